"""Bindings of the two business schemas (order database, shop database) to the driver's Parquet tables.

Each binding is a DataFrame built from the given tables and keeps every row of them. The edge cases the
questions are about (NULL foreign keys, a region without customers, customers without orders or returns,
a month without orders, cities in two regions or missing from the reference) are not in the source
tables; a handful of deterministic expressions *change values* of some rows to make them: a key is set
to NULL, a date moved to the next month, a city renamed. No row is dropped.

Money is cast to ``DECIMAL(18,2)`` (every source amount has at most two decimals) so that sums are exact
and do not depend on the order of a parallel aggregation.

The SQL twin of every binding lives in ``grainline.catalog.views`` and is tested for equality.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from grainline.functions.calendar import date_range_bounds, in_range
from grainline.plans.sizing import bounded_broadcast

MONEY = DecimalType(18, 2)

# Fixed binding values (year mapping and planted cases); the oracle text uses the same ones.
EMPTY_MONTH_START = "1997-08-01"  # the month without orders
EMPTY_MONTH_END = "1997-09-01"
SHOP_HOURS_FROM = 8  # first opening hour of a shop order's synthetic time of day
SHOP_HOURS_SPAN = 12
TWEET_SHIFT_MONTHS = -312  # events (2024) moved into the shop's calendar (1998)
BEVERAGE_TYPES = ("SMALL", "MEDIUM", "LARGE")


def money(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast(MONEY)


@dataclass
class Tables:
    """Lazy access to the driver's tables in one folder."""

    spark: SparkSession
    sf_dir: str
    _cache: dict = field(default_factory=dict)

    def __call__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


class Bench:
    """The order database ("bench") bound to the TPC-H-like tables."""

    # Row bounds that the TPC-H layout fixes whatever the scale (5 regions, 25 nations).
    REGION_ROWS = 5
    NATION_ROWS = 25

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)

    @cached_property
    def regions(self) -> DataFrame:
        return self.t("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))

    @cached_property
    def customers(self) -> DataFrame:
        nation = bounded_broadcast(self.t("nation"), self.NATION_ROWS)
        c = self.t("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("c_custkey")
        region_id = (
            F.when(key % 20 == 7, F.lit(None))
            .when(key % 7 == 0, (F.col("n_regionkey") + 1) % 4)
            .otherwise(F.col("n_regionkey") % 4)
        )
        return c.select(
            key.alias("id"),
            F.col("c_name").alias("name"),
            region_id.cast("int").alias("region_id"),
            F.col("n_name").alias("city"),
            F.col("c_mktsegment").alias("tier"),
            money("c_acctbal").alias("credit"),
            money(key % 6).alias("discount"),
        )

    @staticmethod
    def _order_customer() -> Column:
        """The order's customer; NULL for some orders and for all orders of some customers, who so have none."""
        return F.when((F.col("o_orderkey") % 50 == 3) | (F.col("o_custkey") % 25 == 11), F.lit(None)).otherwise(F.col("o_custkey"))

    def _orders(self, raw: Column | None = None) -> DataFrame:
        o = self.t("orders")
        if raw is not None:
            o = o.where(raw)
        moved = (F.col("o_orderdate") >= F.lit(EMPTY_MONTH_START).cast("timestamp_ntz")) & (
            F.col("o_orderdate") < F.lit(EMPTY_MONTH_END).cast("timestamp_ntz")
        )
        day = F.to_date("o_orderdate")
        return o.select(
            F.col("o_orderkey").alias("id"),
            self._order_customer().alias("customer_id"),
            money("o_totalprice").alias("amount"),
            F.col("o_orderstatus").alias("status"),
            F.when(moved, F.add_months(day, 1)).otherwise(day).alias("order_date"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders()

    def orders_in(self, date_range) -> DataFrame:
        """Orders whose ``order_date`` lies in the period literal or ``[first, last]`` pair.

        ``order_date`` is the raw date but for the orders of one month, moved by a month; the raw date is
        filtered first with the superset ``[start - 1 month, end)``, which the Parquet scan takes, then the
        exact range is applied.
        """
        start, end = date_range_bounds(date_range)
        lo = F.add_months(F.lit(start.isoformat()).cast("date"), -1).cast("timestamp_ntz")
        raw = (F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < F.lit(end.isoformat()).cast("timestamp_ntz"))
        return self._orders(raw).where(in_range("order_date", date_range))

    @cached_property
    def months(self) -> DataFrame:
        """Revenue and orders of every month that has orders."""
        month = F.trunc("order_date", "month").alias("month")
        return self.orders.groupBy(month).agg(F.sum("amount").alias("revenue"), F.count(F.lit(1)).alias("orders"))

    @cached_property
    def order_items(self) -> DataFrame:
        return self.t("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_quantity").alias("quantity"),
            money("l_extendedprice").alias("line_amount"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        """Returned lines per order; those of some customers carry no customer, who so never returned anything."""
        li = self.t("lineitem").filter(F.col("l_returnflag") == "R")
        per_order = li.groupBy("l_orderkey").agg(F.sum(money("l_extendedprice")).cast(MONEY).alias("amount"), F.to_date(F.max("l_shipdate")).alias("return_date"))
        o = self.orders.select("id", F.when(F.col("customer_id") % 5 != 2, F.col("customer_id")).alias("customer_id"))
        return per_order.join(o, F.col("l_orderkey") == F.col("id")).select("id", "customer_id", "amount", "return_date")

    @cached_property
    def products(self) -> DataFrame:
        return self.t("part").select(
            F.col("p_partkey").alias("id"),
            F.col("p_name").alias("name"),
            F.col("p_type").alias("category"),
            money("p_retailprice").alias("list_price"),
        )

    @cached_property
    def campaigns(self) -> DataFrame:
        k = F.col("s_suppkey")
        channel = F.when(k % 10 == 0, "email").when(k % 2 == 1, "social").otherwise("search")
        return self.t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), channel.alias("channel"))

    @cached_property
    def members(self) -> DataFrame:
        return self.members_of()

    def members_of(self, campaigns: DataFrame | None = None) -> DataFrame:
        """Distinct (campaign, customer), of all campaigns or those of a frame (id) only.

        An order's lines are reduced to its distinct campaigns before they meet the order.
        """
        li = self.t("lineitem").select("l_orderkey", F.col("l_suppkey").alias("campaign_id"))
        if campaigns is not None:
            li = li.join(campaigns.select(F.col("id").alias("campaign_id")), "campaign_id", "left_semi")
        o = self.t("orders").select("o_orderkey", F.col("o_custkey").alias("customer_id"))
        return li.distinct().join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("campaign_id", "customer_id").distinct()

    @cached_property
    def cities(self) -> DataFrame:
        """The size of each city per region; some cities are listed under an old name, which no customer has."""
        k = (F.length("city") + F.coalesce("region_id", F.lit(0))) % 3
        size = F.when(k == 0, "large").when(k == 1, "medium").otherwise("small")
        name = F.when(F.length("city") == 5, F.concat(F.col("city"), F.lit(" (OLD)"))).otherwise(F.col("city"))
        return self.customers.select(name.alias("city"), "region_id", size.alias("size_class")).distinct()

    @cached_property
    def events(self) -> DataFrame:
        return self.t("events").select(F.col("event_id").alias("id"), money("value").alias("amount"), F.col("ts").alias("event_ts"))

    @cached_property
    def customer_dims(self) -> DataFrame:
        """Customer attributes with the region name, one row per customer (the lookup of ``orders_flat``)."""
        r = bounded_broadcast(self.regions.select(F.col("id").alias("_rid"), F.col("name").alias("region")), self.REGION_ROWS)
        c = self.customers.join(r, F.col("region_id") == F.col("_rid"), "left")
        return c.select("id", "region_id", "region", "city", "tier", "credit", "discount")

    @cached_property
    def orders_flat(self) -> DataFrame:
        """The flattened star view: orders with their customer's attributes and region name (two left joins)."""
        c = self.customers.select(
            F.col("id").alias("_cid"), "region_id", "city", "tier", "credit", "discount"
        )
        r = bounded_broadcast(self.regions.select(F.col("id").alias("_rid"), F.col("name").alias("region")), self.REGION_ROWS)
        return (
            self.orders.join(c, F.col("customer_id") == F.col("_cid"), "left")
            .join(r, F.col("region_id") == F.col("_rid"), "left")
            .select("id", "customer_id", "amount", "status", "order_date", "region", "city", "tier", "credit", "discount")
        )


class Shop:
    """The shop database ("jaffle") bound to the same tables: store = the customer's nation."""

    STORE_ROWS = Bench.NATION_ROWS

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.t = Tables(spark, sf_dir)

    @staticmethod
    def _tax_rate(nationkey: Column) -> Column:
        return (F.lit(0.04).cast("decimal(6,4)") + (nationkey % 5) * F.lit(0.005).cast("decimal(6,4)")).cast("decimal(6,4)")

    @cached_property
    def stores(self) -> DataFrame:
        n = self.t("nation")
        opened = F.add_months(F.lit("1995-01-01").cast("date"), F.col("n_nationkey") * 4).cast("timestamp_ntz")
        return n.select(
            F.col("n_nationkey").alias("id"),
            F.col("n_name").alias("name"),
            opened.alias("opened_at"),
            self._tax_rate(F.col("n_nationkey")).cast("double").alias("tax_rate"),
        )

    @cached_property
    def customers(self) -> DataFrame:
        return self.t("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    def _orders(self, raw: Column | None = None) -> DataFrame:
        o = self.t("orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
        if raw is not None:
            o = o.where(raw)
        c = self.t("customer").select("c_custkey", "c_nationkey")
        hours = (F.col("o_orderkey") % SHOP_HOURS_SPAN + SHOP_HOURS_FROM).cast("int")
        subtotal = (money("o_totalprice")).cast("decimal(18,0)").cast("long")
        return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer"),
            F.timestamp_add("HOUR", hours, F.col("o_orderdate")).alias("ordered_at"),
            F.col("c_nationkey").alias("store_id"),
            subtotal.alias("subtotal"),
            F.round(subtotal * self._tax_rate(F.col("c_nationkey"))).cast("long").alias("tax_paid"),
        ).withColumn("order_total", F.col("subtotal") + F.col("tax_paid"))

    @cached_property
    def orders(self) -> DataFrame:
        return self._orders()

    def orders_between(self, start: str, end: str) -> DataFrame:
        """Orders with ``start <= ordered_at < end``.

        ``ordered_at`` is the order date plus a synthetic hour, which no scan can filter on; the raw
        order date is filtered first with the superset ``[start - 1 day, end)`` (pushed to Parquet), then
        the exact range is applied.
        """
        lo = F.date_sub(F.lit(start).cast("date"), 1).cast("timestamp_ntz")
        hi = F.lit(end).cast("timestamp_ntz")
        exact = (F.col("ordered_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("ordered_at") < hi)
        return self._orders((F.col("o_orderdate") >= lo) & (F.col("o_orderdate") < hi)).where(exact)

    @cached_property
    def products(self) -> DataFrame:
        kind = F.when(F.col("p_type").isin(*BEVERAGE_TYPES), "beverage").otherwise("jaffle")
        return self.t("part").select(
            F.col("p_partkey").alias("sku"),
            F.col("p_name").alias("name"),
            kind.alias("type"),
            money("p_retailprice").cast("decimal(18,0)").cast("long").alias("price"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self.t("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("sku"))

    def supplies_of(self, sold: DataFrame | None = None) -> DataFrame:
        """Components (sku, supplier, cost), of all products or of the ``sold`` ones (frame with ``sku``) only.

        Lines of other products are left out before the distinct; the supplier's name is not looked up. Nearly all lines
        of a sold product have a supplier of their own, so its pairs come from one sort, which spills, that the joins by
        sku share: a distinct holds them in two hash tables of a task, with a sort before and after.
        """
        li = self.t("lineitem").select(F.col("l_partkey").alias("sku"), F.col("l_suppkey").alias("supplier"))
        if sold is None:
            pairs = li.distinct()
        else:
            sorted_lines = li.where(F.col("sku").isNotNull()).repartition("sku").sortWithinPartitions("sku", "supplier")
            first = F.row_number().over(W.partitionBy("sku", "supplier").orderBy("sku"))
            pairs = sorted_lines.join(sold.select("sku"), "sku", "left_semi").withColumn("__n", first).where("__n = 1").drop("__n")
        return pairs.withColumn("cost", (F.col("sku") % 11 + F.col("supplier") % 7 + 1).cast("long"))

    @cached_property
    def supplier_names(self) -> DataFrame:
        return self.t("supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("name"))

    @cached_property
    def supplies(self) -> DataFrame:
        return self.supplies_of().join(self.supplier_names, "supplier").select(
            F.concat_ws("-", F.col("supplier").cast("string"), F.col("sku").cast("string")).alias("id"),
            "name",
            "cost",
            (F.col("supplier") % 2 == 0).alias("perishable"),
            "sku",
        )

    @cached_property
    def tweets(self) -> DataFrame:
        return self._tweets()

    def tweets_between(self, date_range) -> DataFrame:
        """Tweets of the period: the raw event time, which the scan can filter on, against the bounds moved back."""
        start, end = date_range_bounds(date_range)
        lo, hi = (F.add_months(F.lit(d.isoformat()).cast("date"), -TWEET_SHIFT_MONTHS).cast("timestamp_ntz") for d in (start, end))
        return self._tweets((F.col("ts") >= lo) & (F.col("ts") < hi))

    def _tweets(self, raw: Column | None = None) -> DataFrame:
        e = self.t("events").filter(F.col("event_type") == "click")
        if raw is not None:
            e = e.where(raw)
        return e.select(
            F.col("event_id").alias("id"),
            F.col("user_id"),
            F.timestamp_add("MONTH", F.lit(TWEET_SHIFT_MONTHS), F.col("ts")).alias("tweeted_at"),
            F.col("props").alias("content"),
        )
