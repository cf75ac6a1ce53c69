"""Aggregates without a bit-exact SQL twin, compared with DuckDB within a tolerance."""

import math

from scales import SF_MID
from grainline.catalog import all_questions
from grainline.catalog.views import with_views

SQL = """select o.status, stddev_pop(cast(o.amount as double)) as stddev_pop, stddev_samp(cast(o.amount as double)) as stddev_samp,
  var_pop(cast(o.amount as double)) as var_pop, var_samp(cast(o.amount as double)) as var_samp,
  corr(cast(o.amount as double), cast(c.credit as double)) as corr_amount_credit,
  covar_pop(cast(o.amount as double), cast(c.credit as double)) as covar_pop,
  covar_samp(cast(o.amount as double), cast(c.credit as double)) as covar_samp,
  quantile_cont(cast(o.amount as double), 0.9) as p90_amount, count(distinct o.customer_id) as customers
from b_orders o left join b_customers c on c.id = o.customer_id group by 1"""


def test_dispersion_matches_duckdb(spark, duck_mid):
    got = {r["status"]: r for r in all_questions()["d_dispersion_by_status"].build(spark, SF_MID).collect()}
    want = duck_mid.sql(with_views(SQL)).df().set_index("status")
    assert set(got) == set(want.index)
    for status, row in got.items():
        for col in ("stddev_pop", "stddev_samp", "var_pop", "var_samp", "corr_amount_credit", "covar_pop", "covar_samp", "p90_amount"):
            a, b = row[col], float(want.loc[status, col])
            assert math.isclose(a, b, rel_tol=1e-9), (status, col, a, b)
        # approximate aggregates: within their error bounds
        assert abs(row["customers_approx"] - want.loc[status, "customers"]) <= 0.1 * want.loc[status, "customers"]
        assert abs(row["p90_amount_approx"] - want.loc[status, "p90_amount"]) <= 0.01 * want.loc[status, "p90_amount"]
