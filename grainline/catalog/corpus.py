"""Text and log questions over ``documents`` and ``conversations``.

Conversations stand in for trial traces: a conversation is a trace and each turn one call (role as the
tool). Every question is per-row or a grouped aggregate over the whole table; no conversation is ever
collected into one row.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from grainline.catalog.registry import question
from grainline.functions.text import DENY_PHRASES, phrase_pattern, phrase_hits
from grainline.operators import logs
from grainline.sources.bindings import Tables

LONG_CONVERSATION_TURNS = 20  # fixed: the reference's row limit for one answer


def _phrase_sql() -> str:
    def q(x: str) -> str:
        return x.replace("'", "''")

    items = ", ".join(
        f"case when contains(lt, '{q(p.lower())}') and regexp_matches(text, '{q(phrase_pattern(p))}') then '{q(p)}' end" for p in DENY_PHRASES
    )
    return f"""select doc_id, phrase from (
  select doc_id, unnest(list_filter([{items}], lambda x: x is not null)) as phrase
  from (select doc_id, text, lower(text) as lt from documents))"""


@question("b17_phrase_hits", _phrase_sql(), ("B17",))
def b17_phrase_hits(spark, sf_dir):
    """Documents holding a listed phrase as a whole word, any case (one row per document and phrase)."""
    return phrase_hits(Tables(spark, sf_dir)("documents"), "doc_id", "text")


@question(
    "l8_call_digest",
    f"""select conv_id, turn + 1 as call_no, cast(length(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g')) as bigint) as chars,
  '#' || cast(turn + 1 as varchar) || ' `' || role || '` ' ||
  case when length(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g')) <= {logs.DIGEST_CHARS} then regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g')
       else substr(regexp_replace(text, '[\\n\\r\\t ]+', ' ', 'g'), 1, {logs.DIGEST_CHARS - 1}) || '…' end as line
from conversations""",
    ("L8",),
)
def l8_call_digest(spark, sf_dir):
    c = Tables(spark, sf_dir)("conversations")
    return logs.call_digest(c, "conv_id", "turn", "role", "text")


@question(
    "l6_conversation_flags",
    """select conv_id, count(*) as calls,
  bool_or(lower(text) like '%python%') as used_python,
  bool_or(regexp_matches(lower(text), 'select[^;]*from')) as raw_sql,
  bool_or(regexp_matches(text, 'Error executing tool|[A-Za-z_][A-Za-z0-9_.]*(Error|Exception): ')) as query_errors,
  count(*) filter (where role = 'user') > 1 as several_queries
from conversations group by 1""",
    ("L6",),
)
def l6_conversation_flags(spark, sf_dir):
    c = Tables(spark, sf_dir)("conversations")
    return logs.trace_flags(c, "conv_id", "role", "text", query_tool="user")


@question(
    "l16_long_conversations",
    f"select conv_id, count(*) as turns from conversations group by 1 having count(*) > {LONG_CONVERSATION_TURNS}",
    ("L16",),
)
def l16_long_conversations(spark, sf_dir):
    c = Tables(spark, sf_dir)("conversations")
    return logs.oversized_groups(c, ["conv_id"], LONG_CONVERSATION_TURNS, "turns")


@question(
    "l16_role_mix",
    """select role, count(*) as turns, count(distinct conv_id) as conversations, cast(sum(length(text)) as bigint) as chars
from conversations group by 1""",
    ("L16", "L5"),
)
def l16_role_mix(spark, sf_dir):
    c = Tables(spark, sf_dir)("conversations")
    return c.groupBy("role").agg(F.count(F.lit(1)).alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.sum(F.length("text")).cast("long").alias("chars"))
