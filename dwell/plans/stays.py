"""Mapping of the library's start/end model onto the driver's TPC-H-like tables.

* start  = one ``orders`` row: key ``o_custkey``, time ``o_orderdate``, seq ``o_orderkey``
* end    = a distinct (``o_custkey``, ``l_shipdate``) of ``lineitem`` joined to ``orders``
* second source: ``events`` -- a ``view`` start is ended by the next ``purchase``
  of the same ``user_id``

The stays frame is the paired starts with ``duration_days`` in [0, 365] and the
order attributes used as levels / flags / scores by the evaluation queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import pairing
from ..sources.tables import table

# Fixed parameters of the driver-table mapping.
TRAIN_END = "1999-12-31"
VAL_START = "2000-01-01"
VAL_END = "2000-12-31"
TEST_START = "2001-01-01"
PRED_DIVISOR = 5000.0       # predicted days = o_totalprice / 5000
SCORE_DIVISOR = 600000.0    # score = o_totalprice / 600000
LONG_DAYS = 90.0


def starts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderdate").alias("start_ts"),
        F.col("o_orderkey").alias("seq"), "o_orderstatus", "o_totalprice", "o_orderpriority")


def ends(spark: SparkSession, root: str) -> DataFrame:
    """Distinct (customer, ship date): partial aggregation shrinks it before the
    pairing shuffle."""
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, root, "lineitem").select("l_orderkey", "l_shipdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("o_custkey").alias("key"), F.col("l_shipdate").alias("end_ts"))
            .distinct())


def paired_status(spark: SparkSession, root: str, **kw) -> DataFrame:
    return pairing.pair_status(starts(spark, root), ends(spark, root), "key", "start_ts",
                               "end_ts", seq="seq", **kw)


def paired(spark: SparkSession, root: str, **kw) -> DataFrame:
    return pairing.pair_next(starts(spark, root), ends(spark, root), "key", "start_ts",
                             "end_ts", seq="seq", **kw)


def stays(spark: SparkSession, root: str, lo: float = 0.0, hi: float = 365.0, **kw) -> DataFrame:
    """Paired, with duration, range-filtered; plus the derived evaluation columns."""
    p = pairing.with_duration(paired(spark, root, **kw), "start_ts", "end_ts")
    p = pairing.filter_duration(p, "duration_days", lo, hi)
    return p.withColumns({
        "y_pred": F.col("o_totalprice") / F.lit(PRED_DIVISOR),
        "score": F.col("o_totalprice") / F.lit(SCORE_DIVISOR),
        "is_long": (F.col("duration_days") >= F.lit(LONG_DAYS)).cast("int"),
        "flag_f": F.col("o_orderstatus") == F.lit("F"),
    })


def event_pairs(spark: SparkSession, root: str, **kw) -> DataFrame:
    """``view`` -> next ``purchase`` per user (microsecond timestamps)."""
    ev = table(spark, root, "events").select("event_id", "ts", "user_id", "event_type")
    views = ev.where(F.col("event_type") == "view").select(
        F.col("user_id").alias("key"), F.col("ts").alias("start_ts"), F.col("event_id").alias("seq"))
    buys = ev.where(F.col("event_type") == "purchase").select(
        F.col("user_id").alias("key"), F.col("ts").alias("end_ts"))
    p = pairing.pair_next(views, buys, "key", "start_ts", "end_ts", seq="seq", **kw)
    return pairing.with_duration(p, "start_ts", "end_ts")


# SQL text of the same derivations for the DuckDB oracle.
STARTS_SQL = """starts AS (
  SELECT o_custkey AS key, o_orderdate AS start_ts, o_orderkey AS seq,
         o_orderstatus, o_totalprice, o_orderpriority FROM orders)"""
ENDS_SQL = """ends AS (
  SELECT DISTINCT o.o_custkey AS key, l.l_shipdate AS end_ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""
PAIRED_SQL = """paired AS (
  SELECT s.*, e.end_ts FROM starts s ASOF JOIN ends e ON s.key = e.key AND e.end_ts >= s.start_ts
  QUALIFY row_number() OVER (PARTITION BY s.key, e.end_ts ORDER BY s.start_ts DESC, s.seq DESC) = 1)"""
STAYS_SQL = f"""{STARTS_SQL},
{ENDS_SQL},
{PAIRED_SQL},
stays AS (
  SELECT *, o_totalprice / {PRED_DIVISOR} AS y_pred, o_totalprice / {SCORE_DIVISOR} AS score,
         CAST(duration_days >= {LONG_DAYS} AS INTEGER) AS is_long, o_orderstatus = 'F' AS flag_f
  FROM (SELECT *, date_diff('microsecond', start_ts, end_ts) / 86400000000.0 AS duration_days
        FROM paired)
  WHERE duration_days BETWEEN 0 AND 365)"""
