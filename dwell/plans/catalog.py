"""Registered queries over the driver tables, each with a DuckDB oracle.

Every query reads the whole tables of ``root``; nothing is sampled or capped
except where the cap is the feature (the worst-50 report, the top-levels
report).  Float outputs are rounded to 6 places on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..operators import (audit, breakdown as B, gates, ledger as L, lookup, metrics as M, pairing,
                         ranking, split, stats)
from ..session import reliable_checkpoint, written
from ..sources.tables import table
from . import derived as D
from . import stays as S


class _Stays:
    """The processed stays table, materialised once per query (reliable
    checkpoint): every evaluation block reads it several times (aggregates,
    quantile sorts, rank sorts), and recomputing the pairing for each read
    would multiply the work."""

    @staticmethod
    def stays(spark, root, *columns):
        """All columns, or only those that the query reads: the others are then never written."""
        s = S.stays(spark, root)
        return reliable_checkpoint(s.select(*columns) if columns else s)

    def __getattr__(self, name):
        return getattr(S, name)


MS = _Stays()


class _Derived:
    @staticmethod
    def stays_with_customer(spark, root):
        return reliable_checkpoint(D.stays_with_customer(spark, root))

    def __getattr__(self, name):
        return getattr(D, name)


MD = _Derived()

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS, exact: tuple[str, ...] = ()) -> DataFrame:
    """Round every double column (same rule as the oracle's ``round(x, 6)``) but those in
    ``exact``, which pass a single division's bits through and are equal in both engines."""
    return df.select(*[F.round(F.col(f.name), digits).alias(f.name)
                       if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name not in exact else F.col(f.name)
                       for f in df.schema.fields])


def register(name: str, sql: str | None = None, exact: tuple[str, ...] = ()):
    def deco(fn: Query) -> Query:
        QUERIES[name] = lambda spark, root: rounded(fn(spark, root), exact=exact)
        QUERIES[name].__doc__ = fn.__doc__
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def R(*cols: str) -> str:
    """SQL list ``round(c, 6) AS c`` for the double columns of an oracle."""
    return ", ".join(f"round({c}, {DIGITS}) AS {c}" for c in cols)


W_STAYS = f"WITH {S.STAYS_SQL}"
W_STAYS_C = f"WITH {S.STAYS_SQL},\n{D.STAYS_CUST_SQL}"
TRAIN = (S.TRAIN_END, S.VAL_START, S.VAL_END, S.TEST_START)

# ---------------------------------------------------------------------------
# SQL spellings of the scalar functions (for the oracle only)
# ---------------------------------------------------------------------------
_AGE = r"(?i)^\s*(-?\d+)\s*(day|week|month|year)s?\s*$"
_TZ = r"(?:Z|[+-]\d{2}:?\d{2})\s*$"


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _blank(x: str) -> str:
    return f"nullif({_strip(x)}, '')"


def sql_age_days(x: str) -> str:
    v = f"TRY_CAST(regexp_extract({x}, '{_AGE}', 1) AS BIGINT)"
    unit = f"lower(regexp_extract({x}, '{_AGE}', 2))"
    return (f"CASE WHEN coalesce(regexp_matches({x}, '{_AGE}'), false) AND {v} >= 0 THEN CAST({v} AS DOUBLE) * "
            f"CASE {unit} WHEN 'day' THEN 1.0::DOUBLE WHEN 'week' THEN 7.0::DOUBLE "
            f"WHEN 'month' THEN 30.4375::DOUBLE WHEN 'year' THEN 365.25::DOUBLE END END")


def sql_wall_clock(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_replace({_strip(x)}, '{_TZ}', ''), '') AS TIMESTAMP)"


def sql_age_band(d: str) -> str:
    return (f"CASE WHEN {d} IS NULL OR isnan({d}) THEN 'unknown' WHEN {d} < 60 THEN 'under 2mo' "
            f"WHEN {d} < 180 THEN '2-6mo' WHEN {d} < 365 THEN '6-12mo' WHEN {d} < 1095 THEN '1-3y' "
            f"WHEN {d} < 2555 THEN '3-7y' ELSE '7y+' END")


def sql_season(m: str) -> str:
    return (f"CASE WHEN {m} IN (12, 1, 2) THEN 'Winter' WHEN {m} IN (3, 4, 5) THEN 'Spring' "
            f"WHEN {m} IN (6, 7, 8) THEN 'Summer' WHEN {m} IN (9, 10, 11) THEN 'Fall' END")


def sql_split(ts: str) -> str:
    return (f"CASE WHEN {ts} < TIMESTAMP '2000-01-01' THEN 'train' "
            f"WHEN {ts} >= TIMESTAMP '2000-01-01' AND {ts} < TIMESTAMP '2001-01-01' THEN 'validation' "
            f"WHEN {ts} >= TIMESTAMP '2001-01-01' THEN 'test' END")


def sql_bin(rank: str, n: str, q: int = 10) -> str:
    return f"CASE WHEN {n} <= 1 THEN 0 ELSE greatest(0, (({rank} - 1) * {q} + {n} - 2) // ({n} - 1) - 1) END"


# ---------------------------------------------------------------------------
# Pairing, ledger, breakdowns (the headline slice)
# ---------------------------------------------------------------------------

@register("pair_next", f"""{W_STAYS}
SELECT key, seq, start_ts, end_ts,
       round(CAST(date_diff('microsecond', start_ts, end_ts) AS DOUBLE) / 86400000000.0, 6) AS duration_days
FROM paired""")
def q_pair_next(spark, root):
    """J1 + J2 + P4: every paired start with its end and duration."""
    p = S.paired(spark, root)
    return pairing.with_duration(p, "start_ts", "end_ts").select("key", "seq", "start_ts", "end_ts", "duration_days")


@register("pair_ledger", f"""{W_STAYS},
nxt AS (SELECT s.*, e.end_ts AS next_end FROM starts s ASOF LEFT JOIN ends e
        ON s.key = e.key AND e.end_ts >= s.start_ts),
d AS (SELECT CAST(date_diff('microsecond', start_ts, end_ts) AS DOUBLE) / 86400000000.0 AS dd FROM paired)
SELECT * FROM (VALUES
  ('start unusable', (SELECT count(*) FROM starts WHERE key IS NULL OR start_ts IS NULL),
   'missing key or unparseable start time', 0),
  ('end unusable', (SELECT count(*) FROM ends WHERE key IS NULL OR end_ts IS NULL),
   'missing key or unparseable end time', 1),
  ('no matching end', (SELECT count(*) FROM nxt WHERE next_end IS NULL), 'start has no end at or after it', 2),
  ('end already claimed', (SELECT count(*) FROM nxt WHERE next_end IS NOT NULL) - (SELECT count(*) FROM paired),
   'two starts reached one end; the later start kept', 3),
  ('negative duration', (SELECT count(*) FROM d WHERE dd < 0), 'duration below the lower bound', 4),
  ('duration over cap', (SELECT count(*) FROM d WHERE dd > 365), 'duration above the upper bound', 5))
  AS t(step, dropped, reason, position)""")
def q_pair_ledger(spark, root):
    """Rows dropped per step."""
    st = pairing.with_duration(S.paired_status(spark, root), "start_ts", "end_ts")
    return L.ledger(S.starts(spark, root), S.ends(spark, root), st, "key", "start_ts", "end_ts")


_BD_COLS = ("share", "median_days", "mean_days", "p90_days", "long_stay_rate", "lift_over_base")


def _bd_sql(src: str, by: str, where: str, min_n: int) -> str:
    return f"""lv AS (SELECT CAST({by} AS VARCHAR) AS value, count(*) AS n,
         quantile_cont(duration_days, 0.5) AS median_days, avg(duration_days) AS mean_days,
         quantile_cont(duration_days, 0.9) AS p90_days,
         avg(CAST(duration_days >= 90 AS INTEGER)) AS long_stay_rate,
         CAST(sum(CAST(duration_days >= 90 AS INTEGER)) AS BIGINT) AS long_stay_n
  FROM {src} WHERE {where} GROUP BY 1),
tot AS (SELECT sum(n) AS t, sum(long_stay_n) / sum(n) AS r FROM lv)
SELECT value, n, {R('share', 'median_days', 'mean_days', 'p90_days', 'long_stay_rate', 'lift_over_base')}, long_stay_n
FROM (SELECT lv.*, n / t AS share, CASE WHEN r > 0 THEN long_stay_rate / r END AS lift_over_base
      FROM lv, tot) WHERE value IS NOT NULL AND n >= {min_n}"""


@register("pair_breakdown", f"""{W_STAYS},
{_bd_sql('stays', 'o_orderpriority', 'true', 100)}""")
def q_pair_breakdown(spark, root):
    """A17 by order priority."""
    return B.breakdown(MS.stays(spark, root), "o_orderpriority", min_n=100)


@register("segment_breakdown_open", f"""{W_STAYS_C},
{_bd_sql('stays_c', 'c_mktsegment', "o_orderstatus = 'O'", 100)}""")
def q_segment_breakdown(spark, root):
    """A17 with a where-filter (P10) on a joined level."""
    return B.breakdown(MD.stays_with_customer(spark, root), "c_mktsegment", where={"o_orderstatus": "O"}, min_n=100)


@register("breakdown_summary", f"""{W_STAYS},
part AS (SELECT * FROM stays WHERE o_orderstatus = 'F'),
lv AS (SELECT CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS n FROM part GROUP BY 1)
SELECT (SELECT count(*) FROM part) AS n,
       (SELECT count(*) FROM lv WHERE value IS NOT NULL AND n < 900) AS levels_dropped_below_min_n,
       CAST((SELECT coalesce(sum(n), 0) FROM lv WHERE value IS NOT NULL AND n < 900) AS BIGINT)
         AS rows_dropped_below_min_n,
       round((SELECT avg(duration_days) FROM part), 6) AS overall_mean_days,
       round((SELECT avg(CAST(duration_days >= 90 AS INTEGER)) FROM part), 6) AS overall_long_stay_rate,
       round((SELECT quantile_cont(duration_days, 0.5) FROM part), 6) AS overall_median_days,
       900 AS min_n""")
def q_breakdown_summary(spark, root):
    """A17 overall figures and the levels dropped below min_n."""
    return B.breakdown_summary(MS.stays(spark, root), "o_orderpriority", where={"o_orderstatus": "F"}, min_n=900)


@register("duration_stats", f"""{W_STAYS}
SELECT n, {R('mean_days', 'median_days', 'p90_days', 'p99_days', 'min_days', 'max_days', 'std_days')}
FROM (SELECT avg(duration_days) AS mean_days, quantile_cont(duration_days, 0.5) AS median_days,
             quantile_cont(duration_days, 0.9) AS p90_days, quantile_cont(duration_days, 0.99) AS p99_days,
             min(duration_days) AS min_days, max(duration_days) AS max_days,
             stddev_samp(duration_days) AS std_days, count(duration_days) AS n FROM stays)""")
def q_duration_stats(spark, root):
    """A1."""
    return stats.duration_stats(MS.stays(spark, root))


@register("level_counts", f"""{W_STAYS}
SELECT value, n, {R('median_days', 'share')} FROM (
  SELECT o_orderpriority AS value, count(*) AS n, quantile_cont(duration_days, 0.5) AS median_days,
         count(*) / sum(count(*)) OVER () AS share FROM stays GROUP BY 1)""")
def q_level_counts(spark, root):
    """A2 by order priority."""
    return stats.level_counts(MS.stays(spark, root), "o_orderpriority")


@register("top_levels", f"""{W_STAYS_C}
SELECT value, n, {R('median_days', 'share')} FROM (
  SELECT c_mktsegment AS value, count(*) AS n, quantile_cont(duration_days, 0.5) AS median_days,
         count(*) / sum(count(*)) OVER () AS share FROM stays_c GROUP BY 1)
ORDER BY n DESC, value LIMIT 3""")
def q_top_levels(spark, root):
    """A3: the three most frequent segments."""
    return stats.top_levels(MD.stays_with_customer(spark, root), "c_mktsegment", 3)


@register("flag_contrast", f"""{W_STAYS}
SELECT flag, n, {R('median_days', 'share')}, loose_n FROM (
  SELECT coalesce(flag_f, false) AS flag, count(*) AS n, quantile_cont(duration_days, 0.5) AS median_days,
         count(*) FILTER (WHERE coalesce(starts_with(lower(o_orderpriority), '1'), false)) AS loose_n,
         count(*) / sum(count(*)) OVER () AS share
  FROM stays GROUP BY 1)""")
def q_flag_contrast(spark, root):
    """A5 with the looser 'starts with' count."""
    return stats.flag_contrast(MS.stays(spark, root), F.col("flag_f"), X.starts_with_ci("o_orderpriority", "1"))


@register("split_summary", f"""{W_STAYS},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays),
names AS (SELECT * FROM (VALUES ('train'), ('validation'), ('test')) t(split)),
got AS (SELECT split, count(*) AS rows, min(start_ts) AS min_start, max(start_ts) AS max_start
        FROM lab WHERE split IS NOT NULL GROUP BY 1)
SELECT names.split, coalesce(rows, 0) AS rows, min_start, max_start FROM names LEFT JOIN got USING (split)""")
def q_split_summary(spark, root):
    """P9 + A6."""
    return split.split_summary(S.stays(spark, root), "start_ts", *TRAIN)


# ---------------------------------------------------------------------------
# Regression metrics
# ---------------------------------------------------------------------------

_CORE_SQL = """count(*) AS n, avg(abs(y_pred - duration_days)) AS mae_days,
  quantile_cont(abs(y_pred - duration_days), 0.5) AS median_absolute_error_days,
  sqrt(avg((y_pred - duration_days) * (y_pred - duration_days))) AS rmse_days,
  CASE WHEN var_pop(duration_days) * count(*) > 0
       THEN 1 - sum((y_pred - duration_days) * (y_pred - duration_days)) / (var_pop(duration_days) * count(*))
       WHEN sum((y_pred - duration_days) * (y_pred - duration_days)) = 0 THEN 1.0 ELSE 0.0 END AS r2,
  avg(y_pred - duration_days) AS mean_bias_days, avg(duration_days) AS mean_actual_days,
  avg(y_pred) AS mean_predicted_days,
  avg(CAST(abs(y_pred - duration_days) <= 7 AS DOUBLE)) AS within_7_days_rate,
  avg(CAST(abs(y_pred - duration_days) <= 14 AS DOUBLE)) AS within_14_days_rate"""
_CORE_COLS = ("mae_days", "median_absolute_error_days", "rmse_days", "r2", "mean_bias_days",
              "mean_actual_days", "mean_predicted_days", "within_7_days_rate", "within_14_days_rate")


@register("core_metrics", f"""{W_STAYS}
SELECT n, {R(*_CORE_COLS)} FROM (SELECT {_CORE_SQL} FROM stays)""")
def q_core_metrics(spark, root):
    """A11."""
    return M.core_metrics(MS.stays(spark, root), "duration_days", "y_pred")


@register("metrics_by_group", f"""{W_STAYS}
SELECT "group", n, {R('mae_days', 'median_absolute_error_days', 'mean_actual_days', 'mean_predicted_days')} FROM (
  SELECT CAST(o_orderpriority AS VARCHAR) AS "group", count(*) AS n, avg(abs(y_pred - duration_days)) AS mae_days,
         quantile_cont(abs(y_pred - duration_days), 0.5) AS median_absolute_error_days,
         avg(duration_days) AS mean_actual_days, avg(y_pred) AS mean_predicted_days FROM stays GROUP BY 1)""")
def q_metrics_by_group(spark, root):
    """A12."""
    return M.metrics_by_group(MS.stays(spark, root), "duration_days", "y_pred", "o_orderpriority")


_DECILE_SQL = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY y_pred, seq) AS r, count(*) OVER () AS nn FROM stays),
dec AS (SELECT *, {sql_bin('r', 'nn')} + 1 AS decile FROM ranked)"""


@register("metrics_by_decile", f"""{W_STAYS},
{_DECILE_SQL}
SELECT decile, n, {R('mean_predicted_days', 'mean_actual_days', 'median_actual_days', 'mae_days', 'actual_standard_error')}
FROM (SELECT decile, count(*) AS n, avg(y_pred) AS mean_predicted_days, avg(duration_days) AS mean_actual_days,
             quantile_cont(duration_days, 0.5) AS median_actual_days, avg(abs(y_pred - duration_days)) AS mae_days,
             coalesce(stddev_samp(duration_days) / sqrt(count(*)), 0.0) AS actual_standard_error
      FROM dec GROUP BY decile)""")
def q_metrics_by_decile(spark, root):
    """W1 + A13 (calibration table)."""
    return M.metrics_by_decile(MS.stays(spark, root, "seq", "duration_days", "y_pred"), "duration_days", "y_pred", "seq")


@register("decile_bias", f"""{W_STAYS},
{_DECILE_SQL}
SELECT decile, n, {R('mean_predicted_days', 'mean_actual_days', 'mean_bias_days')}
FROM (SELECT decile, count(*) AS n, avg(y_pred) AS mean_predicted_days, avg(duration_days) AS mean_actual_days,
             avg(y_pred - duration_days) AS mean_bias_days FROM dec GROUP BY decile)""")
def q_decile_bias(spark, root):
    """A14."""
    return M.bias_by_decile(MS.stays(spark, root, "seq", "duration_days", "y_pred"), "duration_days", "y_pred", "seq")


@register("compare_variants", f"""{W_STAYS},
v AS (SELECT seq, duration_days, 'y_pred' AS variant, y_pred AS yh FROM stays
      UNION ALL SELECT seq, duration_days, 'y_pred_b', o_totalprice / 4000.0 FROM stays),
ranked AS (SELECT *, row_number() OVER (PARTITION BY variant ORDER BY yh, seq) AS r,
                  count(*) OVER (PARTITION BY variant) AS nn FROM v),
dec AS (SELECT *, {sql_bin('r', 'nn')} + 1 AS decile FROM ranked),
worst AS (SELECT variant, max(abs(b)) AS max_abs_decile_bias_days
          FROM (SELECT variant, decile, avg(yh - duration_days) AS b FROM dec GROUP BY ALL) GROUP BY variant),
core AS (SELECT variant, {_CORE_SQL.replace('y_pred', 'yh')} FROM v GROUP BY variant)
SELECT variant, n, {R(*_CORE_COLS, 'max_abs_decile_bias_days')} FROM core JOIN worst USING (variant)""")
def q_compare_variants(spark, root):
    """A15 over two prediction columns."""
    s = MS.stays(spark, root, "seq", "duration_days", "y_pred", "o_totalprice").withColumn("y_pred_b", F.col("o_totalprice") / F.lit(4000.0))
    return M.compare_variants(s, "duration_days", ["y_pred", "y_pred_b"], "seq")


@register("interval_calibration", f"""{W_STAYS},
b AS (SELECT duration_days AS y, y_pred * 0.5 AS lo, y_pred AS mid, y_pred * 1.5 AS hi FROM stays)
SELECT {R('nominal_coverage', 'empirical_coverage', 'below_interval_rate', 'above_interval_rate',
          'mean_interval_width_days', 'median_interval_width_days', 'quantile_crossing_rate', 'median_model_mae_days')}
FROM (SELECT 0.8::DOUBLE AS nominal_coverage, avg(CAST(y >= lo AND y <= hi AS DOUBLE)) AS empirical_coverage,
             avg(CAST(y < lo AS DOUBLE)) AS below_interval_rate, avg(CAST(y > hi AS DOUBLE)) AS above_interval_rate,
             avg(hi - lo) AS mean_interval_width_days, quantile_cont(hi - lo, 0.5) AS median_interval_width_days,
             avg(CAST(lo > hi AS DOUBLE)) AS quantile_crossing_rate, avg(abs(mid - y)) AS median_model_mae_days FROM b)""")
def q_interval_calibration(spark, root):
    """A16 with a 0.5x / 1x / 1.5x band."""
    s = MS.stays(spark, root).withColumns({"lo": F.col("y_pred") * 0.5, "hi": F.col("y_pred") * 1.5})
    return M.interval_calibration(s, "duration_days", "lo", "y_pred", "hi")


_TAIL_COLS = ("threshold_days", "share_of_test", "mean_actual_days", "median_actual_days", "mean_predicted_days",
              "median_predicted_days", "mae_days", "mean_bias_days", "under_predicted_rate",
              "predicted_over_threshold_rate", "recall_in_top_decile", "recall_in_top_two_deciles",
              "base_rate_top_decile", "above_p90_band_rate")


@register("tail_analysis", f"""{W_STAYS},
{_DECILE_SQL},
d2 AS (SELECT *, duration_days >= 90 AS lg, CASE WHEN nn > 1 THEN 10 ELSE 1 END AS top FROM dec)
SELECT n, {R(*_TAIL_COLS)} FROM (
  SELECT 90.0::DOUBLE AS threshold_days, count(*) FILTER (WHERE lg) AS n, avg(CAST(lg AS DOUBLE)) AS share_of_test,
    avg(duration_days) FILTER (WHERE lg) AS mean_actual_days,
    quantile_cont(duration_days, 0.5) FILTER (WHERE lg) AS median_actual_days,
    avg(y_pred) FILTER (WHERE lg) AS mean_predicted_days,
    quantile_cont(y_pred, 0.5) FILTER (WHERE lg) AS median_predicted_days,
    avg(abs(y_pred - duration_days)) FILTER (WHERE lg) AS mae_days,
    avg(y_pred - duration_days) FILTER (WHERE lg) AS mean_bias_days,
    avg(CAST(y_pred < duration_days AS DOUBLE)) FILTER (WHERE lg) AS under_predicted_rate,
    avg(CAST(y_pred >= 90 AS DOUBLE)) FILTER (WHERE lg) AS predicted_over_threshold_rate,
    avg(CAST(decile = top AS DOUBLE)) FILTER (WHERE lg) AS recall_in_top_decile,
    avg(CAST(decile >= top - 1 AS DOUBLE)) FILTER (WHERE lg) AS recall_in_top_two_deciles,
    avg(CAST(lg AS DOUBLE)) FILTER (WHERE decile = top) AS base_rate_top_decile,
    avg(CAST(duration_days > y_pred * 1.5 AS DOUBLE)) FILTER (WHERE lg) AS above_p90_band_rate
  FROM d2)""")
def q_tail_analysis(spark, root):
    """A23."""
    s = MS.stays(spark, root).withColumn("hi", F.col("y_pred") * 1.5)
    return M.tail_analysis(s, "duration_days", "y_pred", "seq", hi="hi")


@register("worst_predictions", f"""{W_STAYS}
SELECT key, seq, start_ts, end_ts, round(duration_days, 6) AS duration_days, round(y_pred, 6) AS predicted_days,
       round(abs(y_pred - duration_days), 6) AS absolute_error_days,
       round(y_pred - duration_days, 6) AS signed_error_days
FROM stays ORDER BY abs(y_pred - duration_days) DESC, seq LIMIT 50""")
def q_worst_predictions(spark, root):
    """The 50 largest absolute errors."""
    w = stats.worst_predictions(S.stays(spark, root), "duration_days", "y_pred", 50, tie="seq")
    return w.select("key", "seq", "start_ts", "end_ts", "duration_days", "predicted_days",
                    "absolute_error_days", "signed_error_days")


_WORST_SQL = """worst AS (SELECT *, y_pred AS predicted_days, abs(y_pred - duration_days) AS absolute_error_days,
       y_pred - duration_days AS signed_error_days FROM stays
  ORDER BY abs(y_pred - duration_days) DESC, seq LIMIT 50)"""


@register("characterise_failures", f"""{W_STAYS},
{_WORST_SQL}
SELECT n, under_predicted, over_predicted, {R('mean_actual_days', 'mean_predicted_days', 'min_actual_days',
  'max_actual_days', 'mean_absolute_error_days', 'flag_rate')} FROM (
  SELECT count(*) AS n, count(*) FILTER (WHERE signed_error_days < 0) AS under_predicted,
         count(*) FILTER (WHERE NOT signed_error_days < 0) AS over_predicted,
         avg(duration_days) AS mean_actual_days, avg(predicted_days) AS mean_predicted_days,
         min(duration_days) AS min_actual_days, max(duration_days) AS max_actual_days,
         avg(absolute_error_days) AS mean_absolute_error_days, avg(CAST(flag_f AS DOUBLE)) AS flag_rate FROM worst)""")
def q_characterise_failures(spark, root):
    """A24 numbers over the worst 50."""
    w = stats.worst_predictions(S.stays(spark, root), "duration_days", "y_pred", 50, tie="seq")
    return B.characterise_failures(w, "duration_days", "flag_f")


@register("failure_levels", f"""{W_STAYS},
{_WORST_SQL}
SELECT "column", value, count(*) AS count FROM (
  SELECT 'o_orderpriority' AS "column", o_orderpriority AS value FROM worst
  UNION ALL SELECT 'o_orderstatus', o_orderstatus FROM worst) GROUP BY ALL""")
def q_failure_levels(spark, root):
    """A24 level counts of the worst 50."""
    w = stats.worst_predictions(S.stays(spark, root), "duration_days", "y_pred", 50, tie="seq")
    return B.failure_levels(w, ["o_orderpriority", "o_orderstatus"])


# ---------------------------------------------------------------------------
# Classifier metrics
# ---------------------------------------------------------------------------

_CURVE_SQL = """by_t AS (SELECT score AS threshold, CAST(sum(is_long) AS BIGINT) AS tp_at,
                 CAST(sum(1 - is_long) AS BIGINT) AS fp_at FROM stays GROUP BY 1),
curve AS (SELECT *, sum(tp_at) OVER (ORDER BY threshold DESC) AS tp, sum(fp_at) OVER (ORDER BY threshold DESC) AS fp,
                 sum(tp_at) OVER () AS positives, sum(fp_at) OVER () AS negatives FROM by_t),
curve2 AS (SELECT *, tp / (tp + fp) AS precision, tp / positives AS recall FROM curve)"""


@register("pr_curve", f"""{W_STAYS},
{_CURVE_SQL}
SELECT threshold, tp_at, fp_at, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
       {R('precision', 'recall')}, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives
FROM curve2""", exact=("threshold",))
def q_pr_curve(spark, root):
    """Precision / recall at every distinct score."""
    return ranking.pr_curve(S.stays(spark, root), "score", "is_long")


@register("classifier_metrics", f"""{W_STAYS},
{_CURVE_SQL}
SELECT {R('pr_auc', 'pr_auc_baseline', 'pr_auc_lift', 'roc_auc', 'brier_score', 'positive_rate')}, n FROM (
  SELECT sum(tp_at * precision) / max(positives) AS pr_auc, max(positives) / (max(positives) + max(negatives)) AS pr_auc_baseline,
    CASE WHEN max(positives) > 0 THEN (sum(tp_at * precision) / max(positives)) / (max(positives) / (max(positives) + max(negatives))) END AS pr_auc_lift,
    sum(fp_at * (2 * tp - tp_at)) / (2.0 * max(positives) * max(negatives)) AS roc_auc,
    sum(tp_at * (threshold - 1) * (threshold - 1) + fp_at * threshold * threshold) / (max(positives) + max(negatives)) AS brier_score,
    max(positives) / (max(positives) + max(negatives)) AS positive_rate,
    CAST(max(positives) + max(negatives) AS BIGINT) AS n FROM curve2)""")
def q_classifier_metrics(spark, root):
    """AP (step sum), ROC-AUC, Brier, base rate, lift."""
    return M.classifier_metrics(S.stays(spark, root), "score", "is_long")


@register("threshold_at", f"""{W_STAYS},
{_CURVE_SQL}
SELECT max(threshold) FILTER (WHERE recall >= 0.5) AS threshold_for_recall,
       min(threshold) FILTER (WHERE precision >= 0.1) AS threshold_for_precision FROM curve2""",
          exact=("threshold_for_recall", "threshold_for_precision"))
def q_threshold_at(spark, root):
    """Highest threshold with recall >= 0.5, lowest with precision >= 0.1."""
    c = ranking.pr_curve(S.stays(spark, root), "score", "is_long")
    return c.agg(F.max(F.when(F.col("recall") >= 0.5, F.col("threshold"))).alias("threshold_for_recall"),
                 F.min(F.when(F.col("precision") >= 0.1, F.col("threshold"))).alias("threshold_for_precision"))


@register("operating_points", f"""{W_STAYS},
t AS (SELECT * FROM (VALUES (0.1::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)) v(threshold)),
c AS (SELECT t.threshold, count(*) FILTER (WHERE score >= threshold AND is_long = 1) AS tp,
             count(*) FILTER (WHERE score >= threshold AND is_long <> 1) AS fp,
             count(*) FILTER (WHERE score < threshold AND is_long = 1) AS fn,
             count(*) FILTER (WHERE score < threshold AND is_long <> 1) AS tn, count(*) AS nn
      FROM stays, t GROUP BY t.threshold),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
             CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT round(threshold, 6) AS threshold, {R('precision', 'recall', 'f1', 'flagged_rate')}, flagged,
       tn AS true_negative, fp AS false_positive, fn AS false_negative, tp AS true_positive FROM (
  SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1,
         tp + fp AS flagged, (tp + fp) / nn AS flagged_rate FROM p)""")
def q_operating_points(spark, root):
    """A25 at three thresholds in one pass."""
    return M.operating_points(S.stays(spark, root), "score", "is_long", [0.1, 0.3, 0.5])


_REL_SQL = f"""ranked AS (SELECT *, row_number() OVER (ORDER BY score, seq) AS r, count(*) OVER () AS nn FROM stays),
rb AS (SELECT *, {sql_bin('r', 'nn')} + 1 AS bin FROM ranked),
rel AS (SELECT bin, count(*) AS n, avg(score) AS mean_predicted_probability,
               avg(CAST(is_long AS DOUBLE)) AS actual_positive_rate FROM rb GROUP BY bin)"""


@register("reliability_table", f"""{W_STAYS},
{_REL_SQL}
SELECT bin, n, {R('mean_predicted_probability', 'actual_positive_rate', 'standard_error')} FROM (
  SELECT *, sqrt(actual_positive_rate * (1 - actual_positive_rate) / n) AS standard_error FROM rel)""")
def q_reliability_table(spark, root):
    """A27."""
    return M.reliability_table(MS.stays(spark, root, "seq", "score", "is_long"), "score", "is_long", "seq")


@register("ece", f"""{W_STAYS},
{_REL_SQL}
SELECT round(sum(n * abs(mean_predicted_probability - actual_positive_rate)) / sum(n), 6) AS ece FROM rel""")
def q_ece(spark, root):
    """A28."""
    return M.expected_calibration_error(M.reliability_table(MS.stays(spark, root, "seq", "score", "is_long"), "score", "is_long", "seq"))


@register("classifier_by_group", f"""{W_STAYS},
by_t AS (SELECT o_orderpriority AS "group", score AS threshold, CAST(sum(is_long) AS BIGINT) AS tp_at,
                CAST(sum(1 - is_long) AS BIGINT) AS fp_at FROM stays GROUP BY 1, 2),
curve AS (SELECT *, sum(tp_at) OVER (PARTITION BY "group" ORDER BY threshold DESC) AS tp,
                 sum(fp_at) OVER (PARTITION BY "group" ORDER BY threshold DESC) AS fp,
                 sum(tp_at) OVER (PARTITION BY "group") AS positives,
                 sum(fp_at) OVER (PARTITION BY "group") AS negatives FROM by_t),
c2 AS (SELECT *, tp / (tp + fp) AS precision FROM curve),
g AS (SELECT "group", sum(tp_at * precision) / max(positives) AS pr_auc,
             max(positives) / (max(positives) + max(negatives)) AS pr_auc_baseline,
             sum(fp_at * (2 * tp - tp_at)) / (2.0 * max(positives) * max(negatives)) AS roc_auc,
             sum(tp_at * (threshold - 1) * (threshold - 1) + fp_at * threshold * threshold)
               / (max(positives) + max(negatives)) AS brier_score,
             CAST(max(positives) + max(negatives) AS BIGINT) AS n FROM c2 GROUP BY 1)
SELECT "group", {R('pr_auc', 'pr_auc_baseline', 'pr_auc_lift', 'roc_auc', 'brier_score', 'positive_rate', 'min_lift')},
       n, pr_auc_lift >= 2.0 AS reliable FROM (
  SELECT *, CASE WHEN pr_auc_baseline > 0 THEN pr_auc / pr_auc_baseline END AS pr_auc_lift,
         pr_auc_baseline AS positive_rate, 2.0::DOUBLE AS min_lift FROM g)
WHERE n >= 50 AND positive_rate * n >= 5""")
def q_classifier_by_group(spark, root):
    """A35 + A34 per order priority."""
    return M.classifier_by_group(S.stays(spark, root), "o_orderpriority", "score", "is_long")


# ---------------------------------------------------------------------------
# Rank statistics, smearing
# ---------------------------------------------------------------------------

@register("spearman", f"""{W_STAYS}
SELECT round(corr(ra, rb), 6) AS spearman FROM (
  SELECT rank() OVER (ORDER BY y_pred) + (count(*) OVER (PARTITION BY y_pred) - 1) / 2.0 AS ra,
         rank() OVER (ORDER BY duration_days) + (count(*) OVER (PARTITION BY duration_days) - 1) / 2.0 AS rb
  FROM stays)""")
def q_spearman(spark, root):
    """Spearman correlation of prediction and duration (average ranks)."""
    return ranking.spearman(MS.stays(spark, root), "y_pred", "duration_days")


@register("rank_preserving", f"""{W_STAYS},
p AS (SELECT y_pred AS b, least(365.0, y_pred * 1.2) AS a1, CASE WHEN seq % 97 = 0 THEN 0.0 ELSE y_pred END AS a2
      FROM stays),
blk AS (SELECT b, min(a1) AS lo1, max(a1) AS hi1, min(a2) AS lo2, max(a2) AS hi2 FROM p GROUP BY b),
pre AS (SELECT *, max(hi1) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph1,
               max(hi2) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ph2 FROM blk),
tol AS (SELECT 1e-9 * greatest(1.0, max(abs(a1))) AS t1, 1e-9 * greatest(1.0, max(abs(a2))) AS t2 FROM p)
SELECT coalesce(bool_and(ph1 IS NULL OR lo1 - ph1 >= -t1), true) AS clipped_scale_preserves,
       coalesce(bool_and(ph2 IS NULL OR lo2 - ph2 >= -t2), true) AS zeroed_rows_preserve FROM pre, tol""")
def q_rank_preserving(spark, root):
    """W3 on a monotone map (preserves) and on a perturbed copy (inverts)."""
    s = MS.stays(spark, root).withColumns({
        "a1": F.least(F.lit(365.0), F.col("y_pred") * 1.2),
        "a2": F.when(F.col("seq") % 97 == 0, F.lit(0.0)).otherwise(F.col("y_pred"))})
    r1 = ranking.rank_preserving(s, "y_pred", "a1", "clipped_scale_preserves")
    r2 = ranking.rank_preserving(s, "y_pred", "a2", "zeroed_rows_preserve")
    return B._one_row(r1, r2)


@register("smearing", f"""{W_STAYS}
SELECT {R('smearing_factor', 'residual_std')}, n FROM (
  SELECT avg(exp(ln(1 + duration_days) - ln(1 + y_pred))) AS smearing_factor,
         stddev_pop(ln(1 + duration_days) - ln(1 + y_pred)) AS residual_std, count(*) AS n FROM stays)""")
def q_smearing(spark, root):
    """A29 with log1p(y_pred) as the log-space model."""
    s = S.stays(spark, root).withColumn("f", F.log1p("y_pred"))
    return M.fit_smearing(s, "duration_days", "f")


@register("clipping_counts", f"""{W_STAYS},
c AS (SELECT least(365.0, greatest(0.0, y_pred)) AS b, least(365.0, greatest(0.0, y_pred * 1.3)) AS a FROM stays)
SELECT *, clipped_at_ceiling_after - clipped_at_ceiling_before + clipped_at_floor_after - clipped_at_floor_before
          AS ties_introduced_by_clipping FROM (
  SELECT count(*) FILTER (WHERE b >= 365) AS clipped_at_ceiling_before, count(*) FILTER (WHERE a >= 365) AS clipped_at_ceiling_after,
         count(*) FILTER (WHERE b <= 0) AS clipped_at_floor_before, count(*) FILTER (WHERE a <= 0) AS clipped_at_floor_after FROM c)""")
def q_clipping_counts(spark, root):
    """A30 counts: ties introduced by clipping after a 1.3x correction."""
    s = S.stays(spark, root).withColumns({"b": X.clip_days(F.col("y_pred")),
                                          "a": X.clip_days(F.col("y_pred") * 1.3)})
    return M.clipping_counts(s, "b", "a")


# ---------------------------------------------------------------------------
# Effects, shares, contrasts
# ---------------------------------------------------------------------------

@register("load_share", f"""{W_STAYS}
SELECT n_entities, {R('total_entity_days', 'quick_exit_days_threshold', 'quick_exit_share_of_entities',
  'quick_exit_share_of_entity_days', 'long_stay_days_threshold', 'long_stay_share_of_entities',
  'long_stay_share_of_entity_days', 'long_stay_mean_days')} FROM (
  SELECT count(*) AS n_entities, sum(duration_days) AS total_entity_days, 7.0::DOUBLE AS quick_exit_days_threshold,
    avg(CAST(duration_days <= 7 AS DOUBLE)) AS quick_exit_share_of_entities,
    sum(CASE WHEN duration_days <= 7 THEN duration_days ELSE 0 END) / sum(duration_days) AS quick_exit_share_of_entity_days,
    90.0::DOUBLE AS long_stay_days_threshold, avg(CAST(duration_days >= 90 AS DOUBLE)) AS long_stay_share_of_entities,
    sum(CASE WHEN duration_days >= 90 THEN duration_days ELSE 0 END) / sum(duration_days) AS long_stay_share_of_entity_days,
    coalesce(avg(duration_days) FILTER (WHERE duration_days >= 90), 0.0) AS long_stay_mean_days FROM stays)""")
def q_load_share(spark, root):
    """A19."""
    return B.load_share(S.stays(spark, root))


_EFFECT_SQL = """st AS (SELECT o_orderpriority, start_month,
              count(*) FILTER (WHERE flag_f) AS n1, count(*) FILTER (WHERE NOT flag_f) AS n0,
              sum(CASE WHEN flag_f THEN is_long ELSE 0 END) AS y1, sum(CASE WHEN NOT flag_f THEN is_long ELSE 0 END) AS y0
       FROM stays_c WHERE flag_f IS NOT NULL GROUP BY ALL),
s2 AS (SELECT *, o_orderpriority IS NOT NULL AND start_month IS NOT NULL AND n1 > 0 AND n0 > 0 AND n1 + n0 >= 40 AS ok,
              y1 / n1 AS p1, y0 / n0 AS p0, n1 + n0 AS n FROM st),
s3 AS (SELECT *, p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0 AS var FROM s2),
agg AS (SELECT count(*) FILTER (WHERE ok) > 0 AS usable, sum(y1) / sum(n1) AS rf, sum(y0) / sum(n0) AS ru,
               sum(n * (p1 - p0)) FILTER (WHERE ok) / sum(n) FILTER (WHERE ok) AS est,
               sqrt(sum(n * n * var) FILTER (WHERE ok)) / sum(n) FILTER (WHERE ok) AS se,
               count(*) FILTER (WHERE ok) AS strata_used, coalesce(sum(n) FILTER (WHERE ok), 0) AS retained,
               sum(n) AS total FROM s3)"""


@register("controlled_effect", f"""{W_STAYS_C},
{_EFFECT_SQL}
SELECT usable, round(rf, 6) AS raw_rate_flagged, round(ru, 6) AS raw_rate_unflagged,
       round((rf - ru) * 100, 6) AS raw_difference_pp, round(est * 100, 6) AS controlled_difference_pp,
       round((est - 1.96 * se) * 100, 6) AS ci95_low_pp, round((est + 1.96 * se) * 100, 6) AS ci95_high_pp,
       round(se * 100, 6) AS standard_error_pp, strata_used, CAST(retained AS BIGINT) AS rows_retained,
       round(retained / total, 6) AS coverage, coalesce(abs(est) > 1.96 * se, false) AS significant,
       CASE WHEN NOT usable THEN 'no stratum contained both groups' END AS reason FROM agg""")
def q_controlled_effect(spark, root):
    """Effect of status F on the long rate within (priority, month) strata."""
    return B.controlled_effect(D.stays_with_customer(spark, root), "flag_f", ["o_orderpriority", "start_month"])


_OVR_COLS = ("o_orderpriority", "o_orderstatus", "c_mktsegment")


@register("over_representation", f"""{W_STAYS_C},
u AS (SELECT 'o_orderpriority' AS "column", CAST(o_orderpriority AS VARCHAR) AS value, is_long FROM stays_c
      UNION ALL SELECT 'o_orderstatus', CAST(o_orderstatus AS VARCHAR), is_long FROM stays_c
      UNION ALL SELECT 'c_mktsegment', CAST(c_mktsegment AS VARCHAR), is_long FROM stays_c),
lv AS (SELECT "column", value, count(*) AS n, sum(is_long) AS n_long FROM u WHERE value IS NOT NULL GROUP BY ALL),
sh AS (SELECT *, n_long / sum(n_long) OVER (PARTITION BY "column") AS share_of_long_stays,
              n / sum(n) OVER (PARTITION BY "column") AS share_of_all FROM lv),
rk AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n_long DESC, value) AS r FROM sh WHERE n_long > 0)
SELECT "column", value, {R('share_of_long_stays', 'share_of_all', 'over_representation')} FROM (
  SELECT *, share_of_long_stays / share_of_all AS over_representation FROM rk)
WHERE r <= 6 AND share_of_all > 0.01 AND over_representation > 1.0""")
def q_over_representation(spark, root):
    """A21 (ratio floor 1.0 so the driver data yields rows)."""
    return B.over_representation(MD.stays_with_customer(spark, root), list(_OVR_COLS), min_ratio=1.0)


@register("feature_contrast", f"""{W_STAYS_C},
part AS (SELECT * FROM stays_c WHERE o_orderstatus = 'O'),
base AS (SELECT avg(CAST(is_long AS DOUBLE)) AS b FROM part),
u AS (SELECT 'o_orderpriority' AS "column", CAST(o_orderpriority AS VARCHAR) AS value, is_long FROM part
      UNION ALL SELECT 'c_mktsegment', CAST(c_mktsegment AS VARCHAR), is_long FROM part
      UNION ALL SELECT 'start_month', CAST(start_month AS VARCHAR), is_long FROM part),
lv AS (SELECT "column", value, count(*) AS n, avg(CAST(is_long AS DOUBLE)) AS long_stay_rate
       FROM u GROUP BY ALL HAVING value IS NOT NULL AND count(*) >= 100),
x AS (SELECT lv.*, CASE WHEN b > 0 THEN long_stay_rate / b END AS lift_over_base,
             max(long_stay_rate) OVER (PARTITION BY "column") - min(long_stay_rate) OVER (PARTITION BY "column") AS spread,
             row_number() OVER (PARTITION BY "column" ORDER BY long_stay_rate DESC, value) AS top_rank,
             row_number() OVER (PARTITION BY "column" ORDER BY long_stay_rate, value DESC) AS bottom_rank
      FROM lv, base),
sp AS (SELECT "column", row_number() OVER (ORDER BY spread DESC, "column") AS spread_rank
       FROM (SELECT DISTINCT "column", spread FROM x))
SELECT "column", value, n, {R('long_stay_rate', 'lift_over_base', 'spread')}, top_rank, bottom_rank, spread_rank
FROM x JOIN sp USING ("column") WHERE top_rank <= 3 OR bottom_rank <= 3""")
def q_feature_contrast(spark, root):
    """A18 + T3 within open orders."""
    s = MD.stays_with_customer(spark, root)
    return B.feature_contrast(s, ["o_orderpriority", "c_mktsegment", "start_month"], where={"o_orderstatus": "O"})


@register("flag_timing", f"""{W_STAYS}
SELECT value, n, {R('flag_rate', 'long_rate_flagged', 'long_rate_unflagged', 'flagged_over_unflagged')} FROM (
  SELECT *, CASE WHEN long_rate_unflagged <> 0 THEN long_rate_flagged / long_rate_unflagged END AS flagged_over_unflagged
  FROM (SELECT CAST(o_orderpriority AS VARCHAR) AS value, count(*) AS n,
               avg(CAST(coalesce(flag_f, false) AS DOUBLE)) AS flag_rate,
               avg(CAST(is_long AS DOUBLE)) FILTER (WHERE coalesce(flag_f, false)) AS long_rate_flagged,
               avg(CAST(is_long AS DOUBLE)) FILTER (WHERE NOT coalesce(flag_f, false)) AS long_rate_unflagged
        FROM stays GROUP BY 1))""")
def q_flag_timing(spark, root):
    """A22 per circumstance level."""
    return B.flag_timing_by_level(S.stays(spark, root), "flag_f", "o_orderpriority")


@register("flag_timing_summary", f"""{W_STAYS}
SELECT {R('flag_rate_among_long', 'flag_rate_among_rest', 'flag_rate_all')} FROM (
  SELECT avg(CAST(coalesce(flag_f, false) AS DOUBLE)) FILTER (WHERE duration_days >= 90) AS flag_rate_among_long,
         avg(CAST(coalesce(flag_f, false) AS DOUBLE)) FILTER (WHERE duration_days < 90) AS flag_rate_among_rest,
         avg(CAST(coalesce(flag_f, false) AS DOUBLE)) AS flag_rate_all FROM stays)""")
def q_flag_timing_summary(spark, root):
    """A22 overall."""
    return B.flag_timing_summary(S.stays(spark, root), "flag_f")


CELL = ["o_orderpriority", "o_orderstatus", "c_nationkey", "start_month"]  # fine enough that some are unseen
_CELL_SQL = ", ".join(CELL)


@register("group_median_lookup", f"""{W_STAYS_C},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays_c),
cells AS (SELECT {_CELL_SQL}, quantile_cont(duration_days, 0.5) AS cell_median FROM lab WHERE split = 'train' GROUP BY ALL),
gm AS (SELECT quantile_cont(duration_days, 0.5) AS g FROM lab WHERE split = 'train')
SELECT seq, round(least(365.0, greatest(0.0, coalesce(cell_median, gm.g))), 6) AS baseline_days
FROM lab LEFT JOIN cells USING ({_CELL_SQL}), gm WHERE split = 'test'""")
def q_group_median_lookup(spark, root):
    """A7 + A8 + J4: cell medians fitted on train, global median for unseen cells, clipped, applied to test."""
    lab = split.temporal_split(MD.stays_with_customer(spark, root), "start_ts", *TRAIN)
    train = lab.where(F.col("split") == "train")
    cells = lookup.group_median_table(train, CELL, "duration_days")
    glob = ranking.group_quantiles(train, "duration_days", [0.5], ["_g"])
    test = B._attach(lab.where(F.col("split") == "test"), glob)
    return lookup.lookup_with_fallback(test, cells, CELL, "cell_median", F.col("_g"), "baseline_days").select("seq", "baseline_days")


@register("unseen_cell_rate", f"""{W_STAYS_C},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays_c),
cells AS (SELECT DISTINCT {_CELL_SQL}, true AS seen FROM lab WHERE split = 'train')
SELECT round(avg(CAST(c.seen IS NULL AS DOUBLE)), 6) AS unseen_cell_rate
FROM lab l LEFT JOIN cells c USING ({_CELL_SQL}) WHERE l.split = 'test'""")
def q_unseen_cell_rate(spark, root):
    """The distinct cells of the training period against the test period."""
    lab = split.temporal_split(MD.stays_with_customer(spark, root).select("start_ts", *CELL), "start_ts", *TRAIN)
    return lookup.unseen_cell_rate(lab.where(F.col("split") == "test"), lab.where(F.col("split") == "train"), CELL)


@register("censoring_horizon", f"""{W_STAYS}
SELECT max(end_ts) AS censoring_horizon FROM stays""")
def q_censoring_horizon(spark, root):
    """A37."""
    return stats.censoring_horizon(S.stays(spark, root))


@register("year_span", """SELECT round(floor(epoch(max(ts) - min(ts)) / 86400) / 365.25, 6) AS years_covered FROM events""")
def q_year_span(spark, root):
    """On events, whose times are not at midnight."""
    return stats.year_span(table(spark, root, "events"), "ts")


@register("level_range", f"""{W_STAYS},
lv AS (SELECT o_orderpriority, quantile_cont(duration_days, 0.5) AS m FROM stays GROUP BY 1 HAVING count(*) >= 100)
SELECT round(min(m), 6) AS min_value, round(max(m), 6) AS max_value,
       round(CASE WHEN min(m) <> 0 THEN max(m) / min(m) END, 6) AS max_over_min FROM lv""")
def q_level_range(spark, root):
    """A38 over the A17 medians."""
    return stats.level_range(B.breakdown(MS.stays(spark, root), "o_orderpriority", min_n=100))


@register("event_pairs", """WITH v AS (SELECT user_id AS key, ts AS start_ts, event_id AS seq FROM events WHERE event_type = 'view'),
p AS (SELECT user_id AS key, ts AS end_ts FROM events WHERE event_type = 'purchase'),
x AS (SELECT v.*, p.end_ts FROM v ASOF JOIN p ON v.key = p.key AND p.end_ts >= v.start_ts
      QUALIFY row_number() OVER (PARTITION BY v.key, p.end_ts ORDER BY v.start_ts DESC, v.seq DESC) = 1)
SELECT key, seq, start_ts, end_ts,
       round(CAST(date_diff('microsecond', start_ts, end_ts) AS DOUBLE) / 86400000000.0, 6) AS duration_days FROM x""")
def q_event_pairs(spark, root):
    """J1 + J2 on the events table (view -> next purchase, microsecond times)."""
    return S.event_pairs(spark, root).select("key", "seq", "start_ts", "end_ts", "duration_days")


# ---------------------------------------------------------------------------
# Audits and checks
# ---------------------------------------------------------------------------

_LAG_SQL = """lagged AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority,
       lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_o_orderstatus,
       lag(o_orderpriority) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS prev_o_orderpriority
  FROM orders)"""


def _lagged_orders(spark, root):
    from ..operators.keyed import keyed_lag
    o = table(spark, root, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return keyed_lag(o, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"],
                     pairing.ts_micros(o, "o_orderdate"))


@register("transitions", f"""WITH {_LAG_SQL}
SELECT prev_o_orderstatus AS before, o_orderstatus AS after, count(*) AS n FROM lagged
WHERE prev_o_orderstatus IS NOT NULL GROUP BY ALL""")
def q_transitions(spark, root):
    """Status of a customer's previous order vs this one."""
    lagged = _lagged_orders(spark, root).where(F.col("prev_o_orderstatus").isNotNull())
    return audit.transitions(lagged, "prev_o_orderstatus", "o_orderstatus")


@register("copy_agreement", f"""WITH {_LAG_SQL}
SELECT compared, identical, round(identical / compared, 6) AS identical_rate, compared - identical AS differ FROM (
  SELECT count(*) FILTER (WHERE prev_o_orderpriority IS NOT NULL AND o_orderpriority IS NOT NULL) AS compared,
         count(*) FILTER (WHERE prev_o_orderpriority IS NOT NULL AND o_orderpriority IS NOT NULL
                           AND lower(trim(prev_o_orderpriority)) = lower(trim(o_orderpriority))) AS identical
  FROM lagged)""")
def q_copy_agreement(spark, root):
    """A32 between consecutive orders' priorities."""
    return audit.copy_agreement(_lagged_orders(spark, root), "prev_o_orderpriority", "o_orderpriority")


@register("varies_across_visits", """WITH u AS (
  SELECT o_custkey, 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders
  UNION ALL SELECT o_custkey, 'o_orderstatus', o_orderstatus FROM orders),
k AS (SELECT o_custkey, "column", count(*) AS visits,
             count(DISTINCT value) + max(CAST(value IS NULL AS INTEGER)) AS d FROM u GROUP BY ALL)
SELECT "column", count(*) AS repeat_keys, round(avg(CAST(d > 1 AS DOUBLE)), 6) AS varies_rate
FROM k WHERE visits > 1 GROUP BY 1""")
def q_varies(spark, root):
    """A33 over customers' orders."""
    o = table(spark, root, "orders")
    return audit.varies_across_visits(o, "o_custkey", ["o_orderpriority", "o_orderstatus"])


@register("repeat_entities", """SELECT o_custkey, count(*) AS visits FROM orders GROUP BY 1 HAVING count(*) >= 3""")
def q_repeat_entities(spark, root):
    """Customers with at least three orders."""
    return audit.repeat_entities(table(spark, root, "orders"), "o_custkey", 3)


@register("duplicate_starts", """SELECT o_custkey, o_orderdate, count(*) AS copies FROM orders
GROUP BY ALL HAVING count(*) > 1""")
def q_duplicates(spark, root):
    """The same customer starting twice at the same time."""
    return audit.duplicates(table(spark, root, "orders"), ["o_custkey", "o_orderdate"])


@register("overlapping_stays", f"""{W_STAYS}
SELECT key, seq, start_ts, end_ts, prev_end_ts FROM (
  SELECT *, lag(end_ts) OVER (PARTITION BY key ORDER BY start_ts, seq) AS prev_end_ts FROM stays)
WHERE start_ts < prev_end_ts""")
def q_overlapping(spark, root):
    """Stays that begin before the previous stay of the key ended."""
    s = MS.stays(spark, root).select("key", "seq", "start_ts", "end_ts")
    return audit.overlapping_stays(s, "key", "start_ts", "end_ts", "seq")


@register("non_monotonic_ends", f"""{W_STAYS}
SELECT key, seq, start_ts, end_ts, prev_end_ts FROM (
  SELECT *, lag(end_ts) OVER (PARTITION BY key ORDER BY start_ts, seq) AS prev_end_ts FROM stays)
WHERE end_ts < prev_end_ts""")
def q_non_monotonic(spark, root):
    """Ends that go backwards when starts are sorted (must be empty)."""
    s = MS.stays(spark, root).select("key", "seq", "start_ts", "end_ts")
    return audit.non_monotonic_ends(s, "key", "start_ts", "end_ts", "seq")


@register("duration_out_of_bounds", f"""{W_STAYS}
SELECT key, seq, duration_days FROM stays WHERE duration_days IS NULL OR duration_days < 0 OR duration_days > 365""")
def q_oob(spark, root):
    """Q1 (must be empty)."""
    return audit.duration_out_of_bounds(S.stays(spark, root)).select("key", "seq", "duration_days")


@register("end_reused", f"""{W_STAYS}
SELECT key, end_ts, count(*) AS copies FROM stays GROUP BY ALL HAVING count(*) > 1""")
def q_end_reused(spark, root):
    """Q3: no end settles two starts (must be empty)."""
    return audit.duplicates(S.stays(spark, root), ["key", "end_ts"])


@register("timeline", f"""WITH {S.STARTS_SQL}, {S.ENDS_SQL}
SELECT key, start_ts AS ts, 'START' AS event FROM starts UNION ALL SELECT key, end_ts, 'END' FROM ends""")
def q_timeline(spark, root):
    """Starts and ends of every key on one time line."""
    return audit.timeline(S.starts(spark, root), S.ends(spark, root), "key", "start_ts", "end_ts")


# ---------------------------------------------------------------------------
# Scalar functions over derived text
# ---------------------------------------------------------------------------

@register("parse_part_text", f"""WITH {D.PART_TEXT_SQL},
b AS (SELECT *, {_blank('breed_text')} AS bt, {_blank('color_text')} AS ct, lower({_blank('sex_text')}) AS st
      FROM part_text)
SELECT p_partkey, round({sql_age_days('age_text')}, 6) AS age_days,
  nullif({_strip(f"regexp_replace(split_part(bt, '/', 1), '(?i)' || '\\s*\\bmix\\b\\s*$', '')")}, '') AS primary_breed,
  CASE WHEN bt IS NOT NULL THEN contains(bt, '/') OR regexp_matches(bt, '(?i)\\bmix\\b') END AS is_mix,
  nullif({_strip("split_part(ct, '/', 1)")}, '') AS primary_color,
  CASE WHEN ct IS NOT NULL THEN lower({_strip("split_part(ct, '/', 1)")}) = 'black' END AS is_black,
  CASE WHEN contains(st, 'female') THEN 'Female' WHEN contains(st, 'male') THEN 'Male' ELSE 'Unknown' END AS sex,
  CASE WHEN contains(st, 'neutered') OR contains(st, 'spayed') THEN 'Fixed' WHEN contains(st, 'intact') THEN 'Intact'
       ELSE 'Unknown' END AS sterilization_status,
  coalesce(length({_strip('name_text')}) > 0, false) AS has_name,
  {sql_age_band(sql_age_days('age_text'))} AS age_band
FROM b""")
def q_parse_part_text(spark, root):
    """F2-F5, F7, F9 on text derived from ``part``."""
    t = D.part_text(spark, root)
    bp, mx = X.breed_parts("breed_text")
    cp, bl = X.color_parts("color_text")
    sx, stt = X.sex_parts("sex_text")
    age = X.age_days("age_text")
    return t.select("p_partkey", age.alias("age_days"), bp.alias("primary_breed"), mx.alias("is_mix"),
                    cp.alias("primary_color"), bl.alias("is_black"), sx.alias("sex"), stt.alias("sterilization_status"),
                    X.has_text("name_text").alias("has_name"), X.age_band(age).alias("age_band"))


@register("missingness", f"""WITH {D.PART_TEXT_SQL},
p AS (SELECT {sql_age_days('age_text')} AS age_days, {_blank('breed_text')} AS breed, sex_text FROM part_text),
c AS (SELECT count(*) AS n, count(*) FILTER (WHERE age_days IS NULL) AS age_days,
             count(*) FILTER (WHERE breed IS NULL) AS breed, count(*) FILTER (WHERE sex_text IS NULL) AS sex_text FROM p)
SELECT "column", nulls, round(nulls / n, 6) AS rate FROM (
  SELECT 'age_days' AS "column", age_days AS nulls, n FROM c UNION ALL SELECT 'breed', breed, n FROM c
  UNION ALL SELECT 'sex_text', sex_text, n FROM c) WHERE nulls > 0""")
def q_missingness(spark, root):
    """A4 on parsed part attributes."""
    t = D.part_text(spark, root)
    p = t.select(X.age_days("age_text").alias("age_days"), X.blank_to_null("breed_text").alias("breed"), "sex_text")
    return stats.missingness(p)


@register("wall_clock", f"""WITH {D.ORDER_TEXT_SQL}
SELECT o_orderkey, ts_text, {sql_wall_clock('ts_text')} AS parsed,
       coalesce(regexp_matches({_strip('ts_text')}, '{_TZ}'), false) AS has_offset FROM order_text""")
def q_wall_clock(spark, root):
    """F1 + A36 per row: offsets stripped, wall clock kept, bad text -> null."""
    t = D.order_text(spark, root)
    return t.select("o_orderkey", "ts_text", X.wall_clock("ts_text").alias("parsed"),
                    X.has_offset("ts_text").alias("has_offset"))


@register("source_profile", f"""WITH {D.ORDER_TEXT_SQL},
p AS (SELECT *, {sql_wall_clock('ts_text')} AS parsed FROM order_text)
SELECT count(*) AS rows, min(parsed) AS min_ts, max(parsed) AS max_ts, count(parsed) AS parseable,
       count(*) FILTER (WHERE coalesce(regexp_matches({_strip('ts_text')}, '{_TZ}'), false)) AS with_offset,
       4 AS columns FROM p""")
def q_source_profile(spark, root):
    """S3 + A36 on the orders' text timestamps."""
    t = D.order_text(spark, root)
    return stats.source_profile(t, "ts_text", X.wall_clock("ts_text"))


@register("calendar", f"""SELECT o_orderkey, month(o_orderdate) AS start_month, isodow(o_orderdate) - 1 AS start_day_of_week,
       {sql_season('month(o_orderdate)')} AS start_season FROM orders""")
def q_calendar(spark, root):
    """F6 + F8: month, Monday-based weekday, season."""
    o = table(spark, root, "orders")
    return o.select("o_orderkey", X.month_of("o_orderdate").alias("start_month"),
                    X.weekday_of("o_orderdate").alias("start_day_of_week"),
                    X.season(X.month_of("o_orderdate")).alias("start_season"))


@register("risk_bands", f"""{W_STAYS}
SELECT band, count(*) AS n FROM (
  SELECT CASE WHEN score >= 0.4 THEN 'High' WHEN score >= 0.1 THEN 'Elevated' WHEN score >= 0.02 THEN 'Standard'
              ELSE 'Fast' END AS band FROM stays) GROUP BY 1""")
def q_risk_bands(spark, root):
    """rows per risk band of the score."""
    return S.stays(spark, root).groupBy(X.risk_band("score").alias("band")).agg(F.count(F.lit(1)).alias("n"))


@register("verify_pairs", f"""{W_STAYS},
e AS (SELECT key, end_ts, lag(end_ts) OVER (PARTITION BY key ORDER BY end_ts) AS prev_end_ts FROM ends)
SELECT p.key, p.seq, p.start_ts, p.end_ts, e.prev_end_ts FROM paired p LEFT JOIN e USING (key, end_ts)
WHERE (e.prev_end_ts IS NOT NULL AND e.prev_end_ts >= p.start_ts) OR p.end_ts < p.start_ts""")
def q_verify_pairs(spark, root):
    """Q5 + Q2: every pair points at the first end at or after its start (must be empty)."""
    p = S.paired(spark, root).select("key", "seq", "start_ts", "end_ts")
    return audit.verify_pairs(p, S.ends(spark, root), "key", "start_ts", "end_ts")


@register("end_before_start", f"""{W_STAYS}
SELECT key, seq, start_ts, end_ts FROM stays WHERE end_ts < start_ts""")
def q_end_before_start(spark, root):
    """Q2 (must be empty)."""
    return audit.end_before_start(S.stays(spark, root), "start_ts", "end_ts").select("key", "seq", "start_ts", "end_ts")


@register("split_checks", f"""{W_STAYS},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays),
names AS (SELECT * FROM (VALUES ('train', 0), ('validation', 1), ('test', 2)) t(split, o)),
got AS (SELECT split, count(*) AS rows, min(start_ts) AS min_start, max(start_ts) AS max_start
        FROM lab WHERE split IS NOT NULL GROUP BY 1),
s AS (SELECT names.split, o, coalesce(rows, 0) AS rows, min_start, max_start FROM names LEFT JOIN got USING (split)),
l AS (SELECT *, lag(max_start) OVER (ORDER BY o) AS _prev_max FROM s)
SELECT split, rows, min_start, max_start, _prev_max FROM l WHERE rows = 0 OR min_start <= _prev_max""")
def q_split_checks(spark, root):
    """Q7: every period populated and strictly after the previous one (must be empty)."""
    return audit.split_violations(split.split_summary(S.stays(spark, root), "start_ts", *TRAIN))


@register("deciles_identical", f"""{W_STAYS},
r AS (SELECT seq, row_number() OVER (ORDER BY y_pred, seq) AS r1, row_number() OVER (ORDER BY y_pred * 1.1 + 2, seq) AS r2,
             count(*) OVER () AS nn FROM stays)
SELECT count(*) AS n, bool_and(({sql_bin('r1', 'nn')}) = ({sql_bin('r2', 'nn')})) AS decile_assignment_identical FROM r""")
def q_deciles_identical(spark, root):
    """A strictly monotone correction leaves every decile assignment unchanged."""
    s = MS.stays(spark, root).select("seq", "y_pred").withColumn("y_corr", F.col("y_pred") * 1.1 + 2)
    return M.deciles_identical(s, "y_pred", "y_corr", "seq")


@register("smearing_comparison", f"""{W_STAYS},
c AS (SELECT seq, duration_days AS y, y_pred AS b, least(365.0, greatest(0.0, y_pred * 1.6 - 20)) AS a FROM stays),
long AS (SELECT 'y_pred' AS v, y, b AS p FROM c UNION ALL SELECT 'y_corr', y, a FROM c),
core AS (SELECT v, avg(abs(p - y)) AS mae, avg(p - y) AS bias, 1 - sum((y - p) * (y - p)) / nullif(var_pop(y) * count(*), 0) AS r2 FROM long GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY b, seq) AS r1, row_number() OVER (ORDER BY a, seq) AS r2, count(*) OVER () AS nn,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra FROM c),
blocks AS (SELECT b, min(a) AS lo, max(a) AS hi FROM c GROUP BY b),
steps AS (SELECT lo, max(hi) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM blocks)
SELECT (SELECT round(mae, 6) FROM core WHERE v = 'y_pred') AS y_pred_mae, (SELECT round(bias, 6) FROM core WHERE v = 'y_pred') AS y_pred_bias,
       (SELECT round(r2, 6) FROM core WHERE v = 'y_pred') AS y_pred_r2, (SELECT round(mae, 6) FROM core WHERE v = 'y_corr') AS y_corr_mae,
       (SELECT round(bias, 6) FROM core WHERE v = 'y_corr') AS y_corr_bias, (SELECT round(r2, 6) FROM core WHERE v = 'y_corr') AS y_corr_r2,
       (SELECT bool_and(before IS NULL OR lo - before >= -1e-9 * 365) FROM steps) AS no_inversions,
       (SELECT round(corr(rb, ra), 6) FROM r) AS spearman_correlation,
       (SELECT bool_and(({sql_bin('r1', 'nn')}) = ({sql_bin('r2', 'nn')})) FROM r) AS decile_assignment_identical,
       count(*) FILTER (WHERE b >= 365) AS clipped_at_ceiling_before, count(*) FILTER (WHERE a >= 365) AS clipped_at_ceiling_after,
       count(*) FILTER (WHERE b <= 0) AS clipped_at_floor_before, count(*) FILTER (WHERE a <= 0) AS clipped_at_floor_after,
       count(*) FILTER (WHERE a >= 365) - count(*) FILTER (WHERE b >= 365) + count(*) FILTER (WHERE a <= 0) - count(*) FILTER (WHERE b <= 0) AS ties_introduced_by_clipping
FROM c""")
def q_smearing_comparison(spark, root):
    """A30 on fixed columns: a correction that spreads predictions and clips some of them at the floor."""
    s = MS.stays(spark, root, "seq", "duration_days", "y_pred")
    s = s.withColumn("y_corr", X.clip_days(F.col("y_pred") * 1.6 - 20))
    return M.smearing_comparison(s, "duration_days", "y_pred", "y_corr", "seq")


@register("sample_orders", """SELECT * REPLACE (round(o_totalprice, 6) AS o_totalprice) FROM orders
ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|42'), o_orderkey LIMIT 20""")
def q_sample_orders(spark, root):
    """T5: a repeatable seeded sample of 20 orders for inspection (the cap is the feature)."""
    return stats.sample_rows(table(spark, root, "orders"), 20, 42, ["o_orderkey"])


@register("findings", f"""{W_STAYS_C},
{_EFFECT_SQL},
ls AS (SELECT avg(CAST(duration_days <= 7 AS DOUBLE)) AS qa, sum(CASE WHEN duration_days <= 7 THEN duration_days ELSE 0 END) / sum(duration_days) AS qd,
              avg(CAST(is_long AS DOUBLE)) AS la, sum(CASE WHEN is_long = 1 THEN duration_days ELSE 0 END) / sum(duration_days) AS ld,
              coalesce(avg(duration_days) FILTER (WHERE is_long = 1), 0.0) AS lm,
              avg(CAST(coalesce(flag_f, false) AS DOUBLE)) FILTER (WHERE is_long = 1) AS fl,
              avg(CAST(coalesce(flag_f, false) AS DOUBLE)) FILTER (WHERE is_long = 0) AS fr,
              avg(abs(y_pred - duration_days)) AS mae, avg(duration_days) AS mean FROM stays),
r AS (SELECT 1 - sum((duration_days - y_pred) ** 2) / sum((duration_days - mean) ** 2) AS r2 FROM stays, ls),
t AS (SELECT score, sum(is_long) AS tp_at, sum(1 - is_long) AS fp_at FROM stays GROUP BY 1),
c AS (SELECT tp_at, sum(tp_at) OVER w AS tp, sum(fp_at) OVER w AS fp FROM t WINDOW w AS (ORDER BY score DESC)),
ap AS (SELECT sum(tp_at * tp / (tp + fp)) / sum(tp_at) AS ap FROM c),
every AS (SELECT 'priority' AS finding, o_orderpriority AS level, duration_days, is_long FROM stays_c
          UNION ALL SELECT 'segment', c_mktsegment, duration_days, is_long FROM stays_c
          UNION ALL SELECT 'month', CAST(start_month AS VARCHAR), duration_days, is_long FROM stays_c),
lv AS (SELECT finding, level, count(*) AS n, quantile_cont(duration_days, 0.5) AS m, avg(CAST(is_long AS DOUBLE)) AS rate
       FROM every WHERE level IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
one AS (SELECT * FROM ls, r, ap, agg),
rows AS (
  SELECT finding, CAST(NULL AS VARCHAR) AS level, unnest(stats).s AS stat, unnest(stats).v AS value FROM (
    SELECT 'load_share' AS finding, [{{'s': 'quick_exit_share_of_entities', 'v': qa}}, {{'s': 'quick_exit_share_of_entity_days', 'v': qd}},
      {{'s': 'long_stay_share_of_entities', 'v': la}}, {{'s': 'long_stay_share_of_entity_days', 'v': ld}}, {{'s': 'long_stay_mean_days', 'v': lm}}] AS stats FROM one
    UNION ALL SELECT 'flag_effect', [{{'s': 'raw_difference_pp', 'v': (rf - ru) * 100}}, {{'s': 'controlled_difference_pp', 'v': est * 100}},
      {{'s': 'ci95_low_pp', 'v': (est - 1.96 * se) * 100}}, {{'s': 'ci95_high_pp', 'v': (est + 1.96 * se) * 100}}] FROM one
    UNION ALL SELECT 'flag_timing', [{{'s': 'flag_rate_among_long', 'v': fl}}, {{'s': 'flag_rate_among_rest', 'v': fr}}] FROM one
    UNION ALL SELECT 'duration', [{{'s': 'mae_days', 'v': mae}}, {{'s': 'r2', 'v': r2}}] FROM one
    UNION ALL SELECT 'risk', [{{'s': 'pr_auc', 'v': ap}}, {{'s': 'pr_auc_lift', 'v': ap / la}}] FROM one)
  UNION ALL SELECT finding, level, unnest(['n', 'median_days', 'long_stay_rate']), unnest([CAST(n AS DOUBLE), m, rate]) FROM lv)
SELECT finding, level, stat, round(value, 6) AS value FROM rows""")
def q_findings(spark, root):
    """The numbers of all seven findings, with every level of the three breakdowns."""
    from ..models.report import findings
    return findings(D.stays_with_customer(spark, root), "flag_f", {"priority": "o_orderpriority", "segment": "c_mktsegment", "month": "start_month"},
                    ["o_orderpriority", "start_month"])


@register("operating_point_by_group", f"""{W_STAYS},
g AS (SELECT o_orderpriority AS "group", count(*) AS n, count(*) FILTER (WHERE is_long = 1) AS positives,
             count(*) FILTER (WHERE score >= 0.3) AS flagged, count(*) FILTER (WHERE score >= 0.3 AND is_long = 1) AS true_positive FROM stays GROUP BY 1),
p AS (SELECT *, 0.3::DOUBLE AS threshold, CASE WHEN flagged > 0 THEN true_positive / flagged ELSE 0.0 END AS precision,
             CASE WHEN positives > 0 THEN true_positive / positives ELSE 0.0 END AS recall, flagged / n AS flagged_rate
      FROM g WHERE n >= 50 AND positives >= 5)
SELECT "group", n, positives, flagged, true_positive, {R('threshold', 'precision', 'recall', 'flagged_rate')},
       round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1 FROM p""")
def q_operating_point_by_group(spark, root):
    """The second half, A25 per order priority."""
    return M.operating_point_by_group(S.stays(spark, root), "o_orderpriority", "score", "is_long", 0.3)


_REL_GROUP_SQL = f"""lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays),
gt AS (SELECT o_orderpriority, score, sum(is_long) AS tp_at, sum(1 - is_long) AS fp_at FROM lab WHERE split = 'validation' GROUP BY ALL),
gc AS (SELECT *, sum(tp_at) OVER w AS tp, sum(fp_at) OVER w AS fp FROM gt WINDOW w AS (PARTITION BY o_orderpriority ORDER BY score DESC)),
gr AS (SELECT o_orderpriority, sum(tp_at * tp / (tp + fp)) / sum(tp_at) AS pr_auc, sum(tp_at) / (sum(tp_at) + sum(fp_at)) AS base_rate
       FROM gc GROUP BY 1 HAVING sum(tp_at) >= 5 AND sum(tp_at) + sum(fp_at) >= 50),
rel AS (SELECT *, pr_auc / base_rate AS lift, pr_auc / base_rate >= 2.0 AS reliable FROM gr)"""


@register("scored_orders", f"""{W_STAYS},
{_REL_GROUP_SQL}
SELECT seq, score, row_number() OVER (ORDER BY score DESC, seq) AS risk_rank, o_orderpriority, reliable, round(lift, 6) AS lift,
  CASE WHEN score >= 0.4 THEN 'High' WHEN score >= 0.1 THEN 'Elevated' WHEN score >= 0.02 THEN 'Standard' ELSE 'Fast' END AS risk_band,
  CASE WHEN reliable IS NULL THEN printf('No reliability figures for %s: the score is unverified.', coalesce(o_orderpriority, 'unknown'))
       WHEN reliable THEN printf('Ranking for %s is reliable: %.1f times better than chance (PR-AUC %.3f, base rate %.1f%%).', o_orderpriority, lift, pr_auc, base_rate * 100)
       ELSE printf('Ranking for %s is weak: PR-AUC %.3f at a base rate of %.1f%%, %.2f times chance and below the %.1f held usable; treat the score as a guess.',
                   o_orderpriority, pr_auc, base_rate * 100, lift, 2.0::DOUBLE) END AS reliability_note
FROM lab LEFT JOIN rel USING (o_orderpriority) WHERE split = 'test'""", exact=("score",))
def q_scored_orders(spark, root):
    """R1, T2, J8, F15 on the fixed score in place of a fitted model: band, risk rank, and the group's
    reliability as measured on validation."""
    lab = split.temporal_split(MS.stays(spark, root), "start_ts", *TRAIN)
    rel = M.group_reliability(M.classifier_by_group(lab.where(F.col("split") == "validation"), "o_orderpriority", "score", "is_long"))
    test = lookup.attach_reliability(lab.where(F.col("split") == "test").select("seq", "score", "o_orderpriority"), "o_orderpriority", rel)
    note = X.reliability_message("o_orderpriority", "reliable", "lift", "pr_auc", "base_rate", "min_lift")
    ranked = ranking.global_row_number(test.withColumns({"risk_band": X.risk_band("score"), "reliability_note": note}),
                                       [F.col("score").desc(), F.col("seq")], "risk_rank")
    return ranked.select("seq", "score", "risk_rank", "o_orderpriority", "reliable", "lift", "risk_band", "reliability_note")


@register("counterfactual_effects", f"""{W_STAYS},
base AS (SELECT seq, o_totalprice AS p, flag_f AS f FROM stays),
ref AS (SELECT quantile_cont(o_totalprice, 0.5) AS rp, mode(flag_f) AS rf FROM stays),
cf AS (SELECT seq, 'o_totalprice' AS feature, p / 600000.0 + CASE WHEN f THEN 0.1 ELSE 0.0 END AS now, rp / 600000.0 + CASE WHEN f THEN 0.1 ELSE 0.0 END AS typical FROM base, ref
       UNION ALL SELECT seq, 'flag_f', p / 600000.0 + CASE WHEN f THEN 0.1 ELSE 0.0 END, p / 600000.0 + CASE WHEN rf THEN 0.1 ELSE 0.0 END FROM base, ref)
SELECT seq, feature, round((now - typical) * 100, 6) AS effect_pp FROM cf""")
def q_counterfactual_effects(spark, root):
    """J7 + A10 on a fixed score: what each feature adds against the typical order."""
    st = MS.stays(spark, root).select("seq", "o_totalprice", "flag_f")
    from ..models.features import FeatureSpec
    from ..models.train import fit_reference_row
    reference = fit_reference_row(st, FeatureSpec(numeric=["o_totalprice"], categorical=[], boolean=["flag_f"], forbidden=[]))
    score = F.col("o_totalprice") / F.lit(S.SCORE_DIVISOR) + F.when(F.col("flag_f"), F.lit(0.1)).otherwise(F.lit(0.0))
    changed = lookup.counterfactual_expand(st, ["o_totalprice", "flag_f"], reference, "seq").select("seq", "feature", score.alias("typical"))
    return changed.join(st.select("seq", score.alias("now")), "seq").select("seq", "feature", ((F.col("now") - F.col("typical")) * 100).alias("effect_pp"))


def fixed_score(c: dict) -> Column:
    """A score that needs no fitted model: of the price and the flag."""
    return c["o_totalprice"] / F.lit(S.SCORE_DIVISOR) + F.when(c["flag_f"], F.lit(0.1)).otherwise(F.lit(0.0))


@register("fixed_score_drivers", f"""{W_STAYS},
base AS (SELECT seq, o_totalprice AS p, flag_f AS f FROM stays),
ref AS (SELECT quantile_cont(o_totalprice, 0.5) AS rp, mode(flag_f) AS rf FROM stays),
cf AS (SELECT seq, 'o_totalprice' AS feature, p / 600000.0 + CASE WHEN f THEN 0.1 ELSE 0.0 END AS now, rp / 600000.0 + CASE WHEN f THEN 0.1 ELSE 0.0 END AS typical FROM base, ref
       UNION ALL SELECT seq, 'flag_f', p / 600000.0 + CASE WHEN f THEN 0.1 ELSE 0.0 END, p / 600000.0 + CASE WHEN rf THEN 0.1 ELSE 0.0 END FROM base, ref),
e AS (SELECT seq, feature, round((now - typical) * 100, 6) AS effect_pp FROM cf)
SELECT seq, feature, effect_pp, CAST(row_number() OVER (PARTITION BY seq ORDER BY abs(effect_pp) DESC, feature) - 1 AS INTEGER) AS place FROM e WHERE abs(effect_pp) >= 0.05""")
def q_fixed_score_drivers(spark, root):
    """M11 + T4 on a fixed score: per row, the features ordered by what they add against the typical order."""
    from ..models import explain
    from ..models.features import FeatureSpec
    from ..models.train import fit_reference_row
    st = MS.stays(spark, root).select("seq", "o_totalprice", "flag_f")
    reference = fit_reference_row(st, FeatureSpec(numeric=["o_totalprice"], categorical=[], boolean=["flag_f"]))
    out = explain.drivers(st, fixed_score, ["o_totalprice", "flag_f"], reference, digits=6)
    return out.select("seq", F.posexplode("drivers").alias("place", "d")).select("seq", "place", "d.feature", "d.effect_pp")


@register("fixed_score_importance", f"""{W_STAYS},
base AS (SELECT row_number() OVER (ORDER BY md5(CAST(seq AS VARCHAR)), seq) - 1 AS r, count(*) OVER () AS n, o_totalprice AS p, flag_f AS f, duration_days AS y FROM stays),
reps AS (SELECT k, n, greatest(1, CAST(((k + 1) * 618033988749 % 1000000000000) * n // 1000000000000 AS BIGINT)) AS a0, (k + 1) * 7919 % n AS b
         FROM (SELECT unnest(range(3)) AS k) x, (SELECT DISTINCT n FROM base) y),
maps AS (SELECT k, n, b, a0 + (SELECT min(i) FROM range(1000) t(i) WHERE gcd(a0 + i, n) = 1) AS a FROM reps),
j AS (SELECT m.k, t.y, t.p AS tp, t.f AS tf, d.p AS dp, d.f AS df FROM base t, maps m JOIN base d ON d.r = (m.a * t.r + m.b) % m.n),
s AS (SELECT k, avg(abs(100 * (tp / 600000.0 + CASE WHEN tf THEN 0.1 ELSE 0.0 END) - y)) AS base_mae,
             avg(abs(100 * (dp / 600000.0 + CASE WHEN tf THEN 0.1 ELSE 0.0 END) - y)) AS price_mae,
             avg(abs(100 * (tp / 600000.0 + CASE WHEN df THEN 0.1 ELSE 0.0 END) - y)) AS flag_mae FROM j GROUP BY k),
u AS (SELECT 'o_totalprice' AS feature, price_mae - base_mae AS imp FROM s UNION ALL SELECT 'flag_f', flag_mae - base_mae FROM s)
SELECT feature, round(avg(imp), 6) AS importance_mean, round(stddev_pop(imp), 6) AS importance_std, count(*) AS repeats FROM u GROUP BY 1""")
def q_fixed_score_importance(spark, root):
    """M10 on a fixed score in days: rise of the mean absolute error over three seeded permutations."""
    from ..models import explain
    st = MS.stays(spark, root).select("seq", "o_totalprice", "flag_f", "duration_days")
    return explain.permutation_importance(st, fixed_score, ["o_totalprice", "flag_f"], "seq", "duration_days", repeats=3, answer=lambda x: x * 100)


@register("split_union", f"""{W_STAYS}
SELECT CAST(year(start_ts) AS INTEGER) AS start_year, count(*) AS rows FROM stays GROUP BY 1""")
def q_split_union(spark, root):
    """The three periods put together again hold every row once."""
    parts = split.periods(S.stays(spark, root).select("start_ts"), "start_ts", *TRAIN)
    return split.union_splits(*parts).groupBy(F.year("start_ts").alias("start_year")).agg(F.count(F.lit(1)).alias("rows"))


@register("numeric_text", """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN CAST(o_custkey AS DOUBLE) WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 END AS number FROM orders""")
def q_numeric_text(spark, root):
    """numbers with blanks around them, booleans as text, words and nulls."""
    k = F.col("o_orderkey") % 5
    text = (F.when(k == 0, F.concat(F.lit(" "), F.col("o_custkey").cast("string"), F.lit("\t"))).when(k == 1, F.lit("True"))
            .when(k == 2, F.lit(" FALSE ")).when(k == 3, F.lit("n/a")))
    return table(spark, root, "orders").select("o_orderkey", X.to_number(text).alias("number"))


# Violations that exist: the checks above are empty on sound data, these run them on rows made unsound.

@register("over_30_days", f"""{W_STAYS}
SELECT key, seq, round(duration_days, 6) AS duration_days FROM stays WHERE duration_days > 30""")
def q_over_30_days(spark, root):
    """Q1 with an upper bound of 30 days."""
    return audit.duration_out_of_bounds(S.stays(spark, root), hi=30.0).select("key", "seq", "duration_days")


@register("late_start_violations", f"""{W_STAYS}
SELECT key, seq, start_ts + to_days(CAST(seq % 40 AS INTEGER)) AS start_ts, end_ts FROM stays WHERE end_ts < start_ts + to_days(CAST(seq % 40 AS INTEGER))""")
def q_late_start_violations(spark, root):
    """Q2 on starts moved up to 39 days later."""
    moved = S.stays(spark, root).withColumn("start_ts", F.col("start_ts") + F.make_dt_interval((F.col("seq") % 40).cast("int")))
    return audit.end_before_start(moved, "start_ts", "end_ts").select("key", "seq", "start_ts", "end_ts")


@register("doubled_end_violations", f"""{W_STAYS}
SELECT key, end_ts, count(*) AS copies FROM (SELECT key, end_ts FROM stays UNION ALL SELECT key, end_ts FROM stays WHERE seq % 7 = 0)
GROUP BY ALL HAVING count(*) > 1""")
def q_doubled_end_violations(spark, root):
    """Q3 / U3 with every stay of an order key divisible by 7 entered twice."""
    st = S.stays(spark, root).select("key", "end_ts", "seq")
    return audit.duplicates(st.unionByName(st.where(F.col("seq") % 7 == 0)), ["key", "end_ts"])


@register("early_start_violations", f"""{W_STAYS},
e AS (SELECT key, end_ts, lag(end_ts) OVER (PARTITION BY key ORDER BY end_ts) AS prev_end_ts FROM ends)
SELECT p.key, p.seq, p.start_ts - to_days(60) AS start_ts, p.end_ts, e.prev_end_ts FROM paired p LEFT JOIN e USING (key, end_ts)
WHERE e.prev_end_ts >= p.start_ts - to_days(60)""")
def q_early_start_violations(spark, root):
    """Q5 on starts moved 60 days earlier, where another end may come first."""
    p = S.paired(spark, root).select("key", "seq", "start_ts", "end_ts")
    p = p.withColumn("start_ts", F.col("start_ts") - F.make_dt_interval(F.lit(60)))
    return audit.verify_pairs(p, S.ends(spark, root), "key", "start_ts", "end_ts")


@register("moved_end_violations", f"""{W_STAYS},
m AS (SELECT key, seq, start_ts, end_ts + to_days(CAST(seq % 300 AS INTEGER)) AS end_ts FROM stays),
l AS (SELECT *, lag(end_ts) OVER (PARTITION BY key ORDER BY start_ts, seq) AS prev_end_ts FROM m)
SELECT key, seq, start_ts, end_ts, prev_end_ts FROM l WHERE end_ts < prev_end_ts""")
def q_moved_end_violations(spark, root):
    """Q4 / W7 on ends moved up to 299 days later."""
    moved = S.stays(spark, root).select("key", "seq", "start_ts", (F.col("end_ts") + F.make_dt_interval((F.col("seq") % 300).cast("int"))).alias("end_ts"))
    return audit.non_monotonic_ends(moved, "key", "start_ts", "end_ts", "seq").select("key", "seq", "start_ts", "end_ts", "prev_end_ts")


@register("split_gap_violations", f"""{W_STAYS}
SELECT key, seq, start_ts FROM stays WHERE start_ts >= TIMESTAMP '2000-01-01' AND start_ts < TIMESTAMP '2000-07-01'""")
def q_split_gap_violations(spark, root):
    """Q7: rows in no period when the validation period starts half a year late."""
    lab = split.temporal_split(S.stays(spark, root), "start_ts", S.TRAIN_END, "2000-07-01", S.VAL_END, S.TEST_START)
    return audit.in_no_period(lab).select("key", "seq", "start_ts")


def _scratch(spark, name: str) -> str:
    """A fresh folder under the session's shared checkpoint directory."""
    import uuid
    from ..session import ensure_checkpoint_dir
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/dwell-tables/{name}-{uuid.uuid4().hex}"


@register("stays_table_test_period", f"""{W_STAYS}
SELECT key, seq, start_ts, end_ts, round(duration_days, 6) AS duration_days, CAST(year(start_ts) AS INTEGER) AS start_year
FROM stays WHERE start_ts >= TIMESTAMP '2001-01-01'""")
def q_stays_table(spark, root):
    """S4 + P9: the stays table written as Parquet partitioned by start year and
    read back; the test-period filter prunes partitions."""
    from ..sources import files
    path = _scratch(spark, "stays")
    files.write_stays(S.stays(spark, root).select("key", "seq", "start_ts", "end_ts", "duration_days"), path)
    return files.read_stays(spark, path, since="2001-01-01").withColumn("start_year", F.col("start_year").cast("int"))


@register("raw_text_starts", f"""WITH {D.ORDER_TEXT_SQL},
t AS (SELECT nullif(trim(CAST(o_custkey AS VARCHAR)), '') AS key, {sql_wall_clock('ts_text')} AS start_ts,
             CAST(o_orderkey AS VARCHAR) AS seq FROM order_text)
SELECT * FROM t WHERE key IS NOT NULL AND start_ts IS NOT NULL""")
def q_raw_text_starts(spark, root):
    """S1 + P1 + F1: orders landed as an all-text CSV, read back without type
    inference, keys trimmed, text timestamps parsed to wall clock, unusable rows dropped."""
    from ..sources import files
    path = _scratch(spark, "raw")
    D.order_text(spark, root).select(F.col("o_custkey").cast("string").alias("entity_id"), "ts_text",
                                     F.col("o_orderkey").cast("string").alias("seq")).write.option(
        "header", True).csv(path)
    # asked for in another order than the file has, and with a column that it lacks
    raw = files.read_raw_csv(spark, path, ["seq", "name", "ts_text", "entity_id"])
    return pairing.prepare_starts(raw, "entity_id", "ts_text", "start_ts", keep=["seq"], key_out="key")


@register("pair_payload", f"""{W_STAYS},
e AS (SELECT o.o_custkey AS key, l.l_shipdate AS end_ts, l.l_orderkey * 100 + l.l_linenumber AS end_seq,
             l.l_returnflag, l.l_linestatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey),
first_e AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY key, end_ts ORDER BY end_seq) = 1)
SELECT p.key, p.seq, p.start_ts, p.end_ts, f.l_returnflag, f.l_linestatus
FROM paired p JOIN first_e f USING (key, end_ts)""")
def q_pair_payload(spark, root):
    """Pairing that carries the end row's descriptive columns; among ends at
    the same time the first in source order wins."""
    o = table(spark, root, "orders").select("o_orderkey", "o_custkey")
    li = table(spark, root, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag",
                                               "l_linestatus")
    ends = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("key"), F.col("l_shipdate").alias("end_ts"),
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("end_seq"), "l_returnflag", "l_linestatus")
    p = pairing.pair_next_with_payload(S.starts(spark, root), ends, "key", "start_ts", "end_ts",
                                       ["l_returnflag", "l_linestatus"], seq="seq", end_seq="end_seq")
    return p.select("key", "seq", "start_ts", "end_ts", "l_returnflag", "l_linestatus")


@register("folded_levels", f"""{W_STAYS_C},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays_c),
top AS (SELECT c_mktsegment FROM lab WHERE split = 'train' AND c_mktsegment IS NOT NULL
        GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 3)
SELECT seq, CASE WHEN c_mktsegment IS NULL THEN 'Missing'
                 WHEN c_mktsegment IN (SELECT c_mktsegment FROM top) THEN c_mktsegment ELSE 'Other' END AS segment_level
FROM lab WHERE split = 'test'""")
def q_folded_levels(spark, root):
    """M1 + J6: the three most frequent training segments kept, the rest folded
    to Other, null to Missing; applied to the test period."""
    from ..models.features import fit_levels
    lab = split.temporal_split(MD.stays_with_customer(spark, root), "start_ts", *TRAIN)
    lv = fit_levels(lab.where(F.col("split") == "train"), ["c_mktsegment"], cap=3)
    out = lv.transform(lab.where(F.col("split") == "test"))
    return out.select("seq", F.col("c_mktsegment__lv").alias("segment_level"))


@register("reference_row", f"""{W_STAYS_C},
m AS (SELECT o_orderpriority AS v, count(*) AS c FROM stays_c WHERE o_orderpriority IS NOT NULL GROUP BY 1),
s AS (SELECT c_mktsegment AS v, count(*) AS c FROM stays_c WHERE c_mktsegment IS NOT NULL GROUP BY 1)
SELECT (SELECT v FROM m ORDER BY c DESC, v LIMIT 1) AS o_orderpriority,
       (SELECT v FROM s ORDER BY c DESC, v LIMIT 1) AS c_mktsegment,
       round((SELECT quantile_cont(o_totalprice, 0.5) FROM stays_c), 6) AS o_totalprice,
       round((SELECT avg(CAST(is_long AS DOUBLE)) FROM stays_c), 6) AS positive_rate""")
def q_reference_row(spark, root):
    """A10 + A9: the typical entity (median numeric, most frequent level with the
    smallest value on ties) and the positive rate."""
    st = MD.stays_with_customer(spark, root)
    modes = st.agg(F.avg(F.col("is_long").cast("double")).alias("positive_rate"))
    for level in ("o_orderpriority", "c_mktsegment"):  # counted per level first, no value map in one task
        counts = st.where(F.col(level).isNotNull()).groupBy(level).count().withColumn("least", F.col("count"))
        top = counts.agg(F.max("count").alias("top"))
        modes = B._one_row(modes, B._one_row(counts, top).where("count = top").agg(F.min(level).alias(level)))
    med = ranking.group_quantiles(st, "o_totalprice", [0.5], ["o_totalprice"])
    return B._one_row(modes, med)


@register("display_values", r"""SELECT o_orderkey,
  CASE WHEN p IS NULL THEN 'unknown' ELSE printf('%g', p) END AS price_text,
  CASE WHEN f IS NULL THEN 'unknown' WHEN f THEN 'yes' ELSE 'no' END AS flag_text,
  CASE WHEN pr IS NULL THEN 'unknown' ELSE pr END AS priority_text
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS p,
             CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderstatus = 'F' END AS f,
             nullif(o_orderpriority, '5-LOW') AS pr FROM orders)""")
def q_display_values(spark, root):
    """values rendered for people (null -> unknown, yes/no, shortest decimals)."""
    o = table(spark, root, "orders").select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")).alias("p"),
        F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus") == "F").alias("f"),
        F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).alias("pr"))
    return o.select("o_orderkey", X.display("p", "double").alias("price_text"),
                    X.display("f", "boolean").alias("flag_text"), X.display("pr").alias("priority_text"))


def _split_stays(spark, root, *columns: str) -> DataFrame:
    """The stays of every period with their customers' columns (only ``columns``), written by period: a block
    reads its period and its columns alone."""
    lab = split.temporal_split(D.stays_with_customer(spark, root), "start_ts", *TRAIN)
    return written(lab.select(*columns, "split") if columns else lab, "split")


def _report(spark, root, only: tuple[str, ...] = ()) -> tuple[str, list[str]]:
    """The evaluation report written as one JSON folder per block (``only`` these); its path and the blocks' names."""
    from ..models.report import build_report, classifier_report
    from ..sources.files import write_report_json
    lab = _split_stays(spark, root)
    lab = lab.withColumns({"y_low": F.col("y_pred") * 0.5, "y_high": F.col("y_pred") * 2, "y_corr": X.clip_days(F.col("y_pred") * 1.6 - 20)})
    parts = {p: lab.where(F.col("split") == p) for p in ("train", "validation", "test")}
    blocks = build_report(parts["test"], "duration_days", "y_pred", "seq", ["o_orderpriority", "c_mktsegment"], "flag_f", ["o_orderpriority", "start_month"],
                          parts["train"], ["c_mktsegment", "start_month"], ("y_low", "y_pred", "y_high"), "y_corr")
    blocks.update(classifier_report(parts["validation"], parts["test"], "score", "is_long", "seq", group="o_orderpriority", train=parts["train"]))
    blocks["split"] = split.split_summary(lab, "start_ts", *TRAIN)
    path = _scratch(spark, "report")
    blocks = {name: df for name, df in blocks.items() if not only or name in only}
    write_report_json(blocks, path)
    return path, sorted(blocks)


@register("report_blocks")
def q_report_blocks(spark, root):
    """M14 + M15 + S6: the evaluation report as JSON, a folder a block; returns (block, rows)."""
    path, blocks = _report(spark, root)
    return spark.createDataFrame([(name, spark.read.json(f"{path}/{name}").count()) for name in blocks], "block string, rows long")


@register("report_operating_points", f"""{W_STAYS},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays),
v AS (SELECT score AS threshold, sum(is_long) AS tp_at, sum(1 - is_long) AS fp_at FROM lab WHERE split = 'validation' GROUP BY 1),
curve AS (SELECT threshold, sum(tp_at) OVER (ORDER BY threshold DESC) AS tp, sum(fp_at) OVER (ORDER BY threshold DESC) AS fp, sum(tp_at) OVER () AS positives FROM v),
t AS (SELECT 'operating' AS point, 0.1::DOUBLE AS t UNION ALL SELECT 'at_recall', (SELECT max(threshold) FROM curve WHERE tp / positives >= 0.5)
      UNION ALL SELECT 'at_precision', (SELECT min(threshold) FROM curve WHERE tp / (tp + fp) >= 0.97)),
c AS (SELECT point, t, count(*) AS nn, count(*) FILTER (WHERE score >= t AND is_long = 1) AS tp, count(*) FILTER (WHERE score >= t AND is_long = 0) AS fp,
             count(*) FILTER (WHERE score < t AND is_long = 1) AS fn, count(*) FILTER (WHERE score < t AND is_long = 0) AS tn
      FROM t, lab WHERE split = 'test' GROUP BY point, t),
p AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM c)
SELECT point, t IS NOT NULL AS attainable, round(t, 6) AS threshold, CASE WHEN t IS NOT NULL THEN round(precision, 6) END AS precision,
       CASE WHEN t IS NOT NULL THEN round(recall, 6) END AS recall,
       CASE WHEN t IS NOT NULL THEN round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) END AS f1,
       CASE WHEN t IS NOT NULL THEN tp + fp END AS flagged, CASE WHEN t IS NOT NULL THEN round((tp + fp) / nn, 6) END AS flagged_rate,
       CASE WHEN t IS NOT NULL THEN tn END AS true_negative, CASE WHEN t IS NOT NULL THEN fp END AS false_positive,
       CASE WHEN t IS NOT NULL THEN fn END AS false_negative, CASE WHEN t IS NOT NULL THEN tp END AS true_positive FROM p""")
def q_report_operating_points(spark, root):
    """The operating points of a fixed score, chosen on validation, unattainable ones included."""
    from ..models.report import operating_report
    lab = split.temporal_split(MS.stays(spark, root), "start_ts", *TRAIN).select("split", "score", "is_long")
    return operating_report(lab.where("split = 'validation'"), lab.where("split = 'test'"), "score", "is_long", precision=0.97)


@register("report_baselines", f"""{W_STAYS_C},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays_c),
cells AS (SELECT c_mktsegment, start_month, quantile_cont(duration_days, 0.5) AS m FROM lab WHERE split = 'train' AND start_month <> 3 GROUP BY 1, 2),
g AS (SELECT quantile_cont(duration_days, 0.5) AS m FROM lab WHERE split = 'train' AND start_month <> 3),
x AS (SELECT l.seq, l.duration_days AS y, l.y_pred, coalesce(c.m, g.m) AS cell, g.m AS overall, c.m IS NULL AS unseen
      FROM lab l CROSS JOIN g LEFT JOIN cells c ON l.c_mktsegment = c.c_mktsegment AND l.start_month = c.start_month WHERE l.split = 'test'),
u AS (SELECT 'y_pred' AS variant, y, y_pred AS p FROM x UNION ALL SELECT 'cell_median_days', y, cell FROM x UNION ALL SELECT 'global_median_days', y, overall FROM x)
SELECT variant, count(*) AS n, round(avg(abs(p - y)), 6) AS mae_days, round(avg(p - y), 6) AS mean_bias_days, round(avg(p), 6) AS mean_predicted_days,
       (SELECT round(avg(CAST(unseen AS DOUBLE)), 6) FROM x) AS unseen_cell_rate FROM u GROUP BY 1""")
def q_report_baselines(spark, root):
    """M15 + M3: a prediction against both medians; March is left out of training, so its cells are unseen."""
    from ..models.report import baselines_report
    lab = _split_stays(spark, root, "seq", "duration_days", "y_pred", "c_mktsegment", "start_month")
    out = baselines_report(lab.where("split = 'train' AND start_month <> 3"), lab.where("split = 'test'"), "duration_days", "y_pred", "seq", ["c_mktsegment", "start_month"])
    return out.select("variant", "n", "mae_days", "mean_bias_days", "mean_predicted_days", "unseen_cell_rate")


@register("report_read_back", f"""{W_STAYS},
lab AS (SELECT *, {sql_split('start_ts')} AS split FROM stays), t AS (SELECT * FROM lab WHERE split = 'test')
SELECT 'interval' AS block, 'empirical_coverage' AS stat, round(avg(CAST(duration_days BETWEEN y_pred * 0.5 AND y_pred * 2 AS DOUBLE)), 6) AS value FROM t
UNION ALL SELECT 'core', 'mae_days', round(avg(abs(y_pred - duration_days)), 6) FROM t
UNION ALL SELECT 'baseline', 'brier_score', round(avg(power(r - is_long, 2)), 6) FROM t, (SELECT avg(is_long) AS r FROM lab WHERE split = 'train')
UNION ALL SELECT 'calibration', 'brier_raw', round(avg(power(score - is_long, 2)), 6) FROM t
UNION ALL SELECT 'failures', 'under', CAST(count(*) FILTER (WHERE y_pred < duration_days) AS DOUBLE) FROM (SELECT * FROM t ORDER BY abs(y_pred - duration_days) DESC, seq LIMIT 50)
UNION ALL SELECT 'load_share', 'n_entities', CAST(count(*) AS DOUBLE) FROM t""")
def q_report_read_back(spark, root):
    """A figure of each of six blocks, read back from the JSON that the report was written to."""
    stats_of = {"interval": "empirical_coverage", "core": "mae_days", "baseline": "brier_score", "calibration": "brier_raw", "failures": "under", "load_share": "n_entities"}
    path, _ = _report(spark, root, tuple(stats_of))
    out = None
    for block, stat in stats_of.items():
        one = spark.read.json(f"{path}/{block}").select(F.lit(block).alias("block"), F.lit(stat).alias("stat"), F.col(stat).cast("double").alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


@register("event_duration_stats", f"""WITH v AS (SELECT user_id AS key, ts AS start_ts, event_id AS seq FROM events WHERE event_type = 'view'),
p AS (SELECT user_id AS key, ts AS end_ts FROM events WHERE event_type = 'purchase'),
x AS (SELECT v.*, p.end_ts FROM v ASOF JOIN p ON v.key = p.key AND p.end_ts >= v.start_ts
      QUALIFY row_number() OVER (PARTITION BY v.key, p.end_ts ORDER BY v.start_ts DESC, v.seq DESC) = 1),
d AS (SELECT CAST(date_diff('microsecond', start_ts, end_ts) AS DOUBLE) / 86400000000.0 AS duration_days FROM x)
SELECT n, {R('mean_days', 'median_days', 'p90_days', 'p99_days', 'min_days', 'max_days', 'std_days')}
FROM (SELECT count(duration_days) AS n, avg(duration_days) AS mean_days, quantile_cont(duration_days, 0.5) AS median_days,
             quantile_cont(duration_days, 0.9) AS p90_days, quantile_cont(duration_days, 0.99) AS p99_days,
             min(duration_days) AS min_days, max(duration_days) AS max_days, stddev_samp(duration_days) AS std_days FROM d)""")
def q_event_duration_stats(spark, root):
    """A1 on the second source: view -> next purchase durations (continuous,
    microsecond precision) with exact sort-based quantiles."""
    return stats.duration_stats(reliable_checkpoint(S.event_pairs(spark, root)))


# ---------------------------------------------------------------------------
# Landed files, gates, one-path enrichment, contrasts of numbers
# ---------------------------------------------------------------------------

@register("feed_pages", """SELECT CAST(o_orderkey AS VARCHAR) AS id,
  CASE WHEN o_orderkey // 4000 % 2 = 0 THEN CAST(o_custkey AS VARCHAR) END AS entity_id, o_orderpriority AS kind FROM orders""")
def q_feed_pages(spark, root):
    """Orders landed as pages of a JSON feed, one array a file with the orders of 4000 keys;
    every other page lacks a column."""
    from ..sources import files
    path = _scratch(spark, "feed")
    page = F.floor(F.col("o_orderkey") / 4000)
    record = F.struct(F.col("o_orderkey").cast("string").alias("id"),
                      F.when(page % 2 == 0, F.col("o_custkey").cast("string")).alias("entity_id"), F.col("o_orderpriority").alias("kind"))
    pages = table(spark, root, "orders").groupBy(page.alias("page")).agg(F.to_json(F.collect_list(record)).alias("text"))
    pages.select("text").write.option("maxRecordsPerFile", 1).text(path)
    return files.read_feed_pages(spark, path, ["id", "entity_id", "kind"])


@register("worst_csv", f"""{W_STAYS}
SELECT seq, round(duration_days, 6) AS duration_days, round(y_pred, 6) AS predicted_days
FROM stays ORDER BY abs(y_pred - duration_days) DESC, seq LIMIT 50""")
def q_worst_csv(spark, root):
    """The 50 worst predictions written as CSV and read back."""
    from ..sources import files
    path = _scratch(spark, "worst")
    worst = stats.worst_predictions(S.stays(spark, root), "duration_days", "y_pred", 50, tie="seq")
    files.write_csv(worst.select("seq", "duration_days", "predicted_days"), path)
    back = files.read_raw_csv(spark, path, ["seq", "duration_days", "predicted_days"])
    return back.select(F.col("seq").cast("long"), F.col("duration_days").cast("double"), F.col("predicted_days").cast("double"))


@register("prepared_ends", f"""WITH {D.ORDER_TEXT_SQL},
t AS (SELECT CAST(o_custkey AS VARCHAR) AS key, {sql_wall_clock('ts_text')} AS end_ts FROM order_text)
SELECT key, end_ts FROM t WHERE key IS NOT NULL AND end_ts IS NOT NULL""")
def q_prepared_ends(spark, root):
    """Exactly the key (white space around it cut) and the parsed time of usable ends."""
    raw = D.order_text(spark, root).withColumn("key_text", F.concat(F.lit("\t"), F.col("o_custkey").cast("string"), F.lit(" ")))
    return pairing.prepare_ends(raw, "key_text", "ts_text", "end_ts", key_out="key")


@register("stored_columns", f"""{W_STAYS}
SELECT key, seq, start_ts, end_ts, round(duration_days, 6) AS duration_days, o_orderpriority FROM stays""")
def q_stored_columns(spark, root):
    """The stored columns, after the gate."""
    return gates.select_stored(S.stays(spark, root), ["key", "seq", "start_ts", "end_ts", "duration_days", "o_orderpriority"],
                               forbidden=["next_end_ts", "pair_status"],
                               working=["o_orderstatus", "o_totalprice", "y_pred", "score", "is_long", "flag_f"])


@register("back_transforms", f"""SELECT o_orderkey, round(least(365.0, greatest(0.0, exp(f) - 1)), 6) AS days,
  round(least(365.0, greatest(0.0, exp(f) * 1.1 - 1)), 6) AS smeared_days
FROM (SELECT o_orderkey, ln(1 + o_totalprice / {S.PRED_DIVISOR}) AS f FROM orders)""")
def q_back_transforms(spark, root):
    """F13 + F10: days from log-space values, plain and with a smearing factor of 1.1."""
    from ..models.train import back_transform
    f = F.log1p(F.col("o_totalprice") / F.lit(S.PRED_DIVISOR))
    return table(spark, root, "orders").select("o_orderkey", X.clip_days(back_transform(f, "log1p")).alias("days"),
                                               X.clip_days(back_transform(f, "log1p", 1.1)).alias("smeared_days"))


@register("enriched_parts", f"""WITH {D.PART_TEXT_SQL},
t AS (SELECT *, DATE '2020-01-01' + CAST(p_partkey % 700 AS INTEGER) AS d FROM part_text),
parsed AS ({ORACLE['parse_part_text']})
SELECT p_partkey, age_days, primary_breed, is_mix, primary_color, is_black, sex, sterilization_status, has_name,
  CAST(month(d) AS INTEGER) AS start_month, CAST(isodow(d) - 1 AS INTEGER) AS start_day_of_week, {sql_season('month(d)')} AS start_season
FROM parsed JOIN t USING (p_partkey)""")
def q_enriched_parts(spark, root):
    """all start-time features in one projection."""
    t = D.part_text(spark, root).withColumn("d", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int")))
    out = X.enrich(t, "d", "name_text", "age_text", "breed_text", "color_text", "sex_text")
    return out.drop("d", "name_text", "age_text", "breed_text", "color_text", "sex_text")


@register("numeric_contrast", f"""{W_STAYS_C},
part AS (SELECT * FROM stays_c WHERE o_orderstatus = 'O'),
u AS (SELECT 'o_totalprice' AS "column", o_totalprice AS value, is_long FROM part
      UNION ALL SELECT 'start_month', CAST(start_month AS DOUBLE), is_long FROM part)
SELECT "column", {R('mean_long_stay', 'mean_short_stay', 'median_long_stay', 'median_short_stay')} FROM (
  SELECT "column", avg(value) FILTER (WHERE is_long = 1) AS mean_long_stay, avg(value) FILTER (WHERE is_long = 0) AS mean_short_stay,
         quantile_cont(value, 0.5) FILTER (WHERE is_long = 1) AS median_long_stay,
         quantile_cont(value, 0.5) FILTER (WHERE is_long = 0) AS median_short_stay FROM u GROUP BY 1)""")
def q_numeric_contrast(spark, root):
    """A18 for numeric columns within open orders."""
    return B.numeric_contrast(MD.stays_with_customer(spark, root), ["o_totalprice", "start_month"], where={"o_orderstatus": "O"})


@register("infrequent_levels", f"""{W_STAYS_C},
lab AS (SELECT *, {sql_split('start_ts')} AS split, CAST(c_nationkey AS VARCHAR) || '-' || CAST(start_month AS VARCHAR) AS cell FROM stays_c),
often AS (SELECT cell FROM lab WHERE split = 'train' AND cell IS NOT NULL GROUP BY 1 HAVING count(*) >= 30)
SELECT seq, CASE WHEN cell IS NULL THEN 'Missing' WHEN cell IN (SELECT cell FROM often) THEN cell ELSE 'Other' END AS cell_level
FROM lab WHERE split = 'test'""")
def q_infrequent_levels(spark, root):
    """M2: levels of fewer than 30 training rows fold to Other (nation and month, 300 levels)."""
    from ..models.features import fit_levels
    lab = split.temporal_split(MD.stays_with_customer(spark, root), "start_ts", *TRAIN).withColumn(
        "cell", F.concat_ws("-", F.col("c_nationkey").cast("string"), F.col("start_month").cast("string")))
    levels = fit_levels(lab.where(F.col("split") == "train"), ["cell"], cap=300, min_rows=30)
    return levels.transform(lab.where(F.col("split") == "test")).select("seq", F.col("cell__lv").alias("cell_level"))


# ---------------------------------------------------------------------------
# Models (no SQL oracle)
# ---------------------------------------------------------------------------

def _register_models() -> None:
    from .modeling import MODEL_QUERIES
    for name, fn in MODEL_QUERIES.items():
        register(name)(fn)


_register_models()


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)

