"""Grouped duration statistics.

Each operator is one hash aggregate over the rows (partial + final, so a level
holding a third of all rows is pre-aggregated map-side), followed by small
steps over the *aggregated* levels.  Wide feature sets are unpivoted to
(column, value) and grouped once instead of being scanned per column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import grouped_with_quantiles


def where_equal(df: DataFrame, where: Mapping[str, object] | None) -> DataFrame:
    """P10: conjunctive equality filter ``{column: value}``."""
    for c, v in (where or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def _long(y: str, threshold: float) -> Column:
    return (F.col(y) >= F.lit(threshold)).cast("int")


def breakdown(df: DataFrame, by: str, y: str = "duration_days", where: Mapping[str, object] | None = None,
              min_n: int = 100, threshold: float = 90.0, accuracy: int | None = None) -> DataFrame:
    """A17 levels: value, n, share, median / mean / p90 days, long rate, long n, lift.

    Shares and the overall rate use the whole filtered selection (null levels and
    levels below ``min_n`` included); those levels are then left out of the
    result.  See :func:`breakdown_summary` for the overall figures and the
    dropped counts."""
    part = where_equal(df, where).withColumn("value", F.col(by).cast("string"))
    lv = grouped_with_quantiles(part, ["value"], [
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean_days"),
        F.avg(_long(y, threshold).cast("double")).alias("long_stay_rate"),
        F.sum(_long(y, threshold)).alias("long_stay_n")],
        [(y, [0.5, 0.9], ["median_days", "p90_days"])], accuracy)
    totals = part.agg(F.count(F.lit(1)).alias("_total"), F.sum(_long(y, threshold)).alias("_long_total"))
    lv = _attach(lv, totals)
    overall = F.col("_long_total") / F.col("_total")
    return (lv.where(F.col("value").isNotNull() & (F.col("n") >= min_n))
            .select("value", "n", (F.col("n") / F.col("_total")).alias("share"),
                    "median_days", "mean_days", "p90_days",
                    "long_stay_rate", "long_stay_n",
                    F.when(overall > 0, F.col("long_stay_rate") / overall).alias("lift_over_base")))


def breakdown_summary(df: DataFrame, by: str, y: str = "duration_days",
                      where: Mapping[str, object] | None = None, min_n: int = 100,
                      threshold: float = 90.0, accuracy: int | None = None) -> DataFrame:
    """A17 overall: n, overall median / mean / long rate, levels and rows dropped
    below ``min_n``.  An empty selection gives n = 0."""
    part = where_equal(df, where)
    lv = part.groupBy(F.col(by).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(y)).alias("_sum"), F.sum(_long(y, threshold)).alias("_ln"))
    small = F.col("value").isNotNull() & (F.col("n") < min_n)
    counts = lv.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
                    F.count_if(small).alias("levels_dropped_below_min_n"),
                    F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)).alias("rows_dropped_below_min_n"),
                    (F.sum("_sum") / F.sum("n")).alias("overall_mean_days"),
                    (F.sum("_ln") / F.sum("n")).alias("overall_long_stay_rate"))
    med = grouped_with_quantiles(part, [], [F.count(F.lit(1)).alias("_rows")],
                                 [(y, [0.5], ["overall_median_days"])], accuracy).drop("_rows")
    return _one_row(counts, med).withColumn("min_n", F.lit(min_n))


def _one_row(*frames: DataFrame) -> DataFrame:
    """Side-by-side single-row aggregates: the first frame plus the others'
    columns as scalar subqueries (no join)."""
    out = frames[0]
    for f in frames[1:]:
        out = _attach(out, f)
    return out


def unpivot_levels(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(keep..., column, value) with every level column cast to text."""
    cast = df.select(*keep, *[F.col(c).cast("string").alias(c) for c in columns])
    return cast.unpivot(list(keep), list(columns), "column", "value")


def feature_contrast(df: DataFrame, columns: Sequence[str], y: str = "duration_days",
                     where: Mapping[str, object] | None = None, min_n: int = 100,
                     threshold: float = 90.0, k: int = 3) -> DataFrame:
    """For each column, its levels' long rate and lift inside the selection;
    the k highest and k lowest levels, the column's spread (max - min rate) and
    the column's rank by spread."""
    part = where_equal(df, where).withColumn("_y", _long(y, threshold))
    base = part.agg(F.avg(F.col("_y").cast("double")).alias("_base"))
    long = unpivot_levels(part, columns, ["_y"])
    lv = (long.groupBy("column", "value")
          .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_y").cast("double")).alias("long_stay_rate"))
          .where(F.col("value").isNotNull() & (F.col("n") >= min_n)))
    lv = _attach(lv, base)
    per_col = Window.partitionBy("column")
    lv = lv.withColumns({
        "lift_over_base": F.when(F.col("_base") > 0, F.col("long_stay_rate") / F.col("_base")),
        "spread": F.max("long_stay_rate").over(per_col) - F.min("long_stay_rate").over(per_col),
        "top_rank": F.row_number().over(per_col.orderBy(F.col("long_stay_rate").desc(), "value")),
        "bottom_rank": F.row_number().over(per_col.orderBy(F.col("long_stay_rate"), F.col("value").desc()))})
    spreads = lv.select("column", "spread").distinct()
    spreads = spreads.withColumn("spread_rank", F.row_number().over(
        Window.partitionBy().orderBy(F.col("spread").desc(), "column")))  # <= #columns rows
    return (lv.where((F.col("top_rank") <= k) | (F.col("bottom_rank") <= k))
            .join(spreads.drop("spread"), "column").drop("_base"))


def contrast_by_group(df: DataFrame, group: str, columns: Sequence[str], y: str = "duration_days", min_n: int = 100,
                      threshold: float = 90.0, k: int = 3, top: int = 5) -> DataFrame:
    """A18 inside every group at once: per group the ``top`` columns by spread of their levels' long rates
    (``contrast``: column, spread, the ``k`` highest and the ``k`` lowest levels with n, rate and lift).
    Boolean columns count as levels.  One aggregate over (group, column, value)."""
    part = df.where(F.col(group).isNotNull()).withColumn("_y", _long(y, threshold))
    base = part.groupBy(F.col(group).alias("group")).agg(F.avg(F.col("_y").cast("double")).alias("_base"))
    long = unpivot_levels(part.withColumn("_group", F.col(group)), columns, ["_group", "_y"])
    lv = (long.groupBy(F.col("_group").alias("group"), "column", "value")
          .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("_y").cast("double")).alias("rate"))
          .where(F.col("value").isNotNull() & (F.col("n") >= min_n)).join(base, "group"))
    lv = lv.withColumn("lift", F.when(F.col("_base") > 0, F.col("rate") / F.col("_base")))
    order = lambda sign: F.struct((sign * F.col("rate")).alias("r"), F.col("value"), F.col("n"), F.col("rate"), F.col("lift"))
    cut = lambda c: F.transform(F.slice(c, 1, k), lambda s: F.struct(s["value"].alias("value"), s["n"].alias("n"), s["rate"].alias("rate"), s["lift"].alias("lift")))
    # a (group, column) has at most as many levels as pass min_n
    per = lv.groupBy("group", "column").agg((F.max("rate") - F.min("rate")).alias("spread"), F.sort_array(F.collect_list(order(-1.0))).alias("high"),
                                            F.sort_array(F.collect_list(order(1.0))).alias("low"))
    item = F.struct((-F.col("spread")).alias("s"), "column", "spread", cut("high").alias("highest"), cut("low").alias("lowest"))
    listed = per.groupBy("group").agg(F.slice(F.sort_array(F.collect_list(item)), 1, top).alias("l"))  # an item a column
    return listed.select("group", F.transform("l", lambda s: F.struct(s["column"].alias("column"), s["spread"].alias("spread"),
                                                                      s["highest"].alias("highest"), s["lowest"].alias("lowest"))).alias("contrast"))


def numeric_contrast(df: DataFrame, columns: Sequence[str], y: str = "duration_days",
                     where: Mapping[str, object] | None = None, threshold: float = 90.0) -> DataFrame:
    """A18 for numeric columns: mean and median among the long and among the short rows of the
    selection, one row per column.  Null and NaN values do not count."""
    part = where_equal(df, where).withColumn("_long", F.col(y) >= F.lit(threshold))
    long = (part.select("_long", *[F.col(c).cast("double").alias(c) for c in columns])
            .unpivot(["_long"], list(columns), "column", "value").where(F.col("value").isNotNull() & ~F.isnan("value")))
    sides = grouped_with_quantiles(long, ["column", "_long"], [F.avg("value").alias("_mean")],
                                   [("value", [0.5], ["_median"])])
    return sides.groupBy("column").agg(*[
        F.max(F.when(F.col("_long") == is_long, F.col(f"_{stat}"))).alias(f"{stat}_{side}_stay")
        for stat in ("mean", "median") for side, is_long in (("long", True), ("short", False))])


def _attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a (at most) one-row aggregate to every row as one
    scalar subquery (evaluated once; null when the aggregate has no row)."""
    s = one_row.select(F.struct(*one_row.columns).alias("_s")).scalar()
    return df.withColumns({c: s.getField(c) for c in one_row.columns})


def load_share(df: DataFrame, y: str = "duration_days", quick: float = 7.0, long: float = 90.0) -> DataFrame:
    """Who consumes the total duration - shares of rows and of summed days
    for quick (<= quick) and long (>= long) rows."""
    d = F.col(y)
    total = F.sum(d)
    return df.agg(
        F.count(F.lit(1)).alias("n_entities"), total.alias("total_entity_days"),
        F.lit(quick).alias("quick_exit_days_threshold"),
        F.avg((d <= quick).cast("double")).alias("quick_exit_share_of_entities"),
        (F.sum(F.when(d <= quick, d).otherwise(0.0)) / total).alias("quick_exit_share_of_entity_days"),
        F.lit(long).alias("long_stay_days_threshold"),
        F.avg((d >= long).cast("double")).alias("long_stay_share_of_entities"),
        (F.sum(F.when(d >= long, d).otherwise(0.0)) / total).alias("long_stay_share_of_entity_days"),
        F.coalesce(F.avg(F.when(d >= long, d)), F.lit(0.0)).alias("long_stay_mean_days"))


def controlled_effect(df: DataFrame, flag_col: str, controls: Sequence[str], y: str = "duration_days",
                      min_stratum: int = 40, threshold: float = 90.0) -> DataFrame:
    """Direct standardisation of the flag's effect on the long rate.

    Per stratum of ``controls``: p1 - p0 weighted by stratum size over the usable
    strata (both sides present, size >= ``min_stratum``, no null control);
    variance p1(1-p1)/n1 + p0(1-p0)/n0; 95 % interval.  Two small aggregations:
    rows -> strata -> one row.  ``usable`` is false when no stratum qualifies."""
    part = df.where(F.col(flag_col).isNotNull())
    f = F.col(flag_col).cast("boolean")
    yy = _long(y, threshold)
    strata = part.groupBy(*controls).agg(
        F.count_if(f).alias("n1"), F.count_if(~f).alias("n0"),
        F.sum(F.when(f, yy).otherwise(0)).alias("y1"), F.sum(F.when(~f, yy).otherwise(0)).alias("y0"))
    no_null = F.lit(True)
    for c in controls:
        no_null = no_null & F.col(c).isNotNull()
    ok = no_null & (F.col("n1") > 0) & (F.col("n0") > 0) & (F.col("n1") + F.col("n0") >= min_stratum)
    p1, p0 = F.col("y1") / F.col("n1"), F.col("y0") / F.col("n0")
    n = F.col("n1") + F.col("n0")
    var = p1 * (1 - p1) / F.col("n1") + p0 * (1 - p0) / F.col("n0")
    w = F.sum(F.when(ok, n))
    est = F.sum(F.when(ok, n * (p1 - p0))) / w
    se = F.sqrt(F.sum(F.when(ok, n * n * var))) / w
    out = strata.agg(
        (F.count_if(ok) > 0).alias("usable"),
        (F.sum("y1") / F.sum("n1")).alias("raw_rate_flagged"),
        (F.sum("y0") / F.sum("n0")).alias("raw_rate_unflagged"),
        ((F.sum("y1") / F.sum("n1") - F.sum("y0") / F.sum("n0")) * 100).alias("raw_difference_pp"),
        (est * 100).alias("controlled_difference_pp"),
        ((est - 1.96 * se) * 100).alias("ci95_low_pp"), ((est + 1.96 * se) * 100).alias("ci95_high_pp"),
        (se * 100).alias("standard_error_pp"), F.count_if(ok).alias("strata_used"),
        F.coalesce(F.sum(F.when(ok, n)), F.lit(0)).alias("rows_retained"),
        (F.coalesce(F.sum(F.when(ok, n)), F.lit(0)) / F.sum(n)).alias("coverage"),
        F.coalesce(F.abs(est) > 1.96 * se, F.lit(False)).alias("significant"))
    return out.withColumn("reason", F.when(~F.col("usable"), F.lit("no stratum contained both groups")))


def over_representation(df: DataFrame, columns: Sequence[str], y: str = "duration_days",
                        threshold: float = 90.0, top: int = 6, min_base: float = 0.01,
                        min_ratio: float = 1.25) -> DataFrame:
    """Per column, the ``top`` most common levels among long rows whose share
    there exceeds their overall share by ``min_ratio`` (overall share > min_base).
    Shares are among non-null values of the column."""
    long = unpivot_levels(df.withColumn("_y", _long(y, threshold)), columns, ["_y"]).where(
        F.col("value").isNotNull())
    lv = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("n_long"))
    # per-column totals: a partial aggregate over the rows, one row per column
    tot = long.groupBy("column").agg(F.count(F.lit(1)).alias("_n_all"), F.sum("_y").alias("_n_long_all"))
    lv = lv.join(F.broadcast(tot), "column")  # <= number of columns rows
    lv = lv.withColumns({"share_of_long_stays": F.col("n_long") / F.col("_n_long_all"),
                         "share_of_all": F.col("n") / F.col("_n_all")})
    # row_number <= top becomes a per-partition group limit before the shuffle
    per_col = Window.partitionBy("column")
    lv = lv.where(F.col("n_long") > 0).withColumn(
        "_rk", F.row_number().over(per_col.orderBy(F.col("n_long").desc(), "value")))
    ratio = F.col("share_of_long_stays") / F.col("share_of_all")
    return (lv.where((F.col("_rk") <= top) & (F.col("share_of_all") > min_base) & (ratio > min_ratio))
            .select("column", "value", "share_of_long_stays", "share_of_all", ratio.alias("over_representation")))


def flag_timing_by_level(df: DataFrame, flag_col: str, level: str, y: str = "duration_days",
                         threshold: float = 90.0) -> DataFrame:
    """A22 per level of the circumstance: n, flag rate, long rate with / without
    the flag and their ratio."""
    f = F.coalesce(F.col(flag_col).cast("boolean"), F.lit(False))
    yy = _long(y, threshold).cast("double")
    lv = df.groupBy(F.col(level).cast("string").alias("value")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(f.cast("double")).alias("flag_rate"),
        F.avg(F.when(f, yy)).alias("long_rate_flagged"), F.avg(F.when(~f, yy)).alias("long_rate_unflagged"))
    return lv.withColumn("flagged_over_unflagged",
                         F.try_divide(F.col("long_rate_flagged"), F.col("long_rate_unflagged")))


def flag_timing_summary(df: DataFrame, flag_col: str, y: str = "duration_days",
                        threshold: float = 90.0) -> DataFrame:
    """A22 overall: flag rate among long rows, the rest, and all rows."""
    f = F.coalesce(F.col(flag_col).cast("boolean"), F.lit(False)).cast("double")
    lg = F.col(y) >= F.lit(threshold)
    return df.agg(F.avg(F.when(lg, f)).alias("flag_rate_among_long"),
                  F.avg(F.when(~lg, f)).alias("flag_rate_among_rest"), F.avg(f).alias("flag_rate_all"))


def characterise_failures(worst: DataFrame, y: str, flag_col: str | None = None) -> DataFrame:
    """A24 numbers over the worst rows (output of T1)."""
    under = F.col("signed_error_days") < 0
    cols = [F.count(F.lit(1)).alias("n"), F.count_if(under).alias("under_predicted"),
            F.count_if(~under).alias("over_predicted"), F.avg(y).alias("mean_actual_days"),
            F.avg("predicted_days").alias("mean_predicted_days"), F.min(y).alias("min_actual_days"),
            F.max(y).alias("max_actual_days"), F.avg("absolute_error_days").alias("mean_absolute_error_days")]
    if flag_col:
        cols.append(F.avg(F.col(flag_col).cast("double")).alias("flag_rate"))
    return worst.agg(*cols)


def failure_levels(worst: DataFrame, columns: Sequence[str], top: Mapping[str, int] | None = None) -> DataFrame:
    """A24 level counts of the worst rows per column (optionally top-n per column)."""
    long = unpivot_levels(worst, columns, [])
    lv = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("count"))
    if top:
        lim = F.create_map(*[x for k, v in top.items() for x in (F.lit(k), F.lit(v))])
        rk = F.row_number().over(Window.partitionBy("column").orderBy(F.col("count").desc(), "value"))
        lv = lv.withColumn("_rk", rk).where(F.col("_rk") <= F.coalesce(lim[F.col("column")], F.lit(1 << 30))).drop("_rk")
    return lv
