"""Regression, interval and classifier metrics.

Everything is an aggregate over columns on the same row (predictions are never
aligned by position).  Rank-based statistics go through
:mod:`dwell.operators.ranking`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from . import ranking
from .stats import grouped_with_quantiles

TOLERANCES = (7, 14)


def _err(y: str, yhat: str) -> Column:
    return F.col(yhat) - F.col(y)


def core_metrics_cols(y: str, yhat: str) -> list[Column]:
    e = _err(y, yhat)
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    sst = F.var_pop(y) * n
    cols = [n.alias("n"),
            F.avg(F.abs(e)).alias("mae_days"),
            F.sqrt(F.avg(e * e)).alias("rmse_days"),
            F.when(sst > 0, 1 - sse / sst).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("r2"),
            F.avg(e).alias("mean_bias_days"),
            F.avg(y).alias("mean_actual_days"),
            F.avg(yhat).alias("mean_predicted_days")]
    cols += [F.avg((F.abs(e) <= F.lit(t)).cast("double")).alias(f"within_{t}_days_rate") for t in TOLERANCES]
    return cols


def _core(df: DataFrame, y: str, yhat: str, by: Sequence[str], accuracy: int | None) -> DataFrame:
    return grouped_with_quantiles(df, by, core_metrics_cols(y, yhat),
                                  [(F.abs(_err(y, yhat)), [0.5], ["median_absolute_error_days"])], accuracy)


def core_metrics(df: DataFrame, y: str, yhat: str, accuracy: int | None = None) -> DataFrame:
    """N, MAE, median AE, RMSE, R^2, bias (pred - true), means, within-7/14."""
    return _core(df, y, yhat, [], accuracy)


def metrics_by_group(df: DataFrame, y: str, yhat: str, group: str, accuracy: int | None = None) -> DataFrame:
    """Per level of ``group``: n, MAE, median AE, mean actual / predicted."""
    e = F.abs(_err(y, yhat))
    d = df.withColumn("group", F.col(group).cast("string"))
    return grouped_with_quantiles(
        d, ["group"], [F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae_days"),
                       F.avg(y).alias("mean_actual_days"), F.avg(yhat).alias("mean_predicted_days")],
        [(e, [0.5], ["median_absolute_error_days"])], accuracy)


def with_deciles(df: DataFrame, value: str, tie: str, q: int = 10, out: str = "decile") -> DataFrame:
    """W1 as a 1-based decile column."""
    return ranking.rank_bins(df, value, tie, q, "_bin").withColumn(out, F.col("_bin") + 1).drop("_bin")


def metrics_by_decile(df: DataFrame, y: str, yhat: str, tie: str, q: int = 10,
                      accuracy: int | None = None) -> DataFrame:
    """A13 (= calibration table): per predicted decile n, mean predicted, mean and
    median actual, MAE, standard error of the mean actual (0 when n = 1)."""
    d = with_deciles(df, yhat, tie, q)
    return grouped_with_quantiles(
        d, ["decile"], [F.count(F.lit(1)).alias("n"), F.avg(yhat).alias("mean_predicted_days"),
                        F.avg(y).alias("mean_actual_days"), F.avg(F.abs(_err(y, yhat))).alias("mae_days"),
                        F.coalesce(F.stddev_samp(y) / F.sqrt(F.count(F.lit(1))), F.lit(0.0))
                        .alias("actual_standard_error")],
        [(y, [0.5], ["median_actual_days"])], accuracy)


def bias_by_decile(df: DataFrame, y: str, yhat: str, tie: str, q: int = 10) -> DataFrame:
    """Signed bias per predicted decile."""
    d = with_deciles(df, yhat, tie, q)
    return d.groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(yhat).alias("mean_predicted_days"),
        F.avg(y).alias("mean_actual_days"), F.avg(_err(y, yhat)).alias("mean_bias_days"))


def compare_variants(df: DataFrame, y: str, variants: Sequence[str], tie: str, q: int = 10,
                     accuracy: int | None = None) -> DataFrame:
    """A11 plus the largest absolute decile bias for each prediction column.

    The variants are unpivoted to (variant, y_pred) and binned within variant by
    their cut values; the rows are not sorted."""
    long = df.select(y, tie, *variants).unpivot([y, tie], list(variants), "variant", "_yhat")
    ranked = ranking.rank_bins(long, "_yhat", tie, q, "_bin", by=["variant"]).withColumn("decile", F.col("_bin") + 1)
    per_decile = ranked.groupBy("variant", "decile").agg(F.avg(_err(y, "_yhat")).alias("_bias"))
    worst = per_decile.groupBy("variant").agg(F.max(F.abs("_bias")).alias("max_abs_decile_bias_days"))
    core = _core(long, y, "_yhat", ["variant"], accuracy)  # the errors need no bins
    return core.join(worst, "variant")


def interval_calibration(df: DataFrame, y: str, lo: str, mid: str, hi: str,
                         nominal: float = 0.80, accuracy: int | None = None) -> DataFrame:
    """Empirical coverage of [lo, hi] (inclusive), below / above rates, widths,
    crossing rate, MAE of the middle quantile."""
    yc, l, h = F.col(y), F.col(lo), F.col(hi)
    rate = lambda c: F.avg(c.cast("double"))
    return grouped_with_quantiles(df, [], [
        F.lit(nominal).alias("nominal_coverage"),
        rate((yc >= l) & (yc <= h)).alias("empirical_coverage"),
        rate(yc < l).alias("below_interval_rate"), rate(yc > h).alias("above_interval_rate"),
        F.avg(h - l).alias("mean_interval_width_days"),
        rate(l > h).alias("quantile_crossing_rate"),
        F.avg(F.abs(F.col(mid) - yc)).alias("median_model_mae_days")],
        [(h - l, [0.5], ["median_interval_width_days"])], accuracy)


def tail_analysis(df: DataFrame, y: str, yhat: str, tie: str, threshold: float = 90.0,
                  hi: str | None = None, q: int = 10, accuracy: int | None = None) -> DataFrame:
    """How the long rows (y >= threshold) fare; n = 0 when there are none."""
    # the highest bin is always populated: q when n > 1, else the single bin 1
    d = ranking.global_row_number(df.select(*dict.fromkeys([y, yhat, tie, *([hi] if hi else [])])), [yhat, tie], "_r", total="_n")
    d = d.withColumns({"decile": ranking.bin_of_rank(F.col("_r"), F.col("_n"), q) + 1,
                       "_maxdec": F.when(F.col("_n") > 1, F.lit(q)).otherwise(F.lit(1))})
    long = F.col(y) >= F.lit(threshold)
    in_top = F.col("decile") == F.col("_maxdec")
    in_two = F.col("decile") >= F.col("_maxdec") - 1
    cnt = F.count_if(long)
    lv = lambda c: F.when(long, c)
    cols = [F.lit(threshold).alias("threshold_days"), cnt.alias("n"),
            F.avg(long.cast("double")).alias("share_of_test"),
            F.avg(lv(F.col(y))).alias("mean_actual_days"),
            F.avg(lv(F.col(yhat))).alias("mean_predicted_days"),
            F.avg(lv(F.abs(_err(y, yhat)))).alias("mae_days"),
            F.avg(lv(_err(y, yhat))).alias("mean_bias_days"),
            F.avg(lv((F.col(yhat) < F.col(y)).cast("double"))).alias("under_predicted_rate"),
            F.avg(lv((F.col(yhat) >= F.lit(threshold)).cast("double"))).alias("predicted_over_threshold_rate"),
            F.avg(lv(in_top.cast("double"))).alias("recall_in_top_decile"),
            F.avg(lv(in_two.cast("double"))).alias("recall_in_top_two_deciles"),
            F.avg(F.when(in_top, long.cast("double"))).alias("base_rate_top_decile")]
    if hi:
        cols.append(F.avg(lv((F.col(y) > F.col(hi)).cast("double"))).alias("above_p90_band_rate"))
    return grouped_with_quantiles(d, [], cols, [(lv(F.col(y)), [0.5], ["median_actual_days"]),
                                                (lv(F.col(yhat)), [0.5], ["median_predicted_days"])], accuracy)


# ---------------------------------------------------------------------------
# classifier
# ---------------------------------------------------------------------------

def operating_points(df: DataFrame, score: str, label: str, thresholds: Sequence[float]) -> DataFrame:
    """A25 for several thresholds in one pass: confusion counts of ``score >= t``,
    precision / recall / F1 (0 when undefined), flagged and flagged rate."""
    s, yv = F.col(score), F.col(label) == 1
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, t in enumerate(thresholds):
        hit = s >= F.lit(float(t))
        aggs += [F.count_if(hit & yv).alias(f"tp{i}"), F.count_if(hit & ~yv).alias(f"fp{i}"),
                 F.count_if(~hit & yv).alias(f"fn{i}"), F.count_if(~hit & ~yv).alias(f"tn{i}")]
    row = df.agg(*aggs)
    stack = ", ".join(f"{float(t)!r}D, tp{i}, fp{i}, fn{i}, tn{i}" for i, t in enumerate(thresholds))
    long = row.selectExpr("_n", f"stack({len(thresholds)}, {stack}) AS (threshold, tp, fp, fn, tn)")
    p = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    r = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    out = long.withColumns({"precision": p, "recall": r})
    return out.select(
        "threshold", "precision", "recall",
        F.when(F.col("precision") + F.col("recall") > 0,
               2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
        .otherwise(0.0).alias("f1"),
        (F.col("tp") + F.col("fp")).alias("flagged"),
        ((F.col("tp") + F.col("fp")) / F.col("_n")).alias("flagged_rate"),
        F.col("tn").alias("true_negative"), F.col("fp").alias("false_positive"),
        F.col("fn").alias("false_negative"), F.col("tp").alias("true_positive"))


def curve_summary_cols() -> list[Column]:
    """Aggregates over a PR-curve table (one row per distinct threshold) giving
    AP (step sum), ROC-AUC (trapezoid), Brier, base rate, lift and n."""
    P, N = F.first("positives"), F.first("negatives")
    t = F.col("threshold")
    ap = F.sum(F.col("tp_at") * F.col("precision")) / P
    auc = F.sum(F.col("fp_at") * (2 * F.col("tp") - F.col("tp_at"))) / (2.0 * P * N)
    brier = F.sum(F.col("tp_at") * (t - 1) * (t - 1) + F.col("fp_at") * t * t) / (P + N)
    base = P / (P + N)
    return [ap.alias("pr_auc"), base.alias("pr_auc_baseline"),
            F.when(base > 0, ap / base).alias("pr_auc_lift"), auc.alias("roc_auc"),
            brier.alias("brier_score"), base.alias("positive_rate"), (P + N).alias("n")]


def classifier_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """A26 from the per-threshold curve (distinct scores only)."""
    return ranking.pr_curve(df, score, label).agg(*curve_summary_cols())


def pr_curve_by_group(df: DataFrame, group: str, score: str, label: str) -> DataFrame:
    """W4 per group: one global prefix over (group, threshold desc), then the
    group's own start is subtracted (no per-group window over raw rows)."""
    by = (df.groupBy(F.col(group).alias("group"), F.col(score).alias("threshold"))
          .agg(F.sum(F.col(label).cast("long")).alias("tp_at"),
               F.sum((1 - F.col(label)).cast("long")).alias("fp_at")))
    pre = ranking.prefix_aggregate(by, ["group", F.col("threshold").desc()],
                                   {"_tp": ("sum", "tp_at"), "_fp": ("sum", "fp_at")}, True)
    starts = pre.groupBy("group").agg(
        F.min(F.col("_tp") - F.col("tp_at")).alias("_tp0"), F.min(F.col("_fp") - F.col("fp_at")).alias("_fp0"),
        F.sum("tp_at").alias("positives"), F.sum("fp_at").alias("negatives"))
    out = pre.join(starts, "group").withColumns({"tp": F.col("_tp") - F.col("_tp0"),
                                                 "fp": F.col("_fp") - F.col("_fp0")})
    return out.withColumns({"precision": F.col("tp") / (F.col("tp") + F.col("fp")),
                            "recall": F.try_divide(F.col("tp"), F.col("positives"))}).drop(
        "_tp", "_fp", "_tp0", "_fp0")


def classifier_by_group(df: DataFrame, group: str, score: str, label: str,
                        min_n: int = 50, min_pos: int = 5, min_lift: float = 2.0) -> DataFrame:
    """A35 + A34: A26 per group, groups with n < min_n or positives < min_pos
    skipped; ``reliable`` = lift >= min_lift."""
    curve = pr_curve_by_group(df, group, score, label)
    out = curve.groupBy("group").agg(*curve_summary_cols())
    out = out.where((F.col("n") >= min_n) & (F.col("positive_rate") * F.col("n") >= min_pos))
    return out.withColumns({"reliable": F.col("pr_auc_lift") >= F.lit(min_lift),
                            "min_lift": F.lit(min_lift)})


def reliability_table(df: DataFrame, score: str, label: str, tie: str, bins: int = 10) -> DataFrame:
    """Score bins of equal count: n, mean score, observed rate, binomial SE."""
    d = with_deciles(df, score, tie, bins, "bin")
    rate = F.avg(F.col(label).cast("double"))
    return d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_predicted_probability"),
                                rate.alias("actual_positive_rate")).withColumn(
        "standard_error", F.sqrt(F.col("actual_positive_rate") * (1 - F.col("actual_positive_rate")) / F.col("n")))


def expected_calibration_error(table: DataFrame) -> DataFrame:
    """N-weighted mean |mean score - observed rate| over a reliability table."""
    gap = F.abs(F.col("mean_predicted_probability") - F.col("actual_positive_rate"))
    return table.agg((F.sum(F.col("n") * gap) / F.sum("n")).alias("ece"))


def fit_smearing(df: DataFrame, y: str, f_log: str, target: str = "log1p", quantile: float | None = None) -> DataFrame:
    """Duan smearing factor S = mean(exp(log1p(y) - f)), population std of the
    log residual, n.  Refused where the factor has no meaning: for a model of a quantile,
    which needs no correction of the mean, and for one that was not fitted on log1p(y)."""
    if quantile is not None:
        raise ValueError(f"smearing corrects a mean; this model predicts the {quantile} quantile")
    if target != "log1p":
        raise ValueError(f"smearing needs a model fitted on log1p(y), not on {target!r}")
    r = F.log1p(F.col(y)) - F.col(f_log)
    return df.agg(F.avg(F.exp(r)).alias("smearing_factor"), F.stddev_pop(r).alias("residual_std"),
                  F.count(F.lit(1)).alias("n"))


def clipping_counts(df: DataFrame, before: str, after: str, lo: float = 0.0, hi: float = 365.0) -> DataFrame:
    """Part of A30: rows at the floor / ceiling before and after a correction."""
    b, a = F.col(before), F.col(after)
    out = df.agg(F.count_if(b >= hi).alias("clipped_at_ceiling_before"),
                 F.count_if(a >= hi).alias("clipped_at_ceiling_after"),
                 F.count_if(b <= lo).alias("clipped_at_floor_before"),
                 F.count_if(a <= lo).alias("clipped_at_floor_after"))
    return out.withColumn("ties_introduced_by_clipping",
                          F.col("clipped_at_ceiling_after") - F.col("clipped_at_ceiling_before")
                          + F.col("clipped_at_floor_after") - F.col("clipped_at_floor_before"))


def deciles_identical(df: DataFrame, before: str, after: str, tie: str) -> DataFrame:
    """N, and whether every row has the same decile by both columns.  The second decile is put
    beside the first on its row, so rows are neither joined nor sorted."""
    first = reliable_checkpoint(with_deciles(df.select(tie, before, after), before, tie, out="_d1"))
    return with_deciles(first, after, tie, out="_d2").agg(
        F.count(F.lit(1)).alias("n"), F.bool_and(F.col("_d1") == F.col("_d2")).alias("decile_assignment_identical"))


def smearing_comparison(df: DataFrame, y: str, before: str, after: str, tie: str) -> DataFrame:
    """One row with the errors before and after a correction, whether it keeps the order and
    the decile of every row, the rank correlation, and the rows at the floor and the ceiling."""
    from .breakdown import _one_row
    cols = [before, after]
    wide = compare_variants(df, y, cols, tie).groupBy().pivot("variant", cols).agg(
        F.first("mae_days").alias("mae"), F.first("mean_bias_days").alias("bias"), F.first("r2").alias("r2"))
    same = deciles_identical(df, before, after, tie).drop("n")
    return _one_row(wide, ranking.rank_preserving(df, before, after),
                    ranking.spearman(df, before, after, "spearman_correlation"), same, clipping_counts(df, before, after))


def operating_point_by_group(df: DataFrame, group: str, score: str, label: str, threshold: float,
                             min_n: int = 50, min_pos: int = 5) -> DataFrame:
    """A25 per group (the second half of A35): one aggregate, groups with n < min_n or
    positives < min_pos skipped."""
    hit, yv = F.col(score) >= F.lit(float(threshold)), F.col(label) == 1
    g = df.groupBy(F.col(group).alias("group")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(yv).alias("positives"), F.count_if(hit).alias("flagged"),
        F.count_if(hit & yv).alias("true_positive"))
    p = F.coalesce(F.try_divide(F.col("true_positive"), F.col("flagged")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("true_positive"), F.col("positives")), F.lit(0.0))
    return (g.where((F.col("n") >= min_n) & (F.col("positives") >= min_pos))
            .withColumns({"threshold": F.lit(float(threshold)), "precision": p, "recall": r})
            .withColumns({"f1": F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)),
                          "flagged_rate": F.col("flagged") / F.col("n")}))


def group_reliability(by_group: DataFrame, min_lift: float = 2.0) -> DataFrame:
    """A34 projection of :func:`classifier_by_group`."""
    return by_group.select("group", "pr_auc", F.col("positive_rate").alias("base_rate"),
                           F.col("pr_auc_lift").alias("lift"),
                           (F.col("pr_auc_lift") >= F.lit(min_lift)).alias("reliable"),
                           F.lit(min_lift).alias("min_lift"))
