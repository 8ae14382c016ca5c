"""Report composition (M14-M16): named blocks of small DataFrames.

Each block is its own aggregate over the scored test frame, which is
written once so the blocks do not re-run the pairing or the models.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip_days
from ..operators import breakdown as B
from ..operators import lookup
from ..operators import metrics as M
from ..operators import ranking
from ..session import reliable_checkpoint, written
from .isotonic import fit_isotonic
from .train import predict_group_median


#: Blocks prepared side by side.
BLOCKS_AT_ONCE = 4


def _side_by_side(makers: Mapping[str, Callable]) -> dict:
    """What each maker returns, by its name.  Blocks sort and checkpoint counts in many short jobs that wait
    for the driver more than for the executors, and no block needs another, so a few are prepared at a time."""
    with ThreadPoolExecutor(BLOCKS_AT_ONCE) as pool:
        made = {name: pool.submit(make) for name, make in makers.items()}
        return {name: one.result() for name, one in made.items()}


def operating_report(valid: DataFrame, test: DataFrame, score: str, label: str, recall: float = 0.5, precision: float = 0.5,
                     threshold: float = 0.1) -> DataFrame:
    """A25 on test at the fixed threshold and at those that reach ``recall`` and ``precision`` on
    validation.  A target that no threshold reaches is a row of its own: not attainable, all figures null."""
    curve = reliable_checkpoint(ranking.pr_curve(valid, score, label))
    points = {"operating": threshold, "at_recall": ranking.threshold_for_recall(curve, recall).first()[0],
              "at_precision": ranking.threshold_for_precision(curve, precision).first()[0]}
    reached = {name: float(t) for name, t in points.items() if t is not None}
    figures = M.operating_points(test, score, label, sorted(set(reached.values())))
    names = test.sparkSession.createDataFrame([(n, reached.get(n), n in reached) for n in points], "point string, _t double, attainable boolean")
    return names.join(figures, F.col("_t") == F.col("threshold"), "left").drop("_t")


def calibration_report(valid: DataFrame, test: DataFrame, score: str, label: str, tie: str) -> dict[str, DataFrame]:
    """M8 beside the raw score on test: reliability of both, and one row with Brier score and calibration
    error of both, whether the map keeps the order (W3) and the rank correlation (W6)."""
    t = fit_isotonic(valid, score, label).calibrate(test.select(tie, score, label), score, "calibrated")
    t = written(t)
    made = _side_by_side({"raw": lambda: M.reliability_table(t, score, label, tie), "iso": lambda: M.reliability_table(t, "calibrated", label, tie),
                          "kept": lambda: ranking.rank_preserving(t, score, "calibrated", "ranking_preserved"),
                          "spearman": lambda: ranking.spearman(t, score, "calibrated", "spearman_after_calibration")})
    raw, iso = made["raw"], made["iso"]
    brier = lambda c: F.avg((F.col(c) - F.col(label)) * (F.col(c) - F.col(label)))
    row = B._one_row(t.agg(brier(score).alias("brier_raw"), brier("calibrated").alias("brier_isotonic")),
                     M.expected_calibration_error(raw).withColumnRenamed("ece", "ece_raw"), M.expected_calibration_error(iso).withColumnRenamed("ece", "ece_isotonic"),
                     made["kept"], made["spearman"])
    return {"reliability": raw, "reliability_isotonic": iso, "calibration": row, "ece": M.expected_calibration_error(raw)}


def classifier_report(valid: DataFrame, test: DataFrame, score: str, label: str, tie: str,
                      group: str | None = None, recall: float = 0.5, precision: float = 0.5,
                      threshold: float = 0.1, train: DataFrame | None = None) -> dict[str, DataFrame]:
    """Thresholds chosen on validation, applied to test; both calibrations; with ``train`` the
    baseline that answers its positive rate for everyone."""
    makers = {"classifier": lambda: M.classifier_metrics(test, score, label),
              "operating_points": lambda: operating_report(valid, test, score, label, recall, precision, threshold),
              "calibration": lambda: calibration_report(valid, test, score, label, tie)}
    if train is not None:
        rate = train.agg(F.avg(F.col(label).cast("double")).alias("_rate"))
        makers["baseline"] = lambda: M.classifier_metrics(B._attach(test.select(label), rate), "_rate", label)
    if group:
        makers["by_group"] = lambda: M.classifier_by_group(test, group, score, label)
        makers["operating_point_by_group"] = lambda: M.operating_point_by_group(test, group, score, label, threshold)
    blocks = _side_by_side(makers)
    return blocks | blocks["calibration"]


def baselines_report(train: DataFrame, test: DataFrame, y: str, y_pred: str, tie: str, keys: Sequence[str]) -> DataFrame:
    """M3 beside the model: A15 for the global median, the cell median and ``y_pred``, and the share of
    test rows in a cell that training has not."""
    x = predict_group_median(test, train, list(keys), y, "cell_median_days")
    x = B._attach(x, ranking.group_quantiles(train, y, [0.5], ["global_median_days"]))
    x = written(x.select(tie, y, y_pred, "cell_median_days", clip_days("global_median_days").alias("global_median_days")))
    unseen = lookup.unseen_cell_rate(test, lookup.group_median_table(train, list(keys), y), list(keys))
    return B._attach(M.compare_variants(x, y, [y_pred, "cell_median_days", "global_median_days"], tie), unseen)


def build_report(scored_test: DataFrame, y: str, y_pred: str, tie: str, levels: Sequence[str],
                 flag: str | None = None, controls: Sequence[str] = (), train: DataFrame | None = None, cells: Sequence[str] = (),
                 interval: Sequence[str] | None = None, corrected: str | None = None, more: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Regression blocks, failures, breakdowns, load share and effects; the baselines with
    ``train`` and ``cells``; the interval table of three quantile columns; the comparison with a
    ``corrected`` prediction (A30); ``more`` takes blocks of fitted models as importance (M10) and group diagnosis (M12)."""
    t = written(scored_test)
    worst = reliable_checkpoint(t.orderBy(F.abs(F.col(y_pred) - F.col(y)).desc(), tie).limit(50))
    makers = {
        "core": lambda: M.core_metrics(t, y, y_pred), "deciles": lambda: M.metrics_by_decile(t, y, y_pred, tie),
        "tail": lambda: M.tail_analysis(t, y, y_pred, tie), "load_share": lambda: B.load_share(t, y), "worst": lambda: worst,
        "failures": lambda: worst.agg(F.count_if(F.col(y_pred) < F.col(y)).alias("under"), F.count_if(F.col(y_pred) > F.col(y)).alias("over"),
                                      F.avg(y).alias("mean_actual_days"), F.avg(y_pred).alias("mean_predicted_days"), F.min(y).alias("min_actual_days"), F.max(y).alias("max_actual_days"))}
    for lv in levels:
        makers[f"by_{lv}"] = lambda lv=lv: B.breakdown(t, lv, y)
        makers[f"metrics_by_{lv}"] = lambda lv=lv: M.metrics_by_group(t, y, y_pred, lv)
    if flag and controls:
        makers["controlled_effect"] = lambda: B.controlled_effect(t, flag, list(controls), y)
    if train is not None and cells:
        makers["baselines"] = lambda: baselines_report(train, t, y, y_pred, tie, cells)
    if interval:
        makers["interval"] = lambda: M.interval_calibration(t, y, *interval)
    if corrected:
        makers["smearing"] = lambda: M.smearing_comparison(t, y, y_pred, corrected, tie)
    return _side_by_side(makers) | dict(more or {})


def _stat_rows(finding: str, row: DataFrame, stats: Sequence[str]) -> DataFrame:
    """A one-row block as (finding, level, stat, value) rows; level is null."""
    pairs = [x for s in stats for x in (F.lit(s), F.col(s).cast("double"))]
    return row.select(F.lit(finding).alias("finding"), F.lit(None).cast("string").alias("level"), F.explode(F.create_map(*pairs)).alias("stat", "value"))


def findings(stays: DataFrame, flag: str, levels: Mapping[str, str], controls: Sequence[str], y: str = "duration_days",
             y_pred: str = "y_pred", score: str = "score", label: str = "is_long") -> DataFrame:
    """The numbers behind every finding as (finding, level, stat, value) rows: who consumes the
    load; the flag's raw and controlled effect; when the flag appears; how well duration is predicted;
    and for each breakdown in ``levels`` (finding -> column) the figures of all its levels."""
    t = reliable_checkpoint(stays)
    fixed = [_stat_rows("load_share", B.load_share(t, y), [
                 "quick_exit_share_of_entities", "quick_exit_share_of_entity_days", "long_stay_share_of_entities",
                 "long_stay_share_of_entity_days", "long_stay_mean_days"]),
             _stat_rows("flag_effect", B.controlled_effect(t, flag, controls, y), [
                 "raw_difference_pp", "controlled_difference_pp", "ci95_low_pp", "ci95_high_pp"]),
             _stat_rows("flag_timing", B.flag_timing_summary(t, flag, y), ["flag_rate_among_long", "flag_rate_among_rest"]),
             _stat_rows("duration", M.core_metrics(t, y, y_pred), ["mae_days", "r2"]),
             _stat_rows("risk", M.classifier_metrics(t, score, label), ["pr_auc", "pr_auc_lift"])]
    for finding, column in levels.items():
        pairs = [x for s in ("n", "median_days", "long_stay_rate") for x in (F.lit(s), F.col(s).cast("double"))]
        fixed.append(B.breakdown(t, column, y).select(F.lit(finding).alias("finding"), F.col("value").alias("level"),
                                                      F.explode(F.create_map(*pairs)).alias("stat", "value")))
    return reduce(DataFrame.unionByName, fixed)
