"""Model queries on the driver tables (no SQL oracle: tree models are checked by
row counts and the property tests).

Features of a stay: numeric ``o_totalprice`` and ``c_acctbal``; levels
``o_orderpriority``, ``o_orderstatus``, ``c_mktsegment``, ``start_month``,
``start_day_of_week``, ``start_season``; boolean ``is_urgent``.  Target
``duration_days`` / ``is_long``; split train <= 1999, validation 2000, test 2001+.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import enrich
from ..models import explain
from ..models.boosting import TreeParams
from ..models.features import FeatureSpec
from ..models.isotonic import fit_isotonic
from ..models.train import (Bundle, days_head, fit_bundle, fit_global_median, predict_days, predict_group_median, predict_probability,
                            predict_quantiles, predict_raw)
from ..operators import metrics as M
from ..operators import split
from ..operators.breakdown import _one_row
from ..session import reliable_checkpoint
from ..sources.tables import table
from ..streaming.score import score_batch
from . import stays as S

SPEC = FeatureSpec(
    numeric=["o_totalprice", "c_acctbal"],
    categorical=["o_orderpriority", "o_orderstatus", "c_mktsegment", "start_month", "start_day_of_week",
                 "start_season"],
    boolean=["is_urgent"],
    forbidden=["end_ts", "duration_days", "next_end_ts"])
PARAMS = TreeParams()

S_DATES = (S.TRAIN_END, S.VAL_START, S.VAL_END, S.TEST_START)
PASS = ["seq", "key", "duration_days", "is_long", "split"]


def model_frame(spark: SparkSession, root: str) -> DataFrame:
    """The features, the targets and the period of every stay; projected before it is written, as the
    fits and the evaluation read it several times."""
    c = table(spark, root, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment", "c_acctbal")
    s = S.stays(spark, root).join(c, "key", "left")
    s = s.withColumns({"start_month": F.month("start_ts"), "start_day_of_week": X.weekday_of("start_ts"),
                       "start_season": X.season(F.month("start_ts")),
                       "is_urgent": X.starts_with_ci("o_orderpriority", "1")})
    s = split.temporal_split(s, "start_ts", *S_DATES)
    return reliable_checkpoint(s.select(*PASS, *SPEC.allowed))


def period(df: DataFrame, name: str) -> DataFrame:
    return df.where(F.col("split") == name)


def fitted(spark: SparkSession, root: str, params: TreeParams = PARAMS, which=("classifier", "days", "quantiles"), more=()) -> tuple[DataFrame, Bundle]:
    df = model_frame(spark, root)
    return df, fit_bundle(period(df, "train"), "duration_days", "is_long", SPEC, params, which, more)


def q_model_scores(spark, root):
    """R1 + J9 on the test period: raw orders are enriched, scored (probability, band, day estimate with its
    caveat, 10-90 band), explained and ranked by risk; each result carries its raw record."""
    df, b = fitted(spark, root)
    valid = predict_raw(period(df, "validation"), b, {"classifier": "probability", "days": "days"}, PASS)
    valid = reliable_checkpoint(valid.select("c_mktsegment", "probability", "days", "is_long", "duration_days"))
    rel = M.group_reliability(M.classifier_by_group(valid, "c_mktsegment", "probability", "is_long"))
    b.r2 = M.core_metrics(valid, "duration_days", "days").first()["r2"]
    raw = period(df, "test").select("seq").join(table(spark, root, "orders"), F.col("seq") == F.col("o_orderkey"))
    raw = raw.withColumn("input", F.to_json(F.struct(*[c for c in raw.columns if c.startswith("o_")])))
    starts = raw.join(table(spark, root, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("o_custkey") == F.col("c_custkey"), "left")
    starts = enrich(starts, "o_orderdate").withColumn("is_urgent", X.starts_with_ci("o_orderpriority", "1"))
    incoming = starts.select("seq", "input", *SPEC.allowed)
    out = score_batch(incoming, b, "seq", ["input"], "c_mktsegment", rel)
    return out.withColumn("drivers", F.to_json("drivers"))


def q_model_classifier_metrics(spark, root):
    """M7 + A26 + A25 on the test period, with isotonic calibration (M8) fitted
    on validation and both Brier scores."""
    df, b = fitted(spark, root, which=("classifier",))
    scored = reliable_checkpoint(predict_probability(df, b, PASS).select("split", "probability", "is_long"))
    iso = fit_isotonic(period(scored, "validation"), "probability", "is_long")
    test = iso.calibrate(period(scored, "test"), "probability")
    raw = M.classifier_metrics(test, "probability", "is_long")
    cal = M.classifier_metrics(test, "calibrated", "is_long").select(F.col("brier_score").alias("brier_calibrated"))
    op = M.operating_points(test, "probability", "is_long", [0.1]).select("precision", "recall", "flagged_rate")
    return _one_row(raw, cal, op)


def q_model_quantiles(spark, root):
    """M6 + A16: interval calibration of the quantile heads on test, as fitted (crossings counted)."""
    df, b = fitted(spark, root, which=("quantiles",))
    q = predict_quantiles(period(df, "test"), b, PASS, ordered=False)
    return M.interval_calibration(q, "duration_days", "p10_days", "p50_days", "p90_days")


def q_model_importance(spark, root):
    """M10 for the classifier on test."""
    df, b = fitted(spark, root, which=("classifier",))
    return explain.permutation_importance(period(df, "test"), b.models["classifier"], SPEC.allowed, "seq", "is_long", "ap", seed=7)


def q_model_ablation(spark, root):
    """With vs without the order-status feature."""
    df = model_frame(spark, root)
    return explain.ablation(period(df, "train"), period(df, "test").select("seq", "is_long", *SPEC.allowed), SPEC, ["o_orderstatus"], "is_long", "seq", PARAMS)


def q_model_regression(spark, root):
    """M5 + A11 + baselines (M3): the trees against the global and cell medians."""
    df, b = fitted(spark, root, which=("days",))
    train, test = period(df, "train"), period(df, "test")
    x = predict_days(test, b, PASS, out="tree_days").withColumn("median_days", F.lit(fit_global_median(train, "duration_days")))
    x = predict_group_median(x, train, ["o_orderpriority"], "duration_days", "cell_days")
    return M.compare_variants(x.select("duration_days", "seq", "tree_days", "median_days", "cell_days"), "duration_days",
                              ["tree_days", "median_days", "cell_days"], "seq")


def q_model_smearing(spark, root):
    """M4 + A29 + A30: squared-loss trees on log1p(days); Duan smearing factor fitted
    on validation; before / after metrics, rank preservation, Spearman, decile
    identity and clipping counts on test."""
    df, b = fitted(spark, root, which=(), more=[days_head("duration_days", "log1p", "log")])
    scored = reliable_checkpoint(predict_raw(df, b, {"log": "f"}, PASS).select("split", "seq", "duration_days", "f"))
    sm = M.fit_smearing(period(scored, "validation"), "duration_days", "f", "log1p")
    s_factor = sm.select("smearing_factor").scalar()
    test = period(scored, "test").withColumns({"before": X.clip_days(F.expm1("f")), "after": X.clip_days(F.exp("f") * s_factor - 1)})
    test = reliable_checkpoint(test.select("seq", "duration_days", "before", "after"))
    return _one_row(sm, M.smearing_comparison(test, "duration_days", "before", "after", "seq"))


def q_model_diagnose(spark, root):
    """M12 for every market segment: the general model on the segment, a segment's own model where it has
    enough training data, importance inside the segment and the contrast of its levels."""
    df = model_frame(spark, root)
    out = explain.diagnose_groups(period(df, "train"), period(df, "test").select("seq", "is_long", "duration_days", *SPEC.allowed), "c_mktsegment",
                                  PARAMS, SPEC, "is_long", "duration_days", "seq", PARAMS, min_n=20)
    return out.withColumns({"importance": F.to_json("importance"), "contrast": F.to_json("contrast")})


MODEL_QUERIES = {
    "model_smearing": q_model_smearing,
    "model_diagnose": q_model_diagnose,
    "model_scores": q_model_scores,
    "model_classifier_metrics": q_model_classifier_metrics,
    "model_quantiles": q_model_quantiles,
    "model_importance": q_model_importance,
    "model_ablation": q_model_ablation,
    "model_regression": q_model_regression,
}
