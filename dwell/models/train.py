"""Model operators (M3-M9, A8-A10): baselines, boosted duration and risk models, back-transforms.

* baselines: global median, cell median with global fallback, positive rate;
* duration: boosted trees with squared loss on ``log1p(y)`` (M4) or absolute loss on raw days (M5);
* quantiles (M6): boosted trees with the pinball loss on ``log1p(y)``, one head each;
* classifier (M7): boosted trees with the log loss on ``y >= threshold``;
* isotonic calibration (M8): see :mod:`.isotonic`.

All models of a bundle are heads of one fit (:func:`.boosting.fit_heads`) and answer in one pass.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import age_band, clip_days
from ..operators import lookup, ranking
from ..operators.breakdown import _attach, unpivot_levels
from .boosting import Binner, Boosted, Head, TreeParams, fit_heads, predict
from .features import CAP, FeatureSpec, features_of, fit_levels

QUANTILES = {"p10_days": 0.1, "p50_days": 0.5, "p90_days": 0.9}


# ---------------------------------------------------------------------------
# baselines
# ---------------------------------------------------------------------------

def fit_global_median(train: DataFrame, y: str) -> float:
    """A fitted constant (one aggregated scalar)."""
    return float(ranking.group_quantiles(train, y, [0.5], ["m"]).first()[0])


def fit_positive_rate(train: DataFrame, label: str) -> float:
    """A9."""
    return float(train.agg(F.avg(F.col(label).cast("double"))).first()[0])


def predict_group_median(df: DataFrame, train: DataFrame, keys: list[str], y: str, out: str) -> DataFrame:
    """M3 / A7 + J4: cell median of ``keys`` on train, unseen cell -> global median, clipped."""
    cells = lookup.group_median_table(train, keys, y)
    glob = ranking.group_quantiles(train, y, [0.5], ["_g"])
    return lookup.lookup_with_fallback(_attach(df, glob), cells, keys, "cell_median", F.col("_g"), out).drop("_g")


def with_age_band(df: DataFrame, age_col: str, out: str = "age_band") -> DataFrame:
    return df.withColumn(out, age_band(age_col))


# ---------------------------------------------------------------------------
# bundle
# ---------------------------------------------------------------------------

@dataclass
class Bundle:
    """Fitted models by name, all over the features of ``spec``; ``r2`` is that of the day estimate on the
    rows it was last evaluated on."""

    spec: FeatureSpec
    models: dict[str, Boosted] = field(default_factory=dict)
    reference_row: dict | None = None
    r2: float | None = None

    @property
    def binner(self) -> Binner:
        return next(iter(self.models.values())).binner


def classifier_head(label: str, name: str = "classifier", where: Column | None = None, features: Sequence[str] | None = None) -> Head:
    """M7 on the rows of ``where``."""
    target = F.col(label)
    return Head(name, target if where is None else F.when(where, target), "log_loss", features=features)


def days_head(y: str, loss: str, name: str = "days") -> Head:
    """M4 (``loss='log1p'``: squared error on log1p(y)) or M5 (``'absolute'`` on raw y)."""
    return Head(name, F.log1p(F.col(y)), "squared") if loss == "log1p" else Head(name, F.col(y), "absolute")


def quantile_heads(y: str) -> list[Head]:
    """M6: quantiles survive the log transform, so they are fitted on log1p(y) like the mean."""
    return [Head(name, F.log1p(F.col(y)), "quantile", q) for name, q in QUANTILES.items()]


def fit_bundle(train: DataFrame, y: str, label: str, spec: FeatureSpec, params: TreeParams = TreeParams(),
               which: Sequence[str] = ("classifier", "days", "quantiles"), more: Sequence[Head] = ()) -> Bundle:
    """The named models (and ``more`` heads) in one fit, and the reference row."""
    heads = list(more)
    if "classifier" in which:
        heads.append(classifier_head(label))
    if "days" in which:
        heads.append(days_head(y, "absolute"))
    if "quantiles" in which:
        heads += quantile_heads(y)
    return Bundle(spec, fit_heads(train, spec, heads, params), fit_reference_row(train, spec))


# ---------------------------------------------------------------------------
# answers (M9)
# ---------------------------------------------------------------------------

def back_transform(f: Column, loss: str, smearing: float | None = None) -> Column:
    """days from a model's raw value; a log model's mean is corrected by its smearing factor."""
    if loss != "log1p":
        return f
    return F.exp(f) * F.lit(smearing) - 1 if smearing else F.expm1(f)


def predict_raw(df: DataFrame, bundle: Bundle, outputs: dict[str, str], passthrough: Sequence[str] = ()) -> DataFrame:
    """Behind the gate (P7), a column ``outputs[name]`` for each model ``name``, in one pass."""
    x = features_of(df, bundle.spec, passthrough)
    return predict(x, {out: bundle.models[name] for name, out in outputs.items()})


def predict_probability(df: DataFrame, bundle: Bundle, passthrough: Sequence[str] = (), model: str = "classifier", out: str = "probability") -> DataFrame:
    return predict_raw(df, bundle, {model: out}, passthrough)


def predict_days(df: DataFrame, bundle: Bundle, passthrough: Sequence[str] = (), model: str = "days", loss: str = "absolute",
                 out: str = "estimated_days", smearing: float | None = None) -> DataFrame:
    """Back-transformed and clipped to the range of durations."""
    x = predict_raw(df, bundle, {model: out}, passthrough)
    return x.withColumn(out, clip_days(back_transform(F.col(out), loss, smearing)))


def in_days(x: DataFrame, ordered: bool = True) -> DataFrame:
    """The quantile columns of ``x`` in days.  Separate fits may cross; ``ordered`` puts each row's
    three answers in order."""
    names = list(QUANTILES)
    if ordered:
        x = x.withColumn("_q", F.array_sort(F.array(*names))).withColumns({n: F.col("_q")[i] for i, n in enumerate(names)}).drop("_q")
    return x.withColumns({n: clip_days(F.expm1(F.col(n))) for n in names})


def predict_quantiles(df: DataFrame, bundle: Bundle, passthrough: Sequence[str] = (), ordered: bool = True) -> DataFrame:
    return in_days(predict_raw(df, bundle, {n: n for n in QUANTILES}, passthrough), ordered)


def fit_reference_row(train: DataFrame, spec: FeatureSpec) -> dict:
    """A10: numeric -> median; other -> most frequent non-null value (smallest on
    ties).  Values are counted first, so no task holds a column's value map; the
    medians of all numeric columns share one sort of counts."""
    row = {}
    if spec.level_columns:
        counts = unpivot_levels(train, spec.level_columns, []).where(F.col("value").isNotNull()).groupBy("column", "value").count()
        best = counts.agg(*[F.min(F.when(F.col("column") == c, F.struct(
            (-F.col("count")).alias("c"), F.col("value").cast(train.schema[c].dataType).alias("v"))))["v"].alias(c) for c in spec.level_columns])
        row = best.first().asDict()
    if spec.numeric:
        long = train.select(*[F.col(c).cast("double").alias(c) for c in spec.numeric]).unpivot([], list(spec.numeric), "column", "value")
        medians = {r["column"]: r["m"] for r in ranking.group_quantiles(long, "value", [0.5], ["m"], ["column"]).collect()}  # one row a column
        row |= {c: medians.get(c) for c in spec.numeric}
    return row


__all__ = ["Bundle", "TreeParams", "FeatureSpec", "fit_bundle", "CAP", "fit_levels"]
