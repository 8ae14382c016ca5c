"""Feature specification, level folding (M1), imputation (M2) and the gate before a model.

Categorical columns keep their ``cap`` most frequent training levels (ties by
value); null becomes ``Missing`` and unseen levels ``Other``, so a column has at
most ``cap + 2`` values, which is a byte at the default.  The level table is
a bounded model parameter (``cap`` rows per column), like a StringIndexer's
vocabulary.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.gates import check_columns

MISSING, OTHER = "Missing", "Other"
CAP = 254


@dataclass(frozen=True)
class FeatureSpec:
    numeric: Sequence[str]
    categorical: Sequence[str]
    boolean: Sequence[str] = ()
    forbidden: Sequence[str] = ()
    cap: int = CAP

    @property
    def allowed(self) -> list[str]:
        return [*self.numeric, *self.categorical, *self.boolean]

    @property
    def level_columns(self) -> list[str]:
        return [*self.categorical, *self.boolean]


@dataclass
class FoldedLevels:
    levels: dict[str, list[str]] = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        cols = {}
        for c, keep in self.levels.items():
            text = F.col(c).cast("string")
            cols[f"{c}__lv"] = (F.when(text.isNull(), F.lit(MISSING))
                                .when(text.isin(keep), text).otherwise(F.lit(OTHER)))
        return df.withColumns(cols)


def fit_levels(train: DataFrame, columns: Sequence[str], cap: int = CAP, min_rows: int = 1) -> FoldedLevels:
    """M1: top ``cap`` levels per column by training frequency, one aggregation
    over the unpivoted columns (partial aggregation handles hot levels).  M2: levels
    of fewer than ``min_rows`` training rows are infrequent and fold to ``Other``."""
    long = (train.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], list(columns), "column", "value").where(F.col("value").isNotNull()))
    counts = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_rows)
    rk = F.row_number().over(Window.partitionBy("column").orderBy(F.col("n").desc(), "value"))
    top = counts.withColumn("_rk", rk).where(F.col("_rk") <= cap)
    out: dict[str, list[str]] = {c: [] for c in columns}
    for r in top.select("column", "value").collect():  # <= cap rows per column
        out[r["column"]].append(r["value"])
    return FoldedLevels(out)


def impute(df: DataFrame, train: DataFrame, spec: FeatureSpec, levels: FoldedLevels) -> DataFrame:
    """M2: numbers by the exact training median beside a ``<column>__na`` indicator, levels by the
    constant ``Missing`` (infrequent ones fold by M1's table) as ``<column>__lv``, booleans by the most
    frequent training value.  The fill values are one row of statistics."""
    from .train import fit_reference_row
    fill = fit_reference_row(train, FeatureSpec(spec.numeric, (), spec.boolean))
    cols = {f"{c}__na": F.col(c).isNull() for c in spec.numeric}
    cols |= {c: F.coalesce(F.col(c).cast("double"), F.lit(fill[c])) for c in spec.numeric}
    cols |= {c: F.coalesce(F.col(c), F.lit(fill[c])) for c in spec.boolean}
    return levels.transform(df.withColumns(cols))


def features_of(df: DataFrame, spec: FeatureSpec, passthrough: Sequence[str] = ()) -> DataFrame:
    """P7 on the incoming frame, before any projection: a forbidden column stops the run unless it is
    passed through by name, then a column that is neither a feature nor passed through, then a missing feature."""
    carried = [c for c in passthrough if c not in spec.allowed]
    check_columns([c for c in df.columns if c not in carried], spec.allowed, spec.forbidden, required=spec.allowed)
    return df.select(*carried, *spec.allowed)
