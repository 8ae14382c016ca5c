"""Permutation importance (M10), counterfactual drivers (M11, J7, T4),
group diagnosis (M12) and feature ablation (M13).

What a model answers when one feature of a row is changed is found for all features in one pass over
the row: a fixed score gives one column expression a feature, a boosted model one Arrow function that
walks the trees with one column of codes replaced.  Rows are never copied once a feature."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import breakdown as B
from ..operators import metrics as M
from ..operators import ranking
from ..session import reliable_checkpoint
from .boosting import Boosted, Spot, TreeParams, fit_heads, leaves_of, predict, reach
from .features import FeatureSpec, features_of
from .train import Bundle, classifier_head

#: Rows that one task answers for, about.
ANSWER_ROWS = 50_000
#: A fixed score: the answer as an expression of the features, which come as columns by name.
Score = Callable[[dict[str, Column]], Column]


def changed_raws(model: Boosted, codes: np.ndarray, others: np.ndarray, numbers: Sequence[int]) -> list[np.ndarray]:
    """The raw answers of ``codes`` (a line a feature), then for each feature of ``numbers`` those with its line taken
    from ``others``.  Only rows that a cut of the feature sends to its other side are followed to a new leaf."""
    n = codes.shape[1]
    at_tree = []
    for t in model.trees:
        at_tree.append(np.zeros(n))
        for leaf, spot in reach(t, leaves_of(t), codes, Spot(np.arange(n))).items():
            at_tree[-1][spot.rows] += t[3][leaf]
    raw = model.start + sum(at_tree, np.zeros(n))
    out = [raw.copy() for _ in numbers]
    for (feature, goes_left, child, value), old in zip(model.trees, at_tree):
        inner = child[:, 0] != np.arange(len(feature))
        below = [set() for _ in feature]  # the features that a node and those under it cut by
        for node in range(len(feature) - 1, -1, -1):  # children come behind their parents
            if inner[node]:
                below[node] = {int(feature[node])} | below[child[node, 0]] | below[child[node, 1]]
        root = Spot(np.arange(n))
        for j, new in zip(numbers, out):
            todo = [(0, root, False)] if j in below[0] else []
            while todo:
                node, spot, moved = todo.pop()
                rows, cut = spot.rows, feature[node]
                if not len(rows):
                    continue
                if not inner[node]:  # only moved rows come here
                    new[rows] += value[node] - old[rows]
                elif cut == j:
                    to = goes_left[node].take(others[j].take(rows))
                    stays = np.ones(len(rows), dtype=bool) if moved else goes_left[node].take(codes[j].take(rows)) == to
                    for side, here in ((child[node, 1], to), (child[node, 0], ~to)):
                        if moved or j in below[side]:
                            todo.append((side, Spot(rows.compress(here & stays)), moved))
                        if not moved:
                            todo.append((side, Spot(rows.compress(here & ~stays)), True))
                else:
                    if node not in spot.cuts:  # features that share the way down share its cuts
                        to = goes_left[node].take(codes[cut].take(rows))
                        spot.cuts[node] = Spot(rows.compress(to)), Spot(rows.compress(~to))
                    todo += [(side, one, moved) for side, one in zip((child[node, 1], child[node, 0]), spot.cuts[node]) if moved or j in below[side]]
    return [raw, *out]


def changed_answers(score: Score | Boosted, features: Sequence[str], now: dict[str, Column], other: dict[str, Column]) -> Column:
    """array<double>: the answer for ``now``, then for each feature that with the feature taken from ``other``."""
    if not isinstance(score, Boosted):
        return F.array(score(now), *[score(now | {f: other[f]}) for f in features])
    binner, model = score.binner, score
    numbers = [binner.spec.allowed.index(f) for f in features]
    kinds = {c: "string" if c in binner.levels else "double" for c in binner.spec.allowed}

    @F.pandas_udf("array<double>")
    def answers(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        width = len(binner.spec.allowed)
        for series in batches:
            codes, others = (np.ascontiguousarray(binner.encode(x).T) for x in (series[:width], series[width:]))
            yield pd.Series(list(np.column_stack([model.link(x) for x in changed_raws(model, codes, others, numbers)])))

    cast = lambda cols: [cols[c].cast(kinds[c]) for c in binner.spec.allowed]
    return answers(*cast(now), *cast(now | other))


def drivers(df: DataFrame, score: Score | Boosted, features: Sequence[str], reference: dict, k: int = 6, min_pp: float = 0.05, out: str = "drivers", digits: int = 2) -> DataFrame:
    """``df`` with, per row, the answer minus that with one feature at the reference row's value, in
    percentage points; |effect| < ``min_pp`` dropped, rounded to ``digits``, the ``k`` largest by |effect|.  No
    exchange and no copy of a row."""
    now = {c: F.col(c) for c in (score.binner.spec.allowed if isinstance(score, Boosted) else features)}
    other = {c: F.lit(reference.get(c)).cast(df.schema[c].dataType) for c in features}
    x = df.withColumn("_a", changed_answers(score, features, now, other))
    effects = F.array(*[F.struct(F.lit(f).alias("feature"), F.round((F.col("_a")[0] - F.col("_a")[i + 1]) * 100, digits).alias("effect_pp")) for i, f in enumerate(features)])
    kept = F.filter(effects, lambda s: F.abs(s["effect_pp"]) >= F.lit(min_pp))
    ordered = F.array_sort(kept, lambda a, b: F.when(F.abs(a["effect_pp"]) > F.abs(b["effect_pp"]), -1)
                           .when(F.abs(a["effect_pp"]) < F.abs(b["effect_pp"]), 1)
                           .otherwise(F.when(a["feature"] < b["feature"], -1)
                                      .when(a["feature"] > b["feature"], 1).otherwise(0)))
    return x.withColumn(out, F.slice(ordered, 1, k)).drop("_a")


# ---------------------------------------------------------------------------
# Permutation importance
# ---------------------------------------------------------------------------

def donor_map(n: int, repeat: int, seed: int) -> tuple[int, int]:
    """(a, b) of the one-to-one map r -> (a r + b) mod n of the ranks 0..n-1 for a repeat: a is the first
    number without a common factor with n from a golden-ratio multiple on, b follows from both keys."""
    key = repeat + 1 + seed * 131
    a = max(1, (key * 618_033_988_749 % 1_000_000_000_000) * n // 1_000_000_000_000)
    while gcd(a, n) != 1:
        a += 1
    return a, key * 7919 % n


def permuted_answers(df: DataFrame, score: Score | Boosted, features: Sequence[str], id_col: str, y: str, repeats: int = 10, seed: int = 0) -> DataFrame:
    """(repeat, y, answers): for every row and repeat the unchanged answer, then that with each feature
    taken from the row's donor.  Rows are ranked once, by the MD5 of their id; a donor's rank is a one-to-one
    map of the rank, and the map's inverse tells a donor which row it serves, so one join by rank serves
    all repeats."""
    if repeats < 1:
        raise ValueError("repeats must be at least 1")
    every = list(score.binner.spec.allowed) if isinstance(score, Boosted) else list(features)
    base = df.select(id_col, y, *every)
    ranked = ranking.global_row_number(base.withColumn("_h", F.md5(F.col(id_col).cast("string"))), ["_h", id_col], "_r", total="_n")
    ranked = ranked.withColumn("_r", F.col("_r") - 1)
    n = ranked.agg(F.max("_n")).first()[0] or 0
    if not n:
        return base.select(F.lit(0).alias("repeat"), y, F.array(F.lit(0.0)).alias("answers")).where("false")
    wide = lambda x: F.lit(x).cast("decimal(38,0)")  # noqa: E731  (a r may pass 64 bits)
    serves = []
    for k in range(repeats):
        a, b = donor_map(n, k, seed)
        serves.append(F.struct(F.lit(k).alias("repeat"), F.pmod((F.col("_r").cast("decimal(19,0)") - F.lit(b).cast("decimal(19,0)")) * F.lit(pow(a, -1, n) if n > 1 else 0).cast("decimal(18,0)"), wide(n)).cast("long").alias("_to")))
    donors = ranked.select(F.explode(F.array(*serves)).alias("_s"), *[F.col(c).alias(f"_d_{c}") for c in features])
    donors = donors.select("_s.repeat", F.col("_s._to").alias("_r"), *[f"_d_{c}" for c in features])
    met = ranked.select("_r", y, *every).join(donors, "_r")
    if isinstance(score, Boosted):  # few bytes, but each row walks all trees: dealt by rows to all cores
        met = met.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-n * repeats // ANSWER_ROWS)), "repeat", "_r")
    answers = changed_answers(score, features, {c: F.col(c) for c in every}, {c: F.col(f"_d_{c}") for c in features})
    return met.select("repeat", y, answers.alias("answers"))


def permutation_importance(df: DataFrame, score: Score | Boosted, features: Sequence[str], id_col: str, y: str, metric: str = "mae",
                           repeats: int = 10, seed: int = 0, answer: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """Rise of the mean absolute error (``mae``) or drop of the average precision (``ap``) when one
    feature is shuffled; mean and population std over ``repeats``.  ``answer`` turns a model's raw answer
    into what the metric compares, as days."""
    x = permuted_answers(df, score, features, id_col, y, repeats, seed)
    if metric == "mae":
        error = lambda i: F.avg(F.abs(answer(F.col("answers")[i]) - F.col(y)))
        per = x.groupBy("repeat").agg(*[(error(i + 1) - error(0)).alias(f) for i, f in enumerate(features)])
        imp = per.unpivot(["repeat"], list(features), "feature", "_imp")
    else:
        # an answer's index and repeat name its curve; equal answers of a curve are one row before the sort
        long = x.select("repeat", y, F.posexplode("answers").alias("_i", "_s")).where((F.col("_i") > 0) | (F.col("repeat") == 0))
        per = M.classifier_by_group(long.withColumn("_g", F.struct("_i", "repeat")), "_g", "_s", y, min_n=1, min_pos=1)
        per = reliable_checkpoint(per.select("group._i", F.col("pr_auc").alias("_ap")))
        names = F.array(*[F.lit(f) for f in features])
        imp = B._attach(per.where("_i > 0"), per.where("_i = 0").select(F.col("_ap").alias("_base")))
        imp = imp.select(names[F.col("_i") - 1].alias("feature"), (F.col("_base") - F.col("_ap")).alias("_imp"))
    return imp.groupBy("feature").agg(F.avg("_imp").alias("importance_mean"),
                                      F.stddev_pop("_imp").alias("importance_std"),
                                      F.count(F.lit(1)).alias("repeats"))


# ---------------------------------------------------------------------------
# M12, M13
# ---------------------------------------------------------------------------

def ablation(train: DataFrame, test: DataFrame, spec: FeatureSpec, without: Sequence[str], label: str, id_col: str, params: TreeParams,
             threshold: float = 0.1) -> DataFrame:
    """The same classifier with (a) and without (b) some features, as two heads of one fit; A26 + A25
    for each and the relative change of average precision (b vs a)."""
    left = [c for c in spec.allowed if c not in set(without)]
    models = fit_heads(train, spec, [classifier_head(label, "a"), classifier_head(label, "b", features=left)], params)
    scored = reliable_checkpoint(predict(features_of(test, spec, [id_col, label]), models).select("a", "b", label))
    out = []
    for name in ("a", "b"):
        op = M.operating_points(scored, name, label, [threshold]).select("precision", "recall", "flagged")
        out.append(B._one_row(M.classifier_metrics(scored, name, label), op).withColumn("variant", F.lit(name)))
    res = out[0].unionByName(out[1])
    a_ap = F.max(F.when(F.col("variant") == "a", F.col("pr_auc"))).over(Window.partitionBy())  # two rows
    return res.withColumn("relative_ap_change", (F.col("pr_auc") - a_ap) / a_ap)


def diagnose_groups(train: DataFrame, test: DataFrame, group_col: str, bundle_or_params: Bundle | TreeParams, spec: FeatureSpec, label: str, y: str, id_col: str,
                    params: TreeParams = TreeParams(), min_train: int = 500, min_pos: int = 30, helps: float = 0.20, min_lift: float = 2.0,
                    repeats: int = 10, min_n: int = 100, threshold: float = 90.0) -> DataFrame:
    """M12, a row for every group of ``test``: the general model on the group; a model of the group's own rows
    where it has more than ``min_train`` of them and ``min_pos`` positives, its average precision,
    relative improvement and importance (``importance``: feature, mean, std; largest first); the contrast of the
    features' levels inside the group (``contrast``: A18 by spread).  The general model and those of all
    groups are heads of one fit and answer in one pass."""
    counts = train.where(F.col(group_col).isNotNull()).groupBy(group_col).agg(F.count(F.lit(1)).alias("train_n"), F.sum(F.col(label).cast("long")).alias("train_pos"))
    rows = counts.collect()  # one row a group, a model each
    own = sorted(r[group_col] for r in rows if r["train_n"] > min_train and (r["train_pos"] or 0) > min_pos)
    heads = [classifier_head(label, f"own_{i}", F.col(group_col) == g) for i, g in enumerate(own)]
    general = bundle_or_params.models.get("classifier") if isinstance(bundle_or_params, Bundle) else None
    models = fit_heads(train, spec, heads + ([] if general else [classifier_head(label, "general")]), params)
    if general:
        models["general"] = general
    x = predict(features_of(test, spec, [id_col, label, y, group_col]), models)
    own_score = F.coalesce(*[F.when(F.col(group_col) == g, F.col(f"own_{i}")) for i, g in enumerate(own)], F.lit(None).cast("double"))
    scored = reliable_checkpoint(x.withColumn("own", own_score).drop(*[f"own_{i}" for i in range(len(own))]).where(F.col(group_col).isNotNull()))
    by = lambda s, df: M.classifier_by_group(df, group_col, s, label, min_n=1, min_pos=1)
    out = by("general", scored).select(F.col("group"), "n", F.col("pr_auc").alias("general_pr_auc"), F.col("pr_auc_lift").alias("general_lift"))
    if own:
        mine = by("own", scored.where("own IS NOT NULL")).select("group", F.col("pr_auc").alias("group_model_pr_auc"))
        out = out.join(mine, "group", "left")
    else:
        out = out.withColumn("group_model_pr_auc", F.lit(None).cast("double"))
    weights = None
    for i, g in enumerate(own):
        part = permutation_importance(scored.where(F.col(group_col) == g), models[f"own_{i}"], spec.allowed, id_col, label, "ap", repeats, seed=i)
        part = part.select(F.lit(g).alias("group"), F.struct((-F.col("importance_mean")).alias("m"), "feature", F.col("importance_std").alias("std")).alias("s"))
        weights = part if weights is None else weights.unionByName(part)
    if weights is not None:
        listed = weights.groupBy("group").agg(F.sort_array(F.collect_list("s")).alias("l"))  # a row a feature
        listed = listed.select("group", F.transform("l", lambda s: F.struct(s["feature"].alias("feature"), (-s["m"]).alias("pr_auc_drop"), s["std"].alias("std"))).alias("importance"))
        out = out.join(listed, "group", "left")
    contrast = B.contrast_by_group(test, group_col, spec.level_columns, y, min_n, threshold)
    out = out.join(contrast, "group", "left")
    rel = (F.col("group_model_pr_auc") - F.col("general_pr_auc")) / F.nullif(F.col("general_pr_auc"), F.lit(0.0))
    return out.withColumns({"relative_improvement": rel, "group_model_helps": F.coalesce(rel >= F.lit(helps), F.lit(False)),
                            "reliable": F.col("general_lift") >= F.lit(min_lift)})
