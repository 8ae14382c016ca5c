"""Boosted trees grown best-first on merged gradient histograms (M4-M7).

Every feature is a code of one byte: numbers fall between up to 254 cut values (code 255: missing),
levels have a code each (the folded ones of M1).  A row's gradient and hessian under a head's loss are
summed by (node, feature, code) in each partition, and the partitions' sums are merged, on the driver
where there are few of them, else by ``treeReduce``; one such histogram decides all splits of its node.  Trees grow best-first: the leaf whose
split gains most is split next, up to ``max_leaves``.  Missing numbers go to the side that gains more,
levels are split in the order of their mean gradient.

Jobs, not rows, set the time of a small fit, so a pass serves as much as it can: all heads (models that
share the rows: several losses, quantiles, groups of rows, feature lists) grow in the same passes, and
heads of few rows are boosted whole, each in a task of its own, by the same code, with all values of a leaf at hand; a pass expands every leaf that best-first growth would split as far as known; and the first pass of a tree already
carries the histograms of the last tree's leaves, whose upper splits often hold again.  None of this
changes a split: growth is played again from the root with what is known after each pass.

Absolute and quantile losses set a leaf to the exact quantile of its residuals: brackets of values, at
first the range that the tree's first pass met, are narrowed by merged counts until few enough values lie
in them, which are then collected.

The driver holds histograms (heads x leaves x features x 256) and trees, never rows.  Rows stay in the
partitions as arrays, the codes feature by feature, so that a pass follows only the rows on the way to a
wanted leaf; each round's raw scores are a new cached RDD, checkpointed to the shared
folder every ``CHECKPOINT_ROUNDS`` rounds, so a lost executor repeats at most those.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir, reliable_checkpoint
from .features import MISSING, OTHER, FeatureSpec, FoldedLevels, fit_levels

CODES = 256
GONE = CODES - 1  # the code of a missing number
#: Rows of a partition, of a head that one task fits; rounds between checkpoints; values a leaf's bracket may hold when collected.
PART_ROWS, HELD_ROWS, CHECKPOINT_ROUNDS, BRACKET = 500_000, 1_000_000, 25, 4096
#: Sums of at most so many partitions are merged by the driver itself.
DIRECT_PARTS = 32
#: A level with less support sorts by a mean gradient drawn towards zero.
LEVEL_SUPPORT = 10.0
#: Cells that a bracket of values is cut into.
CELLS = 256
LEAST_HESSIAN = 1e-3
#: Nodes whose best splits are found together.
SIDE_BY_SIDE = 16
#: Gains that differ by less count as equal.
ROUNDING = 1e-9


@dataclass(frozen=True)
class TreeParams:
    """The reference's fixed shape of a fit."""

    max_iter: int = 300
    step_size: float = 0.06
    max_leaves: int = 31
    min_instances: int = 40
    l2: float = 1.0


@dataclass(frozen=True)
class Head:
    """One model of a fit: ``target`` null leaves a row out; ``features`` None takes all of the spec."""

    name: str
    target: Column
    loss: str  # squared | absolute | quantile | log_loss
    quantile: float = 0.5
    features: Sequence[str] | None = None


# ---------------------------------------------------------------------------
# codes of features
# ---------------------------------------------------------------------------

@dataclass
class Binner:
    """Codes of the columns of a spec, in its order; fitted on training rows only."""

    spec: FeatureSpec
    edges: dict[str, list[float]]
    levels: dict[str, list[str]]

    def columns(self) -> list[Column]:
        """The columns as the coder takes them: numbers and booleans as doubles, levels as text."""
        return [F.col(c).cast("string" if c in self.levels else "double").alias(c) for c in self.spec.allowed]

    def encode(self, series: Sequence[pd.Series]) -> np.ndarray:
        out = np.empty((len(series[0]), len(series)), dtype=np.uint8)
        for j, (c, s) in enumerate(zip(self.spec.allowed, series, strict=True)):
            if c in self.levels:
                code = {v: i for i, v in enumerate(self.levels[c])}
                other = code[OTHER]
                out[:, j] = [code[MISSING] if v is None or v != v else code.get(v, other) for v in s.tolist()]
            else:
                x = s.to_numpy(dtype=np.float64, na_value=np.nan)
                out[:, j] = np.where(np.isnan(x), GONE, np.searchsorted(np.asarray(self.edges[c]), x, side="left"))
        return out


def fit_binner(train: DataFrame, spec: FeatureSpec, levels: FoldedLevels | None = None) -> Binner:
    """Cut values at up to 254 approximate quantiles of each number (one aggregate for all), and the
    levels of M1 with Other and Missing."""
    numbers = [*spec.numeric, *spec.boolean]
    edges: dict[str, list[float]] = {}
    if numbers:
        at = F.array(*[F.lit(i / (CODES - 1)) for i in range(1, CODES - 1)])
        cuts = [F.percentile_approx(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")), at, 10_000).alias(c) for c in numbers]
        row = train.agg(*cuts, *[F.max(F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))).alias(f"{c}__max") for c in numbers]).first()
        edges = {c: sorted({float(v) for v in row[c] or [] if v < row[f"{c}__max"]}) for c in numbers}
    kept = (levels or fit_levels(train, list(spec.categorical), spec.cap)).levels if spec.categorical else {}
    return Binner(spec, edges, {c: sorted({*kept[c], OTHER, MISSING}) for c in spec.categorical})


# ---------------------------------------------------------------------------
# trees and models
# ---------------------------------------------------------------------------

@dataclass
class Tree:
    """Nodes as parallel lists; node 0 is the root, a leaf is its own child.  ``goes_left`` has a flag for
    each code of the node's feature."""

    feature: list[int] = field(default_factory=lambda: [0])
    goes_left: list[np.ndarray] = field(default_factory=lambda: [np.ones(CODES, dtype=bool)])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, goes_left: np.ndarray) -> tuple[int, int]:
        a = len(self.feature)
        for _ in range(2):
            n = len(self.feature)
            self.feature.append(0)
            self.goes_left.append(np.ones(CODES, dtype=bool))
            self.left.append(n)
            self.right.append(n)
            self.value.append(0.0)
        self.feature[node], self.goes_left[node], self.left[node], self.right[node] = feature, goes_left, a, a + 1
        return a, a + 1

    def leaves(self) -> list[int]:
        return [i for i in range(len(self.left)) if self.left[i] == i]

    def freeze(self) -> tuple[np.ndarray, ...]:
        """The lists as arrays, and the children of (node, flag) side by side."""
        return (np.array(self.feature), np.array(self.goes_left), np.column_stack((self.right, self.left)), np.array(self.value))


class Spot:
    """Rows that met, and those behind each cut of them, by (feature, flags): [left, right], each once needed."""

    __slots__ = ("rows", "cuts")

    def __init__(self, rows: np.ndarray):
        self.rows, self.cuts = rows, {}


def reach(frozen: tuple[np.ndarray, ...], wanted: Sequence[int], codes: np.ndarray, root: Spot) -> dict[int, Spot]:
    """The rows of ``root`` in each wanted leaf, in their order; ``codes`` has a line a feature.  Branches without
    a wanted leaf are not followed, and cuts that ``root`` knows are not made again."""
    feature, goes_left, child, _ = frozen
    on_way = np.zeros(len(feature), dtype=bool)
    on_way[wanted] = True
    for node in range(len(feature) - 1, -1, -1):  # children come behind their parents
        on_way[node] |= on_way[child[node]].any()
    out, todo = {}, [(0, root)]
    while todo:
        node, spot = todo.pop()
        if child[node, 0] == node:
            out[node] = spot
            continue
        sides, flags = spot.cuts.setdefault((feature[node], goes_left[node].tobytes()), [None, None]), None
        for side, to in enumerate((child[node, 1], child[node, 0])):
            if on_way[to]:
                if sides[side] is None:
                    if flags is None:
                        flags = goes_left[node].take(codes[feature[node]].take(spot.rows))
                    sides[side] = Spot(spot.rows.compress(flags if side == 0 else ~flags))
                todo.append((to, sides[side]))
    return out


def _prune(frozen: tuple[np.ndarray, ...], root: Spot) -> None:
    """Only the cuts of this tree stay known."""
    feature, goes_left, child, _ = frozen
    todo = [(0, root)]
    while todo:
        node, spot = todo.pop()
        key = feature[node], goes_left[node].tobytes()
        spot.cuts = {key: spot.cuts[key]} if child[node, 0] != node and key in spot.cuts else {}
        for sides in spot.cuts.values():
            todo += [(to, one) for to, one in zip((child[node, 1], child[node, 0]), sides) if one is not None]


def leaves_of(frozen: tuple[np.ndarray, ...]) -> np.ndarray:
    return np.flatnonzero(frozen[2][:, 0] == np.arange(len(frozen[0])))


@dataclass
class Boosted:
    """A fitted model: a start value and trees, whose leaf values already hold the step size."""

    binner: Binner
    loss: str
    start: float
    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)

    def raw(self, codes: np.ndarray) -> np.ndarray:
        out, by_feature, rows = np.full(len(codes), self.start), np.ascontiguousarray(codes.T), np.arange(len(codes))
        for t in self.trees:
            for leaf, spot in reach(t, leaves_of(t), by_feature, Spot(rows)).items():
                out[spot.rows] += t[3][leaf]
        return out

    def link(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-raw)) if self.loss == "log_loss" else raw

    def to_json(self) -> str:
        """The model without its binner: one small text."""
        return json.dumps({"loss": self.loss, "start": self.start, "trees": [
            {"feature": t[0].tolist(), "goes_left": [np.packbits(x).tobytes().hex() for x in t[1]], "child": t[2].tolist(), "value": t[3].tolist()} for t in self.trees]})

    @classmethod
    def from_json(cls, text: str, binner: Binner) -> Boosted:
        d = json.loads(text)
        trees = [(np.array(t["feature"]), np.array([np.unpackbits(np.frombuffer(bytes.fromhex(x), np.uint8)).astype(bool) for x in t["goes_left"]]),
                  np.array(t["child"]), np.array(t["value"])) for t in d["trees"]]
        return cls(binner, d["loss"], d["start"], trees)


def predict(df: DataFrame, models: dict[str, Boosted]) -> DataFrame:
    """``df`` with a column for each model's answer (a log-loss model: a probability): one Arrow pass for
    all models, no exchange; also on streams."""
    if not models:
        return df
    binner = next(iter(models.values())).binner

    @F.pandas_udf("array<double>")
    def answers(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for series in batches:
            codes = binner.encode(series)
            yield pd.Series(list(np.column_stack([m.link(m.raw(codes)) for m in models.values()])))

    out = df.withColumn("_answers", answers(*binner.columns()))
    return out.withColumns({name: F.col("_answers")[i] for i, name in enumerate(models)}).drop("_answers")


# ---------------------------------------------------------------------------
# splits
# ---------------------------------------------------------------------------

def _score(g: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return g * g / (h + l2)


def best_split(hist: np.ndarray, categorical: Sequence[bool], allowed: Sequence[int], p: TreeParams) -> tuple[float, int, np.ndarray] | None:
    """(gain, feature, goes_left) of the split that gains most, the first feature on ties; ``hist`` is
    (features, codes, [gradient, hessian, rows]).  Both sides keep ``min_instances`` rows."""
    return best_splits(hist[None], categorical, allowed, p)[0]


def best_splits(hists: np.ndarray, categorical: Sequence[bool], allowed: Sequence[int], p: TreeParams) -> list[tuple[float, int, np.ndarray] | None]:
    """:func:`best_split` of several nodes, side by side."""
    found: list[tuple[float, int, np.ndarray] | None] = [None] * len(hists)
    totals = hists[:, allowed[0]].sum(axis=1)
    nodes = np.flatnonzero(totals[:, 2] >= 2 * p.min_instances)
    if not len(nodes):
        return found
    hists, totals = hists[nodes], totals[nodes]
    wholes = totals[:, 0] * totals[:, 0] / (totals[:, 1] + p.l2)

    def gains(left: np.ndarray, at: np.ndarray | int | None = None, real: np.ndarray | bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The gain of the best cut of each line and its place; ``left`` belongs to all nodes (lines of each) or to
        the node ``at``; cuts that are not ``real`` only fill a line."""
        total, whole = (totals[:, None, None], wholes[:, None, None]) if at is None else (totals[at], wholes[at])
        right = total - left
        fits = (np.minimum(left[..., 2], right[..., 2]) >= p.min_instances) & (np.minimum(left[..., 1], right[..., 1]) >= LEAST_HESSIAN) & real
        gain = np.where(fits, _score(left[..., 0], left[..., 1], p.l2) + _score(right[..., 0], right[..., 1], p.l2) - whole, -np.inf)
        place = np.argmax(gain >= gain.max(axis=-1, keepdims=True) - ROUNDING, axis=-1)  # the first of equal ones, however the sums were merged
        return np.take_along_axis(gain, place[..., None], -1)[..., 0], place

    numbers, levels = [j for j in allowed if not categorical[j]], [j for j in allowed if categorical[j]]
    plain, orders, used = {}, {}, None
    if numbers:
        plain |= {j: (gain, place) for j, gain, place in zip(numbers, *(x.T for x in gains(np.cumsum(hists[:, numbers, :GONE], axis=2)[:, :, :-1])))}
    if levels:  # codes that rows have come first, by their mean gradient; the others only fill a line
        width = 1 + int(np.flatnonzero(hists[:, levels, :, 2].any(axis=(0, 1))).max(initial=0))
        sums = hists[:, levels, :width]
        used = sums[..., 2] > 0
        with np.errstate(divide="ignore", invalid="ignore"):
            order = np.argsort(np.where(used, sums[..., 0] / (sums[..., 1] + LEVEL_SUPPORT), np.inf), axis=-1, kind="stable")
        used = used.sum(axis=-1)
        if width > 1:
            lines = np.take_along_axis(sums, order[..., None], axis=2)
            real = np.arange(width - 1) < used[..., None] - 1
            plain |= {j: (gain, place) for j, gain, place in zip(levels, *(x.T for x in gains(np.cumsum(lines, axis=2)[:, :, :-1], None, real)))}
        orders = {j: order[:, i] for i, j in enumerate(levels)}
        used = dict(zip(levels, used.T))
    codes = np.arange(GONE)
    for i, node in enumerate(nodes):
        best = None

        def consider(j: int, order: np.ndarray, extra_codes: list[int], gain: float, at: int) -> None:
            """The split behind a place of ``order``; the codes in ``extra_codes`` go left as well."""
            nonlocal best
            if gain > (ROUNDING if best is None else best[0] + ROUNDING):
                best = float(gain), j, order, extra_codes, at

        def cuts(j: int, order: np.ndarray, extra: np.ndarray, extra_codes: list[int]) -> None:
            if len(order) > 1:
                consider(j, order, extra_codes, *gains(np.cumsum(hists[i, j, order], axis=0)[:-1] + extra, i))

        for j in allowed:
            if categorical[j]:
                if j in plain and used[j][i] > 1:
                    consider(j, orders[j][i], [], plain[j][0][i], plain[j][1][i])
            else:
                gone = hists[i, j, GONE]
                consider(j, codes, [], plain[j][0][i], plain[j][1][i])  # missing goes right
                if gone[2] > 0:
                    cuts(j, codes, gone, [GONE])  # missing goes left
                    cuts(j, np.array([GONE, *np.flatnonzero(hists[i, j, :GONE, 2] > 0)[:1]]), np.zeros(3), [])  # missing alone
        if best is not None:
            gain, j, order, extra_codes, at = best
            goes_left = np.zeros(CODES, dtype=bool)
            goes_left[order[:at + 1]] = goes_left[extra_codes] = True
            found[node] = gain, j, goes_left
    return found


class Growth:
    """Best-first growth of one tree, played from the root with the histograms known so far.  ``wanted``
    are the leaves of ``tree`` whose histograms are needed next; first, those of the last tree."""

    def __init__(self, allowed: list[int], categorical: list[bool], p: TreeParams, last: Tree | None = None):
        self.allowed, self.categorical, self.p = allowed, categorical, p
        self.tree = last or Tree()
        self.wanted = self.tree.leaves()
        self.pairs: list[tuple[int, int, int]] = []
        self.hist: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[float, int, np.ndarray] | None] = {}

    def take_guess(self, found: np.ndarray) -> None:
        hist = dict(zip(self.wanted, found))
        old = self.tree
        for node in range(len(old.left) - 1, -1, -1):  # children come behind their parents
            if old.left[node] != node:
                hist[node] = hist[old.left[node]] + hist[old.right[node]]
        self.tree, self.hist, self.best = Tree(), {0: hist[0]}, {}
        self._copy(old, 0, 0, hist)

    def _copy(self, old: Tree, a: int, b: int, hist: dict[int, np.ndarray]) -> None:
        """Keep the old splits of node ``a`` as far as they are the best ones again."""
        known, level = {}, [a]
        while level:  # the best splits a level at a time, as far as the old ones hold
            known |= zip(level, self._splits([hist[x] for x in level]))
            level = [y for x in level if self._holds(old, x, known[x]) for y in (old.left[x], old.right[x])]
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            best = self.best[b] = known[a]
            if not self._holds(old, a, best):
                continue
            for x, y in zip((old.left[a], old.right[a]), self.tree.split(b, best[1], best[2])):
                self.hist[y] = hist[x]
                todo.append((x, y))

    @staticmethod
    def _holds(old: Tree, node: int, best: tuple[float, int, np.ndarray] | None) -> bool:
        return old.left[node] != node and best is not None and best[1] == old.feature[node] and np.array_equal(best[2], old.goes_left[node])

    def _splits(self, hists: list[np.ndarray]) -> list[tuple[float, int, np.ndarray] | None]:
        """The best splits of nodes, a bounded number of them side by side."""
        return [x for at in range(0, len(hists), SIDE_BY_SIDE)
                for x in best_splits(np.stack(hists[at:at + SIDE_BY_SIDE]), self.categorical, self.allowed, self.p)]

    def _best(self, node: int) -> tuple[float, int, np.ndarray] | None:
        if node not in self.best:
            self.best[node] = best_split(self.hist[node], self.categorical, self.allowed, self.p)
        return self.best[node]

    def play(self) -> bool:
        """Best-first growth with what is known; True when the tree is settled, else ``wanted`` has the
        smaller children of all leaves that it would split."""
        heap: list[tuple[float, int]] = []
        chosen: list[int] = []
        pending: list[int] = []

        def offer(node: int) -> None:
            if (best := self._best(node)) is not None:
                heapq.heappush(heap, (-best[0], node))

        offer(0)
        while heap and len(chosen) < self.p.max_leaves - 1:
            _, node = heapq.heappop(heap)
            chosen.append(node)
            if self.tree.left[node] == node:
                pending.append(node)
            else:
                offer(self.tree.left[node])
                offer(self.tree.right[node])
        # children of the last split need no histogram of their own unless they may be split in turn
        if pending and len(chosen) == self.p.max_leaves - 1 and pending == chosen[-1:]:
            self.tree.split(pending[0], *self.best[pending[0]][1:])
            pending = []
        if not pending:
            self._prune(set(chosen))
            return True
        self.wanted, self.pairs = [], []
        for node in pending:
            _, feature, goes_left = self.best[node]
            a, b = self.tree.split(node, feature, goes_left)
            rows = self.hist[node][feature, :, 2]
            small = a if rows[goes_left].sum() * 2 <= rows.sum() else b
            self.wanted.append(small)
            self.pairs.append((node, small, a + b - small))
        return False

    def take(self, found: np.ndarray) -> None:
        for (node, small, large), h in zip(self.pairs, found):
            self.hist[small] = h
            self.hist[large] = self.hist[node] - h
        new = [x for _, *two in self.pairs for x in two]
        self.best |= zip(new, self._splits([self.hist[x] for x in new]))

    def _prune(self, chosen: set[int]) -> None:
        """The tree of the chosen splits, numbered anew."""
        out, todo = Tree(), [(0, 0)]
        totals: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        while todo:
            a, b = todo.pop()
            if a in chosen:
                todo += zip((self.tree.left[a], self.tree.right[a]), out.split(b, self.best[a][1], self.best[a][2]))
                for side, child in ((True, self.tree.left[a]), (False, self.tree.right[a])):
                    if child not in self.hist:
                        totals[child] = self.hist[a][self.best[a][1]][self.best[a][2] == side].sum(axis=0)
            else:
                g, h, n = totals[a] if a in totals else self.hist[a][self.allowed[0]].sum(axis=0)
                out.value[b] = -g / (h + self.p.l2)
                self.rows[b] = int(n)
        self.tree = out


# ---------------------------------------------------------------------------
# work on a partition: codes (features, n), targets and raw scores (heads, n)
# ---------------------------------------------------------------------------

def _gradients(loss: str, q: float, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if loss == "squared":
        return raw - y, np.ones(len(y))
    if loss == "log_loss":
        p = 1 / (1 + np.exp(-raw))
        return p - y, p * (1 - p)
    if loss == "absolute":
        return np.sign(raw - y), np.ones(len(y))
    return np.where(y < raw, 1 - q, -q), np.ones(len(y))


class Known:
    """What passes over the same rows find out only once: the places of rows, and per head the gradients, hessians and range of residuals of a round."""

    def __init__(self):
        self.roots: dict[int, Spot] = {}
        self.slopes: dict[int, tuple] = {}

    def root(self, h: int, target: np.ndarray) -> Spot:
        if h not in self.roots:
            self.roots[h] = Spot(np.flatnonzero(~np.isnan(target)))
        return self.roots[h]

    def slope(self, h: int, loss: str, q: float, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if h not in self.slopes:
            res = (y - raw).take(self.root(h, y).rows)
            self.slopes[h] = *_gradients(loss, q, y, raw), np.array([res.min(initial=np.inf), -res.max(initial=-np.inf)])
        return self.slopes[h]


def _open(part) -> tuple[np.ndarray, np.ndarray, np.ndarray, Known]:
    return part if len(part) == 4 else (*part, Known())


def _histograms(part, losses: Sequence[tuple[str, float]], widths: Sequence[int], asked: dict[int, tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per head the sums by (wanted leaf, [gradient, rows, hessian unless it is 1], code), the features' codes
    side by side; and the least residual of the head and the greatest (negated).  Where the leaves hold most rows,
    all rows are counted by (leaf, code) as they lie, each code in the same order as leaf by leaf."""
    codes, targets, raws, known = _open(part)
    out = {}
    for h, (frozen, wanted) in asked.items():
        here = reach(frozen, wanted, codes, known.root(h, targets[h]))
        g, hess, ends = known.slope(h, *losses[h], targets[h], raws[h])
        found = np.empty((len(wanted), 3 if losses[h][0] == "log_loss" else 2, sum(widths)))
        if 2 * sum(len(here[w].rows) for w in wanted) > codes.shape[1]:
            leaf, at = np.full(codes.shape[1], len(wanted)), 0  # the last place takes the other rows
            for i, w in enumerate(wanted):
                leaf[here[w].rows] = i
            for column, width in zip(codes, widths):
                place = leaf * width
                place += column
                for c, x in enumerate((g, None, hess)[:found.shape[1]]):
                    sums = np.bincount(place, x, (len(wanted) + 1) * width)
                    found[:, c, at:at + width] = sums[:len(wanted) * width].reshape(-1, width)
                at += width
            out[h] = found, ends
            continue
        for i, w in enumerate(wanted):
            rows, at = here[w].rows, 0
            weights = [g.take(rows), None, *([hess.take(rows)] if found.shape[1] == 3 else [])]
            for column, width in zip(codes, widths):
                code = column.take(rows).astype(np.intp)
                for c, x in enumerate(weights):
                    found[i, c, at:at + width] = np.bincount(code, x, width)
                at += width
        out[h] = found, ends
    return out


def _add(a: dict, b: dict) -> dict:
    return {k: (a[k][0] + b[k][0], np.minimum(a[k][1], b[k][1])) for k in a}


def _unfold(found: np.ndarray, widths: Sequence[int]) -> np.ndarray:
    """Sums of :func:`_histograms` as (leaf, feature, code, [gradient, hessian, rows])."""
    out, at = np.zeros((len(found), len(widths), CODES, 3)), 0
    for j, width in enumerate(widths):
        one = found[:, :, at:at + width]
        out[:, j, :width, 0], out[:, j, :width, 1], out[:, j, :width, 2] = one[:, 0], one[:, -1], one[:, 1]
        at += width
    return out


def _sums(part) -> np.ndarray:
    """Rows and sum of the targets of each head."""
    return np.array([[(~np.isnan(t)).sum(), np.nansum(t)] for t in part[1]])


def _advance(part, step: dict[int, tuple]):
    """The part with a tree added to the raw scores of each head's rows; the places of rows in these trees stay known."""
    codes, targets, raws, known = _open(part)
    raws = raws.copy()
    for h, tree in step.items():
        root = known.root(h, targets[h])
        for leaf, spot in reach(tree, leaves_of(tree), codes, root).items():
            raws[h, spot.rows] += tree[3][leaf]
        _prune(tree, root)
    known.slopes = {}
    return (codes, targets, raws, known)[:len(part)]


class Held:
    """The rows of a fit in the memory of one task."""

    bracket = np.inf  # all values of a leaf are at hand

    def __init__(self, part):
        self.part = *part, Known()

    def total(self, work: Callable, merge: Callable):
        return work(self.part)

    def advance(self, step: dict[int, tuple]) -> None:
        self.part = _advance(self.part, step)


class Spread:
    """The rows of a fit in the partitions of a cached RDD; each advance is a new one, checkpointed now
    and then, and the one before is released after the next pass."""

    def __init__(self, parts):
        self.parts, self.before, self.rounds = parts.persist(StorageLevel.MEMORY_AND_DISK), None, 0
        self.direct = parts.getNumPartitions() <= DIRECT_PARTS

    @property
    def bracket(self) -> int:
        return BRACKET

    def total(self, work: Callable, merge: Callable):
        found = self.parts.map(work)
        out = reduce(merge, found.collect()) if self.direct else found.treeReduce(merge)
        if self.before is not None:
            self.before.unpersist()
            self.before = None
        return out

    def advance(self, step: dict[int, tuple]) -> None:
        self.before = self.parts
        self.parts = self.parts.map(partial(_advance, step=step)).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += 1
        if self.rounds % CHECKPOINT_ROUNDS == 0:
            self.parts.checkpoint()


Rows = Held | Spread


def _brackets(part, asked: dict) -> dict:
    """For each (head, leaf) the values in its bracket, if few; else its range, or of each of its cells
    the count, the least value and the greatest (negated)."""
    codes, targets, raws, known = _open(part)
    out, leaves, placed = {}, {}, {}
    for h, leaf in asked:
        leaves.setdefault(h, []).append(leaf)
    for (h, leaf), (frozen, low, high, few) in asked.items():
        if h not in placed:
            placed[h] = reach(frozen, leaves[h], codes, known.root(h, targets[h]))
        rows = placed[h][leaf].rows
        x = targets[h].take(rows) - raws[h].take(rows)
        x = x[(x >= low) & (x <= high)]
        if few:
            out[h, leaf] = "values", x
        elif np.isinf(low):
            out[h, leaf] = "range", (x.min(initial=np.inf), x.max(initial=-np.inf))
        else:
            cell = np.minimum((x - low) / ((high - low) / CELLS), CELLS - 1).astype(np.int64)
            least, most = np.full(CELLS, np.inf), np.full(CELLS, np.inf)
            np.minimum.at(least, cell, x)
            np.minimum.at(most, cell, -x)
            out[h, leaf] = "cells", np.stack([np.bincount(cell, minlength=CELLS), least, most])
    return out


def _merge_brackets(a: dict, b: dict) -> dict:
    out = {}
    for key, (kind, x) in a.items():
        y = b[key][1]
        if kind == "values":
            out[key] = kind, np.concatenate((x, y))
        elif kind == "range":
            out[key] = kind, (min(x[0], y[0]), max(x[1], y[1]))
        else:
            out[key] = kind, np.stack([x[0] + y[0], np.minimum(x[1], y[1]), np.minimum(x[2], y[2])])
    return out


def exact_quantiles(rows: Rows, asked: dict[tuple[int, int], tuple[tuple, int, float]],
                    within: dict[int, tuple[float, float]] | None = None) -> dict[tuple[int, int], float]:
    """Interpolated quantiles of the residuals in each (head, leaf): ``asked`` gives the tree, the leaf's
    rows and the quantile; ``within`` a range of a head's residuals, if known.  A bracket holds the two order statistics around the position; ``below``
    counts the values left of it."""
    state, out = {}, {}
    for key, (frozen, n, q) in asked.items():
        low, high = (within or {}).get(key[0], (-np.inf, np.inf))
        if low == high:
            out[key] = float(low)
            continue
        state[key] = {"frozen": frozen, "n": n, "pos": (n - 1) * q, "low": low, "high": high, "below": 0, "inside": n}
    while state:
        wanted = {k: (s["frozen"], s["low"], s["high"], s["inside"] <= rows.bracket) for k, s in state.items()}
        for key, (kind, x) in rows.total(partial(_brackets, asked=wanted), _merge_brackets).items():
            s = state[key]
            low, frac = int(np.floor(s["pos"])), s["pos"] - np.floor(s["pos"])
            high = min(low + 1, s["n"] - 1)
            if kind == "values":
                at = [low - s["below"], high - s["below"]]
                a, b = np.partition(x, at)[at]
                out[key] = float(a + frac * (b - a))
                del state[key]
                continue
            if kind == "range":
                s["low"], s["high"] = x
            else:
                ends = s["below"] + np.cumsum(x[0])
                first, last = int(np.searchsorted(ends, low, side="right")), int(np.searchsorted(ends, high, side="right"))
                if first != last:  # the greatest value of one cell and the least of the next that has any
                    a, b = -x[2][first], x[1][last]
                    out[key] = float(a + frac * (b - a))
                    del state[key]
                    continue
                s["below"], s["inside"] = int(ends[first] - x[0][first]), int(x[0][first])
                s["low"], s["high"] = float(x[1][first]), float(-x[2][first])
            if s["low"] == s["high"]:
                out[key] = float(s["low"])
                del state[key]
    return out


# ---------------------------------------------------------------------------
# the fit
# ---------------------------------------------------------------------------

def _parts(train: DataFrame, binner: Binner, heads: Sequence[Head]):
    """The training rows as one (codes, targets, raw scores) a partition; None without rows."""
    targets = [f"_t{i}" for i in range(len(heads))]
    names, many = binner.spec.allowed, len(heads)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                y = np.ascontiguousarray(pdf[targets].to_numpy(dtype=np.float64).T)
                yield pd.DataFrame({"n": [len(pdf)], "codes": [np.ascontiguousarray(binner.encode([pdf[c] for c in names]).T).tobytes()], "y": [y.tobytes()]})

    rows = train.select(*binner.columns(), *[h.target.cast("double").alias(t) for h, t in zip(heads, targets)])
    packed = reliable_checkpoint(rows.mapInPandas(pack, "n long, codes binary, y binary"))
    total = packed.agg(F.sum("n")).first()[0] or 0
    if not total:
        return None
    cores = train.sparkSession.sparkContext.defaultParallelism
    packed = packed.coalesce(cores * -(-total // (PART_ROWS * cores)))  # a full wave of tasks, or several

    def unpack(found):
        found = list(found)
        codes = [np.frombuffer(r["codes"], np.uint8).reshape(len(names), r["n"]) for r in found]
        y = [np.frombuffer(r["y"], np.float64).reshape(many, r["n"]) for r in found]
        codes = np.concatenate(codes, axis=1) if codes else np.empty((len(names), 0), np.uint8)
        y = np.concatenate(y, axis=1) if y else np.empty((many, 0))
        yield codes, y, np.zeros(y.shape)

    return packed.rdd.mapPartitions(unpack)


def boost(rows: Rows, heads: Sequence[int], losses: Sequence[tuple[str, float]], allowed: Sequence[list[int]], categorical: list[bool],
          widths: Sequence[int], params: TreeParams) -> dict[int, tuple[float, list]]:
    """Start value and trees of the heads with these numbers.  The same rounds run on the driver against
    spread rows and in a task against held ones."""
    totals = rows.total(_sums, np.add)
    live = [h for h in heads if totals[h, 0] > 0]
    sought = [h for h in live if losses[h][0] in ("absolute", "quantile")]
    root = Tree().freeze()
    starts = {h: v for (h, _), v in exact_quantiles(rows, {(h, 0): (root, int(totals[h, 0]), losses[h][1]) for h in sought}).items()}
    for h in live:
        mean = float(totals[h, 1] / totals[h, 0])
        if losses[h][0] == "log_loss":
            mean = min(max(mean, 1e-9), 1 - 1e-9)
            mean = float(np.log(mean / (1 - mean)))
        starts.setdefault(h, mean)
    trees: dict[int, list] = {h: [] for h in live}
    last: dict[int, Tree | None] = dict.fromkeys(live)
    step = {h: (*root[:3], np.array([starts[h]])) for h in live}
    for _ in range(params.max_iter if live else 0):
        rows.advance(step)
        growths = {h: Growth(allowed[h], categorical, params, last[h]) for h in live}
        growing, within = dict(growths), {}
        while growing:
            asked = {h: (g.tree.freeze(), g.wanted) for h, g in growing.items()}
            found = rows.total(partial(_histograms, losses=losses, widths=widths, asked=asked), _add)
            first = not within  # this pass met all rows
            if first:
                within = {h: (float(low), -float(high)) for h, (_, (low, high)) in found.items()}
            for h, g in list(growing.items()):
                (g.take_guess if first else g.take)(_unfold(found[h][0], widths))
                if g.play():
                    del growing[h]
        middle = {(h, leaf): (growths[h].tree.freeze(), n, losses[h][1]) for h in sought for leaf, n in growths[h].rows.items()}
        for (h, leaf), v in exact_quantiles(rows, middle, within).items():
            growths[h].tree.value[leaf] = v
        for h, g in growths.items():
            last[h] = g.tree
            g.tree.value = [v * params.step_size for v in g.tree.value]
            step[h] = g.tree.freeze()
            trees[h].append(step[h])
    return {h: (starts[h], trees[h]) for h in live}


def fit_heads(train: DataFrame, spec: FeatureSpec, heads: Sequence[Head], params: TreeParams = TreeParams(),
              levels: FoldedLevels | None = None, held_rows: int = HELD_ROWS) -> dict[str, Boosted]:
    """All heads fitted side by side on ``train``.  A head of at most ``held_rows`` rows (a bounded number
    of bytes) is boosted in one task, such heads in parallel; the others share passes over all
    partitions.  The models are the same.  A head without usable rows answers 0."""
    ensure_checkpoint_dir(train.sparkSession)
    binner = fit_binner(train, spec, levels)
    columns = spec.allowed
    categorical = [c in binner.levels for c in columns]
    widths = [len(binner.levels[c]) if c in binner.levels else CODES for c in columns]
    allowed = [[j for j, c in enumerate(columns) if h.features is None or c in h.features] for h in heads]
    losses = [(h.loss, 0.5 if h.loss == "absolute" else h.quantile) for h in heads]
    models = [Boosted(binner, h.loss, 0.0) for h in heads]
    if (parts := _parts(train, binner, heads)) is None:
        return {h.name: m for h, m in zip(heads, models)}
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    sizes = parts.map(_sums).treeReduce(np.add)[:, 0]
    small = [h for h in range(len(heads)) if 0 < sizes[h] <= held_rows]
    large = [h for h in range(len(heads)) if sizes[h] > held_rows]
    found = {}
    if small:
        def of_head(index, found):
            for codes, targets, _ in found:
                for h in small:
                    rows = np.flatnonzero(~np.isnan(targets[h]))
                    yield h, (index, codes[:, rows], targets[h, rows])

        def held(item):
            h, got = item[0], sorted(item[1], key=lambda x: x[0])  # sums do not depend on which came first
            targets = np.concatenate([y for *_, y in got])[None]
            part = np.concatenate([c for _, c, _ in got], axis=1), targets, np.zeros(targets.shape)
            return {h: boost(Held(part), [0], losses[h:h + 1], allowed[h:h + 1], categorical, widths, params)[0]}

        for one in parts.mapPartitionsWithIndex(of_head).groupByKey(len(heads)).map(held).collect():  # a bounded group a head
            found |= one
    if large:
        found |= boost(Spread(parts), large, losses, allowed, categorical, widths, params)
    parts.unpersist()
    for h, (start, trees) in found.items():
        models[h].start, models[h].trees = start, trees
    return {h.name: m for h, m in zip(heads, models)}


__all__ = ["Binner", "Boosted", "Head", "Tree", "TreeParams", "best_split", "fit_binner", "fit_heads", "predict"]
