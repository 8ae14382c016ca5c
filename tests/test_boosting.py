"""Boosted trees against a plain version that tries every split of every leaf, one row at a time."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.models import boosting as B
from dwell.models.features import FeatureSpec

SPEC = FeatureSpec(numeric=["x", "z"], categorical=["m"], boolean=["f"])
SCHEMA = "id long, x double, z double, m string, f boolean, y double, g string"


def rows(n=260, seed=3):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        x, z = rnd.choice([None, float("nan"), *map(float, range(12))]), round(rnd.gauss(0, 1), 1)
        m, f = rnd.choice(["a", "b", "c", "d", None, "rare" + str(i)]), rnd.choice([True, False, None])
        y = (x if x is not None and x == x else 20.0) + (4 if m in ("b", "d") else 0) + (3 if f else 0) * z + rnd.gauss(0, 1)
        out.append((i, x, z, m, f, round(y, 3), rnd.choice(["p", "q", "r"])))
    return out


def plain_fit(codes, kinds, y, loss, q, p):
    """Best-first boosting written out: every leaf, feature and cut is tried with plain sums."""
    n = len(y)
    middle = lambda v, at: float(np.quantile(v, at))
    mean = sum(y) / n
    raw = [mean if loss == "squared" else math.log(mean / (1 - mean)) if loss == "log_loss" else middle(y, q)] * n
    gains = []
    for _ in range(p.max_iter):
        if loss == "squared":
            g, h = [r - t for r, t in zip(raw, y)], [1.0] * n
        elif loss == "log_loss":
            s = [1 / (1 + math.exp(-r)) for r in raw]
            g, h = [a - t for a, t in zip(s, y)], [a * (1 - a) for a in s]
        else:
            g, h = [float(np.sign(r - t)) if loss == "absolute" else (1 - q if t < r else -q) for r, t in zip(raw, y)], [1.0] * n
        score = lambda part: sum(g[i] for i in part) ** 2 / (sum(h[i] for i in part) + p.l2)

        def best(part):
            found = None
            for j, kind in enumerate(kinds):
                here = {c: [i for i in part if codes[i][j] == c] for c in {codes[i][j] for i in part}}
                if kind == "level":
                    order = sorted(here, key=lambda c: (sum(g[i] for i in here[c]) / (sum(h[i] for i in here[c]) + 10.0), c))
                    cuts = [set(order[:k]) for k in range(1, len(order))]
                else:
                    order = sorted(c for c in here if c != 255)
                    cuts = [set(order[:k]) for k in range(1, len(order) + (255 in here))]
                    cuts += [{255, *order[:k]} for k in range(1, len(order))] + [{255}] if 255 in here else []
                for cut in cuts:
                    left, right = [i for i in part if codes[i][j] in cut], [i for i in part if codes[i][j] not in cut]
                    if min(len(left), len(right)) >= p.min_instances:
                        gain = score(left) + score(right) - score(part)
                        if gain > 1e-9 and (found is None or gain > found[0] + 1e-9):
                            found = gain, left, right
            return found

        leaves = [(list(range(n)), best(range(n)))]
        taken = []
        while len(leaves) < p.max_leaves and any(b for _, b in leaves):
            at = max((i for i, (_, b) in enumerate(leaves) if b), key=lambda i: leaves[i][1][0])
            gain, left, right = leaves[at][1]
            taken.append(gain)
            leaves[at:at + 1] = [(left, best(left)), (right, best(right))]
        gains.append(taken)
        new = list(raw)
        for part, _ in leaves:
            if loss in ("squared", "log_loss"):
                value = -sum(g[i] for i in part) / (sum(h[i] for i in part) + p.l2)
            else:
                value = middle([y[i] - raw[i] for i in part], q)
            for i in part:
                new[i] = raw[i] + p.step_size * value
        raw = new
    return raw


@pytest.mark.parametrize("loss,q", [("squared", 0.5), ("log_loss", 0.5), ("absolute", 0.5), ("quantile", 0.9)])
@pytest.mark.parametrize("held_rows", [B.PART_ROWS, 0])
def test_equals_the_plain_version(spark, loss, q, held_rows, monkeypatch):
    monkeypatch.setattr(B, "PART_ROWS", 100)  # several partitions
    monkeypatch.setattr(B, "BRACKET", 16)
    params = B.TreeParams(max_iter=4, step_size=0.3, max_leaves=6, min_instances=8, l2=1.0)
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    target = (F.col("y") > 8).cast("int") if loss == "log_loss" else F.col("y")
    fit = B.fit_heads(df, SPEC, [B.Head("a", target, loss, q), B.Head("b", F.when(F.col("g") == "p", target), loss, q)], params, held_rows=held_rows)
    for name, part in (("a", data), ("b", [r for r in data if r[6] == "p"])):
        import pandas as pd
        series = [pd.Series([r[1] for r in part], dtype=float), pd.Series([r[2] for r in part]), pd.Series([r[3] for r in part], dtype=object),
                  pd.Series([None if r[4] is None else float(r[4]) for r in part], dtype=float)]
        codes = fit[name].binner.encode(series)
        y = [float(r[5] > 8) if loss == "log_loss" else r[5] for r in part]
        want = plain_fit(codes.tolist(), ["number", "number", "level", "number"], y, loss, q, params)
        assert fit[name].raw(codes) == pytest.approx(want, abs=1e-7)
    assert len(fit["a"].trees) == 4 and max(len(t[0]) for t in fit["a"].trees) == 11  # 6 leaves


def test_two_rounds_of_the_quantile_loss_by_hand(spark):
    spec = FeatureSpec(numeric=["x"], categorical=[])
    df = spark.createDataFrame([(0.0, 1.0), (0.0, 2.0), (0.0, 3.0), (1.0, 10.0), (1.0, 20.0), (1.0, 30.0)], "x double, y double")
    m = B.fit_heads(df, spec, [B.Head("q", F.col("y"), "quantile", 0.5)], B.TreeParams(2, 0.5, 2, 1, 0.0))["q"]
    assert m.start == 6.5  # the median of all
    # round 1: residual medians 2 - 6.5 and 20 - 6.5, halved; round 2: 2 - 4.25 and 20 - 13.25, halved
    assert [sorted(t[3][t[3] != 0]) for t in m.trees] == [[-2.25, 6.75], [-1.125, 3.375]]
    assert list(m.raw(np.array([[0], [1]], dtype=np.uint8))) == [3.125, 16.625]


def test_exact_quantiles_with_ties(monkeypatch):
    monkeypatch.setattr(B, "BRACKET", 5)
    rnd = np.random.default_rng(1)
    for _ in range(60):
        n = int(rnd.integers(1, 400))
        y = rnd.choice([0.0, 1.0, 1e-9, -3.5, 7.25], n) + rnd.choice([0.0, rnd.normal()], n)
        part = np.zeros((n, 1), np.uint8), y[None], np.zeros((1, n))
        q = float(rnd.choice([0.0, 0.1, 0.5, 0.9, 1.0]))
        got = B.exact_quantiles(B.Held(part), {(0, 0): (B.Tree().freeze(), n, q)})
        assert got[0, 0] == pytest.approx(float(np.quantile(y, q)), abs=1e-12)


def test_held_rows_give_quantiles_in_one_pass(monkeypatch):
    """All values of a leaf are at hand: no bracket is narrowed, whatever the leaf's size."""
    monkeypatch.setattr(B, "BRACKET", 5)
    passes = []

    class Counted(B.Held):
        def total(self, work, merge):
            passes.append(1)
            return super().total(work, merge)

    rnd = np.random.default_rng(2)
    y = rnd.normal(size=(1, 5000))
    tree = B.Tree()
    leaves = tree.split(0, 0, np.arange(B.CODES) < 100)
    codes = rnd.integers(0, 200, (1, 5000)).astype(np.uint8)
    asked = {(0, w): (tree.freeze(), int(((codes[0] < 100) == (w == leaves[0])).sum()), 0.9) for w in leaves}
    got = B.exact_quantiles(Counted((codes, y, np.zeros((1, 5000)))), asked, {0: (float(y.min()), float(y.max()))})
    for w in leaves:
        assert got[0, w] == pytest.approx(float(np.quantile(y[0, (codes[0] < 100) == (w == leaves[0])], 0.9)), abs=1e-12)
    assert len(passes) == 1


def test_all_leaves_at_once_are_counted_as_one_by_one():
    """Sums of all leaves in one count are those of each leaf alone, bit for bit; rows without a target count nowhere."""
    rnd = np.random.default_rng(4)
    widths = [B.CODES, 6]
    codes = np.stack([rnd.integers(0, w, 4000) for w in widths]).astype(np.uint8)
    y = np.where(rnd.random((1, 4000)) < 0.2, np.nan, rnd.random((1, 4000)))
    tree = B.Tree()
    a, b = tree.split(0, 1, np.arange(B.CODES) < 3)
    wanted = [a, *tree.split(b, 0, np.arange(B.CODES) < 90)]
    part = B.Held((codes, y, np.zeros(y.shape))).part
    together = B._histograms(part, [("squared", 0.5)], widths, {0: (tree.freeze(), wanted)})[0][0]
    for i, w in enumerate(wanted):
        leaf = B.reach(tree.freeze(), [w], codes, B.Spot(np.flatnonzero(~np.isnan(y[0]))))[w].rows
        alone = np.concatenate([np.bincount(codes[j, leaf], -y[0, leaf], n) for j, n in enumerate(widths)])
        assert together[i, 0].tobytes() == alone.tobytes()
        assert together[i, 1].sum() == 2 * len(leaf)


def test_kept_places_change_no_model(spark):
    """What a task keeps between passes gives the sums of a plain count."""
    rnd = np.random.default_rng(5)
    widths = [B.CODES, 7, 5, 9, B.CODES]
    codes = np.stack([rnd.integers(0, w, 3000) for w in widths]).astype(np.uint8)
    y = np.where(rnd.random((1, 3000)) < 0.1, np.nan, rnd.integers(0, 2, (1, 3000)))
    tree = B.Tree()
    a, b = tree.split(0, 1, np.arange(B.CODES) < 3)
    c, d = tree.split(b, 0, np.arange(B.CODES) < 90)
    held = B.Held((codes, y, np.zeros(y.shape)))
    for values in ([0.0] * 5, [0.0, 0.5, 0.0, -0.25, 1.0]):
        tree.value = values
        held.advance({0: tree.freeze()})
        leaf = np.where(codes[1] < 3, a, np.where(codes[0] < 90, c, d))
        raw = held.part[2][0]
        for wanted in ([d], [a, c, d]):
            found = B._histograms(held.part, [("log_loss", 0.5)], widths, {0: (tree.freeze(), wanted)})[0][0]
            sums = B._unfold(found, widths)
            for i, w in enumerate(wanted):
                here = np.flatnonzero((leaf == w) & ~np.isnan(y[0]))
                p = 1 / (1 + np.exp(-raw[here]))
                for j in range(len(widths)):
                    for at, x in enumerate((p - y[0, here], p * (1 - p), np.ones(len(here)))):
                        assert sums[i, j, :, at] == pytest.approx(np.bincount(codes[j, here], x, B.CODES), abs=1e-9)
    assert set(held.part[3].roots[0].cuts) == {(1, (np.arange(B.CODES) < 3).tobytes())}


def test_defined_results(spark):
    df = spark.createDataFrame(rows(40), SCHEMA)
    heads = [B.Head("none", F.lit(None), "squared"), B.Head("one", F.lit(1), "log_loss"), B.Head("few", F.col("y"), "squared", features=["x"])]
    fit = B.fit_heads(df, SPEC, heads, B.TreeParams(2, 0.1, 4, 5))
    assert fit["none"].trees == [] and fit["none"].start == 0.0
    got = B.predict(df, fit).select("none", "one", "few").collect()
    assert {r["none"] for r in got} == {0.0} and all(r["one"] > 0.999 for r in got)
    assert all(set(t[0][t[2][:, 0] != np.arange(len(t[0]))]) <= {0} for t in fit["few"].trees)
    empty = B.fit_heads(df.limit(0), SPEC, heads, B.TreeParams(2))
    assert [m.trees for m in empty.values()] == [[], [], []]
    again = B.Boosted.from_json(fit["few"].to_json(), fit["few"].binner)
    codes = np.random.default_rng(0).integers(0, 200, (50, 4)).astype(np.uint8)
    assert list(again.raw(codes)) == list(fit["few"].raw(codes))


def test_splits_of_several_nodes_are_those_of_each_alone():
    """Side by side or alone: the same gains and flags bit for bit; small nodes, missing numbers and unused levels among them."""
    rnd = np.random.default_rng(6)
    p = B.TreeParams(min_instances=5)
    hists = np.zeros((12, 3, B.CODES, 3))
    for node, n in enumerate([400, 9, 300, 12, 50, 700, 0, 30, 200, 11, 90, 60]):
        g, h = rnd.normal(size=n), rnd.random(n)
        for j, width in enumerate((40, 4, 9)):
            code = rnd.integers(0, width, n)
            if j == 0 and node % 3:
                code[rnd.random(n) < 0.2] = B.GONE
            if j == 2:
                code[code > node] = 0
            for c, x in enumerate((g, h, np.ones(n))):
                hists[node, j, :, c] = np.bincount(code, x, B.CODES)
    for allowed in ([0, 1, 2], [0], [1, 2], [2]):
        got = B.best_splits(hists, [False, True, True], allowed, p)
        for one, hist in zip(got, hists):
            want = B.best_split(hist, [False, True, True], allowed, p)
            assert (one is None) == (want is None)
            if one is not None:
                assert one[:2] == want[:2] and one[2].tobytes() == want[2].tobytes()
                here = hist[one[1]]
                left, total = here[one[2]].sum(axis=0), here.sum(axis=0)
                right = total - left
                score = lambda s: s[0] ** 2 / (s[1] + p.l2)
                assert one[0] == pytest.approx(score(left) + score(right) - score(total)) and min(left[2], right[2]) >= 5
        assert got[1] is None and got[6] is None and got[5] is not None
