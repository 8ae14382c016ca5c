import datetime as dt
import os
import random
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from dwell.models import explain
from dwell.models.features import FeatureSpec, fit_levels
from dwell.models.boosting import TreeParams, fit_heads
from dwell.models.isotonic import fit_isotonic
from dwell.models.train import days_head, fit_bundle, predict_days, predict_probability, predict_quantiles
from dwell.operators.gates import LeakageError
from dwell.operators import metrics as M
from dwell.sources.files import SourceError, load_bundle, save_bundle
from dwell.streaming.score import score_batch, score_rows

SPEC = FeatureSpec(numeric=["age_days"], categorical=["animal_type", "intake_type"], boolean=["is_mix"],
                   forbidden=["outcome_type"])
PARAMS = TreeParams(max_iter=8, step_size=0.1, max_leaves=8, min_instances=5)
PASS = ["id", "is_long", "duration_days"]


def _frame(spark, n=1200, seed=0):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        t = rnd.choice(["Dog", "Cat"])
        age = rnd.choice([30.0, 200.0, 900.0, 3000.0])
        if t == "Cat" and age == 3000.0:
            d = 150.0 if rnd.random() < 0.8 else 5.0
        else:
            d = 120.0 if rnd.random() < 0.05 else 5.0 * float(np.exp(rnd.gauss(0, 0.4)))
        rows.append((i, t, rnd.choice(["Stray", "Owner Surrender", "Public Assist"]), age,
                     rnd.random() < 0.5, min(365.0, d)))
    df = spark.createDataFrame(rows, "id long, animal_type string, intake_type string, age_days double, "
                                     "is_mix boolean, duration_days double")
    return df.withColumn("is_long", (F.col("duration_days") >= 90).cast("int"))


@pytest.fixture(scope="module")
def fitted(spark):
    df = _frame(spark)
    b = fit_bundle(df, "duration_days", "is_long", SPEC, PARAMS)
    return df, b


def test_level_cap(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), ("b",), ("c",), (None,)], "x string")
    lv = fit_levels(df, ["x"], cap=2)
    out = [r.x__lv for r in lv.transform(df).collect()]
    assert out == ["a", "a", "b", "b", "Other", "Missing"]


def test_classifier_finds_signal(spark, fitted):
    df, b = fitted
    scored = predict_probability(df, b, PASS)
    r = M.classifier_metrics(scored, "probability", "is_long").first()
    assert r.pr_auc_lift > 2.0
    p = [x.probability for x in scored.collect()]
    assert all(0.0 <= v <= 1.0 for v in p)


def test_quantiles_ordered(spark, fitted):
    df, b = fitted
    q = predict_quantiles(df, b, PASS).collect()
    assert all(0 <= r.p10_days <= r.p50_days <= r.p90_days <= 365 for r in q)


def test_score_batch_ranked_with_drivers(spark, fitted):
    df, b = fitted
    out = score_batch(df.limit(60), b, "id", PASS[1:], group_col="animal_type").collect()
    probs = [r.probability for r in out]
    assert probs == sorted(probs, reverse=True)
    for r in out:
        assert r.risk_band == ("High" if r.probability >= 0.4 else "Elevated" if r.probability >= 0.1
                               else "Standard" if r.probability >= 0.02 else "Fast")
        effects = [abs(d.effect_pp) for d in (r.drivers or [])]
        assert len(effects) <= 6 and all(e >= 0.05 for e in effects)
        assert effects == sorted(effects, reverse=True)
        assert all(e <= 100 for e in effects)


def test_isotonic_monotone(spark, fitted):
    df, b = fitted
    scored = predict_probability(df, b, PASS)
    iso = fit_isotonic(scored, "probability", "is_long")
    cal = sorted((r.probability, r.calibrated) for r in iso.calibrate(scored, "probability").collect())
    assert all(a[1] <= b_[1] + 1e-12 for a, b_ in zip(cal, cal[1:]))


def test_permutation_importance(spark, fitted):
    df, b = fitted
    imp = {r.feature: r for r in explain.permutation_importance(df, b.models["days"], SPEC.allowed, "id", "duration_days",
                                                                  repeats=2, seed=1).collect()}
    assert set(imp) == set(SPEC.allowed)
    assert all(r.repeats == 2 for r in imp.values())
    ap = {r.feature: r.importance_mean for r in explain.permutation_importance(df, b.models["classifier"], SPEC.allowed, "id", "is_long", "ap", 2).collect()}
    assert ap["animal_type"] > 0.1 and ap["age_days"] > 0.1 and abs(ap["intake_type"]) < 0.05


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_donor_map_is_one_to_one(n):
    for k in range(4):
        a, b = explain.donor_map(n, k, 5)
        assert sorted((a * r + b) % n for r in range(n)) == list(range(n))


def test_changed_answers_of_a_model(spark, fitted):
    """One pass over the trees gives what a prediction on changed rows gives."""
    df, b = fitted
    ref = {"age_days": 3000.0, "animal_type": "Cat", "intake_type": None, "is_mix": True}
    model = b.models["classifier"]
    got = {r.id: r for r in explain.drivers(df.limit(50), model, SPEC.allowed, ref, k=9, min_pp=0.0).collect()}
    base = {r.id: r.probability for r in predict_probability(df, b, PASS).collect()}
    for f in SPEC.allowed:
        changed = predict_probability(df.withColumn(f, F.lit(ref[f]).cast(df.schema[f].dataType)), b, PASS)
        for r in changed.where(F.col("id").isin(list(got))).collect():
            effect = {d.feature: d.effect_pp for d in got[r.id].drivers}[f]
            assert effect == pytest.approx((base[r.id] - r.probability) * 100, abs=0.0051)


def test_only_moved_rows_are_followed_to_a_new_leaf(spark, fitted):
    """Answers with one feature changed are those of a walk with the whole changed line; a row whose codes cut alike keeps its answer."""
    model = fitted[1].models["classifier"]
    rnd = np.random.default_rng(3)
    sizes = [len(model.binner.levels[c]) if c in model.binner.levels else 256 for c in SPEC.allowed]
    codes, others = (np.stack([rnd.integers(0, n, 500) for n in sizes]).astype(np.uint8) for _ in range(2))
    others[:, ::3] = codes[:, ::3]
    raw, *got = explain.changed_raws(model, codes, others, range(len(sizes)))
    assert raw == pytest.approx(model.raw(codes.T), abs=1e-12)
    for j, new in enumerate(got):
        changed = codes.copy()
        changed[j] = others[j]
        assert new == pytest.approx(model.raw(changed.T), abs=1e-12)
        assert new[::3].tobytes() == raw[::3].tobytes()
    assert [len(x) for x in explain.changed_raws(model, codes[:, :0], others[:, :0], [1])] == [0, 0]


def test_rows_of_the_importance_are_dealt_to_all_cores(spark, fitted, monkeypatch):
    """Few bytes are much work: the rows that a model answers for are dealt by their number, not by their size."""
    df, b = fitted
    monkeypatch.setattr(explain, "ANSWER_ROWS", 100)
    got = explain.permuted_answers(df, b.models["classifier"], SPEC.allowed, "id", "is_long", repeats=3)
    assert got.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, -(-3 * df.count() // 100))


def test_the_gate_sees_the_incoming_frame(spark, fitted):
    df, b = fitted
    for bad in ("outcome_type", "note"):
        with pytest.raises(LeakageError):
            predict_probability(df.withColumn(bad, F.lit("x")), b, PASS)
        with pytest.raises(LeakageError):
            score_rows(df.withColumn(bad, F.lit("x")), b, "id", PASS[1:])
    with pytest.raises(LeakageError):
        predict_probability(df.drop("age_days"), b, PASS)
    assert "note" in predict_probability(df.withColumn("note", F.lit("x")), b, [*PASS, "note"]).columns


def test_bundle_roundtrip(spark, fitted):
    df, b = fitted
    root = tempfile.mkdtemp(prefix="dwell-bundle-")
    save_bundle(b, root)
    b2 = load_bundle(spark, root)
    p1 = [r.probability for r in predict_probability(df, b, PASS).orderBy("id").collect()]
    p2 = [r.probability for r in predict_probability(df, b2, PASS).orderBy("id").collect()]
    assert p1 == pytest.approx(p2)
    with pytest.raises(SourceError):
        load_bundle(spark, os.path.join(root, "nope"))


def test_stream_scoring(spark, fitted):
    df, b = fitted
    src = tempfile.mkdtemp(prefix="dwell-stream-src-")
    df.limit(40).write.mode("overwrite").parquet(os.path.join(src, "part1"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "part1"))
    q = (score_rows(stream, b, "id", PASS[1:]).writeStream.format("memory").queryName("scored_stream")
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination(120)
    got = spark.sql("SELECT * FROM scored_stream")
    assert got.count() == 40 and "risk_band" in got.columns


def test_foreach_batch_scoring_with_drivers(spark, fitted):
    df, b = fitted
    from dwell.streaming.score import start_scoring, write_batch
    src = tempfile.mkdtemp(prefix="dwell-fb-src-")
    df.limit(30).write.mode("overwrite").parquet(os.path.join(src, "in"))
    out = os.path.join(tempfile.mkdtemp(prefix="dwell-fb-out-"), "scored")
    ck = os.path.join(tempfile.mkdtemp(prefix="dwell-fb-ck-"), "ck")
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "in"))
    q = start_scoring(stream, b, "id", out, ck, PASS[1:])
    q.awaitTermination(180)
    got = spark.read.parquet(out)
    assert got.count() == 30 and {"drivers", "batch_id"} <= set(got.columns)
    write_batch(score_batch(df.limit(30), b, "id", PASS[1:]), out, 0)  # the same batch once more
    assert spark.read.parquet(out).count() == 30


def test_report_blocks_and_diagnosis(spark, fitted):
    df, b = fitted
    from dwell.models.report import build_report, classifier_report
    scored = predict_probability(df, b, PASS)
    blocks = classifier_report(scored, scored, "probability", "is_long", "id", group="animal_type")
    assert {"classifier", "operating_points", "reliability", "ece", "by_group"} <= set(blocks)
    assert blocks["operating_points"].count() >= 1
    rep = build_report(scored.withColumn("pred", F.col("probability") * 100), "duration_days", "pred", "id",
                       ["animal_type"])
    assert rep["core"].first().n == df.count() and rep["worst"].count() == 50
    diag = {r.group: r for r in explain.diagnose_groups(df, df, "animal_type", b, SPEC, "is_long", "duration_days", "id", PARAMS, min_train=100,
                                                        min_pos=60, repeats=2, min_n=10).collect()}
    assert set(diag) == {"Cat", "Dog"} and all(r.general_pr_auc is not None for r in diag.values())
    assert diag["Dog"].group_model_pr_auc is None and diag["Dog"].importance is None and not diag["Dog"].group_model_helps
    assert diag["Cat"].importance[0].feature == "age_days" and len(diag["Cat"].importance) == 4
    spread = [c.spread for c in diag["Cat"].contrast]
    assert spread == sorted(spread, reverse=True) and {c.column for c in diag["Cat"].contrast} == {"animal_type", "intake_type", "is_mix"}


def test_enrich_records_defaults_time(spark):
    from dwell.streaming.score import enrich_records
    raw = spark.createDataFrame([("2020-07-04T10:00:00", "Rex", "2 years", "Beagle Mix", "Black/White", "Neutered Male"),
                                 (None, None, None, None, None, None)],
                                "ts string, name string, age string, breed string, color string, sex string")
    out = enrich_records(raw, "ts", name="name", age_text="age", breed="breed", color="color", sex="sex").collect()
    assert out[0].start_month == 7 and out[0].age_days == 730.5 and out[0].is_mix and out[0].is_black
    assert out[0].sex == "Male" and out[0].sterilization_status == "Fixed" and out[0].has_name
    assert out[1].start_ts is not None and out[1].age_days is None and out[1].sex == "Unknown"
    assert out[1].has_name is False and out[1].is_mix is None


def test_smearing_refusals_and_comparison(spark):
    df = spark.createDataFrame([(i, float(i), i * 0.9, i * 0.9 + 1) for i in range(1, 41)], "id long, y double, a double, b double")
    for kw in ({"target": "raw"}, {"quantile": 0.5}):
        with pytest.raises(ValueError):
            M.fit_smearing(df, "y", "a", **kw)
    r = M.smearing_comparison(df, "y", "a", "b", "id").first()
    assert r.decile_assignment_identical and r.spearman_correlation == pytest.approx(1.0)
    assert r.b_mae == pytest.approx(np.mean([abs(i * 0.9 + 1 - i) for i in range(1, 41)]))


def test_reference_row_and_weighted_isotonic(spark):
    from dwell.models.train import fit_reference_row
    spec = FeatureSpec(numeric=["x"], categorical=["m"], boolean=["f"], forbidden=[])
    df = spark.createDataFrame([(1.0, 10, True), (2.0, 9, None), (9.0, 9, False), (None, 10, False)], "x double, m int, f boolean")
    assert fit_reference_row(df, spec) == {"m": 9, "f": False, "x": 2.0}
    scored = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.1, 0), (0.5, 1), (0.4, 1), (0.9, 0)], "s double, y int")
    got = {r.s: r.calibrated for r in fit_isotonic(scored, "s", "y").calibrate(scored, "s").collect()}
    assert got[0.1] == pytest.approx(1 / 3) and got[0.9] == got[0.4] == got[0.5] == pytest.approx(2 / 3)


def test_importance_of_a_log_model_in_days(spark, fitted):
    df, b = fitted
    log = fit_heads(df, SPEC, [days_head("duration_days", "log1p", "log")], PARAMS)["log"]
    imp = {r.feature: r.importance_mean for r in explain.permutation_importance(
        df, log, SPEC.allowed, "id", "duration_days", repeats=2, answer=F.expm1).collect()}
    assert imp["age_days"] > 0.5  # days, not logarithms


def test_ablation(spark, fitted):
    df, _ = fitted
    got = {r.variant: r for r in explain.ablation(df, df.select("id", "is_long", *SPEC.allowed), SPEC, ["age_days"], "is_long", "id", PARAMS).collect()}
    assert got["b"].pr_auc < got["a"].pr_auc and got["b"].relative_ap_change < 0


def plain_pava(points):
    stack = []
    for x, t, w in sorted(points):
        stack.append([x, x, t, w])
        while len(stack) > 1 and stack[-2][2] * stack[-1][3] >= stack[-1][2] * stack[-2][3]:
            _, high, t2, w2 = stack.pop()
            stack[-1][1], stack[-1][2], stack[-1][3] = high, stack[-1][2] + t2, stack[-1][3] + w2
    return [(a, b, t / w) for a, b, t, w in stack]


@pytest.mark.parametrize("shape,size", [("rising", 5000), ("rising", 100_000), ("falling", 5000), ("wave", 5000)])
def test_isotonic_over_ranges_equals_one_stack(spark, shape, size):
    n = 100_000 if size == 100_000 else 20_000
    rnd = np.random.default_rng(4)
    x = np.arange(n) / n
    rate = {"rising": x, "falling": 1 - x, "wave": 0.5 + 0.4 * np.sin(9 * x)}[shape]
    y = (rnd.random(n) < rate).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "s double, y double").repartition(7)
    got = sorted(tuple(r) for r in fit_isotonic(df, "s", "y", range_pools=size // 4).pools.collect())
    assert got == [pytest.approx(r) for r in plain_pava([(float(a), float(b), 1.0) for a, b in zip(x, y)])]


def test_imputation(spark):
    from dwell.models.features import impute
    df = spark.createDataFrame([(1.0, "a", True), (2.0, None, True), (9.0, "b", False), (None, "a", None)], "x double, m string, f boolean")
    spec = FeatureSpec(numeric=["x"], categorical=["m"], boolean=["f"])
    out = impute(df, df, spec, fit_levels(df, ["m"], min_rows=2)).collect()
    assert [(r.x, r.x__na, r.m__lv, r.f) for r in out] == [(1.0, False, "a", True), (2.0, False, "Missing", True), (9.0, False, "Other", False), (2.0, True, "a", True)]


def test_baselines_read_only_their_period(spark, monkeypatch, tmp_path):
    """The report's stays lie by period: a filter on one leaves the files of the others unread."""
    from dwell.plans import catalog
    stays = spark.createDataFrame([(1, dt.datetime(1998, 1, 1), 3.0), (2, dt.datetime(2000, 5, 1), 4.0), (3, dt.datetime(2002, 1, 1), 5.0)],
                                  "seq long, start_ts timestamp_ntz, duration_days double")
    monkeypatch.setattr(catalog.D, "stays_with_customer", lambda spark, root: stays)
    lab = catalog._split_stays(spark, "nowhere", "seq")
    assert sorted((r.seq, r.split) for r in lab.collect()) == [(1, "train"), (2, "validation"), (3, "test")]
    plan = lab.where("split = 'test'").select("seq")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "ReadSchema: struct<seq:bigint>" in plan
