import datetime as dt

import pytest

from dwell.operators import gates, split

D = dt.datetime
DATES = ("2022-12-31", "2023-01-01", "2023-12-31", "2024-01-01")


def test_split_boundaries(spark):
    rows = [(D(2022, 12, 30),), (D(2022, 12, 31, 23, 59),), (D(2023, 1, 1),), (D(2023, 12, 31, 23, 59),),
            (D(2024, 1, 1),), (D(2025, 3, 1),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    got = [r.split for r in split.temporal_split(df, "t", *DATES).orderBy("t").collect()]
    assert got == ["train", "train", "validation", "validation", "test", "test"]
    summ = {r.split: r.rows for r in split.split_summary(df, "t", *DATES).collect()}
    assert summ == {"train": 2, "validation": 2, "test": 2}


def test_split_misordered(spark):
    with pytest.raises(ValueError):
        split.split_label("t", "2023-12-31", "2023-01-01", "2023-12-31", "2024-01-01")


ALLOWED = ["age_days", "animal_type", "sex"]
FORBIDDEN = ["outcome_type", "outcome_subtype"]


def test_gate_order(spark):
    gates.check_columns(["age_days", "sex"], ALLOWED, FORBIDDEN)
    with pytest.raises(gates.LeakageError, match="forbidden"):
        gates.check_columns(["outcome_type", "zzz"], ALLOWED, FORBIDDEN)
    with pytest.raises(gates.LeakageError, match="whitelist"):
        gates.check_columns(["zzz"], ALLOWED, FORBIDDEN)
    with pytest.raises(gates.LeakageError, match="missing"):
        gates.check_columns(["sex"], ALLOWED, FORBIDDEN, required=ALLOWED)


def test_stored_columns_stop_on_unlisted(spark):
    df = spark.createDataFrame([(1.0, "Dog", "Male", 9)], "age_days double, animal_type string, sex string, n int")
    with pytest.raises(gates.LeakageError, match="whitelist"):
        gates.select_stored(df, ALLOWED, FORBIDDEN)
    assert gates.select_stored(df, ALLOWED, FORBIDDEN, working=["n"]).columns == ALLOWED
    with pytest.raises(gates.LeakageError, match="forbidden"):
        gates.select_stored(df.withColumnRenamed("n", "outcome_type"), ALLOWED, FORBIDDEN, working=["outcome_type"])
    with pytest.raises(gates.LeakageError, match="missing"):
        gates.select_stored(df.drop("sex"), ALLOWED, FORBIDDEN, working=["n"])


@pytest.mark.parametrize("bad", FORBIDDEN)
def test_feature_matrix_rejects(spark, bad):
    df = spark.createDataFrame([(1.0, "Dog", "Male", "x")], f"age_days double, animal_type string, sex string, {bad} string")
    with pytest.raises(gates.LeakageError):
        gates.feature_matrix(df, ALLOWED, FORBIDDEN)


def test_feature_matrix_order(spark):
    df = spark.createDataFrame([("Male", 1.0, "Dog", 9)], "sex string, age_days double, animal_type string, extra int")
    assert gates.feature_matrix(df, ALLOWED, FORBIDDEN).columns == ALLOWED


def test_numeric_contrast_skips_null_and_nan(spark):
    from dwell.operators.breakdown import numeric_contrast
    rows = [(100.0, 1.0, "a"), (95.0, 3.0, "a"), (90.0, 8.0, "a"), (5.0, 10.0, "a"), (6.0, None, "a"), (7.0, float("nan"), "a"), (200.0, 99.0, "b")]
    df = spark.createDataFrame(rows, "duration_days double, x double, g string")
    r = numeric_contrast(df, ["x"], where={"g": "a"}).first()
    assert (r.column, r.mean_long_stay, r.median_long_stay, r.mean_short_stay, r.median_short_stay) == ("x", 4.0, 3.0, 10.0, 10.0)


def test_infrequent_levels_fold(spark):
    from dwell.models.features import fit_levels
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)], "m string")
    levels = fit_levels(df, ["m"], min_rows=3)
    assert levels.levels == {"m": ["a"]}
    assert sorted(r.m__lv for r in levels.transform(df).collect()) == ["Missing", "Other", "Other", "a", "a", "a"]
