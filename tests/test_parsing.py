import datetime as dt

import pytest
from pyspark.sql import functions as F

from dwell.functions import text as X


def _one(spark, col_fn, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(col_fn(F.col("x"))).collect()]


@pytest.mark.parametrize("text,days", [("1 day", 1.0), ("4 weeks", 28.0), ("3 months", 3 * 365.25 / 12),
                                       ("2 years", 730.5), ("  2 YEARS  ", 730.5), ("1 Year", 365.25),
                                       ("0 days", 0.0)])
def test_age_days(spark, text, days):
    assert _one(spark, X.age_days, [text]) == [pytest.approx(days)]


@pytest.mark.parametrize("text", [None, "", "unknown", "2", "years", "2 fortnights", "-1 years"])
def test_age_days_bad(spark, text):
    assert _one(spark, X.age_days, [text]) == [None]


@pytest.mark.parametrize("text,primary,mix", [
    ("Labrador Retriever Mix", "Labrador Retriever", True), ("Beagle", "Beagle", False),
    ("Pit Bull/Labrador Retriever", "Pit Bull", True), ("   ", None, None), (None, None, None),
    ("Mix", None, True), ("domestic shorthair mix", "domestic shorthair", True)])
def test_breed(spark, text, primary, mix):
    df = spark.createDataFrame([(text,)], "x string")
    p, m = X.breed_parts("x")
    assert tuple(df.select(p, m).first()) == (primary, mix)


@pytest.mark.parametrize("text,primary,black", [
    ("Black/White", "Black", True), ("White/Black", "White", False), ("Black Tabby", "Black Tabby", False),
    ("black", "black", True), ("", None, None)])
def test_color(spark, text, primary, black):
    df = spark.createDataFrame([(text,)], "x string")
    p, b = X.color_parts("x")
    assert tuple(df.select(p, b).first()) == (primary, black)


@pytest.mark.parametrize("text,sex,status", [
    ("Neutered Male", "Male", "Fixed"), ("Intact Female", "Female", "Intact"), ("Spayed Female", "Female", "Fixed"),
    ("Unknown", "Unknown", "Unknown"), (None, "Unknown", "Unknown"), ("", "Unknown", "Unknown")])
def test_sex(spark, text, sex, status):
    df = spark.createDataFrame([(text,)], "x string")
    s, st = X.sex_parts("x")
    assert tuple(df.select(s, st).first()) == (sex, status)


def test_season(spark):
    got = _one(spark, X.season, list(range(1, 13)), "int")
    assert got == ["Winter", "Winter", "Spring", "Spring", "Spring", "Summer", "Summer", "Summer",
                   "Fall", "Fall", "Fall", "Winter"]


@pytest.mark.parametrize("text,expected", [
    ("2013-10-01T07:51:00.000", dt.datetime(2013, 10, 1, 7, 51)),
    ("2013-12-02T00:00:00-05:00", dt.datetime(2013, 12, 2)),
    ("2020-05-01T12:00:00Z", dt.datetime(2020, 5, 1, 12)),
    ("2020-05-01T12:00:00+0530", dt.datetime(2020, 5, 1, 12)),
    ("not a date", None), (None, None), ("", None)])
def test_wall_clock(spark, text, expected):
    assert _one(spark, X.wall_clock, [text]) == [expected]


def test_offset_flag(spark):
    assert _one(spark, X.has_offset, ["2020-01-01T00:00:00Z", "2020-01-01T00:00:00", None]) == [True, False, False]


def test_calendar_and_name(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 7, 4), "NA"), (dt.datetime(2020, 12, 28), "  ")],
                               "ts timestamp_ntz, name string")
    out = X.enrich(df, "ts", name="name").collect()
    assert (out[0].start_month, out[0].start_day_of_week, out[0].start_season, out[0].has_name) == (7, 5, "Summer", True)
    assert (out[1].start_day_of_week, out[1].start_season, out[1].has_name) == (0, "Winter", False)


@pytest.mark.parametrize("days,band", [(-5.0, "under 2mo"), (0.0, "under 2mo"), (59.9, "under 2mo"), (60.0, "2-6mo"),
                                       (365.0, "1-3y"), (2555.0, "7y+"), (None, "unknown")])
def test_age_band(spark, days, band):
    assert _one(spark, X.age_band, [days], "double") == [band]


@pytest.mark.parametrize("p,band", [(0.5, "High"), (0.4, "High"), (0.1, "Elevated"), (0.05, "Standard"),
                                    (0.01, "Fast")])
def test_risk_band(spark, p, band):
    assert _one(spark, X.risk_band, [p], "double") == [band]


def test_display(spark):
    df = spark.createDataFrame([(1.5, True, "x"), (None, None, None), (2.0, False, "y")], "a double, b boolean, c string")
    out = df.select(X.display("a", "double"), X.display("b", "boolean"), X.display("c")).collect()
    assert [tuple(r) for r in out] == [("1.5", "yes", "x"), ("unknown", "unknown", "unknown"), ("2", "no", "y")]


def test_to_number(spark):
    assert _one(spark, X.to_number, ["1.5", " 2 ", "true", "FALSE", "x", None]) == [1.5, 2.0, 1.0, 0.0, None, None]
