"""Scalar functions F1-F20 as native Column expressions (whole-stage codegen, no UDF).

They work on batch and streaming frames alike, so training, evaluation and
scoring share one code path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for identical results.
# ---------------------------------------------------------------------------
TZ_SUFFIX_PATTERN = r"(?:Z|[+-]\d{2}:?\d{2})\s*$"
AGE_PATTERN = r"(?i)^\s*(-?\d+)\s*(day|week|month|year)s?\s*$"
DAYS_PER_UNIT = {"day": 1.0, "week": 7.0, "month": 365.25 / 12.0, "year": 365.25}
SEASONS = {12: "Winter", 1: "Winter", 2: "Winter",
           3: "Spring", 4: "Spring", 5: "Spring",
           6: "Summer", 7: "Summer", 8: "Summer",
           9: "Fall", 10: "Fall", 11: "Fall"}
AGE_BAND_EDGES = [60, 180, 365, 1095, 2555]
AGE_BAND_LABELS = ["under 2mo", "2-6mo", "6-12mo", "1-3y", "3-7y", "7y+"]
AGE_BAND_UNKNOWN = "unknown"
RISK_BANDS = [(0.40, "High"), (0.10, "Elevated"), (0.02, "Standard")]
RISK_BAND_LOWEST = "Fast"
# ---------------------------------------------------------------------------


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def strip(col: str | Column) -> Column:
    """Whitespace strip on both ends (all whitespace, not only spaces)."""
    return F.regexp_replace(_c(col), r"^\s+|\s+$", "")


def blank_to_null(col: str | Column) -> Column:
    """Strip; empty becomes null."""
    return F.nullif(strip(col), F.lit(""))


# F1 -------------------------------------------------------------------------
def wall_clock(col: str | Column) -> Column:
    """Text timestamp -> TIMESTAMP_NTZ keeping the written wall clock: a trailing
    ``Z`` / ``+hh:mm`` / ``-hhmm`` is removed, not applied.  Unparseable -> null."""
    text = F.regexp_replace(strip(col), TZ_SUFFIX_PATTERN, "")
    return F.nullif(text, F.lit("")).try_cast("timestamp_ntz")


def has_offset(col: str | Column) -> Column:
    """A36 helper: the raw text carries a zone suffix."""
    return F.coalesce(strip(col).rlike(TZ_SUFFIX_PATTERN), F.lit(False))


# F2 -------------------------------------------------------------------------
def age_days(col: str | Column) -> Column:
    """``"2 years"`` -> 730.5; negative, malformed or null -> null."""
    text = _c(col).cast("string")
    matched = F.coalesce(text.rlike(AGE_PATTERN), F.lit(False))
    value = F.regexp_extract(text, AGE_PATTERN, 1).try_cast("long")
    unit = F.lower(F.regexp_extract(text, AGE_PATTERN, 2))
    per_unit = F.create_map(*[x for k, v in DAYS_PER_UNIT.items() for x in (F.lit(k), F.lit(v))])
    return F.when(matched & (value >= 0), value.cast("double") * per_unit[unit])


# F3 -------------------------------------------------------------------------
def breed_parts(col: str | Column) -> tuple[Column, Column]:
    """(primary, is_mix): mix when ``/`` or the word *mix* appears; primary is the
    part before ``/`` without a trailing *mix*; blank -> (null, null)."""
    text = blank_to_null(col)
    is_mix = text.contains("/") | text.rlike(r"(?i)\bmix\b")
    first = F.split_part(text, F.lit("/"), F.lit(1))
    primary = F.nullif(strip(F.regexp_replace(first, r"(?i)\s*\bmix\b\s*$", "")), F.lit(""))
    return primary, F.when(text.isNotNull(), is_mix)


# F4 -------------------------------------------------------------------------
def color_parts(col: str | Column) -> tuple[Column, Column]:
    """(primary, is_black): primary before ``/``; black is an exact, case-free match."""
    text = blank_to_null(col)
    first = strip(F.split_part(text, F.lit("/"), F.lit(1)))
    return F.nullif(first, F.lit("")), F.when(text.isNotNull(), F.lower(first) == F.lit("black"))


# F5 / F18 -------------------------------------------------------------------
def sex_parts(col: str | Column) -> tuple[Column, Column]:
    """("Neutered Male") -> ("Male", "Fixed"); null/blank -> ("Unknown", "Unknown")."""
    low = F.lower(blank_to_null(col))
    sex = (F.when(low.contains("female"), F.lit("Female"))
           .when(low.contains("male"), F.lit("Male"))
           .otherwise(F.lit("Unknown")))
    return sex, sterilisation_status(col)


def sterilisation_status(col: str | Column) -> Column:
    low = F.lower(blank_to_null(col))
    return (F.when(low.contains("neutered") | low.contains("spayed"), F.lit("Fixed"))
            .when(low.contains("intact"), F.lit("Intact"))
            .otherwise(F.lit("Unknown")))


# F6 -------------------------------------------------------------------------
def season(month: str | Column) -> Column:
    m = F.create_map(*[x for k, v in SEASONS.items() for x in (F.lit(k), F.lit(v))])
    return m[_c(month).cast("int")]


# F7 / F17 -------------------------------------------------------------------
def has_text(col: str | Column) -> Column:
    return F.coalesce(F.length(strip(col)) > 0, F.lit(False))


def starts_with_ci(col: str | Column, prefix: str) -> Column:
    return F.coalesce(F.lower(_c(col)).startswith(prefix.lower()), F.lit(False))


# F8 -------------------------------------------------------------------------
def month_of(ts: str | Column) -> Column:
    return F.month(_c(ts))


def weekday_of(ts: str | Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(_c(ts))


# F9 - F13 -------------------------------------------------------------------
def age_band(days: str | Column) -> Column:
    """Left-closed bands; below the first edge (negatives too) -> first label."""
    d = _c(days)
    expr = F.when(d.isNull() | F.isnan(d), F.lit(AGE_BAND_UNKNOWN))
    for edge, label in zip(AGE_BAND_EDGES, AGE_BAND_LABELS):
        expr = expr.when(d < F.lit(float(edge)), F.lit(label))
    return expr.otherwise(F.lit(AGE_BAND_LABELS[-1]))


def clip_days(col: str | Column, lo: float = 0.0, hi: float = 365.0) -> Column:
    c = _c(col)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def is_long(days: str | Column, threshold: float = 90.0) -> Column:
    return (_c(days) >= F.lit(threshold)).cast("int")


def risk_band(p: str | Column) -> Column:
    c = _c(p)
    expr = None
    for cut, label in RISK_BANDS:
        expr = (F.when(c >= F.lit(cut), F.lit(label)) if expr is None
                else expr.when(c >= F.lit(cut), F.lit(label)))
    return expr.otherwise(F.lit(RISK_BAND_LOWEST))


def flag(col: str | Column) -> Column:
    """Null -> false."""
    return F.coalesce(_c(col).cast("boolean"), F.lit(False))


def to_number(col: str | Column) -> Column:
    """numeric coercion; booleans -> 1.0 / 0.0; unparseable -> null."""
    text = F.lower(strip(_c(col).cast("string")))
    return (F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0))
            .otherwise(text.try_cast("double")))


# F14 / F15 ------------------------------------------------------------------
def six_digits(col: str | Column) -> Column:
    """A number as C's ``%g`` prints it: six significant digits, trailing zeros cut, with an
    exponent below 1e-4 and from 1e6 on.  Java rounds the shortest decimal text half up, C the
    binary value half to even; from 1 to 1e6 a text that ends in a tie is rounded as C does."""
    c = _c(col).cast("double")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))

    def parts(text: Column) -> tuple[Column, Column]:
        return (F.regexp_replace(F.regexp_extract(text, r"^-?([0-9.]+)e", 1), r"\.", ""),
                F.regexp_extract(text, r"e([+-][0-9]+)$", 1).cast("int"))

    rounded, up_power = parts(F.format_string("%.5e", c))
    seven_text = F.format_string("%.6e", c)
    seven, down_power = parts(seven_text)
    size = F.abs(c)
    tie = seven.endswith("5") & (seven_text.cast("double") == c) & (size >= 1) & (size < 1_000_000)
    # the exact fraction in units of 2^-52 against the decimal one, as whole numbers
    binary = ((size - F.floor(size)) * F.lit(float(2 ** 52))).cast("decimal(16,0)")
    decimal = F.substr(seven, down_power + 2).cast("decimal(7,0)")
    scale = F.pow(F.lit(10.0), 6 - down_power).cast("decimal(8,0)")
    above = binary * scale - decimal * F.lit(2 ** 52).cast("decimal(16,0)")
    down = tie & ((above < 0) | ((above == 0) & F.substr(seven, F.lit(6), F.lit(1)).isin("0", "2", "4", "6", "8")))
    digits = F.when(down, F.substr(seven, F.lit(1), F.lit(6))).otherwise(rounded)
    power = F.when(down, down_power).otherwise(up_power)

    def cut(text: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    plain = (F.when(power >= 5, digits)
             .when(power >= 0, cut(F.concat(F.substr(digits, F.lit(1), power + 1), F.lit("."), F.substr(digits, power + 2))))
             .otherwise(cut(F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits))))
    lead = cut(F.concat(F.substr(digits, F.lit(1), F.lit(1)), F.lit("."), F.substr(digits, F.lit(2))))
    scaled = F.concat(lead, F.lit("e"), F.when(power < 0, F.lit("-")).otherwise(F.lit("+")), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return F.when(c == 0, F.lit("0")).otherwise(F.concat(sign, F.when((power < -4) | (power >= 6), scaled).otherwise(plain)))


def display(col: str | Column, dtype: str = "string") -> Column:
    """null -> "unknown", boolean -> yes/no, number -> six significant digits."""
    c = _c(col)
    if dtype == "boolean":
        text = F.when(c, F.lit("yes")).otherwise(F.lit("no"))
    elif dtype in ("double", "float", "int", "bigint", "long"):
        text = six_digits(c)
    else:
        text = c.cast("string")
    return F.when(c.isNull(), F.lit("unknown")).otherwise(text)


def reliability_message(group: str | Column, reliable: str | Column, lift: str | Column, pr_auc: str | Column,
                        base_rate: str | Column, min_lift: str | Column) -> Column:
    """one sentence per row with the group's figures, three cases (not measured, reliable, not)."""
    g, r, lf = F.coalesce(_c(group).cast("string"), F.lit("unknown")), _c(reliable), _c(lift)
    ap, base, least = _c(pr_auc), _c(base_rate) * 100, _c(min_lift)
    return (F.when(r.isNull(), F.format_string("No reliability figures for %s: the score is unverified.", g))
            .when(r, F.format_string(
                "Ranking for %s is reliable: %.1f times better than chance (PR-AUC %.3f, base rate %.1f%%).", g, lf, ap, base))
            .otherwise(F.format_string(
                "Ranking for %s is weak: PR-AUC %.3f at a base rate of %.1f%%, %.2f times chance and below the %.1f "
                "held usable; treat the score as a guess.", g, ap, base, lf, least)))


def day_estimate_caveat(r2: float | None) -> Column:
    """The sentence beside every day estimate, with the model's R2 where it was measured."""
    if r2 is None:
        return F.lit("Indicative only: the day estimate has not been measured on held-out rows.")
    return F.lit(f"Indicative only: on these features the day estimate does no better than a constant (R2 = {r2:.3f})."
                 if r2 <= 0 else f"Indicative only: the day estimate explains a part of the variation (R2 = {r2:.3f}).")


# F20 ------------------------------------------------------------------------
def enrich(df: DataFrame, ts: str, name: str | None = None, age_text: str | None = None,
           breed: str | None = None, color: str | None = None, sex: str | None = None) -> DataFrame:
    """All start-time features in one projection (same path for training and scoring)."""
    cols: dict[str, Column] = {}
    if age_text:
        cols["age_days"] = age_days(age_text)
    if breed:
        p, m = breed_parts(breed)
        cols["primary_breed"], cols["is_mix"] = p, m
    if color:
        p, b = color_parts(color)
        cols["primary_color"], cols["is_black"] = p, b
    if sex:
        s, st = sex_parts(sex)
        cols["sex"], cols["sterilization_status"] = s, st
    if name:
        cols["has_name"] = has_text(name)
    cols["start_month"] = month_of(ts)
    cols["start_day_of_week"] = weekday_of(ts)
    cols["start_season"] = season(month_of(ts))
    return df.withColumns(cols)
