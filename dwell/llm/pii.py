"""Operator 10: format-preserving pseudonyms for personal data, in DataFrame functions only.

Each personal value found in a text and validated is replaced by another value of the same format,
chosen by a keyed permutation (an unbalanced Feistel network) of that format's values.  Equal
values get equal pseudonyms everywhere, so records stay linked across documents, and who holds
the key can invert the permutation.  There is no table of values and no shuffle.

Kinds, and what stays as it was:
  email      letters (case kept) and digits of the part before @ are permuted; the domain stays
  card       13 to 19 digits that pass the Luhn check: all but the last are permuted, the last
             is computed anew, so the pseudonym passes the check too
  ssn        ddd-dd-dddd with a valid area and group: digits permuted within valid ranges' digits
  phone      +c (ddd) ddd-dddd and ddd-ddd-dddd: the ten digits are permuted
  ip         a.b.c.d with octets to 255: a permutation of the 32-bit address
  iban       two letters, two check digits, 11 to 30 letters and digits that pass mod 97: the
             account part is permuted, the check digits are computed anew
  date       yyyy-mm-dd, a real day of 1900 to 2099: a permutation of the days of these years
  key        32 and more hex digits, or AKIA and 16 letters or digits: permuted by class
  secret     8 and more letters and digits after password=, token=, secret= or api_key=; after a colon
             in place of the equals sign, only values with a digit, which tells them from prose.  A
             value that is of another kind keeps that kind's pseudonym, so it stays linked

A permutation may map a value to itself; the last digit then tells nothing either, as for any
pseudonym.  Numbers that fail their check are left alone.  Mail names, hex values and secrets may be of any length;
their patterns take a run of characters whole, so a text is read in linear time.

Defined results: a null text stays null; an empty text stays empty; a text may be of any length;
rows that repeat get equal results; all other columns pass through as they are, whatever their names, but
for columns named as the two results, which the results replace; an empty table gives no rows.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.llm import common

#: The session's setting that holds the key.
KEY_SETTING = "spark.dwell.pseudonym.key"
_OWN_KEY: list[str] = []

#: Rounds of the network.
ROUNDS = 4
#: Days of 1900 to 2099 are 4297 times 17, so a day is a pair (a, b) and no cycle-walking is needed.
_DAYS_A, _DAYS_B = 4297, 17

#: One pattern per kind, in order of precedence: what stands before, the value, what follows.
#: Java regular expressions.
PATTERNS = {
    "secret": ("", r"(?:password|token|secret|api_key)(?:=|: ?(?=[A-Za-z]*+[0-9]))[A-Za-z0-9]{8,}+", r"(?![A-Za-z0-9._%+\-]*+@)"),
    "email": (r"(?<![A-Za-z0-9._%+\-])", r"[A-Za-z0-9._%+\-]++@(?:[A-Za-z0-9\-]{1,63}\.){1,8}[A-Za-z]{2,24}", ""),
    "key": (r"(?<![A-Za-z0-9])", r"[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[A-Z0-9]{16}", r"(?![A-Za-z0-9])"),
    "iban": (r"(?<![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"(?![A-Za-z0-9])"),
    "ip": (r"(?<![0-9.])", r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}", r"(?![0-9]|\.[0-9])"),
    "phone": (r"(?<![0-9+])", r"(?:\+[0-9]{1,3}[ \-])?(?:\([0-9]{3}\) ?|[0-9]{3}[\-. ])[0-9]{3}[\-. ][0-9]{4}", r"(?![0-9])"),
    "ssn": (r"(?<![0-9\-])", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"(?![0-9\-])"),
    "date": (r"(?<![0-9\-])", r"(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}", r"(?![0-9\-])"),
    "card": (r"(?<![0-9\-])", r"[0-9](?:[ \-]?[0-9]){12,18}", r"(?![0-9\-])"),
}


def _any_of(*kinds: str) -> str:
    return "|".join("{}(?:{}){}".format(*PATTERNS[k]) for k in kinds)


#: All kinds in their order.  What kinds side by side ask of their first place is asked once before them, so
#: that at most places inside words three tests fail instead of nine patterns.
PATTERN = (f"(?=[apst]){_any_of('secret')}"
           rf"|(?<![A-Za-z0-9])(?=[A-Za-z0-9._%+\-])(?:{_any_of('email', 'key', 'iban')})"
           f"|(?=[0123456789+(])(?:{_any_of('ip', 'phone', 'ssn', 'date', 'card')})")


def _let(value: Column, then) -> Column:
    """Bind a value once: ``then`` gets it as a variable, so nested use does not repeat its work."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _fold(value: Column, steps: list) -> Column:
    """Apply steps one after the other, each bound once."""
    out = value
    for step in steps:
        out = _let(out, step)
    return out


def _rounds(step) -> list:
    """One function of the state alone for each round."""
    def at(k: int):
        return lambda state: step(k, state)
    return [at(k) for k in range(ROUNDS)]


def _stream(key: str, kind: str, round_: int, half: Column) -> Column:
    """Hex digits of the round function: SHA-512 and, for long values, more of it by counter."""
    base = F.concat(F.lit(f"{key}|{kind}|{round_}|"), half)
    return F.concat(F.sha2(base, 512), F.sha2(F.concat(base, F.lit("|2")), 512))


def _number(stream: Column, at: Column, digits: int = 2) -> Column:
    """``digits`` hex digits of a stream as a number; the stream repeats beyond its end."""
    return F.conv(F.substr(stream, F.pmod(at * digits, F.lit(256 - digits)) + 1, F.lit(digits)), 16, 10).cast("long")


def _shift(char: Column, by: Column) -> Column:
    """Move a character within its class: digits, small letters or capitals."""
    code = F.ascii(char)
    def turn(first: int, size: int) -> Column:
        return F.chr(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
    return (F.when((code >= 48) & (code <= 57), turn(48, 10)).when((code >= 97) & (code <= 122), turn(97, 26))
            .when((code >= 65) & (code <= 90), turn(65, 26)).otherwise(char))


def _shift_hex(char: Column, by: Column) -> Column:
    """The same for hex digits: letters stay within a to f."""
    code = F.ascii(char)
    def turn(first: int, size: int) -> Column:
        return F.chr(F.lit(first) + F.pmod(code - first + by, F.lit(size)))
    return F.when((code >= 48) & (code <= 57), turn(48, 10)).when((code >= 97) & (code <= 102), turn(97, 6)).when((code >= 65) & (code <= 70), turn(65, 6)).otherwise(char)


def _feistel_text(value: Column, key: str, kind: str, shift=_shift) -> Column:
    """A Feistel network over the characters: each half is moved, character by character within
    its class, by a keyed function of the other.  Length and class at every place are kept."""
    def round_(k: int, state: Column) -> Column:
        moved = "a" if k % 2 == 0 else "b"
        other = "b" if moved == "a" else "a"
        new = _let(_stream(key, kind, k, state[other]), lambda s: F.array_join(
            F.transform(F.split(state[moved], ""), lambda c, i: shift(c, _number(s, i))), ""))
        a, b = (new, state["b"]) if moved == "a" else (state["a"], new)
        return F.struct(a.alias("a"), b.alias("b"))

    half = lambda v: F.floor(F.length(v) / 2).cast("int")
    start = _let(value, lambda v: F.struct(F.substr(v, F.lit(1), half(v)).alias("a"), F.substr(v, half(v) + 1).alias("b")))
    return _let(_fold(start, _rounds(round_)), lambda s: F.concat(s["a"], s["b"]))


def _feistel_pair(a: Column, b: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """A Feistel network over a pair of numbers below ``sizes``; returns the struct (a, b)."""
    def round_(k: int, state: Column) -> Column:
        moved, other, size = ("a", "b", sizes[0]) if k % 2 == 0 else ("b", "a", sizes[1])
        new = F.pmod(state[moved] + _number(_stream(key, kind, k, state[other].cast("string")), F.lit(0), 12), F.lit(size))
        x, y = (new, state["b"]) if moved == "a" else (state["a"], new)
        return F.struct(x.cast("long").alias("a"), y.cast("long").alias("b"))

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    return _fold(start, _rounds(round_))


def _luhn_sum(digits: Column, first_double: int) -> Column:
    """The Luhn sum of a digit text, read from the right; ``first_double`` 1: the last digit is not
    doubled (a whole number), 0: it is (a number without its check digit)."""
    def value(c: Column, i: Column) -> Column:
        v = c.cast("int") * F.when(F.pmod(i, F.lit(2)) == first_double, 2).otherwise(1)
        return F.when(v > 9, v - 9).otherwise(v)
    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda a, x: a + x)


def _refill(value: Column, digits: Column) -> Column:
    """Put digits into the places of the digits of ``value``, left to right."""
    filled = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), lambda s, c: F.when(
        c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))))
    return filled["out"]


def _card(value: Column, key: str) -> Column:
    def from_body(digits: Column) -> Column:
        body = _feistel_text(F.substr(digits, F.lit(1), F.length(digits) - 1), key, "card")
        return _let(body, lambda b: F.concat(b, F.pmod(F.lit(10) - F.pmod(_luhn_sum(b, 0), F.lit(10)), F.lit(10)).cast("string")))
    return _let(F.regexp_replace(value, "[^0-9]", ""), lambda d: F.when(
        F.pmod(_luhn_sum(d, 1), F.lit(10)) == 0, _refill(value, from_body(d))).otherwise(value))


def _ip(value: Column, key: str) -> Column:
    def pseudonym(o: Column) -> Column:
        pair = _feistel_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ip")
        octet = lambda x: F.concat(F.floor(x / 256).cast("string"), F.lit("."), F.pmod(x, F.lit(256)).cast("string"))
        return _let(pair, lambda p: F.concat(octet(p["a"]), F.lit("."), octet(p["b"])))
    octets = F.split(value, "\\.").cast("array<int>")
    return _let(octets, lambda o: F.when(F.forall(o, lambda x: x <= 255), pseudonym(o)).otherwise(value))


def _date(value: Column, key: str) -> Column:
    day = F.datediff(F.try_to_date(value, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))
    def pseudonym(d: Column) -> Column:
        pair = _feistel_pair(F.floor(d / _DAYS_B), F.pmod(d, F.lit(_DAYS_B)), (_DAYS_A, _DAYS_B), key, "date")
        return _let(pair, lambda p: F.date_add(F.lit("1900-01-01").cast("date"), (p["a"] * _DAYS_B + p["b"]).cast("int")).cast("string"))
    return _let(day, lambda d: F.when(d.isNull() | (d < 0) | (d >= _DAYS_A * _DAYS_B), value).otherwise(pseudonym(d)))


def _mod97(text: Column) -> Column:
    """Mod 97 of an IBAN's characters, letters counting 10 to 35."""
    return F.aggregate(F.split(text, ""), F.lit(0).cast("int"), lambda a, c: F.when(
        c.rlike("[0-9]"), F.pmod(a * 10 + F.ascii(c) - 48, F.lit(97))).otherwise(F.pmod(a * 100 + F.ascii(c) - 55, F.lit(97))).cast("int"))


def _iban(value: Column, key: str) -> Column:
    country = F.substr(value, F.lit(1), F.lit(2))
    body = F.substr(value, F.lit(5))
    def pseudonym(b: Column) -> Column:
        check = F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))
        return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)
    valid = _mod97(F.concat(body, F.substr(value, F.lit(1), F.lit(4)))) == 1
    return F.when(valid, _let(_feistel_text(body, key, "iban"), pseudonym)).otherwise(value)


def _phone(value: Column, key: str) -> Column:
    """The last ten digits; the country code stays."""
    def pseudonym(d: Column) -> Column:
        lead = F.substr(d, F.lit(1), F.length(d) - 10)
        return _refill(value, F.concat(lead, _feistel_text(F.substr(d, F.length(d) - 9), key, "phone")))
    return _let(F.regexp_replace(value, "[^0-9]", ""), pseudonym)


def _ssn(value: Column, key: str) -> Column:
    """Area 001 to 665 and 667 to 899, group and serial not zero."""
    valid = value.rlike("^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$")
    def pseudonym(p: Column) -> Column:
        # areas are 898 values, groups 99, serials 9999: numbered from 0 and permuted as a pair
        area = F.when(p[0] > 666, p[0] - 2).otherwise(p[0] - 1)
        pair = _feistel_pair(area, (p[1] - 1) * 9999 + p[2] - 1, (898, 99 * 9999), key, "ssn")
        def text(x: Column) -> Column:
            number = F.when(x["a"] >= 665, x["a"] + 2).otherwise(x["a"] + 1)
            return F.concat(F.lpad(number.cast("string"), 3, "0"), F.lit("-"),
                            F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"), F.lit("-"),
                            F.lpad((F.pmod(x["b"], F.lit(9999)) + 1).cast("string"), 4, "0"))
        return _let(pair, text)
    return F.when(valid, _let(F.split(value, "-").cast("array<long>"), pseudonym)).otherwise(value)


def _email(value: Column, key: str) -> Column:
    """Marks before the first letter or digit are no part of the name."""
    lead = F.regexp_extract(value, r"^[._%+\-]*+", 0)
    parts = F.split(F.substr(value, F.length(lead) + 1), "@")
    return F.concat(lead, _feistel_text(F.get(parts, F.lit(0)), key, "email"), F.lit("@"), F.get(parts, F.lit(1)))


def _key(value: Column, key: str) -> Column:
    hexa = value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return (F.when(hexa, _feistel_text(value, key, "key", _shift_hex))
            .when(F.startswith(value, F.lit("AKIA")), F.concat(F.lit("AKIA"), _feistel_text(F.substr(value, F.lit(5)), key, "key")))
            .otherwise(_feistel_text(value, key, "key")))


_KINDS = {"email": _email, "key": _key, "iban": _iban, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _date, "card": _card}


def _by_kind(value: Column, key: str) -> Column:
    out = F.when(F.lit(False), value)
    for kind, change in _KINDS.items():
        out = out.when(value.rlike(f"^(?:{PATTERNS[kind][1]})$"), change(value, key))
    return out.otherwise(value)


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value, by the first kind it matches whole.  A secret is the value behind
    its name; where that is of no other valid kind, it is permuted by class."""
    name = F.when(value.rlike(f"^(?:{PATTERNS['secret'][1]})$"), F.regexp_extract(value, "^[a-z_]+(?:=|: ?)", 0)).otherwise("")
    def change(n: Column, v: Column) -> Column:
        return _let(_by_kind(v, key), lambda p: F.concat(n, F.when((n != "") & (p == v), _key(v, key)).otherwise(p)))
    return _let(name, lambda n: _let(F.substr(value, F.length(n) + 1), lambda v: change(n, v)))


def session_key(spark: SparkSession) -> str:
    """The key that the session's setting names.  Where it is unset, a random one that lives as long as
    this driver: equal values are linked within its runs, and nobody can invert them later."""
    if not _OWN_KEY:
        _OWN_KEY.append(secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING, _OWN_KEY[0])


def _may_hold(text: Column) -> Column:
    """False only where no kind can match: all need a digit, @, = or :, but for a key of letters alone."""
    return text.rlike("[0123456789@=:]") | F.contains(text, F.lit("AKIA")) | text.rlike("[a-f]{32}|[A-F]{32}")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text_col``, and ``n_found`` and ``n_changed`` (long) besides.
    ``key`` is the secret that decides them and must not be empty."""
    if not key:
        raise ValueError("a key is needed: without a secret anybody could invert the pseudonyms")
    found, new, between = (common.fresh(docs, x) for x in ("found", "new", "between"))
    text = F.col(text_col)
    out = (docs.withColumn(found, F.when(_may_hold(text), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
                           .otherwise(F.array().cast("array<string>")))
           .withColumn(new, F.transform(found, lambda v: pseudonym(v, key)))
           .withColumn(between, F.when(F.size(found) > 0, F.split(text, PATTERN, -1))))
    joined = F.array_join(F.zip_with(between, F.concat(new, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    changed = F.size(F.filter(F.zip_with(found, new, lambda a, b: a != b), lambda x: x))
    return (out.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(text))
            .withColumn("n_found", F.size(found).cast("long")).withColumn("n_changed", changed.cast("long"))
            .drop(found, new, between))
