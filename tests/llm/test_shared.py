"""Hashes counted in groups: tables of bits that hold what occurs twice and nothing else."""
import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from dwell.llm import common, jaccard_join, pii, shared, substring


def numbered(spark, n, words=600):
    """Texts of words that no other text has."""
    return (spark.range(n).withColumnRenamed("id", "doc_id").repartition(6)
            .select("doc_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda k: F.concat(F.lit("w"), (F.col("doc_id") * words + k).cast("string"))), " ").alias("text")))


@pytest.fixture(scope="module")
def many(spark):
    """1.8 million windows that occur once, for tables of a million cells; two texts share all but a word."""
    docs = numbered(spark, 3000)
    near = docs.where("doc_id = 7").select(F.lit(7_000_000).cast("long").alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
    return common.materialise(docs.unionByName(near), "many")


def ones(table):
    return int(np.unpackbits(np.frombuffer(table, np.uint8)).sum())


@pytest.mark.parametrize("groups", [4, 7])
def test_elements_held_once_set_no_bit(spark, many, groups):
    twice, often, held = jaccard_join.sketch(many, 20, groups)
    assert len(twice) == 1 << 17 and len(often) == 1 << 14
    assert 590 <= ones(twice) <= 640 and ones(often) == 0 and held == 2
    own = jaccard_join.Sets([many.where("doc_id = 7").first()["text"]], 5).sets[0]
    cells = (own >> np.uint64(44)).astype(np.int64)
    assert ((np.frombuffer(twice, np.uint8)[cells >> 3] >> (cells & 7)) & 1).all()


@pytest.mark.parametrize("groups", [4, 7])
def test_windows_held_once_set_no_bit(spark, many, groups):
    rows = np.frombuffer(substring.sketch(many, 23, groups=groups), np.uint8).reshape(substring.DEPTH, -1)
    assert all(545 <= ones(r) <= 600 for r in rows)  # a few share a fingerprint by chance
    own = substring.Slice([many.where("doc_id = 7").first()["text"]], 50)
    assert len(own.hashes) == 551 and substring._estimated_twice(own.hashes, 23, rows).all()


def test_full_tables_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MAX_BITS", 16)
    monkeypatch.setattr(jaccard_join, "LEAST_BITS", 16)
    docs = numbered(spark, 400, 60)
    near = docs.where("doc_id % 4 = 0").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text"))
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.components(docs.unionByName(near)).collect()}
    assert got == {i: i for i in range(400)} | {i + 1000: i for i in range(0, 400, 4)}


def test_a_hot_element_is_frequent_and_counted_to_a_bound(spark):
    rows = [(i, "one line of six words here " + " ".join(f"x{i}y{k}" for k in range(40))) for i in range(200)]
    twice, often, held = jaccard_join.sketch(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 20, 4)
    assert ones(twice) == 2 and 1 <= ones(often) <= 2 and 90 <= held <= 96


def test_fingerprints_by_group():
    hashes = np.sort(np.random.default_rng(1).integers(0, 2**64, 5000, dtype=np.uint64))
    for groups in (4, 9):
        rows = shared.fingerprints(hashes, groups).to_pylist()
        assert len({r["part"] for r in rows}) == len(rows)
        back = np.concatenate([(np.uint64(r["part"]) << np.uint64(64 - groups)) | (np.frombuffer(r["cells"], np.uint32).astype(np.uint64) << np.uint64(32 - groups)) for r in rows])
        assert (back == hashes >> np.uint64(32 - groups) << np.uint64(32 - groups)).all()
    one = shared.fingerprints(np.array([5], np.uint64), 4).to_pylist()
    assert len(one) == 1 and one[0]["part"] == 0


def test_word_hashes_tell_words_apart():
    rnd = np.random.default_rng(2)
    texts = [b"", b" \t\n", b"one", b" lead and trail \x0b\x0c\r\n", "é 日本  x  y".encode(), b"\x00 a \x00\x00 a\x00", b"x" * 100 + b" " + b"x" * 101, b"end"]
    texts += [bytes(rnd.choice(list(b"ab \n\x85\xa0"), n)) for n in rnd.integers(0, 400, 60)]
    hashes, counts = common.word_hashes(texts)
    words = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len(hashes) == len(words)
    assert len(set(hashes.tolist())) == len(set(words)) == len(set(zip(words, hashes.tolist(), strict=True)))
    assert [len(x) for x in common.word_hashes([])] == [0, 0] and common.word_hashes([b""])[1].tolist() == [0]


def test_sets_are_those_of_each_text():
    texts = ["a b c d e f a b c d e", "A B C D E F", "one two", "", "a b c d e", "x " * 50]
    own = jaccard_join.Sets(texts, 5)
    assert [len(s) for s in own.sets] == [6, 2, 1, 0, 1, 1] and all((np.diff(s.astype(object)) > 0).all() for s in own.sets)
    assert set(own.sets[1].tolist()) < set(own.sets[0].tolist()) and set(own.sets[4].tolist()) < set(own.sets[1].tolist())
    assert own.digests[0] == xxhash.xxh3_128_digest(own.sets[0].tobytes()) and own.digests[3] is None


PARTS = ["password=", "token: ", "secret: ", "api_key=", "abcdef12", "a" * 32, "ABCDEF" * 6, "AKIA", "BCDEFGHIJKLMNOPQ", "Jo.S", "@", "mail8", ".example", ".com", "GB82", "WEST12345698765432", "10.200.3.4", "1.2.3", "+1 ", "(312) ", "312-",
         "555-2485", "123-45-6789", "1999-02-28", "4111 1111 1111 1111", "4111111111111111", " ", " ", "-", "+", ".", "%", "é", "x", "7"]


def test_kinds_are_found_as_by_their_patterns_side_by_side(spark):
    """What is asked once before several kinds changes no match, and no text with a match is passed by."""
    side_by_side = "|".join(f"{before}(?:{value}){after}" for before, value, after in pii.PATTERNS.values())
    rnd = np.random.default_rng(3)
    texts = ["".join(rnd.choice(PARTS, n)) for n in rnd.integers(1, 9, 6000)]
    want = [[m[0] for m in regex.finditer(side_by_side, t)] for t in texts]
    assert [[m[0] for m in regex.finditer(pii.PATTERN, t)] for t in texts] == want
    table = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    rows = table.select("i", F.regexp_extract_all("t", F.lit(side_by_side), F.lit(0)).alias("was"), F.regexp_extract_all("t", F.lit(pii.PATTERN), F.lit(0)).alias("now"),
                        pii._may_hold(F.col("t")).alias("may")).collect()
    assert all(r["was"] == r["now"] and (r["may"] or not r["was"]) for r in rows) and 1000 < sum(bool(r["was"]) for r in rows)
    assert any(r["was"] and not regex.search("[0-9]", texts[r["i"]]) for r in rows) and not all(r["may"] for r in rows)
