"""The pipeline on a small folder of tables: every stage against a plain version of its rule."""
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from dwell.llm import common, quality_cnn, queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def test_stage_order_and_registration():
    import __spark_entry__ as E
    assert [f.__name__ for _, f in P.STAGES] == ["quality", "near_duplicates", "repeated_passages", "personal_data", "pack"]
    names = set(E.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.queries()}


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = common.documents(spark, SF), []
    for name, f in P.STAGES:
        new = common.materialise(f(spark, docs, SF), f"test-{name}")
        out.append((docs, new))
        docs = new
    return out


def test_stages(spark, stages):
    columns = common.documents(spark, SF).columns
    assert all(new.columns == columns for _, new in stages[:-1])
    # near duplicates: one document of each group, and it is the least
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in stages[1])
    def sets(t):
        w = [x.encode().lower() for x in WORDS.findall(t or "")]
        return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    s = {i: sets(t) for i, t in before.items()}
    least = {i: i for i in s}
    for _ in range(6):
        for i in s:
            for j in s:
                if i < j and s[i] and 100 * len(s[i] & s[j]) >= 75 * len(s[i] | s[j]):
                    least[i] = least[j] = min(least[i], least[j])
    assert set(after) == {i for i in s if least[i] == i}
    # passages: no window of 50 words starts in two documents, but for what removal brings together
    first = {}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in stages[2])
    for i in sorted(before):
        w = WORDS.findall(before[i])
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k:k + 50]), i)
    for i, t in before.items():
        w = WORDS.findall(t)
        gone = {p for k in range(len(w) - 49) if first[tuple(w[k:k + 50])] < i for p in range(k, k + 50)}
        assert after[i] == (t if not gone else " ".join(x for p, x in enumerate(w) if p not in gone))
    # personal data: the mail addresses of the input are gone, all else stays
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in stages[3])
    mail = re.compile(r"[\w.]+@mail\d\.example\.com")
    for i, t in before.items():
        for a, b in zip(mail.findall(t), mail.findall(after[i]), strict=True):
            assert len(a) == len(b)
        assert len(after[i].split()) == len(t.split())
    # packing: all tokens of the documents, once
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in after.items():
        ids = np.array(library.encode(t, add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, zlib.crc32(ids[at:at + 2048].tobytes())) for k, at in enumerate(range(0, len(ids), 2048))]
    assert sorted((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[4][1].collect()) == sorted(want)


def test_near_duplicates_choose_rows(spark):
    text = lambda name, n=60: " ".join(f"{name}{k}" for k in range(n))
    a, near = text("a"), text("a", 59) + " other"
    rows = [(5, a, "s"), (5, a, "s"), (5, a, "t"), (5, text("b"), "s"), (3, near, "s"), (7, text("b"), "s"), (8, text("c"), "s"),
            (None, text("d"), "s"), (None, text("d"), "s"), (None, a, "t"), (None, None, "s"), (9, None, "s"), (9, None, "s"), (10, "", "s"), (11, "", "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = sorted((tuple(r) for r in P.near_duplicates(spark, table, "").collect()), key=repr)
    want = [(3, near, "s"), (5, text("b"), "s"), (8, text("c"), "s"), (None, text("d"), "s"), (None, text("d"), "s"), (None, a, "t"), (None, None, "s"),
            (9, None, "s"), (10, "", "s"), (11, "", "s")]
    assert got == sorted(want, key=repr)
    again = spark.createDataFrame([(1, a, "t"), (1, a, "s"), (1, a, "s")], table.schema)
    assert [tuple(r) for r in P.near_duplicates(spark, again, "").collect()] == [(1, a, "s")]


NAMES = ["_row", "_copy", "score", "held_out", "predicted", "n_found", "n_changed", "n_words", "n_removed", "kept_text", "_found", "component_id", "a.b"]


def test_columns_that_clash_pass_every_stage(spark):
    docs = common.documents(spark, SF).withColumns({n: F.lit(f"own {n}") for n in NAMES})
    for name, stage in P.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == docs.columns
        rows = new.collect()
        assert rows and all(r[n] == f"own {n}" for r in rows for n in NAMES), name
        assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_columns_of_the_id_and_text_alone(spark):
    docs = common.documents(spark, SF).select("doc_id", "text")
    for _, stage in P.STAGES[:-1]:
        new = stage(spark, docs, SF)
        assert new.columns == ["doc_id", "text"] and new.count() > 0


def test_no_rows_give_none(spark):
    docs = common.documents(spark, SF).limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_the_quality_stage_keeps_what_the_network_accepts(spark, stages):
    """Held against the network itself, text by text, outside Spark."""
    before, after = stages[0]
    network = quality_cnn.fit(before, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = before.collect()
    scores = [network.score([(r["text"] or "").encode()])[0] for r in rows]
    near = {r["doc_id"] for r, s in zip(rows, scores, strict=True) if abs(s - quality_cnn.THRESHOLD) < 1e-5}
    want = {r["doc_id"] for r, s in zip(rows, scores, strict=True) if s >= quality_cnn.THRESHOLD}
    assert {r["doc_id"] for r in after.collect()} - near == want - near
