"""Periodic runs against all stretches and periods tried one by one."""
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from dwell.llm import periodic_runs as P

SCHEMA = "doc_id long, text string, runs int, collapsed string, n_words double"


def plain_runs(w):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length, seg = j - i + q, w[i:j + q]
            if j > i and length >= max(12, 2 * q) and not any(all(seg[k] == seg[k + p] for k in range(length - p)) for p in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def sequences(rnd, many, longest):
    for _ in range(many):
        n, letters = rnd.randrange(longest), rnd.choice([1, 2, 2, 3, 6])
        w = [rnd.randrange(letters) for _ in range(n)]
        if n > 5 and rnd.random() < 0.6:
            p, s = rnd.randrange(1, n // 2 + 1), rnd.randrange(n)
            w[s:] = [w[s + i % p] for i in range(n - s)]
        yield w


def test_runs_equal_the_plain_version():
    for w in sequences(random.Random(4), 1500, 70):
        assert P.find_runs(w) == plain_runs(w)


def test_stretches_lose_no_run():
    rnd = random.Random(9)
    for _ in range(60):
        texts = list(sequences(rnd, 12, 60))
        flat = np.array([x * 7919 + 13 for w in texts for x in w], dtype=np.uint64)
        owner = np.repeat(np.arange(len(texts)), [len(w) for w in texts])
        starts, found = np.cumsum([0] + [len(w) for w in texts]), [[] for _ in texts]
        for a, b in P.stretches(flat, owner):
            assert owner[a] == owner[b - 1]
            i = owner[a]
            w = texts[i][a - starts[i]:b - starts[i]]
            found[i] += [(int(a - starts[i]) + s, n, q) for s, n, q in P.find_runs(w)]
        assert [sorted(x, key=lambda r: (r[0], r[2])) for x in found] == [plain_runs(w) for w in texts]


def rows():
    rnd = random.Random(7)
    out = [(i, " ".join(rnd.choice(["a", "b", "The", "é", "x\ty", "\n", " "]) for _ in range(rnd.choice([1, 11, 12, 40, 150])))) for i in range(80)]
    vocabulary = [f"w{i}" for i in range(500)]
    out += [(100 + i, " ".join(rnd.choice(vocabulary) for _ in range(300))) for i in range(40)]
    out += [(200, None), (201, ""), (202, " \t\n"), (203, "na " * 4000), (None, "ab cd " * 9), (None, None), (100, "ab " * 12), (100, "ab " * 11)]
    return out + out[:3]


def plain(doc, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(b"" if doc is None else str(doc).encode())
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w) if len(set(w)) > 1 else [(0, n, 1)] if n >= 12 else []
    best = min(((-length, s, q) for s, length, q in runs), default=None)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (doc, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_query_equals_the_plain_version(spark):
    df = spark.createDataFrame([(i, t, 1, "x", 0.5) for i, t in rows()], SCHEMA).repartition(4)
    key = lambda r: (r[0] is None, r[0] or 0, r[6], r[7])
    got = sorted((tuple(r) for r in P.digests(P.detect(df, P.planted)).collect()), key=key)
    assert got == sorted((plain(i, t) for i, t in rows()), key=key)


def test_spans_and_text_of_the_operator(spark):
    row, = P.detect(spark.createDataFrame([(1, "x " + "a b c " * 5 + "y")], "doc_id int, text string")).collect()
    assert (row["n_words"], row["collapsed"]) == (17, "x a b c y")
    assert [tuple(r) for r in row["runs"]] == [(1, 15, 3)]
    assert P.digests(P.detect(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize("period", [1, 5, 4000])
def test_long_texts(period):
    w = [i % period for i in range(12_000)]
    assert P.find_runs(w) == [(0, 12_000, period)]
