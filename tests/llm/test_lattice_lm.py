"""Lattice scores against every segmentation written out, and the counts against plain ones."""
import math
import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest

from dwell.llm import lattice_lm as L

PATH = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, score double, word string, n int, row long"


def segmentations(word, pieces):
    if not word:
        yield ()
    for size in range(1, len(word) + 1):
        if word[:size] in pieces:
            for rest in segmentations(word[size:], pieces):
                yield (word[:size], *rest)


def forward(ways):
    """Log of the summed weight of all ways from 0 to the end; ``ways[i]`` lists (stop, log weight)."""
    alpha = [0.0] + [-math.inf] * len(ways)
    for i, here in enumerate(ways):
        for j, w in here:
            low, high = sorted((alpha[j], alpha[i] + w))
            alpha[j] = high + math.log1p(math.exp(low - high))
    return alpha[-1]


def edges(text, pieces):
    return [[(j, pieces[text[i:j]]) for j in range(i + 1, min(len(text), i + 50) + 1) if text[i:j] in pieces] for i in range(len(text))]


@pytest.mark.parametrize("in_order", [True, False])
def test_forward_sums_all_segmentations(in_order):
    rnd = random.Random(1)
    pieces = {bytes([97 + i]): math.log(0.05 + 0.01 * i) for i in range(4)} | {b"ab": -2.0, b"abc": -3.5, b"bc": -1.5, b"cab": -2.5, b"dd": -0.7, b"abcd": -4.0}
    lattice, uses = L.Lattice(pieces), Counter()
    words = [bytes(rnd.choice(b"abcd") for _ in range(rnd.randrange(1, 11))) for _ in range(300)]
    for word in sorted(words) if in_order else words:
        every = [(s, math.exp(sum(pieces[p] for p in s))) for s in segmentations(word, pieces)]
        total = sum(p for _, p in every)
        assert lattice.enter(word, 3.0) == pytest.approx(math.log(total), abs=1e-9)
        for s, p in every:
            for piece in s:
                uses[piece] += 3 * p / total
    got = lattice.expected()
    assert set(got) == set(uses) and all(got[p] == pytest.approx(uses[p], abs=1e-9) for p in got)


def test_long_words_stay_in_log_space():
    lattice = L.Lattice(L.read_pieces(PATH))
    assert -1e7 < lattice.enter(L.MARK + b"q" * 50_000, 1.0) < -1e4
    assert sum(len(p) * x for p, x in lattice.expected().items()) == pytest.approx(50_003)


def rows():
    rnd = random.Random(3)
    vocabulary = ["The", "the", "house", "house.", "Über", "évidence", "日本語", "x" * 300, "a", "B52", "😀"] + [f"word{i}" for i in range(60)]
    out = [(i, " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "\n", "\t "]) for _ in range(rnd.choice([1, 5, 40])))) for i in range(120)]
    return out + [(200, None), (201, ""), (202, " \n"), (None, "the null id"), (None, None), (3, "unseen elsewhere zzzq"), (3, "unseen elsewhere zzzq"), (9, "house " * 3000)]


def plain(docs, model):
    """The contract, word by word; the probability of a text in one recursion over all of its bytes."""
    parse = lambda t: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))]
    held = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    c = Counter(w for i, t in docs if not held(i) for w in [*parse(t), b""])
    n, v = sum(c.values()), len(c)
    once, twice = (sum(x == k for w, x in c.items() if w) for k in (1, 2))
    d = once / (once + 2 * twice)
    spelt, end = math.log((d * (v - 1) + 1) / (n + 2)), math.log((c[b""] + 1) / (n + 2))
    assert model.end == pytest.approx(end) and model.spelt == pytest.approx(spelt)
    for i, t in docs:
        found = [*parse(t), b""]
        whole = b"".join(L.MARK + w for w in found[:-1])
        ways = edges(whole, model.pieces)
        at = 0
        for w in found[:-1]:
            stop = at + len(L.MARK + w)
            ways[at] = [(j, x + spelt) for j, x in ways[at]] + ([(stop, math.log((c[w] - d) / (n + 2)))] if c[w] else [])
            at = stop
        yield (i, held(i), len(found), sum(c[w] > 0 for w in found), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in found),
               (forward(ways) + end) / math.log(10))


@pytest.mark.parametrize("frequent", [L.FREQUENT, 30, 1])
def test_scores_equal_the_plain_version(spark, frequent):
    df = spark.createDataFrame([(i, t, 0.0, "x", 1, 2) for i, t in rows()], SCHEMA).repartition(4)
    model = L.learn(L.count_words(df), L.read_pieces(PATH))
    assert sum(map(math.exp, model.pieces.values())) == pytest.approx(1.0)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got = sorted((tuple(r) for r in L.score(df, PATH, frequent=frequent).collect()), key=key)
    want = sorted(plain(rows(), model), key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5] and g[5:] == pytest.approx(w[5:], rel=1e-9)


def test_learning_raises_the_training_likelihood(spark):
    df = spark.createDataFrame([(i, t, 0.0, "x", 1, 2) for i, t in rows()], SCHEMA)
    words = [bytes(r["word"]) for r in L.count_words(df).where("c > 0").collect() if r["word"]]

    def total(n):
        lattice = L.Lattice(L.learn(L.count_words(df), L.read_pieces(PATH), rounds=n, prior=1.0).pieces)
        return sum(lattice.enter(L.MARK + w) for w in words)
    assert total(0) < total(1) < total(3)


def test_empty_and_untrained(spark):
    assert L.score(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    out = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    row, = L.score(spark.createDataFrame([(out, "Only held out", 0.0, "", 0, 0)], SCHEMA), PATH).collect()
    assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"], row["base_score"]) == (True, 4, 0, 0, 0.0) and row["score"] < 0
