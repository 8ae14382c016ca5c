"""Operator 11: language-model scores by the likelihood of a subword lattice.

The lattice of a text has the pieces of an existing unigram vocabulary, as byte strings, and all 256
single bytes, so that any text can be spelt.  A word, with the word mark before it, may be cut into
pieces in many ways; the probability of its spelling is the sum over all of them, found by one forward
recursion in log space over its bytes.  Beside the spellings a word that the training documents know has
one edge over all of it.  No piece holds a word mark behind its first character, so the lattice of a
text is the chain of the lattices of its words, and its marginal log probability is the sum of theirs
plus that of the end symbol.  Each word of the corpus is therefore recursed once, not once per text.

The weights of the pieces start from the scores of the vocabulary file, which rank them: rank r gets
1 / (r + 1).  They are then learned from the distinct words of the training documents by expectation
maximisation: forward and backward recursions give the expected uses of each piece in each word; their
sums over the corpus, plus the first weights as PRIOR pseudo-uses in all, are the next weights.  The
edge of a word seen c times weighs (c - d) / (N + 2), its spellings together (d W + 1) / (N + 2) times
the spelling's probability, the end symbol (its count + 1) / (N + 2), where W counts the distinct words
and d = n1 / (n1 + 2 n2) follows from the words seen once and twice.  So all texts' probabilities sum to one.

Scale: words are counted per task before they are shuffled; what is gathered is a row per distinct
word of the corpus.  A round of learning sends each task's sums, at most one a piece, and only the
weights (one a piece) reach the driver.  Words with at least 1 / FREQUENT of all tokens number at most
FREQUENT, so their counts and scores are broadcast; any other word is so rare that its rows, joined by
word, cannot fill a task.

Defined results: a null or empty text is the end symbol alone; only A to Z are lower-cased; a null doc_id
counts as the empty id, whose remainder puts it into training; rows that repeat are scored and counted
each; with no training document all counts are 0 and the pieces keep their first weights; an empty table
gives no rows; columns other than doc_id and text are not read.  A word may be long: time and memory
are linear in it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dwell.llm import common

FOLDS, HELD_OUT = 7, 2
ROUNDS = 2
#: Pseudo-uses that the first weights add, in all.
PRIOR = 1000.0
#: Words of at least a share 1 / FREQUENT of the tokens are broadcast; there are at most FREQUENT.
FREQUENT = 1 << 19
#: Distinct words a task holds before it hands on their counts.
HELD_WORDS = 300_000
#: Marks the start of a word in the vocabulary.
MARK = "▁".encode()
#: The end symbol, which no word can equal.
END = b""


def read_pieces(path: str) -> dict[bytes, float]:
    """Pieces of a vocabulary file and their first log weights by rank of score.  Control pieces and
    those with a word mark behind their first character are left out; single bytes are added last."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scored: dict[bytes, float] = {}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).encode()
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or MARK in piece[1:]):
            scored[piece] = max(scored.get(piece, -math.inf), model.get_score(i))
    order = sorted(scored, key=lambda x: (-scored[x], x))
    order += [b for b in (bytes([x]) for x in range(256)) if b not in scored]
    total = sum(1 / (r + 1) for r in range(len(order)))
    return {piece: -math.log((r + 1) * total) for r, piece in enumerate(order)}


class Lattice:
    """All segmentations of words under log weights of pieces.

    Words are entered one after the other.  What is known of a prefix that a word shares with the one
    before is kept, so words in order cost little more than their new bytes.  For each prefix the forward
    recursion gives the log of the summed probability of its segmentations, and the share of each
    piece that may end there.  Once no later word can share a prefix, the expected number of
    segmentations through it, which its longer prefixes have handed down, is dealt by these shares."""

    def __init__(self, weights: dict[bytes, float]):
        import ahocorasick
        self.pieces, self.uses = list(weights), [0.0] * len(weights)
        found = ahocorasick.Automaton()
        for i, (piece, w) in enumerate(weights.items()):
            found.add_word(piece.decode("latin-1"), (len(piece), w, i))
        found.make_automaton()
        self._matches = found.iter
        self._path, self._alpha, self._into, self._mass = "", [0.0], [([], [])], [0.0]

    def _arrive(self, terms: list[float], pieces: list[tuple[int, int]]) -> None:
        top = max(terms)
        shares = [exp(x - top) for x in terms]
        total = sum(shares)
        self._alpha.append(top + log(total))
        self._into.append(([x / total for x in shares], pieces))
        self._mass.append(0.0)

    def enter(self, word: bytes, count: float = 0.0) -> float:
        """The log probability of ``word``; its segmentations are expected ``count`` times."""
        text, shared = word.decode("latin-1"), 0
        for x, y in zip(self._path, text):
            if x != y:
                break
            shared += 1
        self._leave(shared)
        alpha, at, terms, pieces = self._alpha, shared + 1, [], []
        for last, (size, w, i) in self._matches(text):
            if last < shared:
                continue
            if last >= at:  # single bytes are pieces, so every place is met in turn
                self._arrive(terms, pieces)
                at, terms, pieces = at + 1, [], []
            start = last + 1 - size
            terms.append(alpha[start] + w)
            pieces.append((start, i))
        if terms:
            self._arrive(terms, pieces)
        self._mass[-1] += count
        self._path = text
        return alpha[-1]

    def _leave(self, shared: int) -> None:
        mass, uses = self._mass, self.uses
        while len(mass) > shared + 1:
            self._alpha.pop()
            expected = mass.pop()
            for share, (start, i) in zip(*self._into.pop()):
                share *= expected
                mass[start] += share
                uses[i] += share

    def expected(self) -> dict[bytes, float]:
        """Expected uses of the pieces in all words entered."""
        self._leave(0)
        self._path = ""
        return {p: x for p, x in zip(self.pieces, self.uses) if x}


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def words(text: str) -> list[bytes]:
    return text.encode().lower().split()  # bytes: only A to Z change, only 0x20 and 0x09 to 0x0D part


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, tokens, tokens in training documents) per task, the end symbol once a document."""
    every, train = Counter(), Counter()

    def out():
        held = list(every)
        for start in range(0, len(held), common.SLICE_ROWS * 10):
            part = held[start:start + common.SLICE_ROWS * 10]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([every[w] for w in part], pa.int64()),
                                              pa.array([train[w] for w in part], pa.int64())], names=["word", "n", "c"])
        every.clear()
        train.clear()

    for batch in batches:
        for part in common.slices([batch]):
            for text, held in zip(common.texts(part), part.column("held_out").to_pylist()):
                found = words(text)
                found.append(END)
                every.update(found)
                if not held:
                    train.update(found)
            if len(every) > HELD_WORDS:
                yield from out()
    yield from out()


def count_words(docs: DataFrame) -> DataFrame:
    """word, n (tokens in all documents), c (in training documents), written once, in order within a task."""
    found = docs.select("text", held_out().alias("held_out")).mapInArrow(_counts, "word binary, n long, c long")
    return common.materialise(found.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")).sortWithinPartitions("word"), "word-counts")


@dataclass(frozen=True)
class Model:
    """Log weights of the pieces; the discount of a known word's edge; log weights of all spellings
    together and of the end symbol; the tokens that weights of edges are shares of."""

    pieces: dict[bytes, float]
    discount: float
    spelt: float
    end: float
    total: float

    def scorer(self) -> Callable[[bytes, int], float]:
        lattice = Lattice(self.pieces)

        def log_probability(word: bytes, c: int) -> float:
            """Of a word with its count in training documents, or of the end symbol."""
            if not word:
                return self.end
            spelling = self.spelt + lattice.enter(MARK + word)
            if not c:
                return spelling
            edge = log((c - self.discount) / self.total)
            return max(edge, spelling) + math.log1p(exp(-abs(edge - spelling)))
        return log_probability


def learn(counts: DataFrame, pieces: dict[bytes, float], rounds: int = ROUNDS, prior: float = PRIOR) -> Model:
    """The model after ``rounds`` of expectation maximisation over the distinct training words."""
    spark = counts.sparkSession
    first = {p: math.exp(w) for p, w in pieces.items()}
    is_word, c = F.col("word") != F.lit(END), F.col("c")
    tokens, ends, kinds, once, twice = counts.agg(
        *[F.coalesce(x, F.lit(0)) for x in (F.sum(c), F.sum(F.when(~is_word, c)), F.count_if(is_word & (c > 0)), F.count_if(is_word & (c == 1)), F.count_if(is_word & (c == 2)))]).first()
    train = counts.where(is_word & (c > 0)).select("word")
    weights = dict(pieces)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def expected(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(shared.value)
            for batch in batches:
                for word in batch.column("word").to_pylist():
                    lattice.enter(MARK + word, 1.0)
            uses = lattice.expected()
            yield pa.RecordBatch.from_arrays([pa.array(list(uses), pa.binary()), pa.array(list(uses.values()), pa.float64())], names=["piece", "uses"])

        sums = train.mapInArrow(expected, "piece binary, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = {bytes(r["piece"]): r["uses"] for r in sums.collect()}  # at most one row a piece
        shared.unpersist()
        used = math.fsum(uses.values()) + prior
        weights = {p: math.log((uses.get(p, 0.0) + prior * w) / used) for p, w in first.items()}
    discount = min(max(once / (once + 2 * twice), 0.05), 0.95) if once else 0.5
    return Model(weights, discount, math.log((discount * kinds + 1) / (tokens + 2)), math.log((ends + 1) / (tokens + 2)), tokens + 2)


def _scored_words(counts: DataFrame, shared) -> DataFrame:
    """word, n, c and the natural log probability of each distinct word (the end symbol: of itself)."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value.scorer()
        for batch in batches:
            logs = [log_p(w, c) for w, c in zip(batch.column("word").to_pylist(), batch.column("c").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in ("word", "n", "c")), pa.array(logs, pa.float64())], names=["word", "n", "c", "log_p"])
    return common.materialise(counts.mapInArrow(scored, "word binary, n long, c long, log_p double"), "word-scores")


def score(docs: DataFrame, path: str, rounds: int = ROUNDS, prior: float = PRIOR, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    counts = count_words(docs)
    totals = counts.agg(F.sum("n").alias("all"), F.sum("c").alias("train"), F.count_if(F.col("c") > 0).alias("kinds")).first()
    tokens, train, kinds = totals["all"] or 0, totals["train"] or 0, totals["kinds"] or 0
    base = math.log(train + kinds + 1)
    shared = spark.sparkContext.broadcast(learn(counts, read_pieces(path), rounds, prior))
    table = _scored_words(counts, shared)
    common_words = F.col("n") * frequent >= F.lit(tokens)
    often = table.where(common_words).select("word", "c", "log_p").collect()  # at most ``frequent``
    values = np.array([(log(r["c"] + 1) - base, r["log_p"], r["c"] > 0) for r in often], dtype=np.float64).reshape(-1, 3)
    known = spark.sparkContext.broadcast(([bytes(r["word"]) for r in often], values))
    pair = pa.struct([("word", pa.binary()), ("k", pa.int64())])

    def known_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per document the sums over its frequent words; its other words with their counts."""
        held, values = known.value
        number = {w: i for i, w in enumerate(held)}
        for batch in batches:
            for part in common.slices([batch]):
                sums, sizes, rare, times, ends = [], [], [], [], [0]
                for text in common.texts(part):
                    found = words(text)
                    found.append(END)
                    places = list(map(number.get, found))
                    if None in places:
                        others = Counter([w for w, x in zip(found, places) if x is None])
                        rare.extend(others)
                        times.extend(others.values())
                        places = [x for x in places if x is not None]
                    ends.append(len(rare))
                    sizes.append(len(found))
                    sums.append(values[places].sum(axis=0))
                sums = np.array(sums).reshape(-1, 3)
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(times, pa.int64())], fields=list(pair)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(sizes, pa.int64()), pa.array(sums[:, 2].astype(np.int64)), pa.array(sums[:, 0]), pa.array(sums[:, 1]), rest],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base", "log_p", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = docs.select("doc_id", "text", held_out().alias("held_out")).mapInArrow(
        known_part, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, log_p double, rare array<struct<word:binary,k:long>>")
    parts = common.materialise(parts.withColumn("row", F.monotonically_increasing_id()), "known-words")
    rare = parts.where("size(rare) > 0").select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.k")
    # written before the join: a row of the table is a word, never one of the frequent
    met = rare.join(table.where(~common_words).select("word", "c", "log_p"), "word")
    more = met.groupBy("row").agg(F.sum(F.col("k") * (F.log(F.col("c") + 1.0) - F.lit(base))).alias("more_base"), F.sum(F.col("k") * F.col("log_p")).alias("more_log_p"),
                                  F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"))
    ten = math.log(10)
    add = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return parts.drop("rare").join(more, "row", "left").select(
        "doc_id", "held_out", "n_tokens", add("n_known", "more_known").cast("long").alias("n_known"), F.lit(train).cast("long").alias("train_tokens"),
        (add("base", "more_base") / ten).alias("base_score"), (add("log_p", "more_log_p") / ten).alias("score"))
