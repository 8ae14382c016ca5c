"""Operator 6: quality classifier, a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it.  In each chunk learned
filters slide over embedded bytes, each filter's strongest answer is kept (max-pooling), and a
small dense layer turns the answers into a logit.  The logits of all chunks are averaged and
passed through the logistic function: one probability per text.

The network is fitted on a bounded, documented sample: of the labelled rows that may be learned
from, the SAMPLE_PER_LABEL of each label that come first by a hash of the id, each of these texts
whole.  Scoring reads every byte of every text.  Both hold BLOCK chunks' windows at a time.

Defined results: a null or empty text is one chunk of padding and gets a score as any other; with
no usable label the score is 0.5, with one kind of label only it is that label; a document labelled
twice counts with its greater label; labels other than 0 and 1 are not used; rows that repeat get
equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwell.llm import common

#: Most rows of a label that the fit reads.
SAMPLE_PER_LABEL = 1500
#: Bytes in a chunk, and by how many the next chunk starts later.
CHUNK, STEP = 512, 448
#: Size of a byte's embedding, width and stride of a filter, filters, hidden units.
EMBED, WIDTH, STRIDE, FILTERS, HIDDEN = 8, 8, 2, 32, 16
EPOCHS, BATCH, RATE, SEED = 8, 48, 0.004, 11
THRESHOLD = 0.3
#: Chunks whose windows are held at once.
BLOCK = 128
#: Folds by checksum of the id; fold 0 is held out.
FOLDS = 5


def fold(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(FOLDS))


def cut(data: bytes) -> np.ndarray:
    """All chunks of a text, the last padded with zeros."""
    n = max(1, -(-(len(data) - (CHUNK - STEP)) // STEP))
    padded = np.zeros((n - 1) * STEP + CHUNK, dtype=np.uint8)
    padded[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::STEP]


class Network:
    def __init__(self, weights: dict[str, np.ndarray] | None = None, constant: float | None = None):
        rng = np.random.default_rng(SEED)
        normal = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        self.constant = constant
        self.w = weights or {
            "embed": rng.normal(0, 0.5, (256, EMBED)).astype(np.float32), "filters": normal(WIDTH * EMBED, FILTERS),
            "filter_bias": np.zeros(FILTERS, np.float32), "dense": normal(FILTERS, HIDDEN),
            "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, 1)[:, 0], "out_bias": np.zeros(1, np.float32)}

    def _windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, places, WIDTH * EMBED): the embedded bytes under each place of the filters."""
        embedded = self.w["embed"][chunks].reshape(len(chunks), -1)
        return np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]

    def _forward(self, chunks: np.ndarray) -> tuple:
        w, windows = self.w, self._windows(chunks)
        n, places = windows.shape[:2]
        answers = (windows.reshape(n * places, -1) @ w["filters"]).reshape(n, places, FILTERS)
        at = answers.argmax(axis=1)
        pooled = np.maximum(np.take_along_axis(answers, at[:, None], axis=1)[:, 0] + w["filter_bias"], 0)
        hidden = np.maximum(pooled @ w["dense"] + w["dense_bias"], 0)
        return at, pooled, hidden, hidden @ w["out"] + w["out_bias"][0]

    def logits(self, chunks: np.ndarray) -> np.ndarray:
        return np.concatenate([self._forward(chunks[i:i + BLOCK])[3] for i in range(0, len(chunks), BLOCK)])

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        parts = [cut(t) for t in texts]
        counts = np.array([len(p) for p in parts])
        logits, held, size = [], [], 0
        for p in parts:  # long texts are not joined whole: BLOCK chunks and more at a time
            held.append(p)
            size += len(p)
            if size >= BLOCK:
                logits.append(self.logits(np.concatenate(held)))
                held, size = [], 0
        if held:
            logits.append(self.logits(np.concatenate(held)))
        sums = np.add.reduceat(np.concatenate(logits).astype(np.float64), np.concatenate([[0], np.cumsum(counts)[:-1]]))
        return 1 / (1 + np.exp(-np.clip(sums / counts, -30, 30)))

    def gradient(self, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """The gradient of the weighted mean log loss of whole texts, whose chunks lie one after the other;
        it goes through the pooled places only."""
        w, owner = self.w, np.repeat(np.arange(len(counts)), counts)
        blocks = [slice(i, i + BLOCK) for i in range(0, len(chunks), BLOCK)]
        at, pooled, hidden, logit = (np.concatenate(x) for x in zip(*[self._forward(chunks[b]) for b in blocks], strict=True))
        mean = np.bincount(owner, logit, len(counts)) / counts
        d_mean = (1 / (1 + np.exp(-np.clip(mean, -30, 30))) - labels) * weight / len(counts)
        d = (d_mean / counts)[owner].astype(np.float32)
        grad = {"out": hidden.T @ d, "out_bias": np.array([d.sum()], np.float32)}
        d_hidden = d[:, None] * w["out"] * (hidden > 0)
        grad["dense"], grad["dense_bias"] = pooled.T @ d_hidden, d_hidden.sum(axis=0)
        d_pool = (d_hidden @ w["dense"].T) * (pooled > 0)
        grad["filter_bias"] = d_pool.sum(axis=0)
        grad["filters"], grad["embed"] = np.zeros_like(w["filters"]), np.zeros_like(w["embed"])
        for b in blocks:
            # bytes under the place where each filter answered most: (chunks, filters, WIDTH)
            part = chunks[b]
            under = part[np.arange(len(part))[:, None, None], (at[b] * STRIDE)[:, :, None] + np.arange(WIDTH)]
            seen = w["embed"][under].reshape(len(part), FILTERS, -1)
            grad["filters"] += np.einsum("cf,cfx->xf", d_pool[b], seen)
            d_seen = (d_pool[b][:, :, None] * w["filters"].T[None]).reshape(-1, EMBED)
            flat = under.reshape(-1)
            grad["embed"] += np.stack([np.bincount(flat, d_seen[:, k], 256) for k in range(EMBED)], axis=1).astype(np.float32)
        return grad

    def fit(self, parts: list[np.ndarray], labels: np.ndarray) -> Network:
        """Adam on the log loss of whole texts; ``parts`` holds all chunks of each."""
        w, rng = self.w, np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in w.items()}
        second = {k: np.zeros_like(v) for k, v in w.items()}
        weight = np.where(labels == 1, 0.6 / max(1, (labels == 1).sum()), 0.4 / max(1, (labels == 0).sum())) * len(labels)
        step = 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(parts))
            for start in range(0, len(order), BATCH):
                take = order[start:start + BATCH]
                grad = self.gradient(np.concatenate([parts[i] for i in take]), np.array([len(parts[i]) for i in take]), labels[take], weight[take])
                step += 1
                for k in w:
                    first[k] = 0.9 * first[k] + 0.1 * grad[k]
                    second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
                    w[k] -= (RATE * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
        return self


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Fit on the bounded sample of labelled rows outside fold 0."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.where(fold() != 0).withColumn("order", F.xxhash64("doc_id"))
    parts = [known.where(F.col("quality") == y).orderBy("order", "doc_id").limit(SAMPLE_PER_LABEL) for y in (0, 1)]
    sample = parts[0].unionByName(parts[1]).select("doc_id", "quality")

    # at most twice SAMPLE_PER_LABEL labelled ids, which bounds the broadcast and the rows collected
    rows = (docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample.select(F.col("doc_id").cast("long"), "quality")), "doc_id")
            .select("doc_id", "quality", F.coalesce("text", F.lit("")).alias("text")).distinct().collect())
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["quality"] for r in rows], dtype=np.float64)
    if len(rows) == 0 or y.min() == y.max():
        return Network(constant=float(y[0]) if len(rows) else 0.5)
    return Network().fit([cut(r["text"].encode("utf-8")) for r in rows], y)


def score(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` with ``score``, the probability that the text is of good quality."""
    weights = docs.sparkSession.sparkContext.broadcast((network.w, network.constant))
    docs = docs.drop("score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Network(*weights.value)
        for part in common.slices(batches):
            scores = net.score([t.encode("utf-8") for t in common.texts(part)])
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*names, "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``labels`` and score every row: the columns of ``docs``, ``held_out``, ``score`` and ``predicted``."""
    common.bounded_batches(docs.sparkSession)
    scored = score(docs, fit(docs, labels))
    return scored.withColumns({"held_out": F.coalesce(fold() == 0, F.lit(False)), "predicted": (F.col("score") >= threshold).cast("int")})
