"""Operator 4: approximate nearest neighbours by a forest of random-projection trees.

Vectors that are equal are one *class*, with the least of its ids and its k + 1 least ids: no more of
a class can be among the k nearest of any query, and a vector that a third of all rows share costs
no more than another.  Trees are fitted on a bounded sample of classes: a node projects its vectors
on the line through two random ones and splits them at the median.  Every class of the corpus is
then put into its leaf of every tree.  A query descends all trees through one shared priority queue,
which always opens the branch, of whichever tree, whose split planes lie nearest to the query, until
the leaves found hold a fixed number of sampled vectors.  The classes in these leaves are reranked
by their exact distance in double precision; leaves meet their queries in hash buckets of leaves.

Limits: fitting reads SAMPLE classes; beyond SAMPLE / LEAF * 100 classes leaves grow with the corpus
instead of becoming more, and so does the share of the corpus that each query reranks stay level.

Defined results: null ids and vectors that are null, empty, zero or hold null or non-finite components
take no part, nor do vectors of another length than the most frequent one (of equally frequent
lengths the smaller); a row that repeats counts once; with fewer candidates than k all are returned;
an empty table, or one without queries, gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm import common

#: Parameters: classes in the sample, trees, classes of the corpus that a leaf aims at, and the share
#: of the sample (and the least number of its vectors) that the leaves of a query must hold.
SAMPLE, TREES, LEAF, SEARCH_SHARE, SEARCH_LEAST, SEED = 50_000, 10, 100, 0.75, 4000, 5
#: Rows of the index in one bucket of leaves, about.
ROWS_PER_BUCKET = 20_000


class Forest:
    """Trees as flat arrays: a node's normal, offset and children; a child below zero is leaf -1 - child."""

    def __init__(self, sample: np.ndarray, leaf: int, trees: int = TREES, seed: int = SEED):
        self.normals, self.offsets, self.children, self.sizes, self.roots = [], [], [], [], []
        rng = np.random.default_rng(seed)
        for _ in range(trees):
            self.roots.append(self._grow(sample, np.arange(len(sample)), max(1, leaf), rng))
        dims = sample.shape[1] if sample.ndim == 2 else 1
        self.normals = np.array(self.normals, dtype=np.float32).reshape(-1, dims)
        self.offsets = np.array(self.offsets, dtype=np.float32)
        self.children = np.array(self.children, dtype=np.int64).reshape(-1, 2)

    def _grow(self, sample: np.ndarray, rows: np.ndarray, leaf: int, rng) -> int:
        if len(rows) > leaf:
            a, b = sample[rng.choice(rows, 2, replace=False)]
            normal = a - b
            length = np.linalg.norm(normal)
            if length > 0:
                normal = normal / length
                at = sample[rows] @ normal
                middle = np.median(at)
                left = at < middle
                if 0 < left.sum() < len(rows):
                    node = len(self.normals)
                    self.normals.append(normal)
                    self.offsets.append(middle)
                    self.children.append([0, 0])
                    self.children[node] = [self._grow(sample, rows[left], leaf, rng), self._grow(sample, rows[~left], leaf, rng)]
                    return node
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree: (vectors, trees)."""
        out = np.empty((len(vectors), len(self.roots)), dtype=np.int64)
        for t, root in enumerate(self.roots):
            node = np.full(len(vectors), root, dtype=np.int64)
            while (inner := np.flatnonzero(node >= 0)).size:
                at = node[inner]
                side = np.einsum("ij,ij->i", vectors[inner], self.normals[at]) >= self.offsets[at]
                node[inner] = self.children[at, side.astype(np.int64)]
            out[:, t] = -1 - node
        return out

    def search(self, margins: np.ndarray, want: int) -> list[int]:
        """Leaves for one query, by one queue over all trees.  ``margins``: its signed distance to
        the split plane of every node."""
        queue = [(0.0, t, root) for t, root in enumerate(self.roots)]
        found, held = [], 0
        while queue and held < want:
            far, t, node = heapq.heappop(queue)
            while node >= 0:
                margin = margins[node]
                side = int(margin >= 0)
                heapq.heappush(queue, (max(far, abs(margin)), t, self.children[node, 1 - side]))
                node = self.children[node, side]
            found.append(int(-1 - node))
            held += self.sizes[-1 - node]
        return found


def classes(vectors: DataFrame, k: int) -> DataFrame:
    """One row per distinct vector: ``v``, ``cid`` (the least id) and ``ids`` (the k + 1 least)."""
    valid = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0))
    sizes = valid.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    valid = valid.where(F.size("v") == (sizes["n"] if sizes else 0))

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:  # within a batch, so that a vector with very many ids leaves few rows
            held: dict[tuple, list[int]] = {}
            for vec_id, v in zip(batch.column("vec_id").to_pylist(), batch.column("v").to_pylist(), strict=True):
                held.setdefault(tuple(v), []).append(vec_id)
            yield pa.RecordBatch.from_arrays([pa.array([list(v) for v in held], pa.list_(pa.float64())),
                                              pa.array([sorted(set(x))[:k + 1] for x in held.values()], pa.list_(pa.int64()))], ["v", "ids"])

    few = valid.mapInArrow(least, "v array<double>, ids array<bigint>")
    return (few.groupBy("v").agg(F.flatten(F.collect_list("ids")).alias("ids"))
            .select("v", F.slice(F.array_sort(F.array_distinct("ids")), 1, k + 1).alias("ids")).withColumn("cid", F.col("ids")[0]))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def search(vectors: DataFrame, k: int = 10, every: int = 100) -> DataFrame:
    """The ``k`` nearest found of every row whose id ``every`` divides, among all other rows."""
    spark = vectors.sparkSession
    known = common.materialise(classes(vectors, k), "vector-classes")
    n = known.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if n == 0:
        return spark.createDataFrame([], schema)
    rows = known.select("v", "cid").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()  # SAMPLE rows at most
    sample = np.array([r["v"] for r in rows], dtype=np.float32)
    leaf = max(8, LEAF * len(sample) // max(n, 1))
    shared = spark.sparkContext.broadcast(Forest(sample, leaf))  # bounded by SAMPLE and TREES
    want = int(max(SEARCH_LEAST, SEARCH_SHARE * len(sample)))
    buckets = max(48, -(-n * TREES // ROWS_PER_BUCKET))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = shared.value.leaves(_matrix(batch.column("v")).astype(np.float32))
                yield pa.RecordBatch.from_arrays([batch.column("cid"), batch.column("v"), pa.array(found.tolist(), pa.list_(pa.int64()))], ["cid", "v", "leaves"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            forest, matrix = shared.value, _matrix(batch.column("v"))
            rows = []  # a query goes to each bucket once, with the leaves that it opens there
            for i, m in enumerate(matrix.astype(np.float32) @ forest.normals.T - forest.offsets):
                leaves = np.sort(np.array(forest.search(m, want), dtype=np.int64))
                at = leaves % buckets
                rows += [(i, b, leaves[at == b].tolist()) for b in np.unique(at).tolist()]
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("cid").take(at), batch.column("v").take(at), pa.array([r[1] for r in rows], pa.int64()),
                                              pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["cid", "v", "bucket", "leaves"])

    queries = (vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
               .where(F.col("vec_id") % every == 0).distinct().join(known.select("v", "cid"), "v").select(F.col("vec_id").alias("query_id"), "cid"))
    queries = common.materialise(queries, "vector-queries")
    asked = known.join(queries.select("cid").distinct(), "cid", "left_semi").select("cid", "v")
    index = (known.select("cid", "v").mapInArrow(assign, "cid long, v array<double>, leaves array<bigint>")
             .select("cid", "v", F.explode("leaves").alias("leaf")).withColumn("bucket", F.pmod("leaf", F.lit(buckets))))
    probes = asked.repartition(F.col("cid")).mapInArrow(probe, "cid long, v array<double>, bucket long, leaves array<bigint>")

    def rerank(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """The nearest k + 1 of each query within the leaves of one bucket, by exact distance."""
        none = pd.DataFrame({"q": np.empty(0, np.int64), "cid": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(left) or not len(right):
            return none
        points, ids = np.array(left["v"].tolist(), dtype=np.float64), left["cid"].to_numpy()
        asked_, q_ids = np.array(right["v"].tolist(), dtype=np.float64), right["cid"].to_numpy()
        opened: dict[int, list[int]] = {}
        for i, leaves in enumerate(right["leaves"]):
            for x in leaves:
                opened.setdefault(int(x), []).append(i)
        parts = [none]
        for leaf_id, rows_ in left.groupby("leaf").indices.items():
            at = opened.get(int(leaf_id), [])
            for start in range(0, len(at), 64):
                some = np.array(at[start:start + 64])
                apart = np.sqrt(((asked_[some][:, None] - points[rows_][None]) ** 2).sum(axis=2))
                for i, row in zip(some, apart, strict=True):
                    best = np.lexsort((ids[rows_], row))[:k + 1]
                    parts.append((q_ids[i], ids[rows_][best], row[best]))
        out = pd.DataFrame({"q": np.repeat([p[0] for p in parts[1:]], [len(p[1]) for p in parts[1:]]),
                            "cid": np.concatenate([p[1] for p in parts[1:]]), "score": np.concatenate([p[2] for p in parts[1:]])}) if len(parts) > 1 else none
        return out.drop_duplicates(["q", "cid"]).sort_values(["q", "score", "cid"]).groupby("q").head(k + 1)

    near = index.groupBy("bucket").cogroup(probes.groupBy("bucket")).applyInPandas(rerank, "q long, cid long, score double")
    best = near.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("score", "cid"))), 1, k + 1).alias("best"))
    members = (best.select("q", F.explode("best").alias("b")).select("q", "b.score", "b.cid").join(known.select("cid", "ids"), "cid")
               .select("q", "score", F.explode("ids").alias("vec_id")))
    lists = members.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k + 1).alias("near"))
    result = queries.join(lists, queries["cid"] == lists["q"]).select("query_id", F.slice(
        F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return result.select("query_id", F.posexplode("near").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
