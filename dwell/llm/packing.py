"""Operator 5: best-fit packing planned on the length histogram.

The plan never sees documents: it places *counts* of pieces of each length, longest first, into
the open sequences whose free room is the smallest that fits.  Sequences of the same contents are
kept as one pattern with a count, so the plan's size depends on the capacity alone (at most
``capacity`` lengths), not on the rows.  Pieces then take the planned slots: within a length, the
piece of rank r takes slot r.  Ranks are counted in hash buckets within a length and shifted by the
buckets before, so that a length that a third of all pieces share is spread over many tasks.

Defined results: a null or empty text is the end id alone; a document longer than ``capacity`` is
cut into full pieces and a rest; documents with equal or null ids are packed each on its own;
an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dwell.llm import common, tokens

#: Pieces that one task ranks, about, and the least number of rank buckets of a length.
ROWS_PER_BUCKET, LEAST_BUCKETS = 200_000, 32

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, spread long"


def cut_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """One row per piece: place, length, checksum and a hash that spreads equal lengths."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(tokenizer, False), int(end_id).to_bytes(4, "little")
        for part in common.slices(batches):
            rows: list[tuple] = []
            for doc_id, data in zip(part.column("doc_id").to_pylist(), coder.encode(common.texts(part)), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    piece = data[at:at + 4 * capacity]
                    rows.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*rows, strict=True))
            spread = common.mix(np.array([(x or 0) & (2**64 - 1) for x in columns[0]], dtype=np.uint64) * np.uint64(31) + np.array(columns[1], dtype=np.uint64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()),
                 pa.array(columns[3], pa.int32()), pa.array(columns[4], pa.int64()), pa.array((spread >> np.uint64(1)).astype(np.int64))],
                ["doc_id", "piece", "start", "length", "ids_crc32", "spread"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit over counts: patterns (the lengths in one sequence, in order) and how many sequences
    have each.  ``histogram``: length to number of pieces, lengths from 1 to ``capacity``."""
    open_: dict[int, list[list]] = defaultdict(list)  # free room: [pattern, count] of sequences
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        for room in sorted(r for r in open_ if r >= length):
            at = room
            while left and open_.get(room):
                pattern, count = open_[room].pop()
                # the best fit stays the sequence just used while it has room for another
                per = at // length
                full = min(count, left // per)
                if full:
                    _add(open_, room - per * length, pattern + (length,) * per, full)
                    left -= full * per
                    count -= full
                if count and left:  # the last of this length, fewer than fill a sequence
                    _add(open_, room - left * length, pattern + (length,) * left, 1)
                    count, left = count - 1, 0
                if count:
                    _add(open_, room, pattern, count)
            if not left:
                break
        if left:
            per = capacity // length
            if left // per:
                _add(open_, capacity - per * length, (length,) * per, left // per)
            if left % per:
                _add(open_, capacity - (left % per) * length, (length,) * (left % per), 1)
    merged: dict[tuple[int, ...], int] = defaultdict(int)
    for groups in open_.values():
        for pattern, count in groups:
            merged[pattern] += count
    return sorted(merged.items(), reverse=True)


def _add(open_: dict[int, list[list]], room: int, pattern: tuple[int, ...], count: int) -> None:
    open_[room].append([pattern, count])


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, rank after the last, first sequence, offset) of each run of slots."""
    taken: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            out.append((length, taken[length], taken[length] + count, sequence, offset))
            taken[length] += count
            offset += length
        sequence += count
    return out


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Pack the documents: one row per piece with ``sequence_id`` and ``offset``."""
    spark = docs.sparkSession
    pieces = common.materialise(cut_pieces(docs, tokenizer, capacity, end_id), "pieces")
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    total = sum(histogram.values())
    buckets = max(LEAST_BUCKETS, -(-total // ROWS_PER_BUCKET))
    runs = spark.createDataFrame(slots(plan(histogram, capacity)) or [(0, 0, 0, 0, 0)],
                                 "length int, low long, high long, first_sequence long, offset long")
    dealt = pieces.withColumn("bucket", F.pmod("spread", F.lit(buckets)))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(
        Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    place = Window.partitionBy("length", "bucket").orderBy("spread", "doc_id", "piece", "ids_crc32")
    ranked = (dealt.withColumn("local", F.row_number().over(place) - 1).join(before, ["length", "bucket"])
              .withColumn("rank", F.col("local") + F.col("before")))
    # the runs of slots are bounded by the capacity (see plan), so they go to every task
    return (ranked.join(F.broadcast(runs), "length").where((F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
            .select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
                    (F.col("first_sequence") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset"))
