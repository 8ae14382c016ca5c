"""Which hashes a table holds twice or more: counted in groups by hash, none passed on but those.

Every slice of a table sends its 64-bit hashes as *fingerprints*, the leading bits that name a group
and the 32 bits behind them, once for each time that counts.  A group has all fingerprints of its
range together, sorts them and counts runs of equal ones, so the work is in proportion to the hashes,
not to the groups times the slices.  Different hashes share a fingerprint by chance (n of them about
n / 2^(32 + group bits) each), so counts are too high at times and never too low.

From a group's hashes that are held twice a caller makes its part of a table of bits.  A table fills
with the hashes that are held twice alone: the many that occur once leave no trace in it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm import common

#: Text bytes whose hashes one group counts, about, and the least and most groups as powers of two.
BYTES_PER_GROUP, LEAST_GROUP_BITS, MOST_GROUP_BITS = 16 << 20, 4, 12
#: Leading bits of a hash that a group always knows.
KNOWN_BITS = 32 + LEAST_GROUP_BITS

FINGERPRINTS = "part int, cells binary"


def group_bits(total: int) -> int:
    """The groups for ``total`` bytes of text, as a power of two."""
    return int(min(MOST_GROUP_BITS, max(LEAST_GROUP_BITS, np.ceil(np.log2(max(1, total / BYTES_PER_GROUP))))))


def fingerprints(hashes: np.ndarray, groups: int) -> pa.RecordBatch:
    """Rows of FINGERPRINTS from hashes in order, one for each group that they touch."""
    edges = np.searchsorted(hashes, np.arange(1 << groups, dtype=np.uint64) << np.uint64(64 - groups))
    edges = np.append(edges, len(hashes))
    parts = np.flatnonzero(np.diff(edges))
    cells = (hashes >> np.uint64(32 - groups)).astype(np.uint32)  # the cast drops the bits of the group
    return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), common.binary_runs(cells, np.append(edges[parts], len(hashes)))], ["part", "cells"])


def held_twice(sent: DataFrame, groups: int, table: Callable[[int, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """``table(part, hashes, counts)`` of each group, written once: ``hashes`` has the known bits of those
    held twice or more, in order, the others zero."""
    def of_group(part: int, runs: list[np.ndarray]) -> pa.RecordBatch:
        cells = np.concatenate(runs)
        runs.clear()
        cells.sort()
        again, more = np.unique(cells[1:][cells[1:] == cells[:-1]], return_counts=True)
        return table(part, (np.uint64(part) << np.uint64(64 - groups)) | (again.astype(np.uint64) << np.uint64(32 - groups)), more + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            for part, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                held.setdefault(part, []).append(np.frombuffer(cells, np.uint32))
        while held:
            yield of_group(*held.popitem())
        common.release()

    return common.materialise(sent.repartition(1 << groups, F.col("part")).mapInArrow(count, schema), "held-twice")


def bit_table(cells: np.ndarray, bits: int) -> bytes:
    """2^bits bits, those of ``cells`` set, the lowest bit of a byte first."""
    out = np.zeros(1 << bits, dtype=bool)
    out[cells] = True
    return np.packbits(out, bitorder="little").tobytes()
