"""Shared helpers: scratch tables in the shared folder, Arrow slices, word and window hashes."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dwell.session import ensure_checkpoint_dir

#: The separators of a word, as a Java and RE2 character class.
SEPARATORS = r"[\x20\x09-\x0D]+"
#: Most rows and most text bytes that a Python task holds at once.
SLICE_ROWS, SLICE_BYTES = 2000, 8 << 20
#: Text bytes whose words are hashed at once.
BLOCK_BYTES = 1 << 20

try:
    _LIBC = ctypes.CDLL("libc.so.6")
    _LIBC.malloc_trim  # glibc alone has it
except (OSError, AttributeError):
    _LIBC = None

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_SHIFT = np.uint64(32)
#: Which bytes belong to words, and the longest word that is read in steps of eight bytes.
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_LONG_WORD = 32


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts the lineage, and lost
    executors cost nothing that was written."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Let Spark hand texts and sets to Python in batches of a slice at most: with the default of
    10,000 rows a batch of long rows fills the memory of the JVM and of Python at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SLICE_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(SLICE_BYTES))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` has not, whatever its columns are called."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"_{name}{'_' * k}" for k in range(len(taken) + 1)) if x.lower() not in taken)


def row_key(id_col: str, text_col: str) -> Column:
    """Tells rows apart that share an id: the id and the text together."""
    return F.xxhash64(F.col(id_col), F.col(text_col))


def slices(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that one slice stays within SLICE_ROWS rows and, but for a single
    longer text, within SLICE_BYTES of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or held + n > SLICE_BYTES):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield batch.slice(start)
    release()


def release() -> None:
    """Hand what a task's slices have freed back to the system: a worker lives on for later stages, and
    the allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def texts(batch: pa.RecordBatch, text_col: str = "text") -> list[str]:
    """The texts of a slice; null counts as empty."""
    return [x or "" for x in batch.column(text_col).to_pylist()]


def blocks(data: list[bytes]) -> Iterator[list[bytes]]:
    """The texts of a slice, BLOCK_BYTES and a text at a time: what is computed for a block is several times its size."""
    start, held = 0, 0
    for i, text in enumerate(data):
        held += len(text)
        if held >= BLOCK_BYTES:
            yield data[start:i + 1]
            start, held = i + 1, 0
    if start < len(data):
        yield data[start:]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * _MIX
    return x ^ (x >> _SHIFT)


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the word count of each text.
    Words part at exactly the ASCII separators 0x20 and 0x09 to 0x0D, as ``bytes.split`` parts them.
    A word is read eight bytes at a time, all words at once; of equally long ones up to eight bytes no two
    have the same hash."""
    joined = b" " + b" ".join(data) + b" " * 8
    word = _WORD[np.frombuffer(joined, np.uint8)]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    starts, lengths = edges[::2], edges[1::2] - edges[::2]
    ends_of_texts = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    counts = np.diff(np.searchsorted(starts, ends_of_texts), prepend=0)
    eight = np.ndarray(len(joined) - 7, "<u8", joined, strides=(1,))  # the eight bytes from each place on
    out = mix(lengths.astype(np.uint64) * _ODD)
    for k in range(0, _LONG_WORD, 8):
        at = np.flatnonzero(lengths > k) if k else slice(None)
        if k and not len(at):
            break
        own = eight[starts[at] + k] << (np.uint64(64) - np.uint64(8) * np.minimum(lengths[at] - k, 8).astype(np.uint64))
        out[at] = mix((out[at] ^ own) * _ODD)
    for i in np.flatnonzero(lengths > _LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(joined[starts[i]:starts[i] + lengths[i]])
    return out, counts


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of ``k`` words, by doubling: a run of 2m is mixed from two of m."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, out, power, size = 0, None, mix(words + _ODD), 1
    left = k
    while left:
        if left & 1:
            part = power[done:done + n]
            out = part.copy() if out is None else mix(out * _ODD + part)
            done += size
        left >>= 1
        if left:
            power = mix(power[:-size] * _ODD + power[size:])
            size *= 2
    return out


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


def binary_runs(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """An Arrow binary column whose row i holds ``values[bounds[i]:bounds[i + 1]]``."""
    offsets = (np.asarray(bounds, dtype=np.int64) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1,
                                 [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])
