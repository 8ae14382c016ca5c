"""Operator 2: token ids as bit-plane files.

One file holds the documents of one range of ids, in ascending order.  Its ids form one stream,
cut into blocks of a fixed number of ids.  A block is transposed into planes (byte k of every id,
or bit k of every id), each plane is compressed with zstandard, and an index at the end of the
file holds the place and length of every plane.  The document table (ids and lengths) is stored
in blocks of the same kind.  A reader seeks any block through the index.

Layout: magic (8 bytes), the compressed planes one after the other, the index (JSON, zstandard),
then its length (unsigned 64-bit, little-endian) and the magic again.

Files are written under an attempt's own name and moved into place, so a task that runs again
after a lost executor, or twice, leaves one whole file.  The manifest lists the files that count.

Defined results: a null or empty text is the end id alone; documents with equal or null ids follow
each other by text, null ids first; an empty table makes no file and reads as no rows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dwell.llm import common, tokens

MAGIC = b"BITPLN01"
#: Ids in a block, and text bytes that one file aims at.
BLOCK_IDS, FILE_BYTES = 65_536, 64 << 20

MANIFEST = "file string, first_doc long, n_docs long, n_ids long"


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The planes of a block of unsigned integers, the lowest byte or bit first."""
    rows = np.ascontiguousarray(ids).view(np.uint8).reshape(len(ids), ids.itemsize)
    if planes == "byte":
        return [rows[:, k].tobytes() for k in range(ids.itemsize)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(8 * ids.itemsize)]


def from_planes(data: list[bytes], n: int, kind: str, planes: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    if planes == "byte":
        rows = np.stack([np.frombuffer(x, np.uint8) for x in data], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(x, np.uint8), count=n, bitorder="little") for x in data], axis=1)
        rows = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view(kind).reshape(n) if size > 1 else rows.reshape(n)


class FileWriter:
    def __init__(self, out, planes: str = "byte", block: int = BLOCK_IDS, level: int = 3):
        self.out, self.planes, self.block = out, planes, block
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.held, self.n_held, self.n_ids = len(MAGIC), [], 0, 0
        self.doc_ids, self.lengths = [], []
        self.index = {"planes": planes, "ids": [], "doc_ids": [], "lengths": []}
        out.write(MAGIC)

    def _block(self, name: str, values: np.ndarray) -> None:
        places = []
        for plane in to_planes(values, self.planes):
            data = self.pack(plane)
            self.out.write(data)
            places.append((self.at, len(data)))
            self.at += len(data)
        self.index[name].append({"n": len(values), "planes": places})

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.held.append(ids)
        self.n_held += len(ids) // 4
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.frombuffer(b"".join(self.held), "<u4")
        whole = len(flat) if last else len(flat) // self.block * self.block
        for start in range(0, whole, self.block):
            self._block("ids", flat[start:min(whole, start + self.block)])
        self.held, self.n_held = [flat[whole:].tobytes()], len(flat) - whole

    def close(self) -> None:
        self._flush(True)
        self.index["null_docs"] = sum(x is None for x in self.doc_ids)  # sorted: they come first
        for name, kind, values in (("doc_ids", "<i8", [x or 0 for x in self.doc_ids]), ("lengths", "<u8", self.lengths)):
            flat = np.array(values, dtype=kind).view("<u8")
            for start in range(0, len(flat), self.block):
                self._block(name, flat[start:start + self.block])
        index = self.pack(json.dumps(self.index).encode())
        self.out.write(index + len(index).to_bytes(8, "little") + MAGIC)


class FileReader:
    def __init__(self, source):
        self.source, unpack = source, zstandard.ZstdDecompressor()
        self.unpack = unpack.decompress
        size = source.size()
        source.seek(size - 16)
        tail = source.read(16)
        if tail[8:] != MAGIC:
            raise ValueError("not a whole bit-plane file")
        n = int.from_bytes(tail[:8], "little")
        source.seek(size - 16 - n)
        self.index = json.loads(self.unpack(source.read(n)))

    def block(self, name: str, k: int, kind: str) -> np.ndarray:
        entry, data = self.index[name][k], []
        for at, n in entry["planes"]:
            self.source.seek(at)
            data.append(self.unpack(self.source.read(n)))
        return from_planes(data, entry["n"], kind, self.index["planes"])

    def table(self) -> tuple[list[int | None], np.ndarray]:
        ids = [int(x) for k in range(len(self.index["doc_ids"])) for x in self.block("doc_ids", k, "<i8")]
        lengths = [self.block("lengths", k, "<u8") for k in range(len(self.index["lengths"]))]
        ids[:self.index["null_docs"]] = [None] * self.index["null_docs"]
        return ids, np.concatenate(lengths).astype(np.int64) if lengths else np.empty(0, np.int64)

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        """Each document's id and ids, block by block."""
        doc_ids, lengths = self.table()
        held, k = b"", 0
        for doc_id, n in zip(doc_ids, lengths.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < 4 * n:
                parts.append(self.block("ids", k, "<u4").tobytes())
                have += len(parts[-1])
                k += 1
            held = b"".join(parts) if len(parts) > 1 else held
            yield doc_id, held[:4 * n]
            held = held[4 * n:]


def _open(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path[5:])


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, planes: str = "byte",
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode ``text`` of every row, append ``end_id`` and write the files to ``folder``, a path in
    a store that all executors reach.  Returns the manifest, one row per file."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = max(spark.sparkContext.defaultParallelism, -(-total // file_bytes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(tokenizer, True), int(end_id).to_bytes(4, "little")
        writer = first = None
        for part in common.slices(batches):
            if writer is None:
                store, base = _open(folder)
                store.create_dir(base, recursive=True)
                attempt = f"{base}/.{uuid.uuid4().hex}"
                out = store.open_output_stream(attempt)
                writer, first = FileWriter(out, planes), part.column("doc_id")[0].as_py()
            ids = part.column("doc_id").to_pylist()
            for doc_id, data in zip(ids, coder.encode(common.texts(part)), strict=True):
                writer.add(doc_id, data + end)
        if writer is not None:
            writer.close()
            out.close()
            name = f"ids-{uuid.uuid4().hex}.bpl"
            store.move(attempt, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"file": f"{folder}/{name}", "first_doc": first, "n_docs": len(writer.lengths), "n_ids": writer.n_ids}],
                                             schema=pa.schema([("file", pa.string()), ("first_doc", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    written = (rows.repartitionByRange(int(n_files), "doc_id").sortWithinPartitions("doc_id", "text")
               .mapInArrow(run, MANIFEST))
    written.write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start`` (ids of all documents before it),
    ``n_tokens`` and ``ids`` (binary, little-endian unsigned 32-bit).

    The window below runs over the manifest, one row per file of FILE_BYTES."""
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "n_docs", "file")
    placed = manifest.withColumn("base", F.sum("n_ids").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for row in batch.to_pylist():
                store, path = _open(row["file"])
                with store.open_input_file(path) as source:
                    at, held, size = row["base"], [], 0
                    for doc_id, ids in FileReader(source).documents():
                        held.append({"doc_id": doc_id, "start": at, "n_tokens": len(ids) // 4, "ids": ids})
                        at += len(ids) // 4
                        size += len(ids)
                        if size > common.SLICE_BYTES:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    spread = placed.repartition(manifest.sparkSession.sparkContext.defaultParallelism, F.xxhash64("file"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write ``docs`` to files in the shared folder and read the files back."""
    return read(write(docs, tokenizer, common.scratch(spark, "token-ids"), end_id))
