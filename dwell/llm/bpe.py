"""Operator 1: byte-level BPE encoding and decoding in linear time.

Encoding does not run the merges.  An Aho-Corasick automaton over all tokens, their bytes mapped
to Latin-1 characters, finds the longest token that starts at each byte of a piece.  A walk then
takes longest matches from the left; a token may follow another only if the two are *compatible*:
merging their joined bytes gives exactly these two tokens.  Where no compatible token fits, the
walk steps back and tries the next shorter token.  A position from which no walk reached the end
is marked, so each position is tried once per token length and the work is linear.  The answers to
the compatibility question are memoised per pair of tokens, and whole chunks of text per task.

Defined results: a null or empty text has no ids and decodes to no bytes; repeated rows give
repeated results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm import common, tokens

#: Chunks and pieces remembered by a task, and pairs of tokens; beyond that the memo starts anew.
MEMO_CHUNKS, MEMO_PAIRS = 600_000, 2_000_000


#: Letters and digits of Unicode 17, which the installed ``regex`` module knows and the
#: tables of the installed tiktoken do not.  A text with one of them is split as tiktoken does.
NEWER = (
    r"\u0558\u058b\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c\uab6d"
    r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
    r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
    r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
    r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
    r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
    r"\U0001e6e0-\U0001e6e2\U0001e6e4\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe\U0001e6ff"
    r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")


class BacktrackEncoder:
    """``ranks``: token bytes to id, ids in merge order; all 256 single bytes must be tokens."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex
        self.pieces = regex.compile(pattern).findall
        self.newer = regex.compile(f"[{NEWER}]").search
        older = pattern.replace(r"\p{L}", rf"[\p{{L}}--[{NEWER}]]").replace(r"\p{N}", rf"[\p{{N}}--[{NEWER}]]")
        self.older_pieces = regex.compile(older, regex.V1).findall
        self.ranks, self.vocabulary = ranks, {i: b for b, i in ranks.items()}
        self.sizes = {i: len(b) for b, i in ranks.items()}
        self.joined: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix
        self.pairs: dict[tuple[int, int], bool] = {}
        self.memo: dict[str, bytes] = {}
        self.piece_memo: dict[str, bytes] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if self._learn(token, i):
                self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        for token, i in ranks.items():
            self.shorter[i] = next((ranks[token[:n]] for n in range(len(token) - 1, 0, -1)
                                    if ranks.get(token[:n]) in self.parts), -1)
        self.automaton.make_automaton()

    def _learn(self, token: bytes, i: int) -> bool:
        """Find the one pair of earlier tokens that merges to this token; a token that no merge
        reaches from single bytes stays out of the automaton."""
        if len(token) == 1:
            self.parts[i] = (i, i)
            return True
        for n in range(len(token) - 1, 0, -1):
            left, right = self.ranks.get(token[:n], i), self.ranks.get(token[n:], i)
            if left in self.parts and right in self.parts and self._holds(left, right):
                self.joined[left, right] = i
                self.parts[i] = (left, right)
                return True
        return False

    def _holds(self, left: int, right: int) -> bool:
        """Whether merging the bytes of both leaves exactly these two tokens.  Undo the merges of
        both sides, the latest first; the pair breaks if the tokens that meet at the border would
        have merged earlier than the merges still undone."""
        limit = 1 << 62
        while True:
            if self.joined.get((left, right), limit) < limit:
                return False
            if left > right:
                limit = left
                left = self.parts[left][1]
                if left == limit:
                    limit = right + 1
                    right = self.parts[right][0]
                    if right + 1 == limit:
                        return True
            else:
                limit = right + 1
                right = self.parts[right][0]
                if right + 1 == limit:
                    limit = left
                    left = self.parts[left][1]
                    if left == limit:
                        return True

    def compatible(self, left: int, right: int) -> bool:
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > MEMO_PAIRS:
                self.pairs = {}
            known = self.pairs[left, right] = self._holds(left, right)
        return known

    def encode_piece(self, piece: str) -> list[int]:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        if whole is not None:  # a piece that is a token is that token
            return [whole]
        longest = [-1] * len(data)
        for end, (i, n) in self.automaton.iter(data.decode("latin-1")):
            longest[end - n + 1] = i  # ends ascend, so the last one at a start is the longest
        sizes, shorter, known, last_at = self.sizes, self.shorter, self.pairs, len(data)
        out: list[int] = []
        dead = bytearray(last_at + 1)
        at, token, before = 0, longest[0], -1
        while at < last_at:
            while token >= 0:
                if not dead[at + sizes[token]]:
                    if before < 0:
                        break
                    fits = known.get((before, token))
                    if fits is None:
                        fits = self.compatible(before, token)
                        known = self.pairs
                    if fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += sizes[token]
                before, token = token, longest[at] if at < last_at else -1
            else:
                dead[at] = 1
                last = out.pop()
                at -= sizes[last]
                token, before = shorter[last], out[-1] if out else -1
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit bytes."""
        parts = tokens.chunks(text, keep_space=True)
        memo = self.memo
        if len(memo) > MEMO_CHUNKS:
            memo.clear()
            self.piece_memo.clear()
        try:
            return b"".join(map(memo.__getitem__, parts))
        except KeyError:
            out = []
            for part in parts:
                ids = memo.get(part)
                if ids is None:
                    ids = self._chunk(part)
                    if len(memo) <= MEMO_CHUNKS:
                        memo[part] = ids
                out.append(ids)
            return b"".join(out)

    def _chunk(self, chunk: str) -> bytes:
        out = []
        cut = self.older_pieces if not chunk.isascii() and self.newer(chunk) else self.pieces
        for piece in cut(chunk):
            ids = self.piece_memo.get(piece)
            if ids is None:
                ids = array("I", self.encode_piece(piece)).tobytes()
                if len(piece) < 64 and len(self.piece_memo) < MEMO_CHUNKS:
                    self.piece_memo[piece] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


_ENCODERS: dict[tuple[str, str], BacktrackEncoder] = {}


def encoder(path: str, pattern: str) -> BacktrackEncoder:
    """The encoder of this Python worker."""
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = BacktrackEncoder(load_ranks(path), pattern)
    return _ENCODERS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id`` and ``ids`` (array of int)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for part in common.slices(batches):
            coded = [coder.encode(t) for t in common.texts(part)]
            flat = np.frombuffer(b"".join(coded), dtype="<u4").astype(np.int32)
            ids = common.list_array(flat, np.array([len(x) // 4 for x in coded]), pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``encoded`` with ``decoded`` (binary): the bytes of its ``ids``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids = part.column("ids")
                flat, edges = ids.flatten().to_numpy().tolist(), np.concatenate([[0], np.cumsum(pc.list_value_length(ids).to_numpy())]).tolist()
                decoded = pa.array([coder.decode(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, decoded], [*part.schema.names, "decoded"])

    return encoded.mapInArrow(run, _columns(encoded) + ", decoded binary")


def _columns(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
