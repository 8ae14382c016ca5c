"""Encoding with a tokenizer file of the ``tokenizers`` library, once per distinct chunk.

A text is cut at single spaces that stand between two characters that are not white space.
Neither pre-tokenizer joins characters across such a cut (the byte-level one takes the space as
the start of the next piece, the word-end one drops it), so the ids of a text are the ids of its
chunks, one after the other.  The library encodes each distinct chunk once per task.
"""

from __future__ import annotations

import gc
import os
import re
from bisect import bisect_left

import numpy as np

#: Bytes of chunks and ids that a worker remembers, about; beyond that the memo starts anew.
MEMO_BYTES = 64 << 20
#: New chunks that one call of the library encodes: its time grows faster than the text.
JOINED = 100

_CUT = re.compile(r"(?<=\S) (?=\S)")
_TWO = re.compile(r" \s|\s ")


def chunks(text: str, keep_space: bool = False) -> list[str]:
    """The chunks of a text; with ``keep_space`` all but the first start with the space before."""
    if not text:
        return []
    if text[0] == " " or text[-1] == " " or _TWO.search(text):
        parts = _CUT.split(text)
    else:
        parts = text.split(" ")
    return [parts[0], *[" " + x for x in parts[1:]]] if keep_space else parts


class ChunkEncoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit bytes.  With ``keep_space`` a
    chunk but the first of a text is encoded with the space before it.  A special token that a text
    spells out gets its id, as the library has it."""

    def __init__(self, path: str, keep_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.space = " " if keep_space else ""
        # by chunk: its ids behind a space, and as the first of a text
        self.memo: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {} if keep_space else self.memo
        self.held = 0

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.held > MEMO_BYTES:
            self.held = 0
            self.memo.clear()
            self.first.clear()
        get, first = self.memo.get, self.first.get
        found, missing, open_, starts = [], set(), [], set()
        collecting = gc.isenabled()
        gc.disable()  # lists of text and bytes make no cycles, and many of them make the collector run often
        try:
            for text in texts:
                parts = chunks(text)
                ids = list(map(get, parts))
                if parts:
                    ids[0] = first(parts[0])
                if None in ids:
                    gaps = [(i, parts[i]) for i, x in enumerate(ids) if x is None]
                    if not gaps[0][0]:
                        starts.add(parts[0])
                        missing.update([c for _, c in gaps[1:]])
                    else:
                        missing.update([c for _, c in gaps])
                    open_.append((ids, gaps))
                found.append(ids)
            if self.space:
                for c in starts:
                    self._keep(self.first, c, self._alone(c))
            else:
                missing |= starts
            self._learn(missing)
            for ids, gaps in open_:
                for i, c in gaps:
                    ids[i] = (self.memo if i else self.first)[c]
        finally:
            if collecting:
                gc.enable()
        return [b"".join(ids) for ids in found]

    def _alone(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _keep(self, memo: dict[str, bytes], chunk: str, ids: bytes) -> None:
        memo[chunk] = ids
        self.held += len(chunk) + len(ids) + 120

    def _learn(self, missing: set[str]) -> None:
        """Encode new chunks joined to one text, which costs far less than one call each, and part the ids
        by the place in the text where each token starts."""
        new = []
        for c in missing:
            if c[0].isspace() or c[-1].isspace():  # its white space would join that of a neighbour
                self._keep(self.memo, c, self._alone(self.space + c))
            else:
                new.append(c)
        memo = self.memo
        for at in range(0, len(new), JOINED):
            part = new[at:at + JOINED]
            enc = self.tokenizer.encode(self.space + " ".join(part), add_special_tokens=False)
            data, starts = np.array(enc.ids, dtype="<u4").tobytes(), [x[0] for x in enc.offsets]
            end = token = 0
            before = 0
            for chunk in part:
                end += len(chunk) + 1
                token = bisect_left(starts, end, token)
                memo[chunk] = data[before:4 * token]
                before = 4 * token
            self.held += len(data) + sum(map(len, part)) + 120 * len(part)


_ENCODERS: dict[tuple[str, bool], ChunkEncoder] = {}


def encoder(path: str, keep_space: bool) -> ChunkEncoder:
    """The encoder of this Python worker; its memo serves all tasks that the worker runs."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = ChunkEncoder(path, keep_space)
    return _ENCODERS[path, keep_space]
