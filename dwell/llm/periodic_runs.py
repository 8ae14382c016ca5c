"""Operator 12: periodic runs of words, by a suffix automaton with link-cut access.

A run is a longest stretch of consecutive words with smallest period q (words q apart are equal) and a
length of at least max(LEAST, 2 q).  The suffix automaton of a word sequence has a tree of suffix links;
the path from the state of a prefix to the root spells all suffixes of the prefix, longest first.
Each node of the tree is coloured with the place where its strings ended last.  As words are appended,
the path of each prefix is accessed in a link-cut tree: its preferred-path segments are the stretches
of one colour, and afterwards the whole path is one segment of the new colour.  A segment whose longest
string has length L and last ended d words before the end now, with d <= L, is a square: the last L + d
words have smallest period d, and cannot be extended to the left, as longer suffixes ended elsewhere.
The run grows while later words report it again.  A sequence of n words takes O(n log n) accessed
segments.

Only stretches that may hold a run are read so.  Every word of a run lies in a window of SEED words that
occurs again in the run, at a distance of at most half of its length, so stretches of words outside
such windows are cut away, and what is left is cut again by the same rule until nothing changes.  This
loses no run: a run lies wholly in one stretch, and so do both occurrences of its windows.

Defined results: a null or empty text has no words and no runs, and its collapsed text is empty; words
are compared byte for byte; rows that repeat and null ids give a row each; columns other than doc_id
and text are not read; an empty table gives no rows.  A task holds the automaton of one stretch at a time,
about 1 KB a word, so memory follows the longest repetitive stretch of a text, not the text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm import common

#: Least length of a run in words.
LEAST = 12
#: Words of a window that any run repeats: length - q >= max(LEAST - q, q) >= LEAST / 2.
SEED = LEAST // 2

SCHEMA = "doc_id {id}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def suffix_links(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """The suffix automaton: link and greatest length of each state, and the state of each prefix."""
    steps, link, length, last, prefix = [{}], [-1], [0], 0, []
    for w in words:
        state = len(steps)
        steps.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and w not in steps[p]:
            steps[p][w] = state
            p = link[p]
        if p >= 0:
            q = steps[p][w]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                clone = len(steps)
                steps.append(steps[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and steps[p].get(w) == q:
                    steps[p][w] = clone
                    p = link[p]
                link[q] = link[state] = clone
        prefix.append(state)
        last = state
    return link, length, prefix


def find_runs(words: list[int]) -> list[tuple[int, int, int]]:
    """All runs of a sequence as (start, length, period), in order of start and period."""
    n = len(words)
    if n < LEAST:
        return []
    link, length, prefix = suffix_links(words)
    # each preferred path is a splay tree ordered by depth; the root of the links is left out
    up = [x if x > 0 else -1 for x in link]
    left, right, colour = [-1] * len(up), [-1] * len(up), [-1] * len(up)

    def splay(u: int) -> None:
        """Make ``u`` the top of its splay tree; the tree's colour moves with the top."""
        top = -1
        while True:
            p = up[u]
            if p < 0:
                break
            if left[p] == u:
                u_left = True
            elif right[p] == u:
                u_left = False
            else:
                break
            g = up[p]
            g_left = g >= 0 and left[g] == p
            if g_left or (g >= 0 and right[g] == p):
                top = g
                x = p if g_left == u_left else u  # zig-zig turns the parent first
                _turn(x, p if x == u else g, left, right, up)
            else:
                top = p
            _turn(u, up[u], left, right, up)
        if top >= 0:
            colour[u] = colour[top]

    ends: dict[int, int] = {}
    for r in range(n):
        v = u = prefix[r]
        below = -1
        while u >= 0:
            if up[u] >= 0:
                splay(u)
            c = colour[u]
            if c >= 0:
                d = r - c
                if d <= length[u]:
                    ends[(r - length[u] - d + 1) * (n + 1) + d] = r
            if right[u] >= 0:
                colour[right[u]] = c  # the deeper rest of the old path is a path of its own
            right[u] = below
            below, u = u, up[u]
        colour[below] = r
        splay(v)
    found = []
    for key, end in ends.items():
        start, period = divmod(key, n + 1)
        if end - start + 1 >= max(LEAST, 2 * period):
            found.append((start, end - start + 1, period))
    return sorted(found, key=lambda x: (x[0], x[2]))


def _turn(x: int, p: int, left: list[int], right: list[int], up: list[int]) -> None:
    """Rotate ``x`` above its parent ``p`` in a splay tree."""
    g = up[p]
    if left[p] == x:
        left[p] = moved = right[x]
        right[x] = p
    else:
        right[p] = moved = left[x]
        left[x] = p
    if moved >= 0:
        up[moved] = p
    up[p], up[x] = x, g
    if g >= 0:
        if left[g] == p:
            left[g] = x
        elif right[g] == p:
            right[g] = x


def stretches(words: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the stretches that may hold a run, in the word hashes of all texts of a slice;
    ``owner`` numbers the text of each word."""
    if len(words) < LEAST:
        return []
    windows = common.window_hashes(words, SEED)
    group = owner.astype(np.int64)
    at = np.flatnonzero(owner[SEED - 1:] == owner[:len(windows)])
    size = np.bincount(owner)
    while len(at):
        key = common.mix(windows[at] + common.mix(group[at].astype(np.uint64) + np.uint64(1)))
        order = np.argsort(key, kind="stable")
        place, key = at[order], key[order]
        near = (key[1:] == key[:-1]) & (2 * (place[1:] - place[:-1]) <= size[group[place[1:]]])
        again = np.zeros(len(words), dtype=bool)
        again[place[1:][near]] = again[place[:-1][near]] = True
        edge = np.zeros(len(words) + 1, dtype=np.int32)
        seeds = np.flatnonzero(again)
        np.add.at(edge, seeds, 1)
        np.add.at(edge, seeds + SEED, -1)
        covered = np.cumsum(edge[:-1]) > 0
        new = covered & np.concatenate(([True], ~covered[:-1] | (owner[1:] != owner[:-1])))
        starts = np.flatnonzero(new)
        if not len(starts):
            return []
        number = np.cumsum(new) - 1
        length = np.bincount(number[covered], minlength=len(starts))
        keep = covered & (length[np.maximum(number, 0)] >= LEAST)
        group_now, size_now = np.where(keep, number, -1), length
        inside = np.flatnonzero(keep[:len(windows)] & keep[SEED - 1:] & (group_now[:len(windows)] == group_now[SEED - 1:]))
        if len(inside) == len(at):  # nothing was cut away
            good = np.flatnonzero(length >= LEAST)
            return [(int(starts[i]), int(starts[i] + length[i])) for i in good]
        group, size, at = group_now, size_now, inside
    return []


def _tables(batches: Iterator[pa.RecordBatch], schema: pa.Schema, order: Callable | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in common.slices([batch]):
            ids, data = part.column("doc_id"), [t.encode() for t in common.texts(part)]
            hashes, counts = common.word_hashes(data)
            texts, bounds = [x.split() for x in data], np.concatenate(([0], np.cumsum(counts)))
            if order:
                for i, (doc, n) in enumerate(zip(ids.to_pylist(), counts.tolist())):
                    if n and (places := order(doc, n)) is not None:
                        texts[i] = [texts[i][x] for x in places.tolist()]
                        hashes[bounds[i]:bounds[i + 1]] = hashes[bounds[i] + places]
            owner = np.repeat(np.arange(len(data)), counts)
            runs: list[list[dict]] = [[] for _ in data]
            kept = texts
            dropped: dict[int, np.ndarray] = {}
            for start, stop in stretches(hashes, owner):
                i = int(owner[start])
                first, numbers = start - int(bounds[i]), {}
                words = [numbers.setdefault(w, len(numbers)) for w in texts[i][first:first + stop - start]]
                for at, length, period in find_runs(words):
                    runs[i].append({"start": first + at, "length": length, "period": period})
                    dropped.setdefault(i, np.zeros(len(texts[i]), dtype=bool))[first + at + period:first + at + length] = True
            for i, gone in dropped.items():
                kept[i] = [w for w, g in zip(texts[i], gone.tolist()) if not g]
            collapsed = pa.array([b" ".join(x).decode() for x in kept], schema.field("collapsed").type)
            yield pa.RecordBatch.from_arrays([ids.cast(schema.field("doc_id").type), pa.array(counts, pa.int64()),
                                              pa.array(runs, schema.field("runs").type), collapsed], schema=schema)


def detect(docs: DataFrame, order: Callable[[object, int], np.ndarray | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; in order of start, then period) and the collapsed text:
    the words that are in no run behind its first period, joined by one space.  ``order``, if
    given, tells from a document's id and word count which of its words stands at each place."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string
    common.bounded_batches(docs.sparkSession)
    out = _parse_datatype_string(SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))
    schema = to_arrow_schema(out)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _tables(batches, schema, order), out)


def planted(doc_id, n: int) -> np.ndarray | None:
    """The order of the planted runs: with h the crc32 of the decimal id (null: of nothing) and h % 10 = 0,
    words from h // 10 % n on repeat their first 1 + (n - a) // (3 + g % 8)."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    places = np.arange(n)
    places[a:] = a + (places[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return places


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: least start, then period) and the digests of all runs and the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
