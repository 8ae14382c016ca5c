"""Operator 7: n-gram Jaccard self-join, size-aware, with light and heavy sets.

A document's set holds its distinct word shingles.  Documents with equal sets are one *node*.  Two
nodes link when |A & B| / |A u B| >= 0.75, so each shares at least 3/4 of its own set.

All shingles have one order: first those that only one node holds, then rare, then frequent ones,
each by hash.  If two sets share o elements, the first |A| - o + k of A and the first |B| - o + k of
B have k in common.  From this:

  light sets (size up to a boundary) enumerate all 2-subsets of their first |A| - o + 2 elements;
    two light sets that link share a subset, which is far rarer than a shared element;
  heavy sets put their first |A| - o + 1 elements into inverted lists and scan these; light sets
    near the boundary enter the lists too, so that pairs across it meet there.

The boundary is the size with the least cost: subsets to write for the light sets against entries
to write, and lists of the mean length found in the corpus to scan, for the others.

An element that only one node holds is shared with nobody: it is never written, and a node with
less than 3/4 shared elements is done.  Which elements are shared or frequent is counted over all
documents, in groups by hash (see shared.py), and kept as tables of bits, one per cell of the
hashes.  Only shared elements set bits, so a table fills with these alone, and it only overestimates,
so no link is lost; its size is bounded by MAX_BITS, and a corpus with many more shared elements than
that only writes more candidates.

Candidates are verified in steps, so that a group of m near copies costs about m checks instead of
m^2.  First each node is checked against one hub, the most complete node that it shares most lists
with; this tells how many elements both hold and which the node has besides.  Then only pairs that
no hub joins are left.  Two nodes of the same hub share at most the lesser of their shares with the
hub, plus what both hold outside it.  So either these shares suffice alone, or the two must have an
element outside the hub in common, and such elements are rare.  Every pair that could link two
groups is checked exactly on the whole sets; nothing is capped.

Defined results: a null or empty text, or one without words, has an empty set, links with nothing
and is its own component; fewer words than a shingle make one shingle of all; a null id takes no
part in components and keeps a null one; rows of equal id belong to one document if their sets
are equal, else each row's set is a node under that id; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dwell.llm import common
from dwell.llm.components import connected
from dwell.llm.shared import FINGERPRINTS, bit_table, fingerprints, group_bits, held_twice

SHINGLE = 5
#: Jaccard of 3/4 as whole numbers.
NUM, DEN = 75, 100
#: Cells of the tables as a power of two at most and at least, and the count from which an element is frequent.
MAX_BITS, LEAST_BITS, FREQUENT = 29, 20, 32
#: Sizes tried for the boundary between light and heavy sets.
LARGEST_LIGHT = 48
#: Cells that share one bit of the table of frequent elements.
COARSE = 8
_TRUE = np.array([True])


def least_overlap(n: int) -> int:
    """Elements that a set of ``n`` shares at least with any set it links with."""
    return -(-n * NUM // DEN)


class Sets:
    """The distinct shingle sets of a slice: sorted 64-bit hashes and a 128-bit digest of each."""

    def __init__(self, texts: list[str], size: int):
        self.sets = []
        for block in common.blocks([t.encode("utf-8").lower() for t in texts]):  # bytes.lower changes A-Z only
            self._add(*common.word_hashes(block), size)
        self.digests = [xxhash.xxh3_128_digest(s) if len(s) else None for s in self.sets]

    def _add(self, words: np.ndarray, counts: np.ndarray, size: int) -> None:
        runs = common.window_hashes(words, size)
        ends = np.cumsum(counts)
        for start, end, n in zip((ends - counts).tolist(), ends.tolist(), counts.tolist(), strict=True):
            if n >= size:
                own = runs[start:end - size + 1]
                own.sort()  # no other text reads these runs
                self.sets.append(own[np.concatenate([_TRUE, own[1:] != own[:-1]])])
            elif n:
                whole = common.window_hashes(words[start:end], n)
                self.sets.append(common.mix(whole + np.uint64(n)))  # a short sequence equals no shingle
            else:
                self.sets.append(np.empty(0, np.uint64))

    def first_of_each(self) -> list[int]:
        seen: dict[bytes, int] = {}
        for i, d in enumerate(self.digests):
            if d is not None:
                seen.setdefault(d, i)
        return list(seen.values())


def members(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``node`` (binary digest of the set, null if it is empty)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            own = Sets(common.texts(part), size)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in own.sets], pa.int64()), pa.array(own.digests, pa.binary())],
                                             ["doc_id", "n_shingles", "node"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_shingles long, node binary")


def sketch(docs: DataFrame, bits: int, groups: int, size: int = SHINGLE) -> tuple[bytearray, bytearray, float]:
    """One bit per cell: holds an element held twice or more; one per COARSE cells: a frequent element;
    and the mean number of holders of the elements held twice or more.  2^bits cells, 2^groups tasks."""
    own_bits = bits - groups  # a group has the cells of its range

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.slices(batches):
            own = Sets(common.texts(part), size)
            chosen = own.first_of_each()
            if not chosen:
                continue
            elements = np.sort(np.concatenate([own.sets[i] for i in chosen]))
            keep = np.ones(len(elements), dtype=bool)
            keep[FREQUENT:] = elements[FREQUENT:] != elements[:-FREQUENT]  # beyond FREQUENT a slice need not tell how often
            yield fingerprints(elements[keep], groups)

    def table(part: int, elements: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        cells = ((elements >> np.uint64(64 - bits)) & np.uint64((1 << own_bits) - 1)).astype(np.int64)
        coarse = bit_table(cells[counts >= FREQUENT] // COARSE, own_bits - COARSE.bit_length() + 1)
        return pa.RecordBatch.from_pylist([{"part": part, "shared": bit_table(cells, own_bits), "often": coarse, "n": len(cells),
                                            "held": int(np.minimum(counts, 255).sum())}], schema=pa.schema([
                                                ("part", pa.int32()), ("shared", pa.binary()), ("often", pa.binary()), ("n", pa.int64()), ("held", pa.int64())]))

    merged = held_twice(docs.select("text").mapInArrow(send, FINGERPRINTS), groups, table, "part int, shared binary, often binary, n long, held long")
    width = (1 << own_bits) // 8
    twice, often, n, held = bytearray(width << groups), bytearray((width << groups) // COARSE), 0, 0
    for r in merged.toLocalIterator():  # 2^bits bits and an eighth of that at most
        twice[r["part"] * width:(r["part"] + 1) * width] = r["shared"]
        often[r["part"] * width // COARSE:(r["part"] + 1) * width // COARSE] = r["often"]
        n, held = n + r["n"], held + r["held"]
    return twice, often, held / max(1, n)


def boundary(histogram: dict[int, int], list_length: float) -> int:
    """The largest light size: the least cost of subsets written against lists written and scanned.
    ``histogram``: nodes by size, sizes up to that of the largest set tried over 3/4."""
    def cost(light: int) -> float:
        total = 0.0
        for n, nodes in histogram.items():
            over = n - least_overlap(n)
            if n <= light:
                total += nodes * (over + 2) * (over + 1) / 2
            if 4 * n >= 3 * (light + 1):
                total += nodes * (over + 1) * (1 + list_length)
        return total
    return min(range(2, LARGEST_LIGHT + 1), key=lambda x: (cost(x), x))


def signatures(ordered: np.ndarray, shared: np.ndarray, light: int) -> np.ndarray:
    """The signatures of a set in order; ``shared``: which elements others may hold.  The lowest bit
    tells subsets (1) from list entries (0)."""
    n = len(ordered)
    over, out = n - least_overlap(n), []
    if n <= light:
        first = ordered[:over + 2][shared[:over + 2]]
        if len(first) >= 2:
            a, b = np.array(list(combinations(range(len(first)), 2))).T
            low, high = np.minimum(first[a], first[b]), np.maximum(first[a], first[b])
            out.append(common.mix(common.mix(low) + high) | np.uint64(1))
    if 4 * n >= 3 * (light + 1):
        out.append(ordered[:over + 1][shared[:over + 1]] & ~np.uint64(1))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def entries(docs: DataFrame, tables: Broadcast, bits: int, light: int, size: int = SHINGLE) -> DataFrame:
    """One row per node with a signature: ``node``, ``n`` (set size), ``r`` (elements that others may
    hold), ``signatures`` and ``elements`` (binary, those r elements).  ``tables``: the two bit tables
    of ``sketch``, broadcast."""

    def marked(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return (table[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8)) & 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared_bits, often_bits = (np.frombuffer(x, np.uint8) for x in tables.value)
        for part in common.slices(batches):
            own, rows = Sets(common.texts(part), size), []
            # a set of fewer than three links with an equal one only, and that is the same node
            chosen = [i for i in own.first_of_each() if len(own.sets[i]) >= 3]
            if not chosen:
                continue
            flat, sizes = np.concatenate([own.sets[i] for i in chosen]), np.array([len(own.sets[i]) for i in chosen])
            flat_many, ends = marked(shared_bits, flat >> np.uint64(64 - bits)), np.cumsum(sizes)
            held = np.add.reduceat(flat_many, ends - sizes, dtype=np.int64)
            for k in np.flatnonzero(DEN * held >= NUM * sizes).tolist():
                s, r, many = own.sets[chosen[k]], int(held[k]), flat_many[ends[k] - sizes[k]:ends[k]]
                frequent = marked(often_bits, (s >> np.uint64(64 - bits)) // np.uint64(COARSE))
                order = np.argsort(many * 2 + (many & frequent), kind="stable")  # s is sorted by hash
                sigs = signatures(s[order], many[order].astype(bool), light)
                if len(sigs):
                    rows.append((own.digests[chosen[k]], len(s), r, sigs.view(np.int64), s[many.astype(bool)].tobytes()))
            if rows:
                node, n, r, sigs, elements = zip(*rows, strict=True)
                lists = common.list_array(np.concatenate(sigs), np.array([len(x) for x in sigs]), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(node, pa.binary()), pa.array(n, pa.int64()), pa.array(r, pa.int64()), lists, pa.array(elements, pa.binary())],
                                                 ["node", "n", "r", "signatures", "elements"])

    return docs.select("text").mapInArrow(run, "node binary, n long, r long, signatures array<bigint>, elements binary")


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, checked on all shared elements."""
    sets = nodes.select("id", "n", "elements")
    left = pairs.join(sets.toDF("a", "n_a", "elements_a"), "a")
    both = left.join(sets.toDF("b", "n_b", "elements_b"), "b").select("a", "b", "n_a", "n_b", "elements_a", "elements_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (n_a, n_b, x, y) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "elements_a", "elements_b")), strict=True)):
                common_ = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                if DEN * common_ >= NUM * (n_a + n_b - common_):
                    keep.append(i)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return both.mapInArrow(check, "a long, b long")


def _against_hub(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Check each node (a) with its hub (b): ``linked``, ``i``, the number of shared elements, and
    ``extra``, the elements of the node that the hub does not hold."""
    sets = nodes.select("id", "n", "elements")
    left = pairs.join(sets.toDF("a", "n_a", "elements_a"), "a")
    both = left.join(sets.toDF("b", "n_b", "elements_b"), "b").select("a", "b", "n_a", "n_b", "elements_a", "elements_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked, shared, extra = [], [], []
            for n_a, n_b, x, y in zip(*(batch.column(c).to_pylist() for c in ("n_a", "n_b", "elements_a", "elements_b")), strict=True):
                own = np.frombuffer(x, np.uint64)
                in_hub = np.isin(own, np.frombuffer(y, np.uint64), assume_unique=True)
                i = int(in_hub.sum())
                linked.append(DEN * i >= NUM * (n_a + n_b - i))
                shared.append(i)
                extra.append(own[~in_hub].view(np.int64))
            if linked:
                lists = common.list_array(np.concatenate(extra), np.array([len(x) for x in extra]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked), pa.array(shared, pa.int64()), lists],
                                                 ["id", "hub", "linked", "i", "extra"])

    return both.mapInArrow(check, "id long, hub long, linked boolean, i long, extra array<bigint>")


def _mixed(entries_: DataFrame, key: list[str]) -> DataFrame:
    """The lists that hold nodes of several groups, with the group ``main`` that holds most of each."""
    sizes = entries_.groupBy(*key, "own").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy(*key).agg(F.max(F.struct("c", "own")).alias("main"), F.count("*").alias("groups")).where("groups > 1")
    return entries_.join(mixed.select(*key, F.col("main.own").alias("main")), key)


def _may_link():
    """Entries x (not of the main group) and y of a list: different groups, each pair once, and
    elements that others hold in sufficient number."""
    return ((F.col("x.own") != F.col("y.own")) & ((F.col("y.own") == F.col("y.main")) | (F.col("x.id") < F.col("y.id")))
            & (7 * F.least("x.r", "y.r") >= 3 * (F.col("x.n") + F.col("y.n"))))


def _pair() -> list:
    return [F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")]


def links(docs: DataFrame, known: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Links (a, b) between nodes, named by their least doc_id, that join all that any link joins."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(MAX_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, total / 4))))))  # a cell for each word or more
    twice, often, list_length = sketch(docs, bits, group_bits(total), size)
    reps = known.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"), F.max("n_shingles").alias("n_shingles"))
    counts = reps.where(F.col("n_shingles") <= LARGEST_LIGHT * 4 // 3 + 1).groupBy("n_shingles").count().collect()  # one row per small size
    light = boundary({r["n_shingles"]: r["count"] for r in counts}, list_length)
    tables = docs.sparkSession.sparkContext.broadcast((twice, often))  # bounded by MAX_BITS
    written = entries(docs.where("doc_id IS NOT NULL"), tables, bits, light, size)
    nodes = written.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "r", "signatures", "elements")])
    nodes = common.materialise(nodes.join(reps.select("node", "id"), "node").drop("node"), "nodes")
    tables.unpersist()  # the executors need them no more

    lists = nodes.select("id", "n", "r", F.explode("signatures").alias("sig"))
    # step 1: one hub for each node; the most complete node of a list, the one shared by most lists
    rank = F.struct((F.col("r") / F.col("n")).alias("whole"), F.col("n").alias("n"), (-F.col("id")).alias("id"))
    hubs = lists.groupBy("sig").agg(F.max(rank).alias("hub"), F.count("*").alias("entries")).where("entries > 1")
    lists = common.materialise(lists.join(hubs.select("sig", (-F.col("hub.id")).alias("hub"), F.col("hub.n").alias("hub_n")), "sig"), "lists")
    # of a node's possible hubs the one shared by most lists
    pairs = (lists.where((F.col("id") != F.col("hub")) & (4 * F.least("n", "hub_n") >= 3 * F.greatest("n", "hub_n")))
             .groupBy("id", "hub").count().groupBy("id").agg(F.max(F.struct("count", (-F.col("hub")).alias("h"))).alias("best"))
             .select(F.col("id").alias("a"), (-F.col("best.h")).alias("b")))
    met = common.materialise(_against_hub(pairs, nodes), "hub-checks")
    starred = met.where("linked").select(F.col("id").alias("a"), F.col("hub").alias("b"))
    # a node linked to a hub is in the hub's group; a hub is in its own
    centres = starred.select(F.col("b").alias("id")).distinct()
    group = starred.select(F.col("a").alias("id"), F.col("b").alias("own")).join(centres, "id", "left_anti")
    placed = nodes.select("id", "n", "r").join(met.select("id", "hub", "i"), "id", "left").join(group, "id", "left").select(
        "id", "n", "r", F.coalesce("hub", "id").alias("hub"), F.coalesce("i", "r").alias("i"), F.coalesce("own", "id").alias("own"))
    # shared elements must suffice for the least overlap with any partner
    placed = common.materialise(placed.where(7 * F.col("r") >= 3 * (F.col("n") + F.ceil(F.col("n") * 0.75))), "placed")

    # step 2: pairs of a list that are in different groups; the largest group meets all others only
    rest = common.materialise(_mixed(lists.select("id", "sig").join(placed, "id"), ["sig"]), "mixed-lists")
    x, y = rest.where("own <> main").alias("x"), rest.alias("y")
    through_hub = F.least("x.i", "y.i")
    can = (_may_link() & (F.col("x.hub") != F.col("y.id")) & (F.col("y.hub") != F.col("x.id"))
           & ((F.col("x.hub") != F.col("y.hub")) | (7 * through_hub >= 3 * (F.col("x.n") + F.col("y.n"))))
           & ((F.col("x.sig").bitwiseAND(1) == 1) | (F.greatest("x.n", "y.n") > light)))
    plain = x.join(y, (F.col("x.sig") == F.col("y.sig")) & can).select(*_pair())
    # step 3: of nodes with the same hub, those that need elements outside the hub, by these elements
    outside = met.select("id", F.size("extra").alias("e"), F.explode("extra").alias("element")).join(placed, "id")
    rest = common.materialise(_mixed(outside, ["hub", "element"]), "extra-lists")
    x, y = rest.where("own <> main").alias("x"), rest.alias("y")
    can = _may_link() & (7 * (through_hub + F.least("x.e", "y.e")) >= 3 * (F.col("x.n") + F.col("y.n")))
    extra = x.join(y, (F.col("x.hub") == F.col("y.hub")) & (F.col("x.element") == F.col("y.element")) & can).select(*_pair())
    left = common.materialise(plain.union(extra).distinct(), "pairs-left")
    return starred.unionByName(common.materialise(_linked(left, nodes), "other-links"))


def components(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``, the least doc_id reachable by links."""
    common.bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    known = common.materialise(members(docs, size), "members")
    found = connected(links(docs, known, size))
    reps = known.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("id"))
    named = reps.join(found, "id", "left").select("node", F.coalesce("component", "id").alias("component"))
    return known.join(named, "node", "left").select("doc_id", "n_shingles", F.when(
        F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


#: The same in DuckDB SQL: all pairs that share a shingle, then the least id reachable.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(greatest(len(ws) - 4, 1))) AS i FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
reach AS (SELECT x AS doc_id, x AS other FROM sym UNION SELECT r.doc_id, b.y FROM reach r JOIN sym b ON b.x = r.other),
least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least USING (doc_id)
"""
