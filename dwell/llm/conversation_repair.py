"""Operator 13: conversation structure repair by a square-root checkpointed dynamic programme.

A conversation's rows, taken by turn, must read ``(s?(ua)+)?`` by the initials of their roles.  Four
edits make it so: Keep (free), Rerole to the expected one of user and assistant (1), Delete (2; the
only edit of a blank or duplicate row) and Insert an empty row of the expected role (5).  A truncated
row that stays costs 5 more.  The grammar has four states, so the cost of the rest of a conversation
is a vector of four numbers.  Going backward only the vectors at every sqrt(n)-th row are stored; going
forward each block's vectors are computed again and the least letter among the tight edits (those on
a cheapest way) is taken: D < I < K < R, so the whole script is the ASCII-least of the cheapest.

On Spark the rows are sorted by range of (conversation, turn), so a long conversation lies in several
partitions, and are packed into blocks of bounded rows and bytes.  A conversation inside one block is
repaired there.  One that spans blocks (a hot one, or one at the edge of a partition) is put together
from the blocks' four-by-four cost matrices: one task of a conversation holds 16 numbers a block, not
its rows; each block is then walked for all four states it may start in, and the states are
chained.  The digest of a repaired conversation is one running SHA-256, which reads its pieces in
order and holds one at a time; its audit is one string, as long as the conversation.

Defined results: a null role or text is one space; rows with a null turn come first; rows of one turn
are ordered by role, then by the SHA-256 of their text; a role other than s..., u..., a... (also an
empty one) may only be reroled or deleted; a null conv_id is a conversation of its own; columns other
than the four are not read; an empty table gives no rows.  Equal rows under one turn are duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dwell.llm import common

#: Most rows and most text bytes of a block; rows a range holds.
BLOCK_ROWS, BLOCK_BYTES, RANGE_ROWS = 4096, 8 << 20, 200_000
#: A smaller table is dealt out as well, in ranges of about as many rows at least.
LEAST_ROWS = 10_000

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_SPACE = " \t\n\x0b\x0c\r"
_FAR = 1 << 40
#: State: 0 nothing yet, 1 after the system row, 2 after a user row, 3 after an assistant row.
_EXPECTED = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
_FOLLOWS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_LETTERS = "sua?"
#: What the end of a conversation still costs from each state.
_END = (0, 10, 5, 0)
_GONE, _WHOLE, _CUT = 0, 1, 2


def symbol(role: str, kind: int) -> int:
    """A row as the programme sees it: its role's initial and whether it must go, is whole or truncated."""
    return kind * 4 + (_LETTERS.find(role[0]) if role[:1] in ("s", "u", "a") else 3)


@lru_cache(maxsize=100_000)
def _step(sym: int, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The cost vector before a row from that after it, less its least number, and that number."""
    kind, letter = divmod(sym, 4)
    stay = TRUNCATED if kind == _CUT else 0
    cost = []
    for state in range(4):
        ways = [DELETE + after[state]]
        if kind != _GONE:
            ways.append(REROLE + stay + after[_EXPECTED[state]])
            if (follows := _FOLLOWS[state].get(_LETTERS[letter])) is not None:
                ways.append(stay + after[follows])
        cost.append(min(ways))
    for _ in range(3):
        cost = [min(cost[s], INSERT + cost[_EXPECTED[s]]) for s in range(4)]
    least = min(cost)
    return tuple(min(x - least, _FAR) for x in cost), least


@lru_cache(maxsize=100_000)
def _choose(sym: int, after: tuple[int, ...], state: int) -> tuple[str, int]:
    """The least script of tight edits that takes in one row from ``state``, and the state after it."""
    before, least = _step(sym, after)
    kind, letter = divmod(sym, 4)
    stay = TRUNCATED if kind == _CUT else 0
    script = ""
    while True:
        here = before[state] + least
        if DELETE + after[state] == here:
            return script + "D", state
        if INSERT + before[_EXPECTED[state]] + least == here:
            script, state = script + "I", _EXPECTED[state]
            continue
        follows = _FOLLOWS[state].get(_LETTERS[letter])
        if follows is not None and stay + after[follows] == here:
            return script + "K", follows
        return script + "R", _EXPECTED[state]


def backward(symbols: bytes, after: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """The vector before all rows, as numbers above a least one."""
    total = 0
    for sym in reversed(symbols):
        after, least = _step(sym, after)
        total += least
    return after, total


def matrix(symbols: bytes) -> list[int]:
    """Least costs from each state before the rows to each state after them, row by row."""
    ways = [backward(symbols, tuple(0 if s == t else _FAR for s in range(4))) for t in range(4)]
    return [min(ways[t][0][s] + ways[t][1], _FAR) for s in range(4) for t in range(4)]


def walk(symbols: bytes, after: tuple[int, ...], state: int) -> tuple[list[str], int]:
    """The scripts of all rows from ``state``, and the state after them, given the vector after them."""
    n = len(symbols)
    size = isqrt(n - 1) + 1 if n else 1
    marks, vector = {n: after}, after
    for i in range(n - 1, -1, -1):
        vector, _ = _step(symbols[i], vector)
        if i % size == 0:
            marks[i] = vector
    scripts = []
    for start in range(0, n, size):
        stop = min(start + size, n)
        vectors = [marks[stop]]
        for i in range(stop - 1, start, -1):
            vectors.append(_step(symbols[i], vectors[-1])[0])
        for i in range(start, stop):
            script, state = _choose(symbols[i], vectors.pop(), state)
            scripts.append(script)
    return scripts, state


def closing(state: int) -> str:
    """The inserts that end a conversation from ``state``."""
    return "I" * (_END[state] // INSERT)


def apply(scripts: list[str], last: str, state: int, roles: list[str], texts: list[str]) -> list[tuple[str, str, str]]:
    """The rows that the scripts leave: (edit, role, text); ``last`` are inserts after all rows."""
    out = []
    for script, role, text in zip([*scripts, last], [*roles, ""], [*texts, ""]):
        for edit in script:
            if edit == "D":
                continue
            state = _FOLLOWS[state][role[0]] if edit == "K" else _EXPECTED[state]
            out.append((edit, role, text) if edit == "K" else (edit, _ROLE[state], text if edit == "R" else ""))
    return out


def _join(rows: list[tuple[str, str, str]]) -> str | None:
    return "\n".join(f"{role}:{text}" for _, role, text in rows) if rows else None


# ---------------------------------------------------------------------------
# blocks
# ---------------------------------------------------------------------------

_COUNTS = ["blank", "duplicate", "truncated", "illegal"]
_SMALL = "n long, blank long, duplicate long, truncated long, illegal long, turns long, first_turn {turn}, last_turn {turn}, first_role string, last_role string"
_TURNS = "repaired array<struct<edit:string,role:string,text:string>>"


def _block_schema(rows: DataFrame) -> T.StructType:
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    return T._parse_datatype_string(
        f"conv_id {kind['conv_id']}, part int, block int, complete boolean, {_SMALL.format(turn=kind['turn'])}, matrix array<long>, cost long, audit string, "
        f"{_TURNS}, repaired_sha256 string, roles array<string>, texts array<string>, symbols binary")


class _Block:
    """Rows of one conversation that lie together in one partition."""

    def __init__(self, conv, first_of_part: bool, continued: bool):
        self.conv, self.first_of_part, self.continued = conv, first_of_part, continued
        self.roles, self.texts, self.symbols, self.turns = [], [], bytearray(), []
        self.size, self.counts = 0, dict.fromkeys(_COUNTS, 0)

    def add(self, turn, role: str, text: str, seen: bool) -> None:
        body = text.rstrip(_SPACE)
        kind = _GONE if seen or not body else _WHOLE if body[-1] in ".!?" else _CUT
        if kind != _WHOLE:
            self.counts["blank" if not body else "duplicate" if seen else "truncated"] += 1
        if self.roles and self.roles[-1][:1] + role[:1] not in ("su", "ua", "au"):
            self.counts["illegal"] += 1
        self.roles.append(role)
        self.texts.append(text)
        self.turns.append(turn)
        self.symbols.append(symbol(role, kind))
        self.size += len(text)

    def row(self, part: int, block: int, last_of_part: bool, continues: bool) -> dict:
        symbols = bytes(self.symbols)
        known = [t for t in self.turns if t is not None]
        out = {"conv_id": self.conv, "part": part, "block": block, "n": len(self.roles), **self.counts,
               "turns": len(set(known)), "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None,
               "first_role": self.roles[0], "last_role": self.roles[-1]}
        out["complete"] = not (self.first_of_part or last_of_part or self.continued or continues)
        if not out["complete"]:
            return out | {"matrix": matrix(symbols), "roles": self.roles, "texts": self.texts, "symbols": symbols}
        vector, least = backward(symbols, _END)
        scripts, state = walk(symbols, _END, 0)
        kept = apply(scripts, closing(state), 0, self.roles, self.texts)
        return out | {"cost": vector[0] + least, "audit": "".join(scripts) + closing(state),
                      "repaired": [dict(zip(("edit", "role", "text"), x)) for x in kept],
                      "repaired_sha256": hashlib.sha256((_join(kept) or "").encode()).hexdigest()}


def _packer(schema: pa.Schema, block_rows: int, block_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, held, block, number, part, first = [], 0, None, 0, 0, True
        for batch in batches:
            for conv, turn, role, text, seen, part in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "seen", "part"))):
                if block is not None and (conv != block.conv or len(block.roles) >= block_rows or block.size >= block_bytes):
                    same = conv == block.conv
                    done.append(block.row(part, number, False, same))
                    held += block.size
                    number += 1
                    # a later block of the conversation that opens the partition may continue one before it
                    block = _Block(conv, False, same)
                    if len(done) >= common.SLICE_ROWS or held >= common.SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(done, schema)
                        done, held = [], 0
                elif block is None:
                    block = _Block(conv, first, False)
                first = False
                block.add(turn, role, text, seen)
        if block is not None:
            done.append(block.row(part, number, True, False))
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    return pack


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(schema)


def _sorted_rows(rows: DataFrame, range_rows: int) -> DataFrame:
    """The rows in order of (conv_id, turn, role, text digest) over ranges, each with ``seen``: its role
    and text occur earlier in the conversation.  First occurrences are found by a grouped least place
    and met again by the row's own number, so a text that fills a conversation is no hot key."""
    clean = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    clean = clean.withColumns({"digest": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id()})
    clean = common.materialise(clean, "conversation-rows")
    firsts = clean.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row"))["row"].alias("row")).select("row", F.lit(False).alias("again"))
    n = clean.count()
    n = max(1, -(-n // range_rows), min(int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // LEAST_ROWS))
    order = ["conv_id", "turn", "role", "digest", "row"]
    marked = clean.join(firsts, "row", "left").withColumn("seen", F.coalesce("again", F.lit(True)))
    return (marked.select(*order[:3], "text", "digest", "row", "seen").repartitionByRange(n, *order).sortWithinPartitions(*order)
            .select("conv_id", "turn", "role", "text", "seen", F.spark_partition_id().alias("part")))


# ---------------------------------------------------------------------------
# conversations over several blocks
# ---------------------------------------------------------------------------

def _ends(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The vector after each block of a conversation, from the blocks' matrices, last block first."""
    for batch in batches:
        out = []
        for conv in batch.to_pylist():
            blocks, vector = conv["blocks"], list(_END)
            for i in range(len(blocks) - 1, -1, -1):
                b, least = blocks[i], min(vector)
                out.append({"part": b["part"], "block": b["block"], "is_first": i == 0, "is_last": i == len(blocks) - 1,
                            "after": [min(x - least, _FAR) for x in vector], "cost": None})
                m = b["matrix"]
                vector = [min(m[4 * s + t] + vector[t] for t in range(4)) for s in range(4)]
            out[-1]["cost"] = vector[0]
        yield pa.RecordBatch.from_pylist(out, schema)


def _walks(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Each block walked from every state it may start in."""
    for batch in batches:
        for b in batch.to_pylist():
            starts = [0] if b["is_first"] else range(4)
            found = [walk(b["symbols"], tuple(b["after"]), s) for s in starts]
            yield pa.RecordBatch.from_pylist([{"part": b["part"], "block": b["block"], "exits": [x[1] for x in found], "scripts": [x[0] for x in found]}], schema)


def _entries(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The state in which the way through a conversation enters each of its blocks."""
    for batch in batches:
        out = []
        for conv in batch.to_pylist():
            state = 0
            for b in conv["blocks"]:
                out.append({"part": b["part"], "block": b["block"], "entry": state})
                state = b["exits"][state]
        yield pa.RecordBatch.from_pylist(out, schema)


def _applied(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            scripts = b["scripts"][b["entry"]]
            last = closing(b["exits"][b["entry"]]) if b["is_last"] else ""
            kept = apply(scripts, last, b["entry"], b["roles"], b["texts"])
            yield pa.RecordBatch.from_pylist([{"conv_id": b["conv_id"], "part": b["part"], "block": b["block"], "audit": "".join(scripts) + last,
                                               "repaired": [dict(zip(("edit", "role", "text"), x)) for x in kept], "piece": _join(kept)}], schema)


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A running SHA-256 over the pieces of each conversation, which come sorted."""
    none = object()
    held, run, empty = none, None, True
    for batch in batches:
        done = []
        for conv, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist()):
            if held is none or conv != held:
                if held is not none:
                    done.append({"conv_id": held, "repaired_sha256": run.hexdigest()})
                held, run, empty = conv, hashlib.sha256(), True
            if piece is not None:
                run.update(piece.encode() if empty else b"\n" + piece.encode())
                empty = False
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
    if held is not none:
        yield pa.RecordBatch.from_pylist([{"conv_id": held, "repaired_sha256": run.hexdigest()}], schema)


def _map(df: DataFrame, fn, ddl: str) -> DataFrame:
    out = T._parse_datatype_string(ddl)
    arrow = _arrow(out)
    return df.mapInArrow(lambda batches: fn(batches, arrow), out)


def _together(incomplete: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations over several blocks: a row each, and their repaired blocks."""
    conv = incomplete.schema["conv_id"].dataType.simpleString()
    small = ["part", "block", "n", *_COUNTS, "turns", "first_turn", "last_turn", "first_role", "last_role", "matrix"]
    listed = common.materialise(incomplete.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*small))).alias("blocks")), "conversation-blocks")
    ends = common.materialise(_map(listed, _ends, "part int, block int, is_first boolean, is_last boolean, after array<long>, cost long"), "block-ends")
    walks = common.materialise(_map(incomplete.select("part", "block", "symbols").join(ends, ["part", "block"]), _walks,
                                    "part int, block int, exits array<int>, scripts array<array<string>>"), "block-walks")
    exits = incomplete.select("conv_id", "part", "block").join(walks.select("part", "block", "exits"), ["part", "block"])
    exits = exits.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", "exits"))).alias("blocks"))
    entries = _map(exits, _entries, "part int, block int, entry int")
    whole = incomplete.select("conv_id", "part", "block", "roles", "texts").join(walks, ["part", "block"]).join(entries, ["part", "block"])
    whole = whole.join(ends.select("part", "block", "is_last"), ["part", "block"])
    blocks = common.materialise(_map(whole, _applied, f"conv_id {conv}, part int, block int, audit string, {_TURNS}, piece string"), "repaired-blocks")
    pieces = blocks.select("conv_id", "part", "block", "piece").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    digests = _map(pieces, _digests, f"conv_id {conv}, repaired_sha256 string")
    audits = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "block", "audit"))).alias("a"))
    audits = audits.select("conv_id", F.array_join("a.audit", "").alias("audit"))
    costs = incomplete.select("conv_id", "part", "block").join(ends.where("is_first"), ["part", "block"]).select("conv_id", "cost")
    known = F.expr("filter(blocks, b -> b.first_turn IS NOT NULL)")
    counted = listed.withColumn("known", known).select(
        "conv_id", *[F.expr(f"aggregate(blocks, 0L, (x, b) -> x + b.{c})").alias(c) for c in ("n", *_COUNTS[:3])],
        F.expr("aggregate(blocks, 0L, (x, b) -> x + b.illegal) + size(filter(transform(blocks, (b, i) -> i > 0 AND coalesce("
               "concat(left(blocks[i - 1].last_role, 1), left(b.first_role, 1)) NOT IN ('su', 'ua', 'au'), true)), x -> x))").alias("illegal"),
        F.expr("aggregate(known, 0L, (x, b) -> x + b.turns) - size(filter(transform(known, (b, i) -> i > 0 AND known[i - 1].last_turn = b.first_turn), x -> x))").alias("turns"),
        F.expr("known[0].first_turn").alias("first_turn"), F.expr("known[size(known) - 1].last_turn").alias("last_turn"))
    out = counted
    for more in (costs, audits, digests):
        more = more.withColumnRenamed("conv_id", "_id")
        out = out.join(more, out["conv_id"].eqNullSafe(more["_id"]), "left").drop("_id")
    return out, blocks.select("conv_id", "part", "block", "repaired")


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES, range_rows: int = RANGE_ROWS) -> tuple[DataFrame, DataFrame]:
    """Two tables from ``rows`` (conv_id, turn, role, text).

    Conversations: conv_id, n (rows), gaps (turns that are missing between the least and the greatest),
    blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of ``role:text`` lines).
    Turns: conv_id, place (from 0 within the block), part and block (which order the blocks of a
    conversation), edit, role, text: the repaired rows."""
    common.bounded_batches(rows.sparkSession)
    schema = _block_schema(rows)
    packed = _sorted_rows(rows, range_rows).mapInArrow(_packer(_arrow(schema), block_rows, block_bytes), schema)
    packed = common.materialise(packed, "conversation-packed")
    single, several = _together(packed.where("NOT complete"))
    cols = ["conv_id", "n", *_COUNTS, "turns", "first_turn", "last_turn", "cost", "audit", "repaired_sha256"]
    found = packed.where("complete").select(*cols).unionByName(single.select(*cols))
    gaps = F.coalesce((F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).cast("long"), F.lit(0).cast("long"))
    found = found.select("conv_id", "n", gaps.alias("gaps"), *_COUNTS, "cost", "audit", "repaired_sha256")
    turns = packed.where("complete").select("conv_id", "part", "block", "repaired").unionByName(several)
    turns = turns.select("conv_id", "part", "block", F.posexplode("repaired").alias("place", "r")).select("conv_id", "part", "block", "place", "r.*")
    return found, turns


def damage(rows: DataFrame) -> DataFrame:
    """The planted faults by crc32 of ``conv_id:turn`` modulo 20 (nulls: one space): 0 drops a row, 1
    empties its text, 2 takes its sentence marks, 3 repeats it beside itself, 4 makes it a user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    dealt = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                        (F.crc32(key.cast("binary")) % 20).alias("k")).where("k <> 0")
    text = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("k") == 3, 2).otherwise(1))
    return dealt.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("copy")).drop("copy")


def repair_damaged(rows: DataFrame) -> DataFrame:
    """Every conversation of ``rows`` after :func:`damage` and :func:`repair`; one that lost all its rows
    has zeros, an empty audit and the digest of the empty text."""
    found, _ = repair(damage(rows))
    ids = rows.select("conv_id").distinct()
    found = found.withColumnRenamed("conv_id", "_id")
    numbers = ["gaps", *_COUNTS, "cost"]
    return ids.join(found, ids["conv_id"].eqNullSafe(found["_id"]), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
