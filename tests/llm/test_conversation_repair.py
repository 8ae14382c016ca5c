"""Conversation repair against a plain version: whole vectors of (cost, script), one conversation at a time."""
import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest

from dwell.llm import conversation_repair as C

SCHEMA = "conv_id long, turn long, role string, text string, part string, seen int, repaired long"
EXPECTED = {0: 2, 1: 2, 2: 3, 3: 2}
FOLLOWS = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return out


def plain_repair(rows):
    """The rows of one conversation as the contract words it."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        marks = re.findall(r"[^\x20\x09-\x0D]", text)
        kinds.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, state, inserts=0):  # the least (cost, script, rows left) from here on
        ways = []
        if i == len(rows):
            if state in (0, 3):
                return 0, "", ()
        else:
            _, role, text = rows[i]
            add = lambda cost, letter, rest, row: ways.append((cost + rest[0], letter + rest[1], row + rest[2]))
            add(2, "D", best(i + 1, state), ())
            if kinds[i] not in ("blank", "duplicate"):
                stay = 5 if kinds[i] == "truncated" else 0
                if (nxt := FOLLOWS[state].get(role[:1])) is not None:
                    add(stay, "K", best(i + 1, nxt), ((role, text),))
                nxt = EXPECTED[state]
                add(stay + 1, "R", best(i + 1, nxt), (({2: "user", 3: "assistant"}[nxt], text),))
        if inserts < 3:
            nxt = EXPECTED[state]
            rest = best(i, nxt, inserts + 1)
            ways.append((5 + rest[0], "I" + rest[1], (({2: "user", 3: "assistant"}[nxt], ""),) + rest[2]))
        return min(ways) if ways else (10**9, "", ())

    cost, script, left = best(0, 0)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, script,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(), left)


def make(seed=5):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why", "What is it?", "", " \t", "a.b", "ü。", "x. ", None, "long text " * 50 + "."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rnd.choice([1, 2, 3, 5, 9, 14])):
            turn = rnd.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv, turn, rnd.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), rnd.choice(texts) if rnd.random() < 0.7 else f"t{rnd.random()}."))
    for turn in range(150):  # a conversation with far more rows than others
        rows.append((99, turn, rnd.choice(["user", "assistant", "assistant"]), rnd.choice(texts) if rnd.random() < 0.5 else f"h{turn}."))
    return rows + rows[:7]


def expected(rows):
    groups = defaultdict(list)
    for r in plain_damage(rows):
        groups[r[0]].append(r[1:])
    return {conv: plain_repair(groups.get(conv, [])) for conv in {r[0] for r in rows}}


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 4, "range_rows": 60}, {"block_bytes": 300, "range_rows": 100}])
def test_equals_the_plain_version(spark, sizes, monkeypatch):
    rows = make()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(3)
    if not sizes:
        got = {r["conv_id"]: tuple(r)[1:] for r in C.repair_damaged(df).collect()}
        assert got == {k: v[:-1] for k, v in expected(rows).items()}
        return
    found, turns = C.repair(C.damage(df), **sizes)
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in found.collect()}
    want = {k: v for k, v in expected(rows).items() if k in got}
    assert got == {k: v[:-1] for k, v in want.items()}
    left = defaultdict(list)
    for r in turns.orderBy("part", "block", "place").collect():
        left[r["conv_id"]].append((r["role"], r["text"]))
    assert left == {k: list(v[-1]) for k, v in want.items() if v[-1]}


def test_defined_results(spark):
    assert C.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    row, = C.repair_damaged(spark.createDataFrame([(lost, 0, "user", "Hi.", "", 0, 0)], SCHEMA)).collect()
    assert tuple(row) == (lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_matrix_and_walk_agree_with_the_vector():
    rnd = random.Random(1)
    for _ in range(200):
        symbols = bytes(rnd.randrange(12) for _ in range(rnd.randrange(1, 30)))
        vector, least = C.backward(symbols, C._END)
        m = C.matrix(symbols)
        assert [x + least for x in vector] == [min(m[4 * s + t] + C._END[t] for t in range(4)) for s in range(4)]
        scripts, state = C.walk(symbols, C._END, 0)
        assert len(scripts) == len(symbols) and len(C.closing(state)) * 5 == C._END[state]
