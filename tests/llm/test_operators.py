"""The training-data operators against brute-force versions on a small table with nulls, empty and
long texts, repeated rows, ties, clashing column names, and on an empty table."""
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from dwell.llm import binary_ids, bpe, common, components, jaccard_join, licenses, line_quality, packing, pii, quality_cnn, rp_forest, substring, tokens

BYTE, WORD, RANKS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
SCHEMA = "doc_id long, text string, source string, score double, row long, length int, n_words string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def make():
    rnd = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("on", "the", "Re", "st", "é") for b in ("a", "er", "ing", "", "ou.", "x,", "ty")]
    text = lambda n: " ".join(rnd.choice(vocabulary) + rnd.choice(["", "", "", "\n", "  "]) for _ in range(n))
    rows = [(i, text(rnd.choice([1, 3, 30, 90, 200]))) for i in range(40)]
    base = rows[4][1] + " " + text(150)
    rows += [(50 + i, base) for i in range(4)]  # exact copies
    for i in range(8):  # near copies
        w = base.split(" ")
        for _ in range(rnd.choice([1, 3])):
            w[rnd.randrange(len(w))] = f"w{i}"
        rows.append((60 + i, " ".join(w)))
    passage = text(70)
    rows += [(70 + i, text(20) + " " + passage + " " + text(25)) for i in range(5)]
    rows += [(80, None), (81, ""), (82, "  \n\t "), (83, "one two"), (84, "One TWO"), (85, text(9000)), (85, "other text of the same id"),
             (50, base), (None, base), (None, None), (86, "tab\tand\x0bvertical\x0c form  feed " * 30), (87, "日本語 テキスト 😀 " * 40), (88, "a <|endoftext|> b<|endoftext|>"), (89, "<|startoftext|> x  "), (90, " y <|ENDOFTEXT|>. \n z")]
    rnd.shuffle(rows)
    return [(i, t, rnd.choice(["a", "b", None]), 1.0, 7, 3, "x") for i, t in rows]


ROWS = make()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_matches_the_library(docs, empty):
    import tiktoken
    ranks = bpe.load_ranks(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    coded = bpe.decode(bpe.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted([(r["doc_id"], list(r["ids"]), bytes(r["decoded"])) for r in coded], key=key)
    want = sorted([(i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in ROWS], key=key)
    assert got == want
    assert bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    coder = bpe.encoder(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    for _ in range(300):
        t = "".join(chr(rnd.choice([32, 10, 39, 115, rnd.randrange(32, 0x3000), rnd.randrange(0xE000, 0x20000)])) for _ in range(60))
        assert np.frombuffer(coder.encode(t), "<u4").tolist() == library.encode_ordinary(t)


@pytest.mark.parametrize("path,space", [(BYTE, True), (WORD, False)])
def test_chunk_encoder_matches_the_library(path, space):
    coder = tokens.ChunkEncoder(path, space)
    texts = [t or "" for _, t, *_ in ROWS] + [" lead", "trail ", "a  b", "x <|endoftext|> y", "don't  'S"]
    want = [e.ids for e in coder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == want


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_planes_round_trip(planes):
    for kind in ("<u4", "<u8"):
        ids = np.random.default_rng(0).integers(0, 60000, 1001).astype(kind)
        assert (binary_ids.from_planes(binary_ids.to_planes(ids, planes), len(ids), kind, planes) == ids).all()


def test_files_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(BYTE)
    folder = common.scratch(spark, "files")
    got = binary_ids.read(binary_ids.write(docs, BYTE, folder, planes="bit")).collect()
    start, want = 0, []
    for i, t, *_ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted([(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got], key=lambda x: x[1]) == want
    assert binary_ids.round_trip(spark, empty, BYTE).count() == 0


def test_line_rules(docs, empty):
    got = {(r["doc_id"], r["n_words"]): r for r in line_quality.judge(docs, min_docs=2, max_share=0.01).collect()}
    lines = {}
    for i, t, source, *_ in ROWS:
        for line in {" ".join(WORDS.findall(x.lower())) for x in (t or "").split("\n")} - {""}:
            lines.setdefault((source, line), set()).add(i)
    for i, t, source, *_ in ROWS:
        w = WORDS.findall(t or "")
        at = {}
        for k in range(len(w) - 2):
            at.setdefault(tuple(w[k:k + 3]), []).append(k)
        covered = {p + d for ks in at.values() if len(ks) > 1 for p in ks for d in range(3)}
        r = got[i, len(w)]
        full = [x for x in (t or "").split("\n") if WORDS.search(x)]
        assert (r["word_chars"], r["n_repeat_words"], r["n_dup_lines"]) == (sum(map(len, w)), len(covered), len(full) - len(set(full)))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert line_quality.judge(empty).count() == 0


def test_boilerplate_is_counted_per_host(spark):
    line = "this line is on every page of the host"
    own = [" ".join(f"w{i}x{k}" for k in range(60)) for i in range(6)]
    rows = [(i, f"{own[i]}\n{line}", "h") for i in range(5)] + [(9, "\n".join([line] * 9), "h"), (10, f"{line}\n{own[5]}", "other")]
    got = {r["doc_id"]: (r["n_boilerplate_words"], r["kept"]) for r in line_quality.judge(
        spark.createDataFrame(rows, "doc_id long, text string, source string"), min_docs=3, max_share=0.01).collect()}
    assert got[0] == (9, True) and got[10] == (0, True) and got[9] == (81, False)


def test_boilerplate_lines_leave_the_text(spark, empty):
    rnd = random.Random(5)
    common_lines = ["Menu  Home", "share this\tpage", "© all of us"]
    rows = []
    for i in range(30):
        own = [" ".join(f"w{i}x{k}y{rnd.randrange(9)}" for k in range(40)) for _ in range(3)]
        lines = own + [rnd.choice([x, x.upper(), x + " \r"]) for x in common_lines if rnd.random() < 0.6] + ["", "  "]
        rnd.shuffle(lines)
        rows.append((i, "\n".join(lines), rnd.choice(["h", None])))
    rows += [rows[0], (1, rows[1][1], "other"), (None, rows[2][1], "h"), (40, None, "h"), (41, "", "h"), (42, "\n".join(common_lines * 30), "h")]
    normal = lambda x: " ".join(WORDS.findall(x.lower()))
    held, n = {}, {}
    for i, t, h in rows:
        n.setdefault(h, set()).add(i)
        for x in (t or "").split("\n"):
            if normal(x):
                held.setdefault((h, normal(x)), set()).add(i)
    bad = {k for k, ids in held.items() if len(ids - {None}) + (None in ids) > max(3, len(n[k[0]]) // 50)}
    want, kept = [], []
    for i, t, h in rows:
        new = None if t is None else "\n".join(x for x in t.split("\n") if (h, normal(x)) not in bad)
        want.append((i, h, t, new))
        words, left = len(WORDS.findall(t or "")), len(WORDS.findall(new or ""))
        if words >= 50 and 100 * left >= 50 * words:
            kept.append((i, h, new))
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = [tuple(r) for r in line_quality.remove_lines(table, min_docs=3).select("doc_id", "source", "text", "clean_text").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(t != c for _, _, t, c in want) > 20
    assert sorted((tuple(r) for r in line_quality.clean(table.select("doc_id", "source", "text"), min_docs=3).collect()), key=repr) == sorted(kept, key=repr)
    counts = {(r["doc_id"], r["n_words"], r["n_boilerplate_words"]) for r in line_quality.judge(table, min_docs=3).collect()}
    assert counts == {(i, len(WORDS.findall(t or "")), len(WORDS.findall(t or "")) - len(WORDS.findall(c or ""))) for i, _, t, c in want}
    assert line_quality.remove_lines(empty).count() == line_quality.clean(empty).count() == 0


def test_forest_recall_and_ties(spark):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(1500, 12)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(2000 + i, vectors[7].tolist()) for i in range(60)]
    rows += [(100, vectors[100].tolist()), (9001, None), (9100, [0.0] * 12), (9200, [float("nan")] * 12), (9300, [1.0] * 3), (None, vectors[1].tolist()), (9400, [None] * 12)]
    got = rp_forest.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6)).collect()
    ids = np.array(list(range(1500)) + list(range(2000, 2060)))
    points = np.concatenate([vectors, np.repeat(vectors[7:8], 60, axis=0)]).astype(np.float64)
    hit = total = 0
    for q in ids[ids % 100 == 0]:
        own = points[ids == q][0]
        apart = np.sqrt(((points - own) ** 2).sum(axis=1))
        order = [int(ids[k]) for k in np.lexsort((ids, apart)) if ids[k] != q][:10]
        mine = [(r["rank"], r["vec_id"], r["score"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])]
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(s - apart[ids == v][0]) < 1e-9 for _, v, s in mine)
        hit, total = hit + len(set(order) & {m[1] for m in mine}), total + 10
        if q >= 2000:
            assert [m[1] for m in mine] == order
    assert hit / total >= 0.9
    assert {r["query_id"] for r in got} == set(ids[ids % 100 == 0].tolist())
    assert rp_forest.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_plan_places_every_piece_once():
    rnd = random.Random(5)
    histogram = {rnd.randrange(1, 129): rnd.randrange(1, 60) for _ in range(60)} | {128: 77}
    patterns = packing.plan(histogram, 128)
    used = {}
    for pattern, count in patterns:
        assert sum(pattern) <= 128
        for n in pattern:
            used[n] = used.get(n, 0) + count
    assert used == histogram
    rooms = []  # best-fit decreasing, piece by piece: as many sequences as the plan over counts
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fit = min((r for r in rooms if r >= n), default=None)
        if fit is None:
            rooms.append(128 - n)
        else:
            rooms[rooms.index(fit)] -= n
    assert sum(c for _, c in patterns) == len(rooms)


def test_packing(docs, empty):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(WORD)
    got = packing.pack(docs, WORD, 256).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, k, at, min(256, len(ids) - at), zlib.crc32(ids[at:at + 256].tobytes())) for k, at in enumerate(range(0, len(ids), 256))]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack(empty, WORD).count() == 0


def test_classifier(spark, docs, empty):
    rnd = random.Random(8)
    good = lambda: " ".join(rnd.choice(["the", "house", "stands", "on", "a", "hill."]) for _ in range(80))
    bad = lambda: " ".join(rnd.choice(["BUY", "NOW", "###", "%%%", "CLICK!!"]) for _ in range(80))
    rows = [(i, good() if i % 3 else bad()) for i in range(240)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(240)] + [(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    got = quality_cnn.classify(table, labels).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert np.mean([r["predicted"] == int(r["doc_id"] % 3 > 0) for r in got if r["held_out"]]) >= 0.95
    odd = quality_cnn.classify(docs, labels)
    assert odd.count() == len(ROWS) and odd.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert quality_cnn.classify(empty, labels.limit(0)).count() == 0


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        data = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        chunks = quality_cnn.cut(data)
        whole = bytearray(max(n, 1))
        for k, chunk in enumerate(chunks):
            at = k * quality_cnn.STEP
            whole[at:min(n, at + quality_cnn.CHUNK)] = chunk.tobytes()[:max(0, min(n, at + quality_cnn.CHUNK) - at)]
        assert bytes(whole[:n]) == data


def shingles(t):
    w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in WORDS.findall(t or "")]
    return {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_components_of_the_join(docs, empty):
    sets = [(i, shingles(t)) for i, t, *_ in ROWS]
    known = [(i, s) for i, s in sets if i is not None]
    least = {i: i for i, _ in known}
    changed = True
    while changed:
        changed = False
        for i, s in known:
            for j, o in known:
                if s and o and 100 * len(s & o) >= 75 * len(s | o) and least[i] != least[j]:
                    least[i] = least[j] = min(least[i], least[j])
                    changed = True
    got = [tuple(r) for r in jaccard_join.components(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    want = [(i, len(s), None if i is None else least[i]) for i, s in sets]
    fixed = [x for x in want if x[0] != 85]  # an id with two texts: each set is a node of its own
    assert sorted([x for x in got if x[0] != 85], key=key) == sorted(fixed, key=key)
    assert jaccard_join.components(empty).count() == 0


def test_signatures_meet():
    rnd = np.random.default_rng(4)
    for _ in range(200):
        n = int(rnd.integers(3, 60))
        a = np.unique(rnd.integers(1, 2**62, n).astype(np.uint64))
        b = a[rnd.random(len(a)) > 0.15]
        if not len(b) or 100 * len(b) < 75 * len(a):
            continue
        for light in (2, 10, 20, 48):
            sa, sb = (jaccard_join.signatures(x, np.ones(len(x), bool), light) for x in (a, b))
            assert len(a) == len(b) or len(np.intersect1d(sa, sb))


def test_connected(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, 101), (103, 101), (7, 7)]
    got = {r["id"]: r["component"] for r in components.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100, 103: 100}


def test_licenses(spark, empty):
    text = {1: "Intro.\nReleased under the MIT License.", 2: None, 3: "", 4: "licensed under CC BY-NC 4.0.\nAll rights reserved.",
            5: ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software\n"
                "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software\n"
                "is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
            6: "This text tells of a licensed driver.", 7: "Licensed under the Apache License, Version 2.0. " * 200}
    table = spark.createDataFrame(list(text.items()), "doc_id long, text string").withColumn("licenses", F.lit("clash"))
    got = {r["doc_id"]: (list(r["sentence_ids"])[:2], list(r["licenses"])) for r in licenses.recognise(table).collect()}
    assert got[1] == (["mit-short"], ["MIT"]) and got[2] == got[3] == got[6] == ([], [])
    assert got[4][1] == ["CC-BY-NC-4.0", "proprietary-notice"] and got[7][1] == ["Apache-2.0"]
    assert got[5] == (["mit-grant", "mit-notice"], ["MIT"])
    assert licenses.recognise(empty).count() == 0


def test_licence_readings_are_merged(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n"
           "Redistributions of source code must retain the above copyright\nnotice, this list of conditions and the following disclaimer.\n"
           "Redistributions in binary form must reproduce the above copyright\nnotice, this list of conditions and the following disclaimer in the\n"
           "documentation and/or other materials provided with the distribution.\n")
    notices = "Page 7\nLicensed under CC BY-NC 4.0\nAll rights reserved\nfooter"
    ids, own = ["bsd-grant", "bsd-source", "bsd-binary"], ["ccbync4-short", "rights-reserved"]
    apache = 'Licensed under the Apache License, Version 2.0\n(the "License");'
    cases = {1: (bsd + notices, ids + own, ["BSD-2-Clause", "CC-BY-NC-4.0", "proprietary-notice"]),
             2: (notices + "\n\n" + bsd, own + ids, ["BSD-2-Clause", "CC-BY-NC-4.0", "proprietary-notice"]),
             3: (apache + "\nrest", ["apache2-head"], ["Apache-2.0"]),
             4: (notices, own, ["CC-BY-NC-4.0", "proprietary-notice"]), 5: (bsd, ids, ["BSD-2-Clause"])}
    table = spark.createDataFrame([(i, t) for i, (t, _, _) in cases.items()], "doc_id long, text string")
    got = {r["doc_id"]: (list(r["sentence_ids"]), list(r["licenses"])) for r in licenses.recognise(table).collect()}
    assert got == {i: (a, b) for i, (_, a, b) in cases.items()}


def test_repeated_passages(docs, empty):
    first = {}
    for i, t, *_ in ROWS:
        w = WORDS.findall(t or "")
        for k in range(len(w) - 49):
            if i is not None:
                first[tuple(w[k:k + 50])] = min(i, first.get(tuple(w[k:k + 50]), i))
    want = []
    for i, t, *_ in ROWS:
        w = WORDS.findall(t or "")
        gone = {p for k in range(len(w) - 49) if i is not None and first[tuple(w[k:k + 50])] < i for p in range(k, k + 50)}
        want.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    got = [(r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in substring.remove(docs).collect()]
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(got, key=key) == sorted(want, key=key) and any(x[2] for x in want)
    assert substring.remove(empty).count() == 0


def test_sketch_loses_nothing(spark):
    rows = [(i, " ".join(f"w{k % 400}" for k in range(i, i + 120))) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    bits = 20
    marked = np.frombuffer(substring.sketch(table, bits), np.uint8).reshape(substring.DEPTH, -1)
    own = substring.Slice([t for _, t in rows], 50)
    counts = {}
    for h, o in zip(own.hashes.tolist(), own.owner.tolist(), strict=True):
        counts.setdefault(h, set()).add(o)
    twice = np.array([h for h, o in counts.items() if len(o) > 1], dtype=np.uint64)
    assert len(twice) and substring._estimated_twice(twice, bits, marked).all()


def luhn(digits):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(digits))) % 10 == 0


def test_pseudonyms(spark, empty):
    text = ["mail Jo.Smith+x99@mail8.example.com now", "ip 10.200.3.4, 999.1.1.1", "+1 (312) 555-2485 or 312-555-2485", "4111 1111 1111 1111 and 4111111111111112",
            "GB82WEST12345698765432", "123-45-6789 000-12-1234", "1999-02-28 1999-02-30", "password=b7db7aa4a5fcc78305 x", "", None, "nothing here", "x" * 100_000 + " 4111111111111111"]
    table = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string").withColumn("n_found", F.lit("clash")).withColumn("keep", F.lit(1))
    got = {r["doc_id"]: r for r in pii.pseudonymise(table, "k").collect()}
    new = {i: r["text"] for i, r in got.items()}
    assert re.fullmatch(r"mail [A-Z][a-z]\.[A-Z][a-z]{4}\+[a-z]\d\d@mail8\.example\.com now", new[0]) and new[0] != text[0]
    assert new[1].endswith(", 999.1.1.1") and all(int(x) < 256 for x in new[1].split(",")[0][3:].split("."))
    a, b = new[2].split(" or ")
    assert re.sub(r"\D", "", a)[1:] == re.sub(r"\D", "", b) != "3125552485"  # linked across formats
    card = new[3].split(" and ")[0]
    assert luhn(card.replace(" ", "")) and new[3].endswith("4111111111111112") and new[11].endswith(card.replace(" ", ""))
    moved = new[4][4:] + new[4][:4]
    assert int("".join(str(int(c, 36)) for c in moved)) % 97 == 1
    assert new[5].endswith(" 000-12-1234") and new[6].endswith(" 1999-02-30") and new[6][:10] != "1999-02-28"
    assert (new[8], new[9], new[10]) == ("", None, "nothing here") and got[0]["keep"] == 1
    assert pii.pseudonymise(empty, "k").count() == 0


def test_feistel_is_a_permutation(spark):
    days = spark.range(0, 73049).select(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")).cast("string").alias("d"))
    assert days.select(pii._date(F.col("d"), "k").alias("p")).distinct().where("p BETWEEN '1900-01-01' AND '2099-12-31'").count() == 73049
    codes = spark.range(0, 2600).select(F.concat(F.chr(65 + F.pmod("id", F.lit(26))), F.lpad(F.floor(F.col("id") / 26).cast("string"), 2, "0")).alias("c"))
    assert codes.select(pii._feistel_text(F.col("c"), "k", "t").alias("p")).distinct().where("p rlike '^[A-Z][0-9]{2}$'").count() == 2600
