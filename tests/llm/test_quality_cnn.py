"""Operator 6's network against plain loops: answers, pooling, probability and gradient."""
import math
import random
import zlib

import numpy as np

from dwell.llm import quality_cnn as Q


def plain_logit(w, chunk):
    answers = []
    for f in range(Q.FILTERS):
        best = -math.inf
        for place in range(0, Q.CHUNK - Q.WIDTH + 1, Q.STRIDE):
            best = max(best, sum(float(w["embed"][chunk[place + i]][e]) * float(w["filters"][i * Q.EMBED + e][f]) for i in range(Q.WIDTH) for e in range(Q.EMBED)))
        answers.append(max(0.0, best + float(w["filter_bias"][f])))
    hidden = [max(0.0, sum(a * float(w["dense"][f][h]) for f, a in enumerate(answers)) + float(w["dense_bias"][h])) for h in range(Q.HIDDEN)]
    return sum(x * float(w["out"][h]) for h, x in enumerate(hidden)) + float(w["out_bias"][0])


def data(n, seed):
    return bytes(random.Random(seed).randrange(1, 256) for _ in range(n))


def test_scores_equal_plain_loops():
    net = Q.Network()
    texts = [b"", data(30, 1), data(Q.CHUNK + 5, 2)]
    want = []
    for t in texts:
        chunks, at = [], 0
        while True:  # a chunk every STEP bytes until the text is covered
            part = t[at:at + Q.CHUNK]
            chunks.append(list(part) + [0] * (Q.CHUNK - len(part)))
            if at + Q.CHUNK >= len(t):
                break
            at += Q.STEP
        mean = sum(plain_logit(net.w, c) for c in chunks) / len(chunks)
        want.append(1 / (1 + math.exp(-mean)))
    assert np.allclose(net.score(texts), want, atol=1e-5)


def test_gradient_equals_differences():
    """Every kind of weight, over texts of many chunks, so that blocks are crossed."""
    net = Q.Network()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    parts = [Q.cut(data(n, n)) for n in (10, 900, Q.STEP * (Q.BLOCK + 3), 4000)]
    chunks, counts = np.concatenate(parts), np.array([len(p) for p in parts])
    labels, weight = np.array([1.0, 0, 1, 0]), np.array([0.5, 1.0, 2.0, 0.7])

    def loss():
        mean = np.array([net.logits(p).mean() for p in parts])
        return float((weight * (np.log1p(np.exp(mean)) - labels * mean)).mean())

    grad, rnd = net.gradient(chunks, counts, labels, weight), np.random.default_rng(5)
    for name, values in net.w.items():
        flat = values.reshape(-1)
        for i in rnd.choice(len(flat), min(4, len(flat)), replace=False):
            kept, step = flat[i], 1e-6
            flat[i] = kept + step
            up = loss()
            flat[i] = kept - step
            down = loss()
            flat[i] = kept
            assert math.isclose(grad[name].reshape(-1)[i], (up - down) / (2 * step), rel_tol=2e-3, abs_tol=2e-6), name


def test_the_fit_reads_whole_texts(spark, monkeypatch):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(20 if i % 3 else 4000))) for i in range(40)] + [(41, None), (42, "")]
    docs = spark.createDataFrame(rows + [rows[1]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    seen = []
    monkeypatch.setattr(Q.Network, "fit", lambda self, parts, labels: seen.append((parts, labels)) or self)
    Q.fit(docs, labels)
    (parts, marks), = seen
    taken = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5]
    assert len(parts) == len(taken) and [int(x) for x in marks] == [i % 2 for i, _ in taken]
    for (_, t), chunks in zip(taken, parts, strict=True):
        assert np.array_equal(chunks, Q.cut((t or "").encode()))
