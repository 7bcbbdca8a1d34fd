from __future__ import annotations

import numpy as np
from demandspark.llm.embedding_dedup import codes, embedding_links, hadamard


def brute(rows, least=0.98):
    def ok(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, comp = [0] * n, list(range(n))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(n):
        for j in range(i):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if x is not None and x == y and ok(a) and ok(b) and len(a) == len(b):
                a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= least:
                    links[i] += 1
                    links[j] += 1
                    comp[find(i)] = find(j)
    least_id = {}
    for i in range(n):
        least_id[find(i)] = min(rows[i][0], least_id.get(find(i), 1 << 60))
    return [(rows[i][0], links[i], least_id[find(i)]) for i in range(n)]


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.allclose(np.linalg.norm(hadamard(x), axis=1), 4 * np.linalg.norm(x, axis=1))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert (codes(unit, 3, 2, 1) == codes(unit * 1.0, 3, 2, 1)).all() and codes(unit, 3, 2, 1).shape == (5, 3, 3)


def test_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(40):
        centre = rng.normal(size=24)
        for _ in range(rng.integers(1, 9)):
            rows.append([len(rows), [float(np.float32(x)) for x in centre + rng.normal(size=24) * 0.03], int(c % 3)])
    rows += [[len(rows) + k, list(rows[0][1]), rows[0][2]] for k in range(700)]  # a hot vector
    odd = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] * 24, [None] * 24, [1.0, 2.0], [2.0, 4.0], [1e-30] * 24, [3e30] * 24, [-0.0, 1.0], [0.0, 1.0]]
    rows += [[len(rows) + k, v, 1] for k, v in enumerate(odd)]
    rows += [[len(rows) + k, rows[0][1], None] for k in range(2)]
    df = spark.createDataFrame([tuple(r) + ("kept",) for r in rows], "vec_id long, embedding array<float>, label int, bucket string")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_links(df, rows_per_block=16).collect())
    want = sorted(brute(rows))
    found, true = sum(g[1] for g in got), sum(w[1] for w in want)
    assert found >= 0.99 * true and all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g != w for g, w in zip(got, want, strict=True)) <= 4
    assert embedding_links(df.limit(0)).count() == 0


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for _ in range(600):
        a, b = rng.normal(size=(2, 64))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        cos = rng.uniform(0.9805, 0.984)
        rows += [a.tolist(), (cos * a + np.sqrt(1 - cos * cos) * b / np.linalg.norm(b)).tolist()]
    df = spark.createDataFrame([(k, v, 1) for k, v in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in embedding_links(df).collect()}
    assert sum(got[2 * k + 1] == 2 * k for k in range(600)) >= 594
