import math
import random

import numpy as np

from flowharbor.llm import topk


def brute(rows, k=5):
    seen = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (i, v) in enumerate(seen):
        if i % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for n, (j, w) in enumerate(seen) if n != at and len(w) == len(v))[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)]
    return sorted(out)


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as score", "2 as p")
    data = topk.whole_vectors(df)
    return sorted(map(tuple, topk.top_k(data, data.where("id % 50 = 0")).collect()))


def test_matches_brute_force(spark, monkeypatch):
    for name, value in (("DATA_BLOCK", 90), ("QUERY_BLOCK", 4), ("SAMPLE", 40), ("LEAF", 8), ("QUERY_LEAF", 3), ("PIVOTS", 6)):
        monkeypatch.setattr(topk, name, value)
    rng = random.Random(1)
    centers = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, 0.1) for c in rng.choice(centers)]) for i in range(600)]
    rows += [(1000 + i, centers[0]) for i in range(120)]
    rows += [(50, rows[50][1]), (50, rows[50][1]), (50, [0.5] * 6), (None, centers[0]), (2000, None), (2050, [1.0, None]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6), (2200, [0.5, 0.25]), (2201, [1.0, 1.0]), (2250, []), (2300, [1e30] * 3), (2301, [1e3, 1.0, 1.0])]
    want = [x for x in brute(rows) if abs(x[3]) < 2**62]
    assert [x for x in run(spark, rows) if abs(x[3]) < 2**62] == want and len(want) > 70


def test_nothing_is_pruned_wrongly():
    rng = np.random.default_rng(0)
    for spread in (0.05, 1.0):
        base = rng.normal(size=(12, 16))
        d = np.floor(256 * (base[rng.integers(0, 12, 3000)] + spread * rng.normal(size=(3000, 16))))
        q = d[::40]
        s = topk.Search(q, d, np.arange(3000), 5, np.arange(0, 3000, 40))
        got = s.run()
        for i, row in enumerate(got):
            score = q[i] @ d.T
            score[i * 40] = -np.inf
            order = np.lexsort((np.arange(3000), -score))[:5]
            assert row == [(-int(score[j]), int(j)) for j in order]
        assert spread > 0.5 or s.skipped > 0


def test_fewer_than_k_and_empty(spark):
    assert run(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 256 * 512)]
    assert run(spark, []) == []
