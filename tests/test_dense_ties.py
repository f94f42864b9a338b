"""Dense neighbours among copies: what leaves a product is k pairs a query, the smaller ids first."""

import numpy as np

from flowharbor.operators import memory as K


def test_only_k_of_many_ties_are_kept():
    away = np.zeros((3, 1000))
    away[1, ::2], away[2] = 0.5, np.inf
    away[2, [7, 900]] = 0.25, np.nan
    i, j = K._smallest(away, 3)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 0), (0, 1), (0, 2), (1, 1), (1, 3), (1, 5), (2, 7)]
    i, j = K._smallest(np.array([[0.3, 0.1, 0.1, 0.2], [np.nan, np.nan, np.nan, 0.4]]), 2)
    assert list(zip(i.tolist(), j.tolist(), strict=True)) == [(0, 1), (0, 2), (1, 3)]
    assert len(K._smallest(np.zeros((2, 1)), 3)[0]) == 2


def test_copies_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(K, "MEMORY_BLOCK", 64)
    monkeypatch.setattr(K, "PAIRS", 128)
    rows = spark.createDataFrame([(i, [1.0, float(i % 2)]) for i in range(300)], "mid long, v array<double>")
    query = rows.where("mid < 4").withColumnRenamed("mid", "id")
    got = sorted(tuple(r) for r in K.knn_dense(query, rows, 2).collect())
    assert got == [(0, 1, 2, 0.0), (0, 2, 4, 0.0), (1, 1, 3, 0.0), (1, 2, 5, 0.0), (2, 1, 0, 0.0), (2, 2, 4, 0.0), (3, 1, 1, 0.0), (3, 2, 5, 0.0)]
