"""Sparse neighbours by block products: both rankings against brute force, copies included, and the queries that search by them."""

import math
import random

import pytest

from flowharbor.operators import memory as K
from flowharbor.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("frequent", [0.05, 0.4])
def test_both_rankings_against_brute_force(spark, monkeypatch, frequent):
    for name, value in (("FREQUENT", frequent), ("SPARSE_QUERIES", 9), ("SPARSE_MEMORY", 13), ("PRODUCT_ROWS", 4), ("STRETCH", 7)):
        monkeypatch.setattr(K, name, value)
    rng = random.Random(4)
    some = [["the", *rng.sample([f"t{i}" for i in range(30)], rng.randint(0, 6))] for _ in range(30)]
    queries, held = some[:20] + [["unknown"]], some[10:] + some[20:] + [some[0]] * 5
    df = lambda rows, name: spark.createDataFrame([(i, t, len(r) ** -0.5) for i, r in enumerate(rows) for t in r], f"{name} long, token string, w double")
    idf = {t: math.log((1 + len(held)) / (1 + sum(t in r for r in held))) + 1 for r in held for t in r}
    for by, k in (("dot", 3), ("shared", 12)):
        got = {}
        for r in K.nearest_sparse(df(queries, "id"), df(held, "mid"), k, by).orderBy("id", "r").collect():
            got.setdefault(r.id, []).append((r.mid, round(r.dot, 9)))
        for i, q in enumerate(queries):
            pairs = [(j, len({*q} & {*m}) / math.sqrt(len(q) * len(m)), sum(idf[t] for t in {*q} & {*m})) for j, m in enumerate(held)]
            near = sorted((-round(s if by == "shared" else d, 9), j, round(d, 9)) for j, d, s in pairs if d > 0)
            assert got.get(i, []) == [(j, d) for _, j, d in near[:k]]


@pytest.mark.parametrize("name,searches", [("agg43_diagnosis", 1), ("joi18_motif_contrast", 1), ("joi14_knn_inverted", 1), ("joi14_recall", 2), ("cal11_sweep", 2), ("cal15_leave_one_job", 1)])
def test_queries_search_by_blocks(spark, monkeypatch, name, searches):
    """No query joins all pairs that share a token, and a sweep over k searches once a weighting."""
    calls, search = [], K.nearest_sparse
    monkeypatch.setattr(K, "nearest_sparse", lambda *a, **b: calls.append(1) or search(*a, **b))
    registry.QUERIES[name](spark, SF)
    assert len(calls) == searches
