"""Sparse neighbours: each row is packed once, and several searches share the blocks."""

from flowharbor.operators import memory as K


def rows(spark, sets, name):
    return spark.createDataFrame([(i, t, len(s) ** -0.5) for i, s in sets.items() for t in s], f"{name} long, token string, w double")


def test_searches_share_blocks_that_hold_each_row_once(spark, monkeypatch):
    for name, value in (("SPARSE_QUERIES", 7), ("SPARSE_MEMORY", 5)):
        monkeypatch.setattr(K, name, value)
    sets = {i: {f"t{i % 9}", f"t{i % 4}", f"u{i % 13}", "the"} for i in range(60)}
    made, blocks = [], K.sparse_blocks
    monkeypatch.setattr(K, "sparse_blocks", lambda *a: made.append(blocks(*a)) or made[-1])
    query, memory = rows(spark, sets, "id"), rows(spark, {i: s for i, s in sets.items() if i % 2}, "mid")
    assert K.inverted_recall(query, memory, 30, 3).first().recall == 1.0
    assert len(made) == 1
    q, m, _, even = made[0]
    assert even and q.count() > 5 and m.count() > 5
    for side, ids in ((q, list(sets)), (m, [i for i in sets if i % 2])):
        assert sorted(i for r in side.collect() for i in r["keys"]) == ids
    plan = K.nearest_sparse(query, memory, 3, blocks=made[0])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan
