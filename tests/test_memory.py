"""Nearest neighbours of flows that share no token with the memory."""

from flowharbor.operators import jobs, memory

TRAIN = [(f, "train", "BENIGN", t) for f, ts in ((1, "ab"), (6, "bc"), (11, "ac"), (16, "ab")) for t in ts]
OTHERS = [(3, "val", "BENIGN", "a"), (8, "val", "BENIGN", "b"), (4, "test", "BENIGN", "a"), (9, "test", "ATTACK", "new"), (19, "test", "ATTACK", "c")]


def tables(spark):
    tokens = spark.createDataFrame([(f, s, y, "x", 0, t) for f, s, y, t in TRAIN + OTHERS], "flow_id long, split string, label string, service string, pos int, token string")
    flows = tokens.select("flow_id", "split", "label").distinct().union(spark.createDataFrame([(14, "test", "ATTACK")], tokens.select("flow_id", "split", "label").schema))
    return tokens, flows


def test_queries_without_overlap_are_scored(spark):
    query = spark.createDataFrame([(4, "a", 1.0), (9, "new", 1.0)], "id long, token string, w double")
    held = spark.createDataFrame([(m, t, 0.5**0.5) for m, ts in ((1, "ab"), (6, "bc"), (11, "ac")) for t in ts], "mid long, token string, w double")
    ids = spark.createDataFrame([(4,), (9,), (14,)], "id long")
    sparse = {r.id: round(r.score, 6) for r in memory.knn_sparse(query, held, 2, ids).collect()}
    assert sparse == {4: 0.292893, 9: 1.0, 14: 1.0}
    inverted = {r.id: (round(r.score, 6), r.neighbours) for r in memory.knn_inverted(query, held, 20, 2, ids).collect()}
    assert inverted == {4: (0.292893, 2), 9: (1.0, 2), 14: (1.0, 2)}
    assert {r.id for r in memory.knn_inverted(query, held, 20, 2).collect()} == {4, 9}


def test_jobs_count_flows_without_known_tokens(spark):
    tokens, flows = tables(spark)
    rows = {r.label: r.mean_score for r in jobs.sweep(tokens, ["binary"], [4], flows).collect()}
    assert abs(rows["ATTACK"] - (1 + 1 + 1 - 0.5**0.5 / 2) / 3) < 1e-6
    found = jobs.leave_one_job(tokens, 1, flows=flows).collect()
    assert sum(found[0][c] for c in ("tp", "fp", "tn", "fn")) == 4
