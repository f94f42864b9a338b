"""Label intervals of any length go to a few buckets each."""

from flowharbor.operators import labels as L


def test_long_intervals_do_not_multiply(spark):
    flows = spark.createDataFrame([(1, "a", 5.0), (2, "a", 4e14), (3, "b", 9e12), (4, "c", 1.0)], "flow_id long, key string, ts double")
    labels = spark.createDataFrame([(1, "a", 0.0, 3e14, "x"), (2, "b", 0.0, 3e14, "y"), (3, "b", 8e12, 3e14, "z")], "label_id long, key string, start_ts double, end_ts double, label string")
    got = {r.flow_id: (r.status, r.family) for r in L.match_interval(flows, labels, 10.0).collect()}
    assert got == {1: ("matched", "x"), 2: ("unmatched_time", None), 3: ("ambiguous", None), 4: ("unmatched_key", None)}
    near = {r.flow_id: (r.label, r.n_candidates) for r in L.label_flows(flows, labels, 10.0, 10.0).collect()}
    assert near == {1: ("x", 1), 2: (None, 0), 3: ("y", 2), 4: (None, 0)}


def test_report_computes_its_rows_once(spark):
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            reads.add(len(b))
            yield b

    rows = spark.createDataFrame([(i, "x" if i % 2 else None, float(i), i % 3) for i in range(20)], "flow_id long, label string, delta double, n_candidates int").mapInPandas(seen, "flow_id long, label string, delta double, n_candidates int")
    assert L.alignment_report(rows).first().matched == 10
    assert reads.value == 20
