"""The fold of a service's memory in slices of time equals the fold in one."""

import random

from flowharbor.streaming import flows as T


def test_slices_are_bounded_and_fold_as_one(spark, monkeypatch):
    draw = random.Random(3)
    rows = [(i, draw.choice(["hot"] * 8 + ["b", None]), float(draw.randrange(90)), draw.randrange(12) / 10, draw.choice([0.1, 0.2, 0.9]), draw.random() < 0.1) for i in range(1500)]
    # rows that tie in time and id are ordered by what they hold
    rows += [(1, "hot", 7.0, v, 0.1, False) for v in (0.3, 0.1, 0.2)]
    df = spark.createDataFrame(rows, "flow_id long, service string, ts double, value double, score double, poison boolean").repartition(5)
    fold = lambda: sorted(map(str, T.dynamic_memory(df, 0.5, 8, 0.6, 0.9, 3, "poison").collect()))
    whole = fold()
    monkeypatch.setattr(T, "SLICE", 200)
    source, slices = T.service_slices(df, ["ts", "flow_id"])
    sizes = [max(r["count"] for r in s.groupBy("service").count().collect()) for s in slices]
    assert len(slices) >= 5 and max(sizes) <= 400 and sum(s.count() for s in slices) == len(rows)
    assert fold() == whole and len(whole) == len(rows)
