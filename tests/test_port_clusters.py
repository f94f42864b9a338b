"""Clusters of every port's windows, against the best of all partitions, and the rule that suspects one of them."""

from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowharbor.operators.port_clusters import cluster_ports, entropy_rule

SCHEMA = "id long, port string, v array<double>, cluster string"


def squares(x, own):
    return sum(((x[own == c] - x[own == c].mean(0)) ** 2).sum() for c in set(own.tolist()))


def test_no_partition_is_better(spark):
    rng = np.random.default_rng(3)
    data = {p: rng.normal(size=(8, 2)).round(2) for p in ("a", "b")}
    rows = [(p, i, x.tolist()) for p, xs in data.items() for i, x in enumerate(xs)]
    got = cluster_ports(spark.createDataFrame(rows, "_p string, id long, v array<double>"), 3, starts=10, block_rows=3).collect()
    for p, xs in data.items():
        own = np.array([r["cluster"] for r in sorted(got, key=lambda r: r["id"]) if r["_p"] == p])
        best = min(squares(xs, np.array(c)) for c in product(range(3), repeat=8))
        assert squares(xs, own) == pytest.approx(best)


def planted(spark):
    """Port 443 has a narrow group of 6 windows, port 80 one of a single window; '' and null are one port, 22 is too small."""
    rng = np.random.default_rng(1)
    rows = []

    def put(port, n, at, spread):
        first = len(rows)
        rows.extend((first + i, port, [*(at + rng.normal(size=2) * 0.01).tolist(), spread + float(rng.random() * 0.01)], f"{port}{spread}") for i in range(n))

    for port in ("443", "80", None):
        put(port, 9, np.array([0.0, 0.0]), 3.0)
        put(port, 8, np.array([50.0, 0.0]), 2.0)
    put("443", 6, np.array([0.0, 50.0]), 0.1)
    put("80", 1, np.array([0.0, 50.0]), 0.1)
    put(None, 4, np.array([0.0, 50.0]), 0.1)
    put("22", 2, np.array([0.0, 50.0]), 0.1)
    rows.append((1000, "443", None, "none"))
    rows.append((1001, "443", [1.0, None, 2.0], "none"))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("block_rows", [5, 1000])
def test_the_narrowest_cluster_is_suspected(spark, block_rows):
    windows = planted(spark)
    got = entropy_rule(windows, 3, block_rows=block_rows, rounds=10, starts=4).alias("g").join(windows.alias("w"), "id").select("id", F.col("g.port").alias("port"), "w.v", F.col("w.cluster").alias("group"), "g.cluster", "score", "prediction").collect()
    assert len(got) == windows.count()
    assert {r.group for r in got if r.prediction} == {"4430.1", "None0.1"}
    assert all(r.cluster is None and r.score == 0 for r in got if r.group in ("none", "220.1"))
    top = np.mean([r.v[-1] for r in got if r.group == "4433.0"])
    low = np.mean([r.v[-1] for r in got if r.group == "4430.1"])
    assert {round(r.score, 9) for r in got if r.prediction and r.port == "443"} == {round(top - low, 9)}
    assert {r.port for r in got} == {"443", "80", "22", None}


def test_popular_ports_equal_windows_and_no_windows(spark):
    same = spark.createDataFrame([(i, "1", [1.0, 2.0]) for i in range(6)] + [(10 + i, "2", [float(i), 0.0]) for i in range(8)], "id long, port string, v array<double>")
    got = {r.id: r for r in entropy_rule(same, 2, starts=2, rounds=3).collect()}
    assert len(got) == 14
    assert all(got[10 + i].cluster is None for i in range(8))  # over half of all windows
    assert {(got[i].cluster, got[i].score, got[i].prediction) for i in range(6)} == {(0, 0.0, 1)}
    assert entropy_rule(same.limit(0), 2, starts=2, rounds=2).count() == 0
