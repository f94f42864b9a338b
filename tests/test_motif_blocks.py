"""Motif stability without a row for each sample, motif overlaps from blocks of flows, statistics read once for all pools."""

import random

from pyspark.sql import functions as F

from flowharbor.operators import tokens as T


def made(spark, flows=60, names=12):
    rng = random.Random(6)
    rows = [(f, "train" if f % 4 else "val", f"m{n:02d}") for f in range(flows) for n in range(names) if rng.random() < 0.15 + 0.05 * n]
    return rows, spark.createDataFrame(rows, "flow_id long, split string, token string")


def test_stability_neither_copies_rows_nor_joins_draws(spark):
    _, tokens = made(spark)
    out = T.motif_stability(tokens)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "flow_id" not in "".join(line for line in plan.split("\n") if "Join" in line)
    assert all(0 <= r.stability <= 1 for r in out.collect())


def test_overlaps_against_sets(spark):
    rows, tokens = made(spark)
    held = {}
    for f, _, t in rows:
        held.setdefault(t, set()).add(f)
    names = [(t, i % 3 == 0) for i, t in enumerate(sorted(held))]
    got = T._overlaps(tokens.select("flow_id", "token"), spark.createDataFrame(names, "token string, fresh boolean"))
    wanted = {(a, b): len(held[a] & held[b]) / len(held[a] | held[b]) for a, fa in names for b, fb in names if a < b and (fa or fb) and held[a] & held[b]}
    assert {tuple(sorted(k)): v for k, v in got.items()} == wanted


def test_statistics_are_read_once_for_all_pools(spark):
    rows, tokens = made(spark)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def utility(token):
        seen.add(1)
        return 1.0 + float(token[1:])

    support = {t: len({f for f, s, x in rows if x == t and s == "train"}) / 45 for t in {r[2] for r in rows}}
    stats = spark.createDataFrame(sorted(support.items()), "token string, support double").withColumn("utility", utility("token"))
    chosen = T.select_motifs(stats, tokens, 12, 0.0, 1.0, 0.99, pool=2).collect()
    assert len(chosen) == len(support) == 12 and seen.value == 12
