"""Peers in chunks: pairs of flows are scored inside groups, so that no pair of rows is shuffled, and groups in parts add up."""

import pytest
from pyspark.sql import functions as F

from flowharbor.operators import profiles as P
from flowharbor.operators.primitives import packet_profile


def packets(spark, flows=96, each=40):
    n = F.xxhash64("id")
    r = spark.range(flows * each).select((F.col("id") % flows).cast("string").alias("flow"), (F.col("id") / 7.0).alias("ts"), F.col("id").alias("seq"), (F.pmod(n, F.lit(6)) * 50).cast("int").alias("len"), F.pmod(F.shiftright(n, 20), F.lit(2)).cast("int").alias("dir"))
    return r.withColumn("len", F.when(F.col("seq") % 97 > 0, F.col("len")))  # some lengths are null


def shuffled(spark, df):
    """Rows that all stages of a run of df write to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    total = lambda s: sum(s.apply(i).shuffleWriteRecords() for i in range(s.size()))
    before = total(stages())
    df().write.format("noop").mode("overwrite").save()
    return total(stages()) - before


@pytest.mark.parametrize("made", [lambda r: P.packet_items(r, 64), lambda r: P.local_items(r, 64), lambda r: packet_profile(r, 64)])
def test_no_pairs_are_shuffled(spark, made):
    rows = packets(spark)
    assert shuffled(spark, lambda: made(rows)) < 12 * rows.count()


def test_groups_in_parts_give_the_same(spark, monkeypatch):
    rows = packets(spark, 20)
    made = lambda: [sorted(map(str, f(rows, 8).collect())) for f in (P.packet_items, P.local_items, packet_profile)]
    whole = made()
    for name, value in (("GROUP_ROWS", 10), ("GROUP_SEGS", 3), ("COLUMNS", 2)):
        monkeypatch.setattr(P, name, value)
    assert made() == whole
    assert all(whole)


def test_best_peers_by_brute_force(spark):
    rows = packets(spark, 20)
    counts = {}
    for r in rows.where("len IS NOT NULL").groupBy("flow", "dir", "len").count().collect():
        counts.setdefault(r.flow, {})[r.dir, r.len] = r["count"]
    place = {r.flow: (r.chunk, r.pos) for r in P.peer_chunks(rows, 8).collect()}
    for r in packet_profile(rows, 8).collect():
        near = [(sum(min(c, counts[p].get(x, 0)) for x, c in counts[r.flow].items()), -place[p][1], p) for p in counts if p != r.flow and place[p][0] == place[r.flow][0]]
        assert (r.overlap, r.peer) == (max(near)[0], max(near)[2])
