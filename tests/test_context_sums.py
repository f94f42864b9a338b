"""The service context comes from running sums: no sliding window, nulls count as nothing, a row without a time has no past."""

from pyspark.sql import functions as F

from flowharbor.operators.windows import service_context


def test_against_a_plain_count(spark):
    n = F.xxhash64("id")
    rows = spark.range(300).select(F.col("id").alias("flow_id"), F.concat(F.lit("s"), F.pmod(n, F.lit(2))).alias("service"), F.when(F.col("id") % 50 > 0, F.pmod(F.shiftright(n, 9), F.lit(60)) / 2.0).alias("ts"), F.when(F.col("id") % 9 > 0, F.col("id") % 11).alias("packets"), (F.col("id") % 7).alias("bytes"))
    held = rows.collect()
    got = {r.flow_id: r for r in service_context(rows, 5.0, 6).collect()}
    assert len(got) == len(held)
    for a in held:
        near = [b for b in held if a.ts is not None and b.ts is not None and a.service == b.service and a.ts - 5 <= b.ts and (b.ts, b.flow_id) < (a.ts, a.flow_id)]
        packets = [b.packets for b in near if b.packets is not None]
        want = (len(near), sum(p < 6 for p in packets), sum(packets), sum(b.bytes for b in near), a.ts - max(b.ts for b in near) if near else None)
        assert (got[a.flow_id].recent_count, got[a.flow_id].recent_short, got[a.flow_id].recent_packets, got[a.flow_id].recent_bytes, got[a.flow_id].last_gap) == want
