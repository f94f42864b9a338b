"""Approximate neighbours by blocks: what MLlib's similarity join of the same projections gives, also where one bucket holds all."""

import random

import pytest
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.sql import functions as F

from flowharbor.operators import memory as K
from flowharbor.operators import models as M


@pytest.mark.parametrize("bucket", [0.3, 50.0])
def test_blocks_give_the_join(spark, monkeypatch, bucket):
    for name, value in (("QUERY_BLOCK", 6), ("MEMORY_BLOCK", 17), ("PRODUCT_ROWS", 4)):
        monkeypatch.setattr(K, name, value)
    rng = random.Random(8)
    rows = [[rng.gauss(0, 0.4) for _ in range(4)] for _ in range(80)]
    rows += rows[:20]
    m = spark.createDataFrame(list(enumerate(rows)), "mid long, v array<double>")
    q = m.where("mid % 10 = 0").withColumnRenamed("mid", "id")
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=3, seed=42).fit(M.vectors(m))
    pairs = model.approxSimilarityJoin(M.vectors(q), M.vectors(m), 0.9, "d").select(F.col("datasetA.id").alias("id"), F.col("datasetB.mid").alias("mid"), F.round("d", 6).alias("d")).where("id <> mid")
    want = {}
    for r in pairs.collect():
        want.setdefault(r.id, []).append((r.d, r.mid))
    got = {}
    for r in M.knn_approx(q, m, 3, bucket, 0.9, 3).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((round(r.distance, 6), r.mid))
    assert got == {i: sorted(x)[:3] for i, x in want.items()} and got[0][0] == (0.0, 80)
