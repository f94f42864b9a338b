"""Exact percentiles by histograms."""

from pyspark.sql import functions as F

from flowharbor.operators import staging


def test_as_the_builtin_gives_them(spark, monkeypatch):
    monkeypatch.setattr(staging, "SMALL", 5)
    monkeypatch.setattr(staging, "BINS", 7)
    rows = spark.range(1000).select(F.when(F.col("id") % 9 > 0, F.pmod(F.xxhash64("id"), F.lit(400)) / 3.0).alias("x"))
    shares = [0.0, 0.013, 0.5, 0.95, 1.0]
    assert staging.percentiles(rows, F.col("x"), shares) == rows.agg(F.percentile("x", F.array(*[F.lit(p) for p in shares]))).first()[0]
    assert staging.percentiles(rows.where("false"), F.col("x"), [0.5]) == [None]
