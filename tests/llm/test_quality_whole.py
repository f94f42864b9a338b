"""The quality model learns from every labelled learning row, by exact quantiles and all preference pairs."""

import numpy as np
from pyspark.sql import functions as F

from flowharbor.llm import quality
from flowharbor.llm.common import held_out


def test_every_learning_row_is_used(spark):
    rows = [(i, "word " * (1 + i % 7), i % 2) for i in range(13_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    wanted = df.where(~held_out()).count()
    assert wanted > 10_000  # more than a sample of 5,000 of each label holds
    assert quality.learning_rows(df.select("doc_id", "text"), df.select("doc_id", "quality")).count() == wanted


def test_order_statistics_are_exact(spark):
    rng = np.random.default_rng(2)
    x = np.stack([rng.normal(size=3000), np.round(rng.random(3000), 2), np.zeros(3000)], 1).astype(np.float32)
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5)
    ranks = [1, 2, 700, 1500, 3000]
    got = quality.order_statistics(df, lambda pdf: np.stack(pdf["x"].to_numpy()), ranks, 3)
    assert np.array_equal(got, np.sort(x, axis=0)[np.array(ranks) - 1].T)


def test_weights_are_the_optimum_over_all_pairs(spark):
    rng = np.random.default_rng(4)
    bins = rng.integers(0, quality.BINS, (160, 3)).astype(np.uint8)
    label = (bins[:, 0] + rng.normal(size=160) * 3 > 4.5).astype(int)
    df = spark.createDataFrame([(int(y), bytearray(b.tobytes())) for y, b in zip(label, bins)], "label int, bins binary").withColumn("label", F.col("label").cast("int"))
    w = quality.fit_weights(df, 3)
    hot = np.zeros((160, 30))
    hot[np.arange(160)[:, None], bins + 10 * np.arange(3)] = 1
    d = (hot[label == 1][:, None] - hot[label == 0][None]).reshape(-1, 30)
    loss = lambda v: np.logaddexp(0, -d @ v).mean() + quality.RIDGE / 2 * v @ v
    best = np.zeros(30)
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ best))
        best += np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + quality.RIDGE * np.eye(30), d.T @ p / len(d) - quality.RIDGE * best)
    assert loss(w) < loss(best) * 1.003 < loss(np.zeros(30))
