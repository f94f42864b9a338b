"""Scoring with Spark ML: clusters, forests, hashing, projections; prototypes and memory policies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, BucketedRandomProjectionLSH, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions.scalars import hash_rank_key

from .memory import nearest_blocks
from .staging import first_rows, hash_number, percentiles


def vectors(df: DataFrame, column: str = "v") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.transform(column, lambda x: x.cast("double"))))


def prototype_scores(train: DataFrame, rows: DataFrame, percentile: float = 0.99) -> tuple[DataFrame, DataFrame]:
    """CAL01: distance of (id, v) to the mean of the benign train vectors; the threshold is a percentile of the train's own."""
    center = train.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("c"))
    def distance(df: DataFrame) -> DataFrame:
        long = df.select("id", F.posexplode("v").alias("i", "x")).join(F.broadcast(center), "i")
        return long.groupBy("id").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2)))).alias("score"))

    return distance(rows), distance(train).agg(F.percentile("score", F.lit(percentile)).alias("threshold"))


def knn_approx(query: DataFrame, memory: DataFrame, k: int, bucket: float, radius: float, tables: int = 6, seed: int = 42) -> DataFrame:
    """JOI15: neighbours within `radius` among those that a random projection brings together, ranked by exact distance, the query's own
    row aside. A bucket that holds most rows makes no pairs in a shuffle: rows meet in blocks, where equal hashes allow a pair."""
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(vectors(memory))
    held = F.array(*[vector_to_array(F.col("hashes")[t])[0].cast("long") for t in range(tables)])
    hashed = lambda df, key: model.transform(vectors(df)).select(key, "v", held.alias("h"))

    def prepare(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.array(rows["v"].tolist(), float)
        return x, (x * x).sum(1), np.array(rows["h"].tolist())

    def distances(a: tuple, b: tuple) -> np.ndarray:
        away = np.sqrt(np.round(np.maximum(a[1][:, None] + b[1][None, :] - 2 * (a[0] @ b[0].T), 0), 12))
        met = np.zeros(away.shape, bool)
        for t in range(tables):
            met |= a[2][:, [t]] == b[2][None, :, t]
        return np.where(met & (away < radius), away, np.inf)

    return nearest_blocks(hashed(query, "id"), hashed(memory, "mid"), k, prepare, distances)


def cluster_scores(train: DataFrame, rows: DataFrame, clusters: int, seed: int = 42) -> DataFrame:
    """CAL12: least variance-scaled distance of (id, v) to the k-means clusters of the train rows."""
    model = KMeans(k=clusters, seed=seed, maxIter=20).fit(vectors(train))
    own = model.transform(vectors(train)).select("prediction", F.posexplode("v").alias("i", "x"))
    stats = own.groupBy("prediction", "i").agg(F.avg(F.col("x").cast("double")).alias("c"), F.greatest(F.var_pop(F.col("x").cast("double")), F.lit(1e-6)).alias("var"))
    long = rows.select("id", F.posexplode("v").alias("i", "x")).join(F.broadcast(stats), "i")
    each = long.groupBy("id", "prediction").agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2)) / F.col("var"))).alias("d"))
    return each.groupBy("id").agg(F.min("d").alias("score"))


def forest_baseline(train: DataFrame, test: DataFrame, columns: list[str], trees: int = 20, seed: int = 42) -> DataFrame:
    """CAL14: random forest on tabular columns: (id, label, prediction, probabilities)."""
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(train)
    assemble = VectorAssembler(inputCols=columns, outputCol="features")
    model = RandomForestClassifier(labelCol="y", featuresCol="features", numTrees=trees, maxDepth=6, seed=seed).fit(assemble.transform(index.transform(train)))
    names = F.array(*[F.lit(x) for x in index.labels])
    out = model.transform(assemble.transform(test))
    return out.select("id", "label", F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"), vector_to_array("probability").alias("probabilities"))


def correlated_groups(features: DataFrame, columns: list[str], most: int) -> DataFrame:
    """AGG38: features in groups of up to `most`: seeds by variance, each joined by the most correlated ones left. The
    loop sees the columns' correlation matrix only."""
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(features)
    matrix = Correlation.corr(rows, "features").first()[0].toArray()
    spread = features.agg(*[F.var_pop(c).alias(c) for c in columns]).first().asDict()
    left, out, group = sorted(columns, key=lambda c: (-spread[c], c)), [], 0
    while left:
        seed = left.pop(0)
        i = columns.index(seed)
        mates = sorted(left, key=lambda c: (-abs(matrix[i, columns.index(c)]), c))[: most - 1]
        out += [(group, c) for c in (seed, *mates)]
        left = [c for c in left if c not in mates]
        group += 1
    return features.sparkSession.createDataFrame(out, "group int, feature string")


def domain_gap(rows: DataFrame, domain: str, most: int = 400, seed: int = 42) -> DataFrame:
    """AGG39: between any two domains of (domain, v): distance of their centroids and RBF discrepancy (MMD, width 1) in the two
    main components of standardised vectors. At most `most` rows a domain, drawn by hash: the bound of the kernel's pairs."""
    drawn = rows.withColumn("nth", F.row_number().over(Window.partitionBy(domain).orderBy(F.xxhash64(F.lit(seed), "v")))).where(F.col("nth") <= most).drop("nth")
    scaler = StandardScaler(withMean=True, inputCol="features", outputCol="scaled").fit(vectors(drawn))
    scaled = scaler.transform(vectors(drawn))
    two = PCA(k=2, inputCol="scaled", outputCol="p").fit(scaled).transform(scaled).select(F.col(domain).alias("d"), vector_to_array("p").alias("p"))
    two = two.select("d", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
    c = two.groupBy("d").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    square = F.pow(F.col("a.x") - F.col("b.x"), F.lit(2)) + F.pow(F.col("a.y") - F.col("b.y"), F.lit(2))
    near = two.alias("a").join(F.broadcast(two).alias("b"), F.expr("a.d <= b.d")).groupBy(F.col("a.d").alias("one"), F.col("b.d").alias("other")).agg(F.avg(F.exp(-square / 2)).alias("k"))
    own = near.where("one = other").select("one", F.col("k").alias("own"))
    mmd = near.where("one < other").join(own, "one").join(own.withColumnsRenamed({"one": "other", "own": "theirs"}), "other").select("one", "other", (F.col("own") + F.col("theirs") - 2 * F.col("k")).alias("mmd"))
    apart = c.alias("a").join(c.alias("b"), F.expr("a.d < b.d")).select(F.col("a.d").alias("one"), F.col("b.d").alias("other"), F.sqrt(square).alias("distance"))
    return apart.join(mmd, ["one", "other"])


def memory_cuts(candidates: DataFrame) -> tuple[int, float, float]:
    """CAL08: how many candidates there are, their scores' median and 95th percentile, which several policies share."""
    return candidates.count(), *percentiles(candidates, F.col("score"), [0.5, 0.95])


def govern_memory(memory: DataFrame, candidates: DataFrame, policy: str, seed: int = 42, cuts: tuple[int, float, float] | None = None) -> DataFrame:
    """CAL08: the memory (mid, score) after an update by policy; candidates' scores are their distances to the memory.

    core75: none; all: every candidate; random: half of them by hash order; low_score: up to their median; tail_aware:
    these and, of those from the 95th percentile on, a twentieth of all by id; quarantine: up to the 95th percentile, the rest waits.
    """
    n, low, gate = cuts or memory_cuts(candidates)
    if policy == "random":
        key = hash_rank_key(F.col("mid"), seed, "update")
        more = first_rows(candidates, hash_number(key), [key, "mid"], max(1, n // 2))
    elif policy == "tail_aware":
        tail = first_rows(candidates.where(F.col("score") >= F.lit(gate)), F.col("mid"), ["mid"], max(1, n // 20))
        more = candidates.where(F.col("score") <= F.lit(low)).unionByName(tail.where(F.col("score") > F.lit(low)))
    else:
        more = candidates.where({"core75": F.lit(False), "all": F.lit(True), "low_score": F.col("score") <= F.lit(low), "quarantine": F.col("score") <= F.lit(gate)}[policy])
    return memory.select("mid", "score", F.lit("memory").alias("origin")).unionByName(more.select("mid", "score", F.lit("candidate").alias("origin")))


def core_split(memory: DataFrame, share: float = 0.75, least: int = 1, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """CAL08: the memory's core of a share of its rows (mid, ...) by hash order, at least `least`, and the candidates that remain."""
    want = max(least, round(memory.count() * share))
    key = hash_rank_key(F.col("mid"), seed, "core")
    core = first_rows(memory, hash_number(key), [key, "mid"], want)
    return core, memory.join(core.select("mid"), "mid", "left_anti")


def window_centroids(windows: DataFrame, clusters: int, seed: int = 42) -> list[list[float]]:
    """CAL13: k-means centres of benign windows (v) without the smallest cluster: what benign windows look like."""
    rows = vectors(windows)
    model = KMeans(k=clusters, seed=seed, maxIter=20).fit(rows)
    sizes = {r.prediction: r["count"] for r in model.transform(rows).groupBy("prediction").count().collect()}
    kept = sorted(sizes, key=lambda c: (-sizes[c], c))[: max(1, len(sizes) - 1)]
    return [model.clusterCenters()[c].tolist() for c in kept]


def window_centroid_scores(windows: DataFrame, centroids: list[list[float]]) -> DataFrame:
    """CAL13: (id, score): Euclidean distance of (id, v) to the nearest of a few centroids."""
    gap = lambda c: F.sqrt(F.aggregate(F.zip_with("v", F.array(*[F.lit(x) for x in c]), lambda a, b: F.pow(a.cast("double") - b, F.lit(2))), F.lit(0.0), lambda s, x: s + x))
    return windows.select("id", F.array_min(F.array(*[gap(c) for c in centroids])).alias("score"))


def diagnosis(alerts: DataFrame, memory: DataFrame, neighbours: DataFrame) -> DataFrame:
    """AGG43: of alerts' token weights (id, token, w), memory's (mid, token, w) and neighbour pairs (id, mid): by token
    family, the sum of |w - mean neighbour w|, and whether it is the alert's dominant one."""
    k = neighbours.groupBy("id").agg(F.count("*").alias("k"))
    near = neighbours.join(memory, "mid").join(k, "id").groupBy("id", "token", "k").agg((F.sum("w") / F.first("k")).alias("m")).drop("k")
    both = alerts.select("id", "token", "w").join(near, ["id", "token"], "full_outer")
    gap = both.join(alerts.select("id").distinct(), "id", "left_semi").groupBy("id", F.substring("token", 1, 1).alias("family")).agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("m", F.lit(0.0)))).alias("deviation"))
    return gap.withColumn("dominant", (F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("deviation", 9)), "family")) == 1).cast("int"))


