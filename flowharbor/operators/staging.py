"""Tables staged in the shared folder, running sums over range partitions, and joins whose hot keys are broadcast."""

from __future__ import annotations

import math
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A key of at least this share of all rows is hot; so at most 1 / HOT keys are, which bounds what `lookup` broadcasts.
HOT = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; only a one-machine session that has none gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark, path = df.sparkSession, getattr(df, "_staged_at", None)
    if path:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def running(df: DataFrame, group: list[str], order: list[str | Column], sums: dict[str, Column], peers: bool = False) -> DataFrame:
    """df with inclusive running sums, along `order` inside each `group` (none: over the whole table), under the names of `sums`.

    Rows are dealt to range partitions of (group, order), so a hot group, or one group of all, spreads over tasks: each
    partition is summed, the sums before it are its offset, and a window inside the partition does the rest. With `peers` rows
    that tie in `order` get the sum up to the last of them (a range partition holds all peers); else their order is theirs
    to fix. Null sums count as 0, null groups are groups; an empty table gives no rows.
    """
    names = list(sums)
    keep = df.columns
    values = {f"_v{i}": F.coalesce(sums[c], F.lit(0)) for i, c in enumerate(names)}
    dealt = df.withColumns(values).repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    rows = staged(dealt, "running")
    per_part = rows.groupBy(*group, "_part").agg(*[F.sum(v).alias(v) for v in values])
    if group:
        upto = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        before = per_part.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), *[F.coalesce(F.sum(v).over(upto), F.lit(0)).alias(f"_b{v}") for v in values])
    else:
        # one row a partition: as many as there are tasks
        before = _offsets(per_part, list(values))
    frame = Window.partitionBy(*group, "_part").orderBy(*order)
    frame = frame.rangeBetween(Window.unboundedPreceding, 0) if peers else frame.rowsBetween(Window.unboundedPreceding, 0)
    inside = rows.withColumns({f"_s{v}": F.sum(v).over(frame) for v in values})
    on = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = inside.join(before if group else F.broadcast(before), on)
    return joined.select(*keep, *[(F.col(f"_s{v}") + F.col(f"_b{v}")).alias(c) for v, c in zip(values, names, strict=True)])


def _offsets(per_part: DataFrame, values: list[str]) -> DataFrame:
    """(_p, _b...) of a table without group: the sums of earlier partitions, from one row a partition."""
    rows = sorted(per_part.collect(), key=lambda r: r["_part"])
    kinds = dict(per_part.dtypes)
    out, so_far = [], [r * 0 for r in rows[0][1:]] if rows else []
    for r in rows:
        out.append((r["_part"], *so_far))
        so_far = [a + b for a, b in zip(so_far, r[1:], strict=True)]
    schema = ", ".join(["_p int"] + [f"_b{v} {kinds[v]}" for v in values])
    return per_part.sparkSession.createDataFrame(out, schema)


def lookup(rows: DataFrame, facts: DataFrame, key: str, weight: str, total: int, hot_share: float = HOT) -> DataFrame:
    """rows left-joined with the one row of facts for their key, `weight` being how many of the `total` rows ask for it.

    Keys that at least `hot_share` of all rows ask for are at most 1 / hot_share, so they are broadcast; the others meet by a shuffle in
    which no key holds more than that share. A null key meets nothing and is not shuffled.
    """
    added = [F.col(c) for c in facts.columns if c not in (key, weight)]
    least = max(1, math.ceil(total * hot_share))
    slim = facts.select(key, weight, *added)
    hot = F.broadcast(slim.where(F.col(weight) >= least).drop(weight))
    cold = slim.where(F.col(weight) < least).drop(weight)
    known, unknown = rows.where(F.col(key).isNotNull()), rows.where(F.col(key).isNull())
    out = known.join(hot, key).unionByName(known.join(hot.select(key), key, "left_anti").join(cold, key, "left"))
    return out.unionByName(unknown, allowMissingColumns=True).select(*rows.columns, *added)


#: Bins of one histogram round of `first_rows`, and rows of the boundary bin that are sorted outright.
BINS, SMALL = 2000, 50_000


def first_rows(df: DataFrame, key: Column, order: list[str | Column], n: int) -> DataFrame:
    """The n rows of df with the smallest (key, order), exactly, however many n is: no top-k heap of n rows, no sort of the table.

    Histograms of the numeric key narrow down the bin in which the n-th row lies until it has at most SMALL rows or one value;
    the rows below it are taken by a filter, the rest from that bin by `order`. Only BINS counts a round reach the driver. Null
    keys come last. If one value of the key has many rows, running counts along `order` pick the rest.
    """
    rows = df.withColumn("_k", key.cast("double"))
    low, high, total = rows.agg(F.min("_k"), F.max("_k"), F.count("_k")).first()
    if n <= 0:
        return df.limit(0)
    if n >= total:
        nulls = df.where(key.isNull())
        return df.where(key.isNotNull()).unionByName(nulls.orderBy(*order).limit(n - total)) if n > total else df.where(key.isNotNull())
    below, inside = 0, total
    while inside > SMALL and low < high:
        at = F.least(F.floor((F.col("_k") - low) / (high - low) * BINS), F.lit(BINS - 1))
        bins = rows.where(F.col("_k").between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("c"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).orderBy("b").collect()
        for b in bins:
            if below + b.c >= n:
                low, high, inside = b.lo, b.hi, b.c
                break
            below += b.c
    edge = rows.where(F.col("_k").between(low, high))
    if inside <= SMALL:
        rest = edge.orderBy("_k", *order).limit(n - below)
    else:
        rest = running(edge, [], order, {"_i": F.lit(1)}).where(F.col("_i") <= n - below).drop("_i")
    return rows.where(F.col("_k") < low).unionByName(rest).drop("_k")


def percentiles(df: DataFrame, key: Column, shares: list[float]) -> list[float | None]:
    """Exact percentiles of a numeric key with linear interpolation, as F.percentile gives them, but without a map of all values in one
    task: histograms narrow down the bin that holds a rank until it has at most SMALL rows or one value. Nulls do not count."""
    rows = df.select(key.cast("double").alias("_k")).where("_k IS NOT NULL")
    least, most, total = rows.agg(F.min("_k"), F.max("_k"), F.count("*")).first()
    if not total:
        return [None for _ in shares]

    def at(rank: int) -> float:
        low, high, below, inside = least, most, 0, total
        while inside > SMALL and low < high:
            bin_ = F.least(F.floor((F.col("_k") - low) / (high - low) * BINS), F.lit(BINS - 1))
            bins = rows.where(F.col("_k").between(low, high)).groupBy(bin_.alias("b")).agg(F.count("*").alias("c"), F.min("_k").alias("lo"), F.max("_k").alias("hi")).orderBy("b").collect()
            for b in bins:
                if below + b.c > rank:
                    low, high, inside = b.lo, b.hi, b.c
                    break
                below += b.c
        return low if low == high else rows.where(F.col("_k").between(low, high)).orderBy("_k").offset(rank - below).limit(1).first()[0]

    places = [(total - 1) * p for p in shares]
    found = {r: at(r) for r in sorted({r for x in places for r in (math.floor(x), math.ceil(x))})}
    ends = [(x, math.floor(x), math.ceil(x)) for x in places]
    return [found[a] if found[a] == found[b] else (b - x) * found[a] + (x - a) * found[b] for x, a, b in ends]


def hash_number(hexes: Column) -> Column:
    """The first 13 digits of a hash in hex as a number that a double holds exactly, in the hash's order."""
    return F.conv(F.substring(hexes, 1, 13), 16, 10).cast("long")


def haloed(df: DataFrame, ts: Column, width: float) -> DataFrame:
    """df dealt to time buckets of `width` seconds, each row also to the next bucket: with `_us` (whole microseconds), `_bucket` and
    `_halo` (1 for the copy). A window over (..., _bucket) that looks back `width` seconds then sees all that it asks for, so a hot
    group, or none, spreads over its buckets; rows with `_halo` = 0 are the result. Null times have a bucket of their own."""
    span = max(1, round(width * 1e6))
    rows = df.withColumn("_us", F.round(ts * 1e6).cast("bigint"))
    at = F.floor(F.col("_us") / span).cast("bigint")
    place = lambda b, halo: F.struct(b.alias("bucket"), F.lit(halo).alias("halo"))
    copies = F.when(at.isNull(), F.array(place(at, 0))).otherwise(F.array(place(at, 0), place(at + 1, 1)))
    return rows.withColumn("_copy", F.explode(copies)).withColumns({"_bucket": F.col("_copy.bucket"), "_halo": F.col("_copy.halo")}).drop("_copy")
