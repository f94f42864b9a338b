"""Mixing sources to target weights by systematic sampling.

Within a source every document expects target / source size copies. Their prefix sum along the source is
rank * expected; with one random offset, a document is emitted once for each integer that its step crosses. The
ranks follow (size class, salted bucket, size), so each class is sampled in proportion and totals stay near the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, WORD_PATTERN, staged, table

WEIGHTS = (1, 2, 3)
#: A source's target is at most so many times its size.
MOST = 3
SEED = 42
#: Rows aimed at in one salted bucket of a size class, which is ranked by one task.
BUCKET_ROWS = 50_000


def sizes(text: str = "text"):
    """Words in a text, 0 if null, by one replacement: each word becomes one letter, with the white space before it."""
    letters = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), f"{SPACE_PATTERN[:-1]}*+{WORD_PATTERN}+", "w")
    return F.length(F.rtrim(letters, F.lit(" \t\n\x0b\x0c\r"))).cast("long")


def targets(per_source: list[tuple], weights: tuple = WEIGHTS, most: float = MOST) -> dict:
    """{source: target} from (source, size): weights repeat over sources by code point, null last; what lies above
    `most` times a size is shared again by weight among the others until none is above."""
    order = sorted(per_source, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size, total = dict(order), float(sum(n for _, n in order))
    out, free, left = {}, list(weight), total
    while free:
        share = left / sum(weight[s] for s in free)
        over = [s for s in free if share * weight[s] > most * size[s]]
        if not over:
            return out | {s: share * weight[s] for s in free}
        out |= {s: float(most * size[s]) for s in over}
        free = [s for s in free if s not in over]
        left = max(0.0, total - sum(out.values()))
    return out


def mix(docs: DataFrame, size_col: str, **how) -> DataFrame:
    """docs plus `mix_source_size`, `mix_target` (long, double) and `mix_copies` (0 to `most`); `size_col` holds sizes.

    Ranking shuffles each row once, dealt by (source, size class, salted bucket): a hot source, size or group of
    copies spreads over buckets, whose number grows with the rows. Only one row a source (name, size) reaches the
    driver. A null size counts as 0, a null source is a source of its own, repeated rows are documents of their own,
    and an empty table gives no rows. Columns of docs that have these three names are replaced.
    """
    made = ("mix_source_size", "mix_target", "mix_copies")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return _mixed(docs, size_col, **how).select(*own, *[F.col(f"__{c}").alias(c) for c in made])


def _mixed(docs: DataFrame, size_col: str, source_col: str = "source", weights: tuple = WEIGHTS, most: int = MOST, seed: int = SEED) -> DataFrame:
    spark, own = docs.sparkSession, [F.col(f"`{c}`") for c in docs.columns]
    buckets = max(4, -(-docs.count() // BUCKET_ROWS))
    salt = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t])
    rows = docs.select(*own, F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("__mix_size"), salt.alias("__mix_hash"))
    rows = rows.withColumns({"__mix_class": F.floor(8 * F.log2(F.col("__mix_size") + 1)).cast("int"), "__mix_bucket": F.pmod(F.col("__mix_hash"), F.lit(buckets)).cast("int")})
    named = rows.groupBy(F.col(source_col).alias("__mix_s"), F.col("__mix_class").alias("__mix_c"), F.col("__mix_bucket").alias("__mix_b"))
    counts = staged(named.agg(F.count("*").alias("n"), F.sum("__mix_size").alias("total")), "mix-counts")
    found = counts.groupBy("__mix_s").agg(F.sum("total").alias("n")).collect()
    goal = targets([(r[0], r.n) for r in found], weights, most)
    facts = spark.createDataFrame([(r[0], r.n, goal[r[0]]) for r in found], "__mix_f string, __mix_source_size long, __mix_target double")
    along = Window.partitionBy("__mix_s").orderBy("__mix_c", "__mix_b")
    before = counts.select("__mix_s", "__mix_c", "__mix_b", (F.sum("n").over(along) - F.col("n")).alias("__mix_before"))
    before = before.join(facts, F.col("__mix_s").eqNullSafe(F.col("__mix_f"))).drop("__mix_f")
    inside = Window.partitionBy(source_col, "__mix_class", "__mix_bucket").orderBy("__mix_size", "__mix_hash")
    ranked = rows.withColumn("__mix_rank", F.row_number().over(inside))
    joined = ranked.join(before, F.col(source_col).eqNullSafe(F.col("__mix_s")) & (F.col("__mix_class") == F.col("__mix_c")) & (F.col("__mix_bucket") == F.col("__mix_b")))
    each = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(0.0)
    offset = F.pmod(F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit(""))), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rank = F.col("__mix_before") + F.col("__mix_rank")
    crossed = F.floor(rank * each + offset) - F.floor((rank - 1) * each + offset)
    return joined.select(*own, "__mix_source_size", "__mix_target", F.least(crossed, F.lit(most)).cast("int").alias("__mix_copies"))


def repeated(docs: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """The mixed documents themselves: each row as often as its copies, with the columns of docs; sizes are words.

    Nulls, repeated rows, ties and empty tables are as in mix(); wordless documents cross boundaries like others.
    """
    mixed = _mixed(docs.withColumn("__mix_words", sizes(text_col)), "__mix_words", **how)
    return mixed.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("__mix_copies")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = staged(table(spark, sf_dir, "documents").select("doc_id", "source", sizes().alias("size")), "sizes")
    taken = (F.col("mix_copies") * F.col("size")).alias("taken")
    return mix(docs, "size").select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), taken)
