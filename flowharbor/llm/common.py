"""What the training-data operators share: staged tables in the shared folder, connected components, split of learning rows."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than the six ASCII white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SPACE_PATTERN = r"[\x20\x09-\x0D]+"
WORD = re.compile(WORD_PATTERN)
#: One learning row in FOLDS is held out.
FOLDS = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; only a one-machine session that has none gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes that go to Python at once: texts can be long, and a worker holds several copies of a batch.
BATCH_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1000, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH_LIMITS. Jobs (the queries and the pipeline's stages) call
    this where they start; operators leave the session as it is."""
    for key, most in BATCH_LIMITS.items():
        if not 0 < int(re.sub(r"\D", "", spark.conf.get(key)) or 0) <= most:
            spark.conf.set(key, most)


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


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for rows that no model may learn from: crc32 of the id as text is divisible by FOLDS."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root being the smallest node reachable.

    Alternates large-star and small-star steps, each a min-aggregation and an equi-join (whose hot
    keys adaptive execution splits), until the edge set stops changing; rounds grow with the logarithm of the
    component size, not with its diameter. Only a count and a checksum reach the driver.
    """
    plain = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = staged(plain, "edges")
    before = _digest(now)
    while before[0]:
        step = staged(_small_star(_large_star(now)), "edges")
        after = _digest(step)
        discard(now)
        now = step
        if after == before:
            break
        before = after
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them (edges run from larger u to smaller v)."""
    edges = edges.distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A bounded sample to learn from: (doc_id, text, label) of at most `per_class` labelled learning rows of each class.

    Of the labels under a hash threshold that follows the class's size, each class's `per_class` lowest hashes are taken
    (a partial top-k in each task); that list, bounded by the parameter, is broadcast to the documents, so no text is
    shuffled but the sample's. Rows with a null id, text or label and held-out rows teach nothing; of rows with one id, one is used.
    """
    rows = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.where(~held_out()).withColumn("h", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 63) - 1)))
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    cut = counts.select("label", F.expr(f"cast(least(1.0D, 2.0D * {per_class} / n) * 9223372036854775807D as bigint)").alias("cut"))
    near = rows.join(F.broadcast(cut), "label").where("h <= cut").groupBy("doc_id", "h").agg(F.max("label").alias("label"))
    classes = [r.label for r in counts.collect()]
    ids = reduce(DataFrame.unionAll, [near.where(F.col("label") == c).orderBy("h", "doc_id").limit(per_class) for c in classes], near.limit(0)).select("doc_id", "label")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
