"""The corpus pipeline: language, toxicity, near-duplicates, mixture, packing, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowharbor.llm import language, mixing, packing, simhash, toxicity
from flowharbor.llm.common import bounded_batches, held_out, staged, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (so null and empty ones) and those whose two best languages lie closer than nearly
    all right predictions of learning rows do. Repeated rows share one fate; an empty table gives no rows."""
    bounded_batches(spark)
    books = language.dictionaries(docs, learn=~held_out())
    return language.accepted(docs, books, min_margin=language.least_margin(docs, books, learn=~held_out()))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents at least as likely toxic as not. Null and empty texts stay, and so does all where no label marks
    a toxic text. Repeated rows share one fate; an empty table gives no rows."""
    bounded_batches(spark)
    model = toxicity.toxicity_model(docs, table(spark, sf_dir, "labels"))
    return toxicity.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group that SimHash links (three-word shingles, 3 bits, as in op1) join: the smallest id, of
    equal ids the smallest hash. Null and wordless texts are one group; an empty table gives no rows."""
    bounded_batches(spark)
    return simhash.keep_linked(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents as the sources' targets ask. A null source is a source of its own, a null text has
    size 0, repeated rows are documents of their own; an empty table gives no rows."""
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their ids in their places; copies from the mixture are documents of their own. A null text is empty, a
    null id stays null; an empty table gives no rows."""
    bounded_batches(spark)
    return packing.pack_documents(docs)


STAGES = [("language ID", language_id), ("toxicity", toxicity_filter), ("SimHash near-dedup", near_dedup), ("mixing", mix_sources), ("best-fit packing", pack)]
#: Learnt models, hashed shingles and packing have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.split()[0])
    return STAGES[-1][1](spark, docs, sf_dir)
