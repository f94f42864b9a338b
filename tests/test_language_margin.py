"""The least margin of language ID comes from every reserved text."""

from pyspark.sql import functions as F

from flowharbor.llm import language


def test_margins_of_all_reserved_texts(spark, monkeypatch):
    monkeypatch.setattr(language, "RESERVED", 1)
    monkeypatch.setattr(language, "_prediction", lambda books, c: F.struct(F.substring(c, 1, 1).alias("lang"), F.length(c).cast("double").alias("margin")))
    rows = [(lang, lang + "x" * i) for lang in "ab" for i in range(1, 2000)]
    rows += [("a", "ax")] * 500 + [("b", "axxx"), (None, "ax"), ("a", None), ("a", "a" + "x" * 400_000)]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert language.least_margin(df, {}, share=0.5) == 1001.0
    assert language.least_margin(df, {}, share=1.0) == 400_001.0
