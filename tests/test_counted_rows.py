"""Words counted inside their text's row, as `token_counts` counts them, without a shuffle."""

from flowharbor.operators import tokens as T
from flowharbor.plans import binding as B
from flowharbor.plans import registry

SF = "/root/testdata/sf0.001"


def test_counts_equal_the_grouped_ones(spark):
    names = ["flow_id", "split", "label", "token", "n"]
    made = B.token_counts(spark, SF)
    assert "HashAggregate" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(made.select(names).collect()) == sorted(T.token_counts(B.token_rows(spark, SF)).select(names).collect())


def test_texts_without_words_and_odd_spaces(spark, tmp_path):
    texts = [" \t b a  B\n", "", None, "\x0b", "a a é", "  a"]
    spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = sorted((r.flow_id, r.token, r.n) for r in B.token_counts(spark, str(tmp_path)).collect())
    assert got == [(0, "a", 1), (0, "b", 2), (4, "a", 2), (4, "é", 1), (5, "a", 1), (5, " ", 1)]


def test_queries_group_no_words(spark, monkeypatch):
    monkeypatch.setattr(T, "token_counts", lambda tokens: 1 / 0)
    for name in ("joi13_knn_sparse", "joi14_knn_inverted", "cal15_leave_one_job", "cal11_sweep"):
        registry.QUERIES[name](spark, SF)


def test_pairs_equal_the_windowed_ones(spark):
    names = ["flow_id", "split", "gram", "n"]
    made = B.pair_counts(spark, SF)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "HashAggregate" not in plan
    for least in (1, 10):
        assert sorted(T.frequent_grams(made, least).select(names).collect()) == sorted(T.ngrams(B.token_rows(spark, SF), 2, least).select(names).collect())


def test_augmentation_sorts_no_words(spark, monkeypatch):
    monkeypatch.setattr(T, "ngrams", lambda *a: 1 / 0)
    assert registry.QUERIES["agg18_augment_sequences"](spark, SF).count() > 0
