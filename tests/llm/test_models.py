"""Language, quality, toxicity and the pipeline, on planted data and by held-out accuracy."""

import random
import zlib

import pytest

import corpus_pipeline
from flowharbor.llm import language, quality, toxicity
from flowharbor.llm.common import held_out, table

SF = "/root/testdata/sf0.01"


def is_held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_held_out(spark):
    rows = spark.createDataFrame([(i,) for i in [*range(200), -3, None]], "doc_id long").select("doc_id", held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and is_held_out(r.doc_id)) for r in rows)


def test_language_held_out_accuracy(spark):
    from flowharbor.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op2_language_id"](spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "lang").collect()
    tested = [r for r in docs if is_held_out(r.doc_id) and r.lang]
    assert len(got) == len(docs) and sum(got[r.doc_id].lang_pred == r.lang for r in tested) >= 0.95 * len(tested)
    assert all(0 <= r.score <= 1 and r.held_out == is_held_out(r.doc_id) for r in got.values())


def test_letters_and_what_only_looks_like_them():
    books = (("aa", b"anna banana canna manna " * 40), ("bb", b"bobo dodo toto momo lolo " * 40))
    assert language.classify("½ ² Ⅷ", books) == ("und", 0.0) and language.normalised("a½b Ⅷ c_1") == "a b c"


def test_dictionaries_count_copies_once_and_read_long_texts(spark, monkeypatch):
    """3,000 copies of one text neither crowd out a language's other texts nor empty its dictionary; texts longer than a
    dictionary teach a stretch; no text is both in a dictionary and among those that margins are measured on."""
    monkeypatch.setattr(language, "DICTIONARY_BYTES", 4000)
    rows = [(i, "copied words " * 200, "xx") for i in range(3000)] + [(5000 + i, f"other{i} text{i} " * 10, "xx") for i in range(200)] + [(9000 + i, f"lang{i} " * 5000, "yy") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    books = language.dictionaries(df, size=4000)
    assert set(books) == {"xx", "yy"} and all(2000 < len(b) <= 4000 for b in books.values()) and books["xx"].count(b"other") > 20
    sides = [{r.h for r in language._learnt(df, "text", "lang", None, side).select("h").collect()} for side in (False, True)]
    assert sides[0] and sides[1] and not sides[0] & sides[1] and len(sides[0] | sides[1]) == 231
    assert language.least_margin(df, books) >= language.TIE


def test_language_defined_cases(spark):
    books = {"aa": b"anna banana canna manna " * 40, "bb": b"bobo dodo toto momo lolo " * 40}
    rows = [(1, "banana manna"), (2, "dodo toto bobo"), (3, None), (4, ""), (5, "12 !? 34"), (6, "x"), (1, "banana manna"), (7, "anna canna " * 20000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'z' as lang_pred")
    got = {r.doc_id: (r.lang_pred, r.lang_accepted) for r in language.identified(df, books).collect()}
    assert got[1][0] == got[7][0] == "aa" and got[2] == ("bb", True) and got[3] == got[4] == got[5] == ("und", False)
    kept = language.accepted(df, books)
    assert kept.columns == df.columns and kept.where("doc_id in (3, 4, 5)").count() == 0 and kept.where("doc_id = 1").count() == 2
    assert language.identified(df, {}).where("lang_pred <> 'und'").count() == 0
    assert language.dictionaries(spark.createDataFrame([], "doc_id long, text string, lang string")) == {}


def test_quality_held_out_accuracy(spark):
    from flowharbor.llm.registry import QUERIES

    got = {r.doc_id: r for r in QUERIES["op3_quality"](spark, SF).collect()}
    labels = [r for r in table(spark, SF, "labels").collect() if is_held_out(r.doc_id)]
    assert sum(got[r.doc_id].predicted == r.quality for r in labels) >= 0.93 * len(labels)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())


def test_quality_defined_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "a word")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.ranked(docs.selectExpr("*", "9 as quality_score"), quality.quality_model(docs, labels)).collect()
    assert len(out) == 4 and all(0 <= r.quality_score <= 1 for r in out)
    assert quality.ranked(docs.limit(0), quality.quality_model(docs, labels)).count() == 0


def toxic_corpus():
    rng = random.Random(8)
    clean = [f"{a}{b}" for a in ("lor", "mip", "sed", "tum") for b in ("ano", "ibo", "ust", "ere", "olo")]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(clean, k=rng.randint(20, 120))
        bad = i % 4 == 0
        for _ in range(rng.randint(1, 8) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["nasty", "vileone", "viletwo", "vilexyz", "grr"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_finds_planted_words(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows + [(1000, None), (1001, ""), (1002, "lorano " * 30000), (1003, "a vilenew word"), (0, rows[0][1])], "doc_id long, text string")
    model = toxicity.toxicity_model(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert (model.weights >= 0).all() and list(model.cuts) == sorted(model.cuts)
    out = {r.doc_id: r for r in toxicity.scored(docs.selectExpr("*", "1 as tox_severity"), model).collect()}
    wrong = [i for i, (_, _, t) in enumerate(labels) if out[i].tox_rejected != bool(t)]
    assert not wrong and out[1003].tox_probability > 2 * out[1001].tox_probability
    assert not any(out[i].tox_rejected for i in (1000, 1001, 1002))
    assert all(0 <= r.tox_probability <= 1 and 0 <= r.tox_severity <= 3 for r in out.values())
    mild = [out[i].tox_severity for i, t in rows if sum(w in t for w in ("nasty", "vile", "grr")) == 0]
    assert max(mild) < min(out[i].tox_severity for i, _, t in labels if t)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "x"), (None, None)], "doc_id long, text string")
    model = toxicity.toxicity_model(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.accepted(docs, model).count() == 2


def test_few_toxic_labels_reject_no_text_without_a_mark(spark):
    rows, labels = toxic_corpus()
    docs = spark.createDataFrame(rows[:24] + [(1001, "")], "doc_id long, text string")
    kept = toxicity.accepted(docs, toxicity.toxicity_model(docs, spark.createDataFrame(labels[:24], "doc_id long, quality int, toxic int")))
    assert {i for i, _, t in labels[:24] if not t} | {1001} <= {r.doc_id for r in kept.collect()}


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.language_id(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() >= 0.97 * docs.count()
    clean = corpus_pipeline.toxicity_filter(spark, docs, SF)
    labels = {r.doc_id: r.toxic for r in table(spark, SF, "labels").collect()}
    ids = {r.doc_id for r in clean.select("doc_id").collect()}
    assert clean.columns == docs.columns
    # some 40 toxic learning rows in four languages do not show every word; check_s, with 1,735, gives 0.99 and over
    assert sum(i not in ids for i, t in labels.items() if t) >= 0.65 * sum(labels.values())
    assert sum(i in ids for i, t in labels.items() if not t) >= 0.98 * sum(1 - t for t in labels.values())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "toxicity", "SimHash near-dedup", "mixing", "best-fit packing"]


@pytest.mark.parametrize("extra", [False, True])
def test_pipeline_stages_on_odd_tables(spark, tmp_path, extra):
    rows = [(1, "one two three", "en", "a"), (1, "one two three", "en", "a"), (None, None, None, None), (2, "", "en", "b"), (3, "un deux trois", "fr", None)]
    for name, some in (("odd", rows), ("empty", [])):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string")
        if extra:
            docs = docs.selectExpr("*", "1 as piece", "2 as mix_size", "3 as fp", "'x' as lang_pred", "true as tox_rejected", "4 as sequence_id")
        sf = str(tmp_path / name)
        spark.createDataFrame([(1, 1, 0), (3, 0, 1)][: len(some)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
