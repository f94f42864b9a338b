import random
import re

import pytest
from pyspark.sql import functions as F

from flowharbor.llm import mixing


def test_sizes_count_words(spark):
    texts = [None, "", " ", "a", " a", "a ", "\n a\tb\x0b\x0cc \r", "é ü", "x" * 5000, "a b c\x1cd"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.sizes().alias("n")).collect()
    assert [r.n for r in got] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_targets():
    assert mixing.targets([("a", 600), ("b", 600), (None, 600)]) == pytest.approx({"a": 300, "b": 600, None: 900})
    got = mixing.targets([("a", 1000), ("b", 10), ("c", 1000)])
    assert got["b"] == 30 and got["a"] == pytest.approx(1980 / 4) and got["c"] == pytest.approx(1980 * 3 / 4)
    assert mixing.targets([]) == {} and mixing.targets([("a", 0)]) == {"a": 0.0}


def docs(spark, n=3000):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * int(rng.lognormvariate(4, 1))), rng.choice(["a", "a", "a", "b", "c", None]), i) for i in range(n)]
    rows += [(1, "w w", "a", 1)] * 300 + [(None, None, None, None), (5, "", "d", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, mix_copies long")


def test_mix_comes_near_targets_and_reruns_agree(spark):
    df = docs(spark).withColumn("size", mixing.sizes())
    out = mixing.mix(df.drop("mix_copies"), "size")
    rows = out.collect()
    assert len(rows) == df.count()
    by = {}
    for r in rows:
        assert 0 <= r.mix_copies <= 3
        by.setdefault(r.source, [r.mix_target, r.mix_source_size, 0, 0])
        by[r.source][2] += r.mix_copies * r.size
        by[r.source][3] += r.size
    for target, size, taken, real in by.values():
        assert size == real and target <= 3 * size and abs(taken - target) <= 0.02 * target + 400
    assert sum(t[0] for t in by.values()) == pytest.approx(sum(t[1] for t in by.values()))
    again = mixing.mix(df.drop("mix_copies").repartition(5), "size").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_repeated_keeps_columns(spark):
    df = docs(spark, 200)
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.count() > 0
    assert out.groupBy("doc_id", "text", "source").count().agg(F.max("count")).first()[0] <= 3 * 300


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.repeated(df).count() == 0


def test_copies_are_those_of_sequential_systematic_sampling(spark):
    df = docs(spark, 800).withColumn("size", mixing.sizes()).drop("mix_copies")
    rows = mixing._mixed(df.withColumn("__mix_words", mixing.sizes()), "__mix_words").collect()
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    for source, some in by.items():
        target, size = some[0]["__mix_target"], some[0]["__mix_source_size"]
        each, at, offset, copies = (target / size if size else 0.0), 0.0, spark.range(1).select(F.pmod(F.xxhash64(F.lit(mixing.SEED), F.lit("" if source is None else f"s{source}")), F.lit(1 << 30)) / float(1 << 30)).first()[0], 0
        steps = []
        for n in range(1, len(some) + 1):
            steps.append(int(n * each + offset) - int((n - 1) * each + offset))
        assert sorted(steps) == sorted(r["__mix_copies"] for r in some)
