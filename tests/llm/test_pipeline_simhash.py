"""The pipeline's near-dedup keeps one document of each SimHash component, by the links that op1 finds."""

import random

import corpus_pipeline
from flowharbor.llm import simhash


def test_near_dedup_keeps_one_of_each_simhash_component(spark):
    rng = random.Random(3)
    base = [f"w{rng.randrange(400)}" for _ in range(900)]
    texts = [" ".join(base[: 900 - i % 4] + [f"x{i}"] * (i % 3)) for i in range(30)]
    texts += [" ".join(rng.choices("pqrstu", k=20)) for _ in range(25)] + ["", "one two", "One  two", "one two"]
    # five of 200 words changed: similar shingle sets, but fingerprints further apart than 3 bits
    far = [f"v{i}" for i in range(200)]
    texts += [" ".join(far), " ".join(x + "x" * (i % 40 == 0) for i, x in enumerate(far))]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, "one two", "s"), (None, None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = corpus_pipeline.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    wanted = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    got = [r.doc_id for r in kept.collect()]
    assert sorted(got) == sorted(wanted) and len(wanted) < len(texts) - 20 and {len(texts) - 2, len(texts) - 1} <= wanted
