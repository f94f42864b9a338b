import random

import numpy as np
import pytest
import xxhash

from flowharbor.llm import simhash


def brute(rows):
    """(id, text) -> {position: (fingerprint, component id)}, by comparing all pairs."""
    prints = []
    for _, text in rows:
        words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
        shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 3:
                    root[i] = root[j] = min(root[i], root[j])
    least = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            least[r] = min(least.get(r, rows[i][0]), rows[i][0])
    return [(rows[i][0], f"{prints[i]:016x}", least.get(root[i])) for i in range(len(rows))]


def run(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    found = simhash.near_duplicates(df).selectExpr("doc_id", "lpad(lower(hex(fp)), 16, '0') f", "component_id").collect()
    return sorted((tuple(r) for r in found), key=str)


def test_matches_brute_force(spark):
    rng = random.Random(5)
    base = " ".join(rng.choice("abcdefghij") * 3 for _ in range(900)).split()
    rows = [(i, " ".join(base[: 900 - i % 4] + [f"x{i}"] * (i % 3))) for i in range(30)]
    rows += [(100 + i, " ".join(rng.choices("pqrstu", k=20))) for i in range(25)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, "One"), (204, "oNE two"), (205, "one\x0btwo"), (206, "É Ünïcode words"), (None, "one"), (203, "One"), (None, "alone here now")]
    assert run(spark, rows) == sorted(brute(rows), key=str)


def test_cover_misses_no_pair():
    rng, masks = random.Random(1), simhash.cover(0)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(not diff & m for m in masks)
    for finer in simhash.levels():
        for m, xs in rng.sample(sorted(finer.items()), min(20, len(finer))):
            free = [b for b in range(64) if not m >> b & 1]
            for _ in range(50):
                diff = sum(1 << b for b in rng.sample(free, min(len(free), 3)))
                assert any(not diff & x for x in xs)


@pytest.mark.parametrize("bucket", [2, 8])
def test_hot_buckets_are_covered_again(spark, bucket):
    rng = np.random.default_rng(3)
    prints = {int(rng.integers(1 << 62)) for _ in range(20)}
    seed = 0x123456789ABCDEF
    prints |= {seed ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 6)), replace=False)) for _ in range(150)}
    prints = sorted(simhash._signed(x) for x in prints)
    df = spark.createDataFrame([(x,) for x in prints], "fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df, bucket=bucket)).collect()}
    root = {x: x for x in prints}
    for _ in range(20):
        for x in prints:
            for y in prints:
                if ((x ^ y) & ((1 << 64) - 1)).bit_count() <= 3:
                    root[x] = root[y] = min(root[x], root[y])
    assert {x: got.get(x, x) for x in prints} == root


def test_keep_one(spark):
    rows = [(3, "a b c d", "u"), (1, "a b c d", "v"), (1, "a b c d", "v"), (2, "entirely other words here", None), (None, "entirely other words here", "w"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(kept.collect(), key=str) == sorted([(1, "a b c d", "v"), (2, "entirely other words here", None), (None, None, None)], key=str)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0 and simhash.keep_one(df).count() == 0


def similar_groups(texts):
    """Group of each text, by comparing the five-word shingle sets of all pairs."""
    sets = []
    for text in texts:
        words = text.lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    return root


def near_copies(family):
    """Texts of 200 words with 0 to 5 words exchanged, so that similarities lie on both sides of 0.8."""
    rng, out = random.Random(9), []
    for f in range(12):
        base = [f"f{f}w{rng.randrange(500)}" for _ in range(200)]
        for _ in range(family if f == 0 else 5):
            copy = list(base)
            for at in rng.sample(range(200), rng.randrange(6)):
                copy[at] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("family,bucket", [(5, 64), (60, 2)])
def test_keep_one_finds_similar_texts(spark, family, bucket):
    texts = near_copies(family)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(df, bucket=bucket).collect()) == sorted(set(similar_groups(texts)))
