"""Prefix trie against a dictionary of whole prefixes."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from flowharbor.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in turns.items()}
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, ts in built.items():
        ends[ts].append(c)
        for d in range(len(ts) + 1):
            members[ts[:d]].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in members.items())


def ours(spark, rows, tail):
    found = trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), tail).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in found)


def corpus(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 120):
        for i in range(rng.randint(1, 9)):
            rows.append((c, i, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é🙂", "long " * 50])))
    rows += [(250, i, "user", f"t{i}") for i in range(60)] + [(251, i, "user", f"t{i}") for i in range(45)]
    return rows


@pytest.mark.parametrize(("seed", "tail"), [(1, 20_000), (2, 100), (3, 0)])
def test_agrees_with_dictionaries(spark, seed, tail, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 3)
    rows = corpus(seed)
    if tail == 0:  # a job a depth: keep it shallow
        rows = [r for r in rows if r[1] < 7]
    assert ours(spark, rows, tail) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, None, None, None), (0, None, None, None), (0, 1, "user", ""), (None, 0, "user", "x"), (5, 3, "a:1", "x"), (5, 3, "a", ":1x"), (5, 3, "a", ":1x"), (199, 0, "user", "only"), (100, 0, "user", "y" * 300_000), (101, 0, "user", "y" * 300_000)]
    assert ours(spark, rows, 1000) == brute(rows) == ours(spark, rows, 2)


def test_copies_of_one_conversation_and_an_empty_table(spark):
    rows = [(c, t, "user", f"{t}") for c in range(300) for t in range(7)]
    assert ours(spark, rows, 100) == brute(rows)
    assert ours(spark, [], 100) == []
    extra = spark.createDataFrame([(1, 0, "user", "x", b"k", 3, 4)], SCHEMA + ", key binary, total int, c int")
    assert {r.depth for r in trie.prefix_trie(extra).collect()} <= {0, 1}
