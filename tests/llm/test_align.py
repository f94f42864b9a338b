"""Token alignment against token-by-token loops."""

import hashlib
import random
from collections import Counter

from flowharbor.llm import align


def spans(ids, entries):
    out, at = [], 0
    for i in ids:
        out.append((at, at + len(entries[i]), i))
        at += len(entries[i])
    return out


def brute(rows):
    a_model, a_entries = align.byte_tokenizer()
    b_model, b_entries = align.piece_tokenizer()
    a_entries, b_entries = a_entries.to_pylist(), b_entries.to_pylist()
    docs, held = [], Counter()
    for doc, text in rows:
        a, b = (a_model.encode(" " + text, add_special_tokens=False).ids, b_model.encode(text)) if text else ([], [])
        want = (" " + (text or "")).encode()
        links, groups = Counter(), []
        if text and b"".join(a_entries[i] for i in a) == want == b"".join(b_entries[i] for i in b):
            sa, sb = spans(a, a_entries), spans(b, b_entries)
            low = 0
            for cut in sorted({e for _, e, _ in sa} & {e for _, e, _ in sb}):
                groups.append("|".join(",".join(str(i) for s, _, i in side if low <= s < cut) for side in (sa, sb)))
                low = cut
            links.update((i, j) for s, e, i in sa for t, f, j in sb if s < f and t < e)
        else:
            a = b = []
        held.update(links.keys())
        docs.append((doc, len(a), len(b), len(groups), links, ";".join(groups)))
    best = {}
    for (i, _), n in held.items():
        best[i] = max(best.get(i, 0), n)
    return sorted((d, na, nb, ng, sum(k.values()), sum(m for p, m in k.items() if held[p] == best[p[0]]), sum(m * held[p] for p, m in k.items()), hashlib.sha256(g.encode()).hexdigest() if g else "") for d, na, nb, ng, k, g in docs)


def ours(spark, rows):
    found = align.alignment(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in found)


def corpus(seed):
    rng = random.Random(seed)
    words = ["the", "quality", "Straße", "naïve", "🙂🙃", "<s>", "<|endoftext|>", "   ", "\n\n", "don't", "1234567", "文字", "<0x41>", "\t", "unbelievableness"]
    return [(i, "".join(rng.choice(words) + rng.choice([" ", "", "."]) for _ in range(rng.randint(1, 60)))) for i in range(60)]


def test_agrees_with_loops(spark, monkeypatch):
    for frequent in (align.FREQUENT, 20):  # most pairs by the broadcast, then most by the shuffle
        monkeypatch.setattr(align, "FREQUENT", frequent)
        rows = corpus(4)
        assert ours(spark, rows) == brute(rows)


def test_odd_texts(spark, monkeypatch):
    monkeypatch.setattr(align, "PARTIAL", 10)
    rows = [(1, None), (2, ""), (3, " "), (4, "a ▁ b"), (5, "\x00\x01"), (6, "x"), (6, "x"), (6, "x"), (7, "y " * 30_000), (8, "é" * 5000), (9, "z" * 20_000)]
    quick = [r for r in rows if len(r[1] or "") < 20_000]
    assert ours(spark, quick) == brute(quick)
    found = {r[0]: r for r in ours(spark, rows)}
    assert found[4][1:] == (0, 0, 0, 0, 0, 0, "") and found[1] == (1, 0, 0, 0, 0, 0, 0, "")
    assert found[7][1] > 30_000 and found[9][4] == found[9][1] + found[9][2] - found[9][3]


def test_empty_table_null_ids_and_extra_columns(spark):
    assert ours(spark, []) == []
    df = spark.createDataFrame([(None, "x y", 1, [1])], "doc_id long, text string, rid int, pairs array<int>")
    assert [(r.doc_id, r.n_a, r.n_b) for r in align.alignment(df).collect()] == [(None, 2, 2)]
