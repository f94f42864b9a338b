import random
import zlib

import numpy as np

from flowharbor.llm import packing


def ids_of(text):
    return packing._tokenizers(packing.TOKENIZER)[0].encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_whole_text_ids():
    rng, encode = random.Random(2), packing.WordIds()
    alphabet = ["a", "B", "É", "é", "'s", "12", " ", "\n", "\t", "\x0b", " ", "　", "ΣΑΣ", "日本", "🙂", "<|endoftext|>", "!!", "́", "\x1c", "ﬁ", "İ"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 40))) for _ in range(600)]
    texts += [chr(a) + b + chr(c) for a in range(33, 256) for b in ("", "x") for c in (a, 33, 39, 60, 191, 233)]
    for text, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text), repr(text)


def test_long_texts_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(packing, "STRETCH", 50)
    monkeypatch.setattr(packing, "REMEMBERED", 20)
    rng, encode = random.Random(3), packing.WordIds()
    texts = [" ".join(rng.choices(["alpha,", "Éta", "don't", "x" * 70, "12", "(b)"] + [f"w{chr(97 + i)}" for i in range(26)], k=n)) for n in (1, 5, 400, 0, 90)]
    for text, got in zip(texts, encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == ids_of(text)


def test_other_tokenizers_encode_whole_texts():
    encode = packing.WordIds("byte_bpe_50k.json")
    full = packing._tokenizers("byte_bpe_50k.json")[0]
    texts = ["Two  words, and\nmore", "", " é"]
    assert encode.merges is None and [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == [full.encode(t, add_special_tokens=False).ids for t in texts]


def test_plan_places_every_piece_tightly():
    rng = random.Random(4)
    counts = {n: rng.randint(1, 60) for n in rng.sample(range(1, 2049), 700)}
    made = packing.plan(counts)
    placed = {}
    for lengths, times in made:
        assert sum(lengths) <= 2048 and times > 0
        for n in lengths:
            placed[n] = placed.get(n, 0) + times
    assert placed == counts
    bins, total = sum(t for _, t in made), sum(n * c for n, c in counts.items())
    assert bins <= -(-total // 2048) * 1.02 + 1 and len(made) < 3 * 2048


def test_two_replace_the_smallest():
    assert packing.plan({6: 1, 3: 1, 2: 2}, 10) == [((6, 2, 2), 1), ((3,), 1)]


def test_pieces_in_their_places(spark):
    rng = random.Random(9)
    texts = [None, "", "word", "word", " \n ", *[" ".join(rng.choices(["alpha", "beta", "gamma,", "Ünï"], k=rng.choice([3, 50, 700, 5000]))) for _ in range(60)]]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(2, "word", "x"), (None, "word", "y"), (None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string")
    got = packing.pack_documents(df).collect()
    want = []
    for i, t, _ in rows:
        ids = [*ids_of(t), 0]
        want += [(i, k, k * 2048, ids[k * 2048 : (k + 1) * 2048]) for k in range(-(-len(ids) // 2048))]
    have = [(r.doc_id, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in got]
    assert sorted(have, key=str) == sorted(want, key=str)
    by = {}
    for r in got:
        assert r.length == len(r.ids) // 4 and r.ids_crc32 == zlib.crc32(r.ids)
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    bins = []
    for n in sorted((r.length for r in got), reverse=True):
        at = next((i for i, x in enumerate(bins) if x + n <= 2048), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    assert len(by) <= len(bins)
    whole = {r.sequence_id: r.ids for r in packing.sequences(packing.pack_documents(df)).collect()}
    assert sum(len(x) for x in whole.values()) == 4 * sum(r.length for r in got)


def test_empty(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
