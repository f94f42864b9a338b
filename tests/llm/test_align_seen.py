"""A task encodes a stretch once, whatever batch it recurs in, and gives the same links."""

import pyarrow as pa

from flowharbor.llm import align


class Counting:
    def __init__(self, model):
        self.model, self.asked = model, []

    def encode_batch_fast(self, texts, **more):
        self.asked += texts
        return self.model.encode_batch_fast(texts, **more)


def test_stretches_are_encoded_once(monkeypatch):
    (a_model, a_entries), b = align.byte_tokenizer(), align.piece_tokenizer()
    batches = [pa.array(x) for x in (["the quick fox", None, "l'été naïf 東京 ok"], ["fox the new fox", "", "東京 ok the"], ["quick " * 30, "the new " + "long" * 40])]
    plain = [align.linked(x) for x in batches]
    for kept in (100_000, 4, 0):
        counting = Counting(a_model)
        monkeypatch.setattr(align, "KEPT", kept)
        with monkeypatch.context() as m:
            m.setattr(align, "byte_tokenizer", lambda path: (counting, a_entries))
            m.setattr(align, "piece_tokenizer", lambda path: b)
            seen = align.Seen()
            for x, (at, links, text) in zip(batches, plain, strict=True):
                got = align.linked(x, seen=seen)
                assert got[0].equals(at) and got[1].equals(links) and got[2].equals(text)
        short = [t for t in counting.asked if len(t.encode()) <= align.SHORT]
        assert len(seen.stretches) == min(kept, len(set(short)))
        assert (len(short) == len(set(short))) == (kept == 100_000)
