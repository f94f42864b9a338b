"""Alignment of two tokenizers' tokens by the bytes that they cover, in Arrow.

Per batch of documents: both tokenizers' id lists are flattened with their parents, segmented cumulative sums of token
lengths give byte ends, and a hash join of both sides on (document, end) finds where the byte ranges meet: each row of the
full outer join is one linked pair, each match ends a group. Partial counts of id pairs by batch are merged by Spark.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowharbor.operators.staging import staged

from .common import bounded_batches, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: An id pair in one long: A's id times PAIR plus B's. Both vocabularies are smaller.
PAIR = 1 << 16
#: Pairs in most documents: at most so many are broadcast, the other pairs' links are joined by a shuffle.
FREQUENT = 100_000
#: Before a space that stands between a visible Latin character and a Latin letter both tokenizers cut always: byte-level BPE
#: begins a word there, and no piece holds a space behind another character. So what lies between cuts is encoded once
#: however often it occurs.
CUT = re.compile(r"(?<=[!-~\u00c0-\u024f])(?= [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f])")
#: Distinct pairs that a task counts before it hands them on.
PARTIAL = 500_000
#: Stretches that a task remembers with both tokenizers' ids, and the longest of them in bytes: most words recur from batch to batch.
KEPT, SHORT = 100_000, 48


def _byte_of() -> dict[str, int]:
    """Byte-level BPE writes printable Latin-1 bytes as themselves and the others, in order, as code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@cache
def byte_tokenizer(path: str = BYTE_BPE):
    """The tokenizer and its entries' bytes by id; an entry that isn't byte-level text stands for its own UTF-8."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    of, vocabulary = _byte_of(), json.loads(tokenizer.to_str())["model"]["vocab"]
    entries = [b""] * (max(vocabulary.values()) + 1)
    for entry, i in vocabulary.items():
        entries[i] = bytes(of[c] for c in entry) if all(c in of for c in entry) else entry.encode()
    return tokenizer, pa.array(entries, pa.binary())


@cache
def piece_tokenizer(path: str = PIECE_BPE):
    """The tokenizer and its pieces' bytes by id: U+2581 is a space, a byte piece <0xHH> its byte."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]
    if any(" " in p.decode(errors="replace").lstrip(" ") for p in pieces):
        raise ValueError("a piece reaches over a space, so texts cannot be cut before words")
    return model, pa.array(pieces, pa.binary())


class Seen:
    """Both tokenizers' ids of stretches that a task has encoded before: the first KEPT short ones."""

    def __init__(self) -> None:
        self.stretches, self.ids = pa.array([], pa.string()), [pa.array([], pa.list_(pa.int32()))] * 2

    def encoded(self, distinct: pa.Array, a_model, b_model) -> tuple[pa.Array, list[pa.Array]]:
        """Of distinct stretches, each behind a space: the places of their ids in two arrays of lists. Only stretches not seen before are encoded."""
        at = pc.index_in(distinct, self.stretches)
        new = distinct.filter(at.is_null())
        texts = new.to_pylist()
        own = [e.ids for e in a_model.encode_batch_fast(texts, add_special_tokens=False)], b_model.encode([d[1:] for d in texts], num_threads=1)
        made = [pa.array(ids, pa.list_(pa.int32())) for ids in own]
        place = at.fill_null(0).to_numpy().copy()
        place[at.is_null().to_numpy(zero_copy_only=False)] = len(self.stretches) + np.arange(len(new))
        ids = [pa.concat_arrays(x) for x in zip(self.ids, made, strict=True)]
        keep = pc.indices_nonzero(pc.less_equal(pc.binary_length(new), SHORT))[: KEPT - len(self.stretches)]
        if len(keep):
            self.stretches = pa.concat_arrays([self.stretches, new.take(keep)])
            self.ids = [pa.concat_arrays([a, b.take(keep)]) for a, b in zip(self.ids, made, strict=True)]
        return pa.array(place), ids


def _encoded(texts: list[str], a_model, b_model, seen: Seen) -> list[pa.ListArray]:
    """Both tokenizers' ids of texts, each encoding the distinct stretches between cuts; B adds the space that A's begin with."""
    stretches = [CUT.split(" " + t) for t in texts]
    first = np.concatenate([[0], np.cumsum([len(s) for s in stretches])]).astype(np.int64)
    coded = pa.array(chain.from_iterable(stretches), pa.string(), size=int(first[-1])).dictionary_encode()
    place, own = seen.encoded(coded.dictionary, a_model, b_model)
    place = place.take(coded.indices)
    out = []
    for ids in own:
        lists = ids.take(place)
        upto = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])[first]
        out.append(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pc.list_flatten(lists)))
    return out


def _ends(ids: pa.ListArray, entries: pa.Array, side: str) -> pa.Table:
    """Flattened tokens of lists: doc (their list), end (bytes of the list up to and with the token) and the id as `side`."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids)
    upto = pc.cumulative_sum(pc.cast(pc.binary_length(entries), pa.int64()).take(flat))
    before = pa.concat_arrays([pa.array([0], pa.int64()), upto]).take(ids.offsets.slice(0, len(ids)))
    return pa.table({"doc": doc, "end": pc.subtract(upto, before.take(doc)), side: flat})


def _covers(ids: pa.ListArray, entries: pa.Array, spaced: pa.Array) -> pa.Array:
    """Whether the joined bytes of a document's tokens are its text behind a space."""
    lists = pa.ListArray.from_arrays(ids.offsets, entries.take(pc.list_flatten(ids)))
    return pc.equal(pc.binary_join(lists, b""), pc.cast(spaced, pa.binary()))


def _joined(values: pa.Array, after: np.ndarray, by: str) -> pa.Array:
    """Strings of values joined by `by`, a new one beginning after each position in `after`."""
    offsets = np.concatenate([[0], after + 1]).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), by)


def linked(texts: pa.Array, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE, seen: Seen | None = None) -> tuple[pa.Array, pa.Table, pa.Array]:
    """What a batch of texts holds: the positions of texts with tokens; their links in order, as doc (place among these), a,
    b and meets (a group ends with this link); and each one's groups as text. `seen` remembers stretches for the next batch."""
    (a_model, a_entries), (b_model, b_entries) = byte_tokenizer(a_path), piece_tokenizer(b_path)
    filled = pc.fill_null(texts, "")
    at = pc.indices_nonzero(pc.greater(pc.binary_length(filled), 0))
    some = filled.take(at)
    spaced = pc.binary_join_element_wise("", some, " ")
    ids_a, ids_b = _encoded(some.to_pylist(), a_model, b_model, seen or Seen())
    whole = pc.and_(_covers(ids_a, a_entries, spaced), _covers(ids_b, b_entries, spaced))
    at, ids_a, ids_b = at.filter(whole), ids_a.filter(whole), ids_b.filter(whole)
    met = _ends(ids_a, a_entries, "a").join(_ends(ids_b, b_entries, "b"), ["doc", "end"], join_type="full outer", use_threads=False)
    met = met.sort_by([("doc", "ascending"), ("end", "ascending")]).combine_chunks()
    has_a, has_b = (met[c].is_valid().combine_chunks() for c in ("a", "b"))
    meets = pc.and_(has_a, has_b)
    # each side's tokens in order; a group ends where both do
    groups = [_joined(pc.cast(met[c].combine_chunks().filter(has), pa.string()), np.flatnonzero(meets.filter(has).to_numpy(zero_copy_only=False)), ",") for c, has in (("a", has_a), ("b", has_b))]
    last = met["doc"].combine_chunks().filter(meets).to_numpy()
    text = _joined(pc.binary_join_element_wise(*groups, "|"), np.flatnonzero(np.diff(last, append=-1)), ";")
    # a document's last end is both sides', so that no fill reaches the next document
    links = pa.table({"doc": met["doc"], "a": pc.fill_null_backward(met["a"]), "b": pc.fill_null_backward(met["b"]), "meets": meets, "has_a": has_a, "has_b": has_b})
    return at, links, text


_SIZES = ("n_a", "n_b", "n_groups", "n_links")
_ROW = "rid long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
_SCHEMA = pa.schema([("rid", pa.int64()), ("doc_id", pa.int64()), *[(c, pa.int64()) for c in _SIZES], ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])


def _by_document(batch: pa.RecordBatch, a_path: str, b_path: str, seen: Seen | None = None) -> pa.RecordBatch:
    at, links, text = linked(batch.column("text"), a_path, b_path, seen)
    n, where = len(batch), at.to_numpy()

    def spread(values) -> np.ndarray:
        out = np.zeros(n, np.int64)
        out[where] = values
        return out

    doc = links["doc"].to_numpy()
    sizes = {c: spread(np.bincount(doc, w, len(at)) if len(at) else 0) for c, w in zip(_SIZES, [*(links[c].to_numpy() for c in ("has_a", "has_b", "meets")), None], strict=True)}
    sha = np.full(n, "", object)
    sha[where] = [hashlib.sha256(t.encode()).hexdigest() for t in text.to_pylist()]
    pair = pc.add(pc.multiply(pc.cast(links["a"], pa.int64()), PAIR), pc.cast(links["b"], pa.int64()))
    distinct = pa.table({"doc": links["doc"], "pair": pair}).group_by(["doc", "pair"], use_threads=False).aggregate([([], "count_all")]).sort_by([("doc", "ascending"), ("pair", "ascending")]).combine_chunks()
    held = spread(np.bincount(distinct["doc"].to_numpy(), minlength=len(at)) if len(at) else 0)
    offsets = pa.array(np.concatenate([[0], np.cumsum(held)]).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pc.cast(distinct[c].combine_chunks(), kind)) for c, kind in (("pair", pa.int64()), ("count_all", pa.int32()))]
    return pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *[pa.array(sizes[c]) for c in _SIZES], pa.array(sha, pa.string()), *lists], schema=_SCHEMA)


def aligned(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """Each row of docs (rid, doc_id, text) with n_a, n_b, n_groups, n_links, groups_sha256, its distinct linked id pairs (`pairs`, as
    A's id * PAIR + B's) and how often each is linked (`times`). Texts without tokens have zeros, '' and empty arrays."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            yield _by_document(batch, a_path, b_path, seen)

    return docs.select(F.col("rid").cast("long"), F.col("doc_id").cast("long"), "text").mapInArrow(run, _ROW)


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, a, n, best): how many rows of `aligned` hold each pair, and whether none of its A id's pairs is held by more.

    Tasks count with Arrow and hand on partial counts, Spark adds them; the best counts by A id are at most one for each
    entry of A's vocabulary, so they are broadcast.
    """
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            pairs = pc.list_flatten(batch.column("pairs"))
            flat = pa.table({"pair": pairs, "n": np.ones(len(pairs), np.int64)})
            both = flat if held is None else pa.concat_tables([held, flat])
            held = both.group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["pair", "n"])
            if len(held) > PARTIAL:
                yield from held.to_batches()
                held = None
        if held is not None:
            yield from held.to_batches()

    counts = rows.select("pairs").mapInArrow(partial, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = staged(counts.withColumn("a", F.shiftright("pair", 16)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(most), "a").select("pair", "a", "n", (F.col("n") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str = BYTE_BPE, b_path: str = PIECE_BPE) -> DataFrame:
    """Each document (doc_id, text; other columns are ignored): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens: zeros and ''. Repeated
    rows are documents of their own and count as such, null doc_ids stay, ties for an A id's highest count are all best,
    an empty table gives no rows. A document's pairs meet the corpus-wide counts in the map stage where the pair is one of the FREQUENT
    most frequent, else by a shuffle on the pair: as rarer pairs, none of those is hot.
    """
    rows = staged(aligned(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text"), a_path, b_path), "aligned")
    facts = staged(pair_counts(rows).select("pair", "n", "best"), "pair-facts")
    frequent = F.broadcast(staged(facts.orderBy(F.desc("n"), "pair").limit(FREQUENT), "frequent-pairs"))
    links = rows.select("rid", F.explode(F.arrays_zip("pairs", "times")).alias("l")).select("rid", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    known = links.join(frequent, "pair").groupBy("rid").agg(*_sums())
    rare = links.join(frequent.select("pair"), "pair", "left_anti").join(facts.hint("shuffle_merge"), "pair").groupBy("rid").agg(*_sums())
    sums = known.unionByName(rare).groupBy("rid").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs", "times").join(sums, "rid", "left").select("doc_id", *_SIZES, F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def _sums() -> list:
    times = F.col("times").cast("long")
    return [F.sum(F.when(F.col("best"), times).otherwise(0)).alias("n_best"), F.sum(times * F.col("n")).alias("count_sum")]


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return alignment(table(spark, sf_dir, "documents"))
