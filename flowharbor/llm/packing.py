"""Best-fit packing of token sequences: best-two-fit over the histogram of piece lengths.

Bins are filled greedily, largest fitting piece first; then the bin's smallest piece gives way to two unpacked
pieces that fill the gap it leaves more tightly. A choice depends only on which lengths are left, so one pattern
serves as many bins as its lengths last: the plan has a few thousand patterns at most, however many pieces there
are. Pieces take their places by their rank within their length.
"""

from __future__ import annotations

import functools
import json
import os
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, bounded_batches, staged, table

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
#: Runs of letters or marks whose ids a worker remembers, twice: those met since it last began anew, and those met in the round before.
REMEMBERED = 100_000
#: Characters split into words at once, and runs merged at once: what a worker holds beside its batch.
STRETCH = 1 << 20
MERGED = 2000
#: Pieces of one length aimed at in one salted bucket, which one task ranks.
BUCKET_ROWS = 50_000
#: Words of these characters lower-case letter by letter, and splitting parts them between letters and marks only.
_MARK = r"!-&(-/:;=?@\[\]^_{|}"
_PLAIN = rf"A-Za-zÀ-ÖØ-öø-ÿ{_MARK}"
_MARKS = re.compile(f"[{_MARK}]+")
_ODD = re.compile(rf"[^{_PLAIN}\x20\x09-\x0D]")
#: A word with another character, found in one pass.
_STRANGE = re.compile(rf"(?<![^\x20\x09-\x0D])[{_PLAIN}]*+[^{_PLAIN}\x20\x09-\x0D][^\x20\x09-\x0D]*+")
_SPACE = re.compile(SPACE_PATTERN)
#: The byte-level alphabet: printable Latin-1 stands for itself, the other bytes for the code points from 256 on.
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b))}
_LETTERS = {chr(c): chr(c).encode().decode("latin-1").translate(_BYTE_LEVEL) for c in range(0xC0, 0x100)}
#: The text steps of a tokenizer whose ids are those of its words in turn.
WORD_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
)


@functools.cache
def _tokenizers(name: str):
    """The tokenizer, one that only merges lower-case runs between spaces, and which ids end a run; two times None where the
    file has other steps than WORD_STEPS, so that words cannot be encoded apart from their texts."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    with open(name if "/" in name else public_tokenizers.path(name), encoding="utf-8") as file:
        source = file.read()
    spec, full = json.loads(source), Tokenizer.from_str(source)
    suffix = spec["model"].get("end_of_word_suffix")
    if (spec["normalizer"], spec["pre_tokenizer"]) != WORD_STEPS or not suffix or spec["post_processor"] or any(not {"<", ">"} & set(x["content"]) for x in spec["added_tokens"]):
        return full, None, None
    merges = Tokenizer(full.model)
    merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(full.get_vocab_size(), bool)
    ends[[i for token, i in full.get_vocab(False).items() if token.endswith(suffix)]] = True
    return full, merges, ends


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit bytes.

    Under WORD_STEPS white space is dropped and neither normalisation nor a merge crosses it, so a text's ids are those of
    its words in turn. Plain words need no normalisation but lower case and part into runs of letters and of marks;
    each distinct run is merged once, many at a time, and remembered for a while. Other words go through the whole
    tokenizer, and a tokenizer with other steps encodes whole texts.
    """

    def __init__(self, name: str = TOKENIZER):
        self.full, self.merges, self.ends = _tokenizers(name)
        self.known, self.older = {"": b""}, {}

    def __call__(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        if self.merges is None:
            for t in texts:
                yield _packed(self.full.encode(t, add_special_tokens=False).ids)
            return
        at = 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size + len(texts[at]) <= STRETCH):
                some.append(texts[at])
                size += len(texts[at])
                at += 1
            yield from self._stretch(some) if size <= STRETCH else [self._long(some[0])]

    def _long(self, text: str) -> bytes:
        """Cut at white space into stretches that fit, beside single words that don't."""
        out, at = [], 0
        while at < len(text):
            found = _SPACE.search(text, at + STRETCH)
            end = found.start() if found else len(text)
            out += self._stretch([text[at:end]])
            at = end
        return b"".join(out)

    def _stretch(self, texts: list[str]) -> list[bytes]:
        strange: set[str] = set()
        parted = pc.ascii_split_whitespace(pa.array([_parted(t, strange) for t in texts], pa.string()))
        coded = parted.values.dictionary_encode()
        runs, at = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        known = self._learn(runs, strange)
        ids = [known[x] for x in runs]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        ends, each = np.cumsum(sizes), sizes[at]
        upto = np.concatenate([[0], np.cumsum(each)])
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(ends[at] - upto[1:], each) + np.arange(upto[-1])]
        cuts = upto[parted.offsets.to_numpy()].tolist()
        return [flat[x:y].tobytes() for x, y in zip(cuts, cuts[1:])]

    def _learn(self, runs: list[str], strange: set[str]) -> dict[str, bytes]:
        """The ids of all these runs among others; beyond REMEMBERED, forgets those not met since the last time."""
        if len(self.known) > REMEMBERED:
            self.known, self.older = {"": b""}, self.known
        known, older, fresh = self.known, self.older, []
        for x in runs:
            if x in known:
                continue
            if (ids := older.get(x)) is not None:
                known[x] = ids
            elif x in strange:
                known[x] = _packed(self.full.encode(x, add_special_tokens=False).ids)
            else:
                fresh.append(x)
        for at in range(0, len(fresh), MERGED):
            some = fresh[at : at + MERGED]
            text = " ".join(some)
            for letter in _LETTERS.keys() & set(text):
                text = text.replace(letter, _LETTERS[letter])
            ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
            raw, start = ids.tobytes(), 0
            for x, end in zip(some, (4 * np.flatnonzero(self.ends[ids]) + 4).tolist(), strict=True):
                known[x] = raw[start:end]
                start = end
        return known


def _parted(text: str, strange: set[str]) -> str:
    """The text's runs in lower case between white space, and as they are its strange words, which are added to `strange`."""
    if not _ODD.search(text):
        return _MARKS.sub(r" \g<0> ", text.lower())
    out, at = [], 0
    for m in _STRANGE.finditer(text):
        out += [_MARKS.sub(r" \g<0> ", text[at : m.start()].lower()), m[0]]
        strange.add(m[0])
        at = m.end()
    return " ".join([*out, _MARKS.sub(r" \g<0> ", text[at:].lower())])


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<u4").tobytes()


@functools.cache
def _word_ids(name: str) -> WordIds:
    """One for each worker process: what a task has learnt serves the next."""
    return WordIds(name)


def tokenized(docs: DataFrame, text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str = TOKENIZER) -> DataFrame:
    """docs without the text, one row for each piece: `piece`, `start`, `length` and `ids` (binary, little-endian
    unsigned 32-bit). A document is its ids and end_id; a null text is empty. Pieces are cut at `capacity` ids."""
    end = np.array([end_id], "<u4").tobytes()

    @F.pandas_udf("array<binary>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _word_ids(tokenizer)
        for texts in batches:
            out = []
            for ids in encode([t or "" for t in texts]):
                ids += end
                out.append([ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity)])
            yield pd.Series(out)

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    cutted = docs.select(*rest, F.posexplode(cut(F.col(text_col))).alias("piece", "ids"))
    return cutted.select(*rest, "piece", (F.col("piece").cast("long") * capacity).alias("start"), (F.length("ids") / 4).cast("long").alias("length"), "ids")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over {length: pieces}: (lengths in one bin, bins) in the order made. Every piece is placed."""
    left = {n: c for n, c in counts.items() if c > 0}
    out, order = [], sorted(left)
    while order:
        used: Counter = Counter()
        bin_, gap, top = [], capacity, len(order)
        while gap and (top := bisect_right(order, gap, 0, top)):
            n = order[top - 1]
            fit = min(gap // n, left[n])
            bin_ += [n] * fit
            used[n] += fit
            gap -= fit * n
            top -= 1
        if gap and len(bin_) > 1 and (pair := _closest_pair(order, left, used, gap + bin_[-1], bin_[-1])):
            used[bin_.pop()] -= 1
            bin_ += pair
            used.update(pair)
        times = min(left[n] // c for n, c in used.items() if c)
        out.append((tuple(bin_), times))
        for n, c in used.items():
            left[n] -= times * c
            if not left[n]:
                order.remove(n)
    return out


def _closest_pair(order: list[int], left: dict[int, int], used: Counter, room: int, above: int) -> list[int] | None:
    """The two unpacked lengths of largest sum up to room, if that is over `above`."""
    free = [n for n in order[: bisect_right(order, room)] if left[n] > used[n]]
    i, j, best, pair = 0, len(free) - 1, above, None
    while i <= j:
        total = free[i] + free[j]
        if total > room or i == j and left[free[i]] - used[free[i]] < 2:
            j -= 1
            continue
        if total > best:
            best, pair = total, [free[j], free[i]]
            if best == room:
                break
        i += 1
    return pair


def packed(pieces: DataFrame, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """pieces plus `sequence_id` (from 0) and `offset`: its sequence and place there. Lengths run from 1 to capacity.

    The driver sees one count for each length. Pieces are ranked within (length, salted bucket), so a frequent
    length spreads over tasks; a piece finds its place by its rank in the plan's runs of equal places.
    """
    own = [F.col(f"`{c}`") for c in pieces.columns]
    buckets = max(4, -(-pieces.count() // BUCKET_ROWS))
    salt = F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns])
    rows = pieces.select(*own, F.col(length_col).cast("int").alias("__n"), salt.alias("__h"), F.pmod(salt, F.lit(buckets)).cast("int").alias("__b"))
    counts = staged(rows.groupBy("__n", "__b").agg(F.count("*").alias("c")), "lengths")
    total = {r[0]: r[1] for r in counts.groupBy("__n").agg(F.sum("c")).collect()}
    runs, sequence, seen = defaultdict(list), 0, Counter()  # by length: first rank, first sequence, offset
    for lengths, times in plan(total, capacity):
        at = 0
        for n in lengths:
            runs[n].append((seen[n], sequence, at))
            seen[n] += times
            at += n
        sequence += times
    before = counts.select(F.col("__n").alias("__m"), F.col("__b").alias("__a"), (F.sum("c").over(Window.partitionBy("__n").orderBy("__b")) - F.col("c")).alias("__before"))
    inside = Window.partitionBy("__n", "__b").orderBy("__h")
    ranked = rows.withColumn("__r", F.row_number().over(inside) - 1)
    placed = ranked.join(before, (F.col("__n") == F.col("__m")) & (F.col("__b") == F.col("__a"))).withColumn("__r", F.col("__r") + F.col("__before"))
    firsts = {n: np.array([r[0] for r in rs]) for n, rs in runs.items()}
    begins = {n: np.array([r[1] - r[0] for r in rs]) for n, rs in runs.items()}
    offsets = {n: np.array([r[2] for r in rs]) for n, rs in runs.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        out = pd.DataFrame({"sequence_id": np.zeros(len(n), np.int64), "offset": np.zeros(len(n), np.int64)})
        for x in np.unique(n):
            at = np.flatnonzero(n == x)
            run = np.searchsorted(firsts[x], r[at], "right") - 1
            out.iloc[at, 0], out.iloc[at, 1] = begins[x][run] + r[at], offsets[x][run]
        return out

    found = placed.withColumn("__p", place("__n", "__r"))
    return found.select(*own, "__p.sequence_id", "__p.offset")


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves: `sequence_id`, `length` and `ids`, joined from rows that still have `ids`."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    joined = F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))")
    return placed.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length")).select("sequence_id", "length", joined.alias("ids"))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True) -> DataFrame:
    """Pieces of all documents in their places: id, piece, start, length, ids (unless keep_ids is false), their
    crc32 `ids_crc32`, sequence_id, offset. Repeated rows and null ids are documents like others."""
    pieces = tokenized(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).withColumn("ids_crc32", F.crc32("ids"))
    pieces = staged(pieces if keep_ids else pieces.drop("ids"), "pieces")
    return packed(pieces).withColumnRenamed("doc_id", id_col)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return pack_documents(table(spark, sf_dir, "documents"), keep_ids=False)
