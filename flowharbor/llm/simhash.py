"""SimHash near-duplicates by covering locality-sensitive hashing.

A table's key is the fingerprint under a mask. The masks come from a code: every bit gets a vector of
GF(2)^(radius+1), and mask v holds the bits whose vector has an odd product with v. Any `radius` differing bits leave
some non-zero v with even products throughout, so a pair within the radius agrees under that mask: none is missed.
A bucket larger than `bucket` is covered again on the bits that its mask leaves free, down to buckets that cannot
be larger, so no bucket is capped and none is compared in full when it is hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, components, discard, staged, table

SEED = 42
BITS = 64
RADIUS = 3
SHINGLE = 3
#: Buckets of more fingerprints than this are covered again.
BUCKET = 64
_CHUNK = 1 << 15
#: What keep_one calls near copies: five-word shingles, Jaccard similarity; 20 bands of 4 min-hashes miss 3 in 100,000 pairs at 0.8.
WIDTH = 5
SIMILARITY = 0.8
BANDS = 20
ROWS = 4
#: Shingles and sets aimed at in a block of a large bucket's sets: a pair of blocks holds a matrix of its sets by its sets.
BLOCK_SHINGLES = 100_000
BLOCK_SETS = 1000


def fingerprint(text: str | None, width: int = SHINGLE, seed: int = SEED) -> int:
    """The text's 64-bit fingerprint, unsigned; 0 if it is null or has no word."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    ends = ends[min(width, len(words)) - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        hashes = [digest(joined[s:e], seed) for s, e in zip(starts[at : at + _CHUNK], ends[at : at + _CHUNK], strict=True)]
        bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8)).reshape(-1, BITS)
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def with_fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fp", width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """docs plus column `out`: the fingerprint as a signed long. Null and wordless texts get 0."""

    @F.pandas_udf("long")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, width, seed)) for t in texts], dtype="int64")

    return docs.withColumn(out, udf(F.col(text_col)))


def cover(mask: int, radius: int = RADIUS) -> list[int]:
    """The masks that cover the bits outside `mask`, each joined with it: 2^(radius+1)-1 of them, fewer if bits run out."""
    free = [i for i in range(BITS) if not mask >> i & 1]
    codes = (1 << (radius + 1)) - 1
    vector = {bit: j % codes + 1 for j, bit in enumerate(free)}
    return sorted({mask | sum(1 << bit for bit, x in vector.items() if (x & v).bit_count() & 1) for v in range(1, codes + 1)})


def levels(radius: int = RADIUS, bucket: int = BUCKET) -> list[dict[int, list[int]]]:
    """Mask to finer masks, level by level, until the free bits cannot make a bucket of over 256 or 2 * `bucket` fingerprints."""
    out, masks = [], [0]
    while any(BITS - m.bit_count() > max(8, bucket.bit_length()) for m in masks):
        out.append({m: cover(m, radius) for m in masks})
        masks = sorted({x for xs in out[-1].values() for x in xs})
    return out


def _forest(near: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that span the components of a symmetric relation: fewer than its members."""
    a, b, seen = [], [], np.zeros(len(near), bool)
    for root in range(len(near)):
        edge = [] if seen[root] else [root]
        seen[root] = True
        while edge:
            i = edge.pop()
            new = np.flatnonzero(near[i] & ~seen).tolist()
            seen[new] = True
            a += [i] * len(new)
            b += new
            edge += new
    return a, b


def _spanning(radius: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each bucket's fingerprints, edges that span what links within the radius join."""
    for pdf in batches:
        a, b = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
        for fps in pdf["fps"]:
            x = np.unique(np.asarray(fps, np.int64)).view(np.uint64)
            i, j = _forest(np.bitwise_count(x[:, None] ^ x[None, :]) <= radius)
            a.append(x[i])
            b.append(x[j])
        yield pd.DataFrame({"a": np.concatenate(a).view(np.int64), "b": np.concatenate(b).view(np.int64)})


def links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that have the components of all pairs within the radius."""
    spark = prints.sparkSession
    plan = levels(radius, bucket)
    hot, found = prints.select("fp", F.lit(0).cast("long").alias("m")), None
    for depth, finer in enumerate(plan):
        last = depth == len(plan) - 1
        masks = spark.createDataFrame([(_signed(m), [_signed(x) for x in xs]) for m, xs in finer.items()], "m long, finer array<long>")
        keyed = hot.join(F.broadcast(masks), "m").select("fp", F.explode("finer").alias("m")).withColumn("k", F.col("fp").bitwiseAND(F.col("m")))
        keyed = keyed.distinct() if depth else keyed
        sizes = keyed.groupBy("m", "k").agg(F.count("*").alias("n")).where("n > 1")
        shared = staged(keyed.join(sizes, ["m", "k"]), "buckets")
        fine = (shared if last else shared.where(F.col("n") <= bucket)).groupBy("m", "k").agg(F.collect_list("fp").alias("fps"))
        edges = fine.select("fps").mapInPandas(lambda it: _spanning(radius, it), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        hot = shared.where(F.col("n") > bucket).select("fp", "m")
        if last or hot.isEmpty():
            break
    return found.distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of docs: its id, signed fingerprint `fp` and `component_id`, the smallest id that links reach.

    Exact copies share a fingerprint and are never compared; only distinct fingerprints are. Null texts count as
    empty, and all wordless texts have fingerprint 0. Rows with a null id belong to components and don't name them
    (component_id is null where no member has an id). Repeated rows come out repeated; other columns are ignored.
    """
    rows = staged(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "fp"), "fingerprints")
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("least_id"))
    roots = components(links(prints, radius, bucket)).withColumnsRenamed({"node": "fp", "root": "r"})
    named = prints.join(roots, "fp", "left").withColumn("r", F.coalesce("r", "fp"))
    classes = named.groupBy("r").agg(F.min("least_id").alias("component_id"))
    ids = named.select("fp", "r").join(classes, "r").select("fp", "component_id")
    return rows.join(ids, "fp").select(F.col("doc_id").alias(id_col), "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    """Sorted distinct hashes of the text's `width`-word shingles; a shorter text is one shingle, a wordless one none."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined, n = b" ".join(words), max(1, len(words) - width + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts, ends[min(width, len(words)) - 1 :].tolist(), strict=True)), np.uint64, n))


def _hashes() -> tuple[np.ndarray, ...]:
    rng = np.random.default_rng(SEED)
    return tuple(rng.integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(3))


_FLIP, _FACTOR, _MIX = _hashes()


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """One key for each of BANDS bands of ROWS min-hashes: sets of similarity s share a given one with chance s^ROWS."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), _CHUNK >> 3):
        np.minimum(least, ((shingles[at : at + (_CHUNK >> 3)] ^ _FLIP[:, None]) * _FACTOR[:, None]).min(axis=1), out=least)
    return (least * _MIX).reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64) if len(shingles) else np.empty(0, np.uint64)


def _sketched(texts: DataFrame, width: int) -> DataFrame:
    """texts plus `s`: sid (a hash of the shingle set), n (its size) and its band keys."""

    @F.pandas_udf("sid long, n int, keys array<long>")
    def udf(column: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, width) for t in column]
        sids = [_signed(xxhash.xxh64_intdigest(x.tobytes(), SEED)) if len(x) else 0 for x in sets]
        return pd.DataFrame({"sid": np.array(sids, np.int64), "n": np.array([len(x) for x in sets], np.int32), "keys": [band_keys(x).view(np.int64) for x in sets]})

    return texts.withColumn("s", udf(F.col("text")))


def _shingled(wanted: DataFrame, sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(sid, x): the shingle hashes of the wanted sets, from one text of each."""

    @F.pandas_udf("array<long>")
    def udf(column: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, width).view(np.int64) for t in column], dtype=object)

    one = texts.join(sets.join(wanted.distinct(), "sid").select("sid", "h"), "h").groupBy("sid").agg(F.min("text").alias("text"))
    return staged(one.select("sid", udf(F.col("text")).alias("x")), "shingles")


def _similar(pairs: DataFrame, sets: DataFrame, texts: DataFrame, similarity: float, width: int) -> DataFrame:
    """The pairs (a, b) of sets whose Jaccard similarity, counted over all their shingles, reaches `similarity`."""
    pairs = staged(pairs.select("a", "b").distinct(), "pairs")
    shingles = _shingled(pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid"))), sets, texts, width)
    both = pairs.join(shingles.withColumnRenamed("sid", "a"), "a").join(shingles.withColumnsRenamed({"sid": "b", "x": "y"}), "b")
    common = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c"), (F.size("x") + F.size("y")).alias("n"))
    out = staged(common.where(F.col("c") >= similarity * (F.col("n") - F.col("c")) - 1e-9).select("a", "b"), "similar")
    discard(pairs)
    discard(shingles)
    return out


def _block_links(similarity: float, pdf: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges between the similar sets of two blocks of a bucket (or of one with itself), from shared shingles
    counted for all their pairs by matrix products over stretches of the shingles that occur twice."""
    sets = [np.asarray(x, np.int64) for x in pdf["x"]]
    n, owner = np.array([len(x) for x in sets], np.float32), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = times > 1
    place, kept = np.cumsum(twice) - 1, twice[code]
    code, owner = place[code][kept], owner[kept]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for low in range(0, int(twice.sum()), 2048):
        part = (code >= low) & (code < low + 2048)
        held = np.zeros((len(sets), 2048), np.float32)
        held[owner[part], code[part] - low] = 1
        common += held @ held.T
    i, j = _forest(common >= similarity * (n[:, None] + n[None, :] - common) - 1e-6)
    ids = pdf["sid"].to_numpy()
    return pd.DataFrame({"a": ids[i], "b": ids[j]})


def similar_links(sets: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """Edges (a, b) between sets (sid, n, keys, h) with the components of all pairs that share a band and are similar.

    In each bucket every set first meets one hub. Where that leaves several components, the pairs between them follow:
    one by one in a bucket of up to `bucket` sets, and in a larger one between blocks of about BLOCK_SHINGLES
    shingles and BLOCK_SETS sets at most, each pair of blocks in a task of its own that gives only spanning edges. No bucket is capped, and no
    task holds more than two blocks; the work in a bucket that stays in several components grows with its square.
    """
    keyed = sets.select("sid", "n", F.posexplode("keys").alias("band", "k"))
    hub = F.min_by(F.struct("sid", "n"), F.xxhash64("sid", "band", "k"))
    sizes = keyed.groupBy("band", "k").agg(F.count("*").alias("c"), F.sum("n").alias("held"), hub.alias("hub")).where("c > 1")
    shared = staged(keyed.join(sizes, ["band", "k"]).select("band", "k", "c", "held", "sid", "n", F.col("hub.sid").alias("hub"), F.col("hub.n").alias("m")), "buckets")
    fits = F.least("n", "m") >= similarity * F.greatest("n", "m") - 1e-9
    hubs = shared.where("sid <> hub").where(fits).select(F.least("hub", "sid").alias("a"), F.greatest("hub", "sid").alias("b"))
    found = _similar(hubs, sets, texts, similarity, width)
    roots = components(found).withColumnsRenamed({"node": "sid", "root": "r"})
    named = shared.where("c > 2").join(roots, "sid", "left").withColumn("r", F.coalesce("r", "sid"))
    split = named.groupBy("band", "k").agg(F.min("r").alias("r0"), F.max("r").alias("r1")).where("r0 < r1").select("band", "k")
    left = staged(named.join(split, ["band", "k"]).drop("m"), "split")
    discard(shared)
    small = left.where((F.col("c") <= bucket) & (F.col("sid") != F.col("hub"))).select("band", "k", F.col("sid").alias("a"), "n", "r")
    other = small.withColumnsRenamed({"a": "b", "n": "m", "r": "s"})
    pairs = small.join(other, ["band", "k"]).where("a < b and r <> s").where(fits).select("a", "b")
    found = found.unionByName(_similar(pairs, sets, texts, similarity, width))
    large = left.where(F.col("c") > bucket)
    if large.isEmpty():
        return found
    blocks = F.greatest(F.ceil(F.col("held") / BLOCK_SHINGLES), F.ceil(F.col("c") / BLOCK_SETS))
    mine = large.withColumn("g", F.pmod(F.xxhash64("sid"), blocks)).withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    met = mine.select("band", "k", F.least("g", "t").alias("lo"), F.greatest("g", "t").alias("hi"), "sid")
    shingles = _shingled(large.select("sid"), sets, texts, width)
    across = met.join(shingles, "sid").groupBy("band", "k", "lo", "hi").applyInPandas(lambda pdf: _block_links(similarity, pdf), "a long, b long")
    return found.unionByName(staged(across.distinct(), "across"))


def keep_one(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each group of similar texts: the one of smallest (id, text hash), null ids last; all columns stay.
    By min-hashes, not SimHash: the pipeline uses `keep_linked`.

    Links join texts whose sets of `width`-word shingles have a Jaccard similarity of at least `similarity`; bands of
    min-hashes propose the pairs, and their shingles are counted in full. Wordless and null texts are one group. Of rows
    with equal id and text the one whose columns hash lowest stays. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    slim = staged(_sketched(texts, width).select("doc_id", "h", "s.*"), "sketches")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    sets = staged(slim.groupBy("sid").agg(first.alias("first"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("keys").alias("keys")), "sets")
    discard(slim)
    roots = components(similar_links(sets, texts.select("h", "text"), similarity, width, bucket)).withColumnsRenamed({"node": "sid", "root": "r"})
    least = sets.join(roots, "sid", "left").groupBy(F.coalesce("r", "sid").alias("r")).agg(F.min("first").alias("first"))
    return _only(docs, least, text_col, id_col)


def _only(docs: DataFrame, least: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The rows of docs that `first` (doc_id, h) in least names, one of each."""
    key = ["__near_dup_id", "__near_dup_none", "__near_dup_text"]

    def keyed(i: str, h) -> list:
        return [F.coalesce(F.col(i).cast("string"), F.lit("")).alias(key[0]), F.col(i).isNull().alias(key[1]), h.alias(key[2])]

    rows = docs.select("*", *keyed(id_col, F.xxhash64(F.col(text_col)))).join(least.select(*keyed("first.doc_id", F.col("first.h"))), key, "left_semi")
    order = F.xxhash64(*[F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and "variant" not in t])
    nth = F.row_number().over(Window.partitionBy(*key).orderBy(order))
    return rows.withColumn("__near_dup_nth", nth).where("__near_dup_nth = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_linked(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """docs with one row of each component that SimHash links (fingerprints within `radius` bits) join: the one of smallest
    (id, text hash), null ids last; all columns stay.

    Null and wordless texts have fingerprint 0, like `near_duplicates`. Of rows with equal id and text the one whose columns
    hash lowest stays. An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("text"))
    slim = staged(with_fingerprint(texts).select("doc_id", "h", "fp"), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "h"))
    prints = staged(slim.groupBy("fp").agg(first.alias("first")), "prints")
    discard(slim)
    roots = components(links(prints, radius, bucket)).withColumnsRenamed({"node": "fp", "root": "r"})
    least = prints.join(roots, "fp", "left").groupBy(F.coalesce("r", "fp").alias("r")).agg(F.min("first").alias("first"))
    return _only(docs, least, text_col, id_col)
