"""Prefix trie of conversations by truncation peeling.

From the greatest depth down, conversations that end at a depth merge with the nodes that survive from below, each merged
node strips its last turn, and what agrees then is regrouped one depth higher: one pass discovers the nodes and adds up
what is below them. A prefix is known by an additive digest of its turns, so that stripping a turn is a subtraction.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowharbor.operators.staging import discard, lookup, running, staged

from .common import bounded_batches, table

#: Conversations whose ids share their part above BASE_OF share the first turns of the one divisible by it; h is crc32 mod HEADS.
BASE_OF, HEADS = 100, 6
#: The deepest levels that together have at most TAIL turns are peeled in one task; a long conversation needs no job a turn.
TAIL = 20_000
#: Ids of one row of text on the way to a digest.
CHUNK = 10_000
#: A turn's digest in three parts of 40 bits: sums of 2^23 of them fit a long.
PARTS = ("k1", "k2", "k3")
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def _key(depth: Column, *parts: Column) -> Column:
    """A prefix's name: 16 bytes of the digest of its depth and sums."""
    return F.substring(F.unhex(F.sha2(F.concat_ws(",", depth, *parts), 256)), 1, 16)


def _root() -> Column:
    return _key(*[F.lit(0)] * 4).alias("key")


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (c, pos from 0, turn digest t, chars) and conversations (c, n turns), both of non-null conv_ids."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    t = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    turns = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), "turn", role.alias("role"), t.alias("t"), F.char_length(text).alias("chars"))
    rows = running(turns, ["c"], [F.col("turn").asc_nulls_first(), "role", "t"], {"i": F.lit(1)})
    rows = staged(rows.select("c", (F.col("i") - 1).alias("pos"), "t", "chars"), "numbered")
    return rows, staged(rows.groupBy("c").agg(F.count("*").alias("n")), "conversations")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes (c, pos from 1, total, key, parent, chars) of every rebuilt conversation, and the turnless ones (c).

    c is rebuilt from the first h turns of conversation c - c % BASE_OF (all if fewer, none if absent), h being crc32(c) %
    HEADS, and its own turns after its first h. A base is asked by BASE_OF conversations at most.
    """
    turns, convs = numbered(conversations)
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    bases = convs.where(F.col("c") % BASE_OF == 0).select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    plan = convs.select("c", "n", (F.col("c") - F.col("c") % BASE_OF).alias("base"), h.alias("h")).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = staged(plan.select("c", "n", "base", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "plan")
    firsts = turns.where((F.col("c") % BASE_OF == 0) & (F.col("pos") < HEADS)).withColumnRenamed("c", "base")
    heads = plan.where("taken > 0").join(firsts, "base").where("pos < taken").select("c", (F.col("pos") + 1).alias("pos"), "t", "chars")
    most = plan.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = lookup(turns.where(F.col("pos") >= h).withColumn("h", h), plan.select("c", "n", "taken"), "c", "n", most)
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("taken") + 1).alias("pos"), "t", "chars")
    digest = F.sha2(F.concat(F.col("pos").cast("string").cast("binary"), F.lit(b":"), F.col("t")), 256)
    parts = {k: F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("long") for i, k in enumerate(PARTS)}
    sums = {f"s{k}": F.col(k) for k in PARTS}
    steps = running(heads.unionByName(own).withColumns(parts), ["c"], ["pos"], sums)
    key = _key(F.col("pos"), *[F.col(s) for s in sums])
    parent = _key(F.col("pos") - 1, *[F.col(s) - F.col(k) for s, k in zip(sums, PARTS, strict=True)])
    steps = lookup(steps, plan.select("c", "n", "total"), "c", "n", most)
    steps = steps.select("c", "pos", "total", key.alias("key"), parent.alias("parent"), "chars")
    # dealt by depth, so that a level is read from few row groups
    out = staged(steps.repartitionByRange("pos", "c").sortWithinPartitions("pos", "c"), "prefixes")
    discard(turns)
    return out, plan.where("total = 0").select("c")


STATE = ("c", "n_convs", "n_children", "n_leaves", "saved")
_MERGED = [F.min, F.sum, F.sum, F.sum, F.sum]
_NODE = "key binary, parent binary, depth long, c long, n_convs long, n_children long, n_leaves long, saved long"


def _ended(rows: DataFrame) -> DataFrame:
    """Conversations that end here, (key, c), as what a node merges."""
    zeros = [F.lit(0).cast("long").alias(s) for s in STATE[2:]]
    return rows.select("key", "c", F.lit(1).cast("long").alias("n_convs"), *zeros)


def _stripped(nodes: DataFrame) -> DataFrame:
    """Nodes without their last turn, as what the node above merges."""
    return nodes.select(F.col("parent").alias("key"), "c", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")


def _merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy("key").agg(*[f(s).alias(s) for f, s in zip(_MERGED, STATE, strict=True)])


def _closed(nodes: DataFrame) -> DataFrame:
    """A node counts itself once all below is merged: childless nodes are leaves, and its own text is saved n_convs - 1 times."""
    leaves = F.when(F.col("n_children") == 0, F.lit(1).cast("long")).otherwise(F.col("n_leaves"))
    return nodes.select("key", "parent", "depth", "c", "n_convs", "n_children", leaves.alias("n_leaves"), (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"))


def _peel_tail(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of the deepest levels from their prefixes, deepest first: the same peeling in one task's memory."""
    columns = [x.split()[0] for x in _NODE.split(", ")]
    depth, here, below = None, {}, {}  # this depth's (parent, chars, least c) by key; states from the depth below

    def close() -> tuple[pd.DataFrame, dict]:
        out, up = [], {}
        for key, (parent, chars, ended, c) in here.items():
            least, n, kids, leaves, saved = below.get(key, (c, 0, 0, 0, 0))
            least, n = min(least, c) if ended else least, n + ended
            leaves, saved = leaves or 1, saved + (n - 1) * chars
            out.append((key, parent, depth, least, n, kids, leaves, saved))
            a = up.get(parent)
            up[parent] = (min(a[0], least), a[1] + n, a[2] + 1, a[3] + leaves, a[4] + saved) if a else (least, n, 1, leaves, saved)
        return pd.DataFrame(out, columns=columns), up

    for pdf in batches:
        for c, pos, total, key, parent, chars in zip(pdf["c"], pdf["pos"], pdf["total"], pdf["key"], pdf["parent"], pdf["chars"], strict=True):
            if pos != depth:
                if depth is not None:
                    out, below = close()
                    yield out
                depth, here = pos, {}
            key, parent = bytes(key), bytes(parent)
            seen = here.get(key)
            ends = int(total == pos)
            if seen is None:
                here[key] = (parent, chars, ends, c)
            elif ends:
                here[key] = (parent, chars, seen[2] + 1, min(c, seen[3]) if seen[2] else c)
    if depth is not None:
        yield close()[0]


def _tail_depth(prefixes: DataFrame, tail: int) -> int:
    """A depth (0 or a power of two) below which there are at most `tail` prefixes, from one aggregation."""
    grid = [0] + [1 << i for i in range(40)]
    counts = prefixes.agg(*[F.count(F.when(F.col("pos") > d, 1)) for d in grid]).first()
    return next(d for d, n in zip(grid, counts, strict=True) if n <= tail)


def peeled(prefixes: DataFrame, turnless: DataFrame, tail: int = TAIL) -> DataFrame:
    """All nodes (key, parent, depth, c, n_convs, n_children, n_leaves, saved), c being the smallest member.

    Each depth is a job: a grouping of the nodes below it and the conversations that end there (combined before the shuffle,
    so a hot prefix costs a task no more than its distinct children), and a join of each node with its one
    representative's prefix. So there are as many jobs as depths, but for the deepest levels that `tail` covers.
    """
    start = _tail_depth(prefixes, tail)
    deep = prefixes.where(F.col("pos") > start).repartition(1).sortWithinPartitions(F.desc("pos"))
    levels = [staged(deep.mapInPandas(_peel_tail, _NODE), "level")]
    below = levels[0].where(F.col("depth") == start + 1)
    for depth in range(start, 0, -1):
        here = prefixes.where(F.col("pos") == depth)
        merged = _merged(_ended(here.where("total = pos")).unionByName(_stripped(below)))
        nodes = merged.join(here.select("key", "c", "parent", "chars"), ["key", "c"]).withColumn("depth", F.lit(depth).cast("long"))
        below = staged(_closed(nodes), "level")
        levels.append(below)
    top = _merged(_ended(turnless.select(_root(), "c")).unionByName(_stripped(below)))
    top = top.withColumns({"parent": F.lit(None).cast("binary"), "depth": F.lit(0).cast("long"), "chars": F.lit(0)})
    out = _closed(top)
    for level in levels:
        out = out.unionByName(level)
    return out


def ends(prefixes: DataFrame, turnless: DataFrame) -> DataFrame:
    """(key, ends_sha256) of nodes at which conversations end: SHA-256 of their decimal ids, ascending, joined by commas.

    Ids are joined to texts of at most CHUNK in range partitions of (key, c); only those texts, in order, stream through a node's task,
    which keeps nothing: a digest is sequential, but a third of all conversations ending at one node are few rows.
    """
    rows = prefixes.where("total = pos").select("key", "c").unionByName(turnless.select(_root(), "c"))
    placed = running(rows, ["key"], ["c"], {"i": F.lit(1)})
    chunks = placed.groupBy("key", F.floor((F.col("i") - 1) / CHUNK).alias("chunk")).agg(F.array_join(F.sort_array(F.collect_list("c")).cast("array<string>"), ",").alias("ids"))

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, sha = None, None
        for pdf in batches:
            out = []
            for k, ids in zip(pdf["key"], pdf["ids"], strict=True):
                if k != key:
                    if sha:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["key", "ends_sha256"])
        if sha:
            yield pd.DataFrame([(key, sha.hexdigest())], columns=["key", "ends_sha256"])

    return chunks.repartition("key").sortWithinPartitions("key", "chunk").mapInPandas(digest, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, tail: int = TAIL) -> DataFrame:
    """Nodes of the rebuilt conversations (columns conv_id, turn, role, text; others are ignored): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn (null first), then role and a digest of role and text, so repeated turns stay and ties have one
    order; null roles and texts are empty. Rows without conv_id belong to no conversation. An empty table has no
    node, not even the root. Texts are read once and not shuffled, so long ones cost their digest only.
    """
    prefixes, turnless = rebuilt(conversations)
    nodes = staged(peeled(prefixes, turnless, tail), "nodes").withColumnRenamed("c", "conv_id")
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    out = lookup(nodes.withColumnRenamed("n_children", "kids"), parents, "parent", "n_children", nodes.count()).join(ends(prefixes, turnless), "key", "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("kids").alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 by its defining rule, a table of 256 remainders made by shifting eight times.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, rem[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
ORACLE_SQL = f"""WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS rem),
 o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), t) AS i, length(coalesce(text, ''))::BIGINT AS chars, t FROM (SELECT *, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t FROM conversations WHERE conv_id IS NOT NULL)),
 h AS (SELECT conv_id, conv_id - conv_id % {BASE_OF} AS base, {_CRC} % {HEADS} AS h FROM (SELECT DISTINCT conv_id FROM o), crc),
 b AS (SELECT h.conv_id, 0 AS part, i, chars, t FROM h JOIN o ON o.conv_id = h.base AND i <= h UNION ALL SELECT h.conv_id, 1, i, chars, t FROM h JOIN o ON o.conv_id = h.conv_id AND i > h),
 s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, i) AS d, chars, t FROM b),
 l AS (SELECT h.conv_id, coalesce(n, 0) AS n FROM h LEFT JOIN (SELECT conv_id, count(*) AS n FROM s GROUP BY conv_id) USING (conv_id)),
 p AS (SELECT conv_id, 0::BIGINT AS d, '' AS k, NULL::VARCHAR AS up, 0::BIGINT AS chars FROM h UNION ALL SELECT p.conv_id, s.d, sha256(p.k || s.t), p.k, s.chars FROM p JOIN s ON s.conv_id = p.conv_id AND s.d = p.d + 1),
 e AS (SELECT p.*, n FROM p JOIN l USING (conv_id)),
 v AS (SELECT k, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, coalesce(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = d)), '{EMPTY_SHA}') AS ends_sha256 FROM e GROUP BY k, d),
 kids AS (SELECT up, count(*) AS n_children FROM v WHERE d > 0 GROUP BY up), w AS (SELECT v.*, coalesce(n_children, 0) AS n_children FROM v LEFT JOIN kids ON v.k = kids.up),
 a AS (SELECT k AS top, k, d, n_convs, chars, n_children, up FROM w UNION ALL SELECT a.up, w.k, a.d, a.n_convs, a.chars, a.n_children, w.up FROM a JOIN w ON w.k = a.up),
 t AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars)::BIGINT AS saved_tokens FROM a GROUP BY top)
 SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256 FROM w JOIN t ON t.top = w.k LEFT JOIN w q ON q.k = w.up"""
