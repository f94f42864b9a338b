"""Exact top-k inner products by dual-tree search over cover trees.

Spark deals data and queries into blocks around pivots and prunes pairs of blocks by their covering radii; in each pair left, cover trees
over both sides are descended together. A pair of nodes is dropped when no product in it can reach the worst k-th score
of the query node: <c_q, c_d> + |c_q| r_d + |c_d| r_q + r_q r_d bounds them all. Each query block meets its most
promising data blocks first; the k-th scores found there prune the pairs that are left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import staged, table

K = 5
SCALE = 256
QUERY_STEP = 50
#: Vectors aimed at in a data block and in a query block, vectors of the bounded sample that gives pivots and first thresholds.
DATA_BLOCK = 4096
QUERY_BLOCK = 4096
SAMPLE = 1024
PIVOTS = 64
#: Data blocks that a query block meets before the others are pruned again.
FIRST = 2
LEAF, QUERY_LEAF = 512, 64
FANOUT = 12
_EXACT = 2.0**53
_SLACK = 1e-9


@dataclass
class Node:
    center: np.ndarray
    radius: float
    rows: np.ndarray
    children: list[Node] = field(default_factory=list)


def cover_tree(x: np.ndarray, leaf: int, rows: np.ndarray | None = None, center: np.ndarray | None = None) -> Node:
    """Farthest-first cover tree: a node's children lie apart by over half its radius, at most FANOUT of them, and every
    row of a node lies within its radius. Equal rows share a leaf."""
    rows = np.arange(len(x)) if rows is None else rows
    center = x[rows].mean(0) if center is None else center
    far = np.sqrt(((x[rows] - center) ** 2).sum(1))
    node = Node(center, float(far.max()) * (1 + _SLACK) if len(rows) else 0.0, rows)
    if len(rows) <= leaf:
        return node
    at, owner, near = int(far.argmin()), np.zeros(len(rows), int), np.full(len(rows), np.inf)
    centers = []
    while len(centers) < FANOUT:
        c = x[rows[at]]
        centers.append(c)
        away = np.sqrt(((x[rows] - c) ** 2).sum(1))
        closer = away < near
        owner[closer], near[closer] = len(centers) - 1, away[closer]
        at = int(near.argmax())
        if near[at] <= node.radius / 2 or near[at] == 0:
            break
    if len(centers) > 1:
        node.children = [cover_tree(x, leaf, rows[owner == i], c) for i, c in enumerate(centers)]
    return node


def products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of whole-number vectors, exact: in doubles while they fit, else in Python's integers."""
    if not q.size or not d.size or np.abs(q).max() * np.abs(d).max() * q.shape[1] < _EXACT:
        return q @ d.T
    whole = np.frompyfunc(int, 1, 1)
    return np.clip(whole(q).dot(whole(d).T), -(2**63), 2**63 - 1)


class Search:
    """Best k of each query: scores and ids, ordered by score, then by smaller id. own: the data row that a query is, or -1."""

    def __init__(self, q: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, own: np.ndarray, low: np.ndarray | None = None):
        self.q, self.d, self.d_ids, self.k, self.own = q, d, d_ids, k, own
        self.best: list[list[tuple]] = [[] for _ in q]
        self.worst = np.full(len(q), -np.inf) if low is None else low.astype(float).copy()
        self.skipped = 0

    def run(self) -> list[list[tuple]]:
        if len(self.q) and len(self.d):
            self.pair(cover_tree(self.q, QUERY_LEAF), cover_tree(self.d, LEAF))
        return self.best

    def bound(self, a: Node, b: Node) -> float:
        na, nb = float(np.linalg.norm(a.center)), float(np.linalg.norm(b.center))
        size = (na + a.radius) * (nb + b.radius)
        return float(a.center @ b.center) + na * b.radius + nb * a.radius + a.radius * b.radius + _SLACK * size

    def pair(self, a: Node, b: Node) -> None:
        if self.bound(a, b) < self.worst[a.rows].min():
            self.skipped += len(a.rows) * len(b.rows)
        elif not a.children and not b.children:
            self.leaf(a.rows, b.rows)
        elif b.children and (not a.children or len(b.rows) >= len(a.rows)):
            for child in sorted(b.children, key=lambda n: -self.bound(a, n)):
                self.pair(a, child)
        else:
            for child in a.children:
                self.pair(child, b)

    def leaf(self, rows: np.ndarray, cols: np.ndarray) -> None:
        ids, scores = self.d_ids[cols], products(self.q[rows], self.d[cols])
        good = (scores >= self.worst[rows][:, None]).astype(bool) & (self.own[rows][:, None] != cols)
        for a in np.flatnonzero(good.any(1)):
            i, at = rows[a], np.flatnonzero(good[a])
            s = scores[a][at]
            if len(at) > 4 * self.k:
                at = at[s >= np.partition(s, -self.k)[-self.k]]
                s = scores[a][at]
            merged = sorted([*self.best[i], *zip((-int(x) for x in s), ids[at].tolist())])[: self.k]
            self.best[i] = merged
            if len(merged) == self.k:
                self.worst[i] = max(self.worst[i], float(-merged[-1][0]))


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """(id, dim, v, copy, row): components floor(scale * x). Rows without an id, null vectors and vectors that hold a null or
    non-finite component (also after scaling) take no part. Equal rows are rows of their own, numbered by `copy` from 0;
    `row` is a hash that stands for one of them."""
    scaled = F.transform(F.col(vector_col), lambda x: F.lit(float(scale)) * x.cast("double"))
    usable = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("id"), scaled.alias("v")).where("id IS NOT NULL AND v IS NOT NULL").where(usable)
    whole = F.transform("v", lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    counted = rows.select("id", whole.alias("v")).groupBy("id", "v").agg(F.count("*").alias("n"))
    numbered = counted.select("id", F.size("v").alias("dim"), "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    return numbered.withColumn("row", F.xxhash64("id", "v", "copy"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), -1)


def _chained(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which neighbours are near."""
    left, out = set(range(1, len(pivots))), [0]
    while left:
        away = ((pivots - pivots[out[-1]]) ** 2).sum(1)
        out.append(min(left, key=lambda i: (away[i], i)))
        left.remove(out[-1])
    return out


def _deal(counts: dict[int, int], pivots: np.ndarray, rows: int, gather: bool) -> tuple[dict[int, tuple[int, int]], np.ndarray]:
    """{pivot: (group, salts)} and the groups' centers: a pivot of more than `rows` vectors has several salts; with `gather`,
    pivots near each other share a group of about `rows`."""
    groups: list[list[int]] = []
    full = 0
    for p in _chained(pivots):
        n = counts.get(p, 0)
        if not groups or not gather or full + n > rows:
            groups.append([])
            full = 0
        groups[-1].append(p)
        full += n
    dealt = {p: (g, -(-max(1, sum(counts.get(x, 0) for x in ps)) // rows)) for g, ps in enumerate(groups) for p in ps}
    return dealt, np.array([pivots[ps].mean(0) for ps in groups])


_PLACED = "id long, dim int, v array<double>, row long, copy long, g int, block string, low double, far double"


def top_k(data: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k highest inner products with the data rows other than itself (all,
    if fewer), ties to the smaller id. Both sides have the columns of whole_vectors(); only vectors of one length meet.

    A query that is a data row too (equal id, vector and copy) does not meet itself; equal queries have equal results, each
    its own. A bounded sample of the data gives pivots and every query's first threshold; blocks are salted, so a hot
    pivot or vector fills as many blocks as it needs. Overflowing scores stop at the limits of a long. Empty tables give no rows.
    """
    spark = data.sparkSession
    sample = data.orderBy(F.xxhash64("row"), "id").limit(SAMPLE).collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    by_dim = {n: [r for r in sample if r.dim == n] for n in {r.dim for r in sample}}
    known = {n: (np.array([r.row for r in rows]), np.array([r.v for r in rows], float).reshape(len(rows), -1)) for n, rows in by_dim.items()}
    pivots = {n: v[:: max(1, len(v) // PIVOTS)][:PIVOTS] for n, (_, v) in known.items()}

    def nearest(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        return (-2 * x @ p.T + (p**2).sum(1)).argmin(1)

    def count_near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for n, part in pdf.groupby("dim"):
                p = nearest(_matrix(part["v"]), pivots[n]) if n in pivots else np.zeros(len(part), int)
                yield pd.DataFrame({"dim": n, "p": p}).groupby(["dim", "p"]).size().reset_index(name="n")

    def blocks(df: DataFrame, rows: int, name: str, gather: bool) -> tuple[DataFrame, DataFrame, dict]:
        counts: dict[int, dict[int, int]] = {}
        for r in df.select("dim", "v").mapInPandas(count_near, "dim int, p int, n long").groupBy("dim", "p").agg(F.sum("n").alias("n")).collect():
            counts.setdefault(r.dim, {})[r.p] = r.n
        dealt = {n: _deal(counts.get(n, {}), p, rows, gather) for n, p in pivots.items()}
        spare = {n: -(-sum(c.values()) // rows) for n, c in counts.items()}

        def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for n, part in pdf.groupby("dim"):
                    x, out = _matrix(part["v"]), part.assign(g=0, low=-np.inf)
                    salts = np.full(len(x), spare[n])
                    if n in pivots:
                        own, (to, centers) = nearest(x, pivots[n]), dealt[n]
                        g, salts = np.array([to[p][0] for p in own]), np.array([to[p][1] for p in own])
                        out["g"], out["far"] = g, np.sqrt(((x - centers[g]) ** 2).sum(1))
                        if gather:
                            ids, v = known[n]
                            s = np.asarray(products(x, v), float)
                            s[part["row"].to_numpy()[:, None] == ids] = -np.inf
                            if s.shape[1] > k:
                                out["low"] = np.partition(s, -k, axis=1)[:, -k]
                    else:
                        out["far"] = np.sqrt((x**2).sum(1))
                    salt = (part["row"].to_numpy().view(np.uint64) % salts.astype(np.uint64)).astype(int)
                    out["block"] = [f"{n}/{g}/{s}" for g, s in zip(out["g"], salt, strict=True)]
                    yield out[["id", "dim", "v", "row", "copy", "g", "block", "low", "far"]]

        placed = staged(df.select("id", "dim", "v", "row", "copy").mapInPandas(place, _PLACED), name)
        return placed, placed.groupBy("block", "dim", "g").agg(F.max("far").alias("radius"), F.min("low").alias("low")), {n: c for n, (_, c) in dealt.items()}

    d, d_blocks, d_centers = blocks(data, DATA_BLOCK, "data", False)
    q, q_blocks, q_centers = blocks(queries, QUERY_BLOCK, "queries", True)

    @F.pandas_udf("double")
    def most(dim: pd.Series, a: pd.Series, b: pd.Series, r_a: pd.Series, r_b: pd.Series) -> pd.Series:
        out = np.full(len(dim), np.inf)
        for n in set(dim) & set(pivots):
            at = np.flatnonzero(dim == n)
            x, y, s, t = q_centers[n][a.to_numpy()[at]], d_centers[n][b.to_numpy()[at]], r_a.to_numpy()[at], r_b.to_numpy()[at]
            nx, ny = np.sqrt((x**2).sum(1)), np.sqrt((y**2).sum(1))
            out[at] = (x * y).sum(1) + nx * t + ny * s + s * t + 1e-6 * (1 + (nx + s) * (ny + t))
        return pd.Series(out)

    a, b = q_blocks.alias("a"), d_blocks.alias("b")
    bound = most("a.dim", "a.g", "b.g", "a.radius", "b.radius")
    pairs = a.join(b, "dim").withColumn("most", bound).where("most >= a.low").select(F.col("a.block").alias("qb"), F.col("b.block").alias("db"), "most")
    nth = F.row_number().over(Window.partitionBy("qb").orderBy(F.desc("most"), "db"))
    pairs = staged(pairs.withColumn("nth", nth), "pairs")

    def search(qs: pd.DataFrame, ds: pd.DataFrame) -> pd.DataFrame:
        if qs.empty or ds.empty:
            return pd.DataFrame({"query_id": [], "query": [], "vec_id": [], "score": []}, dtype="int64")
        where = {r: i for i, r in enumerate(ds["row"])}
        own = np.array([where.get(r, -1) for r in qs["row"]])
        found = Search(_matrix(qs["v"]), _matrix(ds["v"]), ds["id"].to_numpy(), k, own, qs["low"].to_numpy()).run()
        rows = [(i, r, vec, -s) for i, r, best in zip(qs["id"], qs["row"], found, strict=True) for s, vec in best]
        return pd.DataFrame(rows, columns=["query_id", "query", "vec_id", "score"], dtype="int64")

    def searched(q: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
        left = q.withColumnRenamed("block", "qb").join(pairs.select("qb", "db"), "qb").select("qb", "db", "id", "row", "v", "low")
        right = d.join(pairs.select(F.col("qb").alias("of"), F.col("db").alias("block")), "block").select("of", "block", "id", "row", "v")
        found = left.groupBy("qb", "db").cogroup(right.groupBy("of", "block")).applyInPandas(search, "query_id long, query long, vec_id long, score long")
        order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
        return staged(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), name)

    first = searched(q, pairs.where(F.col("nth") <= FIRST), "first")
    kth = first.where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("kth"))
    raised = q.join(kth, "row", "left").withColumn("low", F.greatest("low", F.col("kth").cast("double"))).drop("kth")
    lows = raised.groupBy(F.col("block").alias("qb")).agg(F.min("low").alias("least"))
    rest = pairs.where(F.col("nth") > FIRST).join(lows, "qb").where("most >= least")
    found = first.unionByName(searched(raised, rest, "rest")).drop("rank")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = staged(whole_vectors(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(data, data.where(F.col("id") % QUERY_STEP == 0))
