"""Benign memory: exact and approximate nearest neighbours, prototypes, coresets, governance."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import first_rows, hash_number, lookup, running, staged


#: Tokens that at least this share of the memory has, up to WIDEST of them, are columns of dense products; the others meet by their lists.
FREQUENT, WIDEST = 0.05, 2048
#: Rows of a block of queries and of a block of memory, query rows of one product, and pairs of one stretch of rare tokens' lists.
SPARSE_QUERIES, SPARSE_MEMORY, PRODUCT_ROWS, STRETCH = 8192, 8192, 256, 1 << 21
#: Tokens of the rows of a block, about, and tasks that a search is dealt to at least, if it has rows enough.
BLOCK_TOKENS, SEARCH_TASKS = 1 << 22, 32


def sparse_blocks(query: DataFrame, memory: DataFrame) -> tuple[DataFrame, DataFrame, int, bool]:
    """What `nearest_sparse` searches: the blocks of both sides, staged once for any number of searches, how many tokens are columns of
    dense products, and whether the weights of every row are equal and above 0."""
    n, rows = memory.agg(F.count_distinct("mid")).first()[0], query.agg(F.count_distinct("id")).first()[0]
    both = query.groupBy("token").agg(F.count("*").alias("asked")).join(memory.groupBy("token").agg(F.count_distinct("mid").alias("df"), F.count("*").alias("held")), "token")
    idf = F.log((1 + n) / (1 + F.col("df"))) + 1
    vocab = staged(running(both.withColumn("idf", idf), [], [F.desc("df"), "token"], {"place": F.lit(1)}).withColumn("place", (F.col("place") - 1).cast("int")), "places")
    width, asked, held = vocab.agg(F.count_if(F.col("df") >= max(2, n * FREQUENT)), F.sum("asked"), F.sum("held")).first()
    blocks = lambda size, block, tokens, most: max(-(-size // block), -(-(tokens or 0) // BLOCK_TOKENS), min(most, -(-size // PRODUCT_ROWS)), 1)

    def packed(df: DataFrame, key: str, weight: str, total: int, of: int) -> DataFrame:
        known = lookup(df.select(key, "token", "w"), vocab.select("token", weight, "place", "idf"), "token", weight, total or 1).where("place IS NOT NULL")
        dealt = known.select(F.pmod(F.xxhash64(key), F.lit(of)).cast("int").alias("block"), F.col(key).alias("key"), "place", F.col("w").cast("double").alias("w"), "idf").repartitionById(of, "block")
        kind = dict(df.dtypes)[key]

        def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            parts = [b for b in batches if len(b)]
            if parts:
                rows = pd.concat(parts)
                keys, row = np.unique(rows["key"].to_numpy(), return_inverse=True)
                place, w = rows["place"].to_numpy(), rows["w"].to_numpy()
                most, least = np.full(len(keys), -np.inf), np.full(len(keys), np.inf)
                np.maximum.at(most, row, w)
                np.minimum.at(least, row, w)
                even = bool((most == least).all() and (least > 0).all())
                order = np.lexsort((place, row) if key == "id" else (row, place))
                idfs = [None] if key == "id" else [rows["idf"].to_numpy()[order]]
                yield pd.DataFrame({"block": [int(rows["block"].iloc[0])], "keys": [list(keys)], "places": [place[order]], "at": [row[order].astype(np.int32)], "ws": [most if even else w[order]], "idfs": idfs, "even": [even]})

        return staged(dealt.mapInPandas(pack, f"block int, keys array<{kind}>, places array<int>, at array<int>, ws array<double>, idfs array<double>, even boolean"), f"{key}-blocks")

    q = packed(query, "id", "asked", asked, blocks(rows, SPARSE_QUERIES, asked, SEARCH_TASKS))
    m = packed(memory, "mid", "held", held, blocks(n, SPARSE_MEMORY, held, 4))
    even = q.select("even").unionByName(m.select("even")).agg(F.coalesce(F.bool_and("even"), F.lit(False))).first()[0]
    return q, m, min(width, WIDEST), even


def nearest_sparse(query: DataFrame, memory: DataFrame, k: int, by: str = "dot", blocks: tuple | None = None) -> DataFrame:
    """JOI13 and JOI14: for each query the k best memory rows (id, mid, dot, r) of those that share a token with it, exact, of sparse
    rows (id, token, w) and a memory (mid, token, w), which are read several times. `by` is "dot", the inner product above 0, or
    "shared", the summed idf of the shared tokens to 9 places (dot then also has 9); ties go to the smaller id. A dot is to 12 places, but
    where the weights of every row are equal it is the plain sum of its equal products, as SQL adds them up.

    Rows, as lists of the places of their tokens in order of frequency, are packed into blocks (`sparse_blocks`, which several searches may
    share), a row each. Every block of queries meets every block of memory by a nested loop over the partitions of both, so neither pairs nor
    copies of rows are shuffled: frequent tokens are multiplied as dense columns, the lists of the rare ones are met in bounded
    stretches, and a task keeps k rows a query while the memory's blocks pass by one after the other. The products, as all pairs, grow with the square of the rows.
    """
    ids, mids = dict(query.dtypes)["id"], dict(memory.dtypes)["mid"]
    q, m, width, even = blocks or sparse_blocks(query, memory)
    shared = by == "shared"

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        searches = {}
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.qb not in searches:
                    searches[r.qb] = _Search((np.asarray(r.ids), *_entries(r.q_at, r.q_places, r.q_ws, r.q_even)), width, k, shared, even)
                searches[r.qb].meet(np.asarray(r.mids), *_entries(r.m_at, r.m_places, r.m_ws, r.m_even), np.asarray(r.m_idfs) if shared else None)
        for search in searches.values():
            yield from search.found()

    side = lambda df, name, key: df.select(F.col("block").alias(f"{name}b"), F.col("keys").alias(key), *[F.col(c).alias(f"{name}_{c}") for c in ("at", "places", "ws", "even", *(["idfs"] if name == "m" and shared else []))])
    (qs, last), ms = q.agg(F.count("*"), F.max("block")).first(), m.count()
    streams = max(1, min(ms, -(-SEARCH_TASKS // max(qs, 1))))
    pairs = side(m, "m", "mids").repartitionById(streams, F.pmod("mb", F.lit(streams))).hint("shuffle_replicate_nl").crossJoin(side(q, "q", "ids").repartitionById((last or 0) + 1, "qb").hint("shuffle_replicate_nl"))
    found = pairs.mapInPandas(best, f"id {ids}, mid {mids}, dot double, key double, r int")
    if streams > 1:
        found = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("key"), "mid"))).where(F.col("r") <= k)
    return found.select("id", "mid", "dot", "r")


def _entries(at: np.ndarray, places: np.ndarray, ws: np.ndarray, even: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The entries of a block as three arrays: row, place, weight."""
    at, ws = np.asarray(at), np.asarray(ws)
    return at, np.asarray(places), ws[at] if even else ws


def _added(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """x added up n times, one after the other, as a sum of n equal products is: n * x but for its last digits."""
    pairs, back = np.unique(n + 1j * x, return_inverse=True)
    out, times, x = np.zeros(len(pairs)), pairs.real, pairs.imag
    for start in np.searchsorted(times, np.arange(int(times.max(initial=0))), "right"):
        out[start:] += x[start:]
    return out[back]


class _Search:
    """The k best rows so far of each row of a block of queries, to which blocks of memory come one after the other."""

    def __init__(self, queries: tuple, width: int, k: int, shared: bool, even: bool):
        self.ids, self.at, self.place, self.w = queries
        self.width, self.k, self.shared, self.even = width, k, shared, even
        self.best = {}

    def meet(self, mids: np.ndarray, row: np.ndarray, place: np.ndarray, w: np.ndarray, idf: np.ndarray | None) -> None:
        n, rare = len(mids), np.searchsorted(place, self.width)
        lists, spots = place[rare:], row[rare:]
        # equal weights are left out: shared tokens are counted, exactly also in floats
        held = ([(idf, False)] if self.shared else []) + [(np.ones(len(w), np.float32), False) if self.even else (w, True)]
        sides = []
        for v, weighted in held:
            x = np.zeros((self.width, n), v.dtype)
            np.add.at(x, (place[:rare], row[:rare]), v[:rare])
            sides.append((x, v[rare:], weighted))
        weight = np.zeros(n)
        weight[row] = w
        for low in range(0, len(self.ids), PRODUCT_ROWS):
            size = min(PRODUCT_ROWS, len(self.ids) - low)
            start, end = np.searchsorted(self.at, [low, low + size])
            i, p, own = self.at[start:end] - low, self.place[start:end], self.w[start:end]
            mine = np.zeros(size)
            mine[i] = own
            frequent = p < self.width
            first, last = (np.searchsorted(lists, p[~frequent], s) for s in ("left", "right"))
            met = last - first
            upto = np.concatenate([[0], np.cumsum(met)])
            cuts = np.unique(np.concatenate([np.searchsorted(upto, np.arange(0, upto[-1], STRETCH)), [len(met)]]))
            out = []
            for x, v, weighted in sides:
                y = np.zeros((size, self.width), v.dtype)
                np.add.at(y, (i[frequent], p[frequent]), own[frequent] if weighted else v.dtype.type(1))
                out.append(y @ x)
            for c, d in zip(cuts[:-1], cuts[1:], strict=True):
                spot = np.repeat(first[c:d] - upto[c:d], met[c:d]) + np.arange(upto[c], upto[d])
                flat = np.repeat(i[~frequent][c:d].astype(np.int64) * n, met[c:d]) + spots[spot]
                for z, (_, v, weighted) in zip(out, sides, strict=True):
                    np.add.at(z.ravel(), flat, v[spot] * np.repeat(own[~frequent][c:d], met[c:d]) if weighted else v[spot])
            self._keep(low, size, mids, out, mine, weight)

    def _keep(self, low: int, size: int, mids: np.ndarray, out: list, mine: np.ndarray, weight: np.ndarray) -> None:
        k, counted = self.k, self.even and not self.shared
        i0, m0, dot0, key0, least = self.best.get(low, (np.zeros(0, int), mids[:0], np.zeros(0), np.zeros(0), np.zeros(size)))
        rough = out[0] * weight.astype(np.float32) if counted else out[0]
        # what may be among the k best, with room for rounding: exact keys are made of these alone
        bound = least.copy()
        if counted:
            bound = np.divide(bound, mine, out=np.zeros(size), where=mine > 0)
        new = least <= 0
        if new.any():
            some = min(k, len(mids))
            bound[new] = np.partition(rough[new], len(mids) - some, axis=1)[:, len(mids) - some]
        bound = bound * (1 - 1e-5) if counted else bound - 1e-8
        i, j = np.nonzero((rough >= bound.astype(rough.dtype)[:, None]) & (rough > 0))
        product = mine[i] * weight[j]
        if counted:
            dot = key = _added(out[0][i, j].astype(float), product)
        else:
            places = 9 if self.shared else 12
            key = np.round(out[0][i, j], places)
            dot = np.round(out[1][i, j] * product if self.even else out[1][i, j], 9) if self.shared else key
        above = key > 0
        i, m, dot, key = np.concatenate([i0, i[above]]), np.concatenate([m0, mids[j[above]]]), np.concatenate([dot0, dot[above]]), np.concatenate([key0, key[above]])
        names = m if m.dtype.kind in "iu" else np.unique(m, return_inverse=True)[1]
        order = np.lexsort((names, -key, i))
        i, m, dot, key = i[order], m[order], dot[order], key[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        kept = rank < k
        least = np.zeros(size)
        least[i[rank == k - 1]] = key[rank == k - 1]
        self.best[low] = i[kept], m[kept], dot[kept], key[kept], least

    def found(self) -> Iterator[pd.DataFrame]:
        for low, (i, m, dot, key, _) in self.best.items():
            yield pd.DataFrame({"id": self.ids[i + low], "mid": m, "dot": dot, "key": key, "r": np.arange(1, len(i) + 1) - np.searchsorted(i, i)})


def knn_sparse(query: DataFrame, memory: DataFrame, k: int, ids: DataFrame | None = None) -> DataFrame:
    """JOI13: mean of the k smallest cosine distances of sparse unit rows (id, token, w) to a memory (mid, token, w).

    Pairs that share no token are at distance exactly 1, which pads a query that meets fewer than k. With fewer than k memory
    rows the mean is over those. `ids` (id) names all queries: one without a known token has no row in `query` and is at
    distance 1 of everything. Returns (id, score).
    """
    return mean_nearest(nearest_sparse(query, memory, k), memory, k, query if ids is None else ids)


def mean_nearest(nearest: DataFrame, memory: DataFrame, k: int, ids: DataFrame) -> DataFrame:
    """JOI13: the scores of `knn_sparse` from what `nearest_sparse` found for k or more neighbours."""
    by = nearest.where(F.col("r") <= k).groupBy("id").agg(F.sum(1 - F.col("dot")).alias("d"), F.count("*").alias("met"))
    n = memory.agg(F.least(F.lit(k), F.count_distinct("mid")).alias("k_"))
    rows = ids.select("id").distinct().join(by, "id", "left").crossJoin(F.broadcast(n))
    met = F.least(F.coalesce("met", F.lit(0)), F.col("k_"))
    return rows.select("id", ((F.coalesce("d", F.lit(0.0)) + (F.col("k_") - met)) / F.col("k_")).alias("score"))


def knn_inverted(query: DataFrame, memory: DataFrame, candidates: int, k: int, ids: DataFrame | None = None) -> DataFrame:
    """JOI14: candidates by summed idf of shared tokens, then exact distances among them only: the more candidates, the higher
    the recall (`inverted_recall`); `knn_sparse` is the exact way. A query without candidates, `ids` (id) naming those without
    a row, is scored against all of the memory: every distance is 1."""
    near = nearest_sparse(query, memory, candidates, "shared").drop("r").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("dot"), "mid"))).where(F.col("r") <= k)
    met = near.groupBy("id").agg(F.avg(1 - F.col("dot")).alias("score"), F.count("*").alias("neighbours"))
    n = memory.agg(F.count_distinct("mid").alias("n"))
    rows = (query if ids is None else ids).select("id").distinct().join(met, "id", "left").crossJoin(F.broadcast(n)).where("n > 0")
    return rows.select("id", F.coalesce("score", F.lit(1.0)).alias("score"), F.coalesce("neighbours", F.least(F.lit(k), F.col("n"))).alias("neighbours"))


def inverted_recall(query: DataFrame, memory: DataFrame, candidates: int, k: int) -> DataFrame:
    """SET03 for JOI14: mean share of each query's k exact nearest that its candidates reach, ties with the k-th counting as
    reached; queries that share no token with the memory are left out. One row (queries, recall)."""
    blocks = sparse_blocks(query, memory)  # both searches read them
    exact = staged(nearest_sparse(query, memory, k, blocks=blocks).groupBy("id").agg(F.count("*").alias("wanted"), F.round(F.min("dot"), 9).alias("kth")), "kth")
    found = nearest_sparse(query, memory, candidates, "shared", blocks).join(exact, "id").where("dot >= kth").groupBy("id").agg(F.count("*").alias("hits"))
    share = F.least(F.coalesce("hits", F.lit(0)), F.col("wanted")) / F.col("wanted")
    return exact.join(found, "id", "left").agg(F.count("*").alias("queries"), F.avg(share).alias("recall"))


def dot(a, b):
    """Inner product of two arrays."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Rows of a block of queries and of a block of memory in dense products, and pairs of one product.
QUERY_BLOCK, MEMORY_BLOCK, PAIRS = 16384, 16384, 1 << 20


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array(column.tolist(), float).reshape(len(column), -1)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine distances of unit rows to 9 places, in one matrix."""
    out = a @ b.T
    return np.round(np.subtract(1, out, out=out), 9, out=out)


def _smallest(away: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k smallest finite values of each row, ties to the earlier column: no more of them than k a row, whatever ties."""
    last = min(k, away.shape[1]) - 1
    bound = np.partition(away, last, axis=1)[:, [last]]
    bound[np.isnan(bound)] = np.inf
    keep, tie = away < bound, (away == bound) & np.isfinite(bound)
    keep |= tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= k - keep.sum(1, keepdims=True))
    return np.nonzero(keep)


def nearest_blocks(query: DataFrame, memory: DataFrame, k: int, prepare: Callable, distances: Callable) -> DataFrame:
    """For each query (id, ...) the k nearest memory rows (mid, ...) but that of the same id, ties to the smaller id: (id, rank, mid, distance).

    Both sides are dealt to blocks, whose number grows with the rows, and a pair of blocks is one task's group, which leaves each query's
    k best. `prepare` makes what `distances` needs of the rows of one side; that gives the matrix of some queries, PAIRS pairs at most,
    and a block of memory, infinite where a pair is none. Only k pairs a query leave the matrix, however many tie.
    """
    qs, ms = (max(-(-n // block), min(8, -(-n // 2048)), 1) for n, block in ((query.count(), QUERY_BLOCK), (memory.count(), MEMORY_BLOCK)))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = query.select("*", F.pmod(F.xxhash64("id"), F.lit(qs)).cast("int").alias("qb"), each(ms).alias("mb"))
    m = memory.select("*", F.pmod(F.xxhash64("mid"), F.lit(ms)).cast("int").alias("mb"), each(qs).alias("qb"))
    ids, kinds = dict(query.dtypes)["id"], dict(memory.dtypes)["mid"]

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("mid", kind="stable")
        out = [pd.DataFrame({"id": a["id"][:0], "mid": b["mid"][:0], "distance": np.zeros(0)})]
        side, step = prepare(b) if len(b) else None, max(1, PAIRS // max(1, len(b)))
        for low in range(0, len(a) if len(b) else 0, step):
            part = a[low : low + step]
            away = distances(prepare(part), side)
            away[part["id"].to_numpy()[:, None] == b["mid"].to_numpy()[None, :]] = np.inf
            i, j = _smallest(away, k)
            out.append(pd.DataFrame({"id": part["id"].to_numpy()[i], "mid": b["mid"].to_numpy()[j], "distance": away[i, j]}))
        return pd.concat(out[1:] or out)

    found = q.groupBy("qb", "mb").cogroup(m.groupBy("qb", "mb")).applyInPandas(nearest, f"id {ids}, mid {kinds}, distance double")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("distance", "mid"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("id", "rank", "mid", "distance")


def knn_dense(query: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """JOI13 for dense vectors (id, v) and (mid, v) of one length: the stated query set against all memory rows but that of the
    same id, by cosine, as products of blocks. A zero vector is at distance 1 of all. Returns (id, rank, mid, distance), distances to 9 places.
    """
    return nearest_blocks(query.select("id", "v"), memory.select("mid", "v"), k, lambda rows: _unit(rows["v"]), _apart)


def mean_distance(query: DataFrame, memory: DataFrame, k: int) -> DataFrame:
    """(id, score): mean cosine distance to the k nearest memory rows."""
    return knn_dense(query, memory, k).groupBy("id").agg(F.round(F.avg("distance"), 9).alias("score"))


def prototypes(rows: DataFrame, group: str) -> DataFrame:
    """JOI16: the mean vector of each group of (group, v), in long form (group, i, c)."""
    return rows.select(group, F.posexplode("v").alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("c"))


def prototype_distances(rows: DataFrame, centers: DataFrame, group: str) -> DataFrame:
    """JOI16: Euclidean distance of (id, v) to every group's prototype; sums join on the position, a row a (id, group)."""
    long = rows.select("id", F.posexplode("v").alias("i", "x"))
    return long.join(F.broadcast(centers), "i").groupBy("id", group).agg(F.sqrt(F.sum(F.pow(F.col("x") - F.col("c"), F.lit(2)))).alias("distance"))


def coreset(memory: DataFrame, ratio: float, strategy: str, seed: int = 42) -> DataFrame:
    """TOP11: a share of memory rows (mid, distance): by hash order, or `tail`: half those farthest from the centre (ties to
    the smaller id), the rest by hash order."""
    key = F.sha1(F.concat_ws("|", F.lit(str(seed)), F.col("mid").cast("string")))
    want = memory.agg(F.ceil(F.count("*") * ratio).cast("bigint")).first()[0]
    tail = want // 2 if strategy == "tail" else 0
    far = first_rows(memory, -F.col("distance"), ["mid"], tail).select("mid")
    rest = first_rows(memory.join(far, "mid", "left_anti"), hash_number(key), [key], want - tail)
    return far.select("mid", F.lit(1).alias("tail")).unionByName(rest.select("mid", F.lit(0).alias("tail")))


def gate(scores: DataFrame, val: DataFrame) -> DataFrame:
    """CAL09: candidates' bucket and admission by percentiles of the validation scores."""
    from flowharbor.functions import scalars as S

    cut = val.agg(F.percentile("score", F.array(*[F.lit(p) for p in (0.95, 0.99, 0.995, 1.0)])).alias("q"))
    rows = scores.crossJoin(F.broadcast(cut)).withColumn("bucket", S.gate_bucket(F.col("score"), F.col("q")[0], F.col("q")[1], F.col("q")[2], F.col("q")[3]))
    return rows.select("id", "score", "bucket", S.admission(F.col("bucket")).alias("admission"))


def neighbour_recall(exact: DataFrame, variant: DataFrame) -> DataFrame:
    """SET03: mean share of exact neighbours (id, mid) that a variant finds."""
    hit = exact.join(variant.select("id", "mid").withColumn("hit", F.lit(1)), ["id", "mid"], "left")
    return hit.groupBy("id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("r")).agg(F.avg("r").alias("recall"), F.count("*").alias("queries"))
