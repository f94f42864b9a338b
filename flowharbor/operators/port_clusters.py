"""CAL13: k-means of every port's windows at once, as rounds of assignment and aggregation over blocks of windows.

A port's windows are dealt to blocks of bounded size, however many it has; a round brings each block its port's centres,
adds up members by start and cluster inside the block, and merges these few sums in Spark. Several starts run side by side.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import discard, staged

#: Windows aimed at in a block.
BLOCK_ROWS = 50_000


def _uniform(hashes: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in (0, 1) from row hashes and a salt."""
    x = hashes.astype(np.int64).view(np.uint64)
    for s in (*salt, 1):
        x = (x ^ np.uint64(s + 1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, a centre at a time: a block times its clusters at most."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], axis=1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


def _centres(cell: object) -> np.ndarray:
    return np.array([list(c) for c in cell], float)


def _over_blocks(blocks: DataFrame, centres: DataFrame, ports: DataFrame, fold: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """fold(windows of a block, centres of its port) over all blocks."""
    dealt = centres.join(ports.select("_p", "_blocks"), "_p").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1))).drop("_blocks")
    return blocks.groupBy("_p", "_block").cogroup(dealt.groupBy("_p", "_block")).applyInPandas(fold, schema)


def _drawing(seed: int, step: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def draw(windows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        """A block's window of shortest waiting time for each start; none where all lie on a centre."""
        out = []
        hashes = windows["_h"].to_numpy()
        x = _matrix(windows["v"]) if len(windows) else None
        for start, c in zip(centres["start"], centres["c"], strict=True) if x is not None else ():
            rate = _gaps(x, _centres(c)).min(1) if len(c) else np.ones(len(x))
            wait = np.where(rate > 0, -np.log(_uniform(hashes, seed, start, step)) / np.where(rate > 0, rate, 1), np.inf)
            first = np.lexsort((hashes, wait))[0]
            if np.isfinite(wait[first]):
                out.append((windows["_p"].iloc[0], start, wait[first], hashes[first], x[first].tolist()))
        return pd.DataFrame(out, columns=["_p", "start", "wait", "h", "x"])

    return draw


def _seeds(blocks: DataFrame, ports: DataFrame, clusters: int, starts: int, seed: int) -> DataFrame:
    """(_p, start, c): first centres, each drawn with a chance that follows the squared distance to those before it: of
    exponential waiting times by that rate the shortest wins, which is a minimum, so blocks only send their own. A port
    with fewer distinct windows than `clusters` gets fewer centres."""
    none = F.array().cast("array<array<double>>")
    now = ports.select("_p", F.explode(F.sequence(F.lit(0), F.lit(starts - 1))).alias("start")).withColumn("c", none)
    for step in range(clusters):
        drawn = _over_blocks(blocks, now, ports, _drawing(seed, step), "_p string, start int, wait double, h long, x array<double>")
        best = drawn.groupBy("_p", "start").agg(F.min_by("x", F.struct("wait", "h")).alias("x"))
        more = now.join(best, ["_p", "start"], "left").select("_p", "start", F.when(F.col("x").isNull(), F.col("c")).otherwise(F.concat("c", F.array("x"))).alias("c"))
        before, now = now, staged(more, "seeds")
        discard(before)
    return now


def _members(windows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
    """Number, sum and squared distances of a block's windows by start and nearest centre."""
    out = []
    x = _matrix(windows["v"]) if len(windows) else None
    for start, c in zip(centres["start"], centres["c"], strict=True) if x is not None else ():
        gaps = _gaps(x, _centres(c))
        own = gaps.argmin(1)
        for k in np.unique(own).tolist():
            mine = own == k
            out.append((windows["_p"].iloc[0], start, k, int(mine.sum()), x[mine].sum(0).tolist(), float(gaps[mine, k].sum())))
    return pd.DataFrame(out, columns=["_p", "start", "k", "n", "s", "sse"])


def _means(parts: DataFrame, width: int) -> DataFrame:
    """(_p, start, means): the mean of each cluster that has windows, by its number, from the sums of the blocks."""
    sums = parts.groupBy("_p", "start", "k").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("s", F.lit(j))) for j in range(width)]).alias("s"))
    mean = F.struct("k", F.transform("s", lambda e: e / F.col("n")).alias("m"))
    return sums.groupBy("_p", "start").agg(F.map_from_entries(F.collect_list(mean)).alias("means"))


def cluster_ports(windows: DataFrame, clusters: int, starts: int = 10, rounds: int = 20, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """windows (_p, id, v) with `cluster`: each port's windows by k-means, the best of `starts` starts by squared distance.

    A start ends when its centres stand still, all after `rounds` at most. A cluster that loses its last window keeps its
    centre. Every v must have one length and no null; repeated rows count as often as they come.
    """
    sized = windows.groupBy("_p").agg(F.count("*").alias("_rows"))
    ports = staged(sized.select("_p", F.ceil(F.col("_rows") / block_rows).alias("_blocks")), "ports")
    hashed = windows.withColumn("_h", F.xxhash64("id", "v")).join(ports, "_p")
    blocks = staged(hashed.withColumn("_block", F.pmod(F.xxhash64("_h", F.lit(seed)), F.col("_blocks"))).drop("_blocks"), "windows")
    width = (blocks.select(F.size("v")).first() or [0])[0]
    now = _seeds(blocks, ports, clusters, starts, seed)
    for _ in range(rounds):
        parts = _over_blocks(blocks, now, ports, _members, "_p string, start int, k int, n long, s array<double>, sse double")
        at = now.join(_means(parts, width), ["_p", "start"], "left").withColumn("new", F.transform("c", lambda old, k: F.coalesce(F.try_element_at("means", k), old)))
        gap = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda most, x: F.greatest(most, x))
        step = staged(at.select("_p", "start", F.col("new").alias("c"), F.array_max(F.zip_with("new", "c", gap)).alias("moved")), "centres")
        still = not step.where("moved > 1e-9").limit(1).count()
        discard(now)
        now = step.select("_p", "start", "c")
        now._staged_at = step._staged_at
        if still:
            break
    cost = _over_blocks(blocks, now, ports, _members, "_p string, start int, k int, n long, s array<double>, sse double").groupBy("_p", "start").agg(F.sum("sse").alias("sse"))
    best = cost.groupBy("_p").agg(F.min(F.struct(F.round("sse", 9).alias("sse"), "start")).alias("b")).select("_p", F.col("b.start").alias("start"))
    kinds = dict(windows.dtypes)

    def assign(mine: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(mine):
            return pd.DataFrame({"_p": [], "id": [], "v": [], "cluster": []}, dtype=object)
        own = _gaps(_matrix(mine["v"]), _centres(centres["c"].iloc[0])).argmin(1)
        return mine[["_p", "id", "v"]].assign(cluster=own)

    out = staged(_over_blocks(blocks, now.join(best, ["_p", "start"]), ports, assign, f"_p string, id {kinds['id']}, v array<double>, cluster int"), "clusters")
    for done in (now, blocks, ports):
        discard(done)
    return out


def entropy_rule(windows: DataFrame, clusters: int, least_rows: int = 2, popular: float = 2.0, suspects: int = 2, starts: int = 10, rounds: int = 20, seed: int = 42, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """CAL13: (id, port, cluster, score, prediction) of windows (id, port, v): each port's windows are clustered, and the cluster
    of lowest mean in the last component (how widely a window's destinations spread) is suspected if it has `suspects` rows.

    The score is the gap to the port's highest cluster. Ports of fewer than `clusters` windows, or of more than a share of
    1 / popular of all, are left at 0 and without a cluster, and so is a window whose v is null or holds a null. A null
    port is a port of its own. Other columns are ignored; an empty table gives no rows.
    """
    kinds = dict(windows.dtypes)
    rows = windows.select("id", "port", F.col("v").cast("array<double>").alias("v"), F.coalesce(F.concat(F.lit("="), F.col("port").cast("string")), F.lit("")).alias("_p"))
    whole = F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x))
    n = rows.count()
    sized = rows.groupBy("_p").agg(F.count("*").alias("_rows"), F.count_if(whole).alias("_whole"))
    usable = (F.col("_whole") >= clusters) & (F.col("_rows") <= max(1.0, n / max(popular, 1e-6)))
    taken = staged(rows.join(sized.where(usable).select("_p"), "_p", "left_semi").where(whole), "usable")
    out = cluster_ports(taken.select("_p", "id", "v"), clusters, starts, rounds, seed, block_rows)
    facts = out.groupBy("_p", "cluster").agg(F.count("*").alias("size"), F.avg(F.element_at("v", -1)).alias("spread"))
    ends = facts.groupBy("_p").agg(F.min(F.struct("spread", "cluster")).alias("low"), F.max("spread").alias("top"))
    verdict = facts.join(ends, "_p").select("_p", "cluster", (F.col("top") - F.col("spread")).alias("score"), ((F.col("cluster") == F.col("low.cluster")) & (F.col("size") >= max(least_rows, suspects))).cast("int").alias("prediction"))
    port = F.when(F.col("_p") != "", F.substring("_p", 2, 1 << 20)).cast(kinds["port"]).alias("port")
    judged = out.join(F.broadcast(verdict) if verdict.count() <= 100_000 else verdict, ["_p", "cluster"]).select("id", port, "cluster", "score", "prediction")
    # what was not clustered: windows of other ports and incomplete ones
    left = rows.join(sized.where(usable).select("_p", F.lit(True).alias("_in")), "_p", "left").where(F.col("_in").isNull() | ~F.coalesce(whole, F.lit(False)))
    return judged.unionByName(left.select("id", "port", F.lit(None).cast("int").alias("cluster"), F.lit(0.0).alias("score"), F.lit(0).alias("prediction")))
