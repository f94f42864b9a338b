"""Deterministic splits, samples, caps and policy choice. Every random choice is an order by a hash of seed, salt and id."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions.scalars import hash_rank_key

from .staging import running


def lowest_hash(df: DataFrame, k: int, seed: int, salt: str, by: list[str], id_col: str = "flow_id") -> DataFrame:
    """TOP01: the k rows of lowest hash in each class; repeated ids count once."""
    rows = df.dropDuplicates([*by, id_col]).withColumn("key", hash_rank_key(F.col(id_col), seed, salt))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("key", id_col))).where(F.col("rank") <= k)


def cut(rank: Column, n: Column, val: float, test: float) -> Column:
    """TOP03: train, val or test by rank of n: rounded sizes, at least one of each where n allows."""
    t = F.when(n >= 3, F.greatest(F.lit(1), F.least(F.bround(n * test), n - 2))).otherwise(0)
    v = F.when(n >= 3, F.greatest(F.lit(1), F.least(F.bround(n * val), n - t - 1))).otherwise(0)
    return F.when(rank <= n - v - t, "train").when(rank <= n - t, "val").otherwise("test")


def _placed(rows: DataFrame, by: list[str], order: list) -> DataFrame:
    """rows with their place r in `order` and the rows n of their class: running counts, so no class is sorted in one task; of
    the counts there is one row a class."""
    keys = {f"_o{i}": F.col(c) if isinstance(c, str) else c for i, c in enumerate(order)}
    placed = running(rows.withColumns(keys), by, list(keys), {"r": F.lit(1)}).drop(*keys)
    if not by:
        return placed.withColumn("n", F.lit(rows.count()))
    sizes = [F.col(c).alias(f"_c{i}") for i, c in enumerate(by)]
    counts = rows.groupBy(*sizes).agg(F.count("*").alias("n"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_c{i}"))
    return placed.join(counts, same).drop(*[f"_c{i}" for i in range(len(by))])


def make_split(flows: DataFrame, kind: str, val: float = 0.1, test: float = 0.2, seed: int = 42) -> DataFrame:
    """TOP03: (flow_id, split) by `random`, `stratified` (by label), `temporal` or `temporal_stratified` order."""
    by = ["label"] if "stratified" in kind else []
    order = ["start_ts", "flow_id"] if "temporal" in kind else [hash_rank_key(F.col("flow_id"), seed), "flow_id"]
    rows = _placed(flows, by, order)
    return rows.select("flow_id", "label", cut(F.col("r"), F.col("n"), val, test).alias("split"))


def leave_one_out(flows: DataFrame, attack: str, seed: int, train: int, val: int, test: int) -> DataFrame:
    """TOP02: disjoint slices of benign flows in hash order; the held-out attack's flows join the test."""
    key = hash_rank_key(F.col("flow_id"), seed, "loo")
    # the bounded slice is cut by partial top-k before its rows are numbered
    some = flows.where("label = 'BENIGN'").withColumn("key", key).orderBy("key", "flow_id").limit(train + val + test)
    benign = some.withColumn("r", F.row_number().over(Window.orderBy("key", "flow_id")))
    split = F.when(F.col("r") <= train, "train").when(F.col("r") <= train + val, "val").otherwise("test")
    return benign.select("flow_id", split.alias("split")).unionByName(flows.where(F.col("label") == attack).select("flow_id", F.lit("test").alias("split")))


def validate_split(splits: DataFrame) -> DataFrame:
    """TOP05: flows that are in more than one split."""
    return splits.groupBy("flow_id").agg(F.count_distinct("split").alias("splits")).where("splits > 1")


def split_coverage(splits: DataFrame) -> DataFrame:
    """AGG07, SET02: rows of each label in each split, 0 where it has none."""
    have = splits.groupBy("split", "label").agg(F.count("*").alias("n"))
    grid = splits.select("split").distinct().crossJoin(splits.select("label").distinct())
    return grid.join(have, ["split", "label"], "left").select("split", "label", F.coalesce("n", F.lit(0)).alias("n"))


def cap_flows(flows: DataFrame, per_label: int, per_binary: int, seed: int = 42) -> DataFrame:
    """TOP06: at most per_label rows of a label by hash, then per_binary of a binary class, taken label by label in turn."""
    key = hash_rank_key(F.col("flow_id"), seed, "cap")
    rows = flows.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy(key, "flow_id"))).where(F.col("r") <= per_label)
    turn = F.row_number().over(Window.partitionBy("binary").orderBy("r", "label"))
    return rows.withColumn("turn", turn).where(F.col("turn") <= per_binary).drop("r", "turn")


def dedupe(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """TOP07: the first row of each key."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("nth = 1").drop("nth")


def sample_fraction(df: DataFrame, fraction: float, by: list[str], seed: int = 42) -> DataFrame:
    """TOP09: ceil(fraction * n) rows of each class in hash order."""
    rows = _placed(df, by, [hash_rank_key(F.col("flow_id"), seed, "fraction"), "flow_id"])
    return rows.where(F.col("r") <= F.ceil(F.col("n") * fraction)).drop("r", "n")


def select_policy(summaries: DataFrame, max_fpr: float, min_recall: float) -> DataFrame:
    """TOP14: of policies within both limits the one of highest recall, then lowest fpr, then name."""
    return summaries.where((F.col("fpr") <= max_fpr) & (F.col("recall") >= min_recall)).orderBy(F.desc("recall"), "fpr", "policy").limit(1)


def worst_panel(summaries: DataFrame) -> DataFrame:
    """TOP14: each policy's lowest recall and highest fpr over panels."""
    return summaries.groupBy("policy").agg(F.min("recall").alias("recall"), F.max("fpr").alias("fpr"), F.count("*").alias("panels"))


def lowest_attacks(scores: DataFrame, k: int, by: list[str]) -> DataFrame:
    """TOP15: the k lowest-scoring attacks of each run."""
    return scores.where("y = 1").withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("score", "flow_id"))).where(F.col("rank") <= k)


def uniform(seed: int, salt: str, *cols: Column) -> Column:
    """A number in [0, 1) from a hash of seed, salt and columns: the same on every run and cluster."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *cols), F.lit(1 << 40)) / float(1 << 40)


def perturb(rows: DataFrame, mode: str, strength: float, seed: int = 42) -> DataFrame:
    """AUG01-05 on packet rows (flow, ts, seq, len, dir): packet_delete (one packet stays at least), packet_insert and
    direction_flip (one packet at least), length_padding, length_align, iat_jitter (normal, a share of the gap), delay_stretch,
    burst_split (short gaps widened), burst_merge (long gaps shortened), low_rate_c2 (evenly spaced packets at a slow steady pace; of flows
    whose column `attack` is false, if there is one, nothing) and short_flow_delete (flows of under 6 packets). Draws hash (seed, mode, flow, seq)."""
    u = uniform(seed, mode, F.col("flow"), F.col("seq"))
    w = Window.partitionBy("flow")
    hit = (F.col("u") < strength) | (F.col("u") == F.col("least"))
    drawn = rows.withColumns({"u": u, "least": F.min(u).over(w)})
    if mode == "packet_delete":
        return rows.withColumns({"u": u, "top": F.max(u).over(w)}).where((F.col("u") >= strength) | (F.col("u") == F.col("top"))).drop("u", "top")
    if mode == "packet_insert":
        more = drawn.where(hit).drop("u", "least").withColumns({"ts": F.col("ts") + 5e-4, "len": F.bround(F.col("len") * (0.5 + uniform(seed, "scale", F.col("flow"), F.col("seq")))).cast("int")})
        return rows.unionByName(more)
    if mode == "direction_flip":
        return drawn.withColumn("dir", F.when(hit, 1 - F.col("dir")).otherwise(F.col("dir"))).drop("u", "least")
    if mode == "length_padding":
        return rows.withColumn("len", (F.col("len") + 1 + F.floor(u * max(1, round(64 * strength)))).cast("int"))
    if mode == "length_align":
        to = (64, 128, 256)[min(2, max(0, -(-int(strength * 300) // 100) - 1))]
        return rows.withColumn("len", (F.floor((F.col("len") + to - 1) / to) * to).cast("int"))
    order = w.orderBy("ts", "seq")
    raw = F.col("ts") - F.lag("ts").over(order)
    at = rows.withColumns({"gap": F.greatest(raw, F.lit(1e-6)), "first": F.min("ts").over(w)})

    def retimed(gap: Column) -> DataFrame:
        moved = at.withColumn("to", F.coalesce(gap, F.lit(0.0)))
        return moved.withColumn("ts", F.col("first") + F.sum("to").over(order.rowsBetween(Window.unboundedPreceding, 0))).select(*rows.columns)

    if mode == "delay_stretch":
        return retimed(F.col("gap") * (1 + strength * (0.5 + u)))
    if mode == "iat_jitter":
        normal = F.sqrt(-2 * F.log(1 - u)) * F.cos(2 * math.pi * uniform(seed, "angle", F.col("flow"), F.col("seq")))
        at = at.withColumn("gap", raw)
        return retimed(F.greatest(F.col("gap") + normal * F.greatest(F.abs("gap") * strength, F.lit(1e-6)), F.lit(0.0)))
    if mode in ("burst_split", "burst_merge"):
        cut = at.groupBy("flow").agg(F.percentile("gap", F.lit(0.25 if mode == "burst_split" else 0.75)).alias("cut"))
        at = at.join(cut, "flow")
        if mode == "burst_split":
            return retimed(F.when(F.col("gap") <= F.col("cut"), F.col("gap") * (1 + 10 * max(strength, 0.01))).otherwise(F.col("gap")))
        return retimed(F.when(F.col("gap") >= F.col("cut"), F.greatest(F.col("gap") * max(0.0, 1 - strength), F.lit(1e-6))).otherwise(F.col("gap")))
    if mode == "low_rate_c2":
        attack = F.col("attack") if "attack" in rows.columns else F.lit(True)
        facts = at.groupBy("flow").agg(F.count("*").alias("n"), F.coalesce(F.percentile("gap", F.lit(0.5)), F.lit(1.0)).alias("pace"))
        want = F.greatest(F.lit(2.0), F.bround(F.col("n") * max(0.05, 1 - strength)))
        ranked = at.withColumn("i", F.row_number().over(order) - 1).join(facts, "flow").withColumn("want", want)
        j = F.ceil(F.col("i") * (F.col("want") - 1) / (F.col("n") - 1))  # the only place that could be this packet's
        slow = attack & (F.col("want") < F.col("n"))
        kept = ranked.withColumn("j", F.when(slow, j)).where(~slow | (F.floor(F.col("j") * (F.col("n") - 1) / (F.col("want") - 1)) == F.col("i")))
        pace = F.greatest(F.col("pace"), F.lit(1e-3)) * (1 + 20 * max(strength, 0.01))
        return kept.withColumn("ts", F.when(slow, F.col("first") + F.col("j") * pace).otherwise(F.col("ts"))).select(*rows.columns)
    if mode == "short_flow_delete":
        sized = rows.withColumns({"n": F.count("*").over(w), "f": uniform(seed, mode, F.col("flow"))})
        return sized.where((F.col("n") >= 6) | (F.col("f") >= strength)).drop("n", "f")
    raise ValueError(f"unknown mode {mode}")


def perturb_panel(rows: DataFrame, modes: list[str], strengths: list[float], seed: int = 42) -> DataFrame:
    """AUG06: every mode at every strength, marked."""
    out = None
    for m in modes:
        for s in strengths:
            one = perturb(rows, m, s, seed).withColumns({"mode": F.lit(m), "strength": F.lit(float(s))})
            out = one if out is None else out.unionByName(one)
    return out
