"""Behaviour tokens of packet rows (flow, ts, seq, len, dir): positional, burst-shape, transition and structural ones,
and profiles against peers in bounded chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S

from .flows import bursts
from .profiles import peer_chunks, shared_peers


def order():
    """A flow's packets in order."""
    return Window.partitionBy("flow").orderBy("ts", "seq")


def trace_tokens(rows: DataFrame, most: int = 32) -> DataFrame:
    """TOK07: for each of the first `most` packets a token of place, direction and length bin, with gap bins and direction changes."""
    at = rows.withColumns({"i": F.row_number().over(order()) - 1, "gap": F.col("ts") - F.lag("ts").over(order()), "before": F.lag("dir").over(order())}).where(F.col("i") < most)
    bin_ = S.log_bin(F.col("len"))
    kinds = F.array(
        F.concat_ws("_", F.lit("PKT"), "i", F.when(F.col("dir") == 1, "C").otherwise("S"), bin_.cast("string")), F.concat(F.lit("LENBIN_"), bin_),
        F.when(F.col("i") > 0, F.concat(F.lit("IATBIN_"), S.iat_bin(F.col("gap")))), F.when(F.col("before") != F.col("dir"), F.concat(F.lit("DIR_TRANS_"), "before", "dir")),
    )
    return at.select("flow", "i", F.explode(F.filter(kinds, lambda t: t.isNotNull())).alias("token"))


def first_k_tokens(rows: DataFrame, k: int = 3) -> DataFrame:
    """WIN16: the signature of a flow's first k packets: direction and length bin of each."""
    head = rows.withColumn("i", F.row_number().over(order())).where(F.col("i") <= k)
    part = F.concat(F.when(F.col("dir") == 1, "C").otherwise("S"), S.log_bin(F.col("len")))
    made = head.groupBy("flow").agg(F.sort_array(F.collect_list(F.struct("i", part.alias("p")))).alias("ps"))
    return made.select("flow", F.concat(F.lit("FIRSTK_"), F.array_join(F.transform("ps", lambda x: x["p"]), "_")).alias("token"))


def burst_shape_tokens(rows: DataFrame, gap: float, most: int = 4) -> DataFrame:
    """WIN14: the first most-1 bursts and the last: direction, count bin, byte bin, length of time bin."""
    b = bursts(rows, gap)
    w = Window.partitionBy("flow")
    at = b.withColumn("n_bursts", F.count("*").over(w)).where((F.col("burst") < most) | (F.col("burst") == F.col("n_bursts")))
    place = F.when(F.col("burst") < most, F.col("burst").cast("string")).otherwise("LAST")
    return at.select("flow", F.concat_ws("_", F.lit("BURST"), place, F.when(F.col("dir") == 1, "C").otherwise("S"), S.log_bin(F.col("n")).cast("string"), S.log_bin(F.col("bytes")).cast("string"), S.iat_bin(F.col("end") - F.col("start")).cast("string")).alias("token"))


def transition_tokens(rows: DataFrame, gap: float, most: int = 4) -> DataFrame:
    """WIN15: pairs of bursts in a row, and UP, DOWN or STABLE of length over the first 9 packets."""
    b = bursts(rows, gap)
    w = Window.partitionBy("flow").orderBy("burst")
    pair = b.withColumns({"d2": F.lead("dir").over(w), "n2": F.lead("n").over(w)}).where((F.col("burst") <= most) & F.col("d2").isNotNull())
    pairs = pair.select("flow", F.concat(F.lit("BT_"), "dir", S.log_bin(F.col("n")), F.lit("_"), "d2", S.log_bin(F.col("n2"))).alias("token"))
    step = rows.withColumns({"i": F.row_number().over(order()), "next": F.lead("len").over(order())}).where("i <= 8 AND next IS NOT NULL")
    way = F.when(F.col("next") > F.col("len"), "LT_UP").when(F.col("next") < F.col("len"), "LT_DOWN").otherwise("LT_STABLE")
    return pairs.unionByName(step.select("flow", way.alias("token")))


def structural_triggers(rows: DataFrame, small: int = 100, large: int = 1000, long_gap: float = 3600.0, run: int = 3) -> DataFrame:
    """WIN17: triggers (flow, family, name, count): packet shape (small and large packets), direction (dominance, turns), timing
    (long gaps), position (first and last), runs of small packets that restart after every larger one, and composites on what fired."""
    at = rows.withColumns({"before": F.lag("dir").over(order()), "gap": F.col("ts") - F.lag("ts").over(order()), "i": F.row_number().over(order()), "big": (F.col("len") >= small).cast("int")})
    at = at.withColumn("seg", F.sum("big").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    runs = at.where("big = 0").groupBy("flow", "seg").agg(F.count("*").alias("n")).where(F.col("n") >= run).groupBy("flow").agg(F.count("*").alias("small_runs"))
    f = at.groupBy("flow").agg(
        F.count_if(F.col("len") < small).alias("small"), F.count_if(F.col("len") >= large).alias("large"), F.count_if(F.col("before") != F.col("dir")).alias("turns"), F.count_if(F.col("gap") > long_gap).alias("long_gap"),
        F.avg("dir").alias("up"), F.max(F.when(F.col("i") == 1, F.col("dir"))).alias("first_up"), F.count("*").alias("n"),
    ).join(runs, "flow", "left").withColumn("small_runs", F.coalesce("small_runs", F.lit(0)))
    one = lambda c: c.cast("bigint")
    rules: list[tuple[str, str, Column]] = [
        ("PACKET", "SMALL", F.col("small")), ("PACKET", "LARGE", F.col("large")), ("PACKET", "SMALL_RUN", F.col("small_runs")), ("DIR", "TURNS", F.col("turns")), ("TIME", "LONG_GAP", F.col("long_gap")),
        ("DIR", "UP_DOMINANT", one((F.col("up") >= 0.8) & (F.col("n") >= 2))), ("DIR", "DOWN_DOMINANT", one((F.col("up") <= 0.2) & (F.col("n") >= 2))), ("POS", "FIRST_UP", one(F.col("first_up") == 1)),
        ("COMP", "LARGE_AND_TURNS", one((F.col("large") > 0) & (F.col("turns") > 0))), ("COMP", "GAP_AND_SMALL", one((F.col("long_gap") > 0) & (F.col("small") > 0))),
    ]
    made = F.array(*[F.struct(F.lit(a).alias("family"), F.lit(b).alias("name"), c.cast("bigint").alias("count")) for a, b, c in rules])
    return f.select("flow", F.explode(F.filter(made, lambda t: t["count"] > 0)).alias("t")).select("flow", "t.*")


def struct_vocab(triggers: DataFrame, train: DataFrame, least: int = 5) -> DataFrame:
    """AGG19: the names that at least `least` train flows fire, with that number."""
    return triggers.join(train.select("flow").distinct(), "flow", "left_semi").groupBy("name").agg(F.count_distinct("flow").alias("flows")).where(F.col("flows") >= least)


def packet_profile(rows: DataFrame, chunk: int = 128) -> DataFrame:
    """TOK02: each flow's best peer in its chunk of `chunk` flows in time order, by the multiset overlap of lengths by
    direction over its packets (ties to the earlier flow). The chunk bounds every group."""
    placed = peer_chunks(rows, chunk)
    h = rows.groupBy("flow", "dir", "len").agg(F.count("*").alias("c")).join(placed.select("flow", "pos", "chunk"), "flow")
    names = placed.select("flow", "n", "pos")
    best = shared_peers(h).join(names, "pos").select("flow", "n", F.col("peer").alias("pos"), F.col("s").alias("overlap"))
    return best.join(names.select("pos", F.col("flow").alias("peer")), "pos").select("flow", "peer", "overlap", (F.col("overlap") / F.col("n")).alias("share"))


def context_tokens(ctx: DataFrame) -> DataFrame:
    """WIN02: tokens of a service context row: heat, share of short flows in tenths, gap bin."""
    heat = F.concat(F.lit("SVC_HEAT_"), S.log_bin(F.col("recent_count")))
    short = F.when(F.col("recent_count") > 0, F.concat(F.lit("SVC_SHORT_"), S.ratio_bin(F.col("short_ratio"))))
    gap = F.when(F.col("last_gap").isNotNull(), F.concat(F.lit("SVC_GAP_"), S.iat_bin(F.col("last_gap"))))
    return ctx.select("flow_id", F.explode(F.filter(F.array(heat, short, gap), lambda t: t.isNotNull())).alias("token"))


def paragraph_tokens(windows: DataFrame, tokens: DataFrame, most: int, sep: str = "[SEP]") -> DataFrame:
    """WIN07: tokens of a window's flows in order, `sep` after each flow, cut at `most` with sep kept last."""
    by = tokens.groupBy("flow_id").agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("t")).select("flow_id", F.concat(F.transform("t", lambda x: x["token"]), F.array(F.lit(sep))).alias("t"))
    rows = windows.join(by, "flow_id").groupBy("window").agg(F.sort_array(F.collect_list(F.struct("i", "t"))).alias("p"))
    flat = F.flatten(F.transform("p", lambda x: x["t"]))
    cut = F.when(F.size(flat) > most, F.concat(F.slice(flat, 1, most - 1), F.array(F.lit(sep)))).otherwise(flat)
    return rows.select("window", cut.alias("tokens"))
