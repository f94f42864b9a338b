"""Profiles of flows, alone and against peers in bounded chunks, and the behaviour tokens of flows.

Input are packet rows (flow, ts, seq, len, dir). Items come in long form, a row an item with its place `idx`; tokens of a
flow are joined only at the end, from a bounded number of packets.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S

from .flows import burst_tags, bursts
from .staging import running, staged
from .tokens import fit_vocab, token_stats, unk_rate

#: Tokens of the profile kinds.
PROFILE_TOKENS = {
    "SHORT": "PRIM_PROFILE_SHORT_FLOW", "SAME": "PRIM_PROFILE_SAME_LEN", "PKT": "PRIM_PROFILE_PKT_DIST", "LOCAL": "PRIM_PROFILE_LOCAL_SIM",
    "REPEAT": "PRIM_PROFILE_REPEAT_SEG", "DUP": "PRIM_PROFILE_DUP_SEG", "NONE": "PRIM_PROFILE_NONE",
}
MODES = ("none", "packet", "summary", "full")


def _order() -> Window:
    return Window.partitionBy("flow").orderBy("ts", "seq")


def side(c: Column) -> Column:
    """C2S or S2C of a direction."""
    return F.when(c == 1, "C2S").otherwise("S2C")


def numbered(kind: str, *parts: Column) -> Column:
    return F.concat_ws("_", F.lit(kind), *[p.cast("string") for p in parts])


#: Histogram rows and places of segments that one group of a chunk holds about, and lengths that are columns at a time.
GROUP_ROWS, GROUP_SEGS, COLUMNS = 1 << 18, 1024, 4096


def peer_chunks(rows: DataFrame, chunk: int = 128) -> DataFrame:
    """(flow, n, pos, chunk, peers): flows in order of (start, flow), `chunk` of them together, with their number. Positions are
    running counts over range partitions, so no task sorts all flows."""
    flows = rows.groupBy("flow").agg(F.min("ts").alias("t"), F.count("*").alias("n"))
    at = running(flows, [], ["t", "flow"], {"pos": F.lit(1).cast("bigint")}).select("flow", "n", (F.col("pos") - 1).alias("pos"))
    return staged(at.withColumn("chunk", F.floor(F.col("pos") / chunk)).withColumn("peers", F.count("*").over(Window.partitionBy("chunk"))), "peers")


def _best_peers(found: DataFrame, *by: str) -> DataFrame:
    """(*by, peer): of scores (*by, peer, s) in parts, the peer of the largest sum, ties to the earlier."""
    total = found.groupBy(*by, "peer").agg(F.sum("s").alias("s"))
    return total.groupBy(*by).agg(F.min(F.struct((-F.col("s")).alias("s"), "peer")).alias("m")).select(*by, F.col("m.peer").alias("peer"), (-F.col("m.s")).alias("s"))


def _pairs(scores: np.ndarray, met: np.ndarray, pos: np.ndarray, whole: bool) -> pd.DataFrame:
    """(pos, peer, s) of the pairs that met; only the best peer of each flow if no other part adds to the scores."""
    np.fill_diagonal(met, False)
    if whole:
        top = np.where(met, scores, -1).argmax(1)  # the first of equal ones, so the earlier peer
        keep = np.zeros_like(met)
        keep[np.arange(len(pos)), top] = True
        met = met & keep
    i, j = np.nonzero(met)
    return pd.DataFrame({"pos": pos[i], "peer": pos[j], "s": scores[i, j]})


def shared_peers(h: DataFrame, *by: str) -> DataFrame:
    """(pos, *by, peer, s): of histograms (pos, chunk, dir, len, c) each flow's peer in its chunk, by what `by` names (dir) or in all, that it
    shares most packets of equal direction and length with. A chunk is one group, or, if long, several by hash of length; its pairs
    of flows are a matrix, so no pair of rows is shuffled."""
    parts = F.ceil(F.count("*").over(Window.partitionBy("chunk")) / GROUP_ROWS)
    dealt = h.where("dir IS NOT NULL AND len IS NOT NULL").select("pos", "chunk", "dir", F.col("len").cast("long").alias("len"), "c", parts.alias("parts"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("len"), F.col("parts")))

    def overlaps(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for d, g in group.groupby("dir") if by else [(0, group)]:
            pos, i = np.unique(g["pos"].to_numpy(), return_inverse=True)
            code = g.groupby(["dir", "len"], sort=False).ngroup().to_numpy()
            order = np.argsort(code, kind="stable")
            code, i, c = code[order], i[order], g["c"].to_numpy()[order]
            scores, met = np.zeros((len(pos), len(pos)), np.int64), np.zeros((len(pos), len(pos)), bool)
            step = max(1, COLUMNS // len(pos))
            for low in range(0, code[-1] + 1, step):
                a, b = np.searchsorted(code, [low, low + step])
                x = np.zeros((len(pos), step), np.int64)
                x[i[a:b], code[a:b] - low] = c[a:b]
                scores += np.minimum(x[:, None, :], x[None, :, :]).sum(2)
            met = scores > 0
            out.append(_pairs(scores, met, pos, group["parts"].iloc[0] == 1).assign(dir=d))
        return pd.concat(out)

    found = dealt.groupBy("chunk", "part").applyInPandas(overlaps, "pos long, peer long, s long, dir int")
    return _best_peers(found, "pos", *by)


def flow_segments(rows: DataFrame) -> DataFrame:
    """(flow, seg, dir, lens): runs of one direction, numbered from 0, with their lengths in order."""
    new = (F.coalesce(F.lag("dir").over(_order()), F.lit(-1)) != F.col("dir")).cast("int")
    at = rows.withColumn("new", new).withColumn("seg", F.sum("new").over(_order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    lens = F.transform(F.sort_array(F.collect_list(F.struct("ts", "seq", "len"))), lambda x: x["len"])
    return at.groupBy("flow", "seg").agg(F.max("dir").alias("dir"), lens.alias("lens"))


def repeat_items(rows: DataFrame, zero: int = 6, least: int = 2, segments: DataFrame | None = None) -> DataFrame:
    """TOK01 REPEAT: (flow, idx, length, count): lengths of which whole segments of over one packet consist, most first."""
    segs = (segments or flow_segments(rows)).where((F.size("lens") > 1) & (F.array_min("lens") == F.array_max("lens")))
    by = segs.groupBy("flow", F.array_min("lens").alias("length")).agg(F.sum(F.size("lens")).alias("count"), F.min("seg").alias("first"))
    kept = by.where(F.col("count") >= F.when(F.col("length") == 0, zero).otherwise(least))
    return kept.select("flow", (F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("count"), "first")) - 1).alias("idx"), "length", "count")


def duplicate_items(rows: DataFrame, least: int = 2, segments: DataFrame | None = None) -> DataFrame:
    """TOK01 DUP: (flow, idx, left, right, count): pairs of a segment's and its predecessor's sets of lengths that come
    `least` times, most first; pairs of empty packets alone do not count."""
    w = Window.partitionBy("flow").orderBy("seg")
    sets = (segments or flow_segments(rows)).withColumn("left", F.array_sort(F.array_distinct("lens"))).withColumn("right", F.lag("left").over(w))
    by = sets.where("right IS NOT NULL").groupBy("flow", "left", "right").agg(F.count("*").alias("count"), F.min("seg").alias("first"))
    empty = (F.size("left") == 1) & (F.size("right") == 1) & (F.col("left")[0] == 0) & (F.col("right")[0] == 0)
    kept = by.where((F.col("count") >= least) & ~empty)
    return kept.select("flow", (F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("count"), "first")) - 1).alias("idx"), "left", "right", "count")


def packet_items(rows: DataFrame, chunk: int = 128, most: int = 12, placed: DataFrame | None = None) -> DataFrame:
    """TOK02: (flow, idx, dir, length, count): by direction, the lengths that a flow shares with the peer of its chunk that it
    shares most packets with (ties to the earlier peer); alone in its chunk, its own lengths. `most` a direction and in all."""
    at = rows.withColumn("i", F.row_number().over(_order()))
    placed = placed or peer_chunks(rows, chunk)
    h = staged(at.groupBy("flow", "dir", "len").agg(F.count("*").alias("c"), F.min("i").alias("first")).join(placed.select("flow", "pos", "chunk", "peers"), "flow"), "histograms")
    theirs = shared_peers(h, "dir").select("pos", "dir", "peer").join(h.select(F.col("pos").alias("peer"), "dir", "len", F.col("c").alias("theirs")), ["peer", "dir"])
    shared = h.join(theirs.drop("peer"), ["pos", "dir", "len"]).select("flow", "dir", "len", "first", F.least("c", "theirs").alias("c"))
    items = shared.unionByName(h.where("peers = 1").select("flow", "dir", "len", "first", "c"))
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("flow", "dir").orderBy(F.desc("c"), "first"))).where(F.col("r") <= most)
    idx = F.row_number().over(Window.partitionBy("flow").orderBy(F.desc("dir"), "r")) - 1
    return ranked.withColumn("idx", idx).where(F.col("idx") < most).select("flow", "idx", side(F.col("dir")).alias("dir"), F.col("len").alias("length"), F.col("c").alias("count"))


def similar_peers(segs: DataFrame) -> DataFrame:
    """(pos, peer, s): of segments (pos, chunk, seg, lens, later) each flow's peer in its chunk with the most hits of `local_items`. Up to
    GROUP_SEGS places of a chunk are one group; at a place the hits of all pairs are a matrix product of how often each flow
    has a length and which lengths each peer has, so no pair of segments is shuffled."""
    blocks = F.floor(F.max("seg").over(Window.partitionBy("chunk")) / GROUP_SEGS) + 1
    dealt = segs.select("pos", "chunk", "seg", "lens", "later", blocks.alias("parts"), F.floor(F.col("seg") / GROUP_SEGS).alias("part"))

    def hits(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["seg", "pos"], kind="stable")
        pos, at = np.unique(group["pos"].to_numpy(), return_inverse=True)
        own, later = ([np.asarray(x, float) for x in group[c]] for c in ("lens", "later"))
        size = np.array([len(x) for x in own])
        sums = np.array([x.sum() for x in own])  # no sum where a length is null
        known: dict[bytes, int] = {}
        same = np.array([known.setdefault(x.tobytes(), len(known)) for x in own])
        flat, codes = np.unique(np.concatenate([*own, *later]), return_inverse=True)
        valid, n = ~np.isnan(flat), size.sum()
        code, after = codes[:n], codes[n:]
        start, start_after = (np.concatenate([[0], np.cumsum([len(x) for x in xs])]) for xs in (own, later))
        edges = np.flatnonzero(np.diff(group["seg"].to_numpy(), prepend=-1, append=-1))
        scores, met = np.zeros((len(pos), len(pos)), np.int64), np.zeros((len(pos), len(pos)), bool)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows = np.arange(high - low)
            i, x = np.repeat(rows, size[low:high]), code[start[low] : start[high]]
            j = np.repeat(rows, np.diff(start_after[low : high + 1]))
            y = after[start_after[low] : start_after[high]]
            used = np.unique(x[valid[x]])
            found = np.zeros((len(rows), len(rows)))
            for first in range(0, len(used), COLUMNS):
                some = used[first : first + COLUMNS]
                have, held = np.zeros((len(rows), len(some))), np.zeros((len(rows), len(some)))
                for a, b, out, add in ((i, x, have, True), (i, x, held, False), (j, y, held, False)):
                    spot = np.minimum(np.searchsorted(some, b), len(some) - 1)
                    ok = some[spot] == b
                    np.add.at(out, (a[ok], spot[ok]), 1) if add else out.__setitem__((a[ok], spot[ok]), 1)
                found += have @ held.T
            total, lists = sums[low:high], same[low:high]
            whole = (np.abs(total[:, None] - total[None, :]) <= 1) | (lists[:, None] == lists[None, :])
            spots = np.ix_(at[low:high], at[low:high])
            scores[spots] += np.where(whole, size[low:high, None], found).astype(np.int64)
            met[spots] = True
        return _pairs(scores, met, pos, group["parts"].iloc[0] == 1)

    return _best_peers(dealt.groupBy("chunk", "part").applyInPandas(hits, "pos long, peer long, s long"), "pos")


def local_items(rows: DataFrame, chunk: int = 128, most: int = 8, placed: DataFrame | None = None, segments: DataFrame | None = None) -> DataFrame:
    """TOK03: (flow, idx, seg, dir, match, lens): a flow's segments against those at the same place of the best peer in its
    chunk (ties to the earlier peer). EXACT: equal lengths; SUM: sums within 1; else the lengths that the peer's segment
    (FUZZY) or also its next but one (SHIFT2) has; SINGLE: alone in its chunk. Segments without a match leave no item."""
    w = Window.partitionBy("flow").orderBy("seg")
    placed = (placed or peer_chunks(rows, chunk)).select("flow", "pos", "chunk", "peers")
    later = F.coalesce(F.lead("lens", 2).over(w), F.expr("slice(lens, 1, 0)"))
    segs = staged((segments or flow_segments(rows)).withColumn("later", later).join(placed, "flow"), "segments")
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    theirs = segs.select(F.col("pos").alias("peer"), "seg", F.col("lens").alias("theirs"), "later")
    found = segs.drop("later").join(similar_peers(segs).select("pos", "peer"), "pos").join(theirs, ["peer", "seg"])
    whole = F.when(F.col("lens") == F.col("theirs"), "EXACT").when(F.abs(total(F.col("lens")) - total(F.col("theirs"))) <= 1, "SUM")
    hits = F.filter("lens", lambda x: F.array_contains("theirs", x) | F.array_contains("later", x))
    shifted = F.exists("lens", lambda x: ~F.array_contains("theirs", x) & F.array_contains("later", x))
    own = found.select("flow", "seg", "dir", F.coalesce(whole, F.when(shifted, "SHIFT2").otherwise("FUZZY")).alias("match"), F.when(whole.isNotNull(), F.col("lens")).otherwise(hits).alias("hits"))
    own = own.unionByName(segs.where("peers = 1").select("flow", "seg", "dir", F.lit("SINGLE").alias("match"), F.col("lens").alias("hits")))
    kept = own.where(F.size("hits") > 0).withColumn("idx", F.row_number().over(w) - 1).where(F.col("idx") < most)
    return kept.select("flow", "idx", "seg", side(F.col("dir")).alias("dir"), "match", F.slice("hits", 1, 6).alias("lens"))


def rhythm(n: Column, c2s: Column, short: Column, periodic: Column) -> Column:
    """SCA26: a flow's rhythm from its packets, those from the client, and whether its profile is short or repeats; the first rule that fits."""
    s2c = n - c2s
    out = F.when(short, "RHY_SHORT").when(periodic, "RHY_PERIODIC").when((n > 0) & (c2s / n > 0.85), "RHY_CLIENT_BURST").when((s2c > 3 * c2s) & (c2s <= 3), "RHY_REQ_LONGRESP")
    return out.when((n <= 8) & (c2s >= s2c), "RHY_SCAN_LIKE").when((n > 3) & (F.abs(c2s - s2c) <= F.greatest(F.lit(2.0), 0.2 * n)), "RHY_INTERACTIVE").otherwise("RHY_GENERIC")


def _len_bins(lens: str, most: int) -> Column:
    return F.transform(F.slice(lens, 1, most), lambda x: F.concat(F.lit("PKT_LEN_"), S.log_bin(x)))


def profile_items(rows: DataFrame, chunk: int = 128) -> dict[str, DataFrame]:
    """The items of all kinds, staged, as tokens, tags and rhythm all read them."""
    placed, segments = peer_chunks(rows, chunk), staged(flow_segments(rows), "flow-segments")
    made = {"packet": packet_items(rows, chunk, placed=placed), "local": local_items(rows, chunk, placed=placed, segments=segments), "repeat": repeat_items(rows, segments=segments), "dup": duplicate_items(rows, segments=segments)}
    return {kind: staged(df, "items") for kind, df in made.items()}


def profile_tokens(rows: DataFrame, items: dict[str, DataFrame], short: int = 6) -> DataFrame:
    """(flow, sect, idx, tokens): the tokens of each profile item of a flow, in the order of the kinds."""
    token, count = (lambda k: F.lit(PROFILE_TOKENS[k])), F.concat(F.lit("FLOW_COUNT_"), S.log_bin(F.col("count")))
    length = F.concat(F.lit("PKT_LEN_"), S.log_bin(F.col("length")))
    by = rows.groupBy("flow").agg(F.count("*").alias("count"), F.min("len").alias("length"), F.max("len").alias("top"))
    parts = [
        by.where(F.col("count") < short).select("flow", F.lit(0).alias("idx"), F.array(token("SHORT"), count).alias("tokens")),
        by.where("length = top").select("flow", F.lit(0).alias("idx"), F.array(token("SAME"), length, count).alias("tokens")),
        items["packet"].where("idx < 8").select("flow", "idx", F.array(token("PKT"), F.concat(F.lit("PKT_DIR_"), "dir"), length, count).alias("tokens")),
        items["local"].where("idx < 4").select("flow", "idx", F.concat(F.array(token("LOCAL"), F.concat(F.lit("PKT_DIR_"), "dir"), F.concat(F.lit("MATCH_"), "match")), _len_bins("lens", 4)).alias("tokens")),
        items["repeat"].where("idx < 4").select("flow", "idx", F.array(token("REPEAT"), length, count).alias("tokens")),
        items["dup"].where("idx < 4").select("flow", "idx", F.concat(F.array(token("DUP"), count), _len_bins("left", 2), _len_bins("right", 2)).alias("tokens")),
    ]
    out = None
    for sect, part in enumerate(parts):
        one = part.select("flow", F.lit(sect).alias("sect"), F.col("idx").cast("int").alias("idx"), "tokens")
        out = one if out is None else out.unionByName(one)
    return out


def position_facts(rows: DataFrame, items: dict[str, DataFrame]) -> DataFrame:
    """Packet rows with `i` (from 0), `n` and what decides their kind: `same`, `repeat`, `packet`, `local` and `twice`."""
    flows = rows.groupBy("flow").agg(F.count("*").alias("n"), (F.min("len") == F.max("len")).alias("same"))
    repeat = items["repeat"].select("flow", F.col("length").alias("len"), F.lit(True).alias("repeat"))
    packet = items["packet"].select("flow", F.col("length").alias("len"), F.lit(True).alias("packet")).distinct()
    local = items["local"].select("flow", F.lit(True).alias("local")).distinct()
    twice = items["dup"].select("flow", F.lit(True).alias("twice")).distinct()
    return rows.withColumn("i", F.row_number().over(_order()) - 1).join(flows, "flow").join(repeat, ["flow", "len"], "left").join(packet, ["flow", "len"], "left").join(local, "flow", "left").join(twice, "flow", "left")


def position_tags(rows: DataFrame, items: dict[str, DataFrame], short: int = 6, facts: DataFrame | None = None) -> DataFrame:
    """Packet rows with `i` (from 0), `n` and the profile kind that each packet carries: SHORT for all of a short flow; else
    REPEAT by length, SAME, PKT by length; LOCAL at the first and DUP at the last packet that has none, if the flow has such an item."""
    at = facts or position_facts(rows, items)
    base = F.when(F.col("n") < short, "SHORT").when(F.col("repeat"), "REPEAT").when(F.col("same"), "SAME").when(F.col("packet"), "PKT").otherwise("NONE")
    none = Window.partitionBy("flow", "base")
    at = at.withColumn("base", base).withColumns({"up": F.row_number().over(none.orderBy("i")), "down": F.row_number().over(none.orderBy(F.desc("i")))})
    free = F.col("base") == "NONE"
    first = free & F.coalesce("local", F.lit(False)) & (F.col("up") == 1)
    last = free & F.coalesce("twice", F.lit(False)) & (F.col("down") == 1)
    return at.withColumn("tag", F.when(first, "LOCAL").when(last, "DUP").otherwise(F.col("base"))).select(*rows.columns, "i", "n", "tag")


def packet_gaps(rows: DataFrame, gap: float) -> DataFrame:
    """Packet rows with their place in a burst and the time since the packet before."""
    return burst_tags(rows, gap).withColumn("iat", F.coalesce(F.col("ts") - F.lag("ts").over(_order()), F.lit(0.0)))


def flow_facts(rows: DataFrame, gap: float) -> DataFrame:
    """(flow, n, took, c2s, bursts)."""
    return rows.groupBy("flow").agg(F.count("*").alias("n"), (F.max("ts") - F.min("ts")).alias("took"), F.sum("dir").alias("c2s")).join(bursts(rows, gap).groupBy("flow").agg(F.count("*").alias("bursts")), "flow")


def flow_parts(rows: DataFrame, gap: float = 0.1, chunk: int = 128) -> dict:
    """What `flow_tokens` makes of rows whatever `short` is, staged: profile items, facts of packets, gaps and facts of flows."""
    items = profile_items(rows, chunk)
    made = {"facts": position_facts(rows, items), "gaps": packet_gaps(rows, gap), "flows": flow_facts(rows, gap)}
    return {"items": items} | {name: staged(df, name) for name, df in made.items()}


def flow_tokens(rows: DataFrame, profile: str = "full", max_packets: int = 96, max_len: int = 256, gap: float = 0.1, chunk: int = 128, short: int = 6, blocks: tuple[DataFrame, ...] = (), parts: dict | None = None) -> DataFrame:
    """TOK04: (flow, tokens, raw_tokens, truncated): [CLS], flow summary and rhythm, the optional blocks (flow, tokens) in
    their order, profile items (summary, full), per packet direction, length, gap and burst place (packet, full: and profile
    kind), [SEP]; cut at max_len.

    Of more than max_packets packets the first half and last quarter of that number stay, then those with a profile kind.
    `parts` are the `flow_parts` of these rows, gap and chunk, if several settings share them.
    """
    if profile not in MODES:
        raise ValueError(f"unknown profile mode {profile}")
    items = parts["items"] if parts else profile_items(rows, chunk) if profile != "none" else {}
    tagged = position_tags(rows, items, short, parts and parts["facts"]) if profile in ("packet", "full") else rows.withColumns({"i": F.row_number().over(_order()) - 1, "n": F.count("*").over(Window.partitionBy("flow")), "tag": F.lit("NONE")})
    head, tail = max_packets // 2, max_packets // 4
    core = (F.col("n") <= max_packets) | (F.col("i") < head) | (F.col("i") >= F.greatest(F.lit(head), F.col("n") - tail))
    extra = ~core & (F.col("tag") != "NONE")
    ranked = tagged.withColumns({"core": core, "extra": extra}).withColumn("nth", F.row_number().over(Window.partitionBy("flow", "extra").orderBy("i")))
    room = max_packets - head - F.least(F.lit(tail), F.col("n") - head)
    picked = ranked.where(F.col("core") | (F.col("extra") & (F.col("nth") <= room))).select("flow", "seq", "i", "tag")
    gaps = parts["gaps"] if parts else packet_gaps(rows, gap)
    each = [F.concat(F.lit("PKT_DIR_"), side(F.col("dir"))), F.concat(F.lit("PKT_LEN_"), S.log_bin(F.col("len"))), F.concat(F.lit("PKT_IAT_"), S.iat_bin(F.col("iat"))), F.concat(F.lit("BURST_"), "b.tag")]
    if profile in ("packet", "full"):
        each.append(F.element_at(F.create_map(*[F.lit(x) for k in PROFILE_TOKENS.items() for x in k]), F.col("p.tag")))
    packets = gaps.alias("b").join(picked.alias("p"), ["flow", "seq"]).select("flow", "i", F.array(*each).alias("t"))
    flat = lambda *order: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: x[order[-1]]))
    body = packets.groupBy("flow").agg(flat("i", "t").alias("packets"))
    summary = profile_tokens(rows, items, short).groupBy("flow").agg(flat("sect", "idx", "tokens").alias("summary")) if profile in ("summary", "full") else None
    facts = parts["flows"] if parts else flow_facts(rows, gap)
    if profile == "none":
        facts = facts.withColumns({"is_short": F.lit(False), "periodic": F.lit(False)})
    else:
        again = items["repeat"].select("flow").unionByName(items["dup"].select("flow")).distinct().withColumn("periodic", F.lit(True))
        facts = facts.join(again, "flow", "left").withColumns({"is_short": F.col("n") < short, "periodic": F.coalesce("periodic", F.lit(False))})
    start = F.array(
        F.lit("[CLS]"), numbered("FLOW_PKTN", S.log_bin(F.col("n"))), numbered("FLOW_DUR", S.log_bin(F.col("took") * 1000.0)), numbered("FLOW_BURSTN", S.log_bin(F.col("bursts"))),
        numbered("FLOW_DIR_RATIO", S.ratio_bin(F.col("c2s") / F.col("n"))), rhythm(F.col("n"), F.col("c2s"), F.col("is_short"), F.col("periodic")),
    )
    made = facts.select("flow", start.alias("start")).join(body, "flow")
    raw = [F.col("start")]
    for i, block in enumerate(blocks):
        made = made.join(block.select("flow", F.col("tokens").alias(f"block{i}")), "flow", "left")
        raw.append(F.coalesce(f"block{i}", F.array().cast("array<string>")))
    if summary is not None:
        made = made.join(summary, "flow", "left")
        raw.append(F.coalesce("summary", F.array().cast("array<string>")))
    return made.withColumn("raw", F.concat(*raw, F.col("packets"), F.array(F.lit("[SEP]")))).select("flow", F.slice("raw", 1, max_len).alias("tokens"), F.size("raw").alias("raw_tokens"), (F.size("raw") > max_len).alias("truncated"))


def shape_block(rows: DataFrame, gap: float = 0.1, most: int = 4) -> DataFrame:
    """TOK04 block, WIN14: (flow, tokens): nine tokens of each of the first most-1 bursts and the last: packets, duration, bytes by
    direction, main direction, median gap inside, gap to the next burst, mean and spread of length."""
    new = F.lag("dir").over(_order()).isNull() | (F.lag("dir").over(_order()) != F.col("dir")) | (F.col("ts") - F.lag("ts").over(_order()) > gap)
    at = rows.withColumns({"new": new, "iat": F.col("ts") - F.lag("ts").over(_order())}).withColumn("burst", F.sum(F.col("new").cast("int")).over(_order().rowsBetween(Window.unboundedPreceding, 0)))
    up = lambda d: F.sum(F.when(F.col("dir") == d, F.col("len")).otherwise(0))
    b = at.groupBy("flow", "burst").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"), up(1).alias("c2s"), up(0).alias("s2c"), F.percentile(F.when(~F.col("new"), F.col("iat")), F.lit(0.5)).alias("med"), F.avg("len").alias("mean"), F.stddev_pop("len").alias("std"))
    w = Window.partitionBy("flow")
    b = b.withColumns({"bursts": F.count("*").over(w), "next": F.lead("start").over(w.orderBy("burst"))}).where((F.col("burst") < most) | (F.col("burst") == F.col("bursts")))
    tokens = F.array(
        numbered("BURST_PKTN", S.log_bin(F.col("n"))), numbered("BURST_DUR", S.log_bin((F.col("end") - F.col("start")) * 1000.0)), numbered("BURST_BYTES_C2S", S.log_bin(F.col("c2s"))), numbered("BURST_BYTES_S2C", S.log_bin(F.col("s2c"))),
        F.when(F.col("c2s") >= F.col("s2c"), "BURST_DIR_C2S").otherwise("BURST_DIR_S2C"), numbered("BURST_IAT_MED", S.iat_bin(F.coalesce("med", F.lit(0.0)))), numbered("BURST_GAP_NEXT", S.iat_bin(F.coalesce(F.col("next") - F.col("end"), F.lit(0.0)))),
        numbered("BURST_LEN_MEAN", S.log_bin(F.col("mean"))), numbered("BURST_LEN_STD", S.log_bin(F.col("std"))),
    )
    return b.groupBy("flow").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("burst", tokens.alias("t")))), lambda x: x["t"])).alias("tokens"))


def signature_block(rows: DataFrame, k: int = 3) -> DataFrame:
    """TOK04 block, WIN16: (flow, tokens): direction pattern, length bins and gap pattern (Z, S, M, L by bin) of the first k packets."""
    at = rows.withColumns({"i": F.row_number().over(_order()), "iat": F.col("ts") - F.lag("ts").over(_order())}).where(F.col("i") <= k)
    code = S.iat_bin(F.coalesce("iat", F.lit(0.0)))
    letter = F.when(code == 0, "Z").when(code <= 4, "S").when(code <= 8, "M").otherwise("L")
    by = at.groupBy("flow").agg(F.sort_array(F.collect_list(F.struct("i", F.when(F.col("dir") == 1, "C").otherwise("S").alias("d"), S.log_bin(F.col("len")).alias("b"), letter.alias("g")))).alias("p"))
    gaps = F.array_join(F.transform(F.slice("p", 2, k), lambda x: x["g"]), "")
    bins = F.transform("p", lambda x: F.concat_ws("_", F.lit("FIRST_LEN_BIN"), x["i"].cast("string"), x["b"].cast("string")))
    dirs = F.concat(F.lit("FIRST_DIR_PATTERN_"), F.array_join(F.transform("p", lambda x: x["d"]), ""))
    return by.select("flow", F.concat(F.array(dirs), bins, F.array(F.concat(F.lit("FIRST_IAT_PATTERN_"), F.when(gaps == "", "EMPTY").otherwise(gaps)))).alias("tokens"))


def service_block(flows: DataFrame) -> DataFrame:
    """TOK04 block, SCA25: (flow, tokens): protocol, port class, port bin, application and state of flows (flow, protocol, dst_port, appinfo, state)."""
    port = S.to_int(F.col("dst_port"), 0)
    return flows.select("flow", F.array(F.concat(F.lit("PROTO_"), S.norm_protocol(F.col("protocol"), "token")), S.port_class(F.col("dst_port")), numbered("DPORT", S.log_bin(F.greatest(port, F.lit(0)))), S.app_token(F.col("appinfo")), S.state_token(F.col("state"))).alias("tokens"))


def attach_profile(flows: DataFrame, profile: DataFrame) -> DataFrame:
    """JOI11: flows with the columns of their profile row; a flow without one gets false, 0 and empty arrays by type."""
    plain = {"boolean": F.lit(False), "int": F.lit(0), "bigint": F.lit(0).cast("bigint"), "double": F.lit(0.0)}
    cols = [(c, plain.get(t, F.array().cast(t) if t.startswith("array") else F.lit(None).cast(t))) for c, t in profile.dtypes if c != "flow"]
    return flows.join(profile, "flow", "left").select(*[F.col(f"`{c}`") for c in flows.columns], *[F.coalesce(F.col(c), d).alias(c) for c, d in cols])


def behaviour_corpus(tokens: DataFrame, splits: DataFrame, max_len: int = 256) -> tuple[DataFrame, DataFrame, DataFrame]:
    """TOK05: of flow_tokens() and splits (flow, split, label): the long corpus (flow_id, split, label, pos, token), the vocabulary of
    its train rows, and by split the flows, lengths, share of unknown tokens and of flows cut short. Flows without a split go."""
    rows = tokens.join(splits, "flow").persist()  # corpus, vocabulary and statistics all read it
    corpus = rows.select(F.col("flow").alias("flow_id"), "split", "label", F.posexplode("tokens").alias("pos", "token"))
    vocab = fit_vocab(corpus, ("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]"))
    cut = rows.groupBy("split").agg(F.avg(F.col("truncated").cast("double")).alias("cut"), F.max("raw_tokens").alias("longest"))
    stats = token_stats(corpus, max_len).drop("truncated").join(unk_rate(corpus, vocab), "split").join(cut, "split")
    return corpus, vocab, stats


def token_statistics(tokens: DataFrame) -> DataFrame:
    """TOK08: of flows (flow, tokens, packet_count) the statistics that tokens and counts give; the other of the 26 named ones are 0,
    as no raw packet is at hand. Counts are of tokens that begin so; specials do not count as active."""
    active = F.filter("tokens", lambda t: ~t.isin("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]"))
    starts = lambda *names: F.size(F.filter(active, lambda t: F.greatest(*[t.startswith(n) for n in names], F.lit(False)))).cast("double")
    n, same = F.coalesce("packet_count", F.lit(0)).cast("double"), starts("PRIM_PROFILE_SAME_LEN")
    repeat, twice = starts("PRIM_PROFILE_REPEAT_SEG", "RHY_PERIODIC"), starts("PRIM_PROFILE_DUP_SEG")
    known = {
        "packet_count": n, "token_count": F.size("tokens").cast("double"), "active_token_count": F.size(active).cast("double"), "burst_count": starts("BURST_START", "BURST_SINGLE"), "short_flow_flag": ((n > 0) & (n < 6)).cast("double"),
        "same_length_flag": (same > 0).cast("double"), "repeat_count": repeat, "duplicate_count": twice, "profile_short_count": starts("PRIM_PROFILE_SHORT_FLOW", "RHY_SHORT"), "profile_same_count": same, "profile_repeat_count": repeat, "profile_duplicate_count": twice,
    }
    return tokens.select("flow", *[known.get(name, F.lit(0.0)).alias(name) for name in STAT_NAMES])


#: Names of the token statistics.
STAT_NAMES = (
    "flow_duration", "packet_count", "byte_count", "token_count", "active_token_count", "c2s_packet_count", "s2c_packet_count", "c2s_s2c_packet_ratio", "mean_packet_length", "std_packet_length", "min_packet_length", "max_packet_length",
    "iat_mean", "iat_std", "iat_quantile_25", "iat_quantile_50", "iat_quantile_75", "burst_count", "short_flow_flag", "same_length_flag", "repeat_count", "duplicate_count", "profile_short_count", "profile_same_count", "profile_repeat_count", "profile_duplicate_count",
)
