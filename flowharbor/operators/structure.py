"""Structural primitives of flows (WIN17): triggers of seven families from packet and burst events.

packets: (flow, i, pos, dir, len, iat), i from 0, pos the place in the flow's tokens, dir C2S or S2C, len and iat as bins.
bursts: (flow, b, pos, dir, pktn, len_mean, gap_next, c2s, s2c), all but pos and dir as bins; dir, len_mean and gap_next may be null.
`token_events` reads both from tokens, `events` makes them from packet rows. Every rule is a filter over windows or sums of one
flow; what fires is counted in the end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S

from .flows import burst_tags
from .profiles import side


@dataclass(frozen=True)
class Limits:
    """Bins that count as small, low and high, the jump that counts as a spike, the triggers kept of a family and the families
    wanted: composites and positions build on what the wanted families fire."""

    ngrams: tuple[int, ...] = (2, 3)
    small: int = 6
    low_iat: int = 2
    high_iat: int = 10
    spike: int = 4
    per_family: int = 24
    families: tuple[str, ...] = ("packet_shape", "burst_shape", "timing_rhythm", "direction_transition", "composite", "position_aware", "parameterized")


#: How the names of triggers begin, and what position-aware names call them.
POSITION_NAMES = (
    ("PKT_DIR_LEN_NGRAM", "DIR_LEN_NGRAM"), ("PKT_C2S_SMALL_RUN", "C2S_SMALL_RUN"), ("PKT_S2C_SMALL_RUN", "S2C_SMALL_RUN"), ("PKT_SAME_LEN_RUN_C2S", "C2S_SAME_LEN_RUN"), ("PKT_SAME_LEN_RUN_S2C", "S2C_SAME_LEN_RUN"),
    ("PKT_LEN_SPIKE", "LEN_SPIKE"), ("PKT_LEN_RAMP_UP", "LEN_RAMP_UP"), ("PKT_LEN_RAMP_DOWN", "LEN_RAMP_DOWN"), ("IAT_BURSTY_THEN_IDLE", "BURSTY_THEN_IDLE"),
)


def run_bucket(n: Column) -> Column:
    """SCA30: 2, 3, 4, 8 or 16 by run length."""
    return F.when(n <= 2, 2).when(n == 3, 3).when(n <= 5, 4).when(n <= 8, 8).otherwise(16)


def bin_ge(n: Column, small: int, medium: int) -> Column:
    """SCA30: LE_small, small+1_medium or GE_medium+1."""
    return F.when(n <= small, f"LE_{small}").when(n <= medium, f"{small + 1}_{medium}").otherwise(f"GE_{medium + 1}")


def position_bucket(pos: Column, most: Column) -> Column:
    """SCA30: PREFIX, MIDDLE or TAIL by thirds of the flow's tokens."""
    share = pos / F.greatest(most, F.lit(1.0))
    return F.when(share < 1 / 3, "PREFIX").when(share < 2 / 3, "MIDDLE").otherwise("TAIL")


def struct_family(token: Column) -> Column:
    """SCA30: the family of a structural token's name."""
    rest = F.regexp_replace(token, "^PRIM_STRUCT_", "")
    return (
        F.when(~token.startswith("PRIM_STRUCT_"), "unknown").when(rest.startswith("BURST_INTERVAL_"), "timing_rhythm").when(rest.startswith("PKT_"), "packet_shape").when(rest.startswith("BURST_"), "burst_shape")
        .when(rest.rlike("^(IAT|FLOW)_"), "timing_rhythm").when(rest.startswith("DIR_"), "direction_transition").when(rest.startswith("COMP_"), "composite").when(rest.startswith("POS_"), "position_aware").when(rest.startswith("PARAM_"), "parameterized").otherwise("unknown")
    )


#: The fields of a burst's block of tokens and the names of its tokens before their number.
BURST_FIELDS = {"pktn": "BURST_PKTN_", "len_mean": "BURST_LEN_MEAN_", "gap_next": "BURST_GAP_NEXT_", "c2s": "BURST_BYTES_C2S_", "s2c": "BURST_BYTES_S2C_"}


def _number(token: Column, prefix: str) -> Column:
    """The whole number after `prefix`; 0 where there is none."""
    return F.coalesce(F.substring(token, len(prefix) + 1, 32).try_cast("int"), F.lit(0))


def token_events(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """WIN17: packet and burst events of flows' tokens (flow, pos, token), each at the place of its first token.

    A packet is a direction token right before a length and a gap token. A burst begins at its packet count and holds the
    BURST_ tokens up to the next count or any other token; of a field that comes twice the last one counts, an unknown
    number is 0. Null tokens and those of a null flow are no events; a flow without events has no row.
    """
    w = Window.partitionBy("flow").orderBy("pos")
    known = tokens.where("flow IS NOT NULL AND pos IS NOT NULL").select("flow", "pos", F.coalesce("token", F.lit("")).alias("token"))
    near = known.withColumns({f"t{k}": F.lead("token", k).over(w) for k in (1, 2)})
    heads = near.where(F.col("token").isin("PKT_DIR_C2S", "PKT_DIR_S2C") & F.col("t1").startswith("PKT_LEN_") & F.col("t2").startswith("PKT_IAT_"))
    packets = heads.select("flow", (F.row_number().over(w) - 1).alias("i"), "pos", F.substring("token", 9, 3).alias("dir"), _number(F.col("t1"), "PKT_LEN_").alias("len"), _number(F.col("t2"), "PKT_IAT_").alias("iat"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    starts, outside = F.col("token").startswith(BURST_FIELDS["pktn"]), ~F.col("token").startswith("BURST_")
    # tokens of a block share the number of blocks and of other tokens so far with the block's first token
    parts = known.withColumns({"block": F.sum(starts.cast("int")).over(upto), "others": F.sum(outside.cast("int")).over(upto)}).where(~outside & (F.col("block") > 0))
    last = lambda value, when: F.max_by(F.when(when, value), F.when(when, F.col("pos")))
    fields = [last(_number(F.col("token"), begin), F.col("token").startswith(begin)).alias(name) for name, begin in BURST_FIELDS.items()]
    way = F.col("token").isin("BURST_DIR_C2S", "BURST_DIR_S2C", "BURST_DIR_MIXED")
    blocks = parts.groupBy("flow", "block", "others").agg(F.min(F.when(starts, F.col("pos"))).alias("pos"), last(F.substring("token", 11, 5), way).alias("dir"), *fields).where("pos IS NOT NULL")
    bytes_ = [F.coalesce(c, F.lit(0)).alias(c) for c in ("c2s", "s2c")]
    return packets, blocks.select("flow", F.col("block").alias("b"), "pos", "dir", "pktn", "len_mean", "gap_next", *bytes_)


def events(rows: DataFrame, gap: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Packet and burst events of packet rows; places as if each packet had four tokens and each burst nine."""
    w = Window.partitionBy("flow").orderBy("ts", "seq")
    iat = F.coalesce(F.col("ts") - F.lag("ts").over(w), F.lit(0.0))
    at = burst_tags(rows, gap).withColumns({"i": F.row_number().over(w) - 1, "gap": iat, "new": F.col("tag").isin("START", "SINGLE").cast("int")})
    packets = at.select("flow", "i", (4 * F.col("i")).alias("pos"), side(F.col("dir")).alias("dir"), S.log_bin(F.col("len")).alias("len"), S.iat_bin(F.col("gap")).alias("iat"))
    b = at.withColumn("b", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    sums = b.groupBy("flow", "b").agg(F.max("dir").alias("d"), F.count("*").alias("n"), F.avg("len").alias("mean"), F.sum("len").alias("bytes"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    after = F.lead("start").over(Window.partitionBy("flow").orderBy("b")) - F.col("end")
    size = S.log_bin(F.col("bytes"))
    bursts = sums.select("flow", "b", (9 * F.col("b")).alias("pos"), side(F.col("d")).alias("dir"), S.log_bin(F.col("n")).alias("pktn"), S.log_bin(F.col("mean")).alias("len_mean"), S.iat_bin(F.coalesce(after, F.lit(0.0))).alias("gap_next"), F.when(F.col("d") == 1, size).otherwise(0).alias("c2s"), F.when(F.col("d") == 1, 0).otherwise(size).alias("s2c"))
    return packets, bursts


def _fired(df: DataFrame, name: str | Column, family: str, pos: str | None = None, when: Column | None = None) -> DataFrame:
    rows = df if when is None else df.where(when)
    return rows.select("flow", F.concat(F.lit("PRIM_STRUCT_"), F.lit(name) if isinstance(name, str) else name).alias("name"), F.lit(family).alias("family"), (F.col(pos) if pos else F.lit(None)).cast("long").alias("pos"))


def triggers(packets: DataFrame, bursts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """WIN17: (flow, family, name, count, first_pos) of all seven families, at most per_family of a family by (-count, name)."""
    w = Window.partitionBy("flow").orderBy("i")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = {f"{c}{k}": F.lead(c, k).over(w) for c in ("dir", "len", "iat") for k in (1, 2, 3)}
    p = packets.withColumns({**ahead, "len_": F.lag("len").over(w), "dir_": F.lag("dir").over(w)})
    shape, out = "packet_shape", []
    for n in limits.ngrams:
        parts = [x for k in range(n) for x in ((F.col("dir") if not k else F.lead("dir", k).over(w)), F.concat(F.lit("L"), (F.col("len") if not k else F.lead("len", k).over(w)).cast("string")))]
        grams = packets.withColumns({"gram": F.concat_ws("_", F.lit("PKT_DIR_LEN_NGRAM"), *parts), "end": F.lead("i", n - 1).over(w)}).where("end IS NOT NULL")
        out.append(_fired(grams, F.col("gram"), shape, "pos"))
    # a run of small packets ends at a turn and at a larger packet; the larger packet begins a run that never counts
    changed = F.col("dir_").isNull() | (F.col("dir_") != F.col("dir"))
    runs = p.withColumn("run", F.sum((changed | (F.col("len") > limits.small)).cast("int")).over(upto)).groupBy("flow", "run").agg(F.min("i").alias("i"), F.min_by("pos", "i").alias("pos"), F.min_by("len", "i").alias("len"), F.first("dir").alias("dir"), F.count("*").alias("n"))
    runs = runs.withColumn("small", F.col("len") <= limits.small).withColumn("blocked", F.max((~F.col("small")).cast("int")).over(Window.partitionBy("flow").orderBy("run").rowsBetween(Window.unboundedPreceding, 0)))
    long_run = runs.where(F.col("small") & (F.col("n") >= 2))
    # packet triggers stop for good at the first run that begins with a larger packet, the longest-run parameter does not
    out.append(_fired(long_run.where("blocked = 0"), F.concat_ws("_", F.lit("PKT"), "dir", F.lit("SMALL_RUN"), run_bucket(F.col("n")).cast("string")), shape, "pos"))
    longest = long_run.groupBy("flow", "dir").agg(F.max("n").alias("n"))
    out.append(_fired(longest, F.concat_ws("_", F.lit("PARAM"), "dir", F.lit("SMALL_RUN_LEN"), bin_ge(F.col("n"), 3, 5)), "parameterized"))
    same = p.withColumn("run", F.sum((changed | (F.col("len_") != F.col("len"))).cast("int")).over(upto)).groupBy("flow", "run").agg(F.min("pos").alias("pos"), F.first("dir").alias("dir"), F.first("len").alias("len"), F.count("*").alias("n")).where("n >= 2")
    out.append(_fired(same, F.concat_ws("_", F.lit("PKT_SAME_LEN_RUN"), "dir", run_bucket(F.col("n")).cast("string"), F.concat(F.lit("L"), "len")), shape, "pos"))
    out.append(_fired(p, "PKT_LEN_SPIKE", shape, "pos", F.abs(F.col("len") - F.col("len_")) >= limits.spike))
    out.append(_fired(p, "PKT_LEN_RAMP_UP", shape, "pos", (F.col("len") < F.col("len1")) & (F.col("len1") < F.col("len2"))))
    out.append(_fired(p, "PKT_LEN_RAMP_DOWN", shape, "pos", (F.col("len") > F.col("len1")) & (F.col("len1") > F.col("len2"))))
    out.append(_fired(p, "IAT_BURSTY_THEN_IDLE", "timing_rhythm", "pos", (F.greatest("iat", "iat1", "iat2") <= limits.low_iat) & F.col("iat2").isNotNull() & (F.col("iat3") >= limits.high_iat)))

    f = _flow_facts(p, bursts, limits)
    rules: list[tuple] = []
    burst, timing, way, param = "burst_shape", "timing_rhythm", "direction_transition", "parameterized"
    b, n = F.col("b_dirs"), F.col("n")
    wanted = lambda family: F.lit(family in limits.families)
    for x, y in (("c2s", "s2c"), ("s2c", "c2s")):
        rules.append((f"BURST_SINGLE_DIR_DOMINANT_{x.upper()}", burst, (b > 0) & (F.col(f"b_{x}") / b >= 0.8)))
        rules.append((f"BURST_ASYM_BYTES_{x.upper()}", burst, F.col(f"bytes_{x}") >= F.col(f"bytes_{y}") + 4))
    pairs, dup = F.col("pairs"), (F.col("dup") > 0) & (F.col("b_dirs") > 0)
    rules += [
        ("BURST_REQ_RESP_PAIR", burst, pairs >= 1), (F.concat(F.lit("BURST_REQ_RESP_REPEAT_"), run_bucket(pairs).cast("string")), burst, pairs >= 2),
        ("BURST_ALT_FAST", burst, (b >= 4) & (F.col("b_turns") >= b - 2) & (F.col("low_gap") >= F.greatest(F.lit(1), F.floor(b / 2)))), ("BURST_TEMPLATE_DUP", burst, dup), ("BURST_SHORT_MANY", burst, F.col("short_bursts") >= 4),
    ]
    steady = (n >= 4) & (F.col("mode_n") / n >= 0.7)
    beacon, periodic = steady & (F.col("mode_iat") > 0), (F.col("gaps") >= 3) & (F.col("gap_mode_n") >= F.greatest(F.lit(2), F.col("gaps") - 1))
    rules += [
        ("IAT_LOW_VARIANCE", timing, steady), ("IAT_REGULAR_BEACON", timing, beacon), ("IAT_HEAVY_TAIL", timing, (n >= 4) & (F.col("iat_lo") <= limits.low_iat) & (F.col("iat_hi") >= limits.high_iat)),
        ("FLOW_SLOW_DRIP", timing, (n <= 8) & (F.col("high") >= 2)), ("BURST_INTERVAL_PERIODIC", timing, periodic),
    ]
    mono = F.col("up") == n
    one_turn = F.col("turns") == 1
    rules += [
        ("DIR_MONO_C2S", way, mono), ("DIR_SERVER_RESPONSE_ABSENT", way, mono), ("DIR_MONO_S2C", way, F.col("up") == 0), ("DIR_ALTERNATING", way, (n >= 4) & (F.col("turns") >= n - 2)),
        ("DIR_TWO_PHASE_C2S_THEN_S2C", way, one_turn & (F.col("first_dir") == "C2S"), F.col("first_turn")), ("DIR_TWO_PHASE_S2C_THEN_C2S", way, one_turn & (F.col("first_dir") == "S2C"), F.col("first_turn")),
    ]
    runs_by = runs.where("small AND n >= 2 AND blocked = 0").groupBy("flow").agg(F.lit(True).alias("any_small"), F.max(F.col("dir") == "C2S").alias("c2s_small"))
    same_by = same.where("dir = 'C2S'").select("flow", F.lit(True).alias("c2s_same")).distinct()
    idle = out[-1].select("flow", F.lit(True).alias("idle")).distinct()
    f = f.join(runs_by, "flow", "left").join(same_by, "flow", "left").join(idle, "flow", "left")
    has = lambda c: F.coalesce(F.col(c), F.lit(False)) & wanted(timing if c == "idle" else shape)
    comp, steady, beacon, periodic, dup, asked = "composite", steady & wanted(timing), beacon & wanted(timing), periodic & wanted(timing), dup & wanted(burst), pairs * wanted(burst).cast("int")
    rules += [
        ("COMP_FAST_C2S_SMALL_REPEAT", comp, has("c2s_small") & steady), ("COMP_DUP_BURST_LOW_IAT", comp, dup & (steady | periodic)), ("COMP_SHORT_FLOW_SAME_LEN_C2S", comp, mono & wanted(way) & has("c2s_same") & (n <= 6)),
        ("COMP_REQ_RESP_TEMPLATE_REPEAT", comp, (asked >= 1) & (dup | (asked >= 2))), ("COMP_LONG_IDLE_THEN_DUP", comp, has("idle") & dup), ("COMP_LOW_RATE_PERIODIC_SMALL_PKT", comp, beacon & has("any_small")),
    ]
    low, high = F.greatest(F.least("bytes_c2s", "bytes_s2c"), F.lit(1)), F.greatest("bytes_c2s", "bytes_s2c")
    cv = F.when(F.col("iat_mean") > 0, F.col("iat_std") / F.col("iat_mean")).otherwise(0.0)
    named = lambda name, c: F.concat(F.lit(f"PARAM_{name}_"), c)
    rules += [
        (named("BURST_ASYM_RATIO", bin_ge(F.floor(high / low), 3, 7)), param, high >= low + 4), (named("REQ_RESP_REPEAT", bin_ge(F.col("near_pairs"), 2, 3)), param, F.col("near_pairs") >= 2), (named("BURST_COUNT", bin_ge(F.col("bursts"), 3, 8)), param, F.col("bursts") > 0),
        (named("IAT_CV", F.when(cv < 0.25, "LOW").when(cv < 1.0, "MID").otherwise("HIGH")), param, n >= 4), (named("LONG_IDLE_BIN", bin_ge(F.col("iat_hi"), 10, 13)), param, (n >= 4) & (F.col("iat_hi") >= limits.high_iat)),
    ]
    nowhere = F.lit(None).cast("long")
    made = F.array(*[F.when(c, F.struct(F.concat(F.lit("PRIM_STRUCT_"), F.lit(x) if isinstance(x, str) else x).alias("name"), F.lit(fam).alias("family"), (at[0].cast("long") if at else nowhere).alias("pos"))) for x, fam, c, *at in rules])
    whole = f.select("flow", F.explode(F.filter(made, lambda t: t.isNotNull())).alias("t")).select("flow", "t.name", "t.family", "t.pos")
    fired = whole
    for one in out:
        fired = fired.unionByName(one)
    counted = fired.where(F.col("family").isin(*limits.families)).groupBy("flow", "family", "name").agg(F.count("*").alias("count"), F.min("pos").alias("first_pos"))
    # one position trigger for each placed trigger of the families before it; a change of direction is placed by packet, not by token
    base = F.lit(None).cast("string")
    for prefix, called in reversed(POSITION_NAMES):
        base = F.when(F.col("name").startswith(f"PRIM_STRUCT_{prefix}"), called).otherwise(base)
    placed = counted.where("first_pos IS NOT NULL AND family <> 'direction_transition'").where(wanted("position_aware")).join(f.select("flow", "most"), "flow").withColumn("name", F.concat(F.lit("PRIM_STRUCT_POS_"), position_bucket(F.col("first_pos"), F.col("most")), F.lit("_"), base))
    aware = placed.groupBy("flow", "name").agg(F.count("*").alias("count"), F.min("first_pos").alias("first_pos")).select("flow", F.lit("position_aware").alias("family"), "name", "count", "first_pos")
    every = counted.unionByName(aware)
    rank = F.row_number().over(Window.partitionBy("flow", "family").orderBy(F.desc("count"), "name"))
    return every.withColumn("r", rank).where(F.col("r") <= limits.per_family).drop("r")


def _flow_facts(p: DataFrame, bursts: DataFrame, limits: Limits) -> DataFrame:
    """A row a flow: sums over its packets and bursts. Ties of the commonest gap go to the gap met first."""
    mode = p.groupBy("flow", "iat").agg(F.count("*").alias("c"), F.min("i").alias("first")).groupBy("flow").agg(F.min(F.struct((-F.col("c")).alias("c"), "first", "iat")).alias("m"))
    own = p.groupBy("flow").agg(
        F.count("*").alias("n"), F.count_if(F.col("dir") == "C2S").alias("up"), F.count_if(F.col("dir_") != F.col("dir")).alias("turns"), F.min_by("dir", "i").alias("first_dir"), F.min(F.when(F.col("dir_") != F.col("dir"), F.col("i"))).alias("first_turn"), F.min("iat").alias("iat_lo"), F.max("iat").alias("iat_hi"),
        F.count_if(F.col("iat") >= limits.high_iat).alias("high"), F.avg("iat").alias("iat_mean"), F.stddev_pop("iat").alias("iat_std"), F.max("pos").alias("p_most"),
    ).join(mode.select("flow", (-F.col("m.c")).alias("mode_n"), F.col("m.iat").alias("mode_iat")), "flow")
    w = Window.partitionBy("flow").orderBy("b")
    template = lambda *back: [(F.lag(c).over(w) if back else F.col(c)) for c in ("dir", "pktn", "len_mean")]
    again = reduce(and_, [now.eqNullSafe(then) for now, then in zip(template(), template(1), strict=True)]) & F.lag("b").over(w).isNotNull()
    q = bursts.withColumns({"again": again, "near_pair": (F.lag("dir").over(w) == "C2S") & (F.col("dir") == "S2C")})
    gaps = bursts.where("gap_next IS NOT NULL").groupBy("flow", "gap_next").agg(F.count("*").alias("c")).groupBy("flow").agg(F.max("c").alias("gap_mode_n"), F.sum("c").alias("gaps"))
    # turns and pairs are those of the bursts that have a direction
    ways = bursts.where("dir IS NOT NULL").withColumn("dir_", F.lag("dir").over(w)).groupBy("flow").agg(
        F.count("*").alias("b_dirs"), F.count_if(F.col("dir") == "C2S").alias("b_c2s"), F.count_if(F.col("dir") == "S2C").alias("b_s2c"), F.count_if((F.col("dir_") == "C2S") & (F.col("dir") == "S2C")).alias("pairs"), F.count_if(F.col("dir_") != F.col("dir")).alias("b_turns"),
    )
    theirs = q.groupBy("flow").agg(
        F.count("*").alias("bursts"), F.count_if("near_pair").alias("near_pairs"), F.count_if(F.col("gap_next") <= limits.low_iat).alias("low_gap"), F.count_if("again").alias("dup"),
        F.sum("c2s").alias("bytes_c2s"), F.sum("s2c").alias("bytes_s2c"), F.count_if(F.col("pktn") <= 1).alias("short_bursts"), F.max("pos").alias("b_most"),
    ).join(gaps, "flow", "left").join(ways, "flow", "left")
    both = own.join(theirs, "flow", "full")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("bursts", "near_pairs", "b_dirs", "b_c2s", "b_s2c", "pairs", "b_turns", "low_gap", "dup", "bytes_c2s", "bytes_s2c", "short_bursts", "gaps", "gap_mode_n")}
    return both.withColumns(zero).withColumn("most", F.greatest(F.coalesce("p_most", F.lit(0)), F.coalesce("b_most", F.lit(0)), F.lit(1)))
