"""Service context, rolling and tumbling windows, detection delay, replay rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import discard, haloed, running, staged


def since(width: float, *by: str):
    """Window over the rows of `by` from `width` seconds before a row's ts up to it, in whole microseconds."""
    base = Window.partitionBy(*by) if by else Window
    return base.orderBy(F.round(F.col("ts") * 1e6).cast("bigint")).rangeBetween(-round(width * 1e6), 0)


def service_context(flows: DataFrame, window: float = 2.0, short: int = 6) -> DataFrame:
    """WIN01: of flows (flow_id, service, ts, packets, bytes) what the service did in the `window` seconds before: flows,
    short ones, packets, bytes, gap to the last. Rows of one time see those of smaller flow_id only.

    What came in the window is what came before less what came before the window: two running sums, each in one pass, where a sliding
    window adds up its rows anew for each of them. Rows are dealt to buckets of `window` seconds that also hold the one before, so a
    hot service spreads over its buckets. A row without a time has nothing before it.
    """
    key = ["service", "_bucket"]
    order = Window.partitionBy(*key).orderBy("_us", "flow_id")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    gone = Window.partitionBy(*key).orderBy("_us").rangeBetween(Window.unboundedPreceding, -round(window * 1e6) - 1)
    tiny = (F.col("packets") < short).cast("int")
    over = lambda what, span: F.coalesce(F.sum(what).over(span), F.lit(0))
    less = lambda what: F.when(F.col("_us").isNull(), 0).otherwise(over(what, earlier) - over(what, gone)).cast("bigint")
    last = F.col("ts") - F.lag("ts").over(order)
    slim = flows.select("flow_id", "service", "ts", "packets", "bytes") if "bytes" in flows.columns else flows
    out = haloed(slim, F.col("ts"), window).select("flow_id", "service", "ts", "_halo", less(F.lit(1)).alias("recent_count"), less(tiny).alias("recent_short"), less(F.col("packets")).alias("recent_packets"), less(F.col("bytes")).alias("recent_bytes"), F.when(last <= window, last).alias("last_gap"))
    out = out.where("_halo = 0").drop("_halo")
    return out.withColumn("short_ratio", F.when(F.col("recent_count") > 0, F.col("recent_short") / F.col("recent_count")).otherwise(0.0))


def service_state(flows: DataFrame, windows: list[float], short: int = 6) -> DataFrame:
    """WIN03: counts, short ratio and mean packets of the service's earlier flows for several windows, and in all."""
    out = flows.select("flow_id", "service", "ts", "packets", "bytes")
    life = running(out, ["service"], ["ts", "flow_id"], {"i": F.lit(1), "p": F.col("packets"), "known": F.col("packets").isNotNull().cast("int")})
    own = F.coalesce("packets", F.lit(0))
    mean = F.try_divide(F.col("p") - own, F.col("known") - F.col("packets").isNotNull().cast("int"))
    life = life.select("flow_id", (F.col("i") - 1).alias("lifetime"), F.coalesce(mean, F.lit(0.0)).cast("double").alias("lifetime_packets"))
    for w in windows:
        c = service_context(out, w, short)
        life = life.join(c.select("flow_id", F.col("recent_count").alias(f"count_{w:g}"), F.col("short_ratio").alias(f"short_{w:g}")), "flow_id")
    return life


def rolling_scores(preds: DataFrame, group: list[str], n: int, mode: str = "causal", method: str = "mean") -> DataFrame:
    """WIN04: each row's score over the n rows up to it (causal), from it (forward) or around it (centred): mean or max."""
    lo, hi = {"causal": (-(n - 1), 0), "forward": (0, n - 1), "centred": (-(n // 2), (n - 1) // 2)}[mode]
    w = Window.partitionBy(*group).orderBy("ts", "flow_id").rowsBetween(lo, hi)
    value = {"mean": F.avg, "max": F.max}[method]("score").over(w)
    return preds.select("flow_id", *group, value.alias("smoothed"), F.count("*").over(w).alias("rows_used"))


def tumbling_rows(preds: DataFrame, group: list[str], n: int) -> DataFrame:
    """WIN05: blocks of n rows of a group in order: mean and highest score, majority prediction (ties to the larger)."""
    w = Window.partitionBy(*group).orderBy("ts", "flow_id")
    rows = preds.withColumn("block", F.floor((F.row_number().over(w) - 1) / n))
    out = rows.groupBy(*group, "block").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.max("score").alias("most"), F.sum(F.col("hit").cast("bigint")).alias("hits"))
    return out.withColumn("majority", (2 * F.col("hits") >= F.col("n")).cast("int"))


def anchored_windows(preds: DataFrame, group: list[str], width: float) -> DataFrame:
    """WIN05: windows that start at a row and restart at the first row over `width` seconds after. Rows without a time or a
    group belong to none; `width` is positive.

    Every time points to the first one over `width` later; that is found inside time buckets of `width` seconds, or is the first time of the
    next bucket that has any. Doubled pointers then mark what the group's first time reaches, in as many rounds as the logarithm of a
    group's windows. A bucket holds one start at most, so rows meet at most two starts each, in their bucket.
    """
    place = lambda t: F.floor(t / width)
    times = preds.select(*group, "ts").where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*group, "ts"])).distinct().withColumn("_b", place(F.col("ts")))
    firsts = times.groupBy(*group, "_b").agg(F.min("ts").alias("_first"))
    # a time and the end of its reach meet in the bucket of the latter; reaches sort before the times that lie beyond them
    reach = times.select(*group, place(F.col("ts") + width).alias("_b"), (F.col("ts") + width).alias("_at"), F.col("ts").alias("_from"), F.lit(None).cast("double").alias("_time"))
    both = reach.unionByName(times.select(*group, "_b", F.col("ts").alias("_at"), F.lit(None).cast("double").alias("_from"), F.col("ts").alias("_time")))
    later = Window.partitionBy(*group, "_b").orderBy(F.desc("_at"), F.col("_time").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
    inside = both.withColumn("_next", F.last("_time", ignorenulls=True).over(later)).where("_from IS NOT NULL")
    upcoming = Window.partitionBy(*group).orderBy("_b")
    after = inside.select(*group, "_b").distinct().join(firsts, [*group, "_b"], "full").withColumn("_then", F.first("_first", ignorenulls=True).over(upcoming.rowsBetween(1, Window.unboundedFollowing)))
    links = inside.join(after.select(*group, "_b", "_then"), [*group, "_b"]).select(*group, F.col("_from").alias("_f"), F.coalesce("_next", "_then").alias("_t")).where("_t IS NOT NULL")
    links = staged(links, "pointers")
    starts = staged(firsts.groupBy(*group).agg(F.min("_first").alias("start")), "starts")
    while not links.isEmpty():
        hop = starts.withColumnRenamed("start", "_f").join(links, [*group, "_f"]).select(*group, F.col("_t").alias("start"))
        grown = staged(starts.unionByName(hop).distinct(), "starts")
        doubled = staged(links.join(links.select(*group, F.col("_f").alias("_t"), F.col("_t").alias("_u")), [*group, "_t"]).select(*group, "_f", F.col("_u").alias("_t")), "pointers")
        discard(links)
        discard(starts)
        starts, links = grown, doubled
    numbered = running(starts, group, ["start"], {"window": F.lit(1)}).withColumn("window", (F.col("window") - 1).cast("int"))
    dealt = numbered.withColumn("_b", F.explode(F.sequence(place(F.col("start")), place(F.col("start") + width))))
    joined = preds.withColumn("_b", place(F.col("ts"))).join(dealt, [*group, "_b"]).where((F.col("ts") >= F.col("start")) & (F.col("ts") <= F.col("start") + width))
    return joined.groupBy(*group, "window", "start").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))


def session_windows(flows: DataFrame, group: list[str], n: int, stride: int, least: int, purity: float) -> DataFrame:
    """WIN06: windows of n rows every `stride` rows, of at least `least` rows, whose commonest label (ties by name) holds
    the share `purity`."""
    w = Window.partitionBy(*group).orderBy("ts", "flow_id")
    i = F.row_number().over(w) - 1
    rows = flows.withColumn("i", i)
    first = F.greatest(F.lit(0), F.floor((F.col("i") - n + stride) / stride))
    placed = rows.withColumn("w", F.explode(F.sequence(first.cast("bigint"), F.floor(F.col("i") / stride).cast("bigint"))))
    by = placed.groupBy(*group, "w", "label").agg(F.count("*").alias("c"))
    best = by.groupBy(*group, "w").agg(F.sum("c").alias("rows"), F.min(F.struct((-F.col("c")).alias("c"), "label")).alias("m"))
    return best.where((F.col("rows") >= least) & (-F.col("m.c") >= purity * F.col("rows"))).select(*group, F.col("w").alias("window"), "rows", F.col("m.label").alias("label"), (-F.col("m.c") / F.col("rows")).alias("purity"))


def max_sliding_fpr(replay: DataFrame, widths: list[float]) -> DataFrame:
    """WIN08: the highest share of false alerts among benign rows in any window of `width` seconds before a row."""
    b = replay.where("y = 0").groupBy("ts").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("bigint")).alias("h"))
    out = None
    for w in widths:
        span = Window.partitionBy("_bucket").orderBy("_us").rangeBetween(-round(w * 1e6), 0)
        one = haloed(b, F.col("ts"), w).select("_halo", (F.sum("h").over(span) / F.sum("n").over(span)).alias("f")).where("_halo = 0").agg(F.max("f").alias("max_fpr")).select(F.lit(float(w)).alias("window_s"), "max_fpr")
        out = one if out is None else out.unionByName(one)
    return out


def detection_delay(scores: DataFrame, threshold: float, consecutive: int = 3) -> DataFrame:
    """WIN09: by label, seconds and rows from its first row to the end of its first run of so many alerts in a row.

    Rows are numbered by running counts over range partitions. Alerts with equally many misses before them are one run, so
    the first long run and its end are aggregations, and no label is sorted in one task.
    """
    hit = F.coalesce((F.col("score") >= threshold).cast("int"), F.lit(0))
    rows = running(scores.select("label", "flow_id", "ts", hit.alias("hit")), ["label"], ["ts", "flow_id"], {"i": F.lit(1), "misses": 1 - F.col("hit")})
    rows = staged(rows, "numbered")
    runs = rows.where("hit = 1").groupBy("label", "misses").agg(F.count("*").alias("n"), F.min("i").alias("i")).where(F.col("n") >= consecutive)
    ends = runs.groupBy(F.col("label").alias("of")).agg((F.min("i") + consecutive - 1).cast("bigint").alias("end"))
    facts = rows.groupBy("label").agg(F.count("*").alias("rows"), F.min("ts").alias("first"))
    known = facts.join(ends, F.col("label").eqNullSafe(F.col("of")), "left").drop("of")
    last = rows.select(F.col("label").alias("of"), "i", F.col("ts").alias("end_ts"))
    out = known.join(last, F.col("label").eqNullSafe(F.col("of")) & (F.col("i") == F.col("end")), "left")
    return out.select("label", "rows", (F.col("end_ts") - F.col("first")).alias("delay_s"), F.col("end").alias("delay_rows"))


def first_events(replay: DataFrame) -> DataFrame:
    """WIN10: times of the first row, first attack, first alert and first false alert."""
    hit, bad = F.col("hit") == 1, F.col("y") == 1
    return replay.agg(F.min("ts").alias("first"), F.min(F.when(bad, F.col("ts"))).alias("first_attack"), F.min(F.when(hit, F.col("ts"))).alias("first_alert"), F.min(F.when(hit & ~bad, F.col("ts"))).alias("first_fp"), F.avg(F.when(bad, hit.cast("double"))).alias("coverage"))


def service_monitor(scored: DataFrame, threshold: float, window: float, min_count: int, max_packets: int, min_short: float, min_score: float = 0.0, merge: str = "or") -> DataFrame:
    """STR05: model alerts joined with service episodes: a short flow of at least min_score whose service has had
    min_count flows (itself included) in the window, of which the share min_short are short. merge `or` or `model_only`."""
    c = service_context(scored, window, max_packets + 1)
    own = (F.col("packets") <= max_packets).cast("int")
    rows = scored.join(c.select("flow_id", "recent_count", "recent_short"), "flow_id")
    count, short = F.col("recent_count") + 1, F.col("recent_short") + own
    episode = (own == 1) & (F.col("score") >= min_score) & (count >= min_count) & (short / count >= min_short)
    model = F.col("score") >= threshold
    final = model if merge == "model_only" else model | episode
    return rows.select("flow_id", "service", "ts", model.cast("int").alias("model_alert"), episode.cast("int").alias("episode_alert"), final.cast("int").alias("hit"), count.alias("window_count"))


def hybrid_alerts(scored: DataFrame, threshold: float, window: float, min_count: int, max_packets: int) -> DataFrame:
    """STR06: alert on the model's score, or on a short flow when so many short flows came in the window, over all services.

    Short flows are first counted by time; the window then runs inside time buckets that also hold the bucket before.
    """
    tiny = scored.where(F.col("packets") <= max_packets).groupBy("ts").agg(F.count("*").alias("n"))
    span = Window.partitionBy("_bucket").orderBy("_us").rangeBetween(-round(window * 1e6), 0)
    recent = haloed(tiny, F.col("ts"), window).select("ts", "_halo", F.sum("n").over(span).alias("short_recent")).where("_halo = 0").drop("_halo")
    rows = scored.join(recent, "ts", "left")
    burst = (F.col("packets") <= max_packets) & (F.coalesce("short_recent", F.lit(0)) >= min_count)
    return rows.select("flow_id", ((F.col("score") >= threshold) | burst).cast("int").alias("hit"), burst.cast("int").alias("burst_alert"))


def alert_guard(replay: DataFrame, protocols: list[str] | None = None, ports: list[int] | None = None, excluded: list[int] | None = None) -> DataFrame:
    """STR07: alerts kept where protocol and port are allowed; what the guard blocks is marked."""
    ok = F.lit(True)
    ok = ok & F.col("protocol").isin(*protocols) if protocols else ok
    ok = ok & F.col("port").isin(*ports) if ports else ok
    ok = ok & ~F.col("port").isin(*excluded) if excluded else ok
    return replay.withColumn("blocked", ((F.col("hit") == 1) & ~ok).cast("int")).withColumn("hit", F.when(ok, F.col("hit")).otherwise(0))


def guard_audit(guarded: DataFrame, top: int = 20) -> DataFrame:
    """AGG33: blocked true and false alerts by service, most first."""
    by = guarded.where("blocked = 1").groupBy("service").agg(F.sum((F.col("y") == 1).cast("bigint")).alias("blocked_tp"), F.sum((F.col("y") == 0).cast("bigint")).alias("blocked_fp"))
    return by.orderBy(F.desc(F.col("blocked_tp") + F.col("blocked_fp")), "service").limit(top)


def neighbour_turnover(queries: DataFrame) -> DataFrame:
    """WIN11: of (seq, neighbours), 1 - Jaccard between queries in a row: mean and 95th percentile."""
    rows = running(queries, [], ["seq"], {"i": F.lit(1)})
    before = rows.select((F.col("i") + 1).alias("i"), F.col("neighbours").alias("b"))
    t = rows.select("i", F.col("neighbours").alias("a")).join(before, "i").where("b IS NOT NULL")
    turn = 1 - F.size(F.array_intersect("a", "b")) / F.size(F.array_union("a", "b"))
    return t.select(turn.alias("t")).agg(F.avg("t").alias("mean"), F.percentile("t", F.lit(0.95)).alias("p95"))


def context_pairs(flows: DataFrame) -> DataFrame:
    """JOI17: each flow's nearer neighbour in time in its service (ties to the earlier)."""
    w = Window.partitionBy("service").orderBy("ts", "flow_id")
    p, n = F.lag(F.struct("ts", "flow_id")).over(w), F.lead(F.struct("ts", "flow_id")).over(w)
    rows = flows.select("flow_id", "ts", p.alias("p"), n.alias("n"))
    nearer = F.when(F.col("n").isNull() | (F.col("ts") - F.col("p.ts") <= F.col("n.ts") - F.col("ts")), F.col("p.flow_id")).otherwise(F.col("n.flow_id"))
    return rows.where("p IS NOT NULL OR n IS NOT NULL").select("flow_id", F.when(F.col("p").isNull(), F.col("n.flow_id")).otherwise(nearer).alias("partner"))
