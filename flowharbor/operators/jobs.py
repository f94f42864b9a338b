"""Jobs composed of the operators, and the smaller ones that they need."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions.scalars import hash_rank_key, token_class

from . import memory as K
from . import metrics as M
from . import tokens as T
from .profiles import flow_parts, flow_tokens
from .staging import first_rows, hash_number, running, staged


#: SCA28: the token classes that each named view keeps. Fixed values.
VIEWS = {
    "packet": "packet", "packet_burst": "packet burst", "packet_burst_profile": "packet burst profile", "profile_only": "profile", "rhythm_only": "rhythm", "structural_only": "structural", "profile_plus_structural": "profile structural",
    "packet_burst_only": "packet burst flow", "packet_burst_plus_profile": "packet burst flow profile", "packet_burst_plus_structural": "packet burst flow structural", "packet_burst_plus_profile_structural": "packet burst flow profile structural",
    "statistics_only": "flow", "token_histogram_only": "packet burst flow", "primitive_only": "profile structural", "token_plus_primitive": "packet burst flow profile structural", "without_tokens": "profile structural",
}
#: The classes, or parts of tokens, that a view leaves out. Fixed values.
VIEWS_WITHOUT = {"all_with_special": "", "all_no_special": "special", "no_profile_no_unk": "special profile none", "no_burst_no_profile_no_unk": "special profile none burst", "without_primitives": "special profile structural"}
PARTS_WITHOUT = {"without_timing": ("IAT", "DUR", "PERIODIC"), "without_length": ("LEN", "BYTES")}
BEGIN_WITHOUT = {"without_direction": ("PKT_DIR_", "BURST_DIR_", "PRIM_STRUCT_DIR_")}


def view_filter(token: Column, view: str) -> Column:
    """SCA28: whether a token belongs to a named view of the features: views of a sweep, of primitive categories and of feature
    matrices. Special tokens belong to `all_with_special` only. An unknown view is an error."""
    kind = token_class(token)
    if view in VIEWS:
        return kind.isin(*VIEWS[view].split())
    if view == "no_unk":
        return kind != "special"
    if view in VIEWS_WITHOUT:
        return ~kind.isin(*VIEWS_WITHOUT[view].split()) if VIEWS_WITHOUT[view] else token.isNotNull()
    if view in PARTS_WITHOUT:
        return (kind != "special") & ~reduce(lambda a, b: a | b, [token.contains(p) for p in PARTS_WITHOUT[view]])
    if view in BEGIN_WITHOUT:
        return (kind != "special") & ~reduce(lambda a, b: a | b, [token.startswith(p) for p in BEGIN_WITHOUT[view]])
    raise ValueError(f"unknown view {view}")


#: All names that `view_filter` knows.
VIEW_NAMES = sorted({*VIEWS, *VIEWS_WITHOUT, *PARTS_WITHOUT, *BEGIN_WITHOUT, "no_unk"})


def ablation_filter(token: Column, flow_summary: bool = True, packet: bool = True, burst: bool = True, rhythm: bool = True) -> Column:
    """SCA28: whether a token stays when kinds of tokens are switched off; profile tokens go with the packets, special and other ones stay."""
    off = [k for k, on in (("flow", flow_summary), ("packet profile none", packet), ("burst", burst), ("rhythm", rhythm)) if not on]
    gone = " ".join(off).split()
    return ~token_class(token).isin(*gone) if gone else token.isNotNull()


def glob_filter(df: DataFrame, column: str, include: list[str], exclude: list[str]) -> DataFrame:
    """SCA34: rows whose column fits one of the globs (* and ?) and none of the excluded."""
    def fits(globs: list[str]) -> Column:
        out = F.lit(False)
        for g in globs:
            regex = "".join(".*" if c == "*" else "." if c == "?" else f"\\Q{c}\\E" for c in g)
            out = out | F.col(column).rlike(f"^(?s:{regex})$")
        return out

    keep = fits(include) if include else F.lit(True)
    return df.where(keep & ~fits(exclude))


def stratum(packets: Column, duration: Column, both_ways: Column) -> Column:
    """SCA36: a flow's behaviour stratum."""
    return F.when(packets <= 2, "tiny").when(~both_ways, "one_way").when((packets < 6) & (duration < 1), "short").when(packets >= 100, "bulk").otherwise("regular")


def gate_keep(packets: Column, both_ways: Column, gate: str) -> Column:
    """SCA36: the evidence gates: all, min3, two_way, strict."""
    return {"all": F.lit(True), "min3": packets >= 3, "two_way": both_ways, "strict": (packets >= 6) & both_ways}[gate]


def gated_class(coarse: Column, benign_probability: Column, threshold: float = 0.5) -> Column:
    """SCA39: BENIGN where the binary head says so, else the best attack class of the map (ties by name)."""
    attacks = F.filter(F.map_entries(coarse), lambda e: e["key"] != "BENIGN")
    best = F.reduce(attacks, F.struct(F.lit("").alias("key"), F.lit(-1.0).alias("value")), lambda a, e: F.when((e["value"] > a["value"]) | ((e["value"] == a["value"]) & (e["key"] < a["key"])), F.struct(e["key"].alias("key"), e["value"].alias("value"))).otherwise(a))
    return F.when(benign_probability >= threshold, "BENIGN").otherwise(best["key"])


def flow_fingerprint(ts: Column, lens: Column, dirs: Column, n: int = 32) -> Column:
    """SCA41: a hash of the rounded start and the first n lengths and directions."""
    return F.sha1(F.concat_ws("|", F.round(ts, 3).cast("string"), F.array_join(F.slice(lens, 1, n).cast("array<string>"), ","), F.array_join(F.slice(dirs, 1, n).cast("array<string>"), ",")))


def length_vector(flow: Column, lens: Column, n: int) -> Column:
    """SCA44: a flow's first n lengths over 1500, at most 1, padded with zeros."""
    scaled = F.transform(F.slice(lens, 1, n), lambda x: F.least(F.lit(1.0), x / 1500.0))
    return F.slice(F.concat(scaled, F.array_repeat(F.lit(0.0), n)), 1, n)


def capped_flows(packets: DataFrame, flows_per_label: int, packets_per_flow: int) -> DataFrame:
    """AGG02: of packets (label, flow, seq), the first packets of the flows that came first for each label."""
    first = packets.groupBy("label", "flow").agg(F.min("seq").alias("first"))
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("first"))).where(F.col("r") <= flows_per_label)
    rows = packets.join(kept.select("label", "flow"), ["label", "flow"], "left_semi")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("label", "flow").orderBy("seq"))).where(F.col("i") <= packets_per_flow).drop("i")


def augment_sequences(tokens: DataFrame, least: int, cap: int = 32, counts: DataFrame | None = None) -> DataFrame:
    """AGG18: pairs of tokens in a row that enough train flows have, at most `cap` a flow by (-count, name); `counts` (flow_id, split, gram, n)
    are the flows' pairs, if there are any."""
    grams = T.ngrams(tokens, 2, least) if counts is None else T.frequent_grams(counts, least)
    return grams.withColumn("r", F.row_number().over(Window.partitionBy("flow_id").orderBy(F.desc("n"), "gram"))).where(F.col("r") <= cap)


def motif_contrast(alerts: DataFrame, neighbours: DataFrame, tokens: DataFrame) -> DataFrame:
    """JOI18: for each alert and neighbour, tokens that only the alert, only the neighbour and that both have."""
    sets = tokens.groupBy("flow_id").agg(F.collect_set("token").alias("t"))
    rows = neighbours.join(alerts.select("id").distinct(), "id", "left_semi").join(sets.withColumnsRenamed({"flow_id": "id", "t": "a"}), "id").join(sets.withColumnsRenamed({"flow_id": "mid", "t": "b"}), "mid")
    return rows.select("id", "mid", F.size(F.array_except("a", "b")).alias("alert_only"), F.size(F.array_except("b", "a")).alias("neighbour_only"), F.size(F.array_intersect("a", "b")).alias("shared"))


def reservoir(df: DataFrame, family: str, caps: dict[str, int], seed: int = 42) -> DataFrame:
    """TOP08: the rows of lowest hash of each family, up to its cap; families without a cap go."""
    cap = F.create_map(*[x for k, v in caps.items() for x in (F.lit(k), F.lit(v))])
    key = hash_rank_key(F.col("flow_id"), seed, "reservoir")
    ranked = df.withColumn("r", F.row_number().over(Window.partitionBy(family).orderBy(key, "flow_id")))
    return ranked.where(F.col("r") <= cap[F.col(family)]).drop("r")


def trainer_split(flows: DataFrame, by: list[str], val: float, test: float) -> DataFrame:
    """TOP04: chronological split with floor cuts, by group."""
    w = Window.partitionBy(*by)
    rows = flows.withColumns({"r": F.row_number().over(w.orderBy("start_ts", "flow_id")), "n": F.count("*").over(w)})
    t, v = F.floor(F.col("n") * test), F.floor(F.col("n") * val)
    return rows.select("flow_id", F.when(F.col("r") <= F.col("n") - t - v, "train").when(F.col("r") <= F.col("n") - t, "val").otherwise("test").alias("split"))


def pool_split(gated: DataFrame, memory: float, calibration: float) -> DataFrame:
    """TOP13: admitted rows in time order as memory, calibration and tail."""
    rows = gated.where("admission = 'admit'").withColumns({"r": F.percent_rank().over(Window.partitionBy("pool").orderBy("ts", "id"))})
    return rows.select("id", F.when(F.col("r") < memory, "memory").when(F.col("r") < memory + calibration, "calibration").otherwise("tail").alias("part"))


def token_weight_scheme(weights: DataFrame, scheme: str, groups: dict[str, float] | None = None) -> DataFrame:
    """CAL07: weights (flow_id, token, w) under `uniform` (1), `groups` (by first letters) or as they are, normed anew."""
    w = F.col("w")
    if scheme == "uniform":
        w = F.lit(1.0)
    elif scheme == "groups":
        for prefix, factor in (groups or {}).items():
            w = F.when(F.col("token").startswith(prefix), F.col("w") * factor).otherwise(w)
    rows = weights.withColumn("w", w)
    return rows.withColumn("w", F.try_divide(F.col("w"), F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("flow_id")))))


def leave_one_job(tokens: DataFrame, k: int, percentile: float = 99.0, flows: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """CAL15: train-only weights, nearest benign memory, threshold from benign validation scores, metrics on the test.
    `flows` (flow_id, split, label) names the flows to score, those without tokens too; `counts` are the tokens' `token_counts`, if there are any."""
    counts = staged(T.token_counts(tokens) if counts is None else counts, "token-counts")
    w = staged(T.counted_weights(counts, "binary", "l2"), "weights")  # memory and queries are read several times
    memory = w.where("split = 'train' AND label = 'BENIGN'").select(F.col("flow_id").alias("mid"), "token", "w")
    query = w.where("split <> 'train'").select(F.col("flow_id").alias("id"), "token", "w")
    query = query if flows is None else query.join(flows.select(F.col("flow_id").alias("id")), "id", "left_semi")
    meta = (tokens if flows is None else flows).where("split <> 'train'").select(F.col("flow_id").alias("id"), "split", (F.col("label") == "ATTACK").cast("int").alias("y")).distinct()
    scored = K.knn_sparse(query, memory, k, meta).join(meta, "id").select(F.col("id").alias("flow_id"), F.round("score", 9).alias("score"), "y", "split")
    return M.percentile_thresholds(scored.where("split = 'val'"), scored.where("split = 'test'"), [percentile])


def memory_scaling(query: DataFrame, memory: DataFrame, sizes: list[int], k: int, query_ids: DataFrame | None = None) -> DataFrame:
    """CAL10: mean score against hash-drawn memories of several sizes; `query_ids` (id) names queries without known tokens too."""
    ids = memory.select("mid").distinct()
    key = hash_rank_key(F.col("mid"), 42, "memory")
    names = query.select("id").distinct() if query_ids is None else query_ids
    # the memories lie in the largest, so only the queries' tokens that it has matter
    top = staged(memory.join(first_rows(ids, hash_number(key), [key, "mid"], max(sizes)), "mid", "left_semi"), "memory")
    known = staged(query.join(top.select("token").distinct(), "token", "left_semi"), "known")
    out = None
    for n in sizes:
        part = top.join(first_rows(top.select("mid").distinct(), hash_number(key), [key, "mid"], n), "mid", "left_semi")
        one = K.knn_sparse(known, part, k, names).agg(F.avg("score").alias("mean_score"), F.count("*").alias("queries")).select(F.lit(n).alias("size"), "mean_score", "queries")
        out = one if out is None else out.unionByName(one)
    return out


def sweep(tokens: DataFrame, transforms: list[str], ks: list[int], flows: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """CAL11: mean benign and attack test scores by weighting and k; `flows` (flow_id, split, label) also holds those without tokens; `counts`
    are the tokens' `token_counts`, if there are any."""
    out, counts = None, staged(T.token_counts(tokens) if counts is None else counts, "token-counts")
    meta = staged((tokens if flows is None else flows).where("split = 'test'").select(F.col("flow_id").alias("id"), "label").distinct(), "flows")
    for t in transforms:
        w = staged(T.counted_weights(counts, t, "l2"), "weights")
        memory = w.where("split = 'train' AND label = 'BENIGN'").select(F.col("flow_id").alias("mid"), "token", "w")
        query = w.where("split = 'test'").select(F.col("flow_id").alias("id"), "token", "w")
        nearest = staged(K.nearest_sparse(query, memory, max(ks)), "nearest")  # one search, of which every k takes its first
        for k in ks:
            one = K.mean_nearest(nearest, memory, k, meta).join(meta, "id").groupBy("label").agg(F.avg("score").alias("mean_score")).select(F.lit(t).alias("transform"), F.lit(k).alias("k"), "label", "mean_score")
            out = one if out is None else out.unionByName(one)
    return out


def replay_summary(replay: DataFrame) -> DataFrame:
    """STR11: by label and in all (null): flows, alerts, false and true alerts, first and last time."""
    hit = F.col("hit") == 1
    return replay.rollup("label").agg(F.count("*").alias("flows"), F.count_if(hit).alias("alerts"), F.count_if(hit & (F.col("y") == 0)).alias("false_alerts"), F.count_if(hit & (F.col("y") == 1)).alias("true_alerts"), F.min("ts").alias("first"), F.max("ts").alias("last"))


def calibrate(scored: DataFrame, warmup: int) -> tuple[DataFrame, DataFrame]:
    """STR12: the best macro-F1 point on the first `warmup` rows in time, and the rows after them."""
    rows = running(scored, [], ["ts", "flow_id"], {"pos": F.lit(1)})
    return M.best_macro_f1(M.curve(rows.where(F.col("pos") <= warmup))), rows.where(F.col("pos") > warmup).drop("pos")


def pollution(memory: DataFrame, attacks: DataFrame, fraction: float, seed: int = 43) -> DataFrame:
    """STR09: a memory in which a share of rows, drawn by hash, is taken from attacks."""
    want = memory.agg(F.ceil(F.count("*") * fraction).cast("long")).first()[0]
    key = hash_rank_key(F.col("mid"), seed, "pollution")
    bad = first_rows(attacks.select("mid"), hash_number(key), [key, "mid"], want)
    return memory.select("mid", F.lit(0).alias("polluted")).unionByName(bad.select("mid", F.lit(1).alias("polluted")))


def memory_pollution(scored: DataFrame, threshold: float, fraction: float, seed: int = 43, **memory) -> DataFrame:
    """STR09: the service memories of STR08 over scored flows (flow_id, service, ts, value, score, y), a share of whose attacks, drawn
    by hash, slips into memory: one row of rates, poisoned and clean updates."""
    from flowharbor.streaming.flows import dynamic_memory

    want = round(scored.where("y = 1").count() * fraction)
    key = hash_rank_key(F.col("flow_id"), seed, "poison")
    drawn = first_rows(scored.where("y = 1"), hash_number(key), [key, "flow_id"], want).select("flow_id", F.lit(True).alias("poison"))
    rows = scored.join(drawn, "flow_id", "left").select("flow_id", "service", "ts", "value", "score", "y", F.coalesce("poison", F.lit(False)).alias("poison"))
    rows = staged(rows, "poisoned")  # the fold and the rates read them
    out = dynamic_memory(rows, threshold, poison="poison", **memory).join(rows.select("flow_id", "y", "poison"), "flow_id")
    hit, bad = F.col("memory_score") >= threshold, F.col("y") == 1
    facts = out.agg(F.count_if(hit & ~bad).alias("fp"), F.count_if(~hit & ~bad).alias("tn"), F.count_if(hit & bad).alias("tp"), F.count_if(~hit & bad).alias("fn"), F.count_if(F.col("poison")).alias("poisoned_updates"), F.count_if((F.col("admitted") == 1) & ~F.col("poison")).alias("clean_updates"))
    return facts.withColumns({"fpr": M.ratio(F.col("fp"), F.col("fp") + F.col("tn")), "recall": M.ratio(F.col("tp"), F.col("tp") + F.col("fn"))})


def primitive_sensitivity(rows: DataFrame, splits: DataFrame, grid: list[dict], k: int = 3, **tokens) -> DataFrame:
    """CAL16: the leave-one metrics of packet rows' behaviour tokens under each setting of the profile primitives (`short`, `chunk`), one row a setting.
    Settings that differ in `short` only share all that does not depend on it."""
    out, shared = None, {}
    for setting in grid:
        given = {"gap": 0.1, "chunk": 128} | {name: x for name, x in (tokens | setting).items() if name in ("gap", "chunk")}
        key = given["gap"], given["chunk"]
        if key not in shared:
            shared[key] = flow_parts(rows, **given) if tokens.get("profile", "full") != "none" else None
        made = staged(flow_tokens(rows, **(tokens | setting), parts=shared[key]).join(splits, "flow").select("flow", "split", "label", "tokens"), "setting-tokens")
        corpus = made.select(F.col("flow").alias("flow_id"), "split", "label", F.posexplode("tokens").alias("pos", "token"))
        one = leave_one_job(corpus, k).withColumn("setting", F.lit(", ".join(f"{a}={b}" for a, b in sorted(setting.items()))))
        out = one if out is None else out.unionByName(one)
    return out


def insert_benign(attacks: DataFrame, benign: DataFrame, share: float, shift: float, seed: int = 42) -> DataFrame:
    """AUG05: attack flows with hash-drawn benign ones put in, moved by `shift` seconds."""
    from .splits import uniform

    more = benign.where(uniform(seed, "insert", F.col("flow_id")) < share).withColumn("ts", F.col("ts") + shift)
    return attacks.withColumn("inserted", F.lit(0)).unionByName(more.withColumn("inserted", F.lit(1)))
