"""Token corpora in long form (flow_id, split, label, service, pos, token): weights, vocabularies, motifs, n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S

from .staging import lookup, running, staged

#: A token that at least this share of the rows has meets them by broadcast: at most 100,000 tokens.
COMMON = 1e-5


def token_counts(tokens: DataFrame) -> DataFrame:
    """Occurrences by flow and token."""
    return tokens.groupBy("flow_id", "split", "label", "token").agg(F.count("*").alias("n"))


def token_weights(tokens: DataFrame, transform: str = "tfidf", norm: str = "l2") -> DataFrame:
    """AGG08: binary, count or tf-idf weights of tokens that the train split has, idf ln((1 + N) / (1 + df)) + 1 from
    train flows only, normed by flow: l2, l1 or none. Long and sparse throughout; the counts, which three steps read, are staged."""
    return counted_weights(staged(token_counts(tokens), "token-counts"), transform, norm)


def counted_weights(counts: DataFrame, transform: str = "tfidf", norm: str = "l2") -> DataFrame:
    """AGG08: the weights of `token_weights` from the counts of `token_counts`, which are read three times."""
    train = counts.where("split = 'train'")
    total = train.agg(F.count_distinct("flow_id").alias("N"))
    df = train.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(total))
    idf = staged(df.select("token", "df", (F.log((1 + F.col("N")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    held = idf.agg(F.sum("df")).first()[0] or 0  # common tokens are broadcast, only rows of rare ones are shuffled to meet theirs
    w = {"binary": F.lit(1.0), "count": F.col("n").cast("double"), "tfidf": F.col("n") * F.col("idf")}[transform]
    raw = lookup(counts, idf, "token", "df", held, COMMON).where("idf IS NOT NULL").select("flow_id", "split", "label", "token", w.alias("w"))
    by = Window.partitionBy("flow_id")
    size = {"l2": F.sqrt(F.sum(F.col("w") * F.col("w")).over(by)), "l1": F.sum(F.abs("w")).over(by), "none": F.lit(1.0)}[norm]
    return raw.withColumn("w", F.col("w") / size)


def fit_vocab(tokens: DataFrame, specials: tuple = ("[PAD]", "[UNK]", "[CLS]", "[SEP]"), split: str = "train") -> DataFrame:
    """AGG09: (token, id) by first place in the train rows, in order of (flow_id, pos), after the specials."""
    first = tokens.where((F.col("split") == split) & ~F.col("token").isin(*specials)).groupBy("token").agg(F.min(F.struct("flow_id", "pos")).alias("at"))
    ids = running(first, [], ["at"], {"i": F.lit(1).cast("bigint")}).select("token", (F.col("i") + len(specials) - 1).alias("id"))
    return tokens.sparkSession.createDataFrame([(t, i) for i, t in enumerate(specials)], "token string, id long").unionByName(ids)


def unk_rate(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """AGG09: by split, tokens and the share that the vocabulary lacks."""
    joined = tokens.join(vocab.select("token", F.lit(1).alias("known")), "token", "left")
    return joined.groupBy("split").agg(F.count("*").alias("tokens"), F.avg(F.col("known").isNull().cast("double")).alias("unk_rate"))


def token_stats(tokens: DataFrame, most: int) -> DataFrame:
    """AGG11: by split, flows, mean, median and 95th percentile (nearest rank) of length and share cut at `most`."""
    by = tokens.groupBy("split", "flow_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("split").orderBy("n", "flow_id")
    ranked = by.withColumns({"i": F.row_number().over(order), "total": F.count("*").over(Window.partitionBy("split"))})
    rank = lambda q: F.bround(q * (F.col("total") - 1)) + 1
    return ranked.groupBy("split").agg(F.count("*").alias("flows"), F.avg("n").alias("mean"), F.max(F.when(F.col("i") == rank(0.5), F.col("n"))).alias("p50"), F.max(F.when(F.col("i") == rank(0.95), F.col("n"))).alias("p95"), F.avg((F.col("n") > most).cast("double")).alias("truncated"))


def motif_support(tokens: DataFrame) -> DataFrame:
    """AGG12 and AGG14: by token, share of train flows that have it, occurrences, and log1p(occurrences) over the largest."""
    return counted_support(staged(token_counts(tokens), "token-counts"))


def counted_support(counts: DataFrame) -> DataFrame:
    """`motif_support` of token_counts, which three steps read."""
    train = counts.where("split = 'train'")
    total = train.select("flow_id").distinct().agg(F.count("*").alias("N"))
    by = train.groupBy("token").agg(F.count("*").alias("flows"), F.sum("n").alias("occurrences"))
    top = by.agg(F.max("occurrences").alias("top"))
    at = by.crossJoin(F.broadcast(total)).crossJoin(F.broadcast(top))
    return at.select("token", "flows", "occurrences", (F.col("flows") / F.col("N")).alias("support"), (F.log1p("occurrences") / F.log1p("top")).alias("coverage"))


def motif_stability(tokens: DataFrame, samples: int = 20, seed: int = 43) -> DataFrame:
    """AGG13: 1 - min(1, sd / mean) of support over Poisson(1) bootstrap samples, weights from a hash of (seed, sample, flow)."""
    flows = tokens.where("split = 'train'").select("flow_id", "token").distinct()
    # a flow's draws follow from its id, so each token sums them as columns: no join, no copy of a row for each sample
    names = [f"k{b}" for b in range(1, samples + 1)]
    u = lambda b: F.pmod(F.xxhash64(F.lit(seed), F.lit(b), F.col("flow_id")), F.lit(1 << 30)) / float(1 << 30)
    poisson = lambda u: F.when(u < 0.36787944, 0).when(u < 0.73575888, 1).when(u < 0.91969860, 2).when(u < 0.98101184, 3).when(u < 0.99634015, 4).otherwise(5)
    draws = [poisson(u(b)).alias(n) for b, n in enumerate(names, 1)]
    size = tokens.where("split = 'train'").select("flow_id").distinct().select(*draws).agg(*[F.sum(n).alias(f"of_{n}") for n in names])
    has = flows.select("token", *draws).groupBy("token").agg(*[F.sum(n).alias(n) for n in names]).crossJoin(F.broadcast(size))
    share = [F.col(n) / F.col(f"of_{n}") for n in names]
    by = has.select("token", sum(share).alias("s"), sum(x * x for x in share).alias("q"))
    mean = F.col("s") / samples
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("q") / samples - mean * mean))
    return by.select("token", (1 - F.least(F.lit(1.0), sd / (mean + 1e-9))).alias("stability"))


def tail_sensitivity(tokens: DataFrame, scores: DataFrame, core: float = 0.5, tail: float = 0.95) -> DataFrame:
    """AGG15: |rate of a token in validation flows at or above the tail quantile - rate at or below the core quantile|."""
    cut = scores.agg(F.percentile("score", F.array(F.lit(core), F.lit(tail))).alias("q"))
    parts = scores.crossJoin(F.broadcast(cut)).select("flow_id", (F.col("score") <= F.col("q")[0]).cast("int").alias("core"), (F.col("score") >= F.col("q")[1]).cast("int").alias("tail"))
    n = parts.agg(F.sum("core").alias("nc"), F.sum("tail").alias("nt"))
    has = tokens.select("flow_id", "token").distinct().join(parts, "flow_id").groupBy("token").agg(F.sum("core").alias("c"), F.sum("tail").alias("t"))
    at = has.crossJoin(F.broadcast(n))
    return at.select("token", F.abs(F.col("t") / F.col("nt") - F.col("c") / F.col("nc")).alias("sensitivity"))


def ngrams(tokens: DataFrame, n: int, least: int) -> DataFrame:
    """AGG17: runs of n tokens joined by +, in at least `least` train flows: (flow_id, split, gram, count)."""
    w = Window.partitionBy("flow_id").orderBy("pos")
    gram = F.concat_ws("+", "token", *[F.lead("token", i).over(w) for i in range(1, n)])
    rows = tokens.select("flow_id", "split", gram.alias("gram"), F.lead("token", n - 1).over(w).alias("end")).where("end IS NOT NULL")
    return frequent_grams(rows.groupBy("flow_id", "split", "gram").agg(F.count("*").alias("n")), least)


def frequent_grams(counts: DataFrame, least: int) -> DataFrame:
    """AGG17: of the flows' counted grams (flow_id, split, gram, n), those in at least `least` train flows."""
    by = staged(counts, "grams")
    train = by.where("split = 'train'")
    kept = staged(train.groupBy("gram").agg(F.count("*").alias("flows")).where(F.col("flows") >= least), "kept-grams")
    held = kept.agg(F.sum("flows")).first()[0] or 0
    return lookup(by, kept.withColumn("kept", F.lit(True)), "gram", "flows", held, COMMON).where("kept").drop("kept")


def token_lift(tokens: DataFrame, least: int = 1) -> DataFrame:
    """AGG20: a token's flow rate in attacks over that in benign flows, both plus 1e-6."""
    flows = tokens.select("flow_id", "label").distinct().groupBy().agg(F.count_if(F.col("label") == "ATTACK").alias("A"), F.count_if(F.col("label") == "BENIGN").alias("B"))
    by = tokens.select("flow_id", "label", "token").distinct().groupBy("token").agg(F.count_if(F.col("label") == "ATTACK").alias("a"), F.count_if(F.col("label") == "BENIGN").alias("b"))
    at = by.where(F.col("a") + F.col("b") >= least).withColumnsRenamed({"a": "in_attack", "b": "in_benign"}).crossJoin(F.broadcast(flows))
    ra, rb = F.col("in_attack") / F.col("A"), F.col("in_benign") / F.col("B")
    return at.select("token", "in_attack", "in_benign", ((ra + 1e-6) / (rb + 1e-6)).alias("lift"))


#: AGG16: the terms of each strategy's utility, and whether motifs that overlap with chosen ones are left out.
STRATEGIES = {
    "all_candidates": ((), False), "support_only": (("support",), False), "support_stability": (("support", "stability"), False), "support_stability_tail": (("support", "stability", "sensitivity"), False),
    "full_utility": (("support", "stability", "coverage", "sensitivity"), True),
}


def motif_utility(stats: DataFrame, strategy: str = "full_utility", weights: dict[str, float] | None = None) -> DataFrame:
    """AGG16: stats (token and the columns of the strategy's terms) plus `utility`: the weighted sum of its terms, each scaled
    to 0 to 1 over all tokens (1 where all are equal and above 0); support alone is taken unweighted, and all_candidates gives 1."""
    terms, _ = STRATEGIES[strategy]
    if not terms:
        return stats.withColumn("utility", F.lit(1.0))
    ends = stats.agg(*[f(t).alias(f"{n}_{t}") for t in terms for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = lambda t: F.when(F.col(f"hi_{t}") > F.col(f"lo_{t}"), (F.col(t) - F.col(f"lo_{t}")) / (F.col(f"hi_{t}") - F.col(f"lo_{t}"))).otherwise((F.col(f"hi_{t}") > 0).cast("double"))
    weight = {t: (weights or {}).get(t, 1.0) if len(terms) > 1 else 1.0 for t in terms}
    return stats.crossJoin(F.broadcast(ends)).select(*stats.columns, F.round(sum(weight[t] * scaled(t) for t in terms), 9).alias("utility"))


def select_motifs(stats: DataFrame, tokens: DataFrame, size: int, least: float, most: float, redundancy: float, pool: int = 1000, redundancy_cost: float = 0.0, family_caps: dict[str, float] | None = None) -> DataFrame:
    """AGG16: greedy dictionary (rank, token, utility) of up to `size` motifs by utility (column of stats, ties by name), support
    within bounds, none with a Jaccard overlap over `redundancy` with one chosen before (1: no matter); what remains of the
    utility after redundancy_cost times the largest overlap must be above 0. family_caps: the share of `size` that motifs of a
    family (profile, data_mined; structural for all others) may take.

    Candidates come `pool` at a time, best first, until the dictionary is full or none is left; they and the train flows that have them
    are staged once. The overlaps of a pool with itself and with the chosen come from matrix products over blocks of flows; the
    driver's loop sees pool rows and pairs that overlap.
    """
    spark = tokens.sparkSession
    left = staged(stats.where((F.col("support") >= least) & (F.col("support") <= most)).select("token", "utility"), "candidates")
    flows = None
    if redundancy < 1 or redundancy_cost:
        flows = staged(tokens.where("split = 'train'").select("flow_id", "token").join(left, "token", "left_semi").distinct(), "candidate-flows")
    chosen: list[tuple] = []
    held: dict[str, int] = {}
    last = None
    while len(chosen) < size:
        after = left if last is None else left.where((F.col("utility") < last[1]) | ((F.col("utility") == last[1]) & (F.col("token") > last[0])))
        names = [(r.token, r.utility) for r in after.orderBy(F.desc("utility"), "token").limit(pool).collect()]
        if not names:
            break
        last = names[-1]
        overlap = _overlaps(flows, spark.createDataFrame([(t, i < len(names)) for i, (t, *_) in enumerate([*names, *((c[1],) for c in chosen)])], "token string, fresh boolean")) if flows is not None else {}
        for token, utility in names:
            family = "profile" if token.startswith("PRIM_PROFILE_") else "data_mined" if token.startswith("DM_") else "structural"
            if len(chosen) >= size or family in (family_caps or {}) and held.get(family, 0) >= int(size * family_caps[family]):
                continue
            near = max((overlap.get((token, c[1]), overlap.get((c[1], token), 0.0)) for c in chosen), default=0.0)
            if near > redundancy or utility - redundancy_cost * near <= 0:
                continue
            chosen.append((len(chosen) + 1, token, utility - redundancy_cost * near))
            held[family] = held.get(family, 0) + 1
    return spark.createDataFrame(chosen, "rank int, token string, utility double")


def _overlaps(flows: DataFrame, named: DataFrame) -> dict[tuple[str, str], float]:
    """Jaccard overlap of each pair of named tokens (token, fresh), at least one fresh, that share a flow. Blocks of flows hold their
    tokens as rows of zeros and ones, whose product with itself counts all pairs at once: no pair of a flow becomes a row."""
    rows = named.collect()
    ids = named.sparkSession.createDataFrame([(r.token, i) for i, r in enumerate(rows)], "token string, i int")
    sets = flows.join(F.broadcast(ids), "token").groupBy("flow_id").agg(F.collect_list("i").alias("held"))
    size = len(rows)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size), np.int64)
        for pdf in batches:
            for low in range(0, len(pdf), 4096):
                held = pdf["held"].iloc[low : low + 4096]
                block = np.zeros((len(held), size), np.float32)
                block[np.repeat(np.arange(len(held)), held.map(len)), np.concatenate(held.to_list())] = 1
                total += (block.T @ block).astype(np.int64)  # at most 4,096 a product, exact in single precision
        x, y = np.nonzero(np.triu(total))
        yield pd.DataFrame({"x": x, "y": y, "c": total[x, y]})

    both = {(r.x, r.y): r.c for r in sets.select("held").mapInPandas(products, "x int, y int, c long").groupBy("x", "y").agg(F.sum("c").alias("c")).collect()}
    fresh = {pair: c for pair, c in both.items() if pair[0] != pair[1] and (rows[pair[0]].fresh or rows[pair[1]].fresh)}
    return {(rows[x].token, rows[y].token): c / (both[x, x] + both[y, y] - c) for (x, y), c in fresh.items()}


def motif_report(stats: DataFrame, chosen: DataFrame, least: float, most: float) -> DataFrame:
    """AGG16: every candidate of stats with its family, rank if chosen, and whether its support put it out."""
    from flowharbor.functions.scalars import motif_family

    rows = stats.join(F.broadcast(chosen.select("token", "rank")), "token", "left")
    return rows.select("token", motif_family(F.col("token")).alias("family"), F.col("rank").isNotNull().alias("selected"), "rank", "utility", ~F.col("support").between(least, most).alias("filtered_by_support"))


def edge_tokens(train: DataFrame, rows: DataFrame, columns: list[str], bins: int) -> DataFrame:
    """TOK06: for each column a token of its quantile bin, edges from train on log1p, right-side search."""
    value = lambda c: F.log1p(F.greatest(F.col(c).cast("double"), F.lit(0.0)))
    at = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    edges = train.agg(*[F.percentile(value(c), at).alias(f"e_{c}") for c in columns])
    joined = rows.crossJoin(F.broadcast(edges))
    below = lambda c: F.size(F.filter(f"e_{c}", lambda e: e <= value(c)))
    made = [F.concat(F.lit(f"{c.upper()}_"), below(c)) for c in columns]
    return joined.select("flow_id", F.explode(F.array(*made)).alias("token"))


def merge_corpora(sources: list[DataFrame]) -> DataFrame:
    """AGG10: one vocabulary of several corpora: id by first (source, flow_id, pos); with the source it came from."""
    union = None
    for i, s in enumerate(sources):
        one = s.select(F.lit(i).alias("source"), "flow_id", "pos", "token")
        union = one if union is None else union.unionByName(one)
    first = union.groupBy("token").agg(F.min(F.struct("source", "flow_id", "pos")).alias("at"), F.count("*").alias("n"))
    placed = running(first, [], ["at"], {"i": F.lit(1).cast("bigint")})
    return placed.select("token", (F.col("i") - 1).alias("id"), F.col("at.source").alias("source"), "n")


def leakage_report(tokens: DataFrame) -> DataFrame:
    """AGG40: flows in more than one split, and tokens that look like an address, a port or a time."""
    over = tokens.groupBy("flow_id").agg(F.count_distinct("split").alias("s")).agg(F.count_if(F.col("s") > 1).alias("bad")).select(F.lit("split_overlap").alias("check"), "bad")
    t = tokens.select("token").distinct()
    kinds = {"ip_token": r"([0-9]{1,3}\.){3}[0-9]{1,3}", "port_token": r"^(SRC|DST)?_?PORT_[0-9]+$", "time_token": r"^(TS|TIME)_[0-9]{9,}"}
    seen = t.agg(*[F.count_if(F.col("token").rlike(p)).alias(k) for k, p in kinds.items()])
    return over.unionByName(seen.select(F.explode(F.map_from_arrays(F.array(*[F.lit(k) for k in kinds]), F.array(*[F.col(k) for k in kinds]))).alias("check", "bad")))


class LeakageError(ValueError):
    """A leakage check that failed."""


def leakage_checks(splits: DataFrame, vocab: DataFrame | None = None, meta: DataFrame | None = None, profile_manifest: dict | None = None, token_manifest: dict | None = None, allow_ports: bool = False) -> DataFrame:
    """AGG40: the leakage checks L1 to L8 as rows (check, ok, bad), bad counting what speaks against it.

    splits (flow_id, split): a flow is listed once only. vocab (token): no token looks like an address, a time or, unless allowed, a port; as
    either of the first two checks asks for a clean vocabulary, all three kinds fail them. meta (flow_id, has_ip_token,
    has_abs_time_token, has_port_token): no flag is set. Manifests say train_only (or a provenance of that name), which splits
    they were fitted on, and which split tuned the threshold (val unless said); a missing one fails. Null flags are unset,
    null tokens are none, an empty table has nothing against it.
    """
    spark = splits.sparkSession
    given = token_manifest or {}

    def fitted(manifest: dict | None) -> bool:
        m = manifest or {}
        return bool((m.get("train_only") or (m.get("provenance") or m.get("vocab_provenance")) == "train_only") and (m.get("splits") or m.get("split_path")))

    flags = [("L2_profile_primitives_train_only", fitted(profile_manifest)), ("L3_vocab_train_only", fitted(token_manifest)), ("L7_val_test_not_used_for_training_stats", bool(given.get("train_only"))), ("L8_test_not_used_for_threshold_tuning", given.get("threshold_tuning_split", "val") == "val")]
    out = splits.agg((F.count("flow_id") - F.count_distinct("flow_id")).alias("bad")).select(F.lit("L1_flow_id_disjoint").alias("check"), (F.col("bad") == 0).alias("ok"), "bad")
    out = out.unionByName(spark.createDataFrame([(name, ok, int(not ok)) for name, ok in flags], "check string, ok boolean, bad long"))
    if vocab is not None:
        token = F.col("token")
        n = vocab.agg(F.count_if(S.looks_like_ip(token)).alias("ip"), F.count_if(S.is_time_token(token)).alias("time"), F.count_if(S.is_port_token(token)).alias("port"))
        ports = F.lit(allow_ports) | (F.col("port") == 0)
        clean = (F.col("ip") == 0) & (F.col("time") == 0) & ports
        rows = [("L4_vocab_no_raw_ip", clean, "ip"), ("L5_vocab_no_abs_time", clean, "time"), ("L6_vocab_no_raw_port", ports, "port")]
        out = out.unionByName(n.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), ok.alias("ok"), F.col(bad).alias("bad")) for c, ok, bad in rows]))))
    if meta is not None:
        flagged = F.col("has_ip_token") | F.col("has_abs_time_token") | (F.col("has_port_token") & F.lit(not allow_ports))
        out = out.unionByName(meta.na.fill(False, ["has_ip_token", "has_abs_time_token", "has_port_token"]).agg(F.count_if(flagged).alias("bad")).select(F.lit("L4_L5_L6_token_meta_flags").alias("check"), (F.col("bad") == 0).alias("ok"), "bad"))
    return out


def assert_no_leakage(report: DataFrame) -> None:
    """AGG40: raise LeakageError with the names of the failed checks of `leakage_checks`, at most ten rows."""
    failed = sorted(r.check for r in report.where("NOT ok").select("check").collect())
    if failed:
        raise LeakageError(f"leakage: {', '.join(failed)}")
