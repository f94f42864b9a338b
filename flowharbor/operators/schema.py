"""One schema for flows of any source, unions and cuts of flow tables, token corpora, tabular features of flow-meter and sensor rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S


def _have(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def normalize_flows(df: DataFrame, dataset: str = "CICIDS2017", most: int | None = None) -> DataFrame:
    """SCA18: flows of any source in one schema: missing columns and nulls get their defaults (addresses '', ports '0', protocol tcp),
    labels their binary class and family, arrays their types; gaps are made from times if there are none, arrays cut at `most`."""
    text = lambda c, default="": F.coalesce(F.nullif(_have(df, c, "string"), F.lit("")), F.lit(default))
    array = lambda c, kind: F.coalesce(_have(df, c, f"array<{kind}>"), F.array().cast(f"array<{kind}>"))
    cut = (lambda c: F.slice(c, 1, most)) if most else (lambda c: c)
    label = S.norm_label(F.coalesce(F.nullif(_have(df, "label", "string"), F.lit("")), F.nullif(_have(df, "attack_family", "string"), F.lit("")), F.lit("UNKNOWN")))
    proto = F.lower(F.coalesce(F.nullif(_have(df, "proto", "string"), F.lit("")), F.nullif(_have(df, "protocol", "string"), F.lit("")), F.lit("tcp")))
    lens, tss, given = F.transform(array("lens", "double"), lambda x: x.cast("int")), array("tss", "double"), array("iats", "double")
    day = S.infer_day(text("day"), F.coalesce(F.nullif(_have(df, "label_source_file", "string"), F.lit("")), _have(df, "source_file", "string"), F.lit("")))
    meta = [c for c in ("label_source_file", "source_file", "raw_label") if c in df.columns]
    held = F.map_filter(F.create_map(*[x for c in meta for x in (F.lit(c), _have(df, c, "string"))]), lambda k, v: v.isNotNull()) if meta else F.create_map().cast("map<string,string>")
    service = F.array(text("dst_ip"), text("dst_port", "0"), F.upper(proto))
    return df.select(
        _have(df, "flow_id", "string").alias("flow_id"), text("dataset", dataset).alias("dataset"), text("src_ip").alias("src_ip"), text("dst_ip").alias("dst_ip"), text("src_port", "0").alias("src_port"), text("dst_port", "0").alias("dst_port"),
        proto.alias("proto"), F.upper(proto).alias("protocol"), cut(lens).alias("lens"), cut(F.transform(array("dirs", "double"), lambda x: (x != 0).cast("int"))).alias("dirs"), cut(tss).alias("tss"), cut(F.when(F.size(given) > 0, given).otherwise(S.iats(tss))).alias("iats"),
        label.alias("label"), S.binary_label(label).alias("binary_label"), S.attack_family(F.coalesce(F.nullif(_have(df, "attack_family", "string"), F.lit("")), label)).alias("attack_family"), day.alias("day"), _have(df, "split", "string").alias("split"),
        *[_have(df, c, "double").alias(c) for c in ("start_ts", "end_ts", "duration")], F.coalesce(F.nullif(_have(df, "packet_count", "int"), F.lit(0)), F.size(lens)).alias("packet_count"), F.coalesce(_have(df, "service_key", "array<string>"), service).alias("service_key"), held.alias("meta"),
    )


def adapt_array_records(df: DataFrame) -> DataFrame:
    """SRC14: records of fixed-length arrays (packet_sizes, packet_directions, packet_iats, packet_mask) as flows: masked-out packets go, times
    are running sums of the gaps, directions 1 from 0 up, lengths without sign."""
    kept = lambda c: F.transform(F.filter(F.arrays_zip(F.col(c).alias("v"), F.col("packet_mask").alias("m")), lambda x: x["m"].cast("int") != 0), lambda x: x["v"])
    gaps = F.transform(kept("packet_iats"), lambda x: x.cast("double"))
    sums = F.aggregate(gaps, F.array().cast("array<double>"), lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)))))
    rest = [c for c in df.columns if c not in ("packet_sizes", "packet_directions", "packet_iats", "packet_mask")]
    return df.select(*rest, F.transform(kept("packet_sizes"), lambda x: F.abs(x).cast("int")).alias("lens"), F.transform(kept("packet_directions"), lambda x: (x >= 0).cast("int")).alias("dirs"), sums.alias("tss"), gaps.alias("iats"))


def load_token_corpus(df: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """SRC13: (flow_id, tokens, split, label, score) of rows that hold tokens, behavior_tokens or token_sequence; or, with a vocabulary
    (token, id), input_ids and attention_mask, decoded: ids without a token are [UNK], masked ones go."""
    first = lambda kind, *names: F.coalesce(*[_have(df, n, kind) for n in names])
    ids = F.coalesce(first("string", "flow_id", "id"), F.sha1(F.to_json(F.struct("*"))))
    facts = [F.coalesce(first("string", "split"), F.lit("")).alias("split"), first("string", "binary_label", "label").alias("label"), first("double", "score", "anomaly_score").alias("score")]
    if vocab is None:
        tokens = F.coalesce(*[F.when(F.size(_have(df, n, "array<string>")) > 0, _have(df, n, "array<string>")) for n in ("tokens", "behavior_tokens", "token_sequence")], F.array().cast("array<string>"))
        return df.select(ids.alias("flow_id"), tokens.alias("tokens"), *facts)
    rows = df.select(ids.alias("flow_id"), *facts, F.col("input_ids").alias("ids"), F.col("attention_mask").alias("mask"))
    long = rows.select("flow_id", F.posexplode(F.arrays_zip("ids", "mask")).alias("pos", "x")).where("x.mask > 0").select("flow_id", "pos", F.col("x.ids").alias("id"))
    named = long.join(vocab.select("id", "token"), "id", "left").select("flow_id", "pos", F.coalesce("token", F.lit("[UNK]")).alias("token"))
    tokens = named.groupBy("flow_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]).alias("tokens"))
    return rows.drop("ids", "mask").join(tokens, "flow_id", "left").select("flow_id", F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), "split", "label", "score")


def filter_corpus(df: DataFrame, label: str | None = None, binary_label: str | None = None, max_rows: int | None = None, order: str = "flow_id") -> DataFrame:
    """SRC19: rows of exactly one label or binary label, whatever its case; at most max_rows of them by `order`."""
    if (label is None) == (binary_label is None):
        raise ValueError("give exactly one of label and binary_label")
    rows = df.where(F.lower("label" if label is not None else "binary_label") == (label if label is not None else binary_label).lower())
    return rows.orderBy(order).limit(max_rows) if max_rows is not None else rows


def union_sources(**sources: DataFrame) -> DataFrame:
    """SET01: tables in one, each row with the name of the one it came from; columns that a table lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_name", F.lit(name)) for name, df in sources.items()])


def common_keys(flows: DataFrame, labels: DataFrame, key: str = "key") -> DataFrame:
    """SET04: the distinct keys that both have."""
    return flows.select(key).distinct().join(labels.select(key), key, "left_semi")


def flow_heads(flows: DataFrame, ids: DataFrame, arrays: tuple[str, ...], most: int) -> DataFrame:
    """JOI19: the flows whose flow_id is wanted, with only the first `most` elements of these arrays: what an audit reads again and again."""
    wanted = flows.join(ids.select("flow_id").distinct(), "flow_id", "left_semi")
    return wanted.select(*[F.slice(c, 1, most).alias(c) if c in arrays else F.col(f"`{c}`") for c in flows.columns])


#: One-hot groups of the shared features; what fits no bucket is other, a missing value none where there is one.
BUCKETS = {"proto": ("tcp", "udp", "icmp", "other"), "service": ("none", "dns", "ftp", "http", "smtp", "ssh", "ssl", "snmp", "other"), "state": ("none", "fin", "con", "int", "req", "rst", "other")}
#: The columns of the two flow-meter schemas, in the order of MEASURES; times are microseconds.
MEASURES = ("duration", "fwd_packets", "bwd_packets", "fwd_bytes", "bwd_bytes", "flow_iat_mean", "flow_iat_std", "flow_iat_max", "flow_iat_min", "fwd_iat_mean", "bwd_iat_mean", "packet_length_mean", "packet_length_std", "packet_length_max", "packet_length_min", "fwd_packet_length_mean", "bwd_packet_length_mean")
COLUMNS = {
    "meter2017": ("Flow Duration", "Total Fwd Packet", "Total Bwd packets", "Total Length of Fwd Packet", "Total Length of Bwd Packet", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Mean", "Bwd IAT Mean", "Packet Length Mean", "Packet Length Std", "Packet Length Max", "Packet Length Min", "Fwd Packet Length Mean", "Bwd Packet Length Mean"),
    "meter2018": ("Flow Duration", "Tot Fwd Pkts", "Tot Bwd Pkts", "TotLen Fwd Pkts", "TotLen Bwd Pkts", "Flow IAT Mean", "Flow IAT Std", "Flow IAT Max", "Flow IAT Min", "Fwd IAT Mean", "Bwd IAT Mean", "Pkt Len Mean", "Pkt Len Std", "Pkt Len Max", "Pkt Len Min", "Fwd Pkt Len Mean", "Bwd Pkt Len Mean"),
}


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def two_side_moments(smean: Column, spkts: Column, dmean: Column, dpkts: Column) -> Column:
    """SCA32: struct(mean, std, min, max) of packet lengths from both sides' means and counts; a mean of 0 is no minimum."""
    total = spkts + dpkts
    mean = _share(smean * spkts + dmean * dpkts, total)
    var = _share(spkts * (smean - mean) * (smean - mean) + dpkts * (dmean - mean) * (dmean - mean), total)
    least = F.coalesce(F.least(F.nullif(smean, F.lit(0.0)), F.nullif(dmean, F.lit(0.0))), F.lit(0.0))
    return F.struct(mean.alias("mean"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("std"), least.alias("min"), F.greatest(smean, dmean).alias("max"))


def meter_state(proto: Column, fin: Column, syn: Column, rst: Column, psh: Column, ack: Column) -> Column:
    """SCA33: the state that TCP flag counters tell: fin, else rst, else con once acknowledged or pushed, else req; none for other protocols."""
    return F.when(proto != "tcp", "none").when(fin > 0, "fin").when(rst > 0, "rst").when((ack > 0) | (psh > 0), "con").when(syn > 0, "req").otherwise("other")


def shared_features(df: DataFrame, source: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """SCA31: 31 numbers and 20 one-hot columns that the three tabular schemas share: meter2017, meter2018 and argus (the 49-column
    one, by its header). Missing and unreadable numbers are 0; `keep` names columns to carry along."""
    def num(name: str, default: float = 0.0) -> Column:
        value = _have(df, name, "string").try_cast("double")
        return F.when(value.isNull() | F.isnan(value) | (F.abs(value) == float("inf")), F.lit(default)).otherwise(value)

    if source in COLUMNS:
        m = {name: num(column) / (1e6 if name == "duration" or "iat" in name else 1.0) for name, column in zip(MEASURES, COLUMNS[source], strict=True)}
        proto = F.coalesce(F.create_map(F.lit(6), F.lit("tcp"), F.lit(17), F.lit("udp"), F.lit(1), F.lit("icmp"))[F.bround(num("Protocol", -1.0)).cast("int")], F.lit("other"))
        service = S.service_from_port(_have(df, "Dst Port", "string"))
        state = meter_state(proto, *[num(f"{x} Flag Count") for x in ("FIN", "SYN", "RST", "PSH", "ACK")])
    elif source == "argus":
        s, d, took = num("spkts"), num("dpkts"), num("dur")
        sizes = two_side_moments(num("smean"), s, num("dmean"), d)
        i, j = num("sinpkt") / 1000, num("dinpkt") / 1000
        m = {
            "duration": took, "fwd_packets": s, "bwd_packets": d, "fwd_bytes": num("sbytes"), "bwd_bytes": num("dbytes"), "flow_iat_mean": took / F.greatest(s + d - 1, F.lit(1.0)), "flow_iat_std": (num("sjit") + num("djit")) / 2000, "flow_iat_max": F.greatest(i, j), "flow_iat_min": F.least(i, j),
            "fwd_iat_mean": i, "bwd_iat_mean": j, "packet_length_mean": sizes["mean"], "packet_length_std": sizes["std"], "packet_length_max": sizes["max"], "packet_length_min": sizes["min"], "fwd_packet_length_mean": num("smean"), "bwd_packet_length_mean": num("dmean"),
        }
        word = lambda c, default: F.lower(F.trim(F.coalesce(_have(df, c, "string"), F.lit(default))))
        proto = word("proto", "other")
        service = F.when(word("service", "-") == "-", "none").when(word("service", "-") == "ftp-data", "ftp").otherwise(word("service", "-"))
        state = F.when(word("state", "none").isin("fin", "con", "int", "req", "rst"), word("state", "none")).otherwise("other")
    else:
        raise ValueError(f"unknown source {source}")
    base = df.select(*[F.col(f"`{c}`") for c in keep], *[c.alias(f"m_{n}") for n, c in m.items()], proto.alias("k_proto"), service.alias("k_service"), state.alias("k_state"))
    c = {n: F.col(f"m_{n}") for n in m}
    packets, size = c["fwd_packets"] + c["bwd_packets"], c["fwd_bytes"] + c["bwd_bytes"]
    log = lambda x: F.log1p(F.greatest(x, F.lit(0.0)))
    made = {"duration": c["duration"], "fwd_packets": c["fwd_packets"], "bwd_packets": c["bwd_packets"], "total_packets": packets, "fwd_bytes": c["fwd_bytes"], "bwd_bytes": c["bwd_bytes"], "total_bytes": size}
    made |= {"packet_rate": _share(packets, c["duration"]), "byte_rate": _share(size, c["duration"])}
    made |= {f"{w}_{u}_rate": _share(c[f"{w}_{u}s"], c["duration"]) for u in ("packet", "byte") for w in ("fwd", "bwd")}
    made |= {n: c[n] for n in MEASURES[5:]}
    clip = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), F.lit(float(most)))
    rest = {"down_up_ratio": clip(_share(c["bwd_packets"], c["fwd_packets"]), 1000)} | {f"{w}_{u}_fraction": clip(_share(c[f"{w}_{u}s"], total), 1) for u, total in (("packet", packets), ("byte", size)) for w in ("fwd", "bwd")} | {"short_flow_flag": (packets <= 4).cast("double")}
    hot = {f"{kind}_{b}": ((F.col(f"k_{kind}") == b) if b != "other" else ~F.col(f"k_{kind}").isin(*[x for x in names if x != "other"])).cast("double") for kind, names in BUCKETS.items() for b in names}
    return base.select(*[F.col(f"`{x}`") for x in keep], *[log(x).alias(f"log_{n}") for n, x in made.items()], *[x.alias(n) for n, x in rest.items()], *[x.alias(n) for n, x in hot.items()])


def first_rows(df: DataFrame, most: int, by: str, order: str) -> DataFrame:
    """SRC09: the first `most` rows of each value of `by`."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("nth") <= most).drop("nth")
