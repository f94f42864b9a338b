"""Scans and sinks: packet CSV, sensor logs (JSON lines and TSV), label CSVs, windows, indicator lists, result files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowharbor.functions import scalars as S
from flowharbor.operators.flows import expand_conn
from flowharbor.operators.labels import enrich_by_uid

#: Timestamp formats of the label feeds, in the order tried. Years first, month first and day first as the first feed has them; day first in the second.
_CLOCKS, _TWELVE = (" H:m:s.SSSSSS", " H:m:s.SSS", " H:m:s"), (" h:m:s.SSSSSS a", " h:m:s a")
LABEL_FORMATS = [
    *["yyyy-M-d" + c for c in _CLOCKS], *["yyyy/M/d" + c for c in _CLOCKS], *["M/d/yyyy" + c for c in (*_CLOCKS, *_TWELVE)], *["d/M/yyyy" + c for c in (*_CLOCKS, *_TWELVE)], "yyyy-M-d H:m", "yyyy/M/d H:m", "M/d/yyyy H:m", "d/M/yyyy H:m",
]
DAY_FIRST_FORMATS = [*["d/M/yyyy" + c for c in (*_CLOCKS, *_TWELVE)], *["yyyy-M-d" + c for c in _CLOCKS]]


def _usable(df: DataFrame) -> DataFrame:
    return df.where("src_ip <> '' AND dst_ip <> '' AND timestamp IS NOT NULL AND length IS NOT NULL")


def read_packet_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC01: packet CSV with tool-style column names; the label is the file's folder; rows without addresses, time or length go."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path).withColumn("_file", F.col("_metadata.file_path"))
    raw = raw.toDF(*[c.replace(".", "_") for c in raw.columns])
    pick = lambda *n: S.first_of(raw, *n)
    tcp = pick("tcp_srcport") != ""
    rows = raw.select(
        pick("frame_time_epoch").try_cast("double").alias("timestamp"), pick("frame_len").try_cast("double").cast("int").alias("length"), pick("ip_src", "ipv6_src").alias("src_ip"), pick("ip_dst", "ipv6_dst").alias("dst_ip"),
        pick("tcp_srcport", "udp_srcport").alias("src_port"), pick("tcp_dstport", "udp_dstport").alias("dst_port"), F.when(tcp, "TCP").when(pick("udp_srcport") != "", "UDP").otherwise("OTHER").alias("protocol"),
        F.element_at(F.split("_file", "/"), -2).alias("label"), F.monotonically_increasing_id().alias("seq"),
    )
    return _usable(rows)


def packets_of(raw: DataFrame) -> DataFrame:
    """Sensor rows under any of their aliases as packets."""
    pick = lambda *n: S.first_of(raw, *n)
    flag = pick("is_orig")
    return raw.select(
        pick("timestamp", "ts", "time").try_cast("double").alias("timestamp"), pick("srcip", "id.orig_h", "id_orig_h", "src_ip").alias("src_ip"), pick("srcport", "id.orig_p", "id_orig_p", "src_port").alias("src_port"),
        pick("dstip", "id.resp_h", "id_resp_h", "dst_ip").alias("dst_ip"), pick("dstport", "id.resp_p", "id_resp_p", "dst_port").alias("dst_port"), S.norm_protocol(pick("proto", "protocol"), "log").alias("protocol"),
        S.to_int(pick("applayerlength", "length", "len")).cast("int").alias("length"), F.when(flag != "", S.parse_is_orig(flag)).alias("is_orig"), pick("appinfo", "service").alias("appinfo"), pick("uid").alias("uid"),
    )


def read_sensor_json(spark: SparkSession, path: str) -> DataFrame:
    """SRC02: JSON lines; blank lines and # comments go. All fields are read as text."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")
    return packets_of(lines_to_columns(lines))


def lines_to_columns(lines: DataFrame) -> DataFrame:
    parsed = lines.select(F.from_json("value", "map<string,string>").alias("m"))
    keys = [r.k for r in parsed.select(F.explode(F.map_keys("m")).alias("k")).distinct().collect()]
    return parsed.select(*[F.col("m")[k].alias(k) for k in sorted(keys)])


def read_sensor_tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """SRC03: TSV logs whose #fields, #empty_field and #unset_field differ by file; empty and unset become ''."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    head = raw.where("startswith(value, '#')").select("file", F.split("value", "\t").alias("p"))
    one = lambda key: F.max(F.when(F.col("p")[0] == key, F.slice("p", 2, 1000)))
    heads = head.groupBy("file").agg(one("#fields").alias("fields"), F.coalesce(one("#empty_field")[0], F.lit("(empty)")).alias("empty"), F.coalesce(one("#unset_field")[0], F.lit("-")).alias("unset"))
    names = sorted({r.f for r in heads.select(F.explode("fields").alias("f")).distinct().collect()})
    body = raw.where("trim(value) <> '' AND NOT startswith(value, '#')").join(F.broadcast(heads), "file")
    cells = F.map_from_arrays("fields", F.transform(F.slice(F.split("value", "\t", -1), F.lit(1), F.size("fields")), lambda x: F.when((x == F.col("empty")) | (x == F.col("unset")), "").otherwise(x)))
    return body.select("file", cells.alias("m")).select("file", *[F.coalesce(F.col("m")[n], F.lit("")).alias(n) for n in names])


def log_formats(spark: SparkSession, path: str) -> dict[str, str]:
    """SRC04: {file: json or tsv}: by extension, else json where the first line that is not blank begins with a brace. A row a file reaches the driver."""
    lines = spark.read.text(path).where("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.ltrim("value").alias("v"), F.monotonically_increasing_id().alias("i"))
    first = lines.groupBy("file").agg(F.min_by("v", "i").alias("v")).select("file", (F.lower("file").rlike(r"\.(json|jsonl|ndjson)$") | F.startswith("v", F.lit("{"))).alias("json"))
    return {r.file: "json" if r.json else "tsv" for r in first.collect()}


def read_sensor_rows(spark: SparkSession, path: str) -> DataFrame:
    """SRC04: rows of sensor logs of both formats under all their columns; a column that a format lacks is null."""
    formats, parts = log_formats(spark, path), []
    if files := [f for f, kind in formats.items() if kind == "json"]:
        parts.append(lines_to_columns(spark.read.text(files).where("trim(value) <> '' AND NOT startswith(ltrim(value), '#')")))
    if files := [f for f, kind in formats.items() if kind == "tsv"]:
        parts.append(read_sensor_tsv(spark, files).drop("file"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_sensor_packets(spark: SparkSession, path: str) -> DataFrame:
    """SRC05: packets of sensor logs: packet rows, their empty protocol and service filled from the connection row of the same uid; if
    there is no packet row at all, packets made up from the connection rows."""
    raw = read_sensor_rows(spark, path)
    pick = lambda *n: S.first_of(raw, *n)
    conns = raw.where(S.is_conn_row(raw))
    if raw.where(S.is_packet_row(raw)).isEmpty():
        ends = packets_of(conns).select("uid", "src_ip", "src_port", "dst_ip", "dst_port", "protocol", "appinfo")
        counts = conns.select(pick("uid").alias("uid"), pick("ts", "timestamp", "time").try_cast("double").alias("ts"), S.to_double(pick("duration")).alias("duration"), *[S.to_int(pick(c)).cast("int").alias(c) for c in ("orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes")], pick("service", "appinfo").alias("service"))
        return _usable(expand_conn(counts).drop("service").join(ends.dropDuplicates(["uid"]), "uid"))
    packets = packets_of(raw.where(~S.is_conn_row(raw)))
    known = conns.select(pick("uid").alias("uid"), S.norm_protocol(pick("proto", "protocol"), "log").alias("proto"), pick("service", "appinfo").alias("service"), F.monotonically_increasing_id().alias("seq")).where("uid <> ''")
    filled = enrich_by_uid(packets.withColumnRenamed("appinfo", "service"), known).withColumnRenamed("service", "appinfo")
    return _usable(filled.withColumn("seq", F.monotonically_increasing_id()))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC06: flow or score rows of JSON lines under a given schema; a line that does not fit gives nulls."""
    return spark.read.schema(schema).json(path)


def read_labels(spark: SparkSession, path: str, policy: str = "keep", formats: list[str] | None = None) -> DataFrame:
    """SRC07/08: flow-meter label CSVs: key, times, status, label under the attempted policy, raw label, source file."""
    raw = spark.read.option("header", True).csv(path).withColumn("source_file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    raw = raw.toDF(*[c.strip().lower().replace(" ", "_") for c in raw.columns])
    pick = lambda *n: S.first_of(raw, *n)
    ts, took = S.parse_ts(pick("timestamp"), formats or LABEL_FORMATS), S.norm_duration(S.to_double(pick("flow_duration", "duration")))
    key = S.canonical_key(pick("source_ip", "src_ip"), pick("source_port", "src_port"), pick("destination_ip", "dst_ip"), pick("destination_port", "dst_port"), S.norm_protocol(pick("protocol")))
    rows = raw.select(key["key"].alias("key"), ts.alias("t"), took.alias("took"), S.attempted_policy(pick("label"), policy).alias("label"), pick("label").alias("raw_label"), "source_file")
    return rows.where("label IS NOT NULL").select("key", F.col("t.epoch").alias("start_ts"), (F.col("t.epoch") + F.col("took")).alias("end_ts"), F.col("t.status").alias("timestamp_parse_status"), "label", "raw_label", "source_file")


def read_csv_union(spark: SparkSession, paths: list[str], most: int | None = None) -> DataFrame:
    """SRC10: several CSVs with ragged, stripped columns in one, with their source; at most `most` rows of each."""
    parts = []
    for p in paths:
        df = spark.read.option("header", True).csv(p)
        df = df.toDF(*[c.strip() for c in df.columns])
        parts.append((df.limit(most) if most else df).withColumn("source", F.lit(p)))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_attack_windows(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: schedule CSV, or JSON (a list, or under `windows`), to windows; ends before their starts are on the next day; repeats go; sorted by start."""
    if path.endswith(".json"):
        raw = spark.read.option("multiLine", True).json(path)
        raw = raw.select(F.explode("windows").alias("w")).select("w.*") if "windows" in raw.columns else raw
        raw = raw.withColumns({c: F.array_join(c, ",") for c in ("attacker_ips", "victim_ips") if dict(raw.dtypes)[c].startswith("array")})
    else:
        raw = spark.read.option("header", True).csv(path)
    at = lambda c: F.try_to_timestamp(F.concat_ws(" ", "iso_date", c), F.lit("yyyy-MM-dd H:mm")).cast("double")
    ends = lambda c: F.regexp_extract_all(F.col(c), F.lit(r"([0-9]{1,3}(?:\.[0-9]{1,3}){3})"))
    rows = raw.withColumns({"start_ts": at("start_time"), "stop": at("finish_time"), "attackers": F.array_distinct(ends("attacker_ips")), "victims": F.array_distinct(ends("victim_ips"))})
    rows = rows.withColumn("end_ts", F.when(F.col("stop") < F.col("start_ts"), F.col("stop") + 86400).otherwise(F.col("stop")))
    return rows.select("window_id", F.col("attack_family").alias("family"), "start_ts", "end_ts", "attackers", "victims").dropDuplicates().orderBy("start_ts", "window_id")


def read_ip_list(spark: SparkSession, path: str) -> DataFrame:
    """SRC12: the distinct valid IPv4 addresses in text files."""
    found = spark.read.text(path).select(F.explode(F.regexp_extract_all("value", F.lit(r"(?<![0-9.])([0-9]{1,3}(?:\.[0-9]{1,3}){3})(?![0-9.])"))).alias("ip"))
    return found.where(F.forall(F.split("ip", r"\."), lambda x: x.cast("int") <= 255)).distinct()


def profile_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC17: rows, columns and distinct first-column values of each file, from the files themselves."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where("value <> ''")
    return raw.groupBy("file").agg((F.count("*") - 1).alias("rows"), F.max(F.size(F.split("value", ","))).alias("columns"), F.approx_count_distinct(F.split("value", ",")[0]).alias("distinct_first"))


def profile_values(spark: SparkSession, path: str, columns: list[str], time: str | None = None) -> DataFrame:
    """SRC17: (file, column, value, n) histograms of some columns of CSV files with headers, by any of their spellings' case, and under the
    column `time`, if named, its first and last value."""
    raw = spark.read.option("header", True).csv(path).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
    raw = raw.toDF(*[c.strip().lower() for c in raw.columns])
    counted = raw.select("file", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.trim(F.col(f"`{c.lower()}`").cast("string")) for c in columns]))).alias("column", "value"))
    out = counted.groupBy("file", "column", "value").agg(F.count("*").alias("n"))
    if time:
        ends = raw.groupBy("file").agg(F.min(f"`{time.lower()}`").alias("a"), F.max(f"`{time.lower()}`").alias("b"), F.count("*").alias("n"))
        out = out.unionByName(ends.select("file", F.lit(time).alias("column"), F.explode(F.array("a", "b")).alias("value"), "n"))
    return out


def write_result(df: DataFrame | list[DataFrame], path: str, fmt: str = "json") -> None:
    """SRC06, SRC16: result files, with a header in CSV; several tables go in one under the union of their columns."""
    if isinstance(df, list):
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), df)
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)


def write_feature_matrix(long: DataFrame, path: str) -> None:
    """SRC15: features in long form (feature_set, flow_id, feature, value), a folder a feature set, and beside it in `path`_schema the
    features of each set with their numbers of flows, as JSON."""
    long.write.mode("overwrite").partitionBy("feature_set").parquet(path)
    sets = long.groupBy("feature_set").agg(F.array_sort(F.collect_set("feature")).alias("features"), F.count_distinct("flow_id").alias("flows"))
    sets.coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}_schema")


def capped_by_file(df: DataFrame, most: int) -> DataFrame:
    """SRC09: the first `most` rows of each file (column file) by seq."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy("file").orderBy("seq"))).where(F.col("nth") <= most).drop("nth")
