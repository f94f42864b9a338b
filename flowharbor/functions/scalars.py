"""Column functions: clean-up, keys, labels, bins, ports, score shapes. All run inside Spark's expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BENIGN = "BENIGN"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def first_of(df: DataFrame, *names: str, default: str = "") -> Column:
    """SCA01: the first of these columns that df has and that is not empty."""
    have = {c.lower(): c for c in df.columns}
    found = [F.nullif(F.trim(F.col(f"`{have[n.lower()]}`").cast("string")), F.lit("")) for n in names if n.lower() in have]
    return F.coalesce(*found, F.lit(default))


def to_double(c: Column, default: float = 0.0) -> Column:
    """SCA04: a number or the default."""
    return F.coalesce(c.cast("string").try_cast("double"), F.lit(default))


def to_int(c: Column, default: int = 0) -> Column:
    """SCA04: a whole number, read through double and cut towards zero."""
    return F.coalesce(c.cast("string").try_cast("double").try_cast("bigint"), F.lit(default)).cast("bigint")


def norm_protocol(c: Column, variant: str = "numbers") -> Column:
    """SCA03: protocol numbers and names in one spelling, by source. numbers: 6, 17 and 1 named, also as decimals; log, schedule:
    the same, empty is TCP; flowmeter: 1 stays, empty is TCP; token: OTHER for all but the three; lower: lower case, empty is unknown."""
    up = F.upper(F.trim(c.cast("string")))
    named = F.when(up.isin("6", "6.0", "TCP"), "TCP").when(up.isin("17", "17.0", "UDP"), "UDP")
    icmp = named.when(up.isin("1", "1.0", "ICMP"), "ICMP")
    filled = F.coalesce(F.nullif(up, F.lit("")), F.lit("TCP"))
    return {"numbers": icmp.otherwise(up), "log": icmp.otherwise(filled), "schedule": icmp.otherwise(filled), "flowmeter": named.otherwise(filled), "token": icmp.otherwise("OTHER"), "lower": F.lower(F.coalesce(F.nullif(icmp.otherwise(up), F.lit("")), F.lit("unknown")))}[variant]


def is_packet_row(df: DataFrame) -> Column:
    """SCA02: rows that hold a packet's length under one of its names."""
    return _any_filled(df, "applayerlength", "length", "frame_len", "frame.len")


def is_conn_row(df: DataFrame) -> Column:
    """SCA02: rows that hold a connection's counters."""
    return _any_filled(df, "orig_pkts", "resp_pkts", "orig_bytes", "resp_bytes", "orig_ip_bytes", "resp_ip_bytes")


def _any_filled(df: DataFrame, *names: str) -> Column:
    return reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in df.columns if c in names], F.lit(False))


def parse_is_orig(c: Column) -> Column:
    """SCA05: text flag of the originating side."""
    return F.lower(F.trim(c.cast("string"))).isin("true", "t", "1", "orig", "c2s")


def parse_ts(c: Column, formats: list[str]) -> Column:
    """SCA06: struct(epoch, status): numeric text, else the first format that fits, in UTC."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    stamps = [F.try_to_timestamp(text, F.lit(f)).cast("double") for f in formats]
    parsed = F.coalesce(*stamps) if stamps else F.lit(None).cast("double")
    status = F.when(text.isNull() | (text == ""), "missing").when(number.isNotNull(), "parsed_numeric").when(parsed.isNotNull(), "parsed").otherwise("invalid")
    return F.struct(F.coalesce(number, parsed).alias("epoch"), status.alias("status"))


#: Dates of official schedules, with or without a weekday before them.
SCHEDULE_DATE = r"([0-9]{1,2}-[0-9]{1,2}-[0-9]{4})\s*$"


def schedule_epoch(date: Column, clock: Column, offset: float = 14400.0) -> Column:
    """SCA08: epoch seconds of a schedule's date (d-m-y, a weekday before it or not) and clock (h:m), moved by a fixed offset; null if either does not fit."""
    day = F.regexp_extract(F.trim(date), SCHEDULE_DATE, 1)
    return F.try_to_timestamp(F.concat_ws(" ", day, F.trim(clock)), F.lit("d-M-yyyy H:m")).cast("double") + offset


def norm_duration(c: Column) -> Column:
    """SCA07: durations over 10000 are taken for microseconds."""
    return F.when(c > 10000, c / 1e6).otherwise(c)


def canonical_key(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    """SCA09: struct(key, is_fwd): the smaller of the five-tuple and its reverse, and whether it is the tuple itself."""
    fwd = F.struct(src.alias("a"), sport.alias("ap"), dst.alias("b"), dport.alias("bp"), proto.alias("proto"))
    rev = F.struct(dst.alias("a"), dport.alias("ap"), src.alias("b"), sport.alias("bp"), proto.alias("proto"))
    return F.struct(F.least(fwd, rev).alias("key"), (fwd <= rev).alias("is_fwd"))


def reverse_key(key: Column) -> Column:
    """SCA10: the key with its ends swapped."""
    return F.struct(key["b"].alias("a"), key["bp"].alias("ap"), key["a"].alias("b"), key["ap"].alias("bp"), key["proto"].alias("proto"))


def stable_id(*cols: Column, n: int = 20) -> Column:
    """SCA11: the first n hex digits of the SHA-1 of the values, joined by |."""
    return F.substring(F.sha1(F.concat_ws("|", *[c.cast("string") for c in cols])), 1, n)


def norm_label(c: Column) -> Column:
    """SCA12: white space collapsed; empty is UNKNOWN."""
    return F.coalesce(F.nullif(F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), " +", " "), F.lit("")), F.lit("UNKNOWN"))


def is_benign(c: Column) -> Column:
    return F.lower(norm_label(c)).isin("benign", "normal", "benign traffic")


def binary_label(c: Column) -> Column:
    return F.when(is_benign(c), BENIGN).otherwise("ATTACK")


def attempted_policy(c: Column, policy: str = "keep") -> Column:
    """SCA13: what becomes of labels that mark an attempt: keep, drop (null), attack (base label) or benign."""
    if policy not in ("keep", "drop", "attack", "benign"):
        raise ValueError(f"unknown policy {policy}")
    label = norm_label(c)
    attempted = F.lower(label).startswith("attempted") | F.lower(label).contains(" attempted")
    # fixed values: the word and the marks around it that the base label goes without
    base = F.regexp_replace(F.regexp_replace(label, r"(?i)\battempted\b", ""), r"^[\s:_/\\-]+|[\s:_/\\-]+$", "")
    then = {"keep": label, "drop": F.lit(None).cast("string"), "benign": F.lit(BENIGN), "attack": F.coalesce(F.nullif(F.regexp_replace(base, r"\s+", " "), F.lit("")), F.lit("Attempted"))}
    return F.when(attempted, then[policy]).otherwise(label)


#: Ordered rules of the merged label taxonomy: family, any of these parts, and any of these beside it (none: no matter).
MERGED_RULES = (
    ("DDoS", ("ddos",), ()),
    ("DoS", ("dos attacks", "dos hulk", "slowhttptest", "slowloris", "goldeneye", "hulk"), ()),
    ("Infiltration", ("infiltration", "infilteration"), ()),
    ("Bot", ("bot",), ()),
    ("BruteForce", ("ftp-bruteforce", "ssh-bruteforce", "ftp-patator", "ssh-patator"), ()),
    ("WebAttack", ("brute force", "bruteforce"), ("web", "xss", "sql")),
    ("WebAttack", ("sql injection", "web attack", "webattack"), ()),
    ("PortScan", ("portscan",), ()),
    ("Heartbleed", ("heartbleed",), ()),
)
#: Whole labels, white space left out, that no rule covers.
MERGED_WHOLE = {"bruteforce": "WebAttack", "xss": "WebAttack", "sqlinjection": "WebAttack"}
#: Families of the canonical taxonomy.
FAMILIES = (
    "BENIGN", "DoS", "DDoS", "Probe", "BruteForce", "Botnet", "WebAttack", "Infiltration", "Exfiltration", "Generic",
    "Exploit", "Fuzzers", "Analysis", "Backdoor", "Shellcode", "Worms", "OtherAttack", "Heartbleed",
)


def merged_label(c: Column) -> Column:
    """SCA14: the merged taxonomy: the first rule with a part in the label (with or without its white space), else a whole label, else the label."""
    def ruled(label: Column, key: Column, compact: Column) -> Column:
        some = lambda parts: reduce(lambda a, b: a | b, [key.contains(p) | compact.contains(p) for p in parts], F.lit(False))
        out = F.when(F.lower(label).startswith("web attack") | F.lower(label).startswith("webattack"), "WebAttack").when(compact.isin("benign", "normal"), BENIGN)
        for family, parts, beside in MERGED_RULES:
            out = out.when(some(parts) & (some(beside) if beside else F.lit(True)), family)
        for whole, family in MERGED_WHOLE.items():
            out = out.when(compact == whole, family)
        return out.otherwise(label)

    key = lambda label: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(label), "_", " "), r"\s*-\s*", "-"), r"\s+", " ")
    return let(norm_label(c), lambda label: let(key(label), lambda k: let(F.regexp_replace(k, " ", ""), lambda compact: ruled(label, k, compact))))


#: Ordered rules of the families by source: family, parts anywhere, how it begins; letters only, without - _ and spaces.
SOURCE_RULES = {
    "flowmeter": (("Botnet", ("bot",), ""), ("DDoS", ("ddos",), ""), ("DoS", (), "dos"), ("BruteForce", ("brute", "ftp", "ssh"), ""), ("WebAttack", ("web", "xss", "sql"), ""), ("Infiltration", ("infilteration", "infiltration"), "")),
    "rebuild": (("Botnet", ("bot",), ""), ("DDoS", ("ddos",), ""), ("Probe", ("probe", "scan"), ""), ("WebAttack", ("web", "sql", "xss"), ""), ("BruteForce", ("brute", "patator"), ""), ("Heartbleed", ("heartbleed",), ""), ("Infiltration", ("infiltration",), ""), ("DoS", (), "dos")),
}
#: Families of the 49-column source by its categories; any other is OtherAttack.
CATEGORY_FAMILIES = {
    "normal": "BENIGN", "generic": "Generic", "exploits": "Exploit", "fuzzers": "Fuzzers", "dos": "DoS", "reconnaissance": "Probe", "analysis": "Analysis", "backdoor": "Backdoor", "shellcode": "Shellcode", "worms": "Worms",
}


def source_family(c: Column, source: str) -> Column:
    """SCA16: a label's family under the rules of its source: flowmeter, schedule, rebuild or categories."""
    if source == "schedule":
        return let(merged_label(c), lambda merged: F.when(merged == "Bot", "Botnet").when(merged == "PortScan", "Probe").otherwise(merged))
    if source == "categories":
        return F.coalesce(F.create_map(*[F.lit(x) for kv in CATEGORY_FAMILIES.items() for x in kv])[F.lower(norm_label(c))], F.lit("OtherAttack"))
    raw = F.trim(F.coalesce(c, F.lit("")))

    def ruled(key: Column) -> Column:
        out = F.when(key.isin("benign", "normal"), BENIGN)
        for family, parts, start in SOURCE_RULES[source]:
            out = out.when(key.startswith(start) if start else reduce(lambda a, b: a | b, [key.contains(p) for p in parts]), family)
        return out

    return F.coalesce(let(F.regexp_replace(F.lower(raw), "[-_ ]", ""), ruled), F.nullif(raw, F.lit("")), F.lit("UNKNOWN"))


def attack_family(c: Column) -> Column:
    """SCA15: one of FAMILIES."""
    def named(label: Column, merged: Column) -> Column:
        out = F.when(label.isin(*FAMILIES), label).when(merged == "PortScan", "Probe").when(merged == "Bot", "Botnet")
        return out.when(merged.isin(*FAMILIES), merged).when(is_benign(merged), BENIGN).otherwise("OtherAttack")

    return let(norm_label(c), lambda label: let(merged_label(label), lambda merged: named(label, merged)))


def infer_day(day: Column, file: Column) -> Column:
    """SCA17: the weekday that the day begins with, else one in the file name, else unknown."""
    names = "monday|tuesday|wednesday|thursday|friday|saturday|sunday"
    found = F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(day)), f"^({names})", 1), F.lit("")), F.nullif(F.regexp_extract(F.lower(file), f"({names})", 1), F.lit("")))
    return F.coalesce(F.initcap(found), F.lit("unknown"))


def log_bin(c: Column, most: int = 15) -> Column:
    """SCA19: min(floor(log2(v + 1)), most); 0 for v <= 0."""
    return F.when(c <= 0, 0).otherwise(F.least(F.floor(F.log2(c.cast("double") + 1.0)), F.lit(most))).cast("int")


def iat_bin(c: Column, most: int = 15) -> Column:
    """SCA19: log_bin of seconds in milliseconds."""
    return log_bin(F.greatest(c, F.lit(0.0)) * 1000.0, most)


def ratio_bin(c: Column, bins: int = 10) -> Column:
    return F.least((F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * bins).cast("int"), F.lit(bins))


def edge_bin(c: Column, edges: list[float], right_closed: bool = True) -> Column:
    """SCA20: edges below v; with right_closed False also those equal to it."""
    return sum(((c > e) if right_closed else (c >= e)).cast("int") for e in edges)


def relative_times(times: Column) -> Column:
    """SCA21: times since the first."""
    return F.transform(times, lambda t: t - times[0])


def iats(times: Column) -> Column:
    """SCA21: gaps to the time before, 0 first, never negative."""
    return F.transform(times, lambda t, i: F.when(i == 0, 0.0).otherwise(F.greatest(F.lit(0.0), t - F.get(times, i - 1))))


#: Services by well-known port; other ports are other, ports up to 0 and missing ones none.
SERVICES = {20: "ftp", 21: "ftp", 22: "ssh", 25: "smtp", 53: "dns", 80: "http", 161: "snmp", 443: "ssl", 465: "smtp", 587: "smtp", 8080: "http", 8443: "ssl"}
#: Application tokens by service name, and the connection states that have a token.
APPLICATIONS = {
    "dhcp": "APP_DHCP", "dns": "APP_DNS", "ftp": "APP_FTP", "gssapi": "APP_GSSAPI", "http": "APP_HTTP", "irc": "APP_IRC", "ntlm": "APP_NTLM", "ntp": "APP_NTP", "rdp": "APP_RDP", "sip": "APP_SIP", "smb": "APP_SMB", "smtp": "APP_SMTP",
    "snmp": "APP_SNMP", "ssh": "APP_SSH", "ssl": "APP_TLS", "tls": "APP_TLS",
}
STATES = ("S0", "S1", "SF", "REJ", "S2", "S3", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR", "OTH")


def port_class(c: Column) -> Column:
    """SCA24: PORT_ZERO, PORT_SYSTEM, PORT_REGISTERED, PORT_DYNAMIC, or PORT_OTHER if it is no number or over 65535."""
    p = c.cast("string").try_cast("double").try_cast("bigint")
    return F.when(p.isNull() | (p > 65535), "PORT_OTHER").when(p == 0, "PORT_ZERO").when((p > 0) & (p < 1024), "PORT_SYSTEM").when(p < 49152, "PORT_REGISTERED").otherwise("PORT_DYNAMIC")


def service_from_port(c: Column) -> Column:
    """SCA24: the service of a well-known port, other for another, none for a missing one or one up to 0."""
    p = to_int(c, -1)
    return F.when(p <= 0, "none").otherwise(F.coalesce(F.create_map(*[F.lit(x) for kv in SERVICES.items() for x in kv])[p.cast("int")], F.lit("other")))


def app_token(services: Column) -> Column:
    """SCA25: the token of the commonest service in an array (ties to the one met first), APP_NONE without any, APP_OTHER for unknown ones."""
    clean = F.filter(F.transform(services, lambda s: F.lower(F.trim(s))), lambda s: s.isNotNull() & (s != ""))
    counted = F.transform(F.array_distinct(clean), lambda s: F.struct((-F.size(F.filter(clean, lambda x: x == s))).alias("n"), F.array_position(clean, s).alias("at"), s.alias("s")))
    known = F.create_map(*[F.lit(x) for kv in APPLICATIONS.items() for x in kv])
    return F.when(F.size(clean) > 0, F.coalesce(known[F.array_min(counted)["s"]], F.lit("APP_OTHER"))).otherwise("APP_NONE")


def state_token(c: Column) -> Column:
    """SCA25: STATE_ and the connection state, STATE_NONE without one, STATE_OTHER for unknown ones."""
    state = F.upper(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return F.when(state == "", "STATE_NONE").when(state.isin(*STATES), F.concat(F.lit("STATE_"), state)).otherwise("STATE_OTHER")


def token_class(c: Column) -> Column:
    """SCA27: what a token tells of: profile, none (the profile kind that says so), raw_profile, structural, packet, flow, burst, rhythm, match, special, else other."""
    return (
        F.when(c.isin("[PAD]", "[CLS]", "[SEP]", "[MASK]", "[UNK]"), "special").when(c == "PRIM_PROFILE_NONE", "none").when(c.startswith("PRIM_PROFILE_"), "profile").when(c.startswith("RAW_PRIM_PROFILE_"), "raw_profile").when(c.startswith("PRIM_STRUCT_"), "structural")
        .when(c.rlike("^PKT_(DIR|LEN|IAT)_"), "packet").when(c.rlike("^FLOW_(PKTN|DUR|BURSTN|DIR_RATIO|COUNT)_"), "flow").when(c.startswith("BURST_"), "burst").when(c.startswith("RHY_"), "rhythm").when(c.startswith("MATCH_"), "match").otherwise("other")
    )


def is_motif(c: Column, prefixes: tuple[str, ...] = ("PRIM_PROFILE_", "PRIM_STRUCT_", "DM_")) -> Column:
    """SCA29: whether a token can be a motif: it begins with one of the prefixes."""
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def motif_family(c: Column) -> Column:
    """SCA29: profile, structural_ and its kind, data_mined or motif."""
    kind = F.lower(F.regexp_extract(c, "^PRIM_STRUCT_([^_]*)", 1))
    return F.when(c.startswith("PRIM_PROFILE_"), "profile").when(c.startswith("PRIM_STRUCT_"), F.concat(F.lit("structural_"), F.when(kind == "", "unknown").otherwise(kind))).when(c.startswith("DM_"), "data_mined").otherwise("motif")


def temperature(scores: Column, t: float) -> Column:
    """SCA37: a probability map rescaled by temperature, through logs shifted by their maximum."""
    logs = F.transform_values(scores, lambda k, p: F.log(F.greatest(p, F.lit(1e-12))) / t)
    top = F.array_max(F.map_values(logs))
    raised = F.transform_values(logs, lambda k, v: F.exp(v - top))
    total = F.aggregate(F.map_values(raised), F.lit(0.0), lambda a, v: a + v)
    return F.transform_values(raised, lambda k, v: v / total)


def entropy(probs: Column) -> Column:
    """SCA38: entropy of an array of probabilities over the log of its size; 0 for one value."""
    total = F.aggregate(probs, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log(p)).otherwise(0.0))
    return F.when(F.size(probs) > 1, total / F.log(F.size(probs).cast("double"))).otherwise(0.0)


def margin(probs: Column) -> Column:
    """SCA38: the largest less the second largest."""
    order = F.sort_array(probs, asc=False)
    return F.when(F.size(probs) > 1, order[0] - F.get(order, F.lit(1))).otherwise(order[0])


def passes_gate(probs: Column, least: float = 0.0, most_entropy: float = 1.0, least_margin: float = 0.0) -> Column:
    """SCA38: whether an array of probabilities is sure enough: its largest, its entropy and its margin within the limits."""
    return (F.array_max(probs) >= least) & (entropy(probs) <= most_entropy) & (margin(probs) >= least_margin)


#: Parts of a token, between _ and =, that name a port or a time; two words of a time stand side by side. Fixed values.
PORT_PARTS, TIME_PARTS = ("PORT", "DPORT", "SPORT"), ("TS", "TIME", "TIMESTAMP")


def _has_part(c: Column, names: tuple[str, ...]) -> Column:
    parts = F.split(F.upper(c), "[_=]")
    return F.arrays_overlap(parts, F.array(*[F.lit(n) for n in names]))


def is_port_token(c: Column) -> Column:
    """SCA40: a token with a part that names a port."""
    return _has_part(c, PORT_PARTS)


def is_time_token(c: Column) -> Column:
    """SCA40: a token with a part that names a time."""
    return _has_part(c, TIME_PARTS)


def looks_like_ip(c: Column) -> Column:
    """SCA40: a dotted quad or a run of hex groups joined by colons."""
    return c.rlike(r"(^|[^0-9])([0-9]{1,3}\.){3}[0-9]{1,3}($|[^0-9])") | c.rlike(r"(?i)\b([0-9a-f]{1,4}:){3,7}[0-9a-f]{1,4}\b")


def gate_bucket(score: Column, p95: Column, p99: Column, p995: Column, p100: Column) -> Column:
    """SCA42: how far in the benign tail a score lies."""
    return F.when(score <= p95, "core").when(score <= p99, "p95_p99").when(score <= p995, "p99_p995").when(score <= p100, "p995_max").otherwise("above_max")


def admission(bucket: Column) -> Column:
    """SCA42: whether the gate admits, defers or quarantines."""
    return F.when(bucket == "core", "admit").when(bucket.isin("p95_p99"), "admit").when(bucket == "p99_p995", "review").otherwise("quarantine")


def jaccard(a: Column, b: Column) -> Column:
    """SET03: of two arrays as sets; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


def hash_rank_key(id_col: Column, seed: int, salt: str = "") -> Column:
    """TOP01: the deterministic order of sampling: SHA-1 of seed, salt and id."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit(salt), id_col.cast("string")))
