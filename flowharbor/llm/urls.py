"""URL filters by host reputation: empirical-Bayes shrinkage of labelled page outcomes from host to registered domain to suffix.

A host's share of bad pages has a beta prior around its registered domain's share, that one around its suffix's, that one
around all pages'. How strong each prior is comes from the data: the pooled moment estimate of the beta-binomial's
overdispersion at that level. A page is blocked where the posterior's lower bound says that most of its host is bad.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowharbor.operators.staging import lookup, staged

from .common import table

#: (verdict, rule): a host and the beginning of a path, from the first slash on. The query's rules.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: A page is blocked if its host's share of bad pages lies above BAD with the one-sided normal quantile Z (90 %).
BAD, Z = 0.5, 1.2816
#: Bounds of the overdispersion: at the least a prior of 999 pseudo-pages, at the most of 1.
LEAST_RHO, MOST_RHO = 0.001, 0.5
#: Public suffixes of two labels that count as one. Fixed values.
SUFFIXES = ("ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp", "co.kr", "co.in", "com.br", "com.cn", "com.mx", "com.tr", "co.za")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HOST_PATTERN, PATH_PATTERN = "://([^/?#]*)", "://[^/?#]*([^?#]*)"
#: A host without user and port.
NAME_PATTERN = r"^(?:[^@]*@)*(\[[^\]]*\]|[^:]*)"


def host_of(url: Column) -> Column:
    """What lies between the first :// and the next /, ? or #, with A-Z in lower case; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, HOST_PATTERN, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, PATH_PATTERN, 1), F.lit(""))


def fitting(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null if none does. A rule fits its host and all subdomains, where
    the path begins with the rule's. Of rules of one length the first given wins."""
    rule = verdict = F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def with_domains(df: DataFrame, host: str = "host", suffixes=SUFFIXES) -> DataFrame:
    """df with `suffix` (the last label, or the last two where they are in `suffixes`) and `domain` (one label more, the whole
    name if there is none); user and port do not count, an address of digits and dots is a domain of its own without suffix."""
    name = F.regexp_extract(F.col(host), NAME_PATTERN, 1)
    two, numeric = F.substring_index(name, ".", -2), name.rlike(r"^[0-9.]*$|^\[")
    long = two.isin(*suffixes)
    domain = F.when(numeric, name).when(long, F.substring_index(name, ".", -3)).otherwise(two)
    return df.withColumns({"suffix": F.when(numeric, F.lit("")).when(long, two).otherwise(F.substring_index(name, ".", -1)), "domain": domain})


def _strength(children: DataFrame) -> float:
    """Pseudo-pages of the prior that parents' shares `p` are for children with `bad` of `n` labelled pages: 1 / rho - 1 for the
    overdispersion rho that equates (bad - n p)^2 / (n - 1), summed, to its expectation, which is that of n p (1 - p) (1 / (n - 1) + rho).
    The division keeps one huge child from deciding alone."""
    n, bad, p = F.col("n"), F.col("bad"), F.col("p")
    noise = n * p * (1 - p)
    over, under = children.where("n > 1").agg(F.sum(((bad - n * p) * (bad - n * p) - noise) / (n - 1)), F.sum(noise)).first()
    rho = min(MOST_RHO, max(LEAST_RHO, over / under)) if under else LEAST_RHO
    return 1 / rho - 1


def reputation(labelled: DataFrame) -> DataFrame:
    """Hosts of labelled (host, bad), bad being true, false or null (no outcome): (host, pages, n, bad, share, low), the
    posterior mean of each host's share of bad pages and its lower bound, rounded to 9 places.

    A host without outcomes has its domain's prior, a domain its suffix's, a suffix that of all; without any outcome the share
    is 0.5. A null host counts as the empty one, repeated rows as pages of their own, an empty table has no hosts. Pages are counted
    by host before anything is shuffled; one row a suffix, domain and host is all that the levels see.
    """
    rows = labelled.select(F.coalesce("host", F.lit("")).alias("host"), F.col("bad").cast("int").alias("bad"))
    counts = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = staged(with_domains(counts), "hosts")
    domains = staged(hosts.groupBy("domain", "suffix").agg(F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("bad").alias("bad")), "domains")
    suffixes = domains.groupBy("suffix").agg(F.count("*").alias("children"), F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    n, bad, of_hosts, of_domains = hosts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0)), F.count("*"), F.count_distinct("domain")).first()
    level = suffixes.withColumn("p", F.lit((bad + 1) / (n + 2)))
    level = level.withColumn("p", _posterior(_strength(level)))
    below = staged(lookup(domains, level.select("suffix", "children", "p"), "suffix", "children", of_domains), "domain-priors")
    below = below.withColumn("p", _posterior(_strength(below)))
    at = staged(lookup(hosts, below.select("domain", "children", "p"), "domain", "children", of_hosts), "host-priors")
    m = _strength(at)
    share, size = _posterior(m), F.col("n") + m + 1
    low = share - Z * F.sqrt(share * (1 - share) / size)
    return at.select("host", "pages", "n", "bad", F.round(share, 9).alias("share"), F.round(low, 9).alias("low"))


def _posterior(m: float) -> Column:
    return (F.col("bad") + m * F.col("p")) / (F.col("n") + m)


def judged(pages: DataFrame, rules=RULES, threshold: float = BAD) -> DataFrame:
    """Each page (page_id, url; others are ignored): page_id, host, path, rule, verdict, low (null where a rule decides).

    Pages that a rule fits are the labelled outcomes (block: bad); the others are blocked where the lower bound of their host's
    share of bad pages exceeds `threshold`. A null url has an empty host and path, which are a host like any other; null and
    repeated page_ids are kept row by row; an empty table gives no rows. Hot hosts' verdicts are broadcast, the others' are joined.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting(F.col("host"), F.col("path"), rules)
    ruled = parsed.withColumns({"rule": rule, "verdict": verdict})
    known = staged(reputation(ruled.select("host", (F.col("verdict") == "block").alias("bad"))).where("pages > n").select("host", (F.col("pages") - F.col("n")).alias("asking"), "low"), "reputation")
    total = known.agg(F.coalesce(F.sum("asking"), F.lit(0))).first()[0]
    others = lookup(ruled.where("rule IS NULL"), known, "host", "asking", total)
    decided = F.when(F.col("low") > threshold, "block").otherwise("allow")
    return ruled.where("rule IS NOT NULL").withColumn("low", F.lit(None).cast("double")).unionByName(others.withColumn("verdict", decided))


def op11_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _level(name: str, parent: str, key: str) -> str:
    """SQL of a level's posterior shares from its parent's `p`."""
    noise = "n * p * (1 - p)"
    rho = f"coalesce(least({MOST_RHO}, greatest({LEAST_RHO}, sum(((bad - n * p) ** 2 - {noise}) / (n - 1)) FILTER (n > 1) / nullif(sum({noise}) FILTER (n > 1), 0))), {LEAST_RHO})"
    return f"""{name}_p AS (SELECT c.*, q.p FROM {name} c JOIN {parent} q ON {key}), {name}_m AS (SELECT 1 / {rho} - 1 AS m FROM {name}_p), {name}_q AS (SELECT * EXCLUDE (p), (bad + m * p) / (n + m) AS p FROM {name}_p, {name}_m)"""


_FITS = " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for _, r in sorted(RULES, key=lambda r: -len(r[1])))
_TWO = "array_to_string(array_slice(string_split(name, '.'), -2, -1), '.')"
_THREE = "array_to_string(array_slice(string_split(name, '.'), -3, -1), '.')"
_IN = f"{_TWO} IN ({', '.join(repr(s) for s in SUFFIXES)})"
_NUMERIC = "regexp_matches(name, '^[0-9.]*$|^\\[')"
ORACLE_SQL = f"""WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{HOST_PATTERN}', 1), ''), '{UPPER}', '{LOWER}') AS host, coalesce(regexp_extract(url, '{PATH_PATTERN}', 1), '') AS path FROM pages),
 r AS (SELECT *, CASE {_FITS} END AS rule FROM u), v AS (SELECT *, CASE {' '.join(f"WHEN rule = '{r}' THEN '{k}'" for k, r in RULES)} END AS ruled, regexp_extract(host, '{NAME_PATTERN}', 1) AS name FROM r),
 h AS (SELECT host, CASE WHEN {_NUMERIC} THEN name WHEN {_IN} THEN {_THREE} ELSE {_TWO} END AS domain, CASE WHEN {_NUMERIC} THEN '' WHEN {_IN} THEN {_TWO} ELSE string_split(name, '.')[-1] END AS suffix,
 count(ruled)::DOUBLE AS n, (count(*) FILTER (ruled = 'block'))::DOUBLE AS bad FROM v GROUP BY ALL), d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY ALL), s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY ALL),
 a AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS p FROM s), {_level('s', 'a', 'true')}, {_level('d', 's_q', 'c.suffix = q.suffix')}, {_level('h', 'd_q', 'c.domain = q.domain AND c.suffix = q.suffix')},
 low AS (SELECT host, round(p - {Z} * sqrt(p * (1 - p) / (n + m + 1)), 9) AS low FROM h_q)
 SELECT page_id, v.host, path, rule, coalesce(ruled, CASE WHEN low > {BAD} THEN 'block' ELSE 'allow' END) AS verdict FROM v JOIN low ON low.host = v.host"""
