"""URL filters: parsing, rules, shrinkage against plain Python."""

import re
from collections import Counter

import pytest

from flowharbor.llm import urls


def judged(spark, rows, **how):
    return [r.asDict() for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string"), **how).collect()]


def plain_host_path(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return (re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]) if m else ("", "")


def plain_low(outcomes):
    """Lower bounds by host from (host, bad or None), every level a dictionary."""
    def domain(host):
        name = re.match(urls.NAME_PATTERN, host)[1]
        if re.match(r"^[0-9.]*$|^\[", name):
            return name, ""
        parts = name.split(".")
        cut = 2 if ".".join(parts[-2:]) in urls.SUFFIXES else 1
        return ".".join(parts[-cut - 1 :]), ".".join(parts[-cut:])

    n, bad = Counter(), Counter()
    for host, b in outcomes:
        for level in (("h", host), ("d", domain(host)), ("s", domain(host)[1]), ("a",)):
            n[level] += b is not None
            bad[level] += bool(b)

    def strength(level, prior):
        some = [k for k in n if k[0] == level and n[k] > 1]
        noise = {k: n[k] * prior(k) * (1 - prior(k)) for k in some}
        if not sum(noise.values()):
            return 1 / urls.LEAST_RHO - 1
        over = sum(((bad[k] - n[k] * prior(k)) ** 2 - noise[k]) / (n[k] - 1) for k in some)
        return 1 / min(urls.MOST_RHO, max(urls.LEAST_RHO, over / sum(noise.values()))) - 1

    p = {("a",): (bad[("a",)] + 1) / (n[("a",)] + 2)}
    for level, up in (("s", lambda k: ("a",)), ("d", lambda k: ("s", k[1][1])), ("h", lambda k: ("d", domain(k[1])))):
        m = strength(level, lambda k: p[up(k)])
        p |= {k: (bad[k] + m * p[up(k)]) / (n[k] + m) for k in n if k[0] == level}
    return {k[1]: round(p[k] - urls.Z * (p[k] * (1 - p[k]) / (n[k] + m + 1)) ** 0.5, 9) for k in n if k[0] == "h"}


ODD = [(1, None), (1, None), (None, "x"), (3, "HTTP://A.EXAMPLE.NET/EN/x"), (4, "http://example.net/en/?q=/"), (5, "http://b.net"), (6, "a://É.org/fr/#x"), (7, "http://u:p@c.co.uk:80/y"), (8, "http://1.2.3.4/z"), (9, "http://notexample.com/de/"), (10, "x://y://z/de/"), (11, "http://example.com/de"), (12, "s://example.com/de/" + "a" * 200_000)]


def test_odd_urls_are_parsed_and_ruled(spark):
    rows = {(r["page_id"], r["host"]): r for r in judged(spark, ODD)}
    assert len(judged(spark, ODD)) == len(ODD)
    for page, url in ODD:
        host, path = plain_host_path(url)
        assert rows[page, host]["path"] == path
    rule = {k[0]: (r["rule"], r["verdict"]) for k, r in rows.items()}
    assert rule[3] == ("net/", "block") and rule[4] == ("example.net/en/", "allow") and rule[6] == ("org/fr/", "allow")
    assert rule[5][0] is None and rule[9][0] is None and rule[10][0] is None and rule[11][0] is None and rule[12] == ("example.com/de/", "block")


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_shrinkage_agrees_with_plain_python(spark, seed):
    import random

    rng = random.Random(seed)
    hosts = [f"{h}{i}.{d}{j}.{s}" for s, d, h in (("com", "a", "w"), ("co.uk", "b", "m"), ("org", "c", "x")) for j in range(4) for i in range(3)] + ["single", "", "10.0.0.1"]
    rows = [(h, rng.choice([True, False, None]) if "a" in h else rng.random() < 0.1) for h in hosts for _ in range(rng.randint(1, 30))] + [("w0.a0.com", True)] * 400
    got = {r.host: r.low for r in urls.reputation(spark.createDataFrame(rows, "host string, bad boolean")).collect()}
    want = plain_low(rows)
    assert got.keys() == want.keys() and all(abs(got[h] - want[h]) < 1e-8 for h in want)


def test_evidence_moves_hosts_domains_and_strangers(spark):
    rows = [(i, f"http://bad.spam.com/de/{i}") for i in range(50)] + [(100 + i, f"http://ok.org/fr/{i}") for i in range(50)]
    asked = [(200, "http://bad.spam.com/x"), (201, "http://other.spam.com/x"), (202, "http://www.ok.org/x"), (203, "http://new.place/x")]
    got = {r["page_id"]: r["verdict"] for r in judged(spark, rows + asked, rules=(("block", "spam.com/de/"), ("allow", "org/fr/")))}
    assert [got[i] for i in range(200, 204)] == ["block", "block", "allow", "allow"]


def test_empty_table_extra_columns_and_no_python(spark):
    assert judged(spark, []) == []
    df = spark.createDataFrame([(1, "http://a.com/", "h", "r", 1.0)], "page_id long, url string, host string, rule string, low double")
    out = urls.judged(df)
    assert [(r.host, r.rule, r.verdict) for r in out.collect()] == [("a.com", None, "allow")]
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
