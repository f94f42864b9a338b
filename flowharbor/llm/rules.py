"""Quality rules as weak supervision, with DataFrame functions only.

Rules vote good (1), bad (-1) or abstain (0). Expectation-maximisation over the table of vote patterns (at most
3 to the power of the rules) estimates how often each rule votes so on good and on bad documents, and a document is kept by the
posterior probability of its pattern instead of having to pass every rule.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, staged, table

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ITERATIONS = 12
#: Share of good documents and rate of agreeing votes that expectation-maximisation starts from.
PRIOR, AGREE = 0.8, 0.8
#: A document is kept from this posterior on.
KEEP = 0.5


def _windows(words: str, n: int) -> str:
    return f"transform(sequence(0, size({words}) - {n}), i -> xxhash64({', '.join(f'{words}[i + {k}]' for k in range(n))}))"


def measures(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, n_words and the four base measures of every whole text, beside `mq_upper` and `mq_lines`.

    A null text has no words. Repeated rows are measured alike; other columns are ignored. Words in repeated
    windows: a window's hash is 64 bits; where hashes repeat, positions are sorted by hash and the union of the windows
    found is measured, all inside the row, so nothing is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    base = base.withColumn("w", F.filter(F.split("t", SPACE_PATTERN), lambda x: x != ""))
    base = base.withColumn("l", F.filter(F.split("t", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0))
    base = base.withColumn("v", F.transform("w", lambda x: F.xxhash64(x)))
    base = base.withColumn("h", F.when(F.size("v") >= WINDOW, F.expr(_windows("v", WINDOW))).otherwise(F.expr("cast(array() as array<bigint>)")))
    twice = "size(array_distinct(h)) < size(h)"
    ranked = "sort_array(transform(h, (x, i) -> struct(x as x, i as i)))"
    base = base.withColumn("s", F.expr(f"CASE WHEN {twice} THEN {ranked} END"))
    found = "sort_array(transform(filter(s, (e, i) -> (i > 0 AND s[i - 1].x = e.x) OR (i < size(s) - 1 AND s[i + 1].x = e.x)), e -> e.i))"
    base = base.withColumn("p", F.expr(f"CASE WHEN s IS NOT NULL THEN {found} END"))
    covered = f"CASE WHEN size(p) > 0 THEN {WINDOW} + aggregate(sequence(1, size(p) - 1, 1), 0L, (a, i) -> a + least({WINDOW}, p[i] - p[i - 1])) ELSE 0L END"
    covered = covered.replace("sequence(1, size(p) - 1, 1)", "slice(sequence(0, size(p)), 2, size(p) - 1)")
    bare = F.translate("t", SPACES, "")
    return base.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).cast("long").alias("n_repeat_words"),
        (F.length(bare) - F.length(F.regexp_replace(bare, r"\p{Lu}", ""))).cast("long").alias("mq_upper"),
        F.size("l").cast("long").alias("mq_lines"),
    )


def votes(m: DataFrame) -> dict[str, Column]:
    """The rules: 1 good, -1 bad, 0 abstains. Ratios are compared in whole numbers."""
    n, c = F.col("n_words"), F.col("word_chars")

    def rule(good: Column, bad: Column) -> Column:
        return F.when(n == 0, -1).when(bad, -1).when(good, 1).otherwise(0)

    return {
        "v_length": rule(n >= 50, n < 5),
        "v_word": rule((c >= 3 * n) & (c <= 8 * n), (c < 2 * n) | (c > 12 * n)),
        "v_symbols": rule(100 * F.col("n_symbols") <= 2 * n, 100 * F.col("n_symbols") > 15 * n),
        "v_lines": rule(10 * F.col("n_dup_lines") <= F.col("mq_lines"), 10 * F.col("n_dup_lines") > 3 * F.col("mq_lines")),
        "v_repeat": rule(100 * F.col("n_repeat_words") <= 5 * n, 100 * F.col("n_repeat_words") > 20 * n),
        "v_upper": rule(100 * F.col("mq_upper") <= 15 * c, 100 * F.col("mq_upper") > 40 * c),
    }


def fit(patterns: DataFrame, names: list[str], iterations: int = ITERATIONS) -> tuple[float, dict]:
    """Prior of good and {(rule, vote): (rate on good, rate on bad)} by expectation-maximisation.

    `patterns` has a row for each vote pattern and its documents `n`; each round is one aggregation of that table,
    of which one row of sums reaches the driver. Rates are smoothed by one document. Without documents, the start values stand.
    """
    prior = PRIOR
    rate = {(r, v): ((AGREE, 1 - AGREE) if v > 0 else (1 - AGREE, AGREE) if v < 0 else (0.5, 0.5)) for r in names for v in (-1, 0, 1)}
    for _ in range(iterations):
        good = posterior(names, prior, rate)
        sums = [F.sum("n").alias("n"), F.sum(F.col("n") * good).alias("g")]
        for r in names:
            for v in (-1, 0, 1):
                mine = F.when(F.col(r) == v, F.col("n")).otherwise(0)
                sums += [F.sum(mine * good).alias(f"g_{r}_{v + 1}"), F.sum(mine * (1 - good)).alias(f"b_{r}_{v + 1}")]
        x = patterns.agg(*sums).first()
        if not x.n:
            break
        prior = min(max(x.g / x.n, 1e-6), 1 - 1e-6)
        rate = {(r, v): ((x[f"g_{r}_{v + 1}"] + 1) / (x.g + 3), (x[f"b_{r}_{v + 1}"] + 1) / (x.n - x.g + 3)) for r, v in rate}
    return prior, rate


def posterior(names: list[str], prior: float, rate: dict) -> Column:
    """Probability that a document with these votes is good."""
    def weight(r: str, v: int) -> float:
        return math.log(rate[r, v][0] / rate[r, v][1])

    odds = [F.when(F.col(r) > 0, weight(r, 1)).when(F.col(r) < 0, weight(r, -1)).otherwise(weight(r, 0)) for r in names]
    return 1 / (1 + F.exp(-reduce(lambda a, b: a + b, odds, F.lit(math.log(prior / (1 - prior))))))


def judged(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", iterations: int = ITERATIONS, keep: float = KEEP) -> DataFrame:
    """Measures, votes, base_failed, `quality` (posterior) and kept of every document. Null and empty texts fail the base."""
    m = staged(measures(docs, text_col, id_col), "measures")
    rules = votes(m)
    voted = m.withColumns(rules)
    names = list(rules)
    patterns = staged(voted.groupBy(*names).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    prior, rate = fit(patterns, names, iterations)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("quality", posterior(names, prior, rate))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged(table(spark, sf_dir, "documents")).select(*base, "base_failed", "kept")
