"""Toxicity by cumulative-link ordinal regression on sparse features: words and their beginnings.

P(grade > k) = sigmoid(w . x - cut_k): one weight vector shared by ordered cuts. The expected severity is the sum of these
probabilities. Grades: 0 for documents labelled clean; documents labelled toxic are graded 1 to 3 by how many distinct
words they have that the labels themselves mark as toxic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, labelled_sample, staged, table

#: Learning rows of each label at most, terms kept as features, and the least share of the toxic ones that a term must be in.
PER_CLASS = 6000
VOCABULARY = 600
LEAST_SHARE = 0.02
GRADES = 4
STEPS = 1000
RATE = 0.03
RIDGE = 1e-5
#: A document is rejected from this probability of a grade above 0 on.
REJECT = 0.5
#: The lowest cut is this at least: a text without a feature is toxic with a probability of 0.38 at most, and so is never rejected.
LEAST_CUT = 0.5
#: Lengths of the word beginnings that are terms too.
PREFIXES = (4, 5)
#: Terms are features if their smoothed log odds between the labels are over ODDS and lie so many standard deviations
#: above chance, and mark toxic text over MARKS. None speaks for a text (weights
#: stay at 0 or above), so that length cannot outweigh what is found.
ODDS, DEVIATIONS = 1.5, 5.0
MARKS = 2.0
#: From so many distinct words with marking terms on, a toxic document's grade is 2, and 3.
SEVERE = (3, 6)
_WORD = re.compile(r"[^\W\d_]+")


def terms(word: str) -> list[str]:
    """The word itself and, marked ^, its first letters."""
    return [word, *["^" + word[:n] for n in PREFIXES if len(word) > n]]


def words(text: str | None) -> set[str]:
    """The distinct terms of a whole text."""
    return {t for w in set(_WORD.findall((text or "").lower())) for t in terms(w)}


def _marked(text: str | None, marks: frozenset) -> int:
    return sum(not marks.isdisjoint(terms(w)) for w in set(_WORD.findall((text or "").lower())))


@dataclass
class Ordinal:
    """Feature positions, shared weights and ordered cuts."""

    index: dict[str, int]
    weights: np.ndarray
    cuts: np.ndarray

    def above(self, text: str | None) -> np.ndarray:
        """P(grade > k) for each k."""
        at = [self.index[w] for w in self.index.keys() & words(text)]
        return 1 / (1 + np.exp(-np.clip(self.weights[at].sum() - self.cuts, -60, 60)))


def fit(rows: list[tuple[list[int], int]], size: int, grades: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """Weights and cuts from (feature positions, grade) by gradient descent on the cumulative-link likelihood."""
    y = np.array([g for _, g in rows], int)
    if not size or not len(y) or y.max() == 0:
        return np.zeros(size), np.full(grades - 1, 4.0)
    which = np.repeat(np.arange(len(rows)), [len(x) for x, _ in rows])
    at = np.concatenate([np.array(x, int) for x, _ in rows])
    w, cuts = np.zeros(size), np.array([1.0 + k for k in range(grades - 1)])
    share = np.bincount(y, minlength=grades)[:grades]
    each = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, share[0]))
    moment_w, moment_c = np.zeros(size) + 1e-8, np.zeros(grades - 1) + 1e-8
    for _ in range(STEPS):
        f = np.bincount(which, w[at], len(y))
        up = 1 / (1 + np.exp(-np.clip(f[:, None] - np.concatenate([[-np.inf], cuts, [np.inf]]), -60, 60)))  # P(y >= k)
        up[:, 0], up[:, -1] = 1.0, 0.0
        low, high = up[np.arange(len(y)), y], up[np.arange(len(y)), y + 1]
        p = np.maximum(low - high, 1e-12)
        d_low, d_high = low * (1 - low) / p, high * (1 - high) / p
        slope = each * (d_low - d_high)
        gw = np.bincount(at, slope[which], size) - RIDGE * w / np.sqrt(size)
        gc = np.array([(each * (d_high * (y == k) - d_low * (y == k + 1))).sum() for k in range(grades - 1)])
        moment_w = 0.95 * moment_w + 0.05 * gw**2
        moment_c = 0.95 * moment_c + 0.05 * gc**2
        w = np.maximum(0, w + RATE * gw / np.sqrt(moment_w + 1e-12))
        cuts = np.maximum.accumulate(np.maximum(cuts + RATE * gc / np.sqrt(moment_c + 1e-12), LEAST_CUT) + np.arange(grades - 1) * 1e-9)
    return w, cuts


def toxicity_model(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Ordinal:
    """Fit on a bounded sample of labelled learning rows. Term counts over the sample are made in Spark; the driver
    gets VOCABULARY terms and the sample's rows as positions among them."""
    sample = staged(labelled_sample(docs, labels, "toxic", per_class), "toxic-sample")

    @F.pandas_udf("array<string>")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(words(t)) for t in texts])

    n = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad, good = n.get(1, 0), n.get(0, 0)
    if not bad or not good:
        return Ordinal({}, np.zeros(0), np.full(GRADES - 1, 4.0))
    counts = sample.select("label", F.explode(distinct("text")).alias("w")).groupBy("w").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
    odds = F.log((F.col("b") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("b") + 0.5) / (good + 1))
    share = bad / (bad + good)
    strength = (F.col("b") - share * F.col("n")) / F.sqrt(share * (1 - share) * F.col("n"))
    top = counts.where((F.col("b") >= max(3.0, LEAST_SHARE * bad)) & (odds > ODDS) & (strength > DEVIATIONS)).select("w", odds.alias("odds"), strength.alias("s")).orderBy(F.desc("s"), "w").limit(VOCABULARY).collect()
    index = {r.w: i for i, r in enumerate(top)}
    marks = frozenset(r.w for r in top if r.odds > MARKS)

    @F.pandas_udf("array<int>")
    def positions(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(index[w] for w in index.keys() & words(t)) for t in texts])

    @F.pandas_udf("int")
    def marked(texts: pd.Series) -> pd.Series:
        return pd.Series([_marked(t, marks) for t in texts])

    grade = F.when(F.col("label") == 0, 0).otherwise(1 + sum((marked("text") >= x).cast("int") for x in SEVERE))
    got = sorted(sample.select("doc_id", positions("text").alias("x"), grade.alias("g")).collect(), key=lambda r: (r.doc_id, r.g))
    weights, cuts = fit([(r.x, r.g) for r in got], len(index))
    return Ordinal(index, weights, cuts)


def _severity(model: Ordinal, text_col: str) -> Column:
    @F.pandas_udf("severity double, probability double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            up = np.array([model.above(t) for t in texts]).reshape(-1, len(model.cuts))
            yield pd.DataFrame({"severity": up.sum(1), "probability": up[:, 0]})

    return udf(F.col(text_col))


def accepted(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """The rows of docs that scored() does not reject, with the columns of docs. A probability equal to REJECT rejects;
    null and empty texts stay, repeated rows share one fate, and an empty table gives no rows."""
    return docs.withColumn("__tox", _severity(model, text_col)).where(F.col("__tox.probability") < REJECT).drop("__tox")


def scored(docs: DataFrame, model: Ordinal, text_col: str = "text") -> DataFrame:
    """docs plus `tox_severity` (expected grade, 0 to 3), `tox_probability` (of a grade above 0) and `tox_rejected`.

    Null and empty texts have no feature. Equal texts, so also repeated rows, score alike and stay rows of their own; an
    empty table gives no rows. Columns of docs with these names are replaced.
    """
    made = ("tox_severity", "tox_probability", "tox_rejected")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    out = docs.select(*own, _severity(model, text_col).alias("__tox"))
    return out.select(*own, F.col("__tox.severity").alias(made[0]), F.col("__tox.probability").alias(made[1]), (F.col("__tox.probability") >= REJECT).alias(made[2]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.col("tox_severity").alias("severity"), F.col("tox_probability").alias("score"), F.col("tox_rejected").cast("int").alias("predicted"))
