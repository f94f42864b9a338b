"""Quality by Bradley-Terry ranking: a document's score is a linear form of its features, learned so that the better
document of each preference pair wins, by logistic loss on the difference of their features, over all pairs of all labelled
learning rows. The cut is a quantile of the learning scores: the share of rows labelled 0 lies below it.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, held_out, staged, table

#: Newton steps at most, the relative gain of loss at which they end, and levels that scores are rounded to while learning.
STEPS = 20
TOLERANCE = 1e-3
LEVELS = 512
RIDGE = 1e-4
#: Quantile bins of each feature.
BINS = 10
#: The score at the quantile cut.
THRESHOLD = 0.3
FEATURES = (
    "log_words", "word_length", "long_words", "symbols", "upper", "digits", "bangs", "bars", "punctuation", "distinct",
    "top_word", "repeat_pairs", "dup_lines", "line_words", "sentence_words", "short_lines", "other", "short_words", "lower_starts", "run",
)
_SYMBOL = str.maketrans("", "", "#*$%&<>|")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_ENDS = re.compile(r"[.!?]+")


def features(text: str | None) -> list[float]:
    """The 20 measures named in FEATURES of a whole text; zeros for a null or wordless one."""
    text = text or ""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    low = [w.lower() for w in words]
    counts = Counter(low)
    pairs = Counter(zip(low, low[1:]))
    lines = [x for x in text.split("\n") if x.strip()]
    longest = sum(1 for a, b in zip(low, low[1:]) if a == b)
    return [
        np.log1p(n), chars / n, sum(len(w) > 14 for w in words) / n, (len(text) - len(text.translate(_SYMBOL))) / n, len(_UPPER.findall(text)) / chars,
        len(_DIGIT.findall(text)) / chars, text.count("!") / n, text.count("|") / n, sum(text.count(x) for x in ".,;:") / n, len(counts) / n,
        max(counts.values()) / n, 1 - len(pairs) / max(1, n - 1), 1 - len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), n / (1 + len(_ENDS.findall(text))),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), sum(text.count(x) for x in "{}[]=_/\\@") / n, sum(len(w) < 3 for w in words) / n, sum(x[0].islower() for x in lines) / max(1, len(lines)), longest / n,
    ]


@dataclass
class Ranker:
    """Quantile edges, weights of the bins, the cut and the slope that make a score."""

    edges: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        x, out = np.asarray(x, np.float32), np.zeros(len(x))
        for j in range(x.shape[1]):
            out += self.weights[j][np.searchsorted(self.edges[j], x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.raw(x) - self.cut) + np.log(THRESHOLD / (1 - THRESHOLD))
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _ordered(x: np.ndarray) -> np.ndarray:
    """Single-precision numbers as whole numbers of 32 bits in the same order."""
    i = np.asarray(x, np.float32).view(np.int32).astype(np.int64)
    return np.where(i < 0, ~i & 0xFFFFFFFF, i | 1 << 31)


def _number(i: int) -> float:
    return float(np.array([i & 0x7FFFFFFF if i >> 31 else ~i & 0xFFFFFFFF], np.uint32).view(np.float32)[0])


def order_statistics(rows: DataFrame, values, ranks: list[int], columns: int) -> np.ndarray:
    """The values (single precision) at `ranks` (from 1) of each of the columns that `values` makes of a batch of all rows, exactly:
    counts by their leading bits, then by more of them in the ranges that hold a rank. A round's counts that
    reach the driver are columns * ranks * 2,048 at most."""
    found, known = {(j, r): (0, r) for j in range(columns) for r in ranks}, 32
    for shift in (21, 10, 0):
        wanted = {j: np.unique([found[j, r][0] for r in ranks]) for j in range(columns)}

        def count(batches: Iterator[pd.DataFrame], wanted=wanted, shift=shift, known=known) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x = _ordered(values(pdf))
                for j in range(columns):
                    mine = x[:, j][np.isin(x[:, j] >> known, wanted[j])] >> shift
                    at, n = np.unique(mine, return_counts=True)
                    yield pd.DataFrame({"j": j, "at": at, "n": n})

        counts: dict[int, list] = {}
        for row in rows.mapInPandas(count, "j int, at long, n long").groupBy("j", "at").agg(F.sum("n").alias("n")).orderBy("j", "at").collect():
            counts.setdefault(row.j, []).append((row["at"], row.n))
        for (j, r), (lead, left) in found.items():
            inside = [(at, n) for at, n in counts[j] if at >> (known - shift) == lead]
            upto = np.cumsum([n for _, n in inside])
            i = int(np.searchsorted(upto, left))
            found[j, r] = (inside[i][0], left - int(upto[i - 1] if i else 0))
        known = shift
    return np.array([[_number(found[j, r][0]) for r in ranks] for j in range(columns)])


def _total(rows: DataFrame, part) -> np.ndarray:
    """Sum over all rows of the array that `part` makes of a batch's labels and bins (a row of both for each)."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = 0.0
        for pdf in batches:
            if len(pdf):
                total = total + part(pdf["label"].to_numpy(), np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(len(pdf), -1))
        if not np.isscalar(total):
            yield pd.DataFrame({"p": [total.astype(np.float64).tobytes()]})

    return rows.mapInPandas(partial, "p binary").rdd.map(lambda r: np.frombuffer(bytes(r.p))).treeReduce(np.add)


def _placed(bins: np.ndarray) -> np.ndarray:
    return bins.astype(np.int64) + BINS * np.arange(bins.shape[1])


def _levels(w: np.ndarray) -> tuple[float, float]:
    """Least score and width of a level, from the weights: LEVELS of them hold all scores."""
    low, high = w.reshape(-1, BINS).min(1).sum(), w.reshape(-1, BINS).max(1).sum()
    return low, max(high - low, 1e-9) / (LEVELS - 1)


def _level(w: np.ndarray, places: np.ndarray) -> np.ndarray:
    low, width = _levels(w)
    return np.clip(np.rint((w[places].sum(1) - low) / width), 0, LEVELS - 1).astype(np.int64)


def fit_weights(rows: DataFrame, k: int) -> np.ndarray:
    """Weights of k features' bins by logistic loss over every pair of a row labelled 1 with a row labelled 0, found by Newton steps.

    rows: (label, bins). A pair's loss depends on its two scores alone, so the sums over all pairs follow from sums of rows
    by score level: a step is two passes over the rows, with LEVELS levels and a square of the bins a task.
    """
    size = k * BINS

    def by_level(w: np.ndarray):
        def part(label: np.ndarray, bins: np.ndarray) -> np.ndarray:
            places = _placed(bins)
            at = (label * LEVELS + _level(w, places))[:, None] * size + places
            return np.bincount(at.ravel(), minlength=2 * LEVELS * size)

        return part

    def squares(w: np.ndarray, weight: np.ndarray):
        def part(label: np.ndarray, bins: np.ndarray) -> np.ndarray:
            places, out = _placed(bins), np.zeros((size, size))
            for low in range(0, len(label), 4096):
                own = places[low : low + 4096]
                hot = np.zeros((len(own), size), np.float32)
                hot[np.arange(len(own))[:, None], own] = 1
                u = weight[label[low : low + 4096], _level(w, own)].astype(np.float32)
                out += (hot * u[:, None]).T @ hot
            return out.ravel()

        return part

    w, step, before = np.zeros(size), None, np.inf
    for _ in range(STEPS):
        sums = _total(rows, by_level(w)).reshape(2, LEVELS, size)
        n = sums[:, :, :BINS].sum(2)
        pairs = n[0].sum() * n[1].sum()
        gap = _levels(w)[1] * (np.arange(LEVELS)[:, None] - np.arange(LEVELS)[None, :])  # the better one's level less the worse one's
        loss = n[1] @ np.logaddexp(0, -gap) @ n[0] / pairs + RIDGE / 2 * w @ w
        if step is not None and loss > before + 1e-4 * abs(before):
            step = step / 2
            w = w - step
            continue
        if before - loss < TOLERANCE * loss:
            break
        before, lost = loss, 1 / (1 + np.exp(np.clip(gap, -60, 60)))
        curve = lost * (1 - lost)
        slope = (lost @ n[0] @ sums[1] - n[1] @ lost @ sums[0]) / pairs - RIDGE * w
        weight = np.stack([n[1] @ curve, curve @ n[0]])
        across = sums[1].T @ curve @ sums[0]
        square = (_total(rows, squares(w, weight)).reshape(size, size) - across - across.T) / pairs + RIDGE * np.eye(size)
        step = np.linalg.solve(square, slope)
        w = w + step
    return w


def learning_rows(docs: DataFrame, labels: DataFrame, features_col: str | None = None) -> DataFrame:
    """(label, x): the features of every labelled learning row. Rows with a null id, text or label teach nothing; of labels of one id the
    highest counts, of documents with one id one."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).where(~held_out()).groupBy("doc_id").agg(F.max(F.col("quality").cast("int")).alias("label"))
    x = F.col(features_col) if features_col else featured("text")
    both = docs.where(~held_out()).where(x.isNotNull() if features_col else F.col("text").isNotNull()).join(known, "doc_id")
    return both.select("doc_id", "label", x.alias("x")).groupBy("doc_id", "label").agg(F.min("x").alias("x")).select("label", "x")


def quality_model(docs: DataFrame, labels: DataFrame, features_col: str | None = None) -> Ranker:
    """Fit on every labelled learning row: bins by exact quantiles, weights by all preference pairs, the cut at the share of rows
    labelled 0. Without both labels every score is the threshold's. `features_col`: docs hold `featured` texts already."""
    k = len(FEATURES)
    rows = staged(learning_rows(docs, labels, features_col), "quality-rows")
    n = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not n.get(0) or not n.get(1):
        return Ranker(np.zeros((k, BINS - 1)), np.zeros((k, BINS)), 0.0, 1.0)
    total = sum(n.values())
    at = [max(1, -(-total * i // BINS)) for i in range(1, BINS)]
    edges = order_statistics(rows, lambda pdf: np.stack(pdf["x"].to_numpy()), at, k) if total else None

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()).astype(np.float32) if len(pdf) else np.zeros((0, k))
            yield pd.DataFrame({"label": pdf["label"], "bins": [b.tobytes() for b in np.stack([np.searchsorted(edges[j], x[:, j], "right") for j in range(k)], 1).astype(np.uint8)]})

    bins = staged(rows.where("label in (0, 1)").mapInPandas(binned, "label int, bins binary"), "quality-bins")
    model = Ranker(edges, fit_weights(bins, k).reshape(k, BINS), 0.0, 1.0)
    share = labels.where(F.col("quality").isNotNull() & ~held_out()).agg(F.avg((F.col("quality") == 0).cast("double"))).first()[0]
    last = min(max(1, int(np.ceil(share * total))), total)
    below, above = order_statistics(rows, lambda pdf: model.raw(np.stack(pdf["x"].to_numpy()))[:, None], [last, min(last + 1, total)], 1)[0]
    model.cut = float((below + above) / 2)
    discard(rows)
    discard(bins)
    return model


def featured(text_col: str):
    @F.pandas_udf("array<double>")
    def udf(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    return udf(F.col(text_col))


def ranked(docs: DataFrame, model: Ranker, text_col: str = "text", features_col: str | None = None) -> DataFrame:
    """docs plus `quality_score` (0 to 1; a column of that name is replaced).

    Null and empty texts are scored as wordless; equal texts, so also repeated rows, get equal scores and stay rows of
    their own; an empty table gives no rows; a text is measured whole, however long. `features_col`: as in quality_model.
    """

    @F.pandas_udf("double")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for column in batches:
            rows = [features(None) if x is None else x for x in column] if features_col else [features(t) for t in column]
            yield pd.Series(model.score(np.array(rows, float).reshape(-1, len(FEATURES))))

    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "quality_score"]
    return docs.select(*own, udf(F.col(features_col or text_col)).alias("quality_score"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    # each text is measured once, for learning and for its score
    docs = staged(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("text").isNotNull(), featured("text")).alias("x")), "quality-features")
    out = ranked(docs, quality_model(docs, table(spark, sf_dir, "labels"), "x"), features_col="x")
    return out.select("doc_id", held_out().alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= THRESHOLD).cast("int").alias("predicted"))
