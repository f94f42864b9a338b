"""Language by compression: the language whose zstandard raw-content dictionary shortens a text most.

Texts are normalised alike (lower case, letters and single spaces) and encoded whole, in blocks, against each
language's dictionary; the smallest total wins. The margin to the runner-up, a share of the winner's size, makes the
score. Narrow margins are rejected: the least margin is a low quantile of the margins that right predictions of other
learning rows have.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, held_out, table

UNKNOWN = "und"
#: Bytes of a language's dictionary, and so of what it learns from.
DICTIONARY_BYTES = 300_000
#: A text is encoded in blocks of so many characters, each against the whole dictionary.
BLOCK = 2048
LEVEL = 3
#: Under this margin the text is encoded again as its distinct three-word windows, each on its own.
NARROW = 0.01
#: Complete ties are broken by what the text adds behind the last so many bytes of each dictionary.
LEADS = (40, 100, 300)
#: The share of right predictions that the least margin may reject.
REJECTED_SHARE = 0.002
#: A least margin above this rejects ties of the two best at any rate.
TIE = 1e-9
#: Score of a margin m: 1 - exp(-SHARPNESS * m).
SHARPNESS = 30.0
_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: One distinct learning text in RESERVED is kept out of the dictionaries, to measure margins on.
RESERVED = 10
#: Of hashes below 2^63, so many ranges are counted to find a threshold.
RANGES = 4096


def normalised(text: str | None) -> str:
    plain = _NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if plain and not plain.replace(" ", "").isalpha():  # numbers that are words, such as fractions, are no letters
        plain = " ".join("".join(c if c.isalpha() else " " for c in plain).split())
    return plain


def _learnt(docs: DataFrame, text_col: str, lang_col: str, learn: Column | None, reserved: bool) -> DataFrame:
    """(lang, h, n, t) of the rows to learn from, or of those reserved to measure on, which are told apart by the text alone, so
    that no copy is on both sides: h is a hash, n the bytes. Of a text to learn from that is longer than a dictionary t is a stretch that its hash chooses."""
    n, h = F.octet_length(text_col), F.xxhash64(F.lit(0), F.col(text_col)).bitwiseAND(F.lit((1 << 63) - 1))
    mine = (F.pmod(F.xxhash64(F.lit(1), F.col(text_col)), F.lit(RESERVED)) == 0) == F.lit(reserved)
    rows = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & mine)
    rows = rows.where(learn) if learn is not None else rows
    rows = rows.select(F.col(lang_col).alias("lang"), h.alias("h"), n.cast("long").alias("n"), F.col(text_col).alias("t"))
    if reserved:
        return rows
    most = DICTIONARY_BYTES // 4
    first = F.pmod("h", F.greatest(F.char_length("t") - most, F.lit(0)) + 1) + 1
    stretch = F.when(F.col("n") > DICTIONARY_BYTES, F.substring("t", first.cast("int"), F.lit(most))).otherwise(F.col("t"))
    return rows.withColumn("t", stretch).withColumn("n", F.when(F.col("n") > DICTIONARY_BYTES, F.octet_length("t").cast("long")).otherwise(F.col("n")))


def _below(rows: DataFrame, wanted: int, size: Column) -> DataFrame:
    """Of each language the distinct texts in the lowest hash ranges that together hold `wanted` of `size`, or all if they
    do not. Copies count once, in the sizes as in the texts; RANGES counts a language reach the driver, no text is shuffled but those found."""
    width = (1 << 63) // RANGES
    sizes = rows.select("lang", "h", size.alias("s")).distinct().groupBy("lang", F.expr(f"h div {width}").alias("r")).agg(F.sum("s").alias("s")).orderBy("lang", "r").collect()
    cuts, held = {}, {}
    for x in sizes:
        if held.get(x.lang, 0) < wanted:
            cuts[x.lang], held[x.lang] = (x.r + 1) * width - 1, held.get(x.lang, 0) + x.s
    cut = rows.sparkSession.createDataFrame(sorted(cuts.items()), f"lang {dict(rows.dtypes)['lang']}, cut long")
    return rows.join(F.broadcast(cut), "lang").where("h <= cut").groupBy("lang", "h").agg(F.first("t").alias("t"), F.first("n").alias("n"))


def dictionaries(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, size: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """{language: dictionary} from a bounded sample of labelled rows: texts by lowest hash, copies once, until `size` bytes
    are full; twice that reaches the driver at most. The dictionary is their last `size` bytes, so of one of them an end.

    Rows with a null text or language teach nothing, a text over DICTIONARY_BYTES a stretch of it, one text in RESERVED
    nothing; an empty table gives no dictionary. The few texts under the hash threshold are ordered by language.
    """
    near = _below(_learnt(docs, text_col, lang_col, learn, False), size, F.col("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("h").rowsBetween(Window.unboundedPreceding, -1))
    found: dict[str, list] = {}
    for r in near.withColumn("upto", F.coalesce(upto, F.lit(0))).where(F.col("upto") < size).select("lang", "h", "t").collect():
        found.setdefault(r.lang, []).append((r.h, normalised(r.t)))
    raw = {lang: b" ".join(t.encode() for _, t in sorted(found[lang], reverse=True)) for lang in sorted(found)}
    return {lang: x[-size:] for lang, x in raw.items() if len(x) >= 8}


def least_margin(docs: DataFrame, books: dict[str, bytes], text_col: str = "text", lang_col: str = "lang", learn: Column | None = None, share: float = REJECTED_SHARE) -> float:
    """The margin under which a prediction is narrow: the `share` quantile of the margins of right predictions over all reserved
    learning texts, whole and copies once, none of which is in a dictionary; TIE at least. No text is shuffled, only margins."""
    each = _learnt(docs, text_col, lang_col, learn, True).select("lang", "h", _prediction(books, "t").alias("p")).groupBy("lang", "h").agg(F.first("p").alias("p"))
    found = each.where(F.col("p.lang") == F.col("lang")).agg(F.percentile("p.margin", F.lit(share))).first()[0]
    return max(TIE, found or 0.0)


Encoders = list[tuple[str, zstandard.ZstdCompressor]]


def encoders(books: tuple) -> Encoders:
    def of(raw: bytes) -> zstandard.ZstdCompressor:
        book = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        book.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=book, write_content_size=False, write_checksum=False, write_dict_id=False)

    return [(lang, of(raw)) for lang, raw in books]


def classify(text: str | None, books: tuple, with_: Encoders | None = None) -> tuple[str, float]:
    """(language, margin) of a text: und without a letter or a dictionary; ties go to the first language by name.

    A margin is a share of the winner's size. Under NARROW the text is encoded again as its distinct three-word windows, and that
    encoding's margin m, which has another scale, counts as NARROW * m / (NARROW + m): it stays below NARROW.
    """
    plain, with_ = normalised(text), with_ if with_ is not None else encoders(books)
    if not plain or not books:
        return UNKNOWN, 0.0
    sizes = _sizes([plain[i : i + BLOCK].encode() for i in range(0, len(plain), BLOCK)], with_)
    if len(sizes) == 1:
        return sizes[0][1], 1.0
    if sizes[1][0] - sizes[0][0] >= NARROW * sizes[0][0]:
        return sizes[0][1], (sizes[1][0] - sizes[0][0]) / sizes[0][0]
    words = plain.split(" ")
    sizes = _sizes([f" {x} ".encode() for x in dict.fromkeys(" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2)))], with_)
    if sizes[1][0] == sizes[0][0]:
        sizes = _behind_leads(plain.encode(), dict(books), with_)
    margin = (sizes[1][0] - sizes[0][0]) / max(1, sizes[0][0])
    return sizes[0][1], NARROW * margin / (NARROW + margin)


def _sizes(data: list[bytes], with_: Encoders) -> list[tuple[int, str]]:
    return sorted((sum(len(c.compress(x)) for x in data), lang) for lang, c in with_)


def _behind_leads(data: bytes, raw: dict[str, bytes], with_: Encoders) -> list[tuple[int, str]]:
    """What the text adds behind stretches of each language's own dictionary: finer than the text alone, whose few bytes
    may not be worth a compressed block in any language."""
    return sorted((sum(len(c.compress(raw[lang][-n:] + b" " + data + b" ")) - len(c.compress(raw[lang][-n:])) for n in LEADS), lang) for lang, c in with_)


def _prediction(books: dict[str, bytes], text_col: str) -> Column:
    held = tuple(sorted(books.items()))

    @F.pandas_udf("lang string, margin double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with_ = encoders(held)  # they go with the task
        for texts in batches:
            yield pd.DataFrame([classify(t, held, with_) for t in texts], columns=["lang", "margin"])

    return predict(F.col(text_col))


def accepted(docs: DataFrame, books: dict[str, bytes], text_col: str = "text", min_margin: float = TIE) -> DataFrame:
    """The rows of docs that identified() accepts, with the columns of docs: null texts and those without a letter go, repeated rows
    share one fate, an empty table gives no rows."""
    p = docs.withColumn("__lang", _prediction(books, text_col))
    return p.where((F.col("__lang.lang") != UNKNOWN) & (F.col("__lang.margin") >= min_margin)).drop("__lang")


def identified(docs: DataFrame, books: dict[str, bytes], text_col: str = "text", min_margin: float = TIE) -> DataFrame:
    """docs plus `lang_pred`, `lang_score` (0 to 1) and `lang_accepted`: false for und and for margins under `min_margin`.

    Null texts and texts without a letter are und with score 0; a margin equal to `min_margin` is accepted. Equal texts,
    so also repeated rows, fare alike and stay rows of their own; an empty table gives no rows. Columns of docs with these
    names are replaced. The dictionaries go to the tasks with the function: languages * DICTIONARY_BYTES.
    """
    made = ("lang_pred", "lang_score", "lang_accepted")
    own = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    p = docs.select(*own, _prediction(books, text_col).alias("__lang"))
    score = 1 - F.exp(-SHARPNESS * F.col("__lang.margin"))
    fits = (F.col("__lang.lang") != UNKNOWN) & (F.col("__lang.margin") >= min_margin)
    return p.select(*own, F.col("__lang.lang").alias("lang_pred"), score.alias("lang_score"), fits.alias("lang_accepted"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    docs = table(spark, sf_dir, "documents")
    books = dictionaries(docs, learn=~held_out())
    least = least_margin(docs, books, learn=~held_out())
    out = identified(docs.select("doc_id", "text"), books, min_margin=least)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_accepted").alias("accepted"))
