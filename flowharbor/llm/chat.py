"""Chat formatting into budgeted windows.

Prefix sums of a conversation's turn tokens choose turn-aligned spans; every window but the first repeats the system
turn and as many of the turns before it as its history budget holds, and repeated turns carry no loss. Texts cannot
forge the template: its control strings, and those of common templates, are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, staged, table
from .packing import TOKENIZER, WordIds

#: Tokens of a window and, of these, tokens of repeated history.
BUDGET = 1024
HISTORY = 256
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: Strings that end or begin something in common chat templates. Fixed values.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_FIRST = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_RESTS = "|".join(re.escape(c[1:]) for c in CONTROL)
_ESCAPE = re.compile(rf"([{_FIRST}])(\\*)(?={_RESTS})")
_UNESCAPE = re.compile(rf"([{_FIRST}])\\(\\*)(?={_RESTS})")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)


def escaped(text: str) -> str:
    """One backslash more after the first character of each control string, also of those that have some already."""
    return _ESCAPE.sub(r"\1\2\\", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def role_name(role: str | None) -> str:
    """A role in the template: newlines and backslashes are written \\n and \\\\, control strings escaped."""
    return escaped((role or "").replace("\\", "\\\\").replace("\n", "\\n"))


def role_of(name: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(name))


def turn_text(role: str | None, text: str | None) -> str:
    """A turn as a window holds it, escapes and markers included; it ends with a newline, so windows have the sum of its turns' tokens."""
    return f"{START}{role_name(role)}{MIDDLE}{escaped(text or '')}{END}"


def spans(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Every turn with its place, tokens being those of the turn as written: cid (the conversation's id as text), turn, role, text, tokens, pos (from 0), start (tokens before
    it), sys (tokens of the system turn that windows repeat, else 0), step and win.

    Prefix sums are taken over range partitions: first inside each, then over each conversation's sums by partition, so a hot
    conversation spreads over tasks. A turn belongs to the span of `step` = budget - history - sys tokens in which
    it starts; one that reaches over the span's end by more than `history` has a window of its own (odd `win`), so that a
    window keeps its budget unless a single turn exceeds it. A system turn of over half the budget is not repeated.
    """
    @F.pandas_udf("long")
    def count(turns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        encode = WordIds(tokenizer)
        for roles, texts in turns:
            yield pd.Series([len(ids) // 4 for ids in encode([turn_text(r, t) for r, t in zip(roles, texts, strict=True)])], dtype="int64")

    slim = conversations.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("")).alias("cid"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["cid", "turn", "role", "h"]
    dealt = slim.withColumn("h", F.xxhash64("text")).repartitionByRange(*order)
    rows = staged(dealt.withColumn("tokens", count("role", "text")).withColumn("part", F.spark_partition_id()), "turns")
    sums = rows.groupBy("cid", "part").agg(F.count("*").alias("n"), F.sum("tokens").alias("t"))
    upto = Window.partitionBy("cid").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("cid", "part", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("n0"), F.coalesce(F.sum("t").over(upto), F.lit(0)).alias("t0"))
    first = rows.groupBy("cid").agg(F.min(F.struct("turn", "role", "h", "tokens")).alias("f"))
    repeats = (F.col("f.role") == "system") & (2 * F.col("f.tokens") <= budget)
    before = before.join(first.select("cid", F.when(repeats, F.col("f.tokens")).otherwise(0).alias("sys")), "cid")
    inside = Window.partitionBy("cid", "part").orderBy("turn", "role", "h")
    placed = rows.withColumns({"i": F.row_number().over(inside), "s": F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0))}).join(before, ["cid", "part"])
    placed = placed.withColumns({"pos": F.col("n0") + F.col("i") - 1, "start": F.col("t0") + F.col("s") - F.col("tokens"), "step": F.greatest(F.lit(budget - history) - F.col("sys"), F.lit(1))})
    cell = F.floor(F.col("start") / F.col("step"))
    alone = F.col("start") + F.col("tokens") - (cell + 1) * F.col("step") > history
    return placed.withColumn("win", 2 * cell + alone.cast("long")).select("cid", "turn", "role", "text", "tokens", "pos", "start", "sys", "step", "win")


def formatted(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokenizer: str = TOKENIZER) -> DataFrame:
    """Windows of all conversations (columns conv_id, turn, role, text; others are ignored): conv_id, window (rising along a
    conversation, with gaps), first_turn, context_turns (repeated turns, which come first), tokens, text, loss_starts, loss_ends.

    Loss spans are character positions of new assistant texts, escaped. Turns are ordered by turn, then role and a hash of
    the text, so that ties have one order; null turns come first. Null texts and roles are empty, a null conv_id is a
    conversation of its own, repeated rows are turns of their own, and an empty table gives no window. A task gathers
    one window, never a conversation; the system turn joins its conversation's windows, which adaptive execution splits if hot.
    """
    rows = staged(spans(conversations, budget, history, tokenizer), "spans")
    made = rows.groupBy("cid", "win").agg(F.min("pos").alias("first_turn"), F.min("start").alias("at"), F.sum("tokens").alias("fresh"), F.max("sys").alias("sys"))
    held = F.greatest(F.lit(0), F.least(F.lit(history), F.lit(budget) - F.col("sys") - F.col("fresh")))
    made = staged(made.withColumn("held", F.when(F.col("first_turn") > 0, held).otherwise(0)), "windows")
    turn = ["cid", "win", "pos", "role", "text", "tokens"]
    new = rows.select(*turn, F.lit(False).alias("repeated"))
    low, high = F.floor((F.col("start") + F.col("tokens")) / F.col("step")), F.floor((F.col("start") + history) / F.col("step"))
    near = rows.where(F.col("tokens") <= history).withColumn("win", F.explode(F.sequence(2 * low, 2 * high + 1)))
    past = near.join(made.select("cid", "win", "at", "held"), ["cid", "win"]).where("start + tokens <= at AND start >= at - held").select(*turn, F.lit(True).alias("repeated"))
    system = rows.where("pos = 0 AND sys > 0").drop("win")
    again = system.join(made.where("at > held").select("cid", "win"), "cid").select(*turn, F.lit(True).alias("repeated"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "repeated", "role", "text")))
    windows = new.unionByName(past).unionByName(again).groupBy("cid", "win").agg(parts.alias("turns"), F.sum("tokens").alias("tokens"))

    @F.pandas_udf("text string, loss_starts array<int>, loss_ends array<int>")
    def write(windows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([written(turns) for turns in windows], columns=["text", "loss_starts", "loss_ends"])

    context = F.size(F.filter("turns", lambda t: t["repeated"]))
    first = F.array_min(F.transform(F.filter("turns", lambda t: ~t["repeated"]), lambda t: t["pos"]))
    out = windows.select("cid", F.col("win").alias("window"), first.alias("first_turn"), context.alias("context_turns"), "tokens", write("turns").alias("w"))
    return out.select(F.nullif("cid", F.lit("")).cast("long").alias("conv_id"), "window", "first_turn", "context_turns", "tokens", "w.*")


def written(turns) -> tuple[str, list[int], list[int]]:
    """A window's text and the spans of its new assistant texts, from turns with `repeated`, `role` and `text`."""
    out, at, starts, ends = [], 0, [], []
    for turn in turns:
        head, body = f"{START}{role_name(turn['role'])}{MIDDLE}", escaped(turn["text"])
        if turn["role"] == "assistant" and not turn["repeated"]:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        out.append(head + body + END)
        at += len(out[-1])
    return "".join(out), starts, ends


_READ = "cid string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(windowed: DataFrame) -> DataFrame:
    """What the windows of each conversation say, parsed from their text and loss spans alone: a row a conversation.

    A digest of all turns is sequential, so each conversation's windows stream through one task in their order; nothing of them is kept.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cid, state = None, None

        def row() -> tuple:
            return cid, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for pdf in batches:
            done = []
            for c, context, text, starts, ends in zip(pdf["cid"], pdf["context_turns"], pdf["text"], pdf["loss_starts"], pdf["loss_ends"], strict=True):
                if c != cid:
                    if state:
                        done.append(row())
                    cid, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for i, m in enumerate(_TURN.finditer(text)):
                    if i >= context:
                        state[0] += 1
                        state[1].update(f"{role_of(m[1])}\n{unescaped(m[2])}\n".encode())
                for s, e in zip(starts, ends, strict=True):
                    said = unescaped(text[s:e])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield pd.DataFrame(done, columns=[x.split()[0] for x in _READ.split(", ")])
        if state:
            yield pd.DataFrame([row()], columns=[x.split()[0] for x in _READ.split(", ")])

    keyed = windowed.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("cid"), "window", "context_turns", "text", "loss_starts", "loss_ends")
    read = keyed.repartition("cid").sortWithinPartitions("cid", "window").mapInPandas(run, _READ)
    return read.select(F.nullif("cid", F.lit("")).cast("long").alias("conv_id"), *[F.col(x.split()[0]) for x in _READ.split(", ")[1:]])


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    real = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    forged = [(-7, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))]
    return read_back(formatted(real.unionByName(spark.createDataFrame(forged, real.schema))))
