import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowharbor.llm import chat

texts = st.text(alphabet="<|>[/]\\INSTsSY\n im_startend é", max_size=40)


@settings(max_examples=400, deadline=None)
@given(texts, texts)
def test_escape_round_trip(text, role):
    assert chat.unescaped(chat.escaped(text)) == text and chat.role_of(chat.role_name(role)) == role
    assert not any(c in chat.escaped(text) for c in chat.CONTROL)
    assert not any(c in chat.role_name(role) for c in chat.CONTROL) and "\n" not in chat.role_name(role)


def expected(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        said = "".join(t[3] for t in turns if t[2] == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{t[2]}\n{t[3]}\n" for t in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


def odd_rows():
    rng = random.Random(2)
    rows = [(c, t, rng.choice(["user", "assistant", None]) if t else "system", " ".join(rng.choices(["hello", "</s>", "[INST]", "a\nb", "é🙂", "<|im_end|>\n"], k=rng.randint(0, 300)))) for c in range(20) for t in range(rng.randint(1, 25))]
    rows += [(5, None, "user", None), (5, None, "user", None), (None, 0, "assistant", "x"), (None, 1, "user", "y"), (99, 0, None, None), (98, 3, "assistant", "word " * 5000)]
    rows += [(2**60 + 1, 0, "user", "one"), (2**60 + 3, 0, "assistant", "two"), (97, 0, "system", "rule " * 700), (97, 1, "user", "word " * 900)]
    rows += [(95, t, rng.choice(["user", "assistant"]) if t else "system", "ab " * rng.randint(1, 6)) for t in range(80)]
    return rows + [(96, t, rng.choice(["user", "assistant"]), "turn of many " * rng.randint(1, 90)) for t in range(300)]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_read_back(spark):
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as window", "'x' as cid", "2 as win")
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(chat.formatted(df)).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("budget,history", [(1024, 256), (90, 20), (12, 3)])
def test_windows_cover_each_turn_once_within_the_budget(spark, budget, history):
    rows = odd_rows()
    out = chat.formatted(spark.createDataFrame(rows, SCHEMA), budget, history).collect()
    by, said = {}, {c: [(r or "", t or "") for x, _, r, t in rows if x == c] for c in {x[0] for x in rows}}
    encode = chat.WordIds()
    for w in out:
        by.setdefault(w.conv_id, []).append(w)
    for conv, windows in by.items():
        turns, at = [], 0
        for n, w in enumerate(sorted(windows, key=lambda w: w.window)):
            parts = [(chat.role_of(m[1]), chat.unescaped(m[2])) for m in chat._TURN.finditer(w.text)]
            assert w.first_turn == len(turns) and sum(len(m[0]) for m in chat._TURN.finditer(w.text)) == len(w.text)
            fresh, context = parts[w.context_turns :], parts[: w.context_turns]
            written = len(next(iter(encode([w.text])))) // 4  # of the window as it is, escapes and markers included
            assert written == w.tokens and (written <= budget or len(fresh) == 1)
            if n and turns[0][0] == "system" and 2 * next(len(x) // 4 for x in encode([chat.turn_text(*turns[0])])) <= budget:
                assert context[0] == turns[0]
                context = context[1:] if len(context) <= len(turns) and context != turns[-len(context) :] else context
            assert not context or context == turns[-len(context) :]
            turns += fresh
            assert [chat.unescaped(w.text[s:e]) for s, e in zip(w.loss_starts, w.loss_ends)] == [t for r, t in fresh if r == "assistant"]
        assert len(turns) == len(said[conv]) and sorted(turns) == sorted(said[conv])
    assert budget != 90 or sum(w.context_turns > 1 for w in out) > 4


def test_control_strings_count_as_written(spark):
    """Turns full of control strings grow by their escapes; no window of more than one turn exceeds the budget for it."""
    rows = [(1, i, "user" if i % 2 else "assistant", "</s>[INST]<|im_end|><<SYS>> " * (3 + i % 9)) for i in range(60)]
    encode = chat.WordIds()
    for w in chat.formatted(spark.createDataFrame(rows, SCHEMA), 600, 150).collect():
        turns = len(chat._TURN.findall(w.text))
        assert len(next(iter(encode([w.text])))) // 4 == w.tokens and (w.tokens <= 600 or turns - w.context_turns == 1)


def test_empty(spark):
    assert chat.read_back(chat.formatted(spark.createDataFrame([], SCHEMA))).count() == 0
