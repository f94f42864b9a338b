import random
import re

from flowharbor.llm import rules


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {p for i in at for p in range(i, i + 8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def texts():
    rng = random.Random(11)
    out = [None, "", " \n\t", "one", "a\nb\n a\na\r\na", "é🙂 ü#*$%&|<>", "x " * 9, "x " * 4000, "A B C D E F G H\n" * 3]
    for n in (7, 8, 9, 30, 300):
        out += [" ".join(rng.choices("abcd", k=n)) for _ in range(12)]
        out += ["\n".join(" ".join(rng.choices(["alpha", "beta", "gamma", "delta"] * 3 + [f"w{i}" for i in range(40)], k=12)) for _ in range(n // 4 + 1)) for _ in range(12)]
    return out


def test_measures_match_brute_force(spark):
    rows = list(enumerate(texts()))
    got = rules.measures(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    have = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got}
    assert have == {i: brute(t) for i, t in rows}


def test_posterior_replaces_passing_all_rules(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(400)]
    good = [" ".join(rng.choices(vocabulary, k=200)) for _ in range(150)]
    bad = [" ".join(w.upper() + "###$$" for w in rng.choices(vocabulary, k=200)) for _ in range(40)]
    one = [" ".join(rng.choices(vocabulary, k=200)) + "\nsame line\nsame line\nsame line\nsame line"]
    rows = [(i, t, True) for i, t in enumerate(good + bad + one)] + [(None, None, False)]
    out = rules.judged(spark.createDataFrame(rows, "doc_id long, text string, kept boolean")).collect()
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in range(150)) and not any(kept[i] for i in range(150, 190))
    assert kept[190] and not kept[None]
    assert all(0 <= r.quality <= 1 for r in out)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    plan = rules.judged(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(spark):
    assert rules.judged(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_expectation_maximisation_matches_plain_python(spark):
    import math

    rng = random.Random(5)
    names = ["a", "b", "c"]
    votes = [tuple(rng.choice((-1, 0, 1, 1)) if i % 3 else rng.choice((-1, -1, 0)) for _ in names) for i in range(300)]
    df = spark.createDataFrame(votes, "a int, b int, c int")
    prior, rate = rules.fit(df.groupBy(*names).count().withColumnRenamed("count", "n"), names, 5)
    p = rules.PRIOR
    r = {(x, v): ((rules.AGREE, 1 - rules.AGREE) if v > 0 else (1 - rules.AGREE, rules.AGREE) if v < 0 else (0.5, 0.5)) for x in names for v in (-1, 0, 1)}

    def good(vote):
        odds = math.log(p / (1 - p)) + sum(math.log(r[x, v][0] / r[x, v][1]) for x, v in zip(names, vote))
        return 1 / (1 + math.exp(-odds))

    for _ in range(5):
        g = [good(v) for v in votes]
        new = {(x, v): ((sum(q for q, y in zip(g, votes) if y[i] == v) + 1) / (sum(g) + 3), (sum(1 - q for q, y in zip(g, votes) if y[i] == v) + 1) / (len(g) - sum(g) + 3)) for i, x in enumerate(names) for v in (-1, 0, 1)}
        p, r = sum(g) / len(g), new
    assert abs(prior - p) < 1e-9 and all(abs(rate[k][i] - r[k][i]) < 1e-9 for k in r for i in (0, 1))
