"""Label joins, schedules, offsets, context, replay, metrics on literal rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowharbor.operators import labels as L
from flowharbor.operators import memory as K
from flowharbor.operators import metrics as M
from flowharbor.operators import splits as X
from flowharbor.operators import windows as W

LAB = "label_id long, key string, start_ts double, end_ts double, label string"


def test_nearest_label_within_tolerance(spark):
    f = spark.createDataFrame([(1, "k", 102.0), (2, "k", 900.0), (3, "none", 5.0), (4, "m", 1.0)], "flow_id long, key string, ts double")
    lab = spark.createDataFrame([(1, "k", 100.0, 101.0, "BENIGN"), (2, "k", 102.1, 103.0, "DDoS"), (3, "m", None, None, "X")], LAB)
    got = {r.flow_id: (r.label, r.n_candidates) for r in L.label_flows(f, lab, 2.0, 1.0).collect()}
    assert got == {1: ("DDoS", 2), 2: (None, 0), 3: (None, 0), 4: ("X", 1)}


def test_bucketed_join_equals_brute_force_on_a_hot_key(spark):
    rng = random.Random(1)
    fl = [(i, "hot" if i % 3 else "cold", rng.uniform(0, 100)) for i in range(200)]
    la = [(i, rng.choice(["hot", "cold"]), s := rng.uniform(0, 100), s + rng.uniform(0, 9), "L") for i in range(80)]
    got = {r.flow_id: (r.label_id, r.n_candidates) for r in L.label_flows(spark.createDataFrame(fl, "flow_id long, key string, ts double"), spark.createDataFrame(la, LAB), 3.0, 5.0).collect()}
    for i, k, t in fl:
        near = sorted((max(s - t, t - e, 0.0), s, e, j) for j, key, s, e, _ in la if key == k and s - 3 <= t <= e + 3)
        assert got[i] == (near[0][3] if near else None, len(near))


def test_clock_offset(spark):
    f = spark.createDataFrame([("k", 114400.0), ("k", 114410.0)], "key string, ts double")
    lab = spark.createDataFrame([(1, "k", 100000.0, 100001.0, "a"), (2, "k", 100010.0, 100011.0, "a")], LAB)
    assert L.clock_offset(f, lab).first()["offset"] == 14400.0


@pytest.mark.parametrize(("policy", "want"), [("quarantine", {1: "Botnet", 2: "BENIGN", 3: "QUARANTINE"}), ("first", {1: "Botnet", 2: "BENIGN", 3: "Botnet"}), ("drop", {1: "Botnet", 2: "BENIGN"}), ("benign", {1: "Botnet", 2: "BENIGN", 3: "BENIGN"})])
def test_schedule(spark, policy, want):
    f = spark.createDataFrame([(1, "v", "a", 11.0, 12.0), (2, "v", "z", 11.0, 12.0), (3, "a", "v", 30.0, 60.0)], "flow_id long, src string, dst string, start_ts double, end_ts double")
    w = spark.createDataFrame([("w1", "Botnet", 10.0, 40.0, ["a"], ["v"]), ("w2", "DoS", 50.0, 70.0, ["a"], ["v"])], "window_id string, family string, start_ts double, end_ts double, attackers array<string>, victims array<string>")
    assert {r.flow_id: r.family for r in L.label_by_schedule(f, w, 0.0, policy).collect()} == want


def test_merge_windows(spark):
    rows = spark.createDataFrame([("a", 100.0, 100.0), ("a", 120.0, 120.0), ("a", 400.0, 400.0)], "label string, start_ts double, end_ts double")
    got = [(r.start, r.end, r.rows) for r in L.merge_windows(rows).orderBy("start").collect()]
    assert got == [(95.0, 125.0, 2), (395.0, 405.0, 1)]


def test_context_sees_only_prior_rows_of_its_service(spark):
    rows = [(1, "a", 0.0, 2, 5), (2, "b", 0.5, 2, 5), (3, "a", 1.0, 2, 5), (4, "a", 1.5, 2, 5), (5, "a", 1.5, 9, 5), (6, "a", 9.0, 1, 1)]
    f = spark.createDataFrame(rows, "flow_id long, service string, ts double, packets int, bytes int")
    got = {r.flow_id: (r.recent_count, r.recent_short, r.last_gap) for r in W.service_context(f, 2.0).collect()}
    assert got == {1: (0, 0, None), 2: (0, 0, None), 3: (1, 1, 1.0), 4: (2, 2, 0.5), 5: (3, 3, 0.0), 6: (0, 0, None)}


def test_monitor_fires_on_the_third_short_flow(spark):
    f = spark.createDataFrame([(1, "a", 0.0, 2, 1, 0.1), (2, "b", 0.5, 2, 1, 0.1), (3, "a", 1.0, 2, 1, 0.1), (4, "a", 1.5, 2, 1, 0.1)], "flow_id long, service string, ts double, packets int, bytes int, score double")
    got = {r.flow_id: r.hit for r in W.service_monitor(f, 0.9, 2.0, 3, 4, 0.75).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 1}


def test_metrics_against_formulas(spark):
    rng = random.Random(4)
    rows = [(i, int(rng.random() < 0.3), float(rng.randint(0, 12))) for i in range(300)]
    rows = [(i, y, s + 3 * y) for i, y, s in rows]
    df = spark.createDataFrame(rows, "flow_id long, y int, score double")
    pos, neg = [s for _, y, s in rows if y], [s for _, y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg)
    r = M.rank_metrics(df).first()
    assert r.auroc == pytest.approx(auc)
    ap = sum((sum(p >= t for p in pos) - sum(p > t for p in pos)) / len(pos) * sum(p >= t for p in pos) / sum(s >= t for s in pos + neg) for t in {s for s in pos})
    assert r.auprc == pytest.approx(ap)
    assert M.rank_metrics(df.where("y = 1")).first().auroc is None
    best = M.best_macro_f1(M.curve(df)).first()
    assert best.macro_f1 == pytest.approx(max(x.macro_f1 for x in M.curve(df).collect()))
    assert M.curve(df).count() == len({s for _, _, s in rows}) + 1


def test_knn_pads_with_distance_one(spark):
    q = spark.createDataFrame([(1, "x", 1.0), (2, "zz", 1.0)], "id long, token string, w double")
    m = spark.createDataFrame([(7, "x", 0.6), (7, "y", 0.8), (8, "y", 1.0)], "mid long, token string, w double")
    assert {r.id: round(r.score, 9) for r in K.knn_sparse(q, m, 5).collect()} == {1: 0.7, 2: 1.0}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 57])
def test_splits_are_disjoint_and_whole(spark, n):
    f = spark.createDataFrame([(i, "ab"[i % 2], float(-i)) for i in range(n)], "flow_id long, label string, start_ts double")
    for kind in ("random", "stratified", "temporal", "temporal_stratified"):
        got = X.make_split(f, kind)
        assert got.count() == n and X.validate_split(got).count() == 0
    if n >= 3:
        order = {r.flow_id: r.split for r in X.make_split(f, "temporal").collect()}
        assert order[n - 1] == "train" and order[0] == "test" and set(order.values()) == {"train", "val", "test"}


def test_perturbations(spark):
    rows = spark.createDataFrame([("f", float(i), i, 60 + i, i % 2) for i in range(20)] + [("g", 0.0, 0, 5, 1)], "flow string, ts double, seq long, len int, dir int")
    kept = X.perturb(rows, "packet_delete", 1.0)
    assert kept.groupBy("flow").count().count() == 2 and kept.count() >= 2
    assert X.perturb(rows, "direction_flip", 1.0).agg(F.sum("dir")).first()[0] == 10
    assert X.perturb(rows, "length_align", 0.1).agg(F.max("len")).first()[0] == 128
    assert X.perturb(rows, "packet_insert", 0.5).count() > rows.count()
    assert X.perturb(rows, "delay_stretch", 0.5).agg(F.max("ts")).first()[0] > 19


def test_anchored_windows_against_a_plain_fold(spark):
    rng = random.Random(8)
    rows = [(i, "ab"[i % 2], rng.choice([0.1, 0.3]) * rng.randrange(400), rng.random()) for i in range(300)]
    rows += [(900, "b", 5000.0, 1.0), (901, None, 3.0, 1.0), (902, "a", None, 1.0), (903, "c", 7.0, 0.5)]
    df = spark.createDataFrame(rows, "flow_id long, g string, ts double, score double")
    got = {(r.g, r.window): (r.start, r.n, round(r["mean"], 9)) for r in W.anchored_windows(df, ["g"], 1.7).collect()}
    want = {}
    for g in "abc":
        start, window, held = None, -1, []
        for _, _, t, score in sorted((r for r in rows if r[1] == g and r[2] is not None), key=lambda r: r[2]):
            if start is None or t > start + 1.7:
                start, window, held = t, window + 1, []
            held.append(score)
            want[g, window] = (start, len(held), round(sum(held) / len(held), 9))
    assert got == want
    assert W.anchored_windows(df.limit(0), ["g"], 1.7).count() == 0


@pytest.mark.parametrize("shape", [0.4, 0.0, -0.3])
def test_tail_by_likelihood_beats_every_plain_guess(spark, shape):
    rng = random.Random(3)
    draw = lambda q: -math.log(q) if shape == 0 else (q**-shape - 1) / shape
    rows = [(0, draw(1 - rng.random())) for _ in range(3000)]
    df = spark.createDataFrame(rows, "y int, score double")
    got = M.evt_threshold_likelihood(df).first()
    tail = [s - got.u for _, s in rows if s > got.u]

    def loss(x, s):
        return math.inf if s <= 0 or min(1 + x * e / s for e in tail) <= 0 else sum(math.log(s) + (e / s if abs(x) < 1e-12 else (1 + 1 / x) * math.log1p(x * e / s)) for e in tail)

    best, x, s, step = loss(0.1, 1.0), 0.1, 1.0, 0.2
    while step > 1e-9:  # a plain pattern search over (shape, scale)
        near = min(((loss(x + a, s + b), x + a, s + b) for a in (-step, 0, step) for b in (-step, 0, step)), key=lambda r: r[0])
        best, x, s, step = (*near, step) if near[0] < best else (best, x, s, step / 2)
    assert got.k == len(tail) and abs(loss(got["shape"], got.scale) - best) < 1e-6 and loss(got["shape"], got.scale) <= best + 1e-9
    assert got["shape"] == pytest.approx(x, abs=1e-4) and got.scale == pytest.approx(s, abs=1e-4)
    few = M.evt_threshold_likelihood(df.limit(20)).first()
    assert few["shape"] is None and few.threshold == few.plain
