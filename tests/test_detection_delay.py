"""The first run of alerts of each label, against a walk over its rows."""

import random

from flowharbor.operators.windows import detection_delay


def walked(rows, threshold, consecutive):
    out = {}
    for label in {r[1] for r in rows}:
        mine = sorted((r[2], r[0], r[3]) for r in rows if r[1] == label)
        run, end = 0, None
        for i, (ts, _, score) in enumerate(mine, 1):
            run = run + 1 if score is not None and score >= threshold else 0
            if run == consecutive and end is None:
                end = (ts - mine[0][0], i)
        out[label] = (len(mine), *(end or (None, None)))
    return out


def test_first_runs(spark):
    draw = random.Random(5)
    rows = [(i, draw.choice(["hot"] * 8 + ["b", "c"]), float(draw.randrange(60)), draw.choice([0.1, 0.9, 0.9, None])) for i in range(400)]
    rows += [(500 + i, "never", float(i), 0.1) for i in range(5)] + [(600 + i, "all", 7.0, 1.0) for i in range(5)]
    frame = spark.createDataFrame(rows, "flow_id long, label string, ts double, score double")
    for consecutive in (1, 3, 5):
        got = {r.label: (r["rows"], r.delay_s, r.delay_rows) for r in detection_delay(frame, 0.5, consecutive).collect()}
        assert got == walked(rows, 0.5, consecutive)
    assert detection_delay(frame.limit(0), 0.5, 3).count() == 0
