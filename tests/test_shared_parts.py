"""Settings of the profile primitives share what does not depend on them."""

from flowharbor.operators import jobs, profiles


def test_items_are_made_once_and_tokens_agree(spark, monkeypatch):
    rows = [(f"f{i % 24}", i * 0.01, i, (i * 7 % 5) * 50, i % 3 % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "flow string, ts double, seq long, len int, dir int")
    splits = spark.createDataFrame([(f"f{i}", ("train", "train", "val", "test")[i % 4], "ATTACK" if i % 12 == 3 else "BENIGN") for i in range(24)], "flow string, split string, label string")
    made, items = [], profiles.profile_items
    monkeypatch.setattr(profiles, "profile_items", lambda *a: made.append(a) or items(*a))
    parts = profiles.flow_parts(df, 0.1, 8)
    for short in (6, 20):
        alone = profiles.flow_tokens(df, chunk=8, short=short)
        assert sorted(map(str, profiles.flow_tokens(df, chunk=8, short=short, parts=parts).collect())) == sorted(map(str, alone.collect()))
    made.clear()
    found = jobs.primitive_sensitivity(df, splits, [{"short": 6}, {"short": 20}], 1, chunk=8).collect()
    assert len(made) == 1 and sorted(r.setting for r in found) == ["short=20", "short=6"]
