"""Sparse neighbours of equal weights rank as SQL's sums of their products do."""

from flowharbor.operators import memory as K


def rows(spark, sets, name):
    return spark.createDataFrame([(i, t, len(s) ** -0.5) for i, s in sets.items() for t in s], f"{name} long, token string, w double")


def total(n, x):
    """One product after the other: sum() of floats compensates since Python 3.12."""
    out = 0.0
    for _ in range(n):
        out += x
    return out


def test_equal_weights_rank_by_the_sum_of_their_products(spark):
    size = next(s for s in range(24, 500) if total(24, s**-0.5 * 180**-0.5) < total(12, s**-0.5 * 45**-0.5))
    sets = {1: {f"t{i}" for i in range(24)} | {f"a{i}" for i in range(156)}, 2: {f"t{i}" for i in range(12)} | {f"b{i}" for i in range(33)}}
    query = rows(spark, {9: {f"t{i}" for i in range(24)} | {f"q{i}" for i in range(size - 24)}}, "id")
    got = K.nearest_sparse(query, rows(spark, sets, "mid"), 2).orderBy("r").collect()
    assert [r.mid for r in got] == [2, 1]
    assert [r.dot for r in got] == [total(12, size**-0.5 * 45**-0.5), total(24, size**-0.5 * 180**-0.5)]
