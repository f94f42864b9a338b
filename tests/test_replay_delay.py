"""The delay from the first attack to the first alert on one."""

from flowharbor.operators.replay import alert_delay

SCHEMA = "id long, ts double, y int, true_alert int"


def delay(spark, *rows):
    (row,) = alert_delay(spark.createDataFrame(list(rows), SCHEMA)).collect()
    return tuple(row)


def test_flows_and_seconds_from_attack_to_alert(spark):
    rows = [(5, 1.0, 0, 0), (4, 2.0, 1, 0), (3, 2.0, 0, 0), (2, 9.0, 1, 1), (1, 9.0, 1, 0), (9, 30.0, 1, 1)]
    # by (ts, id): 5, 3, 4 (first attack), 1, 2 (first alert), 9
    assert delay(spark, *rows) == (2, 4, 2, 7.0)


def test_without_an_alert_an_attack_or_a_flow(spark):
    assert delay(spark, (1, 1.0, 0, 0), (2, 2.0, 1, 0)) == (1, None, None, None)
    assert delay(spark, (1, 1.0, 0, 0)) == (None, None, None, None)
    assert delay(spark) == (None, None, None, None)
    # a flow without a time comes first
    assert delay(spark, (1, None, 0, 0), (2, 2.0, 1, 1)) == (1, 1, 0, 0.0)
