"""The alert machine, notification groups with their ledger, and the series limiter, as classes and as streams."""

import pytest
from pyspark.sql import functions as F

from heliotrope.streaming import alerts

S = 10**9


def test_machine_phases():
    a = alerts.Alert()
    assert a.evaluate(0, True, 10) == ["pending"] and a.evaluate(5, False, 10) == ["resolved"] and a.fired == 0
    assert a.evaluate(10, True, 10) == ["pending"] and a.generation == 1 and a.evaluate(20, True, 10) == ["firing"]
    assert a.act("ack") == ["acknowledged"] and a.act("ack") == [] and a.evaluate(30, True, 10) == []
    assert a.act("expire") == ["firing"] and a.act("noise") == ["noise"] and a.act("mute") == ["suppressed"] and a.act("signal") == ["firing"]
    assert a.evaluate(40, False, 10) == ["resolved"] and a.score == 0.0  # acknowledged once, fired once


def test_machine_suppresses_noise():
    a, seen = alerts.Alert(), []
    for n in range(4):
        seen.append(a.evaluate(2 * n, True, 0))
        a.evaluate(2 * n + 1, False, 0)
    # the third firing: two firings that cleared unattended score 1
    assert seen == [["pending", "firing"], ["pending", "firing"], ["pending", "firing", "suppressed"], ["pending", "firing", "suppressed"]]


def test_groups_and_ledger():
    g, told = alerts.Group(), []
    for ts, alert, state in [(0, "a", "firing"), (10, None, None), (30, None, None), (40, "b", "firing"), (200, None, None), (330, None, None), (400, None, None), (4000, None, None), (4400, "a", "resolved"), (4500, "b", "resolved"), (4800, None, None), (5200, None, None), (5300, "a", "firing"), (5700, None, None)]:
        if state:
            g.change(ts, alert, state)
        told.append((ts, g.due(ts, 30, 300, 3600)))
    assert [x for x in told if x[1]] == [(30, "initial"), (330, "update"), (4000, "repeat"), (4400, "update"), (4800, "resolved"), (5300, "update")]
    assert g.generation == 1


def test_group_keys(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},), ({"c": "3"},)], "labels map<string,string>")
    keys = lambda by: [r[0] for r in df.select(alerts.group_key(F.col("labels"), by, F.lit("rule"))).collect()]
    assert keys(["a", "x"]) == ['{"a":"1"}', '{"alertname":"rule"}'] and keys(["..."]) == ['{"a":"1","b":"2"}', '{"c":"3"}']


def streamed(spark, tmp_path, name, schema, batches, make):
    folder = tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(folder))
    q = make(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_machine_stream(spark, tmp_path):
    schema = "lkey string, step_ts long, value double, event string"
    batches = [[("s", 0, 9.0, None), ("s", 10, 9.0, None)], [("s", 11, None, "ack"), ("t", 12, 0.0, None)], [("s", 20, 0.0, None), ("s", 30, 9.0, None)]]
    got = streamed(spark, tmp_path, "machine", schema, batches, lambda df: alerts.machine(df, 5.0, 10)).orderBy("step_ts", "state").collect()
    assert [tuple(r)[:4] for r in got] == [("s", 0, "pending", 0), ("s", 10, "firing", 0), ("s", 11, "acknowledged", 0), ("s", 20, "resolved", 0), ("s", 30, "pending", 1)]


def test_notification_stream(spark, tmp_path):
    schema = "receiver string, gkey string, step_ts long, lkey string, state string"
    batches = [[("r", "g", 0, "a", "firing"), ("r", "g", 40 * S, None, None)], [("r", "g", 400 * S, "a", "resolved")], [("r", "g", 401 * S, None, None)]]
    got = streamed(spark, tmp_path, "notes", schema, batches, alerts.notifications).orderBy("step_ts").collect()
    assert [tuple(r)[2:] for r in got] == [(40 * S, "initial", 1, 0), (400 * S, "resolved", 0, 1)]


def test_limiter_stream(spark, tmp_path):
    schema = "metric_name string, labels map<string,string>, ts_ns long, value double"
    row = lambda m, s, t: (m, {"s": s}, t, float(t))
    batches = [[row("m", "a", 1), row("m", "a", 2), row("n", "z", 1)], [row("m", "c", 5), row("m", "b", 4)], [row("m", "a", 9), row("m", "c", 9), row("n", "y", 9)]]
    got = streamed(spark, tmp_path, "limited", schema, batches, lambda df: alerts.limit_series(df, 2))
    assert sorted((r.metric_name, r.labels["s"], r.ts_ns) for r in got.collect()) == [("m", "a", 1), ("m", "a", 2), ("m", "a", 9), ("m", "b", 4), ("n", "y", 9), ("n", "z", 1)]


@pytest.mark.parametrize("most", [2, 3, 10, 4096])
def test_evidence(spark, most):
    from heliotrope.operators import rules

    values = [float((i * 37) % 101) for i in range(100)]
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(values)] + [("s", 200, float("inf")), ("t", 1, 1.0)], "lkey string, step_ts long, value double")
    got = [(r.step_ts, r.value) for r in rules.evidence(df, most).where("lkey = 's'").orderBy("step_ts").collect()]
    assert (0, values[0]) in got and (99, values[99]) in got and len(got) <= max(most, 4)
    assert most < 10 or {min(values), max(values)} <= {v for _, v in got}
