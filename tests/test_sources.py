"""Readers of exports, writers and readers of blocks, compaction and retention."""

import json

import pytest
from pyspark.sql import functions as F

from heliotrope.operators import signals
from heliotrope.sources import tables

DAY = 86400 * 10**9
ATTR = [{"key": "k", "value": {"stringValue": "v"}}, {"key": "n", "value": {"intValue": "7"}}]
RES = {"attributes": [{"key": "service.name", "value": {"stringValue": "api"}}]}


def snaked(x):
    import re

    if isinstance(x, dict):
        return {re.sub("([A-Z])", lambda m: "_" + m[1].lower(), k): snaked(v) for k, v in x.items()}
    return [snaked(v) for v in x] if isinstance(x, list) else x


@pytest.fixture(params=[lambda x: x, snaked], ids=["camel", "snake"])
def lines(request, spark):
    return lambda *x: spark.createDataFrame([(json.dumps(request.param(v)),) for v in x] + [("no json",)], "value string")


def test_otlp_metrics(lines):
    points = [{"attributes": ATTR, "timeUnixNano": "5", "asDouble": 1.5}, {"timeUnixNano": "6", "asInt": "3"}, {"timeUnixNano": "7"}]
    hist = {"attributes": ATTR, "timeUnixNano": "8", "count": "6", "sum": 9.0, "bucketCounts": ["1", "2", "3"], "explicitBounds": [1.0, 2.0]}
    metrics = [{"name": "g", "gauge": {"dataPoints": points[:2]}}, {"name": "s", "sum": {"dataPoints": points[2:]}}, {"name": "h", "histogram": {"dataPoints": [hist, {"timeUnixNano": "9"}]}}]
    df = lines({"resourceMetrics": [{"resource": RES, "scopeMetrics": [{"metrics": metrics}]}]})
    got = sorted((r.metric_name, r.ts_ns, r.value, tuple(sorted(r.labels.items()))) for r in tables.read_otlp_metrics(df).collect())
    svc = ("service.name", "api")
    assert got == [("g", 5, 1.5, (("k", "v"), ("n", "7"), svc)), ("g", 6, 3.0, (svc,)), ("s", 7, 0.0, (svc,))]
    h = {r.ts_ns: r for r in tables.read_otlp_histograms(df).collect()}
    assert (h[8].value, h[8]["count"], h[8].bounds, h[8].counts) == (9.0, 6, [1.0, 2.0], [1, 2, 3]) and (h[9].value, h[9]["count"], h[9].counts) == (0.0, 0, [])


def test_otlp_logs_and_spans(lines):
    logs = [{"timeUnixNano": "11", "severityNumber": 17, "severityText": "ERROR", "body": {"stringValue": "boom"}, "attributes": ATTR, "traceId": "AB", "spanId": "CD"}, {"timeUnixNano": "0", "observedTimeUnixNano": "12"}]
    got = tables.read_otlp_logs(lines({"resourceLogs": [{"resource": RES, "scopeLogs": [{"logRecords": logs}]}]})).orderBy("ts_ns").collect()
    assert [(r.ts_ns, r.severity_number, r.severity_text, r.body, r.attributes, r.resource, r.trace_id, r.span_id) for r in got] == [(11, 17, "ERROR", "boom", {"k": "v", "n": "7"}, {"service.name": "api"}, "ab", "cd"), (12, 0, "", "", {}, {"service.name": "api"}, None, None)]
    spans = [{"traceId": "AB", "spanId": "01", "name": "GET", "kind": 2, "startTimeUnixNano": "1", "endTimeUnixNano": "4", "attributes": ATTR, "status": {"code": 2}}, {"traceId": "AB", "spanId": "02", "startTimeUnixNano": "2", "endTimeUnixNano": "3"}]
    got = tables.read_otlp_spans(lines({"resourceSpans": [{"resource": RES, "scopeSpans": [{"spans": spans}]}]})).orderBy("span_id").collect()
    assert [tuple(r) for r in got] == [("ab", "01", "GET", 2, 1, 4, 2, {"k": "v", "n": "7"}, "api"), ("ab", "02", "", 0, 2, 3, 0, {}, "api")]


def test_json_logs_and_remote_write(spark):
    rows = [({"timestamp": 1700000000, "message": "m", "level": "warn", "a": 1},), ({"timestamp": 1700000000123, "level": "fatal"},), ({"timestamp": "2023-11-14T22:13:20Z"},)]
    df = spark.createDataFrame([(json.dumps(r),) for (r,) in rows] + [("[]",)], "value string")
    got = tables.read_json_logs(df, service="svc").collect()
    assert [(r.ts_ns, r.severity_number, r.body, r.attributes) for r in got[:3]] == [(1700000000 * 10**9, 13, "m", {"a": "1"}), (1700000000123 * 10**6, 21, "", {}), (1700000000 * 10**9, 9, "", {})]
    series = spark.createDataFrame([({"__name__": "m", "a": "b"}, [(5, 1.0), (6, 2.0)]), ({"a": "b"}, [(5, 1.0)])], "labels map<string,string>, samples array<struct<timestamp:long,value:double>>")
    assert [tuple(r) for r in tables.read_remote_write(series).orderBy("ts_ns").collect()] == [("m", {"a": "b"}, 5_000_000, 1.0), ("m", {"a": "b"}, 6_000_000, 2.0)]
    assert json.loads(tables.ndjson(series).first().value)["labels"] == {"__name__": "m", "a": "b"}


def test_log_and_span_blocks(spark, sf, tmp_path):
    """Blocks give the same searches; days and traces prune; a block written twice counts once after compaction."""
    logs, spans = tables.event_logs(spark, sf), tables.order_spans(spark, sf)
    tables.write_logs(logs.all(), str(tmp_path / "logs"))
    tables.write_spans(spans, str(tmp_path / "spans"))
    start = 19730 * DAY
    find = lambda src: [(r.ts_ns, r.span_id) for r in signals.search_logs(src, "severity>=WARN click OR purchase", start, start + 2 * DAY, 500).collect()]
    blocks = tables.read_logs(spark, str(tmp_path / "logs"))
    assert find(blocks) == find(logs) != []
    trace = spans.first().trace_id
    look = lambda src: sorted(r.span_id for r in signals.search_traces(src, "", 0, 2**62, trace_id=trace).collect())
    assert look(tables.read_spans(spark, str(tmp_path / "spans"))) == look(spans) != []
    few = logs.between(start, start + DAY)
    tables.write_logs(few, str(tmp_path / "logs"))
    assert tables.read_logs(spark, str(tmp_path / "logs")).count() == logs.all().count() + few.count()
    tables.compact(spark, str(tmp_path / "logs"), str(tmp_path / "compact"), "logs")
    done = tables.read_logs(spark, str(tmp_path / "compact"))
    assert done.count() == logs.all().count() and find(done) == find(logs)
    assert done.select(F.input_file_name()).distinct().count() == done.select("day").distinct().count()
    days = sorted(str(r.day) for r in done.select("day").distinct().collect())
    gone = tables.expired(spark, str(tmp_path / "compact"), (start + 5 * DAY), 3)
    assert gone == [d for d in days if d < "2024-01-10"] and tables.read_logs(spark, str(tmp_path / "compact")).where("day < '2024-01-10'").count() == 0
