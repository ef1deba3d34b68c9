"""The core queries against their SQL, and the languages' readings on small fixtures."""

import math
import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from heliotrope import queries
from heliotrope.operators import live, rules
from heliotrope.plans import promql_parser, search
from heliotrope.plans.promql import Engine

S = 10**9


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return v


def order(row):
    return tuple((x is None, str(x)) for x in row)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in Path(sf).iterdir():
        con.execute(f"create view {t.stem} as select * from '{t}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(name, spark, sf, duck):
    df = queries.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = [tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    res = duck.execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = [tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()]
    assert sorted(got, key=order) == sorted(want, key=order)


@pytest.fixture(scope="module")
def engine(spark):
    rows = [("requests", {"service": s}, i * 15 * S, float(i * k)) for s, k in (("api", 1), ("web", 3)) for i in range(481)]
    rows += [("churn", {"service": "api"}, t * S, v) for t, v in ((0, 0.0), (10, 50.0), (20, 0.0), (30, 30.0), (40, 0.0), (50, 20.0), (60, 10.0))]
    rows += [("lat_bucket", {"route": "r", "le": le}, m * 60 * S, v) for m in range(3) for le, v in (("0.1", 10.0), ("1.0", 50.0), ("10.0", 90.0), ("+Inf", 100.0))]
    return Engine(spark.createDataFrame(rows, "metric_name string, labels map<string,string>, ts_ns long, value double"))


@pytest.mark.parametrize(
    ("query", "at", "want"),
    [
        ("sum(requests)", 7200, [1920.0]), ("rate(requests[5m])", 7200, [1 / 15, 0.2]), ("increase(requests[5m])", 7200, [20.0, 60.0]), ("count_over_time(requests[5m])", 7200, [21.0, 21.0]),
        ("rate(churn[1m])", 60, [110 / 60]), ("sum_over_time(churn[1m])", 60, [110.0]), ("histogram_quantile(0.9, sum by (le, route) (lat_bucket))", 120, [10.0]), ('absent(nonexistent{job="x"})', 120, [1.0]),
        ("requests == 480", 7200, [480.0]), ("requests offset 1h", 7200, [240.0, 720.0]), ("5 < requests", 7200, [480.0, 1440.0]), ("requests / 0", 7200, [math.inf, math.inf]), ("2 ^ 3 ^ 2", 0, [64.0]),
    ],
)
def test_metric_values(engine, query, at, want):
    got = sorted(r.value for r in engine.query_instant(query, at * S).collect())
    assert got == pytest.approx(sorted(want))


@pytest.mark.parametrize("query", ["", "sum(", "x[5m", "x @ 5", "{}", "topk(x)", "rate(x)[5m", "1 +"])
def test_metric_errors(query):
    with pytest.raises(promql_parser.ParseError):
        promql_parser.parse(query)


@pytest.mark.parametrize(
    ("query", "want"),
    [("TIMEOUT", True), ("service=CHECKOUT", False), ("service=checkout", True), ("service!=api", True), ("attr.http_status_code:500-600", True), ("severity>=FATAL", True), ('body=~"time.ut"', True), ("-timeout", False), ("absent:*", False), ("service:check*", True), ("nothing OR timeout", True), ("NOT (timeout AND nothing)", True), ('"up stream"', False), ("(timeout", False), ("http.status_code>499", True)],
)
def test_search(spark, query, want):
    df = spark.createDataFrame([("upstream timeout", "ERROR", 17, {"http.status_code": "500"}, {"service.name": "checkout"}, None, None)], "body string, severity_text string, severity_number int, attributes map<string,string>, resource map<string,string>, trace_id string, span_id string")
    hit = df.where(search.compile_search(query, search.log_target())).count() == 1
    assert hit == want  # a query that cannot be read becomes its words, signs included


def test_conditions_bind_or_tighter(spark):
    df = spark.createDataFrame([({"a": "1", "b": "2"},)], "fields map<string,string>").withColumn("attributes", F.create_map().cast("map<string,string>")).withColumn("resource", F.col("attributes"))
    yes = lambda c: df.where(live.condition(c)).count() == 1
    assert not yes("a = 1 or a = 1 and b = 9") and yes("z != 1") and not yes("z = 1") and yes("a between 0 and 2 and b in (1, 2)") and yes("not z exists")
    with pytest.raises(live.ConditionError):
        live.condition("a =")


def test_routes_and_inhibition(spark):
    lab = "map<string,string>"
    df = spark.createDataFrame([({"severity": "critical", "cluster": "a"}, 1, "firing"), ({"severity": "warning", "cluster": "a"}, 1, "firing"), ({"severity": "warning", "cluster": "b"}, 1, "firing")], f"labels {lab}, step_ts long, state string")
    root = rules.Route("all", routes=[rules.Route("page", {"severity": "crit.*"}), rules.Route(None, {"cluster": "b"})])
    out = rules.inhibited(df.withColumn("to", rules.receivers(F.col("labels"), root)), {"severity": "critical"}, {"severity": "warning"}, ["cluster"])
    got = {(r.labels["severity"], r.labels["cluster"]): (r.to, r.inhibited) for r in out.collect()}
    assert got == {("critical", "a"): (["page"], False), ("warning", "a"): (["all"], True), ("warning", "b"): (["all"], False)}


def test_alert_stream(spark, tmp_path):
    from heliotrope.streaming.live import alert_transitions

    rows = [("s", t, v) for t, v in ((0, 1.0), (10, 1.0), (20, 1.0), (30, 0.0), (40, 1.0), (50, 0.0))]
    spark.createDataFrame(rows, "lkey string, step_ts long, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("lkey string, step_ts long, value double").parquet(str(tmp_path / "in"))
    q = alert_transitions(stream, 0.5, 20).writeStream.format("memory").queryName("transitions").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [(r.step_ts, r.state) for r in spark.table("transitions").orderBy("step_ts", F.desc("state")).collect()] == [(0, "pending"), (20, "firing"), (30, "resolved"), (40, "pending")]


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())


# -- engine -------------------------------------------------------------------------------------------------------
def test_several_metrics_keep_apart(spark):
    rows = [(m, {"job": "x"}, t * S, float(k * t)) for m, k in (("a", 1), ("b", 5)) for t in range(0, 301, 15)]
    e = Engine(spark.createDataFrame(rows, "metric_name string, labels map<string,string>, ts_ns long, value double"))
    one = lambda q: sorted(r.value for r in e.query_instant(q, 300 * S).collect())
    assert one('count({__name__=~"a|b"})') == [2.0]
    assert one('rate({__name__=~"a|b"}[5m])') == pytest.approx([1.0, 5.0])
    got = e.query_instant('{__name__=~"a|b"}', 300 * S).collect()
    assert sorted(r.labels["__name__"] for r in got) == ["a", "b"]
    assert all(r.labels == {"job": "x"} for r in e.query_instant('rate({__name__=~"a|b"}[5m])', 300 * S).collect())


@pytest.mark.parametrize(("query", "want"), [("ceil(x / 0)", [math.inf]), ("floor(x * 1e300)", [1.5e300]), ("ceil(x)", [2.0]), ("floor(-x)", [-2.0]), ("ceil(x - x) / 0", []), ("floor((x - x) / 0)", [])])
def test_whole_numbers(spark, query, want):
    e = Engine(spark.createDataFrame([("x", {"a": "b"}, 0, 1.5)], "metric_name string, labels map<string,string>, ts_ns long, value double"))
    assert [r.value for r in e.query_instant(query, 0).collect() if not math.isnan(r.value)] == want


def _plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans_push_time_and_fold(spark, sf):
    """The range of a query reaches the files, and its aggregates are hash aggregates over narrow rows."""
    from heliotrope.sources.tables import event_logs, event_samples

    plan = _plan_text(Engine(event_samples(spark, sf)).query_range("sum by (event_type) (rate(event_value[24h]))", queries.START, queries.END, queries.STEP))
    assert "GreaterThanOrEqual(ts,2023-12-31" in plan and "LessThanOrEqual(ts,2024-01-" in plan
    assert "SortAggregate" not in plan and "ObjectHashAggregate" not in plan and "BroadcastNestedLoopJoin" not in plan
    from heliotrope.operators import signals

    plan = _plan_text(signals.search_logs(event_logs(spark, sf), "signup", queries.START, queries.END, 10))
    assert "GreaterThanOrEqual(ts,2024-01-01" in plan and "TakeOrderedAndProject" in plan
    plan = _plan_text(queries.QUERIES["pipeline_log_buckets"](spark, sf))
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    plan = _plan_text(queries.QUERIES["pipeline_correlate_logs"](spark, sf))
    assert "Join" not in plan
    plan = _plan_text(queries.QUERIES["live_metrics"](spark, sf))
    assert plan.count("FileScan") == 1


def test_blocks_are_pruned(spark, sf, tmp_path, monkeypatch):
    """Samples written as blocks give the same answers, read with their stored keys, and days and names prune."""
    from heliotrope.sources import tables

    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")

    path, q = str(tmp_path / "blocks"), "sum by (shard) (increase(event_value[24h]))"
    tables.write_samples(tables.event_samples(spark, sf).all(), path)
    day = 5 * queries.DAY
    ask = lambda src: {(r.step_ts, r.lkey): round(r.value, 6) for r in Engine(src).query_range(q, queries.START + day, queries.START + day + queries.DAY, queries.STEP).collect()}
    blocks = tables.read_samples(spark, path)
    assert ask(blocks) == ask(tables.event_samples(spark, sf)) != {}
    plan = _plan_text(Engine(blocks).query_range(q, queries.START + day, queries.START + day + queries.DAY, queries.STEP))
    scan = next(x for x in plan.split("\n") if "FileScan" in x)
    assert "EqualTo(metric_name,event_value)" in scan and "day" in scan.split("PartitionFilters:")[1].split("PushedFilters")[0] and "labels" not in scan.split("ReadSchema")[1]


def test_range_plans(spark):
    from heliotrope.plans import windows

    rows = [("m", {"a": "x y x"}, t * S, float(t)) for t in range(0, 100, 10)] + [("one", {"a": "b"}, 5 * S, 3.0)]
    df = spark.createDataFrame(rows, "metric_name string, labels map<string,string>, ts_ns long, value double")
    run = lambda **k: windows.run(df, windows.Plan(**({"metric": "m", "op": "rate", "start": 0, "end": 100 * S, "step": 50 * S} | k))).orderBy("step_ts").collect()
    # [0 - 100, 50): five samples over 40 s in a window of 100 s, so a tenth of 40 s is added on either side
    assert [r.value for r in run(range=100 * S)] == pytest.approx([1.0 * 48 / 40, 1.0 * (90 + 2 * 5) / 90])
    assert [r.value for r in run(range=100 * S, op="increase")] == pytest.approx([120.0, 1.0 * 100 / 90 * 100])
    assert run(range=100 * S, relabel=("b", "Z", "a", "x"))[0].labels == {"__name__": "m", "a": "x y x", "b": "Z y x"}
    assert run(metric="one", range=10 * S, op="rate") == [] and [r.value for r in run(metric="one", range=10 * S, op="delta")] == [0.0]
    assert [r.value for r in run(op="abs")] == [40.0, 90.0]
    for bad in ({"op": "avg", "range": S}, {"step": 0}, {"metric": ""}, {"end": 0}, {"end": 31 * 86400 * S}, {"op": "quantile", "param": 1.5}):
        with pytest.raises(ValueError):
            run(**bad)
    assert windows.totals(df, "m", 0, 50 * S).first()[:] == (6, 1)


def test_native_histograms(spark):
    """Empty ones, ranks in the first, an empty and the last bucket, ranges beyond the bounds."""
    h = [("h", {"s": "a"}, 0, 10, 50.0, [1.0, 5.0, 10.0], [4, 0, 4, 2]), ("h", {"s": "none"}, 0, 0, 0.0, [1.0], [0, 0])]
    hist = spark.createDataFrame(h, "metric_name string, labels map<string,string>, ts_ns long, count long, sum double, bounds array<double>, counts array<long>")
    none = spark.createDataFrame([], "metric_name string, labels map<string,string>, ts_ns long, value double")
    e = Engine(none, histograms=hist, native=("h",))
    one = lambda q, s="a": next((r.value for r in e.query_instant(q, 0).collect() if r.labels["s"] == s), None)
    assert one("histogram_quantile(0.2, h)") == pytest.approx(0.5) and one("histogram_quantile(0.6, h)") == pytest.approx(7.5) and one("histogram_quantile(0.95, h)") == 10.0 and one("histogram_quantile(0, h)") == 0.0
    assert one("histogram_quantile(0.5, h)", "none") is None and one("histogram_quantile(2, h)") is None
    assert math.isnan(one("histogram_avg(h)", "none")) and one("histogram_avg(h)") == 5.0 and one("histogram_count(h)") == 10.0 and one("histogram_sum(h)") == 50.0
    mean = (4 * 0.5 + 4 * 7.5) / 8
    assert one("histogram_stdvar(h)") == pytest.approx((4 * (0.5 - mean) ** 2 + 4 * (7.5 - mean) ** 2) / 8) and math.isnan(one("histogram_stddev(h)", "none"))
    assert one("histogram_fraction(0.5, 7.5, h)") == pytest.approx(0.4) and one("histogram_fraction(-5, 100, h)") == pytest.approx(0.8) and math.isnan(one("histogram_fraction(0, 1, h)", "none"))
    with pytest.raises(promql_parser.ParseError):
        e.query_instant("histogram_fraction(1, h)", 0)


def test_live_steps(spark):
    """Fields that are added, histogram points, records that a pipeline drops or sends away, templates, and bare records."""
    logs = spark.createDataFrame([(1, 17, "ERROR", "a=5", {"k": "v"}, {"service.name": "s"}), (2, 9, "INFO", "b", {}, {}), (0, None, None, "a=50", {}, {})], "ts_ns long, severity_number int, severity_text string, body string, attributes map<string,string>, resource map<string,string>")
    steps = [live.Extract(r"a=(?<n>\d+)"), live.AddFields({"team": "t"}), live.Metric("h", "n", ("team",), kind="histogram", bounds=(10.0, 100.0)), live.Metric("c", kind="counter"), live.Route("n > 10", "big"), live.Metric("left")]
    out, points = live.run(live.prepared(logs), [live.Pipeline("p", "body != zzz", steps)])
    assert sorted((r.body, r.destination) for r in out.collect()) == [("a=5", None), ("a=50", "big"), ("b", None)]
    got = sorted((r.metric_name, r.value, r.kind, r.counts, dict(r.labels)) for r in points.collect())
    assert got == [("c", 1.0, "counter", None, {})] * 3 + [("h", 5.0, "histogram", [1, 0, 0], {"team": "t"}), ("h", 50.0, "histogram", [0, 1, 0], {"team": "t"})] + [("left", 1.0, "gauge", None, {})] * 2
    row = live.prepared(logs).orderBy("body").collect()[1]
    assert row.ts_ns > 10**18 and row.severity_number == 9 and row.severity_text == "INFO"
    text = logs.select(live.render("{{ labels.k }}-{{k}}-{{ no }}!", F.col("attributes")).alias("t")).first().t
    assert text == "v-v-!"


def test_limits_are_refused_not_cut(spark, sf):
    from heliotrope.operators import signals
    from heliotrope.sources.tables import event_logs, event_samples

    with pytest.raises(ValueError):
        signals.search_logs(event_logs(spark, sf), "x", 0, 1, limit=10_001)
    with pytest.raises(ValueError):
        signals.label_values(event_samples(spark, sf), "shard", limit=101)


@pytest.fixture(scope="module")
def fleet(spark):
    """Counters of two services, one that grows in bursts, and gauges of three cores."""
    rows = [("requests", {"service": s}, i * 15 * S, float(i * k)) for s, k in (("api", 1), ("web", 3)) for i in range(481)]
    rows += [("bursty", {"service": "api"}, i * 15 * S, 1000.0 * (i // 20)) for i in range(481)]
    rows += [("cpu", {"service": s, "core": c}, i * 15 * S, k + 0.1 * (i % 10)) for s, c, k in (("api", "0", 1.0), ("api", "1", 2.0), ("web", "0", 3.0)) for i in range(481)]
    return Engine(spark.createDataFrame(rows, "metric_name string, labels map<string,string>, ts_ns long, value double"))


CORES = {("api", "0"), ("api", "1"), ("web", "0")}


@pytest.mark.parametrize(
    ("query", "want"),
    [(f"rate(requests[{r}])", {"api": 1 / 15, "web": 3 / 15}) for r in ("1m", "5m", "30m", "1h")]
    + [
        ("rate(bursty[5m])", {"api": 1000 / 300}), ("rate(bursty[1h])", {"api": 12000 / 3600}), ("idelta(requests[10m])", {"api": 1.0, "web": 3.0}), ("max_over_time(requests[5m])", {"api": 480.0, "web": 1440.0}),
        ("min_over_time(requests[5m])", {"api": 460.0, "web": 1380.0}), ("clamp_min(rate(requests[5m]), 0.1)", {"api": 0.1, "web": 0.2}), ("topk(1, requests)", {"web": 1440.0}), ("bottomk(1, requests)", {"api": 480.0}),
        ('requests{service="api"}', {"api": 480.0}), ('requests{service!="api"}', {"web": 1440.0}), ('requests{service=~"api|web"}', {"api": 480.0, "web": 1440.0}), ('requests{service!~"a.*"}', {"web": 1440.0}),
        ('cpu{core="0"} * on(service) cpu{core="1"}', {"api": 2.0}), ("sum(requests) > bool 0", {None: 1.0}), ("sum(rate(requests{service=\"web\"}[5m])) / sum(rate(requests[5m]))", {None: 0.75}), ("abs(-sum(requests))", {None: 1920.0}),
        ("sum(requests) * 2 + 1", {None: 3841.0}), ("sum(requests) % 480", {None: 0.0}), ("sum(requests) ^ 0", {None: 1.0}), ("sum(requests) < bool 1000", {None: 0.0}), ("sum(requests) == bool 1920", {None: 1.0}),
        ("count(cpu)", {None: 3.0}), ("stddev by (service) (cpu)", {"api": 0.5}), ("stdvar without (core) (cpu)", {"api": 0.25}), ("max by (service) (cpu)", {"api": 2.0, "web": 3.0}), ("avg without (core) (cpu)", {"api": 1.5, "web": 3.0}),
        ("max_over_time(requests[10m:7m])", {"api": 468.0, "web": 1404.0}),
    ],
)
def test_fleet(fleet, query, want):
    got = {r.labels.get("service"): r.value for r in fleet.query_instant(query, 7200 * S).collect()}
    assert got == pytest.approx(want)


@pytest.mark.parametrize("query", [f"{f}_over_time(cpu[10m])" for f in ("avg", "min", "max", "sum", "count", "last", "present", "stddev", "stdvar", "mad")] + ["quantile_over_time(0.5, cpu[10m])"] + [f"{f}(cpu)" for f in ("abs", "ceil", "floor", "sqrt", "exp", "ln", "log2", "log10", "sgn", "round", "sin", "cos", "tan", "atan", "sinh", "cosh", "tanh", "asinh", "deg", "rad")])
def test_fleet_keeps_series(fleet, query):
    got = fleet.query_instant(query, 7200 * S).collect()
    assert {(r.labels["service"], r.labels["core"]) for r in got} == CORES and all(math.isfinite(r.value) for r in got)


def test_results(spark, sf, tmp_path):
    import json

    from heliotrope.sources import results, tables

    v = spark.createDataFrame([(2 * S, '{"a":"b"}', 2.0), (S, '{"a":"b"}', math.inf), (S, "{}", 1.5)], "step_ts long, lkey string, value double")
    lines = sorted(r.value for r in results.envelope_lines(v).collect())
    assert [json.loads(x) for x in lines] == [{"metric": {"a": "b"}, "values": [[1.0, "+Inf"], [2.0, "2.0"]]}, {"metric": {}, "values": [[1.0, "1.5"]]}]
    assert {r.target: [tuple(p) for p in r.datapoints] for r in results.simple_json(v).collect()} == {"{}": [(1.5, 1000)], '{"a":"b"}': [(math.inf, 1000), (2.0, 2000)]}
    path = str(tmp_path / "blocks")
    samples = tables.event_samples(spark, sf).all()
    tables.write_samples(samples, path)
    days = results.storage(spark, path).collect()
    assert sum(r.rows for r in days) == samples.count() and all(r.files > 0 and r.bytes > 0 for r in days)


def test_selectors_of_logs(spark):
    df = spark.createDataFrame([("m", "ERROR", 17, {"k": 'a"b'}, {"service.name": "s"}, None, None)], "body string, severity_text string, severity_number int, attributes map<string,string>, resource map<string,string>, trace_id string, span_id string")
    hit = lambda q: df.where(search.compile_search(q, search.log_target())).count() == 1
    assert hit('{k="a\\"b", service=~"s|t"}') and not hit('{service=~"x"}') and hit('{gone=""}') and hit("{}") and not hit('{service!~"s"}')
    with pytest.raises(search.SearchError):
        hit('{k=5}')


def test_correlation_counts_run_along_cells(spark, sf):
    """Counts and maxima equal pairs, at the very ends of windows and of cells too, and no window frame slides."""
    from heliotrope.plans.pipeline import _around

    plan = _plan_text(queries.QUERIES["pipeline_correlate_logs"](spark, sf))
    frames = re.findall(r"RangeFrame, (\S+), (\S+)\)", plan)
    assert frames and {f[0] for f in frames} == {"unboundedpreceding$()"} and all(f[1].startswith("currentrow$()") for f in frames), frames
    rows = [("a", t) for t in range(-25, 40)] + [("b", 0), ("none", 3), ("a", 7)]
    others = [("a", t * t % 37 - 18, t % 5) for t in range(30)] + [("a", 7, 9), ("a", 7, None), ("b", 5, 1), ("b", -5, 2), ("b", 6, 8)]
    got = _around(spark.createDataFrame(rows, "service string, timestamp_ns long"), spark.createDataFrame(others, "service string, timestamp_ns long, _v int"), 5).collect()
    want = []
    for s, t in rows:
        near = [v for o, u, v in others if o == s and abs(u - t) <= 5]
        want.append((s, t, len(near), max((v for v in near if v is not None), default=None)))
    key = lambda r: (r[0], r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_or_reads_each_vector_once(spark, sf):
    """A chain of `or` scans as often as it has vectors, and samples fold into one a series and step before any is dealt out."""
    plan = _plan_text(queries.QUERIES["promql_histogram_quantile_5"](spark, sf))
    assert plan.count("FileScan") == 4 and "LeftAnti" not in plan
    one = _plan_text(Engine(queries.event_samples(spark, sf), 6 * queries.HOUR).query_range("event_value", queries.START, queries.END, queries.STEP))
    assert "max(struct" in one.split("Exchange")[-1].lower()  # the part of the plan that reads
    rows = [(m, {"s": s}, t * S, v) for m, s, t, v in [("a", "x", 10, 1.0), ("a", "x", 10, 3.0), ("a", "x", 9, 8.0), ("a", "x", 61, 4.0), ("b", "x", 50, 5.0), ("b", "y", 50, 6.0), ("c", "y", 55, 7.0), ("c", "z", 55, 2.0), ("c", "x", 115, 9.0)]]
    e = Engine(spark.createDataFrame(rows, "metric_name string, labels map<string,string>, ts_ns long, value double"), 60 * S)
    got = sorted((r.step_ts // S, r.labels["s"], r.value) for r in e.query_range("a or b or (c or a)", 60 * S, 240 * S, 60 * S).collect())
    assert got == [(60, "x", 3.0), (60, "y", 6.0), (60, "z", 2.0), (120, "x", 4.0)]
