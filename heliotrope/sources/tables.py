"""The three signals as DataFrames: adapters from tables, readers of JSON, and writers of sorted blocks.

samples: metric_name, labels, ts_ns, value. logs: ts_ns, severity_number, severity_text, body, attributes, resource,
trace_id, span_id. spans: trace_id, span_id, name, kind, start_ns, end_ns, status, attributes, service.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CORRELATION = ("service.name", "service.version", "k8s.namespace.name", "k8s.pod.name", "k8s.pod.uid", "k8s.container.name", "k8s.node.name")


def ntz_ns(c: str) -> Column:
    """Nanoseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c}) * 1000")


class Scan:
    """Rows of a signal made from a raw table, whose own time column is bounded before anything is computed, so that the
    bounds reach the files' statistics."""

    def __init__(self, raw: DataFrame, make: Callable[[DataFrame], DataFrame], column: str, time: str = "ts_ns"):
        self.raw, self.make, self.column, self.time = raw, make, column, time
        self.sparkSession = raw.sparkSession

    def all(self) -> DataFrame:
        return self.make(self.raw)

    def between(self, first: int, last: int) -> DataFrame:
        """Rows with first <= time <= last (ns)."""
        raw = self.raw
        for us, op in ((-(-first // 1000), ">="), (last // 1000, "<=")):
            if 0 <= us < 253402300800 * 10**6:  # until the year 9999
                at = datetime(1970, 1, 1) + timedelta(microseconds=us)
                raw = raw.where(F.expr(f"{self.column} {op} TIMESTAMP_NTZ'{at.isoformat(sep=' ')}'"))
        return self.make(raw).where(F.col(self.time).between(first, last))


def between(rows: DataFrame | Scan, first: int, last: int, time: str = "ts_ns") -> DataFrame:
    """Rows with first <= time <= last; of tables by day only those days."""
    if isinstance(rows, Scan):
        return rows.between(first, last)
    if dict(rows.dtypes).get("day") == "date":
        one = 86400 * 10**9
        rows = rows.where(F.col("day").between(*[F.date_from_unix_date(F.lit(max(-(2**31), min(2**31 - 1, t // one)))) for t in (first, last)]))
    return rows.where(F.col(time).between(first, last))


def all_rows(rows: DataFrame | Scan) -> DataFrame:
    return rows.all() if isinstance(rows, Scan) else rows


def event_samples(spark: SparkSession, sf_dir: str) -> Scan:
    """events as a gauge event_value{event_type, shard}."""
    return Scan(spark.read.parquet(f"{sf_dir}/events.parquet"), _samples, "ts")


def _samples(e: DataFrame) -> DataFrame:
    labels = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("shard"), F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")))
    return e.select(F.lit("event_value").alias("metric_name"), labels.alias("labels"), ntz_ns("ts").alias("ts_ns"), F.col("value"))


def event_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_hist{event_type}: a histogram of each day's values, at the day's begin."""
    e = _samples(spark.read.parquet(f"{sf_dir}/events.parquet"))
    day, v, edges = 86400 * 10**9, F.col("value"), (20.0, 60.0, 150.0)
    n = lambda lo, hi: F.count_if((v > lo) & (v <= hi))
    counts = F.array(*[n(lo, hi) for lo, hi in zip((float("-inf"), *edges), (*edges, float("inf")))])
    out = e.groupBy(F.element_at("labels", F.lit("event_type")).alias("event_type"), (F.col("ts_ns") - F.pmod("ts_ns", F.lit(day))).alias("ts_ns")).agg(F.count(F.lit(1)).alias("count"), F.sum("value").alias("sum"), counts.alias("counts"))
    return out.select(F.lit("event_hist").alias("metric_name"), F.create_map(F.lit("event_type"), "event_type").alias("labels"), "ts_ns", F.col("sum").alias("value"), "count", "sum", F.array(*map(F.lit, edges)).alias("bounds"), "counts")


def event_logs(spark: SparkSession, sf_dir: str) -> Scan:
    """events as logs: errors are ERROR, purchases WARN, others INFO."""
    return Scan(spark.read.parquet(f"{sf_dir}/events.parquet"), _logs, "ts")


def _logs(e: DataFrame) -> DataFrame:
    sev = F.when(F.col("event_type") == "error", 17).when(F.col("event_type") == "purchase", 13).otherwise(9)
    body = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" took "), F.col("value").cast("string"), F.lit("ms"))
    attrs = F.create_map(F.lit("event_type"), F.col("event_type"), F.lit("user_id"), F.col("user_id").cast("string"), F.lit("duration_ms"), F.col("value").cast("string"))
    res = F.create_map(F.lit("service.name"), F.concat(F.lit("svc-"), (F.col("user_id") % 5).cast("string")))
    text = F.when(sev == 17, "ERROR").when(sev == 13, "WARN").otherwise("INFO")
    return e.select("event_id", ntz_ns("ts").alias("ts_ns"), sev.alias("severity_number"), text.alias("severity_text"), body.alias("body"), attrs.alias("attributes"), res.alias("resource"), F.lpad(F.hex(F.col("event_id") % 1000), 32, "0").alias("trace_id"), F.lpad(F.hex("event_id"), 16, "0").alias("span_id"))


def order_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as server spans (kind 2), a trace per customer; status F is an error."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    start = ntz_ns("o_orderdate") + F.col("o_orderkey") * 1000
    return o.select(
        F.lpad(F.lower(F.hex("o_custkey")), 32, "0").alias("trace_id"), F.lpad(F.lower(F.hex("o_orderkey")), 16, "0").alias("span_id"), F.concat(F.lit("order "), F.col("o_orderpriority")).alias("name"),
        F.when(F.col("o_orderkey") % 5 == 0, 1).otherwise(2).alias("kind"), start.alias("start_ns"), (start + F.floor(F.col("o_totalprice")).cast("long") * 10000).alias("end_ns"),
        F.when(F.col("o_orderstatus") == "F", 2).otherwise(0).alias("status"), F.create_map(F.lit("priority"), F.col("o_orderpriority")).alias("attributes"), F.concat(F.lit("svc-"), (F.col("o_custkey") % 7).cast("string")).alias("service"),
    )


def read_json_logs(df: DataFrame, col: str = "value", service: str = "unknown", ts_field: str = "timestamp", body_field: str = "message", severity_field: str = "level") -> DataFrame:
    """Generic JSON objects as logs; times in s, ms, us or ns are told apart by magnitude, other keys are attributes."""
    m = F.from_json(F.col(col), "map<string,string>")
    t = F.expr(f"try_cast(element_at(m, '{ts_field}') as decimal(28,9))")  # doubles would lose nanoseconds
    scale = lambda n: (t * F.lit(10**n)).cast("long")
    ns = F.when(t < 10**11, scale(9)).when(t < 10**14, scale(6)).when(t < 10**17, scale(3)).otherwise(t.cast("long"))
    iso = F.expr(f"unix_micros(try_to_timestamp(element_at(m, '{ts_field}'))) * 1000")
    level = F.upper(F.coalesce(F.element_at("m", F.lit(severity_field)), F.lit("INFO")))
    sev = F.when(level.isin("TRACE"), 1).when(level.isin("DEBUG"), 5).when(level.isin("WARN", "WARNING"), 13).when(level.isin("ERROR", "ERR"), 17).when(level.isin("FATAL", "CRITICAL"), 21).otherwise(9)
    rest = F.map_filter("m", lambda k, v: ~k.isin(ts_field, body_field, severity_field))
    return df.select(m.alias("m")).where("m is not null").select(F.coalesce(ns, iso).alias("ts_ns"), sev.alias("severity_number"), level.alias("severity_text"), F.coalesce(F.element_at("m", F.lit(body_field)), F.lit("")).alias("body"), rest.alias("attributes"), F.create_map(F.lit("service.name"), F.lit(service)).alias("resource"), F.lit(None).cast("string").alias("trace_id"), F.lit(None).cast("string").alias("span_id"))


_KV = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
_NUMBER = f"struct<attributes:{_KV},timeUnixNano:string,asDouble:double,asInt:string>"
_HISTOGRAM = f"struct<attributes:{_KV},timeUnixNano:string,count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>>"
_RESOURCE = f"resource:struct<attributes:{_KV}>"
OTLP_METRICS = f"struct<resourceMetrics:array<struct<{_RESOURCE},scopeMetrics:array<struct<metrics:array<struct<name:string,gauge:struct<dataPoints:array<{_NUMBER}>>,sum:struct<dataPoints:array<{_NUMBER}>>,histogram:struct<dataPoints:array<{_HISTOGRAM}>>>>>>>>>"
OTLP_LOGS = f"struct<resourceLogs:array<struct<{_RESOURCE},scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:struct<stringValue:string>,attributes:{_KV},traceId:string,spanId:string>>>>>>>"
OTLP_TRACES = f"struct<resourceSpans:array<struct<{_RESOURCE},scopeSpans:array<struct<spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},status:struct<code:int,message:string>>>>>>>>"


def _attributes(c: Column) -> Column:
    text = lambda v: F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), F.lit(""))
    return F.coalesce(F.map_from_entries(F.transform(c, lambda a: F.struct(a["key"], text(a["value"])))), F.from_json(F.lit("{}"), "map<string,string>"))


def _export(df: DataFrame, col: str, schema: str) -> Column:
    """An export of a JSON column; keys may be written in snake case, as in protobuf's own names."""
    camel = F.col(col)
    names = sorted(set(re.findall(r"(\w+):", schema)))
    for n in names:
        snake = re.sub(r"([A-Z])", lambda m: "_" + m[1].lower(), n)
        if snake != n:
            camel = F.regexp_replace(camel, f'"{snake}"\\s*:', f'"{n}":')
    return F.from_json(camel, schema)


def _items(df: DataFrame, col: str, schema: str, outer: str, inner: str, items: str) -> DataFrame:
    """(res, x): each item with the attributes of its resource."""
    r = df.select(F.explode(_export(df, col, schema)[outer]).alias("r"))
    s = r.select(_attributes(F.col("r.resource.attributes")).alias("res"), F.explode(f"r.{inner}").alias("s"))
    return s.select("res", F.explode(f"s.{items}").alias("x"))


def _labels(p: DataFrame) -> Column:
    labels, svc = _attributes(F.col("p.attributes")), F.element_at("res", F.lit("service.name"))
    more = F.map_concat(labels, F.create_map(F.lit("service.name"), F.coalesce(svc, F.lit(""))))
    return F.when(svc.isNotNull() & ~F.map_contains_key(labels, F.lit("service.name")), more).otherwise(labels)


def read_otlp_metrics(df: DataFrame, col: str = "value") -> DataFrame:
    """OTLP/JSON exports of gauges and sums as samples; a missing number is 0."""
    m = _items(df, col, OTLP_METRICS, "resourceMetrics", "scopeMetrics", "metrics")
    p = m.select("res", "x.name", F.explode(F.concat(F.coalesce("x.gauge.dataPoints", F.array()), F.coalesce("x.sum.dataPoints", F.array()))).alias("p"))
    return p.select(F.col("name").alias("metric_name"), _labels(p).alias("labels"), F.col("p.timeUnixNano").cast("long").alias("ts_ns"), F.coalesce("p.asDouble", F.col("p.asInt").cast("double"), F.lit(0.0)).alias("value"))


def read_otlp_histograms(df: DataFrame, col: str = "value") -> DataFrame:
    """OTLP/JSON exports of histograms: (metric_name, labels, ts_ns, value: the sum, count, sum, bounds, counts)."""
    m = _items(df, col, OTLP_METRICS, "resourceMetrics", "scopeMetrics", "metrics")
    p = m.select("res", "x.name", F.explode("x.histogram.dataPoints").alias("p"))
    total = F.coalesce("p.sum", F.lit(0.0))
    counts = F.transform(F.coalesce("p.bucketCounts", F.array().cast("array<string>")), lambda c: c.cast("long"))
    return p.select(F.col("name").alias("metric_name"), _labels(p).alias("labels"), F.col("p.timeUnixNano").cast("long").alias("ts_ns"), total.alias("value"), F.coalesce(F.col("p.count").cast("long"), F.lit(0)).alias("count"), total.alias("sum"), F.coalesce("p.explicitBounds", F.array().cast("array<double>")).alias("bounds"), counts.alias("counts"))


def read_otlp_logs(df: DataFrame, col: str = "value") -> DataFrame:
    """OTLP/JSON exports of logs; a record without a time has that of its observation."""
    x = _items(df, col, OTLP_LOGS, "resourceLogs", "scopeLogs", "logRecords")
    ts = F.coalesce(F.when(F.col("x.timeUnixNano").cast("long") > 0, F.col("x.timeUnixNano").cast("long")), F.col("x.observedTimeUnixNano").cast("long"), F.lit(0))
    return x.select(ts.alias("ts_ns"), F.coalesce("x.severityNumber", F.lit(0)).alias("severity_number"), F.coalesce("x.severityText", F.lit("")).alias("severity_text"), F.coalesce("x.body.stringValue", F.lit("")).alias("body"), _attributes(F.col("x.attributes")).alias("attributes"), F.col("res").alias("resource"), F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"))


def read_otlp_spans(df: DataFrame, col: str = "value") -> DataFrame:
    """OTLP/JSON exports of spans; status 2 is an error, kind 2 a server's."""
    x = _items(df, col, OTLP_TRACES, "resourceSpans", "scopeSpans", "spans")
    return x.select(F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"), F.coalesce("x.name", F.lit("")).alias("name"), F.coalesce("x.kind", F.lit(0)).alias("kind"), F.col("x.startTimeUnixNano").cast("long").alias("start_ns"), F.col("x.endTimeUnixNano").cast("long").alias("end_ns"), F.coalesce("x.status.code", F.lit(0)).alias("status"), _attributes(F.col("x.attributes")).alias("attributes"), F.coalesce(F.element_at("res", F.lit("service.name")), F.lit("unknown")).alias("service"))


def read_remote_write(df: DataFrame) -> DataFrame:
    """Decoded remote-write series (labels map, samples array of (timestamp in ms, value)) as samples; series without a
    name are left out."""
    p = df.where(F.map_contains_key("labels", F.lit("__name__"))).select("labels", F.explode("samples").alias("s"))
    name = F.element_at("labels", F.lit("__name__"))
    return p.select(name.alias("metric_name"), F.map_filter("labels", lambda k, v: k != "__name__").alias("labels"), (F.col("s.timestamp") * 1_000_000).alias("ts_ns"), F.col("s.value").alias("value"))


def kafka_json(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The stream of a topic's values as text, for the readers above."""
    src = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()
    return src.select(F.col("value").cast("string").alias("value"))


def ndjson(df: DataFrame) -> DataFrame:
    """Rows as one JSON text each, fields without a value left out."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


# -- blocks ---------------------------------------------------------------------------------------------------------
#: What blocks of a signal are sorted by within a day, and which column has a bloom filter.
ORDER = {"samples": (("metric_name", "lkey", "ts_ns"), "metric_name"), "logs": (("service", "ts_ns"), "trace_id"), "spans": (("trace_id", "start_ns"), "trace_id")}


def _write(df: DataFrame, path: str, signal: str, time: str, spread: list[Column]) -> None:
    order, bloom = ORDER[signal]
    df = df.withColumn("day", F.expr(f"date_from_unix_date(cast({time} div 86400000000000 as int))"))
    df = df.repartition("day", *spread).sortWithinPartitions("day", *order)
    df.write.mode("append").partitionBy("day").option("compression", "zstd").option(f"parquet.bloom.filter.enabled#{bloom}", "true").parquet(path)


def write_samples(samples: DataFrame, path: str) -> None:
    """Blocks by day, sorted by metric, series and time, so that row groups prune by name and time; the series' keys are
    stored beside the labels."""
    from ..functions.labels import label_key

    df = samples.withColumn("lkey", label_key(F.col("labels")))
    _write(df, path, "samples", "ts_ns", [F.col("metric_name"), F.pmod(F.xxhash64("lkey"), F.lit(16))])


def write_logs(logs: DataFrame, path: str) -> None:
    """Blocks by day, sorted by service and time."""
    df = logs.withColumn("service", F.element_at("resource", F.lit("service.name")))
    _write(df, path, "logs", "ts_ns", [F.col("service"), F.pmod(F.xxhash64("ts_ns"), F.lit(16))])


def write_spans(spans: DataFrame, path: str) -> None:
    """Blocks by day of their start, sorted by trace."""
    _write(spans, path, "spans", "start_ns", [F.pmod(F.xxhash64("trace_id"), F.lit(16))])


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of a signal; predicates on day, the sorted columns and time prune files and row groups, and stored series
    keys are used as they are."""
    return spark.read.parquet(path)


read_logs = read_spans = read_samples


def compact(spark: SparkSession, path: str, to: str, signal: str, days: int = 1) -> None:
    """Rewrites the blocks of a signal as few sorted ones a day, rows that are there twice (a block written again) once."""
    df = spark.read.parquet(path)
    time = "start_ns" if signal == "spans" else "ts_ns"
    flat = [F.to_json(c).alias(c) if t.startswith("map") else F.col(c) for c, t in df.dtypes]
    first = df.withColumn("_h", F.xxhash64(*flat)).withColumn("_g", F.xxhash64(F.lit(1), *flat)).dropDuplicates(["_h", "_g"]).drop("_h", "_g", "day")
    _write(first, to, signal, time, [F.lit(0) if days <= 1 else F.pmod(F.xxhash64(time), F.lit(days))])


def expired(spark: SparkSession, path: str, now: int, keep_days: int) -> list[str]:
    """Deletes the days of a table of blocks that ended before now - keep_days, and returns their names."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    oldest = (datetime(1970, 1, 1) + timedelta(microseconds=now // 1000) - timedelta(days=keep_days)).date().isoformat()
    gone = [f.getPath() for f in fs.listStatus(root) if f.getPath().getName().startswith("day=") and f.getPath().getName()[4:] < oldest]
    for p in gone:
        fs.delete(p, True)
    return sorted(p.getName()[4:] for p in gone)
