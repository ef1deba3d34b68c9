"""Operators over logs, spans and samples: discovery, volumes, downsampling, span metrics, sampling, limits, anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import label_key, read_key
from ..plans.search import compile_search, log_target, span_target
from ..sources.tables import Scan, all_rows, between

VOLUME_BUCKETS = 60


# -- search -------------------------------------------------------------------------------------------------------
def search_logs(logs: DataFrame | Scan, query: str, start: int, end: int, limit: int = 1000, newest: bool = True, severity_min: int = 0) -> DataFrame:
    """The newest (or oldest) `limit` logs of [start, end] that match; limits beyond 10,000 are refused."""
    _check_limit(limit)
    df = between(logs, start, end).where(F.col("severity_number") >= severity_min).where(compile_search(query, log_target()))
    ts = F.col("ts_ns")
    return df.orderBy(ts.desc() if newest else ts, "span_id").limit(limit)


def _check_limit(limit: int, most: int = 10_000) -> None:
    if not 0 <= limit <= most:
        raise ValueError(f"a limit lies in 0..{most}")


def search_traces(spans: DataFrame, query: str, start: int, end: int, limit: int = 200, trace_id: str | None = None) -> DataFrame:
    """Spans that overlap [start, end] and match, newest first; filters come before the limit, which is 10,000 at most."""
    _check_limit(limit)
    df = spans.where((F.col("start_ns") <= end) & (F.col("end_ns") >= start)).where(compile_search(query, span_target()))
    if trace_id is not None:
        df = df.where(F.col("trace_id") == trace_id.lower())
    return df.orderBy(F.col("start_ns").desc(), "span_id").limit(limit)


def volume(df: DataFrame | Scan, start: int, end: int, ts: str = "ts_ns") -> DataFrame:
    """(bucket, n): rows in 60 buckets of [start, end]; buckets without rows are not there."""
    width = (end - start) // VOLUME_BUCKETS
    if width <= 0:
        return all_rows(df).limit(0).select(F.lit(0).cast("int").alias("bucket"), F.lit(0).cast("long").alias("n"))
    b = F.least(F.greatest(F.floor((F.col(ts) - start) / width), F.lit(0)), F.lit(VOLUME_BUCKETS - 1)).cast("int")
    return between(df, start, end, ts).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# -- discovery ----------------------------------------------------------------------------------------------------
def metric_names(samples: DataFrame) -> DataFrame:
    return all_rows(samples).select("metric_name").distinct()


def label_names(samples: DataFrame) -> DataFrame:
    return all_rows(samples).select(F.explode(F.map_keys("labels")).alias("name")).distinct()


def label_values(samples: DataFrame, label: str, prefix: str = "", limit: int = 100) -> DataFrame:
    """(value, last_ns) newest first; limits beyond 100 are refused."""
    _check_limit(limit, 100)
    v = F.element_at("labels", F.lit(label))
    df = all_rows(samples).where(v.isNotNull() & v.startswith(prefix)).groupBy(v.alias("value")).agg(F.max("ts_ns").alias("last_ns"))
    return df.orderBy(F.col("last_ns").desc(), "value").limit(max(1, limit))


def log_fields(logs: DataFrame) -> DataFrame:
    """(field, n): attributes and how many logs have them."""
    return all_rows(logs).select(F.explode(F.map_keys("attributes")).alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def log_field_values(logs: DataFrame, field: str, limit: int = 100) -> DataFrame:
    v = log_target().field(field)
    return all_rows(logs).where(v.isNotNull()).groupBy(v.alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "value").limit(limit)


# -- metrics ------------------------------------------------------------------------------------------------------
def downsample(samples: DataFrame | Scan, metric: str, op: str, start: int, end: int, step: int, param: float | None = None) -> DataFrame:
    """(bucket_ns, labels, lkey, value) per series and bucket [t, t + step): avg, sum, min, max, count, stddev, stdvar, rate
    and increase (rate without, increase with a reset), delta, irate (of the last two samples), last, quantile (param),
    and of the last sample abs, ceil, floor, round (param: to a multiple), clamp_min, clamp_max (param). With the columns
    of native histograms histogram_quantile (param) of the last one."""
    v, ts, n = F.col("value"), F.col("ts_ns"), F.count(F.lit(1))
    first, last = F.min_by("value", "ts_ns"), F.max_by("value", "ts_ns")
    span = (F.max(ts) - F.min(ts)) / 1e9
    two = lambda x: F.when(n >= 2, x)
    whole = lambda fn: F.when(F.abs(last) < F.lit(2.0**53), fn(last).cast("double")).otherwise(last)
    away = lambda x: F.signum(x) * F.floor(F.abs(x) + 0.5)
    ops = {
        "avg": lambda: F.avg(v), "sum": lambda: F.sum(v), "min": lambda: F.min(v), "max": lambda: F.max(v), "count": lambda: n.cast("double"), "stddev": lambda: two(F.stddev_pop(v)), "stdvar": lambda: two(F.var_pop(v)),
        "rate": lambda: two(F.try_divide(last - first, span)), "increase": lambda: two(F.when(last < first, last).otherwise(last - first)), "delta": lambda: two(last - first), "last": lambda: last,
        "irate": lambda: two(F.try_divide(F.max_by("d", "ts_ns"), F.max_by("dt", "ts_ns") / 1e9)), "quantile": lambda: F.percentile(v, 0.5 if param is None else param),
        "abs": lambda: F.abs(last), "ceil": lambda: whole(F.ceil), "floor": lambda: whole(F.floor), "round": lambda: away(last / param) * param if param else away(last),
        "clamp_min": lambda: F.greatest(last, F.lit(float("-inf") if param is None else float(param))), "clamp_max": lambda: F.least(last, F.lit(float("inf") if param is None else float(param))),
        "histogram_quantile": lambda: F.max_by(_histogram_quantile(0.5 if param is None else param), "ts_ns"),
    }
    df = between(samples, start, end - 1).where(F.col("metric_name") == metric)
    df = df.withColumn("lkey", F.col("lkey") if "lkey" in df.columns else label_key(F.col("labels")))
    df = df.withColumn("bucket_ns", ts - F.pmod(ts - start, F.lit(step)))
    if op == "irate":
        w = Window.partitionBy("lkey", "bucket_ns").orderBy("ts_ns")
        prev = F.lag("value").over(w)
        df = df.withColumn("d", F.when(v < prev, v).otherwise(v - prev)).withColumn("dt", ts - F.lag("ts_ns").over(w))
    return df.groupBy("lkey", "bucket_ns").agg(ops[op]().alias("value")).where("value is not null").select("bucket_ns", read_key(F.col("lkey")).alias("labels"), "lkey", "value")


def _histogram_quantile(q: float):
    """Of counts by bounds: linear within a bucket, from 0 in the first; beyond the last bound up to its double."""
    counts, bounds = F.col("counts"), F.col("bounds")
    total = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c)
    lo = lambda i: F.when(i > 0, F.get(bounds, i - 1)).otherwise(F.lit(0.0))
    cells = F.transform(counts, lambda c, i: F.struct(lo(i).alias("lo"), F.coalesce(F.get(bounds, i), 2 * lo(i)).alias("hi"), c.cast("double").alias("c")))
    begin = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("v"))

    def step(acc, b):
        after = acc["upto"] + b["c"]
        v = b["lo"] + (b["hi"] - b["lo"]) * F.coalesce(F.try_divide(total * q - acc["upto"], b["c"]), F.lit(0.0))
        return F.struct(after.alias("upto"), F.when(acc["v"].isNull() & (after >= total * q), v).otherwise(acc["v"]).alias("v"))

    return F.when(total > 0, F.aggregate(cells, begin, step, lambda acc: acc["v"])).otherwise(0.0)


def limit_series(samples: DataFrame, limit: int) -> DataFrame:
    """Samples of the first `limit` series of each metric, in order of their first sample, then of their key (0: all).
    Series are ranked, not samples: a metric's ranking holds one row a series."""
    samples = all_rows(samples)
    if limit <= 0:
        return samples
    df = samples.withColumn("lkey", label_key(F.col("labels")))
    first = df.groupBy("metric_name", "lkey").agg(F.min("ts_ns").alias("f"))
    kept = first.withColumn("r", F.row_number().over(Window.partitionBy("metric_name").orderBy("f", "lkey"))).where(F.col("r") <= limit)
    return df.join(kept.select("metric_name", "lkey"), ["metric_name", "lkey"], "left_semi").select(*samples.columns)


def mad_anomalies(vectors: DataFrame, key: list[str], sensitivity: float = 3.0) -> DataFrame:
    """(key, last, median, mad, fires): the last value of each series against the median absolute deviation of all; both
    medians are the upper one, and a series needs 5 values."""
    c = vectors.groupBy(*key).agg(F.array_sort(F.collect_list("value")).alias("a"), F.max_by("value", "step_ts").alias("last")).where(F.size("a") >= 5)
    upper = lambda a: F.element_at(a, (F.floor(F.size(a) / 2) + 1).cast("int"))
    c = c.withColumn("median", upper("a"))
    c = c.withColumn("mad", upper(F.array_sort(F.transform("a", lambda x: F.abs(x - F.col("median"))))))
    floor = F.greatest("mad", F.lit(1e-9), F.abs("median") * 0.001)
    return c.select(*key, "last", "median", "mad", (F.abs(F.col("last") - F.col("median")) > max(sensitivity, 0.1) * floor).alias("fires"))


# -- spans --------------------------------------------------------------------------------------------------------
def red_metrics(spans: DataFrame) -> DataFrame:
    """Three gauge points for each server span: requests 1, errors 0 or 1, duration in ms. Works on streams too."""
    svc = F.coalesce("service", F.lit("unknown"))
    labels = F.create_map(F.lit("service"), svc, F.lit("operation"), F.col("name"), F.lit("service.name"), svc)
    point = lambda n, v: F.struct(F.lit(n).alias("metric_name"), v.cast("double").alias("value"))
    points = F.array(point("span_requests_total", F.lit(1)), point("span_errors_total", F.when(F.col("status") == 2, 1).otherwise(0)), point("span_duration_ms", (F.col("end_ns") - F.col("start_ns")) / 1e6))
    return spans.where("kind = 2").select(labels.alias("labels"), F.col("end_ns").alias("ts_ns"), F.explode(points).alias("p")).select("p.metric_name", "labels", "ts_ns", "p.value")


def tail_sample(spans: DataFrame, ratio: float, slow_ms: float | None = None, errors: bool = True, services: dict[str, tuple[float, float | None, bool]] | None = None) -> DataFrame:
    """Whole traces: those with an error (if errors), those with a server span of slow_ms or more, and a share `ratio` of the
    rest by a hash of the trace id. services has (ratio, slow_ms, errors) for traces whose first span is of that service.
    The decision is one combinable aggregate a trace, joined back; no trace is gathered."""
    if ratio >= 1 and not services:
        return spans
    took = F.when(F.col("kind") == 2, (F.col("end_ns") - F.col("start_ns")) / 1e6)
    per = spans.groupBy("trace_id").agg(F.max(F.col("status") == 2).alias("bad"), F.max(took).alias("slowest"), F.min_by(F.coalesce("service", F.lit("")), F.struct("start_ns", "span_id")).alias("service"))
    drawn = F.conv(F.substring(F.md5("trace_id"), 1, 8), 16, 10).cast("long") % 10_000

    def kept(ratio: float, slow_ms: float | None, errors: bool):
        slow = F.coalesce(F.col("slowest") >= slow_ms, F.lit(False)) if slow_ms is not None else F.lit(False)
        return (F.col("bad") & F.lit(errors)) | slow | (drawn < int(min(1.0, max(0.0, ratio)) * 10_000))

    keep = kept(ratio, slow_ms, errors)
    for name, policy in (services or {}).items():
        keep = F.when(F.col("service") == name, kept(*policy)).otherwise(keep)
    return spans.join(per.where(keep).select("trace_id"), "trace_id", "left_semi")


def ingested(spans: DataFrame, ratio: float, **policy) -> tuple[DataFrame, DataFrame]:
    """(points, kept spans): metrics are of all spans, before any is sampled away."""
    return red_metrics(spans), tail_sample(spans, ratio, **policy)


# -- across signals -----------------------------------------------------------------------------------------------
#: How much each dimension that an anchor and an event share tells, strongest first.
DIMENSIONS = ((("trace_id",), 100), (("k8s_pod_uid",), 80), (("k8s_pod_name", "k8s_namespace"), 60), (("service_name",), 40), (("k8s_namespace",), 20))


def correlate(events: DataFrame, anchor: dict[str, str], ts: int, window: int, limit: int = 100) -> DataFrame:
    """Events (logs or samples: ts_ns and columns named as dimensions) within the window that share the anchor's strongest
    dimension, with a score of its weight and their nearness."""
    have = [(names, w) for names, w in DIMENSIONS if all(anchor.get(n) and n in events.columns for n in names)]
    if not have or window <= 0:
        return events.limit(0).withColumn("score", F.lit(0.0))
    names, weight = have[0]
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == anchor[n])
    gap = F.abs(F.col("ts_ns") - ts)
    score = F.lit(weight * 1000.0) + F.lit(100.0) * F.greatest(F.lit(window) - gap, F.lit(0)) / F.lit(window)
    return events.where(same & (gap <= window)).withColumn("score", score).orderBy(F.col("score").desc(), "ts_ns").limit(limit)
