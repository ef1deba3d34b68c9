"""The piped language: fetch logs|traces|metrics | filter ... | parse "re" as f | stats ... by ... | limit n | correlate.

Stages run in the order written, each as one DataFrame step; rows carry named columns and a map `fields` of the rest.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import Scan, all_rows, between
from .promql_parser import duration
from .search import compile_search, row_target

_AGG = re.compile(r"\s*(count|sum|avg|min|max|p50|p95|p99)\s*\(\s*([\w.@]*)\s*\)\s*(?:as\s+(\w+))?\s*", re.I)


class PipelineError(ValueError):
    pass


def stages(query: str) -> list[tuple[str, str]]:
    """(verb, rest) of each stage; bars within quotes do not part stages."""
    parts = re.findall(r'(?:"(?:[^"\\]|\\.)*"|[^|"])+', query)
    out = [(p.strip().split(None, 1) + [""])[:2] for p in parts if p.strip()]
    if not out or out[0][0] != "fetch" or any(v == "fetch" for v, _ in out[1:]):
        raise PipelineError("a pipeline starts with its only fetch")
    seen = False
    for verb, _ in out:
        if verb not in ("fetch", "filter", "parse", "stats", "limit", "correlate"):
            raise PipelineError(f"unknown stage {verb!r}")
        if seen and verb in ("filter", "parse", "correlate"):
            raise PipelineError(f"{verb} cannot follow stats")
        seen |= verb == "stats"
    return [(v, r) for v, r in out]


class Pipelines:
    """Runs pipelines over logs, spans and samples (any may be None)."""

    def __init__(self, logs: DataFrame | Scan | None = None, spans: DataFrame | Scan | None = None, samples: DataFrame | Scan | None = None):
        self.logs, self.spans, self.samples = logs, spans, samples

    def fetch(self, signal: str, start: int, end: int) -> DataFrame:
        if signal == "logs":
            df, ts = self.logs, "ts_ns"
        elif signal == "traces":
            df, ts = self.spans, "start_ns"
        elif signal == "metrics":
            df, ts = self.samples, "ts_ns"
        else:
            raise PipelineError(f"unknown signal {signal!r}")
        df = between(df, start, end, ts)
        if signal == "logs":
            return df.select(F.col("ts_ns").alias("timestamp_ns"), "body", F.col("severity_text").alias("severity"), "severity_number", "trace_id", F.element_at("resource", F.lit("service.name")).alias("service"), F.map_concat(F.map_filter("resource", lambda k, v: ~F.map_contains_key("attributes", k)), "attributes").alias("fields"))
        if signal == "traces":
            return df.select(F.col("start_ns").alias("timestamp_ns"), "name", "trace_id", ((F.col("end_ns") - F.col("start_ns")) / 1e6).alias("duration_ms"), F.when(F.col("status") == 2, "ERROR").when(F.col("status") == 1, "OK").otherwise("UNSET").alias("status"), "kind", "service", F.col("attributes").alias("fields"))
        return df.select(F.col("ts_ns").alias("timestamp_ns"), F.col("metric_name").alias("__name__"), "value", F.element_at("labels", F.lit("service.name")).alias("service"), F.col("labels").alias("fields"))

    def run(self, query: str, start: int, end: int) -> DataFrame:
        df = None
        for verb, rest in stages(query):
            if verb == "fetch":
                df = self.fetch(rest.strip(), start, end)
            elif verb == "filter":
                df = df.where(compile_search(rest, row_target(df.columns), lenient=False))
            elif verb == "parse":
                df = self._parse(df, rest)
            elif verb == "stats":
                df = self._stats(df, rest)
            elif verb == "limit":
                df = df.orderBy(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith("map")]).limit(int(rest))
            else:
                df = self._correlate(df, rest)
        return df

    @staticmethod
    def _parse(df: DataFrame, rest: str) -> DataFrame:
        m = re.fullmatch(r'"((?:[^"\\]|\\.)*)"\s+as\s+(\w+)\s*', rest)
        if not m:
            raise PipelineError('parse takes "regex" as field')
        if re.compile(m[1]).groups < 1:
            raise PipelineError("parse needs a group")
        return df.withColumn(m[2], F.when(F.col("body").rlike(m[1]), F.regexp_extract("body", m[1], 1)))

    @staticmethod
    def _stats(df: DataFrame, rest: str) -> DataFrame:
        interval = None
        if m := re.search(r"\s+interval\s*=\s*(\w+)\s*$", rest):
            interval, rest = duration(m[1]), rest[: m.start()]
        head, _, by = re.split(r"(\s+by\s+)", rest, maxsplit=1) if re.search(r"\s+by\s+", rest) else (rest, "", "")
        t = row_target(df.columns)
        keys = [k.strip() for k in by.split(",") if k.strip()]
        aggs, empty = [], {}
        for part in head.split(","):
            a = _AGG.fullmatch(part)
            if not a:
                raise PipelineError(f"bad aggregate {part.strip()!r}")
            fn, field = a[1].lower(), a[2]
            name, x = a[3] or (f"{fn}_{field}" if field else "count"), t.number(field) if field else None
            if fn != "count" and x is None:
                raise PipelineError(f"{fn} needs a field")
            col = F.count(F.lit(1)) if fn == "count" else F.coalesce(F.sum(x), F.lit(0.0)) if fn == "sum" else F.percentile(x, int(fn[1:]) / 100) if fn[0] == "p" else getattr(F, fn)(x)
            aggs.append(col.alias(name))
            if fn in ("count", "sum"):
                empty[name] = F.lit(0).cast("long") if fn == "count" else F.lit(0.0)
        groups = [t.field(k).alias(k) for k in keys]
        if interval is None:
            return df.groupBy(*groups).agg(*aggs)
        ts = F.col("timestamp_ns")
        cells = df.groupBy(*groups, (ts - F.pmod(ts, F.lit(interval))).alias("bucket_ns")).agg(*aggs)
        names = [f"_k{i}" for i in range(len(keys))]
        # a full grid of the groups and buckets seen: aggregates of aggregates, far fewer than rows
        seen = cells.select("bucket_ns").distinct()
        if keys:
            lo, hi = (cells.agg(f("bucket_ns")).scalar() for f in (F.min, F.max))
            kinds = cells.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]).distinct()
            every = F.when(lo.isNotNull(), F.sequence(F.coalesce(lo, F.lit(0)), F.coalesce(hi, F.lit(0)), F.lit(interval)))
            grid = kinds.select(*names, F.explode(every).alias("bucket_ns")).join(seen, "bucket_ns", "left_semi").select(*names, "bucket_ns")
        else:
            grid = seen
        own = cells.toDF(*[f"_o{i}" for i in range(len(cells.columns))])
        at = dict(zip(cells.columns, own.columns))
        on = F.col("bucket_ns") == F.col(at["bucket_ns"])
        for k, n in zip(keys, names):
            on = on & F.col(n).eqNullSafe(F.col(at[k]))
        cols = [(F.coalesce(F.col(at[c]), empty[c]) if c in empty else F.col(at[c])).alias(c) for c in cells.columns if c not in [*keys, "bucket_ns"]]
        return grid.join(own, on, "left").select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "bucket_ns", *cols)

    def _correlate(self, df: DataFrame, rest: str) -> DataFrame:
        words = rest.split()
        window = duration(next((w.split("=")[1] for w in words if w.startswith("window=")), "5m"))
        if words[:1] == ["traces"]:
            return self._near_traces(df, window)
        if words[:1] != ["logs"]:
            raise PipelineError("correlate takes traces or logs")
        logs = all_rows(self.logs).select(F.element_at("resource", F.lit("service.name")).alias("service"), F.col("ts_ns").alias("timestamp_ns"), F.col("severity_number").alias("_v"))
        out = _around(df, logs, window)
        return out.select(*df.columns, F.col("_c").alias("correlated_log_count"), F.col("_m").alias("correlated_max_severity_number"))

    def _near_traces(self, df: DataFrame, window: int) -> DataFrame:
        """Services, number of spans and longest span of each row's trace; a row whose trace has no span gets those of the
        spans of its service that start within the window."""
        cols = ["correlated_trace_services", "correlated_span_count", "correlated_trace_duration_ms"]
        took = (F.col("end_ns") - F.col("start_ns")) / 1e6
        spans = all_rows(self.spans)
        per = spans.groupBy("trace_id").agg(F.sort_array(F.collect_set("service")).alias(cols[0]), F.count(F.lit(1)).alias(cols[1]), F.max(took).alias(cols[2]))
        met = df.join(per, "trace_id", "left").select(*df.columns, *cols)
        alone = met.where(F.col(cols[1]).isNull()).drop(*cols)
        other = spans.select("service", F.col("start_ns").alias("timestamp_ns"), took.alias("_v"))
        near, some = _around(alone, other, window), F.col("_c") > 0
        near = near.select(*df.columns, F.when(some, F.array("service")).alias(cols[0]), F.when(some, F.col("_c")).alias(cols[1]), F.col("_m").alias(cols[2]))
        return met.where(F.col(cols[1]).isNotNull()).unionByName(near)


def _around(rows: DataFrame, others: DataFrame, window: int) -> DataFrame:
    """rows with the number _c and the largest value _m of the others (service, timestamp_ns, _v) of their service within the
    window. A service's time line is cut into cells as long as a whole window, so that each window is the end of one cell
    and the begin of the next, or one cell: counts and maxima run along sorted cells, from either end. No pairs are made,
    and no window is read anew."""
    size, t = 2 * window + 1, F.col("timestamp_ns")
    there = others.withColumn("_at", t).withColumn("_other", F.lit(1))

    def running(df: DataFrame, at, order, count: str, most: str) -> DataFrame:
        both = df.withColumn("_at", at).unionByName(there, allowMissingColumns=True)
        both = both.withColumn("_cell", F.call_function("div", F.col("_at") - F.pmod("_at", F.lit(size)), F.lit(size)))
        # rows of equal times are peers
        w = Window.partitionBy("service", "_cell").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        both = both.withColumn(count, F.count("_other").over(w)).withColumn(most, F.max("_v").over(w))
        return both.where("_other is null").select(*df.columns, count, most)

    out = running(rows, t + window, F.col("_at"), "_c", "_m")
    out = running(out, t - window, F.col("_at").desc(), "_c0", "_m0")
    whole = F.pmod(t - window, F.lit(size)) == 0
    return out.withColumn("_c", F.col("_c") + F.when(whole, 0).otherwise(F.col("_c0"))).withColumn("_m", F.greatest("_m", "_m0")).drop("_c0", "_m0")
