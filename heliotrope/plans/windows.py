"""Range plans: a metric, an operation and steps, without a query text.

Without a range each step is a bucket [t, t + step) of its own (see operators.signals.downsample). With a range a step's
window is [t - range, t + step), for counters: growth over resets, divided by the time between the first and the last
sample and extended by up to a tenth of it to either side of the window. Results can be grouped (sums at each time), cut to
the k series with the greatest last values, and relabelled.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import drop, keep, label_key, read_key, with_label
from ..operators.signals import downsample
from ..sources.tables import Scan, between
from .promql import Grid, down, folded, match, up, with_changes

MOST_RANGE = 30 * 86400 * 10**9
WINDOWED = ("rate", "increase", "delta", "irate")


@dataclass
class Plan:
    metric: str
    op: str
    start: int
    end: int
    step: int
    range: int | None = None
    matchers: list[tuple[str, str, str]] = field(default_factory=list)
    by: list[str] = field(default_factory=list)
    without: list[str] = field(default_factory=list)
    k: int | None = None
    smallest: bool = False
    param: float | None = None
    relabel: tuple[str, str, str, str] | None = None  # to, replacement, from, regular expression

    def check(self) -> None:
        if not self.metric:
            raise ValueError("a plan needs a metric")
        if self.step <= 0 or self.start >= self.end or self.end - self.start > MOST_RANGE:
            raise ValueError("a plan needs start < end, 30 days apart at most, and step > 0")
        if self.op in ("quantile", "histogram_quantile") and not 0 < (self.param if self.param is not None else 0.5) < 1:
            raise ValueError("a quantile lies between 0 and 1")
        if self.range is not None and self.op not in WINDOWED:
            raise ValueError(f"{self.op} takes no range")


def run(samples: DataFrame | Scan, plan: Plan) -> DataFrame:
    """(step_ts, labels, lkey, value); labels hold the metric's name unless results are grouped by others."""
    plan.check()
    first = plan.start - (plan.range or 0)
    df = between(samples, first, plan.end + (plan.step if plan.range else 0) - 1).where(F.col("metric_name") == plan.metric)
    for name, op, v in plan.matchers:
        df = df.where(match(F.col("labels"), name, op, v))
    if plan.range is None:
        out = downsample(df, plan.metric, plan.op, plan.start, plan.end, plan.step, plan.param)
        out = out.withColumnRenamed("bucket_ns", "step_ts")
    else:
        key = F.col("lkey") if "lkey" in df.columns else label_key(F.col("labels"))
        out = _windowed(df.select(key.alias("lkey"), "ts_ns", "value"), plan)
    out = out.withColumn("labels", with_label(F.col("labels"), "__name__", F.lit(plan.metric)))
    if plan.by or plan.without:
        labels = keep(F.col("labels"), plan.by) if plan.by else F.map_filter("labels", lambda k, v: ~k.isin(plan.without))
        out = out.groupBy("step_ts", label_key(labels).alias("lkey")).agg(F.sum("value").alias("value"))
        out = out.withColumn("labels", read_key(F.col("lkey")))
    if plan.relabel:
        out = out.withColumn("labels", replaced(F.col("labels"), *plan.relabel))
    if plan.by or plan.without or plan.relabel:
        out = out.withColumn("lkey", label_key(F.col("labels")))
    if plan.k is not None:
        last = F.max_by("value", "step_ts")
        kept = out.groupBy("lkey").agg(last.alias("last")).orderBy(F.col("last") if plan.smallest else F.col("last").desc(), "lkey").limit(plan.k)
        out = out.join(kept.select("lkey"), "lkey", "left_semi")
    return out.select("step_ts", "labels", "lkey", "value")


def _windowed(df: DataFrame, plan: Plan) -> DataFrame:
    g = Grid(plan.start, plan.end, plan.step)
    df = with_changes(df.repartition("lkey"))
    t = F.col("ts_ns")
    df = df.withColumn("low", up(t - plan.step + 1, g)).withColumn("high", down(t + plan.range, g)).where("low <= high")
    n, grown, seconds = F.col("n"), F.col("sum_d") - F.col("first_d"), plan.range / 1e9
    span = (F.col("t1") - F.col("t0")) / 1e9
    slack = F.greatest(F.least((F.lit(seconds) - span) / 2, span * 0.1), F.lit(0.0))
    rate = F.when((n >= 2) & (span > 0), grown / span * (span + 2 * slack) / span)
    used, value = {
        "rate": (["n", "t0", "t1", "sum_d", "first_d"], rate),
        "increase": (["n", "t0", "t1", "sum_d", "first_d"], rate * seconds),
        "delta": (["t0", "t1", "first_value", "last_value"], F.col("last_value") - F.col("first_value")),
        "irate": (["n", "t1", "last_d", "last_dt"], F.when((n >= 2) & (F.col("last_dt") > 0), F.col("last_d") / (F.col("last_dt") / 1e9))),
    }[plan.op]
    out = folded(df, g, used).withColumn("value", value).where("value is not null")
    return out.select("step_ts", read_key(F.col("lkey")).alias("labels"), "lkey", "value")


def replaced(labels, to: str, replacement: str, source: str, regex: str):
    """labels with `to` set to the source's value whose first match of the expression is replaced; without a match it is the
    value as it is."""
    got = F.coalesce(F.element_at(labels, F.lit(source)), F.lit(""))
    at, hit = F.regexp_instr(got, F.lit(regex)), F.regexp_extract(got, regex, 0)
    new = F.concat(F.substring(got, F.lit(1), at - 1), F.regexp_replace(hit, regex, replacement), F.substring(got, at + F.char_length(hit), F.char_length(got)))
    rest = F.map_filter(labels, lambda k, v: k != to)
    return F.map_concat(rest, F.create_map(F.lit(to), F.when(at > 0, new).otherwise(got)))


def totals(samples: DataFrame | Scan, metric: str, start: int, end: int) -> DataFrame:
    """One row: points scanned and series met in [start, end]."""
    df = between(samples, start, end).where(F.col("metric_name") == metric)
    return df.agg(F.count(F.lit(1)).alias("points"), F.count_distinct(label_key(drop(F.col("labels"), []))).alias("series"))
