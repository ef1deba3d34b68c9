"""Metric queries compiled to one DataFrame plan over all evaluation steps.

A vector is (step_ts, labels, lkey, value). Samples travel as (lkey, ts_ns, value): lkey, the sorted JSON text of the
labels, is made once, and labels are read back from it after all aggregation, so that no map lies in a hash table. Instant
selectors spread each sample over the steps at which it is the last one (a lead window, no join). Range functions first fold
the samples of a series that lie in the windows of the same steps into one row of combinable states, and spread these rows
over their steps; only medians, quantiles, deviations, regressions and smoothing spread the samples. Changes to the sample
before come from a lag window, where a function asks for them. A selector of several metrics keeps their names in the key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ieee import COMPARE, NAN, OPS
from ..functions.labels import drop, empty_labels, keep, label_key, read_key, with_label
from ..sources.tables import Scan, between
from .promql_parser import Aggregate, Binary, Call, Number, ParseError, Range, Selector, Text, parse

LOOKBACK = 300 * 10**9
SUB_STEP = 60 * 10**9
#: Inner grids that a range query over a sub-query may need, one for each place at which its windows begin.
MOST_GRIDS = 64


@dataclass(frozen=True)
class Grid:
    """Steps start, start + step, ... below end."""

    start: int
    end: int
    step: int

    @property
    def n(self) -> int:
        return max(0, -(-(self.end - self.start) // self.step))


@dataclass
class Scalar:
    """A value per step: a column over step_ts."""

    value: Column


def _whole(fn, x: Column) -> Column:
    """ceil or floor of doubles beyond what a long holds, infinities and NaN too: they are whole, or stay what they are."""
    return F.when(F.abs(x) < F.lit(2.0**53), fn(x).cast("double")).otherwise(x)


RANGE_FUNCTIONS = {"rate", "irate", "increase", "delta", "idelta", "deriv", "predict_linear", "quantile_over_time", "mad_over_time", "avg_over_time", "min_over_time", "max_over_time", "sum_over_time", "count_over_time", "last_over_time", "present_over_time", "stddev_over_time", "stdvar_over_time", "changes", "resets", "double_exponential_smoothing", "holt_winters", "absent_over_time"}
SIMPLE = {n: getattr(F, n) for n in ("abs", "exp", "sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")} | {
    "ceil": lambda x: _whole(F.ceil, x), "floor": lambda x: _whole(F.floor, x), "sqrt": F.sqrt, "sgn": F.signum, "deg": F.degrees, "rad": F.radians,
    "ln": lambda x: F.when(x == 0, F.lit(float("-inf"))).otherwise(F.ln(x)), "log2": lambda x: F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log2(x)), "log10": lambda x: F.when(x == 0, F.lit(float("-inf"))).otherwise(F.log10(x)),
}
_time = lambda x: F.timestamp_seconds(x)
DATE = {"minute": F.minute, "hour": F.hour, "day_of_week": lambda t: F.dayofweek(t) - 1, "day_of_month": F.dayofmonth, "day_of_month_iso": F.dayofmonth, "day_of_year": F.dayofyear, "days_in_month": lambda t: F.dayofmonth(F.last_day(t)), "month": F.month, "year": F.year}


def match(labels: Column, name: str, op: str, value: str) -> Column:
    """A label matcher: an absent label counts as empty; regular expressions are searched, not anchored."""
    got = F.coalesce(F.element_at(labels, F.lit(name)), F.lit(""))
    return {"=": got == value, "!=": got != value, "=~": got.rlike(value), "!~": ~got.rlike(value)}[op]


def with_changes(df: DataFrame) -> DataFrame:
    """(lkey, ts_ns, value) with what changed against the series' sample before: d (growth, a reset starts anew), chg, rst, dt."""
    w = Window.partitionBy("lkey").orderBy("ts_ns", "value")
    v, p = F.col("value"), F.col("prev")
    df = df.select("lkey", "ts_ns", "value", F.lag("value").over(w).alias("prev"), (F.col("ts_ns") - F.lag("ts_ns").over(w)).alias("dt"))
    df = df.withColumn("d", F.when(p.isNull(), 0.0).when(v < p, v).otherwise(v - p))
    return df.withColumn("chg", F.when(p.isNotNull() & (p != v), 1.0).otherwise(0.0)).withColumn("rst", F.when(p.isNotNull() & (v < p), 1.0).otherwise(0.0))


def spread(df: DataFrame, g: Grid) -> DataFrame:
    """Rows at each of their steps low to high."""
    k = F.explode(F.sequence("low", "high"))
    return df.withColumn("k", k).withColumn("step_ts", F.lit(g.start) + F.col("k") * g.step).drop("low", "high", "k")


def folded(df: DataFrame, g: Grid, used: list[str]) -> DataFrame:
    """(step_ts, lkey) with the states used, of samples (lkey, ts_ns, value, ..., low, high): those of a series and of the
    same steps become one row first, which is then spread over its steps and combined with others."""
    clean = F.nanvl(F.col("value"), F.lit(None))
    # each state: how samples are folded into it, and how states are
    states = {
        "n": (F.count(F.lit(1)), F.sum("n")), "t0": (F.min("ts_ns"), F.min("t0")), "t1": (F.max("ts_ns"), F.max("t1")),
        "least": (F.min(clean), F.min("least")), "most": (F.max(clean), F.max("most")),
        **{f"sum_{x}": (F.sum(x), F.sum(f"sum_{x}")) for x in ("value", "d", "chg", "rst")},
        **{f"first_{x}": (F.min_by(x, "ts_ns"), F.min_by(f"first_{x}", "t0")) for x in ("value", "d", "chg", "rst")},
        **{f"last_{x}": (F.max_by(x, "ts_ns"), F.max_by(f"last_{x}", "t1")) for x in ("value", "d", "dt")},
    }
    cells = df.groupBy("lkey", "low", "high").agg(*[states[x][0].alias(x) for x in used])
    return spread(cells, g).groupBy("step_ts", "lkey").agg(*[states[x][1].alias(x) for x in used])


def up(t: Column, g: Grid) -> Column:
    """The first step at or after t, in whole numbers."""
    return F.greatest(-_floor_div(-(t - g.start), g.step), F.lit(0).cast("long"))


def down(t: Column, g: Grid) -> Column:
    """The last step at or before t."""
    return F.least(_floor_div(t - g.start, g.step), F.lit(g.n - 1).cast("long"))


# -- native histograms: a column h of count, sum, bounds and counts (one more, beyond the last bound) ---------------------
def _buckets() -> Column:
    """The buckets below the last bound: from lo (0 for the first) to hi, with c observations."""
    h = F.col("h")
    lo = lambda i: F.when(i > 0, F.get(h["bounds"], i - 1)).otherwise(F.lit(0.0))
    return F.transform(h["bounds"], lambda b, i: F.struct(lo(i).alias("lo"), b.alias("hi"), F.coalesce(F.get(h["counts"], i), F.lit(0)).cast("double").alias("c")))


def _total(of) -> Column:
    return F.aggregate(_buckets(), F.lit(0.0), lambda acc, b: acc + of(b))


def _variance() -> Column:
    """Of the middles of finite buckets, by their counts; NaN without any."""
    fine = lambda b, x: F.when((b["c"] > 0) & (F.abs(b["hi"]) < float("inf")), b["c"] * x).otherwise(0.0)
    middle = lambda b: (b["lo"] + b["hi"]) / 2
    n = _total(lambda b: fine(b, F.lit(1.0)))
    mean = F.try_divide(_total(lambda b: fine(b, middle(b))), n)
    return F.coalesce(F.try_divide(_total(lambda b: fine(b, F.pow(middle(b) - mean, F.lit(2.0)))), n), F.lit(NAN))


def _fraction(low: float, high: float) -> Column:
    """The share of observations in [low, high), linear within buckets."""
    count = F.col("h")["count"].cast("double")

    def below(v: float) -> Column:
        inside = lambda b: F.coalesce(F.try_divide(F.lit(v) - b["lo"], b["hi"] - b["lo"]), F.lit(0.0)) * b["c"]
        part = _total(lambda b: F.when(F.lit(v) <= b["lo"], 0.0).when(F.lit(v) >= b["hi"], b["c"]).otherwise(inside(b)))
        return F.least(part, count)

    return F.when(count > 0, F.greatest(below(high) - below(low), F.lit(0.0)) / count).otherwise(F.lit(NAN))


def _quantile(q: float) -> Column:
    """Linear within the first bucket that reaches the rank; the last bound beyond it."""
    count, bounds = F.col("h")["count"].cast("double"), F.col("h")["bounds"]
    if not 0 <= q <= 1:
        return F.lit(NAN)
    rank = count * q
    begin = F.struct(F.lit(0.0).alias("upto"), F.lit(None).cast("double").alias("v"))

    def step(acc, b):
        after = acc["upto"] + b["c"]
        v = F.when(b["c"] <= 0, b["hi"]).otherwise(b["lo"] + (b["hi"] - b["lo"]) * F.try_divide(rank - acc["upto"], b["c"]))
        return F.struct(after.alias("upto"), F.when(acc["v"].isNull() & (after >= rank), v).otherwise(acc["v"]).alias("v"))

    found = F.aggregate(_buckets(), begin, step, lambda acc: acc["v"])
    return F.when(count > 0, F.coalesce(found, F.get(bounds, F.size(bounds) - 1), F.lit(float("inf")))).otherwise(F.lit(NAN))


HISTOGRAM = {
    "histogram_count": lambda: F.col("h")["count"].cast("double"), "histogram_sum": lambda: F.col("h")["sum"], "histogram_avg": lambda: F.coalesce(F.try_divide(F.col("h")["sum"], F.col("h")["count"]), F.lit(NAN)),
    "histogram_stdvar": _variance, "histogram_stddev": lambda: F.sqrt(_variance()), "histogram_fraction": _fraction, "histogram_quantile": _quantile,
}


class Engine:
    """Evaluates queries over samples (metric_name, labels, ts_ns, value), a table or a Scan; a column lkey, as in blocks
    of write_samples, is used as it is."""

    def __init__(self, samples: DataFrame | Scan, lookback: int = LOOKBACK, histograms: DataFrame | Scan | None = None, native: tuple[str, ...] = ()):
        """histograms (metric_name, labels, ts_ns, count, sum, bounds, counts) serve the histogram_ functions;
        histogram_quantile takes the metrics named in native from there, others from buckets by le."""
        self.samples, self.lookback, self.histograms, self.native = samples, lookback, histograms, native
        self.spark: SparkSession = samples.sparkSession

    # -- entry points -------------------------------------------------------------------------------------------
    def query_range(self, query: str, start: int, end: int, step: int) -> DataFrame:
        if start >= end or step <= 0:
            raise ValueError("a range query needs start < end and step > 0")
        return self._vector(parse(query), Grid(start, end, step)).select("step_ts", "labels", "lkey", "value")

    def query_instant(self, query: str, ts: int) -> DataFrame:
        return self.query_range(query, ts, ts + 1, 1)

    # -- nodes --------------------------------------------------------------------------------------------------
    def _steps(self, g: Grid) -> DataFrame:
        return self.spark.range(g.n).select((F.lit(g.start) + F.col("id") * g.step).alias("step_ts"))

    def _vector(self, node, g: Grid) -> DataFrame:
        out = self.eval(node, g)
        if isinstance(out, Scalar):
            return self._constant(out.value, g)
        return out

    def _constant(self, value: Column, g: Grid) -> DataFrame:
        df = self._steps(g).withColumn("labels", empty_labels()).withColumn("value", value.cast("double"))
        return df.withColumn("lkey", F.lit("{}"))

    def eval(self, node, g: Grid):
        if isinstance(node, Number):
            return Scalar(F.lit(node.value))
        if isinstance(node, Selector):
            return self._instant(node, g)
        if isinstance(node, Range):
            raise ParseError("a range vector needs a range function")
        if isinstance(node, Call):
            return self._call(node, g)
        if isinstance(node, Aggregate):
            return self._aggregate(node, g)
        if isinstance(node, Binary):
            return self._binary(node, g)
        raise ParseError("a text is no query")

    def _selected(self, s: Selector, first: int, last: int) -> DataFrame:
        """(lkey, ts_ns, value): samples of a selector in [first, last]."""
        df = between(self.samples, first, last)
        if s.name:
            df = df.where(F.col("metric_name") == s.name)
        for name, op, v in s.matchers:
            on = F.create_map(F.lit("__name__"), F.col("metric_name")) if name == "__name__" else F.col("labels")
            df = df.where(match(on, name, op, v))
        if not s.name:
            key = label_key(F.map_concat(drop(F.col("labels"), []), F.create_map(F.lit("__name__"), F.col("metric_name"))))
        else:
            key = F.col("lkey") if "lkey" in df.columns else label_key(F.col("labels"))
        return df.select(key.alias("lkey"), "ts_ns", "value")

    def _series(self, s: Selector, first: int, last: int, by_time: int = 0) -> DataFrame:
        """_selected(), of a series and time one (the largest of equal times); dealt out by series, or by series and spans of
        by_time ns where no step looks at more."""
        df, parts = self._selected(s, first, last), ["lkey"]
        if by_time:
            df, parts = df.withColumn("_span", _floor_div(F.col("ts_ns"), by_time)), ["lkey", "_span"]
        # of equal times the last in order of value stays, by a sort that the windows over changes need anyway
        w = Window.partitionBy(*parts).orderBy("ts_ns", "value")
        df = df.repartition(*parts).withColumn("_next", F.lead("ts_ns").over(w))
        return df.where("_next is null or _next > ts_ns").select("lkey", "ts_ns", "value")

    def _instant(self, s: Selector, g: Grid) -> DataFrame:
        """Of a series' samples with the same first step only the last (of equal times the largest) can be the last at any
        step: they become one row where they are read, and the window is over these rows."""
        df = self._selected(s, g.start - s.offset - self.lookback, g.end - 1 - s.offset)
        cells = df.groupBy("lkey", up(F.col("ts_ns") + s.offset, g).alias("low")).agg(F.max(F.struct("ts_ns", "value")).alias("x"))
        df, t = cells.select("lkey", "low", "x.ts_ns", "x.value"), F.col("ts_ns") + s.offset
        nxt = F.lead("ts_ns").over(Window.partitionBy("lkey").orderBy("ts_ns")) + s.offset
        last = F.least(F.coalesce(nxt - 1, t + self.lookback), t + self.lookback)
        df = df.withColumn("high", down(last, g))
        df = df.where("low <= high").withColumn("k", F.explode(F.sequence("low", "high")))
        return df.select((F.lit(g.start) + F.col("k") * g.step).alias("step_ts"), read_key(F.col("lkey")).alias("labels"), "lkey", "value")

    def _histograms(self, s: Selector, g: Grid) -> DataFrame:
        """(step_ts, labels, lkey, h): the last histogram of each series at each step."""
        own = Engine(self.histograms, self.lookback)
        h = F.struct(*[F.col(c) for c in ("count", "sum", "bounds", "counts")])
        df = between(own.samples, g.start - s.offset - self.lookback, g.end - 1 - s.offset)
        own.samples = df.select("metric_name", "labels", "ts_ns", h.alias("value"))
        return own._instant(s, g).withColumnRenamed("value", "h")

    def _windowed(self, r: Range, g: Grid, changes: bool) -> DataFrame:
        """(lkey, ts_ns, value, low, high): samples with the first and last step whose closed window holds them; with
        changes also d (growth, a reset starts anew), chg, rst and dt against the sample before."""
        inner = r.inner
        if isinstance(inner, Selector) and r.step is None:
            off = r.offset + inner.offset
            df = self._series(inner, g.start - off - r.range, g.end - 1 - off, 0 if changes else max(r.range, g.step))
            steps_exclusive = 0
        else:
            step = r.step or SUB_STEP
            off = r.offset
            # inner steps begin one step after each window's start; one grid serves all windows, as the outer step is a
            # multiple of the inner one (see _range_call)
            first = g.start - off - r.range + step
            sub = Grid(first, g.start + (g.n - 1) * g.step - off + 1, step)
            df = self._vector(inner, sub).select("lkey", F.col("step_ts").alias("ts_ns"), "value")
            steps_exclusive = 1
        if changes:
            df = with_changes(df)
        t = F.col("ts_ns") + off
        return df.withColumn("low", up(t, g)).withColumn("high", down(t + r.range - steps_exclusive, g)).where("low <= high")

    def _range_call(self, c: Call, g: Grid) -> DataFrame:
        r = next(a for a in c.args if isinstance(a, Range))
        nums = [a.value for a in c.args if isinstance(a, Number)]
        name = c.name
        inner_step = 0 if isinstance(r.inner, Selector) and r.step is None else r.step or SUB_STEP
        apart = inner_step // gcd(inner_step, g.step) if inner_step and g.n > 1 else 1
        if apart > 1:
            # windows that begin at different places of the inner step have inner grids of their own
            if apart > MOST_GRIDS:
                raise ParseError(f"the steps of a range query and a sub-query need {apart} inner grids, more than {MOST_GRIDS}")
            parts = [self._range_call(c, Grid(g.start + i * g.step, g.end, g.step * apart)) for i in range(min(apart, g.n))]
            return reduce(DataFrame.union, parts)
        changes = name in ("rate", "increase", "irate", "idelta", "changes", "resets")
        df = self._windowed(r, g, changes)
        if name == "absent_over_time":
            return self._absent(spread(df.select("low", "high").distinct(), g), r.inner, g)
        v, t, n = F.col("value"), F.col("ts_ns"), F.count(F.lit(1))
        key = ["step_ts", "lkey"]
        col, span = F.col, (F.col("t1") - F.col("t0")) / 1e9
        two = lambda x: F.when(F.col("n") >= 2, x)
        grown, ends = col("sum_d") - col("first_d"), col("last_value") - col("first_value")
        folds = {
            "rate": (["n", "t0", "t1", "sum_d", "first_d"], two(F.try_divide(grown, span))), "increase": (["n", "t0", "sum_d", "first_d"], two(grown)),
            "delta": (["n", "t0", "t1", "first_value", "last_value"], two(ends)), "deriv": (["n", "t0", "t1", "first_value", "last_value"], two(F.try_divide(ends, span))),
            "irate": (["n", "t1", "last_d", "last_dt"], two(F.try_divide(col("last_d"), col("last_dt") / 1e9))), "idelta": (["n", "t1", "last_d"], two(col("last_d"))),
            "avg_over_time": (["n", "sum_value"], col("sum_value") / col("n")), "min_over_time": (["least"], col("least")), "max_over_time": (["most"], col("most")), "sum_over_time": (["sum_value"], col("sum_value")),
            "count_over_time": (["n"], col("n").cast("double")), "present_over_time": (["n"], F.lit(1.0)), "last_over_time": (["t1", "last_value"], col("last_value")),
            "changes": (["t0", "sum_chg", "first_chg"], col("sum_chg") - col("first_chg")), "resets": (["t0", "sum_rst", "first_rst"], col("sum_rst") - col("first_rst")),
        }
        if name in folds:
            used, value = folds[name]
            return self._finished(folded(df, g, used).withColumn("value", value))
        df = spread(df, g)
        x = (t - F.col("step_ts")) / 1e9
        if name == "mad_over_time":
            med = df.groupBy(*key).agg(F.percentile("value", 0.5).alias("m"))
            out = df.join(med, key).groupBy(*key).agg(F.percentile(F.abs(v - F.col("m")), 0.5).alias("value"))
        elif name in ("double_exponential_smoothing", "holt_winters"):
            sf, tf = [min(1.0, max(0.0, a)) for a in (nums + [0.1, 0.3][len(nums) :])[:2]]
            state = lambda s, b: F.struct(s.cast("double").alias("s"), b.cast("double").alias("b"))
            rows = F.array_sort(F.collect_list(F.struct("ts_ns", "value")))  # the samples of one window
            out = df.groupBy(*key).agg(rows.alias("a")).where(F.size("a") >= 2)

            def fold(acc, p):
                s = sf * p["value"] + (1 - sf) * (acc["s"] + acc["b"])
                return state(s, tf * (s - acc["s"]) + (1 - tf) * acc["b"])

            one, second = (F.get("a", F.lit(i))["value"] for i in (0, 1))
            out = out.withColumn("value", F.aggregate(F.slice("a", F.lit(2), F.size("a")), state(one, second - one), fold, lambda s: s["s"]))
        else:
            # exact quantiles hold the samples of a window in one buffer
            loose = {
                "quantile_over_time": lambda: F.percentile(v, nums[0]) if 0 <= nums[0] <= 1 else F.lit(None).cast("double"), "stddev_over_time": lambda: F.stddev_pop(v), "stdvar_over_time": lambda: F.var_pop(v),
                "predict_linear": lambda: F.when(n >= 2, F.regr_intercept(v, x) + F.regr_slope(v, x) * (nums[0] if nums else 0.0)),
            }
            out = df.groupBy(*key).agg(loose[name]().alias("value"))
        return self._finished(out)

    @staticmethod
    def _finished(out: DataFrame) -> DataFrame:
        """A vector of rows (step_ts, lkey, value) without metric names, nulls and NaN."""
        out = out.where(F.col("value").isNotNull() & ~F.isnan("value"))
        return out.select("step_ts", drop(read_key(F.col("lkey")), []).alias("labels"), "lkey", "value")

    def _absent(self, df: DataFrame, inner, g: Grid) -> DataFrame:
        have = df.select("step_ts").distinct()
        eq = {n: v for n, op, v in inner.matchers if op == "="} if isinstance(inner, Selector) else {}
        labels = F.create_map(*[F.lit(x) for kv in sorted(eq.items()) for x in kv]) if eq else empty_labels()
        out = self._steps(g).join(have, "step_ts", "left_anti").withColumn("labels", labels).withColumn("value", F.lit(1.0))
        return out.withColumn("lkey", label_key(F.col("labels")))

    def _call(self, c: Call, g: Grid):
        name, args = c.name, c.args
        step_s = F.col("step_ts") / 1e9
        if name in RANGE_FUNCTIONS and any(isinstance(a, Range) for a in args):
            return self._range_call(c, g)
        if name == "time":
            return Scalar(step_s)
        if name == "pi":
            return Scalar(F.pi())
        if name == "vector":
            return self._vector(args[0], g)
        if name == "scalar":
            v = self._vector(args[0], g).groupBy("step_ts").agg(F.when(F.count(F.lit(1)) == 1, F.max("value")).alias("v"))
            df = self._steps(g).join(v, "step_ts", "left").select("step_ts", F.coalesce("v", F.lit(NAN)).alias("value"))
            return df.withColumn("labels", empty_labels()).withColumn("lkey", F.lit("{}"))
        if name in DATE:
            fn = DATE[name]
            if not args:
                return Scalar(fn(_time(step_s)).cast("double"))
            return self._map(args[0], g, lambda x: fn(_time(x)).cast("double"))
        if name == "timestamp":
            return self._map(args[0], g, lambda x: step_s)
        if name in SIMPLE:
            return self._map(args[0], g, SIMPLE[name])
        if name == "round":
            to = args[1].value if len(args) > 1 else 1.0
            return self._map(args[0], g, lambda x: F.round(x / to) * to if to else F.lit(NAN))
        if name in ("clamp", "clamp_min", "clamp_max"):
            n = [a.value for a in args[1:]]
            lo, hi = (n[0], None) if name == "clamp_min" else (None, n[0]) if name == "clamp_max" else n
            if lo is not None and hi is not None and lo > hi:
                return self._vector(args[0], g).where(F.lit(False))
            return self._map(args[0], g, lambda x: F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))
        if name == "atan2":
            return self._map(args[0], g, lambda x: F.atan2(x, F.lit(args[1].value)))
        if name == "absent":
            return self._absent(self._vector(args[0], g), args[0], g)
        if name in ("sort", "sort_desc"):
            return self._vector(args[0], g).orderBy("step_ts", F.col("value").desc() if name == "sort_desc" else F.col("value"))
        if name in ("sort_by_label", "sort_by_label_desc"):
            by = F.coalesce(F.element_at("labels", F.lit(args[1].value)), F.lit(""))
            return self._vector(args[0], g).orderBy("step_ts", by.desc() if name.endswith("desc") else by)
        if name == "label_replace":
            dst, repl, src, regex = (a.value for a in args[1:])
            return self._relabel(args[0], g, lambda m: label_replace(m, dst, repl, src, regex))
        if name == "label_join":
            dst, sep, *src = (a.value for a in args[1:])
            joined = lambda m: F.concat_ws(sep, *[F.coalesce(F.element_at(m, F.lit(s)), F.lit("")) for s in src])
            return self._relabel(args[0], g, lambda m: with_label(m, dst, joined(m)))
        if name == "label_del":
            gone = [a.value for a in args[1:] if isinstance(a, Text)]
            return self._relabel(args[0], g, lambda m: F.map_filter(m, lambda k, v: ~k.isin(gone)))
        if name.startswith("histogram_") and name != "histogram_quantile" or name == "histogram_quantile" and isinstance(args[1], Selector) and args[1].name in self.native:
            nums = [a.value for a in args if isinstance(a, Number)]
            if name not in HISTOGRAM or not isinstance(args[-1], Selector) or self.histograms is None or len(nums) != {"histogram_fraction": 2, "histogram_quantile": 1}.get(name, 0):
                raise ParseError(f"{name} takes its numbers and a selector of histograms")
            out = self._histograms(args[-1], g).withColumn("value", HISTOGRAM[name](*nums))
            out = out.where(~F.isnan("value")) if name == "histogram_quantile" else out
            return out.select("step_ts", "labels", "lkey", "value")
        if name == "histogram_quantile":
            return self._classic_quantile(args[0].value, self._vector(args[1], g))
        raise ParseError(f"unknown function {name}")

    def _map(self, arg, g: Grid, fn):
        v = self.eval(arg, g)
        if isinstance(v, Scalar):
            return Scalar(fn(v.value))
        return v.withColumn("value", fn(F.col("value"))).where(F.col("value").isNotNull() & ~F.isnan("value"))

    def _relabel(self, arg, g: Grid, fn) -> DataFrame:
        df = self._vector(arg, g).withColumn("labels", fn(F.col("labels")))
        return df.withColumn("lkey", label_key(F.col("labels")))

    def _classic_quantile(self, phi: float, v: DataFrame) -> DataFrame:
        """Quantile of cumulative buckets by le: linear within a bucket, from 0 in the first where its bound is above 0."""
        v = v.where(F.map_contains_key("labels", F.lit("le"))).withColumn("le", F.expr("try_cast(replace(labels['le'], '+Inf', 'Infinity') as double)")).where("le is not null")
        v = v.select("step_ts", label_key(drop(F.col("labels"), ["le"])).alias("lkey"), "le", "value")
        b = v.groupBy("step_ts", "lkey").agg(F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b")).withColumn("labels", read_key(F.col("lkey")))
        b = b.where((F.size("b") >= 2) & (F.element_at("b", -1)["value"] > 0)).withColumn("rank", F.element_at("b", -1)["value"] * phi)
        at = F.array_position(F.transform("b", lambda x: x["value"] >= F.col("rank")), True).cast("int")
        b = b.withColumn("i", F.when(at == 0, F.size("b")).otherwise(at))
        hi, lo = F.element_at("b", F.col("i")), F.when(F.col("i") > 1, F.element_at("b", F.greatest(F.col("i") - 1, F.lit(1))))
        low = F.coalesce(lo["le"], F.when(hi["le"] > 0, 0.0).otherwise(hi["le"]))
        below = F.coalesce(lo["value"], F.lit(0.0))
        inside = low + (hi["le"] - low) * F.try_divide(F.col("rank") - below, hi["value"] - below)
        return b.withColumn("value", F.when(hi["le"] == float("inf"), low).otherwise(F.coalesce(inside, low))).select("step_ts", "labels", "lkey", "value")

    def _aggregate(self, a: Aggregate, g: Grid) -> DataFrame:
        v = self._vector(a.inner, g)
        labels = keep(F.col("labels"), a.by) if a.by is not None else drop(F.col("labels"), a.without) if a.without is not None else empty_labels()
        v = v.withColumn("gkey", label_key(labels))
        x, n = F.col("value"), F.count(F.lit(1))
        if a.op in ("topk", "bottomk"):
            w = Window.partitionBy("step_ts", "gkey").orderBy(x.desc() if a.op == "topk" else x, "lkey")
            return v.withColumn("r", F.row_number().over(w)).where(F.col("r") <= int(a.param.value)).select("step_ts", "labels", "lkey", "value")
        if a.op == "count_values":
            text = F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))
            v = v.withColumn("t", text).groupBy("step_ts", "gkey", "t").agg(n.cast("double").alias("value"))
            v = v.withColumn("labels", with_label(read_key(F.col("gkey")), a.param.value, F.col("t")))
            return v.select("step_ts", "labels", label_key(F.col("labels")).alias("lkey"), "value")
        clean = F.nanvl(x, F.lit(None))
        fold = {"sum": F.sum(x), "avg": F.avg(x), "min": F.min(clean), "max": F.max(clean), "count": n.cast("double"), "group": F.max(F.lit(1.0)), "stddev": F.when(n >= 2, F.stddev_pop(x)), "stdvar": F.when(n >= 2, F.var_pop(x))}
        agg = F.percentile(x, float(a.param.value)) if a.op == "quantile" else fold[a.op]
        out = v.groupBy("step_ts", "gkey").agg(agg.alias("value")).where(F.col("value").isNotNull())
        if a.op == "min":
            out = out.where(F.abs("value") < float("inf"))
        return out.select("step_ts", read_key(F.col("gkey")).alias("labels"), F.col("gkey").alias("lkey"), "value")

    def _is_scalar(self, node) -> bool:
        if isinstance(node, Call):
            return node.name in ("scalar", "time", "pi")
        if isinstance(node, Binary):
            return node.op in OPS and self._is_scalar(node.left) and self._is_scalar(node.right)
        return isinstance(node, Number)

    def _binary(self, b: Binary, g: Grid):
        if b.op == "or":
            return self._either(b, g)
        left, right = self.eval(b.left, g), self.eval(b.right, g)
        if b.op in ("and", "unless"):
            if self._is_scalar(b.left) or self._is_scalar(b.right):
                raise ParseError("set operators need vectors")
            return self._set(b, left, right)
        fn, cols = OPS[b.op], ["step_ts", "labels", "lkey", "value"]

        def result(x: Column, y: Column, kept: Column) -> tuple[Column, Column | None]:
            if b.op not in COMPARE:
                return fn(x, y), None
            return (F.when(fn(x, y), 1.0).otherwise(0.0), None) if b.bool else (kept, fn(x, y))

        if isinstance(left, Scalar) and isinstance(right, Scalar):
            v = fn(left.value, right.value)
            return Scalar(F.when(v, 1.0 if b.bool else left.value).otherwise(0.0) if b.op in COMPARE else v)
        for side, other in ((left, right), (right, left)):
            if isinstance(side, Scalar):
                x, y = (side.value, F.col("value")) if side is left else (F.col("value"), side.value)
                value, cond = result(x, y, F.col("value"))
                df = other.where(cond) if cond is not None else other
                return df.withColumn("value", value).select(*cols)
        scalar_side = [self._is_scalar(b.left), self._is_scalar(b.right)]
        if any(scalar_side):  # scalar(v) has a value per step, joined by step
            vec, sc = (right, left) if scalar_side[0] else (left, right)
            df = vec.join(sc.select("step_ts", F.col("value").alias("s")), "step_ts")
            x, y = (F.col("s"), F.col("value")) if scalar_side[0] else (F.col("value"), F.col("s"))
            value, cond = result(x, y, F.col("value"))
            df = df.where(cond) if cond is not None else df
            return df.withColumn("value", value).select(*cols)
        pick = (lambda m: keep(m, b.on)) if b.on is not None else (lambda m: drop(m, b.ignoring or []))
        key = lambda df: df.withColumn("mk", label_key(pick(F.col("labels"))))
        lv = key(left).select("step_ts", "mk", F.col("labels").alias("ll"), F.col("value").alias("lv"))
        rv = key(right).select("step_ts", "mk", F.col("labels").alias("rl"), F.col("value").alias("rv"))
        if b.side is None:
            # one side of a match must be single; a combinable count says which, so no window gathers a key's rows
            single = rv.groupBy("step_ts", "mk").agg(F.count(F.lit(1)).alias("c"), F.any_value("rl").alias("rl"), F.any_value("rv").alias("rv")).where("c = 1").drop("c")
            j = lv.join(single, ["step_ts", "mk"]).withColumn("labels", pick(F.col("ll")))
        else:
            j = lv.join(rv, ["step_ts", "mk"])
            own, other = ("ll", "rl") if b.side == "left" else ("rl", "ll")
            labels = drop(F.col(own), [])
            for n in b.extra if b.side == "left" else []:
                labels = with_label(labels, n, F.coalesce(F.element_at(other, F.lit(n)), F.lit("")))
            j = j.withColumn("labels", labels)
        value, cond = result(F.col("lv"), F.col("rv"), F.col("lv"))
        j = j.where(cond) if cond is not None else j
        return j.withColumn("value", value).withColumn("lkey", label_key(F.col("labels"))).select(*cols)

    def _either(self, b: Binary, g: Grid) -> DataFrame:
        """a or b or ...: at each step and label set the rows of the first vector that has it; each vector is evaluated once."""
        of = lambda x: [*of(x.left), *of(x.right)] if isinstance(x, Binary) and x.op == "or" else [x]
        if any(self._is_scalar(x) for x in of(b)):
            raise ParseError("set operators need vectors")
        cols = ["step_ts", "labels", "lkey", "value"]
        parts = [self.eval(x, g).select(*cols, F.lit(i).alias("_nth")) for i, x in enumerate(of(b))]
        first = F.min("_nth").over(Window.partitionBy("step_ts", "lkey"))
        return reduce(DataFrame.union, parts).withColumn("_first", first).where("_nth = _first").select(*cols)

    def _set(self, b: Binary, left: DataFrame, right: DataFrame) -> DataFrame:
        cols, key = ["step_ts", "labels", "lkey", "value"], ["step_ts", "lkey"]
        return left.join(right.select(*key), key, "left_semi" if b.op == "and" else "left_anti").select(*cols)


def _floor_div(a: Column, b: int) -> Column:
    """Whole-number floor division by a positive constant, exact for nanoseconds (doubles are not)."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def label_replace(labels: Column, dst: str, repl: str, src: str, regex: str) -> Column:
    """Sets dst to repl, with $n for groups, where regex is found in src; else leaves the labels alone."""
    import re

    got = F.coalesce(F.element_at(labels, F.lit(src)), F.lit(""))
    groups = re.compile(regex).groups
    parts = []
    for piece in re.split(r"(\$\d+)", repl):
        if re.fullmatch(r"\$\d+", piece) and int(piece[1:]) <= groups:
            parts.append(F.regexp_extract(got, regex, int(piece[1:])))
        elif piece:
            parts.append(F.lit(piece))
    value = F.concat(*parts) if parts else F.lit("")
    return F.when(got.rlike(regex), with_label(labels, dst, value)).otherwise(labels)
