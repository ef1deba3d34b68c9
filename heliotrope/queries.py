"""The registered queries of the core engine and their SQL.

Metrics are the gauge event_value{event_type, shard} of `events`, logs one record an event, spans one an order; all over
whole tables. Sums are rounded to 6 places on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import live, rules, signals
from .plans import windows
from .plans.pipeline import Pipelines
from .plans.promql import Engine
from .sources.tables import event_histograms, event_logs, event_samples, order_spans

DAY, HOUR = 86400 * 10**9, 3600 * 10**9
#: 2024-01-01 to 2024-01-31, in steps of six hours.
START, END, STEP = 19723 * DAY, 19753 * DAY, 6 * HOUR
STEPS = (END - START) // STEP

QUERIES: dict = {}
ORACLE: dict = {}


def _flat(df: DataFrame, *labels: str, digits: int = 6) -> DataFrame:
    cols = [F.element_at("labels", F.lit(x)).alias(x) for x in labels]
    return df.select("step_ts", *cols, F.round("value", digits).alias("value"))


#: Samples (one per series and time), steps, and the samples in each step's window of {range} ns.
_SAMPLES = "s AS (SELECT event_type, 's' || (user_id % 4) AS shard, epoch_us(ts) * 1000 AS ts, max(value) AS v FROM events GROUP BY ALL)"
_STEPS = f"st AS (SELECT {START} + i * {STEP} AS t FROM range({STEPS}) r(i))"


def _window(rng: int, offset: int = 0) -> str:
    return f"""WITH {_SAMPLES}, {_STEPS},
w AS (SELECT t, event_type, shard, ts, v, lag(v) OVER p AS pv, lag(ts) OVER p AS pts FROM st JOIN s ON ts BETWEEN t - {offset + rng} AND t - {offset}
      WINDOW p AS (PARTITION BY t, event_type, shard ORDER BY ts)),
d AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN v < pv THEN v ELSE v - pv END AS d FROM w)"""


def _last(lookback: int) -> str:
    """Instant values i (t, event_type, shard, v): the last sample of each series within the lookback."""
    return f"""WITH {_SAMPLES}, {_STEPS},
i AS (SELECT t, event_type, shard, max_by(v, ts) AS v FROM st JOIN s ON ts BETWEEN t - {lookback} AND t GROUP BY ALL)"""


_RATE = "r AS (SELECT t, event_type, shard, sum(d) / ((max(ts) - min(ts)) / 1e9) AS v FROM d GROUP BY ALL HAVING count(*) > 1 AND max(ts) > min(ts))"
_BOTH = ("event_type", "shard")


def _promql(name: str, query: str, sql: str, labels: tuple = _BOTH, lookback: int = 6 * HOUR) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return _flat(Engine(event_samples(spark, sf_dir), lookback).query_range(query, START, END, STEP), *labels)

    QUERIES[f"promql_{name}"], ORACLE[f"promql_{name}"] = run, sql


def _over_time(name: str, call: str, agg: str, having: str = "") -> None:
    _promql(name, call, f"{_window(24 * HOUR)} SELECT t AS step_ts, event_type, shard, round(({agg})::DOUBLE, 6) AS value FROM d GROUP BY ALL {having}")


_promql("instant_selector", 'event_value{event_type=~"err|sign"}', f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(v, 6) AS value FROM i WHERE event_type IN ('error', 'signup')")
_promql("not_equal", 'event_value{event_type!="error",shard=~"s[01]"}', f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(v, 6) AS value FROM i WHERE event_type <> 'error' AND shard IN ('s0', 's1')")
_promql("sum_rate_by_type", "sum by (event_type) (rate(event_value[24h]))", f"{_window(24 * HOUR)}, {_RATE} SELECT t AS step_ts, event_type, round(sum(v), 6) AS value FROM r GROUP BY ALL", ("event_type",))
_promql("offset_increase", "increase(event_value[24h] offset 1d)", f"{_window(24 * HOUR, DAY)} SELECT t AS step_ts, event_type, shard, round(sum(d), 6) AS value FROM d GROUP BY ALL HAVING count(*) > 1")
for _n, _a in (("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("sum", "sum(v)"), ("count", "count(*)"), ("last", "max_by(v, ts)"), ("stddev", "stddev_pop(v)"), ("stdvar", "var_pop(v)"), ("present", "1")):
    _over_time(f"{_n}_over_time", f"{_n}_over_time(event_value[24h])", _a)
_over_time("quantile_over_time", "quantile_over_time(0.9, event_value[24h])", "quantile_cont(v, 0.9)")
_over_time("mad_over_time", "mad_over_time(event_value[24h])", "mad(v)")
_over_time("delta", "delta(event_value[24h])", "max_by(v, ts) - min_by(v, ts)", "HAVING count(*) > 1")
_over_time("deriv", "deriv(event_value[24h])", "(max_by(v, ts) - min_by(v, ts)) / ((max(ts) - min(ts)) / 1e9)", "HAVING count(*) > 1")
_over_time("idelta", "idelta(event_value[24h])", "max_by(d, ts)", "HAVING count(*) > 1")
_over_time("irate", "irate(event_value[24h])", "max_by(d, ts) / (max_by(ts - pts, ts) / 1e9)", "HAVING count(*) > 1")
_over_time("changes", "changes(event_value[24h])", "count(*) FILTER (pv <> v)")
_over_time("resets", "resets(event_value[24h])", "count(*) FILTER (v < pv)")
_over_time("predict_linear", "predict_linear(event_value[24h], 3600)", "regr_intercept(v, (ts - t) / 1e9) + 3600 * regr_slope(v, (ts - t) / 1e9)", "HAVING count(*) > 1")
for _n, _a in (("sum", "sum(v)"), ("avg", "avg(v)"), ("min", "min(v)"), ("max", "max(v)"), ("count", "count(*)"), ("group", "1"), ("stddev", "stddev_pop(v)"), ("stdvar", "var_pop(v)")):
    _promql(f"agg_{_n}", f"{_n} without (shard) (event_value)", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, round(({_a})::DOUBLE, 6) AS value FROM i GROUP BY ALL {'HAVING count(*) > 1' if _n[:3] == 'std' else ''}", ("event_type",))
_promql("agg_quantile", "quantile(0.25, event_value)", f"{_last(6 * HOUR)} SELECT t AS step_ts, round(quantile_cont(v, 0.25), 6) AS value FROM i GROUP BY ALL", ())
for _n, _o in (("topk", "DESC"), ("bottomk", "ASC")):
    _promql(_n, f"{_n}(3, event_value)", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(v, 6) AS value FROM i QUALIFY row_number() OVER (PARTITION BY t ORDER BY v {_o}, event_type, shard) <= 3")
_promql("count_values", 'count_values("v", floor(event_value / 100))', f"{_last(6 * HOUR)} SELECT t AS step_ts, floor(v / 100)::BIGINT::VARCHAR AS v, count(*)::DOUBLE AS value FROM i GROUP BY ALL", ("v",))
_promql("filter_scalar", "event_value > 250", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(v, 6) AS value FROM i WHERE v > 250")
_promql("compare_bool", "event_value >= bool 250", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, (v >= 250)::INT::DOUBLE AS value FROM i")
_promql("arithmetic", "(event_value * 2 - 7) % 5 ^ 2", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round((v * 2 - 7) - 25 * trunc((v * 2 - 7) / 25), 6) AS value FROM i")
_promql("ratio_on", 'event_value{event_type="error"} / on (shard) event_value{event_type="view"}', f"{_last(6 * HOUR)} SELECT t AS step_ts, shard, round(a.v / b.v, 6) AS value FROM i a JOIN i b USING (t, shard) WHERE a.event_type = 'error' AND b.event_type = 'view'", ("shard",))
_promql("group_left", "event_value / ignoring (event_type) group_left sum by (shard) (event_value)", f"{_last(6 * HOUR)}, g AS (SELECT t, shard, sum(v) AS g FROM i GROUP BY ALL) SELECT t AS step_ts, event_type, shard, round(v / g, 6) AS value FROM i JOIN g USING (t, shard)")
_promql("set_and", "event_value and event_value > 300", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(v, 6) AS value FROM i WHERE v > 300")
_promql("set_unless", "event_value unless event_value > 300", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(v, 6) AS value FROM i WHERE NOT v > 300")
_promql("set_or", 'event_value{event_type="error"} or event_value', f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(v, 6) AS value FROM i")
_promql("functions", "round(sqrt(abs(event_value - 100)), 0.5) + clamp(ln(event_value + 1), 1, 5)", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(round(sqrt(abs(v - 100)) / 0.5) * 0.5 + least(greatest(ln(v + 1), 1), 5), 6) AS value FROM i")
_promql("trigonometry", "sin(event_value) * cos(event_value) + deg(atan(event_value)) - tanh(event_value / 500)", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, round(sin(v) * cos(v) + degrees(atan(v)) - tanh(v / 500), 6) AS value FROM i")
_promql("label_replace", 'label_replace(event_value, "part", "p$1", "shard", "s(.)")', f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, 'p' || substr(shard, 2) AS part, round(v, 6) AS value FROM i", ("event_type", "shard", "part"))
_promql("label_join", 'label_join(event_value, "both", "-", "event_type", "shard")', f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type || '-' || shard AS \"both\", round(v, 6) AS value FROM i", ("both",))
_promql("absent_over_time", 'absent_over_time(event_value{event_type="error",shard="s3"}[1h])', f"WITH {_SAMPLES}, {_STEPS} SELECT t AS step_ts, 'error' AS event_type, 's3' AS shard, 1.0::DOUBLE AS value FROM st WHERE NOT EXISTS (SELECT 1 FROM s WHERE event_type = 'error' AND shard = 's3' AND ts BETWEEN t - {HOUR} AND t)")
_promql("subquery", "max_over_time(sum by (event_type) (event_value)[12h:6h])", f"{_last(6 * HOUR)}, g AS (SELECT t, event_type, sum(v) AS v FROM i GROUP BY ALL) SELECT st.t AS step_ts, event_type, round(max(v), 6) AS value FROM st JOIN g ON g.t > st.t - {12 * HOUR} AND g.t <= st.t GROUP BY ALL", ("event_type",))
_promql("subquery_apart", "max_over_time(sum by (event_type) (event_value)[13h:4h])", f"""WITH {_SAMPLES}, {_STEPS}, x AS (SELECT t, t - {13 * HOUR} + k * {4 * HOUR} AS u FROM st, range(1, 4) r(k)),
i AS (SELECT t, u, event_type, shard, max_by(v, ts) AS v FROM x JOIN s ON ts BETWEEN u - {6 * HOUR} AND u GROUP BY ALL), g AS (SELECT t, u, event_type, sum(v) AS v FROM i GROUP BY ALL)
SELECT t AS step_ts, event_type, round(max(v), 6) AS value FROM g GROUP BY ALL""", ("event_type",))
_promql("scalar_share", "event_value / scalar(sum(event_value))", f"{_last(6 * HOUR)}, g AS (SELECT t, sum(v) AS g FROM i GROUP BY ALL) SELECT t AS step_ts, event_type, shard, round(v / g, 6) AS value FROM i JOIN g USING (t)")
_promql("date_functions", "hour() + day_of_week() * 100 + days_in_month() * 10000 + event_value * 0", f"{_last(6 * HOUR)} SELECT t AS step_ts, event_type, shard, (hour(make_timestamp(t // 1000)) + dayofweek(make_timestamp(t // 1000)) * 100 + 310000)::DOUBLE AS value FROM i")
#: Four cumulative buckets of each shard's values: those up to 20, 60 and 150, and all.
_LE = {"20": 20, "60": 60, "150": 150, "+Inf": None}
_BUCKETS = " or ".join(f'label_replace(count by (shard) (event_value{"" if b is None else f" <= {b}"}), "le", "{le}", "shard", ".*")' for le, b in _LE.items())
for _q in (0.05, 0.5, 0.9):
    _promql(f"histogram_quantile_{round(100 * _q)}", f"histogram_quantile({_q}, {_BUCKETS})", f"""{_last(6 * HOUR)},
c AS (SELECT t, shard, nullif(count(*) FILTER (v <= 20), 0) AS a, nullif(count(*) FILTER (v <= 60), 0) AS b, nullif(count(*) FILTER (v <= 150), 0) AS c, count(*) AS n FROM i GROUP BY ALL),
l AS (SELECT t, shard, n, {_q} * n AS r, list_filter([{{'le': 20.0::DOUBLE, 'v': a}}, {{'le': 60.0::DOUBLE, 'v': b}}, {{'le': 150.0::DOUBLE, 'v': c}}, {{'le': 'inf'::DOUBLE, 'v': n}}], lambda x: x.v IS NOT NULL) AS x FROM c),
p AS (SELECT *, list_position(list_transform(x, lambda y: y.v >= r), true) AS i FROM l WHERE len(x) >= 2),
q AS (SELECT t, shard, r, x[i].le AS hi, x[i].v AS hv, CASE WHEN i > 1 THEN x[i - 1].le ELSE 0 END AS lo, CASE WHEN i > 1 THEN x[i - 1].v ELSE 0 END AS lv FROM p)
SELECT t AS step_ts, shard, round(CASE WHEN isinf(hi) THEN lo ELSE lo + (hi - lo) * (r - lv) / (hv - lv) END, 6) AS value FROM q""", ("shard",))


def holt_winters(spark, sf_dir: str) -> DataFrame:
    return _flat(Engine(event_samples(spark, sf_dir), 6 * HOUR).query_range("holt_winters(event_value[24h], 0.5, 0.1)", START, END, STEP), *_BOTH)


QUERIES["promql_holt_winters"] = holt_winters
#: The fold over the values of a window in order of time, as a recursion over their places.
ORACLE["promql_holt_winters"] = f"""WITH RECURSIVE {_SAMPLES}, {_STEPS},
w AS (SELECT t, event_type, shard, list(v ORDER BY ts) AS a FROM st JOIN s ON ts BETWEEN t - {24 * HOUR} AND t GROUP BY ALL HAVING count(*) >= 2),
f AS (SELECT t, event_type, shard, a, 1 AS i, a[1] AS s, a[2] - a[1] AS b FROM w
  UNION ALL SELECT t, event_type, shard, a, i + 1, 0.5 * a[i + 1] + 0.5 * (s + b), 0.1 * ((0.5 * a[i + 1] + 0.5 * (s + b)) - s) + 0.9 * b FROM f WHERE i < len(a))
SELECT t AS step_ts, event_type, shard, round(s, 6) AS value FROM f WHERE i = len(a)"""


# -- samples ------------------------------------------------------------------------------------------------------
def _downsample(op: str, agg: str, having: str = "") -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        df = signals.downsample(event_samples(spark, sf_dir), "event_value", op, START, END, DAY)
        return df.select("bucket_ns", *[F.element_at("labels", F.lit(x)).alias(x) for x in _BOTH], F.round("value", 6).alias("value"))

    QUERIES[f"downsample_{op}"] = run
    ORACLE[f"downsample_{op}"] = f"WITH s AS (SELECT event_type, 's' || (user_id % 4) AS shard, epoch_us(ts) * 1000 AS ts, value AS v FROM events) SELECT ts - (ts - {START}) % {DAY} AS bucket_ns, event_type, shard, round(({agg})::DOUBLE, 6) AS value FROM s WHERE ts >= {START} AND ts < {END} GROUP BY ALL {having}"


for _n, _a, _h in (("avg", "avg(v)", ""), ("max", "max(v)", ""), ("count", "count(*)", ""), ("stddev", "stddev_pop(v)", "HAVING count(*) > 1"), ("quantile", "quantile_cont(v, 0.5)", "")):
    _downsample(_n, _a, _h)


def label_values(spark, sf_dir: str) -> DataFrame:
    return signals.label_values(event_samples(spark, sf_dir), "event_type")


def label_names(spark, sf_dir: str) -> DataFrame:
    return signals.label_names(event_samples(spark, sf_dir))


def series_limit(spark, sf_dir: str) -> DataFrame:
    df = signals.limit_series(event_samples(spark, sf_dir), 7)
    return df.groupBy(*[F.element_at("labels", F.lit(x)).alias(x) for x in _BOTH]).agg(F.count(F.lit(1)).alias("n"))


def recording_rule(spark, sf_dir: str) -> DataFrame:
    df = rules.record(Engine(event_samples(spark, sf_dir), 6 * HOUR), "event:mean", "avg by (event_type) (event_value)", START + 17, END, STEP, {"rule": "r1"})
    return df.select("metric_name", "ts_ns", F.element_at("labels", F.lit("event_type")).alias("event_type"), F.element_at("labels", F.lit("rule")).alias("rule"), F.round("value", 6).alias("value"))


def alert_states(spark, sf_dir: str) -> DataFrame:
    v = Engine(event_samples(spark, sf_dir), 6 * HOUR).query_range("avg by (event_type) (event_value)", START, END, STEP)
    df = rules.alert_states(v, ">", 60.0, 2 * STEP)
    return df.select("step_ts", F.element_at("labels", F.lit("event_type")).alias("event_type"), "state")


def mad_anomalies(spark, sf_dir: str) -> DataFrame:
    v = Engine(event_samples(spark, sf_dir), 6 * HOUR).query_range("avg by (event_type) (event_value)", START, END, STEP)
    v = v.withColumn("event_type", F.element_at("labels", F.lit("event_type")))
    return signals.mad_anomalies(v, ["event_type"], 1.0).select("event_type", F.round("last", 6).alias("last"), F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"), "fires")


_MEANS = f"{_last(6 * HOUR)}, a AS (SELECT t, event_type, avg(v) AS v FROM i GROUP BY ALL)"
QUERIES |= {"discovery_label_values": label_values, "discovery_label_names": label_names, "series_limit": series_limit, "recording_rule": recording_rule, "alert_states": alert_states, "mad_anomalies": mad_anomalies}
ORACLE |= {
    "discovery_label_values": "SELECT event_type AS value, max(epoch_us(ts) * 1000) AS last_ns FROM events GROUP BY ALL",
    "discovery_label_names": "SELECT unnest(['event_type', 'shard']) AS name",
    "series_limit": "WITH s AS (SELECT event_type, 's' || (user_id % 4) AS shard, min(ts) AS f, count(*) AS n FROM events GROUP BY ALL) SELECT event_type, shard, n FROM s QUALIFY row_number() OVER (ORDER BY f, event_type, shard) <= 7",
    "recording_rule": f"{_MEANS} SELECT 'event:mean' AS metric_name, t AS ts_ns, event_type, 'r1' AS rule, round(v, 6) AS value FROM a",
    "alert_states": f"""{_MEANS}, o AS (SELECT *, v > 60 AS o FROM a), l AS (SELECT *, coalesce(lag(o) OVER (PARTITION BY event_type ORDER BY t), false) AS was, lag(t) OVER (PARTITION BY event_type ORDER BY t) AS prior FROM o),
r AS (SELECT *, sum((o <> was)::INT) OVER (PARTITION BY event_type ORDER BY t) AS run FROM l), f AS (SELECT *, min(t) OVER (PARTITION BY event_type, run) AS since FROM r),
p AS (SELECT *, lag(since) OVER (PARTITION BY event_type ORDER BY t) AS ws FROM f)
SELECT t AS step_ts, event_type, CASE WHEN o AND t - since >= {2 * STEP} THEN 'firing' WHEN o THEN 'pending' ELSE 'resolved' END AS state FROM p WHERE o OR (was AND prior - ws >= {2 * STEP})""",
    "mad_anomalies": f"""{_MEANS}, l AS (SELECT event_type, list_sort(list(v)) AS a, max_by(v, t) AS last FROM a GROUP BY ALL HAVING count(*) >= 5), m AS (SELECT event_type, a, last, a[len(a) // 2 + 1] AS median FROM l),
d AS (SELECT event_type, last, median, list_sort(list_transform(a, lambda x: abs(x - median)))[len(a) // 2 + 1] AS mad FROM m)
SELECT event_type, round(last, 6) AS last, round(median, 6) AS median, round(mad, 6) AS mad, abs(last - median) > greatest(mad, 1e-9, abs(median) * 0.001) AS fires FROM d""",
}

# -- range plans and native histograms -------------------------------------------------------------------------------
def _plan(name: str, sql: str, labels: tuple = _BOTH, **how) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        return _flat(windows.run(event_samples(spark, sf_dir), windows.Plan("event_value", start=START, end=END, step=STEP, **how)), *labels)

    QUERIES[f"plan_{name}"], ORACLE[f"plan_{name}"] = run, sql


#: Samples as they are, and the windows [t - range, t + step) of a plan with the growth in each.
_RAW = "s AS (SELECT event_type, 's' || (user_id % 4) AS shard, epoch_us(ts) * 1000 AS ts, value AS v FROM events)"
_PLAN = f"""WITH {_RAW}, {_STEPS},
w AS (SELECT t, event_type, shard, ts, v, lag(v) OVER p AS pv, lag(ts) OVER p AS pts FROM st JOIN s ON ts >= t - {24 * HOUR} AND ts < t + {STEP}
      WINDOW p AS (PARTITION BY t, event_type, shard ORDER BY ts)),
a AS (SELECT t, event_type, shard, count(*) AS n, (max(ts) - min(ts)) / 1e9 AS span, sum(CASE WHEN pv IS NULL THEN 0 WHEN v < pv THEN v ELSE v - pv END) AS g,
  max_by(v, ts) - min_by(v, ts) AS ends, max_by(CASE WHEN v < pv THEN v ELSE v - pv END, ts) AS d, max_by(ts - pts, ts) / 1e9 AS dt FROM w GROUP BY ALL),
r AS (SELECT *, g / span * (span + 2 * greatest(least(({24 * 3600} - span) / 2, span * 0.1), 0)) / span AS rate FROM a WHERE n > 1 AND span > 0)"""
_plan("rate", f"{_PLAN} SELECT t AS step_ts, event_type, shard, round(rate, 6) AS value FROM r", op="rate", range=24 * HOUR)
_plan("increase", f"{_PLAN} SELECT t AS step_ts, event_type, shard, round(rate * {24 * 3600}, 6) AS value FROM r", op="increase", range=24 * HOUR)
_plan("delta", f"{_PLAN} SELECT t AS step_ts, event_type, shard, round(ends, 6) AS value FROM a", op="delta", range=24 * HOUR)
_plan("irate", f"{_PLAN} SELECT t AS step_ts, event_type, shard, round(d / dt, 6) AS value FROM a WHERE n > 1 AND dt > 0", op="irate", range=24 * HOUR)
_plan("group_by", f"{_PLAN} SELECT t AS step_ts, event_type, round(sum(rate), 6) AS value FROM r GROUP BY ALL", ("event_type",), op="rate", range=24 * HOUR, by=["event_type"])
_plan("group_without", f"{_PLAN} SELECT t AS step_ts, shard, 'event_value' AS __name__, round(sum(ends), 6) AS value FROM a GROUP BY ALL", ("shard", "__name__"), op="delta", range=24 * HOUR, without=["event_type"])
_plan("topk", f"{_PLAN}, k AS (SELECT event_type, shard FROM (SELECT event_type, shard, max_by(rate, t) AS last FROM r GROUP BY ALL) ORDER BY last DESC, event_type, shard LIMIT 3) SELECT t AS step_ts, event_type, shard, round(rate, 6) AS value FROM r SEMI JOIN k USING (event_type, shard)", op="rate", range=24 * HOUR, k=3)
_plan("relabel", f"{_PLAN} SELECT t AS step_ts, event_type, shard, replace(event_type, 'r', 'R') AS x, round(ends, 6) AS value FROM a WHERE event_type IN ('purchase', 'view', 'signup')", (*_BOTH, "x"), op="delta", range=24 * HOUR, relabel=("x", "R", "event_type", "r"), matchers=[("event_type", "=~", "^(purchase|view|signup)$")])
_CELLS = f"WITH {_RAW}, c AS (SELECT *, ts - (ts - {START}) % {STEP} AS t FROM s WHERE ts >= {START} AND ts < {END}), d AS (SELECT *, lag(v) OVER p AS pv, lag(ts) OVER p AS pts FROM c WINDOW p AS (PARTITION BY t, event_type, shard ORDER BY ts))"
for _n, _o, _x, _q in (
    ("bucket_irate", "irate", "CASE WHEN count(*) > 1 THEN max_by(CASE WHEN v < pv THEN v ELSE v - pv END, ts) / (max_by(ts - pts, ts) / 1e9) END", None), ("bucket_rate", "rate", "CASE WHEN count(*) > 1 THEN (max_by(v, ts) - min_by(v, ts)) / ((max(ts) - min(ts)) / 1e9) END", None),
    ("bucket_increase", "increase", "CASE WHEN count(*) > 1 THEN CASE WHEN max_by(v, ts) < min_by(v, ts) THEN max_by(v, ts) ELSE max_by(v, ts) - min_by(v, ts) END END", None), ("bucket_delta", "delta", "CASE WHEN count(*) > 1 THEN max_by(v, ts) - min_by(v, ts) END", None),
    ("bucket_sum", "sum", "sum(v)", None), ("bucket_min", "min", "min(v)", None), ("bucket_floor", "floor", "floor(max_by(v, ts))", None), ("bucket_ceil", "ceil", "ceil(max_by(v, ts))", None), ("bucket_round", "round", "round(max_by(v, ts) / 5) * 5", 5.0),
    ("bucket_clamp_min", "clamp_min", "greatest(max_by(v, ts), 50)", 50.0), ("bucket_clamp_max", "clamp_max", "least(max_by(v, ts), 50)", 50.0),
):
    _plan(_n, f"{_CELLS} SELECT t AS step_ts, event_type, shard, round(({_x})::DOUBLE, 6) AS value FROM d GROUP BY ALL HAVING value IS NOT NULL", op=_o, param=_q)


def plan_histogram_quantile(spark, sf_dir: str) -> DataFrame:
    plan = windows.Plan("event_hist", "histogram_quantile", START, END, DAY, param=0.9)
    return _flat(windows.run(event_histograms(spark, sf_dir), plan), "event_type")


QUERIES["plan_histogram_quantile"] = plan_histogram_quantile
ORACLE["plan_histogram_quantile"] = f"""WITH e AS (SELECT event_type, epoch_us(ts) * 1000 - epoch_us(ts) * 1000 % {DAY} AS t, value AS v FROM events),
h AS (SELECT t, event_type, count(*) FILTER (v <= 20) AS a, count(*) FILTER (v > 20 AND v <= 60) AS b, count(*) FILTER (v > 60 AND v <= 150) AS c, count(*) FILTER (v > 150) AS d, 0.9 * count(*) AS r FROM e WHERE t >= {START} AND t < {END} GROUP BY ALL)
SELECT t AS step_ts, event_type, round(CASE WHEN a >= r THEN 20 * r / a WHEN a + b >= r THEN 20 + 40 * (r - a) / b WHEN a + b + c >= r THEN 60 + 90 * (r - a - b) / c ELSE 150 + 150 * (r - a - b - c) / d END, 6) AS value FROM h"""


def plan_totals(spark, sf_dir: str) -> DataFrame:
    return windows.totals(event_samples(spark, sf_dir), "event_value", START, END)


QUERIES["plan_totals"] = plan_totals
ORACLE["plan_totals"] = f"WITH {_RAW} SELECT count(*) AS points, count(DISTINCT event_type || '/' || shard) AS series FROM s WHERE ts BETWEEN {START} AND {END}"

#: Histograms of days at each step, and their buckets below the last bound.
_HIST = f"""WITH {_STEPS}, e AS (SELECT event_type, epoch_us(ts) * 1000 AS ts, value AS v FROM events),
h AS (SELECT event_type, ts - ts % {DAY} AS ts, count(*) AS n, sum(v) AS total, [count(*) FILTER (v <= 20), count(*) FILTER (v > 20 AND v <= 60), count(*) FILTER (v > 60 AND v <= 150)] AS c FROM e GROUP BY ALL),
i AS (SELECT t, event_type, max_by(n, ts) AS n, max_by(total, ts) AS total, max_by(c, ts) AS c FROM st JOIN h ON ts BETWEEN t - {6 * HOUR} AND t GROUP BY ALL),
m AS (SELECT *, (c[1] * 10 + c[2] * 40 + c[3] * 105) / (c[1] + c[2] + c[3]) AS mu FROM i),
x AS (SELECT *, (c[1] * (10 - mu) ** 2 + c[2] * (40 - mu) ** 2 + c[3] * (105 - mu) ** 2) / (c[1] + c[2] + c[3]) AS var, 0.5 * n AS r FROM m)"""


def _hist(name: str, query: str, value: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        engine = Engine(event_samples(spark, sf_dir), 6 * HOUR, event_histograms(spark, sf_dir), ("event_hist",))
        return _flat(engine.query_range(query, START, END, STEP), "event_type")

    QUERIES[f"promql_native_{name}"] = run
    ORACLE[f"promql_native_{name}"] = f"{_HIST} SELECT t AS step_ts, event_type, round(({value})::DOUBLE, 6) AS value FROM x"


_hist("count", "histogram_count(event_hist)", "n")
_hist("sum", "histogram_sum(event_hist)", "total")
_hist("avg", "histogram_avg(event_hist)", "total / n")
_hist("stdvar", "histogram_stdvar(event_hist)", "CASE WHEN c[1] + c[2] + c[3] > 0 THEN var ELSE 'nan' END")
_hist("stddev", "histogram_stddev(event_hist)", "CASE WHEN c[1] + c[2] + c[3] > 0 THEN sqrt(var) ELSE 'nan' END")
_hist("fraction", "histogram_fraction(10, 100, event_hist)", "(c[1] / 2 + c[2] + c[3] * 40 / 90) / n")
_hist("quantile", "histogram_quantile(0.5, event_hist)", "CASE WHEN c[1] >= r THEN 20 * r / c[1] WHEN c[1] + c[2] >= r THEN 20 + 40 * (r - c[1]) / c[2] WHEN c[1] + c[2] + c[3] >= r THEN 60 + 90 * (r - c[1] - c[2]) / c[3] ELSE 150 END")


def noise_scores(spark, sf_dir: str) -> DataFrame:
    """Of the alerts of event types above 60 at once, none of which anyone acknowledges."""
    v = Engine(event_samples(spark, sf_dir), 6 * HOUR).query_range("avg by (event_type) (event_value)", START, END, STEP)
    states = rules.alert_states(v, ">", 60.0, STEP)
    w = Window.partitionBy("lkey").orderBy("step_ts")
    firings = states.withColumn("before", F.lag("state").over(w)).where("state = 'resolved' or (state = 'firing' and before is distinct from 'firing')")
    return rules.noise_scores(firings).select(F.get_json_object("lkey", "$.event_type").alias("event_type"), "fired", F.round("score", 6).alias("score"))


def alert_evidence(spark, sf_dir: str) -> DataFrame:
    v = Engine(event_samples(spark, sf_dir), 6 * HOUR).query_range("avg by (event_type) (event_value)", START, END, STEP)
    return rules.evidence(v, 20).select(F.get_json_object("lkey", "$.event_type").alias("event_type"), "step_ts", F.round("value", 6).alias("value"))


QUERIES |= {"alert_noise_scores": noise_scores, "alert_evidence": alert_evidence}
ORACLE |= {
    "alert_noise_scores": f"""WITH a AS ({ORACLE["alert_states"].replace(str(2 * STEP), str(STEP))}), f AS (SELECT *, lag(state) OVER (PARTITION BY event_type ORDER BY step_ts) AS before FROM a),
n AS (SELECT event_type, count(*) FILTER (state = 'firing' AND before IS DISTINCT FROM 'firing') AS fired, count(*) FILTER (state = 'resolved') AS cleared FROM f WHERE state = 'resolved' OR (state = 'firing' AND before IS DISTINCT FROM 'firing') GROUP BY ALL)
SELECT event_type, fired, round(least(cleared, fired) / fired, 6) AS score FROM n""",
    "alert_evidence": f"""{_MEANS}, o AS (SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM a WINDOW w AS (PARTITION BY event_type ORDER BY t)),
b AS (SELECT o.*, r.b FROM o JOIN range(9) r(b) ON i >= r.b * n // 9 AND i < (r.b + 1) * n // 9 WHERE n > 20),
k AS (SELECT event_type, t, v FROM o WHERE n <= 20 OR i = 0 OR i = n - 1
  UNION SELECT event_type, t, v FROM b QUALIFY row_number() OVER (PARTITION BY event_type, b ORDER BY v, t) = 1 OR row_number() OVER (PARTITION BY event_type, b ORDER BY v DESC, t DESC) = 1)
SELECT event_type, t AS step_ts, round(v, 6) AS value FROM k""",
}

# -- logs ---------------------------------------------------------------------------------------------------------
_LOGS = """WITH l AS (SELECT event_id, epoch_us(ts) * 1000 AS ts_ns, user_id, event_type, value, 'svc-' || (user_id % 5) AS service,
CASE event_type WHEN 'error' THEN 17 WHEN 'purchase' THEN 13 ELSE 9 END AS sev, 'user ' || user_id || ' ' || event_type || ' took ' || value || 'ms' AS body FROM events)"""


def _search(name: str, query: str, where: str) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        df = signals.search_logs(event_logs(spark, sf_dir), query, START, END, limit=10_000)
        return df.select("ts_ns", "severity_number", F.element_at("attributes", F.lit("user_id")).alias("user_id"), F.element_at("resource", F.lit("service.name")).alias("service"))

    QUERIES[f"logs_{name}"] = run
    ORACLE[f"logs_{name}"] = f"{_LOGS} SELECT ts_ns, sev AS severity_number, user_id::VARCHAR AS user_id, service FROM l WHERE {where} ORDER BY ts_ns DESC, event_id LIMIT 10000"


_search("term", "SIGNUP", "event_type = 'signup'")
_search("tree", '(severity>=WARN OR event_type=click) AND NOT service:svc-1 user_id:[10..90]', "(sev >= 13 OR event_type = 'click') AND service <> 'svc-1' AND user_id BETWEEN 10 AND 90")
_search("regex_and_negation", 'body=~"user 1[0-9] " -purchase duration_ms>100', "regexp_matches(body, 'user 1[0-9] ') AND event_type <> 'purchase' AND value > 100")
_search("selector", '{event_type=~"click|err.*", user_id!="7", service="svc-2"}', "(event_type = 'click' OR event_type LIKE 'err%') AND user_id <> 7 AND service = 'svc-2'")
_search("wildcard", "event_type=p*e duration_ms<50 nothing!=x", "event_type = 'purchase' AND value < 50")


def log_volume(spark, sf_dir: str) -> DataFrame:
    return signals.volume(event_logs(spark, sf_dir), START, END)


def log_field_values(spark, sf_dir: str) -> DataFrame:
    return signals.log_field_values(event_logs(spark, sf_dir), "service")


def log_fields(spark, sf_dir: str) -> DataFrame:
    return signals.log_fields(event_logs(spark, sf_dir))


def correlate(spark, sf_dir: str) -> DataFrame:
    df = event_logs(spark, sf_dir).all().withColumn("service_name", F.element_at("resource", F.lit("service.name")))
    return signals.correlate(df, {"service_name": "svc-2"}, START + 15 * DAY, 2 * HOUR).select("ts_ns", F.round("score", 6).alias("score"))


def live_pipeline(spark, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir)[0].groupBy("pipeline", "destination", "severity_text").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("body").startswith("user *")).alias("masked"))


def live_metrics(spark, sf_dir: str) -> DataFrame:
    m = _live(spark, sf_dir)[1]
    return m.groupBy("metric_name", F.element_at("labels", F.lit("what")).alias("what")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def _live(spark, sf_dir: str):
    steps = [live.Extract(r"user (?<who>\d+) (?<what>\w+) took (?<ms>[\d.]+)ms", keep=False), live.Cast("ms", "float"), live.Metric("seen_total", dimensions=("what", "absent")), live.Metric("took_ms", "ms", ("what",), "ms > 100"), live.Mask(r"user \d+", "user *"), live.Route("what = click and ms < 10"), live.Route("what in (view, signup)", "archive")]
    return live.run(event_logs(spark, sf_dir).all(), [live.Pipeline("quiet", "severity_number < 17", steps)])


QUERIES |= {"logs_volume": log_volume, "logs_field_values": log_field_values, "logs_fields": log_fields, "correlate_score": correlate, "live_pipeline": live_pipeline, "live_metrics": live_metrics}
_W = (END - START) // 60
ORACLE |= {
    "logs_volume": f"{_LOGS} SELECT least(greatest((ts_ns - {START}) // {_W}, 0), 59)::INT AS bucket, count(*) AS n FROM l WHERE ts_ns BETWEEN {START} AND {END} GROUP BY ALL",
    "logs_field_values": f"{_LOGS} SELECT service AS value, count(*) AS n FROM l GROUP BY ALL",
    "logs_fields": "SELECT field, n FROM (SELECT count(*) AS n FROM events), (SELECT unnest(['event_type', 'user_id', 'duration_ms']) AS field)",
    "correlate_score": f"{_LOGS} SELECT ts_ns, round(40000 + 100.0 * ({2 * HOUR} - abs(ts_ns - {START + 15 * DAY})) / {2 * HOUR}, 6) AS score FROM l WHERE service = 'svc-2' AND abs(ts_ns - {START + 15 * DAY}) <= {2 * HOUR} ORDER BY score DESC, ts_ns LIMIT 100",
    "live_pipeline": f"{_LOGS} SELECT CASE WHEN sev < 17 THEN 'quiet' END AS pipeline, CASE WHEN event_type IN ('view', 'signup') THEN 'archive' END AS destination, CASE sev WHEN 17 THEN 'ERROR' WHEN 13 THEN 'WARN' ELSE 'INFO' END AS severity_text, count(*) AS n, count(*) FILTER (sev < 17) AS masked FROM l WHERE NOT (event_type = 'click' AND value < 10) GROUP BY ALL",
    "live_metrics": f"{_LOGS} SELECT 'seen_total' AS metric_name, event_type AS what, count(*) AS n, round(count(*)::DOUBLE, 3) AS total FROM l WHERE sev < 17 GROUP BY ALL UNION ALL SELECT 'took_ms', event_type, count(*), round(sum(value), 3) FROM l WHERE sev < 17 AND value > 100 GROUP BY ALL",
}

# -- spans --------------------------------------------------------------------------------------------------------
_SPANS = """WITH sp AS (SELECT lpad(lower(to_hex(o_custkey)), 32, '0') AS trace_id, lpad(lower(to_hex(o_orderkey)), 16, '0') AS span_id, 'order ' || o_orderpriority AS name, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 2 END AS kind,
epoch_us(o_orderdate) * 1000 + o_orderkey * 1000 AS start_ns, floor(o_totalprice)::BIGINT * 10000 AS took, CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END AS status, 'svc-' || (o_custkey % 7) AS service FROM orders)"""


def span_red(spark, sf_dir: str) -> DataFrame:
    df = signals.red_metrics(order_spans(spark, sf_dir))
    return df.groupBy("metric_name", F.element_at("labels", F.lit("service")).alias("service"), F.element_at("labels", F.lit("operation")).alias("operation")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


def span_search(spark, sf_dir: str) -> DataFrame:
    df = signals.search_traces(order_spans(spark, sf_dir), "status=error duration>1500 priority=*URGENT", 0, 10**19 // 2, limit=1000)
    return df.select("trace_id", "span_id", "start_ns", "service")


def tail_sampling(spark, sf_dir: str) -> DataFrame:
    return signals.tail_sample(order_spans(spark, sf_dir), 0.2, 4900.0).groupBy("service").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"))


def service_sampling(spark, sf_dir: str) -> DataFrame:
    kept = signals.tail_sample(order_spans(spark, sf_dir), 0.2, 4900.0, services={"svc-1": (0.0, None, False), "svc-2": (0.5, 4000.0, True)})
    return kept.groupBy("service").agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("trace_id").alias("traces"))


QUERIES["spans_service_sampling"] = service_sampling
ORACLE["spans_service_sampling"] = f"""{_SPANS}, p AS (SELECT trace_id, bool_or(status = 2) AS bad, max(took / 1e6) FILTER (kind = 2) AS slow, arg_min(service, (start_ns, span_id)) AS s, ('0x' || substr(md5(trace_id), 1, 8))::BIGINT % 10000 AS h FROM sp GROUP BY ALL),
k AS (SELECT trace_id FROM p WHERE CASE s WHEN 'svc-1' THEN false WHEN 'svc-2' THEN bad OR slow >= 4000 OR h < 5000 ELSE bad OR slow >= 4900 OR h < 2000 END)
SELECT service, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM sp SEMI JOIN k USING (trace_id) GROUP BY ALL"""


QUERIES |= {"spans_red_metrics": span_red, "spans_search": span_search, "spans_tail_sampling": tail_sampling}
ORACLE |= {
    "spans_red_metrics": f"{_SPANS}, p AS (SELECT name, service, unnest([{{'m': 'span_requests_total', 'v': 1.0::DOUBLE}}, {{'m': 'span_errors_total', 'v': (status = 2)::INT::DOUBLE}}, {{'m': 'span_duration_ms', 'v': took / 1e6}}]) AS p FROM sp WHERE kind = 2) SELECT p.m AS metric_name, service, name AS operation, count(*) AS n, round(sum(p.v), 3) AS total FROM p GROUP BY ALL",
    "spans_search": f"{_SPANS} SELECT trace_id, span_id, start_ns, service FROM sp WHERE status = 2 AND took / 1e6 > 1500 AND name LIKE '%URGENT' ORDER BY start_ns DESC, span_id LIMIT 1000",
    "spans_tail_sampling": f"{_SPANS}, k AS (SELECT trace_id FROM sp GROUP BY ALL HAVING bool_or(status = 2 OR (kind = 2 AND took / 1e6 >= 4900)) OR ('0x' || substr(md5(trace_id), 1, 8))::BIGINT % 10000 < 2000) SELECT service, count(*) AS spans, count(DISTINCT trace_id) AS traces FROM sp SEMI JOIN k USING (trace_id) GROUP BY ALL",
}


# -- the piped language -------------------------------------------------------------------------------------------
def _piped(name: str, query: str, sql: str, finish=lambda df: df) -> None:
    def run(spark, sf_dir: str) -> DataFrame:
        p = Pipelines(event_logs(spark, sf_dir), order_spans(spark, sf_dir), event_samples(spark, sf_dir))
        return finish(p.run(query, 0, 10**19 // 2))

    QUERIES[f"pipeline_{name}"], ORACLE[f"pipeline_{name}"] = run, sql


def _rounded(*cols: str):
    return lambda df: df.select(*[F.round(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


_piped("log_stats", 'fetch logs | filter severity>=WARN | parse "took ([0-9.]+)ms" as ms | filter ms > 100 | stats count() as n, avg(ms) as mean, p95(ms) as p95, max(ms) as top by service', f"{_LOGS} SELECT service, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.95), 6) AS p95, round(max(value), 6) AS top FROM l WHERE sev >= 13 AND value > 100 GROUP BY ALL", _rounded("mean", "p95", "top"))
_piped("log_buckets", "fetch logs | filter event_type=error | stats count() as n, sum(duration_ms) as total by service interval=1d", f"{_LOGS}, c AS (SELECT service, ts_ns - ts_ns % {DAY} AS b, count(*) AS n, sum(value) AS total FROM l WHERE event_type = 'error' GROUP BY ALL), g AS (SELECT * FROM (SELECT DISTINCT service FROM c), (SELECT DISTINCT b FROM c)) SELECT service, b AS bucket_ns, coalesce(n, 0) AS n, round(coalesce(total, 0), 6) AS total FROM g LEFT JOIN c USING (service, b)", _rounded("total"))
_piped("span_stats", "fetch traces | filter kind=2 duration_ms>100 | stats count() as n, p50(duration_ms) as p50 by service, status", f"{_SPANS} SELECT service, CASE status WHEN 2 THEN 'ERROR' ELSE 'UNSET' END AS status, count(*) AS n, round(quantile_cont(took / 1e6, 0.5), 6) AS p50 FROM sp WHERE kind = 2 AND took / 1e6 > 100 GROUP BY ALL", _rounded("p50"))
_piped("metric_stats", "fetch metrics | filter event_type!=view | stats count() as n, min(value) as low by event_type, shard", "SELECT event_type, 's' || (user_id % 4) AS shard, count(*) AS n, min(value) AS low FROM events WHERE event_type <> 'view' GROUP BY ALL")
_piped("correlate_traces", "fetch logs | filter event_type=error | correlate traces window=6h | stats count() as n, sum(correlated_span_count) as spans, max(correlated_trace_duration_ms) as longest by service", f"""{_LOGS}, {_SPANS.removeprefix("WITH ")},
p AS (SELECT trace_id, count(*) AS c, max(took / 1e6) AS d FROM sp GROUP BY ALL), e AS (SELECT *, lpad(to_hex(event_id % 1000), 32, '0') AS trace_id FROM l WHERE event_type = 'error'),
j AS (SELECT e.event_id, e.service, e.ts_ns, p.c, p.d FROM e LEFT JOIN p USING (trace_id)),
k AS (SELECT event_id, j.service, count(start_ns) AS c, max(took / 1e6) AS d FROM j LEFT JOIN sp ON j.service = sp.service AND abs(start_ns - ts_ns) <= {6 * HOUR} WHERE j.c IS NULL GROUP BY ALL),
a AS (SELECT service, c, d FROM j WHERE c IS NOT NULL UNION ALL SELECT service, nullif(c, 0), d FROM k)
SELECT service, count(*) AS n, coalesce(sum(c), 0)::DOUBLE AS spans, max(d) AS longest FROM a GROUP BY ALL""", _rounded("longest"))
_piped("correlate_logs", "fetch logs | filter event_type=purchase | correlate logs window=1h | stats count() as n, sum(correlated_log_count) as near, max(correlated_max_severity_number) as worst by service", f"{_LOGS}, j AS (SELECT a.event_id, a.service, count(*) AS c, max(b.sev) AS m FROM l a JOIN l b ON a.service = b.service AND abs(a.ts_ns - b.ts_ns) <= {HOUR} WHERE a.event_type = 'purchase' GROUP BY ALL) SELECT service, count(*) AS n, sum(c)::DOUBLE AS near, max(m)::DOUBLE AS worst FROM j GROUP BY ALL")
