"""Recording rules, their backfill, and alerts: thresholds, states, silences, inhibition and routing."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import label_key
from ..plans.promql import Engine

COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "==": lambda a, b: F.abs(a - b) < 1e-12, "!=": lambda a, b: F.abs(a - b) >= 1e-12}


def record(engine: Engine, name: str, query: str, start: int, end: int, interval: int, labels: dict[str, str] | None = None) -> DataFrame:
    """Samples of a recording rule for all intervals of [start, end), times truncated to the interval; given labels win.
    A backfill is the same call over the intervals missed: one plan, not a query for each."""
    own = F.create_map(*[F.lit(x) for kv in sorted((labels or {}).items()) for x in kv]) if labels else None
    v = engine.query_range(query, start - start % interval, end, interval)
    m = F.col("labels") if own is None else F.map_concat(F.map_filter("labels", lambda k, _: ~k.isin(list(labels))), own)
    return v.select(F.lit(name).alias("metric_name"), m.alias("labels"), F.col("step_ts").alias("ts_ns"), "value")


def alert_states(vector: DataFrame, op: str, threshold: float, hold: int) -> DataFrame:
    """(labels, lkey, step_ts, state): pending from the first step over the threshold, firing once it has held for `hold`
    ns, resolved at the step that clears it. Runs are found by window sums per series."""
    over = COMPARE[op](F.col("value"), F.lit(float(threshold)))
    w = Window.partitionBy("lkey").orderBy("step_ts")
    df = vector.withColumn("on", over).withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False)))
    df = df.withColumn("run", F.sum((F.col("on") != F.col("was")).cast("int")).over(w))
    df = df.withColumn("since", F.min("step_ts").over(Window.partitionBy("lkey", "run"))).withColumn("was_since", F.lag("since").over(w)).withColumn("prior", F.lag("step_ts").over(w))
    fired = F.col("prior") - F.col("was_since") >= hold
    state = F.when(F.col("on"), F.when(F.col("step_ts") - F.col("since") >= hold, "firing").otherwise("pending")).when(F.col("was") & fired, "resolved")
    return df.withColumn("state", state).where("state is not null").select("labels", "lkey", "step_ts", "state")


@dataclass
class Route:
    """A node of a routing tree; the deepest that matches takes the alert, and with `go_on` its later siblings too."""

    receiver: str | None = None
    match: dict[str, str] = field(default_factory=dict)
    go_on: bool = False
    routes: list[Route] = field(default_factory=list)


def matches(labels: Column, match: dict[str, str]) -> Column:
    """Anchored regular expressions by label; an absent label is empty."""
    out = F.lit(True)
    for k, re_ in match.items():
        out = out & F.coalesce(F.element_at(labels, F.lit(k)), F.lit("")).rlike(f"^(?:{re_})$")
    return out


def receivers(labels: Column, root: Route) -> Column:
    """The receivers of an alert, depth first."""

    def of(node: Route, inherited: str | None) -> Column:
        own = node.receiver or inherited
        if not node.routes:
            return F.array(F.lit(own))
        found, done = F.array().cast("array<string>"), F.lit(False)
        for r in node.routes:
            hit = matches(labels, r.match) & ~done
            found = F.when(hit, F.concat(found, of(r, own))).otherwise(found)
            done = done if r.go_on else done | hit
        return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(own)))

    return of(root, None)


def silenced(labels: Column, ts: Column, silences: list[tuple[dict[str, str], int, int]]) -> Column:
    """Whether a silence (equal labels, from, to) holds at ts."""
    out = F.lit(False)
    for m, a, b in silences:
        same = F.lit(True)
        for k, v in m.items():
            same = same & F.coalesce(F.element_at(labels, F.lit(k)) == v, F.lit(False))
        out = out | (same & ts.between(a, b))
    return out


def inhibited(alerts: DataFrame, source: dict[str, str], target: dict[str, str], equal: list[str]) -> DataFrame:
    """alerts (labels, step_ts, state) with `inhibited`: a firing source at the same step with the same `equal` labels
    holds a target down."""
    key = label_key(F.map_filter("labels", lambda k, v: k.isin(equal)))
    src = alerts.where((F.col("state") == "firing") & matches(F.col("labels"), source)).select("step_ts", key.alias("_k"), F.lit(True).alias("_hit")).distinct()
    marked = alerts.withColumn("_k", key).join(src, ["step_ts", "_k"], "left")
    return marked.withColumn("inhibited", matches(F.col("labels"), target) & ~matches(F.col("labels"), source) & F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


# -- judging alerts -------------------------------------------------------------------------------------------------
def noise_scores(transitions: DataFrame) -> DataFrame:
    """(lkey, fired, score): of an alert's firings the share that nobody acknowledged times the share that resolved."""
    n = lambda state: F.count_if(F.col("state") == state)
    per = transitions.groupBy("lkey").agg(n("firing").alias("fired"), n("acknowledged").alias("acked"), n("resolved").alias("cleared"))
    fired = F.col("fired")
    share = (fired - F.least("acked", fired)) / fired * F.least("cleared", fired) / fired
    return per.select("lkey", "fired", F.when(fired > 0, share).otherwise(0.0).alias("score"))


def evidence(points: DataFrame, most: int = 240) -> DataFrame:
    """Of each series' points (lkey, step_ts, value) at most `most`: all, or the first, the last, and the least and greatest
    of equally many points each. Values that are not finite are left out."""
    most = min(4096, max(2, most))
    buckets = max(1, (most - 2) // 2)
    df = points.where(F.abs("value") < float("inf"))
    w = Window.partitionBy("lkey")
    df = df.withColumn("i", F.row_number().over(w.orderBy("step_ts"))).withColumn("n", F.count(F.lit(1)).over(w))
    few = df.where(F.col("n") <= most).select("lkey", "step_ts", "value")
    cell = F.call_function("div", F.col("i") * buckets + F.col("n") - 1, F.col("n")) - 1
    at, by = F.struct("step_ts", "value"), F.struct("value", "step_ts")
    many = df.where(F.col("n") > most).groupBy("lkey", cell.alias("cell")).agg(F.array(F.min_by(at, by), F.max_by(at, by), F.min(at), F.max(at)).alias("p"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.max("n").alias("n"))
    ends = F.filter("p", lambda x, i: (i < 2) | ((i == 2) & (F.col("lo") == 1)) | ((i == 3) & (F.col("hi") == F.col("n"))))
    return few.union(many.select("lkey", F.explode(ends).alias("x")).select("lkey", "x.step_ts", "x.value").distinct())
