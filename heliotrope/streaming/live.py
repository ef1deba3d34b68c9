"""Streams: span metrics, live tail, windowed log counts and the alert state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.signals import red_metrics
from ..plans.search import compile_search, log_target


def span_metrics(spans: DataFrame) -> DataFrame:
    """The stream of points of a stream of spans; stateless."""
    return red_metrics(spans)


def tail_logs(logs: DataFrame, query: str) -> DataFrame:
    return logs.where(compile_search(query, log_target()))


def counts(logs: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Logs per service and window of event time; a window is final once the watermark has passed it."""
    at = F.timestamp_micros((F.col("ts_ns") / 1000).cast("long"))
    df = logs.withColumn("at", at).withWatermark("at", late)
    return df.groupBy(F.window("at", window), F.element_at("resource", F.lit("service.name")).alias("service")).agg(F.count(F.lit(1)).alias("n"))


STATE = "since long, firing boolean"
TRANSITIONS = "lkey string, step_ts long, state string"


def alert_transitions(points: DataFrame, threshold: float, hold: int) -> DataFrame:
    """points (lkey, step_ts, value) -> transitions pending, firing, resolved, with state kept per series."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        since, firing = state.get if state.exists else (-1, False)
        rows = pd.concat(list(frames)).sort_values("step_ts")  # the new points of one series in one batch
        out = []
        for ts, v in zip(rows.step_ts, rows.value):
            if v > threshold:
                if since < 0:
                    since = int(ts)
                    out.append((key[0], ts, "pending"))
                if not firing and ts - since >= hold:
                    firing = True
                    out.append((key[0], ts, "firing"))
            elif since >= 0:
                if firing:
                    out.append((key[0], ts, "resolved"))
                since, firing = -1, False
        state.update((since, firing))
        yield pd.DataFrame(out, columns=["lkey", "step_ts", "state"])

    return points.groupBy("lkey").applyInPandasWithState(step, TRANSITIONS, STATE, "append", "NoTimeout")
