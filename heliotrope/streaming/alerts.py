"""Alerts as state: the machine of one alert, notification groups, the ledger of what was sent, and the series limiter.

Each is a plain class that takes events in order, and a stream that keeps one of it for each key. Time is the time in the
rows (evaluations tick), so a replay gives the same result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import label_key

PENDING, FIRING, ACKNOWLEDGED, SUPPRESSED, FLAGGED, RESOLVED = "pending", "firing", "acknowledged", "suppressed", "noise", "resolved"


@dataclass
class Alert:
    """pending once over the threshold, firing when that has held; acknowledged, flagged as noise or suppressed by events;
    resolved when it clears, and pending again, one generation on, when it comes back. An alert that fires for the third
    time or more and whose firings mostly cleared unattended (score of `noisy`) is suppressed at once."""

    phase: str = ""
    since: int = 0
    generation: int = 0
    fired: int = 0
    acked: int = 0
    cleared: int = 0

    @property
    def score(self) -> float:
        if not self.fired:
            return 0.0
        return (self.fired - min(self.acked, self.fired)) / self.fired * min(self.cleared, self.fired) / self.fired

    def evaluate(self, ts: int, over: bool, hold: int, noisy: float = 0.7) -> list[str]:
        """New phases, in order, of an evaluation at ts."""
        out = []
        if over:
            if self.phase in ("", RESOLVED):
                self.generation += self.phase == RESOLVED
                self.phase, self.since = PENDING, ts
                out.append(PENDING)
            if self.phase == PENDING and ts - self.since >= hold:
                before = self.score
                self.phase, self.fired = FIRING, self.fired + 1
                out.append(FIRING)
                if self.fired >= 3 and before >= noisy:
                    self.phase = SUPPRESSED
                    out.append(SUPPRESSED)
        elif self.phase not in ("", RESOLVED):
            self.cleared += self.phase != PENDING
            self.phase = RESOLVED
            out.append(RESOLVED)
        return out

    def act(self, event: str) -> list[str]:
        """New phases of what someone did: ack, expire (of an ack), noise, signal, mute."""
        to = {("ack", FIRING): ACKNOWLEDGED, ("expire", ACKNOWLEDGED): FIRING, ("noise", FIRING): FLAGGED, ("signal", FLAGGED): FIRING, ("signal", SUPPRESSED): FIRING, ("mute", FLAGGED): SUPPRESSED}.get((event, self.phase))
        if not to:
            return []
        self.acked += to == ACKNOWLEDGED
        self.phase = to
        return [to]


def machine(points: DataFrame, threshold: float, hold: int, noisy: float = 0.7) -> DataFrame:
    """points (lkey, step_ts, value, event) -> (lkey, step_ts, state, generation, score); event is null for evaluations,
    which have a value. The state of an alert is a few numbers."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        alert = Alert(**json.loads(state.get[0])) if state.exists else Alert()
        out = []
        for frame in frames:
            for ts, v, event in frame.sort_values("step_ts", kind="stable")[["step_ts", "value", "event"]].itertuples(index=False):
                new = alert.act(event) if isinstance(event, str) else alert.evaluate(int(ts), bool(v > threshold), hold, noisy)
                out += [(key[0], int(ts), s, alert.generation, alert.score) for s in new]
        state.update((json.dumps(asdict(alert)),))
        yield pd.DataFrame(out, columns=["lkey", "step_ts", "state", "generation", "score"])

    return points.groupBy("lkey").applyInPandasWithState(step, "lkey string, step_ts long, state string, generation long, score double", "alert string", "append", "NoTimeout")


# -- notification groups --------------------------------------------------------------------------------------------
def group_key(labels: Column, by: list[str], name: Column) -> Column:
    """The key of an alert's group: its labels named in by, all of them for "...", or the alert's name if it has none."""
    if by == ["..."]:
        return label_key(labels)
    kept = F.map_filter(labels, lambda k, v: k.isin(by))
    return F.when(F.size(kept) > 0, label_key(kept)).otherwise(label_key(F.create_map(F.lit("alertname"), name)))


@dataclass
class Group:
    """The alerts of a group and when it was last told of: after `wait` at first, after `interval` for changes, after
    `repeat` while some still fire; once all have resolved, for changes only. ledger: when each (generation, reason) was
    sent; a resolution is sent once a generation, others again after their interval."""

    created: int = -1
    last: int = -1
    phase: str = "waiting"
    dirty: bool = False
    generation: int = 0
    alerts: dict[str, str] = field(default_factory=dict)
    ledger: dict[str, int] = field(default_factory=dict)

    def change(self, ts: int, alert: str, state: str) -> None:
        if state not in (FIRING, RESOLVED) or (state == RESOLVED and alert not in self.alerts):
            return
        if self.created < 0:
            self.created = ts
        if self.alerts.get(alert) != state:
            self.alerts[alert], self.dirty = state, True
        if self.phase == "resolved" and state == FIRING:
            self.phase, self.generation = "active", self.generation + 1

    def due(self, ts: int, wait: int, interval: int, repeat: int) -> str | None:
        """initial, update, repeat or resolved if a notification goes out at ts."""
        firing = FIRING in self.alerts.values()
        if self.created < 0:
            return None
        if self.phase == "waiting":
            reason, after = ("initial", 0) if ts >= self.created + wait else (None, 0)
        elif self.dirty:
            reason, after = ("update" if firing else "resolved", interval) if ts >= self.last + interval else (None, 0)
        else:
            reason, after = ("repeat", repeat) if self.phase == "active" and firing and ts >= self.last + repeat else (None, 0)
        if reason is None:
            return None
        sent = self.ledger.get(f"{self.generation} {reason}")
        self.phase, self.dirty, self.last = "active" if firing else "resolved", False, ts
        if sent is not None and (reason == "resolved" or ts - sent < after):
            return None
        self.ledger = {k: t for k, t in self.ledger.items() if k.startswith(f"{self.generation} ")} | {f"{self.generation} {reason}": ts}
        return reason


def notifications(events: DataFrame, wait: int = 30 * 10**9, interval: int = 300 * 10**9, repeat: int = 4 * 3600 * 10**9) -> DataFrame:
    """events (receiver, gkey, step_ts, lkey, state) -> (receiver, gkey, step_ts, reason, firing, resolved). Rows without a
    state are ticks of a group's clock."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        group, out = Group(**json.loads(state.get[0])) if state.exists else Group(), []
        for frame in frames:
            frame = frame.sort_values("step_ts", kind="stable")
            for ts, rows in frame.groupby("step_ts", sort=True):
                for alert, s in rows[["lkey", "state"]].itertuples(index=False):
                    if isinstance(s, str):
                        group.change(int(ts), alert, s)
                if reason := group.due(int(ts), wait, interval, repeat):
                    values = list(group.alerts.values())
                    out.append((*key, int(ts), reason, values.count(FIRING), values.count(RESOLVED)))
                    group.alerts = {a: s for a, s in group.alerts.items() if s == FIRING}  # told of for the last time
        state.update((json.dumps(asdict(group)),))
        yield pd.DataFrame(out, columns=["receiver", "gkey", "step_ts", "reason", "firing", "resolved"])

    return events.groupBy("receiver", "gkey").applyInPandasWithState(step, "receiver string, gkey string, step_ts long, reason string, firing int, resolved int", "grp string", "append", "NoTimeout")


# -- limits ---------------------------------------------------------------------------------------------------------
def limit_series(samples: DataFrame, limit: int) -> DataFrame:
    """Samples of the first `limit` series of each metric that were ever seen (0: all). The state of a metric is the keys it
    has admitted, `limit` at most."""
    if limit <= 0:
        return samples
    names = samples.columns
    keyed = samples.withColumn("_key", label_key(F.col("labels"))).withColumn("_row", F.to_json(F.struct(*names)))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = set(json.loads(state.get[0])) if state.exists else set()
        for frame in frames:
            fresh = [k for k in frame.sort_values(["ts_ns", "_key"])["_key"].drop_duplicates() if k not in known]
            known |= set(fresh[: max(0, limit - len(known))])
            yield frame.loc[frame["_key"].isin(known), ["_row"]]
        state.update((json.dumps(sorted(known)),))

    out = keyed.select("metric_name", "ts_ns", "_key", "_row").groupBy("metric_name").applyInPandasWithState(step, "_row string", "known string", "append", "NoTimeout")
    return out.select(F.from_json("_row", samples.schema).alias("r")).select("r.*")
