"""State of each service kept in a stream: episodes of short flows and gated memories, in event-time order."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: transformWithState keeps its state in this store; the session that runs the stream must name it.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@dataclass(frozen=True)
class MemoryRule:
    """One step of a service's memory: the batch fold and the stream both take it."""

    threshold: float
    size: int = 128
    least: float = 0.7
    alpha: float = 0.95
    top: int = 5

    def step(self, memory: list[float], trust: float, value: float, score: float, forced: bool) -> tuple[float, bool, list[float], float]:
        """(score against the memory, admitted, memory after, reputation after)."""
        near = sorted([abs(value - m) for m in memory])[: self.top]
        got = sum(near) / len(near) if len(near) == self.top else score
        bad = got >= self.threshold
        trust = self.alpha * trust if bad else min(1.0, self.alpha * trust + (1 - self.alpha))
        admit = bool(forced) or not bad and trust >= self.least
        return got, admit, [*memory, value][-self.size :] if admit else memory, trust


class ServiceMemory:
    """A service's memory and reputation as they go through `MemoryRule.step`, the values also in order of size: the nearest are among `top`
    on each side of a value, so a step does not look at all of them. A memory with a NaN has no order and takes the rule's own step."""

    def __init__(self, rule: MemoryRule, values: Iterable[float] = (), trust: float = 1.0):
        self.rule, self.trust = rule, trust
        self.hold(values)

    def hold(self, values: Iterable[float]) -> None:
        self.values = deque(values)
        self.ordered = sorted(self.values) if all(v == v for v in self.values) else None

    def step(self, value: float, score: float, forced: bool) -> tuple[float, bool]:
        """(score against the memory, admitted)."""
        rule, ordered = self.rule, self.ordered
        if ordered is None or value != value:
            got, admit, values, self.trust = rule.step([*self.values], self.trust, value, score, forced)
            self.hold(values)
            return got, admit
        top, got = rule.top, score
        if len(ordered) >= top:
            at = bisect_left(ordered, value)
            near = sorted([abs(value - m) for m in ordered[max(0, at - top) : at + top]])[:top]
            got = sum(near) / top
        bad = got >= rule.threshold
        self.trust = rule.alpha * self.trust if bad else min(1.0, rule.alpha * self.trust + (1 - rule.alpha))
        admit = bool(forced) or not bad and self.trust >= rule.least
        if admit:
            self.values.append(value)
            insort(ordered, value)
            while 0 < rule.size < len(ordered):
                del ordered[bisect_left(ordered, self.values.popleft())]
        return got, admit


@dataclass(frozen=True)
class EpisodeRule:
    """Episodes of short flows (STR05) over (us, flows, short flows) of the last `window` seconds, oldest first."""

    threshold: float
    window: float
    min_count: int
    max_packets: int
    min_short: float
    min_score: float = 0.0
    merge: str = "or"

    def step(self, recent: list[tuple[int, int, int]], us: int, packets: int | None, score: float | None) -> tuple[list[tuple[int, int, int]], int, int, int, int]:
        """(recent flows after, alert of the model, of the episode, of both, flows in the window)."""
        short = int(packets is not None and packets <= self.max_packets)
        first = us - round(self.window * 1e6)
        recent = [r for r in recent if r[0] >= first]
        if recent and recent[-1][0] == us:
            recent[-1] = (us, recent[-1][1] + 1, recent[-1][2] + short)
        else:
            recent.append((us, 1, short))
        count, tiny = sum(r[1] for r in recent), sum(r[2] for r in recent)
        model = score is not None and score >= self.threshold
        episode = bool(short) and score is not None and score >= self.min_score and count >= self.min_count and tiny / count >= self.min_short
        return recent, int(model), int(episode), int(model if self.merge == "model_only" else model or episode), count


def _ordered(waiting: str, release: Callable[[StatefulProcessor, str, list[tuple]], pd.DataFrame], states: Callable[[StatefulProcessor, object], None]) -> StatefulProcessor:
    """A processor that holds a service's rows (us, flow_id, ...) until the watermark has passed them, and then gives
    them to `release` in order of (us, flow_id)."""

    class Ordered(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.waiting = handle.getListState("waiting", waiting)
            states(self, handle)

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            for pdf in rows:
                self.waiting.appendList([tuple(None if pd.isna(x) else x for x in r) for r in pdf.drop(columns=["service", "event_time"]).astype(object).itertuples(index=False)])
                self.wake(int(pdf["us"].min()))
            return iter([])

        def wake(self, us: int) -> None:
            """A timer in the first millisecond after the earliest row that waits."""
            self.handle.registerTimer(us // 1000 + 1)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            past = timerValues.getCurrentWatermarkInMs() * 1000
            rows = [tuple(r) for r in self.waiting.get()]
            due = sorted((r for r in rows if r[0] < past), key=lambda r: r[:2])
            if due:
                rest = [r for r in rows if r[0] >= past]
                if rest:
                    self.waiting.put(rest)
                    self.wake(min(rest)[0])
                else:
                    self.waiting.clear()
                yield release(self, key[0], due)

        def close(self) -> None:
            pass

    return Ordered()


def _keyed(flows: DataFrame, watermark: str, *columns) -> DataFrame:
    """(service, event_time, us, flow_id, ...) behind a watermark."""
    us = F.unix_micros("event_time")
    return flows.withWatermark("event_time", watermark).select("service", "event_time", us.alias("us"), "flow_id", *columns)


def memory_stream(flows: DataFrame, threshold: float, size: int = 128, least: float = 0.7, alpha: float = 0.95, top: int = 5, poison: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """STR08/STR09 as a stream over (flow_id, service, event_time, value, score): each service's memory and reputation are
    keyed state, and its flows are folded in order of (event_time, flow_id) once the watermark has passed them, so the rows
    are those of the batch fold whatever the order of arrival within the watermark; later rows, and times up to the epoch, are dropped. State of a
    service: `size` values and the flows that wait. The session needs STATE_STORE."""
    rule = MemoryRule(threshold, size, least, alpha, top)

    def states(self, handle) -> None:
        self.memory, self.trust = handle.getListState("memory", "value double"), handle.getValueState("trust", "trust double")

    def release(self, service: str, due: list[tuple]) -> pd.DataFrame:
        memory = [r[0] for r in self.memory.get()]
        trust = self.trust.get()[0] if self.trust.exists() else 1.0
        out = []
        for _, flow, value, score, forced in due:
            got, admit, memory, trust = rule.step(memory, trust, value, score, forced)
            out.append((flow, service, float(got), int(admit), trust))
        if memory:
            self.memory.put([(float(m),) for m in memory])
        self.trust.update((trust,))
        return pd.DataFrame(out, columns=["flow_id", "service", "memory_score", "admitted", "reputation"])

    forced = F.coalesce(F.col(poison), F.lit(False)) if poison else F.lit(False)
    rows = _keyed(flows, watermark, F.col("value").cast("double").alias("value"), F.col("score").cast("double").alias("score"), forced.alias("forced"))
    made = _ordered("us long, flow_id long, value double, score double, forced boolean", release, states)
    return rows.groupBy("service").transformWithStateInPandas(made, "flow_id long, service string, memory_score double, admitted int, reputation double", "Append", "EventTime")


def monitor_stream(flows: DataFrame, threshold: float, window: float, min_count: int, max_packets: int, min_short: float, min_score: float = 0.0, merge: str = "or", watermark: str = "10 minutes") -> DataFrame:
    """STR05 as a stream over (flow_id, service, event_time, packets, score): the alerts of `windows.service_monitor`, in event-time order
    behind the watermark. State of a service: one row for each time of the window that has flows, and the flows that wait. A null packet
    count is not short, a null score no alert. The session needs STATE_STORE."""
    rule = EpisodeRule(threshold, window, min_count, max_packets, min_short, min_score, merge)

    def states(self, handle) -> None:
        self.recent = handle.getListState("recent", "us long, flows long, short long")

    def release(self, service: str, due: list[tuple]) -> pd.DataFrame:
        recent, out = [tuple(r) for r in self.recent.get()], []
        for us, flow, packets, score in due:
            recent, model, episode, hit, count = rule.step(recent, us, packets, score)
            out.append((flow, service, us / 1e6, model, episode, hit, count))
        self.recent.put(recent)
        return pd.DataFrame(out, columns=["flow_id", "service", "ts", "model_alert", "episode_alert", "hit", "window_count"])

    rows = _keyed(flows, watermark, F.col("packets").cast("long").alias("packets"), F.col("score").cast("double").alias("score"))
    made = _ordered("us long, flow_id long, packets long, score double", release, states)
    return rows.groupBy("service").transformWithStateInPandas(made, "flow_id long, service string, ts double, model_alert int, episode_alert int, hit int, window_count long", "Append", "EventTime")
