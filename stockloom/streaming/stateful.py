"""Keyed state with timers: a source's health, breaker and alerts (D8, D9, D12, D13), and bounded windows of seen ids.

State lives in RocksDB in the checkpoint folder, so a stream goes on where it ended, on any executor.  A key's rows of one micro-batch are sorted
in its task before they are applied, and held there; across batches they count in the order in which the batches bring them.  Cap a batch by
files (`files_per_batch` of the readers) where a backlog is long."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """State of arbitrary shape needs the RocksDB store; a query keeps the store it was started with, so the setting is put back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


HEALTH = "source_key string, kind string, at timestamp, run_id long, phase string, fails long, status string, breaker string, tripped boolean, cooldown_s long, severity string, message string, opened_at timestamp, raised long"


#: A time that is null sorts after all others.
LAST = 2**62
_TYPES = {"health": "source_key string, fails long, breaker string, until long", "alerts": "source_key string, phase string, opened long, severity string, message string, raised long"}


def _codes(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Each value's number, and the values by number; null is a value."""
    codes, found = pd.factorize(values.astype(object), use_na_sentinel=False)
    return codes, np.array([None if x is None or x != x else x for x in found], dtype=object)


def _begins(groups: np.ndarray) -> np.ndarray:
    """For rows that lie group by group: the index of the first row of each row's group."""
    first = np.append(True, groups[1:] != groups[:-1])
    return np.maximum.accumulate(np.where(first, np.arange(len(groups)), 0))


def _frame(many: int, **columns) -> pd.DataFrame:
    """Rows of HEALTH: times in microseconds (LAST is null), columns that are not given null."""
    times = {k: pd.arrays.IntegerArray(columns[k].astype("int64"), columns[k] == LAST) for k in ("at", "opened_at") if k in columns}
    names = [c.split()[0] for c in HEALTH.split(", ")]
    return pd.DataFrame({n: times[n] if n in times else columns.get(n) for n in names}, index=range(many))


class SourceHealth(StatefulProcessor):
    """A source's runs to one row for each run (`run`), for each breaker whose cooldown ends (`half_open`), and for each alert that opens, is raised
    again or is resolved (`alert_opened`, `alert_raised`, `alert_resolved`).

    A failure lengthens the source's streak, a success ends it.  From `trip` failures in a row the breaker is open, for `base` seconds that double
    with every further failure, at most `most`; a timer makes it half-open.  An origin (source and phase) has one open alert: later failures
    replace its message and are counted, and a success of the phase resolves it.

    The key is a bucket of sources, so that calls to the store and frames are paid for a bucket and not for each source.  Its state lists the sources
    with a streak and the open alerts; its one timer is that of the cooldown that ends first."""

    def __init__(self, degrade: int = 1, down: int = 3, trip: int = 3, base: int = 900, most: int = 86400) -> None:
        self.degrade, self.down, self.trip, self.base, self.most = degrade, down, trip, base, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.health = handle.getListState("health", _TYPES["health"])
        self.alerts = handle.getListState("alerts", _TYPES["alerts"])

    def status(self, fails: np.ndarray) -> np.ndarray:
        return np.where(fails >= self.down, "down", np.where(fails >= self.degrade, "degraded", "healthy")).astype(object)

    @staticmethod
    def _keep(state: ListState, rows: list[tuple]) -> None:
        if rows:
            state.put(rows)
        else:
            state.clear()

    @staticmethod
    def _timer(health: dict) -> int | None:
        """In milliseconds, rounded up."""
        return min((-(-until // 1000) for _, breaker, until in health.values() if breaker == "open" and until < LAST), default=None)

    def _keep_health(self, health: dict, timer: int | None) -> None:
        self._keep(self.health, [(source, *v) for source, v in health.items()])
        if (now := self._timer(health)) != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if now is not None:
                self.handle.registerTimer(now)

    def handleInputRows(self, key, rows, timerValues):
        runs = pd.concat(list(rows), ignore_index=True)
        source, sources = _codes(runs["source_key"])
        at = runs["at_us"].fillna(LAST).to_numpy("int64")
        order = np.lexsort((runs["run_id"].to_numpy(), at, source))
        runs, source, at = runs.take(order), source[order], at[order]
        ok = runs["ok"].eq(True).to_numpy(bool)
        phase, phases = _codes(runs["phase"])
        run = {"run_id": runs["run_id"].to_numpy(), "phase": phases[phase], "severity": runs["severity"].to_numpy(object), "message": runs["message"].to_numpy(object)}
        yield from self._breakers(source, sources, at, ok, run)
        origin = np.argsort(source * len(phases) + phase, kind="stable")
        yield self._alerts((source * len(phases) + phase)[origin], sources[source[origin]], at[origin], ok[origin], {k: v[origin] for k, v in run.items()})

    def _breakers(self, source, sources, at, ok, run):
        """The rows `run` and `half_open` of runs that are sorted by source and time."""
        health = {s: (fails, breaker, until) for s, fails, breaker, until in self.health.get()}
        timer, here, begin = self._timer(health), np.arange(len(at)), _begins(source)
        held = [health.get(s, (0, "closed", LAST)) for s in sources]
        held_fails, held_open, held_until = (np.array(x)[source] for x in ([h[0] for h in held], [h[1] == "open" for h in held], [h[2] for h in held]))
        reset = np.maximum.accumulate(np.where(ok, here, -1))
        fails = np.where(reset >= begin, here - reset, here - begin + 1 + held_fails)
        opened = fails >= self.trip
        cooldown = np.where(opened, np.minimum(self.base * 2.0 ** np.clip(fails - self.trip, 0, 40), self.most), 0).astype("int64")
        until = np.where(opened & (at < LAST), at + cooldown * 1_000_000, LAST)
        before = lambda x, first: np.where(here == begin, first, np.roll(x, 1))
        was_open, was_until, was_fails = before(opened, held_open), before(until, held_until), before(fails, held_fails)
        over = was_open & (was_until < LAST) & (at >= was_until)
        if over.any():
            yield _frame(int(over.sum()), source_key=sources[source[over]], kind="half_open", at=was_until[over], fails=was_fails[over], status=self.status(was_fails[over]), breaker="half_open")
        breaker = np.where(opened, "open", "closed").astype(object)
        yield _frame(len(at), source_key=sources[source], kind="run", at=at, run_id=run["run_id"], phase=run["phase"], fails=fails, status=self.status(fails), breaker=breaker, tripped=opened & (~was_open | over), cooldown_s=cooldown)
        for i in np.flatnonzero(np.append(source[1:] != source[:-1], True)):
            health.pop(sources[source[i]], None)
            if fails[i]:
                health[sources[source[i]]] = (int(fails[i]), breaker[i], int(until[i]))
        self._keep_health(health, timer)

    def _alerts(self, origin, source, at, ok, run):
        """The rows `alert_*` of runs that are sorted by origin and time."""
        alerts = {(s, phase): more for s, phase, *more in self.alerts.get()}
        here, begin = np.arange(len(at)), _begins(origin)
        reset = np.where(here == begin, -1, np.roll(np.maximum.accumulate(np.where(ok, here, -1)), 1))
        first = np.maximum(begin, reset + 1)  # of the runs since the last success
        raised, opened, severity, message = here - first + ~ok, at[first], run["severity"][first], np.where(ok, np.roll(run["message"], 1), run["message"])
        for b in np.unique(begin) if alerts else ():
            if old := alerts.get((source[b], run["phase"][b])):
                spell = slice(b, b + int(np.searchsorted(first[b:], b, side="right")))
                raised[spell] += old[3]
                opened[spell], severity[spell] = old[0], old[1]
                if ok[b]:
                    message[b] = old[2]
        kind = np.where(ok, "alert_resolved", np.where(raised == 1, "alert_opened", "alert_raised")).astype(object)
        told = raised > 0
        for i in np.flatnonzero(np.append(origin[1:] != origin[:-1], True)):
            alerts.pop((source[i], run["phase"][i]), None)
            if not ok[i]:
                alerts[source[i], run["phase"][i]] = (int(opened[i]), severity[i], message[i], int(raised[i]))
        self._keep(self.alerts, [(*k, *v) for k, v in alerts.items()])
        columns = {"source_key": source, "kind": kind, "at": at, "run_id": run["run_id"], "phase": run["phase"], "severity": severity, "message": message, "opened_at": opened, "raised": raised}
        return _frame(int(told.sum()), **{k: v[told] for k, v in columns.items()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        health = {s: (fails, breaker, until) for s, fails, breaker, until in self.health.get()}
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        over = {s: v for s, v in health.items() if v[1] == "open" and -(-v[2] // 1000) <= now}
        if over:
            timer = self._timer(health)
            self._keep_health(health | {s: (fails, "half_open", until) for s, (fails, _, until) in over.items()}, timer)
            fails = np.array([v[0] for v in over.values()])
            yield _frame(len(over), source_key=np.array([*over], dtype=object), kind="half_open", at=np.array([v[2] for v in over.values()]), fails=fails, status=self.status(fails), breaker="half_open")

    def close(self) -> None:
        pass


def source_health(runs: DataFrame, delay: str = "0 seconds", buckets: int = 1024, **limits: int) -> DataFrame:
    """A stream of runs (source_key, run_id, at, phase, ok, severity, message) -> HEALTH.  Timers follow the event time less `delay`.  A stream keeps the
    number of buckets that it began with; a task holds one bucket's runs of a micro-batch."""
    own = runs.select("source_key", "run_id", "at", "phase", "ok", "severity", "message").withWatermark("at", delay)
    keyed = own.withColumns({"at_us": F.unix_micros("at"), "bucket": F.pmod(F.hash("source_key"), F.lit(buckets))})
    out = keyed.groupBy("bucket").transformWithStateInPandas(SourceHealth(**limits), HEALTH.replace("timestamp", "long"), "Append", "EventTime")
    return out.withColumns({c: F.timestamp_micros(c) for c in ("at", "opened_at")})


SEEN = "origin string, order long, id string, seen boolean, held long"


def bounded_window(ids: DataFrame, held: DataFrame | None, cap: int, trim: int | None = None, touch: bool = False) -> DataFrame:
    """A micro-batch of (origin, order, id) -> SEEN and `window`: the ids of an origin in their order, each with whether the window held it already and how many ids the window
    holds afterwards; then a row of each origin with its window alone, which is `held` (origin, window) of the next micro-batch.

    A new id goes to the end of the window.  Beyond `cap` ids the oldest go, down to `trim`.  With `touch` an id that is seen again moves to the end
    (least recently used goes first); without, it keeps its place (first in, first out).  Spark sorts the rows (and spills them), so a task holds one window and
    one Arrow batch."""
    trim = cap if trim is None else trim
    rows = ids.select("origin", "order", "id", F.lit(None).cast("array<string>").alias("window"))
    if held is not None:
        rows = held.select("origin", F.lit(None).cast("long").alias("order"), F.lit(None).cast("string").alias("id"), "window").union(rows)

    def run(batches):
        import pyarrow as pa

        types = [pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.string())]
        pack = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], ["origin", "order", "id", "seen", "held", "window"])
        begun, at, now = False, None, {}
        for batch in batches:
            found = []
            for origin, order, id, window in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or origin != at:
                    if begun:
                        found.append((at, None, None, None, None, list(now)))
                    begun, at, now = True, origin, {}
                if window is not None:
                    now = dict.fromkeys(window)
                    continue
                known = id in now
                if known and touch:
                    del now[id]
                if not known or touch:
                    now[id] = None
                if len(now) > cap:
                    for old in list(now)[: len(now) - trim]:
                        del now[old]
                found.append((origin, order, id, known, len(now), None))
            if found:
                yield pack(found)
        if begun:
            yield pack([(at, None, None, None, None, list(now))])

    return rows.repartition("origin").sortWithinPartitions("origin", F.col("window").isNull(), "order").mapInArrow(run, f"{SEEN}, window array<string>")
