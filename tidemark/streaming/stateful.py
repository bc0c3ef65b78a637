"""Streaming forms of the sessions and ordered folds.

Sessions use session_window with a watermark. The folds keep their state by key: rows are sorted by time and fed to the same
step; state is a few numbers, or the reads of the last seconds, however long the stream is.

With late=(column, delay) rows may come out of order, across batches too. They wait in a map state, by second, until the watermark of that
timestamp column has passed their second; an event-time timer then folds them in order, whether or not a further row comes. Rows that
come after that are dropped, as always beyond a watermark. idle ends the state of a key that long after its last row, so keys that
have gone cost nothing; initial gives keys a state to start from. Without late a batch's rows are folded as they come, sorted within the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.config import AudioConfig, ScoreConfig
from tidemark.operators.steps import read_step, score_step


def sessions(events: DataFrame, *, keys: list[str], at: str, gap: str, delay: str, aggregates: list) -> DataFrame:
    """One row a session, once the watermark has passed its end."""
    window = F.session_window(at, gap)
    out = events.withWatermark(at, delay).groupBy(*keys, window.alias("_w")).agg(*aggregates)
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *[c for c in out.columns if c not in (*keys, "_w")])


Late = tuple[str, str] | None
Step = Callable[[tuple, dict], tuple[tuple, list[dict]]]


class OrderedFold(StatefulProcessor):
    """Folds a key's rows in order of time, once the watermark has passed them."""

    def __init__(self, names: list[str], kinds: str, order: list[str], step: Step, start: tuple, state: str, keys: list[str], output: list[str], idle: timedelta | None):
        self.names, self.kinds, self.order, self.step, self.start, self.state, self.keys = names, kinds, order, step, start, state, keys
        self.output, self.idle_ms = Row(*output), idle and int(idle.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.acc = handle.getValueState("acc", self.state)
        self.waiting = handle.getMapState("waiting", "second bigint", f"rows array<struct<{self.kinds}>>")
        self.last = handle.getValueState("last", "ms bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.acc.update(tuple(initialState)[len(self.keys) :])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        new: dict[int, list[tuple]] = {}
        for row in rows:
            if (second := row["_ms"] // 1000) * 1000 + 1000 > passed:
                new.setdefault(second, []).append(tuple(row[c] for c in self.names))
        for second, found in new.items():
            known = self.waiting.getValue((second,))[0] if self.waiting.containsKey((second,)) else []
            self.waiting.updateValue((second,), ([*map(tuple, known), *found],))
            self.handle.registerTimer(second * 1000 + 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """All that is due, in order; the first timer that expires finds it, whichever that is."""
        passed = timerValues.getCurrentWatermarkInMs()
        seconds = [k[0] for k in self.waiting.keys()]
        due = sorted(s for s in seconds if s * 1000 + 1000 <= passed)
        if due:
            rows = [dict(zip(self.names, r, strict=True)) for s in due for r in self.waiting.getValue((s,))[0]]
            acc, out = tuple(self.acc.get()) if self.acc.exists() else self.start, []
            for row in sorted(rows, key=lambda r: [r[c] for c in self.order]):
                acc, made = self.step(acc, row)
                out += [self.output(*key, *m.values()) for m in made]
            self.acc.update(acc)
            for s in due:
                self.waiting.removeKey((s,))
            if self.idle_ms:
                self.last.update((due[-1] * 1000,))
                self.handle.registerTimer(due[-1] * 1000 + self.idle_ms)
            return iter(out)
        if self.idle_ms and not seconds and self.last.exists() and self.last.get()[0] + self.idle_ms <= passed:
            self.acc.clear()
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def _folded(
    rows: DataFrame, keys: list[str], order: list[str], step: Step, start: tuple, output: str, state: str, late: Late = None, idle: timedelta | None = None, initial: DataFrame | None = None
) -> DataFrame:
    """Runs step over each key's rows in order, with state between batches. initial: keys and the fields of state."""
    names = [f.strip().split()[0].strip("`") for f in output.split(",")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        acc = held.get if held.exists else start
        batch = pd.concat(list(parts), ignore_index=True).sort_values(order, kind="stable")
        out = []
        for row in batch.to_dict("records"):
            acc, made = step(acc, row)
            out += [dict(zip(keys, key, strict=True)) | m for m in made]
        held.update(acc)
        yield pd.DataFrame(out, columns=names)

    if late is None:
        if idle or initial is not None:
            raise ValueError("idle and initial need a watermark: late")
        return rows.groupBy(*keys).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)
    at, delay = late
    own = [f for f in rows.schema.fields if f.name not in (*keys, at)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    timed = rows.withColumn("_ms", F.unix_millis(at)).withWatermark(at, delay).groupBy(*keys)
    fold = OrderedFold([f.name for f in own], kinds, order, step, start, state, keys, names, idle)
    return timed.transformWithState(fold, output, "Append", "EventTime", None if initial is None else initial.groupBy(*keys))


def cooled(spikes: DataFrame, cfg: AudioConfig, late: Late = None, **ends) -> DataFrame:
    """Loud windows (media_id, w, t, delta_db, rms_db) as spikes: more than the cooldown after the one before."""

    def step(acc: tuple, row: dict) -> tuple[tuple, list[dict]]:
        (last,) = acc
        if last is not None and row["w"] - last <= cfg.cooldown_windows:
            return acc, []
        return (int(row["w"]),), [{c: row[c] for c in ("w", "t", "delta_db", "rms_db")}]

    return _folded(spikes, ["media_id"], ["w"], step, (None,), "media_id string, w long, t double, delta_db double, rms_db double", "last long", late, **ends)


def deduplicated(events: DataFrame, within: float, keys: list[str], key_schema: str, late: Late = None, **ends) -> DataFrame:
    """Events (keys, t) at least `within` after the one kept before."""

    def step(acc: tuple, row: dict) -> tuple[tuple, list[dict]]:
        (last,) = acc
        if last is not None and row["t"] - last < within:
            return acc, []
        return (float(row["t"]),), [{"t": row["t"]}]

    return _folded(events, keys, ["t"], step, (None,), f"{key_schema}, t double", "last double", late, **ends)


def slew_limited(rows: DataFrame, step_size: float, late: Late = None, **ends) -> DataFrame:
    """(key, frame, value) with limited: at most step_size from the one before."""

    def step(acc: tuple, row: dict) -> tuple[tuple, list[dict]]:
        (last,) = acc
        x = float(row["value"]) if last is None else last + max(-step_size, min(step_size, row["value"] - last))
        return (x,), [{"frame": row["frame"], "limited": x}]

    return _folded(rows, ["key"], ["frame"], step, (None,), "key string, frame long, limited double", "last double", late, **ends)


def score_changes(samples: DataFrame, cfg: ScoreConfig, late: Late = None, **ends) -> DataFrame:
    """Readable samples (media_id, t, home, away) as changes and rejections, as they are confirmed."""

    def step(acc: tuple, row: dict) -> tuple[tuple, list[dict]]:
        home, away, times, homes, aways = acc
        current, reads = None if home is None else (home, away), [(t, (h, a)) for t, h, a in zip(times, homes, aways, strict=True)]
        current, reads, found = score_step(cfg, current, reads, float(row["t"]), (int(row["home"]), int(row["away"])))
        state = (*(current or (None, None)), [r[0] for r in reads], [r[1][0] for r in reads], [r[1][1] for r in reads])
        if not found or found[0] == "baseline":
            return state, []
        _, before, after, change_t, confirmed_t, validation = found
        return state, [{"before": "%d:%d" % before, "after": "%d:%d" % after, "change_t": change_t, "confirmed_t": confirmed_t, "validation": validation}]

    output = "media_id string, before string, after string, change_t double, confirmed_t double, validation string"
    state = "home int, away int, times array<double>, homes array<int>, aways array<int>"
    return _folded(samples, ["media_id"], ["t"], step, (None, None, [], [], []), output, state, late, **ends)


def frames_to_read(frames: DataFrame, *, threshold: float = 2.0, refresh: int = 3, reads: int = 1, late: Late = None, **ends) -> DataFrame:
    """(media_id, frame, difference) with should_read."""

    def step(acc: tuple, row: dict) -> tuple[tuple, list[dict]]:
        frame, difference = int(row["frame"]), row["difference"]
        difference = None if difference is None or difference != difference else difference
        last, burst, read = read_step(*acc, frame, difference, threshold, refresh, reads)
        return (last, burst), [{"frame": frame, "should_read": read}]

    return _folded(frames, ["media_id"], ["frame"], step, (None, 0), "media_id string, frame long, should_read boolean", "last long, burst int", late, **ends)
