"""Live detection: windows of samples that come in pieces, and times of events from two streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ByteType, ShortType

from tidemark.config import AudioConfig, EventConfig
from tidemark.functions.scalars import decibels, fallback_time
from tidemark.operators.audio import window_sums


class WindowSums(StatefulProcessor):
    """Windows of a recording whose samples have all come. What has come of the others waits by window, for ttl_ms after its last piece at most."""

    def __init__(self, samples: int, ttl_ms: int | None, narrow: bool = True):
        self.samples, self.ttl_ms, self.output = samples, ttl_ms, Row("media_id", "w", "sq", "peak")
        self.kind, self.squares = (np.int16, "bigint") if narrow else (np.int32, "double")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parts = handle.getMapState("parts", "w bigint", f"n bigint, sq {self.squares}, peak bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        met: dict[int, tuple[int, int, int]] = {}
        for row in rows:
            if row["samples"]:
                for w, n, sq, peak in zip(*(x.tolist() for x in window_sums(row["sample_offset"], np.array(row["samples"], dtype=self.kind), self.samples)), strict=True):
                    a = met.get(w, (0, 0, 0))
                    met[w] = a[0] + n, a[1] + sq, max(a[2], peak)
        for w, (n, sq, peak) in sorted(met.items()):
            if n < self.samples and self.parts.containsKey((w,)):
                known = self.parts.getValue((w,))
                n, sq, peak = n + known[0], sq + known[1], max(peak, known[2])
            if n < self.samples:
                self.parts.updateValue((w,), (n, sq, peak))
            else:
                self.parts.removeKey((w,))
                yield self.output(*key, w, sq, peak)

    def close(self) -> None:
        pass


def windows_of_chunks(chunks: DataFrame, cfg: AudioConfig, *, ttl_ms: int | None = None) -> DataFrame:
    """A stream of chunks (media_id, sample_offset, samples) as operators.audio.windows_of_chunks() gives its windows, in any order and however cut.

    A window is given out once all its samples have come. ttl_ms: how long, in processing time, an incomplete one is kept; without it, for good.
    """
    n = cfg.window_samples
    kind = chunks.schema["media_id"].dataType.simpleString()
    narrow = isinstance(chunks.schema["samples"].dataType.elementType, (ByteType, ShortType))
    given = chunks.select("media_id", "sample_offset", F.col("samples").cast("array<smallint>" if narrow else "array<int>").alias("samples"))
    sums = given.groupBy("media_id").transformWithState(
        WindowSums(n, ttl_ms, narrow), f"media_id {kind}, w bigint, sq {'bigint' if narrow else 'double'}, peak bigint", "Append", "ProcessingTime" if ttl_ms else "None"
    )
    scale = 32768.0 if cfg.normalize_pcm else 1.0
    rms = F.sqrt(F.col("sq") / n) / scale
    return sums.select(
        "media_id", "w", (F.col("w") * cfg.window_ms / 1000).alias("t"), rms.alias("rms"), decibels(rms).alias("rms_db"), decibels(F.col("peak") / scale).alias("peak_db")
    )


def event_times(
    changes: DataFrame, windows: DataFrame, cfg: EventConfig, *, delay: str, spike_db: float = 8.0, origin: str = "1970-01-01", duration: str = "duration_s", key: list[str] | None = None
) -> DataFrame:
    """Streams of changes and windows as operators.signals.event_times() takes them: changes with event_t, peak_t, peak_delta_db and used_fallback.

    An outer interval join of the streams by recording: a window belongs to a change if it lies at most the lookback before it. Both sides have a watermark of
    `delay`; when it has passed a change, its windows are summed up and it is given out, with the fallback if none came. Times are seconds from
    `origin`. State holds what the watermark hasn't passed. key: the columns that tell changes of a recording apart.
    """
    def moment(t):
        return F.timestamp_micros((F.unix_micros(F.lit(origin).cast("timestamp")) + F.col(t) * 1_000_000).cast("bigint"))

    own = [c for c in changes.columns if c in {"media_id", "change_t", duration, *(key or [])}]
    left = changes.select(*[F.col(c).alias(f"c_{c}") for c in own], moment("change_t").alias("c_at")).withWatermark("c_at", delay)
    right = windows.select(F.col("media_id").alias("w_media"), F.struct(F.col("delta_db").alias("delta"), F.col("t").alias("t")).alias("w"), moment("t").alias("w_at")).withWatermark("w_at", delay)
    reach = F.expr(f"interval {int(cfg.lookback_s * 1_000_000)} microseconds")
    met = left.join(right, (F.col("c_media_id") == F.col("w_media")) & (F.col("w_at") >= F.col("c_at") - reach) & (F.col("w_at") <= F.col("c_at")), "left_outer")
    in_time = F.when((F.col("w.t") >= F.greatest(F.lit(0.0), F.col("c_change_t") - cfg.lookback_s)) & (F.col("w.t") <= F.col("c_change_t")), F.col("w"))
    listed = met.groupBy("c_at", *[f"c_{c}" for c in own]).agg(F.collect_list(in_time).alias("ws"))
    best = F.array_max(F.transform("ws", lambda w: w["delta"]))
    out = listed.select(*[F.col(f"c_{c}").alias(c) for c in own], "ws", best.alias("peak_delta_db"))
    first = lambda fits: F.array_min(F.transform(F.filter("ws", fits), lambda w: w["t"]))
    strong = F.coalesce(F.col("peak_delta_db") >= spike_db, F.lit(False))
    onset = first(lambda w: w["delta"] >= F.col("peak_delta_db") - cfg.onset_db)
    return out.select(
        *own, F.when(strong, onset).otherwise(fallback_time("change_t", duration, cfg.fallback_offset_s)).alias("event_t"),
        first(lambda w: w["delta"] == F.col("peak_delta_db")).alias("peak_t"), "peak_delta_db", (~strong).alias("used_fallback"),
    )
