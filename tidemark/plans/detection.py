"""The whole detection of many recordings, as one declared plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import BUILTIN, Config
from tidemark.operators import audio, scoreboard, signals


@dataclass(frozen=True)
class Detection:
    changes: DataFrame
    rejections: DataFrame
    spikes: DataFrame
    clusters: DataFrame
    events: DataFrame


def detect(samples: DataFrame, windows: DataFrame | None, media: DataFrame, cfg: Config = BUILTIN, *, fine: DataFrame | None = None, keywords: DataFrame | None = None, keep_unknown: bool = False) -> Detection:
    """samples: readings; windows: (media_id, w, t, rms), null without audio; fine: readings of a finer scan, to resolve and refine changes.

    Everything is keyed by recording, so the stages share one partitioning by media_id.
    """
    states = scoreboard.score_states(samples, cfg.score)
    changes, rejections = scoreboard.score_changes(states), scoreboard.score_rejections(states)
    if fine is not None:
        ranges = scoreboard.fine_windows(changes, media, cfg.score)
        chains = scoreboard.resolved(ranges, fine, cfg.score)
        by_step = chains.withColumn("seq", F.row_number().over(Window.partitionBy("media_id").orderBy("seq", "step")) - 1).drop("step")
        changes = scoreboard.refined(by_step, scoreboard.fine_windows(by_step, media, cfg.score), fine, cfg.score)
    if windows is None:
        windows = media.sparkSession.createDataFrame([], "media_id string, w bigint, t double, rms double")
    loudness = audio.with_baseline(windows, cfg.audio)
    spikes = audio.spikes(loudness, cfg.audio)
    rows = signals.signal_union(changes, spikes, keywords)
    clusters = signals.classified(signals.clustered(rows, cfg.events.cluster_gap_s), cfg.events, order=[])
    goals = clusters.where("type = 'GOAL'").join(media.select("media_id", "duration_s"), "media_id")
    timed = signals.event_times(goals, loudness, cfg.events, spike_db=cfg.audio.spike_db)
    timed = timed.withColumn("audio_delta_db", F.coalesce(F.round("peak_delta_db", 2), "audio_delta_db"))
    carry = ["type", "confidence", "score_before", "score_after", "validation", "change_t", "audio_spike", "keyword_goal", "audio_delta_db", "used_fallback", "duration_s"]
    # events of one transition are folded in the order of their changes
    kept = signals.deduplicated(timed, cfg.events, keys=["media_id", "score_before", "score_after"], at="event_t", order=["cluster_id"], carry=[c for c in carry if c not in ("score_before", "score_after")])
    if keep_unknown:
        other = clusters.where("type <> 'GOAL'").join(media.select("media_id", "duration_s"), "media_id").withColumn("event_t", F.col("start_t"))
        kept = kept.unionByName(other.select(*[c for c in kept.columns if c in other.columns]), allowMissingColumns=True)
    events = signals.numbered(kept, order=["cluster_id"]).withColumn("clip", signals.clip_window("event_t", "duration_s", cfg.clips))
    return Detection(changes, rejections, spikes, clusters, events)
