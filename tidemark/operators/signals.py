"""Signals: union, sessions, classification, event times, dedup, ids, clips."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ClipConfig, EventConfig
from tidemark.functions.scalars import event_id, fallback_time, score_text
from tidemark.operators.folds import spaced
from tidemark.operators.ranges import range_join

_RANK = {"score_change": 0, "audio_spike": 1, "keyword": 2}


def type_rank(column: str = "type") -> Column:
    c = F.col(column)
    out = F.lit(len(_RANK))
    for name, rank in _RANK.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def signal_union(changes: DataFrame, spikes: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """Tagged rows of all signals; at one time score changes come before spikes, and spikes before keywords."""
    parts = [
        changes.where("validation <> 'invalid'").select(
            "media_id", F.lit("score_change").alias("type"), F.col("change_t").alias("t"), score_text("before").alias("score_before"), score_text("after").alias("score_after"), "validation"
        ),
        spikes.select("media_id", F.lit("audio_spike").alias("type"), "t", "delta_db"),
    ]
    if keywords is not None:
        parts.append(keywords.select("media_id", F.lit("keyword").alias("type"), "t", "text"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def clustered(signals: DataFrame, gap: float, *, keys: list[str] | None = None, at: str = "t", order: list[Column | str] | None = None) -> DataFrame:
    """signals with cluster_id (from 1): a signal joins the cluster of the one before it if it is at most gap later."""
    keys = keys or ["media_id"]
    by = Window.partitionBy(*keys).orderBy(*(order or [at, type_rank()]))
    new = F.when(F.col(at) - F.lag(at).over(by) <= gap, 0).otherwise(1)
    return signals.withColumn("_new", new).withColumn("cluster_id", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def classified(rows: DataFrame, cfg: EventConfig, *, keys: list[str] | None = None, at: str = "t", order: list[str] | None = None) -> DataFrame:
    """One row a cluster: GOAL if it holds a score change (its first one counts), else UNKNOWN_INTERESTING; with a confidence.

    With one_event_per_change every score change is an event of its own.
    """
    keys = [*(keys or ["media_id"]), "cluster_id"]
    is_change, is_spike, is_word = (F.col("type") == n for n in ("score_change", "audio_spike", "keyword"))
    if cfg.one_event_per_change:
        by = Window.partitionBy(*keys).orderBy(at, *(order or []))
        part = F.greatest(F.lit(1), F.sum(is_change.cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
        rows, keys = rows.withColumn("part", part), [*keys, "part"]
    first = F.struct(*[F.col(c) for c in [at, *(order or [])]], F.col("score_before").alias("score_before"), F.col("score_after").alias("score_after"), F.col("validation").alias("validation"))
    flat = rows.groupBy(*keys).agg(
        F.min(at).alias("start_t"), F.max(at).alias("end_t"), F.count("*").alias("n_signals"),
        F.bool_or(is_change).alias("score_change"), F.bool_or(is_spike).alias("audio_spike"), F.bool_or(is_word).alias("keyword_goal"),
        F.max(F.when(is_spike, F.col("delta_db"))).alias("best_delta"), F.min(F.when(is_change, first)).alias("_first"),
    )
    goal = (
        F.lit(cfg.weight_score_change)
        + F.when(F.col("audio_spike"), cfg.weight_audio_spike + cfg.weight_agreeing).otherwise(0.0)
        + F.when(F.col("keyword_goal"), cfg.weight_keyword).otherwise(0.0)
        - F.when(F.col("_first.validation") == "valid", 0.0).otherwise(0.1)
    )
    other = F.least(F.lit(0.4), F.lit(0.15) + F.coalesce("best_delta", F.lit(0.0)) / 100)
    return flat.select(
        *keys, "start_t", "end_t", "n_signals",
        F.when(F.col("score_change"), "GOAL").otherwise("UNKNOWN_INTERESTING").alias("type"),
        F.round(F.when(F.col("score_change"), F.greatest(F.lit(0.01), F.least(F.lit(0.99), goal))).otherwise(other), 3).alias("confidence"),
        "score_change", "audio_spike", "keyword_goal",
        F.round(F.when(F.col("score_change"), F.col("best_delta")).otherwise(F.coalesce("best_delta", F.lit(0.0))), 2).alias("audio_delta_db"),
        F.col("_first.score_before").alias("score_before"), F.col("_first.score_after").alias("score_after"),
        F.col(f"_first.{at}").alias("change_t"), F.col("_first.validation").alias("validation"),
    )


def event_times(changes: DataFrame, windows: DataFrame, cfg: EventConfig, *, spike_db: float = 8.0, duration: str = "duration_s", key: list[str] | None = None) -> DataFrame:
    """changes with event_t, peak_t, peak_delta_db and used_fallback.

    The loudest window of the lookback before a change (the first of the largest delta) gives the event, moved to
    the earliest window within onset_db of it; without a window, or with none of spike_db, the event is a fixed time
    before the change. Recordings and buckets of time are the equi-key of the join, the range its residue.
    """
    key = key or ["media_id", "change_t"]
    w = windows.select("media_id", F.col("t").alias("_t"), "delta_db")
    low = F.greatest(F.lit(0.0), F.col("change_t") - cfg.lookback_s)
    near = range_join(changes, w, ["media_id"], low, F.col("change_t"), "_t", cfg.lookback_s).withColumn(
        "_best", F.max("delta_db").over(Window.partitionBy(*key))
    )
    peaks = near.groupBy(*key).agg(
        F.min(F.when(F.col("delta_db") == F.col("_best"), F.col("_t"))).alias("peak_t"),
        F.max("_best").alias("peak_delta_db"),
        F.min(F.when(F.col("delta_db") >= F.col("_best") - cfg.onset_db, F.col("_t"))).alias("_onset"),
    )
    strong = F.coalesce(F.col("peak_delta_db") >= spike_db, F.lit(False))
    return changes.join(peaks, key, "left").select(
        *changes.columns,
        F.when(strong, F.col("_onset")).otherwise(fallback_time("change_t", duration, cfg.fallback_offset_s)).alias("event_t"),
        "peak_t", "peak_delta_db", (~strong).alias("used_fallback"),
    )


def deduplicated(events: DataFrame, cfg: EventConfig, *, keys: list[str], at: str, order: list[str], carry: list[str]) -> DataFrame:
    """Goals of one key at least dedup_s after the one kept before; other events pass."""
    goals = spaced(events.where("type = 'GOAL'"), keys, order, at, cfg.dedup_s, strict=False, carry=carry)
    return goals.unionByName(events.where("type <> 'GOAL'").select(*goals.columns))


def numbered(events: DataFrame, *, key: str = "media_id", order: list[str]) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.withColumn("n", n).withColumn("event_id", event_id("n"))


def clip_window(t: Column | str, duration: Column | str, cfg: ClipConfig) -> Column:
    """start, end and length of a clip around t, inside the recording, at most max_s long and containing t."""
    t, d = (F.col(x) if isinstance(x, str) else x for x in (t, duration))
    start, end = F.greatest(F.lit(0.0), t - cfg.pre_s), F.least(d, t + cfg.post_s)
    long_ = end - start > cfg.max_s
    lead = cfg.max_s * cfg.pre_s / (cfg.pre_s + cfg.post_s) if cfg.pre_s + cfg.post_s > 0 else 0.0
    cut = F.greatest(F.lit(0.0), t - lead)
    cut_end = F.least(d, cut + cfg.max_s)
    start, end = F.when(long_, F.greatest(F.lit(0.0), cut_end - cfg.max_s)).otherwise(start), F.when(long_, cut_end).otherwise(end)
    end = F.least(d, F.greatest(end, start + 0.5))
    start = F.greatest(F.lit(0.0), F.least(start, end - 0.5))
    return F.struct(F.round(start, 3).alias("start"), F.round(end, 3).alias("end"), F.round(end - start, 3).alias("length"))


def clip_rows(events: DataFrame, media: DataFrame, cfg: ClipConfig) -> DataFrame:
    """Events that get a clip, with its window; a clip is valid from 0.2 s to a second over its largest length."""
    wanted = events if cfg.for_unknown else events.where("type = 'GOAL'")
    out = wanted.join(media.select("media_id", "duration_s"), "media_id").withColumn("clip", clip_window("event_t", "duration_s", cfg))
    return out.withColumn("clip_valid", (F.col("clip.length") > 0.2) & (F.col("clip.length") <= cfg.max_s + 1))
