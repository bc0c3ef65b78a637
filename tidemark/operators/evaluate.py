"""Accuracy of detected events against annotated truth, and run metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import upper_median_of
from tidemark.operators.ranges import range_join
from tidemark.operators.ranks import order_statistic


def matched(detected: DataFrame, truth: DataFrame, *, keys: list[str], within: float, detected_order: list[str], truth_order: list[str], at: str = "t") -> DataFrame:
    """detected with truth_t and matched: each takes the first truth within reach; a truth counts for the first that took it.

    keys and a bucket of time are the equi-part of the join, the tolerance its residue.
    """
    d = detected.select(*keys, *dict.fromkeys([at, *detected_order]))
    t = truth.select(*keys, F.col(at).alias("_truth"), F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(truth_order)]).alias("_order"))
    near = range_join(d, t, keys, F.col(at) - within, F.col(at) + within, "_truth", 2 * within).where(F.abs(F.col(at) - F.col("_truth")) <= within)
    first = near.groupBy(*keys, *dict.fromkeys([at, *detected_order])).agg(F.min(F.struct("_order", "_truth")).alias("_c"))
    took = Window.partitionBy(*keys, "_c").orderBy(*detected_order)
    wins = first.withColumn("_n", F.row_number().over(took)).select(*keys, *dict.fromkeys([at, *detected_order]), F.col("_c._truth").alias("truth_t"), (F.col("_n") == 1).alias("_won"))
    own = list(dict.fromkeys([*keys, at, *detected_order]))
    return detected.join(wins, own, "left").withColumn("matched", F.coalesce("_won", F.lit(False))).drop("_won")


def accuracy(matches: DataFrame, truth: DataFrame, *, keys: list[str], at: str = "t") -> DataFrame:
    """keys, n_detected, n_truth, n_matched, recall, precision and the upper median of the errors; ratios over nothing are 0."""
    d = matches.groupBy(*keys).agg(
        F.count("*").alias("n_detected"), F.count_if("matched").alias("n_matched"),
        upper_median_of(f"CASE WHEN matched THEN abs({at} - truth_t) END").alias("median_error"),
    )
    t = truth.groupBy(*keys).agg(F.count("*").alias("n_truth"))
    both = d.join(t, keys, "full").fillna(0, ["n_detected", "n_matched", "n_truth"])
    return both.withColumns({
        "recall": F.coalesce(F.try_divide("n_matched", "n_truth"), F.lit(0.0)),
        "precision": F.coalesce(F.try_divide("n_matched", "n_detected"), F.lit(0.0)),
    })


def totals(per_video: DataFrame) -> DataFrame:
    sums = per_video.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_detected", "n_matched", "n_truth")])
    return sums.withColumns({
        "recall": F.coalesce(F.try_divide("n_matched", "n_truth"), F.lit(0.0)),
        "precision": F.coalesce(F.try_divide("n_matched", "n_detected"), F.lit(0.0)),
    })


def duplicates(events: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Events beyond the first of each set of parts."""
    return events.groupBy(*keys).agg((F.count("*") - F.count_distinct(F.struct(*parts))).alias("duplicates"))


def coverage(events: DataFrame, clips: DataFrame, *, keys: list[str], at: str = "t") -> DataFrame:
    """Share of events whose time lies in their clip."""
    both = events.join(clips.select(*keys, "event_id", "start", "end"), [*keys, "event_id"], "left")
    inside = F.coalesce(F.col(at).between(F.col("start"), F.col("end")), F.lit(False))
    return both.groupBy(*keys).agg(F.coalesce(F.try_divide(F.count_if(inside), F.count("*")), F.lit(0.0)).alias("clip_coverage"))


def histogram(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, value ('unknown' for null) and n."""
    return rows.groupBy(*keys, F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))


def scan_metadata(samples: DataFrame) -> DataFrame:
    """One row a recording: counts of readings, seconds of inference, and histograms of engines and providers as maps."""

    def counted(column: str) -> DataFrame:
        h = histogram(samples, ["media_id"], column)
        return h.groupBy("media_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("value", "n")))).alias(f"{column}s"))

    flat = samples.groupBy("media_id").agg(
        F.count("*").alias("samples"), F.count_if("ok").alias("ok"), F.count_if("reused").alias("reused"),
        F.count_if(~F.coalesce("reused", F.lit(False))).alias("inferred"), F.round(F.sum(F.coalesce("inference_s", F.lit(0.0))), 3).alias("inference_s"),
    )
    return flat.join(counted("engine"), "media_id").join(counted("provider"), "media_id")


def noted(notes: DataFrame, keys: list[str], *, note: str = "note", order: list[str]) -> DataFrame:
    """keys and degraded: the distinct notes of each, in the order of their first mention."""
    first = notes.groupBy(*keys, note).agg(F.min(F.struct(*order)).alias("_at"))
    listed = F.array_sort(F.collect_list(F.struct("_at", note)))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x[note]).alias("degraded"))


def run_report(media: DataFrame, samples: DataFrame, spikes: DataFrame, events: DataFrame, notes: DataFrame, *, order: list[str]) -> DataFrame:
    """One row a recording: scan_metadata(), what was found and made, the ordered distinct notes, and all of it as a JSON document.

    events: media_id, type, score_change, clip and clip_vertical (whether there is one), fallback. Recordings without a row in a table count 0.
    """
    made = events.groupBy("media_id").agg(
        F.count_if("score_change").alias("score_changes_detected"), F.count_if(F.col("type") == "GOAL").alias("goal_events_created"),
        F.count_if("clip").alias("clips_created"), F.count_if("clip_vertical").alias("vertical_clips_created"), F.count_if("fallback").alias("vertical_center_fallbacks"),
    )
    loud = spikes.groupBy("media_id").agg(F.count("*").alias("audio_spikes_detected"))
    about = media.select("media_id", F.round("duration_s", 3).alias("duration_seconds"), F.concat_ws("x", "width", "height").alias("video_resolution"))
    flat = about.join(scan_metadata(samples), "media_id", "left").join(loud, "media_id", "left").join(made, "media_id", "left")
    counts = [c for c in flat.columns if c not in (*about.columns, "engines", "providers")]
    flat = flat.fillna(0, counts).join(noted(notes, ["media_id"], order=order), "media_id", "left")
    flat = flat.withColumn("degraded", F.coalesce("degraded", F.array().cast("array<string>")))
    return flat.withColumn("document", F.to_json(F.struct(*flat.columns)))


def summary(matches: DataFrame, truth: DataFrame, extra: DataFrame, *, keys: list[str], at: str = "t") -> DataFrame:
    """One row over all recordings: recall, precision, rate of duplicates, upper median of the errors, coverage by clips of what is right, and the document.

    extra: keys, duplicates, clip_covered and vertical_ok of each recording; ratios over nothing are 0.
    """
    per = accuracy(matches, truth, keys=keys, at=at).join(extra, keys, "left").fillna(0)
    error = order_statistic(matches.where("matched"), [], F.abs(F.col(at) - F.col("truth_t")), out="median")
    sums = per.agg(F.count("*").alias("videos"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_detected", "n_matched", "n_truth", "duplicates", "clip_covered", "vertical_ok")])

    def share(part: str, whole: str):
        return F.coalesce(F.try_divide(part, whole), F.lit(0.0))

    flat = sums.join(error, F.lit(True), "left").select(  # one row by one row at most
        "videos", share("n_matched", "n_truth").alias("goal_recall"), share("n_matched", "n_detected").alias("goal_precision"), share("duplicates", "n_detected").alias("duplicate_rate"),
        F.coalesce("median", F.lit(0.0)).alias("median_timestamp_error_seconds"), share("clip_covered", "n_matched").alias("clip_coverage"), share("vertical_ok", "n_matched").alias("vertical_coverage"),
    )
    return flat.withColumn("document", F.to_json(F.struct(*flat.columns)))
