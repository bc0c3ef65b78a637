"""Sources: PCM of WAV files, truth files, listings; sinks: events, metadata, logs, crop commands.

Decoding of video, text recognition and object detection stay outside: their rows (schemas.TABLES) are what these operators start from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalars import frame_rate, media_clock
from tidemark.operators.attempts import checked
from tidemark.sources.pcm import CHUNK, read_pcm

VIDEO = r"(?i)\.(mp4|mkv|mov)$"


def read_wav(spark: SparkSession, path: str, *, chunk: int = CHUNK) -> DataFrame:
    """pcm_chunks of WAV files; a bad file is an error of the run. sources.pcm has other ways."""
    return read_pcm(spark, path, chunk=chunk, mode="FAILFAST").select("media_id", "chunk_idx", "sample_offset", "samples")


def list_videos(spark: SparkSession, path: str) -> DataFrame:
    """path of every video under a folder, in order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("path").rlike(VIDEO)).select("path").orderBy("path")


def probe_attempts(rows: DataFrame, json: str = "probe") -> DataFrame:
    """rows with ok, error and result: a media row out of a prober's JSON (a column of text), of the first video and audio stream.

    Text that is no JSON, a file without a video stream and one without a duration are errors.
    """
    kind = "struct<format: struct<duration: string, format_name: string>, streams: array<struct<codec_type: string, codec_name: string, width: int, height: int, r_frame_rate: string>>>"
    p = F.from_json(json, kind)
    first = lambda name: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == name), F.lit(0))
    video, audio, duration = first("video"), first("audio"), p["format"]["duration"].try_cast("double")
    unread = F.try_parse_json(json).isNull()
    bad = F.when(unread, "not JSON").when(video.isNull(), "no video stream").when(F.coalesce(duration, F.lit(0.0)) <= 0, "no duration")
    media = F.struct(
        F.col("path").alias("media_id"), "path", p["format"]["format_name"].alias("container"), duration.alias("duration_s"), video["width"].alias("width"),
        video["height"].alias("height"), frame_rate(video["r_frame_rate"]).alias("fps"), video["codec_name"].alias("video_codec"), audio["codec_name"].alias("audio_codec"),
        video.isNotNull().alias("has_video"), audio.isNotNull().alias("has_audio"),
    )
    return checked(rows, bad, media)


def probed(rows: DataFrame, json: str = "probe") -> DataFrame:
    """media rows out of a prober's JSON; one bad file is an error of the run. probe_attempts() keeps it as a row."""
    found = probe_attempts(rows, json)
    wrong = F.raise_error(F.concat_ws(": ", "path", "error")).cast(found.schema["result"].dataType)
    return found.select(F.when(F.col("ok"), F.col("result")).otherwise(wrong).alias("r")).select("r.*")


_TRUTH = "video string, duration_seconds double, roi struct<x: int, y: int, width: int, height: int>, events array<struct<type: string, timestamp: double, scoreboard_update: double, score_after: string>>"


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """truth rows of annotation files."""
    docs = spark.read.schema(_TRUTH).option("multiLine", "true").json(path)
    return docs.select(F.col("video").alias("media_id"), F.posexplode("events").alias("idx", "e")).select(
        "media_id", "idx", "e.type", F.col("e.timestamp").alias("t"), "e.scoreboard_update", "e.score_after"
    )


def read_regions(spark: SparkSession, path: str, *, lines: bool = False) -> DataFrame:
    """media_id and region ('x,y,width,height', null if the file names none) of each annotation file, or of each line, as recognition.regions() takes them."""
    docs = spark.read.schema(_TRUTH).option("multiLine", not lines).json(path)
    r = F.col("roi")
    whole = F.concat_ws(",", *[r[c].cast("string") for c in ("x", "y", "width", "height")])
    return docs.select(F.col("video").alias("media_id"), F.when(r.isNotNull(), whole).alias("region"))


def without_truth(media: DataFrame, truth: DataFrame) -> DataFrame:
    return media.join(truth, "media_id", "left_anti")


def ocr_samples_of(readings: DataFrame, *, least_confidence: float = 0.0) -> DataFrame:
    """Raw readings with the parsed score; ok needs a score and enough confidence."""
    from tidemark.functions.scalars import parse_score

    scored = readings.withColumn("score", parse_score("raw"))
    return scored.withColumn("ok", F.coalesce(F.col("ok") & F.col("score").isNotNull() & (F.col("confidence") >= least_confidence), F.lit(False)))


def listed_frames(frames: DataFrame, files: DataFrame) -> DataFrame:
    """A frame list with the files' content; a missing file is a row that isn't ok."""
    return frames.join(files.select("path", "content"), "path", "left").withColumn("ok", F.col("content").isNotNull())


def synthetic_match(spark: SparkSession, media_id: str = "synthetic", seconds: int = 330, *, matches: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Readings each second, loudness windows each 200 ms and the truth of a scripted match with three goals; or of matches (media_id, shift), each later by its shift."""
    matches = (spark.createDataFrame([(media_id, 0.0)], "media_id string, shift double") if matches is None else matches).select("media_id", "shift")
    goals = [(80.0, 83.0, 1, 0), (200.0, 203.0, 1, 1), (300.0, 304.0, 2, 1)]
    home, away = F.lit(0), F.lit(0)
    loud = F.lit(False)
    at = F.col("t") - F.col("shift")
    for goal, shown, h, a in goals:
        home, away = F.when(at >= shown, h).otherwise(home), F.when(at >= shown, a).otherwise(away)
        loud = loud | at.between(goal, goal + 4.5)
    steps = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    samples = matches.withColumn("t", steps(seconds)).withColumn("t", F.col("t").cast("double")).select(
        "media_id", "t", F.lit(True).alias("ok"), F.struct(home.cast("int").alias("home"), away.cast("int").alias("away")).alias("score"), F.lit(0.9).alias("confidence")
    )
    windows = matches.withColumn("w", steps(seconds * 5)).withColumn("t", F.col("w") / 5).select(
        "media_id", "w", "t", ((F.lit(0.06) + F.when(loud, 0.55).otherwise(0.0)) * 32767 / F.sqrt(F.lit(2.0))).alias("rms")
    )
    script = F.array(*[F.struct(F.lit("GOAL").alias("type"), F.lit(g).alias("t"), F.lit(s).alias("scoreboard_update"), F.lit(f"{h}:{a}").alias("score_after")) for g, s, h, a in goals])
    truth = matches.select("media_id", "shift", F.posexplode(script).alias("idx", "e")).select(
        "media_id", "idx", "e.type", (F.col("e.t") + F.col("shift")).alias("t"), (F.col("e.scoreboard_update") + F.col("shift")).alias("scoreboard_update"), "e.score_after"
    )
    return samples, windows, truth


# --- sinks -----------------------------------------------------------------


def write_events(events: DataFrame, path: str) -> None:
    """JSON lines, replaced on a rerun."""
    events.write.mode("overwrite").json(path)


def event_documents(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One JSON document {events: [..]} a recording."""
    fields = [c for c in events.columns if c not in keys]
    listed = F.array_sort(F.collect_list(F.struct(*dict.fromkeys([*order, *fields]))))
    return events.groupBy(*keys).agg(F.to_json(F.struct(listed.alias("events"))).alias("document"))


def error_lines(bad: DataFrame, name: str = "path") -> DataFrame:
    """(t, message) of error rows, at time 0."""
    return bad.select(F.lit(0.0).alias("t"), F.concat(F.lit("ERROR "), F.col(name), F.lit(": "), "error").alias("message"))


def log_lines(rows: DataFrame) -> DataFrame:
    """'[MM:SS.mmm] message' of rows (t, message)."""
    return rows.select(F.concat(F.lit("["), media_clock("t"), F.lit("] "), "message").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
