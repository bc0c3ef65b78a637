"""Readings out of a recogniser's text lines: candidate order, numbers side by side, a second recogniser, regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import read_score, score, score_only
from tidemark.operators.folds import scanned
from tidemark.operators.tracking import paired_numbers


def best_reading(lines: DataFrame, keys: list[str], *, largest: int = 99, width: str = "width", height: str = "height") -> DataFrame:
    """keys, score, confidence, raw of each frame: lines (keys, ord, text, confidence, and the region's width and height).

    Candidates are the lines and, of several, all of them joined with and without spaces at the least confidence; the most
    confident that reads as a score wins, in the order of the lines on ties, joined ones last. Two digits are a score only in a
    region of a score's shape. Without a score the confidence is the largest, 0 without lines.
    """
    listed = F.array_sort(F.collect_list(F.struct("ord", "text", F.col("confidence").cast("double").alias("confidence"))))
    frames = lines.groupBy(*keys).agg(listed.alias("l"), score_only(F.first(width), F.first(height)).alias("only"))
    texts = F.transform("l", lambda x: x["text"])
    least = F.array_min(F.transform("l", lambda x: x["confidence"]))
    joined = F.array(*[F.struct((-least).alias("by"), (F.size("l") + i).alias("at"), F.array_join(texts, gap).alias("text")) for i, gap in enumerate((" ", ""))])
    single = F.transform("l", lambda x, i: F.struct((-x["confidence"]).alias("by"), i.alias("at"), x["text"].alias("text")))
    ordered = F.array_sort(F.when(F.size("l") > 1, F.concat(single, joined)).otherwise(single))
    read = lambda c, only: F.coalesce(read_score(c["text"], largest), F.when(only, read_score(c["text"], largest, compact=True)))
    scored = F.transform(ordered, lambda c: F.struct(read(c, F.col("only")).alias("score"), (-c["by"]).alias("confidence")))
    first = F.get(F.filter(scored, lambda c: c["score"].isNotNull()), F.lit(0))
    most = F.coalesce(F.array_max(F.transform("l", lambda x: x["confidence"])), F.lit(0.0))
    return frames.select(*keys, first.alias("f"), most.alias("most"), F.array_join(texts, " | ").alias("raw")).select(
        *keys, F.col("f.score").alias("score"), F.coalesce("f.confidence", "most").alias("confidence"), "raw"
    )


def recognised(lines: DataFrame, keys: list[str], *, largest: int = 99) -> DataFrame:
    """best_reading(), and where it has no score the nearest two numbers on one line (lines with x, y and the glyphs' glyph_height)."""
    read = best_reading(lines, keys, largest=largest)
    numbers = lines.where(F.col("text").rlike(r"^\d{1,2}$")).where(F.col("text").cast("int") <= largest)
    boxes = numbers.select(*keys, "ord", "text", "x", "y", F.greatest(F.lit(1.0), F.col("glyph_height").cast("double")).alias("height"), "confidence")
    pairs = paired_numbers(boxes, keys).select(*keys, score(F.col("home").cast("int"), F.col("away").cast("int")).alias("_pair"), F.col("confidence").alias("_least"))
    both = read.join(pairs, keys, "left")
    paired = F.col("score").isNull() & F.col("_pair").isNotNull()
    return both.select(*keys, F.coalesce("score", "_pair").alias("score"), F.when(paired, F.col("_least")).otherwise(F.col("confidence")).alias("confidence"), "raw")


def with_fallback(first: DataFrame, second: DataFrame, keys: list[str], *, least_confidence: float = 0.0, tag: str = "fallback") -> DataFrame:
    """first (keys, score, confidence, raw, inference_s, provider), and second's reading where first has no score; engine says which.

    Seconds of both are added up; the provider stays the first one's. ok needs a score and enough confidence.
    """
    other = second.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("score", "confidence", "raw", "inference_s")])
    both = first.join(other, keys, "left")
    missing = F.col("score").isNull() & F.col("_raw").isNotNull()
    pick = lambda c: F.when(missing, F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    out = both.select(
        *keys, pick("score"), pick("confidence"), pick("raw"), F.when(missing, tag).otherwise("first").alias("engine"), "provider",
        F.round(F.when(missing, F.col("inference_s") + F.coalesce("_inference_s", F.lit(0.0))).otherwise(F.col("inference_s")), 6).alias("inference_s"),
    )
    return out.withColumn("ok", F.col("score").isNotNull() & (F.coalesce("confidence", F.lit(0.0)) >= least_confidence))


def regions(videos: DataFrame, truth: DataFrame, default: str | None = None) -> DataFrame:
    """videos (media_id) with the region to read and a warning: the truth file's region before the default one; null and a warning without truth.

    truth: media_id, region; a video that has truth but no region at all is an error of the set.
    """
    known = truth.select("media_id", "region", F.lit(True).alias("_known"))
    both = videos.join(known, "media_id", "left")
    region = F.coalesce("region", F.lit(default).cast("string"))
    checked = F.when(region.isNull(), F.raise_error(F.concat(F.lit("no region for "), "media_id")).cast("string")).otherwise(region)
    return both.select("media_id", F.when(F.col("_known"), checked).alias("region"), F.when(F.col("_known").isNull(), F.concat(F.lit("skipped "), "media_id", F.lit(": no truth"))).alias("warning"))


def calibrated(frames: DataFrame, keys: list[str], order: list[str], *, carry: list[str], expires: int = 600, retry: int = 10) -> DataFrame:
    """keys, carry and use ('crop' or 'layout'), ok, score, confidence: which of two readings of a frame counts.

    frames: crop_ok, crop_score, crop_confidence of reading only where the score was last found, and layout_ok, layout_score, layout_confidence, layout_crops of
    searching the whole region; layout_crops is how many places that search found (1 or 2 can be read alone). A search that finds them calibrates; then crops
    are read until `expires` good readings, after which the region is searched again. A crop that can't be read stands as a failed reading, but
    the first of every `retry` failures in a row searches. A failed search keeps the old places, a good one that finds none forgets them.
    """
    columns = ["crop_ok", "crop_score", "crop_confidence", "layout_ok", "layout_score", "layout_confidence", "layout_crops", *carry]
    fields = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    output = ", ".join([*(f"{c} {fields[c]}" for c in carry), "use string", "ok boolean", f"score {fields['layout_score']}", "confidence double"])

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        places, reads, failures = state
        crop_ok, crop_score, crop_confidence, layout_ok, layout_score, layout_confidence, found, *rest = row
        if places in (1, 2) and reads < expires:
            if crop_ok:
                return (places, reads + 1, 0), [(*rest, "crop", True, crop_score, crop_confidence)]
            failures += 1
            if failures % retry != 1 % retry:
                return (places, reads, failures), [(*rest, "crop", False, None, 0.0)]
        if not layout_ok:
            return (places, 0 if places else reads, failures), [(*rest, "layout", False, None, layout_confidence)]
        state = (found, 0, 0) if found in (1, 2) else (0, reads, failures)
        return state, [(*rest, "layout", True, layout_score, layout_confidence)]

    return scanned(frames, keys, order, columns, (0, 0, 0), step, output)
