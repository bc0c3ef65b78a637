"""Object tracking over detections: boxes, tiles, suppression, and what a camera follows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalars import edge_weight, iou
from tidemark.operators.folds import fold, ordered_rows, scanned
from tidemark.operators.steps import follow_step

FRAME = ["media_id", "frame"]
TARGET = "struct<x: double, y: double, width: double, height: double, confidence: double, kind: string>"


def tile_starts(length: Column, size: int, overlap: float) -> Column:
    """Offsets of tiles along a side; the last is moved back to end at the edge."""
    stride = max(1, int(size * (1 - overlap)))
    n = F.greatest(F.lit(1), F.ceil((length - size) / stride) + 1).cast("int")
    return F.array_distinct(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0), F.least(i * stride, length - size)).cast("int")))


def tiles(frames: DataFrame, *, width: int, height: int, overlap: float) -> DataFrame:
    """frames (with frame_width and frame_height) by tiles: tile_x, tile_y, tile_width, tile_height."""
    down = frames.withColumn("tile_y", F.explode(tile_starts(F.col("frame_height"), height, overlap)))
    return down.withColumn("tile_x", F.explode(tile_starts(F.col("frame_width"), width, overlap))).withColumns(
        {"tile_width": F.least(F.lit(width), F.col("frame_width")), "tile_height": F.least(F.lit(height), F.col("frame_height"))}
    )


def untiled(detections: DataFrame) -> DataFrame:
    """Boxes of tiles in the frame's pixels."""
    return detections.withColumns({"x": F.col("x") + F.col("tile_x"), "y": F.col("y") + F.col("tile_y")})


def overlapping_pairs(boxes: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """keys, a, b (ordinals, a < b) and iou of boxes of a frame that overlap by more than threshold.

    Frames are the equi-key; a frame has few boxes, and no pair leaves its frame.
    """
    keys = keys or FRAME
    box = F.struct("x", "y", "width", "height")
    left = boxes.select(*keys, F.col("ord").alias("a"), box.alias("_a"))
    right = boxes.select(*keys, F.col("ord").alias("b"), box.alias("_b"))
    pairs = left.join(right, keys).where("a < b").withColumn("iou", iou("_a", "_b"))
    return pairs.where(F.col("iou") > threshold).select(*keys, "a", "b", "iou")


def suppressed(boxes: DataFrame, threshold: float, keys: list[str] | None = None) -> DataFrame:
    """Greedy suppression: the most confident box of a frame stays, what overlaps it by more than threshold goes, and so on.

    Ties go to the smaller ordinal (a deliberate choice: a reversed sort elsewhere may take the later one). A fold over each frame's boxes in order of confidence: a box stays if no box that
    stays overlaps it too much.
    """
    keys = keys or FRAME
    ranked = boxes.withColumn("_by", -F.col("confidence"))
    rows = ordered_rows(ranked, keys, ["_by", "ord"], ["x", "y", "width", "height", "confidence"])
    kind = rows.schema["rows"].dataType.simpleString()

    def step(kept: Column, box: Column) -> Column:
        return F.when(F.exists(kept, lambda k: iou(k, box) > threshold), kept).otherwise(F.concat(kept, F.array(box)))

    out = fold("rows", F.expr(f"cast(array() as {kind})"), step)
    return rows.select(*keys, F.explode(out).alias("_b")).select(*keys, *[F.col(f"_b.{c}") for c in ("ord", "x", "y", "width", "height", "confidence")])


def person_clusters(boxes: DataFrame, *, top_k: int = 6, padding: float = 60.0, width: float = 0.0, keys: list[str] | None = None) -> DataFrame:
    """One row a frame: the tallest of the top_k most confident persons, less by the frame's edges, and the padded span of all of them."""
    keys = keys or FRAME
    by = Window.partitionBy(*keys).orderBy(F.desc("confidence"), "ord")
    top = boxes.withColumn("_n", F.row_number().over(by)).where(F.col("_n") <= max(1, top_k))
    weight = edge_weight("x", width)
    best = F.max_by(
        F.struct("x", "y", "height", "confidence"), F.struct((F.col("height") * weight).alias("h"), (F.col("confidence") * weight).alias("c"), (-F.col("_n")).alias("n"))
    )
    low, high = F.min(F.col("x") - F.col("width") / 2) - padding, F.max(F.col("x") + F.col("width") / 2) + padding
    return top.groupBy(*keys).agg(best.alias("_m"), (high - low).alias("_w")).select(
        *keys, F.round("_m.x", 1).alias("x"), F.round("_m.y", 1).alias("y"), F.round(F.greatest(F.lit(1.0), F.col("_w")), 1).alias("width"),
        F.round(F.greatest(F.lit(1.0), F.col("_m.height")), 1).alias("height"), F.round("_m.confidence", 4).alias("confidence"), F.lit("cluster").alias("kind"),
    )


def _jump(a: Column, x: Column, y: Column) -> Column:
    return F.abs(a["x"] - x) + F.abs(a["y"] - y)


def action_target(balls: Column, cluster: Column, last: Column, trust: float, most: Column | float) -> Column:
    """What to follow in a frame: at the start the cluster, else the best ball; later the best trusted ball if near, else the cluster within twice that."""
    ball = F.get(F.filter(balls, lambda b: b["confidence"] >= trust), F.lit(0))
    near_ball = F.coalesce(_jump(ball, last["x"], last["y"]) <= most, F.lit(False))
    near_cluster = F.coalesce(_jump(cluster, last["x"], last["y"]) <= F.lit(2.0) * most, F.lit(False))
    return F.when(last.isNull(), F.coalesce(cluster, ball)).when(near_ball, ball).when(near_cluster, cluster)


def followed(frames: DataFrame, keys: list[str], *, trust: float = 0.05, most: float = 160.0, confirm: int = 2, resync: int = 6) -> DataFrame:
    """keys, t, target (null: lost) of every frame: (t, balls, cluster), by a fold in time order.

    A ball counts once it was linked in `confirm` frames running; a frame without one starts anew. Else the cluster is followed, if within twice the
    gate of what was followed last; after `resync` frames without a target any cluster will do.
    """
    rows = frames.withColumns({"t": F.col("t").cast("double"), "balls": F.col("balls").cast(f"array<{TARGET}>"), "cluster": F.col("cluster").cast(TARGET)})

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        t, balls, cluster = row
        state, target = follow_step(state, balls or [], cluster, trust, most, confirm, resync)
        return state, [(t, target)]

    return scanned(rows, keys, ["t"], ["t", "balls", "cluster"], (None, 0, None, 0), step, f"t double, target {TARGET}")


def paired_numbers(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Each number box with the nearest number to its right on one line: the gap over the mean height, least first."""
    cols = [F.col(c) for c in ("ord", "text", "x", "y", "height", "confidence")]
    left = boxes.select(*keys, F.struct(*cols).alias("l"))
    right = boxes.select(*keys, F.struct(*cols).alias("r"))
    mean = (F.col("l.height") + F.col("r.height")) / 2
    pairs = left.join(right, keys).where((F.col("l.x") < F.col("r.x")) & (F.abs(F.col("l.y") - F.col("r.y")) <= 0.7 * mean))
    gap = F.try_divide(F.col("r.x") - F.col("l.x"), mean)
    found = pairs.withColumn("gap", gap).groupBy(*keys).agg(F.min_by(F.struct("l", "r", "gap"), F.struct("gap", "l.ord", "r.ord")).alias("_p"))
    return found.select(
        *keys, F.col("_p.l.text").alias("home"), F.col("_p.r.text").alias("away"), F.col("_p.gap").alias("gap"),
        F.least("_p.l.confidence", "_p.r.confidence").alias("confidence"),
    )


def detected(frames: DataFrame, detector, schema: str) -> DataFrame:
    """frames through a detector that is loaded once in each worker: detector() gives a function of a pandas frame of rows."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detect = detector()
        for part in parts:
            yield detect(part)

    return frames.mapInPandas(run, schema)


def gate(width: float) -> float:
    """How far a followed point may jump between frames."""
    return max(48.0, 0.15 * width) if width and not math.isnan(width) else 160.0


def scaled(boxes: DataFrame, *, width: float, height: float, frame_width: str = "frame_width", frame_height: str = "frame_height") -> DataFrame:
    """Boxes of a smaller frame in the source's pixels; as they are where the source's size isn't known (0)."""
    sx = F.lit(width) / F.col(frame_width) if width > 0 else F.lit(1.0)
    sy = F.lit(height) / F.col(frame_height) if height > 0 else F.lit(1.0)
    return boxes.withColumns({"x": F.col("x") * sx, "y": F.col("y") * sy, "width": F.col("width") * sx, "height": F.col("height") * sy})


def confident(detections: DataFrame, classes: list[str], least: float) -> DataFrame:
    """Detections of the classes asked for, from least on."""
    return detections.where(F.col("cls").isin(classes) & (F.col("confidence") >= least))


def found_in_tiles(detections: DataFrame, *, classes: list[str], least: float, threshold: float, keys: list[str]) -> DataFrame:
    """Boxes of tiles as boxes of frames: the classes asked for, in the frame's pixels, each object once."""
    return suppressed(untiled(confident(detections, classes, least)), threshold, keys)
