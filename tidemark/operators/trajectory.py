"""Crop trajectories out of track samples."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import TrackConfig
from tidemark.functions.scalars import clamp, half_up, smoothstep, upper_median_of
from tidemark.operators.folds import segmented


def tolerance(sample_fps: float) -> float:
    return max(0.6, 4 * (1 / max(0.5, sample_fps) / 2 + 0.05))


def nearest(left: DataFrame, right: DataFrame, *, keys: list[str], at: str, other: str, within: float, ids: list[str], order: list[str], take: list[str], bucket: float | None = None) -> DataFrame:
    """left with take of the row of right nearest in time, at most `within` away; ties go to the first in order; null without one.

    Both sides are cut into buckets of time; a row of right stands in the buckets that it can reach, so
    the join is an equi-join on keys and bucket however long a recording is.
    """
    width = bucket or max(2 * within, 1e-6)
    sides = [*keys, "_bucket"]
    reach = F.sequence(F.floor((F.col(other) - within) / width), F.floor((F.col(other) + within) / width))
    r = right.select(*keys, F.col(other).alias("_other"), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(order)], *[F.col(c).alias(f"_t_{c}") for c in take], F.explode(reach).alias("_bucket"))
    away = F.abs(F.col(at) - F.col("_other"))
    ranks = F.struct(away.alias("d"), *[F.col(f"_o{i}") for i in range(len(order))])
    found = (
        left.withColumn("_bucket", F.floor(F.col(at) / width)).join(r, sides).where(away <= within)
        .groupBy(*keys, *ids).agg(F.min_by(F.struct(*[F.col(f"_t_{c}").alias(c) for c in take], away.alias("distance")), ranks).alias("_n"))
    )
    return left.join(found, [*keys, *ids], "left").select(*left.columns, *[F.col(f"_n.{c}").alias(c) for c in take], F.col("_n.distance").alias("distance"))


def clip_frames(clips: DataFrame, fps: float) -> DataFrame:
    """Each clip's frames with the time of their middle."""
    n = F.greatest(F.lit(1), half_up((F.col("end") - F.col("start")) * fps))
    return clips.withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), n - 1))).withColumn("frame_t", F.col("start") + (F.col("frame") + 0.5) / fps)


def crop_x(x: Column, kind: Column, width: float, crop: int, lead: float) -> Column:
    """Left edge of the crop: a cluster in its middle, a ball with room ahead toward the nearer half."""
    centred = x - crop / 2
    led = x - crop * F.when(x >= width / 2, lead).otherwise(1 - lead)
    return clamp(F.when(kind == "cluster", centred).otherwise(led), 0.0, float(max(0.0, width - crop)))


def held(frames: DataFrame, keys: list[str], *, value: str, centre: float, hold: int, recentre: int, order: str = "frame") -> DataFrame:
    """frames with value where known; then kept for `hold` frames, eased to the centre over `recentre`, and left there; the centre before the first."""
    by = Window.partitionBy(*keys).orderBy(order)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(value, ignorenulls=True).over(so_far)
    n = F.row_number().over(by)
    known_at = F.last(F.when(F.col(value).isNotNull(), F.col("_n")), ignorenulls=True).over(so_far)
    rows = frames.withColumn("_n", n).withColumns({"_last": last, "age": F.col("_n") - known_at})
    k = F.least(F.lit(1.0), (F.col("age") - hold) / max(1, recentre))
    eased = F.when(F.col("age").isNull(), centre).when(F.col("age") <= hold, F.col("_last")).otherwise(F.col("_last") + (F.lit(centre) - F.col("_last")) * smoothstep(k))
    return rows.withColumn("held", eased.cast("double")).drop("_n", "_last")


def smoothed(frames: DataFrame, keys: list[str], *, value: str, radius: int, order: str = "frame", out: str = "smooth") -> DataFrame:
    """Centred moving average, cut off at the ends."""
    return frames.withColumn(out, F.avg(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(-radius, radius)))


def slew_function(values: list[float | None], step: float) -> dict:
    """What a segment does to the limited value before it.

    A value moves the one before it toward itself by at most step, which is a continuous function of slopes 1, 0 and 1; so the segment's is piecewise
    linear, of slopes 0 and 1, and is kept as its knots (x, y). Each value flattens what lies within step of it to one piece. After a missing
    value nothing is left of the one before: then the knots are null, and last is what leaves. first: the value that starts a key.
    """
    xs: list[float] = []
    ys: list[float] = []
    fixed, last = False, None
    for v in values:
        if v is None or v != v:
            fixed, last = True, None
        elif fixed:
            last = v if last is None else last + max(-step, min(step, v - last))
        elif not xs:
            xs, ys = [v - step, v + step], [v, v]
        else:
            low, high = v - step, v + step
            i, j = bisect_left(ys, low), bisect_right(ys, high)
            at = [_crossing(xs, ys, i, low), _crossing(xs, ys, j, high)]
            xs, ys = [*xs[:i], *at, *xs[j:]], [*(y + step for y in ys[:i]), v, v, *(y - step for y in ys[j:])]
    return {"first": values[0] if values else None, "fixed": fixed, "last": last, "x": None if fixed else xs, "y": None if fixed else ys}


def _crossing(xs: list[float], ys: list[float], i: int, level: float) -> float:
    """The x where the function reaches a level that lies between knots i - 1 and i."""
    return xs[i - 1] + (level - ys[i - 1]) if i else xs[0] - (ys[0] - level)


def slew_limited(frames: DataFrame, keys: list[str], *, value: str, step: float, order: str = "frame", segment: Column | None = None) -> DataFrame:
    """keys, order and limited: each value at most step from the limited one before it; none of a missing value, after which the next starts anew. segment: see folds.segmented(); 4096 frames by default."""
    kind = frames.schema[order].dataType.simpleString()
    function_kind = "struct<first: double, fixed: boolean, last: double, x: array<double>, y: array<double>>"

    @F.pandas_udf(function_kind)
    def function(rows: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([slew_function([None if v is None or v != v else float(v) for v in x], step) for x in rows], columns=["first", "fixed", "last", "x", "y"])

    def leaves(last: Column, done: Column) -> Column:
        x = F.coalesce(last, done["first"])
        below = F.size(F.filter(done["x"], lambda k: k <= x))
        at = lambda c, i: F.get(done[c], i)
        risen = at("y", below - 1) + (x - at("x", below - 1))
        inside = F.when(below == 0, at("y", F.lit(0)) - (at("x", F.lit(0)) - x)).when(below == F.size(done["x"]), risen).otherwise(F.least(risen, at("y", below)))
        return F.when(done["fixed"], done["last"]).otherwise(inside)

    def one(state: Column, row: Column) -> tuple[Column, Column, Column]:
        v = row[value].cast("double")
        x = F.when(v.isNotNull(), F.coalesce(state["last"] + clamp(v - state["last"], -step, step), v))
        return F.struct(x.alias("last")), F.lit(True), F.struct(row[order].alias(order), x.alias("limited"))

    segment = F.floor(F.col(order) / 4096) if segment is None else segment
    values = lambda rows: function(F.transform(rows, lambda r: r[value].cast("double")))
    return segmented(frames, keys, [order], [value], segment.cast("bigint"), values, leaves, one, f"struct<`{order}`: {kind}, limited: double>")


def trajectories(clips: DataFrame, samples: DataFrame, *, width: int, height: int, fps: float, cfg: TrackConfig) -> DataFrame:
    """media_id, clip_id, frame, x of every frame of clips (media_id, clip_id, start, end); fallback: the clip has no tracked sample."""
    crop = max(2, min(width, height * 9 // 16))
    keys = ["media_id", "clip_id"]
    tracked = samples.where("NOT lost").withColumn("crop_x", crop_x(F.col("x"), F.col("kind"), width, crop, cfg.lead))
    seen = nearest(clip_frames(clips, fps), tracked, keys=keys, at="frame_t", other="t", within=tolerance(cfg.fps), ids=["frame"], order=["t"], take=["crop_x"])
    centre = (width - crop) / 2
    rows = held(seen, keys, value="crop_x", centre=centre, hold=int(cfg.hold_s * fps + 0.5), recentre=max(1, int(cfg.recenter_s * fps + 0.5)))
    smooth = smoothed(rows, keys, value="held", radius=int(cfg.smoothing_s * fps / 2))
    limited = slew_limited(smooth, keys, value="smooth", step=cfg.pan * width / fps)
    none = samples.groupBy(*keys).agg(F.bool_and("lost").alias("_lost"))
    return limited.join(none, keys, "left").select(*keys, "frame", half_up(clamp("limited", 0.0, float(width - crop))).cast("int").alias("x"), F.coalesce("_lost", F.lit(True)).alias("fallback"))


def crop_commands(frames: DataFrame, keys: list[str], fps: float, every: int) -> DataFrame:
    """'time crop x N;' lines of every `every`-th frame and the last."""
    last = F.max("frame").over(Window.partitionBy(*keys))
    picked = frames.withColumn("_last", last).where((F.col("frame") % every == 0) | (F.col("frame") == F.col("_last")))
    return picked.select(*keys, "frame", F.format_string("%.3f crop x %d;", F.col("frame") / F.lit(float(fps)), F.col("x")).alias("line"))


def wide_shots(samples: DataFrame, keys: list[str], width: float) -> DataFrame:
    """keys and wide: few balls among the tracked samples, and clusters whose upper median width is half the frame."""
    tracked = ~F.col("lost")
    ball = tracked & (F.col("kind") == "ball")
    stats = samples.groupBy(*keys).agg(
        F.count_if(tracked).alias("tracked"), F.count_if(ball).alias("balls"), upper_median_of("CASE WHEN NOT lost AND kind = 'cluster' THEN width END").alias("_w"),
        F.coalesce(F.round(F.avg(F.when(tracked, F.col("confidence"))), 4), F.lit(0.0)).alias("mean_confidence"), F.count("*").alias("sampled"), F.count_if("lost").alias("lost"),
    )
    few = F.col("balls") < F.greatest(F.lit(2), F.ceil(F.col("tracked") * 0.1))
    return stats.withColumn("wide", F.coalesce((F.col("tracked") > 0) & few & (F.col("_w") >= width / 2), F.lit(False))).drop("_w")
