"""Scalar expressions over columns; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOr = Column | str


def _c(x: ColumnOr) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: ColumnOr) -> Column:
    """Rounds halves toward positive infinity: floor(x + 0.5)."""
    return F.floor(_c(x) + F.lit(0.5))


def clamp(x: ColumnOr, low, high) -> Column:
    low, high = (v if isinstance(v, Column) else F.lit(v) for v in (low, high))
    return F.greatest(low, F.least(high, _c(x)))


def decibels(x: ColumnOr, least: float = 1e-7) -> Column:
    """20 log10 of an amplitude not below least."""
    return F.lit(20.0) * F.log10(F.greatest(_c(x), F.lit(least)))


def amplitude(db: ColumnOr) -> Column:
    return F.pow(F.lit(10.0), _c(db) / 20)


def score(home: ColumnOr, away: ColumnOr) -> Column:
    return F.struct(_c(home).cast("int").alias("home"), _c(away).cast("int").alias("away"))


def _scored(text: Column, pattern: str) -> Column:
    home, away = (F.regexp_extract(text, pattern, g) for g in (1, 2))
    return F.when((home != "") & (away != ""), score(home, away))


# Forms of a score reading.
STRICT = r"^\s*(\d{1,2})\s*[:\-–—]\s*(\d{1,2})\s*$"
SEPARATED = r"(?<!\d)(\d{1,2})\s*[:\-|]\s*(\d{1,2})(?!\d)"
SPACED = r"^\s*(\d{1,2})\s+(\d{1,2})\s*$"
COMPACT = r"^\s*(\d)(\d)\s*$"
ANYWHERE = r"(\d{1,2})\s*[:\-]\s*(\d{1,2})"


def parse_score(text: ColumnOr) -> Column:
    """The whole text must be a score such as '1:0'; else null."""
    return _scored(_c(text), STRICT)


def read_score(text: ColumnOr, largest: int = 99, compact: bool = False) -> Column:
    """A score in free text: separated, spaced, or two digits if compact is set; null if a side is above largest."""
    plain = F.translate(_c(text), "：−–—", ":---")
    forms = [_scored(plain, SEPARATED), _scored(plain, SPACED)] + ([_scored(plain, COMPACT)] if compact else [])
    found = F.coalesce(*forms)
    return F.when((found["home"] <= largest) & (found["away"] <= largest), found)


def found_score(text: ColumnOr, largest: int = 99) -> Column:
    """The first thing like a score anywhere in a text, inside longer numbers also; null if a side is above largest."""
    found = _scored(_c(text), ANYWHERE)
    return F.when((found["home"] <= largest) & (found["away"] <= largest), found)


def score_only(width: ColumnOr, height: ColumnOr) -> Column:
    """A region of this shape shows a score and no team names, so two digits are a score."""
    return _c(width) / F.greatest(F.lit(1), _c(height)) <= 3.0


def padded_crop(box: ColumnOr, width: ColumnOr, height: ColumnOr, *, pair: bool) -> Column:
    """x0, y0, x1, y1 in the unit square of a text box (x0, y0, x1, y1 in pixels) with room around it; more beside one number of a pair, for a second digit."""
    b, w, h = _c(box), _c(width), _c(height)
    tall = F.greatest(F.lit(1.0), b["y1"] - b["y0"])
    px, py = tall * (0.55 if pair else 0.25), tall * (0.25 if pair else 0.2)
    sides = {"x0": F.greatest(F.lit(0.0), (b["x0"] - px) / w), "y0": F.greatest(F.lit(0.0), (b["y0"] - py) / h), "x1": F.least(F.lit(1.0), (b["x1"] + px) / w), "y1": F.least(F.lit(1.0), (b["y1"] + py) / h)}
    return F.struct(*[v.alias(k) for k, v in sides.items()])


def score_text(s: ColumnOr) -> Column:
    s = _c(s)
    return F.when(s.isNotNull(), F.concat_ws(":", s["home"], s["away"]))


def same_score(a: ColumnOr, b: ColumnOr) -> Column:
    """Null equals nothing."""
    return F.coalesce(_c(a) == _c(b), F.lit(False))


def validate_transition(before: ColumnOr, after: ColumnOr) -> Column:
    """valid: one side by 1; suspicious: one side by 2 or 3; invalid: anything else."""
    a, b = _c(before), _c(after)
    home, away = b["home"] - a["home"], b["away"] - a["away"]
    step = home + away
    return (
        F.when((home < 0) | (away < 0) | (step == 0) | ((home > 0) & (away > 0)), "invalid")
        .when(step == 1, "valid")
        .when(step <= 3, "suspicious")
        .otherwise("invalid")
    )


def frame_rate(text: ColumnOr) -> Column:
    """'25/1' as 25.0; 0 for anything malformed or over zero."""
    parts = F.split(_c(text), "/")
    over = F.coalesce(F.get(parts, F.lit(1)), F.lit("1"))
    return F.coalesce(F.try_divide(F.get(parts, F.lit(0)).try_cast("double"), over.try_cast("double")), F.lit(0.0))


def sane_roi(roi: ColumnOr) -> Column:
    """Clamped into the unit square; null if not finite or too small."""
    r = _c(roi)
    sides = [r[c] for c in ("x", "y", "width", "height")]
    finite = ~F.lit(False)
    for s in sides:
        finite = finite & s.isNotNull() & ~F.isnan(s) & (F.abs(s) < float("inf"))
    x, y = clamp(sides[0], 0.0, 1.0), clamp(sides[1], 0.0, 1.0)
    w, h = clamp(sides[2], F.lit(0.0), 1 - x), clamp(sides[3], F.lit(0.0), 1 - y)
    return F.when(
        finite & (w > 0.001) & (h > 0.001), F.struct(x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))
    )


def roi_pixels(roi: ColumnOr, width: ColumnOr, height: ColumnOr, upscale: float = 1.0) -> Column:
    r, w, h = _c(roi), _c(width), _c(height)
    x, y = F.greatest(F.lit(0), half_up(r["x"] * w)), F.greatest(F.lit(0), half_up(r["y"] * h))
    rw = F.least(w - x, F.greatest(F.lit(2), half_up(r["width"] * w)))
    rh = F.least(h - y, F.greatest(F.lit(2), half_up(r["height"] * h)))
    out = [F.greatest(F.lit(2), half_up(v * upscale)) for v in (rw, rh)]
    names = ("x", "y", "width", "height", "out_width", "out_height")
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(names, (x, y, rw, rh, *out), strict=True)])


def sample_count(start: ColumnOr, end: ColumnOr, interval_ms: ColumnOr) -> Column:
    return F.greatest(F.lit(1), F.ceil((_c(end) - _c(start)) * 1000 / _c(interval_ms)))


def media_clock(t: ColumnOr) -> Column:
    """MM:SS.mmm; milliseconds are rounded by themselves and so can read 1000."""
    t = _c(t)
    return F.format_string("%02d:%02d.%03d", F.floor(t / 60), F.floor(t % 60), half_up((t - F.floor(t)) * 1000))


def clip_file(kind: ColumnOr, index: ColumnOr, t: ColumnOr, vertical: bool = False) -> Column:
    """goal_01_67m14s.mp4"""
    t = F.floor(_c(t))
    return F.format_string(
        "%s_%02d_%dm%02ds%s.mp4", F.lower(_c(kind)), _c(index), F.floor(t / 60), (t % 60).cast("long"), F.lit("_vertical" if vertical else "")
    )


def run_name(path: ColumnOr, at: ColumnOr) -> Column:
    stem = F.regexp_replace(F.regexp_replace(_c(path), r"^.*/", ""), r"\.[^.]+$", "")
    return F.concat(F.regexp_replace(stem, r"[^a-zA-Z0-9_-]+", "_"), F.lit("_"), F.date_format(_c(at), "yyyyMMdd_HHmmss"))


def event_id(n: ColumnOr) -> Column:
    return F.format_string("event_%04d", _c(n))


def crop_width(width: ColumnOr, height: ColumnOr) -> Column:
    """Of a 9:16 crop."""
    w, h = _c(width), _c(height)
    return F.greatest(F.lit(2), F.least(w, F.floor(h * 9 / 16))).cast("int")


def smoothstep(k: ColumnOr) -> Column:
    k = _c(k)
    return k * k * (3 - 2 * k)


def fallback_time(change_t: ColumnOr, duration: ColumnOr, offset: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(_c(change_t) - offset, _c(duration)))


def edge_weight(x: ColumnOr, width: float) -> Column:
    """Below 1 within 6 % of the frame's edges, 0.35 at least."""
    if width <= 0:
        return F.lit(1.0)
    margin = width * 0.06
    near = F.least(_c(x), F.lit(width) - _c(x))
    return F.when(near >= margin, 1.0).otherwise(F.greatest(F.lit(0.35), near / margin))


def manhattan(ax, ay, bx, by) -> Column:
    return F.abs(_c(ax) - _c(bx)) + F.abs(_c(ay) - _c(by))


def iou(a: ColumnOr, b: ColumnOr) -> Column:
    """Of two boxes in centre form; 0 without a union."""
    a, b = _c(a), _c(b)

    def overlap(at: str, side: str) -> Column:
        low = F.greatest(a[at] - a[side] / 2, b[at] - b[side] / 2)
        high = F.least(a[at] + a[side] / 2, b[at] + b[side] / 2)
        return F.greatest(F.lit(0.0), high - low)

    inter = overlap("x", "width") * overlap("y", "height")
    union = a["width"] * a["height"] + b["width"] * b["height"] - inter
    return F.when(union <= 0, 0.0).otherwise(F.try_divide(inter, union))


def letterbox(width: ColumnOr, height: ColumnOr, side: int = 640) -> Column:
    """scale, pad_x, pad_y of a frame fitted into a square."""
    w, h = _c(width), _c(height)
    scale = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    pads = [F.floor((side - F.floor(v * scale)) / 2).cast("int") for v in (w, h)]
    return F.struct(scale.alias("scale"), pads[0].alias("pad_x"), pads[1].alias("pad_y"))


def from_letterbox(box: ColumnOr, letter: ColumnOr, width: ColumnOr, height: ColumnOr) -> Column:
    """A box of the square in source pixels, inside the frame; 1 decimal, confidence 4."""
    b, s = _c(box), _c(letter)
    x = clamp((b["x"] - s["pad_x"]) / s["scale"], F.lit(0.0), _c(width).cast("double"))
    y = clamp((b["y"] - s["pad_y"]) / s["scale"], F.lit(0.0), _c(height).cast("double"))
    sides = (b["width"] / s["scale"], b["height"] / s["scale"])
    names = ("x", "y", "width", "height")
    return F.struct(*[F.round(v, 1).alias(n) for n, v in zip(names, (x, y, *sides), strict=True)], F.round(b["confidence"], 4).alias("confidence"))


def has_prefix(texts: ColumnOr, prefix: str) -> Column:
    return F.exists(_c(texts), lambda t: t.startswith(prefix))


def upper_median(values: ColumnOr) -> Column:
    """The element at place n // 2 of the sorted array."""
    v = F.array_sort(F.filter(_c(values), lambda x: x.isNotNull()))
    return F.get(v, F.floor(F.size(v) / 2).cast("int"))


def upper_median_of(value: str) -> Column:
    """An aggregate: the same of an SQL expression over rows, nulls apart. Partial counts by value, no list of all."""
    return F.expr(f"percentile_disc(0.5D) WITHIN GROUP (ORDER BY {value} DESC)")


def keyword_goal(text: ColumnOr) -> Column:
    """A drawn-out 'goal' or 'gol' in any case."""
    return F.lower(_c(text)).rlike(r"\bg+o+a*l+\b")
