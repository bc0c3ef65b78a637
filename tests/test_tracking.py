"""Boxes, followed targets, trajectories and scalars."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import TrackConfig
from tidemark.functions import scalars as S
from tidemark.operators import tracking as T
from tidemark.operators import trajectory as J

BOX = "media_id string, frame long, ord long, x double, y double, width double, height double, confidence double"


def boxes(spark, *rows):
    return spark.createDataFrame([("m", 0, i, *map(float, r)) for i, r in enumerate(rows)], BOX)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_suppression(spark):
    b = boxes(spark, (100, 100, 20, 20, 0.9), (102, 101, 20, 20, 0.8), (300, 300, 20, 20, 0.7))
    assert sorted(r.ord for r in T.suppressed(b, 0.5).collect()) == [0, 2]
    assert [(r.a, r.b) for r in T.overlapping_pairs(b, 0.5).collect()] == [(0, 1)]


def test_letterbox(spark):
    letter = S.letterbox(F.lit(1280), F.lit(720))
    got = one(spark, letter)
    assert (got.scale, got.pad_x, got.pad_y) == (0.5, 0, 140)
    box = F.struct(*[F.lit(float(v)).alias(n) for n, v in zip(("x", "y", "width", "height", "confidence"), (320, 180, 10, 10, 0.5), strict=True)])
    back = one(spark, S.from_letterbox(box, letter, F.lit(1280), F.lit(720)))
    assert (back.x, back.y) == (640, 80)


def test_tiles(spark):
    f = spark.createDataFrame([("m", 0, 1280, 720)], "media_id string, frame long, frame_width int, frame_height int")
    t = T.tiles(f, width=640, height=360, overlap=0.0).withColumns({"x": F.lit(320.0), "y": F.lit(180.0)})
    assert sorted((r.x, r.y) for r in T.untiled(t).collect()) == [(320, 180), (320, 540), (960, 180), (960, 540)]


def test_person_cluster(spark):
    b = boxes(spark, (60, 300, 40, 90, 0.9), (140, 300, 80, 250, 0.8), (600, 300, 40, 90, 0.85))
    r = T.person_clusters(b).first()
    assert (r.x, r.height, r.kind) == (140, 250, "cluster")


def _target(x, confidence, kind="ball"):
    return None if x is None else (float(x), 100.0, 10.0, 10.0, confidence, kind)


@pytest.mark.parametrize(
    ("balls", "cluster", "last", "x"),
    [([(100, 0.9)], 1200, None, 1200), ([(1210, 0.8)], 1150, 1200, 1210), ([(1210, 0.1)], 1150, 1200, 1150), ([(100, 0.9)], 1150, 1200, 1150), ([], 5000, 1200, None)],
)
def test_action_target(spark, balls, cluster, last, x):
    row = spark.createDataFrame([([_target(*b) for b in balls], _target(cluster, 0.5, "cluster"), _target(last, 0.5))], f"balls array<{T.TARGET}>, cluster {T.TARGET}, last {T.TARGET}")
    got = row.select(T.action_target(F.col("balls"), F.col("cluster"), F.col("last"), 0.3, 150.0).alias("v")).first().v
    assert (got and got.x) == x


def test_follow(spark):
    frames = [("m", float(t), [_target(b, 0.9)] if b else [], _target(c, 0.5, "cluster")) for t, b, c in [(0, 500, 520), (1, 510, 530), (2, 515, 540), (3, None, 2000), (4, None, 560)]]
    got = T.followed(spark.createDataFrame(frames, f"media_id string, t double, balls array<{T.TARGET}>, cluster {T.TARGET}"), ["media_id"], confirm=2).orderBy("t").collect()
    assert [r.target and (r.target.kind, r.target.x) for r in got] == [("cluster", 520), ("ball", 510), ("ball", 515), None, ("cluster", 560)]


@pytest.mark.parametrize(
    ("text", "compact", "want"),
    [("0-0", False, (0, 0)), ("Score 2 : 1", False, (2, 1)), ("12  3", False, (12, 3)), ("1：0", False, (1, 0)), ("0|1", False, (0, 1)), ("00", True, (0, 0)), ("01", True, (0, 1)), ("45:30", False, None), ("team 1 team 0", False, None), ("100", True, None), ("22", False, None)],
)
def test_read_score(spark, text, compact, want):
    got = one(spark, S.read_score(F.lit(text), 30, compact))
    assert (got and tuple(got)) == want


@pytest.mark.parametrize(("text", "want"), [("1:0", (1, 0)), ("2 - 1", (2, 1)), (" 0:0 ", (0, 0)), ("12:30", (12, 30)), ("AB:CD", None), ("", None), ("123:45", None)])
def test_parse_score(spark, text, want):
    got = one(spark, S.parse_score(F.lit(text)))
    assert (got and tuple(got)) == want


def test_scalars(spark):
    roi = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("x", "y", "width", "height"), v, strict=True)])
    got = one(spark, S.sane_roi(roi(-0.1, 0.9, 0.5, 0.5)))
    assert (got.x, got.y, got.width, round(got.height, 9)) == (0, 0.9, 0.5, 0.1)
    assert one(spark, S.sane_roi(roi(0, 0, 0, 1))) is None
    assert one(spark, S.crop_width(F.lit(1280), F.lit(720))) == 405 and one(spark, S.crop_width(F.lit(1920), F.lit(1080))) == 607
    assert one(spark, S.clip_file(F.lit("GOAL"), F.lit(1), F.lit(434.0), vertical=True)) == "goal_01_7m14s_vertical.mp4"
    assert one(spark, S.half_up(F.lit(-2.5))) == -2
    assert [one(spark, S.frame_rate(F.lit(x))) for x in ("25/1", "25/0", "x", "30")] == [25, 0, 0, 30]
    assert one(spark, S.media_clock(F.lit(61.5))) == "01:01.500"
    assert one(spark, S.upper_median(F.array(*map(F.lit, (1, 2, 3, 4))))) == 3
    assert one(spark, S.roi_pixels(roi(0.5, 0, 0.5, 0.1), F.lit(100), F.lit(50), 2.0)).out_width == 100
    assert one(spark, S.keyword_goal(F.lit("Gooool!"))) and not one(spark, S.keyword_goal(F.lit("go on")))


def held(spark, xs, fps=10, hold=10, recentre=10, centre=500.0):
    rows = spark.createDataFrame([("c", i, None if x is None else float(x)) for i, x in enumerate(xs)], "clip_id string, frame long, v double")
    return [r.held for r in J.held(rows, ["clip_id"], value="v", centre=centre, hold=hold, recentre=recentre).orderBy("frame").collect()]


def test_hold(spark):
    got = held(spark, [None, 100] + [None] * 30)
    assert got[0] == 500 and got[1:12] == [100] * 11 and got[-1] == 500
    assert all(a <= b for a, b in zip(got[11:], got[12:], strict=False))


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 1000), min_size=1, max_size=30), st.integers(1, 200))
def test_slew(spark, xs, step):
    rows = spark.createDataFrame([("c", i, float(x)) for i, x in enumerate(xs)], "clip_id string, frame long, v double")
    got = [r.limited for r in J.slew_limited(rows, ["clip_id"], value="v", step=float(step)).orderBy("frame").collect()]
    want, last = [], None
    for x in xs:
        last = float(x) if last is None else last + max(-step, min(step, x - last))
        want.append(last)
    assert got == want


def trajectory(spark, samples, seconds=10.0, **cfg):
    clips = spark.createDataFrame([("m", "c", 0.0, seconds)], "media_id string, clip_id string, start double, end double")
    rows = spark.createDataFrame([("m", "c", float(t), float(x), k, lost) for t, x, k, lost in samples], "media_id string, clip_id string, t double, x double, kind string, lost boolean")
    return J.trajectories(clips, rows, width=1280, height=720, fps=10.0, cfg=TrackConfig(**cfg)).orderBy("frame").collect()


def test_trajectory(spark):
    got = trajectory(spark, [(t / 2, 100 + 55 * t, "ball", False) for t in range(21)], lead=0.5)
    assert len(got) == 100 and all(0 <= r.x <= 1280 - 405 for r in got)
    assert got[0].x < got[50].x < got[99].x and not got[0].fallback
    lost = trajectory(spark, [(t, 0, "ball", True) for t in range(4)], 3.0)
    assert {r.x for r in lost} == {438} and lost[0].fallback
    fast = trajectory(spark, [(0.0, 100, "ball", False), (0.4, 1200, "ball", False)], pan=0.1)
    assert all(abs(a.x - b.x) <= 0.1 * 1280 / 10 + 1 for a, b in zip(fast, fast[1:], strict=False))


def test_nearest_takes_the_first_of_equals(spark):
    left = spark.createDataFrame([("k", 1, 10.0), ("k", 2, 99.0)], "k string, i long, t double")
    right = spark.createDataFrame([("k", 9.0, "b", 2), ("k", 11.0, "c", 3), ("k", 9.0, "a", 1)], "k string, s double, v string, o long")
    got = J.nearest(left, right, keys=["k"], at="t", other="s", within=1.0, ids=["i"], order=["s", "o"], take=["v"]).orderBy("i").collect()
    assert [r.v for r in got] == ["a", None]


def test_wide_shot(spark):
    rows = lambda balls, widths: spark.createDataFrame([("c", False, "ball", 10.0, 0.9)] * balls + [("c", False, "cluster", float(w), 0.8) for w in widths], "clip_id string, lost boolean, kind string, width double, confidence double")
    assert J.wide_shots(rows(0, [1300, 1250, 1200]), ["clip_id"], 1920.0).first().wide
    assert not J.wide_shots(rows(8, [1400]), ["clip_id"], 1920.0).first().wide


def test_crop_commands(spark):
    rows = spark.createDataFrame([("c", i, 7 * i) for i in range(12)], "clip_id string, frame long, x long")
    got = [r.line for r in J.crop_commands(rows, ["clip_id"], 10.0, 5).orderBy("frame").collect()]
    assert got == ["0.000 crop x 0;", "0.500 crop x 35;", "1.000 crop x 70;", "1.100 crop x 77;"]


def test_paired_numbers(spark):
    rows = [("m", 0, "3", 100.0, 50.0, 20.0, 0.9), ("m", 1, "1", 150.0, 52.0, 20.0, 0.7), ("m", 2, "45", 400.0, 50.0, 20.0, 0.9)]
    got = T.paired_numbers(spark.createDataFrame(rows, "media_id string, ord long, text string, x double, y double, height double, confidence double"), ["media_id"]).first()
    assert (got.home, got.away, got.confidence) == ("3", "1", 0.7)
