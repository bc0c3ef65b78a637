"""The score state machine, refinement and frame reuse."""

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.config import ScoreConfig
from tidemark.functions import scalars as S
from tidemark.operators import scoreboard as B
from tidemark.schemas import SCORE

CFG = ScoreConfig()


def reads(*spec):
    """'1:0@1,2,3' and 'bad@4' as rows (t, ok, score)."""
    rows = []
    for part in spec:
        shown, _, times = part.partition("@")
        score = None if shown == "bad" else tuple(map(int, shown.split(":")))
        rows += [("m", float(t), score is not None, score) for t in times.split(",")]
    return rows


def states(spark, rows, cfg=CFG, initial=None):
    df = spark.createDataFrame(rows, f"media_id string, t double, ok boolean, score {SCORE}")
    if initial:
        df = df.withColumn("start", S.score(F.lit(initial[0]), F.lit(initial[1])))
    return B.score_states(df, cfg, initial="start" if initial else None).first()


@pytest.mark.parametrize(
    ("spec", "baseline", "changes", "rejected"),
    [
        (["1:0@1,2,3,4"], (1, 0), [], 0),
        (["1:0@1,2,3", "8:0@10", "1:0@11,12"], (1, 0), [], 0),
        (["1:0@1,2,3", "2:0@10,11,12,13"], (1, 0), [("valid", 10, 12)], 0),
        (["1:0@1,2,3", "2:0@10,15,20"], (1, 0), [], 0),
        (["2:1@1,2,3", "1:1@10,11,12"], (2, 1), [], 1),
        (["1:0@1,2,3", "3:0@10,10.5,11"], (1, 0), [("suspicious", 10, 11)], 0),
        (["bad@1,2", "0:0@3", "bad@4", "0:0@5,6"], (0, 0), [], 0),
        (["1:0@1,2,3", "2:0@4", "1:0@5", "2:0@6", "1:0@7,8"], (1, 0), [], 0),
        (["1:1@1,2,3", "2:1@20,21,22", "1:1@60,61,62"], (1, 1), [("valid", 20, 22)], 1),
    ],
)
def test_state_machine(spark, spec, baseline, changes, rejected):
    s = states(spark, reads(*spec))
    assert tuple(s.baseline) == baseline
    assert [(c.validation, c.change_t, c.confirmed_t) for c in s.changes] == changes
    assert len(s.rejected) == rejected


def test_initial_baseline(spark):
    s = states(spark, reads("2:0@10,10.2,10.4"), ScoreConfig(2, 2.0), initial=(1, 0))
    assert [(tuple(c.before), tuple(c.after)) for c in s.changes] == [((1, 0), (2, 0))]
    assert s.baseline_t == 10


@pytest.mark.parametrize(
    ("before", "after", "verdict"),
    [((1, 0), (2, 0), "valid"), ((1, 0), (1, 1), "valid"), ((1, 0), (3, 0), "suspicious"), ((1, 0), (8, 0), "invalid"), ((2, 1), (1, 1), "invalid"), ((1, 0), (0, 1), "invalid"), ((1, 0), (1, 0), "invalid"), ((1, 0), (2, 1), "invalid")],
)
def test_transition(spark, before, after, verdict):
    row = spark.range(1).select(S.validate_transition(S.score(*map(F.lit, before)), S.score(*map(F.lit, after))).alias("v")).first()
    assert row.v == verdict


def plain_machine(rows, cfg):
    """The same rules over a Python list."""
    from tidemark.operators.steps import verdict

    current, recent, out = None, [], []
    for _, t, ok, score in sorted((r for r in rows if r[2]), key=lambda r: r[1]):
        recent = [r for r in recent if t - r[0] <= cfg.window_s] + [(t, score)]
        alike = [r for r in recent if r[1] == score]
        if current == score:
            recent = []
        elif len(alike) >= cfg.reads:
            if current is not None:
                v = verdict(current, score)
                out.append((v, alike[0][0], t))
                score = current if v == "invalid" else score
            current, recent = score, []
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 1), st.booleans()), min_size=1, max_size=40))
def test_fold_equals_plain(spark, spec):
    rows = [("m", float(i), ok, (h, a) if ok else None) for i, (h, a, ok) in enumerate(spec)]
    cfg = ScoreConfig(2, 3.0)
    s = states(spark, rows[::-1], cfg)
    got = [] if s is None else sorted([(c.validation, c.change_t, c.confirmed_t) for c in [*s.changes, *s.rejected]], key=lambda x: x[2])
    assert got == plain_machine(rows, cfg)


def frames(spark, values):
    return spark.createDataFrame([("m", i, [float(v)] * 4) for i, v in enumerate(values)], "media_id string, frame long, signature array<double>")


@pytest.mark.parametrize(
    ("values", "refresh", "burst", "want"),
    [([1, 1, 1, 1], 3, 1, [True, False, False, True]), ([1, 1, 1, 1], 100, 3, [True, True, True, False]), ([1, 9, 9, 9], 100, 1, [True, True, False, False])],
)
def test_change_detector(spark, values, refresh, burst, want):
    d = B.signature_difference(frames(spark, values), ["media_id"])
    got = B.frames_to_read(d, ["media_id"], refresh=refresh, reads=burst).orderBy("frame")
    assert [r.should_read for r in got.collect()] == want


def test_reuse(spark):
    rows = spark.createDataFrame([("m", 0, True, "a"), ("m", 1, False, None), ("m", 2, True, "b"), ("m", 3, False, None)], "media_id string, frame long, should_read boolean, raw string")
    got = B.reused(rows, ["media_id"], ["raw"]).orderBy("frame").collect()
    assert [(r.raw, r.reused) for r in got] == [("a", False), ("a", True), ("b", False), ("b", True)]


def test_refinement(spark):
    media = spark.createDataFrame([("m", 100.0)], "media_id string, duration_s double")
    coarse = reads("0:0@1,2,3", "2:0@10,11,12", "2:1@30,31,32")
    changes = B.score_changes(B.score_states(spark.createDataFrame(coarse, f"media_id string, t double, ok boolean, score {SCORE}"), CFG))
    fine = spark.createDataFrame(
        reads("1:0@8.6,8.8,9.0", "2:0@9.6,9.8,10.0,10.2", "2:0@28.2", "2:1@29.0,29.2,29.4,29.6"), f"media_id string, t double, ok boolean, score {SCORE}"
    )
    windows = B.fine_windows(changes, media, CFG)
    chain = B.resolved(windows, fine, CFG).orderBy("seq", "step").collect()
    assert [(tuple(r.before), tuple(r.after), r.validation) for r in chain] == [((0, 0), (1, 0), "valid"), ((1, 0), (2, 0), "valid"), ((2, 0), (2, 1), "valid")]
    moved = {r.seq: r.change_t for r in B.refined(changes, windows, fine, CFG).collect()}
    assert moved == {0: 10.0, 1: 29.0}


def test_long_ranges_stand_in_few_buckets(spark, monkeypatch):
    from tidemark.config import ScoreConfig
    from tidemark.operators import scoreboard as B

    cfg, widths, join = ScoreConfig(1, 3 * 86400.0, fine_margin_s=21600.0), [], B.range_join
    monkeypatch.setattr(B, "range_join", lambda *a: widths.append(a[-1]) or join(*a))
    score = "struct<home: int, away: int>"
    change = spark.createDataFrame(
        [("a", i, (0, 0), (2, 0) if i else (1, 0), 1e6, 1e6 + 86400, "suspicious" if i else "valid", False, 1e6 - 21600, 1e6 + 108000) for i in range(2)],
        f"media_id string, seq int, before {score}, after {score}, change_t double, confirmed_t double, validation string, refined boolean, lo double, hi double",
    )
    fine = spark.createDataFrame([("a", 1e6 - 9000 + 600 * i, True, (1 + (i > 9), 0)) for i in range(40)], f"media_id string, t double, ok boolean, score {score}")
    chain = [(r.seq, r.step, r.after.home, r.refined) for r in B.resolved(change, fine, cfg).orderBy("seq", "step").collect()]
    moved = {r.seq: (r.change_t, r.refined) for r in B.refined(change.drop("lo", "hi"), change, fine, cfg).collect()}
    assert chain == [(0, 0, 1, False), (1, 0, 1, True), (1, 1, 2, True)] and moved == {0: (1e6 - 9000, True), 1: (1e6, False)}
    assert len(widths) == 2 and all(129600 / w <= 2 for w in widths)
