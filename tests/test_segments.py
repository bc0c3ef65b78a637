"""Folds over segments of a key against a plain fold of the whole key."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import folds, trajectory


def plain_spaced(rows, gap, strict):
    last, kept = None, []
    for t in rows:
        if t is not None and (last is None or (t - last > gap if strict else t - last >= gap)):
            last = t
            kept.append(t)
    return kept


def plain_slew(values, step):
    last, out = None, []
    for v in values:
        last = None if v is None else v if last is None else last + max(-step, min(step, v - last))
        out.append(last)
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40) | st.floats(0, 4), max_size=40), st.sampled_from([0.0, 0.1, 1.5, 7.0]), st.booleans(), st.none() | st.floats(-10, 50))
def test_what_a_segment_does_to_the_time_before_it(times, gap, strict, last):
    import numpy as np

    fits = (lambda a: a > gap) if strict else (lambda a: a >= gap)
    done = folds.kept_function(np.array(times, dtype=float), gap, strict)
    found = next((b for a, b in done if last is None or fits(a - last)), last)
    rows = ([] if last is None else [last]) + times
    kept = plain_spaced(rows, gap, strict)
    assert found == (kept[-1] if kept else None)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(-30, 30) | st.floats(-5, 5) | st.none(), min_size=1, max_size=30), st.sampled_from([0.0, 0.5, 3.0]), st.none() | st.floats(-60, 60))
def test_what_a_segment_does_to_the_limited_value(values, step, last):
    done = trajectory.slew_function(values, step)
    if done["fixed"]:
        found = done["last"]
    else:
        x, xs, ys = done["first"] if last is None else last, done["x"], done["y"]
        below = sum(k <= x for k in xs)
        risen = ys[below - 1] + (x - xs[below - 1])
        found = ys[0] - (xs[0] - x) if not below else risen if below == len(xs) else min(risen, ys[below])
        assert all(b - a > -1e-9 for knots in (xs, ys) for a, b in zip(knots, knots[1:], strict=False))
    wanted = plain_slew(([] if last is None else [last]) + values, step)[-1]
    assert found is wanted is None or found == pytest.approx(wanted, abs=1e-9)


@pytest.mark.parametrize("strict", [True, False])
def test_spaced_over_segments(spark, strict):
    rng = random.Random(4)
    rows = [(k, i, None if rng.random() < 0.02 else float(rng.randrange(300) + i // 4)) for k in (1, 2, None) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, n int, t double")
    got = folds.spaced(df, ["k"], ["n"], "t", 7.0, strict=strict, carry=[], segment=F.floor(F.col("n") / 50))
    found = sorted(((r.k or 0), r.n, r.t) for r in got.collect())
    for k in (1, 2, None):
        assert [t for c, _, t in found if c == (k or 0)] == plain_spaced([t for c, _, t in rows if c == k], 7.0, strict)


def test_slew_over_segments(spark):
    rng = random.Random(5)
    rows = [(k, i, None if rng.random() < 0.003 else rng.uniform(0, 200) if k == "noise" else i * 1.5 + rng.uniform(-3, 3)) for k in ("noise", "track", None) for i in range(1000)]
    df = spark.createDataFrame(rows, "k string, frame int, v double")
    got = trajectory.slew_limited(df, ["k"], value="v", step=2.0, segment=F.floor(F.col("frame") / 64))
    found = {(r.k, r.frame): r.limited for r in got.collect()}
    for k in ("noise", "track", None):
        wanted = plain_slew([v for c, _, v in rows if c == k], 2.0)
        assert [found[k, i] for i in range(1000)] == [w if w is None else pytest.approx(w, abs=1e-9) for w in wanted]


def test_no_array_holds_a_whole_key(spark):
    """The plan groups by key and segment, in one shuffle that both uses share; arrays by key hold a function for each segment."""
    df = spark.range(30_000).selectExpr("1 AS k", "id AS w", "cast(id AS double) AS t")
    out = folds.spaced(df, ["k"], ["w"], "w", 8, strict=True, carry=["t"])
    assert sorted(r.w for r in out.collect()) == list(range(0, 30_000, 9))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ReusedExchange") >= 1


def test_exploded_rows_are_never_broadcast(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import folds, ranges

    few = spark.range(2).selectExpr("id AS m")
    many = few.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("t", F.col("t").cast("double"))
    joined = ranges.range_join(few, many, ["m"], F.lit(3.0), F.lit(5.0), "t", 10.0)
    kept = folds.spaced(many, ["m"], ["t"], "t", 10.0, strict=False, carry=[])
    for df, n in ((joined, 6), (kept, 20)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == n
