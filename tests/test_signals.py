"""Audio, clusters, event times, dedup, clips and the whole detection."""

import math

import pytest
from pyspark.sql import functions as F

from tidemark.config import BUILTIN, SHIPPED, AudioConfig, ClipConfig, EventConfig, configured, load, merge
from tidemark.operators import audio as A
from tidemark.operators import evaluate as E
from tidemark.operators import signals as G
from tidemark.plans.detection import detect
from tidemark.sources.media import synthetic_match

SIGNALS = "media_id string, type string, t double, score_before string, score_after string, validation string, delta_db double, text string"


def loud_windows(spark, seconds, base, loud):
    """RMS windows of a tone of amplitude base, with (from, to, amplitude) stretches."""
    rows = []
    for w in range(int(seconds * 5)):
        t = w / 5
        a = next((x for lo, hi, x in loud if lo <= t < hi), base)
        rows.append(("m", w, t, a * 32767 / math.sqrt(2)))
    return spark.createDataFrame(rows, "media_id string, w long, t double, rms double")


@pytest.mark.parametrize(
    ("seconds", "base", "loud", "check"),
    [
        (50, 0.03, [(40, 42, 0.6)], lambda s: 39.5 <= s[0].t <= 40.5 and s[0].delta_db >= 8),
        (30, 0.5, [], lambda s: not s),
        (50, 0.03, [(40, 41.5, 0.6)], lambda s: len([x for x in s if 39 <= x.t <= 43]) <= 2),
        (50, 0.03, [(40, 41, 0.6), (46, 47, 0.6)], lambda s: len([x for x in s if 39 <= x.t <= 49]) >= 2),
    ],
)
def test_spikes(spark, seconds, base, loud, check):
    cfg = AudioConfig()
    got = A.spikes(A.with_baseline(loud_windows(spark, seconds, base, loud), cfg), cfg).orderBy("w").collect()
    assert check(got)
    assert all(b.w - a.w > cfg.cooldown_windows for a, b in zip(got, got[1:], strict=False))


def test_windows_of_chunks(spark):
    samples = [(i * 37) % 2001 - 1000 for i in range(1000)]
    cfg = AudioConfig(rate=1000, window_ms=150)
    chunks = spark.createDataFrame([("m", i, a, samples[a : a + 230]) for i, a in enumerate(range(0, 1000, 230))], "media_id string, chunk_idx long, sample_offset long, samples array<smallint>")
    got = A.windows_of_chunks(chunks, cfg).orderBy("w").collect()
    assert len(got) == 6  # the trailing part is dropped
    for r in got:
        part = samples[r.w * 150 : (r.w + 1) * 150]
        assert r.rms == pytest.approx(math.sqrt(sum(x * x for x in part) / 150))
        assert r.peak_db == pytest.approx(20 * math.log10(max(map(abs, part))))


def test_clusters(spark):
    rows = spark.createDataFrame([("m", "audio_spike", 4032.1, None, None, None, 13.8, None), ("m", "score_change", 4038.0, "1:0", "2:0", "valid", None, None), ("m", "audio_spike", 4100.0, None, None, None, 12.0, None)], SIGNALS)
    got = G.classified(G.clustered(rows, 8.0), EventConfig()).orderBy("cluster_id").collect()
    assert [(r.n_signals, r.type, r.confidence) for r in got] == [(2, "GOAL", 0.9), (1, "UNKNOWN_INTERESTING", 0.27)]
    exact = spark.createDataFrame([("m", "audio_spike", 0.0, None, None, None, 9.0, None), ("m", "audio_spike", 8.0, None, None, None, 9.0, None)], SIGNALS)
    assert G.clustered(exact, 8.0).select("cluster_id").distinct().count() == 1


def test_one_event_per_change(spark):
    rows = spark.createDataFrame([("m", "score_change", 10.0, "0:0", "1:0", "valid", None, None), ("m", "score_change", 15.0, "1:0", "2:0", "valid", None, None)], SIGNALS)
    assert G.classified(G.clustered(rows, 8.0), EventConfig()).count() == 1
    assert G.classified(G.clustered(rows, 8.0), EventConfig(one_event_per_change=True)).count() == 2


@pytest.mark.parametrize(
    ("windows", "event", "fallback"),
    [
        ([(4010, -30, 0.0), (4032.2, -18, 12.0), (4034, -17.5, 13.0), (4036, -25, 3.0), (4038, -28, 0.0)], 4032.2, False),
        ([(4000, -5, 20.0), (4030, -20, 9.0), (4038, -28, 0.0)], 4030.0, False),
        ([(4030, -40, 1.0), (4036, -40, 0.5)], 4034.0, True),
        ([], 4034.0, True),
    ],
)
def test_event_times(spark, windows, event, fallback):
    change = spark.createDataFrame([("m", 4038.0, 5524.0)], "media_id string, change_t double, duration_s double")
    w = spark.createDataFrame([("m", float(t), float(d)) for t, _, d in windows], "media_id string, t double, delta_db double")
    r = G.event_times(change, w, EventConfig()).first()
    assert (r.event_t, r.used_fallback) == (event, fallback)


@pytest.mark.parametrize(
    ("rows", "kept"),
    [([("1:0", "2:0", 100.0), ("1:0", "2:0", 108.0), ("1:0", "2:0", 130.0)], [100, 130]), ([("1:0", "2:0", 100.0), ("2:0", "2:1", 105.0)], [100, 105]), ([("1:0", "2:0", 100.0), ("1:0", "2:0", 121.0)], [100, 121])],
)
def test_dedup(spark, rows, kept):
    df = spark.createDataFrame([("m", "GOAL", *r) for r in rows], "media_id string, type string, score_before string, score_after string, event_t double")
    got = G.deduplicated(df, EventConfig(), keys=["media_id", "score_before", "score_after"], at="event_t", order=["event_t"], carry=["type"])
    assert sorted(r.event_t for r in got.collect()) == kept


@pytest.mark.parametrize(
    ("t", "duration", "cfg", "start", "end"),
    [(4034.2, 5524.0, ClipConfig(), 4020.2, 4046.2), (5.0, 5524.0, ClipConfig(), 0.0, 17.0), (5520.0, 5524.0, ClipConfig(), 5506.0, 5524.0), (100.0, 500.0, ClipConfig(20, 20, 30), 85.0, 115.0)],
)
def test_clips(spark, t, duration, cfg, start, end):
    c = spark.range(1).select(G.clip_window(F.lit(t), F.lit(duration), cfg).alias("c")).first().c
    assert (c.start, c.end) == (start, end)


@pytest.mark.parametrize("t", [0.0, 1.0, 80.0, 99.0, 100.0])
def test_clip_holds_its_event(spark, t):
    c = spark.range(1).select(G.clip_window(F.lit(t), F.lit(100.0), ClipConfig(max_s=5.0)).alias("c")).first().c
    assert c.start <= t <= c.end and 0 < c.length <= 5


def test_whole_detection(spark):
    samples, windows, truth = synthetic_match(spark)
    media = spark.createDataFrame([("synthetic", 330.0)], "media_id string, duration_s double")
    d = detect(samples, windows, media)
    got = d.events.orderBy("event_id").collect()
    assert [(r.score_before, r.score_after) for r in got] == [("0:0", "1:0"), ("1:0", "1:1"), ("1:1", "2:1")]
    want = [r.t for r in truth.orderBy("t").collect()]
    assert all(abs(r.event_t - t) <= 3 and r.clip.start <= t <= r.clip.end for r, t in zip(got, want, strict=True))
    found = E.matched(d.events.withColumn("t", F.col("event_t")), truth, keys=["media_id"], within=10.0, detected_order=["t"], truth_order=["t"])
    a = E.accuracy(found, truth, keys=["media_id"]).first()
    assert (a.recall, a.precision) == (1.0, 1.0)
    assert E.duplicates(d.events, ["media_id"], ["score_before", "score_after"]).first().duplicates == 0
    silent = detect(samples, None, media).events.orderBy("event_id").collect()
    assert [r.used_fallback for r in silent] == [True] * 3


def test_config(tmp_path):
    assert merge({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 9}}) == {"a": {"b": 9, "c": 2}, "d": 3}
    f = tmp_path / "c.yaml"
    f.write_text("clips:\n  pre_s: 20\nother: 1\n")
    assert load(str(f), {"clips": {"post_s": 3}}).clips == ClipConfig(20.0, 3.0, 30.0)
    assert load(None) == BUILTIN and SHIPPED.clips.max_s == 35.0
    for bad in ({"score": {"reads": 0}}, {"clips": {"pre_s": "x"}}, {"clips": None}, {"audio": {"window_ms": float("nan")}}):
        with pytest.raises(ValueError):
            configured(BUILTIN, bad)
