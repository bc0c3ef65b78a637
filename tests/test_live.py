"""Streams against the batch forms on shuffled input; state that ends; writes that are killed and repeated."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import AudioConfig, EventConfig, ScoreConfig
from tidemark.functions import scalars as S
from tidemark.operators import audio, scoreboard, signals
from tidemark.sources import recordings
from tidemark.streaming import live, stateful


class Sent:
    """A stream over files that are added one by one; each is a batch of its own."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.n = spark, folder, schema, 0
        folder.mkdir(parents=True)
        self.stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(str(self.folder / f"part{self.n:03d}.parquet.d"))
        (f,) = (self.folder / f"part{self.n:03d}.parquet.d").glob("part-*.parquet")
        f.rename(self.folder / f"{self.n:03d}.parquet")
        self.n += 1


def run(spark, out, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return q, spark.table(name).collect()


def shuffled_within(rows, at, seconds, seed):
    """Out of order, but by less than the watermark's delay."""
    rng = random.Random(seed)
    return [r for _, r in sorted((r[at] + rng.uniform(0, seconds), r) for r in rows)]


def test_scores_in_any_order_keep_every_digit(spark, tmp_path):
    rng = random.Random(1)
    rows = []
    for m in ("a", "b"):
        score, t = [0, 0], 0.0
        for _ in range(120):
            t += rng.uniform(0.3, 1.2) + 0.1234567890123
            if rng.random() < 0.1:
                score[rng.randrange(2)] += 1
            rows.append((m, t, *(score if rng.random() < 0.9 else [rng.randrange(5), 0])))
    kind = "media_id string, t double, home int, away int"
    sent = Sent(spark, tmp_path / "in", kind)
    late = shuffled_within(rows, 1, 15, 7)
    for i in range(0, len(late), 60):
        sent.add(late[i : i + 60])
    sent.add([("z", 1e6, 0, 0)])
    sent.add([("z", 1e6 + 1, 0, 0)])
    stream = sent.stream.withColumn("at", F.timestamp_seconds("t"))
    _, got = run(spark, stateful.score_changes(stream, ScoreConfig(), ("at", "20 seconds")), tmp_path, "scores_late")
    batch = scoreboard.score_states(spark.createDataFrame(rows, kind).select("media_id", "t", F.lit(True).alias("ok"), S.score("home", "away").alias("score")), ScoreConfig()).collect()
    want = sorted((s.media_id, c.change_t, c.confirmed_t, c.validation) for s in batch for c in [*s.changes, *s.rejected])
    assert sorted((r.media_id, r.change_t, r.confirmed_t, r.validation) for r in got) == want and len(want) > 10


def test_state_of_idle_keys_goes_and_a_state_to_start_from(spark, tmp_path):
    kind = "media_id string, t double, home int, away int"
    sent = Sent(spark, tmp_path / "in", kind)
    sent.add([(m, float(t), 1, 0) for m in ("a", "b") for t in range(5)])
    sent.add([("z", 1000.0, 0, 0)])
    sent.add([("z", 2000.0, 0, 0)])
    sent.add([("z", 3000.0, 0, 0)])
    sent.add([("z", 4000.0, 0, 0)])
    start = spark.createDataFrame([("a", 0, 0, [], [], [])], "media_id string, home int, away int, times array<double>, homes array<int>, aways array<int>")
    stream = sent.stream.withColumn("at", F.timestamp_seconds("t"))
    out = stateful.score_changes(stream, ScoreConfig(), ("at", "10 seconds"), idle=timedelta(seconds=60), initial=start)
    q, got = run(spark, out, tmp_path, "scores_idle")
    assert [(r.media_id, r.before, r.after) for r in got] == [("a", "0:0", "1:0")]  # b's first score is its baseline
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert max(kept) > kept[-1]


@pytest.mark.parametrize("cut", [3, 7, 1000])
def test_windows_of_any_cut(spark, tmp_path, cut):
    rng = random.Random(cut)
    sounds = {"a": [rng.randrange(-32768, 32768) for _ in range(203)], "b": [rng.randrange(-9, 9) for _ in range(44)]}
    kind = "media_id string, sample_offset bigint, samples array<smallint>"
    rows = [(m, i, s[i : i + cut]) for m, s in sounds.items() for i in range(0, len(s), cut)]
    mixed = rng.sample(rows, len(rows))
    sent = Sent(spark, tmp_path / "in", kind)
    for i in range(0, len(mixed), max(1, len(mixed) // 3)):
        sent.add(mixed[i : i + max(1, len(mixed) // 3)])
    cfg = AudioConfig(rate=1000, window_ms=10)
    _, got = run(spark, live.windows_of_chunks(sent.stream, cfg), tmp_path, f"windows_{cut}")
    want = audio.windows_of_chunks(spark.createDataFrame(rows, kind), cfg).collect()
    shown = lambda rs: sorted((r.media_id, r.w, r.t, r.rms, r.rms_db, r.peak_db) for r in rs)
    assert shown(got) == shown(want) and len(want) == 24


def test_event_times_of_two_streams(spark, tmp_path):
    rng = random.Random(3)
    changes = [(m, float(20 + 37 * i), 400.0, i) for m in ("a", "b", "silent") for i in range(8)]
    windows = [(m, i / 2, rng.uniform(-3, 14)) for m in ("a", "b") for i in range(700)]
    one, two = Sent(spark, tmp_path / "c", "media_id string, change_t double, duration_s double, seq int"), Sent(spark, tmp_path / "w", "media_id string, t double, delta_db double")
    left, right = shuffled_within(changes, 1, 25, 4), shuffled_within(windows, 1, 25, 5)
    for i in range(4):
        one.add(left[i * len(left) // 4 : (i + 1) * len(left) // 4])
        two.add(right[i * len(right) // 4 : (i + 1) * len(right) // 4])
    for t in (1e5, 2e5, 3e5):
        one.add([("end", t, 1e6, 0)])
        two.add([("end", t, 0.0)])
    cfg = EventConfig(lookback_s=12.0)
    out = live.event_times(one.stream, two.stream, cfg, delay="200 seconds", key=["seq"])
    _, got = run(spark, out, tmp_path, "event_times")
    want = signals.event_times(spark.createDataFrame(changes, one.schema), spark.createDataFrame(windows, two.schema), cfg, key=["media_id", "seq", "change_t"]).collect()
    columns = ["media_id", "seq", "change_t", "duration_s", "event_t", "peak_t", "peak_delta_db", "used_fallback"]
    shown = lambda rs: sorted(tuple(str(r[c]) for c in columns) for r in rs if r.media_id != "end")
    assert shown(got) == shown(want) and any(r.used_fallback for r in want) and not all(r.used_fallback for r in want)


def listed(spark, path):
    return sorted((r.media_id, r.n) for r in recordings.read_recordings(spark, path).collect())


def test_a_rerun_replaces_its_own_recordings(spark, tmp_path):
    path = f"file://{tmp_path}/table"
    media = lambda *names: spark.createDataFrame([(n,) for n in names], "media_id string")
    rows = lambda *pairs: spark.createDataFrame(list(pairs), "media_id string, n int")
    with pytest.raises(FileNotFoundError):
        recordings.read_recordings(spark, path)
    assert recordings.replace_recordings(rows(("a", 1), ("a", 2), ("b", 3), ("lost", 9)), media("a", "b"), path, "one")
    assert recordings.replace_recordings(rows(("b", 4)), media("b", "c"), path, "two / é")
    assert listed(spark, path) == [("a", 1), ("a", 2), ("b", 4)]
    assert not recordings.replace_recordings(rows(("a", 7)), media("a"), path, "one")  # committed before
    assert recordings.replace_recordings(rows(), media("a"), path, "three")  # nothing found any more
    assert listed(spark, path) == [("b", 4)]
    recordings.compact(spark, path, "all")
    assert listed(spark, path) == [("b", 4)] and len(list((tmp_path / "table" / "batches").iterdir())) == 1
    assert recordings.replace_recordings(rows(("d", 5)), media("d"), path, "four")
    assert listed(spark, path) == [("b", 4), ("d", 5)]


@pytest.mark.parametrize("step", ["rows", "commit"])
def test_a_write_killed_between_its_steps(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "table")
    first = spark.createDataFrame([("a", 1), ("b", 2)], "media_id string, n int")
    recordings.replace_recordings(first, first, path, "one")
    second = spark.createDataFrame([("a", 10), ("c", 30)], "media_id string, n int")
    with monkeypatch.context() as m:
        if step == "commit":
            m.setattr(recordings, "_commit", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        bad = second if step == "commit" else second.withColumn("n", F.raise_error(F.lit("killed")).cast("int"))
        with pytest.raises(KeyboardInterrupt if step == "commit" else Exception):
            recordings.replace_recordings(bad, second, path, "two")
    assert listed(spark, path) == [("a", 1), ("b", 2)]
    assert recordings.replace_recordings(second, second, path, "two")
    assert listed(spark, path) == [("a", 10), ("b", 2), ("c", 30)]


def test_a_stream_into_recordings(spark, tmp_path):
    sent, path = Sent(spark, tmp_path / "in", "media_id string, n int"), str(tmp_path / "table")
    sent.add([("a", 1), ("b", 1)])
    sent.add([("a", 2)])
    for _ in range(2):  # the second run finds nothing to do, and batches written again change nothing
        write = recordings.replacing(path, name="live")
        q = sent.stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    write(spark.createDataFrame([("a", 99)], "media_id string, n int"), 0)
    assert listed(spark, path) == [("a", 2), ("b", 1)]
