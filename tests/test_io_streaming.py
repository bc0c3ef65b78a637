"""Sources, sinks and the streaming forms."""

import io
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.config import AudioConfig, ScoreConfig
from tidemark.functions import scalars as S
from tidemark.operators import audio, folds, scoreboard
from tidemark.plans import catalogue
from tidemark.sources import media as M
from tidemark.sources.pcm import data_chunk
from tidemark.streaming import stateful


def wav(samples, extra=b""):
    data = struct.pack(f"<{len(samples)}h", *samples)
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
    body = b"WAVE" + fmt + extra + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_wav(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(list(range(10)), b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    got = M.read_wav(spark, str(tmp_path), chunk=4).orderBy("chunk_idx").collect()
    assert [r.sample_offset for r in got] == [0, 4, 8] and [x for r in got for x in r.samples] == list(range(10))
    for bad in (b"", b"RIFF0000WAVE", b"x" * 50):
        with pytest.raises(ValueError):
            data_chunk(io.BytesIO(bad), len(bad))


def test_truth_and_listing(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"video": "v1.mp4", "duration_seconds": 330, "events": [{"type": "GOAL", "timestamp": 80, "scoreboard_update": 83, "score_after": "1:0"}]}')
    (tmp_path / "v1.mp4").write_bytes(b"1")
    (tmp_path / "v2.MKV").write_bytes(b"1")
    truth = M.read_truth(spark, str(tmp_path / "t.json"))
    assert truth.first().t == 80.0
    videos = M.list_videos(spark, str(tmp_path)).select(F.regexp_replace("path", ".*/", "").alias("media_id"))
    assert [r.media_id for r in M.without_truth(videos, truth).collect()] == ["v2.MKV"]


def test_probe(spark):
    text = '{"format": {"duration": "12.5", "format_name": "mp4"}, "streams": [{"codec_type": "audio", "codec_name": "aac"}, {"codec_type": "video", "codec_name": "av1", "width": 1920, "height": 1080, "r_frame_rate": "25/1"}]}'
    r = M.probed(spark.createDataFrame([("a.mp4", text)], "path string, probe string")).first()
    assert (r.duration_s, r.fps, r.width, r.has_audio) == (12.5, 25.0, 1920, True)
    with pytest.raises(Exception, match="no video"):
        M.probed(spark.createDataFrame([("a.mp4", '{"format": {"duration": "1"}, "streams": []}')], "path string, probe string")).collect()


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("m", 2, "b"), ("m", 1, "a")], "media_id string, n int, type string")
    assert M.event_documents(e, ["media_id"], ["n"]).first().document == '{"events":[{"n":1,"type":"a"},{"n":2,"type":"b"}]}'
    for _ in range(2):
        M.write_events(e, str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 2
    M.write_lines(M.log_lines(spark.createDataFrame([(61.0, "done")], "t double, message string")), str(tmp_path / "l"))
    assert spark.read.text(str(tmp_path / "l")).first().value == "[01:01.000] done"


def streamed(spark, df, tmp_path, run, parts=3):
    """Rows of run(stream) over df's rows, that come in `parts` batches in order of their first sort column."""
    source = tmp_path / "in"
    n = df.count()
    rows = df.collect()
    for i in range(parts):
        spark.createDataFrame(rows[i * n // parts : (i + 1) * n // parts], df.schema).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"out_{abs(hash(str(tmp_path)))}"
    q = run(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_streaming_spikes(spark, tmp_path):
    rows = spark.createDataFrame([("m", w, w / 5, 10.0, -20.0) for w in (1, 3, 9, 10, 12, 19, 30)], "media_id string, w long, t double, delta_db double, rms_db double")
    got = streamed(spark, rows, tmp_path, lambda s: stateful.cooled(s, AudioConfig()))
    want = folds.spaced(rows, ["media_id"], ["w"], "w", AudioConfig().cooldown_windows, strict=True, carry=[])
    assert sorted(r.w for r in got) == sorted(r.w for r in want.collect())
    assert audio.spikes


def test_streaming_scores(spark, tmp_path):
    shown = [(0, 0)] * 3 + [(1, 0)] * 4 + [(0, 0)] * 3 + [(1, 0), (3, 0), (3, 0), (3, 0), (3, 1), (3, 1), (3, 1)]
    rows = spark.createDataFrame([("m", float(i), h, a) for i, (h, a) in enumerate(shown)], "media_id string, t double, home int, away int")
    got = streamed(spark, rows, tmp_path, lambda s: stateful.score_changes(s, ScoreConfig()))
    batch = scoreboard.score_states(rows.select("media_id", "t", F.lit(True).alias("ok"), S.score("home", "away").alias("score")), ScoreConfig()).first()
    want = sorted((c.confirmed_t, c.validation) for c in [*batch.changes, *batch.rejected])
    assert sorted((r.confirmed_t, r.validation) for r in got) == want and len(want) == 4


def test_streaming_frames_and_slew(spark, tmp_path):
    rows = spark.createDataFrame([("m", i, None if i == 0 else 9.0 if i % 5 == 0 else 0.0) for i in range(17)], "media_id string, frame long, difference double")
    got = streamed(spark, rows, tmp_path, lambda s: stateful.frames_to_read(s, refresh=4, reads=2))
    want = scoreboard.frames_to_read(rows, ["media_id"], refresh=4, reads=2).collect()
    assert sorted((r.frame, r.should_read) for r in got) == sorted((r.frame, r.should_read) for r in want)


def test_streaming_dedup(spark, tmp_path):
    rows = spark.createDataFrame([("m", float(t)) for t in (100, 108, 121, 130, 150)], "media_id string, t double")
    got = streamed(spark, rows, tmp_path, lambda s: stateful.deduplicated(s, 20.0, ["media_id"], "media_id string"))
    assert sorted(r.t for r in got) == [100, 121, 150]


def test_streaming_late_rows(spark, tmp_path):
    """Rows out of order across batches give what the batch form gives; the last row only moves the watermark."""
    times = [100, 130, 108, 150, 121, 171, 160, 200, 10_000]
    rows = spark.createDataFrame([("m", float(t)) for t in times], "media_id string, t double").withColumn("at", F.timestamp_seconds("t"))
    got = streamed(spark, rows, tmp_path, lambda s: stateful.deduplicated(s, 20.0, ["media_id"], "media_id string", ("at", "60 seconds")))
    want = folds.spaced(rows.where("t < 10000"), ["media_id"], ["t"], "t", 20.0, strict=False, carry=[])
    assert sorted(r.t for r in got) == sorted(r.t for r in want.collect()) == [100, 121, 150, 171, 200]


def test_streaming_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("m", t) for t in (0, 5, 13, 40, 100, 1000)], "media_id string, s int").select("media_id", F.timestamp_seconds("s").alias("at"))
    got = streamed(spark, rows, tmp_path, lambda s: stateful.sessions(s, keys=["media_id"], at="at", gap="8 seconds", delay="1 second", aggregates=[F.count("*").alias("n")]))
    assert sorted(r.n for r in got)[-1] == 3


@pytest.mark.parametrize("name", ["q_spikes", "q_score_changes", "q_classify"])
def test_independent_of_partitions(spark, name):
    """The same rows whatever the number of shuffle partitions."""
    found = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(map(str, catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] and found[0]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
