"""The PCM source against plain arrays; error rows."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.config import AudioConfig
from tidemark.operators import attempts, audio
from tidemark.sources import media as M
from tidemark.sources.pcm import read_pcm, write_wav
from tidemark.sources.storage import read_exactly


def wav(samples, extra=b"", claimed=None):
    data = struct.pack(f"<{len(samples)}h", *samples)
    fmt = b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, 16000, 32000, 2, 16)
    body = b"WAVE" + fmt + extra + b"data" + struct.pack("<I", len(data) if claimed is None else claimed) + data
    return b"RIFF" + struct.pack("<I", len(body) & 0xFFFFFFFF) + body


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    sounds = {"a": [rng.randrange(-32768, 32768) for _ in range(1003)], "deep/b": list(range(17)), "none": []}
    (tmp_path / "deep").mkdir()
    for name, samples in sounds.items():
        (tmp_path / f"{name}.wav").write_bytes(wav(samples, b"LIST" + struct.pack("<I", 3) + b"abc\0"))
    return tmp_path, sounds


def by_file(rows, folder):
    out = {}
    for r in sorted(rows, key=lambda r: r.sample_offset):
        out.setdefault(r.media_id.removeprefix(f"{folder}/").removesuffix(".wav"), []).extend(r.samples or [])
    return out


@pytest.mark.parametrize("size,chunk", [(100, 10), (64, 7), (10_000, 400), (1, 5)])
def test_ranges_hold_all_samples_once(spark, folder, size, chunk):
    path, sounds = folder
    df = read_pcm(spark, f"file://{path}", range=size, chunk=chunk)
    rows = df.collect()
    assert by_file(rows, path) == {k: v for k, v in sounds.items() if v} and all(r.ok and r.error is None for r in rows)
    assert all(r.sample_offset == r.chunk_idx * chunk and len(r.samples) <= chunk for r in rows)
    step = max(1, size // chunk) * chunk
    assert math.ceil(1020 / step) <= df.rdd.getNumPartitions() <= math.ceil(1003 / step) + math.ceil(17 / step)


def test_columns_and_filters_leave_out_work(spark, folder):
    path, sounds = folder
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        df = read_pcm(spark, str(path), range=100, chunk=10)
        own = df.where((F.col("media_id") == f"{path}/a.wav") & (F.col("sample_offset") >= 200) & (F.col("sample_offset") < 400))
        assert own.rdd.getNumPartitions() <= 3
        assert by_file(own.collect(), path) == {"a": sounds["a"][200:400]}
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    thin = read_pcm(spark, str(path), columns="sample_offset bigint, media_id string", chunk=10)
    assert thin.columns == ["sample_offset", "media_id"] and thin.count() == 103


def test_a_file_cut_after_planning(spark, folder):
    path, sounds = folder
    df = read_pcm(spark, str(path), range=100, chunk=10)
    assert df.count() == 103
    (path / "a.wav").write_bytes((path / "a.wav").read_bytes()[: 44 + 12 + 2 * 255])
    rows = df.where(F.col("media_id").endswith("a.wav")).collect()
    assert [x for r in sorted(rows, key=lambda r: r.sample_offset) if r.ok for x in r.samples] == sounds["a"][:250]
    assert {r.error for r in rows if not r.ok} == {"EOFError: incomplete: 10/20 bytes", "EOFError: incomplete: 0/20 bytes", "EOFError: incomplete: 0/6 bytes"}


def test_bad_files_are_rows(spark, folder):
    path, sounds = folder
    (path / "bad.wav").write_bytes(b"RIFF0000WAVE")
    (path / "empty.wav").write_bytes(b"")
    (path / "short.wav").write_bytes(wav([1, 2, 3, 4, 5], claimed=20))
    (path / "stream.wav").write_bytes(wav([7, 8, 9], claimed=0xFFFFFFFF))
    rows = read_pcm(spark, str(path), chunk=4).collect()
    good = by_file([r for r in rows if r.ok], path)
    assert good == {"a": sounds["a"], "deep/b": sounds["deep/b"], "short": [1, 2, 3, 4, 5], "stream": [7, 8, 9]}
    wrong = {r.media_id.rsplit("/", 1)[1]: (r.sample_offset, r.error) for r in rows if not r.ok}
    assert wrong == {
        "bad.wav": (0, "ValueError: a WAV file without data"), "empty.wav": (0, "ValueError: not a WAV file"), "short.wav": (5, "EOFError: incomplete: 10/20 bytes"),
    }
    assert by_file(read_pcm(spark, str(path), chunk=4, mode="dropmalformed").collect(), path) == good
    with pytest.raises(Exception, match="not a WAV file|without data|incomplete"):
        read_pcm(spark, str(path), mode="failfast").collect()
    with pytest.raises(Exception, match="FileNotFound"):
        read_pcm(spark, str(path / "nothing")).collect()
    (path / "deep" / "b.wav").unlink()
    assert read_pcm(spark, str(path / "deep")).collect() == []


def test_windows_of_ranges(spark, folder):
    path, sounds = folder
    cfg = AudioConfig(rate=1000, window_ms=9)
    found = {(r.media_id.rsplit("/", 1)[1], r.w): (r.rms, r.peak_db) for r in audio.windows_of_chunks(read_pcm(spark, str(path), range=50, chunk=10), cfg).collect()}
    wanted = {}
    for name, samples in sounds.items():
        for w in range(len(samples) // 9):
            part = samples[9 * w : 9 * w + 9]
            wanted[f"{name.rsplit('/', 1)[-1]}.wav", w] = (math.sqrt(sum(x * x for x in part) / 9), 20 * math.log10(max(1e-7, max(map(abs, part)))))
    assert found == {k: pytest.approx(v) for k, v in wanted.items()}


@pytest.mark.parametrize("offset,n", [(0, 5), (3, 5), (5, 5), (7, 5), (2, 100), (9, 1)])
def test_window_sums(offset, n):
    samples = np.array([3, -7, 0, -32768, 32767, 5, 5, 1], dtype=np.int16)
    got = list(zip(*(x.tolist() for x in audio.window_sums(offset, samples, n)), strict=True))
    by = {}
    for i, x in enumerate(samples.tolist()):
        by.setdefault((offset + i) // n, []).append(x)
    assert got == [(w, len(v), sum(x * x for x in v), max(map(abs, v))) for w, v in sorted(by.items())]


def test_written_files_are_read(spark, tmp_path):
    rows = [("x/1 é", 4, [5, 6]), ("x/1 é", 0, [1, 2, 3, 4]), ("y", 0, [-1]), ("z", 0, []), (None, 0, [1])]
    df = spark.createDataFrame(rows, "media_id string, sample_offset bigint, samples array<smallint>")
    for _ in range(2):
        done = write_wav(df, f"file://{tmp_path}/w")
    assert sorted((r.media_id, r.n_samples) for r in done.collect()) == [("x/1 é", 6), ("y", 1)]
    got = by_file(read_pcm(spark, f"{tmp_path}/w").collect(), tmp_path / "w")
    assert got == {"x%2F1%20%C3%A9": [1, 2, 3, 4, 5, 6], "y": [-1]}


def test_read_exactly():
    class Drops:
        def __init__(self):
            self.left = [b"ab", b"c", b""]

        def read(self, n):
            return self.left.pop(0)

    assert read_exactly(Drops(), 3) == b"abc"
    with pytest.raises(EOFError, match="3/4"):
        read_exactly(Drops(), 4)


def test_attempts(spark, tmp_path):
    def make():
        def run(row):
            if row.text == "crash":
                raise ValueError("broken row")
            return None if row.text == "nothing" else {"n": len(row.text), "up": row.text.upper()}

        return run

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["abc", "crash", "nothing", "de"] * 50)], "id int, text string")
    good, bad = attempts.routed(attempts.attempted(rows, make, "n int, up string"), str(tmp_path / "r"))
    assert good.columns == ["id", "text", "n", "up"] and {(r.id % 4, r.n, r.up) for r in good.collect()} == {(0, 3, "ABC"), (3, 2, "DE")} and good.count() == 100
    assert {(r.id % 4, r.error) for r in bad.collect()} == {(1, "ValueError: broken row"), (2, "no result")} and bad.count() == 100

    def fails():
        raise OSError("no model")

    assert {r.error for r in attempts.attempted(rows, fails, "n int").collect()} == {"OSError: no model"}
    assert M.log_lines(M.error_lines(bad, "text")).first().value.startswith("[00:00.000] ERROR ")


def test_one_bad_probe_of_many(spark):
    text = '{"format": {"duration": "12.5"}, "streams": [{"codec_type": "video", "width": 1920, "height": 1080, "r_frame_rate": "25/1"}]}'
    rows = [(f"{i}.mp4", text) for i in range(20)] + [("x.mp4", "{broken"), ("y.mp4", '{"format": {"duration": "1"}, "streams": []}'), ("z.mp4", text.replace("12.5", "0")), ("n.mp4", None)]
    found = {r.path: (r.ok, r.error, r.result and r.result.duration_s) for r in M.probe_attempts(spark.createDataFrame(rows, "path string, probe string")).collect()}
    assert [found[f"{i}.mp4"] for i in range(20)] == [(True, None, 12.5)] * 20
    assert {k: found[k][:2] for k in ("x.mp4", "y.mp4", "z.mp4", "n.mp4")} == {"x.mp4": (False, "not JSON"), "y.mp4": (False, "no video stream"), "z.mp4": (False, "no duration"), "n.mp4": (False, "not JSON")}


def test_regions_of_truth_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"video": "a.mp4", "roi": {"x": 1, "y": 2, "width": 30, "height": 4}, "events": []}')
    (tmp_path / "b.json").write_text('{"video": "b.mp4", "events": [{"type": "GOAL", "timestamp": 3}]}')
    assert {r.media_id: r.region for r in M.read_regions(spark, str(tmp_path)).collect()} == {"a.mp4": "1,2,30,4", "b.mp4": None}


@pytest.mark.parametrize("name", ["q_pcm_windows", "q_pcm_ranges"])
def test_samples_beyond_16_bits(spark, tmp_path, name):
    from tidemark.plans import catalogue_more, catalogue_sources  # noqa: F401
    from tidemark.plans.catalogue import QUERIES

    rows = spark.range(12).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id) AS ts", "40L AS user_id", "CASE WHEN id = 3 THEN 560.21D ELSE 1D END AS value")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = {r.w: (r.rms, r.peak_db) for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert got == {0: (round(math.sqrt((4 * 3600 + 33612**2) / 5), 6), round(20 * math.log10(33612), 6)), 1: (60.0, round(20 * math.log10(60), 6))}


def test_wide_files(spark, tmp_path):
    rows = [("x", 0, [1, -(1 << 31), (1 << 31) - 1]), ("x", 3, [40_000])]
    df = spark.createDataFrame(rows, "media_id string, sample_offset bigint, samples array<int>")
    write_wav(df, f"{tmp_path}/w", bits=32).collect()
    (tmp_path / "w" / "y.wav").write_bytes(wav([5, -6]))
    got = by_file(read_pcm(spark, f"{tmp_path}/w", chunk=3, wide="true").collect(), tmp_path / "w")
    assert got == {"x": [1, -(1 << 31), (1 << 31) - 1, 40_000], "y": [5, -6]}
    narrow = read_pcm(spark, f"{tmp_path}/w").collect()
    assert {r.error for r in narrow if not r.ok} == {"ValueError: 32 bits a sample, and the option wide isn't set"} and by_file([r for r in narrow if r.ok], tmp_path / "w") == {"y": [5, -6]}
    w = audio.windows_of_chunks(df, AudioConfig(rate=1000, window_ms=2)).collect()
    assert {r.w: r.rms for r in w} == {0: pytest.approx(2**31 / math.sqrt(2)), 1: pytest.approx(2**31 / math.sqrt(2))}


def test_many_ranges_are_few_partitions(spark, tmp_path, monkeypatch):
    from tidemark.sources import pcm

    monkeypatch.setattr(pcm, "MOST", 8)
    (tmp_path / "a.wav").write_bytes(wav(list(range(1000))))
    parts = pcm.PcmReader(str(tmp_path), ["samples"], 5, 5, "FAILFAST").partitions()
    assert len(parts) <= 9 and [(r.first, r.stop) for p in parts for r in p.ranges][-1][1] == 1000 and sum(r.stop - r.first for p in parts for r in p.ranges) == 1000
