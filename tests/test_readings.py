"""Calibration, signatures of pixels, keywords and order statistics against plain versions."""

import itertools
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators import keywords as K
from tidemark.operators import pixels, ranks, recognition, scoreboard


class PlainReader:
    """As a reader that keeps the places it found."""

    def __init__(self, expires, retry):
        self.places, self.reads, self.failures, self.expires, self.retry = [], 0, 0, expires, retry

    def read(self, row):
        before = self.places
        if self.places and self.reads < self.expires:
            if row["crop_ok"]:
                self.reads += 1
                self.failures = 0
                return "crop", True
            self.failures += 1
            if self.failures % self.retry != 1:
                return "crop", False
        self.places = []
        if row["layout_ok"]:
            if row["layout_crops"]:
                self.places, self.reads, self.failures = ["place"] * row["layout_crops"], 0, 0
            return "layout", True
        if before:
            self.places, self.reads = before, 0
        return "layout", False


def test_calibration(spark):
    rng = random.Random(2)
    rows = [
        {"m": m, "n": n, "crop_ok": rng.random() < good, "crop_score": "c", "crop_confidence": 0.9, "layout_ok": rng.random() < 0.7, "layout_score": "l", "layout_confidence": 0.4, "layout_crops": rng.randrange(3)}
        for m, good in (("a", 0.95), ("b", 0.4), (None, 0.0)) for n in range(400)
    ]
    df = spark.createDataFrame(rows, "m string, n int, crop_ok boolean, crop_score string, crop_confidence double, layout_ok boolean, layout_score string, layout_confidence double, layout_crops int")
    got = recognition.calibrated(df.repartition(7), ["m"], ["n"], carry=["n"], expires=30, retry=10).collect()
    found = {(r.m, r.n): (r.use, r.ok) for r in got}
    for m in ("a", "b", None):
        reader = PlainReader(30, 10)
        own = [r for r in rows if r["m"] == m]
        assert [found[m, r["n"]] for r in own] == [reader.read(r) for r in own]
    assert {(r.use, r.ok, r.score, r.confidence) for r in got} == {("crop", True, "c", 0.9), ("crop", False, None, 0.0), ("layout", True, "l", 0.4), ("layout", False, None, 0.4)}
    assert recognition.calibrated(df.limit(0), ["m"], ["n"], carry=["n"]).collect() == []


def plain_signature(pixels_, w, h, cells):
    """Cell by cell, pixel by pixel."""
    grey = [[round(0.114 * b + 0.587 * g + 0.299 * r) for b, g, r in itertools.batched(pixels_[3 * w * y : 3 * w * (y + 1)], 3)] for y in range(h)]
    out = []
    for j in range(cells[1]):
        for i in range(cells[0]):
            x0, x1, y0, y1 = i * w / cells[0], (i + 1) * w / cells[0], j * h / cells[1], (j + 1) * h / cells[1]
            total = 0.0
            for y in range(h):
                for x in range(w):
                    total += grey[y][x] * max(0.0, min(x1, x + 1) - max(x0, x)) * max(0.0, min(y1, y + 1) - max(y0, y))
            out.append(total / ((x1 - x0) * (y1 - y0)))
    return out


@pytest.mark.parametrize("w,h,cells", [(96, 48, (48, 24)), (100, 37, (48, 24)), (7, 5, (3, 2)), (4, 4, (8, 8)), (1, 1, (2, 1))])
def test_signature_against_loops(w, h, cells):
    data = random.Random(w).randbytes(3 * w * h)
    got, exact = pixels.signature_of(data, w, h, cells), plain_signature(data, w, h, cells)
    assert len(got) == cells[0] * cells[1] and all(abs(a - b) <= 0.5 + 1e-9 and a == int(a) for a, b in zip(got, exact, strict=True))


def test_differences_follow_from_pixels(spark):
    frames = [("m", i, bytes([v]) * (3 * 60 * 30), 60, 30) for i, v in enumerate((10, 10, 14, 255, 0))]
    frames += [("m", 5, b"xx", 60, 30), ("m", 6, None, 60, 30), ("m", 7, b"", 0, 0)]
    df = spark.createDataFrame(frames, "media_id string, frame int, pixels binary, width int, height int")
    found = pixels.signatures(df)
    assert {(r.frame, r.error) for r in found.where("NOT ok").collect()} == {(5, "incomplete frame: 2/5400 bytes"), (6, "no frame"), (7, "incomplete frame: 0/0 bytes")}
    away = scoreboard.signature_difference(found.where("ok"), ["media_id"])
    assert [r.difference for r in away.orderBy("frame").collect()] == [None, 0.0, 4.0, 241.0, 255.0]


def plain_hits(text, keywords):
    """All windows of words against all patterns, by the distance of each word."""

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    words, out = K.words_of(text), []
    for k in keywords:
        for i in range(len(words)):
            best = None
            for p in k.patterns:
                parts = K.words_of(p)
                if i + len(parts) <= len(words):
                    d = sum(distance(a, b) for a, b in zip(words[i:], parts, strict=False))
                    bears = len("".join(parts)) // K.LETTERS_A_DIFFERENCE if k.differences is None else k.differences
                    if d <= bears:
                        best = min(best or (d, -len(parts), " ".join(parts)), (d, -len(parts), " ".join(parts)))
            if best:
                out.append((k.name, best[2], k.weight, best[0], i))
    return sorted(out, key=lambda h: (h[4], [k.name for k in keywords].index(h[0])))


WORDS = [K.Keyword("goal", 30, ("gol", "gool", "bramka")), K.Keyword("penalty", 25, ("karny", "rzut karny"), 1), K.Keyword("card", 40, ("czerwona kartka", "kartka")), K.Keyword("far", 1, ("abcab abc",), 3)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["gol", "goool", "GOOOOL", "gl", "golem", "bramka", "brmka", "bramkaa", "xbramka", "rzut", "karny", "karmy", "kany", "czerwona", "czrwona", "kartka", "kartkz", "a"]) | st.text("abc", max_size=7), max_size=9), st.sampled_from([" ", ", ", "--"]))
def test_keywords_against_all_windows(words, between):
    text = between.join(words)
    assert K.Automaton(WORDS).hits(text) == plain_hits(text, WORDS)


def test_keyword_hits_have_times(spark):
    config = {"goal": {"weight": 30, "patterns": ["gol", "bramka"]}, "card": {"weight": 40, "patterns": ["czerwona kartka"]}}
    rows = spark.createDataFrame([(1, "ale GOOOOL prosze, bramka", 10.0, 18.0), (2, "czerwona kartka", 0.0, 1.0), (3, None, 0.0, 1.0), (4, "", None, None), (5, "golem", 0.0, 1.0)], "id int, text string, a double, b double")
    got = K.keyword_hits(rows, K.keywords_of(config), start="a", end="b").collect()
    assert sorted((r.id, r.keyword, r.weight, r.word, r.t) for r in got) == [(1, "goal", 30.0, 1, 12.0), (1, "goal", 30.0, 3, 16.0), (2, "card", 40.0, 0, 0.0)]
    assert K.keyword_hits(rows.limit(0), K.keywords_of(config)).collect() == []
    for bad in ({"x": {"weight": 1}}, {"x": {"weight": "1", "patterns": ["a"]}}, {"x": ["a"]}):
        with pytest.raises(ValueError):
            K.keywords_of(bad)
    with pytest.raises(ValueError):
        K.Automaton([K.Keyword("x", 1, ("...",))])


@pytest.mark.parametrize("share", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_order_statistics_of_any_group(spark, share):
    rng = np.random.default_rng(3)
    groups = {"big": rng.normal(size=30_000).tolist(), "ties": [5.0] * 20_000 + rng.uniform(0, 10, 500).tolist(), "one": [3.0], "two": [2.0, 1.0], "skew": (10 ** rng.uniform(0, 300, 3000)).tolist(), None: [1.0, 2.0, 3.0]}
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None), ("two", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    found = {r.k: r.x for r in ranks.order_statistic(df, ["k"], "v", share=share, out="x").collect()}
    wanted = {k: sorted(vs)[min(int(len(vs) * share), len(vs) - 1)] for k, vs in groups.items()}
    assert found == wanted | {"none": None}
    everything = sorted(v for vs in groups.values() for v in vs)
    assert ranks.order_statistic(df, [], F.col("v"), share=share).collect() == [(everything[min(int(len(everything) * share), len(everything) - 1)],)]
    assert ranks.order_statistic(df.limit(0), [], "v").collect() == []


def test_keywords_leave_far_words_out(monkeypatch):
    seen = []
    monkeypatch.setattr(K, "_HELD", 50)
    found = K.Automaton(WORDS)
    alone = found._differences
    monkeypatch.setattr(found, "_differences", lambda w: seen.append(w) or alone(w))
    text = " ".join([*(f"word{i % 40}" for i in range(400)), "bramka"])
    assert found.hits(text) == plain_hits(text, WORDS) and found.counted_hits(text)[1] == 401 and len(seen) == 41
    other = " ".join(f"other{i}" for i in range(90))
    assert found.hits(other) == [] and found.hits(text) == plain_hits(text, WORDS) and len(found.known) <= 132
