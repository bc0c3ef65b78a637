"""Whitening against a plain version in integers and numpy."""

import math

import numpy as np
import pytest

from tidemark.llm.whitening import op12_whitening, whiten

INF, NAN = float("inf"), float("nan")


def plain(rows, components=4, scale=256):
    """(key, component) -> n, deviation, whitened up to sign, explained; vectors of one length."""
    xs = [(k, [math.floor(scale * c) for c in v]) for k, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in xs})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:components]
    out = {}
    for key, x in xs:
        apart = [n * a - s for a, s in zip(x, sums, strict=True)]
        for k, o in enumerate(order, 1):
            out.setdefault((key, k), []).append((n, sum(d * d for d in apart), float(np.array(apart, dtype=float) @ vectors[:, o]) / n / math.sqrt(values[o]), values[o] / values.sum()))
    return out


def same(found, wanted):
    by, flips = {}, {}
    for r in found:
        by.setdefault((r[0], r["component"]), []).append(r)
        assert r["identity_error"] <= 1e-4
    assert {k: len(v) for k, v in by.items()} == {k: len(v) for k, v in wanted.items()}
    for key, rows in by.items():
        for r, (n, deviation, whitened, explained) in zip(sorted(rows, key=lambda r: r["deviation"]), sorted(wanted[key], key=lambda w: w[1]), strict=True):
            assert (r["n"], r["deviation"]) == (n, deviation)
            assert r["explained"] == pytest.approx(explained, rel=1e-6)
            flip = flips.setdefault(key[1], 1 if whitened * r["whitened"] >= 0 else -1) if abs(whitened) > 1e-3 else flips.get(key[1])
            assert abs(r["whitened"]) == pytest.approx(abs(whitened), abs=1e-6)
            if flip and abs(whitened) > 1e-3:
                assert r["whitened"] * flip == pytest.approx(whitened, abs=1e-6)


def test_query_against_a_plain_version(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    same(op12_whitening(spark, folder).collect(), plain(rows))


def test_large_means_lose_nothing(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(size=6) * [3, 2, 1, 0.5, 0.2, 0.1] + 4.0e9).tolist()) for i in range(300)]
    same(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), plain(rows))


def test_edges(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(7, rows[7][1]), (8, rows[9][1]), (None, rows[3][1]), (70, None), (71, [0.1, None, 0.2, 0.3, 0.4]), (72, [NAN, 0.0, 0.0, 0.0, 0.0]), (73, [0.0, INF, 0.0, 0.0, 0.0])]
    kinds = "vec_id long, embedding array<double>"
    same(whiten(spark.createDataFrame([(k, v, v, 1) for k, v in rows], f"{kinds}, x array<double>, component int")).collect(), plain(rows))
    assert whiten(spark.createDataFrame([], kinds)).collect() == []
    assert whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, None)], kinds)).collect() == []
    found = whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 2.0]), (3, [5.0]), (4, [7.0]), (5, [6.0])], kinds)).collect()
    assert sorted((r["vec_id"], r["component"], r["n"]) for r in found) == [(1, 1, 2), (2, 1, 2), (3, 1, 3), (4, 1, 3), (5, 1, 3)]


def test_entries_beyond_the_range_of_long(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 5.0])]
    found = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["component"] for r in found} == {1} and all(math.isfinite(r["whitened"]) for r in found)
    assert {r["deviation"] for r in found if r["vec_id"] != 3} == {None}


def test_many_dimensions_in_several_aggregations(spark, monkeypatch):
    monkeypatch.setattr("tidemark.llm.whitening.PAIRS", 50)
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=20) * np.arange(1, 21)).tolist()) for i in range(200)]
    same(whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), plain(rows))
