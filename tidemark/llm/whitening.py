"""Whitening of embeddings: principal components of the distinct vectors, each scaled to variance 1.

Vectors become integers, so that equal ones are told exactly and sums are exact. One aggregation over the distinct vectors
gives their number, and the sum, least and largest entry of every dimension; a second sums the products of every pair of centred
dimensions, as one generated SQL expression each, for the upper triangle of the covariance. Only these sums, whose number depends on the dimensions
and not on the rows, come to the driver, where LAPACK decomposes the matrix. Rows are projected by generated expressions
again, so all that touches rows is planned and compiled by Spark. Up to 90 dimensions make a single aggregation of pairs; more are dealt to
several, each over the written list of distinct vectors.

Vectors that are null, or hold null or non-finite entries, are left out. Vectors of unlike length are whitened apart, each length by
its own list. An empty vector, and a list without variance (a single vector), have no component and so no row. Components whose
variance is zero to double precision are left out. Repeated rows get equal results; ties among eigenvalues leave the order to LAPACK. An
entry beyond the range of long takes its end; a deviation beyond it is null. Empty tables give no rows. Other columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm._common import durable, table

#: Expressions of one aggregation.
PAIRS = 4096
#: Variance, as a share of all, that counts as none.
NONE = 1e-12
_KINDS = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@dataclass
class Whitening:
    """Components (columns) of the integer vectors of one length, by falling variance, and what they were fitted on."""

    size: int
    n: int
    sums: list[int]
    least: list[int]
    most: list[int]
    variances: np.ndarray
    components: np.ndarray
    trace: float

    def centred(self, i: int) -> str:
        """Entry i less its mean: whole part and fraction of the mean are taken off one by one, which loses nothing for large means."""
        whole = round(Fraction(self.sums[i], self.n))
        rest = float(Fraction(self.sums[i], self.n) - whole)
        small = all(-(1 << 62) < v < 1 << 62 for v in (self.least[i], self.most[i]))
        return f"(cast(x[{i}] - ({whole}L) as double) - ({rest!r}D))" if small else f"(cast(x[{i}] as double) - ({float(whole)!r}D) - ({rest!r}D))"

    def scores(self, parts: list[str]) -> list[str]:
        """Each component's whitened score, of the names or expressions of centred entries."""
        return [
            _added([f"{part} * ({float(w)!r}D)" for part, w in zip(parts, self.components[:, k], strict=True)]) + f" / ({float(np.sqrt(e))!r}D)"
            for k, e in enumerate(self.variances)
        ]

    def deviation(self) -> str:
        """Sum of (n * entry - sum) squared, exact."""
        far = [max(abs(self.n * low - s), abs(self.n * high - s)) for low, high, s in zip(self.least, self.most, self.sums, strict=True)]
        if sum(d * d for d in far) < 1 << 63 and all(self.n * max(-low, high) < 1 << 63 for low, high in zip(self.least, self.most, strict=True)):
            return _added([f"({self.n}L * x[{i}] - ({s}L)) * ({self.n}L * x[{i}] - ({s}L))" for i, s in enumerate(self.sums)])
        whole = "cast({} as decimal(38,0))"
        parts = []
        for i, s in enumerate(self.sums):
            apart = f"try_subtract(try_multiply({whole.format(f'x[{i}]')}, {whole.format(f'{self.n}L')}), {whole.format(repr(str(s)))})"
            parts.append(f"try_multiply({apart}, {apart})")
        return f"try_cast({reduce(lambda a, b: f'try_add({a}, {b})', parts)} as bigint)"


def _added(parts: list[str]) -> str:
    """The sum as a balanced tree, whose depth grows with the logarithm."""
    while len(parts) > 1:
        parts = [f"({' + '.join(parts[i : i + 2])})" for i in range(0, len(parts), 2)]
    return parts[0]


def integer_vectors(rows: DataFrame, *, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """rows whose vector is whole and finite, with x: array<bigint>, the floor of every entry times scale."""
    sound = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return rows.where(F.col(vector).isNotNull() & sound).withColumn("x", F.transform(vector, lambda v: F.floor(v.cast("double") * scale)))


def fit_whitening(distinct: DataFrame, size: int, components: int) -> Whitening | None:
    """Of the distinct vectors x that have this size; None if no component has variance."""
    own = distinct.where(F.size("x") == size)
    each = [f"{f}(x[{i}]) as {f}_{i}" for f in ("min", "max") for i in range(size)]
    found = own.selectExpr("count(*) as n", *(f"sum(cast(x[{i}] as decimal(28,0))) as sum_{i}" for i in range(size)), *each).first()
    of = lambda f: [int(found[f"{f}_{i}"]) for i in range(size)]
    made = Whitening(size, found["n"], of("sum"), of("min"), of("max"), np.empty(0), np.empty((size, 0)), 0.0)
    wide = own.selectExpr(*(f"coalesce({made.centred(i)}, 0D) as c{i}" for i in range(size)))  # never null, which spares each sum its test for nulls
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    covariance = np.zeros((size, size))
    for first in range(0, len(pairs), PAIRS):
        part = pairs[first : first + PAIRS]
        sums = wide.selectExpr(*(f"sum(c{i} * c{j}) as s{k}" for k, (i, j) in enumerate(part))).first()
        for (i, j), s in zip(part, sums, strict=True):
            covariance[i, j] = covariance[j, i] = s / made.n
    made.trace = float(np.trace(covariance))
    values, vectors = np.linalg.eigh(covariance)
    kept = [k for k in np.argsort(-values, kind="stable")[:components] if values[k] > NONE * made.trace]
    made.variances, made.components = values[kept], vectors[:, kept]
    made.components = made.components * np.sign(made.components[np.abs(made.components).argmax(axis=0), range(len(kept))]) if kept else made.components
    return made if kept else None


def identity_error(distinct: DataFrame, model: Whitening) -> float:
    """The largest entry by which the covariance of the whitened distinct vectors differs from the identity."""
    k = len(model.variances)
    scored = distinct.where(F.size("x") == model.size).selectExpr(*(f"{e} as w{i}" for i, e in enumerate(model.scores([model.centred(i) for i in range(model.size)]))))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = scored.selectExpr(*(f"covar_pop(w{i}, w{j})" for i, j in pairs)).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = 4, scale: int = 256) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of every sound row and component."""
    sound = integer_vectors(rows.select(F.col(key), F.col(vector)), vector=vector, scale=scale).select(F.col(key).alias("_key"), "x")
    distinct = durable(sound.select("x").distinct(), "distinct-vectors")
    out = rows.sparkSession.createDataFrame([], f"`{key}` {rows.schema[key].dataType.simpleString()}, {_KINDS}")
    for size in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):
        model = fit_whitening(distinct, size, components) if size else None
        if model is None:
            continue
        error = identity_error(distinct, model)
        named = sound.where(F.size("x") == size).selectExpr("_key", f"{model.deviation()} as deviation", *(f"{model.centred(i)} as c{i}" for i in range(size)))
        each = [
            f"struct({k + 1} as component, {score} as whitened, ({float(e / model.trace)!r}D) as explained)"
            for k, (score, e) in enumerate(zip(model.scores([f"c{i}" for i in range(size)]), model.variances, strict=True))
        ]
        found = named.selectExpr("_key", "deviation", f"explode(array({', '.join(each)})) as s").selectExpr(
            f"_key as `{key}`", "s.component as component", f"{model.n}L as n", "deviation", "s.whitened as whitened", "s.explained as explained", f"({error!r}D) as identity_error"
        )
        out = out.union(found)
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of the first four components."""
    return whiten(table(spark, sf_dir, "embeddings"))
