"""Toxicity by cumulative-link ordinal regression.

P(grade > k) = sigmoid(w . x - t_k) with one weight vector for all grades and
rising thresholds t_0 < t_1 < ..; the expected severity is the sum of these
probabilities. x holds log(1 + count) of selected words.

Grades come from the labels alone, never from the words: 0 is a document that isn't toxic, 1 a toxic one of good
quality, 2 a toxic one of bad quality (without a quality label: 1). The model is fitted on a bounded sample of
labelled rows: at most `sample` of each label, those of the smallest hash of
the id. Everything else covers all rows.

Words are selected by chi-square of their presence against the label, out of those in LEAST_DOCS sampled
documents. How pure a selected word must be and the ridge are chosen by FOLDS-fold cross-validation inside the
sample; words are selected anew in each fold, from its own training part. The weights may have either sign.

Null and empty texts have no word and get the model's floor. A document labelled more than once
counts as toxic if one label says so; of an id with several texts that of the smallest hash is learned from. Labels without a document and
null labels are not used. Without toxic labels, or without others, in the sample every score is 0. Ties between words go to
the smaller hash. Repeated rows are scored one by one; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import WordTable, durable, signed, table, text_bytes

#: Labelled documents of each label that the fit may use.
SAMPLE = 4000
#: Words that the model may weigh, and the sampled documents each must be in.
FEATURES, LEAST_DOCS = 2000, 10
GRADES = 2
#: What cross-validation chooses from: the least share of toxic ones among a word's sampled documents, and the ridge.
PURITIES, RIDGES = (0.0, 0.5, 0.9), (1e-5, 1e-3)
FOLDS = 3

_EDGES = b".,;:!?\"'()[]{}*$%&#<>|-_"


def feature(word: bytes) -> int:
    """64-bit hash of a lower-cased word without punctuation at its ends; 0 if nothing is left."""
    word = word.strip(_EDGES)
    return xxhash.xxh64_intdigest(word) if word else 0


@dataclass
class OrdinalModel:
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray

    def above(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, a row per text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - z[:, None], -40, 40)))


def bag_of_words(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """keep, n_words, and the distinct features and their counts of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(lambda w: feature(w).to_bytes(8, "little"))
        for batch in batches:
            features, counts, totals = [], [], []
            for t in batch.column("_text"):
                h = np.frombuffer(b"".join(map(words.__getitem__, t.as_py().lower().split())), dtype=np.uint64)
                h, n = np.unique(h[h != 0], return_counts=True)
                features.append(signed(h))
                counts.append(n.astype(np.int64))
                totals.append(int(n.sum()))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in keep), pa.array(totals, pa.int64()), pa.array(features, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                names=[*keep, "n_words", "features", "counts"],
            )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, text_bytes(text).alias("_text")).mapInArrow(run, f"{kinds}, n_words long, features array<long>, counts array<long>")


def labelled_sample(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic, grade and fold of the rows of at most 2 * sample ids; as few are sent to the documents, which aren't shuffled."""
    poor = F.coalesce(F.col("quality") == 0, F.lit(False))
    grade = F.when(F.col("toxic") > 0, F.when(poor, 2).otherwise(1)).otherwise(0)
    one = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max(grade).alias("grade"))
    ranked = [one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    chosen = ranked[0].unionByName(ranked[1])
    fold = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)).cast("int")
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("*", fold.alias("fold"), F.xxhash64("text").alias("h"))


def _chi(df, bad, n, n_bad):
    """Chi-square of presence against the label; for columns and arrays alike."""
    expected = df * n_bad / n
    return (bad - expected) * (bad - expected) / (expected * (1 - n_bad / n) * (1 - df / (n + 1.0)))


def telling_words(bags: DataFrame, n: int, n_bad: int, count: int = FEATURES) -> DataFrame:
    """The `count` features of the largest chi-square with, for each fold, the documents (df) and toxic documents (bad) that they are in."""
    each = bags.select(F.explode("features").alias("feature"), "toxic", "fold")
    sums = [f(F.when(F.col("fold") == k, v).otherwise(0)).alias(f"{name}{k}") for k in range(FOLDS) for name, v, f in (("df", F.lit(1), F.sum), ("bad", F.col("toxic"), F.sum))]
    counted = each.groupBy("feature").agg(*sums)
    df, bad = (sum((F.col(f"{name}{k}") for k in range(FOLDS)), F.lit(0)) for name in ("df", "bad"))
    least = min(LEAST_DOCS, max(2, n_bad // 10))
    return counted.where(df >= least).withColumn("chi", _chi(df, bad, float(n), float(n_bad))).orderBy(F.desc("chi"), "feature").limit(count)


def _fitted(x, doc, column, grade: np.ndarray, columns: int, ridge: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """weights and thresholds by gradient steps (Adam) on the mean log-loss of the cumulative links; both labels weigh the same."""
    n, toxic = len(grade), grade > 0
    weights, gaps = np.zeros(columns), np.zeros(GRADES)  # t_0, then logs of the rises
    m, s = [[np.zeros_like(v) for v in (weights, gaps)] for _ in range(2)]
    above = grade[:, None] > np.arange(GRADES)[None, :]
    balance = np.where(toxic, n / (2 * toxic.sum()), n / (2 * (~toxic).sum()))
    for step in range(1, rounds + 1):
        rises = np.exp(np.append(0, gaps[1:]))
        thresholds = gaps[0] + np.append(0, np.cumsum(rises[1:]))
        z = np.bincount(doc, weights=weights[column] * x, minlength=n)
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - z[:, None], -40, 40)))
        error = (p - above) * balance[:, None] / n
        dt = -error.sum(axis=0)
        tail = np.cumsum(dt[::-1])[::-1]
        grads = [np.bincount(column, weights=error.sum(axis=1)[doc] * x, minlength=columns) + ridge * weights, np.append(tail[0], tail[1:] * rises[1:])]
        for i, (value, g) in enumerate(zip((weights, gaps), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            value -= 0.1 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-8)
    return weights, gaps[0] + np.append(0, np.cumsum(np.exp(gaps[1:])))


def fit(rows: pa.Table, told: pa.Table, words: pa.Table, rounds: int = 300) -> OrdinalModel:
    """On the driver, over the bounded sample: rows (doc_id, grade, fold) by id, told (doc_id, at, n) of the places among at most FEATURES words."""
    grade, fold = (rows.column(c).to_numpy().astype(int) for c in ("grade", "fold"))
    toxic = grade > 0
    nothing = OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.full(GRADES, 40.0))
    if not len(words) or not toxic.any() or toxic.all():
        return nothing
    names = words.column("feature").to_numpy().astype(np.int64).view(np.uint64)
    df, bad = (np.stack([words.column(f"{c}{k}").to_numpy().astype(float) for k in range(FOLDS)]) for c in ("df", "bad"))
    doc = np.searchsorted(rows.column("doc_id").to_numpy(), told.column("doc_id").to_numpy())
    at, x = told.column("at").to_numpy().astype(int), np.log1p(told.column("n").to_numpy().astype(float))
    order = np.lexsort((at, doc))  # sums in one order, so that results don't depend on the tasks
    doc, at, x = doc[order], at[order], x[order]

    def selected(folds: list[int], purity: float) -> np.ndarray:
        d, b = df[folds].sum(axis=0), bad[folds].sum(axis=0)
        own = np.isin(fold, folds)
        with np.errstate(all="ignore"):
            chi = _chi(d, b, float(own.sum()), float((own & toxic).sum()))
        return (d >= 2) & (b >= purity * d) & (np.nan_to_num(chi) >= 10.83)  # one word in a thousand by chance

    def run(folds: list[int], purity: float, ridge: float):
        keep = selected(folds, purity)
        place = np.cumsum(keep) - 1
        own = np.flatnonzero(np.isin(fold, folds))
        new = np.full(len(rows), -1)
        new[own] = np.arange(len(own))
        use = keep[at] & (new[doc] >= 0)
        weights, thresholds = _fitted(x[use], new[doc[use]], place[at[use]], grade[own], int(keep.sum()), ridge, rounds)
        full = np.zeros(len(names))
        full[keep] = weights
        return full, thresholds, keep

    best = None
    for purity in PURITIES:
        for ridge in RIDGES:
            right, tried = np.zeros(2), np.zeros(2)
            for k in range(FOLDS):
                train = [j for j in range(FOLDS) if j != k]
                inside = np.isin(fold, train)
                if not toxic[inside].any() or toxic[inside].all():
                    continue
                weights, thresholds, _ = run(train, purity, ridge)
                said = np.bincount(doc, weights=weights[at] * x, minlength=len(rows)) >= thresholds[0]
                for y in (0, 1):
                    held = (fold == k) & (toxic == y)
                    right[y] += (said == toxic)[held].sum()
                    tried[y] += held.sum()
            value = (right / np.maximum(tried, 1)).sum()
            if best is None or value > best[0]:
                best = (value, purity, ridge)
    weights, thresholds, keep = run(list(range(FOLDS)), *best[1:])
    order = np.argsort(names[keep])
    return OrdinalModel(names[keep][order], weights[keep][order], thresholds)


def score(docs: DataFrame, model: OrdinalModel, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, severity (expected grade), p_toxic = P(grade > 0) and toxic (p_toxic >= 0.5) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most FEATURES weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: OrdinalModel = sent.value
        places = {int(h): i for i, h in enumerate(m.features)}
        words = WordTable(lambda w: places.get(feature(w), -1).to_bytes(2, "little", signed=True))
        for batch in batches:
            z = np.zeros(batch.num_rows)
            for i, t in enumerate(batch.column("_text")):
                at = np.frombuffer(b"".join(map(words.__getitem__, t.as_py().lower().split())), dtype="<i2")
                at, n = np.unique(at[at >= 0], return_counts=True)
                z[i] = (m.weights[at] * np.log1p(n)).sum()
            above = m.above(z)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pa.array(above.sum(axis=1)), pa.array(above[:, 0]), pa.array(above[:, 0] >= 0.5)],
                names=[key, "severity", "p_toxic", "toxic"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text_bytes(text).alias("_text")).mapInArrow(run, f"`{key}` {kind}, severity double, p_toxic double, toxic boolean")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """What comes to the driver: at most FEATURES words, and for 2 * sample rows the counts of these words."""
    own = ["doc_id", "toxic", "grade", "fold"]
    read = durable(bag_of_words(labelled_sample(docs, labels, sample), [*own, "h"]), "toxic-read")
    bags = durable(read.groupBy(*own).agg(F.min(F.struct("h", "features", "counts")).alias("b")).select(*own, "b.features", "b.counts"), "toxic-bags")
    n, n_bad = bags.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < n_bad < n:
        return OrdinalModel(np.empty(0, np.uint64), np.empty(0), np.full(GRADES, 40.0))
    words = telling_words(bags, n, n_bad).toArrow()
    places = bags.sparkSession.createDataFrame([(int(h), i) for i, h in enumerate(words.column("feature").to_pylist())], "feature long, at int")
    told = bags.select("doc_id", F.explode(F.arrays_zip("features", "counts")).alias("f")).join(F.broadcast(places), F.col("f.features") == F.col("feature"))
    rows = bags.select("doc_id", "grade", "fold").toArrow().sort_by("doc_id")
    return fit(rows, told.select("doc_id", "at", F.col("f.counts").alias("n")).toArrow(), words)


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, trained(docs, labels, sample))


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
