"""Approximate nearest neighbours by a permutation index.

A vector is represented by its LENGTH nearest pivots, nearest first. The index
keeps, in blocks of vectors, an inverted file for each pivot: the vectors that
have it and at which place. A query adds up, over the files of its own pivots,
what a shared pivot takes off the footrule distance of the two orders (a pivot
that is missing counts as at place LENGTH), takes the closest share of each block, and ranks
these again by the cosine of the original vectors in double precision.

The pivots are the PIVOTS vectors of the smallest hash, for each dimension. All
vectors are indexed. Equal vectors are one entry with its smallest ids, as many as a
result can hold, so copies neither crowd a block nor a result; that is exact.
Queries and entries meet block by block: a task has one block of either.

Rows whose id or vector is null, or whose vector is empty, zero or holds null or non-finite
components, take no part. Vectors of unlike dimension aren't compared. A repeated
row is a candidate of its own; a query leaves out one row of its own id. Ties go to the smaller id. Empty tables give
empty results.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._common import durable, table

PIVOTS, LENGTH = 128, 64
#: Share of a block, and least number, that is ranked by cosine.
SHARE, LEAST = 0.3, 256
INDEX_BLOCK, QUERY_BLOCK = 8192, 2048
NEIGHBOURS = 5


def unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that squares neither overflow nor vanish."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """rows: on original vectors, in double precision. Halving or doubling a vector as a whole changes no digit of its cosine, and keeps squares in range."""
    query = np.ldexp(query, -np.frexp(np.abs(query).max())[1])
    rows = np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])
    return (rows @ query) / (np.sqrt(query @ query) * np.sqrt((rows * rows).sum(axis=1)))


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    return np.argsort(-(unit(vectors) @ unit(pivots).T), axis=1, kind="stable")[:, :length]


class InvertedFiles:
    """One block: for each pivot the entries that have it and their places."""

    def __init__(self, vectors: np.ndarray, pivots: np.ndarray, length: int):
        self.length, self.size = min(length, len(pivots)), len(vectors)
        orders = nearest_pivots(vectors, pivots, self.length)
        flat = orders.ravel()
        by_pivot = np.argsort(flat, kind="stable")
        ends = np.searchsorted(flat[by_pivot], np.arange(len(pivots) + 1))
        self.files = [(by_pivot[a:b] // self.length, by_pivot[a:b] % self.length) for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def closest(self, order: np.ndarray, count: int) -> np.ndarray:
        """Entries of the smallest footrule distance: of the largest sum of (length - the later place) over shared pivots."""
        gain = np.zeros(self.size, dtype=np.int64)
        for place, pivot in enumerate(order):
            entries, places = self.files[pivot]
            gain[entries] += self.length - np.maximum(places, place)
        if count >= self.size:
            return np.arange(self.size)
        return np.argpartition(-gain, count)[:count]


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """_id, _v: array<double>, _dim, _h1, _h2 of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    rows = rows.select(F.col(key).alias("_id"), v.alias("_v")).where(
        F.col("_id").isNotNull() & F.col("_v").isNotNull()
    )
    v = F.col("_v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = rows.where(finite & F.exists(v, lambda x: x != 0)).withColumn("_v", F.transform("_v", lambda x: x + F.lit(0.0)))  # no -0
    return rows.select("_id", "_v", F.size("_v").alias("_dim"), F.xxhash64("_v").alias("_h1"), F.xxhash64(F.reverse("_v"), F.lit(1)).alias("_h2"))


def search(
    rows: DataFrame,
    queries,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = NEIGHBOURS,
    pivots: int = PIVOTS,
    length: int = LENGTH,
    share: float = SHARE,
    least: int = LEAST,
    index_block: int = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score. queries: a condition on the column _id."""
    spark = rows.sparkSession
    entry = ["_h1", "_h2"]
    all_rows = durable(usable(rows, key, vector), "vectors")
    # equal vectors: their smallest ids, at most one more than a result holds
    few = all_rows.withColumn("_n", F.row_number().over(Window.partitionBy(*entry).orderBy("_id"))).where(F.col("_n") <= k + 1)
    entries = durable(
        few.groupBy(*entry).agg(F.array_sort(F.collect_list("_id")).alias("_ids"), F.min_by("_v", "_n").alias("_v"), F.first("_dim").alias("_dim")),
        "entries",
    )
    asked = all_rows.where(queries).select(F.col("_id").alias("query_id"), *entry)
    wanted = entries.join(asked.select(*entry).distinct(), entry, "left_semi")
    by_hash = Window.partitionBy("_dim").orderBy(*entry)
    chosen = entries.select("_dim", "_v", *entry).withColumn("_n", F.row_number().over(by_hash)).where(F.col("_n") <= pivots).toPandas()
    by_dim = {int(d): np.stack(g.sort_values("_n")["_v"].to_list()) for d, g in chosen.groupby("_dim")} if len(chosen) else {}
    sent = spark.sparkContext.broadcast(by_dim)  # pivots rows for each dimension
    n, q = entries.count(), wanted.count()
    index_blocks, query_blocks = max(1, -(-n // index_block)), max(1, -(-q // query_block))

    def dealt(df: DataFrame, own: str, blocks: int, other: str, copies: int) -> DataFrame:
        """A block of its own by hash, and a copy for every block of the other side."""
        return df.withColumn(own, F.pmod(F.xxhash64(*entry), F.lit(blocks))).withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(copies - 1).cast("long"))))

    index = dealt(entries.select(*entry, "_v", "_dim", F.element_at("_ids", 1).alias("_first")), "_ib", index_blocks, "_qb", query_blocks)
    asking = dealt(wanted.select(*entry, "_v", "_dim"), "_qb", query_blocks, "_ib", index_blocks)
    asking = asking.toDF(*(f"q{c}" for c in asking.columns))
    top = k + 1  # the query's own entry is among them

    def meet(block: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        out = {c: [] for c in ("q1", "q2", "e1", "e2", "first", "score")}
        if len(block) and len(ask):
            own = sent.value[int(block["_dim"].iloc[0])]
            vectors, firsts = np.stack(block["_v"].to_list()), block["_first"].to_numpy()
            files = InvertedFiles(vectors, own, length)
            h1, h2 = block["_h1"].to_numpy(), block["_h2"].to_numpy()
            asked_vectors = np.stack(ask["q_v"].to_list())
            orders = nearest_pivots(asked_vectors, own, files.length)
            count = min(len(block), max(least, int(np.ceil(share * len(block)))))
            for i, (a, b) in enumerate(zip(ask["q_h1"], ask["q_h2"], strict=True)):
                near = files.closest(orders[i], count)
                score = cosines(asked_vectors[i], vectors[near])
                best = np.lexsort((firsts[near], -score))[:top]
                for c, values in zip(out, ([a] * len(best), [b] * len(best), h1[near[best]], h2[near[best]], firsts[near[best]], score[best]), strict=True):
                    out[c].extend(values)
        return pd.DataFrame(out)

    key_kind = all_rows.schema["_id"].dataType.simpleString()
    met = (
        index.groupBy("_dim", "_ib", "_qb")
        .cogroup(asking.groupBy("q_dim", "q_ib", "q_qb"))
        .applyInPandas(meet, f"q1 long, q2 long, e1 long, e2 long, first {key_kind}, score double")
    )
    by_query = Window.partitionBy("q1", "q2").orderBy(F.desc("score"), "first", "e1", "e2")
    best = met.withColumn("n", F.row_number().over(by_query)).where(F.col("n") <= top)
    with_ids = best.join(entries.select(F.col("_h1").alias("e1"), F.col("_h2").alias("e2"), "_ids"), ["e1", "e2"])
    # ids of all entries found for a query, nearest first: at most (k + 1)^2
    found = with_ids.groupBy("q1", "q2").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "_ids")).alias("found"))
    listed = found.select(
        F.col("q1").alias("_h1"), F.col("q2").alias("_h2"),
        F.array_sort(F.flatten(F.transform("found", lambda x: F.transform(x["_ids"], lambda i: F.struct(x["s"].alias("s"), i.alias("i")))))).alias("found"),
    )
    answers = asked.join(listed, entry).select(
        "query_id",
        F.posexplode(F.slice(F.expr("""concat(
            slice(found, 1, coalesce(nullif(array_position(transform(found, x -> x.i), query_id), 0), size(found) + 1) - 1),
            slice(found, coalesce(nullif(array_position(transform(found, x -> x.i), query_id), 0), size(found)) + 1, size(found)))"""), 1, k)).alias("_p", "_f"),
    )
    return answers.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_f.i").alias(key), (-F.col("_f.s")).alias("score"))


def op1_permutation_index(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("_id") % 50 == 0)
