"""Conflict-constrained best-fit packing of documents into training sequences.

Bins are kept by residual space. A document goes to the bin of the smallest
residual that holds it and does not conflict: a bin carries bitmaps of its
sources and of its duplicate clusters, and the search goes from residual to
residual, from bin to bin, until the tightest compatible bin is found; without one, a new bin is opened.
A bin holds no two documents of a duplicate cluster and at most
`per_source` pieces of a source (one bitmap for each of these).

A document longer than a bin is cut into whole bins and a rest; its whole
pieces fill bins alone, so no text is dropped. Documents without words take no
room and get no bin.

Rows are dealt to shards by a hash of the id, so that shards are alike whatever
the sources and clusters are, hot ones included. A shard holds about SHARD
pieces; their number follows the number of rows. Each shard is packed on its own, longest
pieces first; what that costs is the last bins of each shard.

Null texts and sources: no words, and a source of their own. Repeated ids are dealt and packed row by
row; equal texts are one duplicate cluster unless a cluster column is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import durable, table

CAPACITY = 4096
PER_SOURCE = 4
#: Pieces that a shard holds on average.
SHARD = 20_000


class Bins:
    """Open bins of one shard."""

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]  # bins by residual, in order of arrival
        self.some = 0  # bit r: there is a bin of residual r
        self.sources: list[list[int]] = []  # a bin's bitmaps: bit s of the n-th: over n pieces of source s
        self.clusters: list[int] = []
        self.used: list[int] = []
        self.common: list[int] = [0] * (capacity + 1)  # sources that all bins of a residual have in full

    def open(self) -> int:
        self.sources.append([0] * self.per_source)
        self.clusters.append(0)
        self.used.append(0)
        return len(self.used) - 1

    def tightest(self, size: int, source: int, cluster: int) -> int | None:
        """The compatible bin of the smallest residual that holds size; residual by residual upwards."""
        left = self.some >> size
        residual = size
        while left:
            step = (left & -left).bit_length() - 1
            residual += step
            left >>= step
            if not self.common[residual] & source:
                everywhere = -1
                for b in self.at[residual]:
                    full = self.sources[b][-1]
                    if not full & source and not self.clusters[b] & cluster:
                        return b
                    everywhere &= full
                self.common[residual] = max(everywhere, 0)
            left >>= 1
            residual += 1
        return None

    def put(self, size: int, source: int, cluster: int) -> int:
        b = self.tightest(size, source, cluster)
        if b is None:
            b = self.open()
        else:
            old = self.capacity - self.used[b]
            del self.at[old][b]
            if not self.at[old]:
                self.some &= ~(1 << old)
                self.common[old] = 0
        maps = self.sources[b]
        carry = source
        for i in range(self.per_source):  # a piece moves to the next bitmap where the source has a bit
            maps[i], carry = maps[i] | carry, maps[i] & carry
        self.clusters[b] |= cluster
        self.used[b] += size
        new = self.capacity - self.used[b]
        if new:
            if self.at[new]:
                self.common[new] &= maps[-1]
            else:
                self.common[new] = maps[-1]
            self.at[new][b] = None
            self.some |= 1 << new
        return b


def _bits(values: pd.Series) -> list[int]:
    """A bit for each distinct value of the shard; none for a value that is there once."""
    codes, names = pd.factorize(values, use_na_sentinel=False)
    many = np.bincount(codes, minlength=len(names)) > 1
    place = np.cumsum(many) - 1
    return [1 << int(place[c]) if many[c] else 0 for c in codes]


def packed(rows: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """bin (in the shard) and offset of each row of one shard: row, size (at most capacity), source, cluster."""
    rows = rows.sort_values(["size", "row"], ascending=[False, True], kind="stable").reset_index(drop=True)
    bins = Bins(capacity, per_source)
    where, offset = [], []
    for size, source, cluster in zip(rows["size"].tolist(), _bits(rows["source"]), _bits(rows["cluster"]), strict=True):
        b = bins.put(size, source, cluster)
        where.append(b)
        offset.append(bins.used[b] - size)
    return rows.assign(bin=np.array(where, dtype=np.int64), offset=np.array(offset, dtype=np.int64))


def n_words(column: str):
    """Words between ASCII white space; null has none."""
    text = F.coalesce(F.col(column), F.lit(""))
    apart = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(apart, " "), lambda w: w != "")).cast("long")


def pack(
    docs: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    cluster: str | None = None,
    capacity: int = CAPACITY,
    per_source: int = PER_SOURCE,
    shard: int = SHARD,
) -> DataFrame:
    """key, piece (from 0), start (first word of the piece), n_tokens, bin_id and offset in the bin of every piece.

    A row without words is a piece of no tokens without a bin.
    """
    sized = durable(
        docs.select(
            F.monotonically_increasing_id().alias("_row"),
            F.col(key),
            n_words(text).alias("_n"),
            F.col(source).cast("string").alias("_source"),
            (F.xxhash64(text) if cluster is None else F.xxhash64(cluster)).alias("_cluster"),
        ),
        "packing",
    )
    whole = (F.col("_n") / capacity).cast("long")
    count = sized.agg(F.sum((F.col("_n") % capacity > 0).cast("long")).alias("n")).first()["n"] or 0
    shards = max(1, -(-count // shard))
    rest = sized.where(F.col("_n") % capacity > 0).select(
        "_row", key, (F.col("_n") % capacity).alias("size"), whole.alias("piece"), "_source", "_cluster",
        F.pmod(F.xxhash64("_row", key), F.lit(shards)).alias("shard"),
    )
    kind = docs.schema[key].dataType.simpleString()

    def run(group: pd.DataFrame) -> pd.DataFrame:
        rows = packed(group.rename(columns={"_row": "row", "_source": "source", "_cluster": "cluster"}), capacity, per_source)
        return pd.DataFrame(
            {key: rows[key], "piece": rows["piece"], "start": rows["piece"] * capacity, "n_tokens": rows["size"], "bin_id": "s" + rows["shard"].astype(str) + "-" + rows["bin"].astype(str), "offset": rows["offset"]}
        )

    rests = rest.groupBy("shard").applyInPandas(run, f"`{key}` {kind}, piece long, start long, n_tokens long, bin_id string, offset long")
    # whole bins: named by row and piece
    wholes = sized.where(whole > 0).select("_row", key, F.explode(F.sequence(F.lit(0), whole - 1)).alias("piece")).select(
        key, F.col("piece").cast("long"), (F.col("piece") * capacity).cast("long").alias("start"), F.lit(capacity).cast("long").alias("n_tokens"),
        F.concat_ws("-", F.lit("w"), "_row", "piece").alias("bin_id"), F.lit(0).cast("long").alias("offset"),
    )
    nothing = F.lit(None).cast("long")
    empty = sized.where("_n = 0").select(
        key, F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("n_tokens"), F.lit(None).cast("string").alias("bin_id"), nothing.alias("offset")
    )
    return rests.unionByName(wholes).unionByName(empty)


def op3_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
