"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import shared_folder

__all__ = ["WordTable", "discard", "durable", "hash_table", "mixed", "shared_folder", "shingle_hashes", "signed", "table", "text_bytes", "word_hashes"]

#: Entries a worker keeps in a word table before it starts a new one; bounds a worker's memory.
WORD_TABLE = 400_000
#: Spark keeps the shuffles of a query until the driver collects its garbage; with this setting they go when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: cuts the lineage and outlives executors. The shuffles of the write go with it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes what durable() wrote for these; whatever was computed from them must have been written itself."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WordTable(dict):
    """word -> value, each distinct word computed once; starts anew when full."""

    def __init__(self, compute: Callable[[bytes], object], limit: int = WORD_TABLE):
        super().__init__()
        self.compute, self.limit = compute, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = self.compute(word)
        return value


def hash_table(limit: int = WORD_TABLE) -> WordTable:
    """word -> the 8 bytes of its xxHash64."""
    return WordTable(lambda w: xxhash.xxh64_intdigest(w).to_bytes(8, "little"), limit)


def word_hashes(words: list[bytes], hashes: WordTable) -> np.ndarray:
    return np.frombuffer(b"".join(map(hashes.__getitem__, words)), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every window of width words, in order; of the whole sequence if it is shorter; none of no words."""
    if not len(hashes):
        return hashes
    width = min(width, len(hashes))
    count = len(hashes) - width + 1
    out = np.full(count, 0x9E3779B97F4A7C15 + width, dtype=np.uint64)
    for i in range(width):
        out = mixed(out * np.uint64(0x2545F4914F6CDD1D) + hashes[i : i + count])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def text_bytes(column: str = "text"):
    """The UTF-8 bytes of a text column; null as empty. bytes.split() and bytes.lower() know ASCII only, as the contracts ask."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary")
