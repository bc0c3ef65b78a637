"""A table by recording whose writes may be repeated: each replaces the rows of its own recordings, all at once.

A write goes through three steps: its rows, and the recordings it covers, are written to a folder of the batch; then an entry of the log names the batch. The entry
is the commit: it appears whole, by a rename, or not at all. Readers take, of each recording, the rows of the last committed batch that covers it,
so a recording that a rerun finds nothing in has no rows any more. What a killed write leaves has no entry, and is never read; the next write of the same
batch removes it. A batch whose entry exists isn't written again, which makes foreachBatch exact. There is one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.storage import store_of

_LOG, _BATCHES = "_log", "batches"


def _entries(path: str) -> list[dict]:
    store, folder = store_of(path)
    files = store.get_file_info(fs.FileSelector(f"{folder}/{_LOG}", allow_not_found=True))
    found = []
    for f in sorted((f for f in files if f.base_name.endswith(".json") and not f.base_name.startswith(".")), key=lambda f: f.base_name):
        with store.open_input_stream(f.path) as file:
            found.append(json.loads(file.read()) | {"number": int(f.base_name.removesuffix(".json"))})
    return found


def _commit(path: str, entry: dict, number: int) -> None:
    store, folder = store_of(path)
    store.create_dir(f"{folder}/{_LOG}", recursive=True)
    staged = f"{folder}/{_LOG}/.{number:012d}"
    with store.open_output_stream(staged) as out:
        out.write(json.dumps(entry).encode())
    store.move(staged, f"{folder}/{_LOG}/{number:012d}.json")


def replace_recordings(rows: DataFrame, recordings: DataFrame, path: str, batch: str, *, key: str = "media_id") -> bool:
    """Commits rows as all that the recordings (a column of key) have; False if the batch was committed before, and so is left as it is.

    Rows of other recordings are an error of the caller, and are left out.
    """
    entries = _entries(path)
    if any(e["batch"] == batch for e in entries):
        return False
    at = f"{path.rstrip('/')}/{_BATCHES}/{quote(batch, safe='')}"
    store, folder = store_of(at)
    if store.get_file_info(folder).type == fs.FileType.Directory:
        store.delete_dir(folder)
    recordings.select(key).where(F.col(key).isNotNull()).distinct().write.parquet(f"{at}/recordings")
    covered = rows.sparkSession.read.parquet(f"{at}/recordings")
    rows.join(covered, key, "left_semi").select(rows.columns).write.parquet(f"{at}/rows")
    _commit(path, {"batch": batch, "at": quote(batch, safe=""), "columns": rows.columns}, max((e["number"] for e in entries), default=0) + 1)
    return True


def read_recordings(spark: SparkSession, path: str, *, key: str = "media_id") -> DataFrame:
    """The rows of each recording's last committed batch."""
    entries = _entries(path)
    if not entries:
        raise FileNotFoundError(f"{path}: nothing was committed")
    folders = [f"{path.rstrip('/')}/{_BATCHES}/{e['at']}" for e in entries]
    covered = rows = None
    for number, folder in enumerate(folders):
        tagged = [spark.read.parquet(f"{folder}/{part}").withColumn("_batch", F.lit(number)) for part in ("recordings", "rows")]
        covered, rows = (b if a is None else a.unionByName(b, allowMissingColumns=True) for a, b in zip((covered, rows), tagged, strict=True))
    last = covered.groupBy(key).agg(F.max("_batch").alias("_batch"))
    return rows.join(last, [key, "_batch"], "left_semi").drop("_batch")


def compact(spark: SparkSession, path: str, batch: str, *, key: str = "media_id") -> None:
    """One batch of all that counts, committed as any other; batches before it are then no longer needed, and go."""
    before = _entries(path)
    folders = [f"{path.rstrip('/')}/{_BATCHES}/{e['at']}" for e in before]
    everything = spark.read.parquet(*[f"{f}/recordings" for f in folders])
    if replace_recordings(read_recordings(spark, path, key=key), everything, path, batch, key=key):
        store, folder = store_of(path)
        for e, f in zip(before, folders, strict=True):
            store.delete_file(f"{folder}/{_LOG}/{e['number']:012d}.json")
            store.delete_dir(store_of(f)[1])


def replacing(path: str, *, name: str, key: str = "media_id", recordings: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each micro-batch of a query of this name replaces the recordings it has rows of, or those that recordings(batch) names."""

    def write(rows: DataFrame, number: int) -> None:
        kept = rows.persist()
        try:
            replace_recordings(kept, recordings(kept) if recordings else kept, path, f"{name}-{number}", key=key)
        finally:
            kept.unpersist()

    return write
