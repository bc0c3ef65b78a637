"""Where steps keep files, and how tasks open them."""

from __future__ import annotations

import tempfile
from typing import BinaryIO

from pyarrow import fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset a temporary one, on a local master only: other machines wouldn't see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        own = spark.sparkContext.getCheckpointDir()
        if own is None:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir is not set: steps need a folder that all machines share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            own = spark.sparkContext.getCheckpointDir()
        folder = own
    return folder.rstrip("/")


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if path.startswith("/"):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def read_exactly(file: BinaryIO, n: int) -> bytes:
    """n bytes, however few each read gives; EOFError if there are fewer."""
    parts, missing = [], n
    while missing:
        part = file.read(missing)
        if not part:
            raise EOFError(f"incomplete: {n - missing}/{n} bytes")
        parts.append(part)
        missing -= len(part)
    return b"".join(parts)
