"""Token ids in binary files: one wavelet matrix per shard.

write_tokens() encodes texts and writes their ids, in ascending order of a key, through a data source; each shard is one
file, and holds whole documents. Level by level, from the highest bit of an id to the lowest, a shard keeps one bit of every id
and deals the ids stably into those of bit 0 and those of bit 1. A plane of bits is cut into blocks, each compressed on its own, with
the number of ones before it, so a lookup decompresses one block a level or two. An id is read by following its bits down (access), an
id's occurrences are counted by following a range down (rank), and placed by going back up (select). All ids of a shard come
back by undoing the levels from the last to the first.

A task writes files under names of its own attempt; only those that the manifest names count, and the driver writes it when all
tasks are done, so a task of a lost executor is simply run again. The manifest has a line for each task; where a shard starts inside its
task stands in the shard.

Null and empty texts have no ids but the end id. A null key comes first. Rows of equal keys are ordered by a hash of the
text; equal rows follow each other. An empty table gives no file and no row. Very long texts make a longer shard. Other columns take no
part, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import accumulate, chain, compress, count, repeat
from operator import is_
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tidemark.llm._common import shared_folder, table
from tidemark.sources.storage import store_of

MAGIC = b"TIDEWM01"
MANIFEST = "_manifest.json"
#: Bits of a block of a plane, ids after which a shard ends, and pieces a worker remembers.
BLOCK, SHARD, PIECES = 1 << 15, 1 << 22, 1_200_000
#: Bytes of text that a worker encodes at once.
TEXTS = 1 << 20
#: Bytes of ids of a batch that the reader returns.
BATCH = 1 << 22

# ---- texts to ids


#: Characters whose class is the same in every version of Unicode: white space, printable ASCII, letters of Latin, Greek, Cyrillic, Han and Hangul.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁҊ-ӿ一-鿪가-힣]")
_LETTER, _DIGIT, _SIGN, _SPACE, _END = range(5)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_CLASS[48:58] = _DIGIT
_CLASS[[*range(9, 14), 32]] = _SPACE
_CLASS[0] = _END


def pieces_of(texts: list[bytes]) -> tuple[list[bytes], list[int]]:
    """The pieces of UTF-8 texts that byte-level BPE never merges across, and where in their list each text's end.

    A piece is a run of letters, digits or signs with the single space before it, or white space; the white space before a run keeps
    its last character apart; the endings 's 't 'm 'd 're 've 'll are pieces where an apostrophe begins one. For texts without characters of _OTHER.
    All texts are cut at once, with a zero, which none holds, after each: a zero ends all runs, and white space before it is one piece.
    """
    b = np.frombuffer(b"".join(x + b"\0" for x in texts), dtype=np.uint8)
    n = len(b)
    kind = _CLASS[b]
    space = kind == _SPACE
    cut = np.zeros(n + 2, dtype=bool)  # a piece begins here
    cut[1:n] = kind[1:] != kind[:-1]
    before_run = np.flatnonzero(space[:-1] & (kind[1:] < _SPACE))  # the last white space before a run
    cut[before_run] = True
    cut[before_run[b[before_run] == 32] + 1] = False
    cut[0] = True
    mark = np.flatnonzero(b[:-1] == 39)
    mark = mark[(kind[mark + 1] == _LETTER) & cut[mark]]
    if len(mark):
        one, two = b[mark + 1], b[np.minimum(mark + 2, n - 1)]
        short = np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))
        pair = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        cut[mark[short | pair] + 1] = False
        cut[mark[short] + 2] = True
        cut[mark[pair] + 3] = True
    ends = np.flatnonzero(kind == _END)
    cut[ends] = False
    cut[ends + 1] = cut[0] = False
    # a zero before each piece but a text's first
    cuts = np.flatnonzero(cut[:n])
    given = np.ones(n + len(cuts), dtype=bool)
    given[cuts + np.arange(len(cuts))] = False
    apart = np.zeros(n + len(cuts), dtype=np.uint8)
    apart[given] = b
    stops = (np.searchsorted(cuts, ends, side="right") + np.arange(1, len(ends) + 1)).tolist()
    return apart.tobytes().split(b"\0")[:-1], stops


def _signs() -> dict[int, int]:
    """Byte-level BPE writes a byte as one printable sign: itself, or one past 255, in order. No piece holds a zero."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others) if b}


_SIGNS = _signs()


def _apart(ids: list[list[int]]) -> list[bytes]:
    """Each list as little-endian unsigned 32-bit integers."""
    ends = [4 * x for x in accumulate(map(len, ids))]
    flat = np.fromiter(chain.from_iterable(ids), dtype="<u4").tobytes()
    return [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class TextEncoder:
    """Encodes with one tokenizer file; each distinct piece once, as long as it is remembered."""

    def __init__(self, path: str, limit: int = PIECES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        made = json.loads(self.tokenizer.to_str())
        form = made.get("pre_tokenizer") or {}
        #: Without these a text can't be cut into pieces beforehand.
        self.by_pieces = form.get("type") == "ByteLevel" and not form.get("add_prefix_space") and form.get("use_regex", True) and not made.get("normalizer") and made["model"]["type"] == "BPE"
        added = [x["content"] for x in made.get("added_tokens", [])]
        self.added = re.compile("|".join(map(re.escape, added))) if added else None

    def _ids(self, texts: list[str]) -> list[bytes]:
        return _apart([x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])

    def _piece_ids(self, pieces: list[bytes]) -> list[bytes]:
        """The model alone: a piece needs no cutting, and stands in the model's table by the signs of its bytes."""
        split = self.tokenizer.model.tokenize
        return _apart([[x.id for x in split(p)] for p in b"\0".join(pieces).decode("latin-1").translate(_SIGNS).split("\0")] if pieces else [])

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers. What isn't remembered is given to the library in one batch."""
        if len(self.known) > self.limit:
            self.known = {}
        whole = [not self.by_pieces or bool(_OTHER.search(t)) or bool(self.added and self.added.search(t)) for t in texts]
        pieces, stops = pieces_of([t.encode() for t, w in zip(texts, whole, strict=True) if not w])
        ids = list(map(self.known.get, pieces))
        gaps = list(compress(count(), map(is_, ids, repeat(None))))
        new = list({pieces[i] for i in gaps})
        self.known.update(zip(new, self._piece_ids(new), strict=True))
        for i in gaps:
            ids[i] = self.known[pieces[i]]
        parts = iter(zip([0, *stops], stops, strict=False))
        return [self._ids([t])[0] if w else b"".join(ids[slice(*next(parts))]) for t, w in zip(texts, whole, strict=True)]


@cache
def _encoder(path: str) -> TextEncoder:
    """One for each worker."""
    return TextEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], tokenizer: str, end: int | None) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and ids of batches of (key, text), some bytes of text at a time; each text's ids end with the end id."""
    coder, last = _encoder(tokenizer), b"" if end is None else np.array([end], dtype="<u4").tobytes()
    for batch in batches:
        first, texts, size = 0, [], 0
        for i, x in enumerate(batch.column(1), 1):
            texts.append(x.as_py() or "")
            size += len(texts[-1])
            if size >= TEXTS or i == batch.num_rows:
                yield batch.column(0).slice(first, len(texts)), [x + last for x in coder.encode(texts)]
                first, texts, size = i, [], 0


def given_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """Keys and ids of batches of (key, ids)."""
    for batch in batches:
        yield batch.column(0), [x.as_py() or b"" for x in batch.column(1)]


def encode_texts(docs: DataFrame, tokenizer: str, *, key: str = "doc_id", text: str = "text", end: int | None = 0) -> DataFrame:
    """key and ids (binary, little-endian unsigned 32-bit integers): the ids of the whole text, then the end id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in encoded(batches, tokenizer, end):
            yield pa.RecordBatch.from_arrays([keys, pa.array(ids, pa.binary())], names=[key, "ids"])

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, ids binary")


# ---- ids to a file and back


def matrix_bytes(ids: np.ndarray, documents: pa.Table, start: int, block: int = BLOCK) -> bytes:
    """A shard's file. documents: key and n_tokens in order; start: ids before the shard in its part."""
    n, bits = len(ids), max(1, int(ids.max(initial=0)).bit_length())
    seq = ids.astype(np.uint16 if bits <= 16 else np.uint32)
    count = -(-n // block)
    press = zstandard.ZstdCompressor(level=1)
    ranks, places, body, at = np.zeros((bits, count + 1), dtype="<u8"), np.zeros((bits, count + 1), dtype="<u8"), [], 0
    for level in range(bits):
        on = (seq & seq.dtype.type(1 << (bits - 1 - level))).astype(bool)
        plane = np.zeros(count * block // 8, dtype=np.uint8)
        packed = np.packbits(on, bitorder="little")
        plane[: len(packed)] = packed
        ranks[level, 1:] = np.cumsum(np.bitwise_count(plane.reshape(count, block // 8)).sum(axis=1, dtype=np.uint64))
        for i, raw in enumerate(plane.reshape(count, block // 8)):
            raw = raw.tobytes()
            small = press.compress(raw)
            body.append(small if len(small) < len(raw) else raw)
            places[level, i] = at
            at += len(body[-1])
        places[level, count] = at
        seq = np.concatenate([np.compress(~on, seq), np.compress(on, seq)])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, documents.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(documents)
    parts = {"documents": sink.getvalue().to_pybytes(), "ranks": press.compress(ranks.tobytes()), "places": press.compress(places.tobytes()), "planes": b"".join(body)}
    sections, at = {}, 0
    for name, part in parts.items():
        sections[name] = [at, len(part)]
        at += len(part)
    head = json.dumps({"tokens": n, "documents": documents.num_rows, "bits": bits, "block": block, "start": start, "sections": sections}).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *parts.values()])


class WaveletFile:
    """One shard, read block by block from an open file."""

    def __init__(self, file: BinaryIO):
        self.file = file
        lead = file.read(16)
        if lead[:8] != MAGIC:
            raise ValueError("not a wavelet file")
        size = int.from_bytes(lead[8:], "little")
        head = json.loads(file.read(size))
        self.body = 16 + size
        self.n, self.bits, self.block_bits, self.start, self.sections = head["tokens"], head["bits"], head["block"], head["start"], head["sections"]
        shape = (self.bits, -(-self.n // self.block_bits) + 1)
        self.ranks = np.frombuffer(self._unpacked("ranks"), dtype="<u8").reshape(shape).astype(np.int64)
        self.places = np.frombuffer(self._unpacked("places"), dtype="<u8").reshape(shape).astype(np.int64)
        self.zeros = self.n - self.ranks[:, -1]
        self.block = lru_cache(maxsize=512)(self._block)

    def _section(self, name: str, first: int = 0, last: int | None = None) -> bytes:
        at, size = self.sections[name]
        self.file.seek(self.body + at + first)
        want = (size if last is None else last) - first
        data = self.file.read(want)
        if len(data) != want:
            raise EOFError(f"section {name} ends early")
        return data

    def _unpacked(self, name: str) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self._section(name))

    def documents(self) -> pa.Table:
        """key and n_tokens, in order."""
        return pa.ipc.open_stream(self._section("documents")).read_all()

    def _bits_of(self, raw: bytes) -> np.ndarray:
        if len(raw) != self.block_bits // 8:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        return np.unpackbits(np.frombuffer(raw, dtype=np.uint8), bitorder="little")

    def _block(self, level: int, i: int) -> np.ndarray:
        return self._bits_of(self._section("planes", *self.places[level, i : i + 2].tolist()))

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        i, rest = divmod(at, self.block_bits)
        return int(self.ranks[level, i]) + (int(self.block(level, i)[:rest].sum()) if rest else 0)

    def _down(self, level: int, at: int, bit: int) -> int:
        ones = self._ones(level, at)
        return int(self.zeros[level]) + ones if bit else at - ones

    def _up(self, level: int, at: int, bit: int) -> int:
        """The place in a plane of the bit that the next level has at a place."""
        k = at - int(self.zeros[level]) if bit else at
        before = self.ranks[level] if bit else np.minimum(np.arange(self.ranks.shape[1]) * self.block_bits, self.n) - self.ranks[level]
        i = int(np.searchsorted(before, k, side="right")) - 1
        return i * self.block_bits + int(np.flatnonzero(self.block(level, i) == bit)[k - int(before[i])])

    def _bit(self, token: int, level: int) -> int:
        return token >> (self.bits - 1 - level) & 1

    def access(self, at: int) -> int:
        """The id at a place of the shard."""
        if not 0 <= at < self.n:
            raise IndexError(at)
        token = 0
        for level in range(self.bits):
            bit = int(self.block(level, at // self.block_bits)[at % self.block_bits])
            token, at = token << 1 | bit, self._down(level, at, bit)
        return token

    def _range(self, token: int, stop: int) -> tuple[int, int]:
        """Where, below the last level, the occurrences before a place lie."""
        low, high = 0, stop
        if token < 0 or token >> self.bits:
            return 0, 0
        for level in range(self.bits):
            bit = self._bit(token, level)
            low, high = self._down(level, low, bit), self._down(level, high, bit)
        return low, high

    def rank(self, token: int, stop: int) -> int:
        """Occurrences of an id before a place."""
        low, high = self._range(token, min(max(stop, 0), self.n))
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The place of the k-th occurrence, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(k)
        at = low + k
        for level in reversed(range(self.bits)):
            at = self._up(level, at, self._bit(token, level))
        return at

    def ids(self) -> np.ndarray:
        """All ids in order."""
        ids = np.zeros(self.n, dtype=np.uint32 if self.bits > 16 else np.uint16)
        for level in reversed(range(self.bits)):
            planes = self._section("planes", int(self.places[level, 0]), int(self.places[level, -1]))
            ends = (self.places[level] - self.places[level, 0]).tolist()
            blocks = [self._bits_of(planes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
            on = np.concatenate(blocks)[: self.n].astype(bool) if blocks else np.empty(0, dtype=bool)
            above, zeros = np.empty_like(ids), int(self.zeros[level])
            above[np.flatnonzero(~on)] = ids[:zeros]
            above[np.flatnonzero(on)] = ids[zeros:] | ids.dtype.type(1 << (self.bits - 1 - level))
            ids = above
        return ids.astype("<u4")


# ---- the data source


@dataclass
class Written(WriterCommitMessage):
    part: int
    name: str
    shards: int
    documents: int
    tokens: int


class WaveletWriter(DataSourceArrowWriter):
    """Each task writes its rows, as they come, to files of its own attempt. Texts are encoded here, so that ids need not travel."""

    def __init__(self, path: str, key: str, kind: str, overwrite: bool, shard: int, tokenizer: str | None, end: int | None):
        self.path, self.key, self.kind, self.shard, self.tokenizer, self.end = path, key, kind, shard, tokenizer, end
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        if not overwrite and store.get_file_info(f"{folder}/{MANIFEST}").type != fs.FileType.NotFound:
            raise FileExistsError(path)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = store_of(self.path)
        part = TaskContext.get().partitionId()
        done = Written(part, f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0, 0)
        keys, ids, held = [], [], 0

        def close() -> None:
            sizes = pa.array([len(x) // 4 for x in ids], pa.int64())
            made = matrix_bytes(np.frombuffer(b"".join(ids), dtype="<u4"), pa.table({"key": pa.chunked_array(keys), "n_tokens": sizes}), done.tokens)
            with store.open_output_stream(f"{folder}/{done.name}-{done.shards:05d}.wm") as out:
                out.write(made)
            done.shards, done.documents, done.tokens = done.shards + 1, done.documents + len(ids), done.tokens + held

        for part_keys, part_ids in encoded(iterator, self.tokenizer, self.end) if self.tokenizer else given_ids(iterator):
            begun = 0
            for i, x in enumerate(part_ids):
                ids.append(x)
                held += len(x) // 4
                if held >= self.shard:
                    keys.append(part_keys.slice(begun, i + 1 - begun))
                    close()
                    keys, ids, held, begun = [], [], 0, i + 1
            if begun < len(part_ids):
                keys.append(part_keys.slice(begun))
        if ids:
            close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        lines = [{"key": self.key, "kind": self.kind}, *(vars(m) for m in sorted(filter(None, messages), key=lambda m: m.part) if m.shards)]
        with store.open_output_stream(f"{folder}/.{MANIFEST}") as out:
            out.write("\n".join(map(json.dumps, lines)).encode())
        store.move(f"{folder}/.{MANIFEST}", f"{folder}/{MANIFEST}")

    def abort(self, messages: list[Written | None]) -> None:
        store, folder = store_of(self.path)
        for m in filter(None, messages):
            for i in range(m.shards):
                store.delete_file(f"{folder}/{m.name}-{i:05d}.wm")


@dataclass
class Shard(InputPartition):
    file: str
    start: int


def read_manifest(path: str) -> tuple[dict, list[Shard]]:
    """Key and its type; each shard's file, and the ids before its part."""
    store, folder = store_of(path)
    with store.open_input_stream(f"{folder}/{MANIFEST}") as file:
        lines = [json.loads(x) for x in file.read().decode().splitlines()]
    shards, start = [], 0
    for x in lines[1:]:
        shards += [Shard(f"{x['name']}-{i:05d}.wm", start) for i in range(x["shards"])]
        start += x["tokens"]
    return lines[0], shards


class WaveletReader(DataSourceReader):
    def __init__(self, path: str, key: str):
        self.path, self.key = path, key

    def partitions(self) -> list[InputPartition]:
        return read_manifest(self.path)[1] or [Shard("", 0)]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        store, folder = store_of(self.path)
        with store.open_input_file(f"{folder}/{partition.file}") as file:
            shard = WaveletFile(file)
            documents, ids = shard.documents().combine_chunks(), shard.ids()
        ends = np.cumsum(documents.column("n_tokens").to_numpy())
        starts = ends - documents.column("n_tokens").to_numpy()
        first = 0
        while first < len(ends):
            last = max(first + 1, int(np.searchsorted(ends, starts[first] + BATCH // 4, side="right")))
            blobs = [ids[a:b].tobytes() for a, b in zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    documents.column("key").combine_chunks().slice(first, last - first), pa.array(starts[first:last] + (partition.start + shard.start), pa.int64()),
                    documents.column("n_tokens").combine_chunks().slice(first, last - first), pa.array(blobs, pa.binary()),
                ],
                names=[self.key, "start", "n_tokens", "ids"],
            )
            first = last


class WaveletSource(DataSource):
    """Format "wavelet": writes (key, ids), or with a tokenizer (key, text), as they are ordered; reads key, start, n_tokens and ids."""

    @classmethod
    def name(cls) -> str:
        return "wavelet"

    def schema(self) -> StructType | str:
        head = read_manifest(self.options["path"])[0]
        return f"`{head['key']}` {head['kind']}, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema: StructType) -> WaveletReader:
        return WaveletReader(self.options["path"], schema.fields[0].name)

    def writer(self, schema: StructType, overwrite: bool) -> WaveletWriter:
        first = schema.fields[0]
        end = self.options.get("end")
        return WaveletWriter(
            self.options["path"], first.name, first.dataType.simpleString(), overwrite, int(self.options.get("shard", SHARD)), self.options.get("tokenizer"), None if end is None else int(end)
        )


def write_tokens(docs: DataFrame, tokenizer: str, path: str, *, key: str = "doc_id", text: str = "text", end: int | None = 0, shard: int = SHARD) -> None:
    """Writes the ids of all texts in ascending order of key to a new folder, shards of some `shard` ids.

    Texts are dealt by ranges of the key (and, among equal keys, of the text's hash), so a shuffle of the texts is all that moves.
    """
    docs.sparkSession.dataSource.register(WaveletSource)
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).toDF(key, "_text")
    options = {"shard": shard, "tokenizer": tokenizer} | ({} if end is None else {"end": end})
    ordered.write.format("wavelet").options(**options).mode("append").save(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """key, start, n_tokens and ids of every document."""
    spark.dataSource.register(WaveletSource)
    return spark.read.format("wavelet").load(path)


def _shards(spark: SparkSession, path: str) -> DataFrame:
    found = [(s.file, s.start) for s in read_manifest(path)[1]]
    return spark.createDataFrame(found, "file string, start bigint").repartition(max(1, len(found)))


def token_counts(spark: SparkSession, path: str, tokens: list[int]) -> DataFrame:
    """token and n, its occurrences in all shards, by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_file(f"{folder}/{name}") as file:
                    shard = WaveletFile(file)
                    yield pa.RecordBatch.from_pydict({"token": tokens, "n": [shard.count(t) for t in tokens]})

    return _shards(spark, path).mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(spark: SparkSession, path: str, token: int) -> DataFrame:
    """key, place (in its document) and at (among all ids) of each occurrence of an id, by select."""
    head, _ = read_manifest(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = store_of(path)
        for batch in batches:
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{folder}/{name}") as file:
                    shard = WaveletFile(file)
                    found = np.array([shard.select(token, k) for k in range(shard.count(token))], dtype=np.int64)
                    documents = shard.documents()
                ends = np.cumsum(documents.column("n_tokens").to_numpy())
                of = np.searchsorted(ends, found, side="right")
                place = found - (ends - documents.column("n_tokens").to_numpy())[of]
                keys = documents.column("key").combine_chunks().take(pa.array(of))
                yield pa.RecordBatch.from_arrays([keys, pa.array(place, pa.int64()), pa.array(found + (start + shard.start), pa.int64())], names=[head["key"], "place", "at"])

    return _shards(spark, path).mapInArrow(run, f"`{head['key']}` {head['kind']}, place bigint, at bigint")


def op11_wavelet_tokens(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens (end id included) and ids_crc32 of every document, as read back from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), tokenizer, path)
    return read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
