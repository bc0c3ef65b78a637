"""SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model holds a whitespace marker after another character,
no piece crosses from one marked word (a run of markers and the characters up
to the next marker) into the next, and BPE merges stay inside a marked word. So
every distinct marked word of the corpus is segmented once:

1. A task cuts its texts into marked words, and keeps, block of texts by block, the block's distinct words and each position's
   place among them.
2. The blocks' distinct words are dealt to shards by hash: the table. A shard segments each of its distinct words once, and
   answers every block with the ids of its words.
3. A block joins the ids to its positions by their places.

A word has one entry a block, however often it occurs, so a common word is no hot key, and what is shuffled is far less than the
occurrences. Shards grow in number with the bytes of text. A model whose pieces cross markers, or whose normaliser changes texts,
is applied to whole texts instead.

Null and empty texts are the two end ids and decode to an empty text. Repeated rows give
repeated results, ties don't arise, and empty tables give empty results.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import WordTable, durable, table

MARK = "▁"
_CROSSES = re.compile(f"[^{MARK}]{MARK}")
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*")
#: Marked words of a block of texts, and bytes of text for each shard of the table.
BLOCK = 4_000_000
SHARD_BYTES = 1 << 24


class PieceCodec:
    """Encodes and decodes with one model file; made in each worker."""

    def __init__(self, model: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        self.first, self.last = self.sp.bos_id(), self.sp.eos_id()
        #: Texts that a model must leave as they are for chunks to be exact.
        probe = "  a é  ﬁ①　é\t\n "
        plain = self.sp.decode(self.sp.encode(probe)) == probe
        self.chunked = plain and not any(map(_CROSSES.search, pieces))
        #: How ids are kept between tasks.
        self.kind = "<u2" if self.sp.get_piece_size() <= 1 << 16 else "<u4"
        self.ends = [np.array([i], dtype="<u4").tobytes() for i in (self.first, self.last)]

    def segment(self, chunk: str) -> bytes:
        """Ids of one marked word; encode() itself puts a marker before what it is given."""
        ids = self.sp.encode(chunk[1:].replace(MARK, " ")) if len(chunk) > 1 else [self.sp.piece_to_id(MARK)]
        return np.array(ids, dtype="<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a whole text, begin and end included, as little-endian unsigned 32-bit integers."""
        return self.ends[0] + np.array(self.sp.encode(text), dtype="<u4").tobytes() + self.ends[1]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, dtype="<u4").tolist())


@cache
def _codec(model: str) -> PieceCodec:
    """One for each worker."""
    return PieceCodec(model)


def marked_words(text: str) -> list[str]:
    return _CHUNK.findall((" " + text).replace(" ", MARK)) if text else []


class _Places(dict):
    """A word's place: the number of distinct words before it."""

    def __missing__(self, word: str) -> int:
        place = self[word] = len(self)
        return place


def _planes(numbers: np.ndarray) -> bytes:
    """Byte by byte of all numbers: small ones compress well."""
    return np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    if not planes:
        return np.empty(0, dtype=np.int64)
    return np.ascontiguousarray(np.frombuffer(planes, dtype="u1").reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _cut(blob: bytes, lengths: np.ndarray) -> list[bytes]:
    ends = np.cumsum(lengths).tolist()
    return [blob[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


def blocks_of(rows: DataFrame, kind: str, size: int, shards: int) -> DataFrame:
    """A row for each block of rows (_key, _text), of shard -1: keys, sizes (words of each text), places (of all words, by
    falling frequency, so that they compress), and as lengths the shard of each place; and one for each shard of its distinct
    words: these, in the order of places, and their lengths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        keys, sizes, places, at = [], [], _Places(), array("I")

        def made() -> pa.RecordBatch:
            found = np.frombuffer(at, dtype="<u4") if at else np.empty(0, dtype="<u4")
            often = np.argsort(-np.bincount(found, minlength=len(places)), kind="stable")
            place = np.empty(len(places), dtype=np.int64)
            place[often] = np.arange(len(places))
            words = [w.encode() for w in places]
            words = [words[i] for i in often.tolist()]
            shard = np.array([xxhash.xxh64_intdigest(w) % shards for w in words], dtype=np.int64)
            order = np.argsort(shard, kind="stable")
            met, starts = np.unique(shard[order], return_index=True)
            parts = np.split(order, starts[1:]) if len(met) else []
            n, none = len(met), [None] * len(met)
            check = xxhash.xxh64_intdigest(b"\n".join(words), seed=n) >> 1
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (n + 1), pa.int64()), pa.array([-1, *met.tolist()], pa.int64()), pa.array([keys, *none], pa.list_(batch.schema.field("_key").type)),
                    pa.array([np.array(sizes, dtype="<i8").tobytes(), *none], pa.binary()), pa.array([_planes(place[found]), *none], pa.binary()),
                    pa.array([None, *(b"".join([words[i] for i in p.tolist()]) for p in parts)], pa.binary()),
                    pa.array([_planes(shard), *(_planes(np.array([len(words[i]) for i in p.tolist()])) for p in parts)], pa.binary()),
                    pa.array([check] * (n + 1), pa.int64()),
                ],
                names=["block", "shard", "keys", "sizes", "places", "words", "lengths", "check"],
            )

        for batch in batches:
            for key, text in zip(batch.column("_key").to_pylist(), batch.column("_text"), strict=True):
                words = marked_words(text.as_py())
                keys.append(key)
                sizes.append(len(words))
                at.extend(map(places.__getitem__, words))
                if len(at) >= size:
                    yield made()
                    block += 1
                    keys, sizes, places, at = [], [], _Places(), array("I")
        if keys:
            yield made()

    return rows.mapInArrow(run, f"block long, shard long, keys array<{kind}>, sizes binary, places binary, words binary, lengths binary, check long")


def answered(words: DataFrame, model: str) -> DataFrame:
    """block, shard, check, ids and counts (of ids of each word): each distinct word of a shard is segmented once."""

    def run(group: pa.Table) -> pa.Table:
        codec = _codec(model)
        known = WordTable(lambda w: codec.segment(w.decode()), limit=1 << 62)
        ids, counts = [], []
        for blob, lengths in zip(group.column("words").to_pylist(), group.column("lengths").to_pylist(), strict=True):
            found = [known[w] for w in _cut(blob, _numbers(lengths))]
            ids.append(np.frombuffer(b"".join(found), dtype="<u4").astype(codec.kind).tobytes())
            counts.append(_planes(np.array([len(x) // 4 for x in found])))
        return pa.table({"of": group.column("block"), "shard": group.column("shard"), "of_check": group.column("check"), "ids": pa.array(ids, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return words.groupBy("shard").applyInArrow(run, "of long, shard long, of_check long, ids binary, counts binary")


def encode_pieces(
    docs: DataFrame, model: str, *, key: str = "doc_id", text: str = "text", block: int = BLOCK, shard: int = SHARD_BYTES, decode: bool = False, hold: bool = True
) -> DataFrame:
    """key and ids: binary, the ids with begin and end as little-endian unsigned 32-bit integers; with decode, also decoded, as decode_pieces() gives it, by the same worker.

    The blocks are used twice, and so written first. hold=False makes them twice instead, which takes less disk and more time; only for rows that
    come in the same order each time they are computed, as those of files do. Both times a block has a checksum of its words; where they differ, the task fails.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    codec = PieceCodec(model)
    ends, small = codec.ends, codec.kind
    if not codec.chunked:

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = PieceCodec(model)
            for batch in batches:
                ids = pa.array((own.encode(x.as_py()) for x in batch.column("_text")), pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("_key"), ids], names=[key, "ids"])

        encoded = rows.mapInArrow(whole, f"`{key}` {kind}, ids binary")
        return decode_pieces(encoded, model, key=key) if decode else encoded
    size = rows.agg(F.coalesce(F.sum(F.octet_length("_text")), F.lit(0))).first()[0]
    held = blocks_of(rows, kind, block, max(1, -(-size // shard)))
    held = durable(held, "piece-blocks") if hold else held
    answers = answered(held.where("shard >= 0").select("block", "shard", "words", "lengths", "check"), model)

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        if {*own.column("check").to_pylist(), *found.column("of_check").to_pylist()} != {own.column("check")[0].as_py()}:
            raise ValueError("a block's words differ from those that were answered: its rows came in another order the second time")
        found = found.sort_by("shard")
        by_shard: list[bytes] = []
        for ids, counts in zip(found.column("ids").to_pylist(), found.column("counts").to_pylist(), strict=True):
            by_shard += _cut(np.frombuffer(ids, dtype=small).astype("<u4").tobytes(), 4 * _numbers(counts))
        by_place = [b""] * len(by_shard)
        for i, x in zip(np.argsort(_numbers(own.column("lengths")[0].as_py()), kind="stable").tolist(), by_shard, strict=True):
            by_place[i] = x
        at = _numbers(own.column("places")[0].as_py())
        stops = np.cumsum(np.frombuffer(own.column("sizes")[0].as_py(), dtype="<i8")).tolist()
        out, start = [], 0
        for stop in stops:
            out.append(b"".join((ends[0], *map(by_place.__getitem__, at[start:stop].tolist()), ends[1])))
            start = stop
        made = {key: own.column("keys").combine_chunks().flatten(), "ids": pa.array(out, pa.binary())}
        if decode:
            del by_shard, by_place, at
            reader = _codec(model)
            made["decoded"] = pa.array(map(reader.decode, out), pa.string())
        return pa.table(made)

    both = held.where("shard = -1").select("block", "keys", "sizes", "places", "lengths", "check").groupBy("block").cogroup(answers.groupBy("of"))
    return both.applyInArrow(run, f"`{key}` {kind}, ids binary{', decoded string' if decode else ''}")


def decode_pieces(encoded: DataFrame, model: str, *, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, ids and the decoded text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model)
        for batch in batches:
            texts = pa.array((codec.decode(x.as_py() or b"") for x in batch.column(1)), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=[key, "ids", "decoded"])

    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(key, ids).mapInArrow(run, f"`{key}` {kind}, ids binary, decoded string")


def op6_sentencepiece(spark, sf_dir: str, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document."""
    if model is None:
        import public_tokenizers

        model = public_tokenizers.path("piece_bpe_32k.model")
    return encode_pieces(table(spark, sf_dir, "documents"), model, decode=True, hold=False).select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
