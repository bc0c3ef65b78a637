"""Language-model scores from a log-frequency Bloom filter.

Training counts of words and word pairs are quantised on a logarithmic scale
and put into a Bloom filter: an n-gram of level q = 1 + floor(log2 count) is there with each of the
levels 1..q. An n-gram's level is found by probing level after level until one is missing.

Every n-gram seen in training is held, so the filter grows with the corpus. It is
split by n-gram hash into shards. As 1 + floor(log2 x) <= x for x >= 1, all levels of all words and pairs are at
most twice the tokens, and a text has at most half as many tokens as bytes, and one: the number of shards
follows from the bytes, and a shard has about `pairs` n-gram occurrences at most, whatever the corpus.

Texts are read once, in blocks of some BLOCK tokens. A block sends each distinct word and pair to its shard once, with
its training count in the block. A shard adds up the counts, builds its filter, and answers each block with the levels,
and with the exact counts of words that the base score needs. The answers meet the block's tokens. No
key is hot: a word or pair has one entry a block, however often it occurs.

Words and pairs are known by their 64-bit hash. Null and empty texts have the end token
only. Repeated rows are scored, and learned from, row by row; documents without
an id are scored and learned from as if their id were an empty text. An empty
corpus gives no rows. Ties don't arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import durable, hash_table, mixed, table, text_bytes, word_hashes

#: Word and pair occurrences a shard has on average at most; the larger number of shards counts.
WORDS = 1 << 22
PAIRS = 1 << 22
#: Shards at least of a corpus of so many bytes or more, to keep all tasks busy.
SHARDS, LARGE = 64, 1 << 22
#: Bits of the filter for each entry, and its hash functions.
BITS, HASHES = 16, 4
#: Largest weight of the pair against the word in a probability, and the count of the word before at which it is half of that.
PAIR_WEIGHT, HALF_COUNT = 0.6, 400
#: Tokens that a worker looks at together.
BLOCK = 1_500_000

_END = 0x0123456789ABCDEF  # the end token's hash: of no word in particular


def training_row(key: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 7 != 2


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mixed(mixed(left) * np.uint64(0x9E3779B97F4A7C15) + right)


class LevelFilter:
    """A Bloom filter of (n-gram, level)."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.bits = np.uint64(len(words) * 64)

    @staticmethod
    def size(entries: int) -> int:
        return max(64, entries * BITS // 64)

    @staticmethod
    def positions(keys: np.ndarray, level: int | np.ndarray, bits: np.uint64) -> list[np.ndarray]:
        step = mixed(keys + np.asarray(level, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        jump = mixed(step) | np.uint64(1)
        return [(step + np.uint64(i) * jump) % bits for i in range(HASHES)]

    @classmethod
    def of(cls, keys: np.ndarray, levels: np.ndarray) -> LevelFilter:
        """The filter of keys at their levels, of the size that these need."""
        f = cls(np.zeros(cls.size(int(levels.sum())), dtype=np.uint64))
        filled = np.zeros(int(f.bits), dtype=np.uint8)
        for level in range(1, int(levels.max(initial=0)) + 1):
            for at in cls.positions(keys[levels >= level], level, f.bits):
                filled[at.astype(np.int64)] = 1
        f.words = np.packbits(filled, bitorder="little").view("<u8")
        return f

    def has(self, keys: np.ndarray, level: int) -> np.ndarray:
        found = np.ones(len(keys), dtype=bool)
        for at in self.positions(keys, level, self.bits):
            found &= (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each n-gram, 0 if it isn't held, by repeated probes."""
        out = np.zeros(len(keys), dtype=np.int64)
        alive = np.arange(len(keys))
        level = 0
        while len(alive):
            level += 1
            alive = alive[self.has(keys[alive], level)]
            out[alive] = level
        return out


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count), 0 for no count."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(level: np.ndarray) -> np.ndarray:
    """The smallest count of a level, 0 for level 0: never above the true one, but for false answers of the filter."""
    return np.where(level > 0, np.exp2(level - 1.0), 0.0)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return ((mixed(keys ^ np.uint64(0x3C3C3C3C3C3C3C3C)) >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)


def shard_count(bytes_: int, docs: int, words: int, pairs: int) -> int:
    """From a bound of the tokens: a word has a byte and a space at least."""
    tokens = bytes_ // 2 + 2 * docs
    return max(1, -(-tokens // min(words, pairs)), SHARDS if bytes_ >= LARGE else 1)


def blocks(batch: pa.RecordBatch, hashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Row of the first text, hashes of the tokens of some texts with an end token after each, and the number of tokens of each text."""
    end = np.array([_END], dtype=np.uint64)
    first, rows, sizes, total = 0, [], [], 0
    for t in batch.column("_text"):
        row = word_hashes(t.as_py().lower().split(), hashes)
        rows += [row, end]
        sizes.append(len(row) + 1)
        total += len(row) + 1
        if total >= BLOCK:
            yield first, np.concatenate(rows), np.array(sizes)
            first, rows, sizes, total = first + len(sizes), [], [], 0
    if rows:
        yield first, np.concatenate(rows), np.array(sizes)


def pairs_in(words: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a token has one before it in its text, and the keys of these pairs."""
    second = np.ones(len(at), dtype=bool)
    second[np.append(0, np.cumsum(sizes)[:-1])] = False
    where = np.flatnonzero(second)
    return where, pair_keys(words[at[where - 1]], words[at[where]])


def _dealt(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by shard, and the shards met with their starts."""
    shard = shard_of(keys, shards)
    order = np.argsort(shard, kind="stable")
    met, starts = np.unique(shard[order], return_index=True)
    return order, met, starts


#: Bytes of a pair's key that its shard gets; with the shard itself they tell pairs far better apart than a filter does.
_PAIR_BYTES = 6


def _planes(at: np.ndarray) -> bytes:
    """Byte by byte of all numbers: small ones compress well."""
    return at.astype("<u4").view("u1").reshape(-1, 4).T.tobytes()


def _numbers(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, dtype="u1").reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def pieces(docs: DataFrame, kind: str) -> DataFrame:
    """Of docs (_id, _train, _text): the words of each block by falling count, its tokens by their places in these, and its texts' ids, sizes and whether they train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, block = hash_table(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for first, tokens, sizes in blocks(batch, hashes):
                words, at, n = np.unique(tokens, return_inverse=True, return_counts=True)
                order = np.argsort(-n, kind="stable")
                place = np.empty(len(words), dtype=np.int64)
                place[order] = np.arange(len(words))
                ids, train = (batch.column(c).slice(first, len(sizes)) for c in ("_id", "_train"))
                ends = pa.array([0, len(sizes)], pa.int32())
                own = [words[order].tobytes(), _planes(place[at]), sizes.astype("<i8").tobytes(), train.to_numpy(zero_copy_only=False).astype("u1").tobytes()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int64()), pa.ListArray.from_arrays(ends, ids), *[pa.array([x], pa.binary()) for x in own]],
                    names=["block", "ids", "words", "at", "sizes", "train"],
                )
                block += 1

    return docs.mapInArrow(run, f"block long, ids array<{kind}>, words binary, at binary, sizes binary, train binary")


def sent_keys(held: DataFrame, shards: int) -> DataFrame:
    """Keys and training counts of each block for every shard; kind 0 are words, 1 pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words, sizes, train = (np.frombuffer(batch.column(c)[i].as_py(), dtype=t) for c, t in (("words", "<u8"), ("sizes", "<i8"), ("train", "u1")))
                at = _numbers(batch.column("at")[i].as_py())
                learned = np.repeat(train.astype(np.float64), sizes)
                where, pairs = pairs_in(words, at, sizes)
                pair, of = np.unique(pairs, return_inverse=True)
                shard, kinds, keys, counts = [], [], [], []
                for k, (found, n) in enumerate(((words, np.bincount(at, learned, len(words))), (pair, np.bincount(of, learned[where], len(pair))))):
                    order, met, starts = _dealt(found, shards)
                    n = n.astype("<i4")
                    for s, part in zip(met.tolist(), np.split(order, starts[1:]), strict=False):
                        shard.append(s)
                        kinds.append(k)
                        keys.append((found[part].view("u1").reshape(-1, 8)[:, :_PAIR_BYTES] if k else found[part]).tobytes())
                        counts.append(n[part].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("block")[i].as_py()] * len(shard), pa.int64()), pa.array(shard, pa.int64()), pa.array(kinds, pa.int32()), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())],
                    names=["block", "shard", "kind", "keys", "counts"],
                )

    return held.select("block", "words", "at", "sizes", "train").mapInArrow(run, "block long, shard long, kind int, keys binary, counts binary")


def _keys_of(kind: int, blob: bytes) -> np.ndarray:
    if not kind:
        return np.frombuffer(blob, dtype="<u8")
    out = np.zeros((len(blob) // _PAIR_BYTES, 8), dtype="u1")
    out[:, :_PAIR_BYTES] = np.frombuffer(blob, dtype="u1").reshape(-1, _PAIR_BYTES)
    return out.view("<u8").ravel()


def answered(sent: DataFrame) -> DataFrame:
    """Levels of the keys of every (block, shard, kind), in their order, and of words the exact counts; tokens and distinct are a shard's own, on one of its rows."""

    def run(group: pa.Table) -> pa.Table:
        kinds, blobs = group.column("kind").to_pylist(), group.column("keys").to_pylist()
        parts = [_keys_of(k, b) for k, b in zip(kinds, blobs, strict=True)]
        lengths = np.array([len(x) for x in parts])
        keys, of = np.unique(np.concatenate(parts), return_inverse=True)
        n = np.bincount(of, np.frombuffer(b"".join(group.column("counts").to_pylist()), dtype="<i4"), len(keys)).astype(np.int64)
        seen = n > 0
        found = LevelFilter.of(keys[seen], levels_of(n[seen])).levels(keys).astype(np.uint8)
        parts = np.split(of, np.cumsum(lengths)[:-1])
        word = np.zeros(len(keys), dtype=bool)
        for k, part in zip(kinds, parts, strict=True):
            word[part] |= k == 0
        word &= seen
        rest = [0] * (len(kinds) - 1)
        return pa.table(
            {
                "block": group.column("block"), "shard": group.column("shard"), "kind": group.column("kind"),
                "levels": pa.array([found[p].tobytes() for p in parts], pa.binary()),
                "counts": pa.array([n[p].astype("<i8").tobytes() if k == 0 else b"" for k, p in zip(kinds, parts, strict=True)], pa.binary()),
                "tokens": pa.array([int(n[word].sum()), *rest], pa.int64()), "distinct": pa.array([int(word.sum()), *rest], pa.int64()),
            }
        )

    return sent.groupBy("shard").applyInArrow(run, "block long, shard long, kind int, levels binary, counts binary, tokens long, distinct long")


def probabilities(single: np.ndarray, exact: np.ndarray, at: np.ndarray, where: np.ndarray, both: np.ndarray, total: int, distinct: int) -> np.ndarray:
    """Of each token given the one before it. single: counts by word as the filter tells them; exact: true ones; both: the filter's, of the pairs that end at where.

    (1 - w) (c(b) + 1) / (N + V + 1) + w c(ab) / C(a), with c as told, C exact and w by C(a). As c is rounded down, the
    probabilities of all words and of an unknown one after any word add up to 1 at most; what rounding takes away is given to no word.
    """
    p = (single[at] + 1.0) / (total + distinct + 1.0)
    before = exact[at[where - 1]].astype(np.float64)
    weight = PAIR_WEIGHT * before / (before + HALF_COUNT)
    p[where] = (1 - weight) * p[where] + weight * np.minimum(both / np.maximum(before, 1.0), 1.0)
    return p


def score_documents(docs: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, pairs: int = PAIRS) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs; learns from training_row()s."""
    kind = docs.schema[key].dataType.simpleString()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.count("*").alias("docs")).first()
    shards = shard_count(size["bytes"], size["docs"], words, pairs)
    rows = docs.select(F.col(key).alias("_id"), training_row(key).alias("_train"), text_bytes(text).alias("_text"))
    held = durable(pieces(rows, kind), "lm-pieces")
    answers = durable(answered(sent_keys(held, shards)), "lm-levels")
    known = answers.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n"), F.coalesce(F.sum("distinct"), F.lit(0)).alias("v")).first()
    tokens, distinct = known["n"], known["v"]

    def run(own: pa.Table, replies: pa.Table) -> pa.Table:
        found, sizes = (np.frombuffer(own.column(c)[0].as_py(), dtype=t) for c, t in (("words", "<u8"), ("sizes", "<i8")))
        at = _numbers(own.column("at")[0].as_py())
        where, all_pairs = pairs_in(found, at, sizes)
        pair, of = np.unique(all_pairs, return_inverse=True)
        said = {(k, s): i for i, (k, s) in enumerate(zip(replies.column("kind").to_pylist(), replies.column("shard").to_pylist(), strict=True))}

        def told(k: int, keys: np.ndarray, column: str, dtype: str) -> np.ndarray:
            order, met, _ = _dealt(keys, shards)
            out = np.empty(len(keys), dtype=np.int64)
            out[order] = np.frombuffer(b"".join(replies.column(column)[said[k, s]].as_py() for s in met.tolist()), dtype=dtype)
            return out

        exact = told(0, found, "counts", "<i8")
        n = exact[at]
        single, double = count_of(told(0, found, "levels", "u1")), count_of(told(1, pair, "levels", "u1"))[of]
        p = probabilities(single, exact, at, where, double, tokens, distinct)
        text_of = np.repeat(np.arange(len(sizes)), sizes)
        n_known, base, score = (np.bincount(text_of, x, len(sizes)) for x in (n > 0, np.log10((n + 1) / (tokens + distinct + 1)), np.log10(p)))
        return pa.table({key: own.column("ids").combine_chunks().flatten(), "n_tokens": sizes, "n_known": n_known.astype(np.int64), "base_score": base, "score": score})

    scored = held.drop("train").groupBy("block").cogroup(answers.select("block", "shard", "kind", "levels", "counts").groupBy("block")).applyInArrow(
        run, f"`{key}` {kind}, n_tokens long, n_known long, base_score double, score double"
    )
    return scored.select(
        key, (~training_row(key)).alias("held_out"), "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score"
    )


def op7_lm_score(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
