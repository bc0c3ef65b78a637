"""N-gram Jaccard join with token-combination prefixes.

A document's set is its distinct word shingles, by their 64-bit hashes. Two
documents link when 100 * |A and B| >= percent * |A or B|; components of links are returned.

Candidates (s: percent / 100, n: the size of a set; every bound below holds for any linked pair):

1. Sets are ordered by hash. Two linked sets share at least k of their first
   n - ceil(s n) + k shingles. k(n) grows with n, so prefixes are longer than for k = 1.
2. A shingle is rare if at most RARE prefixes have it. Rare ones are indexed singly, and pairs are counted: of the k shared
   shingles at most as many are frequent as either prefix has, so the pair shares the rest of k as rare ones.
   A shingle that two texts share by chance is thus no candidate.
3. That says nothing of a pair whose prefixes both have k frequent shingles. Documents with that
   many are indexed by combinations of shingles: the prefix is extended to the whole set, and dealt by
   hash to more groups than a linked pair can differ in shingles. Each difference spoils one group, so the pair agrees on
   whole groups, and each group's combination of shingles is one key. Their number follows the size,
   where all k-subsets would grow as its k-th power. Combinations of a fixed k were tried (runs of 4 neighbours, README):
   unlike near copies share too many of them.
4. A set is at risk if no more of its groups hold anything than it can differ in: it could agree on empty groups only. Such sets, a few small
   ones, are compared with every set that shares any shingle of their prefixes, frequent or not. So no link is lost.

Candidates whose sizes or parity sketches are too far apart go; the others are verified on whole texts. Exact copies (equal sets) are one entry from the start.
See _graph.linked for how pairs that share a key are compared; a key that is still crowded with unlike documents
is crossed with the groups of a second, independent hash, which are as certain as the first.

Words: ASCII white space apart, A-Z in lower case. With fewer words than a shingle
has, the whole sequence is the shingle; without words or text the set is empty and links with
nothing. Repeated rows give repeated results; an id should have one text; of several, links are verified on the smallest. Rows without an id get their own result without a component.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import durable, hash_table, mixed, shingle_hashes, signed, table, text_bytes, word_hashes
from tidemark.llm._graph import SKETCH, components, key_filter, linked, maybe_in

WIDTH, PERCENT = 3, 90
#: Prefixes that may share a rare shingle.
RARE = 32
#: Sets whose prefix a task has sent: a copy isn't sent again.
_SENT = 200_000


def shingle_set(text: bytes, width: int, hashes) -> np.ndarray:
    """Sorted distinct hashes."""
    return np.unique(shingle_hashes(word_hashes(text.lower().split(), hashes), width))


def shared_at_least(n, percent: int):
    """k: how many shingles the prefixes share; half of the part of a set that may differ, and one."""
    return 1 + n * (100 - percent) // 200


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - -(-percent * n // 100) + shared_at_least(n, percent))


def size_class(n: int, percent: int) -> int:
    """Linked sets are of the same class or of neighbouring ones."""
    return int(math.floor(math.log(max(n, 1)) / -math.log(percent / 100) + 1e-9))


def most_different(c: int, percent: int) -> int:
    """Bound of |A xor B| of a linked pair whose larger set is of class c: (1 - s) of their union, which is at most larger / s."""
    largest = (100 / percent) ** (c + 1) + 1
    return math.floor(largest * (100 - percent) / percent)


def group_count(c: int, percent: int) -> int:
    """More groups than differing shingles; more still where some are empty: for small sets, and for groups of few shingles."""
    most = most_different(c, percent)
    return (most + 1) * 2 if most < 25 else most + 1 + (most // 4 if percent < 90 else 0)


def combination_keys(shingles: np.ndarray, percent: int, order: int = 0) -> tuple[np.ndarray, bool]:
    """Keys of the groups' combinations, under the own class and the next (a larger partner's), and whether the set is at risk."""
    own, most = size_class(len(shingles), percent), len(shingles) * (100 - percent) // percent
    out, risk = [], False
    for c in (own, own + 1):
        group = mixed(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5 + order)) % np.uint64(group_count(c, percent))
        by_group = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.append(True, group[by_group][1:] != group[by_group][:-1]))
        sums = np.add.reduceat(mixed(shingles[by_group] + np.uint64(c)), starts)  # wraps around
        out.append(mixed(sums + group[by_group][starts] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(c)))
        risk |= len(starts) <= most  # a partner differs in no more, whatever its size
    return np.concatenate(out), risk


def _lists(rows: list[np.ndarray | None]) -> pa.Array:
    ends = np.append(0, np.cumsum([0 if r is None else len(r) for r in rows], dtype=np.int64)).astype(np.int32)
    full = [signed(r) for r in rows if r is not None]
    values = pa.array(np.concatenate([np.empty(0, np.int64), *full]), pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in rows]))


def shingled(docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """doc, n, s1, s2 (128-bit hash of the set) and prefix (null if this task sent it for an equal set, or without an id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, sent = hash_table(), set()
        for batch in batches:
            n, s1, s2, prefixes = [], [], [], []
            for doc, t in zip(batch.column("doc"), batch.column("_text"), strict=True):
                s = shingle_set(t.as_py(), width, hashes)
                both = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                s1.append((both >> 64) - (1 << 63))
                s2.append((both & ((1 << 64) - 1)) - (1 << 63))
                # a row without an id is no entry: it must not stand for later rows of its set
                first = doc.is_valid and len(s) and both not in sent
                prefixes.append(s[: prefix_length(len(s), percent)] if first else None)
                if not first:
                    continue
                if len(sent) >= _SENT:
                    sent.clear()
                sent.add(both)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), _lists(prefixes)],
                names=["doc", "n", "s1", "s2", "prefix"],
            )

    rows = docs.select(F.col(key).cast("long").alias("doc"), text_bytes(text).alias("_text"))
    return rows.mapInArrow(run, "doc long, n long, s1 long, s2 long, prefix array<long>")


def combinations_of(texts: DataFrame, width: int, percent: int, order: int = 0) -> DataFrame:
    """key, node, size: the combination keys of texts (node, text); a null key more of sets at risk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hash_table()
        for batch in batches:
            for node, t in zip(batch.column("node").to_pylist(), batch.column("_text"), strict=True):
                s = shingle_set(t.as_py(), width, hashes)
                if len(s):
                    keys, risk = combination_keys(s, percent, order)
                    keys = [*signed(np.unique(keys)).tolist(), *([None] if risk else [])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys, pa.int64()), pa.array(np.full(len(keys), node)), pa.array(np.full(len(keys), len(s)))], names=["key", "node", "size"]
                    )

    return texts.select("node", text_bytes("text").alias("_text")).mapInArrow(run, "key long, node long, size long")


def sketches_of(texts: DataFrame, width: int) -> DataFrame:
    """node and sketch: parities of the shingles by 1,024 hash values, as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hash_table()
        for batch in batches:
            rows = []
            for t in batch.column("_text"):
                place = mixed(shingle_set(t.as_py(), width, hashes) ^ np.uint64(0x5C5C5C5C5C5C5C5C)) % np.uint64(64 * SKETCH)
                odd = np.bincount(place.astype(np.int64), minlength=64 * SKETCH) & 1
                rows.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(rows, pa.list_(pa.int64()))], names=["node", "sketch"])

    return texts.select("node", text_bytes("text").alias("_text")).mapInArrow(run, "node long, sketch array<long>")


def similar(pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of those (a, b, ta, tb) whose whole texts link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hash_table()
        last, left = None, np.empty(0, np.uint64)
        for batch in batches:
            keep = []
            for i, a in enumerate(batch.column("a").to_pylist()):
                if a != last:
                    last, left = a, shingle_set(batch.column("ta")[i].as_py(), width, hashes)
                right = shingle_set(batch.column("tb")[i].as_py(), width, hashes)
                common = len(np.intersect1d(left, right, assume_unique=True))
                keep.append(100 * common >= percent * (len(left) + len(right) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return pairs.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _k(n, percent: int):
    return F.lit(1) + F.floor(n * (100 - percent) / 200)


def rare_pairs(postings: DataFrame, frequent: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of near sizes that share as many rare shingles as a linked pair must.

    A rare key has at most RARE nodes, so the pairs of a key are bounded. A pair that may share frequent shingles only is
    left to the combinations.
    """
    rows = postings.join(frequent.select("node", "frequent"), "node", "left").select("key", "node", "size", F.coalesce("frequent", F.lit(0)).alias("f"))
    sides = [rows.select("key", F.col("node").alias(n), F.col("size").alias(f"s{n}"), F.col("f").alias(f"f{n}")) for n in ("a", "b")]
    near = (F.col("sa") * 100 >= F.col("sb") * percent) & (F.col("sb") * 100 >= F.col("sa") * percent)
    need = _k(F.least("sa", "sb"), percent) - F.least("fa", "fb")
    met = sides[0].join(sides[1], "key").where((F.col("a") < F.col("b")) & near & (need >= 1))
    return met.groupBy("a", "b").agg(F.count("*").alias("n"), F.max(need).alias("need")).where("n >= need").select("a", "b")


def jaccard_components(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, rare: int = RARE
) -> DataFrame:
    """key, n_shingles and component_id of every row of docs."""
    sets = durable(shingled(docs, key, text, width, percent), "shingles")
    full = sets.where("n > 0 AND doc IS NOT NULL")
    # equal sets are one entry: the smallest document of those whose prefix was sent
    entries = full.where("prefix IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc").alias("entry"))
    copies = full.select("doc", "s1", "s2").join(entries, ["s1", "s2"]).select(F.col("entry").alias("a"), F.col("doc").alias("b"))
    copies = durable(copies, "copies")
    chosen = copies.select(F.col("a").alias("doc")).distinct()
    posted = (
        full.where("prefix IS NOT NULL")
        .join(chosen, "doc", "left_semi")
        .select(F.explode("prefix").alias("key"), F.col("doc").alias("node"), F.col("n").alias("size"))
    )
    counts = durable(posted.groupBy("key").agg(F.count("*").alias("prefixes")).where("prefixes > 1"), "prefix-counts")
    postings = durable(maybe_in(posted, "key", key_filter(counts, "key")).join(counts, "key"), "postings")
    frequent = durable(postings.where(F.col("prefixes") > rare).groupBy("node", "size").agg(F.count("*").alias("frequent")), "frequent")
    pairs = durable(rare_pairs(postings.where(F.col("prefixes") <= rare), frequent, percent), "rare-pairs")
    # a partner's k is at least that of the size s n
    crowded = durable(frequent.where(F.col("frequent") >= _k(F.ceil(F.col("size") * percent / 100), percent)).select("node"), "crowded")
    wanted = docs.select(F.col(key).cast("long").alias("node"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def texts_of(ends: DataFrame, name: str) -> DataFrame:
        ends = durable(ends.distinct(), f"{name}-ends")
        return durable(maybe_in(wanted, "node", key_filter(ends, "node")).join(ends, "node").groupBy("node").agg(F.min("text").alias("text")), name)

    def both_ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("node"))

    def verified_by(texts: DataFrame):
        def verified(pairs: DataFrame) -> DataFrame:
            held = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").cast("binary").alias("tb")), "b").join(
                texts.select(F.col("node").alias("a"), F.col("text").cast("binary").alias("ta")), "a"
            )
            return similar(held, width, percent)

        return verified

    texts = texts_of(crowded.unionByName(both_ends(pairs)), "texts")
    crowded_texts = durable(texts.join(crowded, "node"), "crowded-texts")
    combined = durable(combinations_of(crowded_texts, width, percent), "combinations")
    sketches = durable(sketches_of(crowded_texts, width), "sketches")

    def most_apart(a, b):
        return F.floor((a + b) * F.lit(100 - percent) / F.lit(100 + percent))

    def second(nodes: DataFrame) -> DataFrame:
        return combinations_of(crowded_texts.join(nodes, "node"), width, percent, order=1).where("key IS NOT NULL").select("key", "node")

    verified = verified_by(texts)
    links = linked(combined.where("key IS NOT NULL"), verified, percent / 100, "jaccard", sketches, most_apart, second).unionByName(durable(verified(pairs), "rare-edges")).unionByName(copies)
    risky = combined.where("key IS NULL").select("node")
    if not risky.isEmpty():
        sides = postings.join(risky, "node").select("key", F.col("node").alias("x"), F.col("size").alias("sx")).join(postings.select("key", "node", "size"), "key")
        near = (F.col("sx") * 100 >= F.col("size") * percent) & (F.col("size") * 100 >= F.col("sx") * percent)
        few = durable(sides.where((F.col("x") != F.col("node")) & near).select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct(), "risky-pairs")
        links = links.unionByName(durable(verified_by(texts_of(both_ends(few), "risky-texts"))(few), "risky-edges"))
    found = components(links, "jaccard-components")
    return sets.join(found, F.col("doc") == F.col("node"), "left").select(
        F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id")
    )


def op4_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))
