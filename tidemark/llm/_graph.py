"""Links and their connected components, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import discard, durable

#: Bits of the broadcast key filter: 8 MB, whatever the number of keys.
FILTER_BITS = 1 << 26


def _place(column: str):
    return F.pmod(F.xxhash64(column), F.lit(FILTER_BITS))


def key_filter(keys: DataFrame, column: str, place=None) -> DataFrame:
    """Bits of hashed keys, or of their own places, in arrays of 512 longs: at most FILTER_BITS / 32768 rows of 4 kB."""
    place = _place(column) if place is None else place
    words = keys.groupBy(F.shiftright(place, 15).cast("int").alias("_bucket"), F.shiftright(place, 6).bitwiseAND(F.lit(511)).cast("int").alias("_word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))).alias("_bits")
    )
    bits = F.map_from_entries(F.collect_list(F.struct("_word", "_bits")))
    filled = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda i: F.coalesce(F.try_element_at(F.col("_map"), i), F.lit(0).cast("long")))
    return words.groupBy("_bucket").agg(bits.alias("_map")).select("_bucket", filled.alias("_bits"))


def maybe_in(rows: DataFrame, column: str, filters: DataFrame) -> DataFrame:
    """rows whose key may be among the filter's: none is lost, so a join that follows shuffles less and finds the same.

    With more keys than bits it keeps everything, and stays right.
    """
    place = F.col("_place")
    word = F.get("_bits", F.shiftright(place, 6).bitwiseAND(F.lit(511)).cast("int"))
    bit = F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1))
    return (
        rows.withColumn("_place", _place(column))
        .join(F.broadcast(filters), F.shiftright(place, 15).cast("int") == F.col("_bucket"))
        .where(bit == 1)
        .select(*rows.columns)
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (its smallest node) of every node of edges (a, b); by alternating stars.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller ones;
    rows never outnumber the edges, and a node with many neighbours is only an aggregate and a join key,
    which adaptive execution splits. Rounds go on until the edges stay the same.
    """
    now = durable(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name
    )
    before = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if n == 0 or (n, total) == before:
            break
        before = (n, total)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        last, now = now, durable(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), name)
        discard(last)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


#: Longs of a sketch.
SKETCH = 16


def _renamed(sketches: DataFrame, node: str) -> DataFrame:
    return sketches.select(F.col("node").alias(node), F.col("sketch").alias(f"k{node}"))


def _bits_apart(a: str, b: str):
    return sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(SKETCH)), F.lit(0))


#: Pairs of unlike components that a key may give for each of its nodes before it is crossed with other keys; crossing
#: gives as many rows a node as it has keys of one kind times keys of the other, some thousand.
CROSS = 1024


def linked(
    postings: DataFrame, verified: Callable[[DataFrame], DataFrame], nearly: float, name: str, sketches: DataFrame, most_apart: Callable, second: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Edges (a, b) with the connected components of all pairs that share a key and are verified.

    postings: key, node, size. verified keeps the true ones of pairs (a, b). A pair whose sizes
    differ by more than the share `nearly` is never true.

    sketches (node, sketch: array of SKETCH longs) hold parities of a set's elements: two sets differ in
    as many elements, at least, as their sketches in bits. Pairs that differ in more than
    most_apart(size, size) are left out before they are verified.

    First every node of a key is compared with the key's smallest node; then only pairs that share
    a key and are in different components so far. Pairs left out are of one component, so no
    component is lost, and copies of one text are no square of pairs. A key that would give more than CROSS such pairs a node
    isn't used alone: second(nodes) gives other keys (key, node), of which a true pair shares one as well. Its pairs share
    one of these that isn't crowded, or one of either kind at once.
    """
    keys = durable(postings.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), f"{name}-keys")
    shared = durable(maybe_in(postings, "key", key_filter(keys, "key")).join(keys, "key"), f"{name}-shared")
    centers = shared.groupBy("key").agg(F.min("node").alias("a"))
    pairs = shared.join(centers, "key").where("node <> a").select("a", F.col("node").alias("b"), F.col("size").alias("sb")).distinct()
    sizes = shared.select(F.col("node").alias("a"), F.col("size").alias("sa")).distinct()
    near = (F.col("sa") >= F.col("sb") * F.lit(nearly)) & (F.col("sb") >= F.col("sa") * F.lit(nearly)) & (_bits_apart("ka", "kb") <= most_apart(F.col("sa"), F.col("sb")))
    ends = pairs.join(sizes, "a").join(_renamed(sketches, "a"), "a").join(_renamed(sketches, "b"), "b")
    star = durable(ends.where(near).select("a", "b"), f"{name}-star")
    first = durable(verified(star), f"{name}-edges")
    found = components(first, f"{name}-components")
    labelled = shared.join(found, "node", "left").select("key", "node", "size", F.coalesce("component", "node").alias("component"))
    open_ = durable(_crossing(labelled).where("pairs > 0").join(labelled, "key"), f"{name}-open")
    few, crowded = open_.where(F.col("pairs") <= CROSS * F.col("n")), open_.where(F.col("pairs") > CROSS * F.col("n")).drop("n", "pairs")
    nodes = durable(crowded.groupBy("node").agg(F.max("size").alias("size"), F.max("component").alias("component")), f"{name}-crowded")
    others = second(nodes.select("node")).join(nodes, "node")
    others = durable(_crossing(others).where("pairs > 0").join(others, "key"), f"{name}-second")
    full = others.where(F.col("pairs") > CROSS * F.col("n")).select(F.col("key").alias("other"), "node")
    crossed = crowded.join(full, "node").withColumn("key", F.xxhash64("key", "other"))
    groups = [few, others.where(F.col("pairs") <= CROSS * F.col("n")), crossed]
    held = durable(reduce(DataFrame.unionByName, [g.select("key", "node", "size", "component") for g in groups]).join(sketches, "node"), f"{name}-rest-of")
    left, right = (
        held.select("key", F.col("node").alias(n), F.col("size").alias(f"s{n}"), F.col("component").alias(f"c{n}"), F.col("sketch").alias(f"k{n}")) for n in ("a", "b")
    )
    rest = left.join(right, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & near).select("a", "b").distinct()
    rest = durable(rest.join(star, ["a", "b"], "left_anti"), f"{name}-rest")
    more = durable(verified(rest), f"{name}-edges")
    discard(keys, shared, star, open_, nodes, others, held, rest)
    return first.unionByName(more)


def _crossing(labelled: DataFrame) -> DataFrame:
    """key, n, pairs: its nodes and its pairs of nodes in different components."""
    parts = labelled.groupBy("key", "component").agg(F.count("*").alias("c"))
    return parts.groupBy("key").agg(F.sum("c").alias("n"), ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs"))
