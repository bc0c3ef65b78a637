"""Ordered folds of groups.

A fold runs aggregate() over a group's rows sorted by time and ordinal, in the JVM. A group
is one recording (or one key of it), so its rows fit in a task: about 5,400
samples for a match. What a fold emits is collected by segments, so its time follows the rows. Sorting never relies on arrival order.

Folds that carry a single number (cooldown, dedup, slew limit) don't need the whole group: segmented() deals a key's rows to segments, finds
what each segment does to any number that enters it, and folds all segments at the same time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_rows(df: DataFrame, keys: list[str], order: list[str], columns: list[str], name: str = "rows") -> DataFrame:
    """keys and an array of structs sorted by order; order's columns lead the structs."""
    fields = list(dict.fromkeys([*order, *columns]))
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))


def fold(rows: Column | str, start: Column, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None) -> Column:
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.aggregate(rows, start, step, finish) if finish else F.aggregate(rows, start, step)


#: Rows of a segment of a fold that emits rows.
_SEGMENT = 256


def emitting(rows: Column | str, start: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """The rows (structs of kind) that a fold emits, in order. step(state, row) gives the next state, whether a row is emitted, and that row.

    An accumulator is copied at each step, and what was emitted with it. So the fold runs segment by segment: a step copies what its segment has
    emitted, a segment what those before it have.
    """
    rows = F.col(rows) if isinstance(rows, str) else rows
    nothing, none = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")
    last = F.floor((F.size(rows) - 1) / _SEGMENT).cast("int")
    segments = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * _SEGMENT + 1, F.lit(_SEGMENT)))

    def one(acc: Column, row: Column) -> Column:
        state, emits, row_out = step(acc["state"], row)
        return F.struct(state.alias("state"), F.when(emits, F.concat(acc["out"], F.array(row_out))).otherwise(acc["out"]).alias("out"))

    def segment(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["state"].alias("state"), nothing.alias("out")), one)
        # a variable of a lambda, so that the segment is folded once
        return F.get(F.transform(F.array(done), lambda d: F.struct(d["state"].alias("state"), F.concat(acc["full"], F.array(d["out"])).alias("full"))), F.lit(0))

    return F.aggregate(segments, F.struct(start.alias("state"), none.alias("full")), segment, lambda a: F.flatten(a["full"]))


def scanned(df: DataFrame, keys: list[str], order: list[str], columns: list[str], start: object, step: Callable[[object, tuple], tuple[object, list[tuple]]], output: str) -> DataFrame:
    """keys and the rows that step(state, columns of a row) gives beside the next state, over all rows in order.

    A key's rows come sorted to one task and stream through it in Arrow batches: only the state is held, however long the key is. Structs are dicts, arrays
    lists. output: the fields of the rows that step gives.
    """
    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    own, given, sort = ([f"_{c}{i}" for i in range(len(names))] for c, names in (("k", keys), ("c", columns), ("o", order)))
    rows = df.select(*[F.col(c).alias(n) for names, cs in ((own, keys), (given, columns), (sort, order)) for n, c in zip(names, cs, strict=True)])
    schema = df.sparkSession.createDataFrame([], f"{kinds}, {output}").toArrow().schema

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, start, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = row[: len(keys)]
                if key != now:
                    now, state = key, start
                state, found = step(state, row[len(keys) :])
                out += [(*key, *r) for r in found]
            if out:
                yield made(out)
                out = []

    return rows.repartition(*own).sortWithinPartitions(*own, *sort).drop(*sort).mapInArrow(run, f"{kinds}, {output}")


def _fitting(gap: float, strict: bool) -> Callable:
    return (lambda apart: apart > gap) if strict else (lambda apart: apart >= gap)


def kept_function(at: np.ndarray, gap: float, strict: bool) -> list[tuple[float, float]]:
    """What a segment does to the time kept before it, as (time, last time kept): the first time that fits decides.

    Only rows that no row before them exceeds can be kept, so these are sorted. The row kept after each is found by binary
    search, and the last of each chain by pointer doubling; chains that end alike are one entry.
    """
    at = at[~np.isnan(at)]
    if not len(at):
        return []
    at = at[at >= np.maximum.accumulate(at)]
    fits, n = _fitting(gap, strict), len(at)
    follows = np.searchsorted(at, at + gap, side="right" if strict else "left")
    while (early := (follows > 0) & fits(at[np.maximum(follows - 1, 0)] - at) & (follows - 1 > np.arange(n))).any():
        follows[early] -= 1
    follows = np.maximum(follows, np.arange(n) + 1)
    while (late := (follows < n) & ~fits(at[np.minimum(follows, n - 1)] - at)).any():
        follows[late] += 1
    ends = np.where(follows < n, follows, np.arange(n))
    while (ends[ends] != ends).any():
        ends = ends[ends]
    last = np.append(ends[1:] != ends[:-1], True)
    return list(zip(at[last].tolist(), at[ends[last]].tolist(), strict=True))


def spaced(
    df: DataFrame, keys: list[str], order: list[str], at: str, gap: float, *, strict: bool, carry: list[str], segment: Column | None = None
) -> DataFrame:
    """Rows that are at least gap (more than gap if strict) after the row kept before them, by key.

    A row earlier than the one kept before it isn't kept either, nor is one without a time. segment: see segmented().
    """
    fits = _fitting(gap, strict)

    @F.pandas_udf("array<struct<at: double, last: double>>")
    def function(rows: pd.Series) -> pd.Series:
        return pd.Series([[{"at": a, "last": b} for a, b in kept_function(np.array(x, dtype=float), gap, strict)] for x in rows])

    def leaves(last: Column, done: Column) -> Column:
        fitting = F.filter(done, lambda k: last.isNull() | fits(k["at"] - last))
        return F.coalesce(F.get(fitting, F.lit(0))["last"], last)

    def step(state: Column, row: Column) -> tuple[Column, Column, Column]:
        time = row[at].cast("double")
        kept = time.isNotNull() & (state["last"].isNull() | fits(time - state["last"]))
        return F.struct(F.when(kept, time).otherwise(state["last"]).alias("last")), kept, row

    segment = F.floor(F.col(order[0]) / max(_WIDTH, 64 * gap)) if segment is None else segment
    fields = list(dict.fromkeys([*order, at, *carry]))
    return segmented(df, keys, order, fields, segment.cast("bigint"), lambda rows: function(F.transform(rows, lambda r: r[at].cast("double"))), leaves, step)


#: Units of the first order column in a segment, unless the caller knows better.
_WIDTH = 4096.0


def segmented(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    columns: list[str],
    segment: Column,
    function: Callable[[Column], Column],
    leaves: Callable[[Column, Column], Column],
    step: Callable[[Column, Column], tuple[Column, Column, Column]],
    kind: str | None = None,
) -> DataFrame:
    """keys and the rows that a fold of one double ("last", null at first) emits, in parallel over segments of a key.

    segment grows with order, so rows of a key are dealt to groups of bounded size. function(rows) says, for a whole segment, what becomes of any
    number that enters it; leaves(number, function) applies it. One small fold by key runs over these functions, which gives each
    segment the number that enters it, and then all segments are folded by step at the same time. Both uses of the segments
    share one shuffle, by key and segment; a key's rows never stand in one array.
    """
    keyed = df.withColumn("_key", F.struct(*keys, segment.alias("_segment")))  # a struct, so that null keys meet as well
    rows = ordered_rows(keyed, ["_key"], order, columns)
    kind = kind or _element(rows)
    own = [F.col(f"_key.{k}").alias(k) for k in keys]
    done = rows.select(F.struct(*own).alias("_group"), F.struct("_key._segment", function(F.col("rows")).alias("_f")).alias("_d"))
    listed = done.groupBy("_group").agg(F.array_sort(F.collect_list("_d")).alias("rows"))

    def enter(state: Column, row: Column) -> tuple[Column, Column, Column]:
        shown = F.struct(row["_segment"].alias("_segment"), state["last"].alias("_last"))
        return F.struct(leaves(state["last"], row["_f"]).alias("last")), F.lit(True), shown

    nothing = F.struct(F.lit(None).cast("double").alias("last"))
    entries = listed.select("_group", F.explode(emitting("rows", nothing, "struct<_segment: bigint, _last: double>", enter)).alias("_e"))
    entered = entries.select(F.struct(*[F.col(f"_group.{k}").alias(k) for k in keys], F.col("_e._segment").alias("_segment")).alias("_key"), "_e._last")
    # a row for each segment, which estimates of exploded rows take for few: never broadcast
    made = rows.join(entered.hint("merge"), "_key").select(*own, F.explode(emitting("rows", F.struct(F.col("_last").alias("last")), kind, step)).alias("_r"))
    return made.select(*keys, *[F.col(f"_r.{c}") for c in _names(made, keys)])


def _names(made: DataFrame, keys: list[str]) -> list[str]:
    return [f.name for f in made.schema["_r"].dataType.fields if f.name not in keys]


def _element(rows: DataFrame) -> str:
    return rows.schema["rows"].dataType.elementType.simpleString()
