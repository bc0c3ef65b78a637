"""Scoreboard readings: the score state machine, its refinement, and frame reuse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.config import ScoreConfig
from tidemark.functions.scalars import same_score
from tidemark.operators.folds import scanned
from tidemark.operators.ranges import range_join
from tidemark.operators.steps import read_step, score_step
from tidemark.schemas import SCORE

def readable(samples: DataFrame) -> DataFrame:
    return samples.where("ok AND score IS NOT NULL")


def score_states(samples: DataFrame, cfg: ScoreConfig, *, keys: list[str] | None = None, initial: str | None = None, ordinal: str | None = None) -> DataFrame:
    """keys, baseline, baseline_t, changes and rejected of each recording.

    A score holds once `reads` readings of it lie within window_s. The first is the baseline; a later one is a change, or is
    rejected if no match could go that way, and then the old score stays. initial: a column with the score to start from.
    """
    keys = keys or ["media_id"]
    columns = ["t", "score", *([initial] if initial else [])]

    def step(state: tuple | None, row: tuple) -> tuple[tuple, list[tuple]]:
        t, score, *given = row
        made = []
        if state is None:  # a row for every key, and its score to start from
            base = given[0] if given else None
            state = base and (base["home"], base["away"]), [], 1
            made.append((0, "first", None, base, t, None, None))
        current, reads, n = state
        current, reads, found = score_step(cfg, current, reads, t, (score["home"], score["away"]))
        if found:
            kind, before, after, change_t, confirmed_t, validation = found
            made.append((n, kind, before and dict(zip(("home", "away"), before, strict=True)), dict(zip(("home", "away"), after, strict=True)), change_t, confirmed_t, validation))
            n += 1
        return (current, reads, n), made

    rows = readable(samples).withColumn("t", F.col("t").cast("double")).withColumn("score", F.col("score").cast(SCORE))
    output = f"n int, kind string, before {SCORE}, after {SCORE}, change_t double, confirmed_t double, validation string"
    found = scanned(rows, keys, ["t", *([ordinal] if ordinal else []), "score"], columns, None, step, output)
    change = F.struct("before", "after", "change_t", "confirmed_t", "validation")
    states = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("n", "kind", change.alias("change")))).alias("_e"))
    of = lambda kind: F.transform(F.filter("_e", lambda e: e["kind"] == kind), lambda e: e["change"])
    first, settled = F.get(of("first"), F.lit(0)), F.get(of("baseline"), F.lit(0))
    return states.select(
        *keys, F.coalesce(first["after"], settled["after"]).alias("baseline"), F.when(first["after"].isNotNull(), first["change_t"]).otherwise(settled["change_t"]).alias("baseline_t"),
        of("change").alias("changes"), of("rejection").alias("rejected"),
    )


def _listed(states: DataFrame, column: str, keys: list[str]) -> DataFrame:
    return states.select(*keys, F.posexplode(column).alias("seq", "_c")).select(*keys, "seq", "_c.*")


def score_changes(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _listed(states, "changes", keys or ["media_id"]).withColumn("refined", F.lit(False))


def score_rejections(states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return _listed(states, "rejected", keys or ["media_id"])


def fine_windows(changes: DataFrame, media: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """changes with lo and hi, the range to be read again finely."""
    known = changes.join(media.select("media_id", "duration_s"), "media_id")
    return known.withColumns({
        "lo": F.greatest(F.lit(0.0), F.col("change_t") - cfg.fine_margin_s),
        "hi": F.least("duration_s", F.col("confirmed_t") + cfg.fine_margin_s),
    }).drop("duration_s")


def fine_samples(windows: DataFrame, fine: DataFrame, bucket: float = 10.0) -> DataFrame:
    """The fine readings of each change: an equi-join by recording and bucket of time, with the range as its residue."""
    return range_join(windows, fine.select("media_id", "t", "ok", "score"), ["media_id"], F.col("lo"), F.col("hi"), "t", bucket)


def _bucket(cfg: ScoreConfig) -> float:
    """About the longest range of fine_windows(), so a change stands in two buckets or so, however long ranges are; never under ten seconds."""
    return max(10.0, 2 * cfg.fine_margin_s + cfg.window_s)


def resolved(windows: DataFrame, fine: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """Suspicious changes as the chain of changes that the fine readings show; others, and those without a chain, as they are."""
    doubtful = windows.where("validation = 'suspicious'")
    states = score_states(fine_samples(doubtful, fine, _bucket(cfg)), cfg, keys=["media_id", "seq"], initial="before")
    chain = states.where(F.size("changes") > 0).select("media_id", "seq", F.posexplode("changes").alias("step", "_c"))
    chain = chain.select("media_id", "seq", "step", "_c.*", F.lit(True).alias("refined"))
    with_chain = chain.select("media_id", "seq").distinct()
    same = windows.join(with_chain, ["media_id", "seq"], "left_anti").withColumn("step", F.lit(0))
    return same.select(*chain.columns).unionByName(chain)


def first_run(samples: DataFrame, cfg: ScoreConfig, *, keys: list[str], target: str = "after", order: list[str] | None = None) -> DataFrame:
    """keys and refined_t: the start of the first `reads` readings in a row that all show target within window_s."""
    by = Window.partitionBy(*keys).orderBy(*(order or ["t"]))
    ahead = by.rowsBetween(0, cfg.reads - 1)
    alike = F.count_if(same_score("score", target)).over(ahead) == cfg.reads
    near = F.lead("t", cfg.reads - 1).over(by) - F.col("t") <= cfg.window_s
    return samples.select(*keys, "t", (alike & near).alias("_hit")).where("_hit").groupBy(*keys).agg(F.min("t").alias("refined_t"))


def refined(changes: DataFrame, windows: DataFrame, fine: DataFrame, cfg: ScoreConfig) -> DataFrame:
    """Valid changes moved to the start of their first confirmed run."""
    runs = first_run(readable(fine_samples(windows.where("validation = 'valid'"), fine, _bucket(cfg))), cfg, keys=["media_id", "seq"])
    out = changes.join(runs, ["media_id", "seq"], "left")
    better = (F.col("validation") == "valid") & F.col("refined_t").isNotNull()
    return out.withColumns({"change_t": F.when(better, F.col("refined_t")).otherwise(F.col("change_t")), "refined": F.col("refined") | better}).drop("refined_t")


def signature_difference(frames: DataFrame, keys: list[str]) -> DataFrame:
    """frames with difference: mean absolute difference of each signature from the frame before; null for the first."""
    before = F.lag("signature").over(Window.partitionBy(*keys).orderBy("frame"))
    away = F.aggregate(F.zip_with("signature", "_before", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    return frames.withColumn("_before", before).withColumn("difference", away / F.size("signature")).drop("_before")


def frames_to_read(frames: DataFrame, keys: list[str], *, threshold: float = 2.0, refresh: int = 3, reads: int = 1, carry: list[str] | None = None) -> DataFrame:
    """keys, frame, difference, should_read and carry: the first frame, a changed one, one of the burst after a read, or one that is due again.

    A read arms a burst of reads - 1 more, unless it is itself of a burst.
    """
    carry = carry or []
    kinds = [f"`{c}` {frames.schema[c].dataType.simpleString()}" for c in carry]

    def step(state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        frame, difference, *rest = row
        last, burst, read = read_step(*state, frame, difference, threshold, refresh, reads)
        return (last, burst), [(frame, difference, read, *rest)]

    rows = frames.withColumns({"frame": F.col("frame").cast("bigint"), "difference": F.col("difference").cast("double")})
    return scanned(rows, keys, ["frame", *carry], ["frame", "difference", *carry], (None, 0), step, ", ".join(["frame bigint, difference double, should_read boolean", *kinds]))


def reused(frames: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """frames not read take the last reading's columns, marked as reused."""
    so_far = Window.partitionBy(*keys).orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    taken = {c: F.last(F.when(F.col("should_read"), F.col(c)), ignorenulls=True).over(so_far) for c in columns}
    return frames.withColumns(taken | {"reused": ~F.col("should_read")})
