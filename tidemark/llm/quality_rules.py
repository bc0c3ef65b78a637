"""Quality rules with host verdicts.

Rules are evaluated per document. The failures of each rule are aggregated by
host, and each host's rate of each rule is shrunk with a beta prior fitted to all hosts (moments of the hosts' rates). What
counts of a host is the lower end of its posterior rate, Z standard deviations below the mean, so a host of few documents
isn't condemned by chance.

A host is rejected with all its documents when that end, for failures of the base
rules, is above both MAX_HOST_RATE and FACTOR times the rate of all documents. A host is suspect when that end, for
any one rule, is above FACTOR times the rule's rate over all documents; its documents are then held to
all rules, not to the base rules alone. Other hosts' documents are judged by the base rules.

Null or empty texts have no words and so fail the base rules. A null host is a
host of its own. Repeated rows are judged row by row. Empty tables give empty results. Columns
of the input other than the ones named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._common import durable, hash_table, shingle_hashes, table, text_bytes, word_hashes

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: The rules, by the counts of a document; the first two are the base.
RULES = {
    "few_words": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words",
    "symbols": "100 * n_symbols > 10 * n_words",
    "dup_lines": "100 * n_dup_lines > 30 * n_lines",
    "word_length": "word_chars < 3 * n_words OR word_chars > 10 * n_words",
}
BASE = f"{RULES['few_words']} OR {RULES['repeats']}"
#: A host of mostly failing documents is rejected; one far above the others in a rule is suspect.
MAX_HOST_RATE = 0.5
FACTOR = 3.0
#: Standard deviations of the posterior.
Z = 3.0

SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_CONTINUATION = bytes(range(0x80, 0xC0))
_NOT_SYMBOL = bytes(sorted(set(range(256)) - set(SYMBOLS)))

COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"


def repeated_words(shingles: np.ndarray, width: int) -> int:
    """Words that lie in a window that occurs at least twice."""
    if len(shingles) < 2:
        return 0
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    again = np.zeros(len(shingles) + 1, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(shingles) + width, dtype=np.int32)
    at = np.flatnonzero(again)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + width, -1)
    return int((np.cumsum(covered) > 0).sum())


def counts_of(text: bytes, hashes) -> tuple[int, int, int, int, int, int]:
    words = text.split()
    seen: set[bytes] = set()
    dup_lines = lines = 0
    for line in text.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip(_SPACE):
            seen.add(line)
            lines += 1
    word_chars = len(text.translate(None, _SPACE + _CONTINUATION))
    symbols = len(text.translate(None, _NOT_SYMBOL))
    windows = shingle_hashes(word_hashes(words, hashes), 3) if len(words) >= 3 else np.empty(0, np.uint64)
    return len(words), word_chars, symbols, dup_lines, repeated_words(windows, 3), lines + dup_lines


def rule_counts(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and the counts of every row."""
    fields = [docs.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", " + COUNTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = hash_table()
        names = [x.split()[0] for x in COUNTS.split(", ")]
        for batch in batches:
            rows = [counts_of(t.as_py(), hashes) for t in batch.column("_text")]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keys] + [pa.array(c, pa.int64()) for c in columns], names=keys + names
            )

    return docs.select(*keys, text_bytes(text).alias("_text")).mapInArrow(run, schema)


def host_verdicts(judged: DataFrame, host: str, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """_host, host_rate (shrunk rate of base failures) and host_verdict: ok, suspect or rejected.

    judged has a flag for base_failed and for every rule. Partial sums by host, so a hot host is no hot task; a
    few sums over the hosts make the priors.
    """
    flags = ["base_failed", *RULES]
    hosts = judged.groupBy(host).agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("long")).alias(f) for f in flags])
    n = F.col("n")
    one = hosts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("docs"), F.count("*").alias("hosts"), *[F.coalesce(F.sum(f), F.lit(0)).alias(f) for f in flags],
        *[F.coalesce(F.sum(n * (F.col(f) / n) * (F.col(f) / n)), F.lit(0.0)).alias(f"{f}_square") for f in flags],
    ).first()
    rate, low, usual = {}, {}, {}
    for f in flags:
        a, strength = beta_prior(one["docs"], one[f], one["hosts"], one[f"{f}_square"])
        rate[f] = (F.col(f) + F.lit(a)) / (n + F.lit(strength))
        low[f] = rate[f] - F.lit(Z) * F.sqrt(rate[f] * (F.lit(1.0) - rate[f]) / (n + F.lit(strength + 1)))
        usual[f] = F.lit(FACTOR * one[f] / max(one["docs"], 1))
    rejected = (low["base_failed"] > max_host_rate) & (low["base_failed"] > usual["base_failed"])
    suspect = reduce(lambda x, y: x | y, [low[f] > usual[f] for f in RULES])
    verdict = F.when(rejected, "rejected").when(suspect, "suspect").otherwise("ok")
    return hosts.select(F.col(host).alias("_host"), rate["base_failed"].alias("host_rate"), verdict.alias("host_verdict"))


def beta_prior(docs: int, failed: int, hosts: int, square: float) -> tuple[float, float]:
    """(a, a + b) by moments; square: sum of documents times squared rate over the hosts."""
    if not docs:
        return 0.5, 1.0
    mean = failed / docs
    noise = mean * (1 - mean)
    variance = square / docs - mean * mean - noise * hosts / docs
    strength = min(1e6, max(1.0, noise / max(variance, 1e-9) - 1))
    return mean * strength, strength


def quality_rules(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", host: str = "source", max_host_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """key, the counts, base_failed, host_rate, host_verdict and kept of every row of docs."""
    counts = [x.split()[0] for x in COUNTS.split(", ")]
    own = docs.select(F.col(key).alias("_key"), F.col(host).alias("_own"), F.col(text).alias("_judged"))
    flags = [F.expr(BASE).alias("base_failed"), *[F.expr(rule).alias(name) for name, rule in RULES.items()]]
    judged = durable(rule_counts(own, ["_key", "_own"], "_judged").select("*", *flags), "quality")
    broken = reduce(lambda x, y: x | y, [F.col(f) for f in RULES])
    fails = F.col("base_failed") | (F.col("host_verdict") == "rejected") | ((F.col("host_verdict") == "suspect") & broken)
    verdicts = host_verdicts(judged, "_own", max_host_rate)
    return judged.join(verdicts, F.col("_own").eqNullSafe(F.col("_host")), "left").select(
        F.col("_key").alias(key), *counts, "base_failed", "host_rate", "host_verdict", (~fails).alias("kept")
    )


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("host_rate", F.round("host_rate", 6))
