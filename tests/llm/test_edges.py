"""Every operator and stage over nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm, line_dedup, ngram_jaccard, packing, pii, piece_codec, quality_rules, queries, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem ipsum dolor " * 4000 + "x" * 5000
ROWS = [
    (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n\n ", None, None, None), (4, "one", "en", None, 3), (5, "same line here\nsame line here\nother", "en", "a", 9),
    (6, "same line here\nsame line here\nother", "en", "b", 9), (6, "same line here\nsame line here\nother", "en", "b", 9), (None, "no id at all", "en", "a", 9), (None, None, None, None, None),
    (7, LONG, "en", "a", 9), (8, LONG + " more", "en", "c", 9), (9, "ä é 漢字 ␀ ▁ \x0b ok\r\nz", "en", "a", 9),
]
MODEL = __import__("public_tokenizers").path("piece_bpe_32k.model")


def operators(spark):
    labels = spark.createDataFrame([(5, 1, 1), (5, 1, None), (4, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return {
        "quality": lambda d: quality_rules.quality_rules(d), "lines": lambda d: line_dedup.line_dedup(d), "jaccard": lambda d: ngram_jaccard.jaccard_components(d),
        "pii": lambda d: pii.find_spans(d, ["doc_id"]), "redact": lambda d: pii.redacted(d), "pack": lambda d: packing.pack(d, capacity=100, shard=4),
        "pieces": lambda d: piece_codec.decode_pieces(piece_codec.encode_pieces(d, MODEL), MODEL), "lm": lambda d: bloom_lm.score_documents(d, words=1 << 10, pairs=1 << 8), "toxic": lambda d: toxicity.toxicity(d, labels),
    }


NAMES = ["quality", "lines", "jaccard", "pii", "redact", "pack", "pieces", "lm", "toxic"]
#: Names that the operators use for columns of their own.
CLASH = ["doc", "node", "key", "size", "line", "pos", "_text", "_row", "kept", "_taken", "bits", "a", "b", "n", "host_rate", "spans", "ids"]


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows(spark, name):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        docs = docs.withColumn(c, F.lit("x"))
    got = operators(spark)[name](docs).collect()
    if name == "lines":
        assert {r.doc_id for r in got} >= {None, 1, 2, 3, 4, 5, 7, 9} and 6 not in {r.doc_id for r in got}
        assert next(r.text for r in got if r.doc_id == 5) == "same line here\nother"
        assert next(r.text for r in got if r.doc_id == 1) is None and next(r.text for r in got if r.doc_id == 2) == ""
    elif name == "pack":
        assert sum(r.n_tokens for r in got) == sum(len((t or "").encode().split()) for _, t, *_ in ROWS)
        assert all((r.bin_id is None) == (r.n_tokens == 0) for r in got)
    else:
        assert len(got) == len(ROWS)
    if name == "jaccard":
        assert {r.doc_id: r.component_id for r in got if r.doc_id} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, 8: 8, 9: 9}
    if name == "lm":
        assert all(r.score <= 0 and r.base_score <= 0 for r in got)


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, name):
    assert operators(spark)[name](spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("rows", [ROWS, []])
def test_stages(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        own = stage(spark, docs, "")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert own.columns == docs.columns
        own.collect()


def test_host_verdicts_change_rows(spark):
    """Four hosts like the others, one of mostly failing documents, one of many symbols, one of a single bad document."""
    words = [f"word{i}" for i in range(60)]
    good, noisy = " ".join(words), " ".join(words[:50] + ["#"] * 10)
    rows = [(1000 * h + i, good + str(i) if i % 20 else "too short", "en", f"like{h}", 1) for h in range(4) for i in range(200)]
    rows += [(10_000 + i, good if i % 10 == 0 else "too short", "en", "bad", 1) for i in range(100)]
    rows += [(20_000 + i, noisy if i % 3 == 0 else good, "en", "noisy", 1) for i in range(100)] + [(30_000, "too short", "en", "single", 1), (30_001, noisy, "en", "like0", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    assert {i: r.host_verdict for i, r in got.items() if i % 1000 == 0} == {0: "ok", 1000: "ok", 2000: "ok", 3000: "ok", 10_000: "rejected", 20_000: "suspect", 30_000: "ok"}
    assert not got[10_000].base_failed and not got[10_000].kept  # a good document of the rejected host
    assert not got[20_000].base_failed and not got[20_000].kept and got[20_001].kept  # only what breaks a rule goes from a suspect host
    assert got[30_001].kept and got[30_001].n_symbols == got[20_000].n_symbols  # the same text stays elsewhere
    assert all(got[i].kept != got[i].base_failed for i in got if i < 10_000)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    names = ["doc_id", "base_failed", "host_rate", "host_verdict", "kept"]
    want = {r[0]: r[1:] for r in con.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()['op10_quality_rules']})").fetchall()}
    assert {i: (r.base_failed, round(r.host_rate, 6), r.host_verdict, r.kept) for i, r in got.items()} == want
    assert quality_rules.beta_prior(0, 0, 0, 0.0) == (0.5, 1.0)


def test_quality_counts():
    from tidemark.llm._common import hash_table

    text = "a b c d\na b c d\n\n\n#x é漢"
    assert quality_rules.counts_of(text.encode(), hash_table()) == (10, 12, 1, 1, 8, 3)
