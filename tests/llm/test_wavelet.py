"""Token files against the tokenizers library and plain lists."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm.wavelet import TextEncoder, WaveletFile, WaveletSource, encode_texts, matrix_bytes, occurrences, op11_wavelet_tokens, read_tokens, token_counts, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN, CODER = Tokenizer.from_file(PATH), TextEncoder(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(st.text(st.sampled_from("  \n\t\r\x0b\x1c'stmdrevlSTabé1²_!.漢ä <|>-"), max_size=40) | st.text(max_size=30))
def test_pieces_give_the_ids_of_the_whole_text(text):
    assert np.frombuffer(CODER.encode([text])[0], dtype="<u4").tolist() == plain_ids(text)


@pytest.mark.parametrize("text", ["it's we'll they've 's's 'sabc ''s I'M x'd'", "a  b   \n\n c\n", " <|endoftext|> x", "'", " '", "'l", "'ll", "\n's", " 's", ""])
def test_pieces_of_endings_and_special_tokens(text):
    assert np.frombuffer(CODER.encode([text])[0], dtype="<u4").tolist() == plain_ids(text)


def test_new_pieces_go_to_the_model_alone(monkeypatch):
    """No cutting and no result object for each new piece; every byte but zero stands for itself."""
    coder = TextEncoder(PATH)
    monkeypatch.setattr(coder, "_ids", lambda texts: 1 / 0)
    text = "".join(map(chr, [*range(9, 14), *range(32, 127)])) + " na\u00efve \u0416\u0443\u043a \u4e2d\u6587 \ud55c\uae00"
    assert np.frombuffer(coder.encode([text])[0], dtype="<u4").tolist() == plain_ids(text)
    pieces = [bytes([b]) for b in range(1, 256)]
    assert [len(x) for x in coder._piece_ids(pieces)] == [4] * 255 and coder._piece_ids([]) == []


def test_few_remembered_pieces_give_the_same_ids():
    small, text = TextEncoder(PATH, limit=3), "one two three four five one two six"
    assert small.encode([text, "", text]) == CODER.encode([text, "", text])
    assert small.encode(["one"]) == CODER.encode(["one"])


@pytest.mark.parametrize("n,top,block", [(0, 1, 64), (1, 1, 64), (1000, 3, 64), (5000, 50_000, 256), (4096, 70_000, 4096)])
def test_matrix_against_a_list(n, top, block):
    rng = random.Random(n)
    ids = [min(int(rng.expovariate(1) * top / 6), top) for _ in range(n)]
    documents = pa.table({"key": pa.array(range(3)), "n_tokens": pa.array([n, 0, 0])})
    shard = WaveletFile(io.BytesIO(matrix_bytes(np.array(ids, dtype="<u4"), documents, 7, block)))
    assert shard.ids().tolist() == ids and shard.start == 7 and shard.documents().equals(documents)
    for at in rng.sample(range(n), min(n, 50)):
        assert shard.access(at) == ids[at]
        assert shard.rank(ids[at], at) == ids[:at].count(ids[at])
        assert shard.select(ids[at], ids[:at].count(ids[at])) == at
    for token in [0, 1, top, top + 1, 1 << 20, -1]:
        assert shard.count(token) == ids.count(token)
        with pytest.raises(IndexError):
            shard.select(token, ids.count(token))
    with pytest.raises(IndexError):
        shard.access(n)


def test_a_short_file_is_an_error():
    made = matrix_bytes(np.arange(5000, dtype="<u4"), pa.table({"key": pa.array([1]), "n_tokens": pa.array([5000])}), 0)
    with pytest.raises(EOFError):
        WaveletFile(io.BytesIO(made[:-100])).ids()
    with pytest.raises(ValueError):
        WaveletFile(io.BytesIO(b"something else entirely"))


EDGES = [(5, "five five"), (None, "no id"), (2, None), (3, ""), (2, "two"), (2, "two"), (9, "long " * 30_000), (-4, "<|endoftext|> é²"), (7, " \n ")]


def test_files_hold_all_documents_in_order(spark, tmp_path):
    docs = spark.createDataFrame([(k, t, "x", t) for k, t in EDGES], "doc_id long, text string, ids string, _text string")
    path = f"file://{tmp_path}/tokens"
    write_tokens(docs, PATH, path, shard=1000)
    rows = sorted(read_tokens(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in rows] == sorted((k for k, _ in EDGES), key=lambda k: (k is not None, k or 0))
    at = 0
    for r in rows:
        ids = np.frombuffer(r["ids"], dtype="<u4").tolist()
        assert (r["start"], r["n_tokens"], ids[-1]) == (at, len(ids), 0)
        at += len(ids)
    found = sorted((r["doc_id"] or 0, bytes(r["ids"])) for r in rows)
    assert found == sorted((k or 0, np.array([*plain_ids(t), 0], dtype="<u4").tobytes()) for k, t in EDGES)
    everything = [i for r in rows for i in np.frombuffer(r["ids"], dtype="<u4").tolist()]
    five = plain_ids(" five")[0]
    assert {r["token"]: r["n"] for r in token_counts(spark, path, [0, five, 50_000]).collect()} == {t: everything.count(t) for t in (0, five, 50_000)}
    ends = sorted(r["at"] for r in occurrences(spark, path, 0).collect())
    assert ends == [i for i, t in enumerate(everything) if t == 0]
    assert [(r["doc_id"], r["place"]) for r in occurrences(spark, path, five).collect()] == [(5, everything[[r for r in rows if r["doc_id"] == 5][0]["start"] :].index(five))]
    with pytest.raises(Exception, match="FileExists"):
        write_tokens(docs, PATH, path)


def test_ids_that_are_given_are_written_as_they_are(spark, tmp_path):
    docs = spark.createDataFrame([("b", "two words"), ("a", "one")], "name string, text string").orderBy("name")
    spark.dataSource.register(WaveletSource)
    encode_texts(docs, PATH, key="name", end=None).write.format("wavelet").mode("append").save(f"{tmp_path}/given")
    found = {r["name"]: np.frombuffer(r["ids"], dtype="<u4").tolist() for r in read_tokens(spark, f"{tmp_path}/given").collect()}
    assert found == {"a": plain_ids("one"), "b": plain_ids("two words")}


def test_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    write_tokens(docs, PATH, str(tmp_path / "none"))
    assert read_tokens(spark, str(tmp_path / "none")).collect() == []
    assert token_counts(spark, str(tmp_path / "none"), [1]).collect() == []


def test_query_against_the_library(spark):
    folder = "/root/testdata/sf0.001"
    found = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op11_wavelet_tokens(spark, folder).collect()}
    at, wanted = 0, {}
    for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*plain_ids(r["text"]), 0], dtype="<u4")
        wanted[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert found == wanted
