"""Search, packing, personal data, pieces, scores, toxicity and chat against plain versions."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom_lm, chat_template, packing, permutation_index, pii, piece_codec, queries, toxicity

SF = "/root/testdata/sf0.001"
MODEL = __import__("public_tokenizers").path("piece_bpe_32k.model")


def test_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = {}
    for r in permutation_index.op1_permutation_index(spark, SF).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, vectors = zip(*((r.vec_id, r.embedding) for r in rows.collect()), strict=True)
    ids, m = np.array(ids), np.array(vectors, dtype=float)
    norm = np.sqrt((m * m).sum(1))
    hit = total = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = (m @ m[q]) / (norm * norm[q])
        score[q] = -2
        best = ids[np.lexsort((ids, -score))[:5]]
        own = got[ids[q]]
        hit += len({i for i, _ in own} & set(best.tolist()))
        total += 5
        assert all(abs(s - score[ids == i][0]) < 1e-12 for i, s in own)
    assert hit / total >= 0.9


def test_search_edges(spark):
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (3, [1.0, 0.0]), (2, [2.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [0.0, 1.0]), (None, [1.0, 1.0]), (9, []), (10, [1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("_h1", F.lit("x"))
    got = permutation_index.search(df, F.col("_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 2), (0, 2, 3), (0, 3, 50), (0, 4, 8), (50, 1, 0), (50, 2, 2), (50, 3, 3), (50, 4, 8)]
    assert permutation_index.search(df.limit(0), F.col("_id") % 50 == 0).count() == 0


def test_packing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = packing.pack(docs, capacity=1000, per_source=2, shard=60).join(docs.select("doc_id", "source", "text"), "doc_id").collect()
    words = {r.doc_id: len((r.text or "").encode().split()) for r in got}
    held, bins = Counter(), {}
    for r in got:
        held[r.doc_id] += r.n_tokens
        if r.bin_id is not None:
            bins.setdefault(r.bin_id, []).append(r)
    assert dict(held) == words and set(words) == {r.doc_id for r in docs.collect()}
    for rows in bins.values():
        rows.sort(key=lambda r: r.offset)
        assert all(a.offset + a.n_tokens <= b.offset for a, b in zip(rows, rows[1:], strict=False)) and rows[-1].offset + rows[-1].n_tokens <= 1000
        assert len({r.text for r in rows}) == len(rows)
        assert max(Counter(r.source for r in rows).values()) <= 2


def test_bins_take_the_tightest():
    import random

    rng = random.Random(5)
    bins, held = packing.Bins(50, 2), {}
    for _ in range(400):
        size, s, c = rng.randint(1, 50), rng.randrange(3), rng.randrange(8)
        fits = {b for b, rows in held.items() if sum(r[0] for r in rows) + size <= 50 and sum(r[1] == s for r in rows) < 2 and c not in {r[2] for r in rows}}
        best = max((sum(r[0] for r in held[b]) for b in fits), default=None)
        b = bins.put(size, 1 << s, 1 << c)
        assert (b in fits and sum(r[0] for r in held[b]) == best) if fits else b not in held
        held.setdefault(b, []).append((size, s, c))


def plain_spans(text):
    forms = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    out = []
    for k, form in enumerate(forms):
        for m in re.finditer(form, text):
            d = [int(c) for c in m[0] if c in "0123456789"]
            luhn = sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
            if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (k == 2 and 16 <= len(d) <= 19 and luhn) or (k == 3 and 8 <= len(d) <= 15):
                out.append((k, *m.span()))
    return out


def test_fixed_forms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = pii.op5_pii(spark, "/root/testdata/sf0.01").collect()
    for r in got:
        want = plain_spans(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in want) for k in range(4))
        listed = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest() and set(listed.split(",")) - {""} <= set(r.spans.split(","))


def test_patterns_find_unseen(spark):
    """Identifiers of other forms in the seeds' contexts: malformed, without a digit, in groups; not those of mixed contexts."""
    rows = [(i, f"please write to me: user{i}@mail.org thanks") for i in range(8)] + [(10 + i, f"call my phone +49 30 12345{i}{i}{i} now") for i in range(9)]
    rows += [(30, "call my phone 0049-30-99 now"), (31, "call my phone 0049 (30) 991 today"), (32, "please write to me: bob(at)host thanks"), (33, 'set the key="ABC-unseen" here')]
    rows += [(34, "lot number A-77881 is sold"), (35, "call my phone +49 30 1234599 now")] + [(40 + i, f'set the key="{i:040x}" here'.replace("0000", "a1b2")) for i in range(6)]
    rows += [(50 + i, f"we saw 10.0.0.{i} there") for i in range(3)] + [(60 + i, f"we saw dog{i} there") for i in range(9)] + [(70, None), (71, ""), (32, "please write to me: bob(at)host thanks")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    got = pii.find_spans(df, ["doc_id"]).collect()
    found = {r.doc_id: [(pii.KINDS[s.kind], texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in got}
    assert len(got) == len(rows) and found[34] == found[70] == found[71] == found[60] == [] and len(found[50]) == 1
    assert found[30] == [("phone", "0049-30-99")] and found[31] == [("phone", "0049 (30) 991")] and found[32] == [("email", "bob(at)host")]
    assert found[33] == [("secret", "ABC-unseen")] and found[40][0][0] == "secret" and found[35] == [("phone", "+49 30 1234599")]
    assert all(not r.base for r in got if r.doc_id in (30, 31, 32, 33))
    clean = {r.doc_id: r.text for r in pii.redacted(df).collect()}
    assert clean[0] == "please write to me: <EMAIL> thanks" and clean[30] == "call my phone <PHONE> now" and clean[33] == 'set the key="<SECRET>" here' and clean[70] is None


def test_instances_bring_patterns(spark):
    """A handle found in a trusted context is known in others, where it makes a pattern that finds more."""
    rows = [(i, f"mail goes to: user{i}@mail.org ok") for i in range(40)] + [(50 + i, f"mail goes to: nick-{i} ok") for i in range(9)]
    rows += [(60 + i, f"our handle is nick-{i} friends") for i in range(9)] + [(70, "our handle is mole friends")]
    got = pii.find_spans(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()
    assert {r.doc_id: len(r.spans) for r in got} == {i: 1 for i, _ in rows}


def test_texts_are_scanned_for_what_is_new(spark, monkeypatch):
    """Growths count a pattern once and look its places up once; what was found before still counts."""
    counted, located, count, look = [], [], pii.pattern_counts, pii.places

    def counts(docs, text, patterns):
        counted.extend(r.pattern for r in patterns.select("pattern").distinct().collect())
        return count(docs, text, patterns)

    def places(docs, text, patterns, instances=None):
        located.extend(r.pattern for r in patterns.collect() if instances is None)
        return look(docs, text, patterns, instances)

    monkeypatch.setattr(pii, "pattern_counts", counts)
    monkeypatch.setattr(pii, "places", places)
    test_instances_bring_patterns(spark)
    assert len(set(counted)) == len(counted) > 2 and len(set(located)) == len(located) > 2


def test_words_are_hashed_by_the_chunk(monkeypatch):
    """Hashes of a chunk's words agree just where words do, whatever their length and neighbours; patterns know no neighbour in another text."""
    rnd = np.random.default_rng(5)
    texts = ["", " ", "...", '="', 'a="b" A="7', "x" * 64, "x" * 65, "\x0b\x0c", "a\xa0b c", "\u0391\u03a3' (\u0391\u03a3)"] + ["".join(rnd.choice(list(' .,ab1\n="\u00e9\U0001f600'), size=n)) for n in rnd.integers(1, 150, 400)]
    edge = ".,;:!?\"'()[]{}*$%&#<>|"
    for form, of in ((pii.plain, lambda w: re.sub("[0-9]", "9", w.lower())), (pii.as_it_is, lambda w: w)):
        hashes, bounds = pii.words_of(texts, form)
        known = {}
        for i, t in enumerate(texts):
            words = re.findall(r"[^ \t\n\v\f\r]+", t.replace('="', '= "'))
            assert bounds[i + 1] - bounds[i] == len(words)
            for w, h in zip(words, hashes[bounds[i] : bounds[i + 1]].tolist(), strict=True):
                assert known.setdefault(of(w.strip(edge) or w), h) == h
        assert len(set(known.values())) == len(known) > 300
    alone = [pii.places_of([t])[0] for t in texts]
    together, bounds = pii.places_of(texts)
    assert (np.concatenate(alone, axis=1) == together).all()
    monkeypatch.setattr(pii, "CHUNK", 200)
    assert [t for c in pii.chunks(texts) for t in c] == texts and len(list(pii.chunks(texts))) > 50
    own = pii.instance_hashes(["(ab1)", "ab1", "49 (30) 1"]).view(np.uint64)
    assert own[0] == own[1] == pii.words_of(["x ab1."], pii.as_it_is)[0][1] and len(set(own.tolist())) == 2


def test_spans_are_added_on_the_tables(spark):
    """Secrets in forms that are no seed (in capitals, cut by marks) are found by context; nothing else is."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    added = [(texts[r.doc_id], s.start, s.end, s.kind) for r in pii.find_spans(docs, ["doc_id"]).collect() for s in r.spans if s.kind >= pii.BASE or s not in r.base]
    tokens = {(t, m.start(1), m.end(1)) for t in texts.values() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    seeds = {(t, a, b) for t, a, b in tokens if t[a:b].islower()}
    found = {(t, a, b) for t, a, b, _ in added}
    assert len(tokens - seeds) >= 5 and len(found & (tokens - seeds)) >= 0.9 * len(tokens - seeds)
    assert len(found & tokens) >= 0.95 * len(tokens) and len(found & tokens) >= 0.95 * len(found) and {k for *_, k in added} == {pii.BASE}


@pytest.mark.parametrize("text", ["", " ", "a", " a", "a  b   c ", "▁ ▁▁a", "x\n\ny\t z", "ﬁ①é漢字", "</s> <s> [INST]", "word " * 50, "\x00 \x0b ok"])
def test_pieces_equal_the_library(text):
    codec = piece_codec.PieceCodec(MODEL)
    assert codec.chunked
    ids = np.frombuffer(codec.encode(text), dtype="<u4").tolist()
    assert ids == codec.sp.encode(text, add_bos=True, add_eos=True)
    assert codec.encode(text) == b"".join([codec.ends[0], *map(codec.segment, piece_codec.marked_words(text)), codec.ends[1]])
    assert codec.decode(codec.encode(text)) == codec.sp.decode(ids)


def test_pieces_of_texts_without_words(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "")], "doc_id long, text string").coalesce(1)
    codec = piece_codec.PieceCodec(MODEL)
    assert {bytes(r.ids) for r in piece_codec.encode_pieces(df, MODEL).collect()} == {b"".join(codec.ends)}


@pytest.mark.parametrize("block", [piece_codec.BLOCK, 300])
def test_pieces_of_documents(spark, block):
    """Against the library; with small blocks, shards of the table answer many."""
    codec = piece_codec.PieceCodec(MODEL)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {r.doc_id: r.ids for r in piece_codec.encode_pieces(docs, MODEL, block=block, shard=20_000).collect()}
    assert got == {i: codec.encode(t) for i, t in texts.items()}
    for r in piece_codec.op6_sentencepiece(spark, SF).collect():
        ids = codec.sp.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(codec.sp.decode(ids).encode()).hexdigest()


def test_scores(spark):
    docs = {r.doc_id: (r.text or "").encode().lower().split() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    counts = Counter()
    for i, words in docs.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update([*words, None])
    pairs = Counter(p for i, words in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2 for p in zip(words, [*words[1:], None]))
    n, v = sum(counts.values()), len(counts)
    got = bloom_lm.op7_lm_score(spark, SF).collect()

    def floored(x):
        return 2 ** (x.bit_length() - 1) if x else 0

    def plain(words):
        """The model without a filter."""
        total = 0.0
        for a, b in zip([False, *words], words):
            one, c = (floored(counts[b]) + 1) / (n + v + 1), counts[a] if a is not False else 0
            w = bloom_lm.PAIR_WEIGHT * c / (c + bloom_lm.HALF_COUNT) if c else 0.0
            total += math.log10((1 - w) * one + (w * min(1.0, floored(pairs[a, b]) / c) if c else 0.0))
        return total

    away = [(r.score - plain([*docs[r.doc_id], None])) / len([*docs[r.doc_id], None]) for r in got]
    # false answers of the filter only raise a score, and are few
    assert min(away) > -1e-9 and max(away) < 0.2 and sum(away) / len(away) < 0.005
    for r in got:
        words = [*docs[r.doc_id], None]
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), n)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2) and r.score < 0
    # words outside of the broadcast vocabulary meet their counts by a join: the same scores
    few = {r.doc_id: r for r in bloom_lm.score_documents(spark.read.parquet(f"{SF}/documents.parquet"), words=256, pairs=64).collect()}
    assert all(few[r.doc_id].base_score == pytest.approx(r.base_score) and few[r.doc_id].n_known == r.n_known for r in got)


def test_probabilities_add_up_to_one_at_most():
    rng = np.random.default_rng(4)
    words, v = 12, 40
    pairs = rng.integers(0, 50, (words, words))
    exact = pairs.sum(axis=1) + 1
    told = bloom_lm.count_of(bloom_lm.levels_of(exact))
    total = int(exact.sum())
    for a in range(words):
        at = np.array([x for b in range(words) for x in (a, b)])
        where = np.arange(1, 2 * words, 2)
        p = bloom_lm.probabilities(told, exact, at, where, bloom_lm.count_of(bloom_lm.levels_of(pairs[a])), total, words)
        weight = bloom_lm.PAIR_WEIGHT * exact[a] / (exact[a] + bloom_lm.HALF_COUNT)
        unknown = (1 - weight) / (total + words + 1)
        assert 0.4 < p[where].sum() + unknown <= 1


def test_filter_levels():
    keys = bloom_lm.mixed(np.arange(1, 3001, dtype=np.uint64))
    f = bloom_lm.LevelFilter(np.zeros(bloom_lm.LevelFilter.size(8000), dtype=np.uint64))
    levels = np.arange(3000) % 4
    for level in range(1, 4):
        for at in f.positions(keys[levels >= level], level, f.bits):
            np.bitwise_or.at(f.words, (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
    found = f.levels(keys)
    assert (found >= levels).all() and (found != levels).mean() < 0.01


def test_toxicity_holds_out(spark):
    """A fifth of the labels takes part in no choice: not of words, nor of grades, purity or ridge."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    train = labels.where("doc_id % 5 <> 0")
    scored = toxicity.toxicity(docs, train).join(labels.where("doc_id % 5 = 0").selectExpr("doc_id", "toxic AS y"), "doc_id").toPandas()
    said = scored["toxic"].to_numpy()
    y = scored["y"].to_numpy() == 1
    assert said[y].mean() > 0.75 and said[~y].mean() < 0.05, (said[y].mean(), said[~y].mean())
    assert scored["severity"].between(0, toxicity.GRADES).all()


def test_grades_are_ordered(spark):
    """Words of the worse grade raise the expected severity above those of the lesser one; plain words don't; one weight serves all thresholds."""
    mild, bad, plain = (" ".join([w] * 2) for w in ("nasty", "vile", "tree"))
    rows = [(i, f"{plain} word{i % 7} " + (mild if i % 3 == 1 else f"{bad} {mild}" if i % 3 == 2 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 != 2), int(i % 3 > 0)) for i in range(300)] + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame([*rows, (900, mild), (901, f"{bad} {mild}"), (902, plain), (903, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert got[901].severity > got[900].severity + 0.3 > got[902].severity + 0.6 and got[900].toxic and not got[902].toxic and not got[903].toxic
    model = toxicity.trained(docs, labels)
    z = sum(model.weights[list(model.features).index(toxicity.feature(w))] * math.log1p(2) for w in (b"nasty",))
    assert got[900].severity == pytest.approx(sum(1 / (1 + math.exp(t - z)) for t in model.thresholds)) and list(model.thresholds) == sorted(model.thresholds)


def test_template():
    render = chat_template.compiled("{# c #}{% for m in turns %}{% if loop.first and not loop.last %}>{% elif m.role == 'x' %}X{% else %}-{% endif %}{% generation %}{{ m.text | trim | upper }}{% endgeneration %}{{ 'a' + 'b' + loop.index }}{% endfor %}")
    assert render([{"role": "u", "text": " hi "}, {"role": "x", "text": "yo"}]) == (">HIab1XYOab2", [(1, 3), (7, 9)])
    tree = chat_template.fold(chat_template.parse("a{{ 'b' | upper }}{% if 1 == 1 %}c{% else %}{{ turns }}{% endif %}{{ 2 + 3 }}"))
    assert tree == chat_template.Block((chat_template.Output(chat_template.Const("aBc5")),))
    for bad in ("{{ x }}", "{{ turns.__class__ }}", "{% for a in b %}{% endfor %}", "{% if true %}", "{{ 'a' | eval }}", "{% import os %}", "{{ (1 }}", "{% for t in turns %}{{ t.text.upper }}{% endfor %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compiled(bad)


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "␛1␛0<s>", "␛", "<<SYS>>[/INST]</s></s>"])
def test_escape(text):
    safe = chat_template.escape(text)
    assert chat_template.unescape(safe) == text and not any(c in safe for c in chat_template.CONTROLS)


def test_chat(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    want = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in rows:
        want.setdefault(r.conv_id, []).append((r.turn, r.role or "", r.text or ""))
    got = chat_template.op9_chat_format(spark, SF).collect()
    assert {r.conv_id for r in got} == set(want)
    for r in got:
        turns = sorted(want[r.conv_id])
        both = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(both.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest()) and r.formatted_chars > len(loss)


def test_chat_edges(spark):
    rows = [(None, 0, "user", "a"), (1, 0, None, None), (1, 0, None, None), (2, None, "assistant", "b")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("x"))
    got = {r.conv_id: r for r in chat_template.conversation_digests(chat_template.format_conversations(df)).collect()}
    assert {k: v.n_turns for k, v in got.items()} == {None: 1, 1: 2, 2: 1}
    assert chat_template.format_conversations(df.limit(0)).count() == 0


def test_all_registered(spark):
    assert {int(n[2:].split("_")[0]) for n in queries.queries()} == set(range(1, 14))


def test_rare_ngrams_are_held(spark):
    """A word and a pair seen three times in more than 2^20 tokens are known; the number of shards changes scores by false positives only."""
    held_out = [i for i in range(2000, 2100) if zlib.crc32(str(i).encode()) % 7 == 2]
    train = [i for i in range(200) if zlib.crc32(str(i).encode()) % 7 != 2]
    rows = [(i, " ".join(f"w{(i * 7 + j) % 20000}" for j in range(10_000))) for i in train] + [(1000 + i, "velvet anchor") for i in range(3)]
    rows += list(zip(held_out, ["velvet anchor", "anchor velvet", "absent missing"], strict=False))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in bloom_lm.score_documents(df).collect()}
    pair, apart, unseen = (got[i].score for i in held_out[:3])
    assert got[train[0]].train_tokens > 1 << 20 and [got[i].n_known for i in held_out[:3]] == [3, 3, 1]
    assert pair > apart + 1 and apart > unseen + 0.1  # by the pair, by the words alone
    few = {r.doc_id: r.score for r in bloom_lm.score_documents(df, words=1 << 16, pairs=1 << 16).collect()}
    assert all(few[i] == pytest.approx(r.score, rel=0.02) for i, r in got.items())


def test_blocks_made_in_another_order_fail(spark):
    """Ids are joined by place, so a block whose rows came otherwise the second time must not pass in silence."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, f"word{i} and {i * 7}") for i in range(60)], "doc_id long, text string").coalesce(1)
    assert piece_codec.encode_pieces(docs, model, hold=False).count() == 60

    def other_each_time(parts):
        for part in parts:
            yield part.sample(frac=1.0, random_state=time.time_ns() % 2**32)

    mixed = docs.mapInPandas(other_each_time, docs.schema)
    with pytest.raises(Exception, match="another order"):
        piece_codec.encode_pieces(mixed, model, hold=False).collect()
    found = {r["doc_id"]: r["decoded"] for r in piece_codec.encode_pieces(mixed, model, decode=True).collect()}  # written first, it may
    assert found == {i: f"word{i} and {i * 7}" for i in range(60)}
