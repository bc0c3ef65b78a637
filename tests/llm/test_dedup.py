"""Line dedup and the Jaccard join against plain versions."""

import glob
import os
import random
import tempfile
import time
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _common, _graph, line_dedup, ngram_jaccard

SF = "/root/testdata/sf0.001"


def roots(nodes, edges):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(7, 7)]
    got = {r.node: r.component for r in _graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert got == {n: want[n] for n in got} and all(want[n] == n for n in set(want) - set(got))


def test_filter_loses_nothing(spark):
    keys, rows = spark.range(0, 5000, 7).toDF("k"), spark.range(5000).toDF("k")
    kept = {r.k for r in _graph.maybe_in(rows, "k", _graph.key_filter(keys, "k")).collect()}
    assert kept >= set(range(0, 5000, 7)) and len(kept) < 1000


def shingles(text, width):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def linked_pairs(texts, width, percent):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    out = []
    for a, b in combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            out.append((a, b))
    return out


@pytest.mark.parametrize(("width", "percent", "rare"), [(3, 90, 32), (5, 80, 32), (3, 90, 1), (5, 80, 1)])
def test_jaccard_equals_brute_force(spark, width, percent, rare):
    """With rare=1 every shared shingle is frequent, so that combinations find the pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(1)
    for i, t in list(texts.items())[:60]:  # near copies of several distances
        words = t.split(" ")
        for _ in range(rng.randrange(0, max(2, len(words) // 60))):
            words[rng.randrange(len(words))] = "changed"
        texts[10_000 + i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in ngram_jaccard.jaccard_components(df, width=width, percent=percent, rare=rare).collect()}
    want = roots(texts, linked_pairs(texts, width, percent))
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(shingles(t, width)) for i, t in texts.items()}


def test_row_without_id_stands_for_no_copy(spark):
    """A text's first row of a task has no id; its copies and near copies still link."""
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(None, text), (1, text), (2, text), (3, text + " more"), (None, text)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = ngram_jaccard.jaccard_components(df).collect()
    assert sorted(r.component_id for r in got if r.doc_id) == [1, 1, 1] and [r.component_id for r in got if r.doc_id is None] == [None, None]


@pytest.mark.parametrize("percent", [70, 80, 90, 95])
@pytest.mark.parametrize("order", [0, 1])
def test_linked_sets_share_a_combination(percent, order):
    """Any linked pair that isn't equal shares a combination, also at the limit of the similarity and for small sets, or one of it is known to be at risk."""
    risks = 0
    rng = np.random.default_rng(percent + order)
    for n in [*range(2, 60), *range(60, 400, 17)]:
        for _ in range(30):
            common = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            most = n * (100 - percent) // percent
            if not most:
                continue
            own = int(rng.integers(0, most + 1))
            a, b = (np.unique(np.concatenate([common, rng.integers(1, 1 << 63, k, dtype=np.uint64)])) for k in (own, most - own))
            assert 100 * n >= percent * (n + most)
            (x, risk), (y, other) = (ngram_jaccard.combination_keys(s, percent, order) for s in (a, b))
            risks += risk or other
            assert risk or other or np.intersect1d(x, y).size, (n, own, most)
    assert risks < 300 or percent == 70  # of some 2,000


def test_sets_at_risk_are_compared(spark, monkeypatch):
    """With every set at risk and no combination at all, links are found all the same."""
    monkeypatch.setattr(ngram_jaccard, "group_count", lambda c, percent: 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80)
    texts = {r.doc_id: r.text for r in docs.collect()}
    rng = random.Random(1)
    for i, t in list(texts.items())[:40]:
        words = t.split(" ")
        words[rng.randrange(len(words))] = "changed"
        texts[10_000 + i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(df, width=3, percent=90, rare=1).collect()}
    assert got == roots(texts, linked_pairs(texts, 3, 90))


def test_crowded_keys_are_crossed(spark, monkeypatch):
    """With no pair allowed to a key alone, second keys find the same components; unlike sets that share a passage stay apart."""
    monkeypatch.setattr(_graph, "CROSS", 0)
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(40)]
    texts = {i: " ".join(passage + [f"w{rng.randrange(10**6)}" for _ in range(20)]) for i in range(60)}
    for i in range(60):
        words = texts[i].split(" ")
        words[rng.randrange(40, 60)] = "changed"
        texts[100 + i] = " ".join(words)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_jaccard.jaccard_components(df, width=3, percent=80, rare=1).collect()}
    assert got == roots(texts, linked_pairs(texts, 3, 80)) and len(set(got.values())) == 60


def distance(a, b):
    same = len(os.path.commonprefix([a, b]))
    a, b = a[same:], b[same:]
    same = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[: len(a) - same], b[: len(b) - same]
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_line_dedup(spark):
    base = "the quick brown fox jumps over the lazy dog while many other animals of the forest look on and say nothing at all about it today"
    near = base.replace("today", "todax")
    far = base.replace("quick brown fox", "slow green turtle").replace("lazy dog", "busy cat")
    rows = [(1, f"{base}\nunique one"), (2, f"{base.upper()}.\nunique two"), (3, f"{far}\nthird"), (4, f"{near}\nfourth\nfourth"), (5, "unique two\n" + base)]
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: f"{base}\nunique one", 2: "unique two", 3: f"{far}\nthird", 4: "fourth"}


def normal(line):
    return line.lower().strip(line_dedup._ENDS + " ")


def similar_lines(spark, lines, similarity=0.9):
    """All pairs of edit similarity 0.9 or more; an edit takes two pairs of characters at most, which spares distances that can't be small enough."""
    ordered = sorted(lines, key=lambda t: (len(t), t))
    pairs = np.zeros((len(ordered), 512), dtype=np.int32)
    for row, t in zip(pairs, ordered):
        np.add.at(row, [hash(x) % 512 for x in zip(t, t[1:])], 1)
    size = np.array([len(t) for t in ordered])
    out = []
    for i, a in enumerate(ordered):
        most = (size[i:] * (1 - similarity) + 1e-9).astype(int)
        lost = np.maximum(pairs[i] - pairs[i:], 0).sum(axis=1)
        for j in np.flatnonzero((lost <= 2 * most) & (size[i:] - size[i] <= most))[1:]:
            out.append((a, ordered[i + j], int(most[j])))
    near = spark.createDataFrame(out, "a string, b string, most int").where("levenshtein(a, b) <= most")
    return [(r.a, r.b) for r in near.collect()]


def plainly_deduped(spark, rows):
    """doc_id -> text of rows (doc_id, text) with distinct ids."""
    owner, norms = {}, {normal(x) for _, t in rows for x in (t or "").split("\n")} - {""}
    group = roots(norms, similar_lines(spark, norms))
    for i, t in sorted(rows):
        for x in (t or "").split("\n"):
            if normal(x):
                owner.setdefault(group[normal(x)], i)
    out = {}
    for i, t in rows:
        seen, kept, words = set(), [], not t or not any(map(normal, t.split("\n")))
        for x in (t or "").split("\n"):
            g = group.get(normal(x))
            if g is None or (owner[g] == i and g not in seen):
                kept.append(x)
                words |= g is not None
            seen.add(g)
        if words:
            out[i] = t and "\n".join(kept)
    return out


def test_line_dedup_equals_brute_force(spark):
    """Every link of edit similarity 0.9 is found on this table, so the kept lines are those of all pairs."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    want = plainly_deduped(spark, [(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.text for r in line_dedup.line_dedup(docs).collect()} == want


@pytest.mark.parametrize("length", [12, 25, 40, 80, 200, 600, "dense"])
def test_recall_by_length(spark, length):
    """Of planted edits within similarity 0.9, nine in ten at least are linked; none of unlike lines."""
    rng = random.Random(str(length))
    letters = "abcdefghijklmnopqrstuvwxyz"
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(3000)] + ["the", "of", "and"] * 300
    lines, planted = [], []
    for _ in range(150):
        size = 150 if length == "dense" else length
        line = ""
        while len(line) < size:
            line += rng.choice(vocabulary) + ("" if length == "dense" else " ")
        line = normal(line[:size])
        most, other = int(len(line) * 0.1), list(line)
        for _ in range(rng.randrange(1, max(2, most // 2))) if length in (12, 25, "dense") else ():  # characters
            other[rng.randrange(len(other))] = rng.choice(letters)
        if length not in (12, 25, "dense"):  # words, while they fit
            words, left = line.split(" "), most
            for i in rng.sample(range(len(words)), len(words)):
                left -= max(len(words[i]), 3)
                if left < 0:
                    break
                words[i] = "".join(rng.choice(letters) for _ in range(min(3, max(len(words[i]), 1))))
            other = " ".join(words)
        other = normal("".join(other))
        lines += [line, other]
        planted.append((line, other))
    rows = [(i, x) for i, x in enumerate(lines)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = line_dedup.line_groups(docs, line_dedup.lines_of(docs, "doc_id", "text"), "doc_id", "text").collect()
    norm = {r.line: r.norm for r in line_dedup.lines_of(docs, "doc_id", "text").select("line", "norm").distinct().collect()}
    group = {norm[r.line]: r.group for r in groups}
    true = [(a, b) for a, b in planted if a != b and distance(a, b) <= 0.1 * max(len(a), len(b)) + 1e-9]
    found = sum(group.get(a, a) == group.get(b, b) for a, b in true)
    assert len(true) > 50 and found >= 0.9 * len(true), (found, len(true))


def test_candidates_of_crowded_keys_are_linear(spark):
    """10,000 unlike two-word lines that share a word: candidate pairs follow the lines, not their square."""
    rng = random.Random(4)
    rows = [(i, "chapter " + "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9))) for i in range(10_000)]
    rows += [(10_000 + i, f"chapter {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = line_dedup.durable(line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text")), "known")
    assert line_dedup.candidate_pairs(known).count() < 30 * len(rows)


def test_simhash_blocks_are_certain(spark):
    """Lines that differ in fewer words than there are blocks agree on a block."""
    rng = random.Random(2)
    rows = []
    for i in range(100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 200))]
        other = [*words[3:], *[f"x{rng.randrange(10**6)}" for _ in range(4)]]  # seven differ
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    keys = {}
    for r in line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text")).collect():
        keys.setdefault(r.doc, set()).update(r[k] for k in line_dedup._KEYS if r[k] is not None)
    assert all(keys[2 * i] & keys[2 * i + 1] for i in range(100))


def test_majority(spark):
    """SimHash bits of one block against a plain count; ties take half of their bits of the first hash, half of the last."""
    rng = random.Random(5)
    rows = [sorted(rng.getrandbits(64) - (1 << 63) for _ in range(n)) for n in (1, 2, 3, 4, 5, 6, 7, 8, 40, 63)]
    got = {tuple(r.h): r for r in spark.createDataFrame([(r,) for r in rows], "h array<long>").select("h", line_dedup.majority(F.col("h")).alias("m")).collect()}
    for r in rows:
        g = got[tuple(r)]
        for b in range(64):
            ones = sum(x >> b & 1 for x in r)
            assert (g.m >> b & 1) == ((r[0] if b % 2 == 0 else r[-1]) >> b & 1 if 2 * ones == len(r) else int(2 * ones > len(r)))


def test_linked_lines_are_similar(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    lines = line_dedup.lines_of(docs, "doc_id", "text")
    groups = line_dedup.line_groups(docs, lines, "doc_id", "text")
    norm = {r.line: r.norm for r in lines.select("line", "norm").distinct().collect()}
    found = {}
    for r in groups.select("line", "group").distinct().collect():
        found.setdefault(r.group, []).append(norm[r.line])
    for texts in found.values():
        if len(texts) > 1:
            for t in texts:
                assert any(o is not t and distance(t, o) <= 0.1 * max(len(t), len(o)) for o in texts)


def test_crowded_keys_lose_no_pair(spark):
    """Pairs of all lines that share a block and are near, whatever number shares it, against a plain search of every key."""
    rng = random.Random(9)
    words = "one two three four five six seven eight nine ten of and the to".split()
    made = [" ".join(rng.choice(words) for _ in range(rng.randrange(6, 14))) for _ in range(150)]
    rows = [(i, x) for i, x in enumerate(made + [f"chapter {i}" for i in range(80)])]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id < 60").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    known = line_dedup.durable(line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text")), "known")
    norm = {r.line: r.norm for r in line_dedup.lines_of(docs, "doc_id", "text").select("line", "norm").distinct().collect()}
    by_key, want = {}, set()
    for r in known.collect():
        for k in {r[k] for k in line_dedup._KEYS} - {None}:
            by_key.setdefault(k, []).append(r)
    for held in by_key.values():
        for i, a in enumerate(held):
            for b in held[:i]:
                if ((a.sketch ^ b.sketch) & ((1 << 64) - 1)).bit_count() <= line_dedup.APART:
                    want.add((min(a.line, b.line), max(a.line, b.line)))

    def similar(pairs):
        texts = spark.createDataFrame([(a, b, norm[a], norm[b]) for a, b in pairs], "a long, b long, ta string, tb string")
        return {(r.a, r.b) for r in texts.where("levenshtein(ta, tb) <= floor(greatest(length(ta), length(tb)) * 0.1D + 1e-9)").collect()}

    want = similar(want)
    assert max(map(len, by_key.values())) > 30 and len(want) > 50
    for sizes in ({}, {"crowd": 3}, {"crowd": 3, "cell": 7}):
        got = [tuple(sorted(p)) for p in line_dedup.candidate_pairs(known, **sizes).collect()]
        assert len(got) == len(set(got)) and similar(got) == want, sizes


def test_letters_spare_no_similar_pair(spark):
    """An edit changes the parities of two letters and four pairs at most, whatever the letters."""
    rng = random.Random(3)
    letters = "abcdefghij é中\U0001f600"
    lines = ["".join(rng.choice(letters[:10]) for _ in range(20)) for _ in range(40)]
    other = [x[:4] + rng.choice(letters[10:]) + x[5:12] + rng.choice(letters[10:]) + x[13:] for x in lines]
    docs = spark.createDataFrame(list(enumerate(lines + other)), "doc_id long, text string")
    held = {r.doc: r.letters for r in line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text")).collect()}
    low = (1 << line_dedup.LETTER_BITS) - 1
    odd = [(held[i] ^ held[i + 40]) & ((1 << 64) - 1) for i in range(40)]
    assert len(held) == 80 and all((x & low).bit_count() <= 4 and (x & ~low).bit_count() <= 8 for x in odd)


def test_lines_of_one_crowded_block_are_linked(spark):
    """Two similar lines that agree on a block of 60 lines and on no other: the smallest line of the block is like neither."""
    rng = random.Random(11)
    words = ["".join(rng.choice("bcdfghjklm") for _ in range(5)) for _ in range(400)]
    rows = [(i, "the " + " ".join(rng.sample(words, 12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = line_dedup.durable(line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text")).where("kind = 0"), "known")
    # all lines share one block; two have sketches that are near, each line a block more of its own
    first, *rest = [r.asDict() for r in sorted(known.collect(), key=lambda r: r.line)]
    rows = []
    for i, r in enumerate([first, *rest]):
        near = i in (20, 40)
        rows.append({**r, "length": 70, "letters": None, "sketch": 0x00FF if near else (-1 if i == 0 else 0x5A5A5A5A00000000 ^ rng.getrandbits(62)), "k0": 7, **{f"k{b}": 1000 * i + b for b in range(1, 8)}})
    changed = spark.createDataFrame(rows, known.schema)
    got = {tuple(sorted(p)) for p in line_dedup.candidate_pairs(changed).collect()}
    assert (rows[20]["line"], rows[40]["line"]) in got


def test_rounds_link_the_same_lines(spark, monkeypatch):
    rows = [(i, f"chapter number {i // 3}\nthe same long line of words in document {i}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def groups():
        return sorted(tuple(r) for r in line_dedup.line_groups(docs, line_dedup.lines_of(docs, "doc_id", "text"), "doc_id", "text").collect())

    once = groups()
    monkeypatch.setattr(line_dedup, "ROUND", 60)
    monkeypatch.setattr(line_dedup, "ROUND_A_LINE", 0)
    assert len({r[1] for r in once}) < len(once) and groups() == once


def test_durable_leaves_no_shuffle(spark):
    """The shuffle of a written step goes with the write, and the session's setting is as before."""
    local = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()
    held = lambda: {f for d in local.split(",") for f in glob.glob(f"{d}/**/blockmgr-*/*/shuffle_*", recursive=True)}
    before, setting = held(), spark.conf.get(_common.CLEANUP)
    written = _common.durable(spark.range(10_000).groupBy("id").count(), "counted")
    for _ in range(20):
        if not held() - before:
            break
        time.sleep(0.5)
    assert not held() - before and written.count() == 10_000 and spark.conf.get(_common.CLEANUP) == setting


def test_postings_are_thinned_before_they_are_shuffled(spark, monkeypatch):
    """No anti join with the large keys, which the optimiser puts below the filter, where all postings are shuffled."""
    plans = {}

    def written(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return _common.durable(df, name)

    rows = [(i, f"chapter number {i // 3}\nthe same long line of words in document {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = _common.durable(line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text")), "known")
    monkeypatch.setattr(line_dedup, "durable", written)
    pairs, crowded = line_dedup.first_pairs(known)
    assert pairs.count() > 0 and crowded.count() > 0 and "LeftAnti" not in plans["line-pairs"]


def test_signatures_lose_no_similar_pair(spark):
    """Lines within their edits stay, whatever the edits and letters; of unlike lines of the same syllables most go."""
    rng = random.Random(17)
    syllables = "th an in er on re ed nd ha en to or ti hi as te et ng of al de se le sa si ar ve ra ld ur".split()

    def made(size):
        return "".join(rng.choice(syllables) + (" " if rng.random() < 0.3 else "") for _ in range(size))[:size]

    rows, pairs, near = [], [], set()
    for i, size in enumerate([61, 64, 65, 80, 128, 200, 257, 400, 513, 900, 1025, 3000] * 6):
        a = made(size)
        other, edits = list(a), int(size * 0.09)
        for _ in range(edits):
            at = rng.randrange(len(other))
            kind = rng.randrange(3)
            other[at : at + 1] = [] if kind == 0 else [other[at], rng.choice("ab c")] if kind == 1 else [rng.choice("xyz é\U0001f600" if i % 4 == 0 else "xyz é")]
        rows += [(3 * i, a), (3 * i + 1, "".join(other)), (3 * i + 2, made(size))]
        for j in (1, 2):
            pair = sorted((3 * i, 3 * i + j), key=lambda r: (len(rows[r][1]), r), reverse=True)
            pairs.append(tuple(pair))
            near |= {tuple(pair)} if j == 1 else set()
    texts = spark.createDataFrame(rows, "line long, norm string")
    got = {(r.a, r.b) for r in line_dedup.allowed(spark.createDataFrame(pairs, "a long, b long"), texts, len(rows), 0.9).collect()}
    assert near <= got and len(got - near) < len(near) / 3, (len(near - got), len(got - near))


def test_crowded_keys_in_rounds_give_the_same_pairs(spark, monkeypatch):
    """Keys are taken in rounds, each written by itself."""
    rows = [(i, f"chapter number {i // 3}\nthe same line of words in a document of number {i}") for i in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = line_dedup.durable(line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text")), "known")

    def found():
        return {tuple(r) for r in line_dedup.candidate_pairs(known, crowd=3).collect()}

    once, written = found(), []
    monkeypatch.setattr(line_dedup, "durable", lambda df, name: written.append(name) or _common.durable(df, name))
    monkeypatch.setattr(line_dedup, "ROUND_POSTINGS", 60)
    assert found() == once and written.count("line-others") > 1


def test_blocks_of_parts_equal_a_plain_count(spark):
    """Parts, blocks and their majorities of many hashes, cut out of one sorted array, against each hash put in its place by itself."""
    rng = random.Random(23)
    rows = [(i, 3, level, sorted({rng.getrandbits(64) - (1 << 63) for _ in range(n)})) for i, (level, n) in enumerate([(0, 1), (0, 12), (0, 90), (1, 16), (1, 150), (2, 37), (3, 64), (4, 130), (5, 256), (7, 1100)])]
    df = spark.createDataFrame(rows, "line long, kind int, level int, h array<long>")
    got = line_dedup._voted(line_dedup._dealt(df)).collect()
    want = {}
    for i, kind, level, hashes in rows:
        for h in hashes:
            part = (h >> 20) & ((1 << level) - 1)
            want.setdefault((i, (1 << level) + part + 2 if level else kind, (h >> 61) + 4), []).append(h)
    found = {(r.line, r.kind, r.block): r for r in got if r["size"]}
    assert found.keys() == want.keys() and [sum(r.lead for r in got if r.line == i) for i, *_ in rows] == [1] * len(rows)
    assert {len(h) for h in want.values()} >= {1, 2, 3, 4, 5, 6, 7} and max(map(len, want.values())) > 7
    for k, hashes in want.items():
        n, m = len(hashes), 0
        for b in range(64):
            ones = sum(h >> b & 1 for h in hashes)
            m |= (hashes[-(b % 2)] >> b & 1 if 2 * ones == n else int(2 * ones > n)) << b
        assert (found[k]["size"], found[k].m & ((1 << 64) - 1)) == (n, m), k


def test_features_are_hashed_once(spark):
    """A line's runs are hashed in one place of the plan, not in each place that asks for their number; and no filter sorts them once more."""
    docs = spark.createDataFrame([(1, "a line of words")], "doc_id long, text string")
    plan = line_dedup.known_lines(line_dedup.lines_of(docs, "doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("array_distinct(") <= 4 and plan.count("sort_array(") == 1
