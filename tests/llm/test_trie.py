"""The prefix trie against a plain one, and its sort against sorted()."""

import hashlib
import random
import zlib

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.prefix_trie import TURN, folded, merge_sorted, nodes_of_part, op13_prefix_trie, prefix_trie, shared_turns, turn_sequences
from tidemark.llm.queries import oracle_sql

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(sequences):
    """sequences: id -> list of (turn, size)."""
    members = {}
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members} if len(members) < 300 else None
    if children is None:
        children = {p: [] for p in members}
        for q in members:
            if q:
                children[q[:-1]].append(q)
    out, below = [], {}
    for p in sorted(members, key=len, reverse=True):
        leaves, saved = (sum(below[q][i] for q in children[p]) for i in (0, 1))
        below[p] = leaves or 1, saved + ((len(members[p]) - 1) * p[-1][1] if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *below[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def key(row):
    return row[1], row[0]


def rows_of(sequences):
    """As sorted rows of paths."""
    return sorted((b"".join(hashlib.sha256(str(t).encode()).digest()[:TURN] for t, _ in turns), c, [s for _, s in turns]) for c, turns in sequences.items())


TURNS = st.lists(st.tuples(st.integers(0, 2), st.just(3)), max_size=5)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(-50, 50), TURNS, max_size=30), st.integers(1, 9))
def test_merge_gives_order_and_shared_turns(sequences, run):
    wanted = rows_of(sequences)
    rows = random.Random(run).sample(wanted, len(wanted))
    found = list(merge_sorted(iter(rows), run))
    assert [(p, c, list(s)) for p, c, s, _ in found] == wanted
    assert [lcp for *_, lcp in found] == [shared_turns(a, b) for (a, *_), (b, *_) in zip([(b"",), *wanted], wanted, strict=False)]


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(-50, 50), TURNS, max_size=30), st.lists(st.integers(0, 30), max_size=6))
def test_nodes_of_any_cut_into_parts_add_up(sequences, cuts):
    rows = rows_of(sequences)
    at = sorted({0, *(min(c, len(rows)) for c in cuts), len(rows)})
    given_out = [r for part, (a, b) in enumerate(zip(at, at[1:], strict=False)) for r in nodes_of_part(part, merge_sorted(iter(rows[a:b]), 4))]
    partials = sorted((r for r in given_out if r[1] is not None), key=lambda r: r[:4])
    done = list(folded((*r[:5], *r[7:]) for r in partials))
    parent = {r[:3]: r[4] for r in done if r[0] is not None}
    nodes = [r for r in done if r[0] is None] + [(*r[:6], r[6] if r[5] is None else parent[r[0], r[5], r[2] - 1], *r[7:]) for r in given_out if r[1] is None]
    found = [(r[4], r[2], r[6], *r[7:11], r[13].hex()) for r in nodes]
    assert sorted(found, key=key) == sorted(plain_trie({c: [(t, 3) for t, _ in s] for c, s in sequences.items()}) if sequences else [], key=key)


def plain_rebuilt(rows):
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        own.setdefault(c, []).append(((role or "", text or ""), len(text or "")))
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[: h[c]] + turns[h[c] :] for c, turns in own.items()}


def trie_of(spark, rows, tmp_path, **extra):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return [tuple(r[c] for c in COLUMNS) for r in op13_prefix_trie(spark, str(tmp_path)).collect()]


def test_query_against_a_plain_version_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{folder}/conversations.parquet").collect()]
    found = sorted((tuple(r[c] for c in COLUMNS) for r in op13_prefix_trie(spark, folder).collect()), key=key)
    assert found == sorted(plain_trie(plain_rebuilt(rows)), key=key)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    assert sorted((tuple(r) for r in db.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle_sql()['op13_prefix_trie']})").fetchall()), key=key) == found


def test_hot_groups_over_many_partitions(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in range(600):
        n = rng.randrange(7)
        first = "hot" if c % 3 else f"t{rng.randrange(4)}"
        rows += [(c, i, "user", first if i == 0 else ("same" if c % 5 < 3 else f"x{rng.randrange(3)}")) for i in range(n)]
    rows += [(700, i, "user", "deep") for i in range(300)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "23")
        found = trie_of(spark, rows, tmp_path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(found, key=key) == sorted(plain_trie(plain_rebuilt(rows)), key=key)


def test_edges(spark, tmp_path):
    rows = [
        (0, 1, "user", "a"), (0, None, "user", "b"), (0, 1, None, None), (0, 1, "user", "a"), (1, 0, "u", "ser:a"), (2, 0, "us", "er:a"), (None, 0, "user", "lost"), (-3, 0, "user", ""),
        (-3, 1, "", "x" * 200_000), (100, 2, "user", "é漢😀"), (205, 1, "user", "a"), (206, 1, "user", "a"), (9_000_000_000, 1, None, "z"), (9_000_000_001, 3, "user", "y"),
    ]
    assert sorted(trie_of(spark, rows, tmp_path), key=key) == sorted(plain_trie(plain_rebuilt(rows)), key=key)


def test_empty_tables_and_clashing_names(spark, tmp_path):
    assert trie_of(spark, [], tmp_path) == []
    clash = spark.createDataFrame([(1, 0, "u", "a", "p", 3)], "conv_id long, turn long, role string, text string, path string, turns int")
    assert [tuple(r[c] for c in COLUMNS[:5]) for r in prefix_trie(turn_sequences(clash)).orderBy("depth").collect()] == [(1, 0, None, 1, 1), (1, 1, 1, 1, 0)]


@pytest.mark.parametrize("a,b,n", [(b"", b"", 0), (b"a" * 16, b"a" * 32, 1), (b"a" * 16 + b"b" * 16, b"a" * 16 + b"c" * 16, 1), (b"x" * 16, b"y" * 16, 0)])
def test_shared_turns(a, b, n):
    assert shared_turns(a, b) == n
