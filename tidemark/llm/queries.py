"""Registered queries of this subpackage and their SQL.

SQL expresses op4 (all pairs, which suits small tables), op9, op10 and op13; the others are tested against plain versions.
"""

from __future__ import annotations

from importlib import import_module

from tidemark.llm.quality_rules import BASE, FACTOR, MAX_HOST_RATE, RULES, Z

_MODULES = {
    "op1_permutation_index": "permutation_index",
    "op2_line_dedup": "line_dedup",
    "op3_best_fit_packing": "packing",
    "op4_ngram_jaccard": "ngram_jaccard",
    "op5_pii": "pii",
    "op6_sentencepiece": "piece_codec",
    "op7_lm_score": "bloom_lm",
    "op8_toxicity": "toxicity",
    "op9_chat_format": "chat_template",
    "op10_quality_rules": "quality_rules",
    "op11_wavelet_tokens": "wavelet",
    "op12_whitening": "whitening",
    "op13_prefix_trie": "prefix_trie",
}

_WORD = r"[^\x20\x09-\x0D]+"

_JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) < 3 THEN array_to_string(ws, ' ') ELSE ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 90 * (nx.n + ny.n - k)),
l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS c FROM documents UNION SELECT r.d, l.y FROM r JOIN l ON r.c = l.x)
SELECT d AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id FROM r LEFT JOIN n ON n.doc_id = d GROUP BY 1
"""

_CHAT = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, 20 + length(role) + length(replace(replace(replace(replace(replace(replace(replace(text, '␛', '..'), '<s>', '..'), '</s>', '..'), '[INST]', '..'), '[/INST]', '..'), '<<SYS>>', '..'), '<</SYS>>', '..')) AS size FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(size) AS BIGINT) AS formatted_chars FROM e GROUP BY 1
"""

_FLAGS = {"base_failed": BASE, **RULES}
_ANY_RULE = " OR ".join(f"({x})" for x in RULES.values())


def _each(form: str, flags=_FLAGS, between: str = ", ") -> str:
    """form for every flag: {f} is its name, {rule} its condition."""
    return between.join(form.format(f=f, rule=rule) for f, rule in flags.items())


_QUALITY = rf"""
WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM i),
t AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, i + unnest([0, 1, 2]) AS p FROM t WHERE k > 1) GROUP BY 1),
ln AS (SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w) WHERE regexp_matches(line, '{_WORD}')),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM ln GROUP BY 1),
c AS (SELECT w.doc_id, source, len(ws) AS n_words, length(regexp_replace(text, '[ 	-
]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(dup.lines, 0) AS n_lines FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id)),
j AS (SELECT *, {BASE} AS base_failed, {_ANY_RULE} AS broken FROM c),
h AS (SELECT source, count(*) AS n, {_each("count(*) FILTER ({rule}) AS {f}")} FROM j GROUP BY 1),
m AS (SELECT count(*) / sum(n) AS share, {_each("sum({f}) / sum(n) AS {f}_mean, sum(n * ({f} / n) * ({f} / n)) / sum(n) AS {f}_sq")} FROM h),
a AS (SELECT *, {_each("least(1e6, greatest(1.0, {f}_mean * (1 - {f}_mean) / greatest({f}_sq - {f}_mean * {f}_mean - {f}_mean * (1 - {f}_mean) * share, 1e-9) - 1)) AS {f}_s")} FROM m),
r AS (SELECT h.source, n, {_each("({f} + {f}_mean * {f}_s) / (n + {f}_s) AS {f}_rate")}, a.* FROM h, a),
l AS (SELECT source, base_failed_rate, {_each("{f}_rate - {z} * sqrt({f}_rate * (1 - {f}_rate) / (n + {f}_s + 1)) AS {f}_low".replace("{z}", str(Z)))}, {_each("{k} * {f}_mean AS {f}_usual".replace("{k}", str(FACTOR)))} FROM r),
v AS (SELECT source, base_failed_rate, CASE WHEN base_failed_low > {MAX_HOST_RATE} AND base_failed_low > base_failed_usual THEN 'rejected' WHEN {_each("{f}_low > {f}_usual", RULES, " OR ")} THEN 'suspect' ELSE 'ok' END AS host_verdict FROM l)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, round(base_failed_rate, 6) AS host_rate, host_verdict,
  NOT (base_failed OR host_verdict = 'rejected' OR (host_verdict = 'suspect' AND broken)) AS kept FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""

_TRIE = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY pos) AS ts FROM t GROUP BY 1),
k AS (SELECT conv_id, ts, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::BIGINT) ELSE y >> 1 END)) AS crc FROM o),
h AS (SELECT conv_id, ts, xor(crc, 4294967295::BIGINT) % 6 AS h FROM k),
r AS (SELECT h.conv_id, list_concat(coalesce(o.ts[1:h.h], []), h.ts[h.h + 1:]) AS ts FROM h LEFT JOIN o ON o.conv_id = h.conv_id - h.conv_id % 100),
n AS (SELECT conv_id, d, ts[1:d] AS p, len(ts) = d AS here FROM (SELECT conv_id, ts, unnest(generate_series(0, len(ts))) AS d FROM r)),
g AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (here), '')) AS ends_sha256 FROM n GROUP BY 1, 2),
c AS (SELECT p[1:d - 1] AS p, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * length(g.p[d].text) END AS saved FROM g LEFT JOIN c ON c.p = g.p),
s AS (SELECT p[1:a] AS p, sum(saved) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT p, saved, n_children, unnest(generate_series(0, d)) AS a FROM w) GROUP BY 1)
SELECT w.conv_id, w.d AS depth, q.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.p = w.p LEFT JOIN g q ON w.d > 0 AND q.p = w.p[1:w.d - 1] AND q.d = w.d - 1
"""


def queries() -> dict:
    return {name: getattr(import_module(f"tidemark.llm.{module}"), name) for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard": _JACCARD, "op9_chat_format": _CHAT, "op10_quality_rules": _QUALITY, "op13_prefix_trie": _TRIE}
