"""Registered queries of the sources and the operators on readings, frames and texts: a third part of the catalogue."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import AudioConfig
from tidemark.operators import attempts, audio, keywords, pixels, ranks, recognition
from tidemark.plans.catalogue import events, query
from tidemark.sources import media, pcm
from tidemark.sources.storage import shared_folder


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("""
  WITH s AS (SELECT 'u' || user_id % 20 AS media_id, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1 AS i, cast(floor(value * 60) AS DOUBLE) AS v FROM events)
  SELECT media_id, i // 5 AS w, round(sqrt(avg(v * v)), 6) AS rms, round(20 * log10(greatest(sqrt(avg(v * v)), 1e-7)), 6) AS rms_db, round(20 * log10(greatest(max(abs(v)), 1e-7)), 6) AS peak_db
  FROM s GROUP BY 1, 2 HAVING count(*) = 5""")
def q_pcm_ranges(spark, sf_dir):
    """RMS windows of 5 samples of WAV files, which are written first: read in ranges of 60 samples and rows of 12, which windows span."""
    n = F.row_number().over(Window.partitionBy("media_id").orderBy("event_id")) - 1
    named = events(spark, sf_dir).withColumn("media_id", F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string"))).withColumn("n", n)
    rows = named.select("media_id", "n", F.floor(F.col("value") * 60).cast("int").alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"])
    path = _folder(spark, "wav")
    pcm.write_wav(rows.groupBy("media_id", (F.floor(F.col("n") / 7) * 7).alias("sample_offset")).agg(listed.alias("samples")), path, bits=32)
    out = audio.windows_of_chunks(pcm.read_pcm(spark, path, range=60, chunk=12, mode="FAILFAST", wide="true"), AudioConfig(rate=1000, window_ms=5))
    name = F.regexp_extract("media_id", r"([^/]+)\.wav$", 1)
    return out.select(name.alias("media_id"), "w", *[F.round(c, 6).alias(c) for c in ("rms", "rms_db", "peak_db")])


@query("""
  SELECT 'f' || o_orderkey AS path, k >= 4 AS ok, CASE k WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no video stream' WHEN 2 THEN 'no duration' WHEN 3 THEN 'no duration' END AS error,
    CASE WHEN k >= 4 THEN (o_custkey + 5) / 10.0 END AS duration_s, CASE WHEN k >= 4 THEN 640 + o_custkey % 100 END AS width, CASE WHEN k >= 4 THEN 25.0 END AS fps
  FROM (SELECT *, o_orderkey % 9 AS k FROM orders)""")
def q_probe_attempts(spark, sf_dir):
    """Probed files, four in nine of them bad: each bad one a row with its error beside the good ones."""
    k, c = F.col("o_orderkey") % 9, F.col("o_custkey")
    duration = F.when(k == 2, "0").when(k == 3, "none").otherwise(((c + 5) / 10.0).cast("string"))
    stream = F.concat(F.lit('{"codec_type": "'), F.when(k == 1, "audio").otherwise("video"), F.lit('", "width": '), (640 + c % 100).cast("string"), F.lit(', "height": 360, "r_frame_rate": "25/1"}'))
    text = F.concat(F.lit('{"format": {"duration": "'), duration, F.lit('"}, "streams": ['), stream, F.when(k == 0, "]").otherwise("]}"))
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("path"), text.alias("probe"))
    return media.probe_attempts(rows).select("path", "ok", "error", "result.duration_s", "result.width", "result.fps")


@query("""
  SELECT event_id, CASE WHEN k = 0 THEN 'ValueError: invalid literal for int() with base 10: ''x' || event_id || '''' WHEN k = 1 THEN 'no result' END AS error, CASE WHEN k > 1 THEN event_id * 2 END AS doubled
  FROM (SELECT event_id, event_id % 7 AS k FROM events)""")
def q_routed_attempts(spark, sf_dir):
    """A step that fails on some rows: good and bad rows of one pass, each written to a place of its own and read again."""

    def make():
        def run(row):
            return None if row.event_id % 7 == 1 else {"doubled": 2 * int(row.text)}

        return run

    k = F.col("event_id") % 7
    rows = events(spark, sf_dir).select("event_id", F.concat(F.when(k == 0, "x").otherwise(""), F.col("event_id").cast("string")).alias("text"))
    good, bad = attempts.routed(attempts.attempted(rows, make, "doubled bigint"), _folder(spark, "attempts"))
    return bad.select("event_id", "error").unionByName(good.select("event_id", "doubled"), allowMissingColumns=True)


@query("""
  SELECT 'v' || c_custkey AS media_id, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_nationkey || ',' || c_custkey || ',30,4' ELSE '0,0,9,9' END END AS region,
    CASE WHEN c_custkey % 3 = 0 THEN 'skipped v' || c_custkey || ': no truth' END AS warning FROM customer""")
def q_truth_regions(spark, sf_dir):
    """The region of each video out of truth files: the file's own before the default; videos without truth are skipped with a warning."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("v"), k.cast("string")).alias("media_id"), k, "c_nationkey")
    roi = F.when(k % 2 == 0, F.struct(F.col("c_nationkey").cast("int").alias("x"), k.cast("int").alias("y"), F.lit(30).alias("width"), F.lit(4).alias("height")))
    path = _folder(spark, "truth")
    c.where(k % 3 > 0).select(F.col("media_id").alias("video"), roi.alias("roi")).write.json(path)
    return recognition.regions(c.select("media_id"), media.read_regions(spark, path, lines=True), "0,0,9,9")


@query("""
  WITH RECURSIVE a AS (SELECT event_id, user_id, value < 150 AS co, event_id % 3 <> 0 AS lo, event_id % 4 AS lc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  s AS (
    SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0::BIGINT AS p, 0::BIGINT AS r, 0::BIGINT AS f, 'none' AS b FROM a
    UNION ALL SELECT user_id, n, event_id, CASE b WHEN 'found' THEN lc WHEN 'none' THEN 0 ELSE p END, CASE WHEN b = 'hit' THEN r + 1 WHEN b = 'found' OR (b = 'lost' AND p > 0) THEN 0 ELSE r END,
      CASE WHEN b IN ('hit', 'found') THEN 0 WHEN tries AND NOT co THEN f + 1 ELSE f END, b FROM (
        SELECT *, CASE WHEN tries AND co THEN 'hit' WHEN tries AND (f + 1) % 3 <> 1 THEN 'miss' WHEN NOT lo THEN 'lost' WHEN lc IN (1, 2) THEN 'found' ELSE 'none' END AS b FROM (
          SELECT a.*, s.p, s.r, s.f, s.p IN (1, 2) AND s.r < 5 AS tries FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1)))
  SELECT event_id, CASE WHEN b IN ('hit', 'miss') THEN 'crop' ELSE 'layout' END AS use, b NOT IN ('miss', 'lost') AS ok, CASE WHEN b = 'hit' THEN 'c' || event_id % 10 WHEN b IN ('found', 'none') THEN 'l' || event_id % 7 END AS score,
    CASE b WHEN 'hit' THEN 0.75 WHEN 'miss' THEN 0 ELSE 0.5 END AS confidence FROM s WHERE event_id IS NOT NULL""")
def q_calibrated(spark, sf_dir):
    """Which of two readings counts: of the known place, or of the whole region when that expires or fails."""
    i = F.col("event_id")
    rows = events(spark, sf_dir).select(
        "user_id", "t", "event_id", (F.col("value") < 150).alias("crop_ok"), F.concat(F.lit("c"), (i % 10).cast("string")).alias("crop_score"), F.lit(0.75).alias("crop_confidence"),
        (i % 3 != 0).alias("layout_ok"), F.concat(F.lit("l"), (i % 7).cast("string")).alias("layout_score"), F.lit(0.5).alias("layout_confidence"), (i % 4).alias("layout_crops"),
    )
    return recognition.calibrated(rows, ["user_id"], ["t", "event_id"], carry=["event_id"], expires=5, retry=3).select("event_id", "use", "ok", "score", "confidence")


@query("""
  WITH p AS (SELECT vec_id, unnest(generate_series(0, 63)) AS i, embedding FROM embeddings),
  g AS (SELECT vec_id, (i // 32) * 4 + (i % 8) // 2 AS cell, least(255, greatest(0, floor((embedding[i + 1]::DOUBLE + 1) * 127))) AS v FROM p)
  SELECT vec_id, cell, round_even(avg(v), 0) AS grey FROM g GROUP BY 1, 2""")
def q_frame_signatures(spark, sf_dir):
    """Vectors as grey frames of 8 x 8 pixels of three bytes, and their signatures of 4 x 2 cells."""
    grey = F.transform("embedding", lambda c: F.lpad(F.hex(F.least(F.lit(255), F.greatest(F.lit(0), F.floor((c.cast("double") + 1) * 127)))), 2, "0"))
    data = F.unhex(F.array_join(F.transform(grey, lambda h: F.repeat(h, F.lit(3))), ""))
    frames = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", data.alias("pixels"), F.lit(8).alias("width"), F.lit(8).alias("height"))
    return pixels.signatures(frames, cells=(4, 2)).select("vec_id", F.posexplode("signature").alias("cell", "grey")).withColumn("cell", F.col("cell").cast("long"))


_KEYWORDS = {
    "insult": {"weight": 30, "patterns": ["worthless", "pathetic", "disgusting"]},
    "ending": {"weight": 2.5, "patterns": ["orantion", "orantion ononst"]},
    "phrase": {"weight": 1, "patterns": ["in the", "on the"]},
}
_PATTERNS = ", ".join(
    f"('{name}', {float(k['weight'])}, '{c}', {c.count(' ') + 1}, {len(c.replace(' ', '')) // 5})" for name, k in _KEYWORDS.items() for c in dict.fromkeys(" ".join(keywords.words_of(p)) for p in k["patterns"])
)


@query(rf"""
  WITH w AS (SELECT doc_id, n_chars, list_transform(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: array_to_string(list_filter(string_split(x, ''), lambda c, i: i = 1 or c <> x[i - 1]), '')) AS ws FROM documents),
  p(keyword, weight, pattern, n, most) AS (VALUES {_PATTERNS}),
  i AS (SELECT doc_id, n_chars, ws, len(ws) AS words, unnest(generate_series(1, len(ws))) AS i FROM w WHERE len(ws) > 0),
  h AS (SELECT doc_id, n_chars, words, i - 1 AS word, keyword, weight, pattern, n, most, levenshtein(array_to_string(ws[i:i + n - 1], ' '), pattern) AS differences FROM i JOIN p ON i + n - 1 <= words AND abs(length(array_to_string(ws[i:i + n - 1], ' ')) - length(pattern)) <= most)
  SELECT doc_id, word, keyword, pattern, weight, differences, round(n_chars * word / words, 3) AS t FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, word, keyword ORDER BY differences, n DESC, pattern) AS rank FROM h WHERE differences <= most) WHERE rank = 1""")
def q_keywords(spark, sf_dir):
    """Keywords of a configuration in all texts, drawn-out letters and small differences borne; times by the place among the words."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.lit(0).alias("from"), F.col("n_chars").alias("to"))
    out = keywords.keyword_hits(rows, keywords.keywords_of(_KEYWORDS), start="from", end="to")
    return out.select("doc_id", F.col("word").cast("long").alias("word"), "keyword", "pattern", "weight", F.col("differences").cast("long").alias("differences"), F.round("t", 3).alias("t"))


@query("""
  WITH v AS (SELECT l_returnflag, l_linestatus, list_sort(list(l_extendedprice)) AS x FROM lineitem GROUP BY 1, 2)
  SELECT l_returnflag, l_linestatus, x[len(x) * 9 // 10 + 1] AS high, x[len(x) // 2 + 1] AS middle, x[1] AS low FROM v""")
def q_order_statistics(spark, sf_dir):
    """Exact order statistics of large groups: nine tenths, the upper median and the least."""
    rows, keys = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_returnflag", "l_linestatus"]
    each = [ranks.order_statistic(rows, keys, "l_extendedprice", share=s, out=o) for s, o in ((0.9, "high"), (0.5, "middle"), (0.0, "low"))]
    return each[0].join(each[1], keys).join(each[2], keys)
