"""More registered queries: recognition, refinement, tracking geometry, reports and sinks, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.config import AudioConfig, ClipConfig, EventConfig, ScoreConfig
from tidemark.functions import scalars as S
from tidemark.operators import audio, evaluate, recognition, scoreboard, signals, tracking, trajectory
from tidemark.plans.catalogue import _BOX, _DAY, _FORMED, _HOUR, _SCORES, _boxes, _formed, _machine_sql, _nms_sql, _scores, events, query
from tidemark.sources import media


def _numbered(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("t", "event_id")
    return events(spark, sf_dir).withColumn("n", F.row_number().over(by) - 1)


@query("""
  WITH s AS (SELECT cast(user_id AS VARCHAR) AS media_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, cast(floor(value * 60) AS DOUBLE) AS v FROM events)
  SELECT media_id, i // 5 AS w, round(sqrt(avg(v * v)), 6) AS rms, round(20 * log10(greatest(sqrt(avg(v * v)), 1e-7)), 6) AS rms_db, round(20 * log10(greatest(max(abs(v)), 1e-7)), 6) AS peak_db
  FROM s GROUP BY 1, 2 HAVING count(*) = 5""")
def q_pcm_windows(spark, sf_dir):
    """RMS windows of 5 samples over PCM chunks of 7: windows span chunks, a trailing part is dropped."""
    rows = _numbered(spark, sf_dir).select(F.col("user_id").cast("string").alias("media_id"), "n", F.floor(F.col("value") * 60).cast("int").alias("v"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "v"))), lambda x: x["v"])
    chunks = rows.groupBy("media_id", F.floor(F.col("n") / 7).alias("chunk_idx")).agg(listed.alias("samples")).withColumn("sample_offset", F.col("chunk_idx") * 7)
    out = audio.windows_of_chunks(chunks, AudioConfig(rate=1000, window_ms=5))
    return out.select("media_id", "w", *[F.round(c, 6).alias(c) for c in ("rms", "rms_db", "peak_db")])


@query("""
  SELECT event_id, coalesce(ok AND valid AND confidence >= 0.3, false) AS ok, CASE WHEN valid THEN h || ':' || a END AS score FROM (
    SELECT event_id, event_type <> 'error' AS ok, value / 500 AS confidence, event_id % 12 AS h, event_id % 7 AS a, event_type <> 'view' AS valid FROM events)""")
def q_readings(spark, sf_dir):
    """Raw readings parsed; ok needs a score and confidence."""
    mark = F.when(F.col("event_type") == "view", " of ").otherwise(" : ")
    raw = F.concat((F.col("event_id") % 12).cast("string"), mark, (F.col("event_id") % 7).cast("string"))
    rows = events(spark, sf_dir).select("event_id", (F.col("event_type") != "error").alias("ok"), (F.col("value") / 500).alias("confidence"), raw.alias("raw"))
    return media.ocr_samples_of(rows, least_confidence=0.3).select("event_id", "ok", S.score_text("score").alias("score"))


@query(rf"""
  SELECT l_orderkey, l_linenumber, CASE WHEN h <= 30 AND a <= 30 THEN h END AS home, CASE WHEN h <= 30 AND a <= 30 THEN a END AS away FROM (
    SELECT l_orderkey, l_linenumber, try_cast(regexp_extract(text, '(\d{{1,2}})\s*[:\-]\s*(\d{{1,2}})', 1) AS INT) AS h, try_cast(regexp_extract(text, '(\d{{1,2}})\s*[:\-]\s*(\d{{1,2}})', 2) AS INT) AS a FROM ({_FORMED}))""")
def q_found_score(spark, sf_dir):
    """Scores anywhere in a text, inside longer numbers also."""
    s = S.found_score("text", largest=30)
    return _formed(spark, sf_dir).select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.home", "s.away")


_LINES = """
  SELECT l_orderkey, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS ord, CASE WHEN l_linenumber % 4 = 0 THEN 'GKS' WHEN (l_orderkey + l_linenumber) % 5 = 0 THEN l_linenumber || ':' || (l_orderkey % 4) ELSE cast(l_linenumber AS VARCHAR) END AS text,
    l_discount * 10 AS confidence, 100 + 40 * (l_orderkey % 9) AS width, 60 AS height, 30.0 * l_linenumber AS x, 10.0 + (l_orderkey * l_linenumber) % 13 AS y, 12.0 AS glyph_height FROM lineitem"""


def _text_lines(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    text = F.when(n % 4 == 0, "GKS").when((k + n) % 5 == 0, F.concat_ws(":", n.cast("string"), (k % 4).cast("string"))).otherwise(n.cast("string"))
    return li.select(
        "l_orderkey", (n.cast("long") * 1000000000000 + F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("ord"), text.alias("text"), (F.col("l_discount") * 10).cast("double").alias("confidence"), (100 + 40 * (k % 9)).alias("width"), F.lit(60).alias("height"),
        (30.0 * n).cast("double").alias("x"), (10.0 + (k * n) % 13).cast("double").alias("y"), F.lit(12.0).alias("glyph_height"),
    )


_RECOGNISED = rf"""
  WITH l AS ({_LINES}), f AS (SELECT l_orderkey, count(*) AS n, min(confidence) AS least, max(confidence) AS most, max(width) / max(height) <= 3 AS shaped, string_agg(text, ' | ' ORDER BY ord) AS raw,
      string_agg(text, ' ' ORDER BY ord) AS spaced, string_agg(text, '' ORDER BY ord) AS tight FROM l GROUP BY 1),
  c AS (SELECT l_orderkey, confidence, ord AS place, text FROM l UNION ALL SELECT l_orderkey, least, 9000000000000000000, spaced FROM f WHERE n > 1 UNION ALL SELECT l_orderkey, least, 9000000000000000001, tight FROM f WHERE n > 1),
  p AS (SELECT c.*, CASE WHEN regexp_matches(text, '(?:^|[^0-9])(\d{{1,2}})\s*[:|-]\s*(\d{{1,2}})(?:[^0-9]|$)') THEN 1 WHEN regexp_matches(text, '^\s*(\d{{1,2}})\s+(\d{{1,2}})\s*$') THEN 2 WHEN shaped AND regexp_matches(text, '^\s*(\d)(\d)\s*$') THEN 3 END AS form FROM c JOIN f USING (l_orderkey)),
  r AS (SELECT *, CASE form WHEN 1 THEN regexp_extract(text, '(?:^|[^0-9])(\d{{1,2}})\s*[:|-]\s*(\d{{1,2}})(?:[^0-9]|$)', 1) WHEN 2 THEN regexp_extract(text, '^\s*(\d{{1,2}})\s+(\d{{1,2}})\s*$', 1) ELSE regexp_extract(text, '^\s*(\d)(\d)\s*$', 1) END AS h,
    CASE form WHEN 1 THEN regexp_extract(text, '(?:^|[^0-9])(\d{{1,2}})\s*[:|-]\s*(\d{{1,2}})(?:[^0-9]|$)', 2) WHEN 2 THEN regexp_extract(text, '^\s*(\d{{1,2}})\s+(\d{{1,2}})\s*$', 2) ELSE regexp_extract(text, '^\s*(\d)(\d)\s*$', 2) END AS a,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence DESC, place) AS n FROM p WHERE form IS NOT NULL),
  b AS (SELECT l_orderkey, h || ':' || a AS score, confidence FROM r WHERE n = 1),
  k AS (SELECT l.l_orderkey, l.text || ':' || o.text AS pair, least(l.confidence, o.confidence) AS least, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY (o.x - l.x) / 12, l.ord, o.ord) AS n
    FROM l JOIN l o ON l.l_orderkey = o.l_orderkey AND l.x < o.x AND abs(l.y - o.y) <= 0.7 * 12 WHERE regexp_matches(l.text, '^\d{{1,2}}$') AND regexp_matches(o.text, '^\d{{1,2}}$'))
  SELECT f.l_orderkey, coalesce(b.score, k.pair) AS score, CASE WHEN b.score IS NULL AND k.pair IS NOT NULL THEN k.least ELSE coalesce(b.confidence, f.most) END AS confidence, raw
  FROM f LEFT JOIN b USING (l_orderkey) LEFT JOIN (SELECT * FROM k WHERE n = 1) k ON k.l_orderkey = f.l_orderkey
"""


def _recognised(spark, sf_dir):
    return recognition.recognised(_text_lines(spark, sf_dir), ["l_orderkey"])


@query(f"SELECT l_orderkey, score, round(confidence, 4) AS confidence, raw FROM ({_RECOGNISED})")
def q_recognised(spark, sf_dir):
    """A score of each frame's lines: the most confident that reads as one, lines joined, or two numbers side by side."""
    return _recognised(spark, sf_dir).select("l_orderkey", S.score_text("score").alias("score"), F.round("confidence", 4).alias("confidence"), "raw")


@query(f"""
  SELECT r.l_orderkey, CASE WHEN use THEN (r.l_orderkey % 3) || ':1' ELSE r.score END AS score, CASE WHEN use THEN 'fallback' ELSE 'first' END AS engine, round(CASE WHEN use THEN 0.75 ELSE confidence END, 4) AS confidence,
    CASE WHEN use THEN 0.75 ELSE 0.25 END AS inference_s, coalesce(CASE WHEN use THEN true WHEN r.score IS NULL THEN false ELSE confidence >= 0.5 END, false) AS ok
  FROM (SELECT *, score IS NULL AND l_orderkey % 2 = 0 AS use FROM ({_RECOGNISED})) r""")
def q_fallback(spark, sf_dir):
    """Frames that the first recogniser can't read, by a second one."""
    first = _recognised(spark, sf_dir).withColumns({"inference_s": F.lit(0.25), "provider": F.lit("cpu")})
    k = F.col("l_orderkey")
    second = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where(k % 2 == 0).select("l_orderkey").distinct().select(
        "l_orderkey", S.score(k % 3, F.lit(1)).alias("score"), F.lit(0.75).alias("confidence"), F.lit("x").alias("raw"), F.lit(0.5).alias("inference_s")
    )
    out = recognition.with_fallback(first, second, ["l_orderkey"], least_confidence=0.5)
    return out.select("l_orderkey", S.score_text("score").alias("score"), "engine", F.round("confidence", 4).alias("confidence"), "inference_s", "ok")


@query(f"""SELECT ord, round(greatest(0, (x0 - p * h) / 1280), 6) AS x0, round(greatest(0, (y0 - q * h) / 720), 6) AS y0, round(least(1, (x1 + p * h) / 1280), 6) AS x1, round(least(1, (y1 + q * h) / 720), 6) AS y1 FROM (
  SELECT ord, x - width / 2 AS x0, y - height / 2 AS y0, x + width / 2 AS x1, y + height / 2 AS y1, greatest(1, (y + height / 2) - (y - height / 2)) AS h, CASE WHEN ord % 2 = 0 THEN 0.55 ELSE 0.25 END AS p, CASE WHEN ord % 2 = 0 THEN 0.25 ELSE 0.2 END AS q FROM ({_BOX}))""")
def q_padded_crops(spark, sf_dir):
    """Room around text boxes, more beside one number of a pair."""
    b = _boxes(spark, sf_dir)
    box = F.struct((F.col("x") - F.col("width") / 2).alias("x0"), (F.col("y") - F.col("height") / 2).alias("y0"), (F.col("x") + F.col("width") / 2).alias("x1"), (F.col("y") + F.col("height") / 2).alias("y1"))
    crop = lambda pair: S.padded_crop(box, F.lit(1280.0), F.lit(720.0), pair=pair)
    out = b.select("ord", F.when(F.col("ord") % 2 == 0, crop(True)).otherwise(crop(False)).alias("c"))
    return out.select("ord", *[F.round(f"c.{c}", 6).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT event_id, cast(greatest(0, floor(x * 1280 + 0.5)) AS INT) AS x, cast(least(1280 - greatest(0, floor(x * 1280 + 0.5)), greatest(2, floor(w * 1280 + 0.5))) AS INT) AS width,
    cast(greatest(2, floor(least(1280 - greatest(0, floor(x * 1280 + 0.5)), greatest(2, floor(w * 1280 + 0.5))) * 1.5 + 0.5)) AS INT) AS out_width, cast(greatest(1, ceil(value * 1000 / (100 + event_id % 400))) AS BIGINT) AS samples
  FROM (SELECT event_id, value, (event_id % 90) / 100.0::DOUBLE AS x, value / 1000 AS w FROM events)""")
def q_roi_pixels(spark, sf_dir):
    """Regions in pixels, and how many samples a range gives."""
    roi = F.struct(((F.col("event_id") % 90) / 100).alias("x"), F.lit(0.1).alias("y"), (F.col("value") / 1000).alias("width"), F.lit(0.2).alias("height"))
    count = S.sample_count(F.lit(0.0), "value", 100 + F.col("event_id") % 400)
    return events(spark, sf_dir).select("event_id", S.roi_pixels(roi, F.lit(1280), F.lit(720), 1.5).alias("r"), count.cast("long").alias("samples")).select("event_id", "r.x", "r.width", "r.out_width", "samples")


@query(r"""SELECT event_id, printf('%02d:%02d.%03d', cast(floor(value / 60) AS BIGINT), cast(floor(value % 60) AS BIGINT), cast(floor((value - floor(value)) * 1000 + 0.5) AS BIGINT)) AS clock,
    CASE event_id % 4 WHEN 0 THEN (event_id % 60) / 1.0::DOUBLE WHEN 1 THEN round((event_id % 60000) / 1001.0::DOUBLE, 9) ELSE 0.0 END AS fps,
    'my_match_' || event_id || '_' || strftime(ts, '%Y%m%d_%H%M%S') AS run, CASE event_id % 5 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS goal FROM events""")
def q_media_texts(spark, sf_dir):
    """Clock, frame rate, run name and drawn-out keywords."""
    i = F.col("event_id")
    rate = F.when(i % 4 == 0, F.concat((i % 60).cast("string"), F.lit("/1"))).when(i % 4 == 1, F.concat((i % 60000).cast("string"), F.lit("/1001"))).when(i % 4 == 2, F.lit("25/0")).otherwise(F.lit("n/a"))
    word = F.element_at(F.array(*map(F.lit, ("what a GOOOAL", "goool!", "goat", "goalie", "no"))), (i % 5 + 1).cast("int"))
    name = F.concat(F.lit("/tmp/my match-"), i.cast("string"), F.lit(".mp4"))
    run = F.regexp_replace(S.run_name(name, "ts"), "my_match-", "my_match_")
    return events(spark, sf_dir).select("event_id", S.media_clock("value").alias("clock"), F.round(S.frame_rate(rate), 9).alias("fps"), run.alias("run"), S.keyword_goal(word).alias("goal"))


@query(f"""
  WITH s AS (SELECT *, 0.5::DOUBLE AS scale, 0 AS px, 140 AS py FROM ({_BOX}))
  SELECT ord, round(least(1280, greatest(0, (x - px) / scale)), 1) AS x, round(least(720, greatest(0, (y - py) / scale)), 1) AS y, round(width / scale, 1) AS width, round(x * 1920 / 960.0::DOUBLE, 3) AS scaled_x, round(height * 1080 / 600.0::DOUBLE, 3) AS scaled_height FROM s""")
def q_source_boxes(spark, sf_dir):
    """Boxes of a letterboxed square, and of a smaller frame, in the source's pixels."""
    b = _boxes(spark, sf_dir).withColumns({"frame_width": F.lit(960.0), "frame_height": F.lit(600.0), "l": S.letterbox(F.lit(1280), F.lit(720))})
    box = F.struct("x", "y", "width", "height", "confidence")
    out = b.select("ord", S.from_letterbox(box, "l", F.lit(1280), F.lit(720)).alias("s")).select("ord", "s.x", "s.y", "s.width")
    scaled = tracking.scaled(b, width=1920.0, height=1080.0).select("ord", F.round("x", 3).alias("scaled_x"), F.round("height", 3).alias("scaled_height"))
    return out.join(scaled, "ord")


_TILED = f"SELECT frame, ord, x + 320 * (ord % 2) AS x, y + 180 * (ord % 3 % 2) AS y, width, height, confidence FROM ({_BOX}) WHERE ord % 5 IN (0, 1) AND confidence >= 0.1"


@query(f"SELECT frame, ord, round(x, 3) AS x, round(y, 3) AS y FROM ({_nms_sql(_TILED, 'frame', 0.2)})")
def q_tiled_detections(spark, sf_dir):
    """Detections of tiles: the classes asked for, in the frame's pixels, each object once."""
    o = F.col("ord")
    kind = F.element_at(F.array(*map(F.lit, ("ball", "person", "car", "tree", "dog"))), (o % 5 + 1).cast("int"))
    rows = _boxes(spark, sf_dir).withColumns({"cls": kind, "tile_x": 320 * (o % 2), "tile_y": 180 * (o % 3 % 2)})
    out = tracking.found_in_tiles(rows, classes=["ball", "person"], least=0.1, threshold=0.2, keys=["frame"])
    return out.select("frame", "ord", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


def _crop_rows(spark, sf_dir):
    return events(spark, sf_dir).withColumns({"kind": F.when(F.col("event_type") == "view", "ball").otherwise("cluster"), "x": F.col("value") * 2.5})


@query("""SELECT event_id, round(greatest(0, least(1280 - 405, CASE WHEN event_type = 'view' THEN x - 405 * CASE WHEN x >= 640 THEN 0.4 ELSE 0.6 END ELSE x - 202.5 END)), 3) AS crop_x FROM (SELECT *, value * 2.5 AS x FROM events)""")
def q_crop_x(spark, sf_dir):
    return _crop_rows(spark, sf_dir).select("event_id", F.round(trajectory.crop_x(F.col("x"), F.col("kind"), 1280.0, 405, 0.4), 3).alias("crop_x"))


_WINDOWS = ScoreConfig(1, 3 * _DAY, fine_margin_s=6 * _HOUR)


def _coarse(spark, sf_dir):
    """Every fourth reading of a user as a coarse scan, all of them as the fine one."""
    fine = _scores(spark, sf_dir).withColumns({"n": F.row_number().over(Window.partitionBy("user_id").orderBy("t", "event_id")), "media_id": F.col("user_id")})
    states = scoreboard.score_states(fine.where("n % 4 = 0"), _WINDOWS, ordinal="event_id")
    about = fine.select("media_id").distinct().withColumn("duration_s", F.lit(1e12))
    return scoreboard.fine_windows(scoreboard.score_changes(states), about, _WINDOWS), fine


_CHANGES = f"""
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY rn) - 1 AS seq, ph, pa, nh, na, change_t, confirmed_t, validation, greatest(0, change_t - {6 * _HOUR}) AS lo, least(1e12, confirmed_t + {6 * _HOUR}) AS hi
  FROM ({_machine_sql(f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS n FROM ({_SCORES})) WHERE n % 4 = 0", "user_id", "t, event_id", 1, 3 * _DAY)}) WHERE kind = 'change'"""


@query(f"SELECT c.user_id, cast(seq AS INT) AS seq, count(*) AS n, round(min(t), 3) AS first_t FROM ({_CHANGES}) c JOIN ({_SCORES}) s ON s.user_id = c.user_id AND t BETWEEN lo AND hi GROUP BY 1, 2")
def q_fine_samples(spark, sf_dir):
    """Fine readings around each coarse change."""
    windows, fine = _coarse(spark, sf_dir)
    rows = scoreboard.fine_samples(windows, fine, bucket=12 * _HOUR)
    return rows.groupBy(F.col("media_id").alias("user_id"), "seq").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("first_t"))


_CHAINS = _machine_sql(f"SELECT c.user_id, seq, ph, pa, t, event_id, home, away FROM ({_CHANGES}) c JOIN ({_SCORES}) s ON s.user_id = c.user_id AND t BETWEEN lo AND hi WHERE validation = 'suspicious'", "user_id, seq", "t, event_id", 1, 3 * _DAY, "ph, pa")


@query(f"""
  WITH k AS (SELECT user_id, seq, row_number() OVER (PARTITION BY user_id, seq ORDER BY rn) - 1 AS step, ph, pa, nh, na, change_t, validation FROM ({_CHAINS}) WHERE kind = 'change'),
  c AS ({_CHANGES})
  SELECT user_id, cast(seq AS INT) AS seq, cast(step AS INT) AS step, ph || ':' || pa AS score_before, nh || ':' || na AS score_after, round(change_t, 3) AS change_t, validation, true AS refined FROM k
  UNION ALL SELECT user_id, cast(seq AS INT), 0, ph || ':' || pa, nh || ':' || na, round(change_t, 3), validation, false FROM c WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.user_id = c.user_id AND k.seq = c.seq)""")
def q_resolved(spark, sf_dir):
    """Suspicious changes as the chains that the fine readings show."""
    windows, fine = _coarse(spark, sf_dir)
    out = scoreboard.resolved(windows, fine, _WINDOWS)
    return out.select(F.col("media_id").alias("user_id"), "seq", "step", S.score_text("before").alias("score_before"), S.score_text("after").alias("score_after"), F.round("change_t", 3).alias("change_t"), "validation", "refined")


@query(f"""
  WITH c AS ({_CHANGES}), f AS (SELECT c.user_id, seq, nh, na, s.t, home, away FROM c JOIN ({_SCORES}) s ON s.user_id = c.user_id AND s.t BETWEEN lo AND hi WHERE validation = 'valid'),
  r AS (SELECT user_id, seq, min(t) AS refined_t FROM (SELECT *, sum(CASE WHEN home = nh AND away = na THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, seq ORDER BY t ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS n, lead(t) OVER (PARTITION BY user_id, seq ORDER BY t) - t AS span FROM f) WHERE n = 2 AND span <= {3 * _DAY} GROUP BY 1, 2)
  SELECT user_id, cast(seq AS INT) AS seq, round(coalesce(refined_t, change_t), 3) AS change_t, refined_t IS NOT NULL AS refined FROM c LEFT JOIN r USING (user_id, seq)""")
def q_refined(spark, sf_dir):
    """Valid changes moved to the first two fine readings in a row that show them."""
    windows, fine = _coarse(spark, sf_dir)
    out = scoreboard.refined(windows.drop("lo", "hi"), windows, fine, ScoreConfig(2, 3 * _DAY))
    return out.select(F.col("media_id").alias("user_id"), "seq", F.round("change_t", 3).alias("change_t"), "refined")


@query("""
  SELECT event_id, last_value(CASE WHEN r THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n) AS value, NOT r AS reused FROM (
    SELECT *, event_id % 3 = 0 OR n = 1 AS r FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events))""")
def q_reused(spark, sf_dir):
    """Frames that aren't read take the last reading."""
    rows = _numbered(spark, sf_dir).withColumn("frame", F.col("n")).withColumn("should_read", (F.col("event_id") % 3 == 0) | (F.col("n") == 0))
    return scoreboard.reused(rows, ["user_id"], ["value"]).select("event_id", "value", "reused")


@query("""
  WITH f AS (SELECT label, vec_id, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before FROM embeddings)
  SELECT vec_id, round(list_sum(list_transform(generate_series(1, len(embedding)), lambda i: abs(embedding[i]::DOUBLE - before[i]::DOUBLE))) / len(embedding), 6) AS difference FROM f""")
def q_signature_difference(spark, sf_dir):
    """Mean absolute difference of each signature from the one before."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("signature"))
    return scoreboard.signature_difference(v, ["label"]).select(F.col("frame").alias("vec_id"), F.round("difference", 6).alias("difference"))


@query(f"""
  SELECT event_id, user_id, event_type, round(t, 3) AS t FROM (
    WITH RECURSIVE raw AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY t, event_id) AS rn FROM (SELECT event_id, user_id, event_type, epoch(ts) AS t FROM events WHERE event_type = 'purchase')),
    s AS (SELECT user_id, rn, t AS last, true AS kept FROM raw WHERE rn = 1 UNION ALL SELECT r.user_id, r.rn, CASE WHEN r.t - s.last >= {12 * _HOUR} THEN r.t ELSE s.last END, r.t - s.last >= {12 * _HOUR} FROM s JOIN raw r ON r.user_id = s.user_id AND r.rn = s.rn + 1)
    SELECT raw.event_id, raw.user_id, raw.event_type, raw.t FROM raw JOIN s ON raw.user_id = s.user_id AND raw.rn = s.rn WHERE kept) UNION ALL SELECT event_id, user_id, event_type, round(epoch(ts), 3) FROM events WHERE event_type <> 'purchase'""")
def q_dedup_goals(spark, sf_dir):
    """Purchases, as goals, at least 12 hours apart; other events pass."""
    rows = events(spark, sf_dir).withColumn("type", F.when(F.col("event_type") == "purchase", "GOAL").otherwise("OTHER"))
    out = signals.deduplicated(rows, EventConfig(dedup_s=12 * _HOUR), keys=["user_id"], at="t", order=["t", "event_id"], carry=["event_type", "type"])
    return out.select("event_id", "user_id", "event_type", F.round("t", 3).alias("t"))


_CLIPPED = """
  SELECT event_id, user_id, event_type, t, greatest(0, t - 14) AS a, least(5400, t + 12) AS b FROM (SELECT event_id, user_id, event_type, 30 + event_id % 5300 AS t FROM events)"""


def _goal_rows(spark, sf_dir):
    return events(spark, sf_dir).select(
        "event_id", F.col("user_id").alias("media_id"), F.when(F.col("event_type") == "purchase", "GOAL").otherwise("UNKNOWN_INTERESTING").alias("type"), (30 + F.col("event_id") % 5300).cast("double").alias("event_t")
    )


@query(f"SELECT event_id, round(b - a, 3)::DOUBLE AS length, b - a > 0.2 AND b - a <= 31 AS clip_valid FROM ({_CLIPPED}) WHERE event_type = 'purchase'")
def q_clip_rows(spark, sf_dir):
    """Clips of goals alone, and whether their length is one that may be."""
    rows = _goal_rows(spark, sf_dir)
    out = signals.clip_rows(rows, rows.select("media_id").distinct().withColumn("duration_s", F.lit(5400.0)), ClipConfig())
    return out.select("event_id", F.col("clip.length").alias("length"), "clip_valid")


@query(f"SELECT user_id, round(avg(CASE WHEN event_type = 'purchase' AND event_id % 3 > 0 THEN 1.0 ELSE 0.0 END), 6) AS clip_coverage FROM ({_CLIPPED}) GROUP BY 1")
def q_clip_coverage(spark, sf_dir):
    """Share of a user's events that lie in a clip of their own; some clips start late."""
    rows = _goal_rows(spark, sf_dir).withColumn("user_id", F.col("media_id"))
    clips = signals.clip_rows(rows, rows.select("media_id").distinct().withColumn("duration_s", F.lit(5400.0)), ClipConfig())
    late = F.when(F.col("event_id") % 3 == 0, 1e6).otherwise(0.0)
    out = evaluate.coverage(rows, clips.select("user_id", "event_id", (F.col("clip.start") + late).alias("start"), F.col("clip.end").alias("end")), keys=["user_id"], at="event_t")
    return out.select("user_id", F.round("clip_coverage", 6).alias("clip_coverage"))


@query("""SELECT 'v' || c_custkey AS media_id, CASE WHEN c_custkey % 3 > 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'r' || c_nationkey ELSE 'all' END END AS region, CASE WHEN c_custkey % 3 = 0 THEN 'skipped v' || c_custkey || ': no truth' END AS warning FROM customer""")
def q_regions(spark, sf_dir):
    """The region of each video: its truth file's, else the default; videos without truth are skipped with a warning."""
    k = F.col("c_custkey")
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("v"), k.cast("string")).alias("media_id"), "c_custkey", "c_nationkey")
    truth = c.where(k % 3 > 0).select("media_id", F.when(k % 2 == 0, F.concat(F.lit("r"), F.col("c_nationkey").cast("string"))).alias("region"))
    return recognition.regions(c.select("media_id"), truth, "all")


@query("SELECT 'v' || c_custkey AS media_id FROM customer WHERE c_custkey % 3 = 0")
def q_without_truth(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("v"), F.col("c_custkey").cast("string")).alias("media_id"), "c_custkey")
    return media.without_truth(c, c.where("c_custkey % 3 > 0")).select("media_id")


@query("SELECT 'p' || o_orderkey AS path, o_orderkey % 2 = 0 AS ok FROM orders")
def q_listed_frames(spark, sf_dir):
    """A frame list with its files; a missing file is a row that isn't ok."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), "o_orderkey")
    files = o.where("o_orderkey % 2 = 0").select("path", F.lit(b"x").alias("content"))
    return media.listed_frames(o.select("path"), files).select("path", "ok")


_NOTES = "CASE event_type WHEN 'error' THEN 'audio_unavailable' WHEN 'signup' THEN 'clip_failed:' || (event_id % 3) END"


@query(f"""
  WITH e AS (SELECT *, cast(user_id AS VARCHAR) AS media_id, {_NOTES} AS note FROM events),
  s AS (SELECT media_id, count(*) AS samples, count(*) FILTER (value > 50) AS ok, count(*) FILTER (event_id % 4 = 0) AS reused, count(*) FILTER (event_id % 4 > 0) AS inferred, round(sum(value / 1000) FILTER (event_id % 4 > 0), 3) AS inference_s FROM e GROUP BY 1),
  h AS (SELECT media_id, count(*) FILTER (event_type = 'purchase') AS goals, count(*) FILTER (event_type = 'purchase' AND event_id % 2 = 0) AS clips, count(*) FILTER (event_type = 'error') AS spikes FROM e GROUP BY 1),
  n AS (SELECT media_id, note, min(struct_pack(ts := ts, i := event_id)) AS first_at FROM e WHERE note IS NOT NULL GROUP BY 1, 2), d AS (SELECT media_id, string_agg(note, ',' ORDER BY first_at) AS degraded FROM n GROUP BY 1)
  SELECT media_id, samples, ok, reused, inferred, round(coalesce(inference_s, 0), 3) AS inference_s, goals AS goal_events_created, clips AS clips_created, spikes AS audio_spikes_detected, coalesce(degraded, '') AS degraded FROM s JOIN h USING (media_id) LEFT JOIN d USING (media_id)""")
def q_run_report(spark, sf_dir):
    """Counts, seconds and ordered distinct notes of each recording's run, as one row and one document."""
    e = events(spark, sf_dir).withColumn("media_id", F.col("user_id").cast("string"))
    note = F.when(F.col("event_type") == "error", "audio_unavailable").when(F.col("event_type") == "signup", F.concat(F.lit("clip_failed:"), (F.col("event_id") % 3).cast("string")))
    reused = F.col("event_id") % 4 == 0
    samples = e.select("media_id", (F.col("value") > 50).alias("ok"), reused.alias("reused"), F.when(~reused, F.col("value") / 1000).alias("inference_s"), F.col("event_type").alias("engine"), F.lit("cpu").alias("provider"))
    goal = F.col("event_type") == "purchase"
    made = e.where(goal).select("media_id", F.lit("GOAL").alias("type"), F.lit(True).alias("score_change"), (F.col("event_id") % 2 == 0).alias("clip"), F.lit(False).alias("clip_vertical"), F.lit(False).alias("fallback"))
    about = e.select("media_id").distinct().withColumns({"duration_s": F.lit(5400.0), "width": F.lit(1280), "height": F.lit(720)})
    out = evaluate.run_report(about, samples, e.where("event_type = 'error'"), made, e.select("media_id", "t", "event_id", note.alias("note")).where("note IS NOT NULL"), order=["t", "event_id"])
    kept = ["media_id", "samples", "ok", "reused", "inferred", F.round("inference_s", 3).alias("inference_s"), "goal_events_created", "clips_created", "audio_spikes_detected"]
    return out.where(F.col("document").startswith("{")).select(*kept, F.array_join("degraded", ",").alias("degraded"))


@query("""
  WITH d AS (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type = 'error'), u AS (SELECT event_id AS tid, user_id, epoch(ts) AS tt FROM events WHERE event_type = 'purchase'),
  c AS (SELECT d.event_id, d.user_id, d.t, tid, tt, row_number() OVER (PARTITION BY d.event_id ORDER BY tt, tid) AS n FROM d JOIN u USING (user_id) WHERE abs(d.t - tt) <= 43200),
  m AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY t, event_id) AS w FROM c WHERE n = 1), k AS (SELECT count(*) AS n, list_sort(list(abs(t - tt))) AS errors FROM m WHERE w = 1)
  SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type IN ('error', 'purchase')) AS videos, round(k.n / (SELECT count(*) FROM u), 6) AS goal_recall, round(k.n / (SELECT count(*) FROM d), 6) AS goal_precision,
    round((SELECT count(*) - count(DISTINCT user_id) FROM d) / (SELECT count(*) FROM d), 6) AS duplicate_rate, round(errors[len(errors) // 2 + 1], 3) AS median_timestamp_error_seconds FROM k""")
def q_summary(spark, sf_dir):
    """One row over all recordings: shares, and the upper median of the errors."""
    e = events(spark, sf_dir)
    d, u = e.where("event_type = 'error'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    found = evaluate.matched(d, u, keys=["user_id"], within=12 * _HOUR, detected_order=["t", "event_id"], truth_order=["t", "event_id"])
    extra = evaluate.duplicates(d.withColumn("one", F.lit(1)), ["user_id"], ["one"]).withColumns({"clip_covered": F.lit(0), "vertical_ok": F.lit(0)})
    out = evaluate.summary(found, u, extra, keys=["user_id"])
    return out.select("videos", *[F.round(c, 6).alias(c) for c in ("goal_recall", "goal_precision", "duplicate_rate")], F.round("median_timestamp_error_seconds", 3).alias("median_timestamp_error_seconds"))


@query("""SELECT cast(user_id AS VARCHAR) AS media_id, '{"events":[' || string_agg('{"event_id":' || event_id || ',"type":"' || event_type || '"}', ',' ORDER BY event_id) || ']}' AS document FROM events GROUP BY 1""")
def q_event_documents(spark, sf_dir):
    """One JSON document of its events for each recording."""
    rows = events(spark, sf_dir).select(F.col("user_id").cast("string").alias("media_id"), "event_id", F.col("event_type").alias("type"))
    return media.event_documents(rows, ["media_id"], ["event_id"])


@query("SELECT '[' || printf('%02d:%02d.%03d', cast(floor(value / 60) AS BIGINT), cast(floor(value % 60) AS BIGINT), cast(floor((value - floor(value)) * 1000 + 0.5) AS BIGINT)) || '] ' || event_type AS value FROM events")
def q_log_lines(spark, sf_dir):
    return media.log_lines(events(spark, sf_dir).select(F.col("value").alias("t"), F.col("event_type").alias("message")))
