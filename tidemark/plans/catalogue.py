"""Registered queries: each operator bound to the columns of the given tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.config import AudioConfig, ClipConfig, EventConfig, ScoreConfig
from tidemark.functions import scalars as S
from tidemark.operators import audio, evaluate, folds, ranks, scoreboard, signals, tracking, trajectory
from tidemark.plans.detection import detect
from tidemark.sources.media import synthetic_match

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_T = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) / 1000000D"
_HOUR = 3600.0
_DAY = 24 * _HOUR


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with t, seconds."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("t", F.expr(_T))


def _loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "user_id", "t", F.col("value").alias("rms"))
    return audio.with_baseline(e, AudioConfig(), keys=["user_id"], order=["t", "event_id"])


_BASELINE = """
  SELECT event_id, user_id, epoch(ts) AS t, w, rms_db, coalesce(20 * log10(greatest(mean, 1e-7)), rms_db) AS baseline_db FROM (
    SELECT *, row_number() OVER o - 1 AS w, 20 * log10(greatest(value, 1e-7)) AS rms_db,
      avg(greatest(value, 1e-7)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS mean
    FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id))
"""
_LOUD = f"SELECT *, rms_db - baseline_db AS delta_db FROM ({_BASELINE}) WHERE w >= 10 AND rms_db - baseline_db >= 8 AND rms_db >= -55"


def _spaced_sql(rows: str, keys: str, order: str, at: str, test: str) -> str:
    """Rows kept by distance from the row kept before: rows is a query, keys and order its columns."""
    same = " AND ".join(f"r.{k} = s.{k}" for k in keys.split(", "))
    return f"""
    WITH RECURSIVE raw AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({rows})),
    s AS (SELECT {keys}, rn, {at} AS last, true AS kept FROM raw WHERE rn = 1 UNION ALL
      SELECT {", ".join("r." + k for k in keys.split(", "))}, r.rn, CASE WHEN r.{at} - s.last {test} THEN r.{at} ELSE s.last END, r.{at} - s.last {test}
      FROM s JOIN raw r ON {same} AND r.rn = s.rn + 1)
    SELECT r.* FROM raw r JOIN s ON {same} AND r.rn = s.rn WHERE s.kept"""


@query(
    "SELECT user_id, win, round(sqrt(avg(value * value)), 6) AS rms, round(20 * log10(greatest(sqrt(avg(value * value)), 1e-7)), 6) AS rms_db "
    "FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 20 AS win FROM events) GROUP BY 1, 2 HAVING count(*) = 20"
)
def q_level_db(spark, sf_dir):
    """RMS of whole windows of 20 rows."""
    by = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf_dir).withColumn("win", F.floor((F.row_number().over(by) - 1) / 20))
    rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
    out = rows.groupBy("user_id", "win").agg(F.count("*").alias("n"), rms.alias("rms")).where("n = 20")
    return out.select("user_id", "win", F.round("rms", 6).alias("rms"), F.round(S.decibels("rms"), 6).alias("rms_db"))


@query(f"SELECT event_id, w, round(rms_db, 6) AS rms_db, round(baseline_db, 6) AS baseline_db, round(rms_db - baseline_db, 6) AS delta_db FROM ({_BASELINE})")
def q_baseline(spark, sf_dir):
    return _loudness(spark, sf_dir).select("event_id", F.col("w").cast("long").alias("w"), *[F.round(c, 6).alias(c) for c in ("rms_db", "baseline_db", "delta_db")])


@query(f"SELECT event_id, user_id, w, round(delta_db, 6) AS delta_db FROM ({_LOUD})")
def q_spikes_raw(spark, sf_dir):
    rows = audio.loud(_loudness(spark, sf_dir), AudioConfig())
    return rows.select("event_id", "user_id", F.col("w").cast("long").alias("w"), F.round("delta_db", 6).alias("delta_db"))


@query(f"SELECT user_id, w, event_id, round(t, 3) AS t, round(delta_db, 6) AS delta_db FROM ({_spaced_sql(_LOUD, 'user_id', 'w', 'w', '> 8')})")
def q_spikes(spark, sf_dir):
    """Loud moments against the baseline of the 50 rows before, more than 8 rows apart."""
    out = audio.spikes(_loudness(spark, sf_dir), AudioConfig(), keys=["user_id"], carry=["event_id", "t", "delta_db"])
    return out.select("user_id", F.col("w").cast("long").alias("w"), "event_id", F.round("t", 3).alias("t"), F.round("delta_db", 6).alias("delta_db"))


_CLUSTERS = f"""
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cluster_id FROM (
    SELECT *, epoch(ts) AS t, CASE WHEN epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {4 * _HOUR} THEN 0 ELSE 1 END AS fresh FROM events)
"""


def _clusters(spark, sf_dir):
    return signals.clustered(events(spark, sf_dir), 4 * _HOUR, keys=["user_id"], order=["t", "event_id"])


@query(f"SELECT user_id, cast(cluster_id AS BIGINT) AS cluster_id, count(*) AS n, round(min(t), 3) AS start_t, round(max(t), 3) AS end_t FROM ({_CLUSTERS}) GROUP BY 1, 2")
def q_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).groupBy("user_id", "cluster_id").agg(F.count("*").alias("n"), F.round(F.min("t"), 3).alias("start_t"), F.round(F.max("t"), 3).alias("end_t"))


@query(f"SELECT user_id, count(*) AS n, round(min(t), 3) AS start_t, round(max(t) + {4 * _HOUR}, 3) AS end_t FROM ({_CLUSTERS}) GROUP BY user_id, cluster_id")
def q_session_window(spark, sf_dir):
    """The same sessions by session_window, as the streaming form has them."""
    rows = events(spark, sf_dir).withColumn("at", F.timestamp_micros((F.col("t") * 1000000).cast("long")))
    out = rows.groupBy("user_id", F.session_window("at", "4 hours").alias("w")).agg(F.count("*").alias("n"))
    at = lambda c: F.round(F.unix_micros(f"w.{c}") / 1000000, 3).alias(f"{c}_t")
    return out.select("user_id", "n", at("start"), at("end"))


def _tagged(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("media_id", F.col("user_id").cast("string"))
    changes = e.where("event_type = 'purchase'").select(
        "media_id", F.col("t").alias("change_t"), S.score(F.col("event_id") % 3, F.col("event_id") % 2).alias("before"), S.score(F.col("event_id") % 3 + 1, F.col("event_id") % 2).alias("after"),
        F.when(F.col("event_id") % 5 == 0, "suspicious").when(F.col("event_id") % 11 == 0, "invalid").otherwise("valid").alias("validation"),
    )
    return signals.signal_union(
        changes, e.where("event_type = 'error'").select("media_id", "t", F.col("value").alias("delta_db")), e.where("event_type = 'view'").select("media_id", "t", F.col("props").alias("text"))
    )


_TAGGED = """
  SELECT cast(user_id AS VARCHAR) AS media_id, CASE event_type WHEN 'purchase' THEN 'score_change' WHEN 'error' THEN 'audio_spike' ELSE 'keyword' END AS type, epoch(ts) AS t,
    CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS rank,
    CASE WHEN event_type = 'purchase' THEN (event_id % 3) || ':' || (event_id % 2) END AS score_before,
    CASE WHEN event_type = 'purchase' THEN (event_id % 3 + 1) || ':' || (event_id % 2) END AS score_after,
    CASE WHEN event_type = 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'suspicious' ELSE 'valid' END END AS validation,
    CASE WHEN event_type = 'error' THEN value END AS delta_db, CASE WHEN event_type = 'view' THEN props END AS text
  FROM events WHERE event_type IN ('error', 'view') OR (event_type = 'purchase' AND (event_id % 5 = 0 OR event_id % 11 <> 0))
"""


@query(f"SELECT media_id, type, round(t, 3) AS t, score_before, score_after, validation, delta_db, text FROM ({_TAGGED})")
def q_signals_union(spark, sf_dir):
    return _tagged(spark, sf_dir).withColumn("t", F.round("t", 3))


@query(f"""
  WITH s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY media_id ORDER BY t, rank) <= {24 * _HOUR} THEN 0 ELSE 1 END AS fresh FROM ({_TAGGED})),
  c AS (SELECT *, sum(fresh) OVER (PARTITION BY media_id ORDER BY t, rank ROWS UNBOUNDED PRECEDING) AS cluster_id FROM s),
  g AS (SELECT media_id, cluster_id, count(*) AS n_signals, bool_or(type = 'score_change') AS goal, bool_or(type = 'audio_spike') AS spike, bool_or(type = 'keyword') AS word,
    max(delta_db) AS best, arg_min(score_before, t) FILTER (type = 'score_change') AS score_before, arg_min(score_after, t) FILTER (type = 'score_change') AS score_after,
    arg_min(validation, t) FILTER (type = 'score_change') AS validation FROM c GROUP BY 1, 2)
  SELECT media_id, cast(cluster_id AS BIGINT) AS cluster_id, n_signals, CASE WHEN goal THEN 'GOAL' ELSE 'UNKNOWN_INTERESTING' END AS type, spike AS audio_spike, word AS keyword_goal,
    round(CASE WHEN goal THEN greatest(0.01, least(0.99, 0.7 + CASE WHEN spike THEN 0.15 + 0.05 ELSE 0 END + CASE WHEN word THEN 0.1 ELSE 0 END - CASE WHEN validation = 'valid' THEN 0 ELSE 0.1 END))
      ELSE least(0.4, 0.15 + coalesce(best, 0) / 100) END, 3) AS confidence, score_before, score_after, validation FROM g""")
def q_classify(spark, sf_dir):
    rows = signals.classified(signals.clustered(_tagged(spark, sf_dir), 24 * _HOUR), EventConfig())
    return rows.select("media_id", "cluster_id", "n_signals", "type", "audio_spike", "keyword_goal", "confidence", "score_before", "score_after", "validation")


def _scores(spark, sf_dir):
    """A user's running purchases and sign-ups as a score."""
    run = Window.partitionBy("user_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    counts = [F.sum(F.when(F.col("event_type") == kind, 1).otherwise(0)).over(run) for kind in ("purchase", "signup")]
    return events(spark, sf_dir).select("user_id", "event_id", "t", F.lit(True).alias("ok"), S.score(*counts).alias("score"))


_SCORES = """
  SELECT user_id, event_id, epoch(ts) AS t, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER o AS home, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER o AS away
  FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
"""


def _machine_sql(rows: str, keys: str, order: str, reads: int, window: float, initial: str = "") -> str:
    """The score state machine over rows (keys, t, home, away): a row a step, with what it gave; initial: names of the columns of a score to start from."""
    own = keys.split(", ")
    same = " AND ".join(f"r.{k} = s.{k}" for k in own)
    start = initial or "NULL::BIGINT, NULL::BIGINT"
    return f"""
    WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn FROM ({rows})),
    s AS (SELECT {keys}, 0::BIGINT AS rn, ch, ca, []::STRUCT(t DOUBLE, h BIGINT, a BIGINT)[] AS recent, NULL::VARCHAR AS kind, NULL::BIGINT AS ph, NULL::BIGINT AS pa, NULL::BIGINT AS nh, NULL::BIGINT AS na, NULL::DOUBLE AS change_t, NULL::DOUBLE AS confirmed_t, NULL::VARCHAR AS validation
      FROM (SELECT DISTINCT {keys}, {start} FROM r) d({keys}, ch, ca) UNION ALL
    SELECT {keys}, rn, CASE WHEN settles OR adopted THEN home ELSE ch END, CASE WHEN settles OR adopted THEN away ELSE ca END, CASE WHEN settles OR quiet OR moves THEN []::STRUCT(t DOUBLE, h BIGINT, a BIGINT)[] ELSE rec END,
      CASE WHEN adopted THEN 'change' WHEN moves THEN 'rejection' END, ch, ca, home, away, alike[1].t, t, verdict FROM (
      SELECT *, moves AND verdict <> 'invalid' AS adopted FROM (
        SELECT *, ch IS NULL AND len(alike) >= {reads} AS settles, ch IS NOT NULL AND ch = home AND ca = away AS quiet, ch IS NOT NULL AND NOT (ch = home AND ca = away) AND len(alike) >= {reads} AS moves,
          CASE WHEN home < ch OR away < ca OR (home = ch AND away = ca) OR (home > ch AND away > ca) THEN 'invalid' WHEN home + away - ch - ca = 1 THEN 'valid' WHEN home + away - ch - ca <= 3 THEN 'suspicious' ELSE 'invalid' END AS verdict FROM (
          SELECT *, list_filter(rec, lambda x: x.h = home AND x.a = away) AS alike FROM (
            SELECT {", ".join("r." + k for k in own)}, r.rn, s.ch, s.ca, r.t, r.home::BIGINT AS home, r.away::BIGINT AS away,
              list_append(list_filter(s.recent, lambda x: r.t - x.t <= {window}), struct_pack(t := r.t, h := r.home::BIGINT, a := r.away::BIGINT)) AS rec FROM s JOIN r ON {same} AND r.rn = s.rn + 1)))))
    SELECT * FROM s"""


@query(f"""SELECT user_id, kind, cast(row_number() OVER (PARTITION BY user_id, kind ORDER BY rn) - 1 AS INT) AS seq, ph || ':' || pa AS score_before, nh || ':' || na AS score_after,
  round(change_t, 3) AS change_t, round(confirmed_t, 3) AS confirmed_t, validation FROM ({_machine_sql(_SCORES, "user_id", "t, event_id", 3, 3 * _DAY)}) WHERE kind IS NOT NULL""")
def q_score_changes(spark, sf_dir):
    """The score state machine over each user's running score: 3 readings within 3 days. Between them lie readings that failed, which don't count."""
    read = _scores(spark, sf_dir)
    failed = read.withColumns({"ok": F.lit(False), "score": F.when(F.col("event_id") % 2 == 0, F.col("score"))})
    unread = read.withColumn("score", F.lit(None).cast(read.schema["score"].dataType))
    states = scoreboard.score_states(read.union(failed).union(unread), ScoreConfig(3, 3 * _DAY), keys=["user_id"], ordinal="event_id")
    rows = scoreboard.score_changes(states, ["user_id"]).withColumn("kind", F.lit("change")).drop("refined").unionByName(
        scoreboard.score_rejections(states, ["user_id"]).withColumn("kind", F.lit("rejection"))
    )
    return rows.select("user_id", "kind", "seq", S.score_text("before").alias("score_before"), S.score_text("after").alias("score_after"), F.round("change_t", 3).alias("change_t"), F.round("confirmed_t", 3).alias("confirmed_t"), "validation")


@query(f"""
  SELECT user_id, round(t, 3) AS t, ph || ':' || pa AS score_before, home || ':' || away AS score_after,
    CASE WHEN home < ph OR away < pa OR (home = ph AND away = pa) OR (home > ph AND away > pa) THEN 'invalid' WHEN home + away - ph - pa = 1 THEN 'valid' WHEN home + away - ph - pa <= 3 THEN 'suspicious' ELSE 'invalid' END AS validation
  FROM (SELECT *, lag(home) OVER o AS ph, lag(away) OVER o AS pa FROM ({_SCORES}) WINDOW o AS (PARTITION BY user_id ORDER BY t, event_id)) WHERE ph IS NOT NULL AND (ph <> home OR pa <> away)""")
def q_validate(spark, sf_dir):
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("t", "event_id"))
    runs = _scores(spark, sf_dir).withColumn("before", before).where("before IS NOT NULL AND before <> score")
    return runs.select("user_id", F.round("t", 3).alias("t"), S.score_text("before").alias("score_before"), S.score_text("score").alias("score_after"), S.validate_transition("before", "score").alias("validation"))


@query(f"""
  SELECT user_id, round(min(t), 3) AS refined_t FROM (
    SELECT *, sum(CASE WHEN home = 5 AND away = 5 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS n,
      lead(t, 2) OVER (PARTITION BY user_id ORDER BY t, event_id) - t AS span FROM ({_SCORES})) WHERE n = 3 AND span <= {3 * _DAY} GROUP BY 1""")
def q_run_confirm(spark, sf_dir):
    """When each user's score first showed 5:5 three times running within 3 days."""
    rows = _scores(spark, sf_dir).withColumn("after", S.score(F.lit(5), F.lit(5)))
    out = scoreboard.first_run(rows, ScoreConfig(3, 3 * _DAY), keys=["user_id"], order=["t", "event_id"])
    return out.select("user_id", F.round("refined_t", 3).alias("refined_t"))


@query(f"""
  WITH c AS (SELECT event_id, user_id, epoch(ts) AS change_t FROM events WHERE event_type = 'purchase'),
  n AS (SELECT c.*, epoch(e.ts) AS t, e.value AS d, max(e.value) OVER (PARTITION BY c.event_id) AS best FROM c JOIN events e ON e.user_id = c.user_id AND epoch(e.ts) BETWEEN greatest(0, c.change_t - {12 * _HOUR}) AND c.change_t),
  p AS (SELECT event_id, min(t) FILTER (d = best) AS peak_t, max(best) AS best, min(t) FILTER (d >= best - 1) AS onset FROM n GROUP BY 1)
  SELECT c.event_id, round(CASE WHEN best >= 200 THEN onset ELSE greatest(0, least(change_t - {4 * _HOUR}, 1e12)) END, 3) AS event_t, round(peak_t, 3) AS peak_t, best AS peak_delta_db, NOT coalesce(best >= 200, false) AS used_fallback FROM c LEFT JOIN p USING (event_id)""")
def q_lookback(spark, sf_dir):
    """For each purchase the user's largest value in the 12 hours before, and its onset."""
    e = events(spark, sf_dir)
    changes = e.where("event_type = 'purchase'").select("event_id", F.col("user_id").alias("media_id"), F.col("t").alias("change_t"), F.lit(1e12).alias("duration_s"))
    windows = e.select(F.col("user_id").alias("media_id"), "t", F.col("value").alias("delta_db"))
    out = signals.event_times(changes, windows, EventConfig(lookback_s=12 * _HOUR, fallback_offset_s=4 * _HOUR), spike_db=200.0, key=["media_id", "event_id", "change_t"])
    return out.select("event_id", F.round("event_t", 3).alias("event_t"), F.round("peak_t", 3).alias("peak_t"), "peak_delta_db", "used_fallback")


_KEYED = "SELECT event_id, user_id, event_type, epoch(ts) AS t FROM events"


@query(f"SELECT event_id, user_id, event_type, round(t, 3) AS t FROM ({_spaced_sql(_KEYED, 'user_id, event_type', 't, event_id', 't', f'>= {12 * _HOUR}')})")
def q_dedup(spark, sf_dir):
    """A user's events of one type at least 12 hours after the one kept before."""
    out = folds.spaced(events(spark, sf_dir), ["user_id", "event_type"], ["t", "event_id"], "t", 12 * _HOUR, strict=False, carry=["event_id"])
    return out.select("event_id", "user_id", "event_type", F.round("t", 3).alias("t"))


@query("""
  SELECT event_id, printf('event_%04d', n) AS id, lower(event_type) || '_' || CASE WHEN n < 10 THEN '0' ELSE '' END || n || '_' || (s // 60) || 'm' || CASE WHEN s % 60 < 10 THEN '0' ELSE '' END || (s % 60) || 's.mp4' AS file
  FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, cast(floor(epoch(ts)) AS BIGINT) % 7200 AS s FROM events)""")
def q_event_ids(spark, sf_dir):
    rows = signals.numbered(events(spark, sf_dir).withColumnRenamed("event_id", "row_id"), key="user_id", order=["t", "row_id"])
    s = F.floor("t") % 7200
    return rows.select(F.col("row_id").alias("event_id"), F.col("event_id").alias("id"), S.clip_file("event_type", "n", s).alias("file"))


@query("""
  WITH e AS (SELECT event_id, floor(epoch(ts)) % 5400 + event_id % 7 / 4.0 AS t, 5400.0 AS d, 5 + event_id % 20 AS pre FROM events),
  a AS (SELECT *, greatest(0, t - 25) AS s0, least(d, t + 10) AS e0, greatest(0, t - 30.0 * 25 / 35) AS cut FROM e),
  b AS (SELECT *, e0 - s0 > 30 AS long, least(d, cut + 30) AS cut_end FROM a),
  c AS (SELECT *, CASE WHEN long THEN greatest(0, cut_end - 30) ELSE s0 END AS s1, CASE WHEN long THEN cut_end ELSE e0 END AS e1 FROM b),
  f AS (SELECT *, least(d, greatest(e1, s1 + 0.5)) AS e2 FROM c), g AS (SELECT *, greatest(0, least(s1, e2 - 0.5)) AS s2 FROM f)
  SELECT event_id, round(s2, 3) AS clip_start, round(e2, 3) AS clip_end, round(e2 - s2, 3) AS clip_length FROM g""")
def q_clip_windows(spark, sf_dir):
    t = F.floor("t") % 5400 + (F.col("event_id") % 7) / 4
    rows = events(spark, sf_dir).select("event_id", signals.clip_window(t, F.lit(5400.0), ClipConfig(25.0, 10.0, 30.0)).alias("c"))
    return rows.select("event_id", F.col("c.start").alias("clip_start"), F.col("c.end").alias("clip_end"), F.col("c.length").alias("clip_length"))


@query(f"""
  WITH p AS (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type = 'purchase'), k AS (SELECT event_id AS click_id, user_id, epoch(ts) AS ct FROM events WHERE event_type = 'click'),
  r AS (SELECT p.event_id, click_id, abs(t - ct) AS d, row_number() OVER (PARTITION BY p.event_id ORDER BY abs(t - ct), ct, click_id) AS n FROM p JOIN k USING (user_id) WHERE abs(t - ct) <= {6 * _HOUR})
  SELECT p.event_id, click_id, round(d, 3) AS distance FROM p LEFT JOIN (SELECT * FROM r WHERE n = 1) q USING (event_id)""")
def q_asof_nearest(spark, sf_dir):
    """Each purchase with the user's nearest click within 6 hours."""
    e = events(spark, sf_dir)
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    right = e.where("event_type = 'click'").select("user_id", F.col("t").alias("ct"), F.col("event_id").alias("click_id"))
    out = trajectory.nearest(left, right, keys=["user_id"], at="t", other="ct", within=6 * _HOUR, ids=["event_id"], order=["ct", "click_id"], take=["click_id"])
    return out.select("event_id", "click_id", F.round("distance", 3).alias("distance"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM events")
def q_moving_avg(spark, sf_dir):
    rows = events(spark, sf_dir).withColumn("frame", F.struct("t", "event_id"))
    return trajectory.smoothed(rows, ["user_id"], value="value", radius=4).select("event_id", F.round("smooth", 6).alias("smooth"))


@query("""
  WITH a AS (SELECT event_id, user_id, CASE WHEN event_id % 4 = 0 THEN value END AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  b AS (SELECT *, last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n) AS l, n - last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY n) AS age FROM a),
  c AS (SELECT *, least(1.0, (age - 2) / 3.0) AS k FROM b)
  SELECT event_id, round(CASE WHEN age IS NULL THEN 100 WHEN age <= 2 THEN l ELSE l + (100 - l) * (k * k * (3 - 2 * k)) END, 6) AS held FROM c""")
def q_hold(spark, sf_dir):
    """A value known at each fourth event: held for 2 rows, then eased to 100 over 3."""
    rows = events(spark, sf_dir).withColumns({"frame": F.struct("t", "event_id"), "v": F.when(F.col("event_id") % 4 == 0, F.col("value"))})
    return trajectory.held(rows, ["user_id"], value="v", centre=100.0, hold=2, recentre=3).select("event_id", F.round("held", 6).alias("held"))


@query("""
  WITH RECURSIVE a AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  s AS (SELECT user_id, n, event_id, value AS x FROM a WHERE n = 1 UNION ALL SELECT a.user_id, a.n, a.event_id, s.x + greatest(-10, least(10, a.value - s.x)) FROM s JOIN a ON a.user_id = s.user_id AND a.n = s.n + 1)
  SELECT event_id, round(x, 4) AS limited FROM s""")
def q_slew(spark, sf_dir):
    """Each user's values at most 10 from the limited one before."""
    rows = events(spark, sf_dir).withColumn("frame", F.struct("t", "event_id"))
    out = trajectory.slew_limited(rows, ["user_id"], value="value", step=10.0, segment=F.floor(F.col("t") / _DAY))
    return out.select(F.col("frame.event_id").alias("event_id"), F.round("limited", 4).alias("limited"))


_MATCH = f"""
  WITH d AS (SELECT event_id, user_id, epoch(ts) AS t FROM events WHERE event_type = 'error'), u AS (SELECT event_id AS tid, user_id, epoch(ts) AS tt FROM events WHERE event_type = 'purchase'),
  c AS (SELECT d.event_id, d.user_id, d.t, tid, tt, row_number() OVER (PARTITION BY d.event_id ORDER BY tt, tid) AS n FROM d JOIN u USING (user_id) WHERE abs(d.t - tt) <= {12 * _HOUR}),
  m AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY t, event_id) AS w FROM c WHERE n = 1)
"""


def _matches(spark, sf_dir):
    e = events(spark, sf_dir)
    d, u = e.where("event_type = 'error'").select("event_id", "user_id", "t"), e.where("event_type = 'purchase'").select("event_id", "user_id", "t")
    return evaluate.matched(d, u, keys=["user_id"], within=12 * _HOUR, detected_order=["t", "event_id"], truth_order=["t", "event_id"]), u


@query(_MATCH + "SELECT d.event_id, round(tt, 3) AS truth_t, coalesce(w = 1, false) AS matched FROM d LEFT JOIN m USING (event_id)")
def q_match_truth(spark, sf_dir):
    """Errors matched to purchases within 12 hours: the first in reach, each taken once."""
    return _matches(spark, sf_dir)[0].select("event_id", F.round("truth_t", 3).alias("truth_t"), "matched")


@query(_MATCH + """, x AS (SELECT d.user_id, d.t, tt, coalesce(w = 1, false) AS ok FROM d LEFT JOIN m USING (event_id)),
  g AS (SELECT user_id, count(*) AS n_detected, count(*) FILTER (ok) AS n_matched, list_sort(list(abs(t - tt)) FILTER (ok)) AS errors FROM x GROUP BY 1),
  h AS (SELECT user_id, count(*) AS n_truth FROM u GROUP BY 1)
  SELECT user_id, coalesce(n_detected, 0) AS n_detected, coalesce(n_truth, 0) AS n_truth, coalesce(n_matched, 0) AS n_matched, round(errors[len(errors) // 2 + 1], 3) AS median_error,
    round(CASE WHEN coalesce(n_truth, 0) = 0 THEN 0 ELSE coalesce(n_matched, 0) / n_truth END, 6) AS recall, round(CASE WHEN coalesce(n_detected, 0) = 0 THEN 0 ELSE n_matched / n_detected END, 6) AS precision FROM g FULL JOIN h USING (user_id)""")
def q_accuracy(spark, sf_dir):
    found, truth = _matches(spark, sf_dir)
    out = evaluate.accuracy(found, truth, keys=["user_id"])
    return out.select("user_id", "n_detected", "n_truth", "n_matched", F.round("median_error", 3).alias("median_error"), F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query(_MATCH + """, x AS (SELECT coalesce(w = 1, false) AS ok FROM d LEFT JOIN m USING (event_id))
  SELECT (SELECT count(*) FROM x) AS n_detected, (SELECT count(*) FROM x WHERE ok) AS n_matched, (SELECT count(*) FROM u) AS n_truth,
    round((SELECT count(*) FROM x WHERE ok) / (SELECT count(*) FROM u), 6) AS recall, round((SELECT count(*) FROM x WHERE ok) / (SELECT count(*) FROM x), 6) AS precision""")
def q_totals(spark, sf_dir):
    found, truth = _matches(spark, sf_dir)
    out = evaluate.totals(evaluate.accuracy(found, truth, keys=["user_id"]))
    return out.select("n_detected", "n_matched", "n_truth", F.round("recall", 6).alias("recall"), F.round("precision", 6).alias("precision"))


@query("SELECT event_type, v[len(v) // 2 + 1] AS upper_median FROM (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY 1)")
def q_upper_median(spark, sf_dir):
    return ranks.order_statistic(events(spark, sf_dir), ["event_type"], "value", out="upper_median")


@query("SELECT cast(user_id AS VARCHAR) AS user_id, coalesce(event_type, 'unknown') AS value, count(*) AS n FROM events GROUP BY 1, 2")
def q_histogram(spark, sf_dir):
    return evaluate.histogram(events(spark, sf_dir).withColumn("user_id", F.col("user_id").cast("string")), ["user_id"], "event_type")


@query("SELECT user_id, count(*) - count(DISTINCT event_type) AS duplicates FROM events GROUP BY 1")
def q_duplicates(spark, sf_dir):
    return evaluate.duplicates(events(spark, sf_dir), ["user_id"], ["event_type"])


_BOX = """SELECT vec_id AS ord, vec_id // 50 AS frame, round(500 + 400 * embedding[1]::DOUBLE, 3) AS x, round(300 + 200 * embedding[2]::DOUBLE, 3) AS y,
  round(20 + 300 * abs(embedding[3]::DOUBLE), 3) AS width, round(20 + 300 * abs(embedding[4]::DOUBLE), 3) AS height, round(abs(embedding[5]::DOUBLE), 4) AS confidence FROM embeddings"""


def _boxes(spark, sf_dir):
    """Boxes out of the embeddings' first numbers, fifty a frame; the label is the recording."""
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    e = lambda i: F.get("embedding", F.lit(i)).cast("double")
    return v.select(
        F.col("label").cast("string").alias("label"), F.floor(F.col("vec_id") / 50).alias("frame"), F.col("vec_id").alias("ord"), F.round(500 + 400 * e(0), 3).alias("x"), F.round(300 + 200 * e(1), 3).alias("y"),
        F.round(20 + 300 * F.abs(e(2)), 3).alias("width"), F.round(20 + 300 * F.abs(e(3)), 3).alias("height"), F.round(F.abs(e(4)), 4).alias("confidence"),
    )


_IOU = f"""
  WITH b AS ({_BOX}), p AS (SELECT l.frame, l.ord AS a, r.ord AS b, l.width * l.height + r.width * r.height AS area,
    greatest(0, least(l.x + l.width / 2, r.x + r.width / 2) - greatest(l.x - l.width / 2, r.x - r.width / 2)) * greatest(0, least(l.y + l.height / 2, r.y + r.height / 2) - greatest(l.y - l.height / 2, r.y - r.height / 2)) AS inter
    FROM b l JOIN b r ON l.frame = r.frame AND l.ord < r.ord)
"""


@query(_IOU + "SELECT frame, a, b, round(inter / (area - inter), 5) AS iou FROM p WHERE area - inter > 0 AND inter / (area - inter) > 0.3")
def q_iou_pairs(spark, sf_dir):
    return tracking.overlapping_pairs(_boxes(spark, sf_dir), 0.3, ["frame"]).select("frame", "a", "b", F.round("iou", 5).alias("iou"))


_KEPT = "STRUCT(x DOUBLE, y DOUBLE, width DOUBLE, height DOUBLE)[]"
_INTER = "(greatest(0, least(b.x + b.width / 2, k.x + k.width / 2) - greatest(b.x - b.width / 2, k.x - k.width / 2)) * greatest(0, least(b.y + b.height / 2, k.y + k.height / 2) - greatest(b.y - b.height / 2, k.y - k.height / 2)))"


def _nms_sql(boxes: str, keys: str, threshold: float) -> str:
    """Rows of boxes that greedy suppression keeps: a row a step, with the kept ones so far in a list."""
    same = " AND ".join(f"b.{k} = s.{k}" for k in keys.split(", "))
    over = f"len(list_filter(s.kept, lambda k: {_INTER} > {threshold} * (b.width * b.height + k.width * k.height - {_INTER}))) = 0"
    own = "struct_pack(x := b.x, y := b.y, width := b.width, height := b.height)"
    return f"""
    WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY confidence DESC, ord) AS rn FROM ({boxes})),
    s AS (SELECT DISTINCT {keys}, 0::BIGINT AS rn, []::{_KEPT} AS kept, false AS stays FROM b UNION ALL
      SELECT {", ".join("b." + k for k in keys.split(", "))}, b.rn, CASE WHEN {over} THEN list_append(s.kept, {own}) ELSE s.kept END, {over} FROM s JOIN b ON {same} AND b.rn = s.rn + 1)
    SELECT b.* FROM b JOIN s ON {same} AND b.rn = s.rn WHERE s.stays"""


@query(f"SELECT frame, ord, confidence FROM ({_nms_sql(_BOX, 'frame', 0.3)})")
def q_nms(spark, sf_dir):
    """Greedy suppression of each frame's boxes."""
    return tracking.suppressed(_boxes(spark, sf_dir), 0.3, ["frame"]).select("frame", "ord", "confidence")


@query(f"""
  WITH b AS ({_BOX}), t AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY confidence DESC, ord) AS n, CASE WHEN least(x, 1000 - x) >= 60 THEN 1.0 ELSE greatest(0.35, least(x, 1000 - x) / 60) END AS w FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY height * w DESC, confidence * w DESC, n) AS best FROM t WHERE n <= 6)
  SELECT frame, round(max(x) FILTER (best = 1), 1) AS x, round(max(y) FILTER (best = 1), 1) AS y, round(greatest(1, max(x + width / 2) + 60 - (min(x - width / 2) - 60)), 1) AS width,
    round(greatest(1, max(height) FILTER (best = 1)), 1) AS height, round(max(confidence) FILTER (best = 1), 4) AS confidence FROM k GROUP BY 1""")
def q_person_clusters(spark, sf_dir):
    return tracking.person_clusters(_boxes(spark, sf_dir), width=1000.0, keys=["frame"]).drop("kind")


@query("""
  WITH f AS (SELECT o_orderkey, 320 + o_orderkey % 1601 AS w, 240 + o_orderkey % 841 AS h FROM orders),
  x AS (SELECT DISTINCT o_orderkey, greatest(0, least(i * 320, w - 640)) AS tile_x FROM f, generate_series(0, 20) g(i) WHERE i < greatest(1, ceil((w - 640) / 320) + 1)),
  y AS (SELECT DISTINCT o_orderkey, greatest(0, least(i * 180, h - 360)) AS tile_y FROM f, generate_series(0, 20) g(i) WHERE i < greatest(1, ceil((h - 360) / 180) + 1))
  SELECT o_orderkey, cast(tile_x AS INT) AS tile_x, cast(tile_y AS INT) AS tile_y FROM x JOIN y USING (o_orderkey)""")
def q_tiles(spark, sf_dir):
    """Half-overlapping tiles of frames of many sizes, smaller than a tile also."""
    k = F.col("o_orderkey")
    frames = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, (320 + k % 1601).cast("int").alias("frame_width"), (240 + k % 841).cast("int").alias("frame_height"))
    return tracking.tiles(frames, width=640, height=360, overlap=0.5).select("o_orderkey", "tile_x", "tile_y")


@query("""
  SELECT l_orderkey, l_linenumber, CASE WHEN regexp_matches(s, '^\\s*\\d{1,2}\\s*[:\\-–—]\\s*\\d{1,2}\\s*$') THEN cast(regexp_extract(s, '^\\s*(\\d{1,2})', 1) AS INT) END AS home,
    CASE WHEN regexp_matches(s, '^\\s*\\d{1,2}\\s*[:\\-–—]\\s*\\d{1,2}\\s*$') THEN cast(regexp_extract(s, '(\\d{1,2})\\s*$', 1) AS INT) END AS away
  FROM (SELECT l_orderkey, l_linenumber, l_linenumber || CASE l_orderkey % 4 WHEN 0 THEN ':' WHEN 1 THEN ' - ' WHEN 2 THEN '–' ELSE '/' END || cast(l_quantity AS INT) AS s FROM lineitem)""")
def q_parse_score(spark, sf_dir):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    mark = F.element_at(F.array(*map(F.lit, (":", " - ", "–", "/"))), (F.col("l_orderkey") % 4 + 1).cast("int"))
    s = S.parse_score(F.concat(F.col("l_linenumber").cast("string"), mark, F.col("l_quantity").cast("int").cast("string")))
    return li.select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.home", "s.away")


_FORMS = ("'now ' || a || ' ： ' || b || ' ft'", "a || '  ' || b", "a || '' || (b % 10)", "a || '23:' || b", "'(' || a || '−' || b || '|7'", "a || ' or ' || b", "'x' || a || ' | ' || b || '9'")
_FORMED = "SELECT l_orderkey, l_linenumber, CASE l_orderkey % 7 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END AS text FROM (SELECT l_orderkey, l_linenumber, cast(l_linenumber AS INT) AS a, cast(l_quantity AS INT) AS b FROM lineitem)"


def _formed(spark, sf_dir):
    """Texts of seven forms: separated, spaced, two digits, over-long numbers, other dashes, no score."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey", "l_linenumber", "cast(l_linenumber AS INT) AS a", "cast(l_quantity AS INT) AS b")
    form = "CASE l_orderkey % 7 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(_FORMS)) + " END"
    return li.selectExpr("l_orderkey", "l_linenumber", f"{form} AS text")


@query(f"""
  WITH t AS (SELECT *, translate(text, '：−–—', ':---') AS s FROM ({_FORMED})),
  m AS (SELECT *, '(?:^|[^0-9])(\\d{{1,2}})\\s*[:|-]\\s*(\\d{{1,2}})(?:[^0-9]|$)' AS sep, '^\\s*(\\d{{1,2}})\\s+(\\d{{1,2}})\\s*$' AS spc, '^\\s*(\\d)(\\d)\\s*$' AS cmp FROM t),
  p AS (SELECT *, CASE WHEN regexp_matches(s, sep) THEN sep WHEN regexp_matches(s, spc) THEN spc WHEN regexp_matches(s, cmp) THEN cmp END AS pat FROM m),
  v AS (SELECT l_orderkey, l_linenumber, try_cast(CASE WHEN pat = sep THEN regexp_extract(s, '(?:^|[^0-9])(\\d{{1,2}})\\s*[:|-]\\s*(\\d{{1,2}})(?:[^0-9]|$)', 1) WHEN pat = spc THEN regexp_extract(s, '^\\s*(\\d{{1,2}})\\s+(\\d{{1,2}})\\s*$', 1) WHEN pat = cmp THEN regexp_extract(s, '^\\s*(\\d)(\\d)\\s*$', 1) END AS INT) AS h,
    try_cast(CASE WHEN pat = sep THEN regexp_extract(s, '(?:^|[^0-9])(\\d{{1,2}})\\s*[:|-]\\s*(\\d{{1,2}})(?:[^0-9]|$)', 2) WHEN pat = spc THEN regexp_extract(s, '^\\s*(\\d{{1,2}})\\s+(\\d{{1,2}})\\s*$', 2) WHEN pat = cmp THEN regexp_extract(s, '^\\s*(\\d)(\\d)\\s*$', 2) END AS INT) AS a FROM p)
  SELECT l_orderkey, l_linenumber, CASE WHEN h <= 30 AND a <= 30 THEN h END AS home, CASE WHEN h <= 30 AND a <= 30 THEN a END AS away FROM v""")
def q_read_score(spark, sf_dir):
    """Scores inside texts of seven forms, none of a side above 30."""
    s = S.read_score("text", largest=30, compact=True)
    return _formed(spark, sf_dir).select("l_orderkey", "l_linenumber", s.alias("s")).select("l_orderkey", "l_linenumber", "s.home", "s.away")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def q_json_props(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT user_id, len(list_filter(list_distinct(list(event_type)), lambda x: starts_with(x, 'p'))) > 0 AS any_p, len(list_filter(list_distinct(list(event_type)), lambda x: starts_with(x, 'zz'))) > 0 AS any_zz FROM events GROUP BY 1")
def q_prefix_flags(spark, sf_dir):
    kinds = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("kinds"))
    return kinds.select("user_id", S.has_prefix("kinds", "p").alias("any_p"), S.has_prefix("kinds", "zz").alias("any_zz"))


@query("""
  WITH RECURSIVE a AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS d FROM events),
  s AS (SELECT user_id, frame, event_id, frame AS last, 1 AS burst, true AS should_read FROM a WHERE frame = 0 UNION ALL
    SELECT a.user_id, a.frame, a.event_id, CASE WHEN x THEN a.frame ELSE last END, CASE WHEN NOT fresh AND burst > 0 THEN burst - 1 WHEN x THEN 1 ELSE burst END, x FROM (
      SELECT s.last, s.burst, a.user_id, a.frame, a.event_id, a.d >= 100 AS fresh, a.d >= 100 OR s.burst > 0 OR a.frame - s.last >= 4 AS x FROM s JOIN a ON a.user_id = s.user_id AND a.frame = s.frame + 1) a)
  SELECT event_id, should_read FROM s""")
def q_change_detector(spark, sf_dir):
    """Which rows of a user differ enough, follow such a row, or are due."""
    by = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf_dir).withColumns({"frame": (F.row_number().over(by) - 1).cast("long"), "difference": F.abs(F.col("value") - F.lag("value").over(by))})
    return scoreboard.frames_to_read(rows, ["user_id"], threshold=100.0, refresh=4, reads=2, carry=["event_id"]).select("event_id", "should_read")


@query("""
  SELECT event_id, CASE WHEN x2 IS NULL OR w2 <= 0.001 OR h2 <= 0.001 THEN NULL ELSE round(x2, 6) END AS x, CASE WHEN w2 <= 0.001 OR h2 <= 0.001 THEN NULL ELSE round(w2, 6) END AS width FROM (
    SELECT event_id, greatest(0, least(1, x)) AS x2, greatest(0, least(1 - greatest(0, least(1, x)), w)) AS w2, greatest(0, least(1 - greatest(0, least(1, y)), h)) AS h2
    FROM (SELECT event_id, (value - 100) / 300 AS x, 0.9 AS y, value / 500 AS w, (event_id % 3) / 4 AS h FROM events))""")
def q_sane_roi(spark, sf_dir):
    v = F.col("value")
    roi = F.struct(((v - 100) / 300).alias("x"), F.lit(0.9).alias("y"), (v / 500).alias("width"), ((F.col("event_id") % 3) / 4).alias("height"))
    return events(spark, sf_dir).select("event_id", S.sane_roi(roi).alias("r")).select("event_id", F.round("r.x", 6).alias("x"), F.round("r.width", 6).alias("width"))


@query("SELECT user_id, frame, printf('%.3f crop x %d;', frame / 10.0, x) AS line FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, cast(floor(value) AS BIGINT) AS x, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE frame % 5 = 0 OR frame = n - 1")
def q_crop_commands(spark, sf_dir):
    by = Window.partitionBy("user_id").orderBy("t", "event_id")
    rows = events(spark, sf_dir).select("user_id", (F.row_number().over(by) - 1).cast("long").alias("frame"), F.floor("value").alias("x"))
    return trajectory.crop_commands(rows, ["user_id"], 10.0, 5)


@query("""
  WITH s AS (SELECT user_id, event_type = 'signup' AS lost, CASE event_type WHEN 'view' THEN 'ball' ELSE 'cluster' END AS kind, value AS width, value / 500 AS confidence FROM events WHERE event_type <> 'click'),
  g AS (SELECT user_id, count(*) FILTER (NOT lost) AS tracked, count(*) FILTER (NOT lost AND kind = 'ball') AS balls, list_sort(list(width) FILTER (NOT lost AND kind = 'cluster')) AS w,
    coalesce(round(avg(confidence) FILTER (NOT lost), 4), 0) AS mean_confidence, count(*) AS sampled, count(*) FILTER (lost) AS lost FROM s GROUP BY 1)
  SELECT user_id, tracked, balls, mean_confidence, sampled, lost, coalesce(tracked > 0 AND balls < greatest(2, ceil(tracked * 0.1)) AND w[len(w) // 2 + 1] >= 100, false) AS wide FROM g""")
def q_wide_shots(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", "ball").otherwise("cluster")
    rows = events(spark, sf_dir).where("event_type <> 'click'").select("user_id", (F.col("event_type") == "signup").alias("lost"), kind.alias("kind"), F.col("value").alias("width"), (F.col("value") / 500).alias("confidence"))
    return trajectory.wide_shots(rows, ["user_id"], 200.0)


@query("SELECT o_orderkey, round(least(640.0 / w, 640.0 / h), 9) AS scale, cast(floor((640 - floor(w * least(640.0 / w, 640.0 / h))) / 2) AS INT) AS pad_x, cast(floor((640 - floor(h * least(640.0 / w, 640.0 / h))) / 2) AS INT) AS pad_y, greatest(2, least(w, h * 9 // 16)) AS crop FROM (SELECT o_orderkey, cast(320 + o_orderkey % 1601 AS INT) AS w, cast(240 + o_orderkey % 841 AS INT) AS h FROM orders)")
def q_letterbox(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", (320 + F.col("o_orderkey") % 1601).cast("int").alias("w"), (240 + F.col("o_orderkey") % 841).cast("int").alias("h"))
    return o.select("o_orderkey", S.letterbox("w", "h").alias("l"), S.crop_width("w", "h").alias("crop")).select("o_orderkey", F.round("l.scale", 9).alias("scale"), "l.pad_x", "l.pad_y", "crop")


@query("""
  SELECT 'm' || s_suppkey AS media_id, event_id, event_t + s_suppkey % 20 AS event_t, change_t + s_suppkey % 20 AS change_t, score_before, score_after, 0.9::DOUBLE AS confidence FROM supplier,
    (VALUES ('event_0001', 80::DOUBLE, 83::DOUBLE, '0:0', '1:0'), ('event_0002', 200, 203, '1:0', '1:1'), ('event_0003', 300, 304, '1:1', '2:1')) v(event_id, event_t, change_t, score_before, score_after)""")
def q_synthetic_goals(spark, sf_dir):
    """Goals of a scripted match for each supplier, each begun at another second, end to end."""
    k = F.col("s_suppkey")
    matches = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.concat(F.lit("m"), k.cast("string")).alias("media_id"), (k % 20).cast("double").alias("shift"))
    samples, windows, _ = synthetic_match(spark, matches=matches)
    found = detect(samples, windows, matches.select("media_id", F.lit(360.0).alias("duration_s"))).events
    return found.select("media_id", "event_id", "event_t", "change_t", "score_before", "score_after", "confidence")


_FOLLOW = f"""
  WITH RECURSIVE b AS (SELECT cast(label AS VARCHAR) AS media_id, x.* FROM ({_BOX}) x JOIN embeddings e ON e.vec_id = x.ord),
  t AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY confidence DESC, ord) AS n, CASE WHEN least(x, 1000 - x) >= 60 THEN 1.0 ELSE greatest(0.35, least(x, 1000 - x) / 60) END AS w FROM b),
  k AS (SELECT *, row_number() OVER (PARTITION BY media_id, frame ORDER BY height * w DESC, confidence * w DESC, n) AS best FROM t WHERE n <= 6),
  c AS (SELECT media_id, frame, round(max(x) FILTER (best = 1), 1) AS cx, round(max(y) FILTER (best = 1), 1) AS cy FROM k GROUP BY 1, 2),
  l AS (SELECT media_id, frame, list(struct_pack(x := x, y := y) ORDER BY confidence DESC, ord) FILTER (width < 40 AND confidence >= 0.05) AS balls FROM b GROUP BY 1, 2),
  f AS (SELECT media_id, frame / 3 AS t, cx, cy, coalesce(balls, []) AS balls, row_number() OVER (PARTITION BY media_id ORDER BY frame) AS rn FROM c JOIN l USING (media_id, frame)),
  s AS (SELECT DISTINCT media_id, 0::BIGINT AS rn, NULL::DOUBLE AS t, NULL::STRUCT(x DOUBLE, y DOUBLE) AS ball, 0 AS streak, NULL::DOUBLE AS lx, NULL::DOUBLE AS ly, 0 AS lost, NULL::VARCHAR AS kind, NULL::DOUBLE AS x FROM f UNION ALL
    SELECT media_id, rn, t, ball, streak, coalesce(tx, ax), coalesce(ty, ay), CASE WHEN tx IS NULL THEN lost + 1 ELSE 0 END, kind, tx FROM (
      SELECT *, CASE WHEN follows THEN 'ball' WHEN near THEN 'cluster' END AS kind, CASE WHEN follows THEN ball.x WHEN near THEN cx END AS tx, CASE WHEN follows THEN ball.y WHEN near THEN cy END AS ty FROM (
        SELECT *, streak >= 2 AS follows, cx IS NOT NULL AND (ax IS NULL OR abs(cx - ax) + abs(cy - ay) <= 300) AS near FROM (
          SELECT *, CASE WHEN ball IS NULL THEN 0 ELSE before + 1 END AS streak FROM (
            SELECT f.*, s.streak AS before, s.lost, CASE WHEN s.lost < 6 THEN s.lx END AS ax, CASE WHEN s.lost < 6 THEN s.ly END AS ay,
              list_filter(f.balls, lambda p: s.ball IS NULL OR abs(p.x - s.ball.x) + abs(p.y - s.ball.y) <= 150)[1] AS ball FROM s JOIN f ON f.media_id = s.media_id AND f.rn = s.rn + 1)))))
  SELECT media_id, round(t, 3) AS t, kind, round(x, 1) AS x, kind IS NULL AS lost FROM s WHERE rn > 0"""


@query(_FOLLOW)
def q_follow(spark, sf_dir):
    """What a camera would follow over the boxes of each label."""
    boxes = _boxes(spark, sf_dir).withColumnRenamed("label", "media_id")
    balls = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("by"), "ord", "x", "y", "width", "height", "confidence", F.lit("ball").alias("kind"))))
    ball = F.transform(balls, lambda b: F.struct(*[b[c].alias(c) for c in ("x", "y", "width", "height", "confidence", "kind")]))
    seen = boxes.where("width < 40").groupBy("media_id", "frame").agg(ball.alias("balls"))
    persons = tracking.person_clusters(boxes, width=1000.0).select("media_id", "frame", F.struct("x", "y", "width", "height", "confidence", "kind").alias("cluster"))
    frames = seen.join(persons, ["media_id", "frame"], "full").withColumns({"t": F.col("frame") / 3, "balls": F.coalesce("balls", F.expr(f"cast(array() as array<{tracking.TARGET}>)"))})
    out = tracking.followed(frames, ["media_id"], most=tracking.gate(1000.0))
    return out.select("media_id", F.round("t", 3).alias("t"), "target.kind", F.round("target.x", 1).alias("x"), F.col("target").isNull().alias("lost"))
