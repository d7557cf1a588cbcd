"""Queries of text and object features, added to those of the registry, with their SQL.

Parts stand for recognised text regions (the brand is the video), events of the event table for detected objects.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import features as A
from lumenframe.operators.similar import fuzzy_clusters
from lumenframe.operators.timeline import caption_novelty
from lumenframe.plans.registry import FE, FT, query
from lumenframe.sources.corpus import event_frames, table, text_frames


def region_rows(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.col("p_brand").alias("video_id"), F.concat_ws("_", "p_brand", F.floor(k / 100).cast("string")).alias("shot_id"), k.alias("frame_id"), k.alias("frame_index"), (k / 80.0).alias("ts"),
        F.concat_ws(" ", "p_name", "p_type").alias("text"), (0.6 + (k % 9) * 0.05).alias("confidence"), (F.col("p_size") / 1000.0).alias("area"), (0.3 + (k % 7) / 70.0).alias("cx"), (0.4 + (k % 10) / 20.0).alias("cy"),
    )


def detection_rows(spark, sf):
    rows = event_frames(spark, sf).where("object IS NOT NULL")
    return rows.select("video_id", "frame_id", F.col("frame_id").alias("frame_index"), (F.col("ts") / 3600).alias("ts"), F.col("object").alias("class_name"), F.when(F.col("object") == "view", 7).alias("class_id"), "confidence", (F.col("track_id") / 400.0).alias("area"))


#: Common subsequences by bits: a mask a character of b, folded over the bit-vector recurrence.
REGIONS = """rg AS (SELECT p_brand AS video_id, p_brand || '_' || (p_partkey // 100) AS shot_id, p_partkey AS frame_id, p_partkey / 8e1 AS ts, p_name || ' ' || p_type AS text, trim(regexp_replace(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS key,
    6e-1 + (p_partkey % 9) * 5e-2 AS confidence, p_size / 1e3 AS area, 3e-1 + (p_partkey % 7) / 7e1 AS cx, 4e-1 + (p_partkey % 10) / 2e1 AS cy FROM part),
  kt AS (SELECT DISTINCT key FROM rg), kp AS (SELECT x.key AS a, y.key AS b FROM kt x JOIN kt y ON x.key < y.key AND 82 * (length(x.key) + length(y.key)) <= 200 * least(length(x.key), length(y.key))),
  km AS (SELECT a, b, list_transform(string_split(b, ''), lambda c: list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = c THEN 1::BIGINT << (i - 1) ELSE 0 END))::BIGINT) AS m FROM kp),
  kl AS (SELECT a, b, length(a) - bit_count(list_reduce(list_prepend((1::BIGINT << length(a)) - 1, m), lambda v, x: ((v + (v & x)) | (v - (v & x))) & ((1::BIGINT << length(a)) - 1))) AS l FROM km),
  sim AS (SELECT a, b FROM kl WHERE 200 * l >= 82 * (length(a) + length(b))),
  kv AS (SELECT DISTINCT video_id, key FROM rg WHERE key <> ''), ke AS (SELECT u.video_id, u.key AS x, w.key AS y FROM sim JOIN kv u ON u.key = a JOIN kv w ON w.key = b AND u.video_id = w.video_id),
  reach(video_id, x, y) AS (SELECT video_id, key, key FROM kv UNION SELECT r.video_id, r.x, CASE WHEN ke.x = r.y THEN ke.y ELSE ke.x END FROM reach r JOIN ke ON ke.video_id = r.video_id AND (ke.x = r.y OR ke.y = r.y)),
  tracks AS (SELECT video_id, x AS key, min(y) AS track FROM reach GROUP BY ALL)"""
JUDGED = f"""{REGIONS}, vt AS (SELECT video_id, count(DISTINCT frame_id) AS frames, count(DISTINCT shot_id) AS shots FROM rg GROUP BY 1),
  tr AS (SELECT video_id, track, count(DISTINCT frame_id) AS n, count(DISTINCT shot_id) AS s, greatest(max(cx) - min(cx), max(cy) - min(cy)) AS wide FROM rg JOIN tracks USING (video_id, key) GROUP BY ALL),
  ob AS (SELECT rg.*, track, n / frames::DOUBLE AS fraction, n >= 5 AND n / frames::DOUBLE >= 2e-1 AND s / shots::DOUBLE >= 2e-1 AND wide <= 2 * 8e-2 AS common, cy >= 78e-2 AND area <= 3e-2 AS subtitle, length(replace(replace(key, ' ', ''), '_', '')) AS chars
         FROM rg JOIN tracks USING (video_id, key) JOIN tr USING (video_id, track) JOIN vt USING (video_id)),
  sc AS (SELECT *, least(1e0, 55e-2 * confidence + 25e-2 * least(1e0, chars / 12e0) + 2e-1 * least(1e0, area / 3e-2)) * CASE WHEN common THEN 1e-1 WHEN subtitle THEN 35e-2 ELSE 5e-1 + 5e-1 * (1 - fraction) END AS score FROM ob)"""


def episodes_sql(rows: str, breaks: str, rules: A.Rules) -> str:
    """CTEs from eligible rows to the episodes of a track."""
    return f"""br AS (SELECT *, CASE WHEN {breaks} THEN 0 ELSE 1 END AS fresh FROM {rows} WINDOW w AS (PARTITION BY video_id, track ORDER BY ts, frame_id, key)),
  ru AS (SELECT *, sum(fresh) OVER (PARTITION BY video_id, track ORDER BY ts, frame_id, key ROWS UNBOUNDED PRECEDING) AS episode FROM br),
  ep AS (SELECT video_id, track, episode, min(ts) AS b, max(ts) AS e, arg_min(frame_id, (ts, frame_id)) AS first_index, count(DISTINCT frame_id) AS n, max(extreme) AS extreme, min(fraction) AS fraction, string_agg(DISTINCT frame_id::VARCHAR, ',' ORDER BY frame_id::VARCHAR) AS frames FROM ru GROUP BY ALL),
  ju AS (SELECT *, (episode = 1 OR (fraction <= {rules.rare_fraction:e} AND b - lag(e) OVER (PARTITION BY video_id, track ORDER BY episode) >= {rules.cooldown:e})) AND (n >= {rules.persistence} OR extreme) AS kept FROM ep)"""


EVENT = "'{0}_' || video_id || '_' || substr(sha1(video_id || chr(0) || track), 1, 12) || '_' || lpad(first_index::VARCHAR, 9, '0')"


@query(f"WITH RECURSIVE {REGIONS} SELECT video_id, key, track FROM tracks")
def text_tracks(spark, sf):
    rows = region_rows(spark, sf)
    return fuzzy_clusters(rows, F.col("video_id"), A.comparison(F.col("text")), A.SIMILAR_PERCENT).select(F.col("grp").alias("video_id"), F.col("text").alias("key"), F.col("cluster").alias("track"))


@query(f"WITH RECURSIVE {JUDGED} SELECT video_id, frame_id, track, round(fraction, 6) AS fraction, common, subtitle, round(score, 6) AS score FROM sc")
def text_scores(spark, sf):
    rows = region_rows(spark, sf)
    return A.text_tracks(rows, rows).select("video_id", "frame_id", "track", F.round("fraction", 6).alias("fraction"), "common", "subtitle", F.round("score", 6).alias("score"))


TEXT_ELIGIBLE = "el AS (SELECT *, confidence >= 95e-2 AS extreme FROM sc WHERE NOT common AND NOT subtitle AND confidence >= 75e-2 AND chars >= 4 AND area >= 2e-3)"
TEXT_JOINED = "ts - lag(ts) OVER w <= 125e-2 AND abs(cx - lag(cx) OVER w) <= 8e-2 AND abs(cy - lag(cy) OVER w) <= 8e-2"


@query(f"WITH RECURSIVE {JUDGED}, {TEXT_ELIGIBLE}, {episodes_sql('el', TEXT_JOINED, A.TEXT_RULES)} SELECT video_id, {EVENT.format('OCR')} AS event_id, 'ocr_new' AS event_type, 2 AS priority, frames FROM ju WHERE kept")
def text_events(spark, sf):
    rows = region_rows(spark, sf)
    found = A.protected_events(A.text_episodes(A.text_tracks(rows, rows)), "OCR", "ocr_new", 2)
    return found.select("video_id", "event_id", "event_type", "priority", F.array_join(F.array_sort(F.col("frame_ids").cast("array<string>")), ",").alias("frames"))


DETECTED = f"""{FE}, de AS (SELECT video_id, frame_id, ts / 3600 AS ts, lower(object) AS key, CASE WHEN object = 'view' THEN '7:' ELSE 'name:' END || lower(object) AS track, confidence, track_id / 4e2 AS area FROM fe WHERE object IS NOT NULL),
  dv AS (SELECT video_id, count(DISTINCT frame_id) AS frames FROM fe GROUP BY 1), dn AS (SELECT video_id, track, count(DISTINCT frame_id) AS n FROM de GROUP BY ALL),
  dq AS (SELECT de.*, n / frames::DOUBLE AS fraction, least(1e0, 7e-1 * confidence + 3e-1 * least(1e0, coalesce(area, 0e0) / 2e-1)) * (5e-1 + 5e-1 * (1 - n / frames::DOUBLE)) AS score FROM de JOIN dn USING (video_id, track) JOIN dv USING (video_id)),
  el AS (SELECT *, confidence >= 9e-1 AND area >= 2e-2 AS extreme FROM dq WHERE confidence >= 65e-2 AND area >= 1e-2)"""


@query(f"WITH {DETECTED}, {episodes_sql('el', 'ts - lag(ts) OVER w <= 125e-2', A.OBJECT_RULES)} SELECT video_id, {EVENT.format('OBJECT')} AS event_id, 'object_new' AS event_type, 1 AS priority, frames FROM ju WHERE kept")
def object_events(spark, sf):
    found = A.protected_events(A.object_episodes(A.object_tracks(event_frames(spark, sf), detection_rows(spark, sf))), "OBJECT", "object_new", 1)
    return found.select("video_id", "event_id", "event_type", "priority", F.array_join(F.array_sort(F.col("frame_ids").cast("array<string>")), ",").alias("frames"))


@query(f"WITH {DETECTED} SELECT video_id, frame_id, round(max(score), 12) AS score FROM dq GROUP BY ALL")
def object_scores(spark, sf):
    found = A.object_tracks(event_frames(spark, sf), detection_rows(spark, sf))
    return found.groupBy("video_id", "frame_id").agg(F.round(F.max("score"), 12).alias("score"))


NOVELTY = r"""cw AS (SELECT *, list_distinct(regexp_extract_all(replace(lower(coalesce(caption, '')), 'ß', 'ss'), '[\p{L}\p{N}]+', 0)) AS w FROM ft),
  cp AS (SELECT *, last_value(CASE WHEN len(w) > 0 THEN w END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY ts, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM cw),
  cn AS (SELECT video_id, frame_id, CASE WHEN p IS NULL THEN 5e-1 WHEN len(list_distinct(list_concat(w, p))) = 0 THEN 0e0 ELSE 1 - len(list_intersect(w, p)) / len(list_distinct(list_concat(w, p)))::DOUBLE END AS novelty FROM cp)"""


@query(f"""WITH {FT}, {NOVELTY}, lab AS (SELECT ft.video_id, doc_id AS frame_id, avg(quality) AS q FROM labels JOIN ft ON doc_id = frame_id GROUP BY ALL)
  SELECT ft.video_id, ft.frame_id, round(CASE WHEN ft.frame_id % 4 > 0 THEN round(novelty, 6) END, 6) AS caption, round(CASE WHEN ft.frame_id % 3 > 0 THEN coalesce(q, 0e0) END, 6) AS objects,
    round(coalesce((CASE WHEN ft.frame_id % 4 > 0 THEN 5e-2 * round(novelty, 6) ELSE 0e0 END + CASE WHEN ft.frame_id % 3 > 0 THEN 25e-2 * coalesce(q, 0e0) ELSE 0e0 END) / nullif(CASE WHEN ft.frame_id % 4 > 0 THEN 5e-2 ELSE 0e0 END + CASE WHEN ft.frame_id % 3 > 0 THEN 25e-2 ELSE 0e0 END, 0e0), 0e0), 9) AS importance
  FROM ft LEFT JOIN cn USING (video_id, frame_id) LEFT JOIN lab USING (video_id, frame_id)""")
def frame_features(spark, sf):
    f = text_frames(spark, sf)
    sure = f.join(table(spark, sf, "labels").groupBy(F.col("doc_id").alias("frame_id")).agg(F.avg("quality").alias("score")), "frame_id").select("video_id", "frame_id", "score")
    scores = {"caption": (f.where("frame_id % 4 > 0"), caption_novelty(f).withColumnRenamed("novelty", "score").where("frame_id % 4 > 0")), "objects": (f.where("frame_id % 3 > 0"), sure.where("frame_id % 3 > 0"))}
    out = A.frame_features(f.select("video_id", "frame_id"), scores)
    return out.select("video_id", "frame_id", *[F.round(c, 6).alias(c) for c in ("caption", "objects")], F.round("importance", 9).alias("importance"))
