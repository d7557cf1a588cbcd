"""Queries of segment mapping, context, audits and record checks, added to those of the registry, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import context as C
from lumenframe.operators import records as R
from lumenframe.plans.extended import COVERAGE
from lumenframe.plans.registry import DOT, FE, FT, TOKENS, query
from lumenframe.sources.corpus import event_frames, table, text_frames

SEGMENTS = "sg AS (SELECT video_id, shot_id AS segment_id, min(ts) AS start_time, max(ts) AS end_time FROM ft GROUP BY ALL)"


@query(f"""WITH {FT}, {SEGMENTS}, a AS (SELECT frame_id AS artifact_id, CASE WHEN frame_id % 7 <> 0 THEN video_id END AS v,
    CASE WHEN frame_id % 4 = 0 THEN CASE WHEN frame_id % 8 = 0 THEN frame_id + 1000000000 ELSE frame_id END END AS f,
    CASE WHEN frame_id % 4 = 1 THEN shot_id END AS s, CASE WHEN frame_id % 4 IN (1, 2) THEN ts END AS t FROM ft WHERE frame_id % 5 <> 0)
  SELECT artifact_id, shot_id AS segment_id FROM a JOIN ft ON f = frame_id WHERE v IS NULL OR v = video_id
  UNION ALL SELECT artifact_id, segment_id FROM a JOIN sg ON s = segment_id WHERE f IS NULL AND (v IS NULL OR v = video_id)
  UNION ALL SELECT artifact_id, segment_id FROM a JOIN sg ON t BETWEEN start_time AND end_time WHERE f IS NULL AND s IS NULL AND (v IS NULL OR v = video_id)""")
def artifact_segments(spark, sf):
    f, n = text_frames(spark, sf), F.col("frame_id")
    segments = f.groupBy("video_id", F.col("shot_id").alias("segment_id")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"))
    artifacts = f.select(
        n.alias("artifact_id"), F.when(n % 7 != 0, F.col("video_id")).alias("video_id"), F.when(n % 8 == 0, n + 1000000000).when(n % 4 == 0, n).alias("frame_id"),
        F.when(n % 4 == 1, F.col("shot_id")).alias("segment_id"), F.when((n % 4).isin(1, 2), F.col("ts")).alias("timestamp"), F.when(n % 5 == 0, "failed").when(n % 5 > 1, "success").alias("status"),
    )
    return C.assign_segments(artifacts, segments, f.select("video_id", "frame_id", F.col("shot_id").alias("segment_id")))


@query(f"WITH {FT}, h AS (SELECT video_id, frame_id, CASE WHEN frame_id % 3 = 0 THEN 'own' END AS own FROM ft), m AS (SELECT * FROM ft WHERE frame_id % 2 = 0) SELECT h.video_id, h.frame_id, coalesce(m.shot_id, own) AS segment_id, m.shot_id IS NOT NULL AS mapped FROM h LEFT JOIN m ON h.video_id = m.video_id AND h.frame_id = m.frame_id")
def hit_segments(spark, sf):
    f = text_frames(spark, sf)
    hits = f.select("video_id", "frame_id", F.when(F.col("frame_id") % 3 == 0, "own").alias("segment_id"))
    return C.canonical_segments(hits, f.where("frame_id % 2 = 0").select("video_id", "frame_id", F.col("shot_id").alias("segment_id")))


@query(f"""WITH {FT}, p AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY ts, frame_id) AS p FROM ft)
  SELECT a.frame_id AS target, b.frame_id, b.shot_id AS segment_id, CASE WHEN b.p < a.p THEN 'before' ELSE 'after' END AS direction, round(b.ts - a.ts, 6) AS delta_seconds
  FROM p a JOIN p b ON a.video_id = b.video_id AND abs(a.p - b.p) BETWEEN 1 AND 3 AND abs(b.ts - a.ts) <= 2""")
def frame_context(spark, sf):
    f = text_frames(spark, sf)
    return C.neighbor_context(f, f, 2.0, 3)


@query(rf"""WITH {FT}, k AS (SELECT *, rtrim(regexp_replace(lower(trim(regexp_replace(caption, '\s+', ' ', 'g'))), '\.+$', '')) AS key, regexp_replace(regexp_replace(caption, '^\s+|\s+$', '', 'g'), '\.+$', '') AS said FROM ft),
  f AS (SELECT video_id, shot_id, key, arg_min(said, (ts, frame_id)) AS said, min((ts, frame_id)) AS o FROM k WHERE key <> '' GROUP BY ALL)
  SELECT video_id, shot_id, md5(string_agg(said, '. ' ORDER BY o) || '.') AS caption_md5, count(*) AS kept FROM f GROUP BY ALL""")
def segment_caption(spark, sf):
    return C.segment_captions(text_frames(spark, sf)).select("video_id", "shot_id", F.md5("caption").alias("caption_md5"), "kept")


@query(f"""WITH v AS (SELECT label AS video_id, vec_id AS frame_id, vec_id / 2e1 AS ts, embedding FROM embeddings), o AS (SELECT *, lag(frame_id) OVER w AS left_frame, lag(ts) OVER w AS lts, lag(embedding) OVER w AS le FROM v WINDOW w AS (PARTITION BY video_id ORDER BY ts, frame_id))
  SELECT video_id, left_frame, frame_id AS right_frame, round((1 - least(1e0, greatest(-1e0, {DOT.format('embedding', 'le')}))) / 2, 6) AS delta FROM o WHERE ts - lts > 0 AND ts - lts <= 75e-2""")
def embedding_deltas(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame_id"), (F.col("vec_id") / 20.0).alias("ts"), "embedding")
    return C.adjacent_deltas(v).withColumn("delta", F.round("delta", 6))


COVERED = " + ".join(f"CASE WHEN list_contains(s, '{t}') THEN {w}::DOUBLE ELSE 0e0 END" for t, w in COVERAGE.items())


@query(f"""WITH {FT}, {TOKENS}, s AS (SELECT frame_id, list(DISTINCT stem) AS s FROM st GROUP BY frame_id), b AS (SELECT ft.frame_id, least(1e0, greatest(0e0, (ft.frame_id % 100) / 80e0 - 1e-1)) AS base, ft.frame_id % 6 <> 0 AND coalesce(caption, '') <> '' AS told, coalesce({COVERED}, 0e0) / {sum(COVERAGE.values())}::DOUBLE AS c FROM ft LEFT JOIN s USING (frame_id))
  SELECT frame_id, round(CASE WHEN told THEN 55e-2 * base + 45e-2 * round(c, 6) ELSE 85e-2 * base END, 8) AS quality FROM b""")
def event_quality(spark, sf):
    rows = R.with_term_coverage(text_frames(spark, sf), COVERAGE)
    told = (F.col("frame_id") % 6 != 0) & (F.coalesce("caption", F.lit("")) != "")
    return rows.select("frame_id", F.round(C.event_quality((F.col("frame_id") % 100) / 80.0 - 0.1, F.col("coverage"), told), 8).alias("quality"))


@query(f"WITH {FT} SELECT shot_id, 'TC-' || substr(sha256(string_agg(video_id || chr(0) || frame_id || chr(0) || shot_id || chr(0) || chr(0) || printf('%.6f', ts) || chr(0), '' ORDER BY ts, frame_id)), 1, 16) AS chain_id FROM ft GROUP BY shot_id")
def chain_ids(spark, sf):
    f = text_frames(spark, sf).withColumn("segment_id", F.lit(None).cast("string"))
    chains = f.groupBy("shot_id").agg(F.array_sort(F.collect_list(F.struct("ts", "frame_id", "video_id", "shot_id", "segment_id"))).alias("e"))
    return chains.select("shot_id", C.chain_id(F.col("e")).alias("chain_id"))


@query("""WITH s AS (SELECT p_partkey AS shot_id, p_partkey * 1e1 AS b, p_size / 4e0 AS d, p_partkey * 250 AS lo, p_partkey * 250 + CAST(floor(p_size * 25 / 4) AS BIGINT) AS hi FROM part),
  o AS (SELECT *, unnest(CASE WHEN d < 4 THEN [d / 2] WHEN d <= 8 THEN [d / 3, d * 2 / 3] ELSE list_transform(range(0, CAST(ceil((d - 2) / 4) AS BIGINT)), lambda k: 2 + 4e0 * k) END) AS o FROM s)
  SELECT DISTINCT shot_id, greatest(least(hi, lo + 5), least(greatest(least(hi, lo + 5), hi - 5), CAST(round_even((b + o) * 25, 0) AS BIGINT))) AS frame_index, CASE WHEN d < 4 THEN 'midpoint_lt_4s' WHEN d <= 8 THEN 'two_frames_4_to_8s' ELSE 'every_4s_gt_8s' END AS reason FROM o""")
def shot_sampling(spark, sf):
    k, n = F.col("p_partkey"), F.col("p_size")
    shots = table(spark, sf, "part").select(k.alias("shot_id"), (k * 10.0).alias("start_sec"), (n / 4.0).alias("duration"), F.lit(25.0).alias("fps"), (k * 250).alias("start_frame"), (k * 250 + F.floor(n * 25 / 4)).alias("end_frame"))
    return C.sampled_frames(shots)


@query(f"WITH {FT} SELECT video_id, frame_id, row_number() OVER (ORDER BY video_id, frame_id) - 1 AS row_id FROM ft")
def global_row_ids(spark, sf):
    return C.global_rows(text_frames(spark, sf)).select("video_id", "frame_id", "row_id")


@query(f"WITH {FE}, c AS (SELECT video_id, object, count(*) AS n FROM fe WHERE confidence >= 3e-1 GROUP BY ALL) SELECT video_id, string_agg(object || ':' || n, ',' ORDER BY object) AS counts, CAST(sum(n) AS BIGINT) AS detections FROM c GROUP BY video_id")
def detection_counts(spark, sf):
    found = C.class_counts(event_frames(spark, sf).where("object IS NOT NULL"), 0.3)
    told = F.transform(F.map_entries("counts"), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string")))
    return found.select("video_id", F.array_join(told, ",").alias("counts"), "detections")


@query("""WITH r AS (SELECT doc_id % 900 AS frame_id, CASE WHEN doc_id % 11 <> 0 THEN source END AS video_id, CASE WHEN doc_id % 13 = 0 THEN '' ELSE 'p' END AS keyframe_path FROM documents)
  SELECT frame_id, 'schema_error' AS error, CASE WHEN video_id IS NULL THEN 'video_id' ELSE '' END AS missing_fields, CASE WHEN keyframe_path = '' THEN 'keyframe_path' ELSE '' END AS empty_fields FROM r WHERE video_id IS NULL OR keyframe_path = ''
  UNION ALL SELECT frame_id, 'duplicate_frame_id', '', '' FROM r WHERE frame_id IN (SELECT frame_id FROM r GROUP BY 1 HAVING count(*) > 1)""")
def frame_record_errors(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    return C.record_errors(d.select((n % 900).alias("frame_id"), F.when(n % 11 != 0, F.col("source")).alias("video_id"), F.when(n % 13 == 0, "").otherwise("p").alias("keyframe_path")), ("video_id", "keyframe_path"))


@query("""WITH v AS (SELECT d.doc_id, toxic = 0 AS good FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 = 0) d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (doc_id))
  SELECT count(good) AS reviewed, count(CASE WHEN NOT good THEN 1 END) AS false_events, round(count(good) / nullif(count(*), 0)::DOUBLE, 6) AS coverage, round(count(CASE WHEN NOT good THEN 1 END) / nullif(count(good), 0)::DOUBLE, 6) AS false_rate FROM v""")
def protection_reviews(spark, sf):
    detected = table(spark, sf, "documents").where("doc_id % 3 = 0").select(F.col("doc_id").alias("event_id"))
    reviews = table(spark, sf, "labels").groupBy(F.col("doc_id").alias("event_id")).agg((F.max("toxic") == 0).alias("is_true_event"))
    return C.review_coverage(detected, reviews)


@query(f"""WITH {FT}, s AS (SELECT video_id, shot_id, count(CASE WHEN frame_id % 16 = 0 THEN 1 END) AS n FROM ft GROUP BY ALL), e AS (SELECT video_id, frame_id // 100 AS event_id, count(CASE WHEN frame_id % 16 = 0 THEN 1 END) AS n FROM ft WHERE frame_id % 2 = 0 GROUP BY ALL),
  a AS (SELECT video_id, count(CASE WHEN n = 0 THEN 1 END) AS missing_shots FROM s GROUP BY 1), b AS (SELECT video_id, count(CASE WHEN n = 0 THEN 1 END) AS missing_events FROM e GROUP BY 1)
  SELECT video_id, missing_shots, coalesce(missing_events, 0) AS missing_events, missing_shots = 0 AND coalesce(missing_events, 0) = 0 AS satisfied FROM a LEFT JOIN b USING (video_id)""")
def selection_audit(spark, sf):
    f = text_frames(spark, sf)
    events = f.where("frame_id % 2 = 0").select("video_id", F.floor(F.col("frame_id") / 100).alias("event_id"), "frame_id")
    return C.selection_audit(f, events, f.where("frame_id % 16 = 0"))


LOOSE = "CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN '' WHEN 1 THEN ' True ' WHEN 2 THEN 'YES' WHEN 3 THEN '1' WHEN 4 THEN '0' END"


@query(f"WITH r AS (SELECT p_partkey, {LOOSE} AS said, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS n FROM part) SELECT p_partkey AS frame_id, coalesce(lower(trim(said)) IN ('1', 'true', 'yes'), false) AS flag, CAST(nullif(n, '') AS BIGINT) AS number FROM r")
def optional_fields(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", F.expr(LOOSE).alias("said"), F.expr("CASE WHEN p_partkey % 4 > 0 THEN CAST(p_size AS STRING) ELSE '' END").alias("n"))
    return rows.select(F.col("p_partkey").alias("frame_id"), C.truth(F.col("said")).alias("flag"), C.optional(F.col("n"), "long").alias("number"))
