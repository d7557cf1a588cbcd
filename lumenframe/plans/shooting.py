"""Queries of shots, their candidates, and near-duplicate vectors, with their SQL. Parts stand for detected scenes, brands for videos."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenframe.operators import selection as P
from lumenframe.operators import sequences as S
from lumenframe.operators import shots as T
from lumenframe.plans.registry import FT, query
from lumenframe.sources.corpus import table, text_frames

SHOTS = """sc AS (SELECT p_brand AS video_id, p_partkey * 37 % 5100 - 60 AS s, p_partkey * 37 % 5100 - 60 + p_size * 2 AS e FROM part WHERE p_brand <> 'Brand#7'), vi AS (SELECT DISTINCT p_brand AS video_id, 4800 AS frame_count FROM part),
  ct AS (SELECT video_id, greatest(0, s) AS s, least(e, frame_count - 1) AS e FROM sc JOIN vi USING (video_id) WHERE e >= 0 AND s <= frame_count - 1),
  cv AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c FROM ct), kp AS (SELECT video_id, greatest(s, coalesce(c + 1, 0)) AS start_frame, e AS end_frame FROM cv WHERE e >= greatest(s, coalesce(c + 1, 0))),
  al AS (SELECT * FROM kp UNION ALL SELECT video_id, 0, frame_count - 1 FROM vi WHERE video_id NOT IN (SELECT video_id FROM kp)), sh AS (SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_frame) AS INTEGER) AS shot_index, start_frame::BIGINT AS start_frame, end_frame::BIGINT AS end_frame FROM al)"""


def _shots(spark, sf):
    d = table(spark, sf, "part")
    start = F.col("p_partkey") * 37 % 5100 - 60
    scenes = d.where("p_brand <> 'Brand#7'").select(F.col("p_brand").alias("video_id"), start.alias("start_frame"), (start + F.col("p_size") * 2).alias("end_frame"))
    return T.scenes_to_shots(scenes, d.select(F.col("p_brand").alias("video_id"), F.lit(4800).alias("frame_count")).distinct())


@query(f"WITH {SHOTS} SELECT * FROM sh")
def scene_shots(spark, sf):
    return T.validated(_shots(spark, sf))


@query(f"""WITH {SHOTS}, an AS (SELECT *, least(end_frame, start_frame + 5) AS a, greatest(start_frame, end_frame - 5) AS z FROM sh), ty AS (SELECT *, (end_frame - start_frame + 1) / 25e0 <= 5e-1 + 1e-12 OR a >= z AS tiny FROM an),
  cd AS (SELECT video_id, shot_index, start_frame + (end_frame - start_frame) // 2 AS f, 0 AS r FROM ty WHERE tiny UNION ALL SELECT video_id, shot_index, a, 2 FROM ty WHERE NOT tiny UNION ALL SELECT video_id, shot_index, z, 3 FROM ty WHERE NOT tiny
    UNION ALL SELECT video_id, shot_index, start_frame + CAST(round_even(i * 125e-1, 0) AS BIGINT), 1 FROM (SELECT *, unnest(range(0, CAST(floor((end_frame - start_frame) / 125e-1 + 1e-12) AS BIGINT) + 1)) AS i FROM ty WHERE NOT tiny)
    UNION ALL SELECT video_id, shot_index, start_frame, 4 FROM ty QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY start_frame) = 1 UNION ALL SELECT video_id, shot_index, end_frame, 5 FROM ty QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY start_frame DESC) = 1)
  SELECT video_id, shot_index, 'CANDIDATE_' || video_id || '_' || lpad(f::VARCHAR, 9, '0') AS candidate_id, f AS frame_index, round(f / 25e0, 6) AS timestamp, array_to_string(list_transform(list_sort(list(DISTINCT r)), lambda k: {list(T.REASONS)}[k + 1]), ',') AS reasons FROM cd GROUP BY video_id, shot_index, f""")
def shot_candidates(spark, sf):
    found = T.candidates(_shots(spark, sf), F.lit(25.0), endpoints=True)
    return found.select("video_id", "shot_index", "candidate_id", "frame_index", F.round("timestamp", 6).alias("timestamp"), F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {FT} SELECT frame_id, CASE frame_id % 4 WHEN 0 THEN (frame_id % 10) / 10e0 >= 15e-2 WHEN 1 THEN (frame_id % 10) / 10e0 >= 55e-2 WHEN 2 THEN (frame_id % 10) / 10e0 >= 15e-2 OR (frame_id % 7) / 7e0 >= 55e-2 ELSE (frame_id % 10) / 10e0 >= 15e-2 END AS supported FROM ft""")
def absolute_support(spark, sf):
    k = F.col("frame_id")
    own, other = k % 10 / 10.0, k % 7 / 7.0
    scores = F.when(k % 4 == 0, F.create_map(F.lit("visual"), own)).when(k % 4 == 1, F.create_map(F.lit("dense_text"), own)).when(k % 4 == 2, F.create_map(F.lit("visual"), own, F.lit("dense_text"), other)).otherwise(F.create_map(F.lit("caption"), own))
    return text_frames(spark, sf).select("frame_id", S.absolute_support(scores, own).alias("supported"))


@query()
def vector_repeats(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("video_id"), F.col("vec_id").alias("frame_id"), (F.col("vec_id") / 4.0).alias("ts"), "embedding")
    return P.vector_repeats(e, 12.0, 0.2)
