"""Queries of published bundles and of places in an order, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.operators.evaluation import frame_map_audit as audit
from lumenframe.operators.ranks import places
from lumenframe.plans.registry import FT, query
from lumenframe.sources import bundles, files
from lumenframe.sources.corpus import table, text_frames


@query(f"""WITH {FT} SELECT 'frames' AS role, row_number() OVER (ORDER BY video_id NULLS FIRST, ts, frame_id) - 1 AS row, frame_id FROM ft
  UNION ALL SELECT 'vectors', row_number() OVER (ORDER BY vec_id) - 1, vec_id FROM embeddings""")
def bundle_rows(spark, sf):
    """Publish frames and vectors as one bundle, read it back verified, and return each table's rows by number."""
    path = f"{files.shared_dir(spark).rstrip('/')}/bundles/{uuid.uuid4().hex}"
    frames = bundles.Table(text_frames(spark, sf).select("video_id", "ts", "frame_id", "caption"), ("video_id", "ts", "frame_id"))
    vectors = bundles.Table(table(spark, sf, "embeddings"), ("vec_id",), "embedding", 64)
    bundles.publish(spark, path, {"frames": frames, "vectors": vectors}, source=sf)
    held = bundles.load(spark, path, source=sf)
    row = F.col(bundles.ROW).alias("row")
    return held["frames"].select(F.lit("frames").alias("role"), row, "frame_id").unionByName(held["vectors"].select(F.lit("vectors").alias("role"), row, F.col("vec_id").alias("frame_id")))


@query(f"WITH {FT} SELECT video_id, frame_id, row_number() OVER (PARTITION BY video_id ORDER BY length(caption) DESC NULLS LAST, frame_id) AS place FROM ft")
def length_places(spark, sf):
    f = text_frames(spark, sf).select("video_id", "frame_id", F.length("caption").alias("n"))
    return places(f, ["video_id"], F.desc("n"), "frame_id").select("video_id", "frame_id", "place")


@query("""WITH f AS (SELECT CASE WHEN doc_id % 11 = 0 THEN doc_id + 1000000 WHEN doc_id % 13 = 0 THEN doc_id - 1 ELSE doc_id END AS id, CASE WHEN doc_id % 17 > 0 THEN text ELSE '' END AS caption, source AS video_id, ['video_fps', 'interval', NULL][doc_id % 3 + 1] AS src FROM documents), t AS (SELECT count(*) + 5 AS total FROM documents),
  k AS (SELECT DISTINCT id FROM f), r AS (SELECT 'missing_index' AS issue, i AS id FROM (SELECT unnest(range(total)) AS i FROM t) WHERE i NOT IN (SELECT id FROM k) UNION ALL SELECT 'extra_index', id FROM k, t WHERE id < 0 OR id >= total
    UNION ALL SELECT 'repeated_index', id FROM f GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'empty_caption', id FROM f WHERE caption IS NULL OR caption = '' UNION ALL SELECT 'empty_video_id', id FROM f WHERE video_id IS NULL OR video_id = '' UNION ALL SELECT 'source_' || coalesce(src, 'none'), id FROM f)
  SELECT issue, count(*) AS n, array_to_string(list_sort(list(id))[1:20], ',') AS sample FROM r GROUP BY issue UNION ALL SELECT 'count_mismatch', 5, ''""")
def frame_map_audit(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    named = F.get(F.array(F.lit("video_fps"), F.lit("interval"), F.lit(None)), (k % 3).cast("int"))
    frames = d.select(F.when(k % 11 == 0, k + 1000000).when(k % 13 == 0, k - 1).otherwise(k).alias("id"), F.when(k % 17 > 0, F.col("text")).otherwise("").alias("caption"), F.col("source").alias("video_id"), named.alias("timestamp_source"))
    return audit(frames, d.count() + 5, "id", ("caption", "video_id")).withColumn("sample", F.array_join(F.transform("sample", lambda x: x.cast("string")), ","))
