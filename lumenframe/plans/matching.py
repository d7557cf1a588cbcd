"""Queries of the merge fold, of joins that reject and of context around absent frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators import aliases as A
from lumenframe.operators.fusion import merge_fold as fold
from lumenframe.plans.registry import FT, query
from lumenframe.sources.corpus import table, text_frames

LISTED = """hi AS (SELECT source AS video_id, CASE WHEN doc_id % 5 > 0 THEN doc_id // 2 END AS frame_id, CASE WHEN doc_id % 10 > 0 THEN 's' || doc_id // 6 END AS segment_id, CASE WHEN doc_id % 20 > 0 THEN doc_id // 4 END AS faiss_index,
    doc_id // 8 / 3e0 AS ts, (doc_id % 3) / 2e0 AS conf, l AS list, CASE l WHEN 0 THEN (doc_id % 100) / 1e2 WHEN 1 THEN (doc_id * 7 % 100) / 1e2 + 4e-7 ELSE (doc_id * 3 % 50) / 5e1 END AS score,
    CASE WHEN doc_id % (l + 2) = 0 THEN left(text, 20) ELSE '' END AS caption, CASE WHEN doc_id % 3 = l THEN [lang, 'o' || (doc_id % 4)] ELSE [] END AS objects, ['visual', 'caption', 'ocr'][l + 1] AS modality, l * 1000000000000 + doc_id AS seq
    FROM documents, range(3) r(l) WHERE l = 0 OR doc_id % (l + 1) = 0),
  hk AS (SELECT *, CASE WHEN frame_id IS NOT NULL THEN video_id || ':f' || frame_id WHEN segment_id IS NOT NULL THEN video_id || ':s' || segment_id WHEN faiss_index IS NOT NULL THEN 'r' || faiss_index ELSE video_id || ':t' || printf('%.3f', ts) END AS id FROM hi),
  fo AS (SELECT id, list_reduce(list({'v': video_id, 's': score, 'c': conf, 'a': caption, 'o': objects, 'm': 0} ORDER BY seq), lambda x, y: CASE WHEN y.s > x.s
      THEN {'v': y.v, 's': round(y.s, 6), 'c': y.c, 'a': CASE WHEN y.a <> '' THEN y.a ELSE x.a END, 'o': list_concat(y.o, x.o), 'm': 1}
      ELSE {'v': x.v, 's': round(x.s, 6), 'c': x.c, 'a': CASE WHEN x.a <> '' THEN x.a ELSE y.a END, 'o': list_concat(x.o, y.o), 'm': 1} END) AS f, min(seq) AS first_seen FROM hk GROUP BY id)"""


@query(f"""WITH {LISTED}, sc AS (SELECT id, string_agg(modality || '=' || round(score, 6), ',' ORDER BY modality) AS modalities FROM (SELECT id, modality, max(score) AS score FROM hk GROUP BY ALL) GROUP BY id)
  SELECT f.v AS video_id, f.s AS score, coalesce(f.a, '') AS caption, array_to_string(list_filter(list_transform(f.o, lambda x, i: CASE WHEN list_position(f.o, x) = i THEN x END), lambda x: x IS NOT NULL AND x <> ''), ',') AS objects, modalities, first_seen, row_number() OVER (ORDER BY f.s DESC, f.c DESC NULLS LAST, first_seen) AS place FROM fo JOIN sc USING (id)""")
def merge_fold(spark, sf):
    d, k = table(spark, sf, "documents"), F.col("doc_id")
    lists = []
    for i, (name, score) in enumerate((("visual", (k % 100) / 100.0), ("caption", (k * 7 % 100) / 100.0 + 4e-7), ("ocr", (k * 3 % 50) / 50.0))):
        lists.append(d.where(k % (i + 1) == 0).select(
            F.col("source").alias("video_id"), F.when(k % 5 > 0, F.floor(k / 2)).alias("frame_id"), F.when(k % 10 > 0, F.concat(F.lit("s"), F.floor(k / 6).cast("string"))).alias("segment_id"), F.when(k % 20 > 0, F.floor(k / 4)).alias("faiss_index"),
            (F.floor(k / 8) / 3.0).alias("timestamp"), ((k % 3) / 2.0).alias("timestamp_confidence"), score.alias("score"), F.when(k % (i + 2) == 0, F.substring("text", 1, 20)).otherwise("").alias("caption"),
            F.when(k % 3 == i, F.array("lang", F.concat(F.lit("o"), (k % 4).cast("string")))).otherwise(F.array().cast("array<string>")).alias("objects"), F.create_map(F.lit(name), score).alias("modality_scores"), (F.lit(i * 1_000_000_000_000) + k).alias("seq"),
        ))
    merged = fold(lists[0].unionByName(lists[1]).unionByName(lists[2]))
    told = F.array_join(F.transform(F.map_entries("modality_scores"), lambda e: F.concat(e["key"], F.lit("="), F.round(e["value"], 6).cast("string"))), ",")
    rows = merged.select("video_id", "score", F.coalesce("caption", F.lit("")).alias("caption"), F.array_join("objects", ",").alias("objects"), told.alias("modalities"), "first_seen", "timestamp_confidence")
    return ranked(rows)


def ranked(rows):
    """The place of each merged candidate: those before it of each score and confidence, then by where it was first seen."""
    keys = ["score", "timestamp_confidence"]
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy(F.desc("score"), F.desc_nulls_last("timestamp_confidence")).rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("score", F.col("timestamp_confidence").alias("_c"), F.coalesce(earlier, F.lit(0)).alias("_before"))
    held = rows.withColumn("_c", F.col("timestamp_confidence")).join(starts, (rows["score"] == starts["score"]) & F.col("timestamp_confidence").eqNullSafe(starts["_c"])).drop(starts["score"]).drop(starts["_c"])
    at = F.row_number().over(Window.partitionBy("score", "timestamp_confidence").orderBy("first_seen"))
    return held.withColumn("place", F.col("_before") + at).drop("_before", "_c", "timestamp_confidence")


def candidates_of(f):
    return f.select("video_id", F.concat(F.lit("C"), F.col("frame_id").cast("string")).alias("candidate_id"), F.concat(F.lit("F"), F.col("frame_id").cast("string")).alias("frame_id"))


@query(f"""WITH {FT} SELECT video_id, 'C' || frame_id AS candidate_id, ['success', 'error', 'skipped'][frame_id % 3 + 1] AS status, length(caption) AS chars FROM ft WHERE frame_id % 4 > 0""")
def resolved_records(spark, sf):
    f, k = text_frames(spark, sf), F.col("frame_id")
    named, framed = F.concat(F.lit("C"), k.cast("string")), F.concat(F.lit("F"), k.cast("string"))
    rows = f.where(k % 4 > 0).select(
        "video_id", F.when(k % 4 < 3, named).alias("candidate_id"), F.when(k % 4 == 3, F.when(k % 8 == 3, named).otherwise(framed)).when(k % 4 == 2, framed).alias("frame_id"),
        F.element_at(F.array(F.lit("success"), F.lit("error"), F.lit("skipped")), (k % 3 + 1).cast("int")).alias("status"), F.length("caption").cast("long").alias("chars"),
    )
    return A.resolve(rows, A.alias_table(candidates_of(f)), "caption record").select("video_id", "candidate_id", "status", "chars")


@query("WITH e AS (SELECT label AS video_id, vec_id, list_transform(embedding, lambda x: x * (1 + vec_id % 3)) AS v FROM embeddings) SELECT video_id, 'C' || vec_id AS candidate_id, round(sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) / (1 + vec_id % 3), 4) AS length, round(v[1]::DOUBLE / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))), 4) AS first FROM e")
def aligned_vectors(spark, sf):
    e, k = table(spark, sf, "embeddings").withColumnRenamed("label", "video_id"), F.col("vec_id")
    vectors = e.select("video_id", k.alias("embedding_index"), F.transform("embedding", lambda x: (x * (1 + k % 3)).cast("float")).alias("embedding"))
    records = e.select("video_id", k.alias("embedding_index"), F.concat(F.lit("C"), k.cast("string")).alias("candidate_id"), F.when(k % 2 == 0, F.concat(F.lit("F"), k.cast("string"))).alias("frame_id"), F.when(k % 5 > 0, F.size("embedding")).alias("vector_dim"), (k % 3 == 0).alias("normalized"))
    out = A.aligned_vectors(vectors, records, A.alias_table(candidates_of(e.select("video_id", k.alias("frame_id")))))
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return out.select("video_id", "candidate_id", F.round(length, 4).alias("length"), F.round(F.col("embedding")[0].cast("double"), 4).alias("first"))


WINDOWED = f"""{FT}, mem AS (SELECT video_id, shot_id AS segment_id, frame_id, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY ts, frame_id) - 1 AS p FROM ft WHERE frame_id % 3 > 0),
  seg AS (SELECT video_id, shot_id AS segment_id, min(ts) AS b, max(ts) AS e FROM ft WHERE frame_id % 3 > 0 GROUP BY ALL), siz AS (SELECT video_id, segment_id, count(*) AS n FROM mem GROUP BY ALL),
  tar AS (SELECT ft.frame_id AS id, ft.video_id, siz.segment_id, n, CAST(coalesce(mem.p, CASE WHEN e > b THEN round_even(least(1e0, greatest(0e0, (ts - b) / (e - b))) * (n - 1), 0) ELSE n // 2 END) AS BIGINT) AS c FROM ft JOIN siz ON ft.video_id = siz.video_id AND ft.shot_id = siz.segment_id JOIN seg ON seg.video_id = ft.video_id AND seg.segment_id = ft.shot_id LEFT JOIN mem ON mem.video_id = ft.video_id AND mem.segment_id = ft.shot_id AND mem.frame_id = ft.frame_id)"""


@query(f"WITH {WINDOWED} SELECT id, mem.frame_id, CAST(row_number() OVER (PARTITION BY id ORDER BY abs(p - c), p) AS INTEGER) AS rank FROM tar JOIN mem USING (video_id, segment_id) WHERE abs(p - c) <= 3 AND mem.frame_id <> id QUALIFY rank <= 3")
def segment_window(spark, sf):
    f = text_frames(spark, sf)
    some = f.where("frame_id % 3 > 0")
    segments = some.groupBy("video_id", F.col("shot_id").alias("segment_id")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.transform(F.array_sort(F.collect_list(F.struct("ts", "frame_id"))), lambda x: x["frame_id"]).alias("keyframe_ids"))
    targets = f.select(F.col("frame_id").alias("id"), "video_id", F.col("shot_id").alias("segment_id"), "frame_id", F.col("ts").alias("timestamp"))
    return A.segment_window(A.segment_members(segments), segments, targets, 3)


@query(f"""WITH {FT}, tg AS (SELECT frame_id AS id, video_id, frame_id, ts + 3e-1 AS ts, CASE WHEN frame_id % 3 = 0 THEN shot_id END AS shot_id, CASE WHEN frame_id % 3 = 1 THEN ts - 20 END AS a, CASE WHEN frame_id % 3 = 1 THEN ts - 2 END AS b FROM ft),
  pr AS (SELECT tg.id, ft.frame_id, ft.ts, row_number() OVER (PARTITION BY tg.id ORDER BY abs(ft.ts - tg.ts), ft.ts, ft.frame_id) AS r FROM tg JOIN ft ON tg.video_id = ft.video_id AND ft.frame_id <> tg.frame_id AND CASE WHEN tg.shot_id IS NOT NULL THEN tg.shot_id = ft.shot_id WHEN a IS NOT NULL THEN ft.ts BETWEEN a AND b ELSE abs(ft.ts - tg.ts) <= 4 END)
  SELECT id, frame_id, CAST(row_number() OVER (PARTITION BY id ORDER BY ts, frame_id) AS INTEGER) AS place FROM pr WHERE r <= 4""")
def shot_neighbours(spark, sf):
    f, k = text_frames(spark, sf), F.col("frame_id")
    targets = f.select(k.alias("id"), "video_id", "frame_id", (F.col("ts") + 0.3).alias("ts"), F.when(k % 3 == 0, F.col("shot_id")).alias("shot_id"), F.when(k % 3 == 1, F.col("ts") - 20).alias("shot_start"), F.when(k % 3 == 1, F.col("ts") - 2).alias("shot_end"))
    return A.shot_neighbours(f, targets, 4)
