"""More queries of the engine, added to those of the registry, with the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.operators import fusion as U
from lumenframe.operators import records as R
from lumenframe.plans.registry import FE, FT, HITS, RRF, TERMS, TOKENS, WORDS, _hits, query
from lumenframe.sources.corpus import event_frames, table, text_frames

KEY = f"array_to_string({WORDS.format('caption')}, ' ')"
COVERAGE = dict(zip(TERMS, (1.0, 0.55, 0.35), strict=True))


@query(f"WITH {FT}, {TOKENS}, s AS (SELECT frame_id, list(DISTINCT stem) AS s FROM st GROUP BY frame_id) SELECT ft.frame_id, round(coalesce({' + '.join(f"CASE WHEN list_contains(s, '{t}') THEN {w}::DOUBLE ELSE 0e0 END" for t, w in COVERAGE.items())}, 0e0) / {sum(COVERAGE.values())}::DOUBLE, 6) AS coverage FROM ft LEFT JOIN s USING (frame_id)")
def term_coverage(spark, sf):
    return R.with_term_coverage(text_frames(spark, sf), COVERAGE).select("frame_id", "coverage")


BOUNDED = "b AS (SELECT *, CASE WHEN frame_id % 3 = 0 THEN floor(ts / 5) * 5 END AS bs, CASE WHEN frame_id % 4 = 0 THEN floor(ts / 5) * 5 + 5 END AS be FROM ft)"


@query(f"WITH {FT}, {BOUNDED} SELECT video_id, shot_id, CAST(coalesce(min(bs), min(ts)) AS DOUBLE) AS start_time, CAST(coalesce(max(be), max(ts)) AS DOUBLE) AS end_time, count(*) AS frames, arg_min(frame_id, (ts, frame_id)) AS first_frame, arg_max(frame_id, (ts, frame_id)) AS last_frame FROM b GROUP BY ALL")
def segments_boundary(spark, sf):
    low = F.floor(F.col("ts") / 5).cast("double") * 5
    rows = text_frames(spark, sf).withColumns({"boundary_start": F.when(F.col("frame_id") % 3 == 0, low), "boundary_end": F.when(F.col("frame_id") % 4 == 0, low + 5)})
    return R.boundary_segments(rows)


@query(f"""WITH {FT}, k AS (SELECT *, {KEY} AS key FROM ft), f AS (SELECT video_id, shot_id, key, arg_min(caption, (ts, frame_id)) AS caption, min((ts, frame_id)) AS o, count(*) AS n FROM k WHERE key <> '' GROUP BY ALL)
  SELECT video_id, shot_id, md5(string_agg(caption, ' ' ORDER BY o)) AS caption_md5, count(*) AS kept, CAST(sum(n) AS BIGINT) AS seen FROM f GROUP BY ALL""")
def caption_exact_dedupe(spark, sf):
    return R.distinct_captions(text_frames(spark, sf)).select("video_id", "shot_id", F.md5("caption").alias("caption_md5"), "kept", "seen")


REGION = "coalesce(caption, '')"


@query(f"""WITH {FT}, r AS (SELECT *, {REGION} AS text, (frame_id % 97) / 97e0 AS confidence FROM ft), k AS (SELECT *, array_to_string({WORDS.format('text')}, ' ') AS key FROM r)
  SELECT video_id, shot_id, key, arg_min(text, (ts, frame_id)) AS text, round(max(confidence), 6) AS confidence, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT frame_id) AS sources FROM k WHERE key <> '' GROUP BY ALL""")
def segment_ocr_agg(spark, sf):
    rows = text_frames(spark, sf).withColumns({"text": F.coalesce("caption", F.lit("")), "confidence": (F.col("frame_id") % 97) / 97.0})
    return R.text_regions(rows)


GAPS = f"""{FT}, d AS (SELECT video_id, max(ts) AS dur FROM ft GROUP BY video_id),
  a AS (SELECT DISTINCT video_id, ts, 1 AS kind FROM ft WHERE frame_id % 6 = 0 UNION ALL SELECT video_id, 0e0, 0 FROM d UNION ALL SELECT video_id, dur, 2 FROM d),
  g AS (SELECT video_id, round(ts - lag(ts) OVER (PARTITION BY video_id ORDER BY kind, ts), 6) AS gap FROM a)"""
MEASURES = "count(*) AS gaps, count(CASE WHEN gap > 2 + 1e-12 THEN 1 END) AS violations, round(max(gap), 6) AS max_gap, round(quantile_cont(gap, 95e-2), 6) AS p95_gap FROM g WHERE gap IS NOT NULL"


def _gaps(spark, sf):
    f = text_frames(spark, sf)
    return R.coverage_gaps(f.where("frame_id % 6 = 0"), f.groupBy("video_id").agg(F.max("ts").alias("duration")))


@query(f"WITH {GAPS} SELECT video_id, {MEASURES} GROUP BY video_id")
def coverage_metrics(spark, sf):
    return R.coverage(_gaps(spark, sf), 2.0)


@query(f"WITH {GAPS} SELECT {MEASURES}")
def corpus_rollup(spark, sf):
    return R.coverage(_gaps(spark, sf), 2.0, by=())


# ten digits: at six, exact ties of the two engines' rounding differ
@query(f"""WITH {FE}, q AS (SELECT video_id, frame_id, CASE WHEN frame_id % 2 = 0 THEN 55e-2 * confidence + 25e-2 * least(1e0, (frame_id % 20) / 12e0) + 2e-1 * least(1e0, (frame_id % 50) / 1000e0 / 3e-2) END AS o, 7e-1 * confidence + 3e-1 * least(1e0, (frame_id % 50) / 100e0 / 2e-1) AS b, CASE WHEN frame_id % 3 = 0 THEN 5e-1 END AS c FROM fe)
  SELECT video_id, frame_id, round(greatest(0e0, least(1e0, (coalesce(25e-2 * o, 0e0) + coalesce(25e-2 * b, 0e0) + coalesce(5e-2 * c, 0e0)) / (CASE WHEN o IS NULL THEN 0e0 ELSE 25e-2 END + CASE WHEN b IS NULL THEN 0e0 ELSE 25e-2 END + CASE WHEN c IS NULL THEN 0e0 ELSE 5e-2 END))), 10) AS importance FROM q""")
def object_importance(spark, sf):
    f, area = event_frames(spark, sf), F.col("frame_id") % 50
    parts = {"ocr": F.when(F.col("frame_id") % 2 == 0, R.ocr_quality(F.col("confidence"), F.col("frame_id") % 20, area / 1000.0)), "objects": R.object_quality(F.col("confidence"), area / 100.0), "caption": F.when(F.col("frame_id") % 3 == 0, 0.5)}
    return f.select("video_id", "frame_id", F.round(R.importance(parts), 10).alias("importance"))


@query(f"""WITH {HITS}, p AS (SELECT video_id, frame_id, sum(CASE modality WHEN 'visual' THEN 6e-1 ELSE 4e-1 END / (60 + rank)) AS total, min(rank) AS best, count(*) AS lists FROM h WHERE modality IN ('visual', 'caption') GROUP BY ALL)
  SELECT video_id, frame_id, round(total / (1e0 / 61), 8) AS score, CAST(best AS INTEGER) AS best_rank, lists FROM p""")
def event_rrf(spark, sf):
    h = _hits(spark, sf)
    return R.event_rrf({"hybrid": (h.where("modality = 'visual'"), 0.6), "dense": (h.where("modality = 'caption'"), 0.4)})


@query(f"WITH {RRF}, r AS (SELECT video_id, frame_id, CAST(row_number() OVER (ORDER BY score DESC, video_id, frame_id) AS INTEGER) AS rank FROM f) SELECT * FROM r WHERE rank <= 100")
def submission_rows(spark, sf):
    return R.answer_rows(U.rrf(_hits(spark, sf)))


@query(f"""WITH {FT}, p AS (SELECT shot_id, frame_id, row_number() OVER (PARTITION BY shot_id ORDER BY ts, frame_id) AS p FROM ft),
  n AS (SELECT a.frame_id AS target, b.frame_id, row_number() OVER (PARTITION BY a.frame_id ORDER BY abs(b.p - a.p), b.p) AS rank FROM p a JOIN p b ON a.shot_id = b.shot_id) SELECT target, frame_id, CAST(rank AS INTEGER) AS rank FROM n WHERE rank <= 3""")
def segment_frame_window(spark, sf):
    f = text_frames(spark, sf)
    return R.frame_window(f, f, 3)


@query("SELECT count(CASE WHEN v.k IS NOT NULL AND l.k IS NOT NULL THEN 1 END) AS both, count(CASE WHEN l.k IS NULL THEN 1 END) AS first_only, count(CASE WHEN v.k IS NULL THEN 1 END) AS second_only FROM (SELECT DISTINCT vec_id AS k FROM embeddings) v FULL JOIN (SELECT DISTINCT doc_id AS k FROM labels) l ON v.k = l.k")
def dense_enrich_check(spark, sf):
    return R.key_mismatch(table(spark, sf, "embeddings").select(F.col("vec_id").alias("k")), table(spark, sf, "labels").select(F.col("doc_id").alias("k")), "k")


@query(f"""WITH {FT}, s AS (SELECT video_id AS query_id, (frame_id % 5) / 4e0 AS r, row_number() OVER (PARTITION BY video_id ORDER BY length(caption), frame_id) AS rank FROM ft),
  m AS (SELECT query_id, {', '.join(f'coalesce(max(CASE WHEN rank <= {k} THEN r END), 0e0) AS a{k}' for k in R.FINAL_SCORE_AT)} FROM s GROUP BY query_id)
  SELECT query_id, {', '.join(f'round(a{k}, 6) AS r_at_{k}' for k in R.FINAL_SCORE_AT)}, round(({' + '.join(f'a{k}' for k in R.FINAL_SCORE_AT)}) / 5, 6) AS final FROM m""")
def trake_final_score(spark, sf):
    order = Window.partitionBy("video_id").orderBy(F.length("caption").asc_nulls_last(), "frame_id")
    return R.final_score(text_frames(spark, sf).select(F.col("video_id").alias("query_id"), ((F.col("frame_id") % 5) / 4.0).alias("r"), F.row_number().over(order).alias("rank")))
