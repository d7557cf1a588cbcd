"""Queries of reranking, selection and end-to-end search, added to those of the registry."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import labels as B
from lumenframe.functions import vector as V
from lumenframe.operators import fusion as U
from lumenframe.operators import records as R
from lumenframe.operators import rerank as K
from lumenframe.operators import selection as P
from lumenframe.operators import sequences as S
from lumenframe.operators import vectors as Q
from lumenframe.plans.engine import Engine
from lumenframe.plans.extended import COVERAGE
from lumenframe.plans.registry import DOT, EVENTS, FT, POOL, RRF, TOKENS, _event_rows, _hits, _pools, _queries, _vectors, query
from lumenframe.sources.corpus import event_frames, table, text_frames

# --- records --------------------------------------------------------------------------------------------------------


@query("SELECT doc_id AS frame_id, CASE WHEN doc_id % 3 = 0 THEN concat_ws(' ', source, lang) WHEN doc_id % 3 = 1 AND trim(text) <> '' THEN text ELSE coalesce(lang, '') END AS modality_text FROM documents")
def modality_text(spark, sf):
    m = F.col("doc_id") % 3
    regions = F.when(m == 0, F.array(F.struct(F.col("source").alias("text")), F.struct(F.lit(" ").alias("text")), F.struct(F.col("lang").alias("text"))))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("frame_id"), B.modality_text(F.when(m == 1, F.col("text")).when(m == 0, ""), regions, F.array("lang")).alias("modality_text"))


@query("SELECT doc_id AS frame_id, concat_ws('|', source, lang, CASE WHEN source IS NULL THEN 'x' END) AS labels, concat_ws('|', lang, source) AS classes FROM documents")
def object_labels(spark, sf):
    obj = lambda label, cls: F.struct(label.alias("label"), cls.alias("class_name"))
    objects = F.array(obj(F.lit(""), F.col("source")), obj(F.col("lang"), F.col("source")), obj(F.col("source"), F.lit("x")), obj(F.lit(None).cast("string"), F.lit("")))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("frame_id"), F.array_join(B.labels_of(objects), "|").alias("labels"), F.array_join(B.labels_in(F.concat_ws(",", "lang", F.lit(" "), "source", "lang")), "|").alias("classes"))


@query("SELECT d.doc_id AS frame_id, e.label, l.quality FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id JOIN labels l ON l.doc_id = d.doc_id")
def dense_enrich(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("frame_id"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label")
    return d.join(e, "frame_id").join(table(spark, sf, "labels").select(F.col("doc_id").alias("frame_id"), "quality"), "frame_id")


# --- reranking ------------------------------------------------------------------------------------------------------

FIRST = "q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
DENSE = f"{FT}, {FIRST}, de AS (SELECT ft.*, {DOT.format('embedding', 'q')} AS cosine FROM ft JOIN embeddings ON vec_id = frame_id, q)"


def _dense(spark, sf):
    """Text frames with a vector, and its cosine to the first vector."""
    first = _vectors(spark, sf).where("row = 0").select(F.col("embedding").alias("_q"))  # one row
    rows = text_frames(spark, sf).join(_vectors(spark, sf).select(F.col("row").alias("frame_id"), "embedding"), "frame_id")
    return rows.join(F.broadcast(first)).withColumn("cosine", V.dot(F.col("embedding"), F.col("_q"))).drop("_q")


W = K.SIGNAL_WEIGHTS
WHOLE = "(" + " + ".join(f"{W[n]}::DOUBLE" for n in (*K.DIRECT, *K.CONTEXT)) + ")"


@query(f"""WITH {DENSE}, {TOKENS}, s AS (SELECT frame_id, list(DISTINCT stem) AS s FROM st GROUP BY frame_id),
  g AS (SELECT de.frame_id, (de.frame_id % 11 - 3) / 10e0 AS coarse, (greatest(-1e0, least(1e0, cosine)) + 1) / 2 AS dense, round(coalesce({' + '.join(f"CASE WHEN list_contains(s, '{t}') THEN {w}::DOUBLE ELSE 0e0 END" for t, w in COVERAGE.items())}, 0e0) / {sum(COVERAGE.values())}::DOUBLE, 6) AS caption,
    (de.frame_id % 7) / 7e0 AS ocr, (de.frame_id % 3) / 2e0 AS objects, 1e0 / (2 + de.frame_id % 5) AS gain, (de.frame_id % 4) / 3e0 AS temporal, (de.frame_id % 13) / 13e0 AS neighbor, (de.frame_id % 17) / 17e0 AS segment FROM de LEFT JOIN s USING (frame_id)),
  e AS (SELECT max(abs(coarse)) AS scale, min(coarse) AS low, max(gain) AS most FROM g),
  p AS (SELECT *, CASE WHEN low < 0 THEN (coarse / scale + 1) / 2 ELSE coarse / scale END AS c, least(8e-2, {W['neighbor_support']}::DOUBLE * neighbor / {WHOLE} + {W['segment_support']}::DOUBLE * segment / {WHOLE}) AS bonus FROM g, e)
  SELECT frame_id, round(bonus, 8) AS context_bonus, round(({' + '.join(f"{W[n]}::DOUBLE * {x} / {WHOLE}" for n, x in zip(K.DIRECT, ('c', 'dense', 'caption', 'ocr', 'objects', '(gain / most)', 'temporal', 'greatest(caption, ocr)'), strict=True))}) + bonus, 8) AS score FROM p""")
def deterministic_rerank(spark, sf):
    n = F.col("frame_id")
    rows = R.with_term_coverage(_dense(spark, sf), COVERAGE).select(
        "frame_id", ((n % 11 - 3) / 10.0).alias("coarse_rrf"), ((F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "cosine")) + 1) / 2).alias("dense_visual"), F.col("coverage").alias("caption"), (n % 7 / 7.0).alias("ocr"), (n % 3 / 2.0).alias("objects"),
        (1.0 / (2 + n % 5)).alias("cses_gain"), (n % 4 / 3.0).alias("temporal_consistency"), F.greatest("coverage", n % 7 / 7.0).alias("modality_alignment"), (n % 13 / 13.0).alias("neighbor_support"), (n % 17 / 17.0).alias("segment_support"),
    )
    return K.weighted_signals(rows, context=K.CONTEXT).select("frame_id", "context_bonus", "score")


@query(f"WITH {RRF}, s AS (SELECT frame_id, score, (frame_id % 7) / 7e0 AS c FROM f) SELECT frame_id, CASE WHEN max(c) OVER () >= 2e-1 THEN round(85e-2 * score + 15e-2 * c, 8) ELSE score END AS score FROM s")
def constraint_rerank(spark, sf):
    rows = U.rrf(_hits(spark, sf)).withColumn("constraint", F.col("frame_id") % 7 / 7.0)
    return K.constrained(rows).select("frame_id", "score")


@query(f"WITH {RRF}, r AS (SELECT frame_id, score, row_number() OVER (ORDER BY score DESC, frame_id) AS rank FROM f) SELECT frame_id, CASE WHEN rank <= 20 AND frame_id % 3 <> 0 THEN round(5e-1 * score + 5e-1 * ((frame_id % 9) / 9e0), 8) ELSE score END AS score FROM r")
def model_score_blend(spark, sf):
    rows = U.rrf(_hits(spark, sf)).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "frame_id")))  # the fused pool, 180 rows at most
    return K.model_blend(rows.withColumn("model_score", F.when(F.col("frame_id") % 3 != 0, F.col("frame_id") % 9 / 9.0)), pool=20).select("frame_id", "score")


@query(f"""WITH {RRF}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY score DESC, ts, frame_id) AS r FROM f), c AS (SELECT video_id, shot_id, round(sum(score * CASE WHEN r = 1 THEN 1e0 WHEN r <= 3 THEN 15e-2 ELSE 0e0 END), 10) AS score FROM k GROUP BY ALL),
  co AS (SELECT *, row_number() OVER (ORDER BY score DESC, video_id, shot_id) AS position FROM c QUALIFY position <= 15), {FIRST},
  v AS (SELECT vec_id, round({DOT.format('embedding', 'q')}, 6) AS s FROM embeddings, q), dr AS (SELECT *, row_number() OVER (ORDER BY s DESC, vec_id) AS rank FROM v QUALIFY rank <= 300),
  n AS (SELECT video_id, shot_id, min(rank) AS position FROM dr JOIN ft ON frame_id = vec_id GROUP BY ALL), nw AS (SELECT * FROM n WHERE (video_id, shot_id) NOT IN (SELECT (video_id, shot_id) FROM co) ORDER BY position, video_id, shot_id LIMIT 10)
  SELECT video_id, shot_id, position, false AS rescued FROM co UNION ALL SELECT video_id, shot_id, position, true FROM nw""")
def dense_rescue_clips(spark, sf):
    fused = U.rrf(_hits(spark, sf)).join(text_frames(spark, sf).select("frame_id", "shot_id"), "frame_id")
    coarse = U.clips(fused, 15).withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "video_id", "shot_id")))
    found = Q.search(_vectors(spark, sf), _queries(spark, sf).where("query_id = 0"), 300).select(F.col("row").alias("frame_id"), "rank")
    return K.rescued_clips(coarse, found.join(text_frames(spark, sf).select("frame_id", "video_id", "shot_id"), "frame_id"))


@query(f"WITH {DENSE}, r AS (SELECT video_id, shot_id, frame_id AS \"row\", round(cosine, 6) AS score, CAST(row_number() OVER (PARTITION BY video_id, shot_id ORDER BY round(cosine, 6) DESC, ts, frame_id) AS INTEGER) AS rank FROM de) SELECT * FROM r WHERE rank <= 2")
def topn_per_clip(spark, sf):
    rows = _dense(spark, sf).select("video_id", "shot_id", F.col("frame_id").alias("row"), "ts", F.round("cosine", 6).alias("score"))
    return K.top_in_clip(rows, 2).drop("ts")


# --- sequences and selection ----------------------------------------------------------------------------------------


@query(f"""WITH {POOL} SELECT a.video_id, a.frame_id AS frame_id1, b.frame_id AS frame_id2, round(greatest(0e0, 65e-2 * least(a.quality, b.quality) + 35e-2 * ((a.quality + b.quality) / 2) - least(2e-1, (b.ts - a.ts) / 1e-7 * 2e-1)), 9) AS score
  FROM pool a JOIN pool b ON a.video_id = b.video_id AND a.object = 'click' AND b.object = 'view' AND b.ts > a.ts""")
def ordered_match_relaxed(spark, sf):
    """No two events lie within a tenth of a microsecond, so the strict mode finds nothing and the gap limit is
    lifted. Nine digits, as the constant penalty leaves exact ties at six."""
    return S.match_with_fallback(_pools(spark, sf, 2), 1e-7, digits=9)[1]


@query()
def chain_dp(spark, sf):
    rows = _event_rows(spark, sf).withColumn("candidate_id", F.format_string("%012d", "frame_id"))
    relevance = F.array(*[F.when(F.col("event") == e, F.col("quality")).otherwise(0.0) for e in range(3)])
    return S.chain_scores(rows.select(F.col("video_id").cast("string").alias("video_id"), "candidate_id", "ts", relevance.alias("relevance")), 864000.0)


PATHS = f"""{EVENTS}, pa AS (SELECT a.video_id, CAST(a.frame_id % 4 AS VARCHAR) AS path_id, [a.frame_id, b.frame_id] AS frames, round((a.quality + b.quality) / 2, 6) AS score FROM ev a JOIN ev b ON a.video_id = b.video_id AND a.event = 0 AND b.event = 1)"""


@query(f"""WITH {PATHS}, d AS (SELECT * FROM pa WHERE frames[1] < frames[2] QUALIFY row_number() OVER (PARTITION BY video_id, frames ORDER BY score DESC, path_id) = 1),
  p AS (SELECT *, row_number() OVER (PARTITION BY video_id, path_id ORDER BY score DESC, frames) <= 3 AS ok FROM d), v AS (SELECT *, row_number() OVER (PARTITION BY video_id, ok ORDER BY score DESC, frames, path_id) AS n FROM p),
  o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN ok AND n <= 14 THEN 1 ELSE 2 END, score DESC, frames, video_id, path_id) AS rank FROM v) SELECT CAST(rank AS INTEGER) AS rank, video_id, path_id, array_to_string(frames, ',') AS frames, score FROM o WHERE rank <= 40""")
def sequence_ranking(spark, sf):
    rows = _event_rows(spark, sf)
    part = lambda e: rows.where(F.col("event") == e).select("video_id", F.col("frame_id").alias(f"f{e}"), F.col("quality").alias(f"q{e}"))
    paths = part(0).join(part(1), "video_id").select("video_id", (F.col("f0") % 4).cast("string").alias("path_id"), F.array("f0", "f1").alias("frames"), F.round((F.col("q0") + F.col("q1")) / 2, 6).alias("score"))
    return K.ranked_sequences(paths, 2, 40).withColumn("frames", F.array_join(F.transform("frames", lambda f: f.cast("string")), ","))


@query()
def sequence_nms(spark, sf):
    rows = _event_rows(spark, sf)
    paths = S.kbest(rows.select(F.col("video_id").cast("string").alias("video_id"), "event", F.col("ts").cast("long").alias("frame"), F.col("quality").alias("score")), 3, k=20)
    return K.ranked_sequences(paths.select("video_id", F.col("rank").cast("string").alias("path_id"), "frames", "score"), 3, radius=3600)


@query()
def caption_near_dedupe(spark, sf):
    return P.captions_without_near_repeats(text_frames(spark, sf).withColumn("caption", F.coalesce("caption", F.lit(""))))


@query()
def transition_nms(spark, sf):
    return P.strongest(event_frames(spark, sf).withColumnRenamed("confidence", "strength"), 600.0)


@query()
def hash_distinct_frames(spark, sf):
    return P.distinct_frames(text_frames(spark, sf).withColumn("hash", F.xxhash64(F.coalesce("caption", F.lit("")))))


def _candidates(spark, sf):
    rows, n = _dense(spark, sf), F.col("frame_id")
    span = rows.groupBy("video_id").agg(F.max("ts").alias("duration"))
    events = F.array_compact(F.array(F.when(n % 9 == 0, F.concat(F.lit("o"), (n % 4).cast("string"))), F.when(n % 10 == 0, F.concat(F.lit("t"), (n % 3).cast("string")))))
    return rows.join(span, "video_id").select("video_id", F.format_string("%012d", n).alias("candidate_id"), "ts", n.alias("frame"), (n % 11 / 11.0).alias("importance"), F.when(n % 5 == 0, F.col("shot_id")).alias("duplicate_group"), "embedding", events.alias("event_ids"), "duration")


@query()
def keyframe_select(spark, sf):
    return P.select_keyframes(_candidates(spark, sf), max_gap=4.0, density=0.25)


@query()
def keyframe_select_dedupe(spark, sf):
    return P.select_keyframes(_candidates(spark, sf), max_gap=4.0, density=0.25, dedupe=True)


# --- end to end -----------------------------------------------------------------------------------------------------


def _engine(spark, sf):
    return Engine(text_frames(spark, sf), _vectors(spark, sf).select("row", "embedding"))


def _first_vector(spark, sf):
    return _vectors(spark, sf).where("row = 0").select("embedding").first()[0]


@query()
def kis_search(spark, sf):
    return _engine(spark, sf).search("ther thou onen", "kis", vector=_first_vector(spark, sf))


@query()
def avs_search(spark, sf):
    return _engine(spark, sf).search("ther thou onen", "avs", top_k=50, vector=_first_vector(spark, sf))


@query()
def qa_evidence(spark, sf):
    return _engine(spark, sf).search("ther thou onen", "qa", vector=_first_vector(spark, sf), constraints={"actions": ["ther thou"], "subject": ["onen"]})


@query()
def trake_search(spark, sf):
    return _engine(spark, sf).search("1. ther thou 2. onen 3. thou", "trake")
