"""All queries of the engine over the stored tables, and the DuckDB SQL each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.functions import vector as V
from lumenframe.operators import evaluation as E
from lumenframe.operators import fusion as U
from lumenframe.operators import lexical as L
from lumenframe.operators import sequences as S
from lumenframe.operators import timeline as T
from lumenframe.operators import vectors as Q
from lumenframe.sources.corpus import event_frames, normalize_frames, table, text_frames

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Query terms that occur in the corpus, stemmed.
TERMS = ["ther", "thou", "onen"]
EVENT_TYPES = 3

FT = "ft AS (SELECT source AS video_id, doc_id AS frame_id, doc_id AS frame_index, CAST(doc_id // 20 AS DOUBLE) AS ts, source || '_' || CAST((doc_id // 20) // 5 AS VARCHAR) AS shot_id, text AS caption, lang AS object FROM documents)"
FE = "fe AS (SELECT user_id AS video_id, event_id AS frame_id, epoch_us(ts) / 1e6 AS ts, epoch_us(ts) AS micros, event_type AS object, least(value / 100, 1e0) AS confidence, CAST(json_extract_string(props, '$.k') AS BIGINT) AS track_id FROM events)"
WORDS = "regexp_extract_all(replace(lower(coalesce({}, '')), 'ß', 'ss'), '[\\p{{L}}\\p{{N}}]+', 0)"
TOKENS = f"""wd AS (SELECT frame_id, {WORDS.format('caption')} AS words FROM ft), tok AS MATERIALIZED (SELECT frame_id, unnest(words) AS token, generate_subscripts(words, 1) AS place, len(words) AS doc_len FROM wd),
  dt AS MATERIALIZED (SELECT DISTINCT token FROM tok), ds AS MATERIALIZED (SELECT token, {X.stem_sql('token', 'regexp_matches')} AS stem FROM dt), st AS (SELECT frame_id, stem, token, place, doc_len FROM tok JOIN ds USING (token))"""
LISTED = "(" + ", ".join(f"'{t}'" for t in TERMS) + ")"
BM25 = f"""{FT}, {TOKENS},
  tf AS (SELECT frame_id, stem, count(*) AS tf, any_value(doc_len) AS doc_len FROM st WHERE stem IN {LISTED} GROUP BY ALL),
  df AS (SELECT stem, count(*) AS df FROM tf GROUP BY stem),
  stats AS (SELECT count(*) AS n, avg(len(words)) AS avg_len FROM wd),
  hits AS (SELECT frame_id, sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 25e-1) / (tf + 15e-1 * (25e-2 + 75e-2 * greatest(doc_len, 1) / greatest(avg_len, 1e0)))) AS bm25, list_sort(list(DISTINCT stem)) AS matched
           FROM tf JOIN df USING (stem), stats GROUP BY frame_id)"""
DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


# --- text -----------------------------------------------------------------------------------------------------------


@query(f"WITH {FT}, {TOKENS} SELECT frame_id, count(*) AS n_tokens, count(DISTINCT token) AS n_distinct, count(DISTINCT stem) AS n_stems FROM st GROUP BY frame_id")
def token_stats(spark, sf):
    docs = text_frames(spark, sf)
    words = X.tokens(F.col("caption"))
    return docs.select("frame_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"), F.size(F.array_distinct(F.transform(F.array_distinct(words), X._stem_column))).cast("long").alias("n_stems")).where("n_tokens > 0")


@query(f"WITH {FT}, {TOKENS}, p AS (SELECT frame_id, stem, count(*) AS tf FROM st GROUP BY ALL) SELECT stem, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, max(tf) AS max_tf FROM p GROUP BY stem")
def stem_postings(spark, sf):
    p = L.postings(text_frames(spark, sf))
    return p.groupBy("stem").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


@query(f"WITH {BM25} SELECT frame_id, round(bm25, 6) AS score FROM hits ORDER BY score DESC, frame_id DESC LIMIT 20")
def bm25_topk(spark, sf):
    hits = L.search(text_frames(spark, sf), TERMS).select("frame_id", F.round("bm25", 6).alias("score"))
    return hits.orderBy(F.desc("score"), F.desc("frame_id")).limit(20)


CONTENT = f"list_transform(list_filter({WORDS.format('caption')}, lambda t: t NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)})), lambda t: {X.stem_sql('t', 'regexp_matches')})"
AGAIN = "(" + ", ".join(f"'{t}'" for t in TERMS) + ")"


@query(f"""WITH {BM25}, c AS (SELECT frame_id, string_agg(stem, ' ' ORDER BY place) AS content FROM st WHERE token NOT IN ({', '.join(repr(w) for w in X.STOPWORDS)}) GROUP BY frame_id),
  q AS (SELECT frame_id, bm25, len(matched) / 3e0 AS coverage, CASE WHEN contains(' ' || coalesce(content, '') || ' ', ' {' '.join(TERMS)} ') THEN 1e0 ELSE 0e0 END AS phrase FROM hits LEFT JOIN c USING (frame_id)),
  r AS (SELECT frame_id, round(coverage, 6) AS coverage, phrase, round(bm25, 6) AS bm25, round(least(1e0, greatest(0e0, 5e-1 * round(bm25 / (bm25 + 1e0), 6) + 4e-1 * coverage + 1e-1 * phrase)), 10) AS quality FROM q)
  SELECT * FROM r ORDER BY quality DESC, bm25 DESC, frame_id DESC LIMIT 20""")
def lexical_quality_topk(spark, sf):
    docs = text_frames(spark, sf)
    rows = L.with_quality(L.search(docs, TERMS), docs, TERMS, digits=10).select("frame_id", F.round("coverage", 6).alias("coverage"), "phrase", F.round("bm25", 6).alias("bm25"), "quality")
    return rows.orderBy(F.desc("quality"), F.desc("bm25"), F.desc("frame_id")).limit(20)


@query(f"WITH {FT}, w AS (SELECT frame_id, {CONTENT} AS c FROM ft) SELECT frame_id, len(c) AS n_content, contains(' ' || array_to_string(c, ' ') || ' ', ' the ') AS has_the, contains(' ' || array_to_string(c, ' ') || ' ', ' thion ther ') AS phrase FROM w")
def phrase_match(spark, sf):
    c = X.stems_of(F.col("caption"), content=True)
    has = lambda p: F.contains(F.concat(F.lit(" "), F.array_join("c", " "), F.lit(" ")), F.lit(f" {p} "))
    return text_frames(spark, sf).select("frame_id", c.alias("c")).select("frame_id", F.size("c").cast("long").alias("n_content"), has("the").alias("has_the"), has("thion ther").alias("phrase"))


# --- records --------------------------------------------------------------------------------------------------------


@query("""SELECT source AS video_id, doc_id AS frame_id, CASE WHEN doc_id % 3 = 0 THEN doc_id END AS frame_index,
  coalesce(CASE WHEN doc_id % 3 = 1 THEN doc_id / 2e0 END, CASE WHEN doc_id % 3 = 0 THEN round(doc_id / CASE WHEN doc_id % 2 = 0 THEN 30e0 ELSE 25e0 END, 6) END) AS timestamp,
  CASE doc_id % 3 WHEN 0 THEN 'video_fps' WHEN 1 THEN 'interval' ELSE 'unknown' END AS timestamp_source,
  CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 1e0 ELSE 9e-1 END WHEN doc_id % 3 = 1 THEN 5e-1 ELSE 0e0 END AS timestamp_confidence,
  coalesce(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE nullif(lang, '') END, source) AS caption, source || '/k.jpg' AS keyframe_path, source || '/k.jpg' AS thumbnail_path FROM documents""")
def frames_normalized(spark, sf):
    d = table(spark, sf, "documents")
    m = F.col("doc_id") % 3
    raw = d.select(F.col("source").alias("video_id"), F.col("doc_id").alias("frame_id"), F.when(m == 0, F.col("doc_id")).alias("frame_index"), F.when(m == 1, F.col("doc_id") / 2).alias("timestamp"), F.when(F.col("doc_id") % 2 == 0, 30.0).alias("fps"),
                   F.when(F.col("doc_id") % 4 == 0, "").otherwise(F.col("lang")).alias("caption"), F.col("source").alias("segment_caption"), F.concat("source", F.lit("/k.jpg")).alias("frame_path"), F.lit("").alias("keyframe_path"))
    return normalize_frames(raw)


@query("SELECT lang AS object, count(*) AS frames, count(DISTINCT source) AS videos FROM documents GROUP BY lang")
def object_histogram(spark, sf):
    return text_frames(spark, sf).groupBy("object").agg(F.count(F.lit(1)).alias("frames"), F.countDistinct("video_id").alias("videos"))


@query("SELECT doc_id AS frame_id, '[CAPTION] ' || text || chr(10) || '[OCR] ' || source || chr(10) || '[OBJECTS] ' || lang || ' | ' || source AS document FROM documents")
def tagged_document(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("frame_id"), F.concat_ws("\n", F.concat(F.lit("[CAPTION] "), "text"), F.concat(F.lit("[OCR] "), "source"), F.concat(F.lit("[OBJECTS] "), F.array_join(F.array_distinct(F.array("lang", "source")), " | "))).alias("document"))


@query("SELECT d.doc_id AS frame_id, e.label, l.quality FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id")
def modality_join(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("frame_id"))
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "label")
    return d.join(e, "frame_id", "left").join(table(spark, sf, "labels").select(F.col("doc_id").alias("frame_id"), "quality"), "frame_id", "left")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_pending(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_selected(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return table(spark, sf, "embeddings").select("vec_id", "label").join(good, "vec_id", "left_semi")


@query("SELECT count(*) AS n, (SELECT count(*) FROM range((SELECT count(*) FROM documents)) t(i) WHERE i NOT IN (SELECT doc_id FROM documents)) AS missing, count(*) FILTER (WHERE doc_id >= (SELECT count(*) FROM documents)) AS extra, count(*) FILTER (WHERE text IS NULL OR text = '') AS empty FROM documents")
def frame_map_validate(spark, sf):
    return E.frame_map_report(table(spark, sf, "documents"), "doc_id", "text")


# --- vectors --------------------------------------------------------------------------------------------------------


def _vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), "embedding", "label")


def _queries(spark, sf, every=50):
    """The stated query set: each row whose id is divisible by 50, against all rows."""
    return _vectors(spark, sf).where(F.col("row") % every == 0).select(F.col("row").alias("query_id"), F.col("embedding").alias("query"))


def _ip(k, extra=""):
    return f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS "row", round({DOT.format('e.embedding', 'q.embedding')}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
      r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "row") AS rank FROM s {extra}) SELECT query_id, "row", score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {k}"""


@query(_ip(20))
def vector_topk(spark, sf):
    return Q.search(_vectors(spark, sf), _queries(spark, sf), 20)


@query(_ip(10))
def vector_topk_batch(spark, sf):
    return Q.search(_vectors(spark, sf), _queries(spark, sf), 10)


@query(_ip(50, "WHERE score >= 2e-1"))
def vector_min_score(spark, sf):
    return Q.search(_vectors(spark, sf), _queries(spark, sf), 50, min_score=0.2)


@query("""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS "row", round(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2e0))), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
  r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, "row") AS rank FROM s) SELECT query_id, "row", score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def vector_l2_topk(spark, sf):
    return Q.search(_vectors(spark, sf), _queries(spark, sf), 10, metric="l2")


@query(f"WITH n AS (SELECT sqrt({DOT.format('embedding', 'embedding')}) AS n FROM embeddings) SELECT round(avg(n), 6) AS mean_norm, round(min(n), 6) AS min_norm, round(max(n), 6) AS max_norm FROM n")
def norm_summary(spark, sf):
    n = V.norm(F.col("embedding"))
    return _vectors(spark, sf).agg(F.round(F.avg(n), 6).alias("mean_norm"), F.round(F.min(n), 6).alias("min_norm"), F.round(F.max(n), 6).alias("max_norm"))


@query(f"WITH n AS (SELECT vec_id, len(embedding) AS d, sqrt({DOT.format('embedding', 'embedding')}) AS n FROM embeddings) SELECT count(*) AS n, count(*) FILTER (WHERE d <> 64) AS bad_dim, count(*) FILTER (WHERE isnan(n)) AS not_finite, count(*) FILTER (WHERE n = 0) AS zero, count(*) FILTER (WHERE abs(n - 1) > 1e-4) AS not_unit, count(*) - count(DISTINCT vec_id) AS repeated FROM n")
def dense_validate(spark, sf):
    return Q.violations(_vectors(spark, sf), 64)


@query(f"""WITH v AS (SELECT vec_id, label, embedding FROM embeddings), m AS (SELECT a.vec_id, max({DOT.format('a.embedding', 'b.embedding')}) AS most FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.vec_id)
  SELECT label, vec_id AS "row", round(CASE WHEN most IS NULL THEN 1e0 ELSE greatest(0e0, least(1e0, (1 - most) / 2)) END, 6) AS novelty FROM v LEFT JOIN m USING (vec_id)""")
def selected_novelty(spark, sf):
    return Q.novelty(_vectors(spark, sf), "label")


# --- fusion ---------------------------------------------------------------------------------------------------------


def _hits(spark, sf):
    """Ranked lists of three modalities over the text frames, made from lengths and ids."""
    f = text_frames(spark, sf).withColumn("len", F.length("caption"))
    lists = [("visual", F.col("frame_id") % 7, F.col("len")), ("caption", F.col("len") % 11, F.col("frame_id")), ("ocr", F.col("frame_id") % 13, -F.col("frame_id"))]
    out = None
    for name, first, second in lists:
        part = f.withColumn("_k", F.row_number().over(Window.orderBy(first, second, "frame_id"))).where("_k <= 60").select(F.lit(name).alias("modality"), F.col("_k").alias("rank"), "frame_id", "video_id", "ts", "shot_id", (1.0 / F.col("_k")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


_LIST = "(SELECT '{0}' AS modality, row_number() OVER (ORDER BY {1}, {2}, frame_id) AS rank, frame_id, video_id, ts, shot_id FROM (SELECT *, length(caption) AS len FROM ft))"
HITS = f"{FT}, h0 AS ({' UNION ALL '.join('SELECT * FROM ' + _LIST.format(*x) for x in (('visual', 'frame_id % 7', 'len'), ('caption', 'len % 11', 'frame_id'), ('ocr', 'frame_id % 13', '-frame_id')))}), h AS (SELECT *, 1e0 / rank AS score FROM h0 WHERE rank <= 60)"
RRF = f"{HITS}, f AS (SELECT frame_id, arg_min(video_id, rank) AS video_id, arg_min(ts, rank) AS ts, arg_min(shot_id, rank) AS shot_id, round(sum(CASE modality WHEN 'visual' THEN 55e-2 WHEN 'caption' THEN 2e-1 ELSE 1e-1 END / (60 + rank)), 10) AS score, min(rank) AS best_rank FROM h GROUP BY frame_id)"


@query(f"WITH {HITS} SELECT frame_id, round(max(score), 6) AS score, count(*) AS n_modalities, round(max(CASE WHEN modality = 'visual' THEN score END), 6) AS visual FROM h GROUP BY frame_id")
def candidate_merge(spark, sf):
    m = U.merge(_hits(spark, sf))
    return m.select("frame_id", "score", F.size("modality_scores").cast("long").alias("n_modalities"), F.round(F.col("modality_scores")["visual"], 6).alias("visual"))


@query(f"WITH {RRF} SELECT frame_id, video_id, ts, score, CAST(best_rank AS INTEGER) AS best_rank FROM f")
def rrf_fusion(spark, sf):
    return U.rrf(_hits(spark, sf)).select("frame_id", "video_id", "ts", "score", "best_rank")


@query(f"""WITH {HITS}, p AS (SELECT frame_id, modality, CASE modality WHEN 'visual' THEN 1e0 ELSE 7e-1 END / (60 + rank) AS part FROM h)
  SELECT frame_id, round(sum(CASE WHEN modality = 'visual' THEN part ELSE 0e0 END), 10) AS original, round(sum(CASE WHEN modality <> 'visual' THEN part ELSE 0e0 END), 10) AS raw_expansion,
  round(sum(CASE WHEN modality = 'visual' THEN part ELSE 0e0 END) + least(sum(CASE WHEN modality <> 'visual' THEN part ELSE 0e0 END), 5e-1 / 61), 10) AS score FROM p GROUP BY frame_id""")
def rrf_variant_cap(spark, sf):
    return U.rrf_variants(_hits(spark, sf).withColumnRenamed("modality", "variant"), {"visual": 1.0, "caption": 0.7, "ocr": 0.7}, "visual", cap=0.5)


@query(f"""WITH {RRF}, r AS (SELECT *, row_number() OVER (PARTITION BY video_id, shot_id ORDER BY score DESC, ts, frame_id) AS r FROM f)
  SELECT video_id, shot_id, round(sum(score * CASE WHEN r = 1 THEN 1e0 WHEN r <= 3 THEN 15e-2 ELSE 0e0 END), 10) AS score, count(*) AS n FROM r GROUP BY ALL ORDER BY score DESC, video_id, shot_id LIMIT 50""")
def clip_aggregate(spark, sf):
    fused = U.rrf(_hits(spark, sf)).join(text_frames(spark, sf).select("frame_id", "shot_id"), "frame_id")
    return U.clips(fused, 50)


@query(f"WITH {RRF}, r AS (SELECT *, row_number() OVER (PARTITION BY shot_id ORDER BY score DESC, frame_id) AS r FROM f) SELECT shot_id, frame_id, score FROM r WHERE r = 1")
def shot_dedupe(spark, sf):
    fused = U.rrf(_hits(spark, sf)).join(text_frames(spark, sf).select("frame_id", "shot_id"), "frame_id")
    return U.first_in(fused, ["shot_id"], F.desc("score"), "frame_id").select("shot_id", "frame_id", "score")


@query(f"""WITH {HITS}, p AS (SELECT frame_id, max(CASE WHEN modality = 'visual' THEN score END) AS v, max(CASE WHEN modality = 'caption' THEN score END) AS c, max(CASE WHEN modality = 'ocr' THEN score END) AS o FROM h GROUP BY frame_id)
  SELECT frame_id, round((55e-2 * (CASE WHEN v IS NULL THEN 0e0 ELSE least(1e0, (v + 1) / 2) END) + 2e-1 * least(1e0, coalesce(c, 0)) + 1e-1 * least(1e0, coalesce(o, 0)) + 5e-2 * 1e0) / (55e-2 + 5e-2 + 2e-1 + 1e-1), 6) AS score FROM p""")
def hybrid_rerank(spark, sf):
    m = F.col("modality_scores")
    rows = U.merge(_hits(spark, sf))
    zero = F.lit(0.0)
    # a candidate without a visual score counts as opposite: cosine -1 maps to 0
    score = U.hybrid_score(F.coalesce(m["visual"], F.lit(-1.0)), {"caption": (F.coalesce(m["caption"], zero), 0.2), "ocr": (F.coalesce(m["ocr"], zero), 0.1)}, F.lit(1.0), 0.55, 0.05)
    return rows.select("frame_id", F.round(score, 6).alias("score"))


@query(f"WITH {HITS} SELECT frame_id, round(least(1e0, max(score) + 3e-2 * (count(DISTINCT modality) - 1)), 6) AS score, count(DISTINCT modality) AS groups FROM h GROUP BY frame_id")
def consensus_boost(spark, sf):
    return U.consensus(_hits(spark, sf).withColumnRenamed("modality", "query_group"))


@query(f"WITH {FT} SELECT shot_id, count(DISTINCT (caption, object)) AS signatures FROM ft GROUP BY shot_id HAVING count(DISTINCT (caption, object)) > 1")
def conflicting_shots(spark, sf):
    return text_frames(spark, sf).groupBy("shot_id").agg(F.countDistinct(F.struct("caption", "object")).alias("signatures")).where("signatures > 1")


@query(f"WITH {HITS}, s AS (SELECT frame_id, list_reverse_sort(list(score)) AS a FROM h GROUP BY frame_id) SELECT frame_id, round(7e-1 * a[1] + (1 - 7e-1) * (list_sum(a[1:2]) / len(a[1:2])), 10) AS score FROM s")
def max_top_mean(spark, sf):
    return _hits(spark, sf).groupBy("frame_id").agg(F.collect_list("score").alias("a")).select("frame_id", F.round(U.max_top_mean(F.col("a"), 0.7, 2), 10).alias("score"))


# --- timeline -------------------------------------------------------------------------------------------------------


@query(f"WITH {FE} SELECT video_id, frame_id, count(*) OVER (PARTITION BY video_id ORDER BY micros RANGE BETWEEN 3600000000 PRECEDING AND 1 PRECEDING) AS n_before, count(*) OVER (PARTITION BY video_id ORDER BY micros RANGE BETWEEN 1 FOLLOWING AND 3600000000 FOLLOWING) AS n_after FROM fe")
def neighbor_counts(spark, sf):
    return T.neighbour_counts(event_frames(spark, sf), 3600)


@query(f"""WITH {FE}, p AS (SELECT a.video_id, a.frame_id, b.frame_id AS other, (b.micros - a.micros) / 1e6 AS d FROM fe a JOIN fe b ON a.video_id = b.video_id AND b.micros <> a.micros AND b.micros BETWEEN a.micros - 3600000000 AND a.micros + 3600000000),
  s AS (SELECT video_id, frame_id, coalesce(string_agg(other::VARCHAR, ',' ORDER BY d, other) FILTER (WHERE d < 0), '') AS before, coalesce(string_agg(other::VARCHAR, ',' ORDER BY d, other) FILTER (WHERE d > 0), '') AS after FROM p GROUP BY ALL)
  SELECT fe.video_id, fe.frame_id, coalesce(before, '') AS before, coalesce(after, '') AS after FROM fe LEFT JOIN s ON s.frame_id = fe.frame_id""")
def neighbor_window(spark, sf):
    n = T.neighbours(event_frames(spark, sf), 3600)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["frame_id"].cast("string")), ",")
    return n.select("video_id", "frame_id", ids("before").alias("before"), ids("after").alias("after"))


@query(f"WITH {FT}, p AS (SELECT a.frame_id, b.frame_id AS other, row_number() OVER (PARTITION BY a.frame_id ORDER BY abs(b.ts - a.ts), b.ts, b.frame_id) AS rank FROM ft a JOIN ft b ON a.shot_id = b.shot_id AND a.frame_id <> b.frame_id) SELECT frame_id, other, CAST(rank AS INTEGER) AS rank FROM p WHERE rank <= 3")
def same_shot_neighbors(spark, sf):
    return T.same_shot(text_frames(spark, sf), 3)


@query(f"WITH {FE} SELECT video_id, CAST(floor(ts / 86400) AS BIGINT) AS segment, min(ts) AS start_time, max(ts) AS end_time, count(*) AS frames, arg_min(frame_id, (ts, frame_id)) AS first_frame, arg_max(frame_id, (ts, frame_id)) AS last_frame FROM fe GROUP BY ALL")
def segments_fixed(spark, sf):
    return T.segments(event_frames(spark, sf), 86400)


@query(f"WITH {FE} SELECT video_id, CAST(floor(ts / 864000) AS BIGINT) AS segment, object, round(max(confidence), 6) AS confidence, min(ts) AS first_seen, max(ts) AS last_seen, count(DISTINCT track_id) AS tracks FROM fe GROUP BY ALL")
def segment_object_agg(spark, sf):
    return T.objects_of(event_frames(spark, sf), 864000)


@query(f"WITH {FE}, g AS (SELECT video_id, ts - lag(ts) OVER (PARTITION BY video_id ORDER BY ts) AS gap FROM (SELECT DISTINCT video_id, ts FROM fe)) SELECT video_id, count(*) AS n, round(max(gap), 6) AS max_gap, round(avg(gap), 6) AS mean_gap, round(quantile_cont(gap, 95e-2), 6) AS p95_gap FROM g WHERE gap IS NOT NULL GROUP BY video_id")
def temporal_gaps(spark, sf):
    return T.gaps(event_frames(spark, sf))


EPISODES = f"""{FE}, b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= 7200 THEN 0 ELSE 1 END AS n FROM fe WINDOW w AS (PARTITION BY video_id, object ORDER BY ts, frame_id)),
  r AS (SELECT *, sum(n) OVER (PARTITION BY video_id, object ORDER BY ts, frame_id ROWS UNBOUNDED PRECEDING) AS episode FROM b),
  e AS (SELECT video_id, object, CAST(episode AS BIGINT) AS episode, min(ts) AS start_time, max(ts) AS end_time, count(*) AS frames FROM r GROUP BY ALL),
  p AS (SELECT *, round(start_time - lag(end_time) OVER (PARTITION BY video_id, object ORDER BY episode), 6) AS pause FROM e)"""


@query(f"WITH {EPISODES} SELECT * FROM p")
def episodes(spark, sf):
    return T.episodes(event_frames(spark, sf), 7200)


@query(f"WITH {EPISODES} SELECT * FROM p WHERE pause IS NULL OR pause >= 864000")
def episode_reappear(spark, sf):
    return T.reappearing(T.episodes(event_frames(spark, sf), 7200), 864000)


@query(f"""WITH {FT}, w AS (SELECT *, list_distinct({WORDS.format('caption')}) AS w FROM ft), l AS (SELECT *, lag(CASE WHEN len(w) > 0 THEN w END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY ts, frame_id) AS p FROM w)
  SELECT video_id, frame_id, round(CASE WHEN p IS NULL THEN 5e-1 WHEN len(w) = 0 THEN 1e0 ELSE 1 - len(list_intersect(w, p)) / CAST(len(list_distinct(list_concat(w, p))) AS DOUBLE) END, 6) AS novelty FROM l""")
def caption_novelty(spark, sf):
    return T.caption_novelty(text_frames(spark, sf))


@query(f"WITH {FE}, m AS (SELECT video_id, median(confidence) AS med FROM fe GROUP BY video_id) SELECT video_id, round(greatest(18e-2, any_value(med) + 25e-1 * median(abs(confidence - med))), 6) AS threshold FROM fe JOIN m USING (video_id) GROUP BY video_id")
def transition_threshold(spark, sf):
    return T.robust_threshold(event_frames(spark, sf).select("video_id", F.col("confidence").alias("value")))


@query(f"WITH {FT} SELECT video_id, frame_id, round(CASE WHEN max(ts) OVER w = min(ts) OVER w THEN 0e0 ELSE (ts - min(ts) OVER w) / (max(ts) OVER w - min(ts) OVER w) END, 6) AS position FROM ft WINDOW w AS (PARTITION BY video_id, shot_id)")
def boundary_consistency(spark, sf):
    return T.boundary_position(text_frames(spark, sf))


@query(f"WITH {FT}, b AS (SELECT video_id, shot_id, CAST(least(3, floor((ts - min(ts) OVER w) / greatest(max(ts) OVER w - min(ts) OVER w, 1e-9) * 4)) AS INTEGER) AS bin FROM ft WINDOW w AS (PARTITION BY video_id, shot_id)) SELECT video_id, shot_id, bin, count(*) AS n FROM b GROUP BY ALL")
def clip_bins(spark, sf):
    return T.bins(text_frames(spark, sf))


SHOTS = f"{FT}, shots AS (SELECT video_id, shot_id, min(frame_id) AS start_frame, max(frame_id) AS end_frame FROM ft GROUP BY ALL)"


def _shots(spark, sf):
    return text_frames(spark, sf).groupBy("video_id", "shot_id").agg(F.min("frame_id").alias("start_frame"), F.max("frame_id").alias("end_frame"))


@query(f"""WITH {SHOTS}, c AS (SELECT video_id, shot_id, unnest(range(start_frame, end_frame + 1, 7)) AS frame, 'interval' AS reason FROM shots UNION ALL SELECT video_id, shot_id, start_frame, 'start' FROM shots UNION ALL SELECT video_id, shot_id, end_frame, 'end' FROM shots)
  SELECT video_id, shot_id, frame, string_agg(DISTINCT reason, ',' ORDER BY reason) AS reasons FROM c GROUP BY ALL""")
def dense_candidates(spark, sf):
    return T.dense_candidates(_shots(spark, sf), 7)


@query(f"WITH {SHOTS}, w AS (SELECT video_id, shot_id, start_frame, end_frame + CASE WHEN start_frame % 3 = 0 THEN 40 ELSE 0 END AS end_frame FROM shots), b AS (SELECT *, max(end_frame) OVER (PARTITION BY video_id ORDER BY start_frame, end_frame, shot_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM w) SELECT video_id, shot_id, start_frame, end_frame FROM b WHERE start_frame <= b")
def shot_overlap_check(spark, sf):
    wide = _shots(spark, sf).withColumn("end_frame", F.col("end_frame") + F.when(F.col("start_frame") % 3 == 0, 40).otherwise(0))
    return T.overlapping(wide)


@query(f"""WITH {FT}, d AS (SELECT * FROM ft WHERE frame_id IN (SELECT vec_id FROM embeddings)), p AS (SELECT a.frame_id AS id, d.frame_id AS nearest, abs(d.ts - a.ts) AS dist, row_number() OVER (PARTITION BY a.frame_id ORDER BY abs(d.ts - a.ts), d.frame_id) AS r FROM ft a JOIN d USING (video_id))
  SELECT id, nearest, round(dist, 6) AS distance FROM p WHERE r = 1""")
def nearest_clip_asof(spark, sf):
    f = text_frames(spark, sf)
    dense = f.join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id")), "frame_id", "left_semi")
    return T.nearest_clip(f.select(F.col("frame_id").alias("id"), "video_id", "ts"), dense)


@query(f"WITH {FT}, h AS (SELECT frame_id, video_id, ts, CAST(hash_ AS BIGINT) AS h FROM (SELECT *, (frame_id * 2654435761) % 65536 AS hash_ FROM ft)), p AS (SELECT b.frame_id, min((a.ts, a.frame_id)) AS m FROM h a JOIN h b ON a.video_id = b.video_id AND a.ts < b.ts AND b.ts - a.ts <= 12 AND bit_count(xor(a.h, b.h)) <= 4 GROUP BY b.frame_id) SELECT frame_id, m[2] AS earliest FROM p")
def phash_band_dups(spark, sf):
    h = text_frames(spark, sf).select("video_id", "frame_id", "ts", ((F.col("frame_id") * 2654435761) % 65536).alias("h"))
    return E.band_duplicates(h, 12.0, 4)


# --- sequences ------------------------------------------------------------------------------------------------------


def _pools(spark, sf, n):
    """The hits of each event of a query: all rows of an event type."""
    f = event_frames(spark, sf)
    kinds = ["click", "view", "purchase", "signup"][:n]
    return [f.where(F.col("object") == k).select("video_id", "frame_id", "ts", F.round("confidence", 6).alias("quality")) for k in kinds]


POOL = f"{FE}, pool AS (SELECT video_id, frame_id, ts, object, round(confidence, 6) AS quality FROM fe)"


@query(f"""WITH {POOL} SELECT a.video_id, a.frame_id AS frame_id1, b.frame_id AS frame_id2, round(greatest(0e0, 65e-2 * least(a.quality, b.quality) + 35e-2 * (a.quality + b.quality) / 2 - least(2e-1, (b.ts - a.ts) / 864000 * 2e-1)), 6) AS score
  FROM pool a JOIN pool b ON a.video_id = b.video_id AND a.object = 'click' AND b.object = 'view' AND b.ts > a.ts AND b.ts - a.ts <= 864000 AND a.frame_id <> b.frame_id""")
def ordered_match_2(spark, sf):
    return S.ordered_matches(_pools(spark, sf, 2), 864000, 864000)


@query(f"""WITH {POOL} SELECT a.video_id, a.frame_id AS frame_id1, b.frame_id AS frame_id2, c.frame_id AS frame_id3, round(greatest(0e0, 65e-2 * least(a.quality, b.quality, c.quality) + 35e-2 * (a.quality + b.quality + c.quality) / 3 - least(2e-1, (c.ts - a.ts) / 864000 * 2e-1)), 6) AS score
  FROM pool a JOIN pool b ON a.video_id = b.video_id AND a.object = 'click' AND b.object = 'view' AND b.ts > a.ts AND b.ts - a.ts <= 864000 JOIN pool c ON c.video_id = b.video_id AND c.object = 'purchase' AND c.ts > b.ts AND c.ts - b.ts <= 864000""")
def ordered_match_3(spark, sf):
    return S.ordered_matches(_pools(spark, sf, 3), 864000, 864000)


def _event_rows(spark, sf):
    a, b, c = _pools(spark, sf, 3)
    rows = a.withColumn("event", F.lit(0)).unionByName(b.withColumn("event", F.lit(1))).unionByName(c.withColumn("event", F.lit(2)))
    return rows.withColumn("shot_id", F.floor(F.col("ts") / 86400))


EVENTS = f"{POOL}, ev AS (SELECT video_id, frame_id, ts, quality, CASE object WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS event, CAST(floor(ts / 86400) AS BIGINT) AS shot_id FROM pool WHERE object IN ('click', 'view', 'purchase'))"
RANKED = f"{EVENTS}, rk AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY quality DESC, frame_id) AS rank, count(*) OVER (PARTITION BY event) AS n FROM ev)"


@query(f"WITH {RANKED} SELECT event, frame_id, CAST(rank AS INTEGER) AS rank, round(1 / (1 + (rank - 1) / greatest(1e0, n / 10e0)), 6) AS normalized, round(1 - (rank - 1) / CAST(n AS DOUBLE), 6) AS percentile FROM rk")
def event_rank_normalize(spark, sf):
    return S.normalized_rank(_event_rows(spark, sf), F.desc("quality"), "frame_id").select("event", "frame_id", "rank", "normalized", "percentile")


@query(f"WITH {RANKED}, a AS (SELECT *, row_number() OVER (PARTITION BY event, video_id, shot_id ORDER BY rank) AS s FROM rk), b AS (SELECT *, row_number() OVER (PARTITION BY event, video_id ORDER BY rank) AS v FROM a WHERE s <= 1) SELECT event, video_id, frame_id FROM b WHERE v <= 3")
def event_diversify(spark, sf):
    return S.diversified(S.normalized_rank(_event_rows(spark, sf), F.desc("quality"), "frame_id"), 1, 3).select("event", "video_id", "frame_id")


CONTEXT = "cx AS (SELECT video_id, round(max(1 - (rank - 1) / CAST(n AS DOUBLE)), 6) AS context FROM rk GROUP BY video_id)"


@query(f"""WITH {RANKED}, {CONTEXT}, b AS (SELECT video_id, event, max(CASE WHEN frame_id % 10 > 0 THEN quality END) AS best FROM ev GROUP BY ALL), p AS (SELECT video_id, round(count(CASE WHEN best >= 15e-2 THEN 1 END) / 3e0, 6) AS coverage, round(sum(coalesce(best, 0e0)) / 3e0, 6) AS support FROM b GROUP BY video_id)
  SELECT p.*, coalesce(CASE WHEN video_id % 3 > 0 THEN context END, 0e0) AS context, round((45e-2 * coverage + 45e-2 * support + 1e-1 * coalesce(CASE WHEN video_id % 3 > 0 THEN context END, 0e0)) / 1e0, 8) AS total FROM p LEFT JOIN cx USING (video_id) ORDER BY coverage DESC, total DESC, support DESC, context DESC, video_id LIMIT 30""")
def video_gating(spark, sf):
    rows = _event_rows(spark, sf)
    return S.gated(rows, 3, context_video_score(spark, sf).where("video_id % 3 > 0"), absolute=F.col("frame_id") % 10 > 0)


@query(f"WITH {RANKED} SELECT video_id, round(max(1 - (rank - 1) / CAST(n AS DOUBLE)), 6) AS context FROM rk GROUP BY video_id")
def context_video_score(spark, sf):
    return S.normalized_rank(_event_rows(spark, sf), F.desc("quality"), "frame_id").groupBy("video_id").agg(F.max("percentile").alias("context"))


def _kbest_step(e: int) -> str:
    """SQL of one step of the beam of alignments."""
    source = "kp WHERE event = 0" if e == 0 else f"k{e - 1} s JOIN kp ON s.video_id = kp.video_id AND kp.event = {e} AND kp.frame > s.frames[-1]"
    here = "kp.video_id, [frame] AS frames, score AS total, shot, 0e0 AS gaps, 0e0 AS place" if e == 0 else "kp.video_id, list_append(s.frames, frame) AS frames, total + score AS total, kp.shot, gaps + ln(1 + frame - s.frames[-1]) AS gaps, place + CASE WHEN frame - s.frames[-1] <= 2 THEN 2e-2 ELSE 0e0 END + CASE WHEN kp.shot = s.shot THEN 1e-2 ELSE 0e0 END AS place"
    return f"k{e} AS MATERIALIZED (SELECT * FROM (SELECT {here} FROM {source}) x QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(total / {e + 1} - least(35e-2, 1e-2 * gaps / {max(1, e)}) - least(4e-1, place), 9) DESC, frames) <= 200)"


KBEST = f"""{EVENTS}, ka AS (SELECT video_id::VARCHAR AS video_id, event, CAST(floor(ts) AS BIGINT) AS frame, max(quality) AS score, arg_max(shot_id, (quality, shot_id::VARCHAR)) AS shot FROM ev GROUP BY ALL),
  l2 AS (SELECT video_id, max(frame) AS f FROM ka WHERE event = 2 GROUP BY 1), l1 AS (SELECT video_id, max(frame) AS f FROM ka JOIN l2 USING (video_id) WHERE event = 1 AND frame < f GROUP BY 1),
  kp AS (SELECT ka.* FROM ka LEFT JOIN l1 USING (video_id) LEFT JOIN l2 USING (video_id) WHERE event = 2 OR event = 1 AND frame < l2.f OR event = 0 AND frame < l1.f), {_kbest_step(0)}, {_kbest_step(1)}, {_kbest_step(2)}"""


@query(f"""WITH {KBEST}, kf AS (SELECT video_id, frames, round(greatest(0e0, 7e-1 * total / 3 + 3e-1 - least(35e-2, 1e-2 * gaps / 2) - least(4e-1, place)), 6) AS score FROM k2)
  SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY score DESC, frames) AS INTEGER) AS rank, array_to_string(frames, ',') AS frames, score FROM kf QUALIFY rank <= 5""")
def kbest_alignment(spark, sf):
    rows = _event_rows(spark, sf).select("video_id", "event", F.floor("ts").cast("long").alias("frame"), F.col("quality").alias("score"), "shot_id")
    return S.kbest(rows, 3, k=5).withColumn("frames", F.array_join(F.transform("frames", lambda f: f.cast("string")), ","))


def _clip_frames(spark, sf):
    return text_frames(spark, sf).join(table(spark, sf, "embeddings").select(F.col("vec_id").alias("frame_id"), "embedding"), "frame_id").select("video_id", "shot_id", F.col("frame_id").alias("row"), "ts", "embedding")


@query()
def cses_select(spark, sf):
    first = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").limit(1).collect()
    return S.select_in_clips(_clip_frames(spark, sf), list(first[0][0]), S.ClipProfile(most=4))


@query()
def cses_select_events(spark, sf):
    first = table(spark, sf, "embeddings").where("vec_id = 0").select("embedding").limit(1).collect()
    events = F.array_compact(F.array(F.when(F.col("row") % 3 == 0, "first"), F.when(F.col("row") % 4 == 0, "second")))
    return S.select_in_clips(_clip_frames(spark, sf).withColumn("events", events), list(first[0][0]), S.ClipProfile(weights=(0.5, 0.3, 0.2), most=6))


# --- evaluation -----------------------------------------------------------------------------------------------------


@query(f"""WITH {SHOTS}, t AS (SELECT video_id, list({{'s': start_frame, 'e': end_frame}} ORDER BY start_frame)[1:4] AS iv FROM shots GROUP BY video_id), p AS (SELECT video_id, list(frame_id ORDER BY frame_id) AS fr FROM ft WHERE frame_id % 100 = CAST(substr(video_id, 4) AS INTEGER) GROUP BY video_id)
  SELECT video_id, round(coalesce(list_sum(list_transform(list_zip(fr[1:4], iv), lambda z: CASE WHEN z[1] >= z[2].s AND z[1] <= z[2].e THEN 1e0 ELSE 0e0 END)), 0e0) / len(iv), 6) AS r FROM p JOIN t USING (video_id)""")
def trake_r_score(spark, sf):
    f = text_frames(spark, sf)
    truth = _shots(spark, sf).groupBy("video_id").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.col("start_frame").alias("s"), F.col("end_frame").alias("e")))), 1, 4).alias("intervals"))
    guess = f.where(F.col("frame_id") % 100 == F.substring("video_id", 4, 9).cast("int")).groupBy("video_id").agg(F.slice(F.sort_array(F.collect_list("frame_id")), 1, 4).alias("frames"))
    return S.r_score(guess.withColumn("id", F.col("video_id")), truth.select(F.col("video_id").alias("id"), F.col("video_id").alias("truth_video"), "intervals")).select("video_id", "r")


@query(_ip(10).replace("SELECT query_id, \"row\", score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10", "") + """, j AS (SELECT r.query_id, r.rank, a.label = b.label AS hit FROM r JOIN embeddings a ON a.vec_id = r."row" JOIN embeddings b ON b.vec_id = r.query_id WHERE rank <= 10 AND rank > 1),
  m AS (SELECT query_id, min(CASE WHEN hit THEN rank END) AS first FROM j GROUP BY query_id)
  SELECT avg(CASE WHEN first <= 2 THEN 1e0 ELSE 0e0 END) AS hit_at_2, avg(CASE WHEN first <= 5 THEN 1e0 ELSE 0e0 END) AS hit_at_5, avg(CASE WHEN first <= 10 THEN 1e0 ELSE 0e0 END) AS hit_at_10 FROM m""")
def hit_at_k(spark, sf):
    got = Q.search(_vectors(spark, sf), _queries(spark, sf), 10).where("rank > 1")
    label = _vectors(spark, sf).select("row", "label")
    hits = got.join(label, "row").join(label.select(F.col("row").alias("query_id"), F.col("label").alias("want")), "query_id").select("query_id", "rank", (F.col("label") == F.col("want")).alias("hit"))
    return E.hit_at(hits, (2, 5, 10))


@query(f"""WITH {FT}, sel AS (SELECT video_id, ts FROM ft WHERE frame_id % 6 = 0), ev AS (SELECT f.frame_id AS event_id, f.video_id, f.ts FROM ft f JOIN labels l ON l.doc_id = f.frame_id WHERE l.quality = 1),
  h AS (SELECT e.video_id, e.event_id, max(CASE WHEN s.ts IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM ev e LEFT JOIN sel s ON s.video_id = e.video_id AND abs(s.ts - e.ts) <= 1 GROUP BY ALL)
  SELECT video_id, count(*) AS events, CAST(sum(hit) AS BIGINT) AS covered, round(avg(hit), 6) AS recall FROM h GROUP BY video_id""")
def manual_event_recall(spark, sf):
    f = text_frames(spark, sf)
    events = f.join(table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("frame_id")), "frame_id", "left_semi").select(F.col("frame_id").alias("event_id"), "video_id", "ts")
    return E.event_recall(events, f.where("frame_id % 6 = 0").select("video_id", "ts"), 1.0)
