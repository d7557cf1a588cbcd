"""Queries of the stored text index, local refinement, regions and per-video reports, added to those of the registry, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.operators import context as C
from lumenframe.operators import lexical as L
from lumenframe.operators import records as R
from lumenframe.operators import refine as N
from lumenframe.operators import regions as G
from lumenframe.operators import sequences as S
from lumenframe.plans.extended import COVERAGE
from lumenframe.plans.registry import BM25, FE, FT, LISTED, ORACLE_SQL, POOL, TERMS, TOKENS, _pools, query
from lumenframe.sources import files, textindex
from lumenframe.sources.corpus import event_frames, table, text_frames


def _index(spark, sf) -> str:
    """The path of an index of all frames, written in two segments."""
    path, f = f"{files.shared_dir(spark).rstrip('/')}/textindex/{uuid.uuid4().hex}", text_frames(spark, sf)
    textindex.publish(f.where("frame_id % 2 = 0"), path)
    textindex.publish(f.where("frame_id % 2 <> 0"), path, add=True)
    return path


@query(ORACLE_SQL["bm25_topk"])
def stored_bm25_topk(spark, sf):
    hits = textindex.search(spark, _index(spark, sf), TERMS).select("frame_id", F.round("bm25", 6).alias("score"))
    return hits.orderBy(F.desc("score"), F.desc("frame_id")).limit(20)


@query(ORACLE_SQL["stem_postings"])
def stored_stem_postings(spark, sf):
    return textindex.postings(spark, _index(spark, sf)).groupBy("stem").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


BOUNDARIES = ("peak", "first_transition", "first_leave", "first_contact", "state")
CROSSES = "score >= low + 55e-2 * span AND (b IS NULL OR b < low + 55e-2 * span) AND held >= low + 55e-2 * span AND p + 1 <= n AND (mv IS NULL OR (mv > 1e-6 AND coalesce(motion, 0) >= 35e-2 * mv))"


#: From s (window_id, frame, score, motion, boundary, coarse) to the hypotheses of each window.
HYPOTHESES = f"""  r AS (SELECT *, min(score) OVER a AS low, max(score) OVER a - min(score) OVER a AS span, count(*) OVER a AS n, row_number() OVER o AS p, lag(score) OVER o AS b, lead(score) OVER o AS f, min(score) OVER (PARTITION BY window_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS held, max(motion) OVER a AS mv
    FROM s WINDOW a AS (PARTITION BY window_id), o AS (PARTITION BY window_id ORDER BY frame)),
  c AS (SELECT *, coalesce(coarse, max(CASE WHEN p = n // 2 + 1 THEN frame END) OVER (PARTITION BY window_id)) AS center, min(CASE WHEN {CROSSES} THEN frame END) OVER (PARTITION BY window_id) AS fst, first_value(frame) OVER (PARTITION BY window_id ORDER BY score DESC, frame) AS best,
    span <= 1e-12 AS flat, boundary LIKE 'first%' AS starts FROM r),
  d AS (SELECT *, NOT flat AND starts AND fst IS NULL AND mv IS NOT NULL AS lost FROM c),
  e AS (SELECT *, row_number() OVER (PARTITION BY window_id ORDER BY CASE WHEN flat OR lost THEN abs(frame - center) WHEN starts THEN abs(frame - coalesce(fst, best)) ELSE -score END, CASE WHEN flat OR lost THEN 0e0 WHEN starts THEN -score ELSE abs(frame - center) END, frame) AS rank
    FROM d WHERE flat OR boundary <> 'peak' OR ((b IS NULL OR score >= b) AND (f IS NULL OR score >= f)))
  SELECT window_id, rank, frame, round(score, 6) AS score, CASE WHEN flat THEN 'flat_local_score_fallback' WHEN lost THEN 'insufficient_temporal_signal_fallback' WHEN boundary = 'peak' THEN 'local_peak' WHEN boundary = 'first_leave' THEN 'first_fully_left_state' WHEN starts THEN 'first_positive_transition' ELSE 'semantic_top_score' END AS strategy,
    CASE WHEN flat OR lost THEN 0e0 ELSE round((score - low) / span, 6) END AS confidence, CASE WHEN lost OR (flat AND coarse = frame) THEN 'canonical_metadata' ELSE 'local_refinement' END AS source, CASE WHEN flat THEN 'flat_local_score_fallback' WHEN lost THEN 'insufficient_temporal_boundary_signal' END AS warning
  FROM e WHERE rank <= 5 AND (rank = 1 OR NOT (flat OR lost))"""
NAMED = f"list_extract({list(BOUNDARIES)}, CAST({{}} AS INTEGER) + 1)"


@query(f"""WITH {FE}, s AS (SELECT video_id AS window_id, frame_id AS frame, confidence AS score, {NAMED.format('video_id % 5')} AS boundary, CASE WHEN video_id % 4 > 0 THEN min(frame_id) OVER (PARTITION BY video_id) + 100 END AS coarse,
    CASE WHEN video_id % 3 > 0 THEN abs(confidence - coalesce(lag(confidence) OVER (PARTITION BY video_id ORDER BY frame_id), confidence)) END AS motion FROM fe),
{HYPOTHESES}""")
def local_hypotheses(spark, sf):
    from pyspark.sql import Window

    f = event_frames(spark, sf)
    v, by = F.col("video_id"), Window.partitionBy("video_id").orderBy("frame_id")
    motion = F.when(v % 3 > 0, F.abs(F.col("confidence") - F.coalesce(F.lag("confidence").over(by), F.col("confidence"))))
    scores = f.select(v.alias("window_id"), F.col("frame_id").alias("frame"), F.col("confidence").alias("score"), motion.alias("motion"))
    named = F.element_at(F.array(*[F.lit(b) for b in BOUNDARIES]), (v % 5).cast("int") + 1)
    windows = f.groupBy("video_id").agg(F.min("frame_id").alias("_f")).select(v.alias("window_id"), named.alias("boundary"), F.when(v % 4 > 0, F.col("_f") + 100).alias("coarse"))
    return N.local_hypotheses(scores, windows, 5)


UNIT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE))) / sqrt(list_sum(list_transform({0}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform({1}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
#: Each frame that is a coarse hit has a window of two seconds around it, and asks for the vector of the row with its event's number.
WINDOWED = f"""v AS (SELECT label AS video_id, vec_id AS frame, vec_id / 2e1 AS ts, embedding AS em FROM embeddings), w AS (SELECT frame AS window_id, video_id, frame % 7 AS event, ts - 1 AS low, ts + 1 AS high, frame AS coarse FROM v WHERE frame % 3 = 0),
  q AS (SELECT frame AS event, em AS qe FROM v WHERE frame < 7), j AS (SELECT window_id, v.frame, {UNIT.format('em', 'qe')} AS c, em, coarse FROM w JOIN v ON v.video_id = w.video_id AND v.ts BETWEEN low AND high JOIN q USING (event)),
  k AS (SELECT *, lag(em) OVER (PARTITION BY window_id ORDER BY frame) AS pe FROM j),
  s AS (SELECT window_id, frame, least(1e0, greatest(0e0, (c + 1) / 2)) AS score, CASE WHEN pe IS NULL THEN 0e0 ELSE least(1e0, greatest(0e0, 1 - {UNIT.format('em', 'pe')})) END AS motion, {NAMED.format('window_id % 5')} AS boundary, coarse FROM k)"""


def _windows(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("video_id"), F.col("vec_id").alias("frame"), (F.col("vec_id") / 20.0).alias("ts"), "embedding")
    k, t = F.col("frame"), F.col("ts")
    named = F.element_at(F.array(*[F.lit(b) for b in BOUNDARIES]), (k % 5).cast("int") + 1)
    windows = e.where(k % 3 == 0).select(k.alias("window_id"), "video_id", (k % 7).alias("event"), (t - 1).alias("low"), (t + 1).alias("high"), k.alias("coarse"), named.alias("boundary"))
    return windows, N.local_scores(windows, e, e.where(k < 7).select(k.alias("event"), F.col("embedding").alias("query")), 2.0)


@query(f"WITH {WINDOWED} SELECT window_id, frame, round(score, 6) AS score, round(motion, 6) AS motion FROM s")
def local_scores(spark, sf):
    return _windows(spark, sf)[1].select("window_id", "frame", F.round("score", 6).alias("score"), F.round("motion", 6).alias("motion"))


@query(f"WITH {WINDOWED}, {HYPOTHESES}")
def local_refinement(spark, sf):
    windows, scores = _windows(spark, sf)
    return N.local_hypotheses(scores, windows.select("window_id", "boundary", "coarse"), 5)


def _step(k: int) -> str:
    """SQL of a step of the beam of refined paths."""
    source = "c WHERE event = 0" if k == 0 else f"s{k - 1} s JOIN c USING (path_id) WHERE c.event = {k} AND c.frame > s.frames[-1]"
    frames, total = ("[frame]", "confidence") if k == 0 else ("list_append(s.frames, c.frame)", "s.total + c.confidence")
    return f"s{k} AS MATERIALIZED (SELECT path_id, frames, total FROM (SELECT path_id, {frames} AS frames, {total} AS total FROM {source}) x JOIN w USING (path_id) QUALIFY row_number() OVER (PARTITION BY path_id ORDER BY total / {k + 1} DESC, frames) <= any_value(width) OVER (PARTITION BY path_id))"


@query(f"""WITH {FE}, c AS (SELECT video_id AS path_id, CASE object WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS event, frame_id AS frame, round(confidence, 6) AS confidence FROM fe WHERE object IN ('click', 'view', 'purchase')),
  w AS (SELECT path_id, least(100, 3 * max(n)) AS width FROM (SELECT path_id, event, count(*) AS n FROM c GROUP BY ALL) GROUP BY 1), {_step(0)}, {_step(1)}, {_step(2)}
  SELECT path_id, array_to_string(frames, ',') AS frames, round(85e-2 * ((path_id % 100) / 1e2) + 15e-2 * total / 3, 6) AS score FROM s2""")
def refined_paths(spark, sf):
    f = event_frames(spark, sf).where("object IN ('click', 'view', 'purchase')")
    event = F.when(F.col("object") == "click", 0).when(F.col("object") == "view", 1).otherwise(2)
    choices = f.select(F.col("video_id").alias("path_id"), event.alias("event"), F.col("frame_id").alias("frame"), F.round("confidence", 6).alias("confidence"))
    paths = f.select(F.col("video_id").alias("path_id"), (F.col("video_id") % 100 / 100.0).alias("score")).distinct()
    return N.refined_paths(paths, choices, 3).withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ","))


@query(f"""WITH {POOL}, a AS (SELECT a.video_id, a.frame_id AS f1, b.frame_id AS f2, a.ts AS t1, b.ts AS t2, a.quality AS q1, b.quality AS q2 FROM pool a JOIN pool b ON a.video_id = b.video_id AND a.object = 'click' AND b.object = 'view' AND b.ts > a.ts AND b.ts - a.ts <= 864000
    QUALIFY row_number() OVER (PARTITION BY a.video_id, a.frame_id ORDER BY (a.quality + b.quality) / 2 DESC, b.ts - a.ts, concat_ws('|', a.frame_id, b.frame_id) DESC) <= 4),
  b AS (SELECT a.*, c.frame_id AS f3, c.ts AS t3, c.quality AS q3 FROM a JOIN pool c ON c.video_id = a.video_id AND c.object = 'purchase' AND c.ts > t2 AND c.ts - t2 <= 864000
    QUALIFY row_number() OVER (PARTITION BY a.video_id, f1 ORDER BY (q1 + q2 + c.quality) / 3 DESC, c.ts - t1, concat_ws('|', f1, f2, c.frame_id) DESC) <= 4)
  SELECT video_id, f1 AS frame_id1, f2 AS frame_id2, f3 AS frame_id3, round(greatest(0e0, 65e-2 * least(q1, q2, q3) + 35e-2 * (q1 + q2 + q3) / 3 - least(2e-1, (t3 - t1) / 864000 * 2e-1)), 6) AS score FROM b""")
def ordered_match_beam(spark, sf):
    return S.ordered_matches(_pools(spark, sf, 3), 864000, 864000, beam=4)


@query(rf"""WITH r AS (SELECT doc_id AS frame_id, trim(regexp_replace(regexp_replace(nfc_normalize(text), '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', '', 'g'), '[\s\p{{Z}}]+', ' ', 'g')) AS t, CASE WHEN doc_id % 7 = 0 THEN lang WHEN doc_id % 7 = 1 THEN '' END AS lang FROM documents WHERE doc_id % 10 >= 5)
  SELECT frame_id, md5(t) AS text_md5, md5(strip_accents(translate(t, 'đĐ', 'dD'))) AS plain_md5, coalesce(nullif(lang, ''), CASE WHEN regexp_matches(t, '[{G.VIETNAMESE}]') OR strip_accents(t) <> t THEN 'vi' WHEN regexp_matches(t, '[A-Za-z]') THEN 'en' END) AS language FROM r WHERE t <> ''""")
def text_regions(spark, sf):
    d, n = table(spark, sf, "documents"), F.col("doc_id")
    regions = d.select(n.alias("frame_id"), "text", (n % 10 / 10.0).alias("confidence"), F.when(n % 7 == 0, F.col("lang")).when(n % 7 == 1, "").alias("language"))
    return G.text_regions(regions, 0.5).select("frame_id", F.md5("text").alias("text_md5"), F.md5("unaccented_text").alias("plain_md5"), "language")


@query("""WITH p AS (SELECT p_partkey AS frame_id, CAST(p_partkey % 300 - 20 AS DOUBLE) AS a, CAST(p_size * 3 - 10 AS DOUBLE) AS b, CASE WHEN p_partkey % 9 > 0 THEN 2e2 END AS w, 12e1 AS h FROM part),
  q AS (SELECT frame_id, w, h, [a, a + 60, a + 30] AS xs, [b, b + 5, b + 40] AS ys, a, b FROM p), r AS (SELECT *, list_transform(xs, lambda x: least(w, greatest(0e0, x))) AS cx, list_transform(ys, lambda y: least(h, greatest(0e0, y))) AS cy FROM q)
  SELECT frame_id, CASE WHEN w IS NOT NULL THEN round((list_max(cx) - list_min(cx)) * (list_max(cy) - list_min(cy)) / (w * h), 9) END AS area, CASE WHEN w IS NOT NULL THEN round((list_max(cx) + list_min(cx)) / 2 / w, 9) END AS x, CASE WHEN w IS NOT NULL THEN round((list_max(cy) + list_min(cy)) / 2 / h, 9) END AS y,
    CASE WHEN w IS NOT NULL THEN round(greatest(0e0, least(w, greatest(0e0, a + 50)) - least(w, greatest(0e0, a))) * greatest(0e0, least(h, greatest(0e0, b + 70)) - least(h, greatest(0e0, b))) / (w * h), 9) END AS box FROM r""")
def region_geometry(spark, sf):
    k, s = F.col("p_partkey"), F.col("p_size")
    a, b = (k % 300 - 20).cast("double"), (s * 3 - 10).cast("double")
    w, h = F.when(k % 9 > 0, F.lit(200.0)), F.lit(120.0)
    shape = G.polygon_geometry(F.array(F.array(a, b), F.array(a + 60, b + 5), F.array(a + 30, b + 40)), w, h)
    rows = table(spark, sf, "part").select(k.alias("frame_id"), shape.alias("s"), G.box_area(F.array(a, b, a + 50, b + 70), w, h).alias("box"))
    return rows.select("frame_id", *[F.round(f"s.{c}", 9).alias(c) for c in ("area", "x", "y")], F.round("box", 9).alias("box"))


@query(f"WITH {BM25} SELECT frame_id, round(bm25 / max(bm25) OVER (), 6) AS score FROM hits")
def score_by_largest(spark, sf):
    return G.by_largest(L.search(text_frames(spark, sf), TERMS).select("frame_id", F.col("bm25").alias("score")), "score", 6)


@query("SELECT doc_id AS frame_id, array_to_string(list_sort(list_filter([CASE WHEN doc_id % 3 <> 0 THEN 'ocr' END, CASE WHEN doc_id % 2 <> 0 THEN 'object' END, CASE WHEN doc_id % 5 <> 0 THEN 'caption' END], lambda x: x IS NOT NULL)), ',') AS sources FROM documents")
def source_modalities(spark, sf):
    n = F.col("doc_id")
    scores = F.create_map(*[x for name, c in (("ocr", n % 3), ("object", n % 2), ("caption", n % 5), ("rrf", F.lit(1))) for x in (F.lit(name), c.cast("double"))])
    return table(spark, sf, "documents").select(n.alias("frame_id"), F.array_join(G.source_modalities(scores), ",").alias("sources"))


@query(r"SELECT event_id AS frame_id, CAST(json_extract_string(nullif(regexp_extract(CASE WHEN event_id % 10 > 0 THEN 'Answer: ' || props || E'\nDone.' ELSE 'none' END, '\{.*\}', 0, 's'), ''), '$.k') AS BIGINT) AS k FROM events")
def outer_json(spark, sf):
    said = F.when(F.col("event_id") % 10 > 0, F.concat(F.lit("Answer: "), "props", F.lit("\nDone."))).otherwise("none")
    return table(spark, sf, "events").select(F.col("event_id").alias("frame_id"), F.get_json_object(G.outer_object(said), "$.k").cast("long").alias("k"))


WEIGHED = " + ".join(f"CASE WHEN list_contains(s, '{t}') THEN {w}::DOUBLE ELSE 0e0 END" for t, w in COVERAGE.items())


@query(f"WITH {FT}, {TOKENS}, s AS (SELECT frame_id, list(DISTINCT stem) AS s FROM st GROUP BY frame_id), n AS (SELECT *, len(list_filter(s, lambda x: x IN {LISTED})) AS hit FROM s) SELECT frame_id, round(8e-1 * round(({WEIGHED}) / {sum(COVERAGE.values())}::DOUBLE, 6) + 2e-1 * hit / ({len(TERMS)} + len(s) - hit), 6) AS score FROM n WHERE hit > 0")
def metadata_match(spark, sf):
    terms = F.array(*[F.lit(t) for t in TERMS])
    rows = R.with_term_coverage(text_frames(spark, sf), COVERAGE).withColumn("own", F.array_distinct(X.stems_of(F.col("caption"))))
    return rows.where(F.arrays_overlap("own", terms)).select("frame_id", F.round(0.8 * F.col("coverage") + 0.2 * X.jaccard(terms, F.col("own")), 6).alias("score"))


@query(f"""WITH {FT}, d AS (SELECT video_id, max(ts) + 1 AS duration FROM ft GROUP BY 1), s AS (SELECT video_id, shot_id, count(*) AS n, count(CASE WHEN frame_id % 4 = 0 THEN 1 END) AS k, count(CASE WHEN frame_id % 8 = 0 THEN 1 END) AS p FROM ft GROUP BY ALL),
  o AS (SELECT video_id, CAST(sum(n) AS BIGINT) AS candidate_count, CAST(sum(k) AS BIGINT) AS selected_count, CAST(sum(p) AS BIGINT) AS protected_selected_count, count(*) AS shot_count, count(CASE WHEN k > 0 THEN 1 END) AS covered_shot_count FROM s GROUP BY 1),
  e AS (SELECT video_id, count(*) AS event_count, count(CASE WHEN k > 0 THEN 1 END) AS satisfied_event_count FROM (SELECT video_id, frame_id // 100 AS ev, count(CASE WHEN frame_id % 4 = 0 THEN 1 END) AS k FROM ft WHERE frame_id % 2 = 0 GROUP BY ALL) GROUP BY 1),
  t AS (SELECT DISTINCT video_id, ts, 1 AS kind FROM ft WHERE frame_id % 4 = 0 UNION ALL SELECT video_id, 0, 0 FROM d UNION ALL SELECT video_id, duration, 2 FROM d), g AS (SELECT video_id, round(ts - lag(ts) OVER (PARTITION BY video_id ORDER BY kind, ts), 6) AS gap FROM t),
  h AS (SELECT video_id, count(CASE WHEN gap > 1 + 1e-12 THEN 1 END) AS violations, max(gap) AS largest_gap FROM g WHERE gap IS NOT NULL GROUP BY 1),
  j AS (SELECT video_id, candidate_count, selected_count, protected_selected_count, shot_count, covered_shot_count, coalesce(event_count, 0) AS event_count, coalesce(satisfied_event_count, 0) AS satisfied_event_count, duration, violations, largest_gap FROM o LEFT JOIN e USING (video_id) LEFT JOIN d USING (video_id) LEFT JOIN h USING (video_id))
  SELECT *, round(covered_shot_count / shot_count::DOUBLE, 6) AS shot_recall, round(satisfied_event_count / nullif(event_count, 0)::DOUBLE, 6) AS event_recall, round(selected_count * 60 / duration, 6) AS keyframes_per_minute, greatest(0, selected_count - 40) AS overrun_count, round(greatest(0, selected_count - 40) / 4e1, 6) AS overrun_ratio,
    CASE WHEN violations = 0 AND covered_shot_count = shot_count AND satisfied_event_count = event_count THEN 'passed' ELSE 'failed' END AS status FROM j""")
def video_report(spark, sf):
    f = text_frames(spark, sf)
    selected = f.where("frame_id % 4 = 0").select("frame_id", (F.col("frame_id") % 8 == 0).alias("protected"))
    events = f.where("frame_id % 2 = 0").select("video_id", F.floor(F.col("frame_id") / 100).alias("event_id"), "frame_id")
    return C.video_report(f, selected, events, f.groupBy("video_id").agg((F.max("ts") + 1).alias("duration")), 1.0, 40)
