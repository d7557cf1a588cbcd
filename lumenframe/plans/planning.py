"""Queries of planned hybrid search over many queries, with their SQL. Benchmark items with an id divisible by 50 ask."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.operators import lexical as L
from lumenframe.operators import phrases as H
from lumenframe.operators import planned as P
from lumenframe.operators.scorers import blended, model_scores
from lumenframe.plans.registry import FT, WORDS, query
from lumenframe.sources.corpus import table, text_frames
from lumenframe.sources.files import settled

CAPITALS = "[A-Z][a-z]+"
STAGE1, POOL, TOP = 60, 50, 20


def plan_rows(spark, sf):
    """Branches of each asking item: its text and its second half as captions, its capitalised words as recognised text, a
    source as object where the item is in scope, and the vectors of its id and the next."""
    items = table(spark, sf, "benchmark").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("t"))
    half = F.substr("t", F.floor(F.length("t") / 2).cast("int") + 1)
    told = [("caption", P.ORIGINAL, 1.0, F.lit(True), F.col("t")), ("caption", "paraphrase_1", 0.6, F.lit(True), half), ("ocr", P.ORIGINAL, 1.0, F.lit(True), F.array_join(F.regexp_extract_all("t", F.lit(CAPITALS), 0), " ")), ("objects", P.ORIGINAL, 1.0, F.col("query_id") % 100 == 0, F.concat(F.lit("src"), (F.col("query_id") % 20).cast("string"))), ("audio", P.ORIGINAL, 1.0, F.lit(True), F.col("t"))]
    texts = [items.select("query_id", F.lit(m).alias("modality"), F.lit(v).alias("variant"), F.lit(w).alias("weight"), s.alias("in_scope"), t.alias("text"), F.lit(None).cast("array<float>").alias("vector")) for m, v, w, s, t in told]
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("_v"), F.col("embedding").alias("vector"))
    for name, weight, step in ((P.ORIGINAL, 1.0, 0), ("paraphrase_1", 0.6, 1)):
        texts.append(items.join(vectors, F.col("_v") == F.col("query_id") + step).select("query_id", F.lit(P.VISUAL).alias("modality"), F.lit(name).alias("variant"), F.lit(weight).alias("weight"), F.lit(True).alias("in_scope"), F.lit(None).cast("string").alias("text"), "vector"))
    out = texts[0]
    for t in texts[1:]:
        out = out.unionByName(t)
    return out


def said_rows(spark, sf):
    f = text_frames(spark, sf)
    return {"caption": f.select("frame_id", F.col("caption").alias("text")), "ocr": f.select("frame_id", F.array_join(F.regexp_extract_all("caption", F.lit(CAPITALS), 0), " ").alias("text")), "objects": f.select("frame_id", F.col("video_id").alias("text"))}


def _text_sql(m: str, said: str) -> str:
    """CTEs of one text modality, from its texts to the ranked frames of each branch."""
    return f"""{m}s AS (SELECT frame_id AS id, {WORDS.format(said)} AS ws FROM ft), {m}t AS MATERIALIZED (SELECT id, unnest(ws) AS token, generate_subscripts(ws, 1) AS place, len(ws) AS doc_len FROM {m}s),
  {m}u AS MATERIALIZED (SELECT token, {X.stem_sql('token', 'regexp_matches')} AS stem FROM (SELECT DISTINCT token FROM {m}t)), {m}z AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM {m}s),
  {m}q AS (SELECT query_id, variant, weight, stem, min(i) AS i FROM asked WHERE modality = '{m}' GROUP BY ALL), {m}w AS (SELECT query_id, variant, weight, count(*) AS n_stems, sum({X.weight_sql('stem')}) AS all_w FROM {m}q GROUP BY ALL),
  {m}f AS (SELECT id, stem, count(*) AS tf, any_value(doc_len) AS doc_len FROM {m}t JOIN {m}u USING (token) WHERE stem IN (SELECT stem FROM {m}q) GROUP BY ALL), {m}d AS (SELECT stem, count(*) AS df FROM {m}f GROUP BY 1),
  {m}b AS (SELECT * FROM (SELECT query_id, variant, id, sum(ln(1e0 + (n - df + 5e-1) / (df + 5e-1)) * (tf * 25e-1) / (tf + 15e-1 * (25e-2 + 75e-2 * greatest(doc_len, 1) / greatest(mean, 1e0)))) AS bm25, sum({X.weight_sql('stem')}) AS w, count(*) AS matched
         FROM {m}f JOIN {m}d USING (stem) JOIN {m}q USING (stem), {m}z GROUP BY query_id, variant, id) QUALIFY row_number() OVER (PARTITION BY query_id, variant ORDER BY round(bm25, 9) DESC, id) <= {STAGE1}),
  {m}c AS (SELECT id, ' ' || string_agg(stem, ' ' ORDER BY place) || ' ' AS content FROM {m}t JOIN {m}u USING (token) WHERE token NOT IN ({X._listed(X.STOPWORDS)}) GROUP BY id),
  {m}h AS (SELECT query_id, '{m}' AS modality, variant, weight, id AS frame_id, round(least(1e0, 5e-1 * round(bm25 / (bm25 + 1), 6) + 4e-1 * least(1e0, w / all_w) + CASE WHEN n_stems > 1 AND matched = n_stems AND contains(content, ' ' || phrase || ' ') THEN 1e-1 ELSE 0e0 END), 6) AS score
         FROM {m}b JOIN {m}w USING (query_id, variant) LEFT JOIN {m}c USING (id) LEFT JOIN (SELECT query_id, variant, modality, string_agg(stem, ' ' ORDER BY i) AS phrase FROM asked GROUP BY ALL) p ON p.query_id = {m}b.query_id AND p.variant = {m}b.variant AND p.modality = '{m}')"""


BRANCHES = f"""it AS (SELECT item_id AS query_id, coalesce(text, '') AS t FROM benchmark WHERE item_id % 50 = 0),
  br AS (SELECT query_id, 'caption' AS modality, 'original' AS variant, 1e0 AS weight, true AS in_scope, t AS said FROM it UNION ALL SELECT query_id, 'caption', 'paraphrase_1', 6e-1, true, substr(t, length(t) // 2 + 1) FROM it
    UNION ALL SELECT query_id, 'ocr', 'original', 1e0, true, array_to_string(regexp_extract_all(t, '{CAPITALS}'), ' ') FROM it UNION ALL SELECT query_id, 'objects', 'original', 1e0, query_id % 100 = 0, 'src' || (query_id % 20) FROM it UNION ALL SELECT query_id, 'audio', 'original', 1e0, true, t FROM it),
  bt AS (SELECT query_id, modality, variant, weight, in_scope, {WORDS.format('said')} AS ws FROM br), bx AS (SELECT *, list_filter(ws, lambda x: NOT list_contains([{X._listed(X.STOPWORDS)}], x)) AS kept FROM bt),
  bu AS (SELECT query_id, modality, variant, weight, in_scope, unnest(CASE WHEN len(kept) > 0 THEN kept ELSE ws END) AS token, generate_subscripts(CASE WHEN len(kept) > 0 THEN kept ELSE ws END, 1) AS i FROM bx),
  asked AS (SELECT query_id, modality, variant, weight, {X.stem_sql('token', 'regexp_matches')} AS stem, i FROM bu WHERE in_scope AND modality <> 'audio')"""
COSINE = "list_sum(list_transform(list_zip(e.embedding, v.embedding), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
PLANNED = f"""WITH {FT}, {BRANCHES}, {_text_sql('caption', 'caption')}, {_text_sql('ocr', f"array_to_string(regexp_extract_all(caption, '{CAPITALS}'), ' ')")}, {_text_sql('objects', 'video_id')},
  vh AS (SELECT query_id, 'visual' AS modality, CASE step WHEN 0 THEN 'original' ELSE 'paraphrase_1' END AS variant, CASE step WHEN 0 THEN 1e0 ELSE 6e-1 END AS weight, e.vec_id AS frame_id, round({COSINE}, 6) AS score FROM it, range(2) s(step), embeddings v, embeddings e WHERE v.vec_id = query_id + step
         QUALIFY row_number() OVER (PARTITION BY query_id, step ORDER BY score DESC, e.vec_id) <= {STAGE1}),
  al AS (SELECT * FROM captionh UNION ALL SELECT * FROM ocrh UNION ALL SELECT * FROM objectsh UNION ALL SELECT * FROM vh), ra AS (SELECT *, row_number() OVER (PARTITION BY query_id, modality, variant ORDER BY score DESC, frame_id) AS rank FROM al),
  iv AS (SELECT query_id, modality, frame_id, sum(CASE WHEN variant = 'original' THEN weight / (60 + rank) ELSE 0e0 END) AS own, sum(CASE WHEN variant = 'original' THEN 0e0 ELSE weight / (60 + rank) END) AS more, arg_min(score, (variant <> 'original', rank)) AS score FROM ra GROUP BY ALL),
  ir AS (SELECT iv.*, video_id, ts, row_number() OVER (PARTITION BY query_id, modality ORDER BY round(own + least(more, 1e0 / 61), 10) DESC, round(own, 10) DESC, video_id, ts, frame_id) AS rank FROM iv JOIN ft USING (frame_id)),
  fu AS (SELECT * FROM (SELECT query_id, frame_id, any_value(video_id) AS video_id, any_value(ts) AS ts, round(sum(CASE modality WHEN 'visual' THEN 55e-2 WHEN 'caption' THEN 2e-1 * 15e-1 ELSE 1e-1 END / (60 + rank)), 10) AS rrf,
    max(CASE WHEN modality = 'visual' THEN score END) AS v, max(CASE WHEN modality = 'caption' THEN score END) AS c, max(CASE WHEN modality = 'ocr' THEN score END) AS o, max(CASE WHEN modality = 'objects' THEN score END) AS b FROM ir GROUP BY query_id, frame_id)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, video_id, ts, frame_id) <= {POOL}),
  re AS (SELECT *, round((55e-2 * least(1e0, greatest(0e0, (coalesce(v, -1e0) + 1) / 2)) + 2e-1 * coalesce(c, 0e0) + 1e-1 * coalesce(o, 0e0) + 1e-1 * coalesce(b, 0e0) + 5e-2) / (55e-2 + 5e-2 + 4e-1), 6) AS score FROM fu)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rrf DESC, video_id, ts, frame_id) AS INTEGER) AS rank, frame_id, video_id, score, rrf FROM re QUALIFY rank <= {TOP}"""


@query(PLANNED)
def planned_hybrid(spark, sf):
    f, plan = text_frames(spark, sf), plan_rows(spark, sf)
    # the stored part: each modality's postings are written once, and all branches read them
    indexes = {m: (settled(L.postings(t, text="text")), L.stats(t, "text"), t) for m, t in said_rows(spark, sf).items()}
    hints = plan.select("query_id", F.lit("caption").alias("modality"))
    vectors = table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), "embedding")
    return P.planned_search(plan, f, indexes, vectors, STAGE1, POOL, TOP, hints)[0]


@query(f"WITH {BRANCHES} SELECT query_id, modality, variant, CASE WHEN NOT in_scope THEN 'outside_modality_scope' WHEN modality = 'audio' THEN 'engine_unavailable' ELSE 'no_reliable_modality_terms' END AS reason FROM bx WHERE NOT in_scope OR modality = 'audio' OR len(ws) = 0")
def planned_skips(spark, sf):
    plan = plan_rows(spark, sf)
    return P.branches(plan.where(F.col("modality") != P.VISUAL), ["caption", "ocr", "objects"])[1]


RANKED = f"""{FT}, rk AS (SELECT video_id AS query_id, frame_id AS candidate, ts, (frame_id * 7 % 100) / 1e2 AS score, row_number() OVER (PARTITION BY video_id ORDER BY (frame_id * 7 % 100) DESC, ts, frame_id) AS rank, length(caption) AS n FROM ft),
  mo AS (SELECT *, CASE WHEN rank <= 20 AND n % 13 > 0 THEN (n % 101) / 1e2 END AS model FROM rk), st AS (SELECT query_id, bool_or(rank <= 20 AND model IS NULL) AS failed FROM mo GROUP BY 1)"""


@query(f"""WITH {RANKED}, bl AS (SELECT mo.*, CASE WHEN rank <= 20 AND model IS NOT NULL THEN round(8e-1 * score + 2e-1 * model, 8) ELSE score END AS blend, CASE WHEN failed THEN 'fallback' ELSE 'passed' END AS status FROM mo JOIN st USING (query_id))
  SELECT query_id, candidate, CAST(row_number() OVER (PARTITION BY query_id ORDER BY blend DESC, ts, candidate) AS INTEGER) AS rank, blend AS score, model, CASE WHEN rank <= 20 AND model IS NULL THEN 'ValueError: unreadable' END AS reason, status FROM bl""")
def model_blend_each(spark, sf):
    """A scorer that can't read some rows: the others are blended, these keep their scores."""
    f, k = text_frames(spark, sf), F.col("frame_id")
    order = Window.partitionBy("video_id").orderBy(F.desc(k * 7 % 100), "ts", "frame_id")
    rows = settled(f.select(F.col("video_id").alias("query_id"), k.alias("candidate"), "ts", (k * 7 % 100 / 100.0).alias("score"), F.row_number().over(order).alias("rank"), F.length("caption").alias("n")))

    def by_length(items: list[dict]) -> list[float]:
        if any(i["n"] % 13 == 0 for i in items):
            raise ValueError("unreadable")
        return [min(1.0, i["n"] % 101 / 100) for i in items]

    scores = model_scores(rows.where("rank <= 20"), by_length, ["n"])
    return blended(rows.drop("n"), scores, "each").select("query_id", "candidate", "rank", "score", "model", "reason", "status")


#: A vocabulary that occurs in the items' prose, with variants that overlap within and across categories.
VOCABULARY = {
    "subject": {"the": ["the", "to the", "of the"], "he": ["he", "that he"], "de la": ["de la", "la"]},
    "locations": {"in": ["in the", "in"], "on": ["on the", "on"], "en": ["en la", "en el", "en"]},
    "objects": {"the of": ["the of", "of"], "la": ["la", "la de"], "and the": ["and the", "and", "in the of"]},
    "actions": {"is": ["is"], "was": ["was", "it was"], "est": ["est", "que est"]},
    "attributes": {"a": ["a", "at a"], "it": ["it", "to it"]},
}
ENTRIES = [(c, name, v) for c, names in VOCABULARY.items() for name, variants in names.items() for v in variants]
VALUES = ", ".join(f"('{c}', '{n}', '{v}')" for c, n, v in ENTRIES)
EDGE = r"[\p{L}\p{N}_]"


def _chosen_sql(source: str) -> str:
    """SQL of the greedy choice for each query and category of a table of candidates."""
    return f"""SELECT item_id, category, unnest(list_reduce(list([{{'less': s - e, 's': s, 'canonical': canonical, 'e': e}}] ORDER BY s - e, s, canonical),
    lambda kept, x: CASE WHEN len(list_filter(kept, lambda k: k.s < x[1].e AND x[1].s < k.e)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS k FROM (SELECT DISTINCT * FROM {source}) GROUP BY item_id, category"""


PHRASES = f"""vo(category, canonical, v) AS (VALUES {VALUES}), ch AS (SELECT item_id, lower(coalesce(text, '')) AS t, unnest(range(1, length(coalesce(text, '')) + 1)) AS i FROM benchmark),
  ca AS (SELECT item_id, category, canonical, i - 1 AS s, i - 1 + length(v) AS e FROM ch JOIN vo ON substr(t, i, length(v)) = v WHERE NOT (i > 1 AND regexp_matches(substr(t, i - 1, 1), '{EDGE}')) AND NOT regexp_matches(substr(t, i + length(v), 1), '{EDGE}')),
  c1 AS (SELECT * FROM ca WHERE category <> 'objects'), k1 AS ({_chosen_sql('c1')}),
  c2 AS (SELECT * FROM ca WHERE category = 'objects' AND NOT EXISTS (SELECT 1 FROM k1 WHERE k1.item_id = ca.item_id AND k1.category IN ('locations', 'subject') AND ca.s < k1.k.e AND k1.k.s < ca.e)), k2 AS ({_chosen_sql('c2')}),
  ks AS (SELECT item_id AS query_id, category, k.canonical AS canonical, min((k.s, k.e)) AS f FROM (SELECT * FROM k1 UNION ALL SELECT * FROM k2) GROUP BY ALL),
  kn AS (SELECT query_id, category, canonical, f[1] AS start, f[2] AS finish, CAST(row_number() OVER (PARTITION BY query_id, category ORDER BY f) AS INTEGER) AS place FROM ks)"""


def _known(spark, sf):
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return items, H.constraints(items, H.vocabulary(spark, VOCABULARY))


@query(f"WITH {PHRASES} SELECT query_id, category, canonical, CAST(start AS INTEGER) AS start, CAST(finish AS INTEGER) AS finish, place FROM kn")
def known_constraints(spark, sf):
    return _known(spark, sf)[1].withColumnRenamed("end", "finish")


ASKED = f"""{PHRASES}, au AS (SELECT item_id AS query_id, lower(coalesce(text, '')) AS t, length(regexp_extract(lower(coalesce(text, '')), '^\\s*(?:{'|'.join(H.AUXILIARIES)})\\b')) AS aux FROM benchmark),
  an AS (SELECT query_id, aux, coalesce(min(CASE WHEN category = 'subject' AND start >= aux THEN (start, finish) END), min(CASE WHEN category = 'objects' AND start >= aux THEN (start, finish) END)) AS a FROM au LEFT JOIN kn USING (query_id) GROUP BY ALL),
  hy AS (SELECT query_id, a[1] AS anchor, coalesce(min(CASE WHEN category = 'actions' AND start >= coalesce(a[2], aux) THEN start END), min(CASE WHEN category IN ('attributes', 'locations', 'objects') AND start >= coalesce(a[2], aux) AND start IS DISTINCT FROM a[1] THEN start END)) AS hypothesis FROM an LEFT JOIN kn USING (query_id) GROUP BY ALL)"""


@query(f"WITH {ASKED} SELECT kn.query_id, category, canonical, CASE WHEN start >= hypothesis THEN 'hypothesis' ELSE 'context' END AS role FROM kn JOIN hy USING (query_id)")
def constraint_roles(spark, sf):
    items, known = _known(spark, sf)
    known = settled(known)
    return H.with_roles(known, H.hypothesis_starts(items, known)).select("query_id", "category", "canonical", "role")
