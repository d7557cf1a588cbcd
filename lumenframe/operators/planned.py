"""Planned hybrid search: many queries with their variants and modalities as rows of one job.

A plan has a row for each branch: query_id, modality, variant ('original' or another name), weight, in_scope, and a text or a
vector. Text branches meet the postings of their modality by stem, vector branches meet the vectors in blocks; a modality is
scanned once, however many queries and variants there are. No branch comes back to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as X
from lumenframe.operators import fusion as U
from lumenframe.operators import vectors as Q
from lumenframe.sources.files import settled

ORIGINAL, VISUAL = "original", "visual"
#: Weights of the final score, and of quality: squashed BM25, coverage, phrase.
VISUAL_WEIGHT, TEXT_WEIGHTS, TIME_WEIGHT = 0.55, {"caption": 0.20, "ocr": 0.10, "objects": 0.10}, 0.05
QUALITY = (0.5, 0.4, 0.1)


def term_weight(stem: Column) -> Column:
    return F.when(stem.isin(X.GENERIC_SUBJECTS), X.SUBJECT_WEIGHT).when(stem.isin(X.PARTICLES), X.PARTICLE_WEIGHT).otherwise(1.0)


def branches(plan: DataFrame, engines: list[str]) -> tuple[DataFrame, DataFrame]:
    """Text branches that are searched, with their content stems in order (all stems where none is left), and those that are
    skipped, with the reason: outside_modality_scope, engine_unavailable, no_reliable_modality_terms."""
    content = X.stems_of(F.col("text"), content=True)
    told = plan.withColumn("stems", F.when(F.size(content) > 0, content).otherwise(X.stems_of(F.col("text"))))
    reason = F.when(~F.coalesce("in_scope", F.lit(False)), "outside_modality_scope").when(~F.col("modality").isin(engines), "engine_unavailable").when(F.size("stems") == 0, "no_reliable_modality_terms")
    # written once: the stems are a large expression, which plans would else repeat in each place that reads them
    told = settled(told.withColumn("reason", reason))
    return told.where("reason IS NULL").drop("reason"), told.where("reason IS NOT NULL").select("query_id", "modality", "variant", "reason")


def text_hits(wanted: DataFrame, postings: DataFrame, sizes: DataFrame, texts: DataFrame, pool: int) -> DataFrame:
    """(query_id, variant, frame_id, score, rank) of one modality's branches: the best ``pool`` frames of each by BM25, ranked
    by quality.

    wanted: query_id, variant, stems. postings: frame_id, stem, tf, doc_len. sizes: one row of doc_count and avg_doc_len. texts:
    frame_id, text; only frames that have all of a branch's stems are looked at for its phrase.
    """
    keys = ["query_id", "variant"]
    asked = wanted.select(*keys, F.explode(F.array_distinct("stems")).alias("stem")).withColumn("w", term_weight(F.col("stem")))
    whole = wanted.select(*keys, F.array_join("stems", " ").alias("phrase"), F.size(F.array_distinct("stems")).alias("n_stems"), F.aggregate(F.transform(F.array_distinct("stems"), term_weight), F.lit(0.0), lambda s, x: s + x).alias("all_w"))
    own = postings.join(asked.select("stem").distinct(), "stem")
    df = own.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
    part = X.bm25(F.col("tf"), F.col("df"), F.col("doc_count"), F.col("doc_len"), F.col("avg_doc_len"))
    scored = own.join(df, "stem").join(F.broadcast(sizes)).select("frame_id", "stem", part.alias("part"))  # one row
    hits = scored.join(asked, "stem").groupBy(*keys, "frame_id").agg(F.sum("part").alias("bm25"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("matched"))
    best = hits.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.round("bm25", 9).desc(), "frame_id"))).where(F.col("_r") <= pool).drop("_r")
    rows = best.join(whole, keys)
    full = rows.where((F.col("matched") == F.col("n_stems")) & (F.col("n_stems") > 1)).select(*keys, "frame_id", "phrase").join(texts, "frame_id")
    said = F.concat(F.lit(" "), F.array_join(X.stems_of(F.col("text"), content=True), " "), F.lit(" "))
    told = full.where(F.contains(said, F.concat(F.lit(" "), "phrase", F.lit(" ")))).select(*keys, "frame_id", F.lit(1.0).alias("said"))
    squash, cover, phrase = QUALITY
    quality = squash * F.round(F.col("bm25") / (F.col("bm25") + 1.0), 6) + cover * X.unit(F.col("w") / F.col("all_w")) + phrase * F.coalesce("said", F.lit(0.0))
    out = rows.join(told, [*keys, "frame_id"], "left").select(*keys, "frame_id", F.round(X.unit(quality), 6).alias("score"))
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "frame_id")))


def vector_hits(wanted: DataFrame, vectors: DataFrame, pool: int) -> DataFrame:
    """As text_hits() for branches with a vector (query_id, variant, vector) over vectors (row, embedding)."""
    asked = wanted.select(F.struct("query_id", "variant").alias("query_id"), F.col("vector").alias("query"))
    return Q.search(vectors, asked, pool).select("query_id.query_id", "query_id.variant", F.col("row").alias("frame_id"), "score", "rank")


def fused_variants(hits: DataFrame, frames: DataFrame, budget: float = 1.0, k: int = U.RRF_K) -> DataFrame:
    """(query_id, modality, frame_id, video_id, ts, intra, score, rank): each query's variants of a modality fused by rank;
    variants beside the original add at most ``budget`` of what the original's first rank gives. A branch's own score
    comes from the original, else from the variant with the best rank.

    hits: query_id, modality, variant, weight, frame_id, score, rank. frames: frame_id, video_id, ts.
    """
    keys, own = ["query_id", "modality"], F.col("variant") == ORIGINAL
    part = F.col("weight") / (k + F.col("rank"))
    top = hits.where(own).groupBy(*keys).agg(F.max("weight").alias("_w"))
    each = hits.where("weight > 0").groupBy(*keys, "frame_id").agg(
        F.sum(F.when(own, part).otherwise(0.0)).alias("_own"), F.sum(F.when(own, 0.0).otherwise(part)).alias("_more"), F.min(F.struct((~own).cast("int").alias("a"), "rank", "score"))["score"].alias("score"),
    )
    rows = each.join(top, keys).withColumn("intra", F.round(F.col("_own") + F.least("_more", budget * F.col("_w") / (k + 1)), 10)).join(frames.select("frame_id", "video_id", "ts"), "frame_id")
    order = Window.partitionBy(*keys).orderBy(F.desc("intra"), F.desc(F.round("_own", 10)), "video_id", "ts", "frame_id")
    return rows.select(*keys, "frame_id", "video_id", "ts", "intra", "score", F.row_number().over(order).alias("rank"))


def fused_modalities(intra: DataFrame, hints: DataFrame | None = None, weights: dict[str, float] = U.RRF_WEIGHTS, k: int = U.RRF_K) -> DataFrame:
    """(query_id, frame_id, video_id, ts, rrf, scores, place): modalities fused by weighted rank, a query's hinted ones (query_id,
    modality) raised, with each modality's own score, ranked."""
    rows = intra if hints is None else intra.join(hints.select("query_id", "modality").distinct().withColumn("_h", F.lit(U.HINT_BOOST)), ["query_id", "modality"], "left")
    weight = U.weight_of(F.col("modality"), weights) * (F.lit(1.0) if hints is None else F.coalesce("_h", F.lit(1.0)))
    fused = rows.withColumn("_part", weight / (k + F.col("rank"))).where("_part > 0").groupBy("query_id", "frame_id").agg(
        F.first("video_id").alias("video_id"), F.first("ts").alias("ts"), F.round(F.sum("_part"), 10).alias("rrf"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("modality", "score")))).alias("scores"),
    )
    return fused.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "video_id", "ts", "frame_id")))


def reranked(pool: DataFrame, top_k: int) -> DataFrame:
    """The ``top_k`` best of each query by the weighted mean of visual likeness, text scores and time confidence."""
    text = {m: (F.coalesce(F.col("scores")[m], F.lit(0.0)), w) for m, w in TEXT_WEIGHTS.items()}
    score = U.hybrid_score(F.coalesce(F.col("scores")[VISUAL], F.lit(-1.0)), text, F.coalesce("confidence", F.lit(1.0)) if "confidence" in pool.columns else F.lit(1.0), VISUAL_WEIGHT, TIME_WEIGHT)
    rows = pool.withColumn("score", F.round(score, 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("rrf"), "video_id", "ts", "frame_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top_k)


def planned_search(plan: DataFrame, frames: DataFrame, indexes: dict[str, tuple[DataFrame, DataFrame, DataFrame]], vectors: DataFrame | None = None, stage1: int = 200, pool: int = 100, top_k: int = 20, hints: DataFrame | None = None, budget: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(query_id, rank, frame_id, video_id, score, rrf) of each query of the plan, and the branches that were skipped.

    indexes: by text modality its postings, sizes and texts (see text_hits). Visual branches are those with modality 'visual'.
    An original must be among a query's branches of a modality, as variants are measured by it.
    """
    texts, skipped = branches(plan.where(F.col("modality") != VISUAL), list(indexes))
    found = None
    for modality, index in indexes.items():
        own = texts.where(F.col("modality") == modality)
        hits = text_hits(own, *index, stage1).join(own.select("query_id", "modality", "variant", "weight"), ["query_id", "variant"]).select("query_id", "modality", "variant", "weight", "frame_id", "score", "rank")
        found = hits if found is None else found.unionByName(hits)
    seen = plan.where((F.col("modality") == VISUAL) & F.col("in_scope"))
    if vectors is not None:
        hits = vector_hits(seen, vectors, stage1).join(seen.select("query_id", "modality", "variant", "weight"), ["query_id", "variant"]).select("query_id", "modality", "variant", "weight", "frame_id", "score", "rank")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        raise ValueError("there is no modality to search")
    fused = fused_modalities(fused_variants(found, frames, budget), hints)
    ranked = reranked(fused.where(F.col("place") <= pool), top_k)
    return ranked.select("query_id", "rank", "frame_id", "video_id", "score", "rrf"), skipped
