"""Candidate merging, reciprocal-rank fusion, clip aggregation and reranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as X

#: Default modality weights; a modality that isn't named weighs 1.
RRF_WEIGHTS = {"visual": 0.55, "caption": 0.20, "ocr": 0.10, "objects": 0.10, "dense_text": 0.20}
RRF_K, HINT_BOOST = 60, 1.5


def identity(frame: Column, segment: Column, row: Column, video: Column, ts: Column) -> Column:
    """What makes two hits the same candidate: frame, else segment, else row, else video and time."""
    filled = lambda c: F.nullif(c.cast("string"), F.lit(""))
    return F.coalesce(F.concat(F.lit("frame:"), filled(frame)), F.concat(F.lit("segment:"), filled(segment)), F.concat(F.lit("row:"), filled(row)), F.concat_ws(":", F.lit("time"), video.cast("string"), F.format_number(ts, 3)))


def merge(hits: DataFrame, key: str = "frame_id") -> DataFrame:
    """One row a candidate of (key, modality, score): the best score, and the best of each modality as a map."""
    per = hits.groupBy(key, "modality").agg(F.max("score").alias("score"))
    return per.groupBy(key).agg(F.round(F.max("score"), 6).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("modality", "score")))).alias("modality_scores"))


#: Fields that a merged candidate takes from the first row that has them, and those of the leading row as they are.
FILLED, LISTS = ("caption", "ocr_text", "keyframe_path", "thumbnail_path", "frame_index", "faiss_index"), ("objects",)


def merge_fold(hits: DataFrame, seq: str = "seq") -> DataFrame:
    """One row a candidate of ranked lists that come one after another, in the order of the merged ranking.

    hits: video_id, frame_id, segment_id, faiss_index, timestamp, timestamp_confidence, score, modality_scores (a map), ``seq``
    (place in the concatenated lists, unique within a candidate), and any of FILLED and LISTS. Rows meet from left to right:
    one that beats the score so far (rounded, once two have met) leads, an equal one doesn't. So the rows that led, latest
    first, and then the others as they came, are asked in this order: the first gives all fields of its own, FILLED ones come
    from the first that has them, LISTS are joined without repeats, modalities keep their best score. Candidates stand by
    score, time confidence, and where they were first seen (``first_seen``); order by these to read the ranking.
    """
    named = hits.withColumn("_id", identity(F.col("frame_id"), F.col("segment_id"), F.col("faiss_index"), F.col("video_id"), F.col("timestamp")))
    named = named.withColumn("_id", F.when(F.col("_id").startswith("row:") | F.col("_id").startswith("time:"), F.col("_id")).otherwise(F.concat_ws(":", F.col("video_id").cast("string"), "_id")))
    before = Window.partitionBy("_id").orderBy(seq).rowsBetween(Window.unboundedPreceding, -1)
    met, best = F.count(F.lit(1)).over(before), F.max("score").over(before)
    leads = (met == 0) | (F.col("score") > F.when(met == 1, best).otherwise(F.round(best, 6)))
    rows = named.withColumn("_o", F.when(leads, F.struct(F.lit(0).alias("k"), (-F.col(seq)).alias("s"))).otherwise(F.struct(F.lit(1).alias("k"), F.col(seq).alias("s"))))
    filled = [c for c in FILLED if c in hits.columns]
    lists = [c for c in LISTS if c in hits.columns]
    own = [c for c in hits.columns if c not in {*filled, *lists, seq, "score", "modality_scores"}]
    has = lambda c: F.nullif(F.col(c), F.lit("")) if dict(hits.dtypes)[c] == "string" else F.col(c)
    first = lambda c: F.min(F.when(has(c).isNotNull(), F.struct("_o", F.col(c).alias("v"))))["v"].alias(c)
    joined = lambda c: F.filter(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_o", F.coalesce(c, F.array().cast(dict(hits.dtypes)[c])).alias("v")))), lambda x: x["v"]))), lambda v: v.isNotNull() & (v.cast("string") != "")).alias(c)
    main = rows.groupBy("_id").agg(
        F.min(F.struct("_o", *own)).alias("_top"), F.when(F.count(F.lit(1)) > 1, F.round(F.max("score"), 6)).otherwise(F.max("score")).alias("score"), F.min(seq).alias("first_seen"), *map(first, filled), *map(joined, lists),
    )
    parts = rows.select("_id", F.explode("modality_scores").alias("m", "v")).groupBy("_id", "m").agg(F.max("v").alias("v"))
    maps = parts.groupBy("_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("m", "v")))).alias("modality_scores"))
    out = main.join(maps, "_id", "left").select(*[F.col(f"_top.{c}").alias(c) for c in own], "score", *filled, *lists, "modality_scores", "first_seen")
    return out.orderBy(F.desc("score"), F.desc_nulls_last("timestamp_confidence"), "first_seen")


def weight_of(modality: Column, weights: dict[str, float], hints: tuple[str, ...] = ()) -> Column:
    named = reduce(lambda c, kv: F.when(modality == kv[0], kv[1] * (HINT_BOOST if kv[0] in hints else 1.0)).otherwise(c), weights.items(), F.lit(1.0))
    return named


def rrf(hits: DataFrame, weights: dict[str, float] = RRF_WEIGHTS, hints: tuple[str, ...] = (), k: int = RRF_K, key: str = "frame_id") -> DataFrame:
    """Weighted reciprocal-rank fusion of (modality, rank, key, video_id, ts). Ranks are list positions before repeated
    candidates are dropped; a candidate counts once a modality, at its best rank."""
    first = hits.groupBy(key, "modality").agg(F.min("rank").alias("rank"), F.min_by("video_id", "rank").alias("video_id"), F.min_by("ts", "rank").alias("ts"))
    part = first.withColumn("part", weight_of(F.col("modality"), weights, hints) / (k + F.col("rank"))).where("part > 0")
    best = F.struct("rank", "modality")
    return part.groupBy(key).agg(F.min_by("video_id", best).alias("video_id"), F.min_by("ts", best).alias("ts"), F.round(F.sum("part"), 10).alias("score"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("modality", "rank")))).alias("ranks"), F.min("rank").alias("best_rank"))


def rrf_variants(hits: DataFrame, weights: dict[str, float], original: str = "original", k: int = RRF_K, cap: float = 1.0, key: str = "frame_id") -> DataFrame:
    """Fuse query variants of one modality; expansions add at most ``cap`` of the original's first-rank contribution."""
    first = hits.groupBy(key, "variant").agg(F.min("rank").alias("rank"))
    part = first.withColumn("part", weight_of(F.col("variant"), weights) / (k + F.col("rank")))
    own = F.sum(F.when(F.col("variant") == original, F.col("part")).otherwise(0.0))
    more = F.sum(F.when(F.col("variant") != original, F.col("part")).otherwise(0.0))
    return part.groupBy(key).agg(F.round(own, 10).alias("original"), F.round(more, 10).alias("raw_expansion"), F.round(own + F.least(more, F.lit(cap * weights[original] / (k + 1))), 10).alias("score"))


def clips(fused: DataFrame, top_n: int) -> DataFrame:
    """(video_id, shot_id, score, n): the best frame's score plus .15 of the next two; the top_n best clips."""
    order = Window.partitionBy("video_id", "shot_id").orderBy(F.desc("score"), "ts", "frame_id")
    ranked = fused.withColumn("_r", F.row_number().over(order))
    weight = F.when(F.col("_r") == 1, 1.0).when(F.col("_r") <= 3, 0.15).otherwise(0.0)
    return ranked.groupBy("video_id", "shot_id").agg(F.round(F.sum(F.col("score") * weight), 10).alias("score"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"), "video_id", "shot_id").limit(top_n)


def first_in(rows: DataFrame, group: list[str], *order) -> DataFrame:
    """The first row of each group."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where("_r = 1").drop("_r")


def hybrid_score(visual: Column, others: dict[str, tuple[Column, float]], confidence: Column, visual_weight: float, time_weight: float) -> Column:
    """Weighted mean of the visual cosine mapped to 0..1, modality scores and time confidence."""
    whole = visual_weight + time_weight + sum(w for _, w in others.values())
    return (visual_weight * X.cosine_to_unit(visual) + reduce(lambda a, b: a + b, [w * X.unit(c) for c, w in others.values()], F.lit(0.0)) + time_weight * X.unit(confidence)) / whole


def max_top_mean(scores: Column, ratio: float, k: int) -> Column:
    """ratio * max + (1 - ratio) * mean of the k largest."""
    best = F.slice(F.sort_array(scores, False), 1, k)
    return ratio * F.element_at(best, 1) + (1 - ratio) * (F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(best))


def consensus(hits: DataFrame, step: float = 0.03, key: str = "frame_id") -> DataFrame:
    """Best score plus ``step`` for each further query group that found the candidate, at most 1."""
    return hits.groupBy(key).agg(F.round(F.least(F.lit(1.0), F.max("score") + step * (F.countDistinct("query_group") - 1)), 6).alias("score"), F.countDistinct("query_group").alias("groups"))
