"""Boundary segments, text roll-ups, temporal coverage, importance, event fusion, answer rows and key checks."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as X

#: Weights of the components of a frame's importance, and the cut-offs of the final score.
IMPORTANCE_WEIGHTS = {"ocr": 0.25, "objects": 0.25, "transition": 0.35, "caption": 0.05}
FINAL_SCORE_AT = (1, 5, 20, 50, 100)


def boundary_segments(frames: DataFrame) -> DataFrame:
    """Segments by shot: known boundaries (boundary_start, boundary_end, both may be null) else the first and last time."""
    at = F.struct("ts", "frame_id")
    return frames.groupBy("video_id", "shot_id").agg(
        F.coalesce(F.min("boundary_start"), F.min("ts")).alias("start_time"), F.coalesce(F.max("boundary_end"), F.max("ts")).alias("end_time"),
        F.count(F.lit(1)).alias("frames"), F.min(at)["frame_id"].alias("first_frame"), F.max(at)["frame_id"].alias("last_frame"),
    )


def comparison_key(text: Column) -> Column:
    """Text to compare by: its lower-case words joined by one space."""
    return F.array_join(X.tokens(text), " ")


def distinct_captions(frames: DataFrame) -> DataFrame:
    """Per shot the captions in time order, each comparison key once, joined by a space; captions without a word are left out."""
    keyed = frames.withColumn("_key", F.md5(comparison_key(F.col("caption")))).where(F.size(X.tokens(F.col("caption"))) > 0)
    # the first of each key, with map-side combining
    first = keyed.groupBy("video_id", "shot_id", "_key").agg(F.min(F.struct("ts", "frame_id", "caption")).alias("x"), F.count(F.lit(1)).alias("_n"))
    texts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["caption"])
    return first.groupBy("video_id", "shot_id").agg(F.array_join(texts, " ").alias("caption"), F.count(F.lit(1)).alias("kept"), F.sum("_n").alias("seen"))


def text_regions(regions: DataFrame) -> DataFrame:
    """Per shot and comparison key of (video_id, shot_id, frame_id, ts, text, confidence): first text, best confidence, first
    and last time, number of frames."""
    keyed = regions.withColumn("key", comparison_key(F.col("text"))).where("key <> ''")
    return keyed.groupBy("video_id", "shot_id", "key").agg(
        F.min(F.struct("ts", "frame_id", "text"))["text"].alias("text"), F.round(F.max("confidence"), 6).alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.countDistinct("frame_id").alias("sources")
    )


def coverage_gaps(selected: DataFrame, durations: DataFrame) -> DataFrame:
    """(video_id, gap): gaps between 0, the distinct selected times and the duration. durations: one row a video."""
    inner = selected.select("video_id", "ts", F.lit(1).alias("_kind")).distinct()
    ends = durations.select("video_id", F.explode(F.array(F.struct(F.lit(0.0).alias("ts"), F.lit(0).alias("_kind")), F.struct(F.col("duration").alias("ts"), F.lit(2).alias("_kind")))).alias("e")).select("video_id", "e.ts", "e._kind")
    before = F.lag("ts").over(Window.partitionBy("video_id").orderBy("_kind", "ts"))
    return inner.unionByName(ends).select("video_id", F.round(F.col("ts") - before, 6).alias("gap")).where("gap IS NOT NULL")


def coverage(gaps: DataFrame, max_gap: float, by: Iterable[str] = ("video_id",)) -> DataFrame:
    """Number of gaps, gaps over the limit, largest gap, exact 95th percentile; by video, or over all with by=()."""
    return gaps.groupBy(*by).agg(F.count(F.lit(1)).alias("gaps"), F.count(F.when(F.col("gap") > max_gap + 1e-12, 1)).alias("violations"), F.round(F.max("gap"), 6).alias("max_gap"), F.round(F.percentile("gap", F.lit(0.95)), 6).alias("p95_gap"))


def ocr_quality(confidence: Column, chars: Column, area: Column) -> Column:
    return 0.55 * confidence + 0.25 * F.least(F.lit(1.0), chars / 12) + 0.20 * F.least(F.lit(1.0), area / 0.03)


def object_quality(confidence: Column, area: Column) -> Column:
    return 0.7 * confidence + 0.3 * F.least(F.lit(1.0), area / 0.2)


def importance(scores: dict[str, Column], weights: dict[str, float] = IMPORTANCE_WEIGHTS) -> Column:
    """Weighted mean of the components that are there (not null); 0 where none is."""
    total = lambda parts: reduce(lambda a, b: a + b, parts)
    have = total([F.when(c.isNotNull(), weights[n]).otherwise(0.0) for n, c in scores.items()])
    return F.when(have > 0, X.unit(total([F.coalesce(weights[n] * c, F.lit(0.0)) for n, c in scores.items()]) / have)).otherwise(0.0)


def event_rrf(lists: dict[str, tuple[DataFrame, float]], k: int = 60) -> DataFrame:
    """Fuse ranked lists (video_id, frame_id, rank) by name with their weights; 1 is the score of a candidate that leads all."""
    rows = reduce(DataFrame.unionByName, [d.select("video_id", "frame_id", F.lit(n).alias("list"), "rank", (w / (k + F.col("rank"))).alias("part")) for n, (d, w) in lists.items()])
    best = rows.groupBy("video_id", "frame_id", "list").agg(F.min("rank").alias("rank"), F.max("part").alias("part"))
    most = sum(w for _, w in lists.values()) / (k + 1)
    return best.groupBy("video_id", "frame_id").agg(F.round(F.sum("part") / most, 8).alias("score"), F.min("rank").alias("best_rank"), F.count(F.lit(1)).alias("lists"))


def answer_rows(ranked: DataFrame, most: int = 100) -> DataFrame:
    """The best ``most`` distinct (video_id, frame_id) with their rank; rows without a frame are left out."""
    each = ranked.where("frame_id IS NOT NULL").groupBy("video_id", "frame_id").agg(F.max("score").alias("score"))
    top = each.orderBy(F.desc("score"), "video_id", "frame_id").limit(most)
    return top.select("video_id", "frame_id", F.row_number().over(Window.orderBy(F.desc("score"), "video_id", "frame_id")).alias("rank"))


def frame_window(frames: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """For each target frame the ``limit`` frames of its shot nearest in ordinal position, itself included, ties by position.

    They lie fewer than ``limit`` positions away, so each target meets 2 * limit - 1 positions at most.
    """
    placed = frames.select("shot_id", "frame_id", F.row_number().over(Window.partitionBy("shot_id").orderBy("ts", "frame_id")).alias("_p"))
    here = placed.join(targets.select("frame_id"), "frame_id", "left_semi").select(F.col("frame_id").alias("target"), "shot_id", F.col("_p").alias("_at"), F.explode(F.sequence(F.col("_p") - limit + 1, F.col("_p") + limit - 1)).alias("_p"))
    near = Window.partitionBy("target").orderBy(F.abs(F.col("_p") - F.col("_at")), "_p")
    return here.join(placed, ["shot_id", "_p"]).withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= limit).select("target", "frame_id", "rank")


def key_mismatch(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: keys in both, in ``a`` alone, in ``b`` alone."""
    left, right = (d.select(key).distinct().withColumn(n, F.lit(1)) for d, n in ((a, "_a"), (b, "_b")))
    both = left.join(right, key, "full")
    return both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("_b").isNull(), 1)).alias("first_only"), F.count(F.when(F.col("_a").isNull(), 1)).alias("second_only"))


def final_score(scores: DataFrame, at: tuple[int, ...] = FINAL_SCORE_AT) -> DataFrame:
    """Per query of (query_id, rank, r): the best r among the first k for each k, and their mean."""
    best = [F.coalesce(F.max(F.when(F.col("rank") <= k, F.col("r"))), F.lit(0.0)) for k in at]
    return scores.groupBy("query_id").agg(*[F.round(b, 6).alias(f"r_at_{k}") for b, k in zip(best, at, strict=True)], F.round(reduce(lambda x, y: x + y, best) / len(at), 6).alias("final"))


def with_term_coverage(docs: DataFrame, terms: dict[str, float], text: str = "caption") -> DataFrame:
    """Append coverage: the weight share of the (stemmed) terms that a text has."""
    rows = docs.withColumn("_stems", F.transform(F.array_distinct(X.tokens(F.col(text))), X._stem_column))
    got = reduce(lambda a, b: a + b, [F.when(F.array_contains("_stems", t), w).otherwise(0.0) for t, w in terms.items()])
    return rows.withColumn("coverage", F.round(got / sum(terms.values()), 6)).drop("_stems")
