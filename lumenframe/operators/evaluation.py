"""Validation reports and evaluation metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def frame_map_report(frames: DataFrame, key: str, required: str) -> DataFrame:
    """One row: rows, ids of 0..n-1 that are missing, ids beyond, rows without the required text."""
    n = frames.count()
    ids = frames.sparkSession.range(n).withColumnRenamed("id", key)
    missing = ids.join(frames.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("missing"))
    rest = frames.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col(key) >= n, 1)).alias("extra"), F.count(F.when(F.col(required).isNull() | (F.col(required) == ""), 1)).alias("empty"))
    return rest.join(F.broadcast(missing)).select("n", "missing", "extra", "empty")  # one row each


def frame_map_audit(frames: DataFrame, total: int, key: str, required: tuple[str, ...], source: str = "timestamp_source", sample: int = 20) -> DataFrame:
    """(issue, n, sample) of a frame map held against an index of ``total`` rows: count_mismatch (how far the counts are
    apart), missing_index, extra_index (ids outside 0 ... total - 1), repeated_index, empty_<field> for each required field, and
    source_<name> for each source of times (not an issue, but reported). sample: the smallest ids, ``sample`` at most; issues that don't
    occur have no row."""
    ids = frames.select(F.col(key).cast("long").alias("id"))
    spark, known = frames.sparkSession, ids.distinct()
    found = [
        spark.range(total).join(known, "id", "left_anti").select(F.lit("missing_index").alias("issue"), "id"),
        known.where((F.col("id") < 0) | (F.col("id") >= total)).select(F.lit("extra_index").alias("issue"), "id"),
        ids.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.lit("repeated_index").alias("issue"), "id"),
        *[frames.where(F.col(f).isNull() | (F.col(f).cast("string") == "")).select(F.lit(f"empty_{f}").alias("issue"), F.col(key).cast("long").alias("id")) for f in required],
        frames.select(F.concat(F.lit("source_"), F.coalesce(F.col(source), F.lit("none"))).alias("issue"), F.col(key).cast("long").alias("id")),
    ]
    rows = reduce(DataFrame.unionByName, found)
    first = rows.withColumn("_r", F.row_number().over(Window.partitionBy("issue").orderBy("id"))).where(F.col("_r") <= sample)
    samples = first.groupBy("issue").agg(F.array_sort(F.collect_list("id")).alias("sample"))
    told = rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n")).join(samples, "issue")
    apart = frames.agg(F.abs(F.count(F.lit(1)) - total).alias("n")).where("n > 0").select(F.lit("count_mismatch").alias("issue"), "n", F.array().cast("array<bigint>").alias("sample"))
    return told.select("issue", "n", "sample").unionByName(apart)


def frame_map_fixed(frames: DataFrame, source: str = "timestamp_source", confidence: str = "timestamp_confidence") -> DataFrame:
    """Frames with the source and confidence of their times filled in where they are missing: unknown, 0."""
    have = {source: F.lit("unknown"), confidence: F.lit(0.0)}
    return frames.withColumns({c: F.coalesce(F.col(c), v) if c in frames.columns else v for c, v in have.items()})


def hit_at(hits: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """One row: share of queries with a hit among the first k, of (query_id, rank, hit)."""
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"))
    return first.agg(*[F.avg(F.when(F.col("first") <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in ks])


def event_recall(events: DataFrame, selected: DataFrame, tolerance: float) -> DataFrame:
    """Per video: events, and those with a selected time within the tolerance. Times are joined by buckets of it."""
    width = max(tolerance, 1e-6) * 2
    near = selected.select("video_id", F.col("ts").alias("_t"), F.explode(F.array(F.floor((F.col("ts") - tolerance) / width), F.floor((F.col("ts") + tolerance) / width))).alias("_b")).distinct()
    found = events.withColumn("_b", F.floor(F.col("ts") / width)).join(near, ["video_id", "_b"]).where(F.abs(F.col("_t") - F.col("ts")) <= tolerance).select("event_id").distinct().withColumn("_hit", F.lit(1))
    rows = events.join(found, "event_id", "left")
    hit = F.coalesce("_hit", F.lit(0))
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("events"), F.sum(hit).cast("long").alias("covered"), F.round(F.avg(hit), 6).alias("recall"))


def band_duplicates(hashes: DataFrame, seconds: float, bits: int) -> DataFrame:
    """(frame_id, earliest): the earliest frame of the video before it, within the seconds, whose hash differs in few bits.

    Frames meet in time buckets of the band's width, so a long video is split over many keys.
    """
    here = F.floor(F.col("ts") / seconds)
    late = hashes.select("video_id", "frame_id", "ts", "h", F.explode(F.array(here, here - 1)).alias("_b"))
    early = hashes.select("video_id", F.col("frame_id").alias("_f"), F.col("ts").alias("_t"), F.col("h").alias("_h"), here.alias("_b"))
    pair = late.join(early, ["video_id", "_b"]).where((F.col("_t") < F.col("ts")) & (F.col("ts") - F.col("_t") <= seconds) & (F.bit_count(F.col("h").bitwiseXOR(F.col("_h"))) <= bits))
    return pair.groupBy("frame_id").agg(F.min(F.struct("_t", "_f"))["_f"].alias("earliest"))
