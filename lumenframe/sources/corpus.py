"""Frame records over stored tables, and the projection that normalises records of looser schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHOT_SECONDS, FRAMES_A_SECOND = 5, 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame a document: the source is the video, the id gives the time, five seconds make a shot."""
    second = F.floor(F.col("doc_id") / FRAMES_A_SECOND)
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("video_id"), F.col("doc_id").alias("frame_id"), F.col("doc_id").alias("frame_index"), second.cast("double").alias("ts"),
        F.concat_ws("_", "source", F.floor(second / SHOT_SECONDS).cast("string")).alias("shot_id"), F.col("text").alias("caption"), F.col("lang").alias("object"),
    )


def event_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame an event: the user is the video."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), F.col("event_id").alias("frame_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), F.col("event_type").alias("object"), F.least(F.col("value") / 100, F.lit(1.0)).alias("confidence"), F.get_json_object("props", "$.k").cast("long").alias("track_id"),
    )


def first_filled(*names: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def normalize_frames(raw: DataFrame, fallback_fps: float = 25.0) -> DataFrame:
    """Fill aliases, infer missing times and say where each time comes from.

    An original frame index means video_fps (confidence 1.0, or 0.9 where the rate is the fallback), a timestamp alone
    means interval (0.5), neither means unknown (0.0).
    """
    have = lambda *names: [n for n in names if n in raw.columns] or ["_none"]
    rows = raw.withColumn("_none", F.lit(None).cast("string"))
    rate = F.coalesce(*[F.col(n).cast("double") for n in ("fps", "video_fps") if n in raw.columns], F.lit(None).cast("double"))
    index, time = (F.col(n) if n in raw.columns else F.lit(None).cast("double") for n in ("frame_index", "timestamp"))
    at = F.coalesce(time, F.round(index / F.coalesce(rate, F.lit(fallback_fps)), 6))
    source = F.when(index.isNotNull(), "video_fps").when(time.isNotNull(), "interval").otherwise("unknown")
    sure = F.when(index.isNotNull(), F.when(rate.isNotNull(), 1.0).otherwise(0.9)).when(time.isNotNull(), 0.5).otherwise(0.0)
    path = first_filled(*have("keyframe_path", "frame_path"))
    return rows.select(
        "video_id", "frame_id", index.cast("long").alias("frame_index"), at.alias("timestamp"), source.alias("timestamp_source"), sure.alias("timestamp_confidence"),
        first_filled(*have("caption", "segment_caption", "captions_aggregated")).alias("caption"), path.alias("keyframe_path"), F.coalesce(first_filled(*have("thumbnail_path")), path).alias("thumbnail_path"),
    )
