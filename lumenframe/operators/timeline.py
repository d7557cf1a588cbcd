"""Operators along a video's time: neighbours, segments, gaps, episodes, novelty, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.functions import text as X
from lumenframe.sources.files import settled


def neighbours(frames: DataFrame, seconds: float) -> DataFrame:
    """Frames of the same video strictly before and after within the window, each with its distance in seconds."""
    w = Window.partitionBy("video_id").orderBy("micros").rangeBetween(int(-seconds * 1e6), int(seconds * 1e6))
    near = frames.withColumn("_near", F.collect_list(F.struct("micros", "frame_id")).over(w))
    side = lambda keep: F.transform(F.array_sort(F.filter("_near", keep)), lambda x: F.struct(x["frame_id"].alias("frame_id"), ((x["micros"] - F.col("micros")) / 1e6).alias("delta_seconds")))
    return near.select("video_id", "frame_id", side(lambda x: x["micros"] < F.col("micros")).alias("before"), side(lambda x: x["micros"] > F.col("micros")).alias("after"))


def neighbour_counts(frames: DataFrame, seconds: float) -> DataFrame:
    """How many frames lie strictly before and after within the window; no lists are built."""
    span, order = int(seconds * 1e6), Window.partitionBy("video_id").orderBy("micros")
    n = lambda a, b: F.count(F.lit(1)).over(order.rangeBetween(a, b))
    return frames.select("video_id", "frame_id", n(-span, -1).alias("n_before"), n(1, span).alias("n_after"))


def same_shot(frames: DataFrame, most: int) -> DataFrame:
    """The ``most`` nearest other frames of each frame's shot, by time distance, then time and id.

    They are among the first most + 1 frames (by id) of the frame's own time, of the ``most`` times before and of the
    ``most`` after it, so each frame looks at a bounded pool, however large its shot.
    """
    # the first frames of a time stand for it: no more than most + 1 of one time can be among a frame's nearest
    placed = frames.select("shot_id", "frame_id", "ts")
    heads = placed.withColumn("_r", F.row_number().over(Window.partitionBy("shot_id", "ts").orderBy("frame_id"))).where(F.col("_r") <= most + 1)
    other = F.struct(F.col("ts").alias("t"), F.col("frame_id").alias("f"))
    # by distinct time: what lies around each time, gathered once
    times = heads.groupBy("shot_id", "ts").agg(F.sort_array(F.collect_list(other)).alias("_own"))
    around = Window.partitionBy("shot_id").orderBy("ts").rowsBetween(-most, most)
    pool = times.select("shot_id", "ts", F.flatten(F.collect_list("_own").over(around)).alias("_pool"))
    rows = placed.join(pool, ["shot_id", "ts"])
    ranked = F.slice(F.array_sort(F.transform(F.filter("_pool", lambda o: o["f"] != F.col("frame_id")), lambda o: F.struct(F.abs(o["t"] - F.col("ts")).alias("d"), o["t"].alias("t"), o["f"].alias("f")))), 1, most)
    return rows.select("frame_id", F.posexplode(ranked).alias("_p", "o")).select("frame_id", F.col("o.f").alias("other"), (F.col("_p") + 1).alias("rank"))


def segments(frames: DataFrame, seconds: float) -> DataFrame:
    """Fixed windows of each video: range, number of frames, first and last frame."""
    at = F.floor(F.col("ts") / seconds).cast("long")
    pick = F.struct("ts", "frame_id")
    return frames.groupBy("video_id", at.alias("segment")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("frames"), F.min(pick)["frame_id"].alias("first_frame"), F.max(pick)["frame_id"].alias("last_frame"))


def objects_of(frames: DataFrame, seconds: float) -> DataFrame:
    """For each segment and label: best confidence, first and last time, distinct tracks."""
    at = F.floor(F.col("ts") / seconds).cast("long")
    return frames.groupBy("video_id", at.alias("segment"), "object").agg(F.round(F.max("confidence"), 6).alias("confidence"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.countDistinct("track_id").alias("tracks"))


def gaps(frames: DataFrame) -> DataFrame:
    """Per video over distinct times: number, largest, mean and 95th percentile of the gaps between neighbours."""
    t = frames.select("video_id", "ts").distinct()
    gap = t.withColumn("gap", F.col("ts") - F.lag("ts").over(Window.partitionBy("video_id").orderBy("ts"))).where("gap IS NOT NULL")
    return gap.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("gap"), 6).alias("max_gap"), F.round(F.avg("gap"), 6).alias("mean_gap"), F.round(F.percentile("gap", F.lit(0.95)), 6).alias("p95_gap"))


def episodes(frames: DataFrame, max_gap: float) -> DataFrame:
    """Runs of one label in a video without a gap over max_gap: number, range, frames, and the pause before."""
    order = Window.partitionBy("video_id", "object").orderBy("ts", "frame_id")
    broken = frames.withColumn("_new", F.when(F.col("ts") - F.lag("ts").over(order) <= max_gap, 0).otherwise(1))
    run = broken.withColumn("episode", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    each = run.groupBy("video_id", "object", "episode").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count(F.lit(1)).alias("frames"))
    before = F.lag("end_time").over(Window.partitionBy("video_id", "object").orderBy("episode"))
    return each.withColumn("pause", F.round(F.col("start_time") - before, 6))


def reappearing(runs: DataFrame, pause: float) -> DataFrame:
    """First episodes, and those at least ``pause`` seconds after the one before."""
    return runs.where(F.col("pause").isNull() | (F.col("pause") >= pause))


def caption_novelty(frames: DataFrame) -> DataFrame:
    """1 - Jaccard of a caption's distinct tokens with the previous non-empty caption of its video; first: .5.

    Only ids go through a video's window. Tokens are written once with an id of their row and meet by it, so that no task
    reads the tokens of a video.
    """
    words = F.array_distinct(X.tokens(F.col("caption")))
    held = settled(frames.select("video_id", "frame_id", "ts", words.alias("_w")).withColumn("_id", F.monotonically_increasing_id()))
    order = Window.partitionBy("video_id").orderBy("ts", "frame_id", "_id")
    last = F.last(F.when(F.col("_said"), F.col("_id")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    led = held.select("_id", "video_id", "ts", "frame_id", (F.size("_w") > 0).alias("_said")).select("_id", last.alias("_before"))
    before = held.select(F.col("_id").alias("_before"), F.col("_w").alias("_p"))
    rows = held.select("_id", "video_id", "frame_id", "_w").join(led, "_id").join(before, "_before", "left")
    return rows.select("video_id", "frame_id", F.round(F.when(F.col("_p").isNull(), 0.5).otherwise(1 - X.jaccard(F.col("_w"), F.col("_p"))), 6).alias("novelty"))


def robust_threshold(values: DataFrame, floor: float = 0.18, factor: float = 2.5) -> DataFrame:
    """Per video: median + factor * median absolute deviation, at least the floor."""
    mid = values.groupBy("video_id").agg(F.median("value").alias("med"))
    return values.join(mid, "video_id").groupBy("video_id").agg(F.round(F.greatest(F.lit(floor), F.first("med") + factor * F.median(F.abs(F.col("value") - F.col("med")))), 6).alias("threshold"))


def boundary_position(frames: DataFrame) -> DataFrame:
    """Place of each frame between the first (0) and last (1) of its shot."""
    w = Window.partitionBy("video_id", "shot_id")
    width = F.max("ts").over(w) - F.min("ts").over(w)
    return frames.select("video_id", "frame_id", F.round(F.when(width == 0, 0.0).otherwise((F.col("ts") - F.min("ts").over(w)) / width), 6).alias("position"))


def bins(frames: DataFrame, n: int = 4) -> DataFrame:
    """Time bins inside each clip, and how many frames each has."""
    w = Window.partitionBy("video_id", "shot_id")
    low, high = F.min("ts").over(w), F.max("ts").over(w)
    at = F.least(F.lit(n - 1), F.floor((F.col("ts") - low) / F.greatest(high - low, F.lit(1e-9)) * n)).cast("int")
    return frames.select("video_id", "shot_id", at.alias("bin")).groupBy("video_id", "shot_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def dense_candidates(shots: DataFrame, interval: int) -> DataFrame:
    """Sampled frames of each shot (video_id, shot_id, start_frame, end_frame): every interval, and both ends."""
    steps = F.transform(F.sequence(F.lit(0), F.floor((F.col("end_frame") - F.col("start_frame")) / interval).cast("int")), lambda i: F.struct((F.col("start_frame") + i * interval).alias("frame"), F.lit("interval").alias("reason")))
    ends = F.array(F.struct(F.col("start_frame").alias("frame"), F.lit("start").alias("reason")), F.struct(F.col("end_frame").alias("frame"), F.lit("end").alias("reason")))
    each = shots.select("video_id", "shot_id", F.explode(F.concat(steps, ends)).alias("c")).select("video_id", "shot_id", "c.frame", "c.reason")
    return each.groupBy("video_id", "shot_id", "frame").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


def overlapping(shots: DataFrame) -> DataFrame:
    """Shots that start at or before the largest end of the shots before them."""
    before = F.max("end_frame").over(Window.partitionBy("video_id").orderBy("start_frame", "end_frame", "shot_id").rowsBetween(Window.unboundedPreceding, -1))
    return shots.withColumn("_b", before).where(F.col("start_frame") <= F.col("_b")).drop("_b")


def nearest_clip(hits: DataFrame, dense: DataFrame) -> DataFrame:
    """For each hit (id, video_id, ts) the nearest frame in time of the same video in ``dense``, ties by the earlier id.

    Hits and dense frames are merged in order of time; the last dense time before a hit and the next one after it are its
    only candidates, so no hit meets a whole video. Both windows grow from their start: one that ends at a video's last row
    would be gone through anew for each row.
    """
    marks = dense.groupBy("video_id", "ts").agg(F.min("frame_id").alias("frame"))
    kinds = marks.select("video_id", "ts", F.struct("ts", "frame").alias("mark"), F.lit(None).cast(hits.schema["id"].dataType).alias("id")).unionByName(hits.select("video_id", "ts", F.lit(None).cast(T.StructType([T.StructField("ts", marks.schema["ts"].dataType), T.StructField("frame", marks.schema["frame"].dataType)])).alias("mark"), "id"))
    so_far = lambda order: F.last("mark", ignorenulls=True).over(Window.partitionBy("video_id").orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
    before, after = so_far(F.asc("ts")), so_far(F.desc("ts"))
    found = kinds.select("id", "ts", before.alias("b"), after.alias("a")).where("id IS NOT NULL")
    each = F.array_compact(F.transform(F.array("b", "a"), lambda m: F.when(m.isNotNull(), F.struct(F.abs(m["ts"] - F.col("ts")).alias("d"), m["frame"].alias("nearest")))))
    best = found.select("id", F.array_min(each).alias("m")).where("m IS NOT NULL")
    return best.select("id", "m.nearest", F.round("m.d", 6).alias("distance"))
