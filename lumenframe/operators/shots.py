"""Shots from detected scenes, their validation, and the dense candidates of each shot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Reasons for a candidate, in their order, and the defaults in seconds.
REASONS = ("tiny_shot_midpoint", "dense_interval", "shot_boundary_start", "shot_boundary_end", "video_start", "video_end")
INTERVAL, GUARD, TINY = 0.5, 0.2, 0.5


def scenes_to_shots(scenes: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, shot_index from 1, start_frame, end_frame): disjoint shots of scenes (video_id, start_frame, end_frame; both ends
    included) of videos (video_id, frame_count).

    Scenes outside their video are left out, others cut to it; what an earlier scene covers is cut from the beginning of a
    later one. A video that keeps no scene is one shot.
    """
    last = F.col("frame_count") - 1
    inside = scenes.join(videos.select("video_id", "frame_count"), "video_id").where((F.col("end_frame") >= 0) & (F.col("start_frame") <= last))
    cut = inside.select("video_id", F.greatest(F.lit(0), "start_frame").alias("s"), F.least("end_frame", last).alias("e")).where("e >= s")
    # what is kept before a scene ends where the furthest scene before it ends: one that is dropped ends within another
    covered = F.max("e").over(Window.partitionBy("video_id").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    kept = cut.withColumn("_c", covered).select("video_id", F.greatest("s", F.coalesce(F.col("_c") + 1, F.lit(0))).alias("start_frame"), F.col("e").alias("end_frame")).where("end_frame >= start_frame")
    whole = videos.join(kept.select("video_id").distinct(), "video_id", "left_anti").select("video_id", F.lit(0).alias("start_frame"), last.alias("end_frame"))
    rows = kept.unionByName(whole)
    index = F.row_number().over(Window.partitionBy("video_id").orderBy("start_frame"))
    return rows.select("video_id", index.alias("shot_index"), F.col("start_frame").cast("long").alias("start_frame"), F.col("end_frame").cast("long").alias("end_frame"))


def validated(shots: DataFrame) -> DataFrame:
    """Shots (video_id, shot_index, start_frame, end_frame, perhaps frame_count) as they are; an error of the query that reads
    their start_frame where one has negative or crossed ends, reaches beyond its video, repeats a shot_index or overlaps another."""
    order = Window.partitionBy("video_id").orderBy("start_frame", "end_frame", "shot_index")
    rows = shots.withColumns({"_before": F.max("end_frame").over(order.rowsBetween(Window.unboundedPreceding, -1)), "_n": F.count(F.lit(1)).over(Window.partitionBy("video_id", "shot_index"))})
    at = lambda *parts: F.raise_error(F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))
    beyond = F.col("end_frame") >= F.col("frame_count") if "frame_count" in shots.columns else F.lit(False)
    name = F.concat_ws("/", F.col("video_id").cast("string"), F.col("shot_index").cast("string"))
    wrong = (
        F.when((F.col("shot_index") < 0) | (F.col("start_frame") < 0), at("negative number in shot", name))
        .when(F.col("end_frame") < F.col("start_frame"), at("end before start in shot", name))
        .when(F.coalesce(beyond, F.lit(False)), at("end beyond the video in shot", name))
        .when(F.col("_n") > 1, at("duplicate shot_index:", name))
        .when(F.col("start_frame") <= F.col("_before"), at("shots overlap:", name, "starts at", F.col("start_frame"), "before", F.col("_before")))
    )
    return rows.withColumn("start_frame", wrong.otherwise(F.col("start_frame"))).drop("_before", "_n")


def candidates(shots: DataFrame, fps: Column, interval: float = INTERVAL, guard: float = GUARD, tiny: float = TINY, endpoints: bool = False) -> DataFrame:
    """(video_id, shot_index, candidate_id, frame_index, timestamp, shot_start, shot_end, reasons) of valid shots, a row a frame.

    A shot no longer than ``tiny`` seconds, or too short for both its anchors, gives its middle frame. Others give samples every
    ``interval`` seconds from their start (rounded half to even), and an anchor ``guard`` seconds inside each end. With
    ``endpoints`` a video's first and last frame come too. Frames that several reasons give are one row.
    """
    start, end = F.col("start_frame"), F.col("end_frame")
    rounded = lambda x: F.bround(x).cast("long")
    rows = shots.withColumn("_fps", fps.cast("double"))
    inset = rounded(guard * F.col("_fps"))
    first, last = F.least(end, start + inset), F.greatest(start, end - inset)
    is_tiny = ((end - start + 1) / F.col("_fps") <= tiny + 1e-12) | (first >= last)
    step = interval * F.col("_fps")
    n = F.when(step <= 1, end - start).otherwise(F.floor((end - start) / step + 1e-12)).cast("int")
    made = lambda frame, reason: F.struct(F.greatest(start, F.least(end, frame)).cast("long").alias("frame"), F.lit(REASONS.index(reason)).alias("reason"))
    dense = F.transform(F.sequence(F.lit(0), n), lambda i: made(start + F.when(step <= 1, i.cast("long")).otherwise(rounded(i * step)), "dense_interval"))
    whole = F.when(is_tiny, F.array(made(start + F.floor((end - start) / 2), "tiny_shot_midpoint"))).otherwise(F.concat(dense, F.array(made(first, "shot_boundary_start"), made(last, "shot_boundary_end"))))
    if endpoints:
        by = Window.partitionBy("video_id")
        rows = rows.withColumns({"_s": F.min("start_frame").over(by), "_e": F.max("end_frame").over(by)})
        none = F.array().cast("array<struct<frame:bigint,reason:int>>")
        whole = F.concat(whole, F.when(start == F.col("_s"), F.array(made(start, "video_start"))).otherwise(none), F.when(end == F.col("_e"), F.array(made(end, "video_end"))).otherwise(none))
    each = rows.select("video_id", "shot_index", "_fps", start.alias("_b"), end.alias("_z"), F.explode(whole).alias("c"))
    held = each.groupBy("video_id", "shot_index", "_fps", "_b", "_z", F.col("c.frame").alias("frame_index")).agg(F.array_sort(F.collect_set("c.reason")).alias("r"))
    names = F.array(*[F.lit(r) for r in REASONS])
    return held.select(
        "video_id", "shot_index", F.concat(F.lit("CANDIDATE_"), F.col("video_id").cast("string"), F.lit("_"), F.lpad(F.col("frame_index").cast("string"), 9, "0")).alias("candidate_id"), "frame_index",
        (F.col("frame_index") / F.col("_fps")).alias("timestamp"), (F.col("_b") / F.col("_fps")).alias("shot_start"), ((F.col("_z") + 1) / F.col("_fps")).alias("shot_end"), F.transform("r", lambda k: F.get(names, k)).alias("reasons"),
    )
