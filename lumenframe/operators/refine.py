"""Refinement of coarse hits in a window of frames: boundary-aware hypotheses, and ordered paths through them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import vector as V

#: Boundary types that begin with a change, and the shares of the score span and of the largest motion a
#: change must reach.
FIRST = ("first_contact", "first_transition", "first_leave")
LEAVE, PEAK = "first_leave", "peak"
CROSSING, MOTION, FLAT = 0.55, 0.35, 1e-12
#: Weights of the coarse path and of the local confidence.
PATH_WEIGHT, LOCAL_WEIGHT = 0.85, 0.15
MOST_STATES = 100


def window_frames(windows: DataFrame, frames: DataFrame, width: float) -> DataFrame:
    """Frames (video_id, frame, ts, embedding) of each window (window_id, video_id, low, high: seconds, at most ``width`` apart;
    others kept), by a band join: time is cut into buckets of ``width``, of which a window meets two at most."""
    bucket = lambda c: F.floor(c / width)
    wide = F.when(F.col("high") - F.col("low") > width * (1 + 1e-9), F.raise_error(F.lit("a window is wider than the band"))).otherwise(bucket(F.col("high")))
    looks = windows.withColumn("_b", F.explode(F.sequence(bucket(F.col("low")), wide)))
    return looks.join(frames.withColumn("_b", bucket(F.col("ts"))), ["video_id", "_b"]).where((F.col("ts") >= F.col("low")) & (F.col("ts") <= F.col("high"))).drop("_b")


def local_scores(windows: DataFrame, frames: DataFrame, queries: DataFrame, width: float) -> DataFrame:
    """(window_id, frame, score, motion) as local_hypotheses() takes them, from frame embeddings.

    windows: window_id, video_id, event, low, high; frames: video_id, frame, ts, embedding; queries: event, query (one vector
    each). score is the cosine with the event's vector mapped to 0..1, motion 1 less the cosine with the window's frame before
    (0 for the first, at most 1). Vectors need not be of unit length; one without a direction is an error, as is a query's
    of another dimension.
    """
    unit = lambda c, what: F.coalesce(V.normalized(c), F.raise_error(F.concat(F.lit(f"{what} has no direction: "), F.to_json(F.struct(c.alias("v"))))).cast("array<double>"))
    asked = queries.select("event", unit(F.col("query"), "query embedding").alias("_q"))
    rows = window_frames(windows, frames, width).withColumn("_e", unit(F.col("embedding"), "frame embedding")).join(asked, "event")
    fits = F.when(F.size("_q") != F.size("_e"), F.raise_error(F.lit("query and frame embeddings differ in dimension")).cast("double"))
    score = F.coalesce(fits, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (V.dot(F.col("_e"), F.col("_q")) + 1) / 2)))
    before = F.lag("_e").over(Window.partitionBy("window_id").orderBy("frame"))
    moved = F.when(F.col("_p").isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - V.dot(F.col("_e"), F.col("_p")))))
    return rows.withColumn("_p", before).select("window_id", "frame", score.alias("score"), moved.alias("motion"))


def local_hypotheses(scores: DataFrame, windows: DataFrame, limit: int, confirm: int = 2) -> DataFrame:
    """At most ``limit`` ranked frames for each window: (window_id, rank, frame, score, strategy, confidence, source, warning).

    scores: (window_id, frame, score, motion), frames distinct in a window; a window without any motion is judged by scores
    alone. windows: (window_id, boundary, coarse), coarse may be null. Peaks are local maxima, best first. A first change is
    the first frame whose score rises over the crossing share of the span, stays there for ``confirm`` frames, and moves;
    frames near it follow. Other boundaries take the best scores. Flat scores, and motion without a change, keep the frame
    nearest to the coarse one at confidence 0.
    """
    whole, order = Window.partitionBy("window_id"), Window.partitionBy("window_id").orderBy("frame")
    col = F.col
    rows = scores.join(windows.withColumn("boundary", F.coalesce("boundary", F.lit(""))), "window_id").select(
        "*", F.min("score").over(whole).alias("_low"), (F.max("score").over(whole) - F.min("score").over(whole)).alias("_span"), F.count(F.lit(1)).over(whole).alias("_n"), F.row_number().over(order).alias("_p"),
        F.lag("score").over(order).alias("_before"), F.lead("score").over(order).alias("_after"), F.min("score").over(order.rowsBetween(0, confirm - 1)).alias("_held"), F.max("motion").over(whole).alias("_move"),
    )
    line = col("_low") + CROSSING * col("_span")
    moves = col("_move").isNull() | ((col("_move") > 1e-6) & (F.coalesce("motion", F.lit(0.0)) >= MOTION * col("_move")))
    crosses = (col("score") >= line) & (col("_before").isNull() | (col("_before") < line)) & (col("_held") >= line) & (col("_p") + confirm - 1 <= col("_n")) & moves
    peak = (col("_before").isNull() | (col("score") >= col("_before"))) & (col("_after").isNull() | (col("score") >= col("_after")))
    rows = rows.withColumns({
        "_center": F.coalesce("coarse", F.max(F.when(col("_p") == F.floor(col("_n") / 2) + 1, col("frame"))).over(whole)),
        "_first": F.min(F.when(crosses, col("frame"))).over(whole), "_best": F.min(F.struct(-col("score"), col("frame"))).over(whole)["frame"], "_peak": peak,
    })
    flat, starts = col("_span") <= FLAT, col("boundary").isin(*FIRST)
    lost = ~flat & starts & col("_first").isNull() & col("_move").isNotNull()
    off, main = F.abs(col("frame") - col("_center")).cast("double"), F.coalesce("_first", "_best")
    key = lambda a, b: F.struct(a.alias("a"), b.alias("b"), col("frame"))
    ranked = rows.where(flat | (col("boundary") != PEAK) | col("_peak")).withColumn(
        "rank", F.row_number().over(whole.orderBy(F.when(flat | lost, key(off, F.lit(0.0))).when(starts, key(F.abs(col("frame") - main).cast("double"), -col("score"))).otherwise(key(-col("score"), off))))
    )
    strategy = (
        F.when(flat, "flat_local_score_fallback").when(lost, "insufficient_temporal_signal_fallback").when(col("boundary") == PEAK, "local_peak")
        .when(col("boundary") == LEAVE, "first_fully_left_state").when(starts, "first_positive_transition").otherwise("semantic_top_score")
    )
    kept = F.when(lost | (flat & (col("coarse") == col("frame"))), "canonical_metadata").otherwise("local_refinement")
    warning = F.when(flat, "flat_local_score_fallback").when(lost, "insufficient_temporal_boundary_signal")
    sure = F.when(flat | lost, 0.0).otherwise(F.round((col("score") - col("_low")) / col("_span"), 6))
    return ranked.where((col("rank") <= limit) & (~(flat | lost) | (col("rank") == 1))).select(
        "window_id", "rank", "frame", F.round("score", 6).alias("score"), strategy.alias("strategy"), sure.alias("confidence"), kept.alias("source"), warning.alias("warning")
    )


def refined_paths(paths: DataFrame, choices: DataFrame, events: int) -> DataFrame:
    """(path_id, frames, score): rising choices of one frame an event, in a beam of events x choices (100 at most) by mean
    confidence, then frames. A path none of whose choices rise has no row.

    paths: (path_id, score); choices: (path_id, event from 0, frame, confidence).
    """
    per_event = choices.groupBy("path_id", "event").agg(F.count(F.lit(1)).alias("_c"))
    width = per_event.groupBy("path_id").agg(F.least(F.lit(MOST_STATES), events * F.max("_c")).alias("_width"))
    states = paths.join(width, "path_id").select("path_id", F.col("score").alias("_score"), "_width", F.array().cast("array<bigint>").alias("frames"), F.lit(0.0).alias("_sum"))
    for k in range(events):
        own = choices.where(F.col("event") == k).select("path_id", F.col("frame").alias("_f"), F.col("confidence").alias("_c"))
        last = F.try_element_at("frames", F.lit(-1))
        grown = states.join(own, "path_id").where(last.isNull() | (F.col("_f") > last))
        grown = grown.withColumns({"frames": F.concat("frames", F.array(F.col("_f").cast("long"))), "_sum": F.col("_sum") + F.col("_c")}).drop("_f", "_c")
        place = F.row_number().over(Window.partitionBy("path_id").orderBy(F.desc(F.col("_sum") / (k + 1)), "frames"))
        states = grown.withColumn("_r", place).where("_r <= _width").drop("_r")
    return states.select("path_id", "frames", F.round(PATH_WEIGHT * F.col("_score") + LOCAL_WEIGHT * F.col("_sum") / events, 6).alias("score"))
