"""Artifacts and hits mapped to segments, context around frames, audits and reports of selections, and record checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import vector as V
from lumenframe.operators import records as R
from lumenframe.operators.ranks import places

#: Seconds of a bucket of the interval join.
BUCKET_SECONDS = 10
#: Strings that count as true.
TRUE_WORDS = ("1", "true", "yes")


def assign_segments(artifacts: DataFrame, segments: DataFrame, members: DataFrame) -> DataFrame:
    """(artifact_id, segment_id) of each segment an artifact belongs to; artifacts that didn't succeed are left out.

    artifacts: (artifact_id, video_id, frame_id, segment_id, timestamp, status), nulls allowed. The first of frame, segment
    and time that is there decides, also where it leads to nothing; a video that is there must be the segment's.
    segments: (video_id, segment_id, start_time, end_time); members: (frame_id, segment_id, video_id). The interval join
    meets in buckets of time, so a segment is repeated for each bucket it spans.
    """
    good = artifacts.where("status IS NULL OR status = 'success'").select("artifact_id", F.col("video_id").alias("_video"), F.col("frame_id").alias("_frame"), F.col("segment_id").alias("_segment"), F.col("timestamp").alias("_at"))
    same = F.col("_video").isNull() | (F.col("_video") == F.col("video_id"))
    framed = good.where("_frame IS NOT NULL").join(members, F.col("_frame") == F.col("frame_id")).where(same)
    named = good.where("_frame IS NULL AND _segment IS NOT NULL").join(segments, F.col("_segment") == F.col("segment_id")).where(same)
    low, high = (F.floor(F.col(c) / BUCKET_SECONDS) for c in ("start_time", "end_time"))
    spans = segments.withColumn("_bucket", F.explode(F.sequence(low, high)))
    timed = good.where("_frame IS NULL AND _segment IS NULL AND _at IS NOT NULL").withColumn("_bucket", F.floor(F.col("_at") / BUCKET_SECONDS))
    inside = F.col("_at").between(F.col("start_time"), F.col("end_time"))
    here = timed.where("_video IS NOT NULL").join(spans.withColumnRenamed("video_id", "_video"), ["_video", "_bucket"]).where(inside)
    anywhere = timed.where("_video IS NULL").join(spans, "_bucket").where(inside)
    parts = [d.select("artifact_id", "segment_id") for d in (framed, named, here, anywhere)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def canonical_segments(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Hits with the segment of their frame in place of their own where the frame is known; ``mapped`` says whether it is."""
    known = members.select("video_id", "frame_id", F.col("segment_id").alias("_known"))
    rows = hits.join(known, ["video_id", "frame_id"], "left")
    return rows.withColumns({"segment_id": F.coalesce("_known", "segment_id"), "mapped": F.col("_known").isNotNull()}).drop("_known")


def neighbor_context(frames: DataFrame, targets: DataFrame, seconds: float, each_side: int) -> DataFrame:
    """For each target the nearest ``each_side`` frames before and after it in its video, no further than ``seconds`` away.

    They lie at most that many positions away, so that many rows meet a target instead of all rows of its window.
    """
    placed = frames.select("video_id", "frame_id", "ts", "shot_id", F.row_number().over(Window.partitionBy("video_id").orderBy("ts", "frame_id")).alias("_p"))
    here = placed.join(targets.select("frame_id"), "frame_id", "left_semi").select("video_id", F.col("frame_id").alias("target"), F.col("ts").alias("_ts"), F.col("_p").alias("_at"), F.explode(F.sequence(F.col("_p") - each_side, F.col("_p") + each_side)).alias("_p"))
    near = here.where("_p <> _at").join(placed, ["video_id", "_p"]).withColumn("delta_seconds", F.round(F.col("ts") - F.col("_ts"), 6))
    return near.where(F.abs("delta_seconds") <= seconds).select("target", "frame_id", F.col("shot_id").alias("segment_id"), F.when(F.col("_p") < F.col("_at"), "before").otherwise("after").alias("direction"), "delta_seconds")


def segment_captions(frames: DataFrame) -> DataFrame:
    """Per segment its captions in time order joined to sentences, each once whatever its case, spacing and final dots."""
    key = F.rtrim(F.regexp_replace(F.lower(F.trim(F.regexp_replace("caption", r"\s+", " "))), r"\.+$", ""))
    text = F.regexp_replace(F.regexp_replace("caption", r"^\s+|\s+$", ""), r"\.+$", "")
    keyed = frames.select("video_id", "shot_id", "ts", "frame_id", key.alias("_key"), text.alias("_text")).where("_key <> ''")
    first = keyed.groupBy("video_id", "shot_id", F.md5("_key").alias("_key")).agg(F.min(F.struct("ts", "frame_id", "_text")).alias("x"))
    texts = F.transform(F.array_sort(F.collect_list("x")), lambda x: x["_text"])
    return first.groupBy("video_id", "shot_id").agg(F.concat(F.array_join(texts, ". "), F.lit(".")).alias("caption"), F.count(F.lit(1)).alias("kept"))


def adjacent_deltas(frames: DataFrame, seconds: float = 0.75) -> DataFrame:
    """Change between neighbouring frames of (video_id, frame_id, ts, embedding of unit length): (1 - cosine) / 2, for pairs
    whose times differ by more than nothing and at most ``seconds``."""
    order = Window.partitionBy("video_id").orderBy("ts", "frame_id")
    last = frames.select("*", *[F.lag(c).over(order).alias(f"_{c}") for c in ("frame_id", "ts", "embedding")])
    gap = F.col("ts") - F.col("_ts")
    cosine = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), V.dot(F.col("embedding"), F.col("_embedding"))))
    return last.where((gap > 0) & (gap <= seconds)).select("video_id", F.col("_frame_id").alias("left_frame"), F.col("frame_id").alias("right_frame"), ((1 - cosine) / 2).alias("delta"))


def event_quality(score: Column, coverage: Column, has_text: Column) -> Column:
    """A candidate's quality for an event: score and term coverage, or a discounted score where it has no text at all."""
    base = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return F.when(has_text, 0.55 * base + 0.45 * coverage).otherwise(0.85 * base)


def chain_id(events: Column) -> Column:
    """A stable id of an array of structs (video_id, frame_id, shot_id, segment_id, ts): a digest of their lineage."""
    text = lambda c: F.concat(F.coalesce(c.cast("string"), F.lit("")), F.lit("\0"))
    one = lambda e: F.concat(*[text(e[c]) for c in ("video_id", "frame_id", "shot_id", "segment_id")], text(F.format_string("%.6f", e["ts"])))
    return F.concat(F.lit("TC-"), F.substring(F.sha2(F.array_join(F.transform(events, one), ""), 256), 1, 16))


def sampled_frames(shots: DataFrame, margin: float = 0.2) -> DataFrame:
    """Frames to take of each shot (shot_id, start_sec, duration, fps, start_frame, end_frame): its middle under four seconds,
    its thirds up to eight, else one every four seconds from the second on; kept off the ends by ``margin`` seconds."""
    d = F.col("duration")
    offsets = F.when(d < 4, F.array(d / 2)).when(d <= 8, F.array(d / 3, d * 2 / 3)).otherwise(F.transform(F.sequence(F.lit(0), F.ceil((d - 2) / 4).cast("int") - 1), lambda k: 2 + 4.0 * k))
    reason = F.when(d < 4, "midpoint_lt_4s").when(d <= 8, "two_frames_4_to_8s").otherwise("every_4s_gt_8s")
    edge = F.bround(margin * F.col("fps")).cast("long")
    low = F.least(F.col("end_frame"), F.col("start_frame") + edge)
    high = F.greatest(low, F.col("end_frame") - edge)
    at = F.transform(offsets, lambda o: F.greatest(low, F.least(high, F.bround((F.col("start_sec") + o) * F.col("fps")).cast("long"))))
    return shots.select("shot_id", F.explode(F.array_distinct(at)).alias("frame_index"), reason.alias("reason"))


def global_rows(rows: DataFrame, order: str = "frame_id") -> DataFrame:
    """Append row_id: a running number from 0 over videos in order, and in each by ``order``; no task holds a video."""
    return places(rows, [], "video_id", order, name="row_id").withColumn("row_id", F.col("row_id") - 1)


def class_counts(detections: DataFrame, threshold: float) -> DataFrame:
    """Per video the classes detected with at least ``threshold`` confidence: a map in the order of class names, and their number."""
    each = detections.where(F.col("confidence") >= threshold).groupBy("video_id", "object").agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("object", "n")))).alias("counts"), F.sum("n").alias("detections"))


def record_errors(records: DataFrame, required: Sequence[str], key: str = "frame_id") -> DataFrame:
    """One row for each fault of a record: ``schema_error`` with its missing and empty fields, and ``duplicate_frame_id``."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in required]))
    empty = F.array_compact(F.array(*[F.when(F.col(c).cast("string") == "", F.lit(c)) for c in required]))
    faults = records.select(key, F.array_join(missing, ",").alias("missing_fields"), F.array_join(empty, ",").alias("empty_fields"))
    schema = faults.where("missing_fields <> '' OR empty_fields <> ''").select(key, F.lit("schema_error").alias("error"), "missing_fields", "empty_fields")
    again = records.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    twice = records.select(key).join(again, key).select(key, F.lit("duplicate_frame_id").alias("error"), F.lit("").alias("missing_fields"), F.lit("").alias("empty_fields"))
    return schema.unionByName(twice)


def review_coverage(detected: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: reviewed and false protected events, the share of detected ones that were reviewed, and of those the false ones.

    detected: (event_id); reviews: (event_id, is_true_event), one for each event. Ratios of nothing are null.
    """
    rows = detected.select("event_id").distinct().join(reviews, "event_id", "left")
    seen, wrong = F.count("is_true_event"), F.count(F.when(~F.col("is_true_event"), 1))
    return rows.agg(seen.alias("reviewed"), wrong.alias("false_events"), F.round(seen / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("coverage"), F.round(wrong / F.nullif(seen, F.lit(0)), 6).alias("false_rate"))


def selection_audit(candidates: DataFrame, events: DataFrame, selected: DataFrame) -> DataFrame:
    """Per video, by anti joins apart from any selector: protected events without a selected candidate, shots without one.

    candidates: (video_id, frame_id, shot_id); events: (video_id, event_id, frame_id), a row for each candidate of an event.
    """
    chosen = selected.select("frame_id", F.lit(True).alias("_in")).distinct()

    def lost(rows: DataFrame, unit: str, out: str) -> DataFrame:
        held = rows.join(chosen, "frame_id", "left").groupBy("video_id", unit).agg(F.count("_in").alias("_n"))
        return held.groupBy("video_id").agg(F.count(F.when(F.col("_n") == 0, 1)).alias(out))

    both = lost(candidates, "shot_id", "missing_shots").join(lost(events, "event_id", "missing_events"), "video_id", "left").fillna(0, ["missing_events"])
    return both.withColumn("satisfied", (F.col("missing_events") == 0) & (F.col("missing_shots") == 0))


def video_report(candidates: DataFrame, selected: DataFrame, events: DataFrame, durations: DataFrame, max_gap: float, target: int | None = None) -> DataFrame:
    """Per video of ``candidates``: counts, covered shots, protected events with a selected candidate, gaps over ``max_gap``,
    frames a minute, the overrun of a soft ``target``, and status ``passed`` where shots, events and gaps all hold.

    candidates: (video_id, frame_id, shot_id, ts); selected: (frame_id, protected), of the candidates, once each; events:
    (video_id, event_id, frame_id), a row for each supporting candidate; durations: (video_id, duration). Ratios of nothing
    are null.
    """
    chosen = selected.select("frame_id", F.coalesce("protected", F.lit(False)).alias("_p"), F.lit(True).alias("_in"))
    held = candidates.join(chosen, "frame_id", "left")
    shots = held.groupBy("video_id", "shot_id").agg(F.count(F.lit(1)).alias("_n"), F.count("_in").alias("_s"), F.count(F.when(F.col("_p"), 1)).alias("_p"))
    out = shots.groupBy("video_id").agg(
        F.sum("_n").alias("candidate_count"), F.sum("_s").alias("selected_count"), F.sum("_p").alias("protected_selected_count"), F.count(F.lit(1)).alias("shot_count"), F.count(F.when(F.col("_s") > 0, 1)).alias("covered_shot_count")
    )
    each = events.join(chosen, "frame_id", "left").groupBy("video_id", "event_id").agg(F.count("_in").alias("_s"))
    seen = each.groupBy("video_id").agg(F.count(F.lit(1)).alias("event_count"), F.count(F.when(F.col("_s") > 0, 1)).alias("satisfied_event_count"))
    gaps = R.coverage(R.coverage_gaps(held.where("_in"), durations), max_gap).select("video_id", "violations", F.col("max_gap").alias("largest_gap"))
    ratio = lambda a, b: F.round(F.col(a) / F.nullif(F.col(b), F.lit(0)), 6)
    rows = out.join(seen, "video_id", "left").fillna(0, ["event_count", "satisfied_event_count"]).join(durations, "video_id", "left").join(gaps, "video_id", "left")
    rows = rows.withColumns({"shot_recall": ratio("covered_shot_count", "shot_count"), "event_recall": ratio("satisfied_event_count", "event_count")})
    over = F.greatest(F.lit(0), F.col("selected_count") - target) if target is not None else F.lit(None).cast("long")
    passed = (F.coalesce("violations", F.lit(0)) == 0) & (F.col("covered_shot_count") == F.col("shot_count")) & (F.col("satisfied_event_count") == F.col("event_count"))
    return rows.withColumns({
        "keyframes_per_minute": F.when(F.col("duration") > 0, F.round(F.col("selected_count") * 60 / F.col("duration"), 6)).otherwise(0.0),
        "overrun_count": over, "overrun_ratio": F.round(over / F.nullif(F.lit(target), F.lit(0)), 6), "status": F.when(passed, "passed").otherwise("failed"),
    })


def optional(text: Column, kind: str) -> Column:
    """A value of a loosely typed field: null and the empty string are null."""
    return F.nullif(text, F.lit("")).cast(kind)


def truth(text: Column) -> Column:
    """Whether a loosely typed field says yes; null says no."""
    return F.coalesce(F.lower(F.trim(text)).isin(*TRUE_WORDS), F.lit(False))
