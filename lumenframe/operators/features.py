"""Scores and protected events of recognised texts, objects and captions, by video.

Texts that read alike form tracks; tracks all over a video (station logos) and lines near the bottom (subtitles) count little.
What is left of a track or an object class splits into episodes; those that are new and last, or are very sure, are events.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenframe.functions import text as X
from lumenframe.operators import records as R
from lumenframe.operators.similar import fuzzy_clusters


@dataclass(frozen=True)
class Rules:
    """What an observation must have to make an event, and how episodes part."""

    min_confidence: float
    extreme_confidence: float
    min_area: float
    extreme_area: float
    rare_fraction: float
    persistence: int = 2
    gap: float = 1.25
    cooldown: float = 5.0


#: Fixed values.
TEXT_RULES = Rules(0.75, 0.95, 0.002, 0.002, 0.08)
OBJECT_RULES = Rules(0.65, 0.90, 0.01, 0.02, 0.05)
SIMILAR_PERCENT, SPATIAL_TOLERANCE = 82, 0.08
COMMON_FRACTION, COMMON_FRAMES = 0.20, 5
SUBTITLE_FROM, SUBTITLE_AREA = 0.78, 0.03
MIN_LETTERS = 4
COMMON_FACTOR, SUBTITLE_FACTOR = 0.10, 0.35


@F.pandas_udf(StringType())  # a type's name can't be parsed before there is a session
def folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).strip().casefold(), na_action="ignore")


def comparison(text: Column) -> Column:
    """Text to compare by: compatibility-composed, case folded, punctuation as blanks, single blanks; null gives an empty one."""
    words = F.regexp_replace(F.coalesce(folded(text), F.lit("")), r"(?U)[^\p{L}\p{N}_\s]", " ")
    return F.regexp_replace(F.regexp_replace(words, r"(?U)\s+", " "), "^ | $", "")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def text_tracks(frames: DataFrame, regions: DataFrame) -> DataFrame:
    """Observations with their track and score.

    frames: video_id, shot_id, one row for each frame_id that was read. regions: video_id, shot_id, frame_id, frame_index, ts,
    text, confidence, area, cx, cy (shares of the image; null where unknown). Regions without a word are left out. Appends key
    (the text to compare by), track, subtitle, common, fraction (of the video's frames), quality and score.
    """
    rows = regions.withColumn("key", comparison(F.col("text"))).where("key <> ''")
    tracks = fuzzy_clusters(rows, F.col("video_id"), F.col("key"), SIMILAR_PERCENT).select(F.col("grp").alias("video_id"), F.col("text").alias("key"), F.col("cluster").alias("track"))
    seen = frames.groupBy("video_id").agg(F.countDistinct("frame_id").alias("_frames"), F.countDistinct("shot_id").alias("_shots"))
    named = rows.join(tracks, ["video_id", "key"])
    wide = lambda c: F.coalesce(F.max(c) - F.min(c), F.lit(0.0))
    spread = named.groupBy("video_id", "track").agg(F.countDistinct("frame_id").alias("_n"), F.countDistinct("shot_id").alias("_s"), F.greatest(wide("cx"), wide("cy")).alias("_wide"))
    share = F.col("_n") / F.col("_frames")
    common = (F.col("_n") >= COMMON_FRAMES) & (share >= COMMON_FRACTION) & (F.col("_s") / F.col("_shots") >= COMMON_FRACTION) & (F.col("_wide") <= 2 * SPATIAL_TOLERANCE)
    judged = spread.join(seen, "video_id").select("video_id", "track", share.alias("fraction"), common.alias("common"))
    quality = X.unit(R.ocr_quality(F.col("confidence"), letters(F.col("key")), F.coalesce("area", F.lit(0.0))))
    subtitle = F.coalesce((F.col("cy") >= SUBTITLE_FROM) & (F.col("area") <= SUBTITLE_AREA), F.lit(False))
    out = named.join(judged, ["video_id", "track"]).withColumns({"quality": quality, "subtitle": subtitle})
    factor = F.when(F.col("common"), COMMON_FACTOR).when(F.col("subtitle"), SUBTITLE_FACTOR).otherwise(0.5 + 0.5 * X.unit(1 - F.col("fraction")))
    return out.withColumn("score", X.unit(F.col("quality") * factor))


def object_tracks(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """As text_tracks() for detections (video_id, frame_id, frame_index, ts, class_name, class_id, confidence, area): a track is
    a class. A detection without a class is an error."""
    name = comparison(F.col("class_name"))
    rows = detections.withColumn("key", F.when(name == "", F.raise_error(F.lit("an object needs a class name"))).otherwise(name))
    rows = rows.withColumn("track", F.concat(F.coalesce(F.col("class_id").cast("string"), F.lit("name")), F.lit(":"), "key"))
    seen = frames.groupBy("video_id").agg(F.countDistinct("frame_id").alias("_frames"))
    share = rows.groupBy("video_id", "track").agg(F.countDistinct("frame_id").alias("_n")).join(seen, "video_id").select("video_id", "track", (F.col("_n") / F.col("_frames")).alias("fraction"))
    quality = X.unit(R.object_quality(F.col("confidence"), F.coalesce("area", F.lit(0.0))))
    out = rows.join(share, ["video_id", "track"]).withColumn("quality", quality)
    return out.withColumn("score", X.unit(F.col("quality") * (0.5 + 0.5 * X.unit(1 - F.col("fraction")))))


def track_episodes(rows: DataFrame, rules: Rules, moves: bool) -> DataFrame:
    """Episodes of each track of eligible observations (video_id, track, key, frame_id, frame_index, ts, fraction, extreme and,
    with ``moves``, cx and cy): number, range, frames in order, and whether the episode is an event.

    An episode ends after a pause over the gap or, with ``moves``, where the text jumps. It is new if it is its track's first,
    or the track is rare and away for the cooldown since the episode before, whatever became of that one.
    """
    order = Window.partitionBy("video_id", "track").orderBy("ts", "frame_id", "key")
    parts = F.col("ts") - F.lag("ts").over(order) > rules.gap
    if moves:
        jump = lambda c: F.coalesce(F.abs(F.col(c) - F.lag(c).over(order)) > SPATIAL_TOLERANCE, F.lit(False))
        parts = parts | jump("cx") | jump("cy")
    run = rows.withColumn("episode", F.sum(F.coalesce(parts, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    frame = F.struct("ts", "frame_index", "frame_id")
    each = run.groupBy("video_id", "track", "episode").agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.array_sort(F.collect_set(frame)).alias("_f"), F.max("extreme").alias("_extreme"), F.first("fraction").alias("_fraction"))
    pause = F.col("start_time") - F.lag("end_time").over(Window.partitionBy("video_id", "track").orderBy("episode"))
    new = (F.col("episode") == 1) | ((F.col("_fraction") <= rules.rare_fraction) & (pause >= rules.cooldown))
    kept = new & ((F.size("_f") >= rules.persistence) | F.col("_extreme"))
    return each.select("video_id", "track", "episode", "start_time", "end_time", F.col("_f.frame_id").alias("frame_ids"), F.col("_f")[0]["frame_index"].alias("first_index"), kept.alias("kept"))


def text_episodes(tracks: DataFrame, rules: Rules = TEXT_RULES) -> DataFrame:
    big = F.col("area").isNull() | (F.col("area") >= rules.min_area)
    able = tracks.where(~F.col("common") & ~F.col("subtitle") & (F.col("confidence") >= rules.min_confidence) & (letters(F.col("key")) >= MIN_LETTERS) & big)
    return track_episodes(able.withColumn("extreme", F.col("confidence") >= rules.extreme_confidence), rules, True)


def object_episodes(tracks: DataFrame, rules: Rules = OBJECT_RULES) -> DataFrame:
    able = tracks.where((F.col("confidence") >= rules.min_confidence) & (F.col("area") >= rules.min_area))
    return track_episodes(able.withColumn("extreme", (F.col("confidence") >= rules.extreme_confidence) & (F.col("area") >= rules.extreme_area)), rules, False)


def protected_events(episodes: DataFrame, prefix: str, kind: str, priority: int) -> DataFrame:
    """video_id, event_id, event_type, priority, frame_ids of the episodes that are events."""
    sha = F.substring(F.sha1(F.concat(F.col("video_id").cast("string"), F.lit("\x00"), "track").cast("binary")), 1, 12)
    name = F.concat_ws("_", F.lit(prefix), F.col("video_id").cast("string"), sha, F.lpad(F.col("first_index").cast("string"), 9, "0"))
    return episodes.where("kept").select("video_id", name.alias("event_id"), F.lit(kind).alias("event_type"), F.lit(priority).alias("priority"), "frame_ids")


def transition_events(kept: DataFrame, priority: int = 3) -> DataFrame:
    """Two events for each kept boundary (video_id, left_frame, right_frame and their left_index, right_index): its last
    frame before and its first one after."""
    key = F.concat(F.col("left_frame").cast("string"), F.lit("->"), F.col("right_frame").cast("string"))
    sha = F.substring(F.sha1(F.concat(F.col("video_id").cast("string"), F.lit("\x00"), key).cast("binary")), 1, 12)

    def side(name: str, which: str) -> Column:
        told = F.concat_ws("_", F.lit(f"TRANSITION_{name.upper()}"), F.col("video_id").cast("string"), sha, F.lpad(F.col(f"{which}_index").cast("string"), 9, "0"))
        return F.struct(told.alias("event_id"), F.lit(f"semantic_transition_{name}").alias("event_type"), F.array(f"{which}_frame").alias("frame_ids"))

    each = kept.select("video_id", F.explode(F.array(side("pre", "left"), side("post", "right"))).alias("e"))
    return each.select("video_id", "e.event_id", "e.event_type", F.lit(priority).alias("priority"), "e.frame_ids")


def frame_features(frames: DataFrame, scores: dict[str, tuple[DataFrame, DataFrame]], events: DataFrame | None = None) -> DataFrame:
    """One row a frame of (video_id, frame_id): a score for each component, 0 where it found nothing and null where the frame
    wasn't examined for it, the importance over those there, and the ids of the events that hold the frame.

    scores: by component the frames examined for it and the (video_id, frame_id, score) found there, of which the best counts.
    """
    keys, out = ["video_id", "frame_id"], frames
    for name, (examined, found) in scores.items():
        best = found.groupBy(*keys).agg(F.max("score").alias("_s"))
        out = out.join(examined.select(*keys).distinct().join(best, keys, "left").select(*keys, F.coalesce("_s", F.lit(0.0)).alias(name)), keys, "left")
    out = out.withColumn("importance", R.importance({n: F.col(n) for n in scores}))
    if events is not None:
        held = events.select("video_id", "event_id", F.explode("frame_ids").alias("frame_id")).groupBy(*keys).agg(F.array_sort(F.collect_set("event_id")).alias("event_ids"))
        out = out.join(held, keys, "left").withColumn("event_ids", F.coalesce("event_ids", F.array().cast("array<string>")))
    return out
