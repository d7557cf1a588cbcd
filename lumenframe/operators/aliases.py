"""Joins that reject: records named by one of two keys, vectors beside their records, and context tables.

What does not fit is an error of the query that reads the result, with the offending key in its message. The checks sit in
the key columns themselves, so that no pruning of columns can leave them out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _error(*parts: Column | str) -> Column:
    return F.raise_error(F.concat_ws(" ", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]))


def _blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def unique(rows: DataFrame, keys: list[str], what: str) -> DataFrame:
    """The rows as they are; two of one key are an error."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    told = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
    kept = rows.withColumn("_n", n)
    return kept.withColumn(keys[0], F.when(F.col("_n") > 1, _error(f"duplicate {what}:", told).cast(rows.schema[keys[0]].dataType)).otherwise(F.col(keys[0]))).drop("_n")


def alias_table(candidates: DataFrame) -> DataFrame:
    """(video_id, alias, candidate_id, own) of candidates (video_id, candidate_id, frame_id): each candidate by its own id and,
    where it has one, by its frame's. An alias of two candidates is an error; own says that it is a candidate's id."""
    kinds = F.array(F.struct(F.col("candidate_id").alias("alias"), F.lit(True).alias("own")), F.struct(F.col("frame_id").alias("alias"), F.lit(False).alias("own")))
    each = candidates.select("video_id", "candidate_id", F.explode(kinds).alias("a")).select("video_id", "a.alias", "candidate_id", "a.own").where(~_blank(F.col("alias")))
    found = each.groupBy("video_id", "alias").agg(F.min("candidate_id").alias("_a"), F.max("candidate_id").alias("_b"), F.max("own").alias("own"))
    one = F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(_error("candidate alias is ambiguous:", F.col("alias")))
    return found.select("video_id", "alias", one.alias("candidate_id"), "own")


def resolve(records: DataFrame, aliases: DataFrame, what: str) -> DataFrame:
    """Records (video_id, candidate_id, frame_id, ...), each with the candidate that it names, in ``candidate_id``.

    Errors: neither key, a key that no candidate has (a frame's id isn't a candidate's), two keys of different candidates, a
    status other than success, error or skipped (where there is one), two records of one candidate.
    """
    own = aliases.where("own").select("video_id", F.col("alias").alias("candidate_id"), F.col("candidate_id").alias("_c"))
    other = aliases.select("video_id", F.col("alias").alias("frame_id"), F.col("candidate_id").alias("_f"))
    both = records.join(own, ["video_id", "candidate_id"], "left").join(other, ["video_id", "frame_id"], "left")
    named, framed = ~_blank(F.col("candidate_id")), ~_blank(F.col("frame_id"))
    found = (
        F.when(~named & ~framed, _error(f"{what} needs candidate_id or frame_id"))
        .when(named & F.col("_c").isNull(), _error(f"{what}: unknown candidate", F.col("candidate_id")))
        .when(framed & F.col("_f").isNull(), _error(f"{what}: unknown candidate", F.col("frame_id")))
        .when(named & framed & (F.col("_c") != F.col("_f")), _error(f"{what}: different candidates", F.col("candidate_id"), F.col("frame_id")))
    )
    if "status" in records.columns:
        found = found.when(~F.coalesce(F.col("status"), F.lit("success")).isin("success", "error", "skipped"), _error(f"{what}: unknown status", F.col("status")))
    out = both.withColumn("candidate_id", found.otherwise(F.coalesce("_c", "_f"))).drop("_c", "_f")
    return unique(out, ["candidate_id", "video_id"], f"{what} for candidate").select(*records.columns)


def aligned_vectors(vectors: DataFrame, records: DataFrame, aliases: DataFrame) -> DataFrame:
    """(video_id, candidate_id, embedding) with vectors of norm 1, one to one with candidates.

    vectors: video_id, embedding_index, embedding. records: video_id, embedding_index, candidate_id, frame_id, vector_dim,
    normalized (the last two may be null). Errors: a vector without a record or a record without a vector, a wrong
    dimension, values that aren't finite, a norm of 0, one marked as normalised that isn't (by 1/1000), and those of resolve().
    """
    keys = ["video_id", "embedding_index"]
    left = unique(vectors.select(*keys, "embedding"), keys, "embedding row")
    right = resolve(records, aliases, "embedding record")
    both = left.join(unique(right, keys, "embedding record row").withColumn("_there", F.lit(True)), keys, "full")
    e = F.col("embedding")
    norm = F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    fits = (
        F.when(F.col("_there").isNull(), _error("embedding row without a record:", F.col("embedding_index")))
        .when(e.isNull(), _error("embedding record without a row:", F.col("embedding_index")))
        .when(F.col("vector_dim") != F.size(e), _error("vector_dim mismatch at row", F.col("embedding_index")))
        .when(F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), _error("embedding isn't finite:", F.col("candidate_id")))
        .when(F.col("_norm") <= 0, _error("embedding has invalid norm:", F.col("candidate_id")))
        .when(F.coalesce(F.col("normalized"), F.lit(False)) & (F.abs(F.col("_norm") - 1) > 1e-3), _error("embedding is marked normalized but is not:", F.col("candidate_id")))
    )
    unit = F.transform(e, lambda x: (x / F.col("_norm")).cast("float"))
    return both.withColumn("_norm", norm).select("video_id", fits.otherwise(F.col("candidate_id")).alias("candidate_id"), unit.alias("embedding"))


def neighbour_context(records: DataFrame) -> DataFrame:
    """Neighbour records (video_id, frame_id, ...): a missing key or two records of a frame are errors."""
    held = reduce(lambda d, k: d.withColumn(k, F.when(_blank(F.col(k)), _error(f"neighbor record without {k}").cast(records.schema[k].dataType)).otherwise(F.col(k))), ("video_id", "frame_id"), records)
    return unique(held, ["video_id", "frame_id"], "neighbor record")


def segment_members(segments: DataFrame) -> DataFrame:
    """(video_id, segment_id, frame_id, position) of segments (video_id, segment_id, keyframe_ids): positions from 0 among the
    ids that aren't blank. Errors: a missing key, two records of a segment, a frame twice in one or in two of them."""
    held = reduce(lambda d, k: d.withColumn(k, F.when(_blank(F.col(k)), _error(f"segment record without {k}").cast(segments.schema[k].dataType)).otherwise(F.col(k))), ("video_id", "segment_id"), segments)
    once = unique(held, ["video_id", "segment_id"], "segment record")
    filled = F.filter("keyframe_ids", lambda x: ~_blank(x))
    rows = once.select("video_id", "segment_id", F.posexplode(filled).alias("position", "frame_id"))
    return unique(rows, ["video_id", "frame_id"], "frame of segments")


def segment_window(members: DataFrame, segments: DataFrame, targets: DataFrame, limit: int) -> DataFrame:
    """(id, frame_id, rank): the ``limit`` frames of each target's segment that are nearest in position, itself left out, ties
    by position. targets: id, video_id, segment_id, frame_id, timestamp. A frame that the segment doesn't have stands where its
    time falls between the segment's start_time and end_time, in its middle where these don't differ."""
    if limit <= 0:
        raise ValueError("limit must be positive")
    keys = ["video_id", "segment_id"]
    sizes = members.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).join(segments.select(*keys, F.coalesce("start_time", F.lit(0.0)).alias("_b"), F.coalesce("end_time", "start_time", F.lit(0.0)).alias("_e")), keys)
    here = targets.select("id", *keys, F.col("frame_id").alias("_own"), "timestamp").join(sizes, keys).join(members.select(*keys, F.col("frame_id").alias("_own"), F.col("position").alias("_p")), [*keys, "_own"], "left")
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("timestamp") - F.col("_b")) / (F.col("_e") - F.col("_b"))))
    absent = F.when(F.col("_e") > F.col("_b"), F.bround(ratio * (F.col("_n") - 1)).cast("int")).otherwise(F.floor(F.col("_n") / 2).cast("int"))
    at = here.withColumn("_at", F.coalesce("_p", absent))
    span = F.sequence(F.greatest(F.lit(0), F.col("_at") - limit), F.least((F.col("_n") - 1).cast("int"), F.col("_at") + limit))
    near = at.select("id", *keys, "_own", "_at", F.explode(span).alias("position")).join(members, [*keys, "position"]).where(~F.col("frame_id").eqNullSafe(F.col("_own")))
    order = Window.partitionBy("id").orderBy(F.abs(F.col("position") - F.col("_at")), "position")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit).select("id", "frame_id", "rank")


def shot_neighbours(frames: DataFrame, targets: DataFrame, most: int, radius: float = 4.0) -> DataFrame:
    """(id, frame_id, place): for each target the ``most`` nearest other frames, by time distance, then time and id, numbered
    in order of time. targets: id, video_id, frame_id, shot_id, shot_start, shot_end, ts; they need not be frames.

    A target's frames are those of its shot, where it has one, else of its video between shot_start and shot_end, else within
    ``radius`` seconds. Each target finds its place among the times of its shot or video and looks at ``most`` times before and
    after it, of which each shows no more frames than it could give.
    """
    by_shot = F.nullif(F.col("shot_id").cast("string"), F.lit("")).isNotNull()
    spot = F.when(by_shot, F.concat(F.lit("s:"), F.col("shot_id").cast("string"))).otherwise(F.lit("v"))
    ranged = ~by_shot & F.col("shot_start").isNotNull() & F.col("shot_end").isNotNull()
    low = F.when(ranged, F.col("shot_start")).when(~by_shot, F.col("ts") - radius)
    high = F.when(ranged, F.col("shot_end")).when(~by_shot, F.col("ts") + radius)
    wanted = targets.select("id", "video_id", F.col("frame_id").alias("_own"), F.col("ts").alias("_t"), spot.alias("_spot"), low.alias("_lo"), high.alias("_hi"))
    # the nearest times within the range are also nearest to the range's point that is nearest to the target
    wanted = wanted.withColumn("_probe", F.greatest(F.coalesce("_lo", "_t"), F.least(F.coalesce("_hi", "_t"), F.col("_t"))))
    spots = F.array_compact(F.array(F.when(F.nullif(F.col("shot_id").cast("string"), F.lit("")).isNotNull(), F.concat(F.lit("s:"), F.col("shot_id").cast("string"))), F.lit("v")))
    placed = frames.select("video_id", "frame_id", "ts", F.explode(spots).alias("_spot"))
    head = Window.partitionBy("video_id", "_spot", "ts").orderBy("frame_id")
    heads = placed.withColumn("_r", F.row_number().over(head)).where(F.col("_r") <= most + 1)
    times = heads.groupBy("video_id", "_spot", "ts").agg(F.sort_array(F.collect_list("frame_id")).alias("_ids"))
    marks = times.select("video_id", "_spot", F.col("ts").alias("_probe"), F.lit(1).alias("_is"), F.lit(None).cast(targets.schema["id"].dataType).alias("id"))
    probes = wanted.select("video_id", "_spot", "_probe", F.lit(0).alias("_is"), "id")
    order = Window.partitionBy("video_id", "_spot").orderBy("_probe", F.desc("_is")).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.unionByName(probes).withColumn("_at", F.sum("_is").over(order))
    numbered = times.withColumn("_at", F.row_number().over(Window.partitionBy("video_id", "_spot").orderBy("ts")))
    looks = found.where("_is = 0").select("video_id", "_spot", "id", F.explode(F.sequence(F.col("_at") - most, F.col("_at") + most + 1)).alias("_at"))
    seen = looks.join(numbered, ["video_id", "_spot", "_at"]).select("id", "ts", F.explode("_ids").alias("frame_id"))
    able = seen.join(wanted.select("id", "_own", "_t", "_lo", "_hi"), "id").where(~F.col("frame_id").eqNullSafe(F.col("_own")) & (F.coalesce("_lo", "ts") <= F.col("ts")) & (F.col("ts") <= F.coalesce("_hi", "ts")))
    best = able.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(F.abs(F.col("ts") - F.col("_t")), "ts", "frame_id"))).where(F.col("_r") <= most)
    return best.select("id", "frame_id", F.row_number().over(Window.partitionBy("id").orderBy("ts", "frame_id")).alias("place"))
