"""Queries over streams, with the SQL of the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lumenframe.plans.registry import query
from lumenframe.sources import files
from lumenframe.sources.corpus import table
from lumenframe.streaming import episodes as E

GAP, LATE = 36_000.0, 3_600


@query(f"""WITH e AS (SELECT user_id, event_type, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts)) <= {round(GAP)}000000 THEN 0 ELSE 1 END AS fresh FROM events),
  r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM e),
  s AS (SELECT user_id AS video_id, event_type AS object, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) AS end_us, count(*) AS frames FROM r GROUP BY user_id, event_type, n)
  SELECT * FROM s WHERE end_us + {round(GAP)}000000 <= (SELECT max(epoch_us(ts)) FROM events) - {LATE}000000""")
def streamed_episodes(spark, sf):
    """The event table read as a stream (a pattern: its path may be a file); episodes that may still grow at its end aren't given."""
    at = f"{files.shared_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"
    rows = E.records(spark, f"{sf}/event[s].parquet", table(spark, sf, "events").schema, "parquet")
    frames = rows.select(F.col("user_id").alias("video_id"), F.col("event_type").alias("object"), F.col("event_id").alias("frame_id"), F.col("ts").cast("timestamp").alias("at"))
    E.catch_up(E.episodes(frames, GAP, f"{LATE} seconds"), f"{at}/episodes", f"{at}/checkpoint")
    found = spark.read.parquet(f"{at}/episodes")
    return found.select("video_id", "object", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), "frames")
