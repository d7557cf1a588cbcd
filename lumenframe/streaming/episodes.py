"""Episodes of labels from record files as they arrive, resumable, equal to those of a batch over all files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def records(spark: SparkSession, path: str, schema: StructType, form: str = "json", files_a_batch: int | None = None) -> DataFrame:
    """Record files of a folder as a stream, each file once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader).format(form).load(path)


def episodes(frames: DataFrame, gap: float, late: str = "1 minute", key: str = "frame_id") -> DataFrame:
    """(video_id, object, start_time, end_time, frames) of frames (video_id, object, ``key``, at: timestamp), batch or stream.

    An episode ends after a pause over ``gap`` seconds. Repeated keys of a video count once, on a stream as long as they come within
    ``late`` of each other; frames later than that are left out. A stream gives an episode once it can't grow any more.
    """
    seen = frames.withWatermark("at", late)
    once = seen.dropDuplicatesWithinWatermark(["video_id", key]) if frames.isStreaming else seen.dropDuplicates(["video_id", key])
    sessions = once.groupBy("video_id", "object", F.session_window("at", F.lit(f"{round(gap * 1e6)} microseconds")).alias("w"))
    found = sessions.agg(F.min("at").alias("start_time"), F.max("at").alias("end_time"), F.count(F.lit(1)).alias("frames"))
    return found.select("video_id", "object", "start_time", "end_time", "frames")


def catch_up(stream: DataFrame, sink: str, checkpoint: str) -> int:
    """Take in all that has arrived, append finished episodes to the Parquet table at ``sink``, and stop; how many batches ran.

    Called again, it goes on where it stopped, also after a run that was killed: what the sink holds follows from the
    checkpoint, and no episode is there twice. Both folders must be shared by all machines.
    """
    running = stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception() is not None:
        raise running.exception()
    return len(running.recentProgress)
