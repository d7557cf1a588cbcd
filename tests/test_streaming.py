"""Streamed episodes against a batch over the same files, with late and repeated records, stops and a killed run."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType, TimestampType

from lumenframe.operators import timeline as T
from lumenframe.streaming import episodes as E

SCHEMA = StructType().add("video_id", StringType()).add("object", StringType()).add("frame_id", LongType()).add("at", TimestampType())
START = datetime(2026, 1, 1)


def put(folder, name, rows):
    (folder / f"{name}.json").write_text("".join(json.dumps({"video_id": v, "object": o, "frame_id": i, "at": (START + timedelta(seconds=s)).isoformat()}) + "\n" for v, o, i, s in rows))


def records(rng, n=400):
    """Frames in order of time, with exact gaps, a few of them swapped within a few seconds, and repeats."""
    out, at = [], 0.0
    for i in range(n):
        at += rng.choice([0, 0.5, 1.0, 2.0, 2.0, 2.5, 9.0])
        out.append((f"v{i % 3}", rng.choice("ab"), i, at))
    for i in range(0, n - 2, 7):
        out[i], out[i + 1] = out[i + 1], out[i]
    return [r for x in out for r in ([x, x] if rng.random() < 0.1 else [x])] + [("end", "z", 10**6, at + 1000), ("end", "z", 10**6 + 1, at + 3000)]


def rows_of(df):
    return sorted((r.video_id, r.object, r.start_time, r.end_time, r.frames) for r in df.collect())


@pytest.fixture
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path / "in", f"file://{tmp_path}/out", f"file://{tmp_path}/checkpoint"


def test_stream_equals_batch(spark, folders):
    source, sink, checkpoint = folders
    rows = records(random.Random(1))
    stream = lambda: E.episodes(E.records(spark, f"file://{source}", SCHEMA, files_a_batch=1), 2.0, "30 seconds")
    step = len(rows) // 5
    for k in range(0, len(rows), step):
        put(source, f"part{k:05}", rows[k : k + step])
        E.catch_up(stream(), sink, checkpoint)  # stopped and resumed after each file
    whole = spark.read.schema(SCHEMA).json(f"file://{source}")
    batch = [r for r in rows_of(E.episodes(whole, 2.0)) if r[0] != "end"]
    got = rows_of(spark.read.parquet(sink))
    assert [r for r in got if r[0] != "end"] == batch and len(got) == len(batch) + 1  # the last mark's episode is still open
    # and the batch operator over frames agrees
    frames = whole.dropDuplicates(["frame_id"]).withColumn("ts", F.unix_micros("at") / 1e6)
    runs = T.episodes(frames, 2.0).where("video_id <> 'end'")
    assert sorted((r.video_id, r.object, r.frames) for r in runs.collect()) == sorted((r[0], r[1], r[4]) for r in batch)


def test_nothing_new_adds_nothing(spark, folders):
    source, sink, checkpoint = folders
    put(source, "a", records(random.Random(2), 60))
    stream = lambda: E.episodes(E.records(spark, f"file://{source}", SCHEMA), 2.0, "30 seconds")
    E.catch_up(stream(), sink, checkpoint)
    first = rows_of(spark.read.parquet(sink))
    E.catch_up(stream(), sink, checkpoint)
    assert rows_of(spark.read.parquet(sink)) == first and first


def test_late_records_are_left_out(spark, folders):
    source, sink, checkpoint = folders
    stream = lambda: E.episodes(E.records(spark, f"file://{source}", SCHEMA, files_a_batch=1), 2.0, "30 seconds")
    put(source, "a", [("v", "a", 1, 0), ("v", "a", 2, 500)])
    E.catch_up(stream(), sink, checkpoint)
    put(source, "b", [("v", "a", 3, 1), ("v", "a", 4, 2000)])  # 3 comes long after its time
    E.catch_up(stream(), sink, checkpoint)
    assert [r[4] for r in rows_of(spark.read.parquet(sink))] == [1, 1]


def test_a_failed_run_is_taken_up_again(spark, folders):
    source, sink, checkpoint = folders
    put(source, "a", records(random.Random(4), 60))
    put(source, "b", [("w", "a", 5000, 9000), ("w", "a", 5001, 99000)])
    frames = E.records(spark, f"file://{source}", SCHEMA, files_a_batch=1)
    broken = frames.withColumn("object", F.when(F.col("video_id") == "w", F.raise_error(F.lit("broken"))).otherwise(F.col("object")))
    with pytest.raises(Exception, match="broken"):
        E.catch_up(E.episodes(broken, 2.0, "30 seconds"), sink, checkpoint)
    E.catch_up(E.episodes(frames, 2.0, "30 seconds"), sink, checkpoint)
    whole = E.episodes(spark.read.schema(SCHEMA).json(f"file://{source}"), 2.0)
    assert rows_of(spark.read.parquet(sink)) == [r for r in rows_of(whole) if r[3] < START + timedelta(seconds=99000)]
