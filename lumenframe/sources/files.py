"""Readers of record files, and writers of tables, versioned bundles and answer files.

Paths go through Hadoop's file systems, so they may be local, HDFS or object-store paths alike.
"""

from __future__ import annotations

import csv
import io
import json
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

BAD = "_bad_record"
TASKS = ("kis", "qa", "trake")


def _fs(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    p = hadoop.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def record_files(spark: SparkSession, path: str) -> list[str]:
    """The .json and .jsonl files of a folder, or the file itself, sorted; an error where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        raise FileNotFoundError(path)
    found = sorted(str(s.getPath()) for s in fs.listStatus(p) if s.isFile() and re.search(r"\.jsonl?$", s.getPath().getName(), re.I))
    if not found:
        raise FileNotFoundError(f"no .json or .jsonl file in {path}")
    return found


def keyframe_files(spark: SparkSession, path: str) -> list[str]:
    """Record files, keyframes_*.jsonl alone if there are any; reports and validations are left out."""
    files = [f for f in record_files(spark, path) if not re.search(r"_(report|validation)\.jsonl?$", f)]
    return [f for f in files if re.search(r"/keyframes_[^/]*\.jsonl$", f)] or files


def read_records(spark: SparkSession, paths: str | list[str], schema: StructType, strict: bool = True) -> DataFrame:
    """Records of JSON-lines files. strict: the first malformed line fails the job; else malformed lines are left out."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(paths)
    kept = StructType([*schema.fields, StructField(BAD, StringType())])
    rows = spark.read.schema(kept).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(paths)
    return rows.where(F.col(BAD).isNull()).drop(BAD)


def read_frame_map(spark: SparkSession, path: str, record: StructType) -> DataFrame:
    """Rows (key, ...record) of a file that holds one object of records by key; numeric keys first, in numeric order."""
    maps = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", f"map<string,{record.simpleString()}>")).alias("key", "r"))
    return maps.select("key", "r.*").orderBy(F.col("key").try_cast("long").asc_nulls_last(), "key")


def file_video(path_column: str = "_metadata.file_name") -> Column:
    """The video that a record file is named for."""
    return F.regexp_extract(F.col(path_column), r"^(?:keyframes|captions|ocr|objects|segments)_(.*)\.jsonl?$", 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one in local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def settled(df: DataFrame) -> DataFrame:
    """Cut a table's lineage: write it once in the shared folder and read it from there."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of whole texts that goes to a Python worker (the session's default is 10,000 rows).
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the rows of an Arrow batch to BATCH_ROWS where they are more: texts can be long, and a batch is whole in memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def digest(df: DataFrame) -> str:
    """A fingerprint of a table's rows that doesn't depend on their order: an exact sum of row hashes, with the row count."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    word = lambda k: F.conv(F.substring(row, 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    got = df.agg(F.count(F.lit(1)), *[F.sum(word(k)) for k in range(4)]).first()
    return "-".join(str(v or 0) for v in got)


class Busy(RuntimeError):
    """Another writer has claimed the place, or has changed it meanwhile."""


class Claim:
    """The right to replace CURRENT below a path. ``with Claim(spark, path) as c:`` ... ``c.commit(text)``.

    A mark, PUBLISHING, says who is writing; a second writer is refused while it is there, and so is a commit after the mark or
    CURRENT changed hands. The mark goes when the block ends, also with an error; a writer that is killed leaves it, readers
    keep to the old CURRENT, and abandon() makes way for the next.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.token = spark, path, uuid.uuid4().hex

    def _text(self, name: str) -> str | None:
        fs, p = _fs(self.spark, f"{self.path}/{name}")
        return get(self.spark, f"{self.path}/{name}") if fs.exists(p) else None

    def __enter__(self) -> Claim:
        fs, p = _fs(self.spark, f"{self.path}/PUBLISHING")
        if fs.exists(p):
            raise Busy(f"{self.path}: {self._text('PUBLISHING')} is publishing")
        out = fs.create(p, False)
        out.write(bytearray(self.token.encode()))
        out.close()
        self.base = self._text("CURRENT")
        self._hold()
        return self

    def _hold(self) -> None:
        if self._text("PUBLISHING") != self.token or self._text("CURRENT") != self.base:
            raise Busy(f"{self.path} was taken over by another writer")

    def commit(self, text: str) -> None:
        self._hold()
        replace(self.spark, f"{self.path}/CURRENT", text)
        self.base = text

    def __exit__(self, *error) -> None:
        if self._text("PUBLISHING") == self.token:
            abandon(self.spark, self.path)


def abandon(spark: SparkSession, path: str) -> None:
    """Take away the mark of a writer that will not come back."""
    fs, p = _fs(spark, f"{path}/PUBLISHING")
    fs.delete(p, False)


def publish(df: DataFrame, path: str, partition_by: list[str] | None = None) -> str:
    """Write a table as a new generation below ``path`` and then point CURRENT at it. Readers see the old one or the new one; a
    second writer meanwhile is refused."""
    spark, name = df.sparkSession, f"gen={uuid.uuid4().hex}"
    writer = df.write.mode("errorifexists")
    with Claim(spark, path) as claim:
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{name}")
        saved = spark.read.schema(df.schema).parquet(f"{path}/{name}")
        manifest = {"generation": name, "rows": saved.count(), "digest": digest(saved), "columns": sorted(df.columns)}
        claim.commit(json.dumps(manifest, sort_keys=True))
    return name


def load(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """The current generation of a published table; with ``verify`` its rows must match the manifest."""
    manifest = json.loads(get(spark, f"{path}/CURRENT"))
    df = spark.read.parquet(f"{path}/{manifest['generation']}")
    if sorted(df.columns) != manifest["columns"] or (verify and digest(df) != manifest["digest"]):
        raise ValueError(f"{path}: {manifest['generation']} differs from its manifest")
    return df


def _put(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def replace(spark: SparkSession, path: str, text: str) -> None:
    """Write beside the file, then rename over it: readers see the old text or the new one."""
    hadoop, new = spark._jvm.org.apache.hadoop.fs, f"{path}.{uuid.uuid4().hex}"
    _put(spark, new, text)
    context = hadoop.FileContext.getFileContext(hadoop.Path(path).toUri(), spark._jsc.hadoopConfiguration()) if hadoop.Path(path).toUri().getScheme() else hadoop.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(hadoop.Path(new), hadoop.Path(path), options)


def get(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def answer_file_name(query_id: str) -> tuple[str, str]:
    """(file name, task) of an official query id such as query-p1-3-kis, with or without .csv or .txt."""
    cleaned = re.sub(r"\.(csv|txt)$", "", query_id.strip(), flags=re.I)
    m = re.fullmatch(rf"query-[A-Za-z0-9][A-Za-z0-9_-]*-({'|'.join(TASKS)})", cleaned)
    if not m:
        raise ValueError(f"not an official query id: {query_id!r}")
    return f"{cleaned}.csv", m[1]


def answer_csv(ranked: DataFrame, task: str, events: int | None = None, most: int = 100) -> str:
    """A headless CSV with CRLF of at most 100 ranked answers: video and frame, the answer too (qa), a frame an event (trake).

    Rows come by rank; rows without an original frame and repeats are left out.
    """
    if task not in TASKS:
        raise ValueError(f"unknown task: {task}")
    if not 1 <= most <= 100:
        raise ValueError("an answer file holds 1 to 100 rows")
    columns = {"kis": ["video_id", "frame_index"], "qa": ["video_id", "frame_index", "answer"], "trake": ["video_id", "frames"]}[task]
    good = F.col("video_id").isNotNull() & (F.trim("video_id") != "")
    if task == "trake":
        good &= (F.size("frames") == events) & ~F.exists("frames", lambda f: f.isNull() | (f < 0))
    else:
        good &= F.col("frame_index") >= 0
    once = ranked.where(good).groupBy(*columns).agg(F.min("rank").alias("rank")).orderBy("rank", *columns).limit(most)
    out = io.StringIO(newline="")
    writer = csv.writer(out, lineterminator="\r\n")
    for r in once.collect():  # at most 100
        writer.writerow([r.video_id, *r.frames] if task == "trake" else [r[c] for c in columns])
    return out.getvalue()


def write_answers(ranked: DataFrame, folder: str, query_id: str, events: int | None = None) -> str:
    """Write a query's answer file and return its path."""
    name, task = answer_file_name(query_id)
    _put(ranked.sparkSession, f"{folder}/{name}", answer_csv(ranked, task, events))
    return f"{folder}/{name}"


def append_missing(new: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose keys the Parquet table doesn't have yet; returns how many."""
    spark = new.sparkSession
    fs, p = _fs(spark, path)
    first = new.dropDuplicates(keys)
    if fs.exists(p):
        first = first.join(spark.read.schema(new.schema).parquet(path).select(*keys), keys, "left_anti")
    before = spark.read.parquet(path).count() if fs.exists(p) else 0
    first.write.mode("append").parquet(path)
    return spark.read.parquet(path).count() - before
