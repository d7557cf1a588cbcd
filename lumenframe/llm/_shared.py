"""Helpers shared by the training-data operators: reading, checkpoints, joins on group keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Group-level tables of at most this many rows are broadcast; larger ones go through a salted join.
BROADCAST_ROWS = 20_000
SALTS = 64
#: Tables of one row per group are checkpointed in at most this many files.
GROUP_FILES = 16
#: Rows of an Arrow batch that goes to a Python worker (texts can be long, and the session's default is 10,000 rows).
BATCH_ROWS = 1_000
#: Words are runs of anything but the six ASCII white-space characters.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary one in local
    mode (driver and executor are one process there), else an error: executors wouldn't see each other's files."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = f"file://{tempfile.mkdtemp(prefix='lumenframe-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small table with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def checkpoint_groups(df: DataFrame) -> DataFrame:
    """As checkpoint(), for tables of one row per group: a few files instead of one for each shuffle partition."""
    return checkpoint(df.coalesce(GROUP_FILES))


def written(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut the lineage of a large table: write it once as Parquet in the shared folder and read it from there. codec: of Parquet
    (None: the session's)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Within it, shuffle files go when the query that made them has run, not when the driver next happens to collect its
    garbage. For chains of steps that are each written or checkpointed: a data frame made within isn't run twice."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def join_groups(df: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", bound: int | None = None) -> DataFrame:
    """Join rows with a materialised table of one row per group.

    The group table is counted first, unless a bound of its rows is known and given. Up to BROADCAST_ROWS rows it is broadcast; beyond that it is repeated
    SALTS times and joined on (keys, salt), so that a hot group is spread over SALTS tasks. Keys are not null.
    """
    if (groups.count() if bound is None else bound) <= BROADCAST_ROWS:
        return df.join(F.broadcast(groups), keys, how)
    salted = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    spread = df.withColumn("_salt", F.pmod(F.xxhash64(*df.columns[:8]), F.lit(SALTS)).cast("int"))
    return spread.join(salted, [*keys, "_salt"], how).drop("_salt")


def placed(df: DataFrame, group: str | None, order: list[str], name: str = "_pos") -> DataFrame:
    """Append each row's place from 0 in its group (None: among all rows) by ``order``, without a task that holds a group.

    Rows are range-partitioned by group and order, written once with their place in the partition, and shifted by the counts of
    the partitions before. Groups are not null; nulls of ``order`` come first; rows of equal order meet in one partition.
    """
    by = [*([group] if group else []), *order]
    columns = df.columns
    sorted_rows = written(df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in by]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in by]).withColumn("_at", F.monotonically_increasing_id()))
    sorted_rows = sorted_rows.withColumn("_part", F.shiftright("_at", 33))
    keys = [*([group] if group else []), "_part"]
    runs = sorted_rows.groupBy(*keys).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*([group] if group else [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = checkpoint_groups(runs.select(*keys, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")))
    return join_groups(sorted_rows, starts, keys).select(*columns, (F.col("_at") + F.col("_shift")).alias(name))


def fresh(columns: list[str], name: str) -> str:
    """A name that begins like ``name`` and that no column has, whatever the case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> Column:
    """The column of just this name, also where it holds dots or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(columns: list[str], name: str = "_row") -> Column:
    """All columns as one struct, so that helpers' names can't clash with theirs; unpacked() gives them back."""
    return F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(columns)]).alias(name)


def unpacked(columns: list[str], name: str = "_row") -> list[Column]:
    return [F.col(f"{name}.c{k}").alias(c) for k, c in enumerate(columns)]


def numbered(df: DataFrame) -> DataFrame:
    """The columns under plain names, in order: mapInArrow() can't read names with dots, and its functions go by place."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def hand_back() -> None:
    """Give memory that is free in this process back to the system: Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow() in bounded memory: batches of at most BATCH_ROWS rows (a larger setting of the session is lowered, as it
    is read when the plan runs), and workers that give freed memory back at the end of each task."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def bounded(batches):
        try:
            yield from run(batches)
        finally:
            hand_back()

    return df.mapInArrow(bounded, schema)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and bind it to a lambda variable (else each lambda call evaluates it again)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words of a text; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), ASCII_SPACE), lambda w: w != "")
