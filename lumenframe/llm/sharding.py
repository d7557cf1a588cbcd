"""Shards by fixed virtual slots.

Records are hashed by key into SLOTS virtual slots. Bytes are summed for each slot, and a stored, versioned map gives each
slot a shard. Rebalancing edits the latest version, leaving slots where they are as far as equal bytes allow, and writes the
next one; records never move between slots. All steps are SQL; a map has SLOTS rows, always.

Size of a record: UTF-8 bytes of the text (null: none) plus 16. Null keys hash like the empty string. Repeated rows are
records of their own; an empty table gives an empty table. Operators read only the columns they name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenframe.llm._shared import checkpoint, shared_dir

SLOTS = 4096
OVERHEAD = 16


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The first eight hex digits of the key's MD5, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def slot_sizes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(vslot, bytes, n) of each of the slots, empty ones too. records: (vslot, size)."""
    used = records.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    return every.join(used, "vslot", "left").na.fill(0, ["bytes", "n"])


def _least(loads: Column) -> Column:
    """Position from 0 of the first smallest load."""
    return (F.array_position(loads, F.array_min(loads)) - 1).cast("int")


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 1, before anything is known of sizes: slots go round the shards."""
    return spark.range(slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), (F.col("id") % shards).cast("int").alias("shard"))


def rebalanced(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version of a map: an edit of ``old`` that makes the shards' bytes nearly equal.

    In descending order of size, a slot stays in its shard where that doesn't take it over the mean, and else goes to the
    shard with the fewest bytes. old, sizes ((vslot, bytes) of all slots): fixed numbers of rows.
    """
    both = sizes.join(old, "vslot")
    ranked = both.agg(F.max("version").alias("version"), F.sum("bytes").alias("total"), F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("less"), "vslot", F.col("shard").alias("old")))).alias("all"))
    state = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<struct<vslot:int,shard:int>>").alias("put"))

    def put(a: Column, s: Column) -> Column:
        def at(i: Column) -> Column:
            return F.struct(F.transform(a["loads"], lambda x, k: x - F.when(k == i, s["less"]).otherwise(0)).alias("loads"), F.concat(a["put"], F.array(F.struct(s["vslot"].alias("vslot"), i.alias("shard")))).alias("put"))

        stays = (F.get(a["loads"], s["old"]) - s["less"]) * shards <= F.col("total")
        return F.element_at(F.transform(F.array(F.when(stays, s["old"]).otherwise(_least(a["loads"]))), at), 1)

    done = ranked.select("version", F.explode(F.aggregate("all", state, put, lambda a: a["put"])).alias("p"))
    return done.select((F.col("version") + 1).alias("version"), "p.vslot", "p.shard")


def grow_map(old: DataFrame, sizes: DataFrame, shards: int) -> DataFrame:
    """The next version, with one more shard (number ``shards``): each old shard gives its smallest slots, up to the
    bytes by which it is over the new mean; nothing else moves. old, sizes: fixed numbers of rows."""
    both = old.join(sizes, "vslot").withColumn("_all", F.sum("bytes").over(Window.partitionBy("shard")))
    given = F.sum("bytes").over(Window.partitionBy("shard").orderBy("bytes", "vslot").rowsBetween(Window.unboundedPreceding, 0))
    target = sizes.agg((F.sum("bytes") / (shards + 1)).alias("_target"))
    moved = both.withColumn("_given", given).join(F.broadcast(target))  # one row
    new = F.when((F.col("bytes") > 0) & (F.col("_given") <= F.col("_all") - F.col("_target")), F.lit(shards)).otherwise(F.col("shard"))
    return moved.select((F.col("version") + 1).alias("version"), "vslot", new.cast("int").alias("shard"))


def write_map(slot_map: DataFrame, folder: str) -> None:
    """Store a map under its version; earlier versions stay."""
    slot_map.coalesce(1).write.partitionBy("version").mode("append").parquet(folder)


def read_map(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """A stored map: the given version, or the latest."""
    found = spark.read.parquet(folder)
    wanted = F.lit(version).alias("v") if version is not None else F.max("version").alias("v")
    return found.join(F.broadcast(found.agg(wanted)), F.col("version") == F.col("v")).select("version", "vslot", "shard")


def place(records: DataFrame, slot_map: DataFrame, sizes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Append shard and the record's place in it (slot, gapless from 0: by virtual slot, then key, size, checksum).

    records: with vslot, size and the key. Places are counted within virtual slots, of which each shard has many, and
    shifted by the records of the shard's earlier slots; no task holds a shard.
    """
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1))
    starts = slot_map.join(sizes, "vslot").select("vslot", "shard", F.coalesce(before, F.lit(0)).alias("_start"))
    order = [c for c in (key, "size", "text_crc32") if c in records.columns]
    at = F.row_number().over(Window.partitionBy("vslot").orderBy(*order)) - 1
    return records.withColumn("_at", at).join(F.broadcast(starts), "vslot").withColumn("slot", (F.col("_start") + F.col("_at")).cast("long")).drop("_start", "_at")


def shard_records(docs: DataFrame, shards: int, slots: int = SLOTS, folder: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, vslot, shard, slot of (doc_id, text), by the stored map of ``folder``.

    Where the folder has no map (or None is given: a new folder below the shared one), the first map is stored. The map's
    latest version is edited for the records' bytes a slot, stored as the next version, and read back for the placement.
    """
    spark = docs.sparkSession
    records = docs.select("doc_id", size_of(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), slot_of(F.col("doc_id"), slots).alias("vslot"))
    sizes = checkpoint(slot_sizes(records, slots))
    if folder is None:
        folder = f"{shared_dir(spark).rstrip('/')}/slot_maps/{uuid.uuid4().hex}"
        write_map(first_map(spark, shards, slots), folder)
    write_map(rebalanced(read_map(spark, folder), sizes, shards), folder)
    return place(records, read_map(spark, folder).select("vslot", "shard"), sizes)
