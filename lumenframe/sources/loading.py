"""Record files of every shape as one table: JSON lines, arrays, single records and frame maps, strict or lenient."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lumenframe.sources import files
from lumenframe.sources.corpus import normalize_frames

# Fields that tell a single record from a map of records, and names of files that a text index is built from.
IDENTIFYING = ("frame_id", "keyframe_id", "video_id")
WHOLE_SEGMENTS, SEGMENTS, ARTIFACTS = "segments_all.jsonl", r"segments_.*\.jsonl", r"(captions|ocr|objects).*\.jsonl"

ORDER = "struct<block:bigint,row:bigint,key:string>"


@dataclass
class Loaded:
    """rows: the records with their file and order in it (_file, _order). skipped: (_file, _order, reason) of what was left out."""

    rows: DataFrame
    skipped: DataFrame

    def ordered(self) -> DataFrame:
        """The records in the order of their files' names, and in each as they stand; numeric keys of a map come first, by number."""
        key = F.col("_order.key")
        return self.rows.orderBy("_file", "_order.block", "_order.row", key.try_cast("long").asc_nulls_last(), key).drop("_file", "_order")


def _place(block: Column, row: Column, key: Column) -> Column:
    return F.struct(block.cast("long").alias("block"), row.cast("long").alias("row"), key.cast("string").alias("key")).alias("_order")


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, _order, text) of all lines, blank ones too."""
    raw = spark.read.text(paths).select("value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("id"))
    return raw.select(F.col("file_path").alias("_file"), _place(F.col("file_block_start"), F.col("id"), F.lit(None)), F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("text"))


def _wholes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(_file, _order, text, wrong) of the records of JSON files: elements of an array, a single record, values of a map."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.trim(F.regexp_replace("value", "^\ufeff", "")).alias("t"))
    array = F.from_json("t", "array<string>")
    keys = F.json_object_keys("t")
    entry = lambda row, key, text: F.struct(_place(F.lit(0), row, key), text.alias("text"))
    listed = F.transform(array, lambda x, i: entry(i, F.lit(None), x))
    mapped = F.transform(F.map_entries(F.from_json("t", "map<string,string>")), lambda e: entry(F.lit(0), e["key"], e["value"]))
    single = F.array(entry(F.lit(0), F.lit(None), F.col("t")))
    shape = F.when(F.substr("t", F.lit(1), F.lit(1)) == "[", listed).when(F.arrays_overlap(keys, F.array(*[F.lit(k) for k in IDENTIFYING])), single).when(keys.isNotNull(), mapped)
    held = raw.select("_file", F.coalesce(shape, F.array(entry(F.lit(0), F.lit(None), F.lit(None).cast("string")))).alias("e"))
    return held.select("_file", F.explode("e").alias("e")).select("_file", "e._order", "e.text")


def load(spark: SparkSession, path: str, schema: StructType, strict: bool = True, key_field: str | None = None, require: str | None = None) -> Loaded:
    """The records of a file or of a folder's .json and .jsonl files.

    .jsonl files hold a record a line, with or without a byte-order mark; blank lines count for nothing. .json files hold an
    array of records, one record, or a map of records by key, which ``key_field`` takes where the record has none. strict: the
    first thing that isn't a record is a ValueError that names its file and line, element or key; else what isn't a record,
    and what has no ``require``, is left out with a warning. Fields beyond the schema are dropped.
    """
    found = files.record_files(spark, path)
    lines, wholes = [f for f in found if f.lower().endswith(".jsonl")], [f for f in found if not f.lower().endswith(".jsonl")]
    parts = []
    if lines:
        parts.append(_lines(spark, lines).where("text <> ''"))
    if wholes:
        parts.append(_wholes(spark, wholes))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    wide = StructType([*schema.fields, StructField(files.BAD, StringType())])
    parsed = every.withColumn("r", F.from_json("text", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": files.BAD}))
    broken = F.coalesce(~F.col("text").startswith("{"), F.lit(True)) | F.col("r").isNull() | F.col(f"r.{files.BAD}").isNotNull()
    value = {f.name: F.col(f"r.`{f.name}`") for f in schema.fields}
    if key_field:
        value[key_field] = F.coalesce(value[key_field], F.col("_order.key").try_cast(schema[key_field].dataType))
    reason = F.when(broken, "not a record")
    if require:
        reason = reason.when(value[require].isNull(), f"without {require}")
    told = parsed.withColumn("reason", reason)
    rows = told.where("reason IS NULL").select("_file", "_order", *[v.alias(k) for k, v in value.items()])
    skipped = told.where("reason IS NOT NULL").select("_file", "_order", "reason")
    first = skipped.orderBy("_file", "_order").limit(1).collect()
    if first and strict:
        raise ValueError(_message(spark, first[0], lines))
    if first:
        counts = {r["reason"]: r["count"] for r in skipped.groupBy("reason").count().collect()}
        warnings.warn(f"{path}: left out " + ", ".join(f"{n} {why}" for why, n in sorted(counts.items())), stacklevel=2)
    return Loaded(rows, skipped)


def _message(spark: SparkSession, bad, lines: list[str]) -> str:
    name, at = bad["_file"], bad["_order"]
    if name.lower().endswith(".jsonl"):
        before = _lines(spark, [name]).where((F.col("_order.block") < at["block"]) | ((F.col("_order.block") == at["block"]) & (F.col("_order.row") < at["row"]))) if len(lines) == 1 else None
        if before is None:  # ids run over all files: number those of this one alone
            own = _lines(spark, lines).where(F.col("_file") == name)
            before = own.where((F.col("_order.block") < at["block"]) | ((F.col("_order.block") == at["block"]) & (F.col("_order.row") < at["row"])))
        return f"{name}, line {before.count() + 1}: {bad['reason']}"
    return f"{name}{f', key {at["key"]}' if at['key'] is not None else f', element {at["row"]}'}: {bad['reason']}"


def load_frame_map(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """A map or list of frame records with inferred times and where these come from, by video and time."""
    raw = load(spark, path, schema, strict).rows.drop("_file", "_order")
    return normalize_frames(raw).orderBy("video_id", "timestamp", "frame_id")


def text_sources(spark: SparkSession, folder: str) -> list[str]:
    """The files that a folder's text index is built from: segments_all.jsonl, else segments_*.jsonl, else captions, recognised
    texts and objects; reports are left out. None of these is an error."""
    names = {f.rsplit("/", 1)[-1]: f for f in files.record_files(spark, folder)}
    if WHOLE_SEGMENTS in names:
        return [names[WHOLE_SEGMENTS]]
    for pattern in (SEGMENTS, ARTIFACTS):
        found = [f for n, f in sorted(names.items()) if re.fullmatch(pattern, n, re.I) and "_report" not in n]
        if found:
            return found
    raise FileNotFoundError(f"no segments, captions, recognised texts or objects in {folder}")
