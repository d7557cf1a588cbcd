"""A stored text index: postings are stemmed and written once, and a search reads only the buckets of its query's stems."""

from __future__ import annotations

import json
import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import lexical as L
from lumenframe.sources import files

#: Directories of postings; a stem's is its CRC-32 modulo this number.
BUCKETS = 64


def bucket(stem: Column) -> Column:
    return F.pmod(F.crc32(stem), F.lit(BUCKETS)).cast("int")


def publish(docs: DataFrame, path: str, add: bool = False, key: str = "frame_id", text: str = "caption") -> str:
    """Write the postings of ``docs`` as a segment below ``path`` and then point CURRENT at it: alone, or with ``add`` beside
    the segments already there. Readers see the old index or the new one.

    Keys must be distinct, and new where they are added (ValueError before CURRENT is changed, else). A null or empty text
    counts as a text without postings. A frequent stem's bucket is split over several files by the rebalancing hint; files
    are sorted by stem, so that a scan skips row groups.
    """
    spark, name = docs.sparkSession, f"segment={uuid.uuid4().hex}"
    with files.Claim(spark, path) as claim:  # segments that another writer adds meanwhile would be lost
        rows = L.postings(docs, key, text).withColumn("bucket", bucket(F.col("stem")))
        rows.hint("rebalance", F.col("bucket")).sortWithinPartitions("bucket", "stem").write.partitionBy("bucket").parquet(f"{path}/{name}/postings")
        docs.select(key).write.parquet(f"{path}/{name}/keys")
        keys = spark.read.parquet(f"{path}/{name}/keys")
        segments = _segments(spark, path) if add else []
        old = [f"{path}/{s['name']}/keys" for s in segments]
        if not keys.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty() or (old and not keys.join(spark.read.parquet(*old), key, "left_semi").isEmpty()):
            raise ValueError(f"{path}: a key of {name} is there twice")
        size = L.stats(docs, text).first()
        segments.append({"name": name, "doc_count": size.doc_count, "avg_doc_len": size.avg_doc_len or 0.0, "key": key, "schema": rows.schema.json()})
        claim.commit(json.dumps({"segments": segments}))
    return name


def _segments(spark: SparkSession, path: str) -> list[dict]:
    return json.loads(files.get(spark, f"{path}/CURRENT"))["segments"]


def postings(spark: SparkSession, path: str, terms: list[str] | None = None) -> DataFrame:
    """(key, stem, tf, doc_len) of the current index; with ``terms`` (stems) only theirs, from their buckets' directories."""
    out = None
    for s in _segments(spark, path):
        rows = spark.read.schema(_schema(s)).parquet(f"{path}/{s['name']}/postings")
        out = rows if out is None else out.unionByName(rows)
    if terms is not None:
        out = out.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})) & F.col("stem").isin(terms))
    return out.drop("bucket")


def _schema(segment: dict):
    from pyspark.sql.types import StructType

    return StructType.fromJson(json.loads(segment["schema"]))


def sizes(spark: SparkSession, path: str) -> DataFrame:
    """One row as lexical.stats() gives it: doc_count and avg_doc_len over all segments."""
    segments = _segments(spark, path)
    count = sum(s["doc_count"] for s in segments)
    length = sum(s["doc_count"] * s["avg_doc_len"] for s in segments) / count if count else 0.0
    return spark.createDataFrame([(count, length)], "doc_count long, avg_doc_len double")


def search(spark: SparkSession, path: str, terms: list[str]) -> DataFrame:
    """As lexical.search(), from the stored postings: texts are neither read nor stemmed."""
    segments = _segments(spark, path)
    count = sum(s["doc_count"] for s in segments)
    length = sum(s["doc_count"] * s["avg_doc_len"] for s in segments) / count if count else 0.0
    return L.scored(postings(spark, path, terms), F.lit(count), F.lit(length), segments[0]["key"])
