"""Bundles of ordered tables that are published and read as one, with digests that know the order.

Each table is written with a row number (``_row``, from 0, in the order of its keys). Its digest takes rows in blocks of
BLOCK consecutive numbers: a block's hash is that of its rows' hashes in order, and the table's digest adds up the blocks'
hashes with their numbers, so no task needs more than a block and the partitions don't matter. Swapped, lost, repeated or
changed rows change it.

A bundle is committed by one manifest: all tables of a generation are written and checked first, then the manifest is
renamed over CURRENT. While a writer works its mark refuses others (files.Claim). A reader checks that every table says that it
belongs to the manifest's generation, its columns, number of rows, order and digest, its vectors' contract, and at the
end that the manifest is still the same.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators.ranks import places
from lumenframe.sources import files

BLOCK, ROW, VERSION = 1024, "_row", 1


@dataclass(frozen=True)
class Table:
    """A table to publish: its rows, the columns to order by, and for a column of unit vectors its name and dimension."""

    rows: DataFrame
    order: tuple[str, ...]
    vectors: str | None = None
    dimension: int | None = None


def blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """(block, n, low, high, first, last, ordered, sha) of a table with row numbers: its numbers' range, the keys of its first and last
    row, whether keys never fall inside it, and the hash of its rows in order."""
    told = F.struct(F.col(ROW), F.struct(*order).alias("k"), F.sha2(F.to_json(F.struct(*sorted(c for c in rows.columns if c != ROW)), {"ignoreNullFields": "false"}), 256).alias("h"))
    held = rows.groupBy(F.floor(F.col(ROW) / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(told)).alias("r"))
    rises = F.forall(F.sequence(F.lit(1), F.size("r") - 1), lambda i: F.get(F.col("r.k"), i - 1) <= F.get(F.col("r.k"), i))
    return held.select(
        "block", F.size("r").alias("n"), F.col("r")[0][ROW].alias("low"), F.element_at("r", -1)[ROW].alias("high"), F.col("r")[0]["k"].alias("first"), F.element_at("r", -1)["k"].alias("last"),
        ((F.size("r") == 1) | rises).alias("ordered"), F.sha2(F.array_join(F.col("r.h"), ""), 256).alias("sha"),
    )


def ordered_digest(rows: DataFrame, order: list[str]) -> dict:
    """rows, digest, and what is wrong with the numbers and the order (empty for a sound table)."""
    each = files.settled(blocks(rows, order))
    word = lambda k: F.conv(F.substring(F.sha2(F.concat_ws(":", F.col("block").cast("string"), "sha"), 256), 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")
    full = each.agg(F.count(F.lit(1)).alias("blocks"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.max("high").alias("high"), F.min("low").alias("low"), F.min((F.col("high") - F.col("low") + 1 == F.col("n")).cast("int")).alias("dense"), F.min(F.col("ordered").cast("int")).alias("ordered"), *[F.sum(word(k)).alias(f"w{k}") for k in range(4)]).first()
    wrong = []
    if full["rows"] and (full["low"] != 0 or full["high"] != full["rows"] - 1 or not full["dense"]):
        wrong.append("row numbers are missing or repeated")
    after = each.select((F.col("block") + 1).alias("block"), F.col("last").alias("before"))
    if full["rows"] and (not full["ordered"] or each.join(after, "block").where("before > first").limit(1).count()):
        wrong.append("rows are out of order")
    return {"rows": full["rows"], "digest": "-".join(str(full[f"w{k}"] or 0) for k in range(4)), "wrong": wrong}


def _vector_faults(rows: DataFrame, column: str, dimension: int) -> int:
    e = F.col(column)
    length = F.aggregate(e, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    good = (F.size(e) == dimension) & (F.abs(F.sqrt(length) - 1) <= 1e-3)
    return rows.where(~F.coalesce(good, F.lit(False))).limit(1).count()


def _generation(manifest: dict) -> str:
    """The name of a bundle's content: a hash of its tables' digests."""
    return hashlib.sha256(json.dumps({k: [t["rows"], t["digest"]] for k, t in manifest["tables"].items()}, sort_keys=True).encode()).hexdigest()


def publish(spark: SparkSession, path: str, tables: dict[str, Table], source: str = "") -> dict:
    """Write a bundle and commit it; returns its manifest. Nothing is committed where a table breaks its vectors' contract, or
    another writer was first (files.Busy)."""
    with files.Claim(spark, path) as claim:
        name = f"gen={uuid.uuid4().hex}"
        manifest = {"version": VERSION, "status": "passed", "folder": name, "source": source, "tables": {}}
        for role, t in tables.items():
            numbered = places(t.rows, [], *[F.col(c).asc_nulls_first() for c in t.order], name=ROW).withColumn(ROW, F.col(ROW) - 1)
            numbered.write.parquet(f"{path}/{name}/{role}")
            saved = spark.read.schema(numbered.schema).parquet(f"{path}/{name}/{role}")
            told = ordered_digest(saved, list(t.order))
            if told["wrong"]:
                raise ValueError(f"{role}: {', '.join(told['wrong'])}")
            if t.vectors and _vector_faults(saved, t.vectors, t.dimension):
                raise ValueError(f"{role}: {t.vectors} isn't a unit vector of dimension {t.dimension}")
            manifest["tables"][role] = {"rows": told["rows"], "digest": told["digest"], "order": list(t.order), "schema": saved.schema.json(), "vectors": t.vectors, "dimension": t.dimension}
        manifest["generation"] = _generation(manifest)
        for role in tables:
            files._put(spark, f"{path}/{name}/{role}.generation", manifest["generation"])
        claim.commit(json.dumps(manifest, sort_keys=True))
    return manifest


def load(spark: SparkSession, path: str, source: str | None = None, verify: bool = True) -> dict[str, DataFrame]:
    """The tables of the committed bundle. With ``verify`` they are read whole and held against the manifest; whatever differs
    is a ValueError, as is a source other than the one asked for, or a manifest that changed meanwhile."""
    from pyspark.sql.types import StructType

    text = files.get(spark, f"{path}/CURRENT")
    manifest = json.loads(text)
    if manifest.get("version") != VERSION or manifest.get("status") != "passed":
        raise ValueError(f"{path}: not a bundle of version {VERSION}")
    if source is not None and manifest["source"] != source:
        raise ValueError(f"{path}: made from {manifest['source']!r}")
    if manifest["generation"] != _generation(manifest):
        raise ValueError(f"{path}: the generation doesn't match the tables")
    out = {}
    for role, t in manifest["tables"].items():
        folder = f"{path}/{manifest['folder']}"
        if files.get(spark, f"{folder}/{role}.generation") != manifest["generation"]:
            raise ValueError(f"{path}: {role} is of another generation")
        rows = spark.read.schema(StructType.fromJson(json.loads(t["schema"]))).parquet(f"{folder}/{role}")
        if verify:
            told = ordered_digest(rows, t["order"])
            wrong = told["wrong"] + [f"{what} differ" for what in ("rows", "digest") if told[what] != t[what]]
            if wrong:
                raise ValueError(f"{path}: {role}: {', '.join(wrong)}")
            if t["vectors"] and _vector_faults(rows, t["vectors"], t["dimension"]):
                raise ValueError(f"{path}: {role}: {t['vectors']} breaks its contract")
        out[role] = rows
    if files.get(spark, f"{path}/CURRENT") != text:
        raise ValueError(f"{path}: the manifest changed while its tables were read")
    return out


def report(spark: SparkSession, path: str) -> DataFrame:
    """One row a table of the committed bundle: role, rows, order, digest, vectors, dimension."""
    manifest = json.loads(files.get(spark, f"{path}/CURRENT"))
    rows = [(role, t["rows"], ",".join(t["order"]), t["digest"], t["vectors"], t["dimension"]) for role, t in sorted(manifest["tables"].items())]
    return spark.createDataFrame(rows, "role string, rows long, order string, digest string, vectors string, dimension int")
