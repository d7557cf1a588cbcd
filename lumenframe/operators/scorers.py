"""A seam for outside scorers: batches of rows go to a function in the tasks, failures stay with their row, scores can be kept.

A scorer takes a list of inputs (dicts of the named columns) and returns as many scores from 0 to 1. It is pickled to the tasks;
where it loads a model, it should do so on its first call. A batch that fails is tried again row by row, so that one
bad row costs only itself: its score is null, and ``reason`` says why.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from lumenframe.sources import files

Scorer = Callable[[list[dict]], list[float]]
MODES = ("off", "each", "optional", "required")
#: Share of the ranking's own score, rows of a query that are scored.
OWN_WEIGHT, MOST = 0.8, 20


def _checked(scorer: Scorer, items: list[dict]) -> list[float]:
    scores = [float(s) for s in scorer(items)]
    if len(scores) != len(items):
        raise ValueError(f"{len(items)} rows gave {len(scores)} scores")
    for s in scores:
        if not (math.isfinite(s) and 0.0 <= s <= 1.0):
            raise ValueError(f"a score of {s} isn't from 0 to 1")
    return scores


def model_scores(rows: DataFrame, scorer: Scorer, inputs: list[str], batch: int = 16) -> DataFrame:
    """Append ``model`` (null where the scorer failed) and ``reason`` (null where it didn't) to rows, in batches."""
    schema = StructType([*rows.schema.fields, StructField("model", DoubleType()), StructField("reason", StringType())])

    def one(items: list[dict]) -> list[tuple[float | None, str | None]]:
        try:
            return [(s, None) for s in _checked(scorer, items)]
        except Exception as e:  # whatever an outside scorer raises stays with its rows
            if len(items) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [one([x])[0] for x in items]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            items = frame[inputs].to_dict("records")
            told = [x for k in range(0, len(items), batch) for x in one(items[k : k + batch])]
            yield frame.assign(model=pd.Series([s for s, _ in told], index=frame.index, dtype="float64"), reason=pd.Series([r for _, r in told], index=frame.index, dtype=object))

    scored = rows.mapInPandas(run, schema)
    return scored.withColumn("model", F.when(F.isnan("model"), None).otherwise(F.col("model")))


def kept_scores(rows: DataFrame, scorer: Scorer, inputs: list[str], path: str, name: str, batch: int = 16) -> DataFrame:
    """As model_scores(), with the scores of inputs seen before taken from the Parquet table at ``path``; new ones are added to
    it, failures aren't. ``name`` (model and revision) is part of what a score is kept by. Equal inputs are scored once.
    One writer at a time; scores that a lost writer had added stay good."""
    spark = rows.sparkSession
    keyed = files.settled(rows.withColumn("_key", F.sha2(F.to_json(F.struct(F.lit(name).alias("name"), *inputs), {"ignoreNullFields": "false"}), 256)))
    fs, p = files._fs(spark, path)
    held = spark.read.schema("key string, model double").parquet(path) if fs.exists(p) else spark.createDataFrame([], "key string, model double")
    held = held.groupBy(F.col("key").alias("_key")).agg(F.first("model").alias("model"))
    missing = keyed.join(held, "_key", "left_anti").select("_key", *inputs).dropDuplicates(["_key"])
    new = files.settled(model_scores(missing, scorer, inputs, batch).select("_key", "model", "reason"))
    held = files.settled(held.join(keyed.select("_key").distinct(), "_key", "left_semi").select("_key", "model", F.lit(None).cast("string").alias("reason")))
    new.where("model IS NOT NULL").select(F.col("_key").alias("key"), "model").write.mode("append").parquet(path)
    return keyed.join(held.unionByName(new), "_key").drop("_key")


def blended(rows: DataFrame, scores: DataFrame | None, mode: str = "optional", most: int = MOST, own: float = OWN_WEIGHT) -> DataFrame:
    """Rows (query_id, candidate, ts, score, rank) ranked anew by ``own`` times their score and the rest of the model's.

    scores: (query_id, candidate, model, reason) of the rows up to rank ``most``. off: nothing changes. each: a row without a
    model score keeps its own. optional: a query with such a row keeps its ranking. required: such a row is an error. ``status``
    is disabled, passed or fallback by query, ``reason`` the row's.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "off" or scores is None:
        return rows.withColumns({"model": F.lit(None).cast("double"), "reason": F.lit(None).cast("string"), "status": F.lit("disabled")})
    keys = ["query_id", "candidate"]
    told = rows.join(scores.select(*keys, "model", "reason"), keys, "left")
    asked, model = F.col("rank") <= most, F.col("model")
    if mode == "required":
        why = F.concat(F.lit("a required score failed: "), F.coalesce("reason", F.lit("none was given")))
        told = told.withColumn("model", F.when(asked & model.isNull(), F.raise_error(why).cast("double")).otherwise(model))
    failed = told.where(asked & model.isNull()).select("query_id").distinct().withColumn("_failed", F.lit(True))
    told = told.join(failed, "query_id", "left").withColumn("status", F.when(F.coalesce("_failed", F.lit(False)), "fallback").otherwise("passed")).drop("_failed")
    counts = asked & model.isNotNull() & ((F.col("status") == "passed") | F.lit(mode == "each"))
    mixed = F.when(counts, F.round(own * F.col("score") + (1 - own) * model, 8)).otherwise(F.col("score"))
    still = (F.col("status") == "fallback") & F.lit(mode == "optional")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.when(still, F.col("rank")).otherwise(0), F.desc("score"), "ts", "candidate"))
    return told.withColumn("score", mixed).withColumn("rank", rank)
