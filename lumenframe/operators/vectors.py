"""Exact vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lumenframe.functions import vector as V

#: Queries that are broadcast at once, and scores that a task holds at once.
BLOCK, CELLS = 4096, 1_000_000
#: Rows of a part of a group whose pairs are compared, and rows of it that are multiplied at once.
PART, TILE = 4096, 512


def _best(scores: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of one query, ties by row; all where there are no more."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((rows[at], -scores[at]))[:k]]


def search(vectors: DataFrame, queries: DataFrame, k: int, metric: str = "ip", min_score: float | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, row, score, rank): the k best rows of each query, best first, ties by row.

    queries: (query_id, query). They are counted and go to the tasks in blocks of about ``block``; the vectors are scanned once
    a block, as products of matrices. A task hands on the k best of each query, whatever it reads; rows are integers.
    """
    spark, kind = vectors.sparkSession, queries.schema["query_id"].dataType
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.select("query_id", "query")
    sign = 1.0 if metric == "ip" else -1.0
    out = None
    for b in range(blocks):
        some = (numbered if blocks == 1 else numbered.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).collect()  # about ``block`` rows
        told = spark.sparkContext.broadcast(np.array([r["query"] for r in some], np.float64))

        def run(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            asked = told.value
            held_rows, held = [np.zeros(0, np.int64)] * len(asked), [np.zeros(0)] * len(asked)
            step = max(1, CELLS // max(1, len(asked)))
            own_sizes = (asked**2).sum(1)[:, None] if metric != "ip" else None
            # what a query's next rows must reach: its k-th best so far, or the least that counts
            least = np.full(len(asked), -np.inf if min_score is None else min_score * sign if metric == "ip" else -np.inf)
            for whole in batches:
                for start in range(0, whole.num_rows if len(asked) else 0, step):
                    batch = whole.slice(start, step)
                    rows = np.asarray(batch.column(0)).astype(np.int64)
                    m = np.asarray(batch.column(1).flatten(), np.float64).reshape(len(rows), -1)
                    values = asked @ m.T
                    if metric != "ip":
                        # squared distances from the product tell which rows may count; these are then taken exactly
                        values *= 2.0
                        values -= own_sizes
                        values -= (m**2).sum(1)[None, :]
                    margin = 1e-5 * (1.0 + np.abs(values).max(1, initial=0.0, where=np.isfinite(values)))
                    able = values >= (least - margin)[:, None]
                    for q in np.flatnonzero(able.any(1)):
                        at = np.flatnonzero(able[q])
                        if len(at) > k:  # of a step no more than its own k best, and those within the margin of them
                            at = at[values[q, at] >= np.partition(values[q, at], len(at) - k)[len(at) - k] - margin[q]]
                        exact = values[q, at] if metric == "ip" else ((m[at] - asked[q]) ** 2).sum(1)
                        own_rows, own = np.r_[held_rows[q], rows[at]], np.r_[held[q], np.round(exact, 6) * sign]
                        if min_score is not None:
                            stay = own * sign >= min_score
                            own_rows, own = own_rows[stay], own[stay]
                        best = _best(own, own_rows, k)
                        held_rows[q], held[q] = own_rows[best], own[best]
                        if len(best) == k:
                            least[q] = held[q][-1]
            sizes = [len(r) for r in held_rows]
            if sum(sizes):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), sizes)), pa.array(np.concatenate(held_rows)), pa.array(np.concatenate(held) * sign + 0.0)], ["q", "row", "score"])

        # numbers of the block's queries stand for their ids on the way
        names = spark.createDataFrame([(i, r["query_id"]) for i, r in enumerate(some)], StructType([StructField("q", LongType()), StructField("query_id", kind)]))
        best = F.col("score").desc() if metric == "ip" else F.col("score").asc()
        found = vectors.select(F.col("row").cast("long").alias("row"), "embedding").mapInArrow(run, "q long, row long, score double")
        part = found.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(best, "row"))).where(F.col("rank") <= k)
        part = part.join(F.broadcast(names), "q").select("query_id", F.col("row").cast(vectors.schema["row"].dataType).alias("row"), "score", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def violations(vectors: DataFrame, dim: int, tolerance: float = 1e-4) -> DataFrame:
    """One row: how many vectors break the contract of dimension, finiteness, non-zero and unit norm, and repeated rows."""
    n = V.norm(F.col("embedding"))
    bad = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    return vectors.agg(F.count(F.lit(1)).alias("n"), bad(F.size("embedding") != dim).alias("bad_dim"), bad(F.isnan(n)).alias("not_finite"), bad(n == 0).alias("zero"), bad(F.abs(n - 1) > tolerance).alias("not_unit"), (F.count(F.lit(1)) - F.countDistinct("row")).alias("repeated"))


def novelty(vectors: DataFrame, group: str) -> DataFrame:
    """(group, row, novelty): (1 - largest cosine to another row of the group) / 2; alone: 1.

    All pairs of a group are compared, as products of matrices: a group is dealt over parts of about ``PART`` rows, and a task
    holds two parts at once, whatever the size of the group.
    """
    able = vectors.where(F.col(group).isNotNull() & F.col("row").isNotNull() & F.col("embedding").isNotNull()).select(F.col(group).alias("_g"), F.col("row").alias("_row"), "embedding", F.size("embedding").alias("_d"))
    sizes = able.groupBy("_g", "_d").agg(F.ceil(F.count(F.lit(1)) / PART).cast("int").alias("_n"))
    part = F.pmod(F.xxhash64("_row"), F.col("_n")).cast("int")  # equal rows meet in one part
    dealt = able.join(sizes, ["_g", "_d"]).withColumn("_part", part).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    pairs = dealt.select("_g", "_d", F.least("_part", "_other").alias("_i"), F.greatest("_part", "_other").alias("_j"), "_part", "_row", "embedding")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        low = int(pdf["_i"].iloc[0])
        first, second = pdf[pdf["_part"] == low], pdf[pdf["_part"] == int(pdf["_j"].iloc[0])]
        a, b = (np.stack(p["embedding"]).astype(np.float64) if len(p) else np.zeros((0, 0)) for p in (first, second))
        rows_a, rows_b, same = first["_row"].to_numpy(), second["_row"].to_numpy(), low == int(pdf["_j"].iloc[0])
        most_a, most_b = np.full(len(a), -np.inf), np.full(len(b), -np.inf)
        for start in range(0, len(a) if len(b) else 0, TILE):
            cut = slice(start, start + TILE)
            scores = a[cut] @ b.T
            if same:
                scores[rows_a[cut, None] == rows_b[None, :]] = -np.inf
            else:
                most_b = np.maximum(most_b, scores.max(0))
            most_a[cut] = scores.max(1)
        told = pd.DataFrame({"_row": rows_a, "most": most_a}) if same else pd.DataFrame({"_row": np.r_[rows_a, rows_b], "most": np.r_[most_a, most_b]})
        return told[told["most"] != -np.inf]

    kind = vectors.schema["row"].dataType
    found = pairs.groupBy("_g", "_d", "_i", "_j").applyInPandas(one, StructType([StructField("_row", kind), StructField("most", DoubleType())]))
    most = found.groupBy(F.col("_row").alias("row")).agg(F.max("most").alias("most"))
    return vectors.select(group, "row").join(most, "row", "left").select(group, "row", F.round(F.when(F.col("most").isNull(), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (1 - F.col("most")) / 2))), 6).alias("novelty"))
