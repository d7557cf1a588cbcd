"""Reranking by weighted signals, constraints and model scores; clip rescue; ranking of frame sequences."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.functions import text as X

# Signal weights that results depend on; visual_coverage weighs as much as cses_gain.
SIGNAL_WEIGHTS = {
    "coarse_rrf": 0.14, "dense_visual": 0.39, "caption": 0.11, "ocr": 0.10, "objects": 0.07, "cses_gain": 0.04,
    "temporal_consistency": 0.03, "modality_alignment": 0.02, "neighbor_support": 0.05, "segment_support": 0.05, "visual_coverage": 0.04,
}
DIRECT = ("coarse_rrf", "dense_visual", "caption", "ocr", "objects", "cses_gain", "temporal_consistency", "modality_alignment")
VISUAL_ONLY = ("coarse_rrf", "dense_visual", "cses_gain", "visual_coverage")
CONTEXT = ("neighbor_support", "segment_support")
MAX_CONTEXT_BONUS = 0.08


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns, F.lit(0.0))


def weighted_signals(rows: DataFrame, direct: tuple[str, ...] = DIRECT, context: tuple[str, ...] = (), max_bonus: float = MAX_CONTEXT_BONUS) -> DataFrame:
    """Append context_bonus and score: the weighted mean of the active signal columns (nulls count 0).

    coarse_rrf is divided by its largest magnitude among the rows, and mapped from -1..1 to 0..1 if any is negative;
    cses_gain is divided by its maximum. What the context signals add is capped at ``max_bonus``.
    """
    whole = sum(SIGNAL_WEIGHTS[n] for n in (*direct, *context))
    # one row, whatever the input
    extent = rows.agg(F.max(F.abs("coarse_rrf")).alias("_scale"), F.min("coarse_rrf").alias("_low"), F.max("cses_gain").alias("_gain"))
    coarse = F.coalesce("coarse_rrf", F.lit(0.0)) / F.coalesce(F.nullif("_scale", F.lit(0.0)), F.lit(1.0))
    scaled = {"coarse_rrf": F.when(F.col("_low") < 0, (coarse + 1.0) / 2.0).otherwise(coarse), "cses_gain": F.col("cses_gain") / F.coalesce(F.nullif("_gain", F.lit(0.0)), F.lit(1.0))}
    part = lambda n: SIGNAL_WEIGHTS[n] * F.coalesce(scaled.get(n, F.col(n)), F.lit(0.0)) / whole
    bonus = F.least(_sum(part(n) for n in context), F.lit(max_bonus))
    out = rows.join(F.broadcast(extent)).withColumns({"context_bonus": F.round(bonus, 8), "score": F.round(_sum(part(n) for n in direct) + bonus, 8)})
    return out.drop("_scale", "_low", "_gain")


def context_relevance(signals: dict[str, Column], distance: Column, window: float = 5.0, share: float = 0.1) -> Column:
    """Weighted mean of the signals that are not null, blended with closeness in time: 1 at distance 0, 0 at the window."""
    have = _sum(F.when(c.isNotNull(), SIGNAL_WEIGHTS[n]).otherwise(0.0) for n, c in signals.items())
    mean = F.when(have > 0, _sum(F.coalesce(SIGNAL_WEIGHTS[n] * c, F.lit(0.0)) for n, c in signals.items()) / have).otherwise(0.0)
    return (1.0 - share) * mean + share * F.greatest(F.lit(0.0), 1.0 - F.abs(distance) / window)


def phrase_signal(text: Column, phrase: str) -> Column:
    """1 where the text has the phrase's words in a row, else the weighted share of its content stems that it has."""
    inside = F.contains(F.concat(F.lit(" "), F.array_join(X.tokens(text), " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(X.tokens(F.lit(phrase)), " "), F.lit(" ")))
    weigh = lambda stems: F.aggregate(F.transform(stems, lambda t: F.when(t.isin(X.GENERIC_SUBJECTS), X.SUBJECT_WEIGHT).when(t.isin(X.PARTICLES), X.PARTICLE_WEIGHT).otherwise(1.0)), F.lit(0.0), lambda s, x: s + x)
    wanted = F.array_distinct(X.stems_of(F.lit(phrase), content=True))
    share = F.coalesce(F.try_divide(weigh(F.array_intersect(wanted, X.stems_of(text, content=True))), weigh(wanted)), F.lit(0.0))
    return F.when(F.size(X.tokens(F.lit(phrase))) == 0, 0.0).when(inside, 1.0).otherwise(X.unit(share))


def constraint_signal(constraints: dict[str, list[str]], fields: dict[str, list[Column]]) -> Column:
    """Mean over categories of the mean over their phrases of the best field's phrase signal. A category without a field is 0."""

    def phrase(p: str, texts: list[Column]) -> Column:
        got = [phrase_signal(t, p) for t in texts]
        return F.greatest(*got) if len(got) > 1 else got[0]

    each = [_sum(phrase(p, fields[c]) for p in phrases) / len(phrases) if fields.get(c) else F.lit(0.0) for c, phrases in constraints.items() if phrases]
    return _sum(each) / len(each) if each else F.lit(0.0)


def constrained(rows: DataFrame, signal: str = "constraint", weight: float = 0.15, least: float = 0.20) -> DataFrame:
    """Blend score with the constraint signal, only if some row's signal reaches ``least``."""
    most = rows.agg(F.max(signal).alias("_most"))
    blended = F.round((1.0 - weight) * F.col("score") + weight * F.coalesce(signal, F.lit(0.0)), 8)
    return rows.join(F.broadcast(most)).withColumn("score", F.when(F.col("_most") >= least, blended).otherwise(F.col("score"))).drop("_most")


def model_blend(rows: DataFrame, alpha: float = 0.5, pool: int = 100) -> DataFrame:
    """Blend score with model_score for the first ``pool`` ranks; rows beyond, or without a model score, keep theirs.

    rows: (..., rank, score, model_score); model_score is an input column, null where a row has no content.
    """
    mixed = F.round(alpha * F.col("score") + (1.0 - alpha) * F.col("model_score"), 8)
    return rows.withColumn("score", F.when((F.col("rank") <= pool) & F.col("model_score").isNotNull(), mixed).otherwise(F.col("score")))


def rescued_clips(coarse: DataFrame, dense: DataFrame, most: int = 10, cap: int = 60, depth: int = 300) -> DataFrame:
    """The coarse clips (video_id, shot_id, position), then up to ``most`` clips that only the first ``depth`` dense hits
    (video_id, shot_id, rank) have, by first appearance; ``cap`` clips in all. Appends rescued."""
    keys = ["video_id", "shot_id"]
    first = dense.where(F.col("rank") <= depth).groupBy(*keys).agg(F.min("rank").alias("position"))
    new = first.join(coarse.select(*keys), keys, "left_anti").orderBy("position", *keys).limit(most)
    both = coarse.select(*keys, F.col("position").cast("long"), F.lit(False).alias("rescued")).unionByName(new.select(*keys, F.col("position").cast("long"), F.lit(True).alias("rescued")))
    return both.orderBy("rescued", "position", *keys).limit(cap)


def top_in_clip(rows: DataFrame, k: int = 12) -> DataFrame:
    """The k best frames of each clip of (video_id, shot_id, row, ts, score), with their rank."""
    order = Window.partitionBy("video_id", "shot_id").orderBy(F.desc("score"), "ts", "row")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked_sequences(paths: DataFrame, events: int, limit: int = 100, radius: int = 0, per_path: int = 3) -> DataFrame:
    """The best distinct frame sequences of (video_id, path_id, frames, score), with rank.

    Sequences of another length, with a negative or a not increasing frame are dropped, repeats keep their best row, and
    with a radius those within it at every frame of a better kept one of their video. A first pass takes at most
    ``max(5, ceil(limit / 3))`` a video and ``per_path`` a path, a second the rest, both by score, frames, video and path.
    A path belongs to one video.
    """
    rising = F.forall(F.zip_with(F.slice("frames", 1, events - 1), F.slice("frames", 2, events - 1), lambda a, b: a < b), lambda x: x) if events > 1 else F.lit(True)
    valid = paths.where((F.size("frames") == events) & (F.array_min("frames") >= 0) & F.coalesce(rising, F.lit(False)) & ~F.exists("frames", lambda f: f.isNull()))
    order = [F.desc("score"), F.col("frames"), F.col("video_id"), F.col("path_id")]
    rows = valid.withColumn("_r", F.row_number().over(Window.partitionBy("video_id", "frames").orderBy(*order))).where("_r = 1").drop("_r")
    if radius > 0:
        rows = _apart(rows, radius)
    cap = max(5, math.ceil(limit / 3))
    rows = rows.withColumn("_p", F.row_number().over(Window.partitionBy("video_id", "path_id").orderBy(*order)))
    in_path = F.col("_p") <= per_path
    rows = rows.withColumn("_v", F.row_number().over(Window.partitionBy("video_id", in_path).orderBy(*order)))
    rows = rows.withColumn("_pass", F.when(in_path & (F.col("_v") <= cap), 1).otherwise(2))
    first = rows.orderBy("_pass", *order).limit(limit)
    return first.withColumn("rank", F.row_number().over(Window.orderBy("_pass", *order))).drop("_p", "_v", "_pass")


def _apart(rows: DataFrame, radius: int) -> DataFrame:
    """Greedy suppression of near-equal sequences; keyed by video, whose sequences a beam has capped."""
    names = rows.columns

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[sorted(range(len(pdf)), key=lambda i: (-pdf["score"].iloc[i], tuple(pdf["frames"].iloc[i]), str(pdf["path_id"].iloc[i])))]
        kept: list[int] = []
        for i, frames in enumerate(pdf["frames"]):
            if not any(all(abs(a - b) <= radius for a, b in zip(frames, pdf["frames"].iloc[j], strict=True)) for j in kept):
                kept.append(i)
        return pdf.iloc[kept][names]

    return rows.groupBy("video_id").applyInPandas(one, rows.schema)
