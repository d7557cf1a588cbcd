"""Fuzzy clusters of texts within groups: lossless q-gram candidates, exact ratio, connected components."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lumenframe.operators.ratio import common_subsequence
from lumenframe.sources.files import settled


def alike(percent: int):
    """Column function of two texts: whether 2 * common subsequence / (sum of lengths) is at least ``percent`` per cent."""

    @F.pandas_udf(BooleanType())
    def ratio(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([200 * common_subsequence(a, b) >= percent * (len(a) + len(b)) for a, b in zip(left, right, strict=True)], dtype=bool)

    return ratio


def candidate_pairs(texts: DataFrame, percent: int) -> DataFrame:
    """(grp, a, b), a < b: every pair of a group's texts that can reach the ratio. texts: distinct (grp, text), not empty.

    With L common characters, texts of m and n characters share at least 3L - m - n + 1 of their padded bigrams (a character
    left out breaks two, one put in breaks one), so pairs at ``percent`` share at least one and, by the usual prefix argument,
    one among the rarest of each. Pairs whose lengths alone rule the ratio out are left out.
    """
    if percent <= 66:
        raise ValueError("the bigram bound needs a ratio over 66 per cent")
    n = F.length("text")
    shortest = F.ceil(n * percent / (200 - percent))  # of a partner
    shared = F.floor((3 * percent - 200) * (n + shortest) / 200) + 1
    padded = F.concat(F.lit("\x02"), "text", F.lit("\x03"))
    grams = F.transform(F.sequence(F.lit(1), n + 1), lambda i: F.substr(padded, i, F.lit(2)))
    counted = texts.select("grp", "text", (n + 2 - shared).alias("_most"), F.explode(grams).alias("gram")).groupBy("grp", "text", "_most", "gram").agg(F.count(F.lit(1)).alias("_c"))
    rows = counted.select("grp", "text", "_most", "gram", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))).alias("k"))
    rare = rows.groupBy("grp", "gram", "k").agg(F.count(F.lit(1)).alias("_df")).where("_df > 1")  # others meet nothing
    ranked = rows.join(rare, ["grp", "gram", "k"], "left").withColumn("_r", F.row_number().over(Window.partitionBy("grp", "text").orderBy(F.coalesce("_df", F.lit(1)), "gram", "k")))
    prefix = ranked.where("_r <= _most AND _df IS NOT NULL").select("grp", "gram", "k", "text")
    pairs = prefix.withColumnRenamed("text", "a").join(prefix.withColumnRenamed("text", "b"), ["grp", "gram", "k"]).where("a < b")
    near = percent * (F.length("a") + F.length("b")) <= 200 * F.least(F.length("a"), F.length("b"))
    return pairs.where(near).select("grp", "a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(grp, node, label): the least node that each node of (grp, a, b) reaches. Each round takes the neighbours' least label
    and then that label's own, so paths shorten by halves; tables of a round are written, so that lineage stays short."""
    both = settled(edges.select("grp", F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select("grp", F.col("b").alias("node"), F.col("a").alias("other"))))
    labels = settled(both.groupBy("grp", "node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        heard = both.join(labels.select("grp", F.col("node").alias("other"), F.col("label").alias("_l")), ["grp", "other"]).groupBy("grp", "node").agg(F.min("_l").alias("_l"))
        least = labels.join(heard, ["grp", "node"]).select("grp", "node", F.col("label").alias("_old"), F.least("label", "_l").alias("label"))
        jump = labels.select("grp", F.col("node").alias("label"), F.col("label").alias("_next"))
        moved = settled(least.join(jump, ["grp", "label"], "left").select("grp", "node", "_old", F.least("label", F.coalesce("_next", "label")).alias("label")))
        labels = moved.select("grp", "node", "label")
        if not moved.where("label <> _old").limit(1).count():
            return labels


def fuzzy_clusters(rows: DataFrame, group: Column, text: Column, percent: int = 82) -> DataFrame:
    """(grp, text, cluster) of the distinct texts of each group, empty ones left out: texts at least ``percent`` alike, directly
    or over others, share a cluster, which is named by its least text."""
    texts = settled(rows.select(group.alias("grp"), text.alias("text")).where("text <> ''").distinct())
    edges = settled(candidate_pairs(texts, percent).where(alike(percent)("a", "b")))
    found = components(edges).select("grp", F.col("node").alias("text"), "label")
    return texts.join(found, ["grp", "text"], "left").select("grp", "text", F.coalesce("label", "text").alias("cluster"))
