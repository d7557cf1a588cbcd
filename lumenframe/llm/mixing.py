"""Mixing of sources to target weights by entropy balancing.

Each source gets a share of words (targets). Rates of documents are those nearest to 1 in relative entropy that give each
source its target, none above CAP: rate = min(CAP, exp(tilt * size / scale)) with one tilt a source. The tilts solve the convex
dual; all sources' tilts are improved together by Newton steps on the log of the words, one distributed sum a step, kept
within a bracket that bisection narrows where a step would leave it. Rates depend on source and size alone, so the sums run
over counts of sizes.

Rates then become whole copies: sizes go in descending order, each takes the copies that bring the words so far nearest to
what the rates ask, and hands the rest on to the next smaller size; within a size, documents with the smallest hashes get one
copy more. A source ends within half of its smallest document's words of its target, unless the bounds of copies forbid it.

Sums are of integers and decimals, and ties go by id, so reruns agree. Size of a document: words; null text has none. Sources
go by code points, null last. Documents without words get rate 1 (in sources that are taken whole: CAP) and take no words.
Repeated rows count each; rows of one id and size have their copies dealt in one task. An empty table gives an empty table.
Very long texts are counted whole. Only doc_id, source and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._shared import checkpoint_groups, join_groups, placed, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
#: Sizes of one source are dealt in chunks of so many at most.
CHUNK = 4096
#: A (source, size) with over 1 / HEAVY of all documents is dealt in SPREAD parts; there are at most HEAVY of them.
HEAVY, SPREAD = 1000, 64
#: Most Newton steps; bisection alone would need no more.
STEPS = 100
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, _s (the source: a key that orders null last), size (words)."""
    source = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    return docs.select("doc_id", source.alias("_s"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """Append ``target`` to (_s, source_size): weights repeat over the sources in order and share ``share`` of all sizes; what
    a source's target would have above ``cap`` times its size is shared again by weight until none is above."""
    order = placed(sources, None, ["_s"], "_i")
    weighed = checkpoint_groups(order.withColumn("_w", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("_i") % len(weights) + 1).cast("int"))).drop("_i"))
    most, wanted = F.col("source_size") * cap, lambda a_weight: F.col("_w") * F.lit(a_weight)
    a_weight, full = 0.0, -1
    while True:
        over = wanted(a_weight) > most if full >= 0 else F.lit(False)
        r = weighed.agg(F.sum("source_size"), F.count(F.when(over, 1)), F.coalesce(F.sum(F.when(over, most)), F.lit(0)), F.sum(F.when(~over, F.col("_w")))).first()
        if r[1] == full or not r[3]:
            break
        full, a_weight = r[1], (share * r[0] - r[2]) / r[3]
    return weighed.withColumn("target", F.when(wanted(a_weight) > most, most.cast("double")).otherwise(wanted(a_weight))).drop("_w")


def rate_of(tilt: Column, size: Column, scale: Column, cap: int = CAP) -> Column:
    """Rate of a document; a null tilt takes the cap."""
    return F.coalesce(F.exp(F.least(tilt * size / scale, F.lit(math.log(cap)))), F.lit(float(cap)))


def _exact(x: Column) -> Column:
    """A sum whose result does not depend on the order of its terms."""
    return F.sum(x.cast("decimal(30,6)")).cast("double")


def balanced(hist: DataFrame, sources: DataFrame, cap: int = CAP, steps: int = STEPS) -> DataFrame:
    """Append ``tilt``, ``scale`` and ``words`` (what the rates give) to sources (_s, source_size, target) by Newton steps.

    hist: _s, size (over 0), n. A source whose target is the cap of all its words has a null tilt.
    """
    n, size, tilt, scale = F.col("n"), F.col("size"), F.col("tilt"), F.col("scale")
    shape = hist.groupBy("_s").agg((F.sum(n * size) / F.sum("n")).alias("scale"), F.min("size").alias("_least"))
    state = sources.join(shape, "_s")
    # The smallest documents' rate alone bounds the words from the target's side.
    edge = F.log(F.col("target") / F.col("source_size")) * scale / F.col("_least")
    state = state.select("_s", "source_size", "target", "scale", F.when(F.col("target") < F.col("source_size") * cap, 0.0).alias("tilt"), F.least(edge, F.lit(0.0)).alias("_lo"), F.greatest(edge, F.lit(0.0)).alias("_hi"))
    state = checkpoint_groups(state)
    bound = state.count()
    for step in range(steps + 1):
        rate = rate_of(tilt, size, scale, cap)
        slope = F.when(rate < cap, n * size * size / scale * rate).otherwise(0.0)
        sums = join_groups(hist, state.select("_s", "tilt", "scale"), ["_s"], bound=bound).groupBy("_s").agg(_exact(n * size * rate).alias("words"), _exact(slope).alias("_slope"))
        state = checkpoint_groups(state.drop("words", "_slope").join(sums, "_s"))
        off = F.abs(F.col("words") - F.col("target")) > F.greatest(F.lit(0.5), F.col("target") * 1e-9)
        if step == steps or not state.where(off & tilt.isNotNull()).limit(1).count():
            break
        under = F.col("words") < F.col("target")
        lo, hi = F.when(under, tilt).otherwise(F.col("_lo")), F.when(under, F.col("_hi")).otherwise(tilt)
        newton = tilt + F.log(F.col("target") / F.col("words")) * F.col("words") / F.nullif(F.col("_slope"), F.lit(0.0))
        moved = F.when((newton > lo) & (newton < hi), newton).otherwise((lo + hi) / 2)
        state = state.withColumns({"tilt": F.when(off, moved).otherwise(tilt), "_lo": lo, "_hi": hi})
    return state.select("_s", "source_size", "target", "scale", "tilt", "words")


def _deal(frame: pd.DataFrame, cap: int) -> pd.DataFrame:
    """Copies k of each size of a chunk, largest first, with what is left over in the last row."""
    frame = frame.sort_values("size", ascending=False)
    left, ks = float(frame["start"].iloc[0]), []
    for n, size, rate in zip(frame["n"], frame["size"], frame["rate"], strict=True):
        left += n * size * rate
        ks.append(min(max(math.floor(left / size + 0.5), 0), cap * n))
        left -= ks[-1] * size
    return frame.assign(k=ks, left=[0.0] * (len(ks) - 1) + [left])[["_s", "size", "n", "rate", "k", "left"]]


def dealt(hist: DataFrame, tilts: DataFrame, cap: int = CAP, chunk: int = CHUNK) -> DataFrame:
    """Copies k that the n documents of each (_s, size) get together. A source's lowest chunk takes on what the others leave."""
    rated = join_groups(hist, tilts, ["_s"]).withColumns({"rate": rate_of(F.col("tilt"), F.col("size"), F.col("scale"), cap), "_chunk": F.floor(F.col("size") / chunk)})
    rated = written(rated.select("_s", "size", "n", "rate", "_chunk", (F.col("target") - F.col("words")).alias("short")))
    low = checkpoint_groups(rated.groupBy("_s").agg(F.min("_chunk").alias("_low"), F.first("short").alias("short")))
    told = join_groups(rated.drop("short"), low, ["_s"])
    schema = "_s string, size long, n long, rate double, k long, left double"

    def deal(frame: pd.DataFrame) -> pd.DataFrame:
        return _deal(frame, cap)

    high = written(told.where(F.col("_chunk") > F.col("_low")).withColumn("start", F.lit(0.0)).groupBy("_s", "_chunk").applyInPandas(deal, schema))
    # Decimals: a sum that doesn't depend on its order.
    over = low.join(high.groupBy("_s").agg(_exact(F.col("left")).alias("left")), "_s", "left").select("_s", (F.col("short") + F.coalesce("left", F.lit(0.0))).alias("start"))
    lowest = join_groups(told.where(F.col("_chunk") == F.col("_low")), over, ["_s"])
    return high.unionByName(lowest.groupBy("_s", "_chunk").applyInPandas(deal, schema)).select("_s", "size", "n", "rate", "k")


def copies(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Append ``copies`` and ``rate`` to rows (doc_id, _s, size): k copies over the n rows of each (_s, size), the same for all
    but for one more to those of smallest hash. groups: _s, size, n, rate, k. Heavy groups are ranked in parts."""
    heavy = groups.where(F.col("n") * HEAVY > total).select("_s", "size", F.lit(SPREAD).alias("_parts"))  # under HEAVY rows
    key = F.xxhash64("doc_id")
    parted = rows.join(F.broadcast(heavy), ["_s", "size"], "left").withColumn("_part", F.coalesce(F.pmod(F.hash("doc_id"), F.col("_parts")), F.lit(0))).drop("_parts")
    cells = parted.join(F.broadcast(heavy.drop("_parts")), ["_s", "size"], "left_semi").groupBy("_s", "size", "_part").agg(F.count(F.lit(1)).alias("_m"))
    split = cells.join(groups, ["_s", "size"]).unionByName(groups.where(F.col("n") * HEAVY <= total).withColumns({"_part": F.lit(0), "_m": F.col("n")}))
    upto = F.sum("_m").over(Window.partitionBy("_s", "size").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda x: F.floor(x.cast("decimal(19,0)") * (F.col("k") % F.col("n")).cast("decimal(19,0)") / F.col("n"))
    plan = split.withColumn("_upto", upto).select("_s", "size", "_part", "rate", F.floor(F.col("k") / F.col("n")).alias("_each"), (share(F.col("_upto")) - share(F.col("_upto") - F.col("_m"))).cast("long").alias("_more"))
    at = F.row_number().over(Window.partitionBy("_s", "size", "_part").orderBy(key, "doc_id"))
    return parted.withColumn("_at", at).join(plan, ["_s", "size", "_part"], "left").select("doc_id", "_s", "size", F.coalesce("rate", F.lit(1.0)).alias("rate"), F.coalesce(F.col("_each") + (F.col("_at") <= F.col("_more")).cast("int"), F.lit(1)).cast("int").alias("copies"))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """doc_id, source, size, source_size, target (of its source), rate, copies, taken (words: copies * size)."""
    rows = written(sizes(docs))
    every = checkpoint_groups(rows.groupBy("_s").agg(F.sum("size").alias("source_size")))
    sources = targets(every, weights, share, cap)
    hist = written(rows.where("size > 0").groupBy("_s", "size").agg(F.count(F.lit(1)).alias("n")))
    groups = written(dealt(hist, balanced(hist, sources, cap), cap))
    found = join_groups(copies(rows, groups, rows.count()), checkpoint_groups(sources), ["_s"])
    source = F.when(F.col("_s") != "t", F.substr("_s", F.lit(2)))
    return found.select("doc_id", source.alias("source"), "size", "source_size", "target", "rate", "copies", (F.col("copies") * F.col("size")).alias("taken"))
