"""Quality rules: text statistics, fixed rules, and robust multivariate outliers.

Statistics are per row (``with_text_stats``); null text counts as empty. The outlier verdict comes from a minimum
covariance determinant estimate for each language and source: the location and scatter of the three quarters of the
documents with the smallest determinant of the scatter. Three starts (median and MAD; mean and covariance; the half of
the documents whose largest standardised deviation is least) take START_STEPS concentration steps each, the start of the
smallest determinant goes on until no group's determinant shrinks any more (MAX_STEPS at most), and is reweighted once. A
document is rejected when its Mahalanobis distance from its group's location is beyond the cutoff. Small groups
are pooled: a (language, source) of fewer than MIN_GROUP documents joins the pool of its language, a pool of fewer joins
the common pool, and a common pool of fewer rejects nothing. Null languages and sources count as empty strings.

Repeated rows are documents of their own. Ties in distance fall in one bin and are in or out of the core together. An
empty table gives an empty table. Input columns stay, whatever their names; those named as a result are replaced.

Statistics are transformed and rounded to integers (SCALE steps a unit); sums are exact decimals and quantiles are
taken over fixed bins, so results don't depend on the order of rows. Documents that fail the fixed rules, and those
without a word, take no part in the estimates. Scatter has a floor (FLOOR) so that constant statistics don't reject.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm._shared import checkpoint_groups, fresh, join_groups, let, packed, quoted, unpacked, words_of, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
MIN_GROUP = 60
CORE = 0.75
STARTS, START_STEPS, MAX_STEPS = 3, 1, 5
#: Least decrease of a log determinant that another step is taken for.
SHRINKS = 1e-3
SCALE = 4096
#: Least standard deviation of each transformed statistic: mean word length, symbols, duplicate lines, repeated words.
#: Each statistic can go beyond the cutoff by itself: log(6) / 0.26 and asin(sqrt(0.5)) / 0.13 do, squared.
FLOOR = (0.06, 0.25, 0.26, 0.13)
FEATURES = tuple(f"_f{k}" for k in range(4))
#: Quantiles of chi-square with 4 degrees of freedom: at CORE, at 0.975 (reweighting), and the cutoff (1 - 1e-6).
CHI_CORE, CHI_REWEIGHT, CUTOFF = 5.3853, 11.1433, 33.3768
#: Makes the core's covariance consistent at the normal: CORE / P(chi-square with 6 degrees <= CHI_CORE).
CONSISTENT = CORE / (1 - math.exp(-CHI_CORE / 2) * (1 + CHI_CORE / 2 + CHI_CORE**2 / 8))
STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _repeat_words(words: Column) -> Column:
    """Words in windows of three words that are found twice or more."""
    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"])) | (F.get(s, k + 1)["h"] == x["h"]))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        return F.aggregate(starts, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    # windows that don't all differ: sort them with their places
    return let(windows, lambda w: F.when(F.size(F.array_distinct(F.transform(w, lambda x: x["h"]))) == F.size(w), F.lit(0)).otherwise(let(F.array_sort(w), covered)))


def with_text_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """Append the statistics of each whole text as longs; columns of their names are replaced."""
    t = F.coalesce(quoted(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    found = let(words_of(t), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    per_line = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    w, n = fresh(docs.columns, "_w"), fresh(docs.columns, "_l")
    out = docs.withColumns({
        w: found, n: per_line,
        "word_chars": F.length(F.translate(t, " \t\n\x0b\f\r", "")).cast("long"),
        "n_symbols": (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long"),
    })
    return out.withColumns({"n_words": F.col(f"{w}.n").cast("long"), "n_repeat_words": F.col(f"{w}.r").cast("long"), "n_lines": F.col(f"{n}.n").cast("long"), "n_dup_lines": F.col(f"{n}.d").cast("long")}).drop(w, n)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def features() -> dict[str, Column]:
    """Transformed statistics, rounded to integers of 1 / SCALE."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        F.log1p(20.0 * F.col("n_symbols") / words),
        F.log1p(5.0 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        F.asin(F.sqrt(F.least(F.col("n_repeat_words") / words, F.lit(1.0)))),
    )
    return {f: F.round(v * SCALE).cast("long") for f, v in zip(FEATURES, values, strict=True)}


def _bin_quantile(rows: DataFrame, keys: list[str], bin_: str, share: float) -> DataFrame:
    """For each key the least bin that at least this share of its rows don't exceed. rows: (keys, bin)."""
    counts = rows.groupBy(*keys, bin_).count()
    w = Window.partitionBy(*keys)
    upto = F.sum("count").over(w.orderBy(bin_).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("_upto", upto).withColumn("_all", F.sum("count").over(w)).where(F.col("_upto") >= F.ceil(F.col("_all") * share)).groupBy(*keys).agg(F.min(bin_).alias(bin_))


#: Width of the bins for medians, in steps of 1 / SCALE; there are at most a few thousand bins a group.
MEDIAN_BIN = 16


def _coordinates(groups: DataFrame, name: str) -> DataFrame:
    """(key, feature number, bin) to one row a key with columns name0.. of bin middles."""
    return groups.groupBy("_g").agg(*[F.max(F.when(F.col("_k") == k, F.col("_b"))).alias(f"{name}{k}") for k in range(len(FEATURES))])


PAIRS = [(r, c) for r in range(len(FEATURES)) for c in range(r + 1)]


def _distance() -> Column:
    """Squared Mahalanobis distance, with location _m and inverse scatter _i of the group's row."""
    z = [F.col(f) / SCALE - F.element_at("_m", k + 1) for k, f in enumerate(FEATURES)]
    return reduce(lambda a, b: a + b, [F.element_at("_i", k + 1) * z[r] * z[c] * (1.0 if r == c else 2.0) for k, (r, c) in enumerate(PAIRS)])


def _solved(cov: Column) -> Column:
    """(inverse, log determinant) of a symmetric 4 x 4 matrix by cofactors; matrices are their entries in PAIRS."""
    place = lambda r, k: PAIRS.index((max(r, k), min(r, k))) + 1

    def adjugate(c: Column) -> Column:
        at = lambda r, k: F.element_at(c, place(r, k))

        def minor(r: int, k: int) -> Column:
            (a, b, d), (x, y, z) = [i for i in range(4) if i != r], [i for i in range(4) if i != k]
            return at(a, x) * (at(b, y) * at(d, z) - at(b, z) * at(d, y)) - at(a, y) * (at(b, x) * at(d, z) - at(b, z) * at(d, x)) + at(a, z) * (at(b, x) * at(d, y) - at(b, y) * at(d, x))

        whole = F.array(*[minor(r, k) * (-1) ** (r + k) for r, k in PAIRS])
        det = lambda m: reduce(lambda p, q: p + q, [at(0, k) * F.element_at(m, place(k, 0)) for k in range(4)])
        return let(whole, lambda m: let(det(m), lambda d: F.struct(F.transform(m, lambda x: x / d).alias("i"), F.log(F.greatest(d, F.lit(1e-300))).alias("d"))))

    return let(cov, adjugate)


KEY = ["_g", "_s"]


def _moments(rows: DataFrame, scale: float) -> DataFrame:
    """(group, start, location _m, inverse scatter _i, log determinant _d): the rows' covariance times ``scale``, plus the floor."""
    d = len(FEATURES)
    exact = lambda c: F.sum(c.cast("decimal(28,0)"))
    sums = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"), *[exact(F.col(f)).alias(f"_s{k}") for k, f in enumerate(FEATURES)], *[exact(F.col(FEATURES[r]) * F.col(FEATURES[c])).alias(f"_p{r}{c}") for r, c in PAIRS])
    n = F.col("_n").cast("double")
    mean = [F.col(f"_s{k}").cast("double") / n / SCALE for k in range(d)]
    cov = F.array(*[(F.col(f"_p{r}{c}").cast("double") / n / SCALE**2 - mean[r] * mean[c]) * scale + (FLOOR[r] ** 2 if r == c else 0.0) for r, c in PAIRS])
    solved = sums.select(*KEY, F.array(*mean).alias("_m"), _solved(cov).alias("_x"))
    return checkpoint_groups(solved.select(*KEY, "_m", F.col("_x.i").alias("_i"), F.col("_x.d").alias("_d")))


def _core(at: DataFrame, share: float, bound: int | None = None) -> DataFrame:
    """The rows of (group, start, features, bin _b) in each group's least bins that hold this share of them. The bins aren't written
    apart: each query leaves memory with the driver."""
    most = _bin_quantile(at.select(*KEY, "_b"), KEY, "_b", share).withColumnRenamed("_b", "_most")
    return join_groups(at, most, KEY, bound=bound).where("_b <= _most")


def _concentrated(rows: DataFrame, params: DataFrame, bound: int | None = None) -> DataFrame:
    """One concentration step of each group and start: the moments of the CORE of the rows nearest to the present ones."""
    at = join_groups(rows, params, ["_g"], bound=bound).select(*KEY, *FEATURES, _bin_of_distance(_distance()).alias("_b"))
    return _moments(_core(at, CORE, bound), CONSISTENT)


def _bin_of_distance(d: Column) -> Column:
    """Bins of about 1.5 % of 1 + distance."""
    return F.floor(F.log1p(d) * 64).cast("long")


def fit(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(language, source -> group), (group -> location, scatter). stats: materialised, with lang, source and STATS.

    The number of groups is counted once; it bounds the tables of all steps.
    """
    usable = stats.where(~base_failed()).select(F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"), *[v.alias(k) for k, v in features().items()])
    counts = usable.groupBy("_lang", "_source").count()
    small = F.col("count") < MIN_GROUP
    pool = checkpoint_groups(counts.where(small).groupBy("_lang").agg(F.sum("count").alias("_pool")))
    named = join_groups(checkpoint_groups(counts), pool, ["_lang"], "left")
    name = F.when(~small, F.concat(F.lit("s:"), F.to_json(F.struct("_lang", "_source")))).when(F.col("_pool") >= MIN_GROUP, F.concat(F.lit("l:"), "_lang")).otherwise("*")
    named = named.withColumn("_g", name)
    total = Window.partitionBy("_g")
    groups = checkpoint_groups(named.withColumn("_all", F.sum("count").over(total)).where(F.col("_all") >= MIN_GROUP).select("_lang", "_source", "_g"))
    bound = groups.count() * STARTS
    # five short columns, which all steps read
    rows = written(join_groups(usable, groups, ["_lang", "_source"], bound=bound).select("_g", *FEATURES))
    # first start: medians and median absolute deviations
    long = rows.select("_g", F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f).alias("_v")) for k, f in enumerate(FEATURES)])).alias("x")).select("_g", "x._k", "x._v")
    medians = checkpoint_groups(_coordinates(_bin_quantile(long.withColumn("_b", F.floor(F.col("_v") / MEDIAN_BIN).cast("long")), ["_g", "_k"], "_b", 0.5), "_md"))
    middle = lambda b: (F.col(b) * MEDIAN_BIN + MEDIAN_BIN // 2).cast("long")
    away = join_groups(rows, medians, ["_g"], bound=bound).select("_g", F.explode(F.array(*[F.struct(F.lit(k).alias("_k"), F.floor(F.abs(F.col(f) - middle(f"_md{k}")) / MEDIAN_BIN).cast("long").alias("_b")) for k, f in enumerate(FEATURES)])).alias("x")).select("_g", "x._k", "x._b")
    spread = _coordinates(_bin_quantile(away, ["_g", "_k"], "_b", 0.5), "_ad")
    sd2 = [(1.4826 * middle(f"_ad{k}") / SCALE) ** 2 + FLOOR[k] ** 2 for k in range(len(FEATURES))]
    start = medians.join(spread, "_g").select("_g", F.lit(0).alias("_s"), F.array(*[middle(f"_md{k}") / SCALE for k in range(len(FEATURES))]).alias("_m"), F.array(*[1 / sd2[r] if r == c else F.lit(0.0) for r, c in PAIRS]).alias("_i"))
    first = checkpoint_groups(start.withColumn("_d", F.lit(float("inf"))))
    # second: all rows; third: the half whose largest standardised deviation from the first start is least
    second = _moments(rows.withColumn("_s", F.lit(1)), 1.0)
    largest = F.greatest(*[F.pow(F.col(f) / SCALE - F.element_at("_m", k + 1), 2) * F.element_at("_i", PAIRS.index((k, k)) + 1) for k, f in enumerate(FEATURES)])
    third = _moments(_core(join_groups(rows, first, ["_g"], bound=bound).select("_g", F.lit(2).alias("_s"), *FEATURES, _bin_of_distance(largest).alias("_b")), 0.5, bound), 1.0)
    params = first.unionByName(second).unionByName(third)
    for _ in range(START_STEPS):
        params = _concentrated(rows, params, bound)
    best = F.min_by(F.struct("_s", "_m", "_i", "_d"), F.struct("_d", "_s")).alias("b")
    params = checkpoint_groups(params.groupBy("_g").agg(best).select("_g", "b.*"))
    for _ in range(MAX_STEPS):
        after = _concentrated(rows, params, bound)
        shrunk = after.join(params.select(*KEY, F.col("_d").alias("_was")), KEY).where(F.col("_was") - F.col("_d") > SHRINKS)
        params = after
        if shrunk.limit(1).count() == 0:
            break
    near = join_groups(rows, params, ["_g"], bound=bound).where(_distance() <= CHI_REWEIGHT)
    return groups, _moments(near.select(*KEY, *FEATURES), 1.0).drop("_s")


def with_verdict(stats: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Append base_failed, distance2 (null where there is no estimate) and kept. stats: as for fit(); all columns stay."""
    groups, params = fit(stats)
    both = checkpoint_groups(groups.join(params, "_g").drop("_g"))
    kept_columns = [c for c in stats.columns if c.lower() not in ("base_failed", "distance2", "kept")]
    rows = stats.select(packed(kept_columns), F.coalesce("lang", F.lit("")).alias("_lang"), F.coalesce("source", F.lit("")).alias("_source"), base_failed().alias("base_failed"), (F.col("n_words") > 0).alias("_any"), *[v.alias(k) for k, v in features().items()])
    rows = join_groups(rows, both, ["_lang", "_source"], "left").withColumn("distance2", F.when(F.col("_any"), _distance()))
    kept = ~F.col("base_failed") & (F.col("distance2").isNull() | (F.col("distance2") <= cutoff))
    return rows.select(*unpacked(kept_columns), "base_failed", "distance2", kept.alias("kept"))
