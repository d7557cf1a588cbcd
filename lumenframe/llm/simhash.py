"""Near-duplicates by SimHash fingerprints, with a byte-position index, count filtering and exact verification.

Fingerprint: A-Z lower-cased, words between ASCII white space, shingles of three words with repeats (fewer words: all of
them), XXH64 with seed 42; a bit is 1 where it is set in over half the hashes. No word: zero. Null counts as empty.

Links join fingerprints that differ in two bits or fewer. Such a pair has at least MIN_BYTES = 6 of its 8 bytes in common at
the same positions. The inverted index has a posting for each byte at its position. Single positional bytes are held by
1/256 of all fingerprints each, so postings are kept apart by bucket: two of the four byte pairs (six buckets a fingerprint,
at least one of which a pair of six common bytes has in common), with the bytes of the other four positions as postings.
Pairs are tallied over a bucket's postings; each posting they share is one more common positional byte beside the bucket's
four, and pairs that reach six are kept and verified bit by bit. Pairs that share a bucket alone are never enumerated.

Postings longer than POSTING_LIMIT don't enumerate pairs: each of their fingerprints is linked to the 65 values within one
bit of it, and two fingerprints share such a value just when they differ in two bits or fewer; links go to the smallest
fingerprint that has the value, so their number is linear. That is exact, for any length.

Equal fingerprints count once from the start. Components come from alternating large-star and small-star steps.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm._shared import checkpoint, map_batches, numbered, quoted, written

MAX_BITS = 2
MIN_BYTES = 6
POSTING_LIMIT = 32
SEED = 42


def fingerprint_of(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < 3:
        shingles = [b" ".join(words)]
    else:
        shingles = [b" ".join(s) for s in zip(words, words[1:], words[2:], strict=False)]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(s, SEED) for s in shingles], ">u8")
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[k : k + (1 << 14)].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big", signed=True)


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp") -> DataFrame:
    """Append the fingerprint as a signed long. A column of that name is replaced, others are kept."""
    kept = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*kept, T.StructField(out, T.LongType(), False)])
    at = [f.name for f in kept].index(text)

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array([fingerprint_of(t.as_py()) for t in b.column(at)], pa.int64())], names=schema.fieldNames())

    return map_batches(numbered(docs.select(*[quoted(f.name) for f in kept])), run, schema)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _byte(fp: Column, k: int) -> Column:
    """The byte at position k, from the left."""
    return F.shiftrightunsigned(fp, 56 - 8 * k).bitwiseAND(F.lit(0xFF))


#: Buckets: the byte positions that a bucket's members share, and the positions of its postings.
BUCKETS = [((2 * i, 2 * i + 1, 2 * j, 2 * j + 1), tuple(k for k in range(8) if k // 2 not in (i, j))) for i in range(4) for j in range(i + 1, 4)]


def index_of(prints: DataFrame) -> DataFrame:
    """Postings (key, fp): the key is the number of the bucket and the posting's position in it (5 bits), the bucket's four
    bytes, and the posting's byte."""
    fp = F.col("fp")
    keys = []
    for n, (fixed, free) in enumerate(BUCKETS):
        bucket = F.lit(0).cast("long")
        for k in fixed:
            bucket = F.shiftleft(bucket, 8).bitwiseOR(_byte(fp, k))
        for m, k in enumerate(free):
            keys.append(F.lit((n * 4 + m) << 40).cast("long") + F.shiftleft(bucket, 8) + _byte(fp, k))
    return prints.select("fp", F.explode(F.array(*keys)).alias("key"))


def tallied(short: DataFrame) -> DataFrame:
    """(a, b), a > b: pairs of the postings (key, fp) that have MIN_BYTES common positional bytes by count."""
    pair = F.expr("transform(filter(sequence(0, size(fps) - 2), i -> size(fps) > 1), i -> struct(fps[i] AS b, slice(fps, i + 2, size(fps)) AS rest))")
    met = short.groupBy("key").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    met = met.select("key", F.explode(pair).alias("p")).select("key", F.col("p.b").alias("b"), F.explode("p.rest").alias("a"))
    # the four bytes of the bucket, and one for each posting in it
    each = met.groupBy("a", "b", F.floor(F.shiftrightunsigned("key", 40) / 4).alias("bucket")).agg((F.count(F.lit(1)) + 4).alias("common"))
    return each.where(F.col("common") >= MIN_BYTES).select("a", "b").distinct()


def links(prints: DataFrame, limit: int = POSTING_LIMIT) -> DataFrame:
    """Links (a, b), a > b, whose components are those of all pairs of distinct fingerprints within MAX_BITS bits.

    prints: one row for each distinct fingerprint, materialised.
    """
    index = index_of(prints)
    crowded = checkpoint(index.groupBy("key").count().where(F.col("count") > limit).select("key"))
    pairs = tallied(index.join(crowded, "key", "left_anti"))
    close = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    # long postings: meet at values within one bit
    rest = index.join(crowded, "key", "left_semi").select("fp").distinct()
    near = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    spread = rest.select("fp", F.explode(near).alias("value"))
    lowest = spread.groupBy("value").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("top > b").select("value", "b")
    stars = spread.join(lowest, "value").where("fp > b").select(F.col("fp").alias("a"), "b")
    return close.unionByName(stars).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each component that has an edge. edges: (a, b), longs, a > b.

    Large-star links each node's larger neighbours, small-star its smaller ones, to the smallest node of its
    neighbourhood, until the edges are stars. Only counts come to the driver.
    """
    edges = written(edges.select("a", "b").distinct())
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.col("n")).alias("m"))
        large = both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()
        low = large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
        small = large.join(low, F.col("a") == F.col("n"))
        small = small.select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a > b").distinct()
        small = written(small)
        # stars: no node is both a leaf and a centre, and each leaf has one centre (one query for both)
        ends = small.select(F.explode(F.array(F.struct(F.col("a").alias("x"), F.lit(1).alias("up")), F.struct(F.col("b").alias("x"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        if ends.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).where("ups > 1 OR ups = 1 AND least = 0").isEmpty():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root"))
        edges = small
    raise RuntimeError("components did not settle")


def classes(docs: DataFrame, limit: int = POSTING_LIMIT) -> DataFrame:
    """One row for each document of (doc_id, text): doc_id, fp, component_id. Repeated rows stay repeated.

    component_id: the smallest doc_id that links reach. Null ids count as larger than all others; a component of
    only null ids has a null id.
    """
    prints = written(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "fp"))
    distinct = checkpoint(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp"), limit))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = grouped.join(grouped.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def dedup(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each component the row of the smallest doc_id stays (of repeated ids one)."""
    # names that no column of the documents has
    fp, key = (max([n, *(c + "_" for c in docs.columns if c.lower().startswith(n))], key=len) for n in ("_fp", "_key"))
    # the id as text, null as a word: one key for join and distinct, so that texts are shuffled once
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    mine = written(with_fingerprint(docs, out=fp).withColumn(key, name("doc_id")))
    distinct = checkpoint(mine.groupBy(F.col(fp).alias("fp")).agg(F.min("doc_id").alias("first_id")))
    roots = components(links(distinct.select("fp")))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "fp")).alias("k"))
    stay = mine.join(best.select(F.col("k.fp").alias(fp), name("k.first_id").alias(key)), [fp, key], "left_semi")
    # rows that share the fingerprint and the id: one stays
    return stay.dropDuplicates([fp, key]).select(*[quoted(c) for c in docs.columns])
