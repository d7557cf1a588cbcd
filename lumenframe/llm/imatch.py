"""I-Match fingerprints over several randomised lexicon subsets.

Terms are runs of letters and digits of the lower-cased text. The lexicon holds the terms whose document frequency, over
all documents, lies in a band (that is, within a band of inverse document frequency). Each of the SUBSETS is a random part of the lexicon,
given by a hash: EACH subsets keep 1 / k of it for each k of KEEP, so that texts of any length meet some in few terms. A document's distinct terms
within a subset are sorted and hashed; the fingerprint is the list of these hashes (8 hex digits each, dashes where no
term is left). Likeness is the share of subsets with equal hashes among those where either has a term; where neither has
any in all subsets, 1.

As each lexicon term is in at least LOW of the documents, the lexicon has at most (mean distinct terms) / LOW terms,
whatever the number of documents. It is counted, and broadcast up to LEXICON_ROWS; beyond, the join shuffles.

Null text counts as empty. Ids may be of any type that orders; rows of equal ids are ordered by text and meet in one task, null ids come
last. One document is its own next document; an empty table gives an empty table. Very long texts are taken whole: a text's
terms are one array. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lumenframe.llm._shared import checkpoint, let, placed

LOW, HIGH = 0.002, 0.15
KEEP = (8, 32, 128, 512)
EACH = 8
SUBSETS = EACH * len(KEEP)
LEXICON_ROWS = 1_000_000
CHUNK_ROWS, MAX_CHUNKS = 1000, 20_000
NONE = "-" * 8


def terms(text: Column) -> Column:
    """Distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def lexicon(docs: DataFrame, text: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, h, mask): terms of the band, a hash, and the subsets that have them as bits. The empty term is in none."""
    n = docs.count()
    seen = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    band = seen.where((F.col("df") >= max(2, n * low)) & (F.col("df") <= max(2, n * high))).select("term")
    mask = sum((F.when(F.pmod(F.xxhash64(F.lit(k), "term"), F.lit(KEEP[k // EACH])) == 0, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(SUBSETS)), F.lit(0).cast("long"))
    some = band.withColumns({"h": F.xxhash64("term"), "mask": mask})
    none = docs.sparkSession.range(1).select(F.lit("").alias("term"), F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("mask"))
    return checkpoint(some.unionByName(none))


def _components(found: Column) -> Column:
    """The subsets' hashes of sorted (h, mask) terms."""

    def one(k: int, s: Column) -> Column:
        mine = F.transform(F.filter(s, lambda x: x["mask"].bitwiseAND(F.lit(1 << k)) != 0), lambda x: x["h"])
        return let(mine, lambda m: F.when(F.size(m) == 0, F.lit(NONE)).otherwise(F.substring(F.lpad(F.lower(F.hex(F.xxhash64(m))), 16, "0"), 1, 8)))

    def level(first: int, s: Column) -> Column:
        """The subsets of one share: the terms that none of them has are put aside once."""
        bits = sum(1 << k for k in range(first, first + EACH))
        return let(F.filter(s, lambda x: x["mask"].bitwiseAND(F.lit(bits)) != 0), lambda some: F.array(*[one(k, some) for k in range(first, first + EACH)]))

    return let(F.array_sort(found), lambda s: F.concat(*[level(first, s) for first in range(0, SUBSETS, EACH)]))


def likeness(a: Column, b: Column) -> Column:
    """Of two lists of subset hashes."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    any_ = F.size(F.filter(pairs, lambda p: (p["a"] != NONE) | (p["b"] != NONE)))
    same = F.size(F.filter(pairs, lambda p: (p["a"] == p["b"]) & (p["a"] != NONE)))
    return F.when(any_ == 0, F.lit(1.0)).otherwise(same / any_)


def _key() -> Column:
    """An id as a key that is never null."""
    return F.coalesce(F.concat(F.lit("s"), F.col("doc_id").cast("string")), F.lit("")).alias("_key")


def in_chunks(docs: DataFrame) -> DataFrame:
    """(chunk, guest, doc_id, text): documents cut by id into chunks of about CHUNK_ROWS; each chunk also has, as guests, the rows of
    the id that follows its last one in descending order, null last (after the last chunk: those of the first id).

    Numeric ids of up to MAX_CHUNKS chunks are cut at quantiles that every task knows, others at each row's rank, for which
    texts are shuffled once more. Which it is changes the plan, not the result: that depends on the order alone.
    """
    n = docs.count()
    if isinstance(docs.schema["doc_id"].dataType, NumericType) and n <= CHUNK_ROWS * MAX_CHUNKS:
        return _by_quantile(docs, n)
    return _by_rank(docs)


def _by_quantile(docs: DataFrame, n: int) -> DataFrame:
    chunks = max(1, -(-n // CHUNK_ROWS))
    ids = docs.select(F.col("doc_id").cast("double").alias("id"))
    cuts = sorted(set(ids.approxQuantile("id", [k / chunks for k in range(1, chunks)], max(1e-4, 0.2 / chunks)))) if chunks > 1 else []
    # null ids come last in descending order
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300)).alias("_id"))
    rows = Bucketizer(splits=[float("-inf"), *(cuts or [0.0]), float("inf")], inputCol="_id", outputCol="_chunk").transform(rows).withColumn("chunk", F.col("_chunk").cast("int"))
    heads = rows.groupBy("chunk").agg(F.max("_id").alias("_head"))
    # at most MAX_CHUNKS rows: which chunk has each head as its guests
    w = Window.orderBy(F.col("chunk"))
    hosts = heads.withColumn("_host", F.coalesce(F.lead("chunk").over(w), F.min("chunk").over(Window.partitionBy())))
    hosts = checkpoint(hosts.select("chunk", F.col("_head").alias("_id"), "_host"))
    to = F.when(F.col("_host").isNull(), F.array(F.struct("chunk", F.lit(False).alias("guest")))).otherwise(F.array(F.struct("chunk", F.lit(False).alias("guest")), F.struct(F.col("_host").alias("chunk"), F.lit(True).alias("guest"))))
    return rows.join(F.broadcast(hosts), ["chunk", "_id"], "left").select("doc_id", "text", F.explode(to).alias("to")).select("to.chunk", "to.guest", "doc_id", "text")


def _by_rank(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = placed(rows.select("doc_id").distinct(), None, ["doc_id"])  # from the smallest
    last = ids.agg(F.max("_pos")).first()[0]
    if last is None:
        return rows.select(F.lit(0).cast("long").alias("chunk"), F.lit(False).alias("guest"), "doc_id", "text")
    at = F.lit(last) - F.col("_pos")
    chunk = F.floor(at / CHUNK_ROWS)
    host = F.when(at % CHUNK_ROWS == 0, F.when(chunk == 0, F.lit(last // CHUNK_ROWS)).otherwise(chunk - 1))
    to = F.filter(F.array(F.struct(chunk.alias("chunk"), F.lit(False).alias("guest")), F.struct(host.alias("chunk"), F.lit(True).alias("guest"))), lambda x: x["chunk"].isNotNull())
    named = ids.select(_key(), to.alias("to"))
    return rows.select("doc_id", "text", _key()).join(named.hint("shuffle_hash"), "_key").select("doc_id", "text", F.explode("to").alias("to")).select("to.chunk", "to.guest", "doc_id", "text")


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited (text), parts, edited_parts, next_parts of (doc_id, text).

    One shuffle of the texts, by chunk; windows, the join with the lexicon and the grouping of terms keep that partitioning.
    """
    lex = lexicon(docs, low=low, high=high)
    lex = F.broadcast(lex) if lex.count() <= LEXICON_ROWS else lex
    w = Window.partitionBy("chunk").orderBy("guest", F.col("doc_id").desc_nulls_last(), "text")
    rows = in_chunks(docs).withColumns({"_next": F.lead("text").over(w), "_rn": F.row_number().over(w), "n_chars": F.length("text").cast("long")})
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("_next", F.lit(1), half))
    rows = rows.withColumn("edited", F.coalesce(edited, F.lit("")))
    tagged = F.concat(F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("e"))), F.transform(terms(F.col("text")), lambda t: F.struct(t.alias("term"), F.lit(0).alias("e"))), F.transform(terms(F.col("edited")), lambda t: F.struct(t.alias("term"), F.lit(1).alias("e"))))
    each = rows.select("chunk", "_rn", F.struct("guest", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256")).alias("of"), F.explode(tagged).alias("t"))
    # the document's own columns go with the empty term alone
    met = each.select("chunk", "_rn", F.when(F.col("t.term") == "", F.col("of")).alias("of"), "t.e", "t.term").join(lex, "term")
    pick = lambda e: F.collect_list(F.when((F.col("e") == e) & (F.col("mask") != 0), F.struct("h", "mask")))
    own = met.groupBy("chunk", "_rn").agg(F.first("of", ignorenulls=True).alias("of"), pick(0).alias("a"), pick(1).alias("b"))
    own = own.select("chunk", "_rn", "of.*", "a", "b")
    parts = own.select("chunk", "_rn", "guest", "doc_id", "n_chars", "edited_sha256", _components(F.col("a")).alias("parts"), _components(F.col("b")).alias("edited_parts"))
    after = F.lead("parts").over(Window.partitionBy("chunk").orderBy("_rn"))
    return parts.withColumn("next_parts", after).where(~F.col("guest")).drop("chunk", "_rn", "guest")
