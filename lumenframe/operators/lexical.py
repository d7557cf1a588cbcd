"""Text index and ranked lexical search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from lumenframe.functions import text as X
from lumenframe.sources.files import small_batches


#: Texts of an Arrow batch that are counted at once, and stems that a worker keeps.
SLICE, KEPT = 512, 200_000


class _Stems(dict):
    """Stems of tokens, kept for those seen of late."""

    def __missing__(self, token: str) -> str:
        if len(self) >= KEPT:
            self.clear()
        self[token] = s = X.stem_of(token)
        return s


_STEMS = _Stems()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, stem, tf, doc_len) of batches of (key, tokens): the tokens of a slice are numbered, and counted by text as numbers."""
    for whole in batches:
        for start in range(0, whole.num_rows, SLICE):
            batch = whole.slice(start, SLICE)
            words, sizes = batch.column(1).flatten().dictionary_encode(), pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64)
            stems = pa.array([_STEMS[t] for t in words.dictionary.to_pylist()], pa.string()).dictionary_encode()
            if not len(stems):
                continue
            number = stems.indices.to_numpy().astype(np.int64)[words.indices.to_numpy()]
            found, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(stems) + number, return_counts=True)
            at, stem = found // len(stems), found % len(stems)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), stems.dictionary.take(pa.array(stem)), pa.array(tf.astype(np.int64)), pa.array(sizes[at].astype(np.int32))], ["key", "stem", "tf", "doc_len"])


def postings(docs: DataFrame, key: str = "frame_id", text: str = "caption") -> DataFrame:
    """(key, stem, tf, doc_len): how often each stem occurs in each text. doc_len counts raw tokens.

    Texts are cut into tokens in the JVM and counted whole in the tasks that read them, each different token of a slice being
    stemmed once; what is shuffled are postings. The shuffle adds up texts of one key."""
    small_batches(docs.sparkSession)
    told = docs.select(F.col(key).alias("key"), X.tokens(F.col(text)).alias("tokens"))
    schema = StructType([StructField("key", docs.schema[key].dataType), StructField("stem", StringType()), StructField("tf", LongType()), StructField("doc_len", IntegerType())])
    return told.mapInArrow(_counted, schema).groupBy(F.col("key").alias(key), "stem").agg(F.sum("tf").alias("tf"), F.first("doc_len").alias("doc_len"))


def stats(docs: DataFrame, text: str = "caption") -> DataFrame:
    """One row: number of texts and mean raw-token length."""
    return docs.agg(F.count(F.lit(1)).alias("doc_count"), F.avg(F.size(X.tokens(F.col(text)))).alias("avg_doc_len"))


def sought(docs: DataFrame, terms: list[str], key: str = "frame_id", text: str = "caption") -> DataFrame:
    """The postings (key, stem, tf, doc_len) of some stems alone, by one scan that keeps only tokens that stem to one of them
    before anything is shuffled."""
    own = docs.select(key, F.size(X.tokens(F.col(text))).alias("doc_len"), X.stems_among(F.col(text), terms).alias("_s")).select(key, "doc_len", F.explode("_s").alias("stem"))
    return own.groupBy(key, "stem").agg(F.count(F.lit(1)).alias("tf"), F.first("doc_len").alias("doc_len"))


def search(docs: DataFrame, terms: list[str], key: str = "frame_id", text: str = "caption") -> DataFrame:
    """(key, bm25, matched) of the texts that have any of the query's stems."""
    return scored(sought(docs, terms, key, text).join(F.broadcast(stats(docs, text))), F.col("doc_count"), F.col("avg_doc_len"), key)


def scored(tf: DataFrame, doc_count: Column, avg_doc_len: Column, key: str = "frame_id") -> DataFrame:
    """(key, bm25, matched) from the postings (key, stem, tf, doc_len) of a query's stems."""
    df = tf.groupBy("stem").agg(F.count(F.lit(1)).alias("df"))  # a row for each query term at most
    score = X.bm25(F.col("tf"), F.col("df"), doc_count, F.col("doc_len"), avg_doc_len)
    return tf.join(F.broadcast(df), "stem").groupBy(key).agg(F.sum(score).alias("bm25"), F.sort_array(F.collect_set("stem")).alias("matched"))


def with_quality(hits: DataFrame, docs: DataFrame, terms: list[str], key: str = "frame_id", text: str = "caption", digits: int = 6) -> DataFrame:
    """Append coverage, phrase and quality: half the squashed BM25, .4 weighted coverage, .1 contiguous phrase."""
    again = lambda c: F.transform(c, X._stem_column)
    weigh = lambda a: F.aggregate(F.transform(a, lambda t: F.when(t.isin(X.GENERIC_SUBJECTS), X.SUBJECT_WEIGHT).when(t.isin(X.PARTICLES), X.PARTICLE_WEIGHT).otherwise(1.0)), F.lit(0.0), lambda s, x: s + x)
    query = F.array_distinct(again(F.array(*[F.lit(t) for t in terms])))
    coverage = X.unit(weigh(F.array_intersect(query, again(F.col("matched")))) / weigh(query))
    content = F.concat(F.lit(" "), F.array_join(X.stems_of(F.col(text), content=True), " "), F.lit(" "))
    # only a text with all of the terms can hold the phrase; the others aren't stemmed again
    whole = (F.size("matched") == len(set(terms))) & F.contains(content, F.lit(f" {' '.join(terms)} "))
    phrase = F.when(F.size("matched") < len(set(terms)), 0.0).when(whole, 1.0).otherwise(0.0) if len(terms) > 1 else F.lit(0.0)
    rows = hits.join(docs.select(key, text), key).withColumns({"coverage": coverage, "phrase": phrase})
    quality = 0.5 * F.round(F.col("bm25") / (F.col("bm25") + 1.0), 6) + 0.4 * F.col("coverage") + 0.1 * F.col("phrase")
    return rows.withColumn("quality", F.round(X.unit(quality), digits)).drop(text)


def top(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows by the given keys, with their rank."""
    first = rows.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
