"""Near-duplicates by SimHash, exact verification on word shingles, and an exact prefix index for what SimHash leaves.

SimHash comes first: fingerprints, byte-position postings, tally and count filter of ``simhash`` (its links(), at its bound of
bits), whose links are verified on the texts' whole sets of shingles. No bit bound on 64 bits finds all texts of the similarity asked for (README),
so the texts that are not connected by then go through an index of the sets themselves, with no bound on what is compared.

Shingles: A-Z lower-cased, words between ASCII white space, the different runs of five words (fewer words: all of them),
as 64-bit hashes mixed from the words' XXH64. Two texts are near-duplicates if the Jaccard similarity of these sets is at least 0.8.

Such sets share at least four fifths of the larger one. In any one order of all shingles, their first three common ones
hence lie among the first n - ceil(0.8 n) + 3 of both; only these prefixes are indexed. The order is by hash, with shingles
that many texts have last, so that common passages lead to few comparisons. Any order gives the same pairs.

Texts of fitting size that share three indexed shingles (fewer, where so few must be common), early enough in both for
what is left to reach the similarity, are compared on their whole sets. So that large groups don't compare all pairs, a
round before this one compares the members of each posting with one of them, the one whose shingles most other texts have
(in a group of edited copies the least edited). Both rounds leave out what is connected already, and the round for all pairs whose
parity bitmaps differ in more bits than similar sets have different shingles (a bit is the parity of the set's shingles
with that hash, so sets differ in as many shingles at least). Postings are sorted and streamed, never gathered. Equal sets
count once from the start.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm._shared import checkpoint, fresh, map_batches, numbered, quoted, released, shared_dir, written
from lumenframe.llm.simhash import SEED, components, with_fingerprint
from lumenframe.llm.simhash import links as fingerprint_links

WIDTH = 5
#: Similarity, as a fraction.
PART, WHOLE = 4, 5
#: Indexed shingles that a pair must share.
SHARED = 3
#: 64-bit words of a parity bitmap.
BITMAP = 4
#: Shingles in over so many texts come last in the order, at most so many of them (neither changes the result).
COMMON, MOST_COMMON = 8, 500_000
#: Shingles that a task counts at once.
COUNTED = 2_000_000
#: Of stored texts.
CODEC = "zstd"
#: Word hashes that a worker keeps.
KEPT_WORDS = 100_000


class _WordHashes(dict):
    """XXH64 of words, kept for those seen of late."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, SEED)
        return h


HASHES = _WordHashes()
#: Odd multipliers of the 64-bit mixing steps (fixed values, of MurmurHash3's finaliser).
MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(h: np.ndarray) -> np.ndarray:
    for m in MIX:
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def shingles_of(text: str | None) -> np.ndarray:
    """Sorted different shingles of a text: the words' hashes, mixed in order."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    width = min(WIDTH, len(words))
    h = np.fromiter(map(HASHES.__getitem__, words), np.uint64, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = _mixed(out + h[k : k + n])
    return np.unique(out).view(np.int64)


def parities(shingles: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set of shingles, as signed longs."""
    odd = np.bincount(shingles.view(np.uint64) >> np.uint64(56), minlength=64 * BITMAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(">i8").astype(np.int64)


def with_digest(docs: DataFrame, text: str = "text", out: str = "fp", bitmap: str = "bits") -> DataFrame:
    """Append a digest of the set of shingles as a signed long, and its parity bitmap as longs bits0, bits1, ... Columns of
    these names are replaced, others are kept."""
    made = [T.StructField(n, T.LongType(), False) for n in (out, *(f"{bitmap}{k}" for k in range(BITMAP)))]
    kept = [f for f in docs.schema.fields if f.name not in {m.name for m in made}]
    schema = T.StructType([*kept, *made])
    at = [f.name for f in kept].index(text)

    def run(batches):
        import xxhash

        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                sets = [shingles_of(t.as_py()) for t in b.column(at)]
                digests = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64)
                bits = np.array([parities(x) for x in sets], np.int64).reshape(-1, BITMAP)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(digests.view(np.int64)), *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], names=schema.fieldNames())

    return map_batches(numbered(docs.select(*[quoted(f.name) for f in kept])), run, schema)


def _each(batches):
    """(fp, shingles) of batches of (fp, text)."""
    for batch in batches:
        for fp, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield fp, shingles_of(text.as_py())
    HASHES.clear()  # workers outlive their tasks


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted shingles that many texts of (fp, text) have. Those that tasks see only once aren't counted."""

    def run(batches):
        def counted(sets):
            values, n = np.unique(np.concatenate(sets), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(values[n > 1]), pa.array(n[n > 1].astype(np.int64))], names=["key", "n"])

        sets, held = [], 0
        for _, found in _each(batches):
            sets.append(found)
            held += len(found)
            if held >= COUNTED:
                yield counted(sets)
                sets, held = [], 0
        if sets:
            yield counted(sets)

    counts = map_batches(texts, run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > COMMON)
    most = counts.orderBy(F.desc("n"), "key").limit(MOST_COMMON).select("key").toArrow()
    return np.sort(most.column("key").to_numpy())


def index_of(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(key, fp, n, at): the prefix of each set of (fp, text), the set's size, and the shingle's place in the order."""
    last = common.tobytes()

    def run(batches):
        late = np.frombuffer(last, np.int64)

        def among(found):
            at = np.searchsorted(late, found)
            return late[np.minimum(at, len(late) - 1)] == found if len(late) else np.zeros(len(found), bool)

        def rows(held):
            sizes = [len(k) for _, k, _ in held]
            cols = np.concatenate([k for _, k, _ in held]), np.repeat([f for f, _, _ in held], sizes), np.repeat([n for _, _, n in held], sizes).astype(np.int32)
            at = np.concatenate([np.arange(k, dtype=np.int32) for k in sizes])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (*cols, at)], names=["key", "fp", "n", "at"])

        held = []
        for fp, found in _each(batches):
            n = len(found)
            length = n - -(-PART * n // WHOLE) + SHARED
            held.append((fp, found[np.argsort(among(found), kind="stable")[:length]], n))
            if len(held) == 512:
                yield rows(held)
                held = []
        if held:
            yield rows(held)

    return map_batches(texts, run, "key long, fp long, n int, at int")


def _fit(m: Column, n: Column) -> Column:
    return WHOLE * F.least(m, n) >= PART * F.greatest(m, n)


def _reach(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether two sets of sizes n and m can be similar if one of their first SHARED common shingles is at places i and j."""
    need = F.ceil((n + m) * PART / (PART + WHOLE)) - (SHARED - 1)
    return _fit(n, m) & (n - i >= need) & (m - j >= need)


def similar(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those pairs (a, b) of (fp, text) whose sets are similar enough. pairs: materialised. Texts are stored and moved, not their
    sets, which take several times the room; a pair's sets are made where its texts meet."""
    mine = written(texts.join(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct(), "fp", "left_semi"), CODEC)
    one, two = (mine.select(F.col("fp").alias(c), F.col("text").alias(f"t{c}")) for c in "ab")
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")

    def run(batches):
        last = {}  # of each side the set made last: pairs of one text come in a row

        def found(side, fp, text):
            if side not in last or last[side][0] != fp:
                last[side] = fp, shingles_of(text.as_py())
            return last[side][1]

        for batch in batches:
            near = []
            for a, b, ta, tb in zip(*(batch.column(k).to_pylist() for k in (0, 1)), batch.column(2), batch.column(3), strict=True):
                x, y = found("a", a, ta), found("b", b, tb)
                # common / (|a| + |b| - common) >= PART / WHOLE
                near.append((PART + WHOLE) * len(np.intersect1d(x, y, assume_unique=True)) >= PART * (len(x) + len(y)))
            yield batch.select([0, 1]).filter(pa.array(near, pa.bool_()))
        HASHES.clear()  # workers outlive their tasks

    return checkpoint(map_batches(both, run, "a long, b long"))


BITS = [f"bits{k}" for k in range(BITMAP)]


def candidates(texts: DataFrame) -> DataFrame:
    """Pairs (a, b), a > b, of (fp, text) by SimHash: of texts with equal fingerprints each with the first, and these firsts by
    the links of ``simhash`` (positional bytes tallied, MAX_BITS verified; long postings by stars), so that large groups don't
    have all their pairs verified."""
    prints = checkpoint(with_fingerprint(texts, out="print").select("fp", "print"))
    firsts = checkpoint(prints.groupBy("print").agg(F.min("fp").alias("first")))
    one, two = (firsts.select(F.col("print").alias(c), F.col("first").alias(f"f{c}")) for c in "ab")
    linked = fingerprint_links(firsts.select(F.col("print").alias("fp")))
    near = linked.join(one, "a").join(two, "b").select(F.greatest("fa", "fb").alias("a"), F.least("fa", "fb").alias("b"))
    equal = prints.join(firsts, "print").where("fp > first").select(F.col("fp").alias("a"), F.col("first").alias("b"))
    return checkpoint(near.unionByName(equal))


def links(every: DataFrame) -> DataFrame:
    """Links (a, b), a > b, between similar sets; their components are those of all similar pairs.

    every: (fp, text, bits0, ...), materialised, one row for each fp; fp is the set's digest.
    """
    texts, w = every.select("fp", "text"), Window.partitionBy("key")
    met = candidates(texts)
    near = similar(met, texts)
    roots = components(near).withColumnRenamed("node", "fp")

    shared = written(index_of(texts, common_shingles(texts)).withColumn("size", F.count(F.lit(1)).over(w)).where("size > 1"))
    # how many texts have a set's shingles, over its prefix
    known = checkpoint(shared.groupBy("fp").agg((F.sum("size") / F.max("n")).alias("known"))).join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    led = shared.join(known, "fp").withColumn("head", F.first(F.struct("fp", "n", "at", "root")).over(w.orderBy(F.desc("known"), "fp")))
    led = led.where((F.col("root") != F.col("head.root")) & _reach(F.col("n"), F.col("at"), F.col("head.n"), F.col("head.at")))
    pairs = led.groupBy(F.greatest("head.fp", "fp").alias("a"), F.least("head.fp", "fp").alias("b")).count().where(F.col("count") >= SHARED).select("a", "b")
    tried = checkpoint(pairs.join(met, ["a", "b"], "left_anti"))
    first = near.unionByName(similar(tried, texts))

    roots = components(first).withColumnRenamed("node", "fp")
    named = shared.drop("size").join(every.select("fp", *BITS), "fp").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = named.withColumns({"low": F.min("root").over(w), "top": F.max("root").over(w)}).where("low < top").drop("low", "top")
    other = open_.select("key", F.col("fp").alias("b"), F.col("n").alias("m"), F.col("at").alias("there"), F.col("root").alias("its"), *[F.col(c).alias(f"its_{c}") for c in BITS])
    differ = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"its_{c}"))) for c in BITS), F.lit(0))
    # |a xor b| = |a| + |b| - 2 common, of which similar sets have (WHOLE - PART) / (WHOLE + PART) at most
    close = (PART + WHOLE) * differ <= (WHOLE - PART) * (F.col("n") + F.col("m"))
    rest = open_.join(other, "key").where((F.col("b") < F.col("fp")) & (F.col("root") != F.col("its")) & _reach(F.col("n"), F.col("at"), F.col("m"), F.col("there")) & close)
    rest = rest.groupBy(F.col("fp").alias("a"), "b", F.greatest("n", "m").alias("n")).count().where(F.col("count") >= F.least(F.lit(SHARED), F.ceil(F.col("n") * PART / WHOLE))).select("a", "b")
    return first.unionByName(similar(checkpoint(rest.join(tried.unionByName(met), ["a", "b"], "left_anti")), texts))


def representatives(docs: DataFrame) -> DataFrame:
    """(fp, bits0, ..., id, text, c0, c1, ...): of the documents of each digest the row of the smallest doc_id (null last), with the
    columns under numbers, in a table bucketed by fp, so that joins on it don't move texts. Copies are combined before
    they are shuffled."""
    spark = docs.sparkSession
    fp, bits = fresh(docs.columns, "fp"), "bits"
    while any(c.lower().startswith(bits) for c in docs.columns):
        bits += "_"
    mine = with_digest(docs, out=fp, bitmap=bits)
    row = F.struct(*[quoted(c).alias(f"c{k}") for k, c in enumerate(docs.columns)])
    order = F.struct(quoted("doc_id").isNull(), quoted("doc_id"), F.xxhash64(quoted("text")))
    least = mine.groupBy(F.col(fp).alias("fp")).agg(F.min_by(row, order).alias("r"), *[F.first(f"{bits}{k}").alias(c) for k, c in enumerate(BITS)])
    flat = least.select("fp", *BITS, F.col("r.c%d" % docs.columns.index("doc_id")).alias("id"), F.col("r.c%d" % docs.columns.index("text")).alias("text"), *[F.col(f"r.c{k}") for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")])
    name = f"representatives_{uuid.uuid4().hex}"
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    flat.write.bucketBy(buckets, "fp").sortBy("fp").option("compression", CODEC).option("path", f"{shared_dir(spark).rstrip('/')}/tables/{name}").saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the session's catalog; the files stay, and so does the plan that reads them
    return found


def dedup(docs: DataFrame) -> DataFrame:
    """Documents without near-duplicates: of each component of similar sets the row of the smallest doc_id stays (of repeated
    ids one). All columns stay. Null texts count as empty; all texts without a word are one group. An empty table gives an
    empty table; the longest text is one row in memory."""
    with released(docs.sparkSession):
        every = representatives(docs)
        roots = components(links(every)).withColumnRenamed("node", "fp")
    grouped = every.select("fp", "id").join(roots, "fp", "left").select("fp", "id", F.coalesce("root", "fp").alias("root"))
    best = grouped.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "fp")).alias("k")).select(F.col("k.fp").alias("fp"))
    place = {"doc_id": "id", "text": "text"}
    return every.join(best, "fp", "left_semi").select(*[F.col(place.get(c, f"c{k}")).alias(c) for k, c in enumerate(docs.columns)])
