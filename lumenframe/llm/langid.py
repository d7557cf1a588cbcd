"""Language identification: averaged hashed subword embeddings, a linear softmax, stochastic gradient descent in numpy.

Subwords are byte n-grams of two to four bytes of the lower-cased text in which each run of non-letters is one blank;
they are hashed into BUCKETS rows of an embedding table. A text is the mean of its subwords' embeddings; a linear layer
and softmax over it give probabilities. As the layer is linear, prediction uses the table times the layer.

Training uses a bounded sample: the different labelled texts of smallest hash (at most TrainConfig.max_docs), each as its
subword counts in the buckets, so the driver gets at most max_docs times BUCKETS numbers. A fifth of the sample sets the
temperature (by likelihood) and the rejection threshold: the largest probability that rejects at most ``reject`` of it, and
no more than ``most_reject``. A text is also rejected where the share of its subwords in buckets that training met is below
``learnt_share`` of what all but ``reject`` of that fifth have, as other scripts and random letters are. The default of 1 % is four texts of a full sample's fifth, so that a few odd texts don't set it.

Null texts and texts without a letter get ``und`` with score 0 and are rejected; so are all texts if there was nothing to
learn from. Whole texts are used. Prediction reads the text column alone. Repeated rows are predicted alike, and learnt from
once; of equally probable languages the first in order of their names is taken. An empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.llm._shared import map_batches, numbered, quoted

BUCKETS = 1 << 14
UNKNOWN = "und"
OTHER, LETTER = regex.compile(r"[^\p{L}\p{M}]+"), regex.compile(r"\p{L}")
GRAMS = (2, 3, 4)


@dataclass(frozen=True)
class TrainConfig:
    max_docs: int = 2000
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    batch: int = 16
    reject: float = 0.01
    most_reject: float = 0.5
    learnt_share: float = 0.8
    seed: int = 7


def grams(text: str | None) -> np.ndarray:
    """Bucket numbers of a text's subwords; empty for a text without a letter."""
    if not text or not LETTER.search(text):
        return np.empty(0, np.int64)
    plain = OTHER.sub(" ", text.lower()).strip()
    if not plain:
        return np.empty(0, np.int64)
    b = np.frombuffer(f" {plain} ".encode(), np.uint8).astype(np.uint32)
    out = []
    for n in GRAMS:
        if len(b) < n:
            continue
        h = np.full(len(b) - n + 1, n * 0x9E3779B1 & 0xFFFFFFFF, np.uint32)
        for k in range(n):
            h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - 14))
    return np.concatenate(out).astype(np.int64)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # BUCKETS x languages: embeddings times the layer
    bias: np.ndarray
    temperature: float
    threshold: float
    learnt: np.ndarray  # buckets that training texts have
    least_learnt: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, probability, and whether it is accepted."""
        got = grams(text)
        if not len(got) or not self.langs:
            return UNKNOWN, 0.0, False
        mean = (np.bincount(got, minlength=BUCKETS) @ self.table if len(got) > BUCKETS // 4 else self.table[got].sum(0)) / len(got)
        p = _softmax(((mean + self.bias) / self.temperature)[None])[0]
        k = int(np.argmax(p))
        return self.langs[k], float(p[k]), bool(p[k] >= self.threshold and self.learnt[got].mean() >= self.least_learnt)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class Counts(NamedTuple):
    """A text's language, and its buckets and their shares as bytes."""

    lang: str
    bucket: bytes
    n: bytes


def _sampled(rows: DataFrame, config: TrainConfig) -> list:
    """Subword counts of the sampled rows, made on the executors; they come as Arrow batches, one after the other, so that the driver's
    JVM never holds them all."""
    labelled = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang", F.xxhash64("text", "lang").alias("h"))
    last = labelled.select("h").distinct().orderBy("h").limit(config.max_docs).agg(F.max("h")).first()[0]
    some = labelled.where(F.col("h") <= last).dropDuplicates(["h"]) if last is not None else labelled.limit(0)
    schema = "lang string, bucket binary, n binary"

    def count(batches):
        for batch in batches:
            out = {"lang": [], "bucket": [], "n": []}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if len(got := grams(text)):
                    bucket, n = np.unique(got, return_counts=True)
                    out["lang"].append(lang)
                    out["bucket"].append(bucket.astype("<i4").tobytes())
                    out["n"].append((n / n.sum()).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["lang"], pa.string()), pa.array(out["bucket"], pa.binary()), pa.array(out["n"], pa.binary())], names=list(out))

    got = map_batches(some.select("text", "lang"), count, schema).toArrow()
    return sorted(map(Counts, *(got.column(k).to_pylist() for k in range(3))))


def train(rows: DataFrame, config: TrainConfig = TrainConfig()) -> Model:
    """Fit on rows of (text, lang)."""
    data = _sampled(rows, config)
    langs = sorted({r.lang for r in data})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 1.0, np.zeros(BUCKETS, bool), 1.0)
    rng = np.random.default_rng(config.seed)
    at = {x: k for k, x in enumerate(langs)}
    order = rng.permutation(len(data))
    held = order[: len(data) // 5]
    fit = order[len(data) // 5 :]
    buckets = [np.frombuffer(r.bucket, "<i4") for r in data]
    shares = [np.frombuffer(r.n, "<f4") for r in data]
    label = np.array([at[r.lang] for r in data])
    emb = rng.uniform(-1, 1, (BUCKETS, config.dim)) / config.dim
    layer, bias = np.zeros((config.dim, len(langs))), np.zeros(len(langs))
    steps, step = max(1, config.epochs * -(-len(fit) // config.batch)), 0
    for _ in range(config.epochs):
        for some in np.array_split(rng.permutation(fit), -(-len(fit) // config.batch)):
            rate = config.rate * (1 - step / steps)
            step += 1
            x = np.stack([shares[i] @ emb[buckets[i]] for i in some])
            p = _softmax(x @ layer + bias)
            p[np.arange(len(some)), label[some]] -= 1
            back = p @ layer.T
            layer -= rate * 4 * (x.T @ p) / len(some)
            bias -= rate * p.mean(0)
            for i, g in zip(some, back, strict=True):
                emb[buckets[i]] -= np.outer(shares[i] * rate * 40 / len(some), g)
    # buckets that no text was learnt from say nothing
    learnt = np.zeros(BUCKETS, bool)
    for i in fit:
        learnt[buckets[i]] = True
    table = (emb * learnt[:, None]) @ layer
    logits = np.array([shares[i] @ table[buckets[i]] + bias for i in (held if len(held) else fit)])
    truth = label[held if len(held) else fit]

    def loss(t: float) -> float:
        return float(-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean())

    temperature = min((2.0 ** (k / 4) for k in range(-12, 17)), key=loss)
    best = np.sort(_softmax(logits / temperature).max(1))
    threshold = float(min(best[int(config.reject * len(best))], config.most_reject))
    share = np.sort([float(shares[i][learnt[buckets[i]]].sum()) for i in (held if len(held) else fit)])
    least = config.learnt_share * float(share[int(config.reject * len(share))])
    return Model(langs, table, bias, temperature, threshold, learnt, least)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Append lang_pred, score and accepted; columns of these names are replaced, others are kept."""
    made = [T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False), T.StructField("accepted", T.BooleanType(), False)]
    kept = [f for f in docs.schema.fields if f.name not in {m.name for m in made}]
    schema = T.StructType([*kept, *made])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    source = docs.select(*[quoted(f.name) for f in kept], quoted(text).alias("_in"))

    def run(batches):
        m = shared.value
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                got = [m.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _, _ in got], pa.string()), pa.array([s for _, s, _ in got], pa.float64()), pa.array([yes for _, _, yes in got], pa.bool_())], names=schema.fieldNames())

    return map_batches(numbered(source), run, schema)
