"""Byte-pair encoding by backtracking over longest matches, and decoding with an offset table.

A word is spelt in a 512-letter alphabet: byte b, or 256 + b where it ends the word. An Aho-Corasick automaton
gives the longest token that starts at each place. The encoder takes it when it is compatible with the token before it
(the pair would not have been merged or split otherwise by the merge order), else a shorter prefix token, else it steps
back and marks the place as a dead end. Each place is a dead end at most once, so time is linear in the word, and the
result is the one that applying the merges in rank order gives.

Inputs and results: null text encodes to an empty list; an empty list decodes to an empty string; null ids decode to
null. An output column that the input already has is replaced; other columns are kept.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenframe.llm._shared import map_batches, numbered, quoted

_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_S}\p{{L}}\p{{N}}]+")
SPACES = regex.compile(rf"[{_S}]+")
END = "</w>"
#: Words kept in a worker's memo, and pairs in the compatibility table's memo; both keep the last two fillings at most.
MEMO_WORDS, MEMO_PAIRS = 150_000, 500_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Codec:
    """One vocabulary file of the tokenizers library: byte-level BPE with word ends."""

    def __init__(self, spec: str | bytes):
        import ahocorasick

        spec = json.loads(spec)
        model = spec["model"]
        vocab, letters = model["vocab"], byte_letters()
        spelt: dict[str, str] = {}
        for b, letter in enumerate(letters):
            spelt[letter], spelt[letter + END] = chr(b), chr(256 + b)
        size = 1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])])
        self.text: list[str] = [""] * size
        for token, i in vocab.items():
            self.text[i] = token
        for x in spec["added_tokens"]:
            self.text[x["id"]] = x["content"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # order[t]: place of t in the merge order; letters come first
        self.word: list[str] = [""] * size
        self.left, self.right, self.order = list(range(size)), list(range(size)), [0] * size
        self.pair: dict[int, int] = {}
        for k, (token, s) in enumerate(spelt.items()):
            if token in vocab:
                self.word[vocab[token]], self.order[vocab[token]] = s, k
        for k, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if a + b not in vocab or a not in vocab or b not in vocab:
                continue
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            if (x << 20 | y) not in self.pair:
                self.pair[x << 20 | y] = z
            if not self.word[z]:
                self.word[z], self.left[z], self.right[z], self.order[z] = self.word[x] + self.word[y], x, y, 512 + k
        self.compatible: dict[int, bool] = {}
        whole = [False] * size
        for z in sorted((i for i in range(size) if self.word[i]), key=self.order.__getitem__):
            whole[z] = self.left[z] == z or (whole[self.left[z]] and whole[self.right[z]] and self._fits(self.left[z], self.right[z], self.order[z]))
        self.id_of = {self.word[z]: z for z in range(size) if whole[z]}
        self.shorter = [-1] * size
        self.length = [len(w) for w in self.word]
        self.found = ahocorasick.Automaton()
        for w, z in self.id_of.items():
            self.found.add_word(w, z)
            self.shorter[z] = next((self.id_of[w[:k]] for k in range(len(w) - 1, 0, -1) if w[:k] in self.id_of), -1)
        self.found.make_automaton()
        # decoding: token t is blob[offset[t]:offset[t + 1]], cut once a worker
        self.blob = "".join(self.text)
        self.offset = np.concatenate([[0], np.cumsum([len(t) for t in self.text])]).tolist()
        self.token = [self.blob[i:j] for i, j in zip(self.offset, self.offset[1:], strict=False)]
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _fits(self, a: int, b: int, limit: int) -> bool:
        """Whether tokens a, b stay apart when all merges of an order below the limit are applied to their letters."""
        order, left, right, pair = self.order, self.left, self.right, self.pair
        while True:
            z = pair.get(a << 20 | b)
            if z is not None and order[z] < limit:
                return False
            if order[a] > order[b]:
                # a was made last: undo it, merges later than it no longer count
                if left[a] == a:
                    return True
                limit, a = order[a], right[a]
            else:
                if left[b] == b:
                    if left[a] == a:
                        return True
                    limit, a = order[a], right[a]
                else:
                    limit, b = order[b] + 1, left[b]

    def fits(self, a: int, b: int) -> bool:
        key = a << 20 | b
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) >= MEMO_PAIRS:
                self.compatible.clear()
            known = self.compatible[key] = self._fits(a, b, 1 << 40)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, given in the 512-letter alphabet."""
        n, length = len(word), self.length
        longest = [-1] * (n + 1)
        for end, z in self.found.iter(word):
            longest[end - length[z] + 1] = z  # later ends are longer
        token = longest[0]
        if token >= 0 and length[token] == n:
            return [token]
        shorter, known, fits = self.shorter, self.compatible.get, self.fits
        dead, out, at = set(), [], 0
        while at < n:
            last = out[-1] if out else -1
            while token >= 0:
                if at + length[token] not in dead and (last < 0 or known(last << 20 | token) or fits(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += length[token]
                token = longest[at]
            else:
                dead.add(at)
                token = out.pop()
                at -= length[token]
        return out

    def _chunk(self, chunk: str) -> bytes:
        if known := self.older.get(chunk):
            self.memo[chunk] = known
            return known
        ids: list[int] = []
        for piece in PIECES.findall(chunk):
            raw = piece.encode()
            ids += self.encode_word(raw[:-1].decode("latin-1") + chr(256 + raw[-1]))
        known = np.array(ids, np.int32).tobytes()
        if len(self.memo) >= MEMO_WORDS:
            self.older, self.memo = self.memo, {}
        if len(chunk) <= 64:
            self.memo[chunk] = known
        return known

    def _plain(self, text: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # lower case letter by letter: no final form
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")  # str.split() takes these for white space
        low = SPACES.sub(" ", text).lower() if odd else text.lower()
        make = self._chunk
        return [self.memo.get(w) or make(w) for w in (low.split(" ") if odd else low.split()) if w]

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        if self.special_split and any(s in text for s in self.special):
            parts: list[bytes] = []
            for part in self.special_split.split(text):
                parts += [np.array([self.special[part]], np.int32).tobytes()] if part in self.special else self._plain(part)
        else:
            parts = self._plain(text)
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        """Tokens joined by one space; unknown ids are left out."""
        size = len(self.token)
        return " ".join([self.token[i] for i in (ids.tolist() if hasattr(ids, "tolist") else ids) if 0 <= i < size])


_codecs: dict[int, Codec] = {}


def codec_of(spec: str) -> Codec:
    """One codec a worker and vocabulary."""
    key = hash(spec)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int32), pa.int32()))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _mapped(df: DataFrame, made: list[T.StructField], column: str, values) -> DataFrame:
    """Append columns that ``values(codec-independent column array)`` gives for each batch."""
    kept = [f for f in df.schema.fields if f.name not in {m.name for m in made}]
    schema, source = T.StructType([*kept, *made]), df.select([quoted(f.name) for f in kept] + [quoted(column).alias("_in")])
    names = [f.name for f in schema.fields]

    def run(batches):
        for batch in _small(batches):
            got = values(batch.column(batch.num_columns - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *got], names=names)

    return map_batches(numbered(source), run, schema)


class BpeOperator:
    """Encode and decode columns with one vocabulary file. The file (fixed size, under 2 MB) is broadcast."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self.spec = spark.sparkContext.broadcast(f.read())

    def encode(self, df: DataFrame, text: str = "text", out: str = "token_ids") -> DataFrame:
        spec = self.spec
        return _mapped(df, [T.StructField(out, T.ArrayType(T.IntegerType(), True))], text, lambda col: [_lists([codec_of(spec.value).encode(t) for t in col.to_pylist()])])

    def decode(self, df: DataFrame, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
        spec = self.spec
        return _mapped(df, [T.StructField(out, T.StringType())], ids, lambda col: [pa.array([None if x.as_py() is None else codec_of(spec.value).decode(x.values.to_numpy(zero_copy_only=False)) for x in col], pa.string())])

    def round_trip(self, df: DataFrame, text: str = "text", ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
        """Encode, then decode the ids just made, in one pass."""
        spec = self.spec

        def values(col):
            codec = codec_of(spec.value)
            parts = [codec.encode(t) for t in col.to_pylist()]
            return [_lists(parts), pa.array([codec.decode(p) for p in parts], pa.string())]

        return _mapped(df, [T.StructField(ids, T.ArrayType(T.IntegerType(), True)), T.StructField(decoded, T.StringType())], text, values)
