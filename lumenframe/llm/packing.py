"""Cost-balanced packing of token sequences.

Each partition is packed by itself, in blocks of a bounded number of tokens, so there is no shuffle and a task holds one
block. A document is cut at each full sequence; those pieces fill sequences of their own. What is left of each document
is dealt in descending length: each goes to the sequence of the lowest estimated cost, ``linear * n + quadratic * n^2``
summed over its pieces, among those with enough capacity left. There are just as many sequences as the block's tokens
need, so where no sequence has room for a whole piece, it is cut over those with the most room. Padding is less than one
sequence a block.

Null and empty texts have one token, the end id. Repeated rows are packed as often as they occur. Other columns of the
input are not carried; ``doc_id`` is the row's key column. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumenframe.llm._shared import map_batches
from lumenframe.llm.bpe import _small, byte_letters

SEQUENCE = 2048
END_ID = 1
BLOCK_TOKENS = 1 << 20
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n, in units of one token's feed-forward work at width 4096.
LINEAR, QUADRATIC = 1.0, 1.0 / 24576
MEMO_CHUNKS = 120_000
#: The pattern of the byte-level pre-tokenizer.
_S = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class ByteBpe:
    """Ids of a byte-level vocabulary file without a normaliser, as the tokenizers library gives them.

    The file's merges are applied by a compiled byte-pair routine, word by word; frequent words come from a memo.
    """

    def __init__(self, spec: str):
        import tiktoken

        spec = json.loads(spec)
        byte = {c: b for b, c in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab, ranks = spec["model"]["vocab"], {}
        for t, i in vocab.items():
            if t not in self.special:
                ranks[bytes(byte[c] for c in t)] = i
        for k, merge in enumerate(spec["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            if vocab[a + b] != 256 + k:
                raise ValueError("ids are not in merge order")
        self.core = tiktoken.Encoding("byte", pat_str=PIECES.pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.memo: dict[str, bytes | None] = {}
        self.older: dict[str, bytes | None] = {}

    def _ids(self, chunk: str) -> bytes:
        ids: list[int] = []
        for piece in PIECES.findall(chunk):
            ids += self.core.encode_single_piece(piece.encode())
        return np.array(ids, np.uint32).tobytes()

    def _chunk(self, chunk: str) -> bytes | None:
        """Ids of a chunk that starts at a white-space character; None where it ends in one, and so isn't a unit."""
        if chunk in self.older:
            known = self.older[chunk]
        else:
            known = None if not chunk or chunk[-1].isspace() else self._ids(chunk)
        if len(self.memo) >= MEMO_CHUNKS:
            self.older, self.memo = self.memo, {}
        if len(chunk) <= 48:
            self.memo[chunk] = known
        return known

    def _plain(self, text: str) -> list[bytes]:
        if "\0" in text:
            return [self._ids(text)]
        # A token starts at each white space that follows another character: cut there
        chunks = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        make = self._chunk
        out = [self.memo.get(c) or make(c) for c in chunks]
        if None in out:
            joined, out = "", []
            for c in chunks:
                joined += c
                if joined and not joined[-1].isspace():
                    out.append(self.memo.get(joined) or make(joined))
                    joined = ""
            if joined:
                out.append(self._ids(joined))
        return out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if self.split and any(s in text for s in self.special):
            return b"".join(np.uint32(self.special[p]).tobytes() if p in self.special else b"".join(self._plain(p)) for p in self.split.split(text))
        return b"".join(self._plain(text))


def cost(n):
    return LINEAR * n + QUADRATIC * n * n


def deal(lengths: list[int], size: int = SEQUENCE) -> list[list[tuple[int, int, int, int]]]:
    """Deal pieces of at most ``size`` tokens to sequences; for each piece its parts (start, length, sequence, offset)."""
    number = -(-sum(lengths) // size)
    room, load = np.full(number, size, np.int64), np.zeros(number)
    out: list[list[tuple[int, int, int, int]]] = [[] for _ in lengths]
    for k in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        start, left = 0, lengths[k]
        while left:
            fits = np.flatnonzero(room >= left)
            at = int(fits[np.argmin(load[fits])]) if len(fits) else int(np.argmax(room))
            n = min(left, int(room[at]))
            out[k].append((start, n, at, size - int(room[at])))
            room[at] -= n
            load[at] += cost(n)
            start, left = start + n, left - n
    return out


SCHEMA = T.StructType([T.StructField(n, t, False) for n, t in (("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()))])


def pack(docs: DataFrame, spec: str, key: str = "doc_id", text: str = "text", size: int = SEQUENCE) -> DataFrame:
    """Pieces of all documents: key, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset.

    spec: contents of the vocabulary file, which are broadcast. sequence_id: partition number, then a count from 0.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    schema = T.StructType([docs.schema[key], *SCHEMA.fields])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder = _coder(shared.value)
        first = TaskContext.get().partitionId() << 36
        rows: list[tuple] = []
        block: list[tuple] = []  # key, start, ids, doc_tokens

        def flush(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], kind) for i, kind in enumerate(kinds)], names=names)

        def packed() -> None:
            nonlocal first
            for (k, start, ids, total), parts in zip(block, deal([len(b[2]) // 4 for b in block], size), strict=True):
                for at, n, seq, offset in parts:
                    rows.append((k, start + at, n, ids[4 * at : 4 * (at + n)], total, first + seq, offset))
            first += -(-sum(len(b[2]) // 4 for b in block) // size)
            block.clear()

        kinds = None
        held = 0
        for batch in _small(batches):
            if kinds is None:
                kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(t) + END_BYTES
                total = len(ids) // 4
                whole = total // size * size
                for start in range(0, whole, size):
                    rows.append((k, start, size, ids[4 * start : 4 * (start + size)], total, first, 0))
                    first += 1
                if total > whole:
                    block.append((k, whole, ids[4 * whole :], total))
                    held += total - whole
                if held >= BLOCK_TOKENS:
                    packed()
                    held = 0
                if len(rows) >= 2048:
                    yield flush(rows)
                    rows = []
        if block:
            packed()
        if rows:
            yield flush(rows)

    return map_batches(docs.select(key, text), run, schema)


END_BYTES = np.uint32(END_ID).tobytes()
_coders: dict[int, ByteBpe] = {}


def _coder(spec: str) -> ByteBpe:
    key = hash(spec)
    if key not in _coders:
        _coders.clear()
        _coders[key] = ByteBpe(spec)
    return _coders[key]
