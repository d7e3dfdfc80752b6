"""Byte-pair encoding of whole corpora with a public rank file.

A text is cut into pieces by the vocabulary's pattern; each distinct piece is merged once per worker.
The merges of a piece run on a segment tree over its byte positions whose nodes hold the least pair
rank and, among equals, the leftmost position: the root names the next merge, and a merge updates the
leaves of the two pairs at its live neighbours and clears one, each in logarithmic time. So a piece of
n bytes takes O(n log n) however long it is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Default place of the rank file; a parameter everywhere. The pattern is the one its README states.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces kept in a worker before its memory of pieces starts afresh (speed only).
KEEP = 1_000_000


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token bytes; the rank is the id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    none = len(ranks) * n + n  # above every key
    token: list[bytes] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    get = ranks.get
    size = 1
    while size < n - 1:
        size *= 2
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(token[i] + token[i + 1])
        if r is not None:
            tree[size + i] = r * n + i  # rank first, then position
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a < b else b

    def put(i: int, key: int) -> None:
        k = size + i
        tree[k] = key
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            best = a if a < b else b
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1

    while tree[1] < none:
        i = tree[1] % n
        j = after[i]
        token[i] += token[j]
        k = after[i] = after[j]
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            r = get(token[i] + token[k])
            put(i, none if r is None else r * n + i)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            r = get(token[h] + token[i])
            put(h, none if r is None else r * n + h)
    out, i = [], 0
    while i < n:
        out.append(ranks[token[i]])
        i = after[i]
    return out


class Encoder(dict):
    """Piece -> number of its entry in the table of id lists; pieces are merged when first seen."""

    def __init__(self, path: str = RANKS, pattern: str = PATTERN):
        import regex

        super().__init__()
        self.ranks = load_ranks(path)
        self.find = regex.compile(pattern).findall
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.flat: list[int] = []
        self.length: list[int] = []
        self._view = None

    def __missing__(self, piece: str) -> int:
        ids = merge(piece.encode("utf-8", "surrogatepass"), self.ranks)
        self.flat.extend(ids)
        self.length.append(len(ids))
        k = self[piece] = len(self.length) - 1
        return k

    def pieces(self, text: str) -> np.ndarray:
        found = self.find(text)
        return np.fromiter(map(self.__getitem__, found), np.int32, len(found))

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all pieces, start of each, length of each)."""
        if self._view is None or len(self._view[2]) != len(self.length):
            n = np.array(self.length, np.int64)
            self._view = np.array(self.flat, np.int32), np.cumsum(n) - n, n
        return self._view

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts on end, offsets); null and empty texts have no ids."""
        own = [self.pieces(t) if t else np.zeros(0, np.int32) for t in texts]
        flat, start, length = self.tables()
        offsets, out = np.zeros(len(texts) + 1, np.int64), []
        for k, p in enumerate(own):
            n = length[p]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out.append(flat[np.arange(total) + np.repeat(start[p] - (ends - n), n)])
            offsets[k + 1] = offsets[k] + total
        if len(self) > KEEP:
            self.forget()
        return (np.concatenate(out) if out else np.zeros(0, np.int32)).astype(np.int32), offsets

    def count(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        own = [self.pieces(t) if t else np.zeros(0, np.int32) for t in texts]
        length = self.tables()[2]
        got = np.array([int(length[p].sum()) for p in own], np.int64)
        if len(self) > KEEP:
            self.forget()
        return got


def spare(name: str, taken: list[str]) -> str:
    """The name, or one like it that is not taken."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def _slices(b: pa.RecordBatch, column: int, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch with about `most` bytes of text, so that long texts don't add up in memory."""
    size = np.nan_to_num(pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False).astype(float))
    cut = np.flatnonzero(np.diff((np.cumsum(size) // most).astype(int))) + 1
    for i, j in zip([0, *cut], [*cut, b.num_rows]):
        if j > i:
            yield b.slice(i, j - i)


def encode_texts(df: DataFrame, text: str, *, out: str = "ids", ranks: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Add `out` (ARRAY<INT>): the ids of the text without special tokens.

    Defined results: a null and an empty text both get an empty list; special tokens' strings in a text
    are ordinary text; a column that already bears the name `out` is replaced. `ranks` must be readable
    at this path by all executors. keep: columns that are passed on (all but `out` by default); a text
    that isn't kept isn't sent back. One narrow pass, no shuffle; whole texts, in slices of bounded size.
    """
    cols = [c for c in (df.columns if keep is None else keep) if c != out]
    src = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").cast("string").alias(spare("__text", cols)))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in cols]).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks)
        for whole in batches:
            for b in _slices(whole, k):
                flat, offsets = enc.encode(b.column(k).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))
                yield pa.RecordBatch.from_arrays([*b.columns[:k], ids], names=[*cols, out])

    return src.mapInArrow(run, schema)


def count_tokens(df: DataFrame, text: str, *, out: str = "n_tokens", ranks: str = RANKS, keep: list[str] | None = None) -> DataFrame:
    """Add `out` (LONG): how many ids encode_texts would give."""
    cols = [c for c in (df.columns if keep is None else keep) if c != out]
    src = df.select(*[F.col(f"`{c}`") for c in cols], F.col(f"`{text}`").cast("string").alias(spare("__text", cols)))
    schema = T.StructType([*df.select(*[F.col(f"`{c}`") for c in cols]).schema.fields, T.StructField(out, T.LongType())])
    k = len(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(ranks)
        for whole in batches:
            for b in _slices(whole, k):
                yield pa.RecordBatch.from_arrays([*b.columns[:k], pa.array(enc.count(b.column(k).to_pylist()))], names=[*cols, out])

    return src.mapInArrow(run, schema)
