"""Items into containers of fixed capacity: first-fit decreasing in randomised groups.

A tournament tree holds the free room of the open containers, each node the largest of its leaves, so
the leftmost container with enough room is found by one descent. Groups are independent: their number
follows the number of items, so that one holds a few thousand, enough for a loss of a container at the
end of each to vanish, and no task ever holds more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from laserloom.llm.bpe import RANKS, count_tokens

#: Items in a group; a group of more is cut into several.
GROUP = 16_384


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container (0, 1, ...) of each item; sizes at most capacity, zero allowed."""
    n = len(sizes)
    out = np.zeros(n, np.int64)
    leaves = 1
    while leaves < n:
        leaves *= 2
    tree = [capacity] * (2 * leaves)  # containers not opened yet have all their room
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = 1
        while k < leaves:
            k *= 2
            if tree[k] < s:
                k += 1
        out[i] = k - leaves
        tree[k] -= s
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            best = a if a > b else b
            if tree[k] == best:
                break
            tree[k] = best
            k >>= 1
    return out


def pack(df: DataFrame, item: str, size: str, capacity: int, *, group: int = GROUP, seed: int = 7, rows: int | None = None) -> DataFrame:
    """Put items into containers: container LONG, item, part INT, start LONG, n_tokens LONG.

    An item larger than the capacity is split into full parts, each alone in a container, and a rest
    (part = last) that is packed like any other; no other item is split. Null or negative sizes count as
    zero; items of size zero go into the first container of their group. Repeated and null items are
    packed each for itself; the place of a row in its partition is part of what groups it, so they spread too (df must
    read the same way again, as tables do). An empty table gives no rows. Container numbers are unique, not dense.
    rows: the number of rows of df, if known; else df is counted first.
    """
    n = df.count() if rows is None else rows
    groups = max(1, -(-n // group))
    s = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    src = df.select(F.col(item).alias("item"), s.alias("n")).withColumn("g", F.pmod(F.xxhash64("item", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)).cast("long"))
    src = src.repartition("g").sortWithinPartitions("g", F.xxhash64("item", F.lit(seed + 1)), "item")
    schema = T.StructType([T.StructField("container", T.LongType()), src.schema["item"], T.StructField("part", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def flush(parts: list[pa.RecordBatch], g: int, piece: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        n = t.column("n").to_numpy()
        full, rest = n // capacity, n % capacity
        rest_item = (rest > 0) | (full == 0)
        own = np.concatenate([np.repeat(np.arange(len(n)), full), np.flatnonzero(rest_item)])
        which = np.concatenate([np.arange(full.sum()) - np.repeat(np.cumsum(full) - full, full), full[rest_item]])
        took = np.concatenate([np.full(int(full.sum()), capacity, np.int64), rest[rest_item]])
        bins = np.concatenate([np.arange(full.sum()), full.sum() + first_fit_decreasing(rest[rest_item], capacity)])
        # group, piece of the group, container within the piece
        number = (np.int64(g) * (1 << 18) + piece) * (1 << 25) + bins
        items = t.column("item").take(pa.array(own)).combine_chunks()
        items = items.chunk(0) if isinstance(items, pa.ChunkedArray) and items.num_chunks else items
        return pa.RecordBatch.from_arrays([pa.array(number), items, pa.array(which.astype(np.int32)), pa.array(which * capacity), pa.array(took)], names=["container", "item", "part", "start", "n_tokens"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, size_now, piece = None, 0, 0
        for b in batches:
            gs = b.column(2).to_numpy()
            cut = np.flatnonzero(np.append(True, gs[1:] != gs[:-1])).tolist() + [len(gs)] if len(gs) else [0]
            for i, j in zip(cut[:-1], cut[1:]):
                g = int(gs[i])
                if g != now:
                    if held:
                        yield flush(held, now, piece)
                    held, now, size_now, piece = [], g, 0, 0
                while i < j:
                    take = min(j - i, 2 * group - size_now)
                    held.append(b.slice(i, take))
                    i, size_now = i + take, size_now + take
                    if size_now == 2 * group:
                        yield flush(held, now, piece)
                        held, size_now, piece = [], 0, piece + 1
        if held:
            yield flush(held, now, piece)

    return src.mapInArrow(run, schema).withColumnRenamed("item", item)


def pack_documents(documents: DataFrame, *, capacity: int = 2048, ranks: str = RANKS, group: int = GROUP) -> DataFrame:
    """Texts, measured in tokens, into containers; null and empty texts have no tokens but a place."""
    sizes = count_tokens(documents, "text", ranks=ranks, keep=["doc_id"])
    return pack(sizes, "doc_id", "n_tokens", capacity, group=group, rows=documents.count())
