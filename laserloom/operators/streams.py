"""Working through sorted partitions in bounded memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def spans(keys: list[np.ndarray]) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(keys[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for k in keys:
        change[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(change), n)


def groups(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], most: int, overlap: int) -> Iterator[tuple[pa.Table, int, int]]:
    """(rows, first, last) of each run of equal keys in sorted batches.

    A run of more than `most` rows comes in pieces that share `overlap` rows on either side; first
    and last bound the rows that are the piece's own, so that each row is judged once."""
    held: list[pa.RecordBatch] = []
    size, first, key = 0, 0, None

    def piece(final: bool):
        nonlocal held, size, first
        t = pa.Table.from_batches(held)
        last = size if final else size - overlap
        got = (t, first, last)
        if final:
            held, size, first = [], 0, 0
        else:
            keep = min(size, 2 * overlap)
            rest = t.slice(size - keep).combine_chunks()
            held, size, first = rest.to_batches(), keep, keep - overlap
        return got

    for b in batches:
        if not b.num_rows:
            continue
        arrays = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        cut = spans(arrays)
        for i, j in zip(cut[:-1], cut[1:]):
            now = tuple(a[i] for a in arrays)
            if key is not None and now != key:
                yield piece(True)
            key = now
            held.append(b.slice(i, j - i))
            size += j - i
            if size > most + 2 * overlap:
                yield piece(False)
    if held:
        yield piece(True)
