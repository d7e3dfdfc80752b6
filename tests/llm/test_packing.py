from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from laserloom.llm import packing


def plain(sizes, capacity):
    """First-fit decreasing by looking at every container."""
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, r in enumerate(room) if r >= sizes[i]), len(room))
        if k == len(room):
            room.append(capacity)
        room[k] -= sizes[i]
        out[i] = k
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_tree_is_first_fit_decreasing(sizes):
    assert packing.first_fit_decreasing(np.array(sizes, np.int64), 20).tolist() == plain(sizes, 20)


def check(rows, sizes, capacity):
    used, parts = defaultdict(int), defaultdict(list)
    for c, i, part, start, n in rows:
        used[c] += n
        parts[i].append((part, start, n))
    assert all(v <= capacity for v in used.values())
    for i, own in parts.items():
        want = max(sizes.get(i) or 0, 0)
        own.sort()
        assert sum(n for *_, n in own) == want
        assert [s for _, s, _ in own] == [k * capacity for k in range(len(own))] and (len(own) == 1 or all(n == capacity for *_, n in own[:-1]))
        assert len(own) == max(1, -(-want // capacity))
    assert set(parts) == set(sizes)
    return used


def test_pack(spark):
    r = np.random.RandomState(1)
    sizes = {i: int(x) for i, x in enumerate(r.lognormal(4, 1.2, 3000))} | {5000: 0, 5001: None, 5002: -3, 5003: 100, 5004: 101, 5005: 1000}
    d = spark.createDataFrame(list(sizes.items()), "doc_id long, n long").selectExpr("*", "'x' as container", "1 as g")
    rows = [tuple(x) for x in packing.pack(d, "doc_id", "n", 100, group=700).collect()]
    used = check(rows, sizes, 100)
    total = sum(max(v or 0, 0) for v in sizes.values())
    assert len(used) <= -(-total // 100) * 1.05 + 5


def test_repeated_and_null_items_stay(spark):
    d = spark.createDataFrame([(7, 30)] * 500 + [(None, 40)] * 3, "doc_id long, n long")
    rows = packing.pack(d, "doc_id", "n", 100, group=100).collect()
    used = defaultdict(int)
    for x in rows:
        used[x.container] += x.n_tokens
    assert len(rows) == 503 and sum(used.values()) == 15_120 and max(used.values()) <= 100
    assert packing.pack(d.limit(0), "doc_id", "n", 100).count() == 0


def test_documents(spark, small):
    from laserloom.llm.bpe import count_tokens
    from laserloom.llm.queries import QUERIES

    rows = [tuple(x) for x in QUERIES["p7_containers"](spark, small).collect()]
    sizes = {r.doc_id: r.n_tokens for r in count_tokens(spark.read.parquet(f"{small}/documents.parquet"), "text", keep=["doc_id"]).collect()}
    used = check(rows, sizes, 2048)
    assert sum(used.values()) / 2048 / len(used) > 0.9
