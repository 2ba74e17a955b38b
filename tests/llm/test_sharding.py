import hashlib
import random
import zlib
from collections import Counter

import pytest

from glyphloom.llm import sharding


def brute(groups, shards):
    """The smallest capacity with which a greedy fill of the sizes takes no more than the shards."""
    sizes = [s for _, s in sorted(groups.items())]
    capacity = max(sizes)
    while True:
        n, now = 1, 0
        for s in sizes:
            if now + s > capacity:
                n, now = n + 1, 0
            now += s
        if n <= shards:
            return capacity
        capacity += 1


@pytest.mark.parametrize("seed, marks", [(1, 4096), (2, 1)])
def test_minimax(spark, seed, marks):
    r = random.Random(seed)
    texts = ["x" * r.randrange(0, 40) + str(r.randrange(30)) for _ in range(150)] + [None, None, "", "hot" * 20] + ["hot" * 20] * (60 if seed == 2 else 3)
    docs = spark.createDataFrame([(i if i != 7 else None, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, shard string")
    rows = sharding.shard(docs, 6, marks=marks).collect()
    assert len(rows) == len(texts)
    groups = Counter()
    for t in texts:
        groups[hashlib.sha256(t.encode()).digest() if t is not None else b""] += len((t or "").encode()) + 1
    loads = Counter()
    for x in rows:
        loads[x.shard] += x.size
    assert max(loads.values()) == brute(groups, 6)
    by_text = {}
    for x in rows:
        if x.doc_id is not None:
            t = texts[x.doc_id]
            assert x.size == len((t or "").encode()) + 1 and x.text_crc32 == zlib.crc32((t or "").encode())
            assert by_text.setdefault(t, x.shard) == x.shard
    for k in range(6):
        slots = sorted(x.slot for x in rows if x.shard == k)
        assert slots == list(range(len(slots)))


def test_few_and_none(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 16).count() == 0
    rows = sharding.shard(spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, text string"), 16).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (0, 1)]
