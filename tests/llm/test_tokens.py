import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphloom.llm import pieces, training_order, wordpiece

MODEL = pieces.default_model()
ODD = ["", "  ", " a", "a  b   ", "日本語 ok", "\x00 é́ 😀 x▁y ▁▁", "a" * 3000, "\n\n\t x\r\n", "<s></s><unk> <0x41>", "ﬁ①", "same", "same", None]


def docs(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pieces string")


def test_pieces_agree_with_the_library():
    p = pieces.pieces(MODEL)
    r = random.Random(2)
    texts = [t for t in ODD if t] + ["".join(r.choice("ab e▁ ,.\n日é😀thingTHE<>0x41") for _ in range(r.randrange(1, 120))) for _ in range(400)]
    for t, (ids, digits) in zip(texts, p.encode(texts)):
        assert ids.tolist() == p.library.encode(t)
        assert p.merge("▁" + t.replace(" ", "▁")) == ids.tolist()
        assert digits == ",".join(map(str, ids.tolist()))
        assert p.decode(ids.tolist()) == p.library.decode(ids.tolist())


def test_encode(spark):
    rows = pieces.encode(docs(spark)).orderBy("doc_id").collect()
    assert [r.pieces.n_tokens for r in rows][0] == 0 and rows[-1].pieces.n_tokens == 0
    assert all(r.pieces.agrees for r in rows)
    assert rows[0].pieces.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert pieces.encode(docs(spark, [])).count() == 0


def naive(first, later, word):
    n, at, known = 0, 0, first
    word = "▁" + word
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return 1 + wordpiece.UNKNOWN
        n, at, known = n + 1, end, later
    return n


def test_automaton_is_greedy_longest_match():
    r = random.Random(1)
    for _ in range(60):
        some = {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(8)}
        first, later = {"▁" + x for x in list(some)[:4]} | ({"▁"} if r.random() < 0.5 else set()), set(list(some)[4:])
        a = wordpiece.Automaton(first, later)
        for _ in range(60):
            w = "".join(r.choice("abcd") for _ in range(r.randrange(1, 10)))
            assert a[w.encode()] == naive(first, later, w)


def test_count(spark):
    rows = wordpiece.count(docs(spark, ["hello world", None, "", "a☃b ok", "ok"]).withColumn("tokens", F.lit(1))).orderBy("doc_id").collect()
    assert [r.tokens.n_words for r in rows] == [2, 0, 0, 2, 1]
    assert rows[1].tokens.n_tokens == 0 and rows[4].tokens.n_tokens == 1
    assert wordpiece.count(docs(spark, [])).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permutation(n):
    got = training_order.permute(np.arange(n), n, 5)
    assert sorted(got.tolist()) == list(range(n))
    if n == 1000:
        assert got.tolist() != training_order.permute(np.arange(n), n, 6).tolist()


def test_training_order_round_trip(spark, tmp_path):
    df = docs(spark, [t for t in ODD] + ["word " * 300]).withColumn("slot", F.lit(0))
    rows = training_order.training_order(df, length=16, per_shard=8).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
    assert all(r.shard * 8 + r.record == r.slot and r.byte_offset == r.record * 32 and len(r.ids) == 32 for r in rows)
    p = pieces.pieces(MODEL)
    for i, t in enumerate(ODD):
        own = sorted((r.seq_no, np.frombuffer(bytes(r.ids), "<u2")[: r.n_ids].tolist()) for r in rows if r.doc_id == i)
        assert [x for _, ids in own for x in ids] == p.library.encode(t or "") + [2]
    by = {r.slot: bytes(r.ids) for r in rows}
    for passes in (1, 3):
        path = f"{tmp_path}/shards-{passes}"
        index = training_order.materialise(df, path, passes, length=16, per_shard=8).collect()
        assert sorted((r.slot, r.shard, r.record, r.doc_id, r.seq_no, r.n_ids, r.ids_crc32) for r in index) == sorted((r.slot, r.shard, r.record, r.doc_id, r.seq_no, r.n_ids, r.ids_crc32) for r in rows)
        # Resumed from any slot, the same records follow.
        for slot in (0, 7, 8, len(rows) - 1, len(rows)):
            assert [(k, x.tobytes()) for k, x in training_order.records_from(path, slot)] == [(k, by[k]) for k in range(slot, len(rows))]
    assert training_order.training_order(docs(spark, []), length=16).count() == 0
    assert training_order.materialise(docs(spark, []), f"{tmp_path}/none").count() == 0
    assert list(training_order.records_from(f"{tmp_path}/none")) == []


def test_order_does_not_depend_on_splits(spark):
    rows = [(i if i % 7 else None, f"text {i} " * (i % 5)) for i in range(200)] + [(3, "other text of one id"), (3, "other text of one id")]
    found = set()
    for parts, seed in ((1, 1), (7, 2), (40, 3)):
        mixed = list(rows)
        random.Random(seed).shuffle(mixed)
        df = spark.createDataFrame(mixed, "doc_id long, text string").repartition(parts)
        found.add(tuple(sorted((r.slot, repr(r.doc_id), r.seq_no, r.ids_crc32) for r in training_order.training_order(df, length=8, per_shard=64).collect())))
    assert len(found) == 1
