"""Token ids in training order, as records of a fixed stride.

Each document's ids, ended by one end id, are cut into sequences of ``length`` ids, the
last padded. Sequences are numbered in an order of their documents that depends on ids and
texts alone (by bucket, a hash of both; in a bucket by id, then hash of the text), not on
files or tasks; a keyed Feistel permutation with cycle walking gives each number its own
slot in 0..N-1. Slots go to shards of equal numbers of records, each one task, sorted:
record r of shard s is slot s * per_shard + r, at byte r * stride of the shard's file.
:func:`records_from` reads on from any slot: a stopped run goes on with the same records.

Null and empty texts have the end id as their one sequence. A null id is less than any
other. Repeated rows are sequences of their own; equal rows are in one bucket, in any order.
An empty table gives no records and no files. Columns of the input other than id and text
are not returned.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .pieces import default_model, pieces

#: Documents are dealt into so many buckets, and the driver sees the number of sequences of each.
BUCKETS = 4096


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0..n-1: balanced Feistel rounds over the next even number of bits, walked until inside."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = np.uint64((1 << half) - 1), np.uint64(half)
    keys = [int(k) for k in _mix(np.arange(1, rounds + 1, dtype=np.uint64), key & (2**64 - 1))]
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> shift, x & mask
        for k in keys:
            left, right = right, left ^ (_mix(right, k) & mask)
        x = (left << shift) | right
        out[todo] = x
        todo = todo[x >= np.uint64(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, id: str, text: str, model: str, end_id: int) -> DataFrame:
    """A row for each document: id, text_key, bucket, its ids and end id packed, and n_seq, its number of sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            texts = batch.column(3)
            for at in range(0, batch.num_rows, 512):
                packed = [p.ids_of(r).astype("<u2").tobytes() + end for r in p.rows(texts.slice(at, 512).to_pylist())]
                counts = np.array([-(-len(b) // (2 * length)) for b in packed], np.int64)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, 512) for k in range(3)), pa.array(counts), pa.array(packed, pa.binary())], ["id", "text_key", "bucket", "n_seq", "packed"])

    own = F.col(id).cast("long").alias("id")
    rows = docs.select(own, F.xxhash64(text).alias("text_key"), F.pmod(F.xxhash64(own, text), F.lit(BUCKETS)).cast("int").alias("bucket"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, text_key long, bucket int, n_seq long, packed binary")


def _numbered(rows: DataFrame) -> DataFrame:
    """id, bucket, n_seq, packed, and start: the number of sequences before the document in its bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, before = -1, 0
        for batch in batches:
            buckets, counts = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            starts = np.empty(len(counts), np.int64)
            for i in range(len(counts)):
                if buckets[i] != bucket:
                    bucket, before = buckets[i], 0
                starts[i] = before
                before += counts[i]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(starts)], ["id", "bucket", "n_seq", "packed", "start"])

    return rows.repartition("bucket").sortWithinPartitions("bucket", "id", "text_key").mapInArrow(run, "id long, bucket int, n_seq long, packed binary, start long")


class Order:
    """The sequences of a table in training order: ``rows`` (staged), how many there are, and where they go."""

    def __init__(self, docs: DataFrame, length: int = 256, per_shard: int = 65536, key: int = 20240229, id: str = "doc_id", text: str = "text", model: str | None = None, end_id: int = 2, pad_id: int = 0):
        path = model or default_model()
        if pieces(path).library.get_piece_size() > 65536:
            raise ValueError("ids of more than 16 bits")
        self.length, self.per_shard, self.key, self.id, self.pad_id = length, per_shard, key, id, pad_id
        self.rows = staged(_numbered(sequences(docs, length, id, text, path, end_id)), "sequences")
        counts = np.zeros(BUCKETS, np.int64)
        for r in self.rows.groupBy("bucket").agg(F.sum("n_seq").alias("n")).collect():  # a row for each bucket
            counts[r["bucket"]] = r["n"]
        self.before, self.total = np.cumsum(counts) - counts, int(counts.sum())
        self.shards = -(-self.total // per_shard)

    @property
    def stride(self) -> int:
        return 2 * self.length

    def records(self, first_shard: int = 0, last_shard: int | None = None) -> DataFrame:
        """A row for each sequence of some shards, each shard in one task and in order: slot, shard, record, byte_offset, the document's id, seq_no, n_ids, ids_crc32 and the record itself."""
        stride, before, total, key, per_shard = self.stride, self.before, self.total, self.key, self.per_shard
        pad = np.array([self.pad_id], "<u2").tobytes()
        low, high = first_shard * per_shard, (self.shards if last_shard is None else last_shard + 1) * per_shard

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    b = batch.slice(at, 256)
                    counts = b.column(2).to_numpy()
                    firsts = before[b.column(1).to_numpy()] + b.column(4).to_numpy()
                    of = np.repeat(np.arange(len(counts)), counts)
                    seq = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
                    slots = permute(firsts[of] + seq, total, key)
                    take = np.flatnonzero((slots >= low) & (slots < high))
                    ids, packed = b.column(0).to_pylist(), b.column(3)
                    whole, last = None, -1
                    cut = []
                    for j in take:
                        if of[j] != last:
                            last, whole = of[j], packed[int(of[j])].as_py()
                        cut.append(whole[seq[j] * stride : (seq[j] + 1) * stride])
                    filled = [c + pad * ((stride - len(c)) // 2) for c in cut]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slots[take]), pa.array([ids[of[j]] for j in take], pa.int64()), pa.array(seq[take].astype(np.int32)), pa.array([len(c) // 2 for c in cut], pa.int32()), pa.array([zlib.crc32(x) for x in filled], pa.int64()), pa.array(filled, pa.binary())],
                        ["slot", "id", "seq_no", "n_ids", "ids_crc32", "ids"],
                    )

        found = self.rows.select("id", "bucket", "n_seq", "packed", "start").mapInArrow(run, "slot long, id long, seq_no int, n_ids int, ids_crc32 long, ids binary")
        shard = F.floor(F.col("slot") / per_shard).cast("int")
        placed = found.repartitionById(max(1, -(-(min(high, total) - low) // per_shard)), shard - first_shard).sortWithinPartitions("slot")
        record = F.col("slot") - shard.cast("long") * per_shard
        return placed.select("slot", shard.alias("shard"), record.cast("int").alias("record"), (record * self.stride).alias("byte_offset"), F.col("id").alias(self.id), "seq_no", "n_ids", "ids_crc32", "ids")


def training_order(docs: DataFrame, **kw) -> DataFrame:
    """All records; see :class:`Order` for the settings."""
    return Order(docs, **kw).records()


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _file(top: str, shard: int) -> str:
    return f"{top}/shard-{shard:06d}.bin"


def write_shards(records: DataFrame, path: str) -> DataFrame:
    """Writes each shard as one file of records of a fixed stride; gives the records without their ids.

    ``path`` is a folder that all executors can write, or a URI that pyarrow can. A file gets its
    name only when whole, so a task that runs again replaces it and a lost executor leaves none in part.
    """
    kept = [c for c in records.columns if c != "ids"]
    at, of = records.columns.index("ids"), records.columns.index("shard")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(path)
        store.create_dir(top, recursive=True)
        out = name = part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                name = _file(top, batch.column(of)[0].as_py())
                part = f"{name}.{TaskContext.get().taskAttemptId()}"
                out = store.open_output_stream(part)
            ids = batch.column(at)
            out.write(b"".join(ids.to_pylist()))
            yield batch.select(kept)
        if out is not None:
            out.close()
            store.move(part, name)

    return records.mapInArrow(run, records.drop("ids").schema)


def materialise(docs: DataFrame, path: str, passes: int = 3, **kw) -> DataFrame:
    """Writes all shards and what :func:`records_from` needs under ``path``; gives an index: the records without their ids.

    Each pass moves the records of its share of the shards, so that no more of them lie on disk twice at a time.
    """
    order = Order(docs, **kw)
    indexes = []
    step = max(1, -(-order.shards // passes))
    for first in range(0, max(order.shards, 1), step):
        last = min(order.shards, first + step) - 1
        indexes.append(staged(write_shards(order.records(first, last), path), "order-index"))
    store, top = _store(path)
    store.create_dir(top, recursive=True)
    with store.open_output_stream(f"{top}/order.json") as out:
        out.write(json.dumps({"sequences": order.total, "per_shard": order.per_shard, "stride": order.stride, "pad_id": order.pad_id}).encode())
    discard(order.rows)
    index = indexes[0]
    for more in indexes[1:]:
        index = index.unionByName(more)
    return index


def records_from(path: str, slot: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """(slot, ids with padding) of a written order from a slot on, read in order."""
    store, top = _store(path)
    with store.open_input_stream(f"{top}/order.json") as f:
        about = json.loads(f.read())
    while slot < about["sequences"]:
        shard, record = divmod(slot, about["per_shard"])
        with store.open_input_file(_file(top, shard)) as f:
            f.seek(record * about["stride"])
            while len(x := f.read(about["stride"])) == about["stride"]:
                yield slot, np.frombuffer(x, "<u2")
                slot += 1
        if record == slot - shard * about["per_shard"]:
            raise ValueError(f"{_file(top, shard)} ends before slot {slot}")
