"""Set-similarity join of documents on 5-word shingles, with adaptive multi-match prefixes.

A document's shingles are 64-bit hashes in increasing order, one order for all. If two
sets of sizes n and m are similar enough, their prefixes of n - ceil(t n) + 1 + s and
m - ceil(t m) + 1 + s shingles share at least s + 1 (for any s below the overlap).

First every distinct set shows a prefix a little longer than it must be. A shingle that
many sets show is costly: it makes as many candidates as pairs of them. Such shingles
generate none. A set with k costly shingles in its prefix can spare them as long as k is
less than the s + 1 that it must share; else its prefix is lengthened to the whole set,
and correspondingly more shared shingles are asked for. Pairs are counted by the cheap
shingles that both show, and those with enough are verified on the whole texts. A whole
set with too few cheap shingles is in no such pair, and the others meet only where as many
as a pair must share can still follow, the rarest first.

Sets that are nearly all costly (members of one large group of near copies) are compared
with the hub of each costly shingle, its set with most costly shingles. What is then
connected needs no more; only sets of different groups that share a costly shingle in
their shortest prefixes are compared with one another.

Equal sets are one node, a hash of the set. Null and empty texts have no shingles and no
links. Rows with equal ids are documents of their own; a null id counts as larger than any
other and comes back null. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .graph import components

NO_ID = 2**63 - 1
REMEMBERED = 400_000


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    #: Similar: 100 * intersection >= percent * union.
    percent: int = 75
    #: A prefix has one more shingle for each so many of the set.
    slack: int = 16
    #: A shingle in so many sets' prefixes is costly.
    costly: int = 24


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


@functools.lru_cache(1)
def _hashes() -> _WordHashes:
    return _WordHashes()


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted set of a text's shingles as 64-bit hashes; a shorter text is one shingle."""
    found = text.lower().split() if text else []
    if not found:
        return np.zeros(0, np.int64)
    w = np.fromiter(map(_hashes().__getitem__, found), np.uint64, len(found))
    k = min(words, len(found))
    h = np.full(len(found) - k + 1, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : len(found) - k + 1 + i]
        h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return np.unique(h.view(np.int64))


def set_key(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def overlap(n, percent: int):
    """What a set of n must share with a similar one at least."""
    return -(-n * percent // 100)


def _texts(docs: DataFrame, id: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text).cast("binary").alias("text")).withColumn("text_id", F.xxhash64("text"))


def _keyed(texts: DataFrame, params: JoinParams) -> DataFrame:
    """id, text_id, key (null without shingles), n. Rows of one id may have different texts; a text is known by text_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for t in batch.column(1):
                s = shingles(t.as_py(), params.words)
                sizes.append(len(s))
                keys.append(set_key(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64())], ["id", "text_id", "key", "n"])

    return texts.mapInArrow(run, "id long, text_id long, key long, n long")


def _shown(texts: DataFrame, params: JoinParams, whole: bool) -> DataFrame:
    """A row for each shingle that a set shows: token, key, rank, n. Copies in one partition show theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            held: list[tuple[np.ndarray, int, int]] = []

            def out() -> pa.RecordBatch:
                lengths = np.array([len(p) for p, _, _ in held])
                ranks = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([p for p, _, _ in held])), pa.array(np.repeat(np.array([k for _, k, _ in held], np.int64), lengths)), pa.array(ranks.astype(np.int32)), pa.array(np.repeat(np.array([n for _, _, n in held], np.int32), lengths))],
                    ["token", "key", "rank", "n"],
                )

            rows = 0
            for t in batch.column(1):
                s = shingles(t.as_py(), params.words)
                if not len(s) or (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                n = len(s)
                held.append((s if whole else s[: n - overlap(n, params.percent) + 1 + n // params.slack], key, n))
                rows += len(held[-1][0])
                if rows > 200_000:
                    yield out()
                    held, rows = [], 0
            if held:
                yield out()

    return texts.mapInArrow(run, "token long, key long, rank int, n int")


def _shared(shown: DataFrame, name: str) -> DataFrame:
    """The rows of shingles that more than one set shows, with df, in how many rows they are. Rows are counted before they move, and joined with the counts, so no shingle needs a task of its own."""
    shown = staged(shown, f"{name}-shown")
    counts = shown.groupBy("token").agg(F.count("*").alias("df"), F.min("key").alias("low"), F.max("key").alias("high")).where("low < high").select("token", "df")
    counts = staged(counts, f"{name}-counts")
    out = staged(shown.join(counts, "token"), name)
    discard(shown, counts)
    return out


def _least(params: JoinParams, whole: bool) -> Column:
    """s + 1 for a set of n: what it must share with a similar set in these prefixes (with the smallest such set)."""
    smallest = F.ceil(F.col("n") * params.percent / 100)
    if whole:
        return smallest
    return F.least(F.floor(smallest / params.slack) + 1, F.ceil(smallest * params.percent / 100))


def _costs(shared: DataFrame, params: JoinParams, whole: bool, name: str) -> DataFrame:
    """key, n, k (costly shingles shown) and least (shared shingles to ask for without the costly ones; at most 0: the prefix doesn't do)."""
    hot = F.col("df") >= params.costly
    df = shared.groupBy("key", "n").agg(F.count_distinct(F.when(hot, F.col("token"))).alias("k"))
    return staged(df.withColumn("least", _least(params, whole) - F.col("k")), name)


def _both(n: str, m: str, params: JoinParams) -> Column:
    """What two similar sets of these sizes share at least."""
    return F.ceil((F.col(n) + F.col(m)) * params.percent / (100 + params.percent))


def _pairs(shared: DataFrame, costs: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs of sets (a, b) whose prefixes have enough cheap shingles in common, of sets whose prefix does. Each such shingle is in fewer than ``costly`` rows, so the pairs grow with the rows."""
    cheap = shared.where(F.col("df") < params.costly).select("token", "key", "n").distinct().join(costs.select("key", "least"), "key")
    other = cheap.select("token", F.col("key").alias("b"), F.col("n").alias("m"), F.col("least").alias("lb"))
    near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * params.percent) & (F.col("key") < F.col("b"))
    need = F.greatest("least", "lb")
    pairs = cheap.join(other, "token").where(near & (need > 0)).groupBy(F.col("key").alias("a"), "b").agg(F.count("*").alias("common"), F.min(need).alias("need"))
    return pairs.where("common >= need").select("a", "b")


def _able(shared: DataFrame, costs: DataFrame, params: JoinParams) -> DataFrame:
    """key, n, k, least and tokens (its cheap shingles, the rarest first) of the whole sets with as many cheap shingles as they must share with a similar set."""
    cheap = shared.where(F.col("df") < params.costly).groupBy("key", "n").agg(F.sort_array(F.collect_set(F.struct("df", "token")))["token"].alias("tokens"))
    able = cheap.join(costs.select("key", "k", F.greatest("least", F.lit(1)).alias("least")), "key")
    return able.where(F.size("tokens") >= F.col("least"))


def _met(able: DataFrame, params: JoinParams) -> DataFrame:
    """key, b and need, what they must share, of whole sets that meet at a cheap shingle from which on both have so many.

    The first shingle of all that two sets share is followed, in each of them, by all others that
    they share. So it is not among the last of either, which therefore need not be looked at.
    """
    shown = able.select("key", "n", "k", F.size("tokens").alias("have"), F.posexplode(F.slice("tokens", F.lit(1), F.size("tokens") - F.col("least") + 1)).alias("at", "token"))
    shown = shown.select("token", "key", "n", "k", (F.col("have") - F.col("at")).alias("left"))
    other = shown.select("token", F.col("key").alias("b"), F.col("n").alias("m"), F.col("k").alias("kb"), F.col("left").alias("left_b"))
    near = (F.least("n", "m") * 100 >= F.greatest("n", "m") * params.percent) & (F.col("key") < F.col("b"))
    need = _both("n", "m", params) - F.least("k", "kb")
    return shown.join(other, "token").where(near & (need > 0) & (F.least("left", "left_b") >= need)).select("key", "b", need.alias("need"))


def _whole_pairs(shared: DataFrame, costs: DataFrame, params: JoinParams) -> DataFrame:
    """The pairs of whole sets (a, b) that must share more than the costly shingles of one of them and have enough cheap ones in common. Others are found elsewhere. Reads a staged table."""
    able = staged(_able(shared, costs, params), "whole-able")
    one, other = able.select("key", "tokens"), able.select(F.col("key").alias("b"), F.col("tokens").alias("tokens_b"))
    pairs = _met(able, params).distinct().join(one, "key").join(other, "b")
    return pairs.where(F.size(F.array_intersect("tokens", "tokens_b")) >= F.col("need")).select(F.col("key").alias("a"), "b")


def _verified(pairs: DataFrame, texts: DataFrame, firsts: DataFrame, params: JoinParams, name: str) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar."""
    pairs = staged(pairs, f"{name}-pairs")
    wanted = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    # Only texts in pairs are moved on.
    held = staged(texts.join(firsts.join(wanted, "key", "left_semi").select("key", "text_id"), "text_id").dropDuplicates(["key"]).select("key", "text"), f"{name}-texts")
    joined = pairs.join(held.select(F.col("key").alias("a"), F.col("text").alias("x")), "a").join(held.select(F.col("key").alias("b"), F.col("text").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, y = None, None
        for batch in batches:
            ok = []
            for x, b, t in zip(batch.column(2), batch.column(1).to_pylist(), batch.column(3)):
                if b != last:
                    last, y = b, shingles(t.as_py(), params.words)
                x = shingles(x.as_py(), params.words)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= params.percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    links = staged(joined.select("a", "b", "x", "y").mapInArrow(run, "a long, b long"), f"{name}-links")
    discard(pairs, held)
    return links


def _crowded(shared: DataFrame, costs: DataFrame, texts: DataFrame, firsts: DataFrame, links: DataFrame, params: JoinParams) -> DataFrame:
    """More links, among sets of which even the whole has so many costly shingles that these alone could make them similar."""
    full = costs.where("least <= 0").select("key", "k")
    rows = staged(shared.select("token", "key", "n", "rank", "df").join(full, "key").distinct(), "crowd")
    hot = rows.where(F.col("df") >= params.costly)
    hubs = staged(hot.groupBy("token").agg(F.max(F.struct("k", "key")).alias("hub")).select("token", F.col("hub.key").alias("hub")), "crowd-hubs")
    stars = hot.join(hubs, "token").where(F.col("key") != F.col("hub")).select(F.col("key").alias("a"), F.col("hub").alias("b")).distinct()
    links = links.unionByName(_verified(stars, texts, firsts, params, "crowd-star"))
    groups = staged(components(links, name="crowd-groups"), "crowd-groups")
    prefix = rows.where(F.col("rank") < F.col("n") - F.ceil(F.col("n") * params.percent / 100) + 1)
    placed = staged(prefix.join(groups, prefix["key"] == groups["node"], "left").select("token", "key", "n", "k", F.coalesce("root", "key").alias("root")), "crowd-placed")
    apart = staged(placed.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("token"), "crowd-apart")
    rest = staged(placed.join(apart, "token", "left_semi"), "crowd-rest")
    # A pair is made once, at the first of the shingles that both have here.
    own = staged(rest.groupBy("key").agg(F.collect_list("token").alias("tokens")), "crowd-tokens")
    rest = rest.join(own, "key")
    other = rest.select("token", *[F.col(c).alias(f"{c}_b") for c in ("key", "n", "k", "root", "tokens")])
    near = (F.least("n", "n_b") * 100 >= F.greatest("n", "n_b") * params.percent) & (_both("n", "n_b", params) <= F.least("k", "k_b"))
    first = F.array_min(F.array_intersect("tokens", "tokens_b")) == F.col("token")
    cross = rest.join(other, "token").where((F.col("root") < F.col("root_b")) & near & first).select(F.col("key").alias("a"), F.col("key_b").alias("b")).distinct()
    return links.unionByName(_verified(cross, texts, firsts, params, "crowd-cross"))


def _grouped(texts: DataFrame, params: JoinParams) -> tuple[DataFrame, DataFrame]:
    """Staged: id, text_id, key (null without shingles), n of each row; and root, low (the smallest id that links reach) of each key."""
    keyed = staged(_keyed(texts, params), "sets")
    firsts = staged(keyed.where("key is not null").groupBy("key").agg(F.min("id").alias("id"), F.min("text_id").alias("text_id")), "first-ids")
    shared = _shared(_shown(texts, params, False), "shared")
    costs = _costs(shared, params, False, "costs")
    links = _verified(_pairs(shared, costs, params), texts, firsts, params, "near")
    discard(shared)
    # Sets whose prefix doesn't do show all they have.
    longer = costs.where("least <= 0").select("key")
    again = texts.join(firsts.join(longer, "key", "left_semi").select("text_id"), "text_id", "left_semi").select(*texts.columns)
    shared = _shared(_shown(again, params, True), "shared-whole")
    costs = _costs(shared, params, True, "costs-whole")
    links = links.unionByName(_verified(_whole_pairs(shared, costs, params), texts, firsts, params, "whole"))
    links = _crowded(shared, costs, texts, firsts, links, params)
    groups = components(links, name="set-groups")
    rooted = firsts.join(groups, firsts["key"] == groups["node"], "left").select("key", "id", F.coalesce("root", "key").alias("root"))
    rooted = staged(rooted, "set-roots")
    smallest = staged(rooted.groupBy("root").agg(F.min("id").alias("low")), "set-lows")
    of_key = staged(rooted.join(smallest, "root").select("key", "root", "low"), "set-components")
    discard(firsts, shared, costs, rooted, smallest)
    return keyed, of_key


def link_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """A row for each document: its id, n_shingles, and component_id, the smallest id that links reach (null: only null ids)."""
    keyed, of_key = _grouped(_texts(docs, id, text), params)
    out = keyed.join(of_key, "key", "left").select(F.col("id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("low", "id").alias("component_id"))
    return out.select(*[F.when(F.col(c) != NO_ID, F.col(c)).alias(c) if c != "n_shingles" else F.col(c) for c in out.columns])


def keep_first(docs: DataFrame, id: str = "doc_id", text: str = "text", params: JoinParams = JoinParams()) -> DataFrame:
    """One document of each group, that with the smallest id (null is larger than any), then hash of the text; of rows equal in both any one. Documents without shingles stay."""
    keyed, of_key = _grouped(_texts(docs, id, text), params)
    rows = keyed.join(of_key, "key").select("id", "text_id", "root")
    first = staged(rows.groupBy("root").agg(F.min(F.struct("id", "text_id")).alias("keep")), "near-firsts")
    counted = rows.groupBy("id", "text_id", "root").agg(F.count("*").alias("n"))
    marked = staged(counted.join(first, "root").select("id", "text_id", "n", (F.struct("id", "text_id") == F.col("keep")).alias("stays")).where("n > 1 or not stays"), "near-marks")
    own = docs.select(F.struct("*").alias("_row"), F.coalesce(F.col(id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.col(text).cast("binary")).alias("text_id"))
    found = own.join(marked, ["id", "text_id"], "left")
    kept = found.where("n is null").select("_row.*")
    # Repeated rows are few: only they are moved.
    twice = found.where("stays").dropDuplicates(["id", "text_id"]).select("_row.*")
    return kept.unionByName(twice)
