"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

A text's words become templates: a number, a name (capitalised inside a sentence) or a
unit after a number becomes a typed placeholder that remembers its value; case and
punctuation go. Capitals say nothing in a run of capitalised words (a title, a text in
capitals), so such runs have no names. Windows of template words are joined by hash with the windows of the
benchmark. Where a window has placeholders, the values in the benchmark item and those
in the document are paired; an item asked again with other parameters pairs each old
value with one new value throughout (consistency).

A document holds an item if enough of the item's windows are found in it and the pairs
are consistent, within one alignment (windows as far apart as in the item) or over the
best places of all windows. An item of fewer words than a window is one window of its
own length and found with equal values only. Null and empty texts hold nothing; rows
with equal ids (null too) but different texts are judged each by itself, items likewise.
An empty benchmark or corpus gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fixed, without_punctuation, words_of

NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
PLACEHOLDERS = f"{NAME}-{UNIT}"
#: Stands around a run of capitalised words while a text is read; so many words are a run.
RUN, CAPITALS = "\ue004", 5
# Units of measure.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal s sec min h hr hrs hz khz mhz ghz w kw mw kwh v a j kj k c f pa kpa mpa bar mph kph percent dollars euros pounds cents usd eur gbp"
#: Joins the values of a window.
COMMA = "\x01"
#: A capitalised word, up to a mark inside it that a capital follows. Its repeats and those of numbers give nothing back
#: (possessive): the engine of patterns calls itself for each repeat that could, and a long run would overflow the stack.
CAPITALISED = r"\p{Lu}\p{L}*+(?:['’-]++(?!\p{Lu})\p{L}++)*+"


@dataclass(frozen=True)
class DecontaminationParams:
    window: int = 8
    #: An item is held with this share of its windows found, or this many of them.
    least_share: float = 0.5
    enough_windows: int = 13
    least_consistency: float = 0.5
    #: The benchmark's windows are broadcast up to this many; beyond, both sides are shuffled.
    broadcast_windows: int = 500_000


def _evened(t: Column) -> Column:
    """A text with its runs of capitalised words in lower case, their marks taken out again."""
    t = F.regexp_replace(t, f"((?:{CAPITALISED}(?:[^\\p{{L}}]++|$)){{{CAPITALS},}}+)", f"{RUN}$1{RUN}")
    return F.array_join(F.transform(F.split(t, RUN), lambda part, i: F.when(i % 2 == 1, F.lower(part)).otherwise(part)), "")


def template_texts(texts: DataFrame, text: str, result: str = "words") -> DataFrame:
    """Adds the words of a text, lower-cased, without punctuation; a placeholder word starts with its type, and its value follows."""
    plain = F.coalesce(F.col(text), F.lit(""))
    for c in (NAME, NUMBER, UNIT, RUN):
        plain = F.replace(plain, F.lit(c), F.lit(""))
    df = fixed(texts, result, plain)
    # Few texts have such runs; the others are only searched for them.
    df = fixed(df, result, F.when(F.col(result).rlike(f"(?:{CAPITALISED}[^\\p{{L}}]++){{{CAPITALS - 1}}}\\p{{Lu}}"), _evened(F.col(result))).otherwise(F.col(result)))
    return fixed(df, result, _template_words(F.col(result)))


def _template_words(t: Column) -> Column:
    t = F.regexp_replace(t, r"(\p{Lu}(?<=[\p{L},;] .)[\p{L}'’-]*)", f"{NAME}$1")
    t = F.regexp_replace(F.lower(t), r"([0-9]++(?:[.,:/][0-9]++)*+)", f"{NUMBER}$1")
    t = F.regexp_replace(t, rf"({NUMBER}[0-9.,:/]+ ?)({'|'.join(UNITS.split())})\b", f"$1{UNIT}$2")
    return words_of(without_punctuation(t))


def _slot(word: Column) -> Column:
    """Whether a word is a placeholder: these begin with one of three neighbouring characters."""
    return (word >= NAME) & (word < chr(ord(UNIT) + 1))


def windows(texts: DataFrame, id: str, text: str, size: int, whole: bool = False) -> DataFrame:
    """A row for each window: id, at (its first word, from 0), hash, values (null without placeholders), n (windows in the text). Of ``whole`` texts only those of one window."""
    n_words = F.size("words")
    df = template_texts(texts.select(F.col(id).alias("id"), F.col(text).alias("text")), "text").drop("text").where(n_words == size if whole else n_words >= size)
    df = fixed(df, "slotted", F.exists("words", _slot))
    value = lambda w: F.when(_slot(w), w)
    template = lambda w: F.xxhash64(F.when(_slot(w), F.regexp_replace(w, f"([{PLACEHOLDERS}])[^{PLACEHOLDERS}]*", "$1")).otherwise(w))
    df = df.withColumn("hashes", F.when(F.col("slotted"), F.transform("words", template)).otherwise(F.transform("words", lambda w: F.xxhash64(w))))
    df = df.withColumn("values", F.when(F.col("slotted"), F.transform("words", value)))
    df = fixed(df, "x", F.struct("hashes", "values", "slotted")).select("id", "x.*")
    more = "".join(f", get(hashes, i + {k})" for k in range(1, size))
    df = df.withColumn("found", F.expr(f"transform(slice(hashes, 1, size(hashes) - {size - 1}), (h, i) -> named_struct('hash', xxhash64(h{more}), 'values', if(slotted, nullif(array_join(slice(values, i + 1, {size}), '{COMMA}'), ''), null)))"))
    return df.select("id", F.size("found").alias("n"), F.posexplode("found").alias("at", "w")).select("id", "at", "n", "w.hash", "w.values")


def _meeting(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams, size: int) -> DataFrame:
    """The windows of documents that have the template of an item's window: of full size, or the whole of shorter items."""
    whole = size < params.window
    # Items in lower case too: a copy without capitals shows no names.
    both = windows(benchmark, "id", "text", size, whole).unionByName(windows(benchmark.withColumn("text", F.lower("text")), "id", "text", size, whole))
    items = both.dropDuplicates(["id", "at", "hash"]).select(F.col("id").alias("item"), F.col("at").alias("item_at"), F.col("n").alias("n_windows"), "hash", F.col("values").alias("item_values"))
    if items.limit(params.broadcast_windows + 1).count() <= params.broadcast_windows:
        items = F.broadcast(items)
    found = windows(docs, "id", "text", size).select("id", "at", "hash", "values").join(items, "hash").drop("hash")
    found = found.withColumn("equal", F.col("values").eqNullSafe(F.col("item_values"))).withColumn("size", F.lit(size))
    # A short item says too little to be asked again with other values.
    return found.where("equal") if whole else found


def _keyed(texts: DataFrame, id: str, text: str) -> DataFrame:
    """id (the id and a hash of the text: rows of one id may have different texts) and text."""
    return texts.select(F.struct(F.col(id).alias("id"), F.xxhash64(text).alias("text")).alias("id"), F.col(text).alias("text"))


def held_items(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item that it holds: n_found and n_windows of the item, first_word and last_word in the document, consistency (1 without values), same_values."""
    held = _held(_keyed(docs, id, text), _keyed(benchmark, item, item_text), params)
    return held.select(F.col("id.id").alias(id), F.col("item.id").alias(item), "n_found", "n_windows", "first_word", "last_word", "consistency", "same_values")


def _held(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams) -> DataFrame:
    """The rows of held_items by the keys (id) of documents and items."""
    lengths = template_texts(benchmark, "text").select(F.size("words").alias("n")).where((F.col("n") > 0) & (F.col("n") < params.window)).distinct().collect()
    found = reduce(DataFrame.unionByName, [_meeting(docs, benchmark, params, size) for size in [params.window, *sorted(r["n"] for r in lengths)]])
    enough = (F.col("n_found") >= params.enough_windows) | (F.col("n_found") >= params.least_share * F.col("n_windows"))
    # Windows that lie in the document as in the item are one alignment, judged by itself.
    wordless = F.coalesce(F.size(F.split("values", COMMA)) == F.col("size"), F.lit(False))
    window = F.struct("item_at", "at", "equal", "item_values", "values", "size", wordless.alias("wordless"))
    aligned = found.groupBy("id", "item", (F.col("at") - F.col("item_at")).alias("offset")).agg(F.first("n_windows").cast("long").alias("n_windows"), F.collect_list(window).alias("ws"))
    # A window of values only looks like any other: it counts if the values are equal or its alignment has words.
    aligned = aligned.withColumn("ws", F.expr("if(exists(ws, w -> not w.wordless), ws, filter(ws, w -> w.equal))")).where(F.size("ws") > 0)
    aligned = aligned.withColumn("n_found", F.size("ws")).withColumn("pairs", _pairs(F.col("ws"))).withColumn("agreed", _consistency("pairs"))
    aligned = aligned.withColumn("whole", enough & (F.col("agreed") >= params.least_consistency)).withColumn("verbatim", F.col("whole") & F.forall("ws", lambda w: w["equal"]))
    rank = F.struct(F.col("agreed") >= params.least_consistency, "n_found", -F.abs("offset"))
    places = aligned.select("id", "item", "n_windows", "whole", "verbatim", "agreed", rank.alias("rank"), F.explode("ws").alias("w"))
    # One row for each document, item and window of the item: its place in the largest alignment, and the one with equal values before all others.
    by_window = places.groupBy("id", "item", "w.item_at").agg(
        F.first("n_windows").alias("n_windows"),
        F.min("w.at").alias("low"),
        F.max(F.col("w.at") + F.col("w.size") - 1).alias("high"),
        F.max_by("w", "rank").alias("largest"),
        F.max_by("w", F.struct("w.equal", "rank")).alias("likest"),
        F.max(F.when(F.col("whole"), F.col("agreed"))).alias("aligned"),
        F.max("verbatim").alias("verbatim"),
    )
    held = by_window.groupBy("id", "item").agg(
        F.count("*").alias("n_found"),
        F.first("n_windows").alias("n_windows"),
        F.min("low").alias("first_word"),
        F.max("high").alias("last_word"),
        F.collect_list("largest").alias("largest"),
        F.collect_list("likest").alias("likest"),
        F.max("aligned").alias("aligned"),
        F.max("verbatim").alias("verbatim"),
    )
    for name in ("largest", "likest"):
        held = held.withColumn(f"{name}_pairs", _pairs(F.col(name)))
    held = held.withColumn("consistency", F.greatest("aligned", _consistency("largest_pairs"), _consistency("likest_pairs")))
    held = held.withColumn("same_values", F.col("verbatim") | F.forall("likest_pairs", lambda p: p["0"] == p["1"]))
    return held.where(enough & (F.col("consistency") >= params.least_consistency))


def _pairs(ws: Column) -> Column:
    """The different pairs of an item's value and the document's in windows."""
    zipped = F.transform(F.filter(ws, lambda w: w["values"].isNotNull()), lambda w: F.arrays_zip(F.split(w["item_values"], COMMA).alias("0"), F.split(w["values"], COMMA).alias("1")))
    return F.array_distinct(F.flatten(zipped))


def _consistency(pairs: str) -> Column:
    kinds = F.size(F.array_distinct(F.transform(pairs, lambda p: p["0"])))
    return F.when(F.size(pairs) == 0, 1.0).otherwise(kinds / F.size(pairs))


def clean(docs: DataFrame, benchmark: DataFrame, params: DecontaminationParams = DecontaminationParams(), id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item."""
    held = _held(_keyed(docs, id, text), _keyed(benchmark, "item_id", "text"), params).select(F.col("id.id").alias("_id"), F.col("id.text").alias("_text")).distinct()
    return docs.join(held, docs[id].eqNullSafe(held["_id"]) & (F.xxhash64(docs[text]) == held["_text"]), "left_anti")
