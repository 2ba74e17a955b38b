"""K-best parses in Arrow batches, soft counts, scores and guess numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions import chars, lattice, patterns
from .grammar import ranked
from .stats import contains_terms

PARSES = "array<struct<segs: array<struct<surface: string, label: string>>, logp: double, w: double>>"


def _once(run):
    """A UDF that the optimizer leaves where it is: it runs once for each row, not again in a filter pushed below a groupBy."""
    return run.asNondeterministic()


def segments(df: DataFrame, v: str = "v", result: str = "segs", detect: Callable[[str], list[tuple[str, str]]] = patterns.coarse) -> DataFrame:
    """Adds the segments of a value, by default the coarse ones: patterns, and L, D, S."""

    @F.pandas_udf("array<struct<surface: string, label: string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([[{"surface": t, "label": k} for t, k in detect(x)] if x else None for x in values], dtype=object)

    return _dealt(df, v).withColumn(result, _once(run)(F.col(v)))


def related_segments(df: DataFrame, key: str = "key", value: str = "value", result: str = "segs") -> DataFrame:
    """Adds the coarse segments of a value in which parts taken from its key are labelled."""

    @F.pandas_udf("array<struct<surface: string, label: string>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for keys, values in batches:
            yield pd.Series([[{"surface": t, "label": k} for t, k in patterns.related(a, x)] if x else None for a, x in zip(keys, values)], dtype=object)

    return df.withColumn(result, _once(run)(F.col(key), F.col(value)))


def _dealt(df: DataFrame, v: str) -> DataFrame:
    """Deals values out for Python work: tasks are not merged for having little data."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), v)


#: So many terms go whole to each worker; beyond, each value takes along those that it holds.
MOST_TERMS = 200_000


def as_terms(rows) -> lattice.Terms:
    """Terms of rows (term, label): name, word, syllable or the label of a form. Forms with other characters than letters are names with separators."""
    by: dict[str, set[str]] = {}
    joined: dict[str, str] = {}
    for term, label in sorted(rows):
        if label in ("name", "word", "syllable") or term.isalpha():
            by.setdefault(label, set()).add(term)
        else:
            joined.setdefault(term, label)
    sets = {k: frozenset(x) for k, x in by.items()}
    return lattice.Terms(sets.pop("name", frozenset()), sets.pop("word", frozenset()), forms={k: x for k, x in sorted(sets.items()) if k != "syllable"}, syllables=sets.get("syllable", frozenset()), joined=joined)


def _packed(found: list) -> list[dict]:
    return [{"segs": [{"surface": t, "label": k} for t, k in s], "logp": p, "w": w} for s, p, w in found]


def parses(df: DataFrame, terms: lattice.Terms | DataFrame, config: Config = Config(), v: str = "v", most_terms: int = MOST_TERMS) -> DataFrame:
    """v, m, parses: each distinct value is parsed once and keeps how often it occurs.

    A table of terms (term in lower case, label) of no more than ``most_terms`` rows goes whole
    to the workers; of a larger one each value gets the terms that it holds, by a join.
    """
    distinct = df.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("m"))
    if isinstance(terms, DataFrame):
        few = terms.select("term", "label").limit(most_terms + 1).collect()
        if len(few) > most_terms:
            return _parses_with_own(distinct, terms, config)
        terms = as_terms([tuple(r) for r in few])
    shared = df.sparkSession.sparkContext.broadcast(terms)

    @F.pandas_udf(PARSES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series([_packed(lattice.parse(x, shared.value, config)) for x in values], dtype=object)

    return _dealt(distinct, "v").withColumn("parses", _once(run)(F.col("v")))


def _parses_with_own(distinct: DataFrame, terms: DataFrame, config: Config) -> DataFrame:
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 1
    # A value holds a term as it is or with digits read as letters; no other can change its parse.
    forms = distinct.select("v", F.explode(F.array_distinct(F.array(F.lower("v"), chars.leet(F.col("v"))))).alias("form"))
    held = contains_terms(forms, terms, "form", longest, 1).select("v", "term").distinct().join(terms.select("term", "label"), "term")
    # No more than the substrings of a value.
    own = held.groupBy("v").agg(F.collect_set(F.struct("term", "label")).alias("own"))

    @F.pandas_udf(PARSES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for values, terms in batches:
            yield pd.Series([_packed(lattice.parse(x, as_terms([(t["term"], t["label"]) for t in own]) if own is not None else lattice.Terms(), config)) for x, own in zip(values, terms)], dtype=object)

    return _dealt(distinct.join(own, "v", "left"), "v").withColumn("parses", _once(run)(F.col("v"), F.col("own"))).drop("own")


def samples(parsed: DataFrame) -> DataFrame:
    """v, m, sp, segs, logp, w: a row for each parse that counts."""
    one = parsed.select("v", "m", F.explode("parses").alias("x"))
    return one.select("v", "m", F.array_join(F.transform("x.segs", lambda s: s["label"]), " ").alias("sp"), "x.segs", "x.logp", "x.w")


def soft_structures(sampled: DataFrame) -> DataFrame:
    return sampled.groupBy("sp").agg(F.sum(F.col("w") * F.col("m")).alias("cnt"))


def soft_emissions(sampled: DataFrame) -> DataFrame:
    one = sampled.select((F.col("w") * F.col("m")).alias("w"), F.explode("segs").alias("s"))
    return one.groupBy(F.col("s.label").alias("label"), F.col("s.surface").alias("surface")).agg(F.sum("w").alias("cnt"))


def scores(sampled: DataFrame, structures: DataFrame, emissions: DataFrame) -> DataFrame:
    """v, log_p: over a value's parses, the sum of the chances of the structure times those of its parts; null if no parse is known."""
    one = sampled.select("v", "sp", F.monotonically_increasing_id().alias("path"), F.posexplode("segs").alias("at", "s"))
    known = one.join(emissions.select("label", "surface", F.log("p").alias("lp")), (F.col("s.label") == F.col("label")) & (F.col("s.surface") == F.col("surface")), "left")
    paths = known.groupBy("v", "sp", "path").agg(F.sum("lp").alias("lp"), F.bool_and(F.col("lp").isNotNull()).alias("whole"))
    whole = paths.join(structures.select("sp", F.log("p").alias("ls")), "sp", "left").withColumn("p", F.when(F.col("whole"), F.exp(F.col("lp") + F.col("ls"))))
    return whole.groupBy("v").agg(F.log(F.sum("p")).alias("log_p"))


def draws(structures: DataFrame, emissions: DataFrame, n: int, seed: int = 7, cells: int = 1024) -> DataFrame:
    """draw, log_p: the chances of n paths drawn from a model of structures (sp, p) and emissions (label, surface, p); no value is put together.

    Structures are drawn at n even steps of their running chance, so each has its share without
    a join. A part is drawn by a number of its own, which meets the running chances of its label
    cell by cell.
    """
    runs = ranked(structures.select("sp", F.col("p").alias("cnt")), "sp")
    upto = lambda x: F.ceil(x / F.col("total") * n - 0.5)
    taken = runs.withColumn("a", upto(F.col("before"))).withColumn("b", upto(F.col("before") + F.col("cnt"))).where("a < b")
    taken = taken.select("sp", F.log(F.col("cnt") / F.col("total")).alias("ls"), F.explode(F.expr("sequence(a, b - 1)")).alias("draw"))
    slots = taken.select("draw", "ls", F.posexplode(F.split("sp", " ")).alias("slot", "label"))
    slots = slots.withColumn("u", F.pmod(F.xxhash64("draw", "slot", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)).withColumn("cell", F.floor(F.col("u") * cells))
    parts = ranked(emissions.select("label", "surface", F.col("p").alias("cnt")), "surface", "label")
    parts = parts.select("label", F.log(F.col("cnt") / F.col("total")).alias("lp"), (F.col("before") / F.col("total")).alias("low"), ((F.col("before") + F.col("cnt")) / F.col("total")).alias("high"))
    parts = parts.withColumn("cell", F.explode(F.sequence(F.least(F.floor(F.col("low") * cells), F.lit(cells - 1)), F.least(F.floor(F.col("high") * cells), F.lit(cells - 1)))))
    met = slots.join(parts, ["label", "cell"]).where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
    return met.groupBy("draw", "ls").agg(F.sum("lp").alias("lp")).select("draw", (F.col("ls") + F.col("lp")).alias("log_p"))


def guess_numbers(scored: DataFrame, drawn: DataFrame) -> DataFrame:
    """v, log_p, log10_guesses: how many values are likelier, by the published Monte Carlo estimate (Dell'Amico and Filippone, 2015).

    ``drawn`` has the log_p of values drawn from the model that gave ``scored`` its chances;
    only these numbers are used, and only a sorted table of them is kept on the driver: its
    size is the number drawn.
    """
    logs = np.sort(np.array([r[0] for r in drawn.select("log_p").where("log_p is not null").collect()]))[::-1]
    ranks = np.cumsum(np.exp(-logs)) / max(len(logs), 1)

    @F.pandas_udf("double")
    def run(x: pd.Series) -> pd.Series:
        at = np.searchsorted(-logs, -x.to_numpy(float) - 1e-9, side="left")  # equal chances differ by rounding
        found = np.where(at > 0, ranks[np.maximum(at - 1, 0)] if len(ranks) else 1.0, 1.0)
        return pd.Series(np.where(np.isnan(x.to_numpy(float)), np.nan, np.log10(np.maximum(found, 1.0))))

    return scored.withColumn("log10_guesses", run("log_p"))
