"""Statistics of a string column: lengths, affixes, policies, relations, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import chars


def with_share(df: DataFrame, count: str = "cnt", share: str = "p", factor: float = 1.0) -> DataFrame:
    """Adds each count's part of the sum: one row is broadcast, no window gathers the table."""
    total = df.agg(F.sum(count).alias("_total"))
    return df.crossJoin(F.broadcast(total)).withColumn(share, F.col(count) * F.lit(factor) / F.col("_total")).drop("_total")


def length_histogram(df: DataFrame, v: str = "v") -> DataFrame:
    return with_share(df.groupBy(F.length(v).alias("len")).agg(F.count("*").alias("cnt")), share="pct", factor=100.0)


def average_length(df: DataFrame, v: str = "v", most: int = 30) -> DataFrame:
    return df.where(F.length(v) <= most).agg(F.avg(F.length(v)).alias("avg_len"), F.count("*").alias("n"))


def affixes(df: DataFrame, v: str = "v", end: bool = False, sizes: int = 4, least_core: int = 4) -> DataFrame:
    """Counts of short prefixes (or suffixes) that match the affix rule before (after) a core with a letter."""
    size = F.explode(F.sequence(F.lit(1), F.lit(sizes))).alias("size")
    cut = df.where(F.length(v) >= least_core + 1).select(F.col(v).alias("v"), size).where(F.length("v") - F.col("size") >= least_core)
    affix = F.right("v", F.col("size")) if end else F.left("v", F.col("size"))
    core = F.expr("left(v, length(v) - size)") if end else F.expr("substring(v, size + 1)")
    return cut.where(affix.rlike(chars.AFFIX) & core.rlike("[A-Za-z]")).groupBy(affix.alias("affix")).agg(F.count("*").alias("cnt"))


def policies(v: Column) -> dict[str, Column]:
    long_mixed = (F.length(v) >= 9) & v.rlike("[A-Za-z]") & v.rlike("[0-9]")
    return {"policy_basic": long_mixed, "policy_cases": long_mixed & v.rlike("[a-z]") & v.rlike("[A-Z]")}


def policy_flags(df: DataFrame, v: str = "v") -> DataFrame:
    """How many values hold each policy; one may hold both."""
    flags = policies(F.col(v))
    return df.agg(F.count("*").alias("n"), *[F.coalesce(F.count_if(c), F.lit(0)).alias(k) for k, c in flags.items()])


def relation(key: Column, value: Column) -> Column:
    """How a value takes from its key: the same, holds it, or not."""
    low, of = F.lower(value), F.lower(key)
    return F.when(key.isNull() | (key == ""), "none").when(low == of, "same").when(F.contains(low, of), "contains").otherwise("none")


def match_rate(df: DataFrame, email: str, value: str) -> DataFrame:
    """Of rows with an e-mail address: how many values are its local part."""
    valid = df.where(F.col(email).rlike(chars.EMAIL) & F.col(value).isNotNull())
    return valid.agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.lower(chars.email_local(F.col(email))) == F.lower(value)), F.lit(0)).alias("n_same")).withColumn("rate", F.when(F.col("n") > 0, F.col("n_same") / F.col("n")).otherwise(0.0))


def duplicate_audit(df: DataFrame, v: str = "v") -> DataFrame:
    counts = df.groupBy(v).agg(F.count("*").alias("c"))
    return counts.agg(F.sum("c").alias("total"), F.count("*").alias("n_unique"), F.count_if(F.col("c") > 1).alias("n_groups"), F.sum(F.col("c") - 1).alias("n_extra"))


#: A table of so many terms is broadcast; beyond, both sides are shuffled.
BROADCAST_TERMS = 500_000


def checked(terms: DataFrame, most: int = BROADCAST_TERMS) -> DataFrame:
    """A table of short rows, marked for broadcast if it has no more than so many."""
    return F.broadcast(terms) if terms.limit(most + 1).count() <= most else terms


def contains_terms(df: DataFrame, terms: DataFrame, v: str = "v", longest: int = 12, shortest: int = 3) -> DataFrame:
    """Rows of df with each term they hold and its place: every substring meets the terms by hash."""
    at = df.withColumn("at", F.explode(F.sequence(F.lit(1), F.greatest(F.length(v) - shortest + 1, F.lit(1)))))
    size = at.withColumn("size", F.explode(F.sequence(F.lit(shortest), F.lit(longest)))).where(F.col("at") + F.col("size") - 1 <= F.length(v))
    return size.withColumn("term", F.lower(F.col(v).substr(F.col("at"), F.col("size")))).join(checked(terms.select("term").distinct()), "term").drop("size")


def precedence(first: DataFrame, then: DataFrame) -> DataFrame:
    """Two labelled term tables as one; a term of the first hides that of the second."""
    return first.unionByName(then.join(first.select("term"), "term", "left_anti"))
