"""How much of a column a ranked list covers, and audits of such lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def hits(values: DataFrame, ranks: DataFrame, v: str = "v", miss: int | None = None) -> DataFrame:
    """rn of each value in the list; null, or ``miss`` + 1, if it isn't there."""
    out = values.join(ranks.select(F.col("value").alias(v), "rn"), v, "left")
    return out if miss is None else out.withColumn("rn", F.coalesce("rn", F.lit(miss + 1)))


def coverage(values: DataFrame, ranks: DataFrame, steps: list[int], by: str | None = None, v: str = "v") -> DataFrame:
    """k, rate (and by): the part of values at rank k or better. One pass: ranks fall into steps, whose sums run up."""
    keys = [by] if by else []
    step = F.lit(None).cast("int")
    for k in sorted(steps, reverse=True):
        step = F.when(F.col("rn") <= k, F.lit(k)).otherwise(step)
    left = values.join(ranks.select(F.col("value").alias(v), *keys, "rn"), [v, *keys], "left")
    found = left.groupBy(*keys, step.alias("k")).agg(F.count("*").alias("n"))
    total = found.groupBy(*keys).agg(F.sum("n").alias("total"))
    grid = total.withColumn("k", F.explode(F.array(*map(F.lit, steps))))
    filled = grid.join(found, [*keys, "k"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("k"))
    return filled.select(*keys, "k", (upto / F.col("total")).alias("rate"))


def curve(values: DataFrame, ranks: DataFrame, step: int, most: int, v: str = "v") -> DataFrame:
    return coverage_by_bucket(values.join(ranks.select(F.col("value").alias(v), "rn"), v, "left"), step, most)


def coverage_by_bucket(found: DataFrame, step: int, most: int) -> DataFrame:
    """k, rate for k = step, 2 step ... most: the buckets of the ranks, summed up."""
    bucket = F.when(F.col("rn") <= most, F.ceil(F.col("rn") / step) * step)
    counted = found.groupBy(bucket.alias("k")).agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n").alias("total"))
    grid = found.sparkSession.range(step, most + 1, step).withColumnRenamed("id", "k")
    filled = grid.join(counted, "k", "left").crossJoin(F.broadcast(total))
    return filled.select("k", (F.sum(F.coalesce("n", F.lit(0))).over(Window.orderBy("k")) / F.col("total")).alias("rate"))


def rank_audit(ranks: DataFrame, eps: float = 0.0, value: str = "value", p: str = "p", rn: str = "rn", bucket: int = 10_000) -> DataFrame:
    """total, n_unique, n_repeated, n_extra, n_rising: of a list in its order. Neighbours meet in buckets of ranks, each with the last row of the one before."""
    counts = ranks.groupBy(value).agg(F.count("*").alias("c"))
    repeated = counts.agg(F.sum("c").alias("total"), F.count("*").alias("n_unique"), F.count_if(F.col("c") > 1).alias("n_repeated"), F.sum(F.col("c") - 1).alias("n_extra"))
    own = ranks.select(F.floor(F.col(rn) / bucket).alias("b"), F.col(rn).alias("at"), F.col(p).alias("p"), F.lit(True).alias("own"))
    last = own.groupBy("b").agg(F.max(F.struct("at", "p")).alias("x")).select((F.col("b") + 1).alias("b"), "x.at", "x.p", F.lit(False).alias("own"))
    before = F.lag("p").over(Window.partitionBy("b").orderBy("at"))
    rising = own.unionByName(last).withColumn("before", before).agg(F.coalesce(F.count_if(F.col("own") & (F.col("p") > F.col("before") + eps)), F.lit(0)).alias("n_rising"))
    return repeated.crossJoin(F.broadcast(rising))
