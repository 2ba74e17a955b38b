"""Counts and probabilities of structures and of what stands in them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import chars
from .stats import with_share


def structure_counts(df: DataFrame, v: str = "v") -> DataFrame:
    """sp, cnt: each distinct value is taken apart once."""
    distinct = df.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("m"))
    return distinct.groupBy(chars.structure(F.col("v")).alias("sp")).agg(F.sum("m").alias("cnt"))


def emission_counts(df: DataFrame, v: str = "v") -> DataFrame:
    """label, surface, cnt: of the runs of each value."""
    distinct = df.groupBy(F.col(v).alias("v")).agg(F.count("*").alias("m"))
    runs = distinct.select("m", F.explode(chars.runs(F.col("v"))).alias("surface"))
    label = F.concat(chars.run_class(F.col("surface")), F.length("surface").cast("string"))
    return runs.groupBy(label.alias("label"), "surface").agg(F.sum("m").alias("cnt"))


#: Stands between the segments of a key and those of its value.
SEPARATOR = "acc_pwd_sep"


def pair_structures(pairs: DataFrame) -> DataFrame:
    """sp, cnt of distinct pairs (key, value, m): the key's segments, a separator, the value's."""
    sp = F.concat_ws(" ", chars.structure(F.col("key")), F.lit(SEPARATOR), chars.structure(F.col("value")))
    return pairs.groupBy(sp.alias("sp")).agg(F.sum("m").alias("cnt"))


def pair_emissions(pairs: DataFrame) -> DataFrame:
    """label, surface, cnt of the runs of keys and values of distinct pairs; the separator has none."""
    runs = pairs.select("m", F.explode(F.concat(chars.runs(F.col("key")), chars.runs(F.col("value")))).alias("surface"))
    label = F.concat(chars.run_class(F.col("surface")), F.length("surface").cast("string"))
    return runs.groupBy(label.alias("label"), "surface").agg(F.sum("m").alias("cnt"))


def normalised_weights(weights: list[float]) -> list[float]:
    """Weights scaled to 1; there must be some, none below 0, and not all 0."""
    if not weights or any(w < 0 for w in weights) or sum(weights) <= 0:
        raise ValueError(f"weights must be given, not below 0 and not all 0: {weights}")
    return [w / sum(weights) for w in weights]


def normalise(counts: DataFrame, by: str | None = None) -> DataFrame:
    """Adds p, the part of all, or of all with the same label. Sums are joined: a hot label needs no task of its own."""
    if by is None:
        return with_share(counts)
    totals = counts.groupBy(by).agg(F.sum("cnt").alias("_total"))
    return counts.join(totals, by).withColumn("p", F.col("cnt") / F.col("_total")).drop("_total")


def ranked(counts: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """Adds rn (by count downwards, then value), before (the sum of counts ranked higher) and total.

    Places are added up by levels: those of one count and two first characters (few: a table
    of N rows has at most sqrt(2N) different whole counts), in these those of six, and in
    these the rows. So a window holds the rows of one count and one beginning of six.
    """
    keys = [by] if by else []
    wide, fine = [*keys, "cnt", "_b2"], [*keys, "cnt", "_b2", "_b6"]
    marked = counts.withColumn("_b2", F.left(value, F.lit(2))).withColumn("_b6", F.left(value, F.lit(6)))
    small = marked.groupBy(*fine).agg(F.count("*").alias("_n"))
    large = small.groupBy(*wide).agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy(*keys).orderBy(F.desc("cnt"), "_b2").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda x, w: F.coalesce(F.sum(x).over(w), F.lit(0))
    mass = F.col("_n") * F.col("cnt")
    large = large.select(*wide, before("_n", order).alias("_first"), before(mass, order).alias("_mass"), F.sum(mass).over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*wide).orderBy("_b6").rowsBetween(Window.unboundedPreceding, -1)
    small = small.select(*fine, before("_n", inside).alias("_within")).join(large, wide)
    own = F.row_number().over(Window.partitionBy(*fine).orderBy(value)).cast("long")
    out = marked.withColumn("_own", own).join(small, fine).withColumn("_own", F.col("_own") + F.col("_within"))
    out = out.withColumn("rn", F.col("_first") + F.col("_own")).withColumn("before", F.col("_mass") + (F.col("_own") - 1) * F.col("cnt"))
    return out.drop("_b2", "_b6", "_own", "_within", "_first", "_mass")


def mass_prune(counts: DataFrame, value: str, mass: float, by: str | None = None) -> DataFrame:
    """The values before which less than ``mass`` of all lies, with p anew."""
    kept = ranked(counts, value, by).where(F.col("before") < F.lit(mass) * F.col("total"))
    return normalise(kept.drop("rn", "before", "total"), by)


def trim(counts: DataFrame, value: str, by: str, share: float | None = None, most: int | None = None) -> DataFrame:
    """For each label the values up to a share of its mass, that which crosses it included, or the first few. p is not made anew."""
    df = ranked(counts, value, by).withColumn("p", F.col("cnt") / F.col("total"))
    keep = F.col("rn") <= most if most is not None else F.col("before") < F.lit(share) * F.col("total")
    return df.where(keep).drop("before", "total")


def least_p_for(counts: DataFrame, value: str, mass: float) -> DataFrame:
    """The least probability needed to cover a mass, and how many values that takes."""
    kept = ranked(counts, value).where(F.col("before") < F.lit(mass) * F.col("total"))
    return kept.agg(F.min(F.col("cnt") / F.col("total")).alias("min_p"), F.count("*").alias("n_values"))


def positive(df: DataFrame, p: str = "p") -> DataFrame:
    """Without values of no mass, p scaled to 1."""
    kept = df.where(F.col(p) > 0)
    return kept.crossJoin(F.broadcast(kept.agg(F.sum(p).alias("_s")))).withColumn(p, F.col(p) / F.col("_s")).drop("_s")


def mix(a: DataFrame, b: DataFrame, key: str, share: float) -> DataFrame:
    """share * a + (1 - share) * b."""
    share, _ = normalised_weights([share, 1 - share])
    both = a.select(key, (F.col("p") * share).alias("p")).unionByName(b.select(key, (F.col("p") * (1 - share)).alias("p")))
    return both.groupBy(key).agg(F.sum("p").alias("p"))


def mass_by(df: DataFrame, key: Column, count: str = "cnt", name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.sum(count).alias("cnt"))


def top_by(counts: DataFrame, value: str, by: str, most: int) -> DataFrame:
    """For each label its first few values. The sort within a label keeps only these."""
    rn = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("cnt"), value))
    return counts.withColumn("rn", rn).where(F.col("rn") <= most)


def average_structure_length(counts: DataFrame) -> DataFrame:
    """Over distinct structures, not weighted."""
    return counts.agg(F.avg(F.size(F.split("sp", " "))).alias("avg_size"), F.count("*").alias("n_structures"))


def report(structures: DataFrame, emissions: DataFrame, most_structures: int = 100, most_surfaces: int = 20, salt: str = "") -> DataFrame:
    """What may be shown: the first structures as they are, the first surfaces of each label masked."""
    first = structures.orderBy(F.desc("cnt"), "sp").limit(most_structures).select(F.lit("structure").alias("kind"), F.lit("").alias("label"), F.col("sp").alias("shown"), "cnt")
    return first.unionByName(top_by(emissions, "surface", "label", most_surfaces).select(F.lit("surface").alias("kind"), "label", chars.masked(F.col("surface"), salt).alias("shown"), "cnt"))
