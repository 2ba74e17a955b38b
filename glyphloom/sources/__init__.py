"""Readers and writers. Every reader gives a plan; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, v: the words of the documents, between white space."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.explode(F.split("text", BLANKS)).alias("v")).where("v <> ''")


def values(df: DataFrame, value: str) -> DataFrame:
    """value: without nulls and empty strings."""
    return df.select(F.col(value).cast("string").alias("value")).where("value <> ''")


def pairs(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value: without null or empty values; an empty key is null."""
    return df.select(F.nullif(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(value).cast("string").alias("value")).where("value <> ''")


def accounting(df: DataFrame, *columns: str) -> DataFrame:
    """One row for each column: how many rows are null, empty and usable."""
    given = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
    one = lambda cond: F.sum(F.when(cond, 1).otherwise(0))
    return df.select(given).groupBy(F.col("x.name").alias("name")).agg(
        one(F.col("x.v").isNull()).alias("n_null"), one(F.col("x.v") == "").alias("n_empty"), one(F.col("x.v") != "").alias("n_usable")
    )


def batch(df: DataFrame, id: str, number: int, rows: int) -> DataFrame:
    """Rows of one numbered range of ids; the range reaches the scan."""
    return df.where((F.col(id) >= number * rows) & (F.col(id) < (number + 1) * rows))


def sample_window(df: DataFrame, id: str, part: int, parts: int, seed: int = 0) -> DataFrame:
    """One of ``parts`` disjoint pseudo-random samples; together they are all rows."""
    return df.where(F.pmod(F.xxhash64(F.col(id), F.lit(seed)), F.lit(parts)) == part)


def first_rows(df: DataFrame, n: int, *order: str | Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def random_rows(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def term_list(spark: SparkSession, path: str, least: int = 1) -> DataFrame:
    """term: distinct lower-cased lines of a text file; no rows if there is no such file."""
    try:
        lines = spark.read.text(path)
    except Exception as e:  # Spark has one class for all analysis errors
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "term string")
    return lines.select(F.lower(F.trim("value")).alias("term")).where(F.length("term") >= least).distinct()


def labelled_terms(spark: SparkSession, path: str, labels: dict[str, str]) -> DataFrame:
    """term, label from a CSV with a column for each kind of term."""
    df = spark.read.csv(path, header=True)
    there = {c: x for c, x in labels.items() if c in df.columns}
    pairs = F.explode(F.array(*[F.struct(F.lower(F.trim(F.col(f"`{c}`"))).alias("term"), F.lit(x).alias("label")) for c, x in there.items()])).alias("x")
    return df.select(pairs).select("x.*").where("term <> ''").distinct()


def with_specials(terms: DataFrame, replacements: list[str], mark: str = "[SPECIAL]") -> DataFrame:
    """Terms with each mark in them replaced by each replacement, in all combinations."""
    parts = terms.withColumn("parts", F.split("term", rf"\Q{mark}\E")).where(F.size("parts") > 1)
    done = terms.where(~F.contains("term", F.lit(mark)))
    grown = parts.withColumn("heads", F.array(F.get("parts", F.lit(0)))).withColumn(
        "heads",
        F.reduce(F.slice("parts", F.lit(2), F.size("parts")), F.col("heads"), lambda acc, p: F.flatten(F.transform(acc, lambda h: F.transform(F.array(*map(F.lit, replacements)), lambda r: F.concat(h, r, p))))),
    )
    return done.unionByName(grown.withColumn("term", F.explode("heads")).drop("parts", "heads").select(done.columns)).distinct()


RANKED = T.StructType([T.StructField("value", T.StringType()), T.StructField("p", T.DoubleType())])


def ranked_list(spark: SparkSession, path: str, strict: bool = False, bad: str = "zero") -> DataFrame:
    """value, p from tab-separated lines. Not strict: lines without exactly two fields go, and a line with a bad number counts as 0 or goes (``bad`` "drop")."""
    if strict:
        return spark.read.csv(path, sep="\t", schema=RANKED, mode="FAILFAST", quote="")
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).withColumn("f", fields).where(F.size("f") == 2).select(F.get("f", F.lit(0)).alias("value"), F.get("f", F.lit(1)).try_cast("double").alias("p"))
    return rows.where("p is not null") if bad == "drop" else rows.fillna(0.0, "p")


def json_counts(spark: SparkSession, path: str) -> DataFrame:
    """key, cnt from files that each hold one JSON object of numbers."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,double>"))).toDF("key", "cnt")


def write_sorted_json(counts: DataFrame, path: str, key: str = "key", count: str = "cnt") -> None:
    """A JSON line for each key, most first."""
    counts.orderBy(F.desc(count), key).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def head_of_file(spark: SparkSession, path: str, n: int, out: str) -> None:
    """The first n lines of a text file, written elsewhere."""
    spark.read.text(path).limit(n).write.mode("overwrite").text(out)
