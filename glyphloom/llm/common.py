"""What the operators of this package share: staged tables, word rules, model parameters."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
# Punctuation and symbols. Those of Latin-1 are one class, looked up in one step; the others are few and go one by one.
PUNCTUATION = "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~¡¢£¤¥¦§¨©«¬®¯°±´¶·¸»¿×÷]+"
WIDE_PUNCTUATION = "–—‘’“”…"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share. A local session may name none and gets one of its own; on a cluster that would lose rows."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='glyphloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def staged(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    # Once the table is written, nothing reads the shuffles behind it again.
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """A staged table of a few short columns, marked for broadcast if it has no more than so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def without_punctuation(text: Column) -> Column:
    for c in WIDE_PUNCTUATION:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.regexp_replace(text, PUNCTUATION, "")


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once for each row.

    The optimizer moves a projected expression to where it is used, into the body of a
    lambda or through a filter too, and there it would run for each element. It moves
    nothing through an explode, here of an array of one.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))
