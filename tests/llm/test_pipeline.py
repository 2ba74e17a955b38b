import duckdb
import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.staged(stage(spark, docs, DATA), f"test-{name}")
        assert out.columns == docs.columns
        assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = out
    assert 0 < docs.count() < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())


def test_odd_documents(spark):
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("mine")).withColumn("need", F.lit(1))
    for frame in (docs, docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, DATA)
            assert out.count() <= frame.count()
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == frame.columns


def test_quality_oracle(spark):
    from glyphloom.llm import queries

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    for name, sql in queries.ORACLE_SQL.items():
        df, rel = queries.QUERIES[name](spark, DATA), c.sql(sql)
        at = [rel.columns.index(x) for x in sorted(rel.columns)]
        assert sorted(df.columns) == sorted(rel.columns)
        assert sorted(repr(tuple(r[x] for x in sorted(df.columns))) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_quality_learned_from_some_rows(spark):
    from glyphloom.llm import quality

    params = quality.QualityParams(most_rows=60)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = {r.doc_id: r.kept for r in quality.judge(docs, quality.fit(docs, params=params), params=params).collect()}
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    assert kept == {r[0]: r[-1] for r in c.sql(quality.sql(params=params)).fetchall()}


def test_quality_stage_learns_from_every_row(spark, monkeypatch):
    from glyphloom.llm import quality

    seen, judge = [], quality.judge
    monkeypatch.setattr(quality, "judge", lambda docs, references, *more: seen.append(references) or judge(docs, references, *more))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "the even").otherwise("the odd").alias("text"), F.lit("en").alias("lang"))
    assert corpus_pipeline.quality_rules(spark, docs, DATA).columns == docs.columns
    assert seen[0]["en"].words == {"the": 0.5, "even": 0.25, "odd": 0.25}
