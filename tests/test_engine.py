import duckdb
import pytest
from pyspark.sql import functions as F

from glyphloom import sources
from glyphloom.functions import chars, numbers
from glyphloom.functions.lattice import Terms
from glyphloom.operators import evaluate, grammar, parse, stats
from glyphloom.plans import registry
from glyphloom.streaming import incremental

DATA = "/root/testdata/sf0.001"
TABLES = "customer orders documents nation region".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, oracle, name):
    df = registry.QUERIES[name](spark, DATA)
    rel = oracle.sql(registry.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    own = sorted(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    assert own == sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_number_labels_agree_with_the_parser(spark):
    values = ["1984", "2016", "0731", "731", "31", "99", "991231", "160101", "500230", "20000229", "19990229", "198509", "198513", "19851", "19850", "7841", "78411", "1984731", "13800138000", "1", "000000", "123456789"]
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("label", numbers.number_label(F.col("v")))
    assert {r["v"]: r["label"] for r in df.collect()} == {v: numbers.label_text(v)[0][0] for v in values}


def test_mass_prune(spark):
    counts = spark.createDataFrame([("a", 50), ("b", 30), ("c", 15), ("d", 5)], "sp string, cnt long")
    assert {r["sp"]: round(r["p"], 6) for r in grammar.mass_prune(counts, "sp", 0.9).collect()} == {"a": round(50 / 95, 6), "b": round(30 / 95, 6), "c": round(15 / 95, 6)}
    assert {r["sp"] for r in grammar.mass_prune(counts, "sp", 0.8).collect()} == {"a", "b"}
    assert {r["sp"]: r["rn"] for r in grammar.ranked(counts, "sp").collect()} == {"a": 1, "b": 2, "c": 3, "d": 4}


def test_ranks_are_those_of_a_sort(spark):
    import random

    r = random.Random(2)
    rows = [("".join(r.choice("abé") for _ in range(r.randrange(1, 9))) + str(i), r.choice("xy"), r.choice([1, 1, 1, 2, 5])) for i in range(400)]
    df = spark.createDataFrame(rows, "v string, lang string, cnt long")
    for by in (None, "lang"):
        got = {x["v"]: (x["rn"], x["before"], x["total"]) for x in grammar.ranked(df, "v", by).collect()}
        for lang in ("x", "y") if by else (None,):
            own = sorted((x for x in rows if lang in (None, x[1])), key=lambda x: (-x[2], x[0].encode()))
            upto = 0
            for i, (v, _, n) in enumerate(own):
                assert got[v] == (i + 1, upto, sum(x[2] for x in own))
                upto += n


def test_soft_counts_add_up(spark):
    df = spark.createDataFrame([("password1",), ("password1",), ("qwerty",), ("31-12",), ("zzz",)], "v string")
    s = parse.samples(parse.parses(df, Terms(words=frozenset(["pass", "word", "password"]))))
    structures, emissions = grammar.normalise(parse.soft_structures(s)), grammar.normalise(parse.soft_emissions(s), "label")
    assert structures.agg(F.sum("p")).first()[0] == pytest.approx(1)
    assert all(r[1] == pytest.approx(1) for r in emissions.groupBy("label").agg(F.sum("p")).collect())
    scored = parse.scores(s, structures, emissions)
    assert {r["v"]: r["log_p"] < 0 for r in scored.collect()} == {v: True for v in ("password1", "qwerty", "31-12", "zzz")}
    assert all(r["log10_guesses"] >= 0 for r in parse.guess_numbers(scored, scored).collect())
    joined = s.select("v", F.array_join(F.transform("segs", lambda x: x["surface"]), "").alias("j")).where("v <> j")
    assert joined.count() == 0


def test_audit_finds_faults(spark):
    ranks = spark.createDataFrame([("a", 0.5, 1), ("b", 0.6, 2), ("a", 0.1, 3)], "value string, p double, rn long")
    assert tuple(evaluate.rank_audit(ranks, bucket=2).first()) == (3, 2, 1, 1, 1)


def test_sources(spark, tmp_path):
    (tmp_path / "terms").write_text(" Ann \nbob\n\nann\n")
    assert {r[0] for r in sources.term_list(spark, f"file://{tmp_path}/terms", 2).collect()} == {"ann", "bob"}
    assert sources.term_list(spark, f"file://{tmp_path}/none").count() == 0
    (tmp_path / "ranks").write_text("a\t0.5\nb\tx\nbad\nc\t0.1\td\n")
    assert {tuple(r) for r in sources.ranked_list(spark, f"file://{tmp_path}/ranks").collect()} == {("a", 0.5), ("b", 0.0)}
    with pytest.raises(Exception):
        sources.ranked_list(spark, f"file://{tmp_path}/ranks", strict=True).collect()
    terms = spark.createDataFrame([("a[SPECIAL]b[SPECIAL]c", "x"), ("d", "x")], "term string, label string")
    assert {r["term"] for r in sources.with_specials(terms, [".", "_"]).collect()} == {"a.b.c", "a.b_c", "a_b.c", "a_b_c", "d"}
    rows = spark.createDataFrame([(None, "a"), ("", "b"), ("k", None), ("k", "")], "k string, v string")
    assert [tuple(r) for r in sources.pairs(rows, "k", "v").collect()] == [(None, "a"), (None, "b")]
    parts = [sources.sample_window(spark.range(100), "id", i, 3).count() for i in range(3)]
    assert sum(parts) == 100 and min(parts) > 0


def test_labelled_terms(spark, tmp_path):
    (tmp_path / "forms.csv").write_text("full,given\nAnnLee,Ann\n,Bo\n")
    found = sources.labelled_terms(spark, f"file://{tmp_path}/forms.csv", {"full": "f", "given": "g", "none": "n"})
    assert {tuple(r) for r in found.collect()} == {("annlee", "f"), ("ann", "g"), ("bo", "g")}


def test_counts_are_committed_once(spark, tmp_path):
    path = f"file://{tmp_path}/counts"
    df = spark.createDataFrame([("ab1",), ("ab2",), ("!",)], "v string")
    for _ in range(2):
        incremental.write_counts(grammar.structure_counts(df), path, 0)
    incremental.write_counts(grammar.structure_counts(df), path, 1)
    assert {r["sp"]: r["cnt"] for r in incremental.read_counts(spark, path, "sp").collect()} == {"L2 D1": 4, "S1": 2}


def test_stream(spark, tmp_path):
    spark.createDataFrame([("ab1",), ("ab2",)], "v string").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("v string").parquet(f"file://{tmp_path}/in")
    incremental.stream_structures(stream, f"file://{tmp_path}/counts", f"file://{tmp_path}/ck").awaitTermination(60)
    assert {r["sp"]: r["cnt"] for r in incremental.read_counts(spark, f"file://{tmp_path}/counts", "sp").collect()} == {"L2 D1": 2}


def test_masks_and_parts(spark):
    df = spark.createDataFrame([("Ab1!", "kim@mail.a.example.org")], "v string, m string")
    r = df.select(chars.shape(F.col("v")), chars.pattern(F.col("v")), chars.email_local(F.col("m")), chars.email_domain(F.col("m")), chars.masked(F.col("v"), "salt")).first()
    assert tuple(r)[:4] == ("U1l1D1S1", "U1l1D1!", "kim", "a") and r[4].startswith("U1l1D1S1#sha256:")


def test_labels_of_terms(spark):
    a, b = spark.createDataFrame([("x", "n")], "term string, label string"), spark.createDataFrame([("x", "w"), ("y", "w")], "term string, label string")
    assert {tuple(r) for r in stats.precedence(a, b).collect()} == {("x", "n"), ("y", "w")}


def test_all_terms_are_taken(spark, tmp_path):
    words = [f"{a}{b}{c}{e}" for a in "bcdfghjklm" for b in "aeiou" for c in "bcdfghjklmnprst" for e in "abcdefgh"]
    rows = [(i, " ".join(words), "en") for i in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = parse.as_terms([tuple(r) for r in registry._terms(spark, str(tmp_path)).collect()])
    assert len(words) > 5000 and found.words == frozenset(words)


def test_terms_whole_or_with_each_value(spark):
    terms = spark.createDataFrame([("pass", "word"), ("word", "word"), ("password", "word"), ("ann", "name"), ("pa", "syllable"), ("panwo", "cn_name_full"), ("an.na", "cn_name_special")], "term string, label string")
    df = spark.createDataFrame([(v,) for v in ["password1", "p4ssw0rd!", "AnnPanwo77", "an.na9", "qwerty", "ÉtéPass", "zzz", "x"] * 2], "v string")
    got = [sorted(repr(r) for r in parse.parses(df, terms, most_terms=n).collect()) for n in (100, 1)]
    assert got[0] == got[1] and len(got[0]) == 8
    labels = {x["label"] for r in parse.samples(parse.parses(df, terms)).collect() for x in r["segs"]}
    assert {"cn_name_special", "cn_name_full", "en_name", "leet"} <= labels


def test_values_are_parsed_once(spark):
    for df in (registry.QUERIES["keyboard_walks"](spark, DATA), registry.QUERIES["coarse_structures"](spark, DATA), parse.samples(parse.parses(sources.tokens(spark, DATA), Terms(words=frozenset(["pass"]))))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("ArrowEvalPython") == 1


def test_counts_are_read_once(spark):
    for name in ("structure_distribution", "emission_probs"):
        df = registry.QUERIES[name](spark, DATA)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "ReusedExchange" in plan and plan.count("FileScan") == 1


def test_guess_numbers_are_ranks(spark):
    structures = spark.createDataFrame([("L D", 0.7), ("L", 0.3)], "sp string, p double")
    emissions = spark.createDataFrame([("L", f"w{i}", 0.5**i) for i in range(1, 9)] + [("D", str(i), 0.1) for i in range(10)], "label string, surface string, p double")
    emissions = grammar.normalise(emissions.withColumnRenamed("p", "cnt"), "label")
    by = {}
    for r in emissions.collect():
        by.setdefault(r["label"], []).append((r["surface"], r["p"]))
    chances = {w + d: 0.7 * p * q for w, p in by["L"] for d, q in by["D"]} | {w: 0.3 * p for w, p in by["L"]}
    drawn = parse.draws(structures, emissions, 20_000)
    assert drawn.count() == 20_000
    import math

    scored = spark.createDataFrame([(v, math.log(p)) for v, p in chances.items()], "v string, log_p double")
    for r in parse.guess_numbers(scored, drawn).collect():
        rank = sum(p > math.exp(r["log_p"]) * (1 + 1e-9) for p in chances.values())
        assert abs(10 ** r["log10_guesses"] - max(rank, 1)) <= 0.25 * rank + 1


def test_other_readers(spark, tmp_path):
    (tmp_path / "ranks").write_text("a\t0.5\nb\tx\nbad\n")
    assert [tuple(r) for r in sources.ranked_list(spark, f"file://{tmp_path}/ranks", bad="drop").collect()] == [("a", 0.5)]
    (tmp_path / "counts.json").write_text('{"x y": 1, "z": 3.5}')
    counts = sources.json_counts(spark, f"file://{tmp_path}/counts.json")
    sources.write_sorted_json(counts, f"file://{tmp_path}/sorted")
    assert [tuple(r) for r in spark.read.schema("key string, cnt double").json(f"file://{tmp_path}/sorted").collect()] == [("z", 3.5), ("x y", 1.0)]
    sources.write_csv(counts, f"file://{tmp_path}/csv")
    assert spark.read.csv(f"file://{tmp_path}/csv", header=True).count() == 2
    sources.head_of_file(spark, f"file://{tmp_path}/ranks", 2, f"file://{tmp_path}/head")
    assert [r[0] for r in spark.read.text(f"file://{tmp_path}/head").collect()] == ["a\t0.5", "b\tx"]
    assert grammar.normalised_weights([1, 3]) == [0.25, 0.75]
    for bad in ([], [0.0], [1, -1]):
        with pytest.raises(ValueError):
            grammar.normalised_weights(bad)
    p = spark.createDataFrame([("a", 0.5), ("b", 0.0), ("c", 1.5)], "v string, p double")
    assert {r["v"]: r["p"] for r in grammar.positive(p).collect()} == {"a": 0.25, "c": 0.75}


def test_terms_in_long_values(spark, tmp_path):
    rows = [(i, "apple", "en") for i in range(20)] + [(20, "7" * 150 + "apple" + "7" * 100 + "apple", "en"), (21, "7" * 203 + "apple", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(x) for x in registry.QUERIES["dictionary_match"](spark, str(tmp_path)).collect()] == [("apple", 23, 4)]
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert c.sql(registry.ORACLE_SQL["dictionary_match"]).fetchall() == [("apple", 23, 4)]
