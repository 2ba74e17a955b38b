"""Queries over the driver tables, and the DuckDB text for the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources
from ..config import Config
from ..functions import chars, numbers, patterns
from ..operators import evaluate, grammar, parse, stats
from ..sources import table, tokens

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Pieces of SQL that several queries share.
TOK = r"tok AS (SELECT doc_id, lang, v FROM (SELECT doc_id, lang, unnest(string_split_regex(text, '[\x20\x09-\x0D]+')) AS v FROM documents) WHERE v <> '')"
RUN = r"(\p{L}+|\p{Nd}+|[^\p{L}\p{Nd}]+)"
SHAPE_RUN = r"(\p{Nd}+|\p{Ll}+|\p{Lu}+|[^\p{Nd}\p{Ll}\p{Lu}]+)"
CLASS = r"CASE WHEN regexp_matches(x, '^\p{L}') THEN 'L' WHEN regexp_matches(x, '^\p{Nd}') THEN 'D' ELSE 'S' END"
SP = f"array_to_string(list_transform(regexp_extract_all(v, '{RUN}', 1), lambda x: {CLASS} || length(x)), ' ')"
KIND = r"CASE WHEN regexp_matches(x, '^\p{Nd}') THEN 'D' WHEN regexp_matches(x, '^\p{Ll}') THEN 'l' WHEN regexp_matches(x, '^\p{Lu}') THEN 'U' ELSE 'S' END"
SHAPE = f"coalesce(nullif(array_to_string(list_transform(regexp_extract_all(v, '{SHAPE_RUN}', 1), lambda x: {KIND} || length(x)), ''), ''), 'EMPTY')"
PATTERN = f"array_to_string(list_transform(regexp_extract_all(v, '{SHAPE_RUN}', 1), lambda x: CASE WHEN {KIND} = 'S' THEN x ELSE {KIND} || length(x) END), '')"
STRUCTURES = f"{TOK}, st AS (SELECT {SP} AS sp, count(*) AS cnt FROM tok GROUP BY 1)"
EMISSIONS = f"{TOK}, em AS (SELECT {CLASS} || length(x) AS label, x AS surface, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(v, '{RUN}', 1)) AS x FROM tok) GROUP BY 1, 2)"
TRAIN = f"{TOK}, train AS (SELECT v, count(*) AS cnt FROM tok WHERE doc_id % 5 <> 0 GROUP BY v), rk AS (SELECT v, cnt, row_number() OVER (ORDER BY cnt DESC, v) AS rn FROM train), test AS (SELECT lang, v FROM tok WHERE doc_id % 5 = 0)"
MASKED = "#sha256:"


def query(sql: str | None = None):
    """Registers a query under its name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _structures(spark: SparkSession, d: str) -> DataFrame:
    return grammar.structure_counts(tokens(spark, d))


def _emissions(spark: SparkSession, d: str) -> DataFrame:
    return grammar.emission_counts(tokens(spark, d))


def _distinct(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("v").agg(F.count("*").alias("m"))


def _train(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).where("doc_id % 5 <> 0").groupBy(F.col("v").alias("value")).agg(F.count("*").alias("cnt"))


def _test(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).where("doc_id % 5 = 0").select("lang", "v")


@query(f"WITH {TOK} SELECT length(v) AS len, count(*) AS cnt, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tok) AS pct FROM tok GROUP BY 1")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_histogram(tokens(spark, d))


@query(f"WITH {TOK} SELECT avg(length(v)) AS avg_len, count(*) AS n FROM tok WHERE length(v) <= 30")
def avg_length_filtered(spark: SparkSession, d: str) -> DataFrame:
    return stats.average_length(tokens(spark, d))


def _with_customers(spark: SparkSession, d: str) -> DataFrame:
    """v: the words, and customers' names after one or two digits and before a year, as few words have such affixes."""
    c = F.col("c_custkey").cast("string")
    made = table(spark, d, "customer").select(F.explode(F.array(F.concat(F.right(c, F.lit(2)), F.left("c_name", F.lit(8))), F.concat(F.left("c_name", F.lit(8)), (F.lit(1950) + F.col("c_custkey") % 70).cast("string")))).alias("v"))
    return tokens(spark, d).select("v").unionByName(made)


_AFFIXED = "tok2 AS (SELECT v FROM tok UNION ALL SELECT right(c_custkey::VARCHAR, 2) || left(c_name, 8) FROM customer UNION ALL SELECT left(c_name, 8) || (1950 + c_custkey % 70)::VARCHAR FROM customer)"


def _affix_sql(affix: str, core: str) -> str:
    return rf"WITH {TOK}, {_AFFIXED}, cut AS (SELECT {affix} AS affix, {core} AS core FROM tok2, (SELECT unnest([1, 2, 3, 4]) AS n) WHERE length(v) - n >= 4) SELECT affix, count(*) AS cnt FROM cut WHERE regexp_matches(affix, '{chars.AFFIX}') AND regexp_matches(core, '[A-Za-z]') GROUP BY 1"


@query(_affix_sql("v[1:n]", "v[n + 1:]"))
def prefix_freq(spark: SparkSession, d: str) -> DataFrame:
    return stats.affixes(_with_customers(spark, d))


@query(_affix_sql("right(v, n)", "left(v, length(v) - n)"))
def suffix_freq(spark: SparkSession, d: str) -> DataFrame:
    return stats.affixes(_with_customers(spark, d), end=True)


_POLICY = "length(v) >= 9 AND regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]')"


@query(f"WITH {TOK} SELECT count(*) AS n, count(*) FILTER ({_POLICY}) AS policy_basic, count(*) FILTER ({_POLICY} AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]')) AS policy_cases FROM tok")
def policy_flags(spark: SparkSession, d: str) -> DataFrame:
    return stats.policy_flags(tokens(spark, d))


@query(f"WITH {TOK} SELECT {CLASS} AS label, length(x) AS len, count(*) AS cnt FROM (SELECT unnest(regexp_extract_all(v, '{RUN}', 1)) AS x FROM tok) GROUP BY 1, 2")
def lds_segments(spark: SparkSession, d: str) -> DataFrame:
    runs = tokens(spark, d).select(F.explode(chars.runs(F.col("v"))).alias("x"))
    return runs.groupBy(chars.run_class(F.col("x")).alias("label"), F.length("x").alias("len")).agg(F.count("*").alias("cnt"))


@query(f"WITH {STRUCTURES} SELECT sp, cnt, cnt * 1.0::DOUBLE / (SELECT sum(cnt) FROM st) AS p FROM st")
def structure_distribution(spark: SparkSession, d: str) -> DataFrame:
    return grammar.normalise(_structures(spark, d))


@query(f"WITH {STRUCTURES} SELECT sp, cnt FROM st ORDER BY cnt DESC, sp LIMIT 20")
def top_structures(spark: SparkSession, d: str) -> DataFrame:
    return _structures(spark, d).orderBy(F.desc("cnt"), "sp").limit(20)


@query(f"WITH {STRUCTURES} SELECT avg(length(sp) - length(replace(sp, ' ', '')) + 1) AS avg_size, count(*) AS n_structures FROM st")
def average_structure_length(spark: SparkSession, d: str) -> DataFrame:
    return grammar.average_structure_length(_structures(spark, d))


@query(f"WITH {TOK} SELECT {SHAPE} AS shape, count(*) AS cnt FROM tok GROUP BY 1")
def shape_distribution(spark: SparkSession, d: str) -> DataFrame:
    return _distinct(spark, d).groupBy(chars.shape(F.col("v")).alias("shape")).agg(F.sum("m").alias("cnt"))


@query(f"WITH {TOK}, m AS (SELECT {PATTERN} AS pattern, count(*) AS cnt FROM tok GROUP BY 1) SELECT pattern, cnt, cnt * 1.0::DOUBLE / (SELECT sum(cnt) FROM m) AS p FROM m")
def pattern_mass(spark: SparkSession, d: str) -> DataFrame:
    return stats.with_share(_distinct(spark, d).groupBy(chars.pattern(F.col("v")).alias("pattern")).agg(F.sum("m").alias("cnt")))


@query(f"WITH {EMISSIONS}, r AS (SELECT label, surface AS v, cnt, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, surface) AS rn FROM em) SELECT label, {SHAPE} || '{MASKED}' || left(sha256(v), 10) AS masked, cnt, rn FROM r WHERE rn <= 20")
def masked_top_surfaces(spark: SparkSession, d: str) -> DataFrame:
    return grammar.top_by(_emissions(spark, d), "surface", "label", 20).select("label", chars.masked(F.col("surface")).alias("masked"), "cnt", F.col("rn").cast("long").alias("rn"))


def _digits_sql() -> str:
    y, yy = "CAST(v[1:4] AS INT) BETWEEN 1950 AND 2015", "CASE WHEN CAST(v[1:2] AS INT) <= 15 THEN 2000 + CAST(v[1:2] AS INT) WHEN CAST(v[1:2] AS INT) >= 50 THEN 1900 + CAST(v[1:2] AS INT) END"

    def date(year: str, m: str, d: str) -> str:
        return f"try_strptime(({year}) || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0'), '%Y-%m-%d') IS NOT NULL"

    def splits(year: str, at: int, size: int) -> str:
        return "(" + " OR ".join(date(year, f"v[{at}:{at + m - 1}]", f"v[{at + m}:{at + size - 1}]") for m in (1, 2) if 1 <= size - m <= 2) + ")"

    n = "length(v)"
    return f"""CASE WHEN regexp_matches(v, '{numbers.MOBILE}') THEN 'cn_mobile' WHEN {n} = 4 AND {y} THEN 'year'
        WHEN {n} = 6 AND {date(yy, 'v[3:4]', 'v[5:6]')} THEN 'yymmdd' WHEN {n} = 8 AND {y} AND {date('v[1:4]', 'v[5:6]', 'v[7:8]')} THEN 'yyyymmdd'
        WHEN {n} = 6 AND {y} AND CAST(v[5:6] AS INT) BETWEEN 1 AND 12 THEN 'yyyymm' WHEN {n} = 5 AND {y} AND v[5:5] <> '0' THEN 'yyyymm_nopad'
        WHEN {n} = 4 AND {date("'2000'", 'v[1:2]', 'v[3:4]')} THEN 'mmdd' WHEN {n} = 3 AND {splits("'2000'", 1, 3)} THEN 'mmdd_nopad' WHEN {n} = 2 AND {splits("'2000'", 1, 2)} THEN 'mmdd_nopad'
        WHEN {n} = 4 AND {splits(yy, 3, 2)} THEN 'yymmdd_nopad' WHEN {n} = 5 AND {splits(yy, 3, 3)} THEN 'yymmdd_nopad' WHEN {n} = 6 AND {splits(yy, 3, 4)} THEN 'yymmdd_nopad'
        WHEN {n} = 6 AND {y} AND {splits('v[1:4]', 5, 2)} THEN 'yyyymmdd_nopad' WHEN {n} = 7 AND {y} AND {splits('v[1:4]', 5, 3)} THEN 'yyyymmdd_nopad' WHEN {n} = 8 AND {y} AND {splits('v[1:4]', 5, 4)} THEN 'yyyymmdd_nopad'
        ELSE 'number' || {n} END"""


_FORMATS = {"yyyyMMdd": "%Y%m%d", "yyMMdd": "%y%m%d", "yyyyMM": "%Y%m", "MMdd": "%m%d", "yyyyMd": "%Y%-m%-d", "yyMd": "%y%-m%-d", "Md": "%-m%-d", "yyyyM": "%Y%-m", "yyyy": "%Y"}


@query(
    f"WITH {TOK}, dg AS (SELECT unnest(regexp_extract_all(v, '[0-9]+')) AS v FROM tok UNION ALL SELECT unnest([{', '.join(f"strftime(o_orderdate, '{f}')" for f in _FORMATS.values())}]) AS v FROM orders "
    f"UNION ALL SELECT CAST(13000000000 + o_orderkey * 997 AS VARCHAR) AS v FROM orders) SELECT {_digits_sql()} AS label, count(*) AS cnt, count(DISTINCT v) AS n_values FROM dg GROUP BY 1"
)
def number_labels(spark: SparkSession, d: str) -> DataFrame:
    found = tokens(spark, d).select(F.explode(F.regexp_extract_all("v", F.lit("([0-9]+)"), F.lit(1))).alias("v"))
    orders = table(spark, d, "orders")
    dates = orders.select(F.explode(F.array(*[F.date_format("o_orderdate", f) for f in _FORMATS])).alias("v"))
    phones = orders.select((F.lit(13000000000) + F.col("o_orderkey") * 997).cast("string").alias("v"))
    distinct = found.unionByName(dates).unionByName(phones).groupBy("v").agg(F.count("*").alias("m"))
    return distinct.groupBy(numbers.number_label(F.col("v")).alias("label")).agg(F.sum("m").alias("cnt"), F.count("*").alias("n_values"))


@query(f"WITH {EMISSIONS}, t AS (SELECT label, sum(cnt) AS total FROM em GROUP BY 1) SELECT label, left(sha256(surface), 16) AS surface_id, cnt, cnt * 1.0::DOUBLE / total AS p FROM em JOIN t USING (label)")
def emission_probs(spark: SparkSession, d: str) -> DataFrame:
    df = grammar.normalise(_emissions(spark, d), "label")
    return df.select("label", F.left(F.sha2("surface", 256), F.lit(16)).alias("surface_id"), "cnt", "p")


@query(
    f"WITH {STRUCTURES}, r AS (SELECT sp, cnt, sum(cnt) OVER (ORDER BY cnt DESC, sp ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER () AS total FROM st), k AS (SELECT * FROM r WHERE before < 0.98::DOUBLE * total) SELECT sp, cnt, cnt * 1.0::DOUBLE / (SELECT sum(cnt) FROM k) AS p FROM k"
)
def mass_prune_structures(spark: SparkSession, d: str) -> DataFrame:
    return grammar.mass_prune(_structures(spark, d), "sp", 0.98)


@query(
    f"WITH {EMISSIONS}, r AS (SELECT label, surface, cnt, sum(cnt) OVER (PARTITION BY label ORDER BY cnt DESC, surface ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER (PARTITION BY label) AS total FROM em), k AS (SELECT * FROM r WHERE before < 0.99::DOUBLE * total) "
    "SELECT label, left(sha256(surface), 16) AS surface_id, cnt, cnt * 1.0::DOUBLE / sum(cnt) OVER (PARTITION BY label) AS p FROM k"
)
def mass_prune_emissions(spark: SparkSession, d: str) -> DataFrame:
    df = grammar.mass_prune(_emissions(spark, d), "surface", 0.99, "label")
    return df.select("label", F.left(F.sha2("surface", 256), F.lit(16)).alias("surface_id"), "cnt", "p")


@query(
    f"WITH {EMISSIONS}, r AS (SELECT label, surface, cnt, sum(cnt) OVER (PARTITION BY label ORDER BY cnt DESC, surface ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, surface) AS rn FROM em) "
    "SELECT label, left(sha256(surface), 16) AS surface_id, rn, cnt * 1.0::DOUBLE / total AS p FROM r WHERE before < 0.5::DOUBLE * total"
)
def label_trim(spark: SparkSession, d: str) -> DataFrame:
    df = grammar.trim(_emissions(spark, d), "surface", "label", share=0.5)
    return df.select("label", F.left(F.sha2("surface", 256), F.lit(16)).alias("surface_id"), "rn", "p")


@query(f"WITH {EMISSIONS}, r AS (SELECT label, surface, cnt, sum(cnt) OVER (PARTITION BY label) AS total, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, surface) AS rn FROM em) SELECT label, left(sha256(surface), 16) AS surface_id, rn, cnt * 1.0::DOUBLE / total AS p FROM r WHERE rn <= 50")
def label_trim_by_count(spark: SparkSession, d: str) -> DataFrame:
    df = grammar.trim(_emissions(spark, d), "surface", "label", most=50)
    return df.select("label", F.left(F.sha2("surface", 256), F.lit(16)).alias("surface_id"), "rn", "p")


@query(f"WITH {STRUCTURES}, r AS (SELECT cnt, sum(cnt) OVER (ORDER BY cnt DESC, sp ROWS UNBOUNDED PRECEDING) - cnt AS before, sum(cnt) OVER () AS total FROM st) SELECT min(cnt * 1.0::DOUBLE / total) AS min_p, count(*) AS n_values FROM r WHERE before < 0.9::DOUBLE * total")
def min_prob_for_coverage(spark: SparkSession, d: str) -> DataFrame:
    return grammar.least_p_for(_structures(spark, d), "sp", 0.9)


@query(f"WITH {STRUCTURES}, other AS (SELECT {SHAPE} AS sp, count(*) AS cnt FROM tok GROUP BY 1) SELECT count(*) AS n, count(*) FILTER (p > 0.001) AS n_large FROM (SELECT sp, sum(p) AS p FROM (SELECT sp, cnt * 0.7::DOUBLE / (SELECT sum(cnt) FROM st) AS p FROM st UNION ALL SELECT sp, cnt * 0.3::DOUBLE / (SELECT sum(cnt) FROM other) FROM other) GROUP BY 1)")
def mixed_distribution(spark: SparkSession, d: str) -> DataFrame:
    a = grammar.normalise(_structures(spark, d))
    b = stats.with_share(shape_distribution(spark, d).withColumnRenamed("shape", "sp"))
    return grammar.mix(a, b, "sp", 0.7).agg(F.count("*").alias("n"), F.count_if(F.col("p") > 0.001).alias("n_large"))


_KS = list(range(1000, 10001, 1000))


@query(f"WITH {TRAIN} SELECT k, count(*) FILTER (rn <= k) * 1.0::DOUBLE / count(*) AS rate FROM test LEFT JOIN rk USING (v), (SELECT unnest({_KS}) AS k) GROUP BY k")
def coverage_at_k(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.coverage(_test(spark, d), grammar.ranked(_train(spark, d), "value"), _KS)


@query(f"WITH {TRAIN} SELECT k, count(*) FILTER (rn <= k) * 1.0::DOUBLE / count(*) AS rate FROM test LEFT JOIN rk USING (v), (SELECT unnest(range(100::BIGINT, 30001, 100)) AS k) GROUP BY k")
def coverage_curve(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.curve(_test(spark, d), grammar.ranked(_train(spark, d), "value"), 100, 30_000)


@query(
    f"WITH {TOK}, train AS (SELECT lang, v, count(*) AS cnt FROM tok WHERE doc_id % 5 <> 0 GROUP BY 1, 2), rk AS (SELECT lang, v, row_number() OVER (PARTITION BY lang ORDER BY cnt DESC, v) AS rn FROM train), test AS (SELECT lang, v FROM tok WHERE doc_id % 5 = 0) "
    f"SELECT lang, k, count(*) FILTER (rn <= k) * 1.0::DOUBLE / count(*) AS rate FROM test LEFT JOIN rk USING (lang, v), (SELECT unnest({_KS}) AS k) GROUP BY 1, 2"
)
def multi_model_coverage(spark: SparkSession, d: str) -> DataFrame:
    train = tokens(spark, d).where("doc_id % 5 <> 0").groupBy("lang", F.col("v").alias("value")).agg(F.count("*").alias("cnt"))
    return evaluate.coverage(_test(spark, d), grammar.ranked(train, "value", "lang"), _KS, by="lang")


@query(f"WITH {TRAIN} SELECT count(*) AS n, count(rn) AS n_hit, coalesce(sum(coalesce(rn, 30001)), 0)::BIGINT AS sum_rank FROM test LEFT JOIN rk USING (v)")
def hash_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = evaluate.hits(_test(spark, d), grammar.ranked(_train(spark, d), "value"))
    return found.agg(F.count("*").alias("n"), F.count("rn").alias("n_hit"), F.sum(F.coalesce("rn", F.lit(30001))).alias("sum_rank"))


@query(
    f"WITH {TRAIN}, up AS (SELECT v, cnt, rn, lag(cnt) OVER (ORDER BY rn) AS b FROM rk) SELECT count(*) AS total, count(DISTINCT v) AS n_unique, (SELECT count(*) FROM (SELECT v FROM rk GROUP BY v HAVING count(*) > 1)) AS n_repeated, count(*) - count(DISTINCT v) AS n_extra, count(*) FILTER (cnt > b) AS n_rising FROM up"
)
def rank_audit(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.rank_audit(grammar.ranked(_train(spark, d), "value"), p="cnt")


@query(f"WITH {TOK}, c AS (SELECT v, count(*) AS c FROM tok GROUP BY 1) SELECT sum(c)::BIGINT AS total, count(*) AS n_unique, count(*) FILTER (c > 1) AS n_groups, sum(c - 1)::BIGINT AS n_extra FROM c")
def duplicate_audit(spark: SparkSession, d: str) -> DataFrame:
    return stats.duplicate_audit(tokens(spark, d))


_MAIL = rf"{TOK}, mail AS (SELECT v, split_part(v, '@', 1) AS loc, regexp_replace(v, '^[^@]*@', '') AS host FROM tok WHERE regexp_matches(v, '{chars.EMAIL}'))"


@query(
    rf"WITH {_MAIL}, parts AS (SELECT v, loc, string_split(host, '.') AS l, host FROM mail) SELECT left(sha256(v), 16) AS email_id, length(loc) AS local_len, CASE WHEN len(l) >= 3 THEN l[-3] WHEN len(l) = 2 THEN l[1] ELSE host END AS main_label, count(*) AS cnt FROM parts GROUP BY 1, 2, 3"
)
def email_parts(spark: SparkSession, d: str) -> DataFrame:
    mail = tokens(spark, d).where(F.col("v").rlike(chars.EMAIL))
    return mail.groupBy(F.left(F.sha2("v", 256), F.lit(16)).alias("email_id"), F.length(chars.email_local(F.col("v"))).alias("local_len"), chars.email_domain(F.col("v")).alias("main_label")).agg(F.count("*").alias("cnt"))


@query(
    f"WITH made AS (SELECT CASE WHEN c_custkey % 7 = 0 THEN 'no address' ELSE 'c' || c_custkey || '@a.example.org' END AS k, CASE WHEN c_custkey % 3 = 0 THEN upper('c' || c_custkey) WHEN c_custkey % 3 = 1 THEN 'c' || c_custkey || 'x' END AS v FROM customer), "
    f"valid AS (SELECT lower(split_part(k, '@', 1)) = lower(v) AS same FROM made WHERE regexp_matches(k, '{chars.EMAIL}') AND v IS NOT NULL) SELECT count(*) AS n, count(*) FILTER (same) AS n_same, CASE WHEN count(*) > 0 THEN count(*) FILTER (same) * 1.0::DOUBLE / count(*) ELSE 0 END AS rate FROM valid"
)
def match_rate(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    name = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    key = F.when(F.col("c_custkey") % 7 == 0, "no address").otherwise(F.concat(name, F.lit("@a.example.org")))
    made = c.select(key.alias("k"), F.when(F.col("c_custkey") % 3 == 0, F.upper(name)).when(F.col("c_custkey") % 3 == 1, F.concat(name, F.lit("x"))).alias("v"))
    return stats.match_rate(made, "k", "v")


@query("WITH p AS (SELECT c_name AS k, CASE c_custkey % 4 WHEN 0 THEN upper(c_name) WHEN 1 THEN c_name || '7' WHEN 2 THEN 'x' || c_custkey ELSE '' END AS v FROM customer) SELECT CASE WHEN lower(k) = lower(v) THEN 'same' WHEN contains(lower(v), lower(k)) THEN 'contains' ELSE 'none' END AS relation, count(*) AS cnt FROM p WHERE v <> '' GROUP BY 1")
def relation_label(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey") % 4
    v = F.when(k == 0, F.upper("c_name")).when(k == 1, F.concat("c_name", F.lit("7"))).when(k == 2, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise("")
    made = sources.pairs(table(spark, d, "customer").select("c_name", v.alias("v")), "c_name", "v")
    return made.groupBy(stats.relation(F.col("key"), F.col("value")).alias("relation")).agg(F.count("*").alias("cnt"))


_DICT = f"{TOK}, dict AS (SELECT v AS term FROM tok WHERE regexp_matches(v, '^[a-z]{{4,12}}$') GROUP BY v HAVING count(*) >= 20)"


def _dictionary(spark: SparkSession, d: str) -> DataFrame:
    plain = tokens(spark, d).where(F.col("v").rlike("^[a-z]{4,12}$"))
    return plain.groupBy(F.col("v").alias("term")).agg(F.count("*").alias("c")).where("c >= 20").select("term")


@query(f"WITH {_DICT}, m AS (SELECT v, translate(lower(v), '{chars.LEET_FROM}', '{chars.LEET_TO}') AS t FROM tok) SELECT count(*) AS n, count(*) FILTER (t <> lower(v) AND length(v) >= 4) AS n_leet FROM m JOIN dict ON t = term")
def leet_lookup(spark: SparkSession, d: str) -> DataFrame:
    found = tokens(spark, d).withColumn("term", chars.leet(F.col("v"))).join(_dictionary(spark, d), "term")
    return found.agg(F.count("*").alias("n"), F.count_if((F.col("term") != F.lower("v")) & (F.length("v") >= 4)).alias("n_leet"))


@query(f"WITH {_DICT}, w AS (SELECT v, count(*) AS m FROM tok WHERE length(v) >= 4 GROUP BY 1), at_ AS (SELECT m, v, unnest(range(1, length(v) + 1)) AS i FROM w), s AS (SELECT m, i, lower(v[i:i + n - 1]) AS term FROM at_, (SELECT unnest(range(4, 13)) AS n) WHERE i + n - 1 <= length(v)) SELECT term, sum(m)::BIGINT AS n_found, count(*) AS n_places FROM s JOIN dict USING (term) GROUP BY 1")
def dictionary_match(spark: SparkSession, d: str) -> DataFrame:
    distinct = tokens(spark, d).where(F.length("v") >= 4).groupBy("v").agg(F.count("*").alias("m"))
    found = stats.contains_terms(distinct, _dictionary(spark, d), longest=12, shortest=4)
    return found.groupBy("term").agg(F.sum("m").alias("n_found"), F.count("*").alias("n_places"))


@query(f"WITH {_DICT}, w AS (SELECT v AS term, 'common' AS label FROM tok WHERE regexp_matches(v, '^[a-z]{{4,12}}$') GROUP BY v HAVING count(*) >= 200), both_ AS (SELECT * FROM w UNION ALL SELECT term, 'word' FROM dict WHERE term NOT IN (SELECT term FROM w)) SELECT label, count(*) AS n FROM both_ GROUP BY 1")
def dictionary_precedence(spark: SparkSession, d: str) -> DataFrame:
    plain = tokens(spark, d).where(F.col("v").rlike("^[a-z]{4,12}$"))
    common = plain.groupBy(F.col("v").alias("term")).agg(F.count("*").alias("c")).where("c >= 200").select("term", F.lit("common").alias("label"))
    return stats.precedence(common, _dictionary(spark, d).withColumn("label", F.lit("word"))).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE doc_id >= 200 AND doc_id < 400")
def batch_scan(spark: SparkSession, d: str) -> DataFrame:
    return sources.batch(table(spark, d, "documents"), "doc_id", 1, 200).select("doc_id", F.length("text").cast("long").alias("n"))


@query("SELECT max(doc_id) AS max_id, count(*) AS n FROM documents")
def max_id(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").agg(F.max("doc_id").alias("max_id"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100")
def first_rows(spark: SparkSession, d: str) -> DataFrame:
    return sources.first_rows(table(spark, d, "documents").select("doc_id"), 100, "doc_id")


@query("SELECT 10::BIGINT AS n_parts, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids FROM documents")
def sample_windows(spark: SparkSession, d: str) -> DataFrame:
    """The disjoint pseudo-random samples of all documents: together they are the table."""
    docs = table(spark, d, "documents").select("doc_id")
    parts = [sources.sample_window(docs, "doc_id", i, 10, seed=3).select(F.lit(i).alias("part"), "doc_id") for i in range(10)]
    return reduce(DataFrame.unionByName, parts).agg(F.count_distinct("part").alias("n_parts"), F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"))


@query("SELECT least(500, count(*))::BIGINT AS n_rows, least(500, count(*))::BIGINT AS n_ids FROM documents")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    return sources.random_rows(docs, 500, seed=11).join(docs, "doc_id", "left_semi").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"))


@query("SELECT name, count(*) FILTER (v IS NULL) AS n_null, count(*) FILTER (v = '') AS n_empty, count(*) FILTER (v <> '') AS n_usable FROM (SELECT 'text' AS name, text AS v FROM documents UNION ALL SELECT 'lang', lang FROM documents UNION ALL SELECT 'source', source FROM documents) GROUP BY 1")
def row_accounting(spark: SparkSession, d: str) -> DataFrame:
    return sources.accounting(table(spark, d, "documents"), "text", "lang", "source")


_PAIRED = f"{TOK}, ps AS (SELECT lang AS k, v FROM tok), kp AS (SELECT k, v, {SP} AS sv, {SP.replace('(v,', '(k,')} AS sk, count(*) AS cnt FROM ps GROUP BY k, v)"


def _pairs_of_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy(F.col("lang").alias("key"), F.col("v").alias("value")).agg(F.count("*").alias("m"))


@query(f"WITH {_PAIRED}, st AS (SELECT sk || ' acc_pwd_sep ' || sv AS sp, sum(cnt)::BIGINT AS cnt FROM kp GROUP BY 1) SELECT sp, cnt, cnt * 1.0::DOUBLE / (SELECT sum(cnt) FROM st) AS p FROM st")
def integer_baseline(spark: SparkSession, d: str) -> DataFrame:
    return grammar.normalise(grammar.pair_structures(_pairs_of_tokens(spark, d)))


@query(
    f"WITH {_PAIRED}, em AS (SELECT {CLASS} || length(x) AS label, x AS surface, sum(cnt)::BIGINT AS cnt FROM (SELECT unnest(regexp_extract_all(k, '{RUN}', 1)) AS x, cnt FROM kp UNION ALL SELECT unnest(regexp_extract_all(v, '{RUN}', 1)), cnt FROM kp) GROUP BY 1, 2), t AS (SELECT label, sum(cnt) AS total FROM em GROUP BY 1) "
    "SELECT label, left(sha256(surface), 16) AS surface_id, cnt, cnt * 1.0::DOUBLE / total AS p FROM em JOIN t USING (label)"
)
def integer_emissions(spark: SparkSession, d: str) -> DataFrame:
    df = grammar.normalise(grammar.pair_emissions(_pairs_of_tokens(spark, d)), "label")
    return df.select("label", F.left(F.sha2("surface", 256), F.lit(16)).alias("surface_id"), "cnt", "p")


@query(
    f"WITH {EMISSIONS}, st AS (SELECT {SP} AS sp, count(*) AS cnt FROM tok GROUP BY 1), a AS (SELECT 'structure' AS kind, '' AS label, sp AS shown, cnt FROM st ORDER BY cnt DESC, sp LIMIT 100), r AS (SELECT label, surface AS v, cnt, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, surface) AS rn FROM em) "
    f"SELECT * FROM a UNION ALL SELECT 'surface', label, {SHAPE} || '{MASKED}' || left(sha256('pepper' || v), 10), cnt FROM r WHERE rn <= 20"
)
def redacted_report(spark: SparkSession, d: str) -> DataFrame:
    return grammar.report(_structures(spark, d), _emissions(spark, d), salt="pepper")


def _pattern_counts(df: DataFrame, detect, start: str) -> DataFrame:
    """label, cnt, n_values of what a detector finds in distinct values (v, m)."""
    found = parse.segments(df, detect=lambda x: [(t, k or "") for t, k in detect(x) or []]).select("m", F.explode("segs").alias("s")).where(F.startswith("s.label", F.lit(start)))
    return found.groupBy(F.col("s.label").alias("label")).agg(F.sum("m").alias("cnt"), F.count("*").alias("n_values"))


_COUNTED = "SELECT label, sum(m)::BIGINT AS cnt, count(*) AS n_values FROM hit GROUP BY 1"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"


# Every unit from every place, then from the left the first that counts after the end of the one before.
@query(
    f"""WITH RECURSIVE {TOK}, w AS (SELECT v, lower(v) AS f, count(*) AS m, length(v) AS n FROM tok GROUP BY v),
    at_ AS (SELECT v, f, m, n, unnest(range(1, n)) AS i FROM w), unit AS (SELECT *, unnest(range(1, (n - i + 1) // 2 + 1)) AS u FROM at_),
    twice AS (SELECT v, f, m, n, i, u, f[i:i + u - 1] AS x FROM unit WHERE f[i:i + u - 1] = f[i + u:i + 2 * u - 1] AND regexp_full_match(f[i:i + u - 1], '[a-z0-9]+')),
    times AS (SELECT *, len(list_filter(range(1, (n - i + 1) // u + 1), lambda k: f[i:i + k * u - 1] = repeat(x, k))) AS k FROM twice),
    fits AS (SELECT v, m, i, u, i + k * u AS e, 'sr' || k AS label FROM times WHERE CASE WHEN regexp_full_match(x, '[0-9]+') THEN k >= 3 AND NOT regexp_matches(v[i - 1:i - 1], '[0-9]') AND NOT regexp_matches(v[i + k * u:i + k * u], '[0-9]')
        ELSE (k >= 3 OR u > 1) AND NOT (i > 1 AND regexp_matches(v[i - 1:i - 1], '\\p{{L}}')) AND NOT regexp_matches(v[i + k * u:i + k * u], '\\p{{L}}') END),
    best AS (SELECT v, m, i, arg_min(e, u) AS e, arg_min(label, u) AS label FROM fits GROUP BY v, m, i),
    hit AS (SELECT v, m, min(i) AS i, arg_min(e, i) AS e, arg_min(label, i) AS label FROM best GROUP BY v, m
        UNION ALL SELECT v, m, i, e, label FROM (SELECT b.*, row_number() OVER (PARTITION BY b.v ORDER BY b.i) AS r FROM hit h JOIN best b ON b.v = h.v AND b.i >= h.e) WHERE r = 1)
    {_COUNTED}"""
)
def repeat_runs(spark: SparkSession, d: str) -> DataFrame:
    return _pattern_counts(_distinct(spark, d), patterns.repeats, "sr")


_ALPHA_MADE = f"'{_LETTERS}'[1 + c_custkey % 20:3 + c_custkey % 20 + c_custkey % 4] || c_custkey || '!'"


@query(f"WITH {TOK}, w AS (SELECT v, count(*) AS m FROM (SELECT v FROM tok UNION ALL SELECT {_ALPHA_MADE} FROM customer) GROUP BY v), x AS (SELECT m, unnest(regexp_extract_all(v, '\\p{{L}}+')) AS x FROM w), hit AS (SELECT 'alpha' || length(x) AS label, m FROM x WHERE length(x) >= 3 AND contains('{_LETTERS}', lower(x))) {_COUNTED}")
def alpha_runs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    made = table(spark, d, "customer").select(F.concat(F.substring(F.lit(_LETTERS), (1 + k % 20).cast("int"), (3 + k % 4).cast("int")), k.cast("string"), F.lit("!")).alias("v"))
    values = tokens(spark, d).select("v").unionByName(made).groupBy("v").agg(F.count("*").alias("m"))
    return _pattern_counts(values, patterns.alphabet_runs, "alpha")


_KEYS = ", ".join("(" + ", ".join(["'" + c.replace("'", "''") + "'", str(r), str(i)]) + ")" for c, (r, i) in patterns.KEYS.items())


@query(
    f"""WITH {TOK}, keys(c, r, x) AS (VALUES {_KEYS}), w AS (SELECT v, count(*) AS m FROM tok WHERE length(v) >= 4 GROUP BY v), ch AS (SELECT v, m, unnest(range(1, length(v) + 1)) AS i FROM w),
    k AS (SELECT v, m, i, v[i:i] AS c, r, x, lag(r) OVER o AS r0, lag(x) OVER o AS x0 FROM ch LEFT JOIN keys ON c = v[i:i] WINDOW o AS (PARTITION BY v ORDER BY i)),
    run AS (SELECT *, sum(CASE WHEN coalesce((r = r0 AND abs(x - x0) = 1) OR (r = r0 + 1 AND x - x0 IN (0, -1)) OR (r = r0 - 1 AND x - x0 IN (0, 1)), false) THEN 0 ELSE 1 END) OVER (PARTITION BY v ORDER BY i) AS n, CASE WHEN c BETWEEN '0' AND '9' THEN 'D' WHEN regexp_matches(c, '[A-Za-z]') THEN 'L' ELSE 'S' END AS kind FROM k),
    ends AS (SELECT v, n, max(i) AS e FROM run GROUP BY 1, 2 HAVING count(*) >= 4),
    tail AS (SELECT a.v, a.m, a.n, a.i, e, a.v[a.i:e] AS s, count(DISTINCT b.r) AS n_rows, count(DISTINCT b.kind) AS n_kinds FROM run a JOIN ends USING (v, n) JOIN run b ON b.v = a.v AND b.n = a.n AND b.i >= a.i WHERE e - a.i >= 3 GROUP BY ALL),
    walk AS (SELECT v, m, n, min(i) AS i, any_value(e) AS e FROM tail WHERE n_rows = 1 OR (n_kinds >= 2 AND NOT regexp_matches(lower(s), '{'|'.join(patterns.NO_WALK)}')) GROUP BY v, m, n),
    hit AS (SELECT 'kb' || (e - i + 1) AS label, m FROM walk WHERE NOT regexp_full_match(v[i:e], '[0-9]+')) {_COUNTED}"""
)
def keyboard_walks(spark: SparkSession, d: str) -> DataFrame:
    return _pattern_counts(_distinct(spark, d), lambda x: patterns.walks(x)[0], "kb")


@query()
def coarse_structures(spark: SparkSession, d: str) -> DataFrame:
    """Structures of the whole coarse pass: repeats, walks, three keys, alphabet runs and the rest."""
    found = parse.segments(_distinct(spark, d)).select("m", F.array_join(F.transform("segs", lambda s: s["label"]), " ").alias("sp"))
    return found.groupBy("sp").agg(F.sum("m").alias("cnt"))


_RELATED = """WITH p AS (SELECT 'c' || c_custkey || '@m.shop' || c_custkey % 9 || '.example' AS k, CASE c_custkey % 5 WHEN 0 THEN upper('c' || c_custkey || '@m.shop' || c_custkey % 9 || '.example') WHEN 1 THEN 'c' || c_custkey || '!C' || c_custkey WHEN 2 THEN 'xm.Shop' || c_custkey % 9 || '.example' WHEN 3 THEN 'my' || 'm' || c_custkey ELSE 'other' END AS v FROM customer),
    q AS (SELECT lower(v) AS v, lower(k) AS k, split_part(lower(k), '@', 2) AS host, split_part(lower(k), '@', 1) AS loc FROM p), l AS (SELECT *, string_split(host, '.') AS ls FROM q),
    z AS (SELECT v, k, host, loc, CASE WHEN len(ls) >= 3 THEN ls[-3] WHEN len(ls) = 2 THEN ls[1] ELSE host END AS main FROM l),
    r AS (SELECT v, CASE WHEN v = k THEN k WHEN contains(v, host) THEN host WHEN contains(v, loc) THEN loc WHEN contains(v, main) THEN main END AS part, CASE WHEN v = k THEN 'acc_pwd_same' WHEN contains(v, host) THEN 'acc_email_domain_com' WHEN contains(v, loc) THEN 'acc_email_name' ELSE 'acc_email_domain' END AS label FROM z)
    SELECT label, count(*) AS n_values, sum((length(v) - length(replace(v, part, ''))) // length(part))::BIGINT AS n_parts FROM r WHERE part IS NOT NULL GROUP BY 1"""


@query(_RELATED)
def key_relations(spark: SparkSession, d: str) -> DataFrame:
    """Parts that values take from their keys, as segments. The pairs are made of customer numbers."""
    n = F.col("c_custkey")
    name, host = F.concat(F.lit("c"), n.cast("string")), F.concat(F.lit("m.shop"), (n % 9).cast("string"), F.lit(".example"))
    key = F.concat(name, F.lit("@"), host)
    value = F.when(n % 5 == 0, F.upper(key)).when(n % 5 == 1, F.concat(name, F.lit("!C"), n.cast("string"))).when(n % 5 == 2, F.concat(F.lit("x"), F.replace(host, F.lit("shop"), F.lit("Shop")))).when(n % 5 == 3, F.concat(F.lit("mym"), n.cast("string"))).otherwise("other")
    made = sources.pairs(table(spark, d, "customer").select(key.alias("k"), value.alias("v")), "k", "v")
    parts = parse.related_segments(made).select("key", F.explode("segs").alias("s")).where(F.startswith("s.label", F.lit("acc_")))
    return parts.groupBy(F.col("s.label").alias("label")).agg(F.count_distinct("key").alias("n_values"), F.count("*").alias("n_parts"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    """term, label: the corpus's own frequent short words, those of up to three letters as syllables too."""
    plain = tokens(spark, d).where(F.col("v").rlike(r"^\p{Ll}{3,12}$")).groupBy(F.col("v").alias("term")).agg(F.count("*").alias("c")).where("c >= 5")
    labels = F.when(F.length("term") <= 3, F.array(F.lit("word"), F.lit("syllable"))).otherwise(F.array(F.lit("word")))
    return plain.select("term", F.explode(labels).alias("label"))


def _cut_here(df: DataFrame) -> DataFrame:
    """Computed once for several uses, in the folder that all executors share if the session names one."""
    return df.checkpoint() if df.sparkSession.conf.get("spark.checkpoint.dir", None) else df.persist()


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return _cut_here(parse.samples(parse.parses(tokens(spark, d), _terms(spark, d), Config.from_env())))


@query()
def kbest_parses(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select(chars.masked(F.col("v")).alias("value_id"), "sp", F.round("logp", 9).alias("logp"), F.round("w", 9).alias("w"), "m")


@query()
def named_parses(spark: SparkSession, d: str) -> DataFrame:
    """Soft counts by label where names and name forms are known: nations are names, regions are forms, and values join them with numbers."""
    nations, regions = table(spark, d, "nation"), table(spark, d, "region")
    name, form = F.lower(F.regexp_replace("n_name", "[^A-Za-z]", "")), F.lower(F.regexp_replace("r_name", "[^A-Za-z]", ""))
    terms = nations.select(name.alias("term"), F.lit("name").alias("label")).unionByName(regions.select(form.alias("term"), F.lit("cn_name_full").alias("label"))).unionByName(_terms(spark, d))
    both = nations.join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey"))
    values = both.select(F.explode(F.array(F.concat(name, F.col("n_nationkey").cast("string")), F.concat(F.lit("my"), form), F.concat(form, name), F.concat(F.initcap(name), F.lit("_2001")))).alias("v"))
    found = parse.samples(parse.parses(values, terms, Config.from_env())).select((F.col("w") * F.col("m")).alias("w"), F.explode("segs.label").alias("label"))
    return found.groupBy("label").agg(F.round(F.sum("w"), 6).alias("cnt"))


@query()
def soft_structure_probs(spark: SparkSession, d: str) -> DataFrame:
    return grammar.normalise(parse.soft_structures(_samples(spark, d))).select("sp", F.round("cnt", 6).alias("cnt"), F.round("p", 9).alias("p"))


@query()
def soft_emission_probs(spark: SparkSession, d: str) -> DataFrame:
    df = grammar.normalise(parse.soft_emissions(_samples(spark, d)), "label")
    return df.select("label", F.left(F.sha2("surface", 256), F.lit(16)).alias("surface_id"), F.round("cnt", 6).alias("cnt"), F.round("p", 9).alias("p"))


def _model(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    return grammar.normalise(parse.soft_structures(s)), grammar.normalise(parse.soft_emissions(s), "label")


@query()
def score_values(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    return parse.scores(s, *_model(s)).select(chars.masked(F.col("v")).alias("value_id"), F.round("log_p", 6).alias("log_p"))


#: Paths drawn from the model for the guess-number estimate.
DRAWN = 10_000


@query()
def guess_number(spark: SparkSession, d: str) -> DataFrame:
    s = _samples(spark, d)
    structures, emissions = map(_cut_here, _model(s))
    out = parse.guess_numbers(parse.scores(s, structures, emissions), parse.draws(structures, emissions, DRAWN))
    return out.groupBy(F.floor("log10_guesses").cast("long").alias("log10_guesses")).agg(F.count("*").alias("n_values"))
