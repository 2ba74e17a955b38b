"""Quality rules by distribution divergence, in DataFrame expressions only.

A document's histogram of character classes and its histogram of common words are
compared with those of each language by Jensen-Shannon distance (base 2); the closest
language counts, for each histogram by itself. The languages' histograms are learned
(:func:`fit`) from all rows with a language and a text. A histogram of few words is far from any other by
chance, in proportion to one over the root of their number, so the limits grow in that
way, and below a least length a distance rejects nothing.

Null and empty texts have no words, fail the base rules and are not kept. Rows are
judged one by one, so ties and repeated rows get the same verdict each; other columns
of the input are passed through by :func:`judge` and may have any name but those that
it adds (with a clash, the added column replaces the given one). Without a row to learn
from (an empty table, no language known) only the base rules reject.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NOT_SPACE, discard, fixed, staged, words_of

#: The DuckDB text learns from about so many rows; up to this number that is all of them, and the text and the operator agree.
SQL_ROWS = 20_000

# Classes of characters as patterns; white space is a class too, and letters and the like are the rest.
CHAR_CLASSES = {"digit": "[0-9]+", "stop": "[.,;:!?'\"()-]+", "symbol": "[#*$%&|<>]+"}


@dataclass(frozen=True)
class QualityParams:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: The limit of a distance is a part that holds for any length and one over the root of the number of words.
    max_char_distance: float = 0.15
    max_word_distance: float = 0.15
    by_root_of_words: float = 1.0
    min_chars_for_chars: int = 200
    min_words_for_words: int = 50
    #: None: every row with a language and a text is learned from. A number asks for about so many rows only, those with the smallest MD5 of their id.
    most_rows: int | None = None
    #: Words in a language's histogram.
    common_words: int = 12


@dataclass(frozen=True)
class Reference:
    """A language's shares: of its common words, and of the character classes and white space."""

    words: dict[str, float]
    chars: tuple[float, ...]


def _class_counts(text: Column) -> dict[str, Column]:
    return {f"_c_{name}": _matched(text, pattern) for name, pattern in CHAR_CLASSES.items()}


def fit(docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", params: QualityParams = QualityParams()) -> dict[str, Reference]:
    """The histograms of each language. What reaches the driver is a few numbers for each of them."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    if params.most_rows is not None:
        limit = f"{int(min(1.0, params.most_rows / max(labelled.count(), 1)) * 0xFFFFFFFF):08x}"
        labelled = labelled.where(F.coalesce(F.left(F.md5(F.col(id).cast("string").cast("binary")), F.lit(8)) <= limit, F.lit(limit == "ffffffff")))
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("t"))
    lengths = rows.groupBy("lang").agg(F.sum(F.length("t")).alias("len")).collect()
    # No class holds white space, and none changes with case: what words hold is counted once for each distinct word.
    words = rows.select("lang", F.explode(words_of(F.col("t"))).alias("w")).groupBy("lang", F.lower("w").alias("w")).agg(F.count("*").alias("c"), F.sum(F.length("w")).alias("chars"))
    words = staged(words, "quality-words")
    sums = words.groupBy("lang").agg(F.sum("c").alias("n"), F.sum("chars").alias("word_chars"), *[F.sum(n * F.col("c")).alias(k) for k, n in _class_counts(F.col("w")).items()])
    held = {r["lang"]: r for r in sums.collect()}
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))
    top = words.where(F.col("w").rlike(r"\p{L}")).withColumn("r", first).where(F.col("r") <= params.common_words).collect()
    discard(words)
    out = {}
    for language, length in sorted((r["lang"], r["len"]) for r in lengths):
        own = sorted((x["r"], x["w"], x["c"]) for x in top if x["lang"] == language)
        if own:
            r = held[language]
            chars = [r[f"_c_{name}"] for name in CHAR_CLASSES] + [length - r["word_chars"]]
            out[language] = Reference({w: c / r["n"] for _, w, c in own}, tuple(x / length for x in [*chars, length - sum(chars)]))
    return out


def _kl_half(p: Column, q: float) -> Column:
    m = (p + F.lit(q)) / 2
    other = 0.5 * q * F.log2(F.lit(q) / m) if q > 0 else F.lit(0.0)
    return F.when(p > 0, 0.5 * p * F.log2(p / m)).otherwise(0.0) + other


def js_distance(shares: list[Column], reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of columns and one of numbers, from 0 to 1."""
    return F.sqrt(F.greatest(F.lit(0.0), reduce(lambda a, b: a + b, (_kl_half(p, q) for p, q in zip(shares, reference, strict=True)))))


def _matched(text: Column, pattern: str) -> Column:
    """Characters of a text that a pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))).cast("long")


def _count(listed: str, word: str) -> Column:
    """How often a word stands in a list of which each entry has a blank on either side."""
    return (F.length(listed) - F.length(F.replace(F.col(listed), F.lit(f" {word} "), F.lit("")))) / (len(word) + 2)


def judge(docs: DataFrame, references: dict[str, Reference], text: str = "text", params: QualityParams = QualityParams()) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance (null without references), base_failed and kept."""
    common = sorted({w for r in references.values() for w in r.words})
    t = F.coalesce(F.col(text), F.lit(""))
    df = fixed(docs, "_words", words_of(F.col(text))).withColumn("n_words", F.size("_words").cast("long"))
    # Equal windows: hashes with their places, sorted, so that equal ones are neighbours.
    df = fixed(df, "_hashes", F.when(F.col("n_words") >= 3, F.expr("transform(slice(_words, 1, int(n_words) - 2), (w, i) -> xxhash64(w, get(_words, i + 1), get(_words, i + 2)))")))
    df = fixed(df, "_sorted", F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.expr("sort_array(transform(_hashes, (h, i) -> named_struct('h', h, 'i', i)))")))
    df = fixed(df, "_at", F.expr("sort_array(transform(filter(_sorted, (x, i) -> x.h = get(_sorted, i + 1).h or x.h = get(_sorted, i - 1).h), x -> x.i))"))
    df = df.withColumn("n_repeat_words", F.expr("coalesce(aggregate(zip_with(_at, slice(_at, 2, greatest(size(_at), 1)), (a, b) -> least(3, coalesce(b - a, 3))), 0L, (s, x) -> s + x), 0L)"))
    df = df.withColumn("_length", F.length(t).cast("long"))
    for name, count in _class_counts(t).items():
        df = df.withColumn(name, count)
    df = df.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long")).withColumn("n_symbols", F.col("_c_symbol"))
    df = fixed(df, "_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(NOT_SPACE)))
    df = df.withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
    # Histograms.
    seen = [F.col(f"_c_{name}") for name in CHAR_CLASSES] + [F.col("_length") - F.col("word_chars")]
    length = F.greatest(F.col("_length"), F.lit(1))
    shares = [c / length for c in seen] + [(F.col("_length") - reduce(lambda a, b: a + b, seen)) / length]
    shares = [F.greatest(F.lit(0.0), s) for s in shares]
    df = fixed(df, "_shares", F.array(*shares))
    df = df.withColumn("char_distance", _closest([js_distance([F.get("_shares", F.lit(i)) for i in range(len(shares))], list(r.chars)) for r in references.values()]))
    # Of a long text only the common words go on; no word of theirs is longer than the longest of these.
    df = df.withColumn("_common", F.concat(F.lit(" "), F.array_join(F.filter(F.transform("_words", lambda w: F.lower(w)), lambda w: w.isin(common) if common else F.lit(False)), "  "), F.lit(" ")))
    df = fixed(df, "_common", F.col("_common"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    df = fixed(df, "_counts", F.array(*[(_count("_common", x) / n).cast("double") for x in common]))
    by_language = []
    for r in references.values():
        ps = [F.get("_counts", F.lit(common.index(w))) for w in r.words]
        rest = F.greatest(F.lit(0.0), 1 - reduce(lambda a, b: a + b, ps))
        by_language.append(js_distance([*ps, rest], [*r.words.values(), max(0.0, 1 - sum(r.words.values()))]))
    df = df.withColumn("word_distance", _closest(by_language))
    df = df.withColumn("base_failed", (F.col("n_words") < params.min_words) | (100 * F.col("n_repeat_words") > params.max_repeat_percent * F.col("n_words")))
    chance = F.lit(params.by_root_of_words) / F.sqrt(n)
    odd_chars = (F.col("_length") >= params.min_chars_for_chars) & (F.col("char_distance") > params.max_char_distance + chance)
    odd_words = (F.col("n_words") >= params.min_words_for_words) & (F.col("word_distance") > params.max_word_distance + chance)
    df = fixed(df, "kept", ~F.col("base_failed") & ~F.coalesce(odd_chars, F.lit(False)) & ~F.coalesce(odd_words, F.lit(False)))
    return df.drop("_words", "_hashes", "_sorted", "_at", "_length", "_lines", "_shares", "_common", "_counts", *[f"_c_{name}" for name in CHAR_CLASSES])


def _closest(distances: list[Column]) -> Column:
    return F.least(*distances) if len(distances) > 1 else distances[0] if distances else F.lit(None).cast("double")


def sql(table: str = "documents", params: QualityParams = QualityParams()) -> str:
    """The same rules as DuckDB SQL over doc_id, text and lang; doc_id must be unique. With more than SQL_ROWS rows to learn from this text takes only so many, the operator all."""
    words = r"list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
    lines = r"list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))"
    classes = ", ".join(f"length(t) - length(regexp_replace(t, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')) AS c_{name}" for name, p in CHAR_CLASSES.items())
    names = [f"c_{name}" for name in CHAR_CLASSES]
    counts = [*names, "(n_chars - word_chars)", f"(word_chars - {' - '.join(names)})"]
    half = "CASE WHEN p > 0 THEN 0.5 * p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN 0.5 * q * log2(q / ((p + q) / 2)) ELSE 0 END"
    return f"""WITH d AS (SELECT doc_id, lang, text IS NOT NULL AS given, coalesce(text, '') AS t FROM {table}),
        a AS (SELECT doc_id, lang, given, {words} AS w, len({words}) AS n_words, length(array_to_string({words}, '')) AS word_chars, {lines} AS l, length(t) AS n_chars, {classes} FROM d),
        tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, y, z) AS c FROM (SELECT doc_id, i, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT doc_id, w, unnest(range(1, n_words - 1)) AS i FROM a))),
        rep AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM tri WHERE c > 1) GROUP BY 1),
        few AS (SELECT * FROM a WHERE lang IS NOT NULL AND given AND left(md5(doc_id::VARCHAR), 8) <= (SELECT format('{{:08x}}', CAST(floor(least(1.0::DOUBLE, {params.most_rows or SQL_ROWS}::DOUBLE / greatest(count(*), 1)) * 4294967295) AS BIGINT)) FROM a WHERE lang IS NOT NULL AND given)),
        sums AS (SELECT lang, sum(n_words)::DOUBLE AS n, sum(n_chars)::DOUBLE AS len, [{', '.join(f'sum({c})::DOUBLE' for c in counts)}] AS cs FROM few GROUP BY 1),
        fw AS (SELECT lang, x, count(*) AS c FROM (SELECT lang, lower(unnest(w)) AS x FROM few) WHERE regexp_matches(x, '\\p{{L}}') GROUP BY 1, 2),
        top AS (SELECT lang, x, c / n AS q FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY c DESC, x) AS r FROM fw) JOIN sums USING (lang) WHERE r <= {params.common_words} AND len > 0),
        dw AS (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, lower(unnest(w)) AS x FROM a) WHERE x IN (SELECT x FROM top) GROUP BY 1, 2),
        ps AS (SELECT a.doc_id, top.lang, coalesce(dw.c, 0) / greatest(a.n_words, 1) AS p, q FROM a CROSS JOIN top LEFT JOIN dw ON dw.doc_id = a.doc_id AND dw.x = top.x),
        both_ AS (SELECT * FROM ps UNION ALL SELECT doc_id, lang, greatest(0.0, 1 - sum(p)), greatest(0.0, 1 - sum(q)) FROM ps GROUP BY 1, 2),
        wd AS (SELECT doc_id, min(x) AS wd FROM (SELECT doc_id, lang, sqrt(greatest(0.0, sum({half}))) AS x FROM both_ GROUP BY 1, 2) GROUP BY 1),
        cp AS (SELECT doc_id, lang, greatest(0.0, unnest([{', '.join(counts)}]) / greatest(n_chars, 1)) AS p, unnest(cs) / len AS q FROM (SELECT a.* EXCLUDE (lang), s.lang, s.cs, s.len FROM a CROSS JOIN sums s WHERE s.lang IN (SELECT lang FROM top))),
        cd AS (SELECT doc_id, min(x) AS cd FROM (SELECT doc_id, lang, sqrt(greatest(0.0, sum({half}))) AS x FROM cp GROUP BY 1, 2) GROUP BY 1),
        b AS (SELECT a.*, coalesce(rep.n, 0) AS n_rep, n_words < {params.min_words} OR 100 * coalesce(rep.n, 0) > {params.max_repeat_percent} * n_words AS failed, cd, wd, {params.by_root_of_words!r}::DOUBLE / sqrt(greatest(n_words, 1)) AS chance FROM a LEFT JOIN rep USING (doc_id) LEFT JOIN cd USING (doc_id) LEFT JOIN wd USING (doc_id))
        SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, c_symbol::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_rep::BIGINT AS n_repeat_words, failed AS base_failed,
        NOT failed AND NOT coalesce(n_chars >= {params.min_chars_for_chars} AND cd > {params.max_char_distance!r}::DOUBLE + chance, false) AND NOT coalesce(n_words >= {params.min_words_for_words} AND wd > {params.max_word_distance!r}::DOUBLE + chance, false) AS kept FROM b"""
