import random
import re
from collections import Counter
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from glyphloom.llm import decontaminate, graph, line_dedup, ngram_join

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ri", "so", "tu") for b in ("ba", "do", "fe", "gi", "hu", "ja", "ke", "la")]


def changed(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = r.choice(WORDS)
    return out


def roots(nodes, links):
    up = {x: x for x in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {x: top(x) for x in nodes}


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(40)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(90)] + [(1000, 1000 + i) for i in range(1, 40)]
    found = {x.node: x.root for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots({x for e in edges for x in e}, edges)
    assert all(found.get(x, x) == root for x, root in want.items())


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("costly, seed", [(24, 1), (3, 2), (2, 3)])
def test_join_is_brute_force(spark, costly, seed):
    r = random.Random(seed)
    passage = [r.choice(WORDS) for _ in range(55)]
    texts = [None, "", "One Two", "one two", "one  TWO three"]
    for _ in range(6):
        base = [r.choice(WORDS) for _ in range(r.randrange(30, 120))]
        texts += [" ".join(changed(r, base, r.randrange(0, 5))) for _ in range(r.randrange(2, 12))]
    texts += [" ".join(passage + [r.choice(WORDS) for _ in range(r.randrange(0, 40))]) for _ in range(25)]
    texts += [" ".join(r.choice(WORDS) for _ in range(80)) for _ in range(15)] + [texts[8]] * 6
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, key long").repartition(5)
    got = {x.doc_id: x for x in ngram_join.link_groups(docs, params=ngram_join.JoinParams(costly=costly)).collect()}
    sets = [shingle_set(t) for t in texts]
    links = [(a, b) for a, b in combinations(range(len(texts)), 2) if (i := len(sets[a] & sets[b])) and 100 * i >= 75 * len(sets[a] | sets[b])]
    want = roots(range(len(texts)), links)
    assert {i: got[i].component_id for i in want} == want
    assert all(got[i].n_shingles == len(sets[i]) for i in want)


def test_join_nulls_and_none(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other")], "doc_id long, text string")
    got = sorted((repr(x.doc_id), repr(x.component_id)) for x in ngram_join.link_groups(docs).collect())
    assert got == [("4", "4"), ("4", "4"), ("None", "4"), ("None", "None")]
    # One row of each group stays.
    kept = ngram_join.keep_first(docs.withColumn("n", F.lit(1)).withColumn("key", F.lit(2)))
    assert kept.columns == ["doc_id", "text", "n", "key"]
    assert sorted((repr(x.doc_id), x.text) for x in kept.collect()) == [("4", "a b c d e f"), ("None", "other")]
    empty = spark.createDataFrame([(1, ""), (1, ""), (None, None)], "doc_id long, text string")
    assert ngram_join.keep_first(empty).count() == 3 and ngram_join.keep_first(empty.where("false")).count() == 0
    assert ngram_join.link_groups(docs.where("false")).count() == 0


def test_join_different_texts_of_one_id(spark):
    r = random.Random(21)
    docs = []
    for i in range(12):
        base = [r.choice(WORDS) for _ in range(60)]
        docs += [(None, " ".join(base)), (100 + i, " ".join([*base, "one"])), (7, " ".join(["two", *base, "three"]))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = ngram_join.link_groups(df).collect()
    assert len(found) == len(docs) and {x.component_id for x in found} == {7}


def test_whole_sets_meet_only_where_they_can_be_alike(spark):
    """Texts that share a passage only make no pairs; those of a group do, each by few of its many shingles."""
    r = random.Random(31)
    passage, base = ([r.choice(WORDS) + r.choice(WORDS) for _ in range(n)] for n in (30, 200))
    texts = [" ".join(passage + [r.choice(WORDS) + r.choice(WORDS) for _ in range(60)]) for _ in range(20)]
    texts += [" ".join(base + [r.choice(WORDS) + r.choice(WORDS) for _ in range(3)]) for _ in range(6)]
    params = ngram_join.JoinParams()
    rows = ngram_join._texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text")
    shared = ngram_join._shared(ngram_join._shown(rows, params, True), "test-shared")
    costs = ngram_join._costs(shared, params, True, "test-costs")
    key = {ngram_join.set_key(ngram_join.shingles(t.encode())) for t in texts[20:]}
    met = ngram_join._met(ngram_join._able(shared, costs, params), params).collect()
    # Joined by every shingle these would be 190 * 26 and 15 * 196 rows.
    assert {x for m in met for x in (m.key, m.b)} == key and len(met) <= 15 * (196 - 149 + 1)
    assert {(x.a, x.b) for x in ngram_join._whole_pairs(shared, costs, params).collect()} == {(a, b) for a in key for b in key if a < b}


def normal(line):
    line = re.sub(r"[^\w\s]|_", "", line.lower())
    return re.sub(r"[ \t\x0b\x0c\r]+", " ", line).strip(" ")


def within(a, b, most):
    """Whether the edit distance is at most so much: a band of the table, as far as it can still hold."""
    last = {j: j for j in range(min(most, len(b)) + 1)}
    for i, x in enumerate(a, 1):
        row = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            least = min(last.get(j, most) + 1, row.get(j - 1, most) + 1, last[j - 1] + (x != b[j - 1]) if j and j - 1 in last else most + 1)
            if least <= most:
                row[j] = least
        if not row:
            return False
        last = row
    return last.get(len(b), most + 1) <= most


def alike(x, y):
    most = int(0.1 * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most or sum(((Counter(x) - Counter(y)) + (Counter(y) - Counter(x))).values()) > 2 * most:
        return False
    return within(x, y, most)


def brute_lines(docs):
    """The occurrences that go, by edit similarity alone, and those of them that repeat an equal line."""
    places = {}
    for i, t in docs:
        for at, line in enumerate(t.split("\n") if t is not None else []):
            if n := normal(line):
                places.setdefault(n, []).append((i, at))
    root = roots(sorted(places), [(x, y) for x, y in combinations(sorted(places), 2) if alike(x, y)])
    first = {}
    for n, at in places.items():
        first[root[n]] = min(first.get(root[n], at[0]), min(at))
    return {x for n, at in places.items() for x in at if x != first[root[n]]}, {x for at in places.values() for x in at if x != min(at)}


def dropped(docs, rows):
    """The occurrences that went. Every line of the fixtures is marked with its place, so none is taken for another."""
    got = {x.doc_id: x for x in rows}
    gone = set()
    for i, t in docs:
        if t is None:
            assert got[i].text is None
            continue
        left = got[i].text.split("\n") if got[i]._n_dropped < got[i]._n_lines else []
        lines, at = t.split("\n"), 0
        for k, line in enumerate(lines):
            if at < len(left) and left[at] == line:
                at += 1
            else:
                gone.add((i, k))
        assert at == len(left) and got[i]._n_lines == len(lines) and got[i]._n_dropped == len(lines) - at
    return gone


def mixed_lines(seed, n=40):
    r = random.Random(seed)
    base = [[r.choice(WORDS) + r.choice(WORDS) for _ in range(r.randrange(3, 50))] for _ in range(12)]
    docs = []
    for i in range(n):
        lines = []
        for _ in range(r.randrange(0, 5)):
            w = list(r.choice(base))
            for _ in range(r.randrange(0, 1 + len(w) // 12)):
                w[r.randrange(len(w))] = r.choice(WORDS) + r.choice(WORDS)
            lines.append(" ".join(w))
        lines += r.sample(["Same, line here!", "same  line HERE", "", "a b", "A b.", "x", "\t", "…"], 2)
        docs.append((i, "\n".join(dict.fromkeys(lines))))
    return docs + [(50 + n, None), (51 + n, ""), (52 + n, "\n")]


def lines_frame(spark, docs):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, lid long").repartition(4)


@pytest.mark.parametrize("params", [line_dedup.LineParams(), line_dedup.LineParams(crowded=1, broadcast_lines=0)])
def test_lines_are_brute_force(spark, params):
    docs = mixed_lines(4)
    gone, equal = brute_lines(docs)
    rows = line_dedup.dedup(lines_frame(spark, docs), params=params).collect()
    got = dropped(docs, rows)
    assert all(x.lid == 1 for x in rows)
    # What goes is right, all equal lines go, and of those that are only similar at least 0.9 do.
    assert got <= gone and len(gone - equal) > 20
    assert len(got & (gone - equal)) >= 0.9 * len(gone - equal)
    assert equal <= got
    assert line_dedup.dedup(lines_frame(spark, docs).where("false")).count() == 0


def test_lines_meet_by_similarity_alone(spark):
    r = random.Random(12)
    lines = []
    for n in (8, 10, 12, 16, 20, 40, 80) * 6:
        words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(n)]
        other = list(words)
        for k in r.sample(range(n), max(1, n // 20)):
            other[k] = other[k][:-1] + "z"
        lines += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {x.doc_id for x in line_dedup.dedup(df).collect() if x._n_dropped}
    assert all(i % 2 for i in gone) and len(gone) >= 0.9 * len(lines) / 2


def test_lines_meet_without_their_longest_words(spark):
    r = random.Random(21)
    lines = []
    for _ in range(40):
        words = [r.choice(WORDS) + r.choice(WORDS) for _ in range(40)]
        other = list(words)
        for k in r.sample(range(40), 2):
            words[k] += r.choice(WORDS) + r.choice(WORDS)
            other[k] = words[k][:-1] + "z"
        lines += [" ".join(words), " ".join(other)]
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    gone = {x.doc_id for x in line_dedup.dedup(df).collect() if x._n_dropped}
    assert all(i % 2 for i in gone) and len(gone) >= 0.7 * len(lines) / 2


@pytest.mark.parametrize("crowded", [8, 1000])
def test_lines_that_share_a_passage(spark, monkeypatch, crowded):
    """They meet at words of their own first; those that meet in many places are a pair once."""
    r = random.Random(22)
    word = lambda: r.choice(WORDS) + r.choice(WORDS) + r.choice(WORDS)
    passage = [word() for _ in range(40)]
    lines = [" ".join([word() for _ in range(20)] + passage) for _ in range(120)]
    lines += [x[:-3] + "zzz" for x in lines[:10]]
    pairs, verified = [], line_dedup._verified
    monkeypatch.setattr(line_dedup, "_verified", lambda p, *rest: pairs.extend((min(x), max(x)) for x in p.collect()) or verified(p, *rest))
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    rows = line_dedup.dedup(df, params=line_dedup.LineParams(crowded=crowded)).collect()
    assert {x.doc_id for x in rows if x._n_dropped} == set(range(120, 130))
    if crowded == 8:
        assert len(pairs) < 130 * 129 / 2 / 20


def test_edits_in_many_words(spark):
    """Lines with few edits are alike in however many words the edits stand, with as many words in both or not."""
    r = random.Random(17)
    words = [r.choice(WORDS) + r.choice(WORDS) + r.choice(WORDS) for _ in range(40)]
    other = [w[:-1] + "z" if i % 2 else w for i, w in enumerate(words)]
    x = " ".join(words)
    pairs = [(1, x, " ".join(other)), (2, x, " ".join(other[:20]) + " a " + " ".join(other[20:])), (3, x, " ".join(w[:-3] + "zzz" for w in words))]
    assert [alike(a, b) for _, a, b in pairs] == [True, True, False]
    df = spark.createDataFrame(pairs, "n long, x string, y string")
    assert sorted(p.n for p in line_dedup._alike(df, line_dedup.LineParams()).collect()) == [1, 2]


def test_recall_on_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {x.doc_id: x.text for x in docs.select("doc_id", "text").collect()}
    lines = {i: {n for line in (t or "").split("\n") if (n := normal(line))} for i, t in texts.items()}
    every = sorted(set().union(*lines.values()), key=len)
    ask = set().union(*(x for i, x in lines.items() if i % 100 == 0))
    pairs = [(x, y) for x in ask for y in every if x != y and abs(len(x) - len(y)) <= 0.1 * max(len(x), len(y)) and alike(x, y)]
    params = line_dedup.LineParams()
    occurring = line_dedup.staged(line_dedup.lines_of(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "occurring")
    distinct = line_dedup.staged(line_dedup.distinct_lines(occurring, params), "lines")
    groups = line_dedup.line_groups(distinct, occurring, params)
    root = {x.norm: x.root for x in groups.join(occurring.withColumnRenamed("lid", "node"), "node").select("norm", "root").distinct().collect()}
    assert pairs and sum(x in root and root.get(x) == root.get(y) for x, y in pairs) >= 0.9 * len(pairs)


def test_odd_lines(spark):
    unspaced = "一二三四五六七八九十百千万上下左右中大小月日年早木林山川土空田天生花草虫犬人名女男子"
    long = " ".join(f"{a}{b}{i}" for i, (a, b) in enumerate(zip(WORDS * 40, WORDS[::-1] * 40)))
    docs = [(1, unspaced), (2, unspaced[:20] + "石" + unspaced[21:]), (3, unspaced), (4, long), (5, long.replace("7", "8", 3)), (6, "abcdefgh"), (7, "abcdefgi"), (8, " "), (9, "!!!\n!!!")]
    rows = line_dedup.dedup(lines_frame(spark, docs)).collect()
    assert {x.doc_id for x in rows if x._n_dropped} == {2, 3, 5}


def test_lines_of_repeated_ids(spark):
    df = spark.createDataFrame([(None, "one two three"), (3, "one two three\nfour five six"), (3, "one two three\nfour five six")], "doc_id long, text string")
    assert sorted((x.text, x._n_dropped) for x in line_dedup.dedup(df).collect()) == [("four five six", 1), ("four five six", 1), ("one two three", 0)]


ITEM = "Tom has 5 apples and gives 2 apples to Ann, then how many apples are left in his bag of 5 apples?"


def test_held_items(spark):
    again = ITEM.replace("5", "9").replace("2", "4")
    uneven = "Tom has 5 apples and gives 2 apples to Ann, then how many apples are left in his bag of 7 apples?"
    docs = [(1, "Before. " + ITEM.upper().lower() + " After that more."), (2, again), (3, "Nothing of the kind is here, only apples and a bag of other things in a row"), (4, None), (5, ""), (6, ITEM + "\n" + again), (7, "x " * 3000 + ITEM), (None, ITEM), (8, uneven)]
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, item string")
    b = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None)], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.held_items(d, b).collect()}
    assert {1, 2, 6, 7, None} <= set(got) and not {3, 4, 5} & set(got)
    assert got[2].same_values is False and got[7].same_values is True and got[7].first_word in (3000, 3001)
    for n in (0, 500_000):  # shuffled and broadcast
        p = decontaminate.DecontaminationParams(broadcast_windows=n)
        assert {x.doc_id for x in decontaminate.held_items(d, b, p).collect()} == set(got)
    assert {x.doc_id for x in decontaminate.clean(d, b).collect()} == {i for i, _ in docs} - set(got)
    assert decontaminate.held_items(d.where("false"), b).count() == 0 and decontaminate.held_items(d, b.where("false")).count() == 0


def test_verbatim_values(spark):
    series = "Find the next number of the series: " + " ".join(str(3 * i) for i in range(1, 13)) + " and so on"
    cities = "We passed through " + ", ".join("Oslo Bergen Paris London Madrid Rome Vienna Berlin Prague Athens Dublin".split()) + " on the way home"
    sibling = "Find the next number of the series: " + " ".join(str(7 * i) for i in range(1, 13)) + " and so on"
    docs = [(1, series), (2, "Before that. " + cities + " again."), (3, "10 20 30 40 50 60 70 80 90 100 110 120 130 140"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 x " + sibling + " then " + series), (5, "They say the answer is 42 here"), (6, "They say the answer is 43 here")]
    items = [(1, series), (2, cities), (3, "the answer is 42")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.held_items(d, b).collect()}
    assert set(got) == {(1, 1), (2, 2), (4, 1), (5, 3)}
    assert all(x.same_values for x in got.values())
    assert {x.doc_id for x in decontaminate.clean(d, b).collect()} == {3, 6}


def test_rows_of_one_id_are_judged_each(spark):
    for i in (None, 5):
        docs = spark.createDataFrame([(i, ITEM), (i, "a clean text of which nothing is in the benchmark at all")], "doc_id long, text string")
        bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
        assert [x.text[:7] for x in decontaminate.clean(docs, bench).collect()] == ["a clean"]
        rows = [(i, "one two three\nfour five six"), (i, "seven eight nine\nten eleven twelve"), (-(2**62), "four five six")]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        kept = sorted(line for x in line_dedup.dedup(df).collect() for line in x.text.split("\n") if line)
        assert kept == ["four five six", "one two three", "seven eight nine", "ten eleven twelve"]


def test_case_of_copies(spark):
    items = [ITEM, "A train leaves Boston at 9 am and drives 60 km an hour, when does it get to Chicago that is 300 km away?"]
    docs = []
    for i, x in enumerate(items):
        title = " ".join(w[:1].upper() + w[1:] for w in x.split())
        docs += [(10 * i + k, "Some words before. " + t + " And some after it.") for k, t in enumerate([x, x.upper(), title, x.lower()])]
    docs.append((99, "Here Are Many Words In Title Case That Are In No Item Of The Benchmark At All, Though They Go On"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontaminate.held_items(d, b).collect()} == {(10 * i + k, i) for i in range(2) for k in range(4)}


def test_long_runs(spark):
    """A text of capitalised words only and a list of numbers without a blank, both very long, hold what stands in them."""
    item = "the first printed almanac of the northern islands was sold to travellers at the harbour"
    titled = " ".join(f"Word{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(30_000))
    listed = ",".join(map(str, range(30_000)))
    docs = [(1, f"{titled} {item.title()}"), (2, f"{listed} {item}"), (3, titled), (4, listed)]
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(x.doc_id for x in decontaminate.held_items(d, b).collect()) == [1, 2]


def plain_windows(text, size=8):
    words = re.sub(r"[^\w\s]|_", "", text.lower()).split()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def test_plain_texts_are_brute_force(spark):
    r = random.Random(9)
    items = [" ".join(r.choice(WORDS) for _ in range(r.randrange(10, 40))) for _ in range(8)]
    docs = [" ".join([r.choice(WORDS) for _ in range(20)] + changed(r, r.choice(items).split(), r.randrange(0, 4)) + [r.choice(WORDS) for _ in range(10)]) for _ in range(40)]
    found = decontaminate.held_items(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    want = set()
    for i, t in enumerate(docs):
        for k, x in enumerate(items):
            w = plain_windows(x)
            n = len(w & plain_windows(t))
            if n and (n >= 13 or n >= 0.5 * len(w)):
                want.add((i, k, n))
    assert {(x.doc_id, x.item_id, x.n_found) for x in found.collect()} == want
