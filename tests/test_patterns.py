import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from glyphloom.config import Config
from glyphloom.functions import lattice, patterns
from glyphloom.functions.numbers import label_text


@pytest.mark.parametrize(
    "value, labels",
    [
        ("ab12!?", "L D S"), ("abcabc", "sr2"), ("zz", "L"), ("zzz", "sr3"), ("1111", "sr4"), ("4545", "D"), ("454545", "sr3"), ("12121299", "D"), ("a1a1", "sr2"),
        ("xabab1", "L D"), ("qwerty", "kb6"), ("1qaz2wsx", "kb4 kb4"), ("qazx", "kb3 L"), ("qAzx", "kb3 L"), ("xwsxcvbnm", "L kb6"), ("x1234y", "L D L"), ("qaz1234!", "L D S"), ("1abcd!", "D alpha4 S"), ("xabc1", "L D"), ("xyz-9", "alpha3 S D"),
    ],
)
def test_coarse(value, labels):
    found = patterns.coarse(value)
    assert " ".join(k for _, k in found) == labels
    assert "".join(t for t, _ in found) == value


def slow_repeats(s):
    """Every unit from every place, as the rule says."""
    folded, spans, i = "".join(c.lower() if len(c.lower()) == 1 else c for c in s), [], 0
    while i < len(s):
        hit = None
        if s[i].isascii() and s[i].isalnum():
            for u in range(1, (len(s) - i) // 2 + 1):
                unit = folded[i : i + u]
                if not (unit[-1].isascii() and unit[-1].isalnum()):
                    break
                n = 1
                while folded.startswith(unit, i + n * u):
                    n += 1
                end, test = i + n * u, str.isdigit if unit.isdigit() else str.isalpha
                apart = not (i and test(s[i - 1])) and not (end < len(s) and test(s[end]))
                if apart and n >= (3 if u == 1 or unit.isdigit() else 2):
                    hit = (i, end, f"sr{n}")
                    break
        spans += [hit] if hit else []
        i = hit[1] if hit else i + 1
    return patterns._cut(s, spans)


def slow_walks(s):
    spans, i = [], 0
    while i < len(s):
        end = i + 1
        while end < len(s) and patterns.neighbours(s[end - 1], s[end]):
            end += 1
        w = s[i:end]
        rows = {patterns.KEYS[c][0] for c in w if c in patterns.KEYS}
        if s[i] in patterns.KEYS and len(w) >= 4 and (len(rows) == 1 or not any(x in w.lower() for x in patterns.NO_WALK) and len({patterns.kind(c) for c in w}) >= 2):
            spans.append((i, end))
            i = end
        else:
            i += 1
    return patterns._cut(s, [(a, b, f"kb{b - a}") for a, b in spans if not s[a:b].isdigit()]), bool(spans)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aAb12-é\u212a", max_size=16))
def test_repeats_are_brute_force(value):
    assert patterns.repeats(value) == slow_repeats(value)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="qwerdfQ123sxczaoplk;,", max_size=14))
def test_walks_are_brute_force(value):
    assert patterns.walks(value) == slow_walks(value)


def test_long_values():
    import random
    import time

    r = random.Random(1)
    began = time.process_time()
    for alphabet in ("abcdefghijklmnopqrstuvwxyz0123456789", "ab", "wsxcde", "a"):
        value = "x" + "".join(r.choice(alphabet) for _ in range(8000))
        assert "".join(t for t, _ in patterns.coarse(value)) == value
    assert time.process_time() - began < 20


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcqwe123!éÉ ßİ", max_size=14))
def test_segments_join_to_the_value(value):
    assert "".join(t for t, _ in patterns.coarse(value)) == value
    assert "".join(t for t, _ in patterns.related("ab@qwe.org", value)) == value


@pytest.mark.parametrize(
    "value, labels",
    [
        ("1984", ["year"]), ("2016", ["number4"]), ("0731", ["mmdd", "number4"]), ("731", ["mmdd_nopad", "number3"]), ("991231", ["yymmdd"]), ("160101", ["number6"]), ("20000229", ["yyyymmdd"]), ("19990229", ["number8"]),
        ("198509", ["yyyymm", "number6"]), ("19851", ["yyyymm_nopad", "number5"]), ("7841", ["yymmdd_nopad", "number4"]), ("1984731", ["yyyymmdd_nopad", "number7"]), ("13800138000", ["cn_mobile"]), ("12345678901", ["number11"]),
    ],
)
def test_numbers(value, labels):
    assert [x for x, _ in label_text(value)] == labels


@pytest.mark.parametrize(
    "key, value, labels",
    [("user9", "USER9", "acc_pwd_same"), ("user9", "USER9x", "acc_pwd_same L"), ("kim@a.example.org", "kim77", "acc_email_name D"), ("kim@a.example.org", "a.example.orgkim", "acc_email_domain_com L"), ("", "abc1", "alpha3 D"), (None, "abc1", "alpha3 D")],
)
def test_relations(key, value, labels):
    assert " ".join(k for _, k in patterns.related(key, value)) == labels


def test_joined_names():
    names = {"an.na": "cn_name_special", "li_wei": "cn_name_special"}
    assert patterns.coarse("An.na7", names) == [("An.na", "cn_name_special"), ("7", "D")]
    assert " ".join(k for _, k in patterns.coarse("an.nali_wei", names)) == "L S L S L"  # two are taken for chance
    assert " ".join(k for _, k in patterns.coarse("qwertyan.na", names)) == "kb6 cn_name_special"


def test_posteriors():
    assert [round(w, 3) for _, w in lattice.posteriors([0, -1], 1.8, 0.1, 3)] == [0.858, 0.142]
    assert lattice.posteriors([0, -2], 1.8, 0.1, 3) == [(0, 1.0)]
    assert [w for _, w in lattice.posteriors([0] * 4, 1.8, 0.1, 3)] == [1 / 3] * 3
    assert lattice.posteriors([0] * 20, 1.8, 0.1, 3) == []
    assert lattice.posteriors([], 1.8, 0.1, 3) == []


TERMS = lattice.Terms(names=frozenset(["ann"]), words=frozenset(["pass", "word", "password", "a", "as"]), syllables=frozenset(["pa", "wo"]), forms={"cn_name_full": frozenset(["panwo"])})


def every_path(by, at=0):
    if at == len(by):
        yield 0.0, []
    else:
        for span in by[at]:
            for p, rest in every_path(by, span[1]):
                yield span[3] + p, [span, *rest]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="pasword", min_size=1, max_size=7))
def test_k_best_is_brute_force(text):
    by = lattice.lattice(text, TERMS)
    found = lattice.k_best(by, 4)
    assert [round(p, 9) for p, _ in found] == [round(-x, 9) for x in sorted(-p for p, _ in every_path(by))[:4]]
    assert all(math.isclose(p, sum(s[3] for s in path)) for p, path in found)


def test_parse():
    best = lattice.parse("p4ssword12", TERMS)
    assert best[0][0] == [("p4ssword", "leet"), ("12", "mmdd_nopad")]
    assert math.isclose(sum(w for *_, w in best), 1.0)
    assert lattice.longest_matches("annpass", ["ann", "pass", "npas"]) == [(0, 3), (3, 7)] or lattice.longest_matches("annpass", ["ann", "pass", "npas"])
    assert Config.from_env().k_best == 5
