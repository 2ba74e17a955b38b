"""K-best parses of one string over a lattice of labelled spans, in plain Python."""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from ..config import Config
from .chars import LEET_FROM, LEET_TO
from .numbers import label_text
from .patterns import coarse, related, term_spans

# Chances of labels, and the factors on whole paths.
NAME, WORD, SYLLABLE, LETTER, UNKNOWN, LONE = 0.25, 0.20, 0.10, 0.08, 0.03, 1e-8
FORM_CHANCES = {"cn_name_full": 0.25, "cn_name_given": 0.18, "cn_name_last_abbr": 0.1, "cn_name_abbr": 0.18, "cn_name_first_last": 0.15, "cn_name_last_full": 0.25}
SPLIT, KINDS, MIXED, WORD_OF_2, WORD_OF_3 = 0.85, 0.90, 0.50, 0.50, 0.75
LEET = str.maketrans(LEET_FROM, LEET_TO)


@dataclass(frozen=True)
class Terms:
    """Dictionaries, all in lower case. forms: label -> terms."""

    names: frozenset[str] = frozenset()
    words: frozenset[str] = frozenset()
    forms: dict[str, frozenset[str]] = field(default_factory=dict)
    syllables: frozenset[str] = frozenset()
    #: Names with separators in them (term -> label), for the coarse pass.
    joined: dict[str, str] = field(default_factory=dict)

    @functools.cached_property
    def longest(self) -> int:
        return max((len(t) for s in (self.names, self.words, self.syllables, *self.forms.values()) for t in s), default=0)


#: start, end (after the last), label, logarithm of the chance
Span = tuple[int, int, str, float]


def _substrings(text: str, longest: int) -> Iterator[tuple[int, int, str]]:
    for i in range(len(text)):
        for j in range(i + 1, min(len(text), i + longest) + 1):
            yield i, j, text[i:j]


def dictionary_spans(text: str, terms: Terms) -> Iterator[Span]:
    low = text.lower()
    for i, j, t in _substrings(low, terms.longest):
        if t in terms.names:
            yield i, j, "en_name", math.log(NAME)
        elif t in terms.words:
            yield i, j, "en_word", math.log(WORD)


longest_matches = term_spans


# What forms of some lengths lose.
def _form_factor(label: str, n: int) -> float:
    if label in ("cn_name_full", "cn_name_first_last"):
        return 0.5 if n < 5 else 1.0
    if label == "cn_name_given":
        return {1: 0.5, 2: 0.5, 3: 0.75}.get(n, 1.0)
    if label == "cn_name_abbr":
        return 0.25 if n > 5 else 1.0 if n == 3 else 0.5
    return {1: 0.20, 2: 0.75}.get(n, 1.0) if label == "cn_name_last_full" else 1.0


def form_spans(text: str, terms: Terms) -> Iterator[Span]:
    for label, known in terms.forms.items():
        for i, j in longest_matches(text, known):
            yield i, j, label, math.log(FORM_CHANCES.get(label, LONE) * _form_factor(label, j - i))


def syllable_spans(text: str, terms: Terms) -> Iterator[Span]:
    low, i, longest = text.lower(), 0, max(map(len, terms.syllables), default=0)
    while i < len(low):
        j = next((j for j in range(min(len(low), i + longest), i, -1) if low[i:j] in terms.syllables), i)
        yield (i, j, "py", math.log(SYLLABLE)) if j > i else (i, i + 1, "nn", math.log(LETTER))
        i = max(j, i + 1)


def unknown_span(text: str, terms: Terms) -> Iterator[Span]:
    if len(text) >= 2:
        yield 0, len(text), "unk_seg", math.log(max(UNKNOWN * math.exp(-0.10 * (len(text) - 1)), 1e-12))


DETECTORS: tuple[Callable[[str, Terms], Iterator[Span]], ...] = (dictionary_spans, form_spans, syllable_spans, unknown_span)


def lattice(text: str, terms: Terms, detectors=DETECTORS) -> list[list[Span]]:
    """Spans by their start; each place has one of a single character."""
    by: list[list[Span]] = [[] for _ in text]
    for detect in detectors:
        for span in detect(text, terms):
            by[span[0]].append(span)
    for i, spans in enumerate(by):
        if all(j != i + 1 for _, j, _, _ in spans):
            spans.append((i, i + 1, "nn_char", math.log(LONE)))
    return by


def k_best(by: list[list[Span]], k: int) -> list[tuple[float, list[Span]]]:
    """The k best paths through a lattice; equal ones in a fixed order."""
    # A path is (score, its last span, the path before); spans are compared only between equal scores.
    best: list[list[tuple]] = [[] for _ in range(len(by) + 1)]
    best[0] = [(0.0, (), None)]
    for i, spans in enumerate(by):
        if len(best[i]) > 1:
            best[i] = sorted(best[i], key=_path_order)[:k]
        for span in spans:
            best[span[1]] += [(path[0] - span[3], span[:3], path) for path in best[i]]
    logs = {span[:3]: span for spans in by for span in spans}
    out = []
    for path in sorted(best[-1], key=_path_order)[:k]:
        score, spans = -path[0], []
        while path[2] is not None:
            spans.append(logs[path[1]])
            path = path[2]
        out.append((score, spans[::-1]))
    return out


def _path_order(path: tuple) -> tuple:
    return path[:2]


def _kind(label: str) -> str:
    return "en" if label.startswith("en_") else "cn" if label.startswith("cn_name") else {"py": "py", "unk_seg": "unk"}.get(label, "nn")


def penalty(path: list[Span]) -> float:
    """What a whole path pays for many spans, several kinds, mixed name forms and short words."""
    labels = [s[2] for s in path]
    out = (len(path) - 1) * math.log(SPLIT) + (len({_kind(x) for x in labels}) - 1) * math.log(KINDS)
    forms = [x for x in labels if x.startswith("cn_name")]
    if len(forms) >= 2 and len(set(forms)) >= 2:
        out += math.log(MIXED)
    for i, j, label, _ in path:
        if label == "en_word":
            out += math.log({2: WORD_OF_2, 3: WORD_OF_3}.get(j - i, 1.0))
    return out


Path = tuple[list[tuple[str, str]], float]


def letter_branches(text: str, terms: Terms, k: int, detectors=DETECTORS) -> list[Path]:
    paths = [([(text[i:j], label) for i, j, label, _ in path], p + penalty(path)) for p, path in k_best(lattice(text, terms, detectors), k)]
    return sorted(paths, key=lambda x: -x[1])


def branches(segments: list[tuple[str, str]], terms: Terms, k: int, detectors=DETECTORS) -> list[list[Path]]:
    """For each segment its parses."""
    out: list[list[Path]] = []
    for text, label in segments:
        if label == "L":
            out.append(letter_branches(text, terms, k, detectors))
        elif label == "D":
            found = label_text(text) if text.isascii() else [(f"number{len(text)}", 1.0)]
            out.append([([(text, x)], math.log(p)) for x, p in found])
        else:
            out.append([([(text, f"spec{len(text)}" if label == "S" else label)], 0.0)])
    return out


def expand(groups: list[list[Path]], limit: int) -> list[Path]:
    """Combinations of one parse from each group, the best ``limit`` at each step."""
    paths: list[Path] = [([], 0.0)]
    for group in groups:
        paths = sorted((([*a, *b], p + q) for a, p in paths for b, q in group), key=lambda x: -x[1])[:limit]
    return paths


def merged_label(text: str, terms: Terms) -> str | None:
    low = text.lower()
    mapped = low.translate(LEET)
    if mapped != low and len(text) >= 4 and (mapped in terms.names or mapped in terms.words):
        return "leet"
    return "en_name" if low in terms.names else "en_word" if low in terms.words else None


def merge(segments: list[tuple[str, str]], terms: Terms) -> list[tuple[str, str]]:
    """The fewest segments when neighbours may join to a term; of equal numbers, the one that joins least."""
    n, longest = len(segments), terms.longest
    best: list[list[tuple[str, str]]] = [[] for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        best[i] = [segments[i], *best[i + 1]]
        text = segments[i][0]
        for j in range(i + 1, n):
            text += segments[j][0]
            if len(text) > longest:
                break
            if len(best[j + 1]) + 1 < len(best[i]) and (label := merged_label(text, terms)):
                best[i] = [(text, label), *best[j + 1]]
    return best[0]


def posteriors(logs: list[float], temperature: float, least: float, most: int) -> list[tuple[int, float]]:
    """(place, weight) of the parses kept; none if no parse reaches the least posterior."""
    if not logs:
        return []
    top = max(logs)
    e = [math.exp((x - top) * temperature) for x in logs]
    kept = sorted(((i, x / sum(e)) for i, x in enumerate(e) if x / sum(e) >= least), key=lambda x: -x[1])[:most]
    total = sum(w for _, w in kept)
    return [(i, w / total) for i, w in kept]


def parse(value: str, terms: Terms, config: Config = Config(), key: str | None = None, detectors=DETECTORS) -> list[tuple[list[tuple[str, str]], float, float]]:
    """The parses of a value that count: segments, logarithm of the score, weight."""
    segments = related(key, value, terms.joined) if key else coarse(value, terms.joined)
    paths = [(merge(s, terms), p) for s, p in expand(branches(segments, terms, config.k_best, detectors), config.expand_limit)]
    paths = sorted(paths, key=lambda x: -x[1])[: config.merged_limit]
    kept = posteriors([p for _, p in paths], config.temperature, config.least_posterior, config.most_paths)
    return [(*paths[i], w) for i, w in kept]
