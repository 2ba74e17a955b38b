"""Language identification: script ranges, per-word scores, Viterbi with a switching penalty.

A model holds, for each language, logarithms of the shares of hashed character n-grams
and of the scripts of its letters. A word is scored for those languages that use its
script; a path over the words may change language at a fixed cost, which labels spans
of mixed text. The document's language has most letters on the path; its score is the
share of all letters that it has, where letters of words in a script that no learned
language uses are nobody's: a text of nothing else has score 0.

Null texts, texts without a letter and any text without a learned language are ``und``
with score 0 and no spans. Rows are judged one by one. Other columns pass through
:func:`identify`; one named like its result is replaced. Ties go to the language that
comes first in the alphabet.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ranges of code points by script.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F),),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F)),
    "devanagari": ((0x900, 0x97F),),
    "bengali": ((0x980, 0x9FF),),
    "tamil": ((0xB80, 0xBFF),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF),),
    "hangul": ((0x1100, 0x11FF), (0xAC00, 0xD7AF)),
    "kana": ((0x3040, 0x30FF),),
    "han": ((0x3400, 0x4DBF), (0x4E00, 0x9FFF)),
}
OTHER = len(SCRIPTS)
BUCKETS = 1 << 15
#: The least score of a word for a language, against its best one.
FLOOR = -25.0
#: Words counted or scored at a time in a worker before its memory starts anew.
REMEMBERED = 200_000


_EDGES = sorted((a, b, i) for i, ranges in enumerate(SCRIPTS.values()) for a, b in ranges)
_FROM, _TO, _SCRIPT = (np.array(x) for x in zip(*_EDGES))


def scripts_of(points: np.ndarray) -> np.ndarray:
    """The script of each code point."""
    at = np.maximum(np.searchsorted(_FROM, points, side="right") - 1, 0)
    return np.where((points >= _FROM[at]) & (points <= _TO[at]), _SCRIPT[at], OTHER)


def letters_of(word: bytes) -> str:
    w = word.decode()
    return (w if w.isalpha() else "".join(filter(str.isalpha, w))).lower()


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of letters: word numbers and buckets of their n-grams of one to four characters with edges, and each word's script (of its first letter)."""
    points = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), lengths)
    numbers, buckets, h = [], [], np.zeros(len(points), np.uint64)
    for n in range(1, 5):
        m = len(points) - n + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0x9E3779B97F4A7C15) + points[n - 1 :]
        inside = word[:m] == word[n - 1 :]
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
        numbers.append(word[:m][inside])
        buckets.append(((mixed >> np.uint64(32)) % np.uint64(BUCKETS)).astype(np.int64)[inside])
    firsts = points[np.minimum(np.cumsum(lengths) - lengths + 1, max(len(points) - 1, 0))] if len(points) else points
    return np.concatenate(numbers or [word]), np.concatenate(buckets or [word]), scripts_of(firsts.astype(np.int64))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    shares: np.ndarray  # languages x BUCKETS, logarithms
    scripts: np.ndarray  # languages x scripts, whether the language uses it


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    words: dict[str, Counter] = defaultdict(Counter)

    def flush() -> None:
        for lang, found in words.items():
            into = sums.setdefault(lang, np.zeros(BUCKETS + OTHER + 1, np.int64))
            plain = Counter()
            for w, n in found.items():
                if letters := letters_of(w):
                    plain[letters] += n
            if plain:
                times = np.fromiter(plain.values(), np.int64, len(plain))
                number, bucket, script = grams(list(plain))
                np.add.at(into, bucket, times[number])
                np.add.at(into, BUCKETS + script, times * np.fromiter(map(len, plain), np.int64, len(plain)))
        words.clear()

    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
            words[lang].update(text.as_py().encode().split())
            if sum(map(len, words.values())) > REMEMBERED:
                flush()
    flush()
    for lang, into in sums.items():
        at = np.flatnonzero(into)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(into[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", least_script_share: float = 0.005) -> Model:
    """Counts over all given rows with a text and a language. What reaches the driver is a fixed number of counts for each language."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text), F.col(lang))
    counted = labelled.mapInArrow(_counts, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(set(counted["lang"])))
    table = np.zeros((len(languages), BUCKETS + OTHER + 1))
    for i, x in enumerate(languages):
        own = counted[counted["lang"] == x]
        table[i, own["bucket"].to_numpy()] = own["n"].to_numpy()
    shares = np.log((table[:, :BUCKETS] + 0.1) / (table[:, :BUCKETS].sum(1, keepdims=True) + 0.1 * BUCKETS)).astype(np.float32)
    scripts = table[:, BUCKETS:]
    return Model(languages, shares, scripts >= least_script_share * np.maximum(scripts.sum(1, keepdims=True), 1))


class _Words(dict):
    """UTF-8 word -> row of scores. New words get the next rows; :meth:`settle` scores them together."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new = model, []
        self.scores = np.zeros((0, len(model.languages)), np.float32)
        self.letters = np.zeros(0, np.int64)
        self.known = np.zeros(0, np.int64)  # letters of words in a script that some language uses

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        self[word] = row = len(self)
        return row

    def rows(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def settle(self) -> None:
        plain = [letters_of(w) for w in self.new]
        number, bucket, script = grams(plain)
        sums = np.stack([np.bincount(number, row[bucket], len(plain)) for row in self.model.shares], 1)
        own = np.maximum(sums - sums.max(1, keepdims=True), FLOOR)
        uses = self.model.scripts[:, script].T
        letters = np.fromiter(map(len, plain), np.int64, len(plain))
        own = np.where(uses, own, FLOOR)
        own[(letters == 0) | ~uses.any(1)] = 0
        self.scores = np.concatenate([self.scores, own.astype(np.float32)])
        self.letters = np.concatenate([self.letters, letters])
        self.known = np.concatenate([self.known, np.where(uses.any(1), letters, 0)])
        self.new = []


def constant(scores: np.ndarray, penalty: float) -> int:
    """The language of the whole text if no change within it can pay, else -1.

    Against the best single language, let g be each word's best gain by another. A stay in
    other languages gains at most the sum of g over it, and costs two changes, or one at an
    end of the text.
    """
    best = int(scores.sum(0, dtype=np.float64).argmax())
    if scores.shape[1] == 1:
        return best
    g = np.delete(scores, best, 1).max(1) - scores[:, best]
    upto = np.concatenate([[0.0], np.cumsum(g, dtype=np.float64)])
    if upto.max() > penalty or upto[-1] - upto.min() > penalty or (upto - np.minimum.accumulate(upto)).max() > 2 * penalty:
        return -1
    return best


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best path for texts x words x languages (all padded to one length with zeros): texts x words."""
    d, n, k = scores.shape
    back = np.empty((n, d, k), np.uint8)
    own = np.arange(k, dtype=np.uint8)[None, :]
    v = scores[:, 0].astype(np.float64)
    for t in range(1, n):
        to = v.argmax(1)
        best = v[np.arange(d), to] - penalty
        change = best[:, None] > v
        back[t] = np.where(change, to[:, None], own)
        v = np.where(change, best[:, None], v) + scores[:, t]
    path = np.empty((d, n), np.uint8)
    path[:, -1] = v.argmax(1)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[t, np.arange(d), path[:, t]]
    return path


def _chunks(lengths: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    order, at = np.argsort(lengths, kind="stable"), 0
    order = order[lengths[order] > 0]
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * lengths[order[end]] <= cells:
            end += 1
        yield order[at:end]
        at = end


def identify(docs: DataFrame, model: Model, text: str = "text", penalty: float = 12.0, spans: bool = True, result: str = "language", cells: int = 500_000) -> DataFrame:
    """Adds a struct: lang, score and, if asked for, spans (first and last word, counted from 0, and language)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: BUCKETS numbers for each language
    kind = "lang string, score double" + ", spans array<struct<first: int, last: int, lang: string>>" * spans

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        languages, known = np.array(m.languages, object), None
        for texts in batches:
            n = len(texts)
            langs, score, found = np.full(n, "und", object), np.zeros(n), [[] for _ in range(n)]
            for start in range(0, n if len(languages) else 0, 2048):
                if known is None or len(known) > REMEMBERED:
                    known = _Words(m)
                rows = [known.rows((t or "").encode().split()) for t in texts[start : start + 2048]]
                if known.new:
                    known.settle()
                paths: dict[int, np.ndarray | int] = {i: constant(known.scores[r], penalty) for i, r in enumerate(rows) if len(r)}
                mixed = np.array([len(r) if len(r) and paths[i] == -1 else 0 for i, r in enumerate(rows)])
                for group in _chunks(mixed, cells):
                    padded = np.zeros((len(group), mixed[group].max(), len(languages)), np.float32)
                    for j, i in enumerate(group):
                        padded[j, : len(rows[i])] = known.scores[rows[i]]
                    for i, path in zip(group, viterbi(padded, penalty)):
                        paths[i] = path[: len(rows[i])]
                for i, p in paths.items():
                    if total := known.letters[rows[i]].sum():
                        whole, own = not isinstance(p, np.ndarray), known.known[rows[i]]
                        by = np.array([own.sum()]) if whole else np.bincount(p, own, len(languages))
                        langs[start + i], score[start + i] = languages[p if whole else by.argmax()], by.max() / total
                        if spans:
                            cut = [] if whole else np.flatnonzero(np.diff(p)) + 1
                            found[start + i] = [(int(a), int(b) - 1, languages[p if whole else p[a]]) for a, b in zip([0, *cut], [*cut, len(own)])]
            out = {"lang": langs, "score": score}
            yield pd.DataFrame(out | ({"spans": [[dict(zip(("first", "last", "lang"), s)) for s in x] for x in found]} if spans else {}))

    return docs.withColumn(result, run(F.col(text)))


def held_out(id: Column) -> Column:
    """A third of the ids, by their CRC-32 as text."""
    return F.crc32(id.cast("string").cast("binary")) % 3 == 1
