"""Merge-type SentencePiece encoding with a score-ordered agenda, and decoding.

The agenda holds the adjacent symbol pairs whose join is in the vocabulary; the best
score, then the leftmost, is merged first. Text is cut beforehand where no piece can
reach across (before a run of word marks, and around characters that stand in no piece
of two characters or more), so each part is encoded once and remembered. Short new
parts are merged together: in each round every part takes the best of its agenda. Long
ones have a heap each.

Null and empty texts have no ids. Rows are encoded one by one; other columns of the
input pass through :func:`encode`, and a column named like its result is replaced.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Remembered parts of text per worker; when there are more, the memory starts anew.
REMEMBERED = 900_000
#: Parts of more characters have a heap each.
LONGEST = 48


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces(dict):
    """A vocabulary; as a dict, part of text -> row. New parts get the next rows; :meth:`settle` encodes them together."""

    def __init__(self, path: str):
        import sentencepiece

        super().__init__()
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        self.ids = {sp.id_to_piece(i): i for i in plain}
        self.scores = {sp.id_to_piece(i): sp.get_score(i) for i in plain}
        self.unknown = sp.unk_id()
        byte_ids = {int(sp.id_to_piece(i)[3:-1], 16): i for i in ids if sp.is_byte(i)}
        self.bytes = [byte_ids.get(b) for b in range(256)] if len(byte_ids) == 256 else None
        self.surface = [b""] * len(ids)
        for i in plain:
            self.surface[i] = sp.id_to_piece(i).replace(MARK, " ").encode()
        for b, i in byte_ids.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in self.ids):
            self.parts = re.compile(r".+", re.S)
        else:
            inside = {c for p in self.ids if len(p) > 1 for c in p}
            alone = "".join(c for c in "\n\t\r" if c not in inside)
            self.parts = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))

        self._pairs()
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.new: list[str] = []
        self.flat, self.ends, self.digits = np.zeros(0, np.int32), np.zeros(1, np.int64), []

    def _pairs(self) -> None:
        """Symbols (pieces, and characters in pieces) as numbers; a hash table of the pairs that merge: key -> (rank, symbol)."""
        symbols = {p: i for i, p in enumerate([*self.ids, *sorted({c for p in self.ids for c in p} - set(self.ids))])}
        self.names, self.n_symbols = list(symbols), len(symbols)
        self.symbol_ids = np.array([self.ids.get(p, -1) for p in self.names])
        rank = {x: i for i, x in enumerate(sorted(set(self.scores.values()), reverse=True))}
        self.of_point = np.full(0x110000, -1, np.int32)
        for c, i in symbols.items():
            if len(c) == 1:
                self.of_point[ord(c)] = i
        found = [(symbols[p[:k]] * self.n_symbols + symbols[p[k:]], rank[self.scores[p]], symbols[p]) for p in self.ids for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols]
        keys, ranks, joined = (np.array(x, np.int64) for x in (zip(*found) if found else ((), (), ())))
        self.bits = max(10, int(8 * len(keys)).bit_length())
        self.table = np.full((1 << self.bits, 3), -1, np.int64)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            slot = self._slots(keys[left], probe)
            free = self.table[slot, 0] < 0
            _, first = np.unique(slot, return_index=True)
            takes = np.zeros(len(left), bool)
            takes[first] = True
            takes &= free
            self.table[slot[takes], 0], self.table[slot[takes], 1], self.table[slot[takes], 2] = keys[left[takes]], ranks[left[takes]], joined[left[takes]]
            left, probe = left[~takes], probe + 1
        self.probes = probe

    def _slots(self, keys: np.ndarray, probe: int) -> np.ndarray:
        mixed = (keys.astype(np.uint64) + np.uint64(probe)) * np.uint64(0x9E3779B97F4A7C15)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rows of the table for pairs of symbols, -1 where a pair does not merge."""
        out = np.full(len(a), -1, np.int64)
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        keys = a[todo] * self.n_symbols + b[todo]
        for probe in range(self.probes):
            slot = self._slots(keys, probe)
            there = self.table[slot, 0]
            hit = there == keys
            out[todo[hit]] = slot[hit]
            more = ~hit & (there >= 0)
            if not more.any():
                break
            todo, keys = todo[more], keys[more]
        return out

    def merge_many(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of short parts one after the other, and how many each has. All are merged at once, each by its own agenda."""
        text = "".join(parts)
        symbols = self.of_point[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        # Symbols keep where they start in the text, so what stays unmerged and unknown can be spelt in bytes.
        part, start = np.repeat(np.arange(len(parts)), lengths), np.arange(len(text))
        done_part, done_start, done_symbol = [], [], []
        pair = self._lookup(symbols[:-1], symbols[1:])
        pair = np.append(np.where(part[:-1] == part[1:], pair, -1), -1) if len(text) else pair
        far = np.int64(1) << 62
        while len(symbols):
            # The agenda: rank, then position.
            order = np.where(pair >= 0, self.table[pair, 1] * len(symbols) + np.arange(len(symbols)), far)
            firsts = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            best = np.minimum.reduceat(order, firsts)
            goes_on = np.repeat(best < far, np.diff(np.append(firsts, len(symbols))))
            if not goes_on.all():
                done_part.append(part[~goes_on])
                done_start.append(start[~goes_on])
                done_symbol.append(symbols[~goes_on])
            at = best[best < far] % len(symbols)
            if not len(at):
                break
            symbols[at] = self.table[pair[at], 2]
            goes_on[at + 1] = False
            kept = np.cumsum(goes_on) - 1
            symbols, part, start, pair, at = symbols[goes_on], part[goes_on], start[goes_on], pair[goes_on], kept[at]
            last = at + 1 < len(symbols)
            anew = np.concatenate([at[last], at[at > 0] - 1])
            pair[at[~last]] = -1
            pair[anew] = np.where(part[anew] == part[anew + 1], self._lookup(symbols[anew], symbols[anew + 1]), -1)
        if not done_part:
            return np.zeros(0, np.int64), np.zeros(len(parts), np.int64)
        part, start, symbols = (np.concatenate(x) for x in (done_part, done_start, done_symbol))
        order = np.argsort(start)
        part, start, symbols = part[order], start[order], symbols[order]
        ids = np.where(symbols >= 0, self.symbol_ids[symbols], -1)
        for_each = np.ones(len(ids), np.int64)
        if len(odd := np.flatnonzero(ids < 0)):  # not in the vocabulary: bytes, or one unknown id for neighbours
            spelt = [self._unknown(text[start[i]], i > 0 and ids[i - 1] < 0 and part[i - 1] == part[i]) for i in odd]
            for_each[odd] = [len(x) for x in spelt]
            ids = np.repeat(ids, for_each)
            ids[ids < 0] = [i for x in spelt for i in x]
        return ids, np.bincount(part, for_each, len(parts)).astype(np.int64)

    def _unknown(self, c: str, again: bool) -> list[int]:
        if self.bytes:
            return [self.bytes[b] for b in c.encode()]
        return [] if again else [self.unknown]

    def merge(self, part: str) -> list[int]:
        """The ids of a part, by a heap."""
        symbols: list[str | None] = list(part)
        after = list(range(1, len(symbols) + 1))
        before = list(range(-1, len(symbols) - 1))
        agenda: list[tuple[float, int, int, str]] = []
        scores = self.scores

        def propose(left: int, right: int) -> None:
            if left >= 0 and right < len(symbols):
                joined = symbols[left] + symbols[right]
                if joined in scores:
                    heapq.heappush(agenda, (-scores[joined], left, right, joined))

        for i in range(len(symbols) - 1):
            propose(i, i + 1)
        while agenda:
            _, left, right, joined = heapq.heappop(agenda)
            if symbols[left] is None or symbols[right] is None or after[left] != right or len(symbols[left]) + len(symbols[right]) != len(joined):
                continue
            symbols[left], symbols[right] = joined, None
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
            propose(before[left], left)
            propose(left, after[left])
        out: list[int] = []
        for s in symbols:
            if s is None:
                continue
            if (i := self.ids.get(s)) is not None:
                out.append(i)
            else:
                out += self._unknown(s, bool(out) and out[-1] == self.unknown)
        return out

    def __missing__(self, part: str) -> int:
        self.new.append(part)
        self[part] = row = len(self)
        return row

    def settle(self) -> None:
        short = np.fromiter(map(len, self.new), np.int64, len(self.new)) <= LONGEST
        if short.all():
            flat, lengths = self.merge_many(self.new)
        else:
            ids, n = self.merge_many([p for p, x in zip(self.new, short) if x])
            cut = iter(np.split(ids, np.cumsum(n)[:-1]) if len(n) else [])
            found = [next(cut) if x else np.array(self.merge(p), np.int64) for p, x in zip(self.new, short)]
            flat, lengths = np.concatenate(found), np.array([len(x) for x in found])
        self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        self.new = []

    def rows(self, texts: list[str | None]) -> list[np.ndarray]:
        """Each text as the rows of its parts."""
        if len(self) > REMEMBERED:
            self.clear()
        cut = [self.parts.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        out = [np.fromiter(map(self.__getitem__, c), np.int64, len(c)) for c in cut]
        if self.new:
            self.settle()
        return out

    def ids_of(self, rows: np.ndarray) -> np.ndarray:
        lengths = self.ends[rows + 1] - self.ends[rows]
        upto = np.cumsum(lengths)
        return self.flat[np.repeat(self.ends[rows] - upto + lengths, lengths) + np.arange(upto[-1] if len(rows) else 0)]

    def encode(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, str]]:
        """For each text its ids, and these in decimal joined by commas."""
        found = self.rows(texts)
        at, tail = len(self.digits), self.flat[self.ends[len(self.digits)] :]
        each = [f"{i}," for i in tail.tolist()]
        ends = (self.ends[at:] - self.ends[at]).tolist()
        self.digits += ["".join(each[a:b]) for a, b in zip(ends, ends[1:])]
        for rows in found:
            yield self.ids_of(rows), "".join(map(self.digits.__getitem__, rows.tolist()))[:-1]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.surface.__getitem__, ids))
        raw = raw[1:] if raw[:1] == b" " else raw
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return _each_byte(raw)


def _each_byte(raw: bytes) -> str:
    """Decodes UTF-8; each byte that belongs to no character becomes one replacement character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


@functools.lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode(docs: DataFrame, text: str = "text", model: str | None = None, keep_ids: bool = True, result: str = "pieces", strict: bool = True) -> DataFrame:
    """Adds a struct: n_tokens, ids (if asked for), ids_sha256, decoded_sha256 and agrees.

    ``agrees`` says that the library encodes the text to the same ids and decodes them to
    the same text; every Arrow batch is checked whole. ``strict``: the task fails where it does not.
    """
    path = model or default_model()
    kind = "n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean" + ", ids array<int>" * keep_ids

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        p = pieces(path)
        for texts in batches:
            rows, texts = [], [t or "" for t in texts]
            for at in range(0, len(texts), 256):
                some = texts[at : at + 256]
                for t, (ids, digits) in zip(some, p.encode(some)):
                    ids = ids.tolist()
                    decoded = p.decode(ids)
                    agrees = p.library.encode(t) == ids and p.library.decode(ids) == decoded
                    if strict and not agrees:
                        raise ValueError(f"other ids or another text than the library's, for a text that begins with {t[:80]!r}")
                    rows.append((len(ids), hashlib.sha256(digits.encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), agrees, *([ids] if keep_ids else [])))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256", "agrees"] + ["ids"] * keep_ids)

    return docs.withColumn(result, run(F.col(text)))
