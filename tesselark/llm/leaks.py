"""Evaluation passages inside a training corpus, found through FM-indexes of the corpus.

Each shard of the corpus (the texts of an Arrow batch, cut at ``SHARD_WORDS`` words) becomes a sequence of word numbers
in which every word that no evaluation item has is one separator; runs of separators are one. Its suffixes are sorted by
prefix doubling - a separator ends every comparison, so only passages of evaluation words are ever compared - and the
Burrows-Wheeler transform is kept in a wavelet matrix. All windows of ``WINDOW`` words of all items are searched
backwards at once; windows whose interval empties drop out. Occurrences are located by walking back to sampled suffix
positions, and overlapping ones are merged into spans. An exact comparison of the words follows.

Defined results: words are runs of letters and digits, compared without case; punctuation, spacing and invisible
characters do not matter; null, empty and short texts and items leak nothing; texts are searched whole, whatever their
length; repeated rows give their pairs once; an empty table on either side gives no rows; further columns are ignored.
The items are made into windows on the driver once and broadcast, at most ``MAX_CHARS`` characters of them at a time by a checked size:
more items are searched in several parts, each with a pass of its own. The corpus is never moved: nothing of it is
shuffled but the pairs found.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselark.llm.bytecols import chunks, class_of_bytes, expand_runs, text_bytes

#: Consecutive words that make a leak.
WINDOW = 12
#: Characters of test items that every worker holds at a time (of a larger item alone, that item).
MAX_CHARS = 64_000_000
#: Words of one FM-index.
SHARD_WORDS = 1 << 20
#: Every so many positions of the text are sampled in the suffix order.
SAMPLE = 16
#: Characters that show nothing, besides those of category Cf.
INVISIBLE = frozenset("\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0") | {chr(i) for i in range(0xFE00, 0xFE10)}
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def plain(text: str) -> str:
    """A text in folded case without invisible characters."""
    if text.isascii():
        return text.lower()
    text = "".join(c for c in unicodedata.normalize("NFC", text) if unicodedata.category(c) != "Cf" and c not in INVISIBLE)
    return unicodedata.normalize("NFC", text.casefold())


def word_classes() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    table[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and unicodedata.category(chr(i))[0] in "LN"]] = 1
    return table


class Words:
    """Words of byte arrays and their 64-bit hashes, which are sums of bytes weighted by powers: a difference of prefix
    sums gives the hash of any word."""

    def __init__(self) -> None:
        self.table = word_classes()
        self.power = np.ones(1, np.uint64)
        self.unpower = np.ones(1, np.uint64)

    def forget(self) -> None:
        """Drop the powers, which are made again as they are needed."""
        self.power = self.unpower = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        while len(self.power) < n:
            with np.errstate(over="ignore"):  # arithmetic modulo 2**64
                self.power = np.concatenate([self.power, self.power * (self.power[-1:] * _BASE)])
                self.unpower = np.concatenate([self.unpower, self.unpower * (self.unpower[-1:] * _INVERSE)])

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and its hash."""
        n = len(data)
        inside = class_of_bytes(data, self.table)[0].astype(bool)
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < n)]
        start[edges] |= inside[edges]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        last[edges - 1] |= inside[edges - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(last) + 1
        self._powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=total[1:])
        h = (total[e] - total[s]) * self.unpower[s]
        return s, e, h ^ (h >> np.uint64(32))


def folded_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts in plain form. ASCII texts never become Python strings."""
    raw, offsets = text_bytes(texts)
    if len(raw) and raw.max() >= 0x80:
        high = np.add.reduceat(np.append(raw >= 0x80, False), np.minimum(offsets[:-1], len(raw)))
        high[np.diff(offsets) == 0] = 0
        odd = np.flatnonzero(high)
        picked = [plain(t) for t in texts.take(pa.array(odd)).to_pylist()]
        parts, sizes, at = [], np.diff(offsets), 0
        for i, t in zip(odd.tolist(), picked, strict=True):
            b = t.encode()
            parts += [raw[at : offsets[i]], np.frombuffer(b, np.uint8)]
            sizes[i], at = len(b), offsets[i + 1]
        parts.append(raw[at:])
        raw, offsets = np.concatenate(parts), np.append(0, np.cumsum(sizes))
    upper = (raw >= 65) & (raw <= 90)
    return raw + (upper.astype(np.uint8) << 5), offsets


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit per level; each level keeps the number of ones before each position."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.bits, self.ones, self.zeros = bits, [], []
        row = symbols
        for level in range(bits - 1, -1, -1):
            bit = ((row >> level) & 1).astype(bool)
            count = np.zeros(len(row) + 1, np.int32)
            np.cumsum(bit, out=count[1:])
            self.ones.append(count)
            self.zeros.append(len(row) - int(count[-1]))
            row = np.concatenate([row[~bit], row[bit]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in range(self.bits):
            count, zeros = self.ones[level], self.zeros[level]
            bit = ((symbol >> (self.bits - 1 - level)) & 1).astype(bool)
            a, b = count[low].astype(np.int64), count[high].astype(np.int64)
            low, high = np.where(bit, zeros + a, low - a), np.where(bit, zeros + b, high - b)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at positions."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in range(self.bits):
            count, zeros = self.ones[level], self.zeros[level]
            a = count[at].astype(np.int64)
            bit = count[at + 1] > a
            out = (out << 1) | bit
            at = np.where(bit, zeros + a, at - a)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of ``text`` in order. Symbol 0 is smaller than all and ends a comparison; suffixes that start with it
    stand in text order. Only suffixes that still tie are sorted again, by twice as many symbols."""
    n = len(text)
    order = np.argsort(text.astype(np.uint16) if text.max(initial=0) < 1 << 16 else text, kind="stable")
    head = np.ones(n, bool)
    head[1:] = (text[order][1:] != text[order][:-1]) | (text[order][1:] == 0)
    group = np.flatnonzero(head)[np.cumsum(head) - 1]  # the first place of each suffix's group is its rank
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = group, -1
    places = np.flatnonzero(np.diff(np.append(group, n + 1)) == 0)
    tied = np.unique(np.concatenate([places, places + 1])) if len(places) else places
    width = 1
    while len(tied):
        suffix = order[tied]
        key = (rank[suffix] << 32) | (rank[np.minimum(suffix + width, n)] + 1)
        by = np.argsort(key, kind="stable")
        suffix, key = suffix[by], key[by]
        order[tied] = suffix
        head = np.ones(len(tied), bool)
        head[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(head)
        rank[suffix] = tied[first][np.cumsum(head) - 1]
        size = np.diff(np.append(first, len(tied)))
        tied = tied[np.repeat(size > 1, size)]
        width *= 2
    return order


class FmIndex:
    """FM-index of a sequence over 1..symbols-1, in which 0 separates passages."""

    def __init__(self, text: np.ndarray, symbols: int):
        if not len(text) or text[-1]:
            text = np.append(text, 0)  # else the last symbol would have no row behind it, and ranks of its like be one short
        order = suffix_order(text)
        before = np.where(order > 0, text[np.maximum(order - 1, 0)], 0)
        self.first = np.append(0, np.cumsum(np.bincount(text, minlength=symbols)))
        self.bwt = WaveletMatrix(before.astype(np.int64), max(1, int(symbols - 1).bit_length()))
        # walks stop at sampled positions and behind separators, which have no order of their own
        self.sampled = (order % SAMPLE == 0) | (before == 0)
        self.sample_number = np.cumsum(self.sampled) - 1
        self.samples = order[self.sampled]

    def search(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (rows of symbols) that occur: their numbers and suffix intervals."""
        live = np.arange(len(windows))
        low, high = self.first[windows[:, -1]], self.first[windows[:, -1] + 1]
        for k in range(windows.shape[1] - 2, -1, -1):
            keep = high > low
            live, low, high = live[keep], low[keep], high[keep]
            c = windows[live, k]
            low, high = self.first[c] + self.bwt.rank(c, low), self.first[c] + self.bwt.rank(c, high)
        keep = high > low
        return live[keep], low[keep], high[keep]

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of places in the suffix order."""
        position, walking, at, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), rows.copy(), 0
        while len(walking):
            here = self.sampled[at]
            position[walking[here]] = self.samples[self.sample_number[at[here]]] + steps
            walking, at = walking[~here], at[~here]
            c = self.bwt.access(at)
            at = self.first[c] + self.bwt.rank(c, at)
            steps += 1
        return position


class Items:
    """The evaluation items as windows of word numbers. Made on the driver; what a worker needs of it is arrays."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        self.window, self.words = window, Words()
        data, offsets = folded_bytes(pa.array([t for _, t in items], pa.string()))
        s, _, h = self.words.split(data, offsets)
        self.words.forget()
        self.hashes = np.unique(h)
        number = (np.searchsorted(self.hashes, h) + 1).astype(np.int32)
        owner = np.repeat(np.arange(len(items)), np.diff(np.searchsorted(s, offsets)))
        first = np.flatnonzero(owner[window - 1 :] == owner[: len(owner) - window + 1]) if len(owner) >= window else np.zeros(0, np.int64)
        rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(number, window)[first]) if len(first) else np.zeros((0, window), np.int32)
        key, one, back = np.unique(rows.view(f"V{4 * window}").ravel(), return_index=True, return_inverse=True) if len(rows) else (rows, first, first)
        self.windows = rows[one].astype(np.int64)
        ids = np.array([i for i, _ in items], np.int64)
        pairs = np.unique(np.stack([back, ids[owner[first]]], 1), axis=0) if len(rows) else np.zeros((0, 2), np.int64)
        self.owner_window, self.owner_item = pairs[:, 0], pairs[:, 1]
        self.phrases = {i: t for i, t in items if t}
        # a table of the low bits of the hashes answers most words that no item has
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Word numbers of hashes, 0 for words that no item has."""
        out = np.zeros(len(h), np.int64)
        may = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.searchsorted(self.hashes, h[may])
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == h[may]
        out[may[hit]] = at[hit] + 1
        return out

    def find(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Occurrences, shard by shard: number of the text, number of the window, position in words."""
        if not len(self.windows):
            return
        data, offsets = folded_bytes(texts)
        for a, b in chunks(offsets):
            base = offsets[a]
            part, cuts = data[base : offsets[b]], offsets[a : b + 1] - base
            s, _, h = self.words.split(part, cuts)
            number = self.numbers(h)
            ends = np.searchsorted(s, cuts)
            for x, y in chunks(ends, SHARD_WORDS):
                lo, hi = ends[x], ends[y]
                words = np.insert(number[lo:hi], ends[x:y] - lo, 0)  # each text begins behind a separator
                at = np.insert(np.arange(lo, hi), ends[x:y] - lo, -1)
                text_of = np.insert(np.repeat(np.arange(x, y), np.diff(ends[x : y + 1])), ends[x:y] - lo, -1)
                keep = words > 0
                keep[1:] |= words[:-1] > 0
                words, at, text_of = words[keep], at[keep], text_of[keep]
                if len(words) < self.window:
                    continue
                index = FmIndex(words, len(self.hashes) + 1)
                window, low, high = index.search(self.windows)
                if len(window):
                    rows = expand_runs(high - low, low)
                    place = index.locate(rows)
                    yield a + text_of[place], np.repeat(window, high - low), at[place] - ends[text_of[place]]


def _words(text: str) -> list[str]:
    out, word = [], []
    for c in text + " ":
        if unicodedata.category(c)[0] in "LN":
            word.append(c)
        elif word:
            out.append("".join(word))
            word = []
    return out


def leaked_spans(documents: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id") -> DataFrame:
    """``doc_id, item_id, first_word, last_word``: the merged spans of each document that an item shares, in words."""
    known = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = known.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = max(1, -(-size // MAX_CHARS))
    out = None
    for part in range(parts):
        rows = known.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()  # about MAX_CHARS characters
        found = _spans_of_part(documents, Items(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), window), key)
        out = found if out is None else out.unionByName(found)
    return out


def _spans_of_part(documents: DataFrame, items: Items, key: str) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(items)
    window = items.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, plain_items = shared.value, {}
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for text, hit, at in found.find(texts):
                low = np.searchsorted(found.owner_window, hit, "left")
                count = np.searchsorted(found.owner_window, hit, "right") - low
                item = found.owner_item[expand_runs(count, low)]
                text, at = np.repeat(text, count), np.repeat(at, count)
                by = np.lexsort((at, item, text))
                text, item, at = text[by], item[by], at[by]
                head = np.ones(len(text), bool)
                head[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (at[1:] > at[:-1] + window)
                first = np.flatnonzero(head)
                last = np.append(first[1:], len(text)) - 1
                text, item, start, stop = text[first], item[first], at[first], at[last] + window - 1
                keep = np.zeros(len(text), bool)
                words_of: dict[int, list[str]] = {}
                for i in range(len(text)):  # the exact check: only texts with a hit are compared as strings
                    t, j = int(text[i]), int(item[i])
                    if t not in words_of:
                        words_of[t] = _words(plain(texts[t].as_py()))
                    if j not in plain_items:
                        plain_items[j] = f" {' '.join(_words(plain(found.phrases[j])))} "
                    keep[i] = f" {' '.join(words_of[t][start[i] : start[i] + window])} " in plain_items[j]
                if keep.any():
                    yield pa.RecordBatch.from_arrays(
                        [keys.take(pa.array(text[keep])), pa.array(item[keep], pa.int64()), pa.array(start[keep].astype(np.int32)), pa.array(stop[keep].astype(np.int32))],
                        names=[key, "item_id", "first_word", "last_word"],
                    )

    return documents.select(key, "text").where(f"{key} is not null and length(text) > 0").mapInArrow(run, f"`{key}` long, item_id long, first_word int, last_word int")


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, item_id``: documents and the items they share at least ``window`` consecutive words with."""
    return leaked_spans(documents, items, window).select("doc_id", "item_id").distinct()
