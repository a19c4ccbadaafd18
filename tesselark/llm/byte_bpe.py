"""Encoding of texts with a public byte-level BPE tokenizer, vectorised over whole batches.

A batch of texts is one byte array. Pieces (the tokenizer's pre-tokens) are found from character classes with array
operations. Pieces met before are taken from a direct-mapped table. The distinct new pieces are bucketed by length into
padded matrices; in each round every row merges its leftmost pair of minimum rank, found by a hashed pair lookup, and
becomes one shorter; rows without a pair leave the matrix. Pieces of more than ``WIDEST`` bytes are first cut wherever no merge can
reach across (no merge of the vocabulary joins the two bytes at its seam), so that nearly all of their parts are rows of the
matrices too. A part that is still wider takes its ranks in order, all places of a rank at once: time grows with its length, not
its square. That is the same as merging one pair at a time where a merge never makes room for one of a lower rank, which is
tested when the vocabulary is read; without that, rows of any width are merged in matrices.

Defined results: null and empty texts have no ids; texts of any length are encoded whole; special tokens written in a
text are ordinary text; rows that repeat are encoded again; empty tables give empty tables; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesselark.llm.bytecols import chunks, class_of_bytes, expand_runs, text_bytes

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Columns of the widest matrix, and rows of one.
WIDEST, ROWS = 64, 1 << 14
#: Slots of the table of known pieces, per Python worker.
KNOWN = 1 << 18
_NO_RANK = np.int32(2**31 - 1)
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def piece_classes() -> np.ndarray:
    """Class of each code point under the piece pattern."""
    import regex

    every = "".join(map(chr, range(0x110000)))
    table = np.full(0x110000, OTHER, np.uint8)
    for c, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[m.start() : m.end()] = c
    return table


def piece_starts(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where pieces begin: runs of letters, numbers or other signs, each with one space before it if there is one;
    contractions; white space, whose last character stands alone or goes with the run behind it."""
    n = len(data)
    classes, begins = class_of_bytes(data, table)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1]] = True
    first = first[:n]
    start = first.copy()
    start[1:] |= classes[1:] != classes[:-1]
    start &= begins
    joined = np.zeros(n, bool)
    joined[1:] = data[:-1] == 0x20
    start &= first | (classes == SPACE) | ~joined
    space = np.flatnonzero((classes == SPACE) & begins)
    after = space + np.where(data[space] < 0x80, 1, np.where(data[space] < 0xE0, 2, 3))
    inside = after < n
    space, after = space[inside], after[inside]
    start[space[~first[after] & (classes[after] != SPACE)]] = True
    quote = np.flatnonzero((data == 0x27) & start)
    if len(quote):
        padded = np.append(data, np.zeros(3, np.uint8))
        edge = np.append(first, np.ones(3, bool))
        a, b = padded[quote + 1], padded[quote + 2]
        near, far = ~edge[quote + 1], ~edge[quote + 1] & ~edge[quote + 2]
        one = near & np.isin(a, list(b"stmd"))
        two = far & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        start[quote[one | two] + 1] = False
        for hits, size in ((quote[one], 2), (quote[two & ~one], 3)):
            behind = hits + size
            behind = behind[behind < n]
            start[behind[classes[behind] == LETTER]] = True
    return np.flatnonzero(start)


class PairTable:
    """Hashed lookup of pairs of ids: rank of the merge and the id it makes."""

    BITS = 20

    def __init__(self, pairs: np.ndarray, made: np.ndarray):
        self.made = made.astype(np.int32)
        self.keys = np.full(1 << self.BITS, 2**64 - 1, np.uint64)
        self.ranks = np.full(1 << self.BITS, _NO_RANK, np.int32)
        keys = self._key(pairs[:, 0], pairs[:, 1])
        todo, self.probes = np.arange(len(keys)), 0
        while len(todo):
            slot = self._slot(keys[todo], self.probes)
            free = self.ranks[slot] == _NO_RANK
            _, pick = np.unique(slot[free], return_index=True)
            put = np.flatnonzero(free)[pick]
            self.keys[slot[put]], self.ranks[slot[put]] = keys[todo[put]], todo[put]
            todo = np.delete(todo, put)
            self.probes += 1

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = keys * _K[0]
        return (((h ^ (h >> np.uint64(29))) * _K[1] >> np.uint64(64 - self.BITS)) + np.uint64(probe)).astype(np.int64) & ((1 << self.BITS) - 1)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = self._key(a, b)
        out = np.full(keys.shape, _NO_RANK, np.int32)
        for probe in range(self.probes):
            slot = self._slot(keys, probe)
            hit = self.keys[slot] == keys
            out[hit] = self.ranks[slot[hit]]
        return out


class ByteBpe:
    """The tokenizer, with its table of known pieces."""

    def __init__(self, byte_ids: np.ndarray, pairs: np.ndarray, made: np.ndarray, classes: np.ndarray | None = None):
        self.byte_ids, self.table = byte_ids, PairTable(pairs, made)
        self.classes = piece_classes() if classes is None else classes
        born = np.full(int(max(byte_ids.max(), pairs.max(initial=0), made.max(initial=0))) + 1, -1)  # rank that makes each id
        first, last = np.zeros(len(born), np.int64), np.zeros(len(born), np.int64)
        first[byte_ids] = last[byte_ids] = np.arange(256)
        self.joins = np.zeros((256, 256), bool)
        for rank, ((x, y), z) in enumerate(zip(pairs.tolist(), made.tolist(), strict=True)):
            born[z] = rank if born[z] < 0 else len(made)  # an id with two merges has no one rank
            first[z], last[z] = first[x], last[y]
            self.joins[last[x], first[y]] = True
        #: Whether a merge only ever makes room for merges of a higher rank.
        self.ordered = bool((np.maximum(born[pairs[:, 0]], born[pairs[:, 1]]) < np.arange(len(pairs))).all()) if len(pairs) else True
        if not self.ordered:
            self.joins[:] = True  # ends of tokens are not known in order of rank: nothing is cut
        self.known = {"lo": np.zeros(KNOWN, np.uint64), "hi": np.zeros(KNOWN, np.uint64), "size": np.zeros(KNOWN, np.uint8), "at": np.zeros(KNOWN, np.int64), "count": np.zeros(KNOWN, np.int64)}
        self.pool = np.zeros(0, np.int32)

    @staticmethod
    def read(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the bytes, and the merges in order of rank with the ids they make; bounded by the vocabulary."""
        model = json.loads(Path(path).read_text())["model"]
        vocab = model["vocab"]
        # byte-level files write each byte as a printable character: printable bytes as themselves, the others from 256 on
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        sign = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in plain)}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        pairs = np.array([[vocab[a], vocab[b]] for a, b in merges], np.int64)
        return np.array([vocab[sign[b]] for b in range(256)], np.int32), pairs, np.array([vocab[a + b] for a, b in merges], np.int64)

    def merge_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of padded rows (-1 behind their ends): all tokens in row order, and how many each row has."""
        live = np.arange(len(rows))
        final: list[tuple[np.ndarray, np.ndarray]] = []
        while len(live):
            if rows.shape[1] > 1:
                rank = self.table.rank(rows[:, :-1], rows[:, 1:])
                best = rank.argmin(1)
                low = rank[np.arange(len(rows)), best]
                merging = low != _NO_RANK
            else:
                merging = np.zeros(len(rows), bool)
            if not merging.all():
                final.append((live[~merging], rows[~merging]))
                live, rows, best, low = live[merging], rows[merging], best[merging] if rows.shape[1] > 1 else live, low[merging] if rows.shape[1] > 1 else live
            if len(live):
                rows[np.arange(len(rows)), best] = self.table.made[low]
                columns = np.arange(rows.shape[1] - 1)
                rows = np.take_along_axis(rows, columns + (columns > best[:, None]), 1)
        count = np.zeros(sum(len(i) for i, _ in final), np.int64)
        for i, r in final:
            count[i] = (r >= 0).sum(1)
        begin = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), np.int32)
        for i, r in final:
            out[expand_runs(count[i], begin[i])] = r[r >= 0]
        return out, count

    def merge_long(self, ids: np.ndarray) -> np.ndarray:
        """Tokens of one sequence, rank by rank: the places of each rank wait in a heap of ranks."""
        n = len(ids)
        after, before = np.append(np.arange(1, n), -1), np.arange(-1, n - 1)
        live = np.ones(n, bool)
        rank = np.full(n, _NO_RANK, np.int32)
        rank[:-1] = self.table.rank(ids[:-1], ids[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def wait(places: np.ndarray) -> None:
            places = places[rank[places] != _NO_RANK]
            places = places[np.argsort(rank[places], kind="stable")]
            for group in np.split(places, np.flatnonzero(np.diff(rank[places])) + 1):
                if len(group):
                    r = int(rank[group[0]])
                    if r not in waiting:
                        waiting[r] = []
                        heapq.heappush(heap, r)
                    waiting[r].append(group)

        wait(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(waiting.pop(r)))
            at = at[live[at] & (rank[at] == r)]
            if not len(at):
                continue
            run = np.flatnonzero(np.append(True, after[at[:-1]] != at[1:]))  # in 'aaa' the pairs overlap: every other one merges
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            gone = after[at]
            ids[at], live[gone] = self.table.made[r], False
            after[at] = after[gone]
            has = after[at] >= 0
            before[after[at[has]]] = at[has]
            changed = np.unique(np.concatenate([at, before[at]]))
            changed = changed[(changed >= 0)]
            changed = changed[live[changed]]
            has = after[changed] >= 0
            rank[changed[~has]] = _NO_RANK
            changed = changed[has]
            rank[changed] = self.table.rank(ids[changed], ids[after[changed]])
            wait(changed)
        return ids[live]

    def _new(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of pieces, by length buckets; returns where each lies in the pool and how many tokens it has."""
        if (size > WIDEST).any():
            return self._cut(data, start, size)
        at, count = np.zeros(len(start), np.int64), np.zeros(len(start), np.int64)
        filled, parts = len(self.pool), [self.pool]
        width = 1
        while width <= WIDEST:
            bucket = np.flatnonzero((size <= width) & (size > width // 2))
            for k in range(0, len(bucket), ROWS):
                rows = bucket[k : k + ROWS]
                columns = np.arange(width)
                inside = columns < size[rows][:, None]
                matrix = np.where(inside, self.byte_ids[data[np.minimum(start[rows][:, None] + columns, len(data) - 1)]], -1)
                tokens, n = self.merge_rows(matrix.astype(np.int32))
                at[rows], count[rows] = filled + np.cumsum(n) - n, n
                parts.append(tokens)
                filled += len(tokens)
            width *= 2
        self.pool = np.concatenate(parts).astype(np.int32)
        return at, count

    def _cut(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces some of which are wider than a matrix, by their parts."""
        place = expand_runs(size, start)
        head = np.ones(len(place), bool)
        head[1:] = ~self.joins[data[place[:-1]], data[place[1:]]]
        head[np.cumsum(size) - size] = True
        first = np.flatnonzero(head)
        part, wide = place[first], np.diff(np.append(first, len(place)))
        raw = data.tobytes()
        numbers: dict[bytes, int] = {}
        back = np.array([numbers.setdefault(raw[s : s + z], len(numbers)) for s, z in zip(part.tolist(), wide.tolist(), strict=True)])
        _, pick = np.unique(back, return_index=True)
        begin, length = part[pick], wide[pick]
        at, count = np.zeros(len(pick), np.int64), np.zeros(len(pick), np.int64)
        short = length <= WIDEST
        at[short], count[short] = self._new(data, begin[short], length[short])
        more, filled = [self.pool], len(self.pool)
        for i in np.flatnonzero(~short):
            ids = self.byte_ids[data[begin[i] : begin[i] + length[i]]].copy()
            tokens = self.merge_long(ids) if self.ordered else self.merge_rows(ids[None].astype(np.int32))[0]
            at[i], count[i] = filled, len(tokens)
            more.append(tokens)
            filled += len(tokens)
        self.pool = np.concatenate(more).astype(np.int32)
        # the tokens of a piece are those of its parts one after another
        at, count = at[back], count[back]
        ends = np.append(0, np.cumsum(count))
        edge = np.append(np.searchsorted(first, np.cumsum(size) - size), len(first))
        filled = len(self.pool)
        self.pool = np.concatenate([self.pool, self.pool[expand_runs(count, at)]])
        return filled + ends[edge[:-1]], np.diff(ends[edge])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the offsets of the texts in them."""
        start = piece_starts(data, offsets, self.classes)
        size = np.diff(np.append(start, len(data)))
        padded = np.append(data, np.zeros(24, np.uint8))
        words = np.ndarray((len(data) + 16,), "<u8", padded, 0, (1,))
        keep = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
        lo = words[start] & keep[np.minimum(size, 8)]
        hi = words[np.minimum(start + 8, len(data) + 8)] & keep[np.clip(size - 8, 0, 8)]
        mixed = (lo * _K[0]) ^ ((hi + _K[2]) * _K[1])
        mixed = (mixed ^ (mixed >> np.uint64(31)) ^ size.astype(np.uint64)) * _K[0]
        slot = (mixed >> np.uint64(64 - 18)).astype(np.int64)
        if len(self.pool) > 1 << 24:  # forget, so that memory stays bounded
            self.pool = np.zeros(0, np.int32)
            self.known["size"][:] = 0
        k = self.known
        hit = (k["size"][slot] == size) & (k["lo"][slot] == lo) & (k["hi"][slot] == hi) & (size <= 16)
        at, count = k["at"][slot], k["count"][slot]
        new = np.flatnonzero(~hit & (size <= 16))
        if len(new):
            _, pick, back = np.unique(mixed[new], return_index=True, return_inverse=True)
            one = new[pick]
            same = (lo[new] == lo[one][back]) & (hi[new] == hi[one][back]) & (size[new] == size[one][back])
            a, c = self._new(data, start[one], size[one])
            at[new], count[new] = a[back], c[back]
            for name, value in (("lo", lo[one]), ("hi", hi[one]), ("size", size[one]), ("at", a), ("count", c)):
                k[name][slot[one]] = value
            if not same.all():  # two pieces with one hash
                other = new[~same]
                at[other], count[other] = self._new(data, start[other], size[other])
        rest = np.flatnonzero(size > 16)
        if len(rest):
            raw = data.tobytes()
            numbers: dict[bytes, int] = {}
            back = np.array([numbers.setdefault(raw[s : s + z], len(numbers)) for s, z in zip(start[rest].tolist(), size[rest].tolist(), strict=True)])
            _, pick = np.unique(back, return_index=True)
            a, c = self._new(data, start[rest[pick]], size[rest[pick]])
            at[rest], count[rest] = a[back], c[back]
        ids = self.pool[expand_runs(count, at)]
        ends = np.append(0, np.cumsum(count))
        return ids, ends[np.searchsorted(start, offsets)]


_loaded: dict[str, ByteBpe] = {}


def _worker(name: str, parts) -> ByteBpe:
    """The tokenizer of this Python worker, made once and kept for its later tasks."""
    if name not in _loaded:
        _loaded.clear()
        _loaded[name] = ByteBpe(*parts.value)
    return _loaded[name]


def encode_column(texts: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``key, ids``: the ids of each text. Narrow: no shuffle, one pass; the vocabulary is broadcast (some MB, fixed)."""
    parts, name = texts.sparkSession.sparkContext.broadcast((*ByteBpe.read(tokenizer), piece_classes())), uuid.uuid4().hex
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bpe = _worker(name, parts)
            data, offsets = text_bytes(batch.column(1))
            for a, b in chunks(offsets):
                ids, ends = bpe.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), lists], names=[key, "ids"])

    return texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")
