"""Deeply nested records to related flat tables, by vectorised structural indexing of their JSON text.

A batch of records is one byte array. Quote, escape and bracket bitmaps are built with numpy, the parity of a prefix sum
over the quotes masks what is inside strings, and a prefix sum over brackets gives the nesting depth. Sorting the
structural bytes by depth puts the members of each container beside each other, so the span of every key and value
follows from its neighbours. Paths are walked for all records at once; each row that comes out carries its parent
record, the key or the position in its parent, and scalar fields below it.

Defined results: missing, null and empty parts at any level give no child rows; null fields come out as null; a record
that equals an earlier one in all but its line gives no rows; an empty table gives empty tables; further columns of the
input are ignored. Text that is not JSON raises. Batches are bounded in rows by Arrow and in bytes by ``MAX_BYTES``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text indexed at once; a single longer record is indexed alone.
MAX_BYTES = 16 << 20


def _is(data: np.ndarray, chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table[data]


def _skip(blank: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """The first bytes from ``at`` on, forwards or backwards, that are not blank. Most are so at once; what is left after a few
    steps is looked up."""
    at, n = at.copy(), len(blank)
    for _ in range(4):
        on = (at >= 0) & (at < n)
        on[on] = blank[at[on]]
        if not on.any():
            return at
        at[on] += step
    solid = np.flatnonzero(~blank)
    found = np.searchsorted(solid, at, "left") if step > 0 else np.searchsorted(solid, at, "right") - 1
    return np.where((found >= 0) & (found < len(solid)), solid[np.clip(found, 0, max(0, len(solid) - 1))] if len(solid) else at, n if step > 0 else -1)


class StructuralIndex:
    """Spans of all members of all containers in a byte array that holds one JSON text per record.

    For each member: ``container`` (byte of the opening bracket), ``start``, ``stop`` (its value), ``key_start``,
    ``key_stop`` (-1 in arrays), ``pos`` (its number in the container) and ``opening`` (the opening bracket of its own
    value, or -1 for scalars). Members are sorted by container.
    """

    def __init__(self, data: np.ndarray):
        self.data = data
        n = len(data)
        backslash = data == ord("\\")
        if backslash.any():
            # a quote is escaped if an odd run of backslashes ends just before it
            at = np.arange(n)
            last_other = np.maximum.accumulate(np.where(~backslash, at, -1))
            run = at - last_other
            escaped = np.zeros(n, bool)
            escaped[1:] = (run[:-1] & 1).astype(bool)
        else:
            escaped = np.zeros(n, bool)
        self.escaped = escaped  # bytes behind an escaping backslash
        self.escaping = np.append(escaped[1:], False) if n else escaped
        self.escapes = np.append(0, np.cumsum(escaped, dtype=np.int32))
        self.points = np.append(0, np.cumsum(escaped & (data == ord("u")), dtype=np.int32))
        quotes = (data == ord('"')) & ~escaped
        inside = (np.cumsum(quotes, dtype=np.int64) & 1).astype(bool)
        structural = np.flatnonzero(_is(data, b"{}[]:,") & ~inside)
        kinds = data[structural]
        opens, closes = _is(kinds, b"{["), _is(kinds, b"}]")
        depth = np.cumsum(opens.astype(np.int64) - closes) + closes  # of the container a token belongs to or opens
        order = np.argsort(depth.astype(np.int16) if len(depth) and depth.max() < 1 << 15 else depth, kind="stable")  # 16 bits sort by radix
        pos, kind, level = structural[order], kinds[order], depth[order]
        is_open = opens[order]
        group = np.cumsum(is_open) - 1  # container of each token: its tokens lie together after sorting by depth
        container = pos[is_open][group] if len(pos) else pos
        in_object = data[container] == ord("{") if len(pos) else np.zeros(0, bool)
        begins = np.where(in_object, kind == ord(":"), is_open | (kind == ord(",")))
        i = np.flatnonzero(begins)
        start, stop = pos[i] + 1, pos[i + 1] if len(i) else pos[i]
        blank = _is(data, b" \t\r\n")
        self.blank = blank
        after = lambda at: _skip(blank, at, 1)  # noqa: E731 - the first solid byte from ``at`` on
        first = after(start) if len(i) else start
        filled = first < stop  # '[]' has no member
        i, start, stop = i[filled], first[filled], stop[filled]
        key_at = np.where(in_object[i], after(pos[i - 1] + 1), -1) if len(i) else i
        self.start, self.stop, self.container = start, stop, container[i]
        self.key_start, self.key_stop = key_at, np.where(in_object[i], pos[i], -1)
        token_of_container = np.flatnonzero(is_open)
        self.pos = np.where(in_object[i], (i - token_of_container[group[i]]) // 2, i - token_of_container[group[i]]) if len(i) else i
        self.opening = np.where(_is(data[start], b"{["), start, -1) if len(start) else start
        by = np.argsort(self.container, kind="stable")  # members of a container are in order already
        for name in ("start", "stop", "container", "key_start", "key_stop", "pos", "opening"):
            setattr(self, name, getattr(self, name)[by])
        self.levels = int(level.max()) if len(level) else 0

    def members(self, openings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Members of the containers that open at ``openings`` (-1: none), and for each the number of its container."""
        lo = np.searchsorted(self.container, openings, "left")
        hi = np.searchsorted(self.container, openings, "right")
        count = np.where(openings >= 0, hi - lo, 0)
        parent = np.repeat(np.arange(len(openings)), count)
        offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.repeat(lo, count) + offset, parent

    def with_key(self, members: np.ndarray, key: str) -> np.ndarray:
        """Which of ``members`` have this key, however it is escaped."""
        wanted = json.dumps(key, ensure_ascii=False).encode()
        s, e = self.key_start[members], self.key_stop[members]
        hit = np.flatnonzero((s >= 0) & (e - s >= len(wanted)))
        odd = hit[self.escapes[e[hit]] > self.escapes[s[hit]]]
        for j, byte in enumerate(wanted):
            hit = hit[self.data[s[hit] + j] == byte]
        if len(odd):  # the few keys that hold a backslash
            same = [i for i in odd.tolist() if json.loads(self.data[s[i] : e[i]].tobytes()) == key]
            hit = np.unique(np.concatenate([hit, np.array(same, np.int64)]))
        return hit

    def scalars(self, start: np.ndarray, stop: np.ndarray) -> pa.Array:
        """The scalars of spans (-1: none) as one Arrow array: strings unescaped, null as null, all else as it is written. Bytes are
        copied run by run; only strings with an escaped code point are read one by one."""
        n = len(start)
        there = start >= 0
        s = np.where(there, start, 0)
        e = np.where(there, _skip(self.blank, np.where(there, stop - 1, 0), -1) + 1, 0) if len(self.data) else s
        quoted = there & (self.data[s] == ord('"')) if len(self.data) else there
        null = ~there | (~quoted & (e - s == 4) & (self.data[s] == ord("n"))) if len(self.data) else ~there
        s, e = np.where(quoted, s + 1, s), np.where(quoted, e - 1, e)
        size = np.where(null, 0, np.maximum(e - s, 0))
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(s, size)
        within = np.repeat(quoted, size)  # only strings are unescaped
        keep = ~(self.escaping[place] & within)
        text = self.data[place]
        behind = self.escaped[place] & within
        text[behind] = _UNESCAPED[text[behind]]
        kept = np.append(0, np.cumsum(keep))
        ends = np.append(0, np.cumsum(size))
        offsets = kept[ends].astype(np.int32 if kept[-1] < 1 << 31 else np.int64)
        text, kind = text[keep], pa.string() if offsets.dtype == np.int32 else pa.large_string()
        valid = pa.array(~null).buffers()[1]
        out = pa.Array.from_buffers(kind, n, [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(text.tobytes())]).cast(pa.string())
        slow = np.flatnonzero(~null & quoted & (self.points[e] > self.points[s]))
        if len(slow):
            mask = np.zeros(n, bool)
            mask[slow] = True
            values = [json.loads(self.data[s[i] - 1 : e[i] + 1].tobytes()) for i in slow.tolist()]
            # half a pair of code points is no text: it becomes the sign for that
            values = [v.encode("utf-16", "surrogatepass").decode("utf-16", "replace") for v in values]
            out = pc.replace_with_mask(out, pa.array(mask), pa.array(values, pa.string()))
        return out


#: What each character means behind a backslash.
_UNESCAPED = np.arange(256, dtype=np.uint8)
for _sign, _meaning in (("n", 10), ("t", 9), ("r", 13), ("b", 8), ("f", 12)):
    _UNESCAPED[ord(_sign)] = _meaning


@dataclass(frozen=True)
class ChildTable:
    """A table of children: ``path`` leads from the record to them (a key, ``*`` for each key, ``[]`` for each element);
    ``fields`` are paths of keys from the child to a scalar."""

    name: str
    path: tuple[str, ...]
    fields: dict[str, tuple[str, ...]] = field(default_factory=dict)


class Records:
    """JSON texts of records, indexed once for all tables that are read from them."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
        cuts = offsets - offsets[0]
        # a line end between texts, so that no text runs into the next
        self.opening = np.where(np.diff(cuts) > 0, cuts[:-1] + np.arange(len(texts)), -1)
        self.index = StructuralIndex(np.insert(data, cuts[1:], ord("\n")))

    def children(self, table: ChildTable) -> dict[str, np.ndarray | pa.Array]:
        """Columns ``record`` (number of the text), ``child_key`` (the last ``*`` key), ``pos`` (the last ``[]`` position, else 0)
        and the fields of each child that is not null."""
        index, opening = self.index, self.opening
        record = np.arange(len(opening))
        keys, pos, member = np.full(len(opening), -1), np.zeros(len(opening), np.int64), np.full(len(opening), -1)
        for step in table.path:
            m, parent = index.members(opening)
            if step == "[]":
                pick = np.flatnonzero(index.key_start[m] < 0)
            elif step == "*":
                pick = np.flatnonzero(index.key_start[m] >= 0)
            else:
                pick = index.with_key(m, step)
            member, up = m[pick], parent[pick]
            record, opening = record[up], index.opening[member]
            keys = member if step == "*" else keys[up]
            pos = index.pos[member] if step == "[]" else pos[up]
        if len(member):
            at = index.start[member]
            live = ~((index.opening[member] < 0) & (index.data[at] == ord("n")))
            record, opening, keys, pos = record[live], opening[live], keys[live], pos[live]

        def spans(members: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
            has = members >= 0
            return index.scalars(np.where(has, start[members], -1), np.where(has, stop[members], -1)) if len(start) else pa.nulls(len(members), pa.string())

        out: dict[str, np.ndarray | pa.Array] = {"record": record, "pos": pos, "child_key": spans(keys, index.key_start, index.key_stop)}
        for name, path in table.fields.items():
            at, rows, value = opening, np.arange(len(record)), np.full(len(record), -1)
            for key in path:
                m, parent = index.members(at)
                pick = index.with_key(m, key)
                rows, member = rows[parent[pick]], m[pick]
                at = index.opening[member]
            if len(rows):
                value[rows] = member
            out[name] = spans(value, index.start, index.stop)
        return out


def flatten(records: DataFrame, key: str, text: str, tables: list[ChildTable]) -> DataFrame:
    """Children of all ``tables`` from the JSON object in column ``text``: ``key, child, child_key, pos, fields``, where
    ``fields`` maps the table's field names to scalars. ``key`` is a long that names the record."""
    schema = f"`{key}` long, child string, child_key string, pos int, fields map<string,string>"
    target = pa.schema([(key, pa.int64()), ("child", pa.string()), ("child_key", pa.string()), ("pos", pa.int32()), ("fields", pa.map_(pa.string(), pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.append(0, np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False)))
            start = 0
            while start < batch.num_rows:  # as many records as there is room for, and at least one
                stop = max(start + 1, int(np.searchsorted(sizes, sizes[start] + MAX_BYTES, "right")) - 1)
                part = batch.slice(start, stop - start)
                start = stop
                records = Records(part.column(1).fill_null(""))
                for t in tables:
                    rows = records.children(t)
                    n, k = len(rows["record"]), len(t.fields)
                    if n:
                        names = pa.array(list(t.fields) * n, pa.string())
                        every = pa.concat_arrays([rows[f] for f in t.fields]).take(pa.array((np.arange(n)[:, None] + n * np.arange(k)).ravel()))
                        fields = pa.MapArray.from_arrays(pa.array(np.arange(0, n * k + 1, k, dtype=np.int32)), names, every)
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows["record"])), pa.array([t.name]).take(pa.array(np.zeros(n, int))), rows["child_key"], pa.array(rows["pos"].astype(np.int32)), fields], schema=target)

    return records.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, schema)


#: The flat tables of an entity record.
ENTITY_CHILDREN = [
    ChildTable("sitelink", ("sitelinks", "*"), {"site": ("site",), "title": ("title",), "url": ("url",)}),
    ChildTable("claim", ("claims", "*", "[]"), {"property": ("mainsnak", "property"), "value": ("mainsnak", "datavalue", "value"), "rank": ("rank",)}),
]


def distinct_records(raw: DataFrame) -> DataFrame:
    """``line_no, id, record``: each distinct record as JSON text, named by its first line. Equal records meet after
    partial aggregation, so a record that repeats often crosses the shuffle once per task."""
    ordered = F.struct(
        "id",
        *(F.array_sort(F.map_entries(c)).alias(f"{c}_entries") for c in ("sitelinks", "claims")),
    )
    text = F.to_json(F.struct("sitelinks", "claims"), {"ignoreNullFields": "false"})
    rows = raw.select("line_no", "id", F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256).alias("same"), text.alias("record"))
    first = rows.groupBy("same").agg(F.min(F.struct("line_no", "id", "record")).alias("first"))
    return first.select("first.*")


def entity_children(raw: DataFrame, tables: tuple[str, ...] = ("sitelink", "claim")) -> DataFrame:
    """Sitelinks and statements of each distinct entity record, linked by ``line_no``; only the tables asked for are read."""
    return flatten(distinct_records(raw), "line_no", "record", [t for t in ENTITY_CHILDREN if t.name in tables])


def linked_rows(raw: DataFrame) -> DataFrame:
    """``line_no, child, child_key, pos`` of the children that say something: statements with a main value that is
    neither blank nor JSON null, sitelinks with a title that is not blank."""
    value = F.trim(F.regexp_replace(F.col("fields")["value"], r"\s+", " "))
    title = F.trim(F.regexp_replace(F.col("fields")["title"], r"\s+", " "))
    said = F.when(F.col("child") == "claim", (value != "") & (value != "null")).otherwise(title != "")
    return entity_children(raw).where(said).select("line_no", "child", "child_key", F.when(F.col("child") == "claim", F.col("pos")).otherwise(0).alias("pos")).distinct()
