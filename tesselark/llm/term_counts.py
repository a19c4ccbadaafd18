"""How often every distinct term occurs, in how many records, and which terms are too rare or too common to be useful.

Pairs of term and record identifier are range-partitioned by both, so that a term held by a third of all records is cut
into several ranges, and sorted inside each range by Spark's external sort. One scan over each sorted range compares
neighbours: the lengths of the runs give occurrences and distinct records. A term that a range border cuts comes out as
one partial run per range; these are summed, at most one row per term and range.

Defined results: entries that repeat within a record (the same term, written form and count: a record delivered again)
count once; counts that are null, zero or negative hold nothing; empty terms and records without an identifier do not
count; an empty table gives no terms; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term held by fewer records is rare; one held by more than this share of the records that hold any term is common.
RARE_BELOW, COMMON_ABOVE = 3, (2, 5)


def normal_term(key: Column) -> Column:
    """A term in lower case without apostrophes and spaces around it; null if nothing is left."""
    term = F.regexp_replace(F.lower(key), r"^[\s'’]+|[\s'’]+$", "")
    return F.when(term != "", term)


def _run_lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted rows ``term, id, form, n``: ``term, records, occurrences``; the last run is carried over batches."""
    last: tuple | None = None
    carried: tuple[str, int, int] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = []
        for k in range(4):
            column = batch.column(k)
            differs = np.empty(len(column), bool)
            differs[1:] = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1)).to_numpy(zero_copy_only=False)
            differs[0] = last is None or column[0].as_py() != last[k]
            changed.append(differs)
        new_term, new_pair, new_entry = changed[0], changed[0] | changed[1], changed[0] | changed[1] | changed[2] | changed[3]
        occurrences = np.where(new_entry, batch.column(3).to_numpy(), 0)
        start = np.flatnonzero(np.append(True, new_term[1:]))
        pairs, total = np.add.reduceat(new_pair.astype(np.int64), start), np.add.reduceat(occurrences, start)
        terms = batch.column(0).take(pa.array(start)).to_pylist()
        if carried and not new_term[0]:
            pairs[0] += carried[1]
            total[0] += carried[2]
        elif carried:
            terms, pairs, total = [carried[0], *terms], np.append(carried[1], pairs), np.append(carried[2], total)
        carried = (terms[-1], int(pairs[-1]), int(total[-1]))
        last = tuple(batch.column(k)[batch.num_rows - 1].as_py() for k in range(4))
        yield pa.RecordBatch.from_arrays([pa.array(terms[:-1], pa.string()), pa.array(pairs[:-1], pa.int64()), pa.array(total[:-1], pa.int64())], names=["term", "records", "occurrences"])
    if carried:
        yield pa.RecordBatch.from_arrays([pa.array([carried[0]], pa.string()), pa.array([carried[1]], pa.int64()), pa.array([carried[2]], pa.int64())], names=["term", "records", "occurrences"])


def term_pairs(records: DataFrame, key: str = "id", words: str = "words") -> DataFrame:
    """``term, id, form, n``: the entries of all records that count."""
    rows = records.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.explode(words).alias("form", "n"))
    return rows.where("n > 0").select(normal_term(F.col("form")).alias("term"), "id", "form", F.col("n").cast("long").alias("n")).where("term is not null")


def term_frequencies(records: DataFrame, key: str = "id", words: str = "words") -> DataFrame:
    """``term, occurrences, records, mark``: every term; the mark is ``rare``, ``common`` or null."""
    pairs = term_pairs(records, key, words)
    ordered = pairs.repartitionByRange("term", "id").sortWithinPartitions("term", "id", "form", "n")
    runs = ordered.mapInArrow(_run_lengths, "term string, records long, occurrences long")
    terms = runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    holds = F.exists(F.map_entries(words), lambda e: (e["value"] > 0) & normal_term(e["key"]).isNotNull())
    holders = records.where(F.col(key).isNotNull() & holds).select(F.countDistinct(key).alias("holders"))  # one row
    up, down = COMMON_ABOVE
    mark = F.when(F.col("records") < RARE_BELOW, "rare").when(F.col("records") * down > F.col("holders") * up, "common")
    return terms.join(F.broadcast(holders)).select("term", "occurrences", "records", mark.alias("mark"))
