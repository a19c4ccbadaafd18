import datetime as dt

from tesselark.operators import snapshots

from .conftest import rows

SCHEMA = "corpus string, id long, title string, loaded_at timestamp, __n int, __key string"


def table(spark, data):
    return spark.createDataFrame([(c, i, t, dt.datetime(2023, 1, 1, h), 1, "k") for c, i, t, h in data], SCHEMA)


def found(spark, data):
    return rows(snapshots.page_changes(table(spark, data)).select("corpus", "id", "change_kind"))


def test_added_removed_changed(spark):
    data = [("1", 1, "A", 1), ("1", 2, "B", 1), ("1", 3, "C", 1), ("2", 1, "A", 1), ("2", 2, "B2", 1), ("2", 4, "D", 1), ("3", 3, "C", 1), ("3", 4, "D", 1)]
    assert found(spark, data) == sorted([("2", 2, "changed"), ("2", 3, "removed"), ("2", 4, "added"), ("3", 1, "removed"), ("3", 2, "removed"), ("3", 3, "added")], key=repr)


def test_latest_row_of_a_dump_counts_and_spellings_are_equal(spark):
    data = [("1", 1, "old", 5), ("1", 1, "a_b", 9), ("1", 1, "a_b", 9), ("2", 1, "A  b#x", 1), ("1", 2, None, 1), ("2", 2, None, 1), ("1", 3, None, 1), ("2", 3, "x", 1), ("1", 0, "z", 1), ("2", None, "z", 1), (None, 7, "z", 1)]
    assert found(spark, data) == [("2", 3, "changed")]


def test_empty_and_single(spark):
    assert found(spark, []) == []
    assert found(spark, [("1", 1, "A", 1)]) == []


def test_hot_key_and_typed_changes(spark):
    data = [("1", 7, f"t{i}", i % 20) for i in range(500)] + [("2", 7, "x", 1)] + [("2", i, "y" * 50_000, 1) for i in range(100, 103)]
    got = snapshots.page_changes(table(spark, data)).where("id = 7").first()
    assert (got.change_kind, got.title_before, got.title_after, got.changed_columns) == ("changed", "T99", "X", ["title"])
    assert len(found(spark, data)) == 4


def test_the_merge_moves_no_row(spark):
    plan = snapshots.page_changes(table(spark, [("1", 1, "A", 1), ("2", 1, "B", 1)]))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "FullOuter" in plan and "Exchange" not in plan


def test_later_snapshots_are_kept_in_the_same_ranges(spark):
    first = [("1", i, f"t{i}", 1) for i in range(1, 400)] + [("2", i, f"t{i}", 1) for i in range(100, 500)]
    later = [("3", i, f"t{i}" if i % 10 else "x", 1) for i in range(50, 900)]
    kept = snapshots.KeptSnapshots(spark, "corpus", "id", ["title"], "loaded_at", ranges=3)
    kept.add(table(spark, first))
    kept.add(table(spark, []))
    kept.add(table(spark, later))
    got = rows(kept.changes().select("corpus", "id", "change_kind"))
    old, new = {r[1]: r[2] for r in first if r[0] == "2"}, {r[1]: r[2] for r in later}
    want = [("2", i, "removed") for i in range(1, 100)] + [("2", i, "added") for i in range(400, 500)]
    want += [("3", i, "added" if i not in old else "changed") for i in new if i not in old or old[i] != new[i]]
    assert got == sorted(want, key=repr)
    plan = kept.changes()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_labels_have_a_bucket_each(spark):
    labels = snapshots.range_labels(spark, 13)
    assert len(set(labels)) == 13
