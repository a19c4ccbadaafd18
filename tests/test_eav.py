import datetime as dt

from tesselark.operators import eav

from .conftest import rows

CLAIMS = "claim_id long, id long, property string, claim_value string, claim_rank string, recorded_at timestamp, slot int, code string, row string"
PROPS = [("P31", "item", "kind", 1), ("P569", "date", "born", 1), ("P9003", "quantity", "people", 1), ("P9005", "text", "label", 1)]


def at(n):
    return dt.datetime(2023, 1, 1) + dt.timedelta(hours=n)


def claims(spark, data):
    """Claims with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(*r, 7, "x", "y") for r in data], CLAIMS)


def properties(spark):
    return spark.createDataFrame(PROPS, "property string, datatype string, label string, id int")


def cells(spark, data):
    return rows(eav.filled_cells(claims(spark, data), properties(spark)))


def test_rank_then_time_then_id(spark):
    data = [
        (1, 10, "P31", "Q1", "normal", at(9)), (2, 10, "wdt:p31 ", "Q2", " Preferred", at(1)), (3, 10, "P31", "Q3", "deprecated", at(20)),
        (4, 11, "P31", "Q1", None, at(1)), (5, 11, "P31", "Q2", "", at(2)), (6, 12, "P31", "Q1", None, at(1)), (7, 12, "P31", "Q9", None, at(1)),
    ]
    assert cells(spark, data) == [(10, "P31", 2), (11, "P31", 5), (12, "P31", 7)]


def test_latest_delivery_counts_even_if_it_fills_nothing(spark):
    data = [
        (1, 10, "P31", "Q1", "preferred", at(1)), (1, 10, "P31", None, "preferred", at(2)), (2, 10, "P31", "Q2", "normal", at(0)),
        (3, 11, "P31", "Q5", "normal", at(1)), (3, 11, "P31", "Q5", "normal", at(1)), (4, 12, "P31", "Q5", "normal", at(1)), (4, 0, "P31", "Q5", "normal", at(3)),
    ]
    assert cells(spark, data) == [(10, "P31", 2), (11, "P31", 3)]


def test_nulls_and_unknown_codes(spark):
    data = [(None, 10, "P31", "Q1", "normal", at(1)), (1, None, "P31", "Q1", "normal", at(1)), (2, 0, "P31", "Q1", "normal", at(1)), (3, 10, None, "Q1", None, None), (4, 10, "P7", "Q1", None, at(1)), (5, 13, "P31", "Q1", None, None)]
    assert cells(spark, data) == [(10, "P31", None), (13, "P31", 5)]


def test_values_by_datatype(spark):
    good = {
        "P31": ["Q12", " q12 ", "wd:Q12", '{"entity-type":"item","id":"Q12"}'],
        "P569": ["+1723-04-11T00:00:00Z", "1723-04-11", "11 April 1723", "April 11, 1723", '{"time":"+1723-04-11T00:00:00Z","precision":11}'],
        "P9003": ["1234", "+1234", "1,234", "1.234e+03", '{"amount":"+1234","unit":"1"}'],
        "P9005": ["a label", " a label  "],
    }
    bad = {
        "P31": ["Q", "Q12x7", "Q1 Q2", "{}", '{"id":null}', "", "?", None, "Q0", "somevalue"],
        "P569": ["1723-02-30", "31 February 1932", "+1723-00-00T00:00:00Z", '{"time":"+1723-04-11T00:00:00Z","precision":9}', "1723", "Q5", "null", "Undecember 3, 1700"],
        "P9003": ["12..5", "1,2,3x", "+", "about ten", "12,34", "null", "1e9999"],
        "P9005": ["", "   ", None],
    }
    data, n = [], 0
    for p, values in good.items():
        for v in values:
            n += 1
            data.append((n, n, p, v, "normal", at(1)))
    kept = n
    for p, values in bad.items():
        for v in values:
            n += 1
            data.append((n, n, p, v, "normal", at(1)))
    assert [r[0] for r in cells(spark, data)] == sorted(range(1, kept + 1), key=lambda i: repr((i, data[i - 1][2], i)))
    wide = eav.wide_table(claims(spark, data), properties(spark)).collect()
    assert {r["P31"] for r in wide} - {None} == {"Q12"}
    assert {r["P569"] for r in wide} - {None} == {dt.date(1723, 4, 11)}
    assert {r["P9003"] for r in wide} - {None} == {1234.0}
    assert {r["P9005"] for r in wide} - {None} == {"a label"}


def test_empty_tables_and_long_text(spark):
    assert cells(spark, []) == []
    assert eav.wide_table(claims(spark, []), properties(spark)).columns[:3] == ["id", "P31", "P31__claim_id"]
    assert rows(eav.filled_cells(claims(spark, [(1, 1, "P31", "Q1", None, at(1))]), properties(spark).where("false"))) == []
    long = "x" * 200_000
    wide = eav.wide_table(claims(spark, [(1, 1, "P9005", long, None, at(1))]), properties(spark)).collect()
    assert wide[0]["P9005"] == long


def test_one_entity_with_most_rows(spark):
    data = [(i, 7 if i % 3 else i, "P31", f"Q{i}", "normal", at(i % 50)) for i in range(1, 3000)]
    got = dict((r[0], r[2]) for r in cells(spark, data))
    best = max((r for r in data if r[1] == 7), key=lambda r: (r[5], r[0]))
    assert got[7] == best[0] and len(got) == 1 + sum(1 for r in data if r[1] != 7)


def test_codes_in_two_spellings_are_one_attribute(spark):
    twice = spark.createDataFrame([("P31", "item"), ("p31", None), ("P5", None), ("P5", "quantity"), (None, "item")], "property string, datatype string")
    assert [(a.name, a.datatype) for a in eav.listed_attributes(twice)] == [("P31", "item"), ("P5", "quantity")]


def test_groups_side_by_side(spark):
    """More attributes than one group holds, some without a statement; each column has the type of its attribute."""
    kinds = ["item", "date", "quantity", "text", "other"]
    listed = spark.createDataFrame([(f"P{i}", kinds[i % 5]) for i in range(1, 24)], "property string, datatype string")
    value = {"item": "Q5", "date": "2001-02-03", "quantity": "7", "text": "x", "other": "y"}
    data = [(100 * e + i, e, f"P{i}", value[kinds[i % 5]], None, at(1)) for e in range(1, 6) for i in range(1, 24) if (e + i) % 3]
    wide = eav.wide_table(claims(spark, data), listed)
    assert {f.name: f.dataType.simpleString() for f in wide.schema if f.name in ("P1", "P2", "P3", "P4", "P5")} == {"P1": "date", "P2": "double", "P3": "string", "P4": "string", "P5": "string"}
    got = {(r.id, i): (r[f"P{i}"], r[f"P{i}__claim_id"]) for r in wide.collect() for i in range(1, 24)}
    typed = {"Q5": "Q5", "2001-02-03": dt.date(2001, 2, 3), "7": 7.0, "x": "x", "y": "y"}
    want = {(r[1], int(r[2][1:])): (typed[r[3]], r[0]) for r in data}
    assert {k: v for k, v in got.items() if v != (None, None)} == want
    assert rows(eav.filled_cells(claims(spark, data), listed)) == sorted([(e, f"P{i}", c) for (e, i), (_, c) in want.items()], key=repr)
