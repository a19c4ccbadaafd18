import json
import random

import numpy as np
import pyarrow as pa
import pytest

from tesselark.operators import nested

from .conftest import rows


def brute(text, table):
    out = []

    def walk(value, path, key, pos):
        if not path:
            if value is None:
                return
            fields = {}
            for name, steps in table.fields.items():
                v = value
                for s in steps:
                    v = v.get(s) if isinstance(v, dict) else None
                fields[name] = v
            out.append((key, pos, fields))
            return
        step, rest = path[0], path[1:]
        if step == "*" and isinstance(value, dict):
            for k, v in value.items():
                walk(v, rest, k, pos)
        elif step == "[]" and isinstance(value, list):
            for i, v in enumerate(value):
                walk(v, rest, key, i)
        elif isinstance(value, dict) and step in value:
            walk(value[step], rest, key, pos)

    walk(json.loads(text), table.path, None, 0)
    return out


def value(r, depth=0):
    kind = r.randrange(8 if depth < 4 else 5)
    if kind < 3:
        return r.choice(["", "a", 'q"uo\\te', "{x:[1]}", "ü\n", "null", " ", ",:", "\\"])
    if kind == 3:
        return None
    if kind == 4:
        return r.choice([0, -1, True])
    if kind == 5:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {r.choice(["mainsnak", "k", 'a"b', "", "é", "rank"]): value(r, depth + 1) for _ in range(r.randrange(4))}


@pytest.mark.parametrize("seed", range(8))
def test_spans_equal_a_parser(seed):
    r = random.Random(seed)
    table = nested.ChildTable("c", ("claims", "*", "[]"), {"rank": ("rank",), "deep": ("mainsnak", "k")})
    texts = [json.dumps({"x": value(r), "claims": {f"P{i}": [value(r) for _ in range(r.randrange(4))] for i in range(r.randrange(4))}}, ensure_ascii=r.random() < 0.5, indent=r.choice([None, 2])) for _ in range(60)]
    part = nested.Records(pa.array(["cut off", *texts])[1:]).children(table)
    got = {k: v.tolist() if isinstance(v, np.ndarray) else v.to_pylist() for k, v in part.items()}
    flat = [(n, *x) for n, t in enumerate(texts) for x in brute(t, table)]
    live = range(len(got["record"]))
    assert sorted((got["record"][j], got["child_key"][j], got["pos"][j]) for j in live) == sorted(x[:3] for x in flat)
    want = {x[:3]: x[3] for x in flat}
    for j in live:
        for name in table.fields:
            w = want[got["record"][j], got["child_key"][j], got["pos"][j]][name]
            g = got[name][j]
            if isinstance(w, str):
                assert g == w
            elif w is None:
                assert g is None
            elif isinstance(w, dict | list):
                assert json.loads(g) == w


def test_keys_and_values_written_with_escapes():
    texts = ['{"cl\\u0061ims": {"\\u0050\\"1": [{"r\\u0061nk": "\\ud83d\\ude42 \\t\\/ \\\\n \\ud83d"}, null, 1.5e3]}}', "", '{"claims": {"P2": [ {"rank" : null} , {"rank": true } ]}}']
    got = nested.Records(pa.array(texts)).children(nested.ChildTable("c", ("claims", "*", "[]"), {"rank": ("rank",)}))
    assert got["record"].tolist() == [0, 0, 2, 2] and got["pos"].tolist() == [0, 2, 0, 1]
    assert got["child_key"].to_pylist() == ['P"1', 'P"1', "P2", "P2"]
    assert got["rank"].to_pylist() == ["\U0001f642 \t/ \\n \ufffd", None, None, "true"]


RAW = "line_no long, id string, sitelinks map<string,struct<site:string,title:string,url:string>>, claims map<string,array<struct<mainsnak:struct<property:string,datavalue:struct<value:string>>,rank:string>>>, same string, record int"


def claim(v, rank="normal", snak=True, data=True):
    return ((("P1", (v,) if data else None) if snak else None), rank)


def test_entities(spark):
    one = ({"enwiki": ("enwiki", "Title", "u"), "x": ("x", " ", None), "y": None}, {"P1": [claim('{"id": "Q1"}'), None, claim(None), claim("null"), claim(" "), claim("x", snak=False), claim("x", data=False), claim('"t"')], "P2": None, "P3": []})
    data = [(5, "Q5", *one), (3, "Q5", *one), (4, "Q6", None, None), (6, None, {}, {}), (7, "Q7", None, {"P9": [claim("a" * 300_000)]})]
    df = spark.createDataFrame([(*r, "s", 1) for r in data], RAW)
    assert rows(nested.linked_rows(df)) == sorted([(3, "claim", "P1", 0), (3, "claim", "P1", 7), (3, "sitelink", "enwiki", 0), (7, "claim", "P9", 0)], key=repr)
    assert rows(nested.distinct_records(df).select("line_no", "id")) == sorted([(3, "Q5"), (4, "Q6"), (6, None), (7, "Q7")], key=repr)
    assert rows(nested.linked_rows(df.where("false"))) == []
