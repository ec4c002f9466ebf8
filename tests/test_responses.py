"""Response schemas and answers."""

import json

import pytest
from docweave.functions import responses as P
from pyspark.sql import functions as F

USER = {"n": {"type": ["string", "null"], "enum": ["a", None], "description": "d"}, "r": {"type": "array", "items": {"type": "object", "properties": {"x": {"type": "number"}, "y": {"type": "boolean"}}}}}


def test_checked():
    assert P.checked(USER) == 3
    deep = {"type": "string"}
    for _ in range(5):
        deep = {"type": "object", "properties": {"k": deep}}
    cases = [({}, "empty"), ([], "empty"), ({"a": {"$ref": "#"}}, "cycle"), ({"a": deep}, "too_deep"), ({"a": {"type": "date"}}, "unsupported"), ({"a": 1}, "unsupported"), ({"a": {"type": "object"}}, "malformed"), ({"a": {"type": "array"}}, "malformed"), ({str(i): {} for i in range(1001)}, "too_wide")]
    for schema, kind in cases:
        with pytest.raises(P.SchemaError) as e:
            P.checked(schema)
        assert e.value.kind == kind, schema
    assert P.checked({"a": deep["properties"]["k"]}) == 1 and P.checked({str(i): {} for i in range(1000)}) == 1000


def test_response_schema():
    got = P.response_schema(USER)
    leaf = got["properties"]["n"]
    assert leaf["type"] == "OBJECT" and leaf["required"] == ["value", "chunks", "quote"] and leaf["properties"]["value"] == {"type": "STRING", "nullable": True, "enum": ["a"]} and leaf["description"] == "d"
    assert got["properties"]["r"]["items"]["properties"]["x"]["properties"]["value"]["type"] == "NUMBER" and "required" not in got
    plain = P.response_schema(USER, wrap=False, optional=True)
    assert plain["required"] == [] and plain["properties"]["r"]["items"]["required"] == [] and plain["properties"]["r"]["items"]["properties"]["y"] == {"type": "BOOLEAN", "nullable": True, "description": ""}
    assert list(P.response_schema(USER, chunk_ids=False)["properties"]["n"]["properties"]) == ["value", "quote"]
    assert P.dialect({"type": "string", "enum": [None], "title": "t"}) == {"type": "STRING"}


def test_aliases():
    assert [P.alias(i) for i in (0, 25, 26, 27, 701, 702)] == ["a", "z", "aa", "ab", "zz", "aaa"]
    assert len({P.alias(i) for i in range(20_000)}) == 20_000
    maps = P.row_aliases(USER)
    assert maps == {"r": {"a": "x", "b": "y"}}
    short = P.aliased(P.response_schema(USER, wrap=False, optional=True), maps)
    assert list(short["properties"]["r"]["items"]["properties"]) == ["a", "b"] and list(P.response_schema(USER)["properties"]["r"]["items"]["properties"]) == ["x", "y"]
    assert P.unaliased({"r": [{"a": 1, "q": 2}, 7], "n": "a"}, maps) == {"r": [{"x": 1, "q": 2}, 7], "n": "a"} and P.unaliased([1], maps) == [1]


def test_answers(spark):
    node = {"type": "object", "properties": USER}
    assert P.rehydrated({"r": [{}]}, node, wrap=False) == {"n": None, "r": [{"x": None, "y": None}]}
    assert P.rehydrated({}, node) == {"n": {"value": None, "chunks": [], "quote": ""}, "r": []}
    assert P.rehydrated({"n": 1, "more": 2}, node, wrap=False) == {"n": 1, "more": 2, "r": []}
    assert P.unwrapped({"n": {"value": "", "quote": ""}, "r": [{"x": {"value": 1, "chunks": [], "quote": "q"}}]}) == {"n": None, "r": [{"x": 1}]}
    assert P.has_content({"a": [None, {"b": 0}]}) and not P.has_content({"a": [None, {}], "b": None})
    df = spark.createDataFrame([(1, '{"r": [{"a": 5}]}'), (2, "["), (3, None)], "i int, answer string")
    got = {r.i: r for r in P.answers(df, USER, wrap=False).collect()}
    assert json.loads(got[1].restored) == {"n": None, "r": [{"x": 5, "y": None}]} and got[2].restored is None and got[3]["values"] is None


def test_designed():
    fields = [{"name": " a "}, {"name": "a"}, {"name": "b.c"}, {"name": "x[]"}, {"name": ""}, 3, {"name": "d", "type": "number", "description": None}, *({"name": f"f{i}"} for i in range(60))]
    got = P.designed(fields)
    assert list(got)[:2] == ["a", "d"] and got["a"]["type"] == "string" and got["d"] == {"type": "number", "description": ""} and len(got) == 40
    with pytest.raises(P.SchemaError):
        P.designed([])


def test_columns(spark):
    df = spark.createDataFrame([("date", "x"), (None, "DOB"), (None, None), ("text", "y")], "kind string, key string")
    assert [r[0] for r in df.select(P.normalized_datetime(F.col("kind"), F.col("key"), ("dob",))).collect()] == [True, True, False, False]
