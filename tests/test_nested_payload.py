"""No plain value and no empty array or object of a nested record is lost."""

import json

from fleetweave.operators import nested


def payloads(text, **kw):
    return {p: own for _, p, _, _, own in nested.visit(nested.parse(text), **kw)}


def test_arrays_in_arrays():
    assert payloads('{"grid":[[1,2],[3],[[4],{"a":5}]],"e":[],"o":{},"deep":{"o":{}},"l":["x",[],{}]}') == {
        "": {"grid[0]": [1, 2], "grid[1]": [3], "grid[2][0]": [4], "e": [], "o": {}, "deep.o": {}, "l": ["x"], "l[1]": []},
        "grid[2][1]": {"a": 5}, "l[2]": {},
    }


def test_array_at_the_root():
    assert payloads('["a",{"b":1},[2]]') == {"": {"": ["a"], "[2]": [2]}, "[1]": {"b": 1}}
    assert payloads("[]") == {"": {"": []}} and payloads('[{"b":1}]') == {"[0]": {"b": 1}}


def test_found_rows_stay():
    assert payloads('["a",{"b":[[1]]},[2]]', payload=False) == {"[1]": {}}


def test_flatten_keeps_payload(spark):
    df = spark.createDataFrame([("k", '{"grid":[[1,2],[3]],"e":[]}'), ("r", "[7]")], "id string, t string")
    got = {r.rec_key: json.loads(r.payload) for r in nested.flatten(df, "id", "t").collect()}
    assert got == {"k": {"grid[0]": [1, 2], "grid[1]": [3], "e": []}, "r": {"": [7]}}
