"""YAML texts against what they mean; an API gives the same operations from both notations."""

import json

import pytest

from strataloom.functions.yaml import yaml_to_json
from strataloom.operators import contracts as N

CASES = [("a: 1\nb:\n  - x\n  - y: 2\n    z: [1, 'q', {k: v, n: null}]\nc: {d: e}\n", {"a":1,"b":["x",{"y":2,"z":[1,"q",{"k":"v","n":None}]}],"c":{"d":"e"}}),
("a:\n- 1\n- 2\nb: 3",{"a":[1,2],"b":3}),
("a: |\n  line 1\n   deeper\n\n  last\nb: >-\n  folded\n  text\n\n  para\n",{"a":"line 1\n deeper\n\nlast\n","b":"folded text\npara"}),
("'q k': \"x\\ty\\u00e9\"\n\"k2\": 'it''s' # c\n200: ok\ntrue: t\n",{"q k":"x\ty\u00e9","k2":"it's","200":"ok","true":"t"}),
("# c\n---\na: &x {b: 1}\nc: *x\n",{"a":{"b":1},"c":{"b":1}}),
("a: plain text\n  goes on\nb: http://x.y/z#frag # comment\nc: a:b\n",{"a":"plain text goes on","b":"http://x.y/z#frag","c":"a:b"}),
("- a\n- - b\n  - c\n-\n  d: 1\n- \n",["a",["b","c"],{"d":1},None]),
("a: [1,\n  2, # x\n  3]\nb: 0x1F\nc: 1.5e3\nd: ~\ne: yes\nf: .inf\n",{"a":[1,2,3],"b":31,"c":1500.0,"d":None,"e":"yes","f":None}),
("a: 1\na: 2",None),("a: 1\n---\nb: 2",None),("\ta: 1",None),("? a\n: b",None),("a: b: c",None),("",None),("just text","just text"),("a:\n  b:\n    c: 1\n  d: 2\ne:",{"a":{"b":{"c":1},"d":2},"e":None}),
("a: \"two\n  lines\"\nb: 1",{"a":"two lines","b":1}),
("paths:\n  /a/{id}:\n    get:\n      parameters:\n        - name: id\n          required: true\n      responses:\n        '200':\n          description: ok\n",{"paths":{"/a/{id}":{"get":{"parameters":[{"name":"id","required":True}],"responses":{"200":{"description":"ok"}}}}}}),
("{\"n\": 5, \"a\": [true]}",{"n":5,"a":[True]}),("a: |+\n  x\n\n\nb: 1",{"a":"x\n\n\n","b":1}),("a: !!str 12\nb: !t x",{"a":"12","b":"x"}),("- 'a'\n- \"b\"\n",["a","b"]),("a:   \n   # note\n   - 1\n",{"a":[1]}),("a: [",None),("a: 'open",None),("- a\n b: 1",None),("key: - x",{"key":"- x"}),("a: {b: 1, c}",{"a":{"b":1,"c":None}}),
]


@pytest.mark.parametrize("text, want", CASES)
def test_values(text, want):
    got = yaml_to_json(text)
    assert (None if got is None else json.loads(got)) == want


def test_what_is_no_yaml_is_null():
    for text in ("a: 1\na: 2", "a: 1\n---\nb: 2", "\ta: 1", "? a\n: b", "a: b: c", "a: [", "a: 'open", "- a\n b: 1", "*none", "a: {b: 1, b: 2}", "[1, 2}", "a: [1] x"):
        assert yaml_to_json(text) is None, text
    assert yaml_to_json(None) is None and yaml_to_json("") == "null"
    assert yaml_to_json("[" * 50_000) is None and json.loads(yaml_to_json("\n".join(f"k{i}: {i}" for i in range(20_000))))["k19999"] == 19999


def test_round_trip():
    """JSON is YAML."""
    value = {"a": [1, 2.5, None, True, "x: y # z", {"n": []}], "b c": {"é\n": "'\"\\"}, "": {}}
    for text in (json.dumps(value), json.dumps(value, indent=2), json.dumps(value, ensure_ascii=False, indent=1)):
        assert json.loads(yaml_to_json(text)) == value


def test_one_api_in_two_notations(spark):
    api = {"openapi": "3.1", "paths": {"/a/{id}": {"get": {"operationId": "one", "parameters": [{"required": True}], "responses": {"200": {"content": {"x": {"schema": {"$ref": "#/c/R"}}}}}}}}, "components": {"schemas": {"R": {"type": "object", "required": ["a"], "properties": {"a": {}}}}}}
    yaml = """
openapi: 3.1.0
paths:
  /a/{id}:
    get:
      operationId: one
      parameters: [{required: true}]
      responses:
        '200': {content: {x: {schema: {$ref: '#/c/R'}}}}
components:
  schemas:
    R: {type: object, required: [a], properties: {a: {}}}
"""
    files = spark.createDataFrame([("j", json.dumps(api)), ("y", yaml), ("n", "no: api"), ("b", "a: ["), ("0", None)], "path string, text string")
    for rows in (N.api_operations(files).collect(), N.api_schemas(files).collect()):
        by = {r.path: tuple(r)[1:] for r in rows}
        assert set(by) == {"j", "y"} and by["j"] == by["y"]
