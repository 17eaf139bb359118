"""Merging of request bodies by paths against a recursive form."""

import json

from quillmill.operators import bodies, catalog

CASES = [
    ({"a": {"b": 1, "c": [1]}, "m": 0}, {"a": {"c": [2], "d": 3}, "model": 1}), ({}, {"x": {"y": {}}}), ({"a": 1}, {"a": {"b": {}}}), ({"a": {"b": 1}}, {"a": {}}), ({"a": {"b": 1}}, {"a": 2, 'q"\\é': None}),
    ({"a": {}}, {"a": {"z": "1"}}), ({"a": 1}, {}), ({"a": 1}, {"a": {}}), ({"a": {"b": {"c": 1}}}, {"a": {"b": {"c": {"d": True}}}}), ({"a": {"b": 1}}, None), ({"model": "m", "s": {"model": 1}}, {"s": {"model": 2}, "stream": True}),
    ({"a.b": {"": 1}, "a": {"b": 2}}, {"a.b": {"": [{"k": {}}]}}),
]


def test_merge_against_recursive_form(spark):
    rows = [(i, json.dumps(b), None if c is None else json.dumps(c)) for i, (b, c) in enumerate(CASES)]
    got = {r.id: r for r in bodies.merged(spark.createDataFrame(rows, "id long, base string, change string"), "id", "base", "change").collect()}
    for i, (base, change) in enumerate(CASES):
        assert json.loads(got[i].merged) == catalog.deep_merged(base, change or {}, bodies.PROTECTED) and got[i].error is None


def test_what_is_no_object(spark):
    rows = [(1, '{"a":1}', "[1]"), (2, '{"a":1}', "nope"), (3, '{"a":1}', "null"), (4, '{"b":{"a":1}}', '{"b":3}')]
    got = {r.id: (r.merged, r.error) for r in bodies.merged(spark.createDataFrame(rows, "id long, base string, change string"), "id", "base", "change").collect()}
    assert got == {1: (None, bodies.NOT_AN_OBJECT), 2: (None, bodies.NOT_AN_OBJECT), 3: ('{"a":1}', None), 4: ('{"b":3}', None)}
    assert bodies.merged(spark.createDataFrame([], "id long, base string, change string"), "id", "base", "change").collect() == []


def test_rows_are_merged_alone(spark):
    odd = [("5", '{"x":1}'), ("5", "{}"), ("5", '{"model":1}'), (None, '{"x":{"y":{}}}'), ("nope", "{}"), ("[1]", None), ('{"a":{"b":null}}', '{"a":{"c":null}}'), ('{"a":null}', '{"a":{"c":"}{"}}'), ('{"a":1.50,"b":12345678901234567890,"c":[{"z":1,"a":2}]}', '{"c":{"\\u00e9":1e3}}'), ("null", "null")]
    nested = lambda n, end: "".join(f'{{"k{i}":' for i in range(n)) + end + "}" * n
    texts = [*odd, *((json.dumps(b), None if c is None else json.dumps(c)) for b, c in CASES), *((nested(n, '{"u":1}'), nested(n, '{"v":2}')) for n in (1, 5))]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id long, base string, change string")
    got = {r.id: (r.merged, r.error) for r in bodies.merged(rows, "id", "base", "change").collect()}
    assert got == {r.id: (r.merged, r.error) for r in bodies.by_paths(rows, "id", "base", "change").collect()}
    assert json.loads(got[len(texts) - 1][0]) == json.loads(nested(5, '{"u":1,"v":2}'))
    plan = bodies.merged(rows.filter("id < 20"), "id", "base", "change")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
