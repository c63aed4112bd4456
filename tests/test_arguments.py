import hashlib
import json

from pyspark.sql import functions as F

from trialstats.functions.arguments import args_sha256, matches_schema

SCHEMA = {
    "type": "object", "required": ["record"],
    "properties": {
        "n": {"type": "integer"},
        "record": {"type": "object", "required": ["id"], "properties": {
            "id": {"type": "string"}, "total": {"type": ["number", "null"]},
            "items": {"type": "array", "items": {"type": "object"}}}},
    },
}
CASES = {
    '{"record": {"id": "a"}}': True, '{"record": {"id": "a", "total": 1.5}, "n": 2}': True,
    '{"record": {"id": "a", "total": null}}': True, '{"record": {"id": 1}}': False, '{"record": {}}': False,
    '{"n": 1}': False, '{"record": {"id": "a"}, "n": true}': False, '{"record": {"id": "a"}, "n": 1.0}': False,
    '{"record": {"id": "a", "total": true}}': False, '[1]': False, '{"record": {"id": "a", "items": 3}}': False,
    '{"record": {"id": "a", "extra": 9}}': True,
}


def test_schema_predicate(spark):
    df = spark.createDataFrame([(t,) for t in CASES], "t string")
    got = {r.t: r.ok for r in df.select("t", matches_schema(F.parse_json("t"), SCHEMA).alias("ok")).collect()}
    assert got == CASES


def test_argument_fingerprint(spark):
    texts = ['{"b": 1, "a": [1, "é"]}', "not json", '{"a":[1,"é"],"b":1}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(args_sha256(F.col("t"))).collect()]
    want = hashlib.sha256(json.dumps({"a": [1, "é"], "b": 1}, separators=(",", ":")).encode()).hexdigest()
    assert got[0] == got[2] == want and got[1] == hashlib.sha256(b'"not json"').hexdigest()


def test_large_integers_and_quoted_keys(spark):
    schema = {"type": "object", "required": ["a.b"], "properties": {"a.b": {"type": "integer"}, 'q"': {"type": ["null", "string"]}}}
    cases = {'{"a.b": 12345678901234567890}': True, '{"a.b": 1.5}': False, '{"a": {"b": 1}}': False,
             '{"a.b": 1, "q\\"": 2}': False, '{"a.b": 1, "q\\"": null}': True}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.ok for r in df.select("t", matches_schema(F.parse_json("t"), schema).alias("ok")).collect()} == cases
