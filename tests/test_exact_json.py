"""Exact decoding of messages: what ``json.loads`` accepts, refuses and returns."""

import hashlib
import json

from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from roverlake.functions.exact_json import _Constant, _members, object_fields
from roverlake.operators import envelope as env
from roverlake.operators import route as rt
from roverlake.operators import status as st

KEYS = ("a", "b", "é")
TEXTS = [
    "{}", " {} ", '{"a":1}', '{"a":1,"a":2}', '{"a":{"a":1,"a":2},"b":[1, 2]}', '{"a":NaN}', '{"a":-Infinity,"b":Infinity}', '{"a":1} x', '{"a":1}{"a":2}', '{"a":1,}', "{,}", '{"a"}', '{"a":}',
    '{"a" : "x\\u0041\\n" , "b":true}', '{"\\u0061":7}', '{"a":"\\ud83d\\ude00","b":"\\ud800"}', '{"a":"\\u0000"}', '{"a":"tab\there"}', '{"a":1.50,"b":1e400}', '{"a":%s}' % ("123456789" * 5),
    '{"a":%s}' % ("9" * 5000), '{"a":[[[]]],"b":null}', '{"é":"ü","b":"\\""}', "[1,2]", '"text"', "null", "NaN", "12 13", "", " ", "{bad", "{'a':1}", '{"a":01}', '{"a":+1}', '{"a":tru}', "﻿{}",
    '{"a":' * 200_000 + "1" + "}" * 200_000, '{"a":\n\t"x"\r\n}', '{"a":1 "b":2}', '{"a":1,,"b":2}', '{"a":1]', '{"a":"x', '{a:1}', '{"a":1}\x00', '{"b":false,"a":-0.0}', '{"a":"NaN"}', '{"a":{"x":[NaN]}}',
]


def expected(text):
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return "malformed", None
    return ("object", value) if isinstance(value, dict) else ("other", None)


def same(a, b):
    return json.dumps(a) == json.dumps(b)


def test_fields_equal_json_loads(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, raw string").withColumn("m", object_fields("raw", KEYS))
    for r in rows.orderBy("i").collect():
        state, value = expected(TEXTS[r.i])
        assert r.m["state"] == state, TEXTS[r.i][:50]
        for key in KEYS:
            field = r.m[key]
            if state != "object" or key not in value:
                assert tuple(field) == (None, None, None, None)
                continue
            assert field["json"] in TEXTS[r.i] and same(json.loads(field["json"]), value[key])
            if field["kind"] == "string" and field["storable"]:
                assert field["text"] == value[key]
            assert field["kind"] == {str: "string", bool: "boolean", dict: "object", list: "array", type(None): "null"}.get(type(value[key]), "number")
    odd = {r.raw: r.m["a"]["storable"] for r in rows.where("length(raw) < 100").collect()}
    assert [odd[t] for t in ('{"a":NaN}', '{"a":"\\u0000"}', '{"a":{"x":[NaN]}}', '{"a":"NaN"}', '{"a":1}')] == [False, False, False, True, True]
    assert not rows.where("raw like '%ud800%'").first().m["b"]["storable"]


def test_null_and_broken_bytes(spark):
    rows = spark.createDataFrame([(0, None), (1, bytearray(b'{"a":"\xff"}')), (2, bytearray(b'{"a":1}'))], "i int, raw binary").withColumn("m", object_fields("raw", ["a"]))
    assert [r.m["state"] for r in rows.orderBy("i").collect()] == [None, "malformed", "object"]
    assert spark.createDataFrame([], "raw string").select(object_fields("raw", ["a"])).count() == 0


VALUES = hs.recursive(hs.none() | hs.booleans() | hs.integers() | hs.floats() | hs.text(max_size=8), lambda c: hs.lists(c, max_size=3) | hs.dictionaries(hs.text(max_size=4), c, max_size=3), max_leaves=8)


@settings(max_examples=300, deadline=None)
@given(hs.lists(hs.tuples(hs.sampled_from(["a", "b", "c", "é"]), VALUES), max_size=5), hs.booleans(), hs.sampled_from(["", " ", "\n\t"]), hs.sampled_from(["", " ", "x", "}", "\t"]), hs.integers(0, 400))
def test_members_of_any_object(pairs, ascii_only, blank, tail, cut):
    """Repeated keys, blanks, tails and texts cut short: members and refusals of json.loads."""
    text = "{" + ",".join(f"{blank}{json.dumps(k, ensure_ascii=ascii_only)}{blank}:{blank}{json.dumps(v, ensure_ascii=ascii_only)}{blank}" for k, v in pairs) + "}" + tail
    value_at = json.JSONDecoder(parse_constant=_Constant).raw_decode
    for t in (text, text[:cut]):
        state, value = expected(t)
        try:
            found = _members(t, frozenset("abcé"), value_at)
        except ValueError:
            assert state == "malformed"
            continue
        assert state == ("other" if found is None else "object")
        if found is not None:
            assert found.keys() == value.keys() and all(same(json.loads(t[a:b]), value[k]) for k, (a, b, _) in found.items())


def test_envelopes_keep_bytes_and_refuse_what_cannot_be_stored(spark):
    at = '"timestamp":"2025-01-01T00:00:00"'
    raws = [
        '{"robot_id":"ghost","robot_id":"r1",%s,"data":{ "k" : 1.0, "k":2 },"metadata":[1, 2]}' % at,
        '{"robot_id":"r1",%s,"data":{"k":NaN}}' % at,
        '{"robot_id":"r1","data_type":"sensor_image",%s,"data":{"k":NaN}}' % at,
        '{"robot_id":"r1",%s} trailing' % at,
        '{"robot_id":"r1",%s,"data":{"k":%s}}' % (at, "123456789" * 5),
        '{"robot_id":"r1",%s,"data":{"s":"\\u0000"}}' % at,
        '{"robot_id":12,%s,"data":"%s"}' % (at, "x" * 20_000_000),
        '{"robot_id":"r1","data_type":"status",%s,"data":{"status":"old","status":"new","location":{"b":1, "a":2}}}' % at,
    ]
    parsed = env.parse_envelope(spark.createDataFrame(list(enumerate(raws)), "arrival_seq long, raw string"))
    got = {r.arrival_seq: r for r in parsed.collect()}
    assert [got[i].reject_reason for i in range(8)] == [None, "not_storable", None, "malformed_json", None, "not_storable", None, None]
    assert (got[0].robot_id, got[0].data, got[0].metadata) == ("r1", '{ "k" : 1.0, "k":2 }', "[1, 2]")
    assert got[4].data == '{"k":%s}' % ("123456789" * 5) and got[6].robot_id == "12" and len(got[6].data) == 20_000_002
    blob = rt.blob_rows(env.accepted(parsed)).first()
    assert bytes(blob.payload) == b'{"k":NaN}' and blob.length == 9
    status = st.status_rows(env.accepted(parsed).where("data_type = 'status'").withColumn("time", F.col("ts"))).first()
    assert (status.status, status.location) == ("new", '{"b":1, "a":2}')
    assert hashlib.sha256(blob.payload).hexdigest() == rt.blob_rows(env.accepted(parsed)).select(F.sha2("payload", 256)).first()[0]
