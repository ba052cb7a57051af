"""Hand-made edge rows for the column functions (FIXTURES §3)."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from roverlake.functions import json as J
from roverlake.functions import sensors as SF
from roverlake.functions.time import iso_format, parse_iso, parse_width, time_bucket
from roverlake.operators import commands as cmd
from roverlake.operators import status as st


def test_key_presence_and_field_text(spark):
    rows = ['{"k":1}', '{"k":null}', "{}", '{"k":"85"}', '{"k":true}', '{"a.b":2}', "[]", "bad{", None]
    df = spark.createDataFrame([(r,) for r in rows], "v string")
    got = df.select(J.has_key("v", "k").alias("h"), J.to_double(J.field_text("v", "k")).alias("x"),
                    J.field_text("v", "a.b").alias("ab")).collect()
    assert [r.h for r in got] == [True, True, False, True, True, False, False, False, False]
    assert [r.x for r in got] == [1.0, None, None, 85.0, None, None, None, None, None]
    assert got[5].ab == "2"


@pytest.mark.parametrize("width", ["1 hour", "5 hours", "7 days", "1 day", "15 minutes", "90 minutes", "1 month", "3 months"])
def test_bucket_origin_matches_time_bucket(spark, width):
    base = dt.datetime(2023, 11, 3, 7, 21, 13, 500000)
    times = [base + dt.timedelta(minutes=37 * i) for i in range(0, 2000, 7)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    got = [r.b for r in df.select(time_bucket("t", width).alias("b")).collect()]
    con = duckdb.connect()
    n, kind = parse_width(width)
    interval = f"{n} months" if kind == "months" else f"{n} seconds"
    want = [con.execute(f"SELECT time_bucket(INTERVAL '{interval}', ?::TIMESTAMP)", [t]).fetchone()[0] for t in times]
    assert got == want


def test_parse_iso_forms(spark):
    cases = {
        "2025-08-27T11:33:34.123456": dt.datetime(2025, 8, 27, 11, 33, 34, 123456),
        "2025-08-27T11:33:34Z": dt.datetime(2025, 8, 27, 11, 33, 34),
        "2025-08-27T11:33:34+08:00": dt.datetime(2025, 8, 27, 3, 33, 34),
        "2025-08-27": dt.datetime(2025, 8, 27),
        "2025-08-27 11:33:34": dt.datetime(2025, 8, 27, 11, 33, 34),
        "20250827T113334": dt.datetime(2025, 8, 27, 11, 33, 34),
        "2025": None, "2025-08": None, "T11:33": None, "": None, "not-a-date": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "s string")
    got = {r.s: r.t for r in df.select("s", parse_iso("s").cast("timestamp_ntz").alias("t")).collect()}
    assert got == cases


def test_parse_iso_agrees_with_fromisoformat(spark):
    dates = ["2025-08-27", "20250827", "2025-W35-3", "2025W353", "2025-W35", "2025W35", "2025-8-27", "2025-13-01", "2025-02-29", "2024-02-29", "2020-W53-7", "2021-W53-1", "0000-01-01", "2025", "2025-08", "202508"]
    times = ["", "T1:2:3", "T11", "T11:33", "T1133", "T113334", "T11:33:34", " 11:33:34", "x11:33:34", "\n11:33", "T11:33:34.5", "T11:33:34,5", "T11:33:34.1234567", "T113334.123", "T11:33:34.", "T", "T24:00", "T11:60", "T11:33:60", "T11:3334"]
    zones = ["", "Z", "z", " UTC", " Europe/Berlin", "+5", "+05", "+0530", "+05:30", "-05:30:15", "+19:00", "+24:00", "-00:60", "Z ", " "]
    texts = [d + t + z for d in dates for t in times for z in (zones if t not in ("", "T") else ("", " ", "Z"))] + ["", " 2025-08-27", "T11:33", "now", None]
    def python(text):
        try:
            t = dt.datetime.fromisoformat(text)
        except (ValueError, TypeError):
            return None
        return t if t.tzinfo is None else t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    df = spark.createDataFrame([(x,) for x in texts], "s string")
    got = {r.s: r.t for r in df.select("s", parse_iso("s").cast("timestamp_ntz").alias("t")).collect()}
    wrong = {x: (got[x], python(x)) for x in texts if got[x] != python(x)}
    assert not wrong


def test_iso_format_drops_zero_fraction(spark):
    df = spark.createDataFrame([(dt.datetime(2025, 1, 2, 3, 4, 5),), (dt.datetime(2025, 1, 2, 3, 4, 5, 120),)],
                               "t timestamp_ntz")
    assert [r.s for r in df.select(iso_format("t").alias("s")).collect()] == [
        "2025-01-02T03:04:05", "2025-01-02T03:04:05.000120"]


def test_typed_getters(spark):
    rows = ['{"battery":85.5,"status":"ok","position":{"x":1,"y":"2"}}', '{"battery":"85","status":5,"position":3}',
            '{"battery":true,"status":null,"position":{}}', '{"battery":null}', "{}",
            '{"battery":{"v":1},"position":{"x":{"a":1},"z":2.5}}']
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    got = df.select(J.number_or("d", "battery").alias("b"), J.string_or("d", "status").alias("s"),
                    J.position_of("d").alias("p")).collect()
    assert [r.b for r in got] == [85.5, 0.0, 0.0, 0.0, 0.0, 0.0]
    assert [r.s for r in got] == ["ok", "", "", "", "", ""]
    assert [None if r.p is None else tuple(r.p) for r in got] == [
        (1.0, 0.0, 0.0), None, (0.0, 0.0, 0.0), None, None, (0.0, 0.0, 2.5)]


def test_battery_bands_and_flag(spark):
    vals = [100, 80, 79.99, 60, 40, 20, 19.99, 0, 20.01]
    df = spark.createDataFrame([(float(v),) for v in vals], "b double")
    got = df.select(st.battery_status("b").alias("s"), st.battery_ok("b").alias("ok")).collect()
    assert [r.s for r in got] == ["excellent", "excellent", "good", "good", "fair", "low", "critical", "critical", "low"]
    assert [r.ok for r in got] == [True, True, True, True, True, False, False, False, True]


@pytest.mark.parametrize("n", [0, 1, 36, 37, 71, 72, 100, 360, 361, 720])
def test_laser_downsample_equals_python_slice(spark, n):
    ranges = [float(i) for i in range(n)]
    df = spark.createDataFrame([(ranges,)], "r array<double>")
    row = df.select(SF.laser_downsample("r").alias("s"),
                    SF.laser_info("r", F.lit(0.0), F.lit(1.0), F.lit(0.5), F.lit(0.1), F.lit(9.0)).alias("i")).first()
    step = n // 36 if n > 36 else 1
    assert row.s == ranges[::step]
    assert row.i.total_points == n and row.i.sampled_points == len(ranges[::step])
    assert row.i.angle_increment == 0.5 * step


def test_diagnostics_status_and_last_name_wins(spark):
    entry = "struct<name:string,level:int,message:string>"
    cases = [[], [("a", 0, "")], [("a", 1, ""), ("b", 0, "")], [("a", 2, "")], [("a", 3, "")],
             [("a", 2, "x"), ("a", 0, "y")]]
    df = spark.createDataFrame([(c,) for c in cases], f"e array<{entry}>")
    got = df.select(SF.diagnostics_status("e").alias("s"), SF.diagnostics_map("e").alias("m")).collect()
    assert [r.s for r in got] == ["active", "active", "degraded", "warning", "warning", "warning"]
    assert got[5].m["a"].message == "y" and len(got[5].m) == 1


def test_command_normaliser(spark):
    rows = ['{"type":"move","linear":0.5}', '{"type":"move","linear":"0.25","angular":true}', '{"type":"goto","y":2}',
            '{"type":"stop"}', '{"type":"spin"}', '{"type":null}', "{}", '{"type":"move","angular":"x"}',
            '{"type":"goto","x":null}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "id int, command string")
    got = cmd.normalise_commands(df).orderBy("id").collect()
    assert [(r.action, r.linear_x, r.angular_z) for r in got[:2]] == [("twist", 0.5, 0.0), ("twist", 0.25, 1.0)]
    assert (got[2].goal_x, got[2].goal_y, got[2].goal_w, got[2].frame_id) == (0.0, 2.0, 1.0, "map")
    assert (got[3].linear_x, got[3].angular_z) == (0.0, 0.0)
    assert [r.accepted for r in got] == [True, True, True, True, False, False, False, False, False]


def test_json_codec(spark):
    df = spark.createDataFrame([('{"a":1}',), ("[1]",), ("null",), (None,), ("{bad",)], "j string")
    assert [r.o for r in df.select(J.decode_object("j").alias("o")).collect()] == ['{"a":1}', None, None, None, None]
    s = spark.createDataFrame([(1, None)], "a int, b string").select(J.encode_json(F.struct("a", "b")).alias("e"))
    assert s.first().e == '{"a":1}'


def test_field_json_quotes_strings(spark):
    rows = ['{"l":"abc"}', '{"l":null}', '{"l":{"x":1}}', '{"l":[1,2]}', '{"l":5}', "{}"]
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    assert [r.t for r in df.select(J.field_json("d", "l").alias("t")).collect()] == [
        '"abc"', "null", '{"x":1}', "[1,2]", "5", None]
