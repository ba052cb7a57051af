"""JSON column helpers.

Payloads stay JSON text in storage. Key presence and value types are read
with VARIANT functions (``try_parse_json`` / ``schema_of_variant``) because
``get_json_object`` cannot tell an absent key from a JSON null, nor a number
from a numeric string.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roverlake.functions.util import as_col


def _path(key: str) -> str:
    # Bracket form so that names with dots or spaces address one top-level key.
    return "$['" + key.replace("'", "\\'") + "']"


def field_text(js, key: str) -> Column:
    """``js->>'key'``: the field as text, JSON null -> NULL (F1)."""
    return F.get_json_object(as_col(js), _path(key))


def field_json(js, key: str) -> Column:
    """JSON text of a top-level field, like ``json.dumps(obj.get(key))``:
    a JSON string keeps its quotes, a JSON null gives the text ``null``, an
    absent key gives SQL NULL."""
    js = as_col(js)
    v = F.try_variant_get(variant(js), _path(key), "variant")
    text = F.when(F.schema_of_variant(v) == "STRING", F.to_json(v)).otherwise(F.get_json_object(js, _path(key)))
    return F.when(has_key(js, key), F.coalesce(text, F.lit("null")))


def to_double(c, on_bad: str = "null") -> Column:
    """``::float``. ANSI cast raises on bad text; ``on_bad='null'`` uses try_cast (F2)."""
    c = as_col(c)
    if on_bad == "null":
        return c.try_cast("double")
    if on_bad == "raise":
        return c.cast("double")
    raise ValueError("on_bad must be 'null' or 'raise'")


def keys(js) -> Column:
    """Top-level keys of a JSON object; NULL for arrays, scalars and bad JSON."""
    return F.json_object_keys(as_col(js))


def has_key(js, key: str) -> Column:
    """``value ? key``: top-level key present, also when its value is JSON null."""
    return F.coalesce(F.array_contains(keys(js), F.lit(key)), F.lit(False))


def variant(js) -> Column:
    return F.try_parse_json(as_col(js))


def is_object(js) -> Column:
    """True only for a JSON object; arrays, scalars, null and bad JSON fail."""
    return F.coalesce(F.schema_of_variant(variant(js)).startswith("OBJECT"), F.lit(False))


def _vtype(v: Column, key: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, _path(key), "variant"))


def _is_number(type_name: Column) -> Column:
    return (
        type_name.isin("BIGINT", "DOUBLE", "FLOAT", "INT", "SMALLINT", "TINYINT")
        | type_name.startswith("DECIMAL")
    )


def number_or(js, key: str, default: float = 0.0) -> Column:
    """Field as double when it is a JSON number, else ``default`` (GetBattery, F9)."""
    v = variant(js)
    return F.when(_is_number(_vtype(v, key)), F.try_variant_get(v, _path(key), "double")).otherwise(F.lit(default))


def string_or(js, key: str, default: str = "") -> Column:
    """Field when it is a JSON string, else ``default`` (GetStatus, F11)."""
    v = variant(js)
    return F.when(_vtype(v, key) == "STRING", F.try_variant_get(v, _path(key), "string")).otherwise(F.lit(default))


def position_of(js, key: str = "position") -> Column:
    """GetPosition (F10): struct(x, y, z) when the field is an object, else NULL.

    A missing or non-numeric coordinate reads as 0.
    """
    v = variant(js)
    obj = F.try_variant_get(v, _path(key), "variant")
    is_obj = F.coalesce(F.schema_of_variant(obj).startswith("OBJECT"), F.lit(False))

    def coord(name: str) -> Column:
        t = F.schema_of_variant(F.try_variant_get(obj, f"$.{name}", "variant"))
        return F.when(_is_number(t), F.try_variant_get(obj, f"$.{name}", "double")).otherwise(F.lit(0.0))

    return F.when(is_obj, F.struct(coord("x").alias("x"), coord("y").alias("y"), coord("z").alias("z")))


def sorted_keys(js) -> Column:
    """Key names of a payload, sorted (F17; the reference order is random)."""
    return F.array_sort(keys(js))


def render(js) -> Column:
    """``k: v, k: v`` display text of a payload's top-level fields.

    Nested values print as their JSON text.
    """
    m = F.from_json(as_col(js), "map<string,string>")
    return F.array_join(
        F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("null")))),
        ", ",
    )


def encode_json(c) -> Column:
    """JSON column codec, write side (F8): struct/map -> JSON text, NULL stays NULL."""
    return F.to_json(as_col(c))


def decode_object(js) -> Column:
    """JSON column codec, read side (F8): the text when it holds a JSON object,
    NULL for SQL NULL; anything else (array, scalar, bad JSON) is an error in
    the reference and NULL here (check with ``is_object`` to reject)."""
    c = as_col(js)
    return F.when(is_object(c), c)
