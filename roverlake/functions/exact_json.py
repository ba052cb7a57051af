"""Byte-exact decoding of JSON objects (P1, P2, F7): kinds, texts and slices of top-level fields.

``object_fields`` accepts what Python's ``json.loads`` accepts: NaN and Infinity, numbers of any
length, any nesting its recursion limit allows; and refuses what it refuses: trailing text, bare
words, control characters in strings, bytes that are no UTF-8. Of a repeated key the last value
counts. A field's ``json`` is the slice of the input, untouched, so stored payloads keep their
bytes. VARIANT and ``get_json_object`` cannot do this (they refuse repeated keys and NaN, round
long numbers, ignore trailing text, and render values anew), so the decoder is an Arrow-batched
function; it only finds fields, and every rule on them is a column expression.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from roverlake.functions.util import as_col

OBJECT, OTHER, MALFORMED = "object", "other", "malformed"
_FIELD = {"kind": pa.string(), "text": pa.string(), "json": pa.string(), "storable": pa.bool_()}
_FIELD_TYPE = "struct<kind: string, text: string, json: string, storable: boolean>"
_space = json.decoder.WHITESPACE.match
_string = json.decoder.scanstring
_key = re.compile(r'"([^"\\\x00-\x1f]*)"[ \t\n\r]*:[ \t\n\r]*').match  # a key without escapes, up to its value
_colon = re.compile(r"[ \t\n\r]*:[ \t\n\r]*").match
_mark = re.compile(r"[ \t\n\r]*([,}])[ \t\n\r]*").match


class _Constant(float):
    """NaN or an infinity, told apart from numbers that JSON columns can hold."""


_KINDS = {str: "string", bool: "boolean", dict: "object", list: "array", type(None): "null"}


def _members(text: str, wanted: frozenset[str], value_at: Callable) -> dict[str, tuple[int, int, object]] | None:
    """Last (start, end, value) of each wanted key of an object; None for another value.
    ValueError if ``text`` is not one JSON value. ``value_at`` decodes (value, end) at a place."""
    at = _space(text, 0).end()
    if text[at:at + 1] != "{":
        _, end = value_at(text, at)
        if _space(text, end).end() != len(text):
            raise ValueError("trailing text")
        return None
    found = {}
    at = _space(text, at + 1).end()
    if text[at:at + 1] == "}":
        mark, at = "}", at + 1
    else:
        mark = ","
    while mark == ",":
        plain = _key(text, at)
        if plain:
            key, at = plain[1], plain.end()
        else:
            if text[at:at + 1] != '"':
                raise ValueError("a key is expected")
            key, at = _string(text, at + 1, True)
            colon = _colon(text, at)
            if not colon:
                raise ValueError("a colon is expected")
            at = colon.end()
        value, end = value_at(text, at)
        if key in wanted:
            found[key] = (at, end, value)
        after = _mark(text, end)
        if not after:
            raise ValueError("a comma is expected")
        mark, at = after[1], after.end()
    if _space(text, at).end() != len(text):
        raise ValueError("trailing text")
    return found


def _has_constant(value) -> bool:
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, _Constant):
            return True
        if isinstance(v, dict):
            todo += v.values()
        elif isinstance(v, list):
            todo += v
    return False


def _sound(text: str) -> bool:
    """False for what a JSON text may escape but a text column cannot hold."""
    return "\0" not in text and not any("\ud800" <= c <= "\udfff" for c in text)


def _storable(value, slice_: str) -> bool:
    """True if a binary JSON column can hold the value: no NaN or infinity, no NUL or
    half surrogate in a string (which only an escape can bring in)."""
    if ("N" in slice_ or "I" in slice_) and _has_constant(value):
        return False
    return "\\u" not in slice_ or _sound(json.dumps(value, ensure_ascii=False).replace("\\u0000", "\0"))


def _field(text: str, found: tuple[int, int, object] | None) -> tuple:
    if found is None:
        return None, None, None, None
    start, end, value = found
    slice_ = text[start:end]
    kind = _KINDS.get(type(value), "number")
    shown = value if kind == "string" else slice_ if kind in ("number", "boolean") else None
    if kind == "string" and "\\u" in slice_ and not _sound(value):
        shown = None
    return kind, shown, slice_, _storable(value, slice_)


def object_fields(raw, keys: Sequence[str]) -> Column:
    """A struct of ``state`` (object, other or malformed; NULL for NULL) and, for each
    key, a struct: ``kind`` (string, number, boolean, null, object, array; NULL if the key
    is absent), ``text`` (a string's characters, a number or boolean as written),
    ``json`` (the slice of the input) and ``storable`` (a JSON column can hold it)."""
    keys = tuple(keys)
    wanted = frozenset(keys)

    def decode(batch: pa.Array) -> pa.Array:
        value_at = json.JSONDecoder(parse_constant=_Constant).raw_decode
        states: list[str | None] = []
        columns: list[list] = [[] for _ in range(len(keys) * len(_FIELD))]
        for data in batch.to_pylist():
            text, found = "", None
            if data is None:
                states.append(None)
            else:
                try:
                    text = data.decode("utf-8")
                    found = _members(text, wanted, value_at)
                    states.append(OTHER if found is None else OBJECT)
                except (ValueError, RecursionError):  # what json.loads raises, and bytes that are no UTF-8
                    states.append(MALFORMED)
            for k, key in enumerate(keys):
                for c, part in enumerate(_field(text, found.get(key) if found else None)):
                    columns[k * len(_FIELD) + c].append(part)
        n = len(_FIELD)
        fields = [pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns[k * n:(k + 1) * n], _FIELD.values(), strict=True)], list(_FIELD)) for k in range(len(keys))]
        return pa.StructArray.from_arrays([pa.array(states, pa.string()), *fields], ["state", *keys])

    schema = ", ".join(["state: string", *(f"`{k}`: {_FIELD_TYPE}" for k in keys)])
    return F.arrow_udf(decode, f"struct<{schema}>")(as_col(raw).cast("binary"))
