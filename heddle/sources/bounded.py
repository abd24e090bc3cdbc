"""Bounded reading of JSON text that built-in readers cannot vet: depth, sizes, duplicate keys, byte-order marks."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Nesting, bytes of a string, members of an object, items of a list.
MAX_DEPTH, MAX_STRING, MAX_MEMBERS, MAX_ITEMS = 64, 1 << 20, 4096, 1_000_000


class Refused(ValueError):
    pass


def _pairs(pairs: list[tuple[str, object]]) -> dict:
    if len(pairs) > MAX_MEMBERS:
        raise Refused("TOO_MANY_MEMBERS")
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Refused("DUPLICATE_KEY")
    return out


def _constant(name: str) -> object:
    raise Refused("NOT_A_NUMBER")


def _walk(value: object, depth: int = 1) -> None:
    if depth > MAX_DEPTH:
        raise Refused("TOO_DEEP")
    if isinstance(value, str) and len(value.encode()) > MAX_STRING:
        raise Refused("TOO_LONG")
    if isinstance(value, list) and len(value) > MAX_ITEMS:
        raise Refused("TOO_MANY_ITEMS")
    for child in value.values() if isinstance(value, dict) else value if isinstance(value, list) else ():
        _walk(child, depth + 1)


def refusal(text: str | None) -> str | None:
    """Why a JSON text is refused; null for a good one."""
    if text is None or text.startswith("﻿"):
        return "BYTE_ORDER_MARK" if text else "MISSING"
    depth = most = 0
    quoted = escaped = False
    for c in text:  # depth is checked before parsing, so that deep nesting can't exhaust the parser
        if quoted:
            escaped, quoted = (c == "\\" and not escaped), not (c == '"' and not escaped)
        elif c == '"':
            quoted = True
        elif c in "[{":
            depth += 1
            most = max(most, depth)
        elif c in "]}":
            depth -= 1
    if most > MAX_DEPTH:
        return "TOO_DEEP"
    try:
        _walk(json.loads(text, object_pairs_hook=_pairs, parse_constant=_constant))
    except Refused as error:
        return str(error)
    except ValueError:
        return "MALFORMED"
    return None


@F.arrow_udf(T.StringType())
def json_refusal(text: pa.Array) -> pa.Array:
    return pa.array([refusal(t) for t in text.to_pylist()], pa.string())
