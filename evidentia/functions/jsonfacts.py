"""Strict JSON facts of a text in one Arrow pass; rows that do not look like JSON come in as null and cost nothing."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

from evidentia.functions.text import WS

FIELDS = ["parses", "error_found", "error_status", "degraded", "unclosed"]
SCHEMA = StructType([StructField(f, IntegerType() if f == "error_status" else BooleanType()) for f in FIELDS])

#: Wording of fallback and placeholder results.
DEGRADED = (
    "fallback|placeholder|substituted|degraded|unreachable|last known|stale|partial results?|best effort|retry exhausted|circuit open|"
    "could not reach|no rows returned|default value"
)
_DEGRADED = re.compile(rf"\b(?:{DEGRADED})\b", re.I | re.A)
_STATUS_KEYS = ("status", "statusCode", "code", "httpStatus")
_PAIRS = {"}": "{", "]": "["}
#: White space around a payload, of any script.
SPACES = "".join(chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and re.match(WS.replace(r"\x0B", "\x0b"), chr(c)))
_TOKEN = re.compile(
    r"[ \t\n\r]*(?:(?P<mark>[{}\[\],:])|(?P<text>\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\")"
    r"|(?P<number>-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(?P<word>true|false|null))"
)


def _reject(name: str) -> None:
    raise ValueError(name)


def _integer(digits: str) -> int | float:
    """An integer of any length; beyond what an exact one is needed for, a float, which may be infinite."""
    return int(digits) if len(digits) < 20 else float(digits)


def parse_nested(text: str) -> object:
    """Strict JSON without recursion, for documents nested deeper than the parser's stack."""
    root: list = []
    holders: list = [root]
    keys: list[str | None] = [None]
    at, state = 0, "value"
    while len(holders) > 1 or not root:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, holder = m["mark"], holders[-1]
        if mark and mark in "}]" and state in ("next", "first" if mark == "]" else "first key") and isinstance(holder, list if mark == "]" else dict) and holder is not root:
            holders.pop()
            keys.pop()
            state = "next"
        elif mark == "," and state == "next":
            state = "key" if isinstance(holder, dict) else "value"
        elif mark == ":" and state == "colon":
            state = "value"
        elif state in ("key", "first key") and m["text"]:
            keys[-1], state = json.loads(m["text"]), "colon"
        elif state in ("value", "first") and (not mark or mark in "{["):
            value = {} if mark == "{" else [] if mark == "[" else json.loads(m[m.lastgroup], parse_int=_integer)
            if isinstance(holder, dict):
                holder[keys[-1]] = value
            else:
                holder.append(value)
            state = "next"
            if mark:
                holders.append(value)
                keys.append(None)
                state = "first key" if mark == "{" else "first"
        else:
            raise ValueError(f"no JSON at {at}")
    if text[at:].strip(" \t\n\r"):
        raise ValueError("text after the document")
    return root[0]


def parse(text: str) -> object:
    """Strict JSON: no constants such as NaN, nothing after the document; of equal keys the last counts."""
    try:
        return json.loads(text, parse_constant=_reject, parse_int=_integer)
    except RecursionError:
        return parse_nested(text)


def find_status(value: object) -> int | None:
    """The first HTTP status under a status key of the object, else of its ``error``, else of its ``response``."""
    pending = [value]
    while pending:
        v = pending.pop()
        if isinstance(v, dict):
            for k in _STATUS_KEYS:
                s = v.get(k)
                if isinstance(s, (int, float)) and not isinstance(s, bool) and math.isfinite(s) and s == int(s) and 100 <= s <= 599:
                    return int(s)
            pending += [v.get("response"), v.get("error")]
    return None


def strings(value: object) -> Iterator[str]:
    """All strings and keys, in depth-first order."""
    pending = [value]
    while pending:
        v = pending.pop()
        if isinstance(v, str):
            yield v
        elif isinstance(v, dict):
            for k, x in reversed(v.items()):
                pending += [x, k]
        elif isinstance(v, list):
            pending += reversed(v)


def unclosed(text: str) -> bool:
    """Whether brackets or a string are open at the end; a closer that fits nothing means no."""
    stack, quoted, escaped = [], False, False
    for c in text:
        if quoted:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            stack.append(c)
        elif c in _PAIRS and (not stack or stack.pop() != _PAIRS[c]):
            return False
    return quoted or bool(stack)


def facts(text: str | None) -> tuple:
    """Facts of one text that begins with a bracket after white space."""
    if text is None:
        return (None,) * 5
    text = text.strip(SPACES)
    try:
        value = parse(text)
    except ValueError:
        return False, False, None, False, unclosed(text)
    status = find_status(value)
    if status is not None and not 200 <= status <= 299:
        found = True
    else:
        error = value.get("error") if isinstance(value, dict) else None
        found = len(error) > 0 if isinstance(error, str) else error is not None
    return True, found, status if found else None, any(_DEGRADED.search(s) for s in strings(value)), False


@F.arrow_udf(SCHEMA)
def _facts(texts: pa.Array) -> pa.Array:
    rows = [facts(t) for t in texts.to_pylist()]
    kinds = [pa.int32() if f == "error_status" else pa.bool_() for f in FIELDS]
    return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], FIELDS)


def json_facts(text: Column) -> Column:
    """Facts as a struct, all null where the text does not begin with ``{`` or ``[`` after white space."""
    return _facts(F.when(text.rlike(rf"\A{WS}*+[{{\[]"), text))
