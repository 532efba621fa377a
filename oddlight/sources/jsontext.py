"""Strict JSON: duplicate keys, surrogate escapes and non-finite numbers are errors with line and column."""

from __future__ import annotations

import json
import re

from ..errors import InvalidManifest

_SURROGATE = re.compile(r"(?<!\\)(?:\\\\)*\\u[dD][89a-fA-F]")


def _object(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        seen: set = set()
        twice = next(k for k, _ in pairs if k in seen or seen.add(k))
        raise InvalidManifest(f"duplicate key {twice!r}")
    return out


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise InvalidManifest(f"number {text} is not finite")
    return value


def _constant(text: str):
    raise InvalidManifest(f"{text} is not JSON")


def parse(text: str):
    if m := _SURROGATE.search(text):
        raise InvalidManifest(f"surrogate escape at line {text.count(chr(10), 0, m.start()) + 1}")
    try:
        return json.loads(text, object_pairs_hook=_object, parse_float=_number, parse_constant=_constant, strict=True)
    except json.JSONDecodeError as e:
        raise InvalidManifest(f"{e.msg} at line {e.lineno}, column {e.colno}") from e


def render(value) -> str:
    """Sorted keys, two spaces of indent, shortest exact doubles."""
    return json.dumps(value, sort_keys=True, indent=2, ensure_ascii=False, allow_nan=False) + "\n"
