"""Strict JSON reading shared by the drift and shredding operators."""

from __future__ import annotations

import json


def _refuse(constant: str):
    raise ValueError(f"{constant} is no JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse)


def parse_record(text) -> dict | None:
    """The object that a valid line holds; None for null, broken or non-object text."""
    if not isinstance(text, str):
        return None
    try:
        value = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def parse_embedded(text: str):
    """An object or array that was stored as a string; None for any other string."""
    head = text.lstrip()[:1]
    if head not in ("{", "["):
        return None
    try:
        value = _DECODER.decode(text)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, (dict, list)) else None


def kind_of(value) -> str:
    """string, number, boolean, object, array or null."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    return "object" if isinstance(value, dict) else "array"


def scalar_text(value) -> str | None:
    """A scalar as JSON writes it, strings bare; None for objects, arrays and null."""
    if value is None or isinstance(value, (dict, list)):
        return None
    return value if isinstance(value, str) else json.dumps(value)
