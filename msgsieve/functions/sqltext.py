"""Helpers to place values in SQL expression text."""

from __future__ import annotations


def regex(pattern: str) -> str:
    """A raw SQL literal whose classes and boundaries follow Unicode."""
    return text(pattern, raw=True, prefix="(?U)")


def text(value: str, raw: bool = False, prefix: str = "") -> str:
    if raw:
        if '"' in value:
            raise ValueError("a raw pattern may not hold a double quote")
        return f'r"{prefix}{value}"'
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def strings(values) -> str:
    return ", ".join(text(v) for v in values)
