"""Python values as SQL text."""

from __future__ import annotations


def sql_of(x) -> str:
    """A Python value as SQL."""
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (int, float)):
        return repr(x)
    if isinstance(x, (tuple, list)):
        return "array(" + ", ".join(map(sql_of, x)) + ")"
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
