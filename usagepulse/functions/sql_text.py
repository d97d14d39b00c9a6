"""Text placed in SQL strings."""

from __future__ import annotations


def quoted(text: str) -> str:
    """A SQL string literal holding ``text``, whatever its characters."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
