"""Column names with any characters."""

from __future__ import annotations


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
