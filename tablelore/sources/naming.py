"""Safe and unique table names."""

from __future__ import annotations

import re


def clean_name(name: str) -> str:
    """A table name with odd characters as underscores and no leading digit."""
    name = re.sub(r"[^a-zA-Z0-9_]", "_", name)
    return re.sub(r"^(?=[0-9])", "_", name) or "table_data"


def safe_name(file_name: str) -> str:
    """The table name of a file: its name without the extension, cleaned."""
    return clean_name(re.sub(r"\.[^.]+$", "", file_name))


def unique_name(name: str, taken: set[str]) -> str:
    """``name``, or the first free ``name_2``, ``name_3``, …; remembers the choice."""
    free, number = name, 2
    while free in taken:
        free = f"{name}_{number}"
        number += 1
    taken.add(free)
    return free
