"""Table column names from header cells."""

from __future__ import annotations

import re
from collections.abc import Sequence

_OUTSIDE = re.compile("[^a-z0-9_]")


def sanitize_name(name: object, index: int) -> str:
    """Lower-case identifier of a header cell; ``col_<index>`` for a blank or numeric-zero cell."""
    numeric_void = isinstance(name, (int, float)) and (not name or name != name)
    text = "" if name is None or numeric_void else str(name).strip()
    return _OUTSIDE.sub("_", text.lower()) if text else f"col_{index}"


def unique_names(headers: Sequence[object], first_index: int = 0) -> list[str]:
    """Sanitized names, made distinct with the lowest free ``_2``, ``_3`` … suffix."""
    taken: set[str] = set()
    names = []
    for offset, header in enumerate(headers):
        stem = candidate = sanitize_name(header, first_index + offset)
        n = 1
        while candidate in taken:
            n += 1
            candidate = f"{stem}_{n}"
        taken.add(candidate)
        names.append(candidate)
    return names
