"""Word splitting shared by the Python-side operators."""

from __future__ import annotations

import re

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def words(text: str | None) -> list[str]:
    """Lower-cased words without punctuation at their ends; null has none."""
    out = (text or "").lower().split()
    if not all(map(str.isalnum, out)):
        trim = _EDGE.sub
        out = [w for w in (w if w.isalnum() else trim("", w) for w in out) if w]
    return out
