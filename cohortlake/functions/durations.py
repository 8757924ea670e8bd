"""Duration literals such as 500ms, 30s, 5m, 1h, 7d."""

from __future__ import annotations

import re

UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
_LITERAL = re.compile(r"([0-9]+)(ms|s|m|h|d)")


def duration_ms(text: str) -> int:
    found = _LITERAL.fullmatch(text) if isinstance(text, str) else None
    if found is None:
        raise ValueError(f"not a duration: {text!r}")
    return int(found[1]) * UNIT_MS[found[2]]
