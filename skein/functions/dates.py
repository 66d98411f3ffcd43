"""Date parameters of searches."""

from __future__ import annotations

import math
import re
from datetime import datetime

_STAMP = re.compile(r"(\d{4}-\d{2}-\d{2})[Tt ](\d{2}:\d{2}:\d{2})(\.\d+)?([+-]\d{2}:\d{2})")


class DateError(ValueError):
    """A date parameter that is neither a number nor an RFC 3339 time."""


def parse_date(value: object) -> int | None:
    """Epoch milliseconds of a parameter, or None for no bound.

    Whole numbers stay, fractions are cut, texts are RFC 3339 times with an
    offset (or Z) or numbers; empty texts, booleans, lists and objects mean no
    bound. Anything else is a DateError, also a date without time or offset.
    """
    if isinstance(value, bool) or value is None or isinstance(value, (list, dict, tuple)):
        return None
    if isinstance(value, int):
        return value
    if isinstance(value, float):
        return int(value) if math.isfinite(value) else None
    if not isinstance(value, str):
        raise DateError(f"not a date: {value!r}")
    text = value.strip()
    if not text:
        return None
    m = _STAMP.fullmatch(text[:-1] + "+00:00" if text[-1:] in "Zz" else text)
    if m:
        try:
            at = datetime.fromisoformat(f"{m[1]}T{m[2]}{m[4]}")
        except ValueError as e:
            raise DateError(f"not a date: {value!r}") from e
        return int(at.timestamp()) * 1000 + int(float(m[3] or 0) * 1000)
    try:
        return int(float(text))
    except (ValueError, OverflowError) as e:
        raise DateError(f"not a date: {value!r}") from e
