"""Rows as text: tables, JSON and JSON lines."""

from __future__ import annotations

import base64
import json
import math
from collections.abc import Iterable, Mapping
from dataclasses import asdict, is_dataclass
from datetime import date, datetime
from decimal import Decimal
from enum import Enum
from typing import Any


def jsonable(value: Any) -> Any:
    """Bytes as base64; not-a-number and infinities as null; exact numbers and other objects as text."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, Enum):
        return value.value
    if value is None or isinstance(value, (bool, int, str)):
        return value
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    if isinstance(value, Decimal):
        return str(value)
    if is_dataclass(value) and not isinstance(value, type):
        return jsonable(asdict(value))
    if isinstance(value, Mapping):
        return {str(k): jsonable(v) for k, v in value.items()}
    if isinstance(value, Iterable):
        return [jsonable(v) for v in value]
    return str(value)


def table(rows: list[dict[str, Any]]) -> str:
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    cells = [["" if (v := jsonable(r[n])) is None else v if isinstance(v, str) else json.dumps(v) for n in names] for r in rows]
    widths = [max(len(n), *(len(c[k]) for c in cells)) for k, n in enumerate(names)]
    line = lambda values: "  ".join(v.ljust(w) for v, w in zip(values, widths, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in widths]), *map(line, cells)])
