"""Helpers to write the DuckDB oracle text of a key.

An oracle query may name any ERP test table (``apca_t`` ...); ``with_fixtures`` prepends the
DuckDB definition of each table it mentions as a CTE, so the text runs on the driver's views
alone. The oracle side deliberately uses the plain formulation of each report (fan-out joins
first, then GROUP BY / DISTINCT), while the Spark side is free to plan differently; equal
results cross-check both.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from .fixtures_sql import FIXTURE_SQL


def with_fixtures(body: str, ctes: Sequence[tuple[str, str]] = ()) -> str:
    """``WITH <fixtures used>, <ctes> <body>``."""
    text = body + " " + " ".join(sql for _, sql in ctes)
    used = [name for name in FIXTURE_SQL if re.search(rf"\b{name}\b", text)]
    parts = [f"{name} AS ({FIXTURE_SQL[name]})" for name in used]
    parts += [f"{name} AS ({sql})" for name, sql in ctes]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def with_steps(result: str, **steps: str) -> str:
    """``result`` over named steps, each of which may use the ones before it."""
    return with_fixtures(result, list(steps.items()))
