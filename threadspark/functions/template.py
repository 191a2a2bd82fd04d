"""``$name`` and ``${name}`` templates compiled once into a concatenation of literals and columns."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: an escaped dollar, a name, a name in braces
PLACEHOLDER = re.compile(r"\$(?:(\$)|([A-Za-z_][A-Za-z0-9_]*)|\{([A-Za-z_][A-Za-z0-9_]*)\})")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """One text per row for ``$name``, ``${name}`` and ``$$``; unknown names and null values become empty text."""
    parts: list[Column] = []
    at = 0
    for found in PLACEHOLDER.finditer(template):
        before = template[at : found.start()] + (found[1] or "")
        at = found.end()
        if before:
            parts.append(F.lit(before))
        name = found[2] or found[3]
        if name in values:
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    if template[at:]:
        parts.append(F.lit(template[at:]))
    return F.concat(*parts) if parts else F.lit("")
