"""A small query language over index fields: ``field:term``, ``field:[a TO b]``, AND, OR, NOT and parentheses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:(\()|(\))|(AND|OR|NOT)\b|(\w+):(?:\[\s*(\S+)\s+TO\s+(\S+?)\s*\]|"([^"]*)"|([^\s()]+)))')


def parse(query: str, numeric: tuple[str, ...] = ("ninlinks",)) -> Column:
    """The filter of a query. Ranges hold for numeric fields only; ``*`` leaves an end open."""
    tokens, at = [], 0
    while query[at:].strip():
        m = _TOKEN.match(query, at)
        if not m:
            raise ValueError(f"can't read the query at {query[at:]!r}")
        tokens.append(m)
        at = m.end()
    pos = 0

    def peek(group: int) -> str | None:
        return tokens[pos][group] if pos < len(tokens) else None

    def any_of() -> Column:
        nonlocal pos
        left = all_of()
        while peek(3) == "OR":
            pos += 1
            left = left | all_of()
        return left

    def all_of() -> Column:
        nonlocal pos
        left = one()
        while pos < len(tokens) and not peek(2) and peek(3) != "OR":
            if peek(3) == "AND":
                pos += 1
            left = left & one()
        return left

    def one() -> Column:
        nonlocal pos
        if pos >= len(tokens):
            raise ValueError("the query ends too early")
        m = tokens[pos]
        pos += 1
        if m[3] == "NOT":
            return ~one()
        if m[1]:
            inner = any_of()
            if not peek(2):
                raise ValueError("a parenthesis isn't closed")
            pos += 1
            return inner
        if not m[4]:
            raise ValueError(f"unexpected {m.group().strip()!r}")
        c = F.col(m[4])
        if m[5] is not None:
            if m[4] not in numeric:
                raise ValueError(f"{m[4]} has no ranges")
            low = F.lit(True) if m[5] == "*" else c >= int(m[5])
            return low & (F.lit(True) if m[6] == "*" else c <= int(m[6]))
        value = m[7] if m[7] is not None else m[8]
        return c == (int(value) if m[4] in numeric else value)

    out = any_of()
    if pos < len(tokens):
        raise ValueError(f"unexpected {tokens[pos].group().strip()!r}")
    return out
