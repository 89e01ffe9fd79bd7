"""Canonical forms of page titles and categories, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every run of characters that counts as one space (no-break and typographic spaces included).
SPACES = r"(?U)[\s_]+"


def canonical_title(c: Column) -> Column:
    """Cut at the first ``#``; ``_`` and runs of white space become one space; trimmed. NULL stays NULL."""
    return F.trim(F.regexp_replace(F.substring_index(c, "#", 1), SPACES, " "))


def canonical_category(c: Column) -> Column:
    """As a title, but nothing is cut; leading ``category:`` in any case is dropped; lower case."""
    spaced = F.lower(F.trim(F.regexp_replace(c, SPACES, " ")))
    return F.trim(F.regexp_replace(spaced, r"^category ?: ?", ""))


def present(c: Column) -> Column:
    """True for a non-null, non-blank canonical form."""
    return c.isNotNull() & (c != "")
