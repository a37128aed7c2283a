"""Text helpers as columns: stripping, tokens, case tests, title case, normalisation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as SQL's patterns see it.
WHITE = " \t\n\x0b\f\r"
CASED = "\\p{Lu}\\p{Ll}\\p{Lt}"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def collapse(c: Column) -> Column:
    """Stripped, with runs of white space as one space."""
    return F.regexp_replace(strip(c), "\\s+", " ")


def tokens(c: Column) -> Column:
    """Lower-case tokens between white space."""
    return F.filter(F.split(F.lower(c), "\\s+"), lambda t: t != "")


def is_upper(c: Column) -> Column:
    return c.rlike("\\p{Lu}") & ~c.rlike("[\\p{Ll}\\p{Lt}]")


def is_title(c: Column) -> Column:
    return c.rlike("[\\p{Lu}\\p{Lt}]") & ~c.rlike(f"[{CASED}][\\p{{Lu}}\\p{{Lt}}]") & ~c.rlike(f"(^|[^{CASED}])\\p{{Ll}}")


def numbered(c: Column) -> Column:
    return c.rlike("^\\d+(\\.\\d+)*\\s+\\S")


def plain(c: Column) -> Column:
    """Lower case, anything but a-z and 0-9 as a space, collapsed."""
    return collapse(F.regexp_replace(F.lower(c), "[^a-z0-9\\s]", " "))


def plain_tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(plain(c), " "), lambda t: t != ""))


def join_hyphens(c: Column) -> Column:
    """Words split at a line end joined, white space collapsed."""
    return collapse(F.regexp_replace(c, "(\\w)-\\s*\\n\\s*(\\w)", "$1$2"))


def any_phrase(c: Column, phrases: list[str]) -> Column:
    """Whether lower-case text c holds any of the phrases."""
    found = F.lit(False)
    for p in phrases:
        found = found | c.contains(p.lower())
    return found


def any_pattern(c: Column, patterns: list[str]) -> Column:
    """Whether c matches any of the patterns, in any case. One of plain words is tried only where these stand."""
    found = F.lit(False)
    for p in patterns:
        words, here = re.fullmatch(r"\\b([A-Za-z&' ]+)\\b", p), c.rlike(f"(?i){p}")
        found = found | ((F.lower(c).contains(words[1].lower()) & here) if words else here)
    return found
