"""Mailbox addresses and message identifiers of headers, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_key(c: Column) -> Column:
    """Message-ID without angle brackets and white space around it; null if nothing is left."""
    bare = F.regexp_replace(c, r"^[\s<]+|[\s>]+$", "")
    return F.when(bare != "", bare)


def address_set(c: Column) -> Column:
    """Sorted set of the mailbox addresses of a To header, in lower case; empty for none and null.

    Quoted display names and comments are taken away first, as they may hold commas or signs.
    """
    plain = F.regexp_replace(F.coalesce(c, F.lit("")), r'"(?:[^"\\]|\\.)*"(?!@)', " ")
    plain = F.regexp_replace(plain, r"\([^()]*\)", " ")
    parts = F.split(plain, r"[,;]")
    one = F.transform(parts, lambda p: F.lower(F.when(p.contains("<"), F.regexp_extract(p, r"<\s*([^<>]*?)\s*>", 1)).otherwise(F.regexp_replace(F.regexp_replace(p, r"^[^@]*:\s*", ""), r"\s+", ""))))
    return F.array_sort(F.array_distinct(F.filter(one, lambda a: a.contains("@"))))
