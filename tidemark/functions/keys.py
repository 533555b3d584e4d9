"""Deterministic keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The namespace of URLs in RFC 4122, as hex.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def _dashed(h: Column) -> Column:
    """32 hex digits as a UUID of version 5."""
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def uuid5(name: Column, namespace: str = URL_NAMESPACE) -> Column:
    return _dashed(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))))


def bare_uuid(name: Column) -> Column:
    """The same form over the name alone."""
    return _dashed(F.sha1(F.encode(name, "UTF-8")))


def hash31(text: Column) -> Column:
    """The 31-multiplier hash of the characters' codes, modulo 2**32."""
    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296)


def stable_json(text: Column) -> Column:
    """JSON with sorted keys, for equality; null if it doesn't parse."""
    return F.to_json(F.try_parse_json(text))


def content_key(*columns: Column) -> Column:
    """SHA-256 of columns' values, nulls told from empty texts."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns))), 256)
