"""Deterministic identifiers as native Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: RFC 4122 name-space id for URLs (6ba7b811-9dad-11d1-80b4-00c04fd430c8).
NAMESPACE_URL_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def content_id(text: Column | str) -> Column:
    """Document id: first 16 hex characters of SHA-256 over the UTF-8 text."""
    return F.substring(F.sha2(_col(text), 256), 1, 16)


def uuid5_url(*parts: Column | str, sep: str = "|") -> Column:
    """RFC 4122 version-5 UUID (SHA-1, URL name space) of ``sep``-joined parts.

    Equal to Python's ``uuid.uuid5(uuid.NAMESPACE_URL, "a|b|c")``. Pure column
    expression, so a retried task always yields the same id.
    """
    name = F.concat_ws(sep, *[_col(p) for p in parts])
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_URL_HEX)), F.encode(name, "UTF-8")))
    variant = F.lower(
        F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128))
    )
    return F.concat(
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 19, 2),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )


def uuid5_sql(name_sql: str) -> str:
    """The same uuid5 as an SQL expression that DuckDB and Spark SQL both run."""
    d = f"sha1(unhex('{NAMESPACE_URL_HEX}') || encode({name_sql}))"
    return (
        f"(substr({d},1,8) || '-' || substr({d},9,4) || '-5' || substr({d},14,3) || '-' || "
        f"lower(printf('%02x', (('0x' || substr({d},17,2))::INTEGER & 63) | 128)) || "
        f"substr({d},19,2) || '-' || substr({d},21,12))"
    )
