"""Counter-based random numbers: a hash of seed and counter, the same in any engine and on any retry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 60


def bits(*parts: Column | int | str) -> Column:
    """60 random bits from the parts, joined by colons: the first 15 hex digits of their MD5."""
    text = F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def below(limit: Column, *parts: Column | int | str) -> Column:
    """A random integer in [0, limit); the bias is at most limit / 2^60."""
    return bits(*parts) % limit


def unit(*parts: Column | int | str) -> Column:
    """A random double in (0, 1]."""
    return (bits(*parts).cast("double") + 1) / F.lit(float(1 << BITS))


def bits_sql(*parts: str) -> str:
    """The same 60 bits in DuckDB's SQL, from SQL expressions."""
    return f"CAST('0x' || substr(md5({" || ':' || ".join(f'CAST({p} AS VARCHAR)' for p in parts)}), 1, 15) AS BIGINT)"
