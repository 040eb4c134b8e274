"""Numbers drawn from texts by hashing, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(text: Column) -> Column:
    """First 32 bits of the md5 of a text as a whole number: the draws of every sampling operator."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def hash_number_sql(text: str) -> str:
    return f"cast('0x' || substr(md5(cast({text} as varchar)), 1, 8) as bigint)"
