"""Column expressions over posts and tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagwright.plans.query import Sort

URL_PREFIX = "https://example.com/questions/"


def tokenize(raw: Column) -> Column:
    """Tags of a raw string such as ``<c#><.net>``: split at spaces and angle brackets, empty parts dropped; null gives no tags."""
    return F.filter(F.split(F.coalesce(raw, F.lit("")), "[ <>]"), lambda t: t != "")


def url(id_: Column, prefix: str = URL_PREFIX) -> Column:
    return F.concat(F.lit(prefix), id_.cast("string"))


def sort_key(sort: Sort) -> Column:
    """What a dimension is ordered by: numbers with null as -1, timestamps as they are."""
    return F.col(sort.column) if sort.is_date else F.coalesce(F.col(sort.column), F.lit(-1)).cast("long")


def order(sort: Sort) -> list[Column]:
    """Descending; ties go to the larger id."""
    return [sort_key(sort).desc(), F.col("id").desc()]


def display(sort: Sort) -> Column:
    """The dimension as text: a date, a number with thousands marks, or <null>."""
    c = F.col(sort.column)
    return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss") if sort.is_date else F.format_number(c, 0), F.lit("<null>"))


def reversed_text(c: Column) -> Column:
    return F.reverse(c)


def popcount(c: Column) -> Column:
    return F.bit_count(c)


_LOW = 0xFFFFFFFF


def _u32(c: Column) -> Column:
    return c.bitwiseAND(F.lit(_LOW))


def wang_hash(c: Column) -> Column:
    """Thomas Wang's 32-bit integer mix, unsigned in a long."""
    k = _u32(c.cast("long"))
    k = _u32(_u32(F.bitwise_not(k)) + F.shiftleft(k, 15))
    k = k.bitwiseXOR(F.shiftright(k, 12))
    k = _u32(k + F.shiftleft(k, 2))
    k = k.bitwiseXOR(F.shiftright(k, 4))
    k = _u32(k * 2057)
    return k.bitwiseXOR(F.shiftright(k, 16))


def fnv1a_hash(c: Column) -> Column:
    """FNV-1a over an integer's four bytes, low byte first, unsigned in a long."""
    k, h = _u32(c.cast("long")), F.lit(2166136261).cast("long")
    for shift in (0, 8, 16, 24):
        h = _u32(h.bitwiseXOR(F.shiftright(k, shift).bitwiseAND(F.lit(0xFF))) * 16777619)
    return h


def human_size(size: int) -> str:
    """A file size in the largest unit that leaves a whole number over 0; what doesn't divide is lost."""
    units, k = ("B", "KB", "MB", "GB", "TB", "PB"), 0
    while size >= 1024 and k < len(units) - 1:
        size, k = size // 1024, k + 1
    return f"{size} {units[k]}"
