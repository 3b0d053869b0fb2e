"""Dimension and format arithmetic, integers only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from . import values as V
from .paths import col


def valid_dims(w, h, limit: int = V.MAX_DIMENSION) -> Column:
    return col(w).between(1, limit) & col(h).between(1, limit)


def storage_side(c, align: int = V.STORAGE_ALIGN) -> Column:
    """Rounded up to the storage alignment."""
    up = col(c) + (align - 1)
    return up - F.pmod(up, F.lit(align))


def _by_format(fmt, index: int) -> Column:
    c, out = col(fmt), None
    for row in V.FORMATS:
        out = F.when(c == row[0], F.lit(row[index])) if out is None else out.when(c == row[0], F.lit(row[index]))
    return out


def bits_per_pixel(fmt) -> Column:
    return _by_format(fmt, 2)


def stores_alpha(fmt) -> Column:
    return F.coalesce(col(fmt).isin([f[0] for f in V.FORMATS if f[3]]), F.lit(False))


def encoded_size(w, h, fmt) -> Column:
    """Bytes of the base level, null for invalid sizes or formats."""
    pixels = storage_side(w).cast("bigint") * storage_side(h).cast("bigint")
    return F.when(valid_dims(w, h), F.shiftright(pixels * bits_per_pixel(fmt), 3))


def max_levels(w, h) -> Column:
    """Number of halvings down to one, plus one."""
    return F.length(F.bin(F.greatest(col(w), col(h)).cast("bigint")))


def level_extent(side, level: int | Column) -> Column:
    lvl = F.lit(level) if isinstance(level, int) else level
    return F.greatest(F.lit(1), F.call_function("shiftright", col(side), lvl.cast("int")))


def target_scale(category, w, h) -> Column:
    side, cat = F.greatest(col(w), col(h)), col(category)
    return (
        F.when(cat.isin("characters", "backgrounds"), 4)
        .when(cat.isin("monsters", "ui", "icons", "maps"), F.when(side <= 512, 4).otherwise(2))
        .when(cat.isin("dungeon", "effects", "fonts"), F.when(side >= 256, 2).otherwise(4))
        .otherwise(F.when(side >= 512, 2).otherwise(4))
    )
