"""Positions and running totals inside groups of any size.

A plain window sorts a whole group in one task. That is fine while the widest
group is known to be small. Beyond ``hot_rows`` the rows are range-partitioned
by (group, order) instead, so that a hot group spreads over many slabs; each
slab is numbered by itself and shifted by what the slabs before it hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut

HOT_ROWS = 2_000_000
HASH_BUCKETS = 65_536
#: The shift table has a row per slab and is broadcast.
MAX_SLABS = 20_000


def has_hot_group(df: DataFrame, group: list[str], hot_rows: int = HOT_ROWS) -> bool:
    """Whether some group may hold more than ``hot_rows`` rows.

    Rows are counted per hash bucket, not per group: the count of a bucket
    bounds its groups from above and the shuffle stays small however many
    groups there are. A false alarm costs time only.
    """
    return _count_guarded(df, group, hot_rows)[0]


def _count_guarded(df: DataFrame, group: list[str], hot_rows: int) -> tuple[bool, int]:
    top, total = df.groupBy(F.pmod(F.xxhash64(*group), F.lit(HASH_BUCKETS))).count().agg(
        F.max("count"), F.sum("count")).first()
    return (top or 0) > max(hot_rows, 4 * (total or 0) // HASH_BUCKETS), total or 0


def number_and_total(
    df: DataFrame,
    group: list[str],
    order: list[str],
    number: str | None = "n",
    totals: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
    slabs: int | None = None,
) -> DataFrame:
    """Add the one-based position and inclusive running sums per group.

    ``order`` must be a total order inside each group. Sums are of integer
    columns. The number of slabs follows from the number of rows.
    """
    totals = totals or {}
    hot, total = _count_guarded(df, group, hot_rows)
    if not hot:
        w = Window.partitionBy(*group).orderBy(*order)
        running = w.rowsBetween(Window.unboundedPreceding, 0)
        out = {number: F.row_number().over(w).cast("bigint")} if number else {}
        out |= {name: F.sum(value).over(running) for name, value in totals.items()}
        return df.withColumns(out)

    # A slab is sorted in one task: about half of what a group may hold there.
    slabs = slabs or min(MAX_SLABS, max(2, -(-2 * total // hot_rows)))
    ranged = cut(
        df.repartitionByRange(slabs, *group, *order).withColumn("_slab", F.spark_partition_id())
    )
    keys = ["_slab", *group]
    held = ranged.groupBy(*keys).agg(
        F.count("*").alias("_rows"),
        *[F.sum(value).alias(f"_sum_{name}") for name, value in totals.items()],
    )
    before = Window.partitionBy(*group).orderBy("_slab").rowsBetween(Window.unboundedPreceding, -1)
    # At most one row per slab continues a group of an earlier slab, so this
    # table never has more rows than there are slabs.
    shift = held.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.sum("_rows").over(before).alias("_shift_rows"),
        *[F.sum(f"_sum_{name}").over(before).alias(f"_shift_{name}") for name in totals],
    ).filter(F.col("_shift_rows") > 0)
    w = Window.partitionBy(*keys).orderBy(*order)
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns(
        {"_n": F.row_number().over(w).cast("bigint")}
        | {f"_run_{name}": F.sum(value).over(running) for name, value in totals.items()}
    )
    cond = F.lit(True)
    for k in keys:
        cond = cond & local[k].eqNullSafe(shift[f"_k_{k}"])
    joined = local.join(F.broadcast(shift), cond, "left")
    out = {number: F.col("_n") + F.coalesce("_shift_rows", F.lit(0))} if number else {}
    out |= {
        name: F.col(f"_run_{name}") + F.coalesce(F.col(f"_shift_{name}"), F.lit(0)) for name in totals
    }
    return joined.withColumns(out).select(*df.columns, *out)


def first_per_group(df: DataFrame, group: list[str], order: list[str], keep: list[str] | None = None) -> DataFrame:
    """First row of each group, by partial aggregation: a hot group leaves one row per map task."""
    keep = keep or [c for c in df.columns if c not in group]
    return (
        df.groupBy(*group)
        .agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("_row"))
        .select(*group, *[F.col("_row")[c].alias(c) for c in keep])
    )


def top_per_group(df: DataFrame, group: list[str], order: list, k: int, position: str = "n") -> DataFrame:
    """First k rows of each group. Map tasks pass on at most k rows per group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(position, F.row_number().over(w)).filter(F.col(position) <= k)
