"""Rescans, user edits and clean-up of a stored catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.paths import forward


def rescan_upsert(catalog: DataFrame, incoming: DataFrame, key: list[str], extracted: list[str],
                  user: list[str], classification: list[str], override: str) -> DataFrame:
    """Merge a rescan into the catalogue, unmatched rows of both sides included.

    Incoming owns the extracted columns, the stored row owns the user columns;
    classification follows the stored row only when the user overrode it.
    """
    old = catalog.select(*key, F.struct(*extracted, *user, *classification, override).alias("_old"))
    new = incoming.select(*key, F.struct(*[c for c in [*extracted, *user, *classification, override]
                                           if c in incoming.columns]).alias("_new"))
    both = old.join(new, key, "full")
    has_old, has_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    pinned = has_old & F.coalesce(F.col("_old")[override], F.lit(False))

    def from_new(c):
        return F.col("_new")[c] if c in incoming.columns else F.lit(None)

    cols = {c: F.when(has_new, from_new(c)).otherwise(F.col("_old")[c]) for c in extracted}
    cols |= {c: F.when(has_old, F.col("_old")[c]).otherwise(from_new(c)) for c in user}
    cols |= {c: F.when(pinned | ~has_new, F.col("_old")[c]).otherwise(from_new(c)) for c in classification}
    cols[override] = F.coalesce(F.when(pinned | ~has_new, F.col("_old")[override]).otherwise(from_new(override)),
                                F.lit(False))
    return both.select(*key, *[e.alias(c) for c, e in cols.items()])


def set_user_metadata(catalog: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """Overwrite the user columns as a whole; updates for unknown ids are errors."""
    news = updates.select(key, F.struct(*columns).alias("_user"))
    out = catalog.join(news, key, "left").withColumns(
        {c: F.when(F.col("_user").isNotNull(), F.col("_user")[c]).otherwise(F.col(c)) for c in columns}
    ).drop("_user")
    return out, updates.select(key).join(catalog.select(key), key, "left_anti")


def sanitize_refs(df: DataFrame, columns: list[str], prefix: str, status: str) -> DataFrame:
    """Blank path columns below a transient prefix and note it in ``<column>_status``."""
    gone = {c: F.startswith(forward(c), F.lit(prefix)) for c in columns}
    return df.withColumns(
        {f"{c}_status": F.when(g, F.lit(status)) for c, g in gone.items()}
    ).withColumns({c: F.when(F.col(f"{c}_status").isNotNull(), F.lit("")).otherwise(F.col(c)) for c in columns})


def sanitize_nested(df: DataFrame, column: str, field: str, prefix: str, status: str) -> DataFrame:
    """The same inside an array of structs."""
    def clean(x):
        gone = F.startswith(forward(x[field]), F.lit(prefix))
        return x.withField(f"{field}_status", F.when(gone, F.lit(status))).withField(
            field, F.when(gone, F.lit("")).otherwise(x[field]))

    return df.withColumn(column, F.transform(column, clean))
