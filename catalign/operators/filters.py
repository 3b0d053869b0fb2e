"""Row selection: candidates, path safety, sizes, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import content as C, hashes as H, paths as P, values as V


def candidate_filter(files: DataFrame, ext="ext", content="content", **rules) -> DataFrame:
    return files.filter(C.candidate(ext, content, **rules))


def signature_filter(files: DataFrame, ext="ext", content="content", out="rule", **rules) -> DataFrame:
    """Selected files with the rule that selected them."""
    return files.withColumn(out, C.signature(ext, content, **rules)).filter(F.col(out).isNotNull())


def split_unsafe(df: DataFrame, path="path") -> tuple[DataFrame, DataFrame]:
    """Safe rows, and the rejected ones with the rule they break."""
    reason = P.unsafe_reason(path)
    return df.filter(reason.isNull()), df.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def flag_size(df: DataFrame, ceiling: int, size="length") -> DataFrame:
    """All rows in one pass: ``kept``, and the issue's message for those above the ceiling."""
    over = F.col(size) > ceiling
    return df.withColumns({"kept": ~over, "message": F.when(over, F.format_string("size %d exceeds %d", F.col(size), F.lit(ceiling)))})


def size_guard(df: DataFrame, ceiling: int, size="length") -> tuple[DataFrame, DataFrame]:
    """Rows within the ceiling, and an issue for each row above it.

    Both are plain comparisons on the size column, so file sources can apply
    them before they read content.
    """
    over = df.filter(F.col(size) > ceiling).withColumn("stage", F.lit("size_limit")).withColumn(
        "message", F.format_string("size %d exceeds %d", F.col(size), F.lit(ceiling))
    )
    return df.filter(F.col(size) <= ceiling), over


def skip_extensions(df: DataFrame, ext="ext", skipped=V.SKIP_EXTENSIONS, unless: Column | None = None) -> DataFrame:
    """Drop known-irrelevant extensions unless another test keeps the row."""
    keep = ~F.coalesce(F.col(ext).isin(list(skipped)), F.lit(False))
    return df.filter(keep if unless is None else keep | unless)


def countable(stage="stage", source="source", stages=V.COUNTABLE_STAGES, read_stage=V.COUNTABLE_READ_STAGE,
              decode_stage=V.COUNTABLE_DECODE_STAGE, archives=V.ARCHIVE_EXTENSIONS,
              decode_extension=V.COUNTABLE_DECODE_EXTENSION) -> Column:
    """Which issues count: listed stages, and two that depend on the source extension."""
    ext, s = P.extension(source), P.col(stage)
    return (
        F.when(s == read_stage, ~F.coalesce(ext.isin(list(archives)), F.lit(False)))
        .when(s == decode_stage, F.coalesce(ext == decode_extension, F.lit(False)))
        .otherwise(F.coalesce(s.isin(list(stages)), F.lit(False)))
    )


def countable_issues(issues: DataFrame, **kw) -> DataFrame:
    return issues.filter(countable(**kw))


def verified_only(evidence: DataFrame, rank="rank", least: int = V.VERIFIED_RANK) -> DataFrame:
    return evidence.filter(F.col(rank) >= least)


def valid_ids(df: DataFrame, asset_id=None, title_id=None, runtime_hash=None) -> DataFrame:
    """Rows whose given identifier columns are all well formed."""
    cond = F.lit(True)
    if asset_id:
        cond = cond & H.is_asset_id(asset_id)
    if title_id:
        cond = cond & H.is_title_id(title_id)
    if runtime_hash:
        cond = cond & H.is_runtime_hash(runtime_hash)
    return df.filter(cond)


def selector_gap(files: DataFrame, narrow: Column, broad: Column) -> DataFrame:
    """Rows the wide probe accepts and the production selector never reads; one scan."""
    return files.filter(broad & ~narrow)
