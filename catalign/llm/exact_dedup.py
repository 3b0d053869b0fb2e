"""Exact deduplication: a two-pass Bloom filter tells which rows may be repeated; only those are shuffled.

Pass one hashes each text to a few slots of a filter and counts the hits of each
slot; the slots hit twice or more make the filter of pass two. A row can have a
copy only if all its slots are in it. Rows outside pass straight through, the
others are grouped by digest, which decides exactly. What is shuffled for all
rows is the slots, eight bytes each and combined in the map tasks.

Edge cases: a null text equals the empty text. Of equal texts the largest id
stays; null ids are smaller than any other. Rows that repeat the id that stays
are all reported as kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut
from .common import attach_groups, build_filter, filter_blocks, filter_slots, flag_hits, keep_one, row_key, text_of

HASHES = 2
BITS_PER_ROW = 16


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), F.unhex(F.sha2(text_of(docs, text_col), 256)).alias("digest"))


def repeated_filter(digests: DataFrame, rows: int, bits_per_row: int = BITS_PER_ROW) -> tuple[DataFrame, list]:
    """Bitmaps of the slots that two or more rows hit, and the slot expressions."""
    slots = filter_slots(F.col("digest"), filter_blocks(rows, bits_per_row), HASHES)
    hit = digests.select(F.explode(F.array(*slots)).alias("slot")).groupBy("slot").count().filter("count > 1")
    return cut(build_filter(hit)), slots


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = cut(_digests(docs, id_col, text_col))
    total = digests.count()
    bitmaps, slots = repeated_filter(digests, total)
    flagged = flag_hits(digests, bitmaps, slots)
    single = flagged.filter(~F.col("_maybe")).select(
        "doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"))
    maybe = flagged.filter("_maybe").drop("_maybe")
    groups = cut(maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    found = attach_groups(maybe, groups, "digest", "group_size", total, "inner")
    return single.unionByName(found).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents without all but the largest id of each group of equal texts; of rows that share id and text one stays.

    Only the texts of rows that may be repeated are shuffled.
    """
    digests = cut(_digests(docs, id_col, text_col))
    total = digests.count()
    bitmaps, slots = repeated_filter(digests, total)
    maybe = flag_hits(digests, bitmaps, slots).filter("_maybe").drop("_maybe")
    groups = cut(maybe.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    judged = cut(attach_groups(maybe, groups.filter("group_size > 1"), "digest", "group_size", total, "inner").select(
        row_key("doc_id", "digest").alias("row"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept")))
    lost = judged.filter("NOT kept").select("row")
    twice = judged.filter("kept").groupBy("row").count().filter("count > 1").select("row")
    return keep_one(docs, row_key(docs[id_col], F.unhex(F.sha2(text_of(docs, text_col), 256))), lost, twice)
