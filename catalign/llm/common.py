"""Helpers shared by the operators."""

from __future__ import annotations

import ctypes
import functools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import cut

#: A key is hot if it holds more than one in so many rows, so hot keys are no more than this.
HOT_SHARE = 1000
#: Bits of one block of a filter: what a bitmap of Spark's bitmap functions holds.
BLOCK_BITS = 32_768
#: Largest filter that is sent to executors (64 MB). A corpus that outgrows it sends more rows
#: through the exact path; results stay the same.
MAX_FILTER_BITS = 1 << 29
#: Bytes of text in a slice for steps that hold a hundred bytes for each of them.
SMALL_SLICE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(df: DataFrame, text: str = "text") -> Column:
    """Text with null read as empty."""
    return F.coalesce(df[text].cast("string"), F.lit(""))


def attach_groups(rows: DataFrame, groups: DataFrame, key: str, count: str, total: int, how: str = "left") -> DataFrame:
    """Join each row with its group's row; nulls are a group as well.

    ``groups`` has one row per ``key`` and in ``count`` how many of ``total``
    rows it holds. Groups with more than a thousandth of the rows, at most a
    thousand, are broadcast so that no hot group meets in one task; the other
    groups are joined by a shuffle. Both inputs are read more than once: pass
    tables, not long plans.
    """
    values = [c for c in groups.columns if c != key]
    packed = groups.select(F.col(key).alias("_key"), F.col(count).alias("_count"), F.struct(*values).alias("_group"))
    is_hot = F.col("_count") * HOT_SHARE > total
    hot = packed.filter(is_hot).withColumn("_found", F.lit(True))
    rest = packed.filter(~is_hot)
    probed = rows.join(F.broadcast(hot), rows[key].eqNullSafe(hot["_key"]), "left")
    first = probed.filter(F.col("_found"))
    other = probed.filter(F.col("_found").isNull()).select(*rows.columns)
    second = other.join(rest, other[key].eqNullSafe(rest["_key"]), how)
    out = [*[F.col(c) for c in rows.columns], *[F.col("_group")[c].alias(c) for c in values]]
    return first.select(*out).unionByName(second.select(*out))


def filter_blocks(rows: int, bits_per_row: int) -> int:
    """Blocks of a filter for so many rows."""
    return max(1, math.ceil(min(rows * bits_per_row, MAX_FILTER_BITS) / BLOCK_BITS))


def filter_slots(key: Column, blocks: int, hashes: int) -> list[Column]:
    """One-based slots of a key, all in one block, so that a lookup reads one bitmap."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)) * BLOCK_BITS
    return [block + F.pmod(F.xxhash64(key, F.lit(j)), F.lit(BLOCK_BITS)) + 1 for j in range(hashes)]


def build_filter(slots: DataFrame, slot: str = "slot") -> DataFrame:
    """Bitmaps of a set of slots, one row for each block that has any."""
    return slots.groupBy(F.bitmap_bucket_number(slot).alias("_block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("_bits"))


def flag_hits(rows: DataFrame, bitmaps: DataFrame, slots: list[Column], name: str = "_maybe") -> DataFrame:
    """Whether all slots of a row are set. The bitmaps are broadcast; ``filter_blocks`` bounds their size."""
    def is_set(slot: Column) -> Column:
        at = F.bitmap_bit_position(slot)
        byte = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        power = F.element_at(F.array(*[F.lit(1 << b) for b in range(8)]), (at % 8 + 1).cast("int"))
        return byte.bitwiseAND(power) != 0

    joined = rows.withColumn("_at", F.bitmap_bucket_number(slots[0])).join(
        F.broadcast(bitmaps), F.col("_at") == F.col("_block"), "left")
    hit = F.lit(True)
    for slot in slots:
        hit = hit & is_set(slot)
    return joined.withColumn(name, F.col("_bits").isNotNull() & F.coalesce(hit, F.lit(False))).drop("_at", "_block", "_bits")


def row_key(doc_id, digest) -> Column:
    """Key of a document and its text, for rows whose id may be repeated or null."""
    doc_id, digest = (F.col(c) if isinstance(c, str) else c for c in (doc_id, digest))
    return F.substring(F.unhex(F.sha2(F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.hex(digest)), 256)), 1, 16)


def keep_one(docs: DataFrame, key: Column, lost: DataFrame, twice: DataFrame, bits_per_row: int = 12, hashes: int = 3) -> DataFrame:
    """Documents whose key is not in ``lost``, and one only of those that share a key in ``twice``.

    A Bloom filter of the keys lets documents pass that cannot be meant, so the texts of most
    are not shuffled; the others are joined exactly. Of several rows with one key the one
    with the smallest hash of its columns stays.
    """
    marks = cut(lost.select("row", F.lit(True).alias("_lost")).distinct().unionByName(twice.select("row", F.lit(False).alias("_lost")).distinct()))
    blocks = filter_blocks(marks.count(), bits_per_row)
    slots = marks.select(F.explode(F.array(*filter_slots(F.col("row"), blocks, hashes))).alias("slot"))
    # The document travels as one value, so that no column of it can clash.
    keyed = docs.select(F.struct(*docs.columns).alias("doc"), key.alias("_row"))
    flagged = flag_hits(keyed, cut(build_filter(slots)), filter_slots(F.col("_row"), blocks, hashes))
    passed = flagged.filter(~F.col("_maybe")).select("doc")
    held = flagged.filter("_maybe").select("doc", "_row")
    judged = held.join(marks, held["_row"] == marks["row"], "left")
    single = judged.filter("_lost IS NULL").select("doc")
    if twice.isEmpty():
        return passed.unionByName(single).select("doc.*")
    first = judged.filter("NOT _lost").groupBy("_row").agg(F.min_by("doc", F.xxhash64("doc")).alias("doc")).select("doc")
    return passed.unionByName(single).unionByName(first).select("doc.*")


def likely_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id", bits_per_row: int = 12, hashes: int = 3) -> DataFrame:
    """Documents whose id may be in ``ids``: all that are, and a few more. Nothing is shuffled; join what comes out."""
    return _flag_ids(docs, ids, key, bits_per_row, hashes)[0].filter("_maybe").select("doc.*")


def _flag_ids(docs: DataFrame, ids: DataFrame, key: str, bits_per_row: int, hashes: int) -> tuple[DataFrame, DataFrame]:
    ids = cut(ids.select(F.col(key).alias("_drop")).filter(F.col("_drop").isNotNull()).distinct())
    n = ids.count()
    blocks = filter_blocks(n, bits_per_row)
    slots = ids.select(F.explode(F.array(*filter_slots(F.col("_drop"), blocks, hashes))).alias("slot"))
    packed = docs.select(F.struct(*docs.columns).alias("doc"))
    return flag_hits(packed, cut(build_filter(slots)), filter_slots(F.col("doc")[key], blocks, hashes)), ids


def text_chunks(batches: Iterable[pa.RecordBatch], size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of (…, text) batches whose texts have about ``size`` bytes together, with these texts.

    Bounds the memory of a task: only the texts of one slice are Python strings at a
    time. A longer text is a slice of its own. Null is the empty text.
    """
    for batch in batches:
        column = batch.column(batch.num_columns - 1)
        upto = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < len(column):
            before = upto[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(upto, before + size, side="right")))
            yield batch.slice(begin, end - begin), [t or "" for t in column.slice(begin, end - begin).to_pylist()]
            begin = end


def give_back() -> None:
    """Return to the system what was freed and is kept for later, by Arrow's pool and by the C library."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def lean(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """``run`` over the batches of a task, after which freed memory is given back.

    Spark keeps a Python worker for later tasks and stages; what an idle one holds
    counts beside whatever its executor does next.
    """
    @functools.wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole
