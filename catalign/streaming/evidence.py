"""Evidence arriving as a stream.

The merge keeps the strongest, then earliest row per key, which is
commutative, associative and idempotent. A micro-batch therefore only appends
its own merged rows under its batch id; replaying a batch overwrites the same
folder, and the table is the merge over base and deltas. Work per batch grows
with the batch, not with the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.evidence import merge_evidence
from ..operators.ranking import first_per_group
from ..sources.documents import path_exists
from ..sources.sinks import expire_versions, has_published, publish, read_published


def stream_upsert(source: DataFrame, root: str, keys: list[str], rank: str, order_by: list[str], checkpoint: str):
    """Start the stream over what is available; returns the query."""
    def merge(batch: DataFrame, batch_id: int) -> None:
        merge_evidence(batch, keys, rank, order_by).write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")

    return source.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def _arrived(spark: SparkSession, root: str, schema: StructType | None) -> tuple[DataFrame, int, bool]:
    """Rows of the base and of the deltas that it does not hold yet, the last batch among them, and whether all are of the base."""
    parts, upto, merged = [], -1, False
    if has_published(spark, f"{root}/base"):
        base = read_published(spark, f"{root}/base")
        upto = base.agg(F.max("_upto")).first()[0]
        upto = -1 if upto is None else upto
        parts.append(base.drop("_upto"))
        merged = True
    if path_exists(spark, f"{root}/deltas"):
        # The batch is a folder, so folded batches are not read again.
        deltas = spark.read.parquet(f"{root}/deltas").filter(F.col("batch") > upto)
        last = deltas.agg(F.max("batch")).first()[0]
        if last is not None:
            parts.append(deltas.drop("batch"))
            upto, merged = last, False
    if not parts:
        if schema is None:
            raise ValueError(f"nothing has arrived below {root}; give a schema to read an empty table")
        parts.append(spark.createDataFrame([], schema))
    return (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])), upto, merged


def read_merged(spark: SparkSession, root: str, keys: list[str], rank: str, order_by: list[str],
                schema: StructType | None = None) -> DataFrame:
    """The current table; ``schema`` is that of the source, for a root where nothing has arrived."""
    rows, _, merged = _arrived(spark, root, schema)
    return rows if merged else merge_evidence(rows, keys, rank, order_by)


def compact(spark: SparkSession, root: str, keys: list[str], rank: str, order_by: list[str],
            schema: StructType | None = None, keep: int = 10) -> None:
    """Fold the deltas into a new published base, which records the last batch it holds; only later ones are read then.

    Bases before the last ``keep`` are retired, unless a reader holds them.
    """
    rows, upto, _ = _arrived(spark, root, schema)
    publish(merge_evidence(rows, keys, rank, order_by).withColumn("_upto", F.lit(upto).cast("bigint")), f"{root}/base",
            checks={"null_key": F.col(keys[0]).isNull()})
    expire_versions(spark, f"{root}/base", keep)


def stream_dedupe(source: DataFrame, root: str, keys: list[str], checkpoint: str, order_by: list[str] | None = None):
    """Start the stream over what is available; each micro-batch appends its distinct keys under its batch id.

    With ``order_by``, a total order of the rows of a key, it appends the first whole row of each key instead. No state
    and no watermark: no key is lost however late it comes, a late row that is first in the order takes the place of
    the row before, and a replayed batch overwrites its own folder. Keys that recur over batches are merged when they are read.
    """
    def append(batch: DataFrame, batch_id: int) -> None:
        _first(batch, keys, order_by).write.mode("overwrite").parquet(f"{root}/deltas/batch={batch_id}")

    return source.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()


def read_deduped(spark: SparkSession, root: str, keys: list[str], schema: StructType | None = None,
                 order_by: list[str] | None = None) -> DataFrame:
    """Each key that has arrived, once; with ``order_by`` its first row, the same for every split into batches."""
    return _first(_arrived(spark, root, schema)[0], keys, order_by)


def _first(rows: DataFrame, keys: list[str], order_by: list[str] | None) -> DataFrame:
    if order_by is None:
        return rows.select(*keys).distinct()
    return first_per_group(rows, keys, order_by, [c for c in rows.columns if c not in keys])
