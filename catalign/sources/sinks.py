"""Reports and published tables."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .documents import path_exists
from .files import system_of


class PublishRejected(Exception):
    """A check found violations; the published table is unchanged."""


def write_csv_report(df: DataFrame, path: str, columns: list[str], redact: tuple[str, ...] = ()) -> None:
    """Full CSV, and a second one without the redacted columns."""
    df.select(*columns).write.mode("overwrite").csv(f"{path}/full", header=True, escape='"')
    df.select(*[c for c in columns if c not in redact]).write.mode("overwrite").csv(
        f"{path}/redacted", header=True, escape='"')


def write_partitioned(df: DataFrame, path: str, by: str = "category", label: Column | None = None) -> None:
    """Parquet laid out by a sanitised category.

    Rows are rebalanced by category first: small categories meet in one task and
    one file, hot ones are split to the advisory size.
    """
    from ..functions.names import safe_export

    laid = df.withColumn(by, label if label is not None else safe_export(by))
    laid.hint("rebalance", by).write.mode("overwrite").partitionBy(by).option("maxRecordsPerFile", 5_000_000).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    """JSON lines, one asset per line."""
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_files(rows: DataFrame, path: str, name: str = "name", value: str = "value") -> int:
    """A file of its own for every row, by its name below ``path`` and with its value as content; returns how many.

    Tasks write below a hidden name and rename, so nothing is left to a commit in the driver and another attempt of a task
    puts the same content in place. Names must be unique. On file systems that Arrow knows.
    """
    def run(batches):
        system, root = system_of(path)
        made, n = {root}, 0
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                folder, _, base = f"{root}/{file}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder)
                    made.add(folder)
                draft = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as f:
                    f.write(content.as_buffer() if content.is_valid else b"")
                system.move(draft, f"{folder}/{base}")
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    system, root = system_of(path)
    system.create_dir(root)
    return rows.select(F.col(name), F.col(value).cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def mapping_documents(mapping: DataFrame, root: str = "textures", hash_="hash", name="name", entries: int = 10_000) -> DataFrame:
    """Mapping objects ``{root: {hash: name}}`` of about ``entries`` keys each, in key order; the inverse of ``read_mapping``.

    A hash with several names maps nothing. Keys are unique and dealt by their digest, so no object depends on how often
    a name occurs.
    """
    one = mapping.filter(F.col(hash_).isNotNull() & F.col(name).isNotNull()).groupBy(hash_).agg(
        F.min(name).alias("_lo"), F.max(name).alias("_hi")).filter("_lo = _hi")
    count = mapping.agg(F.approx_count_distinct(hash_)).first()[0]
    bucket = F.pmod(F.xxhash64(hash_), F.lit(max(1, -(-count // entries))))
    return one.groupBy(bucket.alias("_bucket")).agg(F.sort_array(F.collect_list(F.struct(hash_, "_lo"))).alias("_pairs")).select(
        F.to_json(F.struct(F.map_from_entries("_pairs").alias(root))).alias("value"))


def write_mapping(mapping: DataFrame, path: str, root: str = "textures", hash_="hash", name="name", entries: int = 10_000) -> None:
    """Mapping objects as JSON, one a line."""
    mapping_documents(mapping, root, hash_, name, entries).write.mode("overwrite").text(path)


def export_report(assets: DataFrame, issues: DataFrame, identity: dict[str, str], path: str) -> None:
    """Flat export table, issues, and a header row with identity and counts."""
    assets.write.mode("overwrite").json(f"{path}/assets", ignoreNullFields=False)
    issues.write.mode("overwrite").json(f"{path}/issues", ignoreNullFields=False)
    export_header(assets, issues, identity).write.mode("overwrite").json(f"{path}/header")


def export_header(assets: DataFrame, issues: DataFrame, identity: dict[str, str]) -> DataFrame:
    tagged = assets.select(F.lit(1).alias("a")).unionByName(issues.select(F.lit(0).alias("a")))
    return tagged.agg(F.count_if(F.col("a") == 1).alias("assets"), F.count_if(F.col("a") == 0).alias("issues")).select(
        *[F.lit(v).alias(k) for k, v in identity.items()], "assets", "issues")


def publish(df: DataFrame, root: str, checks: dict[str, Column] | None = None, keys: list[str] | None = None,
            manifest: bool = False) -> int:
    """Write, audit, then publish.

    The data goes to a new version folder. Each check is a condition that marks
    violating rows, ``keys`` must be unique. Only when all counts are zero does
    the version get the next number in the pointer log that readers follow;
    until then, and after a failure, readers see the previous version. Numbers are
    given at the commit by creating a file that must not exist yet: of two
    publishers the one that ends last is the one that is read. With ``manifest``
    the files' lengths and digests are stored for ``verify_published``. Returns the number.
    """
    spark = df.sparkSession
    folder = uuid.uuid4().hex
    staged = f"{root}/versions/{folder}"
    try:
        df.write.parquet(staged)
        written = spark.read.schema(df.schema).parquet(staged)
        found = written.agg(
            F.count("*").alias("rows"), *[F.count_if(c).alias(name) for name, c in (checks or {}).items()]
        ).first().asDict()
        found.pop("rows")
        if keys:
            found["duplicate_key"] = written.groupBy(*keys).count().filter(F.col("count") > 1).count()
        broken = {k: v for k, v in found.items() if v}
        if broken:
            raise PublishRejected(str(broken))
        if manifest:
            _files(spark, staged).write.parquet(f"{root}/manifests/{folder}")
    except Exception:
        _drop(spark, staged)
        _drop(spark, f"{root}/manifests/{folder}")
        raise
    return _commit(spark, root, folder)


def read_published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The version of that number, or the last one."""
    return spark.read.parquet(_version_path(spark, root, _last(spark, root) if version is None else version))


def has_published(spark: SparkSession, root: str) -> bool:
    return _last(spark, root) > 0


def published_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers that can be read, oldest first."""
    return sorted(int(n) for n in _names(spark, f"{root}/pointers") if n.isdigit())


def verify_published(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(file, problem) where a version published with a manifest differs from it: missing, added, or changed files."""
    folder = _folder(spark, root, _last(spark, root) if version is None else version)
    wanted = spark.read.parquet(f"{root}/manifests/{folder}").select("file", F.struct("length", "sha256").alias("_want"))
    there = _files(spark, f"{root}/versions/{folder}").select("file", F.struct("length", "sha256").alias("_have"))
    problem = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "added").when(
        F.col("_have") != F.col("_want"), "changed")
    return wanted.join(there, "file", "full").select("file", problem.alias("problem")).filter("problem IS NOT NULL")


@contextmanager
def held_version(spark: SparkSession, root: str, version: int | None = None) -> Iterator[DataFrame]:
    """A version, the last one by default, that ``expire_versions`` leaves alone until the block ends.

    The hold is written before the pointer is looked at again, and expiry takes the pointer away before it looks for
    holds: either the reader sees that the version is gone, and takes the next, or expiry sees the hold.
    """
    while True:
        number = _last(spark, root) if version is None else version
        folder = _folder(spark, root, number)
        hold = f"{root}/holds/{folder}-{uuid.uuid4().hex}"
        _write(spark, hold, str(number))
        if path_exists(spark, f"{root}/pointers/{number}"):
            break
        _drop(spark, hold)
    try:
        yield spark.read.parquet(f"{root}/versions/{folder}")
    finally:
        _drop(spark, hold)


def expire_versions(spark: SparkSession, root: str, keep: int = 10, stale_seconds: float = 7 * 86_400) -> list[int]:
    """Retire all but the last ``keep`` versions; returns their numbers.

    A retired version has no pointer, so nobody starts to read it. Its folder goes as soon as no pointer and no hold
    names it, at the latest with a later expiry. Holds older than ``stale_seconds`` count as left behind, and so do folders
    of that age that were never published. Folders of running publishers are younger and stay, as do those without a
    time (object stores give none).
    """
    if keep < 1:
        raise ValueError("at least the last version stays")
    retired = published_versions(spark, root)[:-keep]
    for number in retired:
        _write(spark, f"{root}/retired/{_folder(spark, root, number)}", str(number))
        _drop(spark, f"{root}/pointers/{number}")
    # What is still named is read after the pointers went.
    old = time.time() - stale_seconds
    used = {_folder(spark, root, n) for n in published_versions(spark, root)}
    used |= {name.partition("-")[0] for name, at in _names(spark, f"{root}/holds").items() if at >= old}
    marked = _names(spark, f"{root}/retired")
    for folder, at in _names(spark, f"{root}/versions").items():
        if folder not in used and (folder in marked or 0 < at < old):
            for part in ("versions", "manifests", "retired"):
                _drop(spark, f"{root}/{part}/{folder}")
    return retired


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Data files of a folder with length and digest, computed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        F.substring_index("path", "/", -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def _names(spark: SparkSession, path: str) -> dict[str, float]:
    """Entries of a folder and when they were last changed, in seconds; nothing is opened."""
    fs, p = _file(spark, path)
    return {f.getPath().getName(): f.getModificationTime() / 1000 for f in fs.listStatus(p)} if fs.exists(p) else {}


def _last(spark: SparkSession, root: str) -> int:
    """Number of the last version, 0 without any.

    Numbers have no gaps above the oldest pointer, so the search starts at the number noted by some publisher and
    goes up; the log is listed only where that note is missing or names a retired version.
    """
    try:
        number = int(_read(spark, f"{root}/last"))
    except (Py4JJavaError, ValueError):
        number = 0
    if not number or not path_exists(spark, f"{root}/pointers/{number}"):
        number = max(published_versions(spark, root), default=0)
    while number and path_exists(spark, f"{root}/pointers/{number + 1}"):
        number += 1
    return number


def _folder(spark: SparkSession, root: str, number: int) -> str:
    """A pointer is a file ``<number>`` that holds the folder's name."""
    return _read(spark, f"{root}/pointers/{number}")


def _version_path(spark: SparkSession, root: str, number: int) -> str:
    return f"{root}/versions/{_folder(spark, root, number)}"


def _commit(spark: SparkSession, root: str, folder: str) -> int:
    number = _last(spark, root) + 1
    while not _write(spark, f"{root}/pointers/{number}", folder, overwrite=False):  # somebody else has the number
        number += 1
    _write(spark, f"{root}/last", str(number))
    return number


def _write(spark: SparkSession, path: str, text: str, overwrite: bool = True) -> bool:
    """Write a small file; False if it exists and must not be overwritten."""
    fs, p = _file(spark, path)
    try:
        out = fs.create(p, overwrite)
    except Py4JJavaError as e:
        if "AlreadyExists" not in e.java_exception.getClass().getName():
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


def _read(spark: SparkSession, path: str) -> str:
    fs, p = _file(spark, path)
    given = fs.open(p)
    try:
        return bytes(given.readAllBytes()).decode()
    finally:
        given.close()


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _drop(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)
