"""File inventories."""

from __future__ import annotations

import re
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths as P
from ..session import cut

#: Names that Spark's sources do not list.
HIDDEN = re.compile(r"_[^=]*$|\.|.*\._COPYING_$", re.DOTALL)


#: Files that one task goes through and folders that it lists, about, and how many tasks there are at most.
FILES_PER_TASK, FOLDERS_PER_TASK, MAX_TASKS = 5_000, 50, 20_000


def scan_files(spark: SparkSession, roots: str | list[str], glob: str | None = None, max_len: int | None = None,
               content: bool = False, in_tasks: bool = False) -> DataFrame:
    """Files below the roots, each once, with extension and length.

    Content is not read unless asked for; the size filter reaches the source. Spark's file sources
    do not list files without any byte, so these are not found.

    Spark's sources hold the whole listing in the driver and plan a task for some 30 files. With ``in_tasks``
    (without content, on file systems that Arrow knows) folders are listed in tasks, level by level, so millions of files may be found.
    """
    if in_tasks:
        found = _list_in_tasks(spark, [roots] if isinstance(roots, str) else roots, glob)
        return (found if max_len is None else found.filter(F.col("length") <= max_len)).withColumn("ext", P.extension("path"))

    def one(root):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        return reader.load(root)

    roots = [roots] if isinstance(roots, str) else roots
    cols = ["path", "length"] + (["content"] if content else [])
    # One load per root, and overlapping roots list a file twice.
    df = reduce(lambda a, b: a.unionByName(b), [one(r).select(*cols) for r in roots])
    if max_len is not None:
        df = df.filter(F.col("length") <= max_len)
    if len(roots) > 1:
        df = df.dropDuplicates(["path"])
    return df.withColumn("ext", P.extension("path"))


def read_ends(files: DataFrame, head: int, tail: int = 0, path: str = "path", length: str = "length") -> DataFrame:
    """Files with ``head`` and ``tail``, their first and last bytes; nothing between is read, so files may have any size.

    For what only looks at magics, footers or a bounded prefix. A file that has gone, has shrunk or cannot be opened since the
    listing has nulls. Paths are those of ``scan_files``; executors open them by the file systems of Arrow.
    """
    named = files.select(F.col(path).alias("path"), F.col(length).alias("length"))

    def run(batches):
        for batch in batches:
            ends = [_ends(p, n, head, tail) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([e[0] for e in ends], pa.binary()), pa.array([e[1] for e in ends], pa.binary())],
                names=["path", "length", "head", "tail"])

    return named.mapInArrow(run, "path string, length long, head binary, tail binary").withColumn("ext", P.extension("path"))


def system_of(path: str) -> tuple[pafs.FileSystem, str]:
    """Arrow's file system of a path, and what the path is called there."""
    if path.startswith("file:") or path.startswith("/"):
        return pafs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def _list_in_tasks(spark: SparkSession, roots: list[str], glob: str | None) -> DataFrame:
    """Path and length of the files below the roots; hidden and empty ones are left out, as Spark's sources do."""
    wanted = re.compile(_glob_pattern(glob) if glob else ".*", re.DOTALL)

    def run(batches):
        for batch in batches:
            for folder in batch.column("path").to_pylist():
                system, name = system_of(folder)
                start = "file:" if isinstance(system, pafs.LocalFileSystem) else folder[:len(folder) - len(name)]
                infos = [i for i in system.get_file_info(pafs.FileSelector(name)) if not HIDDEN.match(i.base_name)]
                infos = [i for i in infos if i.type == pafs.FileType.Directory or i.size and wanted.fullmatch(i.base_name)]
                for n in range(0, len(infos), FILES_PER_TASK):
                    some = infos[n:n + FILES_PER_TASK]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([start + i.path for i in some], pa.string()),
                         pa.array([None if i.type == pafs.FileType.Directory else i.size for i in some], pa.int64())], names=["path", "length"])

    folders = spark.createDataFrame([(r,) for r in roots], "path string")
    found = spark.createDataFrame([], "path string, length long")
    cores = spark.sparkContext.defaultParallelism
    while n := folders.count():
        tasks = min(MAX_TASKS, max(min(n, cores), -(-n // FOLDERS_PER_TASK)))
        listed = cut(folders.repartition(tasks, "path").mapInArrow(run, "path string, length long"))
        found = found.unionByName(listed.filter("length IS NOT NULL"))
        folders = listed.filter("length IS NULL").select("path").distinct()
    # A given number of tasks: listings are small, but what is done with each file is not.
    tasks = min(MAX_TASKS, max(cores, -(-found.count() // FILES_PER_TASK)))
    return found.repartition(tasks, "path").dropDuplicates(["path"])


def _glob_pattern(glob: str) -> str:
    """A glob of Hadoop's as a regular expression."""
    out, depth, escaped = "", 0, False
    for c in glob:
        if escaped or c not in "\\*?{},[]!":
            out, escaped = out + (c if c == "-" or c == "^" and out.endswith("[") else re.escape(c)), False
        elif c == "\\":
            escaped = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            out += "(?:" if c == "{" else ")"
        else:
            out += {"*": ".*", "?": ".", ",": "|" if depth else ",", "!": "^" if out.endswith("[") else "!"}.get(c, c)
    return out


def _ends(path: str, length: int, head: int, tail: int) -> tuple[bytes | None, bytes | None]:
    try:
        system, name = system_of(path)
        with system.open_input_file(name) as f:
            first = f.read_at(min(head, length), 0)
            last = f.read_at(min(tail, length), length - min(tail, length))
    except OSError:
        return None, None
    return (first, last) if len(first) == min(head, length) and len(last) == min(tail, length) else (None, None)
