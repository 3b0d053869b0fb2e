"""Readers, writers, publishing and streams."""

import json

import pytest
from pyspark.sql import functions as F

from catalign.operators.evidence import merge_evidence
from catalign.session import shared_dir
from catalign.sources import documents as D, sinks as K
from catalign.sources.files import read_ends, scan_files
from catalign.streaming import evidence as ST


def test_scan_files(spark, tmp_path, rows):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.STEX").write_bytes(b"x" * 10)
    (tmp_path / "in" / "deep" / "b.bin").write_bytes(b"y" * 99)
    root = str(tmp_path / "in")
    df = scan_files(spark, [root, root + "/deep"])
    assert rows(df.select(F.substring_index("path", "/", -1), "length", "ext")) == [("a.STEX", 10, "stex"), ("b.bin", 99, "bin")]
    small = scan_files(spark, root, max_len=50)
    assert small.count() == 1
    plan = small._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,50)]" in plan.split("PushedFilters")[-1] and "content" not in plan.split("ReadSchema")[-1]


def test_files_listed_in_tasks(spark, tmp_path, rows):
    """The same files as Spark's own listing, but in tasks of thousands of files: Spark's source plans one for some 30."""
    root = str(tmp_path / "in %dir")
    names = spark.range(900).select(F.format_string("k=%d/é %%41-%d.txt", F.col("id") % 7, "id").alias("name"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("value"))
    assert K.write_files(names, root) == 900
    odd = spark.createDataFrame([("a.TXT", "up"), ("_k/hidden.txt", "h"), ("k=8/_hidden.txt", "h"), ("k=8/_a=b.txt", "seen"), ("k=8/.h.txt", "h"), ("k=8/b.csv", "c")], "name string, value string")
    assert K.write_files(odd, root) == 6 and K.write_files(odd, root) == 6  # another attempt puts the same in place
    for glob in (None, "*.txt", "*.{csv,TXT}", "?.[a-cT]*", "_a=b.txt"):
        own = scan_files(spark, [root, f"{root}/k=3"], glob, in_tasks=True)
        assert rows(own) == rows(scan_files(spark, [root, f"{root}/k=3"], glob)) and own.count() > 0, glob
    assert scan_files(spark, root, max_len=2, in_tasks=True).count() == 4
    assert scan_files(spark, root, in_tasks=True).rdd.getNumPartitions() <= 8 < scan_files(spark, root).rdd.getNumPartitions()
    assert K.write_files(names.limit(0), root + "/none") == 0 and scan_files(spark, root + "/none", in_tasks=True).count() == 0


def test_manifests(spark, tmp_path, rows):
    bad, good = tmp_path / "bad.json", tmp_path / "good.json"
    bad.write_text("{nope")
    good.write_text(json.dumps({"title_id": "t", "assets": [{"asset_id": "a", "w": 1}, {"asset_id": "b"}]}, indent=1))
    schema = "asset_id string, w int"
    assert rows(D.read_manifest(spark, [str(tmp_path / "none"), str(good)], schema)) == [("a", 1), ("b", None)]
    assert D.read_manifest(spark, [str(bad), str(good)], schema).count() == 0
    assert D.read_manifest(spark, [str(tmp_path / "none")], schema).count() == 0


def test_mapping_documents(spark, rows):
    docs = [json.dumps({"textures": {"ab": "x.png", "zz": "y.png", "0C": ["p", "q", 3, None], "d": 7, "e": None, "f": {"g": "h"}, "1": "[literal"}}),
            "{broken", json.dumps({"other": 1})]
    df = spark.createDataFrame([(d,) for d in docs], "doc string")
    pad = "0" * 14
    assert rows(D.read_mapping(df, "doc")) == [
        (pad + "01", "[literal"), (pad + "0C", "p"), (pad + "0C", "q"), (pad + "AB", "x.png")]


def test_reports(spark, tmp_path, rows):
    (tmp_path / "a.json").write_text('{"n": 3}')
    (tmp_path / "b.json").write_text("{oops")
    got = D.load_reports(spark, {k: str(tmp_path / f"{k}.json") for k in "abc"}, "n bigint")
    assert rows(got) == [("a", 3), ("b", None), ("c", None)]
    assert D.load_reports(spark, {"x": str(tmp_path / "none")}, "n bigint").count() == 1


def test_ends_of_files_of_any_size(spark, tmp_path, rows):
    """The large file is sparse and beyond what a content column can hold, so only its ends can have been read."""
    root = tmp_path / "in dir"
    root.mkdir()
    contents = {"a b.bin": b"MAGIC tail", "é%41.bin": b"xy"}
    (root / "empty.bin").touch()  # not listed
    for name, content in contents.items():
        (root / name).write_bytes(content)
    with open(root / "large.bin", "wb") as f:
        f.write(b"FARC")
        f.seek((3 << 30) - 3)
        f.write(b"end")
    files = scan_files(spark, str(root))
    got = {p.rpartition("/")[2]: (n, bytes(h), bytes(t)) for p, n, h, t in rows(read_ends(files, 5, 3), "path", "length", "head", "tail")}
    assert got == {k: (len(v), v[:5], v[-3:]) for k, v in contents.items()} | {"large.bin": (3 << 30, b"FARC\0", b"end")}
    gone = read_ends(files.select(F.concat("path", F.lit("x")).alias("path"), "length"), 5)
    assert {(r["head"], r["tail"]) for r in gone.collect()} == {(None, None)} and read_ends(files.limit(0), 5).count() == 0


def test_publish_failure_keeps_previous(spark, tmp_path, rows):
    root = str(tmp_path / "table")
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    K.publish(one, root, {"empty": F.col("v") == ""}, keys=["id"])
    versions = set((tmp_path / "table" / "versions").iterdir())
    with pytest.raises(K.PublishRejected, match="empty"):
        K.publish(spark.createDataFrame([(2, "")], one.schema), root, {"empty": F.col("v") == ""})
    with pytest.raises(K.PublishRejected, match="duplicate_key"):
        K.publish(one.unionAll(one), root, keys=["id"])
    with pytest.raises(Exception):
        K.publish(one.withColumn("v", F.raise_error(F.lit("disk full")).cast("string")), root)
    assert rows(K.read_published(spark, root)) == [(1, "a")]
    assert set((tmp_path / "table" / "versions").iterdir()) == versions
    # A publisher that starts first and ends last is the one that is read; a taken number is skipped.
    (tmp_path / "table" / "pointers" / "2").write_text(K._folder(spark, root, 1))
    late = one.withColumn("v", F.lit("late"))
    numbers = [K._commit(spark, root, K._folder(spark, root, 1)), K.publish(late, root)]
    assert numbers == [3, 4] and rows(K.read_published(spark, root)) == [(1, "late")]
    assert rows(K.read_published(spark, root, 1)) == [(1, "a")]
    # Publishing may read what is published.
    K.publish(K.read_published(spark, root).withColumn("v", F.lit("b")), root)
    assert rows(K.read_published(spark, root)) == [(1, "b")]


def test_versions_expire_while_a_reader_holds_one(spark, tmp_path, rows):
    root, folder = str(tmp_path / "table"), tmp_path / "table"
    one = spark.createDataFrame([(1, "a")], "id int, v string")
    assert K.expire_versions(spark, root) == [] and not K.has_published(spark, root)
    for n in range(1, 6):
        assert K.publish(one.withColumn("id", F.lit(n)), root, manifest=True) == n
    with K.held_version(spark, root, 2) as held:
        assert K.expire_versions(spark, root, keep=2) == [1, 2, 3]
        assert rows(held) == [(2, "a")] and K.published_versions(spark, root) == [4, 5]
        assert len(list((folder / "versions").iterdir())) == 3
    # Released, it goes with the next expiry; what is kept is whole.
    assert K.expire_versions(spark, root, keep=2) == []
    assert len(list((folder / "versions").iterdir())) == len(list((folder / "manifests").iterdir())) == 2
    assert not list((folder / "holds").glob("[!.]*")) and rows(K.read_published(spark, root)) == [(5, "a")]
    # Numbers go on, also when the note of the last one is lost or behind.
    (folder / "last").unlink()
    (folder / ".last.crc").unlink()
    assert K.publish(one, root) == 6
    (folder / "last").write_text("4")
    (folder / ".last.crc").unlink()
    assert rows(K.read_published(spark, root)) == [(1, "a")] and K.publish(one, root) == 7
    # A running publisher's folder stays, one left behind goes; so does a version whose hold is too old.
    (folder / "versions" / "running").mkdir()
    with K.held_version(spark, root, 6):
        assert K.expire_versions(spark, root, keep=1) == [4, 5, 6] and (folder / "versions" / "running").exists()
        assert len(list((folder / "versions").iterdir())) == 3
        K.expire_versions(spark, root, keep=1, stale_seconds=-5)
    assert [p.name for p in (folder / "versions").iterdir()] == [K._folder(spark, root, 7)]
    with pytest.raises(ValueError):
        K.expire_versions(spark, root, keep=0)


def test_manifest_shows_changed_files(spark, tmp_path, rows):
    root = str(tmp_path / "table")
    K.publish(spark.range(40).repartition(3), root, manifest=True)
    assert K.verify_published(spark, root).count() == 0
    files = sorted((tmp_path / "table" / "versions" / K._folder(spark, root, 1)).glob("part-*"))
    whole = files[0].read_bytes()
    files[0].write_bytes(whole[:-1] + b"?")
    (files[0].parent / f".{files[0].name}.crc").unlink()  # else the local file system refuses to read it
    (files[0].parent / "part-extra").write_bytes(b"x")
    files[1].unlink()
    assert rows(K.verify_published(spark, root)) == sorted([(files[0].name, "changed"), ("part-extra", "added"), (files[1].name, "missing")])


def test_local_folders_are_for_local_sessions_only():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            getCheckpointDir = staticmethod(lambda: None)

    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn"):
        Session.sparkContext.master = master
        with pytest.raises(RuntimeError):
            shared_dir(Session)


def test_partitioned_and_csv(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a/b", "s,1"), (2, "con", 'q"x')], "id int, category string, source string")
    K.write_partitioned(df, str(tmp_path / "p"))
    assert {p.name for p in (tmp_path / "p").iterdir() if p.is_dir()} == {"category=a_b", "category=_con"}
    K.write_csv_report(df, str(tmp_path / "c"), ["id", "source"], redact=("source",))
    assert spark.read.csv(str(tmp_path / "c/redacted"), header=True).columns == ["id"]
    assert rows(spark.read.csv(str(tmp_path / "c/full"), header=True, escape='"'), "source") == [('q"x',), ("s,1",)]


HOW = (["asset", "hash"], "rank", ["at"])


def test_stream_equals_batch_and_replay_is_harmless(spark, tmp_path, rows):
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    data = [(i % 5, i % 3, (i * 7) % 4, i) for i in range(60)]
    schema = "asset int, hash int, rank int, at int"
    for part in range(3):
        spark.createDataFrame(data[part::3], schema).coalesce(1).write.mode("append").parquet(src)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.stream_upsert(source, root, *HOW, f"{root}/progress").awaitTermination()
    want = rows(merge_evidence(spark.createDataFrame(data, schema), *HOW))
    assert rows(ST.read_merged(spark, root, *HOW)) == want
    ST.compact(spark, root, *HOW)
    assert rows(ST.read_merged(spark, root, *HOW)) == want
    # A second start finds nothing new; later files continue the same table.
    late = [(0, 0, 3, -1)]
    spark.createDataFrame(late, schema).write.mode("append").parquet(src)
    ST.stream_upsert(source, root, *HOW, f"{root}/progress").awaitTermination()
    assert rows(ST.read_merged(spark, root, *HOW)) == rows(merge_evidence(spark.createDataFrame(data + late, schema), *HOW))
    # What a base holds is not read from deltas again, so these may go.
    ST.compact(spark, root, *HOW)
    (tmp_path / "out" / "deltas").rename(tmp_path / "gone")
    assert rows(ST.read_merged(spark, root, *HOW)) == rows(merge_evidence(spark.createDataFrame(data + late, schema), *HOW))
    empty = str(tmp_path / "empty")
    with pytest.raises(ValueError):
        ST.read_merged(spark, empty, *HOW)
    assert ST.read_merged(spark, empty, *HOW, spark.createDataFrame(data, schema).schema).count() == 0


def test_stream_dedupe_loses_no_key(spark, tmp_path, rows):
    """One file per batch, times out of order, keys that recur over batches; a replayed batch changes nothing."""
    src, root = str(tmp_path / "src"), str(tmp_path / "out")
    schema = "asset int, hash int, ts timestamp"
    data = [(i % 11, i % 7, f"2024-01-{1 + (i * 13) % 28:02d} 00:00:00") for i in range(200)]
    for part in range(4):
        frame = spark.createDataFrame(data[part::4], "asset int, hash int, ts string").selectExpr("asset", "hash", "cast(ts AS timestamp) AS ts")
        frame.coalesce(1).write.mode("append").parquet(src)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    ST.stream_dedupe(source, root, ["asset", "hash"], f"{root}/progress").awaitTermination()
    want = sorted({(a, h) for a, h, _ in data})
    assert sorted(rows(ST.read_deduped(spark, root, ["asset", "hash"]))) == want and len(list((tmp_path / "out" / "deltas").glob("batch=*"))) == 4
    ST.stream_dedupe(source, root, ["asset", "hash"], f"{root}/again").awaitTermination()
    assert sorted(rows(ST.read_deduped(spark, root, ["asset", "hash"]))) == want


@pytest.mark.parametrize("files", [1, 3, 7])
def test_stream_keeps_the_first_whole_row_for_any_batches(spark, tmp_path, rows, files):
    """Times run backwards over the batches, so every later batch has rows that come first; null times come before all."""
    src, root, keys, order = str(tmp_path / "src"), str(tmp_path / "out"), ["asset"], ["at", "path"]
    schema = "asset int, at int, path string, size int"
    data = [(i % 9 if i % 10 else None, None if i % 31 == 0 else 100 - i // 4, f"p{i % 5}", i) for i in range(90)]
    for part in range(files):
        spark.createDataFrame(data[part::files], schema).coalesce(1).write.mode("append").parquet(src)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    want = {}
    for row in sorted(data, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
        want.setdefault(row[0], row)
    for progress in ("progress", "again"):  # every batch is sent twice
        ST.stream_dedupe(source, root, keys, f"{root}/{progress}", [*order, "size"]).awaitTermination()
        got = rows(ST.read_deduped(spark, root, keys, order_by=[*order, "size"]))
        assert got == sorted(want.values(), key=lambda t: tuple((x is None, str(x)) for x in t))


def test_mapping_is_written_and_read_back(spark, tmp_path, rows):
    pairs = [(f"{n:016X}", f"d/{n % 7}\"é.png") for n in range(300)]
    odd = [(pairs[0][0], pairs[0][1]), ("F" * 16, "a.png"), ("F" * 16, "b.png"), (None, "c.png"), ("E" * 16, None)]
    mapping = spark.createDataFrame(pairs + odd, "hash string, name string")
    out = str(tmp_path / "mapping")
    K.write_mapping(mapping, out, entries=50)
    lines = spark.read.text(out)
    assert 3 <= lines.count() <= 9
    assert rows(D.read_mapping(lines, "value")) == sorted(pairs)
    K.write_mapping(mapping.limit(0), out)
    assert spark.read.text(out).count() == 0
