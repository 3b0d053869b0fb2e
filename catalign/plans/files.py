"""Queries for sources and sinks (2.A). Sinks write below the shared folder and are read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes as H
from ..operators.dedupe import union_roots
from ..operators.lookup import ingest_external
from ..operators.materials import unresolved_rows
from ..session import cut, scratch_path
from ..sources import documents as docs, sinks
from ..sources.files import read_ends, scan_files as scan
from . import adapters as A
from .adapters import table
from .registry import query


@query("a1_scan_files", """SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) + 1 AS BIGINT) AS length, 'txt' AS ext,
    substr(coalesce(html, '') || chr(10), 1, 1) AS first, chr(10) AS last FROM pages WHERE page_id IS NOT NULL""")
def scan_files(spark, sf):
    """Every page as a file of its own, found below two overlapping roots, with its first and last byte; the rest is not read."""
    root = scratch_path(spark, "page-files")
    folder = F.pmod("page_id", F.lit(16))
    pages = table(spark, sf, "pages").filter("page_id IS NOT NULL").select(
        F.format_string("folder=%d/%d/page_id=%d-%d.txt", folder, F.pmod(F.xxhash64("page_id"), F.lit(16)), "page_id",
                        F.monotonically_increasing_id()).alias("name"), folder.alias("folder"),
        F.concat(F.coalesce("html", F.lit("")), F.lit("\n")).alias("value"))
    sinks.write_files(pages, root, "name", "value")
    found = scan(spark, [root, f"{root}/folder=3"] if pages.filter("folder = 3").count() else [root], glob="*.txt", in_tasks=True)
    # A character has four bytes at most.
    return read_ends(found, 4, 1).select(
        F.regexp_extract("path", "page_id=(-?[0-9]+)-[0-9]+[.]txt$", 1).cast("bigint").alias("page_id"), "length", "ext",
        F.substring(F.col("head").cast("string"), 1, 1).alias("first"), F.col("tail").cast("string").alias("last"))


@query("a1_file_inventory", f"""WITH {A.SQL_FILES} SELECT path, ext, length FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY page_id) AS rn FROM files) WHERE rn = 1""")
def file_inventory(spark, sf):
    files = cut(A.files(spark, sf).select("path", "ext", "length", "page_id"))  # content is read here and not again
    return union_roots([files.filter(F.col("ext").isNotNull()), files], ["page_id"]).drop("page_id")


@query("a2_read_manifest", f"WITH {A.SQL_ASSETS} SELECT asset_id, width, height, format, candidate_hash, source FROM assets")
def read_manifest(spark, sf):
    schema = "asset_id string, width int, height int, format int, candidate_hash string, source string"
    path = scratch_path(spark, "manifest")
    sinks.write_lines(A.slim_assets(spark, sf).select("asset_id", "width", "height", "format", "candidate_hash", "source"), path)
    return docs.read_manifest(spark, [f"{path}-missing", path], schema, lines=True)


@query("a3_read_mapping", """SELECT upper(substr(sha256(text), 1, 16)) AS hash, lang || '/' || source || '-' || doc_id || '.png' AS name
    FROM documents
  UNION ALL SELECT lpad(doc_id::VARCHAR, 16, '0'), 'p' || doc_id || '.png' FROM documents
  UNION ALL SELECT lpad(doc_id::VARCHAR, 16, '0'), 'q' || doc_id || '.png' FROM documents""")
def read_mapping(spark, sf):
    doc = F.format_string(
        '{"textures":{"%s":"%s/%s-%d.png","no-hex":"x.png","%d":["p%d.png",7,"q%d.png"],"b":5,"c":null}}',
        F.substring(F.sha2("text", 256), 1, 16), "lang", "source", "doc_id", "doc_id", "doc_id", "doc_id")
    return docs.read_mapping(table(spark, sf, "documents").select(doc.alias("doc")), "doc")


@query("a3_write_mapping", """SELECT upper(substr(sha256(text), 1, 16)) AS hash, min(lang || '/' || source || '.png') AS name
  FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lang || '/' || source) = 1""")
def write_mapping(spark, sf):
    path = scratch_path(spark, "mapping")
    names = table(spark, sf, "documents").filter("text IS NOT NULL").select(
        F.upper(F.substring(F.sha2("text", 256), 1, 16)).alias("hash"), F.concat("lang", F.lit("/"), "source", F.lit(".png")).alias("name"))
    sinks.write_mapping(names, path, entries=500)
    return docs.read_mapping(spark.read.text(path), "value")


@query("a4_load_reports", """SELECT 'lines' AS report, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total FROM lineitem
  UNION ALL SELECT 'documents', count(*), CAST(sum(n_chars) AS BIGINT) FROM documents
  UNION ALL SELECT 'absent', NULL, NULL""")
def load_reports(spark, sf):
    path = scratch_path(spark, "reports")
    table(spark, sf, "lineitem").agg(
        F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("total")).write.json(f"{path}/lines")
    table(spark, sf, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total")).write.json(f"{path}/documents")
    return docs.load_reports(spark, {n: f"{path}/{n}" for n in ("lines", "documents", "absent")}, "n bigint, total bigint")


@query("a5_csv_report", "SELECT doc_id, lang, n_chars FROM documents")
def csv_report(spark, sf):
    path = scratch_path(spark, "csv")
    sinks.write_csv_report(table(spark, sf, "documents"), path, ["doc_id", "lang", "source", "n_chars"], redact=("source",))
    return spark.read.schema("doc_id bigint, lang string, n_chars bigint").csv(f"{path}/redacted", header=True)


@query("a6_publish", f"WITH {A.SQL_ASSETS} SELECT doc_id, asset_id, candidate_hash, width, height FROM assets")
def publish(spark, sf):
    path = scratch_path(spark, "published")
    a = A.slim_assets(spark, sf).select("doc_id", "asset_id", "candidate_hash", "width", "height")
    checks = {"bad_id": ~H.is_asset_id("asset_id"), "bad_hash": ~H.is_runtime_hash("candidate_hash")}
    sinks.publish(a.limit(0), path)
    try:  # a failing check leaves the earlier version in place
        sinks.publish(a, path, {"never": F.col("width") > 0})
    except sinks.PublishRejected:
        pass
    sinks.publish(a, path, checks, keys=["doc_id"])
    return sinks.read_published(spark, path)


@query("a6_expire_versions", """SELECT version, CAST(count(*) AS BIGINT) AS rows, CAST(sum(length(text) * version) AS BIGINT) AS chars
  FROM documents, (SELECT unnest([1, 3, 4]) AS version) GROUP BY 1""")
def expire_versions(spark, sf):
    """Four versions of the documents' lengths; the first is held by a reader and the second retired."""
    path = scratch_path(spark, "versions")
    sizes = cut(table(spark, sf, "documents").select("doc_id", F.length("text").alias("chars")))

    def totals(version, df):
        return df.agg(F.count("*").alias("rows"), F.sum("chars").alias("chars")).select(F.lit(version).alias("version"), "rows", "chars")

    sinks.publish(sizes, path, manifest=True)
    with sinks.held_version(spark, path, 1) as first:
        for version in (2, 3, 4):
            sinks.publish(sizes.withColumn("chars", F.col("chars") * version), path, manifest=True)
        sinks.expire_versions(spark, path, keep=2)
        found = cut(totals(1, first))
    for version in sinks.published_versions(spark, path):
        found = found.unionByName(totals(version, sinks.read_published(spark, path, version)))
    return found


@query("a7_write_partitioned", "SELECT doc_id, lang || '_' || source AS category FROM documents")
def write_partitioned(spark, sf):
    path = scratch_path(spark, "laid")
    d = table(spark, sf, "documents").select("doc_id", F.concat("lang", F.lit("/"), "source").alias("category"))
    sinks.write_partitioned(d, path)
    return spark.read.parquet(path).select("doc_id", F.col("category").cast("string").alias("category"))


@query("a8_export_report", """SELECT 'demo' AS game_id, count(*) AS assets, count(*) FILTER (n_chars > 5000) AS issues FROM documents""")
def export_report(spark, sf):
    path = scratch_path(spark, "export")
    a = A.slim_assets(spark, sf).select("asset_id", "width", "height", "format", "candidate_hash", "n_chars")
    issues = a.filter(F.col("n_chars") > 5000).select("asset_id", F.lit("size").alias("stage"))
    sinks.export_report(a, issues, {"game_id": "demo"}, path)
    return spark.read.schema("game_id string, assets bigint, issues bigint").json(f"{path}/header")


@query("a9_ingest_external", """WITH m AS (SELECT replace(url, 'http://', 'https://') AS path, md5(html) AS hash, page_id FROM pages),
    bp AS (SELECT path, min(page_id) AS v FROM m GROUP BY 1), bh AS (SELECT hash, min(page_id) AS v FROM m GROUP BY 1)
  SELECT url AS path, coalesce(bp.v, bh.v) AS value, CASE WHEN bp.v IS NOT NULL THEN 'first' WHEN bh.v IS NOT NULL THEN 'second' END
    AS matched_by
  FROM pages LEFT JOIN bp ON bp.path = url LEFT JOIN bh ON bh.hash = md5(html)""")
def external(spark, sf):
    p = table(spark, sf, "pages")
    files = p.select(F.col("url").alias("path"), F.md5("html").alias("hash"))
    manifest = p.select(F.replace("url", F.lit("http://"), F.lit("https://")).alias("path"), F.md5("html").alias("hash"),
                        F.col("page_id").alias("value"))
    return ingest_external(files, manifest, "path", "hash", "value", ["value"]).drop("hash")


SQL_REASONS = f"""{A.SQL_STAGES}, reasons AS (
    SELECT material, array_to_string(list_sort(list(DISTINCT CASE WHEN source_id = 0 THEN 'inadmissible source' ELSE 'operand out of range' END)), ' | ')
      AS reasons FROM stages WHERE source_id = 0 OR operand_id > 7 GROUP BY 1)"""


@query("a10_write_unresolved", f"WITH {SQL_REASONS} SELECT material, reasons FROM reasons")
def write_unresolved(spark, sf):
    path = scratch_path(spark, "unresolved")
    # Two possible reasons, so the set per material stays that small.
    why = F.when(F.col("source_id") == 0, "inadmissible source").when(F.col("operand_id") > 7, "operand out of range")
    m = A.stages(spark, sf).groupBy("material").agg(F.array_sort(F.collect_set(why)).alias("reasons")).withColumn(
        "status", F.when(F.size("reasons") > 0, "unresolved").otherwise("resolved"))
    unresolved_rows(m).select("material", "reasons").write.csv(path, header=True)
    return spark.read.schema("material bigint, reasons string").csv(path, header=True)
