"""Queries for aggregations (2.D) and the fingerprint comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as C, values as V
from ..operators import dedupe, evidence, fingerprint as FP, materials as M, summary as S
from ..operators.budget import admit_under_budget
from ..operators.matching import match_exact
from ..session import cut
from . import adapters as A
from .adapters import table
from .registry import query
from .rows import SQL_DESCRIPTOR

KEYS = ["candidate_hash", "format", "width", "height"]


@query("d1_dedupe_assets", f"""WITH {A.SQL_ASSETS}, first AS (
    SELECT *, count(*) OVER k AS copies, row_number() OVER (PARTITION BY candidate_hash, format, width, height ORDER BY doc_id) AS rn
    FROM assets WINDOW k AS (PARTITION BY candidate_hash, format, width, height)),
  alt AS (SELECT a.candidate_hash, a.format, a.width, a.height, count(DISTINCT a.source) AS alternates
    FROM assets a JOIN first f USING (candidate_hash, format, width, height) WHERE f.rn = 1 AND a.source <> f.source GROUP BY ALL)
  SELECT candidate_hash, format, width, height, doc_id, source, copies, coalesce(alternates, 0) AS alternates
  FROM first LEFT JOIN alt USING (candidate_hash, format, width, height) WHERE rn = 1""")
def dedupe_assets(spark, sf):
    a = cut(A.slim_assets(spark, sf).select(*KEYS, "doc_id", "source"))  # content is read here and not again
    kept = dedupe.dedupe_assets(a, KEYS, ["doc_id"])
    alternates = dedupe.merged_values(a, kept, KEYS, "source", exclude_kept=True).groupBy(*KEYS).agg(
        F.count("*").alias("alternates"))
    return kept.join(alternates, KEYS, "left").withColumn("alternates", F.coalesce("alternates", F.lit(0)))


@query("d1_alternate_sources", f"""WITH {A.SQL_ASSETS}, first AS (
    SELECT *, row_number() OVER (PARTITION BY candidate_hash, format, width, height ORDER BY doc_id) AS rn FROM assets)
  SELECT DISTINCT f.doc_id, a.source FROM assets a JOIN first f USING (candidate_hash, format, width, height)
  WHERE f.rn = 1 AND a.source <> f.source""")
def alternate_sources(spark, sf):
    a = cut(A.slim_assets(spark, sf).select(*KEYS, "doc_id", "source"))  # content is read here and not again
    kept = dedupe.dedupe_assets(a, KEYS, ["doc_id"])
    return dedupe.merged_values(a, kept, KEYS, "source", exclude_kept=True).join(
        kept.select(*KEYS, "doc_id"), KEYS).select("doc_id", "source")


@query("d1_dedupe_lines", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, copies FROM (
    SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS copies,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {A.SQL_LINE_ORDER}) AS rn FROM lineitem) WHERE rn = 1""")
def dedupe_lines(spark, sf):
    return dedupe.dedupe_assets(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"],
                                [c for c in A.LINE_ORDER if c != "l_linenumber"]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "copies")


SQL_HIST = """SELECT 'parser' AS section, parser_used AS key, count(*) AS n FROM {0} GROUP BY 2
    UNION ALL SELECT 'format', format::VARCHAR, count(*) FROM {0} GROUP BY 2
    UNION ALL SELECT 'dimensions', width || 'x' || height, count(*) FROM {0} GROUP BY 2
    UNION ALL SELECT 'category', category, count(*) FROM {0} GROUP BY 2"""


def sections():
    return {"parser": F.col("parser_used"), "format": F.col("format"),
            "dimensions": F.concat(F.col("width").cast("string"), F.lit("x"), F.col("height").cast("string")),
            "category": F.col("category")}


@query("d2_histogram", f"WITH {A.SQL_ASSETS} {SQL_HIST.format('assets')}")
def histogram(spark, sf):
    return S.histogram(A.assets(spark, sf), sections())


@query("d3_inventory_summary", f"""WITH {A.SQL_FILES}, slim AS (SELECT coalesce(ext, '(none)') AS ext,
      regexp_replace(substr(content, 1, 4), '[^ -~]', '.', 'g') AS magic, starts_with(content, '<!DO') AS doctype,
      contains(content, '***') AS starred, NOT starts_with(content, '<pre') AND contains(content, '<pre') AS embedded,
      ext = 'html' AS html FROM files)
  SELECT 'flags' AS section, unnest(['files', 'doctype', 'starred', 'embedded', 'html']) AS key,
    unnest([count(*), count(*) FILTER (doctype), count(*) FILTER (starred), count(*) FILTER (embedded), count(*) FILTER (html)]) AS n FROM slim
  UNION ALL SELECT 'extension', ext, count(*) FROM slim GROUP BY 2
  UNION ALL (SELECT 'magic', magic, count(*) FROM slim GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 50)""")
def inventory_summary(spark, sf):
    flags = {
        "doctype": C.starts_with("content", ["<!DO"], False), "starred": C.contains_token("content", "***", False),
        "embedded": ~C.starts_with("content", ["<pre"], False) & C.contains_token("content", "<pre", False),
        "html": F.coalesce(F.col("ext") == "html", F.lit(False))}
    return S.inventory_summary(A.files(spark, sf), flags, binary=False)


@query("d4_run_summary", """SELECT l_returnflag AS format, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS failed,
    CAST(sum(CASE WHEN l_linestatus = 'O' THEN CAST(l_quantity AS BIGINT) ELSE 0 END) AS BIGINT) AS names,
    CAST(max(CAST(l_quantity AS BIGINT)) AS BIGINT) AS widest FROM lineitem GROUP BY 1""")
def run_summary(spark, sf):
    q = F.col("l_quantity").cast("bigint")
    rows = table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "format")
    return S.run_summary(rows, ["format"], {
        "failed": F.count_if(F.col("l_linestatus") == "F"),
        "names": F.sum(F.when(F.col("l_linestatus") == "O", q).otherwise(0)), "widest": F.max(q)})


def sql_digest(source: str, widths=(6, 3)) -> str:
    """CTE chain ending in ``digest_root(value)``."""
    ctes = [f"dg0 AS (SELECT sha256(j || '|' || count(*)) AS digest FROM (SELECT {SQL_DESCRIPTOR} AS j FROM {source}) GROUP BY j)"]
    for i, w in enumerate(widths, 1):
        ctes.append(f"dg{i} AS (SELECT substr(digest, 1, {w}) || sha256(string_agg(digest, ',' ORDER BY digest)) AS digest "
                    f"FROM dg{i - 1} GROUP BY substr(digest, 1, {w}))")
    ctes.append(f"digest_root AS (SELECT sha256(string_agg(digest, ',' ORDER BY digest)) AS value FROM dg{len(widths)})")
    return ", ".join(ctes)


@query("d5_catalog_digest", f"WITH {A.SQL_ASSETS}, {sql_digest('assets')} SELECT value AS digest FROM digest_root")
def catalog_digest(spark, sf):
    a = A.assets(spark, sf)
    return FP.catalog_digest(a.select(FP.descriptor(a).alias("json")), "json")


SQL_UNIQUE = """uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY candidate_hash, format, width, height ORDER BY doc_id) AS rn
    FROM assets) WHERE rn = 1)"""


@query("d6_fingerprint", f"""WITH {A.SQL_ASSETS}, {SQL_UNIQUE}, {sql_digest('uniq')}
  SELECT 'scalar' AS section, unnest(['asset_count', 'candidate_hash_count', 'verified_runtime_hash_count', 'material_bound_assets']) AS key,
    unnest([count(*), count(*), CAST(sum(len(verified_hashes)) AS BIGINT), count(*) FILTER (material_binding_count > 0)])::VARCHAR AS value FROM uniq
  UNION ALL SELECT 'scalar', 'asset_descriptor_sha256', value FROM digest_root
  UNION ALL SELECT section, key, n::VARCHAR FROM ({SQL_HIST.format('uniq')})
  UNION ALL SELECT 'summary', unnest(['files', 'countable']), unnest([count(*), count(*) FILTER (ext = 'html')])::VARCHAR FROM (
    SELECT {A.sql_ext("regexp_replace(url, '^[a-z]+://', '')")} AS ext FROM pages)""")
def fingerprint(spark, sf):
    a = dedupe.dedupe_assets(A.assets(spark, sf), KEYS, ["doc_id"])
    files = A.files(spark, sf).agg(F.count("*").alias("files"), F.count_if(F.col("ext") == "html").alias("countable"))
    return FP.fingerprint(a, sections(), {"summary": files})


def rollup(spark, sf):
    slots = cut(A.slots(spark, sf))
    r = M.nest_slots(slots, ["material"], "slot", "asset").join(report(spark, sf, slots), "material")
    return r.select("material", "status", "alpha_rows", F.col("slot_count").cast("bigint").alias("slot_count"), F.array_join(F.transform(
        "slots", lambda s: F.concat(s["slot"].cast("string"), F.lit(":"), s["asset"].cast("string"))), ",").alias("slots"))


SQL_USES = f"""uses AS (SELECT DISTINCT st.material, stage, input, st.source_id - 3 AS slot, operand_id, format
    FROM stages st JOIN slots sl ON sl.material = st.material AND sl.slot = st.source_id - 3 WHERE source_id BETWEEN 3 AND 5),
  counted AS (SELECT material,
    count(*) FILTER (operand_id IN (0, 1) AND format NOT IN ({A.ALPHA_IDS})) AS constant_inputs,
    count(*) FILTER (NOT (operand_id IN (0, 1) AND format NOT IN ({A.ALPHA_IDS})) AND operand_id <= 7) AS explicit_channels
    FROM uses GROUP BY 1)"""


@query("d8_stage_use_counts", f"WITH {A.SQL_SLOTS}, {A.SQL_STAGES}, {SQL_USES} SELECT * FROM counted")
def stage_use_counts(spark, sf):
    return M.stage_use_counts(A.stages(spark, sf), A.slots(spark, sf), ["material"])


# System turns are stages without inputs: their material cannot be resolved.
SQL_RESOLVABLE = """inputs AS (SELECT * FROM stages WHERE source_id <> 0),
  resolved AS (SELECT st.material, bool_and(CASE
      WHEN i.source_id BETWEEN 3 AND 5 THEN sl.slot IS NOT NULL AND i.operand_id <= 7
      WHEN i.source_id = 15 THEN i.operand_id IN (0, 1) AND EXISTS (SELECT 1 FROM stages p WHERE p.material = st.material AND p.stage < st.stage)
      ELSE false END) AND coalesce(bool_or(i.source_id BETWEEN 3 AND 5), false) AS resolvable
    FROM stages st LEFT JOIN inputs i ON i.material = st.material AND i.stage = st.stage
    LEFT JOIN slots sl ON sl.material = st.material AND sl.slot = i.source_id - 3 GROUP BY 1)"""
SQL_REPORT = f"""{A.SQL_SLOTS}, {A.SQL_STAGES}, {SQL_USES}, {SQL_RESOLVABLE}, report AS (SELECT material,
    coalesce(constant_inputs + explicit_channels, 0) AS alpha_rows, CASE WHEN resolvable THEN 'resolved'
      WHEN coalesce(constant_inputs + explicit_channels, 0) > 0 THEN 'unresolved' ELSE 'no_texture_alpha' END AS status
    FROM (SELECT DISTINCT material FROM slots) LEFT JOIN resolved USING (material) LEFT JOIN counted USING (material))"""


def resolvable(spark, sf, slots=None, stages=None):
    slots, stages = slots or A.slots(spark, sf), stages or A.stages(spark, sf)
    return M.stage_resolvable(stages.filter("source_id <> 0"), ["material"], slots, stages)


def report(spark, sf, slots=None):
    """Materials with a bound slot and their status. Slots and stages are narrow tables that several branches read, made once."""
    slots, stages = slots or cut(A.slots(spark, sf)), cut(A.stages(spark, sf))
    uses = M.stage_use_counts(stages, slots, ["material"])
    return M.material_report(slots, resolvable(spark, sf, slots, stages), uses, ["material"])


@query("d7_material_rollup", f"""WITH {SQL_REPORT} SELECT material, status, alpha_rows, count(*) AS slot_count,
    string_agg(slot || ':' || asset, ',' ORDER BY slot) AS slots FROM slots JOIN report USING (material) GROUP BY 1, 2, 3""")
def material_rollup(spark, sf):
    return rollup(spark, sf)


@query("d9_stage_resolvable", f"WITH {A.SQL_SLOTS}, {A.SQL_STAGES}, {SQL_RESOLVABLE} SELECT * FROM resolved")
def stage_resolvable(spark, sf):
    return resolvable(spark, sf)


@query("d10_merge_evidence", f"""WITH {A.SQL_EVIDENCE} SELECT asset, hash, rank, method, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY asset, hash ORDER BY rank DESC, ts, event_id) AS rn FROM evidence) WHERE rn = 1""")
def merge_evidence(spark, sf):
    return evidence.merge_evidence(A.evidence(spark, sf), ["asset", "hash"], "rank", ["ts", "event_id"]).select(
        "asset", "hash", "rank", "method", "event_id")


@query("d11_status_rollup", f"""WITH {SQL_REPORT} SELECT count(*) FILTER (status = 'resolved') AS resolved,
    count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status = 'no_texture_alpha') AS no_texture_alpha FROM report""")
def status_rollup(spark, sf):
    return S.status_rollup(report(spark, sf), "status", ["resolved", "unresolved", "no_texture_alpha"])


@query("d12_archive_report", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {A.SQL_LINE_ORDER}) AS rn FROM lineitem)
  SELECT l_orderkey, count(*) AS members, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes,
    count(*) FILTER (l_returnflag = 'R') AS known_members,
    string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY rn) FILTER (rn <= 5) AS head FROM m GROUP BY 1""")
def archive_report(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("size", F.col("l_quantity").cast("bigint"))
    return S.archive_report(lines, "l_orderkey", A.LINE_ORDER, "size", F.col("l_returnflag") == "R",
                            ["l_linenumber", "l_partkey"], k=5)


@query("d13_coverage_totals", "SELECT count(*) AS payloads, " + ", ".join(
    f"count(*) FILTER (l_returnflag = '{k}' AND {e}) AS {k.lower()}_{n}" for k in "ANR" for n, e in [
        ("declared", "true"), ("parsed", "l_linestatus = 'F'"), ("unsupported", "l_linestatus = 'O' AND l_quantity > 40")])
    + " FROM lineitem")
def coverage_totals(spark, sf):
    group = {"declared": F.lit(True), "parsed": F.col("l_linestatus") == "F",
             "unsupported": (F.col("l_linestatus") == "O") & (F.col("l_quantity") > 40)}
    return S.coverage_totals(table(spark, sf, "lineitem"), "l_returnflag", {k: group for k in "ANR"})


SQL_MATCH = f"""{A.SQL_ASSETS}, keyed AS (SELECT a.*, sha256(text) AS direct, sha256(reverse(text)) AS mirrored, l.doc_id IS NOT NULL AS known
    FROM assets a JOIN documents d USING (doc_id) LEFT JOIN labels l USING (doc_id)),
  cat AS (SELECT doc_id, candidate_hash, unnest([direct, mirrored]) AS digest FROM keyed WHERE known),
  hits AS (SELECT k.doc_id, min(c.doc_id) AS asset, count(DISTINCT c.doc_id) AS n, min(c.candidate_hash) AS asset_hash
    FROM (SELECT doc_id, unnest([direct, mirrored]) AS digest FROM keyed WHERE NOT known) k JOIN cat c USING (digest) GROUP BY 1),
  matches AS (SELECT k.doc_id, CASE WHEN n = 1 THEN asset END AS asset,
    CASE WHEN n IS NULL THEN 'unmatched' WHEN n = 1 THEN 'verified' ELSE 'ambiguous' END AS status,
    k.candidate_hash, h.asset_hash, k.source
    FROM keyed k LEFT JOIN hits h USING (doc_id) WHERE NOT known)"""


def exact_matches(spark, sf):
    """Unlabelled documents against labelled ones."""
    known = table(spark, sf, "labels").select("doc_id", F.lit(True).alias("known"))
    d = cut(A.slim_assets(spark, sf).select(
        "doc_id", "candidate_hash", F.sha2("text", 256).alias("direct"), F.sha2(F.reverse("text"), 256).alias("mirrored"),
        "source").join(known, "doc_id", "left"))
    dump = d.filter(F.col("known").isNull())
    catalog = d.filter(F.col("known").isNotNull()).withColumnRenamed("doc_id", "asset")
    return catalog, match_exact(dump, catalog, "doc_id", "asset", ["direct", "mirrored"], carry=["candidate_hash"])


@query("d14_evidence_report", f"""WITH {SQL_MATCH} SELECT count(*) AS found, count(*) FILTER (status = 'verified') AS matched_exact,
    CAST(0 AS BIGINT) AS similar, count(*) FILTER (status = 'ambiguous') AS ambiguous, count(*) FILTER (status = 'unmatched') AS unmatched,
    count(*) FILTER (status = 'verified' AND candidate_hash = asset_hash) AS agreeing,
    count(*) FILTER (status = 'verified' AND candidate_hash <> asset_hash) AS disagreeing,
    CASE WHEN count(*) FILTER (status = 'verified' AND candidate_hash <> asset_hash) > 0 THEN 'FAIL'
      WHEN count(*) FILTER (status = 'verified') > 0 THEN 'PASS' ELSE 'NO_EXACT_SAMPLES' END AS verdict FROM matches""")
def evidence_report(spark, sf):
    catalog, m = exact_matches(spark, sf)
    own = catalog.select("asset", F.col("candidate_hash").alias("asset_hash"))
    return S.evidence_report(m.join(own, "asset", "left").withColumn(
        "agrees", F.col("candidate_hash") == F.col("asset_hash")))


@query("d15_bindings_by_name", """WITH b AS (SELECT p_name AS name, l_orderkey AS material, l_linenumber AS slot FROM lineitem JOIN part ON p_partkey = l_partkey),
    u AS (SELECT l_orderkey AS material, l_linenumber AS slot, count(*) AS uses FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
    s AS (SELECT l_orderkey AS material, count(DISTINCT l_suppkey) AS stages FROM lineitem GROUP BY 1)
  SELECT DISTINCT name, material, slot, coalesce(uses, 0) AS uses, coalesce(stages, 0) AS stages
  FROM b LEFT JOIN u USING (material, slot) LEFT JOIN s USING (material)""")
def bindings_by_name(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("material"), F.col("l_linenumber").alias("slot"), "l_partkey", "l_returnflag",
        F.col("l_suppkey").alias("stage"))
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name"))
    return M.bindings_by_name(lines.join(part, "l_partkey"), lines.filter(F.col("l_returnflag") != "N"), lines,
                              ["material"], "name", "slot")


@query("d16_usage_snapshot", None)
def usage_snapshot(spark, sf):
    decided = admit_under_budget(A.archives(spark, sf), A.BUDGET, ["o_orderkey"], ["o_custkey"], "archive_size")
    return S.usage_snapshot(decided, A.BUDGET, ["o_custkey"])


@query("e12_diff_fingerprints", f"""WITH {A.SQL_ASSETS},
    a AS (SELECT section, key, n FROM ({SQL_HIST.format("(SELECT * FROM assets WHERE source < 'src15')")})),
    b AS (SELECT section, key, n FROM ({SQL_HIST.format("(SELECT * FROM assets WHERE source >= 'src15')")}))
  SELECT section, key, a.n::VARCHAR AS expected, b.n::VARCHAR AS actual FROM a FULL JOIN b USING (section, key)
  WHERE a.n IS DISTINCT FROM b.n""")
def diff_fingerprints(spark, sf):
    a = A.assets(spark, sf)
    one = FP.fingerprint(a.filter(F.col("source") < "src15"), sections())
    two = FP.fingerprint(a.filter(F.col("source") >= "src15"), sections())
    return FP.diff_fingerprints(one, two, ["parser", "format", "dimensions", "category"])
