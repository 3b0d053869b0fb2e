"""Queries for ordered operators and expansion (2.F, 2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N, paths as P, values as V
from ..operators import dedupe, expand as X, naming
from ..operators.budget import admit_under_budget, capped_sample
from ..operators.lookup import nesting_depth
from . import adapters as A
from .adapters import table
from .registry import ORACLES, query


@query("f1_assign_unique_names", f"""WITH a AS (SELECT p_partkey, {A.sql_slug('p_name')} AS base, upper(substr(sha256(p_partkey::VARCHAR), 1, 16)) AS owner FROM part),
    k AS (SELECT base, min(owner) AS keeper FROM a GROUP BY 1),
    n AS (SELECT a.*, keeper, row_number() OVER (PARTITION BY base, lower(substr(owner, 1, 8)), owner <> keeper ORDER BY owner) AS rn FROM a JOIN k USING (base))
  SELECT p_partkey, base, CASE WHEN owner = keeper THEN base WHEN rn = 1 THEN base || '-' || lower(substr(owner, 1, 8))
    ELSE base || '-' || lower(substr(owner, 1, 8)) || '-' || rn END AS name FROM n""")
def assign_unique_names(spark, sf):
    a = table(spark, sf, "part").select(
        "p_partkey", N.slug("p_name").alias("base"),
        F.upper(F.substring(F.sha2(F.col("p_partkey").cast("string"), 256), 1, 16)).alias("owner"))
    return naming.assign_unique_names(a, "base", "owner").select("p_partkey", "base", "name")


@query("f2_dedupe_names_within", f"""WITH m AS (SELECT l.*, p_name || '.stex' AS name, replace(p_name, ' ', '_') AS stem FROM lineitem l JOIN part ON p_partkey = l_partkey),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, name ORDER BY {A.SQL_LINE_ORDER}) AS rn FROM m)
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, name,
    CASE WHEN rn = 1 THEN name ELSE regexp_replace(name, '\\.stex$', '') || '_' || rn || '.stex' END AS unique_name FROM r""")
def dedupe_names_within(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat("p_name", F.lit(".stex")).alias("name"))
    m = table(spark, sf, "lineitem").join(part, "l_partkey")
    return naming.dedupe_names_within(m, "l_orderkey", "name", A.LINE_ORDER).select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "name", "unique_name")


@query("f3_pick_slot", f"WITH {A.SQL_SLOTS} SELECT material, slot, asset FROM slots")
def pick_slot(spark, sf):
    return A.slots(spark, sf).drop("format")


@query("f4_last_write_wins", f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {A.SQL_LINE_ORDER}) AS up,
      row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(c + ' DESC' for c in A.LINE_ORDER)}) AS down FROM lineitem)
  SELECT l_orderkey, l_linenumber, max(l_partkey) FILTER (up = 1) AS first_partkey, max(l_suppkey) FILTER (down = 1) AS last_suppkey,
    count(*) AS writes FROM m GROUP BY 1, 2""")
def last_write_wins(spark, sf):
    order = [c for c in A.LINE_ORDER if c != "l_linenumber"]
    lines = table(spark, sf, "lineitem").withColumn("payload", F.col("l_suppkey"))
    return dedupe.last_write_wins(lines, ["l_orderkey", "l_linenumber"], order, ["payload"]).select(
        "l_orderkey", "l_linenumber", F.col("first_l_partkey").alias("first_partkey"),
        F.col("payload").alias("last_suppkey"), "writes")


@query("f5_segment_layout", """SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS size,
    CAST(sum(length(text)) OVER w - length(text) AS BIGINT) AS "offset", CAST(sum(length(text)) OVER w AS BIGINT) AS "end"
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)""")
def segment_layout(spark, sf):
    levels = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("size"))
    return dedupe.segment_layout(levels, ["conv_id"], ["turn"], "size")


SQL_PAGES = """SELECT doc_id, lang, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 25 + 1 AS page,
    (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) % 25 AS cell FROM documents"""


@query("f6_paginate", SQL_PAGES)
def paginate(spark, sf):
    return dedupe.paginate(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], V.PAGE_SIZE)


@query("f6_paginate_spread", SQL_PAGES)
def paginate_spread(spark, sf):
    """The same on the path for groups too large for one task."""
    return dedupe.paginate(table(spark, sf, "documents").select("doc_id", "lang"), ["lang"], ["doc_id"], V.PAGE_SIZE,
                           hot_rows=1)


@query("f7_capped_sample", """WITH RECURSIVE c AS (SELECT *, row_number() OVER (ORDER BY rule, doc_id) AS n FROM (
      SELECT CASE lang WHEN 'fr' THEN 0 WHEN 'de' THEN 1 ELSE 2 END AS rule, doc_id, source, n_chars FROM documents)),
    walk AS (SELECT CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS used, CAST([] AS VARCHAR[]) AS seen, CAST(0 AS BIGINT) AS first_rule,
        CAST(NULL AS BIGINT) AS pick
      UNION ALL SELECT n, CASE WHEN ok THEN used + n_chars ELSE used END, CASE WHEN ok THEN list_append(seen, source) ELSE seen END,
        CASE WHEN ok AND rule = 0 THEN first_rule + 1 ELSE first_rule END, CASE WHEN ok THEN len(seen) + 1 END
      FROM (SELECT w.used, w.seen, w.first_rule, c.n, c.rule, c.source, c.n_chars, len(seen) < 6 AND c.n_chars > 0 AND used + c.n_chars <= 4000
          AND NOT list_contains(seen, c.source) AND NOT (c.rule = 0 AND first_rule >= 3) AS ok FROM walk w JOIN c ON c.n = w.rn + 1))
  SELECT w.pick, c.rule, c.doc_id, c.source, c.n_chars FROM walk w JOIN c ON c.n = w.rn WHERE pick IS NOT NULL""")
def sample(spark, sf):
    d = table(spark, sf, "documents").select(
        F.when(F.col("lang") == "fr", 0).when(F.col("lang") == "de", 1).otherwise(2).alias("rule"), "doc_id", "source", "n_chars")
    return capped_sample(d, "rule", ["doc_id"], "source", "n_chars", max_rows=6, max_bytes=4000,
                         quotas={0: V.SAMPLE_FIRST_RULE_QUOTA})


B = A.BUDGET
SQL_ADMIT = f"""{A.SQL_ARCHIVES}, judged AS (SELECT *, CASE WHEN smallest < 0 THEN 'negative_size' WHEN archive_size > {B['max_archive_bytes']} THEN 'archive_bytes'
      WHEN depth > {B['max_depth']} THEN 'depth' WHEN largest > {B['max_member_bytes']} THEN 'member_bytes' WHEN members > {B['max_members']} THEN 'members'
      WHEN bytes > {B['max_expanded_bytes']} THEN 'expanded_bytes' END AS standing FROM archives),
  seq AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM judged WHERE standing IS NULL),
  walk AS (SELECT o_custkey, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS m, CAST(0 AS BIGINT) AS b, CAST(NULL AS VARCHAR) AS reason FROM (SELECT DISTINCT o_custkey FROM seq)
    UNION ALL SELECT w.o_custkey, s.rn, CASE WHEN m + members <= {B['max_members']} AND b + bytes <= {B['max_expanded_bytes']} THEN m + members ELSE m END,
      CASE WHEN m + members <= {B['max_members']} AND b + bytes <= {B['max_expanded_bytes']} THEN b + bytes ELSE b END,
      CASE WHEN m + members > {B['max_members']} THEN 'members' WHEN b + bytes > {B['max_expanded_bytes']} THEN 'expanded_bytes' END
    FROM walk w JOIN seq s ON s.o_custkey = w.o_custkey AND s.rn = w.rn + 1),
  decided AS (SELECT j.*, CASE WHEN j.standing IS NOT NULL THEN j.standing ELSE w.reason END AS reason,
      j.standing IS NULL AND w.reason IS NULL AS admitted
    FROM judged j LEFT JOIN seq s USING (o_orderkey) LEFT JOIN walk w ON w.o_custkey = s.o_custkey AND w.rn = s.rn)"""
SQL_ADMITTED = f"WITH RECURSIVE {SQL_ADMIT} SELECT o_orderkey, admitted, reason FROM decided"


@query("f8_admit_under_budget", SQL_ADMITTED)
def admit(spark, sf):
    return admit_under_budget(A.archives(spark, sf), B, ["o_orderkey"], ["o_custkey"], "archive_size").select(
        "o_orderkey", "admitted", "reason")


@query("f8_admit_in_chunks", SQL_ADMITTED)
def admit_in_chunks(spark, sf):
    """The same on the path for scopes too large for one task."""
    return admit_under_budget(A.archives(spark, sf), B, ["o_orderkey"], ["o_custkey"], "archive_size", fold_rows=8,
                              chunk_rows=12).select("o_orderkey", "admitted", "reason")


ORACLES["d16_usage_snapshot"] = f"""WITH RECURSIVE {SQL_ADMIT} SELECT o_custkey, count(*) FILTER (admitted) AS archives,
    CAST(coalesce(sum(members) FILTER (admitted), 0) AS BIGINT) AS members_used, CAST(coalesce(sum(bytes) FILTER (admitted), 0) AS BIGINT) AS bytes_used,
    coalesce(max(depth) FILTER (admitted), 0) AS max_depth_seen, CAST({B['max_members']} AS BIGINT) AS max_members,
    CAST({B['max_expanded_bytes']} AS BIGINT) AS max_expanded_bytes FROM decided GROUP BY 1"""


@query("f9_top_k", "SELECT substr(text, 1, 4) AS magic, count(*) AS n FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_k(spark, sf):
    d = table(spark, sf, "documents").select(F.substring("text", 1, 4).alias("magic"))
    return dedupe.most_common(d, "magic", V.MAGIC_TOP)


@query("f10_nesting_depth", f"""WITH {A.SQL_FILES}, roots AS (SELECT DISTINCT split_part(path, '/', 1) AS root, 1 AS depth FROM files WHERE ext = 'html'
      UNION ALL SELECT DISTINCT split_part(path, '/', 1) || '/en', 2 FROM files)
  SELECT path, coalesce(max(depth), 0) + 1 AS depth FROM files LEFT JOIN roots ON starts_with(path, root || '/') GROUP BY 1""")
def depth(spark, sf):
    files = A.files(spark, sf)
    host = F.substring_index("path", "/", 1)
    roots = files.filter("ext = 'html'").select(host.alias("root"), F.lit(1).alias("depth")).unionByName(
        files.select(F.concat(host, F.lit("/en")).alias("root"), F.lit(2).alias("depth"))).distinct()
    return nesting_depth(files.select("path"), roots)


@query("f11_ordered_output", f"WITH {A.SQL_ASSETS} SELECT candidate_hash, width, height, format, doc_id FROM assets ORDER BY ALL")
def ordered_output(spark, sf):
    a = A.slim_assets(spark, sf).select("candidate_hash", "width", "height", "format", "doc_id")
    return dedupe.ordered_output(a, a.columns)


def _stage(n: int, kind: str, base: str) -> str:
    return f"""s{n} AS (SELECT * FROM {base} UNION ALL SELECT m.child, m.kind, s.depth + 1, {n} FROM s{n} s JOIN members m ON m.parent = s.path
      WHERE s.kind = '{kind}')"""


SQL_STAGED = f"""{A.SQL_MEMBERS}, s0 AS (SELECT path, kind, 0 AS depth, 0 AS stage FROM roots),
  {_stage(1, 'A', 's0')}, {_stage(2, 'B', 's1')}, {_stage(3, 'C', 's2')}"""
SQL_FULL = """full_set AS (SELECT path, kind, 0 AS depth, 0 AS stage FROM roots UNION ALL
    SELECT m.child, m.kind, f.depth + 1, 1 FROM full_set f JOIN members m ON m.parent = f.path WHERE f.kind IS NOT NULL)"""


@query("h1_expand_staged", f"WITH RECURSIVE {SQL_STAGED} SELECT path, kind, depth, stage FROM s3")
def expand_staged(spark, sf):
    return X.expand_staged(*A.hierarchy(spark, sf), [["A"], ["B"], ["C"]])


@query("h2_expand_fixed_point", f"WITH RECURSIVE {A.SQL_MEMBERS}, {SQL_FULL} SELECT path, kind, depth, stage FROM full_set")
def expand_fixed_point(spark, sf):
    return X.expand_fixed_point(*A.hierarchy(spark, sf))


@query("h2_staged_gap", f"""WITH RECURSIVE {SQL_STAGED}, {SQL_FULL} SELECT path, kind, depth FROM full_set
  WHERE path NOT IN (SELECT path FROM s3)""")
def staged_gap(spark, sf):
    roots, members = A.hierarchy(spark, sf)
    store = X.store_members(members, roots)  # one for both
    return X.staged_gap(X.expand_fixed_point(roots, members, store=store),
                        X.expand_staged(roots, members, [["A"], ["B"], ["C"]], store=store)).select("path", "kind", "depth")


EXPANSION = {"max_depth": 16, "max_members": 6_000, "max_expanded_bytes": 150_000, "max_member_bytes": 1_000,
             "max_archive_bytes": 1 << 40}


@query("h1_expand_under_budget")
def expand_under_budget(spark, sf):
    """No SQL twin: the charge runs through all rounds in order. Tested against a sequential model."""
    roots, members = A.hierarchy(spark, sf)
    sized = members.withColumn("size", F.length("child").cast("bigint") * 4)
    files, refused, _ = X.expand_under_budget(roots, sized, [["A"], ["B"], ["C"]], EXPANSION)
    return files.join(refused.select("path", "reason"), "path", "left")
