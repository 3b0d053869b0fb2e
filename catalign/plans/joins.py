"""Queries for joins and set operations (2.E, 2.G)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as C, hashes as H, paths as P, values as V
from ..operators import dedupe, filters as B, lookup as L
from ..operators.matching import match_nearest
from ..session import cut
from . import adapters as A
from .adapters import table
from .counts import SQL_MATCH, exact_matches
from .registry import query


@query("e1_pair_files", """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN upper(p) ELSE p END AS path,
      lower(p) AS key, ext FROM (SELECT *, 'data/c' || o_custkey || '.' || ext AS p FROM (SELECT *,
      CASE o_orderstatus WHEN 'O' THEN 'hpi' WHEN 'F' THEN 'hpb' ELSE 'bin' END AS ext FROM orders))),
    s AS (SELECT regexp_replace(key, '\\.[^.]*$', '.') AS pair_key, ext, arg_min(path, o_orderkey) AS path FROM f GROUP BY 1, 2)
  SELECT i.pair_key, i.path AS index_path, d.path AS data_path FROM s i LEFT JOIN s d ON d.pair_key = i.pair_key AND d.ext = 'hpb'
  WHERE i.ext = 'hpi'""")
def pair_files(spark, sf):
    ext = F.when(F.col("o_orderstatus") == "O", "hpi").when(F.col("o_orderstatus") == "F", "hpb").otherwise("bin")
    path = F.concat(F.lit("data/c"), F.col("o_custkey").cast("string"), F.lit("."), ext)
    files = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", F.upper(path)).otherwise(path).alias("path"))
    return L.pair_files(files, "hpi", "hpb", "path", ["o_orderkey"])


SQL_NAMES = """catalog AS (SELECT p_name AS name, 'p' || p_partkey AS asset FROM part UNION ALL SELECT n_name, 'n' || n_nationkey FROM nation),
  refs AS (SELECT p_partkey AS ref, unnest([p_name, p_type, 'NATION_' || (p_size % 30)]) AS name FROM part),
  idx AS (SELECT name, min(asset) AS lo, count(DISTINCT asset) AS n FROM catalog GROUP BY 1)"""


def name_refs(spark, sf):
    part = table(spark, sf, "part")
    catalog = part.select(F.col("p_name").alias("name"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("asset")).unionByName(
        table(spark, sf, "nation").select(F.col("n_name").alias("name"),
                                          F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("asset")))
    refs = part.select(F.col("p_partkey").alias("ref"), "p_brand", F.explode(F.array(
        "p_name", "p_type", F.concat(F.lit("NATION_"), (F.col("p_size") % 30).cast("string")))).alias("name"))
    return refs, catalog


@query("e2_bind_by_unique_name", f"""WITH {SQL_NAMES} SELECT ref, name, CASE WHEN n IS NULL THEN 'missing' WHEN n = 1 THEN 'resolved'
    ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN lo END AS bound_asset FROM refs LEFT JOIN idx USING (name)""")
def bind_by_unique_name(spark, sf):
    refs, catalog = name_refs(spark, sf)
    return L.bind_by_unique_name(refs.drop("p_brand"), catalog, "name", "asset")


@query("e2_ambiguous_candidates", f"""WITH {SQL_NAMES} SELECT DISTINCT name, asset FROM catalog
  WHERE name IN (SELECT name FROM idx WHERE n > 1) AND name IN (SELECT name FROM refs)""")
def ambiguous_candidates(spark, sf):
    refs, catalog = name_refs(spark, sf)
    return L.ambiguous_candidates(refs, catalog, "name", "asset")


SQL_HANDED = f"""{SQL_NAMES},
  held AS (SELECT DISTINCT 'n' || s_nationkey AS asset, p_brand || '|' || p_type AS identity, s_suppkey AS ref
    FROM supplier JOIN part ON p_partkey = s_suppkey),
  brought AS (SELECT lo AS asset, p_brand || '|' || p_type AS identity, ref FROM refs JOIN idx USING (name) JOIN part ON p_partkey = ref
    WHERE n = 1),
  handed AS (SELECT asset, identity, arg_min(ref, (added, ref)) AS ref, bool_and(added) AS added FROM (
    SELECT *, false AS added FROM held UNION ALL SELECT *, true FROM brought) GROUP BY 1, 2)"""


def handed_over(spark, sf):
    """References of parts bring what brand and type bind to nations, which hold the bindings of their own suppliers' parts."""
    refs, catalog = name_refs(spark, sf)
    bound = table(spark, sf, "part").select(F.col("p_partkey").alias("ref"), F.concat_ws("|", "p_brand", "p_type").alias("identity"))
    held = table(spark, sf, "supplier").join(bound, F.col("s_suppkey") == F.col("ref")).select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("asset"), "identity", "ref")
    return L.hand_over_bindings(refs.join(bound, "ref"), catalog, held, "name", "asset", "identity", ["ref"])


@query("e2_hand_over_bindings", f"WITH {SQL_HANDED} SELECT asset, identity, ref, added FROM handed")
def hand_over_bindings(spark, sf):
    return handed_over(spark, sf)


@query("e2_count_handed_over", f"""WITH {SQL_HANDED} SELECT asset, count(*) AS bindings, count(*) FILTER (added) AS added
  FROM handed GROUP BY 1""")
def count_handed_over(spark, sf):
    return L.count_handed_over(handed_over(spark, sf), "asset")


@query("e3_match_exact", f"WITH {SQL_MATCH} SELECT doc_id, asset, status FROM matches")
def match_exact(spark, sf):
    return exact_matches(spark, sf)[1].drop("candidate_hash")


SQL_NEAREST = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    scored AS (SELECT a.vec_id, b.vec_id AS neighbour, least(
        list_sum(list_transform(list_zip(a.e, b.e), lambda p: abs(p[1] - p[2]))) / len(a.e),
        list_sum(list_transform(list_zip(list_reverse(a.e), b.e), lambda p: abs(p[1] - p[2]))) / len(a.e)) AS score
      FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score, neighbour) AS rn FROM scored),
    two AS (SELECT vec_id, max(neighbour) FILTER (rn = 1) AS neighbour, max(score) FILTER (rn = 1) AS score,
      coalesce(max(score) FILTER (rn = 2), 1.0) AS second FROM ranked WHERE rn <= 2 GROUP BY 1)"""


@query("e4_match_nearest", f"""WITH {SQL_NEAREST}
  SELECT vec_id, neighbour, round(score, 6) AS score, round(second, 6) AS runner_up_score,
    coalesce(score <= 0.115 AND (second - score >= 0.001 OR second >= 0.2), false) AS accepted FROM v LEFT JOIN two USING (vec_id)""")
def nearest(spark, sf):
    """Every vector against all the others of its label."""
    e = table(spark, sf, "embeddings")
    m = match_nearest(e, e.withColumnRenamed("vec_id", "neighbour"), "vec_id", "neighbour", "embedding", "label",
                      best_max=0.115, gap_min=0.001, second_ok=0.2, exclude_same=True)
    return m.withColumns({c: F.round(c, 6) for c in ("score", "runner_up_score")})


@query("e5_lookup_profile", """WITH prof AS (SELECT n_name AS profile, CASE WHEN n_regionkey < 2 THEN 'Brand#' || n_nationkey END AS exact_id,
      CASE n_regionkey WHEN 2 THEN 'ECON' WHEN 3 THEN 'SMALL' WHEN 4 THEN 'LAR' END AS family, n_nationkey AS priority FROM nation),
    fam AS (SELECT p_type, arg_min(profile, priority) AS profile FROM (SELECT DISTINCT p_type FROM part) t JOIN prof ON contains(p_type, family) GROUP BY 1)
  SELECT p_partkey, coalesce(e.profile, f.profile) AS profile, CASE WHEN e.profile IS NOT NULL THEN 'exact' WHEN f.profile IS NOT NULL THEN 'family'
    ELSE 'unsupported' END AS profile_status
  FROM part LEFT JOIN prof e ON e.exact_id = p_brand LEFT JOIN fam f USING (p_type)""")
def lookup_profile(spark, sf):
    region = F.col("n_regionkey")
    profiles = table(spark, sf, "nation").select(
        F.col("n_name").alias("profile"),
        F.when(region < 2, F.concat(F.lit("Brand#"), F.col("n_nationkey").cast("string"))).alias("exact_id"),
        F.when(region == 2, "ECON").when(region == 3, "SMALL").when(region == 4, "LAR").alias("family"),
        F.col("n_nationkey").alias("priority"))
    return L.lookup_profile(table(spark, sf, "part"), profiles, "p_brand", "p_type").select(
        "p_partkey", "profile", "profile_status")


@query("e6_resolve_precedence", """WITH alias AS (SELECT n_name AS alias, 'nation ' || n_nationkey AS target FROM nation WHERE n_nationkey < 12
      UNION ALL SELECT c_name, 'self ' || c_custkey FROM customer WHERE c_acctbal < 0
      UNION ALL SELECT c_mktsegment, 'segment ' || c_mktsegment FROM (SELECT DISTINCT c_mktsegment FROM customer) WHERE c_mktsegment < 'H'),
    probes AS (SELECT c_custkey, unnest([0, 1, 2]) AS priority, unnest([c_name, 'NATION_' || c_nationkey, c_mktsegment]) AS alias FROM customer)
  SELECT c_custkey, arg_min(target, priority) AS target, min(priority) AS priority FROM probes JOIN alias USING (alias) GROUP BY 1""")
def resolve_precedence(spark, sf):
    c = table(spark, sf, "customer")
    aliases = table(spark, sf, "nation").filter("n_nationkey < 12").select(
        F.col("n_name").alias("alias"), F.concat(F.lit("nation "), F.col("n_nationkey").cast("string")).alias("target")
    ).unionByName(c.filter("c_acctbal < 0").select(
        F.col("c_name").alias("alias"), F.concat(F.lit("self "), F.col("c_custkey").cast("string")).alias("target"))
    ).unionByName(c.filter("c_mktsegment < 'H'").select(F.col("c_mktsegment").alias("alias")).distinct().withColumn(
        "target", F.concat(F.lit("segment "), "alias")))
    nation = F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))
    return L.resolve_precedence(c, aliases, "c_custkey", [F.col("c_name"), nation, F.col("c_mktsegment")])


SQL_MAPPING = f"""{A.SQL_FILES}, mapping AS (SELECT upper(substr(md5(split_part(path, '/', 1)), 1, 16)) AS hash,
      CASE WHEN ext = 'html' THEN path ELSE {A.sql_leaf('path')} END AS name FROM files),
    leafs AS (SELECT {A.sql_leaf('path')} AS name, min(path) AS path, count(DISTINCT path) AS n FROM files GROUP BY 1),
    hits AS (SELECT hash, coalesce(f.path, CASE WHEN l.n = 1 THEN l.path END) AS file FROM mapping m
      LEFT JOIN (SELECT DISTINCT path FROM files) f ON f.path = m.name LEFT JOIN leafs l ON l.name = {A.sql_leaf('m.name')}),
    resolved AS (SELECT hash, CASE WHEN count(DISTINCT file) = 1 THEN min(file) END AS file,
      least(count(DISTINCT file), 2)::INTEGER AS n_files FROM hits GROUP BY 1)"""


def mapping_tables(spark, sf):
    files = A.files(spark, sf)
    mapping = files.select(
        F.upper(F.substring(F.md5(F.substring_index("path", "/", 1)), 1, 16)).alias("hash"),
        F.when(F.col("ext") == "html", F.col("path")).otherwise(P.leaf("path")).alias("name"))
    return mapping, files.select("path")


@query("e7_resolve_mapping", f"WITH {SQL_MAPPING} SELECT hash, file, n_files FROM resolved")
def resolve_mapping(spark, sf):
    mapping, files = mapping_tables(spark, sf)
    return L.resolve_mapping(mapping, files)


@query("e8_rehydrate", """WITH b AS (SELECT l_orderkey AS o_orderkey, l_suppkey AS owner, l_partkey FROM lineitem WHERE l_linestatus = 'O' AND l_quantity > 25),
    m AS (SELECT o_orderkey, min(owner) AS owner FROM b GROUP BY 1),
    f AS (SELECT l_partkey, min(owner) AS owner FROM b GROUP BY 1 HAVING count(DISTINCT owner) = 1)
  SELECT o.o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE coalesce(m.owner, f.owner) END AS owner,
    CASE WHEN o_orderstatus = 'F' THEN 'kept' WHEN m.owner IS NOT NULL THEN 'key' WHEN f.owner IS NOT NULL THEN 'fallback' ELSE 'missing' END AS origin
  FROM orders o LEFT JOIN m USING (o_orderkey) LEFT JOIN f ON f.l_partkey = o.o_custkey""")
def rehydrate(spark, sf):
    assets = table(spark, sf, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("owner"), "o_custkey")
    bindings = table(spark, sf, "lineitem").filter((F.col("l_linestatus") == "O") & (F.col("l_quantity") > 25)).select(
        F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("owner"), "l_partkey")
    return L.rehydrate(assets, bindings, ["o_orderkey"], "owner", ("_k", F.col("o_custkey"), F.col("l_partkey"))).drop(
        "o_custkey")


@query("e9_bind_slots", f"""WITH {A.SQL_BINDINGS}, owner AS (SELECT p_name || '|' || p_brand AS key, min(p_partkey) AS asset FROM part WHERE p_size < 30 GROUP BY 1)
  SELECT l_orderkey, slot, asset, count(*) AS n FROM bindings b JOIN part p ON p.p_partkey = b.l_partkey
  JOIN owner o ON o.key = p_name || '|' || p_brand WHERE slot IN (0, 1, 2) GROUP BY ALL""")
def bind_slots(spark, sf):
    part = table(spark, sf, "part").withColumn("key", H.binding_key("p_name", "p_brand"))
    slots = A.bindings(spark, sf).filter(F.col("slot").isin(V.MATERIAL_SLOTS)).join(
        part.select(F.col("p_partkey").alias("l_partkey"), "key"), "l_partkey")
    owners = part.filter("p_size < 30").select("key", F.col("p_partkey").alias("asset"))
    return L.bind_slots(slots, owners, "key", "asset", ["asset"]).groupBy("l_orderkey", "slot", "asset").agg(
        F.count("*").alias("n"))


@query("e10_reconcile_refs", f"""WITH {SQL_NAMES}, bad AS (SELECT DISTINCT p_brand, CASE WHEN n IS NULL THEN 'missing' ELSE 'ambiguous' END AS status, name
      FROM (SELECT ref, name, n FROM refs LEFT JOIN idx USING (name) WHERE n IS NULL OR n > 1) JOIN part ON p_partkey = ref),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand, status ORDER BY name) AS rn, count(*) OVER (PARTITION BY p_brand, status) AS total FROM bad)
  SELECT p_brand, status, total, total || ' name reference(s) ' || CASE status WHEN 'missing' THEN 'were not decoded anywhere in the scan'
      ELSE 'matched several assets and could not be bound' END || ': ' || string_agg(name, ', ' ORDER BY name) FILTER (rn <= 20) ||
    CASE WHEN total > 20 THEN ', ... (+' || (total - 20) || ' more)' ELSE '' END AS message FROM ranked GROUP BY p_brand, status, total""")
def reconcile_refs(spark, sf):
    refs, catalog = name_refs(spark, sf)
    return L.reconcile_refs(refs, catalog, "p_brand", "name", "asset", V.REFERENCE_DISPLAY_LIMIT)


SQL_COUNTS = """a AS (SELECT o_orderkey AS k, CAST(count(*) AS BIGINT) AS audit FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    p AS (SELECT l_orderkey AS k, CAST(count(DISTINCT l_linenumber) AS BIGINT) AS production FROM lineitem WHERE l_quantity > 5 GROUP BY 1),
    both_sides AS (SELECT k, coalesce(audit, 0) AS audit, coalesce(production, 0) AS production FROM a FULL JOIN p USING (k))"""


def count_tables(spark, sf):
    lines = table(spark, sf, "lineitem")
    audit = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")).join(
        lines.groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n")), "k")
    production = lines.filter("l_quantity > 5").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.count_distinct("l_linenumber").alias("n"))
    return audit, production


@query("e11_reconcile_counts", f"""WITH {SQL_COUNTS} SELECT k, audit, production,
    CASE WHEN audit > production THEN 'missed' WHEN audit < production THEN 'extra' ELSE 'equal' END AS state FROM both_sides""")
def reconcile_counts(spark, sf):
    audit, production = count_tables(spark, sf)
    return L.reconcile_counts(audit, production, ["k"], "n")


@query("e13_lookup_two_keys", """WITH s1 AS (SELECT s_nationkey, arg_min(s_name, s_suppkey) AS supplier FROM supplier WHERE s_acctbal > 5000 GROUP BY 1),
    s2 AS (SELECT right(s_name, 9) AS code, arg_min(s_name, s_suppkey) AS supplier FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
  SELECT c_custkey, coalesce(s2.supplier, s1.supplier) AS supplier,
    CASE WHEN s2.supplier IS NOT NULL THEN 'first' WHEN s1.supplier IS NOT NULL THEN 'second' END AS matched_by
  FROM customer LEFT JOIN s2 ON s2.code = right(c_name, 9) LEFT JOIN s1 ON s1.s_nationkey = c_nationkey""")
def lookup_two_keys(spark, sf):
    s = table(spark, sf, "supplier").filter("s_acctbal > 5000").select(
        F.expr("right(s_name, 9)").alias("code"), "s_nationkey", F.col("s_name").alias("supplier"), "s_suppkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.expr("right(c_name, 9)").alias("code"))
    return L.lookup_two_keys(c, s, ("code", "code"), ("c_nationkey", "s_nationkey"), "supplier", ["s_suppkey"]).select(
        "c_custkey", "supplier", "matched_by")


@query("e14_changed_rows", """SELECT doc_id FROM documents WHERE lang = 'fr' OR source = 'src3' OR source = 'src4'""")
def changed_rows(spark, sf):
    base = table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.sha2("text", 256).alias("digest"), F.col("n_chars").alias("size"))
    now = base.select(
        "doc_id",
        F.when(F.col("lang") == "fr", F.reverse("digest")).when(F.col("source") == "src4", F.lit(None)).otherwise(F.col("digest")).alias("digest"),
        F.when(F.col("source") == "src3", F.col("size") + 1).otherwise(F.col("size")).alias("size"))
    return L.changed_rows(base, now, "doc_id", "digest", "size")


@query("e15_selector_gap", f"""WITH {A.SQL_FILES} SELECT path FROM files WHERE (coalesce(ext, '') = 'html' OR contains(content, '***') OR contains(content, '###'))
  AND NOT coalesce(ext = 'html', false)""")
def selector_gap(spark, sf):
    narrow = C.candidate("ext", "content", ["html"], ["<htm"], None, False)
    broad = C.candidate("ext", "content", ["html"], ["<htm"], "***", False) | C.contains_token("content", "###", False)
    return B.selector_gap(A.files(spark, sf), narrow, broad).select("path")


@query("g1_missing_names", """SELECT DISTINCT o_custkey AS payload, l_partkey AS name FROM orders JOIN lineitem ON l_orderkey = o_orderkey
  WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 40)""")
def missing_names(spark, sf):
    refs = table(spark, sf, "orders").join(
        table(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("payload"), F.col("l_partkey").alias("name"))
    decoded = table(spark, sf, "part").filter("p_size <= 40").select(F.col("p_partkey").alias("name"))
    return dedupe.missing_names(refs, decoded, ["payload", "name"], on=["name"])


@query("g2_union_roots", f"""WITH {A.SQL_FILES} SELECT path, length FROM (SELECT *, row_number() OVER (PARTITION BY path
    ORDER BY CASE WHEN ext = 'html' THEN 0 WHEN length > 4000 THEN 1 ELSE 2 END, page_id) AS rn FROM files) WHERE rn = 1""")
def union_roots(spark, sf):
    f = cut(A.files(spark, sf).select("path", "length", "ext", "page_id"))  # content is read here and not again
    return dedupe.union_roots([f.filter("ext = 'html'"), f.filter("length > 4000"), f], ["page_id"]).drop("ext", "page_id")


@query("g3_carry_forward", """WITH newer AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1),
    older AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '2000-01-01' GROUP BY 1)
  SELECT * FROM newer UNION ALL SELECT * FROM older WHERE o_custkey NOT IN (SELECT o_custkey FROM newer)""")
def carry_forward(spark, sf):
    o, day = table(spark, sf, "orders"), F.lit("2000-01-01").cast("timestamp")
    new = o.filter(F.col("o_orderdate") >= day).groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    old = o.filter(F.col("o_orderdate") < day).groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    return dedupe.carry_forward(new, old, ["o_custkey"])


@query("g4_union_nested", f"""WITH b AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS frame, l_partkey || '|' || l_suppkey AS identity FROM lineitem)
  SELECT l_suppkey, identity, l_orderkey, l_returnflag FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, identity
    ORDER BY frame, l_orderkey, {A.SQL_LINE_ORDER}) AS rn FROM b) WHERE rn = 1""")
def union_nested(spark, sf):
    b = table(spark, sf, "lineitem").withColumn("identity", H.binding_key("l_partkey", "l_suppkey"))
    return dedupe.union_nested(
        [b.filter("l_returnflag = 'R'"), b.filter("l_returnflag <> 'R'")], ["l_suppkey"], "identity",
        ["l_orderkey", *[c for c in A.LINE_ORDER if c != "l_suppkey"]],
    ).select("l_suppkey", "identity", "l_orderkey", "l_returnflag")


@query("g5_leaf_files", f"WITH {A.SQL_MEMBERS} SELECT child AS path, kind FROM members WHERE NOT EXISTS (SELECT 1 FROM members p WHERE p.parent = members.child)")
def leaf_files(spark, sf):
    _, members = A.hierarchy(spark, sf)
    return dedupe.leaf_files(members.select(F.col("child").alias("path"), "kind"), members)


@query("g5_leaves_below_kind", f"""WITH {A.SQL_PATHS} SELECT path FROM paths WHERE contains(lower(path), '.a/')
    AND path NOT IN (SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) FROM paths)""")
def leaves_below_kind(spark, sf):
    return dedupe.leaves_below(A.member_paths(spark, sf), "a")
