"""Queries for validation, state changes and streams (2.I, 2.J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashes as H, names as N
from ..operators import evidence as EV, state as ST, summary as S, validate as VA
from ..operators.budget import check_members
from ..operators.lookup import keep_live_name, reconcile_counts
from ..operators.matching import match_nearest
from ..session import scratch_path
from ..sources import documents as docs
from ..streaming import evidence as stream
from . import adapters as A
from .adapters import table
from .counts import SQL_MATCH, exact_matches
from .joins import SQL_COUNTS, SQL_MAPPING, SQL_NEAREST, count_tables, mapping_tables
from .registry import query


@query("i1_validate_catalog", f"""WITH {A.SQL_EVIDENCE}
  SELECT 'game_mismatch' AS rule, doc_id::VARCHAR AS subject FROM documents WHERE lang IS DISTINCT FROM 'en'
  UNION ALL SELECT 'duplicate_id', n_chars::VARCHAR FROM documents GROUP BY n_chars HAVING count(*) > 1
  UNION ALL SELECT 'conflicting_hash', hash FROM evidence WHERE rank >= 2 GROUP BY 2 HAVING count(DISTINCT asset) > 1
  UNION ALL SELECT 'schema_version', doc_id::VARCHAR FROM documents WHERE source = 'src2'""")
def validate_catalog(spark, sf):
    d = table(spark, sf, "documents")
    by_id = VA.validate_catalog(
        d.withColumnRenamed("doc_id", "asset"), A.evidence(spark, sf).limit(0), "asset", "lang", "en",
        F.when(F.col("source") == "src2", 2).otherwise(1))
    ids = VA.validate_catalog(d.withColumnRenamed("n_chars", "asset"), A.evidence(spark, sf), "asset", "lang", "en")
    return by_id.unionByName(ids.filter(F.col("rule") != "game_mismatch"))


@query("i2_plan_mapping", f"""WITH {A.SQL_ASSETS}, ev AS (SELECT doc_id, unnest(verified_hashes) AS hash, category || '/' || source || '.png' AS path FROM assets)
  SELECT hash, CASE WHEN count(DISTINCT path) = 1 THEN min(path) END AS path,
    CASE WHEN count(DISTINCT path) = 1 THEN 'mapped' ELSE 'conflict' END AS state FROM ev GROUP BY 1""")
def plan_mapping(spark, sf):
    ev = A.assets(spark, sf).select(
        F.explode("verified_hashes").alias("hash"), F.concat("category", F.lit("/"), "source", F.lit(".png")).alias("path"),
        F.lit(2).alias("rank"))
    return VA.plan_mapping(ev, "hash", "path")


@query("i3_validate_mapping", f"""WITH {SQL_MAPPING} SELECT CASE n_files WHEN 0 THEN 'no_file' ELSE 'several_files' END AS rule, hash AS subject
    FROM resolved WHERE n_files <> 1
  UNION ALL SELECT DISTINCT 'bad_hash', split_part(path, '/', 1) FROM files
  UNION ALL SELECT 'root_documents', count(*)::VARCHAR FROM (SELECT DISTINCT split_part(path, '/', 1) FROM files)""")
def validate_mapping(spark, sf):
    mapping, files = mapping_tables(spark, sf)
    host = F.substring_index("path", "/", 1)
    bad = files.select(host.alias("hash"), F.col("path").alias("name"))
    return VA.validate_mapping(mapping.unionByName(bad), files, roots=files.select(host.alias("root")).distinct())


SQL_PAGE_NAMES = r"""names AS (SELECT upper(substr(sha256(html), 1, 16)) AS hash, replace(url, 'https://', '') || CASE WHEN page_id % 3 = 0 THEN '' ELSE '.png' END AS name
    FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)"""


@query("i3_mapping_paths", f"""WITH {SQL_PAGE_NAMES} SELECT DISTINCT 'bad_path' AS rule, name AS subject FROM names
    WHERE name = '' OR regexp_matches(name, '(^|/)(\\.\\.)?(/|$)') OR NOT ends_with(lower(name), '.png')""")
def mapping_paths(spark, sf):
    """Names are the pages' addresses, of which one in three is no image; all of them resolve."""
    names = table(spark, sf, "pages").filter("url IS NOT NULL AND html IS NOT NULL").select(
        F.upper(F.substring(F.sha2("html", 256), 1, 16)).alias("hash"),
        F.concat(F.replace("url", F.lit("https://"), F.lit("")), F.when(F.col("page_id") % 3 == 0, "").otherwise(".png")).alias("name"))
    found = VA.validate_mapping(names, names.select(F.col("name").alias("path")).distinct(), image_ext="png")
    return found.filter("rule = 'bad_path'")


LIMITS = {"max_members": 8, "max_expanded_bytes": 250, "max_member_bytes": 45, "max_archive_bytes": 90_000}


@query("i4_check_members", """WITH m AS (SELECT l_orderkey AS archive, CAST(l_quantity AS BIGINT) - 3 AS size, l_linenumber * 10 - 15 AS off,
      CAST(floor(l_extendedprice) AS BIGINT) AS archive_size FROM lineitem),
    t AS (SELECT archive, count(*) AS n, sum(size) AS b, max(archive_size) AS a FROM m GROUP BY 1)
  SELECT archive, rule, count(*) AS n FROM (SELECT archive, CASE WHEN size < 0 THEN 'negative_size' WHEN off < 0 OR off + size > archive_size THEN 'outside_source'
      WHEN size > 45 THEN 'member_bytes' END AS rule FROM m) WHERE rule IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT archive, 'members', 1 FROM t WHERE n > 8 UNION ALL SELECT archive, 'expanded_bytes', 1 FROM t WHERE b > 250
  UNION ALL SELECT archive, 'archive_bytes', 1 FROM t WHERE a > 90000""")
def members(spark, sf):
    m = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("archive"), (F.col("l_quantity").cast("bigint") - 3).alias("size"),
        (F.col("l_linenumber") * 10 - 15).alias("off"), F.floor("l_extendedprice").cast("bigint").alias("archive_size"))
    return check_members(m, "archive", "off", "size", "archive_size", LIMITS)


@query("i5_verdict", """SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS agreeing, count(*) FILTER (l_returnflag = 'R') AS disagreeing,
    CASE WHEN count(*) FILTER (l_returnflag = 'R') > 0 THEN 'FAIL' WHEN count(*) FILTER (l_returnflag = 'A') > 0 THEN 'PASS'
      ELSE 'NO_EXACT_SAMPLES' END AS verdict FROM lineitem GROUP BY 1""")
def verdicts(spark, sf):
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_returnflag") == "A").alias("agreeing"), F.count_if(F.col("l_returnflag") == "R").alias("disagreeing"))
    return t.withColumn("verdict", S.verdict("agreeing", "disagreeing"))


@query("i6_coverage_complete", f"WITH {SQL_COUNTS} SELECT count(*) AS issues, count(*) = 0 AS complete FROM both_sides WHERE audit > production")
def coverage_complete(spark, sf):
    audit, production = count_tables(spark, sf)
    return S.coverage_complete(reconcile_counts(audit, production, ["k"], "n").filter("state = 'missed'"))


@query("j1_rescan_upsert", f"""WITH old AS (SELECT doc_id, n_chars, lang, {A.sql_categorize('text')} AS category, quality, toxic = 1 AS pinned
      FROM documents LEFT JOIN labels USING (doc_id)),
    new AS (SELECT CASE WHEN source = 'src1' THEN doc_id + 1000000 ELSE doc_id END AS doc_id, n_chars + 1 AS n_chars, upper(lang) AS lang, 'rescanned' AS category
      FROM documents WHERE lang <> 'en' OR source = 'src1')
  SELECT doc_id, CASE WHEN new.n_chars IS NOT NULL THEN new.n_chars ELSE old.n_chars END AS n_chars,
    CASE WHEN new.n_chars IS NOT NULL THEN new.lang ELSE old.lang END AS lang, quality,
    CASE WHEN pinned OR new.n_chars IS NULL THEN old.category ELSE new.category END AS category, coalesce(pinned, false) AS pinned
  FROM old FULL JOIN new USING (doc_id)""")
def rescan_upsert(spark, sf):
    d = table(spark, sf, "documents")
    old = d.join(table(spark, sf, "labels"), "doc_id", "left").select(
        "doc_id", "n_chars", "lang", "quality", N.categorize("text").alias("category"), (F.col("toxic") == 1).alias("pinned"))
    new = d.filter((F.col("lang") != "en") | (F.col("source") == "src1")).select(
        F.when(F.col("source") == "src1", F.col("doc_id") + 1000000).otherwise(F.col("doc_id")).alias("doc_id"),
        (F.col("n_chars") + 1).alias("n_chars"), F.upper("lang").alias("lang"), F.lit("rescanned").alias("category"))
    return ST.rescan_upsert(old, new, ["doc_id"], ["n_chars", "lang"], ["quality"], ["category"], "pinned")


SQL_RESCAN = f"""{A.SQL_EVIDENCE}, halves AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1 END AS fresh FROM evidence),
  side AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fresh, asset, hash ORDER BY rank DESC, ts, event_id) AS rn FROM halves) WHERE rn = 1)"""


@query("j1_rescan_evidence", f"""WITH {SQL_RESCAN} SELECT coalesce(s.asset, n.asset) AS asset, coalesce(s.hash, n.hash) AS hash,
    CASE WHEN n.rank > coalesce(s.rank, -1) THEN n.rank ELSE s.rank END AS rank, CASE WHEN n.rank > coalesce(s.rank, -1) THEN n.event_id ELSE s.event_id END AS event_id
  FROM (SELECT * FROM side WHERE fresh = 0) s FULL JOIN (SELECT * FROM side WHERE fresh = 1) n ON s.asset = n.asset AND s.hash IS NOT DISTINCT FROM n.hash""")
def rescan_evidence(spark, sf):
    """Odd events are a rescan of what the even ones left in the catalogue."""
    how = (["asset", "hash"], "rank", ["ts", "event_id"])
    ev = A.evidence(spark, sf)
    stored = EV.merge_evidence(ev.filter("event_id % 2 = 0"), *how)
    return EV.rescan_evidence(stored, ev.filter("event_id % 2 <> 0"), *how).select("asset", "hash", "rank", "event_id")


SQL_PENDING = f"""{A.SQL_EVIDENCE}, best AS (SELECT asset, hash, rank, CASE WHEN rank >= 2 THEN 'verified' ELSE 'candidate' END AS status, method FROM (
    SELECT *, row_number() OVER (PARTITION BY asset, hash ORDER BY rank DESC, ts, event_id) AS rn FROM evidence) WHERE rn = 1),
  decisions AS (SELECT DISTINCT c_custkey AS asset, lpad((c_nationkey * 4)::VARCHAR, 16, '0') AS hash FROM customer)"""


def pending(spark, sf):
    best = EV.merge_evidence(A.evidence(spark, sf), ["asset", "hash"], "rank", ["ts", "event_id"]).select(
        "asset", "hash", F.when(EV.is_verified(), "verified").otherwise("candidate").alias("status"), "method")
    decisions = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("asset"), F.lpad((F.col("c_nationkey") * 4).cast("string"), 16, "0").alias("hash"))
    return best, decisions


@query("j2_confirm", f"""WITH {SQL_PENDING} SELECT b.asset, b.hash, CASE WHEN d.asset IS NOT NULL THEN 'verified' ELSE status END AS status,
    CASE WHEN d.asset IS NOT NULL AND status = 'candidate' THEN 'user_confirmed_visual_candidate' ELSE method END AS method
  FROM best b LEFT JOIN decisions d ON d.asset = b.asset AND d.hash = b.hash""")
def confirm(spark, sf):
    best, decisions = pending(spark, sf)
    return EV.confirm(best, decisions, ["asset", "hash"])[0]


@query("j2_confirm_log", f"""WITH {SQL_PENDING} SELECT b.asset, b.hash, b.method AS candidate_method, 'user_confirmed_visual_candidate' AS method
  FROM best b JOIN decisions d ON d.asset = b.asset AND d.hash = b.hash WHERE status = 'candidate'""")
def confirm_log(spark, sf):
    best, decisions = pending(spark, sf)
    return EV.confirm(best, decisions, ["asset", "hash"])[2].select("asset", "hash", "candidate_method", "method")


@query("j2_confirm_errors", f"""WITH {SQL_PENDING} SELECT asset, hash,
    CASE WHEN EXISTS (SELECT 1 FROM best b WHERE b.asset = decisions.asset) THEN 'no_pending' ELSE 'unknown_asset' END AS error FROM decisions
  WHERE (asset, hash) NOT IN (SELECT (asset, hash) FROM best WHERE status = 'candidate')""")
def confirm_errors(spark, sf):
    best, decisions = pending(spark, sf)
    return EV.confirm(best, decisions, ["asset", "hash"])[1]


@query("j3_apply_evidence", f"""WITH {SQL_MATCH}, stored AS (SELECT a.doc_id AS asset, a.candidate_hash AS hash, CASE WHEN l.quality = 1 THEN 'verified' ELSE 'candidate' END AS status,
      'scan' AS method, 0 AS fresh, a.doc_id AS item FROM assets a JOIN labels l USING (doc_id)),
    incoming AS (SELECT asset, candidate_hash, 'verified', 'exact', 1, doc_id FROM matches WHERE status = 'verified'
      UNION ALL SELECT d.doc_id, upper(substr(md5(d.source), 1, 16)), 'candidate', 'similar', 1, d.doc_id FROM documents d JOIN labels USING (doc_id)),
    both_sides AS (SELECT * FROM stored UNION ALL SELECT * FROM incoming),
    ranked AS (SELECT *, count(*) OVER (PARTITION BY asset, hash) AS log_rows, row_number() OVER (PARTITION BY asset, hash ORDER BY status = 'candidate',
      CASE WHEN status = 'verified' THEN fresh ELSE -fresh END, item) AS rn FROM both_sides)
  SELECT asset, hash, status, method, log_rows FROM ranked WHERE rn = 1""")
def apply_evidence(spark, sf):
    catalog, m = exact_matches(spark, sf)
    stored = catalog.join(table(spark, sf, "labels"), F.col("asset") == F.col("doc_id")).select(
        "asset", F.col("candidate_hash").alias("hash"), F.when(F.col("quality") == 1, "verified").otherwise("candidate").alias("status"),
        F.lit("scan").alias("method"), F.col("asset").alias("item"))
    exact = m.filter("status = 'verified'").select(
        "asset", F.col("candidate_hash").alias("hash"), "status", F.lit("exact").alias("method"), F.col("doc_id").alias("item"))
    similar = catalog.select(
        "asset", F.upper(F.substring(F.md5("source"), 1, 16)).alias("hash"), F.lit("candidate").alias("status"),
        F.lit("similar").alias("method"), F.col("asset").alias("item"))
    return EV.apply_evidence(stored, exact.unionByName(similar), ["asset", "hash"], ["item"]).drop("item")


@query("j3_similar_to_pending", f"""WITH {SQL_NEAREST} SELECT neighbour AS asset, lpad(vec_id::VARCHAR, 16, '0') AS hash,
    'candidate' AS status, 'similar' AS method, CAST(1 AS BIGINT) AS log_rows FROM two
  WHERE score <= 0.115 AND (second - score >= 0.001 OR second >= 0.2) AND neighbour <> vec_id
  UNION ALL SELECT vec_id, lpad(vec_id::VARCHAR, 16, '0'), CASE WHEN vec_id % 5 = 0 THEN 'verified' ELSE 'candidate' END,
    CASE WHEN vec_id % 5 = 0 OR NOT ok THEN 'stored' ELSE 'similar' END,
    CAST(CASE WHEN ok AND (vec_id % 3 = 0 OR vec_id % 5 = 0) THEN 2 ELSE 1 END AS BIGINT) FROM (
      SELECT vec_id, coalesce(score <= 0.115 AND (second - score >= 0.001 OR second >= 0.2), false) AS ok FROM v LEFT JOIN two USING (vec_id))
  WHERE ok OR vec_id % 3 = 0 OR vec_id % 5 = 0""")
def similar_to_pending(spark, sf):
    """Accepted similar matches enter as candidates, never as verified."""
    e = table(spark, sf, "embeddings")
    m = match_nearest(e, e.withColumnRenamed("vec_id", "asset"), "vec_id", "asset", "embedding", "label",
                      best_max=0.115, gap_min=0.001, second_ok=0.2, exclude_same=True).filter("accepted")
    found = m.select("asset", F.lpad(F.col("vec_id").cast("string"), 16, "0").alias("hash"), F.lit("candidate").alias("status"),
                     F.lit("similar").alias("method"), F.col("vec_id").alias("item"))
    # The catalogue already has a pending row for every third item and a verified one for every fifth.
    stored = e.filter("vec_id % 3 = 0 OR vec_id % 5 = 0").select(
        F.col("vec_id").alias("asset"), F.lpad(F.col("vec_id").cast("string"), 16, "0").alias("hash"),
        F.when(F.col("vec_id") % 5 == 0, "verified").otherwise("candidate").alias("status"), F.lit("stored").alias("method"),
        F.col("vec_id").alias("item"))
    pairs = found.select(F.col("item").alias("asset"), "hash", "status", "method", "item")
    return EV.apply_evidence(stored, found.unionByName(pairs), ["asset", "hash"], ["item"]).drop("item")


SQL_USER = """updates AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000 ELSE 0 END AS doc_id, quality AS stars, 'reviewed' AS tag FROM labels)"""


def user_updates(spark, sf):
    catalog = table(spark, sf, "documents").select("doc_id", F.lit(None).cast("int").alias("stars"), F.col("lang").alias("tag"))
    updates = table(spark, sf, "labels").select(
        (F.col("doc_id") + F.when(F.col("toxic") == 1, 1000000).otherwise(0)).alias("doc_id"),
        F.col("quality").alias("stars"), F.lit("reviewed").alias("tag"))
    return ST.set_user_metadata(catalog, updates, "doc_id", ["stars", "tag"])


@query("j4_set_user_metadata", f"""WITH {SQL_USER} SELECT d.doc_id, u.stars, CASE WHEN u.doc_id IS NOT NULL THEN u.tag ELSE d.lang END AS tag
  FROM documents d LEFT JOIN updates u USING (doc_id)""")
def set_user_metadata(spark, sf):
    return user_updates(spark, sf)[0]


@query("j4_unknown_ids", f"WITH {SQL_USER} SELECT doc_id FROM updates WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def unknown_ids(spark, sf):
    return user_updates(spark, sf)[1]


@query("j5_sanitize_refs", """SELECT page_id, CASE WHEN starts_with(url, 'http://') THEN '' ELSE url END AS url,
    CASE WHEN starts_with(url, 'http://') THEN 'transient_removed' END AS url_status FROM pages""")
def sanitize_refs(spark, sf):
    return ST.sanitize_refs(table(spark, sf, "pages").select("page_id", "url"), ["url"], "http://", "transient_removed")


@query("j6_keep_live_name", """WITH live AS (SELECT upper(substr(md5(p_name), 1, 16)) AS hash, 'live/' || min(p_partkey) || '.png' AS file FROM part WHERE p_size <= 25 GROUP BY 1),
    probes AS (SELECT p_partkey, unnest([upper(substr(md5(p_name), 1, 16)), upper(substr(md5(split_part(p_name, ' ', 1)), 1, 16)),
      upper(substr(md5(CASE WHEN p_size > 40 THEN 'red widget' ELSE '' END), 1, 16))]) AS hash FROM part),
    hit AS (SELECT p_partkey, min(file) AS file FROM probes JOIN live USING (hash) GROUP BY 1 HAVING count(DISTINCT file) = 1)
  SELECT p.p_partkey, coalesce(split_part(file, '/', -1), p_name) AS name FROM part p LEFT JOIN hit USING (p_partkey)""")
def live_names(spark, sf):
    part = table(spark, sf, "part")

    def h(c):
        return F.upper(F.substring(F.md5(c), 1, 16))

    live = part.filter("p_size <= 25").groupBy(h(F.col("p_name")).alias("hash")).agg(
        F.concat(F.lit("live/"), F.min("p_partkey").cast("string"), F.lit(".png")).alias("file"))
    assets = part.select("p_partkey", F.col("p_name").alias("name"), F.array(
        h(F.col("p_name")), h(F.substring_index("p_name", " ", 1)),
        h(F.when(F.col("p_size") > 40, "red widget").otherwise(""))).alias("hashes"))
    return keep_live_name(assets, live, "p_partkey", "hashes", "name").drop("hashes")


def event_stream(spark, sf):
    """The events table as a stream: a folder as it is, a single file through its folder."""
    path, schema = f"{sf}/events.parquet", table(spark, sf, "events").schema
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", 256 << 30)  # a backlog comes in several batches
    if docs.is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", "events.parquet").parquet(sf)


@query("j7_stream_upsert", f"""WITH {A.SQL_EVIDENCE} SELECT asset, hash, rank, method, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY asset, hash ORDER BY rank DESC, ts, event_id) AS rn FROM evidence) WHERE rn = 1""")
def stream_upsert(spark, sf):
    root = scratch_path(spark, "stream")
    how = (["asset", "hash"], "rank", ["ts", "event_id"])
    stream.stream_upsert(A.event_evidence(event_stream(spark, sf)), root, *how, f"{root}/progress").awaitTermination()
    schema = A.evidence(spark, sf).schema
    stream.compact(spark, root, *how, schema)
    return stream.read_merged(spark, root, *how, schema).select("asset", "hash", "rank", "method", "event_id")


@query("j8_stream_dedupe", f"WITH {A.SQL_EVIDENCE} SELECT DISTINCT asset, hash FROM evidence")
def stream_dedupe(spark, sf):
    root = scratch_path(spark, "dedupe")
    keys = ["asset", "hash"]
    stream.stream_dedupe(A.event_evidence(event_stream(spark, sf)), root, keys, f"{root}/progress").awaitTermination()
    return stream.read_deduped(spark, root, keys, A.evidence(spark, sf).schema)


@query("j8_stream_first_rows", f"""WITH {A.SQL_EVIDENCE} SELECT asset, hash, rank, method, event_id FROM (
    SELECT *, row_number() OVER (PARTITION BY asset, hash ORDER BY ts, event_id) AS rn FROM evidence) WHERE rn = 1""")
def stream_first_rows(spark, sf):
    root, keys, order = scratch_path(spark, "first-rows"), ["asset", "hash"], ["ts", "event_id"]
    stream.stream_dedupe(A.event_evidence(event_stream(spark, sf)), root, keys, f"{root}/progress", order).awaitTermination()
    return stream.read_deduped(spark, root, keys, A.evidence(spark, sf).schema, order).select("asset", "hash", "rank", "method", "event_id")
