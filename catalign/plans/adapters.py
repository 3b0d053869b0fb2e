"""Given tables seen as catalogue tables, in Spark and as SQL with the same columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import names as N, paths as P, values as V
from ..functions.hashes import normalize_hash


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- SQL fragments ---------------------------------------------------------

def sql_categorize(expr: str) -> str:
    text = f"lower(replace({expr}, '\\', '/'))"
    arms = []
    for label, needles in V.CATEGORY_RULES:
        hits = " OR ".join(f"contains({text}, '{n}')" for n in needles)
        arms.append(f"WHEN {hits} THEN '{label}'")
    return "CASE " + " ".join(arms) + f" ELSE '{V.CATEGORY_DEFAULT}' END"


def sql_leaf(expr: str) -> str:
    return f"split_part(replace({expr}, '\\', '/'), '/', -1)"


def sql_ext(expr: str) -> str:
    return f"nullif(lower(trim(regexp_extract({sql_leaf(expr)}, '\\.([^.]*)$', 1))), '')"


def sql_stem(expr: str) -> str:
    return f"regexp_replace({sql_leaf(expr)}, '(?s)^(.+)\\.[^.]+$', '\\1')"


def sql_slug(expr: str, fallback: str = "texture", stem: bool = True) -> str:
    inner = sql_stem(expr) if stem else expr
    t = (f"lower(regexp_replace(regexp_replace({inner}, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'))")
    return f"coalesce(nullif({t}, ''), '{fallback}')"


FORMAT_OF_LANG = {"en": 0, "fr": 3, "de": 5, "es": 12}
SQL_FORMAT = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FORMAT_OF_LANG.items()) + " ELSE 1 END"
ALPHA_IDS = ", ".join(str(f[0]) for f in V.FORMATS if f[3])

# Assets: documents with dimensions derived from their length.
SQL_ASSETS = f"""assets AS (
  SELECT d.doc_id, 'doc:' || d.doc_id AS asset_id, upper(substr(sha256(text), 1, 16)) AS candidate_hash,
    {SQL_FORMAT} AS format, CAST(1 + n_chars % 1024 AS INTEGER) AS width,
    CAST(1 + (n_chars // 8) % 512 AS INTEGER) AS height, 0 AS mip,
    CASE source WHEN 'src0' THEN 'stex' WHEN 'src1' THEN 'cgfx_struct' ELSE 'bch_struct' END AS parser_used,
    {sql_categorize('text')} AS category, d.source,
    CASE WHEN l.quality = 1 THEN [upper(substr(sha256(text), 1, 16))] ELSE [] END AS verified_hashes,
    CAST(coalesce(l.toxic, 0) AS BIGINT) AS material_binding_count
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def slim_assets(spark: SparkSession, sf: str) -> DataFrame:
    """Identity and dimensions of documents; one digest per text, no content carried on."""
    d = table(spark, sf, "documents")
    fmt = None
    for lang, code in FORMAT_OF_LANG.items():
        fmt = F.when(F.col("lang") == lang, code) if fmt is None else fmt.when(F.col("lang") == lang, code)
    return d.select(
        "doc_id", F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("asset_id"),
        F.upper(F.substring(F.sha2("text", 256), 1, 16)).alias("candidate_hash"),
        fmt.otherwise(1).alias("format"),
        (F.lit(1) + F.col("n_chars") % 1024).cast("int").alias("width"),
        (F.lit(1) + F.expr("n_chars div 8") % 512).cast("int").alias("height"),
        F.lit(0).alias("mip"),
        F.when(F.col("source") == "src0", "stex").when(F.col("source") == "src1", "cgfx_struct")
        .otherwise("bch_struct").alias("parser_used"),
        "text", "source", "lang", "n_chars",
    )


def assets(spark: SparkSession, sf: str) -> DataFrame:
    d = slim_assets(spark, sf).withColumn("category", N.categorize("text")).drop("text", "lang", "n_chars")
    labels = table(spark, sf, "labels")
    return d.join(labels, "doc_id", "left").withColumns({
        "verified_hashes": F.when(F.col("quality") == 1, F.array("candidate_hash")).otherwise(
            F.array().cast("array<string>")),
        "material_binding_count": F.coalesce("toxic", F.lit(0)).cast("bigint"),
    }).drop("quality", "toxic")


# Files: pages, the address without its scheme as the path.
SQL_FILES = f"""files AS (
  SELECT page_id, regexp_replace(url, '^[a-z]+://', '') AS path, html AS content, length(html) AS length,
    {sql_ext("regexp_replace(url, '^[a-z]+://', '')")} AS ext
  FROM pages)"""


def files(spark: SparkSession, sf: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://", "")
    return table(spark, sf, "pages").select(
        "page_id", path.alias("path"), F.col("html").alias("content"), F.length("html").cast("bigint").alias("length"),
        P.extension(path).alias("ext"))


# Evidence: events, one row per observed hash of a user.
SQL_RANK = ("CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 0 WHEN 'click' THEN 1 "
            "WHEN 'purchase' THEN 2 ELSE 3 END")
SQL_EVIDENCE = f"""evidence AS (
  SELECT user_id AS asset, lpad(upper(json_extract_string(props, '$.k')), 16, '0') AS hash, {SQL_RANK} AS rank,
    event_type AS method, ts, event_id FROM events)"""


def event_evidence(events: DataFrame) -> DataFrame:
    rank = (F.when(F.col("event_type").isin("view", "error"), 0).when(F.col("event_type") == "click", 1)
            .when(F.col("event_type") == "purchase", 2).otherwise(3))
    return events.withColumn("k", F.get_json_object("props", "$.k")).select(
        F.col("user_id").alias("asset"), normalize_hash("k").alias("hash"),
        rank.alias("rank"), F.col("event_type").alias("method"), "ts", "event_id")


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    return event_evidence(table(spark, sf, "events"))


# Bindings: lineitem. The table has no key, so orders list every column.
LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
              "l_returnflag", "l_linestatus", "l_shipdate"]
SQL_LINE_ORDER = ", ".join(LINE_ORDER)
SQL_BINDINGS = """bindings AS (
  SELECT *, l_linenumber - 1 AS slot, l_returnflag = 'N' AS enabled FROM lineitem)"""


def bindings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumns({
        "slot": F.col("l_linenumber") - 1, "enabled": F.col("l_returnflag") == "N"})


SQL_SLOTS = f"""{SQL_BINDINGS}, slots AS (
  SELECT l_orderkey AS material, slot, l_partkey AS asset, CAST(l_partkey % 14 AS INTEGER) AS format FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, slot ORDER BY NOT enabled, {SQL_LINE_ORDER}) AS rn
    FROM bindings WHERE slot IN (0, 1, 2)) WHERE rn = 1)"""


def slots(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.dedupe import pick_slot

    return pick_slot(bindings(spark, sf), ["l_orderkey"], "slot", "enabled", LINE_ORDER, V.MATERIAL_SLOTS).select(
        F.col("l_orderkey").alias("material"), "slot", F.col("l_partkey").alias("asset"),
        (F.col("l_partkey") % 14).cast("int").alias("format"))


# Stage inputs: conversations, one input per turn.
SQL_STAGES = """stages AS (
  SELECT conv_id AS material, turn AS stage, 0 AS input, 0 AS combiner_id,
    CASE role WHEN 'user' THEN CAST(3 + turn % 3 AS INTEGER) WHEN 'assistant' THEN 15 ELSE 0 END AS source_id,
    CASE role WHEN 'user' THEN CAST(length(text) % 9 AS INTEGER) ELSE CAST(length(text) % 2 AS INTEGER) END AS operand_id
  FROM conversations)"""


def stages(spark: SparkSession, sf: str) -> DataFrame:
    n, user = F.length("text"), F.col("role") == "user"
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("material"), F.col("turn").alias("stage"), F.lit(0).alias("input"),
        F.lit(0).alias("combiner_id"),
        F.when(user, (F.col("turn") % 3 + 3).cast("int")).when(F.col("role") == "assistant", 15).otherwise(0)
        .alias("source_id"),
        F.when(user, n % 9).otherwise(n % 2).alias("operand_id"))


# Containers: region > nation > customer > orders > lineitem.
SQL_MEMBERS = """roots AS (SELECT 'R' || r_regionkey AS path, 'B' AS kind FROM region),
members AS MATERIALIZED (
  SELECT 'R' || n_regionkey AS parent, 'N' || n_nationkey AS child,
    CASE n_nationkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS kind FROM nation
  UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'MACHINERY' THEN 'C' WHEN 'HOUSEHOLD' THEN NULL ELSE 'B' END
    FROM customer
  UNION ALL SELECT 'C' || o_custkey, 'O' || o_orderkey,
    CASE o_orderstatus WHEN 'F' THEN 'B' WHEN 'O' THEN 'C' ELSE NULL END FROM orders
  UNION ALL SELECT DISTINCT 'O' || l_orderkey, 'L' || l_orderkey || '-' || l_linenumber, NULL FROM lineitem)"""


# Paths spell out all containers: a container's name ends in its kind.
SQL_PATHS = f"""{SQL_MEMBERS},
paths0 AS (SELECT path AS node, path || '.' || kind AS path FROM roots),
""" + ",\n".join(f"""paths{n} AS MATERIALIZED (SELECT child AS node, path || '/' || child || coalesce('.' || kind, '') AS path
  FROM members JOIN paths{n - 1} ON parent = node)""" for n in range(1, 5)) + """,
paths AS MATERIALIZED (""" + " UNION ALL ".join(f"SELECT path FROM paths{n}" for n in range(5)) + ")"


def hierarchy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(roots, members)."""
    roots, levels = _levels(spark, sf)
    return roots, reduce(DataFrame.unionByName, levels)


def member_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths of all roots and members, level by level."""
    roots, levels = _levels(spark, sf)
    steps = [roots.select(F.col("path").alias("node"), F.concat_ws(".", "path", "kind").alias("path"))]
    for level in levels:
        steps.append(level.join(steps[-1], F.col("parent") == F.col("node")).select(
            F.col("child").alias("node"), F.concat("path", F.lit("/"), F.concat_ws(".", "child", "kind")).alias("path")))
    return reduce(DataFrame.unionByName, steps).select("path")


def _levels(spark: SparkSession, sf: str) -> tuple[DataFrame, list[DataFrame]]:
    """Roots, and the members of each level from the top."""
    def tag(prefix, *cols):
        return F.concat(F.lit(prefix), F.concat_ws("-", *[F.col(c).cast("string") for c in cols]))

    none = F.lit(None).cast("string")
    roots = table(spark, sf, "region").select(tag("R", "r_regionkey").alias("path"), F.lit("B").alias("kind"))
    rest = F.col("n_nationkey") % 3
    parts = [
        (table(spark, sf, "nation"), tag("R", "n_regionkey"), tag("N", "n_nationkey"),
         F.when(rest == 0, "A").when(rest == 1, "B").otherwise("C")),
        (table(spark, sf, "customer"), tag("N", "c_nationkey"), tag("C", "c_custkey"),
         F.when(F.col("c_mktsegment") == "BUILDING", "A").when(F.col("c_mktsegment") == "MACHINERY", "C")
         .when(F.col("c_mktsegment") == "HOUSEHOLD", none).otherwise("B")),
        (table(spark, sf, "orders"), tag("C", "o_custkey"), tag("O", "o_orderkey"),
         F.when(F.col("o_orderstatus") == "F", "B").when(F.col("o_orderstatus") == "O", "C").otherwise(none)),
        (table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct(),
         tag("O", "l_orderkey"), tag("L", "l_orderkey", "l_linenumber"), none),
    ]
    return roots, [df.select(parent.alias("parent"), child.alias("child"), kind.alias("kind")) for df, parent, child, kind in parts]


# Archives: orders with their lines as members, admitted per customer.
BUDGET = {"max_depth": 3, "max_members": 40, "max_expanded_bytes": 1000, "max_member_bytes": 49,
          "max_archive_bytes": 450_000}
SQL_ARCHIVES = """archives AS (
  SELECT o_orderkey, o_custkey, CAST(left(o_orderpriority, 1) AS INTEGER) - 1 AS depth,
    CAST(floor(o_totalprice) AS BIGINT) AS archive_size, m.members, m.bytes, m.largest, m.smallest
  FROM orders JOIN (
    SELECT l_orderkey, count(*) AS members, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS bytes,
      max(CAST(l_quantity AS BIGINT)) AS largest, min(CAST(l_quantity AS BIGINT)) AS smallest
    FROM lineitem GROUP BY 1) m ON m.l_orderkey = o_orderkey)"""


def archives(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.budget import archive_totals

    lines = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_quantity").cast("bigint").alias("size"))
    return table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.substring("o_orderpriority", 1, 1).cast("int") - 1).alias("depth"),
        F.floor("o_totalprice").cast("bigint").alias("archive_size"),
    ).join(archive_totals(lines, ["l_orderkey"], "size").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
