"""Queries for filters and row expressions (2.B, 2.C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import content as C, dims as D, hashes as H, names as N, paths as P, values as V
from ..operators import filters as B
from ..operators.fingerprint import descriptor
from ..operators.ranking import top_per_group
from . import adapters as A
from .adapters import table
from .registry import query

SQL_UNSAFE = "CASE WHEN p IS NULL OR p = '' THEN 'empty' " + " ".join(
    f"WHEN regexp_matches(p, '{pattern}') THEN '{name}'" for name, pattern in P.UNSAFE_PATTERNS) + " END"


@query("b1_candidate_filter", f"""WITH {A.SQL_FILES} SELECT path FROM files
  WHERE ext IN ('html') OR starts_with(content, '<htm') OR contains(content, '***')""")
def candidate_filter(spark, sf):
    return B.candidate_filter(A.files(spark, sf), exts=["html"], magics=["<htm"], needle="***",
                              binary=False).select("path")


@query("b2_signature_filter", f"""WITH {A.SQL_FILES}, ruled AS (SELECT path, CASE
    WHEN starts_with(content, '<!DO') THEN CASE WHEN contains(content, '***') OR contains(content, '%%%') THEN 'wrapped' END
    WHEN starts_with(content, '<htm') OR starts_with(content, '<HTM') THEN 'magic'
    WHEN contains(content, '<script') THEN CASE WHEN ext IN ('html') THEN 'extension' ELSE 'embedded' END END AS rule
  FROM files) SELECT path, rule FROM ruled WHERE rule IS NOT NULL""")
def signature_filter(spark, sf):
    return B.signature_filter(
        A.files(spark, sf), magics=["<htm", "<HTM"], wrapper="<!DO", wrapped=["***", "%%%"], exts=["html"],
        needle="<script", binary=False).select("path", "rule")


@query("b3_safe_path", f"""WITH paths AS (
    SELECT url AS path FROM pages UNION ALL SELECT regexp_replace(url, '^[a-z]+://', '') FROM pages
    UNION ALL SELECT p_name FROM part UNION ALL SELECT '/' || p_name FROM part
    UNION ALL SELECT p_name || '/../' || p_type FROM part UNION ALL SELECT 'aux.' || p_type FROM part),
  judged AS (SELECT path, replace(path, '\\', '/') AS p FROM paths)
  SELECT path, {SQL_UNSAFE} AS reason FROM judged""")
def safe_path(spark, sf):
    url = table(spark, sf, "pages").select(F.explode(F.array(
        F.col("url"), F.regexp_replace("url", "^[a-z]+://", ""))).alias("path"))
    part = table(spark, sf, "part").select(F.explode(F.array(
        F.col("p_name"), F.concat(F.lit("/"), "p_name"), F.concat("p_name", F.lit("/../"), "p_type"),
        F.concat(F.lit("aux."), "p_type"))).alias("path"))
    ok, bad = B.split_unsafe(url.unionByName(part))
    return ok.withColumn("reason", F.lit(None).cast("string")).unionByName(bad)


@query("b4_size_guard", f"""WITH {A.SQL_FILES} SELECT path, length, length <= 6000 AS kept,
  CASE WHEN length > 6000 THEN 'size ' || length || ' exceeds 6000' END AS message FROM files""")
def size_guard(spark, sf):
    return B.flag_size(A.files(spark, sf).select("path", "length"), 6000)


@query("b5_skip_extensions", f"""WITH {A.SQL_FILES} SELECT path FROM files
  WHERE NOT coalesce(ext IN ('html', 'txt'), false) OR contains(content, '***')""")
def skip_extensions(spark, sf):
    return B.skip_extensions(A.files(spark, sf), skipped=["html", "txt"],
                             unless=C.contains_token("content", "***", False)).select("path")


@query("b6_countable_issues", """WITH issues AS (SELECT event_id, event_type AS stage,
    'u' || user_id || CASE WHEN value > 10 THEN '.farc' ELSE '.stex' END AS source FROM events)
  SELECT event_id FROM issues WHERE CASE stage WHEN 'error' THEN NOT source LIKE '%.farc'
    WHEN 'purchase' THEN source LIKE '%.stex' ELSE stage IN ('click', 'view') END""")
def countable_issues(spark, sf):
    issues = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("stage"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"),
                 F.when(F.col("value") > 10, ".farc").otherwise(".stex")).alias("source"))
    return B.countable_issues(issues, stages=["click", "view"], read_stage="error",
                              decode_stage="purchase").select("event_id")


@query("b7_verified_only", f"WITH {A.SQL_EVIDENCE} SELECT asset, hash, rank, event_id FROM evidence WHERE rank >= 2")
def verified_only(spark, sf):
    return B.verified_only(A.evidence(spark, sf)).select("asset", "hash", "rank", "event_id")


@query("b8_valid_ids", """WITH ids AS (
    SELECT 'doc:' || doc_id AS asset_id, substr(sha256(text), 1, 16) AS title_id,
      substr(sha256(text), 1, CAST(1 + n_chars % 20 AS INTEGER)) AS hash FROM documents
    UNION ALL SELECT c_name, '0004000000' || lpad(c_custkey::VARCHAR, 6, '0'), c_custkey::VARCHAR FROM customer
    UNION ALL SELECT o_orderpriority, lpad(o_orderkey::VARCHAR, 16, '0'), o_custkey::VARCHAR FROM orders)
  SELECT * FROM ids WHERE regexp_full_match(asset_id, '[A-Za-z0-9_.:-]{1,128}')
    AND regexp_full_match(title_id, '[0-9A-Fa-f]{16}') AND regexp_full_match(trim(hash), '[0-9A-Fa-f]{1,16}')""")
def valid_ids(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("asset_id"),
        F.substring(F.sha2("text", 256), 1, 16).alias("title_id"),
        F.expr("substring(sha2(text, 256), 1, cast(1 + n_chars % 20 as int))").alias("hash"))
    cust = table(spark, sf, "customer").select(
        F.col("c_name").alias("asset_id"),
        F.concat(F.lit("0004000000"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("title_id"),
        F.col("c_custkey").cast("string").alias("hash"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("asset_id"), F.lpad(F.col("o_orderkey").cast("string"), 16, "0").alias("title_id"),
        F.col("o_custkey").cast("string").alias("hash"))
    return B.valid_ids(docs.unionByName(cust).unionByName(orders), "asset_id", "title_id", "hash")


@query("b9_hashes_or_candidate", """SELECT d.doc_id,
    upper(substr(CASE WHEN l.quality = 1 THEN sha256(text) ELSE md5(text) END, 1, 16)) AS hash
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def hashes_or_candidate(spark, sf):
    d = table(spark, sf, "documents").select(
        "doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("good"), F.substring(F.md5("text"), 1, 16).alias("guess"))
    j = d.join(table(spark, sf, "labels"), "doc_id", "left").withColumn(
        "verified", F.when(F.col("quality") == 1, F.array("good", "good")))
    return j.select("doc_id", F.explode(H.hashes_or_candidate("verified", "guess")).alias("hash"))


@query("c1_categorize", f"""SELECT 'd' || doc_id AS id, {A.sql_categorize('text')} AS category FROM documents
  UNION ALL SELECT 'p' || page_id, {A.sql_categorize('url')} FROM pages""")
def categorize(spark, sf):
    d = table(spark, sf, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), N.categorize("text").alias("category"))
    p = table(spark, sf, "pages").select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), N.categorize("url").alias("category"))
    return d.unionByName(p)


@query("c2_slug", f"""SELECT p_name AS name, {A.sql_slug('p_name')} AS slug FROM part
  UNION ALL SELECT url, {A.sql_slug('url')} FROM pages""")
def slug(spark, sf):
    return table(spark, sf, "part").select(F.col("p_name").alias("name")).unionByName(
        table(spark, sf, "pages").select(F.col("url").alias("name"))).withColumn("slug", N.slug("name"))


SQL_SAFE = """coalesce(nullif(substr(trim(regexp_replace(regexp_replace(regexp_replace(trim(translate(s, '\\/', '__')),
      '^\\.+|\\.+$', '', 'g'), '[\\x00-\\x1f<>:"|?*]', '_', 'g'), '\\s+', ' ', 'g')), 1, 180), ''), 'unnamed') AS flat,
    coalesce(nullif(substr(regexp_replace(regexp_replace(trim(split_part(replace(s, '\\', '/'), '/', -1)),
      '[^A-Za-z0-9._@+\\-]', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 1, 120), ''), 'member') AS package,
    CASE WHEN regexp_matches(x, '(?i)^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9]) *(\\..*)?$') THEN '_' || x ELSE x END AS export"""


@query("c3_safe_component", f"""WITH names AS (SELECT url AS s FROM pages UNION ALL SELECT c_name || ' / ' || c_mktsegment FROM customer
    UNION ALL SELECT 'com' || p_size || '.' || p_name FROM part UNION ALL SELECT '..' || o_orderpriority || ':  ' || o_orderkey FROM orders),
  prepared AS (SELECT s, coalesce(nullif(regexp_replace(regexp_replace(substr(s, 1, 96),
      '[\\x00-\\x1f\\x7f\\s<>:"/\\\\|?*_]+', '_', 'g'), '^[._ ]+|[._ ]+$', '', 'g'), ''), 'texture') AS x FROM names)
  SELECT md5(s) AS id, {SQL_SAFE} FROM prepared""")
def safe_component(spark, sf):
    names = table(spark, sf, "pages").select(F.col("url").alias("s")).unionByName(
        table(spark, sf, "customer").select(F.concat("c_name", F.lit(" / "), "c_mktsegment").alias("s"))).unionByName(
        table(spark, sf, "orders").select(F.concat(
            F.lit(".."), "o_orderpriority", F.lit(":  "), F.col("o_orderkey").cast("string")).alias("s"))).unionByName(
        table(spark, sf, "part").select(F.concat(
            F.lit("com"), F.col("p_size").cast("string"), F.lit("."), "p_name").alias("s")))
    return names.select(F.md5("s").alias("id"), N.safe_flat("s").alias("flat"),
                        N.safe_package("s", "member").alias("package"), N.safe_export("s").alias("export"))


SQL_ASSET_NAME = ("'tex1_' || width || 'x' || height || '_' || candidate_hash || '_' || format || '_mip' || mip || '.png'")


@query("c4_parse_asset_name", f"""WITH {A.SQL_ASSETS}, named AS (
    SELECT doc_id, width, height, format, candidate_hash,
      CASE WHEN format = 5 THEN source || '.png' ELSE {SQL_ASSET_NAME} END AS name FROM assets)
  SELECT doc_id, name, CASE WHEN format <> 5 THEN width END AS width, CASE WHEN format <> 5 THEN height END AS height,
    CASE WHEN format <> 5 THEN candidate_hash END AS hash, CASE WHEN format <> 5 THEN format END AS format,
    CASE WHEN format <> 5 THEN 0 END AS mip FROM named""")
def parse_asset_name(spark, sf):
    a = A.slim_assets(spark, sf).select("doc_id", F.when(F.col("format") == 5, F.concat("source", F.lit(".png"))).otherwise(
        N.format_asset_name("width", "height", "candidate_hash", "format", "mip")).alias("name"))
    return a.withColumn("p", N.parse_asset_name("name")).select("doc_id", "name", "p.*")


@query("c5_format_asset_name", f"""WITH {A.SQL_ASSETS} SELECT doc_id, {SQL_ASSET_NAME} AS canonical,
    source || '__' || width || 'x' || height || '_f' || format || '_' || candidate_hash || '.png' AS exported FROM assets""")
def format_asset_name(spark, sf):
    return A.slim_assets(spark, sf).select(
        "doc_id", N.format_asset_name("width", "height", "candidate_hash", "format", "mip").alias("canonical"),
        N.export_name("source", "width", "height", "format", "candidate_hash").alias("exported"))


@query("c6_normalize_hash", """SELECT doc_id, CASE WHEN 1 + n_chars % 20 <= 16 THEN
    lpad(upper(substr(sha256(text), 1, CAST(1 + n_chars % 20 AS INTEGER))), 16, '0') END AS hash FROM documents
  UNION ALL SELECT -1 - page_id, NULL FROM pages""")
def normalize_hash(spark, sf):
    raw = table(spark, sf, "documents").selectExpr(
        "doc_id", "substring(sha2(text, 256), 1, cast(1 + n_chars % 20 as int)) AS h").unionByName(
        table(spark, sf, "pages").selectExpr("-1 - page_id AS doc_id", "url AS h"))
    return raw.select("doc_id", H.normalize_hash("h").alias("hash"))


@query("c7_content_identity", "SELECT doc_id, sha256(text) AS direct, sha256(reverse(text)) AS mirrored FROM documents")
def content_identity(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", H.direct_digest("text").alias("direct"), H.mirrored_digest("text").alias("mirrored"))


@query("c8_target_scale", f"""WITH {A.SQL_ASSETS} SELECT doc_id, category, CASE
    WHEN category IN ('characters', 'backgrounds') THEN 4
    WHEN category IN ('monsters', 'ui', 'icons', 'maps') THEN CASE WHEN greatest(width, height) <= 512 THEN 4 ELSE 2 END
    WHEN category IN ('dungeon', 'effects', 'fonts') THEN CASE WHEN greatest(width, height) >= 256 THEN 2 ELSE 4 END
    WHEN greatest(width, height) >= 512 THEN 2 ELSE 4 END AS scale FROM assets""")
def target_scale(spark, sf):
    return A.slim_assets(spark, sf).withColumn("category", N.categorize("text")).select(
        "doc_id", "category", D.target_scale("category", "width", "height").alias("scale"))


SQL_BITS = "CASE f " + " ".join(f"WHEN {f[0]} THEN {f[2]}" for f in V.FORMATS) + " END"


@query("c9_storage_size", f"""WITH p AS (SELECT p_partkey, p_size * 97 AS w, p_size * 13 AS h,
    CAST(p_partkey % 15 AS INTEGER) AS f FROM part)
  SELECT p_partkey, (w + 7) // 8 * 8 AS storage_w, (h + 7) // 8 * 8 AS storage_h,
    CASE WHEN w BETWEEN 1 AND 4096 AND h BETWEEN 1 AND 4096 THEN
      CAST((w + 7) // 8 * 8 AS BIGINT) * ((h + 7) // 8 * 8) * {SQL_BITS} // 8 END AS bytes FROM p""")
def storage_size(spark, sf):
    p = table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") * 97).alias("w"), (F.col("p_size") * 13).alias("h"),
        (F.col("p_partkey") % 15).cast("int").alias("f"))
    return p.select("p_partkey", D.storage_side("w").alias("storage_w"), D.storage_side("h").alias("storage_h"),
                    D.encoded_size("w", "h", "f").alias("bytes"))


@query("c10_stores_alpha", f"SELECT p_partkey, p_partkey % 15 IN ({A.ALPHA_IDS}) AS alpha FROM part")
def stores_alpha(spark, sf):
    return table(spark, sf, "part").select("p_partkey", D.stores_alpha(F.col("p_partkey") % 15).alias("alpha"))


@query("c11_magic_label", """SELECT page_id, regexp_replace(substr(html, 1, 4), '[^ -~]', '.', 'g') AS magic FROM pages
  UNION ALL SELECT -1 - doc_id, regexp_replace(substr(text, 1, 4), '[^ -~]', '.', 'g') FROM documents""")
def magic_label(spark, sf):
    return table(spark, sf, "pages").select("page_id", C.magic_label("html", False).alias("magic")).unionByName(
        table(spark, sf, "documents").select((-1 - F.col("doc_id")).alias("page_id"),
                                             C.magic_label("text", False).alias("magic")))


@query("c12_guess_suffix", f"""WITH {A.SQL_FILES} SELECT path,
    CASE WHEN contains(content, '***') THEN '.table' WHEN starts_with(content, '<!DO') THEN '.doc'
      WHEN starts_with(content, '<htm') THEN '.htm' ELSE '.bin' END AS flat,
    CASE WHEN starts_with(content, '<htm') THEN '.htm'
      WHEN s <> '' AND length(s) <= 12 THEN s ELSE '.bin' END AS package
  FROM (SELECT *, lower(regexp_extract({A.sql_leaf('path')}, '(?s)^.+(\\.[^.]+)$', 1)) AS s FROM files)""")
def guess_suffix(spark, sf):
    return A.files(spark, sf).select(
        "path",
        C.guess_suffix_flat("content", [("<!DO", ".doc"), ("<htm", ".htm")], "***", ".table", False).alias("flat"),
        C.guess_suffix_package("content", "path", [("<htm", ".htm")], False).alias("package"))


SQL_MEMBER = f"""{A.SQL_FILES}, m AS (SELECT page_id, content, CASE WHEN length > 4000 THEN path END AS name FROM files),
    n AS (SELECT *, CASE WHEN contains(content, '***') THEN '.table' WHEN starts_with(content, '<!DO') THEN '.doc' ELSE '.bin' END AS flat_suffix,
      regexp_replace(translate(name, '/', '_'), '[<>:"|?*]', '_', 'g') AS flat_name,
      coalesce(nullif(regexp_replace(regexp_replace({A.sql_leaf("coalesce(name, '')")}, '[^A-Za-z0-9._@+\\-]', '_', 'g'), '^[._]+|[._]+$', '', 'g'), ''),
        printf('member_%04d', page_id)) AS base FROM m),
    o AS (SELECT *, lower(regexp_extract(base, '(?s)^.+(\\.[^.]+)$', 1)) AS own FROM n)"""


@query("c12_member_name", f"""WITH {SQL_MEMBER} SELECT page_id,
    CASE WHEN name IS NULL THEN printf('hash_00000000_%05d', page_id) || flat_suffix
      WHEN regexp_matches(flat_name, '\\.[^.]+$') THEN flat_name ELSE flat_name || flat_suffix END AS flat,
    printf('%04d_', page_id) || base || CASE WHEN own <> '' AND length(own) <= 12 THEN '' ELSE '.bin' END AS package FROM o""")
def member_name(spark, sf):
    m = A.files(spark, sf).select("page_id", "content", F.when(F.col("length") > 4000, F.col("path")).alias("name"))
    flat = C.guess_suffix_flat("content", [("<!DO", ".doc")], "***", ".table", False)
    return m.select("page_id", N.member_name_flat("page_id", "name", flat).alias("flat"), N.member_name_package(
        "page_id", "name", lambda base: C.guess_suffix_package("content", base, [("<htm", ".htm")], False)).alias("package"))


@query("c13_display_seed", f"""WITH p AS (SELECT p_partkey, p_name,
      CASE WHEN p_size < 25 THEN split_part(p_name, ' ', 1) || '_mdl' ELSE '' END AS model,
      CASE WHEN p_size % 3 = 0 THEN p_name || '_mask' WHEN p_size % 3 = 1 THEN split_part(p_name, ' ', 1) || '_tex01'
        ELSE '' END AS name FROM part),
    q AS (SELECT *, {A.sql_slug('name')} AS t, {A.sql_slug('model')} AS full_root,
      regexp_replace({A.sql_slug('model')}, '-(a|b|model|mdl)$', '') AS short_root,
      coalesce(nullif(name, ''), nullif(model, ''), nullif({A.sql_stem("'src/' || p_name || '.stex'")}, '')) AS raw FROM p),
    r AS (SELECT *, name <> '' AND model <> '' AS paired, {A.sql_slug('raw')} AS seed FROM q),
    s AS (SELECT p_partkey, CASE
      WHEN paired AND (t = full_root OR regexp_full_match(t, full_root || '{V.GENERIC_TEXTURE_TAIL}')) THEN full_root
      WHEN paired AND short_root <> '' AND (t = short_root OR regexp_full_match(t, short_root || '{V.GENERIC_TEXTURE_TAIL}'))
        THEN short_root ELSE seed END AS seed FROM r)
  SELECT p_partkey, regexp_replace(seed, '-(mask|opacity|transparency|trans)$', '-alpha') AS seed FROM s""")
def display_seed(spark, sf):
    first = F.substring_index("p_name", " ", 1)
    p = table(spark, sf, "part").select(
        "p_partkey", F.when(F.col("p_size") < 25, F.concat(first, F.lit("_mdl"))).otherwise("").alias("model"),
        F.when(F.col("p_size") % 3 == 0, F.concat("p_name", F.lit("_mask")))
        .when(F.col("p_size") % 3 == 1, F.concat(first, F.lit("_tex01"))).otherwise("").alias("name"),
        F.concat(F.lit("src/"), "p_name", F.lit(".stex")).alias("source"),
        F.col("p_partkey").cast("string").alias("id"))
    return p.select("p_partkey", N.display_seed("name", "model", "source", "id").alias("seed"))


@query("c14_aux_mask", """WITH uses AS (SELECT conv_id, turn, role,
    CASE WHEN length(text) % 3 = 0 THEN 'Alpha' WHEN length(text) % 3 = 1 THEN 'Red' ELSE 'Constant' END AS operand,
    CASE WHEN role = 'system' THEN 'ui_mask.' || conv_id ELSE role || conv_id END AS name FROM conversations)
  SELECT conv_id, bool_or(role = 'system' OR (turn > 0 AND operand IN ('Alpha', 'Red'))) AS aux FROM uses GROUP BY 1""")
def aux_mask(spark, sf):
    n, conv = F.length("text") % 3, F.col("conv_id").cast("string")
    uses = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.when(n == 0, "Alpha").when(n == 1, "Red").otherwise("Constant").alias("operand"),
        F.when(F.col("role") == "system", F.concat(F.lit("ui_mask."), conv)).otherwise(F.concat("role", conv)).alias("name"))
    return uses.groupBy("conv_id").agg(F.bool_or(N.is_aux_mask("name", "turn", "operand")).alias("aux"))


@query("c15_path_helpers", f"""WITH {A.SQL_FILES} SELECT path, lower(path) AS path_key, ext,
    regexp_replace(path, '\\.[^.]*$', '') || '.hpb' AS partner,
    CASE WHEN NOT regexp_matches(path, '(^|/)(\\.{{1,2}})?(/|$)|[ .](/|$)|:') THEN 'root/' || path END AS child FROM files""")
def path_helpers(spark, sf):
    return A.files(spark, sf).select(
        "path", P.path_key("path").alias("path_key"), "ext", P.replace_extension("path", "hpb").alias("partner"),
        P.child_path(F.lit("root/"), "path").alias("child"))


@query("c16_render_list", """WITH names AS (SELECT DISTINCT p_brand, p_name FROM part),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_name) AS n, count(*) OVER (PARTITION BY p_brand) AS total
      FROM names)
  SELECT p_brand, any_value(total) || ' part reference(s) listed: ' ||
    string_agg(p_name, ', ' ORDER BY p_name) FILTER (n <= 20) ||
    CASE WHEN any_value(total) > 20 THEN ', ... (+' || (any_value(total) - 20) || ' more)' ELSE '' END AS message
  FROM ranked GROUP BY 1""")
def render_list(spark, sf):
    names = table(spark, sf, "part").select("p_brand", "p_name").distinct()
    total = names.groupBy("p_brand").agg(F.count("*").alias("total"))
    shown = top_per_group(names, ["p_brand"], ["p_name"], V.REFERENCE_DISPLAY_LIMIT).groupBy("p_brand").agg(
        F.array_sort(F.collect_list("p_name")).alias("shown"))
    return total.join(shown, "p_brand").select(
        "p_brand", N.render_names("shown", "total", "part", "listed").alias("message"))


@query("c17_token_offsets", """WITH parts AS (SELECT page_id, string_split(html, '<p>') AS s FROM pages),
    hits AS (SELECT page_id, s, unnest(range(1, least(len(s), 17))) AS i FROM parts)
  SELECT page_id, i - 1 AS pos, CAST(list_sum(list_transform(s[1:i], lambda x: length(x))) + (i - 1) * 3 AS BIGINT) AS at FROM hits""")
def token_offsets(spark, sf):
    return table(spark, sf, "pages").select(
        "page_id", F.posexplode(C.token_offsets("html", "<p>", V.TOKEN_LIMIT_WIDE)).alias("pos", "at"))


SQL_DESCRIPTOR = """'{"candidate_hash":"' || candidate_hash || '","category":"' || category || '","format":' || format ||
  ',"height":' || height || ',"material_binding_count":' || material_binding_count || ',"mip":0,"parser_used":"' || parser_used ||
  '","verified_hashes":[' || CASE WHEN len(verified_hashes) > 0 THEN '"' || verified_hashes[1] || '"' ELSE '' END ||
  '],"width":' || width || '}'"""


@query("c18_descriptor", f"WITH {A.SQL_ASSETS} SELECT doc_id, {SQL_DESCRIPTOR} AS descriptor FROM assets")
def descriptors(spark, sf):
    a = A.assets(spark, sf)
    return a.select("doc_id", descriptor(a).alias("descriptor"))


@query("c19_source_group", """SELECT doc_id, source || '-' || substr(sha1(source || '|' || n_chars), 1, 10) AS source_group
  FROM documents""")
def source_group(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", H.source_group("source", "source", "n_chars").alias("source_group"))


@query("c20_source_kind", """SELECT doc_id, CASE source WHEN 'src0' THEN 'texture' WHEN 'src1' THEN 'model' ELSE 'other' END
  AS kind FROM documents""")
def source_kind(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", H.source_kind("source", {"src0": "texture", "src1": "model"}, "other").alias("kind"))


@query("c21_binding_key", """SELECT l_orderkey, count(DISTINCT l_orderkey || '|' || l_linenumber || '|' || l_partkey || '|' ||
    (l_returnflag = 'N')) AS bindings FROM lineitem GROUP BY 1""")
def binding_key(spark, sf):
    return A.bindings(spark, sf).select(
        "l_orderkey", H.binding_key("l_orderkey", "l_linenumber", "l_partkey", "enabled").alias("key")
    ).groupBy("l_orderkey").agg(F.count_distinct("key").alias("bindings"))


@query("c22_levels", """WITH p AS (SELECT p_partkey, p_size * 97 AS w, p_size * 13 AS h, length(bin(p_size * 97)) AS n FROM part)
  SELECT p_partkey, i AS level, greatest(1, w >> i) AS level_w, greatest(1, h >> i) AS level_h
  FROM (SELECT *, CAST(unnest(range(0, n)) AS INTEGER) AS i FROM p)""")
def levels(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 97).alias("w"), (F.col("p_size") * 13).alias("h"))
    lv = p.withColumn("level", F.explode(F.sequence(F.lit(0), D.max_levels("w", "h") - 1)))
    return lv.select("p_partkey", "level", D.level_extent("w", F.col("level")).alias("level_w"),
                     D.level_extent("h", F.col("level")).alias("level_h"))
