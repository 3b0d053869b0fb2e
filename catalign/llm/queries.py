"""The queries of the operators, each over its whole table, with SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import (exact_dedup, html_extract, language_id, mixing, near_dup, packing, periodic, quality, secret_scan, spelling, token_counts,
               token_files, urls)
from .common import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_token_counts")
def tokens(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op2_exact_dedup", """SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
    doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
  FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def exact(spark, sf):
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


SQL_MIX = r"""sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
      md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM documents),
  src AS (SELECT source, sum(size) AS s, [1, 2, 3][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS w
    FROM sized GROUP BY source),
  ordered AS (SELECT *, row_number() OVER (ORDER BY 3.0 * s / w, source NULLS LAST) AS k, sum(s) OVER () AS t,
    sum(w) OVER () AS all_w FROM src),
  levels AS (SELECT *, (t - coalesce(sum(3 * s) OVER before, 0)) / (all_w - coalesce(sum(w) OVER before, 0)) AS level
    FROM ordered WINDOW before AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  water AS (SELECT coalesce((SELECT level FROM levels WHERE 3 * s > level * w ORDER BY k LIMIT 1), 0) AS level),
  targets AS (SELECT source, CAST(s AS BIGINT) AS source_size, least(CAST(3 * s AS DOUBLE), (SELECT level FROM water) * w) AS target FROM src),
  goals AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    target - whole * source_size AS goal FROM targets),
  runs AS (SELECT z.*, g.source_size, g.target, g.whole, g.goal, sum(z.size) OVER (PARTITION BY z.source ORDER BY place) AS upto
    FROM sized z JOIN goals g ON z.source IS NOT DISTINCT FROM g.source),
  near AS (SELECT source, min(struct_pack(off := abs(upto - goal), upto := upto)) AS best, any_value(goal) AS goal FROM runs GROUP BY source)"""


@query("op3_mixing", f"""WITH {SQL_MIX}
  SELECT doc_id, size, r.source_size, r.target,
    CAST(size * (whole + CASE WHEN n.best.off < n.goal AND upto <= n.best.upto THEN 1 ELSE 0 END) AS BIGINT) AS taken
  FROM runs r JOIN near n ON r.source IS NOT DISTINCT FROM n.source""")
def mixed(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).drop("copies")


@query("op4_secret_scan")
def secrets(spark, sf):
    kinds = [k for k, *_ in secret_scan.KINDS]
    found = secret_scan.scan_secrets(table(spark, sf, "documents"))
    return found.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in kinds],
        F.sha2(secret_scan.listed(kinds), 256).alias("base_sha256"), secret_scan.listed([*kinds, "entropy"]).alias("spans"))


@query("op5_language_id")
def languages(spark, sf):
    docs = table(spark, sf, "documents")
    known = language_id.fit(docs.filter(~language_id.is_held_out("doc_id")))
    return language_id.identify(docs, known).withColumn("held_out", language_id.is_held_out("doc_id")).select(
        "doc_id", "held_out", "lang_pred", "score", "share")


@query("op6_near_dup")
def near_duplicates(spark, sf):
    return near_dup.near_classes(table(spark, sf, "documents"))


@query("op7_best_fit_packing")
def packed(spark, sf):
    return packing.pack(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_url_filter", r"""WITH rules(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
    ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
  cut AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
  urls AS (SELECT DISTINCT host, path FROM p),
  won AS (SELECT u.host, u.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY u.host, u.path
      ORDER BY length(r.host || r.path) DESC, length(r.host) DESC, r.verdict DESC) AS n
    FROM urls u JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path))
  SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') AS verdict
  FROM p LEFT JOIN won w ON p.host = w.host AND p.path = w.path AND n = 1""")
def url_filter(spark, sf):
    return urls.filter_urls(table(spark, sf, "pages"), urls.rule_table(spark))


@query("op9_html_extract")
def main_texts(spark, sf):
    return html_extract.extract_pages(table(spark, sf, "pages"))


@query("op10_quality_rules")
def rules(spark, sf):
    return quality.quality_rules(table(spark, sf, "documents"))


def with_periods(docs):
    """Documents of which, by a checksum of the id, one in ten repeats a stretch of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.expr(
        r"regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+', 0)")).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    placed = words.withColumn("n", n).withColumn("a", F.when(n > 0, g % n)).withColumn(
        "p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + g % 8)))
    return placed.select("doc_id", F.expr("""CASE WHEN p IS NULL THEN text ELSE concat_ws(' ', transform(sequence(0L, n - 1L),
        i -> words[int(if(i < a, i, a + (i - a) % p))])) END""").alias("text"))


@query("op11_periodic_runs")
def periodic_runs(spark, sf):
    found = periodic.find_runs(with_periods(table(spark, sf, "documents")))
    # Of runs with the same exponent the first in the list stays.
    best = F.expr("""aggregate(runs, CAST(NULL AS struct<start: bigint, length: bigint, period: bigint>),
        (b, r) -> CASE WHEN b IS NULL OR r.length * b.period > b.length * r.period THEN r ELSE b END)""")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op12_spelling_variants")
def spelling_variants(spark, sf):
    return spelling.variants(spelling.count_words(table(spark, sf, "documents"), change=spelling.drop_letter))


@query("op13_token_files")
def token_ids(spark, sf):
    docs = table(spark, sf, "documents")
    return token_files.read(spark, token_files.write(docs, public_tokenizers.path("word_bpe_49k.json"), closing_id=1))
