"""URL filters: host suffixes and path prefixes, joined on short hash prefixes, confirmed by whole digests.

Each URL is expanded into the expressions host suffix + path prefix that a rule
could have: suffixes at label boundaries with as many labels as some rule, path
prefixes as long as some rule's path. Expressions meet rules on the first eight
hex digits of their digest; the whole digest confirms. Of the rules that fit, the
longest wins, then the longest host, then block before allow.

Edge cases: a null URL, or one without ``://``, has an empty host and path, fits
no rule and gets the default verdict. Rules with a null field are left out; a
rule given twice counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut

#: The rules of the query, as (verdict, host, path).
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
#: Hex digits of a digest that meet first.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host in lower case, and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, path), 256)


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The winning rule of each distinct (host, path) that has one: host, path, rule, verdict."""
    rules = cut(rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("verdict").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), "verdict").distinct())
    # How many labels and how long a path rules have: a few numbers, bounded by the longest rule.
    labels = [r[0] for r in rules.select(F.size(F.split("r_host", r"\.", -1))).distinct().collect()]
    lengths = [r[0] for r in rules.select(F.length("r_path")).distinct().collect()]
    if not labels:
        return urls.select("host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict")).limit(0)
    parts = F.split("host", r"\.", -1)
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(labels)]), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in sorted(lengths)]), lambda n: n <= F.length("path")),
        lambda n: F.substring(F.col("path"), F.lit(1), n))
    seen = urls.select("host", "path").distinct()
    expressions = (seen.select("host", "path", F.explode(suffixes).alias("suffix"))
                   .select("host", "path", "suffix", F.explode(prefixes).alias("prefix"))
                   .withColumn("digest", digest(F.col("suffix"), F.col("prefix"))))
    # All rules that share a prefix are one row; with 32 bits these are a few rules, whatever their number in all.
    whole = digest(F.col("r_host"), F.col("r_path"))
    listed = rules.groupBy(F.substring(whole, 1, PREFIX).alias("prefix_key")).agg(
        F.collect_list(F.struct(whole.alias("digest"), "r_host", "r_path", "verdict")).alias("listed"))
    met = expressions.withColumn("prefix_key", F.substring("digest", 1, PREFIX)).join(listed, "prefix_key")
    fits = met.select("host", "path", F.inline(F.filter("listed", lambda r: r["digest"] == F.col("digest"))))
    rank = F.struct((F.length("r_host") + F.length("r_path")).alias("n"), F.length("r_host").alias("h"),
                    (F.col("verdict") == "block").alias("b"), F.concat("r_host", "r_path").alias("rule"), "verdict")
    return fits.groupBy("host", "path").agg(F.max(rank).alias("w")).select("host", "path", "w.rule", "w.verdict")


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = split_url(pages[url_col].cast("string"))
    urls = pages.select(pages[id_col].alias("page_id"), host.alias("host"), path.alias("path"))
    won = match_rules(urls.filter(F.col("host") != ""), rules)
    return urls.join(won, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def rule_table(spark, rules=RULES) -> DataFrame:
    """Rules as a table of literals, at least one."""
    fields = ("verdict", "host", "path")
    rows = [F.struct(*[F.lit(v).alias(f) for f, v in zip(fields, rule)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))
