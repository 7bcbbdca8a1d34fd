"""URL filters: allow and block rules on hosts and paths, matched as hashed expressions (DataFrame functions only).

Each url becomes the expressions (host suffix, path prefix) that a rule could have; they meet the rules in an equi-join on a short
prefix of the expression's SHA-256, the full digest confirms the match, and the longest confirmed rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, written

#: Hexadecimal digits of the digest on which urls and rules are joined.
PREFIX_DIGITS = 8
SALTS = 8


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def url_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, action): one row for each (host, path), the digest added. Of contradicting rules for one (host, path) block stands."""
    kept = rules.where("host IS NOT NULL AND path IS NOT NULL AND action IS NOT NULL").groupBy("host", "path").agg(F.max("action").alias("action"))
    full = _digest(F.col("host"), F.col("path"))
    return kept.select(F.concat("host", "path").alias("rule"), "action", F.length("host").alias("_host_length"), F.length("path").alias("_path_length"), full.alias("_digest"), F.substring(full, 1, PREFIX_DIGITS).alias("_short"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """pages with host, path, rule and verdict added (columns of these names are replaced).

    A rule (host, path, action) fits its host and all subdomains if the url's path starts with the rule's; the longest host + path wins
    (of equally long ones the longer host, then the rule text). Without a fitting rule: rule null, verdict `default`. A null url, or one
    without ://, has an empty host and path and no rule. Repeated rows stay repeated; an empty table gives no rows.

    Expressions: a suffix for each label of the host, a prefix for each length that rule paths have. They are made once for each distinct
    (host, start of the path as long as the longest rule path), so that a hot host is few rows; what the join with the rules leaves, the best
    rule of each, meets the pages by (host, start)."""
    hashed = written(url_rules(rules))
    lengths = hashed.agg(F.sort_array(F.collect_set("_path_length")).alias("_lengths"))  # one row, as many entries as a path is long at most
    lengths = [r["_lengths"] for r in lengths.collect()][0] or []
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": url_host(F.col(url_col)), "path": url_path(F.col(url_col))})
    start = F.substring("path", 1, max(lengths, default=0))
    # every (host, start of the path) once: the expressions of a url follow from it
    places = rows.where("host != ''").select("host", start.alias("_start")).distinct()
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("_start") >= n, F.substring("_start", 1, n)) for n in lengths)).cast("array<string>"), lambda p: p.isNotNull())
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p))))
    asked = places.select("host", "_start", F.explode(digests).alias("_asked")).withColumn("_short", F.substring("_asked", 1, PREFIX_DIGITS))
    # each rule stands in SALTS rows, so that an expression that very many hosts ask for goes to as many tasks
    salted = hashed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    met = asked.withColumn("_salt", F.pmod(F.xxhash64("host", "_start"), F.lit(SALTS)).cast("int")).join(salted, ["_short", "_salt"]).where(F.col("_asked") == F.col("_digest"))
    rank = F.struct((F.col("_host_length") + F.col("_path_length")).alias("n"), F.col("_host_length").alias("h"), F.col("rule").alias("rule"), F.col("action").alias("action"))
    best = written(met.groupBy("host", "_start").agg(F.max(rank).alias("_best")))
    # a page without host asks for nothing: its key is a digest that no host can be, so that such pages don't meet in one task
    kept = [c for c in rows.columns if c not in ("host", "path")]
    digest = F.xxhash64(*(F.col(f"`{c}`") for c in kept if "map<" not in rows.schema[c].dataType.simpleString()))
    nowhere = F.concat(F.lit("/"), digest.cast("string"))
    named, salt, asked_host, asked_start, told_best = fresh(rows, "_named", "_salt", "_asked_host", "_asked_start", "_best")
    rows = rows.withColumn(named, F.when(F.col("host") == "", nowhere).otherwise(F.col("host")))
    rows = rows.withColumn(salt, F.pmod(digest, F.lit(SALTS)).cast("int"))
    # a hot host's pages are spread over SALTS keys; the table of verdicts, one row for each place, stands in as many rows
    told = best.select(F.col("host").alias(asked_host), F.col("_start").alias(asked_start), F.col("_best").alias(told_best), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt))
    told = told.withColumnRenamed(salt, salt + "_")
    met_by = (F.col(named) == F.col(asked_host)) & (start == F.col(asked_start)) & (F.col(salt) == F.col(salt + "_"))
    out = rows.join(told, met_by, "left")
    return out.select(*kept, "host", "path", F.col(told_best)["rule"].alias("rule"), F.coalesce(F.col(told_best)["action"], F.lit(default)).alias("verdict"))


#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP1_SQL = r"""
WITH rules(host, path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT row_number() OVER () AS k, page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
m AS (
  SELECT p.k, r.host || r.path AS rule, r.action, row_number() OVER (PARTITION BY p.k ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC, r.host || r.path DESC) AS n
  FROM p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path))
SELECT p.page_id, p.host, p.path, m.rule, coalesce(m.action, 'allow') AS verdict FROM p LEFT JOIN m ON p.k = m.k AND m.n = 1
"""
