"""URL filters: rules on hosts and path prefixes, matched by short hashes of URL expressions.

Each distinct (host, path) is expanded into expressions: the host and its parent domains of as many labels as some rule's host has
at the most, each with every prefix of the path whose length some rule path has. An expression's SHA-256 joins the rules' on its first 8 hex digits; the full digest
then confirms the match, and the longest rule decides (host and path together; then the longer host; then block before
allow). Everything is a DataFrame expression.

Rules are broadcast up to `most_rules` of them; a larger rule table is joined by shuffling, with the expressions salted
`salts` ways, as one host may hold a third of all rows.

A null url, or one without "://", has an empty host and path and no rule. Where no rule fits, rule is null and the verdict is
`default`. Repeated rows stay, each with its verdict. An empty table of pages gives no verdicts, one of rules gives `default` for all. Other
columns, whatever their names, aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: About 40 MB as a broadcast table.
MOST_RULES = 200_000
SALTS = 64
PREFIX_DIGITS = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def split_url(pages: DataFrame) -> DataFrame:
    """Adds host and path."""
    rest = F.coalesce(F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": host, "path": path})


def digest_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict) with what the join needs; a rule given twice with both verdicts blocks."""
    one = rules.where("host is not null and path is not null").groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    key = F.concat("host", "path")
    digest = F.sha2(F.concat("host", F.lit("\n"), "path"), 256)
    return one.select(
        digest.substr(1, PREFIX_DIGITS).alias("short"),
        digest.alias("rule_digest"),
        F.size(F.split("host", r"\.")).alias("n_labels"),
        F.struct(F.length(key).alias("size"), F.length("host").alias("host_size"), "blocks", key.alias("rule")).alias("found"),
    )


def expressions(path_lengths: list[int], most_labels: int):
    """The (host suffix, path prefix) digests of a row's host and path, first of all a null that every row has."""
    labels = F.split("host", r"\.")
    n = F.size(labels)
    hosts = F.transform(F.sequence(F.greatest(F.lit(1), n - most_labels + 1), n), lambda k: F.array_join(F.slice(labels, k, n - k + 1), "."))
    lengths = F.filter(F.array(*(F.lit(x) for x in path_lengths)).cast("array<int>"), lambda x: x <= F.length("path"))
    paths = F.transform(lengths, lambda x: F.substring("path", F.lit(1), x))
    each = F.transform(hosts, lambda h: F.transform(paths, lambda p: F.sha2(F.concat(h, F.lit("\n"), p), 256)))
    return F.concat(F.array(F.lit(None).cast("string")), F.when(F.col("host") != "", F.flatten(each)).otherwise(F.array().cast("array<string>")))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", most_rules: int = MOST_RULES, salts: int = SALTS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages(page_id, url)."""
    rules = digest_rules(rules)
    most_labels = rules.agg(F.max("n_labels")).first()[0] or 1
    rules = rules.drop("n_labels")
    lengths = [r[0] for r in rules.select((F.col("found.size") - F.col("found.host_size")).alias("n")).distinct().orderBy("n").collect()]  # as many as path lengths
    small = rules.limit(most_rules + 1).count() <= most_rules
    # Equal rows are judged once, before anything is expanded.
    rows = split_url(pages.select("page_id", "url")).groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    wide = rows.withColumn("digest", F.explode(expressions(lengths, most_labels))).withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    if small:
        joined = wide.join(F.broadcast(rules), "short", "left")
    else:
        salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(salts)).cast("int")
        many = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = wide.withColumn("salt", salt).join(many, ["short", "salt"], "left")
    # The short hash only brings candidates: the full digest confirms them, and a row without a confirmed rule stays.
    joined = joined.withColumn("found", F.when(F.col("digest") == F.col("rule_digest"), F.col("found")))
    best = joined.groupBy("page_id", "host", "path").agg(F.max("found").alias("found"), F.max("copies").alias("copies"))
    verdict = F.when(F.col("found").isNull(), default).when(F.col("found.blocks"), "block").otherwise("allow")
    return best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.read(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "host string, path string, verdict string"))


SQL = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
r(h, s, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
numbered AS (SELECT row_number() OVER () AS k, * FROM q),
fit AS (
  SELECT k, arg_max(h || s, length(h || s)) AS rule, arg_max(v, length(h || s)) AS verdict
  FROM numbered JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, s) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN fit USING (k)
"""

QUERY = ("op2_url_filter", query, SQL)
