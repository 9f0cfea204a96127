"""Operator 2, URL filters: host-suffix and path-prefix expressions against hashed rules.

Every distinct URL is expanded into the expressions ``host suffix + path
prefix``; rules and expressions meet by an equi-join on a short hash prefix, and
a hit counts when the full digests agree and the path starts with the rule's
path. The longest rule wins. DataFrame functions only.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortspark.llm.registry import register
from cohortspark.llm.tables import table

PREFIX_DIGITS = 8  # hex digits of the short hash: 4 bytes
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"),
         ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(F.coalesce(found, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.split(host, r"\.", -1)


def _steps(path: Column) -> Column:
    """The path's prefixes that end in a slash, and the empty one."""
    return F.size(F.split(path, "/", -1)) - 1


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``rec`` (the whole row of ``pages``), host, path, rule and verdict, one row per row.

    ``rules`` has host, path and verdict. A rule fits its host and all its
    subdomains when the URL's path starts with the rule's path; the longest
    rule (host and path) wins, then the longer host, then block. Rules with a
    NULL or an empty host are dropped, a NULL path counts as empty, repeated
    rules count once. A NULL URL or one without ``://`` has an empty host and
    path, fits no rule and gets ``default``, as does an empty table's absence
    of rows. Other columns of ``pages`` stay inside ``rec`` and cannot clash.

    Hot URLs: only distinct URLs are expanded (aggregated before the shuffle).
    How far a URL is expanded is bounded by the deepest host and path among the
    rules, one aggregated row; deeper expressions cannot meet a rule, so
    nothing is lost. Spark broadcasts the rules only when they are small.
    """
    clean = (rules.where(F.col("host") != "")
             .select(lower_ascii(F.col("host")).alias("r_host"),
                     F.coalesce("path", F.lit("")).alias("r_path"), F.col("verdict").alias("r_verdict"))
             .groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict")))
    # a rule's path is met at its last slash; the rest of it is compared afterwards
    anchor = F.concat("r_host", F.regexp_extract("r_path", "(?s)^(.*/)?", 1))
    depth = clean.agg(
        F.max(F.size(_labels(F.col("r_host")))), F.max(_steps(F.col("r_path")))).first()
    most_labels, most_steps = depth[0] or 0, depth[1] or 0
    clean = clean.select("r_host", "r_path", "r_verdict", F.sha2(anchor, 256).alias("r_digest"))
    clean = clean.withColumn("r_short", F.substring("r_digest", 1, PREFIX_DIGITS))

    asked = pages.select(F.col(url).alias("u")).where(F.col("u").isNotNull()).distinct()
    asked = asked.select("u", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"))
    hosts = F.transform(
        F.sequence(F.lit(1), F.least(F.size("l"), F.lit(max(1, most_labels)))),
        lambda n: F.array_join(F.slice("l", F.size("l") - n + 1, n), "."))
    paths = F.transform(
        F.sequence(F.lit(0), F.least(F.size("s") - 1, F.lit(most_steps))),
        lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice("s", F.lit(1), n), "/"), F.lit("/"))))
    cases = (asked.where("host <> ''")
             .select("u", "path", _labels(F.col("host")).alias("l"), F.split("path", "/", -1).alias("s"))
             .select("u", "path", hosts.alias("hs"), paths.alias("ps"))
             .select("u", "path", F.explode("hs").alias("h"), "ps")
             .select("u", "path", "h", F.explode("ps").alias("p"))
             .select("u", "path", F.sha2(F.concat("h", "p"), 256).alias("digest")))
    hits = cases.join(clean, F.substring("digest", 1, PREFIX_DIGITS) == F.col("r_short")).where(
        (F.col("digest") == F.col("r_digest")) & F.startswith("path", F.col("r_path")))
    rule = F.concat("r_host", "r_path")
    best = hits.groupBy("u").agg(F.max(F.struct(
        F.length(rule).alias("n"), F.length("r_host").alias("m"), F.col("r_verdict").alias("verdict"),
        rule.alias("rule"))).alias("best"))
    rows = pages.select(F.struct("*").alias("rec"), F.col(url).alias("v"))
    return rows.join(best, F.col("v") == F.col("u"), "left").select(
        "rec", host_of(F.col("v")).alias("host"), path_of(F.col("v")).alias("path"),
        F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """The rows of ``pages`` whose verdict is allow, with their own columns."""
    return judge(pages, rules, url).where("verdict = 'allow'").select("rec.*")


SQL = r"""
WITH rules(rh, rp, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                                 ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
p AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
              'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages)
SELECT page_id, host, path, arg_max(rh || rp, length(rh || rp)) AS rule,
       coalesce(arg_max(v, length(rh || rp)), 'allow') AS verdict
FROM p LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
GROUP BY page_id, host, path
"""


@register("op2_url_filter", SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(map(str, RULES)) + " AS r(host, path, verdict)")
    pages = table(spark, folder, "pages").select("page_id", "url")
    return judge(pages, rules).select(F.col("rec.page_id").alias("page_id"), "host", "path", "rule", "verdict")
