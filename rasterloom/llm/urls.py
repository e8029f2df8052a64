"""URL filters by host-suffix and path-prefix expressions.

Every distinct URL is expanded to the expressions host suffix x path prefix, prefixes at the lengths
that rules have. Expressions meet rules in an equi-join on the first four bytes of their SHA-256, the
whole digest confirms a hit, and the longest rule wins (host and path together, then the longer host,
then block before allow). The join is left to Catalyst: a small rule table is broadcast under its
checked size, a large one is shuffled, and URLs enter it once each however often they occur.

Defined results: a null URL or one without ``://`` has empty host and path, which no rule fits;
repeated pages are judged alike; an empty rule table leaves every verdict to ``default``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path) of the standing rules.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
RULE_SCHEMA = "verdict string, host string, path string"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def standing_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RULES), RULE_SCHEMA)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (ASCII letters lower-cased) and path of a URL, by its first ``://``."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.substring(url, at + 3, F.char_length(url))
    host = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "?", 1), "#", 1)
    path = F.substring_index(F.substring_index(F.substring(rest, F.char_length(host) + 1, F.char_length(url)), "?", 1), "#", 1)
    none = F.lit("")
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise(none), F.when(at > 0, path).otherwise(none)


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Array of (host suffix, path prefix); prefixes have the given lengths."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.char_length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(s.alias("host"), p.alias("path")))))


def _digest(host: str, path: str) -> Column:
    return F.sha2(F.concat(F.col(host), F.lit("\x00"), F.col(path)), 256)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, url, host, path, rule (host and path of the winning rule, else null), verdict."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"))
    rules = rules.where("host is not null and path is not null and verdict is not null").select(F.col("verdict").alias("said"), F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.col("path").alias("rule_path"))
    # At most as many lengths as a path can have characters, never one a rule.
    lengths = [r[0] for r in rules.select(F.char_length("rule_path").alias("n")).distinct().orderBy("n").collect()]
    keyed = rules.withColumn("digest", _digest("rule_host", "rule_path")).withColumn("short", F.substring("digest", 1, 8))
    urls = pages.where("url is not null").groupBy("url").agg(F.count("*").alias("seen"))
    host, path = split_url(F.col("url"))
    urls = urls.select("url", host.alias("host"), path.alias("path")).where("host <> ''")
    if not lengths:
        hits = urls.select("url").where("false").select("url", F.lit("").alias("rule"), F.lit("").alias("said"))
    else:
        wide = urls.select("url", F.explode(expressions(F.col("host"), F.col("path"), lengths)).alias("e")).select("url", "e.host", "e.path")
        wide = wide.withColumn("digest_of", _digest("host", "path")).select("url", "digest_of", F.substring("digest_of", 1, 8).alias("short"))
        met = wide.join(keyed, "short").where("digest_of = digest")
        order = F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), F.char_length("rule_host").alias("h"), (F.col("said") == "block").alias("b"), F.concat("rule_host", "rule_path").alias("r"))
        hits = met.groupBy("url").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "said"), order).alias("w")).select("url", "w.rule", "w.said")
    host, path = split_url(F.col("url"))
    return pages.join(hits, "url", "left").select("page_id", "url", host.alias("host"), path.alias("path"), "rule", F.coalesce("said", F.lit(default)).alias("verdict"))


ORACLE = r"""
WITH p AS (SELECT page_id, url, CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN NULL ELSE substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, rest FROM p),
q AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM h),
rules(said, rh, rp) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (SELECT q.*, rules.*, row_number() OVER (PARTITION BY page_id ORDER BY length(rh) + length(rp) DESC NULLS LAST, length(rh) DESC NULLS LAST) AS k
      FROM q LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rh || rp AS rule, coalesce(said, 'allow') AS verdict FROM m WHERE k = 1
"""
