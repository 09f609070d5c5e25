"""URL filter rules by expansion into host suffixes and path prefixes (DataFrame functions only).

Every URL is expanded into the (host suffix, path prefix) expressions that some rule could equal. The
expressions meet the rules in an equi-join on a 4-byte prefix of their SHA-256; full digests confirm a
meeting, and the longest confirmed rule decides.

Defined results: a null URL, or one without ``://``, has an empty host and path and gets the default
verdict; an empty path meets no rule with a path; rows repeat in the result as in the input; an empty
rule table gives the default verdict to all rows. Columns of the input that clash with the operator's
own are left out of its result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (action, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

#: Rules up to this many are broadcast; a larger table is joined by shuffling on the hash prefix.
BROADCAST_RULES = 100_000


def split_url(url):
    """Columns (host, path) of a URL column: host after the first ``://`` up to ``/ ? #``, path up to ``? #``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def digest(host, path):
    # the host's length keeps (host, path) pairs with equal concatenations apart
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def rule_table(spark, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    rows = spark.createDataFrame(list(dict.fromkeys(rules)), "action string, rule_host string, rule_path string")
    rows = rows.withColumn("rule_host", F.translate("rule_host", UPPER, LOWER))
    # of equal rules with both actions the block stays
    return rows.groupBy("rule_host", "rule_path").agg(F.max("action").alias("action")).withColumn("rule_digest", digest(F.col("rule_host"), F.col("rule_path")))


def filter_urls(df: DataFrame, rules: Sequence[tuple[str, str, str]], key: str = "page_id", url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """One row for each row of `df`: key, host, path, rule (``host + path`` or null), verdict.

    A rule fits its host and the host's subdomains if the path starts with the rule's path. The longest
    rule wins: the most characters of host and path together, then the longer host, then a block.
    The host and path lengths that rules use bound the expressions of a URL, whatever its own length.
    """
    spark = df.sparkSession
    host, path = split_url(F.col("url_"))
    # a URL's verdict depends on host and path alone, so each distinct pair is judged once: a hot host with repeated
    # paths is summed up before the shuffle
    pages = df.select(F.col(key).alias("key_"), F.col(url).alias("url_")).select("key_", host.alias("host"), path.alias("path"))
    if not rules:
        return pages.select(F.col("key_").alias(key), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    lengths = sorted({len(p) for _, _, p in rules})
    table = rule_table(spark, rules).withColumn("short", F.substring("rule_digest", 1, prefix_hex))
    table = F.broadcast(table) if len(rules) <= BROADCAST_RULES else table
    suffixes = F.array_distinct(F.array(*(F.substring_index("host", ".", -n) for n in labels)))
    prefixes = F.array_distinct(F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull()))
    expressions = (
        pages.withColumn("suffix", F.explode(suffixes)).withColumn("prefix", F.explode(prefixes))
        .withColumn("digest", digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("digest", 1, prefix_hex))
    )
    fits = expressions.join(table, "short").where("digest = rule_digest")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("h"), F.col("action"), F.concat("rule_host", "rule_path").alias("rule"))
    best = fits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    judged = pages.join(best, ["host", "path"], "left")
    return judged.select(F.col("key_").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op3(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return filter_urls(table(spark, sf_dir, "pages"), RULES)


SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path FROM p
), m AS (
  SELECT page_id, host, coalesce(path, '') AS path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM q
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM m
"""
