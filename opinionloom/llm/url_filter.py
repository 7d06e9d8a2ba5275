"""URL filters: host-suffix and path-prefix expressions, joined with a rule table on short hash prefixes.

Every url is expanded into the expressions a rule could be stored under, the expressions meet the rules in an equi-join
on a 32-bit prefix of their SHA-256, and what meets is confirmed by the full digest and the rule's own text.

Defined cases: a null url, or one without ``://``, has an empty host and path and meets no rule. Rules without a host, or
with a null path or verdict, are ignored; of rules with equal host and path the smallest verdict counts. A url gets one
result row per input row, repeated rows included. Columns of ``pages`` other than the key and the url are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rules of at most this many rows (some 200 bytes each) are broadcast; longer lists are joined by shuffle.
BROADCAST_RULES = 100_000
PREFIX_HEX = 8


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _folder(path: Column) -> Column:
    """The path up to its last slash: what a rule is filed under."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def _suffixes(host: Column, most: int) -> Column:
    """The host and its parent domains, of at most ``most`` labels."""
    labels = F.split(host, r"\.", -1)
    n = F.size(labels)
    sizes = F.sequence(F.lit(1), F.least(n, F.lit(most)))
    return F.transform(sizes, lambda k: F.array_join(F.slice(labels, n - k + 1, k), "."))


def _prefixes(path: Column, most: int) -> Column:
    """The empty path and every prefix that ends in one of the first ``most`` slashes."""
    parts = F.split(path, "/", most + 1)
    sizes = F.sequence(F.lit(0), F.size(parts) - 1)
    return F.transform(
        sizes, lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/")))
    )


def _digest(host: Column, folder: Column) -> Column:
    return F.sha2(F.concat_ws("\n", host, folder), 256)


def judge_urls(
    pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow"
) -> DataFrame:
    """Rows ``(key, host, path, rule, verdict)``; ``rules`` has ``host, path, verdict``.

    A rule fits its host and all subdomains where the url's path starts with the rule's path. The longest rule wins,
    then the one with the longer host, then the smaller text.
    """
    clean = (
        rules.select(F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
        .filter("rule_host is not null and rule_host != '' and rule_path is not null and verdict is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.min("verdict").alias("verdict"))
        .withColumn("digest", _digest(F.col("rule_host"), _folder(F.col("rule_path"))))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    # No url needs an expression deeper than the deepest rule.
    bounds = clean.agg(
        F.count("*").alias("n"),
        F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.max(F.size(F.split("rule_path", "/", -1)) - 1).alias("slashes"),
    ).first()
    urls = pages.select(F.col(key).alias("_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    expressions = (
        urls.select("host", "path")
        .withColumn("suffix", F.explode(_suffixes(F.col("host"), max(1, bounds.labels or 1))))
        .withColumn("folder", F.explode(_prefixes(F.col("path"), bounds.slashes or 0)))
        .select("host", "path", _digest(F.col("suffix"), F.col("folder")).alias("url_digest"))
        .withColumn("prefix", F.substring("url_digest", 1, PREFIX_HEX))
    )
    met = expressions.join(F.broadcast(clean) if bounds.n <= BROADCAST_RULES else clean, "prefix").filter(
        (F.col("url_digest") == F.col("digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    )
    rule = F.concat("rule_host", "rule_path")
    # max of the order key first: the text is compared only between rules of equal length
    best = met.groupBy("host", "path").agg(
        F.max(F.struct(F.length(rule).alias("size"), F.length("rule_host").alias("host_size"))).alias("longest"),
        F.collect_set(F.struct(rule.alias("rule"), F.length("rule_host").alias("host_size"), "verdict")).alias("fitting"),
    )
    chosen = F.array_min(
        F.filter(
            "fitting",
            lambda r: (F.length(r["rule"]) == F.col("longest.size")) & (r["host_size"] == F.col("longest.host_size")),
        )
    )
    best = best.select(F.col("host").alias("h"), F.col("path").alias("p"), chosen.alias("best"))
    return urls.join(best, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")), "left").select(
        F.col("_key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )
