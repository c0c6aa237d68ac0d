"""URL filters over hashed host-suffix / path-prefix expressions (DataFrame functions only).

A rule (host, path, verdict) fits a url whose host is the rule's host or a subdomain of it and whose path starts with
the rule's path. Each url is expanded into the expressions (last k labels of the host + first n characters of the
path) for every (k, n) that some rule has, so no rule can be missed and long urls stay cheap. Expressions meet rules in
an equi-join on the first 32 bits of their SHA-256, full digests are then compared, and the longest rule wins; of two
as long the one with the longer host, then block before allow, then the greater string.

Null urls and urls without '://' have an empty host and path and meet no rule. Repeated rows are judged each for
itself. An empty rule table gives every url the default verdict; an empty page table gives an empty result. The result
holds the id column, url parts, rule and verdict only, so clashing names among other columns do not matter.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseframe.llm.common import lower_ascii

PREFIX_HEX = 8  #: 32 bits of the digest
BROADCAST_RULES = 50_000  #: rules above this number are joined through a shuffle instead
SALTS = 32  #: copies of each rule in that shuffle: common suffixes such as a top-level domain are spread over these


def url_host(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, ASCII lower case; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _labels(host: Column) -> Column:
    return F.size(F.split(host, r"\."))


def hashed_rules(rules: DataFrame) -> DataFrame:
    """rules(host, path, verdict), each (host, path) once (block wins), with digest, its short prefix and rank."""
    rule = F.concat("host", "path")
    once = rules.groupBy(lower_ascii(F.col("host")).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    return once.select(
        rule.alias("rule"), "verdict", F.sha2(rule, 256).alias("digest"), F.substring(F.sha2(rule, 256), 1, PREFIX_HEX).alias("prefix"),
        F.struct(F.length(rule).alias("n"), F.length("host").alias("h"), F.col("verdict").alias("verdict"), rule.alias("rule")).alias("rank"),
        _labels(F.col("host")).alias("labels"), F.length("path").alias("chars"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", broadcast_rules: int = BROADCAST_RULES, salts: int = SALTS) -> DataFrame:
    """One row per page: id, host, path, rule (null if none fits), verdict."""
    known = hashed_rules(rules)
    # At most (labels in a host) x (path lengths) shapes, whatever the number of rules: numbers, one literal in the plan.
    shapes = [{"labels": r.labels, "chars": r.chars} for r in known.select("labels", "chars").distinct().collect()]
    few = known.limit(broadcast_rules + 1).count() <= broadcast_rules
    parts = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url")).select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    if not shapes:
        return parts.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # Equal urls and urls that differ in their query only are judged once.
    urls = parts.select("host", "path").where("host <> ''").distinct()
    urls = urls.withColumn("labels", _labels(F.col("host"))).withColumn("chars", F.length("path"))
    fitting = F.filter(F.from_json(F.lit(json.dumps(shapes)), "array<struct<labels: int, chars: int>>"), lambda s: (s["labels"] <= F.col("labels")) & (s["chars"] <= F.col("chars")))
    # the last labels of the host and the first characters of the path
    expressions = F.transform(fitting, lambda s: F.concat(F.array_join(F.slice(F.split("host", r"\."), -s["labels"], s["labels"]), "."), F.col("path").substr(F.lit(1), s["chars"])))
    asked = urls.select("host", "path", F.explode(expressions).alias("expression")).select("host", "path", F.sha2("expression", 256).alias("asked"))
    asked = asked.withColumn("prefix", F.substring("asked", 1, PREFIX_HEX))
    known = known.select("prefix", "digest", "rank")
    if few:
        met = asked.join(F.broadcast(known), "prefix")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        met = asked.withColumn("salt", F.pmod(F.hash("host", "path"), F.lit(salts))).join(salted, ["prefix", "salt"])
    best = met.where("asked = digest").groupBy("host", "path").agg(F.max("rank").alias("rank"))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("rank.rule").alias("rule"), F.coalesce("rank.verdict", F.lit(default)).alias("verdict")
    )
