"""URL filter: host-suffix and path-prefix expressions against a rule table, with DataFrame functions only.

Each distinct (host, path) is expanded into the suffixes of the host at label borders, for the label counts that rules
have. Those that a rule names are expanded further, with the prefixes of the path at the lengths that this host's rules
have. Either expression's SHA-256 is computed, the first 8 hex digits are the join key, and the full digest then
confirms. Of the rules that fit, the one with the longest host and path wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.common import LOWER, UPPER, free_names

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Rule tables up to this many rows are small enough to send to every task (about 200 bytes a rule).
BROADCAST_RULES = 50_000


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "verdict string, host string, path string")


def url_host(url: Column) -> Column:
    """From after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """pages with host, path, rule (host and path of the winning rule, else null) and verdict.

    A row of pages gives a row of the result, repeated rows too. Null urls and those without :// have an empty host
    and path, fit no rule, and get the default. Equal rules: block beats allow. A rule with a null host or path fits nothing.
    Columns of pages named host, path, rule or verdict are replaced; all others are kept. Urls may be of any length. An
    empty table gives no rows; without rules all get the default.
    """
    rules = rules.where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    digest = lambda *parts: F.sha2(F.concat_ws("\n", *parts), 256)
    short = lambda full: F.substring(full, 1, 8)
    spans = {"span": F.length("host") + F.length("path"), "host_span": F.length("host"), "rule": F.concat("host", "path")}
    keyed = rules.withColumns(spans | {"digest": digest("host", "path")}).withColumn("key", short("digest")).select("key", "digest", "span", "host_span", "verdict", "rule")
    # A host that any rule names, with the lengths of its rules' paths only.
    named = rules.groupBy(F.col("host").alias("name")).agg(F.collect_set(F.length("path")).alias("lengths")).withColumn("full", digest("name")).select(short("full").alias("key"), F.col("full").alias("named"), "lengths")
    shape = rules.agg(F.collect_set(F.size(F.split("host", "[.]"))).alias("labels"), F.count("*").alias("n")).first()
    if shape["n"] <= BROADCAST_RULES:
        keyed, named = F.broadcast(keyed), F.broadcast(named)

    host, path = free_names([c for c in pages.columns if c not in ("host", "path")], "url_host_", "url_path_")
    at = pages.drop("rule", "verdict").withColumns({"host": url_host(F.col("url")), "path": url_path(F.col("url"))})
    each = at.select("host", "path").where("host <> ''").distinct()
    labels = F.array(*[F.lit(int(x)) for x in sorted(shape["labels"])]).cast("array<int>")
    parts = F.split("host", "[.]")
    hosts = F.transform(F.filter(labels, lambda n: n <= F.size(parts)), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    met = each.withColumn("h", F.explode(hosts)).withColumn("full", digest("h")).withColumn("key", short("full")).join(named, "key").where("full = named").drop("key", "full", "named")
    paths = F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    tries = met.withColumn("p", F.explode(paths)).withColumn("full", digest("h", "p")).withColumn("key", short("full"))
    best = tries.join(keyed, "key").where("full = digest").groupBy("host", "path").agg(F.max(F.struct("span", "host_span", "verdict", "rule")).alias("best"))
    best = best.select(F.col("host").alias(host), F.col("path").alias(path), "best.rule", "best.verdict")
    found = at.join(best, (F.col("host") == F.col(host)) & (F.col("path") == F.col(path)), "left")
    return found.drop(host, path).withColumn("verdict", F.coalesce("verdict", F.lit(default)))
