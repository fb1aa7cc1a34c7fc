"""URL filters by hashed host-suffix and path-prefix expressions, in DataFrame functions only.

A rule is a host, a path and a verdict; its expression is host + path. Every
distinct URL is expanded into the expressions that a fitting rule could have:
each suffix of its host at a label border with each prefix of its path of a
length that some rule's path has. Expressions meet rules in an equi-join on
the first PREFIX_DIGITS hex digits of their SHA-256; the full digest, host
and path confirm a meeting, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.names import Named

PREFIX_DIGITS, SALTS = 8, 16
Rule = tuple[str, str, str]


def _after_scheme(url: Column) -> Column:
    """What follows the first `://`; empty for a null or none."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(_after_scheme(url), "^([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(host, path, action) rows of a list of rules."""
    return spark.createDataFrame(rules, "host string, path string, action string")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of pages (default all) with host, path, rule and verdict.

    A rule (host, path, action) fits a URL when the URL's host is the rule's
    or a subdomain of it and the URL's path starts with the rule's; of several
    the one with the longest host + path wins, then the smaller host, then
    `block`. Without a fitting rule, rule is null and verdict is default. A
    null URL or one without `://` has an empty host and path, and no rule
    fits an empty host. Rules with a null field are ignored. Repeated rows
    are judged alike; other columns of pages are kept, those named like the
    added ones are replaced. Distinct URLs are judged once each, so a hot URL
    is one row of the join; an expression that very many URLs have meets its
    rule in SALTS tasks. URLs may be of any length: of a host only suffixes of
    as many labels as some rule's host has are made, of a path only prefixes
    of the lengths of rules' paths. These numbers alone, at most as many as
    the longest rule has labels and characters, come to the driver.
    """
    own = Named(pages)
    rules = rules.where("host is not null and path is not null and action is not null").select("host", "path", "action").distinct()
    sizes = rules.agg(F.collect_set(F.size(F.split("host", "\\.", -1))).alias("labels"), F.collect_set(F.length("path")).alias("lengths")).first()

    urls = own.df.where(own["url"].isNotNull()).select(own["url"].alias("url")).distinct()
    parts = urls.select("url", host_of(F.col("url")).alias("h"), path_of(F.col("url")).alias("p")).where("h <> ''").withColumn("n", F.size(F.split("h", "\\.", -1)))
    suffixes = F.array_compact(F.array(*(F.when(F.col("n") >= n, F.substring_index("h", ".", -n)) for n in sorted(sizes["labels"]))).cast("array<string>"))
    prefixes = F.array_compact(F.array(*(F.when(F.length("p") >= n, F.substring("p", 1, n)) for n in sorted(sizes["lengths"]))).cast("array<string>"))
    spread = parts.select("url", F.explode(suffixes).alias("xh"), prefixes.alias("xps")).select("url", "xh", F.explode("xps").alias("xp"))
    hashed = spread.withColumn("full", _digest(F.col("xh"), F.col("xp"))).withColumn("short", F.substring("full", 1, PREFIX_DIGITS)).withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)))
    listed = rules.withColumn("rule_full", _digest(F.col("host"), F.col("path"))).withColumn("short", F.substring("rule_full", 1, PREFIX_DIGITS)).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))

    fits = hashed.join(listed, ["short", "salt"]).where("full = rule_full and xh = host and xp = path")
    score = F.struct((F.length("host") + F.length("path")).alias("n"), F.length("path").alias("np"), F.when(F.col("action") == "block", 1).otherwise(0).alias("strict"), "host", "path", "action")
    best = fits.groupBy("url").agg(F.max(score).alias("b")).select("url", F.concat("b.host", "b.path").alias("rule"), F.col("b.action").alias("action"))
    judged = own.df.join(best, own["url"] == F.col("url"), "left")
    return own.back(judged, keep, host=host_of(own["url"]), path=path_of(own["url"]), rule=F.col("rule"), verdict=F.coalesce("action", F.lit(default)))
