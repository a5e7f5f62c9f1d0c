"""URL filter lists: host-suffix and path-prefix expressions, short hash prefixes,
full digests, rule precedence. Built-in Spark expressions only.

A rule is (host, path, verdict). It fits its host and every subdomain, where the
url's path starts with the rule's path. Each distinct (host, path) of the urls is
expanded into the host suffixes and path prefixes that some rule could have; the
expressions meet the rules on the first 4 bytes of their SHA-256 and are
confirmed on the whole digest. The longest rule wins; of equally long ones that
with the longer host, then ``block``.

Defined cases: a null url or one without ``://`` has empty host and path and no
rule; an empty path fits no rule whose path is not empty; no fitting rule gives
the default verdict; rules with a null field are ignored; repeated urls are
judged once and each row is returned; an empty table gives no rows. Input columns
other than the key and url columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the join uses (4 bytes).
PREFIX_DIGITS = 8


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.when(F.instr(url, "://") > 0, found).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    after = F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(rest))
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(after, r"^[^?#]*", 0)).otherwise("")


def _expressions(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Array of (host suffix, path prefix): suffixes of the given numbers of labels,
    prefixes of the given lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in labels]), lambda n: n <= F.size(parts)),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.transform(
        F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length(path)),
        lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(
        prefixes, lambda p: F.struct(s.alias("suffix"), p.alias("prefix")))))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\x00"), path), 256)


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url",
                default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule (null if none fits), verdict.

    Of the rules the driver gets only the distinct numbers of host labels and the
    distinct path lengths, a few integers. Urls are judged once for each distinct
    (host, path), counted together before the shuffle; verdicts go back to the rows
    over a plain join on one key, where adaptive execution can split a url that a
    large part of the rows have. The rules are broadcast only where Spark's size
    threshold allows it.
    """
    rules = rules.select(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path"),
                         F.col("verdict").alias("rule_verdict")).dropna().distinct()
    shape = rules.agg(F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
                      F.collect_set(F.length("rule_path")).alias("lengths")).first()
    rows = pages.select(F.col(key).alias("row_key"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = rows.withColumn("host", F.coalesce("host", F.lit(""))).withColumn("path", F.coalesce("path", F.lit("")))
    found = rows.select(F.col("row_key").alias(key), "host", "path")
    if not shape.labels:
        return found.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    listed = rules.withColumn("digest", _digest(F.col("rule_host"), F.col("rule_path"))) \
        .withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))
    expanded = (
        rows.select("host", "path").distinct()
        .select("host", "path", F.explode(_expressions(F.col("host"), F.col("path"), sorted(shape.labels),
                                                       sorted(shape.lengths))).alias("e"))
        .select("host", "path", _digest(F.col("e.suffix"), F.col("e.prefix")).alias("full"))
        .withColumn("short", F.substring("full", 1, PREFIX_DIGITS)))
    rule = F.concat("rule_host", "rule_path")
    judged = (
        expanded.join(listed, "short").where(F.col("full") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct(F.length(rule), F.length("rule_host"), F.col("rule_verdict") == "block",
                            rule.alias("rule"), F.col("rule_verdict").alias("verdict"))).alias("best"))
        .select(F.concat("host", F.lit("\x00"), "path").alias("at"), "best.rule", "best.verdict"))
    return (
        rows.withColumn("at", F.concat("host", F.lit("\x00"), "path")).join(judged, "at", "left")
        .select(F.col("row_key").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict")))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """Rules given as text in a job's settings, as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")
