"""Rules over hosts and paths, matched through hashed expressions of each url.

A rule names a host, which its subdomains share, and the start of a path. Each
url is expanded into expressions: every suffix of its host with as many labels
as some rule's host has, with every start of its path whose length some rule
has. Expressions meet rules in an
equi-join on a short prefix of their digest; the full digest confirms a match,
and of the matching rules the longest (host and path together) decides, then
the longer host, then a block. Where no rule fits, the default decides.

Cases: a null url, or one without "://", has an empty host and path and takes
the default and is not joined; equal urls are judged once and repeated rows are
kept; very long urls, of long hosts or paths, expand by the rules' labels and
lengths only; ids may be null; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of a digest that the join compares; the rest is confirmed after it.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_table(docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Rules (verdict, host, path) with digests; one of the same host and path stays, a block before an allow."""
    best = {(h.lower(), p): "block" for v, h, p in rules if v == "block"}
    best = {(h.lower(), p): v for v, h, p in rules} | best
    rows = [(v, h, p) for (h, p), v in sorted(best.items())]
    made = docs.sparkSession.createDataFrame(rows, "rule_verdict string, rule_host string, rule_path string")
    digest = F.sha2(F.concat_ws("\n", "rule_host", "rule_path"), 256)
    return made.select("rule_verdict", "rule_host", "rule_path", digest.alias("rule_digest"), F.substring(digest, 1, PREFIX).alias("prefix"))


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """Per row of pages: page_id, host, path, rule (host and path, else null), verdict."""
    host, path = split_url(pages["url"].cast("string"))
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    named = rows.where("host != ''")
    urls = named.select("host", "path").distinct()
    lengths = sorted({len(p) for _, _, p in rules})
    labels = sorted({h.count(".") + 1 for _, h, _ in rules})
    suffixes = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]))
    starts = F.array_distinct(F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substr(F.col("path"), F.lit(1), n)))
    expressions = (
        urls.select("host", "path", F.explode(suffixes).alias("suffix"), starts.alias("starts"))
        .select("host", "path", "suffix", F.explode("starts").alias("start"))
        .select("host", "path", F.sha2(F.concat_ws("\n", "suffix", "start"), 256).alias("digest"))
    )
    matches = expressions.withColumn("prefix", F.substring("digest", 1, PREFIX)).join(rule_table(pages, rules), "prefix").where("digest = rule_digest")
    order = F.struct(
        (F.length("rule_host") + F.length("rule_path")).alias("size"),
        F.length("rule_host").alias("host_size"),
        (F.col("rule_verdict") == "block").alias("block"),
        F.concat("rule_host", "rule_path").alias("rule"),
        F.col("rule_verdict").alias("verdict"),
    )
    best = matches.groupBy("host", "path").agg(F.max(order).alias("best"))
    judged = named.join(best, ["host", "path"], "left").select(*rows.columns, F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    nameless = rows.where("host = ''").select(*rows.columns, F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.select("page_id", "host", "path", "rule", "verdict").unionByName(nameless)
