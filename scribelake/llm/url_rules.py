"""URL filters: pattern rules indexed by their rarest literal token.

A rule names a host, which stands for all its subdomains too, and the beginning of a
path, in which ``*`` stands for any characters.  Each rule becomes one regular expression
and a set of *literal tokens* that every URL it fits must have: the labels of its host
and the path segments it spells out in full.  URLs are cut into the same tokens.  A rule
is filed under the token that fewest URLs of the corpus have; the tokens of a URL fetch
the rules filed there, and only those run their expression.  A rule without any literal
token is filed under the empty token, which every URL has.

Equal (host, path) pairs are judged once, so neither a page that is listed a million
times nor a host that has a third of all pages is work for one task: tokens are counted
in each task first, and the fetch is a join that Spark may broadcast, after checking the
size of the rules, or split where one token is common.

Of the fitting rules the longest wins, by characters of host and path together; of
equally long ones that with the longer host, then block over allow, then the smaller
text.  Defined results: a URL that is NULL or lacks ``://`` has an empty host and path,
which only a rule without a host fits; a URL no rule fits gets ``default``.  Hosts are
lower-cased in A-Z, paths are taken as they are.  Rules with a NULL host or path are
errors.  Columns of the pages other than id and url are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scribelake.session import materialise

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(
        F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))
    ).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(host: Column, path: Column) -> Column:
    """Host labels, marked ``h:``, and path segments, marked ``p:``, and the empty token."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), x))
    return F.array_distinct(F.concat(F.array(F.lit("")), labels, segments))


def _literals(host: str, path: str) -> list[str]:
    """Tokens that every fitting URL has; a segment counts if a slash ends it."""
    segments = path.split("/")[1:-1] if path.startswith("/") else []
    labels = host.split(".") if host else []
    return [f"h:{x}" for x in labels] + [f"p:{x}" for x in segments if x and "*" not in x]


def _pattern(host: str, path: str) -> str:
    """An expression for host and path, written one after the other.

    A host holds no slash and a path begins with one or is empty, so the seam is clear.
    """
    hosts = rf"(?:[^/]*\.)?{re.escape(host)}" if host else "[^/]*"
    rest = ".*".join(re.escape(part) for part in path.split("*"))
    return f"(?s)^{hosts}{rest or '(?:/|$)'}"


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path); verdict is allow or block."""
    rows = []
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"no such verdict: {verdict}")
        host = host.translate(str.maketrans(_UPPER, _UPPER.lower()))
        rows.append((host + path, verdict, len(host), _pattern(host, path), _literals(host, path) or [""]))
    return spark.createDataFrame(
        rows, "rule string, verdict string, host_length int, pattern string, tokens array<string>"
    )


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    default: str = "allow",
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict."""
    host, path = host_and_path(F.col(f"`{url_col}`"))
    parts = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    tokens = materialise(
        parts.select("host", "path")
        .distinct()
        .withColumn("token", F.explode(url_tokens(F.col("host"), F.col("path")))),
        "tokens",
    )
    rules = materialise(rules, "rules")
    wanted = rules.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(wanted, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # the rarest token of each rule; one that no URL has is rarest of all
    filed = (
        rules.withColumn("token", F.explode("tokens"))
        .join(counts, "token", "left")
        .groupBy("rule", "verdict", "host_length", "pattern")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("rarest"))
        .withColumn("token", F.col("rarest.token"))
        .drop("rarest")
    )
    filed = materialise(filed, "filed")
    fits = tokens.join(filed, "token").where(F.expr("concat(host, path) RLIKE pattern"))
    # the smallest is the longest rule, then the longest host, then block, then the text
    order = F.struct(
        (-F.length("rule")).alias("length"),
        (-F.col("host_length")).alias("host_length"),
        (F.col("verdict") != "block").alias("allows"),
        "rule",
        "verdict",
    )
    best = fits.groupBy("host", "path").agg(F.min(order).alias("won"))
    return (
        parts.join(best.select("host", "path", "won"), ["host", "path"], "left")
        .select(
            "page_id",
            "host",
            "path",
            F.col("won.rule").alias("rule"),
            F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
        )
    )
