"""URL filters: host-suffix and path-prefix expressions joined on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried, quoted

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Hex digits of a digest that the join uses; the whole digest is compared afterwards.
PREFIX_DIGITS = 8


def url_host(url: Column) -> Column:
    """From behind the first `://` to the next `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_behind_scheme(url), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From behind the host to `?`, `#` or the end; else empty."""
    return F.regexp_extract(_behind_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1)


def _behind_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))


def _suffixes(host: Column) -> Column:
    """A host and all its parent domains: a.b.c, b.c, c."""
    labels = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\0"), path), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """Add host, path, rule and verdict to every row of `pages`.

    `rules` holds (host, path, verdict). A rule fits its host and all subdomains when the
    url's path starts with the rule's. The rule with the longest host+path wins; among equally
    long ones the longer host, then `block`, then the smaller text. Without a fitting rule,
    `rule` is null and the verdict is `default`.

    Each distinct (host, path) is expanded once, however many pages have it, into its host
    suffixes times its path prefixes of the lengths that rules have. Expressions meet rules on
    a short prefix of their SHA-256, and the full digest confirms. A null url, or one without
    `://`, has empty host and path. Rules with a null host or path fit nothing. Columns of
    `pages` named host, path, rule or verdict are replaced, others stay whatever they are called.
    Repeated rows and null ids are judged like any other; empty tables give empty results.
    """
    inward, outward = carried(pages, ("host", "path", "rule", "verdict"))
    placed = pages.select(*inward, url_host(F.col(quoted(url))).alias("host"), url_path(F.col(quoted(url))).alias("path")).fillna("", ["host", "path"])
    known = rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull()).select(
        F.translate("host", UPPER, LOWER).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    )
    known = known.withColumn("digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn(
        "prefix", F.substring("digest", 1, PREFIX_DIGITS)
    )
    # One row: the distinct lengths of rule paths, a few hundred numbers whatever the rules are.
    lengths = known.agg(F.array_sort(F.collect_set(F.length("r_path"))).alias("lengths")).first()["lengths"]
    fitting = F.array(*[F.lit(n) for n in lengths]) if lengths else F.array().cast("array<int>")
    expanded = (
        placed.select("host", "path")
        .distinct()
        .withColumn("e_host", F.explode(_suffixes(F.col("host"))))
        .withColumn("e_len", F.explode(F.filter(fitting, lambda n: n <= F.length("path"))))
        .withColumn("e_digest", _digest(F.col("e_host"), F.expr("substring(path, 1, e_len)")))
        .select("host", "path", "e_digest", F.substring("e_digest", 1, PREFIX_DIGITS).alias("prefix"))
    )
    strength = F.struct(
        (F.length("r_host") + F.length("r_path")).alias("length"),
        F.length("r_host").alias("host_length"),
        (F.col("r_verdict") == "block").alias("blocks"),
        F.concat("r_host", "r_path").alias("rule"),
        F.col("r_verdict").alias("verdict"),
    )
    best = (
        expanded.join(known, "prefix")
        .filter(F.col("e_digest") == F.col("digest"))
        .groupBy("host", "path")
        .agg(F.max(strength).alias("best"))
    )
    return placed.join(best, ["host", "path"], "left").select(
        *outward,
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )
