"""Line de-duplication by distinct-site spread, with HyperLogLog sketches per line hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.llm.columns import carried, quoted
from sqlweave.session import materialise

# Sketches have 2^LG_K registers. Their standard error is about 1.04 / sqrt(2^LG_K) at most;
# estimates within MARGIN (five standard errors) of the limit are counted exactly.
LG_K = 12
MARGIN = 5 * 1.04 / 2 ** (LG_K / 2)


def line_hash(line: Column) -> Column:
    """128 bits of a line as two hashes with different seeds."""
    return F.struct(F.xxhash64(F.lit("a"), line).alias("a"), F.xxhash64(F.lit("b"), line).alias("b"))


def drop_site_boilerplate(
    documents: DataFrame, min_sites: int = 10, text: str = "text", site: str = "source", margin: float = MARGIN
) -> DataFrame:
    """Remove lines that stand on `min_sites` or more distinct sites from every text.

    Lines end at \\n; white space at both ends does not count for equality, and blank lines are
    never removed. Each task sketches the sites of its lines, sketches of a line merge in the
    aggregation, and a line is decided by its estimate unless that is near `min_sites`: such
    lines get an exact distinct count. `n_lines` and `n_removed` are added; other columns stay,
    columns of those two names are replaced, whatever the others are called.

    A null text stays null with 0 lines; a null site counts as no site. Removal is decided for
    each text, so repeated rows and null ids are treated alike. An empty table gives an empty
    result.
    """
    inward, outward = carried(documents, ("n_lines", "n_removed"))
    place = [c for c in documents.columns if c.lower() not in ("n_lines", "n_removed")].index(text)
    content, where = F.col(quoted(text)), F.col(quoted(site))
    lines = F.split(content, "\n", -1)
    trimmed = lambda x: F.trim(x, F.lit(" \t\r\u000b\f"))
    source = documents.select(content.alias("content"), where.cast("string").alias("place"))
    spread_lines = (
        source.filter(F.col("place").isNotNull() & F.col("content").isNotNull())
        .select("place", F.explode(F.transform(F.split("content", "\n", -1), trimmed)).alias("line"))
        .filter(F.col("line") != "")
        .select("place", line_hash(F.col("line")).alias("h"))
    )
    sketched = spread_lines.groupBy("h").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("place", F.lit(LG_K))).alias("sites")
    )
    # Far below the limit most lines fall out here and are never written.
    wide = materialise(sketched.filter(F.col("sites") >= min_sites * (1 - margin)))
    near = wide.filter(F.col("sites") <= min_sites * (1 + margin)).select("h")
    exact = (
        spread_lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
        .filter(F.col("sites") >= min_sites)
    )
    boilerplate = materialise(
        wide.filter(F.col("sites") > min_sites * (1 + margin)).select("h").union(exact.select("h"))
    )
    key = F.unhex(F.md5(F.coalesce(content, F.lit(""))))
    # The lines to remove from each text that has any: at most as many as the text has.
    marked = materialise(
        documents.filter(content.isNotNull())
        .select(key.alias("key"), F.explode(F.array_distinct(F.transform(lines, lambda x: line_hash(trimmed(x))))).alias("h"))
        .join(boilerplate, "h", "left_semi")
        .distinct()
        .groupBy("key")
        .agg(F.collect_list("h").alias("gone"))
    )
    kept = F.col(f"kept_{place}")
    now = F.split(kept, "\n", -1)
    stays = F.filter(now, lambda x: ~F.array_contains(F.col("gone"), line_hash(trimmed(x))))
    has = F.col("gone").isNotNull()
    n_lines = F.when(kept.isNull(), 0).otherwise(F.size(now)).cast("long")
    outward[place] = F.when(has, F.array_join("stays", "\n")).otherwise(kept).alias(text)
    return (
        documents.select(*inward, key.alias("key"))
        .join(marked, "key", "left")
        .withColumn("stays", F.when(has, stays))
        .select(*outward, n_lines.alias("n_lines"), F.when(has, n_lines - F.size("stays")).otherwise(F.lit(0)).cast("long").alias("n_removed"))
    )
