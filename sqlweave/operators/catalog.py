"""Database catalogs: flattening, keys, sample values, descriptions and documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.functions.arrays import unnest
from sqlweave.functions.seeded import digest
from sqlweave.functions.text import strip_space
from sqlweave.operators.ranking import gather_text, integer_bucket, position
from sqlweave.session import materialise

# How many values of a column are looked at, and how many are kept.
SAMPLE_POOL = 10
# Rows whose values are compared at once.
SAMPLE_ROWS = 512
SAMPLE_SIZE = 2


def flatten_primary_keys(keys: Column) -> Column:
    """Column indexes out of entries like '3' (single) and '[3, 4]' (composite), once each."""

    def numbers(entry: Column) -> Column:
        found = F.regexp_extract_all(entry, F.lit(r"(\d+)"), 1)
        return F.transform(found, lambda n: n.cast("int"))

    return F.array_distinct(F.flatten(F.transform(keys, numbers)))


def flatten_columns(raw: DataFrame) -> DataFrame:
    """One row per real column of each catalog, positional indexes resolved.

    Names are resolved inside the nested row, so nothing is joined and only the
    finished column entries are exploded.
    """
    keys = raw.withColumn("__pk", flatten_primary_keys(F.col("primary_keys")))

    def entry(column: Column, i: Column) -> Column:
        return F.struct(
            i.cast("int").alias("col_idx"),
            column["table_idx"].alias("table_idx"),
            F.get("table_names_original", column["table_idx"]).alias("table_name"),
            column["name"].alias("column_name"),
            F.get("column_names", i)["name"].alias("display_name"),
            F.get("column_types", i).alias("type"),
            F.array_contains("__pk", i.cast("int")).alias("is_pk"),
        )

    real = F.filter(F.transform("column_names_original", entry), lambda c: c["table_idx"] >= 0)
    return unnest(keys, real, "c", "db_id").select("db_id", "c.*").drop("table_idx")


def foreign_key_edges(raw: DataFrame) -> DataFrame:
    """Edges between 'table.column' names in both directions; `edge_pos` is the write order."""

    def name(idx: Column) -> Column:
        column = F.get("column_names_original", idx)
        return F.concat(F.get("table_names_original", column["table_idx"]), F.lit("."), column["name"])

    def both(pair: Column, i: Column) -> Column:
        one, other = name(pair[0]), name(pair[1])
        return F.array(
            F.struct((2 * i).alias("edge_pos"), one.alias("key_from"), other.alias("key_to")),
            F.struct((2 * i + 1).alias("edge_pos"), other.alias("key_from"), one.alias("key_to")),
        )

    edges = F.flatten(F.transform("foreign_keys", both))
    return unnest(raw, edges, "e", "db_id").select("db_id", "e.*")


def foreign_key_partner(edges: DataFrame) -> DataFrame:
    """The one partner each column keeps: the last edge written wins."""
    return edges.groupBy("db_id", "key_from").agg(F.max_by("key_to", "edge_pos").alias("foreign_key"))


def sample_values(table: DataFrame, table_name: str, columns: list[str], seed: str = "values") -> DataFrame:
    """Two seeded samples from the ten smallest distinct values of every column.

    Every task reduces its share to ten values per column, so what is shuffled does
    not grow with the table. Values are compared as text; '' is never kept.
    """
    texts = table.select(*[F.col(c).cast("string").alias(c) for c in columns])

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, pa.Array] = {}
        for whole in batches:
            # Pieces, because every step below copies the texts it looks at.
            for start in range(0, whole.num_rows, SAMPLE_ROWS):
                batch = whole.slice(start, SAMPLE_ROWS)
                for name in columns:
                    values = pc.unique(pc.drop_null(batch.column(name)))
                    if name in kept:
                        values = pc.unique(pa.concat_arrays([kept[name], values]))
                    order = pc.array_sort_indices(values)[:SAMPLE_POOL]
                    kept[name] = values.take(order)
            pa.default_memory_pool().release_unused()
        names = [n for n, values in kept.items() for _ in values]
        flat = [v.as_py() for values in kept.values() for v in values]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array(flat, pa.string())], ["column_name", "value"]
        )

    pool = texts.mapInArrow(smallest, "column_name string, value string").distinct()
    first = Window.partitionBy("column_name").orderBy("value")
    shuffled = Window.partitionBy("column_name").orderBy(
        digest(seed, F.lit(table_name), F.col("column_name"), F.col("value"))
    )
    return (
        pool.withColumn("n", F.row_number().over(first))
        .filter((F.col("n") <= SAMPLE_POOL) & (F.col("value") != ""))
        .withColumn("pick", F.row_number().over(shuffled))
        .filter(F.col("pick") <= SAMPLE_SIZE)
        .select(F.lit(table_name).alias("table_name"), "column_name", "pick", "value")
    )


def clean_description(text: Column) -> Column:
    """One line, without the evidence marker, trimmed; NULL becomes ''."""
    plain = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    return strip_space(F.replace(plain, F.lit("commonsense evidence:"), F.lit("")))


def clean_value_description(text: Column) -> Column:
    """As clean_description, and without a leading 'not useful'."""
    clean = clean_description(text)
    marked = F.lower(clean).startswith("not useful")
    return F.when(marked, strip_space(F.substring(clean, 11, 2**31 - 1))).otherwise(clean)


def describe_columns(columns: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Attach descriptions by lower-cased names: column text, then value text."""
    texts = descriptions.select(
        "db_id",
        F.lower("table_name").alias("__t"),
        F.lower(strip_space(F.col("original_column_name"))).alias("__c"),
        clean_description(F.col("column_description")).alias("__d"),
        clean_value_description(F.col("value_description")).alias("__v"),
    )
    keyed = columns.withColumns({"__t": F.lower("table_name"), "__c": F.lower("column_name")})
    column_part = F.when(F.coalesce("__d", F.lit("")) != "", F.concat("__d", F.lit(" "))).otherwise("")
    return (
        keyed.join(texts, ["db_id", "__t", "__c"], "left")
        .withColumn("description", F.concat(column_part, F.coalesce("__v", F.lit(""))))
        .drop("__t", "__c", "__d", "__v")
    )


def search_document(table: Column, column: Column, description: Column, values: Column) -> Column:
    """Text of a column for retrieval."""
    described = F.when(F.trim(description) != "", F.concat(F.lit("\ncolumn_desc:"), description, F.lit(". ")))
    valued = F.when(F.trim(values) != "", F.concat(F.lit("\nvalue_desc:"), values, F.lit(".")))
    return F.concat(
        F.lit("table:"), table, F.lit("\ncolumn:"), column,
        F.coalesce(described, F.lit("")), F.coalesce(valued, F.lit("")),
    )


def training_document(table: Column, column: Column, description: Column, values: Column) -> Column:
    """Text of a column for contrastive training. The closing tags are part of the format."""
    described = F.when(
        F.trim(description) != "",
        F.concat(F.lit(" <column description>"), description, F.lit("</column_description>")),
    )
    valued = F.when(
        F.trim(values) != "", F.concat(F.lit(" <value description>"), values, F.lit("</value description>"))
    )
    return F.concat(
        F.lit("<table>"), table, F.lit("</table> <column>"), column, F.lit("</column>"),
        F.coalesce(described, F.lit("")), F.coalesce(valued, F.lit("")),
    )


def restore_casing(names: DataFrame, columns: DataFrame) -> DataFrame:
    """Give (db_id, table_name, column_name) their catalog spelling; unknown names stay.

    A catalog's names are far larger in memory than in their files, so they are never broadcast.
    """
    spelled = columns.select(
        "db_id",
        F.lower("table_name").alias("__t"),
        F.lower("column_name").alias("__c"),
        F.col("table_name").alias("__table"),
        F.col("column_name").alias("__column"),
    )
    tables = spelled.select("db_id", "__t", F.col("__table").alias("__only")).distinct()
    return (
        names.withColumns({"__t": F.lower("table_name"), "__c": F.lower("column_name")})
        .join(tables.hint("merge"), ["db_id", "__t"], "left")
        .join(spelled.drop("__table").hint("merge"), ["db_id", "__t", "__c"], "left")
        .withColumn("table_name", F.coalesce("__only", "table_name"))
        .withColumn("column_name", F.coalesce("__column", "column_name"))
        .drop("__t", "__c", "__only", "__column")
    )


def expand_columns(selected: DataFrame, columns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Full information of the selected columns, and the selections no catalog knows."""
    keys = ["db_id", "table_name", "column_name"]
    return selected.join(columns, keys), selected.join(columns, keys, "left_anti")


def foreign_key_lines(selected: DataFrame) -> DataFrame:
    """'t.c = t2.c2' of the selected columns that have a partner.

    `selected(question_id, pos, table_name, column_name, foreign_key, is_wildcard)`; the
    partner need not be selected, `target_selected` tells.
    """
    linked = selected.filter(F.col("foreign_key").isNotNull() & (F.col("foreign_key") != "") & ~F.col("is_wildcard"))
    own = F.concat_ws(".", "table_name", "column_name")
    chosen = selected.select("question_id", own.alias("foreign_key"), F.lit(True).alias("__hit")).distinct()
    return linked.join(chosen, ["question_id", "foreign_key"], "left").select(
        "question_id",
        "pos",
        F.concat(own, F.lit(" = "), "foreign_key").alias("fk"),
        F.coalesce("__hit", F.lit(False)).alias("target_selected"),
    )


def distinct_foreign_keys(lines: DataFrame) -> DataFrame:
    """One line per unordered pair, first orientation kept; lines without exactly one '=' go."""
    parts = F.transform(F.split("fk", "="), strip_space)
    pair = F.array_sort(parts)
    rest = [c for c in lines.columns if c not in ("question_id", "pos", "fk")]
    first = F.min_by(F.struct(F.col("pos"), parts.alias("parts"), *rest), "pos")
    return (
        lines.filter(F.size(F.split("fk", "=")) == 2)
        .groupBy("question_id", pair.alias("pair"))
        .agg(first.alias("f"))
        .select("question_id", "f.pos", F.array_join("f.parts", " = ").alias("fk"), *[f"f.{c}" for c in rest])
    )


def connected_components(edges: DataFrame, group: str = "db_id", a: str = "a", b: str = "b") -> DataFrame:
    """Smallest member id of every node's component, within its group.

    Each round takes the smallest label among a node's neighbours and then jumps to
    that label's own label, so paths shorten by more than half; rounds are written out
    to cut the lineage. Minima combine before the shuffle, so hubs are no hot spot.
    """
    one_way = edges.select(group, F.col(a).alias("node"), F.col(b).alias("other"))
    swapped = edges.select(group, F.col(b).alias("node"), F.col(a).alias("other"))
    links = materialise(one_way.union(swapped).distinct())
    labels = links.select(group, "node").distinct().withColumn("label", F.col("node"))
    while True:
        seen = links.join(labels.select(group, F.col("node").alias("other"), "label"), [group, "other"])
        nearest = seen.groupBy(group, "node").agg(F.min("label").alias("near"))
        lowered = labels.join(nearest, [group, "node"]).select(
            group, "node", F.col("label").alias("before"), F.least("label", "near").alias("label")
        )
        targets = lowered.select(group, F.col("node").alias("label"), F.col("label").alias("beyond"))
        labels = materialise(
            lowered.join(targets, [group, "label"]).select(
                group, "node", F.col("beyond").alias("label"), (F.col("beyond") < F.col("before")).alias("moved")
            )
        )
        if labels.filter("moved").isEmpty():
            return labels.drop("moved")
        labels = labels.drop("moved")


def name_ids(columns: DataFrame) -> DataFrame:
    """Identifier of every name: '__table.column__' for columns, '__table__' for tables, '*'."""
    own = F.lower(F.concat_ws(".", "table_name", "column_name"))
    of_columns = columns.select("db_id", own.alias("name"))
    of_tables = columns.select("db_id", F.lower("table_name").alias("name")).distinct()
    star = columns.select("db_id").distinct().withColumn("name", F.lit("*"))
    named = of_columns.union(of_tables).withColumn("name_id", F.concat(F.lit("__"), "name", F.lit("__")))
    return named.union(star.withColumn("name_id", F.lit("__all__")))


def vocabulary_stats(columns: DataFrame) -> DataFrame:
    """Distinct comments, descriptions and string sample values.

    `columns(comment, description, sample_values)`. Values count when the first one is text.
    """
    number = r"^-?\d+(\.\d+)?([eE][-+]?\d+)?$"
    textual = F.size("sample_values").__gt__(0) & ~F.get("sample_values", F.lit(0)).rlike(number)
    entries = F.concat(
        F.array(F.struct(F.lit("comment").alias("kind"), F.col("comment").alias("entry"))),
        F.array(F.struct(F.lit("description").alias("kind"), F.col("description").alias("entry"))),
        F.when(
            textual, F.transform("sample_values", lambda v: F.struct(F.lit("value").alias("kind"), v.alias("entry")))
        ).otherwise(F.array().cast("array<struct<kind:string,entry:string>>")),
    )
    return (
        unnest(columns, entries, "e")
        .select("e.*")
        .filter(F.col("entry").isNotNull() & (F.col("entry") != ""))
        .distinct()
        .groupBy("kind")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )


def table_columns(columns: DataFrame) -> DataFrame:
    """Columns of every table in catalog order, as one comma-joined text.

    Samples refer to it by `db_id`, so a database is listed once, not once per question.
    """
    return gather_text(columns, ["db_id", "table_name"], "col_idx", "column_name", ",")


def linked_samples(samples: DataFrame, links: DataFrame) -> DataFrame:
    """Samples that use at least one column."""
    return samples.join(links, "question_id", "left_semi")
