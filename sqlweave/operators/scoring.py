"""Accuracy by level, turn and session; clause-by-clause scores of query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.functions import text as T
from sqlweave.functions.arrays import unnest
from sqlweave.functions.scopes import with_resolved_names
from sqlweave.session import spread

# Components that are compared as bags of units.
UNIT_LISTS = ("select", "select(no AGG)", "where", "where(no OP)", "group(no Having)", "keywords")


def execution_accuracy(attempts: DataFrame) -> DataFrame:
    return attempts.agg(F.count(F.lit(1)).alias("n"), F.avg("res").alias("accuracy"))


def accuracy_by_level(turns: DataFrame) -> DataFrame:
    """Count and accuracies per difficulty level and over `all`."""
    level = F.when(F.grouping("level") == 1, "all").otherwise(F.col("level"))
    return (
        turns.rollup("level")
        .agg(
            level.alias("score_level"),
            F.count(F.lit(1)).alias("n"),
            F.avg("exec").alias("exec"),
            F.avg("exact").alias("exact"),
        )
        .drop("level")
        .withColumnRenamed("score_level", "level")
    )


def accuracy_by_turn(turns: DataFrame) -> DataFrame:
    """Count and accuracies by 1-based turn number; later turns share a bucket."""
    label = F.when(F.col("turn") > 4, "turn > 4").otherwise(F.concat(F.lit("turn "), F.col("turn")))
    return turns.groupBy(label.alias("turn")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("exec").alias("exec"), F.avg("exact").alias("exact")
    )


def joint_accuracy(turns: DataFrame) -> DataFrame:
    """Share of sessions whose every turn is right. A metric that was not run counts as right."""

    def right(metric: str) -> Column:
        return F.bool_and(F.coalesce(F.col(metric) == 1, F.lit(True))).cast("int")

    sessions = turns.groupBy("session_id").agg(right("exec").alias("exec"), right("exact").alias("exact"))
    return sessions.agg(
        F.count(F.lit(1)).alias("n_sessions"), F.avg("exec").alias("joint_exec"), F.avg("exact").alias("joint_exact")
    )


def bag_overlap(units: DataFrame) -> DataFrame:
    """Per query, block and component: units on each side and how many they share, as bags.

    `units(query_id, block_id, side, component, unit)`, side 'gold' or 'pred'.
    """

    def on(side: str) -> Column:
        return F.sum(F.when(F.col("side") == side, 1).otherwise(0))

    keys = ["query_id", "block_id", "component"]
    counted = units.groupBy(*keys, "unit").agg(on("gold").alias("g"), on("pred").alias("p"))
    return counted.groupBy(*keys).agg(
        F.sum("g").alias("label_total"), F.sum("p").alias("pred_total"), F.sum(F.least("g", "p")).alias("cnt")
    )


def drop_table_prefix(name: Column) -> Column:
    """'t.c' becomes 'c'."""
    return F.when(name.contains("."), F.split(name, r"\.").getItem(1)).otherwise(name)


def component_scores(cnt: Column, pred_total: Column, label_total: Column) -> Column:
    """All or nothing: 1 when both sides have as many units and share them all."""
    return F.when((pred_total == label_total) & (cnt == pred_total), 1).otherwise(0)


def f1(acc: Column, rec: Column) -> Column:
    return F.when(acc + rec == 0, F.lit(0.0)).otherwise(2.0 * acc * rec / F.nullif(acc + rec, F.lit(0)))


def hit(count: Column, total: Column) -> Column:
    """1 when everything was found; serves as accuracy and as recall."""
    return F.when(count == total, 1).otherwise(0)


def exact_match(components: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """Every component scores 1, and the sorted table lists agree where they are given.

    `components(query_id, component, label_total, pred_total, cnt)`,
    `tables(query_id, gold_tables, pred_tables)`.
    """
    score = component_scores(F.col("cnt"), F.col("pred_total"), F.col("label_total"))
    per_query = components.groupBy("query_id").agg(F.min(score).alias("exact"))
    if tables is None:
        return per_query
    same = F.array_sort("gold_tables") == F.array_sort("pred_tables")
    agree = tables.select("query_id", (same | (F.size("gold_tables") == 0)).alias("agree"))
    return per_query.join(agree, "query_id").select(
        "query_id", F.when(F.col("agree"), F.col("exact")).otherwise(0).alias("exact")
    )


def macro_scores(components: DataFrame) -> DataFrame:
    """Mean acc / rec / f1 by level and component, `all` included.

    acc averages over queries that predict the component, rec over those whose gold has
    it. Where both are 0 the f1 is 1, as the scoring rules have it.
    """
    score = component_scores(F.col("cnt"), F.col("pred_total"), F.col("label_total"))
    level = F.when(F.grouping("level") == 1, "all").otherwise(F.col("level"))
    means = components.groupingSets([["component", "level"], ["component"]], "component", "level").agg(
        level.alias("score_level"),
        F.coalesce(F.avg(F.when(F.col("pred_total") > 0, score)), F.lit(0.0)).alias("acc"),
        F.coalesce(F.avg(F.when(F.col("label_total") > 0, score)), F.lit(0.0)).alias("rec"),
    )
    both_zero = (F.col("acc") == 0) & (F.col("rec") == 0)
    return means.select(
        F.col("score_level").alias("level"),
        "component",
        "acc",
        "rec",
        F.when(both_zero, F.lit(1.0)).otherwise(f1(F.col("acc"), F.col("rec"))).alias("f1"),
    )


def report_grid(scores: DataFrame, metric: str, level: str, value: str) -> DataFrame:
    """Metrics as rows, all levels of the data as columns; `scores` has one row for each of both."""
    return scores.groupBy(metric).pivot(level).agg(F.first(value))


def map_equivalent_columns(units: DataFrame, representatives: DataFrame) -> DataFrame:
    """Replace columns by the representative of their reference group.

    `units(db_id, unit, ...)`, `representatives(db_id, unit, representative)`.
    """
    return units.join(representatives, ["db_id", "unit"], "left").withColumn(
        "unit", F.coalesce("representative", "unit")
    ).drop("representative")


def _neutral_words(sql: Column) -> Column:
    """Words of a query without DISTINCT and with a slot for every literal."""
    return F.split(T.slot_text(T.reformat_tokens(T.remove_distinct(T.join_operators(T.collapse_space(sql))))), " ")


def with_neutral_text(df: DataFrame, sql: str, out: str, names: Column | None = None) -> DataFrame:
    """Add a query's neutral text, in which columns stand under their tables' names.

    Names are read block by block, see `scopes.with_resolved_names`.
    """
    worded = df.withColumn("__words", _neutral_words(F.col(sql)))
    placed = with_resolved_names(worded, "__words", "__plain", names)
    return placed.withColumn(out, F.array_join("__plain", " ")).drop("__words", "__plain")


def with_known_names(queries: DataFrame, columns: DataFrame, representatives: DataFrame | None = None) -> DataFrame:
    """Add `names`: the catalog columns both of whose names occur in one of a query's texts.

    `queries(query_id, db_id, sql_gt, sql_pred)`, `columns(db_id, table_name, column_name)`,
    `representatives(db_id, unit, representative)` with units 'table.column', as for
    `map_equivalent_columns`. Names are compared in lower case. A query's list is bounded by its
    texts' words; words meet the catalog in equi-joins by database and name.
    """
    text = F.lower(F.concat_ws(" ", "sql_gt", "sql_pred"))
    worded = queries.select("query_id", "db_id", F.array_distinct(F.regexp_extract_all(text, F.lit(r"\w+"), 0)).alias("words"))
    worded = worded.select("query_id", "db_id", "words", F.explode_outer("words").alias("column")).filter("column is not null")
    known = columns.select("db_id", F.lower("table_name").alias("table"), F.lower("column_name").alias("column")).distinct()
    # The words travel with the row, so whether the table is one of them needs no second join.
    # An inner join might broadcast the words, whose size Spark takes from before they were listed; a left join cannot.
    # The test stands in a generator, for a filter on the table would make the join an inner one again.
    met = worded.join(known, ["db_id", "column"], "left")
    named = F.when(F.array_contains("words", F.col("table")), F.array(F.struct("table", "column")))
    found = met.select("query_id", "db_id", F.inline_outer(named)).filter("table is not null")
    if representatives is None:
        found = found.withColumn("representative", F.lit(None).cast("string"))
    else:
        first = representatives.groupBy("db_id", F.lower("unit").alias("unit")).agg(F.min(F.lower("representative")).alias("representative"))
        found = found.withColumn("unit", F.concat_ws(".", "table", "column")).join(first, ["db_id", "unit"], "left")
    lists = found.groupBy("query_id").agg(F.collect_list(F.struct("table", "column", "representative")).alias("names"))
    return spread(queries.join(lists, "query_id", "left"), like=queries)


def _shared(a: Column, b: Column) -> Column:
    """Size of the bag intersection of two arrays."""

    def times(items: Column, x: Column) -> Column:
        return F.size(F.filter(items, lambda y: y == x))

    return F.aggregate(
        F.array_distinct(a), F.lit(0), lambda acc, x: acc + F.least(times(a, x), times(b, x))
    )


_AGGREGATE = r"\b(?:max|min|count|sum|avg) ?⟦(.*)⟧"
_OPERATOR = r" (?:not )?(?:=|!=|<>|>=|<=|>|<|like|in|between|is)(?: |$).*$"


def _units(c: Column) -> dict[str, Column]:
    """Unit lists of a clause struct. Each sub-query stands in its unit as the digest of its own text."""
    selected = T.split_list(c["select"])
    where = T.split_conditions(c["where"])
    return {
        "select": selected,
        "select(no AGG)": F.transform(selected, lambda x: F.trim(F.regexp_replace(x, _AGGREGATE, "$1"))),
        "where": where,
        "where(no OP)": F.transform(where, lambda x: F.trim(F.regexp_replace(x, _OPERATOR, ""))),
        "group(no Having)": F.transform(T.split_list(c["group_by"]), drop_table_prefix),
        "keywords": T.keyword_set(c),
    }


def _tables(c: Column) -> Column:
    """Table names of a FROM clause, aliases and conditions left out."""
    return F.regexp_extract_all(F.concat(F.lit("join "), c["from"]), F.lit(r"(?:\bjoin|,) ([\w.]+|\{q\w*\})"), 1)


_SET_OPERATION = r" (?:union(?: all)?|intersect|except) (.*)$"


def _same_block(a: Column, b: Column) -> Column:
    """Whether two clause structs match exactly, with units, tables and connectives in any order."""
    bag = lambda items: F.array_sort(items)
    same = (a["set_op"] == b["set_op"]) & (a["having"] == b["having"]) & (a["order_by"] == b["order_by"]) & ((a["limit"] == "") == (b["limit"] == ""))
    for units in (lambda c: T.split_list(c["select"]), lambda c: T.split_conditions(c["where"]), lambda c: T.split_list(c["group_by"]), _tables):
        same = same & (bag(units(a)) == bag(units(b)))
    connectives = lambda c: bag(F.array_distinct(T.connectives(c["where"])))
    return same & (connectives(a) == connectives(b))


def compare_texts(
    queries: DataFrame, columns: DataFrame | None = None, representatives: DataFrame | None = None
) -> DataFrame:
    """Components of each (query_id, sql_gt, sql_pred): label_total, pred_total and cnt.

    Both texts are taken apart inside their row, so nothing is shuffled. Sub-queries are folded
    from the inside out and match when their own neutral text does, wherever their unit stands. The
    side of a set operation matches when its clauses do, units in any order; what follows a second
    one there has to be the same text.

    With the catalog's `columns`, bare names of blocks that read several tables are placed, and
    columns count as equal to their `representatives`; see `with_known_names`. Without, such names
    match as they stand.
    """
    df, names = queries, None
    if columns is not None:
        df, names = with_known_names(queries, columns, representatives), F.col("names")
    for side, column in (("g", "sql_gt"), ("p", "sql_pred")):
        df = with_neutral_text(df, column, f"{side}_text", names)
        df = df.withColumn(f"{side}_outer", T.outer_block(F.col(f"{side}_text"), digests=True))
        df = df.withColumn(f"{side}_c", T.clauses(T.first_block(F.col(f"{side}_outer")), F.col(f"{side}_outer")))
    gold, pred = F.col("g_c"), F.col("p_c")
    # Unit lists are columns of their own: the counting below reads them many times.
    staged = {}
    for side in "gp":
        units = _units(F.col(f"{side}_c"))
        staged |= {f"{side}_u{i}": units[name] for i, name in enumerate(UNIT_LISTS)}
    df = df.withColumns(staged)

    def line(name: str, label: Column, predicted: Column, cnt: Column) -> Column:
        return F.struct(
            F.lit(name).alias("component"), label.cast("int").alias("label_total"),
            predicted.cast("int").alias("pred_total"), cnt.cast("int").alias("cnt"),
        )

    lines = [
        line(name, F.size(f"g_u{i}"), F.size(f"p_u{i}"), _shared(F.col(f"g_u{i}"), F.col(f"p_u{i}")))
        for i, name in enumerate(UNIT_LISTS)
    ]
    has_g, has_p = gold["group_by"] != "", pred["group_by"] != ""
    same_group = has_g & has_p & (gold["group_by"] == pred["group_by"]) & (gold["having"] == pred["having"])
    lines.append(line("group", has_g, has_p, same_group))
    order_g, order_p = gold["order_by"] != "", pred["order_by"] != ""
    same_limit = (gold["limit"] == "") == (pred["limit"] == "")
    lines.append(line("order", order_g, order_p, order_g & (gold["order_by"] == pred["order_by"]) & same_limit))
    ao_g, ao_p = F.array_distinct(T.connectives(gold["where"])), F.array_distinct(T.connectives(pred["where"]))
    same_ao = F.array_sort(ao_g) == F.array_sort(ao_p)
    # A mismatch reports the sizes crosswise with nothing shared, a match counts one of one.
    lines.append(
        line(
            "and/or",
            F.when(same_ao, 1).otherwise(F.size(ao_p)),
            F.when(same_ao, 1).otherwise(F.size(ao_g)),
            F.when(same_ao, 1).otherwise(0),
        )
    )
    set_g, set_p = gold["set_op"] != "", pred["set_op"] != ""
    # What follows a set operation is taken apart only in texts that both have one.
    g_rest, p_rest = (F.regexp_extract(f"{side}_outer", _SET_OPERATION, 1) for side in "gp")
    g_block, p_block = (T.clauses(T.first_block(rest), rest) for rest in (g_rest, p_rest))
    same_last = F.regexp_extract(g_rest, _SET_OPERATION, 1) == F.regexp_extract(p_rest, _SET_OPERATION, 1)
    same_rest = same_last & _same_block(g_block, p_block)
    same_set = set_g & (gold["set_op"] == pred["set_op"]) & same_rest
    lines.append(line("IUEN", set_g, set_p, same_set))
    return df.select(
        *queries.columns,
        F.array(*lines).alias("components"),
        _tables(gold).alias("gold_tables"),
        _tables(pred).alias("pred_tables"),
    )


def exact_match_texts(compared: DataFrame) -> DataFrame:
    """Exact match of each compared text pair, decided inside the row."""
    all_right = F.forall(
        "components",
        lambda c: component_scores(c["cnt"], c["pred_total"], c["label_total"]) == 1,
    )
    # and/or reports its sizes crosswise; a component absent on both sides is right.
    tables = (F.size("gold_tables") == 0) | (F.array_sort("gold_tables") == F.array_sort("pred_tables"))
    return compared.withColumn("exact", (all_right & tables).cast("int"))
