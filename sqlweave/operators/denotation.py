"""Is a predicted result equal to the gold result? All queries are compared in one job.

Input in long form: `results(query_id, side, row_idx, cells)` with side 'gold' or
'pred' and canonical cells (see functions.cells). Each equality counts, per
distinct row, how often either side has it; the counts combine before the shuffle,
so one query holding most of the rows is no hot spot. `queries(query_id, ...)`
lists every query asked, because a query whose two results are empty leaves no
rows behind and still counts as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sqlweave.operators.ranking import position
from sqlweave.session import materialise

GOLD, PRED = "gold", "pred"

# Partial column mappings of a query taken on per round; the others wait for a later one.
MAPPINGS_AT_ONCE = 32


def _is(side: str) -> Column:
    return F.when(F.col("side") == side, 1).otherwise(0)


def _counts(results: DataFrame, *keys: str | Column) -> DataFrame:
    return results.groupBy("query_id", *keys).agg(
        F.sum(_is(GOLD)).alias("gold_n"), F.sum(_is(PRED)).alias("pred_n")
    )


def _per_query(queries: DataFrame, verdicts: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Verdicts of all queries, with the value for 'no rows on either side' filled in."""
    return queries.join(verdicts, "query_id", "left").fillna(defaults)


def set_equal(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Same set of rows; duplicates and order ignored. Two empty results are equal."""
    verdict = (
        _counts(results, "cells")
        .groupBy("query_id")
        .agg(F.bool_and((F.col("gold_n") > 0) == (F.col("pred_n") > 0)).alias("set_eq"))
    )
    return _per_query(queries, verdict, {"set_eq": True})


def bag_equal(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Same rows with the same multiplicities; order ignored."""
    verdict = (
        _counts(results, "cells")
        .groupBy("query_id")
        .agg(F.bool_and(F.col("gold_n") == F.col("pred_n")).alias("bag_eq"))
    )
    return _per_query(queries, verdict, {"bag_eq": True})


def ordered_equal(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Same row at every position. `row_idx` is dense on each side."""
    verdict = (
        _counts(results, "row_idx", "cells")
        .groupBy("query_id")
        .agg(F.bool_and(F.col("gold_n") == F.col("pred_n")).alias("ordered_eq"))
    )
    return _per_query(queries, verdict, {"ordered_eq": True})


def order_matters(sql: Column) -> Column:
    """Row order is compared when the gold text asks for one."""
    return F.lower(sql).contains("order by")


def shape_check(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Row counts and widths of both sides, and whether they agree."""
    width = F.size("cells")
    shapes = results.groupBy("query_id").agg(
        F.sum(_is(GOLD)).alias("gold_rows"),
        F.sum(_is(PRED)).alias("pred_rows"),
        F.coalesce(F.max(F.when(F.col("side") == GOLD, width)), F.lit(0)).alias("gold_width"),
        F.coalesce(F.max(F.when(F.col("side") == PRED, width)), F.lit(0)).alias("pred_width"),
    )
    zeros = {c: 0 for c in ("gold_rows", "pred_rows", "gold_width", "pred_width")}
    same = (F.col("gold_rows") == F.col("pred_rows")) & (F.col("gold_width") == F.col("pred_width"))
    return _per_query(queries, shapes, zeros).withColumn("shape_eq", same)


def _order_key(ordered: Column) -> Column:
    return F.when(ordered, F.col("row_idx"))


def quick_reject(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Necessary condition: rows with their cells sorted must agree.

    `queries` carries `ordered`. Row sets are compared, or rows by position when
    order matters; `may_match` false proves the results differ.
    """
    keyed = results.join(queries.select("query_id", "ordered"), "query_id")
    counts = _counts(
        keyed, _order_key(F.col("ordered")).alias("at"), F.array_sort("cells").alias("cells")
    )
    verdict = counts.groupBy("query_id").agg(
        F.bool_and((F.col("gold_n") > 0) == (F.col("pred_n") > 0)).alias("may_match")
    )
    return _per_query(queries, verdict, {"may_match": True})


def permute_cells(cells: Column, permutation: Column) -> Column:
    """Reorder the cells of a row; `permutation` holds 0-based source positions."""
    return F.transform(permutation, lambda i: F.get(cells, i))


def _own_column(pair: Column) -> Column:
    return F.when(F.col("side") == GOLD, pair["gold"]).otherwise(pair["pred"])


def _column_classes(stated: DataFrame) -> DataFrame:
    """Columns not mapped yet, by what they hold: (query_id, turn, print, golds, preds).

    `stated` are rows with `turn` and `mapping` of a state of their query.

    A column's print is the multiset of its cells, each tagged with its row: the cells of
    the mapped columns in their order and the other cells without one. Under every right
    mapping that extends the state a gold column and its pred column have equal prints.
    `preds` carry `content`, equal for pred columns that are equal cell by cell.
    """
    used = F.transform("mapping", _own_column)
    filled = F.transform("cells", lambda c: F.coalesce(c, F.lit("")))
    numbered = stated.select(
        "query_id",
        "turn",
        "side",
        "row_idx",
        "at",
        used.alias("used"),
        F.transform(filled, lambda c, i: F.struct(i.alias("col"), c.alias("cell"))).alias("numbered"),
    )
    free = F.filter("numbered", lambda x: ~F.array_contains("used", x["col"]))
    mapped = F.transform("used", lambda i: F.get("numbered", i)["cell"])
    tag = F.xxhash64("at", mapped, F.array_sort(F.transform(free, lambda x: x["cell"])))
    cell = numbered.select("query_id", "turn", "side", "row_idx", tag.alias("tag"), F.explode(free).alias("x"))

    def total(*parts: Column | str) -> Column:
        return F.sum(F.xxhash64(*parts).cast("decimal(38,0)"))

    columns = cell.groupBy("query_id", "turn", "side", F.col("x.col").alias("col")).agg(
        total("x.cell", "tag").alias("print"), total("x.cell", "row_idx").alias("content")
    )
    gold = F.when(F.col("side") == GOLD, F.col("col"))
    pred = F.when(F.col("side") == PRED, F.struct("content", "col"))
    return columns.groupBy("query_id", "turn", "print").agg(
        F.array_sort(F.collect_list(gold)).alias("golds"), F.array_sort(F.collect_list(pred)).alias("preds")
    )


def _extended(stated: DataFrame, states: DataFrame) -> DataFrame:
    """Every way to take each state on, (query_id, width, mapping); states that cannot be right leave none.

    A class of one column, or of pred columns that are all equal, leaves no choice and is
    mapped at once. Of the others the smallest gives its first gold column to each
    different pred column of the class.
    """
    contents = F.array_distinct(F.transform("preds", lambda p: p["content"]))
    pairs = F.transform(
        F.arrays_zip("golds", "preds"), lambda z: F.struct(z["golds"].alias("gold"), z["preds"]["col"].alias("pred"))
    )
    fixed = F.size(contents) == 1
    steps = (
        _column_classes(stated)
        .groupBy("query_id", "turn")
        .agg(
            F.bool_and(F.size("golds") == F.size("preds")).alias("possible"),
            F.flatten(F.collect_list(F.when(fixed, pairs))).alias("sure"),
            F.min(F.when(~fixed, F.struct(F.size(contents), "golds", "preds"))).alias("open"),
        )
        .filter("possible")
    )
    different = F.filter(
        "open.preds", lambda p: ~F.exists("open.preds", lambda o: (o["content"] == p["content"]) & (o["col"] < p["col"]))
    )
    gold = F.get("open.golds", F.lit(0))
    choices = F.when(
        F.col("open").isNotNull(),
        F.transform(different, lambda p: F.array(F.struct(gold.alias("gold"), p["col"].alias("pred")))),
    ).otherwise(F.array(F.slice("sure", 1, 0)))
    return steps.join(states, ["query_id", "turn"]).select(
        "query_id", "width", F.explode(F.transform(choices, lambda c: F.concat("mapping", "sure", c))).alias("mapping")
    )


def _fitting(rows: DataFrame, complete: DataFrame) -> DataFrame:
    """query_id of the queries one of whose complete mappings makes the two results equal, row by row."""
    sources = F.transform(F.array_sort("mapping"), lambda m: m["pred"])
    arranged = rows.join(complete.select("query_id", sources.alias("permutation")), "query_id").withColumn(
        "cells",
        F.when(F.col("side") == PRED, permute_cells(F.col("cells"), F.col("permutation"))).otherwise(F.col("cells")),
    )
    return (
        _counts(arranged, "permutation", "at", "cells")
        .groupBy("query_id", "permutation")
        .agg(F.bool_and(F.col("gold_n") == F.col("pred_n")).alias("fits"))
        .filter("fits")
        .select("query_id")
        .distinct()
    )


def column_permutation_equal(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Does some order of the pred columns make the results equal?

    `queries` carries `ordered`: rows are compared by position where it is true, as a
    bag elsewhere. Cheap necessary conditions come first. Then mappings of the surviving
    queries grow in rounds, all queries at once: each query takes its longest partial
    mappings on by the columns its rows now tell apart and keeps the other choices for
    later, so that at most MAPPINGS_AT_ONCE x width^2 of a query wait; complete ones are
    checked row by row. Columns that can trade places cost one choice, not every order of them, and a
    query ends with its first fit. No mapping that could fit is left out.
    """
    keyed = results.join(queries.select("query_id", "ordered"), "query_id").withColumn(
        "at", _order_key(F.col("ordered"))
    )
    sorted_rows = _counts(keyed, "at", F.array_sort("cells").alias("cells"))
    survivors = (
        sorted_rows.groupBy("query_id")
        .agg(F.bool_and(F.col("gold_n") == F.col("pred_n")).alias("alive"))
        .filter("alive")
        .select("query_id")
    )
    rows = materialise(
        keyed.join(survivors, "query_id", "left_semi").select("query_id", "side", "row_idx", "at", "cells")
    )
    nothing = F.expr("cast(array() as array<struct<gold:int,pred:int>>)")
    first = rows.groupBy("query_id").agg(F.max(F.size("cells")).alias("width"))
    fitting = first.filter(F.col("width") == 0).select("query_id")
    first = first.filter(F.col("width") > 0).withColumns({"turn": F.lit(1), "mapping": nothing})
    states = _extended(rows.withColumns({"turn": F.lit(1), "mapping": nothing}), first)
    is_complete = F.size("mapping") == F.col("width")
    longest = Window.partitionBy("query_id").orderBy(F.desc(F.size("mapping")), "mapping")
    while True:
        states = materialise(states)
        left = states.agg(F.bool_or(is_complete).alias("complete"), F.bool_or(~is_complete).alias("partial")).first()
        partial = states.filter(~is_complete)
        if left["complete"]:
            found = _fitting(rows, states.filter(is_complete))
            if left["partial"]:
                found = materialise(found)
                partial = partial.join(found, "query_id", "left_anti")
            fitting = fitting.union(found)
        if not left["partial"]:
            break
        placed = partial.withColumn("turn", F.row_number().over(longest))
        now = placed.filter(F.col("turn") <= MAPPINGS_AT_ONCE)
        later = placed.filter(F.col("turn") > MAPPINGS_AT_ONCE).drop("turn")
        states = _extended(rows.join(now, "query_id"), now).unionByName(later)
    seen = results.select("query_id").distinct().withColumn("has_rows", F.lit(True))
    return (
        queries.join(fitting.withColumn("fits", F.lit(True)), "query_id", "left")
        .join(seen, "query_id", "left")
        .withColumn("colperm_eq", F.coalesce("fits", F.col("has_rows").isNull()))
        .drop("fits", "has_rows")
    )


def result_validity(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Plausibility of a result when there is no gold one.

    0 for no rows, for a first cell that is zero, NULL or '', and for a result
    holding nothing but NULLs; 1 otherwise.
    """
    first = F.min_by("cells", "row_idx")
    stats = (
        results.filter(F.col("side") == PRED)
        .groupBy("query_id")
        .agg(
            first.alias("first"),
            F.bool_and(F.forall("cells", lambda c: c.isNull())).alias("all_null"),
        )
        .withColumn("head", F.try_element_at("first", F.lit(1)))
        .select(
            "query_id",
            F.when(F.col("all_null") | F.col("head").isNull() | F.col("head").isin("n:0", "s:"), 0)
            .otherwise(1)
            .alias("valid"),
        )
    )
    return _per_query(queries, stats, {"valid": 0})


def any_candidate(candidates: DataFrame) -> DataFrame:
    """Pass when any candidate passes; report the first passing one, else candidate 0."""
    first = F.min_by("sql", F.struct((~F.col("passed")).alias("failed"), F.col("cand_idx")))
    return candidates.groupBy("query_id").agg(
        F.max(F.col("passed").cast("int")).alias("res"), first.alias("final_sql")
    )


def suite_equal(outcomes: DataFrame) -> DataFrame:
    """A candidate must match on every database; a query needs one such candidate.

    `outcomes(query_id, cand_idx, db_idx, gold_ok, pred_ok, equal)`. Where the gold
    query itself fails, the status says so and the query does not pass.
    """
    per_candidate = outcomes.groupBy("query_id", "cand_idx").agg(
        F.bool_and(F.col("pred_ok") & F.col("equal")).alias("all_equal"),
        F.bool_and("gold_ok").alias("gold_ok"),
    )
    return per_candidate.groupBy("query_id").agg(
        F.max((F.col("all_equal") & F.col("gold_ok")).cast("int")).alias("res"),
        F.when(F.bool_and("gold_ok"), "ok").otherwise("gold failed").alias("status"),
    )


# Messages stored with a failed attempt.
MESSAGE_WRONG = "runnable but wrong"
MESSAGE_WRONG_ORDER = "runnable but wrong order"


def status_report(outcomes: DataFrame, ordered_family: bool = False) -> DataFrame:
    """res / error / timeout / error_msg of every attempt.

    `outcomes` carries `equal` (boolean), `timed_out` (boolean) and `exception`
    (text or NULL).
    """
    message = MESSAGE_WRONG_ORDER if ordered_family else MESSAGE_WRONG
    failed = F.col("exception").isNotNull() & ~F.col("timed_out")
    ran = ~failed & ~F.col("timed_out")
    res = F.when(ran & F.col("equal"), 1).otherwise(0)
    return outcomes.select(
        *[c for c in outcomes.columns if c not in ("equal", "timed_out", "exception")],
        res.alias("res"),
        failed.alias("error"),
        F.col("timed_out").alias("timeout"),
        F.when(failed, F.col("exception")).when(res == 0, message).alias("error_msg"),
    )


def efficiency_ratio(timings: DataFrame) -> DataFrame:
    """Mean of gold time / pred time over a query's runs after a three-sigma cut.

    `timings(query_id, run, t_gold, t_pred, equal)`; 0 where the results differ. Runs
    of equal ratio have no spread and are all kept.
    """
    ratio = timings.select("query_id", "equal", (F.col("t_gold") / F.col("t_pred")).alias("ratio"))
    spread = ratio.groupBy("query_id").agg(
        F.avg("ratio").alias("mean"), F.stddev_pop("ratio").alias("sigma")
    )
    kept = ratio.join(spread, "query_id").filter(
        (F.col("sigma") == 0) | (F.abs(F.col("ratio") - F.col("mean")) < 3 * F.col("sigma"))
    )
    return kept.groupBy("query_id").agg(
        F.when(F.bool_and("equal"), F.avg("ratio")).otherwise(0.0).alias("time_ratio"),
        F.count(F.lit(1)).alias("runs_kept"),
    )


def dense_rows(results: DataFrame) -> DataFrame:
    """Replace increasing row ids (partition number in the high bits) by 0-based positions."""
    placed = position(
        results, ["query_id", "side"], [F.col("row_idx")], F.shiftright("row_idx", 33), out="__pos"
    )
    return placed.withColumn("row_idx", F.col("__pos") - 1).drop("__pos")
