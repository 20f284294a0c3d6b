"""Result comparison over lineitem, orders and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.functions.cells import row_cells
from sqlweave.operators import denotation as D
from sqlweave.operators.ranking import integer_bucket, position
from sqlweave.session import load


def _line_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A supplier's lines as gold result; as prediction the same lines, some doubled,
    some with two columns swapped, some with a changed value."""
    lines = load(spark, sf, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_linenumber"
    )
    kind = F.col("l_suppkey") % 4
    gold = lines.select(
        F.col("l_suppkey").alias("query_id"),
        F.lit(D.GOLD).alias("side"),
        row_cells(lines, ["l_returnflag", "l_linestatus", "l_quantity"]).alias("cells"),
    )
    pred_lines = (
        lines.withColumn("copies", F.when((kind == 1) & (F.col("l_quantity") > 25), 2).otherwise(1))
        .withColumn("a", F.when(kind == 2, F.col("l_linestatus")).otherwise(F.col("l_returnflag")))
        .withColumn("b", F.when(kind == 2, F.col("l_returnflag")).otherwise(F.col("l_linestatus")))
        .withColumn(
            "q",
            F.when((kind == 3) & (F.col("l_linenumber") == 7), F.col("l_quantity") + 0.5).otherwise(
                F.col("l_quantity")
            ),
        )
    )
    pred = pred_lines.select(
        F.col("l_suppkey").alias("query_id"),
        F.lit(D.PRED).alias("side"),
        row_cells(pred_lines, ["a", "b", "q"]).alias("cells"),
        F.explode(F.sequence(F.lit(1), "copies")).alias("copy"),
    ).drop("copy")
    queries = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("query_id"))
    return gold.unionByName(pred), queries


_LINE_SQL = """
with base as (select l_suppkey query_id, l_suppkey % 4 kind, l_returnflag a, l_linestatus b,
                     l_quantity q, l_linenumber n from lineitem),
gold as (select query_id, a, b, q, 1 g, 0 p from base),
pred as (select query_id, case when kind = 2 then b else a end a, case when kind = 2 then a else b end b,
                case when kind = 3 and n = 7 then q + 0.5 else q end q, 0 g,
                case when kind = 1 and q > 25 then 2 else 1 end p from base),
cnt as (select query_id, a, b, q, sum(g) g, sum(p) p from (select * from gold union all select * from pred)
        group by all),
v as (select query_id, bool_and((g > 0) = (p > 0)) set_eq, bool_and(g = p) bag_eq from cnt group by 1)
"""


def set_eq(spark, sf):
    return D.set_equal(*_line_results(spark, sf))


def bag_eq(spark, sf):
    return D.bag_equal(*_line_results(spark, sf))


def shape_check(spark, sf):
    return D.shape_check(*_line_results(spark, sf))


def _order_results(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """A customer's orders by key as gold result. Predictions by customer: unchanged,
    newest first, columns rotated, or columns rotated and newest first."""
    orders = load(spark, sf, "orders").select(
        "o_custkey", "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice"
    )
    bucket = integer_bucket(F.col("o_orderkey"))
    placed = position(orders, ["o_custkey"], [F.col("o_orderkey")], bucket, "n", total="size")
    kind = F.col("o_custkey") % 5
    gold_cells = row_cells(orders, ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    rotated = row_cells(orders, ["o_totalprice", "o_orderstatus", "o_orderpriority"])
    doubled = row_cells(orders, ["o_orderstatus", "o_orderstatus", "o_totalprice"])
    sides = placed.select(
        F.col("o_custkey").alias("query_id"),
        F.explode(
            F.array(
                F.struct(F.lit(D.GOLD).alias("side"), (F.col("n") - 1).alias("row_idx"), gold_cells.alias("cells")),
                F.struct(
                    F.lit(D.PRED).alias("side"),
                    F.when(kind.isin(1, 3), F.col("size") - F.col("n")).otherwise(F.col("n") - 1).alias("row_idx"),
                    F.when(kind.isin(2, 3), rotated).when(kind == 4, doubled).otherwise(gold_cells).alias("cells"),
                ),
            )
        ).alias("r"),
    ).select("query_id", "r.*")
    queries = load(spark, sf, "customer").select(
        F.col("c_custkey").alias("query_id"),
        D.order_matters(
            F.when(F.col("c_custkey") % 2 == 0, "SELECT a, b, c FROM t Order By a").otherwise("SELECT a, b, c FROM t")
        ).alias("ordered"),
    )
    return sides, queries


_ORDER_SQL = """
with q as (select c_custkey query_id, c_custkey % 5 kind, c_custkey % 2 = 0 ordered from customer),
o as (select o_custkey, o_orderkey, o_orderstatus s, o_orderpriority p, o_totalprice t,
             row_number() over (partition by o_custkey order by o_orderkey) n,
             count(*) over (partition by o_custkey) size from orders),
f as (select q.query_id, q.kind, q.ordered, count(o.o_custkey) rows,
             coalesce(bool_and(o.s = m.s and o.p = m.p and o.t = m.t), true) palindrome,
             coalesce(bool_and(list_sort([o.s, o.p]) = list_sort([m.s, m.p]) and o.t = m.t), true) loose
      from q left join o on o.o_custkey = q.query_id
      left join o m on m.o_custkey = o.o_custkey and m.n = o.size + 1 - o.n
      group by all)
"""


def ordered_eq(spark, sf):
    results, queries = _order_results(spark, sf)
    return D.ordered_equal(results, queries).select("query_id", "ordered_eq")


def colperm_eq(spark, sf):
    return D.column_permutation_equal(*_order_results(spark, sf))


def quick_reject(spark, sf):
    return D.quick_reject(*_order_results(spark, sf))


def result_validity(spark, sf):
    """A customer's order totals by order key, with zeros, NULLs and '' injected."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus")
    kind = F.col("o_custkey") % 6
    shaped = orders.withColumn(
        "a",
        F.when(kind == 1, F.lit(0.0)).when(kind == 2, F.lit(None)).otherwise(F.col("o_totalprice")),
    ).withColumn(
        "b", F.when(kind.isin(2, 3), F.lit(None)).when(kind == 4, F.lit("")).otherwise(F.col("o_orderstatus"))
    )
    front = F.when(kind == 4, F.array(F.lit("s:"), F.lit("n:1"))).otherwise(row_cells(shaped, ["a", "b"]))
    results = shaped.select(
        F.col("o_custkey").alias("query_id"),
        F.lit(D.PRED).alias("side"),
        F.col("o_orderkey").alias("row_idx"),
        front.alias("cells"),
    )
    queries = load(spark, sf, "customer").select(F.col("c_custkey").alias("query_id"))
    return D.result_validity(results, queries)


def any_candidate(spark, sf):
    """A user is a query, an event type a candidate; it passes when its events average enough."""
    passed = load(spark, sf, "events").groupBy("user_id", "event_type").agg(
        (F.count(F.when(F.col("value") > 100, 1)) >= 5).alias("passed")
    )
    candidates = passed.select(
        F.col("user_id").alias("query_id"),
        (F.ascii("event_type") + F.length("event_type")).alias("cand_idx"),
        F.concat(F.lit("SELECT "), "event_type", F.lit(" FROM t;")).alias("sql"),
        "passed",
    )
    return D.any_candidate(candidates)


def suite_all(spark, sf):
    """Databases of a suite are weekdays; an event decides whether its candidate fits there."""
    outcomes = load(spark, sf, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("event_type").alias("cand_idx"),
        F.weekday("ts").alias("db_idx"),
        (F.col("value") > 1).alias("gold_ok"),
        (F.col("value") < 250).alias("pred_ok"),
        (F.col("value") != 10).alias("equal"),
    )
    return D.suite_equal(outcomes)


def status_report(spark, sf):
    outcomes = load(spark, sf, "events").select(
        F.col("event_id").alias("question_id"),
        F.col("event_type").isin("purchase", "signup").alias("equal"),
        (F.col("value") > 150).alias("timed_out"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("no such column: k"), F.get_json_object("props", "$.k"))).alias(
            "exception"
        ),
    )
    return D.status_report(outcomes)


def efficiency_ratio(spark, sf):
    timings = load(spark, sf, "events").select(
        F.col("user_id").alias("query_id"),
        F.col("event_id").alias("run"),
        (F.col("value") + 1.0).alias("t_gold"),
        (F.get_json_object("props", "$.k").cast("double") + 1.0).alias("t_pred"),
        (F.col("user_id") % 7 != 0).alias("equal"),
    )
    scored = D.efficiency_ratio(timings)
    return scored.select("query_id", F.round("time_ratio", 6).alias("time_ratio"), "runs_kept")


QUERIES = {
    "set_eq": (
        set_eq,
        _LINE_SQL + "select s_suppkey query_id, coalesce(set_eq, true) set_eq from supplier left join v on query_id = s_suppkey",
    ),
    "bag_eq": (
        bag_eq,
        _LINE_SQL + "select s_suppkey query_id, coalesce(bag_eq, true) bag_eq from supplier left join v on query_id = s_suppkey",
    ),
    "shape_check": (
        shape_check,
        """with c as (select s_suppkey query_id, count(l_suppkey) g,
        sum(case when l_suppkey % 4 = 1 and l_quantity > 25 then 2 when l_suppkey is not null then 1 else 0 end)::bigint p
        from supplier left join lineitem on l_suppkey = s_suppkey group by 1)
        select query_id, g gold_rows, p pred_rows, case when g > 0 then 3 else 0 end gold_width,
        case when p > 0 then 3 else 0 end pred_width, g = p shape_eq from c""",
    ),
    "ordered_eq": (
        ordered_eq,
        _ORDER_SQL + """select query_id, case kind when 0 then true when 1 then palindrome
        else rows = 0 end ordered_eq from f""",
    ),
    "colperm_eq": (
        colperm_eq,
        _ORDER_SQL + """select query_id, ordered, case kind when 4 then rows = 0
        when 1 then not ordered or palindrome when 3 then not ordered or palindrome else true end colperm_eq from f""",
    ),
    "quick_reject": (
        quick_reject,
        _ORDER_SQL + """select query_id, ordered, case kind when 4 then rows = 0
        when 1 then not ordered or loose when 3 then not ordered or loose else true end may_match from f""",
    ),
    "result_validity": (
        result_validity,
        """select c_custkey query_id, case when count(o_orderkey) = 0 or c_custkey % 6 in (1, 2, 4)
        then 0 else 1 end valid from customer left join orders on o_custkey = c_custkey group by c_custkey""",
    ),
    "any_candidate": (
        any_candidate,
        """with p as (select user_id, event_type, count(*) filter (value > 100) >= 5 ok,
        ascii(event_type) + length(event_type) idx from events group by all),
        r as (select *, row_number() over (partition by user_id order by (not ok), idx) n,
              max(ok::int) over (partition by user_id) res from p)
        select user_id query_id, res, 'SELECT ' || event_type || ' FROM t;' final_sql from r where n = 1""",
    ),
    "suite_all": (
        suite_all,
        """with c as (select user_id, event_type, bool_and(value < 250 and value <> 10) eq, bool_and(value > 1) gold
        from events group by all)
        select user_id query_id, max((eq and gold)::int) res,
        case when bool_and(gold) then 'ok' else 'gold failed' end status from c group by 1""",
    ),
    "status_report": (
        status_report,
        """select event_id question_id, (event_type in ('purchase', 'signup') and value <= 150)::int res,
        event_type = 'error' and value <= 150 error, value > 150 timeout,
        case when event_type = 'error' and value <= 150 then 'no such column: k' || json_extract_string(props, '$.k')
        when event_type in ('purchase', 'signup') and value <= 150 then null else 'runnable but wrong' end error_msg
        from events""",
    ),
    "efficiency_ratio": (
        efficiency_ratio,
        """with r as (select user_id, (value + 1.0::double) / (json_extract_string(props, '$.k')::double + 1.0) ratio from events),
        s as (select user_id, avg(ratio) m, stddev_pop(ratio) sd from r group by 1)
        select user_id query_id, round(case when user_id % 7 <> 0 then avg(ratio) else 0.0 end, 6) time_ratio,
        count(*) runs_kept from r join s using (user_id) where sd = 0 or abs(ratio - m) < 3 * sd group by 1""",
    ),
}
