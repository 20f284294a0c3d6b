"""The SQL constructs users write, one query each, and execution of query pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.operators import candidates, execution
from sqlweave.session import load, scratch_path
from sqlweave.sources import readers, writers
from sqlweave.plans.bindings import questions

TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents")


def _views(spark: SparkSession, sf: str) -> None:
    for table in TABLES:
        load(spark, sf, table).createOrReplaceTempView(table)


def _sql(text: str):
    def build(spark: SparkSession, sf: str) -> DataFrame:
        _views(spark, sf)
        return spark.sql(text.rstrip().rstrip(";"))

    return build


CONSTRUCTS = {
    "sql_projection": "SELECT o_orderkey, o_orderpriority AS priority FROM orders",
    "sql_star": "SELECT * FROM supplier",
    "sql_distinct": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "sql_aggregates": """SELECT l_returnflag, max(l_quantity) AS hi, min(l_quantity) AS lo, count(*) AS n,
        round(sum(l_extendedprice), 2) AS total, round(avg(l_discount), 6) AS disc,
        count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY l_returnflag""",
    "sql_arithmetic": """SELECT o_orderkey, o_totalprice * 2 - o_custkey AS a,
        o_totalprice / (o_custkey + 1) AS b FROM orders""",
    "sql_alias_self_join": """SELECT T1.o_orderkey AS k, T1.o_orderstatus AS s1, T2.o_orderstatus AS s2
        FROM orders AS T1 JOIN orders AS T2 ON T1.o_orderkey = T2.o_orderkey - 1 AND T1.o_orderpriority = T2.o_orderpriority""",
    "sql_join_chain": """SELECT n_name, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
        FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        AND l_shipdate > o_orderdate JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
    "sql_derived_table": """SELECT t.l_suppkey, t.q FROM (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem
        GROUP BY l_suppkey) AS t WHERE t.q > 100""",
    "sql_predicates": """SELECT p_partkey FROM part WHERE p_size >= 10 AND p_size < 40 AND p_size != 20
        AND p_retailprice > 905 AND p_type = 'ECONOMY'""",
    "sql_between": "SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 50000",
    "sql_in_subquery": """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders
        WHERE o_totalprice > 300000)""",
    "sql_is_null": """SELECT count(*) AS n FROM (SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders
        ON c_custkey = o_custkey) AS t WHERE o_orderkey IS NULL OR c_custkey IS NOT NULL""",
    "sql_exists": """SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey
        AND l_quantity >= 50)""",
    "sql_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "sql_and_or": """SELECT event_id FROM events WHERE event_type = 'click' AND value > 10 OR event_type = 'error'
        AND value < 5""",
    "sql_group_having": """SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY o_custkey
        HAVING count(*) > 12""",
    "sql_top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "sql_intersect": "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders",
    "sql_union": "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 UNION SELECT p_partkey FROM part WHERE p_size > 45",
    "sql_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 100000",
    "sql_nested_blocks": """SELECT p_brand, count(*) AS n FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem
        WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')) GROUP BY p_brand ;""",
    "sql_cte": """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey)
        SELECT c_mktsegment, round(sum(s), 2) AS total FROM spent JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment""",
}

# LIKE ignores case in the queries users bring, so the engine side uses ILIKE.
_LIKE = "SELECT p_partkey, p_name FROM part WHERE p_name {} '%RING%' AND p_name NOT {} 'red%'"

# NOT IN makes Spark broadcast the sub-query whatever its size. The same meaning without that:
# no match, and no NULL on either side.
_NOT_IN = """SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderstatus = 'F' AND o_custkey = c_custkey)
    AND (SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_custkey IS NULL) = 0"""
_PLAIN_NOT_IN = """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders
    WHERE o_orderstatus = 'F')"""

# (gold, prediction) pairs over the tables: right, reordered, doubled, wrong, broken.
PAIRS = [
    ("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey", "SELECT o_custkey, count(o_orderkey) AS n FROM orders GROUP BY o_custkey"),
    ("SELECT DISTINCT l_suppkey FROM lineitem", "SELECT l_suppkey FROM lineitem"),
    ("SELECT event_id FROM events WHERE value > 5", "SELECT event_id FROM events WHERE value >= 6"),
    ("SELECT p_brand FROM part", "SELECT p_brandname FROM part"),
    ("SELECT s_name FROM supplier WHERE s_acctbal < -99999", "SELECT s_name, s_acctbal FROM supplier WHERE s_acctbal < -99999"),
    ("SELECT c_custkey FROM customer ORDER BY c_custkey", "SELECT c_custkey FROM customer ORDER BY c_custkey DESC"),
]


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    _views(spark, sf)
    rows = [(i, None, gold, pred) for i, (gold, pred) in enumerate(PAIRS)]
    return spark.createDataFrame(rows, "query_id bigint, db_id string, sql_gt string, sql_pred string")


def _graded(spark: SparkSession, sf: str, ordered_family: bool) -> DataFrame:
    graded = execution.grade_pairs(_pairs(spark, sf), ordered_family)
    message = F.when(F.col("error"), "failed").otherwise(F.col("error_msg"))
    return graded.select("query_id", "res", "error", "timeout", message.alias("error_msg"))


def execute_pairs(spark, sf):
    return _graded(spark, sf, ordered_family=False)


def execute_pairs_ordered(spark, sf):
    return _graded(spark, sf, ordered_family=True)


def timed_pairs(spark, sf):
    """Both statements of every pair run in turns, twice each; seconds differ from run to run, so only their use is told."""
    timed = execution.timed_pairs(_pairs(spark, sf), repeats=2)
    return timed.select("query_id", (F.col("time_ratio") > 0).alias("timed"), "runs_kept")


def _pairs_sql(ordered_family: bool) -> str:
    parts = []
    for i, (gold, pred) in enumerate(PAIRS):
        if "p_brandname" in pred:
            parts.append(f"select {i}::bigint query_id, 0 res, true error, 'failed' error_msg")
            continue
        if i == 4:
            equal = f"not exists ({gold}) and not exists ({pred})"
        elif ordered_family and "ORDER BY" in gold:
            equal = "(select count(*) < 2 from customer)"
        else:
            word = "except all" if ordered_family else "except"
            equal = f"not exists (({gold}) {word} ({pred})) and not exists (({pred}) {word} ({gold}))"
        wrong = "runnable but wrong order" if ordered_family else "runnable but wrong"
        parts.append(
            f"select {i}::bigint query_id, ({equal})::int res, false error, case when not ({equal}) then '{wrong}' end error_msg"
        )
    return f"select query_id, res, error, false timeout, error_msg from ({' union all '.join(parts)})"


# (gold, prediction) pairs whose prediction has other literals, and the fillings tried in their order.
SLOTTED = [
    ("SELECT count(*) FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 70000", "SELECT count(*) FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 1"),
    ("SELECT o_custkey, count(*) FROM orders WHERE o_totalprice > 3 GROUP BY o_custkey", "SELECT o_custkey, count(*) FROM orders WHERE o_totalprice > 3 GROUP BY o_custkey"),
    ("SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = 'F'", "SELECT min(o_totalprice) FROM orders WHERE o_orderstatus = 'O'"),
    ("SELECT count(nothing) FROM orders WHERE o_custkey > 3", "SELECT count(*) FROM orders WHERE o_custkey > 3"),
    ("SELECT count(*) FROM orders WHERE o_custkey BETWEEN 2 AND 60", "SELECT count(*) FROM orders WHERE o_custkey >= 10 AND o_custkey <= 20 AND o_orderkey >= 0"),
]
CANDIDATES = [
    [SLOTTED[0][1], *[f"SELECT count(*) FROM orders WHERE o_orderstatus = {a} AND o_totalprice > {b}" for b in ("'F'", "70000") for a in ("'F'", "70000")]],
    [SLOTTED[1][1]],
    [SLOTTED[2][1], "SELECT min(o_totalprice) FROM orders WHERE o_orderstatus = 'F'"],
    [],
    [SLOTTED[4][1], *[f"SELECT count(*) FROM orders WHERE o_custkey >= {a} AND o_custkey <= {b} AND o_orderkey >= {c}" for c in (2, 60) for b in (2, 60) for a in (2, 60)]],
]
SUITE = 3


def _slotted(spark: SparkSession) -> DataFrame:
    rows = [(i, "all", gold, pred) for i, (gold, pred) in enumerate(SLOTTED)]
    return spark.createDataFrame(rows, "query_id bigint, db_id string, sql_gt string, sql_pred string")


def candidate_run(spark, sf):
    """Fillings of five predictions, run until one gives the gold result on all orders."""
    _views(spark, sf)
    return candidates.first_passing(_slotted(spark)).select("query_id", "res", F.col("cand_idx").cast("int").alias("cand_idx"), "gold_failed")


def suite_run(spark, sf):
    """The same on three databases, each with the orders of a third of all customers."""
    sessions = {}
    for number in range(SUITE):
        part = sessions[f"part_{number}"] = spark.newSession()
        load(part, sf, "orders").filter(F.col("o_custkey") % SUITE == number).createOrReplaceTempView("orders")
    asked = _slotted(spark)
    databases = asked.select("query_id", F.posexplode(F.array(*[F.lit(name) for name in sessions])).alias("db_no", "db_id"))
    found = candidates.first_passing(asked, databases, session_for=sessions.__getitem__)
    return found.select("query_id", "res", F.col("cand_idx").cast("int").alias("cand_idx"), "gold_failed")


def _candidates_sql(parts: list[str]) -> str:
    """The first candidate in order that differs from the gold result on none of `parts`, conditions on the orders."""
    rows = []
    for i, ((gold, _), texts) in enumerate(zip(SLOTTED, CANDIDATES)):
        if not texts:
            rows.append(f"select {i}::bigint query_id, null::int cand_idx, true gold_failed")
        for number, sql in enumerate(texts):
            # A text compared with a number is an error in either engine or equals none.
            if "o_orderstatus = 7" in sql or "o_totalprice > 'F'" in sql:
                continue
            on = lambda text, part: text.replace("FROM orders", f"FROM (SELECT * FROM orders WHERE {part})")  # noqa: E731, B023
            same = " and ".join(
                f"not exists (({on(gold, p)}) except all ({on(sql, p)})) and not exists (({on(sql, p)}) except all ({on(gold, p)}))" for p in parts
            )
            rows.append(f"select {i}::bigint query_id, case when {same} then {number} end cand_idx, false gold_failed")
    return f"""select query_id, (min(cand_idx) is not null)::int res, min(cand_idx) cand_idx, bool_or(gold_failed) gold_failed
        from ({" union all ".join(rows)}) group by query_id"""


def session_files(spark, sf):
    """Every document as a session file: lines are turns, a blank line ends a session."""
    lines = load(spark, sf, "documents").select(
        "doc_id", F.posexplode(F.split(F.regexp_replace("text", r"\. ?\n", ".\n\n"), "\n")).alias("line_no", "line")
    )
    return readers.sessions(lines.withColumn("line_no", F.col("line_no").cast("long")), ["doc_id"])


def question_files(spark, sf):
    """Questions written as JSON lines and read back, some without evidence."""
    asked = questions(spark, sf).select(
        "question_id", "db_id", F.concat("question", F.lit(" é")).alias("question"),
        F.when(F.col("evidence") != "", F.col("evidence")).alias("evidence"), F.col("sql").alias("SQL"),
    )
    path = scratch_path(spark)
    writers.write_json(asked, path)
    return readers.read_questions(spark, path, lines=True).select("question_id", "db_id", "question", "evidence")


QUERIES = {name: (_sql(text), text.rstrip().rstrip(";")) for name, text in CONSTRUCTS.items()} | {
    "sql_not_in": (_sql(_NOT_IN), _PLAIN_NOT_IN),
    "sql_like": (_sql(_LIKE.format("ILIKE", "ILIKE")), _LIKE.format("ilike", "ilike")),
    "execute_pairs": (execute_pairs, _pairs_sql(False)),
    "execute_pairs_ordered": (execute_pairs_ordered, _pairs_sql(True)),
    "timed_pairs": (
        timed_pairs,
        f"select query_id, res = 1 timed, case when error then 0 else 2 end::bigint runs_kept from ({_pairs_sql(False)})",
    ),
    "candidate_run": (candidate_run, _candidates_sql(["true"])),
    "suite_run": (suite_run, _candidates_sql([f"o_custkey % {SUITE} = {n}" for n in range(SUITE)])),
    "session_files": (
        session_files,
        r"""with s as (select doc_id, string_split(regexp_replace(text, '\. ?\n', chr(46) || chr(10) || chr(10), 'g'), chr(10)) ls from documents),
        l as (select doc_id, unnest(range(0, len(ls))) line_no, unnest(ls) line from s),
        b as (select *, length(trim(regexp_replace(line, '\s+', ' ', 'g'), ' ')) = 0 blank from l),
        r as (select *, sum(blank::int) over w sid, coalesce(max(case when blank then line_no end) over w, -1) st from b
              window w as (partition by doc_id order by line_no))
        select doc_id, sid::bigint session_id, line_no - st turn, string_split(trim(line, ' '), chr(9))[1] "sql",
        string_split(trim(line, ' '), chr(9))[2] db_id from r where not blank""",
    ),
    "question_files": (
        question_files,
        """with e as (select event_id, user_id, event_type, json_extract_string(props, '$.k')::int k from events)
        select event_id question_id, 'db_' || user_id db_id, 'How many ' || event_type || ' events have key ' || k || '? é' question,
        case when k % 2 = 0 then 'key ' || k || ' means ' || event_type else '' end evidence from e""",
    ),
}
