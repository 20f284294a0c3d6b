"""Run batches of user queries on Spark and store their results in long form.

SQL text can only be submitted by the driver, so the driver does just that: a
bounded pool of threads submits statements, every result goes straight from the
executors to the shared folder, and only one status row per statement comes back.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, Future, ThreadPoolExecutor, wait
from functools import cache

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from sqlweave.functions.cells import row_cells
from sqlweave.functions.text import FIXED_YEAR
from sqlweave.operators import denotation as D
from sqlweave.session import materialise, scratch_path

STATUS_DDL = "query_id bigint, side string, ok boolean, timed_out boolean, exception string, seconds double"
RESULT_DDL = "query_id bigint, side string, row_idx bigint, cells array<string>"
# Status rows written together.
STATUS_BATCH = 1000

SessionFor = Callable[[str | None], SparkSession]

_QUOTED = re.compile(r"""('(?:[^']|'')*'|"(?:[^"]|"")*"|`[^`]*`)""")
_SPLIT_OPERATOR = re.compile(r"([<>!]) =")
_CURRENT_YEAR = re.compile(r"\bYEAR\s*\(\s*CURDATE\s*\(\s*\)\s*\)", re.I)
_LIKE = re.compile(r"\bLIKE\b", re.I)
_OPERAND = r"(?:\b(?:count|sum|min|max)\s*)?\(\s*(?:distinct\s+)?(?:(?:\w+\.)?\w+|\*)\s*\)|(?:\w+\.)?\w+"
_QUOTIENT = re.compile(rf"(?<![\w.])({_OPERAND})\s*/\s*({_OPERAND})(?![\w.(])", re.I)
# A word in front of a parenthesis calls a function, unless it is one of these.
_BEFORE_VALUE = re.compile(r"\b(?:select|distinct|where|and|or|not|on|by|having|when|then|else|between|like|all)$|\W$|^$", re.I)
_CALL = re.compile(r"(\w*)\s*\(\s*(?:distinct\s+)?([\w.]+|\*)\s*\)", re.I)


def integral_columns(session: SparkSession) -> set[str]:
    """Lower-cased column names that are whole numbers in every table of the session that has them."""
    whole, other = set(), set()
    for table in session.catalog.listTables():
        for name, kind in session.table(table.name).dtypes:
            (whole if kind in ("tinyint", "smallint", "int", "bigint") else other).add(name.lower())
    return whole - other


def compatible(sql: str, integral: Callable[[], set[str]] = set) -> str:
    """A statement as Spark has to read it, changed by text only and never inside quotes.

    Comparison operators split by a space are joined, the current year is the fixed one, LIKE
    ignores case, and a quotient of two whole numbers is a whole number: of digits, whole-number
    columns, either of them in parentheses, counts, and sums, minima and maxima of such columns.
    A quotient that stands behind another product, or whose types the text cannot tell, stays.
    """

    def is_whole(operand: str) -> bool:
        call = _CALL.fullmatch(operand)
        if call and call[1].lower() == "count":
            return True
        if call and call[1].lower() in ("", "sum", "min", "max"):
            return is_whole(call[2])
        return operand.isdigit() or operand.rpartition(".")[2].lower() in integral()

    def quotient(m: re.Match) -> str:
        before = m.string[: m.start()].rstrip()
        alone = before[-1:] not in ("*", "/", "%", ")")
        if m[1].startswith("("):
            alone = alone and _BEFORE_VALUE.search(before[-20:]) is not None
        return f"{m[1]} div {m[2]}" if alone and is_whole(m[1]) and is_whole(m[2]) else m[0]

    def plain(part: str) -> str:
        part = _SPLIT_OPERATOR.sub(r"\1=", part)
        part = _CURRENT_YEAR.sub(FIXED_YEAR, part)
        return _QUOTIENT.sub(quotient, _LIKE.sub("ILIKE", part))

    return "".join(part if i % 2 else plain(part) for i, part in enumerate(_QUOTED.split(sql)))


def _run(session: SparkSession, row: Row, path: str, timeout: float, integral: Callable[[], set[str]]) -> tuple:
    """Run one statement under a job tag; a timer cancels its jobs when time is up."""
    tag = f"statement-{uuid.uuid4().hex}"
    context = session.sparkContext
    expired = threading.Event()

    def stop() -> None:
        expired.set()
        context.cancelJobsWithTag(tag)

    timer = threading.Timer(timeout, stop)
    context.addJobTag(tag)
    context.setInterruptOnCancel(True)
    timer.start()
    started = time.monotonic()
    try:
        result = session.sql(compatible(row["sql"].rstrip().rstrip(";"), integral))
        result.select(
            F.lit(row["query_id"]).cast("long").alias("query_id"),
            F.lit(row["side"]).alias("side"),
            F.monotonically_increasing_id().alias("row_idx"),
            row_cells(result).alias("cells"),
        ).write.parquet(path)
        return (row["query_id"], row["side"], not expired.is_set(), expired.is_set(), None, time.monotonic() - started)
    except Exception as error:  # any failure of the user's query is a result, not our error
        message = None if expired.is_set() else str(error)
        return (row["query_id"], row["side"], False, expired.is_set(), message, time.monotonic() - started)
    finally:
        timer.cancel()
        context.removeJobTag(tag)


def run_statements(
    statements: DataFrame,
    timeout: float = 30.0,
    workers: int = 4,
    session_for: SessionFor | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Results (query_id, side, row_idx, cells) and status, with the seconds taken, of every statement.

    `statements(query_id, side, db_id, sql)`. Rows are fetched partition by partition
    and at most a few per worker wait, so a long list never sits on the driver whole.
    `session_for` gives the session that holds a database's tables.
    """
    spark = statements.sparkSession
    root = scratch_path(spark)
    pick = session_for or (lambda _: spark)
    # Whole-number columns are listed once per session, when a quotient first asks for them.
    listed: dict[int, tuple[SparkSession, Callable[[], set[str]]]] = {}

    def integral(session: SparkSession) -> Callable[[], set[str]]:
        return listed.setdefault(id(session), (session, cache(lambda: integral_columns(session))))[1]

    rows: Iterator[Row] = statements.select("query_id", "side", "db_id", "sql").toLocalIterator()
    done: list[tuple] = []
    written = 0

    def flush() -> None:
        nonlocal written
        if done:
            spark.createDataFrame(done, STATUS_DDL).coalesce(1).write.parquet(f"{root}/status/batch={written}")
            written += 1
            done.clear()

    with ThreadPoolExecutor(workers) as pool:
        waiting: set[Future] = set()
        for number, row in enumerate(rows):
            if len(waiting) >= 2 * workers:
                finished, waiting = wait(waiting, return_when=FIRST_COMPLETED)
                done.extend(f.result() for f in finished)
            if len(done) >= STATUS_BATCH:
                flush()
            path = f"{root}/results/statement={number}"
            task = inheritable_thread_target(spark)(_run)
            session = pick(row["db_id"])
            waiting.add(pool.submit(task, session, row, path, timeout, integral(session)))
        done.extend(f.result() for f in wait(waiting).done)
    flush()
    status = spark.read.schema(STATUS_DDL).parquet(f"{root}/status") if written else spark.createDataFrame([], STATUS_DDL)
    if status.filter("ok").isEmpty():
        return spark.createDataFrame([], RESULT_DDL), status
    results = spark.read.schema(RESULT_DDL).option("recursiveFileLookup", True).parquet(f"{root}/results")
    kept = results.join(status.filter("ok").select("query_id", "side"), ["query_id", "side"], "left_semi")
    return _numbered(kept), status


def _numbered(results: DataFrame) -> DataFrame:
    """Row ids of written results as 0-based positions.

    An id is a partition's number and a count from 0 inside it, and all rows written are here. So
    only partitions are counted, and no row is sorted or shuffled.
    """
    keys = ["query_id", "side"]
    sizes = results.groupBy(*keys, F.shiftright("row_idx", 33).alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    placed = results.withColumn("__part", F.shiftright("row_idx", 33)).join(materialise(offsets), [*keys, "__part"])
    position = F.col("__offset") + F.col("row_idx").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("row_idx", position).select(*results.columns)


def grade_pairs(pairs: DataFrame, ordered_family: bool = False, with_gold: bool = True, **options) -> DataFrame:
    """res / error / timeout / error_msg of every (query_id, db_id, sql_gt, sql_pred).

    With gold, results are compared as sets, or under column permutation and order in
    the ordered family; each gold statement runs once. Without, a result has to be
    plausible.
    """
    sides = [F.struct(F.lit(D.PRED).alias("side"), F.col("sql_pred").alias("sql"))]
    if with_gold:
        sides.append(F.struct(F.lit(D.GOLD).alias("side"), F.col("sql_gt").alias("sql")))
    statements = pairs.select("query_id", "db_id", F.inline(F.array(*sides)))
    results, status = run_statements(statements, **options)
    queries = pairs.select("query_id", D.order_matters(F.col("sql_gt")).alias("ordered"))
    if not with_gold:
        equal = D.result_validity(results, queries).select("query_id", (F.col("valid") == 1).alias("equal"))
    elif ordered_family:
        equal = D.column_permutation_equal(results, queries).select("query_id", F.col("colperm_eq").alias("equal"))
    else:
        equal = D.set_equal(results, queries).select("query_id", F.col("set_eq").alias("equal"))
    ran = status.groupBy("query_id").agg(
        F.bool_or("timed_out").alias("timed_out"),
        F.max("exception").alias("exception"),
    )
    outcomes = pairs.select("query_id").join(ran, "query_id").join(equal, "query_id")
    return D.status_report(outcomes, ordered_family)


def timed_pairs(pairs: DataFrame, repeats: int = 10, ordered_family: bool = False, **options) -> DataFrame:
    """Time ratio of every (query_id, db_id, sql_gt, sql_pred) from repeated runs: (query_id, time_ratio, runs_kept).

    The gold and the predicted statement run in turns, one at a time unless `workers` says
    otherwise, so both meet the same load. Results of the first run decide whether they are
    equal. A pair of which no run of both sides came through has ratio 0 and no runs.
    """
    options = {"workers": 1} | options
    sides = [
        F.struct(F.lit(run).alias("run"), F.lit(side).alias("side"), F.col(text).alias("sql"))
        for run in range(repeats)
        for side, text in ((D.GOLD, "sql_gt"), (D.PRED, "sql_pred"))
    ]
    runs = pairs.select("query_id", "db_id", F.inline(F.array(*sides)))
    # A run is a statement of its own: its number goes into the id.
    numbered = runs.select((F.col("query_id") * repeats + F.col("run")).alias("query_id"), "side", "db_id", "sql")
    results, status = run_statements(numbered, **options)
    query, run = F.floor(F.col("query_id") / repeats).cast("long"), F.pmod("query_id", F.lit(repeats))

    def seconds(side: str) -> Column:
        return F.max(F.when((F.col("side") == side) & F.col("ok"), F.col("seconds")))

    taken = (
        status.groupBy(query.alias("of"), run.alias("run"))
        .agg(seconds(D.GOLD).alias("t_gold"), seconds(D.PRED).alias("t_pred"))
        .dropna()
        .withColumnRenamed("of", "query_id")
    )
    first = results.withColumn("run", run).filter(F.col("run") == 0).withColumn("query_id", query).drop("run")
    queries = pairs.select("query_id", D.order_matters(F.col("sql_gt")).alias("ordered"))
    if ordered_family:
        equal = D.column_permutation_equal(first, queries).select("query_id", F.col("colperm_eq").alias("equal"))
    else:
        equal = D.set_equal(first, queries).select("query_id", F.col("set_eq").alias("equal"))
    ratios = D.efficiency_ratio(taken.join(equal, "query_id"))
    return pairs.select("query_id").join(ratios, "query_id", "left").fillna({"time_ratio": 0.0, "runs_kept": 0})
