"""Fillings of any count by their number, and candidates run until one passes."""

from decimal import Decimal
from itertools import product

import pytest

from sqlweave.operators import candidates, execution, slots

QUERIES = "query_id bigint, sql_gt string, sql_pred string"
RANGES = "query_id bigint, first decimal(38,0), number int"


def wide(literals: int, n_slots: int) -> tuple[str, str]:
    gold = "SELECT a FROM t WHERE " + " AND ".join(f"a <> {100 + i}" for i in range(literals))
    return gold, "SELECT a FROM t WHERE " + " AND ".join(f"b <> {i}" for i in range(n_slots))


def test_ranges_list_what_all_fillings_list(spark):
    rows = [(1, *wide(3, 4)), (2, *wide(1, 2)), (3, *wide(2, 0)), (4, "SELECT a FROM t", "SELECT a FROM t WHERE a = 1")]
    queries = spark.createDataFrame(rows, QUERIES)
    want = {(r["query_id"], r["cand_idx"]): r["sql"] for r in slots.slot_fillings(queries).collect()}
    plan = slots.slot_plan(queries)
    assert {r["query_id"]: r["n_alternatives"] for r in plan.collect()} == {1: "81", 2: "1", 3: "1", 4: "0"}
    ranges = spark.createDataFrame([(q, Decimal(f), 7) for q in (1, 2, 3, 4) for f in range(0, 98, 7)] + [(1, Decimal(5), 0)], RANGES)
    got = {(r["query_id"], int(r["cand_idx"])): r["sql"] for r in slots.fillings_in(plan, ranges).collect()}
    assert got == want and len(got) == 82 + 2 + 2 + 1


@pytest.mark.parametrize("literals,n_slots", [(21, 21), (40, 40)])
def test_counts_beyond_64_bits_are_exact(spark, literals, n_slots):
    gold, pred = wide(literals, n_slots)
    plan = slots.slot_plan(spark.createDataFrame([(1, gold, pred)], QUERIES))
    (row,) = plan.collect()
    assert row["n_alternatives"] == str(literals**n_slots)
    top = min(literals**n_slots, 10**38 - 1)
    firsts = [1, 12345678901234567890123, top - 1]
    asked = spark.createDataFrame([(1, Decimal(f), 3) for f in firsts], RANGES)
    got = {int(r["cand_idx"]): r["sql"] for r in slots.fillings_in(plan, asked.filter("first < 99999999999999999999999999999999999997")).collect()}
    for index, sql in got.items():
        digits = [(index - 1) // literals**place % literals for place in range(n_slots)]
        pieces = row["pieces"]
        assert sql == pieces[0] + "".join(row["values"][d] + p for d, p in zip(digits, pieces[1:]))
    if literals == 21:
        assert max(got) == literals**n_slots and len(got) == 8


def test_candidates_run_until_one_passes(spark):
    spark.createDataFrame([(i, i % 7, f"n{i % 3}") for i in range(60)], "a int, b int, c string").createOrReplaceTempView("t")
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("one")
    gold = "SELECT a FROM t WHERE b = 3 AND c = 'n1'"
    pairs = [
        (1, gold, "SELECT a FROM t WHERE c = 'n1' AND b = 3"), (2, gold, "SELECT a FROM t WHERE c = 'n2' AND b = 1"),
        (3, gold, "SELECT b FROM t WHERE c = 'n2' AND b = 1"), (4, "SELECT zz FROM t", gold), (5, gold, "SELECT nothing FROM t WHERE c = 'n1'"),
        (6, gold, "SELECT a FROM t WHERE b = 9 AND b = 9 AND b = 9 AND c = 'n2'"),
    ]
    queries = spark.createDataFrame([(q, "d", g, p) for q, g, p in pairs], "query_id bigint, db_id string, sql_gt string, sql_pred string")
    got = {r["query_id"]: r for r in candidates.first_passing(queries).collect()}
    values = ["3", "'n1'"]
    second = 1 + [f"{c} {b}" for b, c in product(values, values)].index("'n1' 3")
    assert {q: r["res"] for q, r in got.items()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 0, 6: 1}
    assert got[1]["cand_idx"] == 0 and got[1]["final_sql"] == pairs[0][2] and got[2]["cand_idx"] == second
    assert got[4]["gold_failed"] and got[4]["tried"] == 0 and not got[3]["gold_failed"]
    # None is left out where none passes: the prediction and all fillings were run.
    assert got[3]["tried"] == 5 and got[5]["tried"] == 3
    assert "'n1'" in got[6]["final_sql"] and got[6]["cand_idx"] > 1


def test_suites_need_every_database(spark):
    sessions = {}
    for name, rows in {"x": [(1, 1), (2, 5)], "y": [(1, 5), (2, 1)], "z": [(3, 3)]}.items():
        sessions[name] = spark.newSession()
        sessions[name].createDataFrame(rows, "a int, b int").createOrReplaceTempView("t")
    queries = spark.createDataFrame(
        [(1, None, "SELECT a FROM t WHERE b = 5", "SELECT a FROM t WHERE a = 2 AND b > 4"), (2, None, "SELECT a FROM t WHERE b = 5", "SELECT a FROM t WHERE b > 2 AND b < 9 AND b = 4"),
         (3, None, "SELECT a FROM t", "SELECT a FROM missing")],
        "query_id bigint, db_id string, sql_gt string, sql_pred string",
    )
    databases = [(q, n, d) for q in (1, 2) for n, d in enumerate(("x", "y"))] + [(3, 0, "x"), (3, 1, "z")]
    suites = spark.createDataFrame(databases, "query_id bigint, db_no int, db_id string")
    got = {r["query_id"]: r for r in candidates.first_passing(queries, suites, session_for=sessions.__getitem__).collect()}
    # The first prediction is right on x alone; with 5 in its slots the second never is; nothing else is asked of z.
    assert {q: r["res"] for q, r in got.items()} == {1: 0, 2: 0, 3: 0}
    only = {r["query_id"]: r["res"] for r in candidates.first_passing(queries, suites.filter("db_id = 'x'"), session_for=sessions.__getitem__).collect()}
    assert only == {1: 1, 2: 0, 3: 0}
    assert candidates.first_passing(queries.limit(0), suites, session_for=sessions.__getitem__).count() == 0


def test_time_ratios_come_from_repeated_runs(spark):
    spark.range(5).createOrReplaceTempView("timed_five")
    rows = [
        (7, None, "select id from timed_five", "select id from timed_five where id >= 0"),
        (8, None, "select id from timed_five", "select id from timed_five where id > 0"),
        (9, None, "select id from timed_five", "select nothing from timed_five"),
    ]
    pairs = spark.createDataFrame(rows, "query_id bigint, db_id string, sql_gt string, sql_pred string")
    timed = {r["query_id"]: (r["time_ratio"], r["runs_kept"]) for r in execution.timed_pairs(pairs, repeats=3).collect()}
    assert timed[7][0] > 0 and timed[7][1] == 3
    assert timed[8] == (0.0, 3) and timed[9] == (0.0, 0)
