import itertools
import random

import pytest

from sqlweave.functions.cells import row_cells
from sqlweave.operators import denotation as D

RESULTS = "query_id bigint, side string, row_idx bigint, cells array<string>"


def long_form(pairs):
    rows = []
    for query_id, (gold, pred) in enumerate(pairs):
        for side, result in (("gold", gold), ("pred", pred)):
            rows += [(query_id, side, i, list(cells)) for i, cells in enumerate(result)]
    return rows


def run(spark, operator, pairs, column, ordered=None):
    results = spark.createDataFrame(long_form(pairs), RESULTS)
    flags = ordered or [False] * len(pairs)
    queries = spark.createDataFrame(list(enumerate(flags)), "query_id bigint, ordered boolean")
    rows = operator(results, queries).select("query_id", column).collect()
    return [dict(rows)[i] for i in range(len(pairs))]


CASES = [
    ([], []),
    ([("n:1",)], []),
    ([("n:1",)], [("n:1",), ("n:1",)]),
    ([("n:1", "s:a")], [("s:a", "n:1")]),
    ([(None, "n:1")], [(None, "n:1")]),
    ([("n:1",), ("n:2",)], [("n:2",), ("n:1",)]),
    ([("n:1", "n:2")], [("n:1",)]),
    ([("s:1",)], [("n:1",)]),
]


def test_set_bag_ordered(spark):
    assert run(spark, D.set_equal, CASES, "set_eq") == [True, False, True, False, True, True, False, False]
    assert run(spark, D.bag_equal, CASES, "bag_eq") == [True, False, False, False, True, True, False, False]
    assert run(spark, D.ordered_equal, CASES, "ordered_eq") == [True, False, False, False, True, False, False, False]


def brute(gold, pred, ordered):
    if len(gold) != len(pred):
        return False
    if not gold:
        return True
    if len(gold[0]) != len(pred[0]):
        return False
    for order in itertools.permutations(range(len(gold[0]))):
        moved = [tuple(r[i] for i in order) for r in pred]
        same = moved == gold if ordered else sorted(moved, key=str) == sorted(gold, key=str)
        if same:
            return True
    return False


def test_column_permutation_against_brute_force(spark):
    rng = random.Random(3)
    pairs, ordered = [], []
    for _ in range(150):
        width, height = rng.randint(1, 5), rng.randint(0, 5)
        gold = [tuple(rng.choice(["n:0", "n:1", None]) for _ in range(width)) for _ in range(height)]
        order = rng.sample(range(width), width)
        pred = [tuple(r[i] for i in order) for r in gold]
        if rng.random() < 0.5:
            rng.shuffle(pred)
        if pred and rng.random() < 0.4:
            i = rng.randrange(len(pred))
            pred[i] = tuple(rng.choice(["n:0", "n:1", None]) for _ in range(width))
        pairs.append((gold, pred))
        ordered.append(rng.random() < 0.5)
    expected = [brute(g, p, o) for (g, p), o in zip(pairs, ordered)]
    assert run(spark, D.column_permutation_equal, pairs, "colperm_eq", ordered) == expected
    maybe = run(spark, D.quick_reject, pairs, "may_match", ordered)
    assert all(m for m, e in zip(maybe, expected) if e)


def test_identical_columns_do_not_multiply(spark):
    wide = [tuple(["n:1"] * 9 + ["n:2"])]
    assert run(spark, D.column_permutation_equal, [(wide, [wide[0][::-1]])], "colperm_eq") == [True]


def incidence(edges, width):
    return [tuple("n:1" if c in edge else "n:0" for c in range(width)) for edge in edges]


def test_columns_that_can_trade_places_do_not_multiply(spark):
    """Twelve columns: their 12! orders are never listed."""
    rng = random.Random(5)
    one_ring = incidence([(i, (i + 1) % 12) for i in range(12)], 12)
    two_rings = incidence([(h + i, h + (i + 1) % 6) for h in (0, 6) for i in range(6)], 12)
    unit = incidence([(i,) for i in range(12)], 12)
    mixed = [tuple(rng.choice(["n:0", "n:1"]) for _ in range(12)) for _ in range(30)]
    order = rng.sample(range(12), 12)

    def moved(rows):
        out = [tuple(r[i] for i in order) for r in rows]
        rng.shuffle(out)
        return out

    # Two rings of six have the row and column sums of one of twelve.
    pairs = [(one_ring, moved(one_ring)), (one_ring, moved(two_rings)), (unit, moved(unit)), (mixed, moved(mixed))]
    swapped = [list(r) for r in moved(mixed)]
    i = next(i for i, r in enumerate(swapped) if r[0] != r[1])
    swapped[i][0], swapped[i][1] = swapped[i][1], swapped[i][0]
    pairs.append((mixed, [tuple(r) for r in swapped]))
    assert run(spark, D.column_permutation_equal, pairs, "colperm_eq") == [True, False, True, True, False]


@pytest.mark.parametrize(
    "rows, valid",
    [([], 0), ([["n:0"]], 0), ([[None]], 0), ([["s:"]], 0), ([[None, None], [None, None]], 0), ([["n:5"], ["n:0"]], 1)],
)
def test_validity(spark, rows, valid):
    results = spark.createDataFrame([(1, "pred", i, r) for i, r in enumerate(rows)], RESULTS)
    queries = spark.createDataFrame([(1,)], "query_id bigint")
    assert D.result_validity(results, queries).first()["valid"] == valid


def test_cells_are_canonical(spark):
    df = spark.sql("select 1 a, 1.0D b, cast(1.50 as decimal(5,2)) c, '1' d, cast(null as int) e, true f, 2.5D g")
    assert df.select(row_cells(df)).first()[0] == ["n:1", "n:1", "n:1.5", "s:1", None, "n:1", "n:2.5"]


def test_efficiency_ratio(spark):
    runs = [(1, i, 2.0, 1.0, True) for i in range(20)] + [(1, 20, 900.0, 1.0, True)]
    runs += [(2, i, 1.0, 1.0, False) for i in range(3)] + [(3, 0, 4.0, 2.0, True)]
    df = spark.createDataFrame(runs, "query_id int, run int, t_gold double, t_pred double, equal boolean")
    out = {r["query_id"]: (r["time_ratio"], r["runs_kept"]) for r in D.efficiency_ratio(df).collect()}
    assert out == {1: (2.0, 20), 2: (0.0, 3), 3: (2.0, 1)}


def test_suite_needs_every_database_and_a_running_gold(spark):
    rows = [
        (1, 0, 0, True, True, True), (1, 0, 1, True, True, False), (1, 1, 0, True, True, True), (1, 1, 1, True, True, True),
        (2, 0, 0, False, True, True),
    ]
    df = spark.createDataFrame(rows, "query_id int, cand_idx int, db_idx int, gold_ok boolean, pred_ok boolean, equal boolean")
    out = {r["query_id"]: (r["res"], r["status"]) for r in D.suite_equal(df).collect()}
    assert out == {1: (1, "ok"), 2: (0, "gold failed")}


def test_any_candidate_reports_first_pass_or_candidate_zero(spark):
    rows = [(1, 0, "a", False), (1, 1, "b", True), (1, 2, "c", True), (2, 0, "x", False), (2, 1, "y", False)]
    df = spark.createDataFrame(rows, "query_id int, cand_idx int, sql string, passed boolean")
    out = {r["query_id"]: (r["res"], r["final_sql"]) for r in D.any_candidate(df).collect()}
    assert out == {1: (1, "b"), 2: (0, "x")}
