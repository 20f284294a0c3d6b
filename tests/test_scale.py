"""Plans and task shares that decide whether a query still runs on larger tables."""

import contextlib
import io

from pyspark.sql import functions as F

from sqlweave import session
from sqlweave.llm import simhash
from sqlweave.operators import catalog as C
from sqlweave.operators import execution, linking, ranking, scoring
from sqlweave.operators import retrieval as R
from sqlweave.session import materialise, spread


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain()
    return text.getvalue()


def test_catalogs_and_vectors_are_not_broadcast(spark):
    rows = [(i, f"db_{i % 3}", [float(i), 1.0], "T", f"C{i}") for i in range(30)]
    written = spark.createDataFrame(rows, "id bigint, db_id string, vector array<double>, table_name string, column_name string")
    table, other = materialise(written), materialise(written)
    asked = table.select("db_id", F.col("id").alias("question_id"), "vector")
    held = other.select("db_id", F.col("id").alias("doc_id"), "vector")
    # The grid of cells stands on the right; the left side holds the vectors.
    assert "BuildLeft" not in plan(R.top_k_cosine(asked, held, 5))
    keys = ["db_id", "table_name", "column_name"]
    assert "Broadcast" not in plan(C.restore_casing(table.select(*keys), other.select(*keys)))


def test_rings_of_several_pages_leave_out_what_is_struck(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RING_PAGE", 3)
    members = spark.createDataFrame([("a", i) for i in range(20)] + [("b", i) for i in range(100, 102)], "g string, m bigint")
    requests = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "q bigint, g string")
    every = {}
    for r in ranking.ring_sample(requests, members, "g", ["q"], ["m"], 20, "s").collect():
        every.setdefault(r["q"], []).append((r["pick"], r["m"]))
    assert {q: sorted(m for _, m in found) for q, found in every.items()} == {1: [*range(20)], 2: [*range(20)], 3: [100, 101]}
    struck = spark.createDataFrame([(1, every[1][0][1]), (1, 7), (2, 3)], "q bigint, m bigint")
    left = ranking.ring_sample(requests, members, "g", ["q"], ["m"], 20, "s", struck, F.lit(5)).collect()
    gone = {1: {every[1][0][1], 7}, 2: {3}, 3: set()}
    wanted = {(q, i, m) for q, found in every.items() for i, m in enumerate([m for _, m in sorted(found) if m not in gone[q]][:5], 1)}
    assert {(r["q"], r["turn"], r["m"]) for r in left} == wanted


def test_one_row_group_is_dealt_to_all_tasks(spark, tmp_path):
    # Two files of one row group, of which Spark would make more splits than hold rows.
    path = str(tmp_path / "rows.parquet")
    spark.range(4000).selectExpr("id", "sha2(cast(id as string), 512) text").coalesce(1).write.parquet(path)
    with_splits = spark.newSession()
    with_splits.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    shares = spread(with_splits.read.parquet(path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(shares) == 4 and max(r["count"] for r in shares) < 1500


def test_written_rows_are_numbered_without_sorting(spark):
    part = 1 << 33
    rows = [(1, "gold", 0, ["a"]), (1, "gold", 1, ["b"]), (1, "gold", 2 * part, ["c"]), (1, "pred", part, ["d"]), (1, "pred", part + 1, ["e"])]
    numbered = execution._numbered(spark.createDataFrame(rows, "query_id bigint, side string, row_idx bigint, cells array<string>"))
    assert {(r["side"], r["row_idx"], r["cells"][0]) for r in numbered.collect()} == {
        ("gold", 0, "a"), ("gold", 1, "b"), ("gold", 2, "c"), ("pred", 0, "d"), ("pred", 1, "e")
    }
    assert "Window" not in plan(numbered)


def test_known_names_deal_rows_and_list_words_once(spark, monkeypatch):
    """Texts meet the catalog over one list of words, and come out in shares of rows for the costly comparison."""
    monkeypatch.setattr(session, "SPREAD_ROWS", 10)
    queries = spark.range(400).select(
        F.col("id").alias("query_id"), F.lit("d").alias("db_id"), F.lit("SELECT a.k FROM a").alias("sql_gt"), F.lit("SELECT k FROM b").alias("sql_pred")
    )
    columns = spark.createDataFrame([("d", "A", "K"), ("d", "b", "k"), ("d", "c", "k"), ("e", "a", "z")], "db_id string, table_name string, column_name string")
    named = scoring.with_known_names(queries, columns)
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1
    assert named.rdd.getNumPartitions() == 40
    lists = {tuple(sorted((n["table"], n["column"]) for n in r["names"])) for r in named.collect()}
    assert lists == {(("a", "k"), ("b", "k"))}


def test_words_of_texts_are_not_broadcast(spark):
    """Spark takes the size of listed words from before they were listed."""
    texts = [(1, "d", "SELECT a.k FROM a", "SELECT k FROM b"), (2, "d", "SELECT z FROM a", ""), (3, None, "SELECT k FROM a", "k"), (None, "d", "SELECT k FROM a", "k"), (4, "d", None, None), (5, "d", "k c", "c"), (5, "d", "k b", "x")]
    queries = materialise(spark.createDataFrame(texts, "query_id bigint, db_id string, sql_gt string, sql_pred string"))
    rows = [("d", "A", "K"), ("d", "b", "k"), ("d", "c", "k"), ("d", None, "k"), ("d", "a", None), (None, "a", "k")] + [("e", f"table_{i}", f"column_{i}") for i in range(2000)]
    columns = materialise(spark.createDataFrame(rows, "db_id string, table_name string, column_name string"))
    same = materialise(spark.createDataFrame([("d", "A.k", "b.K")], "db_id string, unit string, representative string"))
    named = scoring.with_known_names(queries, columns, same)
    assert "BuildLeft" not in plan(named)
    found = {(r["query_id"], r["sql_gt"]): r["names"] and sorted(tuple(n) for n in r["names"]) for r in named.collect()}
    both = [("b", "k", None), ("c", "k", None)]
    assert found == {
        (1, "SELECT a.k FROM a"): [("a", "k", "b.k"), ("b", "k", None)], (2, "SELECT z FROM a"): None, (3, "SELECT k FROM a"): None,
        (None, "SELECT k FROM a"): None, (4, None): None, (5, "k c"): both, (5, "k b"): both,
    }


def test_anchors_of_fingerprints_are_not_broadcast(spark):
    """A fingerprint has 2 home and 32 other anchors, of which Spark's sizes know nothing."""
    prints = materialise(spark.range(200).selectExpr("xxhash64(id) fp"))
    assert "Broadcast" not in plan(simhash.close_pairs(prints))


def test_names_of_a_text_search_it_for_ctes_once(spark):
    """A search inside a lambda is made again at every name."""
    sql = "WITH c AS (SELECT T1.a FROM t AS T1)\x1c  SELECT T2.b, d FROM t T2 JOIN c ON T2.a = c.a"
    asked = spark.createDataFrame([(1, "x", sql)], "question_id long, db_id string, sql string")
    columns = spark.createDataFrame([("x", "T", c, c) for c in "abd"] + [("x", "c", "a", "no")], "db_id string, table_name string, column_name string, doc_id string")
    used = linking.used_columns(asked, columns)
    assert plan(used).count("(?:select|with|values)") == 1
    assert sorted(r["doc_id"] for r in used.collect()) == ["a", "b", "d"]
