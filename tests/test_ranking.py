from pyspark.sql import functions as F

from sqlweave.operators import ranking
from sqlweave.sources import readers


def test_positions_of_a_hot_group_with_null_keys(spark):
    hot = spark.range(5000).select(F.lit("hot").alias("g"), F.col("id"))
    nulls = spark.range(30).select(F.lit(None).cast("string").alias("g"), F.col("id"))
    df = hot.union(nulls)
    out = ranking.position(df, ["g"], [F.col("id")], ranking.integer_bucket(F.col("id"), 64), total="n")
    assert out.count() == 5030
    assert out.filter(F.col("pos") != F.col("id") + 1).count() == 0
    assert {r["n"] for r in out.select("n").distinct().collect()} == {5000, 30}


def test_running_totals_cross_buckets(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 10 == 0).cast("int").alias("x"))
    out = ranking.running(df, [], "id", {"s": F.col("x")}, {"m": F.when(F.col("x") == 1, F.col("id"))}, width=7)
    wrong = out.filter((F.col("s") != F.floor(F.col("id") / 10) + 1) | (F.col("m") != F.floor(F.col("id") / 10) * 10))
    assert wrong.count() == 0 and out.count() == 1000


def test_ring_sample_is_distinct_and_exact_in_size(spark):
    members = spark.range(40).select((F.col("id") % 3).alias("g"), F.col("id").alias("m")).filter("g < 2")
    small = spark.createDataFrame([(9, 100), (9, 101)], "g bigint, m bigint")
    requests = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(99, 9)], "q bigint, g bigint")
    out = ranking.ring_sample(requests, members.union(small), "g", ["q"], ["m"], 5, "s")
    sizes = {r["q"]: (r["n"], r["d"]) for r in out.groupBy("q").agg(F.count("*").alias("n"), F.count_distinct("m").alias("d")).collect()}
    assert sizes.pop(99) == (2, 2)
    assert set(sizes.values()) == {(5, 5)} and len(sizes) == 50


def test_gather_text_keeps_a_long_group_whole(spark):
    df = spark.range(1, 1501).select(F.lit("k").alias("k"), F.col("id").alias("pos"), F.col("id").cast("string").alias("t"))
    (whole,) = ranking.gather_text(df.repartition(3), ["k"], "pos", "t", ",").collect()
    assert whole["n_lines"] == 1500 and whole["t"] == ",".join(str(i) for i in range(1, 1501))


def test_sessions(spark):
    text = ["a\tdb", "b\tdb", "", "", "c\tdb"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no bigint, line string")
    rows = readers.sessions(lines).orderBy("session_id", "turn").collect()
    assert [(r["session_id"], r["turn"], r["sql"], r["db_id"]) for r in rows] == [
        (0, 1, "a", "db"), (0, 2, "b", "db"), (2, 1, "c", "db")]
    assert readers.session_count_gap(readers.sessions(lines), readers.sessions(lines)).first()["equal"]


def test_ring_neighbours_do_not_always_come_together(spark):
    members = spark.range(101).select(F.lit(1).alias("g"), F.col("id").alias("m"))
    requests = spark.range(200).select(F.col("id").alias("q"), F.lit(1).alias("g"))
    out = ranking.ring_sample(requests, members, "g", ["q"], ["m"], 5, "s")
    pairs = out.alias("a").join(out.alias("b"), "q").filter("a.m < b.m").select("a.m", F.col("b.m").alias("o")).distinct()
    # Consecutive places could give no more than 4 x 101 pairs.
    assert pairs.count() > 1000
