import math

from sqlweave.operators import preference as P
from sqlweave.operators import scoring as S
from sqlweave.sources import writers

PAIRS = "pair_id bigint, batch int, c double, r double, ref_c double, ref_r double"


def test_baseline_is_a_running_mean_over_batches(spark):
    rows = [(1, 1, 10.0, 0.0, 0.0, 0.0), (2, 1, 20.0, 0.0, 0.0, 10.0), (3, 2, 40.0, 30.0, 0.0, 0.0), (4, 7, 0.0, 0.0, 0.0, 0.0)]
    out = {r["pair_id"]: r["delta"] for r in P.baseline_loss(spark.createDataFrame(rows, PAIRS), "batch").collect()}
    first, second, third = 0.1 * 20 / 4, 0.1 * 90 / 6, 0.1 * 90 / 8
    assert all(math.isclose(out[k], v) for k, v in {1: first, 2: first, 3: second, 4: third}.items())


def test_sorted_loss_ranks_ties_and_close_values(spark):
    values = [0.5] * 700 + [1e-9 * i for i in range(800)] + [-3.0, 90.0]
    rows = [(i, 1, v, 2.0 * v, 0.0, 0.0) for i, v in enumerate(values)]
    out = P.sorted_pair_loss(spark.createDataFrame(rows, PAIRS), "batch").orderBy("rank").collect()
    high, low = sorted(values), sorted(2.0 * v for v in values)
    assert [r["rank"] for r in out] == list(range(1, len(values) + 1))
    for row, h, l in zip(out, high, low):
        assert math.isclose(row["loss"], math.log1p(math.exp(-0.1 * (h - l))), abs_tol=1e-9)


def test_vector_files_do_not_grow_with_tasks(spark, tmp_path):
    rows = spark.range(400).selectExpr("if(id = 7, null, concat('d', id % 2)) database_name", "id", "array(double(id)) vector")
    writers.write_vectors(rows.repartition(16), str(tmp_path / "v"), rows_per_file=1000)
    assert len(list((tmp_path / "v").glob("*/*.parquet"))) == 3
    assert writers.read_vectors(spark, str(tmp_path / "v")).count() == 400


EXACT = [
    ("select T1.name from singer as T1", "select a.name from singer as a", 1),
    ("select T1.name from singer as T1 where T1.age > 3", "select name from singer where age > 3", 1),
    ("select T1.a from x as T1 join y as T2 on T1.i = T2.i", "select T2.a from y as T1 join x as T2 on T1.i = T2.i", 1),
    ("select T1.a from x as T1 join y as T2 on T1.i = T2.i", "select T2.a from x as T1 join y as T2 on T1.i = T2.i", 0),
    ("select a from x , y where x.i = y.i", "select a from x , y where x.i = x.i", 0),
    ("select count(*) from x", "select count(*) from y", 0),
    ("select name from singer where age > 3", "select singer.age from singer where age > 3", 0),
]


def test_exact_match_resolves_aliases(spark):
    rows = [(i, g, p) for i, (g, p, _) in enumerate(EXACT)]
    pairs = spark.createDataFrame(rows, "query_id int, sql_gt string, sql_pred string")
    out = {r["query_id"]: r["exact"] for r in S.exact_match_texts(S.compare_texts(pairs)).collect()}
    assert [out[i] for i in range(len(EXACT))] == [e for _, _, e in EXACT]
