import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from sqlweave.operators import catalog as C
from sqlweave.operators import contrastive, correction, execution, preference
from sqlweave.operators import retrieval as R
from sqlweave.sources import readers, writers


def vectors(spark, n, key, seed, groups=2):
    rng = np.random.default_rng(seed)
    rows = [(i, i % groups, [float(x) for x in rng.standard_normal(8)]) for i in range(n)]
    return spark.createDataFrame(rows, f"{key} bigint, db_id int, vector array<double>")


def brute_top_k(questions, documents, k):
    out = set()
    docs = documents.collect()
    for q in questions.collect():
        scored = []
        for d in docs:
            if d["db_id"] == q["db_id"]:
                a, b = np.array(q["vector"]), np.array(d["vector"])
                scored.append((-round(float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)), 6), d["doc_id"]))
        out |= {(q["question_id"], doc, i + 1) for i, (_, doc) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("cell", [2048, 7])
def test_top_k_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(R, "CELL_ROWS", cell)
    questions, documents = vectors(spark, 30, "question_id", 1), vectors(spark, 61, "doc_id", 2)
    got = {(r["question_id"], r["doc_id"], r["rank"]) for r in R.top_k_cosine(questions, documents, 5).collect()}
    assert got == brute_top_k(questions, documents, 5)


def test_approximate_search_finds_most(spark):
    questions, documents = vectors(spark, 40, "question_id", 1, 1), vectors(spark, 300, "doc_id", 2, 1)
    exact = R.top_k_cosine(questions, documents, 5)
    near = R.approximate_top_k(questions, documents, 5, dims=8, bands=16, band_planes=3)
    recall = R.recall_at_k(exact, near, "question_id", "doc_id").agg(F.avg("recall")).first()[0]
    assert recall > 0.8


def test_contrastive_score_by_hand(spark):
    rows = [(1, "a", 0.9, 0.85), (1, "b", 0.9, 0.1), (2, "a", 0.9, 0.2), (2, "b", 0.9, 0.3)]
    df = spark.createDataFrame(rows, "row_id int, negative string, pos_sim double, neg_sim double")
    hard = {r["row_id"]: r["loss"] for r in contrastive.contrastive_score(df, hard_only=True).collect()}
    for row_id, kept in ((1, [0.85]), (2, [0.3])):
        expected = np.logaddexp.reduce([0.9 / 0.07, *[k / 0.07 for k in kept]]) - 0.9 / 0.07
        assert hard[row_id] == pytest.approx(expected)
    names = {(r["row_id"], r["negative"]) for r in contrastive.hard_negatives(df).collect()}
    assert names == {(1, "a"), (2, "b")}


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame(
        [("d", i, i + 1) for i in range(200)] + [("d", 900, 901), ("e", 1, 2), ("d", 901, 900)], "db_id string, a bigint, b bigint")
    labels = {(r["db_id"], r["node"]): r["label"] for r in C.connected_components(edges).collect()}
    assert all(labels[("d", i)] == 0 for i in range(201))
    assert labels[("d", 901)] == 900 and labels[("e", 2)] == 1


def test_foreign_key_lines_keep_first_orientation(spark):
    lines = spark.createDataFrame(
        [(1, 1, "b.x=a.y"), (1, 2, "a.y = b.x"), (1, 3, "bad"), (1, 4, "a = b = c")], "question_id int, pos int, fk string")
    assert [r["fk"] for r in C.distinct_foreign_keys(lines).collect()] == ["b.x = a.y"]


def test_descriptions_are_cleaned(spark):
    df = spark.createDataFrame([(None,), (" Not useful  rest",), ("commonsense evidence: a\nb",)], "t string")
    got = [tuple(r) for r in df.select(C.clean_description(F.col("t")), C.clean_value_description(F.col("t"))).collect()]
    assert got == [("", ""), ("Not useful  rest", "rest"), ("a b", "a b")]


def test_pair_mining_cases(spark):
    cases = {  # question: (wrong, right)
        1: (0, 3), 2: (3, 0), 3: (1, 4), 4: (5, 2), 5: (3, 3), 6: (2, 5)}
    rows, attempt = [], 0
    for q, (w, r) in cases.items():
        for res, n in ((0, w), (1, r)):
            for _ in range(n):
                rows.append((q, attempt, f"gold{q}", f"{'ok' if res else 'bad'}{attempt}", res))
                attempt += 1
    df = spark.createDataFrame(rows, "question_id int, attempt_id bigint, sql_gt string, sql_pred string, res int")
    pairs = {}
    for r in correction.mine_pairs(df).collect():
        pairs.setdefault(r["question_id"], []).append((r["chosen"], r["rejected"]))
    assert 1 not in pairs
    assert [c for c, _ in pairs[2]] == ["gold2"] * 3 and [c for c, _ in pairs[3]] == ["gold3"]
    assert len(pairs[4]) == 2 and all(c.startswith("ok") for c, _ in pairs[4])
    for q in (5, 6):
        chosen = [c for c, _ in pairs[q]]
        assert len(chosen) == cases[q][0] and chosen.count(f"gold{q}") == 1 and len(set(chosen)) == len(chosen)


def test_revision_stops_early(spark):
    df = spark.createDataFrame([(1, "ok"), (2, "bad")], "question_id int, sql_pred string")

    def grade(rows):
        right = F.col("sql_pred").startswith("ok")
        return rows.withColumn("res", right.cast("int")).withColumn("error_msg", F.when(~right, "wrong"))

    def fix(rows):
        return rows.select("question_id", F.lit("ok now").alias("sql_pred"))

    history = correction.revise(df, grade, fix, rounds=5)
    got = sorted((r["question_id"], r["round"], r["sql_pred"], r["error_msg"]) for r in history.collect() if r)
    assert got == [(1, 0, "ok", None), (2, 0, "bad", "wrong"), (2, 1, "ok now", None)]


def test_losses_stay_finite(spark):
    df = spark.createDataFrame([(-900.0, 5.0, -1.0, -1.0)], "c double, r double, ref_c double, ref_r double")
    kinds = ["sigmoid", "exo_pair", "hinge", "nca_pair", "apo_zero", "apo_down", "ipo", "sppo_hard"]
    assert all(np.isfinite(v) for v in df.select(*[preference.pair_loss(k) for k in kinds]).first())


def test_statements_report_errors_and_timeouts(spark):
    spark.range(20).createOrReplaceTempView("numbers")
    slow = "select sum(hash(id)) from range(100000000000000)"
    pairs = spark.createDataFrame(
        [(1, None, "select id from numbers;", "select id from numbers order by id desc"),
         (2, None, "select id from numbers", "select nothing from numbers"),
         (3, None, "select 1", slow)],
        "query_id bigint, db_id string, sql_gt string, sql_pred string")
    got = {r["query_id"]: r for r in execution.grade_pairs(pairs, timeout=4.0, workers=2).collect()}
    assert (got[1]["res"], got[1]["error_msg"]) == (1, None)
    assert got[2]["error"] and "nothing" in got[2]["error_msg"]
    assert got[3]["timeout"] and got[3]["res"] == 0 and got[3]["error_msg"] == "runnable but wrong"
    plausible = execution.grade_pairs(pairs.filter("query_id = 1"), with_gold=False).first()
    assert plausible["res"] == 1


def test_catalog_json(spark, tmp_path):
    catalog = {
        "db_id": "d", "table_names_original": ["T", "U"],
        "column_names_original": [[-1, "*"], [0, "Id"], [0, "Name"], [1, "Id"], [1, "Ref"]],
        "column_names": [[-1, "*"], [0, "id"], [0, "name"], [1, "id"], [1, "ref"]],
        "column_types": ["text", "number", "text", "number", "number"],
        "primary_keys": [1, [3, 4]], "foreign_keys": [[4, 1], [4, 2]]}
    path = tmp_path / "tables.json"
    path.write_text(json.dumps([catalog], indent=2))
    raw = readers.read_catalogs(spark, str(path))
    rows = C.flatten_columns(raw).orderBy("col_idx").collect()
    assert [(r["table_name"], r["column_name"], r["is_pk"]) for r in rows] == [
        ("T", "Id", True), ("T", "Name", False), ("U", "Id", True), ("U", "Ref", True)]
    partner = {r["key_from"]: r["foreign_key"] for r in C.foreign_key_partner(C.foreign_key_edges(raw)).collect()}
    assert partner == {"U.Ref": "T.Name", "T.Id": "U.Ref", "T.Name": "U.Ref"}


def test_description_files(spark, tmp_path):
    folder = tmp_path / "d" / "database_description"
    folder.mkdir(parents=True)
    head = "original_column_name,column_name,column_description,data_format,value_description\n"
    (folder / "Plain.csv").write_text("﻿" + head + 'a,A,"two\nlines",text,\n,,x,,\n', encoding="utf-8")
    (folder / "Old.csv").write_bytes((head + "b,B,caf\xe9 \u20ac,text,\n").encode("cp1252"))
    rows = {r["table_name"]: r for r in readers.read_descriptions(spark, str(tmp_path)).collect()}
    assert set(rows) == {"plain", "old"}
    assert rows["plain"]["column_description"] == "two\nlines" and rows["plain"]["file_status"] == "utf-8"
    assert rows["old"]["column_description"] == "café €" and rows["old"]["file_status"] == "cp1252"
    assert rows["old"]["db_id"] == "d"


def test_other_sources(spark, tmp_path):
    (tmp_path / "s.json").write_text(json.dumps([{"table": "T", "col_data": [{"column_name": "A"}, {"column_name": "B"}]}]))
    assert {tuple(r) for r in readers.read_schema_json(spark, str(tmp_path / "s.json")).collect()} == {("t", "a"), ("t", "b")}
    rows = [{"question_id": 1, "db_id": "d", "question": "q", "SQL": "select 1"}]
    (tmp_path / "q.json").write_text(json.dumps(rows, indent=4))
    assert readers.read_questions(spark, str(tmp_path / "q.json")).first()["evidence"] == ""
    train = [{"db_id": "d", "question": "q", "sql_gt": "select 1", "table": ["t"], "column": [{"a": {"type": "int"}}], "foreign_keys": []}]
    (tmp_path / "t.json").write_text(json.dumps(train))
    assert json.loads(readers.read_training(spark, str(tmp_path / "t.json")).first()["column"]) == [{"a": {"type": "int"}}]
    catalog = readers.introspect(spark, {"n": spark.range(1)}, "d").first()
    assert (catalog["table_name"], catalog["column_name"], catalog["type"]) == ("n", "id", "bigint")
    writers.write_json(spark.createDataFrame([("é",)], "x string"), str(tmp_path / "out"))
    assert "\\u00E9" in spark.read.text(str(tmp_path / "out")).first()[0]
    writers.write_vectors(vectors(spark, 10, "doc_id", 1), str(tmp_path / "v"), "db_id")
    assert readers and writers.read_vectors(spark, str(tmp_path / "v")).filter("db_id = 1").count() == 5


def test_lines_of_a_file_read_in_many_splits_keep_their_numbers(spark, tmp_path):
    lines = [("" if i % 7 == 6 else f"turn {i}\tdb") for i in range(5000)]
    for name, part in (("a.sql", lines), ("b.sql", lines[:100])):
        (tmp_path / name).write_text("\n".join(part) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4096")
    try:
        numbered = readers.numbered_lines(spark, str(tmp_path))
        rows = numbered.collect()
        told = readers.read_sessions(spark, str(tmp_path)).collect()
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
    finally:
        spark.conf.set(key, before)
    for name, part in (("a.sql", lines), ("b.sql", lines[:100])):
        got = sorted((r["line_no"], r["line"]) for r in rows if r["file"].endswith(name))
        assert got == list(enumerate(part))
        turns = {(r["session_id"], r["turn"], r["sql"]) for r in told if r["file"].endswith(name)}
        assert turns == {(i // 7, i % 7 + 1, f"turn {i}") for i, line in enumerate(part) if line}


def test_sample_values(spark):
    df = spark.createDataFrame([(f"v{i:03d}", "") for i in range(200)] + [(None, "x")], "a string, b string").repartition(7)
    rows = C.sample_values(df, "t", ["a", "b"]).collect()
    a = [r["value"] for r in rows if r["column_name"] == "a"]
    assert len(a) == 2 and set(a) <= {f"v{i:03d}" for i in range(10)}
    assert [r["value"] for r in rows if r["column_name"] == "b"] == ["x"]
