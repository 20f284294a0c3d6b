"""Retrieval and contrastive sampling over embeddings and the events catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.functions.vectors import dot, l2_normalise
from sqlweave.operators import catalog as C
from sqlweave.operators import contrastive, linking
from sqlweave.operators import retrieval as R
from sqlweave.operators.ranking import ring_sample, seeded_position
from sqlweave.plans.bindings import CATALOG_SQL, LINKS_SQL, catalog, questions, stride_sql
from sqlweave.session import load, materialise, spread

K = 25
# Sign-projection setting shared with the SQL twin.
BANDS, BAND_PLANES, DIMS, SEED = 12, 4, 64, 7
TEXT_DIMS = 256


def _vectors(spark: SparkSession, sf: str, key: str) -> DataFrame:
    """Every embedding, its label standing for the database it belongs to."""
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias(key), F.col("label").alias("db_id"), F.col("embedding").alias("vector")
    )


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    return R.top_k_cosine(_vectors(spark, sf, "question_id"), _vectors(spark, sf, "doc_id"), K)


def topk_columns(spark, sf):
    return _hits(spark, sf).select("question_id", "doc_id", "rank")


def _near(spark: SparkSession, sf: str) -> DataFrame:
    return R.approximate_top_k(
        _vectors(spark, sf, "question_id"), _vectors(spark, sf, "doc_id"), K,
        dims=DIMS, bands=BANDS, band_planes=BAND_PLANES, seed=SEED,
    )


def approx_topk(spark, sf):
    return _near(spark, sf).select("question_id", "doc_id", "rank")


def approx_recall(spark, sf):
    """Mean recall@25 of the approximate search per database."""
    recall = R.recall_at_k(_hits(spark, sf), _near(spark, sf), "question_id", "doc_id")
    owner = _vectors(spark, sf, "question_id").select("question_id", "db_id")
    return recall.join(owner, "question_id").groupBy("db_id").agg(F.round(F.avg("recall"), 6).alias("recall"))


def grouped_hits(spark, sf):
    """Hits by table: a document's table is its id modulo 5."""
    named = _hits(spark, sf).select(
        "question_id", "rank",
        F.concat(F.lit("t"), F.col("doc_id") % 5).alias("table_name"), F.concat(F.lit("c"), "doc_id").alias("column_name"),
    )
    grouped = R.group_hits(named)
    return grouped.select("question_id", "table_name", "table_rank", F.array_join("columns", ",").alias("columns"))


def query_text(spark, sf):
    asked = questions(spark, sf)
    return asked.select(
        "question_id",
        R.query_text(F.col("question"), F.col("evidence")).alias("query_text"),
        R.query_text(F.col("question"), F.col("evidence"), gap="  ").alias("training_query_text"),
    )


def embed_text(spark, sf):
    """Non-zero entries of every document's vector."""
    texts = spread(load(spark, sf, "documents").select("doc_id", "text"))
    model = R.HashedVectoriser(TEXT_DIMS).fit(texts, "text")
    vectors = texts.select("doc_id", F.posexplode(model.transform(F.col("text"))).alias("dim", "weight"))
    return vectors.filter(F.col("weight") != 0).withColumn("weight", F.round("weight", 6))


def retrieve_schema(spark, sf):
    """Whole retrieval: column documents and questions embedded, ten nearest columns of the
    question's database, grouped by table in catalog spelling."""
    columns = materialise(catalog(spark, sf))
    values = C.clean_value_description(F.col("value_description"))
    documents = columns.select(
        "db_id", "doc_id",
        C.search_document(F.lower("table_name"), F.lower("column_name"), F.col("column_description"), values).alias("text"),
    )
    model = R.HashedVectoriser(TEXT_DIMS).fit(documents, "text")
    asked = questions(spark, sf).select(
        "question_id", "db_id",
        model.transform(R.query_text(F.concat("question", F.lit(" K"), "k"), F.col("evidence"))).alias("vector"),
    )
    held = documents.select("db_id", "doc_id", model.transform(F.col("text")).alias("vector"))
    hits = R.top_k_cosine(asked, held, 10)
    lowered = columns.select(
        "doc_id", "db_id", F.lower("table_name").alias("table_name"), F.lower("column_name").alias("column_name")
    )
    spelled = C.restore_casing(hits.join(lowered.hint("merge"), "doc_id"), columns.select("db_id", "table_name", "column_name"))
    grouped = R.group_hits(spelled.select("question_id", "rank", "table_name", "column_name"))
    return grouped.select("question_id", "table_name", "table_rank", F.array_join("columns", ",").alias("columns"))


def _long(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, F.posexplode("vector").alias("dim", "x")).select(key, "dim", F.round("x", 6).alias("x"))


def mean_pool(spark, sf):
    return _long(R.mean_pool(_vectors(spark, sf, "vec_id"), "db_id"), "db_id")


def last_token_pool(spark, sf):
    tokens = _vectors(spark, sf, "vec_id").withColumn("mask", F.col("vec_id") % 3 != 0)
    pooled = R.last_token_pool(tokens, "db_id", "vec_id", "mask")
    return _long(pooled.withColumn("vector", F.col("vector").cast("array<double>")), "db_id")


def l2_normalise_vectors(spark, sf):
    """Embeddings scaled by their id, so id 0 is the zero vector, and brought to unit length."""
    scaled = _vectors(spark, sf, "vec_id").select(
        "vec_id", F.transform("vector", lambda x: x.cast("double") * F.col("vec_id")).alias("vector")
    )
    return _long(scaled.select("vec_id", l2_normalise(F.col("vector")).alias("vector")), "vec_id")


def samples_per_db(spark, sf):
    return questions(spark, sf).groupBy("db_id").agg(F.count(F.lit(1)).alias("n_samples"))


def _linked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    asked = questions(spark, sf).select("question_id", "db_id", "sql")
    columns = catalog(spark, sf)
    links = materialise(linking.used_columns(asked, columns).select("question_id", "doc_id"))
    return asked.drop("sql"), columns.select("db_id", "doc_id"), links


def pos_neg_split(spark, sf):
    return contrastive.split_counts(*_linked(spark, sf))


def explode_positives(spark, sf):
    asked, _, links = _linked(spark, sf)
    return contrastive.training_rows(asked, links)


def sampled_negatives(spark, sf):
    asked, documents, links = _linked(spark, sf)
    return contrastive.sample_negatives(contrastive.training_rows(asked, links), documents, links, 7)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector asks; its positive is the next on its label's ring, its seven negatives
    stand on the next label's."""
    vectors = _vectors(spark, sf, "doc_id")
    ring = seeded_position(vectors, ["db_id"], "ring", ["doc_id"], "place", "size")
    step = F.pmod(F.col("place"), F.col("size")) + 1
    rows = ring.select(F.col("doc_id").alias("row_id"), "db_id", F.col("vector").alias("q"), step.alias("place")).join(
        ring.select("db_id", "place", F.col("vector").alias("p")), ["db_id", "place"]
    )
    asked = rows.select(
        "row_id", F.pmod(F.col("db_id") + 1, F.lit(10)).alias("db_id"), "q", dot(F.col("q"), F.col("p")).alias("pos_sim")
    )
    taken = ring_sample(asked, vectors.select("db_id", "doc_id"), "db_id", ["row_id"], ["doc_id"], 7, "negatives")
    negatives = taken.join(vectors.select("doc_id", "vector"), "doc_id")
    return negatives.select(
        "row_id", F.col("doc_id").alias("negative"),
        F.round("pos_sim", 9).alias("pos_sim"), F.round(dot(F.col("q"), F.col("vector")), 9).alias("neg_sim"),
    )


def hard_negatives(spark, sf):
    return contrastive.hard_negatives(_scored(spark, sf)).select("row_id", "negative")


def contrastive_score(spark, sf):
    """Loss of every row with all sampled negatives, and with hard ones only."""
    scored = _scored(spark, sf)
    every = contrastive.contrastive_score(scored)
    hard = contrastive.contrastive_score(scored, hard_only=True).withColumnRenamed("loss", "hard_loss")
    return every.join(hard, "row_id").select("row_id", F.round("loss", 6).alias("loss"), F.round("hard_loss", 6).alias("hard_loss"))


def mean_contrastive_score(spark, sf):
    return contrastive.contrastive_score(_scored(spark, sf)).agg(
        F.round(F.avg("loss"), 6).alias("mean_loss"), F.count(F.lit(1)).alias("n_rows")
    )


_TOP_SQL = f"""
v as (select vec_id, label, embedding::double[] e from embeddings),
u as (select vec_id, label, e, sqrt(list_dot_product(e, e)) n from v),
s as (select q.vec_id question_id, d.vec_id doc_id, round(list_dot_product(q.e, d.e) / (q.n * d.n), 9) score
      from u q join u d on q.label = d.label),
top as (select question_id, doc_id, row_number() over (partition by question_id order by score desc, doc_id)::int "rank"
        from s qualify "rank" <= {K})
"""


def _approx_sql() -> str:
    planes = R.random_planes(DIMS, BANDS * BAND_PLANES, SEED)

    def side(plane) -> str:
        numbers = ", ".join(repr(float(x)) for x in plane)
        return f"(list_dot_product(e, [{numbers}]::double[]) > 0)::int"

    codes = []
    for band in range(BANDS):
        own = planes[band * BAND_PLANES : (band + 1) * BAND_PLANES]
        codes.append(" + ".join(f"{2 ** i} * {side(p)}" for i, p in enumerate(own)))
    return f"""{_TOP_SQL.split('s as (')[0]}
    b as (select vec_id, label, [{', '.join(codes)}] codes from u),
    x as (select vec_id, label, unnest(range(1, {BANDS + 1})) band, unnest(codes) code from b),
    cand as (select distinct q.vec_id question_id, d.vec_id doc_id from x q join x d using (label, band, code)),
    s as (select question_id, doc_id, round(list_dot_product(q.e, d.e) / (q.n * d.n), 9) score from cand
          join u q on q.vec_id = question_id join u d on d.vec_id = doc_id),
    near as (select question_id, doc_id, row_number() over (partition by question_id order by score desc, doc_id)::int "rank"
             from s qualify "rank" <= {K})"""


_TOKEN_SQL = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+')"


def _dims_sql(text: str) -> str:
    return f"[('0x' || substr(md5(t), 1, 8))::bigint % {TEXT_DIMS} for t in {_TOKEN_SQL.format(text)}]"


_PREFIX = R.INSTRUCTION.replace("\n", "' || chr(10) || '")
_QUESTION = "'How many ' || event_type || ' events have key ' || k || '?'"
_EVIDENCE = "case when k % 2 = 0 then 'key ' || k || ' means ' || event_type else '' end"

_RETRIEVE_SQL = f"""with {CATALOG_SQL},
docs as (select db_id, doc_id, table_name, column_name, 'table:' || lower(table_name) || chr(10) || 'column:' || lower(column_name)
  || case when column_description <> '' then chr(10) || 'column_desc:' || column_description || '. ' else '' end
  || case when value_description <> '' then chr(10) || 'value_desc:' || trim(substr(value_description, 11), ' ') || '.' else '' end txt from cat),
asked as (select event_id question_id, 'db_' || user_id db_id, '{_PREFIX}' || {_QUESTION} || ' K' || k
  || case when k % 2 = 0 then ' ' || {_EVIDENCE} else '' end txt from ev),
dd as (select db_id, doc_id, unnest({_dims_sql('txt')}) dim from docs),
idf as (select dim, ln((1.0 + (select count(*) from docs)) / (1.0 + count(distinct doc_id))) + 1.0 w from dd group by 1),
allidf as (select r.dim, coalesce(w, ln(1.0 + (select count(*) from docs)) + 1.0) w from (select unnest(range(0, {TEXT_DIMS})) dim) r left join idf using (dim)),
dv as (select db_id, doc_id, dim, count(*) * any_value(w) x from dd join allidf using (dim) group by all),
dn as (select doc_id, sqrt(sum(x * x)) n from dv group by 1),
qq as (select db_id, question_id, unnest({_dims_sql('txt')}) dim from asked),
qv as (select db_id, question_id, dim, count(*) * any_value(w) x from qq join allidf using (dim) group by all),
qn as (select question_id, sqrt(sum(x * x)) n from qv group by 1),
pairs as (select q.question_id, d.doc_id from asked q join docs d using (db_id)),
dots as (select q.question_id, d.doc_id, sum(q.x * d.x) s from qv q join dv d using (db_id, dim) group by 1, 2),
s as (select p.question_id, p.doc_id, round(coalesce(s, 0) / (qn.n * dn.n), 9) score from pairs p left join dots using (question_id, doc_id)
      join qn on qn.question_id = p.question_id join dn on dn.doc_id = p.doc_id),
top as (select question_id, doc_id, row_number() over (partition by question_id order by score desc, doc_id) r from s qualify r <= 10),
g as (select question_id, table_name, min(r) best, string_agg(column_name, ',' order by r) "columns" from top join docs using (doc_id) group by 1, 2)
select question_id, table_name, row_number() over (partition by question_id order by best)::int table_rank, "columns" from g"""

_SCORED_SQL = f"""
v as (select vec_id, label, embedding::double[] e from embeddings),
r as (select *, row_number() over (partition by label order by md5('ring|' || vec_id), vec_id) place,
      count(*) over (partition by label) size from v),
n as (select *, row_number() over (partition by label order by md5('negatives|' || vec_id), vec_id) place,
      count(*) over (partition by label) size from v),
a as (select q.vec_id row_id, (q.label + 1) % 10 label, q.e, list_dot_product(q.e, p.e) pos from r q
      join r p on p.label = q.label and p.place = q.place % q.size + 1),
w as (select a.*, unnest(range(0, least(7, s.size))) pick, s.size, ('0x' || substr(md5('negatives|' || row_id), 1, 8))::bigint % s.size start,
      {stride_sql("md5('negatives|' || row_id)", 's.size')} stride
      from a join (select label, max(size) size from n group by 1) s using (label)),
sc as (select row_id, n.vec_id negative, round(pos, 9) pos_sim, round(list_dot_product(w.e, n.e), 9) neg_sim
       from w join n on n.label = w.label and n.place = (start + pick * stride) % w.size + 1)
"""
_LOSS_SQL = _SCORED_SQL + """,
l as (select row_id, ln(1 + sum(exp((neg_sim - pos_sim) / 0.07))) loss,
      ln(1 + coalesce(sum(exp((neg_sim - pos_sim) / 0.07)) filter (neg_sim >= pos_sim - 0.1), max(exp((neg_sim - pos_sim) / 0.07)))) hard_loss
      from sc group by 1)
"""

_LONG = "unnest(range(0, 64))::int dim, round(unnest({}), 6) x"

QUERIES = {
    "topk_columns": (topk_columns, f"with {_TOP_SQL} select * from top"),
    "approx_topk": (approx_topk, f"with {_approx_sql()} select * from near"),
    "approx_recall": (
        approx_recall,
        f"""with {_approx_sql()}, s2 as (select q.vec_id question_id, d.vec_id doc_id, q.label,
        round(list_dot_product(q.e, d.e) / (q.n * d.n), 9) score from u q join u d on q.label = d.label),
        top as (select question_id, doc_id, label, row_number() over (partition by question_id order by score desc, doc_id) r from s2 qualify r <= {K}),
        rec as (select t.question_id, t.label, sum((n.doc_id is not null)::int) / count(*) recall from top t
                left join near n on n.question_id = t.question_id and n.doc_id = t.doc_id group by 1, 2)
        select label db_id, round(avg(recall), 6) recall from rec group by 1""",
    ),
    "grouped_hits": (
        grouped_hits,
        f"""with {_TOP_SQL}, g as (select question_id, 't' || (doc_id % 5) table_name, min("rank") best,
        string_agg('c' || doc_id, ',' order by "rank") "columns" from top group by 1, 2)
        select question_id, table_name, row_number() over (partition by question_id order by best)::int table_rank, "columns" from g""",
    ),
    "query_text": (
        query_text,
        f"""with {CATALOG_SQL}, q as (select event_id question_id, '{_PREFIX}' || {_QUESTION} t, {_EVIDENCE} e from ev)
        select question_id, t || case when e <> '' then ' ' || e else '' end query_text,
        t || case when e <> '' then '  ' || e else '' end training_query_text from q""",
    ),
    "embed_text": (
        embed_text,
        f"""with t as (select doc_id, unnest({_dims_sql('text')}) dim from documents),
        idf as (select dim, ln((1.0 + (select count(*) from documents)) / (1.0 + count(distinct doc_id))) + 1.0 w from t group by 1),
        x as (select doc_id, dim, count(*) * any_value(w) x from t join idf using (dim) group by 1, 2),
        n as (select doc_id, sqrt(sum(x * x)) n from x group by 1)
        select doc_id, dim::int dim, round(x / n, 6) weight from x join n using (doc_id)""",
    ),
    "retrieve_schema": (retrieve_schema, _RETRIEVE_SQL),
    "mean_pool": (
        mean_pool,
        """with x as (select label, unnest(range(0, 64))::int dim, unnest(embedding)::double v from embeddings)
        select label db_id, dim, round(avg(v), 6) x from x group by 1, 2""",
    ),
    "last_token_pool": (
        last_token_pool,
        f"""with m as (select label, arg_max(embedding::double[], vec_id) e from embeddings where vec_id % 3 <> 0 group by 1)
        select label db_id, {_LONG.format('e')} from m""",
    ),
    "l2_normalise": (
        l2_normalise_vectors,
        f"""with m as (select vec_id, [x * vec_id for x in embedding::double[]] e from embeddings),
        n as (select vec_id, e, sqrt(list_dot_product(e, e)) n from m),
        u as (select vec_id, case when n = 0 then e else [x / n for x in e] end e from n)
        select vec_id, {_LONG.format('e')} from u""",
    ),
    "samples_per_db": (samples_per_db, "select 'db_' || user_id db_id, count(*) n_samples from events group by 1"),
    "pos_neg_split": (
        pos_neg_split,
        f"""with {CATALOG_SQL}, {LINKS_SQL}, p as (select question_id, count(*) n from links group by 1),
        h as (select user_id, count(*) n from cat group by 1)
        select event_id question_id, 'db_' || ev.user_id db_id, coalesce(p.n, 0) n_positive, h.n - coalesce(p.n, 0) n_negative
        from ev left join p on question_id = event_id left join h on h.user_id = ev.user_id""",
    ),
    "explode_positives": (
        explode_positives,
        f"with {CATALOG_SQL}, {LINKS_SQL} select question_id, db_id, doc_id from links",
    ),
    "sampled_negatives": (
        sampled_negatives,
        f"""with {CATALOG_SQL}, {LINKS_SQL},
        ring as (select db_id, doc_id, row_number() over (partition by db_id order by md5('negatives|' || doc_id), doc_id) place from cat),
        size as (select db_id, count(*) n from cat group by 1),
        used as (select question_id, count(*) n from links group by 1),
        w as (select question_id, db_id, doc_id positive, unnest(range(0, least(7 + used.n, size.n))) pick, size.n size,
              ('0x' || substr(md5('negatives|' || question_id || '|' || doc_id), 1, 8))::bigint % size.n start,
              {stride_sql("md5('negatives|' || question_id || '|' || doc_id)", 'size.n')} stride
              from links join used using (question_id) join size using (db_id)),
        t as (select w.question_id, positive, pick, ring.doc_id from w join ring on ring.db_id = w.db_id and place = (start + pick * stride) % size + 1
              where not exists (select 1 from links l where l.question_id = w.question_id and l.doc_id = ring.doc_id)),
        o as (select *, row_number() over (partition by question_id, positive order by pick)::int neg_rank from t)
        select question_id, positive, doc_id negative, neg_rank from o where neg_rank <= 7""",
    ),
    "hard_negatives": (
        hard_negatives,
        f"""with {_SCORED_SQL}, h as (select *, row_number() over (partition by row_id order by neg_sim desc, negative) n from sc)
        select row_id, negative from h where neg_sim >= pos_sim - 0.1 or n = 1""",
    ),
    "contrastive_score": (
        contrastive_score,
        f"with {_LOSS_SQL} select row_id, round(loss, 6) loss, round(hard_loss, 6) hard_loss from l",
    ),
    "mean_contrastive_score": (
        mean_contrastive_score,
        f"with {_LOSS_SQL} select round(avg(loss), 6) mean_loss, count(*) n_rows from l",
    ),
}
