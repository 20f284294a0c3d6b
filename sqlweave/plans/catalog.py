"""Catalog operators: nested catalogs read out of documents, column catalogs out of events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlweave.operators import catalog as C
from sqlweave.operators import linking
from sqlweave.plans.bindings import CATALOG_SQL, LINKS_SQL, catalog, keyed_events, questions
from sqlweave.session import load, materialise, spread


def nested_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    """A document as a catalog: lines are tables, words are columns, all built inside its row."""
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    words = F.flatten(
        F.transform(
            lines,
            lambda line, i: F.transform(
                F.filter(F.split(line, " "), lambda w: w != ""),
                lambda w: F.struct(i.cast("int").alias("table_idx"), w.alias("name")),
            ),
        )
    )
    star = F.array(F.struct(F.lit(-1).alias("table_idx"), F.lit("*").alias("name")))
    rows = spread(load(spark, sf, "documents")).select("doc_id", lines.alias("lines"), F.concat(star, words).alias("columns"))
    indexes = F.sequence(F.lit(1), F.size("columns") - 1)
    return rows.filter(F.size("columns") > 1).select(
        F.concat(F.lit("doc_"), "doc_id").alias("db_id"),
        F.transform("lines", lambda _, i: F.concat(F.lit("line_"), i)).alias("table_names_original"),
        F.col("columns").alias("column_names_original"),
        F.transform("columns", lambda c: F.struct(c["table_idx"].alias("table_idx"), F.lower(c["name"]).alias("name"))).alias(
            "column_names"
        ),
        F.transform("columns", lambda c: F.when(F.length(c["name"]) % 2 == 0, "text").otherwise("number")).alias(
            "column_types"
        ),
        F.transform(
            F.filter(indexes, lambda i: i % 7 == 0),
            lambda i: F.when(i % 2 == 0, F.concat(F.lit("["), i, F.lit(", "), i + 1, F.lit("]"))).otherwise(i.cast("string")),
        ).alias("primary_keys"),
        F.transform(F.filter(indexes, lambda i: (i % 5 == 0)), lambda i: F.array(i, i - 1)).alias("foreign_keys"),
    )


_WORDS_SQL = """
l as (select doc_id, [x for x in string_split(text, chr(10)) if x <> ''] lines from documents),
t as (select doc_id, i - 1 table_idx, [x for x in string_split(lines[i], ' ') if x <> ''] words
      from (select doc_id, lines, unnest(range(1, len(lines) + 1)) i from l)),
w as (select doc_id, table_idx, j, words[j] word from (select doc_id, table_idx, words, unnest(range(1, len(words) + 1)) j from t)),
c as (select 'doc_' || doc_id db_id, row_number() over (partition by doc_id order by table_idx, j)::int col_idx,
      'line_' || table_idx table_name, word column_name from w)
"""
_FK_SQL = _WORDS_SQL + """,
f as (select a.db_id, a.col_idx // 5 - 1 n, a.table_name || '.' || a.column_name one,
      b.table_name || '.' || b.column_name other from c a join c b on a.db_id = b.db_id and b.col_idx = a.col_idx - 1
      where a.col_idx % 5 = 0),
e as (select db_id, (2 * n)::int edge_pos, one key_from, other key_to from f
      union all select db_id, (2 * n + 1)::int, other, one from f)
"""


def catalog_flatten(spark, sf):
    return C.flatten_columns(nested_catalogs(spark, sf))


def fk_edges(spark, sf):
    return C.foreign_key_edges(nested_catalogs(spark, sf))


def fk_partner(spark, sf):
    return C.foreign_key_partner(C.foreign_key_edges(nested_catalogs(spark, sf)))


# Columns of the given tables whose texts are the same in every engine; floating
# numbers, timestamps and vectors are written differently by Spark and DuckDB.
_SAMPLED = {
    "region": "r_regionkey r_name",
    "nation": "n_nationkey n_name n_regionkey",
    "customer": "c_custkey c_name c_nationkey c_mktsegment",
    "supplier": "s_suppkey s_name s_nationkey",
    "part": "p_partkey p_name p_brand p_type p_size",
    "orders": "o_orderkey o_custkey o_orderstatus o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_returnflag l_linestatus",
    "events": "event_id user_id event_type props",
    "documents": "doc_id text lang source n_chars",
    "embeddings": "vec_id label",
    "pages": "page_id url html",
    "benchmark": "item_id text",
    "labels": "doc_id quality toxic",
    "conversations": "conv_id turn role text",
}


def sample_values(spark, sf):
    """Sample values of every comparable column of every table, each table read once."""
    parts = [C.sample_values(load(spark, sf, t), t, columns.split()) for t, columns in _SAMPLED.items()]
    return reduce(DataFrame.union, parts)


def _sampled_sql() -> str:
    reads = [
        f"select '{t}' table_name, '{c}' column_name, {c}::varchar \"value\" from {t} group by 3"
        for t, columns in _SAMPLED.items()
        for c in columns.split()
    ]
    return f"""with v as ({' union all '.join(reads)}),
    p as (select *, row_number() over (partition by table_name, column_name order by "value") n from v where "value" is not null),
    s as (select *, row_number() over (partition by table_name, column_name
          order by md5('values|' || table_name || '|' || column_name || '|' || "value")) pick from p where n <= 10 and "value" <> '')
    select table_name, column_name, pick::int pick, "value" from s where pick <= 2"""


def clean_description(spark, sf):
    texts = spread(load(spark, sf, "documents"))
    raw = F.concat(F.when(F.col("doc_id") % 2 == 0, "Not Useful \n").otherwise(" commonsense evidence:"), F.col("text"))
    return texts.select(
        "doc_id", C.clean_description(raw).alias("description"), C.clean_value_description(raw).alias("value_description")
    )


def described_columns(spark, sf):
    columns = catalog(spark, sf)
    texts = columns.select(
        "db_id", F.lower("table_name").alias("table_name"),
        F.concat(F.lit(" "), F.upper("column_name")).alias("original_column_name"), "column_description", "value_description",
    )
    return C.describe_columns(columns.select("db_id", "table_name", "column_name", "type"), texts)


def column_documents(spark, sf):
    columns = catalog(spark, sf)
    table, column = F.lower("table_name"), F.lower("column_name")
    values = C.clean_value_description(F.col("value_description"))
    return columns.select(
        "doc_id",
        C.search_document(table, column, F.col("column_description"), values).alias("search_text"),
        C.training_document(table, column, F.col("column_description"), values).alias("training_text"),
    )


def restore_casing(spark, sf):
    """Lower-cased guesses: a question's own column and the one after, known or not."""
    events = keyed_events(spark, sf)
    guesses = events.select(
        F.col("event_id").alias("question_id"),
        F.concat(F.lit("db_"), "user_id").alias("db_id"),
        F.col("event_type").alias("table_name"),
        F.explode(F.array(F.concat(F.lit("k"), "k"), F.concat(F.lit("k"), F.col("k") + 1))).alias("column_name"),
    )
    return C.restore_casing(guesses, catalog(spark, sf))


def expand_columns(spark, sf):
    """Per question: how many guessed columns the catalog knows, with their types, and how many it rejects."""
    events = keyed_events(spark, sf)
    guesses = events.select(
        F.col("event_id").alias("question_id"),
        F.concat(F.lit("db_"), "user_id").alias("db_id"),
        F.initcap("event_type").alias("table_name"),
        F.explode(F.array(F.concat(F.lit("K"), "k"), F.concat(F.lit("K"), F.col("k") + 1))).alias("column_name"),
    )
    known, rejected = C.expand_columns(guesses, catalog(spark, sf).select("db_id", "table_name", "column_name", "type"))
    keys = ["question_id", "db_id", "table_name", "column_name"]
    return known.select(*keys, "type", F.lit("known").alias("status")).union(
        rejected.select(*keys, F.lit(None).cast("string").alias("type"), F.lit("rejected").alias("status"))
    )


def catalog_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Columns of one name in neighbouring tables of a database reference each other."""
    columns = catalog(spark, sf)
    next_table = F.lead("event_type").over(Window.partitionBy("user_id", "k").orderBy("event_type"))
    linked = columns.select("db_id", "user_id", "k", "event_type", next_table.alias("next_type")).filter(
        F.col("next_type").isNotNull()
    )
    return linked


def partner_edges(spark: SparkSession, sf: str) -> DataFrame:
    linked = catalog_edges(spark, sf)

    def name(kind: str):
        return F.concat(F.initcap(kind), F.lit(".K"), "k")

    place = F.ascii("event_type")
    return linked.select(
        "db_id",
        F.inline(
            F.array(
                F.struct((2 * place).alias("edge_pos"), name("event_type").alias("key_from"), name("next_type").alias("key_to")),
                F.struct((2 * place + 1).alias("edge_pos"), name("next_type").alias("key_from"), name("event_type").alias("key_to")),
            )
        ),
    )


def linked_selection(spark: SparkSession, sf: str) -> DataFrame:
    """Columns each question uses with the partner they keep."""
    used = materialise(
        linking.used_columns(questions(spark, sf).select("question_id", "db_id", "sql"), catalog(spark, sf))
    )
    return with_partners(spark, sf, used)


def with_partners(spark: SparkSession, sf: str, used: DataFrame) -> DataFrame:
    partners = C.foreign_key_partner(partner_edges(spark, sf)).withColumnRenamed("key_from", "own")
    return (
        used.withColumn("own", F.concat_ws(".", "table_name", "column_name"))
        .join(partners, ["db_id", "own"], "left")
        .select(
            "question_id", F.col("k").alias("pos"), "db_id", "table_name", "column_name", "foreign_key",
            (F.col("k") % 50 == 49).alias("is_wildcard"),
        )
    )


def fk_strings(spark, sf):
    lines = C.foreign_key_lines(linked_selection(spark, sf))
    return C.distinct_foreign_keys(lines)


PARTNER_SQL = """
pt as (select *, coalesce(lead(table_name) over w, lag(table_name) over w) || '.' || column_name foreign_key
       from cat window w as (partition by user_id, k order by event_type))
"""


def distinct_fk_lines(spark, sf):
    """Both directions of every reference, and some broken lines, per database."""
    lines = partner_edges(spark, sf).select(
        F.col("db_id").alias("question_id"),
        F.xxhash64("key_from", "key_to").alias("unused"),
        F.col("edge_pos").alias("pos"),
        F.when(F.col("edge_pos") % 7 == 0, F.concat("key_from", F.lit("="), "key_to", F.lit(" = x")))
        .otherwise(F.concat(F.lit(" "), "key_from", F.lit("="), "key_to"))
        .alias("fk"),
    ).drop("unused")
    return C.distinct_foreign_keys(lines)


def fk_components(spark, sf):
    linked = catalog_edges(spark, sf)

    def node(kind: str):
        return (F.col("k") * 1000 + F.ascii(kind)).cast("long")

    edges = linked.select("db_id", node("event_type").alias("a"), node("next_type").alias("b"))
    return C.connected_components(edges)


def name_ids(spark, sf):
    return C.name_ids(catalog(spark, sf))


def vocabulary(spark, sf):
    columns = catalog(spark, sf).select(
        F.col("display_name").alias("comment"),
        F.concat_ws(" ", "column_description", "value_description").alias("description"),
        F.when(F.col("type") == "text", F.transform("values", lambda v: F.concat(F.lit("v"), v))).otherwise(F.col("values")).alias(
            "sample_values"
        ),
    )
    return C.vocabulary_stats(columns)


def link_columns(spark, sf):
    used = linking.used_columns(questions(spark, sf).select("question_id", "db_id", "sql"), catalog(spark, sf))
    return used.select("question_id", "db_id", "table_name", "column_name")


def used_tables(spark, sf):
    return linking.used_tables(questions(spark, sf).select("question_id", "db_id", "sql"), catalog(spark, sf))


def table_columns(spark, sf):
    columns = catalog(spark, sf).select("db_id", "table_name", "column_name", F.col("k").alias("col_idx"))
    return C.table_columns(columns)


def linked_samples(spark, sf):
    """Questions that use a column another table references."""
    linked = linked_selection(spark, sf).filter(F.col("foreign_key").isNotNull())
    return C.linked_samples(questions(spark, sf).select("question_id", "question"), linked)


_SEL_SQL = f"""with {CATALOG_SQL}, {LINKS_SQL}, {PARTNER_SQL},
sel as (select l.question_id, p.k pos, l.db_id, l.table_name, l.column_name, p.foreign_key, p.k % 50 = 49 wild
        from links l join pt p using (doc_id))"""

QUERIES = {
    "catalog_flatten": (
        catalog_flatten,
        f"""with {_WORDS_SQL}, s as (select db_id, max(col_idx) n from c group by 1)
        select db_id, col_idx, table_name, column_name, lower(column_name) display_name,
        case when length(column_name) % 2 = 0 then 'text' else 'number' end "type",
        (col_idx % 7 = 0) or (col_idx > 1 and (col_idx - 1) % 14 = 0) is_pk from c""",
    ),
    "fk_edges": (fk_edges, f"with {_FK_SQL} select * from e"),
    "fk_partner": (fk_partner, f"with {_FK_SQL} select db_id, key_from, arg_max(key_to, edge_pos) foreign_key from e group by 1, 2"),
    "sample_values": (sample_values, _sampled_sql()),
    "clean_description": (
        clean_description,
        """with r as (select doc_id, trim(replace(replace(case when doc_id % 2 = 0 then 'Not Useful ' || chr(10) else
        ' commonsense evidence:' end || text, chr(10), ' '), 'commonsense evidence:', ''), ' ' || chr(9)) d from documents)
        select doc_id, d description, case when lower(d) like 'not useful%' then trim(substr(d, 11), ' ' || chr(9)) else d end value_description from r""",
    ),
    "described_columns": (
        described_columns,
        f"""with {CATALOG_SQL} select db_id, table_name, column_name, "type",
        case when column_description <> '' then column_description || ' ' else '' end
        || case when value_description <> '' then trim(substr(value_description, 11), ' ') else '' end description from cat""",
    ),
    "column_documents": (
        column_documents,
        f"""with {CATALOG_SQL}, d as (select doc_id, lower(table_name) t, lower(column_name) c, column_description d,
        trim(substr(value_description, 11), ' ') v from cat)
        select doc_id, 'table:' || t || chr(10) || 'column:' || c
        || case when d <> '' then chr(10) || 'column_desc:' || d || '. ' else '' end
        || case when v <> '' then chr(10) || 'value_desc:' || v || '.' else '' end search_text,
        '<table>' || t || '</table> <column>' || c || '</column>'
        || case when d <> '' then ' <column description>' || d || '</column_description>' else '' end
        || case when v <> '' then ' <value description>' || v || '</value description>' else '' end training_text from d""",
    ),
    "restore_casing": (
        restore_casing,
        f"""with {CATALOG_SQL}, g as (select event_id, user_id, event_type, unnest([k, k + 1]) k from ev)
        select event_id question_id, 'db_' || g.user_id db_id, upper(g.event_type[1]) || g.event_type[2:] table_name,
        coalesce(c.column_name, 'k' || g.k) column_name from g left join cat c
        on c.user_id = g.user_id and c.event_type = g.event_type and c.k = g.k""",
    ),
    "expand_columns": (
        expand_columns,
        f"""with {CATALOG_SQL}, g as (select event_id, user_id, event_type, unnest([k, k + 1]) k from ev)
        select event_id question_id, 'db_' || g.user_id db_id, upper(g.event_type[1]) || g.event_type[2:] table_name,
        'K' || g.k column_name, c."type", case when c.doc_id is null then 'rejected' else 'known' end status
        from g left join cat c on c.user_id = g.user_id and c.event_type = g.event_type and c.k = g.k""",
    ),
    "fk_strings": (
        fk_strings,
        _SEL_SQL + """, f as (select s.question_id, s.pos, s.table_name || '.' || s.column_name one, s.foreign_key other
        from sel s where s.foreign_key is not null and not s.wild)
        select f.question_id, f.pos, one || ' = ' || other fk, exists (select 1 from sel x where x.question_id = f.question_id
        and x.table_name || '.' || x.column_name = other) target_selected from f""",
    ),
    "distinct_fk_lines": (
        distinct_fk_lines,
        f"""with {CATALOG_SQL}, n as (select *, lead(table_name) over (partition by user_id, k order by event_type) nxt,
        ascii(event_type) place from cat),
        d as (select db_id, table_name || '.' || column_name one, nxt || '.' || column_name other, 2 * place p0, 2 * place + 1 p1 from n where nxt is not null)
        select db_id question_id, case when p0 % 7 <> 0 then p0 else p1 end pos,
        case when p0 % 7 <> 0 then one || ' = ' || other else other || ' = ' || one end fk from d""",
    ),
    "fk_components": (
        fk_components,
        f"""with {CATALOG_SQL}, g as (select db_id, k, event_type, count(*) over w n, min(ascii(event_type)) over w low
        from cat window w as (partition by db_id, k))
        select db_id, (k * 1000 + ascii(event_type))::bigint node, (k * 1000 + low)::bigint label from g where n > 1""",
    ),
    "name_ids": (
        name_ids,
        f"""with {CATALOG_SQL}, n as (select db_id, lower(table_name || '.' || column_name) "name" from cat
        union all select distinct db_id, lower(table_name) from cat)
        select db_id, "name", '__' || "name" || '__' name_id from n union all select distinct db_id, '*', '__all__' from cat""",
    ),
    "vocabulary": (
        vocabulary,
        f"""with {CATALOG_SQL}, e as (select 'comment' kind, display_name entry from cat
        union select 'description', column_description || ' ' || value_description from cat
        union select 'value', 'v' || unnest("values") from cat where "type" = 'text')
        select kind, count(*) n_distinct from e group by 1""",
    ),
    "link_columns": (
        link_columns,
        f"with {CATALOG_SQL}, {LINKS_SQL} select question_id, db_id, table_name, column_name from links",
    ),
    "used_tables": (
        used_tables,
        "select event_id question_id, 'db_' || user_id db_id, upper(event_type[1]) || event_type[2:] table_name from events",
    ),
    "table_columns": (
        table_columns,
        f"""with {CATALOG_SQL} select db_id, table_name, string_agg(column_name, ',' order by k) column_name,
        count(*)::int n_lines from cat group by 1, 2""",
    ),
    "linked_samples": (
        linked_samples,
        _SEL_SQL + """select distinct s.question_id, 'How many ' || event_type || ' events have key ' ||
        json_extract_string(props, '$.k') || '?' question from sel s join events on event_id = s.question_id
        where foreign_key is not null""",
    ),
}
