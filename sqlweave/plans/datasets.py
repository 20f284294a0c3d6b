"""Training-set queries over the events catalog, documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.functions import text as T
from sqlweave.operators import catalog as C
from sqlweave.operators import datasets as B
from sqlweave.operators import linking
from sqlweave.operators import retrieval as R
from sqlweave.operators.ranking import gather_text, integer_bucket, position
from sqlweave.plans import catalog as catalog_plans
from sqlweave.plans import sqltext
from sqlweave.plans.bindings import CATALOG_SQL, LINKS_SQL, catalog, keyed_events, questions, stride_sql
from sqlweave.session import load, materialise, spread

TOP_K, TIMES = 25, 2


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return linking.used_columns(questions(spark, sf).select("question_id", "db_id", "sql"), catalog(spark, sf))


def schema_augment(spark, sf):
    needed = materialise(_links(spark, sf).select("question_id", "db_id", "doc_id"))
    augmented = B.augment_schemas(needed, catalog(spark, sf).select("db_id", "doc_id"), TOP_K, TIMES)
    return augmented.select("question_id", "variant", "doc_id", "is_needed")


def schema_needed(spark, sf):
    needed = _links(spark, sf).select("question_id", "db_id", "doc_id")
    kept = B.augment_schemas(needed, catalog(spark, sf).select("db_id", "doc_id"), 0, TIMES)
    return kept.select("question_id", "variant", "doc_id")


def wildcard_merge(spark, sf):
    chosen = materialise(
        _links(spark, sf).select(
            "question_id", "table_name",
            F.when(F.col("k") % 10 == 0, "*").otherwise(F.col("column_name")).alias("column_name"),
        )
    )
    return B.merge_wildcards(chosen, ["question_id"])


def dev_rows(spark, sf):
    """Odd events as rows; ids renumbered without gaps."""
    asked = sqltext.texts(spark, sf).select(
        (F.col("event_id") * 2 + 1).alias("question_id"),
        F.concat(F.lit(" \tevent "), "event_id", F.lit("\n")).alias("question"),
        F.when(F.col("event_id") % 3 == 0, F.lit(None)).otherwise(F.lit(" known ")).alias("evidence"),
        F.concat(F.lit("\n"), "sql", F.lit(" ")).alias("sql"),
    )
    return B.evaluation_rows(asked, running_id=True)


def test_rows(spark, sf):
    asked = sqltext.texts(spark, sf).select(
        F.col("event_id").alias("question_id"), F.lit("q ").alias("question"), F.lit(None).cast("string").alias("evidence"), "sql"
    )
    graded = T.with_clauses(asked, "sql").withColumn("counts", T.complexity(F.col("clauses")))
    rows = B.evaluation_rows(graded.withColumn("difficulty", T.difficulty(F.col("counts"))).drop("clauses", "counts"))
    return rows


def dedup_rows(spark, sf):
    documents = load(spark, sf, "documents").select("lang", "source", "text")
    unique = B.deduplicate_rows(documents)
    return unique.select("lang", "source", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


def dedup_lines(spark, sf):
    """Order and line keys once each, as canonical JSON."""
    keys = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    return B.deduplicate_rows(keys).select(B.canonical_json(["l_orderkey", "l_linenumber"]).alias("row"))


def _selection(links: DataFrame) -> DataFrame:
    """Used columns of every question with what their prompt line shows."""
    return links.select(
        "question_id", F.col("k").alias("pos"), "table_name", "column_name", "type",
        (F.col("k") % 5 == 0).alias("primary_key"),
        F.when(F.col("type") == "text", F.transform("values", lambda v: F.concat(F.lit('é"'), v))).otherwise(
            F.col("values")
        ).alias("sample_values"),
        F.concat("column_description", F.lit(" "), "value_description").alias("description"),
        F.col("display_name").alias("comment"),
        (F.col("k") % 25 == 7).alias("is_wildcard"),
    )


def prompt_render(spark, sf):
    """Whole prompts: question, schema lines, references, evidence."""
    links = materialise(_links(spark, sf))
    schema = B.schema_texts(_selection(links), ["question_id"], "pos")
    lines = C.distinct_foreign_keys(C.foreign_key_lines(catalog_plans.with_partners(spark, sf, links)))
    references = gather_text(lines.select("question_id", "pos", "fk"), ["question_id"], "pos", "fk", " | ")
    asked = questions(spark, sf).select("question_id", "question", "evidence")
    whole = (
        asked.join(schema.drop("n_lines"), "question_id", "left")
        .join(references.drop("n_lines"), "question_id", "left")
    )
    return whole.select(
        "question_id", B.prompt_text(F.col("question"), F.col("schema_text"), F.col("fk"), F.col("evidence")).alias("prompt"),
    )


def _chats(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation turn as a prompt; odd turns carry a failed answer and its message."""
    odd = F.col("turn") % 2 == 1
    return load(spark, sf, "conversations").select(
        "conv_id", "turn", "role",
        F.concat(F.lit("<|im_start|>system\nbe brief\nplease<|im_end|>\n"),
                 B.chat_prompt(F.col("text"), F.when(odd, "SELECT 1"), F.when(odd, F.concat(F.lit("no such table "), "role")))).alias("chat"),
        F.concat(F.lit(" SELECT "), "turn").alias("sql_gt"),
        F.concat(F.lit("SELECT "), "role").alias("sql_pred"),
    )


def chat_layout(spark, sf):
    return _chats(spark, sf).select("conv_id", "turn", B.drop_system_turn(F.col("chat")).alias("chat"))


def input_by_phase(spark, sf):
    chat, gold = F.col("chat"), F.col("sql_gt")
    return _chats(spark, sf).select(
        "conv_id", "turn",
        F.md5(B.model_input(chat, gold, "prompt")).alias("prompt"),
        F.md5(B.model_input(chat, gold, "fence")).alias("fence"),
        F.md5(B.model_input(chat, gold, "answer")).alias("answer"),
    )


def preference_rows(spark, sf):
    rows = _chats(spark, sf).select("conv_id", "turn", *B.preference_row(F.col("chat"), F.col("sql_gt"), F.col("sql_pred")))
    return B.short_prompts(rows, "prompt", 4000)


def revision_rows(spark, sf):
    """Prompts of wrong attempts: the unprocessed prediction where there is one, and the message."""
    wrong = keyed_events(spark, sf).filter(~F.col("event_type").isin("purchase", "signup"))
    previous = F.coalesce(F.when(F.col("k") % 2 == 0, F.concat(F.lit("SELECT raw "), "k")), F.concat(F.lit("SELECT "), "k"))
    chat = B.chat_prompt(F.concat(F.lit("count "), "event_type"), previous, F.lit("runnable but wrong"))
    return wrong.select(F.col("event_id").alias("question_id"), B.model_input(chat, F.lit(""), "prompt").alias("prompt"))


def _ids(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as ids: the length of every space-separated word."""
    return spread(load(spark, sf, "documents")).select("doc_id", F.transform(F.split("text", " "), F.length).alias("ids"))


def label_mask(spark, sf):
    masked = _ids(spark, sf).select("doc_id", "ids", B.mask_prompt(F.col("ids"), F.col("doc_id") % 50).alias("labels"))
    return masked.select(
        "doc_id",
        F.size(F.filter("labels", lambda x: x == B.MASKED)).alias("n_masked"),
        F.aggregate("labels", F.lit(0).cast("long"), lambda a, x: a + F.when(x != B.MASKED, x).otherwise(0)).alias("total"),
        F.size("labels").alias("n"),
    )


def truncate(spark, sf):
    cut = _ids(spark, sf).select(
        "doc_id", B.keep_last(F.col("ids"), 100).alias("tail"), B.keep_first(F.col("ids"), 100).alias("head")
    )
    return cut.select("doc_id", F.array_join("tail", " ").alias("prompt"), F.array_join("head", " ").alias("completion"))


def length_filter(spark, sf):
    return B.short_enough(_ids(spark, sf), "ids", 3000).select("doc_id", F.size("ids").alias("n_tokens"))


def training_schemas(spark, sf):
    """Both schema variants by table: how many columns a question uses, and how many its database has."""
    links = _links(spark, sf)
    related = links.groupBy("question_id", "db_id", "table_name").agg(
        F.count(F.lit(1)).alias("n_related"), F.min("column_name").alias("first_column")
    )
    full = catalog(spark, sf).groupBy("db_id", "table_name").agg(F.count(F.lit(1)).alias("n_full"))
    return related.join(full, ["db_id", "table_name"])


def contrastive_rows(spark, sf):
    """Query text and positive document of every training row."""
    links = _links(spark, sf)
    asked = questions(spark, sf).select(
        "question_id", R.query_text(F.col("question"), F.col("evidence"), gap="  ").alias("query_text")
    )
    document = C.training_document(
        F.lower("table_name"), F.lower("column_name"), F.col("column_description"),
        C.clean_value_description(F.col("value_description")),
    )
    return links.select("question_id", document.alias("positive")).join(asked, "question_id")


def attempt_table(spark, sf):
    dataset = questions(spark, sf).withColumnRenamed("sql", "sql_gt").drop("user_id", "event_type", "k")
    predictions = keyed_events(spark, sf).select(
        F.col("event_id").alias("question_id"),
        F.array(F.concat(F.lit("SELECT "), "k"), F.concat(F.lit("SELECT "), "value")).alias("candidates"),
    )
    rows = B.attempt_rows(dataset, predictions)
    return rows.withColumn("candidates", F.array_join("candidates", ";"))


_AUGMENT_SQL = f"""with {CATALOG_SQL}, {LINKS_SQL}, v as (select unnest(range(1, {TIMES} + 1))::int variant),
needed as (select question_id, db_id, count(*) n from links group by 1, 2),
ring as (select db_id, doc_id, row_number() over (partition by db_id order by md5('augment|' || doc_id), doc_id) place from cat),
size as (select db_id, count(*) size from cat group by 1),
w as (select question_id, variant, db_id, n, size, unnest(range(0, least(case when n < {TOP_K} then {TOP_K} else 0 end, size))) pick,
      ('0x' || substr(md5('augment|' || question_id || '|' || variant), 1, 8))::bigint % size start,
      {stride_sql("md5('augment|' || question_id || '|' || variant)", 'size')} stride
      from needed join size using (db_id) cross join v),
p as (select w.question_id, variant, doc_id, n, pick from w join ring on ring.db_id = w.db_id and place = (start + pick * stride) % size + 1
      where not exists (select 1 from links l where l.question_id = w.question_id and l.doc_id = ring.doc_id)),
d as (select *, row_number() over (partition by question_id, variant order by pick) r from p)
select question_id, variant, doc_id, true is_needed from links cross join v
union all select question_id, variant, doc_id, false from d where r <= {TOP_K} - n"""

_CHAT_SQL = """c as (select conv_id, turn, "role", '<|im_start|>user' || chr(10) || text || '<|im_end|>' || chr(10)
|| case when turn % 2 = 1 then '<|im_start|>assistant' || chr(10) || 'SELECT 1<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10)
|| '### Error Message' || chr(10) || 'no such table ' || "role" || '<|im_end|>' || chr(10) else '' end
|| '<|im_start|>assistant' || chr(10) chat, 'SELECT ' || turn gold, 'SELECT ' || "role" pred from conversations)"""

_PROMPT_SQL = catalog_plans._SEL_SQL + """,
ln as (select l.question_id, c.k, case when c.k % 25 = 7 then c.table_name || '.*' else c.table_name || '.' || c.column_name ||
  ' = {"type": "' || upper(c."type") || '", "primary_key": ' || (c.k % 5 = 0)::varchar ||
  ', "values": [' || case when c."type" = 'text' then array_to_string(['"\\u00e9\\"' || x || '"' for x in c."values"], ', ')
                     else array_to_string(c."values", ', ') end || ']' ||
  ', "description": "' || trim(c.column_description || ' ' || c.value_description) || '"' ||
  ', "comment": "' || c.display_name || '"}' end line from links l join cat c using (doc_id)),
sch as (select question_id, string_agg(line, chr(10) order by k, line) s from ln group by 1),
fks as (select question_id, string_agg(table_name || '.' || column_name || ' = ' || foreign_key, ' | ' order by pos,
        table_name || '.' || column_name || ' = ' || foreign_key) f from sel where foreign_key is not null and not wild group by 1)
select event_id question_id, '### Question' || chr(10) || 'How many ' || event_type || ' events have key ' || k || '?' || chr(10)
 || chr(10) || '### Database' || chr(10) || '-- Tables and Columns' || chr(10) || s
 || case when f is not null then chr(10) || chr(10) || '-- Foreign Keys' || chr(10) || f else '' end
 || case when k % 2 = 0 then chr(10) || chr(10) || '-- Evidence' || chr(10) || 'key ' || k || ' means ' || event_type else '' end prompt
from ev join sch on sch.question_id = event_id left join fks on fks.question_id = event_id"""

_IDS_SQL = "i as (select doc_id, [length(w) for w in string_split(text, ' ')] ids from documents)"

QUERIES = {
    "schema_augment": (schema_augment, _AUGMENT_SQL),
    "schema_needed": (
        schema_needed,
        f"with {CATALOG_SQL}, {LINKS_SQL} select question_id, unnest([1, 2]) variant, doc_id from links",
    ),
    "wildcard_merge": (
        wildcard_merge,
        f"""with {CATALOG_SQL}, {LINKS_SQL}, s as (select l.question_id, l.table_name, case when k % 10 = 0 then '*' else l.column_name end column_name
        from links l join cat using (doc_id)), m as (select *, max((column_name = '*')::int) over (partition by question_id, table_name) st from s)
        select distinct question_id, table_name, case when st = 1 then '*' else column_name end column_name from m""",
    ),
    "dev_rows": (
        dev_rows,
        f"""with {sqltext.TEXTS_SQL}, n as (select event_id, {sqltext._norm_sql("sql")} t from texts)
        select event_id question_id, 'event ' || event_id question, case when event_id % 3 = 0 then '' else 'known' end evidence,
        case when ends_with(t, ';') then t else t || ';' end sql_gt from n""",
    ),
    "test_rows": (
        test_rows,
        f"""with {sqltext.TEXTS_SQL}, n as (select event_id, {sqltext._norm_sql("sql")} t from texts)
        select event_id question_id, 'q' question, '' evidence, {sqltext._choose_sql([s[1] for s in sqltext.SHAPES])} difficulty,
        case when ends_with(t, ';') then t else t || ';' end sql_gt from n""",
    ),
    "dedup_rows": (
        dedup_rows,
        "select lang, source, md5(text) digest, length(text)::int n_chars from (select distinct lang, source, text from documents)",
    ),
    "dedup_lines": (
        dedup_lines,
        """select '{"l_linenumber":' || l_linenumber || ',"l_orderkey":' || l_orderkey || '}' "row"
        from (select distinct l_orderkey, l_linenumber from lineitem)""",
    ),
    "prompt_render": (prompt_render, _PROMPT_SQL),
    "chat_layout": (chat_layout, f"with {_CHAT_SQL} select conv_id, turn, chat from c"),
    "input_by_phase": (
        input_by_phase,
        f"""with {_CHAT_SQL}, s as (select *, {sqltext._strip_sql('chat')} p from c)
        select conv_id, turn, md5(p) prompt, md5(p || chr(10) || '```sql' || chr(10)) fence,
        md5(p || chr(10) || gold || '<|im_end|>') answer from s""",
    ),
    "preference_rows": (
        preference_rows,
        f"""with {_CHAT_SQL} select conv_id, turn, chat prompt, ' ' || gold || '<|im_end|>' chosen, pred || '<|im_end|>' rejected
        from c where length(chat) <= 4000""",
    ),
    "revision_rows": (
        revision_rows,
        """with e as (select event_id, event_type, json_extract_string(props, '$.k')::int k from events
        where event_type not in ('purchase', 'signup'))
        select event_id question_id, '<|im_start|>user' || chr(10) || 'count ' || event_type || '<|im_end|>' || chr(10)
        || '<|im_start|>assistant' || chr(10) || case when k % 2 = 0 then 'SELECT raw ' else 'SELECT ' end || k || '<|im_end|>' || chr(10)
        || '<|im_start|>user' || chr(10) || '### Error Message' || chr(10) || 'runnable but wrong<|im_end|>' || chr(10)
        || '<|im_start|>assistant' prompt from e""",
    ),
    "label_mask": (
        label_mask,
        f"""with {_IDS_SQL} select doc_id, least(doc_id % 50, len(ids))::int n_masked,
        coalesce(list_sum(ids[(doc_id % 50 + 1)::int:]), 0)::bigint total, len(ids)::int n from i""",
    ),
    "truncate": (
        truncate,
        f"""with {_IDS_SQL} select doc_id, array_to_string(ids[greatest(len(ids) - 99, 1)::int:], ' ') prompt,
        array_to_string(ids[1:100], ' ') completion from i""",
    ),
    "length_filter": (
        length_filter,
        f"with {_IDS_SQL} select doc_id, len(ids)::int n_tokens from i where len(ids) <= 3000",
    ),
    "training_schemas": (
        training_schemas,
        f"""with {CATALOG_SQL}, {LINKS_SQL}, f as (select db_id, table_name, count(*) n_full from cat group by 1, 2)
        select question_id, db_id, table_name, count(*) n_related, min(column_name) first_column, any_value(n_full) n_full
        from links join f using (db_id, table_name) group by 1, 2, 3""",
    ),
    "contrastive_rows": (
        contrastive_rows,
        f"""with {CATALOG_SQL}, {LINKS_SQL} select l.question_id,
        '<table>' || lower(c.table_name) || '</table> <column>' || lower(c.column_name) || '</column>'
        || case when column_description <> '' then ' <column description>' || column_description || '</column_description>' else '' end
        || case when value_description <> '' then ' <value description>' || trim(substr(value_description, 11), ' ') || '</value description>' else '' end positive,
        '{R.INSTRUCTION.replace(chr(10), "' || chr(10) || '")}' || 'How many ' || ev.event_type || ' events have key ' || ev.k || '?'
        || case when ev.k % 2 = 0 then '  key ' || ev.k || ' means ' || ev.event_type else '' end query_text
        from links l join cat c using (doc_id) join ev on ev.event_id = l.question_id""",
    ),
    "attempt_table": (
        attempt_table,
        """with e as (select event_id, user_id, event_type, value, json_extract_string(props, '$.k')::int k from events)
        select event_id question_id, 'db_' || user_id db_id, 'How many ' || event_type || ' events have key ' || k || '?' question,
        case when k % 2 = 0 then 'key ' || k || ' means ' || event_type else '' end evidence,
        'SELECT T1.K' || k || ', K' || (k + 1) || ' FROM ' || upper(event_type) || ' AS T1 WHERE T1.K' || k || ' > '
        || round(value)::int || ' AND name = ''K' || (k + 3) || ' from view'' ORDER BY K' || (k - 1) sql_gt,
        'SELECT ' || k || ';SELECT ' || value candidates from e""",
    ),
}
