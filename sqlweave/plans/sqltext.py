"""SQL text operators over query texts built from events, and over whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.functions import text as T
from sqlweave.operators import slots
from sqlweave.plans.bindings import keyed_events
from sqlweave.session import load, spread

# Query shapes: template, difficulty, (component1, component2, others). $T event type, $K key, $V value.
SHAPES = [
    ("SELECT DISTINCT name FROM $T WHERE k > = $K", "easy", (1, 0, 0)),
    ("SELECT count( * ), max(v) FROM $T GROUP BY k;", "medium", (1, 0, 2)),
    (
        "SELECT T1.name,  T2.v FROM $T AS T1 JOIN log AS T2 ON T1.id = T2.id WHERE T1.k = $K AND T2.name LIKE \"%a  ( b )%\"",
        "hard", (3, 0, 2),
    ),
    ("SELECT name FROM $T WHERE id IN ( SELECT id FROM log WHERE v < $V )", "hard", (1, 1, 0)),
    (
        "SELECT name FROM $T WHERE y = YEAR( CURDATE() ) ORDER BY v DESC LIMIT $K",
        "hard", (3, 0, 0),
    ),
    (
        "SELECT name FROM $T WHERE k ! = $K OR v < = $V UNION SELECT name FROM log WHERE note = 'distinct value' ;",
        "extra", (2, 1, 1),
    ),
    (
        "SELECT name, count(*) FROM $T WHERE k BETWEEN $K AND $V GROUP BY name HAVING count(*) > 2 ORDER BY count(*) ASC",
        "hard", (3, 0, 2),
    ),
    ("SELECT avg(v) FROM $T\tWHERE name = \"it's\" AND k = $K", "medium", (1, 0, 1)),
]


def _fill(template: Column) -> Column:
    out = F.replace(template, F.lit("$T"), F.col("event_type"))
    out = F.replace(out, F.lit("$K"), F.col("k").cast("string"))
    return F.replace(out, F.lit("$V"), F.col("value").cast("string"))


def _choose(values: list, shift: int = 0) -> Column:
    which = (F.col("event_id") + shift) % len(SHAPES)
    out = F.when(which == 0, values[0])
    for i, value in enumerate(values[1:], 1):
        out = out.when(which == i, value)
    return out


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _choose_sql(values: list, shift: int = 0) -> str:
    cases = " ".join(f"when {i} then {_quoted(v) if isinstance(v, str) else v}" for i, v in enumerate(values))
    return f"case (event_id + {shift}) % {len(SHAPES)} {cases} end"


def texts(spark: SparkSession, sf: str) -> DataFrame:
    templates = [s[0] for s in SHAPES]
    return spread(keyed_events(spark, sf)).select(
        "event_id", _fill(_choose(templates)).alias("sql"), _fill(_choose(templates, 1)).alias("other")
    )


def _filled_sql(shift: int) -> str:
    template = _choose_sql([s[0] for s in SHAPES], shift)
    return f"replace(replace(replace({template}, '$T', event_type), '$K', json_extract_string(props, '$.k')), '$V', value::varchar)"


TEXTS_SQL = f"texts as (select event_id, {_filled_sql(0)} sql, {_filled_sql(1)} other from events)"

_SP = T.SPACE
_LIT = "''(?:[^'']|'''')*''|\"(?:[^\"]|\"\")*\""
_NAME = "`[^`]*`|\\[[A-Za-z_][^\\]]*\\]"
_TOKEN = f"({_LIT}|{_NAME}|[!<>=]=|<>|\\|\\||\\w+(?:\\.(?:\\w+|{_NAME}|\\*))*|\\.\\d+|[^\\s\\w])"


def _ops_sql(x: str) -> str:
    return f"replace(replace(replace({x}, '< =', '<='), '> =', '>='), '! =', '!=')"


def _norm_sql(x: str) -> str:
    out = f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'), ' ')"
    out = f"regexp_replace({out}, '\"([^\"]*)\"', '''\\1''', 'g')"
    out = f"regexp_replace({out}, '\\({_SP}*', '(', 'g')"
    return f"regexp_replace({out}, '{_SP}*\\)', ')', 'g')"


def _closed_sql(x: str) -> str:
    return f"(with n as (select {x} t) select case when ends_with(t, ';') then t else t || ';' end from n)"


_NODISTINCT = f"regexp_replace({{}}, '({_LIT})|\\b(?i:distinct)\\b', '\\1', 'g')"
_YEAR = f"(?i)YEAR{_SP}*\\({_SP}*CURDATE{_SP}*\\({_SP}*\\){_SP}*\\){_SP}*"


def _tokens_sql(x: str) -> str:
    plain = f"regexp_replace(trim({x}, ' '), '[;\\t]', '', 'g')"
    return f"regexp_extract_all({_ops_sql(f'regexp_replace({plain}, $r$\\b[tT][123]\\.\\*$r$, $r$*$r$, $r$g$r$)')}, '{_TOKEN}', 1)"


_ISLIT = f"regexp_full_match(t, '{_LIT}|\\d+(?:\\.\\d+)?|\\.\\d+')"


def _slots_sql(x: str) -> str:
    return f"array_to_string([case when {_ISLIT} then 'valuerare' else lower(t) end for t in {_tokens_sql(x)}], ' ')"


def normalise_sql(spark, sf):
    """Query texts and all document texts, each as a whole."""
    asked = texts(spark, sf).select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), "sql")
    prose = spread(load(spark, sf, "documents")).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("sql"))
    both = asked.union(prose)
    return both.select("kind", "id", T.normalise_sql(F.col("sql")).alias("sql"))


def clean_sql(spark, sf):
    sql = F.col("sql")
    return texts(spark, sf).select(
        "event_id",
        T.join_operators(sql).alias("joined"),
        T.fix_current_year(sql).alias("fixed_year"),
        T.remove_distinct(sql).alias("no_distinct"),
        T.fill_placeholder(sql).alias("filled"),
        T.reformat(sql).alias("reformatted"),
    )


def tokenise(spark, sf):
    sql = F.col("sql")
    return texts(spark, sf).select(
        "event_id",
        F.when(T.quotes_balanced(sql), F.array_join(T.tokens(sql), "¦")).alias("tokens"),
        T.quotes_balanced(sql).alias("balanced"),
    )


def strip_literals(spark, sf):
    """How often every query fingerprint occurs in the log, and how many literals it has."""
    words = texts(spark, sf).select(T.reformat_tokens(F.col("sql")).alias("words"))
    slotted = words.select(
        T.slot_text(F.col("words")).alias("fingerprint"), F.size(T.literals(F.col("words"))).alias("n_literals")
    )
    return slotted.groupBy("fingerprint", "n_literals").agg(F.count(F.lit(1)).alias("n_queries"))


def slot_fillings(spark, sf):
    pairs = texts(spark, sf).select(
        F.col("event_id").alias("query_id"), F.col("sql").alias("sql_gt"), F.col("other").alias("sql_pred")
    )
    return slots.slot_fillings(pairs)


def first_candidates(spark, sf):
    pairs = texts(spark, sf).select(
        F.col("event_id").alias("query_id"), F.col("other").alias("sql_gt"), F.col("sql").alias("sql_pred")
    )
    return slots.first_round_candidates(pairs)


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    turns = load(spark, sf, "conversations")
    marked = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    twice = F.concat(marked, F.lit("<|im_start|>assistant again\t"), "text", F.lit(" <|endoftext|>"))
    fenced = F.concat(F.lit("Answer:\n```sql\n  "), "text", F.lit("\n```\nrest ```sql x```"))
    return turns.select(
        "conv_id", "turn", twice.alias("chat"),
        F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(fenced).alias("answer"),
    )


def extract_block(spark, sf):
    chat = _chat(spark, sf)
    return chat.select(
        "conv_id",
        "turn",
        T.first_sql_block(F.col("answer")).alias("sql_block"),
        T.assistant_turn(F.col("chat"), revised=False).alias("first_turn"),
        T.assistant_turn(F.col("chat"), revised=True).alias("last_turn"),
    )


def difficulty(spark, sf):
    parsed = T.with_clauses(texts(spark, sf), "sql")
    counted = parsed.select("event_id", T.complexity(F.col("clauses")).alias("n"))
    return counted.select("event_id", "n.component1", "n.component2", "n.others", T.difficulty(F.col("n")).alias("level"))


# Keywords of the shapes above, in listing order.
SHAPE_KEYWORDS = [
    "where", "group", "where like", "where in", "where desc order limit", "where union or",
    "where group having asc order", "where",
]
SHAPE_NESTING = [(0, 0), (0, 0), (0, 0), (1, 0), (0, 0), (0, 1), (0, 0), (0, 0)]


def keyword_sets(spark, sf):
    parsed = T.with_clauses(texts(spark, sf), "sql")
    return parsed.select("event_id", F.array_join(T.keyword_set(F.col("clauses")), " ").alias("keywords"))


def nested_queries(spark, sf):
    return texts(spark, sf).select("event_id", T.nested_inventory(F.col("sql")).alias("n")).select(
        "event_id", "n.subqueries", "n.set_ops"
    )


# Typed comparison values of the shapes: (table, column, literal).
SHAPE_VALUES = [
    [(None, "K", "$K")],
    [],
    [(None, "K", "$K"), (None, "NAME", "%a ( b )%")],
    [(None, "V", "$V")],
    [],
    [(None, "K", "$K"), (None, "V", "$V"), (None, "NOTE", "distinct value")],
    [(None, "K", "$K"), (None, "K", "$V")],
    [(None, "NAME", "it's"), (None, "K", "$K")],
]


def typed_values(spark, sf):
    """Comparison literals of every query after operators are repaired, with the table named."""
    named = F.replace(T.join_operators(F.col("sql")), F.lit(" k "), F.lit(" Log.k "))
    found = texts(spark, sf).select("event_id", F.posexplode(T.typed_values(named)).alias("pos", "t"))
    return found.select("event_id", "pos", "t.table_name", "t.column_name", "t.literal")


def _typed_sql() -> str:
    rows = []
    for shape, values in enumerate(SHAPE_VALUES):
        for pos, (_, column, literal) in enumerate(values):
            # 'k' stands alone before every comparison except 'T1.k'.
            table = "null" if column != "K" or shape == 2 else "'log'"
            rows.append(f"({shape}, {pos}, {table}, {_quoted(column)}, {_quoted(literal)})")
    return f"""with v(shape, pos, table_name, column_name, template) as (values {', '.join(rows)})
    select event_id, pos, table_name, column_name,
    replace(replace(template, '$K', json_extract_string(props, '$.k')), '$V', value::varchar) literal
    from events join v on shape = event_id % {len(SHAPES)}"""


def unquote(spark, sf):
    """Every document and conversation line, quoted, comes back without its quotes."""
    prose = load(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit("'"), F.replace("text", F.lit("'"), F.lit("''")), F.lit("'")).alias("literal")
    )
    return prose.select("doc_id", T.unquote(F.col("literal")).alias("text"))


_BLOCK = f"(?s)```sql{_SP}*(.*?)(?:{_SP}*```|<\\|im_end\\|>|<ANSWER>|<\\|endoftext\\|>)"
_TURN = "(?s)<\\|im_start\\|>assistant(.*?)<\\|(?:im_end|endoftext)\\|>"


def _strip_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _fillings_sql(gold: str, pred: str) -> str:
    """Fillings in long form by recursion over the slots."""
    return f"""
    base as (select event_id query_id, {pred} own, string_split({_slots_sql(pred)}, 'valuerare') pieces,
             list_distinct([t for t in {_tokens_sql(gold)} if {_ISLIT}]) vals_any,
             [t for t in {_tokens_sql(gold)} if {_ISLIT}] vals_all from texts),
    b as (select query_id, own, pieces, len(pieces) - 1 slots,
          [vals_all[i] for i in range(1, len(vals_all) + 1) if list_position(vals_all, vals_all[i]) = i] vals from base),
    n as (select *, (len(vals) ** slots)::bigint alts from b),
    ix as (select *, unnest(range(0, alts)) ix from n),
    filled as (select query_id, ix + 1 cand_idx, alts n_alternatives,
               array_to_string([case when j = 1 then pieces[j] else
                   vals[((ix // (len(vals) ** (j - 2))::bigint) % len(vals)) + 1] || pieces[j] end
                   for j in range(1, len(pieces) + 1)], '') sql from ix),
    cand as (select query_id, 0::bigint cand_idx, own sql, alts n_alternatives from n
             union all select query_id, cand_idx, sql, n_alternatives from filled)"""


_G = _NODISTINCT.format(_ops_sql("other"))
_P = _NODISTINCT.format(_ops_sql("replace(sql, 'value', '1')"))

QUERIES = {
    "normalise_sql": (
        normalise_sql,
        f"""with {TEXTS_SQL}, u as (select 'event' kind, event_id id, sql from texts union all
        select 'document', doc_id, text from documents),
        n as (select kind, id, {_norm_sql('sql')} t from u)
        select kind, id, case when ends_with(t, ';') then t else t || ';' end sql from n""",
    ),
    "clean_sql": (
        clean_sql,
        f"""with {TEXTS_SQL} select event_id, {_ops_sql('sql')} joined,
        regexp_replace(sql, '{_YEAR}', '2020', 'g') fixed_year, {_NODISTINCT.format('sql')} no_distinct,
        replace(sql, 'value', '1') filled, array_to_string({_tokens_sql('sql')}, ' ') reformatted from texts""",
    ),
    "tokenise": (
        tokenise,
        f"""with {TEXTS_SQL}, b as (select *, len(regexp_extract_all(sql, '[''"]')) % 2 = 0 balanced from texts)
        select event_id, balanced, case when balanced then
        array_to_string(regexp_extract_all({_ops_sql('sql')}, '{_TOKEN}', 1), '¦') end tokens from b""",
    ),
    "strip_literals": (
        strip_literals,
        f"""with {TEXTS_SQL} select {_slots_sql('sql')} fingerprint,
        len([t for t in {_tokens_sql('sql')} if {_ISLIT}])::int n_literals, count(*) n_queries from texts group by 1, 2""",
    ),
    "slot_fillings": (
        slot_fillings,
        f"with {TEXTS_SQL}, {_fillings_sql('sql', 'other')} select * from cand",
    ),
    "first_candidates": (
        first_candidates,
        f"""with raw_{TEXTS_SQL}, texts as (select event_id, {_G} g, {_P} p from raw_texts),
        {_fillings_sql('g', 'p')}
        select query_id, cand_idx, n_alternatives, regexp_replace(sql, '{_YEAR}', '2020', 'g') sql,
        regexp_replace(g, '{_YEAR}', '2020', 'g') sql_gt from cand join texts on event_id = query_id""",
    ),
    "extract_block": (
        extract_block,
        f"""with c as (select conv_id, turn, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)
        || '<|im_start|>assistant again' || chr(9) || text || ' <|endoftext|>' chat,
        case when turn % 3 = 0 then text else 'Answer:' || chr(10) || '```sql' || chr(10) || '  ' || text || chr(10)
        || '```' || chr(10) || 'rest ```sql x```' end answer from conversations),
        t as (select *, regexp_extract_all(chat, '{_TURN}', 1) turns from c)
        select conv_id, turn, regexp_replace({_strip_sql(f"regexp_extract(answer, '{_BLOCK}', 1)")}, '{_SP}+', ' ', 'g') sql_block,
        coalesce({_strip_sql('turns[1]')}, '') first_turn,
        coalesce({_strip_sql('coalesce(turns[2], turns[1])')}, '') last_turn from t""",
    ),
    "difficulty": (
        difficulty,
        f"""select event_id, {_choose_sql([s[2][0] for s in SHAPES])} component1,
        {_choose_sql([s[2][1] for s in SHAPES])} component2, {_choose_sql([s[2][2] for s in SHAPES])} others,
        {_choose_sql([s[1] for s in SHAPES])} level from events""",
    ),
    "keyword_sets": (
        keyword_sets,
        f"select event_id, {_choose_sql(SHAPE_KEYWORDS)} keywords from events",
    ),
    "nested_queries": (
        nested_queries,
        f"""select event_id, {_choose_sql([s[0] for s in SHAPE_NESTING])} subqueries,
        {_choose_sql([s[1] for s in SHAPE_NESTING])} set_ops from events""",
    ),
    "typed_values": (typed_values, _typed_sql()),
    "unquote": (
        unquote,
        "select doc_id, replace(replace(text, '``', '`'), '\"\"', '\"') \"text\" from documents",
    ),
}
