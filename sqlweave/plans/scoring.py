"""Scores over conversations, documents and query texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sqlweave.functions import text as T
from sqlweave.functions.arrays import unnest
from sqlweave.operators import scoring as S
from sqlweave.plans import sqltext
from sqlweave.plans.bindings import keyed_events
from sqlweave.session import load


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation is a session; whether a turn is right depends on the length of its text."""
    size = F.length("text")
    level = F.when(size < 100, "easy").when(size < 200, "medium").when(size < 400, "hard").otherwise("extra")
    return load(spark, sf, "conversations").select(
        F.col("conv_id").alias("session_id"),
        (F.col("turn") + 1).alias("turn"),
        level.alias("level"),
        F.when(size % 4 != 0, 1).otherwise(0).alias("exec"),
        F.when(size % 3 != 0, 1).otherwise(0).alias("exact"),
    )


_TURNS_SQL = """t as (select conv_id session_id, turn + 1 turn, case when length(text) < 100 then 'easy' when length(text) < 200
then 'medium' when length(text) < 400 then 'hard' else 'extra' end "level", (length(text) % 4 <> 0)::int ex,
(length(text) % 3 <> 0)::int em from conversations)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if c in columns else c for c in df.columns])


def execution_accuracy(spark, sf):
    attempts = load(spark, sf, "events").select(F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("res"))
    return _rounded(S.execution_accuracy(attempts), "accuracy")


def accuracy_by_level(spark, sf):
    return _rounded(S.accuracy_by_level(_turns(spark, sf)), "exec", "exact")


def turn_accuracy(spark, sf):
    return _rounded(S.accuracy_by_turn(_turns(spark, sf)), "exec", "exact")


def joint_accuracy(spark, sf):
    return _rounded(S.joint_accuracy(_turns(spark, sf)), "joint_exec", "joint_exact")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """Words of user turns are gold units, those of other turns predicted ones."""
    words = load(spark, sf, "conversations").select(
        F.col("conv_id").alias("query_id"),
        F.lit(0).alias("block_id"),
        F.when(F.col("role") == "user", "gold").otherwise("pred").alias("side"),
        F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]+)"), 1).alias("words"),
    )
    words = unnest(words, F.col("words"), "unit", "query_id", "block_id", "side")
    component = F.when(F.length("unit") <= 2, "select").when(F.length("unit") <= 4, "where").otherwise("keywords")
    return words.withColumn("component", component)


_UNITS_SQL = """u as (select conv_id query_id, 0 block_id, "role" = 'user' g, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) unit
from conversations),
k as (select query_id, block_id, case when length(unit) <= 2 then 'select' when length(unit) <= 4 then 'where' else 'keywords' end component,
unit, sum(g::int)::bigint g, sum((not g)::int)::bigint p from u group by all),
o as (select query_id, block_id, component, sum(g)::bigint label_total, sum(p)::bigint pred_total, sum(least(g, p))::bigint cnt from k group by all)"""


def component_match(spark, sf):
    return S.bag_overlap(_units(spark, sf))


def _levelled(spark: SparkSession, sf: str) -> DataFrame:
    """Components scored on distinct words only where both sides agree, with a level per conversation."""
    overlap = S.bag_overlap(_units(spark, sf))
    kind = F.col("query_id") % 4
    label = F.when(kind == 0, F.col("cnt")).otherwise(F.col("label_total"))
    predicted = F.when(kind == 0, F.col("cnt")).when(kind == 1, F.lit(0)).otherwise(F.col("pred_total"))
    level = F.when(F.col("query_id") % 3 == 0, "easy").otherwise("hard")
    return overlap.select(
        "query_id", "component", level.alias("level"), label.alias("label_total"), predicted.alias("pred_total"), "cnt"
    )


_LEVELLED_SQL = """v as (select query_id, component, case when query_id % 3 = 0 then 'easy' else 'hard' end "level",
case when query_id % 4 = 0 then cnt else label_total end l, case when query_id % 4 = 0 then cnt when query_id % 4 = 1 then 0
else pred_total end p, cnt from o),
s as (select *, (p = l and cnt = p)::int score from v)"""


def macro_scores(spark, sf):
    return _rounded(S.macro_scores(_levelled(spark, sf)), "acc", "rec", "f1")


def component_exact(spark, sf):
    components = _levelled(spark, sf)
    tables = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("query_id")).agg(
        F.collect_set(F.when(F.col("role") == "user", F.col("turn") % 2)).alias("gold_tables"),
        F.collect_set(F.when(F.col("role") != "system", F.col("turn") % 2)).alias("pred_tables"),
    )
    return S.exact_match(components, tables)


def report_pivot(spark, sf):
    """Labelled documents by language, quality and toxicity shares as rows of a grid."""
    graded = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    long = graded.select("lang", F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("metric", "x"))
    means = long.groupBy("lang", "metric").agg(F.round(F.avg("x"), 6).alias("score"))
    return S.report_grid(means, "metric", "lang", "score")


def _text_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Predictions by event: the gold text, a changed literal, a DISTINCT too many, or another shape."""
    kind = (F.col("event_id") / 8).cast("long") % 4
    changed = F.regexp_replace("sql", r"\b\d+(\.\d+)?$|\b\d+(\.\d+)? ", "7 ")
    doubled = F.regexp_replace("sql", r"^SELECT (DISTINCT )?", "SELECT  DISTINCT ")
    return sqltext.texts(spark, sf).select(
        F.col("event_id").alias("query_id"),
        F.col("sql").alias("sql_gt"),
        F.when(kind == 0, F.col("sql")).when(kind == 1, changed).when(kind == 2, doubled).otherwise(F.col("other")).alias("sql_pred"),
    )


def exact_match(spark, sf):
    compared = S.compare_texts(_text_pairs(spark, sf))
    return S.exact_match_texts(compared).select("query_id", "exact")


# Event types by turns: the second table of a text that reads two.
_TYPES = ("click", "error", "purchase", "signup", "view")


def exact_match_names(spark, sf):
    """Texts over each user's tables whose predictions leave out prefixes, reuse aliases or turn the tables round.

    By event: two tables in gold order; two tables turned round, where the bare name may belong to the
    other one; a sub-query under a reused alias; the same with both tables swapped. Columns of even
    keys are references of one group.
    """
    types = F.array(*[F.lit(t) for t in _TYPES])
    events = keyed_events(spark, sf).withColumn("t", F.col("event_type"))
    events = events.withColumn("o", F.element_at(types, (F.array_position(types, F.col("t")) % len(_TYPES) + 1).cast("int")))
    t, o, c = F.col("t"), F.col("o"), F.concat(F.lit("k"), "k")
    kind = F.col("event_id") % 4

    def say(text: str) -> Column:
        return F.concat(*[{"T": t, "O": o, "C": c}.get(part, F.lit(part)) for part in text.split("|")])

    joined = say("SELECT |T|.|C| FROM |T| JOIN |O| WHERE |T|.|C| > 1")
    nested = say("SELECT T1.|C| FROM |T| AS T1 WHERE T1.|C| IN (SELECT T1.|C| FROM |O| AS T1)")
    predicted = (
        F.when(kind == 0, say("SELECT |C| FROM |T| JOIN |O| WHERE |C| > 5"))
        .when(kind == 1, say("SELECT |C| FROM |O| AS a JOIN |T| AS b WHERE |C| > 5"))
        .when(kind == 2, say("SELECT |C| FROM |T| WHERE |C| IN (SELECT |C| FROM |O|)"))
        .otherwise(say("SELECT |C| FROM |O| WHERE |C| IN (SELECT |C| FROM |T|)"))
    )
    pairs = events.select(
        F.col("event_id").alias("query_id"), F.concat(F.lit("db_"), "user_id").alias("db_id"),
        F.when(kind < 2, joined).otherwise(nested).alias("sql_gt"), predicted.alias("sql_pred"),
    )
    seen = events.select(F.concat(F.lit("db_"), "user_id").alias("db_id"), "event_type", "k").distinct()
    columns = seen.select("db_id", F.initcap("event_type").alias("table_name"), F.concat(F.lit("K"), "k").alias("column_name"))
    first = seen.filter("k % 2 = 0").withColumn("first", F.min("event_type").over(Window.partitionBy("db_id", "k")))
    representatives = first.select(
        "db_id", F.concat(F.col("event_type"), F.lit(".k"), "k").alias("unit"), F.concat(F.col("first"), F.lit(".k"), "k").alias("representative")
    )
    return S.exact_match_texts(S.compare_texts(pairs, columns, representatives)).select("query_id", "exact")


# Units of the query shapes in `plans.sqltext`, by component.
SHAPE_UNITS = {
    "select": [1, 2, 2, 1, 1, 1, 2, 1],
    "select(no AGG)": [1, 2, 2, 1, 1, 1, 2, 1],
    "where": [1, 0, 2, 1, 1, 2, 1, 2],
    "where(no OP)": [1, 0, 2, 1, 1, 2, 1, 2],
    "group(no Having)": [0, 1, 0, 0, 0, 0, 1, 0],
    "group": [0, 1, 0, 0, 0, 0, 1, 0],
    "order": [0, 0, 0, 0, 1, 0, 1, 0],
    "and/or": [1, 1, 1, 1, 1, 1, 1, 1],
    "IUEN": [0, 0, 0, 0, 0, 1, 0, 0],
    "keywords": [1, 1, 2, 2, 4, 3, 5, 1],
}


def text_components(spark, sf):
    """Component counts of every gold text against itself with its literals changed."""
    pairs = sqltext.texts(spark, sf).select(
        F.col("event_id").alias("query_id"), F.col("sql").alias("sql_gt"), F.replace("sql", F.lit("1"), F.lit("2")).alias("sql_pred")
    )
    pairs = pairs.withColumn("sql_pred", F.replace("sql_pred", F.lit("T2"), F.lit("T1"))).withColumn(
        "sql_gt", F.replace("sql_gt", F.lit("T2"), F.lit("T1"))
    )
    compared = S.compare_texts(pairs)
    return unnest(compared, F.col("components"), "c", "query_id").select("query_id", "c.*")


def _text_components_sql() -> str:
    parts = [
        f"select event_id query_id, {_quote(name)} component, {sqltext._choose_sql(units)} n from events"
        for name, units in SHAPE_UNITS.items()
    ]
    return f"select query_id, component, n label_total, n pred_total, n cnt from ({' union all '.join(parts)})"


def _quote(text: str) -> str:
    return "'" + text + "'"


def keyword_overlap(spark, sf):
    both = T.with_clauses(T.with_clauses(sqltext.texts(spark, sf), "sql", "gold"), "other", "pred")
    sets = both.select("event_id", T.keyword_set(F.col("gold")).alias("g"), T.keyword_set(F.col("pred")).alias("p"))
    return sets.select(
        F.col("event_id").alias("query_id"),
        F.size("g").alias("label_total"),
        F.size("p").alias("pred_total"),
        F.size(F.array_intersect("g", "p")).alias("cnt"),
    )


def equivalent_columns(spark, sf):
    """Columns named by events, with the later of two linked types mapped to the earlier."""
    events = keyed_events(spark, sf)
    units = events.select(
        "event_id", F.concat(F.lit("db_"), "user_id").alias("db_id"), F.concat_ws(".", "event_type", "k").alias("unit")
    )
    seen = events.select("user_id", "event_type", "k").distinct()
    first = seen.groupBy("user_id", "k").agg(F.min("event_type").alias("first"))
    representatives = seen.join(first, ["user_id", "k"]).select(
        F.concat(F.lit("db_"), "user_id").alias("db_id"),
        F.concat_ws(".", "event_type", "k").alias("unit"),
        F.concat_ws(".", "first", "k").alias("representative"),
    )
    return S.map_equivalent_columns(units, representatives)


_KEYS = ", ".join(f"{i}: string_split('{w}', ' ')" for i, w in enumerate(sqltext.SHAPE_KEYWORDS))

QUERIES = {
    "execution_accuracy": (
        execution_accuracy,
        "select count(*) n, round(avg((event_type in ('purchase', 'signup'))::int), 6) accuracy from events",
    ),
    "accuracy_by_level": (
        accuracy_by_level,
        f"""with {_TURNS_SQL} select case when grouping("level") = 1 then 'all' else "level" end "level", count(*) n,
        round(avg(ex), 6) "exec", round(avg(em), 6) exact from t group by rollup("level")""",
    ),
    "turn_accuracy": (
        turn_accuracy,
        f"""with {_TURNS_SQL} select case when turn > 4 then 'turn > 4' else 'turn ' || turn end turn, count(*) n,
        round(avg(ex), 6) "exec", round(avg(em), 6) exact from t group by 1""",
    ),
    "joint_accuracy": (
        joint_accuracy,
        f"""with {_TURNS_SQL}, s as (select session_id, min(ex) ex, min(em) em from t group by 1)
        select count(*) n_sessions, round(avg(ex), 6) joint_exec, round(avg(em), 6) joint_exact from s""",
    ),
    "component_match": (component_match, f"with {_UNITS_SQL} select * from o"),
    "macro_scores": (
        macro_scores,
        f"""with {_UNITS_SQL}, {_LEVELLED_SQL},
        m as (select component, case when grouping("level") = 1 then 'all' else "level" end "level",
              coalesce(avg(score) filter (p > 0), 0) acc, coalesce(avg(score) filter (l > 0), 0) rec from s
              group by grouping sets ((component, "level"), (component)))
        select component, "level", round(acc, 6) acc, round(rec, 6) rec,
        round(case when acc = 0 and rec = 0 then 1.0 when acc + rec = 0 then 0.0 else 2.0 * acc * rec / (acc + rec) end, 6) f1 from m""",
    ),
    "component_exact": (
        component_exact,
        f"""with {_UNITS_SQL}, {_LEVELLED_SQL}, x as (select query_id, min(score) exact from s group by 1),
        t as (select conv_id, list_sort(list_distinct(coalesce(list(turn % 2) filter ("role" = 'user'), []))) g,
              list_sort(list_distinct(coalesce(list(turn % 2) filter ("role" <> 'system'), []))) p from conversations group by 1)
        select query_id, case when g = p or len(g) = 0 then exact else 0 end exact from x join t on conv_id = query_id""",
    ),
    "report_pivot": (
        report_pivot,
        """with j as (select lang, quality, toxic from labels join documents using (doc_id)),
        l as (select lang, 'quality' metric, quality x from j union all select lang, 'toxic', toxic from j)
        select metric, round(avg(x) filter (lang = 'de'), 6) de, round(avg(x) filter (lang = 'en'), 6) en,
        round(avg(x) filter (lang = 'es'), 6) es, round(avg(x) filter (lang = 'fr'), 6) fr from l group by 1""",
    ),
    "exact_match": (exact_match, "select event_id query_id, ((event_id // 8) % 4 < 3)::int exact from events"),
    "exact_match_names": (
        exact_match_names,
        """with e as (select event_id, user_id, event_type t, json_extract_string(props, '$.k')::int k from events),
        n as (select *, case t when 'click' then 'error' when 'error' then 'purchase' when 'purchase' then 'signup'
              when 'signup' then 'view' else 'click' end o from e),
        seen as (select distinct user_id, t, k from e)
        select event_id query_id, case event_id % 4 when 0 then 1 when 2 then 1 when 3 then 0
        else (s.t is null or n.k % 2 = 0)::int end exact
        from n left join seen s on s.user_id = n.user_id and s.t = n.o and s.k = n.k""",
    ),
    "text_components": (text_components, _text_components_sql()),
    "keyword_overlap": (
        keyword_overlap,
        f"""with m as (select map {{{_KEYS}}} m), k as (select event_id, m[(event_id % 8)::int] g, m[((event_id + 1) % 8)::int] p from events, m)
        select event_id query_id, len(g)::int label_total, len(p)::int pred_total, len(list_intersect(g, p))::int cnt from k""",
    ),
    "equivalent_columns": (
        equivalent_columns,
        """with e as (select event_id, user_id, event_type, json_extract_string(props, '$.k')::int k from events)
        select event_id, 'db_' || user_id db_id, min(event_type) over (partition by user_id, k) || '.' || k unit from e""",
    ),
}
