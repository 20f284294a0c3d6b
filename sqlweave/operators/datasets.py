"""Training sets: augmented schemas, prompts, chats, masks and length limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.functions.text import normalise_sql, strip_space
from sqlweave.operators.ranking import gather_text, integer_bucket, position, ring_sample

# Longest texts that still go into a prompt.
MAX_VALUE, MAX_DESCRIPTION, MAX_COMMENT = 30, 60, 30
# Chat markup and the label of masked tokens.
TURN_START, TURN_END, MASKED = "<|im_start|>", "<|im_end|>", -100
_NUMERIC_TYPES = r"(?i)^(?:int|integer|real|float|double|numeric|decimal|number|bigint)"


def augment_schemas(
    needed: DataFrame, columns: DataFrame, top_k: int, times: int, seed: str = "augment"
) -> DataFrame:
    """Needed columns of every question plus seeded distractors up to `top_k`, in `times` variants.

    `needed(question_id, db_id, doc_id)`, `columns(db_id, doc_id)`. Distractors are
    picked on the database's ring, with room for the needed ones that are struck out,
    so a question costs at most about `top_k` rows per variant whatever its database
    holds. With `top_k` of 0 or less only the needed columns are kept.
    """
    variants = F.explode(F.sequence(F.lit(1), F.lit(times)))
    kept = needed.select("question_id", "db_id", "doc_id", variants.alias("variant"), F.lit(True).alias("is_needed"))
    if top_k <= 0:
        return kept
    counts = needed.groupBy("question_id", "db_id").agg(F.count(F.lit(1)).alias("n_needed"))
    asked = counts.withColumn("variant", variants)
    wanted = F.when(F.col("n_needed") < top_k, F.lit(top_k)).otherwise(0)
    picked = ring_sample(
        asked, columns, "db_id", ["question_id", "variant"], ["doc_id"], wanted, seed,
        struck=needed, keep=F.lit(top_k) - F.col("n_needed"),
    )
    distractors = picked.select("question_id", "db_id", "doc_id", "variant", F.lit(False).alias("is_needed"))
    return kept.union(distractors)


def merge_wildcards(selection: DataFrame, keys: list[str]) -> DataFrame:
    """Collapse every table selected as '*' to that one entry.

    `selection(*keys, table_name, column_name)`. All such tables are kept.
    """
    star = F.col("column_name") == "*"
    starred = selection.filter(star).select(*keys, "table_name").distinct()
    plain = selection.filter(~star).join(starred, [*keys, "table_name"], "left_anti")
    return plain.unionByName(selection.filter(star).dropDuplicates([*keys, "table_name"]))


def deduplicate_rows(rows: DataFrame) -> DataFrame:
    """Whole rows once each; copies combine before the shuffle."""
    return rows.distinct()


def canonical_json(columns: list[str]) -> Column:
    """Row as JSON with sorted keys, for de-duplicating rows of nested columns."""
    return F.to_json(F.struct(*sorted(columns)))


def json_text(text: Column) -> Column:
    """JSON string literal with every non-ASCII character escaped."""
    plain = F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high = F.lit(0xD800) + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00) + (code - 0x10000).bitwiseAND(F.lit(0x3FF))
        return F.when(code < 128, c).when(code < 0x10000, unit(code)).otherwise(F.concat(unit(high), unit(low)))

    spelled = F.array_join(F.transform(F.split(plain, ""), escaped), "")
    return F.when(plain.rlike(r"[^\x00-\x7f]"), spelled).otherwise(plain)


def column_line(c: Column) -> Column:
    """Prompt line of one column: 'table.column = {json}', or 'table.*'.

    `c` has table_name, column_name, type, primary_key, sample_values, description,
    comment and is_wildcard. Long texts are left out of the line.
    """
    numeric = c["type"].rlike(_NUMERIC_TYPES)
    number = r"^-?\d+(?:\.\d+)?$"
    fit = F.filter(
        F.coalesce(c["sample_values"], F.array().cast("array<string>")),
        lambda v: (numeric & v.rlike(number)) | (F.length(v) < MAX_VALUE),
    )
    values = F.transform(fit, lambda v: F.when(numeric & v.rlike(number), v).otherwise(json_text(v)))

    def short(text: Column, limit: int) -> Column:
        return (F.coalesce(text, F.lit("")) != "") & (F.length(text) < limit)

    parts = F.array(
        F.concat(F.lit('"type": '), json_text(F.upper(c["type"]))),
        F.concat(F.lit('"primary_key": '), F.coalesce(c["primary_key"], F.lit(False)).cast("string")),
        F.when(F.size(values) > 0, F.concat(F.lit('"values": ['), F.array_join(values, ", "), F.lit("]"))),
        F.when(
            short(c["description"], MAX_DESCRIPTION),
            F.concat(F.lit('"description": '), json_text(strip_space(c["description"]))),
        ),
        F.when(short(c["comment"], MAX_COMMENT), F.concat(F.lit('"comment": '), json_text(strip_space(c["comment"])))),
    )
    body = F.concat(F.lit("{"), F.array_join(F.array_compact(parts), ", "), F.lit("}"))
    star = F.concat(c["table_name"], F.lit(".*"))
    return F.when(c["is_wildcard"], star).otherwise(
        F.concat(c["table_name"], F.lit("."), c["column_name"], F.lit(" = "), body)
    )


SCHEMA_HEAD = "\n### Database\n-- Tables and Columns"


def schema_texts(selection: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Schema lines of every group, joined in `pos` order into one text."""
    columns = F.struct(*[c for c in selection.columns if c not in keys])
    lines = selection.withColumn("schema_text", column_line(columns)).select(*keys, pos, "schema_text")
    return gather_text(lines, keys, pos, "schema_text")


def prompt_text(question: Column, schema_text: Column, foreign_keys: Column, evidence: Column) -> Column:
    """Question, schema, references joined by ' | ', evidence. Empty parts are left out."""

    def unless_empty(head: str, text: Column) -> Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(F.lit(head), text))

    head = F.concat(F.lit("### Question\n"), strip_space(question))
    schema = F.when(schema_text.isNull() | (schema_text == ""), F.lit(SCHEMA_HEAD)).otherwise(
        F.concat(F.lit(SCHEMA_HEAD + "\n"), schema_text)
    )
    given = F.when(
        F.coalesce(evidence, F.lit("")) != "", F.concat(F.lit("\n-- Evidence\n"), strip_space(evidence))
    )
    return F.concat_ws("\n", head, schema, unless_empty("\n-- Foreign Keys\n", foreign_keys), given)


def chat_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(TURN_START), role, F.lit("\n"), text, F.lit(TURN_END + "\n"))


def drop_system_turn(chat: Column) -> Column:
    return F.regexp_replace(chat, r"(?s)<\|im_start\|>system.*?<\|im_end\|>\n?", "")


def chat_prompt(prompt: Column, previous_sql: Column, error_msg: Column) -> Column:
    """User turn, after an error also the failed answer and the message, then an open answer."""
    user = chat_turn(F.lit("user"), prompt)
    retry = F.concat(
        chat_turn(F.lit("assistant"), F.coalesce(previous_sql, F.lit(""))),
        chat_turn(F.lit("user"), F.concat(F.lit("### Error Message\n"), error_msg)),
    )
    return F.concat(user, F.coalesce(retry, F.lit("")), F.lit(TURN_START + "assistant\n"))


def model_input(chat: Column, sql_gt: Column, phase: str) -> Column:
    """Input text by phase: 'prompt' as is, 'fence' with an opened SQL block, 'answer' with the gold."""
    clean = strip_space(drop_system_turn(chat))
    if phase == "fence":
        return F.concat(clean, F.lit("\n```sql\n"))
    if phase == "answer":
        return F.concat(clean, F.lit("\n"), strip_space(sql_gt), F.lit(TURN_END))
    if phase == "prompt":
        return clean
    raise ValueError(f"unknown phase {phase!r}")


def preference_row(chat: Column, sql_gt: Column, sql_pred: Column) -> list[Column]:
    """prompt / chosen / rejected, answers closed by the turn mark."""
    return [
        drop_system_turn(chat).alias("prompt"),
        F.concat(sql_gt, F.lit(TURN_END)).alias("chosen"),
        F.concat(sql_pred, F.lit(TURN_END)).alias("rejected"),
    ]


def mask_prompt(ids: Column, prompt_length: Column) -> Column:
    """Label ids with the first `prompt_length` masked."""
    return F.transform(ids, lambda x, i: F.when(i < prompt_length, F.lit(MASKED)).otherwise(x))


def keep_last(ids: Column, n: int) -> Column:
    """Last n ids, as prompts are cut."""
    return F.when(F.size(ids) > n, F.slice(ids, -n, n)).otherwise(ids)


def keep_first(ids: Column, n: int) -> Column:
    """First n ids, as completions are cut."""
    return F.slice(ids, 1, n)


def short_enough(rows: DataFrame, ids: str, limit: int) -> DataFrame:
    return rows.filter(F.size(ids) <= limit)


def short_prompts(rows: DataFrame, prompt: str, limit: int) -> DataFrame:
    """Preference rows are limited in characters, not tokens."""
    return rows.filter(F.length(prompt) <= limit)


def evaluation_rows(questions: DataFrame, running_id: bool = False) -> DataFrame:
    """Trimmed question and evidence, normalised SQL; optionally ids renumbered from 0."""
    rows = questions.withColumns(
        {
            "question": strip_space(F.col("question")),
            "evidence": strip_space(F.coalesce("evidence", F.lit(""))),
            "sql_gt": normalise_sql(strip_space(F.col("sql"))),
        }
    ).drop("sql")
    if not running_id:
        return rows
    bucket = integer_bucket(F.col("question_id"))
    placed = position(rows.withColumn("__all", F.lit(0)), ["__all"], [F.col("question_id")], bucket, "__id")
    return placed.withColumn("question_id", F.col("__id") - 1).drop("__all", "__id")


def attempt_rows(dataset: DataFrame, predictions: DataFrame, optional: tuple[str, ...] = ("evidence", "difficulty")) -> DataFrame:
    """Dataset columns joined with `predictions(question_id, sql_pred array, ...)`; the optional
    columns come along where the dataset has them."""
    base = ["question_id", "db_id", "question", "sql_gt"]
    present = [c for c in optional if c in dataset.columns]
    return dataset.select(*base, *present).join(predictions, "question_id")
