"""Columns of SQL text: cleaning, extraction, literals and shape features.

Everything works on whole texts with regular expressions and array functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Every character counted as white space.
SPACE = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# A string literal in either quote; anything tested in front of it must come later in an alternation.
# A doubled quote inside belongs to the literal.
LITERAL = r"""'(?:[^']|'')*'|"(?:[^"]|"")*\""""
QUOTED_NAME = r"`[^`]*`|\[[A-Za-z_][^\]]*\]"
DOTTED_NAME = rf"\w+(?:\.(?:\w+|{QUOTED_NAME}|\*))*"
NUMBER = r"\d+(?:\.\d+)?|\.\d+"

# The slot put in place of a literal.
SLOT = "valuerare"

# Year that stands for the current one.
FIXED_YEAR = "2020"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}+|{SPACE}+$", "")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, f"{SPACE}+", " ")


def normalise_sql(sql: Column) -> Column:
    """One space between words, single quotes, no space inside parentheses, ';' at the end.

    Literals are not spared: white space and parentheses inside them change as well.
    """
    out = F.trim(collapse_space(sql))
    out = F.regexp_replace(out, '"([^"]*)"', "'$1'")
    out = F.regexp_replace(out, rf"\({SPACE}*", "(")
    out = F.regexp_replace(out, rf"{SPACE}*\)", ")")
    return F.when(out.endswith(";"), out).otherwise(F.concat(out, F.lit(";")))


def join_operators(sql: Column) -> Column:
    """Repair comparison operators that were split by a space."""
    out = sql
    for sign in ("<", ">", "!"):
        out = F.replace(out, F.lit(f"{sign} ="), F.lit(f"{sign}="))
    return out


def fix_current_year(sql: Column) -> Column:
    call = rf"(?i)YEAR{SPACE}*\({SPACE}*CURDATE{SPACE}*\({SPACE}*\){SPACE}*\){SPACE}*"
    return F.regexp_replace(sql, call, FIXED_YEAR)


def remove_distinct(sql: Column) -> Column:
    """Drop the keyword DISTINCT; literals keep the word."""
    return F.regexp_replace(sql, rf"({LITERAL})|\b(?i:distinct)\b", "$1")


def first_sql_block(text: Column) -> Column:
    """First fenced SQL block of a generated text on one line, '' if there is none."""
    block = rf"(?s)```sql{SPACE}*(.*?)(?:{SPACE}*```|<\|im_end\|>|<ANSWER>|<\|endoftext\|>)"
    return collapse_space(strip_space(F.regexp_extract(text, block, 1)))


def assistant_turn(text: Column, revised: bool) -> Column:
    """First assistant turn of a chat text; the second where there is one and `revised`."""
    turns = F.regexp_extract_all(
        text, F.lit(r"(?s)<\|im_start\|>assistant(.*?)<\|(?:im_end|endoftext)\|>"), 1
    )
    first = F.try_element_at(turns, F.lit(1))
    chosen = F.coalesce(F.try_element_at(turns, F.lit(2)), first) if revised else first
    return F.coalesce(strip_space(chosen), F.lit(""))


def fill_placeholder(sql: Column) -> Column:
    """Put 1 for the placeholder word; names that contain it change too."""
    return F.replace(sql, F.lit("value"), F.lit("1"))


def tokens(sql: Column) -> Column:
    """Tokens; literals, quoted and dotted names, `alias.*` and two-character operators are whole."""
    pattern = rf"({LITERAL}|{QUOTED_NAME}|[!<>=]=|<>|\|\||{DOTTED_NAME}|\.\d+|[^\s\w])"
    return F.regexp_extract_all(join_operators(sql), F.lit(pattern), 1)


def quotes_balanced(sql: Column) -> Column:
    """Texts with an odd number of quotes have no tokens."""
    return F.regexp_count(sql, F.lit("['\"]")) % 2 == 0


def reformat_tokens(sql: Column) -> Column:
    """Tokens without ';' and tabs, 't1.*' to 't3.*' as '*'."""
    plain = F.regexp_replace(F.trim(sql), "[;\t]", "")
    return tokens(F.regexp_replace(plain, r"\b[tT][123]\.\*", "*"))


def reformat(sql: Column) -> Column:
    """The query's tokens joined by single spaces."""
    return F.array_join(reformat_tokens(sql), " ")


def _is_literal(token: Column) -> Column:
    return token.rlike(rf"^(?:{LITERAL}|{NUMBER})$")


def literals(words: Column) -> Column:
    """Literals among the reformatted tokens of a query, in order of appearance."""
    return F.filter(words, _is_literal)


def slot_text(words: Column) -> Column:
    """Lower-cased reformatted query with a slot for every literal: its fingerprint."""
    slotted = F.transform(words, lambda t: F.when(_is_literal(t), SLOT).otherwise(F.lower(t)))
    return F.array_join(slotted, " ")


def unquote(literal: Column) -> Column:
    """Strip one quote on each side and un-double the rest."""
    out = F.regexp_replace(literal, "^[`'\"]|[`'\"]$", "")
    for quote in ("`", "'", '"'):
        out = F.replace(out, F.lit(quote * 2), F.lit(quote))
    return out


def blank_literals(sql: Column) -> Column:
    """Lower-cased text on one line with '' for every string literal: safe to search for keywords."""
    return F.lower(collapse_space(F.regexp_replace(sql, LITERAL, "''")))


_SUBQUERY = r"\( ?(?:select|with)\b[^()]*\)"
_PARENS = r"\(([^()]*)\)"


def outer_block(sql: Column, digests: bool = False) -> Column:
    """The outermost query block: nested selects become '{q}', other parentheses are opened.

    Innermost parentheses are folded first, as many times as the text has parentheses. With
    `digests` each nested select keeps a digest of its own folded text, as '{q…}'.
    """

    def named(text: Column) -> Column:
        # One nested select a round; equal ones share their digest.
        swap = lambda sub: F.when(sub == "", text).otherwise(F.replace(text, sub, F.concat(F.lit(" {q"), F.md5(sub), F.lit("} "))))
        return F.get(F.transform(F.array(F.regexp_extract(text, _SUBQUERY, 0)), swap), F.lit(0))

    def fold(text: Column, _: Column) -> Column:
        inner = named(text) if digests else F.regexp_replace(text, _SUBQUERY, " {q} ")
        return F.regexp_replace(inner, r"\((?! ?(?:select|with)\b)([^()]*)\)", "⟦$1⟧")

    def folded(blank: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.regexp_count(blank, F.lit(r"\("))), blank, fold)

    # Blanked once for both of its uses.
    return F.get(F.transform(F.array(blank_literals(sql)), folded), F.lit(0))


def first_block(outer: Column) -> Column:
    """What stands before the first set operation."""
    return F.split(outer, r" (?:union(?: all)?|intersect|except) ").getItem(0)


def clause(block: Column, start: str, stops: tuple[str, ...]) -> Column:
    """Text between a clause keyword and the next one, '' if the clause is missing."""
    ends = "|".join(rf"\b{s}\b" for s in stops)
    found = F.regexp_extract(block, rf"\b{start}\b (.*?)(?:(?:{ends})|;|$)" if ends else rf"\b{start}\b (.*?)(?:;|$)", 1)
    return F.trim(found)


_AFTER = {
    "from": ("where", "group by", "having", "order by", "limit"),
    "where": ("group by", "having", "order by", "limit"),
    "group by": ("having", "order by", "limit"),
    "having": ("order by", "limit"),
    "order by": ("limit",),
    "limit": (),
}


def clauses(block: Column, outer: Column) -> Column:
    """Struct of the block's clause texts: select, from, where, group_by, having, order_by,
    limit, and `set_op` (the text's set operation, or '')."""
    parts = [F.trim(F.regexp_extract(block, r"^ ?select (.*?) from\b", 1)).alias("select")]
    parts += [clause(block, k, stops).alias(k.replace(" ", "_")) for k, stops in _AFTER.items()]
    parts.append(F.regexp_extract(outer, r" (union|intersect|except) ", 1).alias("set_op"))
    return F.struct(*parts)


def with_clauses(df: DataFrame, sql: str, out: str = "clauses") -> DataFrame:
    """Add the clause struct of a query column. Each stage is its own column, so the
    folding of parentheses runs once per text."""
    folded = df.withColumn("__outer", outer_block(F.col(sql))).withColumn("__block", first_block(F.col("__outer")))
    return folded.withColumn(out, clauses(F.col("__block"), F.col("__outer"))).drop("__outer", "__block")


def split_list(text: Column) -> Column:
    """Items of a comma list; commas inside opened parentheses do not split."""
    items = F.split(text, r",(?![^⟦⟧]*⟧)")
    return F.filter(F.transform(items, F.trim), lambda x: x != "")


def split_conditions(text: Column) -> Column:
    """Conditions of an AND/OR list; the AND of a BETWEEN stays inside its condition."""
    guarded = F.regexp_replace(text, r"\bbetween (\S+) and (\S+)", "between $1 ⟨and⟩ $2")
    items = F.split(guarded, r" (?:and|or) ")
    whole = F.transform(items, lambda x: F.trim(F.replace(x, F.lit("⟨and⟩"), F.lit("and"))))
    return F.filter(whole, lambda x: x != "")


def connectives(text: Column) -> Column:
    """AND/OR words of a condition list, without the AND of BETWEEN."""
    plain = F.regexp_replace(text, r"\bbetween (\S+) and (\S+)", "between")
    return F.regexp_extract_all(plain, F.lit(r" (and|or) "), 1)



def _join_conditions(from_text: Column) -> Column:
    found = F.regexp_extract_all(from_text, F.lit(r"\bon (.*?)(?= (?:inner |cross )?join\b|$)"), 1)
    return F.array_join(found, " and ")


def _all_conditions(c: Column) -> Column:
    texts = F.array(_join_conditions(c["from"]), c["where"], c["having"])
    return F.array_join(F.filter(texts, lambda x: x != ""), " and ")


# Keywords a query is described by, in the order they are listed.
KEYWORDS = (
    "where", "group", "having", "desc", "asc", "order", "limit",
    "except", "union", "intersect", "or", "not", "in", "like",
)


def keyword_set(c: Column) -> Column:
    """Keywords of a query, from its clauses."""
    # The conditions are put together once for all tests on them.
    conditions = F.concat(F.lit(" "), _all_conditions(c), F.lit(" "))
    return F.get(F.transform(F.array(conditions), lambda text: _keywords(c, text)), F.lit(0))


def _keywords(c: Column, conditions: Column) -> Column:
    ordered = c["order_by"] != ""
    descending = F.regexp_like(c["order_by"], F.lit(r"\bdesc\b"))
    present = {
        "where": c["where"] != "",
        "group": c["group_by"] != "",
        "having": c["having"] != "",
        "desc": ordered & descending,
        "asc": ordered & ~descending,
        "order": ordered,
        "limit": c["limit"] != "",
        "except": c["set_op"] == "except",
        "union": c["set_op"] == "union",
        "intersect": c["set_op"] == "intersect",
        "or": F.array_contains(connectives(conditions), "or"),
        "not": F.regexp_like(conditions, F.lit(r"\bnot\b")),
        "in": F.regexp_like(conditions, F.lit(r"\bin\b")),
        "like": F.regexp_like(conditions, F.lit(r"\blike\b")),
    }
    return F.array_compact(F.array(*[F.when(present[k], F.lit(k)) for k in KEYWORDS]))


_AGGREGATE = r"\b(?:max|min|count|sum|avg) ?⟦"


def complexity(c: Column) -> Column:
    """Counts that decide the difficulty: component1, component2, others."""

    def flag(test: Column) -> Column:
        return test.cast("int")

    conditions = F.concat(F.lit(" "), _all_conditions(c), F.lit(" "))
    where = split_conditions(c["where"])
    joins = F.regexp_count(c["from"], F.lit(r"\bjoin\b"))
    component1 = (
        flag(c["where"] != "")
        + flag(c["group_by"] != "")
        + flag(c["order_by"] != "")
        + flag(c["limit"] != "")
        + joins
        + F.size(F.filter(connectives(conditions), lambda x: x == "or"))
        + F.regexp_count(conditions, F.lit(r"\blike\b"))
    )
    component2 = F.regexp_count(conditions, F.lit(r"\{q\}")) + flag(c["set_op"] != "")
    aggregates = (
        F.regexp_count(c["select"], F.lit(_AGGREGATE))
        + F.regexp_count(c["order_by"], F.lit(_AGGREGATE))
        # Conditions count as aggregates when they are negated, as the scoring rules have it.
        + F.size(F.filter(where, lambda x: F.regexp_like(x, F.lit(r"\bnot\b"))))
        + F.size(F.filter(split_conditions(c["having"]), lambda x: F.regexp_like(x, F.lit(r"\bnot\b"))))
    )
    where_entries = F.size(where) + F.size(connectives(c["where"]))
    others = (
        flag(aggregates > 1)
        + flag(F.size(split_list(c["select"])) > 1)
        + flag(where_entries > 1)
        + flag(F.size(split_list(c["group_by"])) > 1)
    )
    return F.struct(component1.alias("component1"), component2.alias("component2"), others.alias("others"))


def difficulty(n: Column) -> Column:
    """easy / medium / hard / extra from the complexity counts."""
    c1, c2, others = n["component1"], n["component2"], n["others"]
    flat = c2 == 0
    return (
        F.when((c1 <= 1) & (others == 0) & flat, "easy")
        .when(flat & (((others <= 2) & (c1 <= 1)) | ((c1 <= 2) & (others < 2))), "medium")
        .when(
            (flat & (others > 2) & (c1 <= 2))
            | (flat & (c1 > 2) & (c1 <= 3) & (others <= 2))
            | ((c1 <= 1) & (others == 0) & (c2 <= 1)),
            "hard",
        )
        .otherwise("extra")
    )


def nested_inventory(sql: Column) -> Column:
    """How many sub-queries stand in parentheses anywhere, and how many set operations."""
    blank = blank_literals(sql)
    return F.struct(
        F.regexp_count(blank, F.lit(r"\( ?select\b")).alias("subqueries"),
        F.regexp_count(blank, F.lit(r"\b(?:union|intersect|except)\b")).alias("set_ops"),
    )


_COMPARE = rf"(?:(\w+)\.)?(\w+) ?(?:=|!=|<>|>=|<=|>|<|(?i:like)) ?({LITERAL}|[-+]?(?:{NUMBER}))"
_BETWEEN = r"(?:([^.\s]*)\.)?([^.\s]+) (?i:between) ([^\s;]+) (?i:and) ([^\s;]+)"


def typed_values(sql: Column) -> Column:
    """(table, column, literal) of every comparison with a literal and of BETWEEN bounds.

    Aliases t0..t9 give no table; columns are upper-cased, tables lower-cased.
    """
    text = collapse_space(sql)

    def groups(pattern: str, n: int) -> list[Column]:
        return [F.regexp_extract_all(text, F.lit(pattern), g) for g in range(1, n + 1)]

    def table(name: Column, alias_is_none: bool) -> Column:
        missing = name == ""
        if alias_is_none:
            missing = missing | name.rlike("^[tT][0-9]$")
        return F.when(~missing, F.lower(name))

    compared = F.transform(
        F.arrays_zip(*[g.alias(n) for g, n in zip(groups(_COMPARE, 3), "tcv")]),
        lambda x: F.struct(
            table(x["t"], True).alias("table_name"), F.upper(x["c"]).alias("column_name"), unquote(x["v"]).alias("literal")
        ),
    )
    bounds = F.flatten(
        F.transform(
            F.arrays_zip(*[g.alias(n) for g, n in zip(groups(_BETWEEN, 4), "tcab")]),
            lambda x: F.transform(
                F.array(x["a"], x["b"]),
                lambda v: F.struct(
                    table(x["t"], False).alias("table_name"), F.upper(x["c"]).alias("column_name"), v.alias("literal")
                ),
            ),
        )
    )
    return F.concat(compared, bounds)
