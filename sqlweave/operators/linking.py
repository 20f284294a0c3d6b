"""Schema linking: which catalog columns a query uses, read off its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.functions.arrays import unnest
from sqlweave.functions.scopes import declared_tables, token_scopes
from sqlweave.functions.text import SPACE

_CTE = r"\b(\w+) as ?\( ?(?:select|with|values)\b"
_FROM = (
    r"\b(?:from|join) ([^()]+?)(?= (?:where|group by|order by|having|limit|union|intersect|except"
    r"|on|using|(?:inner |left |right |full |cross |natural )?(?:outer )?join)\b|[();]|$)"
)
_TOKEN = r"\w+\.\w+|\w+|[^\s\w]"
_BARE = r"(?<![\w.])([a-z_]\w*)(?![\w.(])"


_QUOTED = r'[`"\[][^`"\[\]]*[`"\]]'
_HELD = "quoted__"
# A run of white space. Other characters mostly fail on one comparison, not on the whole class.
_WIDE_SPACE = rf"(?![!-~]){SPACE}+"


def _plain(sql: Column) -> Column:
    """Lower-cased one-line text without string literals."""
    return F.regexp_replace(F.regexp_replace(F.lower(sql), r"'(?:[^']|'')*'", "''"), _WIDE_SPACE, " ")


def _held(text: Column) -> Column:
    """The text with every quoted name replaced by a word that holds its number."""
    pieces = F.split(text, _QUOTED, -1)
    return F.array_join(F.transform(pieces, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.lit(_HELD), i - 1, p))), "")


def _name(word: Column) -> Column:
    """A name as it stands in the catalog: what a held word stands for, without its quotes."""
    # Most words are no held ones, which a comparison tells without a search.
    number = F.when(word.startswith(_HELD), F.regexp_extract(word, rf"^{_HELD}(\d+)$", 1)).otherwise("")
    quoted = F.regexp_replace(F.get("__quoted", F.when(number != "", number).cast("int")), r'["`\[\]]', "")
    return F.when(number != "", quoted).otherwise(word)


def _parsed(queries: DataFrame) -> DataFrame:
    """Add `refs` (alias, table of the text's real tables), `qualified` and `bare` names."""
    text, ctes = F.col("__text"), F.col("__ctes")
    lists = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_FROM), 1), lambda x: F.split(x, ",")))
    words = F.transform(lists, lambda x: F.split(F.regexp_replace(F.trim(x), r"\bas\b ?", ""), " "))
    refs = F.transform(
        F.filter(words, lambda w: w[0] != ""),
        lambda w: F.struct(_name(F.coalesce(F.get(w, F.lit(1)), w[0])).alias("alias"), _name(w[0]).alias("table_name")),
    )
    real = F.filter(refs, lambda r: ~F.array_contains(ctes, r["table_name"]))
    declared, scopes = F.col("__declared"), F.col("__scopes")

    def owned(word: Column, i: Column) -> Column:
        """A prefixed name with the table that the nearest block around it declares under the prefix."""
        alias = _name(F.substring_index(word, ".", 1))
        near = F.filter(declared, lambda d: (d["alias"] == alias) & F.array_contains(F.get(scopes, i), d["block"]))
        return F.when(
            F.instr(word, ".") > 1,
            F.struct(
                alias.alias("alias"), _name(F.substring_index(word, ".", -1)).alias("column_name"),
                # In a text of one block all its declarations are near, so they need no scope.
                F.when(F.col("__nested"), F.try_element_at(near, F.lit(-1))["table"]).alias("table_name"),
            ),
        )

    pairs = F.filter(
        F.transform("__words", owned), lambda p: p.isNotNull() & ~F.coalesce(F.array_contains(ctes, p["table_name"]), F.lit(False))
    )
    named = F.transform(
        declared_tables(F.col("__words"), scopes, bare_aliases=True),
        lambda d: F.struct(_name(d["table"]).alias("table"), _name(d["alias"]).alias("alias"), d["block"].alias("block")),
    )
    rest = F.regexp_replace(F.regexp_replace(text, _FROM, "from"), r"\bas \w+", "")
    return (
        queries.withColumn("__plain", _plain(F.col("sql")))
        .withColumn("__quoted", F.regexp_extract_all(F.col("__plain"), F.lit(_QUOTED), 0))
        .withColumn("__text", _held(F.col("__plain")))
        # A column of its own: inside the lambdas it would be searched for again at every name.
        .withColumn("__ctes", F.regexp_extract_all(text, F.lit(_CTE), 1))
        .withColumn("__words", F.regexp_extract_all(text, F.lit(_TOKEN), 0))
        .withColumn("__nested", F.size(F.filter("__words", lambda w: w == "select")) > 1)
        .withColumn("__scopes", F.when(F.col("__nested"), token_scopes(F.col("__words"))))
        .withColumn("__declared", F.when(F.col("__nested"), named))
        .withColumn("__refs", F.array_distinct(real))
        .withColumn("__qualified", F.array_distinct(pairs))
        .withColumn("__bare", F.array_distinct(F.transform(F.regexp_extract_all(rest, F.lit(_BARE), 1), _name)))
    )


def used_tables(queries: DataFrame, columns: DataFrame) -> DataFrame:
    """(question_id, db_id, table_name): existing tables a query reads, also those it takes
    no named column from."""
    names = F.array_distinct(F.transform("__refs", lambda r: r["table_name"]))
    named = unnest(_parsed(queries), names, "__t", "question_id", "db_id")
    tables = columns.select("db_id", "table_name", F.lower("table_name").alias("__t")).distinct()
    return named.join(tables, ["db_id", "__t"]).drop("__t")


def used_columns(queries: DataFrame, columns: DataFrame) -> DataFrame:
    """Catalog rows of the columns each query uses.

    An alias means the table that the nearest block around it declares under it, or where none does
    all tables the text declares under it. CTE names are no tables, a bare name belongs to every used
    table that has it. All name pairs of a text are worked out inside its row; one
    equi-join on the full column name then keeps those that exist.
    """

    def resolve(name: Column) -> Column:
        hit = F.filter("__refs", lambda r: (r["alias"] == name["alias"]) | (r["table_name"] == name["alias"]))
        by_alias = F.filter(hit, lambda r: r["alias"] == name["alias"])
        anywhere = F.transform(F.when(F.size(by_alias) > 0, by_alias).otherwise(hit), lambda r: r["table_name"])
        tables = F.when(name["table_name"].isNotNull(), F.array(name["table_name"])).otherwise(anywhere)
        return F.transform(tables, lambda t: F.struct(t.alias("t"), name["column_name"].alias("c")))

    def everywhere(name: Column) -> Column:
        return F.transform("__refs", lambda r: F.struct(r["table_name"].alias("t"), name.alias("c")))

    named = F.flatten(F.transform("__qualified", resolve))
    bare = F.flatten(F.transform("__bare", everywhere))
    wanted = (
        unnest(_parsed(queries), F.array_distinct(F.concat(named, bare)), "n", "question_id", "db_id")
        .select("question_id", "db_id", F.col("n.t").alias("__t"), F.col("n.c").alias("__c"))
    )
    known = columns.withColumns({"__t": F.lower("table_name"), "__c": F.lower("column_name")})
    return wanted.join(known, ["db_id", "__t", "__c"]).drop("__t", "__c")
