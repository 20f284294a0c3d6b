"""Which query block every token of a text stands in, and what names mean there.

A block is a SELECT in parentheses or one side of a set operation. Its number grows from left to
right; a token carries the numbers of the blocks around it, so a name finds the nearest table that
declares it. Arrays of tokens only, nothing is parsed into a tree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SET_OPERATIONS = ("union", "intersect", "except")
# Words that open a clause.
ZONES = ("select", "from", "join", "on", "using", "where", "group", "having", "order", "limit")
# Words that may stand behind a table and are no alias of it.
NO_ALIAS = (*ZONES, *SET_OPERATIONS, "as", "inner", "left", "right", "full", "cross", "natural", "outer")
NO_NAMES = "array<struct<table:string,column:string,representative:string>>"


def token_scopes(words: Column) -> Column:
    """The blocks around every token, outermost first, its own last.

    Only parentheses and set operations change the block, so only these are folded; a token has the
    blocks of the last change before it.
    """
    path = "array<int>"
    start = F.struct(
        F.expr(f"cast(array(array(0)) as array<{path}>)").alias("stack"),
        F.lit(1).alias("next"),
        F.expr(f"cast(array(struct(0, array(0))) as array<struct<at:int,blocks:{path}>>)").alias("changes"),
    )

    def step(state: Column, turn: Column) -> Column:
        blocks = F.element_at(state["stack"], -1)
        below = F.slice(state["stack"], 1, F.size(state["stack"]) - 1)
        new = F.array(state["next"])
        stack = (
            F.when(turn["opens"], F.concat(state["stack"], F.array(F.concat(blocks, new))))
            .when(turn["word"] == "(", F.concat(state["stack"], F.array(blocks)))
            .when(turn["word"] != ")", F.concat(below, F.array(F.concat(F.slice(blocks, 1, F.size(blocks) - 1), new))))
            .when(F.size(state["stack"]) > 1, below)
            .otherwise(state["stack"])
        )
        moved = F.struct(
            stack.alias("stack"),
            (state["next"] + F.when(turn["opens"] | turn["word"].isin(*SET_OPERATIONS), 1).otherwise(0)).alias("next"),
            turn["at"].alias("at"), state["changes"].alias("changes"),
        )
        # The new stack is worked out once for both of its uses.
        once = F.transform(
            F.array(moved),
            lambda m: F.struct(
                m["stack"].alias("stack"), m["next"].alias("next"),
                F.concat(m["changes"], F.array(F.struct(m["at"].alias("at"), F.element_at(m["stack"], -1).alias("blocks")))).alias("changes"),
            ),
        )
        return F.get(once, F.lit(0))

    def turn(word: Column, i: Column) -> Column:
        opens = (word == "(") & F.coalesce(F.get(words, i + 1).isin("select", "with"), F.lit(False))
        return F.when(
            word.isin("(", ")", *SET_OPERATIONS), F.struct(word.alias("word"), opens.alias("opens"), (i + 1).alias("at"))
        )

    turns = F.filter(F.transform(words, turn), lambda t: t.isNotNull())
    blocks = F.size(F.filter(words, lambda w: w == "select")) > 1
    changes = F.when(blocks, F.aggregate(turns, start, step, lambda state: state["changes"])).otherwise(start["changes"])
    return F.get(
        F.transform(
            F.array(changes),
            lambda found: F.transform(
                words, lambda _, i: F.element_at(F.filter(found, lambda c: c["at"] <= i), -1)["blocks"]
            ),
        ),
        F.lit(0),
    )


def _declares(words: Column, scopes: Column, i: Column) -> Column:
    """Whether token `i` stands where a table is named: behind FROM or JOIN, or behind a comma of that list."""
    before = F.get(words, i - 1)
    own = lambda j: F.element_at(F.get(scopes, j), -1)
    # The clause word before the comma, of the comma's own block.
    clause = F.try_element_at(
        F.filter(words, lambda w, j: (j < i - 1) & w.isin(*ZONES) & (own(j) == own(i - 1))), F.lit(-1)
    )
    return F.coalesce(
        F.when(before.isin("from", "join"), F.lit(True)).when(before == ",", clause.isin("from", "join")), F.lit(False)
    )


def declared_tables(words: Column, scopes: Column, bare_aliases: bool = False) -> Column:
    """(at, table, alias, block) of everything read in a FROM list; a sub-query's table is '('.

    Only AS gives an alias, or with `bare_aliases` the word behind the table as well; a table without
    one stands under its own name.
    """

    def declared(word: Column, i: Column) -> Column:
        after = F.get(words, i + 1)
        alias = F.when((after == "as") & (word != "("), F.get(words, i + 2))
        if bare_aliases:
            alias = alias.when((word != "(") & after.rlike(r"^[a-z_]\w*$") & ~after.isin(*NO_ALIAS), after)
        alias = alias.otherwise(word)
        block = F.element_at(F.get(scopes, F.when(word == "(", i - 1).otherwise(i)), -1)
        found = F.struct(i.alias("at"), word.alias("table"), alias.alias("alias"), block.alias("block"))
        return F.when(_declares(words, scopes, i), found)

    return F.filter(F.transform(words, declared), lambda d: d.isNotNull())


def with_resolved_names(df: DataFrame, words: str, out: str, names: Column | None = None) -> DataFrame:
    """Add the tokens of a lower-cased query with every column under its table's name.

    A prefix means the table declared under it in the nearest block around it, else the last one
    anywhere in the text. Where a block reads one table only, that table's columns stand without it.
    In other blocks a bare name belongs to the block's first table that has it, by `names(table,
    column, representative)` of the query's database, and a column stands under its representative
    where it has one. Aliases are left out of FROM lists. Names that cannot be placed stay as they are.
    """
    tokens, scopes, tables = F.col(words), F.col("__scopes"), F.col("__tables")
    known = F.lit(None).cast(NO_NAMES) if names is None else F.col("__names")

    def meant(prefix: Column, blocks: Column) -> Column:
        near = F.filter(tables, lambda d: (d["alias"] == prefix) & F.array_contains(blocks, d["block"]))
        anywhere = F.filter(tables, lambda d: d["alias"] == prefix)
        last = lambda found: F.try_element_at(found, F.lit(-1))["table"]
        return F.coalesce(last(near), last(anywhere), prefix)

    def read(word: Column, i: Column) -> Column:
        """A token with the table and column it names, if it names any, and its block's tables."""
        blocks = F.get(scopes, i)
        own = F.get("__own", F.element_at(blocks, -1))
        dotted = word.rlike(r"^[a-z_]\w*\.")
        table = F.when(dotted, meant(F.substring_index(word, ".", 1), blocks))
        column = F.when(dotted, F.substr(word, F.instr(word, ".") + 1)).otherwise(word)
        if names is not None:
            places = F.exists(tables, lambda d: d["at"] == i) | (F.coalesce(F.get(tokens, i - 1), F.lit("")) == "as")
            called = F.coalesce(F.get(tokens, i + 1), F.lit("")) == "("
            free = (F.size(own) > 1) & word.rlike(r"^[a-z_]\w*$") & ~places & ~called
            owner = F.filter(own, lambda t: F.exists(known, lambda n: (n["table"] == t) & (n["column"] == word)))
            table = table.when(free, F.get(owner, F.lit(0)))
        return F.struct(word.alias("word"), table.alias("table"), column.alias("column"), own.alias("own"))

    def placed(r: Column) -> Column:
        inside = F.array_contains(r["own"], r["table"])
        full = F.concat_ws(".", r["table"], r["column"])
        if names is not None:
            entry = F.get(F.filter(known, lambda n: (n["table"] == r["table"]) & (n["column"] == r["column"])), F.lit(0))
            full = F.when(inside, F.coalesce(entry["representative"], full)).otherwise(full)
        return (
            F.when(r["table"].isNull(), r["word"]).when((F.size(r["own"]) == 1) & inside, r["column"]).otherwise(full)
        )

    def kept(_: Column, i: Column) -> Column:
        """Not the AS behind a table, nor the alias behind that."""
        return ~F.exists(
            tables, lambda d: (d["table"] != "(") & (d["alias"] != d["table"]) & i.between(d["at"] + 1, d["at"] + 2)
        )

    # Tables of every block, by its number.
    last_block = F.coalesce(F.array_max(F.transform(scopes, lambda blocks: F.element_at(blocks, -1))), F.lit(0))
    own_tables = F.transform(
        F.sequence(F.lit(0), last_block),
        lambda b: F.array_distinct(F.transform(F.filter(tables, lambda d: d["block"] == b), lambda d: d["table"])),
    )
    staged = (
        df.withColumn("__scopes", token_scopes(tokens))
        .withColumn("__tables", declared_tables(tokens, scopes))
        .withColumn("__own", own_tables)
    )
    if names is not None:
        staged = staged.withColumn("__names", names)
    full = staged.withColumn("__read", F.transform(tokens, read)).withColumn(
        out, F.filter(F.transform("__read", placed), kept)
    )
    return full.drop("__scopes", "__tables", "__own", "__read", *([] if names is None else ["__names"]))
