"""Fill the literals of gold queries into the slots of predicted ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.functions import text as T

# Fillings written by one task from one row.
CHUNK = 4096


def _digit(index: Column, base: Column, place: Column) -> Column:
    """The digit of `index` in the given base at a 0-based place."""
    scaled = F.aggregate(
        F.when(place > 0, F.sequence(F.lit(1).cast("long"), place.cast("long"))).otherwise(F.array().cast("array<bigint>")),
        index,
        lambda acc, _: F.floor(acc / base).cast("long"),
    )
    return F.pmod(scaled, base)


def _power(base: Column, times: Column) -> Column:
    """base^times in whole numbers; null beyond a long."""
    most = (1 << 63) - 1
    steps = F.when(times > 0, F.sequence(F.lit(1), times.cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(
        steps, F.lit(1).cast("long"), lambda acc, _: F.when((base == 0) | (acc <= F.floor(F.lit(most) / F.greatest(base, F.lit(1))) - 1), acc * base)
    )


# Whole numbers of any length are arrays of limbs, the lowest first.
LIMB_DIGITS = 9
LIMB = 10**LIMB_DIGITS


def _limbs(number: Column) -> Column:
    """Limbs of a whole number given in digits."""
    digits = number.cast("string")
    whole = F.lpad(digits, (F.ceil(F.length(digits) / LIMB_DIGITS) * LIMB_DIGITS).cast("int"), "0")
    return F.reverse(F.transform(F.regexp_extract_all(whole, F.lit(f".{{{LIMB_DIGITS}}}"), F.lit(0)), lambda x: x.cast("long")))


def _digits(limbs: Column) -> Column:
    """The digits of a number in limbs."""
    text = F.array_join(F.reverse(F.transform(limbs, lambda x: F.lpad(x.cast("string"), LIMB_DIGITS, "0"))), "")
    return F.regexp_replace(text, "^0+(?=.)", "")


def _times(limbs: Column, factor: Column) -> Column:
    state = lambda carry, out: F.struct(carry.alias("carry"), out.alias("out"))

    def step(acc: Column, limb: Column) -> Column:
        x = limb * factor + acc["carry"]
        return state(F.floor(x / LIMB).cast("long"), F.concat(acc["out"], F.array(F.pmod(x, F.lit(LIMB)))))

    start = state(F.lit(0).cast("long"), F.array().cast("array<bigint>"))
    return F.aggregate(limbs, start, step, lambda acc: F.when(acc["carry"] > 0, F.concat(acc["out"], F.array(acc["carry"]))).otherwise(acc["out"]))


def _divided(limbs: Column, by: Column) -> Column:
    """(rest, out): the remainder, and the quotient in limbs."""
    state = lambda rest, out: F.struct(rest.alias("rest"), out.alias("out"))

    def step(acc: Column, limb: Column) -> Column:
        x = acc["rest"] * LIMB + limb
        rest = F.pmod(x, by)
        return state(rest, F.concat(F.array(F.floor((x - rest) / by).cast("long")), acc["out"]))

    return F.aggregate(F.reverse(limbs), state(F.lit(0).cast("long"), F.array().cast("array<bigint>")), step)


def slot_plan(queries: DataFrame) -> DataFrame:
    """(query_id, sql_pred, pieces, values, n_alternatives): what fillings are made of, and how many there are.

    `n_alternatives` is literals^slots in digits, exact whatever its length.
    """
    gold, pred = T.reformat_tokens(F.col("sql_gt")), T.reformat_tokens(F.col("sql_pred"))
    cut = queries.select(
        "query_id", "sql_pred", F.split(T.slot_text(pred), rf"\b{T.SLOT}\b").alias("pieces"), F.array_distinct(T.literals(gold)).alias("values")
    )
    slots = F.slice("pieces", 2, F.size("pieces"))
    power = F.aggregate(slots, F.array(F.lit(1).cast("long")), lambda acc, _: _times(acc, F.size("values").cast("long")))
    return cut.withColumn("n_alternatives", _digits(power))


def fillings_in(plan: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, cand_idx, sql) of the candidates from `first` on, `number` of them or as many as there are.

    `ranges(query_id, first decimal(38,0), number)`. Candidate 0 is the prediction, candidate i > 0 the
    filling i - 1 in the order of `slot_fillings`. Each is worked out from its number alone, so a
    consumer asks for any range of any number of fillings, and nothing else is written.
    """
    asked = plan.join(ranges, "query_id").filter("number > 0")
    steps = F.explode(F.sequence(F.lit(0), F.col("number").cast("int") - 1)).alias("step")
    listed = asked.select("query_id", "sql_pred", "pieces", "values", "n_alternatives", "first", steps).withColumn(
        "cand_idx", (F.col("first") + F.col("step")).cast("decimal(38,0)")
    )
    # A decimal of 38 digits cannot reach a count of more.
    held = (F.length("n_alternatives") > 38) | (F.col("cand_idx") <= F.try_to_number("n_alternatives", F.lit("9" * 38)))
    base = F.greatest(F.size("values"), F.lit(1)).cast("long")
    state = lambda left, words: F.struct(left.alias("left"), words.alias("words"))

    def put(acc: Column, piece: Column) -> Column:
        parted = _divided(acc["left"], base)
        return state(parted["out"], F.concat(acc["words"], F.array(F.get("values", parted["rest"].cast("int")), piece)))

    start = state(_limbs(F.greatest(F.col("cand_idx") - 1, F.lit(0)).cast("decimal(38,0)")), F.slice("pieces", 1, 1))
    words = F.aggregate(F.slice("pieces", 2, F.size("pieces")), start, put, lambda acc: acc["words"])
    return listed.filter(held).select("query_id", "cand_idx", F.when(F.col("cand_idx") == 0, F.col("sql_pred")).otherwise(F.array_join(words, "")).alias("sql"))


def slot_fillings(queries: DataFrame) -> DataFrame:
    """Every way to put gold literals into the slots of a prediction.

    `queries(query_id, sql_gt, sql_pred)`. Candidate 0 is the prediction as it stands,
    the others are all literals^slots fillings. Long series are cut into chunks that
    different tasks write, so none is left out. `n_alternatives` is exact; where it is beyond
    a long it is null, nothing could write the fillings, and candidate 0 stands alone here: `slot_plan`
    has the count, and `fillings_in` any range of them.
    """
    prepared = (
        queries.withColumn("gold_words", T.reformat_tokens(F.col("sql_gt")))
        .withColumn("pred_words", T.reformat_tokens(F.col("sql_pred")))
        .withColumn("pieces", F.split(T.slot_text(F.col("pred_words")), rf"\b{T.SLOT}\b"))
        .withColumn("values", F.array_distinct(T.literals(F.col("gold_words"))))
        .drop("gold_words", "pred_words")
        .withColumn("n_slots", F.size("pieces") - 1)
        .withColumn("n_values", F.size("values").cast("long"))
        .withColumn("n_alternatives", _power(F.col("n_values"), F.col("n_slots")))
    )
    last = F.floor((F.col("n_alternatives") - 1) / CHUNK)
    chunked = (
        prepared.filter("n_alternatives > 0")
        .withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .repartition("query_id", "chunk")
    )
    first = F.col("chunk") * CHUNK
    final = F.least(first + CHUNK, F.col("n_alternatives")) - 1
    indexed = chunked.withColumn("index", F.explode(F.sequence(first, final)))
    filled = F.transform(
        "pieces",
        lambda piece, j: F.when(j == 0, piece).otherwise(
            F.concat(
                F.get("values", _digit(F.col("index"), F.greatest("n_values", F.lit(1)), j - 1).cast("int")), piece
            )
        ),
    )
    fillings = indexed.select(
        "query_id", (F.col("index") + 1).alias("cand_idx"), F.array_join(filled, "").alias("sql"), "n_alternatives"
    )
    own = prepared.select(
        "query_id", F.lit(0).cast("long").alias("cand_idx"), F.col("sql_pred").alias("sql"), "n_alternatives"
    )
    return own.union(fillings)


def first_round_candidates(queries: DataFrame) -> DataFrame:
    """Cleaned gold text and candidate list of raw (query_id, sql_gt, sql_pred)."""
    gold = T.remove_distinct(T.join_operators(F.col("sql_gt")))
    pred = T.remove_distinct(T.join_operators(T.fill_placeholder(F.col("sql_pred"))))
    cleaned = queries.select("query_id", gold.alias("sql_gt"), pred.alias("sql_pred"))
    candidates = slot_fillings(cleaned).withColumn("sql", T.fix_current_year(F.col("sql")))
    golds = cleaned.select("query_id", T.fix_current_year(F.col("sql_gt")).alias("sql_gt"))
    return candidates.join(golds, "query_id")
