"""Revision and pair mining over events, preference metrics over lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sqlweave.operators import correction as V
from sqlweave.operators import preference as P
from sqlweave.operators import scoring as S
from sqlweave.session import load


def _attempts(spark: SparkSession, sf: str) -> DataFrame:
    """A user's events of one weekday are the attempts at one question."""
    return load(spark, sf, "events").select(
        (F.col("user_id") * 10 + F.weekday("ts")).alias("question_id"),
        F.col("event_id").alias("attempt_id"),
        F.concat(F.lit("SELECT gold "), "user_id").alias("sql_gt"),
        F.concat(F.lit("SELECT "), "value").alias("sql_pred"),
        F.when(F.col("event_type").isin("purchase", "signup"), 1).otherwise(0).alias("res"),
    )


def pair_mining(spark, sf):
    return V.mine_pairs(_attempts(spark, sf))


def _first_pass(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select(
        F.col("event_id").alias("question_id"), F.concat(F.lit("SELECT "), "value").alias("sql_pred")
    )


def _grade(rows: DataFrame) -> DataFrame:
    """A text is right when its length is a multiple of three."""
    right = F.length("sql_pred") % 3 == 0
    return rows.withColumn("res", right.cast("int")).withColumn("error_msg", F.when(~right, "runnable but wrong"))


def _generate(wrong: DataFrame) -> DataFrame:
    return wrong.select("question_id", F.concat("sql_pred", F.lit("0")).alias("sql_pred"))


def _history(spark: SparkSession, sf: str, rounds: int = 2) -> DataFrame:
    return V.revise(_first_pass(spark, sf), _grade, _generate, rounds)


def revision_history(spark, sf):
    lines = V.history_lines(_history(spark, sf))
    return lines.select("question_id", "round", "sql_pred", "error_msg", "step", "n_steps")


def last_prediction(spark, sf):
    return V.last_prediction(_history(spark, sf))


def revised_accuracy(spark, sf):
    first = _grade(_first_pass(spark, sf))
    revised = V.last_prediction(_history(spark, sf)).join(first.filter("res = 0").select("question_id"), "question_id", "left_semi")
    merged = V.merge_revised(first.select("question_id", "sql_pred", "res"), _grade(revised).select("question_id", "sql_pred", "res"))
    return S.execution_accuracy(merged).withColumn("accuracy", F.round("accuracy", 6))


def training_file(spark, sf):
    """Mined rows without bookkeeping, candidate lists unwrapped."""
    rows = _attempts(spark, sf).withColumns(
        {
            "error": F.lit(False), "timeout": F.lit(False), "pre_sql_gt": F.lit(""), "pre_sql_pred": F.lit(""),
            "sql_pred": F.array(F.when(F.col("attempt_id") % 9 == 0, F.col("sql_gt")).otherwise(F.col("sql_pred"))),
        }
    )
    return V.unwrap(V.drop_bookkeeping(rows, ordered_family=True))


def round_concat(spark, sf):
    """Two rounds of generated rows put together, counted."""
    attempts = _attempts(spark, sf)
    both = V.concat_rounds([attempts.filter("res = 1"), attempts.filter("res = 0")])
    return both.groupBy("round", "question_id").agg(F.count(F.lit(1)).alias("n"))


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    """A part is a pair, its open lines the chosen side, a line one token."""
    return load(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("pair_id"),
        F.when(F.col("l_linestatus") == "O", "chosen").otherwise("rejected").alias("side"),
        F.col("l_linenumber").alias("token_idx"),
        (-F.log1p(F.col("l_extendedprice") / 10000)).alias("logp"),
        (-F.log1p(F.col("l_quantity") / 10)).alias("ref_logp"),
        (F.col("l_linenumber") > 1).alias("is_completion"),
    )


def preference_report(spark, sf):
    rated = P.rewards(P.sequence_logps(_tokens(spark, sf)))
    means = {
        "reward_chosen": "reward_chosen", "reward_rejected": "reward_rejected", "margin": "margin", "accuracy": "win",
        "logp_chosen": "c", "logp_rejected": "r",
    }
    return rated.agg(*[F.round(F.avg(c), 6).alias(name) for name, c in means.items()], F.count(F.lit(1)).alias("n_pairs"))


_LOSSES = ["sigmoid", "robust", "exo_pair", "hinge", "sppo_hard", "nca_pair", "apo_zero", "apo_down", "discopop"]


def pair_losses(spark, sf):
    """Every element-wise loss of every pair."""
    pairs = P.sequence_logps(_tokens(spark, sf))
    smoothing = {"sigmoid": 0.1, "robust": 0.1}
    losses = [F.round(P.pair_loss(k, smoothing=smoothing.get(k, 0.0)), 6).alias(k) for k in _LOSSES]
    return pairs.select("pair_id", *losses)


def divergence_losses(spark, sf):
    pairs = P.sequence_logps(_tokens(spark, sf))
    means = P.sequence_logps(_tokens(spark, sf), mean=True).select("pair_id", F.round(P.pair_loss("ipo"), 6).alias("ipo"))
    variants = pairs.select(
        "pair_id",
        F.round(P.pair_loss("sigmoid", P.logits("js")), 6).alias("js"),
        F.round(P.pair_loss("sigmoid", P.logits("alpha", alpha=0.1)), 6).alias("alpha"),
        F.round(P.pair_loss("sigmoid", P.logits(reference_free=True)), 6).alias("reference_free"),
    )
    return variants.join(means, "pair_id")


def baseline_loss(spark, sf):
    """Batches are part brands in the order of their numbers."""
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    brands = load(spark, sf, "part").select(F.col("p_partkey").alias("pair_id"), number.alias("batch"))
    pairs = P.sequence_logps(_tokens(spark, sf)).join(brands, "pair_id")
    return P.baseline_loss(pairs, "batch").select("pair_id", F.round("delta", 6).alias("delta"), F.round("loss", 6).alias("loss"))


def sorted_losses(spark, sf):
    brands = load(spark, sf, "part").select(F.col("p_partkey").alias("pair_id"), F.col("p_brand").alias("batch"))
    pairs = P.sequence_logps(_tokens(spark, sf)).join(brands, "pair_id")
    paired = P.sorted_pair_loss(pairs, "batch").withColumnRenamed("loss", "aot_pair")
    other = P.sorted_pair_loss(pairs, "batch", paired=False).withColumnRenamed("loss", "aot")
    return paired.join(other, ["batch", "rank"]).select(
        "batch", "rank", F.round("aot_pair", 6).alias("aot_pair"), F.round("aot", 6).alias("aot")
    )


def composite_loss(spark, sf):
    pairs = P.sequence_logps(_tokens(spark, sf))
    nll = -F.col("c") / 10
    weight = P.policy_weight(F.col("c") / 100, F.col("r") / 100 + 0.2)
    loss = P.composite_loss(P.pair_loss("sigmoid"), nll, 1.0, weight, F.abs("margin"), 0.001)
    return P.rewards(pairs).select("pair_id", F.round(loss, 6).alias("loss"))


def logged_means(spark, sf):
    logged = load(spark, sf, "events").select(
        F.col("event_type").alias("phase"), F.concat(F.lit("day_"), F.weekday("ts")).alias("metric"), "value"
    )
    return P.logged_means(logged).withColumn("value", F.round("value", 6))


_SIG = "(1 / (1 + exp(-({}))))"
_LSIG = "(least({0}, 0) - ln(1 + exp(-abs({0}))))"
_PAIRS_SQL = """
tk as (select l_partkey pair_id, l_linestatus = 'O' ch, -ln(1 + l_extendedprice / 10000) lp, -ln(1 + l_quantity / 10) rp,
       l_linenumber > 1 comp from lineitem),
pr as (select pair_id, coalesce(sum(lp) filter (ch and comp), 0) c, coalesce(sum(lp) filter (not ch and comp), 0) r,
       coalesce(sum(rp) filter (ch and comp), 0) rc, coalesce(sum(rp) filter (not ch and comp), 0) rr,
       count(*) filter (ch and comp) nc, count(*) filter (not ch and comp) nr from tk group by 1),
z as (select *, (c - r) - (rc - rr) z, c - rc dc, r - rr dr, 0.1 * ((c - r) - (rc - rr)) bz from pr)
"""


def _losses_sql() -> str:
    lp, ln = _LSIG.format("bz"), _LSIG.format("(-bz)")
    forms = {
        "sigmoid": f"-{lp} * 0.9 - {ln} * 0.1",
        "robust": f"(-{lp} * 0.9 + {ln} * 0.1) / 0.8",
        "exo_pair": f"{_SIG.format('bz')} * ({lp} - ln(0.999)) + {_SIG.format('-bz')} * ({ln} - ln(0.001))",
        "hinge": "greatest(1 - bz, 0)",
        "sppo_hard": "pow(dc - 5, 2) + pow(dr + 5, 2)",
        "nca_pair": f"-{_LSIG.format('(0.1 * dc)')} - 0.5 * {_LSIG.format('(-0.1 * dc)')} - 0.5 * {_LSIG.format('(-0.1 * dr)')}",
        "apo_zero": f"1 - {_SIG.format('0.1 * dc')} + {_SIG.format('0.1 * dr')}",
        "apo_down": f"{_SIG.format('0.1 * dc')} + 1 - {_SIG.format('0.1 * (dc - dr)')}",
        "discopop": f"-{lp} * (1 - {_SIG.format('bz / 0.05')}) + exp(-bz) * {_SIG.format('bz / 0.05')}",
    }
    return ", ".join(f"round({v}, 6) {k}" for k, v in forms.items())


_SOFT = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"


_HISTORY_SQL = """
b as (select event_id, 'SELECT ' || value p, (3 - length('SELECT ' || value) % 3) % 3 need from events),
h as (select event_id question_id, unnest(range(0, need + 1))::int "round", p, need from b)
"""

QUERIES = {
    "pair_mining": (
        pair_mining,
        """with a as (select user_id * 10 + (isodow(ts) - 1) q, event_id id, 'SELECT gold ' || user_id gold, 'SELECT ' || value pred,
        (event_type in ('purchase', 'signup'))::int res from events),
        c as (select *, sum(1 - res) over (partition by q) w, sum(res) over (partition by q) r from a),
        s as (select *, case when w > r and r >= 1 and w > 1 then least(w - r, r) when w >= 2 and w <= r then w - 1 else 0 end n,
              w > r and r >= 1 and w > 1 more, w >= 2 and w <= r mixed from c where w > 0),
        o as (select *, row_number() over (partition by q, res order by
              case when (res = 0 and more) or (res = 1 and mixed) then md5('pairs|' || id) end, id) k from s)
        select distinct w.q question_id, coalesce(r.pred, w.gold) chosen, w.pred rejected
        from o w left join o r on r.q = w.q and r.res = 1 and r.k = w.k and r.k <= r.n
        where w.res = 0 and (not w.more or w.k <= w.n) and coalesce(r.pred, w.gold) <> w.pred""",
    ),
    "revision_history": (
        revision_history,
        f"""with {_HISTORY_SQL} select question_id, "round", p || repeat('0', "round") sql_pred,
        case when "round" < need then 'runnable but wrong' end error_msg, ("round" + 1)::bigint step, (need + 1)::bigint n_steps from h""",
    ),
    "last_prediction": (
        last_prediction,
        f"""with {_HISTORY_SQL} select event_id question_id, need::int "round", p || repeat('0', need) sql_pred from b""",
    ),
    "revised_accuracy": (revised_accuracy, "select count(*) n, 1.0::double accuracy from events"),
    "training_file": (
        training_file,
        """select event_id attempt_id, 'SELECT gold ' || user_id sql_gt, 'SELECT ' || value sql_pred,
        (event_type in ('purchase', 'signup'))::int res from events where event_id % 9 <> 0""",
    ),
    "round_concat": (
        round_concat,
        """select (event_type not in ('purchase', 'signup'))::int "round", user_id * 10 + (isodow(ts) - 1) question_id, count(*) n
        from events group by 1, 2""",
    ),
    "preference_report": (
        preference_report,
        f"""with {_PAIRS_SQL} select round(avg(0.1 * dc), 6) reward_chosen, round(avg(0.1 * dr), 6) reward_rejected,
        round(avg(0.1 * dc - 0.1 * dr), 6) margin, round(avg((0.1 * dc > 0.1 * dr)::int), 6) accuracy, round(avg(c), 6) logp_chosen,
        round(avg(r), 6) logp_rejected, count(*) n_pairs from z""",
    ),
    "pair_losses": (pair_losses, f"with {_PAIRS_SQL} select pair_id, {_losses_sql()} from z"),
    "divergence_losses": (
        divergence_losses,
        f"""with {_PAIRS_SQL}, d as (select *, 0.1 * (z - ({_SOFT.format('dc')} - {_SOFT.format('dr')})) js,
        0.1 * ((exp(least(-0.1 * dr, 88)) - exp(least(-0.1 * dc, 88))) / 0.1) al, 0.1 * (c - r) fr,
        (c / nullif(nc, 0) - r / nullif(nr, 0)) - (rc / nullif(nc, 0) - rr / nullif(nr, 0)) zm from z)
        select pair_id, round(-{_LSIG.format('js')}, 6) js, round(-{_LSIG.format('al')}, 6) alpha,
        round(-{_LSIG.format('fr')}, 6) reference_free, round(pow(zm - 5, 2), 6) ipo from d""",
    ),
    "baseline_loss": (
        baseline_loss,
        f"""with {_PAIRS_SQL}, y as (select z.*, regexp_extract(p_brand, '([0-9]+)$', 1)::int batch from z join part on p_partkey = pair_id),
        r as (select batch, sum(sum(0.1 * dc + 0.1 * dr)) over (order by batch) / (2 * sum(count(*)) over (order by batch)) delta from y group by batch),
        b as (select y.*, delta from y join r using (batch))
        select pair_id, round(delta, 6) delta, round(-{_LSIG.format('(0.1 * dc - delta)')} - {_LSIG.format('(-(0.1 * dr - delta))')}, 6) loss from b""",
    ),
    "sorted_losses": (
        sorted_losses,
        f"""with {_PAIRS_SQL}, b as (select z.*, p_brand batch from z join part on p_partkey = pair_id),
        r as (select batch, row_number() over (partition by batch order by dc, pair_id) r1, row_number() over (partition by batch order by dr, pair_id) r2,
              row_number() over (partition by batch order by c - r, pair_id) r3, row_number() over (partition by batch order by rc - rr, pair_id) r4,
              dc, dr, c - r pol, rc - rr ref from b),
        m as (select a.batch, a.r1 "rank", 0.1 * (a.dc - b.dr) x, 0.1 * (c.pol - d.ref) y from r a join r b on b.batch = a.batch and b.r2 = a.r1
              join r c on c.batch = a.batch and c.r3 = a.r1 join r d on d.batch = a.batch and d.r4 = a.r1)
        select batch, "rank", round(-{_LSIG.format('x')}, 6) aot_pair, round(-{_LSIG.format('y')}, 6) aot from m""",
    ),
    "composite_loss": (
        composite_loss,
        f"""with {_PAIRS_SQL} select pair_id, round((-{_LSIG.format('bz')} + (-c / 10)) * least(exp(c / 100 + r / 100 + 0.2), 1)
        + 0.001 * abs(0.1 * dc - 0.1 * dr), 6) loss from z""",
    ),
    "logged_means": (
        logged_means,
        "select event_type phase, 'day_' || (isodow(ts) - 1) metric, round(avg(value), 6) \"value\" from events group by 1, 2",
    ),
}
