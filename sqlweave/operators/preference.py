"""Preference metrics over logged token log-probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqlweave.functions.vectors import log_sigmoid, sigmoid, softplus
from sqlweave.operators.ranking import position, running

# Default parameters of the losses.
BETA = 0.1
ALPHA = 1.0
EXO_SMOOTHING = 1e-3
DISCOPOP_TAU = 0.05
# exp() of anything above this is cut to it.
MAX_EXPONENT = 88.0

# Parts of a batch that are ranked apart from each other, and of the rows that share one value.
PARTS, TIED_PARTS = 256, 64


def sequence_logps(tokens: DataFrame, mean: bool = False) -> DataFrame:
    """One row per pair: log-probabilities of both sides over completion tokens.

    `tokens(pair_id, side, token_idx, logp, ref_logp, is_completion)`, side 'chosen' or
    'rejected'. `mean` divides by the number of completion tokens.
    """

    def total(column: str, side: str) -> Column:
        own = (F.col("side") == side) & F.col("is_completion")
        summed = F.coalesce(F.sum(F.when(own, F.col(column))), F.lit(0.0))
        return summed / F.nullif(F.count(F.when(own, 1)), F.lit(0)) if mean else summed

    return tokens.groupBy("pair_id").agg(
        total("logp", "chosen").alias("c"),
        total("logp", "rejected").alias("r"),
        total("ref_logp", "chosen").alias("ref_c"),
        total("ref_logp", "rejected").alias("ref_r"),
    )


def rewards(pairs: DataFrame, beta: float = BETA) -> DataFrame:
    """Rewards of both sides, their margin, and whether the chosen side wins."""
    chosen, rejected = beta * (F.col("c") - F.col("ref_c")), beta * (F.col("r") - F.col("ref_r"))
    return pairs.withColumns(
        {
            "reward_chosen": chosen,
            "reward_rejected": rejected,
            "margin": chosen - rejected,
            "win": F.when(chosen > rejected, 1).otherwise(0),
        }
    )


def logits(divergence: str = "reverse_kl", reference_free: bool = False, alpha: float = ALPHA) -> Column:
    """Difference of the log-ratios of both sides under a divergence."""
    kept = 0.0 if reference_free else 1.0
    chosen, rejected = F.col("c") - kept * F.col("ref_c"), F.col("r") - kept * F.col("ref_r")
    if divergence == "alpha":
        def capped(x: Column) -> Column:
            return F.exp(F.least(x, F.lit(MAX_EXPONENT)))

        return (capped(-alpha * rejected) - capped(-alpha * chosen)) / alpha
    z = (F.col("c") - F.col("r")) - kept * (F.col("ref_c") - F.col("ref_r"))
    if divergence == "js":
        return z - (softplus(chosen) - softplus(rejected))
    if divergence == "reverse_kl":
        return z
    raise ValueError(f"unknown divergence {divergence!r}")


def _smooth(x: Column, smoothing: float) -> Column:
    return -log_sigmoid(x) * (1 - smoothing) - log_sigmoid(-x) * smoothing


def pair_loss(
    kind: str, z: Column | None = None, beta: float = BETA, smoothing: float = 0.0, tau: float = DISCOPOP_TAU
) -> Column:
    """Loss of a pair as an expression over c, r, ref_c and ref_r."""
    z = logits() if z is None else z
    bz = beta * z
    chosen, rejected = F.col("c") - F.col("ref_c"), F.col("r") - F.col("ref_r")
    if kind == "sigmoid":
        return _smooth(bz, smoothing)
    if kind == "robust":
        return (-log_sigmoid(bz) * (1 - smoothing) + log_sigmoid(-bz) * smoothing) / (1 - 2 * smoothing)
    if kind == "exo_pair":
        s = F.lit(smoothing or EXO_SMOOTHING)
        return sigmoid(bz) * (log_sigmoid(bz) - F.log(1 - s)) + sigmoid(-bz) * (log_sigmoid(-bz) - F.log(s))
    if kind == "hinge":
        return F.greatest(1 - bz, F.lit(0.0))
    if kind == "ipo":
        return F.pow(z - 1 / (2 * beta), 2)
    if kind == "sppo_hard":
        return F.pow(chosen - 0.5 / beta, 2) + F.pow(rejected + 0.5 / beta, 2)
    if kind == "nca_pair":
        return -log_sigmoid(beta * chosen) - 0.5 * log_sigmoid(-beta * chosen) - 0.5 * log_sigmoid(-beta * rejected)
    if kind == "apo_zero":
        return 1 - sigmoid(beta * chosen) + sigmoid(beta * rejected)
    if kind == "apo_down":
        return sigmoid(beta * chosen) + 1 - sigmoid(beta * (chosen - rejected))
    if kind == "discopop":
        mix = sigmoid(bz / tau)
        return -log_sigmoid(bz) * (1 - mix) + F.exp(-bz) * mix
    raise ValueError(f"unknown loss {kind!r}")


def baseline_loss(pairs: DataFrame, batch: str, beta: float = BETA) -> DataFrame:
    """Loss against the running mean reward (`delta`): over a pair's batch and all before it.

    `batch` is an integer that orders the batches; one mean per batch is joined back.
    """
    chosen, rejected = beta * (F.col("c") - F.col("ref_c")), beta * (F.col("r") - F.col("ref_r"))
    sums = pairs.groupBy(batch).agg(
        (F.sum(chosen) + F.sum(rejected)).alias("__sum"), (F.count(chosen) + F.count(rejected)).alias("__count")
    )
    upto = running(sums, [], batch, {"__rewards": F.col("__sum"), "__n": F.col("__count")})
    means = upto.select(batch, (F.col("__rewards") / F.col("__n")).alias("delta"))
    loss = -log_sigmoid(chosen - F.col("delta")) - log_sigmoid(-(rejected - F.col("delta")))
    return pairs.join(means, batch).withColumn("loss", loss)


def _leading(cuts: Column, holds: Callable[[Column], Column]) -> Column:
    """How many of fewer than PARTS ascending cuts fulfil a condition that ends somewhere, by halving."""
    steps = F.array(*[F.lit(1 << b) for b in reversed(range((PARTS - 1).bit_length()))])
    return F.aggregate(
        steps, F.lit(0), lambda n, step: n + F.when(holds(F.get(cuts, n + step - 1)), step).otherwise(0)
    )


def sorted_pair_loss(
    pairs: DataFrame, batch: str, paired: bool = True, beta: float = BETA, smoothing: float = 0.0
) -> DataFrame:
    """Both sides sorted within a batch and met by rank.

    `paired` compares the sides' log-ratios, otherwise policy and reference ones. Values
    are ranked between approximate percentiles of their batch, and rows that share a
    percentile's value in further parts, so a large batch is spread over tasks.
    """
    if paired:
        left, right = F.col("c") - F.col("ref_c"), F.col("r") - F.col("ref_r")
    else:
        left, right = F.col("c") - F.col("r"), F.col("ref_c") - F.col("ref_r")

    def ranked(value: Column, name: str) -> DataFrame:
        valued = pairs.select(batch, "pair_id", value.alias(name))
        percentiles = [i / PARTS for i in range(1, PARTS)]
        cuts = valued.groupBy(batch).agg(F.percentile_approx(name, percentiles).alias("__cuts"))
        below = _leading(F.col("__cuts"), lambda c: c < F.col(name))
        upto = _leading(F.col("__cuts"), lambda c: c <= F.col(name))
        # Between two cuts both counts are equal; where they differ all values are the same.
        tied = F.when(below < upto, F.pmod(F.xxhash64("pair_id"), F.lit(TIED_PARTS))).otherwise(0)
        cut = valued.join(cuts, batch).withColumn("__part", F.struct((below + upto).alias("at"), tied.alias("tied"))).drop("__cuts")
        return position(cut, [batch], [F.col(name), F.col("pair_id")], F.col("__part"), "rank").drop("pair_id", "__part")

    delta = F.col("high") - F.col("low")
    met = ranked(left, "high").join(ranked(right, "low"), [batch, "rank"])
    return met.select(batch, "rank", _smooth(beta * delta, smoothing).alias("loss"))


def composite_loss(loss: Column, nll: Column | None = None, nll_weight: float = 1.0, policy_weight: Column | None = None,
                   aux: Column | None = None, aux_weight: float = 0.0) -> Column:
    """Loss + weighted likelihood term, times the policy weight (at most 1), + weighted extra term."""
    out = loss if nll is None else loss + nll_weight * nll
    if policy_weight is not None:
        out = out * F.least(policy_weight, F.lit(1.0))
    return out if aux is None else out + aux_weight * aux


def policy_weight(adjusted_chosen: Column, adjusted_rejected: Column) -> Column:
    """exp of both sides' mean adjusted log-probability, at most 1."""
    return F.least(F.exp(adjusted_chosen + adjusted_rejected), F.lit(1.0))


def logged_means(metrics: DataFrame) -> DataFrame:
    """Mean of every logged metric per phase."""
    return metrics.groupBy("phase", "metric").agg(F.avg("value").alias("value"))
