"""Schedules of training, and random de-registration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions.draws import draw

SCHEDULES = ("concave", "convex", "linear")
#: Random segmentation ends after this share of the epochs.
RANDOM_SHARE = 0.95


def temperature(previous: float, final: float, alpha: float) -> float:
    """The temperature of the next epoch."""
    return max(final, previous * alpha)


def epoch_cap(init: float, final: float, alpha: float, max_iteration: int) -> int:
    """How many epochs there are at most: until the final temperature, or ``max_iteration``."""
    if min(init, final, alpha) <= 0 or alpha == 1:
        return max_iteration
    return max(0, min(math.ceil((math.log2(final) - math.log2(init)) / math.log2(alpha)), max_iteration))


def random_fraction(epoch: int, epochs: int, schedule: str = "concave") -> float:
    """The share of words that is segmented at random."""
    end = RANDOM_SHARE * epochs
    if not epoch or epoch >= end:
        return 0.0
    shares = {
        "concave": lambda: math.sqrt(1 - (epoch / end) ** 2),
        "convex": lambda: 1 / (RANDOM_SHARE * epoch + 1),
        "linear": lambda: 1 - epoch / end,
    }
    return min(1.0, max(0.0, shares[schedule]())) / 2


def dereg_chance(epoch: int, epochs: int) -> float:
    """The chance of a de-registration after this epoch."""
    return (math.exp(3 * epoch / epochs) - 1) / (math.exp(3) - 1)


def dereg_due(
    epoch: int, epochs: int, u: float, bulk_prob: float, num_prefix: int, num_suffix: int, every: int = 0
) -> bool:
    """Whether one is due: by chance if there are affixes, and every so many epochs."""
    by_chance = u < dereg_chance(epoch, epochs) and bulk_prob > 0 and num_prefix + num_suffix > 0
    return by_chance or bool(every and epoch % every == 0)


def schedule_table(
    spark: SparkSession, init: float, final: float, alpha: float, max_iteration: int, schedule: str = "concave"
) -> DataFrame:
    """``epoch``, ``temperature``, ``random_fraction``, ``dereg_chance`` of each epoch."""
    n = epoch_cap(init, final, alpha, max_iteration)
    epoch = F.col("epoch").cast("double")
    end = RANDOM_SHARE * n
    shares: dict[str, Column] = {
        "concave": F.sqrt(F.greatest(1 - F.pow(epoch / end, F.lit(2.0)), F.lit(0.0))),
        "convex": 1 / (RANDOM_SHARE * epoch + 1),
        "linear": 1 - epoch / end,
    }
    share = F.least(F.greatest(shares[schedule], F.lit(0.0)), F.lit(1.0)) / 2
    return spark.range(n).select(
        F.col("id").alias("epoch")
    ).select(
        "epoch",
        F.greatest(F.lit(float(final)), F.lit(float(init)) * F.pow(F.lit(alpha), epoch + 1)).alias("temperature"),
        F.when((epoch == 0) | (epoch >= end), 0.0).otherwise(share).alias("random_fraction"),
        ((F.exp(3 * epoch / n) - 1) / (math.exp(3) - 1)).alias("dereg_chance"),
    )


def is_affix(state: Column, num_state: int, num_prefix: int, num_suffix: int) -> Column:
    """Whether a state is a prefix or suffix."""
    return (state <= num_prefix) | (state > num_state - num_suffix - 2)


def dereg_candidates(
    lex: DataFrame, num_state: int, num_prefix: int, num_suffix: int, affix_lbound: int = 60, stem_ubound: int = 150
) -> DataFrame:
    """Entries that may be de-registered: rare affixes and frequent stems."""
    affix = is_affix(F.col("state"), num_state, num_prefix, num_suffix)
    return lex.where((affix & (F.col("freq") < affix_lbound)) | (~affix & (F.col("freq") > stem_ubound)))


def dereg_drawn(candidates: DataFrame, bulk_prob: float = 0.15, seed: int = 0, epoch: int = 0) -> DataFrame:
    """``morph``, ``state`` of the candidates that are drawn, each with the given probability."""
    u = draw(seed, "dereg", epoch, F.col("morph"), F.col("state"))
    return candidates.where(u < bulk_prob).select("morph", "state")


class EarlyStop:
    """Tells when the loss has stayed the same for ``patience`` epochs, and when it improved."""

    def __init__(self, delta: float = 1e-6, patience: int = 10) -> None:
        self.delta, self.patience, self.last, self.count = delta, patience, -1.0, 0

    def step(self, loss: float) -> tuple[bool, bool]:
        """(stop, improved); only a loss that differs from the last becomes the last."""
        if abs(self.last - loss) < self.delta and loss:
            self.count += 1
            return self.count == self.patience, False
        improved = self.last > loss
        self.count, self.last = 0, loss
        return False, improved
