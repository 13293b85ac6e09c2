"""First segmentations, by rule or at random."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.draws import below, draw
from segloom.operators.counts import BOUNDARY

#: Attempts to find states whose steps are all allowed.
ATTEMPTS = 64


def chunk_segment(word: Column, size: int = 3, boundary: bool = False) -> Column:
    """Chunks of ``size`` characters from the left, for a model of 5 states.

    The first one is a prefix (1) if the word has more than two chunks' length, the last of several
    a suffix (3), others are stems (2).
    """
    n = F.length(word)
    last = F.floor((n - 1) / size).cast("int")
    chunks = F.sequence(F.lit(0), F.greatest(last, F.lit(0)))

    def piece(i: Column) -> Column:
        state = F.when((i == 0) & (n > 2 * size), 1).when((i > 0) & (i == last), 3).otherwise(2)
        return F.struct(_bounded(F.substr(word, i * size + 1, F.lit(size)), i, boundary), state.alias("state"))

    return F.when(n > 0, F.transform(chunks, piece))


def _bounded(morph: Column, i: Column, boundary: bool) -> Column:
    return (F.when(i == 0, F.concat(F.lit(BOUNDARY), morph)).otherwise(morph) if boundary else morph).alias("morph")


def chunk_segments(words: DataFrame, size: int = 3, boundary: bool = False) -> DataFrame:
    """Words with ``segment`` by chunks and ``cost`` 0."""
    return words.where(F.length("word") > 0).withColumns(
        {"segment": chunk_segment(F.col("word"), size, boundary), "cost": F.lit(0.0)}
    )


def random_segments(
    words: DataFrame,
    num_state: int,
    num_prefix: int = 0,
    num_suffix: int = 0,
    forbidden: list[tuple[int, int]] | None = None,
    boundary: bool = False,
    seed: int = 0,
    epoch: int = 0,
    key: str = "word",
    attempts: int = ATTEMPTS,
) -> DataFrame:
    """Words with a random ``segment`` and ``cost`` 0.

    A word of several letters is cut at one place at least: the number of cuts is uniform, and so
    are their places. Up to ``num_prefix`` prefixes and ``num_suffix`` suffixes, stems between them,
    each with a uniform state, are laid over the pieces in order; what goes beyond the pieces is
    left out. States with a forbidden step, start and end included, are drawn again, ``attempts``
    times at most; then it is an error. A single letter gets a stem and isn't checked.

    Draws are by ``key``, so equal keys get equal segments: give occurrences their own keys, or
    count words first. Empty and null words are dropped.
    """
    w = F.col("word")
    n = F.length(w)
    stems = num_state - num_prefix - num_suffix - 2

    def u(what: str, attempt: Column, *more: Column | int) -> Column:
        return draw(seed, what, epoch, F.col(key), attempt, *more)

    def cuts(attempt: Column) -> Column:
        many = below(u("cuts", attempt), n - 1) + 1
        places = F.transform(
            F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))),
            lambda p: F.struct(u("cut", attempt, p).alias("u"), p.alias("p")),
        )
        chosen = F.transform(F.slice(F.array_sort(places), F.lit(1), many), lambda x: x["p"])
        return F.concat(F.array(F.lit(0)), F.array_sort(chosen), F.array(n))

    def several(what: str, attempt: Column, most: int, first: int, kinds: int, count: Column | None = None) -> Column:
        if not most or not kinds:
            return F.array().cast("array<int>")
        many = below(u(f"{what}s", attempt), most + 1) if count is None else count
        every = F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(most), many)),
            lambda i: (below(u(what, attempt, i), kinds) + first).cast("int"),
        )
        return F.slice(every, F.lit(1), F.greatest(many, F.lit(0)))

    def states(attempt: Column, pieces: Column) -> Column:
        before = several("prefix", attempt, num_prefix, 1, num_prefix)
        after = several("suffix", attempt, num_suffix, num_state - num_suffix - 1, num_suffix)
        left = (pieces - F.size(before) - F.size(after)).cast("int")
        return F.concat(before, several("stem", attempt, 1, num_prefix + 1, stems, left), after)

    attempt: Column = F.lit(0)
    if forbidden:
        bad = F.array(*[F.lit(a * num_state + b) for a, b in sorted(set(forbidden))])

        def allowed(a: Column) -> Column:
            path = F.concat(F.array(F.lit(0)), states(a, F.size(cuts(a)) - 1), F.array(F.lit(num_state - 1)))
            steps = F.transform(
                F.sequence(F.lit(1), F.size(path) - 1),
                lambda i: F.element_at(path, i) * num_state + F.element_at(path, i + 1),
            )
            return ~F.arrays_overlap(steps, bad)

        tried = F.filter(F.sequence(F.lit(0), F.lit(attempts - 1)), allowed)
        attempt = F.coalesce(
            F.get(tried, F.lit(0)),
            F.raise_error(F.lit("no allowed states found; is transition control satisfiable?")).cast("int"),
        )
    drawn = words.where(n > 0).withColumn("_attempt", F.when(n > 1, attempt))
    drawn = drawn.withColumn("_cuts", cuts(F.col("_attempt")))
    drawn = drawn.withColumn("_states", states(F.col("_attempt"), F.size("_cuts") - 1))
    count = F.least(F.size("_states"), F.size("_cuts") - 1)
    many = F.transform(
        F.sequence(F.lit(1), count),
        lambda i: F.struct(
            _bounded(
                F.substr(w, F.element_at("_cuts", i) + 1, F.element_at("_cuts", i + 1) - F.element_at("_cuts", i)),
                i - 1, boundary,
            ),
            F.element_at("_states", i).alias("state"),
        ),
    )
    single = F.array(
        F.struct(
            _bounded(w, F.lit(0), boundary),
            (below(u("stem", F.lit(0), F.lit(1)), stems) + num_prefix + 1).cast("int").alias("state"),
        )
    )
    return drawn.withColumns({"segment": F.when(n > 1, many).otherwise(single), "cost": F.lit(0.0)}).drop(
        "_attempt", "_cuts", "_states"
    )
