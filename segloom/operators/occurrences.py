"""Counts of segmentations in which each occurrence of a word draws for itself.

Occurrences never become rows: a word goes to a task with its number of occurrences, in blocks, and
an Arrow kernel draws for all occurrences of a chunk at once. A task gives counts, not segments; the
counts of all tasks are added. Draws depend on the word, the number of the occurrence, seed and epoch,
so neither blocks nor partitions nor retries change them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.draws import key_bits, key_draw, occurrence_keys, word_keys
from segloom.operators.counts import BOUNDARY
from segloom.operators.model import Model, Settings

#: Occurrences of a word in a row at most.
BLOCK = 1 << 14
#: Words of more letters are long.
LONG = 100
#: Tasks for each core.
TASKS = 4
#: Characters of the occurrences that a kernel handles at once.
CHUNK = 1 << 15
#: Occurrences of long words at once.
LEAST = 64
#: Different counts that a kernel holds before it hands them on.
HELD = 1_000_000

COUNTS = "morph string, state int, to_state int, freq bigint"
_PA_COUNTS = pa.schema([("morph", pa.string()), ("state", pa.int32()), ("to_state", pa.int32()), ("freq", pa.int64())])


def blocks(words: DataFrame, whole: bool = False) -> DataFrame:
    """``word``, ``first``, ``n``: runs of at most BLOCK occurrences or ``whole`` words, spread over the tasks of a shuffle.

    The number of tasks follows the cores, as the rows are too small to tell the work behind them.
    """
    spark = words.sparkSession
    runs = F.lit(0).cast("bigint") if whole else F.explode(F.expr(f"sequence(0L, (n - 1) div {BLOCK})"))
    several = words.where("word <> '' AND n > 0").select("word", "n", runs.alias("_block"))
    first = F.col("_block") * BLOCK
    rows = several.select("word", first.alias("first"), (F.col("n") if whole else F.least(F.lit(BLOCK), F.col("n") - first)).alias("n"))
    tasks = TASKS * spark.sparkContext.defaultParallelism
    # Long words take as many steps for one as for many, so they go to few tasks.
    long = F.pmod(F.xxhash64("word", "first"), F.lit(max(1, tasks // 8)))
    key = F.when(F.length("word") > LONG, long).otherwise(F.xxhash64("word", "first"))
    return rows.repartition(tasks, key)


class Counts:
    """Emissions and steps of paths over words of one length, counted."""

    def __init__(self, num_state: int) -> None:
        self.num_state = num_state
        self.morphs: Counter[tuple[str, int]] = Counter()
        self.steps = np.zeros((num_state, num_state), np.int64)

    def add(
        self, texts: list[str], word: np.ndarray, begin: np.ndarray, end: np.ndarray, state: np.ndarray,
        weight: np.ndarray | None = None, prefix: str = "",
    ) -> None:
        """Emissions of ``texts[word][begin:end]`` by ``state``; ``prefix`` goes before a word's first morph."""
        size, n = len(texts[0]) + 1, self.num_state
        code = ((word * size + begin) * size + end) * n + state
        if weight is None:
            found, many = np.unique(code, return_counts=True)
        else:
            found, place = np.unique(code, return_inverse=True)
            many = np.zeros(len(found), np.int64)
            np.add.at(many, place, weight)
        rest, s = np.divmod(found, n)
        rest, e = np.divmod(rest, size)
        w, b = np.divmod(rest, size)
        for i, j, k, t, c in zip(w.tolist(), b.tolist(), e.tolist(), s.tolist(), many.tolist(), strict=True):
            self.morphs[(texts[i][j:k] if j else prefix + texts[i][:k], t)] += c

    def step(self, before: np.ndarray, after: np.ndarray, weight: np.ndarray | None = None) -> None:
        steps = self.steps.reshape(-1)
        if weight is None:
            steps += np.bincount(before * self.num_state + after, minlength=len(steps))
        else:
            np.add.at(steps, before * self.num_state + after, weight)

    def batch(self) -> pa.RecordBatch:
        """What was counted, as rows; the counts begin again."""
        at = np.argwhere(self.steps)
        morphs = [m for m, _ in self.morphs] + [None] * len(at)
        states = [s for _, s in self.morphs] + at[:, 0].tolist()
        after = [None] * len(self.morphs) + at[:, 1].tolist()
        freq = [*self.morphs.values(), *self.steps[at[:, 0], at[:, 1]].tolist()]
        self.__init__(self.num_state)
        return pa.RecordBatch.from_arrays(
            [pa.array(x, t) for x, t in zip((morphs, states, after, freq), _PA_COUNTS.types, strict=True)],
            schema=_PA_COUNTS,
        )


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """Words of one length, with the first number and the number of their occurrences."""
    words = batch.column("word").to_pylist()
    first, many = batch.column("first").to_numpy(), batch.column("n").to_numpy()
    lengths = np.array([len(w) for w in words])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        yield [words[i] for i in at], first[at], many[at]


def chunks(
    first: np.ndarray, many: np.ndarray, sizes: np.ndarray, chars: int = CHUNK
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The word's place and the number of each occurrence, so many at once that they have about ``chars`` characters.

    ``sizes``: of the words, from the longest. Of long words there are LEAST occurrences at once.
    """
    ends, at = np.cumsum(many), 0
    while at < ends[-1]:
        most = max(LEAST, chars // int(sizes[np.searchsorted(ends, at, "right")]))
        number = np.arange(at, min(at + most, int(ends[-1])))
        which = np.searchsorted(ends, number, "right")
        yield which, first[which] + number - (ends - many)[which]
        at += most


def satisfiable(settings: Settings, size: int) -> bool:
    """Whether random states of a word of ``size`` letters can be allowed at all."""
    s = settings
    allowed = np.ones((s.num_state, s.num_state), bool)
    for a, b in s.forbidden:
        if 0 <= a < s.num_state and 0 <= b < s.num_state:
            allowed[a, b] = False
    number = np.arange(s.num_state)
    prefix = (number >= 1) & (number <= s.num_prefix)
    suffix = (number >= s.num_state - s.num_suffix - 1) & (number <= s.num_state - 2)
    stem = (number > s.num_prefix) & (number < s.num_state - s.num_suffix - 1)
    before = [number == 0]
    for _ in range(s.num_prefix):
        before.append((before[-1] @ allowed) & prefix)
    for p, reached in enumerate(before):
        for stems in range(size + 1):
            if stems:
                reached = (reached @ allowed) & stem
            end = reached
            for q in range(s.num_suffix + 1):
                if q:
                    end = (end @ allowed) & suffix
                # Without stems affixes may be more than the pieces, but not fewer than two.
                fits = 2 <= p + stems + q <= size if stems else p + q >= 2
                if fits and (end @ allowed)[-1]:
                    return True
    return False


def _random_chunk(
    texts: list[str], which: np.ndarray, keys: np.ndarray, settings: Settings, allowed: np.ndarray, counts: Counts
) -> None:
    """Random segments of one chunk, as ``random_segments`` has them; those with a forbidden step are drawn again."""
    size, n, prefixes, suffixes = len(texts[0]), settings.num_state, settings.num_prefix, settings.num_suffix
    stems, boundary = n - prefixes - suffixes - 2, BOUNDARY if settings.has_word_boundary else ""
    if size == 1:
        state = np.floor(key_draw(keys, 0) * stems).astype(np.int64) + prefixes + 1
        nothing = np.zeros_like(which)
        counts.add(texts, which, nothing, nothing + 1, state, prefix=boundary)
        counts.step(nothing, state)
        counts.step(state, nothing + n - 1)
        return
    width = max(size, prefixes + suffixes)
    columns = np.arange(width)
    # Slots of an attempt: number of cuts, of prefixes, of suffixes, the places, the states.
    slots, attempt = 3 + size - 1 + width, 0
    left = np.arange(len(which))
    while len(left):
        key, base = keys[left][:, None], attempt * slots
        u = key_draw(key, base + np.arange(3))
        many = np.floor(u[:, 0] * (size - 1)).astype(np.int64) + 1
        before = np.floor(u[:, 1] * (prefixes + 1)).astype(np.int64)
        after = np.floor(u[:, 2] * (suffixes + 1)).astype(np.int64)
        place = key_bits(key, base + 3 + np.arange(size - 1))
        cut = place <= np.take_along_axis(np.sort(place, axis=1), many[:, None] - 1, axis=1)
        pieces = cut.sum(axis=1) + 1
        total = np.maximum(pieces, before + after)
        is_prefix = columns < before[:, None]
        is_suffix = columns >= (total - after)[:, None]
        kinds = np.where(is_prefix, prefixes, np.where(is_suffix, suffixes, stems))
        least = np.where(is_prefix, 1, np.where(is_suffix, n - suffixes - 1, prefixes + 1))
        state = np.floor(key_draw(key, base + 2 + size + columns) * kinds).astype(np.int64) + least
        path = np.concatenate([np.zeros((len(left), 1), np.int64), state], axis=1)
        if settings.forbidden:
            inside = allowed[path[:, :-1], path[:, 1:]] | (columns >= total[:, None])
            good = inside.all(axis=1) & allowed[path[np.arange(len(left)), total], n - 1]
        else:
            good = np.ones(len(left), bool)
        row = np.flatnonzero(good)
        cut, path, pieces, word = cut[row], path[row], pieces[row], which[left[row]]
        # Ends of pieces by row and place; a piece begins where the one before it ended.
        ends = np.concatenate([cut, np.ones((len(row), 1), bool)], axis=1)
        at, end = np.nonzero(ends)
        head = np.append(True, at[1:] != at[:-1])[: len(at)]
        begin = np.where(head, 0, np.roll(end + 1, 1))
        piece = np.cumsum(ends, axis=1)[at, end]
        counts.add(texts, word[at], begin, end + 1, path[at, piece], prefix=boundary)
        counts.step(path[at, piece - 1], path[at, piece])
        counts.step(path[np.arange(len(row)), pieces], np.full(len(row), n - 1))
        left, attempt = left[~good], attempt + 1


def random_counts(
    words: DataFrame, settings: Settings, seed: int = 0, epoch: int = 0, fraction: float | None = None,
    chance_epoch: int = 0,
) -> DataFrame:
    """Counts of random segments of ``word``, ``n``: a row of COUNTS is an emission or, without morph, a step.

    Segments are those of ``random_segments``, but each occurrence draws for itself, and states are
    drawn until all their steps are allowed. It is an error if no states can be. With a ``fraction``,
    only the occurrences drawn for it at ``chance_epoch`` count. Rows of several tasks are to be added.
    """
    allowed = np.ones((settings.num_state, settings.num_state), bool)
    for a, b in settings.forbidden:
        if 0 <= a < settings.num_state and 0 <= b < settings.num_state:
            allowed[a, b] = False

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = Counts(settings.num_state)
        for batch in batches:
            for texts, first, many in by_length(batch):
                size = len(texts[0])
                if size > 1 and settings.forbidden and not satisfiable(settings, size):
                    raise ValueError(f"transition control allows no states for words of {size} letters")
                keys = word_keys(seed, "segment", epoch, texts)
                chances = word_keys(seed, "random", chance_epoch, texts)
                for which, number in chunks(first, many, np.full(len(texts), size)):
                    if fraction is not None:
                        mine = key_draw(occurrence_keys(chances, which, number), 0) < fraction
                        which, number = which[mine], number[mine]
                    if len(which):
                        _random_chunk(texts, which, occurrence_keys(keys, which, number), settings, allowed, counts)
                    if len(counts.morphs) > HELD:
                        yield counts.batch()
        yield counts.batch()

    return blocks(words).mapInArrow(kernel, COUNTS)


def model_of(counted: DataFrame, settings: Settings, **more) -> Model:
    """The model of added rows of COUNTS; states and steps are few and are collected."""
    n, freq = settings.num_state, {}
    for r in transitions_of(counted).collect():
        freq[r.from_state, r.to_state] = r.freq
    steps = [(a, b, freq.get((a, b), 0)) for a in range(n) for b in range(n)]
    # The start counts once a word, other states as often as a step leads there.
    states = [(s, sum(v for (a, b), v in freq.items() if (b if s else a) == s)) for s in range(n)]
    spark = counted.sparkSession
    return Model(
        settings,
        counted.where("morph IS NOT NULL").select("morph", "state", "freq"),
        spark.createDataFrame(states, "state int, freq bigint"),
        spark.createDataFrame(steps, "from_state int, to_state int, freq bigint"),
        **more,
    )


def added(counted: DataFrame) -> DataFrame:
    """Rows of COUNTS of several tasks, added."""
    return counted.groupBy("morph", "state", "to_state").agg(F.sum("freq").alias("freq"))


def transitions_of(counted: DataFrame) -> DataFrame:
    """``from_state``, ``to_state``, ``freq`` of the steps that occur, from rows of COUNTS."""
    steps = counted.where("morph IS NULL").select(F.col("state").alias("from_state"), "to_state", "freq")
    return steps.groupBy("from_state", "to_state").agg(F.sum("freq").alias("freq"))
