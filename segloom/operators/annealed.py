"""Counts of searched segmentations, in which each occurrence of a word draws for itself above T = 0.

The search is that of ``lattice``, for training: costs and ties are the same, and so are the best T
percent of a cell's candidates. It goes over all occurrences of a chunk at once, gives counts instead
of segments, and looks morphs up in a tree of characters, which is far smaller than a dictionary.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.draws import key_draw, occurrence_keys, word_keys
from segloom.operators.costs import MORPH_SIZE, PRIOR, UNSEEN
from segloom.operators.counts import BOUNDARY
from segloom.operators.lattice import CostTables, with_edges
from segloom.operators.model import Model
from segloom.operators.occurrences import COUNTS, HELD, Counts, blocks, chunks

#: A lexicon of more entries is joined, not broadcast. An entry takes some 50 bytes in a worker, more with many states.
SHARED_ENTRIES = 1_500_000
#: Characters of the occurrences that are searched at once.
CHUNK = 1 << 15
#: Characters of the words that a kernel prepares at once.
HELD_CHARS = 1 << 17
#: Cells from which on they are sorted by a network.
FEW = 256
#: Instead of an infinite cost, where costs are sorted.
FAR = 1e300


@dataclass
class Lookup:
    """Known morphs as a tree: at each depth, the sorted (parent, character) of its nodes, and what they hold by state."""

    keys: list[np.ndarray]
    cost: list[np.ndarray]
    gone: list[np.ndarray]

    @classmethod
    def of_rows(cls, tables: CostTables, rows: pa.RecordBatch | pa.Table) -> Lookup:
        state, freq, gone = (rows.column(x).to_numpy() for x in ("state", "freq", "gone"))
        return cls.of(tables, rows.column("morph").to_pylist(), state, freq, gone)

    @classmethod
    def of(cls, tables: CostTables, morphs: list[str], state: np.ndarray, freq: np.ndarray, gone: np.ndarray) -> Lookup:
        """From entries of the lexicon of MORPH_SIZE characters at most; cost is NaN where a state doesn't have the morph."""
        out = cls([], [], [])
        lengths = np.fromiter(map(len, morphs), np.int64, len(morphs))
        chars = np.array(morphs, f"<U{MORPH_SIZE}").view(np.uint32).reshape(len(morphs), MORPH_SIZE).astype(np.int64)
        known = -np.log2((freq + PRIOR) / (tables.freq[state] + tables.types[state] * PRIOR))
        node, inner = np.zeros(len(morphs), np.int64), tables.num_state - 2
        for depth in range(MORPH_SIZE):
            row = np.flatnonzero(lengths > depth)
            keys, node[row] = np.unique(node[row] << 21 | chars[row, depth], return_inverse=True)
            cost, dropped = np.full((len(keys), inner), np.nan), np.zeros((len(keys), inner), bool)
            here = np.flatnonzero(lengths == depth + 1)
            cost[node[here], state[here] - 1] = known[here]
            dropped[node[here], state[here] - 1] = gone[here]
            out.keys.append(keys)
            out.cost.append(cost)
            out.gone.append(dropped)
        return out

    def down(self, depth: int, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Nodes one character further, -1 where there is none."""
        keys = self.keys[depth]
        if not len(keys):
            return np.full_like(node, -1)
        wanted = node << 21 | char
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where((node >= 0) & (keys[at] == wanted), at, -1)


class NewCosts:
    """Parts of what a morph costs in states that don't have it, by character and length."""

    def __init__(self, tables: CostTables) -> None:
        t, inner = tables, slice(1, tables.num_state - 1)
        self.boundary = t.boundary
        self.codes = np.array(sorted(map(ord, t.charset)), np.int64)
        counts = np.full((len(self.codes), t.num_state), float(UNSEEN))
        place = {c: i for i, c in enumerate(self.codes.tolist())}
        for ch, by_state in t.char_count.items():
            for s, many in by_state.items():
                counts[place[ord(ch)], s] = many
        more = np.arange(MORPH_SIZE + 1, dtype=float)
        # What one more of a character takes, if so many are there already.
        self.taken = np.log2(counts[:, None, inner] + PRIOR + more[None, :, None])
        self.base = -np.log2(PRIOR / (t.freq[inner] + (t.types[inner] + 1) * PRIOR))
        size = t.char_size[inner] + (len(self.codes) + 1) * PRIOR
        self.added = np.cumsum(np.log2(size[None] + more[:, None]), axis=0)
        self.type = np.log2(t.types[inner] + PRIOR)


def begins(end: int, boundary: bool) -> np.ndarray:
    """Where morphs that end at a place may begin; a boundary is no morph of its own."""
    if boundary and end == 1:
        return np.zeros(0, np.int64)
    found = np.arange(max(0, end - MORPH_SIZE), end)
    return found[found != 1] if boundary else found


@dataclass
class Emissions:
    """By length - 1 and by place, the texts laid one after the other: cost of the morph in each state, and whether it is de-registered."""

    offset: np.ndarray
    sizes: np.ndarray
    cost: np.ndarray
    gone: np.ndarray | None

    @classmethod
    def of(cls, texts: list[str], new: NewCosts, lookup: Lookup) -> Emissions:
        sizes = np.array([len(x) for x in texts])
        offset = np.cumsum(sizes) - sizes
        chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        ids = np.minimum(np.searchsorted(new.codes, chars), max(0, len(new.codes) - 1))
        strange = (new.codes[ids] != chars) if len(new.codes) else np.ones(len(chars), bool)
        if new.boundary:
            strange[offset] = False
        if strange.any():
            text = texts[int(np.searchsorted(offset, np.argmax(strange), "right")) - 1]
            raise ValueError(f"{text!r} has characters that are not in the charset")
        cost = np.full((MORPH_SIZE, len(chars), len(new.base)), np.inf)
        gone = np.zeros(cost.shape, bool) if any(x.any() for x in lookup.gone) else None
        # A boundary at the start of a morph is no character of it.
        lead = (chars == ord(BOUNDARY)) & new.boundary
        row, ends = np.arange(len(chars)), np.repeat(offset + sizes, sizes)
        node, taken = np.zeros(len(chars), np.int64), 0.0
        for d in range(MORPH_SIZE):
            fits = np.flatnonzero(row + d < ends[row])
            row, node = row[fits], node[fits]
            c = ids[row + d]
            if not d:
                taken = np.where(lead[row][:, None], 0.0, new.taken[c, 0])
            else:
                before = sum((ids[row + j] == c).astype(np.int64) for j in range(d)) - (lead[row] & (ids[row] == c))
                taken = taken[fits] + new.taken[c, before]
            found = new.base + (new.added[d + 1 - lead[row]] - (taken + new.type))
            node = lookup.down(d, node, chars[row + d])
            hit = np.flatnonzero(node >= 0)
            known = lookup.cost[d][node[hit]]
            found[hit] = np.where(np.isnan(known), found[hit], known)
            cost[d, row] = found
            if gone is not None:
                gone[d, row[hit]] = lookup.gone[d][node[hit]]
        return cls(offset, sizes, cost, gone)


@lru_cache(maxsize=None)
def network(size: int, first: int) -> list[tuple[int, int]]:
    """Pairs to put in order, one after the other, so that the ``first`` least of ``size`` are sorted (Batcher)."""
    pairs, p = [], 1
    while p < size:
        k = p
        while k:
            for j in range(k % p, size - k, 2 * k):
                for i in range(j, j + min(k, size - j - k)):
                    if i // (2 * p) == (i + k) // (2 * p):
                        pairs.append((i, i + k))
            k //= 2
        p *= 2
    needed, kept = set(range(first)), []
    for a, b in reversed(pairs):
        if a in needed or b in needed:
            needed |= {a, b}
            kept.append((a, b))
    return kept[::-1]


def pick(ways: np.ndarray, cells: int, temperature: float, finite: bool, draws) -> tuple[np.ndarray, np.ndarray]:
    """Index and cost of the candidate that each cell takes; candidates come first in ``ways``, none of them infinite if ``finite``.

    Costs that agree in 45 bits count as ties, as their last bits hold the index while they are sorted.
    """
    size = len(ways)
    window = int(max(min(temperature / 100 * cells, cells), 1))
    if temperature <= 0 or window == 1 or size == 1:
        best = ways.argmin(axis=0)
        return best, np.take_along_axis(ways, best[None], axis=0)[0]
    window = min(window, size)
    bits = np.int64((1 << (size - 1).bit_length()) - 1)
    keys = (ways if finite else np.minimum(ways, FAR)).view(np.int64) & ~bits
    keys |= np.arange(size).reshape(-1, *[1] * (ways.ndim - 1))
    rows, spare = list(keys.view(np.float64)), np.empty(ways.shape[1:])
    # With few cells, the calls would take longer than the sort.
    for a, b in network(size, window) if spare.size > FEW else ():
        np.minimum(rows[a], rows[b], out=spare)
        np.maximum(rows[a], rows[b], out=rows[b])
        rows[a], spare = spare, rows[a]
    first = np.stack(rows[:window]) if spare.size > FEW else np.sort(keys.view(np.float64), axis=0)[:window]
    many = window if finite else np.maximum(1, (first < FAR / 2).sum(axis=0))
    chosen = np.floor(draws() * many).astype(np.int64)
    best = np.take_along_axis(first, chosen[None], axis=0)[0].view(np.int64) & bits
    return best, np.take_along_axis(ways, best[None], axis=0)[0]


def longest_first(batch: pa.RecordBatch, prefix: str) -> Iterator[tuple[list[str], list[str], np.ndarray, np.ndarray]]:
    """Words, texts, first numbers and numbers of occurrences, the longest words first, of about HELD_CHARS characters."""
    words = batch.column("word").to_pylist()
    first, many = batch.column("first").to_numpy(), batch.column("n").to_numpy()
    sizes = np.array([len(w) for w in words], np.int64)
    order = np.argsort(-sizes, kind="stable")
    part = np.cumsum(sizes[order]) // HELD_CHARS
    for at in np.split(order, np.flatnonzero(np.diff(part)) + 1):
        some = [words[i] for i in at]
        yield some, [prefix + w for w in some], first[at], many[at]


def _search_chunk(
    which: np.ndarray, keys: np.ndarray, tables: CostTables, emissions: Emissions, temperature: float
) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Pieces (occurrence, begin, end, state before, state) of the paths, the occurrences that count, and their last states.

    Occurrences come with the longest words first, so at each place those that go on are the first ones.
    """
    n, count, inner = tables.num_state, len(which), tables.num_state - 2
    step, last = tables.transition[:-1, 1:-1], tables.transition[1:-1, -1]
    finite = bool(np.isfinite(tables.transition[:-1, 1:]).all())
    sizes, offset = emissions.sizes[which], emissions.offset[which]
    one = which[0] == which[-1]
    longest = int(sizes[0])
    # Occurrences are the last axis, so that each step of numpy goes over many of them.
    cost = np.full((longest + 1, inner, count), np.inf)
    taken = np.zeros((longest + 1, inner, count), np.int16)

    def draws(slots: np.ndarray, rows: int):
        return lambda: key_draw(keys[:rows], slots)

    for e in range(1, longest + 1):
        bs = begins(e, tables.boundary)
        if not len(bs):
            continue
        rows = int(np.searchsorted(-sizes, -e, "right"))
        # All occurrences of one word have the same emissions.
        emitted = emissions.cost[(e - 1 - bs)[:, None], offset[None, : 1 if one else rows] + bs[:, None]]
        emitted = np.ascontiguousarray(emitted.transpose(0, 2, 1))
        # Candidates in the order of previous state, then previous place; only the start has state 0.
        zero = int(bs[0] == 0)
        later = bs[zero:]
        ways = np.empty((zero + inner * len(later), inner, rows))
        if zero:
            ways[0] = step[0][:, None] + emitted[0]
        if len(later):
            before = cost[later, :, :rows].transpose(1, 0, 2)[:, :, None]
            part = ways[zero:].reshape(inner, len(later), inner, rows)
            np.add(before, step[1:, None, :, None], out=part)
            part += emitted[zero:]
        slots = (e * n + np.arange(1, n - 1))[:, None]
        taken[e, :, :rows], cost[e, :, :rows] = pick(ways, (n - 1) * len(bs), temperature, finite, draws(slots, rows))
    every = np.arange(count)
    ends = np.ascontiguousarray((cost[sizes, :, every] + last).T)
    best, value = pick(ends, inner, temperature, finite, draws((sizes + 1) * n + n - 1, count))
    good = np.isfinite(value) & (value > 0)
    final = best + 1
    state, place = final.copy(), sizes.copy()
    pieces = []
    for e in range(longest, 0, -1):
        row = np.flatnonzero(good & (place == e))
        if not len(row):
            continue
        bs, s = begins(e, tables.boundary), state[row]
        i, zero = taken[e][s - 1, row].astype(np.int64), int(bs[0] == 0)
        later = bs[zero:] if len(bs) > zero else bs
        start = (i == 0) & bool(zero)
        p, k = np.divmod(np.maximum(i - zero, 0), len(later))
        begin, before = np.where(start, 0, later[k]), np.where(start, 0, p + 1)
        pieces.append((row, begin, np.full(len(row), e), before, s))
        state[row], place[row] = before, begin
    whole = [np.concatenate(x) for x in zip(*pieces, strict=True)] if pieces else [np.zeros(0, np.int64)] * 5
    if emissions.gone is not None:
        row, begin, end, _, s = whole
        good[row[emissions.gone[end - begin - 1, offset[row] + begin, s - 1]]] = False
    keep = good[whole[0]]
    return [x[keep] for x in whole], good, final


def annealed_counts(
    words: DataFrame,
    model: Model,
    temperature: float = 0.0,
    fraction: float = 0.0,
    seed: int = 0,
    epoch: int = 0,
    deregistered: DataFrame | None = None,
    shared_entries: int = SHARED_ENTRIES,
) -> DataFrame:
    """Counts of the search of ``word``, ``n`` when training, without the occurrences drawn for the ``fraction``.

    As in a training step, what has no path, a cost of 0 or less or a de-registered pair counts for
    nothing; that is decided for each occurrence. At T = 0 without a fraction, a word is searched once.
    """
    tables, spark = CostTables.of(model, True), words.sparkSession
    once = temperature <= 0 and fraction <= 0
    lexicon = model.lexicon.where(F.length("morph").between(1, MORPH_SIZE))
    if deregistered is None:
        lexicon = lexicon.select("morph", "state", "freq", F.lit(False).alias("gone"))
    else:
        drawn = deregistered.select("morph", "state", F.lit(True).alias("gone")).distinct()
        lexicon = lexicon.join(drawn, ["morph", "state"], "left").select(
            "morph", "state", "freq", F.coalesce("gone", F.lit(False)).alias("gone")
        )

    rows = blocks(words, once)
    joined = model.lexicon.count() > shared_entries
    if joined:
        rows = with_edges(rows, model, lexicon)
    shared = spark.sparkContext.broadcast((tables, None if joined else Lookup.of_rows(tables, lexicon.toArrow())))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lookup = shared.value
        counts, new = Counts(tables.num_state), NewCosts(tables)
        prefix = BOUNDARY if tables.boundary else ""
        for batch in batches:
            if joined:
                edges = pa.Table.from_struct_array(batch.column("_edges").flatten())
                lookup = Lookup.of_rows(tables, edges)
            for some, texts, first, many in longest_first(batch, prefix):
                emissions = Emissions.of(texts, new, lookup)
                keys = word_keys(seed, "cell", epoch, some)
                chances = word_keys(seed, "random", epoch, some)
                for which, number in chunks(first, np.ones_like(many) if once else many, emissions.sizes, CHUNK):
                    if fraction > 0:
                        mine = key_draw(occurrence_keys(chances, which, number), 0) >= fraction
                        which, number = which[mine], number[mine]
                    if not len(which):
                        continue
                    (row, begin, end, before, state), good, final = _search_chunk(
                        which, occurrence_keys(keys, which, number), tables, emissions, temperature
                    )
                    weight = many[which] if once else None
                    counts.add(texts, which[row], begin, end, state, weight[row] if once else None)
                    counts.step(before, state, weight[row] if once else None)
                    ended = np.full(int(good.sum()), tables.num_state - 1)
                    counts.step(final[good], ended, weight[good] if once else None)
                if len(counts.morphs) > HELD:
                    yield counts.batch()
        yield counts.batch()

    return rows.mapInArrow(kernel, COUNTS)
