"""Search for the best segmentation of words.

A word is a lattice of substrings of up to MORPH_SIZE characters, each in any interior state. The
cost of a path is the sum of transition and emission costs; a cell (position, state) keeps its best
predecessor, ties going to the lower previous state, then to the lower previous position. At a
temperature T above 0 a cell takes any of the best T percent of its candidates, by a draw.

The search is an Arrow kernel which goes over all words of a batch at once, position by position.
Emission costs of the lexicon reach it in one of two ways: a lexicon of at most ``broadcast_entries``
entries is broadcast; a larger one is joined, by shuffles, with the distinct substrings of the words.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.draws import draw_value
from segloom.operators.costs import MORPH_SIZE, PRIOR, UNSEEN
from segloom.operators.counts import BOUNDARY, char_counts, lexicon_charset
from segloom.operators.model import Model

#: A lexicon of more entries isn't broadcast. An entry takes some 200 bytes in a Python worker.
BROADCAST_ENTRIES = 300_000
#: Words that a kernel searches at once.
BATCH = 2048

SEGMENT = "array<struct<morph:string,state:int>>"
_PA_SEGMENT = pa.list_(pa.struct([("morph", pa.string()), ("state", pa.int32())]))


@dataclass
class CostTables:
    """What the kernel knows of a model besides the lexicon: at most states times characters numbers."""

    num_state: int
    boundary: bool
    transition: np.ndarray
    freq: np.ndarray
    types: np.ndarray
    char_size: np.ndarray
    char_count: dict[str, dict[int, int]]
    charset: frozenset[str]
    training: bool

    @classmethod
    def of(cls, model: Model, training: bool = False) -> CostTables:
        """Collects states, steps and characters; none of these grows with the words."""
        n = model.settings.num_state
        freq, types, size = np.zeros(n), np.zeros(n), np.zeros(n)
        for r in model.state_freq.collect():
            freq[r.state] = r.freq
        for r in model.states().collect():
            types[r.state], size[r.state] = r.types, r.char_size
        transition = np.full((n, n), math.inf)
        for r in model.transition_freq.collect():
            if (r.from_state, r.to_state) not in model.settings.forbidden:
                share = (r.freq + PRIOR) / (freq[r.from_state] + (n - 2) * PRIOR)
                transition[r.from_state, r.to_state] = -math.log2(share)
        boundary = model.settings.has_word_boundary
        chars: dict[str, dict[int, int]] = {}
        for r in char_counts(model.lexicon, boundary).collect() if training else ():
            chars.setdefault(r.ch, {})[r.state] = r["count"]
        known = {r.ch for r in lexicon_charset(model.lexicon, boundary=boundary).collect()} | model.predefined
        return cls(n, boundary, transition, freq, types, size, chars, frozenset(known), training)

    def known(self, freq: int, state: int) -> float:
        """Cost of an entry of the lexicon."""
        return -math.log2((freq + PRIOR) / (self.freq[state] + self.types[state] * PRIOR))

    def new(self, morph: str, state: int) -> float:
        """Cost of a morph that the state doesn't have; infinite unless training."""
        if not self.training:
            return math.inf
        bare = morph[1:] if self.boundary and morph.startswith(BOUNDARY) else morph
        if not self.charset.issuperset(bare):
            raise ValueError(f"{morph!r} has characters that are not in the charset")

        def change(count: float, added: int) -> float:
            return sum(math.log2(count + i) for i in range(added))

        cost = -math.log2(PRIOR / (self.freq[state] + (self.types[state] + 1) * PRIOR))
        added = change(self.char_size[state] + (len(self.charset) + 1) * PRIOR, len(bare) + 1)
        taken = 0.0
        for c in dict.fromkeys(bare):
            taken += change(self.char_count.get(c, {}).get(state, UNSEEN) + PRIOR, bare.count(c))
        taken += math.log2(self.types[state] + PRIOR)
        return cost + (added - taken)


class Emissions(dict):
    """Rows of a cost matrix by morph: a column for each interior state. Row 0 is infinite."""

    def __init__(self, tables: CostTables, lexicon: dict[str, dict[int, int]]) -> None:
        self.tables, self.lexicon, self.used = tables, lexicon, 1
        self.matrix = np.full((1024, tables.num_state - 2), math.inf)

    def __missing__(self, morph: str) -> int:
        t, known = self.tables, self.lexicon.get(morph)
        if known is None and not t.training:
            return 0
        known = known or {}
        if self.used == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.full_like(self.matrix, math.inf)])
        self.matrix[self.used] = [
            t.known(known[s], s) if s in known else t.new(morph, s) for s in range(1, t.num_state - 1)
        ]
        self[morph] = self.used
        self.used += 1
        return self.used - 1


def _pick(candidates: np.ndarray, cells: int, temperature: float, draws) -> tuple[np.ndarray, np.ndarray]:
    """Index and cost of the candidate that each (word, state) takes; candidates: words, candidates, states."""
    if temperature <= 0 or int(max(min(temperature / 100 * cells, cells), 1)) == 1:
        best = candidates.argmin(axis=1)
    else:
        window = int(max(min(temperature / 100 * cells, cells), 1))
        order = candidates.argsort(axis=1, kind="stable")[:, :window]
        cost = np.take_along_axis(candidates, order, axis=1)
        finite = np.maximum(1, np.isfinite(cost).sum(axis=1))
        chosen = np.floor(draws() * finite).astype(np.int64)
        best = np.take_along_axis(order, chosen[:, None, :], axis=1)[:, 0]
    return best, np.take_along_axis(candidates, best[:, None, :], axis=1)[:, 0]


def search(
    words: list[str], emissions: Emissions, temperature: float = 0.0, seed: int = 0, epoch: int = 0,
    keys: list | None = None,
) -> list[tuple[list[tuple[str, int]], float]]:
    """Segment and cost of each word; an infinite cost and no segment if there is no path."""
    keys = words if keys is None else keys
    out: list = [([], math.inf)] * len(words)
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if w:
            by_length.setdefault(len(w), []).append(i)
    for places in by_length.values():
        for at in range(0, len(places), BATCH):
            some = places[at : at + BATCH]
            found = _search([words[i] for i in some], emissions, temperature, seed, epoch, [keys[i] for i in some])
            for i, result in zip(some, found, strict=True):
                out[i] = result
    return out


def _search(words: list[str], emissions: Emissions, temperature: float, seed: int, epoch: int, keys: list) -> list:
    t = emissions.tables
    n, count = t.num_state, len(words)
    inner = n - 2
    texts = [BOUNDARY + w for w in words] if t.boundary else words
    size = len(texts[0])
    starts = [b for b in range(size) if not t.boundary or b == 0 or b > 1]
    spans = {e: [b for b in starts if e - MORPH_SIZE <= b < e] for e in range(1 + t.boundary, size + 1)}
    index = {
        (b, e): np.fromiter((emissions[x[b:e]] for x in texts), np.int64, count) for e, bs in spans.items() for b in bs
    }
    matrix = emissions.matrix
    cost = np.full((size + 1, count, n - 1), math.inf)
    cost[0, :, 0] = 0.0
    step, last = t.transition[:-1, 1:-1], t.transition[1:-1, -1]
    from_state = np.zeros((size + 1, count, inner), np.int64)
    from_place = np.zeros((size + 1, count, inner), np.int64)

    def draws(position: int, states: Iterable[int]):
        return lambda: np.array([[draw_value(seed, "cell", epoch, k, position, s) for s in states] for k in keys])

    for e, bs in spans.items():
        if not bs:
            continue
        # Candidates in the order of previous state, then previous position, for each word and state.
        ways = cost[bs].transpose(1, 2, 0)[:, :, :, None] + step[None, :, None, :]
        ways = ways + np.stack([matrix[index[b, e]] for b in bs], axis=1)[:, None]
        best, value = _pick(
            ways.reshape(count, -1, inner), (n - 1) * len(bs), temperature, draws(e, range(1, n - 1))
        )
        cost[e, :, 1:] = value
        from_state[e], from_place[e] = best // len(bs), np.array(bs)[best % len(bs)]
    ends = (cost[size][:, 1:] + last[None])[:, :, None]
    best, value = _pick(ends, inner, temperature, draws(size + 1, [n - 1]))
    results = []
    for k, text in enumerate(texts):
        if not math.isfinite(value[k, 0]):
            results.append(([], math.inf))
            continue
        path, s, e = [], int(best[k, 0]) + 1, size
        while e > 0:
            b = int(from_place[e, k, s - 1])
            path.append((text[b:e], s))
            s, e = int(from_state[e, k, s - 1]), b
        results.append((path[::-1], float(value[k, 0])))
    return results


def _lexicon_dict(rows: Iterable[tuple[str, int, int]]) -> dict[str, dict[int, int]]:
    out: dict[str, dict[int, int]] = {}
    for morph, state, freq in rows:
        out.setdefault(morph, {})[state] = freq
    return out


def _segment_array(found: list) -> pa.Array:
    return pa.array(
        [[{"morph": m, "state": s} for m, s in path] if path else None for path, _ in found], _PA_SEGMENT
    )


def _kernel(shared, temperature: float, seed: int, epoch: int, key: str, joined: bool):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, lexicon = shared.value
        emissions = Emissions(tables, lexicon)
        for batch in batches:
            if joined:
                edges = batch.column("_edges").to_pylist()
                emissions = Emissions(tables, _lexicon_dict((x["morph"], x["state"], x["freq"]) for e in edges for x in e))
            names = [n for n in batch.schema.names if n != "_edges"]
            words = batch.column("word").to_pylist()
            found = search([w or "" for w in words], emissions, temperature, seed, epoch, batch.column(key).to_pylist())
            costs = pa.array([c if p else None for p, c in found], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in names], _segment_array(found), costs], [*names, "segment", "cost"]
            )
            if len(emissions) > 2_000_000:
                emissions = Emissions(tables, lexicon)

    return kernel


def substrings(word: Column, boundary: bool = False) -> Column:
    """The distinct substrings of a word that a search looks up."""
    text = F.concat(F.lit(BOUNDARY), word) if boundary else word
    n = F.length(text)
    each = F.transform(
        F.sequence(F.lit(1), n),
        lambda e: F.transform(
            F.sequence(F.greatest(e - MORPH_SIZE, F.lit(0)), e - 1), lambda b: F.substr(text, b + 1, e - b)
        ),
    )
    return F.array_distinct(F.flatten(each))


def with_edges(words: DataFrame, model: Model, lexicon: DataFrame | None = None) -> DataFrame:
    """Words with the entries of the model's or another lexicon of their substrings, by shuffles; as many as substrings times states."""
    lexicon = model.lexicon if lexicon is None else lexicon
    each = words.select("word").where(F.length("word") > 0).distinct()
    parts = each.select("word", F.explode(substrings(F.col("word"), model.settings.has_word_boundary)).alias("morph"))
    edges = parts.join(lexicon, "morph").groupBy("word").agg(
        F.collect_list(F.struct(*lexicon.columns)).alias("_edges")
    )
    none = F.array().cast(edges.schema["_edges"].dataType)
    return words.join(edges, "word", "left").withColumn("_edges", F.coalesce("_edges", none))


def search_words(
    words: DataFrame,
    model: Model,
    training: bool = False,
    temperature: float = 0.0,
    seed: int = 0,
    epoch: int = 0,
    key: str = "word",
    broadcast_entries: int = BROADCAST_ENTRIES,
) -> DataFrame:
    """``words`` with ``segment`` and ``cost``, both null where there is no path.

    No shuffle if the lexicon is broadcast; equal words are searched as often as they come, so
    count them first at T = 0. Above T = 0 draws depend on ``key``. Null and empty words have no path.
    When training, an unknown character is an error.
    """
    tables = CostTables.of(model, training)
    spark = words.sparkSession
    size = model.lexicon.limit(broadcast_entries + 1).count()
    joined = size > broadcast_entries
    lexicon: dict = {}
    if joined:
        words = with_edges(words, model)
    else:
        lexicon = _lexicon_dict(tuple(r) for r in model.lexicon.select("morph", "state", "freq").collect())
    shared = spark.sparkContext.broadcast((tables, lexicon))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema if f.name != "_edges"]
    schema = ", ".join([*fields, f"segment {SEGMENT}", "cost double"])
    return words.mapInArrow(_kernel(shared, temperature, seed, epoch, key, joined), schema)


def in_charset(word: Column, chars: Iterable[str]) -> Column:
    """Whether all of a word's characters are known."""
    pieces = F.array(F.lit(""), *[F.lit(c) for c in sorted(chars)])
    return F.size(F.array_except(F.split(word, ""), pieces)) == 0


def segment(words: DataFrame, model: Model, strict: bool = False, **how) -> DataFrame:
    """``words`` with ``segment``, ``cost`` and ``oov``, at T = 0 and with known morphs only.

    Words of the model's cache have the segment that it holds, the others are searched. A word with
    a character that the model doesn't know is ``oov`` and has no segment; with ``strict`` it is an
    error. Each distinct word is searched once.
    """
    chars = {r.ch for r in lexicon_charset(model.lexicon, boundary=model.settings.has_word_boundary).collect()}
    chars |= model.predefined
    known = in_charset(F.col("word"), chars)
    if strict:
        known = F.when(known, True).otherwise(
            F.raise_error(F.concat(F.lit("characters not in charset: "), F.col("word"))).cast("boolean")
        )
    each = words.select("word").where("word IS NOT NULL").distinct().withColumn("oov", ~known)
    if model.cache is not None:
        # A known word may be in the cache although its morphs were pruned since.
        held = each.join(model.cache, "word", "left")
        hit = held.where("segment IS NOT NULL AND NOT oov")
        found = hit.unionByName(_searched(held.where("segment IS NULL OR oov").select("word", "oov"), model, how))
    else:
        found = _searched(each, model, how)
    if words.columns == ["word"]:
        return words.join(found, "word", "left").select("word", "segment", "cost", "oov")
    return words.join(found, "word", "left")


def _searched(words: DataFrame, model: Model, how: dict) -> DataFrame:
    found = search_words(words.where("NOT oov"), model, **how)
    none = words.where("oov").select(
        "word", "oov", F.lit(None).cast(SEGMENT).alias("segment"), F.lit(None).cast("double").alias("cost")
    )
    return found.unionByName(none)


def explain_lattice(word: str, model: Model, training: bool = False) -> DataFrame:
    """The cells of one word: ``position``, ``state``, ``cost`` of the best way there, at T = 0, finite ones only."""
    tables = CostTables.of(model, training)
    spark = model.lexicon.sparkSession
    pieces = [r.m for r in spark.createDataFrame([(word,)], "word string").select(
        F.explode(substrings(F.col("word"), tables.boundary)).alias("m")
    ).collect()]
    rows = model.lexicon.where(F.col("morph").isin(pieces)).select("morph", "state", "freq").collect()
    emissions = Emissions(tables, _lexicon_dict(tuple(r) for r in rows))
    text = BOUNDARY + word if tables.boundary else word
    cells: dict[tuple[int, int], float] = {(0, 0): 0.0}
    for e in range(1 + tables.boundary, len(text) + 1):
        for s in range(1, tables.num_state - 1):
            ways = [
                cells[b, p] + tables.transition[p, s] + emissions.matrix[emissions[text[b:e]], s - 1]
                for b, p in cells
                if e - MORPH_SIZE <= b < e and (not tables.boundary or b != 1)
            ]
            if ways and math.isfinite(min(ways)):
                cells[e, s] = float(min(ways))
    return spark.createDataFrame([(e, s, c) for (e, s), c in cells.items()], "position int, state int, cost double")


def compare_segment(words: DataFrame, model: Model) -> DataFrame:
    """For ``word``, ``expected`` segment and ``expected_cost``: whether the search finds it, and the relative error."""
    found = segment(words, model)
    return found.select(
        "word",
        F.coalesce(F.col("segment") == F.col("expected"), F.lit(False)).alias("same_segment"),
        ((F.col("cost") - F.col("expected_cost")) / F.col("expected_cost")).alias("relative_error"),
    )
