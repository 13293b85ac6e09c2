"""Passages of held-out items in a corpus."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segloom.functions.columns import pick

WORD = re.compile(r"[^\W_]+")
# Spaced seeds; a word under 0 is ignored, so one that was replaced there does no harm.
MASKS = ("1101100111", "1110011011")
#: Characters of items that make one block. Only a block's index is held in memory; a larger set of
#: items is searched block by block.
BLOCK_CHARS = 8_000_000


def words(text: str | None) -> list[str]:
    """Runs of letters and digits, in lower case."""
    return WORD.findall(text.lower()) if text else []


class Index:
    """Seeds of a block of items.

    Words of the items are numbered from 1, all others are 0. A seed is the hash of the words under
    a mask's ones. Seeds are sorted, with the places they come from.
    """

    def __init__(self, items: list[tuple[int, str | None]], masks: tuple[str, ...] = MASKS) -> None:
        self.number: dict[str, int] = {}
        self.items = [i for i, _ in items]
        self.texts = [
            np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(t)], np.int64) for _, t in items
        ]
        self.longest = max(map(len, self.texts), default=0)
        self.masks = [np.flatnonzero([c == "1" for c in m]) for m in masks]
        self.spans = [len(m) for m in masks]
        self.seeds = []
        for care, span in zip(self.masks, self.spans, strict=True):
            hashes, item, place = [], [], []
            for k, t in enumerate(self.texts):
                h = seeds(t, care, span)
                hashes.append(h)
                item.append(np.full(len(h), k, np.int64))
                place.append(np.arange(len(h)))
            flat = np.concatenate([*hashes, np.empty(0, np.uint64)])
            order = np.argsort(flat, kind="stable")
            self.seeds.append(
                (
                    flat[order],
                    np.concatenate([*item, np.empty(0, np.int64)])[order],
                    np.concatenate([*place, np.empty(0, np.int64)])[order],
                )
            )


def seeds(numbers: np.ndarray, care: np.ndarray, span: int) -> np.ndarray:
    """The hash of every window of ``span`` words, of the words at the offsets ``care``."""
    n = len(numbers) - span + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    x = numbers.astype(np.uint64)
    h = np.zeros(n, np.uint64)
    for offset in care:
        h = (h ^ (x[offset : offset + n] + np.uint64(offset + 1))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def overlap(item: np.ndarray, text: np.ndarray, shift: int, near: int) -> tuple[int, int, int, int]:
    """Where an item, laid at ``shift`` in a text, overlaps it: longest equal run, and first word,
    length and number of substituted words of the longest overlap, in which no ``near`` words in
    succession hold more than one substitution.
    """
    first, last = max(0, -shift), min(len(item), len(text) - shift)
    equal = item[first:last] == text[first + shift : last + shift]
    wrong = np.flatnonzero(~equal)
    edges = np.concatenate([[-1], wrong, [len(equal)]])
    gaps = np.diff(edges) - 1
    run = int(gaps.max(initial=0))
    best, start = (0, 0, 0), 0
    # Substitutions whose neighbours on both sides are equal for long enough are within the overlap.
    for k in range(len(wrong) + 1):
        if k == len(wrong) or min(gaps[k], gaps[k + 1]) < near // 2:
            length, holes = int(edges[k + 1] - edges[start] - 1), k - start
            best = max(best, (length - holes, int(edges[start] + 1), holes))
            start = k + 1
    matched, at, holes = best
    return run, first + at, matched + holes, holes


def _search(index: Index, near: int):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = index.number.get
        for batch in batches:
            ids = batch.column(0).to_pylist()
            counts, parts = [], []
            for text in batch.column(1):
                w = words(text.as_py())
                parts.append(np.fromiter(map(number, w, repeat(0)), np.int64, len(w)))
                counts.append(len(w))
            ends = np.cumsum(counts)
            flat = np.concatenate([*parts, np.empty(0, np.int64)])
            found = set()
            for care, span, (hashes, item, place) in zip(index.masks, index.spans, index.seeds, strict=True):
                mine = seeds(flat, care, span)
                lo = np.searchsorted(hashes, mine, "left")
                hit = np.flatnonzero(lo < len(hashes)) if len(hashes) else np.empty(0, np.int64)
                hit = hit[hashes[lo[hit]] == mine[hit]]
                times = np.searchsorted(hashes, mine[hit], "right") - lo[hit]
                at = np.repeat(hit, times)
                entry = np.repeat(lo[hit] - np.cumsum(times) + times, times) + np.arange(times.sum())
                doc = np.searchsorted(ends, at, "right")
                start = (ends - counts)[doc] if len(doc) else doc
                shift = at - start - place[entry]
                found.update(zip(doc.tolist(), item[entry].tolist(), shift.tolist(), strict=True))
            rows = []
            for doc, item, shift in sorted(found):
                measures = overlap(index.texts[item], parts[doc], shift, near)
                rows.append((index.items[item], ids[doc], *measures, shift + measures[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in columns],
                ["item_id", "doc_id", "run", "item_at", "length", "substituted", "doc_at"],
            )

    return kernel


def overlaps(
    items: DataFrame,
    documents: DataFrame,
    item_id: str = "item_id",
    item_text: str = "text",
    doc_id: str = "doc_id",
    doc_text: str = "text",
    near: int = 10,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Overlaps of items with documents that share a spaced seed.

    The items' seeds are joined with the seeds of all windows of all documents, in whole; around
    each hit, words are compared, and ``run`` (the longest run of equal words), the longest overlap
    that tolerates single substitutions (``item_at``, ``doc_at``, ``length``, ``substituted``)
    come out, a row for each item, document and alignment. As a seed spans ten words, no run of ten
    equal words is missed. Documents aren't shuffled: a block's seeds go to all tasks, and a block
    is bounded by ``block_chars`` characters of items (or one item); more items mean more passes.

    Null and empty texts, and items or documents without an id, match nothing. Rows of one id that
    come twice give their rows once each.
    """
    held = pick(items, id=item_id, text=item_text).where("id IS NOT NULL AND text IS NOT NULL")
    size = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(size / block_chars))
    texts = pick(documents, doc_id=doc_id, text=doc_text).where("doc_id IS NOT NULL AND text IS NOT NULL")
    out = None
    for block in range(blocks):
        mine = held.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).distinct().orderBy("id", "text")
        index = Index([(r.id, r.text) for r in mine.collect()])
        found = texts.mapInArrow(
            _search(index, near),
            "item_id bigint, doc_id bigint, run bigint, item_at bigint, length bigint, "
            "substituted bigint, doc_at bigint",
        )
        out = found if out is None else out.unionByName(found)
    return out


def leaks(items: DataFrame, documents: DataFrame, words_in_sequence: int = 10, **names: str) -> DataFrame:
    """``item_id``, ``doc_id`` of items of which a document has so many words in the same sequence, 10 at least."""
    if words_in_sequence < max(map(len, MASKS)):
        raise ValueError("a seed spans more words")
    found = overlaps(items, documents, **names).where(F.col("run") >= words_in_sequence)
    return found.select("item_id", "doc_id").distinct()
