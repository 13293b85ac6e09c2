"""Token ids by a public byte-level tokenizer."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from segloom.functions.columns import pick

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how the tokenizer's authors split a text into pieces.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Pieces that a worker remembers, and the longest that it does.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64
_NONE = 1 << 60


class MinTree:
    """A segment tree over positions that holds the leftmost least value."""

    def __init__(self, values: list[int]) -> None:
        self.size = size = 1 << max(0, len(values) - 1).bit_length()
        # A node is rank * size + position: the least is the least rank, and of these the leftmost.
        self.node = node = [_NONE * size] * (2 * size)
        for i, v in enumerate(values):
            node[size + i] = v * size + i
        for i in range(size - 1, 0, -1):
            x, y = node[2 * i], node[2 * i + 1]
            node[i] = x if x <= y else y

    def put(self, position: int, value: int) -> None:
        node = self.node
        i = self.size + position
        node[i] = value * self.size + position
        while i > 1:
            x, y = node[i], node[i ^ 1]
            i >>= 1
            low = x if x <= y else y
            if node[i] == low:
                return
            node[i] = low

    def least(self) -> tuple[int, int]:
        return divmod(self.node[1], self.size)


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece: pairs are merged in the order of their rank, the leftmost first.

    Position i of the tree holds the rank of the token that starts at byte i with the next one;
    ``following`` and ``before`` link the tokens that are left. A merge updates the pair itself,
    the one before, and the second token's, so a piece of n bytes takes n log n steps.
    """
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    rank = ranks.get
    tree = MinTree([rank(piece[i : i + 2], _NONE) for i in range(n - 1)])
    following, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while True:
        value, i = tree.least()
        if value >= _NONE:
            break
        j = following[i]
        k = following[j]
        following[i] = k
        tree.put(j, _NONE) if j < n - 1 else None
        if k < n:
            before[k] = i
            tree.put(i, rank(piece[i : following[k]], _NONE))
        else:
            tree.put(i, _NONE)
        if (h := before[i]) >= 0:
            tree.put(h, rank(piece[h:k], _NONE))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : following[i]]])
        i = following[i]
    return ids


class _Pieces(dict):
    """Ids by piece, computed when first asked for; forgets all when it is full."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        raw = piece.encode()
        ids = merge(raw, self.ranks)
        if len(raw) <= REMEMBERED_BYTES:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


@lru_cache(maxsize=2)
def encoder(path: str):
    """A function from a text to its ids, kept by the worker process."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    split, ids = regex.compile(PATTERN).findall, _Pieces(ranks).__getitem__
    return lambda text: chain.from_iterable(map(ids, split(text)))


def _encode(path: str, most: int = 1 << 21):
    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)

        def out(ids: list, flat: array, ends: list) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(
                pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32), pa.int32())
            )
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), lists], ["doc_id", "ids"])

        for batch in batches:
            done, flat, ends = [], array("i"), [0]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    flat.extend(encode(text.as_py()))
                done.append(doc)
                ends.append(len(flat))
                if len(flat) >= most:
                    yield out(done, flat, ends)
                    done, flat, ends = [], array("i"), [0]
            yield out(done, flat, ends)

    return kernel


def encode(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id`` and ``ids``, the list of token ids of each row's text, without special tokens.

    One pass of an Arrow kernel over the scan, no shuffle. Empty and null texts have an empty list.
    Special tokens' strings are ordinary text. Whole texts are encoded, a piece of n bytes in
    n log n steps, so a very long one without blanks does no harm; ids leave the worker in batches
    of some million. A row that comes twice comes out twice.
    """
    return pick(documents, doc_id=doc_id, text=text).mapInArrow(_encode(vocabulary), "doc_id bigint, ids array<int>")
