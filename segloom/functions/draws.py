"""Uniform draws that depend on keys only, so results are the same for any partitioning and retry."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_SCALE = float(1 << 32)


def draw(*keys: Column | str | int) -> Column:
    """A number in [0, 1) from the keys; literals may be strings or integers."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in keys]
    text = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.conv(F.substr(F.md5(text), F.lit(1), F.lit(8)), 16, 10).cast("double") / F.lit(_SCALE)


def draw_value(*keys: object) -> float:
    """The same number in Python, for kernels."""
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:8], 16) / _SCALE


def below(u: Column, n: Column | int) -> Column:
    """A whole number in [0, n) from a draw."""
    return F.floor(u * n).cast("int")


#: Odd constants of splitmix64, which steps from one number of a stream to the next and mixes it.
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """Whole numbers of 64 bits, mixed by the last step of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def word_keys(seed: int, what: str, epoch: int, words: list[str]) -> np.ndarray:
    """A key for each word, by md5."""
    texts = (f"{seed}|{what}|{epoch}|{w}".encode() for w in words)
    return np.array([int(hashlib.md5(t).hexdigest()[:16], 16) for t in texts], np.uint64)


def occurrence_keys(keys: np.ndarray, which: np.ndarray, number: np.ndarray) -> np.ndarray:
    """A key for each occurrence: of the word at that place, the one of that number."""
    return mixed(keys[which] + number.astype(np.uint64) * _STEP)


def key_bits(keys: np.ndarray, slot: int | np.ndarray) -> np.ndarray:
    """The draw of that slot of each key, as 64 bits."""
    return mixed(keys + (np.asarray(slot).astype(np.uint64) + np.uint64(1)) * _STEP)


def key_draw(keys: np.ndarray, slot: int | np.ndarray) -> np.ndarray:
    """The same as a number in [0, 1)."""
    return (key_bits(keys, slot) >> np.uint64(11)) * 2.0**-53
