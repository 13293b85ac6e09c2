"""Counts of segments that each occurrence draws for itself."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import SparkSession

from segloom.operators.model import Settings
from segloom.operators.occurrences import BLOCK, random_counts, satisfiable
from segloom.plans.queries import FORBIDDEN, seed_random_controlled


@pytest.fixture(scope="module")
def spark():
    return SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()


def counted(found) -> tuple[Counter, Counter]:
    morphs, steps = Counter(), Counter()
    for r in found.collect():
        if r.morph is None:
            steps[r.state, r.to_state] += r.freq
        else:
            morphs[r.morph, r.state] += r.freq
    return morphs, steps


def test_controlled_ends_and_keeps_control(spark, tmp_path):
    text = " ".join(["ab"] * 30_000 + ["segmentation"] * 500 + ["a"] * 9)
    spark.createDataFrame([(text,)], "text string").write.parquet(f"{tmp_path}/documents.parquet")
    steps = {(r.from_state, r.to_state): r.freq for r in seed_random_controlled(spark, str(tmp_path)).collect()}
    assert not FORBIDDEN & set(steps)
    starts = sum(n for (a, _), n in steps.items() if a == 0)
    assert starts == sum(n for (_, b), n in steps.items() if b == 4) == 30_500


def test_random_counts_by_hand(spark):
    """Two letters have two pieces; the states are those of the allowed draws, each as often as it should be."""
    n = 3 * BLOCK + 5
    words = spark.createDataFrame([("ab", n), ("c", 7)], "word string, n bigint")
    morphs, steps = counted(random_counts(words, Settings(5, 1, 1, forbidden=FORBIDDEN)))
    assert sum(v for (m, _), v in morphs.items() if m == "a") == sum(v for (m, _), v in morphs.items() if m == "b") == n
    assert morphs["c", 2] == 7
    # Of four equal draws of prefix and suffix, a prefix before a suffix is forbidden: 22, 12 and 23 stay.
    for key, share in {("a", 1): 1 / 3, ("a", 2): 2 / 3, ("b", 2): 2 / 3, ("b", 3): 1 / 3}.items():
        assert abs(morphs[key] / n - share) < 0.01
    assert steps[2, 4] == morphs["b", 2] + 7 and steps[0, 1] == morphs["a", 1]


def test_places_are_uniform(spark):
    n = 60_000
    morphs, _ = counted(random_counts(spark.createDataFrame([("abcd", n)], "word string, n bigint"), Settings(3)))
    # One, two or three cuts, in equal shares; "a" is a piece by 1/3, 2/3 and 1 of them.
    assert abs(morphs["a", 1] / n - 2 / 3) < 0.01 and abs(morphs["bc", 1] / n - 1 / 9) < 0.01
    assert sum(len(m) * v for (m, _), v in morphs.items()) == 4 * n


def test_rare_states_are_found_and_impossible_ones_are_an_error(spark):
    """Control that one of some thousand draws meets doesn't end in an error, as it did after 64 draws."""
    rare = frozenset({(a, b) for a in range(12) for b in range(12)} - {(0, 7), (7, 8), (8, 11)})
    assert satisfiable(Settings(12, 0, 0, forbidden=rare), 2)
    morphs, _ = counted(random_counts(spark.createDataFrame([("ab", 20)], "word string, n bigint"), Settings(12, forbidden=rare)))
    assert morphs == {("a", 7): 20, ("b", 8): 20}
    never = Settings(5, 1, 1, forbidden=frozenset({(2, 4), (3, 4), (1, 4)}))
    assert not satisfiable(never, 9)
    with pytest.raises(Exception, match="allows no states"):
        random_counts(spark.createDataFrame([("ab", 1)], "word string, n bigint"), never).collect()


def test_blocks_and_partitions_change_nothing(spark, monkeypatch):
    words = spark.createDataFrame([("abc", 2 * BLOCK + 9), ("abd", 3), ("x" * 300, 4)], "word string, n bigint")
    settings = Settings(6, 2, 1, has_word_boundary=True)
    one = counted(random_counts(words, settings))
    monkeypatch.setattr("segloom.operators.occurrences.TASKS", 1)
    assert counted(random_counts(words.repartition(5), settings)) == one
    assert sum(v for (m, _), v in one[0].items() if m.startswith("▁")) == 2 * BLOCK + 9 + 3 + 4
