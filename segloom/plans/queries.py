"""Queries of the core operators over a data folder.

The corpus is made of the words of ``documents``; the seed model (5 states, one of them a prefix, one
a suffix) is counted from their chunks of three characters.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions.columns import pick
from segloom.operators import anneal, codelen, costs, counts, prune
from segloom.operators.lattice import explain_lattice, search_words, segment
from segloom.operators.model import Model, Settings
from segloom.operators.occurrences import random_counts, transitions_of
from segloom.operators.seed import chunk_segments, random_segments
from segloom.operators.training import train_step, without_deregistered
from segloom.plans.trainer import TrainConfig, Trainer
from segloom.sources import corpus
from segloom.sources.segmented_text import parsed, rendered
from segloom.sources.tables import table

SETTINGS = Settings(5, 1, 1)
BOUNDED = Settings(5, 1, 1, has_word_boundary=True)
#: Steps that queries with transition control forbid: a suffix after a prefix, a prefix before the end.
FORBIDDEN = frozenset({(1, 3), (1, 4)})
ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus: distinct words of documents with their number."""
    return corpus.counted(corpus.words_of_texts(table(spark, sf_dir, "documents")))


def other_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct lines of the partitions, in lower case."""
    return corpus.counted(corpus.words_of_lines(table(spark, sf_dir, "partition_lines")))


def seeded(spark: SparkSession, sf_dir: str, boundary: bool = False) -> DataFrame:
    return chunk_segments(words(spark, sf_dir), boundary=boundary)


def seed_model(spark: SparkSession, sf_dir: str, settings: Settings = SETTINGS) -> Model:
    return Model.from_segmented(seeded(spark, sf_dir, settings.has_word_boundary), settings)


def path_text(segment_: Column | str = "segment") -> Column:
    """A segment as text, ``morph/state morph/state``."""
    return F.array_join(F.transform(segment_, lambda x: F.concat(x["morph"], F.lit("/"), x["state"])), " ")


def shown(found: DataFrame) -> DataFrame:
    return found.select("word", path_text().alias("path"), F.round("cost", 6).alias("cost"))


# Scans and corpus


def corpus_words(spark, sf_dir):
    return words(spark, sf_dir)


def line_words(spark, sf_dir):
    return other_words(spark, sf_dir)


def partition_scan(spark, sf_dir):
    """The lines of every partition."""
    lines = pick(table(spark, sf_dir, "partition_lines"), pid="pid", line="dataset", line_id="line_id")
    return lines.select("pid", "line_id", "line").distinct()


def corpus_charset(spark, sf_dir):
    return corpus.charset(words(spark, sf_dir))


def charset_filtered_words(spark, sf_dir):
    return corpus.filter_charset(words(spark, sf_dir), ALPHABET)


def partition_sizes(spark, sf_dir):
    parts = corpus.split_balanced(words(spark, sf_dir), 7)
    return parts.groupBy("pid").agg(F.count("*").alias("size"), F.min("word").alias("least"))


def fraction_split(spark, sf_dir):
    parts = corpus.split_fraction(words(spark, sf_dir), 0.3)
    return parts.groupBy("at_random").agg(F.count("*").alias("size"), F.min("word").alias("least"))


# Seeds


def seed_chunk_segments(spark, sf_dir):
    return seeded(spark, sf_dir).select("word", "n", path_text().alias("path"))


def seed_random_segments(spark, sf_dir):
    found = random_segments(words(spark, sf_dir), 7, 2, 2)
    return found.select("word", "n", path_text().alias("path"))


def seed_random_controlled(spark, sf_dir):
    """Steps of random segments, one for each occurrence, which are all allowed; single letters are left out."""
    several = words(spark, sf_dir).where(F.length("word") > 1)
    return transitions_of(random_counts(several, Settings(5, 1, 1, forbidden=FORBIDDEN)))


# Counts


def lexicon(spark, sf_dir):
    return counts.lexicon(seeded(spark, sf_dir))


def state_freq(spark, sf_dir):
    return counts.state_freq(seeded(spark, sf_dir), 5)


def transition_freq(spark, sf_dir):
    return counts.transitions(seeded(spark, sf_dir), 5)


def transition_dense(spark, sf_dir):
    return counts.transition_matrix(counts.transitions(seeded(spark, sf_dir), 5), 5)


def _segmented_table(spark, sf_dir):
    rows = pick(table(spark, sf_dir, "segmented"), seg_id="seg_id", word="word", segment="segment")
    return rows.distinct()


def segmented_lexicon(spark, sf_dir):
    """Counts of the stored segmented corpus."""
    return counts.lexicon(_segmented_table(spark, sf_dir))


def segmented_transitions(spark, sf_dir):
    return counts.transitions(_segmented_table(spark, sf_dir), 14)


def merged_lexicon(spark, sf_dir):
    """The lexicons of each model's bundles, added."""
    rows = pick(
        table(spark, sf_dir, "lexicon"),
        entry_id="entry_id", model_name="model_name", morph="morph", state="state", freq="freq",
    ).where("morph <> ''").distinct()
    return counts.merge_lexicons(rows, "model_name")


def merged_state_freq(spark, sf_dir):
    """The state frequencies of each model's bundles, added."""
    names = pick(table(spark, sf_dir, "bundles"), bundle_id="bundle_id", model_name="model_name").distinct()
    rows = pick(table(spark, sf_dir, "state_freq"), bundle_id="bundle_id", state="state", freq="freq").distinct()
    return counts.merge_states(rows.join(names, "bundle_id"), "model_name")


def state_sizes(spark, sf_dir):
    return counts.states_of_types(lexicon(spark, sf_dir), 5)


def state_char_counts(spark, sf_dir):
    return counts.char_counts(lexicon(spark, sf_dir))


def bits_per_char(spark, sf_dir):
    return counts.bits_per_char(counts.lexicon_charset(lexicon(spark, sf_dir)))


def freq_of_freq(spark, sf_dir):
    return counts.freq_of_freq(lexicon(spark, sf_dir))


def morph_states(spark, sf_dir):
    index = counts.morph_states(lexicon(spark, sf_dir))
    entries = F.array_sort(F.transform(F.map_entries("states"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])))
    return index.select("morph", F.array_join(entries, " ").alias("states"))


def morph_char_counts(spark, sf_dir):
    return counts.morph_char_counts(lexicon(spark, sf_dir))


# Costs


def transition_cost(spark, sf_dir):
    found = seed_model(spark, sf_dir).transition_costs()
    return found.select("from_state", "to_state", F.round("cost", 6).alias("cost"))


def transition_cost_ctrl(spark, sf_dir):
    found = seed_model(spark, sf_dir, Settings(5, 1, 1, forbidden=FORBIDDEN)).transition_costs()
    return found.select("from_state", "to_state", F.round("cost", 6).alias("cost"))


def emission_cost_known(spark, sf_dir):
    m = seed_model(spark, sf_dir)
    return costs.emission_costs(m.lexicon, m.states()).select("morph", "state", F.round("cost", 6).alias("cost"))


def add_morph_pos(spark, sf_dir):
    m = seed_model(spark, sf_dir)
    size = counts.lexicon_charset(m.lexicon).agg(F.count("*")).scalar()
    found = costs.added_chars(m.states(), size)
    return found.select("state", "length", F.round("cost", 6).alias("cost"))


def add_morph_neg1(spark, sf_dir):
    m = seed_model(spark, sf_dir)
    found = costs.added_counts(m.lexicon, counts.lexicon_charset(m.lexicon), 5)
    return found.select("state", "ch", "k", F.round("cost", 6).alias("cost"))


def add_morph_neg2(spark, sf_dir):
    found = costs.added_types(seed_model(spark, sf_dir).states())
    return found.select("state", F.round("cost", 6).alias("cost"))


def emission_cost_new(spark, sf_dir):
    """What each morph costs in the states that don't have it."""
    m = seed_model(spark, sf_dir)
    found = costs.new_morph_costs(m.lexicon, m.lexicon, m.states(), 5)
    return found.select("morph", "state", F.round("cost", 6).alias("cost"))


# Code length


def codelen_transition(spark, sf_dir):
    m = seed_model(spark, sf_dir)
    return codelen.transition_length(m.transition_freq, 5).select(F.round("transition", 3).alias("bits"))


def codelen_lexicon(spark, sf_dir):
    return codelen.lexicon_length(lexicon(spark, sf_dir)).select(F.round("lexicon", 3).alias("bits"))


def codelen_emission(spark, sf_dir):
    return codelen.emission_length(lexicon(spark, sf_dir)).select(F.round("emission", 3).alias("nats"))


def codelen_total(spark, sf_dir):
    parts = seed_model(spark, sf_dir).code_length()
    return parts.select(*[F.round(c, 3).alias(c) for c in parts.columns])


# Search


def segment_words(spark, sf_dir):
    """Every distinct word of documents, segmented by the seed model."""
    return shown(search_words(words(spark, sf_dir), seed_model(spark, sf_dir)))


def segment_words_boundary(spark, sf_dir):
    return shown(search_words(words(spark, sf_dir), seed_model(spark, sf_dir, BOUNDED)))


def segment_words_ctrl(spark, sf_dir):
    m = seed_model(spark, sf_dir, Settings(5, 1, 1, forbidden=FORBIDDEN))
    return shown(search_words(words(spark, sf_dir), m))


def segment_words_joined(spark, sf_dir):
    """The same, with the lexicon joined instead of broadcast, as it is when it is large."""
    return shown(search_words(words(spark, sf_dir), seed_model(spark, sf_dir), broadcast_entries=0))


def segment_cached(spark, sf_dir):
    """Words whose seed segments are cached keep them; the lines' words are searched."""
    model = seed_model(spark, sf_dir).with_cache(seeded(spark, sf_dir).where(F.length("word") <= 6))
    found = segment(words(spark, sf_dir), model)
    return found.select("word", path_text().alias("path"), F.round("cost", 6).alias("cost"))


def oov_words(spark, sf_dir):
    """The lines' words with a character that the seed model doesn't know."""
    chars = [r.ch for r in counts.lexicon_charset(lexicon(spark, sf_dir)).collect()]
    return other_words(spark, sf_dir).where(~corpus.within_charset(F.col("word"), chars)).select("word")


def infeasible_words(spark, sf_dir):
    """The lines' words, of known characters or not, that the seed model has no path for."""
    found = search_words(other_words(spark, sf_dir).select("word"), seed_model(spark, sf_dir))
    return found.where("segment IS NULL").select("word")


def lattice_cells(spark, sf_dir):
    """The cells of one word."""
    cells = explain_lattice("segmentation", seed_model(spark, sf_dir))
    return cells.select("position", "state", F.round("cost", 6).alias("cost"))


# Training


def train_step_t0(spark, sf_dir):
    return shown(train_step(words(spark, sf_dir), seed_model(spark, sf_dir)))


def train_step_counts(spark, sf_dir):
    """State and transition counts after one step."""
    found = train_step(words(spark, sf_dir), seed_model(spark, sf_dir))
    return counts.transition_matrix(counts.transitions(found, 5), 5)


def train_step_annealed(spark, sf_dir):
    return shown(train_step(words(spark, sf_dir), seed_model(spark, sf_dir), temperature=20.0, epoch=1))


def dereg_candidates(spark, sf_dir):
    return anneal.dereg_candidates(lexicon(spark, sf_dir), 5, 1, 1)


def dereg_drawn(spark, sf_dir):
    return anneal.dereg_drawn(dereg_candidates(spark, sf_dir), 0.15)


def deregistered_filter(spark, sf_dir):
    found = without_deregistered(seeded(spark, sf_dir), dereg_drawn(spark, sf_dir))
    return found.select("word", "n")


def _schedule(kind: str):
    def query(spark, sf_dir):
        found = anneal.schedule_table(spark, 100.0, 1e-4, 0.95, 20, kind)
        return found.select("epoch", *[F.round(c, 9).alias(c) for c in found.columns[1:]])

    return query


def epoch_losses(spark, sf_dir):
    """Losses of three epochs from random segments, with a de-registration after each second one."""
    config = TrainConfig(6, 1, 1, alpha=0.5, min_lexicon_freq=2)
    trainer = Trainer(spark, config, seed=1)
    trainer.load_raw_corpus(words(spark, sf_dir))
    done = trainer.train(3, bulk_dereg_every_n_epoch=2)
    rows = list(enumerate([trainer.first_loss, *done.losses]))
    return spark.createDataFrame(rows, "epoch bigint, loss double")


# Pruning, text, summary


def prune_threshold(spark, sf_dir):
    return prune.prune_threshold(lexicon(spark, sf_dir), 5, 100)


def pruned_lexicon(spark, sf_dir):
    return prune.pruned_lexicon(lexicon(spark, sf_dir), 5, 100)


def pruned_charset(spark, sf_dir):
    return counts.lexicon_charset(pruned_lexicon(spark, sf_dir))


def pruned_segment(spark, sf_dir):
    """Words of the pruned lexicon's characters, segmented with it; state and transition counts stay."""
    m = seed_model(spark, sf_dir).with_lexicon(pruned_lexicon(spark, sf_dir))
    chars = [r.ch for r in counts.lexicon_charset(m.lexicon).collect()]
    return shown(train_step(corpus.filter_charset(words(spark, sf_dir), chars), m, final=True))


def segmented_text_render(spark, sf_dir):
    return rendered(seeded(spark, sf_dir))


def segmented_text_parse(spark, sf_dir):
    lines = rendered(seeded(spark, sf_dir)).select(F.col("line").alias("value"))
    return parsed(lines).select("word", path_text().alias("path"), "cost")


def model_summary(spark, sf_dir):
    return seed_model(spark, sf_dir).summary().select("metric", F.round("value", 3).alias("value"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    listed = (
        corpus_words, line_words, partition_scan, corpus_charset, charset_filtered_words, partition_sizes,
        fraction_split, seed_chunk_segments, seed_random_segments, seed_random_controlled, lexicon, state_freq,
        transition_freq, transition_dense, segmented_lexicon, segmented_transitions, merged_lexicon,
        merged_state_freq, state_sizes, state_char_counts, bits_per_char, freq_of_freq, morph_states,
        morph_char_counts, transition_cost, transition_cost_ctrl, emission_cost_known, add_morph_pos,
        add_morph_neg1, add_morph_neg2, emission_cost_new, codelen_transition, codelen_lexicon, codelen_emission,
        codelen_total, segment_words, segment_words_boundary, segment_words_ctrl, segment_words_joined,
        segment_cached, oov_words, infeasible_words, lattice_cells, train_step_t0, train_step_counts,
        train_step_annealed, dereg_candidates, dereg_drawn, deregistered_filter, epoch_losses, prune_threshold,
        pruned_lexicon, pruned_charset, pruned_segment, segmented_text_render, segmented_text_parse, model_summary,
    )
    return {f.__name__: f for f in listed} | {f"anneal_schedule_{k}": _schedule(k) for k in anneal.SCHEDULES}
