"""Training: a loop on the driver over DataFrame jobs, one for each epoch."""

from __future__ import annotations

import logging
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions.draws import draw_value
from segloom.operators import anneal, prune
from segloom.operators.lattice import segment
from segloom.operators.model import Model, Settings
from segloom.operators.occurrences import added, model_of, random_counts
from segloom.operators.training import epoch_counts, train_step
from segloom.session import cut
from segloom.sources import corpus as corpora
from segloom.sources.model_store import checkpoint_name, read_model, write_charset, write_model
from segloom.sources.segmented_text import write_segmented

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class TrainConfig:
    """Parameters of training. ``forbidden``: steps between states that are not allowed."""

    num_state: int
    num_prefix: int = 0
    num_suffix: int = 0
    has_word_boundary: bool = False
    forbidden: frozenset[tuple[int, int]] = frozenset()
    charset: frozenset[str] = frozenset()
    delta: float = 1e-6
    patience: int = 10
    init_temp: float = 100.0
    final_temp: float = 1e-4
    alpha: float = 0.95
    schedule: str = "concave"
    affix_lbound: int = 60
    stem_ubound: int = 150
    bulk_prob: float = 0.15
    min_lexicon_freq: int = 0
    min_pruned_remain: int = 0

    def __post_init__(self) -> None:
        if self.schedule not in anneal.SCHEDULES:
            raise ValueError(f"schedule must be one of {anneal.SCHEDULES}")
        if not 0 <= self.bulk_prob <= 1:
            raise ValueError("bulk_prob must be in [0, 1]")
        if self.min_lexicon_freq < 0:
            raise ValueError("min_lexicon_freq must not be negative")
        self.settings()

    def settings(self) -> Settings:
        return Settings(
            self.num_state, self.num_prefix, self.num_suffix, self.has_word_boundary, frozenset(self.forbidden)
        )


@dataclass(frozen=True)
class Trained:
    """What training gives: the model with the last epoch's counts, the losses, the segmented words, and what is left after pruning."""

    model: Model
    losses: list[float]
    segmented: DataFrame
    pruned_model: Model | None = None
    pruned_segmented: DataFrame | None = None


class Trainer:
    """Learns a model from words.

    Each occurrence of a word draws for itself above T = 0 and in random segmentation; at T = 0
    without random segmentation, distinct words are searched once, and counted as often as they are
    there. Counts of each epoch are written to the checkpoint
    folder, so lineage doesn't grow, and lost executors cost one epoch at most.
    """

    def __init__(self, spark: SparkSession, config: TrainConfig, seed: int = 0, path: str | None = None, name: str = "model"):
        self.spark, self.config, self.seed, self.path, self.name = spark, config, seed, path, name
        self.counted: DataFrame | None = None
        self.model: Model | None = None
        self.first_loss: float | None = None

    def load_checkpoint(self, path: str) -> None:
        """Starts from a written model instead of random segments."""
        self.model = read_model(self.spark, path)[0]
        self.first_loss = self.model.loss()

    def load_raw_corpus(self, corpus: str | DataFrame) -> None:
        """Loads a file of words, or a DataFrame with ``word`` and perhaps ``n``; seeds a model if there is none.

        Given a character set, words with other characters are dropped.
        """
        words = corpora.read_words(self.spark, corpus) if isinstance(corpus, str) else corpus
        if self.config.charset:
            words = corpora.filter_charset(words, self.config.charset)
        if "n" not in words.columns:
            words = corpora.counted(words)
        self.counted = cut(words.where("word <> ''").select("word", F.col("n").cast("bigint").alias("n")))
        chars = self.config.charset or frozenset(r.ch for r in corpora.charset(self.counted).collect())
        if self.model is None:
            first = random_counts(self.counted, self.config.settings(), self.seed)
            self.model = self._settle(first, chars)
            self.first_loss = self.model.loss()
        self.model = replace(self.model, predefined=chars)

    def _settle(self, counted: DataFrame, chars: frozenset[str]) -> Model:
        """The model of an epoch's counts, which are added and written once."""
        return model_of(cut(added(counted)), self.config.settings(), predefined=chars)

    def epoch(self, epoch: int, epochs: int, temperature: float, deregistered: DataFrame | None = None) -> float:
        """One epoch; the model becomes the new one. Gives its loss."""
        fraction = 0.0 if deregistered is not None else anneal.random_fraction(epoch, epochs, self.config.schedule)
        found = epoch_counts(self.counted, self.model, temperature, fraction, self.seed, epoch, deregistered)
        self.model = self._settle(found, self.model.predefined)
        return self.model.loss()

    def deregister(self, epoch: int, epochs: int) -> float:
        """De-registers drawn pairs and counts again without the words that use them."""
        c = self.config
        drawn = anneal.dereg_drawn(
            anneal.dereg_candidates(
                self.model.lexicon, c.num_state, c.num_prefix, c.num_suffix, c.affix_lbound, c.stem_ubound
            ),
            c.bulk_prob, self.seed, epoch,
        )
        return self.epoch(epoch, epochs, 0.0, cut(drawn))

    def train(self, max_iteration: int = 10, bulk_dereg_every_n_epoch: int = 0, save_corpus: bool = False) -> Trained:
        """Trains, segments all words with the result, and writes what a path was given for.

        With 0 iterations it only segments the words, by the loaded model.
        """
        if self.model is None or self.counted is None:
            raise ValueError("load a corpus first")
        c = self.config
        epochs = anneal.epoch_cap(c.init_temp, c.final_temp, c.alpha, max_iteration)
        stop, temperature, losses = anneal.EarlyStop(c.delta, c.patience), c.init_temp, []
        for e in range(epochs):
            temperature = anneal.temperature(temperature, c.final_temp, c.alpha)
            loss = self.epoch(e, epochs, temperature)
            u = draw_value(self.seed, "trigger", e)
            if anneal.dereg_due(e, epochs, u, c.bulk_prob, c.num_prefix, c.num_suffix, bulk_dereg_every_n_epoch):
                loss = self.deregister(e, epochs)
            losses.append(loss)
            log.info("epoch %d of %d at %g: %g", e, epochs, temperature, loss)
            done, improved = stop.step(loss)
            if improved and self.path:
                write_model(self.model, f"{self.path}/{checkpoint_name(self.name, e, loss)}.model", mode="overwrite")
            if done:
                break
        return self._collect(losses, save_corpus)

    def _collect(self, losses: list[float], save_corpus: bool) -> Trained:
        model, c = self.model, self.config
        segmented = train_step(self.counted, model, final=True)
        loss = model.loss()
        self._write("FINAL", loss, model, segmented, save_corpus)
        if not c.min_lexicon_freq:
            return Trained(model, losses, segmented)
        pruned = model.with_lexicon(cut(prune.pruned_lexicon(model.lexicon, c.min_lexicon_freq, c.min_pruned_remain)))
        chars = frozenset(r.ch for r in pruned.charset().collect())
        left = train_step(corpora.filter_charset(self.counted, chars), pruned, final=True)
        self._write("PRUNED", loss, pruned, left, save_corpus)
        return Trained(model, losses, segmented, pruned, left)

    def _write(self, stage: str, loss: float, model: Model, segmented: DataFrame, save_corpus: bool) -> None:
        if not self.path:
            return
        base = f"{self.path}/{checkpoint_name(self.name, stage, loss)}"
        write_model(model, f"{base}.model", segmented if save_corpus else None, mode="overwrite")
        if stage == "FINAL":
            write_segmented(segmented, f"{base}.txt", mode="overwrite")
        else:
            write_charset(model, f"{self.path}/pruned_charset", mode="overwrite")


def segment_all(words: DataFrame, model: Model) -> DataFrame:
    """Segments of all words, the batch use of a finished model."""
    return segment(words, model)
