"""A segmentation model as DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.operators import codelen, costs, counts
from segloom.session import cut

LEXICON = "morph string, state int, freq bigint"


@dataclass(frozen=True)
class Settings:
    """The small parameters of a model. ``forbidden``: steps that are not allowed."""

    num_state: int
    num_prefix: int = 0
    num_suffix: int = 0
    has_word_boundary: bool = False
    forbidden: frozenset[tuple[int, int]] = field(default_factory=frozenset)

    def __post_init__(self) -> None:
        if self.num_state < 3:
            raise ValueError("num_state must be at least 3")
        if min(self.num_prefix, self.num_suffix) < 0 or self.num_state - self.num_prefix - self.num_suffix < 3:
            raise ValueError("num_state must leave a start, an end and a stem beside the affixes")
        object.__setattr__(self, "forbidden", frozenset((int(a), int(b)) for a, b in self.forbidden))


@dataclass(frozen=True)
class Model:
    """Lexicon (as large as it is), state and transition frequencies (small), and settings.

    ``predefined``: characters that count as known besides those of the lexicon, as cost tables are
    made; they don't enter the code length.
    """

    settings: Settings
    lexicon: DataFrame
    state_freq: DataFrame
    transition_freq: DataFrame
    predefined: frozenset[str] = frozenset()
    cache: DataFrame | None = None

    @classmethod
    def from_tables(
        cls, lexicon: DataFrame, state_freq: DataFrame, transition_freq: DataFrame, settings: Settings, **more
    ) -> Model:
        """From tables, which may be sparse and hold entries more than once; these are added."""
        n = settings.num_state
        lex = lexicon.where(F.col("morph").isNotNull()).select("morph", F.col("state").cast("int").alias("state"), "freq")
        steps = transition_freq.groupBy("from_state", "to_state").agg(F.sum("freq").alias("freq"))
        return cls(
            settings,
            counts.merge_lexicons(lex),
            counts.dense_states(counts.merge_states(state_freq), n),
            counts.transition_matrix(steps, n),
            **more,
        )

    @classmethod
    def from_segmented(cls, segmented: DataFrame, settings: Settings, **more) -> Model:
        """Counts of a segmented corpus."""
        n = settings.num_state
        return cls(
            settings,
            counts.lexicon(segmented),
            counts.state_freq(segmented, n),
            counts.transition_matrix(counts.transitions(segmented, n), n),
            **more,
        )

    @classmethod
    def empty(cls, spark: SparkSession, settings: Settings) -> Model:
        """A model without any count."""
        none = spark.createDataFrame([], LEXICON)
        steps = spark.createDataFrame([], "from_state int, to_state int, freq bigint")
        return cls.from_tables(none, none.select("state", "freq"), steps, settings)

    def with_cache(self, segmented: DataFrame) -> Model:
        """The same model, which knows these words' segments; the last of equal words counts.

        Without a column ``seq`` that orders them, the largest segment and cost is the last.
        """
        key = F.col("seq") if "seq" in segmented.columns else F.lit(0)
        last = F.max(F.struct(key.alias("seq"), "segment", "cost")).alias("last")
        word = F.ltrim(F.array_join(F.transform("segment", lambda x: x["morph"]), ""), F.lit(counts.BOUNDARY))
        known = segmented.where(F.size("segment") > 0).groupBy(word.alias("word")).agg(last)
        return replace(self, cache=known.select("word", "last.segment", "last.cost"))

    def with_lexicon(self, lexicon: DataFrame) -> Model:
        """Another lexicon with the same state and transition counts, as pruning leaves them."""
        return replace(self, lexicon=lexicon)

    def settled(self) -> Model:
        """The same model with its tables written to the checkpoint folder, which ends their lineage."""
        return replace(
            self, lexicon=cut(self.lexicon), state_freq=cut(self.state_freq), transition_freq=cut(self.transition_freq)
        )

    @cached_property
    def control(self) -> DataFrame | None:
        """The forbidden steps as a table, or None."""
        if not self.settings.forbidden:
            return None
        rows = [(a, b, 0) for a, b in sorted(self.settings.forbidden)]
        schema = "from_state int, to_state int, allowed int"
        return self.lexicon.sparkSession.createDataFrame(rows, schema)

    def states(self) -> DataFrame:
        """``state``, ``types``, ``char_size``, ``freq`` of the interior states."""
        s = self.settings
        return costs.state_table(self.lexicon, self.state_freq, s.num_state, s.has_word_boundary)

    def transition_costs(self) -> DataFrame:
        return costs.transition_costs(self.transition_freq, self.state_freq, self.settings.num_state, self.control)

    def charset(self) -> DataFrame:
        """``ch``: characters of all morphs, the word boundary included where the lexicon has it."""
        return counts.lexicon_charset(self.lexicon)

    def code_length(self) -> DataFrame:
        s = self.settings
        return codelen.code_length(self.lexicon, self.transition_freq, s.num_state, s.has_word_boundary)

    def loss(self) -> float:
        """The total code length."""
        return self.code_length().first()["total"]

    def tables(self) -> dict[str, DataFrame]:
        return {"lexicon": self.lexicon, "state_freq": self.state_freq, "transition_freq": self.transition_freq}

    def summary(self) -> DataFrame:
        """``metric``, ``value``: settings, sizes, code length, state and transition frequencies."""
        s = self.settings
        spark = self.lexicon.sparkSession
        fixed = spark.createDataFrame(
            [
                ("has_word_boundary", float(s.has_word_boundary)), ("num_state", float(s.num_state)),
                ("num_prefix", float(s.num_prefix)), ("num_suffix", float(s.num_suffix)),
                ("forbidden", float(len(s.forbidden))),
            ],
            "metric string, value double",
        )
        size = self.lexicon.agg(F.lit("lexicon").alias("metric"), F.count("*").cast("double").alias("value"))
        loss = self.code_length().select(F.lit("encoding_cost").alias("metric"), F.col("total").alias("value"))
        states = self.state_freq.select(
            F.concat(F.lit("state_freq_"), "state").alias("metric"), F.col("freq").cast("double").alias("value")
        )
        steps = self.transition_freq.select(
            F.concat(F.lit("transition_freq_"), "from_state", F.lit("_"), "to_state").alias("metric"),
            F.col("freq").cast("double").alias("value"),
        )
        return fixed.unionByName(size).unionByName(loss).unionByName(states).unionByName(steps)
