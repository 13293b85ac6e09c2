"""Queries of the training-data operators over a data folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segloom.functions.columns import pick
from segloom.llm import frequency as fr
from segloom.llm import leaks, lookalikes, records, spam, tokens
from segloom.sources.tables import table


def lexicon_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon rows that count, each entry once."""
    rows = pick(
        table(spark, sf_dir, "lexicon"),
        entry_id="entry_id", bundle_id="bundle_id", model_name="model_name", morph="morph", state="state", freq="freq",
    )
    rows = rows.where("freq IS NOT NULL AND morph <> ''")
    return fr.once(rows, "entry_id", "bundle_id", "morph", "state")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total, number of bundles and marks of every (morph, state) and every state."""
    n = pick(table(spark, sf_dir, "bundles"), b="bundle_id").agg(F.countDistinct("b")).scalar()
    lexicon = lexicon_rows(spark, sf_dir).withColumn("field", F.lit("lexicon"))
    states = pick(table(spark, sf_dir, "state_freq"), bundle_id="bundle_id", state="state", freq="freq")
    states = fr.once(states.where("freq > 0"), "bundle_id", "state")
    states = states.select(F.lit("state_freq").alias("field"), F.lit("").alias("morph"), "bundle_id", "state", "freq")
    tokens_ = lexicon.select("field", "morph", "bundle_id", "state", "freq").unionByName(states)
    counts = fr.last_seen(tokens_, ["field", "morph", "state"], "bundle_id", F.col("freq"))
    return fr.marked(counts, n).drop("last_record")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.array_compact(
        F.array(F.when(F.col("rare"), F.lit("rare")), F.when(F.col("common"), F.lit("common")))
    )
    return p1_terms(spark, sf_dir).select("field", "morph", "state", F.explode(marks).alias("mark"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "partition_lines")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.same_records(_lines(spark, sf_dir))


def p2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its number of copies."""
    return records.collapse(_lines(spark, sf_dir))


def _top(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = fr.top_k(lexicon_rows(spark, sf_dir), "morph", F.col("freq"))
    rows = pick(table(spark, sf_dir, "segmented"), seg_id="seg_id", segment="segment").where("segment IS NOT NULL")
    morphs = fr.once(rows, "seg_id").select(F.explode("segment.morph").alias("morph"))
    segmented = fr.top_k(morphs, "morph", F.lit(1))
    return lexicon.withColumn("field", F.lit("lexicon")).unionByName(
        segmented.withColumn("field", F.lit("segmented_corpus"))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _top(spark, sf_dir).select("field", "morph")


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent morphs with their counts."""
    return _top(spark, sf_dir).select("field", "morph", "occurrences")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pick(_lines(spark, sf_dir), id="line_id", text="dataset")
    chars = pick(table(spark, sf_dir, "charset_entries"), id="charset_id", model="model_name", text="ch")
    return lines.select(F.lit("partition_lines").alias("scope"), "id", "text").unionByName(
        chars.select(F.concat(F.lit("charset_entries/"), "model").alias("scope"), "id", "text")
    ).where("scope IS NOT NULL")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = F.substring_index("scope", "/", 1).alias("origin")
    return lookalikes.pairs(_stored(spark, sf_dir)).select(origin, "id_a", "id_b")


def p4_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text that has a visible character, in its consistent form."""
    rows = lookalikes.consistent(_stored(spark, sf_dir).where("text IS NOT NULL")).where(lookalikes.visible())
    origin = F.substring_index("scope", "/", 1).alias("origin")
    return rows.select(origin, "id", "text", "form").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("freq").desc(), F.col("morph"), F.col("bundle_id"), F.col("entry_id")]
    top = fr.top_n_in_groups(lexicon_rows(spark, sf_dir), ["model_name", "state"], order)
    return top.select("model_name", "state", "entry_id")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(_documents(spark, sf_dir))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "benchmark"), _documents(spark, sf_dir))


def p7_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest overlap of each item and document that share a seed, substitutions tolerated."""
    found = leaks.overlaps(table(spark, sf_dir, "benchmark"), _documents(spark, sf_dir))
    best = F.max(F.struct(F.col("length") - F.col("substituted"), "run", "length", "substituted")).alias("best")
    return found.groupBy("item_id", "doc_id").agg(best).select(
        "item_id", "doc_id", "best.run", "best.length", "best.substituted"
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(_documents(spark, sf_dir))


def p8_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's measures and kind."""
    return spam.judge(_documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Queries by name."""
    return {
        f.__name__: f
        for f in (
            p1_found, p1_terms, p2_found, p2_records, p3_found, p3_counts, p4_found, p4_forms, p5_found, p6_ids,
            p7_found, p7_overlaps, p8_found, p8_measures,
        )
    }
