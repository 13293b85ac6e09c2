"""Segmented words as text: ``morph state morph state ...<TAB>cost``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """``word``, ``segment``, ``cost`` of the lines.

    Lines are stripped; those without one tab exactly, or with fewer than two tokens, are skipped;
    an odd token at the end is ignored.
    """
    text = F.split(F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")), "\t")
    tokens = F.split(F.trim(F.col("parts")[0]), " ")
    pairs = F.transform(
        F.sequence(F.lit(1), F.floor(F.size("tokens") / 2).cast("int")),
        lambda i: F.struct(
            F.element_at("tokens", i * 2 - 1).alias("morph"), F.element_at("tokens", i * 2).cast("int").alias("state")
        ),
    )
    rows = lines.select(text.alias("parts")).where(F.size("parts") == 2)
    rows = rows.select(tokens.alias("tokens"), F.col("parts")[1].cast("double").alias("cost"))
    rows = rows.where(F.size("tokens") >= 2).select(pairs.alias("segment"), "cost")
    word = F.array_join(F.transform("segment", lambda x: x["morph"]), "")
    return rows.select(word.alias("word"), "segment", "cost")


def read_segmented(spark: SparkSession, path: str) -> DataFrame:
    """Segmented words of text files, in the order of no line; repeated words stay."""
    return parsed(spark.read.text(path))


def rendered_line() -> Column:
    """The text line of ``segment`` and ``cost``."""
    tokens = F.transform("segment", lambda x: F.concat(x["morph"], F.lit(" "), x["state"].cast("string")))
    return F.concat(F.array_join(tokens, " "), F.lit("\t"), F.format_string("%.4f", F.col("cost")))


def rendered(segmented: DataFrame) -> DataFrame:
    """``word``, ``line``, a row a word.

    The word is spelled by its morphs, a word boundary included. Of equal words the one of the
    largest ``seq`` counts, or without such a column the largest segment. A morph with a blank
    can't be written in this format and is an error; words without a segment are left out.
    """
    seq = F.col("seq") if "seq" in segmented.columns else F.lit(0)
    word = F.array_join(F.transform("segment", lambda x: x["morph"]), "")
    last = F.max(F.struct(seq.alias("seq"), "segment", "cost")).alias("last")
    one = segmented.where(F.size("segment") > 0).groupBy(word.alias("word")).agg(last)
    one = one.select("word", "last.segment", "last.cost")
    blank = F.exists("segment", lambda x: x["morph"].rlike(r"\s"))
    error = F.raise_error(F.concat(F.lit("a morph has a blank: "), F.col("word"))).cast("string")
    return one.select("word", F.when(blank, error).otherwise(rendered_line()).alias("line"))


def write_segmented(segmented: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes text files, ordered by word over all files."""
    rendered(segmented).orderBy("word").select("line").write.mode(mode).text(path)
