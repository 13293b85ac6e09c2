"""Word lists as DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segloom.functions.columns import pick
from segloom.functions.draws import draw

# Fixed value: what ends a line besides carriage return and line feed.
LINE_ENDS = "[\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """``word`` for each line of UTF-8 text files, in lower case; repeated lines stay, blank ones go.

    Lines aren't stripped. A line is blank if it is empty or of white space only.
    """
    lines = spark.read.text(path).select(F.explode(F.split("value", LINE_ENDS)).alias("word"))
    return lines.select(F.lower("word").alias("word")).where(F.trim("word") != "")


def words_of_texts(texts: DataFrame, text: str = "text") -> DataFrame:
    """``word`` for each run of letters of each text, in lower case. Null and empty texts have none."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    return pick(texts, text=text).select(F.explode(found).alias("word"))


def words_of_lines(lines: DataFrame, line: str = "dataset") -> DataFrame:
    """``word`` for each line that isn't null or blank, in lower case."""
    return pick(lines, word=line).select(F.lower("word").alias("word")).where(F.trim("word") != "")


def counted(words: DataFrame) -> DataFrame:
    """The corpus as a bag: ``word`` and ``n``, how often it is there. Null and empty words go.

    Words that are there often are combined before the shuffle.
    """
    return words.where(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))


def charset(words: DataFrame) -> DataFrame:
    """``ch``: the distinct characters of the words."""
    return words.select(F.explode(F.split("word", "")).alias("ch")).where("ch <> ''").distinct()


def within_charset(word: Column, chars: Iterable[str]) -> Column:
    """Whether a word has no other characters; true for the empty word."""
    return F.size(F.array_except(F.split(word, ""), F.array(F.lit(""), *[F.lit(c) for c in sorted(set(chars))]))) == 0


def filter_charset(words: DataFrame, chars: Iterable[str]) -> DataFrame:
    """Words of these characters only; others are dropped, as when a character set is given for training."""
    return words.where(within_charset(F.col("word"), chars))


def numbered(rows: DataFrame, u: Column, *order: str, buckets: int = 4096) -> DataFrame:
    """``rows`` with ``rn``, their number from 0 in the order of the draw ``u`` and of ``order``.

    No task sees all rows: they are put into buckets by the draw, whose sizes add up to the first
    numbers of the buckets; there are ``buckets`` of these sizes, whatever the input.
    """
    drawn = rows.withColumn("_u", u).withColumn("_bucket", F.floor(F.col("_u") * buckets).cast("int"))
    sizes = drawn.groupBy("_bucket").agg(F.count("*").alias("_size"))
    before = F.coalesce(
        F.sum("_size").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    firsts = sizes.select("_bucket", before.alias("_first"))
    within = F.row_number().over(Window.partitionBy("_bucket").orderBy("_u", *order)) - 1
    return (
        drawn.withColumn("rn", within)
        .join(F.broadcast(firsts), "_bucket")
        .withColumn("rn", F.col("rn") + F.col("_first"))
        .drop("_u", "_bucket", "_first")
    )


def split_balanced(words: DataFrame, parts: int, seed: int = 0, key: str = "word") -> DataFrame:
    """Words shuffled by draws and split into parts 0 .. parts-1, with ``pid``.

    All parts have floor(count / parts) words, the first ones one more. There may be fewer words
    than parts; then some parts are empty.
    """
    rows = numbered(words, draw(seed, "shuffle", 0, F.col(key)), key)
    size = F.floor(F.lit(rows.agg(F.count("*")).scalar()) / parts)
    even = F.col("rn") < size * parts
    pid = F.when(even, F.floor(F.col("rn") / F.greatest(size, F.lit(1)))).otherwise(F.col("rn") - size * parts)
    return rows.withColumn("pid", pid.cast("int"))


def split_fraction(words: DataFrame, fraction: float, seed: int = 0, epoch: int = 0, key: str = "word") -> DataFrame:
    """Words with ``at_random``: false for the first floor(count * (1 - fraction)) in the order of draws."""
    rows = numbered(words, draw(seed, "fraction", epoch, F.col(key)), key)
    first = F.floor(F.lit(rows.agg(F.count("*")).scalar()) * (1 - fraction))
    return rows.withColumn("at_random", F.col("rn") >= first).drop("rn")
