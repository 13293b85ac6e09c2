"""Records that differ in formatting only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segloom.functions.columns import pick
from segloom.session import cut

#: Hashes are added modulo 2^62, so that no sum overflows.
_MASK = (1 << 62) - 1
#: Above so many fields, equality is verified by sorting, as counting takes quadratic time.
MANY = 64
#: A class is hot if it has more lines than this and than a thousandth of all repeated lines.
HOT = 10_000
SALTS = 16


def normal_fields(line: Column, separators: str = r"[\t;|]") -> Column:
    """Non-empty fields, each as its letters, marks and numbers without letter case.

    A field's name and value are hashed as one text, since what stands between them is formatting.
    The two forms of small sigma are one letter.
    """
    plain = F.translate(F.lower(line), "ς", "σ")
    fields = F.transform(F.split(plain, separators), lambda f: F.regexp_replace(f, r"[^\p{L}\p{M}\p{N}]+", ""))
    return F.filter(fields, lambda f: f != "")


def multiset_hash(fields: Column) -> Column:
    """A hash of the fields that doesn't depend on their order but on how often each is there."""

    def total(salt: int) -> Column:
        return F.aggregate(
            fields,
            F.lit(0).cast("bigint"),
            lambda acc, f: (acc + F.xxhash64(f, F.lit(salt)).bitwiseAND(F.lit(_MASK))).bitwiseAND(F.lit(_MASK)),
        )

    return F.struct(F.size(fields).alias("n"), total(1).alias("a"), total(2).alias("b"))


def same_multiset(x: Column, y: Column) -> Column:
    """Whether two arrays have the same elements equally often; sorts only beyond ``MANY`` elements."""
    counted = F.forall(
        F.array_distinct(x),
        lambda v: F.size(F.filter(x, lambda e: e == v)) == F.size(F.filter(y, lambda e: e == v)),
    )
    return (x == y) | (
        (F.size(x) == F.size(y))
        & F.when(F.size(x) <= MANY, counted).otherwise(F.array_sort(x) == F.array_sort(y))
    )


def fingerprints(lines: DataFrame, line_id: str = "line_id", text: str = "dataset") -> DataFrame:
    """``id``, ``fields`` and ``print`` of the lines that have an id and any letter, mark or number."""
    fields = pick(lines, id=line_id, text=text).select("id", normal_fields(F.col("text")).alias("fields"))
    return fields.where((F.size("fields") > 0) & F.col("id").isNotNull()).withColumn("print", multiset_hash(F.col("fields")))


def _members(prints: DataFrame) -> DataFrame:
    """``id`` and ``record_id`` of every line in a fingerprint of several lines, ``record_id`` being the smallest.

    The copies of one record may be a third of all lines. Aggregation combines them before the
    shuffle; for the join that tells each line its record, lines of hot classes are spread over
    ``SALTS`` tasks, and only hot classes' representatives are repeated. There are fewer than a
    thousand hot classes, whatever the input, so their fingerprints are broadcast.
    """
    classes = cut(
        prints.groupBy("print")
        .agg(F.min(F.struct("id", "fields")).alias("first"), F.max("id").alias("last"), F.count("*").alias("lines"))
        .where(F.col("first.id") < F.col("last"))
    )
    bound = classes.agg(F.greatest(F.lit(HOT), F.coalesce(F.sum("lines"), F.lit(0)) / 1000)).scalar()
    hot = classes.where(F.col("lines") > bound)
    salts = F.when(F.col("lines") > bound, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    firsts = classes.select("print", "first", F.explode(salts).alias("salt"))
    spread = prints.join(F.broadcast(hot.select("print", F.lit(True).alias("hot"))), "print", "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    )
    found = spread.join(firsts, ["print", "salt"])
    equal = same_multiset(F.col("fields"), F.col("first.fields"))
    # Lines of one fingerprint that differ all the same form classes of their own, by their fields.
    return found.select(
        "id",
        F.when(equal, F.col("first.id")).alias("record_id"),
        F.when(~equal, F.array_sort("fields")).alias("other"),
    )


def same_records(lines: DataFrame, line_id: str = "line_id", text: str = "dataset") -> DataFrame:
    """``record_id`` and ``line_id`` of each line that repeats an earlier record in any formatting.

    A field's hash stands for its letters, marks and numbers; the fields' hashes are added, which
    makes the order of fields irrelevant and needs no sorting; lines are grouped by the sum and
    their fields are compared with those of the group's smallest line. Lines delivered again count
    once. Null and blank lines, and lines of other characters only, are no records; an empty table
    gives no row.
    """
    members = cut(_members(fingerprints(lines, line_id, text)))
    strays = members.where("other IS NOT NULL")
    own = strays.groupBy("other").agg(F.min("id").alias("record_id"))
    rest = strays.drop("record_id").join(own, "other").select("record_id", "id")
    return (
        members.where("other IS NULL").select("record_id", "id").unionByName(rest)
        .where("record_id < id").distinct().withColumnRenamed("id", "line_id")
    )


def collapse(lines: DataFrame, line_id: str = "line_id", text: str = "dataset") -> DataFrame:
    """One row for each record: ``record_id`` and ``copies``, the number of its lines."""
    ids = fingerprints(lines, line_id, text).select("id").distinct()
    repeats = same_records(lines, line_id, text)
    more = repeats.groupBy("record_id").agg((F.count("*") + 1).alias("copies"))
    firsts = ids.join(repeats, F.col("id") == F.col("line_id"), "left_anti")
    return firsts.join(more, F.col("id") == F.col("record_id"), "left").select(
        F.col("id").alias("record_id"), F.coalesce("copies", F.lit(1)).cast("bigint").alias("copies")
    )
