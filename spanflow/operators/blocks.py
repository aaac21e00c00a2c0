"""Blocks of long recordings, so that no task needs a whole one.

A block is what a recording has in one stretch of its order column: frame numbers or ticks. Work goes on in every block by
itself; what must cross a border is worked out on a table of one row for each block and joined back. Rows without a
recording (null keys) or without a place in its order belong to no block and are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of a block unless said.
SIZE = 1 << 16


def block_of(order: str | Column, size: float) -> Column:
    """The number of the block in which a frame or tick lies."""
    return F.floor((F.col(order) if isinstance(order, str) else order) / size).cast("long")


#: Tasks for each of Spark's shuffle partitions where a step makes many rows of one.
FINER = 4


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over more tasks than other shuffles have, which Spark doesn't merge: what its small shuffled rows
    grow to in the later steps then fits into a task's memory and isn't spilled."""
    return df.repartition(FINER * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def before(per_block: DataFrame, keys: Sequence[str], **sums: str) -> DataFrame:
    """per_block (keys, _b, ...) with the sums of columns over all earlier blocks of the same keys, by new name."""
    w = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return per_block.withColumns({name: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long") for name, c in sums.items()})


def with_positions(df: DataFrame, keys: Sequence[str], order: str, size: int = SIZE, name: str = "_at", ties: Sequence[str] = ()) -> DataFrame:
    """The place of each row among those of its keys, from 0, in the order of a whole-number column: its place in its block
    and the number of rows in earlier blocks."""
    cut = df.withColumn("_b", block_of(order, size)).repartition(*keys, "_b")  # both branches read this shuffle
    inside = cut.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_b").orderBy(order, *ties)) - 1)
    offsets = before(cut.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n")), keys, _before="_n").drop("_n")
    return inside.join(offsets, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_k")).drop("_b", "_k", "_before")


def with_halo(df: DataFrame, place: str, size: int, back: int = 0, ahead: int = 0) -> DataFrame:
    """Rows with `_b`, the block of a place; the last `back` places before a block and the first `ahead` after it are there
    once more with `_own` false. More than a block of halo is taken from several blocks."""
    own = block_of(place, size)
    first, last = block_of(F.col(place) - ahead, size), block_of(F.col(place) + back, size)
    spread = df.withColumn("_b", F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), first), last)))
    return spread.withColumn("_own", F.col("_b") == own)


#: Rows of a block where stretches of ticks are chosen by themselves.
ROWS = 1 << 15


def with_stretches(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column, width: float | None = None, rows: int | None = None) -> DataFrame:
    """df with `_lo`, `_w` and `_many`: where the stretches of its keys begin, how long they are and how many there are. With
    a width, all from 0 on and no bound; else as many equal ones as the keys have multiples of `rows` rows (ROWS unless
    given), in most cases one, for which a count of df is joined back."""
    if width:
        return df.withColumns({"_lo": F.lit(0.0), "_w": F.lit(float(width)), "_many": F.lit(None).cast("long")})
    facts = df.groupBy(*keys).agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"), F.count(F.lit(1)).alias("_rows"))
    span = F.greatest(F.col("_hi") - F.col("_lo"), F.lit(0)).cast("double")
    many = F.ceil(F.col("_rows") / (rows or ROWS)).cast("long")
    facts = facts.withColumns({"_many": many, "_w": F.when(span > 0, span / many).otherwise(1.0)})
    return df.join(facts.drop("_hi", "_rows"), list(keys))


def stretch_of(at: Column) -> Column:
    """The number of the stretch in which `at` lies; of a bounded number of them the first or last holds what lies outside."""
    number = F.floor((at - F.col("_lo")) / F.col("_w")).cast("long")
    held = F.greatest(F.lit(0).cast("long"), F.least(F.col("_many") - 1, number))
    return F.when(number.isNull() | F.col("_many").isNull(), number).otherwise(held)
