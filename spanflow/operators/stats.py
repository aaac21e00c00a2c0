"""Statistics over pieces, recordings and speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn


def activity_stats(pieces: DataFrame, cls: str = "class", keys: tuple = ()) -> DataFrame:
    """Number and total duration of each class's pieces, and their shares."""
    w = Window.partitionBy(*keys)
    df = pieces.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("pieces"), F.sum(F.col("end") - F.col("start")).alias("duration"))
    return df.withColumns({"piece_share": F.col("pieces") / F.sum("pieces").over(w), "duration_share": F.try_divide("duration", F.sum("duration").over(w))})


def combination(active: str | Column, genders: str | Column) -> Column:
    """Sorted genders of those active, as one word."""
    pairs = F.zip_with(active, genders, lambda a, g: F.when(a == 1, g))
    return F.array_join(F.array_sort(F.filter(pairs, lambda g: g.isNotNull())), "")


def gender_stats(pieces: DataFrame, recordings: DataFrame, overlap: bool = False) -> DataFrame:
    """For each recording and combination of active genders: pieces, duration, and its share of the recording.

    overlap: for each combination of the genders that a recording's speakers have instead: recordings, their duration, and
    the shares of the pieces and of the duration in which more than one speaker is active."""
    genders = recordings.select("rec_id", F.transform("speakers", lambda s: s["gender"]).alias("_g"))
    length = F.col("end") - F.col("start")
    if overlap:
        several = F.aggregate("active", F.lit(0), lambda a, x: a + x) > 1
        per = pieces.groupBy("rec_id").agg(
            F.count(F.lit(1)).alias("_n"), F.sum(length).alias("_d"), F.count_if(several).alias("_m"), F.sum(F.when(several, length).otherwise(0)).alias("_o")
        )
        word = F.array_join(F.array_sort(F.filter("_g", lambda g: g.isNotNull())), "").alias("genders")
        of = per.join(genders, "rec_id").groupBy(word)
        return of.agg(F.count(F.lit(1)).alias("recordings"), F.sum("_d").alias("duration"), F.try_divide(F.sum("_m"), F.sum("_n")).alias("overlap_pieces"), F.try_divide(F.sum("_o"), F.sum("_d")).alias("overlap_share"))
    df = pieces.join(genders, "rec_id").withColumn("genders", combination("active", "_g"))
    out = df.groupBy("rec_id", "genders").agg(F.count(F.lit(1)).alias("pieces"), F.sum(length).alias("duration"))
    return out.withColumn("share", F.try_divide("duration", F.sum("duration").over(Window.partitionBy("rec_id"))))


def duration_stats(extents: DataFrame, by: tuple = (), column: str = "duration") -> DataFrame:
    return extents.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(column).alias("total"), F.min(column).alias("least"), F.max(column).alias("most"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("deviation"))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int, weight: str | None = None) -> DataFrame:
    """bin (from 1), n and, with a weight, its sum; the right edge is in the last bin, values outside are left out."""
    counted = [F.count(F.lit(1)).alias("n"), *([F.sum(weight).alias("weight")] if weight else [])]
    return df.withColumn("bin", fn.bin_key(column, lo, hi, bins)).where("bin is not null").groupBy("bin").agg(*counted)


def speaker_counts(recordings: DataFrame) -> DataFrame:
    s = recordings.select(F.explode("speakers").alias("s"))
    return s.agg(F.countDistinct("s").alias("records"), F.countDistinct("s.pin").alias("pins"), F.min("s.pin").alias("least_pin"), F.max("s.pin").alias("most_pin"))


def median(df: DataFrame, value: str | Column, by: tuple = (), bins: int = 4096, passes: int = 3) -> DataFrame:
    """by, median: the exact median of the finite values (null where a group has none), by counting.

    Each pass counts values in equal bins between bounds, which then narrow to the bin that holds the wanted rank; a last
    pass counts the distinct values of that bin. No pass brings a group's values to one task: what is grouped are counts.
    The bounds are two rows a group; Spark decides how they meet the values."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    names = [f"_k{i}" for i in range(len(by))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(by, names, strict=True)), x.alias("_x"))
    groups = rows.select(*names).distinct() if names else df.sparkSession.range(1).select()
    # not null nor NaN either; equal values are one row, and all passes read this shuffle
    rows = rows.where(F.abs("_x") < float("inf")).groupBy(*names, "_x").agg(F.count(F.lit(1)).alias("_c"))
    facts = rows.groupBy(*names).agg(F.sum("_c").alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    wanted = F.array(F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))  # ranks from 0
    goal = facts.where("_n > 0").select(*names, F.posexplode(wanted).alias("_which", "_rank"), "_lo", "_hi")

    def inside(goal: DataFrame) -> DataFrame:
        on = (F.col("_x") >= F.col("_lo")) & (F.col("_x") <= F.col("_hi"))
        for k in names:
            on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"g.{k}"))
        return rows.alias("r").join(goal.alias("g"), on).select(*(F.col(f"g.{k}").alias(k) for k in names), "_which", "_rank", "_lo", "_hi", "_x", "_c")

    def hit(counts: DataFrame, order: str) -> DataFrame:
        """The rows of counts in which the wanted ranks lie, the ranks less what lies before."""
        w = Window.partitionBy(*names, "_which").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        left = counts.withColumn("_rank", F.col("_rank") - F.coalesce(F.sum("_c").over(w), F.lit(0).cast("long")))
        return left.where("_rank >= 0 and _rank < _c")

    for _ in range(passes):
        # halves, so that bounds at both ends of the doubles don't overflow
        place = F.floor((F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * bins)
        place = F.when(F.col("_hi") > F.col("_lo"), F.least(F.lit(bins - 1).cast("long"), place)).otherwise(F.lit(0).cast("long"))
        counts = inside(goal).groupBy(*names, "_which", "_rank", place.alias("_bin")).agg(F.sum("_c").alias("_c"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        goal = hit(counts, "_bin").select(*names, "_which", "_rank", "_lo", "_hi")
    found = hit(inside(goal), "_x").groupBy(*names).agg(F.sum(F.col("_x") / 2).alias("median"))
    on = F.lit(True)
    for k in names:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return groups.alias("a").join(found.alias("b"), on, "left").select(*(F.col(f"a.{k}").alias(c) for k, c in zip(names, by, strict=True)), "median")


def median_duration(pieces: DataFrame, cls: str = "class", **options) -> DataFrame:
    return median(pieces, F.col("end") - F.col("start"), (cls,), **options)


def split_balance(recordings: DataFrame, split: str = "split", group: str = "group_id", duration: str = "duration") -> DataFrame:
    """Groups, files, duration and its share for each split, and in total (null)."""
    df = recordings.rollup(split).agg(F.countDistinct(group).alias("groups"), F.count(F.lit(1)).alias("files"), F.sum(duration).alias("duration"))
    whole = F.max(F.when(F.col(split).isNull(), F.col("duration"))).over(Window.partitionBy())
    return df.withColumn("share", F.try_divide("duration", whole))


def common_rate(segments: DataFrame, by: str = "rec_id", rate: str = "rate") -> DataFrame:
    """Least common multiple of each recording's rates."""
    rates = segments.groupBy(by).agg(F.collect_set(F.col(rate).cast("long")).alias("_r"))
    return rates.select(by, F.aggregate("_r", F.lit(1).cast("long"), fn.lcm).alias("rate"))


def rescale(df: DataFrame, column: str, lo: float = 0.0, hi: float = 1.0, by: tuple = ()) -> DataFrame:
    """Values brought to [lo, hi], over all rows or by keys; missing values stay missing, a constant gives null."""
    x = F.nanvl(F.col(column), F.lit(None).cast("double"))
    if by:
        w = Window.partitionBy(*by)
        df = df.withColumns({"_a": F.min(x).over(w), "_b": F.max(x).over(w)})
    else:  # two numbers; a window without keys would bring all rows to one task
        df = df.join(F.broadcast(df.agg(F.min(x).alias("_a"), F.max(x).alias("_b"))))
    return df.withColumn(column, lo + F.try_divide(x - F.col("_a"), F.col("_b") - F.col("_a")) * (hi - lo)).drop("_a", "_b")
