"""Confusion matrices as long tables (keys, true, pred, n), precision and recall, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align(true: DataFrame, pred: DataFrame, keys: tuple = ("rec_id", "frame_idx")) -> DataFrame:
    """Truth and prediction of the same frames."""
    return true.join(pred, list(keys))


def _grid(counts: DataFrame, keys: tuple, nclasses: int | None) -> DataFrame:
    """All cells of each key from the counts (keys, true, pred, n) that occur; keys may be null."""
    k = F.lit(nclasses) if nclasses is not None else F.col("_k")
    per = counts.groupBy(*keys).agg(F.collect_list(F.struct("true", "pred", "n")).alias("_cells"))
    if nclasses is None:  # one row with the number of classes
        per = per.join(F.broadcast(counts.agg((F.coalesce(F.max(F.greatest("true", "pred")), F.lit(-1)) + 1).cast("int").alias("_k"))))
    of = F.map_from_entries(F.transform("_cells", lambda c: F.struct(c["true"] * k + c["pred"], c["n"])))
    cells = per.withColumn("_n", of).withColumn("_c", F.explode(F.when(k > 0, F.sequence(F.lit(0), k * k - 1)).otherwise(F.array().cast("array<int>"))))
    return cells.select(*keys, F.floor(F.col("_c") / k).cast("int").alias("true"), (F.col("_c") % k).cast("int").alias("pred"), F.coalesce(F.try_element_at("_n", "_c"), F.lit(0).cast("long")).alias("n"))


def confusion(aligned: DataFrame, keys: tuple = (), nclasses: int | None = None, true: str | Column = "true", pred: str | Column = "pred", n: Column | None = None) -> DataFrame:
    """Counts of each (keys, true, pred), with a 0 for cells that don't occur; a class of nclasses or more is an error.
    true, pred: columns or any expressions; n: another aggregate than the count, as long as it is a whole number."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    bad = F.raise_error(F.lit("class out of range"))
    least = lambda c: (c >= 0) if nclasses is None else c.between(0, nclasses - 1)
    inside = lambda c: F.when(least(col(c)), col(c)).otherwise(bad).cast("int")
    rows = aligned.withColumns({"_true": inside(true), "_pred": inside(pred)})
    counts = rows.groupBy(*keys, "_true", "_pred").agg((F.count(F.lit(1)) if n is None else n).cast("long").alias("n"))
    return _grid(counts.select(*keys, F.col("_true").alias("true"), F.col("_pred").alias("pred"), "n"), keys, nclasses)


def normalize_confusion(conf: DataFrame, keys: tuple = ()) -> DataFrame:
    """precision (share of the predicted class) and recall (share of the true class); null for an empty class."""
    total = lambda c: F.sum("n").over(Window.partitionBy(*keys, c))
    return conf.withColumns({"precision": F.try_divide("n", total("pred")), "recall": F.try_divide("n", total("true"))})


def evaluate(aligned: DataFrame, each: str = "rec_id", variants: tuple = ("pred",), nclasses: int = 3) -> DataFrame:
    """Confusions with precision and recall of each recording (also of the null one) and in total (is_total), for one or more
    predictions. Rows are counted once; the totals are sums of the recordings' counts."""
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.col(v).alias("pred")) for v in variants)))
    df = aligned.select(each, "true", rows.alias("_v")).select(each, "true", "_v.*")
    conf = confusion(df, ("variant", each), nclasses).withColumn("is_total", F.lit(False))
    total = F.struct(F.lit(True).alias("is_total"), F.lit(None).cast(conf.schema[each].dataType).alias(each))
    own = F.struct(F.lit(False).alias("is_total"), F.col(each).alias(each))
    both = conf.select("variant", "true", "pred", "n", F.explode(F.array(own, total)).alias("_g")).select("variant", "_g.*", "true", "pred", "n")
    sums = both.groupBy("variant", "is_total", each, "true", "pred").agg(F.sum("n").alias("n"))
    return normalize_confusion(sums, ("variant", "is_total", each)).select("variant", "is_total", each, "true", "pred", "n", "precision", "recall")


def confusion_history(aligned: DataFrame, keys: tuple = ("pass", "epoch"), nclasses: int = 3) -> DataFrame:
    return normalize_confusion(confusion(aligned, keys, nclasses), keys)


def class_distribution(frames: DataFrame, cls: str = "class", keys: tuple = ()) -> DataFrame:
    """n and share of each class."""
    counts = frames.groupBy(*keys, cls).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))
