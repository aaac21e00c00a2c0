"""Sampling of frames and plans of training batches. Seeded orders are by hash, so they repeat on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames as R


def _draw(seed: int, *columns: str) -> Column:
    """A fixed draw for a seed and some columns: the MD5 of their texts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(c).cast("string") for c in columns)))


def batch_plan(frames: DataFrame, passes: int, seed: int | None = None, keys: tuple = ("rec_id", "chunk_id"), start: tuple = (0, 0), steps: int | None = None, first: int = 0) -> DataFrame:
    """pass, chunk_pos and keys: in which order each pass takes the chunks; from (pass, chunk) `start` on. With steps also
    step and its number of rows, as assign_steps() makes them. first: so many of the keys are drawn by themselves before the
    others, so that a pass takes all chunks of one value (such as a range of a store's chunks) before those of the next.

    Chunks are numbered within parts (recordings, or the first digits of the draw), and the parts' sizes are summed up, so
    that no task orders all chunks."""
    chunks = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")).withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    if seed is None:
        chunks, order = chunks.withColumn("_part", F.col(keys[0])), [*keys]
    else:
        chunks = chunks.withColumns({"_first": _draw(seed, "pass", *keys[:first]) if first else F.lit(""), "_draw": _draw(seed, "pass", *keys)})
        chunks, order = chunks.withColumn("_part", F.substring("_first" if first else "_draw", 1, 3)), ["_first", "_draw", *keys]
    parts = chunks.groupBy("pass", "_part").agg(F.count(F.lit(1)).alias("_n"))
    parts = parts.select("pass", "_part", (F.sum("_n").over(Window.partitionBy("pass").orderBy("_part")) - F.col("_n")).alias("_before"))
    here = F.row_number().over(Window.partitionBy("pass", "_part").orderBy(*order)) - 1
    plan = chunks.join(parts, ["pass", "_part"]).withColumn("chunk_pos", (F.col("_before") + here).cast("int"))
    plan = plan.where((F.col("pass") > start[0]) | (F.col("pass") == start[0]) & (F.col("chunk_pos") >= start[1]))
    if steps is None:
        return plan.select("pass", *keys, "chunk_pos")
    n = F.least(F.lit(steps), F.col("_size")).cast("int")
    each = F.floor(F.col("_size") / n)
    cut = plan.withColumn("step", F.explode(F.sequence(F.lit(0), n - 1)))
    return cut.select("pass", *keys, "chunk_pos", "step", F.when(F.col("step") == n - 1, F.col("_size") - each * (n - 1)).otherwise(each).alias("rows"))


def take_plan(plan: DataFrame, frames: DataFrame, keys: tuple = ("rec_id", "chunk_id"), data: bool = True, labels: bool = True, feat: str = "feat", cls: str = "class") -> DataFrame:
    """The plan's frames with their provenance; data only or labels only leaves the other column unread."""
    drop = [c for c, wanted in ((feat, data), (cls, labels)) if not wanted]
    return plan.join(frames.drop(*drop), list(keys))


def shuffle_rows(frames: DataFrame, seed: int, keys: tuple = ("rec_id", "chunk_id")) -> DataFrame:
    """row_pos: a seeded permutation of each chunk's rows, for data and labels alike."""
    w = Window.partitionBy(*keys).orderBy(_draw(seed, *keys, "frame_idx"), "frame_idx")
    return frames.withColumn("row_pos", F.row_number().over(w) - 1)


def subsample(frames: DataFrame, ratios: dict, seed: int | None = None, cls: str | Column = "class", rec: str = "rec_id", order: str = "frame_idx") -> DataFrame:
    """Of each run of one class, its share of rows by class: 0 drops it, 1 (or no ratio) keeps it, else at least one row
    and the whole part of ratio times length, the first ones or seeded random ones. cls: a column or any expression."""
    w = Window.partitionBy(rec).orderBy(order)
    df = frames.withColumn("_cls", F.col(cls) if isinstance(cls, str) else cls)
    new = F.coalesce((~F.col("_cls").eqNullSafe(F.lag("_cls").over(w))).cast("int"), F.lit(1))
    df = df.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(new)).withColumn("_run", F.sum("_new").over(w))
    run = Window.partitionBy(rec, "_run")
    pick = [_draw(seed, rec, order)] if seed is not None else []
    ratio = F.coalesce(F.create_map(*(F.lit(x) for k, v in ratios.items() for x in (k, float(v))))[F.col("_cls")], F.lit(1.0)) if ratios else F.lit(1.0)
    df = df.withColumns({"_n": F.count(F.lit(1)).over(run), "_k": F.row_number().over(run.orderBy(*pick, order)), "_r": ratio})
    keep = F.when(F.col("_r") == 0, 0).when(F.col("_r") == 1, F.col("_n")).otherwise(F.greatest(F.lit(1), F.floor(F.col("_n") * F.col("_r"))))
    return df.where(F.col("_k") <= keep).drop("_cls", "_new", "_run", "_n", "_k", "_r")


def assign_steps(frames: DataFrame, steps: int, keys: tuple = ("rec_id", "chunk_id"), order: str = "frame_idx") -> DataFrame:
    """step: min(steps, n) slices of n div steps rows, the last with the rest."""
    w = Window.partitionBy(*keys)
    df = frames.withColumns({"_n": F.count(F.lit(1)).over(w), "_k": F.row_number().over(w.orderBy(order)) - 1})
    s = F.least(F.lit(steps), F.col("_n"))
    return df.withColumn("step", F.least(F.floor(F.col("_k") / F.floor(F.col("_n") / s)), s - 1).cast("int")).drop("_n", "_k")


def plan_summary(frames: DataFrame, steps: int, keys: tuple = ("rec_id", "chunk_id")) -> DataFrame:
    """Frames, chunks and steps of a pass."""
    per = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.sum("n").alias("frames"), F.count(F.lit(1)).alias("chunks"), F.sum(F.least(F.lit(steps), F.col("n"))).alias("steps"))


def training_batches(frames: DataFrame, context: int = 0, ratios: dict | None = None, seed: int | None = None, steps: int = 1, how: str = "dominant") -> DataFrame:
    """Context, window label, subsampling, shuffling, steps, in this order."""
    df = frames
    if context:
        df = R.window_label(df, context, how, keys=("rec_id", "chunk_id")).withColumn("class", F.col("window_class")).drop("window_class")
        df = R.stack_context(df, context)
    df = subsample(df, ratios or {}, seed)
    if seed is None:
        return assign_steps(df, steps)
    return assign_steps(shuffle_rows(df, seed), steps, order="row_pos")


def assign_splits(recordings: DataFrame, rules: dict, group: str = "group_id") -> DataFrame:
    """split of each group by its place in order: rules has (first, last place, last None: open) for each split. Groups are few, recordings many: only distinct groups are ranked."""
    places = recordings.select(group).distinct().withColumn("_g", F.row_number().over(Window.orderBy(group)) - 1)
    split = F.lit(None).cast("string")
    for name, (lo, hi) in rules.items():
        split = F.when((F.col("_g") >= lo) & (F.lit(True) if hi is None else F.col("_g") <= hi), name).otherwise(split)
    return recordings.join(places.withColumn("split", split).drop("_g"), group)
