"""Operators on tables of frames (rec_id, frame_idx, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B
from . import segments as S


def frame_centres(catalog: DataFrame, hop: int, win: int) -> DataFrame:
    """rec_id, frame_idx, t: the centre sample of each frame; recordings shorter than a window have none."""
    n = F.floor((F.col("samples") - win) / hop)
    ok = catalog.where(F.col("samples") >= win)
    return ok.select("rec_id", F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("frame_idx")).withColumn("t", (F.col("frame_idx") * hop + win // 2).cast("double"))


def frame_labels(segments: DataFrame, catalog: DataFrame, hop: int, win: int, label: str = "active") -> DataFrame:
    """The label at every frame's centre, recordings moved to start at 0; segments must be contiguous."""
    return S.label_at(frame_centres(catalog, hop, win), S.shift_to(segments, 0), label)


def check_frames(frames: DataFrame, catalog: DataFrame, hop: int, win: int) -> DataFrame:
    """Recordings whose number of frames isn't what their samples ask for."""
    have = frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n"))
    want = catalog.select("rec_id", F.greatest(F.lit(0), F.floor((F.col("samples") - win) / hop) + 1).alias("want"))
    return have.join(want, "rec_id", "full_outer").where("not (n <=> want)")


def check_chunks(chunked: DataFrame, size: int, keys: tuple = ("rec_id", "chunk_id"), feat: str | None = None, dims: int | None = None) -> DataFrame:
    """keys, n and problem: chunks that don't hold `size` rows in unbroken order, or rows of other than `dims` numbers."""
    wide = F.count_if(F.size(feat) != dims) if feat and dims else F.lit(0)
    per = chunked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), (F.max("frame_idx") - F.min("frame_idx") + 1).alias("_span"), wide.alias("_wide"))
    faults = F.array(F.when(F.col("n") != size, "size"), F.when(F.col("_span") != F.col("n"), "gap"), F.when(F.col("_wide") > 0, "dimensions"))
    return per.select(*keys, "n", F.explode(F.filter(faults, lambda x: x.isNotNull())).alias("problem"))


def check_recordings(catalog: DataFrame, segments: DataFrame, samples: DataFrame | None = None, rate: int = 8000, channels: int = 1, tolerance: float = 1e-3) -> DataFrame:
    """rec_id and check: a row for each check that a recording fails."""
    ends = segments.groupBy("rec_id").agg(F.max(F.col("end") / F.col("rate")).alias("_end"))
    df = catalog.join(ends, "rec_id", "left")
    faults = [F.when(F.col("rate") != rate, "rate"), F.when(F.col("channels") != channels, "channels"), F.when(F.col("samples") < F.col("_end") * F.col("rate"), "shorter than its labels")]
    if samples is not None:
        total = lambda f: F.aggregate("samples", F.lit(0.0), f)
        per = samples.groupBy("rec_id").agg(F.max(F.aggregate("samples", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))).alias("_peak"), (F.sum(total(lambda a, x: a + x)) / F.sum(F.size("samples"))).alias("_mean"))
        df = df.join(per, "rec_id", "left")
        faults += [F.when(F.col("_peak") > 1, "amplitude"), F.when(F.abs("_mean") > tolerance, "mean")]
    return df.select("rec_id", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("check"))


def force_class(posteriors: DataFrame, truth: str = "true", cls: int = 0, n: int = 3, probs: str = "probs") -> DataFrame:
    """Where the truth is the class, its posterior is 1."""
    sure = F.array(*(F.lit(float(i == cls)) for i in range(n)))
    return posteriors.withColumn(probs, F.when(F.col(truth) == cls, sure).otherwise(F.col(probs)))


def activity_class(active: str | Column = "active", hi: int = 2) -> Column:
    """Number of active speakers, at most hi."""
    return F.least(F.aggregate(active, F.lit(0), lambda a, x: a + x), F.lit(hi))


def with_swapped(frames: DataFrame, columns: tuple = ("feat",)) -> DataFrame:
    """Every two-channel row once more with its channels reversed; other numbers of channels are an error."""
    two = {c: F.when(F.size(c) != 2, F.raise_error(F.lit("not two channels"))).otherwise(F.reverse(c)) for c in columns}
    return frames.withColumn("swapped", F.lit(False)).unionByName(frames.withColumns(two).withColumn("swapped", F.lit(True)))


def labels_as(df: DataFrame, kind: str, column: str = "label") -> DataFrame:
    return df.withColumn(column, F.col(column).cast(kind))


def runs(
    frames: DataFrame, key: str | Column, keep: str = "keys", label: str | None = None, min_start: int = 0, rate: int | None = None, rec: str = "rec_id", order: str = "frame_idx", size: int = B.SIZE
) -> DataFrame:
    """Runs of neighbouring frames with equal keys: rec, run, start, end, and key, labels, or both; with a rate, which must be a
    whole number, also that. The key may be a column or any expression, also of arrays.

    Blocks of `size` numbers of `order` are cut into runs by themselves; a table of their first and last keys, frames and
    runs then tells which runs go on over a border and how many came before."""
    if rate is not None and (rate != int(rate) or rate <= 0):
        raise ValueError("the rate must be a whole number above 0")
    w = Window.partitionBy(rec, "_b").orderBy(order)
    at = Window.partitionBy(rec, "_b").orderBy("_k")
    listed = keep in ("labels", "both")
    cols = [rec, order, (F.col(key) if isinstance(key, str) else key).alias("_key"), *([F.col(label or order).alias("_label")] if listed else [])]
    df = frames.select(*cols).withColumn("_b", B.block_of(order, size)).withColumn("_k", F.row_number().over(w) - 1)
    first = (F.col("_k") == 0) | ~F.col("_key").eqNullSafe(F.lag("_key").over(at))
    df = df.withColumns({"_new": first, "_last": F.lead("_k").over(at).isNull()})
    if listed:
        df = df.withColumn("_run", F.sum(F.col("_new").cast("int")).over(at))
        parts = df.groupBy(rec, "_b", "_run").agg(F.min("_k").alias("_k"), F.max(F.when(F.col("_last"), F.col("_k") + 1)).alias("_n"), F.first("_key").alias("_key"), F.sort_array(F.collect_list(F.struct("_k", "_label")))["_label"].alias("labels"))
    else:  # a run's first row, and how many rows the block has with the last run's
        df = df.where("_new or _last").withColumn("_n", F.coalesce(F.when(F.col("_last"), F.col("_k") + 1), F.when(F.lead("_new").over(at), F.lit(None)).otherwise(F.lead("_k").over(at) + 1)))
        parts = df.where("_new").withColumn("_run", F.row_number().over(at)).select(rec, "_b", "_run", "_k", "_n", "_key")
    parts = parts.where(F.col(rec).isNotNull() & F.col("_b").isNotNull()).repartition(rec, "_b")  # both branches read this shuffle
    head = parts.groupBy(rec, "_b").agg(F.max("_n").alias("_frames"), F.max("_run").alias("_runs"), F.min_by("_key", "_run").alias("_head"), F.max_by("_key", "_run").alias("_tail"), F.min(F.when(F.col("_run") == 2, F.col("_k"))).alias("_second"))
    over = Window.partitionBy(rec).orderBy("_b")
    goes_on = F.lag("_runs").over(over).isNotNull() & F.lag("_tail").over(over).eqNullSafe(F.col("_head"))
    head = B.before(head.withColumn("_on", goes_on.cast("int")).withColumn("_more", F.col("_runs") - F.col("_on")), [rec], _past="_frames", _before="_more")
    # where the run that is open at a block's end ends: at the first run that begins in a later block, or after the last frame
    begins = F.col("_past") + F.when(F.col("_on") == 0, F.lit(0)).otherwise(F.col("_second"))
    later = over.rowsBetween(1, Window.unboundedFollowing)
    whole = F.max(F.col("_past") + F.col("_frames")).over(Window.partitionBy(rec))
    head = head.withColumn("_begins", begins).withColumn("_until", F.coalesce(F.first("_begins", ignorenulls=True).over(later), whole))
    placed = parts.join(head.select(rec, "_b", "_on", "_past", "_before", "_until"), [rec, "_b"])
    run, start = F.col("_before") + F.col("_run") - F.col("_on") - 1, F.col("_past") + F.col("_k")
    end = F.when(F.col("_n").isNotNull(), F.col("_until")).otherwise(F.col("_past") + F.lead("_k").over(Window.partitionBy(rec, "_b").orderBy("_run")))
    placed = placed.select(rec, run.alias("run"), (start + min_start).cast("long").alias("start"), (end + min_start).cast("long").alias("end"), "_key", ((F.col("_run") == 1) & (F.col("_on") == 1)).alias("_more"), *(["labels"] if listed else []))
    kept = [F.first("_key").alias("key")] if keep == "both" else []
    if listed:
        done = placed.groupBy(rec, "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), *kept, F.flatten(F.sort_array(F.collect_list(F.struct("start", "labels")))["labels"]).alias("labels"))
    else:
        done = placed.where(~F.col("_more")).select(rec, "run", "start", "end", F.col("_key").alias("key"))
    return done if rate is None else done.withColumn("rate", F.lit(int(rate)).cast("long"))


def stack_context(frames: DataFrame, c: int, keys: tuple = ("rec_id", "chunk_id"), feat: str = "feat") -> DataFrame:
    """context: the frames from c before to c after each frame of a chunk; frames without a full window are dropped."""
    w = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-c, c)
    return frames.withColumn("context", F.collect_list(feat).over(w)).where(F.size("context") == 2 * c + 1)


def rolling(df: DataFrame, fn, win: int, step: int = 1, keys: tuple = ("rec_id",), order: str = "frame_idx", name: str = "value", size: int = B.SIZE) -> DataFrame:
    """fn (an aggregate expression, or several by name) over full windows that start at each step-th row.

    Rows are worked on in blocks of `size` places, with the win - 1 rows after each block."""
    placed = B.with_halo(B.with_positions(df, keys, order, size), "_at", size, ahead=win - 1)
    full = Window.partitionBy(*keys, "_b").orderBy("_at").rowsBetween(0, win - 1)
    made = fn if isinstance(fn, dict) else {name: fn}
    out = placed.withColumns({**{k: f.over(full) for k, f in made.items()}, "_n": F.count(F.lit(1)).over(full)})
    return out.where((F.col("_n") == win) & F.col("_own") & (F.col("_at") % step == 0)).drop("_n", "_at", "_b", "_own")


def windows(values: str | Column, win: int | tuple, step: int | tuple) -> Column:
    """Strided windows of an array: (n - win) // step + 1 of them; a window longer than the array is an error. With several
    numbers, windows of nested arrays: by the first over the outer array, by the others over what is in it, each window
    holding the windows of its rows."""
    v = F.col(values) if isinstance(values, str) else values
    wins, steps = (win if isinstance(win, tuple) else (win,)), (step if isinstance(step, tuple) else (step,))
    if len(wins) > 1:
        v = F.transform(v, lambda row: windows(row, wins[1:], steps[1:]))
    cut = F.transform(F.sequence(F.lit(0), F.size(v) - wins[0], F.lit(steps[0])), lambda i: F.slice(v, i + 1, wins[0]))
    return F.when(F.size(v) < wins[0], F.raise_error(F.lit("the window is longer than the data"))).otherwise(cut)


def normalize_rolling(
    frames: DataFrame, win: int, std: bool = True, first: str | tuple = "skip", column: str = "value", keys: tuple = ("rec_id",), order: str = "frame_idx", size: int = B.SIZE, dims: int | None = None
) -> DataFrame:
    """Value less the mean of the last `win` rows, by their population deviation. The first win - 1 rows are dropped
    (skip), take the first full window's figures (copy), or given ones (mean, variance). A deviation of 0 gives null.
    dims: the column holds vectors of so many numbers, each of which is a value by itself.

    Rows are worked on in blocks of `size` places, with the win - 1 rows before each block."""
    placed = B.with_halo(B.with_positions(frames, keys, order, size), "_at", size, back=win - 1)
    last = Window.partitionBy(*keys, "_b").orderBy("_at").rowsBetween(-(win - 1), 0)
    values = [F.col(column)] if dims is None else [F.col(column)[i] for i in range(dims)]
    figures = F.array(*(F.struct(F.avg(x).over(last).alias("m"), F.stddev_pop(x).over(last).alias("s")) for x in values))
    df = placed.withColumn("_f", figures).where("_own")
    full = F.col("_at") >= win - 1
    if first == "skip":
        df = df.where(full)
    elif first == "copy":
        if win <= size:  # the first full window ends in the block of the rows before it
            copied = F.first(F.when(F.col("_at") == win - 1, F.col("_f")), ignorenulls=True).over(Window.partitionBy(*keys, "_b"))
            df = df.withColumn("_f", F.when(full, F.col("_f")).otherwise(copied))
        else:
            known = df.where(F.col("_at") == win - 1).select(*keys, F.col("_f").alias("_f0"))
            early = df.where(~full).join(known, list(keys), "left").withColumn("_f", F.col("_f0")).drop("_f0")
            df = df.where(full).unionByName(early)
    else:
        given = F.struct(F.lit(float(first[0])).alias("m"), F.lit(float(first[1]) ** 0.5).alias("s"))
        df = df.withColumn("_f", F.when(full, F.col("_f")).otherwise(F.array(*[given] * len(values))))
    done = [F.try_divide(x - f["m"], f["s"]) if std else x - f["m"] for x, f in ((x, F.col("_f")[i]) for i, x in enumerate(values))]
    return df.withColumn(column, done[0] if dims is None else F.array(*done)).drop("_at", "_b", "_own", "_f")


def assign_chunks(frames: DataFrame, size: int, overlap: int = 0, drop_tail: bool = True, rec: str = "rec_id") -> DataFrame:
    """chunk_id and chunk_start. Without overlap the last chunk is short; with it chunk k holds [k * step, k * step + size)
    with step = size - overlap, a frame is in each chunk that holds it, and a tail that fills no chunk is dropped."""
    if not overlap:
        return frames.withColumn("chunk_id", F.floor(F.col("frame_idx") / size)).withColumn("chunk_start", F.col("chunk_id") * size)
    step, i = size - overlap, F.col("frame_idx")
    low, high = F.greatest(F.lit(0).cast("long"), F.ceil((i - size + 1) / step)), F.floor(i / step)
    df = frames
    if drop_tail:
        df = df.join(frames.groupBy(rec).agg(F.count(F.lit(1)).alias("_n")), rec)
    df = df.where(low <= high).withColumn("chunk_id", F.explode(F.sequence(low, high))).withColumn("chunk_start", F.col("chunk_id") * step)
    return df.where(F.col("chunk_start") + size <= F.col("_n")).drop("_n") if drop_tail else df


def skip_overlap(frames: DataFrame, overlap: int, context: int) -> DataFrame:
    """Each chunk but the first of a recording without its first max(0, overlap - 2 * context) frames."""
    return frames.where((F.col("chunk_id") == 0) | (F.col("frame_idx") - F.col("chunk_start") >= max(0, overlap - 2 * context)))


def normalize_chunk(frames: DataFrame, std: bool = False, keys: tuple = ("rec_id", "chunk_id"), feat: str = "feat", dims: int | None = None) -> DataFrame:
    """Vectors less their chunk's mean, bin by bin, and by the population deviation if asked; a deviation of 0 gives null.

    dims, the length of all vectors, lets one shuffle do: the figures are window aggregates over a chunk's rows. Without it
    one grouped pass over bins gives the figures, which are joined back."""
    one = (lambda x, m, s: F.try_divide(x - m, s)) if std else (lambda x, m, s: x - m)
    if dims:
        w = Window.partitionBy(*keys)
        bins = [F.col(feat)[i] for i in range(dims)]
        return frames.withColumn(feat, F.array(*(one(x, F.avg(x).over(w), F.stddev_pop(x).over(w) if std else None) for x in bins)))
    parts = frames.select(*keys, F.posexplode(feat).alias("bin", "x")).groupBy(*keys, "bin").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    figures = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bin", "m", "s"))).alias("_f"))
    return frames.join(figures, list(keys)).withColumn(feat, F.zip_with(feat, "_f", lambda x, f: one(x, f["m"], f["s"]))).drop("_f")


def window_label(frames: DataFrame, ctx: int, how: str | Column = "dominant", n: int = 3, keys: tuple = ("rec_id",), cls: str = "class") -> DataFrame:
    """window_class of the frames from ctx before to ctx after: the most frequent (of equal ones the lowest), highest, or centre's,
    or what an aggregate expression makes of the window."""
    w = Window.partitionBy(*keys).orderBy("frame_idx").rowsBetween(-ctx, ctx)
    if isinstance(how, Column):
        return frames.withColumn("window_class", how.over(w))
    if how == "centre":
        return frames.withColumn("window_class", F.col(cls))
    if how == "max":
        return frames.withColumn("window_class", F.max(cls).over(w))
    counts = F.array(*(F.count_if(F.col(cls) == k).over(w) for k in range(n)))
    return frames.withColumn("_c", counts).withColumn("window_class", (F.array_position("_c", F.array_max("_c")) - 1).cast("int")).drop("_c")


def with_recording_attrs(frames: DataFrame, recordings: DataFrame) -> DataFrame:
    """Frames with their recording's attributes, kept as a dimension and joined when asked for."""
    return S.with_recording(frames, recordings)
