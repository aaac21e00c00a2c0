"""Operators on tables of segments (rec_id, start, end, ...). Columns beside these pass through unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blocks as B


def _order(*more: str):
    return [F.col("start"), F.col("end"), *map(F.col, more)]


def at_rate(segments: DataFrame, rate: float) -> DataFrame:
    """Ticks at another rate; exact integers where the new rate is a multiple of the old one."""
    if rate <= 0:
        raise ValueError("the rate must be positive")
    new, old = F.lit(float(rate)), F.col("rate").cast("double")
    times = lambda c: F.when(new == old, F.col(c)).when(new % old == 0, F.col(c) * (new / old)).otherwise(F.col(c) * new / old)
    return segments.withColumns({"start": times("start"), "end": times("end"), "rate": new})


def shift_to(segments: DataFrame, start: float, rate: float | None = None) -> DataFrame:
    """Moves each recording so that its first start is `start`, which may be given at another rate."""
    goal = F.lit(float(start)) * (F.col("rate") / F.lit(float(rate)) if rate else F.lit(1.0))
    by = goal - F.min("start").over(Window.partitionBy("rec_id"))
    return segments.withColumn("_by", by).withColumns({"start": F.col("start") + F.col("_by"), "end": F.col("end") + F.col("_by")}).drop("_by")


def extent(segments: DataFrame) -> DataFrame:
    """min_start, max_end (end of the last segment in order of start and end) and true_end of each recording."""
    return segments.groupBy("rec_id").agg(F.min("start").alias("min_start"), F.max(F.struct("start", "end"))["end"].alias("max_end"), F.max("end").alias("true_end"))


def annotated_range(segments: DataFrame, catalog: DataFrame) -> DataFrame:
    """First and last sample of each recording that both audio and labels cover."""
    return extent(segments).join(catalog.select("rec_id", "samples"), "rec_id").select("rec_id", F.greatest(F.lit(0.0), F.col("min_start")).alias("lo"), F.least(F.col("samples").cast("double"), F.col("max_end")).alias("hi"))


def drop_empty(segments: DataFrame, observation=None) -> DataFrame:
    """Without segments that don't last; an Observation gets their number as `dropped`."""
    if observation is not None:
        segments = segments.observe(observation, F.count_if(~F.coalesce(F.col("end") > F.col("start"), F.lit(False))).alias("dropped"))
    return segments.where("end > start")


def number_segments(segments: DataFrame, *ties: str) -> DataFrame:
    """seg_idx from 0 in order of start and end, then of the given columns."""
    w = Window.partitionBy("rec_id").orderBy(*_order(*ties))
    return segments.withColumn("seg_idx", (F.row_number().over(w) - 1).cast("int"))


def slice_segments(segments: DataFrame, lo: int | None = None, hi: int | None = None, *ties: str) -> DataFrame:
    """Segments lo to hi (not included) of each recording; negative places count from the end."""
    n = F.count(F.lit(1)).over(Window.partitionBy("rec_id"))
    place = lambda x: F.lit(x) if x >= 0 else n + x
    df = number_segments(segments, *ties).withColumn("_n", n)
    n = F.col("_n")
    if lo is not None:
        df = df.where(F.col("seg_idx") >= place(lo))
    if hi is not None:
        df = df.where(F.col("seg_idx") < place(hi))
    return df.drop("_n")


def check_segments(segments: DataFrame, contiguous: bool = False, strict: bool = False) -> DataFrame:
    """A row for each violation: rec_id, start, end, problem. strict: the first one found is an error."""
    df = segments
    faults = [F.when(~F.coalesce(F.col("end") > F.col("start"), F.lit(False)), "end is not after start"), F.when(~F.coalesce(F.col("rate") > 0, F.lit(False)), "rate is not positive")]
    if contiguous:
        after = F.lead("start").over(Window.partitionBy("rec_id").orderBy(*_order()))
        df = df.withColumn("_after", after)
        faults.append(F.when(F.col("_after") != F.col("end"), "the next segment starts elsewhere"))
    found = df.select("rec_id", "start", "end", F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("problem"))
    return found.withColumn("problem", F.raise_error(F.col("problem"))) if strict else found


def boundaries(segments: DataFrame) -> DataFrame:
    """Pieces between neighbouring starts and ends of each recording."""
    cuts = segments.select("rec_id", F.explode(F.array(F.col("start"), F.col("end"))).alias("start")).distinct()
    return cuts.withColumn("end", F.lead("start").over(Window.partitionBy("rec_id").orderBy("start"))).where(F.col("end").isNotNull())


def flatten(segments: DataFrame, label: str = "label", width: float | None = None) -> DataFrame:
    """rec_id, start, end, seg_idxs and labels (both in order of seg_idx, empty in gaps) of each piece between boundaries.

    Starts and ends are ranked in one sorted pass; a segment then covers the pieces from the rank of its start to that of
    its end, so no two segments are compared, and the work is that of the result. Segments that don't last are left out.
    Recordings are worked on in stretches, of `width` ticks or else so that each has a bounded number of segments; a segment
    is in each stretch that it touches, and a stretch's last piece ends where the next one with a boundary begins."""
    segs = segments.where("end > start").select("rec_id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("seg_idx").alias("i"), F.col(label).alias("label"))
    segs = B.with_stretches(segs, ["rec_id"], F.col("s"), F.col("e"), width)
    first, last = B.stretch_of(F.col("s")), B.stretch_of(F.col("e"))
    segs = segs.withColumns({"_f": first, "_l": last}).withColumn("_b", F.explode(F.sequence("_f", "_l")))
    # an end of -1 lies before the stretch and has rank 0; one of 1 lies after it and ends after its last piece
    none = F.lit(None)
    edge = lambda at, side, kind, name: F.struct(at.alias("t"), side.alias("side"), F.lit(kind).alias("kind"), name.alias("label"))
    starts_here, ends_here = F.col("_b") == F.col("_f"), F.col("_b") == F.col("_l")
    edges = F.array(
        edge(F.when(starts_here, F.col("s")), F.when(starts_here, 0).otherwise(-1), 0, F.col("label")),
        edge(F.when(ends_here, F.col("e")), F.when(ends_here, 0).otherwise(1), 1, F.when(none.isNotNull(), F.col("label"))),
    )
    events = B.dealt(segs.select("rec_id", "_b", "i", F.inline(edges)), "rec_id", "_b")
    w = Window.partitionBy("rec_id", "_b").orderBy("side", "t")
    new = (F.col("side") == 0) & ~F.lag("t").over(w).eqNullSafe(F.col("t"))
    ranked = events.withColumn("_new", new.cast("int")).withColumn("_r", F.sum("_new").over(w))
    of = lambda kind, x: F.max(F.when(F.col("kind") == kind, x))
    real = F.when(F.col("side") == 0, F.col("t"))
    covers = ranked.groupBy("rec_id", "_b", "i").agg(
        of(0, F.col("_r")).alias("_from"), of(1, F.col("_r") + (F.col("side") == 1).cast("int")).alias("_to"), of(0, real).alias("s"), of(1, real).alias("e"), F.first("label", ignorenulls=True).alias("label")
    )
    # a row for each piece that a segment covers, which tells the piece's start where the segment begins there, and one that tells where it ends
    lo, hi = F.greatest(F.col("_from"), F.lit(1)), F.col("_to") - 1
    seg = F.struct("i", "label")
    piece = lambda p, start, x: F.struct(p.cast("long").alias("p"), start.alias("start"), x.alias("seg"))
    inside = F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda r: piece(r, F.when(r == F.col("_from"), F.col("s")), seg))
    ends = F.array(piece(F.col("_to"), F.col("e"), F.when(none.isNotNull(), seg)))
    empty = F.slice(inside, 1, 0)
    members = covers.select("rec_id", "_b", F.inline(F.concat(F.when(lo <= hi, inside).otherwise(empty), F.when(F.col("e").isNotNull(), ends).otherwise(empty))))
    rows = members.groupBy("rec_id", "_b", F.col("p").alias("_p")).agg(F.max("start").alias("start"), F.sort_array(F.collect_list("seg")).alias("_rows"))
    heads = events.where("side = 0").groupBy("rec_id", "_b").agg(F.min("t").alias("_t"))
    heads = heads.select("rec_id", "_b", F.lead("_t").over(Window.partitionBy("rec_id").orderBy("_b")).alias("_next")).where("_next is not null")
    after = F.lead("start").over(Window.partitionBy("rec_id", "_b").orderBy("_p"))
    done = rows.withColumn("_end", after).join(heads, ["rec_id", "_b"], "left").withColumn("end", F.coalesce("_end", "_next")).where("start is not null and end is not null")
    return done.select("rec_id", "start", "end", F.col("_rows.i").alias("seg_idxs"), F.col("_rows.label").alias("labels"))


def concurrency(segments: DataFrame) -> DataFrame:
    """rec_id, start, end, n: how many segments cover each piece. One sorted pass over starts and ends, no join."""
    steps = segments.where("end > start").select("rec_id", F.explode(F.array(F.struct(F.col("start").alias("t"), F.lit(1).alias("d")), F.struct(F.col("end").alias("t"), F.lit(-1).alias("d")))).alias("x"))
    sums = steps.groupBy("rec_id", F.col("x.t").alias("start")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("rec_id").orderBy("start")
    return sums.select("rec_id", "start", F.lead("start").over(w).alias("end"), F.sum("d").over(w).alias("n")).where(F.col("end").isNotNull())


def active_speakers(segments: DataFrame, speakers: list, speaker: str = "speaker") -> DataFrame:
    """rec_id, start, end, active (0 or 1 for each of the speakers) and doubled (someone is annotated twice, also someone
    who isn't among the speakers) of each piece. A sweep: each boundary adds and takes away speakers; no lists are made."""
    segs = segments.where("end > start").select("rec_id", "start", "end", F.col(speaker).alias("_who"))
    edge = lambda t, d: F.struct(t.alias("t"), F.lit(d).alias("d"))
    steps = segs.select("rec_id", "_who", F.inline(F.array(edge(F.col("start"), 1), edge(F.col("end"), -1))))
    counts = [F.sum(F.when(F.col("_who") == F.lit(s), F.col("d")).otherwise(0)) for s in speakers]
    known = F.coalesce(F.col("_who").isin(list(speakers)), F.lit(False))
    # someone annotated twice: of speakers seen in the counts, of others by their own running counts
    own = Window.partitionBy("rec_id", "_who").orderBy("t")
    others = steps.where(~known & F.col("_who").isNotNull()).groupBy("rec_id", "_who", "t").agg(F.sum("d").alias("d"))
    twice = others.withColumn("_n", F.sum("d").over(own)).withColumn("_was", F.coalesce(F.lag("_n").over(own), F.lit(0)))
    twice = twice.select("rec_id", "t", ((F.col("_n") > 1).cast("int") - (F.col("_was") > 1).cast("int")).alias("x")).where("x != 0")
    both = steps.select("rec_id", "t", "_who", "d", F.lit(0).alias("x")).unionByName(twice.withColumns({"_who": F.lit(None).cast(steps.schema["_who"].dataType), "d": F.lit(0)}))
    sums = both.groupBy("rec_id", "t").agg(*(c.alias(f"c{k}") for k, c in enumerate(counts)), F.sum("x").alias("x"))
    w = Window.partitionBy("rec_id").orderBy("t")
    run = sums.select("rec_id", F.col("t").alias("start"), F.lead("t").over(w).alias("end"), *(F.sum(f"c{k}").over(w).alias(f"c{k}") for k in range(len(speakers))), F.sum("x").over(w).alias("x")).where("end is not null")
    now = [F.col(f"c{k}") for k in range(len(speakers))]
    doubled = F.greatest(F.lit(0).cast("long"), F.col("x"), *(c - 1 for c in now)) > 0
    return run.select("rec_id", "start", "end", F.array(*((c > 0).cast("int") for c in now)).alias("active"), doubled.alias("doubled"))


def overlay(left: DataFrame, right: DataFrame) -> DataFrame:
    """rec_id, start, end, a, b: where each of two annotations has a segment, from tick 0 to the first one's last end, in runs."""
    rounded = lambda df: df.select("rec_id", F.rint("start").alias("start"), F.rint("end").alias("end")).where("end > start")
    l, r = rounded(left), rounded(right)  # noqa: E741
    last = l.groupBy("rec_id").agg(F.max("end").alias("_last"))
    cut = r.join(last, "rec_id").select("rec_id", F.least("start", "_last").alias("start"), F.least("end", "_last").alias("end")).where("end > start")
    point = lambda t, a, b: F.struct(t.alias("t"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    steps = l.select("rec_id", F.explode(F.array(point(F.col("start"), 1, 0), point(F.col("end"), -1, 0))).alias("x")).unionByName(
        cut.select("rec_id", F.explode(F.array(point(F.col("start"), 0, 1), point(F.col("end"), 0, -1))).alias("x"))
    ).unionByName(last.select("rec_id", F.explode(F.array(point(F.lit(0.0), 0, 0), point(F.col("_last"), 0, 0))).alias("x")))
    sums = steps.groupBy("rec_id", F.col("x.t").alias("t")).agg(F.sum("x.a").alias("a"), F.sum("x.b").alias("b"))
    w = Window.partitionBy("rec_id").orderBy("t")
    flags = sums.select("rec_id", "t", F.lead("t").over(w).alias("e"), (F.sum("a").over(w) > 0).cast("int").alias("a"), (F.sum("b").over(w) > 0).cast("int").alias("b")).where("e is not null and t >= 0")
    changed = F.coalesce((F.struct("a", "b") != F.lag(F.struct("a", "b")).over(w)).cast("int"), F.lit(1))
    runs = flags.withColumn("_c", changed).withColumn("_run", F.sum("_c").over(w))
    return runs.groupBy("rec_id", "_run", "a", "b").agg(F.min("t").alias("start"), F.max("e").alias("end")).select("rec_id", "start", "end", "a", "b")


#: Stretches up to which a segment is put in each that it touches.
NEAR = 64


def labels_at(
    points: DataFrame, segments: DataFrame, label: str = "label", width: float | None = None, digits: int = 10, default: list | None = None, strict: bool = False
) -> DataFrame:
    """points (rec_id, t, ...) with labels: those of all segments that cover t, in order of start, end and seg_idx; `default`
    (empty unless given) if none does, or an error if strict. Times are rounded to `digits` first; equal points are looked up
    once and all keep their rows.

    An as-of merge: a segment is in each stretch that it touches, its starts and ends learn how many distinct points lie
    before them there, and it meets the points of these ranks by equality, so the work is that of the result and all of it
    is done in the stretch, with one shuffle. Stretches are `width` ticks long, or else such that each has a bounded number
    of points; a segment that touches many is put in those alone that have points."""
    rounded = lambda c: F.bround(F.col(c).cast("double"), digits)
    points = points.drop("labels")
    tagged = points.select("rec_id", rounded("t").alias("t"), F.struct(*points.columns).alias("_row"))
    s = segments.where("rec_id is not null").select("rec_id", rounded("start").alias("s"), rounded("end").alias("e"), F.col("seg_idx").alias("i"), F.col(label).alias("label")).where("e > s")
    if width:
        tagged, s = (B.with_stretches(df, ["rec_id"], None, None, width) for df in (tagged, s))
    else:
        asked = B.with_stretches(tagged.select("rec_id", "t").where("t is not null"), ["rec_id"], F.col("t"), F.col("t"))
        facts = asked.select("rec_id", "_lo", "_w", "_many").distinct()
        tagged, s = tagged.join(facts, "rec_id", "left"), s.join(facts, "rec_id")
    dots = tagged.select("rec_id", B.stretch_of(F.col("t")).alias("_b"), "t", "_row")
    s = s.select("rec_id", B.stretch_of(F.col("s")).alias("_f"), B.stretch_of(F.col("e")).alias("_l"), F.struct("s", "e", "i", "label").alias("seg"))
    near = F.col("_l") - F.col("_f") < NEAR
    short = s.where(near).withColumn("_b", F.explode(F.sequence("_f", "_l")))
    long = s.where(~near).join(dots.select("rec_id", "_b").distinct(), "rec_id").where("_b between _f and _l")
    edge = lambda here, at, beyond, kind: F.struct(F.when(F.col("_b") == F.col(here), F.col("seg")[at]).otherwise(F.lit(beyond)).alias("t"), F.lit(kind).alias("kind"))
    edges = short.unionByName(long).select("rec_id", "_b", "seg", F.inline(F.array(edge("_f", "s", float("-inf"), 0), edge("_l", "e", float("inf"), 1))))
    events = edges.unionByName(dots.withColumn("kind", F.lit(2)), allowMissingColumns=True).repartition("rec_id", "_b")
    w = Window.partitionBy("rec_id", "_b").orderBy("t", "kind")
    dot = F.col("kind") == 2
    new = dot & ~(F.coalesce(F.lag("kind").over(w) == 2, F.lit(False)) & F.lag("t").over(w).eqNullSafe(F.col("t")))
    ranked = events.withColumn("_new", new.cast("int")).withColumn("_k", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    until = F.max(F.when(F.col("kind") == 1, F.col("_k"))).over(Window.partitionBy("rec_id", "_b", "seg"))
    met = F.when(dot, F.array("_k")).when((F.col("kind") == 0) & (F.col("_until") > F.col("_k")), F.sequence(F.col("_k") + 1, F.greatest(F.col("_k") + 1, "_until")))
    placed = ranked.withColumn("_until", until).select("rec_id", "_b", "seg", "_row", "kind", F.explode(met).alias("_r"))
    found = placed.withColumn("_s", F.collect_list("seg").over(Window.partitionBy("rec_id", "_b", "_r"))).where(dot)
    labels = F.sort_array("_s")["label"]
    kind = segments.select(F.array(label)).schema[0].dataType
    none = F.raise_error(F.lit("a point lies outside of all segments")).cast(kind) if strict else F.array(*map(F.lit, default or [])).cast(kind)
    return found.select("_row.*", F.when(F.size("_s") == 0, none).otherwise(labels).alias("labels"))


def label_at(points: DataFrame, segments: DataFrame, label: str = "label", default=None, strict: bool = False, width: float | None = None, digits: int = 10) -> DataFrame:
    """points with the label of the one segment of a contiguous annotation that holds t, times rounded to `digits` first; an
    as-of merge in stretches of `width` ticks, or else such that each has a bounded number of rows. The last segment before a
    stretch is carried over its border."""
    rounded = lambda c: F.bround(F.col(c).cast("double"), digits)
    tagged = segments.where("rec_id is not null").select("rec_id", rounded("start").alias("_t"), F.lit(0).alias("_kind"), F.struct(rounded("start").alias("start"), rounded("end").alias("end"), F.col(label).alias("label")).alias("_seg"))
    asked = points.select("rec_id", rounded("t").alias("_t"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_row"))
    both = B.with_stretches(tagged.unionByName(asked, allowMissingColumns=True).withColumn("_key", F.coalesce(F.col("rec_id").cast("string"), F.lit(""))), ["_key"], F.col("_t"), F.col("_t"), width)
    both = both.withColumn("_b", F.coalesce(B.stretch_of(F.col("_t")), F.lit(0).cast("long"))).drop("_lo", "_w", "_many").repartition("_key", "_b")
    w = Window.partitionBy("_key", "_b").orderBy("_t", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.groupBy("_key", "_b").agg(F.max_by("_seg", F.when(F.col("_kind") == 0, F.col("_t"))).alias("_last"))
    carried = carried.select("_key", "_b", F.last("_last", ignorenulls=True).over(over).alias("_carried"))
    found = both.withColumn("_at", F.last("_seg", ignorenulls=True).over(w)).where("_kind = 1").join(carried, ["_key", "_b"]).withColumn("_at", F.coalesce("_at", "_carried"))
    inside = F.col("_at").isNotNull() & F.col("rec_id").isNotNull() & (F.col("_t") < F.col("_at.end"))
    outside = F.raise_error(F.lit("a point lies outside of the annotation")) if strict else F.lit(default)
    return found.select("_row.*", F.when(inside, F.col("_at.label")).otherwise(outside).alias("label"))


def speakers_of(segments: DataFrame, *attributes: str) -> DataFrame:
    """Distinct speakers of each recording with the given attributes."""
    return segments.select("rec_id", "speaker", *attributes).distinct()


def with_recording(segments: DataFrame, recordings: DataFrame, strict: bool = False) -> DataFrame:
    """Segments (also a stream of them) with their recording's attributes; strict: a missing recording is an error.

    The dimension's size decides how Spark joins it; no broadcast is forced."""
    joined = segments.join(recordings.withColumn("_found", F.lit(True)), "rec_id", "left")
    if strict:
        joined = joined.withColumn("_found", F.when(F.col("_found").isNull(), F.raise_error(F.concat(F.lit("unknown recording: "), F.col("rec_id")))).otherwise(F.col("_found")))
        joined = joined.where("_found")
    return joined.drop("_found")


def missing_from(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Distinct keys of a that b doesn't have."""
    return a.select(*keys).distinct().join(b.select(*keys), list(keys), "left_anti")


def pair_recordings(catalog: DataFrame, segments: DataFrame, key: str = "rec_id", counts: bool = False) -> DataFrame:
    """Every key of either side with status both, left_only or right_only; with counts also n_left and n_right, and the status
    mismatch where both have the key but not equally often."""
    a, b = (df.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for df, n in ((catalog, "n_left"), (segments, "n_right")))
    uneven = F.col("n_left") != F.col("n_right") if counts else F.lit(False)
    status = F.when(F.col("n_right").isNull(), "left_only").when(F.col("n_left").isNull(), "right_only").when(uneven, "mismatch").otherwise("both")
    number = [F.coalesce(n, F.lit(0).cast("long")).alias(n) for n in ("n_left", "n_right")] if counts else []
    return a.join(b, key, "full_outer").select(key, status.alias("status"), *number)


def pick_recordings(df: DataFrame, ids: list | None = None, groups: list | None = None, at: tuple | None = None, groups_at: tuple | None = None, column: str = "rec_id", strict: bool = True) -> DataFrame:
    """Rows of recordings by id, by group, or by place (lo, hi) among the sorted ids or groups; strict: an unknown id is an
    error. column: what counts as a recording, so that conversations can be picked in the same way."""
    spark, out = df.sparkSession, df
    for c, wanted in ((column, ids), ("group_id", groups)):
        if wanted is not None:
            if strict and (unknown := missing_from(spark.createDataFrame([(x,) for x in wanted], df.select(c).schema), df, c).limit(5).collect()):
                raise ValueError(f"unknown {c}: {[r[0] for r in unknown]}")
            out = out.where(F.col(c).isin(list(wanted)))
    for c, place in (("group_id", groups_at), (column, at)):
        if place is not None:
            lo, hi = place
            # no more than hi ids are ranked
            chosen = out.select(c).distinct().orderBy(c).limit(hi).withColumn("_k", F.row_number().over(Window.orderBy(c))).where(F.col("_k") > lo).select(c)
            out = out.join(chosen, c, "left_semi")
    return out


def head_recordings(df: DataFrame, n: int, last: bool = False) -> DataFrame:
    """All rows of the first or last n recordings in order of id."""
    order = F.desc("rec_id") if last else F.asc("rec_id")
    return df.join(df.select("rec_id").distinct().orderBy(order).limit(n), "rec_id", "left_semi")


def union_ids(*parts: DataFrame, key: str = "rec_id") -> DataFrame:
    """Distinct keys that any of the parts has."""
    keys = parts[0].select(key)
    for p in parts[1:]:
        keys = keys.unionAll(p.select(key))
    return keys.distinct()


def check_disjoint(*parts: DataFrame, key: str = "rec_id") -> DataFrame:
    """Keys that more than one part has."""
    keys = [p.select(key).distinct() for p in parts]
    both = keys[0]
    for k in keys[1:]:
        both = both.unionAll(k)
    return both.groupBy(key).count().where("count > 1").select(key)


def check_same(a: DataFrame, b: DataFrame, key: str = "rec_id") -> DataFrame:
    """Keys that only one side has, or has more often."""
    a, b = a.select(key), b.select(key)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def merge_tiers(a: DataFrame, b: DataFrame, prefix_a: str = "true-", prefix_b: str = "pred-") -> DataFrame:
    """The tiers of two annotations together, told apart by a prefix."""
    return a.withColumn("tier", F.concat(F.lit(prefix_a), "tier")).unionByName(b.withColumn("tier", F.concat(F.lit(prefix_b), "tier")), allowMissingColumns=True)


def common_rate_of(rows: DataFrame, by: str = "source") -> DataFrame:
    """by, common: the least common multiple of each group's distinct rates."""
    from .stats import common_rate

    return common_rate(rows, by).withColumnRenamed("rate", "common")
