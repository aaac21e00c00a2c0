"""Markov priors, merging of predictors, Viterbi smoothing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as fn
from . import blocks as B


def _moves_between(ends: DataFrame, keys: tuple, order: str) -> DataFrame:
    """keys, from_state, to_state of the moves from each block's last state to the next block's first."""
    w = Window.partitionBy(*(c for c in ends.columns if c not in ("_b", "_head", "_tail"))).orderBy(order)
    after = ends.withColumn("_next", F.lead("_head").over(w)).where("_next is not null")
    return after.select(*(F.col("_tail")[k].alias(k) for k in keys), F.col("_tail.state").alias("from_state"), F.col("_next.state").alias("to_state"))


def priors_from_segments(
    segments: DataFrame, state: str | Column = "label", keys: tuple = (), round_to_int: bool = False, width: float | None = 1e6
) -> tuple[DataFrame, DataFrame]:
    """(states: keys, state, init, prior), (transitions: keys, from_state, to_state, n), without expanding segments to ticks:
    between neighbouring segments one transition each, within a segment one less than its ticks. state: a column or any
    expression. Segments of equal start and end are ordered by state; a move counts for the keys of the segment it leaves.

    Segments that start in the same stretch of `width` ticks are a block of their recording (None: all of it); moves over
    the borders come from the blocks' first and last segments."""
    ticks = F.col("end") - F.col("start")
    block = B.block_of("start", width) if width else F.lit(0).cast("long")
    df = segments.select("rec_id", *keys, "start", "end", (F.col(state) if isinstance(state, str) else state).alias("state"), (F.rint(ticks) if round_to_int else ticks).alias("_d"), block.alias("_b"))
    df = df.repartition("rec_id", "_b")  # all branches read this shuffle
    inner = df.withColumn("_next", F.lead("state").over(Window.partitionBy("rec_id", "_b").orderBy("start", "end", "state")))
    one = F.struct("start", "end", "state", *keys)
    ends = df.groupBy("rec_id", "_b").agg(F.min(one).alias("_head"), F.max(F.struct("start", "end", "state", *keys)).alias("_tail"))
    first = df.groupBy("rec_id").agg(F.min(one).alias("_x")).select(*(F.col("_x")[k].alias(k) for k in keys), F.col("_x.state").alias("state"), F.lit(1).cast("long").alias("init"))
    totals = df.groupBy(*keys, "state").agg(F.sum("_d").alias("prior"), F.count(F.lit(1)).alias("_n"))
    states = first.groupBy(*keys, "state").agg(F.sum("init").alias("init"))
    states = totals.join(states, [*keys, "state"], "left").select(*keys, "state", F.coalesce("init", F.lit(0).cast("long")).alias("init"), "prior")
    moves = inner.where(F.col("_next").isNotNull()).select(*keys, F.col("state").alias("from_state"), F.col("_next").alias("to_state")).unionByName(_moves_between(ends, keys, "_b"))
    moves = moves.groupBy(*keys, "from_state", "to_state").agg(F.count(F.lit(1)).cast("double").alias("n"))
    stays = totals.select(*keys, F.col("state").alias("from_state"), F.col("state").alias("to_state"), (F.col("prior") - F.col("_n")).alias("n"))
    return states, moves.unionByName(stays).groupBy(*keys, "from_state", "to_state").agg(F.sum("n").alias("n"))


def priors_from_frames(
    frames: DataFrame, cls: str = "class", keys: tuple = (), chunk: tuple = ("rec_id",), order: str = "frame_idx", size: int = B.SIZE
) -> tuple[DataFrame, DataFrame]:
    """The same from frames; transitions only within a chunk, the first frame of each recording gives init. Chunks are worked
    on in blocks of `size` frame numbers; moves over the borders come from the blocks' first and last frames."""
    df = frames.select(*dict.fromkeys([*chunk, *keys, order]), F.col(cls).alias("state")).withColumn("_b", B.block_of(order, size)).repartition(*chunk, "_b")
    inner = df.withColumn("_next", F.lead("state").over(Window.partitionBy(*chunk, "_b").orderBy(order)))
    one = F.struct(order, "state", *(k for k in keys if k != order))
    ends = df.groupBy(*chunk, "_b").agg(F.min(one).alias("_head"), F.max(one).alias("_tail"))
    first = df.groupBy(chunk[0]).agg(F.min(one).alias("_x")).select(*(F.col("_x")[k].alias(k) for k in keys), F.col("_x.state").alias("state"))
    totals = df.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("prior"))
    states = totals.join(first.groupBy(*keys, "state").agg(F.count(F.lit(1)).alias("init")), [*keys, "state"], "left")
    states = states.select(*keys, "state", F.coalesce("init", F.lit(0).cast("long")).alias("init"), "prior")
    moves = inner.where(F.col("_next").isNotNull()).select(*keys, F.col("state").alias("from_state"), F.col("_next").alias("to_state")).unionByName(_moves_between(ends, keys, "_b"))
    return states, moves.groupBy(*keys, "from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))


def combine_priors(parts: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Sums of raw counts over splits."""
    states, moves = parts[0]
    for s, m in parts[1:]:
        states, moves = states.unionByName(s), moves.unionByName(m)
    return states.groupBy("state").agg(F.sum("init").alias("init"), F.sum("prior").alias("prior")), moves.groupBy("from_state", "to_state").agg(F.sum("n").alias("n"))


def normalize_priors(states: DataFrame, moves: DataFrame, keys: tuple = ()) -> tuple[DataFrame, DataFrame]:
    """init and prior by their sums, transitions by the sums of their rows."""
    share = lambda c, *by: F.try_divide(F.col(c), F.sum(c).over(Window.partitionBy(*keys, *by)))
    return states.withColumns({"init": share("init"), "prior": share("prior")}), moves.withColumn("p", share("n", "from_state"))


def merge_posteriors(posteriors: DataFrame, weights: DataFrame | None = None, merge=None) -> DataFrame:
    """rec_id, frame_idx, probs: the predictors' weighted sum, normalised, in one shuffle. weights: (predictor[, class], weight);
    a predictor without a weight is an error. merge: a function of the array of the predictors' arrays to one array, in
    place of the sum."""
    df = posteriors.select("rec_id", "frame_idx", "predictor", "probs")
    if weights is not None:
        by_class = "class" in weights.columns
        w = weights.groupBy("predictor").agg(F.sort_array(F.collect_list(F.struct(*(["class"] if by_class else []), "weight")))["weight"].alias("_w"))
        known = F.when(F.col("_w").isNull(), F.raise_error(F.concat(F.lit("no weight for predictor "), F.col("predictor").cast("string")))).otherwise(F.col("_w"))
        scaled = F.zip_with("probs", "_w", lambda p, x: p * x) if by_class else F.transform("probs", lambda p: p * F.col("_w")[0])
        df = df.join(w, "predictor", "left").withColumn("_w", known).withColumn("probs", scaled)
    rows = df.groupBy("rec_id", "frame_idx").agg(F.sort_array(F.collect_list(F.struct("predictor", "probs")))["probs"].alias("_v"))
    plain = lambda v: F.aggregate(F.slice(v, 2, F.size(v)), v[0], lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    return rows.withColumn("_m", (merge or plain)(F.col("_v"))).select("rec_id", "frame_idx", fn.normalize("_m").alias("probs"))


#: Logarithms are whole multiples of 2 to the minus this, so that sums are exact and equal however a recording is cut.
BITS = 32


def fixed_log(x, amin: float = 1e-15) -> np.ndarray:
    """Natural logarithms, at least that of amin, as whole numbers."""
    return np.rint(np.log(np.maximum(np.asarray(x, float), amin)) * (1 << BITS)).astype(np.int64)


def _observed(probs: np.ndarray, amin: float, scale: np.ndarray | None) -> np.ndarray:
    if scale is not None:
        probs = probs / scale
        probs = probs / probs.sum(1, keepdims=True)
    return fixed_log(probs, amin)


def _over(score: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Max-plus product of (..., states) with the steps from state to state."""
    out = score[..., 0, None] + step[0]
    for i in range(1, len(step)):
        np.maximum(out, score[..., i, None] + step[i], out=out)
    return out


def _stretches(n: int) -> tuple[int, int]:
    """n frames as so many stretches of equal length that both numbers are about the root of n."""
    many = max(1, int(n**0.5))
    return many, n // many


def block_product(obs: np.ndarray, step: np.ndarray) -> np.ndarray:
    """[i, j]: the best score of a block's frames that end in state j, coming from state i in the frame before it. Stretches
    of the block are multiplied side by side, then with each other."""
    many, long = _stretches(len(obs))
    side = obs[: many * long].reshape(many, long, -1)
    part = step[None] + side[:, 0, None, :]
    for t in range(1, long):
        part = _over(part, step) + side[:, t, None, :]
    whole = part[0]
    for p in part[1:]:
        whole = _over(whole, p)
    for o in obs[many * long :]:
        whole = _over(whole, step) + o
    return whole


def _forward(obs: np.ndarray, step: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Back pointers (frame, state) of a block, of equal ones the lowest state, and the score of each state in its last
    frame. enter: the scores in the frame before it."""
    many, long = _stretches(len(obs))
    side = obs[: many * long].reshape(many, long, -1)
    part = step[None] + side[:, 0, None, :]
    for t in range(1, long):
        part = _over(part, step) + side[:, t, None, :]
    score = np.empty((many, len(step)), np.int64)  # before each stretch
    score[0] = enter
    for k in range(1, many):
        score[k] = _over(score[k - 1], part[k - 1])
    back = np.empty((many, long, len(step)), np.int8 if len(step) < 128 else np.int64)
    for t in range(long):
        reach = score[:, :, None] + step[None]
        back[:, t] = reach.argmax(1)
        score = reach.max(1) + side[:, t]
    last, flat = score[-1], [back.reshape(many * long, -1)]
    for o in obs[many * long :]:
        reach = last[:, None] + step
        flat.append(reach.argmax(0)[None].astype(back.dtype))
        last = reach.max(0) + o
    return np.concatenate(flat), last


def _through(back: np.ndarray) -> np.ndarray:
    """For each state in a block's last frame, the state in the frame before the block that its pointers lead to."""
    many, long = _stretches(len(back))
    side = back[: many * long].reshape(many, long, -1)
    lead = np.repeat(np.arange(back.shape[1])[None], many, 0)
    for t in range(long - 1, -1, -1):
        lead = np.take_along_axis(side[:, t], lead, 1)
    at = np.arange(back.shape[1])
    for row in back[many * long :][::-1]:
        at = row[at]
    for k in range(many - 1, -1, -1):
        at = lead[k][at]
    return at


def _states(back: np.ndarray, end: int) -> np.ndarray:
    """The states of a block's frames, the last of which is `end`."""
    many, long = _stretches(len(back))
    side = back[: many * long].reshape(many, long, -1)
    path = np.empty(len(back), np.int64)
    at = end
    for t in range(len(back) - 1, many * long - 1, -1):
        path[t], at = at, int(back[t, at])
    lead = np.repeat(np.arange(back.shape[1])[None], many, 0)
    for t in range(long - 1, -1, -1):
        lead = np.take_along_axis(side[:, t], lead, 1)
    ends = np.empty(many, np.int64)
    for k in range(many - 1, -1, -1):
        ends[k], at = at, int(lead[k][at])
    out, rows = path[: many * long].reshape(many, long), np.arange(many)
    for t in range(long - 1, -1, -1):
        out[:, t] = ends
        ends = side[rows, t, ends].astype(np.int64)
    return path


def _start(obs: np.ndarray, init: np.ndarray) -> np.ndarray:
    return init + obs[0]


def best_path(probs: np.ndarray, init: np.ndarray, trans: np.ndarray, amin: float = 1e-15, scale: np.ndarray | None = None) -> np.ndarray:
    """Likeliest states of one recording; trans is from (rows) to (columns); of equal paths the lower state."""
    obs, step = _observed(np.asarray(probs, float), amin, scale), fixed_log(trans, amin)
    first = _start(obs, fixed_log(init, amin))
    if len(obs) == 1:
        return np.array([first.argmax()])
    back, last = _forward(obs[1:], step, first)
    end = int(last.argmax())
    rest = _states(back, end)
    return np.concatenate(([back[0][rest[0]]], rest))


#: Frames of a recording up to which it is traced together with others.
SHORT = 1 << 10


def _together(obs: np.ndarray, first: np.ndarray, many: np.ndarray, step: np.ndarray, init: np.ndarray) -> np.ndarray:
    """best_path() of several recordings side by side, whose `many` rows of obs begin at `first`."""
    order = np.argsort(-many, kind="stable")  # those that still go on come first
    first, many = first[order], many[order]
    score, path, back = init + obs[first], np.empty(len(obs), np.int64), []
    on = [int(np.searchsorted(-many, -t)) for t in range(int(many[0]))]  # recordings with more than t frames
    for t in range(1, len(on)):
        reach = score[: on[t], :, None] + step[None]
        back.append(reach.argmax(1))
        score[: on[t]] = reach.max(1) + obs[first[: on[t]] + t]
    at = score.argmax(1)
    for t in range(len(on) - 1, -1, -1):
        path[first[: on[t]] + t] = at[: on[t]]
        if t:
            at[: on[t]] = back[t - 1][np.arange(on[t]), at[: on[t]]]
    return path


def viterbi(
    posteriors: DataFrame, init: list, trans: list, amin: float = 1e-15, trans_axis: str = "from_to", scale_priors: list | None = None, size: int = B.SIZE
) -> DataFrame:
    """rec_id, frame_idx, state: the likeliest states, of equal paths the lower ones.

    Recordings are cut into blocks of `size` frame numbers, which are worked on side by side: each block but the last gives
    the max-plus product of its frames; a pass over a recording's blocks turns these into the scores before each block;
    each block but the first then tells where its pointers lead from every last state; a pass from the last block back
    gives every block's last state, and the blocks are traced. A recording of one block is traced alone, or if it is short,
    together with others of its task. The few
    numbers of the model go along; logarithms are fixed-point numbers, so the result is that of an uncut recording."""
    m = np.array(trans, float)
    begin, step = fixed_log(init, amin), fixed_log(m if trans_axis == "from_to" else m.T, amin)
    scale = np.array(scale_priors, float) if scale_priors is not None else None
    rec, n = posteriors.schema["rec_id"].dataType.simpleString(), len(begin)
    cut = posteriors.select("rec_id", "frame_idx", "probs").withColumn("_b", B.block_of("frame_idx", size))
    span = cut.groupBy("rec_id").agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"))
    many = span.where("_first < _last")  # recordings of one block need no borders
    long = cut.join(many, "rec_id")

    def read(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray]:
        pdf = pdf.sort_values("frame_idx")
        return pdf, _observed(np.stack(pdf["probs"]), amin, scale)

    def product(key, pdf):
        first = key[1] == pdf["_first"].iloc[0]
        _, obs = read(pdf)
        if first:  # a vector: the same scores from every state
            score = _start(obs, begin)
            got = np.repeat((_forward(obs[1:], step, score)[1] if len(obs) > 1 else score)[None], n, 0)
        else:
            got = block_product(obs, step)
        return pd.DataFrame({"rec_id": [key[0]], "_b": [key[1]], "m": [got.reshape(-1)]})

    def scores(key, pdf):
        """The scores in the frame before every block but the first; differences alone matter, so the best is 0."""
        pdf, at, out = pdf.sort_values("_b"), None, []
        for m in pdf["m"]:
            m = np.asarray(m, np.int64).reshape(n, n)
            at = m[0] if at is None else _over(at, m)
            at = at - at.max()
            out.append(at)
        return pd.DataFrame({"rec_id": key[0], "_after": pdf["_b"].to_numpy(), "enter": out})

    def pointers(pdf: pd.DataFrame, enter) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
        """Of a block: its rows in order, back pointers (none into a recording's first frame), the last scores."""
        pdf, obs = read(pdf)
        if enter is not None:
            return pdf, *_forward(obs, step, np.asarray(enter, np.int64))
        score = _start(obs, begin)
        if len(obs) == 1:
            return pdf, np.zeros((0, n), np.int8), score
        return pdf, *_forward(obs[1:], step, score)

    def leads(key, pdf, border):
        """Where each last state of a block leads, and the best of them."""
        if not len(pdf) or not len(border):
            return pd.DataFrame({"rec_id": [], "_b": [], "lead": [], "best": []})
        _, back, last = pointers(pdf, border["enter"].iloc[0])
        return pd.DataFrame({"rec_id": [key[0]], "_b": [key[1]], "lead": [_through(back)], "best": [int(last.argmax())]})

    def ends(key, pdf):
        """The last state of every block, from the last block back."""
        pdf = pdf.sort_values("_b")
        at, out = int(pdf["best"].iloc[-1]), []
        for block, before, lead in zip(pdf["_b"].tolist()[::-1], pdf["_before"].tolist()[::-1], pdf["lead"].tolist()[::-1], strict=True):
            out.append((key[0], block, at))
            at = int(lead[at])
        out.append((key[0], int(before), at))
        return pd.DataFrame(out, columns=["rec_id", "_b", "end"])

    def trace(key, pdf, border):
        if not len(pdf):
            return pd.DataFrame({"rec_id": [], "frame_idx": [], "state": []})
        known = len(border) > 0
        enter = border["enter"].iloc[0] if known else None
        pdf, back, last = pointers(pdf, enter)
        end = int(border["end"].iloc[0]) if known else int(last.argmax())
        path = _states(back, end) if len(back) else np.zeros(0, np.int64)
        if len(path) < len(pdf):  # the frame that no pointer leads into
            path = np.concatenate(([back[0][path[0]] if len(path) else end], path))
        return pd.DataFrame({"rec_id": pdf["rec_id"], "frame_idx": pdf["frame_idx"], "state": path})

    def whole(tables):
        """The states of recordings of one block, whose rows come in order."""

        def states(pdf, first):
            many, path = np.diff(np.append(first, len(pdf))), np.empty(len(pdf), np.int64)
            obs, few = _observed(np.stack(pdf["probs"]), amin, scale), many <= SHORT
            if few.any():
                rows = np.flatnonzero(np.repeat(few, many))
                path[rows] = _together(obs[rows], np.cumsum(many[few]) - many[few], many[few], step, begin)
            for f, n in zip(first[~few], many[~few], strict=True):
                back, last = _forward(obs[f + 1 : f + n], step, _start(obs[f : f + n], begin))
                rest = _states(back, int(last.argmax()))
                path[f : f + n] = np.concatenate(([back[0][rest[0]]], rest))
            return pdf[["_key", "frame_idx"]].assign(state=path)

        held = None  # the rows of the last recording, which may go on
        for pdf in tables:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            code, at = (pd.factorize(pdf[c], use_na_sentinel=False)[0] for c in ("_key", "_b"))
            first = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (at[1:] != at[:-1])))
            held = pdf.iloc[first[-1] :]
            if len(first) > 1:
                yield states(pdf.iloc[: first[-1]], first[:-1])
        if held is not None:
            yield states(held, np.array([0]))

    by = ["rec_id", "_b"]
    blocks = long.select(*by).distinct()
    before = blocks.withColumn("_before", F.lag("_b").over(Window.partitionBy("rec_id").orderBy("_b")))
    made = long.where("_b < _last").groupBy(*by).applyInPandas(product, f"rec_id {rec}, _b bigint, m array<bigint>")
    after = made.groupBy("rec_id").applyInPandas(scores, f"rec_id {rec}, _after bigint, enter array<bigint>")
    entered = before.join(after.withColumnRenamed("_after", "_before"), ["rec_id", "_before"])  # not the first blocks
    named = lambda df: df.withColumnsRenamed({"rec_id": "_rec", "_b": "_block"}).groupBy("_rec", "_block")
    led = long.where("_b > _first").groupBy(*by).cogroup(named(entered)).applyInPandas(leads, f"rec_id {rec}, _b bigint, lead array<bigint>, best bigint")
    closed = led.join(before, by).groupBy("rec_id").applyInPandas(ends, f"rec_id {rec}, _b bigint, end bigint")
    borders = closed.join(entered.select(*by, "enter"), by, "left")
    made = f"rec_id {rec}, frame_idx bigint, state bigint"
    # as text, since pandas makes floating point of whole numbers beside a null
    short = cut.join(many, "rec_id", "left_anti").select(F.col("rec_id").cast("string").alias("_key"), "_b", "frame_idx", "probs")
    short = short.repartition("_key", "_b").sortWithinPartitions("_key", "_b", "frame_idx").mapInPandas(whole, "_key string, frame_idx bigint, state bigint")
    short = short.select(F.col("_key").cast(rec).alias("rec_id"), "frame_idx", "state")
    return short.unionByName(long.select(*cut.columns).groupBy(*by).cogroup(named(borders)).applyInPandas(trace, made))
