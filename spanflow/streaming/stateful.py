"""Streams of frames, and operators that keep state by recording.

Without a watermark the frames of a recording must arrive in order. With one (event time column, delay) they may be out of
order: each waits in state until the watermark has passed its event time, and a timer at the recording's last event time
ends what is still open. Frames later than the delay are dropped by Spark. Such streams keep more than one kind of state,
for which Spark needs its RocksDB store: see use_rocksdb().
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..operators.segments import with_recording


def stream_frames(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    """New files of a frame store as a stream; with a checkpoint location it goes on where it stopped."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def _ordered(frames) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values("frame_idx", ignore_index=True)


def use_rocksdb(spark: SparkSession) -> None:
    """Makes the session's new streams keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


#: Frames of an entry of state, and an event time after all others.
HELD, NEVER = 10_000, 1 << 62


class InOrder(StatefulProcessor):
    """Hands a recording's frames on in order of frame_idx once the watermark has passed them. Waiting frames are kept in
    lists, an entry for what a batch brings, so that calls of the state follow the batches and not the frames.

    work(carry, frames) takes the tuple of what was kept (None at first) and a list of (frame_idx, value), and returns what
    to keep and rows to emit; end(carry) returns the rows that a recording's end emits."""

    def __init__(self, held: str, carry: str, names: list[str], work, end=None):
        self.held_schema, self.carry_schema, self.names, self.work, self.end = held, carry, names, work, end

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", self.held_schema)
        self.carry = handle.getValueState("carry", self.carry_schema)
        self.span = handle.getValueState("span", "first bigint, last bigint")

    def _ripe(self, before: int | None, span: tuple) -> tuple[list[tuple], tuple]:
        """Rows of the frames whose event time is before a time (None: all), and the event times that are left. State is read
        only when a frame is ripe; of a frame that came twice the later one counts."""
        if before is not None and span[0] >= before:
            return [], span
        held = {}
        for part in self.held.get():
            held.update(zip(part[0], zip(part[1], part[2], strict=True), strict=True))
        ready = sorted((k, v) for k, (v, t) in held.items() if before is None or t < before)
        late = [(k, v, t) for k, (v, t) in held.items() if before is not None and t >= before]
        parts = [tuple(map(list, zip(*late[i : i + HELD], strict=True))) for i in range(0, len(late), HELD)]
        self.held.put(parts) if parts else self.held.clear()
        span = min((t for *_, t in late), default=NEVER), span[1]
        if not ready:
            return [], span
        kept, rows = self.work(self.carry.get() if self.carry.exists() else None, ready)
        self.carry.update(kept)
        return rows, span

    def _table(self, key, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *r) for r in rows], columns=["rec_id", *self.names])

    def handleInputRows(self, key, rows, timerValues):
        was = self.span.get() if self.span.exists() else None
        first, last = was or (NEVER, -NEVER)
        for pdf in rows:
            ms = pdf["event_time"].astype("datetime64[ms]").astype("int64")
            self.held.appendValue((pdf["frame_idx"].tolist(), pdf["value"].tolist(), ms.tolist()))
            first, last = min(first, int(ms.min())), max(last, int(ms.max()))
        if not was or last != was[1]:
            if was:
                self.handle.deleteTimer(was[1] + 1)
            self.handle.registerTimer(last + 1)  # fires when the watermark is past the last frame
        out, span = self._ripe(timerValues.getCurrentWatermarkInMs(), (first, last))
        self.span.update(span)
        yield self._table(key, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        rows, _ = self._ripe(None, self.span.get())
        if self.end:
            rows += self.end(self.carry.get())
            self.carry.clear()
        self.span.clear()
        yield self._table(key, rows)

    def close(self) -> None:
        pass


def _in_order(frames: DataFrame, value: str, watermark: tuple, carry: str, out: str, work, end=None) -> DataFrame:
    kind, rec = frames.schema[value].dataType.simpleString(), frames.schema["rec_id"].dataType.simpleString()
    # names that Python takes for fields, which a column called class is not
    rows = frames.withWatermark(*watermark).select("rec_id", "frame_idx", F.col(value).alias("value"), F.col(watermark[0]).alias("event_time"))
    names = [part.strip().split(" ")[0] for part in out.split(",")]
    step = InOrder(f"frame_idx array<bigint>, value array<{kind}>, ms array<bigint>", carry, names, work, end)
    return rows.groupBy("rec_id").transformWithStateInPandas(step, f"rec_id {rec}, {out}", "Append", "EventTime")


def runs_stream(frames: DataFrame, key: str = "class", watermark: tuple | None = None) -> DataFrame:
    """rec_id, start, end, key of each run as soon as its key changes; the open run is state: its key, start and end.

    watermark: (event time column, delay): frames may come out of order, and a recording's open run ends once the watermark
    is past the recording's last frame."""
    kind, rec = frames.schema[key].dataType.simpleString(), frames.schema["rec_id"].dataType.simpleString()
    if watermark:

        def work(carry, ready):
            out = []
            k, start, end = carry or (None, None, None)
            for at, now in ready:
                if start is None or now != k:
                    if start is not None:
                        out.append((start, end, k))
                    k, start = now, at
                end = at + 1
            return (k, start, end), out

        return _in_order(frames, key, watermark, f"key {kind}, start bigint, end bigint", f"start bigint, end bigint, key {kind}", work, lambda c: [(c[1], c[2], c[0])])

    def step(names, parts, state: GroupState):
        out: list[tuple] = []
        k, start, end = state.get if state.exists else (None, None, None)
        pdf = _ordered(parts)
        for at, now in zip(pdf["frame_idx"].tolist(), pdf[key].tolist(), strict=True):
            if start is None or now != k:
                if start is not None:
                    out.append((names[0], start, end, k))
                k, start = now, at
            end = at + 1
        state.update((k, start, end))
        yield pd.DataFrame(out, columns=["rec_id", "start", "end", "key"])

    df = frames.select("rec_id", "frame_idx", key)
    return df.groupBy("rec_id").applyInPandasWithState(step, f"rec_id {rec}, start bigint, end bigint, key {kind}", f"key {kind}, start bigint, end bigint", "append", GroupStateTimeout.NoTimeout)


def _rolled(x: np.ndarray, win: int, std: bool):
    """The last len(x) - win + 1 values less the mean of the win that end there, by their deviation; null where that is 0."""
    view = np.lib.stride_tricks.sliding_window_view(x, win)
    y = view[:, -1] - view.mean(1)
    if std:
        s = view.std(1)
        return [float(a / b) if b > 0 else None for a, b in zip(y, s, strict=True)]
    return y.tolist()


def normalize_rolling_stream(frames: DataFrame, win: int, column: str = "value", std: bool = True, watermark: tuple | None = None) -> DataFrame:
    """rec_id, frame_idx and the value less the mean of the last win rows, by their deviation; the state is the last win - 1 values."""
    rec = frames.schema["rec_id"].dataType.simpleString()
    if watermark:

        def work(carry, ready):
            x = np.array([*(carry[0] if carry else []), *(v for _, v in ready)], float)
            made = _rolled(x, win, std) if len(x) >= win else []
            return (x[len(x) - min(len(x), win - 1) :].tolist(),), [(k, y) for (k, _), y in zip(ready[len(ready) - len(made) :], made, strict=True)]

        return _in_order(frames, column, watermark, "tail array<double>", f"frame_idx bigint, {column} double", work)

    def step(names, parts, state: GroupState):
        pdf = _ordered(parts)
        before = np.array(state.get[0] if state.exists else [], float)
        x = np.concatenate((before, pdf[column].to_numpy(float)))
        state.update((x[len(x) - min(len(x), win - 1) :].tolist(),))
        y = _rolled(x, win, std) if len(x) >= win else []
        at = pdf["frame_idx"].to_numpy()[len(pdf) - len(y) :]
        yield pd.DataFrame({"rec_id": [names[0]] * len(y), "frame_idx": at, column: pd.array(y, "Float64")})  # null, as in the batch form

    return frames.select("rec_id", "frame_idx", column).groupBy("rec_id").applyInPandasWithState(step, f"rec_id {rec}, frame_idx bigint, {column} double", "tail array<double>", "append", GroupStateTimeout.NoTimeout)


def class_counts_stream(frames: DataFrame, cls: str = "class") -> DataFrame:
    """Counts so far (output mode complete or update)."""
    return frames.groupBy(cls).agg(F.count(F.lit(1)).alias("n"))


def transitions_stream(frames: DataFrame, cls: str = "class", watermark: tuple | None = None) -> DataFrame:
    """rec_id, from_state, to_state, n of each batch's transitions; the state is a recording's last class."""
    rec, kind = frames.schema["rec_id"].dataType.simpleString(), frames.schema[cls].dataType.simpleString()

    def moves(classes: list) -> list[tuple]:
        return [(a, b, n) for (a, b), n in Counter(zip(classes, classes[1:], strict=False)).items()]

    if watermark:

        def work(carry, ready):
            classes = [*(carry or ()), *(v for _, v in ready)]
            return (classes[-1],), moves(classes)

        return _in_order(frames, cls, watermark, f"last {kind}", f"from_state {kind}, to_state {kind}, n bigint", work)

    def step(names, parts, state: GroupState):
        classes = [*(state.get if state.exists else ()), *_ordered(parts)[cls].tolist()]
        state.update((classes[-1],))
        yield pd.DataFrame([(names[0], *m) for m in moves(classes)], columns=["rec_id", "from_state", "to_state", "n"])

    return frames.select("rec_id", "frame_idx", cls).groupBy("rec_id").applyInPandasWithState(step, f"rec_id {rec}, from_state {kind}, to_state {kind}, n bigint", f"last {kind}", "append", GroupStateTimeout.NoTimeout)


enrich_stream = with_recording
