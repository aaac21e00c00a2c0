import datetime
import random
from collections import Counter
from types import SimpleNamespace

import pandas as pd
import pytest

from spanflow.operators import decode
from spanflow.operators import frames as R
from spanflow.streaming import stateful as T

SCHEMA = "rec_id string, frame_idx long, class int, value double"
VALUES = [0, 0, 1, 1, 1, 0, 2, 2]


def run(spark, tmp_path, make, mode="append"):
    """All files one by one through a stream; a restart half way goes on from the checkpoint."""
    rows = [("a", i, c, float(i * i % 7)) for i, c in enumerate(VALUES)]
    src, out = str(tmp_path / "in"), []

    def keep(df, _):
        out.extend(df.collect())

    for part in (rows[:3], rows[3:5], rows[5:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = make(T.stream_frames(spark, src, SCHEMA, 1))
        q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.createDataFrame(rows, SCHEMA), out


def test_runs_stream(spark, tmp_path):
    batch, got = run(spark, tmp_path, T.runs_stream)
    want = [(r.start, r.end, r.key) for r in R.runs(batch, "class").orderBy("start").collect()]
    assert sorted((r.start, r.end, r.key) for r in got) == want[:-1]  # the last run is still open


def test_rolling_stream(spark, tmp_path):
    batch, got = run(spark, tmp_path, lambda s: T.normalize_rolling_stream(s, 3))
    want = {r.frame_idx: r.value for r in R.normalize_rolling(batch, 3).collect()}
    assert {r.frame_idx for r in got} == {*want} and all(abs(r.value - want[r.frame_idx]) < 1e-9 for r in got)


def test_transitions_stream(spark, tmp_path):
    batch, got = run(spark, tmp_path, T.transitions_stream)
    sums: dict = {}
    for r in got:
        sums[r.from_state, r.to_state] = sums.get((r.from_state, r.to_state), 0) + r.n
    assert sums == {(r.from_state, r.to_state): r.n for r in decode.priors_from_frames(batch)[1].collect()}


def test_counts_and_enrichment(spark, tmp_path):
    people = spark.createDataFrame([("a", "ann")], "rec_id string, name string")
    _, got = run(spark, tmp_path, lambda s: T.class_counts_stream(T.enrich_stream(s, people).where("name = 'ann'")), "complete")
    assert {r["class"]: r.n for r in got} == {0: 3, 1: 3, 2: 2}


TIMED = SCHEMA + ", ts timestamp"


def timed(spark, tmp_path, make, batches):
    """Batches of (recording, frame, class, second), one file each; a restart after each goes on from the checkpoint."""
    T.use_rocksdb(spark)
    many = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    src, out = str(tmp_path / "in"), []
    try:
        for part in batches:
            rows = [(rec, i, c, float(i * i % 7), datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)) for rec, i, c, s in part]
            spark.createDataFrame(rows, TIMED).coalesce(1).write.mode("append").parquet(src)
            stream = make(T.stream_frames(spark, src, TIMED, 1))
            q = stream.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda df, _: out.extend(df.collect())).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", many)
    return out


def test_a_batch_without_a_recording_ends_no_run(spark, tmp_path):
    batches = [[("a", 0, 0, 0), ("a", 1, 0, 1)], [("b", 0, 1, 2)], [("a", 2, 0, 3), ("a", 3, 0, 4)], [("z", 0, 0, 500)], [("z", 1, 0, 501)]]
    got = timed(spark, tmp_path, lambda s: T.runs_stream(s, watermark=("ts", "60 seconds")), batches)
    assert sorted((r.rec_id, r.start, r.end, r.key) for r in got) == [("a", 0, 4, 0), ("b", 0, 1, 1)]


def test_frames_out_of_order(spark, tmp_path):
    rng = random.Random(3)
    frames = [(rec, i, (i // 3 + (rec == "b")) % 2, i) for rec in "ab" for i in range(24)]
    late = sorted(frames, key=lambda f: f[3] + rng.uniform(0, 9))
    batches = [late[:15], late[15:30], late[30:], [("z", 0, 0, 500)], [("z", 1, 0, 501)]]
    batch = spark.createDataFrame([(rec, i, c, float(i * i % 7)) for rec, i, c, _ in frames], SCHEMA)
    ws = {"watermark": ("ts", "10 seconds")}
    got = timed(spark, tmp_path / "1", lambda s: T.runs_stream(s, **ws), batches)
    want = [tuple(r) for r in R.runs(batch, "class").select("rec_id", "start", "end", "key").collect()]
    assert sorted((r.rec_id, r.start, r.end, r.key) for r in got) == sorted(want)
    got = timed(spark, tmp_path / "2", lambda s: T.normalize_rolling_stream(s, 3, **ws), batches)
    want = {(r.rec_id, r.frame_idx): r.value for r in R.normalize_rolling(batch, 3).collect()}
    assert {(r.rec_id, r.frame_idx): r.value for r in got} == pytest.approx(want)
    got = timed(spark, tmp_path / "3", lambda s: T.transitions_stream(s, **ws), batches)
    sums: Counter = Counter()
    for r in got:
        sums[r.from_state, r.to_state] += r.n
    assert sums == {(r.from_state, r.to_state): r.n for r in decode.priors_from_frames(batch)[1].collect()}


class Kept:
    """State of a stream in memory that counts its calls."""

    def __init__(self):
        self.x, self.calls, self.timers = {}, 0, set()

    def _of(self, name):
        self.calls += 1
        return self.x.get(name)

    def _set(self, name, value):
        self.calls += 1
        self.x[name] = value

    def getValueState(self, name, _):
        return SimpleNamespace(exists=lambda: self._of(name) is not None, get=lambda: self._of(name), update=lambda v: self._set(name, v), clear=lambda: self._set(name, None))

    def getListState(self, name, _):
        return SimpleNamespace(get=lambda: iter(self._of(name) or []), appendValue=lambda v: self._set(name, [*(self.x.get(name) or []), v]), put=lambda v: self._set(name, v), clear=lambda: self._set(name, None))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


def test_calls_of_state_follow_batches():
    kept = Kept()
    step = T.InOrder("", "", ["at"], lambda carry, ready: ((1,), [(k,) for k, _ in ready]))
    step.init(kept)
    out = []
    for part, mark in ((range(0, 3000, 2), 0), (range(1, 3000, 2), 0), (range(3000, 3001), 1500)):
        pdf = pd.DataFrame({"frame_idx": list(part), "value": 0, "event_time": pd.to_datetime(list(part), unit="ms")})
        out += pd.concat(step.handleInputRows(("a",), iter([pdf]), SimpleNamespace(getCurrentWatermarkInMs=lambda m=mark: m)))["at"].tolist()
        assert kept.timers == {max(part) + 1} if len(part) > 1 else kept.timers == {3001}
    assert out == list(range(1500)) and kept.calls < 30  # more than 3,000 when each frame had an entry
    assert pd.concat(step.handleExpiredTimer(("a",), None, None))["at"].tolist() == list(range(1500, 3001))
