"""Stores that several writers share, sound that is read by ranges, documents that grow."""

import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanflow.operators import decode, sampling
from spanflow.plans.annotate import annotate, classify, fit_frame_classifier, predictor_of
from spanflow.sources import annotations as A
from spanflow.sources import audio, store


def test_two_writers_at_once(spark, tmp_path):
    """Overlapping keys from three threads: each key once, whichever writer was first."""
    path, errors = f"file:{tmp_path}/results", []

    def write(k):
        try:
            store.append_results(spark.range(k * 10, k * 10 + 30).select(F.col("id").alias("key"), F.lit(k).alias("who")), path, ["key"])
        except Exception as e:  # noqa: BLE001 - seen by the test
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = store.read_results(spark, path).collect()
    assert not errors and sorted(r.key for r in rows) == [*range(50)]
    assert all(10 * r.who <= r.key < 10 * r.who + 30 for r in rows)


def test_a_killed_writer_leaves_nothing(spark, tmp_path, monkeypatch):
    path, df = f"file:{tmp_path}/results", spark.range(5).select(F.col("id").alias("key"), F.lit("a").alias("x"))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            store.append_results(df, path, ["key"])
    with pytest.raises(FileNotFoundError):
        store.read_results(spark, path)
    assert store.append_results(df, path, ["key"]) == 5 and store.append_results(df, path, ["key"]) == 0
    assert store.read_results(spark, path).count() == 5


def test_a_writer_that_loses_the_race(spark, tmp_path, monkeypatch):
    """Another writer commits between this one's reading and its commit: the keys in between are left out."""
    path, taken = f"file:{tmp_path}/results", []
    real = store._commit

    def late(spark_, where, number, batch):
        if not taken:
            taken.append(1)
            store.append_results(spark.createDataFrame([(1, "other"), (None, "other")], "key long, x string"), path, ["key"])
        return real(spark_, where, number, batch)

    monkeypatch.setattr(store, "_commit", late)
    rows = [(1, "b"), (2, "c"), (2, "b"), (None, "me")]
    assert store.append_results(spark.createDataFrame(rows, "key long, x string"), path, ["key"]) == 1
    assert sorted(map(tuple, store.read_results(spark, path).collect()), key=str) == [(1, "other"), (2, "b"), (None, "other")]


def wav(path, x, rate=8000, channels=1, before=b""):
    raw = (np.asarray(x) * 32767).astype("<i2").tobytes()
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16)
    body = b"WAVE" + before + fmt + struct.pack("<4sI", b"data", len(raw)) + raw
    path.write_bytes(struct.pack("<4sI", b"RIFF", len(body)) + body)


def test_sound_is_read_by_ranges(spark, tmp_path, monkeypatch):
    x = np.sin(np.arange(5000) / 9) * 0.5
    wav(tmp_path / "a.wav", x, before=struct.pack("<4sI", b"LIST", 100_001) + b"\0" * 100_002)
    wav(tmp_path / "b.wav", np.repeat(x[:7], 2), channels=2)
    wav(tmp_path / "c.wav", [])
    rows = {r.rec_id: (r.samples, r.channels) for r in audio.audio_catalog(spark, str(tmp_path)).collect()}
    assert rows == {"a": (5000, 1), "b": (7, 2), "c": (0, 1)}
    got = audio.read_samples(spark, str(tmp_path), block=999, mono=False).orderBy("rec_id", "channel", "block").collect()
    assert [(r.rec_id, r.channel, r.block, len(r.samples)) for r in got] == [*(("a", 0, k, 999) for k in range(5)), ("a", 0, 5, 5), ("b", 0, 0, 7), ("b", 1, 0, 7)]
    assert np.allclose(np.concatenate([r.samples for r in got[:6]]), (x * 32767).astype("<i2") / 32768)
    # what is read of a header doesn't grow with the file
    seen = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def read(self, n):
            seen.append(n)
            return self.f.read(n)

        def seek(self, *to):
            return self.f.seek(*to)

    with open(tmp_path / "a.wav", "rb") as f:
        audio._wav_head(Counted(f), 10**6)
    assert sum(seen) < 200


@pytest.mark.parametrize("size", [1, 33, 100, 2000])
def test_logmel_of_any_blocks(spark, size):
    x = np.random.default_rng(0).normal(size=2000)
    want = audio.logmel_frames(x, audio.mel_bank(8000, 256, 16), 256, 80)
    rows = [("a", k, x[k * size : (k + 1) * size].tolist()) for k in range(-(-len(x) // size))] + [("b", 0, x[:100].tolist()), ("c", 0, [])]
    df = spark.createDataFrame(rows, "rec_id string, block int, samples array<double>")
    for frames in (3, 4096):
        got = audio.logmel(df, n_mels=16, frames=frames).orderBy("frame_idx").collect()
        assert [r.frame_idx for r in got] == [*range(len(want))] and np.allclose([r.feat for r in got], want)


def test_a_tier_is_added_once(spark, tmp_path):
    tiers = spark.createDataFrame([("a", "x", 0, 1000, "p & q")], "rec_id string, tier string, start long, end long, content string")
    A.write_eaf(tiers, f"{tmp_path}/1")
    more = tiers.withColumn("tier", F.lit("y"))
    A.add_to_eaf(spark, f"{tmp_path}/1", more, f"{tmp_path}/2", glob="*", rec_id=A.folder_id())
    got = A.read_eaf(spark, f"{tmp_path}/2", glob="*").select("tier", "start", "end", "content").collect()
    assert sorted(map(tuple, got)) == [("x", 0, 1000, "p & q"), ("y", 0, 1000, "p & q")]
    with pytest.raises(Exception, match="has this tier"):
        A.add_to_eaf(spark, f"{tmp_path}/2", more, f"{tmp_path}/3", glob="*", rec_id=A.folder_id())


def test_classifier_against_its_coefficients(spark):
    """Posteriors are the softmax of the fitted linear maps, and the classes are told apart."""
    rng = np.random.default_rng(2)
    cls = rng.integers(0, 3, 300)
    x = rng.normal(size=(300, 2, 2)) + np.array([[0, 0], [4, 0], [0, 4]])[cls][:, None]
    df = spark.createDataFrame([(i, int(c), v.tolist()) for i, (c, v) in enumerate(zip(cls, x, strict=True))], "frame_idx long, class int, context array<array<double>>")
    model = fit_frame_classifier(df)
    got = classify(df, model).orderBy("frame_idx").collect()
    z = x.reshape(300, -1) @ model.coefficientMatrix.toArray().T + model.interceptVector.toArray()
    p = np.exp(z - z.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    assert np.allclose([r.probs for r in got], p) and (p.argmax(1) == cls).mean() > 0.97


def test_a_resumed_pass_skips_files(spark, tmp_path):
    """No shuffle of the frames; what is read falls with the start position; the plan's parts make up the whole."""
    df = spark.range(2000).select((F.col("id") % 5).cast("string").alias("rec_id"), F.floor(F.col("id") / 5).alias("frame_idx"), F.floor(F.col("id") / 50).alias("chunk_id"), F.array(F.lit(1.0)).alias("feat"))
    store.write_frame_table(df, "kept_frames", f"file:{tmp_path}/frames", 4, 5)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keys = ("chunk_range", "rec_id", "chunk_id")
        rows, files = [], []
        for start in ((0, 0), (0, 120), (0, 195)):
            plan = sampling.batch_plan(spark.table("kept_frames"), 1, 3, keys, start, first=1)
            plan = spark.createDataFrame(plan.collect(), plan.schema)
            taken = store.read_plan(plan, "kept_frames")
            shuffles = [x for x in taken._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
            assert len(shuffles) == 1  # the plan's
            rows.append(taken.count())
            files.append(taken.select("chunk_range").distinct().count())
        assert rows == [2000, 800, 50] and files[0] == 8 and files[1] < 5 and files[2] == 1
        whole = sampling.batch_plan(spark.table("kept_frames"), 1, 3, keys, first=1).orderBy("chunk_pos").collect()
        assert [r.chunk_pos for r in whole] == [*range(200)]
        assert sum(a.chunk_range != b.chunk_range for a, b in zip(whole, whole[1:], strict=False)) == 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.sql("drop table kept_frames")


def test_annotation_against_numpy(spark, tmp_path):
    """The whole chain, from a sound file to tiers in milliseconds, and a file that can't be read."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=6000) * np.repeat(rng.choice([0.02, 0.2, 0.6], 12), 500)
    x = np.clip(x, -1, 1)
    wav(tmp_path / "one.wav", x)
    (tmp_path / "bad.wav").write_bytes(b"RIFF nothing")
    win, hop, mels, norm, c = 256, 80, 8, 12, 2
    weights, bias = rng.normal(size=(3, (2 * c + 1) * mels)), np.array([0.1, 0.0, -0.1])
    init, stay = [0.5, 0.3, 0.2], [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    got = annotate(spark, str(tmp_path), predictor_of(weights, bias), init, stay, win=win, hop=hop, n_mels=mels, norm=norm, context=c).collect()

    feat = audio.logmel_frames((x * 32767).astype("<i2") / 32768, audio.mel_bank(8000, win, mels), win, hop)
    part = [feat[max(0, i - norm + 1) : i + 1] if i >= norm - 1 else feat[:norm] for i in range(len(feat))]
    normed = np.array([(f - p.mean(0)) / p.std(0) for f, p in zip(feat, part, strict=True)])
    stacked = np.stack([normed[i - c : i + c + 1].reshape(-1) for i in range(c, len(normed) - c)])
    z = stacked @ weights.T + bias
    p = np.exp(z - z.max(1, keepdims=True))
    states = decode.best_path(p / p.sum(1, keepdims=True), np.array(init), np.array(stay))
    cuts = [0, *(np.flatnonzero(np.diff(states)) + 1).tolist(), len(states)]
    tick = lambda k: int(np.rint((k + (win // 2 + c * hop) / hop) * 1000 * hop / 8000))
    want = [("one", ("none", "single", "multiple")[states[a]], tick(a), tick(b)) for a, b in zip(cuts, cuts[1:], strict=False)]
    assert sorted((r.rec_id, r.tier, r.start, r.end) for r in got if r.problem is None) == sorted(want) and len(want) > 3
    assert [(r.rec_id, r.tier) for r in got if r.problem] == [("bad", None)]


def test_logmel_of_many_short_stretches(spark):
    """Stretches of many recordings are worked on together, also of recordings without a name or shorter than a window."""
    bank, made = audio.mel_bank(8000, 32, 8), {}
    rng = np.random.default_rng(3)
    rows = []
    for rec, n in [(None, 90), *((k, 10 + 7 * k) for k in range(40)), (2**60 + 1, 3000)]:
        x = rng.normal(size=n)
        made[rec] = audio.logmel_frames(x, bank, 32, 8)
        rows += [(rec, b, x[k : k + 1100].tolist()) for b, k in enumerate(range(0, n, 1100))]
    df = spark.createDataFrame(rows, "rec_id bigint, block int, samples array<double>")
    for frames in (2, 4096):
        feats = audio.logmel(df, 8000, 32, 8, 8, frames=frames)
        assert not any(w in feats._jdf.queryExecution().toString() for w in ("FlatMapGroupsInPandas", "FlatMapGroupsInArrow"))  # a group for each stretch before
        got = {}
        for r in feats.orderBy("frame_idx").collect():
            got.setdefault(r.rec_id, []).append(r.feat)
        assert {k: len(v) for k, v in got.items()} == {k: len(v) for k, v in made.items() if len(v)}
        assert all(np.allclose(v, made[k]) for k, v in got.items())


def test_many_blocks_in_one_table(spark, tmp_path):
    """Short blocks leave a task together, and those with a problem among them."""
    for k in range(5):
        (tmp_path / f"f{k}.wav").write_bytes(b"RIFF" + bytes(4) + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\x01\0\x01\0" + (8000).to_bytes(4, "little") + bytes(6) + b"\x08\0data" + (950).to_bytes(4, "little") + bytes([128 + k]) * 950)
    (tmp_path / "bad.wav").write_bytes(b"no")
    got = {(r.rec_id, r.block): r for r in audio.read_samples(spark, str(tmp_path), block=100, strict=False).collect()}
    assert len(got) == 51 and all(len(got[f"f{k}", b].samples) == (50 if b == 9 else 100) and got[f"f{k}", b].samples[0] == k / 128 for k in range(5) for b in range(10))
    assert [r.problem for r in got.values() if r.problem] == ["not a WAV file"]


def test_annotation_reads_few_times(spark, tmp_path):
    """Tasks list the files, problems come from headers, and smoothing starts from stored posteriors."""
    for k in range(12):
        wav(tmp_path / f"f{k}.wav", np.sin(np.arange(400 + k) / (k + 2)))
    (tmp_path / "bad.wav").write_bytes(b"RIFF nothing")
    made = annotate(spark, str(tmp_path), predictor_of(np.ones((3, 24)), np.zeros(3)), [0.6, 0.2, 0.2], [[0.8, 0.1, 0.1]] * 3, win=64, hop=32, n_mels=8, norm=5, context=1)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryFile" not in plan and "predict" not in plan and "ArrowEvalPython" not in plan
    got = made.collect()
    assert {r.rec_id for r in got if r.tier} == {f"f{k}" for k in range(12)} and [r.rec_id for r in got if r.problem] == ["bad"]
