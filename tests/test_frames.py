import hashlib
import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanflow.functions import scalar as fn
from spanflow.operators import decode, evaluate, sampling, stats
from spanflow.operators import frames as R


def classes(spark, values, rec="a"):
    return spark.createDataFrame([(rec, i, x) for i, x in enumerate(values)], "rec_id string, frame_idx long, class int")


def test_runs_of_argmax(spark):
    probs = np.random.default_rng(3).dirichlet([1, 1, 1], 40)
    df = spark.createDataFrame([("a", i, p.tolist()) for i, p in enumerate(probs)], "rec_id string, frame_idx long, probs array<double>")
    got = [(r.start, r.end, r.key) for r in R.runs(df, fn.argmax("probs"), min_start=11, rate=50).orderBy("start").collect()]
    assert [k for s, e, k in got for _ in range(s, e)] == probs.argmax(1).tolist() and got[0][0] == 11
    assert all(a[1] == b[0] and a[2] != b[2] for a, b in zip(got, got[1:]))
    with pytest.raises(ValueError):
        R.runs(df, "frame_idx", rate=2.5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 2), min_size=1, max_size=30))
def test_runs_expand_to_the_same_frames(spark, values):
    got = R.runs(classes(spark, values), "class").orderBy("start").collect()
    assert [r.key for r in got for _ in range(r.start, r.end)] == values


def test_viterbi_against_all_paths(spark):
    rng = np.random.default_rng(8)
    init, trans = rng.dirichlet([1] * 3), rng.dirichlet([1] * 3, 3)
    recs = {k: rng.dirichlet([0.7] * 3, 6) for k in "abcd"}
    df = spark.createDataFrame([(k, i, p.tolist()) for k, x in recs.items() for i, p in enumerate(x)], "rec_id string, frame_idx long, probs array<double>")

    def best(obs):
        score = lambda path: np.log(init[path[0]]) + np.log(obs[range(6), path]).sum() + sum(np.log(trans[a, b]) for a, b in zip(path, path[1:]))
        return max(itertools.product(range(3), repeat=6), key=lambda p: score([*p]))

    scale = np.array([0.5, 0.3, 0.2])
    for t, axis, by in ((trans, "from_to", None), (trans.T, "to_from", None), (trans, "from_to", scale)):
        got = decode.viterbi(df, init.tolist(), t.tolist(), trans_axis=axis, scale_priors=None if by is None else by.tolist()).orderBy("rec_id", "frame_idx").collect()
        for k, x in recs.items():
            y = x if by is None else x / by / (x / by).sum(1, keepdims=True)
            assert tuple(r.state for r in got if r.rec_id == k) == best(y)


def test_rolling(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(10)], "rec_id string, frame_idx long, value double")
    got = R.rolling(df, F.avg("value"), 2, name="m").orderBy("frame_idx").collect()
    assert [r.m for r in got] == [i + 0.5 for i in range(9)]
    normed = R.normalize_rolling(df, 2).collect()
    assert len(normed) == 9 and all(r.value == pytest.approx(1.0) for r in normed)
    assert R.normalize_rolling(df, 3, first="copy").count() == 10


def test_subsample_keeps_at_least_one_of_a_run(spark):
    df = classes(spark, [0, 0, 0, 1, 1, 1, 1, 1, 1, 1, 2, 1, 1])
    for seed in (None, 3):
        got = sorted(r.frame_idx for r in sampling.subsample(df, {0: 0, 1: 0.2, 2: 1}, seed).collect())
        assert len(got) == 3 and 10 in got and sum(3 <= i < 10 for i in got) == 1


def test_confusion_with_empty_classes(spark):
    pairs = np.random.default_rng(6).integers(0, 3, (50, 2)).tolist()  # the fourth class never occurs
    df = spark.createDataFrame(pairs, "true int, pred int")
    want = {(a, b): pairs.count([a, b]) for a in range(4) for b in range(4)}
    assert {(r.true, r.pred): r.n for r in evaluate.confusion(df, nclasses=4).collect()} == want
    assert {(r.true, r.pred): r.n for r in evaluate.confusion(df).collect()} == {k: n for k, n in want.items() if max(k) < 3}
    normed = evaluate.normalize_confusion(evaluate.confusion(df, nclasses=4)).where(F.col("true") == 3).collect()
    assert all(r.recall is None for r in normed)
    with pytest.raises(PySparkException):
        evaluate.confusion(df, nclasses=2).collect()
    odd = evaluate.confusion(df, true=F.col("true") % 2, pred=F.lit(0), n=F.sum("pred")).collect()
    assert {(r.true, r.pred): r.n for r in odd if r.pred == 0} == {(k, 0): sum(b for a, b in pairs if a % 2 == k) for k in (0, 1)}
    assert evaluate.confusion(df.limit(0)).count() == 0 and evaluate.confusion(df.limit(0), nclasses=2).count() == 4


def test_evaluate_keeps_ids_and_counts_null_ones_once(spark):
    rows = [(7, 0, 0), (7, 1, 0), (None, 1, 1)]
    got = evaluate.evaluate(spark.createDataFrame(rows, "rec_id long, true int, pred int"), nclasses=2)
    assert dict(got.dtypes)["rec_id"] == "bigint"
    cells = {(r.is_total, r.rec_id, r.true, r.pred): r.n for r in got.collect()}
    assert len(cells) == 12 and sum(n for k, n in cells.items() if k[0]) == 3 and cells[False, None, 1, 1] == 1 and cells[True, None, 0, 0] == 1


def test_chunks_and_steps_against_arrays(spark):
    df = classes(spark, [0] * 53)
    got = sorted((r.chunk_id, r.frame_idx) for r in R.assign_chunks(df, 16, 4).collect())
    assert got == [(k, k * 12 + j) for k in range(4) for j in range(16)]
    steps = sorted((r.frame_idx, r.step) for r in sampling.assign_steps(R.assign_chunks(df, 53), 5).collect())
    assert [s for _, s in steps] == [min(i // 10, 4) for i in range(53)]


def test_context_drops_edges(spark):
    got = R.stack_context(R.assign_chunks(classes(spark, range(12)), 6), 1, feat="class").orderBy("frame_idx").collect()
    assert [r.context for r in got] == [[i - 1, i, i + 1] for i in (1, 2, 3, 4, 7, 8, 9, 10)]


def test_window_label_takes_the_lowest_of_equal(spark):
    got = R.window_label(classes(spark, [2, 1, 1, 2, 2]), 1).orderBy("frame_idx").collect()
    assert [r.window_class for r in got] == [1, 1, 1, 2, 2]


def test_merge_and_normalise(spark):
    df = spark.createDataFrame([("a", 0, 0, [0.5, 0.5]), ("a", 0, 1, [0.1, 0.9])], "rec_id string, frame_idx long, predictor int, probs array<double>")
    weights = spark.createDataFrame([(0, 1.0), (1, 3.0)], "predictor int, weight double")
    assert decode.merge_posteriors(df, weights).first().probs == pytest.approx([0.2, 0.8])
    by_class = spark.createDataFrame([(0, 1, 0.0), (0, 0, 1.0), (1, 0, 0.0), (1, 1, 1.0)], "predictor int, class int, weight double")
    assert decode.merge_posteriors(df, by_class).first().probs == pytest.approx([0.5 / 1.4, 0.9 / 1.4])
    assert decode.merge_posteriors(df, merge=lambda v: F.zip_with(v[0], v[1], lambda a, b: F.greatest(a, b))).first().probs == pytest.approx([0.5 / 1.4, 0.9 / 1.4])
    with pytest.raises(PySparkException):
        decode.merge_posteriors(df, weights.where("predictor = 0")).collect()


def test_plans_number_all_chunks_once(spark):
    df = spark.createDataFrame([(f"r{k % 7}", k // 7, k % 3) for k in range(90) for _ in range(1 + k % 4)], "rec_id string, chunk_id int, class int")
    for seed in (None, 5):
        plan = sampling.batch_plan(df, 2, seed).collect()
        for p in (0, 1):
            order = [(r.rec_id, r.chunk_id) for r in sorted((r for r in plan if r["pass"] == p), key=lambda r: r.chunk_pos)]
            draw = lambda k, p=p: hashlib.md5(f"{seed}:{p}:{k[0]}:{k[1]}".encode()).hexdigest()
            assert order == sorted(order, key=draw if seed else None) and len({*order}) == 90
    late = sampling.batch_plan(df, 2, 5, start=(1, 3)).agg(F.min("chunk_pos"), F.count(F.lit(1))).first()
    assert tuple(late) == (3, 87)
    steps = sampling.batch_plan(df, 1, None, steps=3)
    assert steps.agg(F.sum("rows")).first()[0] == df.count()
    assert "class" not in sampling.take_plan(steps, df, labels=False).columns


def test_windows_of_nested_arrays(spark):
    grid = [[float(10 * i + j) for j in range(5)] for i in range(4)]
    got = spark.createDataFrame([(grid,)], "g array<array<double>>").select(R.windows("g", (2, 3), (2, 1)).alias("w")).first().w
    assert got == [[[grid[i + a][j : j + 3] for j in range(3)] for a in range(2)] for i in (0, 2)]


def test_chunk_checks(spark):
    rows = [("a", 0, i) for i in range(4)] + [("a", 1, i) for i in (4, 5, 7, 8)] + [("b", 0, 0)]
    df = spark.createDataFrame(rows, "rec_id string, chunk_id int, frame_idx long")
    assert sorted((r.rec_id, r.chunk_id, r.problem) for r in R.check_chunks(df, 4).collect()) == [("a", 1, "gap"), ("b", 0, "size")]


def test_window_label_by_expression(spark):
    got = R.window_label(classes(spark, [2, 0, 1, 2]), 1, F.min("class")).orderBy("frame_idx").collect()
    assert [r.window_class for r in got] == [0, 0, 0, 1]


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    for text, seconds in (("9.25", 9.25), ("2:03.5", 123.5), ("2:0:7", 7207), ("10:20:30.125", 37230.125), ("00:00:30,75", 30.75)):
        assert value(fn.clock_seconds(F.lit(text))) == pytest.approx(seconds)
    assert value(fn.clock_seconds(F.lit(2), F.lit(3.5))) == 123.5 and value(fn.clock_seconds(F.lit(2), F.lit(0), F.lit(7))) == 7207 and value(fn.clock_seconds(F.lit(4.5))) == 4.5
    t = value(fn.combine_time(fn.time_point(F.lit("T01:00:02:3F4")), fn.duration(F.lit("PT1M5S2N6F"))))
    assert (t.start, t.end, t.rate) == (43233, 44017, 12)
    assert value(fn.lcm(F.lit(0), F.lit(4))) == 0 and value(fn.lcm(F.lit(21), F.lit(6))) == 42
    assert value(fn.recording_id(F.lit("/x/fe_03_00001.txt"))) == "00001"
    assert value(fn.one_hot(F.lit(1), 3)) == [0, 1, 0] and value(fn.one_hot(F.lit(2))) == [0, 0, 1]
    assert value(R.windows(F.sequence(F.lit(0), F.lit(6)), 3, 2)) == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]
    assert [value(fn.bin_key(F.lit(x), 0, 10, 5)) for x in (0.0, 9.9, 10.0, 10.1, -1.0)] == [1, 5, 5, None, None]


def test_rescale_ignores_nan(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (None,)], "v double")
    assert sorted(r.v for r in stats.rescale(df, "v").collect() if r.v is not None) == [0.0, 1.0]


def test_rolling_of_vectors(spark):
    """Vectors get the figures of their numbers one by one, also where the first full window is longer than a block."""
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(r, k, rng.normal(size=3).tolist()) for r in ("a", "b") for k in range(30)], "rec_id string, frame_idx bigint, feat array<double>")
    flat = df.select("rec_id", "frame_idx", F.posexplode("feat").alias("bin", "value"))
    for first, size in (("skip", 64), ("copy", 64), ("copy", 4), ((0.5, 4.0), 7)):
        want = {(r.rec_id, r.frame_idx, r.bin): r.value for r in R.normalize_rolling(flat, 6, first=first, keys=("rec_id", "bin"), size=size).collect()}
        got = R.normalize_rolling(df, 6, first=first, column="feat", size=size, dims=3)
        assert {(r.rec_id, r.frame_idx, b): x for r in got.collect() for b, x in enumerate(r.feat)} == pytest.approx(want)
    assert got.columns == df.columns
