"""Operators over blocks give the same at every block size, and what a plain loop gives."""

import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanflow.operators import decode, stats
from spanflow.operators import frames as R
from spanflow.operators import segments as S


def plain_path(obs, init, step):
    """One frame after the other, in the same fixed-point numbers."""
    score, back = init + obs[0], []
    for o in obs[1:]:
        reach = score[:, None] + step
        back.append(reach.argmax(0))
        score = reach.max(0) + o
    path = [int(score.argmax())]
    for b in back[::-1]:
        path.append(int(b[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize(("blocks", "ties"), [(1, False), (7, True), (100, False)])
def test_viterbi_in_blocks(spark, blocks, ties):
    rng = np.random.default_rng(blocks)
    init, trans = np.array([0.5, 0.25, 0.25]), np.array([[0.9, 0.1, 0.0], [0.05, 0.9, 0.05], [0.0, 0.1, 0.9]])
    n, rows, want = 700, [], []
    for rec, many in (("a", n), ("b", 5), ("c", 1), ("d", 2 * n // blocks + 1)):
        p = rng.choice([0.25, 0.5], (many, 3)) if ties else rng.dirichlet([1, 1, 1], many)
        rows += [(rec, i, x) for i, x in enumerate(p.tolist())]
        want += [(rec, i, s) for i, s in enumerate(plain_path(decode.fixed_log(p), decode.fixed_log(init), decode.fixed_log(trans)))]
    df = spark.createDataFrame(rows, "rec_id string, frame_idx long, probs array<double>").repartition(3)
    got = decode.viterbi(df, init.tolist(), trans.tolist(), size=-(-n // blocks))
    assert sorted(map(tuple, got.collect())) == want
    if blocks == 1:
        turned = decode.viterbi(df, init.tolist(), trans.T.tolist(), trans_axis="to_from", size=350)
        assert sorted(map(tuple, turned.collect())) == want


def test_best_path_of_any_length():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 5, 16, 17, 99, 400):
        p, init, trans = rng.dirichlet([1] * 4, n), rng.dirichlet([1] * 4), rng.dirichlet([1] * 4, 4)
        assert decode.best_path(p, init, trans).tolist() == plain_path(decode.fixed_log(p), decode.fixed_log(init), decode.fixed_log(trans))


def test_viterbi_of_many_recordings(spark):
    """Short recordings are traced side by side, whatever their lengths and however Arrow cuts their rows."""
    rng = np.random.default_rng(8)
    init, trans = np.array([0.5, 0.3, 0.2]), np.array([[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]])
    made = {k: rng.dirichlet([1, 1, 1], n) for k, n in [(None, 9), *((k, 1 + k * k % 41) for k in range(60)), (2**60 + 1, decode.SHORT + 60), (-5, 700)]}
    made[3] = np.full((9, 3), 1 / 3)  # ties
    df = spark.createDataFrame([(k, i, p.tolist()) for k, v in made.items() for i, p in enumerate(v)], "rec_id bigint, frame_idx bigint, probs array<double>").repartition(7)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("50", batch):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            out, got = decode.viterbi(df, init.tolist(), trans.tolist()), {}
            for r in out.orderBy("frame_idx").collect():
                got.setdefault(r.rec_id, []).append(r.state)
            assert got == {k: decode.best_path(v, init, trans).tolist() for k, v in made.items()}
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert any(line.strip(" +-:|").startswith("MapInPandas") for line in plan.splitlines())  # before, a group for each recording
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_viterbi_with_a_gap(spark):
    """Blocks without frames in between, frame numbers that don't start at 0."""
    rng = np.random.default_rng(1)
    at = [*range(30, 60), *range(400, 430), *range(431, 440)]
    p = rng.dirichlet([1, 1], len(at))
    df = spark.createDataFrame([(1, i, x) for i, x in zip(at, p.tolist(), strict=True)], "rec_id long, frame_idx long, probs array<double>")
    want = plain_path(decode.fixed_log(p), decode.fixed_log([0.5, 0.5]), decode.fixed_log([[0.8, 0.2], [0.2, 0.8]]))
    for size in (16, 1000):
        got = decode.viterbi(df, [0.5, 0.5], [[0.8, 0.2], [0.2, 0.8]], size=size).orderBy("frame_idx").collect()
        assert [r.state for r in got] == want


def frames_of(spark, seed=0, n=300):
    rng = np.random.default_rng(seed)
    rows = [(rec, int(i), str(rng.choice(["x", "y"], p=[0.8, 0.2])) if rng.random() < 0.9 else None, float(rng.normal())) for rec in "ab" for i in np.sort(rng.choice(2 * n, n, False))]
    return rows, spark.createDataFrame(rows, "rec_id string, frame_idx long, class string, value double").repartition(4)


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_runs_in_blocks(spark, size):
    rows, df = frames_of(spark)
    want = []
    for rec, group in itertools.groupby(rows, lambda r: r[0]):
        at = 0
        for run, (k, part) in enumerate(itertools.groupby(group, lambda r: r[2])):
            part = list(part)
            want.append((rec, run, at, at + len(part), k, [r[1] for r in part]))
            at += len(part)
    got = R.runs(df, "class", keep="both", size=size).select("rec_id", "run", "start", "end", "key", "labels")
    assert sorted(map(tuple, got.collect())) == want
    got = R.runs(df, F.col("class"), size=size, min_start=3, rate=2).select("rec_id", "run", F.col("start") - 3, F.col("end") - 3, "key")
    assert sorted(map(tuple, got.collect())) == [r[:5] for r in want]


@pytest.mark.parametrize(("size", "first"), [(1, "skip"), (7, "skip"), (7, "copy"), (50, "copy"), (7, (0.5, 4.0)), (1 << 16, "copy")])
def test_rolling_in_blocks(spark, size, first):
    rows, df = frames_of(spark, 1, 120)
    want, sums = {}, {}
    for rec, group in itertools.groupby(rows, lambda r: r[0]):
        group = list(group)
        x = np.array([r[3] for r in group])
        for i, r in enumerate(group):
            part = x[i - 8 : i + 1] if i >= 8 else x[:9]
            if i >= 8 or first == "copy":
                want[rec, r[1]] = (x[i] - part.mean()) / part.std()
            elif first != "skip":
                want[rec, r[1]] = (x[i] - 0.5) / 2.0
            if i % 3 == 0 and i + 9 <= len(x):
                sums[rec, r[1]] = x[i : i + 9].sum()
    got = {(r.rec_id, r.frame_idx): r.value for r in R.normalize_rolling(df, 9, first=first, size=size).collect()}
    assert got == pytest.approx(want)
    if first == "skip":
        rolled = {(r.rec_id, r.frame_idx): r.total for r in R.rolling(df, {"total": F.sum("value")}, 9, 3, size=size).collect()}
        assert rolled == pytest.approx(sums)


@pytest.mark.parametrize("size", [1, 7, 1 << 16])
def test_priors_in_blocks(spark, size):
    rows, df = frames_of(spark, 2)
    rows = [(a, b, c or "z", v) for a, b, c, v in rows]
    states, moves = decode.priors_from_frames(df.fillna("z", ["class"]), size=size)
    want = Counter()
    for _, group in itertools.groupby(rows, lambda r: r[0]):
        classes = [r[2] for r in group]
        want.update(zip(classes, classes[1:], strict=False))
    assert {(r.from_state, r.to_state): r.n for r in moves.collect()} == want
    heads = Counter(next(g)[2] for _, g in itertools.groupby(rows, lambda r: r[0]))
    counts = Counter(r[2] for r in rows)
    assert {r.state: (r.init, r.prior) for r in states.collect()} == {k: (heads[k], n) for k, n in counts.items()}
    segments = df.fillna("z", ["class"]).select("rec_id", F.col("frame_idx").cast("double").alias("start"), (F.col("frame_idx") + 1.0).alias("end"), F.col("class").alias("label"))
    states, moves = decode.priors_from_segments(segments, width=float(size))
    assert {(r.from_state, r.to_state): r.n for r in moves.where("n > 0").collect()} == want
    assert {r.state: (r.init, r.prior) for r in states.collect()} == {k: (heads[k], n) for k, n in counts.items()}


def test_priors_with_keys_and_an_expression(spark):
    """The state and the keys are given as expressions; a move counts for the keys of the segment that it leaves."""
    rows = [("a", 0.0, 2.0, "x1", "g"), ("a", 2.0, 5.0, "y1", "g"), ("a", 5.0, 6.0, "x2", "h"), ("b", 0.0, 1.0, "y3", "h")]
    df = spark.createDataFrame(rows, "rec_id string, start double, end double, label string, grp string")
    for width in (None, 1.0, 100.0):
        states, moves = decode.priors_from_segments(df, F.substring("label", 1, 1), ("grp",), width=width)
        assert {(r.grp, r.from_state, r.to_state): r.n for r in moves.collect()} == {("g", "x", "y"): 1.0, ("g", "y", "x"): 1.0, ("g", "x", "x"): 1.0, ("g", "y", "y"): 2.0, ("h", "x", "x"): 0.0, ("h", "y", "y"): 0.0}
        assert {(r.grp, r.state): (r.init, r.prior) for r in states.collect()} == {("g", "x"): (1, 2.0), ("g", "y"): (0, 3.0), ("h", "x"): (0, 1.0), ("h", "y"): (1, 1.0)}


def spans(spark, seed=3, n=150):
    rng = np.random.default_rng(seed)
    rows = sorted((rec, float(s), float(s + rng.integers(1, 40)), str(rng.choice(list("pqr")))) for rec in "ab" for s in rng.integers(0, 300, n))
    rows = [(*r, i) for _, g in itertools.groupby(rows, lambda r: r[0]) for i, r in enumerate(g)]
    return rows, spark.createDataFrame(rows, "rec_id string, start double, end double, label string, seg_idx int").repartition(4)


@pytest.mark.parametrize("width", [None, 1.0, 13.0, 1000.0])
def test_flatten_in_stretches(spark, width, monkeypatch):
    rows, df = spans(spark)
    if width is None:
        monkeypatch.setattr(S.B, "ROWS", 20)  # the choice by numbers of segments, many stretches a recording
    want = []
    for rec in "ab":
        own = [r for r in rows if r[0] == rec]
        cuts = sorted({x for r in own for x in r[1:3]})
        for a, b in zip(cuts, cuts[1:], strict=False):
            inside = [r for r in own if r[1] <= a and r[2] >= b]
            want.append((rec, a, b, [r[4] for r in inside], [r[3] for r in inside]))
    assert sorted(map(tuple, S.flatten(df, width=width).collect())) == want
    speakers = [tuple(r) for r in S.active_speakers(df, ["p", "q"], "label").collect()]
    assert sorted(speakers) == [(rec, a, b, [int("p" in x), int("q" in x)], len(x) > len({*x})) for rec, a, b, _, x in want]


@pytest.mark.parametrize("width", [None, 1.0, 13.0])
def test_lookups_in_stretches(spark, width):
    rows, df = spans(spark)
    rng = np.random.default_rng(4)
    points = [("a" if rng.random() < 0.5 else "b", float(t)) for t in rng.integers(-5, 350, 200)] + [("a", 7.0)] * 3 + [("z", 1.0), (None, 1.0), ("a", None)]
    asked = spark.createDataFrame(points, "rec_id string, t double").repartition(3)
    got = S.labels_at(asked, df, width=width).select("rec_id", "t", "labels").collect()
    want = [(rec, t, [r[3] for r in rows if r[0] == rec and t is not None and r[1] <= t < r[2]]) for rec, t in points]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    joined = [(rec, float(k * 10), float(k * 10 + (10 if k % 5 else 4)), str(k)) for rec in "ab" for k in range(3, 30)]
    tiled = spark.createDataFrame(joined, "rec_id string, start double, end double, label string")
    got = S.label_at(asked, tiled, default="-", width=width).select("rec_id", "t", "label").collect()
    want = [(rec, t, next((r[3] for r in joined if r[0] == rec and t is not None and r[1] <= t < r[2]), "-")) for rec, t in points]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_times_just_off_a_border(spark):
    segs = spark.createDataFrame([("a", 0.0, 3.0, "x", 0), ("a", 3.0, 5.0, "y", 1)], "rec_id string, start double, end double, label string, seg_idx int")
    points = spark.createDataFrame([("a", 2.9999999999999996), ("a", 3.0000000000000004), ("a", 2.999999), ("a", 4.9999999999999996)], "rec_id string, t double")
    one = {r.t: r.label for r in S.label_at(points, segs, default="-").collect()}
    many = {r.t: r.labels for r in S.labels_at(points, segs, default=["-"]).collect()}
    assert one == {2.9999999999999996: "y", 3.0000000000000004: "y", 2.999999: "x", 4.9999999999999996: "-"}
    assert many == {k: [v] for k, v in one.items()}


@pytest.mark.parametrize("kind", ["random", "ties", "spread", "one"])
def test_median(spark, kind):
    rng = np.random.default_rng(6)
    rows = defaultdict(list)
    for k, n in (("a", 501), ("b", 500), ("c", 1), ("d", 2)):
        x = {"random": rng.normal(size=n), "ties": rng.integers(0, 4, n), "spread": rng.choice([-1, 1], n) * 10.0 ** rng.integers(-300, 300, n), "one": np.zeros(n)}[kind]
        rows[k] = [float(v) for v in x]
    flat = [(k, v) for k, x in rows.items() for v in x] + [("a", None), ("a", float("nan")), ("n", None), (None, 3.0)]
    df = spark.createDataFrame(flat, "k string, v double").repartition(3)
    got = {r.k: r.median for r in stats.median(df, "v", ("k",), bins=16).collect()}
    assert got == {**{k: pytest.approx(float(np.median(x)), rel=1e-12, abs=0) for k, x in rows.items()}, "n": None, None: 3.0}
    whole = [v for _, v in flat if v is not None and v == v]
    assert stats.median(df, "v").first()["median"] == pytest.approx(float(np.median(whole)), rel=1e-12)


def test_overlap_of_combinations(spark):
    pieces = spark.createDataFrame([("a", 0.0, 1.0, [1, 0]), ("a", 1.0, 4.0, [1, 1]), ("b", 0.0, 2.0, [0, 1]), ("c", 0.0, 1.0, [1, 1]), ("c", 1.0, 2.0, [0, 0])], "rec_id string, start double, end double, active array<int>")
    recs = spark.createDataFrame([("a", [("f",), ("m",)]), ("b", [("m",), ("f",)]), ("c", [("f",), ("f",)])], "rec_id string, speakers array<struct<gender string>>")
    got = {r.genders: tuple(r)[1:] for r in stats.gender_stats(pieces, recs, overlap=True).collect()}
    assert got == {"fm": (2, 6.0, pytest.approx(1 / 3), 0.5), "ff": (1, 2.0, 0.5, 0.5)}


def test_pairs_with_counts(spark):
    left, right = (spark.createDataFrame([(x,) for x in s], "rec_id string") for s in ("aabc", "abdd"))
    assert sorted(map(tuple, S.pair_recordings(left, right, counts=True).collect())) == [("a", "mismatch", 2, 1), ("b", "both", 1, 1), ("c", "left_only", 1, 0), ("d", "right_only", 0, 2)]


def test_growing_steps_are_dealt_finely(spark):
    """What flatten's rows grow to is dealt over more tasks than a shuffle has, which are not merged."""
    df = spark.createDataFrame([("a", 0.0, 4.0, 0, "x"), ("a", 2.0, 6.0, 1, "y")], "rec_id string, start double, end double, seg_idx int, label string")
    flat = S.flatten(df, width=10)
    many = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert f", {many}), REPARTITION_BY_NUM" in flat._jdf.queryExecution().executedPlan().toString()  # of Spark's choice before
    assert sorted((r.start, r.end, r.labels) for r in flat.collect()) == [(0, 2, ["x"]), (2, 4, ["x", "y"]), (4, 6, ["y"])]
