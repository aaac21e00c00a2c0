import random
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from spanflow.operators import decode, stats
from spanflow.operators import segments as S

SCHEMA = "rec_id string, start double, end double, rate double, label int, seg_idx int"


def made(seed, n=9, contiguous=False):
    """Segments (start, end, label) in order: end to end, or anywhere, with gaps, overlaps and repeats."""
    rng, at, out = random.Random(seed), 0.0, []
    for _ in range(n):
        if not contiguous:
            at = rng.randint(0, 40) / 2
        end = at + rng.randint(1, 12) / 2
        out.append((at, end, rng.randint(0, 3)))
        at = end
    return sorted(out)


def pieces(rows):
    """Flattened by trying every segment on every piece."""
    cuts = sorted({t for s, e, _ in rows for t in (s, e)})
    return [(a, b, [x for s, e, x in rows if s <= a and b <= e]) for a, b in zip(cuts, cuts[1:])]


CONTIGUOUS, OVERLAPPING = made(1, contiguous=True), made(2)


def table(spark, rows, rate=1.0):
    return spark.createDataFrame([("a", s * rate, e * rate, float(rate), x, i) for i, (s, e, x) in enumerate(rows)], SCHEMA)


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy("start").select(*cols).collect()]


@pytest.mark.parametrize("rate", [1, 3, 101, 8000])
@pytest.mark.parametrize("to", [1.0, 3, 100, 101])
def test_rates_go_there_and_back(spark, rate, to):
    df = table(spark, CONTIGUOUS, rate)
    back = S.at_rate(S.at_rate(df, to), rate)
    for a, b in zip(rows(back, "start", "end"), rows(df, "start", "end"), strict=True):
        assert a == pytest.approx(b)


def test_rate_must_be_positive(spark):
    with pytest.raises(ValueError):
        S.at_rate(table(spark, CONTIGUOUS), 0)


@pytest.mark.parametrize("start", [0, 2.5, 77])
def test_shift(spark, start):
    assert rows(S.shift_to(table(spark, OVERLAPPING), start), "start")[0][0] == start


@pytest.mark.parametrize("width", [None, 1.0, 3.5, 100.0])
def test_flatten_against_brute_force(spark, width):
    cases = {str(k): made(k, 2 + k % 9) for k in range(12)}
    cases["gap"], cases["same"], cases["empty"] = [(0.0, 2.0, 7), (9.0, 11.0, 8)], [(1.0, 3.0, 1)] * 3, [(4.0, 4.0, 1), (2.0, 6.0, 2)]
    df = spark.createDataFrame([(r, s, e, 1.0, x, i) for r, c in cases.items() for i, (s, e, x) in enumerate(c)], SCHEMA)
    got = {}
    for r in S.flatten(df, width=width).collect():
        got.setdefault(r.rec_id, []).append((r.start, r.end, r.labels))
    assert {k: sorted(v) for k, v in got.items()} == {k: pieces([x for x in c if x[1] > x[0]]) for k, c in cases.items()}
    assert S.flatten(df.limit(0), width=width).count() == 0


def test_flatten_of_one_long_recording(spark):
    n = 200_000
    name = F.substring(F.concat(F.lit("a"), F.col("id").cast("string")), 1, 1)  # no literal, which would fold the join away
    df = spark.range(n).select(name.alias("rec_id"), F.col("id").cast("double").alias("start"), (F.col("id") + 1.5).alias("end"), F.lit(1.0).alias("rate"), (F.col("id") % 5).cast("int").alias("label"), F.col("id").cast("int").alias("seg_idx"))
    for width in (None, 5000.0):
        flat = S.flatten(df, width=width)
        assert "BroadcastNestedLoop" not in flat._jdf.queryExecution().toString()
        assert tuple(flat.agg(F.count(F.lit(1)), F.sum(F.size("labels")), F.sum(F.col("end") - F.col("start"))).first()) == (2 * n - 1, 3 * n - 2, n + 0.5)


def test_labels_at_points(spark):
    at = [0.0, 1.25, 3.0, 3.0, 4.5, 7.75, 12.0, 30.0, -1.0, None]
    points = spark.createDataFrame([("a", t, k) for k, t in enumerate(at)] + [("other", 1.0, 99), (None, 1.0, 98)], "rec_id string, t double, k int")
    want = {k: [x for s, e, x in OVERLAPPING if t is not None and s <= t < e] for k, t in enumerate(at)} | {99: [], 98: []}
    for width in (None, 2.0):
        got = S.labels_at(points, table(spark, OVERLAPPING), width=width).collect()
        assert len(got) == len(want) and {r.k: r.labels for r in got} == want
    twice = S.labels_at(points.select("rec_id", "t").where("t = 3"), table(spark, OVERLAPPING)).collect()
    assert [r.labels for r in twice] == [want[2]] * 2
    for default in ([-1], [0, 1]):
        assert {r.k: r.labels for r in S.labels_at(points, table(spark, OVERLAPPING), default=default).collect()} == {k: v or default for k, v in want.items()}
    with pytest.raises(PySparkException):
        S.labels_at(points, table(spark, OVERLAPPING), strict=True).collect()


def test_label_at_contiguous(spark):
    last = CONTIGUOUS[-1][1]
    at = [0.0, 0.25, CONTIGUOUS[2][0], CONTIGUOUS[2][1] - 1e-4, last - 0.5, last, -1.0]
    points = spark.createDataFrame([("a", t) for t in at], "rec_id string, t double")
    got = {r.t: r.label for r in S.label_at(points, table(spark, CONTIGUOUS), default=-1).collect()}
    assert got == {t: next((x for s, e, x in CONTIGUOUS if s <= t < e), -1) for t in at}
    with pytest.raises(PySparkException):
        S.label_at(points, table(spark, CONTIGUOUS), strict=True).collect()


def test_violations(spark):
    bad = spark.createDataFrame([("a", 1.0, 0.0, 1.0), ("b", 0.0, 1.0, 0.0), ("c", 0.0, 1.0, -1.0), ("d", 0.0, 1.0, 1.0)], "rec_id string, start double, end double, rate double")
    assert sorted(r.rec_id for r in S.check_segments(bad).collect()) == ["a", "b", "c"]
    assert S.check_segments(table(spark, CONTIGUOUS), True).count() == 0
    assert S.check_segments(table(spark, OVERLAPPING), True).count() == sum(a[1] != b[0] for a, b in zip(OVERLAPPING, OVERLAPPING[1:]))


def test_active_speakers_counts_a_doubled_one_once(spark):
    df = table(spark, [(0.0, 2.0, 0), (1.0, 3.0, 0), (2.5, 4.0, 1)])
    got = rows(S.active_speakers(df, [0, 1], "label"), "start", "active", "doubled")
    assert got == [(0, [1, 0], False), (1, [1, 0], True), (2, [1, 0], False), (2.5, [1, 1], False), (3, [0, 1], False)]


def test_overlay_merges_runs_and_clips(spark):
    got = rows(S.overlay(table(spark, [(1.0, 3.0, 0), (3.0, 5.0, 0)]), table(spark, [(2.0, 9.0, 0)])), "start", "end", "a", "b")
    assert got == [(0, 1, 0, 0), (1, 2, 1, 0), (2, 5, 1, 1)]


def test_concurrency_agrees_with_flatten(spark):
    df = table(spark, OVERLAPPING)
    assert rows(S.concurrency(df), "start", "n") == rows(S.flatten(df).withColumn("n", F.size("labels")), "start", "n")


def test_priors_by_the_closed_form(spark):
    states, moves = decode.priors_from_segments(table(spark, CONTIGUOUS, 10))
    ticks = [x for s, e, x in CONTIGUOUS for _ in range(round((e - s) * 10))]
    assert {r[0]: (r[1], r[2]) for r in states.collect()} == {x: (int(x == ticks[0]), n) for x, n in Counter(ticks).items()}
    assert {(r[0], r[1]): r[2] for r in moves.collect() if r[2]} == Counter(zip(ticks, ticks[1:]))
    by_expression = decode.priors_from_segments(table(spark, CONTIGUOUS, 10), F.col("label") % 2)[0]
    assert {r[0]: r[2] for r in by_expression.collect()} == Counter(x % 2 for x in ticks)


def test_common_rate_and_slices(spark):
    df = spark.createDataFrame([("a", 4), ("a", 6), ("b", 5)], "rec_id string, rate int")
    assert {r.rec_id: r.rate for r in stats.common_rate(df).collect()} == {"a": 12, "b": 5}
    assert rows(S.slice_segments(table(spark, CONTIGUOUS), -2), "label") == [(x,) for *_, x in CONTIGUOUS[-2:]]


def test_pick_unknown_is_an_error(spark):
    with pytest.raises(ValueError):
        S.pick_recordings(table(spark, CONTIGUOUS), ids=["zz"])
    df = spark.createDataFrame([(f"{g}{k}", g) for g in "cab" for k in range(3)], "rec_id string, group_id string")
    assert {r.rec_id for r in S.pick_recordings(df, groups_at=(1, 2), at=(1, 3)).collect()} == {"b1", "b2"}
    assert {r.rec_id for r in S.pick_recordings(df, groups=["c"], ids=["c0"]).collect()} == {"c0"}
    assert {r.group_id for r in S.pick_recordings(df, at=(0, 2), column="group_id").collect()} == {"a", "b"}
    assert {r[0] for r in S.union_ids(df.where("group_id = 'a'"), df, key="group_id").collect()} == {*"abc"}


def test_labels_at_with_few_shuffles(spark):
    """One shuffle of points and segments, also where segments cross borders or more stretches than can be counted."""
    segs = spark.createDataFrame([("a", 0.0, 1e12, 0, "all"), ("a", 3.0, 9.0, 1, "x"), ("a", 3.0, 9.0, 1, "x"), ("a", 5.0, 400.0, 2, "y"), (None, 0.0, 9.0, 3, "z"), ("b", 0.0, 1.0, 4, "b")], "rec_id string, start double, end double, seg_idx int, label string")
    points = spark.createDataFrame([("a", t, k) for k, t in enumerate((-1.0, 0.0, 3.0, 3.0, 5.0, 9.0, 399.0, 400.0, 1e12 - 4, 1e12, None))] + [(None, 4.0, 90), ("c", 4.0, 91), ("b", 0.5, 92)], "rec_id string, t double, k int")
    want = {0: [], 1: ["all"], 2: ["all", "x", "x"], 3: ["all", "x", "x"], 4: ["all", "x", "x", "y"], 5: ["all", "y"], 6: ["all", "y"], 7: ["all"], 8: ["all"], 9: [], 10: [], 90: [], 91: [], 92: ["b"]}
    for width in (4, 1e6, None):
        made = S.labels_at(points, segs, width=width)
        rows = made.collect()
        assert {r.k: r.labels for r in rows} == want and len(rows) == len(want)
        assert made.columns == ["rec_id", "t", "k", "labels"]
    plan = S.labels_at(points, segs, width=1e6)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert sum("Exchange" in line for line in initial.splitlines()) <= 5  # of which four are for segments over many stretches
