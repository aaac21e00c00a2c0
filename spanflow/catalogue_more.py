"""More queries over the test tables, with equal SQL: checks, casts, picks, set operations, scalar functions, scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalogue import CONV, EMB, EV, LONGS, RUNS, SEG, SEG0, _day, _posteriors, _pred, _r, _read, embedding_frames, event_frames, order_segments, query, turn_segments
from .functions import scalar as fn
from .operators import evaluate, sampling, stats
from .operators import frames as R
from .operators import segments as S
from .plans.annotate import predictor_of, score


@query("SELECT o_orderkey, o_custkey AS rec_id, c_mktsegment AS label FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def recording_attributes(spark, d):
    frames = _read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("rec_id"))
    return R.with_recording_attrs(frames, _read(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"), F.col("c_mktsegment").alias("label")))


LAST = "last AS (SELECT rec_id, min(s) AS lo, arg_max(e, s * 1000000 + e) AS hi FROM seg GROUP BY rec_id)"


@query(f"WITH {SEG}, {LAST} SELECT rec_id, CAST(greatest(0, lo) AS BIGINT) AS lo, CAST(least(rec_id + 10000, hi) AS BIGINT) AS hi FROM last")
def annotated_ranges(spark, d):
    catalog = _read(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"), (F.col("c_custkey") + 10000).alias("samples"))
    return S.annotated_range(order_segments(spark, d), catalog).select("rec_id", *_day("lo", "hi"))


@query(f"WITH {SEG0} SELECT rec_id, count(*) AS n, count(*) FILTER (e > s) AS kept FROM seg0 GROUP BY rec_id")
def empty_segments(spark, d):
    every = order_segments(spark, d, True)
    kept = S.drop_empty(every).groupBy("rec_id").agg(F.count(F.lit(1)).alias("kept"))
    return every.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).join(kept, "rec_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0).cast("long")))


@query(f"""WITH {CONV}, x AS (SELECT rec_id, max(e) - rec_id % 3 AS samples, max(e) AS m, CASE WHEN rec_id % 4 = 0 THEN 2 ELSE 1 END AS ch, CASE WHEN rec_id % 5 = 0 THEN 2 ELSE 1 END AS rate FROM conv GROUP BY rec_id)
    SELECT rec_id, 'rate' AS "check" FROM x WHERE rate <> 1 UNION ALL SELECT rec_id, 'channels' FROM x WHERE ch <> 1 UNION ALL SELECT rec_id, 'shorter than its labels' FROM x WHERE samples < m * rate""")
def recording_checks(spark, d):
    turns = turn_segments(spark, d)
    catalog = turns.groupBy("rec_id").agg(F.max("end").alias("m")).select("rec_id", (F.col("m") - F.col("rec_id") % 3).alias("samples"), F.when(F.col("rec_id") % 4 == 0, 2).otherwise(1).alias("channels"), F.when(F.col("rec_id") % 5 == 0, 2).otherwise(1).alias("rate"))
    return R.check_recordings(catalog, turns, rate=1)


@query(f"WITH {EV}, c AS (SELECT rec_id, frame_idx // 16 AS chunk_id, count(*) AS n FROM ev GROUP BY ALL) SELECT rec_id, chunk_id, n, 'size' AS problem FROM c WHERE n <> 16")
def chunk_checks(spark, d):
    return R.check_chunks(R.assign_chunks(event_frames(spark, d), 16), 16)


@query(f"WITH {EV}, h AS (SELECT rec_id, count(*) AS n FROM ev GROUP BY rec_id) SELECT rec_id, n, n + rec_id % 2 AS want FROM h WHERE rec_id % 2 <> 0")
def frame_count_checks(spark, d):
    frames = event_frames(spark, d)
    catalog = frames.groupBy("rec_id").agg(F.count(F.lit(1)).alias("n")).select("rec_id", ((F.col("n") + F.col("rec_id") % 2 - 1) * 80 + 256).alias("samples"))
    return R.check_frames(frames, catalog, 80, 256)


@query(f"WITH {EMB}, v AS (SELECT *, {_pred(1)} AS a, {_pred(2)} AS b, {_pred(3)} AS c FROM emb) SELECT rec_id, frame_idx, CASE WHEN class % 3 = 0 THEN 1.0 ELSE round(a / (a + b + c), 4) END AS p0 FROM v")
def forced_silence(spark, d):
    truth = embedding_frames(spark, d).select("rec_id", "frame_idx", (F.col("class") % 3).alias("true"))
    rows = _posteriors(spark, d).where("predictor = 0").join(truth, ["rec_id", "frame_idx"])
    return R.force_class(rows).select("rec_id", "frame_idx", _r(F.col("probs")[0], "p0"))


@query(f"WITH {EV} SELECT rec_id, frame_idx, least(CAST(class = 'click' AS INTEGER) + CAST(value > 50 AS INTEGER) + CAST(value > 80 AS INTEGER), 2) AS class FROM ev")
def activity_classes(spark, d):
    active = F.array(*(x.cast("int") for x in (F.col("class") == "click", F.col("value") > 50, F.col("value") > 80)))
    return event_frames(spark, d).withColumn("active", active).select("rec_id", "frame_idx", R.activity_class().alias("class"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS label FROM lineitem")
def labels_cast(spark, d):
    return R.labels_as(_read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").cast("string").cast("double").alias("label")), "long")


@query(f"WITH {SEG}, pt AS (SELECT o_custkey AS rec_id, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS t, row_number() OVER () AS k FROM orders UNION ALL SELECT o_custkey, -1, -row_number() OVER () FROM orders) SELECT pt.rec_id, CAST(pt.t AS BIGINT) AS t, coalesce(string_agg(g.label, ',' ORDER BY g.label), 'none') AS labels FROM pt LEFT JOIN seg g ON g.rec_id = pt.rec_id AND g.s <= pt.t AND pt.t < g.e GROUP BY pt.rec_id, pt.t, pt.k")
def labels_at_repeated_points(spark, d):
    """Points without an id of their own: equal ones stay as many rows; those outside get the default."""
    t = F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("double")
    points = _read(spark, d, "orders").select(F.col("o_custkey").alias("rec_id"), F.explode(F.array(t, F.lit(-1.0))).alias("t"))
    return S.labels_at(points, order_segments(spark, d), width=64, default=["none"]).select("rec_id", *_day("t"), F.array_join(F.sort_array("labels"), ",").alias("labels"))


GRID = "(SELECT unnest([0, 0, 1, 1]) AS t, unnest([0, 1, 0, 1]) AS p) g"


@query(f"""WITH b AS (SELECT lang AS pass, source AS epoch, quality AS t, toxic AS p FROM labels JOIN documents USING (doc_id)), n AS (SELECT pass, epoch, t, p, count(*) AS n FROM b GROUP BY ALL), k AS (SELECT DISTINCT pass, epoch, g.t, g.p FROM b CROSS JOIN {GRID}), f AS (SELECT k.*, coalesce(n, 0) AS n FROM k LEFT JOIN n USING (pass, epoch, t, p))
    SELECT pass, epoch, t AS "true", p AS pred, n, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY pass, epoch, p), 0), 4) AS precision, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY pass, epoch, t), 0), 4) AS recall FROM f""")
def confusion_history(spark, d):
    rows = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", F.col("lang").alias("pass"), F.col("source").alias("epoch")), "doc_id")
    done = evaluate.confusion_history(rows.select("pass", "epoch", F.col("quality").alias("true"), F.col("toxic").alias("pred")), nclasses=2)
    return done.select("pass", "epoch", "true", "pred", "n", _r("precision"), _r("recall"))


@query("SELECT CAST(l_returnflag = 'R' AS INTEGER) AS \"true\", CAST(l_quantity > 25 AS INTEGER) AS pred, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def confusion_by_expressions(spark, d):
    return evaluate.confusion(_read(spark, d, "lineitem"), nclasses=2, true=(F.col("l_returnflag") == "R").cast("int"), pred=(F.col("l_quantity") > 25).cast("int"), n=F.sum(F.col("l_quantity").cast("long")))


@query("SELECT l.doc_id, quality, toxic, lang FROM labels l JOIN documents d ON l.doc_id = d.doc_id")
def aligned_frames(spark, d):
    return evaluate.align(_read(spark, d, "labels"), _read(spark, d, "documents").select("doc_id", "lang"), ("doc_id",))


@query("SELECT event_id, round((value - (SELECT min(value) FROM events)) / ((SELECT max(value) FROM events) - (SELECT min(value) FROM events)) * 2 - 1, 4) + 0.0 AS value FROM events")
def rescale_all(spark, d):
    return stats.rescale(event_frames(spark, d), "value", -1.0, 1.0).select("event_id", _r("value"))


@query(f"""WITH {EV}, r0 AS (SELECT *, class || (value > 50) AS key FROM ev), r1 AS (SELECT *, CASE WHEN key = lag(key) OVER w THEN 0 ELSE 1 END AS new FROM r0 WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx)), r2 AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY frame_idx) - 1 AS run FROM r1)
    SELECT rec_id, run, min(frame_idx) + 5 AS start, max(frame_idx) + 6 AS "end", CAST(100 AS BIGINT) AS rate FROM r2 GROUP BY rec_id, run""")
def vector_runs(spark, d):
    return R.runs(event_frames(spark, d), F.array(F.col("class"), (F.col("value") > 50).cast("string")), min_start=5, rate=100).select("rec_id", "run", "start", "end", "rate")


@query(f"WITH {EMB}, x AS (SELECT rec_id, frame_idx, CAST(embedding AS DOUBLE[]) AS v, unnest(generate_series(0, (64 - 12) // 5)) AS k FROM emb) SELECT rec_id, frame_idx, count(*) AS windows, round(sum(list_sum(v[k * 5 + 1 : k * 5 + 12]) * (k + 1)), 3) + 0.0 AS checksum FROM x GROUP BY ALL")
def strided_windows(spark, d):
    sums = F.transform(R.windows("feat", 12, 5), lambda w, k: F.aggregate(w, F.lit(0.0), lambda a, x: a + x) * (k + 1))
    return embedding_frames(spark, d).withColumn("w", sums).select("rec_id", "frame_idx", F.size("w").cast("long").alias("windows"), _r(F.aggregate("w", F.lit(0.0), lambda a, x: a + x), "checksum", 3))


@query(f"""WITH {EV}, w AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)),
    f AS (SELECT rec_id, m AS m0, sd AS sd0 FROM w WHERE frame_idx = 9) SELECT w.rec_id, frame_idx, round((value - CASE WHEN n = 10 THEN m ELSE m0 END) / nullif(CASE WHEN n = 10 THEN sd ELSE sd0 END, 0), 3) + 0.0 AS value FROM w LEFT JOIN f USING (rec_id)""")
def rolling_norm_copied(spark, d):
    return R.normalize_rolling(event_frames(spark, d), 10, first="copy").select("rec_id", "frame_idx", _r("value", n=3))


@query(f"""WITH {EV}, w AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT rec_id, frame_idx, round((value - CASE WHEN n = 10 THEN m ELSE 40 END) / nullif(CASE WHEN n = 10 THEN sd ELSE 5 END, 0), 3) + 0.0 AS value FROM w""")
def rolling_norm_given(spark, d):
    return R.normalize_rolling(event_frames(spark, d), 10, first=(40.0, 25.0)).select("rec_id", "frame_idx", _r("value", n=3))


@query(f"""WITH {EMB}, x AS (SELECT rec_id, frame_idx, frame_idx // 20 AS chunk_id, unnest(generate_series(1, 64)) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM emb),
    n AS (SELECT *, (v - avg(v) OVER c) / nullif(stddev_pop(v) OVER c, 0) AS z FROM x WINDOW c AS (PARTITION BY rec_id, chunk_id, bin)) SELECT rec_id, frame_idx, round(sum(z * bin), 2) + 0.0 AS checksum FROM n GROUP BY rec_id, frame_idx""")
def chunk_norm_deviation(spark, d):
    df = R.normalize_chunk(R.assign_chunks(embedding_frames(spark, d), 20), std=True)
    return df.select("rec_id", "frame_idx", _r(F.aggregate(F.transform("feat", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x), "checksum", 2))


@query(f"WITH {EV}, {LONGS} SELECT rec_id, frame_idx, CAST(min(class) OVER w AS INTEGER) AS window_class FROM ev2 WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)")
def window_label_by_expression(spark, d):
    df = event_frames(spark, d).withColumn("class", (F.length("class") % 3).cast("int"))
    return R.window_label(df, 3, F.min("class")).select("rec_id", "frame_idx", "window_class")


@query(f"WITH {CONV}, c AS (SELECT rec_id, max(e) AS n FROM conv GROUP BY rec_id), f AS (SELECT rec_id, unnest(generate_series(0, CAST((n - 256) // 80 AS BIGINT))) AS frame_idx FROM c WHERE n >= 256) SELECT f.rec_id, frame_idx, label FROM f JOIN conv c ON c.rec_id = f.rec_id AND c.s <= frame_idx * 80 + 128 AND frame_idx * 80 + 128 < c.e")
def frame_labels(spark, d):
    turns = turn_segments(spark, d)
    catalog = S.extent(turns).select("rec_id", F.col("max_end").cast("long").alias("samples"))
    return R.frame_labels(turns, catalog, 80, 256, "label").select("rec_id", "frame_idx", "label")


@query(f"WITH {EV} SELECT rec_id, frame_idx FROM ev WHERE rec_id IN (SELECT DISTINCT rec_id FROM ev ORDER BY rec_id DESC LIMIT 4)")
def last_recordings(spark, d):
    return S.head_recordings(event_frames(spark, d), 4, last=True).select("rec_id", "frame_idx")


@query("SELECT c_custkey AS rec_id, c_nationkey AS group_id FROM customer WHERE c_nationkey IN (SELECT DISTINCT c_nationkey FROM customer ORDER BY c_nationkey LIMIT 3 OFFSET 2)")
def groups_by_place(spark, d):
    return S.pick_recordings(_read(spark, d, "customer").select(F.col("c_custkey").alias("rec_id"), F.col("c_nationkey").alias("group_id")), groups_at=(2, 5))


@query("SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY conv_id LIMIT 5 OFFSET 10)")
def conversations_by_place(spark, d):
    return S.pick_recordings(_read(spark, d, "conversations").select("conv_id", "turn"), at=(10, 15), column="conv_id")


@query(f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, run ORDER BY md5('7:' || rec_id || ':' || frame_idx), frame_idx) AS k, count(*) OVER (PARTITION BY rec_id, run) AS n FROM r1)
    SELECT rec_id, frame_idx, class FROM k WHERE CASE class WHEN 'click' THEN k <= greatest(1, floor(n * 0.4)) WHEN 'error' THEN false ELSE true END""")
def subsample_seeded(spark, d):
    return sampling.subsample(event_frames(spark, d), {"click": 0.4, "error": 0.0}, seed=7).select("rec_id", "frame_idx", "class")


@query(f"""WITH {EV}, c AS (SELECT rec_id, frame_idx // 16 AS chunk_id, count(*) AS n FROM ev GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY rec_id, chunk_id) - 1 AS pos, least(3, n) AS k FROM c), s AS (SELECT *, unnest(generate_series(0, k - 1)) AS step FROM o)
    SELECT rec_id, chunk_id, CAST(pos AS INTEGER) AS chunk_pos, CAST(step AS INTEGER) AS step, CASE WHEN step = k - 1 THEN n - (n // k) * (k - 1) ELSE n // k END AS "rows" FROM s""")
def batch_plan_steps(spark, d):
    return sampling.batch_plan(R.assign_chunks(event_frames(spark, d), 16), 1, steps=3).select("rec_id", "chunk_id", "chunk_pos", "step", F.col("rows").cast("long").alias("rows"))


@query(f"""WITH {EV}, c AS (SELECT DISTINCT rec_id, frame_idx // 16 AS chunk_id FROM ev), o AS (SELECT *, row_number() OVER (ORDER BY md5('3:0:' || rec_id || ':' || chunk_id)) - 1 AS pos FROM c)
    SELECT ev.rec_id, frame_idx, CAST(pos AS INTEGER) AS chunk_pos, value FROM ev JOIN o ON o.rec_id = ev.rec_id AND o.chunk_id = frame_idx // 16""")
def data_only_plan(spark, d):
    frames = R.assign_chunks(event_frames(spark, d).select("rec_id", "frame_idx", "class", "value"), 16)
    return sampling.take_plan(sampling.batch_plan(frames, 1, 3), frames, labels=False, feat="value").select("rec_id", "frame_idx", "chunk_pos", "value")


@query("SELECT s_nationkey AS key FROM supplier UNION SELECT c_nationkey FROM customer")
def union_of_ids(spark, d):
    return S.union_ids(_read(spark, d, "supplier").select(F.col("s_nationkey").alias("key")), _read(spark, d, "customer").select(F.col("c_nationkey").alias("key")), key="key")


@query("SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def ids_on_one_side(spark, d):
    return S.check_same(_read(spark, d, "documents"), _read(spark, d, "labels"), "doc_id")


@query(f"WITH {CONV} SELECT rec_id, 'true-' || label AS tier, CAST(s AS BIGINT) AS start FROM conv UNION ALL SELECT rec_id, 'pred-' || label, CAST(s AS BIGINT) FROM conv")
def merged_tiers(spark, d):
    tiers = turn_segments(spark, d).select("rec_id", F.col("label").alias("tier"), F.col("start").cast("long").alias("start"))
    return S.merge_tiers(tiers, tiers)


@query(f"""WITH {EV}, t AS (SELECT *, CAST(event_id % 86400 AS BIGINT) AS k FROM ev)
    SELECT event_id, CAST(CASE length(class) % 3 WHEN 0 THEN 100 WHEN 1 THEN 10 ELSE 1 END AS VARCHAR) AS hot, round(k + (k % 4) / 4.0, 4) AS seconds, CAST(k * 8 + k % 8 AS BIGINT) AS ticks, CAST((k % 50) * 6 + k % 6 AS BIGINT) AS lasts, CAST((k * 8 + k % 8) * 3 AS BIGINT) AS start_24,
    CAST(k AS VARCHAR) AS rec, 'b_' || k AS stem, 'f' AS gender, round_even(k / 4.0, 0) AS even, k || ' - ' || (k + 1) || ' : ' || class AS line, printf('%.2f (%.2f)', k % 8 * 12.5, k % 4 * 25.0) AS pr, round(k * 0.5 + 1, 4) AS mixed, CAST(2 * k + 1 AS BIGINT) AS added, CAST(-1 AS BIGINT) AS less, round(ln(greatest(0.5, value)), 4) AS logged FROM t""")
def scalar_functions_more(spark, d):
    k = (F.col("event_id") % 86400).cast("long")
    df = event_frames(spark, d).withColumn("k", k)
    k, i = F.col("k"), F.col("k").cast("int")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    clock = F.concat_ws(":", pad(F.floor(k / 3600)), pad(F.floor(k / 60) % 60), F.concat(pad(k % 60), F.element_at(F.array(*map(F.lit, (".0", ",25", ".5", ",75"))), (i % 4 + 1))))
    point = F.concat(F.lit("T"), pad(F.floor(k / 3600)), F.lit(":"), pad(F.floor(k / 60) % 60), F.lit(":"), pad(k % 60), F.lit(":"), (k % 8).cast("string"), F.lit("F8"))
    length = F.concat(F.lit("PT"), (k % 50).cast("string"), F.lit("S"), (k % 6).cast("string"), F.lit("N6F"))
    path = F.concat(F.lit("/x/b_"), k.cast("string"), F.lit(".tar.gz"))
    hot = F.array_join(F.transform(fn.one_hot(F.length("class") % 3, 3), lambda x: x.cast("int").cast("string")), "")
    return df.select(
        "event_id", F.regexp_replace(hot, "^0+", "").alias("hot"), _r(fn.clock_seconds(clock), "seconds"), fn.time_point(point)["ticks"].alias("ticks"), fn.duration(length)["ticks"].alias("lasts"), fn.combine_time(fn.time_point(point), fn.duration(length))["start"].alias("start_24"),
        fn.recording_id(path).alias("rec"), fn.file_stem(F.concat(F.lit("/x/b_"), k.cast("string"), F.lit(".wav"))).alias("stem"), fn.gender_dialect(F.lit("f.a"))["gender"].alias("gender"), fn.round_even((k / 4.0).cast("double")).alias("even"),
        fn.segment_line(k, k + 1, "class").alias("line"), fn.precision_recall_line(k % 8 * 0.125, k % 4 * 0.25).alias("pr"), _r(fn.mix(F.array(k.cast("double")), F.array(F.lit(2.0)), 0.5, 0.5)[0], "mixed"), fn.add(F.array(k), F.array(k + 1))[0].alias("added"),
        fn.subtract(F.array(k), F.array(k + 1))[0].alias("less"), _r(fn.log_floor("value", 0.5, False), "logged"),
    )


Z = [f"list_sum([CAST(embedding[j] AS DOUBLE) * (((j - 1) * {k + 2} % 7 - 3) / 10.0) FOR j IN range(1, 65)]) + {k / 10}" for k in range(3)]


@query(f"WITH {EMB} SELECT rec_id, frame_idx, round(exp({Z[0]}) / (exp({Z[0]}) + exp({Z[1]}) + exp({Z[2]})), 3) AS p0 FROM emb")
def predictor_scores(spark, d):
    """A linear predictor of whole vectors."""
    weights = np.array([[(j * (k + 2) % 7 - 3) / 10 for j in range(64)] for k in range(3)])
    frames = embedding_frames(spark, d).select("rec_id", "frame_idx", F.array("feat").alias("context"))
    return score(frames, predictor_of(weights, np.arange(3) / 10), 64).select("rec_id", "frame_idx", _r(F.col("probs")[0], "p0", 3))


@query(f"""WITH {EMB}, v AS (SELECT rec_id, frame_idx, [{_pred(1)}, {_pred(2)}, {_pred(3)}] AS x, [{_pred(4)}, {_pred(5)}, {_pred(6)}] AS y FROM emb),
    m AS (SELECT rec_id, frame_idx, [greatest(x[i] / list_sum(x), y[i] / list_sum(y)) FOR i IN range(1, 4)] AS m FROM v) SELECT rec_id, frame_idx, round(m[1] / list_sum(m), 4) AS p0 FROM m""")
def merge_by_function(spark, d):
    """Two predictors, merged by the larger of their numbers instead of a sum."""
    from .operators.decode import merge_posteriors

    both = merge_posteriors(_posteriors(spark, d), merge=lambda v: F.zip_with(v[0], v[1], lambda a, b: F.greatest(a, b)))
    return both.select("rec_id", "frame_idx", _r(F.col("probs")[0], "p0"))
