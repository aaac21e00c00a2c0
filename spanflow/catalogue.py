"""Queries over the driver's tables, and the same in SQL.

events are frames (a user is a recording, the type is the class); orders with their lineitems are overlapping segments
of days for each customer; conversations are contiguous segments whose ticks are characters; embeddings are feature
frames, 50 a recording. Doubles are rounded and arrays become text, so that results can be compared by value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import scalar as fn
from .operators import decode, evaluate, sampling, stats
from .operators import frames as R
from .operators import segments as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EV = "ev AS (SELECT user_id AS rec_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, event_type AS class, value, event_id FROM events)"
RUNS = EV + ", r0 AS (SELECT *, CASE WHEN class = lag(class) OVER w THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx)), r1 AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY frame_idx) - 1 AS run FROM r0), runs AS (SELECT rec_id, run, min(frame_idx) AS s, max(frame_idx) + 1 AS e, min(class) AS class FROM r1 GROUP BY rec_id, run)"
SEG0 = "seg0 AS (SELECT o_custkey AS rec_id, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS s, (CAST(l_shipdate AS DATE) - DATE '1970-01-01') AS e, l_returnflag AS label FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
SEG = SEG0 + ", seg AS (SELECT * FROM seg0 WHERE e > s)"
PIECES = SEG + ", cut AS (SELECT DISTINCT rec_id, s FROM seg UNION SELECT DISTINCT rec_id, e FROM seg), pieces AS (SELECT * FROM (SELECT rec_id, s, lead(s) OVER (PARTITION BY rec_id ORDER BY s) AS e FROM cut) WHERE e IS NOT NULL)"
CONV = "c0 AS (SELECT conv_id AS rec_id, turn, role AS label, length(text) AS d FROM conversations WHERE length(text) > 0), conv AS (SELECT rec_id, turn, label, sum(d) OVER w - d AS s, sum(d) OVER w AS e FROM c0 WINDOW w AS (PARTITION BY rec_id ORDER BY turn))"
EMB = "emb AS (SELECT vec_id // 50 AS rec_id, vec_id % 50 AS frame_idx, label AS class, embedding FROM embeddings)"


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def event_frames(spark, d) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _read(spark, d, "events").select(F.col("user_id").alias("rec_id"), (F.row_number().over(w) - 1).cast("long").alias("frame_idx"), F.col("event_type").alias("class"), "value", "event_id")


def order_segments(spark, d, all_rows: bool = False) -> DataFrame:
    day = lambda c: F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("double")
    df = _read(spark, d, "orders").join(_read(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    df = df.select(F.col("o_custkey").alias("rec_id"), day("o_orderdate").alias("start"), day("l_shipdate").alias("end"), F.lit(1.0).alias("rate"), F.col("l_returnflag").alias("label"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag").alias("tie"))
    return S.number_segments(df if all_rows else S.drop_empty(df), "tie")


def turn_segments(spark, d) -> DataFrame:
    n = F.length("text")
    w = Window.partitionBy("conv_id").orderBy("turn")
    df = _read(spark, d, "conversations").where(n > 0)
    return df.select(F.col("conv_id").alias("rec_id"), "turn", (F.sum(n).over(w) - n).cast("double").alias("start"), F.sum(n).over(w).cast("double").alias("end"), F.lit(1.0).alias("rate"), F.col("role").alias("label"), (F.row_number().over(w) - 1).alias("seg_idx"))


def embedding_frames(spark, d) -> DataFrame:
    v = F.col("vec_id")
    return _read(spark, d, "embeddings").select(F.floor(v / 50).alias("rec_id"), (v % 50).alias("frame_idx"), F.col("label").alias("class"), F.transform("embedding", lambda x: x.cast("double")).alias("feat"))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _r(c, alias: str | None = None, n: int = 4):
    """Rounded, without a negative zero."""
    x = F.round(F.col(c) if isinstance(c, str) else c, n) + F.lit(0.0)
    return x.alias(alias or c)


def _day(*cols: str):
    return [F.col(c).cast("long").alias(c) for c in cols]


def _text(c: str):
    return F.concat_ws(",", F.col(c).cast("array<string>"))


@query(f"WITH {RUNS} SELECT rec_id, run, s AS start, e AS \"end\", class AS key FROM runs")
def event_runs(spark, d):
    return R.runs(event_frames(spark, d), "class")


@query(f"WITH {RUNS} SELECT rec_id, run, min(frame_idx) AS start, max(frame_idx) + 1 AS \"end\", string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY frame_idx) AS labels FROM r1 GROUP BY rec_id, run")
def event_runs_labels(spark, d):
    return R.runs(event_frames(spark, d), "class", keep="labels", label="event_id").withColumn("labels", _text("labels"))


@query(f"""WITH {RUNS}, mv AS (SELECT class AS f, lead(class) OVER (PARTITION BY rec_id ORDER BY s) AS t, 1 AS n FROM runs), al AS (
    SELECT f, t, n FROM mv WHERE t IS NOT NULL UNION ALL SELECT class, class, e - s - 1 FROM runs), g AS (SELECT f, t, sum(n) AS n FROM al GROUP BY f, t)
    SELECT f AS from_state, t AS to_state, CAST(n AS BIGINT) AS n, round(CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY f), 4) AS p FROM g""")
def transition_priors(spark, d):
    runs = R.runs(event_frames(spark, d), "class").withColumnRenamed("key", "label")
    states, moves = decode.priors_from_segments(runs)
    return decode.normalize_priors(states, moves)[1].select("from_state", "to_state", F.col("n").cast("long").alias("n"), _r("p"))


@query(f"WITH {EV}, x AS (SELECT class, lag(class) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS was FROM ev) SELECT was AS from_state, class AS to_state, 2 * count(*) AS n FROM x WHERE was IS NOT NULL GROUP BY ALL")
def frame_transitions(spark, d):
    one = decode.priors_from_frames(event_frames(spark, d))
    return decode.combine_priors([one, one])[1]


@query(f"""WITH {CONV}, f AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY s, e) AS k FROM conv)
    SELECT label AS state, round(CAST(sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) AS DOUBLE) / (SELECT count(DISTINCT rec_id) FROM conv), 4) AS init,
    round(CAST(sum(e - s) AS DOUBLE) / (SELECT sum(e - s) FROM conv), 4) AS prior FROM f GROUP BY label""")
def turn_priors(spark, d):
    states, moves = decode.priors_from_segments(turn_segments(spark, d))
    return decode.normalize_priors(states, moves)[0].select("state", _r("init"), _r("prior"))


@query(f"WITH {CONV} SELECT rec_id, turn, CAST(s * 100 AS BIGINT) AS start, CAST(e * 100 AS BIGINT) AS \"end\" FROM conv")
def turn_segments_rate(spark, d):
    return S.at_rate(turn_segments(spark, d), 100).select("rec_id", "turn", *_day("start", "end"))


@query(f"WITH {CONV}, t AS (SELECT rec_id, s + rec_id + 3 AS s, e + rec_id + 3 AS e FROM conv) SELECT rec_id, CAST(min(s) - min(s) + 7 AS BIGINT) AS min_start, CAST(max(e) - min(s) + 7 AS BIGINT) AS max_end FROM t GROUP BY rec_id")
def turn_segments_shift(spark, d):
    return S.extent(S.shift_to(turn_segments(spark, d).withColumns({c: F.col(c) + F.col("rec_id") + 3 for c in ("start", "end")}), 7)).select("rec_id", *_day("min_start", "max_end"))


@query(f"WITH {SEG0} SELECT rec_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS \"end\", 'end is not after start' AS problem FROM seg0 WHERE NOT e > s")
def segment_violations(spark, d):
    return S.check_segments(order_segments(spark, d, True)).select("rec_id", *_day("start", "end"), "problem")


@query(f"WITH {CONV}, n AS (SELECT *, row_number() OVER (PARTITION BY rec_id ORDER BY s, e) - 1 AS i, count(*) OVER (PARTITION BY rec_id) AS n FROM conv) SELECT rec_id, turn, label FROM n WHERE i >= 1 AND i < n - 1")
def slice_turns(spark, d):
    return S.slice_segments(turn_segments(spark, d), 1, -1).select("rec_id", "turn", "label")


@query(f"""WITH {PIECES} SELECT p.rec_id, CAST(p.s AS BIGINT) AS start, CAST(p.e AS BIGINT) AS "end", count(g.s) AS n, coalesce(string_agg(g.label, ',' ORDER BY g.label), '') AS labels
    FROM pieces p LEFT JOIN seg g ON g.rec_id = p.rec_id AND g.s <= p.s AND g.e >= p.e GROUP BY p.rec_id, p.s, p.e""")
def flatten_orders(spark, d):
    return S.flatten(order_segments(spark, d), width=1024).select("rec_id", *_day("start", "end"), F.size("seg_idxs").cast("long").alias("n"), F.array_join(F.sort_array("labels"), ",").alias("labels"))


@query(f"""WITH {PIECES}, c AS (SELECT p.rec_id, p.s, p.e, count(g.s) AS n FROM pieces p LEFT JOIN seg g ON g.rec_id = p.rec_id AND g.s <= p.s AND g.e >= p.e GROUP BY p.rec_id, p.s, p.e)
    SELECT least(n, 2) AS class, count(*) AS pieces, CAST(sum(e - s) AS BIGINT) AS duration, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS piece_share,
    round(CAST(sum(e - s) AS DOUBLE) / sum(sum(e - s)) OVER (), 4) AS duration_share FROM c GROUP BY least(n, 2)""")
def concurrency_profile(spark, d):
    pieces = S.concurrency(order_segments(spark, d)).withColumn("class", F.least("n", F.lit(2)).cast("long"))
    return stats.activity_stats(pieces).select("class", "pieces", F.col("duration").cast("long").alias("duration"), _r("piece_share"), _r("duration_share"))


FLAGS = "max(CASE WHEN g.label = 'A' THEN 1 ELSE 0 END) AS a, max(CASE WHEN g.label = 'N' THEN 1 ELSE 0 END) AS n, max(CASE WHEN g.label = 'R' THEN 1 ELSE 0 END) AS r"


@query(f"WITH {PIECES} SELECT p.rec_id, CAST(p.s AS BIGINT) AS start, CAST(p.e AS BIGINT) AS \"end\", {FLAGS}, count(g.label) > count(DISTINCT g.label) AS doubled FROM pieces p LEFT JOIN seg g ON g.rec_id = p.rec_id AND g.s <= p.s AND g.e >= p.e GROUP BY p.rec_id, p.s, p.e")
def active_flags(spark, d):
    done = S.active_speakers(order_segments(spark, d), ["A", "N", "R"], "label")
    return done.select("rec_id", *_day("start", "end"), *(F.col("active")[i].alias(k) for i, k in enumerate("anr")), "doubled")


@query(f"""WITH {SEG}, l AS (SELECT * FROM seg WHERE label = 'R'), m AS (SELECT rec_id, max(e) AS last FROM l GROUP BY rec_id),
    r AS (SELECT s.rec_id, least(s, last) AS s, least(e, last) AS e FROM seg s JOIN m USING (rec_id) WHERE label = 'A' AND least(s, last) < least(e, last)),
    t AS (SELECT rec_id, s AS t FROM l UNION SELECT rec_id, e FROM l UNION SELECT rec_id, s FROM r UNION SELECT rec_id, e FROM r UNION SELECT rec_id, 0 FROM m UNION SELECT rec_id, last FROM m),
    p AS (SELECT * FROM (SELECT rec_id, t AS s, lead(t) OVER (PARTITION BY rec_id ORDER BY t) AS e FROM t) WHERE e IS NOT NULL),
    f AS (SELECT p.*, CAST(EXISTS (SELECT 1 FROM l WHERE l.rec_id = p.rec_id AND l.s <= p.s AND l.e >= p.e) AS INTEGER) AS a, CAST(EXISTS (SELECT 1 FROM r WHERE r.rec_id = p.rec_id AND r.s <= p.s AND r.e >= p.e) AS INTEGER) AS b FROM p),
    n AS (SELECT *, CASE WHEN a = lag(a) OVER w AND b = lag(b) OVER w THEN 0 ELSE 1 END AS new FROM f WINDOW w AS (PARTITION BY rec_id ORDER BY s)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY s) AS run FROM n)
    SELECT rec_id, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS "end", min(a) AS a, min(b) AS b FROM g GROUP BY rec_id, run""")
def overlay_flags(spark, d):
    segs = order_segments(spark, d)
    return S.overlay(segs.where("label = 'R'"), segs.where("label = 'A'")).select("rec_id", *_day("start", "end"), "a", "b")


@query(f"""WITH {SEG}, pt AS (SELECT o_orderkey, o_custkey AS rec_id, (CAST(o_orderdate AS DATE) - DATE '1970-01-01') AS t FROM orders)
    SELECT pt.o_orderkey, count(g.s) AS n, coalesce(string_agg(g.label, ',' ORDER BY g.label), '') AS labels FROM pt LEFT JOIN seg g ON g.rec_id = pt.rec_id AND g.s <= pt.t AND pt.t < g.e GROUP BY pt.o_orderkey""")
def labels_at_orders(spark, d):
    points = _read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("rec_id"), F.datediff(F.to_date("o_orderdate"), F.lit("1970-01-01").cast("date")).cast("double").alias("t"))
    done = S.labels_at(points, order_segments(spark, d), width=1024)
    return done.select("o_orderkey", F.size("labels").cast("long").alias("n"), F.array_join(F.sort_array("labels"), ",").alias("labels"))


@query(f"""WITH {CONV}, k AS (SELECT DISTINCT rec_id FROM conv), pt AS (SELECT rec_id, unnest([0, 50, 100, 1000, 100000]) AS t FROM k)
    SELECT pt.rec_id, CAST(pt.t AS BIGINT) AS t, coalesce(c.label, 'outside') AS label FROM pt LEFT JOIN conv c ON c.rec_id = pt.rec_id AND c.s <= pt.t AND pt.t < c.e""")
def turn_at_offset(spark, d):
    segs = turn_segments(spark, d)
    points = segs.select("rec_id").distinct().withColumn("t", F.explode(F.array(*(F.lit(x).cast("long") for x in (0, 50, 100, 1000, 100000)))))
    return S.label_at(points, segs, default="outside").select("rec_id", "t", "label")


@query(f"WITH {CONV}, c AS (SELECT rec_id, max(e) AS n FROM conv GROUP BY rec_id) SELECT rec_id, frame_idx, frame_idx * 80 + 128 AS t FROM (SELECT rec_id, unnest(generate_series(0, CAST((n - 256) // 80 AS BIGINT))) AS frame_idx FROM c WHERE n >= 256)")
def frame_clock(spark, d):
    catalog = S.extent(turn_segments(spark, d)).select("rec_id", F.col("max_end").cast("long").alias("samples"))
    return R.frame_centres(catalog, 80, 256).withColumn("t", F.col("t").cast("long"))


CONF = "g AS (SELECT * FROM (SELECT unnest([0, 0, 1, 1]) AS t, unnest([0, 1, 0, 1]) AS p))"


@query(f"""WITH {CONF}, c AS (SELECT quality AS t, toxic AS p, count(*) AS n FROM labels GROUP BY ALL), f AS (SELECT g.t, g.p, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.t = g.t AND c.p = g.p)
    SELECT t AS "true", p AS pred, n, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY p), 0), 4) AS precision, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY t), 0), 4) AS recall FROM f""")
def confusion_labels(spark, d):
    pairs = _read(spark, d, "labels").select(F.col("quality").alias("true"), F.col("toxic").alias("pred"))
    return evaluate.normalize_confusion(evaluate.confusion(pairs, nclasses=2)).select("true", "pred", "n", _r("precision"), _r("recall"))


@query(f"""WITH {CONF}, b AS (SELECT nullif(length(source) % 5, 1) AS rec_id, quality AS t, toxic AS p FROM labels JOIN documents USING (doc_id)), u AS (SELECT false AS is_total, rec_id, t, p FROM b UNION ALL SELECT true, NULL, t, p FROM b),
    c AS (SELECT is_total, rec_id, t, p, count(*) AS n FROM u GROUP BY ALL), k AS (SELECT DISTINCT is_total, rec_id, g.t, g.p FROM u CROSS JOIN g), f AS (SELECT k.*, coalesce(n, 0) AS n FROM k LEFT JOIN c ON c.is_total = k.is_total AND c.rec_id IS NOT DISTINCT FROM k.rec_id AND c.t = k.t AND c.p = k.p)
    SELECT is_total, CAST(rec_id AS BIGINT) AS rec_id, t AS "true", p AS pred, n, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY is_total, rec_id, p), 0), 4) AS precision, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY is_total, rec_id, t), 0), 4) AS recall FROM f""")
def confusion_by_source(spark, d):
    rows = _read(spark, d, "labels").join(_read(spark, d, "documents").select("doc_id", F.nullif(F.length("source") % 5, F.lit(1)).cast("long").alias("rec_id")), "doc_id")
    done = evaluate.evaluate(rows.select("rec_id", F.col("quality").alias("true"), F.col("toxic").alias("pred")), nclasses=2)
    return done.select("is_total", "rec_id", "true", "pred", "n", _r("precision"), _r("recall"))


@query("SELECT event_type AS class, count(*) AS n, round(CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS share FROM events GROUP BY event_type")
def class_distribution(spark, d):
    return evaluate.class_distribution(event_frames(spark, d)).select("class", "n", _r("share"))


@query(f"WITH {CONV} SELECT label, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS total, CAST(min(e - s) AS BIGINT) AS least, CAST(max(e - s) AS BIGINT) AS most, round(avg(e - s), 4) AS mean, round(stddev_pop(e - s), 4) AS deviation FROM conv GROUP BY label")
def duration_stats(spark, d):
    df = turn_segments(spark, d).withColumn("duration", F.col("end") - F.col("start"))
    return stats.duration_stats(df, ("label",)).select("label", "n", *_day("total", "least", "most"), _r("mean"), _r("deviation"))


@query(f"WITH {CONV} SELECT CAST(CASE WHEN e - s = 400 THEN 20 ELSE floor((e - s) / 20.0) + 1 END AS BIGINT) AS bin, count(*) AS n, CAST(sum(e - s) AS BIGINT) AS weight FROM conv WHERE e - s BETWEEN 0 AND 400 GROUP BY 1")
def duration_hist(spark, d):
    df = turn_segments(spark, d).withColumn("duration", F.col("end") - F.col("start"))
    return stats.histogram(df, "duration", 0, 400, 20, "duration").select(F.col("bin").cast("long").alias("bin"), "n", *_day("weight"))


@query(f"WITH {RUNS} SELECT class, round(median(e - s), 4) AS median FROM runs GROUP BY class")
def median_duration(spark, d):
    return stats.median_duration(R.runs(event_frames(spark, d), "class").withColumnRenamed("key", "class")).select("class", _r("median"))


@query(f"""WITH {PIECES}, f AS (SELECT p.rec_id, p.s, p.e, coalesce(string_agg(DISTINCT g.label, '' ORDER BY g.label), '') AS genders FROM pieces p LEFT JOIN seg g ON g.rec_id = p.rec_id AND g.s <= p.s AND g.e >= p.e GROUP BY p.rec_id, p.s, p.e)
    SELECT rec_id, genders, count(*) AS pieces, CAST(sum(e - s) AS BIGINT) AS duration, round(CAST(sum(e - s) AS DOUBLE) / sum(sum(e - s)) OVER (PARTITION BY rec_id), 4) AS share FROM f GROUP BY rec_id, genders""")
def group_combo_stats(spark, d):
    segs = order_segments(spark, d)
    speaker = F.array(*(F.struct(F.lit(x).alias("gender")) for x in "ANR"))
    done = stats.gender_stats(S.active_speakers(segs, [*"ANR"], "label"), segs.select("rec_id").distinct().withColumn("speakers", speaker))
    return done.select("rec_id", "genders", "pieces", *_day("duration"), _r("share"))


@query("""WITH g AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS k FROM (SELECT DISTINCT c_nationkey FROM customer)),
    r AS (SELECT c.c_nationkey, CASE WHEN k = 0 THEN 'val' WHEN k <= 15 THEN 'train' ELSE 'test' END AS split, o_totalprice AS v FROM customer c JOIN g USING (c_nationkey) JOIN orders ON o_custkey = c_custkey)
    SELECT split, count(DISTINCT c_nationkey) AS groups, count(*) AS files, round(sum(v) / (SELECT sum(v) FROM r), 4) AS share FROM r GROUP BY split UNION ALL SELECT NULL, count(DISTINCT c_nationkey), count(*), 1.0 FROM r""")
def split_balance(spark, d):
    rows = _read(spark, d, "customer").join(_read(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_nationkey").alias("group_id"), F.col("o_totalprice").alias("duration"))
    split = sampling.assign_splits(rows, {"val": (0, 0), "train": (1, 15), "test": (16, None)})
    return stats.split_balance(split).select("split", "groups", "files", _r("share"))


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN 'left_only' WHEN d.doc_id IS NULL THEN 'right_only' ELSE 'both' END AS status FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def pair_status(spark, d):
    return S.pair_recordings(_read(spark, d, "documents"), _read(spark, d, "labels"), "doc_id")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def missing_ids(spark, d):
    return S.missing_from(_read(spark, d, "documents"), _read(spark, d, "labels"), "doc_id")


@query("SELECT o_orderkey, o_custkey AS rec_id, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def with_metadata(spark, d):
    people = _read(spark, d, "customer").join(_read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("c_custkey").alias("rec_id"), "c_name", "n_name")
    return S.with_recording(_read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("rec_id")), people)


@query(f"""WITH {EV}, w AS (SELECT rec_id, frame_idx, round(avg(value) OVER w, 4) AS mean, round(max(value) OVER w, 4) AS most, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING))
    SELECT rec_id, frame_idx, mean, most FROM w WHERE n = 5 AND frame_idx % 2 = 0""")
def rolling_stats(spark, d):
    df = R.rolling(event_frames(spark, d), {"mean": F.avg("value"), "most": F.max("value")}, 5, 2)
    return df.select("rec_id", "frame_idx", _r("mean"), _r("most"))


@query(f"""WITH {EV}, w AS (SELECT *, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 9 PRECEDING AND CURRENT ROW))
    SELECT rec_id, frame_idx, round((value - m) / nullif(sd, 0), 3) + 0.0 AS value FROM w WHERE n = 10""")
def rolling_norm(spark, d):
    return R.normalize_rolling(event_frames(spark, d), 10).select("rec_id", "frame_idx", _r("value", n=3))


@query(f"WITH {EV} SELECT rec_id, frame_idx, round((value - min(value) OVER w) / nullif(max(value) OVER w - min(value) OVER w, 0), 4) AS value FROM ev WINDOW w AS (PARTITION BY rec_id)")
def rescale_minmax(spark, d):
    return stats.rescale(event_frames(spark, d), "value", by=("rec_id",)).select("rec_id", "frame_idx", _r("value"))


@query(f"""WITH {EMB}, x AS (SELECT rec_id, frame_idx, frame_idx // 20 AS chunk_id, unnest(generate_series(1, 64)) AS bin, unnest(embedding) AS v FROM emb),
    n AS (SELECT *, CAST(v AS DOUBLE) - avg(CAST(v AS DOUBLE)) OVER (PARTITION BY rec_id, chunk_id, bin) AS c FROM x) SELECT rec_id, frame_idx, chunk_id, round(sum(c * bin), 3) + 0.0 AS checksum FROM n GROUP BY rec_id, frame_idx, chunk_id""")
def chunk_norm(spark, d):
    df = R.normalize_chunk(R.assign_chunks(embedding_frames(spark, d), 20), dims=64)
    check = F.aggregate(F.transform("feat", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return df.select("rec_id", "frame_idx", "chunk_id", _r(check, "checksum", 3))


CHUNKS = EV + ", n AS (SELECT *, count(*) OVER (PARTITION BY rec_id) AS n FROM ev), c AS (SELECT rec_id, frame_idx, k AS chunk_id, k * 12 AS chunk_start FROM (SELECT *, unnest(generate_series(0, frame_idx // 12)) AS k FROM n) WHERE frame_idx < k * 12 + 16 AND k * 12 + 16 <= n)"


@query(f"WITH {CHUNKS} SELECT rec_id, frame_idx, chunk_id, chunk_start FROM c")
def overlap_chunks(spark, d):
    return R.assign_chunks(event_frames(spark, d), 16, 4).select("rec_id", "frame_idx", "chunk_id", "chunk_start")


@query(f"WITH {CHUNKS} SELECT rec_id, frame_idx, chunk_id FROM c WHERE chunk_id = 0 OR frame_idx - chunk_start >= 2")
def skip_overlap(spark, d):
    return R.skip_overlap(R.assign_chunks(event_frames(spark, d), 16, 4), 4, 1).select("rec_id", "frame_idx", "chunk_id")


@query(f"""WITH {EV}, w AS (SELECT rec_id, frame_idx, string_agg(CAST(event_id AS VARCHAR), ',') OVER w AS context, count(*) OVER w AS n FROM ev WINDOW w AS (PARTITION BY rec_id, frame_idx // 16 ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT rec_id, frame_idx, context FROM w WHERE n = 5""")
def context_stack(spark, d):
    df = R.stack_context(R.assign_chunks(event_frames(spark, d), 16), 2, feat="event_id")
    return df.select("rec_id", "frame_idx", _text("context").alias("context"))


LONGS = "ev2 AS (SELECT rec_id, frame_idx, length(class) % 3 AS class FROM ev)"


@query(f"""WITH {EV}, {LONGS}, w AS (SELECT rec_id, frame_idx, sum(CASE WHEN class = 0 THEN 1 ELSE 0 END) OVER w AS a, sum(CASE WHEN class = 1 THEN 1 ELSE 0 END) OVER w AS b, sum(CASE WHEN class = 2 THEN 1 ELSE 0 END) OVER w AS c, max(class) OVER w AS most
    FROM ev2 WINDOW w AS (PARTITION BY rec_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
    SELECT rec_id, frame_idx, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS dominant, CAST(most AS INTEGER) AS most FROM w""")
def window_label(spark, d):
    df = event_frames(spark, d).withColumn("class", (F.length("class") % 3).cast("int"))
    df = R.window_label(df, 2).withColumnRenamed("window_class", "dominant")
    return R.window_label(df, 2, "max").select("rec_id", "frame_idx", "dominant", F.col("window_class").alias("most"))


@query(f"""WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY rec_id, run ORDER BY frame_idx) AS k, count(*) OVER (PARTITION BY rec_id, run) AS n FROM r1)
    SELECT rec_id, frame_idx, class FROM k WHERE CASE class WHEN 'click' THEN k <= greatest(1, floor(n * 0.4)) WHEN 'error' THEN false ELSE true END""")
def subsample_runs(spark, d):
    return sampling.subsample(event_frames(spark, d), {"click": 0.4, "error": 0.0}).select("rec_id", "frame_idx", "class")


@query(f"""WITH {EV}, k AS (SELECT *, frame_idx // 16 AS chunk_id, row_number() OVER w - 1 AS k, count(*) OVER (PARTITION BY rec_id, frame_idx // 16) AS n FROM ev WINDOW w AS (PARTITION BY rec_id, frame_idx // 16 ORDER BY frame_idx))
    SELECT rec_id, frame_idx, CAST(least(k // (n // least(5, n)), least(5, n) - 1) AS INTEGER) AS step FROM k""")
def batch_steps(spark, d):
    return sampling.assign_steps(R.assign_chunks(event_frames(spark, d), 16), 5).select("rec_id", "frame_idx", "step")


@query(f"WITH {EV}, c AS (SELECT rec_id, frame_idx // 16 AS k, count(*) AS n FROM ev GROUP BY ALL) SELECT CAST(sum(n) AS BIGINT) AS frames, count(*) AS chunks, CAST(sum(least(5, n)) AS BIGINT) AS steps FROM c")
def plan_summary(spark, d):
    return sampling.plan_summary(R.assign_chunks(event_frames(spark, d), 16), 5)


def _pred(i: int) -> str:
    """Unnormalised posterior i: 1 to 3 of the first predictor, 4 to 6 of the second; every third number of the vector, by
    magnitude or squared."""
    x = "CAST(embedding[j] AS DOUBLE)"
    one = f"abs({x})" if i < 4 else f"{x} * {x}"
    return f"(list_sum([{one} FOR j IN range({(i - 1) % 3 + 1}, 65, 3)]) + 0.001)"


P3 = EMB + f", p0 AS (SELECT rec_id, frame_idx, [{_pred(1)}, {_pred(2)}, {_pred(3)}] AS v FROM emb)"


def _probs(one):
    total = lambda k: F.aggregate(F.filter(F.transform("feat", lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda t: t["i"] % 3 == k), F.lit(0.0), lambda a, t: a + one(t["x"])) + 0.001
    return fn.normalize(F.array(*(total(k) for k in range(3))))


def _posteriors(spark, d):
    df = embedding_frames(spark, d)
    made = lambda k, one: df.select("rec_id", "frame_idx", F.lit(k).alias("predictor"), _probs(one).alias("probs"))
    return made(0, F.abs).unionByName(made(1, lambda x: x * x))


MERGED = ", ".join(f"{_pred(i)} / ({_pred(1)} + {_pred(2)} + {_pred(3)}) + 2 * {_pred(i + 3)} / ({_pred(4)} + {_pred(5)} + {_pred(6)}) AS m{i}" for i in (1, 2, 3))


@query(f"WITH {EMB}, m AS (SELECT rec_id, frame_idx, {MERGED} FROM emb) SELECT rec_id, frame_idx, round(m1 / (m1 + m2 + m3), 4) AS p1, round(m2 / (m1 + m2 + m3), 4) AS p2, round(m3 / (m1 + m2 + m3), 4) AS p3 FROM m")
def merge_posteriors(spark, d):
    weights = spark.createDataFrame([(0, 1.0), (1, 2.0)], "predictor int, weight double")
    done = decode.merge_posteriors(_posteriors(spark, d), weights)
    return done.select("rec_id", "frame_idx", *(_r(F.col("probs")[i], f"p{i + 1}") for i in range(3)))


VITERBI = P3 + """, p AS (SELECT rec_id, frame_idx, v[1] / (v[1] + v[2] + v[3]) / {0} AS a0, v[2] / (v[1] + v[2] + v[3]) / {1} AS b0, v[3] / (v[1] + v[2] + v[3]) / {2} AS c0 FROM p0),
    o AS (SELECT rec_id, frame_idx, ln(greatest(1e-15, a0 / (a0 + b0 + c0))) AS a, ln(greatest(1e-15, b0 / (a0 + b0 + c0))) AS b, ln(greatest(1e-15, c0 / (a0 + b0 + c0))) AS c FROM p),
    w AS (SELECT rec_id, CAST(frame_idx AS BIGINT) AS t, ln(0.6) + a AS x, ln(0.2) + b AS y, ln(0.2) + c AS z, [0] AS px, [1] AS py, [2] AS pz FROM o WHERE frame_idx = 0 UNION ALL
        SELECT w.rec_id, t + 1, a + greatest(x + ln(0.8), y + ln(0.1), z + ln(0.1)), b + greatest(x + ln(0.1), y + ln(0.8), z + ln(0.1)), c + greatest(x + ln(0.1), y + ln(0.1), z + ln(0.8)),
        list_append(CASE WHEN x + ln(0.8) >= y + ln(0.1) AND x + ln(0.8) >= z + ln(0.1) THEN px WHEN y >= z THEN py ELSE pz END, 0),
        list_append(CASE WHEN x + ln(0.1) >= y + ln(0.8) AND x >= z THEN px WHEN y + ln(0.8) >= z + ln(0.1) THEN py ELSE pz END, 1),
        list_append(CASE WHEN x >= y AND x + ln(0.1) >= z + ln(0.8) THEN px WHEN y + ln(0.1) >= z + ln(0.8) THEN py ELSE pz END, 2)
        FROM w JOIN o ON o.rec_id = w.rec_id AND o.frame_idx = w.t + 1),
    e AS (SELECT rec_id, CASE WHEN x >= y AND x >= z THEN px WHEN y >= z THEN py ELSE pz END AS path FROM w QUALIFY t = max(t) OVER (PARTITION BY rec_id)),
    s AS (SELECT rec_id, unnest(path) AS state, generate_subscripts(path, 1) - 1 AS frame_idx FROM e)"""


@query(f"WITH RECURSIVE {VITERBI.format(1, 1, 1)} SELECT rec_id, frame_idx, CAST(state AS BIGINT) AS state FROM s")
def viterbi_states(spark, d):
    stay = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    return decode.viterbi(_posteriors(spark, d).where("predictor = 0"), [0.6, 0.2, 0.2], stay)


@query(f"WITH RECURSIVE {VITERBI.format(0.5, 0.3, 0.2)} SELECT rec_id, frame_idx, CAST(state AS BIGINT) AS state FROM s")
def viterbi_scaled(spark, d):
    stay = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    return decode.viterbi(_posteriors(spark, d).where("predictor = 0"), [0.6, 0.2, 0.2], stay, scale_priors=[0.5, 0.3, 0.2])


@query(f"""WITH RECURSIVE {VITERBI.format(1, 1, 1)}, y AS (SELECT s.rec_id, emb.class % 3 AS t, s.state AS sm, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS rw FROM s JOIN o USING (rec_id, frame_idx) JOIN emb USING (rec_id, frame_idx)),
    u AS (SELECT 'raw' AS variant, rec_id, t, rw AS p FROM y UNION ALL SELECT 'smoothed', rec_id, t, sm FROM y), u2 AS (SELECT variant, false AS is_total, rec_id, t, p FROM u UNION ALL SELECT variant, true, NULL, t, p FROM u),
    k AS (SELECT DISTINCT variant, is_total, rec_id, g.t, h.p FROM u2 CROSS JOIN (SELECT unnest([0, 1, 2]) AS t) g CROSS JOIN (SELECT unnest([0, 1, 2]) AS p) h), n AS (SELECT variant, is_total, rec_id, t, p, count(*) AS n FROM u2 GROUP BY ALL),
    f AS (SELECT k.*, coalesce(n.n, 0) AS n FROM k LEFT JOIN n ON n.variant = k.variant AND n.is_total = k.is_total AND n.rec_id IS NOT DISTINCT FROM k.rec_id AND n.t = k.t AND n.p = k.p)
    SELECT variant, is_total, rec_id, t AS "true", p AS pred, n, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY variant, is_total, rec_id, p), 0), 4) AS precision, round(CAST(n AS DOUBLE) / nullif(sum(n) OVER (PARTITION BY variant, is_total, rec_id, t), 0), 4) AS recall FROM f""")
def smoothing_report(spark, d):
    from .plans.annotate import report

    stay = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    truth = embedding_frames(spark, d).select("rec_id", "frame_idx", (F.col("class") % 3).cast("int").alias("true"))
    done = report(_posteriors(spark, d).where("predictor = 0"), truth, [0.6, 0.2, 0.2], stay)
    return done.select("variant", "is_total", "rec_id", "true", "pred", "n", _r("precision"), _r("recall"))


@query(f"WITH {EMB}, i AS (SELECT *, unnest(generate_series(0, len(embedding) // 2 - 1)) AS i FROM emb), p AS (SELECT rec_id, frame_idx, CAST(i AS INTEGER) AS pair, CAST(embedding[2 * i + 1] AS DOUBLE) AS a, CAST(embedding[2 * i + 2] AS DOUBLE) AS b FROM i) SELECT rec_id, frame_idx, pair, false AS swapped, round(a, 4) + 0.0 AS a, round(b, 4) + 0.0 AS b FROM p UNION ALL SELECT rec_id, frame_idx, pair, true, round(b, 4) + 0.0, round(a, 4) + 0.0 FROM p")
def channel_swap(spark, d):
    """Neighbouring numbers of a vector are the two channels, so that all of it is read."""
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("feat") / 2).cast("int") - 1), lambda i: F.slice("feat", i * 2 + 1, 2))
    two = embedding_frames(spark, d).select("rec_id", "frame_idx", F.posexplode(pairs).alias("pair", "feat"))
    return R.with_swapped(two).select("rec_id", "frame_idx", "pair", "swapped", _r(F.col("feat")[0], "a"), _r(F.col("feat")[1], "b"))


@query("""SELECT p_partkey, least(greatest(p_size, 10), 40) AS clipped, CAST(floor(p_size / 7) AS BIGINT) AS floored, CASE WHEN p_size = 0 THEN 0 ELSE lcm(p_size, 12) END AS multiple, round(log10(greatest(1e-8, p_retailprice)), 4) AS logged,
    substr(p_brand, 1, 3) AS grp, CAST(floor(p_retailprice / 60) AS BIGINT) AS m, CASE WHEN p_size % 3 = 0 THEN 'none' WHEN p_size % 3 = 1 THEN 'single' ELSE 'multiple' END AS tier FROM part""")
def scalar_functions(spark, d):
    return _read(spark, d, "part").select(
        "p_partkey", fn.clip("p_size", 10, 40).alias("clipped"), fn.floor_div("p_size", F.lit(7)).alias("floored"), fn.lcm("p_size", F.lit(12)).alias("multiple"), _r(fn.log_floor("p_retailprice", 1e-8), "logged"),
        fn.group_id("p_brand").alias("grp"), (fn.hms("p_retailprice")["h"] * 60 + fn.hms("p_retailprice")["m"]).alias("m"), fn.tier_name(F.col("p_size") % 3).alias("tier"),
    )


@query(f"WITH {EMB} SELECT rec_id, frame_idx, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best, class % 3 = 0 AS none FROM emb")
def argmax_frames(spark, d):
    return embedding_frames(spark, d).select("rec_id", "frame_idx", fn.argmax("feat").alias("best"), (fn.from_one_hot(fn.one_hot(F.col("class") % 3, 3)) == 0).alias("none"))


@query(f"WITH {SEG0}, r AS (SELECT DISTINCT rec_id, label FROM seg0) SELECT rec_id, label AS speaker FROM r")
def speakers_of(spark, d):
    return S.speakers_of(order_segments(spark, d, True).withColumn("speaker", F.col("label")))


@query(f"WITH {EV} SELECT * FROM (SELECT rec_id, frame_idx, class FROM ev WHERE rec_id IN (SELECT rec_id FROM (SELECT DISTINCT rec_id FROM ev) ORDER BY rec_id LIMIT 5 OFFSET 3))")
def pick_recordings(spark, d):
    return S.pick_recordings(event_frames(spark, d), at=(3, 8)).select("rec_id", "frame_idx", "class")


@query("SELECT count(DISTINCT (c_nationkey, c_mktsegment)) AS records, count(DISTINCT c_nationkey) AS pins, min(c_nationkey) AS least_pin, max(c_nationkey) AS most_pin FROM customer")
def speaker_counts(spark, d):
    """Nations as pins, segments as what is told of them: a pin has several records."""
    told = F.struct(F.col("c_nationkey").alias("pin"), F.col("c_mktsegment").alias("gender"))
    return stats.speaker_counts(_read(spark, d, "customer").select(F.array(told).alias("speakers")))


@query("SELECT o_custkey AS rec_id, CASE WHEN bool_or(o_orderpriority LIKE '1%') AND bool_or(o_orderpriority LIKE '2%') THEN 12 ELSE max(CASE WHEN o_orderpriority LIKE '1%' THEN 4 WHEN o_orderpriority LIKE '2%' THEN 6 ELSE 2 END) END AS rate FROM orders GROUP BY o_custkey")
def common_rate(spark, d):
    rate = F.when(F.col("o_orderpriority").like("1%"), 4).when(F.col("o_orderpriority").like("2%"), 6).otherwise(2)
    return stats.common_rate(_read(spark, d, "orders").select(F.col("o_custkey").alias("rec_id"), rate.alias("rate")))


@query("SELECT s_nationkey AS key FROM (SELECT DISTINCT s_nationkey FROM supplier) WHERE s_nationkey IN (SELECT c_nationkey FROM customer)")
def shared_keys(spark, d):
    return S.check_disjoint(_read(spark, d, "supplier").select(F.col("s_nationkey").alias("key")), _read(spark, d, "customer").select(F.col("c_nationkey").alias("key")), key="key")


@query(f"""WITH {EV} SELECT rec_id, frame_idx, CAST(row_number() OVER (PARTITION BY rec_id, frame_idx // 16 ORDER BY md5('7:' || rec_id || ':' || (frame_idx // 16) || ':' || frame_idx)) - 1 AS INTEGER) AS row_pos FROM ev""")
def seeded_shuffle(spark, d):
    return sampling.shuffle_rows(R.assign_chunks(event_frames(spark, d), 16), 7).select("rec_id", "frame_idx", "row_pos")


@query(f"""WITH {EV}, c AS (SELECT DISTINCT rec_id, frame_idx // 16 AS chunk_id FROM ev), p AS (SELECT c.*, pass FROM c CROSS JOIN (SELECT unnest([0, 1]) AS pass)),
    n AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY md5('7:' || pass || ':' || rec_id || ':' || chunk_id)) - 1 AS chunk_pos FROM p) SELECT pass, rec_id, chunk_id, CAST(chunk_pos AS INTEGER) AS chunk_pos FROM n WHERE pass > 0 OR chunk_pos >= 5""")
def batch_plan(spark, d):
    return sampling.batch_plan(R.assign_chunks(event_frames(spark, d), 16), 2, 7, start=(0, 5))


@query()
def classifier_scores(spark, d):
    from .plans.annotate import classify, fit_frame_classifier

    df = R.stack_context(R.assign_chunks(embedding_frames(spark, d), 25), 1)
    return classify(df, fit_frame_classifier(df, iterations=10)).select("rec_id", "frame_idx", "class", fn.argmax("probs").alias("pred"))


from . import catalogue_files, catalogue_more, catalogue_plans  # noqa: E402,F401 - they add their queries
