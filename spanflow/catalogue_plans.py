"""Queries of compositions, hooks and sources with files: batches, pipelines, annotation, mixed scans, late streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .catalogue import CONV, EMB, EV, PIECES, RUNS, _day, _r, _read, embedding_frames, event_frames, order_segments, query, turn_segments
from .operators import decode, sampling, stats
from .operators import frames as R
from .operators import segments as S
from .plans.annotate import annotate, predictor_of
from .plans.training import pipeline
from .sources import annotations as A
from .sources import audio, store
from .streaming import stateful

# --- training batches and pipelines

RANKED = "least(3, n) AS steps FROM (SELECT *, count(*) OVER (PARTITION BY rec_id, chunk_id) AS n FROM {0})"


@query(f"""WITH {EMB}, f AS (SELECT rec_id, frame_idx, frame_idx // 25 AS chunk_id, class % 3 AS c FROM emb),
    w AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (c = 0) OVER w AS n0, count(*) FILTER (c = 1) OVER w AS n1, count(*) FILTER (c = 2) OVER w AS n2 FROM f WINDOW w AS (PARTITION BY rec_id, chunk_id ORDER BY frame_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)),
    d AS (SELECT rec_id, frame_idx, chunk_id, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS class FROM w WHERE n = 5),
    r AS (SELECT *, CASE WHEN class = lag(class) OVER (PARTITION BY rec_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS new FROM d), q AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS run FROM r),
    k AS (SELECT *, count(*) OVER (PARTITION BY rec_id, run) AS many, row_number() OVER (PARTITION BY rec_id, run ORDER BY md5('7:' || rec_id || ':' || frame_idx), frame_idx) AS pick FROM q),
    s AS (SELECT * FROM k WHERE class <> 0 OR pick <= greatest(1, floor(many * 0.5))),
    o AS (SELECT *, row_number() OVER (PARTITION BY rec_id, chunk_id ORDER BY md5('7:' || rec_id || ':' || chunk_id || ':' || frame_idx), frame_idx) - 1 AS row_pos, {RANKED.format('s')})
    SELECT rec_id, frame_idx, class, CAST(row_pos AS INTEGER) AS row_pos, CAST(least(row_pos // (n // steps), steps - 1) AS INTEGER) AS step FROM o""")
def training_batches(spark, d):
    df = R.assign_chunks(embedding_frames(spark, d).withColumn("class", (F.col("class") % 3).cast("int")), 25)
    return sampling.training_batches(df, 2, {0: 0.5}, 7, 3).select("rec_id", "frame_idx", "class", "row_pos", "step")


def _two_speakers(spark, d):
    active = F.array((F.col("class") % 2).cast("int"), (F.floor(F.col("class") / 2) % 2).cast("int"))
    return embedding_frames(spark, d).select(F.col("rec_id").cast("string").alias("rec_id"), "frame_idx", "feat", active.alias("active"))


@query(f"""WITH {EMB}, f AS (SELECT rec_id, frame_idx, frame_idx // 16 AS chunk_id, least(class % 2 + class // 2 % 2, 2) AS class FROM emb WHERE frame_idx >= 5),
    r AS (SELECT *, CASE WHEN class = lag(class) OVER (PARTITION BY rec_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS new FROM f), q AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS run FROM r),
    k AS (SELECT *, count(*) OVER (PARTITION BY rec_id, run) AS many, row_number() OVER (PARTITION BY rec_id, run ORDER BY frame_idx) AS pick FROM q), s AS (SELECT * FROM k WHERE class <> 1 OR pick <= greatest(1, floor(many * 0.4))),
    o AS (SELECT *, row_number() OVER (PARTITION BY rec_id, chunk_id ORDER BY frame_idx) - 1 AS p, {RANKED.format('s')})
    SELECT CAST(rec_id AS VARCHAR) AS rec_id, frame_idx, CAST(class AS INTEGER) AS class, CAST(least(p // (n // steps), steps - 1) AS INTEGER) AS step FROM o""")
def framewise_batches(spark, d):
    """A named pipeline with a function that runs first and with subsampling."""
    done = pipeline(_two_speakers(spark, d), "framewise", chunk=16, ratios={1: 0.4}, steps=3, prepare=lambda df: df.where("frame_idx >= 5"))
    return done.select("rec_id", "frame_idx", F.col("class").cast("int").alias("class"), "step")


@query(f"""WITH {EMB}, x AS (SELECT rec_id, frame_idx, frame_idx // 25 AS chunk_id, least(class % 2 + class // 2 % 2, 2) AS c, unnest(generate_series(1, 64)) AS bin, CAST(unnest(embedding) AS DOUBLE) AS v FROM emb),
    m AS (SELECT *, v - avg(v) OVER (PARTITION BY rec_id, chunk_id, bin) AS y FROM x), a AS (SELECT rec_id, frame_idx, chunk_id, min(c) AS c, sum(y * bin) AS a, sum(y) AS b FROM m GROUP BY ALL),
    w AS (SELECT rec_id, frame_idx, chunk_id, count(*) OVER w AS n, lag(a) OVER o + a + lead(a) OVER o + 64 * b + 128 * lead(b) OVER o AS checksum,
        count(*) FILTER (c = 0) OVER w AS n0, count(*) FILTER (c = 1) OVER w AS n1, count(*) FILTER (c = 2) OVER w AS n2 FROM a
        WINDOW w AS (PARTITION BY rec_id, chunk_id ORDER BY frame_idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), o AS (PARTITION BY rec_id, chunk_id ORDER BY frame_idx)),
    s AS (SELECT rec_id, frame_idx, chunk_id, checksum, CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS class FROM w WHERE n = 3),
    o AS (SELECT *, row_number() OVER (PARTITION BY rec_id, chunk_id ORDER BY frame_idx) - 1 AS p, {RANKED.format('s')}), t AS (SELECT unnest(['', '~']) AS mark)
    SELECT rec_id || mark AS rec_id, frame_idx, CAST(class AS INTEGER) AS class, CAST(least(p // (n // steps), steps - 1) AS INTEGER) AS step, round(checksum, 3) + 0.0 AS checksum FROM o CROSS JOIN t""")
def stereo_context_batches(spark, d):
    """The richest named pipeline: both orders of the channels, contexts of normalised vectors, dominant labels."""
    done = pipeline(_two_speakers(spark, d), "stereo_context_normalized", chunk=25, context=1, steps=3)
    check = F.aggregate(F.transform(F.flatten("context"), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return done.select("rec_id", "frame_idx", F.col("class").cast("int").alias("class"), "step", _r(check, "checksum", 3))


# --- hooks given as expressions


@query(f"""WITH {CONV}, t AS (SELECT rec_id, s, e, substr(label, 1, 1) AS state, lead(substr(label, 1, 1)) OVER (PARTITION BY rec_id ORDER BY s, e) AS next FROM conv),
    m AS (SELECT state AS f, next AS t, 1 AS n FROM t WHERE next IS NOT NULL UNION ALL SELECT state, state, e - s - 1 FROM t) SELECT f AS from_state, t AS to_state, CAST(sum(n) AS BIGINT) AS n FROM m GROUP BY ALL""")
def state_hook(spark, d):
    """States made of labels by an expression, in stretches of 100 ticks."""
    return decode.priors_from_segments(turn_segments(spark, d), F.substring("label", 1, 1), width=100.0)[1].withColumn("n", F.col("n").cast("long"))


@query(f"""WITH {EV}, c AS (SELECT *, length(class) % 3 AS k FROM ev), r AS (SELECT *, CASE WHEN k = lag(k) OVER (PARTITION BY rec_id ORDER BY frame_idx) THEN 0 ELSE 1 END AS new FROM c),
    q AS (SELECT *, sum(new) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS run FROM r), p AS (SELECT *, count(*) OVER (PARTITION BY rec_id, run) AS many, row_number() OVER (PARTITION BY rec_id, run ORDER BY frame_idx) AS pick FROM q)
    SELECT rec_id, frame_idx, class FROM p WHERE CASE k WHEN 2 THEN pick <= greatest(1, floor(many * 0.4)) WHEN 1 THEN false ELSE true END""")
def class_hook(spark, d):
    """Subsampling by classes that an expression makes."""
    return sampling.subsample(event_frames(spark, d), {2: 0.4, 1: 0.0}, cls=F.length("class") % 3).select("rec_id", "frame_idx", "class")


@query(f"""WITH {EV}, f AS (SELECT rec_id, frame_idx, class, frame_idx // 8 AS chunk_id, frame_idx // 32 AS chunk_range FROM ev), c AS (SELECT DISTINCT rec_id, chunk_id, chunk_range FROM f),
    p AS (SELECT c.*, pass FROM c CROSS JOIN (SELECT unnest([0, 1]) AS pass)),
    n AS (SELECT *, row_number() OVER (PARTITION BY pass ORDER BY md5('7:' || pass || ':' || chunk_range), md5('7:' || pass || ':' || chunk_range || ':' || rec_id || ':' || chunk_id)) - 1 AS chunk_pos FROM p)
    SELECT n.pass, CAST(chunk_pos AS INTEGER) AS chunk_pos, rec_id, frame_idx, class FROM n JOIN f USING (rec_id, chunk_id, chunk_range) WHERE pass > 1 OR pass = 1 AND chunk_pos >= 100""")
def resumed_pass(spark, d):
    """Labels of the frames that are left of the second pass over a bucketed store, from its chunk 100 on."""
    path = store.scratch(spark)
    table = f"frames_{path.rsplit('-', 1)[1]}"
    frames = R.assign_chunks(event_frames(spark, d).select("rec_id", "frame_idx", "class", F.array("value").alias("feat")), 8)
    store.write_frame_table(frames, table, path, 8, 4)
    plan = sampling.batch_plan(spark.table(table), 2, 7, keys=("chunk_range", "rec_id", "chunk_id"), start=(1, 100), first=1)
    return store.read_plan(plan, table, only_labels=True).select("pass", "chunk_pos", "rec_id", "frame_idx", "class")


# --- statistics and pairing


@query(f"""WITH {PIECES}, f AS (SELECT p.rec_id, p.s, p.e, count(DISTINCT g.label) > 1 AS several FROM pieces p LEFT JOIN seg g ON g.rec_id = p.rec_id AND g.s <= p.s AND g.e >= p.e GROUP BY p.rec_id, p.s, p.e),
    w AS (SELECT rec_id, string_agg(DISTINCT label, '' ORDER BY label) AS genders FROM seg GROUP BY rec_id),
    r AS (SELECT rec_id, count(*) AS n, sum(e - s) AS d, count(*) FILTER (several) AS m, coalesce(sum(e - s) FILTER (several), 0) AS o FROM f GROUP BY rec_id)
    SELECT genders, count(*) AS recordings, CAST(sum(d) AS BIGINT) AS duration, round(CAST(sum(m) AS DOUBLE) / sum(n), 4) AS overlap_pieces, round(CAST(sum(o) AS DOUBLE) / sum(d), 4) AS overlap_share FROM r JOIN w USING (rec_id) GROUP BY genders""")
def overlap_by_combination(spark, d):
    """How much is said at once in the recordings of each combination of speakers."""
    segs = order_segments(spark, d)
    speakers = segs.groupBy("rec_id").agg(F.transform(F.array_sort(F.collect_set("label")), lambda x: F.struct(x.alias("gender"))).alias("speakers"))
    done = stats.gender_stats(S.active_speakers(segs, [*"ANR"], "label"), speakers, overlap=True)
    return done.select("genders", "recordings", *_day("duration"), _r("overlap_pieces"), _r("overlap_share"))


@query("""WITH c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_custkey % 3 = 0 GROUP BY ALL), s AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL)
    SELECT k AS nation, coalesce(c.n, 0) AS n_left, coalesce(s.n, 0) AS n_right, CASE WHEN s.n IS NULL THEN 'left_only' WHEN c.n IS NULL THEN 'right_only' WHEN c.n <> s.n THEN 'mismatch' ELSE 'both' END AS status FROM c FULL JOIN s USING (k)""")
def pairs_counted(spark, d):
    left = _read(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_nationkey").alias("nation"))
    return S.pair_recordings(left, _read(spark, d, "supplier").select(F.col("s_nationkey").alias("nation")), "nation", counts=True)


@query(f"WITH {CONV} SELECT c.rec_id, c.turn, coalesce(n.label, 'outside') AS label FROM conv c LEFT JOIN conv n ON n.rec_id = c.rec_id AND n.s = c.e")
def turn_at_border(spark, d):
    """Points a trillionth before each turn's end: rounding brings them to the next turn. In stretches of 500 ticks."""
    segs = turn_segments(spark, d)
    return S.label_at(segs.select("rec_id", "turn", (F.col("end") - 1e-12).alias("t")), segs, default="outside", width=500).select("rec_id", "turn", "label")


# --- checks, and what stores keep


@query(f"""WITH {CONV}, k AS (SELECT * FROM conv WHERE turn % 5 <> 3), n AS (SELECT *, lead(s) OVER (PARTITION BY rec_id ORDER BY s, e) AS after FROM k)
    SELECT rec_id, CAST(s AS BIGINT) AS start, CAST(e AS BIGINT) AS "end", 'the next segment starts elsewhere' AS problem FROM n WHERE after <> e""")
def gaps_between_turns(spark, d):
    return S.check_segments(turn_segments(spark, d).where("turn % 5 <> 3"), contiguous=True).select("rec_id", *_day("start", "end"), "problem")


@query(f"""WITH {EV}, r AS (SELECT rec_id, count(*) AS n, max(abs(value - 40)) / 50 AS peak, avg((value - 40) / 50) AS mean FROM ev GROUP BY rec_id),
    f AS (SELECT rec_id, unnest([CASE WHEN rec_id % 4 = 0 THEN 'rate' END, CASE WHEN rec_id % 5 = 0 THEN 'channels' END, CASE WHEN rec_id % 3 = 0 THEN 'shorter than its labels' END,
        CASE WHEN peak > 1 THEN 'amplitude' END, CASE WHEN abs(mean) > 0.2 THEN 'mean' END]) AS "check" FROM r) SELECT rec_id, "check" FROM f WHERE "check" IS NOT NULL""")
def sound_checks(spark, d):
    """Rate, channels, length against labels, amplitude and mean of each user's values, taken as samples."""
    blocks = event_frames(spark, d).groupBy("rec_id", F.floor(F.col("frame_idx") / 7).alias("block")).agg(F.collect_list((F.col("value") - 40) / 50).alias("samples"))
    rate, rec = F.when(F.col("rec_id") % 4 == 0, 16000).otherwise(8000), F.col("rec_id")
    catalog = blocks.groupBy("rec_id").agg(F.sum(F.size("samples")).alias("samples")).select("rec_id", "samples", rate.alias("rate"), F.when(rec % 5 == 0, 2).otherwise(1).alias("channels"))
    labels = catalog.select("rec_id", F.lit(0.0).alias("start"), (F.col("samples") + F.when(rec % 3 == 0, 1).otherwise(0)).cast("double").alias("end"), "rate")
    return R.check_recordings(catalog, labels, blocks, tolerance=0.2)


@query(f"""WITH {EMB}, k AS (SELECT rec_id, frame_idx, frame_idx // 20 AS chunk_id, (rec_id + frame_idx) % 13 = 0 AS wide FROM emb WHERE (rec_id * 3 + frame_idx) % 17 <> 0),
    c AS (SELECT rec_id, chunk_id, count(*) AS n, max(frame_idx) - min(frame_idx) + 1 AS span, bool_or(wide) AS wide FROM k GROUP BY ALL),
    f AS (SELECT rec_id, chunk_id, n, unnest([CASE WHEN n <> 20 THEN 'size' END, CASE WHEN span <> n THEN 'gap' END, CASE WHEN wide THEN 'dimensions' END]) AS problem FROM c) SELECT * FROM f WHERE problem IS NOT NULL""")
def chunk_checks(spark, d):
    """Chunks of a wrong size, with gaps, or with vectors of other lengths."""
    frames = embedding_frames(spark, d).where((F.col("rec_id") * 3 + F.col("frame_idx")) % 17 != 0)
    cut = F.when((F.col("rec_id") + F.col("frame_idx")) % 13 == 0, F.slice("feat", 1, 63)).otherwise(F.col("feat"))
    return R.check_chunks(R.assign_chunks(frames.withColumn("feat", cut), 20), 20, feat="feat", dims=64)


@query(f"""WITH {EV}, x AS (SELECT CASE WHEN rec_id % 3 = 0 THEN 'val' ELSE 'train' END AS split, class, lag(class) OVER (PARTITION BY rec_id ORDER BY frame_idx) AS was FROM ev)
    SELECT split, was AS from_state, class AS to_state, count(*) AS n FROM x WHERE was IS NOT NULL GROUP BY ALL""")
def stored_transitions(spark, d):
    path, frames = store.scratch(spark), event_frames(spark, d)
    for split, part in (("val", "rec_id % 3 = 0"), ("train", "rec_id % 3 <> 0")):
        store.write_priors(*decode.priors_from_frames(frames.where(part), size=16), path, split)
    return store.read_priors(spark, path, ["val", "train"])[1].select("split", "from_state", "to_state", "n")


# --- sound

BANK = ", ".join(f"({m}, {k}, CAST({w!r} AS DOUBLE))" for m, row in enumerate(audio.mel_bank(8000, 32, 8).tolist()) for k, w in enumerate(row) if w)


@query(f"""WITH {EV}, bank AS (SELECT * FROM (VALUES {BANK}) b(mel, k, weight)), n AS (SELECT *, count(*) OVER (PARTITION BY rec_id) AS n FROM ev),
    f AS (SELECT rec_id, value, n, frame_idx AS i, unnest(range(greatest(0, (frame_idx - 24) // 8), frame_idx // 8 + 1)) AS f FROM n),
    h AS (SELECT rec_id, f, i - 8 * f AS t, value * (0.5 - 0.5 * cos(2 * pi() * (i - 8 * f) / 32)) AS x FROM f WHERE i - 8 * f BETWEEN 0 AND 31 AND 8 * f + 32 <= n),
    p AS (SELECT rec_id, f, k, sum(x * cos(2 * pi() * k * t / 32)) ^ 2 + sum(x * sin(2 * pi() * k * t / 32)) ^ 2 AS power FROM h CROSS JOIN (SELECT unnest(range(0, 17)) AS k) GROUP BY ALL)
    SELECT rec_id, f AS frame_idx, CAST(mel AS INTEGER) AS mel, round(log10(greatest(1e-8, sum(power * weight))), 4) AS value FROM p JOIN bank USING (k) GROUP BY rec_id, f, mel""")
def logmel_events(spark, d):
    """Log-mel features of the event values of each user, taken as samples, in blocks shorter than the window."""
    df = event_frames(spark, d).withColumn("block", F.floor(F.col("frame_idx") / 10))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", F.col("value").alias("v")))), lambda x: x["v"])
    made = audio.logmel(df.groupBy("rec_id", "block").agg(rows.alias("samples")), 8000, 32, 8, 8, frames=2)
    return made.select("rec_id", "frame_idx", F.posexplode("feat").alias("mel", "value")).withColumn("value", F.round("value", 4))


def _sounds(spark, d) -> str:
    """A WAV file for each conversation, whose 8-bit samples are its text; of odd ones with two channels."""
    path = store.scratch(spark)
    whole = _read(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    payload, ch = F.col("text").cast("binary"), F.col("conv_id") % 2 + 1
    raw = lambda x: F.lit(x).cast("binary")

    def little(x, n):
        h = F.lpad(F.hex(x), 2 * n, "0")
        return F.unhex(F.concat(*(F.substring(h, 2 * k + 1, 2) for k in range(n - 1, -1, -1))))

    n = F.length(payload)
    head = F.concat(raw("RIFF"), little(n + 48, 4), raw("WAVELIST"), little(F.lit(4), 4), raw("note"), raw("fmt "), little(F.lit(16), 4), little(F.lit(1), 2), little(ch, 2), little(F.lit(8000), 4), little(8000 * ch, 4), little(ch, 2), little(F.lit(8), 2), raw("data"), little(n, 4))
    store.write_files(whole.select(F.concat(F.lit("call_"), "conv_id", F.lit(".wav")).alias("name"), F.concat(head, payload).alias("content")), path)
    return path


WHOLE = "w AS (SELECT conv_id, conv_id % 2 + 1 AS channels, encode(string_agg(text, ' ' ORDER BY turn)) AS b FROM conversations GROUP BY conv_id), v AS (SELECT conv_id, channels, b, octet_length(b) // channels AS samples FROM w)"


@query(f"WITH {WHOLE} SELECT 'call_' || conv_id AS rec_id, 8000 AS rate, CAST(channels AS INTEGER) AS channels, samples, round(samples / 8000.0, 6) AS seconds FROM v")
def wav_files_listed(spark, d):
    """Headers of files on disk, with a chunk before the format; tasks seek, whatever the files' lengths."""
    return audio.audio_catalog(spark, _sounds(spark, d)).select("rec_id", "rate", "channels", "samples", _r("seconds", n=6))


@query(f"""WITH {WHOLE}, x AS (SELECT conv_id, channels, unnest(range(0, samples * channels)) AS i, hex(b) AS h FROM v), y AS (SELECT conv_id, i % channels AS channel, i // channels AS t, CAST(('0x' || substr(h, 2 * i + 1, 2)) AS INTEGER) / 128.0 - 1 AS x FROM x)
    SELECT 'call_' || conv_id AS rec_id, CAST(channel AS INTEGER) AS channel, CAST(t // 500 AS INTEGER) AS block, count(*) AS n, round(sum(x * (t % 500 + 1)), 3) AS checksum FROM y GROUP BY ALL""")
def wav_files_read(spark, d):
    """All samples of files on disk, in blocks that are read from their places."""
    made = audio.read_samples(spark, _sounds(spark, d), mono=False, block=500)
    check = F.aggregate(F.transform("samples", lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return made.select("rec_id", "channel", "block", F.size("samples").cast("long").alias("n"), _r(check, "checksum", 3))


@query()
def annotated_recordings(spark, d):
    """From sound files to tiers: features, normalisation, contexts, scores, smoothing, runs. SQL has no such chain; its
    steps have queries of their own."""
    weights = np.array([[((j * (k + 2)) % 7 - 3) / 10 for j in range(24)] for k in range(3)])
    stay = [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]]
    return annotate(spark, _sounds(spark, d), predictor_of(weights, np.zeros(3)), [0.6, 0.2, 0.2], stay, win=64, hop=32, n_mels=8, norm=5, context=1)


# --- documents and streams


@query(f"""WITH {CONV}, t AS (SELECT c.rec_id, s, e, CAST(c.turn % 2 AS VARCHAR) AS speaker FROM conv c)
    SELECT 'call_' || rec_id AS rec_id, 'transcript' AS kind, s AS start, e AS "end", 100 AS rate, speaker FROM t UNION ALL SELECT 'tiers_' || rec_id, label, s * 1000, e * 1000, 1000, NULL FROM conv""")
def mixed_annotations(spark, d):
    """A folder of transcripts and ELAN documents, each read by its extension."""
    path, turns = store.scratch(spark), turn_segments(spark, d)
    seconds = lambda c: F.format_string("%d.%02d", F.floor(F.col(c) / 100).cast("long"), (F.col(c) % 100).cast("long"))
    line = F.struct("start", F.concat(seconds("start"), F.lit(" "), seconds("end"), F.when(F.col("turn") % 2 == 0, " A: x").otherwise(" B: x")).alias("x"))
    said = turns.groupBy("rec_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda r: r["x"]), "\n").alias("content"))
    store.write_files(said.select(F.concat(F.lit("x_call-"), "rec_id", F.lit(".txt")).alias("name"), "content"), path)
    documents = A.tier_documents(A.tier_rows(turns, F.col("label")))
    store.write_files(documents.select(F.concat(F.lit("tiers_"), "rec_id", F.lit(".eaf")).alias("name"), F.col("document").alias("content")), path)
    return A.read_annotations(spark, path).select(F.regexp_replace("rec_id", "-", "_").alias("rec_id"), F.coalesce("tier", F.lit("transcript")).alias("kind"), *_day("start", "end"), F.col("rate").cast("int").alias("rate"), "speaker")


@query(f"""WITH {CONV} SELECT rec_id, label AS tier, CAST(s * 1000 AS BIGINT) AS start, CAST(e * 1000 AS BIGINT) AS "end", label AS content FROM conv
    UNION ALL SELECT rec_id, 'whole', 0, CAST(1000 * max(e) AS BIGINT), 'all <of it>' FROM conv GROUP BY rec_id""")
def tiers_added_to_documents(spark, d):
    """Documents that get one more tier."""
    first, second, turns = store.scratch(spark), store.scratch(spark), turn_segments(spark, d)
    A.write_eaf(A.tier_rows(turns, F.col("label")), first)
    more = turns.groupBy(F.col("rec_id").cast("string").alias("rec_id")).agg(F.lit("whole").alias("tier"), F.lit(0).cast("long").alias("start"), (1000 * F.max("end")).cast("long").alias("end"), F.lit("all <of it>").alias("content"))
    A.add_to_eaf(spark, first, more, second, glob="*", rec_id=A.folder_id())
    return A.read_eaf(spark, second, glob="*").select(A.folder_id().cast("long").alias("rec_id"), "tier", "start", "end", "content")


@query(f"WITH {RUNS} SELECT rec_id, s AS start, e AS \"end\", class AS key FROM runs")
def runs_of_late_frames(spark, d):
    """A stream whose second part holds the frames between those of the first: with a watermark the runs are those of all."""
    path = store.scratch(spark)
    frames = event_frames(spark, d).select("rec_id", "frame_idx", "class", F.timestamp_seconds(F.col("frame_idx") + 1000).alias("ts"))
    end = frames.limit(1).select(F.lit(-1).cast(frames.schema["rec_id"].dataType).alias("rec_id"), F.lit(0).cast("long").alias("frame_idx"), "class")
    parts = [frames.where("frame_idx % 3 = 0"), frames.where("frame_idx % 3 <> 0"), *(end.withColumn("ts", F.timestamp_seconds(F.lit(10**9 + k))) for k in range(2))]
    before, spark_conf = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None), spark.conf
    stateful.use_rocksdb(spark)
    try:
        for part in parts:  # a restart from the checkpoint after each part
            part.write.mode("append").parquet(f"{path}/in")
            stream = stateful.runs_stream(stateful.stream_frames(spark, f"{path}/in", frames.schema), watermark=("ts", "1000000 seconds"))
            stream.writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").option("path", f"{path}/out").format("parquet").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark_conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark_conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out").where("rec_id <> -1")
