import io
import wave

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation
from pyspark.sql import functions as F

from spanflow.operators import decode
from spanflow.operators import segments as S
from spanflow.plans import annotate, training
from spanflow.sources import annotations as A
from spanflow.sources import audio, store


def test_transcripts(spark, tmp_path):
    (tmp_path / "fe_03_00001.txt").write_text("# comment\n\n0.25 1.5 A: hello there\n1.05 2.00 B: yes\n")
    got = [(r.rec_id, r.start, r.end, r.rate, r.speaker, r.content) for r in A.read_transcripts(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == [("00001", 25, 150, 100, "0", "hello there"), ("00001", 105, 200, 100, "1", "yes")]
    (tmp_path / "fe_03_00002.txt").write_text("0 1 C: no\n")
    with pytest.raises(PySparkException):
        A.read_transcripts(spark, str(tmp_path)).collect()


def test_calls_and_sample_labels(spark, tmp_path):
    (tmp_path / "calls.csv").write_text("a,b,c,d,e,f,g,h,i,j,k,l,m,n,o\n00001,x,ENG1,2.5,3.0,111,f.a,,,,222,m.o,,,\n")
    r = A.read_recordings(spark, str(tmp_path / "calls.csv")).first()
    assert (r.rec_id, r.group_id, r.signal_grade, [tuple(s) for s in r.speakers]) == ("00001", "000", 2.5, [("111", "f", "a"), ("222", "m", "o")])
    (tmp_path / "x.phn").write_text("0 3050 h#\n3050 4559 sh and more\n")
    got = [(r.start, r.end, r.label) for r in A.read_sample_labels(spark, str(tmp_path / "x.phn")).orderBy("start").collect()]
    assert got == [(0, 3050, "h#"), (3050, 4559, "sh and more")]


def segment(point, length, descriptor):
    return f"<m:AudioSegment><m:MediaTime><m:MediaTimePoint>{point}</m:MediaTimePoint><m:MediaDuration>{length}</m:MediaDuration></m:MediaTime>{descriptor}</m:AudioSegment>"


def test_mpeg7(spark, tmp_path):
    who = '<m:AudioDescriptor confidence="0.5"><m:SpokenContent>hi</m:SpokenContent><m:Speaker id="s1" gender="f"><m:GivenName>Ann</m:GivenName></m:Speaker></m:AudioDescriptor>'
    body = segment("T00:00:01:500F1000", "PT0H0M2S250N1000F", who) + segment("T00:00:05:0F1000", "PT1S", "") + segment("T00:00:05:0F1000", "PT0S", who) + segment("T00:00:04:1F3", "PT1S0N3F", who)
    (tmp_path / "one.xml").write_text(f'<m:Mpeg7 xmlns:m="urn:x">{body}</m:Mpeg7>')
    got = [(r.start, r.end, r.rate, r.speaker) for r in A.read_mpeg7(spark, str(tmp_path)).orderBy("start").collect()]
    assert got == [(4500, 11250, 3000, "s1"), (13000, 16000, 3000, "s1")]
    (tmp_path / "two.xml").write_text('<m:Mpeg7 xmlns:m="urn:x"></m:Mpeg7>')
    assert A.read_mpeg7(spark, str(tmp_path), strict=False).count() == 2
    with pytest.raises(PySparkException, match="no annotation in .*two.xml"):
        A.read_mpeg7(spark, str(tmp_path)).collect()


def test_mpeg7_files_are_read_once(spark, tmp_path):
    """Few tasks open many files, once each; elements are found in any dialect, past comments, broken and nested ones."""
    who = '<m:AudioDescriptor confidence="0.5"><m:SpokenContent>a &lt; <![CDATA[b]]></m:SpokenContent></m:AudioDescriptor>'
    good = segment("T00:00:01:0F10", "PT1S0N10F", who)
    bodies = {
        "plain": (good, 1), "comment": (f"<!-- {good} -->{good}<![CDATA[{good}]]>", 1), "broken": (good + good.replace("&lt;", "&") + good, 2), "self": ("<m:AudioSegment/>" + good, 1),
        "nested": (good.replace("</m:AudioSegment>", f"<m:TemporalDecomposition>{good}</m:TemporalDecomposition></m:AudioSegment>") + good, 2), "open": (good + "<m:AudioSegment>", 1), "other": (good.replace("m:", "q:"), 1),
    }
    for k, (body, _) in bodies.items():
        (tmp_path / k).mkdir()
        (tmp_path / k / f"{k} #%41.xml").write_text(f"<x>{body}</x>")
    for hidden in ("_x.xml", ".x.xml", "x.txt"):
        (tmp_path / "plain" / hidden).write_text("")
    read = A.read_mpeg7(spark, str(tmp_path))
    got = read.groupBy("source", "content").count().collect()
    assert {r.source.rsplit("/", 2)[1]: r["count"] for r in got} == {k: n for k, (_, n) in bodies.items()}
    assert {r.content for r in got} == {"a < b"} and all(r.source.endswith("%20%23%2541.xml") for r in got)
    assert "FileScan" not in read._jdf.queryExecution().toString()  # a scan for each of five joined reads before
    assert A.read_mpeg7(spark, str(tmp_path), strict=False, dialect="q").select("source").distinct().count() == 1
    with pytest.raises(PySparkException, match="no annotation in .*plain"):
        A.read_mpeg7(spark, str(tmp_path / "plain"), dialect="q").collect()
    with pytest.raises(FileNotFoundError):
        A.read_mpeg7(spark, str(tmp_path / "none"))
    text = "<x>" + good * 50 + f"<!-- {good} --></x>"
    for size in (1, 7, 100):  # elements and marks over the borders of what is read at once
        assert [*A._audio_segments(io.BytesIO(text.encode()), "<m:AudioSegment", size)] == [good] * 50 + [None]


def test_files_below(spark, tmp_path):
    """The same files as by Spark's own reader."""
    for name in ("a.wav", "b c.wav", "x.txt", "_h.wav", ".h.wav", "_k=1.wav", "p/q/d%20.wav", "_p/e.wav", "p=1/f.wav", "p/é.WAV", "p/g1.wav"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * len(name))
    for glob in ("*", "*.wav", "{a,f}.*", "[^a]*.wav", "?.wav"):
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(str(tmp_path))
        got = store.files_below(spark, str(tmp_path), glob)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, own.select("path", "length").collect()))
    assert got.rdd.getNumPartitions() == 4


def test_eaf_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.0, 2.0, 2.0, "x & y"), ("a", 1.0, 3.0, 2.0, "z")], "rec_id string, start double, end double, rate double, label string")
    tiers = A.tier_rows(df, F.concat(F.lit("t-"), F.substring("label", 1, 1)))
    document = A.tier_documents(tiers).first().document
    (tmp_path / "a.eaf").write_text(document)
    back = {(r.tier, r.start, r.end, r.content) for r in A.read_eaf(spark, str(tmp_path)).collect()}
    assert back == {("t-x", 0, 500, "x & y"), ("t-x", 500, 1000, "x & y"), ("t-z", 500, 1000, "z"), ("t-z", 1000, 1500, "z")}
    assert A.read_eaf(spark, str(tmp_path), ["t-z"]).count() == 2
    with pytest.raises(ValueError):
        A.read_eaf(spark, str(tmp_path), ["none"])


def wav(path, x, rate=8000, channels=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.asarray(x) * 32767).astype("<i2").tobytes())
    path.write_bytes(out.getvalue())


def test_audio_catalogue_and_features(spark, tmp_path):
    x = np.sin(np.arange(8000) / 5) * 0.5
    wav(tmp_path / "a.wav", x)
    wav(tmp_path / "b.wav", np.repeat(x, 2), channels=2)
    got = {r.rec_id: (r.rate, r.channels, r.samples, r.seconds) for r in audio.audio_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a": (8000, 1, 8000, 1.0), "b": (8000, 2, 8000, 1.0)}
    head = spark.read.format("binaryFile").load(str(tmp_path / "b.wav")).select(audio.wav_header().alias("h")).first().h
    assert (head.channels, head.rate, head.bits, head.samples) == (2, 8000, 16, 8000)
    samples = audio.read_samples(spark, str(tmp_path), block=1000)
    feats = audio.logmel(samples)
    whole = audio.logmel_frames((x * 32767).astype("<i2") / 32768, audio.mel_bank(8000, 256, 64), 256, 80)
    for rec in "ab":
        rows = feats.where(F.col("rec_id") == rec).orderBy("frame_idx").collect()
        assert np.allclose(np.array([r.feat for r in rows]), whole)
    (tmp_path / "c.wav").write_bytes(b"nothing")
    assert audio.audio_catalog(spark, str(tmp_path), strict=False).where("problem is not null").count() == 1
    (tmp_path / "d.sph").write_bytes(b"NIST_1A\n   1024\nsample_count -i 80\nchannel_count -i 2\nsample_rate -i 8000\nend_head\n".ljust(1024))
    assert audio.audio_catalog(spark, str(tmp_path), "sph").first().samples == 80
    rows = annotate.annotate(spark, str(tmp_path), annotate.predictor_of(np.zeros((3, 3 * 64)), np.array([0.0, 1.0, 0.0])), [1 / 3] * 3, [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]], norm=20, context=1).collect()
    assert {(r.rec_id, r.tier, r.start) for r in rows if r.tier} == {("a", "single", 26), ("b", "single", 26)}
    assert [(r.rec_id, r.problem) for r in rows if r.problem] == [("c", "not a WAV file")]
    two = [annotate.predictor_of(np.zeros((3, 3 * 64)), np.array(b)) for b in ([0.0, 1.0, 0.0], [9.0, 0.0, 0.0])]
    last = annotate.annotate(spark, str(tmp_path), two, [1 / 3] * 3, [[0.8, 0.1, 0.1], [0.1, 0.8, 0.1], [0.1, 0.1, 0.8]], norm=20, context=1, merge=lambda v: v[1]).collect()
    assert {r.tier for r in last if r.tier} == {"none"}


@pytest.mark.parametrize("bits,kind", [(8, 1), (16, 1), (24, 1), (32, 1), (32, 3), (64, 3)])
def test_sample_formats(bits, kind):
    x = np.array([[0.5, -0.25], [-1.0, 0.75], [0.0, 0.125]])
    if kind == 3:
        raw = x.astype(f"<f{bits // 8}").tobytes()
    elif bits == 8:
        raw = (x * 128 + 128).astype(np.uint8).tobytes()
    else:
        raw = b"".join(int(v).to_bytes(bits // 8, "little", signed=True) for v in (x * (1 << (bits - 1))).ravel())
    head = b"fmt " + (16).to_bytes(4, "little") + kind.to_bytes(2, "little") + (2).to_bytes(2, "little") + (8000).to_bytes(4, "little") + bytes(6) + bits.to_bytes(2, "little")
    for size, cut in ((len(raw), 0), (len(raw) + 999, 0), (len(raw), 1)):  # whole, longer than the file, cut within a sample
        body = raw[: len(raw) - cut]
        wav_ = b"RIFF" + bytes(4) + b"WAVE" + b"LIST" + (3).to_bytes(4, "little") + bytes(4) + head + b"data" + size.to_bytes(4, "little") + body
        kind_, channels, rate, bits_, at, n = audio._wav_parts(wav_)
        got = audio.pcm(wav_[at : at + n], bits_, channels, kind_)
        assert (channels, rate) == (2, 8000) and np.allclose(got, x[: len(body) // (bits // 4)])


def test_unknown_formats_are_errors():
    head = b"RIFF" + bytes(4) + b"WAVEfmt " + (16).to_bytes(4, "little")
    for kind, channels, bits in ((7, 1, 8), (1, 0, 16), (1, 1, 12), (3, 1, 16)):
        with pytest.raises(ValueError):
            audio._wav_parts(head + kind.to_bytes(2, "little") + channels.to_bytes(2, "little") + (8000).to_bytes(4, "little") + bytes(6) + bits.to_bytes(2, "little") + b"data" + bytes(4))


def test_eaf_without_annotations(spark, tmp_path):
    tier = '<TIER TIER_ID="{}" ANNOTATOR="me" PARTICIPANT="you">{}</TIER>'
    note = '<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="{0}" TIME_SLOT_REF1="{1}" TIME_SLOT_REF2="{2}"><ANNOTATION_VALUE>{0}</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>'
    slots = "".join(f'<TIME_SLOT TIME_SLOT_ID="ts{k}" TIME_VALUE="{k * 10}"/>' for k in range(4))
    page = lambda *tiers: f"<ANNOTATION_DOCUMENT><TIME_ORDER>{slots}</TIME_ORDER>{''.join(tiers)}</ANNOTATION_DOCUMENT>"
    (tmp_path / "a.eaf").write_text(page(tier.format("x", note.format("a1", "ts0", "ts2") + note.format("a2", "ts3", "ts3") + note.format("a3", "ts3", "ts1")), tier.format("y", "")))
    watch = Observation()
    got = A.read_eaf(spark, str(tmp_path), observation=watch).collect()
    assert [(r.tier, r.annotator, r.participant, r.start, r.end) for r in got] == [("x", "me", "you", 0, 20)] and watch.get["dropped"] == 2
    assert A.read_eaf(spark, str(tmp_path), F.col("tier") == "x").count() == 1
    with pytest.raises(ValueError):
        A.read_eaf(spark, str(tmp_path), ["y"])
    (tmp_path / "b.eaf").write_text(page())
    with pytest.raises(ValueError, match="b.eaf"):
        A.read_eaf(spark, str(tmp_path)).collect()
    assert A.read_eaf(spark, str(tmp_path), strict=False).count() == 1


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, [1.0], "g", "train"), ("b", 0, [2.0], "g", "val")], "rec_id string, frame_idx long, feat array<double>, group_id string, split string")
    store.write_frames(df, str(tmp_path / "f"))
    assert "feat" not in store.read_frames(spark, str(tmp_path / "f"), True).columns
    assert store.append_results(df, str(tmp_path / "r"), ["rec_id"]) == 2
    assert store.append_results(df.withColumn("frame_idx", F.lit(9)), str(tmp_path / "r"), ["rec_id"]) == 0
    states, moves = decode.priors_from_frames(df.withColumn("class", F.lit(1)))
    for split in ("val", "train", "val"):
        store.write_priors(states, moves, str(tmp_path / "p"), split)
    assert store.read_priors(spark, str(tmp_path / "p"), ["val"])[0].first().prior == 2


def test_named_pipelines(spark):
    df = spark.createDataFrame([("a", i, [float(i), 1.0], [i // 4 % 2, 1]) for i in range(20)], "rec_id string, frame_idx long, feat array<double>, active array<int>")
    for name in training.PIPELINES:
        got = training.pipeline(df, name, chunk=10, context=1, seed=1, steps=2)
        want = (8 if "context" in name else 10) * 2 * (2 if "stereo" in name else 1)
        assert got.count() == want, name


def test_split_operators(spark):
    a, b = spark.createDataFrame([("x",), ("y",)], "rec_id string"), spark.createDataFrame([("y",), ("z",)], "rec_id string")
    assert [r[0] for r in S.check_disjoint(a, b).collect()] == ["y"]
    assert sorted((r.rec_id, r.side) for r in S.check_same(a, b).collect()) == [("x", "left"), ("z", "right")]
    assert {r.rec_id: r.status for r in S.pair_recordings(a, b).collect()} == {"x": "left_only", "y": "both", "z": "right_only"}


def test_tiers_in_few_files(spark, tmp_path):
    path = str(tmp_path / "tiers")
    df = spark.range(300).select(F.concat(F.lit("r"), "id").alias("rec_id"), F.lit(0.0).alias("start"), F.lit(2.0).alias("end"), F.lit(1.0).alias("rate"), F.lit("x").alias("label"))
    A.write_tiers(df, path, F.col("label"))
    A.write_tiers(df.where("rec_id < 'r2'").withColumn("label", F.lit("y")), path, F.col("label"), mode="append")
    got = sorted((r.rec_id, r.tier, r.start, r.end) for r in spark.read.parquet(path).collect())
    assert got == sorted((f"r{k}", t, 0, 2000) for k in range(300) for t in "xy" if t == "x" or f"r{k}" < "r2")
    assert len(list((tmp_path / "tiers").rglob("*.parquet"))) < 50  # one for each recording before


def test_texts_of_many_recordings(spark, tmp_path):
    """A file for each recording, whatever its name, in as many folders as there are tasks."""
    path, ids = str(tmp_path / "texts"), [*(f"r{k}" for k in range(200)), "a.b", "a/b", "ä c"]
    rows = spark.createDataFrame([(r, f"{k} {k + 1} said") for r in ids for k in range(3)], "rec_id string, value string")
    assert store.write_texts(rows, path) == 203
    files = [f.name for f in (tmp_path / "texts").rglob("*.txt")]
    assert len(files) == 203 and len(list((tmp_path / "texts").iterdir())) <= 4  # a folder for each recording before
    got = A.read_sample_labels(spark, path, rec_id=A.folder_id()).groupBy("rec_id").count().collect()
    assert {r["count"] for r in got} == {3} and {r.rec_id for r in got} >= {"r0", "r199", "a.b"}
    with pytest.raises(FileExistsError):
        store.write_texts(rows, path)
    assert store.write_texts(rows.where("rec_id = 'r0'").withColumn("value", F.lit("9 10 x")), path, mode="append") == 1
    assert sorted(r.start for r in A.read_sample_labels(spark, path, rec_id=A.folder_id()).where("rec_id = 'r0'").collect()) == [0, 1, 2, 9, 9, 9]
    store.write_texts(rows.where("rec_id = 'r1'"), path, mode="overwrite")
    assert A.list_files(spark, path).count() == 1
