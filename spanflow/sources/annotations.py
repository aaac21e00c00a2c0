"""Readers and a writer of annotation formats. Schemas are declared; times become exact ticks without floating point."""

from __future__ import annotations

import codecs
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as fn
from ..operators import segments as S
from . import store


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path and length of the files below root; contents are not read, and tasks list the folders."""
    return store.files_below(spark, root, glob)


def _lines(spark: SparkSession, path: str, glob: str | None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", "true")
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("source"))


def read_transcripts(spark: SparkSession, path: str, glob: str | None = None, rec_id: Column | None = None) -> DataFrame:
    """Dialogue transcripts: lines `start end SPEAKER: words`. Blank lines and lines with # are left out; a speaker other
    than A or B is an error; a file's rate is 10 to the most decimals in it; text after a second colon is lost. rec_id: an
    expression of `source` (None: by the file's name)."""
    raw = _lines(spark, path, glob).where("line <> '' and line not like '#%'")
    g = lambda k: F.regexp_extract("line", r"^(\S+)\s+(\S+)\s+(\S+?):([^:]*)", k)
    df = raw.select("source", g(1).alias("s"), g(2).alias("e"), g(3).alias("spk"), F.trim(g(4)).alias("content"))
    places = lambda c: F.length(F.regexp_extract(c, r"\.(\d*)$", 1))
    digits = F.max(F.greatest(places("s"), places("e"))).over(Window.partitionBy("source"))
    df = df.withColumn("_d", digits)
    ticks = lambda c: F.concat(F.replace(F.col(c), F.lit("."), F.lit("")), F.expr(f"repeat('0', _d - length(regexp_extract({c}, '[.](\\\\d*)$', 1)))")).cast("long")
    speaker = F.when(F.col("spk") == "A", 0).when(F.col("spk") == "B", 1).otherwise(F.raise_error(F.concat(F.lit("unknown speaker: "), "spk")))
    return df.select(
        (fn.recording_id(F.element_at(F.split("source", "/"), -1)) if rec_id is None else rec_id).alias("rec_id"), ticks("s").alias("start"), ticks("e").alias("end"), F.pow(F.lit(10), "_d").cast("long").alias("rate"),
        speaker.cast("string").alias("speaker"), "content", "source",
    )


CALLS = "callid string, x1 string, topicid string, signalgrade double, convgrade double, pin_a string, sex_a string, x2 string, x3 string, x4 string, pin_b string, sex_b string, x5 string, x6 string, x7 string"


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Call table of 15 columns with a header; speakers in channel order."""
    df = spark.read.csv(path, header=True, schema=CALLS)
    one = lambda s: F.struct(F.col(f"pin_{s}").alias("pin"), fn.gender_dialect(f"sex_{s}")["gender"].alias("gender"), fn.gender_dialect(f"sex_{s}")["dialect"].alias("dialect"))
    return df.select(
        F.col("callid").alias("rec_id"), fn.group_id("callid").alias("group_id"), F.col("topicid").alias("topic_id"), F.col("signalgrade").alias("signal_grade"), F.col("convgrade").alias("conv_grade"), F.array(one("a"), one("b")).alias("speakers")
    )


def read_sample_labels(spark: SparkSession, path: str, sep: str = " ", rate: int = 16000, glob: str | None = None, rec_id: Column | None = None) -> DataFrame:
    """Lines `start end words...` with ticks in samples. rec_id: as in read_transcripts()."""
    parts = F.split("line", rf"\Q{sep}\E")
    return _lines(spark, path, glob).where("line <> ''").select(
        (fn.file_stem("source") if rec_id is None else rec_id).alias("rec_id"), parts[0].cast("long").alias("start"), parts[1].cast("long").alias("end"), F.lit(rate).cast("long").alias("rate"), F.array_join(F.slice(parts, 3, F.size(parts)), " ").alias("label"), "source"
    )


MPEG7 = """
    TemporalDecomposition string, MediaTime struct<MediaTimePoint:string,MediaDuration:string>,
    AudioDescriptor array<struct<_confidence:double,Identifier:string,SpokenContent:string,Speaker:struct<_id:string,_gender:string,GivenName:string>>>
"""


#: Comments, character data, and the tags of AudioSegment elements with any prefix; the last one of a text may be open.
_MARKS = re.compile(r"""<!--(?:.*?-->|.*\Z)|<!\[CDATA\[(?:.*?\]\]>|.*\Z)|<(/?)(?:[^\s<>/:!?"']+:)?AudioSegment(?:\s(?:[^>"']|"[^"]*"|'[^']*')*?)?(/?)>""", re.S)


def _decoder(head: bytes):
    """What decodes an XML file that begins with these bytes."""
    told = re.match(rb"""<\?xml[^>]*?encoding\s*=\s*["']([\w.-]+)""", head)
    name = "utf-16" if head[:2] in (b"\xff\xfe", b"\xfe\xff") else told[1].decode() if told else "utf-8-sig"
    try:
        return codecs.getincrementaldecoder(name)("replace")
    except LookupError:
        return codecs.getincrementaldecoder("utf-8")("replace")


def _audio_segments(f, tag: str | None, size: int = 1 << 20):
    """The text of each outermost AudioSegment of an open file; then None, if the file has the tag. No more is held than
    `size` bytes and the segment they lie in."""
    head = f.read(size)
    decode, text, at, start, depth, tagged = _decoder(head), "", 0, None, 0, tag is None
    while True:
        old = max(0, len(text) - len(tag or ""))
        text += decode.decode(head, final=not head)
        tagged = tagged or text.find(tag, old) >= 0
        while m := _MARKS.search(text, at):
            if m[0][:2] == "<!":
                if not m[0].endswith(("-->", "]]>")) and head:
                    break
            elif m[1]:
                depth = max(0, depth - 1)
            elif not m[2]:
                depth += 1
                start = m.start() if depth == 1 else start
            at = m.end()
            if not m[0].startswith("<!") and depth == 0 and (start is not None or m[2]):
                yield text[m.start() if start is None else start : at]
                start = None
        if not head:
            break
        if m is None:  # a mark may be cut
            last = text.rfind("<", at)
            at = last if last >= 0 and ">" not in text[last:] else len(text)
        else:
            at = m.start()
        cut = at if start is None else start
        text, at, start = text[cut:], at - cut, None if start is None else 0
        head = f.read(size)
    if tagged:
        yield None


def read_mpeg7(spark: SparkSession, path: str, glob: str = "*.xml", strict: bool = True, dialect: str | None = None) -> DataFrame:
    """AudioSegment elements that have a descriptor, with ticks at the least common multiple of their file's rates.
    dialect: the prefix of the tags that count; without it any prefix does.
    Segments without a descriptor or of no length are left out; strict: a file without any is an error that names it, raised
    when the result is used. Each file is opened once, by one of the tasks that the files are dealt over."""
    tag = None if dialect is None else f"<{dialect}:AudioSegment"

    def run(frames):
        for pdf in frames:
            rows, held = [], 0
            for p in pdf["path"]:
                source = store.uri_of(p)
                rows.append((source, None, False))  # for files without a segment
                with store.opened(p) as f:
                    for x in _audio_segments(f, tag):
                        rows.append((source, x, x is None))
                        held += len(x or "") + 100
                        if held >= 1 << 22:
                            yield pd.DataFrame(rows, columns=["source", "x", "tagged"])
                            rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["source", "x", "tagged"])

    raw = store.files_below(spark, path, glob).mapInPandas(run, "source string, x string, tagged boolean")
    raw = raw.select("source", "tagged", F.col("x").isNull().alias("_mark"), F.from_xml("x", MPEG7, {"ignoreNamespace": "true"}).alias("x"))
    df = raw.select("source", "tagged", "_mark", F.get("x.AudioDescriptor", F.lit(0)).alias("d"), F.col("x.MediaTime").alias("m"))
    times = F.when(F.col("d").isNotNull(), fn.combine_time(fn.time_point("m.MediaTimePoint"), fn.duration("m.MediaDuration")))
    df = df.withColumn("t", times).withColumn("_ok", F.coalesce(F.col("t.end") > F.col("t.start"), F.lit(False)))
    df, file = df.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source"), Window.partitionBy("source")
    df = df.withColumns({"_r": F.collect_set(F.when(F.col("_ok"), F.col("t.rate"))).over(file), "_has": F.max("tagged").over(file), "_n": F.row_number().over(file.orderBy(F.desc("_mark")))})
    df = df.withColumn("common", F.aggregate("_r", F.lit(1).cast("long"), fn.lcm))
    bare = (F.col("_n") == 1) & ((F.size("_r") == 0) | ~F.col("_has"))
    missing = F.raise_error(F.concat(F.lit("no annotation in "), "source")).cast("boolean") if strict else F.lit(False)
    by = F.col("common") / F.col("t.rate")
    return df.where(F.when(F.col("_ok") & F.col("_has"), True).when(bare, missing).otherwise(False)).select(
        fn.file_stem("source").alias("rec_id"), (F.col("t.start") * by).cast("long").alias("start"), (F.col("t.end") * by).cast("long").alias("end"), F.col("common").alias("rate"),
        F.col("d.Speaker._id").alias("speaker"), F.col("d.Speaker._gender").alias("gender"), F.col("d.Speaker.GivenName").alias("name"), F.col("d._confidence").alias("confidence"), F.col("d.SpokenContent").alias("content"), "source",
    )


EAF = """
    TIME_ORDER struct<TIME_SLOT:array<struct<_TIME_SLOT_ID:string,_TIME_VALUE:bigint>>>,
    TIER array<struct<_TIER_ID:string,_ANNOTATOR:string,_PARTICIPANT:string,
        ANNOTATION:array<struct<ALIGNABLE_ANNOTATION:struct<_ANNOTATION_ID:string,_TIME_SLOT_REF1:string,_TIME_SLOT_REF2:string,ANNOTATION_VALUE:string>>>>>
"""


def read_eaf(spark: SparkSession, path: str, tiers: list | Column | None = None, glob: str = "*.eaf", strict: bool = True, observation=None) -> DataFrame:
    """Annotations of all tiers, of named ones (a missing name is an error), or of those a condition on `tier` allows. strict: a
    file without a tier, or whose chosen tiers are all empty, is an error. An Observation gets the number of annotations that
    don't last as `dropped`; they are left out."""
    raw = spark.read.format("xml").option("rowTag", "ANNOTATION_DOCUMENT").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").schema(EAF).load(path)
    slots = F.map_from_entries(F.transform("TIME_ORDER.TIME_SLOT", lambda s: F.struct(s["_TIME_SLOT_ID"], s["_TIME_VALUE"])))
    df = raw.select(F.col("_metadata.file_path").alias("source"), slots.alias("slots"), F.explode("TIER").alias("t"))
    df = df.withColumn("tier", F.col("t._TIER_ID"))
    if isinstance(tiers, list):
        have = {r[0] for r in df.where(F.col("tier").isin(tiers)).select("tier").distinct().collect()}
        if missing := sorted({*tiers} - have):
            raise ValueError(f"no such tier: {missing}")
        df = df.where(F.col("tier").isin(tiers))
    elif tiers is not None:
        df = df.where(tiers)
    if strict:
        empty = raw.select(F.col("_metadata.file_path").alias("source")).join(df.where(F.size("t.ANNOTATION") > 0).select("source"), "source", "left_anti").limit(3).collect()
        if empty:
            raise ValueError(f"no annotation in {[r[0] for r in empty]}")
    df = df.withColumn("a", F.explode("t.ANNOTATION")).select("*", F.col("a.ALIGNABLE_ANNOTATION").alias("x"))
    found = df.select(
        fn.file_stem("source").alias("rec_id"), F.col("slots")[F.col("x._TIME_SLOT_REF1")].alias("start"), F.col("slots")[F.col("x._TIME_SLOT_REF2")].alias("end"), F.lit(1000).cast("long").alias("rate"),
        "tier", F.col("t._ANNOTATOR").alias("annotator"), F.col("t._PARTICIPANT").alias("participant"), F.col("x.ANNOTATION_VALUE").alias("content"), "source",
    )
    return S.drop_empty(found, observation)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """All formats below a folder, each chosen by extension; columns that a format lacks are null."""
    parts = []
    for glob, read in (("*.eaf", read_eaf), ("*.xml", lambda s, p: read_mpeg7(s, p, strict=False)), ("*.txt", lambda s, p: read_transcripts(s, p, "*.txt"))):
        if list_files(spark, path, glob).limit(1).count():
            parts.append(read(spark, path))
    if not parts:
        raise ValueError(f"no annotations below {path}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def tier_rows(segments: DataFrame, tier: Column, label: str = "label") -> DataFrame:
    """rec_id, tier, start, end (ms), content of each flattened piece and label. tier: a struct (tier, annotator,
    participant, content) made of `label`, or a name. Two annotations of a tier in one place are an error."""
    pieces = S.flatten(S.number_segments(segments), label)
    rate = segments.groupBy("rec_id").agg(F.first("rate").alias("rate"))
    df = pieces.select("rec_id", "start", "end", F.explode("labels").alias("label")).join(rate, "rec_id")
    ms = lambda c: F.rint(F.col(c) * 1000 / F.col("rate")).cast("long")
    df = df.select("rec_id", tier.alias("_t"), ms("start").alias("start"), ms("end").alias("end"), F.col("label").cast("string").alias("content"))
    if isinstance(df.schema["_t"].dataType, T.StructType):
        own = {f: F.col(f"_t.{f}") for f in ("tier", "annotator", "participant", "content") if f in df.schema["_t"].dataType.names}
        df = df.withColumns(own).drop("_t")
    else:
        df = df.withColumnRenamed("_t", "tier")
    twice = F.count(F.lit(1)).over(Window.partitionBy("rec_id", "tier", "start", "end"))
    return df.withColumn("tier", F.when(twice > 1, F.raise_error(F.lit("two annotations of a tier in one place"))).otherwise(F.col("tier")))


def write_tiers(segments: DataFrame, path: str, tier: Column, label: str = "label", mode: str = "error") -> None:
    """Tiers as a table, a recording's rows together and in order; mode append adds to what is there. The number of files
    follows the size of the table and not the number of recordings."""
    tier_rows(segments, tier, label).repartition("rec_id").sortWithinPartitions("rec_id", "tier", "start").write.mode(mode).parquet(path)


def tier_documents(tiers: DataFrame, media: str | None = None) -> DataFrame:
    """rec_id and an ELAN document of each recording's tiers. An annotation's slots are numbered by its place."""
    esc = lambda c: F.replace(F.replace(F.replace(F.replace(F.col(c).cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    w = Window.partitionBy("rec_id").orderBy("tier", "start", "end")
    df = tiers.withColumn("k", F.row_number().over(w))
    slot = F.format_string('<TIME_SLOT TIME_SLOT_ID="ts%d" TIME_VALUE="%d"/><TIME_SLOT TIME_SLOT_ID="ts%d" TIME_VALUE="%d"/>', 2 * F.col("k") - 1, F.col("start").cast("long"), 2 * F.col("k"), F.col("end").cast("long"))
    note = F.format_string('<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a%d" TIME_SLOT_REF1="ts%d" TIME_SLOT_REF2="ts%d"><ANNOTATION_VALUE>%s</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>', "k", 2 * F.col("k") - 1, 2 * F.col("k"), esc("content"))
    text = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", c.alias("x")))), lambda x: x["x"]), "")
    told = [F.first(c, True).alias(c) for c in ("annotator", "participant") if c in tiers.columns]
    tier = df.groupBy("rec_id", "tier").agg(*told, F.min("k").alias("k"), text(slot).alias("slots"), text(note).alias("notes"))
    who = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f' {c.upper()}="'), esc(c), F.lit('"'))).otherwise("") for c in ("annotator", "participant") if c in tiers.columns]
    body = F.concat(F.lit('<TIER TIER_ID="'), esc("tier"), F.lit('"'), *who, F.lit(' LINGUISTIC_TYPE_REF="default-lt">'), "notes", F.lit("</TIER>"))
    docs = tier.groupBy("rec_id").agg(text(F.col("slots")).alias("slots"), text(body).alias("tiers"))
    head = f'<HEADER MEDIA_FILE="" TIME_UNITS="milliseconds">{f"<MEDIA_DESCRIPTOR MEDIA_URL={chr(34)}{media}{chr(34)}/>" if media else ""}</HEADER>'
    return docs.select("rec_id", F.concat(F.lit(f"<ANNOTATION_DOCUMENT>{head}<TIME_ORDER>"), "slots", F.lit("</TIME_ORDER>"), "tiers", F.lit("</ANNOTATION_DOCUMENT>")).alias("document"))


def write_eaf(tiers: DataFrame, path: str, media: str | None = None, mode: str = "error") -> None:
    """One ELAN file for each recording, rec_id=<rec_id>.eaf in some folder below path."""
    store.write_texts(tier_documents(tiers, media).select("rec_id", F.col("document").alias("value")), path, "eaf", mode)


def add_to_eaf(spark: SparkSession, path: str, tiers: DataFrame, out: str, glob: str = "*.eaf", rec_id: Column | None = None, media: str | None = None) -> None:
    """The ELAN documents below path with more tiers (rec_id, tier, start, end in ms, content, and perhaps annotator and
    participant), written below out. A tier that a document has already is an error; a recording without a document gets
    one. rec_id: the recording of a document, an expression of `source` (None: by the file's name)."""
    had = read_eaf(spark, path, glob=glob, strict=False)
    had = had.withColumn("rec_id", rec_id) if rec_id is not None else had
    told = ("annotator", "participant")
    both = had.select("rec_id", "tier", "start", "end", "content", *told, F.lit(0).alias("_new")).unionByName(tiers.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    own = F.collect_set("_new").over(Window.partitionBy("rec_id", "tier"))
    clash = F.raise_error(F.concat(F.lit("the document has this tier: "), "tier"))
    write_eaf(both.withColumn("tier", F.when(F.size(own) > 1, clash).otherwise(F.col("tier"))).drop("_new"), out, media)


def folder_id(source: str = "source") -> Column:
    """The recording of a file by write_texts(), or of one that was written into a folder of its own."""
    return F.regexp_extract(source, r"rec_id=([^/]+?)(?:/|\.[^./]*$)", 1)
