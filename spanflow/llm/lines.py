"""Removal of passages that repeat across documents, by hashing of units.

A text is cut into units: its lines, and these at the ends of their sentences, so that a passage set into another
line is still found. Units are normalised (letter case, blanks) and known by a 128-bit digest. A unit whose digest
occurs in a document of smaller doc_id, or earlier in its own document, is a repeat; the earliest stays. Repeats are
removed where they make up a whole line, which has a digest of its own and is a repeat of an earlier whole line of any
length, or where they stand in a run of neighbouring repeats of at least `min_words` words, so that short sentences inside
a line stay; with min_words=1 these go, too. Spans are given in code points of the original text.

Units miss a passage whose ends are glued to another text. So grams of GRAM words are compared as well: of every GRAM
neighbouring grams the one of the smallest hash is an anchor, whatever stands around them, so that any passage of
2 * GRAM - 1 words shares an anchor with its earlier copy. Around shared anchors that no removed run of units covers,
every gram is compared with those around the same anchors in the earliest document that holds them, and all that
occur in a document of smaller doc_id are removed: the passage up to its very ends.

Defined cases: a null text counts as empty and stays without units; rows with a null doc_id keep their text and take
nothing from others, but lose what they repeat within themselves; rows that share a doc_id share its rank, and take
nothing from each other; rows that repeat doc_id and text lose the same; doc_id must be an integer; an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, codes, discard, materialise, mix, span_hashes, spans

MIN_WORDS, GRAM = 25, 25
_BLANK = np.array([*range(9, 14), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)
_tables: dict[str, np.ndarray] = {}
KEY = ["doc_id", "row"]
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("words", T.IntegerType()), T.StructField("first_doc", T.LongType())])


def _lower(code: np.ndarray) -> np.ndarray:
    """Small letters for capital ones, where both are one code point below 65,536."""
    if "lower" not in _tables:
        small = [chr(x).lower() for x in range(1 << 16)]
        _tables["lower"] = np.array([ord(c) if len(c) == 1 else x for x, c in enumerate(small)], np.uint32)
    return np.where(code < 1 << 16, _tables["lower"][np.minimum(code, 0xFFFF)], code)


class Words(NamedTuple):
    """Words and units of some texts end to end: places are in their joined code points, texts begin at `ends`."""

    ends: np.ndarray  # where texts begin, and the end
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # number of each text's first word, and of all
    hash: np.ndarray
    other: np.ndarray  # a second hash, of other numbers for the letters
    unit: np.ndarray  # number of each unit's first word
    unit_start: np.ndarray
    unit_end: np.ndarray
    unit_doc: np.ndarray
    line: np.ndarray  # units that begin a line


def words_of(texts: list[str]) -> Words:
    """A unit ends at a word whose last sign is one of .!? and at a line's end. It holds the blanks after it, to the end of
    the line, and those before it on its own line; blank lines lie between units."""
    code, ends = codes(texts)
    inside = ~np.isin(code, _BLANK)
    start, end = spans(inside)
    border = np.unique(ends[1:-1])
    border = border[(border > 0) & (border < len(code))]
    border = border[inside[border] & inside[border - 1]]
    start, end = np.sort(np.concatenate((start, border))), np.sort(np.concatenate((end, border)))
    first = np.searchsorted(start, ends)
    n = len(start)
    lines = np.flatnonzero(code == 10)
    new, line = np.zeros(n, bool), np.zeros(n, bool)  # words that begin a unit, and a line
    new[first[:-1][first[:-1] < n]] = line[first[:-1][first[:-1] < n]] = True
    if n:
        stop = np.isin(code[end - 1], np.array([33, 46, 63], np.uint32))
        upto = np.searchsorted(lines, start)
        line[1:] |= upto[1:] > np.searchsorted(lines, end[:-1])
        new |= line
        new[1:] |= stop[:-1]
    unit = np.flatnonzero(new)
    doc = np.searchsorted(first, unit, "right") - 1
    last = np.append(unit[1:], n)[: len(unit)] - 1  # last word of each unit
    gap0 = np.where(unit == first[doc], ends[doc], end[np.maximum(unit - 1, 0)]) if n else np.zeros(0, np.int64)
    gap1 = np.where(last + 1 == first[doc + 1], ends[doc + 1], start[np.minimum(last + 1, n - 1)]) if n else np.zeros(0, np.int64)
    before = np.searchsorted(lines, start[unit]) - 1  # the last line end before it, and the first after it
    after = np.searchsorted(lines, end[last])
    padded = np.append(lines, [-1, len(code) + 1])
    unit_start = np.where((before >= 0) & (padded[before] >= gap0), padded[before] + 1, np.where(unit == first[doc], gap0, start[unit]))
    unit_end = np.where(padded[np.minimum(after, len(lines) + 1)] < gap1, padded[np.minimum(after, len(lines) + 1)] + 1, gap1)
    unit_end = np.where(after < len(lines), unit_end, gap1)
    small = _lower(code)
    other = mix(small.astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D))
    return Words(ends, start, end, first, span_hashes(small, start, end), span_hashes(other, start, end), unit, unit_start, unit_end, doc, line[unit])


def units(text: str) -> list[tuple[int, int, int]]:
    """(start, end, words) of the units of one text."""
    w = words_of([text])
    return list(zip(w.unit_start.tolist(), w.unit_end.tolist(), np.diff(np.append(w.unit, len(w.start)))[: len(w.unit)].tolist(), strict=True))


def anchors(hashes: np.ndarray) -> np.ndarray:
    """Places of the smallest hash of every GRAM neighbouring ones."""
    if len(hashes) < GRAM:
        return np.zeros(0, np.int64)
    return np.unique(np.lib.stride_tricks.sliding_window_view(hashes, GRAM).argmin(1) + np.arange(len(hashes) - GRAM + 1))


def _grams(w: Words, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of the grams that begin at each word of a text but the last GRAM - 1."""
    at = np.arange(max(0, int(w.first[i + 1] - w.first[i]) - GRAM + 1))
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return tuple(span_hashes(x[w.first[i] : w.first[i + 1]], at, at + GRAM) for x in (w.hash, w.other))


PARTS = "row bigint, doc_id bigint, at int, word int, words int, hi bigint, lo bigint, own boolean, whole boolean"
LINE = np.uint64(0xA24BAED4963EE407)  # tells the digests of lines from those of units


def unit_digests(docs: DataFrame, with_anchors: bool = True) -> DataFrame:
    """A row for each unit: at (its number), word (its first), words, digest, own (repeats an earlier unit of its row); the same
    for each line, of which `whole` is true, at its first unit; and for each anchor: at and word (the gram's first word), words (the text's, negative), digest."""

    def run(frames):
        for pdf in frames:
            texts, row = pdf["text"].tolist(), pdf["row"].to_numpy(np.int64)
            null = pdf["doc_id"].isna().to_numpy()
            ids = pdf["doc_id"].fillna(0).to_numpy(np.int64)
            for a, b in batches(texts):
                w = words_of(texts[a:b])
                begins = np.flatnonzero(w.line)
                number = np.arange(len(w.unit)) - np.searchsorted(w.unit_doc, w.unit_doc)
                until = lambda x: np.append(x[1:], len(w.start))[: len(x)]  # noqa: E731, B023
                word, last = np.concatenate((w.unit, w.unit[begins])), np.concatenate((until(w.unit), until(w.unit[begins])))
                doc, number = np.concatenate((w.unit_doc, w.unit_doc[begins])), np.concatenate((number, number[begins]))
                whole = np.arange(len(word)) >= len(w.unit)
                hi, lo = (np.where(whole, mix(h ^ LINE), h) for h in (span_hashes(w.hash, word, last), span_hashes(w.other, word, last)))
                # the first place of each digest in its text
                same = np.lexsort((np.arange(len(hi)), lo, hi, doc))
                own = np.zeros(len(hi), bool)
                own[same[1:]] = (doc[same[1:]] == doc[same[:-1]]) & (hi[same[1:]] == hi[same[:-1]]) & (lo[same[1:]] == lo[same[:-1]])
                parts = [(doc, number, word - w.first[doc], last - word, hi, lo, own, whole)]
                for i in range(b - a) if with_anchors else ():
                    if not null[a + i]:
                        h, other = _grams(w, i)
                        at = anchors(h)
                        if len(at):
                            parts.append((np.full(len(at), i), at, at, np.full(len(at), -(w.first[i + 1] - w.first[i])), h[at], other[at], *np.zeros((2, len(at)), bool)))
                doc, number, word, size, hi, lo, own, whole = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({"row": row[a + doc], "doc_id": pd.arrays.IntegerArray(ids[a + doc], null[a + doc]), "at": number, "word": word, "words": size, "hi": hi.view(np.int64), "lo": lo.view(np.int64), "own": own, "whole": whole})

    return docs.mapInPandas(run, PARTS)


def _rows(docs: DataFrame) -> DataFrame:
    """A row is known by its doc_id and a hash of its text: rows that repeat both lose the same."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer")
    return docs.select(F.xxhash64("text").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")


def _full(texts: DataFrame) -> DataFrame:
    return texts.withColumn("text", F.coalesce("text", F.lit("")))


def _repeats(made: DataFrame) -> DataFrame:
    """The rows of `made`, a written table that is deleted then, that repeat something, with first_doc: the digest's first document. Anchors of that document, too."""
    # a row a key and task goes through the shuffle, however often a unit repeats
    first = made.where(~F.col("own")).groupBy("hi", "lo").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc < last").select("hi", "lo", "first_doc")
    first = materialise(first)  # the join then has plain shuffles on both sides, so that Spark can split a unit that stands everywhere
    found = materialise(made.join(first, ["hi", "lo"], "left").where("own or first_doc < doc_id or (words < 0 and first_doc = doc_id)").drop("lo"))
    discard(made, first)
    return found


def _runs(found: DataFrame, min_words: int) -> DataFrame:
    """KEY, a, b (words), words, first_doc of the repeated lines, and of the runs of neighbouring repeated units that are long
    enough."""
    w = Window.partitionBy(*KEY).orderBy("at")
    numbered = found.where("words > 0 and not whole").withColumns({"_run": F.col("at") - F.dense_rank().over(w), "_again": F.coalesce(F.lag("at").over(w) == F.col("at"), F.lit(False))})
    runs = numbered.groupBy(*KEY, "_run").agg(F.min("word").alias("a"), F.max(F.col("word") + F.col("words")).alias("b"), F.sum(F.when(~F.col("_again"), F.col("words"))).cast("int").alias("words"), F.min("first_doc").alias("first_doc"))
    lines = found.where("whole").select(*KEY, F.col("word").alias("a"), (F.col("word") + F.col("words")).alias("b"), "words", "first_doc")
    return runs.where(F.col("words") >= min_words).drop("_run").unionByName(lines)


def _open_anchors(found: DataFrame, runs: DataFrame) -> DataFrame:
    """KEY, at: shared anchors with words around them that no run covers, and the same anchors in their first document."""
    shared = found.where("words < 0")
    around = shared.where("first_doc < doc_id").select(*KEY, F.greatest(F.lit(0), F.col("at") - (GRAM - 1)).alias("a"), F.least(F.col("at") + (2 * GRAM - 1), -F.col("words")).alias("b"), F.lit(1).alias("_kind"), "at", "hi")
    both = runs.select(*KEY, "a", "b", F.lit(0).alias("_kind"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("long").alias("hi")).unionByName(around)
    w = Window.partitionBy(*KEY).orderBy("a", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    asked = both.withColumn("_to", F.max(F.when(F.col("_kind") == 0, F.col("b"))).over(w)).where("_kind = 1 and (_to is null or _to < b)")
    asked = materialise(asked.select(*KEY, "at", "hi"))
    sources = shared.where("first_doc = doc_id").join(asked.select("hi").distinct(), "hi", "left_semi").select(*KEY, "at")
    return asked.select(*KEY, "at").unionByName(sources)


def _gram_rows(joined: DataFrame) -> DataFrame:
    """KEY, at, hash and other of all grams around the places."""

    def run(frames):
        for pdf in frames:
            texts = pdf["text"].tolist()
            for a, b in batches(texts):
                none = np.zeros(0, np.uint64)
                w, parts = words_of(texts[a:b]), [(np.zeros(0, np.int64), np.zeros(0, np.int64), none, none)]
                for i in range(b - a):
                    h, other = _grams(w, i)
                    near = (np.asarray(pdf["places"].iloc[a + i], np.int64)[:, None] + np.arange(1 - GRAM, GRAM)).ravel()
                    at = np.unique(near[(near >= 0) & (near < len(h))])
                    parts.append((np.full(len(at), a + i), at, h[at], other[at]))
                i, at, h, other = (np.concatenate(x) for x in zip(*parts, strict=True))
                yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(np.int64)[i], "row": pdf["row"].to_numpy(np.int64)[i], "at": at, "hash": h.view(np.int64), "other": other.view(np.int64)})

    return joined.where("places is not null").select("doc_id", "row", "text", "places").mapInPandas(run, "doc_id bigint, row bigint, at int, hash bigint, other bigint")


def _gram_runs(joined: DataFrame) -> DataFrame:
    """KEY, more: runs (a, b, first_doc) of grams that occur in a document of smaller doc_id."""
    every = materialise(_gram_rows(joined))
    first = materialise(every.groupBy("hash", "other").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last")).where("first_doc < last").select("hash", "other", "first_doc"))
    hits = every.join(first, ["hash", "other"]).where("first_doc < doc_id")
    w = Window.partitionBy(*KEY).orderBy("at")
    far = F.coalesce((F.col("at") > F.lag("at").over(w) + GRAM).cast("int"), F.lit(0))
    runs = hits.withColumn("_far", far).withColumn("_run", F.sum("_far").over(w)).groupBy(*KEY, "_run").agg(F.min("at").alias("a"), (F.max("at") + GRAM).alias("b"), F.min("first_doc").alias("first_doc"))
    return runs.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "first_doc")).alias("more"))


def _cut(text: str, runs: list, more: list) -> tuple[str, list]:
    """The text without the passages, and these as (start, end, words, first_doc); words is null where grams had a part."""
    w = words_of([text])
    found = []
    for r in runs:
        k = np.searchsorted(w.unit, [r["a"], r["b"] - 1], "right") - 1
        found.append((int(w.unit_start[k[0]]), int(w.unit_end[k[1]]), False, r["first_doc"]))
    found += [(int(w.start[r["a"]]), int(w.end[r["b"] - 1]), True, r["first_doc"]) for r in more]
    out: list[tuple] = []
    for s, e, glued, d in sorted(found, key=lambda x: x[:2]):
        if out and s <= out[-1][1]:
            had = out[-1]
            out[-1] = (had[0], max(had[1], e), had[2] or (glued and e > had[1]), min((x for x in (had[3], d) if x is not None), default=None))
        else:
            out.append((s, e, glued, d))
    many = lambda s, e: int(np.searchsorted(w.start, e) - np.searchsorted(w.start, s))
    out = [(s, e, None if glued else many(s, e), d) for s, e, glued, d in out]
    at, kept = 0, []
    for s, e, *_ in out:
        kept.append(text[at:s])
        at = e
    return "".join([*kept, text[at:]]), out


def _removed(joined: DataFrame) -> DataFrame:
    """doc_id, text without the removed spans, spans (empty if none), n_removed (code points). Rows without any passage don't go to Python."""

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))]))
    def cut(text: pd.Series, runs: pd.Series, more: pd.Series) -> pd.DataFrame:
        some = lambda x: [] if x is None else list(x)
        rows = [(None, []) if t is None else _cut(t, some(r), some(m)) for t, r, m in zip(text, runs, more, strict=True)]
        return pd.DataFrame({"text": [r[0] for r in rows], "spans": [[dict(zip(SPAN.names, x, strict=True)) for x in r[1]] for r in rows]})

    plain = joined.where("runs is null and more is null").select("doc_id", "text", F.array().cast(T.ArrayType(SPAN)).alias("spans"))
    done = joined.where("runs is not null or more is not null").withColumn("_x", cut("text", "runs", "more")).select("doc_id", "_x.text", "_x.spans")
    return plain.unionByName(done).withColumn("n_removed", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"])))


def _joined(docs: DataFrame, info: DataFrame) -> DataFrame:
    a, b = _rows(docs).alias("a"), info.alias("b")
    rest = [F.col(f"b.{c}") for c in info.columns if c not in KEY]
    return a.join(b, F.col("a.row").eqNullSafe(F.col("b.row")) & F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")), "left").select("a.doc_id", "a.row", "a.text", *rest)


def dedup_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every row of docs without the units that occur earlier: doc_id, text, spans, n_removed."""
    runs = _runs(_repeats(materialise(unit_digests(_full(_rows(docs)), False))), min_words)
    per_row = runs.groupBy(*KEY).agg(F.collect_list(F.struct("a", "b", "words", "first_doc")).alias("runs"))
    return _removed(materialise(_joined(docs, per_row)).withColumn("more", F.lit(None).cast("array<struct<a:int,b:int,first_doc:bigint>>")))


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """As dedup_passages, and without any passage of 2 * GRAM - 1 words or more that stands in an earlier document."""
    found = _repeats(materialise(unit_digests(_full(_rows(docs)))))
    runs = materialise(_runs(found, min_words))
    run = F.struct("a", "b", "words", "first_doc")
    info = runs.select(*KEY, run.alias("run"), F.lit(None).cast("int").alias("at")).unionByName(_open_anchors(found, runs).select(*KEY, F.lit(None).cast("struct<a:int,b:int,words:int,first_doc:bigint>").alias("run"), "at"))
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    info = info.groupBy(*KEY).agg(F.collect_list("run").alias("runs"), F.collect_set("at").alias("places")).withColumns({"runs": some("runs"), "places": some("places")})
    joined = materialise(_joined(docs, info))
    more = _gram_runs(joined)
    closed = joined.where("places is null").withColumn("more", F.lit(None).cast("array<struct<a:int,b:int,first_doc:bigint>>"))
    asked = joined.where("places is not null").join(more, KEY, "left")
    return _removed(closed.unionByName(asked).drop("places"))
