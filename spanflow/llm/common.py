"""Helpers that the corpus operators share: shared storage, samples to learn from, text codes."""

from __future__ import annotations

import tempfile
import uuid
from collections import Counter
from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows in an Arrow batch, so that a batch of very long texts still fits a Python worker.
BATCH_ROWS = 400


def tune(spark: SparkSession) -> SparkSession:
    """Bounds the Arrow batches of the Python stages by rows and, where Spark knows it, by bytes; a finished query's shuffle
    files go at once, since every step that others build on is a written table."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Only a local session may do without: it gets a
    folder of its own, since its driver and executors are one process; on a cluster an unset folder is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"file:{tempfile.gettempdir()}/spanflow-{spark.sparkContext.applicationId}"


def materialise(df: DataFrame) -> DataFrame:
    """Writes a table into the shared folder and reads it back, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanflow-{uuid.uuid4().hex}"
    df.write.parquet(path)
    done = spark.read.schema(df.schema).parquet(path)
    done.scratch = path
    return done


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote, once all that was made of them is written, too."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def set_aside(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df with the columns of these names renamed, and a function that gives a later table df's own columns back."""
    taken, other = {*df.columns, *names}, {}
    for c in df.columns:
        if c in {*names}:
            other[c] = next(x for k in range(len(taken) + 1) if (x := f"{c}_{k}") not in taken)
            taken.add(other[c])
    return df.withColumnsRenamed(other), lambda done: done.select(*(F.col(other.get(c, c)).alias(c) for c in df.columns))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fold that no model learns from: crc32 of the id as text, modulo 5, is 0."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _luck(key: str = "doc_id") -> Column:
    """A number in [0, 1) that a hash of the id gives."""
    return F.xxhash64(F.col(key).cast("string")).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))


def _texts_of(docs: DataFrame, chosen: list, schema) -> list[tuple]:
    """(doc_id, label, text) of the chosen (doc_id, label), by a join whose broadcast side is as small as that list."""
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in chosen], schema).withColumnRenamed(schema[1].name, "_label")
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")
    return sorted((r["doc_id"], r["_label"], r["text"]) for r in found.select("doc_id", "_label", "text").collect())


def sample_texts(docs: DataFrame, labelled: DataFrame, label: str, rows: int) -> list[tuple]:
    """(doc_id, label, text) of at most `rows` rows of `labelled` (doc_id, label), the first in the order of a hash.

    Only ids are ranked; the texts of the chosen ones are then fetched."""
    keyed = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", label)
    return _texts_of(docs, keyed.orderBy(_luck(), "doc_id", label).limit(rows).collect(), keyed.schema)


def sample_each(docs: DataFrame, labelled: DataFrame, label: str, rows: int, max_labels: int) -> list[tuple]:
    """The same with at most `rows` rows of every label. More than `max_labels` labels are an error: none is left out.

    One pass counts the labels, a second ranks only rows whose hash is below a bound that about twice as many as
    wanted pass, so that no label's rows meet in one task; a label of which too few pass is ranked in full."""
    keyed = labelled.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).alias("_label"))
    counts = keyed.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).limit(max_labels + 1).collect()
    if len(counts) > max_labels:
        raise ValueError(f"{label} has more than {max_labels} values; raise the limit or group them")
    if not counts:
        return []
    spark = docs.sparkSession

    def ranked(bounds: list[tuple]) -> list:
        kind = keyed.schema["_label"].dataType.simpleString()
        bound = spark.createDataFrame(bounds, f"_label {kind}, _bound double")  # a row a label, max_labels at most
        order = Window.partitionBy("_label").orderBy("_luck", "doc_id")
        near = keyed.withColumn("_luck", _luck()).join(F.broadcast(bound), "_label").where("_luck < _bound")
        return near.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= rows).select("doc_id", "_label").collect()

    chosen = ranked([(r["_label"], (2 * rows + 40) / r["n"]) for r in counts])
    have = Counter(r["_label"] for r in chosen)
    if short := [(r["_label"], 2.0) for r in counts if have[r["_label"]] < min(rows, r["n"])]:
        again = {x for x, _ in short}
        chosen = [r for r in chosen if r["_label"] not in again] + ranked(short)
    return _texts_of(docs, chosen, keyed.schema)


def batches(texts: list[str], chars: int = 1 << 21):
    """(first, after) ranges of `texts` of about `chars` characters each; a longer text stands alone."""
    at = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > chars:
            yield at, i
            at, size = i, 0
        size += len(text)
    if at < len(texts):
        yield at, len(texts)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts end to end, and the offsets at which they start (one more at the end)."""
    ends = np.cumsum([0, *map(len, texts)])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), ends


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd multiplier and of its inverse, modulo 2 to the 64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _P), ("down", _P_INVERSE)):
            steps = np.full(max(n, 1 << 16), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finishes a 64-bit hash so that all its bits depend on all bits of the input."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def span_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of code[start:end] for many spans at once."""
    up, down = powers(len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum((code.astype(np.uint64) + np.uint64(1)) * up[: len(code)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
