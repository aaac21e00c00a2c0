"""Stores of frames, results and priors as Parquet."""

from __future__ import annotations

import fnmatch
import re
import tempfile
import uuid

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder below the one that all executors share. Only a local session may do without that."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = f"file:{tempfile.gettempdir()}/spanflow-{spark.sparkContext.applicationId}"
    return f"{shared}/store-{uuid.uuid4().hex}"


def write_frames(frames: DataFrame, path: str, mode: str = "error") -> None:
    """Frames by split and group, a recording's frames together and in order."""
    frames.repartitionByRange("split", "group_id", "rec_id").sortWithinPartitions("split", "group_id", "rec_id", "frame_idx").write.mode(mode).partitionBy("split", "group_id").parquet(path)


def write_frame_table(frames: DataFrame, table: str, path: str, buckets: int, chunks: int, mode: str = "error") -> None:
    """Frames with chunk_id as a table below path: by ranges of `chunks` chunks (chunk_range), and in each range in buckets by
    recording and chunk, in order. A join with a batch plan then needs no shuffle of the frames, and a long recording lies in
    many buckets."""
    ranged = frames.withColumn("chunk_range", F.floor(F.col("chunk_id") / chunks).cast("int")).repartition(buckets, "rec_id", "chunk_id")
    ranged.write.mode(mode).option("path", path).partitionBy("chunk_range").bucketBy(buckets, "rec_id", "chunk_id").sortBy("rec_id", "frame_idx").saveAsTable(table)


def read_plan(plan: DataFrame, table: str, only_labels: bool = False) -> DataFrame:
    """The frames of a table by write_frame_table() that a plan (chunk_range, rec_id, chunk_id, ...) takes, with the plan's
    columns. Files of ranges that the plan doesn't name are not opened: a plan that is resumed late, made with first=1,
    reads few. The names of ranges go through the driver, and nothing else."""
    wanted = [r[0] for r in plan.select("chunk_range").distinct().collect()]
    frames = plan.sparkSession.table(table).where(F.col("chunk_range").isin(wanted))
    return (frames.drop("feat") if only_labels else frames).join(plan.drop("chunk_range"), ["rec_id", "chunk_id"])


def read_frames(spark: SparkSession, path: str, only_labels: bool = False) -> DataFrame:
    """The stored frames; only_labels: the features are never read."""
    df = spark.read.parquet(path)
    return df.drop("feat") if only_labels else df


def _files_of(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and a function that makes paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), make


def _committed(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches that count, a log entry each."""
    fs, make = _files_of(spark, path)
    if not fs.exists(make(f"{path}/log")) or not fs.listStatus(make(f"{path}/log")):
        return []
    return [r["value"] for r in spark.read.text(f"{path}/log").collect()]


def _commit(spark: SparkSession, path: str, number: int, batch: str) -> bool:
    """Makes a batch the log's entry of this number; false if another has it. The entry is written in full under a hidden
    name first; then one call of the file system, which never replaces a file, gives it its number."""
    fs, make = _files_of(spark, path)
    entry, staged = make(f"{path}/log/{number:012d}"), make(f"{path}/log/.{batch}")
    fs.mkdirs(make(f"{path}/log"))
    out = fs.create(staged, True)
    out.write(bytearray(batch.encode()))
    out.close()
    if not fs.getUri().toString().startswith("file"):
        return fs.rename(staged, entry)
    jvm = spark._jvm
    local = lambda p: jvm.java.io.File(fs.makeQualified(p).toUri()).toPath()
    try:  # a local rename does replace a file, a link doesn't
        jvm.java.nio.file.Files.createLink(local(entry), local(staged))
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception):
            raise
        return False
    finally:
        fs.delete(staged, False)


def _unknown(df: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the other table doesn't have; null is a key like others."""
    a, b = df.alias("a"), known.select(*keys).alias("b")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    return a.join(b, on, "left_anti")


def append_results(df: DataFrame, path: str, keys: list[str]) -> int:
    """Adds the rows whose keys the store doesn't have yet, and tells how many. What is there stays as it is; of rows with
    equal keys the smallest in order of the other columns is added.

    A batch is written to a folder of its own and counts once it has an entry in the log. A writer that finds the next
    number taken leaves out the keys of the batches that came in between and tries again, so that each key is stored
    once, however many write at a time; what a killed writer leaves has no entry and is never read."""
    spark, rest = df.sparkSession, [c for c in df.columns if c not in keys]
    if rest:
        one = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_rest"))
        new = one.select(*(F.col(c) if c in keys else F.col("_rest")[c].alias(c) for c in df.columns))
    else:
        new = df.distinct()
    done: list[str] = []
    batch = None
    while True:
        now = _committed(spark, path)
        late = [b for b in now if b not in done]
        if batch is None or late:
            new = _unknown(new, _batches(spark, path, late), keys) if late else new
            batch, done = uuid.uuid4().hex, now
            new.write.parquet(f"{path}/data/{batch}")
            new = spark.read.schema(df.schema).parquet(f"{path}/data/{batch}")
        if _commit(spark, path, len(done) + 1, batch):
            return new.count()


def _batches(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    return spark.read.parquet(*(f"{path}/data/{b}" for b in names))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """All rows that append_results() has stored."""
    if not (names := _committed(spark, path)):
        raise FileNotFoundError(f"no results in {path}")
    return _batches(spark, path, names)


def _system(folder: str):
    """The file system of a folder for use in a task, and the folder's path there."""
    from pyarrow import fs

    if folder.startswith("file:"):  # as it stands: Hadoop's names aren't escaped
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def opened(path: str):
    """A file that can be sought in, whatever file system its path names."""
    if path.startswith("file:"):
        return open("/" + path[5:].lstrip("/"), "rb")
    system, at = _system(path)
    return system.open_input_file(at)


def uri_of(path: str) -> str:
    """A path as Spark's readers give it in _metadata.file_path."""
    return _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", path)


_ESCAPED = re.compile(r"""[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]""")


def _alternatives(glob: str) -> list[str]:
    """A glob without its braces, once for each choice."""
    m = re.search(r"\{([^{}]*)\}", glob)
    return [x for one in m[1].split(",") for x in _alternatives(glob[: m.start()] + one + glob[m.end() :])] if m else [glob]


def files_below(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """path and length of the files below a path, by name and without hidden ones, as of Spark's readers. Tasks list: one the
    path itself, others what is in its folders, so that no file costs the driver or a task of its own anything; contents are
    not read. The rows are dealt by path over the shuffle partitions, which Spark doesn't merge, small as they are."""
    fs, make = _files_of(spark, path)
    found = fs.globStatus(make(path))
    roots = [(fs.makeQualified(f.getPath()).toString(), None if f.isDirectory() else f.getLen()) for f in found or []]
    if not roots:
        raise FileNotFoundError(path)
    fits = re.compile("|".join(fnmatch.translate(g) for g in _alternatives(glob.replace("[^", "[!"))))
    hidden = lambda name: name[:1] == "." or (name[:1] == "_" and "=" not in name) or name.endswith("._COPYING_")

    def listing(deep: bool):
        def run(frames):
            from pyarrow.fs import FileSelector, FileType

            for pdf in frames:
                rows, folders = [], []
                for p, n in zip(pdf["path"], pdf["length"], strict=True):
                    folders += [p] if pd.isna(n) else []
                    rows += [] if pd.isna(n) else [(p, int(n))]
                while folders:
                    system, at = _system(folder := folders.pop())
                    for f in system.get_file_info(FileSelector(at)):
                        if hidden(f.base_name):
                            continue
                        below = f"{folder}/{f.base_name}"
                        if f.type == FileType.Directory:
                            (folders if deep else rows).append(below if deep else (below, None))
                        elif fits.match(f.base_name):
                            rows.append((below, f.size))
                    if len(rows) >= 1 << 16:
                        yield pd.DataFrame(rows, columns=["path", "length"]).astype({"length": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "length"]).astype({"path": object, "length": "Int64"})

        return run

    schema, n = "path string, length bigint", int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = [r for r in roots if r[1] is None or fits.match(r[0].rsplit("/", 1)[-1])]
    top = spark.createDataFrame(files, schema).coalesce(1).mapInPandas(listing(False), schema)
    return top.repartition(n, "path").mapInPandas(listing(True), schema).repartition(n, "path")


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes each row (name, content) as a file below a folder that all executors share, and tells how many. A task's files
    lie in a folder of its own, so that many tasks can list them."""
    run_id = uuid.uuid4().hex

    def run(frames):
        system, at = _system(folder)
        at = f"{at}/part-{TaskContext.get().partitionId():05d}-{run_id}"
        system.create_dir(at)
        for pdf in frames:
            for name, content in zip(pdf["name"], pdf["content"], strict=True):
                with system.open_output_stream(f"{at}/{name}") as f:
                    f.write(content)
            yield pdf[["name"]]

    return rows.select("name", F.col("content").cast("binary").alias("content")).mapInPandas(run, "name string").count()


_UNSAFE = re.compile(r"""[\x00-\x1f"#%'*/:=?\\\x7f{}\[\]^]""")


def write_texts(lines: DataFrame, folder: str, extension: str = "txt", mode: str = "error") -> int:
    """A text file for each rec_id with its rows (value) as lines, by the name rec_id=<rec_id>.<extension>, and how many there
    are. A task writes its files one after the other into a folder of its own, line by line and each under a hidden name
    first, so that folders follow the tasks and no commit goes through all files. mode: as of Spark's writers."""
    spark = lines.sparkSession
    fs, make = _files_of(spark, folder)
    if fs.exists(make(folder)):
        if mode in ("error", "errorifexists"):
            raise FileExistsError(folder)
        if mode == "ignore":
            return 0
        if mode == "overwrite":
            fs.delete(make(folder), True)
    root, run_id = fs.makeQualified(make(folder)).toString(), uuid.uuid4().hex

    def run(frames):
        system, at = _system(root)
        at = f"{at}/part-{TaskContext.get().partitionId():05d}-{run_id}"
        now, out, done = None, None, 0

        def close():
            out.close()
            system.move(f"{at}/.{now}.{extension}", f"{at}/{now}.{extension}")

        for pdf in frames:
            for rec, value in zip(pdf["rec_id"].tolist(), pdf["value"].tolist(), strict=True):
                name = "rec_id=" + (_UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", rec) if rec else "__HIVE_DEFAULT_PARTITION__")
                if name != now:
                    if out is None:
                        system.create_dir(at)
                    else:
                        close()
                    now, out, done = name, system.open_output_stream(f"{at}/.{name}.{extension}"), done + 1
                out.write(((value or "") + "\n").encode())
        if out is not None:
            close()
        yield pd.DataFrame({"files": [done]})

    rows = lines.select(F.coalesce(F.col("rec_id").cast("string"), F.lit("")).alias("rec_id"), "value")
    # by number, so that Spark doesn't merge the parts: what a file costs doesn't follow its bytes
    made = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "rec_id").sortWithinPartitions("rec_id").mapInPandas(run, "files bigint")
    return made.agg(F.sum("files")).first()[0] or 0


def write_priors(states: DataFrame, moves: DataFrame, path: str, split: str) -> None:
    """Both tables of raw counts for one split, in place of an earlier one."""
    for name, table in (("states", states), ("moves", moves)):
        table.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}/split={split}")


def read_priors(spark: SparkSession, path: str, splits: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    got = [spark.read.parquet(f"{path}/{k}") for k in ("states", "moves")]
    return tuple(df.where(F.col("split").isin(splits)) if splits else df for df in got)


def write_splits(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).partitionBy("split", "group_id").parquet(path)
