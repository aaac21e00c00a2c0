"""Audio catalogues, samples, and log-mel features."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import store

CATALOG = "path string, format string, rate int, channels int, seconds double, samples bigint, problem string"


def _wav_parts(raw: bytes, whole: int | None = None) -> tuple[int, int, int, int, int, int]:
    """(format, channels, rate, bits, first byte, bytes) of the data chunk; other chunks are skipped. A data chunk that says it
    is longer than the file (`whole` bytes) ends with the file. Format 1 is whole numbers, 3 floating point."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, fmt, number = 12, None, lambda x: int.from_bytes(x, "little")
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], number(raw[at + 4 : at + 8])
        if name == b"fmt ":
            f = raw[at + 8 : at + 8 + min(size, 40)]
            kind = number(f[24:26]) if number(f[0:2]) == 0xFFFE else number(f[0:2])
            fmt = kind, number(f[2:4]), number(f[4:8]), number(f[14:16])
            if kind not in (1, 3) or fmt[3] not in ((8, 16, 24, 32) if kind == 1 else (32, 64)) or not fmt[1] or not fmt[2]:
                raise ValueError(f"unknown WAV format: {fmt}")
        elif name == b"data":
            if fmt is None:
                raise ValueError("no format before the data")
            return (*fmt, at + 8, min(size, max(0, (len(raw) if whole is None else whole) - at - 8)))
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


def pcm(data: bytes, bits: int, channels: int, kind: int = 1) -> np.ndarray:
    """Samples in [-1, 1] by time and channel; a last incomplete sample is left out."""
    width = bits // 8 * channels
    data = data[: len(data) // width * width]
    if kind == 3:
        x = np.frombuffer(data, f"<f{bits // 8}").astype(float)
    elif bits == 8:
        x = np.frombuffer(data, np.uint8).astype(float) / 128 - 1
    elif bits == 24:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / float(1 << 23)
    else:
        x = np.frombuffer(data, f"<i{bits // 8}").astype(float) / (1 << (bits - 1))
    return x.reshape(-1, channels)


def _sphere(raw: bytes) -> tuple[int, int, int]:
    text = raw[:1024].decode("latin-1")
    field = lambda k: int(re.search(rf"^{k} -i (\d+)", text, re.M)[1])
    try:
        return field("channel_count"), field("sample_rate"), field("sample_count")
    except TypeError:
        raise ValueError("a header field is missing") from None


def catalog_of(files: DataFrame, format: str = "wav", strict: bool = True) -> DataFrame:
    """A catalogue row for each row of files (path, length, head: the file's first bytes)."""

    def run(frames):
        for pdf in frames:
            rows = []
            for p, length, head in zip(pdf["path"], pdf["length"], pdf["head"], strict=True):
                try:
                    if format == "wav":
                        _, channels, rate, bits, _, size = _wav_parts(head, int(length))
                        n = size // (bits // 8 * channels)
                    else:
                        channels, rate, n = _sphere(head)
                    rows.append((p, format, rate, channels, n / rate, n, None))
                except (ValueError, ZeroDivisionError) as e:
                    if strict:
                        raise
                    rows.append((p, format, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "format", "rate", "channels", "seconds", "samples", "problem"]).astype({"rate": "Int32", "channels": "Int32", "samples": "Int64"})

    found = files.select("path", "length", "head").mapInPandas(run, CATALOG)
    return found.withColumn("rec_id", F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1))


def _wav_head(f, whole: int) -> bytes:
    """The beginning of a WAV file and its chunks' heads up to the data, with the chunks in between left out: what
    _wav_parts() needs, however long a chunk is. Also the bytes left out."""
    head, skipped = f.read(12), 0
    while True:
        chunk = f.read(8)
        head += chunk
        if len(chunk) < 8 or chunk[:4] == b"data":
            return head, skipped
        size = int.from_bytes(chunk[4:], "little")
        size += size % 2
        if chunk[:4] == b"fmt ":
            head += f.read(min(size, 64))
            f.seek(max(0, size - 64), 1)
            skipped += max(0, size - 64)
        else:
            head = head[:-8]
            skipped += 8 + size
            f.seek(min(size, whole), 1)


def wav_catalog_of(files: DataFrame, strict: bool = True) -> DataFrame:
    """catalog_of() for rows (path, length), with the columns kind, bits, at and bytes of the samples: headers are read by
    seeking, so that what is read of a file doesn't depend on its length."""

    def run(frames):
        for pdf in frames:
            rows = []
            for p, length in zip(pdf["path"], pdf["length"], strict=True):
                try:
                    with store.opened(p) as f:
                        head, skipped = _wav_head(f, int(length))
                    kind, channels, rate, bits, at, size = _wav_parts(head, int(length) - skipped)
                    n = size // (bits // 8 * channels)
                    rows.append((p, "wav", rate, channels, n / rate, n, None, kind, bits, at + skipped, size))
                except ValueError as e:
                    if strict:
                        raise
                    rows.append((p, "wav", None, None, None, None, str(e), None, None, None, None))
            whole = ["rate", "channels", "samples", "kind", "bits", "at", "bytes"]
            yield pd.DataFrame(rows, columns=["path", "format", "rate", "channels", "seconds", "samples", "problem", "kind", "bits", "at", "bytes"]).astype(dict.fromkeys(whole, "Int64"))

    found = files.select("path", "length").mapInPandas(run, f"{CATALOG}, kind int, bits int, at bigint, bytes bigint")
    return found.withColumn("rec_id", F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1))


def audio_catalog(spark: SparkSession, path: str, format: str = "wav", strict: bool = True) -> DataFrame:
    """A row for each WAV or SPHERE file from its header; strict: a broken file is an error, else it is a row with a problem.
    Tasks get paths and lengths and read headers alone."""
    found = store.files_below(spark, path, f"*.{format}")
    if format == "wav":
        return wav_catalog_of(found, strict).drop("kind", "bits", "at", "bytes")

    def heads(frames):
        for pdf in frames:
            first = []
            for p in pdf["path"]:
                with store.opened(p) as f:
                    first.append(f.read(1024))
            yield pdf.assign(head=first)

    return catalog_of(found.mapInPandas(heads, "path string, length bigint, head binary"), format, strict)


def wav_header(content: str = "content"):
    """Struct (channels, rate, bits, samples) of a WAV file with a plain 44-byte header, in SQL alone."""
    number = lambda at, n: F.conv(F.hex(F.reverse(F.substring(F.col(content).cast("binary"), at + 1, n)) if n == 1 else F.concat(*(F.substring(content, at + k + 1, 1) for k in range(n - 1, -1, -1)))), 16, 10).cast("long")
    channels, bits = number(22, 2), number(34, 2)
    return F.struct(channels.alias("channels"), number(24, 4).alias("rate"), bits.alias("bits"), F.floor(number(40, 4) * 8 / bits / channels).alias("samples"))


def samples_of(files: DataFrame, mono: bool = True, block: int = 1 << 16, strict: bool = True) -> DataFrame:
    """rec_id, channel, block, rate, samples in [-1, 1] of the rows of files (path, content); mono: the mean of the channels, as
    channel 0. strict: a broken file is an error, else it is one row without samples that says its problem."""

    def run(frames):
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    kind, channels, rate, bits, at, size = _wav_parts(content)
                    x = pcm(content[at : at + size], bits, channels, kind)
                except ValueError as e:
                    if strict:
                        raise
                    yield pd.DataFrame({"path": [p], "channel": pd.array([None], "Int32"), "block": pd.array([None], "Int32"), "rate": pd.array([None], "Int32"), "samples": [None], "problem": [str(e)]})
                    continue
                x = x.mean(1, keepdims=True) if mono else x
                for c in range(x.shape[1]):
                    for k in range(0, len(x), block):
                        yield pd.DataFrame({"path": [p], "channel": [c], "block": [k // block], "rate": [rate], "samples": [x[k : k + block, c]], "problem": [None]})

    found = files.select("path", "content").mapInPandas(run, "path string, channel int, block int, rate int, samples array<double>, problem string")
    return found.withColumn("rec_id", F.regexp_extract("path", r"([^/.]+)\.[^/]*$", 1))


#: Samples that a task holds before it hands them on.
HELD = 1 << 18


def read_samples(spark: SparkSession, path: str, mono: bool = True, block: int = 1 << 16, strict: bool = True) -> DataFrame:
    """What samples_of() gives for the WAV files below path, each block read by itself from its place in the file, so that
    a long recording is dealt over tasks and none holds more than a block of it."""
    return samples_from(sound_files(spark, path, strict), mono, block)


def sound_files(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """wav_catalog_of() the WAV files below path."""
    return wav_catalog_of(store.files_below(spark, path, "*.wav"), strict)


def samples_from(files: DataFrame, mono: bool = True, block: int = 1 << 16) -> DataFrame:
    """read_samples() of rows of sound_files()."""
    width = F.floor(F.col("bits") / 8) * F.col("channels")
    last = F.floor((F.greatest(F.col("samples"), F.lit(1)) - 1) / block).cast("int")
    ranges = files.select("path", "rec_id", "rate", "channels", "kind", "bits", "problem", "at", width.alias("width"), "samples", F.explode(F.sequence(F.lit(0), F.coalesce(last, F.lit(0)))).alias("block"))
    ranges = ranges.withColumns({"at": F.col("at") + F.col("block").cast("long") * block * F.col("width"), "n": F.least(F.lit(block), F.col("samples") - F.col("block").cast("long") * block)})
    ranges = ranges.where("problem is not null or n > 0").drop("samples").repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "block").sortWithinPartitions("path", "block")

    def run(frames):
        names = ["path", "rec_id", "channel", "block", "rate", "samples", "problem"]
        table = lambda rows: pd.DataFrame(rows, columns=names).astype(dict.fromkeys(("channel", "block", "rate"), "Int32"))
        for pdf in frames:
            rows, held, path, f = [], 0, None, None
            for r in pdf.itertuples(index=False):
                if isinstance(r.problem, str):
                    rows.append((r.path, r.rec_id, None, None, None, None, r.problem))
                    continue
                if r.path != path:
                    if f is not None:
                        f.close()
                    path, f = r.path, store.opened(r.path)
                f.seek(int(r.at))
                x = pcm(f.read(int(r.n * r.width)), int(r.bits), int(r.channels), int(r.kind))
                x = x.mean(1, keepdims=True) if mono else x
                rows += [(r.path, r.rec_id, c, int(r.block), int(r.rate), x[:, c], None) for c in range(x.shape[1])]
                held += x.size
                if held >= HELD:  # a table for many short blocks, and no more than these at once
                    yield table(rows)
                    rows, held = [], 0
            if f is not None:
                f.close()
            if rows:
                yield table(rows)

    return ranges.mapInPandas(run, "path string, rec_id string, channel int, block int, rate int, samples array<double>, problem string")


def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    """Triangular filters of equal area: the scale is linear below 1 kHz and logarithmic above."""
    step, knee = 200 / 3, 1000 / (200 / 3)
    grow = np.log(6.4) / 27
    to_mel = lambda f: np.where(f < 1000, f / step, knee + np.log(np.maximum(f, 1) / 1000) / grow)
    to_hz = lambda m: np.where(m < knee, m * step, 1000 * np.exp(grow * (m - knee)))
    edge = to_hz(np.linspace(0, float(to_mel(np.array(rate / 2))), n_mels + 2))
    bins = np.arange(n_fft // 2 + 1) * rate / n_fft
    up = (bins[None, :] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    down = (edge[2:, None] - bins[None, :]) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edge[2:] - edge[:-2]))[:, None]


def logmel_frames(x: np.ndarray, bank: np.ndarray, win: int, hop: int) -> np.ndarray:
    """log10 of the mel power of each full frame, floored at 1e-8."""
    if len(x) < win:
        return np.zeros((0, len(bank)))
    return _logmel_rows(np.lib.stride_tricks.sliding_window_view(x, win)[::hop], bank)


def _logmel_rows(rows: np.ndarray, bank: np.ndarray) -> np.ndarray:
    win = rows.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(win) / win)
    power = np.abs(np.fft.rfft(rows * hann, axis=1)) ** 2
    return np.log10(np.maximum(1e-8, power @ bank.T))


#: Samples of a row that goes to Python, so that an Arrow batch of many rows stays small.
PART = 1 << 10


def logmel(samples: DataFrame, rate: int = 8000, win: int = 256, hop: int = 80, n_mels: int = 64, key: str = "rec_id", frames: int = 4096) -> DataFrame:
    """key, frame_idx, feat from rows (key, block, samples) with blocks of any lengths, also shorter than a window.

    Samples are dealt anew into stretches of `frames` frames and the samples that their last frames reach into, so that a
    recording is worked on by stretches and never as a whole. A task works on many short stretches at once."""
    over = Window.partitionBy(key).orderBy("block")
    size, span = F.size("samples").cast("long"), frames * hop
    placed = samples.where(F.size("samples") > 0).select(key, "samples", size.alias("_n"), (F.sum(size).over(over) - size).alias("_at"))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_at") - (span - hop + win - 1)) / span))
    dealt = placed.withColumn("_k", F.explode(F.sequence(first, F.floor((F.col("_at") + F.col("_n") - 1) / span))))
    lo = F.greatest(F.lit(0).cast("long"), F.col("_k") * span - F.col("_at"))
    hi = F.least(F.col("_n"), (F.col("_k") + 1) * span - hop + win - F.col("_at"))
    part = F.slice("samples", lo.cast("int") + 1, F.greatest(F.lit(0), (hi - lo).cast("int")))
    dealt = dealt.select(key, "_k", (F.col("_at") + lo).alias("_at"), part.alias("part")).where(F.size("part") > 0)
    bank = mel_bank(rate, win, n_mels)

    def features(pdf, first):
        """Features of the stretches that begin at the rows `first`."""
        bounds = np.concatenate(([0], np.cumsum([len(p) for p in pdf["part"]])))[np.append(first, len(pdf))]
        many = np.clip((np.diff(bounds) - win) // hop + 1, 0, frames)
        which = np.repeat(np.arange(len(first)), many)
        place = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)
        x, keys, number, step = np.concatenate(pdf["part"].tolist()), pdf["_key"].to_numpy()[first], pdf["_k"].to_numpy()[first], max(1, (1 << 20) // win)
        for i in range(0, len(which), step):
            w, j = which[i : i + step], place[i : i + step]
            feat = _logmel_rows(np.lib.stride_tricks.sliding_window_view(x, win)[bounds[w] + j * hop], bank)
            yield pd.DataFrame({"_key": keys[w], "frame_idx": number[w] * frames + j, "feat": list(feat)})

    def run(tables):
        held = None  # the rows of the last stretch, which may go on
        for pdf in tables:
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            code = pd.factorize(pdf["_key"], use_na_sentinel=False)[0]
            new = np.ones(len(pdf), bool)
            new[1:] = (code[1:] != code[:-1]) | (pdf["_k"].to_numpy()[1:] != pdf["_k"].to_numpy()[:-1])
            first = np.flatnonzero(new)
            held = pdf.iloc[first[-1] :]
            if len(first) > 1:
                yield from features(pdf.iloc[: first[-1]], first[:-1])
        if held is not None:
            yield from features(held, np.array([0]))

    kind = samples.schema[key].dataType
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("part") - 1) / PART).cast("int")), lambda i: F.struct((F.col("_at") + i * PART).alias("_at"), F.slice("part", i * PART + 1, PART).alias("part")))
    rows = dealt.select(F.col(key).cast("string").alias("_key"), "_k", F.inline(cut)).repartition("_key", "_k").sortWithinPartitions("_key", "_k", "_at")
    return rows.mapInPandas(run, "_key string, frame_idx bigint, feat array<double>").select(F.col("_key").cast(kind).alias(key), "frame_idx", "feat")
