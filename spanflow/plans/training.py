"""Fixed compositions of frame operators into training batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frames as R
from ..operators import sampling as B

#: name: (context, chunk normalisation, channel swap)
PIPELINES = {
    "framewise": (False, False, False),
    "framewise_normalized": (False, True, False),
    "context": (True, False, False),
    "context_normalized": (True, True, False),
    "stereo_context_normalized": (True, True, True),
}


def pipeline(frames: DataFrame, name: str, chunk: int = 16384, context: int = 10, ratios: dict | None = None, seed: int | None = None, steps: int = 1, std: bool = False, how: str = "dominant", prepare=None) -> DataFrame:
    """Batches of frames (rec_id, frame_idx, feat, active): class from the active speakers, chunks, then what the name says.

    prepare: a function of DataFrame to DataFrame that runs first."""
    with_context, normalized, swap = PIPELINES[name]
    df = prepare(frames) if prepare else frames
    df = R.with_swapped(df, ("active",)) if swap else df
    if swap:  # a swapped recording is one of its own
        df = df.withColumn("rec_id", F.when(F.col("swapped"), F.concat("rec_id", F.lit("~"))).otherwise(F.col("rec_id")))
    df = R.assign_chunks(df.withColumn("class", R.activity_class()), chunk)
    df = R.normalize_chunk(df, std) if normalized else df
    return B.training_batches(df, context if with_context else 0, ratios, seed, steps, how)
