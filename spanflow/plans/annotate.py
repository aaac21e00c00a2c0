"""Scoring, a frame classifier, and annotation of recordings from end to end."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalar as fn
from ..operators import decode, evaluate
from ..operators import frames as R
from ..sources import audio, store


def score(frames: DataFrame, predict_fn, size: int, batch: int = 256, context: str = "context") -> DataFrame:
    """probs of each frame's context, `size` numbers in all, by a predictor: predict_fn() gives a function of a (n, size)
    array to (n, classes)."""
    run = predict_batch_udf(predict_fn, return_type=T.ArrayType(T.DoubleType()), batch_size=batch, input_tensor_shapes=[[size]])
    return frames.withColumn("_x", F.flatten(context)).withColumn("probs", run("_x")).drop("_x")


def fit_frame_classifier(frames: DataFrame, cls: str = "class", context: str = "context", iterations: int = 50):
    """Multinomial logistic regression on flattened contexts; transform with classify()."""
    ready = frames.select(array_to_vector(F.flatten(context)).alias("features"), F.col(cls).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", maxIter=iterations).fit(ready)


def classify(frames: DataFrame, model, context: str = "context") -> DataFrame:
    """probs by a fitted frame classifier."""
    scored = model.transform(frames.withColumn("features", array_to_vector(F.flatten(context))))
    return scored.withColumn("probs", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def predictor_of(weights: np.ndarray, bias: np.ndarray):
    """A predict_fn of a softmax over a linear map."""

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            z = x.reshape(len(x), -1) @ weights.T + bias
            p = np.exp(z - z.max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)

        return predict

    return make


def annotate(spark: SparkSession, path: str, predict_fn, init: list, trans: list, rate: int = 8000, win: int = 256, hop: int = 80, n_mels: int = 64, norm: int = 2000, context: int = 10, weights: DataFrame | None = None, merge=None) -> DataFrame:
    """rec_id, tier, start, end (ms), problem: features, rolling normalisation, contexts, scores, merging, smoothing, runs, tiers.

    predict_fn: one predictor or a list of them, merged with `weights` or `merge` (see merge_posteriors). A file that can't
    be read, or that has another rate, is one row that says its problem. Posteriors are stored on the way."""
    files = audio.sound_files(spark, path, strict=False)
    wrong = F.concat(F.lit("rate is "), F.col("rate").cast("string"))
    files = files.withColumn("problem", F.coalesce("problem", F.when((F.col("rate") != rate) & (F.col("samples") > 0), wrong)))
    failed = files.where("problem is not null").groupBy("rec_id").agg(F.min("problem").alias("problem"))  # by headers alone
    feats = audio.logmel(audio.samples_from(files.where("problem is null")), rate, win, hop, n_mels)
    normed = R.normalize_rolling(feats, norm, first="copy", column="feat", dims=n_mels).withColumn("feat", F.transform("feat", lambda x: F.coalesce(x, F.lit(0.0))))
    stacked, size = R.stack_context(normed, context, keys=("rec_id",)), (2 * context + 1) * n_mels
    many = predict_fn if isinstance(predict_fn, list) else [predict_fn]
    scored = [score(stacked, f, size).select("rec_id", "frame_idx", F.lit(k).alias("predictor"), "probs") for k, f in enumerate(many)]
    scored = scored[0] if len(many) == 1 else decode.merge_posteriors(reduce(DataFrame.unionByName, scored), weights, merge)
    kept = store.scratch(spark)  # smoothing reads the posteriors several times
    scored.select("rec_id", "frame_idx", "probs").write.parquet(kept)
    states = decode.viterbi(spark.read.schema("rec_id string, frame_idx bigint, probs array<double>").parquet(kept), init, trans)
    found = R.runs(states, "state")
    # the first output frame is the centre of the first full context
    tick = lambda c: F.rint((F.col(c) + (win // 2 + context * hop) / hop) * 1000 * hop / rate).cast("long")
    tiers = found.select("rec_id", fn.tier_name("key").alias("tier"), tick("start").alias("start"), tick("end").alias("end"))
    return tiers.unionByName(failed, allowMissingColumns=True)


def report(posteriors: DataFrame, truth: DataFrame, init: list, trans: list, nclasses: int = 3) -> DataFrame:
    """Confusions of raw and of smoothed predictions, for each recording and in total."""
    raw = posteriors.select("rec_id", "frame_idx", fn.argmax("probs").alias("raw"))
    smooth = decode.viterbi(posteriors, init, trans).select("rec_id", "frame_idx", F.col("state").cast("int").alias("smoothed"))
    both = evaluate.align(truth.select("rec_id", "frame_idx", "true"), raw.join(smooth, ["rec_id", "frame_idx"]))
    return evaluate.evaluate(both, variants=("raw", "smoothed"), nclasses=nclasses)
