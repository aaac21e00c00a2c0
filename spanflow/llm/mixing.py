"""Mixing of sources to target weights with soft membership.

A classifier that learns from a bounded sample of labelled rows gives every document a posterior over domains. Each
document gets a rate, the number of times it is expected to be used, so that the domains' expected token totals (rate
times tokens times posterior) match the targets: least squares, each domain weighted by its own size, solved by
projected gradient steps from rate 1 with momentum that starts anew whenever the squares grow. With these weights the
gradient's Lipschitz constant is 1, so the step is 1 and needs no search. A step needs only the domains' totals, one
aggregation over all documents; the rates are a column that is computed from the last few steps' residuals and written
to the shared folder every `KEEP` steps, and never gathered. Steps go on until every domain is within `close` of its
target (shares of all tokens) or the projected gradient vanishes, which is the least-squares optimum where no
nonnegative rates reach the targets. If neither happens within `max_steps`, that is an error.

Defined cases: a null text counts as empty and has no tokens; rows with a null or repeated doc_id are rated like
others (rounding to whole copies then falls alike on equal ids); domains without any tokens are left out of the fit;
without labelled rows every document belongs to the one domain `all`, whose target is all tokens and weights are not
looked at; a weight for a domain that no labelled row has is an error, a domain without a weight has weight 0; an
empty table gives an empty result; input columns named like the results are replaced in mix(), and kept as they are by
mix_rows().
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, materialise, sample_each, set_aside
from .quality import SubwordModel

KEEP = 32
MADE = ("n_tokens", "posteriors", "rate", "domain", "copies", "_state", "_now")


class NotConverged(RuntimeError):
    """The steps ran out before targets or optimum were reached."""


class Fit(NamedTuple):
    """Shares of all tokens by domain, in the order of `domains`; `gradient` is the projected gradient's norm."""

    domains: list
    natural: list[float]
    target: list[float]
    reached: list[float]
    gradient: float
    steps: int
    converged: bool


def train_domains(docs: DataFrame, labelled: DataFrame, label: str, rows: int = 200, max_domains: int = 1000) -> SubwordModel | None:
    """A classifier of words alone, from at most `rows` labelled rows a domain outside the held-out fold; None without any."""
    known = sample_each(docs, labelled.where(~held_out()), label, rows, max_domains)
    return SubwordModel.train(known, orders=()) if known else None


def memberships(docs: DataFrame, model: SubwordModel | None, columns: list[str] | None = None) -> DataFrame:
    """The given columns of docs (None: all), n_tokens (words) and posteriors (one a domain, in the model's order)."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in columns or docs.columns if c not in MADE]
    fields = [docs.schema[c] for c in kept]
    docs = docs.select(*dict.fromkeys([*kept, "text"]))

    def run(frames):
        for pdf in frames:
            texts = pdf["text"].fillna("").tolist()
            p = shipped.value.probabilities(texts) if shipped.value is not None else np.ones((len(texts), 1))
            yield pdf[kept].assign(n_tokens=np.array([len(x.split()) for x in texts], np.int64), posteriors=list(p))

    return docs.mapInPandas(run, T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))]))


def _pull(misses: Column) -> Column:
    """The gradient of a row's rate: the domains' weighted misses by its posteriors."""
    return F.aggregate(F.zip_with("posteriors", misses, lambda p, x: p * x), F.lit(0.0), lambda a, x: a + x)


def _numbers(x: np.ndarray) -> Column:
    return F.array(*(F.lit(float(v)) for v in x))


def _moved(steps: list[tuple[float, np.ndarray]], least: float) -> Column:
    """The state (rate, one before) after the given steps: each goes from the point `ahead` of the rate against the misses there."""
    if not steps:
        return F.col("_state")

    def step(s: Column, e: Column) -> Column:
        point = s["rate"] + e["ahead"] * (s["rate"] - s["last"])
        return F.struct(F.greatest(F.lit(least), point - _pull(e["misses"])).alias("rate"), s["rate"].alias("last"))

    return F.aggregate(F.array(*(F.struct(F.lit(float(a)).alias("ahead"), _numbers(m).alias("misses")) for a, m in steps)), F.col("_state"), step)


def fit_rates(members: DataFrame, weights: dict | None, domains: list, budget: float | None = None, least: float = 0.0, close: float = 1e-4, flat: float = 3e-5, max_steps: int = 400) -> tuple[DataFrame, Fit]:
    """members with the column rate, and the report. weights: target shares (None: square roots of the natural ones, scaled);
    budget: tokens wanted as a multiple of those there (None: a tenth more than what makes no domain lose, which leaves
    documents of several domains room); least: lower bound of the rates; flat: a projected gradient that counts as none."""
    k = range(len(domains))
    if weights and (unknown := sorted({*map(str, weights)} - {*map(str, domains)})):
        raise ValueError(f"weights for domains that don't exist: {unknown}")
    tokens = lambda r, i: F.sum(F.col("n_tokens") * r * F.col("posteriors")[i])
    first = members.agg(F.sum("n_tokens").alias("n"), *(tokens(F.lit(1.0), i).alias(f"t{i}") for i in k)).first()
    n = float(first["n"] or 0)
    if not n:
        return members.withColumn("rate", F.lit(max(1.0, least))), Fit(domains, [0.0] * len(domains), [0.0] * len(domains), [0.0] * len(domains), 0.0, 0, True)
    share = np.array([first[f"t{i}"] or 0.0 for i in k]) / n
    there = share > 0
    given = {str(d): w for d, w in weights.items()} if weights else None
    want = np.array([given.get(str(d), 0.0) for d in domains], float) if given else np.sqrt(share)
    want = np.where(there, want, 0)
    if not want.sum():
        raise ValueError("no domain with tokens has a weight")
    want /= want.sum()
    sought = there & (want > 0)
    scale = budget if budget is not None else 1.1 * float((share[sought] / want[sought]).max())
    target = want * scale
    enough = np.where(target > 0, np.minimum(close, 0.01 * target), close)  # a small target is met to a hundredth of itself

    rows = members.withColumn("_state", F.struct(F.lit(max(1.0, least)).alias("rate"), F.lit(max(1.0, least)).alias("last")))
    pending: list[tuple[float, np.ndarray]] = []
    power, best = 1.0, np.inf
    # totals are linear in the rates, so those of the point ahead follow from those of the last two rates
    now = last = share * max(1.0, least)
    gradient, steps = np.inf, 0
    while True:
        miss = np.where(there, (now - target) / np.maximum(share, 1e-12), 0)
        done = (np.abs(now - target) <= enough).all()
        if done or gradient <= flat or steps >= max_steps:
            fit = Fit(domains, share.tolist(), target.tolist(), now.tolist(), float(gradient), steps, bool(done or gradient <= flat))
            break
        squares = float((miss * (now - target)).sum())
        if squares > best:  # momentum went too far
            power = 1.0
        best = squares
        grown = (1 + np.sqrt(1 + 4 * power * power)) / 2
        ahead, power = (power - 1) / grown, grown
        at = now + ahead * (now - last)
        pending.append((ahead, np.where(there, (at - target) / np.maximum(share, 1e-12), 0)))
        steps += 1
        if len(pending) == KEEP:
            rows, pending = materialise(rows.withColumn("_state", _moved(pending, least))), []
        one = rows.withColumn("_now", _moved(pending, least)).select("n_tokens", "posteriors", F.col("_now.rate").alias("_r"), F.col("_now.last").alias("_l"))
        # how far a step without momentum would have moved the last rates: the projected gradient, weighted by tokens
        still = F.col("_l") - F.greatest(F.lit(least), F.col("_l") - _pull(_numbers(miss)))
        got = one.agg((F.sqrt(F.sum(F.col("n_tokens") * still * still) / n)).alias("g"), *(tokens(F.col("_r"), i).alias(f"t{i}") for i in k)).first()
        last, now, gradient = now, np.array([got[f"t{i}"] or 0.0 for i in k]) / n, got["g"]
    return rows.withColumn("_state", _moved(pending, least)).withColumn("rate", F.col("_state.rate")).drop("_state"), fit


def mix_report(docs: DataFrame, labelled: DataFrame, label: str, weights: dict | None = None, budget: float | None = 1.0, least: float = 0.0, columns: list[str] | None = None, seed: int = 3, close: float = 1e-4, max_steps: int = 400) -> tuple[DataFrame, Fit]:
    """mix() and the report of its fit, whether it converged or not."""
    model = train_domains(docs, labelled, label)
    domains = model.classes if model else ["all"]
    members = materialise(memberships(docs, model, columns))
    rated, fit = fit_rates(members, weights if model else None, domains, budget, least, close=close, max_steps=max_steps)
    luck = (F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(seed)).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))
    top = F.array_position("posteriors", F.array_max("posteriors")).cast("int")
    return rated.withColumn("domain", F.element_at(F.array(*(F.lit(str(d)) for d in domains)), top)).withColumn(
        "copies", (F.floor("rate") + (luck < F.col("rate") - F.floor("rate")).cast("long")).cast("int")
    ), fit


def mix(docs: DataFrame, labelled: DataFrame, label: str, weights: dict | None = None, budget: float | None = 1.0, least: float = 0.0, columns: list[str] | None = None, seed: int = 3, close: float = 1e-4, max_steps: int = 400) -> DataFrame:
    """The given columns of docs (None: all; doc_id is needed), n_tokens, posteriors, domain (the likeliest), rate, and copies: the rate rounded up or down by
    a hash of doc_id, so that totals of copies match totals of rates in expectation. A fit that doesn't converge is an error."""
    done, fit = mix_report(docs, labelled, label, weights, budget, least, columns, seed, close, max_steps)
    if not fit.converged:
        raise NotConverged(f"after {fit.steps} steps: {fit}")
    return done


def mix_rows(docs: DataFrame, labelled: DataFrame, label: str, **settings) -> DataFrame:
    """Each row of docs as often as its copies say, with its own columns and values, whatever their names."""
    renamed, own = set_aside(docs, MADE)
    mixed = mix(renamed, labelled, label, **settings).where("copies > 0")
    return own(mixed.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))))
