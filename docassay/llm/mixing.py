"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier over hashed words, counted from labelled rows, gives each document its
posterior over domains. Every document then gets a nonnegative rate so that the expected tokens of each domain,
the sum of rate x tokens x posterior, match the targets. The rates solve a
least-squares problem by projected gradient from rate 1: each step is one aggregation over the documents that
gives the domains' totals, and one column expression that moves all rates and clips them at 0. The gradient is
scaled by the inverse second moments (domains x domains) of the documents whose rate is not 0. Should that stop helping, the
descent begins anew with those of all documents, with which a step of size 1 always descends, and with momentum.

There is no limit of steps: the descent ends when all totals are within ``CLOSE`` of the largest target, or, where no nonnegative rates
reach the targets, when ``WINDOW`` steps no longer bring it ``PROGRESS`` closer. Closeness is then measured in the scaled norm (a domain's gap
counts in units of how much its tokens spread over documents), not in the plain one. ``Fit`` says which it was, and ``mix`` warns.

The classifier is counted on labelled rows of at most ``SAMPLE_ROWS`` ids that a document has; its weights, the second
moments and the totals are all that reaches the driver, and their size depends on the numbers of buckets and domains only.

Defined cases: null and empty texts have no tokens, the prior as posterior and rate 1; a domain
without labelled rows is not learned and its share goes to the others; without any, rates are 1; repeated rows count as often as they
occur, but equal texts with equal labels are learned from once; an empty table gives an empty result; only the id and the result columns are returned.
"""

from __future__ import annotations

import itertools
import math
import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import cut
from .sampling import labelled

SAMPLE_ROWS, BUCKETS, SMOOTH = 5000, 1 << 13, 0.5
CUT_EVERY, CLOSE, WINDOW, PROGRESS = 6, 1e-6, 25, 0.1


def words(text: str | Column) -> Column:
    """Lower-cased runs of characters other than white space; one empty string for an empty text."""
    return F.split(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), "\\s+")


def bucket(word: str | Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def numbers(values: list[float]) -> Column:
    """A constant array of doubles, folded into one literal when the plan is optimised."""
    return F.split(F.lit(",".join(map(repr, map(float, values)))), ",").cast("array<double>")


def train(docs: DataFrame, labels: DataFrame, domain: Column, doc_id: str = "doc_id", text: str = "text") -> tuple[list[str], np.ndarray, np.ndarray]:
    """Domains, their log priors, and the log likelihood of each (domain, bucket) relative to the mean domain."""
    own = labels.select(doc_id, domain.cast("string").alias("domain_"))
    sample = labelled(docs, own, "domain_", SAMPLE_ROWS, doc_id, text)
    # A word counts once a document, so that long texts do not outvote the rest; bucket -1 stands for the document itself.
    held = F.transform(F.filter(words("t"), lambda w: w != ""), bucket)
    rows = sample.select(F.xxhash64("t").alias("key_"), "y", F.explode(F.concat(F.array(F.lit(-1)), F.array_distinct(held))).alias("b"))
    counts = rows.distinct().groupBy("y", "b").count().collect()
    names = sorted({r.y for r in counts})
    table, number = np.zeros((max(len(names), 1), BUCKETS)), np.ones(max(len(names), 1))
    for r in counts:
        if r.b < 0:
            number[names.index(r.y)] = r["count"]
        else:
            table[names.index(r.y), r.b] = r["count"]
    prior = np.log(number)
    rate = np.log((table + SMOOTH) / (table.sum(1, keepdims=True) + SMOOTH * BUCKETS))
    return names, prior - prior.max(), rate - rate.mean(0)


def posteriors(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and p_0, p_1, ...: each domain's posterior.

    The words' evidence is added up and divided by the root of their number: neighbouring words are
    not independent, and without it long texts would belong to one domain wholly.
    """
    names, prior, rate = model
    rows = docs.select(F.col(doc_id), F.monotonically_increasing_id().alias("row_"), words(text).alias("w"))
    rows = rows.select(doc_id, "row_", F.explode("w").alias("w"))
    full = F.col("w") != ""
    rows = rows.select(doc_id, "row_", full.alias("full_"), bucket("w").alias("b"))
    sums = [F.coalesce(F.sum(F.when(F.col("full_"), F.get(numbers(r), F.col("b")))), F.lit(0.0)).alias(f"s_{k}") for k, r in enumerate(rate)]
    found = rows.groupBy(doc_id, "row_").agg(F.count_if("full_").alias("n_tokens"), *sums)
    root = F.sqrt(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    found = found.select(doc_id, "n_tokens", *[(F.col(f"s_{k}") / root + float(p)).alias(f"l_{k}") for k, p in enumerate(prior)])
    top = F.greatest(*[f"l_{k}" for k in range(len(prior))], F.lit(-1e300))
    found = found.select(doc_id, "n_tokens", *[F.exp(F.col(f"l_{k}") - top).alias(f"e_{k}") for k in range(len(prior))])
    total = sum((F.col(f"e_{k}") for k in range(len(prior))), F.lit(0.0))
    return found.select(doc_id, "n_tokens", *[(F.col(f"e_{k}") / total).alias(f"p_{k}") for k in range(len(prior))])


@dataclass
class Fit:
    """rows: the given ones with ``rate``; totals: the domains' expected tokens at these rates; reached: whether these are the targets."""

    rows: DataFrame
    totals: list[float]
    reached: bool


def fit_rates(rows: DataFrame, targets: list[float]) -> Fit:
    """Rates of ``rows`` (n_tokens, p_0, ...) for the expected tokens ``targets`` of each domain. ``rows`` is read many times and should be cheap to read."""
    k = len(targets)
    a = [F.col("n_tokens").cast("double") * F.col(f"p_{i}") for i in range(k)]
    total = lambda v: F.coalesce(F.sum(v), F.lit(0.0))
    close = CLOSE * max(max(targets), 1e-300)
    rate, now, everywhere = F.col("rate"), [0.0] * k, None

    def lowered(at: Column, move: np.ndarray) -> Column:
        return F.greatest(F.lit(0.0), at - sum((a[i] * float(move[i]) for i in range(k)), F.lit(0.0)))

    best, stuck, step, own = math.inf, 0, 0, rows.withColumn("rate", F.lit(1.0))
    while stuck < 3:
        moved = F.when(rate > 0, 1.0).otherwise(0.0)
        r = own.agg(*[total(rate * a[i]).alias(f"t_{i}") for i in range(k)], *[total(moved * a[i] * a[j]).alias(f"m_{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
        now = [r[f"t_{i}"] for i in range(k)]
        second = np.array([[r[f"m_{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
        second += 1e-9 * max(np.trace(second) / k, 1e-300) * np.eye(k)
        everywhere = second if everywhere is None else everywhere
        gap = np.array(now) - targets
        if not np.trace(everywhere) > 1e-200 or np.abs(gap).max() <= close:
            return Fit(own, now, bool(np.abs(gap).max() <= close))
        size = float(gap @ np.linalg.solve(everywhere, gap))
        best, stuck = (size, 0) if size < 0.8 * best else (best, stuck + 1)
        step += 1
        own = own.withColumn("rate", lowered(rate, np.linalg.solve(second, gap)))
        own = cut(own) if step % CUT_EVERY == 0 else own
    # Accelerated: each step starts from a point beyond the rates, in the direction of the last change; it starts anew when the gap grows.
    own = rows.withColumns({"rate": F.lit(1.0), "ahead": F.lit(1.0)})
    now = point = np.array([float(x) for x in rows.agg(*[total(x) for x in a]).first()])
    weight, gaps = 1.0, [math.inf]
    for step in itertools.count(1):
        move = np.linalg.solve(everywhere, point - targets)
        after = (1 + math.sqrt(1 + 4 * weight * weight)) / 2
        own = own.withColumn("next", lowered(F.col("ahead"), move))
        own = own.withColumns({"ahead": F.col("next") + (F.col("next") - rate) * ((weight - 1) / after), "rate": F.col("next")}).drop("next")
        own = cut(own) if step % CUT_EVERY == 0 else own
        new = np.array([float(x) for x in own.agg(*[total(rate * x) for x in a]).first()])
        gap = new - targets
        point, now = new + (new - now) * ((weight - 1) / after), new
        gaps.append(math.sqrt(gap @ np.linalg.solve(everywhere, gap)))
        weight = after
        if gaps[-1] > gaps[-2]:
            own, point, weight = own.withColumn("ahead", rate), now, 1.0
        reached = bool(np.abs(gap).max() <= close)
        if reached or (step > WINDOW and min(gaps[-WINDOW:]) > (1 - PROGRESS) * min(gaps[:-WINDOW])):
            return Fit(own.drop("ahead"), now.tolist(), reached)


def mix(
    docs: DataFrame, labels: DataFrame, domain: Column, shares: dict[str, float], total: float | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, a posterior p_<domain> for each domain, and the document's rate.

    shares: the wanted share of each domain; domains not named get none. total: tokens of the mix; by default those of the documents.
    """
    model = train(docs, labels, domain, doc_id, text)
    names = model[0]
    rows = posteriors(docs, model, doc_id, text)
    if not any(shares.get(n) for n in names):
        return rows.select(doc_id, "n_tokens", *[F.lit(None).cast("double").alias(f"p_{n}") for n in shares], F.lit(1.0).alias("rate"))
    rows = cut(rows)
    if total is None:
        total = float(rows.agg(F.sum("n_tokens")).first()[0] or 0)
    weight = math.fsum(shares.get(n, 0.0) for n in names)
    found = fit_rates(rows, [total * shares.get(n, 0.0) / weight for n in names])
    if not found.reached:
        warnings.warn(f"no nonnegative rates give these shares; tokens of {names} at the rates found: {found.totals}", stacklevel=2)
    return found.rows.select(doc_id, "n_tokens", *[F.col(f"p_{i}").alias(f"p_{n}") for i, n in enumerate(names)], "rate")
