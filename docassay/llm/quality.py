"""Quality by hierarchical empirical Bayes: a document's own evidence under the posteriors of its path and host.

A logistic classifier on the shape of a text (lengths, kinds of characters, repetition) gives each document the
log-odds of good quality. Grouped sums over all documents give each host and each path its mean;
the mean of a host is shrunk towards the global mean and that of a path towards its host's, by
the pseudo-counts that the method of moments finds from the spread between groups. The result adds the path
posterior's log-odds, less the global ones, to the document's own; for this, the document itself is taken out of the sums of its
path and host, so that no evidence counts twice (a path's only document has its host's posterior as prior).

The classifier is fitted on at most ``SAMPLE_ROWS`` labelled rows, whose features the tasks compute from whole texts; all
sums are over every row. Null labels are left out, and equal texts with equal labels count once.

Defined cases: null and empty texts get the evidence of an empty text; null hosts and null paths are groups
of their own; without labelled rows of both kinds every document's evidence is neutral; repeated
rows count as often as they occur; an empty table gives an empty result; only the named columns
and those of the result are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Tokens, buffers, map_text
from .cluster import cut
from .sampling import features, labelled

SAMPLE_ROWS = 6000
_KINDS = {
    "capital": range(65, 91), "digit": range(48, 58), "space": (32, 9), "line": (10,), "stop": b".?", "comma": b",;:", "bang": b"!",
    "bar": b"|", "sign": b"#$%&*@^~<>{}[]=+\\/_", "wide": range(128, 256),
}
_KIND = np.zeros((256, len(_KINDS)), np.float32)
for _i, _bytes in enumerate(_KINDS.values()):
    _KIND[list(_bytes), _i] = 1


def shape(column: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    data, off = buffers(column)
    tokens = Tokens(data, off)
    n = len(off) - 1
    size, words = np.diff(off), tokens.count
    each = np.maximum(size, 1)
    out = [np.log1p(size), np.log1p(words)]
    for i in range(_KIND.shape[1]):
        total = np.append(0, np.cumsum(_KIND[:, i].astype(bool)[data]))
        out.append((total[off[1:]] - total[off[:-1]]) / each)
    length = tokens.end - tokens.start
    some = np.maximum(words, 1)
    per = lambda x: np.diff(np.append(0, np.cumsum(x))[tokens.first]) / some
    document = tokens.document()
    again = np.zeros(len(length), bool)
    again[1:] = (tokens.hash[1:] == tokens.hash[:-1]) & (document[1:] == document[:-1])
    order = np.lexsort((tokens.hash, document))
    h, d = tokens.hash[order], document[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    distinct = np.bincount(d, weights=fresh, minlength=n)
    out += [per(length), per(length <= 3), per(length >= 12), per(again), distinct / some, np.log1p(distinct)]
    return np.stack(out, 1).astype(np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    base: float

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of good quality."""
        z = np.clip((x - self.mean) / self.scale, -5, 5)
        return np.clip(np.concatenate([np.ones((len(z), 1)), z, z * z], 1) @ self.weight, -12, 12)


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> Model:
    """Ridge logistic regression on the features and their squares, by Newton steps."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.clip((x - mean) / scale, -5, 5)
    z = np.concatenate([np.ones((len(z), 1)), z, z * z], 1)
    w = np.zeros(z.shape[1])
    lam = np.full(len(w), ridge)
    lam[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        curve = np.maximum(p * (1 - p), 1e-6)
        w = w + np.linalg.solve((z * curve[:, None]).T @ z + np.diag(lam), z.T @ (y - p) - lam * w)
    return Model(mean, scale, w, float(np.log(y.mean() / (1 - y.mean()))))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model | None:
    own = labels.select(doc_id, F.col(label).cast("int").alias(label))
    listed = lambda column: {"x": pa.array(list(shape(column)), pa.list_(pa.float64()))}
    sample = features(labelled(docs, own, label, SAMPLE_ROWS, doc_id, text), SAMPLE_ROWS, lambda: listed, [T.StructField("x", T.ArrayType(T.DoubleType()))])
    rows = sample.toArrow().sort_by([("key_", "ascending"), ("y", "ascending")])
    y = (rows["y"].to_numpy() > 0).astype(np.float64)
    if not len(y) or y.min() == y.max():
        return None
    return fit(np.array(rows["x"].to_pylist()), y)


def evidence(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``evidence``: the log-odds of good quality."""

    def make():
        def compute(column: pa.Array) -> dict:
            return {"evidence": model.log_odds(shape(column)) if model is not None else np.zeros(len(column))}

        return compute

    return map_text(docs, text, make, [T.StructField("evidence", T.DoubleType())])


def strength(groups: DataFrame, mean: Column) -> float:
    """Pseudo-count of the prior over group means, by the method of moments; ``mean`` is what they shrink to."""
    r = groups.agg(
        F.sum("n").alias("n"),
        F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.when(F.col("n") > 0, F.col("n") * (F.col("s") / F.col("n") - mean) ** 2)).alias("between"),
        F.sum(F.col("n").cast("double") ** 2).alias("nn"),
        F.count("*").alias("groups"),
    ).first()
    if not r.n or r.groups < 2 or r.n <= r.groups:
        return 1.0
    within = max(r.within / (r.n - r.groups), 1e-9)
    spread = (r.between - (r.groups - 1) * within) / max(r.n - r.nn / r.n, 1e-9)
    return float(min(max(within / max(spread, 1e-12), 1.0), 1e6))


def posteriors(scored: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host_, path_, host_posterior, path_posterior, their sums s and n) from rows with host_, path_ and p; the global mean; the strengths over hosts and paths."""
    paths = cut(scored.groupBy("host_", "path_").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("ss")))
    hosts = cut(paths.groupBy("host_").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss")))
    total = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = total.s / total.n if total.n else 0.5
    of_host = strength(hosts, F.lit(mean))
    hosts = hosts.select(F.col("host_").alias("h_"), F.col("s").alias("host_s"), F.col("n").alias("host_n"), shrunk("s", "n", of_host, F.lit(mean)).alias("host_posterior"))
    paths = cut(paths.join(hosts, F.col("host_") == F.col("h_")).drop("h_"))
    of_path = strength(paths, F.col("host_posterior"))
    return paths.withColumn("path_posterior", shrunk("s", "n", of_path, F.col("host_posterior"))).drop("ss"), mean, of_host, of_path


def shrunk(s: str | Column, n: str | Column, strength: float, mean: Column) -> Column:
    """A group's mean, from its sum and number, shrunk towards ``mean``."""
    s, n = (F.col(v) if isinstance(v, str) else v for v in (s, n))
    return (s + strength * mean) / (n + strength)


def grade(docs: DataFrame, model: Model | None, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, quality (0 to 1) and keep (at least even odds)."""
    rows = docs.select(
        F.col(doc_id).alias("id_"), F.col(text).alias("text_"), host.cast("string").alias("host"), path.cast("string").alias("path"),
        F.coalesce(host.cast("string"), F.lit("\0")).alias("host_"), F.coalesce(path.cast("string"), F.lit("\0")).alias("path_"),
    )
    scored = evidence(rows, model, "text_").withColumn("p", 1 / (1 + F.exp(-F.col("evidence"))))
    scored = cut(scored)
    groups, mean, of_host, of_path = posteriors(scored)
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    groups = groups.withColumnsRenamed({"host_": "h_", "path_": "p_"})
    joined = scored.join(groups, (F.col("host_") == F.col("h_")) & (F.col("path_") == F.col("p_")))
    own_host = shrunk(F.col("host_s") - F.col("p"), F.col("host_n") - 1, of_host, F.lit(mean))
    prior = shrunk(F.col("s") - F.col("p"), F.col("n") - 1, of_path, own_host)
    prior = F.least(F.greatest(prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    odds = F.col("evidence") + F.log(prior / (1 - prior)) - float(np.log(mean / (1 - mean)))
    quality = 1 / (1 + F.exp(-odds))
    return joined.select(F.col("id_").alias(doc_id), "host", "path", "evidence", "host_posterior", "path_posterior", quality.alias("quality"), (quality >= 0.5).alias("keep"))
