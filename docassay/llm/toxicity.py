"""Toxicity by cumulative-link ordinal regression over sparse token features.

P(grade <= j) = sigmoid(cut_j - w . x): all thresholds share the weights w. x holds log(1 + count)
of hashed tokens that are associated with a grade above 0 in the training sample: all those that pass at a
false discovery rate of ``DISCOVERY``, however many. A
document's result has its most probable grade, the expected severity (the mean grade), and whether P(grade > 0)
reaches the value that had the best F1 on rows held out in turn from selection and fit.

Labels above 1 are grades as they are: every different label of the sample is a grade, and thresholds lie between neighbouring ones, however many; severity is the mean label. Where labels only say toxic or not, ``grades`` ranks toxic rows by how
often they hold tokens that are indicative in the other folds, so that no row's grade comes from a selection that saw it.

Training reads at most ``SAMPLE_ROWS`` labelled rows, of any length: tasks count their tokens, grouped
sums over the sample give each token's evidence (at most 2 ** ``BITS`` sums), and the driver collects
the counts of the selected tokens only. Scoring reads every text whole.

Defined cases: null and empty texts have no features and get the base rates; a model without
labelled rows of both kinds gives grade 0 and severity 0; null labels are left out, and equal texts with equal labels count
once; an empty table gives an empty result; an input column named like
a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Tokens, beside, buffers, map_text
from .sampling import features, labelled

SAMPLE_ROWS, BITS, GRADES, DISCOVERY, FOLDS = 8000, 20, 4, 0.05, 5


@dataclass
class Sparse:
    """A matrix of few values other than 0, each with its row and column; ``@`` takes a vector."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    shape: tuple[int, int]

    def __len__(self) -> int:
        return self.shape[0]

    def __matmul__(self, vector: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.value * vector[self.column], self.shape[0])

    @property
    def T(self) -> Sparse:
        return Sparse(self.column, self.row, self.value, self.shape[::-1])

    def log1p(self) -> Sparse:
        return Sparse(self.row, self.column, np.log1p(self.value), self.shape)


@dataclass
class Model:
    """bucket: hashed token of each feature, ascending; weight: of each feature; cut: ascending thresholds.

    least: the P(grade > 0) from which a text counts as toxic. value: what each grade stands for, ascending from 0; None: its number.
    """

    bucket: np.ndarray
    weight: np.ndarray
    cut: np.ndarray
    least: float = 0.5
    value: np.ndarray | None = None

    @property
    def values(self) -> np.ndarray:
        return np.arange(len(self.cut) + 1) if self.value is None else self.value

    def above(self, x: np.ndarray) -> np.ndarray:
        """P(grade > j) of each row, for each threshold."""
        return 1 / (1 + np.exp(np.clip(self.cut[None, :] - (x @ self.weight)[:, None], -500, 500)))


def buckets(tokens: Tokens) -> np.ndarray:
    return (tokens.hash >> np.uint64(64 - BITS)).astype(np.int64)


def counts(tokens: Tokens, bucket: np.ndarray) -> Sparse:
    """Of each document, how often each feature occurs."""
    index = np.full(1 << BITS, -1, np.int32)
    index[bucket] = np.arange(len(bucket))
    feature = index[buckets(tokens)]
    at = np.flatnonzero(feature >= 0)
    n = len(tokens.first) - 1
    document = np.searchsorted(tokens.first, at, "right") - 1
    pair, often = np.unique(document * max(len(bucket), 1) + feature[at], return_counts=True)
    return Sparse(*np.divmod(pair, max(len(bucket), 1)), often.astype(np.float64), (n, len(bucket)))


def token_counts(column: pa.Array) -> dict:
    """Of each text: its different hashed tokens and how often each occurs."""
    tokens = Tokens(*buffers(column))
    pair, often = np.unique(tokens.document() * (1 << BITS) + buckets(tokens), return_counts=True)
    first = np.searchsorted(pair >> BITS, np.arange(len(column) + 1)).astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(first, pa.array(values.astype(np.int32)))
    return {"bucket": listed(pair & ((1 << BITS) - 1)), "often": listed(often)}


def indicative(n: np.ndarray, hit: np.ndarray, rate: float) -> np.ndarray:
    """Hashed tokens whose documents are toxic more often than the share ``rate`` of all documents is, ascending.

    n and hit: of each token, the documents and the toxic documents that hold it. Benjamini and Hochberg's step-up rule over the
    Chernoff bound of each token's binomial tail, which is exact
    for tokens that only toxic documents hold. The bar depends on the number of tokens and finds, not of rows.
    """
    seen = np.flatnonzero(n)
    n, hit = n[seen], hit[seen]
    part = hit / n
    with np.errstate(divide="ignore", invalid="ignore"):
        tail = -(hit * np.log(part / rate) + np.where(part < 1, (n - hit) * np.log((1 - part) / (1 - rate)), 0))
    tail[part <= rate] = 0
    order = np.argsort(tail, kind="stable")
    passed = np.flatnonzero(tail[order] <= np.log(DISCOVERY * np.arange(1, len(seen) + 1) / max(len(seen), 1)))
    return np.sort(seen[order[: passed[-1] + 1]]) if len(passed) else seen[:0]


def of_features(pairs: Sparse, bucket: np.ndarray) -> Sparse:
    """The columns ``bucket`` of ``pairs``, whose columns are hashed tokens."""
    index = np.full(1 << BITS, -1, np.int32)
    index[bucket] = np.arange(len(bucket))
    at = np.flatnonzero(index[pairs.column] >= 0)
    return Sparse(pairs.row[at], index[pairs.column[at]], pairs.value[at].astype(np.float64), (len(pairs), len(bucket)))


def rows_of(x: Sparse, use: np.ndarray) -> Sparse:
    """The rows in ``use``."""
    at = np.flatnonzero(use[x.row])
    return Sparse((np.cumsum(use) - 1)[x.row[at]], x.column[at], x.value[at], (int(use.sum()), x.shape[1]))


def grades(hits: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(grade of each row, what each grade stands for): the different labels, if any is above 1; else 0 for rows that are not toxic and 1 to GRADES - 1 by thirds of ``hits`` for the others."""
    if label.max(initial=0) > 1:
        value = np.unique(np.append(np.maximum(label, 0), 0))
        return np.searchsorted(value, np.maximum(label, 0)), value
    own = hits[(label > 0) & (hits > 0)]
    cuts = np.quantile(own, np.arange(1, GRADES - 1) / (GRADES - 1)) if len(own) else np.zeros(GRADES - 2)
    return np.where(label > 0, 1 + (hits[:, None] > cuts[None, :]).sum(1), 0), np.arange(GRADES)


def fit(x: np.ndarray, grade: np.ndarray, bucket: np.ndarray, ridge: float = 1e-4, rounds: int = 400, value: np.ndarray | None = None) -> Model:
    """Maximum likelihood by gradient steps with per-parameter scaling; cuts stay ordered as sums of positive steps."""
    k = (GRADES if value is None else len(value)) - 1
    level = np.clip([(grade > j).mean() for j in range(k)], 1e-4, 1 - 1e-4)
    start = np.maximum.accumulate(np.log((1 - level) / level) + np.arange(k) * 1e-2)
    par = np.concatenate([np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(par), np.zeros_like(par)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    back = x.T
    for t in range(1, rounds + 1):
        w, step = par[: x.shape[1]], np.exp(par[x.shape[1] + 1 :])
        cut = par[x.shape[1]] + np.append(0, np.cumsum(step))
        s = sig(cut[None, :] - (x @ w)[:, None])  # P(grade <= j)
        full = np.concatenate([np.zeros((len(x), 1)), s, np.ones((len(x), 1))], 1)
        slope = full * (1 - full)
        row = np.arange(len(x))
        p = np.maximum(full[row, grade + 1] - full[row, grade], 1e-12)
        g_cut = np.zeros((len(x), k + 2))
        g_cut[row, grade + 1] += slope[row, grade + 1] / p
        g_cut[row, grade] -= slope[row, grade] / p
        g_cut = g_cut[:, 1:-1]
        g_w = -(back @ g_cut.sum(1)) / len(x) - ridge * w
        g_c = g_cut.mean(0)
        tail = np.cumsum(g_c[::-1])[::-1]
        grad = np.concatenate([g_w, tail[:1], tail[1:] * step])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        par = par + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    cut = par[x.shape[1]] + np.append(0, np.cumsum(np.exp(par[x.shape[1] + 1 :])))
    return Model(bucket, par[: x.shape[1]], cut, value=value)


def best_threshold(p: np.ndarray, toxic: np.ndarray) -> float:
    """The threshold on p with the best F1 over the training rows, half-way to the next lower value."""
    order = np.argsort(-p, kind="stable")
    p, hit = p[order], np.cumsum(toxic[order])
    f1 = 2 * hit / (np.arange(1, len(p) + 1) + toxic.sum())
    f1[:-1][p[:-1] == p[1:]] = -1  # equal values are not parted
    i = int(np.argmax(f1))
    return float(p[i] + p[i + 1]) / 2 if i + 1 < len(p) else 0.0


def evidence(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(FOLDS, 2 ** BITS) each: of each fold and hashed token, the rows and the toxic rows that hold it."""
    rows = sample.select(F.explode("bucket").alias("b"), F.pmod("key_", F.lit(FOLDS)).alias("fold"), (F.col("y") > 0).cast("int").alias("toxic"))
    sums = [f(F.when(F.col("fold") == k, v).otherwise(0)).cast("int").alias(f"{name}{k}") for k in range(FOLDS) for name, f, v in (("n", F.sum, F.lit(1)), ("hit", F.sum, F.col("toxic")))]
    found = rows.groupBy("b").agg(*sums).toArrow()
    out = np.zeros((2, FOLDS, 1 << BITS), np.int32)
    for i, name in enumerate(("n", "hit")):
        for k in range(FOLDS):
            out[i, k, found["b"].to_numpy()] = found[f"{name}{k}"].to_numpy()
    return out[0], out[1]


def chosen_counts(sample: DataFrame, bucket: np.ndarray) -> pa.Table:
    """(key_, y, b, often) of the hashed tokens ``bucket``."""
    sent = sample.sparkSession.sparkContext.broadcast(bucket)  # at most 2 ** BITS numbers

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bucket")
            b, often = lists.flatten().to_numpy(), batch.column("often").flatten().to_numpy()
            row = np.repeat(np.arange(len(batch)), np.diff(lists.offsets.to_numpy()))
            at = np.flatnonzero(np.isin(b, sent.value))
            own = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([batch.column("key_").take(own), batch.column("y").take(own), pa.array(b[at]), pa.array(often[at])], ["key_", "y", "b", "often"])

    schema = T.StructType([sample.schema["key_"], sample.schema["y"], T.StructField("b", T.IntegerType()), T.StructField("often", T.IntegerType())])
    return sample.mapInArrow(pick, schema).toArrow()


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    lists = T.ArrayType(T.IntegerType())
    own = labels.select(doc_id, F.col(label).cast("int").alias(label))
    sample = features(labelled(docs, own, label, SAMPLE_ROWS, doc_id, text), SAMPLE_ROWS, lambda: token_counts, [T.StructField("bucket", lists), T.StructField("often", lists)])
    rows = sorted(zip(*(c.to_pylist() for c in sample.select("key_", "y").toArrow().columns)))
    key, y = np.array([k for k, _ in rows], np.int64), np.array([v for _, v in rows], np.int64)
    toxic = y > 0
    if not len(rows) or toxic.min() == toxic.max():
        return None
    return fit_sample(key, y, *evidence(sample), lambda bucket: chosen_counts(sample, bucket))


def fit_sample(key: np.ndarray, y: np.ndarray, n: np.ndarray, hit: np.ndarray, counts_of) -> Model:
    """The model of rows (key, y), in order, from the evidence of each fold; ``counts_of`` gives the counts of chosen tokens."""
    fold, toxic = key % FOLDS, y > 0
    parted = all(len(set(toxic[fold != k])) > 1 for k in range(FOLDS))
    every = indicative(n.sum(0), hit.sum(0), toxic.mean())
    without = [indicative(n.sum(0) - n[k], hit.sum(0) - hit[k], toxic[fold != k].mean()) if parted else every for k in range(FOLDS)]
    table = counts_of(np.unique(np.concatenate([every, *without])))
    place = {r: i for i, r in enumerate(zip(key.tolist(), y.tolist()))}
    row = np.array([place[r] for r in zip(table["key_"].to_pylist(), table["y"].to_pylist())], np.int64)
    pairs = Sparse(row, table["b"].to_numpy(), table["often"].to_numpy(), (len(key), 1 << BITS))
    hits = np.zeros(len(key))
    for k in range(FOLDS):
        hits[fold == k] = (of_features(pairs, without[k]) @ np.ones(len(without[k])))[fold == k]
    grade, value = grades(hits, y)
    own = of_features(pairs, every).log1p()
    model = fit(own, grade, every, value=value)
    p = model.above(own)[:, 0]
    if parted:
        for k in range(FOLDS):
            x, use = of_features(pairs, without[k]).log1p(), fold != k
            p[~use] = fit(rows_of(x, use), grade[use], without[k], value=value).above(x)[~use, 0]
    # The threshold lies above what a text without any feature has: its severity is the base rate's and says nothing about it.
    base = float(model.above(np.zeros((1, len(every))))[0, 0])
    model.least = max(best_threshold(p, toxic), base + 1e-9)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` with ``grade``, ``severity`` and ``toxic``."""

    def make():
        def compute(column: pa.Array) -> dict:
            if model is None:
                above = np.zeros((len(column), GRADES - 1))
            else:
                above = model.above(counts(Tokens(*buffers(column)), model.bucket).log1p())
            full = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            values = model.values if model else np.arange(GRADES)
            grade = values[np.argmax(full[:, :-1] - full[:, 1:], 1)].astype(np.int32)
            return {"grade": grade, "severity": above @ np.diff(values).astype(float), "toxic": above[:, 0] >= (model.least if model else 1)}

        return compute

    fields = [T.StructField("grade", T.IntegerType()), T.StructField("severity", T.DoubleType()), T.StructField("toxic", T.BooleanType())]
    return map_text(docs, text, make, fields, keep_text)


def clean(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The documents that are not toxic, with their own columns."""
    return beside(docs, ["grade", "severity", "toxic"], lambda d: score(d, model, text, keep_text=True).where("not toxic"))
