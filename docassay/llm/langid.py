"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the runs of 3 and 4 bytes of the lower-cased text, other than those with a gap between
words inside; gaps count as one boundary byte. A text's vector is the mean embedding of its subwords. Embeddings and
softmax are trained together by stochastic gradient descent in numpy, on a sample of at most ``SAMPLE_ROWS``
texts of any length: tasks count their subwords, of which a text has at most 2 ** ``BUCKET_BITS`` different ones, and the driver
collects the counts. A fifth of the sample is kept out of it: on that part a temperature
is fitted, and the least score at which the predictions above it keep ``PRECISION`` becomes the
rejection threshold. Since mean and softmax input are linear, tasks add up one
precomputed row of logits per subword.

Defined cases: a null text, or one without a letter, is ``und`` with score 0 and rejected; without
labelled rows so is everything; a null id is not held out and not learned from; an empty table
gives an empty result; an input column named like a result column is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import _TOKEN, buffers, lowered, map_text
from .sampling import features, own_labels

SAMPLE_ROWS = 3000
BUCKET_BITS, WIDTH, EPOCHS, BATCH, RATE, PRECISION = 16, 16, 6, 32, 60.0, 0.99
MOST_LEAST = 0.95  # no threshold above this, or rounding would decide
UNKNOWN = "und"


def stream(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with a boundary byte for each gap byte and around each text; where each text begins."""
    low = np.where(_TOKEN[data], lowered(data), 32).astype(np.uint8)
    n = len(off) - 1
    out = np.full(len(low) + n + 1, 32, np.uint8)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist())):
        out[a + i + 1 : b + i + 1] = low[a:b]
    return out, off + np.arange(n + 1)


def subwords(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all subwords of many texts, and the index of each text's first; one more at the end."""
    s, begin = stream(*buffers(column))
    size = len(s)
    gap = s == 32
    wide = s.astype(np.uint32)
    three = wide[:-2] | wide[1:-1] << 8 | wide[2:] << 16 if size > 2 else np.zeros(0, np.uint32)
    four = three[:-1] | wide[3:] << 24 if size > 3 else np.zeros(0, np.uint32)
    ok3 = ~gap[1:-1] if size > 2 else np.zeros(0, bool)
    ok4 = ~(gap[1:-2] | gap[2:-1]) if size > 3 else np.zeros(0, bool)
    at = np.concatenate([np.flatnonzero(ok3), np.flatnonzero(ok4)])
    key = np.concatenate([three[ok3] * np.uint32(2654435761), (four[ok4] ^ np.uint32(0xA5A5A5A5)) * np.uint32(2246822519)])
    order = np.argsort(np.searchsorted(begin, at, "right"), kind="stable")
    bucket = (key >> np.uint32(32 - BUCKET_BITS))[order]
    return bucket, np.searchsorted(np.sort(at), begin)


def logits(column: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the subwords' rows for each text, and their number; positions of 3- and 4-byte runs separately."""
    s, begin = stream(*buffers(column))
    total = np.zeros((len(begin) - 1, rows.shape[1]))
    number = np.zeros(len(begin) - 1)
    wide = s.astype(np.uint32)
    gap = s == 32
    for k in (3, 4):
        if len(s) < k:
            continue
        key = wide[: len(s) - k + 1].copy()
        ok = ~gap[1 : len(s) - k + 2]
        for j in range(1, k):
            key |= wide[j : len(s) - k + 1 + j] << np.uint32(8 * j)
            if 1 < j < k - 1:
                ok &= ~gap[j : len(s) - k + 1 + j]
        at = np.flatnonzero(ok)
        key = key[at] * np.uint32(2654435761) if k == 3 else (key[at] ^ np.uint32(0xA5A5A5A5)) * np.uint32(2246822519)
        first = np.searchsorted(at, begin)
        full = np.flatnonzero(np.diff(first))
        if len(full):
            total[full] += np.add.reduceat(rows[key >> np.uint32(32 - BUCKET_BITS)], first[full], axis=0)
            number += np.diff(first)
    return total, number


@dataclass
class Model:
    languages: list[str]
    rows: np.ndarray  # of each bucket: its embedding times the softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def probabilities(self, column: pa.Array) -> np.ndarray:
        total, number = logits(column, self.rows)
        return softmax((total / np.maximum(number, 1)[:, None] + self.bias) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Counts:
    """Of each text, its different subwords (bucket) and each one's share of all; text i has the entries first[i]:first[i + 1]."""

    bucket: np.ndarray
    share: np.ndarray
    first: np.ndarray

    def of(self, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets, shares and each text's first entry of some texts that have any."""
        size = self.first[texts + 1] - self.first[texts]
        at = np.repeat(self.first[texts] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return self.bucket[at].astype(np.int64), self.share[at], np.cumsum(size) - size

    def mean(self, texts: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The mean row of the subwords of each text; 0 without any."""
        out = np.zeros((len(texts), rows.shape[1]))
        full = np.flatnonzero(self.first[texts + 1] > self.first[texts])
        if len(full):
            bucket, share, starts = self.of(texts[full])
            out[full] = np.add.reduceat(rows[bucket] * share[:, None], starts, axis=0)
        return out


def subword_counts(column: pa.Array) -> dict:
    """Of each text: its different subwords and how often each occurs."""
    bucket, first = subwords(column)
    text = np.repeat(np.arange(len(column)), np.diff(first))
    pair, often = np.unique(text << BUCKET_BITS | bucket, return_counts=True)
    begin = np.searchsorted(pair >> BUCKET_BITS, np.arange(len(column) + 1)).astype(np.int32)
    listed = lambda values: pa.ListArray.from_arrays(begin, pa.array(values.astype(np.int32)))
    return {"bucket": listed(pair & ((1 << BUCKET_BITS) - 1)), "often": listed(often)}


def fit(own_counts: Counts, languages: list[str]) -> Model:
    names = sorted(set(languages))
    y = np.searchsorted(names, languages)
    rng = np.random.default_rng(4)
    order = rng.permutation(len(y))
    held, own = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(own):
        own = order
    embed = rng.normal(0, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH))
    weight, bias = np.zeros((WIDTH, len(names))), np.zeros(len(names))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        own = rng.permutation(own)
        for at in range(0, len(own), BATCH):
            pick = own[at : at + BATCH]
            pick = pick[own_counts.first[pick + 1] > own_counts.first[pick]]
            if not len(pick):
                continue
            ids, part, starts = own_counts.of(pick)
            part = part[:, None]
            mean = np.add.reduceat(embed[ids] * part, starts, axis=0)
            slope = softmax(mean @ weight + bias)
            slope[np.arange(len(pick)), y[pick]] -= 1
            slope /= len(pick)
            back = np.repeat(slope @ weight.T, np.diff(np.append(starts, len(ids))), axis=0)
            weight -= rate / 4 * mean.T @ slope
            bias -= 0.1 * slope.sum(0)
            np.subtract.at(embed, ids, rate * part * back)
    model = Model(names, (embed @ weight).astype(np.float32), bias)
    if len(held):
        calibrate(model, own_counts.mean(held, model.rows), y[held])
    return model


def calibrate(model: Model, z: np.ndarray, y: np.ndarray) -> None:
    """Temperature of the best held-out likelihood, then the least score that keeps PRECISION. z: mean rows of held-out texts."""
    best = None
    for temperature in np.geomspace(0.3, 20, 60):
        p = softmax((z + model.bias) / temperature)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()
        if best is None or loss < best[0] - 1e-12:
            best = (loss, float(temperature))
    model.temperature = best[1]
    p = softmax((z + model.bias) / model.temperature)
    score, right = p.max(1), p.argmax(1) == y
    order = np.argsort(-score, kind="stable")
    good = np.cumsum(right[order]) / np.arange(1, len(y) + 1) >= PRECISION
    model.least = min(float(score[order][np.flatnonzero(good)[-1]]), MOST_LEAST) if good.any() else MOST_LEAST


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    lists = T.ArrayType(T.IntegerType())
    rows = docs.select(doc_id, text, F.col(lang).cast("string").alias("y_"))
    found = features(own_labels(rows, "y_", SAMPLE_ROWS, doc_id, text), SAMPLE_ROWS, lambda: subword_counts, [T.StructField("bucket", lists), T.StructField("often", lists)])
    found = found.toArrow().sort_by([("key_", "ascending"), ("y", "ascending")]).combine_chunks()
    if not len(found):
        return None
    bucket, often = (found[c].combine_chunks() for c in ("bucket", "often"))
    first = np.append(0, np.cumsum(bucket.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
    often = often.flatten().to_numpy()
    total = np.append(0, np.cumsum(often))[first]
    share = (often / np.repeat(np.diff(total), np.diff(first))).astype(np.float32)
    return fit(Counts(bucket.flatten().to_numpy().astype(np.uint16), share, first), found["y"].to_pylist())


def has_letter(column: pa.Array) -> np.ndarray:
    data, off = buffers(column)
    total = np.append(0, np.cumsum((data | 32) - np.uint8(97) < 26))
    found = total[off[1:]] > total[off[:-1]]
    wide = np.append(0, np.cumsum(data >= 128))
    for i in np.flatnonzero(~found & (wide[off[1:]] > wide[off[:-1]])):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py())
    return found


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` without the text, with ``lang_pred``, ``score`` and ``rejected``."""

    def make():
        def compute(column: pa.Array) -> dict:
            known = has_letter(column) & (model is not None)
            p = model.probabilities(column) if model is not None else np.zeros((len(column), 1))
            name = np.array(model.languages if model is not None else [UNKNOWN], object)[p.argmax(1)]
            score = np.where(known, p.max(1), 0.0)
            least = model.least if model is not None else 1.0
            return {"lang_pred": pa.array(np.where(known, name, UNKNOWN), pa.string()), "score": score, "rejected": ~known | (score < least)}

        return compute

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return map_text(docs, text, make, fields)
