"""Word differences of texts, as a batch job over the rows that need one."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "array<struct<kind: string, text: string>>"


CELLS = 1 << 20  # a table of at most so many cells is filled at once; larger ones are halved


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The length of a longest common subsequence of x with each beginning of y, in one row."""
    row = np.zeros(len(y) + 1, np.int32)
    for word in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == word)))
    return row


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """The places (i, j) of a longest common subsequence that the rule of ``segments`` walks through.

    The walk goes back from the end: equal words are taken, else it moves along y if the subsequence stays as long, else along x. A
    table of every beginning is filled only for small parts. A larger part is halved over x where the walk crosses the half, so memory stays linear.
    """
    if not len(x) or not len(y):
        return []
    if len(x) * len(y) > CELLS and len(x) > 1:
        half = len(x) // 2
        j = crossing(x[half:], y, lengths(x[:half], y))
        return common(x[:half], y[:j]) + [(half + i, j + k) for i, k in common(x[half:], y[j:])]
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i, word in enumerate(x):
        best[i + 1, 1:] = np.maximum.accumulate(np.maximum(best[i, 1:], best[i, :-1] + (y == word)))
    i, j, out = len(x), len(y), []
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif best[i, j - 1] >= best[i - 1, j]:
            j -= 1
        else:
            i -= 1
    return out[::-1]


def crossing(x: np.ndarray, y: np.ndarray, above: np.ndarray) -> int:
    """Where the walk back over x and y leaves x, given the lengths ``above`` x: each cell of a row hands on where the walk from it ends."""
    row, end = above, np.arange(len(y) + 1)
    for word in x:
        new, to = np.zeros_like(row), np.zeros_like(end)
        equal = y == word
        new[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + equal))
        up = np.append(True, ~equal & (new[:-1] < row[1:]))  # the walk goes on in the row above
        source = np.where(np.append(False, equal), np.append(0, end[:-1]), end)
        # Else it goes along the row, to the nearest cell before that leaves it.
        leaves = up | np.append(False, equal)
        last = np.maximum.accumulate(np.where(leaves, np.arange(len(leaves)), 0))
        row, end = new, source[last]
    return int(end[-1])


def segments(canonical: str, extracted: str) -> list[tuple[str, str]]:
    """equal, missing and extra parts along a longest common subsequence of words, each with its trailing space.

    Where two paths are equally long, the extra word comes last before the common one, so that
    walking back takes it first.
    """
    a, b = re.findall(r"\S+\s*", canonical), re.findall(r"\S+\s*", extracted)
    if not a or not b:
        return [("extra", extracted)] * bool(b) or [("missing", canonical)] * bool(a)
    ids = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([ids[w] for w in a]), np.array([ids[w] for w in b])
    tail = 0  # equal words at the end are always taken
    while tail < min(len(a), len(b)) and x[len(a) - 1 - tail] == y[len(b) - 1 - tail]:
        tail += 1
    m, n = len(a) - tail, len(b) - tail
    pairs = common(x[:m], y[:n]) + [(m + k, n + k) for k in range(tail)]
    parts, i, j = [], 0, 0
    for p, q in [*pairs, (len(a), len(b))]:
        # Walking back, extra words go first: so in order the missing ones stand before them.
        parts += [("missing", "".join(a[i:p])), ("extra", "".join(b[j:q]))]
        if p < len(a):
            parts.append(("equal", a[p]))
        i, j = p + 1, q + 1
    out: list[tuple[str, str]] = []
    for kind, text in parts:
        if text:
            out[-1:] = [(kind, out[-1][1] + text)] if out and out[-1][0] == kind else [*out[-1:], (kind, text)]
    return out


PIECE = 1 << 18  # characters of texts whose segments are held at once: as objects they take up to some hundred times the room


def pieces(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in runs of rows whose texts have at most ``PIECE`` characters, one of them aside."""
    ends = (batch.a_.str.len() + batch.b_.str.len()).cumsum() // PIECE
    for _, piece in batch.groupby(ends, sort=False):
        yield piece


def diff(rows: DataFrame, canonical: str, extracted: str, key: str = "doc_id") -> DataFrame:
    """key, position, kind, text: the segments of each row; null texts are empty."""
    own = rows.select(key, F.coalesce(canonical, F.lit("")).alias("a_"), F.coalesce(extracted, F.lit("")).alias("b_"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in pieces(batch):
                found = [[{"kind": k, "text": t} for k, t in segments(a, b)] for a, b in zip(piece.a_, piece.b_)]
                yield pd.DataFrame({key: piece[key].to_numpy(), "segments": found})

    found = own.mapInPandas(run, f"{key} {own.schema[key].dataType.simpleString()}, segments {SCHEMA}")
    return found.select(key, F.posexplode("segments").alias("position", "s")).select(key, "position", "s.*")


def most_missed(segments_: DataFrame, limit: int = 20) -> DataFrame:
    """The words that are missing most often over all texts."""
    words = segments_.where("kind = 'missing'").select(F.explode(F.split(F.lower(F.trim("text")), r"\s+")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "word").limit(limit)
