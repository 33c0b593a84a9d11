"""Vectorised text handling inside Arrow tasks.

Spark partitions the rows; these helpers turn one bounded slice of a record batch into a byte
buffer plus offsets so that numpy can tokenise and hash many documents at once. A slice holds at
most ``SLICE_BYTES`` of text, or a single document if that is longer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE_BYTES = 1 << 20
BITMAP = 1 << 27  # bits: 16 MB at the driver and in each executor
_MULT = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_powers: dict[str, np.ndarray] = {}

#: Token bytes: ASCII letters and digits, and every byte of a non-ASCII character.
_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and len + 1 offsets; a null is an empty text."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of at most ``most`` text bytes each, or of one row."""
    _, off = buffers(batch.column(column))
    n, at = len(off) - 1, 0
    while at < n:
        end = int(np.searchsorted(off, off[at] + most, "right")) - 1
        end = min(max(end, at + 1), n)
        yield batch.slice(at, end - at)
        at = end


def pieces(texts: list[str], most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a list of texts, of at most ``most`` bytes each, or of one text."""
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["t"])
    for part in slices(batch, "t", most):
        yield part.column("t")


def map_text(
    df: DataFrame,
    text: str,
    make: Callable[[], Callable[[pa.Array], dict[str, pa.Array | np.ndarray]]],
    fields: list[T.StructField],
    keep_text: bool = False,
) -> DataFrame:
    """``df``, without ``text`` unless it is kept, with ``fields`` computed per row by the function that ``make()`` returns.

    A column of ``df`` that is named like one of ``fields`` is replaced.

    ``make`` runs once per task, so tables it builds are shared by all the task's batches.
    """
    new_names = {f.name.lower() for f in fields}
    keep = [f for f in df.schema.fields if f.name.lower() not in new_names and (keep_text or f.name != text)]
    df = df.select(*dict.fromkeys([*(f.name for f in keep), text]))
    schema = T.StructType([*keep, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for part in slices(whole, text):
                new = compute(part.column(text))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in keep), *(as_arrow(new[f.name]) for f in fields)],
                    [*(f.name for f in keep), *(f.name for f in fields)],
                )

    return df.mapInArrow(run, schema)


def as_arrow(values) -> pa.Array:
    return values if isinstance(values, (pa.Array, pa.ChunkedArray)) else pa.array(values)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that all bits of a polynomial hash are usable."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd multiplier and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) <= n:
        size = max(n + 1, SLICE_BYTES + 2)
        for name, base in (("up", _MULT), ("down", pow(_MULT, -1, 1 << 64))):
            row = np.full(size, base & _MASK, np.uint64)
            row[0] = 1
            _powers[name] = np.multiply.accumulate(row)
    return _powers["up"], _powers["down"]


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each data[start:end]; equal byte strings have equal hashes wherever they stand."""
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def lowered(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 capitals in lower case, byte for byte."""
    low = _LOWER[data]
    at = np.flatnonzero(data[:-1] == 0xC3) + 1
    at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
    low[at] += 32
    return low


class Tokens:
    """Lower-cased tokens of many texts: maximal runs of ASCII letters, digits and non-ASCII characters."""

    def __init__(self, data: np.ndarray, off: np.ndarray, hashed: bool = True):
        self.data = low = lowered(data)
        is_token = _TOKEN[data]
        size = len(data)
        before, after = np.zeros(size, bool), np.zeros(size, bool)
        before[1:], after[:-1] = is_token[:-1], is_token[1:]
        edge = off[(off > 0) & (off < size)]
        before[edge], after[edge - 1] = False, False
        self.start = np.flatnonzero(is_token & ~before)
        self.end = np.flatnonzero(is_token & ~after) + 1
        #: Token index at which each document begins; one more at the end.
        self.first = np.searchsorted(self.start, off)
        if hashed:
            self.hash = span_hash(low, self.start, self.end)

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)

    def document(self) -> np.ndarray:
        """The document index of each token."""
        return np.repeat(np.arange(len(self.first) - 1), self.count)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]] along axis 0; empty ranges give zero."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def windows(tokens: Tokens, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k tokens that stay inside one document, and the index of their first token."""
    n = len(tokens.hash)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        h = h * np.uint64(_MULT) + tokens.hash[j : n - k + 1 + j]
    last = np.repeat(tokens.first[1:], tokens.count)  # first token after the document of each token
    at = np.arange(n - k + 1)
    inside = at + k <= last[: n - k + 1]
    return mix(h[inside]), at[inside]


def bitmap(hashes: DataFrame) -> np.ndarray:
    """BITMAP bits with that of every hash ``h`` set. Its size does not depend on the rows; of very many hashes it says little, but never leaves one out."""
    bit = F.pmod("h", F.lit(BITMAP)) + 1
    # Dealt out by bucket before they are set, so that no task sends parts of all buckets.
    rows = hashes.select(F.bitmap_bucket_number(bit).alias("b"), F.bitmap_bit_position(bit).alias("p")).repartition("b")
    bits = np.zeros(BITMAP // 8 + 4096, np.uint8)
    for r in rows.groupBy("b").agg(F.bitmap_construct_agg("p").alias("m")).collect():  # at most BITMAP bits in all
        bits[(r.b - 1) * 4096 : (r.b - 1) * 4096 + len(r.m)] = np.frombuffer(r.m, np.uint8)
    return bits


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of some unsigned hashes may be among those of a bitmap."""
    b = (h & np.uint64(BITMAP - 1)).astype(np.int64)
    return (bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores added until no column of the frames is called so (column names ignore case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def beside(df: DataFrame, names: list[str], step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``step(df)`` with columns of ``df`` that are called like the step's results, ``names``, out of its way."""
    own = {n.lower() for n in names}
    held = {n: unused(f"{n}_held_", df) for n in df.columns if n.lower() in own}
    found = step(df.withColumnsRenamed(held)).drop(*names).withColumnsRenamed({v: k for k, v in held.items()})
    return found.select(*df.columns)
