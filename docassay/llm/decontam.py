"""Benchmark decontamination by greedy string tiling.

Windows are the runs of ``SHORTEST`` tokens. Of every benchmark item some windows are its seeds, the ones that the fewest items
hold: so many that a text without any of them cannot cover enough of the item. Documents and items meet on
shared seeds only, so a template that many items begin with brings nothing together. Each pair that met is looked at by all its shared
windows; where these could cover enough of the item, the pair is tiled: running Karp-Rabin finds the longest
common unmarked runs, the longest are marked first in both texts, and the search length falls until
``SHORTEST``. A tile may stand anywhere, so reordered passages count. The share of the item's
tokens that tiles cover is its coverage; a pair leaks from ``COVERAGE`` on.

A benchmark of at most ``BLOCK_BYTES`` goes to the tasks as a broadcast of token hashes and seeds, and no document row is
shuffled. A larger one is joined with the documents on seeds; a bitmap of 16 MB keeps most
windows of documents out of that join, and only the texts of pairs that met are shuffled. Both ways give the same rows.

Defined cases: a null or empty document leaks nothing; an item without tokens never matches; an
item of fewer than ``SHORTEST`` tokens must occur whole; equal items are compared once and each get their own row, repeated documents
too; an empty table gives no leaks; a result column named like the document's id column gets the prefix ``leak_``.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import Tokens, bitmap, buffers, in_bitmap, slices, sums, windows
from .cluster import cut

SHORTEST, COVERAGE = 5, 0.8
BLOCK_BYTES = 32 << 20
NAMES = ["item_id", "coverage", "tiles", "covered", "tokens"]
_KNOWN = 1 << 22
_BASE, _PRIME = 1_000_003, (1 << 61) - 1


def hashes(values: list[int], free: list[bool], k: int):
    """(position, Karp-Rabin hash) of every run of k free values."""
    top = pow(_BASE, k, _PRIME)
    h = size = 0
    for i, x in enumerate(values):
        if not free[i]:
            h = size = 0
            continue
        h, size = (h * _BASE + x) % _PRIME, size + 1
        if size > k:
            h, size = (h - values[i - k] * top) % _PRIME, k
        if size == k:
            yield i - k + 1, h


def tiles(item: list[int], doc: list[int | None], shortest: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (start in item, start in doc, length); None in doc is a token that no tile may hold."""
    open_item, open_doc = [True] * len(item), [x is not None for x in doc]
    found: list[tuple[int, int, int]] = []
    k = max(shortest, min(20, len(item)))
    while True:
        at = defaultdict(list)
        for i, h in hashes(item, open_item, k):
            at[h].append(i)
        matches = []
        for j, h in hashes(doc, open_doc, k):
            for i in at.get(h, ()):
                # A match that also holds one token earlier is part of a longer one seen before.
                if i and j and open_item[i - 1] and open_doc[j - 1] and item[i - 1] == doc[j - 1]:
                    continue
                n = 0
                while i + n < len(item) and j + n < len(doc) and open_item[i + n] and open_doc[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n >= k:
                    matches.append((-n, i, j))
        if matches and (longest := -min(matches)[0]) > 2 * k:
            k = longest
            continue
        marked = False
        for n, i, j in sorted(matches):
            # What marked tiles left of this match: its longest open part of k or more.
            best, run = (0, 0), 0
            for x in range(-n):
                run = run + 1 if open_item[i + x] and open_doc[j + x] else 0
                best = max(best, (run, -(x - run + 1)))
            size, x = best[0], -best[1]
            if size == -n:
                found.append((i + x, j + x, size))
                open_item[i + x : i + x + size] = [False] * size
                open_doc[j + x : j + x + size] = [False] * size
                marked = True
            # A match that a longer one cut is looked for again at its own length.
        if matches and marked:
            continue
        if k == shortest:
            return found
        k = max(shortest, k // 2)


def least_covered(size: np.ndarray, coverage: float) -> np.ndarray:
    """The fewest tokens of items of ``size`` tokens that make a leak."""
    return np.ceil(coverage * size - 1e-9)


def chosen(often: np.ndarray, at: np.ndarray, item: np.ndarray, size: np.ndarray, k: np.ndarray, coverage: float) -> np.ndarray:
    """Which windows of items are seeds.

    Of each window: how many items hold it, its first token, its item (ascending); of each item: its tokens and
    its window length. A text without any seed of an item leaves so many of its tokens uncovered that it cannot leak. Seeds are held by as few items
    as powers of two tell apart, and there are no more of them than the proof needs.
    """
    begin = np.append(0, np.cumsum(size))
    spare = size - least_covered(size, coverage)

    def covered(held: np.ndarray) -> np.ndarray:
        edge = np.zeros(begin[-1] + 1, np.int64)
        np.add.at(edge, begin[item[held]] + at[held], 1)
        np.add.at(edge, begin[item[held]] + at[held] + k[item[held]], -1)
        return np.cumsum(edge)[:-1] > 0

    bar, todo, level = np.zeros(len(size), np.int64), size > 0, 1
    while todo.any():
        open_ = size - sums(covered(todo[item] & (often > level)), begin)
        bar[todo & (open_ > spare)] = level
        todo &= bar == 0
        level *= 2
    rare = often <= bar[item]
    # The first spare + 1 tokens that rare windows alone can cover prove it: no window beyond them is needed.
    alone = ~covered(~rare)
    nth = np.cumsum(alone)
    before = np.append(0, nth)[begin[:-1]]
    last = np.searchsorted(nth, before + spare + 1) - begin[:-1]
    return rare & (at <= np.minimum(last, size - k)[item])


def item_windows(tokens: Tokens, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first token in its item, item) of all windows by items, and each item's window length."""
    size = tokens.count
    k = np.minimum(size, shortest)
    found = []
    for n in np.unique(k[k > 0]):
        h, at = windows(tokens, int(n))
        item = np.searchsorted(tokens.first, at, "right") - 1
        own = k[item] == n
        found.append((h[own], at[own] - tokens.first[item[own]], item[own]))
    h, at, item = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((at, item))
    return h[order], at[order], item[order], k


@dataclass
class Items:
    """Distinct items as token hashes (item i: tokens first[i]:first[i + 1]), and by window length the seeds' hashes, ascending, with their items."""

    ids: list[list]
    hash: np.ndarray
    first: np.ndarray
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of(ids: list, texts: list[str | None], shortest: int, coverage: float) -> Items:
        same: dict[str, list] = {}
        for i, t in zip(ids, texts):
            if t is not None:
                same.setdefault(t, []).append(i)
        tokens = Tokens(*buffers(pa.array(list(same), pa.string())))
        h, at, item, k = item_windows(tokens, shortest)
        pair = np.unique(np.stack([h, item.astype(np.uint64)], 1), axis=0)
        value, number = np.unique(pair[:, 0], return_counts=True)
        seed = chosen(number[np.searchsorted(value, h)], at, item, tokens.count, k, coverage)
        h, item = h[seed], item[seed]
        seeds = {}
        for n in np.unique(k[item]).tolist():
            own = k[item] == n
            order = np.lexsort((item[own], h[own]))
            seeds[n] = h[own][order], item[own][order].astype(np.int32)
        return Items(list(same.values()), tokens.hash, tokens.first, seeds)


class Matcher:
    """Looks documents up among items; one for each task."""

    def __init__(self, items: Items, shortest: int, coverage: float):
        self.items, self.shortest, self.coverage = items, shortest, coverage
        self.known = {}  # passes few windows on to the exact look-up
        for k, (h, _) in items.seeds.items():
            self.known[k] = np.zeros(_KNOWN, bool)
            self.known[k][(h & np.uint64(_KNOWN - 1)).astype(np.int64)] = True

    def met(self, tokens: Tokens) -> dict[int, np.ndarray]:
        """Of each document that shares a seed with any item, these items."""
        found = defaultdict(list)
        for k, (seeds, item) in self.items.seeds.items():
            h, where = windows(tokens, k)
            near = self.known[k][(h & np.uint64(_KNOWN - 1)).astype(np.int64)]
            h, where = h[near], where[near]
            lo, hi = np.searchsorted(seeds, h, "left"), np.searchsorted(seeds, h, "right")
            hit = np.flatnonzero(hi > lo)
            document = np.searchsorted(tokens.first, where[hit], "right") - 1
            for part in np.split(hit, np.flatnonzero(np.diff(document)) + 1) if len(hit) else ():
                ranges = {int(a): int(b) for a, b in zip(lo[part], hi[part])}
                d = int(np.searchsorted(tokens.first, where[part[0]], "right") - 1)
                found[d].append(np.concatenate([item[a:b] for a, b in ranges.items()]))
        return {d: np.unique(np.concatenate(x)) for d, x in found.items()}

    def leaks(self, column: pa.Array) -> Iterator[tuple[int, list, int, int, int]]:
        """(document, ids of equal items, tiles, covered tokens, tokens) of each leak."""
        tokens = Tokens(*buffers(column))
        for d, items in sorted(self.met(tokens).items()):
            own = Document(tokens.hash[tokens.first[d] : tokens.first[d + 1]])
            for i in items.tolist():
                item = self.items.hash[self.items.first[i] : self.items.first[i + 1]]
                found = own.tiled(item, self.shortest, self.coverage)
                if found:
                    yield d, self.items.ids[i], *found, len(item)


class Document:
    """A document's token hashes and its windows by length."""

    def __init__(self, hash_: np.ndarray):
        self.hash = hash_
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.held:
            h = run_hashes(self.hash, k)
            self.held[k] = h, np.unique(h)
        return self.held[k]

    def tiled(self, item: np.ndarray, shortest: int, coverage: float) -> tuple[int, int] | None:
        """(tiles, covered tokens) of an item, or None where too little of it is covered."""
        k, least = min(shortest, len(item)), least_covered(np.array(len(item)), coverage)
        mine, distinct = self.windows(k)
        own = run_hashes(item, k)
        if not len(distinct):
            return None
        shared = distinct[np.minimum(np.searchsorted(distinct, own), len(distinct) - 1)] == own
        could = np.zeros(len(item) + 1, np.int64)
        np.add.at(could, np.flatnonzero(shared), 1)
        np.add.at(could, np.flatnonzero(shared) + k, -1)
        if (np.cumsum(could)[:-1] > 0).sum() < least:
            return None
        # The document's tokens that shared windows cover, each stretch closed by a token that matches nothing.
        doc: list[int | None] = []
        last = -1
        for x in np.flatnonzero(np.isin(mine, own[shared])).tolist():
            if last >= 0 and x > last:
                doc.append(None)
            doc += self.hash[max(x, last) : x + k].tolist()
            last = x + k
        found = tiles(item.tolist(), doc, k)
        total = sum(n for *_, n in found)
        return (len(found), total) if total >= least else None


def run_hashes(hash_: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k tokens of one text."""
    h, _ = windows(OneText(hash_), k)
    return h


class OneText(Tokens):
    """The tokens of one text, by their hashes."""

    def __init__(self, hash_: np.ndarray):
        self.hash, self.first = hash_, np.array([0, len(hash_)])


def result_names(doc_id: str) -> list[str]:
    return [f"leak_{n}" if n == doc_id.lower() else n for n in NAMES]


def kinds(item_type: T.DataType) -> list[T.DataType]:
    return [item_type, T.DoubleType(), T.IntegerType(), T.IntegerType(), T.IntegerType()]


def items_of(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """(i, t): the items that have a text; no other can leak."""
    return benchmark.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("t is not null")


def small(items: DataFrame) -> bool:
    """Whether items (i, t) fit into a broadcast of about BLOCK_BYTES, texts and ids counted."""
    size = F.octet_length("t") + F.coalesce(F.octet_length(F.to_json(F.struct("i"))), F.lit(0)) + 16
    return items.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0] <= BLOCK_BYTES


def broadcast_items(docs: DataFrame, rows: DataFrame, shortest: int, coverage: float):
    """rows: i and t, of at most about BLOCK_BYTES."""
    held = rows.collect()
    return docs.sparkSession.sparkContext.broadcast(Items.of([r.i for r in held], [r.t for r in held], shortest, coverage))


def leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shortest: int = SHORTEST, coverage: float = COVERAGE,
) -> DataFrame:
    """One row per leaked (document, item): the document's id, item_id, coverage, tiles, covered and tokens."""
    item_type = benchmark.schema[item_id].dataType
    names = result_names(doc_id)
    rows = items_of(benchmark, item_id, item_text)
    if not small(rows):
        own = docs.select(F.col(doc_id).alias("id_"), F.col(text).alias("t"))
        found = joined_leaks(own, rows, shortest, coverage)
        keyed = own.where("t is not null").select("id_", *text_key("t", "d"))
        return keyed.join(found, ["d1", "d2"]).select(F.col("id_").alias(doc_id), *[F.col(n).alias(m) for n, m in zip(NAMES, names)])
    sent = broadcast_items(docs, rows, shortest, coverage)
    schema = T.StructType([docs.schema[doc_id], *map(T.StructField, names, kinds(item_type))])
    arrow = to_arrow_type(item_type)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, shortest, coverage)
        for batch in batches:
            for part in slices(batch, text):
                found = [(d, i, n, covered, size) for d, ids, n, covered, size in matcher.leaks(part.column(text)) for i in ids]
                if found:
                    d, i, n, covered, size = map(list, zip(*found))
                    number = [pa.array(x, pa.int32()) for x in (n, covered, size)]
                    own = part.column(doc_id).take(pa.array(d, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, pa.array(i, arrow), pa.array(np.array(covered) / np.array(size)), *number], schema.names)

    return docs.select(doc_id, text).mapInArrow(find, schema)


def clean(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    shortest: int = SHORTEST, coverage: float = COVERAGE,
) -> DataFrame:
    """The documents that leak no item, with their own columns."""
    rows = items_of(benchmark, item_id, item_text)
    if not small(rows):
        found = joined_leaks(docs.select(F.col(text).alias("t")), rows, shortest, coverage).select("d1", "d2").distinct()
        one, two = (k for k in text_key(text, "d"))
        return docs.join(found, one.eqNullSafe(found.d1) & two.eqNullSafe(found.d2), "left_anti")
    sent = broadcast_items(docs, rows, shortest, coverage)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(sent.value, shortest, coverage)
        for batch in batches:
            for part in slices(batch, text):
                good = np.ones(len(part), bool)
                good[[d for d, *_ in matcher.leaks(part.column(text))]] = False
                yield part.filter(pa.array(good))

    return docs.mapInArrow(keep, docs.schema)


# --- a benchmark larger than a broadcast ------------------------------------------------------------------------------


def text_key(text: str, prefix: str) -> list:
    """128 bits that tell texts apart."""
    return [F.xxhash64(text).alias(f"{prefix}1"), F.xxhash64(F.lit(1), text).alias(f"{prefix}2")]


def list_array(values: np.ndarray, begin: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(begin.astype(np.int32), pa.array(values))


def item_seeds(texts: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """(k, h, t1, t2): the seeds of items (t1, t2, t); how many items hold a window is a grouped count."""

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "t"):
                tokens = Tokens(*buffers(part.column("t")))
                h, at, item, k = item_windows(tokens, shortest)
                own = [part.column(c).take(pa.array(item)) for c in ("t1", "t2")]
                more = [pa.array(x.astype(np.int32)) for x in (tokens.count[item], k[item], at)]
                yield pa.RecordBatch.from_arrays([*own, *more, pa.array(h.view(np.int64))], ["t1", "t2", "size", "k", "at", "h"])

    every = cut(texts.mapInArrow(cut_up, "t1 long, t2 long, size int, k int, at int, h long"))
    often = every.select("t1", "t2", "k", "h").distinct().groupBy("k", "h").agg(F.count("*").alias("often"))
    whole = every.join(often, ["k", "h"]).groupBy("t1", "t2", "size", "k")
    whole = whole.agg(F.array_sort(F.collect_list(F.struct("at", "h", "often"))).alias("w"))  # the windows of one text
    whole = whole.select("t1", "t2", "size", "k", *[F.col(f"w.{c}").alias(c) for c in ("at", "h", "often")])

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, h, often = (batch.column(c).flatten().to_numpy() for c in ("at", "h", "often"))
            item = np.repeat(np.arange(len(batch)), batch.column("at").value_lengths().to_numpy())
            size, k = (batch.column(c).to_numpy().astype(np.int64) for c in ("size", "k"))
            seed = np.flatnonzero(chosen(often, at, item, size, k, coverage))
            own = pa.array(item[seed])
            yield pa.RecordBatch.from_arrays([batch.column("k").take(own), pa.array(h[seed]), batch.column("t1").take(own), batch.column("t2").take(own)], ["k", "h", "t1", "t2"])

    return cut(whole.mapInArrow(pick, "k int, h long, t1 long, t2 long").distinct())


def joined_leaks(docs: DataFrame, items: DataFrame, shortest: int, coverage: float) -> DataFrame:
    """(d1, d2, NAMES) of each different text of ``docs`` (t) that leaks any of ``items`` (i, t)."""
    items = cut(items.where("t is not null").select("i", "t", *text_key("t", "t")))
    texts = items.select("t1", "t2", "t").dropDuplicates(["t1", "t2"])
    seeds = item_seeds(texts, shortest, coverage)
    lengths = [r.k for r in seeds.select("k").distinct().collect()]  # at most SHORTEST
    sent = docs.sparkSession.sparkContext.broadcast(bitmap(seeds))
    own = docs.where("t is not null").select("t", *text_key("t", "d"))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            for part in slices(batch, "t"):
                tokens = Tokens(*buffers(part.column("t")))
                for k in lengths:
                    h, at = windows(tokens, k)
                    near = np.flatnonzero(in_bitmap(bits, h))
                    document = np.searchsorted(tokens.first, at[near], "right") - 1
                    pair = np.unique(np.stack([document.astype(np.uint64), h[near]], 1), axis=0)
                    d = pa.array(pair[:, 0].astype(np.int64))
                    number = pa.array(np.full(len(pair), k, np.int32))
                    yield pa.RecordBatch.from_arrays([part.column("d1").take(d), part.column("d2").take(d), number, pa.array(pair[:, 1].copy().view(np.int64))], ["d1", "d2", "k", "h"])

    met = own.mapInArrow(cut_up, "d1 long, d2 long, k int, h long").join(seeds, ["k", "h"]).select("d1", "d2", "t1", "t2").distinct()
    met = cut(met)
    near = own.join(met.select("d1", "d2").distinct(), ["d1", "d2"], "left_semi").dropDuplicates(["d1", "d2"])
    pairs = met.join(texts.withColumnRenamed("t", "item"), ["t1", "t2"]).join(near, ["d1", "d2"])

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes_of = lambda x: Tokens(*buffers(x)).hash
        for batch in batches:
            found, last, document = [], None, None
            for n in range(len(batch)):
                key = batch.column("d1")[n].as_py(), batch.column("d2")[n].as_py()
                if key != last:
                    last, document = key, Document(hashes_of(batch.column("t").slice(n, 1)))
                item = hashes_of(batch.column("item").slice(n, 1))
                got = document.tiled(item, shortest, coverage)
                if got:
                    found.append((*key, batch.column("t1")[n].as_py(), batch.column("t2")[n].as_py(), got[1] / len(item), *got, len(item)))
            if found:
                kinds_ = [*[pa.int64()] * 4, pa.float64(), *[pa.int32()] * 3]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds_)], ["d1", "d2", "t1", "t2", *NAMES[1:]])

    leaked = pairs.select("d1", "d2", "t1", "t2", "item", "t").mapInArrow(tile, "d1 long, d2 long, t1 long, t2 long, coverage double, tiles int, covered int, tokens int")
    return leaked.join(items.select("i", "t1", "t2"), ["t1", "t2"]).select("d1", "d2", F.col("i").alias("item_id"), *NAMES[1:])
