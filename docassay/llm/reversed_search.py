"""Ranked lexical search with the roles reversed: the queries are indexed, and the documents stream through the index.

The items of a benchmark are the queries. An inverted index over their terms is broadcast; every document's counts of
these terms are looked up in it once, which gives its scores for all items that share a term with it, and each item keeps a heap of its ``TOP``
best documents. Heaps are kept by task and merged, first by groups of tasks, then by item; what is shuffled does not depend on the
number of documents that match, only on tasks x items x ``TOP``.

Scores are integers: with N documents that have a term, L terms in all, n terms of the document, df documents that hold a term and tf its occurrences in the
document, a term weighs w = floor(1000 ln((2N + 2) / (2df + 1))), and a document's score sums w x (10^9 tf div (1000 tf + 12 m))
over the item's terms with repeats, m = 75 + 25 n N div L. Texts are tokenised once: the first pass keeps, of each document, its number of terms and
its counts of indexed terms, from which the statistics and then the scores are made.

An index has at most ``BLOCK`` entries (different terms of an item, and ``TOP`` for its heap); items beyond that are dealt out over several indices by a hash of
their id, and the documents stream through each in turn. An item whose own terms exceed it gets an index of its own.

Terms are runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lowered.

Defined cases: null and empty texts have no terms and no score; rows of items that share an id are one item with the terms of all of them, equal
rows count once, and a null id is an id; every row of documents is a document; ties go to the smaller document id, a null id comes last; empty tables give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .batches import buffers, slices
from .cluster import cut
from .divergence import terms

TOP = 20
BLOCK = 1 << 20  # entries of an index and places in its items' heaps: about 25 MB, and 150 MB of full heaps in a task
CELLS = 1 << 21  # scores and look-ups that a task holds at once
MERGE = 64  # groups of tasks that merge their heaps first


@dataclass
class Index:
    """term: hashes, ascending; term t is in the items item[first[t]:first[t + 1]], ``often`` times each. ids: of the items."""

    term: np.ndarray
    first: np.ndarray
    item: np.ndarray
    often: np.ndarray
    ids: list


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, h, often): the hashed terms of each item."""
    rows = items.select(F.col(item_id).alias("item"), F.col(text).alias("t")).where("t is not null").distinct()
    schema = T.StructType([rows.schema["item"], T.StructField("h", T.LongType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "t"):
                found = terms(*buffers(part.column("t")))
                own = part.column("item").take(pa.array(found.document()))
                yield pa.RecordBatch.from_arrays([own, pa.array(found.hash.view(np.int64))], ["item", "h"])

    return rows.mapInArrow(split, schema).groupBy("item", "h").agg(F.count("*").alias("often"))


def blocks_of(entries: DataFrame, most: int) -> DataFrame:
    """``entries`` with ``block``: items are dealt out so that no block has more than ``most`` entries, unless it holds one item only."""
    sizes = cut(entries.groupBy("item").agg((F.count("*") + TOP).alias("size")))
    every = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    if every <= most:
        return entries.withColumn("block", F.lit(0).cast("long"))
    number = F.when(F.col("size") > most // 2, F.xxhash64("item")).otherwise(F.pmod(F.xxhash64("item"), F.lit(4 * every // most + 1)))
    # Large items are alone in a block of their own hash; small ones share blocks that are a quarter full on average.
    own = sizes.select(F.col("item").alias("of_item"), number.alias("block"))
    full = own.join(sizes, F.col("of_item").eqNullSafe(F.col("item"))).groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("items"))
    if full.where((F.col("size") > most) & (F.col("items") > 1)).isEmpty():
        return entries.join(own, F.col("item").eqNullSafe(F.col("of_item"))).drop("of_item")
    return blocks_of(entries, most // 2)  # fewer, smaller items a block: hashes that met by chance part again


def index_of(entries: DataFrame) -> Index:
    """The index of one block; its size is bounded by BLOCK."""
    held = entries.select("item", "h", "often").toArrow()
    ids = held["item"].combine_chunks().dictionary_encode(null_encoding="encode")
    h = held["h"].to_numpy().view(np.uint64)
    item = ids.indices.to_numpy()
    order = np.lexsort((item, h))
    term, first = np.unique(h[order], return_index=True)
    return Index(term, np.append(first, len(h)), item[order].astype(np.int64), held["often"].to_numpy()[order], ids.dictionary.to_pylist())


def matched(docs: DataFrame, sent, doc_id: str, text: str) -> DataFrame:
    """(doc, n, term, tf): of each document with a term, its number of terms, and its counts of indexed terms (their places in the index)."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("t")).where("t is not null")
    lists = T.ArrayType(T.IntegerType())
    schema = T.StructType([rows.schema["doc"], T.StructField("n", T.LongType()), T.StructField("term", lists), T.StructField("tf", lists)])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value.term
        for whole in batches:
            for part in slices(whole, "t"):
                found = terms(*buffers(part.column("t")))
                at = np.searchsorted(known, found.hash)
                at[at == len(known)] = 0
                hit = np.flatnonzero(known[at] == found.hash) if len(known) else np.zeros(0, np.int64)
                pair, often = np.unique(found.document()[hit] * max(len(known), 1) + at[hit], return_counts=True)
                document, term = np.divmod(pair, max(len(known), 1))
                full = np.flatnonzero(found.count)
                first = np.searchsorted(document, np.append(full, len(part))).astype(np.int32)
                listed = [pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32))) for x in (term, often)]
                yield pa.RecordBatch.from_arrays([part.column("doc").take(pa.array(full)), pa.array(found.count[full]), *listed], schema.names)

    return rows.mapInArrow(look_up, schema)


def weights(often: np.ndarray, documents: int) -> np.ndarray:
    """w of terms that so many documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in often.tolist()], np.int64)


def norms(n: np.ndarray, documents: int, length: int) -> np.ndarray:
    """m of each document; in Python's integers where 64 bits do not hold the product."""
    if len(n) and 25 * int(n.max()) * documents >= 1 << 63:
        return np.array([75 + 25 * int(x) * documents // length for x in n], np.int64)
    return 75 + 25 * n * documents // max(length, 1)


class Heaps:
    """The best documents of each item so far, as (score, id), best first."""

    def __init__(self, items: int):
        self.best: list[list[tuple]] = [[] for _ in range(items)]
        #: A score below this cannot enter any more.
        self.least = np.ones(items, np.int64)

    def add(self, scores: np.ndarray, doc_ids: pa.Array) -> None:
        """scores: documents x items."""
        document, item = np.nonzero(scores >= self.least[None, :])
        if not len(document):
            return
        order = np.lexsort((-scores[document, item], item))
        document, item = document[order], item[order]
        begin = np.flatnonzero(np.append(True, item[1:] != item[:-1]))
        for lo, hi in zip(begin.tolist(), np.append(begin[1:], len(item)).tolist()):
            i, own = int(item[lo]), document[lo:hi]
            score = scores[own, i]
            if len(own) > TOP:  # in falling order: what is below the last that could stay cannot enter
                own = own[: np.searchsorted(-score, -score[TOP - 1], "right")]
            ids = doc_ids.take(pa.array(own)).to_pylist()
            rows = [*self.best[i], *zip(scores[own, i].tolist(), ids)]
            self.best[i] = heapq.nsmallest(TOP, rows, key=lambda x: (-x[0], x[1] is None, x[1] if x[1] is not None else 0))
            if len(self.best[i]) == TOP:
                self.least[i] = self.best[i][-1][0]


def streamed(found: DataFrame, sent, weight: np.ndarray, documents: int, length: int, item_type: T.DataType) -> DataFrame:
    """(item_id, doc_id, score): the heaps of each task."""
    schema = T.StructType([T.StructField("item_id", item_type), found.schema["doc"], T.StructField("score", T.LongType())])
    # Sums stay below 2 ** 53, so that float sums are exact, unless an item repeats terms very often.
    known = sent.value
    number = np.diff(known.first)
    most = np.bincount(known.item, known.often * np.repeat(weight, number) * 1e6, max(len(known.ids), 1)).max(initial=0)
    exact = bool(most < 2**53)
    heavy = found.sparkSession.sparkContext.broadcast(weight)

    def scores_of(own: Index, row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int) -> np.ndarray:
        """Scores of some documents for all items; part: of each (document, term), what the term counts there."""
        size = own.first[term + 1] - own.first[term]
        at = np.repeat(own.first[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        cell = np.repeat(row, size) * len(own.ids) + own.item[at]
        value = np.repeat(part, size) * own.often[at]
        if exact:
            return np.bincount(cell, value, rows * len(own.ids)).astype(np.int64).reshape(rows, -1)
        total = np.zeros(rows * len(own.ids), np.int64)
        np.add.at(total, cell, value)
        return total.reshape(rows, -1)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = sent.value, heavy.value
        heaps = Heaps(len(own.ids))
        wide = np.diff(own.first)
        for batch in batches:
            first = np.append(0, np.cumsum(batch.column("term").value_lengths().to_numpy())).astype(np.int64)
            term, tf = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in ("term", "tf"))
            m = norms(batch.column("n").to_numpy(), documents, length)
            row = np.repeat(np.arange(len(batch)), np.diff(first))
            part = w[term] * (1_000_000_000 * tf // (1000 * tf + 12 * m[row]))
            work = np.append(0, np.cumsum(wide[term]))[first] + np.arange(len(batch) + 1) * len(own.ids)
            lo = 0
            while lo < len(batch):
                hi = max(lo + 1, int(np.searchsorted(work, work[lo] + CELLS, "right")) - 1)
                a, b = first[lo], first[hi]
                heaps.add(scores_of(own, row[a:b] - lo, term[a:b], part[a:b], hi - lo), batch.column("doc").slice(lo, hi - lo))
                lo = hi
        rows = [(own.ids[i], doc, score) for i, best in enumerate(heaps.best) for score, doc in best]
        if rows:
            kinds = [to_arrow_type(f.dataType) for f in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], schema.names)

    return found.select("doc", "n", "term", "tf").mapInArrow(rank, schema)


def merged(heaps: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): the best of all heaps, merged by groups of tasks before they meet by item."""
    order = [F.col("score").desc(), F.col("doc").asc_nulls_last()]
    some = heaps.withColumn("task", F.pmod(F.spark_partition_id(), F.lit(MERGE)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "task").orderBy(*order))).where(F.col("rank") <= TOP)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= TOP)
    return best.select("item_id", "rank", "doc", "score")


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id and score of the ``TOP`` best documents of each item."""
    entries = cut(blocks_of(cut(item_terms(items, item_id, item_text)), block))
    numbers = [r.block for r in entries.select("block").distinct().collect()]  # items / BLOCK
    found = None
    for number in numbers or [0]:
        known = index_of(entries.where(F.col("block") == number))
        sent = docs.sparkSession.sparkContext.broadcast(known)
        own = cut(matched(docs, sent, doc_id, text))
        documents, length = own.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        held = own.select(F.explode("term").alias("t")).groupBy("t").count().toArrow()  # terms of an index
        often = np.zeros(len(known.term), np.int64)
        often[held["t"].to_numpy()] = held["count"].to_numpy()
        weight = weights(often, documents)
        best = merged(streamed(own, sent, weight, documents, length, items.schema[item_id].dataType))
        found = best if found is None else found.unionByName(best)
    name = doc_id if doc_id.lower() not in ("item_id", "rank", "score") else f"found_{doc_id}"
    return found.select("item_id", "rank", F.col("doc").alias(name), "score")
