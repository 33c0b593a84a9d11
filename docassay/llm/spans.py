"""Substring dedup by sliding sentence spans.

A text is cut into sentences at line ends and after ``.``, ``!`` or ``?`` before white space. From every sentence the
shortest run of at least ``SENTENCES`` sentences and ``WORDS`` words is hashed (96 bits over lower-cased
words). Runs are joined over all documents; a run's first place is in the document with the
smallest id, at its first position there. All sentences that any other place covers are removed.

For texts without sentence ends, and for passages that begin or end inside a sentence, the parameter ``long`` cuts sentences of more than so many
words further, where the hash of two neighbouring words is the least of any ``WINDOW``
successive ones (winnowing; of equal ones the last): equal passages are cut alike
wherever they stand, at most ``WINDOW`` words apart, so every passage of more than 50 words inside such a sentence holds a whole run. These pieces then
take the place of sentences; a removed one may be a part of a sentence. Without it only whole sentences go.

Words are runs of ASCII letters, digits and other characters beyond ASCII; a stretch of a script that is written without spaces is one word here.

Defined cases: rows with a null id or null text are returned unchanged; texts with fewer
sentences or words than a run has no run; rows that share an id, equal ones too, are told apart by their place in the table, of which the
first counts as first (the rows are then written once with a number, so that it stays); an empty
table gives an empty result; an input column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Tokens, beside, bitmap, buffers, in_bitmap, mix, powers, slices, unused
from .cluster import cut

SENTENCES, WORDS, WINDOW = 3, 20, 8
ADDED = ["n_sentences", "n_units", "n_removed"]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[33, 46, 63]] = True


def winnowed(pair: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which values are the least, of equal ones the last, of any WINDOW successive ones inside one text; text i has the values first[i]:first[i + 1] - 1."""
    chosen = np.zeros(len(pair), bool)
    n = len(pair) - WINDOW + 1
    if n <= 0:
        return chosen
    least, at = pair[:n].copy(), np.arange(n)
    for j in range(1, WINDOW):
        value = pair[j : n + j]
        better = value <= least
        least[better] = value[better]
        at[better] = np.flatnonzero(better) + j
    end = np.repeat(first[1:], np.diff(first))[:n]  # the token after the text of each window's first token
    chosen[at[np.arange(n) + WINDOW < end]] = True
    return chosen


class Runs:
    """Sentences (or their pieces) of many texts and the hashed run that starts at each."""

    def __init__(self, column: pa.Array, long: int | None = None):
        self.data, self.off = buffers(column)
        tokens = Tokens(self.data, self.off)
        n = len(tokens.start)
        ends = self.data == 10
        ends[:-1] |= _STOP[self.data[:-1]] & _SPACE[self.data[1:]]
        seen = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum(ends, out=seen[1:])
        begins = np.ones(n, bool)  # does a sentence begin at this token
        if n:
            begins[1:] = seen[tokens.start[1:]] > seen[tokens.end[:-1]]
            begins[tokens.first[:-1][tokens.count > 0]] = True
        #: Number of each document's sentences.
        self.sentences = np.diff(np.append(0, np.cumsum(begins))[tokens.first])
        if n and long is not None:
            size = np.diff(np.append(np.flatnonzero(begins), n))
            pair = mix(tokens.hash[:-1] * np.uint64(3) + tokens.hash[1:])  # of two words, so frequent words do not decide alone
            begins[1:] |= np.repeat(size > long, size)[:-1] & winnowed(pair, tokens.first)
        self.word = np.append(np.flatnonzero(begins), n)  # first word of each sentence
        #: Index of each document's first sentence or piece; one more at the end.
        self.first = np.searchsorted(self.word[:-1], tokens.first)
        self.count = np.diff(self.first)
        self.start = tokens.start[self.word[:-1]]  # first byte
        m = len(self.word) - 1
        self.last = np.maximum(np.arange(m) + SENTENCES, np.searchsorted(self.word, self.word[:-1] + WORDS))
        limit = np.repeat(self.first[1:], self.count)
        self.at = np.flatnonzero(self.last <= limit)  # sentences at which a run begins
        a, b = self.word[self.at], self.word[self.last[self.at]]
        up, down = powers(n)
        both = []
        for value in (tokens.hash, mix(tokens.hash ^ np.uint64(0x5DEECE66D))):
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(value * up[:n], out=total[1:])
            both.append(mix((total[b] - total[a]) * down[a] + (b - a).astype(np.uint64)))
        self.hash = both[0].view(np.int64)
        self.check = (both[1] >> np.uint64(33)).astype(np.int32)
        self.document = np.repeat(np.arange(len(self.count)), self.count)[self.at]

    def firsts(self) -> np.ndarray:
        """Of self.at: the first place of each different run of a document, in order."""
        if not len(self.at):
            return np.zeros(0, np.int64)
        own = mix(self.hash.view(np.uint64) + mix(self.document.astype(np.uint64) + np.uint64(1)))
        return np.sort(np.unique(own, return_index=True)[1])

    def removed(self, run: np.ndarray) -> np.ndarray:
        """Which sentences the runs numbered ``run`` cover."""
        edge = np.zeros(len(self.word), np.int64)
        np.add.at(edge, self.at[run], 1)
        np.add.at(edge, self.last[self.at[run]], -1)
        return np.cumsum(edge)[:-1] > 0

    def without(self, gone: np.ndarray, document: int) -> str:
        """The text of a document without the sentences marked in ``gone``."""
        lo, hi = self.first[document], self.first[document + 1]
        edges = np.append(self.start[lo:hi], self.off[document + 1])
        edges[0] = self.off[document]
        kept = [self.data[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~gone[lo:hi])]
        return b"".join(kept).decode("utf-8", "replace").strip()


def runs(docs: DataFrame, long: int | None, among: Broadcast | None = None) -> DataFrame:
    """(id_, h, g): every different run of every document (id_, t), or those that a bitmap may hold."""
    rows = docs.where("id_ is not null and t is not null")
    schema = T.StructType([rows.schema["id_"], T.StructField("h", T.LongType()), T.StructField("g", T.IntegerType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, "t"):
                own = Runs(part.column("t"), long)
                pick = own.firsts()
                if among is not None:
                    pick = pick[in_bitmap(among.value, own.hash[pick].view(np.uint64))]
                ids = part.column("id_").take(pa.array(own.document[pick]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own.hash[pick]), pa.array(own.check[pick])], ["id_", "h", "g"])

    return rows.mapInArrow(find, schema)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", long: int | None = None) -> DataFrame:
    """``docs`` with repeated sentences taken out of ``text``, and n_sentences, n_units (sentences, or pieces with ``long``) and n_removed (of these) added."""
    place, given = F.col(doc_id), docs.columns
    if not docs.where(place.isNotNull()).groupBy(place.alias("id_")).count().where("count > 1").isEmpty():
        row = unused("row_", docs)
        docs = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        place = F.when(F.col(doc_id).isNotNull(), F.struct(F.col(doc_id).alias("id"), F.col(row).alias("row")))
    texts = docs.select(place.alias("id_"), F.col(text).alias("t"))
    ends = runs(texts, long).groupBy("h", "g").agg(F.min("id_").alias("first_"), F.max("id_").alias("last_"))
    first = cut(ends.where("first_ < last_").select("h", "g", "first_"))
    # Most runs stand in one document: a bitmap of the others keeps them from being shuffled again.
    among = docs.sparkSession.sparkContext.broadcast(bitmap(first))
    later = runs(texts, long, among).join(first, ["h", "g"]).where("id_ <> first_")
    # The document's own run has these 96 bits, so 64 of them find it again inside the document.
    id_, hits = unused("later_id_", docs), unused("later_h_", docs)
    later = later.groupBy(F.col("id_").alias(id_)).agg(F.collect_set("h").alias(hits))
    keep = [c for c in given if c.lower() not in ADDED]
    rows = docs.join(later, place == F.col(id_), "left").select(*keep, hits)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != hits), *(T.StructField(n, T.IntegerType()) for n in ADDED)])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, text):
                column, own = part.column(text), Runs(part.column(text), long)
                named = part.column(doc_id).is_valid().to_numpy(zero_copy_only=False)
                hit = np.ones(len(own.at), bool)
                hit[own.firsts()] = False  # a second place in the same document
                hit &= named[own.document]
                if part.column(hits).null_count < len(part):
                    lists = part.column(hits).fill_null([])
                    spots = np.searchsorted(own.document, np.arange(len(part) + 1))
                    for d in np.flatnonzero(np.diff(lists.offsets.to_numpy())):
                        lo, hi = spots[d], spots[d + 1]
                        hit[lo:hi] |= np.isin(own.hash[lo:hi], lists[int(d)].values.to_numpy())
                gone = own.removed(np.flatnonzero(hit))
                total = np.append(0, np.cumsum(gone))
                lost = total[own.first[1:]] - total[own.first[:-1]]
                if lost.any():
                    was = column.to_pylist()
                    for d in np.flatnonzero(lost):
                        was[d] = own.without(gone, int(d))
                    column = pa.array(was, column.type)
                out = [column if f.name == text else part.column(f.name) for f in schema.fields[: -len(ADDED)]]
                sizes = [pa.array(x.astype(np.int32)) for x in (own.sentences, own.count, lost)]
                yield pa.RecordBatch.from_arrays([*out, *sizes], schema.names)

    return rows.mapInArrow(clean, schema)


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars", long: int | None = None) -> DataFrame:
    """The documents without repeated sentences, with their own columns; those that had no other sentence are gone."""

    def step(d: DataFrame) -> DataFrame:
        found = remove_repeats(d, doc_id, text, long).where("n_removed = 0 or n_removed < n_units")
        if n_chars in d.columns:
            found = found.withColumn(n_chars, F.when(F.col("n_removed") > 0, F.char_length(text).cast(d.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
        return found

    return beside(docs, ADDED, step)
