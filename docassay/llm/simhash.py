"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits. For a radius r, every bit position gets a nonzero vector of
r + 1 bits; table v, for each nonzero v, keeps the positions whose vector has an odd product with
v. Any r positions leave at least one v orthogonal to all their vectors, so two fingerprints
within the radius agree on all kept positions of some table: no link is missed.

Only distinct fingerprints are hashed. A bucket with more than ``SMALL`` of them is covered again
with the next level's vectors. Four levels leave so few free positions that no bucket can
hold more than ``SMALL`` distinct fingerprints, so nothing is capped.

Defined cases: a null or blank text has fingerprint zero and links like any other; exact copies
share a fingerprint; repeated rows stay as many rows; an empty table gives an empty result; other
columns are ignored. A null doc_id takes part, but is never the smallest unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_text, unused
from .cluster import components, cut

SHINGLE, RADIUS, SEED, BITS = 3, 3, 42, 64
LEVELS, SMALL = 4, 2048


def fingerprint(text: bytes) -> int:
    """Majority of the XXH64 values of a text's word shingles, as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 1
    k = min(SHINGLE, len(words))
    end = np.cumsum(size) - 1
    start = (end + 1 - size)[: len(words) - k + 1].tolist()
    hashed = xxhash.xxh64_intdigest
    h = np.fromiter((hashed(joined[i:j], SEED) for i, j in zip(start, end[k - 1 :].tolist())), ">u8", len(start))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 14):
        ones += np.unpackbits(h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">u8")[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by ``fp``, the fingerprint as a signed long."""

    def make():
        def compute(column: pa.Array) -> dict:
            found = [fingerprint((x.as_buffer().to_pybytes() if x.is_valid else b"")) for x in column]
            return {"fp": pa.array(np.array(found, np.uint64).view(np.int64))}

        return compute

    return map_text(docs, text, make, [T.StructField("fp", T.LongType())])


def vectors(level: int) -> np.ndarray:
    """The nonzero (RADIUS + 1)-bit vector of each bit position: all of them equally often, in a fixed random order."""
    every = np.arange(BITS) % (2 ** (RADIUS + 1) - 1) + 1
    return np.random.default_rng([2016, level]).permutation(every)


def masks(level: int) -> list[int]:
    """The kept positions of each table of a level."""
    own = vectors(level)
    odd = [[bin(int(w) & v).count("1") & 1 for w in own] for v in range(1, 2 ** (RADIUS + 1))]
    return [sum(1 << i for i, bit in enumerate(row) if bit) for row in odd]


def most_free_bits(levels: int = LEVELS) -> int:
    """The most positions that any table of the last level leaves free; a bucket there holds at most 2 ** this."""
    kept = np.array([0], np.uint64)
    for level in range(levels):
        kept = (kept[:, None] | np.array(masks(level), np.uint64)[None, :]).ravel()
    return BITS - int(np.bitwise_count(kept).min())


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket of at most SMALL fingerprints: links that connect what is within the radius, at most one per member."""
    for batch in batches:
        a, b = [], []
        for bucket in batch.column("fps"):
            x = np.sort(np.array(bucket.values.to_numpy(zero_copy_only=False), np.int64)).view(np.uint64)
            root = np.arange(len(x))
            for i in range(len(x) - 1):
                near = np.flatnonzero(np.bitwise_count(x[i + 1 :] ^ x[i]) <= RADIUS) + i + 1
                for old in np.unique(root[near]):
                    if old != root[i]:
                        j = near[root[near] == old][0]
                        root[root == old] = root[i]
                        a.append(x[i])
                        b.append(x[j])
        yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)) for v in (a, b)], ["a", "b"])


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) among distinct fingerprints ``fp`` that span every group connected within the radius."""
    rows = fps.select("fp", F.lit(0).cast("long").alias("kept"), F.lit(0).alias("path"))
    found = None
    for level in range(LEVELS):
        table = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("i"), F.lit(_signed(m)).alias("m")) for i, m in enumerate(masks(level))])).alias("t")
        rows = rows.select("fp", "kept", "path", table).select(
            "fp", F.expr("kept | t.m").alias("kept"), (F.col("path") * 16 + F.col("t.i")).alias("path")
        )
        rows = rows.withColumn("key", F.expr("fp & kept"))
        full = rows.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        rows = cut(rows.join(full, ["path", "key"]))
        small = rows.where(F.col("n") <= SMALL) if level < LEVELS - 1 else rows
        small = small.groupBy("path", "key").agg(F.collect_list("fp").alias("fps")).select("fps")
        new = small.mapInArrow(_spanning, "a long, b long")
        found = new if found is None else found.unionByName(new)
        rows = rows.where(F.col("n") > SMALL).select("fp", "kept", "path")
        if level < LEVELS - 1 and rows.isEmpty():
            break
    return found


def components_of(own: DataFrame) -> DataFrame:
    """(fp_, component_id) of every fingerprint of ``own`` (id_, fp): component_id is the smallest id_ reachable."""
    if most_free_bits() > np.log2(SMALL):
        raise AssertionError("the covering levels do not bound a bucket")
    reps = cut(own.groupBy("fp").agg(F.min("id_").alias("least")))
    roots = components(links(reps))
    known = reps.join(roots, reps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = cut(known)
    smallest = known.groupBy("root").agg(F.min("least").alias("component_id"))
    return known.join(smallest, "root").select(F.col("fp").alias("fp_"), "component_id", F.col("root").alias("group_"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, ``fp`` and ``component_id``, the smallest id reachable over links."""
    own = cut(fingerprints(docs.select(F.col(doc_id).alias("id_"), text), text))
    known = components_of(own)
    return own.join(known, own.fp == known.fp_).select(F.col("id_").alias(doc_id), "fp", "component_id")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near copies: that with the smallest id (null ids come last), then fingerprint and text hash.

    Rows are told apart by id and text, so rows that share an id but not their text are judged by themselves.
    Of rows that are equal in both, the one with the least JSON form stays.
    """
    key = F.xxhash64(F.coalesce(text, F.lit("")))
    own = docs.select(F.col(doc_id).alias("id_"), key.alias("text_hash"), F.col(text).alias("text_"))
    own = cut(fingerprints(own, "text_"))
    known = components_of(own)
    order = F.struct(F.col("id_").isNull().alias("last"), "id_", "fp", "text_hash")
    of_group = own.join(known, own.fp == known.fp_).groupBy("group_").agg(F.min(order).alias("b")).select("b.id_", "b.text_hash")
    kept = cut(of_group)
    id_, hash_, often = (unused(n, docs) for n in ("kept_id_", "kept_hash_", "kept_row_"))
    picks = kept.select(F.col("id_").alias(id_), F.col("text_hash").alias(hash_))
    rows = docs.join(picks, docs[doc_id].eqNullSafe(F.col(id_)) & (key == F.col(hash_)), "left_semi")
    copies = own.join(kept, own.id_.eqNullSafe(kept.id_) & (own.text_hash == kept.text_hash), "left_semi")
    if copies.count() > kept.count():
        row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
        rows = rows.groupBy(F.col(doc_id).alias(id_), key.alias(hash_)).agg(F.min_by(row, F.to_json(row)).alias(often)).select(f"{often}.*")
    return rows
