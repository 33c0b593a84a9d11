"""Bounded samples of labelled rows for fitting models on the driver.

Only the number of rows is bounded. Texts are turned into features in tasks, whole and whatever their
length, and the driver collects features, never texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_text
from .cluster import cut


def thinned(df: DataFrame, h: Column, rows: int) -> DataFrame:
    """The ``rows`` rows of ``df`` with the least hashes ``h`` (more, if hashes at the limit are equal); all, if there are no more."""
    least = [r[0] for r in df.select(h.alias("h_")).orderBy("h_").limit(rows + 1).collect()]
    return df if len(least) <= rows else df.where(h <= least[rows - 1])


def labelled(docs: DataFrame, labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(t, y): texts and labels of at most ``rows`` labelled ids that a document has, chosen by a hash of the id.

    ``labels`` has ``doc_id`` and ``label``; rows with a null id, text or label are left out. The text column is
    read once; what is broadcast are the chosen ids.
    """
    own = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("sample_id_"), F.col(label).alias("y")).distinct()
    present = own.join(docs.select(F.col(doc_id).alias("id_")), F.col("sample_id_") == F.col("id_"), "left_semi")
    picks = thinned(present, F.xxhash64(F.col("sample_id_").cast("string")), rows)
    texts = docs.select(F.col(doc_id).alias("id_"), F.col(text).alias("t")).where("t is not null")
    return texts.join(F.broadcast(picks), F.col("id_") == F.col("sample_id_")).select("t", "y")


def own_labels(docs: DataFrame, label: str, rows: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(t, y) of at most ``rows`` rows of ``docs`` that carry their label themselves, chosen by a hash of the id."""
    full = docs.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull())
    chosen = thinned(full, F.xxhash64(F.col(doc_id).cast("string")), rows)
    return chosen.select(F.col(text).alias("t"), F.col(label).alias("y")).where("t is not null")


def features(sample: DataFrame, rows: int, make: Callable, fields: list[T.StructField]) -> DataFrame:
    """(key_, y, fields) of each different (text, label) of a sample (t, y), computed in tasks and kept in the shared folder.

    key_ is a hash of the text. Rows beyond ``rows``, which repeated ids can bring, are thinned out by hash.
    """
    keyed = sample.select(F.xxhash64("t").alias("key_"), "y", "t")
    found = cut(map_text(keyed, "t", make, fields).dropDuplicates(["key_", "y"]))
    return thinned(found, F.xxhash64("key_", "y"), rows)
