"""What texts name of a lexicon, at the scale of tables: each different text is read once, and its words meet an index of the keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N

ID = "lexicon_text_id_"


def lexicon(spark: SparkSession, entries: dict[str, list[str]]) -> DataFrame:
    """A constant lexicon (canonical name: other names) as the table that ``lexicon_join`` takes."""
    names = [(name, canonical) for canonical, others in entries.items() for name in (canonical, *others)]
    return spark.createDataFrame([(key, name, i) for i, (key, name) in enumerate(names)], "key string, name string, place int")


def keys_of(table: DataFrame) -> DataFrame:
    """text, name, words, rank of a lexicon (key, name, place): keys as they stand in ``lexicon_text``; the longest comes first, equally long ones by ``place`` and name."""
    keys = table.select(N.lexicon_text(F.col("key")).alias("text"), "name", "place").where((F.col("text") != "") & F.col("name").isNotNull())
    rank = F.struct((-F.length("text")).alias("size"), "place", "name")
    return keys.groupBy("text", "name").agg(F.min(rank).alias("rank")).withColumn("words", F.size(F.split("text", " ")))


def candidates(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """ID, rank, name, key, at, size: the first place (in words) of every key in every text (ID, text).

    A word meets the index of first words, which tells how many words the keys that begin with it have; only runs of so many words then meet the
    keys, by equality. So a word with which many keys begin multiplies nothing, and neither does a key that many texts hold.
    """
    longest = keys.agg(F.max("words")).first()[0] or 0  # one number
    starts = keys.groupBy(F.element_at(F.split("text", " "), 1).alias("word")).agg(F.collect_set("words").alias("sizes"))
    # Bound once a text: split inside the lambda, a text would be split again for each of its words.
    run = lambda words: N.once(words, lambda all_: F.transform(all_, lambda w, i: F.struct(w.alias("word"), F.slice(all_, i + 1, longest).alias("next"))))
    begun = texts.select(ID, F.posexplode(run(F.split("text", " "))).alias("at", "r")).select(ID, "at", "r.word", "r.next").join(starts, "word")
    tried = begun.select(ID, "at", "next", F.explode("sizes").alias("size")).where(F.size("next") >= F.col("size"))
    met = tried.select(ID, "at", "size", F.array_join(F.slice("next", 1, F.col("size")), " ").alias("key")).join(keys.withColumnRenamed("text", "key").drop("words"), "key")
    return met.groupBy(ID, "rank", "name", "key", "size").agg(F.min("at").alias("at"))


def lexicon_join(rows: DataFrame, column: str, table: DataFrame, out: str) -> DataFrame:
    """``rows`` with ``out``: the names of the lexicon that a text holds, by the greedy choice of ``normalize.lexicon_found``.

    table: key, name, place (any type that can be ordered; the order among equally long keys), of any size. Each different text is read once, however many rows
    hold it; only matches are shuffled, by a hash of their text, and joined back. Null and empty texts, and an empty lexicon, give an empty
    array. A column ``out`` of the rows is replaced; all others stay.
    """
    text = N.lexicon_text(F.col(column))
    texts = rows.select(text.alias("text")).distinct().select(F.unhex(F.sha2("text", 256)).alias(ID), "text")
    held = candidates(texts, keys_of(table)).groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("rank", "at", "size", "name", "key"))).alias("held"))
    placed = F.transform("held", lambda e: F.struct((e["at"] + 1).alias("at"), e["size"].alias("size"), e["name"].alias("name"), e["key"].alias("key")))
    names = held.select(ID, F.transform(N.greedy(placed), lambda e: e["name"]).alias("lexicon_names_"))
    kept = [c for c in rows.columns if c != out]
    joined = rows.select(*kept, F.unhex(F.sha2(text, 256)).alias(ID)).join(names, ID, "left")
    return joined.select(*kept, F.coalesce("lexicon_names_", F.array().cast("array<string>")).alias(out))
