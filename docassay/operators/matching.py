"""Joins at the scale of sets: token links, anchor coverage, routing of comparisons to rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N
from ..sources.folders import scratch

#: What the rules are called, in the order in which they are shown.
TITLES = {
    "brand": "Brand name", "classType": "Class / type designation", "abv": "Alcohol by volume (ABV)", "netContents": "Net contents",
    "producerOrigin": "Producer & country of origin", "governmentWarning": "Government warning",
}
#: The compared fields that stand under each row of a report.
ROUTE = [("brand", "brandName"), ("classType", "classType"), ("producerOrigin", "producer"), ("producerOrigin", "countryOfOrigin"), ("wine", "wineVarietal"), ("wine", "wineAppellation")]
WINE_FIELDS = ["wineVarietal", "wineAppellation"]


def surfaces(field: Column, status: Column) -> Column:
    return F.when(field.isin(WINE_FIELDS), status != "not_applicable").otherwise(status.isin("mismatch", "not_on_label"))


def with_rule_titles(results: DataFrame) -> DataFrame:
    """Rule results with the title and place of their rule; the rules are a handful of rows."""
    dim = results.sparkSession.createDataFrame([(k, v, i) for i, (k, v) in enumerate(TITLES.items())], "rule_id string, title string, display_order int")
    return results.join(F.broadcast(dim), "rule_id")


def compare_by_rule(checked: DataFrame) -> DataFrame:
    """doc_id, rule_id, surfaced, matched, missing: what the comparisons under each row of a report say."""
    rule = F.coalesce(*[F.when(F.col("field_id") == field, name) for name, field in ROUTE])
    status = F.col("status")
    return checked.groupBy("doc_id", rule.alias("rule_id")).agg(
        F.bool_or(status.isin("mismatch", "not_on_label")).alias("surfaced"), F.bool_or(status == "match").alias("matched"), F.bool_or(status == "not_on_application").alias("missing")
    )


def rarest_first(names: DataFrame, column: str, frequency: DataFrame) -> DataFrame:
    """``names`` with ``ranked``: the tokens of ``column`` from the rarest to the most frequent one; equally rare ones by name."""
    rows = names.select(column, F.explode(F.split(column, " ")).alias("token")).join(frequency, "token")
    return rows.groupBy(column).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "token"))), lambda x: x["token"]).alias("ranked"))


def token_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """left_id, right_id, shared, score of all pairs that share enough producer tokens.

    Only different names are compared. Tokens are ordered by how many names hold them. Sets that
    overlap by the threshold share a token among the first of both orders (prefix filter), and a
    set within another holds its own rarest token in it; so candidates meet on rare tokens, and a
    token that most names hold joins almost nothing. Candidates are then compared exactly.
    """

    def own(df: DataFrame, key: str) -> DataFrame:
        return df.select(key, F.array_join(F.array_sort(N.producer_tokens(F.col("v"))), " ").alias(f"{key}_name")).where(F.col(f"{key}_name") != "")

    a_rows, b_rows = own(left, "left_id"), own(right, "right_id")
    a_names, b_names = a_rows.select(F.col("left_id_name").alias("name")).distinct(), b_rows.select(F.col("right_id_name").alias("name")).distinct()
    frequency = a_names.unionByName(b_names).select(F.explode(F.split("name", " ")).alias("token")).groupBy("token").agg(F.count("*").alias("n"))

    def keys(names: DataFrame, side: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        ranked = rarest_first(names, "name", frequency).withColumnRenamed("name", side)
        size = F.size("ranked")
        prefix = size - F.ceil(size * K.PRODUCER_THRESHOLD).cast("int") + 1
        token = lambda arr: ranked.select(side, F.explode(arr).alias("token"))
        return token(F.slice("ranked", 1, prefix)), token(F.slice("ranked", 1, 1)), token(F.col("ranked"))

    (a_prefix, a_first, a_all), (b_prefix, b_first, b_all) = keys(a_names, "a"), keys(b_names, "b")
    meets = [x.join(y, "token").select("a", "b") for x, y in ((a_prefix, b_prefix), (a_first, b_all), (a_all, b_first))]
    pairs = reduce(DataFrame.unionByName, meets).distinct()
    n, m = F.size(F.split("a", " ")), F.size(F.split("b", " "))
    pairs = pairs.withColumns({"shared": F.size(F.array_intersect(F.split("a", " "), F.split("b", " "))).cast("long"), "n": n, "m": m})
    score = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    kept = pairs.where((score >= K.PRODUCER_THRESHOLD) | ((F.col("n") >= 2) & (F.col("shared") == F.col("n"))) | ((F.col("m") >= 2) & (F.col("shared") == F.col("m")))).withColumn("score", F.round(score, 9))
    return kept.join(a_rows, F.col("a") == F.col("left_id_name")).join(b_rows, F.col("b") == F.col("right_id_name")).select("left_id", "right_id", "shared", "score")


def anchor_join(docs: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """doc_id, item_id, matched, coverage: the documents that hold at least ``share`` of an item's content tokens.

    A document that covers an item holds at least one of any n - share x n + 1 of its n tokens. The
    ones that the fewest documents hold are the item's seeds: documents and items meet on seeds
    only, and frequent tokens join nothing. Candidates are then compared exactly. Documents are cut into tokens once; of
    these only the ones that any item holds are kept, in the shared folder.
    """
    anchors = items.select("item_id", F.explode(F.array_distinct(N.content_tokens(F.col("text")))).alias("token")).distinct()
    path = scratch(docs.sparkSession, "anchors")
    tokens = docs.select("doc_id", F.explode(N.content_tokens(F.col("text"))).alias("token"))
    tokens.join(anchors.select("token").distinct(), "token", "left_semi").distinct().write.parquet(path + "/tokens")
    held = docs.sparkSession.read.parquet(path + "/tokens")
    frequency = held.groupBy("token").agg(F.count("*").alias("n"))
    ranked = anchors.join(frequency, "token", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))).alias("r"))
    size = F.size("r")
    needed = size - F.ceil(size * F.lit(share) - 1e-9).cast("int") + 1
    seeds = ranked.select("item_id", F.explode(F.slice("r", 1, needed)).alias("x")).select("item_id", "x.token")
    pairs = held.join(seeds, "token").select("doc_id", "item_id").distinct()
    found = pairs.join(anchors, "item_id").join(held, ["doc_id", "token"]).groupBy("doc_id", "item_id").agg(F.count("*").alias("matched"))
    found = found.join(ranked.select("item_id", size.alias("n")), "item_id").where(F.col("matched") / F.col("n") >= share)
    return found.select("doc_id", "item_id", "matched", F.round(F.col("matched") / F.col("n"), 9).alias("coverage"))
