"""The lexicon join against a plain greedy choice, and its edge cases."""

import random

from docassay.functions import constants as K
from docassay.functions import normalize as N
from docassay.operators import lexicon as L
from pyspark.sql import functions as F


def brute(text, entries):
    plain = f" {text.lower()} "
    held = []
    for key, name in N.lexicon_keys(entries):
        at = plain.find(f" {key} ")
        if at >= 0 and not any(name == n or (at < b and at + len(key) > a) for a, b, n in held):
            held.append((at, at + len(key), name))
    return [n for _, _, n in held]


def test_against_brute_force(spark):
    pick = random.Random(5)
    words = sorted({w for k, _ in N.lexicon_keys(K.VARIETALS) for w in k.split()})
    texts = [" ".join(pick.choice(words) for _ in range(pick.randrange(1, 40))) for _ in range(300)] + ["petite sirah petite syrah", "ruby cabernet sauvignon blanc", "garnacha blanca grenache blanc"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, v string").unionByName(spark.createDataFrame([(1000 + i, texts[-1]) for i in range(500)], "id int, v string"))
    found = L.lexicon_join(rows, "v", L.lexicon(spark, K.VARIETALS), "names").withColumn("other", N.lexicon_matches(F.col("v"), K.VARIETALS)).collect()
    assert len(found) == len(texts) + 500
    for r in found:
        assert r.names == brute(r.v, K.VARIETALS) == r.other, r


def test_a_refused_candidate_blocks_nothing(spark):
    rows = spark.createDataFrame([(1, "Petite Sirah, Petite Syrah")], "id int, v string")
    first, second = L.lexicon_join(rows, "v", L.lexicon(spark, K.VARIETALS), "names").first().names
    assert first == dict(N.lexicon_keys(K.VARIETALS))["petite sirah"] and second == dict(N.lexicon_keys(K.VARIETALS))["syrah"]


def test_edges(spark):
    table = L.lexicon(spark, {"A b": ["b"], "": ["!"], "C": []})
    rows = spark.createDataFrame([(None, None, 1), (1, "", 2), (2, " !? ", 3), (3, "x a  B c", 4), (3, "x a  B c", 4), (4, "b " * 50000 + "c", 5)], "id int, text string, names int")
    found = sorted((r.id or 0, r.names) for r in L.lexicon_join(rows, "text", table, "names").collect())
    assert found == [(0, []), (1, []), (2, []), (3, ["A b", "C"]), (3, ["A b", "C"]), (4, ["A b", "C"])]
    clash = rows.select("id", F.col("text").alias("key"), F.col("names").alias("word"))  # names that the operator uses itself
    assert L.lexicon_join(clash, "key", table, "found").columns == ["id", "key", "word", "found"]
    assert L.lexicon_join(rows.limit(0), "text", table, "names").count() == 0
    assert {tuple(r.names) for r in L.lexicon_join(rows, "text", table.limit(0), "names").collect()} == {()}
    assert L.lexicon_join(rows, "text", table.unionByName(table), "names").count() == rows.count()
