import numpy as np
from docassay.llm import quality, sampling, toxicity
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark, sizes):
    docs = spark.createDataFrame([(i, f"{i} " + "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 2) for i in range(len(sizes))], "doc_id long, y int")


def test_no_length_matters(spark):
    docs, labels = table(spark, [10] * 30 + [1 << 20] * 10)
    assert sampling.labelled(docs, labels, "y", 100).count() == 40
    short, _ = table(spark, [10] * 40)
    few = [{r.i for r in sampling.labelled(d, labels, "y", 12).select(F.substring_index("t", " ", 1).alias("i")).collect()} for d in (docs, short)]
    assert len(few[0]) == 12 and few[0] == few[1]


def test_labels_without_a_text_take_no_place(spark):
    docs, labels = table(spark, [10] * 40)
    assert sampling.labelled(docs.where("doc_id >= 30"), labels, "y", 10).count() == 10


def test_repeated_rows_count_once(spark):
    docs, labels = table(spark, [10] * 3)
    sample = sampling.labelled(docs.union(docs), labels.union(labels.withColumn("y", F.lit(7)).where("doc_id = 1")), "y", 100)
    size = lambda: lambda column: {"n": np.array([len(x.as_py()) for x in column], np.int32)}
    rows = sampling.features(sample, 100, size, [T.StructField("n", T.IntegerType())])
    assert sorted((r.y, r.n) for r in rows.collect()) == [(0, 12), (0, 12), (1, 12), (7, 12)]
    # An id with more texts than the bound does not exceed it.
    hot = spark.range(500).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    assert sampling.features(sampling.labelled(hot, labels, "y", 20), 20, size, [T.StructField("n", T.IntegerType())]).count() == 20


def test_a_long_labelled_text_changes_the_model(spark):
    body = " ".join(f"plain{i % 5000}" for i in range(150_000))
    rows = [(i, f"word{i % 9} other{i % 7}", i % 4 == 0) for i in range(400)]
    rows = [(i, t + " nasty" * bad, bad) for i, t, bad in rows]
    long = [(1000 + i, body + f" vile{i % 2}" + f" end{i}", True) for i in range(12)]
    docs = lambda own: spark.createDataFrame([(i, t) for i, t, _ in own], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in [*rows, *long]], "doc_id long, toxic int")
    assert len(long[0][1]) > 1 << 20
    one, two = (toxicity.train(docs(own), labels) for own in (rows, [*rows, *long]))
    assert len(two.bucket) > len(one.bucket)
    probe = spark.createDataFrame([(1, "x vile0 y vile1")], "doc_id long, text string")
    assert not toxicity.score(probe, one).first().toxic and toxicity.score(probe, two).first().severity > toxicity.score(probe, one).first().severity


def test_quality_learns_from_long_texts_only(spark):
    docs, labels = table(spark, [60_000] * 8)
    assert quality.train(docs, labels.withColumnRenamed("y", "quality")) is not None
