import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from docassay.llm import queries, toxicity
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d.where("doc_id % 2 = 0"), labels)
    got = {r.doc_id: r for r in toxicity.score(d.where("doc_id % 2 = 1 and lang = 'en'").select("doc_id", "text"), model).collect()}
    truth = [(got[r.doc_id], r.toxic) for r in labels.collect() if r.doc_id in got]
    hit = [r.toxic for r, y in truth if y]
    false = [r.toxic for r, y in truth if not y]
    assert np.mean(hit) > 0.9 and np.mean(false) < 0.002
    assert np.mean([r.severity for r, y in truth if y]) > 1 > 0.3 > np.mean([r.severity for r, y in truth if not y])


def test_thresholds_share_weights_and_are_ordered():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 3))
    z = x @ np.array([4.0, -2.0, 0.0]) + rng.logistic(size=4000)
    grade = np.searchsorted([0.0, 1.5, 3.0], z)
    model = toxicity.fit(x, grade, np.arange(3), ridge=0, rounds=1500)
    assert np.allclose(model.weight, [4, -2, 0], atol=0.5) and np.allclose(model.cut, [0, 1.5, 3], atol=0.4)
    above = model.above(x)
    assert (np.diff(above, axis=1) <= 0).all()


def test_query_and_odd_rows(spark, sf_dir):
    got = queries.op1_toxicity(spark, sf_dir)
    assert got.columns == ["doc_id", "grade", "severity", "toxic"] and got.count() == 200
    schema = "doc_id long, text string, grade string, toxic string, y int"
    rows = [(1, None, "a", "b", 1), (2, "", "a", "b", 1), (None, "word " * 50000, "a", "b", 1), (2, "", "a", "b", 1)]
    d = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0), (2, 0), (2, 0)], "doc_id long, toxic int")
    for model in (toxicity.train(d, labels), toxicity.train(d, labels.limit(0))):
        out = toxicity.score(d, model, keep_text=True)
        assert out.columns == ["doc_id", "text", "y", "grade", "severity", "toxic"] and out.count() == 4
        assert toxicity.score(d.limit(0), model).count() == 0


def test_rarer_tokens_are_learned_in_other_languages(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d.where("doc_id % 2 = 0"), labels)
    got = toxicity.score(d.where("doc_id % 2 = 1").select("doc_id", "lang", "text"), model).withColumnRenamed("toxic", "found")
    rows = got.join(labels, "doc_id").select("lang", "toxic", "found").collect()
    for lang, least in {"de": 0.6, "en": 0.9, "fr": 0.8}.items():
        hit = [r.found for r in rows if r.lang == lang and r.toxic]
        false = [r.found for r in rows if r.lang == lang and not r.toxic]
        print(lang, np.mean(hit), np.mean(false))
        assert np.mean(hit) > least and np.mean(false) < 0.05


def held(texts, toxic):
    """(n, hit) of each hashed token."""
    n, hit = np.zeros((2, 1 << toxicity.BITS))
    for tokens, y in zip(toxicity.token_counts(pa.array(texts))["bucket"].to_pylist(), toxic):
        n[tokens] += 1
        hit[tokens] += y
    return n, hit, np.mean(toxic)


def test_bar_does_not_grow_with_the_sample():
    plain = [f"plain{i % 50} text{i % 7}" for i in range(8000)]
    toxic = np.zeros(8000)
    toxic[:800] = 1
    texts = [f"{t} rare{i // 10}" if i < 800 else t for i, t in enumerate(plain)]
    assert len(toxicity.indicative(*held(texts, toxic))) == 80
    many = [f"{t} word{i // 2}" if i < 800 else t for i, t in enumerate(plain * 2)]
    many = [f"{t} rare{i % 300}" if 8000 <= i < 10400 else t for i, t in enumerate(many)]
    mark = np.zeros(16000)
    mark[8000:10400] = 1
    assert len(toxicity.indicative(*held(many, mark))) == 300  # more than any cap of 256


def slow_model(texts, labels):
    """The same model from lists of words: evidence by fold, grades by the other folds' tokens, plain loops."""
    rows = sorted({(toxicity_key(t), y, t) for t, y in zip(texts, labels)})
    words = [[bucket_of(w) for w in re.findall(r"[a-z0-9]+", t.lower())] for *_, t in rows]
    key, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    fold = key % toxicity.FOLDS
    n, hit = np.zeros((2, toxicity.FOLDS, 1 << toxicity.BITS))
    for k, w, bad in zip(fold, words, y > 0):
        own = list(set(w))
        n[k, own] += 1
        hit[k, own] += bad
    table = [(int(k), int(v), b, c) for k, v, w in zip(key, y, words) for b, c in sorted(Counter(w).items())]
    counts = lambda bucket: pa.table(dict(zip(("key_", "y", "b", "often"), map(list, zip(*[r for r in table if r[2] in wanted(bucket)])))))
    return toxicity.fit_sample(key, y, n, hit, counts)


def wanted(bucket, held={}):  # noqa: B006
    return held.setdefault(id(bucket), set(bucket.tolist()))


def toxicity_key(t):
    return KEYS[t]


@lru_cache(None)
def bucket_of(word):
    return toxicity.token_counts(pa.array([word]))["bucket"].to_pylist()[0][0]


KEYS = {}


def test_query_against_a_model_of_word_lists(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    d = d.withColumn("text", F.regexp_replace("text", "[^\\x00-\\x7f]", ""))
    KEYS.update({r.text: r.k for r in d.select("text", F.xxhash64("text").alias("k")).collect()})
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = d.collect()
    want = slow_model(*zip(*[(r.text, truth[r.doc_id]) for r in rows if truth.get(r.doc_id) is not None]))
    model = toxicity.train(d, labels)
    assert (model.bucket == want.bucket).all() and len(model.bucket) and np.allclose(model.weight, want.weight, atol=1e-6) and np.isclose(model.least, want.least, atol=1e-9)
    got = {r.doc_id: r for r in toxicity.score(d.select("doc_id", "text"), model).collect()}
    weight = dict(zip(want.bucket.tolist(), want.weight))
    for r in rows:
        own = Counter(bucket_of(w) for w in re.findall(r"[a-z0-9]+", r.text.lower()))
        z = sum(weight[b] * np.log1p(n) for b, n in own.items() if b in weight)
        above = 1 / (1 + np.exp(want.cut - z))
        assert np.isclose(got[r.doc_id].severity, above.sum()) and got[r.doc_id].toxic == (above[0] >= want.least)


def test_graded_labels_are_used_as_they_are(spark):
    rng = np.random.default_rng(3)
    level = rng.integers(0, 4, 600)
    rows = [(i, f"plain{i % 13} " + "bad " * int(3 * g) + f"w{i}", int(g)) for i, g in enumerate(level)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(d.select("doc_id", "text"), toxicity.train(d, d)).collect()
    assert np.mean([abs(r.severity - level[r.doc_id]) < 0.5 for r in got]) > 0.95


def test_every_label_is_a_grade(spark):
    import random

    rng = random.Random(3)
    words = {0: ["calm", "river"], 1: ["mild", "rude"], 4: ["harsh", "vile"], 7: ["brutal", "foul"]}
    rows, labels = [], []
    for i in range(800):
        y = [0, 0, 0, 1, 4, 7][i % 6]
        text = [f"w{rng.randrange(300)}" for _ in range(20)] + ([rng.choice(words[y]) for _ in range(3)] if y else [])
        rng.shuffle(text)
        rows.append((i, " ".join(text)))
        labels.append((i, y))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert model.values.tolist() == [0, 1, 4, 7] and len(model.cut) == 3 and (np.diff(model.cut) > 0).all()
    found = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    mean = {y: np.mean([found[i].severity for i, v in labels if v == y]) for y in (0, 1, 4, 7)}
    assert mean[0] < mean[1] < mean[4] < mean[7] and mean[7] > 4
    assert {found[i].grade for i, _ in labels} <= {0, 1, 4, 7} and sum(found[i].grade == y for i, y in labels) > 600


def test_recall_by_language(spark):
    """Toxic rows of every language with many labels are found; held-out rows."""
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = toxicity.train(d.where("doc_id % 4 <> 1"), labels)
    rows = toxicity.score(d.where("doc_id % 4 = 1"), model).select("doc_id", "lang", F.col("toxic").alias("found")).join(labels, "doc_id").collect()
    share = lambda lang: np.mean([r.found for r in rows if r.toxic and (lang is None or r.lang == lang)])
    print({lang: (share(lang), sum(r.toxic for r in rows if r.lang == lang)) for lang in ("en", "fr", "de", "es")})
    assert share("en") > 0.8 and share(None) > 0.8
    assert np.mean([r.found for r in rows if not r.toxic]) < 0.01
