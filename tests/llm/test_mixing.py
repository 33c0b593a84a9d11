import re

import numpy as np
import pytest
from docassay.llm import mixing, queries
from pyspark.sql import functions as F


def slow_rates(a, targets):
    """Plain projected gradient on all rows, to convergence; returns the totals that it reaches."""
    inverse = np.linalg.inv(a.T @ a + 1e-9 * np.trace(a.T @ a) / len(targets) * np.eye(len(targets)))
    r = np.ones(len(a))
    for _ in range(20000):
        r = np.maximum(0, r - a @ (inverse @ (r @ a - targets)))
    return r @ a


@pytest.mark.parametrize("share, reachable", [([0.7, 0.2, 0.1], True), ([0.02, 0.02, 0.96], True), ([0.05, 0.9, 0.05], True), ([0.0, 0.0, 1.0], False)])
def test_rates_against_plain_arithmetic(spark, share, reachable):
    rng = np.random.default_rng(5)
    n = rng.integers(0, 500, 300)
    p = rng.dirichlet([0.3, 0.5, 0.7], 300) * 0.98 + 0.02 / 3
    rows = spark.createDataFrame([(i, int(n[i]), *map(float, p[i])) for i in range(300)], "doc_id long, n_tokens long, p_0 double, p_1 double, p_2 double")
    targets = np.array([float(x * n.sum()) for x in share])
    found = mixing.fit_rates(rows, targets.tolist())
    assert found.reached == reachable and found.rows.columns == [*rows.columns, "rate"]
    r = np.zeros(300)
    for x in found.rows.collect():
        r[x.doc_id] = x.rate
    a = n[:, None] * p
    assert (r >= 0).all() and np.allclose(found.totals, r @ a, rtol=1e-6, atol=1e-3)
    if reachable:
        assert np.abs(r @ a - targets).max() <= 1e-6 * targets.max() * 1.01
    else:
        inverse = np.linalg.inv(a.T @ a)
        size = lambda t: np.sqrt((t - targets) @ inverse @ (t - targets))
        assert size(r @ a) <= 2 * size(slow_rates(a, targets)) and size(r @ a) < 0.2 * size(a.sum(0))


def test_shares_out_of_reach_are_reported(spark):
    rows = [(i, "good " * 5 if i % 2 else "bad " * 5) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i % 2 else "bad") for i in range(20)], "doc_id long, d string")
    with pytest.warns(UserWarning, match="no nonnegative rates"):
        out = mixing.mix(d, labels, F.col("d"), {"good": 1.0}).toPandas()
    assert out.rate[out.doc_id % 2 == 0].max() < 0.1 < 0.5 < out.rate[out.doc_id % 2 == 1].min()


def test_labels_without_a_document_do_not_count(spark):
    docs = spark.createDataFrame([(i, f"good {i}") for i in range(10)] + [(10, "bad")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good") for i in range(10)] + [(10, "bad")] + [(100 + i, "bad") for i in range(5000)], "doc_id long, d string")
    names, prior, _ = mixing.train(docs, labels, F.col("d"))
    assert names == ["bad", "good"] and np.isclose(np.exp(prior[0] - prior[1]), 0.1)


def test_posteriors_against_plain_arithmetic(spark):
    docs = spark.createDataFrame([(1, "good words here good"), (2, "bad | | words"), (3, None), (4, "good |"), (5, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "good"), (2, "bad"), (4, "bad"), (9, "good")], "doc_id long, d string")
    names, prior, rate = model = mixing.train(docs, labels, F.col("d"))
    assert names == ["bad", "good"]
    bucket = {w: docs.sparkSession.range(1).select(mixing.bucket(F.lit(w))).first()[0] for w in "good words here bad |".split()}
    for r in mixing.posteriors(docs, model).collect():
        text = {1: "good words here good", 2: "bad | | words", 4: "good |"}.get(r.doc_id, "")
        w = re.findall(r"\S+", text)
        z = prior + sum((rate[:, bucket[x]] for x in w), np.zeros(2)) / max(1, len(w)) ** 0.5
        assert r.n_tokens == len(w) and np.allclose([r.p_0, r.p_1], np.exp(z) / np.exp(z).sum())


def test_query_hits_its_targets_and_tells_domains_apart(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op5_mixing(spark, sf).toPandas()
    assert len(rows) == 1000 and (rows.rate >= 0).all()
    total = rows.n_tokens.sum()
    for name, share in queries.SHARES.items():
        assert abs((rows.rate * rows.n_tokens * rows[f"p_{name}"]).sum() / total - share) < 1e-3
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas().merge(rows, on="doc_id")
    good = labels[(labels.quality == 1) & (labels.toxic == 0)]
    poor = labels[(labels.quality == 0) & (labels.toxic == 0)]
    assert good.p_good.mean() > poor.p_good.mean() + 0.2


def test_odd_rows(spark):
    schema = "doc_id long, text string, rate string, row_ int, domain_ string"
    rows = [(1, None, "x", 1, "x"), (2, "", "x", 1, "x"), (None, "word " * 40000, "x", 1, "x"), (3, "other word", "x", 1, "x"), (3, "other word", "x", 1, "x")]
    d = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, "a"), (3, "b"), (3, None), (None, "a"), (2, "a")], "doc_id long, d string")
    labels = labels.unionByName(spark.createDataFrame([(3, "a")], labels.schema))
    out = mixing.mix(d, labels, F.col("d"), {"a": 1.0, "b": 1.0})
    assert out.columns == ["doc_id", "n_tokens", "p_a", "p_b", "rate"] and out.count() == 5
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].n_tokens == got[2].n_tokens == 0 and got[1].rate == 1.0
    assert mixing.mix(d.limit(0), labels, F.col("d"), {"a": 1.0}).count() == 0
    assert mixing.mix(d, labels.limit(0), F.col("d"), {"a": 1.0}).count() == 5
    assert {r.rate for r in mixing.mix(d, labels, F.col("d"), {"zzz": 1.0}).collect()} == {1.0}
