import numpy as np
import pyarrow as pa
from docassay.llm import quality, queries
from pyspark.sql import functions as F


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.train(d.where("doc_id % 2 = 0"), labels)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.evidence(d.where("doc_id % 2 = 1").select("doc_id", "text"), model).collect()
    pairs = [(r.evidence, truth[r.doc_id]) for r in rows if r.doc_id in truth]
    good, bad = [e for e, y in pairs if y], [e for e, y in pairs if not y]
    auc = np.mean([np.mean([g > b for b in bad]) for g in good])
    print("auc", auc, np.mean([g > 0 for g in good]), np.mean([b < 0 for b in bad]))
    assert auc > 0.9


def test_posteriors_against_plain_arithmetic(spark):
    rng = np.random.default_rng(1)
    rows = [(f"h{h}", f"h{h}/p{p}", float(rng.beta(2 + h, 4))) for h in range(5) for p in range(3) for _ in range(int(rng.integers(1, 30)))]
    got, mean, *_ = quality.posteriors(spark.createDataFrame(rows, "host_ string, path_ string, p double"))
    all_p = np.array([p for *_, p in rows])
    assert abs(mean - all_p.mean()) < 1e-12

    def strength(groups):
        n = np.array([len(v) for v, _ in groups.values()])
        within = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v, _ in groups.values()) / (n.sum() - len(n))
        between = sum(len(v) * (np.mean(v) - m) ** 2 for v, m in groups.values())
        return min(max(within / max((between - (len(n) - 1) * within) / (n.sum() - (n**2).sum() / n.sum()), 1e-12), 1.0), 1e6)

    hosts = {h: ([p for a, _, p in rows if a == h], mean) for h in {r[0] for r in rows}}
    k = strength(hosts)
    host = {h: (sum(v) + k * mean) / (len(v) + k) for h, (v, _) in hosts.items()}
    paths = {(h, q): ([p for a, b, p in rows if (a, b) == (h, q)], host[h]) for h, q in {r[:2] for r in rows}}
    k = strength(paths)
    for r in got.collect():
        v, m = paths[r.host_, r.path_]
        assert abs(r.host_posterior - host[r.host_]) < 1e-9 and abs(r.path_posterior - (sum(v) + k * m) / (len(v) + k)) < 1e-9


def test_shape_features():
    x = quality.shape(pa.array(["a b a\nc. D!", "", None, "12 12 12 |"]))
    assert x.shape[0] == 4 and np.isfinite(x).all() and (x[1] == x[2]).all()
    assert np.isclose(x[3, -3], 2 / 3) and np.isclose(np.expm1(x[0, -1]), 4)


def test_query_and_odd_rows(spark, sf_dir):
    assert queries.op3_quality(spark, sf_dir).count() == 200
    schema = "doc_id long, text string, source string, evidence string, host_ string, p int"
    rows = [(1, None, "s", "x", "x", 1), (2, "", None, "x", "x", 1), (None, "w " * 60000, "s", "x", "x", 1), (2, "", None, "x", "x", 1)]
    d = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")
    for docs in (d, d.limit(0)):
        out = quality.grade(docs, quality.train(docs, labels), F.col("source"), F.col("source"))
        assert out.count() == docs.count() and all(0 <= r.quality <= 1 for r in out.collect())


def test_query_against_plain_arithmetic(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.withColumn("host", F.col("source")).withColumn("path", F.concat_ws("/", "source", "lang")).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    key = {r.doc_id: r.k for r in docs.select("doc_id", F.xxhash64("text").alias("k")).collect()}
    sample = sorted({(key[r.doc_id], truth[r.doc_id], r.text) for r in rows if truth.get(r.doc_id) is not None})
    model = quality.fit(np.concatenate([quality.shape(pa.array([t])) for *_, t in sample]), np.array([float(y > 0) for _, y, _ in sample]))
    odds = {r.doc_id: float(model.log_odds(quality.shape(pa.array([r.text])))[0]) for r in rows}
    p = {i: 1 / (1 + np.exp(-z)) for i, z in odds.items()}
    mean = np.mean(list(p.values()))
    _, _, of_host, of_path = quality.posteriors(spark.createDataFrame([(r.host, r.path, float(p[r.doc_id])) for r in rows], "host_ string, path_ string, p double"))
    want = {}
    for r in rows:
        host = [p[o.doc_id] for o in rows if o.host == r.host and o is not r]
        path = [p[o.doc_id] for o in rows if o.path == r.path and o is not r]
        prior = (sum(path) + of_path * (sum(host) + of_host * mean) / (len(host) + of_host)) / (len(path) + of_path)
        want[r.doc_id] = 1 / (1 + np.exp(-(odds[r.doc_id] + np.log(prior / (1 - prior)) - np.log(mean / (1 - mean)))))
    got = {r.doc_id: (r.quality, r.keep) for r in queries.op3_quality(spark, sf_dir).collect()}
    assert set(got) == set(want) and all(np.isclose(got[i][0], q, atol=1e-6) and got[i][1] == (got[i][0] >= 0.5) for i, q in want.items())


def test_one_giant_group_and_ties(spark):
    rows = [(i, "Same words in every text here.", "hot") for i in range(300)] + [(1000 + i, f"Text {i}.", f"h{i}") for i in range(5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1000, 1), (1001, 0)], "doc_id long, quality int")
    out = quality.grade(d, quality.train(d, labels), F.col("source"), F.col("source")).collect()
    assert len(out) == 305 and len({r.quality for r in out if r.host == "hot"}) == 1
