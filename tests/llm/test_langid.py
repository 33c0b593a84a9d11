import zlib

import numpy as np
import pyarrow as pa
from docassay.llm import langid, queries


def slow_subwords(text):
    """Runs of 3 and 4 bytes without a gap inside, by position."""
    import re

    s = re.sub(rb"[^0-9a-z\x80-\xff]", b" ", (" " + text + " ").lower().encode())
    out = []
    for k in (3, 4):
        out += [s[i : i + k] for i in range(len(s) - k + 1) if b" " not in s[i + 1 : i + k - 1]]
    return sorted(out)


def test_held_out_accuracy_and_calibration(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = queries.op4_language(spark, "/root/testdata/sf0.01").collect()
    assert len(got) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    right = [r.lang_pred == truth[r.doc_id] for r in held]
    assert np.mean(right) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert np.mean([r.rejected for r in held]) < 0.2
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.05


def test_the_sum_of_rows_is_the_mean_embedding():
    texts = ["Der Hund, the dog!", "", "ab", None, "Élan vital 12"]
    rng = np.random.default_rng(0)
    rows = rng.random((1 << langid.BUCKET_BITS, 3)).astype(np.float32)
    column = pa.array(texts)
    bucket, first = langid.subwords(column)
    total, number = langid.logits(column, rows)
    for i, t in enumerate(texts):
        own = bucket[first[i] : first[i + 1]]
        assert len(own) == number[i] == len(slow_subwords(t.replace("É", "é") if t else ""))
        assert np.allclose(total[i], rows[own].sum(0), atol=1e-4)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score string, key int"
    base = [(i, t, l, "x", 1) for i, (t, l) in enumerate([("the cat sat on the mat " * 3, "en"), ("der hund lag auf dem gras " * 3, "de")] * 10)]
    rows = [*base, (100, None, "en", "x", 1), (101, "", None, "x", 1), (102, "12 34 !?", "en", "x", 1), (None, "the mat " * 20000, "en", "x", 1), (103, "a", None, "x", 1), (103, "a", None, "x", 1), (104, "漢字", None, "x", 1)]
    d = spark.createDataFrame(rows, schema)
    model = langid.train(d)
    out = langid.predict(d, model)
    assert out.columns == ["doc_id", "lang", "key", "lang_pred", "score", "rejected"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0) and got[None][0] == "en" and got[0][0] == "en" and got[1][0] == "de"
    assert got[103][0] in ("en", "de") and got[104][0] in ("en", "de") and out.count() == len(rows)
    assert {r.lang_pred for r in langid.predict(d, langid.train(d.withColumn("lang", d.lang.substr(9, 1)).where("false"))).collect()} == {"und"}
    assert langid.predict(d.limit(0), model).count() == 0


def test_query_against_slow_sums(spark, sf_dir):
    """Every row's prediction from a plain list of its subwords, with the query's own model."""
    from pyspark.sql import functions as F

    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(d.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    got = {r.doc_id: r for r in queries.op4_language(spark, sf_dir).collect()}
    for r in d.collect():
        text = r.text.encode()
        keys = []
        for w in slow_subwords(langid.lowered(np.frombuffer(text, np.uint8)).tobytes().decode()):
            x = int.from_bytes(w, "little")
            keys.append(((x * 2654435761 if len(w) == 3 else (x ^ 0xA5A5A5A5) * 2246822519) % (1 << 32)) >> (32 - langid.BUCKET_BITS))
        z = (model.rows[keys].astype(float).mean(0) if keys else 0) + model.bias
        p = np.exp(z / model.temperature - (z / model.temperature).max())
        p /= p.sum()
        assert got[r.doc_id].lang_pred == model.languages[int(p.argmax())] and np.isclose(got[r.doc_id].score, p.max(), atol=1e-4)


def test_a_long_labelled_text_is_learned(spark):
    long = "zorg blix quam " * 80_000
    rows = [(i, "the cat sat on the mat", "en") for i in range(20)] + [(100 + i, long + str(i), "xx") for i in range(6)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(spark.createDataFrame([(1, "blix zorg quam zorg")], "doc_id long, text string"), langid.train(d)).first()
    assert found.lang_pred == "xx"
