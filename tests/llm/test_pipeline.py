import re

import corpus_pipeline
import pytest
from docassay.llm import decontam

from .test_simhash import slow_components, slow_fingerprint
from .test_spans import brute


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return {k: (v.columns, {r.doc_id: r for r in v.collect()}) for k, v in out.items()}


def test_columns_stay(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][0] == stages["documents"][0]


def test_toxicity(stages):
    before, after = stages["documents"][1], stages["toxicity"][1]
    insult = re.compile(r"\b(idiot|moron|clown|stupid|loser|worthless|pathetic|scum|disgusting|trash)\b", re.I)
    for i, r in before.items():
        if i not in after:
            assert insult.search(r.text)


def test_near_dedup(stages):
    before = {i: slow_fingerprint(r.text) for i, r in stages["toxicity"][1].items()}
    assert set(stages["simhash_near_dedup"][1]) == set(slow_components(before).values())


def test_substring_dedup(stages):
    before, after = stages["simhash_near_dedup"][1], stages["substring_dedup"][1]
    short = lambda t: all(len(re.findall(r"[^\W_]+", s)) <= 12 for s in re.split(r"\n|(?<=[.!?])\s", t))
    want = brute([(i, r.text) for i, r in before.items()])
    for i, r in before.items():
        if short(r.text) and want[i][1]:
            assert i not in after or len(after[i].text) < len(r.text)
        if i in after:
            assert after[i].n_chars == len(after[i].text)
            assert set(re.findall(r"\w+", after[i].text)) <= set(re.findall(r"\w+", r.text))


def test_decontamination(spark, sf_dir, stages):
    before, after = stages["substring_dedup"][1], stages["decontamination"][1]
    docs = spark.createDataFrame(list(before.values()))
    leaked = {r.doc_id for r in decontam.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert set(after) == set(before) - leaked and all(after[i] == before[i] for i in after)


def test_mixing(stages):
    rows = stages["mixing"][1]
    assert set(rows) == set(stages["decontamination"][1]) and all(r.rate >= 0 for r in rows.values())
    total = sum(r.n_tokens for r in rows.values())
    for name, share in corpus_pipeline.SHARES.items():
        assert abs(sum(r.rate * r.n_tokens * r[f"p_{name}"] for r in rows.values()) / total - share) < 1e-3


def test_run(spark, sf_dir, stages):
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(stages["mixing"][1])


def test_stages_on_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic string, leaks int, n_removed int, rate int"
    rows = [(1, None, None, None, None, "x", 1, 1, 1), (2, "", "en", "s", 0, "x", 1, 1, 1), (None, "some text", "en", "s", 9, "x", 1, 1, 1), (3, "word " * 30000, "en", "s", 1, "x", 1, 1, 1), (3, "word " * 30000, "en", "s", 1, "x", 1, 1, 1)]
    for table in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns and out.count() <= table.count()
        assert corpus_pipeline.set_rates(spark, table, sf_dir).count() == table.count()
