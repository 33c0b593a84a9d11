import math
import re

import numpy as np
import pytest
from docassay.llm import queries, reversed_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=20):
    """docs, items: (id, text). Rows of items that share an id are one item; equal rows count once."""
    own = [(i, TERM.findall((t or "").translate(LOW))) for i, t in docs]
    own = [(i, ws) for i, ws in own if ws]
    n, length = len(own), sum(len(ws) for _, ws in own)
    df = {}
    for _, ws in own:
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    wanted = {}
    for i, t in dict.fromkeys(items):
        wanted.setdefault(i, []).extend(TERM.findall((t or "").translate(LOW)))
    out = set()
    for item, terms in wanted.items():
        scored = []
        for doc, ws in own:
            m = 75 + 25 * len(ws) * n // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * ws.count(w) // (1000 * ws.count(w) + 12 * m)) for w in terms if w in df and w in ws)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out |= {(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored)[:top])}
    return out


def random_tables(seed, docs=60, items=7):
    rng = np.random.default_rng(seed)
    vocabulary = ["the", "The", "of", "É", "é", "x1", "zeta", "qu", "日本", "a_b", "no-no", "rare%d"]
    text = lambda n: " ".join(v % rng.integers(5) if "%" in v else v for v in rng.choice(vocabulary, n))
    return [(i, text(int(rng.integers(0, 40)))) for i in range(docs)], [(i, text(int(rng.integers(0, 12)))) for i in range(items)]


@pytest.mark.parametrize("block", [reversed_search.BLOCK, 60, 1])
def test_against_brute_force(spark, block):
    docs, items = random_tables(block)
    docs += [(100, docs[3][1]), (101, docs[3][1]), (None, docs[3][1]), (3, docs[3][1]), (200, None), (201, ""), (202, "--- ")]
    items += [(50, None), (51, ""), (1, "zeta extra"), (None, "the zeta"), items[0], (52, "zeta " * 30), (53, "nowhere")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in reversed_search.search(d, i, block=block).collect()]
    assert set(got) == brute(docs, items) and len(got) == len(set(got))


def test_heaps_keep_the_best_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(reversed_search, "CELLS", 8)
    docs, items = random_tables(5, docs=200)
    d = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    i = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in reversed_search.search(d, i).collect()} == brute(docs, items)


def test_blocks_are_bounded_and_whole(spark):
    rows = [(f"i{k}", h, 1) for k in range(40) for h in range(1 + k % 7)] + [("large", h, 1) for h in range(900)]
    entries = spark.createDataFrame(rows, "item string, h long, often long")
    found = [(r.item, r.h, r.often, r.block) for r in reversed_search.blocks_of(entries, 200).collect()]
    assert sorted(x[:3] for x in found) == sorted(rows)
    blocks = {}
    for item, *_, block in found:
        blocks.setdefault(block, []).append(item)
    assert all(len(v) + reversed_search.TOP * len(set(v)) <= 200 or len(set(v)) == 1 for v in blocks.values())
    assert all(len({b for i, *_, b in found if i == item}) == 1 for item in {x[0] for x in found})


def test_norms_beyond_64_bits():
    n = np.array([10**9, 3], np.int64)
    assert reversed_search.norms(n, 10**12, 10**14).tolist() == [75 + 25 * 10**9 * 10**12 // 10**14, 75]


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([("a", "x y", 1, 2)], "doc_id string, text string, score int, item_id int")
    items = spark.createDataFrame([("q", "y", 1)], "item_id string, text string, rank int")
    got = reversed_search.search(docs, items).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("q", 1, "a")]
    assert reversed_search.search(docs.limit(0), items).count() == 0
    assert reversed_search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert reversed_search.search(docs, items.limit(0)).count() == 0


def test_query_at_the_smallest_scale(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    assert {tuple(r) for r in queries.op12_reversed_search(spark, sf_dir).collect()} == brute(docs, items)
