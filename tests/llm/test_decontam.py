import random
import re

import numpy as np
import pyarrow as pa
from docassay.llm import decontam, queries
from pyspark.sql import functions as F


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def slow_tiles(a, b, shortest):
    """Greedy string tiling by comparing all positions; returns how many tokens of a are covered."""
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and free_a[i + n] and free_b[j + n] and a[i + n] == b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < shortest:
            return covered
        covered += n
        for x in range(n):
            free_a[i + x] = free_b[j + x] = False


def test_tiling_against_brute_force():
    rng = random.Random(4)
    for _ in range(150):
        a = [rng.randint(1, 4) for _ in range(rng.randint(0, 25))]
        b = [rng.randint(1, 4) for _ in range(rng.randint(0, 40))]
        found = decontam.tiles(a, b, 3)
        for i, j, n in found:
            assert n >= 3 and a[i : i + n] == b[j : j + n]
        for side in (0, 1):
            held = [x + t for tile in found for x, t in [(tile[side], k) for k in range(tile[2])]]
            assert len(held) == len(set(held))
        best = slow_tiles(a, b, 3)
        assert abs(sum(n for *_, n in found) - best) <= 3  # equal but for ties of equally long matches


def test_query_against_brute_force(spark, sf_dir):
    bench = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.item_id): r for r in queries.op2_decontamination(spark, sf_dir).collect()}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    want = set()
    for d, w in docs.items():
        own = grams(w)
        for i, item in bench.items():
            shared = own & grams(item)
            if 5 * len(shared) < 0.5 * len(item):
                continue
            near = sorted({x for p in range(len(w) - 4) if tuple(w[p : p + 5]) in shared for x in range(p, p + 5)})
            seq, last = [], None
            for x in near:
                if last is not None and x != last + 1:
                    seq.append(None)
                seq.append(w[x])
                last = x
            if slow_tiles(item, seq, 5) >= 0.8 * len(item):
                want.add((d, i))
    assert set(got) == want and want


def test_reordered_passages_leak_and_others_do_not(spark):
    item = " ".join(f"w{i}" for i in range(40))
    parts = [" ".join(f"w{i}" for i in range(a, a + 10)) for a in (20, 0, 30, 10)]
    rows = [(1, "x y " + " z z ".join(parts) + " q"), (2, " ".join(parts[:3])), (3, " ".join(f"w{i}" for i in range(0, 40, 2))), (4, item.upper().replace(" ", ", ")), (5, None), (6, ""), (7, "short item")]
    bench = [(10, item), (11, item), (12, "Short item."), (13, None), (14, "...")]
    d, b = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id int, text string")
    got = {(r.doc_id, r.item_id, r.tiles) for r in decontam.leaks(d, b).collect()}
    assert got == {(1, 10, 4), (1, 11, 4), (4, 10, 1), (4, 11, 1), (7, 12, 1)}
    assert sorted(r.doc_id for r in decontam.clean(d, b).collect()) == [2, 3, 5, 6]


def test_joined_and_odd_tables(spark, monkeypatch):
    schema = "doc_id long, text string, leaks string, item_id int, tiles int, d1 int, t string"
    long = "intro " + "noise words here " * 5000 + " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(1, long, "own", 5, 1, 2, "t"), (1, long, "own", 5, 1, 2, "t"), (None, long, "own", 5, 1, 2, "t"), (2, "clean text", "own", 5, 1, 2, "t"), (3, None, "own", 5, 1, 2, "t")], schema)
    items = [(i, " ".join(f"w{j}" for j in range(i, i + 12))) for i in range(9)]
    b = spark.createDataFrame([*items, (100, items[0][1]), (101, None), (102, "clean"), (103, "...")], "item_id long, text string")
    whole = sorted(map(str, decontam.leaks(d, b).collect()))
    assert len(whole) == 3 * 10 + 1
    kept = [(3, None, "own", 5, 1, 2, "t")]
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 300)
    assert sorted(map(str, decontam.leaks(d, b).collect())) == whole
    left = decontam.clean(d, b)
    assert left.columns == d.columns and [tuple(r) for r in left.collect()] == kept
    monkeypatch.undo()
    assert [tuple(r) for r in decontam.clean(d, b).collect()] == kept
    assert decontam.leaks(d.limit(0), b).count() == 0 and decontam.leaks(d, b.limit(0)).count() == 0
    for name in ("item_id", "tiles"):
        got = decontam.leaks(d.select(F.col("doc_id").alias(name), "text"), b, doc_id=name)
        assert len(set(got.columns)) == 6 and got.columns[0] == name and got.count() == 31


def test_seeds_prove_that_nothing_is_missed():
    """Of texts made of an item's windows: each that could cover enough holds a seed."""
    rng = random.Random(7)
    for _ in range(300):
        size = rng.randint(1, 40)
        k = min(5, size)
        n = size - k + 1
        often = np.array([rng.choice([1, 1, 2, 50, 2000]) for _ in range(n)])
        seed = decontam.chosen(often, np.arange(n), np.zeros(n, int), np.array([size]), np.array([k]), 0.8)
        for _ in range(40):
            held = np.array([rng.random() < rng.choice([0.3, 0.7, 0.95]) for _ in range(n)])
            covered = np.zeros(size, bool)
            for p in np.flatnonzero(held):
                covered[p : p + k] = True
            if covered.sum() >= 0.8 * size:
                assert held[seed].any()
    # A template at the beginning of all items is no seed where the rest suffices.
    often = np.array([2000] * 7 + [1] * 20)
    assert not decontam.chosen(often, np.arange(27), np.zeros(27, int), np.array([31]), np.array([5]), 0.8)[:7].any()


def test_shared_templates_and_repeated_words_stay_small(spark, monkeypatch):
    import tracemalloc

    template = "which of the following statements about it"
    rng = random.Random(3)
    bench = [template + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(25)) for _ in range(2000)]
    text = " ".join([template + f" x{i}" for i in range(1500)]) + " " + bench[7] + " " + "same " * 14_000
    items = decontam.Items.of(list(range(2000)), bench, 5, 0.8)
    matcher = decontam.Matcher(items, 5, 0.8)
    tracemalloc.start()
    found = list(matcher.leaks(pa.array([text, "same " * 14_000])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(d, i) for d, i, *_ in found] == [(0, [7])] and peak < 64 << 20
    d = spark.createDataFrame([(1, text), (2, template)], "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(bench)), "item_id int, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 1000)
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()] == [(1, 7)]


def test_items_without_text_are_never_collected(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 200)
    items = spark.createDataFrame([(f"item {i}", None) for i in range(50)], "item_id string, text string")
    assert decontam.small(decontam.items_of(items, "item_id", "text")) and decontam.items_of(items, "item_id", "text").count() == 0
    long_ids = spark.createDataFrame([("x" * 300, "a")], "item_id string, text string")
    assert not decontam.small(decontam.items_of(long_ids, "item_id", "text"))
    docs = spark.createDataFrame([(1, "one two three four five six seven")], "doc_id long, text string")
    mixed = items.unionByName(spark.createDataFrame([("y", "one two three four five six seven")], "item_id string, text string"))
    assert [(r.doc_id, r.item_id) for r in decontam.leaks(docs, mixed).collect()] == [(1, "y")] and decontam.clean(docs, mixed).count() == 0
