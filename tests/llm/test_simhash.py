import numpy as np
import xxhash
from docassay.llm import queries, simhash


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    k = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_query_against_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    fps = {i: slow_fingerprint(t) for i, t in docs.items()}
    want = slow_components(fps)
    got = queries.op10_simhash(spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", want[i]) for i in docs}


def test_every_pair_within_the_radius_shares_a_table():
    rng = np.random.default_rng(1)
    for level in range(simhash.LEVELS):
        masks = simhash.masks(level)
        for _ in range(2000):
            diff = sum(1 << int(i) for i in rng.choice(64, 3, replace=False))
            assert any(diff & m == 0 for m in masks)
    assert 2 ** simhash.most_free_bits() <= simhash.SMALL


def test_hot_buckets_are_split_and_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = int(rng.integers(0, 2**63))
    fps = {i: base ^ sum(1 << int(b) for b in rng.choice(40, rng.integers(0, 9), replace=False)) for i in range(150)}
    fps |= {1000 + i: int(rng.integers(0, 2**63)) for i in range(20)}
    monkeypatch.setattr(simhash, "SMALL", 4)
    rows = sorted({f - (1 << 64) if f >> 63 else f for f in fps.values()})
    edges = simhash.links(spark.createDataFrame([(f,) for f in rows], "fp long")).collect()
    want = slow_components({f: f % (1 << 64) for f in rows})
    root = {f: f for f in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        assert bin((e.a ^ e.b) % (1 << 64)).count("1") <= 3
        a, b = find(e.a), find(e.b)
        root[max(a, b)] = min(a, b)
    assert {f: find(f) for f in rows} == want


def test_odd_rows(spark):
    schema = "doc_id long, text string, fp long, root string, key int"
    rows = [(1, None, 1, "a", 1), (2, "", 1, "b", 2), (3, " \n ", 1, "c", 3), (4, "one", 1, "d", 4), (5, "One", 1, "e", 5), (5, "One", 1, "e", 5), (None, "x y z " * 4000, 1, "f", 6)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (None, None)}
    kept = simhash.first_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "fp", "root", "key"]
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 4]  # of the null texts one stays
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0


def test_rows_that_share_an_id_are_judged_by_themselves(spark):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six seven", "red green blue white black grey")
    schema = "doc_id long, text string, kept_id_ string, kept_hash_ long, id_ int"
    rows = [(1, a, "k", 1, 1), (1, b, "k", 2, 2), (2, a, "k", 3, 3), (3, c, "k", 4, 4), (3, c, "k", 4, 4), (3, c, "j", 5, 5), (None, b, "k", 6, 6), (None, "nothing like the others at all", "k", 7, 7)]
    kept = simhash.first_of_each(spark.createDataFrame(rows, schema))
    assert kept.columns == ["doc_id", "text", "kept_id_", "kept_hash_", "id_"]
    # The second row of id 1 resembles nothing of a smaller id; id 2 is a copy of id 1; of the equal rows of id 3 one stays.
    assert sorted((r.doc_id or 0, r.text, r.kept_id_) for r in kept.collect()) == [(0, "nothing like the others at all", "k"), (1, a, "k"), (1, b, "k"), (3, c, "j")]
