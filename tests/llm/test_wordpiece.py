import random

import numpy as np
from docassay.llm import queries, wordpiece


def greedy(word, begin, after):
    n, at, known = 0, 0, begin
    while at < len(word):
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in known), 0)
        if not size:
            return -1
        at, n, known = at + size, n + 1, after
    return n


def test_automaton_against_greedy_search():
    rng = random.Random(9)
    for _ in range(60):
        piece = lambda: bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5)))
        begin, after = {piece() for _ in range(rng.randint(0, 12))}, {piece() for _ in range(rng.randint(0, 12))}
        machine = wordpiece.Automaton(sorted(begin), sorted(after))
        words = [bytes(rng.choice(b"abcd" if rng.random() < 0.05 else b"abc") for _ in range(rng.randint(1, 12))) for _ in range(80)] + [b"ab" * 400]
        data = np.frombuffer(b"".join(words), np.uint8)
        size = np.array([len(w) for w in words])
        got = machine.count(data, np.cumsum(size) - size, size)
        assert got.tolist() == [greedy(w, begin, after) for w in words]


def test_many_pieces_popped_in_one_step():
    begin = after = [b"b", b"b" * 300, b"c"]
    machine = wordpiece.Automaton(begin, after)
    words = [b"b" * 127 + b"c", b"b" * 128 + b"c", b"b" * 150 + b"c", b"b" * 200 + b"c", b"b" * 299 + b"c", b"b" * 300 + b"c", b"b" * 650 + b"cb", b"b" * 200]
    data, size = np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words])
    assert machine.count(data, np.cumsum(size) - size, size).tolist() == [greedy(w, set(begin), set(after)) for w in words]


def test_query_against_brute_force(spark, sf_dir):
    begin, after = map(set, wordpiece.read_vocabulary(wordpiece.VOCABULARY))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    memo = {}
    want = set()
    for r in docs:
        found = [memo[w] if w in memo else memo.setdefault(w, greedy(w, begin, after)) for w in r.text.encode().split()]
        want.add((r.doc_id, len(found), sum(n if n > 0 else 1 for n in found), sum(n < 0 for n in found)))
    assert {tuple(r) for r in queries.op9_tokens(spark, sf_dir).collect()} == want


def test_odd_rows(spark):
    schema = "doc_id long, text string, n_words string, key int"
    rows = [(1, None, "x", 1), (2, " \n\t ", "x", 1), (None, "word " * 40000 + "z" * 30000, "x", 1), (2, " \n\t ", "x", 1)]
    out = wordpiece.token_counts(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "key", "n_words", "n_tokens", "n_unknown"]
    got = {(r.doc_id, r.n_words) for r in out.collect()}
    assert got == {(1, 0), (2, 0), (None, 40001)} and out.count() == 4
    assert wordpiece.token_counts(spark.createDataFrame([], schema)).count() == 0
