import math
import re

import numpy as np
import pytest
from docassay.llm import divergence, queries
from pyspark.sql import functions as F

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(t):
    t = t or ""
    words = re.findall("[^\x20\x09-\x0d]+", t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search("[^\x20\x09-\x0d]", line):
            dup += line in seen
            seen.add(line)
    three = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + j for i, w in enumerate(three) if three.count(w) > 1 for j in range(3)} if len(three) < 3000 else None
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered) if covered is not None else None


def test_plain_rules_by_hand(spark):
    texts = [
        "", None, "one two", "a b c a b c", "a b c d a b c", "x\nx\n\n \nx", "a  b\r\na  b\n", "é#ü $$ ñ|", "   x", "ab c a bc ab c a",
        "a\u0085b   c", "🙂 🙂 🙂 🙂 🙂", "tab\tsep\x0bvt\x0cff", "\x1f\x1c a", " \n\n ", "a b a b a b", "| | | | |\n| | | | |\n",
    ]
    rng = np.random.default_rng(0)
    texts += [" ".join(rng.choice(["a", "b", "c", "\n", "|"], int(rng.integers(1, 200)))) for _ in range(150)]
    rows = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for r in divergence.quality_rules(rows).collect():
        want = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def of(t):
    t = t or ""
    kinds = [0] * 7
    for c in t:
        b = ord(c)
        kinds[6 if b > 127 else 0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\n\x0b\x0c\r" else 4 if c in ".,;:!?'\"()-" else 5] += 1
    return kinds, TERM.findall(t.translate(LOW))


def js(p, q):
    one = lambda a, b: a / 2 * math.log2(2 * a / (a + b)) if a > 0 else 0
    return sum(one(a, b) + one(b, a) for a, b in zip(p, q))


def test_verdict_against_plain_arithmetic(spark):
    """All documents at the smallest scale, without numpy or hashes."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    count, chars = {}, {}
    for r in docs:
        kinds, words = of(r.text)
        c = chars.setdefault(r.lang, [0] * 7)
        for k in range(7):
            c[k] += kinds[k]
        own = count.setdefault(r.lang, {})
        for w in words:
            own[w] = own.get(w, 0) + 1
    refs = {}
    every = sum(sum(c.values()) for c in count.values())
    for lang, own in count.items():
        n = sum(own.values())
        if n * 1000 >= every:
            refs[lang] = [x / sum(chars[lang]) for x in chars[lang]], {w: k / n for w, k in own.items() if k * 1000 >= n}
    got = {r.doc_id: r for r in divergence.quality_rules(spark.createDataFrame(docs)).collect()}
    assert len(got) == len(docs)
    for r in docs:
        kinds, words = of(r.text)
        best = math.inf
        for share, common in refs.values():
            n = max(sum(kinds), 1)
            a = math.sqrt(max(js([k / n for k in kinds], share) - 6 / (8 * math.log(2) * n), 0))
            m = max(len(words), 1)
            held = {w: words.count(w) / m for w in common}
            p = [*held.values(), 1 - sum(held.values())]
            q = [*common.values(), 1 - sum(common.values())]
            b = math.sqrt(max(js(p, q) - len(common) / (8 * math.log(2) * m), 0))
            best = min(best, max(a / divergence.MOST_CLASSES if sum(kinds) >= divergence.LEAST_CHARS else 0, b / divergence.MOST_WORDS if len(words) >= divergence.LEAST_TERMS else 0))
        assert got[r.doc_id].kept == (not got[r.doc_id].base_failed and best <= 1), (r.doc_id, best)


def test_good_documents_stay_and_poor_ones_go(spark):
    sf = "/root/testdata/sf0.1"
    found = divergence.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r.quality, r.base_failed, r.kept): r["count"] for r in found.groupBy("quality", "base_failed", "kept").count().collect()}
    print(n)
    assert n.get((1, False, False), 0) == 0  # no good document goes by divergence
    assert n.get((0, False, False), 0) >= n.get((0, False, True), 0)


@pytest.mark.parametrize("langs", [["a"], [None], ["a", "b"]])
def test_odd_rows(spark, langs):
    schema = "doc_id long, text string, lang string, kept string, n_words string"
    rows = [(1, None, langs[0], "x", "x"), (2, "", langs[-1], "x", "x"), (None, "w " * 60000, langs[0], "x", "x"), (2, "", langs[0], "x", "x"), (3, "the of and " * 200, None, "x", "x")]
    got = divergence.quality_rules(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and not any(r.kept for r in got)
    assert {r.n_words for r in got} == {0, 60000, 600}
    assert divergence.quality_rules(spark.createDataFrame([], schema)).count() == 0


def test_a_rare_language_has_no_reference(spark):
    big = [(i, " ".join(["the", "of", f"w{i}"] * 400), "en") for i in range(4)]
    rows = spark.createDataFrame([*big, (9, "uno dos", "xx")], "doc_id long, text string, lang string")
    assert divergence.learn(rows).names == ["en"]


def test_query_against_sql(spark):
    """The whole query is compared row by row in the correctness run; here on the smallest tables."""
    import duckdb

    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op11_quality_rules"]).fetchall())
    got = queries.op11_quality_rules(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.collect())) == want
    assert got.where(F.col("kept") & F.col("base_failed")).isEmpty()
