import re

import pytest
from docassay.llm import queries, spans


def pieces(text):
    """Sentences as (words, start) by the rule of the operator, cut only at punctuation and lines."""
    return [re.findall(r"[^\W_]+", s.lower()) for s in re.split(r"\n|(?<=[.!?])\s", text) if re.search(r"[^\W_]", s)]


def test_second_place_goes_and_first_stays(spark):
    passage = "The grey heron stood very still in reeds. It watched the slow water for fish. Nothing moved until the evening bell rang. Then it flew off over the dark hill."
    rows = [
        (1, f"Alpha opening words here. {passage} Closing of the first."),
        (2, f"Quite another opening. Something else again. {passage} A different end."),
        (3, f"Third text alone. {passage} {passage}"),
        (4, "Clean text with its own words only. Nothing in it repeats anywhere at all. It should stay just as it is, to the last letter."),
    ]
    got = {r.doc_id: r for r in spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == rows[0][1] and got[1].n_removed == 0
    assert "heron" not in got[2].text and "Quite another opening." in got[2].text and "A different end." in got[2].text
    assert got[3].text == "Third text alone."
    assert got[4].text == rows[3][1] and got[4].n_removed == 0


def test_passages_without_punctuation_are_found(spark):
    passage = " ".join(f"word{i * 7919 % 1009}" for i in range(80))
    rows = [(i, " ".join(f"own{i}x{j}" for j in range(30)) + " " + passage + " " + " ".join(f"end{i}x{j}" for j in range(30))) for i in range(3)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert all(r.n_removed == 0 and r.n_sentences == r.n_units == 1 for r in spans.remove_repeats(d).collect())  # only whole sentences
    got = {r.doc_id: r for r in spans.remove_repeats(d, long=12).collect()}
    assert got[0].n_removed == 0 and got[0].n_sentences == 1 < got[0].n_units
    for i in (1, 2):
        left = sum(w in got[i].text.split() for w in passage.split())
        assert left < 40 and f"own{i}x0" in got[i].text and f"end{i}x29" in got[i].text


def brute(rows, cut_up=pieces):
    """(units, removed ones) by comparing word runs themselves."""
    cut = {i: cut_up(t) for i, t in rows}
    places = {}
    for i in sorted(cut):
        s = cut[i]
        for a in range(len(s)):
            b = a + 3
            while b <= len(s) and sum(map(len, s[a:b])) < 20:
                b += 1
            if b <= len(s):
                places.setdefault(tuple(w for x in s[a:b] for w in x), []).append((i, a, b))
    gone = {i: set() for i in cut}
    for found in places.values():
        for i, a, b in found[1:]:
            gone[i] |= set(range(a, b))
    return {i: (len(cut[i]), len(gone[i])) for i in cut}


def test_query_against_brute_force(spark, tmp_path):
    import random

    rng = random.Random(3)
    words = "ba be bi bo bu da de di do du".split()
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) + rng.choice(".!?")
    pool = [" ".join(sentence() for _ in range(6)) for _ in range(5)]
    rows = [(i, rng.choice([" ", "\n"]).join([sentence(), rng.choice(pool), sentence(), rng.choice(pool)][: rng.randint(0, 4)])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op7_spans(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_units, r.n_removed) for r in got} == brute(rows)
    assert all(r.n_sentences == r.n_units for r in got)


def winnowed_pieces(text, long=12):
    """Sentences of more than ``long`` words cut before the last least pair hash of any eight successive pairs of the text."""
    import pyarrow as pa

    words = [w for s in pieces(text) for w in s]
    own = spans.Tokens(*spans.buffers(pa.array([text])))
    pair = [int(x) for x in spans.mix(own.hash[:-1] * spans.np.uint64(3) + own.hash[1:])]
    marks = set()
    for i in range(len(pair) - spans.WINDOW + 1):
        window = pair[i : i + spans.WINDOW]
        marks.add(i + max(j for j, x in enumerate(window) if x == min(window)))
    out, at = [], 0
    for s in pieces(text):
        units = [[]]
        for j, w in enumerate(s):
            if j and len(s) > long and at + j - 1 in marks:
                units.append([])
            units[-1].append(w)
        out += units
        at += len(s)
    assert at == len(words)
    return out


def test_cut_sentences_against_brute_force(spark):
    import random

    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pool = [some(70), some(55) + ". " + some(15), some(30)]
    rows = [(i, rng.choice([" ", ". "]).join([some(rng.randint(5, 40)), rng.choice(pool), some(rng.randint(5, 40)), rng.choice(pool)][: rng.randint(1, 4)])) for i in range(50)]
    got = spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), long=12).collect()
    want = brute(rows, winnowed_pieces)
    assert {r.doc_id: (r.n_units, r.n_removed) for r in got} == want and sum(n for _, n in want.values()) > 100


def test_odd_rows(spark):
    schema = "doc_id long, text string, h string, g int, n_removed string, first_ int, later_id_ int, later_h_ int"
    long = " ".join(f"Part {i} of a long text goes on." for i in range(5000))
    rows = [(i, t, k, n, "x", 1, 2, 3) for i, t, k, n in [(1, None, "a", 1), (2, "", "b", 2), (None, long, "c", 3), (4, long, "d", 4), (4, long, "d", 4), (5, long, "e", 5)]]
    out = spans.remove_repeats(spark.createDataFrame(rows, schema))
    assert out.columns == ["doc_id", "text", "h", "g", "first_", "later_id_", "later_h_", "n_sentences", "n_units", "n_removed"]
    got = {(r.doc_id, r.text, r.n_removed) for r in out.collect()}
    assert got == {(1, None, 0), (2, "", 0), (None, long, 0), (4, long, 0), (4, "", 5000), (5, "", 5000)}
    assert spans.remove_repeats(spark.createDataFrame([], schema)).count() == 0


def test_rows_that_share_an_id_are_places_of_their_own(spark):
    passage = "The grey heron stood very still in reeds. It watched the slow water for fish. Nothing moved until the evening bell rang."
    other = "A second passage has words of its own. They are not those of the first one. It is told once more somewhere below."
    rows = [(1, passage), (1, passage), (1, f"{passage} Something more."), (2, f"{passage} {other}"), (2, f"{other} End."), (0, "Short."), (3, other)]
    found = spans.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    keyed = [((i, n), t) for n, (i, t) in enumerate(rows)]  # by id, then by row
    want = brute(keyed)
    assert sorted((r.doc_id, r.n_units, r.n_removed) for r in found) == sorted((i, *want[i, n]) for n, (i, _) in enumerate(rows))
    assert sum(r.n_removed == 0 for r in found if r.doc_id == 1) == 1
    assert {c for r in found for c in r.asDict()} == {"doc_id", "text", *spans.ADDED}


@pytest.mark.parametrize("text", ["", "...", "a", "\n\n", "é. ü! ñ?"])
def test_short_texts_have_no_run(text):
    import pyarrow as pa

    assert len(spans.Runs(pa.array([text])).at) == 0


def test_every_long_passage_without_punctuation_holds_a_run():
    import random

    import pyarrow as pa

    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(10**6)}"
    for case in range(400):
        passage = [rng.choice("ab") if case % 4 == 0 else word() for _ in range(51 + case % 10)]
        texts = [" ".join([*(word() for _ in range(rng.randint(10, 40))), *passage, *(word() for _ in range(rng.randint(10, 40)))]) for _ in range(2)]
        own = spans.Runs(pa.array(["some other text", *texts]), 12)
        assert set(own.hash[own.document == 1]) & set(own.hash[own.document == 2])
        alone = spans.Runs(pa.array(texts[1:]), 12)
        assert (alone.hash == own.hash[own.document == 2]).all()
