"""Steps whose work must grow with their input: what is computed once a row or page is not computed again for every word of it."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from docassay.functions import normalize as N
from docassay.operators import diff as DF
from docassay.operators import extract as E
from docassay.operators import lexicon as L
from docassay.operators import pages as PG
from docassay.operators import prominent as P
from docassay.operators import words as W
from docassay.plans import fixtures as X
from docassay.plans import lifecycle_queries as LQ
from docassay.plans import word_queries as WQ
from docassay.sources import contract as C
from docassay.sources import results as S


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_mean_below_generator(spark):
    """a page's mean was folded anew for each of its words, each of which carried the whole page."""
    word = "named_struct('text', concat('w', i), 'conf', 50 + i % 3)"
    page = f"array(named_struct('paragraphs', array(named_struct('lines', array(named_struct('words', transform(sequence(1, n), i -> {word})))))))"
    pages = spark.range(1, 3).selectExpr("id as doc_id", "1 as page", "cast(id * 3 as int) n").selectExpr("doc_id", "page", f"{page} blocks")
    words = S.flatten_blocks(pages)
    text = plan(words)
    assert text.index("Generate") < text.index("aggregate(")
    assert [tuple(r) for r in words.where("doc_id = 1").orderBy("word_idx").collect()] == [(1, 1, 51, i, f"w{i + 1}", 50 + (i + 1) % 3) for i in range(3)]


def test_lexicon_text_split_once(spark):
    """the words of a text were split from it again for each of them."""
    texts = spark.createDataFrame([(bytearray(b"1"), "a b c a b")], f"{L.ID} binary, text string")
    keys = L.keys_of(spark.createDataFrame([("a b", "ab", 1), ("b c a", "bca", 2), ("c x", "cx", 3)], "key string, name string, place int"))
    found = L.candidates(texts, keys)
    made = [line for line in plan(found).splitlines() if "Generate posexplode" in line or "transform(" in line and "next" in line]
    assert made and max(line.count("split(") for line in made) == 1
    assert sorted((r["key"], r["at"], r["size"]) for r in found.collect()) == [("a b", 0, 2), ("b c a", 1, 3)]


def test_block_pages_in_batches(spark):
    """a pandas frame was made for each page, with or without a warning."""
    said = "Brand | GOVERNMENT Warning: one two three four five | six seven eight nine".split(" | ")
    rows = [(doc, 1, n * 10 + i, n, 0, t, 80, 10.0 * i, 10.0 * i + 9) for doc in (1, 2) for n, line in enumerate(said[: 3 if doc == 1 else 1]) for i, t in enumerate(line.split())]
    found = P.warning_block(spark.createDataFrame(rows, "doc_id long, page int, idx int, line int, cluster int, text string, conf int, x0 double, x1 double"))
    assert "FlatMapGroupsInPandas" not in plan(found)
    assert [tuple(r) for r in found.collect()] == [(1, 1, " ".join(said[1:]), 11, 80)]


def test_region_in_one_pass(spark):
    """words were read and marked twice, joined with their page, and stripped of signs for every anchor."""
    rows = [(1, 1, i, t, 80, 0.0, 10.0 * i, 9.0, 10.0 * i + 9) for i, t in enumerate("GOVERNMENT WARNING: surgeon a b c d pregnancy".split())]
    found = P.warning_region(spark.createDataFrame(rows, "doc_id long, page int, idx int, text string, conf int, y0 double, x0 double, y1 double, x1 double"))
    assert "Join" not in plan(found) and plan(found).count("[^a-z]") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 1, "GOVERNMENT WARNING: surgeon a b c d pregnancy", 8, 80)]


def test_offsets(spark):
    """the text before each word was joined again for each word."""
    long = spark.createDataFrame([(1, 1, 0, "ab " * 300 + "é", 0.0, 0.0, 904.0, 1.0)], "doc_id long, page int, item_idx int, text string, x double, y double, width double, height double")
    found = W.words_of_items(long)
    assert "array_join" not in plan(found)
    rows = {r["word"]: (r["text"], r["x0"]) for r in found.collect()}
    assert len(rows) == 301 and all(rows[k] == ("é" if k == 300 else "ab", round(904 * 3 * k / 901 * 200 / 72, 6)) for k in rows)
    parts = spark.range(1).selectExpr("array('', 'abc', '', 'd') p", "cast(array() as array<string>) e", "cast(null as array<string>) n")
    assert tuple(parts.select(*[N.offsets(F.col(v), 1) for v in "pen"]).first()) == ([0, 1, 5, 6], [], None)


def test_mean_of_equal_centres(spark):
    """words of one centre entered a line's mean one by one, which rounds it otherwise than the weighted mean of the SQL."""
    ys = [4.5, 4.5, 6.3, 12.24]
    assert abs((4.5 * 2 + 6.3) / 3 - 12.24) == 7.14 and 4.5 + (6.3 - 4.5) / 3 != (4.5 * 2 + 6.3) / 3
    words = spark.createDataFrame([(1, 1, i, y, y) for i, y in enumerate(ys)], "doc_id long, page int, idx int, y0 double, y1 double")
    assert [r["line"] for r in W.cluster_lines(words, 7.14).orderBy("idx").collect()] == [0] * 4


def test_clusters_gather_what_is_asked(spark):
    """words carried their page and centre through the shuffle once more."""
    words = spark.createDataFrame([(1, 1, 0, 5.0, 6.0)], "doc_id long, page int, idx int, y0 double, y1 double")
    assert "at_" not in plan(W.cluster_lines(words, 18.0, centroid=False))


def test_brand_runs_made_once(spark):
    """filters on what the runs gave were pushed below them, so that words were compared and runs made twice."""
    rows = [(1, 1, "Old Tom", "the OLD tom gin".split()), (2, 1, "Old Tom", "nothing".split()), (3, 1, "", ["x1"]), (4, 1, "ab cd", [])]
    found = E.brand_match(spark.createDataFrame(rows, "doc_id long, page int, brand string, words array<string>"))
    assert plan(found).count("keg") == 1
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, 2, 1.05)]


def test_result_lines_read_once(spark, sf_dir):
    """Each check went its own way from the root of the document, and a filter worked out the text of each line a second time where the file was read."""
    found = LQ.QUERIES["P6_result_contract_checks"](spark, sf_dir)
    text = plan(found)
    below = text[text.index("Repartition") :]
    assert text.count("parseJson") == 1 and "GOVERNMENT WARNING" not in below and "RLIKE" not in below
    # Outside of lambdas no part is read on its own; the ways to parts of another kind are worked out only for such.
    assert "$['report']['extractedForm']['phone']" not in text and "array_compact" not in text


def test_members_of_another_kind(spark):
    """What is read with its list or map and is of another kind is looked at once more, for its message."""
    own = C.record({"a": C.listing(C.record({"x": C.number(0)}, nullable=True)), "b": C.mapping(C.listing(C.text()), optional=True)})
    rows = [
        ('{"a": [{"x": 1}, null, 3, [], {}], "b": {"k": "v", "l": ["w", null]}}', "a.2: expected object; a.3: expected object; a.4.x: required; b.k: expected array; b.l.1: expected string"),
        ('{"a": [], "b": {"k": null}}', "b.k: expected array"), ('{"a": [{"x": null}]}', "a.0.x: expected a number from 0"), ('{"a": [{"x": 0.5}], "b": {}}', None),
    ]
    df = spark.createDataFrame(rows, "value string, want string")
    assert [(r.found, r.want) for r in C.checked(df, "value", own, "v", "found").collect() if r.found != r.want] == []


def test_events_and_labels_are_dealt_out(spark, sf_dir):
    """A file that came in as many cuts as there are cores was read as it was, though few of the cuts hold its row groups."""
    for name in ("events", "part"):
        whole = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        sizes = X.deal(whole.repartition(1).union(whole.limit(0).repartition(8))).groupBy(F.spark_partition_id()).count().collect()
        assert len(sizes) >= 32 and max(r["count"] for r in sizes) <= 2 * min(r["count"] for r in sizes)


def test_differences_in_pieces(spark):
    """the segments of a whole batch were held at once, as objects."""
    sizes = [10, DF.PIECE * 3, 5] + [DF.PIECE // 10] * 40
    batch = pd.DataFrame({"k": range(len(sizes)), "a_": ["a" * n for n in sizes], "b_": ""})
    got = list(DF.pieces(batch))
    assert [k for piece in got for k in piece.k] == list(range(len(sizes)))
    assert len(got) >= 5 and all(p.a_.str.len().sum() - p.a_.str.len().max() <= DF.PIECE for p in got)
    rows = spark.range(300).selectExpr("id as doc_id", "repeat('x ', 30) a", "concat(repeat('x ', 30), 'y') b").coalesce(1)
    assert [tuple(r) for r in DF.diff(rows, "a", "b").groupBy("position", "kind").count().orderBy("position").collect()] == [(0, "equal", 300), (1, "extra", 300)]


def test_fields_are_routed_by_document(spark, sf_dir):
    """fields and boxes were dealt out by document and field, then with all they carried by document; lines by order and field, with the texts made of them; pages by document and page, then by document."""
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = WQ.QUERIES["G23_field_route"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    keys = sorted(re.sub(r"#\w+", "", k) for k in re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", text))
    assert keys == ["doc_id", "doc_id", "doc_id, page", "l_orderkey", "l_orderkey"]
    # The lines of both uses of the boxes leave as they are, so that one exchange serves both.
    assert len({re.sub(r"#\w+", "", k) for k in re.findall(r"Exchange hashpartitioning\(l_orderkey.*\n.*?Project (\[.*?\])", text)}) == 1
    assert "regexp_replace" not in text


def test_fields_of_odd_rows(spark):
    """rows meet by document; several boxes of one field give several rows, and what has no document or field meets nothing."""
    wanted = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "b"), (None, "b"), (1, "b")], "doc_id int, field string")
    own = spark.createDataFrame([(1, "b", 7), (1, "b", 8), (1, "ba", 1), (1, "B", 2), (1, None, 3), (None, "b", 4), (3, "b", 5)], "doc_id int, field string, v int")
    found = sorted(map(tuple, PG.of_fields(wanted, own).collect()), key=str)
    assert found == sorted([(1, "b", 7), (1, "b", 8), (1, "b", 7), (1, "b", 8), (1, "a", None), (1, None, None), (2, "b", None), (None, "b", None)], key=str)


def test_pages_of_odd_rows(spark):
    """items and images are one grouping, in which those without a page or document stay apart, as they were in the join."""
    items = spark.createDataFrame([(1, None, 1, "SERIAL NUMBER"), (1, None, 2, "x"), (1, 1, 1, "y")], "doc_id int, page int, item_idx int, text string")
    images = spark.createDataFrame([(1, None, 600.0, 500.0), (1, None, 1.0, 1.0), (None, 1, 2.0, 2.0), (1, 1, None, 3.0), (1, 1, 2.0, 2.0)], "doc_id int, page int, width double, height double")
    got = PG.page_stats(items, images, spark.createDataFrame([(1, 1), (1, 1), (1, 2), (1, None)], "doc_id int, page int"))
    found = [(r.doc_id, r.page, r.n_items, r.n_images, r.has_image, r.largest) for r in got.collect()]
    want = [(1, None, 2, 0, False, 0.0), (1, None, 0, 2, True, 300000.0), (1, None, 0, 0, False, 0.0), (None, 1, 0, 1, False, 4.0), (1, 1, 1, 2, False, 4.0), (1, 2, 0, 0, False, 0.0)]
    assert sorted(found, key=str) == sorted(want, key=str)
    # Flags that are null, as another source may give them, count as none, and the form's own flags do not make a label.
    pages = [(1, 1, 2, True, True), (1, 2, 0, None, True), (1, 3, 0, None, None), (2, 1, 0, None, None), (2, 2, 0, True, None), (3, 1, 1, True, True), (3, 2, 0, False, False)]
    picked = W.pick_pages(spark.createDataFrame(pages, "doc_id int, page int, marker_hits int, has_image boolean, has_marker boolean"))
    assert sorted(map(tuple, picked.collect())) == [(1, 1, "form"), (1, 2, "label"), (2, 1, "form"), (2, 2, "label"), (3, 1, "form+label")]


def test_landmarks_shuffle_no_words(spark, sf_dir):
    """F2 of round 4: all words of all documents were shuffled and sorted twice, once for the places of landmarks and once to meet them, with boxes in doubles."""
    for name in ("G13_landmark_value", "G12_marker_run_search"):
        text = WQ.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange hashpartitioning\(doc_id#\d+L?, \d+\)", text)) == text.count("Exchange hashpartitioning") == 1
        assert not re.search("Window|Join|posexplode|Sort ", text)
    # Words that come as a table are shuffled once.
    text = W.landmark_values(WQ.words(spark, sf_dir), [W.Landmark("x", "th ON", "right")])._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and not re.search("Window|Join", text)


def test_word_pages_are_the_words(spark, tmp_path):
    """F2 of round 4: pages made where their texts are hold the words of the table, also of rows that share an id or have no text."""
    texts = ["th\ton the  on\n\n on éa th 😀x y", " ", "", None, "th on", "ab " * 100 + "\nx"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, "the on z\nw"), (4, "a on th"), (4, None), (7, "th on b")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda df: sorted((r.doc_id, r.page, sorted(map(tuple, r.words))) for r in df.collect() if r.words)
    made, words = WQ.word_pages(spark, str(tmp_path)), WQ.words(spark, str(tmp_path))
    assert held(made) == held(W.gather(words)) and len(held(made)) == 4
    own = [W.Landmark("x", "th ON", "right", 250)]
    got = sorted(map(str, W.landmark_values_of(made, own).collect()))
    assert got == sorted(map(str, W.landmark_values(words, own).collect())) and len(got) == 3


def test_places_of_odd_words(spark):
    """F2 of round 4: a page's places are tried in order until one has a value; what has no place on the page is near none."""
    nan = float("nan")
    column = [(1, 1, i, "a" if i % 2 else "th", 5.0, 30.0 * i, 9.0, 30.0 * i + 9) for i in range(500)]
    value = [(1, 1, 500, "th", 5.0, 15000.0, 9.0, 15009.0), (1, 1, 501, "A:", 10.0, 15000.0, 14.0, 15009.0), (1, 1, 502, "v", 20.0, 15017.9, 24.0, 15027.0), (1, 1, 503, "w", 20.0, 15018.0, 24.0, 15027.0), (1, 1, 504, None, 20.0, 14983.0, 24.0, 15000.0)]
    lost = [(2, 1, 0, "v", 20.0, None, 24.0, 9.0), (2, 1, 1, "th", 5.0, 0.0, 9.0, 9.0), (2, 1, 2, "a", 10.0, 0.0, None, 9.0), (2, 1, 3, "u", 20.0, nan, 24.0, 9.0), (None, 1, 0, "th", 5.0, 0.0, 9.0, 9.0), (None, 1, 1, "a", 10.0, 0.0, 14.0, 9.0), (None, 1, 2, "v", 20.0, 0.0, 24.0, 9.0)]
    df = spark.createDataFrame(column + value + lost, "doc_id int, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double")
    found = W.landmark_values(df, [W.Landmark("n", "no", "right"), W.Landmark("f", "TH a", "right", 20)])
    assert [tuple(r) for r in found.collect()] == [(1, 1, 1, "f", "v", [504, 502])]
    assert sorted((str(r.doc_id), r.idx, r.end_x1) for r in W.marker_runs(df, "th A").collect()) == [("1", 0, 9.0), ("2", 1, None), ("None", 0, 14.0)]
