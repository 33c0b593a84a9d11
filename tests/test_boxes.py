"""Boxes that go with hinted and re-read values, as rows."""

from docassay.operators import extract as E
from docassay.operators import lifecycle
from pyspark.sql import functions as F


def box(text, source="tesseract", conf=80.0):
    return (2, source, [(w, conf + i) for i, w in enumerate(text.split())], 10.0) if text is not None else None


def said(b):
    return None if b is None else (b.page, " ".join(w.text for w in b.words), b.mean_confidence)


def test_boxes_are_narrowed_to_the_best_run(spark):
    cases = [
        ("Merlot from MERLOT, red wine", ["merlot"], (2, "MERLOT,", 82.0)),  # "wine" stands near the second run
        ("Merlot from Merlot", ["merlot"], (2, "Merlot", 80.0)),  # of equal ones the first
        ("Napa Valley and Merlot", ["merlot", "napa valley"], (2, "Napa Valley", 81.0)),  # more words count more; the mean is rounded
        ("Cabernet, Sauvignon", ["cabernet sauvignon"], (2, "Cabernet, Sauvignon", 81.0)),
        ("Merlots", ["merlot"], None), ("", ["merlot"], None), ("Merlot", [""], None), ("Merlot", [], None), (None, ["merlot"], None),
    ]
    rows = spark.createDataFrame([(i, box(t), v) for i, (t, v, _) in enumerate(cases)], f"i int, b {E.BOX}, v array<string>")
    got = {r.i: said(r.x) for r in rows.select("i", E.best_run(F.col("b"), F.col("v")).alias("x")).collect()}
    assert got == {i: want for i, (*_, want) in enumerate(cases)}
    assert rows.limit(1).select(E.best_run(F.struct(F.lit(1).alias("page"), F.lit("vlm").alias("source"), F.col("b.words").alias("words"), F.lit(None).cast("double").alias("mean_confidence")), F.col("v")).alias("x")).first().x is None


def test_hints_bring_their_boxes(spark):
    schema = "doc_id int, class_type string, producer string, wine_varietal string, wine_appellation string, country_of_origin string, " + ", ".join(f"{f}_box {E.BOX}" for f in ("class_type", "producer", "wine_varietal", "wine_appellation", "country_of_origin"))
    own = box("own")
    rows = [
        (1, "Merlot wine", "Acme, Napa Valley, CA", None, None, None, box("Merlot wine"), box("Acme, Napa Valley, CA"), None, None, None),
        (2, "Merlot of Napa Valley", None, "Syrah", None, "France", box("Merlot of Napa Valley", "vlm"), None, own, None, own),
        (3, None, None, None, None, None, None, None, own, own, own),
    ]
    got = {r.doc_id: r for r in E.origin_hint(E.wine_hints(spark.createDataFrame(rows, schema))).collect()}
    assert (got[1].wine_varietal, said(got[1].wine_varietal_box)) == ("Merlot", (2, "Merlot", 80.0))
    assert (got[1].wine_appellation, said(got[1].wine_appellation_box)[1]) == ("Napa Valley", "Napa Valley,")
    assert (got[1].country_of_origin, said(got[1].country_of_origin_box)[1]) == ("USA", "Acme, Napa Valley, CA")
    assert (got[2].wine_varietal, said(got[2].wine_varietal_box)[1], got[2].wine_appellation, got[2].wine_appellation_box) == ("Syrah", "own", "Napa Valley", None)
    assert (got[2].country_of_origin, said(got[2].country_of_origin_box)[1]) == ("France", "own")
    assert (got[3].wine_varietal, got[3].country_of_origin, said(got[3].wine_varietal_box)[1]) == (None, None, "own")


def test_form_answers(spark):
    f = "application."
    fields = [(1, f + "brandName", None, None, False), (1, f + "source", "Domestic", box("x", conf=95.0), False), (1, f + "productType", "WINE", box("x", conf=10.0), False), (1, f + "grapeVarietals", " ", None, False), (1, f + "phone", None, None, False)]
    fields += [(2, f + "grapeVarietals", " ", None, True), (2, f + "brandName", "", box("x", "vlm"), True)]
    rows = spark.createDataFrame(fields, f"doc_id int, field string, value string, box {E.BOX}, is_wine boolean").withColumn("box", F.col("box").withField("mean_confidence", F.get("box.words.conf", F.lit(0))))
    assert {(r.doc_id, r.field.removeprefix(f)) for r in E.form_fallback_targets(rows).collect()} == {(1, "brandName"), (1, "productType"), (2, "grapeVarietals")}
    answers = spark.createDataFrame([(1, f + "brandName", None), (1, f + "productType", "something"), (2, f + "grapeVarietals", "null"), (2, f + "brandName", "B")], "doc_id int, field string, value string")
    got = {(r.doc_id, r.field.removeprefix(f)): (r.value, r.box and (r.box.source, r.box.page, len(r.box.words))) for r in E.merge_form_answers(rows, answers, spark.createDataFrame([(1, 4), (1, 3)], "doc_id int, page int")).collect()}
    assert got == {
        (1, "brandName"): (None, ("vlm", 3, 0)), (1, "source"): ("Domestic", ("tesseract", 2, 1)), (1, "productType"): ("WINE", ("vlm", 3, 0)), (1, "grapeVarietals"): (" ", None), (1, "phone"): (None, None),
        (2, "grapeVarietals"): (None, ("vlm", 1, 0)), (2, "brandName"): ("B", ("vlm", 1, 0)),
    }


def test_state_of_the_newest_reads_their_events_only(spark):
    apps = spark.createDataFrame([(i, "compliant" if i % 2 else "non_compliant", i // 2) for i in range(6)], "app_id int, verdict string, created_at int")
    reviews = spark.createDataFrame([(1, 5, "approved", "r", "me", 3), (2, 5, "rejected", "r", "me", 9), (3, 4, "rejected", " ", "me", 3), (4, 77, "approved", "r", "me", 3), (5, 0, "approved", "r", "me", 1)], "review_id int, app_id int, decision string, reason string, reviewer string, ts int")
    archives = spark.createDataFrame([(5, 5), (5, 7), (4, 4), (5, 2)], "app_id int, ts int")
    every = {r.app_id: (r.status, r.status_at, r.archived_at) for r in lifecycle.current_state(apps, reviews, archives).collect()}
    assert every[5] == ("approved", 3, 5) and every[4] == ("pending_rejection", 2, None) and every[0] == ("approved", 1, None) and set(every) == set(range(6))
    assert {r.app_id: (r.status, r.status_at, r.archived_at) for r in lifecycle.newest_states(apps, reviews, archives, "created_at", 3).collect()} == {i: every[i] for i in (2, 4, 5)}
