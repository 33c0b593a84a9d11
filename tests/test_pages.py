"""Page classification, kinds of pages and field routing, as rows."""

import pytest
from docassay.operators import pages as P
from docassay.operators import words as W

WORD = "array<string>"


def test_markers_are_counted_once_and_across_items(spark):
    items = [
        (1, 1, 2, "NAME"), (1, 1, 1, "BRAND"), (1, 1, 3, "BRAND NAME"), (1, 1, 4, "SERIAL NUMBER"), (1, 1, 5, "brand name"),
        (1, 2, 1, "Brand (front) or keg collar"), (1, 3, 1, "Image Type: Back"), (1, 4, 1, "plain"),
    ]
    images = [(1, 2, 600.0, 500.0), (1, 2, 10.0, 10.0), (1, 5, 20.0, 20.0)]
    got = {
        r.page: r for r in P.page_stats(
            spark.createDataFrame(items, "doc_id int, page int, item_idx int, text string"), spark.createDataFrame(images, "doc_id int, page int, width double, height double"),
            spark.createDataFrame([(1, p) for p in range(1, 7)], "doc_id int, page int"),
        ).collect()
    }
    assert [got[p].marker_hits for p in range(1, 7)] == [2, 0, 0, 0, 0, 0]
    assert [got[p].has_marker for p in range(1, 7)] == [False, True, True, False, False, False]
    assert [(got[p].front_hits, got[p].back_hits) for p in (2, 3)] == [(3, 0), (0, 1)]
    assert [got[p].n_items for p in range(1, 7)] == [5, 1, 1, 1, 0, 0]
    assert (got[2].has_image, got[2].largest, got[2].n_images) == (True, 300000.0, 2)
    assert (got[5].has_image, got[5].largest) == (False, 400.0) and got[6].n_images == 0
    # The stats feed the choice of pages: the form, and the page with the image.
    assert sorted((r.page, r.kind) for r in W.pick_pages(spark.createDataFrame(list(got.values()))).collect()) == [(1, "form"), (2, "label")]


def test_items_are_trimmed_of_every_space(spark):
    rows = [(1, 1, 1, "  x\t", None, 3.0, 4.0), (1, 1, 2, " \n ", 1.0, 0.0, 0.0)]
    got = P.clean_items(spark.createDataFrame(rows, "doc_id int, page int, item_idx int, text string, height double, m2 double, m3 double")).collect()
    assert [(r.text, r.height) for r in got] == [("x", 5.0)]


def kinds(spark, pages, boxes):
    rows = P.page_kinds(spark.createDataFrame([(1, *p) for p in pages], "doc_id int, page int, kind string"), spark.createDataFrame([(1, *b) for b in boxes], f"doc_id int, field string, page int, source string, words {WORD}"))
    return {r.page: r.tab for r in rows.collect()}


@pytest.mark.parametrize(
    ("pages", "boxes", "want"),
    [
        ([(1, "form"), (2, "label-front"), (3, "label-back")], [], {1: "form", 2: "front", 3: "back"}),
        ([(1, "form+label")], [], {1: "form"}),
        ([(1, "unknown")], [], {}),
        ([(1, "unknown")], [("label.abv", 1, "pdf", ["w"])], {1: "front"}),
        # A neutral label page takes the better rank of a box; one that names its side is locked.
        ([(2, "label")], [("label.governmentWarning", 2, "tesseract", ["w"])], {2: "back"}),
        ([(2, "label-front")], [("label.governmentWarning", 2, "tesseract", ["w"])], {2: "front"}),
        ([(2, "label-front")], [("application.brandName", 2, "tesseract", ["w"])], {2: "front"}),
        ([(2, "label")], [("application.brandName", 2, "pdf", ["w"]), ("label.abv", 2, "pdf", ["w"])], {2: "form"}),
        # Boxes of a vision model, or without words, say nothing.
        ([], [("application.brandName", 2, "vlm", ["w"]), ("label.abv", 3, "pdf", [])], {}),
        ([], [("label.abv", 3, "pdf", ["w"]), ("label.governmentWarning", 3, "pdf", ["w"])], {3: "back"}),
        ([(1, "label"), (1, "form")], [], {1: "form"}),
    ],
)
def test_page_kinds(spark, pages, boxes, want):
    assert kinds(spark, pages, boxes) == want


def test_fields_are_routed(spark):
    boxes = [
        (1, "label.abv", 2, "pdf", ["4", "%"]), (1, "label.brandName", 3, "vlm", []), (1, "application.brandName", 9, "tesseract", ["a"]), (2, "label.abv", 7, "tesseract", []),
        (2, "label.producer", 5, "pdf", ["p"]), (3, "label.governmentWarning", 4, "pdf", ["g"]),
    ]
    pages = [(1, 1, "form"), (1, 2, "label-back"), (1, 3, "label-front"), (2, 6, "label-back"), (2, 4, "label-back")]
    wanted = [(1, f) for f in ("label.abv", "label.brandName", "application.brandName", "label.producer", "application.phone")] + [(2, f) for f in ("label.abv", "label.producer", "label.brandName", "application.phone")]
    wanted += [(3, "label.governmentWarning"), (3, "label.abv"), (4, "label.abv")]
    b = spark.createDataFrame(boxes, f"doc_id int, field string, page int, source string, words {WORD}")
    p = spark.createDataFrame(pages, "doc_id int, page int, kind string")
    found = {(r.doc_id, r.field): (r.tab, r.page, r.words, r.is_fallback) for r in P.select_fields(spark.createDataFrame(wanted, "doc_id int, field string"), b, P.page_kinds(p, b)).collect()}
    assert found == {
        (1, "label.abv"): ("back", 2, ["4", "%"], False),
        (1, "label.brandName"): ("front", 3, None, True),  # a vision model's: the brand is the front's, its lowest page
        (1, "application.brandName"): ("form", 9, ["a"], False),
        (1, "label.producer"): ("front", 3, None, False),
        (1, "application.phone"): ("form", 1, None, False),
        (2, "label.abv"): ("front", 5, None, False),  # page 5 is the front's by its box
        (2, "label.producer"): ("front", 5, ["p"], False),
        (2, "label.brandName"): ("front", 5, None, False),
        (2, "application.phone"): ("form", None, None, False),
        (3, "label.governmentWarning"): ("back", 4, ["g"], False),
        (3, "label.abv"): ("back", 4, None, False),  # a back is all there is
        (4, "label.abv"): ("front", None, None, False),
    }


def test_sources_of_fields(spark):
    boxes = [(1, "a", "pdf", ["w"], 90.0), (1, "b", "tesseract", [], 65.0), (1, "c", "vlm", [], None), (1, "d", "tesseract", ["w"], 69.0), (1, "e", "pdf", [], 70.0)]
    older = [(1, "b", "high"), (1, "c", "low"), (1, "f", "low"), (1, "g", None)]
    wanted = spark.createDataFrame([(1, f) for f in "abcdefg"], "doc_id int, field string")
    got = {r.field: (r.source, r.low) for r in P.field_sources(wanted, spark.createDataFrame(boxes, f"doc_id int, field string, source string, words {WORD}, mean_confidence double"), spark.createDataFrame(older, "doc_id int, field string, confidence string")).collect()}
    assert got == {"a": ("pdf", False), "b": ("tesseract", True), "c": ("vlm", True), "d": ("tesseract", True), "e": ("none", False), "f": ("tesseract", True), "g": ("none", False)}


def test_pages_for_reading(spark):
    picked = spark.createDataFrame([(1, 1, "form"), (1, 2, "label"), (1, 3, "label"), (2, 4, "form"), (2, 5, "label"), (3, 2, "form")], "doc_id int, page int, kind string")
    known = spark.createDataFrame([(1,), (1,), (3,)], "doc_id int")
    assert sorted(map(tuple, P.pages_to_read(picked, known).collect())) == [(1, 2), (1, 3), (2, 4), (2, 5)]
    read = spark.createDataFrame([(1, 3), (2, 4)], "doc_id int, page int")
    assert dict(map(tuple, P.vlm_pages(picked, read).collect())) == {1: 3, 2: 5, 3: 2}
