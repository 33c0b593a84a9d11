"""Cases that are easy to get wrong, as rows."""

import pytest
from docassay.functions import constants as K
from docassay.functions import normalize as N
from docassay.operators import diff, extract, lifecycle, rules, words
from docassay.sources import results
from docassay.streaming import streams
from pyspark.sql import functions as F


def values(spark, cases, *columns):
    """The value of each Column function for each row of inputs (one or two strings)."""
    width = len(cases[0])
    names = ["a", "b", "c"][:width]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(cases)], "i int, " + ", ".join(f"{n} string" for n in names))
    rows = df.select("i", *[f(*[F.col(n) for n in names]).alias(f"v{k}") for k, f in enumerate(columns)]).orderBy("i").collect()
    return [tuple(r[1:]) if len(columns) > 1 else r[1] for r in rows]


def test_normalisation(spark):
    assert values(spark, [("Ridge Creek Distillery, LLC",), (None,), ("  Viña  de la Rosa S.A. ",)], N.exact) == ["ridge creek distillery,", "", "vina de la rosa s.a."]
    assert values(spark, [("west virginia and new york",)], N.expand_states) == ["west va and new york".replace("new york", "ny")]
    assert [sorted(x) for x in values(spark, [("Distilled and Bottled by Ridge Creek Distillery LLC · Bardstown, Kentucky",), (None,)], N.producer_tokens)] == [["bardstown", "creek", "distillery", "ky", "ridge"], []]
    assert values(spark, [("Acme, Denver, Colorado",), ("Viña de la Rosa",), ("Imported by X, New York, NY",), ("Acme, Bardstown, KY",), (None,)], N.implies_domestic) == [False, True, False, True, False]
    assert values(spark, [("Product of U.S.A.",), ("made of France",), ("country of origin Italy",)], N.country) == ["usa", "france", "italy"]
    assert values(spark, [("rosé wine blend",), ("Semi-Dry White",), ("Merlot",)], N.type_only) == [True, True, False]


def test_matching(spark):
    assert values(spark, [("Ridge Creek Distillery, LLC, Bardstown, KY", "Distilled and Bottled by Ridge Creek Distillery LLC · Bardstown, Kentucky"), ("Calypso Sands Distilling, Inc., Miami, FL", "Bottled by Tropical Spirits LLC · San Juan, Puerto Rico")], N.producer_match) == [True, False]
    assert values(spark, [("IMPORTED", "France"), ("IMPORTED", "USA"), ("USA", "United States")], N.country_match) == [True, False, True]
    assert values(spark, [("DISTILLED SPIRITS", "Single Malt Scotch Whisky"), ("WINE", "Barbera"), ("India Pale Ale", "Hop Forge IPA"), ("bourbon", "Kentucky Straight Bourbon Whiskey")], N.class_type_match) == [False, True, True, True]
    assert values(spark, [("", ""), ("a b", "b c")], lambda a, b: N.jaccard(F.array_remove(F.split(a, " "), ""), F.array_remove(F.split(b, " "), ""))) == [1.0, pytest.approx(1 / 3)]


def test_lexicon(spark):
    names = lambda v: F.array_join(N.lexicon_matches(v, K.VARIETALS), "|")
    # Longest key first, only its first place, no overlap, each name once.
    assert values(spark, [("Grenache Blanc and Grenache",), ("Merlot, Cabernet Sauvignon",), ("Shiraz Syrah",), ("blend",), (None,)], names) == ["Grenache Blanc", "Cabernet Sauvignon|Merlot", "Syrah", "", ""]
    assert values(spark, [("Napa Valley, California",), ("Mosel",), ("N/A",), ("red blend",), (" ",)], N.appellation_claim) == ["Napa Valley", "Mosel", None, None, None]


def test_rules(spark):
    assert len(K.WARNING) == 283
    schema = "brand_name string, abv string, warning_text string, appears_bold boolean, appears_all_caps boolean, net_contents string, class_type string, producer string, country_of_origin string, extraction_confidence string"
    base = dict(brand_name="B", abv="40%", warning_text=K.WARNING, appears_bold=None, appears_all_caps=None, net_contents="750 mL", class_type="Gin", producer="Acme, KY", country_of_origin=None, extraction_confidence="high")
    cases = [
        ({}, "compliant", {}), ({"appears_bold": False}, "compliant", {"governmentWarning": "uncertain"}), ({"warning_text": K.WARNING.replace("WARNING:", "WARNING :")}, "non_compliant", {"governmentWarning": "fail"}),
        ({"warning_text": K.WARNING.replace("to the", "").replace(" of ", " ")}, "compliant", {}), ({"warning_text": K.WARNING.replace("should not drink", "might avoid drinking")}, "non_compliant", {"governmentWarning": "fail"}),
        ({"net_contents": "5.17 gal"}, "needs_review", {"netContents": "warn"}), ({"abv": "forty percent"}, "needs_review", {"abv": "warn"}), ({"abv": "12.5"}, "compliant", {}), ({"extraction_confidence": "low"}, "compliant", {"brand": "uncertain"}),
        ({"producer": "Acme"}, "needs_review", {"producerOrigin": "warn"}), ({"producer": None}, "needs_review", {"producerOrigin": "warn"}), ({"brand_name": " "}, "needs_review", {"brand": "warn"}),
    ]
    df = spark.createDataFrame([(i, *(base | change).values()) for i, (change, *_) in enumerate(cases)], "doc_id int, " + schema)
    verdicts = {r.doc_id: r.v for r in df.select("doc_id", rules.verdict_column(F.lit(False)).alias("v")).collect()}
    found = {}
    for r in rules.rule_results(df).collect():
        if r.status != "pass":
            found.setdefault(r.doc_id, {})[r.rule_id] = r.status
            assert r.reason
    for i, (_, verdict, odd) in enumerate(cases):
        assert (verdicts[i], found.get(i, {})) == (verdict, odd)


def test_a_rule_is_added_by_extending_the_registry(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id int, lot string")
    own = {"lot": lambda: rules.outcome([(F.col("lot").isNull(), "warn", "no lot")], F.col("lot"))}
    assert [tuple(r) for r in rules.rule_results(df, own).collect()] == [(1, "lot", 0, "pass", None, "x")]


def test_diff_reconstructs_both_sides(spark):
    cases = [("a b c d", "a c d e"), ("one two", ""), ("", "x y"), ("same text here", "same text here"), ("a b a b", "b a b a"), ("w ", "w")]
    for a, b in cases:
        found = diff.segments(a, b)
        assert "".join(t for k, t in found if k != "extra") == (a if a.strip() else "") and "".join(t for k, t in found if k != "missing") == (b if b.strip() else "")
        assert all(x[0] != y[0] for x, y in zip(found, found[1:]))
    assert diff.segments("a b", "b a") == [("missing", "a b"), ("extra", "b a")] and diff.segments("x a", "x b") == [("equal", "x "), ("missing", "a"), ("extra", "b")]
    rows = spark.createDataFrame([(1, "a b", None), (2, None, None)], "doc_id int, canonical string, seen string")
    assert [tuple(r) for r in diff.diff(rows, "canonical", "seen").collect()] == [(1, 0, "missing", "a b")]


def test_line_clusters_follow_the_running_mean(spark):
    rows = [(1, 1, i, f"w{i}", 90, 10.0 * i, y, 10.0 * i + 5, y + 10) for i, y in enumerate([0.0, 2.5, 5.0, 7.0, 30.0])]
    df = spark.createDataFrame(rows, "doc_id int, page int, idx int, text string, conf int, x0 double, y0 double, x1 double, y1 double")
    assert [r.line for r in words.cluster_lines(df, 3.0).orderBy("idx").collect()] == [0, 0, 1, 1, 2]
    assert [r.line for r in words.cluster_lines(df, 3.0, centroid=False).orderBy("idx").collect()] == [0, 0, 1, 1, 2]


def test_pages_are_capped_after_ordering(spark):
    rows = [(1, p, 3 if p == 6 else 1, False, p < 6) for p in range(1, 7)] + [(2, 1, 0, False, False), (3, 1, 2, False, False), (3, 2, 0, True, False)]
    df = spark.createDataFrame(rows, "doc_id int, page int, marker_hits int, has_marker boolean, has_image boolean")
    got = {}
    for r in words.pick_pages(df).collect():
        got.setdefault(r.doc_id, {})[r.page] = r.kind
    assert got == {1: dict.fromkeys(range(1, 5), "label"), 2: {1: "form+label"}, 3: {1: "form", 2: "label"}}


def test_brand_windows(spark):
    df = spark.createDataFrame([(1, 1, "Ridge Creek", "fine BOURBON from RIDGE CREEK today".split()), (2, 1, "Bouchard", "the BOULCHARD house".split()), (3, 1, "Acme", "approved status".split())], "doc_id int, page int, brand string, words array<string>")
    assert {(r.doc_id, r.start, r.size, r.score) for r in extract.brand_match(df).collect()} == {(1, 3, 2, 1.05)}
    assert values(spark, [("boulchard", "bouchard"), ("creek", "creeks"), ("ab", "abc"), ("ridge", "ridgeline")], extract.similar) == [False, True, False, True]


def test_csv_quotes_only_where_needed(spark):
    assert values(spark, [('say "x"',), ("a,b",), ("plain",), (None,), ("two\nlines",)], results.csv_field) == ['"say ""x"""', '"a,b"', "plain", "", '"two\nlines"']


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"abc")
    row = results.scan_files(spark, str(tmp_path / "in")).first()
    assert (row.byte_size, row.hash_prefix) == (3, "ba7816bf8f01cfea")
    df = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h1")], "n int, content_hash string")
    for batch in (0, 0, 1):
        results.append_verified(df, str(tmp_path / "out"), batch, order="n")
    assert sorted((r.n, r.content_hash) for r in results.read_verified(spark, str(tmp_path / "out")).collect()) == [(1, "h1"), (2, "h2")]
    # Two writers of different batches that did not see each other.
    df.where("n = 3").write.parquet(str(tmp_path / "out/batch=9"))
    assert results.read_verified(spark, str(tmp_path / "out")).count() == 2


def test_csv_report_is_one_text(spark, tmp_path):
    schema = ", ".join(f"{k} string" for k in results.CSV_COLUMNS)
    rows = [("  lead and trail  ", 'say "x"', "a,b", "two\nlines", None, *[""] * 12), ("f2", *["v"] * 16)]
    results.write_csv(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path / "csv"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "csv").glob("part-*")))
    head, *lines = text.split("\r\n")
    assert head == ",".join(results.CSV_COLUMNS) and text.count("filename") == 1 and text.endswith("\r\n")
    assert sorted(x for x in lines if x) == ['  lead and trail  ,"say ""x""","a,b","two\nlines",' + "," * 12, "f2" + ",v" * 16]


def test_baseline_documents_are_read(spark, tmp_path):
    import json

    (tmp_path / "a.json").write_text(json.dumps({"capturedAt": "t", "entries": [{"filename": "x", "sizeBytes": 5, "pages": [{"pageNumber": 1, "kind": "form", "pngSizeBytes": 9}], "totalLatencyMs": 7.5, "extraction": {"a": 1}}, {"filename": "y", "errorMessage": "no"}], "summary": {"totalPdfs": 2}}, indent=1))
    rows = sorted(results.baseline_entries(spark, str(tmp_path)).collect(), key=lambda r: r.filename)
    assert [(r.capturedAt, r.filename, r.totalLatencyMs, r.errorMessage) for r in rows] == [("t", "x", 7.5, None), ("t", "y", None, "no")] and rows[0].pages[0].kind == "form"


def test_requests_name_one_to_two_hundred_rows(spark):
    state = spark.createDataFrame([(i, "approved" if i % 2 else "pending_approval", None) for i in range(500)], "app_id int, status string, archived_at string")
    asked = spark.createDataFrame([(1, i) for i in range(200)] + [(1, 5), (2, None)] + [(3, i) for i in range(201)] + [(4, 301), (4, 999)], "request_id int, app_id int")
    got = {r.request_id: (r.ids, r.moved, r.problem) for r in lifecycle.archive_requests(state, asked).collect()}
    assert got == {1: (200, 100, None), 2: (0, 0, "no ids"), 3: (201, 0, "too many ids"), 4: (2, 1, None)}
    assert lifecycle.archived_by(state, asked).count() == 101


def test_landmarks(spark):
    def page(doc, *lines):
        return [(doc, 1, 100 * k + j, w, 60.0 * j, 30.0 * y, 60.0 * j + 50, 30.0 * y + 12) for k, (y, line) in enumerate(lines) for j, w in enumerate(line.split())]

    rows = page(1, (0, "BRAND NAME"), (4, "6. Brand Name: (Required)"), (5, "Ridge Creek"), (6, "wrapped")) + page(2, (0, "TYPE OF PRODUCT"), (1, "Wine Malt Beverages"), (5, "CLASS TYPE"), (6, "India Pale Ale"))
    rows += page(3, (0, "Phone 555 123"), (2, "BRAND NAME"))
    df = spark.createDataFrame(rows, "doc_id int, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double")
    own = [*words.LANDMARKS, words.Landmark("phone", "PHONE", "right", 100)]
    got = {(r.doc_id, r.field, r.value) for r in words.landmark_fields(df, extract.strict_family, own).collect()}
    # The first place has no value, so the second counts; only its first line does. An ambiguous text leaves the type to the next landmark.
    assert got == {(1, "brandName", "Ridge Creek"), (2, "productType", "MALT BEVERAGES"), (3, "phone", "555 123")}
    assert next(r.idxs for r in words.landmark_values(df, own).collect() if r.doc_id == 1) == [200, 201]


def test_line_tolerance_of_ocr_words(spark):
    rows = [(1, 1, i, f"w{i}", 10.0 * i, y, 10.0 * i + 5, y + h) for i, (y, h) in enumerate([(0.0, 30), (20.0, 30), (60.0, 10), (64.0, 10)])]
    df = spark.createDataFrame(rows, "doc_id int, page int, idx int, text string, x0 double, y0 double, x1 double, y1 double")
    # The upper median height is 30, so centres up to 24 apart share a line.
    assert [r.line for r in words.cluster_lines(df).orderBy("idx").collect()] == [0, 0, 1, 1]


def test_boxes_snap_to_widgets(spark):
    boxes = spark.createDataFrame([(1, "application.brandName", 2, 0.1, 0.1, 0.1, 0.1, "low"), (1, "label.abv", 1, 0.2, 0.2, 0.2, 0.2, "medium")], "doc_id int, field string, page int, x double, y double, w double, h double, confidence string")
    widgets = spark.createDataFrame([("application.brandName", 0.0, 50.0, 50.0, 100.0, 100.0, 200.0), ("application.brandName", 50.0, 100.0, 100.0, 150.0, 100.0, 200.0), ("application.email", 0.0, 0.0, 1.0, 1.0, 100.0, 200.0)], "field string, rx0 double, ry0 double, rx1 double, ry1 double, page_width double, page_height double")
    got = {r.field: (r.page, r.x, r.y, r.w, r.h, r.confidence) for r in words.snap_provenance(boxes, widgets).collect()}
    assert got == {"application.brandName": (2, 0.0, 0.25, 1.0, 0.5, "high"), "label.abv": (1, 0.2, 0.2, 0.2, 0.2, "medium")}


def test_large_differences_are_the_same_in_linear_space(monkeypatch):
    import random

    rng = random.Random(1)
    for _ in range(300):
        a, b = (" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(2))
        monkeypatch.setattr(diff, "CELLS", 1 << 20)
        want = diff.segments(a, b)
        monkeypatch.setattr(diff, "CELLS", rng.choice([1, 6, 20]))
        assert diff.segments(a, b) == want


def test_patterns_of_producers_and_countries(spark):
    cases = ["Imported by Tropical Spirits LLC, New York, NY Government Warning", "brewed and canned by: Hop Forge, Denver, CO", "Product of New Zealand. Contains", "PRODUCT OF U.S.A. net", "product of South Africa estate grown on hillside slopes near 1890"]
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate(cases)], "doc_id int, page int, text string")
    got = {(r.doc_id, r.field): r.value for r in extract.first_patterns(df).collect()}
    assert got == {
        (0, "producer"): "Imported by Tropical Spirits LLC, New York, NY", (1, "producer"): cases[1], (2, "countryOfOrigin"): "Product of New Zealand", (3, "countryOfOrigin"): "PRODUCT OF U.S", (4, "countryOfOrigin"): "product of South Africa estate grown on hi",
    }


def test_archiving_twice_moves_nothing(spark):
    state = spark.createDataFrame([(1, "approved", None), (2, "pending_approval", None), (3, "rejected", "2024")], "app_id int, status string, archived_at string")
    ids = spark.createDataFrame([(0, 1), (0, 1), (0, 2), (0, 3), (0, 9)], "request_id int, app_id int")
    assert [r.app_id for r in lifecycle.archived_by(state, ids).collect()] == [1]
    assert lifecycle.archived_by(state.withColumn("archived_at", F.lit("x")), ids).count() == 0
    assert state.where(lifecycle.status_filter([], None)).count() == 0


def test_extension_points(spark):
    from docassay.operators import cross_check

    lines = ["ACME GIN 40% alc", "750 mL"]
    rows = [(1, 1, 100 * k + j, w, 90, 10.0 * j, 40.0 * k, 10.0 * j + 9, 40.0 * k + 12) for k, line in enumerate(lines) for j, w in enumerate(line.split())]
    df = spark.createDataFrame(rows, "doc_id int, page int, idx int, text string, conf int, x0 double, y0 double, x1 double, y1 double")
    assert {(r.field, r.value) for r in extract.pattern_extractor(df, df).collect()} == {("abv", "40% alc"), ("netContents", "750 mL")}
    pairs = spark.createDataFrame([(1, "WINE", "a", "A"), (2, "WINE", "a", None)], "doc_id int, wine_gate string, form_lot string, label_lot string")
    own = [("lot", F.col("form_lot"), F.col("label_lot"), F.lower("form_lot") == F.lower("label_lot"))]
    assert [(r.doc_id, r.status) for r in cross_check.cross_check(pairs, own).collect()] == [(1, "match"), (2, "not_on_label")]
