from docassay.functions import constants as K
from docassay.operators import prominent, words

SCHEMA = "doc_id int, page int, idx int, line int, text string, conf int, x0 double, y0 double, x1 double, y1 double"


def laid(spark, doc_lines, height=None, conf=90):
    rows = []
    for doc, lines in doc_lines.items():
        for k, line in enumerate(lines):
            for j, w in enumerate(line.split()):
                rows.append((doc, 1, 100 * k + j, k, w, conf, 100.0 * j, 40.0 * k, 100.0 * j + 80, 40.0 * k + (height or {}).get(k, 12)))
    return spark.createDataFrame(rows, SCHEMA)


def frames(spark, docs, kind="label"):
    pages = spark.createDataFrame([(d, 1, kind) for d in docs], "doc_id int, page int, kind string")
    return pages


def test_class_type(spark):
    own = {1: ["Ridge Creek", "Fine Straight Bourbon Whiskey here", "Distilled by Acme Whiskey", "40% alc vodka"], 2: ["old Cabernet Sauvignon wine", "India Pale Ale"], 3: ["nothing to see"]}
    expected = spark.createDataFrame([(1, "DISTILLED SPIRITS"), (2, "MALT BEVERAGES"), (3, "WINE")], "doc_id int, product_type string")
    got = {r.doc_id: (r.text, r.family) for r in prominent.class_type_candidate(laid(spark, own), frames(spark, own), expected).collect()}
    assert got == {1: ("Straight Bourbon Whiskey", "DISTILLED SPIRITS"), 2: ("India Pale Ale", "MALT BEVERAGES")}


def test_prominent_name(spark):
    own = {1: ["RIDGE CREEK", "Midnight Harvest", "12 Main Street", "small words", "far down", "below"], 2: ["Acme Brewing Company", "Golden Hour"]}
    brands = spark.createDataFrame([(1, "Ridge Creek"), (2, None)], "doc_id int, brand string")
    got = {r.doc_id: r.text for r in prominent.prominent_name(laid(spark, own, {1: 30}), frames(spark, own), brands).collect()}
    assert got == {1: "Midnight Harvest"}  # the second document's line lies too low


def test_warning_block_and_region(spark):
    tokens = K.WARNING.split()
    body = [" ".join(tokens[i : i + 6]) for i in range(0, len(tokens), 6)]
    own = {1: ["Brand", *body, "after the end"], 2: ["Brand", "government warning only"], 3: ["no such text here at all"], 4: [body[0], *body[2:]]}
    df = laid(spark, own)
    got = {r.doc_id: (r.text, r.words) for r in prominent.warning_block(words.split_at_gaps(df, 48)).collect()}
    # The walk ends with the line that completes nine of ten words of the second sentence.
    assert set(got) == {1, 4} and got[1] == (" ".join(tokens[:42]), 42)
    region = {r.doc_id: r for r in prominent.warning_region(df).collect()}
    assert set(region) == {1, 4} and K.WARNING in region[1].text


def test_below_marker(spark):
    df = laid(spark, {1: ["MARK here", "value of it", "next line"], 2: ["MARK", "5. Formula", "x"]}).selectExpr("doc_id", "page", "idx", "text", "conf", "x0", "y0 * 0.4 as y0", "x1", "y0 * 0.4 + 10 as y1")
    runs = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0)], "doc_id int, page int, my double")
    assert [(r.doc_id, r.value) for r in prominent.below_marker(df, runs, 0, 500).collect()] == [(1, "value of it")]
