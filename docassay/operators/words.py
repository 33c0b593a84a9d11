"""Page geometry over tables of words: doc_id, page, idx (reading order), text, conf, x0, y0, x1, y1."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N

PAGE = ["doc_id", "page"]
#: Boxes of the form, in points from the lower left.
FORM_BOXES = {
    "plantRegistryNumber": (8, 578, 100, 602), "serialNumber": (8, 534, 100, 556), "applicant": (200, 536, 590, 596), "brandName": (8, 454, 195, 470), "fancifulName": (8, 424, 195, 440),
}
#: What makes an image count as label artwork, and the limits of page choice and checkboxes.
AREA, SHORT_SIDE, LONG_SIDE, PADDING, MOST_PAGES = 250_000, 300, 500, 4, 4
LEAST_INK, MARGIN = 15_000, 1.45
POINTS_TO_PIXELS = 200 / 72
BOILERPLATE = r"(?i)(basic permit|brewer'?s notice|plant registry|approved dba|tradename|required)"
HEADER = r"(?i)^\d+[a-z]?\.\s+|\b(?:formula|grape varietal|type of application|phone number|email address|show any information)\b"


def clean_value(v: Column) -> Column:
    return N.whitespace(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[“”]", '"'), N.SPACES, " "), " ,", ","))


def is_header(v: Column) -> Column:
    return v.rlike(HEADER)


def null_if_absent(v: Column) -> Column:
    return F.when(~F.coalesce(F.trim(v).rlike(r"(?i)^(?:n/?a|none|null|-+|—+)?$"), F.lit(True)), v)


def words_of_items(items: DataFrame, page_height: float = 792.0) -> DataFrame:
    """Words of text items (text, x, y, width, height): boxes in proportion to character offsets, y turned downwards, in pixels."""
    parts = F.split("text", r"(?<=\s)(?=\S)")
    rows = items.select("*", F.posexplode(N.placed(parts)).alias("k", "part_")).withColumns({"part": F.col("part_.text"), "start": F.col("part_.start")}).where(F.trim("part") != "")
    total = F.greatest(F.length("text"), F.lit(1))
    lead = F.length("part") - F.length(F.ltrim("part"))
    first, last = F.col("start") + lead, F.col("start") + lead + F.length(F.trim("part"))
    scaled = lambda v: F.round(v * POINTS_TO_PIXELS, 6)
    return rows.select(
        *PAGE, "item_idx", F.col("k").alias("word"), F.trim("part").alias("text"), scaled(F.col("x") + F.col("width") * first / total).alias("x0"), scaled(F.lit(page_height) - F.col("y") - F.col("height")).alias("y0"),
        scaled(F.col("x") + F.col("width") * last / total).alias("x1"), scaled(F.lit(page_height) - F.col("y")).alias("y1"),
    )


def in_boxes(words: DataFrame, boxes: dict[str, tuple[float, float, float, float]]) -> DataFrame:
    """Words with the ``field`` of each box that holds their centre; the boxes are a handful of constants."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hits = [F.when(cx.between(a, c) & cy.between(b, d), name) for name, (a, b, c, d) in boxes.items()]
    return words.select("*", F.explode(F.array_compact(F.array(*hits))).alias("field"))


def ocr_tolerance(words: Column) -> Column:
    """What counts as one line on a page of OCR words: 0.8 of the upper median height, 10 at least; 16 stands for heights where there is none."""
    heights = F.array_sort(F.filter(F.transform(words, lambda w: w["y1"] - w["y0"]), lambda h: h > 0))
    median = N.once(heights, lambda h: F.coalesce(F.get(h, F.floor(F.size(h) / 2).cast("int")), F.lit(16.0)))
    return F.greatest(F.lit(10.0), median * 0.8)


def line_begins(at: Column, tolerance: Column, centroid: bool) -> Column:
    """Where lines begin along the ascending centres of a page's words.

    Words come in the order of their centres, so only the newest line can be within the tolerance of the next one: an older line was left because a
    word lay beyond it, and no later word lies before that. The fold keeps that line's mean and size, and what it returns grows by lines.
    Words of one centre enter the mean together, weighted by their number: one by one they would round it differently.
    ``before`` and ``held`` are the line's mean and size without the words at its last centre, ``y``.
    """
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("mean"), F.lit(0).alias("n"), none.alias("before"), F.lit(0).alias("held"), none.alias("y"), F.array().cast("array<double>").alias("begins"))

    def step(line: Column, y: Column) -> Column:
        now = lambda mean, n, before, held, begins: F.struct(mean.alias("mean"), n.alias("n"), before.alias("before"), held.alias("held"), y.alias("y"), begins.alias("begins"))
        near = F.coalesce(F.abs(line["mean"] - y) <= tolerance if centroid else F.abs(line["mean"] - y) < tolerance, F.lit(False))
        n, held, m = line["n"] + 1, line["held"], line["n"] + 1 - line["held"]
        again = F.when(held == 0, y).otherwise((line["before"] * held + y * m) / n) if centroid else line["mean"]
        mean = (line["mean"] * line["n"] + y) / n if centroid else line["mean"]
        repeated = now(again, n, line["before"], held, line["begins"])
        joined = now(mean, n, line["mean"], line["n"], line["begins"])
        opened = now(y, F.lit(1), y, F.lit(0), F.concat(line["begins"], F.array(y)))
        return F.when(F.coalesce(line["y"] == y, F.lit(False)), repeated).when(near, joined).otherwise(opened)

    return F.aggregate(at, start, step, lambda line: line["begins"])


def cluster_lines(words: DataFrame, tolerance: float | Callable[[Column], Column] = ocr_tolerance, centroid: bool = True, descending: bool = False) -> DataFrame:
    """Words with ``line``: greedy clusters in reading order. A word joins the first line within ``tolerance`` of its
    centre (of the line's running mean, or of its first word's y0 without ``centroid``), else opens one.

    ``tolerance`` is a number, or a function of the page's array of words. The choice depends on order, so a page is folded by itself; a page is a bounded group.
    """
    rest = [c for c in words.columns if c not in PAGE]  # a page's own columns are kept once a page
    pages = words.groupBy(*PAGE).agg(F.collect_list(F.struct(*rest)).alias("w_"))
    centre = lambda w: (w["y0"] + w["y1"]) / 2 if centroid else w["y0"].cast("double")
    at = (lambda w: -centre(w)) if descending else centre
    limit = tolerance(F.col("w_")) if callable(tolerance) else F.lit(float(tolerance))
    at_ = F.array_sort(F.transform("w_", at))
    begins = N.once(limit, lambda t: line_begins(at_, t, centroid))  # or the tolerance would be computed at every step
    rows = pages.select(*PAGE, "w_", begins.alias("begins_")).select(*PAGE, F.explode("w_").alias("w"), "begins_")
    line = F.size(F.filter("begins_", lambda b: b <= at(F.col("w")))) - 1
    return rows.select(*[F.col(c) if c in PAGE else F.col(f"w.{c}").alias(c) for c in words.columns], line.alias("line"))


def split_at_gaps(words: DataFrame, gap: float) -> DataFrame:
    """Words with ``cluster``: numbered anew where the gap to the word before, in the line, is over ``gap``."""
    by = Window.partitionBy(*PAGE, "line").orderBy("x0", "idx")
    jump = F.coalesce(F.col("x0") - F.lag("x1").over(by) > gap, F.lit(False))
    return words.withColumn("jump", jump.cast("int")).withColumn("cluster", F.sum("jump").over(by.rowsBetween(Window.unboundedPreceding, 0))).drop("jump")


def rect_union(words: DataFrame, *by: str) -> DataFrame:
    return words.groupBy(*PAGE, *by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("n"))


def span_overlap(a0, a1, b0, b1, tolerance: float = 80) -> Column:
    return (F.col(a0) <= F.col(b1) + tolerance) & (F.col(a1) >= F.col(b0) - tolerance)


#: How far around a landmark its value may lie, in pixels.
SAME_LINE, LEFT_OF, BELOW, DISTANCE = 18, 80, 50, 250


@dataclass(frozen=True)
class Landmark:
    """A printed label of a form and where its value stands: to the ``right`` or ``below``."""

    field: str
    marker: str
    direction: str = "below"
    distance: float = DISTANCE


#: The landmarks of the form, in order of priority.
LANDMARKS = [
    Landmark("plantRegistryNumber", "PLANT REGISTRY"), Landmark("serialNumber", "SERIAL NUMBER"), Landmark("productType", "TYPE OF PRODUCT", distance=900),
    Landmark("productType", "CLASS/TYPE", distance=600), Landmark("productType", "CLASS TYPE", distance=600), Landmark("brandName", "BRAND NAME"),
    Landmark("fancifulName", "FANCIFUL NAME"), Landmark("mailingAddress", "MAILING ADDRESS"), Landmark("applicant.name", "NAME AND ADDRESS OF APPLICANT"),
    Landmark("email", "E-MAIL ADDRESS"), Landmark("phone", "TELEPHONE"), Landmark("applicationType", "TYPE OF APPLICATION"), Landmark("wineAppellation", "WINE APPELLATION"),
    Landmark("grapeVarietals", "GRAPE VARIETAL"), Landmark("formula", "FORMULA"), Landmark("applicationDate", "DATE OF APPLICATION"),
]


#: What a word carries to its page's array; the first three give the reading order.
READING = ["y0", "x0", "idx", "text", "x1", "y1"]


def gather(words: DataFrame) -> DataFrame:
    """PAGE and ``words``, the page's words as one array: the only time that landmarks shuffle a table of words."""
    return words.groupBy(*PAGE).agg(F.collect_list(F.struct(*READING)).alias("words"))


def tokens_of(m: Landmark) -> list[str]:
    return m.marker.lower().split()


def with_places(words: Column, landmarks: list[Landmark], use: Callable[[Column, list[Column]], Column]) -> Column:
    """``use(w, places)``: a page's words in reading order (y0, x0, idx) and, of each landmark, every number in ``w`` from which on consecutive words contain its tokens."""
    tokens = [tokens_of(m) for m in landmarks]
    # Signs at a word's end are in the way of no token that holds none.
    signs = any(set(":.,") & set(t) for own in tokens for t in own)
    plain = lambda w: F.regexp_replace(F.lower(w["text"]), "[:.,]+$", "") if signs else F.lower(w["text"])
    every = lambda conditions: reduce(lambda a, b: a & b, conditions)

    def places(own: list[str], plains: Column, page: Column) -> Column:
        hit = lambda i: every([F.contains(F.get(plains, i + k), F.lit(t)) for k, t in enumerate(own)])
        found = F.filter(F.sequence(F.lit(0), F.greatest(F.size(plains) - 1, F.lit(0))), hit)
        return F.when(every([F.contains(page, F.lit(t)) for t in own]), found).otherwise(F.array().cast("array<int>"))

    def found(w: Column) -> Column:
        return N.once(F.transform(w, plain), lambda plains: N.once(F.array_join(plains, " "), lambda page: use(w, [places(own, plains, page) for own in tokens])))

    return N.once(F.sort_array(words), found)


def marker_runs(words: DataFrame, marker: str) -> DataFrame:
    """The first place of each page where consecutive words contain the marker's tokens, in reading order (y0, x0)."""
    return marker_runs_of(gather(words), marker)


def marker_runs_of(pages: DataFrame, marker: str) -> DataFrame:
    """``marker_runs`` of pages as ``gather`` gives them."""
    own = Landmark("", marker)

    def first(w: Column, places: list[Column]) -> Column:
        at = F.get(places[0], F.lit(0))
        begin, end = F.get(w, at), F.get(w, at + len(tokens_of(own)) - 1)
        run = F.struct(begin["x0"].alias("x0"), begin["y0"].alias("y0"), end["x1"].alias("end_x1"), end["y1"].alias("end_y1"), begin["idx"].alias("idx"))
        return F.when(at.isNotNull(), run)

    # Through a generator, or a filter on the run would search for it once more.
    runs = pages.select(*PAGE, F.explode_outer(F.array(with_places(F.col("words"), [own], first))).alias("m"))
    return runs.where("m is not null").select(*PAGE, "m.*")


def first_reached(w: Column, test: Callable[[Column], Column]) -> Column:
    """The number of the first of a page's words, in reading order, whose y0 meets a test that all later ones meet too; their count if none does. Found by halving."""
    size = F.size(w)

    def halve(s: Column, _: Column) -> Column:
        mid = F.shiftright(s["lo"] + s["hi"], 1)
        now = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
        return F.when(s["lo"] >= s["hi"], s).when(F.coalesce(test(F.get(w, mid)["y0"]), F.lit(False)), now(s["lo"], mid)).otherwise(now(mid + 1, s["hi"]))

    steps = F.sequence(F.lit(1), F.length(F.bin(size)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), size.alias("hi")), halve, lambda s: s["lo"])


def words_near(w: Column, at: Column, m: Landmark) -> Column:
    """Of a page's words in reading order those where the landmark whose tokens begin at number ``at`` has its value."""

    def near(run: Column) -> Column:
        begin, end = run["begin"], run["end"]
        if m.direction == "right":
            from_, to = lambda y: y - begin["y0"] > -SAME_LINE, lambda y: y - begin["y0"] >= SAME_LINE
            inside = lambda x: (x > end["x1"]) & (x - end["x1"] < float(m.distance))
        else:
            reach = F.greatest((end["y1"] - end["y0"]) * 2, F.lit(BELOW))
            from_, to = lambda y: y > end["y1"], lambda y: y - end["y1"] >= reach
            inside = lambda x: (x < end["x1"] + float(m.distance)) & (x > begin["x0"] - LEFT_OF)
        band = lambda lo: F.slice(w, lo + 1, F.greatest(first_reached(w, to) - lo, F.lit(0)))
        return F.filter(N.once(first_reached(w, from_), band), lambda x: inside(x["x0"]))

    return N.once(F.struct(F.get(w, at).alias("begin"), F.get(w, at + len(tokens_of(m)) - 1).alias("end")), near)


def landmark_values(words: DataFrame, landmarks: list[Landmark] | None = None) -> DataFrame:
    """PAGE, landmark, field, value and idxs (its words): of each landmark the text beside its first place that has any.

    To the right: words with a y0 within 18 of the landmark's and a gap under its distance. Below: words that begin under the landmark by less than two line heights
    (50 at least), from 80 left of its first word to its distance right of its last; of these the first visual line.
    """
    return landmark_values_of(gather(words), landmarks)


def landmark_values_of(pages: DataFrame, landmarks: list[Landmark] | None = None) -> DataFrame:
    """``landmark_values`` of pages as ``gather`` gives them, without a shuffle. A page's places are tried in reading order, and those after the first with a value are not."""
    landmarks = LANDMARKS if landmarks is None else landmarks

    def value(w: Column, places: Column, m: Landmark) -> Column:
        found = F.aggregate(places, F.slice(w, 1, 0), lambda held, i: F.when(F.size(held) > 0, held).otherwise(words_near(w, i, m)))
        return found if m.direction == "right" else N.once(found, lambda f: F.filter(f, lambda x: x["y0"] - F.get(f, F.lit(0))["y0"] < SAME_LINE))

    def values(w: Column, places: list[Column]) -> Column:
        return F.array(*[F.struct(F.lit(n).alias("landmark"), value(w, own, m).alias("w")) for n, (own, m) in enumerate(zip(places, landmarks))])

    rows = pages.where(" and ".join(f"{k} is not null" for k in PAGE))
    # An inner generator would have its array filtered, and so made, once more below it.
    rows = rows.select(*PAGE, F.explode_outer(with_places(F.col("words"), landmarks, values)).alias("h")).select(*PAGE, "h.*").where(F.size("w") > 0)
    field = F.get(N.words_in([m.field for m in landmarks]), F.col("landmark"))
    return rows.select(*PAGE, "landmark", field.alias("field"), F.trim(F.array_join(F.transform("w", lambda w: w["text"]), " ")).alias("value"), F.transform("w", lambda w: w["idx"]).alias("idxs"))


def landmark_fields(words: DataFrame, family: Callable[[Column], Column], landmarks: list[Landmark] | None = None) -> DataFrame:
    """PAGE, field, value: the form fields at their landmarks. The product type is ``family`` of the first of its landmarks whose text names exactly one."""
    rows = landmark_values(words, landmarks).withColumn("value", F.when(F.col("field") == "productType", family(F.col("value"))).otherwise(F.col("value")))
    return rows.where("value is not null").groupBy(*PAGE, "field").agg(F.min_by("value", "landmark").alias("value"))


def checked_choice(scores: DataFrame) -> DataFrame:
    """The choice of each document whose ink score is high enough and well above the next; documents need two rows."""
    by = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), "choice")
    rows = scores.select("doc_id", "choice", "score", F.row_number().over(by).alias("place"), F.lead("score").over(by).alias("next_score"))
    return rows.where((F.col("place") == 1) & F.col("next_score").isNotNull() & (F.col("score") >= LEAST_INK) & (F.col("score") >= MARGIN * F.col("next_score"))).select("doc_id", "choice", "score")


def substantial(width: Column, height: Column) -> Column:
    return (width * height >= AREA) | ((F.least(width, height) >= SHORT_SIDE) & (F.greatest(width, height) >= LONG_SIDE))


def label_rects(images: DataFrame) -> DataFrame:
    """Padded rectangles of substantial images, cut at the page; those of at most a pixel are gone."""
    clamp = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    rows = images.where(substantial(F.col("width"), F.col("height"))).withColumns({
        "rx0": clamp(F.col("x") - PADDING, F.col("page_width")), "ry0": clamp(F.col("y") - PADDING, F.col("page_height")),
        "rx1": clamp(F.col("x") + F.col("width") + PADDING, F.col("page_width")), "ry1": clamp(F.col("y") + F.col("height") + PADDING, F.col("page_height")),
    })
    return rows.where((F.col("rx1") - F.col("rx0") > 1) & (F.col("ry1") - F.col("ry0") > 1))


def pick_pages(stats: DataFrame) -> DataFrame:
    """doc_id, page, kind of at most MOST_PAGES pages of each document: the form page, and label pages by image, else by marker."""
    best = Window.partitionBy("doc_id").orderBy(F.col("marker_hits").desc(), "page")
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    number = lambda flag: F.coalesce(F.col(flag).cast("int"), F.lit(0))
    # Whether a page besides the form's, the first one in this order, has the flag: in the order that the form's page needs anyway, so that one sort and one pass give all.
    others = lambda flag: F.sum(number(flag)).over(whole) > F.first(number(flag)).over(whole)
    rows = stats.select("doc_id", "page", (F.row_number().over(best) == 1).alias("is_form"), "has_image", "has_marker", others("has_image").alias("any_image"), others("has_marker").alias("any_marker"))
    rows = rows.withColumn("is_label", ~F.col("is_form") & F.when(F.col("any_image"), F.col("has_image")).otherwise(F.col("has_marker")))
    rows = rows.withColumn("any_label", F.col("any_image") | F.col("any_marker")).where("is_form or is_label")
    kind = F.when(F.col("is_label"), "label").when(F.col("any_label"), "form").otherwise("form+label")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    return rows.select("doc_id", "page", kind.alias("kind"), place.alias("place")).where(F.col("place") <= MOST_PAGES).select("doc_id", "page", "kind")


def city_state_zip(v: Column) -> dict[str, Column]:
    """city, state and postal code of a line; null unless all three are there (the value is trimmed first)."""
    pattern = r"(?i)^(.+?)\s+([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$"
    part = lambda i: F.nullif(F.regexp_extract(clean_value(v), pattern, i), F.lit(""))
    return {"city": part(1), "state": F.upper(part(2)), "postal_code": part(3)}


def applicant(lines: DataFrame) -> DataFrame:
    """doc_id, name, address, city_line from lines (doc_id, line, text) of the applicant box."""
    rows = lines.withColumn("text", clean_value(F.col("text"))).where((F.col("text") != "") & ~F.col("text").rlike(BOILERPLATE))
    used = F.col("text").rlike(r"(?i)\bused\s+on\s+label\b")
    first = lambda condition: F.min_by(F.when(condition, F.col("text")), F.when(condition, F.col("line")))
    found = rows.groupBy("doc_id").agg(
        first(used).alias("used"), first(F.lit(True)).alias("any"), first(F.col("text").rlike(r"^\d+\b") & ~used).alias("address"), first(F.col("text").rlike(r"(?i)^(.+?)\s+([A-Z]{2})\s+(\d{5}(?:-\d{4})?)$")).alias("city_line")
    )
    name = clean_value(F.regexp_replace(F.coalesce("used", "any"), r"(?i)\(?\s*used\s+on\s+label\s*\)?", ""))
    return found.select("doc_id", F.nullif(name, F.lit("")).alias("name"), "address", "city_line")


def page_summary(words: DataFrame) -> DataFrame:
    return words.groupBy(*PAGE).agg(F.count("*").alias("words"), F.count_distinct("line").alias("lines"), F.round(F.avg("conf")).cast("long").alias("mean_confidence"), F.count_if(F.col("conf") < 60).alias("unsure"))


def snap_provenance(boxes: DataFrame, widgets: DataFrame) -> DataFrame:
    """boxes (doc_id, field, page, x, y, w, h, confidence) with each field's widget in place of its box, at high confidence.

    widgets: field, rx0, ry0, rx1, ry1 in points from the lower left, page_width and page_height; a field may have several, whose union counts.
    Only fields that have a box already are replaced; fields without a widget, such as those of the label, stay as they are. Widgets are a handful of rows per form.
    """
    union = widgets.groupBy(F.col("field").alias("field_")).agg(
        F.min(F.col("rx0") / F.col("page_width")).alias("x_"), F.min(1 - F.col("ry1") / F.col("page_height")).alias("y_"),
        F.max(F.col("rx1") / F.col("page_width")).alias("x1_"), F.max(1 - F.col("ry0") / F.col("page_height")).alias("y1_"),
    )
    rows = boxes.join(union, F.col("field") == F.col("field_"), "left")
    box = {"x": F.col("x_"), "y": F.col("y_"), "w": F.col("x1_") - F.col("x_"), "h": F.col("y1_") - F.col("y_")}
    return rows.select("doc_id", "field", "page", *[F.coalesce(v, F.col(k)).alias(k) for k, v in box.items()], F.when(F.col("field_").isNotNull(), "high").otherwise(F.col("confidence")).alias("confidence"))
