"""Pages of a document: what stands on them, which to read, and where a field is shown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from .words import PAGE, substantial

#: What counts as blank at the ends of an item.
SPACE = " \t\n\x0b\f\r\xa0\ufeff"
FORM, BACK, FRONT = "form", "back", "front"
LOW_CONFIDENCE = 70
#: Of a page that several sources name, the first of these counts.
RANKS = {FORM: 3, BACK: 2, FRONT: 1}


def clean_items(items: DataFrame) -> DataFrame:
    """Text items without those that are blank: trimmed, with the height of their matrix (m2, m3) where they have none."""
    text = F.trim("text", F.lit(SPACE))
    return items.withColumns({"text": text, "height": F.coalesce("height", F.hypot("m2", "m3"))}).where("text <> ''")


def page_texts(items: DataFrame) -> DataFrame:
    """doc_id, page, text and n_items: the items (doc_id, page, item_idx, text) of each page joined by a space, in their order."""
    rows = items.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("item_idx", "text"))).alias("held"))  # the items of one page
    return rows.select(*PAGE, F.array_join(F.transform("held", lambda x: x["text"]), " ").alias("text"), F.size("held").alias("n_items"))


def marker_hits(text: Column, markers: list[str]) -> Column:
    """How many different markers a text contains."""
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))


def page_stats(items: DataFrame, images: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """One row for each page that has text items or images (or stands in ``pages``).

    items: doc_id, page, item_idx, text, cleaned. images: doc_id, page, width, height as drawn. Columns: marker_hits (different markers of a
    form), has_marker (any marker of a label), front_hits, back_hits, n_items, n_images, has_image (a substantial one), largest (area, 0 without an image).
    """
    t = F.col("text")
    texts = page_texts(items).select(
        *PAGE, "n_items", marker_hits(t, K.FORM_MARKERS).alias("marker_hits"), (marker_hits(t, K.LABEL_MARKERS) > 0).alias("has_marker"),
        marker_hits(t, K.FRONT_MARKERS).alias("front_hits"), marker_hits(t, K.BACK_MARKERS).alias("back_hits"),
    )
    drawn = images.select(*PAGE, substantial(F.col("width"), F.col("height")).alias("has_image"), (F.col("width") * F.col("height")).alias("largest"), F.lit(1).cast("long").alias("n_images"))
    parts = [texts, drawn] if pages is None else [texts, drawn, pages.select(*PAGE)]
    # Rows without a document or page are those of no page: they stay apart by where they come from.
    parts = [p.withColumn("apart_", F.when(F.col("doc_id").isNull() | F.col("page").isNull(), i)) for i, p in enumerate(parts)]
    # Images are few a page: dealt out by document at once, neither they nor what is then worked out by document are shuffled again.
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).repartition("doc_id")
    numbers, flags = ["marker_hits", "front_hits", "back_hits", "n_items", "n_images", "largest"], ["has_marker", "has_image"]
    rows = rows.groupBy(*PAGE, "apart_").agg(*[(F.sum(c) if c == "n_images" else F.max(c)).alias(c) for c in numbers], *[F.bool_or(c).alias(c) for c in flags])
    return rows.select(*PAGE, *[F.coalesce(c, F.lit(0)).alias(c) for c in numbers], *[F.coalesce(c, F.lit(False)).alias(c) for c in flags])


def pages_to_read(picked: DataFrame, parsed: DataFrame) -> DataFrame:
    """doc_id, page: of the picked pages (doc_id, page, kind), those of a label alone where the form is known already (``parsed``: doc_id), else all."""
    known = parsed.select("doc_id").distinct().withColumn("known_", F.lit(True))
    rows = picked.join(known, "doc_id", "left")
    return rows.where(F.col("known_").isNull() | F.contains(F.col("kind"), F.lit("label"))).select(*PAGE)


def vlm_pages(picked: DataFrame, read: DataFrame) -> DataFrame:
    """doc_id, page: the page a vision model is shown: the first label page that was read (``read``: doc_id, page), else the first label page, the first page, or 1."""
    rows = picked.join(read.select(*PAGE).distinct().withColumn("read_", F.lit(True)), PAGE, "left")
    label = F.contains(F.col("kind"), F.lit("label"))
    first = lambda condition: F.min(F.when(condition, F.col("page")))
    return rows.groupBy("doc_id").agg(F.coalesce(first(label & F.col("read_")), first(label), F.min("page"), F.lit(1)).alias("page"))


# --- kinds ------------------------------------------------------------------------------------------------------------


def rank_of_kind(kind: Column) -> Column:
    """The rank of the tab that a page's kind stands for; null for a kind of none. A label page is the front's."""
    has = lambda word: F.contains(kind, F.lit(word))
    return F.when(has(FORM), RANKS[FORM]).when(has(BACK), RANKS[BACK]).when(has(FRONT) | has("label"), RANKS[FRONT])


def rank_of_field(field: Column) -> Column:
    """The rank of the tab that a field's box speaks for: the form's, the back's for the warning, else the front's."""
    return F.when(F.startswith(field, F.lit("application.")), RANKS[FORM]).when(field == "label.governmentWarning", RANKS[BACK]).otherwise(RANKS[FRONT])


def tab_of(rank: Column) -> Column:
    return F.when(rank == RANKS[FORM], FORM).when(rank == RANKS[BACK], BACK).when(rank == RANKS[FRONT], FRONT)


def drawn(box: str = "") -> Column:
    """Whether a box (source, words) can be shown: not a vision model's, and with words."""
    return F.coalesce((F.col(f"{box}source") != "vlm") & (F.size(f"{box}words") > 0), F.lit(False))


def page_kinds(pages: DataFrame, boxes: DataFrame) -> DataFrame:
    """doc_id, page, tab: from the kinds of pages (doc_id, page, kind) and the boxes of fields (doc_id, field, page, source, words).

    Both sources are one union, and a page's best rank wins; where a kind itself names the form, the front or the back, boxes do not change it.
    """
    kind = F.col("kind")
    lock = F.contains(kind, F.lit(FORM)) | F.contains(kind, F.lit(FRONT)) | F.contains(kind, F.lit(BACK))
    of_kind = pages.select(*PAGE, rank_of_kind(kind).alias("by_kind"), lock.alias("lock"), F.lit(None).cast("int").alias("by_box")).where("by_kind is not null")
    of_box = boxes.where(drawn()).select(*PAGE, F.lit(None).cast("int").alias("by_kind"), F.lit(False).alias("lock"), rank_of_field(F.col("field")).alias("by_box"))
    best = of_kind.unionByName(of_box).groupBy(*PAGE).agg(F.max("by_kind").alias("by_kind"), F.bool_or("lock").alias("lock"), F.max("by_box").alias("by_box"))
    return best.select(*PAGE, tab_of(F.when(F.col("lock"), F.col("by_kind")).otherwise(F.greatest("by_kind", "by_box"))).alias("tab"))


def available_tabs(kinds: DataFrame) -> DataFrame:
    """doc_id, tab and the lowest page of each."""
    return kinds.groupBy("doc_id", "tab").agg(F.min("page").alias("page"))


def of_fields(wanted: DataFrame, own: DataFrame) -> DataFrame:
    """wanted (doc_id, field) with the other columns of each row of ``own`` for that document and field, or nulls.

    A document's fields are few, so rows meet by document and ``between`` picks those of one field: an equality would be a key of the join, and
    all rows be dealt out by document and field, apart from everything else about their document.
    """
    rest = [c for c in own.columns if c not in ("doc_id", "field")]
    own = own.withColumnsRenamed({"doc_id": "own_doc_", "field": "own_field_"})
    same = (F.col("doc_id") == F.col("own_doc_")) & F.col("field").between(F.col("own_field_"), F.col("own_field_"))
    return wanted.join(own, same, "left").select(*wanted.columns, *rest)


def select_fields(wanted: DataFrame, boxes: DataFrame, kinds: DataFrame) -> DataFrame:
    """doc_id, field, tab, page, words and is_fallback for each wanted field (doc_id, field): where it is shown.

    A box with words is shown on its page, under that page's tab. Any other field has the tab it would belong to and that tab's lowest page, or none:
    the form for fields of the application, the front for the brand, else the front if the document has one, or the back.
    """
    by_doc = kinds.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("page", "tab"))).alias("tabs"),  # one entry a page
        *[F.min(F.when(F.col("tab") == t, F.col("page"))).alias(f"{t}_page") for t in RANKS],
    )
    own = boxes.select("doc_id", "field", F.col("page").alias("box_page"), F.col("source").alias("box_source"), F.col("words").alias("box_words"))
    rows = of_fields(wanted, own).join(by_doc, "doc_id", "left")
    shown = drawn("box_")
    field = F.col("field")
    side = F.when(F.col("front_page").isNull() & F.col("back_page").isNotNull(), BACK).otherwise(FRONT)
    assumed = F.when(F.startswith(field, F.lit("application.")), FORM).when(field == "label.brandName", FRONT).otherwise(side)
    tab = F.when(shown, F.coalesce(F.try_element_at("tabs", "box_page"), tab_of(rank_of_field(field)))).otherwise(assumed)
    rows = rows.withColumns({"tab": tab, "shown": shown})
    lowest = F.coalesce(*[F.when(F.col("tab") == t, F.col(f"{t}_page")) for t in RANKS])
    return rows.select(
        "doc_id", "field", "tab", F.when(F.col("shown"), F.col("box_page")).otherwise(lowest).alias("page"), F.when(F.col("shown"), F.col("box_words")).alias("words"),
        F.coalesce(F.col("box_source") == "vlm", F.lit(False)).alias("is_fallback"),
    )


# --- what a field's value rests on ------------------------------------------------------------------------------------


def field_sources(wanted: DataFrame, boxes: DataFrame, provenance: DataFrame) -> DataFrame:
    """doc_id, field, source and low for each wanted field (doc_id, field).

    boxes: doc_id, field, source, words, mean_confidence. provenance: doc_id, field, confidence, of an older kind of run. A box of the text layer or of OCR counts with
    words only, one of a vision model always; else an older entry stands for OCR. low: an entry says so, or the words' mean confidence is below LOW_CONFIDENCE.
    """
    own = boxes.select("doc_id", "field", F.col("source").alias("box_source"), F.size("words").alias("n_words"), "mean_confidence")
    older = provenance.where("confidence is not null").select("doc_id", "field", "confidence")
    rows = of_fields(of_fields(wanted, own), older)
    worded = F.col("box_source").isin("pdf", "tesseract") & (F.col("n_words") > 0)
    source = F.when(worded | (F.col("box_source") == "vlm"), F.col("box_source")).when(F.col("confidence").isNotNull(), "tesseract").otherwise("none")
    low = F.coalesce(F.col("confidence") == "low", F.lit(False)) | F.coalesce(F.col("mean_confidence") < LOW_CONFIDENCE, F.lit(False))
    return rows.select("doc_id", "field", source.alias("source"), low.alias("low"))
