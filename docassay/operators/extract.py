"""Field extraction from page texts and words."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N

#: Patterns of label fields, in order of priority within a field.
PATTERNS = {
    "abv": [r"(?i)\b\d{1,2}(?:\.\d{1,2})?\s*%\s*(?:abv|alc|by\s*vol|vol)\b", r"(?i)\balc\.?\s*\d{1,2}(?:\.\d{1,2})?\s*%", r"(?i)\(\s*\d{1,3}\s+proof\s*\)", r"\b\d{1,2}(?:\.\d{1,2})?\s*%"],
    "netContents": [r"(?i)\b\d+(?:\.\d+)?\s*(?:m?l|fl\.?\s*oz|gal)\b"],
    "producer": [
        r"(?i)\b(?:produced|bottled|distilled|imported|brewed|vinified)(?:\s+and\s+\w+)?\s+by\s*:?\s*[A-Z][A-Za-z0-9'.,&\-\s]{2,120}?"
        r"(?=\s+(?:government|contains|net\s+content|alc\.?|vol\.?|product\s+of|caution|©|approved|class/type|item\s+\d+)|\s*$)"
    ],
    "countryOfOrigin": [r"(?i)\bproduct\s+of\s+([a-z][a-z.,\s'-]{2,40}?)(?=\s*(?:\b(?:contains|net|alc|bottled|imported|distilled|produced|address|gov)\b|$|\.))", r"(?i)\bproduct\s+of\s+([a-z][a-z.,\s'-]{2,30})"],
}
#: Codes of states in an upper-cased text; texts that are not a brand.
STATE_CODE = r"\b(?:A[LKZR]|C[AOT]|D[CE]|FL|GA|HI|I[ADLN]|K[SY]|LA|M[ADEHINOST]|N[CDEHJMVY]|O[HKR]|PA|RI|S[CD]|T[NX]|UT|V[AIT]|W[AIVY])\b"
NOT_BRAND = r"(?i)(?:image\s*type|actual\s+dimensions|ttb|ttbonline|www\.?|\.com|https?|government|warning|front|back|keg\s+collar|status|approved|class/?type|description)"
LEAST_BRAND, UNSURE = 0.75, 60
STRICT = {
    "WINE": r"\b(?:WINE|PORT|SHERRY|VERMOUTH|CHAMPAGNE|RIESLING|CHARDONNAY|CABERNET|MERLOT|PINOT|SAUVIGNON|MOSCATO|VINEYARD)\b",
    "MALT BEVERAGES": r"\b(?:MALT|BEER|ALE|LAGER|STOUT|PORTER|IPA|PILSNER|WEISSE|SAISON)\b",
    "DISTILLED SPIRITS": r"\b(?:SPIRITS|WHISKEY|WHISKY|VODKA|RUM|GIN|TEQUILA|BOURBON|BRANDY|COGNAC|MEZCAL|LIQUEUR|DISTILLED)\b",
}
NOTHING = ["", "-", "n/a", "na", "none", "not applicable"]
PRODUCT_WORDS = r"\b(?:wine|blend|beer|ale|lager|vodka|whiskey|whisky|tequila|rum|gin|chardonnay|cabernet|merlot|pinot|sauvignon|riesling)\b"


#: An extractor makes label fields (doc_id, field, value, page) of words and forms; any producer of such a table can stand in.
Extractor = Callable[[DataFrame, DataFrame], DataFrame]


def page_texts(words: DataFrame) -> DataFrame:
    """doc_id, page, text of words in reading order."""
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "idx", "text")))
    return words.groupBy("doc_id", "page").agg(F.array_join(F.transform(ordered, lambda w: w["text"]), " ").alias("text"))


def pattern_extractor(words: DataFrame, forms: DataFrame) -> DataFrame:
    """The extractor by patterns; it does not look at the forms."""
    return first_patterns(page_texts(words)).select("doc_id", "field", "value", "page")


def first_patterns(pages: DataFrame, patterns: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, field, page, value: patterns in order of priority, each over all pages before the next; the first page wins."""
    hits = []
    for field, own in (patterns or PATTERNS).items():
        for i, p in enumerate(own):
            hits.append(F.struct(F.lit(field).alias("field"), F.lit(i).alias("priority"), F.regexp_extract("text", p, 0).alias("value")))
    rows = pages.select("doc_id", "page", F.explode(F.array(*hits)).alias("h")).where("h.value <> ''").select("doc_id", "page", "h.*")
    best = rows.groupBy("doc_id", "field").agg(F.min_by(F.struct("page", "value"), F.struct("priority", "page")).alias("b"))
    return best.select("doc_id", "field", "b.page", F.col("b.value").alias("value"))


def words_of_match(words: DataFrame, matches: DataFrame) -> DataFrame:
    """Words that a match touches: words (doc_id, page, idx, text, start, stop) joined to matches (doc_id, page, from_, to_) by overlapping spans."""
    return words.join(matches, ["doc_id", "page"]).where((F.col("start") < F.col("to_")) & (F.col("stop") > F.col("from_")))


def similar(a: Column, b: Column) -> Column:
    """Equal; or one within the other with lengths close enough; or the same first four characters."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    within = (short >= 4) & (short / F.greatest(long, F.lit(1)) >= 0.75) & (F.contains(a, b) | F.contains(b, a))
    return (a == b) | within | ((short >= 4) & (F.substring(a, 1, 4) == F.substring(b, 1, 4)))


def similar_links(left: DataFrame, right: DataFrame) -> DataFrame:
    """Similar pairs of tokens (a, b) of two columns of tokens.

    Candidates meet on a blocking key: the token, its first four characters, or (for containment) any
    of its runs of three quarters of the longer length; then the predicate is checked.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        t = F.col(name)
        runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(t) - 3)), lambda i: F.substr(t, i, F.lit(4)))
        return df.where(F.length(t) >= 1).select(name).distinct().select(name, F.explode(F.array_distinct(F.when(F.length(t) >= 4, runs).otherwise(F.array(t)))).alias("key"))

    pairs = keyed(left, "a").join(keyed(right, "b"), "key").select("a", "b").distinct()
    return pairs.where(similar(F.col("a"), F.col("b")))


def brand_match(pages: DataFrame) -> DataFrame:
    """doc_id, page, start, size, score: of each document the run of words that covers its brand's tokens best.

    pages: doc_id, page, brand, words (array). A run that covers enough holds a word that is like, or part of, a token of the brand: only runs
    around such words are made, inside the page's row, and only the best of them leaves it.
    """
    tokens = F.filter(F.split(F.regexp_replace(F.lower("brand"), r"[^a-z0-9\s]", " "), r"\s+"), lambda t: F.length(t) >= 2)
    rows = pages.select("doc_id", "page", "words", tokens.alias("brand"), F.transform("words", lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", "")).alias("plain"))
    n = F.size("brand")
    whole = F.array_join("brand", "")
    # Joined words contain a token only if one of them shares a character run with it: a word within the brand's letters, or that begins or ends one of its tokens.
    near = lambda t: F.exists("brand", lambda b: similar(t, b) | F.contains(t, b) | F.contains(b, t) | touches(t, b))
    at = F.filter(F.sequence(F.lit(0), F.size("plain") - 1), lambda i: N.once(F.get("plain", i), lambda t: (F.length(t) >= 2) & near(t)))
    rows = rows.where((n > 0) & (F.size("plain") > 0) & (whole != "")).select("*", n.alias("n"), F.least(F.greatest(n + 1, F.lit(3)), F.lit(6)).alias("most"), at.alias("at"))
    starts = F.array_sort(F.array_distinct(F.flatten(F.transform("at", lambda i: F.sequence(F.greatest(F.lit(0), i - F.col("most") + 1), i)))))
    rows = rows.withColumn("starts", F.filter(starts, lambda i: F.length(F.get("plain", i)) >= 2))

    def scored(start: Column, size: Column) -> Column:
        def score(w: Column) -> Column:
            joined = F.array_join(w, "")
            covered = F.size(F.filter("brand", lambda b: F.exists(w, lambda t: similar(t, b)) | ((F.col("n") > 1) & F.contains(joined, b))))
            points = covered / F.col("n") + F.when(F.size(w) == F.col("n"), 0.05).otherwise(0.0) - F.greatest(F.lit(0), F.size(w) - F.col("n")) * 0.08
            return F.struct(F.round(points, 9).alias("score"), (-F.col("page")).alias("p"), (-start).alias("a"), (-size).alias("b"))

        window = F.filter(F.slice("plain", start + 1, size), lambda t: F.length(t) >= 2)
        chrome = F.array_join(F.slice("words", start + 1, size), " ").rlike(NOT_BRAND)
        fits = start + size <= F.size("plain")
        return F.when(fits & ~chrome, N.once(window, score))

    runs = F.flatten(F.transform("starts", lambda i: F.transform(F.sequence(F.lit(1), F.col("most")), lambda k: scored(i, k))))
    best = rows.select("doc_id", F.array_max(F.filter(runs, lambda r: r["score"] >= LEAST_BRAND)).alias("r"))
    # Documents without a run go after the grouping: a filter before it would be pushed below the runs and make them twice.
    found = best.groupBy("doc_id").agg(F.max("r").alias("r")).where("r is not null")
    return found.select("doc_id", (-F.col("r.p")).alias("page"), (-F.col("r.a")).alias("start"), (-F.col("r.b")).alias("size"), "r.score")


def touches(t: Column, b: Column) -> Column:
    """Whether a beginning of ``b`` ends ``t`` or an end of ``b`` begins it, so that joined words may hold ``b``."""
    cuts = F.sequence(F.lit(1), F.least(F.length(t), F.length(b)))
    return F.exists(cuts, lambda k: (F.right(t, k) == F.left(b, k)) | (F.left(t, k) == F.right(b, k)))


def clean_line(v: Column) -> Column:
    plain = N.whitespace(F.regexp_replace(v, "[“”\"']", ""))
    return F.trim(F.regexp_replace(plain, r"^[|\\/.,;:-]+|[|\\/.,;:-]+$", ""))


def warning_score(v: Column) -> Column:
    """0 to 7 by how much of the health warning a text holds."""
    plain = F.lower(N.whitespace(F.coalesce(v, F.lit(""))))
    words = plain.rlike(r"\bgovernment\s+warning\b")
    one, two = (N.anchor_coverage(v, a) >= K.ANCHOR_SHARE for a in (K.ANCHORS_1, K.ANCHORS_2))
    parts = [(words, 1), (F.contains(plain, F.lit(K.WARNING_PREFIX.lower())), 1), (one, 2), (two, 2), (plain == K.WARNING.lower(), 1)]
    return reduce(lambda a, b: a + b, [F.when(c, n).otherwise(0) for c, n in parts])


def region_text(v: Column) -> Column:
    """A region's own text with prefix and both sentences; the canonical text with both sentences only; else null."""
    both = (N.anchor_coverage(v, K.ANCHORS_1) >= K.ANCHOR_SHARE) & (N.anchor_coverage(v, K.ANCHORS_2) >= K.ANCHOR_SHARE)
    prefix = F.contains(F.lower(N.whitespace(v)), F.lit(K.WARNING_PREFIX.lower()))
    return F.when(both & prefix, v).when(both, F.lit(K.WARNING))


def domestic_hint(producer: Column) -> Column:
    return F.coalesce(F.upper(producer).rlike(STATE_CODE) & ~producer.rlike(r"(?i)^\s*imported\s+by\b"), F.lit(False))


def fallback_targets(fields: DataFrame) -> DataFrame:
    """doc_id, field of what must be read again: fields (doc_id, product_type, field, value, has_box, mean_conf, source)."""
    warning = F.col("field") == "governmentWarning"
    canonical = F.coalesce(F.lower(N.whitespace(F.col("value"))) == K.WARNING.lower(), F.lit(False))
    poor = (F.coalesce(F.trim("value"), F.lit("")) == "") | ~F.col("has_box") | F.coalesce(F.col("mean_conf") < UNSURE, F.lit(False))
    need = F.when(F.col("field").startswith("wine") & (F.col("product_type") != "WINE"), False).when(warning & ~canonical, True).when(F.col("source") == "vlm", False).otherwise(poor)
    return fields.where(need).select("doc_id", "field").distinct()


def plain_dashes(v: Column) -> Column:
    return F.lower(N.whitespace(F.regexp_replace(v, "[—–-]+", "-")))


def form_wine_value(v: Column) -> Column:
    """'N/A' for values that declare nothing, null for the word null, else the trimmed value."""
    plain = plain_dashes(v)
    return F.when(plain == "null", None).when(plain.isin(NOTHING), "N/A").otherwise(F.trim(v))


def label_value(field: Column, v: Column) -> Column:
    """A re-read label value as it may be stored; null where it must not be."""
    nothing = plain_dashes(v).isin([*NOTHING, "null"])
    varietal = F.when(~nothing & ~N.type_only(v), N.varietal(v))
    appellation = F.when(~nothing, F.coalesce(N.appellation(v), F.when(~N.type_only(v), F.trim(v))))
    plain = F.lower(N.whitespace(v))
    country = F.when(~plain.isin("", "null", "n/a", "na", "none", "not applicable", "american") & ~plain.rlike(PRODUCT_WORDS), F.trim(v))
    return F.when(field == "wineVarietal", varietal).when(field == "wineAppellation", appellation).when(field == "countryOfOrigin", country).otherwise(v)


def source_value(v: Column) -> Column:
    return F.when(F.lower(v).startswith("imp"), "Imported").otherwise("Domestic")


def merge_answers(fields: DataFrame, answers: DataFrame) -> DataFrame:
    """doc_id, field, value, source, taken: re-read answers where they may be stored; a warning also needs a strictly higher score.

    The box stays where the answer is not taken, is a warning, or says the same; else its source becomes vlm.
    """
    rows = fields.join(answers.select("doc_id", "field", F.col("value").alias("answer")), ["doc_id", "field"], "left")
    stored = label_value(F.col("field"), F.col("answer"))
    empty = F.coalesce(F.trim("value"), F.lit("")) == ""
    better = (F.col("field") != "governmentWarning") | empty | (warning_score(F.col("answer")) > warning_score(F.col("value")))
    rows = rows.withColumn("stored", stored).withColumn("taken", F.col("stored").isNotNull() & better)
    same = N.comparison_text(F.col("value")) == N.comparison_text(F.col("stored"))
    keep = ~F.col("taken") | (F.col("field") == "governmentWarning") | same
    return rows.select("doc_id", "field", F.when(F.col("taken"), F.col("stored")).otherwise(F.col("value")).alias("value"), F.when(keep, F.col("source")).otherwise("vlm").alias("source"), "taken")


def strict_family(v: Column) -> Column:
    """The one family that an upper-cased text names."""
    found = F.array_compact(F.array(*[F.when(F.upper(v).rlike(p), n) for n, p in STRICT.items()]))
    return N.once(found, lambda f: F.when(F.size(f) == 1, f[0]))


def all_caps(v: Column) -> Column:
    return ~v.rlike("[a-z]")


# --- boxes that go with values ----------------------------------------------------------------------------------------

BOX = "struct<page: int, source: string, words: array<struct<text: string, conf: double>>, mean_confidence: double>"
NEAR_BEFORE, NEAR_AFTER, WINE_BONUS = 2, 3, 10


def best_run(box: Column, values: Column) -> Column:
    """A field's box (BOX) narrowed to the run of its words that reads like one of ``values`` (an array of texts); null without one, or for a box without words of its own.

    A run scores its words, and WINE_BONUS if "wine" stands near it; of equal scores the first run counts.
    """

    def placed(plain: Column, tokens: Column) -> Column:
        size = F.size(tokens)
        starts = F.when((size > 0) & (F.size(plain) >= size), F.sequence(F.lit(0), F.size(plain) - size)).otherwise(F.array().cast("array<int>"))
        runs = F.filter(starts, lambda i: F.slice(plain, i + 1, size) == tokens)
        low = lambda i: F.greatest(i - NEAR_BEFORE, F.lit(0))
        near = lambda i: F.array_contains(F.slice(plain, low(i) + 1, i + size + NEAR_AFTER - low(i)), "wine")
        return F.transform(runs, lambda i: F.struct((size + F.when(near(i), WINE_BONUS).otherwise(0)).alias("score"), (-i).alias("before"), size.alias("size")))

    def narrowed(plain: Column) -> Column:
        tokens = lambda v: F.filter(F.split(N.lexicon_text(v), " "), lambda t: t != "")
        runs = F.flatten(F.transform(values, lambda v: N.once(tokens(v), lambda t: placed(plain, t))))
        return N.once(F.array_max(runs), cut_out)

    def cut_out(best: Column) -> Column:
        words = F.slice(box["words"], -best["before"] + 1, best["size"])
        mean = F.round(F.aggregate(words, F.lit(0.0), lambda a, w: a + w["conf"]) / best["size"])
        return F.when(best.isNotNull(), F.struct(box["page"].alias("page"), box["source"].alias("source"), words.alias("words"), mean.alias("mean_confidence")))

    usable = box.isNotNull() & (box["source"] != "vlm") & (F.size(box["words"]) > 0)
    return F.when(usable, N.once(F.transform(box["words"], lambda w: N.lexicon_text(w["text"])), narrowed))


def wine_hints(labels: DataFrame) -> DataFrame:
    """``labels`` (class_type, producer, wine_varietal, wine_appellation, and a BOX of each: class_type_box, producer_box, wine_varietal_box, wine_appellation_box) with missing
    varietals and appellations taken from the class and the producer, and their boxes narrowed to the words that say so. A value that is there keeps its box."""
    grapes = N.lexicon_found(F.col("class_type"), K.VARIETALS)
    of_class, of_producer = (N.lexicon_found(F.col(c), K.APPELLATIONS) for c in ("class_type", "producer"))
    no_varietal, no_appellation = (F.coalesce(F.col(c) == "", F.lit(True)) for c in ("wine_varietal", "wine_appellation"))
    first = lambda found: F.get(found, F.lit(0))
    rows = labels.withColumns({"grapes_": F.when(no_varietal, grapes), "of_class_": F.when(no_appellation, first(of_class)), "of_producer_": F.when(no_appellation, first(of_producer))})
    said = lambda m: F.array(m["key"], m["name"])
    grape_box = F.when(F.size("grapes_") > 0, best_run(F.col("class_type_box"), F.transform("grapes_", lambda e: e["key"])))
    place_box = F.when(F.col("of_class_").isNotNull(), best_run(F.col("class_type_box"), said(F.col("of_class_")))).when(F.col("of_producer_").isNotNull(), best_run(F.col("producer_box"), said(F.col("of_producer_"))))
    return rows.withColumns({
        "wine_varietal_box": F.coalesce(grape_box, "wine_varietal_box"), "wine_appellation_box": F.coalesce(place_box, "wine_appellation_box"),
        "wine_varietal": F.coalesce(F.nullif(F.array_join(F.transform("grapes_", lambda e: e["name"]), ", "), F.lit("")), "wine_varietal"),
        "wine_appellation": F.coalesce(F.col("of_class_")["name"], F.col("of_producer_")["name"], F.col("wine_appellation")),
    }).drop("grapes_", "of_class_", "of_producer_")


def origin_hint(labels: DataFrame) -> DataFrame:
    """``labels`` (country_of_origin, producer, and country_of_origin_box, producer_box) with USA, and the producer's box, where no country stands and the producer is a domestic one."""
    hint = (F.coalesce(F.col("country_of_origin"), F.lit("")) == "") & domestic_hint(F.col("producer"))
    rows = labels.withColumn("hint_", hint)
    return rows.withColumns({"country_of_origin": F.when(F.col("hint_"), "USA").otherwise(F.col("country_of_origin")), "country_of_origin_box": F.when(F.col("hint_"), F.coalesce("producer_box", "country_of_origin_box")).otherwise(F.col("country_of_origin_box"))}).drop("hint_")


#: The fields of a form that are read again, and those that only wine has.
FORM_TARGETS = ["application.brandName", "application.fancifulName", "application.source", "application.productType", "application.applicant.name"]
WINE_TARGETS = ["application.grapeVarietals", "application.wineAppellation"]


def form_fallback_targets(fields: DataFrame) -> DataFrame:
    """doc_id, field of what of a form must be read again: fields (doc_id, field, value, box, is_wine). A vision model's value is not asked for twice."""
    value, box = F.col("value"), F.col("box")
    poor = (F.coalesce(F.trim(value), F.lit("")) == "") | box.isNull() | F.coalesce(box["mean_confidence"] < UNSURE, F.lit(False))
    asked = F.col("field").isin(FORM_TARGETS) | (F.col("field").isin(WINE_TARGETS) & F.col("is_wine"))
    return fields.where(asked & ~F.coalesce(box["source"] == "vlm", F.lit(False)) & poor).select("doc_id", "field").distinct()


def merge_form_answers(fields: DataFrame, answers: DataFrame, pages: DataFrame) -> DataFrame:
    """doc_id, field, value, box: fields of a form (doc_id, field, value, box) with re-read values in their place.

    answers: doc_id, field, value, one for each field that was asked for. A null answer keeps the value; whatever it says, the box of a field that was asked for is a vision
    model's from now on, without words, on the document's first page (pages: doc_id, page; 1 without any).
    """
    first = pages.groupBy("doc_id").agg(F.min("page").cast("int").alias("first_page"))
    rows = fields.join(answers.select("doc_id", "field", F.col("value").alias("answer"), F.lit(True).alias("asked")), ["doc_id", "field"], "left").join(first, "doc_id", "left")
    box = F.struct(F.coalesce("first_page", F.lit(1)).alias("page"), F.lit("vlm").alias("source"), F.array().cast("array<struct<text: string, conf: double>>").alias("words"), F.lit(None).cast("double").alias("mean_confidence"))
    field = F.col("field")
    answer = F.col("answer")
    stored = F.when(answer.isNull(), F.col("value")).when(field.isin(WINE_TARGETS), form_wine_value(answer)).when(field == "application.source", source_value(answer))
    stored = stored.when(field == "application.productType", F.coalesce(strict_family(answer), "value")).otherwise(answer)
    return rows.select("doc_id", "field", stored.alias("value"), F.when(F.col("asked"), box).otherwise(F.col("box")).alias("box"))
