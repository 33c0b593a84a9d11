"""Label fields without a pattern: class and type, prominent names, and the health warning as a block or region.

Input words have ``line``, the visual line of their page (see words.cluster_lines). Pages hold a bounded number of words.
"""

from __future__ import annotations

import re
from functools import reduce
from itertools import groupby, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N
from . import extract as E
from .words import PAGE, clean_value, is_header

#: Lines that are no class or name; patterns of class names; words of a warning region.
NOT_FIELD = r"(?i)(government|warning|attention|caution|contains|sulfites|alc|vol|proof|net|contents|gallons?|ounces?|ml|liters?)"
MADE_BY = r"(?i)(brewed|bottled|produced|distilled|imported)\s+by"
CHROME = r"(?i)(image type|actual dimensions|ttb|status|approved|surrendered|qualifications|expiration date|affix|omb no|ttbonline|front|back|keg\s+collar)"
CLASS_PATTERNS = [
    r"(?i)\b(?:india\s+pale\s+ale|pale\s+ale|ale|lager|stout|porter|pilsner|saison|beer)\b",
    r"(?i)\b(?:straight\s+bourbon\s+whiskey|bourbon\s+whiskey|whiskey|whisky|vodka|rum|gin|tequila|brandy|cognac|mezcal|liqueur|cordial|schnapps|distilled\s+spirits?|flavored\s+tequila)\b",
    r"(?i)\b(?:red|white|rose|rosé|pink|table|dessert|sparkling|carbonated|fruit|honey|rice)\s+(?:wine|blend)\b",
]
NOT_NAME = [
    NOT_FIELD, MADE_BY, CHROME, r"^[A-Z]{1,4}\.[A-Z]", r"(?i)^(?:beer|style|type|class/?type|brand)(?:\s*:\s*(?:beer|style|type|class/?type|brand))*\s*:?\s*$",
    r"(?i)\b(?:rd|road|st|street|ave|avenue|blvd|dr|drive|ln|lane|suite|ste)\.?\b", r"(?i)\b(?:brewing|brewery|winery|vineyards?|distillery|cidery|cellars?|co\.?|company|llc|inc)\b",
    r"(?i)(class/type|description)", r"^\d",
]
REGION_ANCHORS = [
    "government", "warning", "according", "rding", "surgeon", "general", "women", "drink", "pregnancy", "birth", "defect", "consumption", "beverage",
    "rages", "alcoholic", "dlic", "operate", "machinery", "mace", "health", "problem",
]
FOOTER = r"(?i)^(?:ttb|previous|editions|obsolete|https?://|www\.|\d+/\d+)$|ttbonline"
GROW_LEFT, GROW_UP, GROW_DOWN = 360, 180, 90


def lines_of(words: DataFrame, least_conf: int) -> DataFrame:
    """doc_id, page, line, w (its words by x), and the page's extent; words that are unsure or hold no letter or digit are left out."""
    extent = words.groupBy(*PAGE).agg(F.greatest(F.max("x1"), F.lit(1)).alias("page_x"), F.greatest(F.max("y1"), F.lit(1)).alias("page_y"))
    rows = words.where((F.col("conf") >= least_conf) & F.col("text").rlike("[A-Za-z0-9]"))
    own = rows.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("x0", "idx", "text", "conf", "y0", "x1", "y1"))).alias("w"))
    return own.join(extent, PAGE)


def joined_text(w: Column) -> Column:
    return E.clean_line(F.array_join(F.transform(w, lambda x: x["text"]), " "))


def measured(rows: DataFrame) -> DataFrame:
    """Mean confidence, height, width, centre and centre bonus of the words ``w``."""
    low = lambda n: F.array_min(F.transform("w", lambda x: x[n]))
    high = lambda n: F.array_max(F.transform("w", lambda x: x[n]))
    total = F.aggregate("w", F.lit(0).cast("double"), lambda a, x: a + x["conf"])
    rows = rows.withColumns({"mean_conf": F.round(total / F.size("w")), "height": high("y1") - low("y0"), "width": high("x1") - low("x0"), "cx": (low("x0") + high("x1")) / 2, "cy": (low("y0") + high("y1")) / 2})
    half = F.col("page_x") / 2
    return rows.withColumn("centred", 1 - F.least(F.lit(1.0), F.abs(F.col("cx") - half) / half))


def run_in(words: Column, value: Column) -> Column:
    """The best run of words that equals a value: near the word wine first, else the first one; null without any."""
    plain = F.transform(words, lambda x: N.lexicon_text(x["text"]))
    tokens = F.filter(F.split(N.lexicon_text(value), " "), lambda t: t != "")

    def best(p: Column, t: Column) -> Column:
        n = F.size(t)
        starts = F.when((n > 0) & (F.size(p) >= n), F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(p) - n + 1)), lambda i: F.slice(p, i, n) == t))
        near = F.filter(starts, lambda i: F.array_contains(F.slice(p, F.greatest(F.lit(1), i - 2), n + F.least(i - 1, F.lit(2)) + 3), "wine"))
        return F.coalesce(F.get(near, F.lit(0)), F.get(starts, F.lit(0)))

    at = N.once(plain, lambda p: N.once(tokens, lambda t: best(p, t)))
    return F.when(at.isNotNull(), F.slice(words, at, F.size(tokens)))


def best_of(rows: DataFrame, *columns: str) -> DataFrame:
    order = F.struct("score", F.when(F.contains("kind", F.lit("front")), 1).otherwise(0), -F.col("page"), -F.col("line"))
    return rows.groupBy("doc_id").agg(F.max_by(F.struct("page", "line", "text", "score", *columns), order).alias("b")).select("doc_id", "b.*")


def class_type_candidate(words: DataFrame, pages: DataFrame, expected: DataFrame) -> DataFrame:
    """doc_id, page, line, text, score, family: the line that names the class best. pages: doc_id, page, kind; expected: doc_id, product_type."""
    rows = lines_of(words, 30).where(F.size("w") <= 12).withColumn("line_text", joined_text(F.col("w")))
    rows = rows.where((F.col("line_text") != "") & ~reduce(lambda a, b: a | b, [F.col("line_text").rlike(p) for p in (NOT_FIELD, MADE_BY, CHROME)]))
    rows = rows.withColumn("family", N.family(F.col("line_text"))).where("family is not null")
    found = [N.varietal(F.col("line_text")), *[F.nullif(F.regexp_extract("line_text", p, 0), F.lit("")) for p in CLASS_PATTERNS]]
    rows = rows.withColumn("w", F.coalesce(*[F.when(v.isNotNull(), run_in(F.col("w"), v)) for v in found], F.col("w")))
    rows = measured(rows.withColumn("text", joined_text(F.col("w"))).where("text <> ''")).where("mean_conf >= 45")
    rows = rows.join(pages, PAGE, "left").join(expected, "doc_id", "left")
    score = F.when(F.col("family") == F.col("product_type"), 60).otherwise(0) + F.when(F.contains("kind", F.lit("front")), 10).otherwise(0) + F.when(F.col("cy") <= F.col("page_y") * 0.7, 8).otherwise(0) + F.col("centred") * 10 + F.col("height")
    return best_of(rows.withColumn("score", F.round(score, 6)), "family")


def name_tokens(v: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.regexp_replace(F.lower(F.coalesce(v, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+")), lambda t: F.length(t) >= 3)


def prominent_name(words: DataFrame, pages: DataFrame, brands: DataFrame) -> DataFrame:
    """doc_id, page, line, text, score: the most prominent short line that is not the known brand. brands: doc_id, brand."""
    rows = lines_of(words, 35).where(F.size("w") <= 5).withColumn("text", joined_text(F.col("w")))
    letters = F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    rows = rows.where(F.col("text").rlike("[A-Za-z]{3}") & (letters >= 5) & ~reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p in NOT_NAME]))
    rows = measured(rows).where((F.col("mean_conf") >= 75) & (F.col("cy") <= F.col("page_y") * 0.62))
    rows = rows.join(pages, PAGE, "left").join(brands, "doc_id", "left")
    shared = F.exists(name_tokens(F.col("text")), lambda a: F.exists(name_tokens(F.col("brand")), lambda b: E.similar(a, b)))
    score = F.col("height") * 2 + F.col("width") * 0.03 + F.col("centred") * 20 - F.when(F.col("text").rlike(r"\d"), 30).otherwise(0)
    return best_of(rows.where(~shared).withColumn("score", F.round(score, 6)))


def is_region_anchor(v: Column) -> Column:
    def hit(token: Column) -> Column:
        hits = [(token == a) | ((F.length(token) >= 5) & (F.contains(token, F.lit(a)) | F.contains(F.lit(a), token)) if len(a) >= 5 else F.lit(False)) for a in REGION_ANCHORS]
        return (F.length(token) >= 4) & reduce(lambda a, b: a | b, hits)

    return N.once(F.regexp_replace(F.lower(v), "[^a-z]", ""), hit)


def warning_region(words: DataFrame) -> DataFrame:
    """doc_id, page, text, words, mean_conf of the region around a page's warning words; three of them and eight words in all are needed. A page is gathered once, and its region taken inside its row."""
    anchor = is_region_anchor(F.col("text")).alias("anchor")
    marked = words.select(*PAGE, F.struct("y0", "x0", "idx", "text", "conf", "x1", "y1", anchor).alias("w_"))
    pages = marked.groupBy(*PAGE).agg(F.array_sort(F.collect_list("w_")).alias("all_"))
    pages = pages.withColumn("marks_", F.filter("all_", lambda w: w["anchor"])).where(F.size("marks_") >= 3)
    edge = lambda find, name: find(F.transform("marks_", lambda w: w[name]))
    rect = F.struct(edge(F.array_min, "x0").alias("x0"), edge(F.array_min, "y0").alias("y0"), edge(F.array_max, "x1").alias("x1"), edge(F.array_max, "y1").alias("y1"))

    def near(w: Column, r: Column) -> Column:
        cx, cy = (w["x0"] + w["x1"]) / 2, (w["y0"] + w["y1"]) / 2
        across = cx.between(F.greatest(F.lit(0.0), r["x0"] - GROW_LEFT), r["x1"] + GROW_LEFT)
        return across & cy.between(F.greatest(F.lit(0.0), r["y0"] - GROW_UP), r["y1"] + GROW_DOWN) & ~w["text"].rlike(FOOTER)

    held = N.once(rect, lambda r: F.filter("all_", lambda w: near(w, r)))
    rows = pages.select(*PAGE, F.inline(F.array(F.struct(held.alias("w")))))
    rows = rows.where((F.size("w") >= 8) & (F.size(F.filter("w", lambda w: w["anchor"])) >= 3))
    sure = F.filter(F.transform("w", lambda w: w["conf"].cast("double")), lambda v: v.isNotNull())
    mean = N.once(sure, lambda v: F.when(F.size(v) > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v)))
    return rows.select(*PAGE, F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("text"), F.size("w").cast("long").alias("words"), F.round(mean).cast("int").alias("mean_conf"))


def _complete(text: str) -> bool:
    plain = " ".join(text.lower().split())
    seen = {t for t in re.sub(r"[^a-z\s]", " ", plain).split() if len(t) >= 3}
    share = lambda anchors: sum(a in seen for a in anchors) / len(anchors) >= K.ANCHOR_SHARE
    return bool(re.search(r"\bproblems\b", plain)) or (K.WARNING_PREFIX.lower() in plain and share(K.ANCHORS_1) and share(K.ANCHORS_2))


def block_of(page: list[dict], most_lines: int) -> tuple[str, int, int | None] | None:
    """text, words and mean_conf of the block in a page's words, which are sorted by line, x0 and idx."""
    plain = lambda w: (w["text"] or "").lower()
    start = next((i for i, (a, b) in enumerate(pairwise(page)) if plain(a) == "government" and plain(b).startswith("warning") and a["line"] == b["line"]), None)
    if start is None:
        return None
    taken, left, right, missed = [], None, None, 0
    for _, line in islice(groupby(page[start:], key=lambda w: w["line"]), most_lines):
        clusters: dict = {}
        for w in line:
            clusters.setdefault(w["cluster"], []).append(w)
        if left is None:
            own = clusters[page[start]["cluster"]]
        else:
            beneath = lambda c: min(w["x0"] for w in c) <= right + 80 and max(w["x1"] for w in c) >= left - 80
            own = next((c for _, c in sorted(clusters.items()) if beneath(c)), None)
        if own is None:
            missed += 1
            if missed >= 2:
                break
            continue
        missed = 0
        taken += own
        sides = [w["x0"] for w in own] + [left] * (left is not None), [w["x1"] for w in own] + [right] * (right is not None)
        left, right = min(sides[0]), max(sides[1])
        text = " ".join(w["text"] for w in taken if w["text"] is not None)
        if _complete(text):
            break
    sure = [w["conf"] for w in taken if w["conf"] is not None]
    return (text, len(taken), int(sum(sure) / len(sure) + 0.5) if sure else None) if len(taken) >= 10 else None


def warning_block(words: DataFrame, most_lines: int = 18) -> DataFrame:
    """doc_id, page, text, words, mean_conf: from "government warning" on, the clusters of following lines that lie below.

    words carry ``line`` and ``cluster`` (see words.split_at_gaps). The walk ends after two lines without a
    cluster, or once the text is complete; ten words are needed. It depends on order, so each page is folded by itself;
    pages reach Python as rows, many in a batch, and only those that hold the first word.
    """
    page = F.array_sort(F.collect_list(F.struct("line", "x0", "idx", "cluster", "text", "conf", "x1")))
    pages = words.groupBy(*PAGE).agg(page.alias("w")).where(F.exists("w", lambda w: F.lower(w["text"]) == "government"))

    def folded(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # what is unpacked at once
                part = batch.slice(at, 500)
                found = [block_of(w, most_lines) for w in part.column("w").to_pylist()]
                keep = [i for i, f in enumerate(found) if f]
                columns = [part.column(c).take(pa.array(keep, pa.int64())) for c in PAGE]
                columns += [pa.array([found[i][k] for i in keep], kind) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, [*PAGE, "text", "words", "mean_conf"])

    kind = words.schema
    schema = f"doc_id {kind['doc_id'].dataType.simpleString()}, page {kind['page'].dataType.simpleString()}, text string, words int, mean_conf int"
    return pages.mapInArrow(folded, schema)


def below_marker(words: DataFrame, runs: DataFrame, x0: float, x1: float) -> DataFrame:
    """doc_id, page, value: the first line under a marker, its centre in the x range and 3 to 30 points below the marker's centre; section headers are no value.

    runs has my, the marker's centre; y grows downwards. The first line is what lies within 3 points of the topmost word.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    near = words.join(runs.select(*PAGE, "my"), PAGE).withColumn("cy", cy).where(cx.between(x0, x1) & (cy > F.col("my") + 3) & (cy - F.col("my") <= 30))
    top = near.groupBy(*PAGE).agg(F.min("cy").alias("top"))
    line = near.join(top, PAGE).where(F.col("cy") - F.col("top") <= 3)
    value = clean_value(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "idx", "text"))), lambda w: w["text"]), " "))
    return line.groupBy(*PAGE).agg(value.alias("value")).where((F.col("value") != "") & ~is_header(F.col("value")))
