"""Queries of page geometry and extraction over words, items, images and pages derived from the given tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N
from ..operators import extract as E
from ..operators import pages as P
from ..operators import words as W
from . import duck as D
from . import fixtures as X
from .text_queries import FX, KEYS

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def add(name, make, sql=None):
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


# --- words: documents, a page each, a visual line for each text line ---
WORDS = """ln as (select doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) z from documents),
wd as (select doc_id, z[2] as row_no, unnest(list_zip(string_split(z[1], ' '), range(len(string_split(z[1], ' '))))) y from ln),
wp as (select doc_id, row_no, y[2] as word, y[1] as text, sum(len(y[1]) + 1) over (partition by doc_id, row_no order by y[2]) - len(y[1]) - 1 as cum from wd),
fx_words as (select doc_id, 1 as page, row_no * 100000 + word as idx, row_no as line, text, 40 + (len(text) * 7 + word) % 60 as conf, (10 * cum)::double as x0, (20 * row_no + word % 3)::double as y0, (10 * cum + 8 * len(text))::double as x1, (20 * row_no + word % 3 + 12)::double as y1 from wp where text <> '')"""


def boxed(row_no, word, text, cum):
    """A word's number and box on its page."""
    x0, y0 = cum * 10.0, row_no * 20.0 + word % 3
    return {"idx": row_no.cast("long") * 100000 + word, "x0": x0, "y0": y0, "x1": x0 + 8 * F.length(text), "y1": y0 + 12}


def words(s, d):
    rows = X.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row_no", "row"))
    rows = rows.select("doc_id", "row_no", F.posexplode(N.placed(F.split("row", " "), 1)).alias("word", "z")).select("doc_id", "row_no", "word", "z.text", c("z.start").alias("cum")).where("text <> ''")
    at = boxed(c("row_no"), c("word"), c("text"), c("cum"))
    return rows.select(
        "doc_id", F.lit(1).alias("page"), at["idx"].alias("idx"), c("row_no").alias("line"), "text", (40 + (F.length("text") * 7 + c("word")) % 60).alias("conf"),
        *[at[k].alias(k) for k in ("x0", "y0", "x1", "y1")],
    )


def word_pages(s, d):
    """The same words, gathered by page: each is made where its text is, so that texts are shuffled and words are not. Rows that share an id are one page."""

    def word(row_no, k, text, cum):
        at = boxed(row_no, k, text, cum) | {"text": text}
        return F.struct(*[at[n].alias(n) for n in W.READING])

    boxes = lambda parts, row_no: N.once(N.offsets(parts, 1), lambda at: F.transform(parts, lambda p, k: word(row_no, k, p, F.get(at, k))))
    row = lambda t, row_no: F.filter(N.once(F.split(t, F.lit(" ")), lambda parts: boxes(parts, row_no)), lambda w: w["text"] != "")
    page = lambda t: F.flatten(F.transform(F.split(t, F.lit("\n")), row))
    texts = X.table(s, d, "documents").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    return texts.select("doc_id", F.lit(1).alias("page"), F.flatten(F.transform("texts", page)).alias("words"))


add("G25_spike_page_summary", lambda s, d: W.page_summary(words(s, d)), f"with {WORDS} select doc_id, page, count(*) as words, count(distinct line) as lines, round(avg(conf))::bigint as mean_confidence, count(*) filter (conf < 60) as unsure from fx_words group by all")
add("G19_field_mean_confidence", lambda s, d: words(s, d).groupBy("doc_id", "line").agg(F.round(F.avg("conf")).cast("long").alias("mean_confidence")), f"with {WORDS} select doc_id, line, round(avg(conf))::bigint as mean_confidence from fx_words group by all")
_boxes = ", ".join(f"('{n}', {a}, {b}, {e}, {f})" for n, (a, b, e, f) in W.FORM_BOXES.items())
add("G6_box_assign", lambda s, d: W.in_boxes(words(s, d), W.FORM_BOXES).select("doc_id", "idx", "field", "text"), f"with {WORDS}, b(field, bx0, by0, bx1, by1) as (values {_boxes}) select doc_id, idx, field, text from fx_words join b on (x0 + x1) / 2 between bx0 and bx1 and (y0 + y1) / 2 between by0 and by1")
add("G10_rect_union", lambda s, d: W.rect_union(words(s, d), "line"), f"with {WORDS} select doc_id, page, line, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as n from fx_words group by all")
_gap = "case when x0 - lag(x1) over (partition by doc_id, page, line order by x0, idx) > 48 then 1 else 0 end"
_wide = lambda s, d: words(s, d).withColumns({"x0": c("x0") + (c("line") * 7 + c("idx") % 100000) * 9.0 * (c("idx") % 5), "x1": c("x1") + (c("line") * 7 + c("idx") % 100000) * 9.0 * (c("idx") % 5)})
WIDE = f"{WORDS}, wide as (select * replace (x0 + (line * 7 + idx % 100000) * 9.0 * (idx % 5) as x0, x1 + (line * 7 + idx % 100000) * 9.0 * (idx % 5) as x1) from fx_words)"
add("G9_line_gap_split", lambda s, d: W.split_at_gaps(_wide(s, d), 48).select("doc_id", "idx", "cluster"), f"with {WIDE}, g as (select *, {_gap} j from wide) select doc_id, idx, (sum(j) over (partition by doc_id, page, line order by x0, idx rows unbounded preceding))::bigint as cluster from g")
# Rows less than a tolerance apart, so that the running mean decides; heights differ by document and word.
TALL = f"{WORDS}, tall as (select doc_id, page, idx, text, x0, y0 * 0.37 as y0, x1, y0 * 0.37 + 6 + doc_id % 25 + idx % 3 as y1 from fx_words)"


def tall(s, d):
    return words(s, d).drop("line").withColumns({"y0": c("y0") * 0.37, "y1": c("y0") * 0.37 + 6 + c("doc_id") % 25 + c("idx") % 3}).select("doc_id", "page", "idx", "y0", "y1")


def clustered(centre: str, tolerance: str, centroid: bool) -> str:
    """The greedy rule as a recursion over the different centres of a page, from the first to the last."""
    near = f"abs(f.mean - o.y) {'<=' if centroid else '<'} o.tol"
    mean = "(f.mean * f.n + o.y * o.m) / (f.n + o.m)" if centroid else "f.mean"
    return f"""with recursive {TALL.replace("ln as (", "ln as (", 1)}, tl as (select doc_id, page, {tolerance} tol from tall group by all),
g as (select t.doc_id, t.page, {centre} y, tol, count(*) m from tall t join tl using (doc_id, page) group by all), o as (select *, row_number() over (partition by doc_id, page order by y) k from g),
f as (select doc_id, page, k, y, y::double mean, m n, 0 line from o where k = 1 union all
 select o.doc_id, o.page, o.k, o.y, case when {near} then {mean} else o.y end, case when {near} then f.n + o.m else o.m end, case when {near} then f.line else f.line + 1 end from f join o on o.doc_id = f.doc_id and o.page = f.page and o.k = f.k + 1)
select t.doc_id, t.page, t.idx, f.line from tall t join f on f.doc_id = t.doc_id and f.page = t.page and f.y = {centre}"""


_median = "greatest(10, 0.8 * coalesce(list_sort(list(y1 - y0) filter (y1 > y0))[count(*) filter (y1 > y0) // 2 + 1], 16))"
add("G7_line_cluster_centroid", lambda s, d: W.cluster_lines(tall(s, d), 10.0).select("doc_id", "page", "idx", "line"), clustered("(t.y0 + t.y1) / 2", "10.0", True))
add("G7_line_cluster_ocr", lambda s, d: W.cluster_lines(tall(s, d)).select("doc_id", "page", "idx", "line"), clustered("(t.y0 + t.y1) / 2", _median, True))
add("G8_line_cluster_anchor", lambda s, d: W.cluster_lines(tall(s, d), 18.0, centroid=False).select("doc_id", "page", "idx", "line"), clustered("t.y0", "18.0", False))


def overlaps(s, d):
    a = W.rect_union(words(s, d), "line")
    b = a.select("doc_id", (c("line") - 1).alias("line"), c("x0").alias("n0"), c("x1").alias("n1"))
    return a.join(b, ["doc_id", "line"]).select("doc_id", "line", W.span_overlap("x0", "x1", "n0", "n1").alias("overlap"))


add("G11_span_overlap", overlaps, f"with {WORDS}, r as (select doc_id, line, min(x0) a, max(x1) b from fx_words group by all) select r.doc_id, r.line, r.a <= n.b + 80 and r.b >= n.a - 80 as overlap from r join r n on n.doc_id = r.doc_id and n.line = r.line + 1")
_plain = "regexp_replace(lower(text), '[:.,]+$', '')"
RUNS = f"""{WORDS}, lead_ as (select *, {_plain} p0, lead({_plain}) over w p1, lead(x1) over w e1, row_number() over w pos from fx_words window w as (partition by doc_id, page order by y0, x0, idx)),
runs as (select doc_id, page, arg_min({{'x0': x0, 'y0': y0, 'e1': e1, 'idx': idx}}, pos) m from lead_ where contains(p0, 'th') and contains(p1, 'on') group by all)"""
add("G12_marker_run_search", lambda s, d: W.marker_runs_of(word_pages(s, d), "th ON").select("doc_id", "x0", "y0", c("end_x1"), "idx"), f"with {RUNS} select doc_id, m.x0 as x0, m.y0 as y0, m.e1 as end_x1, m.idx as idx from runs")
_th_on = [W.Landmark("x", "th ON", "right", 250)]
add(
    "G13_landmark_value",
    lambda s, d: W.landmark_values_of(word_pages(s, d), _th_on).select("doc_id", "page", "value"),
    f"""with {RUNS}, every as (select doc_id, page, pos, y0 my0, e1 from lead_ where contains(p0, 'th') and contains(p1, 'on')), v as (select f.doc_id, f.page, pos, string_agg(f.text, ' ' order by f.y0, f.x0, f.idx) as value from fx_words f join every using (doc_id, page) where abs(f.y0 - my0) < 18 and f.x0 > e1 and f.x0 - e1 < 250 group by all)
select doc_id, page, arg_min(value, pos) as value from v group by all""",
)

# --- a form's words: printed labels and, below or beside them, values; some labels stand there twice, first without a value ---
FORM_LINES = [
    (0, "'5. TYPE OF PRODUCT (Required)'"), (1, "case when doc_id % 4 = 0 then 'Wine Distilled Spirits Malt Beverages' when doc_id % 4 = 1 then 'none' else product_type end"), (3, "'CLASS/TYPE'"),
    (4, "case doc_id % 3 when 0 then 'TABLE WINE' when 1 then 'BOURBON WHISKEY' else 'PALE ALE' end"), (7, "'6. BRAND NAME'"), (8, "case when doc_id % 5 <> 0 then brand_name else '' end"), (12, "'BRAND NAME:'"),
    (13, "'other ' || brand_name"), (16, "'Serial Number,'"), (17, "'A-' || doc_id"), (18, "'second line'"), (21, "'PHONE: 555 ' || doc_id"), (24, "'8a. NAME AND ADDRESS OF APPLICANT (Required)'"), (25, "applicant_name"),
]
LANDMARKS = [*W.LANDMARKS, W.Landmark("phoneRight", "PHONE", "right")]
_laid = "100.0 + 60 * k as x0, 30.0 * line as y0, 100.0 + 60 * k + 8 * len(text) as x1, 30.0 * line + 12 as y1"
FORM_WORDS = f"""fl_ as (select doc_id, unnest([{", ".join(f"{{'line': {n}, 'text': {t}}}" for n, t in FORM_LINES)}]) u from fx_forms), fp as (select doc_id, u.line as line, unnest(list_zip(string_split(u.text, ' '), range(len(string_split(u.text, ' '))))) z from fl_),
fw as (select doc_id, 1 as page, line * 100 + k as idx, text, {_laid} from (select doc_id, line, z[1] text, z[2] k from fp) where text <> '')"""


def form_words(s, d):
    rows = X.forms(s, d).select("doc_id", F.explode(F.array(*[F.struct(F.lit(n).alias("line"), F.expr(t).alias("text")) for n, t in FORM_LINES])).alias("u"))
    rows = rows.select("doc_id", "u.line", F.posexplode(F.split("u.text", " ")).alias("k", "text")).where("text <> ''")
    return rows.selectExpr("doc_id", "1 as page", "line * 100 + k as idx", "text", *[f"cast({x} as double) {n}" for x, n in (part.rsplit(" as ", 1) for part in _laid.split(", "))])


_markers = ", ".join(f"({i}, '{m.field}', [{', '.join(D.quote(t) for t in m.marker.lower().split())}], {str(m.direction == 'right').lower()}, {m.distance})" for i, m in enumerate(LANDMARKS))
LANDED = f"""{FORM_WORDS}, lm(n, field, toks, is_right, dist) as (values {_markers}), ps as (select *, regexp_replace(lower(text), '[:.,]+$', '') plain, row_number() over (partition by doc_id, page order by y0, x0, idx) pos from fw),
pl as (select doc_id, page, list(plain order by pos) plains from ps group by all),
rn as (select a.doc_id, a.page, n, field, is_right, dist, a.pos, a.x0 mx0, a.y0 my0, b.x1 ex1, b.y0 ey0, b.y1 ey1 from ps a join pl using (doc_id, page) cross join lm join ps b on b.doc_id = a.doc_id and b.page = a.page and b.pos = a.pos + len(toks) - 1 where len(list_filter(list_zip(plains[a.pos : a.pos + len(toks) - 1], toks), lambda z: contains(z[1], z[2]))) = len(toks)),
nr as (select rn.*, w.text, w.y0, w.x0, w.idx, min(w.y0) over (partition by rn.doc_id, rn.page, n, rn.pos) top from rn join fw w using (doc_id, page) where case when is_right then abs(w.y0 - my0) < 18 and w.x0 > ex1 and w.x0 - ex1 < dist else w.y0 > ey1 and w.y0 - ey1 < greatest((ey1 - ey0) * 2, 50) and w.x0 < ex1 + dist and w.x0 > mx0 - 80 end),
vl as (select doc_id, page, n, field, pos, string_agg(text, ' ' order by y0, x0, idx) as value from nr where is_right or y0 - top < 18 group by all), bs as (select doc_id, page, n, field, arg_min(value, pos) as value from vl group by all)"""
_hits = {k: f"regexp_matches(upper(value), {D.quote(p)})" for k, p in E.STRICT.items()}
_one = f"case when {' + '.join(f'({v})::int' for v in _hits.values())} = 1 then case {' '.join(f'when {v} then {D.quote(k)}' for k, v in _hits.items())} end end"
add(
    "G13_landmark_below",
    lambda s, d: W.landmark_values(form_words(s, d), LANDMARKS).where("field <> 'productType'").select("doc_id", "page", "field", "value"),
    f"with {FX}, {LANDED} select doc_id, page, field, value from bs where field <> 'productType'",
)
add(
    "G13_product_type",
    lambda s, d: W.landmark_fields(form_words(s, d), E.strict_family).where("field = 'productType'").select("doc_id", c("value").alias("product_type")),
    f"with {FX}, {LANDED}, t as (select doc_id, n, {_one} as family from bs where field = 'productType') select doc_id, arg_min(family, n) as product_type from t where family is not null group by 1",
)
add("K6_reading_order", lambda s, d: words(s, d).select("doc_id", "idx", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "idx")).alias("place")), f"with {WORDS} select doc_id, idx, row_number() over (partition by doc_id, page order by y0, x0, idx) as place from fx_words")

# --- items ---
ITEMS = "fx_items as (select doc_id, 1 as page, z[2] as item_idx, z[1] as text, 10.0 + z[2] as x, 700.0 - 12 * z[2] as y, 6.0 * len(z[1]) as width, case when z[2] % 4 = 0 then null else 11.0 end as height, 3.0 as m2, 4.0 as m3 from (select doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) z from documents))"


def items(s, d):
    rows = X.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("item_idx", "text"))
    return rows.select("doc_id", F.lit(1).alias("page"), "item_idx", "text", (10.0 + c("item_idx")).alias("x"), (700.0 - 12 * c("item_idx")).alias("y"), (6.0 * F.length("text")).alias("width"), F.when(c("item_idx") % 4 != 0, 11.0).alias("height"), F.lit(3.0).alias("m2"), F.lit(4.0).alias("m3"))


def clean_items(s, d):
    return P.clean_items(items(s, d))


add("G1_clean_text_items", lambda s, d: clean_items(s, d).select("doc_id", "item_idx", "text", "height"), f"with {ITEMS} select doc_id, item_idx, trim(text) as text, coalesce(height, sqrt(m2 * m2 + m3 * m3)) as height from fx_items where trim(text) <> ''")
add(
    "G5_words_from_items",
    lambda s, d: W.words_of_items(clean_items(s, d)).groupBy("doc_id", "item_idx").agg(F.count("*").alias("n"), F.round(F.sum("x0"), 3).alias("x0"), F.round(F.sum("x1"), 3).alias("x1"), F.max("y1").alias("y1")),
    f"""with {ITEMS}, i as (select doc_id, item_idx, trim(text) text, x, y, width from fx_items where trim(text) <> ''), w as (select i.*, unnest(list_zip(string_split(text, ' '), range(len(string_split(text, ' '))))) z from i),
p as (select *, z[1] t, sum(len(z[1]) + 1) over (partition by doc_id, item_idx order by z[2]) - len(z[1]) - 1 st from w)
select doc_id, item_idx, count(*) as n, round(sum(round((x + width * st / len(text)) * 200 / 72, 6)), 3) as x0, round(sum(round((x + width * (st + len(t)) / len(text)) * 200 / 72, 6)), 3) as x1, max(round((792 - y) * 200 / 72, 6)) as y1 from p where t <> '' group by all""",
)

# --- images and pages: lineitem rows as the images of a page ---
IMAGES = "im as (select l_orderkey doc_id, l_linenumber page, l_quantity * 16 width, l_extendedprice / 100 height, cast(30 * l_linenumber - 40 as double) x, cast(5 as double) y, cast(600 as double) page_width, cast(800 as double) page_height from lineitem)"
#: Lines of documents that give way to these, dealt over four pages; neighbours on a page are four apart, so that one marker stands in two items.
PRINTED = [
    "PART I - APPLICATION", "5. BRAND", "4. TYPE OF PRODUCT (Required)", "2. PLANT REGISTRY/BASIC PERMIT", "3. SERIAL NUMBER", " NAME ", "14. TYPE OF APPLICATION", "8. NAME AND ADDRESS OF APPLICANT", "6. FANCIFUL NAME",
    "AFFIX COMPLETE SET OF LABELS BELOW", "Image Type: Back", "Brand (front) or keg collar", "Brand name", "Image Type:", "or keg collar", "   ", "Brand (front)", "SERIAL", "NUMBER", "serial number", "x", "y",
]
PAGE_TEXTS = f"""pgi as (select doc_id, z[2] % 4 + 1 as page, z[2] as i, trim(coalesce({D.lists(PRINTED)}[(doc_id * 7 + z[2]) % 41 + 1], z[1])) t from (select doc_id, unnest(list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))) z from documents)),
pt as (select doc_id, page, string_agg(t, ' ' order by i) t, count(*) n_items from pgi where t <> '' group by all)"""
_hits = lambda markers: " + ".join(f"contains(t, {D.quote(m)})::int" for m in markers)
STATS = f"""{IMAGES}, {PAGE_TEXTS}, pi as (select doc_id, page, bool_or(width * height >= {W.AREA} or (least(width, height) >= {W.SHORT_SIDE} and greatest(width, height) >= {W.LONG_SIDE})) has_image, max(width * height) largest, count(*) n_images from im group by all),
st as (select doc_id, page, coalesce({_hits(K.FORM_MARKERS)}, 0) marker_hits, coalesce(({_hits(K.LABEL_MARKERS)}) > 0, false) has_marker, coalesce({_hits(K.FRONT_MARKERS)}, 0) front_hits, coalesce({_hits(K.BACK_MARKERS)}, 0) back_hits, coalesce(n_items, 0) n_items, coalesce(n_images, 0) n_images, coalesce(has_image, false) has_image, coalesce(largest, 0) largest from pt full join pi using (doc_id, page))"""


def images(s, d):
    return X.view(s, d, f"with {IMAGES} select * from im")


def page_items(s, d):
    rows = X.table(s, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("item_idx", "line"))
    printed = F.try_element_at(F.array(*map(F.lit, PRINTED)), ((c("doc_id") * 7 + c("item_idx")) % 41 + 1).cast("int"))
    return rows.select("doc_id", (c("item_idx") % 4 + 1).alias("page"), "item_idx", F.coalesce(printed, "line").alias("text"), *[F.lit(1.0).alias(v) for v in ("height", "m2", "m3")])


def stats(s, d):
    return P.page_stats(P.clean_items(page_items(s, d)), images(s, d))


PICKED = f"""{STATS}, r as (select *, row_number() over (partition by doc_id order by marker_hits desc, page) = 1 is_form from st), r2 as (select *, max((not is_form and has_image)::int) over (partition by doc_id) = 1 any_image from r),
r3 as (select *, not is_form and case when any_image then has_image else has_marker end is_label from r2), r4 as (select *, max(is_label::int) over (partition by doc_id) = 1 any_label from r3),
picked as (select doc_id, page, case when is_label then 'label' when any_label then 'form' else 'form+label' end kind from r4 where is_form or is_label qualify row_number() over (partition by doc_id order by page) <= {W.MOST_PAGES})"""
add(
    "G2_page_stats", lambda s, d: stats(s, d).withColumn("largest", F.round("largest", 6)),
    f"with {STATS} select doc_id, page, marker_hits, has_marker, front_hits, back_hits, n_items, n_images, has_image, round(largest, 6) as largest from st",
)
add(
    "G3_substantial_images",
    lambda s, d: W.label_rects(images(s, d)).select("doc_id", "page", "rx0", "ry0", "rx1", "ry1"),
    f"with {IMAGES}, k as (select doc_id, page, greatest(0, least(page_width, x - 4)) rx0, greatest(0, least(page_height, y - 4)) ry0, greatest(0, least(page_width, x + width + 4)) rx1, greatest(0, least(page_height, y + height + 4)) ry1 from im where width * height >= {W.AREA} or (least(width, height) >= {W.SHORT_SIDE} and greatest(width, height) >= {W.LONG_SIDE})) select * from k where rx1 - rx0 > 1 and ry1 - ry0 > 1",
)
add("G4_pick_pages", lambda s, d: W.pick_pages(stats(s, d)), f"with {PICKED} select doc_id, page, kind from picked")
# Kinds as a renderer may give them, and boxes of fields: lineitem rows, of those that share a field the first.
KINDS = f"{PICKED}, kd as (select doc_id, page, case when kind = 'label' then case (doc_id + page) % 5 when 0 then 'label-back' when 1 then 'label-front' when 2 then 'unknown' else 'label' end else kind end kind from picked)"
BOXED = ["application.brandName", "application.serialNumber", "application.applicant.name", "label.brandName", "label.abv", "label.governmentWarning", "label.producer", "label.wineVarietal"]
BOX_ROWS = f"""bxr as (select l_orderkey doc_id, {{field}} field, l_linenumber page, case when l_suppkey % 3 = 0 then 'vlm' when l_suppkey % 3 = 1 then 'pdf' else 'tesseract' end source, l_quantity % 4 n_words,
case when l_suppkey % 3 = 0 then null else l_quantity + 50 end mean_confidence, row_number() over (partition by l_orderkey, l_partkey % {len(BOXED)} order by l_linenumber, l_partkey, l_suppkey, l_quantity) k from lineitem)"""
BOX_SQL = BOX_ROWS.format(field=f"{D.lists(BOXED)}[l_partkey % {len(BOXED)} + 1]")
WANTED = f"wt as (select doc_id, unnest({D.lists(BOXED)}) field from (select distinct l_orderkey doc_id from lineitem))"


def kinds(s, d):
    named = F.when((c("doc_id") + c("page")) % 5 == 0, "label-back").when((c("doc_id") + c("page")) % 5 == 1, "label-front").when((c("doc_id") + c("page")) % 5 == 2, "unknown").otherwise("label")
    return W.pick_pages(stats(s, d)).withColumn("kind", F.when(c("kind") == "label", named).otherwise(c("kind")))


def boxes(s, d):
    # Lines are dealt out by order, as narrow as they are; texts are made of those that stay.
    lines = X.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey")
    place = F.row_number().over(Window.partitionBy("l_orderkey", c("l_partkey") % len(BOXED)).orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    rows = lines.withColumn("k", place).where("k = 1")
    n_words = (c("l_quantity") % 4).cast("int")
    return rows.select(
        c("l_orderkey").alias("doc_id"), F.try_element_at(F.array(*map(F.lit, BOXED)), (c("l_partkey") % len(BOXED) + 1).cast("int")).alias("field"), c("l_linenumber").alias("page"),
        F.when(c("l_suppkey") % 3 == 0, "vlm").when(c("l_suppkey") % 3 == 1, "pdf").otherwise("tesseract").alias("source"), F.when(c("l_suppkey") % 3 == 0, None).otherwise(c("l_quantity") + 50).alias("mean_confidence"),
        F.slice(F.array(*[F.lit(f"w{i}") for i in range(1, 4)]), F.lit(1), n_words).alias("words"),
    )


def wanted(s, d):
    return X.table(s, d, "lineitem").select(c("l_orderkey").alias("doc_id")).distinct().select("doc_id", F.explode(F.array(*map(F.lit, BOXED))).alias("field"))


def provenance(s, d):
    """Entries of an older kind of run, for the first line of some orders."""
    field = F.try_element_at(F.array(*map(F.lit, BOXED)), (c("l_suppkey") % len(BOXED) + 1).cast("int"))
    rows = X.table(s, d, "lineitem").where("l_linenumber = 1")
    return rows.select(c("l_orderkey").alias("doc_id"), field.alias("field"), F.when(c("l_orderkey") % 4 == 0, "low").when(c("l_orderkey") % 4 != 3, "high").alias("confidence")).distinct()


_kind_rank = "case when contains(kind, 'form') then 3 when contains(kind, 'back') then 2 when contains(kind, 'front') or contains(kind, 'label') then 1 end"
_field_rank = "case when field like 'application.%' then 3 when field = 'label.governmentWarning' then 2 else 1 end"
_tab = lambda rank: f"case {rank} when 3 then 'form' when 2 then 'back' when 1 then 'front' end"
TABS = f"""{KINDS}, {BOX_SQL}, bx1 as (select * from bxr where k = 1), locked as (select doc_id, page from kd where contains(kind, 'form') or contains(kind, 'front') or contains(kind, 'back')),
cand as (select doc_id, page, {_kind_rank} as rank from kd where {_kind_rank} is not null union all select doc_id, page, {_field_rank} from bx1 anti join locked using (doc_id, page) where source <> 'vlm' and n_words > 0),
tabs as (select doc_id, page, {_tab('max(rank)')} tab from cand group by all)"""
add("G21_page_kind_derive", lambda s, d: P.page_kinds(kinds(s, d), boxes(s, d)), f"with {TABS} select doc_id, page, tab from tabs")
add("G22_available_tabs", lambda s, d: P.available_tabs(P.page_kinds(kinds(s, d), boxes(s, d))), f"with {TABS} select doc_id, tab, min(page) as page from tabs group by all")
add(
    "G23_field_route",
    lambda s, d: P.select_fields(wanted(s, d), boxes(s, d), P.page_kinds(kinds(s, d), boxes(s, d))).withColumns({"words": F.array_join("words", " "), "page": c("page").cast("string")}),
    f"""with {TABS}, {WANTED}, have as (select doc_id, min(page) filter (tab = 'form') form_page, min(page) filter (tab = 'front') front_page, min(page) filter (tab = 'back') back_page from tabs group by 1),
j as (select w.doc_id, w.field, b.page box_page, b.source, b.n_words, t.tab box_tab, h.*, coalesce(b.source <> 'vlm' and b.n_words > 0, false) shown from wt w left join bx1 b using (doc_id, field) left join tabs t on t.doc_id = w.doc_id and t.page = b.page left join have h on h.doc_id = w.doc_id),
p as (select *, case when shown then coalesce(box_tab, {_tab(_field_rank)}) when field like 'application.%' then 'form' when field = 'label.brandName' then 'front' when front_page is null and back_page is not null then 'back' else 'front' end tab from j)
select doc_id, field, tab, case when shown then box_page else case tab when 'form' then form_page when 'back' then back_page else front_page end end::varchar as page, case when shown then array_to_string(list_transform(range(1, n_words::int + 1), lambda i: 'w' || i), ' ') end as words, coalesce(source = 'vlm', false) as is_fallback from p""",
)
add(
    "G24_vlm_routing_page", lambda s, d: P.vlm_pages(W.pick_pages(stats(s, d)), boxes(s, d).where(P.drawn() & (c("source") == "tesseract"))),
    f"with {TABS}, ocr as (select distinct doc_id, page from bx1 where source = 'tesseract' and n_words > 0) select p.doc_id, coalesce(min(p.page) filter (contains(kind, 'label') and o.page is not null), min(p.page) filter (contains(kind, 'label')), min(p.page), 1) as page from picked p left join ocr o on o.doc_id = p.doc_id and o.page = p.page group by 1",
)
add("P11_ocr_page_selection", lambda s, d: P.pages_to_read(W.pick_pages(stats(s, d)), X.table(s, d, "orders").where("o_orderkey % 3 = 0").select(c("o_orderkey").alias("doc_id"))), f"with {PICKED} select doc_id, page from picked where doc_id not in (select o_orderkey from orders where o_orderkey % 3 = 0) or contains(kind, 'label')")
SOURCES = f"""{BOX_SQL}, {WANTED}, bx1 as (select * from bxr where k = 1), pv as (select distinct l_orderkey doc_id, {D.lists(BOXED)}[l_suppkey % {len(BOXED)} + 1] field, case l_orderkey % 4 when 0 then 'low' when 3 then null else 'high' end confidence from lineitem where l_linenumber = 1),
fs as (select w.doc_id, w.field, case when b.source in ('pdf', 'tesseract') and n_words > 0 then b.source when b.source = 'vlm' then 'vlm' when confidence is not null then 'tesseract' else 'none' end source, coalesce(confidence = 'low', false) or coalesce(mean_confidence < {P.LOW_CONFIDENCE}, false) low from wt w left join bx1 b using (doc_id, field) left join pv using (doc_id, field))"""
_sources = lambda s, d: P.field_sources(wanted(s, d), boxes(s, d), provenance(s, d))
add("P7_field_source_class", lambda s, d: _sources(s, d).drop("low"), f"with {SOURCES} select doc_id, field, source from fs")
add("P9_field_low_confidence", lambda s, d: _sources(s, d).drop("source"), f"with {SOURCES} select doc_id, field, low from fs")
CHOICES = "ch as (select l_orderkey doc_id, 'c' || l_linenumber || '-' || l_partkey || '-' || l_suppkey choice, max(l_extendedprice) score from lineitem group by all)"
add("G15_checked_choice", lambda s, d: W.checked_choice(X.view(s, d, f"with {CHOICES.replace('group by all', 'group by 1, 2')} select * from ch")), f"with {CHOICES}, r as (select *, row_number() over w p, lead(score) over w n from ch window w as (partition by doc_id order by score desc, choice)) select doc_id, choice, score from r where p = 1 and n is not null and score >= {W.LEAST_INK} and score >= {W.MARGIN} * n")
ADDRESS = """ad as (select s_suppkey doc_id, u.line, u.text from supplier join nation on n_nationkey = s_nationkey, lateral (values (0, case when s_suppkey % 3 = 0 then 'Basic permit no. 12' else s_name || ' Holding' end), (1, case when s_suppkey % 2 = 0 then s_name || ' ( used on label )' else 'Tradename line' end), (2, (s_suppkey + 10) || ' Main  Street'), (3, n_name || ' ky ' || case when s_suppkey % 5 = 0 then '' else (10000 + s_suppkey) || '' end)) u(line, text))"""


def address(s, d):
    rows = X.table(s, d, "supplier").join(F.broadcast(X.table(s, d, "nation")), c("n_nationkey") == c("s_nationkey"))
    k = c("s_suppkey")
    texts = [F.when(k % 3 == 0, "Basic permit no. 12").otherwise(F.concat("s_name", F.lit(" Holding"))), F.when(k % 2 == 0, F.concat("s_name", F.lit(" ( used on label )"))).otherwise("Tradename line"), F.concat((k + 10).cast("string"), F.lit(" Main  Street")), F.concat("n_name", F.lit(" ky "), F.when(k % 5 == 0, "").otherwise((k + 10000).cast("string")))]
    return rows.select(k.alias("doc_id"), F.posexplode(F.array(*texts)).alias("line", "text"))


_clean = lambda v: f"trim(regexp_replace(regexp_replace({v}, '\\s+', ' ', 'g'), ' ,', ',', 'g'))"
_csz = "(?i)^(.+?)\\s+([A-Z]{2})\\s+(\\d{5}(?:-\\d{4})?)$"
add("G17_city_state_zip", lambda s, d: address(s, d).select("doc_id", "line", *[v.alias(k) for k, v in W.city_state_zip(c("text")).items()]), f"with {ADDRESS} select doc_id, line, nullif(regexp_extract({_clean('text')}, '{_csz}', 1), '') as city, upper(nullif(regexp_extract({_clean('text')}, '{_csz}', 2), '')) as state, nullif(regexp_extract({_clean('text')}, '{_csz}', 3), '') as postal_code from ad")
add(
    "G16_applicant_block",
    lambda s, d: W.applicant(address(s, d)),
    f"with {ADDRESS}, k as (select doc_id, line, {_clean('text')} text from ad), f as (select *, regexp_matches(text, '(?i)\\bused\\s+on\\s+label\\b') used from k where text <> '' and not regexp_matches(text, {D.quote(W.BOILERPLATE)})) select doc_id, nullif({_clean('regexp_replace(coalesce(arg_min(text, line) filter (used), arg_min(text, line)), ' + D.quote('(?i)[(]?\\s*used\\s+on\\s+label\\s*[)]?') + ', ' + D.quote('') + ')')}, '') as name, arg_min(text, line) filter (regexp_matches(text, '^\\d+\\b') and not used) as address, arg_min(text, line) filter (regexp_matches(text, '{_csz}')) as city_line from f group by 1",
)
add(
    "G18_form_value_clean",
    lambda s, d: X.forms(s, d).select("doc_id", W.clean_value(F.concat(F.lit("“"), c("brand_name"), F.lit("”  , x"))).alias("v"), W.is_header(F.concat((c("doc_id") % 20).cast("string"), F.when(c("doc_id") % 2 == 0, "a. Phone").otherwise(" brand"))).alias("header"), W.null_if_absent(c("grape_varietals")).alias("grapes")),
    f"with {FX} select doc_id, '\"' || brand_name || '\", x' as v, doc_id % 2 = 0 as header, case when grape_varietals <> 'N/A' then grape_varietals end as grapes from fx_forms",
)


_box_fields = "['application.brandName', 'application.serialNumber', 'application.applicant', 'label.abv', 'application.phone']"
BOXES = f"{IMAGES}, bx as (select doc_id, {{f}} field, min(page) page, floor(min(x)) / 1000 x, floor(min(y)) / 1000 y, floor(max(width)) / 10000 w, floor(max(height)) / 10000 h, case when doc_id % 3 = 0 then 'low' else 'medium' end confidence from im group by 1, 2)"


def snapped(s, d):
    boxes = X.view(s, d, f"with {BOXES.format(f=f'element_at(array({_box_fields[1:-1]}), cast(page % 5 + 1 as int))')} select * from bx")
    # The applicant's block is the union of two widgets here.
    widgets = [(f"application.{n}", *map(float, r), 612.0, 792.0) for n, r in W.FORM_BOXES.items()] + [("application.applicant", 200.0, 500.0, 400.0, 540.0, 612.0, 792.0)]
    found = W.snap_provenance(boxes, s.createDataFrame(widgets, "field string, rx0 double, ry0 double, rx1 double, ry1 double, page_width double, page_height double"))
    return found.select("doc_id", "field", "page", *[F.round(v, 6).alias(v) for v in "xywh"], "confidence")


def _widget_sql(field: str, x0, y0, x1, y1) -> str:
    return f"('application.{field}', {x0} / 612.0, 1 - {y1} / 792.0, ({x1} - {x0}) / 612.0, ({y1} - {y0}) / 792.0)"


_rects = W.FORM_BOXES | {"applicant": (200, 500, 590, 596)}
add(
    "G20_provenance_snap", snapped,
    f"with {BOXES.format(f=_box_fields + '[page % 5 + 1]')}, wd_(field, wx, wy, ww, wh) as (values {', '.join(_widget_sql(n, *r) for n, r in _rects.items())}) select doc_id, field, page, round(coalesce(wx, x), 6) as x, round(coalesce(wy, y), 6) as y, round(coalesce(ww, w), 6) as w, round(coalesce(wh, h), 6) as h, case when wx is not null then 'high' else confidence end as confidence from bx left join wd_ using (field)",
)

# --- extraction: two pages of text for each label ---
# Countries of several words, with and without something that ends them; the fallback pattern's case has nothing in reach that does.
_country = "case doc_id % 7 when 3 then 'PRODUCT OF NEW ZEALAND' when 4 then 'Product of U.S.A.' when 5 then null else country_of_origin end"
_first = "case when doc_id % 7 = 5 then 'product of South Africa estate grown on hillside slopes near the old river 1890' end"
PAGES = f"{FX}, pg as (select doc_id, u.page, u.text from fx_labels, lateral (values (1, concat_ws(' ', brand_name, class_type, net_contents, {_first})), (2, concat_ws(' ', producer, abv || case when doc_id % 2 = 0 then ' by vol' else '' end, {_country} || '. CONTAINS SULFITES'))) u(page, text))"


def pages(s, d):
    two = F.concat_ws(" ", "producer", F.concat("abv", F.when(c("doc_id") % 2 == 0, " by vol").otherwise("")), F.concat(F.expr(_country), F.lit(". CONTAINS SULFITES")))
    return X.labels(s, d).select("doc_id", F.posexplode(F.array(F.concat_ws(" ", "brand_name", "class_type", "net_contents", F.expr(_first)), two)).alias("p", "text")).select("doc_id", (c("p") + 1).alias("page"), "text")




def captured(pattern: str) -> str:
    """A pattern without look-ahead: what it looked at is taken too, and group 1 is the match."""
    flag, body = ("(?i)", pattern[4:]) if pattern.startswith("(?i)") else ("", pattern)
    match, ahead, rest = body.partition("(?=")
    plain = match.replace("of\\s+(", "of\\s+(?:")
    return f"{flag}({plain})(?:{rest}" if ahead else f"{flag}({plain})"


_found = " union all ".join(f"select doc_id, page, '{f}' field, {i} priority, regexp_extract(text, {D.quote(captured(p))}, 1) as v from pg" for f, own in E.PATTERNS.items() for i, p in enumerate(own))
HITS = f"{PAGES}, hits as ({_found}), best as (select doc_id, field, arg_min({{'page': page, 'value': v}}, {{'a': priority, 'b': page}}) b from hits where v <> '' group by all)"
add("X1_pattern_priority_extract", lambda s, d: E.first_patterns(pages(s, d)), f"with {HITS} select doc_id, field, b.page as page, b.value as value from best")
SPANS = "sp as (select doc_id, page, z[2] as idx, z[1] as text, sum(len(z[1]) + 1) over (partition by doc_id, page order by z[2]) - len(z[1]) - 1 as start from (select doc_id, page, unnest(list_zip(string_split(text, ' '), range(len(string_split(text, ' '))))) z from pg))"


def page_spans(s, d):
    rows = pages(s, d).select("doc_id", "page", F.posexplode(F.split("text", " ")).alias("idx", "text"))
    by = Window.partitionBy("doc_id", "page").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.length("text") + 1).over(by) - 1
    return rows.withColumn("stop", stop).withColumn("start", c("stop") - F.length("text"))


def match_words(s, d):
    found = E.first_patterns(pages(s, d)).join(pages(s, d), ["doc_id", "page"])
    spans = found.select("doc_id", "page", "field", (F.instr("text", c("value")) - 1).alias("from_"), (F.instr("text", c("value")) - 1 + F.length("value")).alias("to_"))
    return E.words_of_match(page_spans(s, d), spans).select("doc_id", "page", "field", "idx", "text")


add("X2_match_to_words", match_words, f"with {HITS}, {SPANS} select sp.doc_id, sp.page, best.field, sp.idx, sp.text from best join pg on pg.doc_id = best.doc_id and pg.page = b.page join sp on sp.doc_id = pg.doc_id and sp.page = pg.page where start < instr(pg.text, b.value) - 1 + len(b.value) and start + len(sp.text) > instr(pg.text, b.value) - 1")
# Every run of words of every page, scored as it stands.
_covered = f"len(list_filter(brand, lambda b: len(list_filter(run, lambda t: {D.similar('t', 'b')})) > 0 or (n > 1 and contains(array_to_string(run, ''), b))))"
add(
    "X3_brand_ngram_match",
    lambda s, d: E.brand_match(X.forms(s, d).select("doc_id", c("brand_name").alias("brand")).join(pages(s, d).select("doc_id", "page", F.split("text", " ").alias("words")), "doc_id")),
    f"""with {PAGES},
brands as (
  select doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(brand_name), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), lambda t: len(t) >= 2) as brand
  from fx_forms),
plain as (
  select doc_id, page, brand, len(brand) as n, least(greatest(len(brand) + 1, 3), 6) as most, string_split(text, ' ') as words,
    list_transform(string_split(text, ' '), lambda w: regexp_replace(lower(w), '[^a-z0-9]', '', 'g')) as plain
  from pg join brands using (doc_id) where len(brand) > 0),
starts as (select *, unnest(range(0, len(plain))) as start from plain),
sizes as (select *, unnest(range(1, most + 1)) as size from starts where len(plain[start + 1]) >= 2),
runs as (
  select *, list_filter(plain[start + 1:start + size], lambda t: len(t) >= 2) as run from sizes
  where start + size <= len(plain) and not regexp_matches(array_to_string(words[start + 1:start + size], ' '), {D.quote(E.NOT_BRAND)})),
scored as (
  select doc_id, page, start, size, round({_covered}::double / n + case when len(run) = n then 0.05::double else 0 end
    - greatest(0, len(run) - n) * 0.08::double, 9) as score
  from runs)
select doc_id, page, start, size, score from scored where score >= {E.LEAST_BRAND}
qualify row_number() over (partition by doc_id order by score desc, page, start, size) = 1""",
)
_tok = "select distinct unnest(string_split(lower({v}), ' ')) {n} from {t}"
_sim = "(a = b or (least(len(a), len(b)) >= 4 and least(len(a), len(b)) / greatest(len(a), len(b)) >= 0.75 and (contains(a, b) or contains(b, a))) or (least(len(a), len(b)) >= 4 and a[:4] = b[:4]))"
add(
    "X4_token_similarity",
    lambda s, d: E.similar_links(X.table(s, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("a")), X.labels(s, d).select(F.explode(F.split(F.lower(F.coalesce("class_type", "producer", F.lit("x"))), " ")).alias("b"))),
    f"with {FX}, a as ({_tok.format(v='p_name', n='a', t='part')}), b as ({_tok.format(v='coalesce(class_type, producer, ' + D.quote('x') + ')', n='b', t='fx_labels')}) select a, b from a, b where a <> '' and b <> '' and {_sim}",
)
add("X7_clean_label_line", lambda s, d: X.labels(s, d).select("doc_id", E.clean_line(F.concat(F.lit('|. "'), c("producer"), F.lit('" ;-'))).alias("v")), f"with {FX} select doc_id, trim({D.replace(D.whitespace('producer'), r'^[|\\/.,;:-]+|[|\\/.,;:-]+$', '')}) as v from fx_labels")
_both = f"{D.anchors('warning_text', K.ANCHORS_1)} >= {K.ANCHOR_SHARE} and {D.anchors('warning_text', K.ANCHORS_2)} >= {K.ANCHOR_SHARE}"
_lowered = f"lower({D.whitespace('coalesce(warning_text, ' + D.quote('') + ')')})"
_has = f"contains({_lowered}, {D.quote(K.WARNING_PREFIX.lower())})"
add("X10_warning_region_text", lambda s, d: X.labels(s, d).select("doc_id", E.region_text(c("warning_text")).alias("v")), f"with {FX} select doc_id, case when {_both} and {_has} then warning_text when {_both} then {D.quote(K.WARNING)} end as v from fx_labels")
add(
    "X11_warning_score",
    lambda s, d: X.labels(s, d).select("doc_id", E.warning_score(c("warning_text")).alias("score")),
    f"with {FX} select doc_id, regexp_matches({_lowered}, '\\bgovernment\\s+warning\\b')::int + {_has}::int + 2 * ({D.anchors('warning_text', K.ANCHORS_1)} >= {K.ANCHOR_SHARE})::int + 2 * ({D.anchors('warning_text', K.ANCHORS_2)} >= {K.ANCHOR_SHARE})::int + ({_lowered} = {D.quote(K.WARNING.lower())})::int as score from fx_labels",
)


def boxed_labels(s, d):
    """Labels with a box for class and producer: a word for each word, of a vision model for some."""
    word = lambda t, i: F.struct(t.alias("text"), (40 + (F.length(t) * 7 + i) % 60).cast("double").alias("conf"))
    box = lambda v: F.when(c(v).isNotNull() & (c("doc_id") % 7 != 3), F.struct((c("doc_id") % 3 + 1).cast("int").alias("page"), F.when(c("doc_id") % 11 == 0, "vlm").otherwise("tesseract").alias("source"), F.transform(F.split(v, " "), word).alias("words"), F.lit(50.0).alias("mean_confidence")))
    rows = X.labels(s, d).withColumn("class_type", F.when(c("doc_id") % 3 == 0, F.concat(F.lit("Red Wine of Merlot, Napa Valley "), "class_type")).otherwise(c("class_type")))
    none = F.lit(None).cast(E.BOX)
    return rows.withColumns({"class_type_box": box("class_type"), "producer_box": box("producer"), **dict.fromkeys(["wine_varietal_box", "wine_appellation_box", "country_of_origin_box"], none)})


_said = lambda v: F.array_join(F.transform(c(v)["words"], lambda w: w["text"]), " ")


def hinted(s, d):
    rows = E.wine_hints(boxed_labels(s, d))
    return rows.select("doc_id", c("wine_varietal").alias("varietal"), c("wine_appellation").alias("appellation"), _said("wine_varietal_box").alias("varietal_words"), c("wine_varietal_box")["mean_confidence"].alias("varietal_confidence"), _said("wine_appellation_box").alias("appellation_words"))


_has_box = lambda v: f"({v} is not null and doc_id % 7 <> 3 and doc_id % 11 <> 0)"
_plain = lambda v: f"list_transform(string_split({v}, ' '), lambda w: {D.lexicon_text('w')})"
_key_of = lambda e, v: f"substr({D.lexicon_text(v)}, {e}.at::int, {e}.size::int)"
_cut = lambda best, v: f"array_to_string(string_split({v}, ' ')[1 - {best}.before : {best}.size - {best}.before], ' ')"
_conf = "list_aggregate(list_transform(range(1 - bv.before, bv.size - bv.before + 1), lambda i: 40 + (len(string_split(class_type, ' ')[i]) * 7 + i - 1) % 60), 'avg')"
add(
    "X12_wine_hints", hinted,
    f"""with {FX}, {KEYS}, l as (select * replace (case when doc_id % 3 = 0 then 'Red Wine of Merlot, Napa Valley ' || class_type else class_type end as class_type) from fx_labels),
h as (select l.*, {D.candidates('class_type', 'kv.ks')} v, {D.candidates('class_type', 'ka.ks')} a, {D.candidates('producer', 'ka.ks')} p from l, kv, ka),
k as (select *, case when coalesce(wine_varietal, '') = '' then {D.kept('v')} end gv, case when coalesce(wine_appellation, '') = '' then {D.kept('a')}[1] end ga, case when coalesce(wine_appellation, '') = '' then {D.kept('p')}[1] end gp from h),
r as (select *, case when {_has_box('class_type')} then {D.best_run(_plain('class_type'), f"list_transform(gv, lambda e: {_key_of('e', 'class_type')})")} end bv,
 case when ga is not null then case when {_has_box('class_type')} then {D.best_run(_plain('class_type'), f"[{_key_of('ga', 'class_type')}, {D.lexicon_text('ga.name')}]")} end end ba,
 case when ga is null and gp is not null and {_has_box('producer')} then {D.best_run(_plain('producer'), f"[{_key_of('gp', 'producer')}, {D.lexicon_text('gp.name')}]")} end bp from k)
select doc_id, coalesce(nullif(array_to_string(list_transform(gv, lambda e: e.name), ', '), ''), wine_varietal) as varietal, coalesce(ga.name, gp.name, wine_appellation) as appellation, case when bv is not null then {_cut('bv', 'class_type')} end as varietal_words,
 case when bv is not null then round({_conf}) end as varietal_confidence, case when ba is not null then {_cut('ba', 'class_type')} when bp is not null then {_cut('bp', 'producer')} end as appellation_words from r""",
)
add(
    "X13_extractor_domestic_hint", lambda s, d: E.origin_hint(boxed_labels(s, d)).select("doc_id", c("country_of_origin").alias("country"), _said("country_of_origin_box").alias("words")),
    f"with {FX}, h as (select *, country_of_origin is null and coalesce(regexp_matches(upper(producer), {D.quote(E.STATE_CODE)}) and not regexp_matches(producer, '(?i)^\\s*imported\\s+by\\b'), false) hint from fx_labels) select doc_id, case when hint then 'USA' else country_of_origin end as country, case when hint and doc_id % 7 <> 3 then producer end as words from h",
)
_targets = {"brandName": "brand_name", "governmentWarning": "warning_text", "countryOfOrigin": "country_of_origin", "wineVarietal": "wine_varietal", "wineAppellation": "wine_appellation"}
FIELDS = f"{FX}, fl as (select l.doc_id, f.product_type, u.field, u.value, l.doc_id % 13 <> 0 has_box, 50 + l.doc_id % 40 mean_conf, case when l.doc_id % 5 = 0 then 'vlm' else 'tesseract' end source from fx_labels l join fx_forms f using (doc_id), lateral (values {', '.join(f'({D.quote(k)}, l.{v})' for k, v in _targets.items())}) u(field, value))"


def fields(s, d):
    rows = X.labels(s, d).join(X.forms(s, d).select("doc_id", "product_type"), "doc_id")
    rows = rows.select("doc_id", "product_type", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), c(v).alias("value")) for k, v in _targets.items()])).alias("u"))
    return rows.select("doc_id", "product_type", "u.*", (c("doc_id") % 13 != 0).alias("has_box"), (50 + c("doc_id") % 40).alias("mean_conf"), F.when(c("doc_id") % 5 == 0, "vlm").otherwise("tesseract").alias("source"))


_canon = f"coalesce(lower({D.whitespace('value')}) = {D.quote(K.WARNING.lower())}, false)"
add("X14_fallback_targets", lambda s, d: E.fallback_targets(fields(s, d)), f"with {FIELDS} select distinct doc_id, field from fl where case when field like 'wine%' and product_type <> 'WINE' then false when field = 'governmentWarning' and not {_canon} then true when source = 'vlm' then false else coalesce(trim(value), '') = '' or not has_box or mean_conf < {E.UNSURE} end")


def answers(s, d):
    return fields(s, d).where("doc_id % 3 = 0").select("doc_id", "field", F.when(c("field") == "governmentWarning", K.WARNING).when(c("field") == "countryOfOrigin", F.when(c("doc_id") % 2 == 0, "American").otherwise("France")).when(c("field") == "brandName", c("value")).when(c("doc_id") % 4 == 0, "none").otherwise("Shiraz, Napa Valley").alias("value"))


_answer = f"""case field when 'governmentWarning' then {D.quote(K.WARNING)} when 'countryOfOrigin' then case when doc_id % 2 = 0 then 'American' else 'France' end when 'brandName' then value else case when doc_id % 4 = 0 then 'none' else 'Shiraz, Napa Valley' end end"""
_kept = """case field when 'wineVarietal' then case when answer <> 'none' then 'Syrah' end when 'wineAppellation' then case when answer <> 'none' then 'Napa Valley' end when 'countryOfOrigin' then case when answer <> 'American' then answer end else answer end"""
_score = f"regexp_matches(lw, '\\bgovernment\\s+warning\\b')::int + contains(lw, {D.quote(K.WARNING_PREFIX.lower())})::int + 2 * ({D.anchors('value', K.ANCHORS_1)} >= {K.ANCHOR_SHARE})::int + 2 * ({D.anchors('value', K.ANCHORS_2)} >= {K.ANCHOR_SHARE})::int + (lw = {D.quote(K.WARNING.lower())})::int"
add(
    "X15_fallback_merge", lambda s, d: E.merge_answers(fields(s, d), answers(s, d)),
    f"""with {FIELDS}, an as (select *, case when doc_id % 3 = 0 then {_answer} end answer, lower({D.whitespace('coalesce(value, ' + D.quote('') + ')')}) lw from fl), st as (select *, {_kept} stored from an),
tk as (select *, stored is not null and (field <> 'governmentWarning' or coalesce(trim(value), '') = '' or 7 > {_score}) taken from st)
select doc_id, field, case when taken then stored else value end as value, case when not taken or field = 'governmentWarning' or {D.comparison_text('value')} = {D.comparison_text('stored')} then source else 'vlm' end as source, taken from tk""",
)
_form_fields = {"application.brandName": "brand_name", "application.productType": "product_type", "application.source": "source", "application.applicant.name": "applicant_name", "application.grapeVarietals": "grape_varietals"}
FORM_FIELDS = f"""{FX}, ff as (select f.doc_id, f.product_type, u.i, u.field, u.value, case when (f.doc_id + u.i) % 6 = 0 then null when (f.doc_id + u.i) % 6 = 1 then 'vlm' else 'pdf' end source, 45.0 + (f.doc_id + u.i) % 30 conf
 from fx_forms f, lateral (values {', '.join(f'({i}, {D.quote(k)}, f.{v})' for i, (k, v) in enumerate(_form_fields.items()))}) u(i, field, value)),
wanted as (select doc_id, field, i from ff where (field <> 'application.grapeVarietals' or product_type = 'WINE') and source is distinct from 'vlm' and (coalesce(trim(value), '') = '' or source is null or conf < {E.UNSURE}))"""


def form_fields(s, d):
    rows = X.forms(s, d).select("doc_id", c("product_type").alias("kind_"), F.posexplode(F.array(*[F.struct(F.lit(k).alias("field"), c(v).alias("value")) for k, v in _form_fields.items()])).alias("i", "u"))
    turn = (c("doc_id") + c("i")) % 6
    box = F.struct(F.lit(1).alias("page"), F.when(turn == 1, "vlm").otherwise("pdf").alias("source"), F.array(F.struct(F.lit("w").alias("text"), F.lit(90.0).alias("conf"))).alias("words"), (45.0 + (c("doc_id") + c("i")) % 30).alias("mean_confidence"))
    return rows.select("doc_id", "i", "u.*", F.when(turn != 0, box).alias("box"), (c("kind_") == "WINE").alias("is_wine"))


def form_merged(s, d):
    rows = form_fields(s, d)
    asked = E.form_fallback_targets(rows).join(rows.select("doc_id", "field", "i"), ["doc_id", "field"])
    said = F.when(c("doc_id") % 4 == 0, None).when(c("i") == 1, "Fine Vodka").when(c("i") == 2, "imported goods").when(c("i") == 4, F.when(c("doc_id") % 5 == 0, "null").otherwise(" n/a")).otherwise("Answered")
    pages = X.table(s, d, "lineitem").where("l_orderkey % 3 = 0").select(c("l_orderkey").alias("doc_id"), c("l_linenumber").alias("page"))
    found = E.merge_form_answers(rows, asked.select("doc_id", "field", said.alias("value")), pages)
    return found.select("doc_id", "field", "value", F.coalesce(c("box")["source"], F.lit("none")).alias("source"), F.coalesce(c("box")["page"], F.lit(0)).alias("page"), F.coalesce(F.size(c("box")["words"]), F.lit(0)).alias("n_words"))


add("X16_form_fallback_targets", lambda s, d: E.form_fallback_targets(form_fields(s, d)), f"with {FORM_FIELDS} select doc_id, field from wanted")
add(
    "X16_form_fallback_merge", form_merged,
    f"""with {FORM_FIELDS}, pg as (select l_orderkey doc_id, min(l_linenumber) page from lineitem where l_orderkey % 3 = 0 group by 1), m as (select ff.*, w.doc_id is not null asked, pg.page p from ff left join wanted w using (doc_id, field) left join pg on pg.doc_id = ff.doc_id)
select doc_id, field, case when not asked or doc_id % 4 = 0 then value when i = 1 then 'DISTILLED SPIRITS' when i = 2 then 'Imported' when i = 4 then case when doc_id % 5 = 0 then null else 'N/A' end else 'Answered' end as value,
 case when asked then 'vlm' else coalesce(source, 'none') end as source, case when asked then coalesce(p, 1) when source is null then 0 else 1 end::int as page, case when asked or source is null then 0 else 1 end as n_words from m""",
)
add("X17_value_sanitizers", lambda s, d: X.forms(s, d).select("doc_id", E.form_wine_value(c("grape_varietals")).alias("grapes"), E.label_value(F.lit("countryOfOrigin"), c("grape_varietals")).alias("country"), E.label_value(F.lit("wineVarietal"), c("grape_varietals")).alias("varietal"), E.source_value(c("source")).alias("source")), f"with {FX}, {KEYS}, g as (select *, {D.candidates('grape_varietals', 'kv.ks')} v from fx_forms, kv) select doc_id, grape_varietals as grapes, case when grape_varietals <> 'N/A' and not regexp_matches(lower(grape_varietals), {D.quote(E.PRODUCT_WORDS)}) then grape_varietals end as country, case when grape_varietals <> 'N/A' and not {D.type_only('grape_varietals')} then nullif(array_to_string({D.accepted('v')}, ', '), '') end as varietal, case when source = 'Imported' then 'Imported' else 'Domestic' end as source from g")
_strict = {k: f"regexp_matches(upper(class_type), {D.quote(p)})" for k, p in E.STRICT.items()}
add("X18_family_from_text_strict", lambda s, d: X.labels(s, d).select("doc_id", E.strict_family(c("class_type")).alias("family")), f"with {FX} select doc_id, case when {' + '.join(f'({v})::int' for v in _strict.values())} = 1 then case {' '.join(f'when {v} then {D.quote(k)}' for k, v in _strict.items())} end end as family from fx_labels")
add("X19_all_caps_flag", lambda s, d: X.labels(s, d).select("doc_id", E.all_caps(c("brand_name")).alias("v")), f"with {FX} select doc_id, not regexp_matches(brand_name, '[a-z]') as v from fx_labels")
