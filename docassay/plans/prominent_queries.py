"""Queries of unpatterned label fields, over words that each label's values are laid out as."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..operators import prominent as P
from ..operators import words as W
from . import duck as D
from . import fixtures as X
from .text_queries import FX
from .word_queries import WORDS
from .word_queries import words as document_words

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def add(name, make, sql=None):
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


# Brand, class, producer, then the warning at eight words a line; the smaller the print, the lower the line.
LAID = """rows_ as (select doc_id, u.part, u.text from fx_labels, lateral (values (0, brand_name), (1, class_type), (2, producer), (3, warning_text)) u(part, text) where u.text is not null),
toks as (select doc_id, part, unnest(list_zip(string_split(text, ' '), range(len(string_split(text, ' '))))) z from rows_),
cells as (select doc_id, part, z[1] text, z[2] k, case when part < 3 then part else 3 + z[2] // 8 end as line, case when part < 3 then z[2] else z[2] % 8 end as col from toks where z[1] <> ''),
lw as (select doc_id, 1 as page, line * 100 + col as idx, line, text, 50 + (len(text) * 11 + col * 5) % 50 as conf, 100.0 + 110 * col as x0, 40.0 * line as y0, 100.0 + 110 * col + 9 * len(text) as x1, 40.0 * line + case part when 0 then 30 when 1 then 20 else 12 end as y1 from cells)"""


def words(s, d):
    parts = F.array(*[F.col(v) for v in ("brand_name", "class_type", "producer", "warning_text")])
    rows = X.labels(s, d).select("doc_id", F.posexplode(parts).alias("part", "value")).where("value is not null")
    rows = rows.select("doc_id", "part", F.posexplode(F.split("value", " ")).alias("k", "text")).where("text <> ''")
    line = F.when(c("part") < 3, c("part")).otherwise(3 + F.floor(c("k") / 8).cast("int"))
    col = F.when(c("part") < 3, c("k")).otherwise(c("k") % 8)
    rows = rows.withColumns({"line": line, "col": col})
    x0, y0 = 110 * c("col") + 100.0, 40.0 * c("line")
    return rows.select(
        "doc_id", F.lit(1).alias("page"), (c("line").cast("long") * 100 + c("col")).alias("idx"), "line", "text", (50 + (F.length("text") * 11 + c("col") * 5) % 50).alias("conf"), x0.alias("x0"), y0.alias("y0"),
        (x0 + 9 * F.length("text")).alias("x1"), (y0 + F.when(c("part") == 0, 30).when(c("part") == 1, 20).otherwise(12)).alias("y1"),
    )


def pages(s, d):
    return X.labels(s, d).select("doc_id", F.lit(1).alias("page"), F.when(c("doc_id") % 2 == 0, "front").otherwise("label").alias("kind"))


def matches_any(v: str, patterns: list[str]) -> str:
    return "(" + " or ".join(f"regexp_matches({v}, {D.quote(p)})" for p in patterns) + ")"


def lines_sql(least_conf: int, most_words: int) -> str:
    """Lines of sure words, with their words and cleaned text, as SQL."""
    return f"""
ext as (
  select doc_id, page, greatest(max(x1)::double, 1) as page_x, greatest(max(y1)::double, 1) as page_y from lw group by all),
gathered as (
  select doc_id, page, line, string_agg(text, ' ' order by x0, idx) as raw,
    list({{'text': text, 'conf': conf::double, 'x0': x0::double, 'y0': y0::double, 'x1': x1::double, 'y1': y1::double}} order by x0, idx) as w
  from lw where conf >= {least_conf} and regexp_matches(text, '[A-Za-z0-9]')
  group by all having count(*) <= {most_words}),
lines as (select *, {D.clean_line("raw")} as line_text from gathered)"""


def measured_sql(source: str) -> str:
    """The measures of the words w of each row of ``source``, as SQL."""
    each = lambda n: f"list_transform(w, lambda x: x.{n})"
    return f"""
extents as (
  select s.*, page_x, page_y, round(list_avg({each("conf")})) as mean_conf,
    list_min({each("x0")}) as x0, list_max({each("x1")}) as x1, list_min({each("y0")}) as y0, list_max({each("y1")}) as y1
  from {source} s join ext using (doc_id, page)),
measured as (
  select *, y1 - y0 as height, x1 - x0 as width, (y0 + y1) / 2 as cy,
    1 - least(1.0::double, abs((x0 + x1) / 2 - page_x / 2) / (page_x / 2)) as centred, doc_id % 2 = 0 as front
  from extents)"""


FIRST = "qualify row_number() over (partition by doc_id order by score desc, front desc, page, line) = 1"

_values = ", ".join(["nullif(array_to_string(grapes, ', '), '')", *(f"nullif(regexp_extract(line_text, {D.quote(p)}), '')" for p in P.CLASS_PATTERNS)])
_starts = "list_filter(range(1, len(p) - len(t) + 2), lambda i: len(t) > 0 and p[i:i + len(t) - 1] = t)"
_near = f"list_filter({_starts}, lambda i: list_contains(p[greatest(1, i - 2):i + len(t) + 2], 'wine'))"
add(
    "X5_class_type_candidate",
    lambda s, d: P.class_type_candidate(words(s, d), pages(s, d), X.forms(s, d).select("doc_id", "product_type")),
    f"""with {FX}, {LAID}, {D.keys("lexicon", K.VARIETALS)}, {lines_sql(30, 12)},
named as (
  select doc_id, page, line, w, line_text, {D.accepted(D.candidates("line_text", "ks"))} as grapes from lines, lexicon
  where line_text <> '' and not {matches_any("line_text", [P.NOT_FIELD, P.MADE_BY, P.CHROME])}),
kept as (select *, {D.family("line_text", "grapes")} as family, [{_values}] as found from named),
tokens as (
  select *, list_transform(w, lambda x: {D.lexicon_text("x.text")}) as p,
    list_transform(found, lambda v: list_filter(string_split({D.lexicon_text("v")}, ' '), lambda u: u <> '')) as ts
  from kept where family is not null),
placed as (select *, list_transform(ts, lambda t: coalesce(({_near})[1], ({_starts})[1])) as places from tokens),
chosen as (select *, list_filter(range(1, len(ts) + 1), lambda k: places[k] is not null)[1] as k from placed),
runs as (
  select doc_id, page, line, family, case when k is null then w else w[places[k]:places[k] + len(ts[k]) - 1] end as w from chosen),
texts as (select *, array_to_string(list_transform(w, lambda x: x.text), ' ') as raw from runs),
cleaned as (select *, {D.clean_line("raw")} as text from texts), {measured_sql("cleaned")},
scored as (
  select m.*, round(case when family = product_type then 60 else 0 end + case when front then 10 else 0 end
    + case when cy <= page_y * 0.7::double then 8 else 0 end + centred * 10 + height, 6) as score
  from measured m join fx_forms using (doc_id) where text <> '' and mean_conf >= 45)
select doc_id, page, line, text, score, family from scored {FIRST}""",
)


def name_tokens_sql(v: str) -> str:
    plain = D.replace(f"lower(coalesce({v}, ''))", r"[^a-z0-9\s]", " ")
    return f"list_filter(list_distinct(regexp_split_to_array({plain}, '\\s+')), lambda t: len(t) >= 3)"


_shared = f"len(list_filter({name_tokens_sql('text')}, lambda a: len(list_filter({name_tokens_sql('applicant_name')}, lambda b: {D.similar('a', 'b')})) > 0)) > 0"
add(
    "X6_prominent_name",
    lambda s, d: P.prominent_name(words(s, d), pages(s, d), X.forms(s, d).select("doc_id", c("applicant_name").alias("brand"))),
    f"""with {FX}, {LAID}, {lines_sql(35, 5)},
named as (
  select doc_id, page, line, w, line_text as text from lines
  where regexp_matches(line_text, '[A-Za-z]{{3}}') and len(regexp_replace(line_text, '[^A-Za-z]', '', 'g')) >= 5
    and not {matches_any("line_text", P.NOT_NAME)}), {measured_sql("named")},
scored as (
  select m.*, round(height * 2 + width * 0.03::double + centred * 20 - case when regexp_matches(text, '[0-9]') then 30 else 0 end, 6) as score
  from measured m join fx_forms using (doc_id)
  where mean_conf >= 75 and cy <= page_y * 0.62::double and not ({_shared}))
select doc_id, page, line, text, score from scored {FIRST}""",
)


def block_sql(gap: int, most_lines: int = 18) -> str:
    """The walk over the lines below a warning's first words, one line a step, as SQL."""
    complete = f"""(regexp_matches(lower({D.whitespace("text")}), '\\bproblems\\b')
      or (contains(lower({D.whitespace("text")}), {D.quote(K.WARNING_PREFIX.lower())})
        and {D.anchors("text", K.ANCHORS_1)} >= {K.ANCHOR_SHARE} and {D.anchors("text", K.ANCHORS_2)} >= {K.ANCHOR_SHARE}))"""
    return f"""with recursive {FX}, {LAID},
ordered as (
  select *, row_number() over (partition by doc_id, page order by line, x0, idx) as place, lead(text) over l as next_text,
    coalesce((x0 - lag(x1) over l > {gap})::int, 0) as jump
  from lw window l as (partition by doc_id, page, line order by x0, idx)),
split as (
  select *, sum(jump) over (partition by doc_id, page, line order by x0, idx rows unbounded preceding) as cluster from ordered),
begins as (
  select doc_id, page, min(place) as first_place, arg_min(line, place) as first_line, arg_min(cluster, place) as first_cluster
  from split where lower(text) = 'government' and starts_with(lower(next_text), 'warning') group by all),
numbered as (
  select doc_id, page, line, row_number() over (partition by doc_id, page order by line) as k
  from (select distinct doc_id, page, line from split) join begins using (doc_id, page) where line >= first_line),
clusters as (
  select doc_id, page, k, cluster, min(x0) as a, max(x1) as b, count(*) as n, sum(conf) as conf, string_agg(text, ' ' order by x0, idx) as text
  from split join numbered using (doc_id, page, line) where k > 1 group by all),
walk as (
  select doc_id, page, 1::bigint as k, min(x0)::double as a, max(x1)::double as b, 0 as missed, count(*)::bigint as n, sum(conf)::double as conf,
    string_agg(text, ' ' order by x0, idx) as text, true as grown
  from split join begins using (doc_id, page)
  where line = first_line and cluster = first_cluster and place >= first_place group by doc_id, page
  union all
  select w.doc_id, w.page, w.k + 1, least(w.a, arg_min(c.a, c.cluster))::double, greatest(w.b, arg_min(c.b, c.cluster))::double,
    case when count(c.cluster) = 0 then w.missed + 1 else 0 end, (w.n + coalesce(arg_min(c.n, c.cluster), 0))::bigint,
    (w.conf + coalesce(arg_min(c.conf, c.cluster), 0))::double, concat_ws(' ', w.text, arg_min(c.text, c.cluster)), count(c.cluster) > 0
  from (select * from walk where k < {most_lines} and missed < 2 and not (grown and {complete})) w
  join numbered l on l.doc_id = w.doc_id and l.page = w.page and l.k = w.k + 1
  left join clusters c on c.doc_id = w.doc_id and c.page = w.page and c.k = w.k + 1 and c.a <= w.b + 80 and c.b >= w.a - 80
  group by w.doc_id, w.page, w.k, w.a, w.b, w.missed, w.n, w.conf, w.text)
select doc_id, page, text, n as words, floor(conf / n + 0.5)::int as mean_conf from walk
where n >= 10 qualify row_number() over (partition by doc_id, page order by k desc) = 1"""


add("X8_warning_block", lambda s, d: P.warning_block(W.split_at_gaps(words(s, d), 200)), block_sql(200))
# Lines that fall apart after every short word.
add("X8_warning_block_narrow", lambda s, d: P.warning_block(W.split_at_gaps(words(s, d), 80)), block_sql(80))
_token = "regexp_replace(lower(text), '[^a-z]', '', 'g')"
_hits = " or ".join(f"{_token} = '{a}'" + (f" or (len({_token}) >= 5 and (contains({_token}, '{a}') or contains('{a}', {_token})))" if len(a) >= 5 else "") for a in P.REGION_ANCHORS)
add(
    "X9_warning_region",
    lambda s, d: P.warning_region(words(s, d)),
    f"""with {FX}, {LAID}, m as (select *, len({_token}) >= 4 and ({_hits}) anchor from lw), r as (select doc_id, page, count(*) n, min(x0) ax0, min(y0) ay0, max(x1) ax1, max(y1) ay1 from m where anchor group by all having count(*) >= 3),
i as (select m.* from m join r using (doc_id, page) where (x0 + x1) / 2 between greatest(0, ax0 - {P.GROW_LEFT}) and ax1 + {P.GROW_LEFT} and (y0 + y1) / 2 between greatest(0, ay0 - {P.GROW_UP}) and ay1 + {P.GROW_DOWN} and not regexp_matches(text, {D.quote(P.FOOTER)}))
select doc_id, page, string_agg(text, ' ' order by y0, x0, idx) as text, count(*) as words, round(avg(conf))::int as mean_conf from i group by all having count(*) >= 8 and count(*) filter (anchor) >= 3""",
)


def below(s, d):
    own = document_words(s, d)
    by = Window.partitionBy("doc_id", "page").orderBy("y0", "x0", "idx")
    first = own.withColumn("place", F.row_number().over(by)).where("place = 1").select("doc_id", "page", ((c("y0") + c("y1")) / 2).alias("my"))
    return P.below_marker(own, first, 50.0, 400.0)


add(
    "G14_marker_below_pt",
    below,
    f"""with {WORDS}, f as (select doc_id, page, (y0 + y1) / 2 my from fx_words qualify row_number() over (partition by doc_id, page order by y0, x0, idx) = 1), n as (select w.*, (y0 + y1) / 2 cy from fx_words w join f using (doc_id, page) where (x0 + x1) / 2 between 50 and 400 and (y0 + y1) / 2 > my + 3 and (y0 + y1) / 2 - my <= 30),
t as (select *, min(cy) over (partition by doc_id, page) top from n), v as (select doc_id, page, trim(regexp_replace(regexp_replace(string_agg(text, ' ' order by x0, idx), '\\s+', ' ', 'g'), ' ,', ',', 'g')) as value from t where cy - top <= 3 group by all) select doc_id, page, value from v where value <> '' and not regexp_matches(value, {D.quote(W.HEADER)})""",
)
