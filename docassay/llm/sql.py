"""DuckDB SQL of the quality rules and of the ranked search."""

from __future__ import annotations

from . import divergence

_LOWERED = "translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: One pattern for each character class; what they leave of a text is the class of other ASCII characters.
_CLASSES = [r"[a-z]", r"[A-Z]", r"[0-9]", r"[\x09-\x0D\x20]", r"[.,;:!?''\"()\-]", None, r"[^\x00-\x7F]"]


def _held(pattern: str) -> str:
    return f"length(t) - length(regexp_replace(t, '{pattern}', '', 'g'))"


def _added(p: str, q: str) -> str:
    """What a cell with the shares p and q adds to a divergence."""
    one = lambda a, b: f"case when {a} > 0 then {a} / 2 * log2(2 * {a} / ({a} + {b})) else 0 end"
    return f"({one(p, q)} + {one(q, p)})"


def _distance(found: str, cells: str, n: str) -> str:
    return f"sqrt(greatest({found} - ({cells} - 1) / (8 * ln(2) * greatest({n}, 1)), 0))"


_COUNTS = ", ".join(f"{_held(p)} as c{k}" if p else "0 as c5" for k, p in enumerate(_CLASSES))
_PARTS = " union all ".join(f"select rid, {k} as k, {f'c{k}' if p else 'length(t) - c0 - c1 - c2 - c3 - c4 - c6'} as c from classes" for k, p in enumerate(_CLASSES))

QUALITY_RULES = rf"""
with d as (select row_number() over () as rid, doc_id, lang, coalesce(text, '') as t from documents),
w as (select rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, {_TERMS} as ts from d),
lines as (select rid, unnest(string_split(t, chr(10))) as line from d),
dup as (select rid, sum(n - 1) as n from (select rid, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]') group by rid, line) group by rid),
words as (select rid, unnest(ws) as w, unnest(range(len(ws))) as i from w),
threes as (select rid, i, w || ' ' || lead(w) over o || ' ' || lead(w, 2) over o as three from words window o as (partition by rid order by i)),
twice as (select rid, three from threes where three is not null group by rid, three having count(*) > 1),
repeated as (select rid, i from threes join twice using (rid, three)),
covered as (select rid, count(distinct i + j) as n from repeated, (values (0), (1), (2)) as o(j) group by rid),
base as (select d.rid, d.doc_id, len(ws) as n_words, coalesce(length(array_to_string(ws, '')), 0) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols,
  coalesce(dup.n, 0) as n_dup_lines, coalesce(covered.n, 0) as n_repeat_words from d join w using (rid) left join dup using (rid) left join covered using (rid)),
classes as (select rid, t, {_COUNTS} from d),
held as ({_PARTS}),
chars as (select rid, sum(c) as n from held group by rid),
tokens as (select rid, unnest(ts) as term from w),
own as (select rid, term, count(*) as c from tokens group by rid, term),
many as (select rid, len(ts) as n from w),
lang_words as (select lang, sum(n) as n from many join d using (rid) where lang is not null group by lang),
langs as (select lang, n from lang_words where n > 0 and n * {divergence.RARITY} >= (select sum(n) from lang_words)),
lang_classes as (select lang, k, sum(c) as c from held join d using (rid) join langs using (lang) group by lang, k),
lang_share as (select lang, k, c / sum(c) over (partition by lang) as q from lang_classes),
common as (select lang, term, sum(c) / any_value(langs.n) as q from own join d using (rid) join langs using (lang) group by lang, term having sum(c) * {divergence.RARITY} >= any_value(langs.n)),
common_all as (select lang, sum(q) as q, count(*) + 1 as cells from common group by lang),
met as (select rid, lang, sum({_added('p', 'q')} - q / 2) as s, sum(p) as p from (select rid, lang, c / n as p, q from own join many using (rid) join common using (term)) group by rid, lang),
by_word as (select rid, lang, {_distance(f"coalesce(s, 0) + q / 2 + {_added('rest_p', 'rest_q')}", 'cells', 'n')} as x, n from
  (select many.rid, many.n, a.lang, a.cells, a.q, met.s, greatest(1 - coalesce(met.p, 0), 0) as rest_p, greatest(1 - a.q, 0) as rest_q
   from many cross join common_all a left join met on met.rid = many.rid and met.lang = a.lang)),
by_class as (select rid, lang, {_distance('sum(s)', '7', 'any_value(n)')} as x, any_value(n) as n from
  (select h.rid, ls.lang, chars.n, {_added('(h.c / greatest(chars.n, 1))', 'ls.q')} as s from held h join chars using (rid) join lang_share ls on ls.k = h.k) group by rid, lang),
best as (select rid, min(greatest(case when c.n >= {divergence.LEAST_CHARS} then c.x / {divergence.MOST_CLASSES} else 0 end, case when b.n >= {divergence.LEAST_TERMS} then b.x / {divergence.MOST_WORDS} else 0 end)) as x
  from by_class c join by_word b using (rid, lang) group by rid),
failed as (select *, n_words < {divergence.LEAST_WORDS} or 100 * n_repeat_words > {divergence.REPEATED} * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(x, 0) <= 1 as kept from failed left join best using (rid)
"""

SEARCH = rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
tokens as (select rid, doc_id, {_TERMS} as ts from d),
full_docs as (select rid, doc_id, ts, len(ts)::bigint as n from tokens where len(ts) > 0),
size as (select count(*)::bigint as docs, sum(n)::bigint as words from full_docs),
own as (select rid, term, count(*)::bigint as tf from (select rid, unnest(ts) as term from full_docs) group by rid, term),
often as (select term, count(*)::bigint as df from own group by term),
items as (select item_id, unnest({_TERMS}) as term from (select distinct item_id, text as t from benchmark where text is not null)),
wanted as (select item_id, term, count(*)::bigint as times from items group by item_id, term),
part as (select rid, term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // words))) as s
  from own join often using (term) join full_docs using (rid) cross join size where term in (select term from wanted)),
scores as (select item_id, rid, sum(times * s)::bigint as score from part join wanted using (term) group by item_id, rid),
ranked as (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id, rid)::int as rank from scores join full_docs using (rid) where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 20
"""
