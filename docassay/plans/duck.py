"""The comparators once more, as DuckDB expressions, for the oracle queries."""

from __future__ import annotations

from functools import reduce

from ..functions import constants as K
from ..functions import normalize as N

#: Fixed value: marks at the ends of a label line.
EDGES = r"^[|\\/.,;:-]+|[|\\/.,;:-]+$"


def quote(v: str) -> str:
    return "'" + v.replace("'", "''") + "'"


def lists(values: list[str]) -> str:
    return "[" + ", ".join(map(quote, values)) + "]"


def replace(v: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({v}, {quote(pattern)}, {quote(to)}, '{flags}')"


def whitespace(v: str) -> str:
    return f"trim({replace(v, N.SPACES, ' ')})"


def exact(v: str) -> str:
    return whitespace(replace(f"strip_accents(lower(coalesce({v}, '')))", K.CORPORATE_SUFFIX, ""))


def expand_states(v: str) -> str:
    return reduce(lambda out, s: replace(out, rf"\b{s[0]}\b", s[1]), K.STATES.items(), v)


def producer_tokens(v: str) -> str:
    plain = replace(expand_states(f"strip_accents(lower(coalesce({v}, '')))"), r"[^a-z0-9\s]", " ")
    drop = ["", *K.NOISE_TOKENS, *K.PROCESS_TOKENS, *K.CORPORATE_TOKENS]
    return f"list_filter(list_distinct(regexp_split_to_array({plain}, '\\s+')), lambda t: not list_contains({lists(drop)}, t))"


def subset(a: str, b: str) -> str:
    return f"list_has_all({b}, {a})"


def jaccard(a: str, b: str) -> str:
    return f"(case when len({a}) + len({b}) = 0 then 1.0 else len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) end)"


def implies_domestic(v: str, tokens: str) -> str:
    return f"coalesce({v} <> '' and not regexp_matches({v}, '(?i)^\\s*imported\\s+by\\b') and list_has_any({tokens}, {lists(K.STATE_CODES)}), false)"


def country(v: str) -> str:
    plain = f"trim({replace(replace(exact(v), r'^(?:product|produce|made)\s+of\s+', '', ''), r'^country\s+of\s+origin\s+', '', '')})"
    return f"(case when {plain} in ({', '.join(map(quote, K.USA_NAMES))}) then 'usa' else {plain} end)"


def no_declaration(v: str) -> str:
    return f"({exact(v)} in ({', '.join(map(quote, K.NO_DECLARATION))}))"


def lexicon_text(v: str) -> str:
    plain = replace(f"lower(strip_accents(coalesce({v}, '')))", "&", " and ")
    return f"trim({replace(replace(plain, '''['’]''', ''), '[^a-z0-9]+', ' ')})"


def type_only(v: str) -> str:
    return "(" + " or ".join(f"regexp_matches({lexicon_text(v)}, {quote(p)})" for p in K.WINE_STYLES) + ")"


def keys(name: str, entries: dict[str, list[str]]) -> str:
    """A one-row CTE that holds a lexicon as a list."""
    rows = ", ".join(f"({quote(k)}, {quote(c)}, {i})" for i, (k, c) in enumerate(N.lexicon_keys(entries)))
    return f"{name} as (select list({{'key': key, 'name': name, 'ord': ord}} order by ord) ks from (values {rows}) t(key, name, ord))"


def candidates(v: str, ks: str) -> str:
    return f"list_filter(list_transform({ks}, lambda e: {{'at': instr(' ' || {lexicon_text(v)} || ' ', ' ' || e.key || ' '), 'size': len(e.key), 'name': e.name, 'ord': e.ord}}), lambda e: e.at > 0)"


def kept(c: str) -> str:
    """The greedy choice: a fold over the candidates, in order, that takes each one that clashes with none taken before."""
    clash = "(e[1].at < h.at + h.size and e[1].at + e[1].size > h.at) or h.name = e[1].name"
    fold = f"list_reduce(list_transform({c}, lambda e: [e]), lambda taken, e: case when len(list_filter(taken, lambda h: {clash})) > 0 then taken else list_concat(taken, e) end)"
    return f"(case when len({c}) = 0 then {c} else {fold} end)"


def accepted(c: str) -> str:
    """Their names."""
    return f"list_transform({kept(c)}, lambda e: e.name)"


def best_run(words: str, values: str) -> str:
    """{score, before, size} of the best run of normalised words that reads like one of some values."""
    at = f"lambda i: {words}[i + 1 : i + len(string_split(v, ' '))] = string_split(v, ' ')"
    near = f"list_contains({words}[greatest(i - 2, 0) + 1 : i + len(string_split(v, ' ')) + 3], 'wine')"
    runs = f"list_transform(list_filter(range(0, len({words}) - len(string_split(v, ' ')) + 1), {at}), lambda i: {{'score': len(string_split(v, ' ')) + case when {near} then 10 else 0 end, 'before': -i, 'size': len(string_split(v, ' '))}})"
    return f"list_aggregate(flatten(list_transform(list_filter({values}, lambda v: v <> ''), lambda v: {runs})), 'max')"


def family(v: str, varietals: str) -> str:
    plain = exact(v)
    hits = [f"(regexp_matches({plain}, {quote(K.WINE_WORDS)}) or len({varietals}) > 0 or {type_only(v)})", f"regexp_matches({plain}, {quote(K.MALT_WORDS)})", f"regexp_matches({plain}, {quote(K.SPIRIT_WORDS)})"]
    count = " + ".join(f"({h})::int" for h in hits)
    return f"(case when {plain} <> '' and {count} = 1 then case " + " ".join(f"when {h} then {quote(f)}" for h, f in zip(hits, K.FAMILIES)) + " end end)"


def alias_equivalent(a: str, b: str) -> str:
    return "(" + " or ".join(f"({a} in ({m}) and {b} in ({m}))" for m in (", ".join(map(quote, f)) for f in K.CLASS_FAMILIES)) + ")"


def class_tokens(v: str) -> str:
    own = f"list_filter(list_distinct(string_split({v}, ' ')), lambda t: t <> '')"
    more = ", ".join(f"(case when list_has_any({own}, {lists(f)}) then {lists(sorted({w for m in f for w in m.split()}))} else []::varchar[] end)" for f in K.CLASS_FAMILIES)
    return f"list_distinct(flatten([{own}, {more}]))"


def content_tokens(v: str) -> str:
    return f"list_filter(list_distinct(regexp_split_to_array({replace(f'lower(coalesce({v}, ' + quote('') + '))', r'[^a-z\s]', ' ')}, '\\s+')), lambda t: len(t) >= 3)"


def anchors(v: str, words: list[str]) -> str:
    return f"(len(list_intersect({content_tokens(v)}, {lists(words)}))::double / {len(words)})"


def comparison_text(v: str) -> str:
    return f"trim({replace(f'lower(coalesce({v}, ' + quote('') + '))', '[^a-z0-9]+', ' ')})"


def parity_text(v: str) -> str:
    return f"trim({replace(replace(f'lower(coalesce({v}, ' + quote('') + '))', '[^a-z0-9.%/ ]+', ''), ' +', ' ')})"


def presence_match(a: str, b: str) -> str:
    x, y = parity_text(a), parity_text(b)
    p, q = (f"list_filter(string_split({v}, ' '), lambda t: len(t) >= 3)" for v in (x, y))
    found = f"len(list_filter({p}, lambda t: len(list_filter({q}, lambda u: contains(t, u) or contains(u, t))) > 0)) > 0"
    return f"(case when {x} = '' or {y} = '' or len({p}) = 0 or len({q}) = 0 then {x} = {y} else {found} end)"


def blank(v: str) -> str:
    return f"coalesce(trim({v}) = '', true)"


def similar(a: str, b: str) -> str:
    short, long = f"least(len({a}), len({b}))", f"greatest(len({a}), len({b}), 1)"
    within = f"{short} >= 4 and {short}::double / {long} >= 0.75 and (contains({a}, {b}) or contains({b}, {a}))"
    return f"({a} = {b} or ({within}) or ({short} >= 4 and left({a}, 4) = left({b}, 4)))"


def clean_line(v: str) -> str:
    plain = whitespace(replace(v, "[“”\"']", ""))
    return f"trim({replace(plain, EDGES, '')})"


def diff(source: str) -> str:
    """CTEs that end in ``parts`` (pid, position, kind, text): the word differences of the texts a and b of ``source`` (pid, a, b).

    ``filled`` holds the table of common lengths, a list for each beginning of a; ``walk`` goes back through it from the end, along b where both ways are as long.
    """
    cell = "greatest(row[-1], best[j[1] + 1], best[j[1]] + case when x[i + 1] = y[j[1]] then 1 else 0 end)"
    move = "case when w.i > 0 and w.j > 0 and x[w.i] = y[w.j] then 'equal' when w.j > 0 and (w.i = 0 or f.best[w.j] >= g.best[w.j + 1]) then 'extra' else 'missing' end"
    return f"""cut as (select pid, a, b, regexp_extract_all(a, '\\S+\\s*') x, regexp_extract_all(b, '\\S+\\s*') y from {source}),
both_full as (select * from cut where len(x) > 0 and len(y) > 0),
filled as (select pid, 0::bigint i, list_transform(range(0, len(y) + 1), lambda k: 0::bigint) best from both_full
 union all select pid, i + 1, list_reduce(list_prepend([0::bigint], list_transform(range(1, len(y) + 1), lambda j: [j])), lambda row, j: list_append(row, {cell})) from filled join both_full using (pid) where i < len(x)),
walk as (select pid, len(x)::bigint i, len(y)::bigint j, 0 step, '' kind, '' word from both_full
 union all select pid, case when move = 'extra' then i else i - 1 end, case when move = 'missing' then j else j - 1 end, step + 1, move, case when move = 'extra' then y[j] else x[i] end
 from (select w.pid, w.i, w.j, w.step, c.x, c.y, {move} move from walk w join both_full c on c.pid = w.pid join filled f on f.pid = w.pid and f.i = w.i left join filled g on g.pid = w.pid and g.i = w.i - 1 where w.i > 0 or w.j > 0)),
turned as (select *, case when kind = lag(kind) over (partition by pid order by step desc) then 0 else 1 end new from walk where step > 0),
numbered as (select *, sum(new) over (partition by pid order by step desc) - 1 position from turned),
parts as (select pid, position::int as position, kind, string_agg(word, '' order by step desc) as text from numbered group by pid, position, kind
 union all select pid, 0, 'extra', b from cut where len(x) = 0 and len(y) > 0 union all select pid, 0, 'missing', a from cut where len(x) > 0 and len(y) = 0)"""
