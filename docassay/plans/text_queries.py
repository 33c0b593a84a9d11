"""Queries of the comparators, joins, rules and the verdict over forms and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N
from ..operators import cross_check as C
from ..operators import lexicon as L
from ..operators import matching as M
from ..operators import rules as R
from . import duck as D
from . import fixtures as X

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FX = f"fx_forms as ({X.FORMS}), fx_labels as ({X.LABELS})"


def add(name, make, sql=None):
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


def scalar(name, source, columns, sql_columns):
    """A query that applies Column expressions to forms or labels, and the same in DuckDB."""
    make = X.labels if source == "fx_labels" else X.forms
    add(name, lambda s, d: make(s, d).select("doc_id", *[c().alias(n) for n, c in columns.items()]), f"with {FX} select doc_id, {', '.join(f'{v} as {n}' for n, v in sql_columns.items())} from {source}")


c = F.col
joined_array = lambda v: F.array_join(F.array_sort(v), " ")
sorted_list = lambda v: f"array_to_string(list_sort({v}), ' ')"

scalar("N1_normalize_whitespace", "fx_labels", {"v": lambda: N.whitespace(F.concat(F.lit("  "), c("producer"), F.lit(" \t x ")))}, {"v": D.whitespace("('  ' || producer || ' ' || chr(9) || ' x ')")})
add(
    "N2_strip_diacritics",
    lambda s, d: X.table(s, d, "documents").select("doc_id", N.strip_diacritics(c("text")).alias("v")),
    "select doc_id, strip_accents(text) as v from documents",
)
scalar("N3_normalized_exact", "fx_forms", {"v": lambda: N.exact(c("applicant_name")), "w": lambda: N.exact(c("wine_appellation"))}, {"v": D.exact("applicant_name"), "w": D.exact("wine_appellation")})
scalar("N4_expand_states", "fx_labels", {"v": lambda: N.expand_states(F.lower("producer"))}, {"v": D.expand_states("lower(producer)")})
scalar("N5_producer_tokens", "fx_labels", {"v": lambda: joined_array(N.producer_tokens(c("producer")))}, {"v": sorted_list(D.producer_tokens("producer"))})
scalar("N6_implies_domestic", "fx_labels", {"v": lambda: N.implies_domestic(c("producer"))}, {"v": D.implies_domestic("producer", D.producer_tokens("producer"))})
scalar("N7_country_value", "fx_labels", {"v": lambda: N.country(c("country_of_origin"))}, {"v": D.country("country_of_origin")})
scalar("N8_no_declaration", "fx_forms", {"v": lambda: N.no_declaration(c("grape_varietals"))}, {"v": D.no_declaration("grape_varietals")})
add(
    "N9_lexicon_text",
    lambda s, d: X.table(s, d, "documents").select("doc_id", N.lexicon_text(c("text")).alias("v")),
    f"select doc_id, {D.lexicon_text('text')} as v from documents",
)
scalar("N10_type_only", "fx_labels", {"v": lambda: N.type_only(c("class_type"))}, {"v": D.type_only("class_type")})

KEYS = f"{D.keys('kv', K.VARIETALS)}, {D.keys('ka', K.APPELLATIONS)}"
ITEMS = f"""{KEYS}, fx as (select l.*, f.product_type, f.source, f.brand_name f_brand, f.applicant_name, f.applicant_city, f.applicant_state, f.grape_varietals, f.wine_appellation f_app,
 coalesce(f.product_type, case when coalesce(f.grape_varietals, '') <> '' or coalesce(f.wine_appellation, '') <> '' then 'WINE' else 'DISTILLED SPIRITS' end) gate from fx_labels l join fx_forms f using (doc_id)),
cand as (select fx.*, {D.candidates('grape_varietals', 'kv.ks')} fv, {D.candidates('f_app', 'ka.ks')} fa, {D.candidates('wine_varietal', 'kv.ks')} lv, {D.candidates('wine_appellation', 'ka.ks')} la, {D.candidates('class_type', 'kv.ks')} cv from fx, kv, ka),
lex as (select * exclude (fv, fa, lv, la, cv), {D.accepted('fv')} fv, {D.accepted('fa')} fa, {D.accepted('lv')} lv, {D.accepted('la')} la, {D.accepted('cv')} cv from cand),
claims as (select *, case when not {D.no_declaration('grape_varietals')} and not {D.type_only('grape_varietals')} then nullif(array_to_string(fv, ', '), '') end x_var,
 case when {D.no_declaration('f_app')} then null when len(fa) > 0 then fa[1] when not {D.type_only('f_app')} then nullif(trim(f_app), '') end x_app,
 case when not {D.no_declaration('wine_varietal')} and not {D.type_only('wine_varietal')} then nullif(array_to_string(lv, ', '), '') end l_var,
 case when {D.no_declaration('wine_appellation')} then null when len(la) > 0 then la[1] when not {D.type_only('wine_appellation')} then nullif(trim(wine_appellation), '') end l_app,
 {D.family('class_type', 'cv')} l_family from lex)"""


def pairs(s, d):
    return C.paired(X.labels(s, d), X.forms(s, d))


add(
    "N11_wine_claims",
    lambda s, d: X.forms(s, d).select("doc_id", N.varietal_claim(c("grape_varietals")).alias("varietal"), N.appellation_claim(c("wine_appellation")).alias("appellation")),
    f"with {FX}, {ITEMS} select doc_id, x_var as varietal, x_app as appellation from claims",
)
add("N12_family_from_text", lambda s, d: X.labels(s, d).select("doc_id", N.family(c("class_type")).alias("family")), f"with {FX}, {ITEMS} select doc_id, l_family as family from claims")
scalar(
    "N13_alias_and_containment", "fx_labels",
    {"alias": lambda: N.alias_equivalent(N.exact(c("class_type")), F.lit("ipa")), "contained": lambda: N.token_containment(N.exact(c("class_type")), F.lit("ipa"))},
    {"alias": D.alias_equivalent(D.exact("class_type"), "'ipa'"), "contained": f"(len({D.class_tokens(D.exact('class_type'))}) > 0 and ({D.subset(D.class_tokens(D.exact('class_type')), D.class_tokens(chr(39) + 'ipa' + chr(39)))} or {D.subset(D.class_tokens(chr(39) + 'ipa' + chr(39)), D.class_tokens(D.exact('class_type')))}))"},
)
_APP = "concat_ws(', ', f.applicant_name, f.applicant_city, f.applicant_state)"
TOKENS = f"tok as (select l.doc_id, {D.producer_tokens(_APP)} a, {D.producer_tokens('l.producer')} b from fx_labels l join fx_forms f using (doc_id))"
add(
    "N14_jaccard",
    lambda s, d: pairs(s, d).select("doc_id", F.round(N.jaccard(N.producer_tokens(c("x_producer")), N.producer_tokens(c("producer"))), 9).alias("score")),
    f"with {FX}, {TOKENS} select doc_id, round({D.jaccard('a', 'b')}, 9) as score from tok",
)
scalar(
    "N15_anchor_coverage", "fx_labels",
    {"one": lambda: F.round(N.anchor_coverage(c("warning_text"), K.ANCHORS_1), 9), "two": lambda: F.round(N.anchor_coverage(c("warning_text"), K.ANCHORS_2), 9)},
    {"one": f"round({D.anchors('warning_text', K.ANCHORS_1)}, 9)", "two": f"round({D.anchors('warning_text', K.ANCHORS_2)}, 9)"},
)
scalar("N16_comparison_text", "fx_labels", {"v": lambda: N.comparison_text(c("producer"))}, {"v": D.comparison_text("producer")})
scalar("N17_eval_text", "fx_labels", {"v": lambda: N.eval_text(c("abv")), "w": lambda: N.whitespace(c("warning_text"))}, {"v": f"lower({D.whitespace('abv')})", "w": D.whitespace("warning_text")})
add(
    "N18_presence_match",
    lambda s, d: pairs(s, d).select("doc_id", N.parity_text(c("producer")).alias("text"), N.presence_match(c("brand_name"), c("x_brand")).alias("brand"), N.presence_match(c("class_type"), c("x_varietal")).alias("other")),
    f"with {FX}, {ITEMS} select doc_id, {D.parity_text('producer')} as text, {D.presence_match('brand_name', 'f_brand')} as brand, {D.presence_match('class_type', 'case when product_type = ' + D.quote('WINE') + ' then x_var end')} as other from claims",
)
SECRETS = "fx_secrets as (select doc_id, text || case doc_id % 7 when 0 then ' sk-proj-' || repeat('aB3_', 6) when 1 then ' Bearer ' || repeat('tok.', 6) when 2 then ' Authorization: Basic' || doc_id || ', rate limit 429' when 3 then ' sk-ant-' || repeat('x9-z', 6) when 4 then ' api-key: k' || doc_id || ' timed out' when 5 then ' sk-' || repeat('q', 24) || ' bearer ' || repeat('w', 30) || ' 401 unauthorized' else '' end as msg from documents)"


def secrets(s, d):
    return X.view(s, d, f"with {SECRETS} select * from fx_secrets")


add(
    "N19_scrub_secrets",
    lambda s, d: secrets(s, d).select("doc_id", N.scrub(c("msg")).alias("v"), (N.scrub(c("msg")) != c("msg")).alias("changed")),
    f"with {SECRETS}, x as (select doc_id, msg, {reduce(lambda o, p: D.replace(o, p, K.REDACTED), K.SECRETS, 'msg')} as v from fx_secrets) select doc_id, v, v <> msg as changed from x",
)
add(
    "N20_error_category",
    lambda s, d: secrets(s, d).groupBy(N.error_category(c("msg")).alias("category")).agg(F.count("*").alias("n")),
    f"with {SECRETS} select case " + " ".join(f"when regexp_matches(msg, {D.quote(p)}) then {D.quote(n)}" for n, p in K.ERROR_CATEGORIES) + " else 'other' end as category, count(*) as n from fx_secrets group by 1",
)
_SHOWN = ["brand_name", "abv", "warning_text", "net_contents", "class_type", "producer", "country_of_origin", "wine_varietal", "wine_appellation"]
scalar(
    "N23_redact_summary", "fx_labels",
    {"extraction_confidence": lambda: c("extraction_confidence"), "present": lambda: F.concat_ws(",", *[F.when(c(f).isNotNull(), f) for f in _SHOWN])},
    {"extraction_confidence": "extraction_confidence", "present": "concat_ws(',', " + ", ".join(f"case when {f} is not null then '{f}' end" for f in _SHOWN) + ")"},
)
add(
    "N24_expectations",
    lambda s, d: C.expectations(X.forms(s, d)),
    f"with {FX}, {ITEMS} select doc_id, product_type as wine_gate, f_brand as x_brand, product_type as x_class, {_APP.replace('f.', '')} as x_producer, case source when 'Imported' then 'IMPORTED' when 'Domestic' then 'USA' else '' end as x_country, case when product_type = 'WINE' then x_var end as x_varietal, case when product_type = 'WINE' then x_app end as x_appellation from claims",
)
scalar(
    "N25_mailing_join", "fx_forms", {"v": lambda: N.joined(c("applicant_name"), c("source"), F.lit(""), c("applicant_city"))},
    {"v": "nullif(concat_ws(', ', nullif(applicant_name, ''), nullif(source, ''), nullif(applicant_city, '')), '')"},
)

# --- joins and matching ---
add(
    "J1_form_label_join",
    lambda s, d: pairs(s, d).select("doc_id", "brand_name", "x_brand", c("wine_gate").isNotNull().alias("has_form")),
    f"with {FX} select l.doc_id, l.brand_name, f.brand_name as x_brand, f.doc_id is not null as has_form from fx_labels l left join fx_forms f using (doc_id)",
)
_pm = f"(len(a) >= 2 and {D.subset('a', 'b')}) or (len(b) >= 2 and {D.subset('b', 'a')}) or {D.jaccard('a', 'b')} >= {K.PRODUCER_THRESHOLD}"
add(
    "J3_producer_match",
    lambda s, d: pairs(s, d).select("doc_id", N.producer_match(c("x_producer"), F.coalesce("producer", F.lit(""))).alias("matched")),
    f"with {FX}, {TOKENS} select doc_id, {_pm} as matched from tok",
)
add(
    "J3_producer_links",
    lambda s, d: M.token_links(X.table(s, d, "supplier").select(c("s_suppkey").alias("left_id"), c("s_name").alias("v")), X.labels(s, d).select(c("doc_id").alias("right_id"), c("producer").alias("v"))),
    f"with {FX}, a as (select s_suppkey left_id, unnest({D.producer_tokens('s_name')}) t, len({D.producer_tokens('s_name')}) n from supplier), b as (select doc_id right_id, unnest({D.producer_tokens('producer')}) t, len({D.producer_tokens('producer')}) n from fx_labels) select left_id, right_id, count(*) as shared, round(count(*)::double / (a.n + b.n - count(*)), 9) as score from a join b using (t) group by left_id, right_id, a.n, b.n having count(*)::double / (a.n + b.n - count(*)) >= {K.PRODUCER_THRESHOLD} or (a.n >= 2 and count(*) = a.n) or (b.n >= 2 and count(*) = b.n)",
)
_country = D.country("coalesce(country_of_origin, '')")
add(
    "J4_country_match",
    lambda s, d: pairs(s, d).select("doc_id", N.country_match(c("x_country"), F.coalesce("country_of_origin", F.lit(""))).alias("matched")),
    f"with {FX}, {ITEMS}, t as (select doc_id, case source when 'Imported' then 'imported' when 'Domestic' then 'usa' else '' end a, {_country} b from claims) select doc_id, case when a = 'imported' then b not in ('usa', '') else a = b end as matched from t",
)
_a, _b = D.exact("product_type"), D.exact("class_type")
_within = f"(len({D.class_tokens(_a)}) > 0 and len({D.class_tokens(_b)}) > 0 and ({D.subset(D.class_tokens(_a), D.class_tokens(_b))} or {D.subset(D.class_tokens(_b), D.class_tokens(_a))}))"
_ct = f"case when {_a} = {_b} then true when {_a} in ({', '.join(D.quote(f.lower()) for f in K.FAMILIES)}) then coalesce(l_family = upper({_a}), false) else {D.alias_equivalent(_a, _b)} or {_within} end"
add("J5_class_type_match", lambda s, d: pairs(s, d).select("doc_id", N.class_type_match(c("x_class"), F.coalesce("class_type", F.lit(""))).alias("matched")), f"with {FX}, {ITEMS} select doc_id, {_ct} as matched from claims")


def lexicon_matches(s, d):
    found = L.lexicon_join(X.labels(s, d), "wine_varietal", L.lexicon(s, K.VARIETALS), "varietals")
    found = L.lexicon_join(found, "producer", L.lexicon(s, K.APPELLATIONS), "appellations")
    return found.select("doc_id", F.array_join("varietals", "|").alias("varietals"), F.array_join("appellations", "|").alias("appellations"))


add(
    "J6_lexicon_match", lexicon_matches,
    f"""with {FX}, {KEYS}, x as (select doc_id, {D.candidates('wine_varietal', 'kv.ks')} v, {D.candidates('producer', 'ka.ks')} a from fx_labels, kv, ka)
select doc_id, array_to_string({D.accepted('v')}, '|') as varietals, array_to_string({D.accepted('a')}, '|') as appellations from x""",
)
add(
    "J6_lexicon_expression",
    lambda s, d: X.labels(s, d).select("doc_id", F.array_join(N.lexicon_matches(c("wine_varietal"), K.VARIETALS), "|").alias("varietals"), F.array_join(N.lexicon_matches(c("producer"), K.APPELLATIONS), "|").alias("appellations")),
    ORACLE_SQL["J6_lexicon_match"],
)


def places_named(s, d):
    """A lexicon that is a table: nations and regions, whose keys may have several words, in what labels say of their producers."""
    nations = X.table(s, d, "nation").select(c("n_name").alias("key"), c("n_name").alias("name"), c("n_nationkey").alias("place"))
    regions = X.table(s, d, "region").select(c("r_name").alias("key"), F.concat(c("r_name"), F.lit(" (region)")).alias("name"), (c("r_regionkey") + 1000).alias("place"))
    rows = X.labels(s, d).select("doc_id", F.concat_ws(" of ", "producer", "country_of_origin").alias("said"))
    return L.lexicon_join(rows, "said", nations.unionByName(regions), "names").select("doc_id", F.array_join("names", "|").alias("names"))


add(
    "J6_lexicon_table", places_named,
    f"""with {FX}, n as (select n_name k, n_name nm, n_nationkey o from nation union all select r_name, r_name || ' (region)', r_regionkey + 1000 from region),
t as (select {D.lexicon_text('k')} k, nm, o from n), ks as (select list({{'key': k, 'name': nm, 'ord': o}} order by -len(k), o, nm) ks from t where k <> ''),
x as (select doc_id, {D.candidates("concat_ws(' of ', producer, country_of_origin)", 'ks.ks')} v from fx_labels, ks) select doc_id, array_to_string({D.accepted('v')}, '|') as names from x""",
)


def items_named(s, d):
    """A lexicon that grows with the data: the first three words of every benchmark item, in whole documents."""
    items = X.table(s, d, "benchmark").select(F.array_join(F.slice(F.split(N.lexicon_text(c("text")), " "), 1, 3), " ").alias("key"), c("item_id").cast("string").alias("name"), c("item_id").alias("place"))
    return L.lexicon_join(X.table(s, d, "documents").select("doc_id", "text"), "text", items, "items").select("doc_id", F.array_join("items", "|").alias("items"))


_held = "list_filter(list_transform(ks, lambda e: {'at': instr(' ' || t || ' ', ' ' || e.key || ' '), 'size': len(e.key), 'name': e.name}), lambda e: e.at > 0)"
add(
    "J6_lexicon_documents", items_named,
    f"""with b as (select array_to_string(string_split({D.lexicon_text('text')}, ' ')[1:3], ' ') k, item_id from benchmark),
lexicon as (select list({{'key': k, 'name': item_id::varchar}} order by -len(k), item_id, item_id::varchar) ks from b where k <> ''),
plain as (select doc_id, {D.lexicon_text('text')} t from documents), x as (select doc_id, {_held} v from plain, lexicon)
select doc_id, array_to_string({D.accepted('v')}, '|') as items from x""",
)
_titles = " ".join(f"when '{k}' then '{v.lower()}'" for k, v in C.FIELDS.items())
CHECKED = f"""{FX}, {ITEMS}, {TOKENS}, dom as (select doc_id, coalesce(country_of_origin, case when {D.implies_domestic('producer', D.producer_tokens('producer'))} then 'USA' end) l_country from fx_labels),
sides as (select c.doc_id, c.gate, u.field_id, nullif(trim(u.a), '') is not null has_a, nullif(trim(u.b), '') is not null has_b, u.a, u.b, u.m from claims c join tok using (doc_id) join dom using (doc_id), lateral (values
 ('brandName', f_brand, brand_name, {D.exact('f_brand')} = {D.exact('brand_name')}), ('classType', product_type, class_type, {_ct}), ('producer', {_APP.replace('f.', '')}, producer, {_pm}),
 ('countryOfOrigin', case source when 'Imported' then 'IMPORTED' when 'Domestic' then 'USA' else '' end, l_country, case when source = 'Imported' then {D.country('l_country')} not in ('usa', '') else {D.country('l_country')} = 'usa' end),
 ('wineVarietal', x_var, l_var, {D.exact('x_var')} = {D.exact('l_var')}), ('wineAppellation', x_app, l_app, {D.exact('x_app')} = {D.exact('l_app')})) u(field_id, a, b, m)),
checked as (select *, field_id in ('wineVarietal', 'wineAppellation') and gate <> 'WINE' skipped, case when field_id in ('wineVarietal', 'wineAppellation') and gate <> 'WINE' then 'not_applicable' when not has_a and has_b then 'not_on_application' when not has_a then 'not_applicable' when not has_b then 'not_on_label' when m then 'match' else 'mismatch' end status from sides),
cross_checked as (select doc_id, field_id, status, case when not skipped and has_a then a end application_value, case when not skipped and has_b then b end label_value,
 case when skipped then 'Not a wine label — wine-specific field skipped.' when status = 'not_on_application' then 'Label declares ' || case field_id {_titles} end || ' but the application did not.' when status = 'not_applicable' then 'No expectation declared on the application.' when status = 'not_on_label' then 'Application declares ' || case field_id {_titles} end || ', but it may not have been detected on the label.' when status = 'mismatch' then 'Application value may differ from the label value: application "' || a || '", label "' || b || '".' end reason from checked)"""
add("J2_cross_check", lambda s, d: C.cross_check(pairs(s, d)), f"with {CHECKED} select doc_id, field_id, status, application_value, label_value, reason from cross_checked")


def free_pairs(s, d):
    return C.paired(X.labels(s, d), X.free_forms(s, d))


add("J2_cross_check_free_types", lambda s, d: C.cross_check(free_pairs(s, d)), ORACLE_SQL["J2_cross_check"].replace(X.FORMS, X.FREE_FORMS))
add("J5_class_type_match_free_types", lambda s, d: free_pairs(s, d).select("doc_id", N.class_type_match(c("x_class"), F.coalesce("class_type", F.lit(""))).alias("matched")), ORACLE_SQL["J5_class_type_match"].replace(X.FORMS, X.FREE_FORMS))
add(
    "J12_anchor_coverage_join",
    lambda s, d: M.anchor_join(X.table(s, d, "documents").select("doc_id", "text"), X.table(s, d, "benchmark").select("item_id", "text"), K.ANCHOR_SHARE),
    f"with d as (select distinct doc_id, unnest({D.content_tokens('text')}) t from documents), b as (select distinct item_id, unnest({D.content_tokens('text')}) t, len({D.content_tokens('text')}) n from benchmark) select doc_id, item_id, count(*) as matched, round(count(*)::double / n, 9) as coverage from d join b using (t) group by doc_id, item_id, n having count(*)::double / n >= {K.ANCHOR_SHARE}",
)

# --- rules and verdict ---
STATUS_SQL = {
    "governmentWarning": f"""case when {D.blank('warning_text')} then 'fail' when same or (has_prefix and one and two) then case when appears_bold = false then 'uncertain' when appears_all_caps = false then 'uncertain' else 'pass' end else 'fail' end""",
    "brand": f"case when {D.blank('brand_name')} then 'warn' when extraction_confidence = 'low' then 'uncertain' else 'pass' end",
    "abv": f"case when coalesce(abv = '', true) then 'warn' when regexp_matches(trim(abv), {D.quote(K.PERCENT)}) or regexp_matches(trim(abv), {D.quote(K.PROOF)}) or regexp_matches(trim(abv), {D.quote(K.BARE_NUMBER)}) then 'pass' else 'warn' end",
    "netContents": f"case when coalesce(net_contents = '', true) then 'warn' when regexp_matches(trim(net_contents), {D.quote(K.NET_CONTENTS)}) then 'pass' else 'warn' end",
    "classType": f"case when {D.blank('class_type')} then 'warn' else 'pass' end",
    "producerOrigin": f"case when {D.blank('producer')} or ({D.blank('country_of_origin')} and not dom) then 'warn' else 'pass' end",
}
RULED = f"""pre as (select *, coalesce(lower({D.whitespace('warning_text')}) = {D.quote(K.WARNING.lower())}, false) same, coalesce(contains(lower({D.whitespace('warning_text')}), {D.quote(K.WARNING_PREFIX.lower())}), false) has_prefix,
 {D.anchors('warning_text', K.ANCHORS_1)} >= {K.ANCHOR_SHARE} one, {D.anchors('warning_text', K.ANCHORS_2)} >= {K.ANCHOR_SHARE} two, {D.implies_domestic('producer', D.producer_tokens('producer'))} dom from fx_labels),
ruled as (select doc_id, u.rule_id, u.rule_order, u.status from pre, lateral (values {', '.join(f"('{k}', {i}, {v})" for i, (k, v) in enumerate((k, STATUS_SQL[k]) for k in R.RULES))}) u(rule_id, rule_order, status))"""
_reasons = {
    "R1_rule_brand": ("brand", R.brand, f"case when {D.blank('brand_name')} then 'Brand name not detected on the label.' when extraction_confidence = 'low' then 'Brand name extracted, but the image quality made the reading unreliable.' end", "brand_name"),
    "R2_rule_abv": ("abv", R.abv, f"case when coalesce(abv = '', true) then 'Alcohol content (ABV) not detected on the label.' when {STATUS_SQL['abv']} = 'warn' then 'Alcohol content is present but not in a recognized format (expected a percentage or proof value).' end", "abv"),
    "R3_rule_government_warning": ("governmentWarning", R.warning, f"""case when {D.blank('warning_text')} then 'Government Warning not detected on the label.' when not same and not has_prefix then 'The "GOVERNMENT WARNING:" prefix is missing from the warning text.' when not same and not one and two then 'The Government Warning is missing the first sentence about the Surgeon General and pregnancy.' when not same and one and not two then 'The Government Warning is missing the second sentence about driving and machinery.' when not same and not one and not two then 'The Government Warning text differs substantially from the required wording.' when appears_bold = false then 'The Government Warning text is correct, but may not appear in bold as required.' when appears_all_caps = false then 'The Government Warning text is correct, but the "GOVERNMENT WARNING:" prefix may not be in all caps as required.' end""", "warning_text"),
    "R4_rule_net_contents": ("netContents", R.net_contents, f"case when coalesce(net_contents = '', true) then 'Net contents not detected on the label.' when {STATUS_SQL['netContents']} = 'warn' then 'Net contents is present but the unit is not in a recognized format (mL, L, or fl oz).' end", "net_contents"),
    "R5_rule_class_type": ("classType", R.class_type, f"case when {D.blank('class_type')} then 'Class/type designation not detected on the label.' end", "class_type"),
    "R6_rule_producer_origin": ("producerOrigin", R.producer_origin, f"case when {D.blank('producer')} and {D.blank('country_of_origin')} then 'Both producer and country of origin are missing from the label.' when {D.blank('producer')} then 'Producer information is missing from the label.' when {D.blank('country_of_origin')} and not dom then 'Country of origin is missing from the label.' end", f"nullif(concat_ws(' · ', nullif(producer, ''), nullif(coalesce(country_of_origin, case when {D.blank('country_of_origin')} and dom then 'USA' end), '')), '')"),
}
for _name, (_id, _rule, _why, _value) in _reasons.items():
    add(_name, lambda s, d, rule=_rule: X.labels(s, d).select("doc_id", rule().alias("r")).select("doc_id", "r.*"), f"with {FX}, {RULED} select doc_id, {STATUS_SQL[_id]} as status, {_why} as reason, {_value} as extracted_value from pre")
add("R7_rule_engine", lambda s, d: R.rule_results(X.labels(s, d)).select("doc_id", "rule_id", "rule_order", "status"), f"with {FX}, {RULED} select doc_id, rule_id, rule_order, status from ruled")
VERDICT = f"""{CHECKED}, {RULED}, vd as (select doc_id, case when bool_or(fails) then 'non_compliant' when bool_or(issue) then 'needs_review' else 'compliant' end verdict from (select doc_id, rule_id = 'governmentWarning' and status = 'fail' fails, status in ('warn', 'fail') issue from ruled union all select doc_id, false, status in ('mismatch', 'not_on_label') from cross_checked) group by doc_id)"""
add(
    "R8_verdict",
    lambda s, d: C.verify(X.labels(s, d), X.forms(s, d)).groupBy("product_type", "verdict").agg(F.count("*").alias("n")),
    f"with {VERDICT} select product_type, verdict, count(*) as n from vd join fx_forms using (doc_id) group by all",
)
add("R8_verdict_rows", lambda s, d: C.verify(X.labels(s, d), X.forms(s, d)), f"with {VERDICT} select doc_id, product_type, verdict from vd join fx_forms using (doc_id)")
add(
    "R9_label_only_verdict",
    lambda s, d: X.labels(s, d).select("doc_id", R.verdict_column(F.lit(False)).alias("verdict")),
    f"with {FX}, {RULED} select doc_id, case when bool_or(rule_id = 'governmentWarning' and status = 'fail') then 'non_compliant' when bool_or(status in ('warn', 'fail')) then 'needs_review' else 'compliant' end as verdict from ruled group by doc_id",
)
add(
    "R10_initial_status",
    lambda s, d: C.verify(X.labels(s, d), X.forms(s, d)).groupBy(R.initial_status(c("verdict")).alias("status")).agg(F.count("*").alias("n")),
    f"with {VERDICT} select case verdict when 'non_compliant' then 'pending_rejection' else 'pending_approval' end as status, count(*) as n from vd group by 1",
)
_route = ", ".join(f"('{a}', '{b}')" for a, b in M.ROUTE)
COMPARED = f"route(rule_id, field_id) as (values {_route}), compared as (select x.doc_id, r.rule_id, bool_or(x.status in ('mismatch', 'not_on_label')) surfaced, bool_or(x.status = 'match') matched, bool_or(x.status = 'not_on_application') missing from cross_checked x join route r using (field_id) group by all)"


def compared(s, d):
    return M.compare_by_rule(C.cross_check(pairs(s, d)))


add("J10_comparison_routing", compared, f"with {CHECKED}, {COMPARED} select doc_id, rule_id, surfaced, matched, missing from compared")
add(
    "R12_comparison_status",
    lambda s, d: compared(s, d).select("doc_id", "rule_id", R.comparison_status(c("surfaced"), c("matched"), c("missing")).alias("status")),
    f"with {CHECKED}, {COMPARED} select doc_id, rule_id, case when surfaced then 'warn' when matched then 'pass' when missing then 'uncertain' end as status from compared",
)
add(
    "R11_merged_rule_status",
    lambda s, d: R.rule_results(X.labels(s, d)).join(compared(s, d), ["doc_id", "rule_id"], "left").select("doc_id", "rule_id", R.merged_status(c("status"), F.coalesce("surfaced", F.lit(False))).alias("status")),
    f"with {CHECKED}, {RULED}, {COMPARED} select r.doc_id, r.rule_id, case when r.status in ('fail', 'warn', 'uncertain') then r.status when coalesce(surfaced, false) then 'warn' else r.status end as status from ruled r left join compared c on c.doc_id = r.doc_id and c.rule_id = r.rule_id",
)
_titled = f"select doc_id, rule_id, case rule_id {' '.join(f'when {D.quote(k)} then {D.quote(v)}' for k, v in M.TITLES.items())} end as title, case rule_id {' '.join(f'when {D.quote(k)} then {i}' for i, k in enumerate(M.TITLES))} end as display_order, status from ruled"
add("J9_rule_dim_join", lambda s, d: M.with_rule_titles(R.rule_results(X.labels(s, d))).select("doc_id", "rule_id", "title", "display_order", "status"), f"with {FX}, {RULED} {_titled}")
add("K5_rule_display_sort", lambda s, d: M.with_rule_titles(R.rule_results(X.labels(s, d))).select("doc_id", "rule_id", "title", "display_order", "status").orderBy("doc_id", "display_order"), f"with {FX}, {RULED} {_titled} order by doc_id, display_order")
add(
    "P10_surface_comparison",
    lambda s, d: C.cross_check(pairs(s, d)).where(M.surfaces(c("field_id"), c("status"))).select("doc_id", "field_id", "status"),
    f"with {CHECKED} select doc_id, field_id, status from cross_checked where case when field_id like 'wine%' then status <> 'not_applicable' else status in ('mismatch', 'not_on_label') end",
)
