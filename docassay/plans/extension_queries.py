"""Queries of the extension points: a rule, an extractor, a re-reader, a compared field and scored fields that a caller brings along."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import cross_check as C
from ..operators import extract as E
from ..operators import quality as Q
from ..operators import rules as R
from . import duck as D
from . import fixtures as X
from .quality_queries import RUN
from .quality_queries import pairs as run_pairs
from .text_queries import FX, RULED
from .word_queries import FIELDS, HITS, PAGES, fields, page_spans, pages

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def add(name, make, sql):
    QUERIES[name] = make
    ORACLE_SQL[name] = sql


def vintage():
    """A caller's rule: who declares a wine appellation must name a varietal too."""
    varietal, appellation = c("wine_varietal"), c("wine_appellation")
    return R.outcome([(~R.blank(appellation) & R.blank(varietal), "warn", "An appellation stands without a varietal."), (R.blank(appellation), "uncertain", None)], N.varietal(varietal))


_without = f"not {D.blank('wine_appellation')} and {D.blank('wine_varietal')}"
add(
    "U1_added_rule",
    lambda s, d: R.rule_results(X.labels(s, d), {**R.RULES, "appellationNeedsVarietal": vintage}).select("doc_id", "rule_id", "rule_order", "status"),
    f"""with {FX}, {RULED} select doc_id, rule_id, rule_order, status from ruled union all
select doc_id, 'appellationNeedsVarietal', {len(R.RULES)}, case when {_without} then 'warn' when {D.blank('wine_appellation')} then 'uncertain' else 'pass' end from fx_labels""",
)


def extracted(s, d):
    words = page_spans(s, d).select("doc_id", "page", "idx", "text", F.lit(0.0).alias("y0"), c("idx").cast("double").alias("x0"))
    extractor: E.Extractor = E.pattern_extractor
    return extractor(words, X.forms(s, d))


add("U2_document_extractor", extracted, f"with {HITS} select doc_id, field, b.value as value, b.page as page from best")


def reread(s, d):
    """A re-reader that answers what it is asked for from the pages' patterns; any table of doc_id, field and value would do."""
    asked = E.fallback_targets(fields(s, d))
    answers = E.first_patterns(pages(s, d)).join(asked, ["doc_id", "field"], "left_semi").select("doc_id", "field", "value")
    return E.merge_answers(fields(s, d), answers).where("field = 'countryOfOrigin'")


_plain = f"lower({D.whitespace('answer')})"
_no_country = ", ".join(map(D.quote, ("", "null", "n/a", "na", "none", "not applicable", "american")))
add(
    "U3_field_reader", reread,
    f"""with {FIELDS}, {HITS.replace(PAGES, PAGES[len(FX) + 2:])},
an as (select fl.*, case when source <> 'vlm' and (coalesce(trim(fl.value), '') = '' or not has_box or mean_conf < {E.UNSURE}) then b.value end answer
 from fl left join best on best.doc_id = fl.doc_id and best.field = fl.field where fl.field = 'countryOfOrigin'),
st as (select *, case when {_plain} not in ({_no_country}) and not regexp_matches({_plain}, {D.quote(E.PRODUCT_WORDS)}) then trim(answer) end stored from an)
select doc_id, field, coalesce(stored, value) as value, case when stored is null or {D.comparison_text('value')} = {D.comparison_text('stored')} then source else 'vlm' end as source, stored is not null as taken from st""",
)


def other_fields() -> C.Fields:
    """A caller's comparison: the declared source against the country on the label, by equality alone."""
    declared = F.nullif(c("x_country"), F.lit(""))
    return [("labelCountry", declared, c("country_of_origin"), N.exact(declared) == N.country(c("country_of_origin")))]


_declared = "case source when 'Imported' then 'IMPORTED' when 'Domestic' then 'USA' end"
_status = f"case when a is null and b is null then 'not_applicable' when a is null then 'not_on_application' when b is null then 'not_on_label' when {D.exact('a')} = {D.country('b')} then 'match' else 'mismatch' end"
add(
    "U4_compared_field",
    lambda s, d: C.cross_check(C.paired(X.labels(s, d), X.forms(s, d)), other_fields()).select("doc_id", "field_id", "status", "application_value", "label_value"),
    f"""with {FX}, p as (select l.doc_id, {_declared} a, l.country_of_origin b from fx_labels l join fx_forms f using (doc_id))
select doc_id, 'labelCountry' as field_id, {_status} as status, a as application_value, b as label_value from p""",
)
_normal = lambda v: f"lower({D.whitespace(v)})"
_values = ", ".join(f"('{f}', ({_normal(f)} is not distinct from {_normal('a_' + f)})::int)" for f in ("warning_text", "abv"))
add(
    "U5_scored_fields",
    lambda s, d: Q.field_scores(run_pairs(s, d), ["warning_text", "abv"]),
    f"with {RUN} select doc_id, u.field, u.score from pairs, lateral (values {_values}) u(field, score) where not failed",
)
