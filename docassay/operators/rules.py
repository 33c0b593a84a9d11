"""Label rules, the rule engine and the verdict. A rule is a function from columns to a struct; adding one extends RULES."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import normalize as N


def none() -> Column:
    return F.lit(None).cast("string")


def blank(v: Column) -> Column:
    return F.coalesce(F.trim(v) == "", F.lit(True))


def outcome(cases: list[tuple[Column, str, str | None]], value: Column, status: str = "pass") -> Column:
    """The first case (condition, status, reason) that holds, else ``status`` without a reason. Conditions are tried once, in order."""
    first = reduce(lambda w, c: w.when(c[1][0], c[0]), list(enumerate(cases))[1:], F.when(cases[0][0], 0)).otherwise(len(cases))
    statuses = N.words_in([*(c[1] for c in cases), status])
    reasons = F.array(*[F.lit(c[2]) for c in cases], none())
    return N.once(first, lambda i: F.struct(F.get(statuses, i).alias("status"), F.get(reasons, i).alias("reason"), value.cast("string").alias("extracted_value")))


def brand() -> Column:
    v = F.col("brand_name")
    low = F.coalesce(F.col("extraction_confidence") == "low", F.lit(False))
    return outcome([
        (blank(v), "warn", "Brand name not detected on the label."),
        (low, "uncertain", "Brand name extracted, but the image quality made the reading unreliable."),
    ], v)


def abv() -> Column:
    v, t = F.col("abv"), F.trim("abv")
    known = t.rlike(K.PERCENT) | t.rlike(K.PROOF) | t.rlike(K.BARE_NUMBER)
    return outcome([
        (F.coalesce(v == "", F.lit(True)), "warn", "Alcohol content (ABV) not detected on the label."),
        (~known, "warn", "Alcohol content is present but not in a recognized format (expected a percentage or proof value)."),
    ], F.nullif(v, F.lit("")))


def warning() -> Column:
    v = F.col("warning_text")
    text = "The Government Warning text is correct, but "
    # 0: no sentence, 1: the first, 2: the second, 3: both, or the canonical text.
    plain = F.lower(N.whitespace(v))
    share = lambda t, a: (F.size(F.array_intersect(t, N.words_in(a))) / F.lit(len(a)) >= K.ANCHOR_SHARE).cast("int")
    sentences = N.once(N.content_tokens(v), lambda t: share(t, K.ANCHORS_1) + 2 * share(t, K.ANCHORS_2))
    held = N.once(plain, lambda p: F.when(p == K.WARNING.lower(), 3).when(~F.contains(p, F.lit(K.WARNING_PREFIX.lower())), -1).otherwise(sentences))
    return N.once(F.when(~blank(v), held), lambda h: outcome([
        (h.isNull(), "fail", "Government Warning not detected on the label."),
        (h == -1, "fail", f'The "{K.WARNING_PREFIX}" prefix is missing from the warning text.'),
        (h == 2, "fail", "The Government Warning is missing the first sentence about the Surgeon General and pregnancy."),
        (h == 1, "fail", "The Government Warning is missing the second sentence about driving and machinery."),
        (h == 0, "fail", "The Government Warning text differs substantially from the required wording."),
        (F.coalesce(~F.col("appears_bold"), F.lit(False)), "uncertain", text + "may not appear in bold as required."),
        (F.coalesce(~F.col("appears_all_caps"), F.lit(False)), "uncertain", text + 'the "GOVERNMENT WARNING:" prefix may not be in all caps as required.'),
    ], F.when(h.isNotNull(), v)))


def net_contents() -> Column:
    v = F.col("net_contents")
    return outcome([
        (F.coalesce(v == "", F.lit(True)), "warn", "Net contents not detected on the label."),
        (~F.trim(v).rlike(K.NET_CONTENTS), "warn", "Net contents is present but the unit is not in a recognized format (mL, L, or fl oz)."),
    ], F.nullif(v, F.lit("")))


def class_type() -> Column:
    v = F.col("class_type")
    return outcome([(blank(v), "warn", "Class/type designation not detected on the label.")], v)


def producer_origin() -> Column:
    p, c = F.col("producer"), F.col("country_of_origin")

    def judged(inferred: Column) -> Column:
        country = ~blank(c) | inferred
        shown = F.nullif(F.concat_ws(" · ", F.nullif(p, F.lit("")), F.nullif(F.coalesce(c, F.when(inferred, "USA")), F.lit(""))), F.lit(""))
        return outcome([
            (blank(p) & ~country, "warn", "Both producer and country of origin are missing from the label."),
            (blank(p), "warn", "Producer information is missing from the label."),
            (~country, "warn", "Country of origin is missing from the label."),
        ], shown)

    return N.once(blank(c) & N.implies_domestic(p), judged)


#: Evaluation order; what is shown first is DISPLAY_ORDER.
RULES: dict[str, Callable[[], Column]] = {
    "brand": brand, "abv": abv, "governmentWarning": warning, "netContents": net_contents, "classType": class_type, "producerOrigin": producer_origin,
}


def rule_results(labels: DataFrame, rules: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """doc_id, rule_id, rule_order, status, reason, extracted_value: all rules of all labels in one pass."""
    rules = RULES if rules is None else rules
    rows = F.array(*[F.struct(F.lit(name).alias("rule_id"), F.lit(i).alias("rule_order"), rule().alias("r")) for i, (name, rule) in enumerate(rules.items())])
    return labels.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.rule_id", "x.rule_order", "x.r.*")


def verdict_of(warning_fails: Column, mismatch: Column, any_issue: Column) -> Column:
    return F.when(warning_fails, "non_compliant").when(mismatch | any_issue, "needs_review").otherwise("compliant")


def verdict_column(mismatch: Column) -> Column:
    """The verdict of a label row, given whether the cross-check found a mismatch; needs no shuffle."""
    statuses = F.array(*[rule()["status"] for rule in RULES.values()])
    at = list(RULES).index("governmentWarning")
    return N.once(statuses, lambda s: verdict_of(s[at] == "fail", mismatch, F.exists(s, lambda x: x.isin("warn", "fail"))))


def initial_status(verdict: Column) -> Column:
    return F.when(verdict == "non_compliant", "pending_rejection").otherwise("pending_approval")


def comparison_status(surfaced: Column, matched: Column, not_on_application: Column) -> Column:
    return F.when(surfaced, "warn").when(matched, "pass").when(not_on_application, "uncertain")


def merged_status(rule_status: Column, surfaced: Column) -> Column:
    return F.when(rule_status.isin("fail", "warn", "uncertain"), rule_status).when(surfaced, "warn").otherwise(rule_status)
