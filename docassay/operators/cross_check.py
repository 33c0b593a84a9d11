"""Declared values of a form against what its label says, field by field."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from . import rules

#: Compared fields and their names.
FIELDS = {
    "brandName": "Brand name", "classType": "Type of product", "producer": "Producer", "countryOfOrigin": "Country of origin",
    "wineVarietal": "Grape varietal", "wineAppellation": "Wine appellation",
}
FORM = ["doc_id", "product_type", "source", "brand_name", "applicant_name", "applicant_city", "applicant_state", "grape_varietals", "wine_appellation"]


def expectations(forms: DataFrame) -> DataFrame:
    """What a form lets one expect of its label: doc_id and an ``expected`` value for each field."""
    type_ = F.coalesce("product_type", F.when((F.coalesce("grape_varietals", F.lit("")) != "") | (F.coalesce("wine_appellation", F.lit("")) != ""), "WINE").otherwise("DISTILLED SPIRITS"))
    wine = type_ == "WINE"
    return forms.select(
        "doc_id", type_.alias("wine_gate"), F.coalesce("brand_name", F.lit("")).alias("x_brand"), F.coalesce("product_type", F.lit("")).alias("x_class"),
        F.coalesce(N.joined(F.col("applicant_name"), F.col("applicant_city"), F.col("applicant_state")), F.lit("")).alias("x_producer"),
        F.when(F.col("source") == "Imported", "IMPORTED").when(F.col("source") == "Domestic", "USA").otherwise("").alias("x_country"),
        F.when(wine, N.varietal_claim(F.col("grape_varietals"))).alias("x_varietal"),
        F.when(wine, N.appellation_claim(F.col("wine_appellation"))).alias("x_appellation"),
    )


def paired(labels: DataFrame, forms: DataFrame) -> DataFrame:
    """Labels with their form's expectations; those without a form stay, with nulls."""
    seen = labels.select(
        "*", N.family(F.col("class_type")).alias("l_family"), N.varietal_claim(F.col("wine_varietal")).alias("l_varietal"), N.appellation_claim(F.col("wine_appellation")).alias("l_appellation"),
        F.coalesce("country_of_origin", F.when(N.implies_domestic(F.col("producer")), "USA")).alias("l_country"),
    )
    return seen.join(expectations(forms), "doc_id", "left")


Fields = list[tuple[str, Column, Column, Column]]


def default_fields() -> Fields:
    """(field, declared, observed, whether they match); a caller may compare other fields or compare them otherwise."""
    full = lambda v: F.when(F.trim(v) != "", v)
    same = lambda a, b: N.exact(a) == N.exact(b)
    kind = lambda a, b: N.class_type_match(a, b, F.col("l_family"))
    pairs = [
        ("brandName", "x_brand", "brand_name", same), ("classType", "x_class", "class_type", kind), ("producer", "x_producer", "producer", N.producer_match),
        ("countryOfOrigin", "x_country", "l_country", N.country_match), ("wineVarietal", "x_varietal", "l_varietal", same), ("wineAppellation", "x_appellation", "l_appellation", same),
    ]
    return [(name, full(F.col(a)), full(F.col(b)), match(full(F.col(a)), full(F.col(b)))) for name, a, b, match in pairs]


def field_status(name: str, declared: Column, observed: Column, matched: Column) -> Column:
    status = F.when(declared.isNull() & observed.isNotNull(), "not_on_application").when(declared.isNull(), "not_applicable").when(observed.isNull(), "not_on_label")
    status = status.when(matched, "match").otherwise("mismatch")
    if name.startswith("wine"):
        status = F.when(F.coalesce(F.col("wine_gate") != "WINE", F.lit(True)), "not_applicable").otherwise(status)
    return F.when(F.col("wine_gate").isNull(), "not_applicable").otherwise(status)


def reported(name: str, v: Column) -> Column:
    """A report row of a field from v: its declared value a, its observed value b, the status and whether it was skipped."""
    wine, title = name.startswith("wine"), FIELDS.get(name, name).lower()
    reason = (
        F.when(v["skipped"], "Not a wine label — wine-specific field skipped." if wine else "No application to compare with.")
        .when(v["status"] == "not_on_application", f"Label declares {title} but the application did not.")
        .when(v["status"] == "not_applicable", "No expectation declared on the application.")
        .when(v["status"] == "not_on_label", f"Application declares {title}, but it may not have been detected on the label.")
        .when(v["status"] == "mismatch", F.concat(F.lit('Application value may differ from the label value: application "'), v["a"], F.lit('", label "'), v["b"], F.lit('".')))
    )
    keep = lambda c: F.when(~v["skipped"], c)
    return F.struct(F.lit(name).alias("field_id"), v["status"].alias("status"), keep(v["a"]).alias("application_value"), keep(v["b"]).alias("label_value"), reason.alias("reason"))


def cross_check(pairs: DataFrame, fields: Fields | None = None) -> DataFrame:
    """doc_id, field_id, status, application_value, label_value, reason: six rows for each pair. Without a form, nothing applies."""
    rows = []
    for name, declared, observed, matched in fields or default_fields():
        skipped = (F.coalesce(F.col("wine_gate") != "WINE", F.lit(True)) if name.startswith("wine") else F.lit(False)) | F.col("wine_gate").isNull()
        seen = F.struct(declared.alias("a"), observed.alias("b"), field_status(name, declared, observed, matched).alias("status"), skipped.alias("skipped"))
        rows.append(N.once(seen, partial(reported, name)))  # or the status would be evaluated for each case of the reason
    return pairs.select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


def mismatch_column(fields: Fields | None = None) -> Column:
    """Whether any field of a pair is a mismatch or missing on the label; needs no shuffle."""
    return reduce(lambda a, b: a | b, [field_status(*f).isin("mismatch", "not_on_label") for f in fields or default_fields()])


def verify(labels: DataFrame, forms: DataFrame) -> DataFrame:
    """doc_id, product_type and verdict of each label; one join, no other shuffle."""
    pairs = paired(labels, forms)
    return pairs.select("doc_id", F.col("wine_gate").alias("product_type"), rules.verdict_column(mismatch_column()).alias("verdict"))
