"""Extraction quality: expected against actual values, gates, and parity between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N

#: Scored fields and thresholds.
SCORED = ["brand_name", "abv", "net_contents", "class_type", "producer", "country_of_origin"]
LEAST_ACCURACY, LEAST_WARNINGS, TOLERANCE, COST = 0.85, 1.0, 0.05, 0.001


def eval_pairs(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected rows with their actual ones (``a_`` columns) and ``failed``: no actual row."""
    own = actual.select(F.col("doc_id").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in actual.columns if c != "doc_id"])
    return expected.join(own, F.col("doc_id") == F.col("a_id"), "left").withColumn("failed", F.col("a_id").isNull()).drop("a_id")


def field_scores(pairs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """doc_id, field, score: 1 where both are null or equal but for case and white space."""
    rows = [F.struct(F.lit(f).alias("field"), N.eval_text(F.col(f)).eqNullSafe(N.eval_text(F.col(f"a_{f}"))).cast("int").alias("score")) for f in fields or SCORED]
    return pairs.where(~F.col("failed")).select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")


def warning_match(e: Column, a: Column) -> Column:
    """A struct of score (1 or 0, with case) and reason."""
    e, a = N.whitespace(e), N.whitespace(a)
    reason = (
        F.when(e.eqNullSafe(a), None)
        .when(e.isNull(), "Hallucinated warning — expected null, got extracted text.")
        .when(a.isNull(), "Missed warning — expected text, got null.")
        .otherwise("Warning text differs from expected (see trace for diff).")
    )
    return F.struct(e.eqNullSafe(a).cast("int").alias("score"), reason.alias("reason"))


def eval_gate(pairs: DataFrame) -> DataFrame:
    """One row: accuracy, warning rate, errors, cases, outcome (3: all failed, 1: below a threshold, 0: passed)."""
    score = sum(N.eval_text(F.col(f)).eqNullSafe(N.eval_text(F.col(f"a_{f}"))).cast("int") for f in SCORED) / F.lit(len(SCORED))
    warned = warning_match(F.col("warning_text"), F.col("a_warning_text"))["score"]
    r = pairs.agg(F.avg(F.when(~F.col("failed"), score)).alias("accuracy"), F.coalesce(F.avg(F.when(~F.col("failed"), warned)), F.lit(0.0)).alias("warnings"), F.count_if("failed").alias("errors"), F.count("*").alias("cases"))
    outcome = F.when(F.col("errors") == F.col("cases"), 3).when((F.col("accuracy") < LEAST_ACCURACY) | (F.col("warnings") < LEAST_WARNINGS), 1).otherwise(0)
    return r.select(F.round("accuracy", 9).alias("accuracy"), F.round("warnings", 9).alias("warnings"), "errors", "cases", outcome.alias("outcome"))


def run_summary(runs: DataFrame) -> DataFrame:
    """Totals of a run: runs has failed, render_ms, extract_ms, total_ms."""
    ok = ~F.col("failed")
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(ok, F.col(c)))), F.lit(0.0)).cast("long").alias(f"mean_{c}")
    return runs.agg(F.count("*").alias("total"), F.count_if(ok).alias("successes"), F.count_if("failed").alias("errors"), mean("render_ms"), mean("extract_ms"), mean("total_ms"))


def parity_fields(pairs: DataFrame, fields: list[str], vlm: Column) -> DataFrame:
    """doc_id, field, matched, exact, fallback of documents that did not fail; ``vlm``: which field name came from a re-read, given by a column function of the field."""
    rows = [F.struct(F.lit(f).alias("field"), N.presence_match(F.col(f), F.col(f"a_{f}")).alias("matched"), F.col(f).eqNullSafe(F.col(f"a_{f}")).alias("exact")) for f in fields]
    found = pairs.where(~F.col("failed")).select("doc_id", F.explode(F.array(*rows)).alias("x")).select("doc_id", "x.*")
    return found.withColumn("fallback", vlm)


def sample_parity(pairs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, accuracy, fallbacks, fields, latency_delta; failed documents stay with accuracy 0."""
    per = found.groupBy(F.col("doc_id").alias("f_id")).agg(F.avg(F.col("matched").cast("int")).alias("share"), F.count_if("fallback").alias("fallbacks"), F.count("*").alias("fields"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = pairs.join(per, F.col("doc_id") == F.col("f_id"), "left")
    return rows.select("doc_id", "failed", F.round(F.coalesce("share", F.lit(0.0)), 9).alias("accuracy"), zero("fallbacks"), zero("fields"), (F.col("a_total_ms") - F.col("total_ms")).alias("latency_delta"), "total_ms", "a_total_ms")


def field_parity(found: DataFrame) -> DataFrame:
    matched = F.count_if("matched")
    return found.groupBy("field").agg(matched.alias("matched"), F.count("*").alias("total"), F.round(matched * 100 / F.count("*")).cast("long").alias("percent"))


def parity_gate(samples: DataFrame) -> DataFrame:
    """One row; accuracy is over successes, latency over all samples."""
    ok = ~F.col("failed")
    r = samples.agg(
        F.coalesce(F.avg(F.when(ok, F.col("accuracy"))), F.lit(0.0)).alias("accuracy"), F.round(F.avg("a_total_ms")).alias("latency"), F.round(F.avg(F.when(ok, F.col("total_ms")))).alias("baseline"),
        F.coalesce(F.sum(F.when(ok, F.col("fallbacks"))), F.lit(0)).alias("fallbacks"), F.coalesce(F.sum(F.when(ok, F.col("fields"))), F.lit(0)).alias("fields"),
    )
    passed = (F.col("accuracy") >= 1 - TOLERANCE) & (F.col("latency") <= F.col("baseline"))
    return r.select(F.round("accuracy", 6).alias("accuracy"), "latency", "baseline", "fallbacks", "fields", F.round(F.col("fallbacks") * COST, 3).alias("cost"), passed.alias("passed"))


def batch_progress(received: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id, received, total, complete."""
    n = received.groupBy(F.col("batch_id").alias("r_id")).agg(F.count("*").alias("n"))
    got = F.coalesce("n", F.lit(0))
    return batches.join(n, F.col("batch_id") == F.col("r_id"), "left").select("batch_id", got.alias("received"), "total", ((F.col("total") > 0) & (got >= F.col("total"))).alias("complete"))


def stage_timings(timings: DataFrame, stages: list[str]) -> DataFrame:
    """Long timings (doc_id, stage, ms) as one row for each document."""
    return timings.groupBy("doc_id").pivot("stage", stages).agg(F.sum("ms"))
