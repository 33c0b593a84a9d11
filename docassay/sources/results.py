"""Reading and writing of result lines, uploads and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import initial_status
from . import contract as C

MOST_FILE, MOST_UPLOAD, MOST_BATCH = 10 << 20, 25 << 20, 25
#: Accepted kinds of files.
ACCEPTED = ["image/png", "image/jpeg", "image/webp", "application/pdf"]
VERDICTS = ["compliant", "needs_review", "non_compliant"]
CSV_COLUMNS = [
    "filename", "status", "overallStatus", "brandStatus", "brandValue", "abvStatus", "abvValue", "governmentWarningStatus", "governmentWarningReason",
    "netContentsStatus", "netContentsValue", "classTypeStatus", "classTypeValue", "producerOriginStatus", "producerOriginValue", "errorMessage", "durationMs",
]


def scan_files(spark, path: str) -> DataFrame:
    """path, byte_size, content_hash and its prefix of each file; the content itself is not kept."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return rows.select("path", F.col("length").alias("byte_size"), *hashes(F.col("content")))


def hashes(content: Column) -> list[Column]:
    full = F.sha2(content, 256)
    return [full.alias("content_hash"), F.substring(full, 1, 16).alias("hash_prefix")]


def upload_problem() -> Column:
    """Why an upload is refused, or null: columns file_name, mime, byte_size."""
    return (
        F.when(F.col("file_name").isNull(), "missing file")
        .when((F.col("mime") != "") & (F.col("mime") != "application/pdf"), "only PDF files are accepted")
        .when(F.col("byte_size") == 0, "the file is empty")
        .when(F.col("byte_size") > MOST_UPLOAD, "the file is too large")
    )


def admit_batches(files: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id, reason and accepted (number of files) of each batch; the batch list may name batches without files."""
    bad = (F.col("byte_size") > MOST_FILE) | ~F.col("mime").isin(ACCEPTED) | F.col("mime").isNull()
    found = files.groupBy(F.col("batch_id").alias("b_")).agg(F.count("*").alias("n"), F.count_if(~bad).alias("good"))
    rows = batches.join(found, F.col("batch_id") == F.col("b_"), "left")
    n, good = F.coalesce("n", F.lit(0)), F.coalesce("good", F.lit(0))
    reason = F.when(n == 0, "no files").when(n > MOST_BATCH, "too many files").when(good == 0, "no valid files")
    return rows.select("batch_id", reason.alias("reason"), F.when(reason.isNull(), good).otherwise(0).alias("accepted"))


#: What parts of a result line may be.
RULE_STATUSES = ["pass", "warn", "fail", "uncertain"]
CROSS_STATUSES = ["match", "mismatch", "not_on_label", "not_on_application", "not_applicable"]
CROSS_FIELDS = ["brandName", "classType", "producer", "countryOfOrigin", "wineVarietal", "wineAppellation"]
BOX_SOURCES, CONFIDENCES = ["pdf", "tesseract", "vlm"], ["high", "medium", "low"]
FIELD_PATHS = [
    *[f"application.{f}" for f in (
        "repId", "brandName", "fancifulName", "productType", "classType", "source", "applicant.name", "applicant.address", "applicant.city", "applicant.state", "mailingAddress",
        "formula", "grapeVarietals", "wineAppellation", "serialNumber", "plantRegistryNumber", "phone", "email", "applicationType", "containerWording", "applicationDate",
        "applicantSignatureName",
    )],
    *[f"label.{f}" for f in ("brandName", "abv", "governmentWarning", "netContents", "classType", "producer", "countryOfOrigin", "wineVarietal", "wineAppellation")],
]
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
PRODUCT_TYPES, SOURCES = ["WINE", "DISTILLED SPIRITS", "MALT BEVERAGES"], ["Domestic", "Imported"]
ADDRESS = ["name", "addressLine1", "city", "state", "postalCode"]
_maybe = C.text(nullable=True)
EXTRACTED_FORM = C.record({
    "repId": _maybe, "plantRegistryNumber": _maybe, "source": C.one_of(SOURCES, nullable=True), "serialNumber": _maybe, "productType": C.one_of(PRODUCT_TYPES, nullable=True),
    "brandName": _maybe, "fancifulName": _maybe, "applicant": C.record(dict.fromkeys(ADDRESS, _maybe)),
    **dict.fromkeys(["mailingAddress", "formula", "grapeVarietals", "wineAppellation", "phone", "email", "applicationType", "containerWording", "applicationDate", "applicantSignatureName"], _maybe),
})
EXTRACTED_LABEL = C.record({
    "brandName": _maybe, "abv": _maybe, "governmentWarning": C.record({"text": _maybe, "appearsAllCaps": C.flag(nullable=True), "appearsBold": C.flag(nullable=True)}),
    **dict.fromkeys(["netContents", "classType", "producer", "countryOfOrigin", "wineVarietal", "wineAppellation"], _maybe), "extractionConfidence": C.one_of(CONFIDENCES),
})
BOX = C.record(dict.fromkeys("xywh", C.number(0, 1)))
PROVENANCE = C.record({"page": C.number(0, whole=True), "bbox": BOX, "confidence": C.one_of(CONFIDENCES)}, nullable=True)
WORD = C.record({"text": C.text(), "confidence": C.number(0, 100), "bbox": C.record(dict.fromkeys(["x0", "y0", "x1", "y1"], C.number()))})
FIELD_BOX = C.record({"page": C.number(1, whole=True), "source": C.one_of(BOX_SOURCES), "words": C.listing(WORD), "meanConfidence": C.number(0, 100, nullable=True)})
CROSS_FIELD = C.record({"id": C.one_of(CROSS_FIELDS), "label": C.text(), "status": C.one_of(CROSS_STATUSES), "applicationValue": _maybe, "labelValue": _maybe, "reason": C.text(optional=True)})
REPORT = C.record({
    "overallStatus": C.one_of(VERDICTS), "crossCheck": C.record({"overallStatus": C.one_of(["match", "mismatch"]), "fields": C.mapping(CROSS_FIELD, CROSS_FIELDS)}, optional=True),
    "fields": C.mapping(C.record({"status": C.one_of(RULE_STATUSES), "reason": C.text(optional=True), "extractedValue": C.text(optional=True, nullable=True)})),
    "provenance": C.mapping(PROVENANCE, FIELD_PATHS), "bboxes": C.mapping(FIELD_BOX, FIELD_PATHS, optional=True), "extractedForm": EXTRACTED_FORM, "extractedLabel": EXTRACTED_LABEL,
    "pages": C.listing(C.record({"pageNumber": C.number(1, whole=True), "kind": C.text()}), optional=True),
})
_common = {"index": C.number(0, whole=True), "filename": C.text(), "durationMs": C.number(0)}
#: A line of a result stream: the report of a document, or the error in its place.
RESULT_LINE = C.variants("status", {
    "ok": C.record({**_common, "report": REPORT, "applicationId": C.matching(UUID, "uuid", optional=True, nullable=True)}), "error": C.record({**_common, "errorMessage": C.text()}),
})
LINE_COLUMNS = ["kind", "status", "index", "filename", "duration_ms", "application_id", "overall_status", "error_message", "report", "problems", "quarantined"]


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Result lines as rows: ``kind`` (value, parse-error or schema-error), the line's fields, and the report as a variant. Blank lines are gone.

    A line that is not JSON, or that breaks the contract, becomes a row with all its ``problems`` and its text (``quarantined``); nothing fails.
    """
    rest = [c for c in lines.columns if c != value]
    # Blank lines go in a generator: a filter would move below, and work out the text of each line once more where it was read.
    rows = lines.select(*rest, F.explode(F.when(F.col(value).rlike(r"\S"), F.array(value))).alias(value))
    rows = C.checked(rows, value, RESULT_LINE, "v_", "problems")
    good = F.col("problems").isNull()
    take = lambda path, kind: F.when(good, F.try_variant_get("v_", f"$.{path}", kind))
    kind = F.when(F.col("v_").isNull(), "parse-error").when(good, "value").otherwise("schema-error")
    found = [
        kind, take("status", "string"), take("index", "long"), take("filename", "string"), take("durationMs", "double"), take("applicationId", "string"), take("report.overallStatus", "string"),
        take("errorMessage", "string"), take("report", "variant"), F.col("problems"), F.when(~good, F.col(value)),
    ]
    return rows.select(*rest, *[v.alias(n) for v, n in zip(found, LINE_COLUMNS)])


def last_lines(parsed: DataFrame, order: str) -> DataFrame:
    """Of the parsed lines that are values, the one with the greatest ``order`` for each file."""
    rows = parsed.where("kind = 'value'")
    held = [c for c in rows.columns if c != "filename"]
    return rows.groupBy("filename").agg(F.max_by(F.struct(*held), order).alias("r")).select("filename", "r.*")


def check_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Result lines with ``problems``: what their contract forbids, joined; null without any. Blank lines are gone."""
    return parse_lines(lines, value).select(*[c for c in lines.columns if c != value], "problems")


def json_line(*columns: str) -> Column:
    """A compact JSON object that keeps nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def csv_field(v: Column) -> Column:
    """A CSV field, quoted only where it holds a quote, comma or line end; null is empty."""
    text = F.coalesce(v.cast("string"), F.lit(""))
    return F.when(text.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(columns: list[str]) -> Column:
    return F.concat_ws(",", *[csv_field(F.col(c)) for c in columns])


def report_rows(results: DataFrame, rule_results: DataFrame) -> DataFrame:
    """The wide rows of the CSV report, from results (doc_id, filename, status, overallStatus, errorMessage, durationMs) and long rule results."""
    cell = lambda rule, what: F.max(F.when(F.col("rule_id") == rule, F.col(what)))
    names = {c: (c.removesuffix("Status").removesuffix("Value").removesuffix("Reason"), {"S": "status", "V": "extracted_value", "R": "reason"}[c.removeprefix(c.removesuffix("Status").removesuffix("Value").removesuffix("Reason"))[0]]) for c in CSV_COLUMNS[3:15]}
    wide = rule_results.groupBy("doc_id").agg(*[cell(rule, what).alias(c) for c, (rule, what) in names.items()])
    return results.join(wide, "doc_id", "left").select("doc_id", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) if c in names else F.col(c) for c in CSV_COLUMNS])


def write_csv(rows: DataFrame, path: str) -> None:
    """The report as part files whose concatenation, by name, is one CSV text: a single header, CRLF line ends, minimal quoting, values as they are."""
    lines = rows.select(csv_line(CSV_COLUMNS).alias("value"))
    header = rows.sparkSession.createDataFrame([(",".join(CSV_COLUMNS),)], lines.schema).coalesce(1)
    header.union(lines).write.text(path, lineSep="\r\n")


def read_csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines (value) of a written report without its header; line ends inside a value are no CRLF."""
    return spark.read.text(path, lineSep="\r\n").where(F.col("value") != ",".join(CSV_COLUMNS))


def exists(spark: SparkSession, path: str) -> bool:
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    return own.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(own)


def verification_rows(documents: DataFrame) -> DataFrame:
    """What is stored of a verified document: documents has form_brand, label_brand and verdict, and any other columns."""
    rest = [c for c in documents.columns if c not in ("form_brand", "label_brand")]
    return documents.select(*rest, F.coalesce("form_brand", "label_brand").alias("brand_name"), initial_status(F.col("verdict")).alias("status"))


def append_verified(rows: DataFrame, path: str, batch: int, key: str = "content_hash", order: str = "app_id") -> None:
    """Appends, as part ``batch``, the row with the least ``order`` of each key that no other batch holds. A replayed batch replaces its own part.

    Writers of different batches may run at once; where both store a key, ``read_verified`` takes the smaller batch's row.
    """
    spark = rows.sparkSession
    first = rows.groupBy(F.col(key).alias("key_")).agg(F.min_by(F.struct(*rows.columns), order).alias("r")).select("r.*")
    if exists(spark, path):
        known = spark.read.parquet(path).where(F.col("batch") != batch).select(key)
        first = first.join(known, key, "left_anti")
    first.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def read_verified(spark: SparkSession, path: str, key: str = "content_hash") -> DataFrame:
    """One row for each stored key."""
    rows = spark.read.parquet(path)
    kept = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(F.col(key).alias("key_")).agg(F.min_by(F.struct(*kept), "batch").alias("r")).select("r.*")


#: The fields of a saved run.
BASELINE = (
    "capturedAt string, entries array<struct<filename: string, sizeBytes: long, pages: array<struct<pageNumber: int, kind: string, pngSizeBytes: long>>, extractionLatencyMs: double, "
    "renderLatencyMs: double, totalLatencyMs: double, modelId: string, providerName: string, extraction: variant, errorMessage: string>>, "
    "summary struct<totalPdfs: long, successCount: long, errorCount: long, meanRenderLatencyMs: double, meanExtractionLatencyMs: double, meanTotalLatencyMs: double>"
)


def baseline_entries(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One row for each entry of the saved runs in a folder, a JSON document a file (or a line): capturedAt and the entry's fields."""
    return spark.read.json(path, schema=BASELINE, multiLine=not lines).select("capturedAt", F.explode("entries").alias("e")).select("capturedAt", "e.*")


#: The kinds of an application's fields.
APPLICATION_TYPES = ["CERTIFICATE_OF_LABEL_APPROVAL", "CERTIFICATE_OF_EXEMPTION", "DISTINCTIVE_LIQUOR_BOTTLE_APPROVAL", "RESUBMISSION_AFTER_REJECTION"]
_address = dict.fromkeys(ADDRESS, C.text())
APPLICATION = C.record({
    "ttbFormId": C.text(), "formRevision": C.text(), "scenarioId": C.text(), "expectedVerdict": C.one_of(["COMPLIANT", "NEEDS_REVIEW"]),
    "form": C.record({
        "repId": _maybe, "plantRegistryNumber": C.text(), "source": C.one_of(SOURCES), "serialNumber": C.text(), "productType": C.one_of(PRODUCT_TYPES), "brandName": C.text(),
        "fancifulName": _maybe, "applicant": C.record(_address), "mailingAddress": C.record(_address, nullable=True), "formulaId": _maybe, "grapeVarietals": _maybe, "wineAppellation": _maybe,
        "phone": C.text(), "email": C.text(), "applicationType": C.one_of(APPLICATION_TYPES), "containerInfo": C.anything(), "applicationDate": C.text(),
        "applicantSignatureName": C.text(),
    }),
    "crossCheckExpectations": C.record({**dict.fromkeys(["brandName", "classType", "producer", "countryOfOrigin"], C.text()), **dict.fromkeys(["wineVarietal", "wineAppellation"], C.text(optional=True))}),
    "labelOnlyExpectations": C.record({"abv": C.text(), "netContents": C.text(), "governmentWarning": C.one_of(["PRESENT_AND_VERBATIM", "ABSENT"])}),
    "intentionalMismatches": C.listing(C.record(dict.fromkeys(["field", "expectedFromApplication", "appearsOnLabelAs", "rationale"], C.text())), optional=True),
    "notes": C.text(optional=True),
})


def parse_applications(lines: DataFrame, value: str = "value") -> DataFrame:
    """Application documents with ``problems`` (null: valid) in place of their JSON text, and the parsed ``application`` of valid ones."""
    rest = [c for c in lines.columns if c != value]
    rows = C.checked(lines, value, APPLICATION, "v_", "problems")
    return rows.select(*rest, "problems", F.when(F.col("problems").isNull(), F.col("v_")).alias("application"))


def read_applications(spark: SparkSession, path: str) -> DataFrame:
    """The application documents of a folder, a JSON document a file."""
    return parse_applications(spark.read.text(path, wholetext=True))


def flatten_blocks(pages: DataFrame) -> DataFrame:
    """Words of nested OCR output (blocks, paragraphs, lines, words), with the page's mean confidence, 0 without words."""
    rows = pages.select("doc_id", "page", F.flatten(F.transform("blocks", lambda b: F.flatten(F.transform(b["paragraphs"], lambda p: F.flatten(F.transform(p["lines"], lambda line: line["words"])))))).alias("w"))
    mean = F.when(F.size("w") > 0, F.round(F.aggregate("w", F.lit(0.0), lambda a, w: a + w["conf"]) / F.greatest(F.size("w"), F.lit(1)))).otherwise(0)
    # The mean stands below the generator: beside it, every word would carry its page's array and fold it again.
    rows = rows.select("doc_id", "page", mean.cast("int").alias("mean_confidence"), "w")
    return rows.select("doc_id", "page", "mean_confidence", F.posexplode_outer("w").alias("word_idx", "x")).select("doc_id", "page", "mean_confidence", "word_idx", "x.*")
