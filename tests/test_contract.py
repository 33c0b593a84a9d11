"""Result lines and applications under their contracts, as rows and as a stream."""

import copy
import json

from docassay.sources import contract as C
from docassay.sources import results
from docassay.streaming import streams
from pyspark.sql import functions as F

BOX = {"page": 1, "source": "pdf", "words": [{"text": "a", "confidence": 90, "bbox": {"x0": 1, "y0": 2.5, "x1": 3, "y1": 4}}], "meanConfidence": None}
FORM = dict.fromkeys(["repId", "plantRegistryNumber", "source", "serialNumber", "productType", "brandName", "fancifulName", "mailingAddress", "formula", "grapeVarietals", "wineAppellation"])
FORM |= dict.fromkeys(["phone", "email", "applicationType", "containerWording", "applicationDate", "applicantSignatureName"]) | {"applicant": dict.fromkeys(results.ADDRESS)}
LABEL = dict.fromkeys(["brandName", "abv", "netContents", "classType", "producer", "countryOfOrigin", "wineVarietal", "wineAppellation"])
LABEL |= {"governmentWarning": {"text": None, "appearsAllCaps": None, "appearsBold": None}, "extractionConfidence": "high"}
CROSS = {"id": "brandName", "label": "Brand name", "status": "match", "applicationValue": "A", "labelValue": None}
REPORT = {
    "overallStatus": "compliant", "crossCheck": {"overallStatus": "match", "fields": {"brandName": CROSS}}, "fields": {"brand": {"status": "pass", "extractedValue": "A"}},
    "provenance": {"label.abv": {"page": 0, "bbox": {"x": 0, "y": 0.1, "w": 1, "h": 0.5}, "confidence": "high"}, "label.brandName": None}, "extractedForm": FORM, "extractedLabel": LABEL,
    "bboxes": {"label.abv": BOX}, "pages": [{"pageNumber": 1, "kind": "front"}],
}
OK = {"status": "ok", "index": 0, "filename": "f", "durationMs": 1.5, "applicationId": None, "report": REPORT}
ERROR = {"status": "error", "index": 1, "filename": "g", "durationMs": 0, "errorMessage": "x"}
GONE = object()


def changed(path, value, base=OK):
    out = copy.deepcopy(base)
    *way, last = path
    at = out
    for k in way:
        at = at[k]
    if value is GONE:
        del at[last]
    else:
        at[last] = value
    return out


def in_report(*path_and_value):
    *path, value = path_and_value
    return changed(["report", *path], value)


def test_result_lines(spark):
    label = ["bboxes", "label.abv"]
    cases = [
        (OK, None), (ERROR, None), (changed(["applicationId"], GONE), None), (changed(["applicationId"], "0a1b2c3d-0000-4000-8000-0123456789ab"), None), (changed(["more"], 3), None),
        (in_report("crossCheck", GONE), None), (in_report("bboxes", GONE), None), (in_report("pages", GONE), None), (in_report("provenance", {}), None), (in_report("fields", {}), None),
        (changed(["index"], 1.0), None),
        (changed(["errorMessage"], GONE, ERROR), "errorMessage: required"), (changed(["status"], "done"), "status: expected one of ok, error"), (changed(["status"], GONE), "status: expected one of ok, error"),
        ([1], "(root): expected object"), ("text", "(root): expected object"), (None, "(root): expected object"),
        (changed(["index"], 1.5), "index: expected a whole number from 0"), (changed(["index"], -1), "index: expected a whole number from 0"), (changed(["durationMs"], "5"), "durationMs: expected a number from 0"),
        (changed(["filename"], 3), "filename: expected string"), (changed(["filename"], None), "filename: expected string"), (changed(["applicationId"], "nope"), "applicationId: expected uuid"),
        (changed(["report"], GONE), "report: required"), (changed(["report"], []), "report: expected object"), (in_report("overallStatus", "fine"), "report.overallStatus: expected one of compliant, needs_review, non_compliant"),
        (in_report("crossCheck", None), "report.crossCheck: expected object"), (in_report("crossCheck", "overallStatus", "maybe"), "report.crossCheck.overallStatus: expected one of match, mismatch"),
        (in_report("crossCheck", "fields", {"bogus": {**CROSS, "id": "brandName"}}), "report.crossCheck.fields: unknown key bogus"), (in_report("crossCheck", "fields", "brandName", "label", 4), "report.crossCheck.fields.brandName.label: expected string"),
        (in_report("crossCheck", "fields", "brandName", "labelValue", GONE), "report.crossCheck.fields.brandName.labelValue: required"),
        (in_report("fields", None), "report.fields: expected object"), (in_report("fields", "brand", "status", "good"), "report.fields.brand.status: expected one of pass, warn, fail, uncertain"),
        (in_report("fields", "brand", "reason", 3), "report.fields.brand.reason: expected string"), (in_report("fields", "brand", "extractedValue", False), "report.fields.brand.extractedValue: expected string"),
        (in_report("provenance", GONE), "report.provenance: required"), (in_report("provenance", "foo", None), "report.provenance: unknown key foo"),
        (in_report("provenance", "label.abv", "bbox", "x", 1.5), "report.provenance.label.abv.bbox.x: expected a number from 0 to 1"), (in_report("provenance", "label.abv", "confidence", "sure"), "report.provenance.label.abv.confidence: expected one of high, medium, low"),
        (in_report(*label, "page", 0), "report.bboxes.label.abv.page: expected a whole number from 1"), (in_report(*label, "words", 0, "confidence", 101), "report.bboxes.label.abv.words.0.confidence: expected a number from 0 to 100"),
        (in_report(*label, "words", None), "report.bboxes.label.abv.words: expected array"), (in_report(*label, "source", "scan"), "report.bboxes.label.abv.source: expected one of pdf, tesseract, vlm"),
        (in_report("bboxes", "label.colour", BOX), "report.bboxes: unknown key label.colour"), (in_report("bboxes", "label.abv", None), "report.bboxes.label.abv: expected object"),
        (in_report("extractedForm", "phone", GONE), "report.extractedForm.phone: required"), (in_report("extractedForm", "source", "Elsewhere"), "report.extractedForm.source: expected one of Domestic, Imported"),
        (in_report("extractedForm", "applicant", None), "report.extractedForm.applicant: expected object"), (in_report("extractedLabel", GONE), "report.extractedLabel: required"),
        (in_report("extractedLabel", "governmentWarning", "appearsBold", "yes"), "report.extractedLabel.governmentWarning.appearsBold: expected boolean"),
        (in_report("extractedLabel", "extractionConfidence", None), "report.extractedLabel.extractionConfidence: expected one of high, medium, low"), (in_report("pages", 0, "pageNumber", 0), "report.pages.0.pageNumber: expected a whole number from 1"),
        (changed(["index"], None, in_report("pages", 3)), "index: expected a whole number from 0; report.pages: expected array"),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)] + [(100, "{bad"), (101, " \t "), (102, ""), (103, None)], "i int, value string")
    rows = {r.i: r for r in results.parse_lines(df).collect()}
    assert {r.i: r.problems for r in results.check_lines(df).collect()} == {i: r.problems for i, r in rows.items()}
    broken = rows.pop(100)
    assert (broken.kind, broken.problems, broken.quarantined) == ("parse-error", "(root): not JSON", "{bad") and len(rows) == len(cases)
    for i, (line, want) in enumerate(cases):
        r = rows[i]
        assert r.problems == want, (i, r.problems, want)
        assert r.kind == ("value" if want is None else "schema-error") and (r.quarantined is None) == (want is None)
        assert want is not None or (r.status, r.filename, r.duration_ms) == (line["status"], line["filename"], line["durationMs"])
    assert rows[0].overall_status == "compliant" and json.loads(str(rows[0].report))["pages"] == REPORT["pages"] and rows[1].error_message == "x"


def test_the_last_valid_line_of_a_file_counts(spark):
    lines = [{**ERROR, "index": 1}, {**OK, "index": 2, "filename": "g"}, {**OK, "index": 3, "filename": "g", "durationMs": -1}, {**OK, "index": 0}]
    rows = results.last_lines(results.parse_lines(spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")), "index").collect()
    assert {(r.filename, r["index"], r.status) for r in rows} == {("g", 2, "ok"), ("f", 0, "ok")}


def test_a_contract_of_ones_own(spark):
    own = C.record({"a": C.text(optional=True), "b": C.listing(C.mapping(C.number(most=3)))})
    rows = [('{"b": [{"x": 1}, {"y": 4, "z": null}]}', "b.1.y: expected a number to 3; b.1.z: expected a number to 3"), ('{"a": null, "b": []}', "a: expected string"), ('{"a": "x"}', "b: required"), ("7", "(root): expected object")]
    df = spark.createDataFrame(rows, "value string, want string")
    assert [r.found == r.want for r in C.checked(df, "value", own, "v", "found").collect()] == [True] * 4


def test_applications(spark):
    address = dict.fromkeys(results.ADDRESS, "x")
    form = dict.fromkeys(["plantRegistryNumber", "serialNumber", "brandName", "phone", "email", "applicationDate", "applicantSignatureName"], "x")
    form |= {"repId": None, "source": "Domestic", "productType": "WINE", "fancifulName": None, "applicant": address, "mailingAddress": None, "formulaId": None, "grapeVarietals": None, "wineAppellation": None}
    form |= {"applicationType": "CERTIFICATE_OF_EXEMPTION", "containerInfo": {"any": 1}}
    ok = {"ttbFormId": "f", "formRevision": "r", "scenarioId": "s", "expectedVerdict": "COMPLIANT", "form": form, "labelOnlyExpectations": {"abv": "", "netContents": "", "governmentWarning": "ABSENT"}}
    ok |= {"crossCheckExpectations": dict.fromkeys(["brandName", "classType", "producer", "countryOfOrigin"], "x")}
    mismatch = dict.fromkeys(["field", "expectedFromApplication", "appearsOnLabelAs", "rationale"], "x")
    cases = [
        (ok, None), ({**ok, "intentionalMismatches": [mismatch]}, None), ({**ok, "intentionalMismatches": []}, None), ({**ok, "notes": 3}, "notes: expected string"),
        ({**ok, "intentionalMismatches": [mismatch, {"field": 3}]}, "intentionalMismatches.1.field: expected string; intentionalMismatches.1.expectedFromApplication: required; intentionalMismatches.1.appearsOnLabelAs: required; intentionalMismatches.1.rationale: required"),
        ({**ok, "intentionalMismatches": None}, "intentionalMismatches: expected array"), (changed(["crossCheckExpectations"], GONE, ok), "crossCheckExpectations: required"),
        (changed(["form", "containerInfo"], GONE, ok), None), (changed(["form", "mailingAddress"], {"name": "x"}, ok), "; ".join(f"form.mailingAddress.{k}: required" for k in results.ADDRESS[1:])),
        (changed(["form", "mailingAddress"], GONE, ok), "form.mailingAddress: required"), (changed(["form", "applicant"], "x", ok), "form.applicant: expected object"),
    ]
    df = spark.createDataFrame([(i, json.dumps(x)) for i, (x, _) in enumerate(cases)], "i int, value string")
    got = {r.i: (r.problems, r.application is not None) for r in results.parse_applications(df).collect()}
    assert got == {i: (want, want is None) for i, (_, want) in enumerate(cases)}


def test_streamed_lines_go_to_two_tables_and_a_restart_adds_nothing(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [json.dumps(OK), "", '{"broken', json.dumps({"filename": 3}), json.dumps(ERROR)]
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    for _ in range(2):
        streams.drain(streams.result_lines(spark.readStream.text(str(tmp_path / "in")), str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "log")))
    assert sorted(r.filename for r in spark.read.parquet(str(tmp_path / "good")).collect()) == ["f", "g"]
    bad = spark.read.parquet(str(tmp_path / "bad"))
    assert sorted((r.kind, r.problems) for r in bad.collect()) == [("parse-error", "(root): not JSON"), ("schema-error", "status: expected one of ok, error")]
    assert bad.where(F.col("quarantined").isNull()).isEmpty()
