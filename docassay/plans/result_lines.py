"""Result lines for the registered queries: one for each event, with a fault in each of some residue classes of its id.

``VALUE`` runs on Spark and on DuckDB; ``PROBLEMS`` names the faults once more, for DuckDB.
"""

from __future__ import annotations

import json

from ..sources import results as S

_form = dict.fromkeys(["repId", "plantRegistryNumber", "source", "serialNumber"]) | {"productType": "@product"} | dict.fromkeys(["brandName", "fancifulName"])
_form |= {"applicant": dict.fromkeys(S.ADDRESS)} | dict.fromkeys(["mailingAddress", "formula", "grapeVarietals", "wineAppellation"]) | {"@phone": None}
_form |= dict.fromkeys(["email", "applicationType", "containerWording", "applicationDate", "applicantSignatureName"])
_label = dict.fromkeys(["brandName", "abv"]) | {"governmentWarning": {"text": "GOVERNMENT WARNING", "appearsAllCaps": True, "appearsBold": "@bold"}}
_label |= dict.fromkeys(["netContents", "classType", "producer", "countryOfOrigin", "wineVarietal", "wineAppellation"]) | {"extractionConfidence": "high"}
_word = {"text": "40 %", "confidence": 96.5, "bbox": {"x0": 1, "y0": 2, "x1": 30, "y1": 14}}
_cross = {"id": "@cross_id", "label": "Brand", "status": "match", "applicationValue": "A", "labelValue": None}
_report = {
    "overallStatus": "@verdict", "crossCheck": {"overallStatus": "@cross", "fields": {"@cross_key": _cross}}, "fields": {"brand": {"status": "@rule", "reason": "@reason", "extractedValue": None}, "abv": {"status": "pass"}},
    "provenance": {"@prov": {"page": "@prov_page", "bbox": {"x": 0.5, "y": "@y", "w": 1, "h": 0.25}, "confidence": "high"}, "label.brandName": None},
    "bboxes": {"label.abv": {"page": "@page", "source": "@source", "words": [_word, _word], "meanConfidence": "@mean"}}, "extractedForm": _form, "@label": _label, "pages": [{"pageNumber": 1, "kind": "form"}, {"pageNumber": "@number", "kind": "label"}],
}
_ok = {"status": "@status", "index": "@index", "filename": "@file", "durationMs": "@ms", "report": _report, "applicationId": "@app"}

_key = "case when event_id % 59 = 1 then 'nonsense' else 'brandName' end"
_prov = "case when event_id % 13 = 1 then 'label.colour' else 'label.abv' end"
_one_of = lambda values: "expected one of " + ", ".join(values)
#: Of each part that varies: its JSON, the JSON of its faults by condition, and the fault's message (SQL), in the order of the contract.
PARTS: list[tuple[str, str, list[tuple[str, str]], str]] = [
    ("@index", "' || event_id || '", [("event_id % 23 = 1", "-1"), ("event_id % 23 = 2", "1.5")], "'index: expected a whole number from 0'"),
    ("@file", '"f\' || (event_id % 700) || \'"', [("event_id % 89 = 0", "3")], "'filename: expected string'"),
    ("@ms", "' || (event_id % 900) || '", [("event_id % 47 = 1", '"5"')], "'durationMs: expected a number from 0'"),
    ("@verdict", "\"' || case event_id % 3 when 0 then 'compliant' when 1 then 'needs_review' else 'non_compliant' end || '\"", [("event_id % 29 = 1", '"fine"')], f"'report.overallStatus: {_one_of(S.VERDICTS)}'"),
    ("@cross", '"match"', [("event_id % 53 = 1", '"maybe"')], "'report.crossCheck.overallStatus: expected one of match, mismatch'"),
    ("@cross_key", f"\"' || {_key} || '\"", [], "case when event_id % 59 = 1 then 'report.crossCheck.fields: unknown key nonsense' end"),
    ("@cross_id", '"brandName"', [("event_id % 61 = 1", '"nonsense"')], f"'report.crossCheck.fields.' || {_key} || '.id: {_one_of(S.CROSS_FIELDS)}'"),
    ("@rule", '"pass"', [("event_id % 17 = 1", '"good"')], f"'report.fields.brand.status: {_one_of(S.RULE_STATUSES)}'"),
    ("@reason", '"why"', [("event_id % 67 = 1", "7")], "'report.fields.brand.reason: expected string'"),
    ("@prov", f"\"' || {_prov} || '\"", [], "case when event_id % 13 = 1 then 'report.provenance: unknown key label.colour' end"),
    ("@prov_page", "0", [("event_id % 11 = 1", "-1")], f"'report.provenance.' || {_prov} || '.page: expected a whole number from 0'"),
    ("@y", "0", [("event_id % 31 = 1", "1.5")], f"'report.provenance.' || {_prov} || '.bbox.y: expected a number from 0 to 1'"),
    ("@page", "1", [("event_id % 7 = 1", "0")], "'report.bboxes.label.abv.page: expected a whole number from 1'"),
    ("@source", '"pdf"', [("event_id % 37 = 1", '"scan"')], f"'report.bboxes.label.abv.source: {_one_of(S.BOX_SOURCES)}'"),
    ("@mean", "null", [("event_id % 41 = 1", "101")], "'report.bboxes.label.abv.meanConfidence: expected a number from 0 to 100'"),
    ("@product", '"WINE"', [("event_id % 71 = 1", '"CIDER"')], f"'report.extractedForm.productType: {_one_of(S.PRODUCT_TYPES)}'"),
    ("@phone", '"phone"', [("event_id % 43 = 2", '"fax"')], "'report.extractedForm.phone: required'"),
    ("@label", '"extractedLabel"', [("event_id % 73 = 1", '"other"')], "'report.extractedLabel: required'"),
    ("@bold", "null", [("event_id % 79 = 1", '"yes"')], "case when event_id % 73 <> 1 then 'report.extractedLabel.governmentWarning.appearsBold: expected boolean' end"),
    ("@number", "2", [("event_id % 83 = 1", "0")], "'report.pages.1.pageNumber: expected a whole number from 1'"),
    ("@app", '"0a1b2c3d-0000-4000-8000-0123456789ab"', [("event_id % 19 = 1", '"12-34"'), ("event_id % 19 = 2", "null")], "case when event_id % 19 = 1 then 'applicationId: expected uuid' end"),
    ("@status", '"ok"', [("event_id % 103 = 1", '"done"')], "''"),
]


def _filled() -> str:
    text = json.dumps(_ok)
    for name, good, faults, _ in PARTS:
        chosen = good if not faults else "' || case " + " ".join(f"when {when} then '{bad}'" for when, bad in faults) + f" else '{good}' end || '"
        text = text.replace(f'"{name}"', chosen)
    return f"'{text}'"


_error = """'{"status": "error", "index": ' || event_id || ', "filename": "f' || (event_id % 700) || '", "durationMs": ' || case when event_id % 4 = 1 then '-4' else '4' end || case when event_id % 9 = 1 then '' else ', "errorMessage": "failed ' || user_id || '"' end || '}'"""
VALUE = f"case when event_id % 101 = 0 then ' \t ' when event_id % 97 = 0 then substr({_filled()}, 1, 40) when event_type = 'error' then {_error} else {_filled()} end"
#: Both fail on their own: a line that is cut off, and one whose status is unknown, have no other problem.
_of_ok = ", ".join(f"case when {' or '.join(w for w, _ in faults) or 'true'} then {message} end" for name, _, faults, message in PARTS if name != "@status")
PROBLEMS = f"""case when event_id % 97 = 0 then '(root): not JSON'
 when event_type = 'error' then nullif(concat_ws('; ', case when event_id % 4 = 1 then 'durationMs: expected a number from 0' end, case when event_id % 9 = 1 then 'errorMessage: required' end), '')
 when event_id % 103 = 1 then 'status: expected one of ok, error' else nullif(concat_ws('; ', {_of_ok}), '') end"""
LINES = f"fx_ndjson as (select event_id, {VALUE} as value from events)"
PARSED = f"""{LINES}, pr as (select event_id, value, {PROBLEMS} as problems, event_id % 97 = 0 broken from fx_ndjson join (select event_id, event_type, user_id from events) using (event_id) where event_id % 101 <> 0),
j as (select event_id, value, problems, case when broken then 'parse-error' when problems is null then 'value' else 'schema-error' end kind, case when problems is null then value::json end v from pr)"""
