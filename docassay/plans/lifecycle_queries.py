"""Queries of sources, filters, the review queue and its history."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators import rules as R
from ..sources import results as S
from ..sources import snapshots as V
from ..sources.folders import scratch
from . import fixtures as X
from .result_lines import LINES, PARSED
from .text_queries import FX, RULED, _reasons, STATUS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
c = F.col


def add(name, make, sql=None):
    QUERIES[name] = make
    if sql:
        ORACLE_SQL[name] = sql


def documents(s, d):
    return X.table(s, d, "documents")


# --- sources and admission ---
add(
    "S1_raw_scan_hash",
    lambda s, d: documents(s, d).select("doc_id", F.octet_length("text").alias("byte_size"), *S.hashes(F.encode("text", "UTF-8"))),
    "select doc_id, strlen(text) as byte_size, sha256(text) as content_hash, sha256(text)[:16] as hash_prefix from documents",
)
UPLOADS = "fx_uploads as (select doc_id, source batch_id, n_chars * 1000 byte_size, case doc_id % 6 when 0 then 'application/pdf' when 1 then '' when 2 then 'image/png' when 3 then 'text/plain' when 4 then 'image/webp' else 'application/pdf' end mime, case when doc_id % 31 = 0 then null else 'f' || doc_id end file_name from documents)"
SMALL = UPLOADS.replace("source batch_id", "source || '-' || (doc_id % 4) batch_id")
uploads = lambda s, d, sql=UPLOADS: X.view(s, d, f"with {sql} select * from fx_uploads")
add(
    "S2_upload_admission",
    lambda s, d: uploads(s, d).select("doc_id", S.upload_problem().alias("reason")),
    f"with {UPLOADS} select doc_id, case when file_name is null then 'missing file' when mime <> '' and mime <> 'application/pdf' then 'only PDF files are accepted' when byte_size = 0 then 'the file is empty' when byte_size > {S.MOST_UPLOAD} then 'the file is too large' end as reason from fx_uploads",
)


def batches(sql):
    bad = f"(byte_size > {S.MOST_FILE} or mime not in ('{chr(39).join(S.ACCEPTED).replace(chr(39), chr(39) + ', ' + chr(39))}'))"
    return f"with {sql}, g as (select batch_id, count(*) n, count(*) filter (not {bad}) good from fx_uploads group by 1), l as (select batch_id from g union all select 'none-' || n_nationkey from nation) select l.batch_id, case when n is null then 'no files' when n > {S.MOST_BATCH} then 'too many files' when good = 0 then 'no valid files' end as reason, case when n <= {S.MOST_BATCH} then good else 0 end as accepted from l left join g using (batch_id)"


def admit(s, d, sql):
    files = uploads(s, d, sql)
    listed = files.select("batch_id").distinct().union(X.table(s, d, "nation").select(F.concat(F.lit("none-"), c("n_nationkey").cast("string"))))
    return S.admit_batches(files, listed)


add("S3_batch_admission", lambda s, d: admit(s, d, UPLOADS), batches(UPLOADS))
add("S3_batch_admission_small", lambda s, d: admit(s, d, SMALL), batches(SMALL))
lines = lambda s, d: X.view(s, d, f"with {LINES} select * from fx_ndjson")
_got = lambda path: f"json_extract_string(v, '$.{path}')"
add(
    "S5_result_lines_source",
    lambda s, d: S.parse_lines(lines(s, d)).withColumn("index", F.coalesce("index", F.lit(-1))).drop("report"),
    f"""with {PARSED} select event_id, kind, {_got('status')} as status, coalesce({_got('index')}::bigint, -1) as "index", {_got('filename')} as filename, {_got('durationMs')}::double as duration_ms, {_got('applicationId')} as application_id,
 {_got('report.overallStatus')} as overall_status, {_got('errorMessage')} as error_message, problems, case when problems is not null then value end as quarantined from j""",
)
add(
    "S5_last_lines",
    lambda s, d: S.last_lines(S.parse_lines(lines(s, d)), "index").select("filename", "index", "status", F.try_variant_get("report", "$.bboxes['label.abv'].words[1].text", "string").alias("word")),
    f"""with {PARSED}, o as (select {_got('filename')} filename, {_got('index')}::bigint i, v from j where kind = 'value') select filename, max(i) as "index", {_got('status').replace('(v,', '(arg_max(v, i),')} as status, {_got('report.bboxes."label.abv".words[1].text').replace('(v,', '(arg_max(v, i),')} as word from o group by 1""",
)
add("P6_result_contract_checks", lambda s, d: S.check_lines(lines(s, d)), f"with {PARSED} select event_id, problems from j")
add(
    "P6_kinds", lambda s, d: S.parse_lines(lines(s, d)).groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 3).alias("total_ms")),
    f"with {PARSED} select kind, count(*) as n, round(sum({_got('durationMs')}::double), 3) as total_ms from j group by kind",
)
add(
    "S6_result_lines_sink",
    lambda s, d: X.labels(s, d).select("doc_id", S.json_line("doc_id", "abv", "appears_bold", "country_of_origin").alias("line")),
    f"""with {FX} select doc_id, '{{"doc_id":' || doc_id || ',"abv":' || coalesce('"' || abv || '"', 'null') || ',"appears_bold":' || coalesce(appears_bold::varchar, 'null') || ',"country_of_origin":' || coalesce('"' || country_of_origin || '"', 'null') || '}}' as line from fx_labels""",
)


def report(s, d):
    labels = X.labels(s, d)
    results = labels.select(
        "doc_id", F.concat(F.lit('file "'), c("doc_id").cast("string"), F.lit('".pdf')).alias("filename"), F.when(c("doc_id") % 23 == 0, "error").otherwise("ok").alias("status"),
        F.when(c("doc_id") % 23 != 0, R.verdict_column(F.lit(False))).alias("overallStatus"), F.when(c("doc_id") % 23 == 0, "failed, twice").alias("errorMessage"), (c("doc_id") * 7 % 1000).alias("durationMs"),
    )
    return S.report_rows(results, R.rule_results(labels))


def report_written(s, d):
    path = scratch(s, "report") + "/csv"
    S.write_csv(report(s, d), path)
    return S.read_csv_lines(s, path).select(F.col("value").alias("line"))


_of = {"brand": "R1_rule_brand", "abv": "R2_rule_abv", "governmentWarning": "R3_rule_government_warning", "netContents": "R4_rule_net_contents", "classType": "R5_rule_class_type", "producerOrigin": "R6_rule_producer_origin"}
_cells = {f"{k}Status": f"st_{k}" for k in _of} | {f"{k}Value": f"va_{k}" for k in _of} | {"governmentWarningReason": "re_governmentWarning"}
REPORT = f"""{FX}, {RULED}, tests as (select doc_id, {', '.join(f"{STATUS_SQL[k]} as st_{k}, {_reasons[n][2]} as re_{k}, {_reasons[n][3]} as va_{k}" for k, n in _of.items())} from pre),
rv as (select doc_id, case when bool_or(rule_id = 'governmentWarning' and status = 'fail') then 'non_compliant' when bool_or(status in ('warn', 'fail')) then 'needs_review' else 'compliant' end verdict from ruled group by doc_id),
rep as (select doc_id, 'file "' || doc_id || '".pdf' as filename, case when doc_id % 23 = 0 then 'error' else 'ok' end as status, case when doc_id % 23 <> 0 then verdict end as "overallStatus", {', '.join(f'case when doc_id % 23 <> 0 then {_cells[k]} end as "{k}"' for k in S.CSV_COLUMNS[3:15])}, case when doc_id % 23 = 0 then 'failed, twice' end as "errorMessage", doc_id * 7 % 1000 as "durationMs" from tests join rv using (doc_id))"""
_csv = lambda v: f"""case when regexp_matches(coalesce({v}::varchar, ''), '[",\\r\\n]') then '"' || replace({v}::varchar, '"', '""') || '"' else coalesce({v}::varchar, '') end"""
_json = lambda k: f"""'"{k}":' || coalesce({'"' + k + '"::varchar' if k == 'durationMs' else 'to_json("' + k + '")::varchar'}, 'null')"""
add("S7_report_csv_sink", report_written, f"with {REPORT} select " + " || ',' || ".join(_csv(f'"{k}"') for k in S.CSV_COLUMNS) + " as line from rep")
add("S8_report_json_sink", lambda s, d: report(s, d).select("doc_id", S.json_line(*S.CSV_COLUMNS).alias("line")), f"with {REPORT} select doc_id, '{{' || " + " || ',' || ".join(_json(k) for k in S.CSV_COLUMNS) + " || '}' as line from rep")

# --- verified applications, reviews and archive requests ---
VERDICTS = f"{FX}, {RULED}, vd as (select doc_id, case when bool_or(rule_id = 'governmentWarning' and status = 'fail') then 'non_compliant' when bool_or(status in ('warn', 'fail')) then 'needs_review' else 'compliant' end verdict from ruled group by doc_id)"
APPS = f"{VERDICTS}, apps as (select p_partkey app_id, p_name brand_name, vd.verdict, ts created_at, sha256(p_name || '|' || p_brand) content_hash, p_size * 1000 byte_size, case when p_partkey % 5 = 0 then null else p_name end pdf_bytes, 'p' || (p_partkey % 2) prompt_version, 'm' || (p_partkey % 3) extractor_model from vd join part on p_partkey = vd.doc_id join events on event_id = p_partkey)"
REVIEWS = "reviews as (select event_id review_id, user_id * 3 app_id, case event_type when 'purchase' then 'approved' when 'error' then 'rejected' else 'maybe' end decision, case when event_id % 5 = 0 then null else 'reason ' || event_id end reason, case when event_id % 53 = 0 then repeat('n', 60) else 'r' || (user_id % 7) end reviewer, ts from events where event_type in ('purchase', 'error') or event_id % 40 = 1)"
ARCHIVES = "archives as (select event_id, user_id * 3 app_id, ts from events where event_type = 'signup' and event_id % 29 = 0)"
_problem = f"case when a.app_id is null then 'unknown application' when decision not in ('approved', 'rejected') then 'unknown decision' when decision = 'rejected' and coalesce(trim(reason), '') = '' then 'a rejection needs a reason' when length(reviewer) > {L.MOST_REVIEWER} then 'reviewer too long' when length(reason) > {L.MOST_REASON} then 'reason too long' end"
STATE = f"""{APPS}, {REVIEWS}, {ARCHIVES}, r1 as (select r.*, {_problem} p1 from reviews r left join apps a using (app_id)),
lock_ as (select x.app_id, min(x.ts) archived_at from archives x join (select app_id, min(ts) t from r1 where p1 is null group by 1) f on f.app_id = x.app_id and x.ts > f.t group by 1),
judged as (select r1.* exclude (p1), case when p1 is null and r1.ts >= archived_at then 'archived' else p1 end problem from r1 left join lock_ using (app_id)),
last_ as (select app_id, arg_max(decision, {{'a': ts, 'b': review_id}}) decision, max(ts) decided_at from judged where problem is null group by 1),
state as (select apps.*, coalesce(decision, case verdict when 'non_compliant' then 'pending_rejection' else 'pending_approval' end) status, coalesce(decided_at, created_at) status_at, archived_at from apps left join last_ using (app_id) left join lock_ using (app_id))"""


def apps(s, d):
    part, events = X.table(s, d, "part"), X.table(s, d, "events").select(c("event_id"), c("ts").alias("created_at"))
    verdicts = X.labels(s, d).select("doc_id", R.verdict_column(F.lit(False)).alias("verdict"))
    rows = verdicts.join(part, c("p_partkey") == c("doc_id")).join(events, c("event_id") == c("p_partkey"))
    return rows.select(
        c("p_partkey").alias("app_id"), c("p_name").alias("brand_name"), "verdict", "created_at", F.sha2(F.concat_ws("|", "p_name", "p_brand"), 256).alias("content_hash"), (c("p_size") * 1000).alias("byte_size"),
        F.when(c("p_partkey") % 5 != 0, c("p_name")).alias("pdf_bytes"), F.concat(F.lit("p"), (c("p_partkey") % 2).cast("string")).alias("prompt_version"), F.concat(F.lit("m"), (c("p_partkey") % 3).cast("string")).alias("extractor_model"),
    )


def reviews(s, d):
    return X.view(s, d, f"with {REVIEWS} select * from reviews")


def archives(s, d):
    return X.view(s, d, f"with {ARCHIVES} select * from archives")


def state(s, d):
    return L.current_state(apps(s, d), reviews(s, d), archives(s, d))


add("P1_summary_projection", lambda s, d: apps(s, d).select("app_id", "brand_name", "verdict", "created_at", "content_hash", "byte_size", c("pdf_bytes").isNotNull().alias("has_pdf_bytes")), f"with {APPS} select app_id, brand_name, verdict, created_at, content_hash, byte_size, pdf_bytes is not null as has_pdf_bytes from apps")
add("P2_point_lookup", lambda s, d: apps(s, d).where("app_id = 42").limit(1).select("app_id", "brand_name", "verdict"), f"with {APPS} select app_id, brand_name, verdict from apps where app_id = 42")
add("P3_status_archived_filter", lambda s, d: state(s, d).where(L.status_filter(L.FINAL, True)).select("app_id", "status"), f"with {STATE} select app_id, status from state where status in ('approved', 'rejected') and archived_at is not null")
add("P4_archive_view", lambda s, d: L.newest(state(s, d).where(L.status_filter(["approved"], True)), "created_at", 200).select("app_id", "status", "created_at"), f"with {STATE} select app_id, status, created_at from state where status = 'approved' and archived_at is not null order by created_at desc, app_id limit 200")


def violations(s, d):
    verdict = F.when(c("app_id") % 97 == 0, "maybe").otherwise(c("verdict"))
    status = F.when(c("app_id") % 89 == 0, "open").when(c("app_id") % 83 != 0, R.initial_status(c("verdict")))
    rows = apps(s, d).select("app_id", verdict.alias("verdict"), status.alias("status"))
    return L.domain_violations(rows, "applications", "app_id", {"verdict": L.VERDICTS, "status": L.STATUSES}).unionByName(L.domain_violations(reviews(s, d), "reviews", "review_id", {"decision": L.FINAL}))


add(
    "P5_domain_constraints", violations,
    f"with {APPS}, {REVIEWS} select 'applications' as table_name, app_id as id, 'verdict' as column_name, 'maybe' as value from apps where app_id % 97 = 0 union all select 'applications', app_id, 'status', 'open' from apps where app_id % 89 = 0 union all select 'reviews', review_id, 'decision', decision from reviews where decision not in ('approved', 'rejected')",
)
add("W1_latest_review", lambda s, d: reviews(s, d).groupBy("app_id").agg(F.max_by("decision", F.struct("ts", "review_id")).alias("decision"), F.max("ts").alias("decided_at")), f"with {REVIEWS} select app_id, arg_max(decision, {{'a': ts, 'b': review_id}}) as decision, max(ts) as decided_at from reviews group by 1")


def history(s, d):
    from pyspark.sql import Window

    return reviews(s, d).select("app_id", "review_id", "decision", F.row_number().over(Window.partitionBy("app_id").orderBy(c("ts").desc(), c("review_id").desc())).alias("place"))


add("W2_review_history", history, f"with {REVIEWS} select app_id, review_id, decision, row_number() over (partition by app_id order by ts desc, review_id desc) as place from reviews")
add("J8_review_join", lambda s, d: apps(s, d).select("app_id", "brand_name").join(reviews(s, d), "app_id", "left").select("app_id", "brand_name", "review_id", "decision"), f"with {APPS}, {REVIEWS} select app_id, brand_name, review_id, decision from apps left join reviews using (app_id)")
add("J8_orphan_reviews", lambda s, d: reviews(s, d).join(apps(s, d).where("app_id % 9 <> 0"), "app_id", "left_anti").select("review_id", "app_id"), f"with {APPS}, {REVIEWS} select review_id, app_id from reviews where app_id not in (select app_id from apps where app_id % 9 <> 0)")
add("L1_insert_verification", lambda s, d: apps(s, d).select("app_id", "verdict", R.initial_status(c("verdict")).alias("status"), "created_at"), f"with {APPS} select app_id, verdict, case verdict when 'non_compliant' then 'pending_rejection' else 'pending_approval' end as status, created_at from apps")
add("L2_finalize", lambda s, d: L.judged_reviews(apps(s, d), reviews(s, d), archives(s, d)).select("review_id", "app_id", "decision", "problem"), f"with {STATE} select review_id, app_id, decision, problem from judged")
add("L5_review_state_view", lambda s, d: state(s, d).select("app_id", "status", "status_at", "archived_at"), f"with {STATE} select app_id, status, status_at, archived_at from state")
# Seven requests: one without ids, three of every row (too many in larger tables), three of every other row.
_asked = lambda s, d: apps(s, d).select((c("app_id") % 7).alias("request_id"), F.when(c("app_id") % 7 != 6, c("app_id")).alias("app_id")).where("app_id is null or request_id < 3 or app_id % 2 = 0")
ASKED = "asked as (select * from (select app_id % 7 request_id, case when app_id % 7 <> 6 then app_id end app_id from apps) where app_id is null or request_id < 3 or app_id % 2 = 0), rq as (select request_id, count(distinct app_id) ids from asked group by 1)"
add(
    "L3_archive",
    lambda s, d: L.archived_by(state(s, d), _asked(s, d)),
    f"with {STATE}, {ASKED} select app_id from state where status in ('approved', 'rejected') and archived_at is null and app_id in (select app_id from asked join rq using (request_id) where ids between 1 and {L.MOST_ARCHIVED} and app_id is not null)",
)
add(
    "L3_archive_requests",
    lambda s, d: L.archive_requests(state(s, d), _asked(s, d)),
    f"with {STATE}, {ASKED}, mv as (select request_id, count(distinct s.app_id) n from asked a join state s on s.app_id = a.app_id where status in ('approved', 'rejected') and archived_at is null group by 1) select request_id, ids, case when ids between 1 and {L.MOST_ARCHIVED} then coalesce(n, 0) else 0 end as moved, case when ids = 0 then 'no ids' when ids > {L.MOST_ARCHIVED} then 'too many ids' end as problem from rq left join mv using (request_id)",
)


def stored(s, d):
    """Applications and reviews as the first version of a folder."""
    path = scratch(s, "snapshots") + "/queue"
    V.write(s, path, {"apps": apps(s, d).drop("pdf_bytes"), "reviews": reviews(s, d)})
    return path


def deleted_by_hash(s, d):
    path = stored(s, d)
    V.delete_by_hash(s, path, V.read(s, path)["apps"].where("app_id % 10 = 0").select("content_hash"))
    return V.read(s, path)["reviews"].groupBy("app_id").agg(F.count("*").alias("n"))


def deleted_recent(s, d):
    path = stored(s, d)
    V.delete_recent(s, path, 25)
    return V.read(s, path)["apps"].select("app_id")


add("L4_delete_by_hash", deleted_by_hash, f"with {APPS}, {REVIEWS} select app_id, count(*) as n from reviews where app_id in (select app_id from apps where content_hash not in (select content_hash from apps where app_id % 10 = 0)) group by 1")
add("L4_delete_recent", deleted_recent, f"with {APPS} select app_id from apps where app_id not in (select app_id from apps order by created_at desc, app_id limit 25)")
add("A1_count_by_status", lambda s, d: apps(s, d).agg(F.count_if(c("verdict") == "compliant").alias("compliant"), F.count_if(c("verdict").isin("needs_review", "non_compliant")).alias("needs_review"), F.count_if(c("verdict").isNull()).alias("errors")), f"with {APPS} select count(*) filter (verdict = 'compliant') as compliant, count(*) filter (verdict in ('needs_review', 'non_compliant')) as needs_review, count(*) filter (verdict is null) as errors from apps")
add("A2_queue_bucket_counts", lambda s, d: L.queue_counts(state(s, d)), f"with {STATE} select count(*) filter (status = 'pending_approval') as pending_approval, count(*) filter (status = 'pending_rejection') as pending_rejection, count(*) filter (status in ('approved', 'rejected')) as finalized from state where archived_at is null")
for _name, _by, _n, _spark, _sql in [
    ("K2_queue_page", "created_at", 100, lambda rows: rows.where(L.status_filter(["pending_approval"], False)), "status = 'pending_approval' and archived_at is null"),
    ("K3_finalized_page", "status_at", 100, lambda rows: rows.where(L.status_filter(L.FINAL, False)), "status in ('approved', 'rejected') and archived_at is null"),
]:
    add(_name, lambda s, d, by=_by, n=_n, f=_spark: L.newest(f(state(s, d)), by, n).select("app_id", "status", by), f"with {STATE} select app_id, status, {_by} from state where {_sql} order by {_by} desc, app_id limit {_n}")
for _name, _n in [("K1_recent_applications", 50), ("K4_recent_n", 5)]:
    add(_name, lambda s, d, n=_n: L.newest_states(apps(s, d), reviews(s, d), archives(s, d), "created_at", n).select("app_id", "status", "created_at"), f"with {STATE} select app_id, status, created_at from state order by created_at desc, app_id limit {_n}")
RUNS = "runs as (select doc_id, sha256(text) content_hash, 'p' || (doc_id % 2) prompt_version, 'm' || (doc_id % 3) extractor_model from documents)"
_runs = lambda s, d: documents(s, d).select("doc_id", F.sha2("text", 256).alias("content_hash"), F.concat(F.lit("p"), (c("doc_id") % 2).cast("string")).alias("prompt_version"), F.concat(F.lit("m"), (c("doc_id") % 3).cast("string")).alias("extractor_model"))
KEY = ["content_hash", "prompt_version", "extractor_model"]
add("J7_run_cache_hits", lambda s, d: L.split_by_cache(_runs(s, d).where("doc_id % 4 <> 0"), _runs(s, d).where("doc_id % 4 = 0"), KEY, ["doc_id"])[0].select("doc_id"), f"with {RUNS} select doc_id from runs r where doc_id % 4 <> 0 and exists (select 1 from runs v where v.doc_id % 4 = 0 and v.content_hash = r.content_hash and v.prompt_version = r.prompt_version and v.extractor_model = r.extractor_model)")
add("J7_run_cache", lambda s, d: L.split_by_cache(_runs(s, d).where("doc_id % 4 <> 0"), _runs(s, d).where("doc_id % 4 = 0"), KEY, ["doc_id"])[1].select("doc_id", "content_hash"), f"with {RUNS} select min(doc_id) as doc_id, content_hash from runs r where doc_id % 4 <> 0 and not exists (select 1 from runs v where v.doc_id % 4 = 0 and v.content_hash = r.content_hash and v.prompt_version = r.prompt_version and v.extractor_model = r.extractor_model) group by content_hash, prompt_version, extractor_model")


def verified(s, d):
    """Two batches that share keys, the first of them replayed."""
    path = scratch(s, "verified") + "/table"
    brand = F.when(c("app_id") % 6 != 0, c("brand_name"))
    rows = apps(s, d).withColumns({"form_brand": brand, "label_brand": F.upper("brand_name"), "content_hash": F.sha2(F.concat(c("brand_name"), (c("app_id") % 7).cast("string")), 256)})
    rows = S.verification_rows(rows.select("app_id", "content_hash", "verdict", "form_brand", "label_brand"))
    for batch, part in ((0, rows.where("app_id % 3 <> 0")), (1, rows.where("app_id % 2 = 0")), (0, rows.where("app_id % 3 <> 0"))):
        S.append_verified(part, path, batch)
    return S.read_verified(s, path)


add(
    "S9_verification_sink", verified,
    f"with {APPS}, v as (select app_id, sha256(brand_name || (app_id % 7)) content_hash, verdict, case verdict when 'non_compliant' then 'pending_rejection' else 'pending_approval' end status, case when app_id % 6 <> 0 then brand_name else upper(brand_name) end brand_name, case when app_id % 3 <> 0 then 0 else 1 end batch from apps where app_id % 3 <> 0 or app_id % 2 = 0), f as (select *, row_number() over (partition by content_hash order by batch, app_id) k from v) select app_id, content_hash, verdict, brand_name, status from f where k = 1",
)
