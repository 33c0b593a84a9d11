"""The review queue as event tables: what is pending, finalised and archived follows from events, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import initial_status

VERDICTS = ["compliant", "needs_review", "non_compliant"]
STATUSES = ["pending_approval", "pending_rejection", "approved", "rejected"]
FINAL = ["approved", "rejected"]
MOST_REVIEWER, MOST_REASON, MOST_ARCHIVED = 50, 2000, 200


def review_problem(known: Column) -> Column:
    """Why a review is refused by itself, or null. ``known``: the application exists."""
    return (
        F.when(~known, "unknown application")
        .when(~F.col("decision").isin(FINAL) | F.col("decision").isNull(), "unknown decision")
        .when((F.col("decision") == "rejected") & (F.coalesce(F.trim("reason"), F.lit("")) == ""), "a rejection needs a reason")
        .when(F.length("reviewer") > MOST_REVIEWER, "reviewer too long")
        .when(F.length("reason") > MOST_REASON, "reason too long")
    )


def judged_reviews(apps: DataFrame, reviews: DataFrame, archives: DataFrame) -> DataFrame:
    """Reviews with ``problem`` (null: accepted). An application is archived by the first archive event after its
    first valid review; reviews from then on are refused."""
    ids = apps.select(F.col("app_id").alias("known_id"))
    rows = reviews.join(ids, F.col("app_id") == F.col("known_id"), "left").withColumn("problem", review_problem(F.col("known_id").isNotNull())).drop("known_id")
    locks = archive_times(rows.where("problem is null"), archives)
    rows = rows.join(locks.withColumnRenamed("app_id", "lock_id"), F.col("app_id") == F.col("lock_id"), "left")
    late = F.col("problem").isNull() & (F.col("ts") >= F.col("archived_at"))
    return rows.withColumn("problem", F.when(late, "archived").otherwise(F.col("problem"))).drop("lock_id", "archived_at")


def archive_times(valid: DataFrame, archives: DataFrame) -> DataFrame:
    """app_id, archived_at: the first archive event of each application that comes after a valid review."""
    first = valid.groupBy(F.col("app_id").alias("first_id")).agg(F.min("ts").alias("first_ts"))
    return archives.join(first, (F.col("app_id") == F.col("first_id")) & (F.col("ts") > F.col("first_ts"))).groupBy("app_id").agg(F.min("ts").alias("archived_at"))


def current_state(apps: DataFrame, reviews: DataFrame, archives: DataFrame) -> DataFrame:
    """``apps`` with status, status_at and archived_at: the newest accepted review decides, later ids among equal times.

    A review that is valid by itself is accepted unless the archive event that locks its application came before; those of unknown applications meet no row of ``apps``.
    """
    valid = reviews.withColumn("problem", review_problem(F.lit(True))).where("problem is null")
    locks = archive_times(valid, archives).withColumnRenamed("app_id", "lock_id")
    rows = valid.join(locks, F.col("app_id") == F.col("lock_id"), "left").where("archived_at is null or ts < archived_at")
    last = rows.groupBy(F.col("app_id").alias("last_id")).agg(F.max_by("decision", F.struct("ts", "review_id")).alias("decision"), F.max("ts").alias("decided_at"), F.max("archived_at").alias("archived_at"))
    found = apps.join(last, F.col("app_id") == F.col("last_id"), "left")  # a lock comes after a review that counts, so it is here
    return found.withColumns({"status": F.coalesce("decision", initial_status(F.col("verdict"))), "status_at": F.coalesce("decided_at", "created_at")}).drop("decision", "decided_at", "last_id")


def newest_states(apps: DataFrame, reviews: DataFrame, archives: DataFrame, by: str, limit: int) -> DataFrame:
    """The state of the ``limit`` applications that are newest by a column of ``apps``: their ids are picked first, and only their events are read."""
    ids = [r.app_id for r in newest(apps, by, limit).select("app_id").collect()]  # limit rows
    own = F.col("app_id").isin(ids)
    return newest(current_state(apps.where(own), reviews.where(own), archives.where(own)), by, limit)


def status_filter(statuses: list[str], archived: bool | None) -> Column:
    """Rows of the given statuses; archived ones only, others only, or (None) both. No status: no row."""
    if not statuses:
        return F.lit(False)
    own = F.col("status").isin(statuses)
    return own if archived is None else own & (F.col("archived_at").isNotNull() if archived else F.col("archived_at").isNull())


def newest(rows: DataFrame, by: str, limit: int) -> DataFrame:
    """The ``limit`` newest rows, smaller ids first among equal times."""
    return rows.orderBy(F.col(by).desc(), F.col("app_id")).limit(limit)


def queue_counts(state: DataFrame) -> DataFrame:
    """One row of counts of what is not archived."""
    rows = state.where("archived_at is null")
    return rows.agg(F.count_if(F.col("status") == "pending_approval").alias("pending_approval"), F.count_if(F.col("status") == "pending_rejection").alias("pending_rejection"), F.count_if(F.col("status").isin(FINAL)).alias("finalized"))


def archive_requests(state: DataFrame, requests: DataFrame) -> DataFrame:
    """request_id, ids, moved and problem of each request (request_id, app_id): one that names none or more than MOST_ARCHIVED different rows is refused.

    Of the others those rows move that are finalised and not archived; asking again moves nothing.
    """
    named = requests.where("app_id is not null").distinct().withColumnRenamed("app_id", "wanted_")
    open_ = state.where(status_filter(FINAL, False)).select("app_id", F.lit(1).alias("open_"))
    found = named.join(open_, F.col("wanted_") == F.col("app_id"), "left").groupBy("request_id").agg(F.count("*").alias("ids"), F.count("open_").alias("moves"))
    rows = requests.select("request_id").distinct().join(found, "request_id", "left").withColumn("ids", F.coalesce("ids", F.lit(0)))
    problem = F.when(F.col("ids") == 0, "no ids").when(F.col("ids") > MOST_ARCHIVED, "too many ids")
    return rows.select("request_id", "ids", F.when(problem.isNull(), F.col("moves")).otherwise(0).alias("moved"), problem.alias("problem"))


def archived_by(state: DataFrame, requests: DataFrame) -> DataFrame:
    """app_id of the rows that valid requests (request_id, app_id) move. Which requests are valid does not depend on the state, which is read once."""
    named = requests.where("app_id is not null").distinct()
    valid = named.groupBy("request_id").agg(F.count("*").alias("ids")).where(F.col("ids") <= MOST_ARCHIVED).select("request_id")
    ids = named.join(valid, "request_id", "left_semi").select("app_id").distinct()
    return state.where(status_filter(FINAL, False)).join(ids, "app_id", "left_semi").select("app_id")


def domain_violations(rows: DataFrame, table: str, key: str, domains: dict[str, list[str]]) -> DataFrame:
    """table_name, id, column_name and value of every value outside its domain; null is no value and breaks none."""
    bad = [F.when(~F.col(c).isin(values), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c, values in domains.items()]
    found = rows.select(F.lit(table).alias("table_name"), F.col(key).alias("id"), F.explode(F.array_compact(F.array(*bad))).alias("x"))
    return found.select("table_name", "id", "x.*")


def without(apps: DataFrame, reviews: DataFrame, gone: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """New snapshots without the applications whose ``key`` is in ``gone``, and without their reviews."""
    left = apps.join(gone.select(key).distinct(), key, "left_anti")
    return left, reviews.join(left.select("app_id"), "app_id", "left_semi")


def split_by_cache(runs: DataFrame, verified: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(hits, misses): runs whose key was verified before, and the first run of each other key."""
    done = verified.select(*keys).distinct()
    hits = runs.join(done, keys, "left_semi")
    firsts = runs.join(done, keys, "left_anti").groupBy(*keys).agg(F.min(F.struct(*order)).alias("first_"))
    return hits, firsts.select(*keys, "first_.*")
