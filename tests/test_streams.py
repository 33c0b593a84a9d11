"""Streams over several micro-batches: replayed, late and repeated events; and versions of tables that change together."""

import datetime as dt
import json
import shutil

import pytest
from docassay.operators import cross_check
from docassay.sources import snapshots
from docassay.streaming import streams
from pyspark.sql import functions as F

EVENT = "event_id long, app_id long, ts timestamp, kind string, decision string, reason string, reviewer string"


def put(path, number, rows):
    path.mkdir(exist_ok=True)
    (path / f"{number:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))


def event(number, app, minute, decision=None, reason="why"):
    ts = (dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)).isoformat() + "Z"
    return {"event_id": number, "app_id": app, "ts": ts, "kind": "review" if decision else "archive", "decision": decision, "reason": reason, "reviewer": "r"}


def states(spark, tmp_path, keep="365 days"):
    changes = streams.review_state(spark.readStream.schema(EVENT).json(str(tmp_path / "in")), "10 minutes", keep)
    streams.drain(streams.upserts(changes, str(tmp_path / "out"), str(tmp_path / "log")), streams.STATE_STORE)
    rows = streams.newest(spark, str(tmp_path / "out"), "app_id", "as_of").collect()
    minute = lambda t: None if t is None else int((t - dt.datetime(2024, 1, 1)).total_seconds() // 60)
    return {r.app_id: (r.status, minute(r.status_at), minute(r.archived_at)) for r in rows}


def test_review_state_over_batches(spark, tmp_path):
    at = tmp_path / "in"
    put(at, 1, [event(3, 1, 30, "rejected"), event(2, 1, 20, "approved"), event(1, 1, 10), event(2, 1, 20, "approved"), event(9, 2, 31, "rejected", " "), event(10, 3, 29, "approved"), event(99, 9, 60, "approved")])
    # Out of order inside the batch; the archive event before the first review counts for nothing; a rejection without a reason is none.
    assert states(spark, tmp_path) == {1: ("rejected", 30, None), 3: ("approved", 29, None)}
    # The watermark stands at minute 50: what is older is late, what is repeated is known, what is between is taken.
    put(at, 2, [event(4, 1, 45, "approved"), event(3, 1, 30, "rejected"), event(5, 1, 55), event(11, 3, 58), event(12, 3, 59, "rejected"), event(98, 9, 90, "rejected")])
    assert states(spark, tmp_path) == {1: ("rejected", 30, 55), 3: ("approved", 29, 58), 9: ("approved", 60, None)}
    # Nothing new: a restart changes nothing.
    before = spark.read.parquet(str(tmp_path / "out")).count()
    assert states(spark, tmp_path)[1] == ("rejected", 30, 55) and spark.read.parquet(str(tmp_path / "out")).count() == before
    # Locked by the archive event.
    put(at, 3, [event(13, 1, 95, "approved"), event(14, 9, 96, "approved"), event(97, 8, 200, "approved")])
    assert states(spark, tmp_path) == {1: ("rejected", 30, 55), 3: ("approved", 29, 58), 9: ("approved", 96, None)}


def test_an_application_without_events_is_forgotten(spark, tmp_path):
    put(tmp_path / "in", 1, [event(1, 1, 1, "approved"), event(2, 1, 2), event(3, 2, 100, "approved")])
    assert states(spark, tmp_path, "60 minutes")[1] == ("approved", 1, 2)
    put(tmp_path / "in", 2, [event(4, 1, 150, "rejected"), event(5, 2, 300, "approved")])
    assert states(spark, tmp_path, "60 minutes")[1] == ("rejected", 150, None)  # begins anew


def test_many_events_of_one_application_and_one_instant(spark, tmp_path):
    put(tmp_path / "in", 1, [event(i, 1, 5, ["approved", "rejected"][i % 2]) for i in range(40)] + [event(1000 + i, 1, 6 + i / 60, "approved") for i in range(200)] + [event(5000, 2, 60, "approved")])
    assert states(spark, tmp_path) == {1: ("approved", 9, None)}
    assert spark.read.parquet(str(tmp_path / "out")).where("app_id = 1").count() == 201  # the equal instants are one step


def test_waiting_events_beyond_one_value(spark, tmp_path, monkeypatch):
    """each event had its own timer and entry; now few are one value, and more than ``most`` go by millisecond with the same result."""
    own = streams.Reviews
    monkeypatch.setattr(streams, "Reviews", lambda keep: own(keep, 3))
    put(tmp_path / "in", 1, [event(i, 1, 5 + i % 7, ["approved", "rejected"][i % 2]) for i in range(30)] + [event(50, 2, 8, "approved"), event(51, 3, 59, "approved"), event(99, 9, 60, "approved")])
    assert states(spark, tmp_path) == {1: ("rejected", 11, None), 2: ("approved", 8, None)}
    assert spark.read.parquet(str(tmp_path / "out")).where("app_id = 1").count() == 7
    put(tmp_path / "in", 2, [event(60, 1, 55, "approved"), event(61, 2, 56), event(51, 3, 59, "approved"), event(98, 9, 90, "rejected")])
    assert states(spark, tmp_path) == {1: ("approved", 55, None), 2: ("approved", 8, 56), 3: ("approved", 59, None), 9: ("approved", 60, None)}


def test_a_run_is_verified_once(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cross_check, "verify", lambda rows, forms: rows.select("doc_id", F.lit("compliant").alias("verdict")))
    schema = "doc_id long, content_hash string, prompt_version string, extractor_model string"
    row = lambda i, h, m="m": {"doc_id": i, "content_hash": h, "prompt_version": "p", "extractor_model": m}

    def run(name="main"):
        labels = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        streams.drain(streams.verify(labels, None, str(tmp_path / "out"), str(tmp_path / f"log-{name}"), name=name))
        return sorted((r.doc_id, r.content_hash, r.extractor_model) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    put(tmp_path / "in", 1, [row(2, "a"), row(1, "a"), row(3, "b")])
    assert run() == [(1, "a", "m"), (3, "b", "m")]
    put(tmp_path / "in", 2, [row(4, "a"), row(5, "a", "other"), row(6, "c"), row(6, "c")])
    assert run() == [(1, "a", "m"), (3, "b", "m"), (5, "a", "other"), (6, "c", "m")]
    assert run() == run("again")  # another stream over the same rows finds them all verified
    shutil.rmtree(tmp_path / "log-main/commits")  # the last batches are replayed
    assert run() == [(1, "a", "m"), (3, "b", "m"), (5, "a", "other"), (6, "c", "m")]


def test_only_changed_batches_are_written(spark, tmp_path):
    def run():
        counts = streams.batch_progress(spark.readStream.schema("batch_id string").json(str(tmp_path / "in")))
        streams.drain(streams.upserts(counts, str(tmp_path / "out"), str(tmp_path / "log")))
        sizes = spark.createDataFrame([("a", 2), ("b", 2), ("c", 0), ("d", 1)], "batch_id string, total int")
        return {r.batch_id: (r.received, r.complete) for r in streams.progress(streams.newest(spark, str(tmp_path / "out"), "batch_id"), sizes).collect()}

    put(tmp_path / "in", 1, [{"batch_id": "a"}, {"batch_id": "b"}])
    assert run() == {"a": (1, False), "b": (1, False), "c": (0, False), "d": (0, False)}
    put(tmp_path / "in", 2, [{"batch_id": "a"}])
    assert run() == {"a": (2, True), "b": (1, False), "c": (0, False), "d": (0, False)}
    parts = {r.part: r.n for r in spark.read.parquet(str(tmp_path / "out")).groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sorted(parts.values()) == [1, 2]
    streams.compact(spark, str(tmp_path / "out"), str(tmp_path / "small"), "batch_id")
    assert {r.batch_id: r.received for r in streams.newest(spark, str(tmp_path / "small"), "batch_id").collect()} == {"a": 2, "b": 1}


def test_versions_change_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "queue")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, path)
    apps = spark.createDataFrame([(i, f"h{i % 3}", i) for i in range(6)], "app_id long, content_hash string, created_at long")
    reviews = spark.createDataFrame([(i, i % 6) for i in range(12)], "review_id long, app_id long")
    first = snapshots.write(spark, path, {"apps": apps, "reviews": reviews, "more": apps.limit(1)})
    held = snapshots.read(spark, path)
    ids = lambda: tuple(sorted({r.app_id for r in snapshots.read(spark, path)[t].collect()}) for t in ("apps", "reviews"))

    # A failure between the two tables leaves the old version, whole.
    broken = reviews.withColumn("x", F.raise_error("lost").cast("string"))
    with pytest.raises(Exception, match="lost"):
        snapshots.write(spark, path, {"apps": apps.limit(1), "reviews": broken}, since=first)
    assert snapshots.version(spark, path) == first and ids() == ([0, 1, 2, 3, 4, 5], [0, 1, 2, 3, 4, 5])

    second = snapshots.delete_by_hash(spark, path, spark.createDataFrame([("h1",), ("h1",), ("none",)], "content_hash string"))
    assert ids() == ([0, 2, 3, 5], [0, 2, 3, 5]) and snapshots.read(spark, path)["more"].count() == 1
    assert held["apps"].count() == 6  # a reader of the old version goes on
    with pytest.raises(RuntimeError, match="meanwhile"):
        snapshots.write(spark, path, {"apps": apps}, since=first)
    snapshots.delete_recent(spark, path, 2)
    assert ids() == ([0, 2], [0, 2])
    gone = snapshots.clean(spark, path)
    assert {first, second} <= set(gone) and ids() == ([0, 2], [0, 2])
