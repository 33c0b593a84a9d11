"""Structured Streaming forms: result lines, verification, batch progress and review state."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import cross_check
from ..operators.lifecycle import review_problem
from ..sources.folders import discard, scratch
from ..sources.results import exists, parse_lines

#: What ``review_state`` needs of the session: keyed state with timers lives in this kind of store only.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
RUN_KEY = ["content_hash", "prompt_version", "extractor_model"]


def drain(query, settings: dict[str, str] | None = None) -> None:
    """Starts a query on what is there now and waits for it. ``settings`` hold for the query alone."""
    conf = SparkSession.active().conf
    before = {k: conf.get(k, None) for k in settings or {}}
    try:
        for k, v in (settings or {}).items():
            conf.set(k, v)
        running = query.trigger(availableNow=True).start()  # takes a copy of the settings
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)
    running.awaitTermination()


def result_lines(lines: DataFrame, good: str, bad: str, checkpoint: str):
    """Streaming lines (column value) into two tables: results and quarantined lines. Batches overwrite their own folder, so a replay changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, scratch(batch.sparkSession, "lines")
        parse_lines(batch).write.mode("overwrite").parquet(at)  # kept compressed, as a batch may be much larger than the memory
        parsed = spark.read.parquet(at)
        parsed.where("kind = 'value'").drop("quarantined", "problems").write.mode("overwrite").parquet(f"{good}/batch={number}")
        parsed.where("kind <> 'value'").write.mode("overwrite").parquet(f"{bad}/batch={number}")
        discard(spark, at)

    return lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def verify(labels: DataFrame, forms: DataFrame, out: str, checkpoint: str, keys: list[str] = RUN_KEY, name: str = "main"):
    """Streaming labels, with a run's ``keys``, into verdict rows in ``out``. A run is verified once: keys that ``out`` holds are passed over, and of rows that share one in a
    batch that with the least doc_id stays.

    Only the key columns of earlier results are read. ``name`` keeps apart the batches of streams that write to one table; a replayed batch replaces its own part.
    """
    spark = labels.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.min_by(F.struct(*batch.columns), "doc_id").alias("r")).select("r.*")
        if exists(spark, out):
            known = spark.read.parquet(out).where(~((F.col("stream") == name) & (F.col("batch") == number))).select(*keys)
            new = new.join(known, keys, "left_anti")
        found = cross_check.verify(new, forms).join(new.select("doc_id", *keys), "doc_id")
        found.write.mode("overwrite").parquet(f"{out}/stream={name}/batch={number}")

    return labels.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def batch_progress(received: DataFrame) -> DataFrame:
    """A running count for each batch_id; in update mode only those that a micro-batch changes."""
    return received.groupBy("batch_id").agg(F.count("*").alias("received"))


def upserts(changes: DataFrame, out: str, checkpoint: str):
    """Writes the changed rows of each micro-batch, and no others, as a part of its own; ``newest`` reads the last of each key."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/part={number}")

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)


def newest(spark: SparkSession, out: str, key: str, *order: str) -> DataFrame:
    """The last row of each key: of the latest part, and inside it of the greatest ``order``."""
    rows = spark.read.parquet(out)
    held = [c for c in rows.columns if c not in (key, "part")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*held), F.struct("part", *order)).alias("r")).select(key, "r.*")


def compact(spark: SparkSession, out: str, target: str, key: str, *order: str) -> None:
    """The newest rows as a table of one part, for a reader that starts anew there."""
    newest(spark, out, key, *order).write.mode("overwrite").parquet(f"{target}/part=-1")


def progress(counts: DataFrame, batches: DataFrame) -> DataFrame:
    """batch_id, received, total, complete: running counts against the sizes of the batches (batch_id, total). One is complete once as many came as it holds, and it holds any."""
    got = F.coalesce("received", F.lit(0))
    return batches.join(counts.select("batch_id", "received"), "batch_id", "left").select("batch_id", got.alias("received"), "total", ((F.col("total") > 0) & (got >= F.col("total"))).alias("complete"))


class Reviews(StatefulProcessor):
    """The review state of one application. Events wait until the watermark has passed them, then they count in the order of their time.

    Up to ``most`` waiting events are kept as one value, with one timer for the first of them: each access to the state costs more than an event's own work. More of them are
    kept by millisecond, with a timer for each, so that no step holds more than ``most`` events or those of one millisecond. An event that the
    watermark has passed is late and changes nothing; so does one that is repeated. After ``keep`` milliseconds without an event the state goes.
    """

    def __init__(self, keep: int, most: int = 1000):
        self.keep, self.most = keep, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        event = "at: long, ts: long, event_id: long, kind: string, decision: string"
        self.handle = handle
        self.state = handle.getValueState("state", "status string, status_at long, archived_at long, ends long")
        self.waiting = handle.getValueState("waiting", f"few array<struct<{event}>>, many long")
        self.instants = handle.getMapState("instants", "at long", f"events array<struct<{event}>>")

    def held(self) -> tuple[list[tuple], int]:
        """The waiting events that are kept as one value, and the number of those kept by millisecond."""
        found = self.waiting.get()
        return ([], 0) if found is None else (list(map(tuple, found[0])), found[1])

    def hold(self, few: list[tuple], many: int) -> None:
        self.waiting.update((few, many)) if few or many else self.waiting.clear()

    def spread(self, events: list[tuple]) -> int:
        """Keeps events by millisecond, and gives the number of new ones."""
        added = 0
        for at, group in groupby(sorted(events, key=lambda e: e[0]), lambda e: e[0]):
            old = list(map(tuple, self.instants.getValue((at,))[0])) if self.instants.containsKey((at,)) else []
            new = {e[2]: e for e in [*group, *old]}  # of repeated ones the first stays
            added += len(new) - len(old)
            self.instants.updateValue((at,), (list(new.values()),))
            self.handle.registerTimer(at)
        return added

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs()
        few, many = self.held()
        before = min(few)[0] if few else None
        known = {(e[0], e[2]): e for e in few}
        for r in rows:
            if r.at > passed:
                known.setdefault((r.at, r.event_id), (r.at, r.ts, r.event_id, r.kind, r.decision))
            if len(known) > self.most:
                many, known = many + self.spread(list(known.values())), {}
        few = list(known.values())
        if many and few:
            many, few = many + self.spread(few), []
        self.hold(few, many)
        if few and (first := min(e[0] for e in few)) != before:
            self.handle.registerTimer(first)
        return iter(())

    def due(self, at: int, passed: int) -> list[tuple]:
        """Takes out the waiting events whose turn has come."""
        few, many = self.held()
        if many:
            if not self.instants.containsKey((at,)):
                return []
            found = list(map(tuple, self.instants.getValue((at,))[0]))
            self.instants.removeKey((at,))
            self.hold(few, many - len(found))
            return found
        found, left = [e for e in few if e[0] <= passed], [e for e in few if e[0] > passed]
        if found:
            self.hold(left, 0)
            if left:
                self.handle.registerTimer(min(e[0] for e in left))
        return found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, passed = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        status, status_at, archived_at, ends = self.state.get() or (None, None, None, None)
        events = self.due(at, passed)
        if not events:
            if ends is not None and ends <= at:
                self.state.clear()
            return
        known = ends
        for at, group in groupby(sorted(events, key=lambda e: e[:3]), lambda e: e[0]):
            if ends is not None and ends < at:
                status = status_at = archived_at = None
            before = status, status_at, archived_at
            for _, ts, _, kind, decision in group:
                if archived_at is not None:
                    continue
                if kind == "archive":
                    archived_at = ts if status is not None and ts > status_at else None
                else:
                    status, status_at = decision, ts
            ends = at + self.keep
            if before != (status, status_at, archived_at):
                yield Row(app_id=key[0], status=status, status_at=status_at, archived_at=archived_at, as_of=at)
        if known is not None:
            self.handle.deleteTimer(known)
        self.handle.registerTimer(ends)
        self.state.update((status, status_at, archived_at, ends))

    def close(self) -> None:
        pass


def review_state(events: DataFrame, delay: str = "1 hour", keep: str = "365 days") -> DataFrame:
    """Streaming review and archive events (event_id, app_id, ts, kind, decision, reason, reviewer) into state changes: app_id, status, status_at, archived_at and as_of.

    Events may come in any order within ``delay``; an archive event counts once there is a decision, and locks. An application without events for ``keep`` is
    forgotten. ``upserts`` writes the changes, ``newest(..., "as_of")`` reads the state. Needs ``STATE_STORE``.
    """
    valid = events.withWatermark("ts", delay).withColumn("problem", F.when(F.col("kind") == "review", review_problem(F.lit(True)))).where("problem is null")
    rows = valid.select("app_id", F.col("ts").alias("event_time"), F.unix_millis("ts").alias("at"), F.unix_micros("ts").alias("ts"), "event_id", "kind", "decision")
    kept = events.sparkSession.range(1).select((F.expr(f"unix_millis(timestamp_seconds(0) + interval {keep})")).alias("ms")).first().ms
    made = f"app_id {events.schema['app_id'].dataType.simpleString()}, status string, status_at long, archived_at long, as_of long"
    found = rows.groupBy("app_id").transformWithState(Reviews(kept), made, "Update", "EventTime")
    times = {c: F.timestamp_micros(c) for c in ("status_at", "archived_at")}
    return found.where("status is not null").withColumns(times)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables as a stream of files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")
