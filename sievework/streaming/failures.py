"""A ticket's log of failures as keyed state of a stream, and the same log in batch."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import TimerValues

from sievework.functions.text import failure_key
from sievework.sources.files import read_batches, write_batch

#: What a logged failure is: its number in the ticket's log, and how often its pattern, its state and its kind occurred so far.
LOG = "ticket string, event_id long, fail_id string, pattern string, occurrences long, recurring boolean, in_state long, of_kind long, total long"
_FAILURES = ("ticket", "event_id", "state", "kind", "pattern")


def _failures(events: DataFrame) -> DataFrame:
    """events (ticket, event_id, state, kind, summary) with the pattern of their summary."""
    pattern = failure_key(F.coalesce("summary", F.lit("")))
    return events.select(F.col("ticket").cast("string").alias("ticket"), F.col("event_id").cast("long").alias("event_id"), F.coalesce("state", F.lit("")).alias("state"), F.coalesce("kind", F.lit("")).alias("kind"), pattern.alias("pattern"))


def batch_failure_log(events: DataFrame) -> DataFrame:
    """LOG of all events in order of event_id; of rows with one ticket and event_id the first by state, kind and pattern counts. A pattern is
    recurring from its second failure on. A null ticket is one of its own."""
    f = _failures(events)
    once = f.groupBy("ticket", "event_id").agg(F.min(F.struct("state", "kind", "pattern")).alias("r")).select("ticket", "event_id", "r.*")
    n = lambda *by: F.row_number().over(Window.partitionBy("ticket", *by).orderBy("event_id")).cast("long")
    rows = once.withColumns({"total": n(), "occurrences": n("pattern"), "in_state": n("state"), "of_kind": n("kind")})
    number = F.col("total").cast("string")
    fail_id = F.concat(F.lit("fail-"), F.lpad(number, F.greatest(F.length(number), F.lit(3)), F.lit("0")))
    return rows.select("ticket", "event_id", fail_id.alias("fail_id"), "pattern", "occurrences", (F.col("occurrences") > 1).alias("recurring"), "in_state", "of_kind", "total")


#: Event ids of a ticket that are remembered in one entry of the state, as 16-bit offsets.
BLOCK = 1 << 16
#: Names of a ticket whose counts lie beside its total; further ones have an entry each.
NEAR = 64


class FailureLog(StatefulProcessor):
    """Per ticket: how many failures there were, in all, by state, kind and pattern, and which event ids have been logged.

    What is kept grows with a ticket's different patterns and with its events; `remember_ms` lets ids go after a while. Every access to the state is a
    message to the JVM and back, so a micro-batch reads and writes a ticket's total with its first NEAR counts as one entry, and the ids of a BLOCK as one.
    """

    def __init__(self, remember_ms: int | None = None):
        self.remember_ms = remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.near = handle.getValueState("near", "total long, counts map<string, long>")
        self.far = handle.getMapState("far", "name string", "n long")
        self.seen = handle.getMapState("seen", "block long", "ids binary, at binary", self.remember_ms)

    def _unseen(self, ids: Iterable[int], now: int) -> set[int]:
        """Those of ids that aren't remembered; they are from now on."""
        blocks: dict[int, list[int]] = {}
        for i in ids:
            blocks.setdefault(i // BLOCK, []).append(i % BLOCK)
        fresh: set[int] = set()
        for block, offsets in blocks.items():
            old = self.seen.getValue((block,))
            known, at = (np.frombuffer(old[0], np.uint16), np.frombuffer(old[1], np.int64)) if old else (np.zeros(0, np.uint16), np.zeros(0, np.int64))
            if self.remember_ms:
                kept = at > now - self.remember_ms
                known, at = known[kept], at[kept]
            there = set(known.tolist())
            new = [o for o in offsets if o not in there]
            if new:
                at = np.append(at, np.full(len(new), now, np.int64)) if self.remember_ms else at
                self.seen.updateValue((block,), (np.append(known, np.array(new, np.uint16)).tobytes(), at.tobytes()))
                fresh.update(block * BLOCK + o for o in new)
        return fresh

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:  # noqa: N802, N803
        first: dict[int, tuple] = {}  # a ticket's part of one micro-batch
        for r in rows:
            said = (r.state, r.kind, r.pattern)
            if r.event_id not in first or said < first[r.event_id]:
                first[r.event_id] = said
        fresh = self._unseen(first, timerValues.getCurrentProcessingTimeInMs() if self.remember_ms else 0)
        if not fresh:
            return
        total, near = self.near.get() or (0, {})
        far: dict[str, int] = {}

        def next_of(kind: str, name: str) -> int:
            name = f"{kind} {name}"
            counts = near if name in near or len(near) < NEAR else far
            if counts is far and name not in far:
                old = self.far.getValue((name,))
                far[name] = old[0] if old else 0
            counts[name] = counts.get(name, 0) + 1
            return counts[name]

        for total, event_id in enumerate(sorted(fresh), total + 1):
            state, kind, pattern = first[event_id]
            n = next_of("pattern", pattern)
            yield Row(ticket=key[0], event_id=event_id, fail_id=f"fail-{total:03d}", pattern=pattern, occurrences=n, recurring=n > 1, in_state=next_of("state", state), of_kind=next_of("kind", kind), total=total)
        for name, n in far.items():
            self.far.updateValue((name,), (n,))
        self.near.update((total, near))

    def close(self) -> None:
        pass


def stream_failure_log(spark: SparkSession, events: DataFrame, folder: str, remember_ms: int | None = None) -> DataFrame:
    """Runs a stream of events until none is left and returns the whole LOG so far; called again, it goes on where it stopped.

    Numbers follow arrival: within a micro-batch event_id, so a late event gets the next number. An event that comes again is ignored.
    Checkpoint and log lie in folder; a batch is added to the log once by its number, whatever is run again.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if remember_ms:  # ids go by the clock, for which Spark would run batches without data and without end
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    logged = _failures(events).groupBy("ticket").transformWithState(FailureLog(remember_ms), LOG, "append", "processingTime" if remember_ms else "none")
    sink = logged.writeStream.outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    sink.foreachBatch(lambda batch, n: write_batch(batch, f"{folder}/log", n) and None).start().awaitTermination()
    return read_batches(spark, f"{folder}/log", LOG)
