"""The failure log as a stream, with restarts, and in batch; checkpoints and points to resume at."""

from collections import Counter
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import functions as F

from sievework.operators.checks import step_progress
from sievework.operators.lifecycle import resume_details
from sievework.streaming.failures import FailureLog, batch_failure_log, stream_failure_log
from sievework.streaming.state import files_stream

DDL = "ticket string, event_id long, state string, kind string, summary string"
ROWS = [(t, i, "EVALUATION" if i % 3 else "DESIGN", None if i % 7 == 0 else f"k{i % 2}", f"Panic in a.go:{i} at 0x{i:x}ff" if i % 2 else f"other {i % 4 // 2}") for i in range(60) for t in (("A", "B", None)[i % 3],)]


def plain(rows):
    """The log of rows in order of arrival."""
    import re

    total, counts, seen, out = Counter(), Counter(), set(), set()
    for t, i, state, kind, summary in rows:
        if (t, i) in seen:
            continue
        seen.add((t, i))
        pattern = re.sub("[0-9]+", "<n>", re.sub("0x[0-9a-f]+", "<hex>", summary.lower())).strip()
        total[t] += 1
        for name in (("p", pattern), ("s", state), ("k", kind or "")):
            counts[t, name] += 1
        n = counts[t, ("p", pattern)]
        out.add((t, i, f"fail-{total[t]:03d}", pattern, n, n > 1, counts[t, ("s", state)], counts[t, ("k", kind or "")], total[t]))
    return out


def test_batch_log(spark):
    found = [tuple(r) for r in batch_failure_log(spark.createDataFrame(ROWS[::-1] + ROWS[:5], DDL)).collect()]
    assert set(found) == plain(ROWS) and len(found) == len(ROWS)


def test_stream_equals_batch_over_restarts(spark, tmp_path):
    data, folder = tmp_path / "events", str(tmp_path / "log")

    def arrive(n, rows):
        spark.createDataFrame(rows, DDL).coalesce(1).write.parquet(str(data / f"part={n}"))

    def run():
        stream = spark.readStream.schema(DDL + ", part int").option("maxFilesPerTrigger", 1).parquet(str(data)).drop("part")
        return [tuple(r) for r in stream_failure_log(spark, stream, folder).collect()]

    arrive(0, ROWS[:20])
    first = run()
    assert set(first) == plain(ROWS[:20])
    # after a restart the next files come, one with events that were there before; then one that is late
    arrive(1, ROWS[10:40])
    arrive(2, ROWS[41:])
    assert set(run()) == plain(ROWS[:40] + ROWS[41:])
    arrive(3, [ROWS[40]])
    last = run()
    assert set(last) == plain(ROWS[:40] + ROWS[41:] + [ROWS[40]]) and len(last) == len(ROWS)
    assert sorted(run(), key=str) == sorted(last, key=str)  # nothing new, nothing twice
    assert {r for r in last if r[:2] == ("B", 40)} == {r for r in last if r[2] == "fail-020" and r[0] == "B"}


class Handle:
    """State in memory that counts how often it is asked."""

    def __init__(self):
        self.asked = 0

    def _state(self):
        held = {}

        def get(key=()):
            self.asked += 1
            return held.get(key)

        def put(*kv):
            self.asked += 1
            held[kv[0] if kv[1:] else ()] = kv[-1]

        return SimpleNamespace(get=get, getValue=get, update=put, updateValue=put)

    def getValueState(self, *_):  # noqa: N802
        return self._state()

    def getMapState(self, *_):  # noqa: N802
        return self._state()


def logged_by(log, rows, now=0):
    given = (Row(ticket=t, event_id=i, state=s, kind=k, pattern=p) for t, i, s, k, p in rows)
    return [tuple(r) for r in log.handleInputRows((rows[0][0],), given, SimpleNamespace(getCurrentProcessingTimeInMs=lambda: now))]


def test_a_micro_batch_asks_the_state_seldom():
    log, handle = FailureLog(), Handle()
    log.init(handle)
    rows = [("A", i, "s", f"k{i % 2}", f"p{i % 3}") for i in range(-500, 500)]
    assert [r[1:3] for r in logged_by(log, rows + rows[:9])] == [(i, f"fail-{i + 501:03d}") for i in range(-500, 500)]
    assert handle.asked <= 6  # two blocks of ids and the total, read and written
    assert logged_by(log, rows[::-1]) == [] and handle.asked <= 8


def test_many_names_and_blocks():
    log = FailureLog()
    log.init(Handle())
    rows = [("A", i * 40_000 - 10**7, "s", f"k{i % 2}", "x" * (i % 150)) for i in range(500)]
    found = [r for part in (rows[:200], rows[100:400], rows) for r in logged_by(log, part)]
    assert set(found) == plain(rows) and len(found) == 500


def test_ids_are_forgotten_after_a_while():
    log = FailureLog(1000)
    log.init(Handle())
    row = [("A", 7, "s", "k", "p")]
    other = [("A", 8, "s", "k", "p")]
    assert [len(logged_by(log, r, now)) for r, now in ((row, 1), (other, 900), (row, 1000), (row, 1001), (other, 1899), (row, 2000))] == [1, 1, 0, 1, 0, 0]


def test_ids_are_forgotten_by_a_stream(spark, tmp_path):
    spark.createDataFrame(ROWS[:3], DDL).coalesce(1).write.parquet(str(tmp_path / "events" / "part=0"))
    for k in (1, 2):
        stream = spark.readStream.schema(DDL + ", part int").parquet(str(tmp_path / "events")).drop("part")
        assert stream_failure_log(spark, stream, str(tmp_path / "log"), 1).count() == 3 * k
        spark.createDataFrame(ROWS[:3], DDL).coalesce(1).write.parquet(str(tmp_path / "events" / f"part={k}"))


def test_a_micro_batch_takes_several_files(spark, tmp_path):
    data, out = str(tmp_path / "events"), []
    spark.createDataFrame(ROWS, DDL).repartition(6).write.parquet(data)
    for size, batches in ((1, 6), (1 << 20, 1)):
        query = files_stream(spark, data, size).writeStream.option("checkpointLocation", str(tmp_path / f"c{size}")).trigger(availableNow=True).foreachBatch(lambda b, n: out.append(b.count())).start()
        query.awaitTermination()
        assert len(out) == batches and sum(out) == len(ROWS)
        out.clear()


def test_completion_clears_the_checkpoint(spark):
    rows = [(1, 1, "started", "a", None, "c1"), (1, 2, "started", "b", "half way", "c1"), (2, 1, "started", "a", "x", None), (2, 2, "completed", "b", None, "c2"), (3, 1, "completed", "a", None, None), (3, 2, "started", "b", "again", None)]
    df = spark.createDataFrame(rows, "step int, n int, kind string, at string, checkpoint string, commit string")
    got = {r.step: (r.started, r.completed, r.status, r.checkpoint, r.commits) for r in step_progress(df, ["step"], [F.col("n")]).collect()}
    assert got == {1: ("a", None, "started", "half way", "c1"), 2: ("a", "b", "completed", None, "c2"), 3: ("b", "a", "started", "again", "")}


def test_where_to_resume(spark):
    frame = lambda ddl, *rows: spark.createDataFrame(rows, ddl)
    spaces = frame("ticket string, state string", ("i", "IMPLEMENTATION"), ("a", "ANALYSIS"), ("p", "PLANNING"), ("d", "DESIGN"), ("r", "DESIGN"), ("e", "EVALUATION"), ("f", "EVALUATION"), ("b", "BLOCKED"), ("n", "EVALUATION"))
    steps = frame("ticket string, step_id int, status string, checkpoint string", ("i", 1, "completed", None), ("i", 3, "pending", None), ("i", 2, "in_progress", "wip"))
    files = frame("ticket string, name string", ("a", "related-code.json"), ("p", "analysis.md"), ("d", "design-v3.md"), ("r", "design-v1.md"), ("r", "design-changelog.md"))
    stages = frame("ticket string, stage string", ("e", "unit_test"), ("e", "lint"), ("f", "bench"))
    got = {r.ticket: (r.step_id, r.checkpoint, r.sub_status, r.last_stage, r.next_stage) for r in resume_details(spaces, steps, files, stages).collect()}
    none = (None,) * 5
    assert got == {
        "i": (2, "wip", None, None, None), "a": (None, None, "partial", None, None), "p": (None, None, "fresh", None, None), "d": (None, None, "review_pending", None, None), "r": (None, None, "partial", None, None),
        "e": (None, None, None, "lint", "security"), "f": (None, None, None, "bench", None), "b": none, "n": (None, None, None, None, "unit_test"),
    }
