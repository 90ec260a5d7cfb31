"""Folds of ordered events into state."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.operators.integrity import latest


def cell_states(matrix: DataFrame, events: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Every cell of the matrix with its latest status and error; 'pending' without an event. Errors clear on running and done."""
    last = latest(events, keys, order, ["status", "error"])
    status = F.coalesce("status", F.lit("pending"))
    return matrix.join(last, keys, "left").select(*keys, status.alias("status"), F.when(F.col("status") == "failed", F.col("error")).alias("error"))


def to_run(cells: DataFrame, order: list[Column], batch: int | None = None) -> DataFrame:
    """Cells to run on resuming: pending and running ones, the first `batch` of them."""
    open_ = cells.where("status in ('pending', 'running')")
    return open_ if batch is None else open_.orderBy(*order).limit(batch)


def progress(cells: DataFrame, by: list[str]) -> DataFrame:
    """done, failed, open and complete by keys."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return cells.groupBy(*by).agg(n("done").alias("done"), n("failed").alias("failed"), n("pending", "running").alias("open"), (n("pending", "running") == 0).alias("complete"))


#: Events of a key that are folded at once, and runs of events, and groups of runs.
FOLD = 512


def guarded(events: DataFrame, keys: list[str], order: list[Column], allowed: dict[str, tuple[str, ...]], start: str, missing: Column | None = None) -> DataFrame:
    """Each event (to_state) with from_state, the state that the key is in, missing, and whether the transition is allowed.

    missing lists the preconditions that fail (none by default), in order. A transition is allowed if its pair is and nothing
    is missing; a refused one leaves the state as it is. Keys may have any number of events: runs of FOLD of them become
    maps of every state to the one that follows, runs of FOLD maps are composed again, and what is left of a key is chained; then
    states are filled in from the top down. All of it are expressions on arrays.
    """
    none = F.expr("cast(array() as array<string>)")
    states = sorted({start, *allowed, *(b for bs in allowed.values() for b in bs)})
    sign = {s: chr(33 + k) for k, s in enumerate(states)}  # a state as one character, a map as those that its signs become
    same = F.lit("".join(sign.values()))
    names = F.array(*map(F.lit, states))
    effect = F.array(*(F.lit("".join(sign[b if b in allowed.get(a, ()) else a] for a in states)) for b in states))
    pairs = F.array(*(F.lit(sign[a] + sign[b]) for a, bs in allowed.items() for b in sorted(set(bs))))

    def ends(items: str) -> Column:
        """The map that the maps m of the items make up."""
        return F.aggregate(items, same, lambda acc, x: F.call_function("translate", acc, same, x["m"]))

    def along(items: str, first: Column) -> Column:
        """The signs before each item and after the last."""
        return F.aggregate(items, first, lambda acc, x: F.concat(acc, F.call_function("translate", F.right(acc, F.lit(1)), same, x["m"])))

    turn = F.row_number().over(Window.partitionBy("_k").orderBy(*order)) - 1
    rows = events.withColumn("missing", none if missing is None else F.coalesce(missing, none)).withColumn("_k", F.struct(*keys)).withColumn("_n", turn)
    to = F.coalesce(F.array_position(names, F.col("to_state")), F.lit(0)).cast("int")
    m = F.when((F.size("missing") == 0) & (to > 0), F.get(effect, to - 1)).otherwise(same)
    event = F.struct("_n", m.alias("m"), F.struct(*events.columns, "missing").alias("row"))
    listed = lambda c, name: F.sort_array(F.collect_list(c)).alias(name)
    sign_at = lambda signs, i: F.substring(signs, i + 1, F.lit(1))
    # numbers differ, so sorting looks at nothing else; a group has FOLD items at most
    runs = rows.withColumn("_run", F.floor(F.col("_n") / FOLD)).groupBy("_k", "_run").agg(listed(event, "e"))
    groups = runs.select("_k", "_run", ends("e").alias("m")).withColumn("_group", F.floor(F.col("_run") / FOLD)).groupBy("_k", "_group").agg(listed(F.struct("_run", "m"), "r"))
    keyed = groups.select("_k", "_group", ends("r").alias("m")).groupBy("_k").agg(listed(F.struct("_group", "m"), "g"))
    of_groups = keyed.withColumn("s", along("g", F.lit(sign[start]))).select("_k", "s", F.posexplode("g").alias("_i", "x")).select("_k", "x._group", sign_at("s", F.col("_i")).alias("s"))
    of_runs = groups.join(of_groups, ["_k", "_group"]).withColumn("s", along("r", F.col("s"))).select("_k", "s", F.posexplode("r").alias("_i", "x")).select("_k", "x._run", sign_at("s", F.col("_i")).alias("s"))
    filled = runs.join(of_runs, ["_k", "_run"]).withColumn("s", along("e", F.col("s"))).select("s", F.posexplode("e").alias("_i", "x")).select("x.row.*", sign_at("s", F.col("_i")).alias("_s"))
    state = F.get(names, F.array_position(F.array(*map(F.lit, sign.values())), F.col("_s")).cast("int") - 1)
    done = F.get(F.array(*map(F.lit, sign.values())), F.coalesce(F.array_position(names, F.col("to_state")), F.lit(0)).cast("int") - 1)
    ok = (F.size("missing") == 0) & F.coalesce(F.array_contains(pairs, F.concat("_s", done)), F.lit(False))
    return filled.select(*events.columns, "missing", state.alias("from_state"), ok.alias("allowed"))


def cycles(events: DataFrame, keys: list[str], failed: Column, side_effect: Column, most: int) -> DataFrame:
    """Failures by keys, how many of them name a side effect, and whether they reach `most`."""
    return events.groupBy(*keys).agg(F.count_if(failed).alias("cycles"), F.count_if(failed & side_effect).alias("side_effects"), (F.count_if(failed) >= most).alias("blocked"))


def cycle_actions(failures: DataFrame, keys: list[str], order: list[Column], most: int, escalations: int = 1) -> DataFrame:
    """Each failure with its number among its key's, and what follows: REENTER while fewer than `most`, then ESCALATE so many times, then BLOCKED."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return failures.withColumn("cycle", n).withColumn("action", F.when(F.col("cycle") < most, "REENTER").when(F.col("cycle") < most + escalations, "ESCALATE").otherwise("BLOCKED"))


def commits_of(steps: Column) -> Column:
    """Different commits of an array of steps, in order."""
    return F.array_distinct(F.flatten(F.transform(steps, lambda s: F.coalesce(s["commits"], F.expr("cast(array() as array<string>)")))))


def resume_points(steps: DataFrame, keys: list[str], step: str, status: str) -> DataFrame:
    """The first step of each key that isn't completed; null when all are."""
    return steps.groupBy(*keys).agg(F.min(F.when(F.col(status) != "completed", F.col(step))).alias("resume_at"))


#: Files that a stage leaves before it has ended, and one whose absence beside them means that a review is due (fixed values); stages of an
#: evaluation in order, of which the last is a test bench by whatever name.
ARTIFACTS = {"ANALYSIS": ("analysis.md", "related-code.json"), "PLANNING": ("plan.md",), "DESIGN": ("design-v",)}
REVIEWED, EVALUATION_STAGES = "design-changelog.md", ("unit_test", "lint", "security", "bench")


def resume_details(workspaces: DataFrame, steps: DataFrame, artifacts: DataFrame, stages: DataFrame, stage_order: tuple[str, ...] = EVALUATION_STAGES) -> DataFrame:
    """ticket, state, step_id, checkpoint, sub_status, last_stage, next_stage: where each workspace (ticket, state) goes on.

    In IMPLEMENTATION at the first step (ticket, step_id, status, checkpoint) that isn't completed; in ANALYSIS, PLANNING and DESIGN
    fresh, or partial if files (ticket, name) of that stage are there, or review_pending for a design without its change log; in
    EVALUATION at the stage after the last one (ticket, stage) that was completed, in their order. Other states have no more to say.
    """
    open_ = steps.where("status <> 'completed'").groupBy("ticket").agg(F.min(F.struct("step_id", "checkpoint")).alias("step"))
    there = lambda names: reduce(lambda a, b: a | b, (F.startswith("name", F.lit(n)) if n.endswith("-v") else F.col("name") == n for n in names))
    found = artifacts.groupBy("ticket").agg(*(F.bool_or(there(names)).alias(f"_{s}") for s, names in ARTIFACTS.items()), F.bool_or(F.col("name") == REVIEWED).alias("_reviewed"))
    at = F.array_position(F.array(*map(F.lit, stage_order)), F.col("stage"))
    last = stages.groupBy("ticket").agg(F.max(at).alias("_done"))
    j = workspaces.select("ticket", "state").join(open_, "ticket", "left").join(found, "ticket", "left").join(last, "ticket", "left")
    state, yes = F.col("state"), lambda c: F.coalesce(F.col(c), F.lit(False))
    sub = F.when((state == "DESIGN") & yes("_DESIGN") & ~yes("_reviewed"), "review_pending")
    for s in ARTIFACTS:
        sub = sub.when((state == s) & yes(f"_{s}"), "partial").when(state == s, "fresh")
    done = F.when(state == "EVALUATION", F.coalesce("_done", F.lit(0)))
    stage = lambda i: F.get(F.array(*map(F.lit, stage_order)), i.cast("int"))
    building = state == "IMPLEMENTATION"
    return j.select("ticket", "state", F.when(building, F.col("step.step_id")).alias("step_id"), F.when(building, F.col("step.checkpoint")).alias("checkpoint"), sub.alias("sub_status"), F.when(done > 0, stage(done - 1)).alias("last_stage"), stage(done).alias("next_stage"))


def numbered(failures: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """failures with fail_id: fail-001, fail-002, ... by keys; from 1000 on numbers have as many digits as they need."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("string")
    return failures.withColumn("fail_id", F.concat(F.lit("fail-"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0"))))


def latency(events: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Seconds from the first to the last event of each key."""
    return events.groupBy(*keys).agg(F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", F.min(ts), F.max(ts)) / 1e6).alias("latency_s"))


def monitor(samples: DataFrame, ts: str, value: Column, width: str, most: float, digits: int = 4) -> DataFrame:
    """Per window: samples, mean, largest, those over `most`, and whether it passes. Samples without a time are in no window.

    The mean is rounded, halves away from zero, from the exact sum of the values' micro-units, so it doesn't depend on the order
    of rows; where a value isn't finite or passes twelve digits, from the average of doubles.
    """
    exact = value.try_cast("decimal(18,6)")
    mean = F.when(F.count(exact) == F.count(value), F.round(F.try_divide(F.sum(exact), F.count(exact)), digits).cast("double")).otherwise(F.round(F.avg(value), digits))
    by = samples.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("samples"), mean.alias("mean"), F.max(value).alias("largest"), F.count_if(value > most).alias("violations"))
    return by.select(F.col("w.start").alias("start"), "samples", "mean", "largest", "violations", (F.col("violations") == 0).alias("passes"))


def fan_out(events: DataFrame, workspaces: DataFrame, key: str) -> DataFrame:
    """Each event to every workspace of its key that isn't completed."""
    return events.join(workspaces.where("state <> 'COMPLETED'"), key)
