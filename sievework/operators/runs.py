"""What the cells of an experiment came to, out of the files they leave: outcome, cycles, safety, latency, tokens and cost."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.integrity import prefer
from sievework.operators.records import iso_time, outcome_of
from sievework.operators.rollup import cost_status
from sievework.operators.usage import BUCKETS, costs, models_of, usage_from_chars, usage_from_sessions
from sievework.sources.readers import safe_json_lines

#: Stages of an evaluation, of which the last is a test bench by whatever name, and words of a summary that tell of a side effect.
STAGES = ("unit_test", "lint", "security", "bench")
SIDE_EFFECTS = ("bench", "race", "regression", "derived state", "derived-state", "panic", "data race")
TRANSCRIPT = "subagent_type string, prompt_chars long, response_chars long"
SESSION = "message struct<model: string, usage: struct<input_tokens: long, output_tokens: long, cache_creation_input_tokens: long, cache_read_input_tokens: long>>"


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit(kind)), F.lit(False))


def _filled(*columns: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def _stage(state: Column, name: str) -> Column:
    """A stage's status: its object's, or itself if it is text."""
    own = _at(state, f"states.EVALUATION.results.{name}", "variant")
    return F.when(_is(own, "OBJECT"), F.try_variant_get(own, "$.status", "string")).when(_is(own, "STRING"), own.cast("string"))


def run_facts(files: DataFrame, stage_names: tuple[str, ...] = STAGES, side_effects: tuple[str, ...] = SIDE_EFFECTS) -> DataFrame:
    """files (cell, meta, state: texts of JSON, or null) with what these two say. What is no JSON object counts as empty.

    task, mode, status, pipeline_state, correct (null if never evaluated), detail (map of stages), bug_cycles and side_effects (of the
    failures of an evaluation), safety_flags, latency_s (between the run's own times, else the pipeline's; null without both).
    """
    an_object = lambda c: F.when(_is(F.try_parse_json(c), "OBJECT"), F.try_parse_json(c))
    f = files.withColumn("_m", an_object(F.col("meta"))).withColumn("_s", an_object(F.col("state")))
    m, s = F.col("_m"), F.col("_s")
    now = _at(s, "current_state")
    failures = F.filter(F.coalesce(_at(s, "failure_log", "array<variant>"), F.expr("cast(array() as array<variant>)")), lambda e: F.coalesce(F.try_variant_get(e, "$.state", "string") == "EVALUATION", F.lit(False)))
    summary = lambda e: F.lower(F.coalesce(F.try_variant_get(e, "$.actual_outcome.summary", "string"), F.lit("")))
    harm = lambda e: reduce(lambda a, b: a | b, (F.contains(summary(e), F.lit(w)) for w in side_effects))
    checked = _at(s, "states.TICKET_INTAKE.sensitive_check.result")
    raced = F.lower(F.coalesce(_at(s, "states.EVALUATION.results.unit_test.race_detected"), F.lit("")))
    flags = F.array_compact(F.array(
        F.when(checked.isin("REDACTED", "BLOCKED"), F.concat(F.lit("sensitive_"), F.lower(checked))), F.when(_stage(s, "security") == "FAIL", "security_fail"), F.when(~raced.isin("", "false", "0", "null"), "race_detected"),
    ))
    stages = F.array(*(F.struct(F.lit(k).alias("key"), _stage(s, k).alias("value")) for k in stage_names))
    start, end = (iso_time(_filled(_at(m, a), _at(s, b))) for a, b in (("started_at", "created_at"), ("ended_at", "updated_at")))
    return f.select(
        "cell", _filled(_at(m, "task"), _at(s, "ticket_id"), F.col("cell")).alias("task"), _filled(_at(m, "mode"), F.lit("unknown")).alias("mode"),
        _filled(_at(m, "status"), F.when(s.isNotNull() & (F.size(F.json_object_keys(F.col("state"))) > 0), "done").otherwise("incomplete")).alias("status"),
        now.alias("pipeline_state"), outcome_of(now).alias("correct"), F.map_from_entries(F.filter(stages, lambda x: x["value"].isNotNull())).alias("detail"),
        F.size(failures).alias("bug_cycles"), F.size(F.filter(failures, harm)).alias("side_effects"), flags.alias("safety_flags"),
        F.when(start.isNotNull() & end.isNotNull(), F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", start, end) / 1e6)).alias("latency_s"),
    )


def run_usage(transcripts: DataFrame, sessions: DataFrame, agents: DataFrame, tiers: DataFrame, prices: DataFrame, fallback: str) -> DataFrame:
    """cell, the four kinds of tokens, tokens, cost, cost_status, usage_source, models.

    sessions and transcripts: cell, line (of JSON; those that can't be read are skipped). A cell whose session tells of any
    usage takes that, else its transcript's characters are estimated by the models of its agents.
    """
    said = safe_json_lines(sessions, "line", SESSION, "cell").select("cell", F.coalesce("message.model", F.lit(fallback)).alias("model"), "message.usage")
    exact = usage_from_sessions(said, ["cell", "model"])
    log = models_of(safe_json_lines(transcripts, "line", TRANSCRIPT, "cell"), "subagent_type", agents, tiers, fallback)
    guessed = usage_from_chars(log, ["cell", "model"], "prompt_chars", "response_chars")
    both = prefer(exact, guessed, ["cell"], "source", ("session_jsonl", "char_estimate"))
    total = lambda c: F.sum(c).alias(c)
    by = costs(both, prices, "source").groupBy("cell").agg(
        *map(total, BUCKETS), F.sum(sum((F.col(b) for b in BUCKETS[1:]), F.col(BUCKETS[0]))).alias("tokens"), F.round(F.sum("amount"), 6).alias("cost"),
        cost_status(F.col("status")).alias("cost_status"), F.first("source").alias("usage_source"), F.sort_array(F.collect_set("model")).alias("models"),
    )
    return by


def collected_runs(listed: DataFrame, files: DataFrame, usage: DataFrame, stage_names: tuple[str, ...] = STAGES) -> DataFrame:
    """A row for each cell: of those listed (pos, cell, task, mode, status), whether they left files or not, with what the list says of
    task, mode and status before what the files say; without a list of all that left files, by name."""
    facts = run_facts(files, stage_names).withColumn("_left", F.lit(True))
    told = listed.select("pos", "cell", *(F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in ("task", "mode", "status")), F.lit(True).alias("_said"))
    any_listed = listed.select(F.lit(1)).limit(1).agg((F.count(F.lit(1)) > 0).alias("_any"))  # one row
    j = told.join(facts, "cell", "full").join(F.broadcast(any_listed), F.lit(True)).where(F.coalesce("_said", F.lit(False)) | ~F.col("_any"))
    empty = F.expr("cast(array() as array<string>)")
    rows = j.join(usage, "cell", "left")
    return rows.select(
        "cell", "pos", F.coalesce("_task", "task", "cell").alias("task"), F.coalesce("_mode", "mode", F.lit("unknown")).alias("mode"), F.coalesce("_status", "status", F.lit("incomplete")).alias("status"), "pipeline_state", "correct", "detail",
        F.coalesce("bug_cycles", F.lit(0)).alias("bug_cycles"), F.coalesce("side_effects", F.lit(0)).alias("side_effects"), F.coalesce("safety_flags", empty).alias("safety_flags"), "latency_s",
        *(F.coalesce(b, F.lit(0)).alias(b) for b in (*BUCKETS, "tokens")), F.coalesce("cost", F.lit(0)).cast("decimal(18,6)").alias("cost"), F.coalesce("cost_status", F.lit("unknown")).alias("cost_status"),
        F.coalesce("usage_source", F.lit("char_estimate")).alias("usage_source"), F.coalesce("models", empty).alias("models"),
    )
