"""Queries on events, states, rule corpora, integrity and parsing of records."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import failure_key, masked
from sievework.operators import gates, integrity, lifecycle, parsing, rollup, tickets
from sievework.operators.spans import scan_and_filter
from sievework.functions.detectors import MAX_SCAN_BYTES, Policy
from sievework.plans.common import INJECTED_SQL, injected, rows, table
from sievework.plans.filtering import scanned_sql
from sievework.session import shared_folder
from sievework.sources.readers import safe_json_lines, typed_scalar
from sievework.streaming.failures import batch_failure_log, stream_failure_log
from sievework.streaming.state import batch_states, files_stream, stream_states

STATUS = {"view": "pending", "click": "running", "purchase": "done", "error": "failed", "signup": "running"}
ALLOWED = {"view": ("view", "click"), "click": ("view", "purchase", "error"), "purchase": ("view",), "error": ("click", "signup"), "signup": ("view",)}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _status() -> F.Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in STATUS.items() for x in kv)), F.col("event_type"))


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", (F.col("event_id") % 4).alias("slot"), _status().alias("status"), F.when(F.col("event_type") == "error", F.concat(F.lit("e"), "event_id")).alias("error"), "ts", "event_id")
    grid = e.select("user_id").distinct().select("user_id", F.explode(F.array(*map(F.lit, range(5))).cast("array<bigint>")).alias("slot"))
    return lifecycle.cell_states(grid, e, ["user_id", "slot"], [F.col("ts"), F.col("event_id")])


def cell_state_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cells(spark, sf_dir)


_CASE = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS.items()) + " END"
_CELLS = f"""ev AS (SELECT user_id, event_id % 4 AS slot, {_CASE} AS status, CASE WHEN event_type = 'error' THEN 'e' || event_id END AS error, row_number() OVER (PARTITION BY user_id, event_id % 4 ORDER BY ts DESC, event_id DESC) AS n FROM events),
g AS (SELECT user_id, unnest([0, 1, 2, 3, 4])::BIGINT AS slot FROM (SELECT DISTINCT user_id FROM events)),
cells AS (SELECT user_id, slot, coalesce(status, 'pending') AS status, CASE WHEN status = 'failed' THEN error END AS error FROM g LEFT JOIN (SELECT * FROM ev WHERE n = 1) USING (user_id, slot))"""
CELL_STATE = f"WITH {_CELLS} SELECT user_id, slot, status, error FROM cells"


def progress_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.progress(_cells(spark, sf_dir), ["user_id"])


PROGRESS = f"WITH {_CELLS} SELECT user_id, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status IN ('pending', 'running')) AS open, count(*) FILTER (status IN ('pending', 'running')) = 0 AS complete FROM cells GROUP BY user_id"


def resume_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.to_run(_cells(spark, sf_dir), [F.col("user_id"), F.col("slot")], 25).select("user_id", "slot", "status")


RESUME_BATCH = f"WITH {_CELLS} SELECT user_id, slot, status FROM cells WHERE status IN ('pending', 'running') ORDER BY user_id, slot LIMIT 25"


def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") == "F", "completed").otherwise("open").alias("status"))
    return lifecycle.resume_points(steps, ["l_orderkey"], "l_linenumber", "status")


RESUME_POINT = "SELECT l_orderkey, min(l_linenumber) FILTER (l_linestatus <> 'F') AS resume_at FROM lineitem GROUP BY l_orderkey"


def transition_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("to_state", F.col("event_type"))
    lacks = F.array_compact(F.array(F.when(F.col("value") < 5, "value too small"), F.when((F.col("event_type") == "purchase") & (F.col("value") < 40), "purchase not covered")))
    found = lifecycle.guarded(e, ["user_id"], [F.col("ts"), F.col("event_id")], ALLOWED, "view", lacks)
    return found.select("event_id", "from_state", "to_state", F.array_join("missing", ",").alias("missing"), "allowed")


_PAIRS = ", ".join(f"'{a}>{b}'" for a, bs in ALLOWED.items() for b in bs)
TRANSITION_GUARD = f"""WITH e AS (SELECT event_id, user_id, ts, event_type AS to_state, array_to_string(list_filter([CASE WHEN value < 5 THEN 'value too small' END, CASE WHEN event_type = 'purchase' AND value < 40 THEN 'purchase not covered' END], lambda x: x IS NOT NULL), ',') AS missing FROM events),
l AS (SELECT event_id, to_state, missing, coalesce(list(CASE WHEN missing = '' THEN to_state ELSE '-' END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS before FROM e),
s AS (SELECT event_id, to_state, missing, list_reduce(list_prepend('view', before), lambda s, t: CASE WHEN (s || '>' || t) IN ({_PAIRS}) THEN t ELSE s END) AS from_state FROM l)
SELECT event_id, from_state, to_state, missing, missing = '' AND (from_state || '>' || to_state) IN ({_PAIRS}) AS allowed FROM s"""


def bug_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.cycles(_events(spark, sf_dir), ["user_id"], F.col("event_type") == "error", F.rlike("props", F.lit("(?i)\"k\": *[0-4]\\b")), 8)


BUG_CYCLES = "SELECT user_id, count(*) FILTER (event_type = 'error') AS cycles, count(*) FILTER (event_type = 'error' AND regexp_matches(props, '\"k\": *[0-4]\\b')) AS side_effects, count(*) FILTER (event_type = 'error') >= 8 AS blocked FROM events GROUP BY user_id"


def recurring_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where("event_type = 'error'").select("event_id", F.concat(F.lit("User "), "user_id", F.lit(" at 0xAF"), F.col("event_id") % 10, F.lit(" type "), F.col("event_id") % 3 + 7, F.when(F.col("event_id") % 3 == 0, " late").otherwise("")).alias("s"))
    return rollup.recurring(e, failure_key(F.col("s")), "event_id")


RECURRING = """SELECT 'user <n> at <hex> type <n>' || CASE WHEN event_id % 3 = 0 THEN ' late' ELSE '' END AS pattern, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events WHERE event_type = 'error' GROUP BY 1 HAVING count(*) >= 2"""


def numbered_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.numbered(_events(spark, sf_dir).where("event_type = 'error'"), ["user_id"], [F.col("ts"), F.col("event_id")]).select("event_id", "fail_id")


NUMBERED = "SELECT event_id, 'fail-' || repeat('0', greatest(0, 3 - length(n::VARCHAR))::INT) || n AS fail_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')"


def _failures(events: DataFrame) -> DataFrame:
    summary = F.concat(F.lit("Nil pointer in pool.go:"), F.col("event_id") % 1000, F.when(F.col("event_id") % 3 == 0, " at 0xAB12").when(F.col("event_id") % 3 == 1, " again"))
    return events.where("event_type IN ('error', 'click')").select(F.col("user_id").cast("string").alias("ticket"), "event_id", F.when(F.col("value") > 40, "EVALUATION").otherwise("DESIGN").alias("state"), F.col("event_type").alias("kind"), summary.alias("summary"))


def failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_failure_log(_failures(_events(spark, sf_dir)))


def streamed_failure_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same log, from a stream of the table's files."""
    stream = files_stream(spark, f"{sf_dir}/events.parquet")
    return stream_failure_log(spark, _failures(stream), f"{shared_folder(spark)}/failures-{uuid.uuid4().hex}")


FAILURE_LOG = """WITH f AS (SELECT user_id::VARCHAR AS ticket, event_id, CASE WHEN value > 40 THEN 'EVALUATION' ELSE 'DESIGN' END AS state, event_type AS kind, CASE event_id % 3 WHEN 0 THEN 'nil pointer in pool.go:<n> at <hex>' WHEN 1 THEN 'nil pointer in pool.go:<n> again' ELSE '' END AS pattern FROM events WHERE event_type IN ('error', 'click')),
n AS (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY event_id) AS total, row_number() OVER (PARTITION BY ticket, pattern ORDER BY event_id) AS occurrences, row_number() OVER (PARTITION BY ticket, state ORDER BY event_id) AS in_state, row_number() OVER (PARTITION BY ticket, kind ORDER BY event_id) AS of_kind FROM f)
SELECT ticket, event_id, 'fail-' || repeat('0', greatest(0, 3 - length(total::VARCHAR))::INT) || total AS fail_id, pattern, occurrences, occurrences > 1 AS recurring, in_state, of_kind, total FROM n"""


def resume_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as workspaces: their lines are steps, files and stages."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    state = F.element_at(F.array(*map(F.lit, ("IMPLEMENTATION", "ANALYSIS", "PLANNING", "DESIGN", "EVALUATION", "BLOCKED"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    key = F.col("l_orderkey").alias("ticket")
    steps = li.select(key, F.col("l_linenumber").alias("step_id"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("in_progress").alias("status"), F.concat(F.lit("at "), "l_partkey").alias("checkpoint"))
    name = F.element_at(F.array(*map(F.lit, ("analysis.md", "plan.md", "design-v2.md", "design-changelog.md", "notes.md"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    stage = F.element_at(F.array(*map(F.lit, lifecycle.EVALUATION_STAGES)), (F.col("l_partkey") % 4 + 1).cast("int"))
    found = lifecycle.resume_details(o.select(F.col("o_orderkey").alias("ticket"), state.alias("state")), steps, li.select(key, name.alias("name")), li.where("l_linenumber > 4").select(key, stage.alias("stage")))
    return found


RESUME_DETAILS = """WITH w AS (SELECT o_orderkey AS ticket, ['IMPLEMENTATION', 'ANALYSIS', 'PLANNING', 'DESIGN', 'EVALUATION', 'BLOCKED'][o_orderkey % 6 + 1] AS state FROM orders), s AS (SELECT l_orderkey AS ticket, min({'i': l_linenumber, 'c': 'at ' || l_partkey}) AS s FROM lineitem WHERE l_linestatus <> 'F' GROUP BY 1),
a AS (SELECT l_orderkey AS ticket, bool_or(l_partkey % 5 = 0) AS a, bool_or(l_partkey % 5 = 1) AS p, bool_or(l_partkey % 5 = 2) AS d, bool_or(l_partkey % 5 = 3) AS r FROM lineitem GROUP BY 1), e AS (SELECT l_orderkey AS ticket, max(l_partkey % 4 + 1) AS e FROM lineitem WHERE l_linenumber > 4 GROUP BY 1)
SELECT w.ticket, state, CASE WHEN state = 'IMPLEMENTATION' THEN s.s.i END AS step_id, CASE WHEN state = 'IMPLEMENTATION' THEN s.s.c END AS checkpoint,
 CASE state WHEN 'ANALYSIS' THEN CASE WHEN a THEN 'partial' ELSE 'fresh' END WHEN 'PLANNING' THEN CASE WHEN p THEN 'partial' ELSE 'fresh' END WHEN 'DESIGN' THEN CASE WHEN d AND NOT r THEN 'review_pending' WHEN d THEN 'partial' ELSE 'fresh' END END AS sub_status,
 CASE WHEN state = 'EVALUATION' THEN ['unit_test', 'lint', 'security', 'bench'][e] END AS last_stage, CASE WHEN state = 'EVALUATION' THEN ['unit_test', 'lint', 'security', 'bench'][coalesce(e, 0) + 1] END AS next_stage FROM w LEFT JOIN s USING (ticket) LEFT JOIN a USING (ticket) LEFT JOIN e USING (ticket)"""


def latency_by_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.latency(_events(spark, sf_dir), ["user_id"], "ts").select("user_id", F.round("latency_s", 3).alias("latency_s"))


LATENCY = "SELECT user_id, round(greatest(0, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 3) AS latency_s FROM events GROUP BY user_id"


def monitor_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lifecycle.monitor(_events(spark, sf_dir), "ts", F.col("value"), "2 days", 150.0)
    return m.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "samples", "mean", F.round("largest", 4).alias("largest"), "violations", "passes")


#: A time is in the window that it falls into by the microsecond; means are rounded from exact sums, halves away from zero.
MONITOR = """WITH e AS (SELECT time_bucket(INTERVAL 2 days, ts, TIMESTAMP '1970-01-01') AS w, value, TRY_CAST(value AS DECIMAL(18,6)) AS exact FROM events WHERE ts IS NOT NULL),
s AS (SELECT w, count(*) AS samples, (sum(exact) * 1000000)::HUGEINT AS micro, count(exact) AS n, avg(value) AS mean, count(value) AS n_values, round(max(value), 4) AS largest, count(*) FILTER (value > 150) AS violations FROM e GROUP BY w)
SELECT strftime(w, '%Y-%m-%d %H:%M:%S') AS start, samples, CASE WHEN n = n_values THEN sign(micro) * ((2 * abs(micro) + 100 * n) // (200 * n)) / 10000.0 ELSE round(mean, 4) END AS mean, largest, violations, violations = 0 AS passes FROM s"""


def comment_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    _events(spark, sf_dir).createOrReplaceTempView("comment_events")
    return spark.sql("SELECT event_type, user_id % 5 AS reviewer, count(*) AS n FROM comment_events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())")


COMMENT_DISTRIBUTION = "SELECT event_type, user_id % 5 AS reviewer, count(*) AS n FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 5), ())"


def newest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integrity.latest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], ["o_orderkey", "o_totalprice"])


NEWEST = "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1"


def safety_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_and_filter(injected(table(spark, sf_dir, "documents")), "text", Policy()).select("doc_id", "scan_result")
    j = found.join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flags = F.array_compact(F.array(F.when(F.col("scan_result").isin("REDACTED", "BLOCKED"), F.concat(F.lit("sensitive_"), F.lower("scan_result"))), F.when(F.col("toxic") == 1, "toxic"), F.when(F.col("quality") == 0, "low_quality")))
    return j.select("doc_id", F.array_join(flags, ";").alias("flags"))


#: A text is blocked by a blocking rule or its size, redacted by any other that redacts: whatever it says itself, besides what was appended.
SAFETY_FLAGS = "WITH " + INJECTED_SQL + ", " + scanned_sql("doc_inj", "doc_id") + f""", s AS (SELECT doc_id, CASE WHEN strlen(text) > {MAX_SCAN_BYTES} THEN 'BLOCKED' ELSE scan_result END AS scan_result FROM filtered)
SELECT doc_id, array_to_string(list_filter([CASE WHEN scan_result <> 'CLEAN' THEN 'sensitive_' || lower(scan_result) END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality = 0 THEN 'low_quality' END], lambda x: x IS NOT NULL), ';') AS flags FROM s LEFT JOIN labels USING (doc_id)"""


def integrity_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "supplier"))
    idle = integrity.missing(c.select("c_custkey"), o.select(F.col("o_custkey").alias("c_custkey")).distinct(), ["c_custkey"]).select(F.lit("no_orders").alias("problem"), F.col("c_custkey").cast("long").alias("key"))
    lost = integrity.missing(c.select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey"), n.select(F.col("s_nationkey").alias("n_nationkey")).distinct(), ["n_nationkey"]).select(F.lit("no_supplier").alias("problem"), F.col("c_custkey").cast("long").alias("key"))
    return idle.unionByName(lost)


INTEGRITY = "SELECT 'no_orders' AS problem, c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'no_supplier', c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)"


def pin_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as agents: by fives their file has no pin, another one, or theirs; one in seven isn't expected, one in eleven has no file."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    body = F.when(k % 5 == 0, "no pin").when(k % 5 == 1, "name: x\nmodel:   other\n").otherwise(F.concat(F.lit("---\nmodel: "), "c_mktsegment", F.lit("\n---")))
    pinned = c.where(k % 11 != 0).select("c_custkey", parsing.pinned_model(body).alias("model"))
    return integrity.drift(c.where(k % 7 != 0).select("c_custkey", F.col("c_mktsegment").alias("model")), pinned, "c_custkey", "model")


PIN_DRIFT = """SELECT c_custkey, problem FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 AND c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 11 = 0 THEN 'missing' WHEN c_custkey % 7 = 0 THEN 'unexpected' WHEN c_custkey % 5 < 2 THEN 'differs' END AS problem FROM customer) WHERE problem IS NOT NULL"""


def tool_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = rows(spark, "tool string", *((f"mcp__srv__t{i}",) for i in range(5)))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("a\nuse mcp__srv__t"), F.col("doc_id") % 7, F.lit(" now\n"), F.coalesce("text", F.lit(""))).alias("t"))
    lines = docs.select("doc_id", F.posexplode(F.split("t", "\n")).alias("i", "line")).select("doc_id", (F.col("i") + 1).alias("line_no"), F.explode(F.regexp_extract_all("line", F.lit("(mcp__[a-z]+__[a-z0-9_]+)"), F.lit(1))).alias("tool"))
    return integrity.missing(lines, known, ["tool"]).select("doc_id", "line_no", "tool")


TOOL_REFERENCES = """WITH l AS (SELECT doc_id, string_split('a' || chr(10) || 'use mcp__srv__t' || (doc_id % 7) || ' now' || chr(10) || coalesce(text, ''), chr(10)) AS l FROM documents), r AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS line_no FROM l),
t AS (SELECT doc_id, line_no, unnest(regexp_extract_all(line, 'mcp__[a-z]+__[a-z0-9_]+')) AS tool FROM r) SELECT doc_id, line_no, tool FROM t WHERE tool NOT IN ('mcp__srv__t0', 'mcp__srv__t1', 'mcp__srv__t2', 'mcp__srv__t3', 'mcp__srv__t4')"""


def settings_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    value, origin = integrity.resolved_setting(("explicit", F.when(k % 2 == 0, F.lit("x"))), ("env", F.when(k % 3 == 0, F.lit("")).when(k % 5 == 0, F.lit("e"))), ("detected", F.when(k % 7 == 0, F.lit("d"))))
    return table(spark, sf_dir, "customer").select("c_custkey", value.alias("value"), origin.alias("origin"), masked(F.when(k % 2 == 0, "API_TOKEN").otherwise("ROOT"), F.lit("v"), ("API_TOKEN",)).alias("shown"))


SETTINGS = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'x' WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'e' WHEN c_custkey % 7 = 0 THEN 'd' END AS value,
 CASE WHEN c_custkey % 2 = 0 THEN 'explicit' WHEN c_custkey % 3 <> 0 AND c_custkey % 5 = 0 THEN 'env' WHEN c_custkey % 7 = 0 THEN 'detected' ELSE 'none' END AS origin, CASE WHEN c_custkey % 2 = 0 THEN '********' ELSE 'v' END AS shown FROM customer"""


def merge_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = gates.failing([("shipped", F.col("o_orderstatus") == "F"), ("priced", F.col("o_totalprice") > 100_000), ("urgent", F.startswith("o_orderpriority", F.lit("1")))])
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(checks, ",").alias("missing"))


MERGE = "SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'shipped' END, CASE WHEN o_totalprice <= 100000 THEN 'priced' END, CASE WHEN NOT starts_with(o_orderpriority, '1') THEN 'urgent' END], lambda x: x IS NOT NULL), ',') AS missing FROM orders"


def severity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _events(spark, sf_dir).groupBy("user_id").agg(F.map_from_arrays(F.array(F.lit("critical"), F.lit("medium")), F.array(F.count_if(F.col("value") > 180), F.count_if(F.col("value") > 120))).alias("m"))
    return by.select("user_id", gates.severity_gate(F.col("m")).alias("gate"))


SEVERITY = "SELECT user_id, CASE WHEN count(*) FILTER (value > 180) > 0 THEN 'FAIL' WHEN count(*) FILTER (value > 120) > 0 THEN 'WARN' ELSE 'PASS' END AS gate FROM events GROUP BY user_id"


VERBS = ("add", "remove", "evict", "rebuild")


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A case for each order of two parts or more: the state it keeps, with its parts as the sites that must maintain it."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    verb = F.element_at(F.array(*map(F.lit, VERBS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    state = F.concat(F.lit("Order"), "l_orderkey")
    test = F.concat(F.lit("Test"), state, F.when(verb == "evict", "Pressure").otherwise("Sum"))
    action = F.when(verb.isin("remove", "evict"), "sub").otherwise(verb)
    site = F.struct("l_partkey", F.struct(F.concat(F.lit("part"), "l_partkey", F.lit("."), verb).alias("site"), action.alias("action"), test.alias("covered_by_test")).alias("s"))
    by = li.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(site)), lambda x: x["s"]).alias("sites")).where(F.size("sites") > 1)  # an order's parts
    steps = F.transform(F.sequence(F.lit(1), F.size("sites")), lambda i: F.concat(F.lit("## Step "), i.cast("string"), F.lit(": keep "), "l_orderkey"))
    tests = [F.concat(F.lit("Test"), state, F.lit(x)) for x in ("Sum", "Pressure")]
    return by.select(
        F.lower(state).alias("case_id"), "sites", tests[0].alias("invariant_test"), tests[1].alias("adversarial_test"), steps.alias("prose_steps"), F.size("sites").alias("contract_steps"),
        F.transform("sites", lambda s: s["site"]).alias("maintained"), F.array(*tests).alias("existing"),
    )


def contract_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.detection_summary(gates.mutant_findings(_cases(spark, sf_dir)))


#: Of each case: six hard mutants, two of which lose a test, which the old rules see too; a plan without its block; an undeclared site, which no rule sees.
CONTRACT_DETECTION = "SELECT category, mutants * n AS mutants, before * n AS detected_before, after * n AS detected_after, before * n AS flagged_before, after * n AS flagged_after FROM (VALUES ('clean', 1, 0, 0), ('hard', 6, 2, 6), ('soft', 1, 0, 1), ('residual', 1, 0, 0)) t(category, mutants, before, after), (SELECT count(*) AS n FROM (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_partkey) > 1))"

HEALTH, CALLS, OUTCOMES = ("serviceable", "degraded", "down"), ("get_for_task", "find_callers", "impact_analysis", "concurrency_impact", "semantic_search"), ("ok", "transient", "persistent")


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as runs: their events are calls, of which the last of each kind counts; errors of a high value last."""
    e, k = _events(spark, sf_dir), F.col("event_id")
    call = F.element_at(F.array(*map(F.lit, CALLS)), (k % len(CALLS) + 1).cast("int"))
    outcome = F.when(F.col("event_type") != "error", "ok").when(F.col("value") > 40, "persistent").otherwise("transient")
    last = e.select("user_id", call.alias("call"), outcome.alias("outcome"), k).groupBy("user_id", "call").agg(F.max_by("outcome", "event_id").alias("outcome"))
    runs = last.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("call", "outcome")))).alias("calls"))  # as many as kinds of calls
    health = F.element_at(F.array(*map(F.lit, HEALTH)), F.when(F.col("user_id") % 9 == 0, 3).when(F.col("user_id") % 9 == 1, 2).otherwise(1))
    return runs.select(F.col("user_id").alias("id"), health.alias("health"), "calls")


def backend_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = gates.backend_decisions(_scenarios(spark, sf_dir))
    return s.select("id", "before", "after", "silent_before", "silent_after", "over_block", F.array_join("missing_after", ",").alias("missing_after"))


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
BACKEND_POLICY = f"""WITH e AS (SELECT user_id, {_LIST(CALLS)}[event_id % 5 + 1] AS c, arg_max(CASE WHEN event_type <> 'error' THEN 'ok' WHEN value > 40 THEN 'persistent' ELSE 'transient' END, event_id) AS o FROM events GROUP BY 1, 2),
m AS (SELECT user_id AS id, user_id % 9 > 1 AS up, coalesce(string_agg(c, ',' ORDER BY c) FILTER (o = 'persistent' AND c <> 'semantic_search'), '') AS lost, coalesce(bool_or(o <> 'ok') FILTER (c <> 'semantic_search'), false) AS shaky FROM e GROUP BY user_id),
d AS (SELECT *, CASE WHEN up THEN 'CLEAN' ELSE 'BLOCKED' END AS before, CASE WHEN NOT up OR contains(lost, 'get_for_task') THEN 'BLOCKED' WHEN lost <> '' THEN 'DEGRADED' ELSE 'CLEAN' END AS after FROM m)
SELECT id, before, after, before = 'CLEAN' AND shaky AS silent_before, after = 'CLEAN' AND lost <> '' AS silent_after, up AND lost = '' AND after <> 'CLEAN' AS over_block, lost AS missing_after FROM d"""


def _tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ticket for every document, by fives: a stated feature, a bug by its words, a review with criteria, a release, and a bare text."""
    k = F.col("doc_id")
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[#*\\n-]", " ")
    bodies = F.array(
        F.concat(F.lit("## Work Type: New Feature\n## Background\n"), text, F.lit("\n### Scope\n- Module: a"), k, F.lit(", b ,\n- note\n## AC\n- [ ] one\n- [x] two: three\n")),
        F.concat(F.lit("bug, and its fix\n## Steps to  Reproduce\n- a\n* b\n## EXPECTED\nfine\n## Other\n"), text),
        F.concat(F.lit("**작업 유형**: 코드 리뷰\n## 리뷰 대상\n- core/"), k, F.lit("\n## 수용 기준\n"), text),
        F.concat(F.lit("## Type: Release\n## Version\nv2\n## Checklist\n- [X] Bench "), k, F.lit("\n## Changes\n"), F.when(k % 2 == 0, "- X-1: y").otherwise("")), text,
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.when(k % 3 == 0, F.concat(F.lit("ticket "), k)).alias("summary"), F.element_at(bodies, (k % 5 + 1).cast("int")).alias("description"))


def ticket_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _tickets(spark, sf_dir).select("doc_id", F.posexplode(tickets.ticket_sections(F.col("description"))).alias("pos", "s"))
    boxes = F.array_join(F.transform("s.checklist", lambda x: F.concat_ws("=", x["text"], x["checked"])), "|")
    pairs = F.array_join(F.transform("s.pairs", lambda x: F.concat(x["key"], F.lit("="), F.array_join(x["values"], "+"))), "|")
    return t.select("doc_id", "pos", "s.key", F.md5(F.encode("s.body", "UTF-8")).alias("body_md5"), boxes.alias("checklist"), F.array_join("s.bullets", "|").alias("bullets"), pairs.alias("pairs"))


_TICKETS = "t AS (SELECT doc_id, doc_id % 5 AS k, CASE WHEN doc_id % 3 = 0 THEN 'ticket ' || doc_id ELSE '' END AS summary, regexp_replace(coalesce(text, ''), '[#*' || chr(10) || '-]', ' ', 'g') AS x FROM documents)"
TICKET_SECTIONS = f"""WITH {_TICKETS}, s AS (SELECT doc_id, unnest(CASE k
 WHEN 0 THEN [{{'pos': 0, 'key': 'work type: new feature', 'body': '', 'c': '', 'b': '', 'p': ''}}, {{'pos': 1, 'key': 'background', 'body': x, 'c': '', 'b': '', 'p': ''}}, {{'pos': 2, 'key': 'scope', 'body': '- Module: a' || doc_id || ', b ,' || chr(10) || '- note', 'c': '', 'b': 'Module: a' || doc_id || ', b ,|note', 'p': 'modules=a' || doc_id || '+b'}}, {{'pos': 3, 'key': 'acceptance_criteria', 'body': '- [ ] one' || chr(10) || '- [x] two: three', 'c': 'one=false|two: three=true', 'b': '', 'p': ''}}]
 WHEN 1 THEN [{{'pos': 0, 'key': 'steps_to_reproduce', 'body': '- a' || chr(10) || '* b', 'c': '', 'b': 'a|b', 'p': ''}}, {{'pos': 1, 'key': 'expected', 'body': 'fine', 'c': '', 'b': '', 'p': ''}}, {{'pos': 2, 'key': 'other', 'body': x, 'c': '', 'b': '', 'p': ''}}]
 WHEN 2 THEN [{{'pos': 0, 'key': 'review_target', 'body': '- core/' || doc_id, 'c': '', 'b': 'core/' || doc_id, 'p': ''}}, {{'pos': 1, 'key': 'acceptance_criteria', 'body': x, 'c': '', 'b': '', 'p': ''}}]
 WHEN 3 THEN [{{'pos': 0, 'key': 'type: release', 'body': '', 'c': '', 'b': '', 'p': ''}}, {{'pos': 1, 'key': 'version', 'body': 'v2', 'c': '', 'b': '', 'p': ''}}, {{'pos': 2, 'key': 'checklist', 'body': '- [X] Bench ' || doc_id, 'c': 'Bench ' || doc_id || '=true', 'b': '', 'p': ''}},
  {{'pos': 3, 'key': 'changes', 'body': CASE WHEN doc_id % 2 = 0 THEN '- X-1: y' ELSE '' END, 'c': '', 'b': CASE WHEN doc_id % 2 = 0 THEN 'X-1: y' ELSE '' END, 'p': CASE WHEN doc_id % 2 = 0 THEN 'x-1=y' ELSE '' END}}]
 ELSE [] END) AS s FROM t)
SELECT doc_id, s.pos, s.key, md5(trim(s.body, ' ' || chr(9) || chr(13) || chr(10))) AS body_md5, s.c AS checklist, s.b AS bullets, s.p AS pairs FROM s"""


def parsed_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tickets.parsed_tickets(_tickets(spark, sf_dir))
    return t.select("doc_id", "work_type", "stated", "pipeline_variant", F.size("sections").alias("sections"), F.array_join("missing_fields", ",").alias("missing"), F.size("warnings").alias("warnings"))


PARSED_TICKETS = f"""WITH {_TICKETS}, g AS (SELECT *, lower(summary || chr(10) || x) AS low FROM t),
w AS (SELECT *, CASE k WHEN 0 THEN 'feature' WHEN 1 THEN 'bugfix' WHEN 2 THEN 'code_review' WHEN 3 THEN 'release' ELSE CASE WHEN len(regexp_extract_all(low, 'fix|bug|에러|버그|수정')) >= 2 THEN 'bugfix' WHEN regexp_matches(low, 'review|리뷰|검토') THEN 'code_review' WHEN regexp_matches(low, 'v1[.]|release|릴리즈|태그') THEN 'release' WHEN trim(low, ' ' || chr(10)) = '' THEN 'unknown' ELSE 'feature' END END AS work_type FROM g)
SELECT doc_id, work_type, k IN (0, 2, 3) AS stated, CASE work_type WHEN 'code_review' THEN 'review_only' WHEN 'release' THEN 'release' ELSE 'full' END AS pipeline_variant, [4, 3, 2, 4, 0][k + 1] AS sections,
 CASE k WHEN 0 THEN concat_ws(',', CASE WHEN summary = '' THEN 'summary' END, CASE WHEN trim(x, ' ' || chr(9) || chr(13)) = '' THEN 'requirements' END) WHEN 1 THEN concat_ws(',', CASE WHEN summary = '' THEN 'summary' END, 'actual', 'scope.modules')
  WHEN 2 THEN CASE WHEN summary = '' THEN 'summary' ELSE '' END WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN '' ELSE 'changes' END
  ELSE CASE work_type WHEN 'feature' THEN concat_ws(',', CASE WHEN summary = '' THEN 'summary' END, 'requirements', 'scope.modules') WHEN 'bugfix' THEN concat_ws(',', CASE WHEN summary = '' THEN 'summary' END, 'steps_to_reproduce', 'expected', 'actual', 'scope.modules') WHEN 'code_review' THEN concat_ws(',', CASE WHEN summary = '' THEN 'summary' END, 'review_target.files_or_modules') WHEN 'release' THEN 'version,changes' ELSE '' END END AS missing,
 CASE WHEN work_type = 'unknown' THEN 1 WHEN k = 2 AND trim(x, ' ' || chr(9) || chr(13)) <> '' THEN 1 WHEN k = 4 AND work_type = 'release' THEN 1 ELSE 0 END AS warnings FROM w"""


REPLIES = (
    '{"sufficient": "yes", "other": [9], "relevant_indices": [1, 3, 3.9, 9, "2"]}', 'I think [2] fits. Sufficient: NO\n{"relevant_indices": [4, 1], "relevant": true, "answer_present": false}', "nothing [1, 2]",
    'data: {"a": 1}\ndata: {"b": 2}', 'event: x\n{"c": 3}', 'cut off: {"relevant": TRUE, "relevant_indices": [2, 5, 77', '{"relevant_indices": "1, 2", "sufficient": 1}', 'broken {"relevant_indices": [5, 3, 5], }',
)


def reply_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply of each kind in the middle of every text of the benchmark."""
    reply = F.element_at(F.array(*map(F.lit, REPLIES)), (F.col("item_id") % len(REPLIES) + 1).cast("int"))
    text = F.concat(F.translate(F.coalesce("text", F.lit("")), "{}[]", "()()"), F.lit("\n"), reply)
    t = table(spark, sf_dir, "benchmark").select("item_id", text.alias("text"))
    keys = ("relevant", "sufficient", "answer_present")
    return t.select("item_id", parsing.verdict(F.col("text"), "sufficient").alias("said"), F.array_join(parsing.relevance(F.col("text"), F.lit(5)), ",").alias("relevant_ids"), parsing.first_rpc_object(F.col("text")).alias("rpc"), parsing.judgements(F.col("text"), keys).alias("j")).select("*", *(F.col(f"j.{k}").alias(k) for k in keys)).drop("j")


REPLY_PARSING = """SELECT item_id, said, relevant_ids, rpc, relevant, sufficient, answer_present FROM benchmark JOIN (VALUES
 (0, true, '1,3', '{"sufficient": "yes", "other": [9], "relevant_indices": [1, 3, 3.9, 9, "2"]}', false, true, false), (1, false, '1,4', '{"relevant_indices": [4, 1], "relevant": true, "answer_present": false}', true, false, false), (2, NULL, NULL, NULL, NULL, NULL, NULL),
 (3, NULL, NULL, '{"a": 1}', NULL, NULL, NULL), (4, NULL, NULL, '{"c": 3}', false, false, false), (5, NULL, NULL, NULL, true, false, false), (6, NULL, NULL, '{"relevant_indices": "1, 2", "sufficient": 1}', false, true, false),
 (7, NULL, '3,5', NULL, NULL, NULL, NULL)) t(k, said, relevant_ids, rpc, relevant, sufficient, answer_present) ON k = item_id % 8"""


def log_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A test log for every order, with a line for each of its lines."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    word = F.when(F.col("l_returnflag") == "R", "FAIL").when(F.col("l_returnflag") == "A", "SKIP").otherwise("PASS")
    line = F.concat(F.when(F.col("l_linenumber") % 2 == 0, "    ").otherwise(""), F.lit("--- "), word, F.lit(": Test"), "l_linenumber", F.lit(" (0.01s)"))
    logs = li.groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list(line)), "\n").alias("log"))
    extra = F.concat("log", F.when(k % 13 == 0, "\nWARNING: DATA RACE").otherwise(""), F.when(k % 3 == 0, F.concat(F.lit("\ncoverage: "), k % 100, F.lit(".5% of statements"))).otherwise(""))
    return logs.select("l_orderkey", parsing.test_tally(extra).alias("t")).select("l_orderkey", "t.*")


LOG_TALLY = """WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag NOT IN ('R', 'A')) AS passed, count(*) FILTER (l_returnflag = 'R') AS failed, count(*) FILTER (l_returnflag = 'A') AS skipped FROM lineitem GROUP BY l_orderkey)
SELECT *, l_orderkey % 13 = 0 AS race, CASE WHEN l_orderkey % 3 = 0 THEN l_orderkey % 100 + 0.5 END::DOUBLE AS coverage, CASE WHEN failed > 0 OR l_orderkey % 13 = 0 THEN 'FAIL' WHEN passed > 0 THEN 'PASS' ELSE 'UNKNOWN' END AS status FROM c"""


def _node(kind: str, *children: object, **attrs: object) -> dict:
    return {"type": kind, "content": list(children)} | ({"attrs": attrs} if attrs else {})


def _leaf(text: str, *marks: object) -> dict:
    return {"type": "text", "text": text, "marks": [m if isinstance(m, dict) else {"type": m} for m in marks]}


def _par(text: str) -> dict:
    return _node("paragraph", _leaf(text))


def _items(*texts: str) -> list[dict]:
    return [_node("listItem", _par(t)) for t in texts]


#: Trees and their markdown, by the format's rules (fixed values): what each kind of node gives, nested and at its edges.
TREES = (
    (_node("doc", _par("Hello world")), "Hello world"),
    (_node("doc", _node("heading", _leaf("Background"), level=2)), "## Background"),
    (_node("doc", _node("bulletList", *_items("first", "second"))), "- first\n- second"),
    (_node("doc", _node("orderedList", *_items("a", "b"))), "1. a\n2. b"),
    (_node("doc", _node("taskList", _node("taskItem", _leaf(" done "), state="DONE"), _node("taskItem", _leaf("todo"), state="TODO"))), "- [x] done\n- [ ] todo"),
    (_node("doc", _node("codeBlock", _leaf("package main"), language="go")), "```go\npackage main\n```"),
    (_node("doc", _node("paragraph", _leaf("bold", "strong"), _leaf(" and "), _leaf("italic", "em"))), "**bold** and *italic*"),
    (None, ""),
    (_node("doc", _node("panel", _par("in"), _node("rule"))), "in---"),
    (_node("doc", _node("heading", _leaf("deep"), level=9), _node("heading", _leaf("none"))), "###### deep\n\n# none"),
    (_node("doc", _node("paragraph", _leaf("a"), _node("hardBreak"), _leaf("b"))), "a  \nb"),
    (_node("doc", _node("paragraph", _node("mention", text="bob"), _leaf(" "), _node("mention", id="u1"), _leaf(" "), _node("mention"), _node("emoji", shortName=":x:"), _node("inlineCard", url="http://x"))), "@bob @u1 @mention:x:<http://x>"),
    (_node("doc", _node("table", _node("tableRow", _node("tableHeader", _par("h")), _node("tableHeader", _par("i"))), _node("tableRow", _node("tableCell", _par("1")), _node("tableCell", _par("2"))))), "h | i\n--- | ---\n1 | 2"),
    (_node("doc", _node("orderedList", _node("listItem", _par("a"), _node("bulletList", *_items("n", "m"))), *_items("b"))), "1. a\n  - n\n  - m\n2. b"),
    (_node("doc", _node("blockquote", _par("one"), _par("two"))), "> one\n> two"),
    (_node("doc", _node("paragraph", _leaf("l", "code", {"type": "link", "attrs": {"href": "u"}}, "strike", "other"), _leaf("plain", {"type": "link"}))), "~~[`l`](u)~~[plain]()"),
)


def tree_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of each kind for every part of the table."""
    trees = F.array(*(F.lit(json.dumps(t)) for t, _ in TREES))
    p = table(spark, sf_dir, "part").select("p_partkey", F.element_at(trees, (F.col("p_partkey") % len(TREES) + 1).cast("int")).alias("tree"))
    return p.select("p_partkey", parsing.tree_to_markdown(F.col("tree")).alias("markdown"))


TREE_MARKDOWN = "SELECT p_partkey, m AS markdown FROM part JOIN (VALUES " + ", ".join(f"({i}, '{m}')" for i, (_, m) in enumerate(TREES)) + f") t(k, m) ON k = p_partkey % {len(TREES)}"


def paragraph_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(parsing.tree_to_markdown(parsing.paragraph_tree(F.trim("text"))).cast("binary")).alias("text_md5"))


PARAGRAPH_TREES = "SELECT item_id, md5(trim(text, ' ')) AS text_md5 FROM benchmark"


def json_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits for every order, one for each line with another place inside; one order in ten has no JSON."""
    li = table(spark, sf_dir, "lineitem")
    inner = F.struct(F.array(F.struct(F.concat(F.lit("s"), "l_suppkey").alias("file"), F.lit("x").alias("start_line"))).alias("near"))
    hit = F.struct(F.col("l_linenumber").alias("n"), F.concat(F.lit("p"), "l_partkey").alias("file"), F.col("l_linenumber").alias("start_line"), F.when(F.col("l_linenumber") != 2, F.col("l_linenumber") + 5).alias("end_line"), inner.alias("more"))
    o = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(hit)).alias("hits"))
    text = F.when(F.col("l_orderkey") % 10 == 0, "not json").otherwise(F.to_json(F.struct("hits", F.lit(1).alias("x"))))
    return parsing.collected_locations(o.select("l_orderkey", text.alias("j")), "l_orderkey", "j")


JSON_LOCATIONS = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, 'p' || l_partkey, 's' || l_suppkey) - 1 AS i FROM lineitem WHERE l_orderkey % 10 <> 0)
SELECT l_orderkey, (2 * i)::INT AS pos, 'p' || l_partkey AS file, l_linenumber AS start_line, CASE WHEN l_linenumber <> 2 THEN l_linenumber + 5 END AS end_line FROM l UNION ALL SELECT l_orderkey, (2 * i + 1)::INT, 's' || l_suppkey, NULL, NULL FROM l"""


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _events(spark, sf_dir).select(F.when(F.col("event_id") % 50 == 0, F.lit('{"k": ')).when(F.col("event_id") % 51 == 0, F.lit("  ")).otherwise(F.col("props")).alias("value"))
    return safe_json_lines(lines, "value", "k int").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


EVENT_LINES = "SELECT (props->>'k')::INT AS k, count(*) AS n FROM events WHERE event_id % 50 <> 0 AND event_id % 51 <> 0 GROUP BY 1"


def scalar_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By sevens a word for nothing, a flag, a whole number, another number, a text, or nothing, of every order."""
    k = F.col("o_orderkey")
    v = F.element_at(F.array(F.lit("null"), F.lit("~"), F.when(k % 2 == 0, "True").otherwise("false"), k.cast("string"), F.concat(k % 100, F.lit(".5")), F.col("o_orderpriority"), F.lit("")), (k % 7 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", typed_scalar(v).alias("t")).select("o_orderkey", "t.*")


SCALAR_TYPES = """SELECT o_orderkey, ['null', 'null', 'bool', 'int', 'float', 'str', 'null'][o_orderkey % 7 + 1] AS kind, CASE WHEN o_orderkey % 7 = 2 THEN o_orderkey % 2 = 0 END AS b, CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey END AS i,
 CASE WHEN o_orderkey % 7 = 4 THEN o_orderkey % 100 + 0.5 END::DOUBLE AS d, CASE WHEN o_orderkey % 7 = 5 THEN o_orderpriority END AS s FROM orders"""


def event_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    spaces = _events(spark, sf_dir).select("user_id").distinct().select("user_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("space")).withColumn("state", F.when((F.col("space") == "b") & (F.col("user_id") % 2 == 0), "COMPLETED").otherwise("OPEN"))
    return lifecycle.fan_out(_events(spark, sf_dir), spaces, "user_id").groupBy("user_id", "space").agg(F.count(F.lit(1)).alias("n"))


FAN_OUT = "SELECT user_id, space, count(*) AS n FROM events, (VALUES ('a'), ('b')) s(space) WHERE NOT (space = 'b' AND user_id % 2 = 0) GROUP BY user_id, space"


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stream_states(spark, f"{sf_dir}/events.parquet")


def stream_state_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_states(_events(spark, sf_dir))


STREAM_STATE = "SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'error') AS failures, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id"

_SQL = {
    cell_state_latest: CELL_STATE, progress_counts: PROGRESS, resume_batch: RESUME_BATCH, resume_point: RESUME_POINT, transition_guard: TRANSITION_GUARD, bug_cycles: BUG_CYCLES, recurring_failures: RECURRING, numbered_failures: NUMBERED, failure_log: FAILURE_LOG, streamed_failure_log: FAILURE_LOG, resume_details: RESUME_DETAILS,
    latency_by_task: LATENCY, monitor_window: MONITOR, comment_distribution: COMMENT_DISTRIBUTION, newest_per_key: NEWEST, safety_flags: SAFETY_FLAGS, integrity_antijoin: INTEGRITY, pin_drift: PIN_DRIFT, tool_references: TOOL_REFERENCES,
    settings_resolution: SETTINGS, merge_preconditions: MERGE, severity_gate: SEVERITY, contract_detection: CONTRACT_DETECTION, backend_policy: BACKEND_POLICY, ticket_sections: TICKET_SECTIONS, parsed_tickets: PARSED_TICKETS, reply_parsing: REPLY_PARSING, log_tally: LOG_TALLY,
    tree_markdown: TREE_MARKDOWN, paragraph_trees: PARAGRAPH_TREES, json_locations: JSON_LOCATIONS, event_lines: EVENT_LINES, scalar_types: SCALAR_TYPES, event_fan_out: FAN_OUT, stream_state: STREAM_STATE, stream_state_batch: STREAM_STATE,
}
QUERIES = {f.__name__: f for f in _SQL}
ORACLE = {f.__name__: s for f, s in _SQL.items()}
