"""Queries on issues, workspaces, runs, set-up and cells of experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import failure_key, info_volume, safe_double, safe_long
from sievework.operators import compositions, evaluation, gates, lifecycle, ranking, records, rollup, runs
from sievework.operators.parsing import paragraph_tree
from sievework.operators.scoring import reference_verdicts
from sievework.plans.common import rows, table
from sievework.plans.lifecycle import BACKEND_POLICY
from sievework.sources.readers import replay_key, upsert_latest
from sievework.sources.text_index import words_of

_STATES = ("TICKET_INTAKE", "EVALUATION_PASS", "EVALUATION_FAIL", "BLOCKED", "COMPLETED", "COMPLETION", "")


def _pick(values: tuple, index: F.Column) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def _list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


def issue_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    name = lambda x, c: F.when(c, F.struct(x.alias("name")))
    status = F.when(k % 7 != 0, F.struct(F.col("o_orderstatus").alias("name"), F.when(k % 3 != 0, F.struct(F.lower("o_orderstatus").alias("key"))).alias("statusCategory")))
    fields = F.struct(
        name(F.col("o_orderpriority"), k % 5 != 0).alias("issuetype"), F.concat(F.lit("order "), k).alias("summary"), paragraph_tree(F.col("o_orderpriority")).alias("description"), F.when(k % 4 != 0, F.struct(F.col("o_custkey").cast("string").alias("displayName"))).alias("assignee"),
        status.alias("status"), F.when(k % 6 != 0, F.array(F.lit("a"), F.col("o_orderstatus"))).alias("labels"), F.lit("c").alias("created"), F.lit("u").alias("updated"),
    )
    raw = table(spark, sf_dir, "orders").select(F.concat(F.lit("ORD-"), k).alias("key"), fields.alias("fields"))
    out = records.normal_issue(raw)
    return out.withColumn("labels", F.array_join("labels", ","))


ISSUE_RECORDS = """SELECT 'ORD-' || o_orderkey AS ticket_id, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority ELSE 'Unknown' END AS type, 'order ' || o_orderkey AS summary, o_orderpriority AS description, CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey::VARCHAR ELSE '' END AS assignee,
 CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus ELSE 'Unknown' END AS status, CASE WHEN o_orderkey % 7 <> 0 AND o_orderkey % 3 <> 0 THEN lower(o_orderstatus) ELSE 'unknown' END AS status_category, CASE WHEN o_orderkey % 6 <> 0 THEN 'a,' || o_orderstatus ELSE '' END AS labels, 'c' AS created, 'u' AS updated FROM orders"""


def comments_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created"), F.when(F.col("user_id") % 4 != 0, F.struct(F.concat(F.lit("u"), "user_id").alias("displayName"))).alias("a"))
    start = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("2024-01-1"), F.col("user_id") % 10))
    return records.since(c, "created", start).select("event_id", "created", records.author_name(F.col("a")).alias("author"))


COMMENTS_SINCE = "SELECT event_id, created, CASE WHEN user_id % 4 <> 0 THEN 'u' || user_id ELSE 'Unknown' END AS author FROM (SELECT *, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created FROM events) WHERE user_id % 3 = 0 OR created >= '2024-01-1' || (user_id % 10)"


def issue_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.search(table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_orderkey", "o_totalprice")


ISSUE_SEARCH = "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50"

_HTTP = {"view": 429, "click": 200, "purchase": None, "error": 404, "signup": 401}


def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.lit(None).cast("int")
    for k, v in _HTTP.items():
        code = F.when(F.col("event_type") == k, F.lit(v).cast("int")).otherwise(code)
    e = table(spark, sf_dir, "events").withColumn("request", F.concat_ws("-", "user_id", F.floor(F.col("event_id") / 40)))
    return records.retried(e, "request", [F.col("ts"), F.col("event_id")], code)


RETRY = """WITH e AS (SELECT user_id || '-' || (event_id // 40) AS request, row_number() OVER (PARTITION BY user_id, event_id // 40 ORDER BY ts, event_id) AS n, CASE event_type WHEN 'view' THEN 429 WHEN 'click' THEN 200 WHEN 'error' THEN 404 WHEN 'signup' THEN 401 END AS status FROM events),
r AS (SELECT request, max(n) AS last, min(n) FILTER (coalesce(status, 429) <> 429) AS stop, arg_min(status, n) FILTER (coalesce(status, 429) <> 429) AS status FROM e WHERE n <= 3 GROUP BY request)
SELECT request, CASE WHEN stop IS NULL THEN CASE WHEN last >= 3 THEN 'exhausted' ELSE 'open' END WHEN status = 401 THEN 'unauthorized' WHEN status = 404 THEN 'not_found' ELSE 'ok' END AS outcome, coalesce(stop, last) AS attempts, 2.0 ** (coalesce(stop, last) - 1) - 1 AS waited_s FROM r"""


def pass_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _pick(_STATES, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", records.outcome_of(state).alias("correct"))


PASS_STATES = f"SELECT o_orderkey, CASE WHEN s IN ('EVALUATION_PASS', 'COMPLETED', 'COMPLETION') THEN true WHEN s IN ('EVALUATION_FAIL', 'BLOCKED') THEN false END AS correct FROM (SELECT o_orderkey, {_list(_STATES)}[o_orderkey % 7 + 1] AS s FROM orders)"


def _workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workspace for each event."""
    k = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("T-"), k).alias("ticket"), _pick(_STATES, k * 3 + F.col("user_id")).alias("state"), _pick(("auto", "interactive", None), k).alias("mode"), (k % 5).alias("cycle"), (k % 4).alias("max_cycles"), F.col("ts").alias("touched"), "user_id", "event_id",
    )


_WORKSPACES = f"w AS (SELECT 'T-' || event_id AS ticket, {_list(_STATES)}[(event_id * 3 + user_id) % 7 + 1] AS state, ['auto', 'interactive', NULL][event_id % 3 + 1] AS mode, event_id % 5 AS cycle, event_id % 4 AS max_cycles, ts AS touched, user_id, event_id FROM events)"


def active_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.active(_workspaces(spark, sf_dir), "state", [F.col("touched").desc(), F.col("ticket")]).select("ticket", "state")


ACTIVE = f"WITH {_WORKSPACES} SELECT ticket, state FROM w WHERE state NOT IN ('', 'COMPLETED', 'COMPLETION') ORDER BY touched DESC, ticket LIMIT 5"


def auto_continue(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _workspaces(spark, sf_dir)
    now = w.agg(F.max("touched").alias("now"))  # one row
    both = w.join(F.broadcast(now), F.lit(True))
    return records.to_continue(both, F.col("now"), 7 * 86_400, F.col("user_id") % 11 < 5).select("ticket", "state")


AUTO_CONTINUE = f"WITH {_WORKSPACES} SELECT ticket, state FROM w WHERE touched >= (SELECT max(touched) FROM w) - INTERVAL 7 DAY AND state NOT IN ('', 'COMPLETED', 'COMPLETION', 'BLOCKED') AND mode = 'auto' AND user_id % 11 >= 5 AND greatest(cycle, 1) <= CASE max_cycles WHEN 0 THEN 3 ELSE max_cycles END ORDER BY touched DESC, ticket LIMIT 1"


def review_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return records.next_number(table(spark, sf_dir, "customer"), o, "c_custkey")


REVIEW_NUMBERS = "SELECT c_custkey, count(o_orderkey) + 1 AS number FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey"


def last_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_shipdate") + F.make_dt_interval("l_linenumber"))
    by = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_shipdate").alias("started"), done.alias("ended"))).alias("s"))  # an order's lines
    return by.select("l_orderkey", F.date_format(records.last_activity(F.col("s"), ("started", "ended")), "yyyy-MM-dd HH:mm:ss").alias("at"))


LAST_ACTIVITY = "SELECT l_orderkey, strftime(max(CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + to_days(l_linenumber) ELSE l_shipdate END), '%Y-%m-%d %H:%M:%S') AS at FROM lineitem GROUP BY l_orderkey"


def record_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, times and numbers out of loose fields."""
    k = F.col("c_custkey")
    times = ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05+02:00", "2024-01-02 03:04:05", "2024-13-02T00:00:00Z", "soon", "", None)
    loose = ("12", "-3", " 7 ", "1.5", "x", "", None)
    at = records.iso_time(_pick(times, k))
    x = _pick(loose, k)
    return table(spark, sf_dir, "customer").select(
        "c_custkey", records.first_count(F.when(k % 2 == 0, k % 3), F.when(k % 5 != 0, k), F.lit(9)).alias("tokens"), F.unix_timestamp(at).alias("epoch_s"), safe_double(x).alias("as_double"), safe_long(x).alias("as_long"), info_volume(safe_long(x)).cast("long").alias("volume"),
    )


RECORD_VALUES = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 AND c_custkey % 3 <> 0 THEN c_custkey % 3 WHEN c_custkey % 5 <> 0 THEN c_custkey ELSE 9 END AS tokens, [1704164645, 1704157445, 1704164645, NULL, NULL, NULL, NULL][c_custkey % 7 + 1] AS epoch_s,
 [12.0, -3.0, 7.0, 1.5, 0.0, 0.0, 0.0][c_custkey % 7 + 1]::DOUBLE AS as_double, [12, -3, 7, 1, 0, 0, 0][c_custkey % 7 + 1] AS as_long, [12, 0, 7, 1, 0, 0, 0][c_custkey % 7 + 1] AS volume FROM customer"""

_STOP = ("the", "and", "for", "with")


def query_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.array_join(records.identifiers(F.coalesce("text", F.lit("")), _STOP), ",").alias("terms"))


QUERY_IDENTIFIERS = f"WITH t AS (SELECT item_id, list_filter(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x) NOT IN {_STOP}) AS l FROM benchmark) SELECT item_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:6], ',') AS terms FROM t"


def secret_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff that adds every part's name as a literal, under names that tell of secrets or not."""
    name = _pick(("apiToken", "db_password", "title", "PRIVATE_KEY_PEM", "tokenless"), F.col("p_partkey"))
    diff = F.concat(F.lit("+++ b/x.go\n-oldSecret = \"0123456789abcdef\"\n+  "), name, F.lit(" := \""), F.col("p_name"), F.lit("\"; other_key = '"), F.col("p_type"), F.lit("' + x\n+secret: 'short'\n"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(records.secret_literals(diff), ",").alias("names"))


SECRET_LITERALS = "SELECT p_partkey, concat_ws(',', CASE WHEN length(p_name) >= 16 AND p_partkey % 5 <> 2 THEN ['apiToken', 'db_password', 'title', 'PRIVATE_KEY_PEM', 'tokenless'][p_partkey % 5 + 1] END, CASE WHEN length(p_type) >= 16 THEN 'other_key' END) AS names FROM part"


def failure_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("state"), F.concat(F.lit("t"), F.col("event_id") % 3).alias("type"))
    s = records.failure_summary(e, "user_id", ("state", "type"))
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string"))), ",")
    return s.select("user_id", "total", shown("by_state").alias("by_state"), shown("by_type").alias("by_type"))


FAILURE_SUMMARIES = """WITH a AS (SELECT user_id, string_agg(k || '=' || n, ',' ORDER BY k) AS by_state, sum(n)::BIGINT AS total FROM (SELECT user_id, event_type AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id),
b AS (SELECT user_id, string_agg(k || '=' || n, ',' ORDER BY k) AS by_type FROM (SELECT user_id, 't' || (event_id % 3) AS k, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id) SELECT user_id, total, by_state, by_type FROM a JOIN b USING (user_id)"""


def discovery_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.first_seen(table(spark, sf_dir, "events"), "event_type", "event_id").select("event_type", "first", "place")


DISCOVERY = "SELECT event_type, min(event_id) AS first, row_number() OVER (ORDER BY min(event_id)) AS place FROM events GROUP BY event_type"


def detected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer the first of three paths that exists."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    tried = c.select("key", F.posexplode(F.array(F.lit("bin/a"), F.lit("bin/b"), F.lit("c"))).alias("priority", "p")).select("key", "priority", F.concat("p", F.lit("/"), "key").alias("path"))
    there = c.select(F.concat(F.when(F.col("key") % 2 == 0, "bin/b/").when(F.col("key") % 3 == 0, "bin/a/").otherwise("x/"), "key").alias("path")).unionByName(c.where("key % 5 <> 0").select(F.concat(F.lit("c/"), "key").alias("path")))
    return records.detected(tried, there)


DETECTED_PATHS = "SELECT c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN 'bin/b/' WHEN c_custkey % 3 = 0 THEN 'bin/a/' ELSE 'c/' END || c_custkey AS path FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 OR c_custkey % 5 <> 0"


def allow_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return records.allow_merged(p.where("p_size < 20").select(F.col("p_type").alias("entry")), p.where("p_size >= 10").select(F.col("p_type").alias("entry")))


ALLOW_LISTS = "SELECT p_type AS entry, NOT bool_or(p_size < 20) AS added FROM part WHERE p_size IS NOT NULL GROUP BY p_type"


def format_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that one or the other formatter would change, each once."""
    p = table(spark, sf_dir, "part")
    return p.where("p_partkey % 2 = 0").select("p_brand").union(p.where("p_partkey % 3 = 0").select("p_brand")).distinct()


FORMAT_VIOLATIONS = "SELECT DISTINCT p_brand FROM part WHERE p_partkey % 2 = 0 OR p_partkey % 3 = 0"


def setup_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    packs = F.when(k % 3 == 0, F.array(F.lit("solo"))).otherwise(F.array(F.lit("beta"), F.lit("alpha"), F.lit("")))
    name = F.when(k % 4 == 0, "my-beta-repo").otherwise("plain")
    remote = F.when(k % 5 == 0, "git@host:alpha/x")
    mode = records.autonomy(F.when(k % 2 == 0, "local").otherwise("tracker"))
    health = records.carried_health(_pick(("ok", "degraded", "down"), k), F.when(k % 7 == 0, F.array(F.lit("z"), F.lit("a"))).otherwise(F.expr("cast(array() as array<string>)")))
    seeds = records.impact_seeds(F.array(F.lit("A"), F.when(k % 2 == 0, "").otherwise("B"), F.lit("A"), F.lit(None), F.lit("C"), F.lit("D")))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", records.project_of(F.when(k % 11 == 0, "forced"), packs, name, remote).alias("project"), records.readiness(k % 2, k % 3).alias("ready"), mode["mode"].alias("mode"), mode["on_failure"].alias("on_failure"),
        health["serviceable"].alias("serviceable"), health["degraded"].alias("degraded"), F.array_join(health["missing"], ",").alias("missing"), health["widen"].alias("widen"), F.array_join(seeds, ",").alias("seeds"),
    )


SETUP_CHECKS = """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'forced' WHEN c_custkey % 3 = 0 THEN 'solo' WHEN c_custkey % 5 = 0 THEN 'alpha' WHEN c_custkey % 4 = 0 THEN 'beta' END AS project, CASE WHEN c_custkey % 6 = 0 THEN 'READY' ELSE 'NOT_READY' END AS ready,
 CASE WHEN c_custkey % 2 = 0 THEN 'auto' ELSE 'interactive' END AS mode, CASE WHEN c_custkey % 2 = 0 THEN 'escalate' ELSE 'halt' END AS on_failure, c_custkey % 3 <> 2 AS serviceable, c_custkey % 3 = 1 OR c_custkey % 7 = 0 AS degraded, CASE WHEN c_custkey % 7 = 0 THEN 'a,z' ELSE '' END AS missing,
 c_custkey % 3 <> 0 OR c_custkey % 7 = 0 AS widen, CASE WHEN c_custkey % 2 = 0 THEN 'A,C,D' ELSE 'A,B,C' END AS seeds FROM customer"""


def run_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    results = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    shots = e.select("user_id", "ts", F.col("event_id").alias("index_id"), F.col("event_type").alias("status"))
    return records.with_identity(results, shots, "user_id", "ts").select("user_id", "c_mktsegment", F.col("identity.index_id").alias("index_id"), F.col("identity.status").alias("status"))


RUN_IDENTITIES = "WITH s AS (SELECT user_id, event_id AS index_id, event_type AS status, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) SELECT c_custkey AS user_id, c_mktsegment, index_id, status FROM customer LEFT JOIN s ON user_id = c_custkey AND n = 1"


def scoped_processes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pid"), "p_size")
    return records.processes_to_end(p.where("p_size > 10"), p.where("pid % 3 = 0"), p.where("pid % 50 = 1"))


SCOPED_PROCESSES = "SELECT p_partkey AS pid FROM part WHERE p_size > 10 AND p_partkey % 3 <> 0 AND p_partkey % 50 <> 1"


def manifest_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("bucket"))
    one = records.selected(o, buckets=("F", "O"))
    return one.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).unionByName(records.selected(o, ids=(1, 2, 3), buckets=("F", "O", "P")).select(F.lit("by id").alias("bucket"), F.col("id").alias("n")))


MANIFEST = "SELECT o_orderstatus AS bucket, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1 UNION ALL SELECT 'by id', o_orderkey FROM orders WHERE o_orderkey IN (1, 2, 3) AND o_orderstatus IN ('F', 'O', 'P')"


def question_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("question_id"), F.when(F.col("quality") == 1, "done").otherwise("open").alias("status"))
    known = table(spark, sf_dir, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("question_id"), "source")
    return records.with_question(cells, known).select("question_id", "source", "status", "error")


QUESTION_LOOKUP = "SELECT l.doc_id AS question_id, source, CASE WHEN d.doc_id IS NULL THEN 'failed' WHEN quality = 1 THEN 'done' ELSE 'open' END AS status, CASE WHEN d.doc_id IS NULL THEN 'question ' || l.doc_id || ' not in index' END AS error FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'fr') d USING (doc_id)"


def commit_workspaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as commits; nations as workspaces of twenty tickets, of which every other one has a state."""
    c = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("commit_id"), (F.col("o_custkey") % 22).alias("ticket"))
    k = F.col("n_nationkey")
    w = table(spark, sf_dir, "nation").select((k % 20).cast("long").alias("ticket"), F.col("n_name").alias("workspace"), F.when(k % 2 == 0, "OPEN").alias("state"), (k % 3).alias("touched"))
    return records.logged_to(c, w, "touched")


COMMIT_WORKSPACES = """WITH w AS (SELECT n_nationkey % 20 AS ticket, n_name AS workspace, n_nationkey % 2 = 0 AS live, row_number() OVER (PARTITION BY n_nationkey % 20 ORDER BY n_nationkey % 3 DESC, n_name DESC) AS n FROM nation)
SELECT o_orderkey AS commit_id, o_custkey % 22 AS ticket, workspace FROM orders JOIN w ON (o_custkey % 22 < 20 AND w.ticket = o_custkey % 22 AND n = 1) OR (o_custkey % 22 >= 20 AND live)"""


def replayed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as prompts: by fours not recorded, recorded by the full key, by its first 16 digits, or by the index, for which a second recording under the digits doesn't count."""
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), F.concat(F.lit("role "), F.coalesce("role", F.lit(""))).alias("system"), F.concat("conv_id", F.lit(" "), "turn", F.lit(" "), F.coalesce("text", F.lit(""))).alias("user"), (F.col("conv_id") + F.col("turn")).alias("k"))
    key = replay_key(F.col("system"), F.col("user"))
    fixture = lambda where, name, said: c.where(where).select(name.alias("name"), F.concat(F.lit(said), "id").alias("response"), F.col("k").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"))
    named = F.concat(F.lit("f-"), "id")
    fixtures = fixture("k % 4 = 1", key, "answer ").unionByName(fixture("k % 4 = 2", F.substring(key, 1, 16), "answer ")).unionByName(fixture("k % 4 = 3", named, "answer ")).unionByName(fixture("k % 4 = 3", F.substring(key, 1, 16), "other "))
    return records.replayed(c, fixtures, c.where("k % 4 = 3").select(key.alias("key"), named.alias("name")), strict=False).drop("error")


REPLAYED = """SELECT conv_id || '/' || turn AS id, CASE WHEN (conv_id + turn) % 4 <> 0 THEN 'answer ' || conv_id || '/' || turn ELSE '{"answer": "REPLAY_PLACEHOLDER", "citations": []}' END AS response, CASE WHEN (conv_id + turn) % 4 <> 0 THEN conv_id + turn ELSE 100 END AS input_tokens, CASE WHEN (conv_id + turn) % 4 <> 0 THEN 1 ELSE 20 END AS output_tokens FROM conversations"""


def contract_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for every order, whose steps are its lines: as a block, in flow style, with a quoted key and comments, behind a block
    that is no YAML, without a list, or none."""
    line = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"))
    o = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("steps"))
    each = lambda form, between: F.array_join(F.transform("steps", lambda s: F.format_string(form, s["n"], s["p"])), between)
    plans = (
        F.concat(F.lit("text\n```yaml\n# c\nsteps:\n"), each("  - id: %d\n    part: %d", "\n"), F.lit("\n```\n")),
        F.concat(F.lit("```yaml\n- a\n- b\n```\n```yml\n{steps: ["), each("{id: %d, part: %d}", ", "), F.lit("], n: 1}\n```")),
        F.concat(F.lit('```yaml\n"steps": # c\n'), each("- {id: %d, part: %d} # x", "\n"), F.lit("\n```\n")),
        F.concat(F.lit("```yaml\nsteps: [1\n```\n```yaml\nderived_state: sum\nsites:\n- s\n```\n```yaml\nsteps:\n"), each("- id: %d\n  part: %d", "\n"), F.lit("\n```")),
        F.lit("```yaml\nsteps: none\n```\n"), F.lit("no block"),
    )
    plan = F.lit(None).cast("string")
    for k, form in enumerate(plans):  # of an array all would be made for each order
        plan = F.when(F.pmod("l_orderkey", F.lit(6)) == k, form).otherwise(plan)
    blocks = records.yaml_blocks(plan).alias("blocks")
    first = lambda c: F.md5(F.encode(c, "UTF-8"))
    found = o.select("l_orderkey", blocks)
    return found.select("l_orderkey", F.size("blocks").alias("blocks"), first(records.contract_block(F.col("blocks"), ("steps",))).alias("plan_md5"), first(records.contract_block(F.col("blocks"), ("sites",), ("derived_state",))).alias("sites_md5"))


CONTRACT_BLOCKS = """WITH o AS (SELECT l_orderkey, l_orderkey % 6 AS k, '{"steps":[' || string_agg('{"id":' || l_linenumber || ',"part":' || l_partkey || '}', ',' ORDER BY l_linenumber, l_partkey) || ']' AS j FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, [1, 1, 1, 2, 1, 0][k + 1] AS blocks, CASE WHEN k IN (0, 2, 3) THEN md5(j || '}') WHEN k = 1 THEN md5(j || ',"n":1}') END AS plan_md5, CASE WHEN k = 3 THEN md5('{"derived_state":"sum","sites":["s"]}') END AS sites_md5 FROM o"""


def rendered_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for every order, with its parts as steps."""
    n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.concat(F.lit("part "), "l_partkey"))).alias("steps"))
    shown = records.plan_markdown(F.concat(F.lit("Order "), "l_orderkey"), F.col("steps"))
    return n.select("l_orderkey", F.md5(F.encode(shown, "UTF-8")).alias("plan_md5"), F.size(records.yaml_blocks(shown)).alias("blocks"))


RENDERED_PLANS = """WITH d AS (SELECT DISTINCT l_orderkey, 'part ' || l_partkey AS p FROM lineitem), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS i FROM d)
SELECT l_orderkey, md5('# Order ' || l_orderkey || chr(10) || chr(10) || string_agg('## Step ' || i || ': ' || p, chr(10) ORDER BY i) || chr(10) || chr(10) || '```yaml' || chr(10) || 'steps:' || chr(10) || string_agg('  - ' || p, chr(10) ORDER BY i) || chr(10) || '```' || chr(10)) AS plan_md5, 1 AS blocks FROM n GROUP BY l_orderkey"""


#: Words as whole-word search sees them.
_WORDS = "[A-Za-z0-9_]+"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for every document: strict JSON, a block in prose, prose with a citation, or none. Symbols of the first citation by
    sixes: none, one of the index, a word of the document, an unknown one, no identifier, and a word while the index can't be asked."""
    k = F.col("doc_id")
    word = F.regexp_extract(F.coalesce("text", F.lit("")), "[A-Za-z_][A-Za-z0-9_]*", 0)
    symbol = F.element_at(F.array(F.lit(""), F.concat(F.lit("core.Brand_"), k % 5 + 1, k % 7 + 1, F.lit("()")), F.concat(F.lit("core."), word), F.concat(F.lit("pkg.NoSuch"), k), F.lit("no symbol"), word), (k % 6 + 1).cast("int"))
    cite = lambda a, b, s=F.lit(""): F.concat(F.lit('{"file": "./src/f'), k % 5, F.lit('.go", "start_line": '), a, F.lit(', "end_line": '), b, F.lit(', "symbol": "'), s, F.lit('"}'))
    said = F.concat(F.lit("the Pool holds "), k)
    body = F.concat(F.lit('{"answer": "'), said, F.lit('", "citations": ['), cite(k % 50 + 1, k % 50 + 9, symbol), F.lit(", "), cite(F.lit(900), F.lit(901)), F.lit("]}"))
    reply = F.when(k % 4 == 0, body).when(k % 4 == 1, F.concat(F.lit("Well: "), body, F.lit(" so."))).when(k % 4 == 2, F.concat(F.lit("see src/f"), k % 5, F.lit(".go:"), k % 50 + 1, F.lit(" for the pool"))).otherwise("no idea")
    return table(spark, sf_dir, "documents").select(k.alias("cell_id"), (k % 10).alias("question_id"), reply.alias("response"), F.col("n_chars").alias("injected_tokens"), (k % 6 != 5).alias("index_up"))


def _questions(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    q = spark.range(9).select(F.col("id").alias("question_id"), F.when(F.col("id") % 3 == 0, F.expr("cast(array() as array<string>)")).when(F.col("id") % 3 == 1, F.array(F.lit("POOL"))).otherwise(F.array(F.lit("absent"))).alias("keywords"))
    expected = spark.range(9).select(F.col("id").alias("question_id"), F.concat(F.lit("src/f"), F.col("id") % 5, F.lit(".go")).alias("path"), F.lit(5).alias("start_line"), F.lit(30).alias("end_line"))
    files = spark.range(4).select(F.concat(F.lit("src/f"), "id", F.lit(".go")).alias("path"))
    return q, expected, files


def scored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols are looked up among the brands of parts, then among the words of all documents."""
    names = table(spark, sf_dir, "part").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("name"))
    words = words_of(table(spark, sf_dir, "documents"), "text", _WORDS)
    scored = evaluation.scored_cells(_cells(spark, sf_dir), *_questions(spark), names, words)
    return scored.select("cell_id", "question_id", "parse_mode", "answer", F.round("precision", 6).alias("precision"), "recall", F.round("f1", 6).alias("f1"), "correctness", "citations", "unsupported", "is_partial", F.col("info_volume").cast("long").alias("info_volume"))


#: The kinds of answers by hand: of two citations the first may hit the question's range, the second never does; prose has one.
_SCORED = """s AS (SELECT doc_id AS cell_id, doc_id % 10 AS question_id, n_chars AS info_volume, doc_id % 4 AS kind, doc_id % 50 + 1 AS a, CASE WHEN doc_id % 4 = 2 THEN doc_id % 50 + 1 ELSE doc_id % 50 + 9 END AS b, doc_id % 5 AS f,
  CASE doc_id % 4 WHEN 2 THEN 1 WHEN 3 THEN 0 ELSE 2 END AS n FROM documents),
h AS (SELECT *, n > 0 AND question_id < 9 AND question_id % 5 = f AND a <= 30 AND b >= 5 AS hit FROM s),
p AS (SELECT *, CASE WHEN question_id = 9 THEN CASE WHEN n = 0 THEN 1.0 ELSE 0.0 END WHEN hit THEN 1.0 / n ELSE 0.0 END AS precision, CASE WHEN question_id = 9 OR hit THEN 1.0 ELSE 0.0 END AS recall,
  CASE kind WHEN 0 THEN 'strict' WHEN 3 THEN 'failed' ELSE 'lenient' END AS parse_mode, CASE WHEN kind < 2 THEN 'the Pool holds ' || cell_id WHEN kind = 2 THEN 'see src/f' || f || '.go:' || a || ' for the pool' ELSE '' END AS answer FROM h),
scored AS (SELECT *, CASE WHEN question_id = 9 THEN precision WHEN hit THEN 2 * precision / (precision + 1) ELSE 0.0 END AS f1, kind <> 3 AND recall >= 0.5 AND (question_id = 9 OR question_id % 3 <> 2) AS correctness, CASE WHEN f = 4 THEN n ELSE 0 END AS unsupported FROM p)"""
SCORED_CELLS = f"""WITH {_SCORED}, names AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS name FROM part), words AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_WORDS}')) AS name FROM documents),
 first AS (SELECT doc_id AS cell_id, doc_id % 6 AS k, CASE doc_id % 6 WHEN 1 THEN 'Brand_' || (doc_id % 5 + 1) || (doc_id % 7 + 1) WHEN 3 THEN 'NoSuch' || doc_id ELSE regexp_extract(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*') END AS name FROM documents),
 bad AS (SELECT cell_id, k = 5 AND name <> '' AS partial, CASE WHEN k IN (0, 4) OR name = '' THEN false WHEN name IN (SELECT name FROM words) THEN false WHEN k <> 5 AND name IN (SELECT name FROM names) THEN false ELSE true END AS missing FROM first)
SELECT cell_id, question_id, parse_mode, answer, round(precision, 6)::DOUBLE AS precision, recall::DOUBLE AS recall, round(f1, 6)::DOUBLE AS f1, correctness, n AS citations,
 CASE WHEN f <> 4 AND kind < 2 AND missing THEN 1 ELSE unsupported END AS unsupported, f <> 4 AND kind < 2 AND partial AS is_partial, info_volume FROM scored JOIN bad USING (cell_id)"""


def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = evaluation.macro_scores(evaluation.scored_cells(_cells(spark, sf_dir), *_questions(spark)), ["question_id"])
    return m.select("question_id", "n", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")), "hits")


MACRO = f"WITH {_SCORED} SELECT question_id, count(*) AS n, round(avg(precision), 6)::DOUBLE AS precision, round(avg(recall), 6)::DOUBLE AS recall, round(avg(f1), 6)::DOUBLE AS f1, count(*) FILTER (recall > 0) AS hits FROM scored GROUP BY question_id"


def rescored_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells stored as wrong or right by turns, and with one unsupported citation each, scored anew."""
    found = evaluation.scored_cells(_cells(spark, sf_dir), *_questions(spark))
    old = found.withColumn("correctness", F.when(F.col("cell_id") % 5 != 0, F.col("cell_id") % 2 == 0)).withColumn("unsupported", F.lit(1).cast("long"))
    files = _questions(spark)[2]
    cited = _cells(spark, sf_dir).where("cell_id % 4 = 2").select("cell_id", F.lit(0).alias("pos"), F.concat(F.lit("src/f"), F.col("cell_id") % 5, F.lit(".go")).alias("path"), F.lit(None).cast("string").alias("symbol"))
    counts = evaluation.unsupported_counts(reference_verdicts(cited, files, None, spark.createDataFrame([], "name string")), ["cell_id"])
    return evaluation.rescored(old, _questions(spark)[0], counts, ("correctness", "unsupported")).select("cell_id", "correctness", "unsupported", "changed")


RESCORED = f"WITH {_SCORED}, n AS (SELECT *, CASE WHEN kind = 2 AND f = 4 THEN 1 ELSE 0 END AS bad FROM scored) SELECT cell_id, correctness, bad AS unsupported, bad <> 1 OR (CASE WHEN cell_id % 5 <> 0 THEN cell_id % 2 = 0 END) IS DISTINCT FROM correctness AS changed FROM n"


def collected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.concat(F.lit("c"), "o_orderkey").alias("name")
    found = o.where("o_orderkey % 3 <> 0").select(name, F.lit("t").alias("task"), F.col("o_orderpriority").alias("mode"), F.lit("seen").alias("status"), "o_totalprice")
    listed = o.where("o_orderkey % 5 <> 0").select(name, F.when(F.col("o_orderkey") % 2 == 0, "own").otherwise("").alias("task"), F.lit(None).cast("string").alias("mode"), F.col("o_orderstatus").alias("status"))
    return evaluation.collected(listed, found)


COLLECTED = "SELECT 'c' || o_orderkey AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'own' WHEN o_orderkey % 3 <> 0 THEN 't' END AS task, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS mode, o_orderstatus AS status, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 5 <> 0"


_AGENTS = (("planner", "deep"), ("coder", "exec"))
_TIERS = (("deep", "m-deep"), ("exec", "m-exec"))
_PRICES = (("m-deep", "15", "75", "18.75", "1.5"), ("m-exec", "3", "15", "3.75", "0.3"))


def experiment_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells whose files are made of them and their lines: two in seven leave no state, one in nine no meta, every third cell
    has a session, one in eleven is listed without files."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    cell = F.concat(F.lit("c"), k)
    at = lambda s: F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T10:"), F.lpad((k % s).cast("string"), 2, "0"), F.lit(":00Z"))
    meta = F.to_json(F.struct(F.when(k % 5 != 0, F.concat(F.lit("t"), "o_custkey")).alias("task"), F.col("o_orderpriority").alias("mode"), F.when(k % 2 == 0, at(10)).alias("started_at"), F.when(k % 2 == 0, at(50)).alias("ended_at")))
    failure = F.struct(F.lit("EVALUATION").alias("state"), F.struct(F.when(k % 4 == 3, "Data RACE in pool").otherwise("unit").alias("summary")).alias("actual_outcome"))
    other = F.struct(F.lit("DESIGN").alias("state"), F.struct(F.lit("panic").alias("summary")).alias("actual_outcome"))
    log = F.transform(F.sequence(F.lit(0), k % 4), lambda i: F.when(i == 0, other).otherwise(failure))
    results = F.struct(F.struct(F.when(k % 3 == 0, "FAIL").otherwise("PASS").alias("status"), (k % 6 == 0).alias("race_detected")).alias("unit_test"), F.when(k % 8 == 0, "FAIL").otherwise("PASS").alias("security"))
    intake = F.struct(F.struct(F.when(k % 10 == 0, "BLOCKED").when(k % 10 == 1, "REDACTED").otherwise("CLEAN").alias("result")).alias("sensitive_check"))
    state = F.to_json(F.struct(F.concat(F.lit("s"), k).alias("ticket_id"), _pick(_STATES, k).alias("current_state"), F.struct(intake.alias("TICKET_INTAKE"), F.struct(results.alias("results")).alias("EVALUATION")).alias("states"), log.alias("failure_log"), at(20).alias("created_at"), at(40).alias("updated_at")))
    left = o.where(k % 11 != 0)
    files = left.select(cell.alias("cell"), F.when(k % 9 != 0, meta).otherwise("{cut").alias("meta"), F.when(k % 7 > 1, state).alias("state"))
    listed = o.select(k.cast("int").alias("pos"), cell.alias("cell"), F.when(k % 13 == 0, "told").otherwise("").alias("task"), F.lit(None).cast("string").alias("mode"), F.when(k % 2 == 0, "done").alias("status"))
    li, n = table(spark, sf_dir, "lineitem").where("l_orderkey % 11 <> 0"), F.col("l_linenumber")
    of = F.concat(F.lit("c"), "l_orderkey").alias("cell")
    said = F.to_json(F.struct(F.when(n % 3 == 0, "planner").when(n % 3 == 1, "coder").alias("subagent_type"), (F.col("l_partkey") % 1000).alias("prompt_chars"), n.alias("response_chars")))
    used = F.to_json(F.struct(F.struct(F.when(n % 2 == 0, "m-deep").when(n == 7, "m-none").alias("model"), F.struct(F.col("l_partkey").alias("input_tokens"), n.alias("output_tokens")).alias("usage")).alias("message")))
    spend = runs.run_usage(
        li.select(of, said.alias("line")), li.where("l_orderkey % 3 = 0").select(of, used.alias("line")),
        rows(spark, "agent string, tier string", *_AGENTS), rows(spark, "tier string, model string", *_TIERS), rows(spark, "model string, input string, output string, cache_write string, cache_read string", *_PRICES), "m-exec",
    )
    found = runs.collected_runs(listed, files, spend)
    shown = F.array_join(F.transform(F.sort_array(F.map_entries("detail")), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return found.select("cell", "task", "mode", "status", "pipeline_state", "correct", shown.alias("detail"), "bug_cycles", "side_effects", F.array_join("safety_flags", ",").alias("flags"), "latency_s", "input", "output", "tokens", F.col("cost").cast("double").alias("cost"), "cost_status", "usage_source", F.array_join("models", ",").alias("models"))


EXPERIMENT_RUNS = f"""WITH l AS (SELECT l_orderkey AS k, l_orderkey % 3 = 0 AS exact, CASE WHEN l_orderkey % 3 = 0 THEN CASE WHEN l_linenumber % 2 = 0 THEN 'm-deep' WHEN l_linenumber = 7 THEN 'm-none' ELSE 'm-exec' END WHEN l_linenumber % 3 = 0 THEN 'm-deep' ELSE 'm-exec' END AS model,
 CASE WHEN l_orderkey % 3 = 0 THEN l_partkey ELSE (l_partkey % 1000 + 3) // 4 END AS i, CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE (l_linenumber + 3) // 4 END AS o FROM lineitem WHERE l_orderkey % 11 <> 0),
m AS (SELECT k, exact, model, sum(i)::BIGINT AS i, sum(o)::BIGINT AS o, round(CASE model WHEN 'm-deep' THEN (sum(i) * 15 + sum(o) * 75)::DECIMAL(30,6) WHEN 'm-exec' THEN (sum(i) * 3 + sum(o) * 15)::DECIMAL(30,6) ELSE 0 END / 1000000, 6) AS c FROM l GROUP BY k, exact, model),
u AS (SELECT k, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, sum(i + o)::BIGINT AS tokens, sum(c)::DOUBLE AS cost, CASE WHEN NOT bool_and(exact) THEN 'estimated' WHEN bool_and(model = 'm-none') THEN 'unknown' WHEN bool_or(model = 'm-none') THEN 'mixed' ELSE 'actual' END AS cost_status,
 CASE WHEN bool_and(exact) THEN 'session_jsonl' ELSE 'char_estimate' END AS usage_source, string_agg(model, ',' ORDER BY model) AS models FROM m GROUP BY k),
f AS (SELECT o_orderkey AS k, o_custkey, o_orderpriority AS p, o_orderkey % 11 <> 0 AS l, o_orderkey % 11 <> 0 AND o_orderkey % 9 <> 0 AS meta, o_orderkey % 11 <> 0 AND o_orderkey % 7 > 1 AS st, {_list(_STATES)}[o_orderkey % 7 + 1] AS s FROM orders)
SELECT 'c' || k AS cell, CASE WHEN k % 13 = 0 THEN 'told' WHEN meta AND k % 5 <> 0 THEN 't' || o_custkey WHEN st THEN 's' || k ELSE 'c' || k END AS task, CASE WHEN meta THEN p ELSE 'unknown' END AS mode, CASE WHEN k % 2 = 0 OR st THEN 'done' ELSE 'incomplete' END AS status,
 CASE WHEN st THEN s END AS pipeline_state, CASE WHEN NOT st THEN NULL WHEN s IN ('EVALUATION_PASS', 'COMPLETED', 'COMPLETION') THEN true WHEN s IN ('EVALUATION_FAIL', 'BLOCKED') THEN false END AS correct,
 CASE WHEN NOT l THEN NULL WHEN st THEN 'security=' || CASE WHEN k % 8 = 0 THEN 'FAIL' ELSE 'PASS' END || ',unit_test=' || CASE WHEN k % 3 = 0 THEN 'FAIL' ELSE 'PASS' END ELSE '' END AS detail,
 CASE WHEN st THEN k % 4 ELSE 0 END AS bug_cycles, CASE WHEN st AND k % 4 = 3 THEN 3 ELSE 0 END AS side_effects,
 CASE WHEN st THEN concat_ws(',', CASE k % 10 WHEN 0 THEN 'sensitive_blocked' WHEN 1 THEN 'sensitive_redacted' END, CASE WHEN k % 8 = 0 THEN 'security_fail' END, CASE WHEN k % 6 = 0 THEN 'race_detected' END) ELSE '' END AS flags,
 CASE WHEN meta AND k % 2 = 0 THEN greatest(0, k % 50 - k % 10) * 60.0 WHEN st THEN greatest(0, k % 40 - k % 20) * 60.0 END::DOUBLE AS latency_s,
 coalesce(input, 0) AS input, coalesce(output, 0) AS output, coalesce(tokens, 0) AS tokens, coalesce(cost, 0) AS cost, coalesce(cost_status, 'unknown') AS cost_status, coalesce(usage_source, 'char_estimate') AS usage_source, coalesce(models, '') AS models FROM f LEFT JOIN u USING (k)"""


def surfaced_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    path = lambda d, n: F.concat(F.lit(d), n.cast("string"), F.lit(".go"))
    files = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(path("src/f", k).alias("path"))
    r = table(spark, sf_dir, "part").select(k.alias("id"), F.when(k % 6 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(path("./src/f", k), path("src/f", k), path("src/f", k + 1), F.concat(F.lit("src/f"), k, F.lit("_test.go")))).alias("surfaced"), F.array(path("src/f", k + k % 3)).alias("expected"))
    return evaluation.surfaced_scores(r, files)


SURFACED = """WITH r AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 0 ELSE 3 END AS n, p_partkey % 6 <> 0 AND p_partkey % 3 < 2 AS hit FROM part), m AS (SELECT max(p_partkey) AS top FROM part)
SELECT id, hit AS location_hit, CASE WHEN hit THEN 0.333 ELSE 0.0 END::DOUBLE AS answer_focus, CASE WHEN hit THEN 1.0 ELSE 0.0 END::DOUBLE AS recall, n AS n_surfaced, CASE WHEN n = 0 THEN 0 WHEN id % 2 = 1 AND id = top THEN 3 ELSE 2 END AS error_count, CASE WHEN n > 0 THEN 1 ELSE 0 END AS test_file_count, CASE WHEN n > 0 THEN 1 ELSE 0 END AS test_pollution FROM r, m"""


def assembled_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 2, F.col("l_returnflag")).alias("body"))
    c = evaluation.assembled(lines, "l_orderkey", F.concat(F.lit("### "), "l_linenumber"), F.col("body"), [F.col("l_linenumber")])
    return c.select("l_orderkey", F.md5(F.encode("context", "UTF-8")).alias("context_md5"))


ASSEMBLED = "SELECT l_orderkey, md5(string_agg('### ' || l_linenumber || chr(10) || CASE WHEN l_linenumber <> 2 THEN l_returnflag ELSE '(file not found)' END, chr(10) || chr(10) ORDER BY l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_returnflag END)) AS context_md5 FROM lineitem GROUP BY l_orderkey"


def fixture_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    old = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit("old").alias("origin"))
    return upsert_latest(old, o.where("o_orderkey % 3 = 0").select("o_orderkey", F.lit("new").alias("origin")), "o_orderkey").select("o_orderkey", "origin")


FIXTURE_UPSERT = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE 'old' END AS origin FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0"


def review_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments on lines and reviews as one table of remarks."""
    e = table(spark, sf_dir, "events")
    inline = e.where("event_type = 'view'").select(F.lit("inline").alias("kind"), F.col("event_id").alias("id"), F.concat(F.lit("f"), "user_id").alias("path"), F.col("props").alias("body"))
    reviews = e.where("event_type = 'click'").select(F.lit("review").alias("kind"), F.col("event_id").alias("id"), F.lit(None).cast("string").alias("path"), F.col("props").alias("body"))
    return inline.unionByName(reviews)


REVIEW_UNION = "SELECT CASE event_type WHEN 'view' THEN 'inline' ELSE 'review' END AS kind, event_id AS id, CASE WHEN event_type = 'view' THEN 'f' || user_id END AS path, props AS body FROM events WHERE event_type IN ('view', 'click')"

def detection_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.plans.lifecycle import contract_detection

    return gates.detection_rates(contract_detection(spark, sf_dir)).select("category", "rate_before", "rate_after", "gain_pp", "false_positives")


DETECTION_RATES = "SELECT * FROM (VALUES ('clean', 0.0, 0.0, 0.0, 0), ('hard', 0.333, 1.0, 66.7, 0), ('soft', 0.0, 1.0, 100.0, 0), ('residual', 0.0, 0.0, 0.0, 0)) t(category, rate_before, rate_after, gain_pp, false_positives)"


def decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sievework.plans.lifecycle import _scenarios

    return gates.decision_counts(gates.backend_decisions(_scenarios(spark, sf_dir)))


DECISION_COUNTS = f"SELECT count(*) AS scenarios, count(*) FILTER (silent_before) AS silent_before, count(*) FILTER (silent_after) AS silent_after, count(*) FILTER (after = 'BLOCKED') AS blocked_after, count(*) FILTER (after = 'DEGRADED') AS degraded_after, count(*) FILTER (over_block) AS over_block FROM ({BACKEND_POLICY})"


def recurring_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", F.concat(F.lit("Step "), F.col("event_id") % 9, F.lit(" of "), F.col("user_id") % 3, F.when(F.col("event_id") % 50 == 0, F.concat(F.lit(" alone "), F.translate(F.col("event_id").cast("string"), "0123456789", "abcdefghij"))).otherwise("")).alias("s"))
    return rollup.recurring_ids(e, failure_key(F.col("s")), "event_id")


RECURRING_IDS = "WITH e AS (SELECT event_id, 'step <n> of <n>' || CASE WHEN event_id % 50 = 0 THEN ' alone ' || translate(event_id::VARCHAR, '0123456789', 'abcdefghij') ELSE '' END AS pattern FROM events WHERE event_type = 'error') SELECT pattern, event_id, n FROM (SELECT *, count(*) OVER (PARTITION BY pattern) AS n FROM e) WHERE n >= 2"


def cycle_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "ts")
    return lifecycle.cycle_actions(e, ["user_id"], [F.col("ts"), F.col("event_id")], 3).select("event_id", "cycle", "action")


CYCLE_ACTIONS = "SELECT event_id, n AS cycle, CASE WHEN n < 3 THEN 'REENTER' WHEN n < 4 THEN 'ESCALATE' ELSE 'BLOCKED' END AS action FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')"


def flattened_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = F.struct("l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 3, F.array(F.concat(F.lit("c"), F.col("l_partkey") % 3), F.concat(F.lit("d"), F.col("l_linenumber") % 2))).alias("commits"))
    steps = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(step)).alias("steps"))  # an order's lines
    return steps.select("l_orderkey", F.array_join(lifecycle.commits_of(F.col("steps")), ",").alias("commits"))


FLATTENED_COMMITS = """WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey, unnest(['c' || (l_partkey % 3), 'd' || (l_linenumber % 2)]) AS c, generate_subscripts([1, 2], 1) AS i FROM lineitem WHERE l_linenumber <> 3), f AS (SELECT l_orderkey, c, min((l_linenumber, l_partkey, i)) AS spot FROM u GROUP BY ALL)
SELECT l_orderkey, coalesce(string_agg(c, ',' ORDER BY spot) FILTER (c IS NOT NULL), '') AS commits FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN f USING (l_orderkey) GROUP BY l_orderkey"""


def symbol_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "part").select(F.col("p_brand").alias("name"), F.col("p_type").alias("kind"), F.when(F.col("p_size") % 2 == 0, "go").otherwise("py").alias("language"), F.col("p_partkey").alias("file"))
    names = table(spark, sf_dir, "part").where("p_partkey % 10 = 0").select(F.col("p_brand").alias("name"))
    return compositions.find_symbol(s, names, "go").select("name", "kind", "file")


SYMBOL_SITES = "SELECT p_brand AS name, p_type AS kind, p_partkey AS file FROM part WHERE p_size % 2 = 0 AND p_brand IN (SELECT p_brand FROM part WHERE p_partkey % 10 = 0)"


def change_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("symbol"), F.col("o_orderkey").alias("ref"), "o_orderdate")
    wanted = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("symbol"))
    return compositions.change_history(wanted, o, [F.col("o_orderdate").desc(), F.col("ref")], 3).select("symbol", "ref", "rank")


CHANGE_REFS = "SELECT symbol, ref, rank FROM (SELECT o_custkey AS symbol, o_orderkey AS ref, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) WHERE rank <= 3"


def backend_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as backends of their order: the first is the index, the second the embedder; what was returned is down."""
    n = F.col("l_linenumber")
    b = table(spark, sf_dir, "lineitem").select("l_orderkey", F.when(n == 1, "index").when(n == 2, "embedder").otherwise(F.concat(F.lit("b"), n)).alias("name"), (F.col("l_returnflag") != "R").alias("up"))
    return compositions.health(b, ("l_orderkey",)).select("l_orderkey", "status", F.array_join("missing", ",").alias("missing"))


BACKEND_HEALTH = """WITH b AS (SELECT l_orderkey, CASE l_linenumber WHEN 1 THEN 'index' WHEN 2 THEN 'embedder' ELSE 'b' || l_linenumber END AS name, l_returnflag <> 'R' AS up FROM lineitem)
SELECT l_orderkey, CASE WHEN NOT coalesce(bool_or(up) FILTER (name = 'index'), false) THEN 'down' WHEN NOT coalesce(bool_or(up) FILTER (name = 'embedder'), false) OR NOT bool_and(up) THEN 'degraded' ELSE 'ok' END AS status, coalesce(string_agg(DISTINCT name, ',' ORDER BY name) FILTER (NOT up), '') AS missing FROM b GROUP BY l_orderkey"""


_SQL = {
    detection_rates: DETECTION_RATES, decision_counts: DECISION_COUNTS, recurring_ids: RECURRING_IDS, cycle_actions: CYCLE_ACTIONS, flattened_commits: FLATTENED_COMMITS, symbol_sites: SYMBOL_SITES, change_refs: CHANGE_REFS,
    backend_health: BACKEND_HEALTH,
    issue_records: ISSUE_RECORDS, comments_since: COMMENTS_SINCE, issue_search: ISSUE_SEARCH, retry_outcomes: RETRY, pass_states: PASS_STATES, active_workspaces: ACTIVE, auto_continue: AUTO_CONTINUE, review_numbers: REVIEW_NUMBERS,
    last_activity: LAST_ACTIVITY, record_values: RECORD_VALUES, query_identifiers: QUERY_IDENTIFIERS, secret_literals: SECRET_LITERALS, failure_summaries: FAILURE_SUMMARIES, discovery_order: DISCOVERY, detected_paths: DETECTED_PATHS,
    allow_lists: ALLOW_LISTS, format_violations: FORMAT_VIOLATIONS, setup_checks: SETUP_CHECKS, run_identities: RUN_IDENTITIES, scoped_processes: SCOPED_PROCESSES, manifest_selection: MANIFEST, question_lookup: QUESTION_LOOKUP,
    commit_workspaces: COMMIT_WORKSPACES, replayed_answers: REPLAYED, contract_blocks: CONTRACT_BLOCKS, rendered_plans: RENDERED_PLANS, scored_cells: SCORED_CELLS, macro_scores: MACRO, rescored_cells: RESCORED, collected_cells: COLLECTED, experiment_runs: EXPERIMENT_RUNS,
    surfaced_files: SURFACED, assembled_contexts: ASSEMBLED, fixture_upsert: FIXTURE_UPSERT, review_union: REVIEW_UNION,
}
QUERIES = {f.__name__: f for f in _SQL}
ORACLE = {f.__name__: s for f, s in _SQL.items()}
