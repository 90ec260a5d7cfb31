"""Queries on completeness, settings, verdicts and refresh."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import checks, integrity
from sievework.plans.common import rows, table


def range_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.size(F.split("text", "\n")).alias("n_lines"))
    want = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("d/"), F.col("o_custkey")).alias("path"), (F.col("o_orderkey") % 5).alias("start_line"), (F.col("o_orderkey") % 5 + F.col("o_orderkey") % 3).alias("end_line"))
    return checks.validate_ranges(want, files).select("id", "problem")


RANGE_VALIDATION = """WITH f AS (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents), w AS (SELECT o_orderkey AS id, o_custkey, o_orderkey % 5 AS s, o_orderkey % 5 + o_orderkey % 3 AS e FROM orders)
SELECT id, CASE WHEN n IS NULL THEN 'file_missing' WHEN NOT s BETWEEN 1 AND n THEN 'start_out_of_range' WHEN NOT e BETWEEN s AND n THEN 'end_out_of_range' END AS problem FROM w LEFT JOIN f ON doc_id = o_custkey"""


def path_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://|[?#].*$", "")
    pages = table(spark, sf_dir, "pages")
    return checks.suffix_matches(pages.select(path.alias("path")).distinct(), pages.select(F.regexp_extract(path, "^[^/]*/(.*)$", 1).alias("path")).where("path <> ''").distinct())


PATH_SUFFIXES = """WITH p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS a FROM pages), q AS (SELECT DISTINCT regexp_extract(a, '^[^/]*/(.*)$', 1) AS b FROM p WHERE regexp_extract(a, '^[^/]*/(.*)$', 1) <> '')
SELECT a, b FROM p, q WHERE a <> '' AND (ends_with(a, b) OR ends_with(b, a))"""


def suffix_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as cited by their path alone, on lines that depend on their number, among the places of all whole addresses."""
    path = F.regexp_replace("url", "^[a-z]+://|[?#].*$", "")
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    cited = p.select(k.alias("id"), F.regexp_extract(path, "^[^/]*/(.*)$", 1).alias("path"), (k % 40).alias("start_line"), (k % 40 + 3).alias("end_line"))
    return checks.suffix_locations(cited, p.select(path.alias("path"), (k % 60 + 10).alias("start_line"), (k % 60 + 12).alias("end_line")))


SUFFIX_PLACES = """WITH p AS (SELECT page_id AS k, regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g') AS a, regexp_extract(regexp_replace(url, '^[a-z]+://|[?#].*$', '', 'g'), '^[^/]*/(.*)$', 1) AS c FROM pages)
SELECT k AS id, c AS path, k % 40 AS start_line, k % 40 + 3 AS end_line, EXISTS (SELECT 1 FROM p q WHERE p.c <> '' AND q.a <> '' AND (ends_with(q.a, p.c) OR ends_with(p.c, q.a)) AND p.k % 40 <= q.k % 60 + 12 AND q.k % 60 + 10 <= p.k % 40 + 3) AS found FROM p"""


def sibling_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("dir"), F.col("n_name").alias("name"))
    return checks.next_sibling(n)


SIBLINGS = """WITH n AS (SELECT 'r' || n_regionkey AS dir, n_name AS name FROM nation), r AS (SELECT dir, list_sort(list(name)) AS x FROM n GROUP BY dir) SELECT n.dir, n.name, CASE WHEN x[1] <> n.name THEN x[1] ELSE x[2] END AS sibling FROM n JOIN r USING (dir)"""


def setting_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("K"), "n_nationkey").alias("key")
    n = table(spark, sf_dir, "nation")
    pick = lambda m, v: n.where(f"n_nationkey % {m} = 0").select(key, F.lit(v).alias("value"))
    return checks.setting_status(pick(3, "x"), pick(2, "y").unionByName(pick(7, "")), n.select(key))


SETTING_STATES = "SELECT 'K' || n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN 'ok' WHEN n_nationkey % 2 = 0 THEN 'restart_needed' ELSE 'unset' END AS status FROM nation"


def settings_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("K"), "n_nationkey").alias("key"), "n_nationkey")
    old = n.where("n_nationkey % 2 = 0").select("key", F.lit("old").alias("value"))
    new = n.where("n_nationkey % 3 = 0").select("key", F.when(F.col("n_nationkey") % 9 == 0, "").otherwise("new").alias("value"))
    return checks.merge_settings(old, new, False)


SETTINGS_MERGE = """SELECT 'K' || n_nationkey AS key, CASE WHEN n_nationkey % 2 = 0 THEN 'old' ELSE 'new' END AS value, n_nationkey % 2 <> 0 AS written FROM nation WHERE n_nationkey % 2 = 0 OR (n_nationkey % 3 = 0 AND n_nationkey % 9 <> 0)"""


def issue_remedies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as issues, and advice on settings made of customers; the advice on what is unset comes with a kind that is an issue too."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'").select(F.col("event_type").alias("kind"), F.col("event_id").alias("pos"))
    told = checks.advice(_settings(spark, sf_dir), F.lit(False)).select("kind", "pos").unionByName(rows(spark, "kind string, pos int", ("error", 9), ("signup", 10)))
    return checks.remedies(e, rows(spark, "kind string, fix string", ("error", "retry"), ("view", "ignore"), ("env_unset", "setup")), "ask", told)


REMEDIES = """WITH a AS (SELECT * FROM (VALUES ('restart_needed', 0), ('env_unset', 1), ('env_secret_unset', 2), ('permissions_unset', 3), ('error', 9), ('signup', 10)) t(kind, pos)), r AS (SELECT event_type AS kind, 0 AS g, event_id AS pos FROM events WHERE event_type <> 'signup' UNION ALL SELECT kind, 1, pos FROM a),
m AS (SELECT kind, min({'g': g, 'pos': pos}) AS x, count(*) AS n FROM r GROUP BY kind)
SELECT kind, x.pos AS pos, x.g = 1 AS advice, n, CASE kind WHEN 'error' THEN 'retry' WHEN 'view' THEN 'ignore' WHEN 'env_unset' THEN 'setup' ELSE 'ask' END AS fix FROM m"""


def _settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    status = F.when(k % 5 == 0, "restart_needed").when(k % 5 == 1, "ok").otherwise("unset")
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("K"), k % 40).alias("key"), status.alias("status"), (k % 3 == 0).alias("secret"))


def setup_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.advice(_settings(spark, sf_dir), F.lit(False), ("K7",))


SETUP_ADVICE = """WITH s AS (SELECT 'K' || (c_custkey % 40) AS key, CASE c_custkey % 5 WHEN 0 THEN 'restart_needed' WHEN 1 THEN 'ok' ELSE 'unset' END AS status, c_custkey % 3 = 0 AS secret FROM customer),
k AS (SELECT key, CASE WHEN status = 'restart_needed' THEN 'restart_needed' WHEN status = 'unset' AND secret THEN 'env_secret_unset' WHEN status = 'unset' AND key <> 'K7' THEN 'env_unset' END AS kind FROM s)
SELECT kind, CASE kind WHEN 'restart_needed' THEN 0 WHEN 'env_unset' THEN 1 ELSE 2 END AS pos, string_agg(DISTINCT key, ', ' ORDER BY key) AS detail FROM k WHERE kind IS NOT NULL GROUP BY kind UNION ALL SELECT 'permissions_unset', 3, ''"""


def domain_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as packs: one in nine is no JSON, keys are missing by sevens, every fifth has another id, every fourth a lost file."""
    k = F.col("c_custkey")
    pid = F.concat(F.lit("p"), k)
    doc = F.to_json(F.struct(F.when(k % 5 == 0, "other").otherwise(pid).alias("project_id"), F.when(k % 7 != 1, F.lit(1)).alias("version"), F.when(k % 7 != 2, F.concat(F.lit("inv"), k % 4, F.lit(".md"))).alias("invariants")))
    packs = table(spark, sf_dir, "customer").select(pid.alias("id"), F.when(k % 9 == 0, "{no").otherwise(doc).alias("doc"))
    files = table(spark, sf_dir, "customer").where("c_custkey % 4 <> 3").select(pid.alias("id"), F.concat(F.lit("inv"), k % 4, F.lit(".md")).alias("name"))
    return checks.pack_problems(packs, files, ("project_id", "version", "invariants"), ("invariants",), "project_id")


DOMAIN_PACKS = """WITH c AS (SELECT c_custkey AS k, 'p' || c_custkey AS id, c_custkey % 9 = 0 AS bad FROM customer) SELECT id, 'invalid JSON' AS problem FROM c WHERE bad UNION ALL SELECT id, 'missing key version' FROM c WHERE NOT bad AND k % 7 = 1 UNION ALL SELECT id, 'missing key invariants' FROM c WHERE NOT bad AND k % 7 = 2
UNION ALL SELECT id, 'project_id other is not the folder' FROM c WHERE NOT bad AND k % 5 = 0 UNION ALL SELECT id, 'invariants -> inv3.md not found' FROM c WHERE NOT bad AND k % 4 = 3 AND k % 7 <> 2"""


def unregistered_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return integrity.missing(docs, table(spark, sf_dir, "labels").select("doc_id").distinct(), ["doc_id"])


UNREGISTERED = "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"


def oversized_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as steps, whose orders' parts are files and quantities lines."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    by = li.groupBy("o_custkey").agg(F.countDistinct("l_partkey").alias("files"), F.sum("l_quantity").cast("long").alias("lines"))
    return checks.oversized(by)


OVERSIZED = "SELECT o_custkey, count(DISTINCT l_partkey) AS files, sum(l_quantity)::BIGINT AS lines FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_custkey HAVING count(DISTINCT l_partkey) > 10 OR sum(l_quantity)::BIGINT > 500"


def unfixed_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    fixed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    tested = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select("l_orderkey", "l_linenumber")
    return integrity.missing(integrity.missing(sites, fixed.distinct(), ["l_orderkey", "l_linenumber"]), tested.distinct(), ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("open_sites"))


UNFIXED = """WITH x AS (SELECT l_orderkey, l_linenumber, bool_or(l_returnflag = 'R' OR l_linestatus = 'F') OVER (PARTITION BY l_orderkey, l_linenumber) AS done FROM lineitem) SELECT l_orderkey, count(*) AS open_sites FROM x WHERE NOT done GROUP BY l_orderkey"""


def red_green(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("test"), F.when(F.col("o_orderkey") % 2 == 0, "base").otherwise("head").alias("role"), F.when(F.col("o_orderstatus") == "F", "FAIL").otherwise("PASS").alias("outcome"), F.lit("b").alias("body"))
    return checks.red_then_green(o)


RED_GREEN = """SELECT o_custkey AS test, coalesce(max(CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'FAIL' ELSE 'PASS' END END) = 'FAIL' AND max(CASE WHEN o_orderkey % 2 = 1 THEN CASE o_orderstatus WHEN 'F' THEN 'FAIL' ELSE 'PASS' END END) = 'PASS', false) AS consistent FROM orders GROUP BY o_custkey"""


def stage_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.when(F.col("value") > 199, "FAIL").when(F.col("value") > 190, "WARN").otherwise("PASS").alias("status"), (F.col("event_id") % 997 == 0).alias("degraded"))
    return checks.overall_verdict(e, ["user_id"])


STAGE_VERDICTS = "SELECT user_id, bool_and(value <= 199) AS accepted, bool_or((value > 190 AND value <= 199) OR event_id % 997 = 0) AS careful FROM events GROUP BY user_id"


def squash_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = F.transform(F.sequence(F.lit(1), (F.col("c_custkey") % 14 + 1).cast("int")), lambda i: F.concat(F.lit("s"), i))
    return table(spark, sf_dir, "customer").select("c_custkey", checks.squash_lines(steps).alias("body"))


SQUASH = """WITH c AS (SELECT c_custkey, list_transform(range(1, c_custkey % 14 + 2), lambda i: 's' || i) AS s FROM customer) SELECT c_custkey, CASE WHEN len(s) <= 10 THEN array_to_string(s, '; ') ELSE array_to_string(s[1:3], '; ') || '; and ' || (len(s) - 3) || ' more' END AS body FROM c"""


#: Commands and their verdicts by the guard's rules (fixed values): command, branch checked out, whether tags go unasked, verdict.
COMMANDS = (
    ("git push --force origin x", "x", False, "deny"), ("git push --force-with-lease origin x", "x", False, "allow"), ("git push -f", "x", False, "deny"), ("git push origin x", "x", False, "allow"), ("git push origin main", "x", False, "deny"),
    ("git push origin HEAD:master", "x", False, "deny"), ("git push origin mainline", "x", False, "allow"), ("git commit -m a", "main", False, "deny"), ("git -C sub commit -m a", "main", False, "allow"), ("git commit -m a", "x", False, "allow"),
    ("git reset --hard", "x", False, "ask"), ("git clean -xfd", "x", False, "ask"), ("git branch -D y", "x", False, "ask"), ("git push --tags", "x", False, "ask"), ("git push --tags", "x", True, "allow"), ("git push origin tag v1", None, False, "ask"),
    ("git rebase main", "x", False, "allow"), ("ls && git reset --hard; git push -f", "x", False, "deny"), ("echo git push -f", "main", False, "allow"), (None, "main", False, "allow"),
)


def command_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A command of each kind for every order."""
    c = F.element_at(F.array(*(F.struct(*(F.lit(x).cast(t).alias(n) for x, t, n in zip(c[:3], ("string", "string", "boolean"), "cbt", strict=True))) for c in COMMANDS)), (F.col("o_orderkey") % len(COMMANDS) + 1).cast("int"))
    t = table(spark, sf_dir, "orders").select("o_orderkey", c.alias("x"))
    return t.select("o_orderkey", checks.command_rule(F.col("x.c"), F.col("x.b"), F.col("x.t")).alias("rule"))


COMMAND_RULES = f"SELECT o_orderkey, {[c[3] for c in COMMANDS]}[o_orderkey % {len(COMMANDS)} + 1] AS rule FROM orders"


def index_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d/"), "doc_id").alias("path"), F.md5(F.col("text").cast("binary")).alias("hash"), "doc_id")
    old = docs.where("doc_id % 10 <> 1").withColumn("hash", F.when(F.col("doc_id") % 10 == 2, "stale").otherwise(F.col("hash")))
    return checks.refresh(old, docs.where("doc_id % 10 <> 3"))


INDEX_REFRESH = "SELECT 'd/' || doc_id AS path, CASE doc_id % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'changed' ELSE 'removed' END AS change FROM documents WHERE doc_id % 10 IN (1, 2, 3)"


def error_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("event_id") % 7 == 0, "AUTH_FAILED").otherwise("NOT_FOUND")
    e = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", checks.error_envelope(code, F.concat(F.lit("user "), "user_id")).alias("x"))
    return e.select("event_id", "x.*")


ERROR_ENVELOPES = "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'AUTH_FAILED' ELSE 'NOT_FOUND' END AS error, 'user ' || user_id AS message, event_id % 7 <> 0 AS recoverable FROM events WHERE event_type = 'error'"


def step_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    e = li.select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linestatus") == "F", "completed").otherwise("started").alias("kind"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("at"), F.concat(F.lit("c"), F.col("l_suppkey") % 3).alias("commit"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("at "), "l_partkey")).alias("checkpoint"))
    return checks.step_progress(e, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("kind"), F.col("at")])


STEP_PROGRESS = """WITH e AS (SELECT *, l_linestatus = 'F' AS done, strftime(l_shipdate, '%Y-%m-%d') AS day, {'n': l_linenumber, 'p': l_partkey, 'k': CASE WHEN l_linestatus = 'F' THEN 'completed' ELSE 'started' END, 'a': strftime(l_shipdate, '%Y-%m-%d')} AS o, CASE WHEN l_suppkey % 2 = 0 THEN 'at ' || l_partkey ELSE '' END AS c FROM lineitem)
SELECT l_orderkey, min(day) FILTER (NOT done) AS started, max(day) FILTER (done) AS completed, array_to_string(list_sort(list_distinct(list('c' || (l_suppkey % 3)))), ',') AS commits, arg_max(o.k, o) AS status, nullif(arg_max(c, o) FILTER (c <> '' OR done), '') AS checkpoint FROM e GROUP BY l_orderkey"""


def idempotent_init(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "events").where("event_id % 5 = 0").groupBy("user_id").agg(F.max("event_type").alias("status"))
    return checks.missing_states(old, table(spark, sf_dir, "events").select("user_id").distinct(), ["user_id"])


IDEMPOTENT_INIT = "SELECT u.user_id, coalesce(s, 'pending') AS status FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN (SELECT user_id, max(event_type) AS s FROM events WHERE event_id % 5 = 0 GROUP BY user_id) o USING (user_id)"


def merged_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id")
    every = checks.timeline([(f"n{i}", e.where(f"user_id % 3 = {i}")) for i in range(3)], "event_id", 50)
    return every.select("event_id", "node")


TIMELINE = "SELECT event_id, 'n' || (user_id % 3) AS node FROM events ORDER BY event_id LIMIT 50"


def stage_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), (F.col("l_quantity") > 20).alias("run_when"))
    return checks.run_order(li.groupBy("l_orderkey", "pos").agg(F.max("run_when").alias("run_when")), ["l_orderkey"]).groupBy("l_orderkey").agg(F.max("turn").cast("long").alias("runs"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"))


STAGE_DISPATCH = "WITH s AS (SELECT l_orderkey, l_linenumber, max(l_quantity) > 20 AS w FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT l_orderkey, nullif(count(*) FILTER (w), 0) AS runs, count(*) FILTER (NOT w) AS skipped FROM s GROUP BY l_orderkey"

_SQL = {
    range_validation: RANGE_VALIDATION, path_suffixes: PATH_SUFFIXES, suffix_places: SUFFIX_PLACES, sibling_files: SIBLINGS, setting_states: SETTING_STATES, settings_merge: SETTINGS_MERGE, issue_remedies: REMEDIES, setup_advice: SETUP_ADVICE, domain_packs: DOMAIN_PACKS, unregistered_documents: UNREGISTERED, oversized_steps: OVERSIZED,
    unfixed_sites: UNFIXED, red_green: RED_GREEN, stage_verdicts: STAGE_VERDICTS, squash_bodies: SQUASH, command_rules: COMMAND_RULES, index_refresh: INDEX_REFRESH, error_envelopes: ERROR_ENVELOPES, step_progress: STEP_PROGRESS,
    idempotent_init: IDEMPOTENT_INIT, merged_timeline: TIMELINE, stage_dispatch: STAGE_DISPATCH,
}
QUERIES = {f.__name__: f for f in _SQL}
ORACLE = {f.__name__: s for f, s in _SQL.items()}
