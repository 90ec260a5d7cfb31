"""Queries on citations, correctness, rollups, usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import checkable_symbol, bare_symbol, drop_dot_slash, estimated_tokens, is_test_file, normal_path
from sievework.operators import integrity, rollup, scoring, usage
from sievework.operators.parsing import json_citations, parse_responses, prose_citations
from sievework.plans.common import quoted, rows, table

RESPONSES = (
    (1, '{"answer": "In the pool.", "citations": [{"file": "core/pool.go", "start_line": "12", "end_line": 20}, {"file": ""}]}'),
    (2, 'Here it is: {"answer": "See below", "citations": []} and core/tx/list.go:45-67 too'),
    (3, "It is in consensus/core/round.go:45 and eth/handler.go lines 7-9, consensus/core/round.go:45 again"),
    (4, "nothing to cite here, only pool.go:3"),
    (5, ""),
    (6, '{"answer": "x"} trailing'),
    (7, '} {"citations": [{"file": "a/b.py", "start_line": 3}]}'),
    (8, None),
)
PRICES = (("deep", "15", "75", "18.75", "1.50"), ("exec", "3", "15", "3.75", "0.30"))


def _responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One of the replies for every document."""
    reply = F.element_at(F.array(*(F.lit(t) for _, t in RESPONSES)), (F.pmod("doc_id", F.lit(len(RESPONSES))) + 1).cast("int"))
    return parse_responses(table(spark, sf_dir, "documents").select("doc_id", reply.alias("text")), "text")


def page_url_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://[^/]*", "."), "[?#].*$", "")
    return table(spark, sf_dir, "pages").select("page_id", normal_path(path).alias("path"), drop_dot_slash(path).alias("no_dot"), is_test_file(path).alias("is_test"))


PAGE_URL_NORM = """WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/]*', '.'), '[?#].*$', '') AS path FROM pages),
q AS (SELECT *, string_split(path, '/') AS parts FROM p)
SELECT page_id, rtrim(ltrim(replace(path, '\\', '/'), './'), '/') AS path, regexp_replace(path, '^\\./', '') AS no_dot,
  regexp_matches(parts[-1], '(_test[.](go|py)|[.](test|spec)[.][jt]sx?|[.]t[.]sol)$') OR starts_with(parts[-1], 'test_') OR list_has_any(parts, ['test', 'tests', 'testdata', '__tests__']) AS is_test FROM q"""


def citation_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("see core/f"), F.col("doc_id") % 7, F.lit(".go:"), F.col("doc_id") + 1, F.lit("-"), F.col("doc_id") + 9, F.lit(" and pkg/m.py line "), F.col("doc_id") % 5, F.lit(", notes.md:4. "), F.coalesce("text", F.lit(""))).alias("text"))
    return docs.select("doc_id", F.explode(prose_citations(F.col("text"))).alias("c")).select("doc_id", "c.file", "c.start_line", "c.end_line")


CITATION_PROSE = """SELECT doc_id, 'core/f' || (doc_id % 7) || '.go' AS file, (doc_id + 1)::INT AS start_line, (doc_id + 9)::INT AS end_line FROM documents
UNION ALL SELECT doc_id, 'pkg/m.py', nullif(doc_id % 5, 0)::INT, nullif(doc_id % 5, 0)::INT FROM documents"""


def citation_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.array(
        F.struct(F.concat(F.lit("src/"), "o_orderstatus", F.lit(".go")).alias("file"), (F.col("o_orderkey") % 100).cast("string").alias("start_line"), (F.col("o_orderkey") % 100 + 5).alias("end_line"), F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("Status."), "o_orderstatus")).otherwise("").alias("symbol")),
        F.struct(F.lit("").alias("file"), F.lit("1").alias("start_line"), F.lit(2).cast("long").alias("end_line"), F.lit("x").alias("symbol")),
    )).alias("j"))
    return orders.select("o_orderkey", F.explode(json_citations(F.col("j"))).alias("c")).select("o_orderkey", "c.*")


CITATION_JSON = "SELECT o_orderkey, 'src/' || o_orderstatus || '.go' AS file, (o_orderkey % 100)::INT AS start_line, (o_orderkey % 100 + 5)::INT AS end_line, CASE WHEN o_orderkey % 3 <> 0 THEN 'Status.' || o_orderstatus END AS symbol FROM orders"


def parse_mode_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("citations", lambda c: F.concat_ws(":", c["file"], c["start_line"], c["end_line"]))
    return _responses(spark, sf_dir).select("doc_id", "parse_mode", F.coalesce("answer", F.lit("")).alias("answer"), F.array_join(shown, ",").alias("cited"))


PARSE_MODE_MIX = """SELECT doc_id, parse_mode, answer, cited FROM documents JOIN (VALUES (1, 'strict', 'In the pool.', 'core/pool.go:12:20'), (2, 'lenient', 'See below', 'core/tx/list.go:45:67'),
(3, 'lenient', 'It is in consensus/core/round.go:45 and eth/handler.go lines 7-9, consensus/core/round.go:45 again', 'consensus/core/round.go:45:45,eth/handler.go:7:9'),
(4, 'failed', '', ''), (5, 'failed', '', ''), (6, 'lenient', 'x', ''), (7, 'lenient', '} {"citations": [{"file": "a/b.py", "start_line": 3}]}', 'a/b.py'), (8, 'failed', '', '')) t(id, parse_mode, answer, cited) ON doc_id % 8 + 1 = id"""


def location_prf(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    at = F.col("l_partkey") % 50
    path = F.concat(F.lit("./src/"), F.col("l_suppkey") % 3, F.lit(".go"))
    mine = lambda odd: lines.where(F.col("l_linenumber") % 2 == odd)
    span = lambda df, extra: df.select(F.col("l_orderkey").alias("q"), path.alias("path"), at.alias("start_line"), (at + extra).cast("long").alias("end_line"))
    pred, exp = span(mine(1), F.col("l_quantity")), span(mine(0), F.lit(10))
    questions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("q"))
    found = scoring.location_scores(questions, pred, exp, ["q"])
    return found.select("q", "n_pred", "n_exp", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


LOCATION_PRF = """WITH x AS (SELECT row_number() OVER () AS i, l_orderkey AS q, l_suppkey % 3 AS path, l_partkey % 50 AS s, l_linenumber % 2 AS odd, (l_partkey % 50 + l_quantity)::BIGINT AS pe, l_partkey % 50 + 10 AS ee FROM lineitem),
p AS (SELECT i, q, path, s, pe AS e FROM x WHERE odd = 1), e AS (SELECT i, q, path, s, ee AS e FROM x WHERE odd = 0),
hp AS (SELECT q, count(*) AS n_pred, count(*) FILTER (EXISTS (SELECT 1 FROM e WHERE e.q = p.q AND e.path = p.path AND p.s <= e.e AND e.s <= p.e)) AS h FROM p GROUP BY q),
he AS (SELECT q, count(*) AS n_exp, count(*) FILTER (EXISTS (SELECT 1 FROM p WHERE e.q = p.q AND e.path = p.path AND p.s <= e.e AND e.s <= p.e)) AS h FROM e GROUP BY q),
b AS (SELECT o_orderkey AS q, coalesce(n_pred, 0) AS n_pred, coalesce(hp.h, 0) AS hit_p, coalesce(n_exp, 0) AS n_exp, coalesce(he.h, 0) AS hit_e FROM orders LEFT JOIN hp ON hp.q = o_orderkey LEFT JOIN he ON he.q = o_orderkey),
s AS (SELECT *, CASE WHEN n_exp = 0 THEN CASE WHEN n_pred = 0 THEN 1.0 ELSE 0.0 END WHEN n_pred = 0 THEN 0.0 ELSE hit_p::DOUBLE / n_pred END::DOUBLE AS pr, CASE WHEN n_exp = 0 THEN 1.0 ELSE hit_e::DOUBLE / n_exp END::DOUBLE AS rc FROM b)
SELECT q, n_pred, n_exp, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN n_exp = 0 THEN pr WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END, 6)::DOUBLE AS f1 FROM s"""


def correctness(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    words = F.when(F.col("conv_id") % 4 == 0, F.expr("cast(array() as array<string>)")).otherwise(F.array(F.lit("THE"), F.lit("Que")))
    return turns.select("conv_id", "turn", scoring.correct(F.coalesce("text", F.lit("")), (F.col("turn") % 10) / 10.0, words, F.col("conv_id") % 7 != 0).alias("correct"))


CORRECTNESS = """SELECT conv_id, turn, conv_id % 7 <> 0 AND trim(coalesce(text, ''), ' ') <> '' AND (turn % 10) / 10.0 >= 0.5 AND (conv_id % 4 = 0 OR contains(lower(coalesce(text, '')), 'the') OR contains(lower(coalesce(text, '')), 'que')) AS correct
FROM conversations WHERE role = 'assistant'"""


def symbol_existence(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 7 != 0).alias("index_up"), F.when(F.col("p_partkey") % 9 == 0, F.lit("gone/x.go")).otherwise(F.lit("./src/parts.go")).alias("path"),
        F.when(F.col("p_partkey") % 5 == 0, F.lit("no symbol here")).when(F.col("p_partkey") % 5 == 1, None).otherwise(F.concat(F.lit("pkg."), F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_"), F.lit("()"))).alias("symbol"))
    known = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("name"))
    said = table(spark, sf_dir, "part").where("p_size = 1").select(F.regexp_replace("p_brand", "[^A-Za-z0-9]", "_").alias("name"))
    return scoring.reference_verdicts(parts, rows(spark, "path string", ("src/parts.go",)), known, said).select("id", "reason", "is_unsupported", "is_partial")


SYMBOL_EXISTENCE = """WITH c AS (SELECT p_partkey AS id, p_partkey % 9 = 0 AS gone, p_partkey % 5 AS k, p_partkey % 7 <> 0 AS up, regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS name FROM part),
x AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS name FROM part WHERE p_size % 2 = 0), w AS (SELECT DISTINCT regexp_replace(p_brand, '[^A-Za-z0-9]', '_', 'g') AS name FROM part WHERE p_size = 1),
v AS (SELECT id, CASE WHEN gone THEN 'file_missing' WHEN k = 1 THEN 'file_only' WHEN k = 0 THEN 'symbol_not_checkable' WHEN up AND name IN (SELECT name FROM x) THEN 'symbol_indexed' WHEN name IN (SELECT name FROM w) THEN 'symbol_in_text' ELSE 'symbol_missing' END AS reason, NOT gone AND k > 1 AND NOT up AS is_partial FROM c)
SELECT id, reason, reason IN ('file_missing', 'symbol_missing') AS is_unsupported, is_partial FROM v"""


def symbol_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.concat(F.col("p_type"), F.lit(" pkg.f"), F.col("p_size"), F.lit("()"))
    return table(spark, sf_dir, "part").select("p_partkey", bare_symbol(s).alias("bare"), checkable_symbol(F.concat(F.lit(" a.f"), F.col("p_size"), F.lit("() "))).alias("dotted"), checkable_symbol(s).alias("spaced"))


SYMBOL_NAMES = "SELECT p_partkey, 'f' || p_size AS bare, true AS dotted, false AS spaced FROM part"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("method"), F.col("user_id").alias("question"), (F.pmod("event_id", F.lit(10)) / 10.0).alias("precision"), F.when(F.col("event_id") % 3 != 0, F.pmod("event_id", F.lit(7)) / 7.0).alias("recall"),
        (F.pmod("event_id", F.lit(5)) / 5.0).alias("f1"), (F.col("event_id") % 2 == 0).alias("correct"), (F.col("event_id") % 4).alias("unsupported"), (F.col("event_id") % 1000).alias("tokens"))


_CELLS = "cells AS (SELECT event_type AS method, user_id AS question, (event_id % 10) / 10.0::DOUBLE AS p, CASE WHEN event_id % 3 <> 0 THEN (event_id % 7) / 7.0::DOUBLE END AS r, (event_id % 5) / 5.0::DOUBLE AS f, event_id % 2 = 0 AS ok, event_id % 4 AS bad, event_id % 1000 AS tokens FROM events)"
_ROLLUP = """roll AS (SELECT method, count(*) AS n, round(avg(p), 4) AS loc_p, round(avg(coalesce(r, 0)), 4) AS loc_r, round(avg(f), 4) AS loc_f1,
 round(count(*) FILTER (ok) / count(*), 4) AS correct_rate, sum(bad)::BIGINT AS unsupported, round(avg(tokens), 1) AS avg_tokens FROM cells GROUP BY method)"""
METHODS = ("click", "error", "purchase", "signup", "view", "absent")


def method_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.method_rollup(_cells(spark, sf_dir), rows(spark, "method string", *((m,) for m in METHODS)))


METHOD_ROLLUP = f"WITH {_CELLS}, {_ROLLUP}, m(method) AS (VALUES {', '.join(f'({quoted(m)})' for m in METHODS)}) SELECT method, coalesce(n, 0) AS n, loc_p, loc_r, loc_f1, correct_rate, unsupported, avg_tokens FROM m LEFT JOIN roll USING (method)"


def question_method_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.matrix(_cells(spark, sf_dir), "question", "method", list(METHODS), F.sum("tokens"))


QUESTION_MATRIX = f"WITH {_CELLS} SELECT question, " + ", ".join(f"(sum(tokens) FILTER (method = '{m}'))::BIGINT AS {m}" for m in METHODS) + " FROM cells GROUP BY question"


def delta_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.delta(method_rollup(spark, sf_dir), "click", "view")


DELTA = f"WITH {_CELLS}, {_ROLLUP} SELECT 'click' AS baseline, 'view' AS target, round(t.correct_rate - b.correct_rate, 4) AS delta_correct_rate, CASE WHEN b.avg_tokens > 0 THEN round(100 * (1 - t.avg_tokens / b.avg_tokens), 1) ELSE 0 END AS token_reduction_pct FROM roll b, roll t WHERE b.method = 'click' AND t.method = 'view'"


def mode_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    correct = F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False)
    status = F.when(F.col("o_orderpriority").startswith("1"), "actual").when(F.col("o_orderkey") % 97 == 0, "estimated").when(F.col("o_orderpriority").startswith("2"), "unknown").otherwise("actual")
    return rollup.mode_rollup(o.select(F.col("o_orderpriority").alias("mode"), correct.alias("correct"), (F.col("o_orderkey") % 5000).alias("tokens"), (F.col("o_orderkey") % 100).cast("decimal(18,6)").alias("cost"),
        F.when(F.col("o_custkey") % 3 == 0, (F.col("o_orderkey") % 60).cast("double")).alias("latency"), status.alias("cost_status"),
        (F.col("o_orderkey") % 3).alias("flags"), (F.col("o_orderkey") % 4).alias("bug_cycles"), (F.col("o_orderkey") % 2).alias("side_effects")))


MODE_AGGREGATE = """WITH c AS (SELECT o_orderpriority AS mode, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS ok, o_orderkey % 5000 AS tokens, o_orderkey % 100 AS cost, o_orderkey % 3 AS flags, o_orderkey % 4 AS cycles, o_orderkey % 2 AS side, CASE WHEN o_custkey % 3 = 0 THEN (o_orderkey % 60)::DOUBLE END AS latency,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'actual' WHEN o_orderkey % 97 = 0 THEN 'estimated' WHEN o_orderpriority LIKE '2%' THEN 'unknown' ELSE 'actual' END AS st FROM orders)
SELECT mode, count(*) AS cells, count(ok) AS evaluated, count(*) FILTER (ok) AS correct, round(count(*) FILTER (ok) / nullif(count(ok), 0), 4) AS correct_rate, sum(tokens)::BIGINT AS total_tokens, round(sum(tokens) / count(*), 1) AS avg_tokens,
 round(sum(cost)::DECIMAL(28,6) / count(*), 6)::DOUBLE AS avg_cost, round(avg(latency), 2) AS avg_latency, sum(flags)::BIGINT AS safety_flags, sum(cycles)::BIGINT AS bug_cycles, round(sum(cycles) / count(*), 2) AS avg_bug_cycles, sum(side)::BIGINT AS side_effects,
 CASE WHEN bool_and(st = 'actual') THEN 'actual' WHEN bool_or(st = 'estimated') THEN 'estimated' WHEN bool_and(st = 'unknown') THEN 'unknown' ELSE 'mixed' END AS cost_status FROM c GROUP BY mode"""


def retrieval_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    return rollup.retrieval_rollup(e.select(F.col("event_type").alias("method"), (k % 3 != 0).alias("present"), ((k % 11) / 11.0).alias("focus"), (k % 9000).alias("tokens"), (k % 13 == 0).alias("polluted"),
        F.when(k % 4 != 0, k % 5 != 0).alias("sufficient"), F.when(k % 6 != 0, (k % 8) / 8.0).alias("relevance")))


RETRIEVAL_ROLLUP = """WITH r AS (SELECT event_type AS method, event_id AS k FROM events),
a AS (SELECT method, round(100 * avg((k % 3 <> 0)::INT), 1) AS present, round(avg((k % 11) / 11.0::DOUBLE), 3) AS focus, round(avg(k % 9000), 1) AS tokens, count(*) FILTER (k % 13 = 0) || '/' || count(*) AS polluted,
 round(100 * avg((k % 5 <> 0)::INT) FILTER (k % 4 <> 0), 1) AS sufficient, round(avg((k % 8) / 8.0::DOUBLE) FILTER (k % 6 <> 0), 3) AS relevance FROM r GROUP BY method)
SELECT *, CASE WHEN tokens > 0 THEN round(sufficient / (tokens / 1000), 2) ELSE 0 END AS efficiency FROM a"""


def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").try_cast("int")
    by = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(k % 2 == 0).alias("yes"), F.count_if(k % 2 == 1).alias("no"))
    return by.select("user_id", F.concat_ws("/", F.col("yes").cast("string"), F.col("no").cast("string")).alias("tally"), scoring.majority(F.col("yes"), F.col("no")).alias("verdict"))


MAJORITY = "WITH v AS (SELECT user_id, count(*) FILTER (k % 2 = 0) AS y, count(*) FILTER (k % 2 = 1) AS n FROM (SELECT user_id, (props->>'k')::INT AS k FROM events) GROUP BY user_id) SELECT user_id, y || '/' || n AS tally, CASE WHEN y + n > 0 THEN y >= n END AS verdict FROM v"


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "role", F.length(F.coalesce("text", F.lit(""))).alias("prompt_chars"), (F.length(F.coalesce("text", F.lit(""))) * 2 + F.col("turn")).alias("response_chars"))


def _pins(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return rows(spark, "agent string, tier string", ("user", "high"), ("assistant", "low")), rows(spark, "tier string, model string", ("high", "deep"), ("low", "exec"))


def usage_by_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    modelled = usage.models_of(_log(spark, sf_dir), "role", *_pins(spark), fallback="other")
    return usage.usage_from_chars(modelled, ["role", "model"], "prompt_chars", "response_chars")


_USAGE = """u AS (SELECT conv_id, role, CASE role WHEN 'user' THEN 'deep' WHEN 'assistant' THEN 'exec' ELSE 'other' END AS model, (length(coalesce(text, '')) + 3) // 4 AS i, (length(coalesce(text, '')) * 2 + turn + 3) // 4 AS o FROM conversations)"""
USAGE_BY_AGENT = f"WITH {_USAGE} SELECT role, model, sum(i)::BIGINT AS input, sum(o)::BIGINT AS output, 0::BIGINT AS cache_write, 0::BIGINT AS cache_read FROM u GROUP BY role, model"


def _prices(spark: SparkSession) -> DataFrame:
    return rows(spark, "model string, input string, output string, cache_write string, cache_read string", *PRICES)


def cost_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    modelled = usage.models_of(_log(spark, sf_dir), "role", *_pins(spark), fallback="other")
    used = usage.usage_from_chars(modelled, ["conv_id", "model"], "prompt_chars", "response_chars").withColumn("source", F.when(F.col("conv_id") % 2 == 0, "session_jsonl").otherwise("char_estimate"))
    priced = usage.costs(used, _prices(spark), "source")
    return priced.groupBy("model", "status").agg(F.sum("amount").cast("decimal(18,6)").cast("string").alias("amount"), F.count(F.lit(1)).alias("cells"))


COST_BY_MODEL = f"""WITH {_USAGE}, c AS (SELECT conv_id, model, sum(i) AS i, sum(o) AS o FROM u GROUP BY conv_id, model), p(model, pi, po) AS (VALUES ('deep', 15, 75), ('exec', 3, 15)),
a AS (SELECT c.model, CASE WHEN p.model IS NULL THEN 'unknown' WHEN conv_id % 2 = 0 THEN 'actual' ELSE 'estimated' END AS status, CASE WHEN p.model IS NULL THEN 0::DECIMAL(18,6) ELSE ((i * pi + o * po)::DECIMAL(18,0) * 0.000001::DECIMAL(7,6))::DECIMAL(18,6) END AS amount FROM c LEFT JOIN p USING (model))
SELECT model, status, sum(amount)::DECIMAL(18,6)::VARCHAR AS amount, count(*) AS cells FROM a GROUP BY model, status"""


def usage_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    exact = log.where("conv_id % 3 = 0").select("conv_id", F.struct(F.col("prompt_chars").alias("input_tokens"), F.lit(None).cast("int").alias("output_tokens"), F.lit(2).alias("cache_creation_input_tokens"), F.lit(1).alias("cache_read_input_tokens")).alias("usage"))
    return integrity.prefer(usage.usage_from_sessions(exact, ["conv_id"]), usage.usage_from_chars(log, ["conv_id"], "prompt_chars", "response_chars"), ["conv_id"], "source", ("session_jsonl", "char_estimate"))


USAGE_FALLBACK = """SELECT conv_id, sum(CASE WHEN conv_id % 3 = 0 THEN length(coalesce(text, '')) ELSE (length(coalesce(text, '')) + 3) // 4 END)::BIGINT AS input, sum(CASE WHEN conv_id % 3 = 0 THEN 0 ELSE (length(coalesce(text, '')) * 2 + turn + 3) // 4 END)::BIGINT AS output,
 sum(CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 0 END)::BIGINT AS cache_write, sum(CASE WHEN conv_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS cache_read, CASE WHEN conv_id % 3 = 0 THEN 'session_jsonl' ELSE 'char_estimate' END AS source FROM conversations GROUP BY conv_id"""


def price_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price list with an entry for each part; every third one has another, every fifth of these is new, and some are comments."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    price = lambda x: [(x + i).cast("string").alias(b) for i, b in enumerate(usage.BUCKETS)]
    base = p.where(k % 15 != 0).select(F.concat(F.lit("m"), k).alias("model"), *price(k))
    name = F.when(k % 4 == 1, F.concat(F.lit("_m"), k)).otherwise(F.concat(F.lit("m"), k)).alias("model")
    return integrity.override(base, p.where(k % 3 == 0).select(name, *price(F.col("p_size"))), "model", usage.BUCKETS)


PRICE_OVERRIDE = """WITH x AS (SELECT *, p_partkey % 3 = 0 AND p_partkey % 4 <> 1 AS other FROM part WHERE p_partkey % 15 <> 0 OR p_partkey % 4 <> 1), y AS (SELECT p_partkey, CASE WHEN other THEN p_size ELSE p_partkey END AS v FROM x)
SELECT 'm' || p_partkey AS model, v::VARCHAR AS input, (v + 1)::VARCHAR AS output, (v + 2)::VARCHAR AS cache_write, (v + 3)::VARCHAR AS cache_read FROM y"""


def report_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = method_rollup(spark, sf_dir).withColumn("flags", F.array("method", F.lit("x"))).withColumn("any", F.col("n") > 0)
    return rollup.csv_columns(cells, ["method", "n", "loc_p", "flags", "any"])


REPORT_CSV = f"WITH {_CELLS}, {_ROLLUP}, m(method) AS (VALUES {', '.join(f'({quoted(m)})' for m in METHODS)}) SELECT method, coalesce(n, 0)::VARCHAR AS n, coalesce(loc_p::VARCHAR, '') AS loc_p, method || ';x' AS flags, CASE WHEN n > 0 THEN '1' ELSE '0' END AS \"any\" FROM m LEFT JOIN roll USING (method)"


def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.markdown_rows(method_rollup(spark, sf_dir), ["method", "n", "loc_p", "unsupported"]).select("method", "line")


REPORT_MARKDOWN = f"WITH {_CELLS}, {_ROLLUP}, m(method) AS (VALUES {', '.join(f'({quoted(m)})' for m in METHODS)}) SELECT method, '| ' || method || ' | ' || coalesce(n, 0) || ' | ' || coalesce(printf('%.4f', loc_p), '—') || ' | ' || coalesce(unsupported::VARCHAR, '—') || ' |' AS line FROM m LEFT JOIN roll USING (method)"


#: The caller's order of methods.
REPORTED = ("view", "absent", "purchase", "click")
_COLUMNS = ("method", "n", "loc_p", "loc_r", "loc_f1", "correct_rate", "unsupported", "avg_tokens")


def _order(spark: SparkSession) -> DataFrame:
    return rows(spark, "method string, pos int", *((m, i) for i, m in enumerate(REPORTED)))


def rollup_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = method_rollup(spark, sf_dir).where("n > 0")
    return rollup.report_rows(found, _order(spark), "method", list(_COLUMNS))


_IN_ORDER = f"o(method, pos) AS (VALUES {', '.join(f'({quoted(m)}, {i})' for i, m in enumerate(REPORTED))})"
ROLLUP_CSV = f"WITH {_CELLS}, {_ROLLUP}, {_IN_ORDER} SELECT pos, method, " + ", ".join(f"coalesce({c}::VARCHAR, '') AS {c}" for c in _COLUMNS[1:]) + " FROM o LEFT JOIN roll USING (method)"


def report_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup in the caller's order, the change between two methods, and that between two of which one has no cells."""
    found = method_rollup(spark, sf_dir)
    columns = ["method", "n", "loc_p", "correct_rate", "unsupported"]
    change = lambda a, b: rollup.delta_lines(rollup.delta(found, a, b))
    return rollup.report_sections(("Rollup", rollup.report_table(found.where("n > 0"), _order(spark), "method", columns)), ("Change", change("click", "view")), ("No change", change("click", "absent")))


REPORT_DOCUMENT = f"""WITH {_CELLS}, {_ROLLUP}, {_IN_ORDER}, d AS (SELECT round(t.correct_rate - b.correct_rate, 4) AS c, CASE WHEN b.avg_tokens > 0 THEN round(100 * (1 - t.avg_tokens / b.avg_tokens), 1) ELSE 0 END AS r FROM roll b, roll t WHERE b.method = 'click' AND t.method = 'view')
SELECT * FROM (VALUES (0, -9, '## Rollup'), (1, -9, '## Change'), (2, -9, '## No change'), (0, -2, '| method | n | loc_p | correct_rate | unsupported |'), (0, -1, '|---|---|---|---|---|'), (1, 0, '| metric | value |'), (1, 1, '|---|---|'), (1, 2, '| baseline | click |'), (1, 3, '| target | view |'), (2, 0, '_not available_')) t(section, pos, line)
UNION ALL SELECT 0, pos, '| ' || method || ' | ' || coalesce(n::VARCHAR, '—') || ' | ' || coalesce(printf('%.4f', loc_p), '—') || ' | ' || coalesce(printf('%.4f', correct_rate), '—') || ' | ' || coalesce(unsupported::VARCHAR, '—') || ' |' FROM o LEFT JOIN roll USING (method)
UNION ALL SELECT 1, 4, '| delta_correct_rate | ' || printf('%+.4f', c::DOUBLE) || ' |' FROM d UNION ALL SELECT 1, 5, '| token_reduction_pct | ' || printf('%+.1f', r::DOUBLE) || ' |' FROM d"""


def estimated_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.sum(estimated_tokens(F.col("text"))).alias("tokens"))


ESTIMATED_TOKENS = "SELECT lang, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY lang"

_SQL = {
    page_url_norm: PAGE_URL_NORM, citation_prose: CITATION_PROSE, citation_json: CITATION_JSON, parse_mode_mix: PARSE_MODE_MIX, location_prf: LOCATION_PRF, correctness: CORRECTNESS, symbol_existence: SYMBOL_EXISTENCE, symbol_names: SYMBOL_NAMES,
    method_rollup: METHOD_ROLLUP, question_method_matrix: QUESTION_MATRIX, delta_table: DELTA, mode_aggregate: MODE_AGGREGATE, retrieval_rollup: RETRIEVAL_ROLLUP, majority_vote: MAJORITY, usage_by_agent: USAGE_BY_AGENT,
    cost_by_model: COST_BY_MODEL, usage_fallback: USAGE_FALLBACK, price_override: PRICE_OVERRIDE, report_csv: REPORT_CSV, report_markdown: REPORT_MARKDOWN, rollup_csv: ROLLUP_CSV, report_document: REPORT_DOCUMENT, estimated_token_counts: ESTIMATED_TOKENS,
}
QUERIES = {f.__name__: f for f in _SQL}
ORACLE = {f.__name__: s for f, s in _SQL.items()}
