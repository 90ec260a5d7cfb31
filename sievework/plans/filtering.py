"""Queries on sensitive text: scan, redact, block, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.detectors import DETECTORS, MAX_SCAN_BYTES, TOKEN, Detector, Policy, jvm_regex
from sievework.functions.text import shannon_entropy
from sievework.operators.integrity import upsert
from sievework.operators.spans import MAY_LEAVE, merge_metadata, scan, scan_and_filter, scan_counts, worth_searching
from sievework.plans.common import INJECTED_SQL, injected, quoted, table

RULES = tuple(d for d in DETECTORS if d.type != "entropy")
ENTROPY = next(d for d in DETECTORS if d.type == "entropy")
POLICY = Policy()


def _hits(d: Detector) -> str:
    return f"len(regexp_extract_all(text, {quoted(d.regex)}))"


_TOKENS = f"regexp_extract_all(text, {quoted(TOKEN)})"
_H = "list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: -((len(t) - len(replace(t, c, ''))) / len(t)) * log2((len(t) - len(replace(t, c, ''))) / len(t))))"
_FITS = f"strlen(t) BETWEEN {ENTROPY.min_length} AND {ENTROPY.max_length} AND NOT (" + " OR ".join(f"regexp_matches(t, {quoted(x)})" for x in ENTROPY.exclude_patterns) + f") AND {_H} >= {ENTROPY.threshold}"
_ENTROPY_HITS = f"len(list_filter({_TOKENS}, lambda t: {_FITS}))"
_ALL_HITS = {**{d.id: _hits(d) for d in RULES}, ENTROPY.id: _ENTROPY_HITS}


def _ids(action: str, prefix: str = "") -> str:
    some = [d for d in DETECTORS if d.action == action]
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN n_{d.id} > 0 THEN '{prefix}{d.id}' END" for d in some) + "], lambda x: x IS NOT NULL), ',')"


def redacted_sql(text: str) -> str:
    """All redacting rules one after the other, the one that can hold others inside first."""
    for d in sorted((d for d in RULES if d.action == "redact"), key=lambda d: d.id != "db_connection_string"):
        text = f"regexp_replace({text}, {quoted(d.regex)}, '[REDACTED:{d.id}]', 'g')"
    return text


def scanned_sql(source: str, keep: str) -> str:
    counts = ", ".join(f"{e} AS n_{k}" for k, e in _ALL_HITS.items())
    redact = " + ".join(f"n_{d.id}" for d in DETECTORS if d.action == "redact")
    block = " + ".join(f"n_{d.id}" for d in DETECTORS if d.action == "block")
    return f"""counted AS (SELECT {keep}, text, {counts} FROM {source}),
scanned AS (SELECT *, {block} AS blocks, {redact} AS redacts FROM counted),
filtered AS (SELECT {keep}, text, blocks,
  CASE WHEN blocks > 0 THEN 'BLOCKED' WHEN redacts > 0 THEN 'REDACTED' ELSE 'CLEAN' END AS scan_result,
  CASE WHEN blocks > 0 THEN 0 ELSE redacts END AS redacted_count,
  CASE WHEN blocks > 0 THEN '' ELSE {_ids('redact')} END AS redacted_patterns, {_ids('block')} AS blocked_patterns,
  CASE WHEN blocks > 0 THEN '' ELSE {_ids('warn', 'warn:')} END AS warnings FROM scanned)"""


def _joined(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.array_join(c, ",") for c in ("redacted_patterns", "blocked_patterns", "warnings")})


def filter_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = injected(table(spark, sf_dir, "documents")).select("text", F.lower("text").alias("low"))
    counted = docs.select(F.explode(F.array(*(F.struct(F.lit(d.id).alias("pattern_id"), F.when(worth_searching(F.col("text"), F.col("low"), d), F.regexp_count("text", F.lit(jvm_regex(d.regex)))).otherwise(0).alias("n")) for d in RULES))).alias("x"))
    return counted.groupBy(F.col("x.pattern_id").alias("pattern_id")).agg(F.sum("x.n").cast("long").alias("matches"), F.count_if(F.col("x.n") > 0).alias("texts"))


FILTER_MATCH_COUNTS = "WITH " + INJECTED_SQL + " " + " UNION ALL ".join(f"SELECT '{d.id}' AS pattern_id, sum({_hits(d)})::BIGINT AS matches, count(*) FILTER ({_hits(d)} > 0) AS texts FROM doc_inj" for d in RULES)


def filter_rollup_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_counts(injected(table(spark, sf_dir, "documents")), "text", POLICY)
    count = lambda r: F.count_if(F.col("scan_result") == r).alias(r.lower())
    return found.groupBy("source").agg(count("CLEAN"), count("REDACTED"), count("BLOCKED"), F.sum("redacted_count").alias("redacted_spans"))


FILTER_ROLLUP = "WITH " + INJECTED_SQL + ", " + scanned_sql("doc_inj", "doc_id, source") + """
SELECT source, count(*) FILTER (scan_result = 'CLEAN') AS clean, count(*) FILTER (scan_result = 'REDACTED') AS redacted,
       count(*) FILTER (scan_result = 'BLOCKED') AS blocked, sum(redacted_count)::BIGINT AS redacted_spans FROM filtered GROUP BY source"""


def filter_redacted_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_and_filter(injected(table(spark, sf_dir, "documents")), "text", POLICY)
    return found.select("doc_id", "scan_result", F.length("filtered_text").cast("long").alias("n_chars"), F.md5(F.col("filtered_text").cast("binary")).alias("text_md5"), F.right("filtered_text", F.lit(40)).alias("tail"))


FILTER_REDACTED = "WITH " + INJECTED_SQL + ", " + scanned_sql("doc_inj", "doc_id, source") + f""",
done AS (SELECT doc_id, scan_result, CASE WHEN blocks > 0 THEN '' ELSE {redacted_sql('text')} END AS t FROM filtered)
SELECT doc_id, scan_result, length(t) AS n_chars, md5(t) AS text_md5, right(t, 40) AS tail FROM done"""


def filter_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_and_filter(injected(table(spark, sf_dir, "documents")), "text", POLICY)
    return _joined(found).select("doc_id", "scan_result", "redacted_count", "redacted_patterns", "blocked_patterns", "warnings")


FILTER_METADATA = "WITH " + INJECTED_SQL + ", " + scanned_sql("doc_inj", "doc_id, source") + " SELECT doc_id, scan_result, redacted_count::BIGINT AS redacted_count, redacted_patterns, blocked_patterns, warnings FROM filtered"


def filter_drop_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_and_filter(injected(table(spark, sf_dir, "documents")), "text", POLICY)
    may = F.expr(MAY_LEAVE)
    merged = merge_metadata(found, "source", order=F.col("doc_id"), kept=F.when(may, 1), kept_chars=F.when(may, F.length("filtered_text")))
    return _joined(merged).select("source", "scan_result", "redacted_count", "redacted_patterns", "blocked_patterns", "warnings", "kept", "kept_chars")


FILTER_DROP = "WITH " + INJECTED_SQL + ", " + scanned_sql("doc_inj", "doc_id, source") + f""",
m AS (SELECT source, CASE max(CASE scan_result WHEN 'BLOCKED' THEN 2 WHEN 'REDACTED' THEN 1 ELSE 0 END) WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'REDACTED' ELSE 'CLEAN' END AS scan_result,
             sum(redacted_count)::BIGINT AS redacted_count FROM filtered GROUP BY source),
u AS (SELECT source, 'r' AS list, doc_id, string_split(redacted_patterns, ',') AS l FROM filtered UNION ALL SELECT source, 'b', doc_id, string_split(blocked_patterns, ',') FROM filtered UNION ALL SELECT source, 'w', doc_id, string_split(warnings, ',') FROM filtered),
n AS (SELECT source, list, doc_id, unnest(l) AS name, generate_subscripts(l, 1) AS pos FROM u), f AS (SELECT source, list, name, min((doc_id, pos)) AS spot FROM n WHERE name <> '' GROUP BY ALL),
p AS (SELECT source, coalesce(string_agg(name, ',' ORDER BY spot) FILTER (list = 'r'), '') AS redacted_patterns, coalesce(string_agg(name, ',' ORDER BY spot) FILTER (list = 'b'), '') AS blocked_patterns, coalesce(string_agg(name, ',' ORDER BY spot) FILTER (list = 'w'), '') AS warnings FROM f GROUP BY source),
k AS (SELECT source, count(*) AS kept, sum(length({redacted_sql('text')}))::BIGINT AS kept_chars FROM filtered WHERE blocks = 0 GROUP BY source)
SELECT m.source, scan_result, redacted_count, coalesce(redacted_patterns, '') AS redacted_patterns, coalesce(blocked_patterns, '') AS blocked_patterns, coalesce(warnings, '') AS warnings, kept, kept_chars FROM m LEFT JOIN k USING (source) LEFT JOIN p USING (source)"""


def filter_oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.repeat(F.lit("x"), 2_000_000)).otherwise(F.col("text")))
    return scan_and_filter(docs, "text", Policy(detectors=RULES)).groupBy("scan_result").agg(F.count(F.lit(1)).alias("n"), F.max(F.array_join("blocked_patterns", ",")).alias("reason"))


FILTER_OVERSIZE = f"""WITH big AS (SELECT doc_id, CASE WHEN doc_id % 100 = 0 THEN repeat('x', 2000000) ELSE text END AS text FROM documents),
small AS (SELECT doc_id, text FROM big WHERE strlen(text) <= {MAX_SCAN_BYTES}),
{scanned_sql('small', 'doc_id')},
r AS (SELECT scan_result, blocked_patterns AS reason FROM filtered UNION ALL SELECT 'BLOCKED', 'payload_too_large:' || strlen(text) FROM big WHERE strlen(text) > {MAX_SCAN_BYTES})
SELECT scan_result, count(*) AS n, max(reason) AS reason FROM r GROUP BY scan_result"""


def entropy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = injected(table(spark, sf_dir, "documents"))
    spans = docs.select("doc_id", "text", F.explode(scan(F.col("text"), Policy(detectors=(ENTROPY,)))).alias("s"))
    token = F.expr("substring(text, s.first + 1, s.last - s.first)")
    return spans.select("doc_id", token.alias("token"), F.round(shannon_entropy(token), 6).alias("entropy"))


ENTROPY_TOKENS = "WITH " + INJECTED_SQL + f", tok AS (SELECT doc_id, unnest({_TOKENS}) AS t FROM doc_inj) SELECT doc_id, t AS token, round({_H}, 6) AS entropy FROM tok WHERE {_FITS}"


def policy_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of every order: its first four lines as they come, and those from the third on as its own, in reverse, for the rules one further up."""
    li, n = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("l_returnflag"), F.min("l_linestatus").alias("l_linestatus")), F.col("l_linenumber")
    rule = lambda k: F.concat(F.lit("rule_"), k).alias("id")
    base = li.where(n <= 4).select("l_orderkey", rule(n), F.col("l_returnflag").alias("action"), n.cast("int").alias("pos"))
    own = li.where(n >= 3).select("l_orderkey", rule(n - 1), F.concat(F.lit("own_"), "l_linestatus").alias("action"), (10 - n).cast("int").alias("pos"))
    return upsert(base, own, "id", "pos", ("action",), by=("l_orderkey",))


POLICY_UPSERT = """WITH li AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag, min(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey, 'rule_' || l_linenumber AS id, l_returnflag AS action, l_linenumber AS pos FROM li WHERE l_linenumber <= 4), c AS (SELECT l_orderkey, 'rule_' || (l_linenumber - 1) AS id, 'own_' || l_linestatus AS action, 10 - l_linenumber AS pos FROM li WHERE l_linenumber >= 3)
SELECT l_orderkey, id, CASE WHEN c.pos IS NULL THEN b.action ELSE c.action END AS action, row_number() OVER (PARTITION BY l_orderkey ORDER BY b.pos NULLS LAST, c.pos) - 1 AS pos FROM b FULL JOIN c USING (l_orderkey, id)"""


def email_warnings_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    mail = next(d for d in RULES if d.id == "email_address")
    return table(spark, sf_dir, "documents").select("doc_id", F.regexp_count("text", F.lit(jvm_regex(mail.regex))).cast("long").alias("n")).where("n > 0")


EMAIL_WARNINGS = "SELECT doc_id, n FROM (SELECT doc_id, " + _ALL_HITS["email_address"] + " AS n FROM documents) WHERE n > 0"


def conversation_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_and_filter(table(spark, sf_dir, "conversations"), "text", POLICY)
    return merge_metadata(found, "role").select("role", "scan_result", "redacted_count", F.array_join("warnings", ",").alias("warnings"))


CONVERSATION_SANITIZE = "WITH " + scanned_sql("(SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)", "conv_id, turn, role") + """,
w AS (SELECT role, unnest(string_split(warnings, ',')) AS x FROM filtered)
SELECT f.role, CASE max(CASE scan_result WHEN 'BLOCKED' THEN 2 WHEN 'REDACTED' THEN 1 ELSE 0 END) WHEN 2 THEN 'BLOCKED' WHEN 1 THEN 'REDACTED' ELSE 'CLEAN' END AS scan_result,
       sum(redacted_count)::BIGINT AS redacted_count, coalesce((SELECT array_to_string(list_sort(list_distinct(list(x))), ',') FROM w WHERE w.role = f.role AND x <> ''), '') AS warnings
FROM filtered f GROUP BY f.role"""

QUERIES = {f.__name__: f for f in (filter_match_counts, filter_rollup_by_source, filter_redacted_text, filter_metadata, filter_drop_blocked, filter_oversize, entropy_tokens, policy_upsert, email_warnings_raw, conversation_sanitize)}
ORACLE = {
    "filter_match_counts": FILTER_MATCH_COUNTS, "filter_rollup_by_source": FILTER_ROLLUP, "filter_redacted_text": FILTER_REDACTED, "filter_metadata": FILTER_METADATA, "filter_drop_blocked": FILTER_DROP,
    "filter_oversize": FILTER_OVERSIZE, "entropy_tokens": ENTROPY_TOKENS, "policy_upsert": POLICY_UPSERT, "email_warnings_raw": EMAIL_WARNINGS, "conversation_sanitize": CONVERSATION_SANITIZE,
}
