"""Queries on ranking, graphs and path rules."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import fts_safe, line_range, search_terms, ticket_id
from sievework.operators import diffs, domains, graph, ranking
from sievework.operators.integrity import priority_lookup
from sievework.plans.common import rows, table
from sievework.session import shared_folder
from sievework.sources.text_index import PATTERN, TextIndex, build_index, open_index, update_index

K = 5
_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[a-z]{4,}')"
INDEX_CTE = f"""w AS (SELECT doc_id AS id, unnest({_WORDS}) AS term, len({_WORDS}) AS dl FROM documents),
ix AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM w GROUP BY id, term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark)"""


def built(spark: SparkSession, sf_dir: str, pattern: str = PATTERN, fold: bool = True) -> TextIndex:
    """The index of documents, built once a session for each state of the table's files."""
    docs = table(spark, sf_dir, "documents")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    state = hashlib.sha256("|".join(sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)).encode()).hexdigest()[:32]
    path = f"{shared_folder(spark)}/text-index-{spark.sparkContext.applicationId}-{state}-{hashlib.sha256(f'{pattern} {fold}'.encode()).hexdigest()[:8]}"
    try:
        return open_index(spark, path)
    except FileNotFoundError:
        build_index(docs, path, pattern=pattern, fold=fold)
        return open_index(spark, path)


def index_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored index's own statistics; the first query of a session that asks for the index builds it."""
    index = built(spark, sf_dir)
    terms = index.frequencies.agg(F.count(F.lit(1)).alias("n_different"), F.sum("df").alias("n_pairs"))
    return index.totals.join(F.broadcast(terms), F.lit(True))  # one row each


INDEX_STATISTICS = f"WITH {INDEX_CTE} SELECT count(DISTINCT id) AS n_docs, sum(tf)::BIGINT AS n_terms, count(DISTINCT term) AS n_different, count(*) AS n_pairs FROM ix"


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.terms_of(table(spark, sf_dir, "benchmark"), "item_id", "text").select(F.col("id").alias("query_id"), "term")


def keyword_ranking(spark: SparkSession, sf_dir: str, k: int = K) -> DataFrame:
    queries, index, docs = queries_of(spark, sf_dir), built(spark, sf_dir).postings, table(spark, sf_dir, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), F.length("text").alias("size"), F.substring_index(F.trim("text"), " ", 1).alias("name"))  # a text's first word stands in for a file's name
    return ranking.best_documents(queries, ranking.keyword_parts(queries, index, sizes), ["id"], ["size"], k, docs.count())


def keyword_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyword_ranking(spark, sf_dir).select("query_id", "id", F.col("score").cast("long").alias("score"), "rank")


_KEYWORD = f"""kw AS (SELECT query_id, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size, id) AS rank FROM (SELECT query_id, id, 10 * count(*) + max(contains(lower(string_split(trim(d.text, ' '), ' ')[1]), term)::INT) AS score, any_value(length(d.text)) AS size
 FROM q JOIN ix USING (term) JOIN documents d ON d.doc_id = id GROUP BY query_id, id)) WHERE rank <= {K})"""
KEYWORD_TOPK = f"WITH {INDEX_CTE}, {_KEYWORD} SELECT * FROM kw"


def bm25_ranking(queries: DataFrame, index: TextIndex) -> DataFrame:
    wanted = F.broadcast(queries.select("term").distinct())
    parts = ranking.bm25_parts(wanted, index.postings, index.frequencies, index.totals)
    return ranking.best_documents(queries, parts, ["id"], [], K, index.totals.first()["n_docs"], 6)


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_ranking(queries_of(spark, sf_dir), built(spark, sf_dir)).select("query_id", "id", "score", "rank")


BM25_CTE = f"""st AS (SELECT count(*) AS n, avg(dl) AS av FROM (SELECT id, any_value(dl) AS dl FROM ix GROUP BY id)), dfs AS (SELECT term, count(*) AS df FROM ix GROUP BY term),
bs AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / av))), 6) AS score FROM q JOIN ix USING (term) JOIN dfs USING (term), st GROUP BY query_id, id),
bm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bs) WHERE rank <= {K})"""
BM25_TOPK = f"WITH {INDEX_CTE}, {BM25_CTE} SELECT query_id, id, score, rank FROM bm"


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = ranking.reciprocal_rank_fusion([keyword_ranking(spark, sf_dir), bm25_ranking(queries_of(spark, sf_dir), built(spark, sf_dir))])
    return fused.select("query_id", "id", F.round("score", 8).alias("score"))


RRF = f"WITH {INDEX_CTE}, {_KEYWORD}, {BM25_CTE} SELECT query_id, id, round(sum(1.0 / (60 + rank)), 8) AS score FROM (SELECT query_id, id, rank FROM kw UNION ALL SELECT query_id, id, rank FROM bm) GROUP BY query_id, id"


def _before(docs: DataFrame) -> DataFrame:
    """documents as they were: without every tenth, and another tenth with other texts."""
    text = F.when(F.col("doc_id") % 10 == 2, F.concat(F.lit("stale wording "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return docs.where("doc_id % 10 <> 1").withColumn("text", text)


def _updated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, TextIndex]:
    """Changes, and the index that is built of the documents as they were and brought to those of today, without a tenth that is gone."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"
    build_index(_before(docs), path)
    changes = update_index(docs.where("doc_id % 10 <> 3"), path)
    return changes, open_index(spark, path)


def index_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed documents by kind, and the statistics after the update."""
    changes, index = _updated(spark, sf_dir)
    terms = index.frequencies.agg(F.count(F.lit(1)).alias("n_different"), F.sum("df").alias("n_pairs"))
    one = index.totals.join(F.broadcast(terms), F.lit(True))  # one row each
    return changes.groupBy("change").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(one), F.lit(True))


_NOW = f"""w AS (SELECT doc_id AS id, unnest({_WORDS}) AS term, len({_WORDS}) AS dl FROM documents WHERE doc_id % 10 <> 3),
ix AS MATERIALIZED (SELECT id, term, count(*) AS tf, any_value(dl) AS dl FROM w GROUP BY id, term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark)"""
INDEX_UPDATE = f"""WITH {_NOW} SELECT change, n, n_docs, n_terms, n_different, n_pairs FROM (SELECT CASE doc_id % 10 WHEN 1 THEN 'added' WHEN 2 THEN 'changed' ELSE 'removed' END AS change, count(*) AS n FROM documents WHERE doc_id % 10 IN (1, 2, 3) GROUP BY 1),
 (SELECT count(DISTINCT id) AS n_docs, sum(tf)::BIGINT AS n_terms, count(DISTINCT term) AS n_different, count(*) AS n_pairs FROM ix)"""


def updated_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, over an index that has been updated."""
    return bm25_ranking(queries_of(spark, sf_dir), _updated(spark, sf_dir)[1]).select("query_id", "id", "score", "rank")


UPDATED_BM25 = f"WITH {_NOW}, {BM25_CTE} SELECT query_id, id, score, rank FROM bm"


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    found = ranking.vector_top_k(v.where("vec_id % 100 = 0"), v, 3)
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


VECTOR_TOPK = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.e, v.e) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 3"""


def filtered_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors with the language and source of the document of their number as language and kind."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("language"), F.concat(F.lit("src/p"), F.floor(F.col("doc_id") / 4), F.lit("/d"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".md").otherwise(".go")).alias("path"), F.coalesce("source", F.lit("none")).alias("kind"))
    v = table(spark, sf_dir, "embeddings")
    found = ranking.semantic_search(v.where("vec_id % 100 = 0").select("vec_id", "embedding"), v.join(d, "vec_id"), 3, "en", "src/**/d?*.go")
    return found.select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


FILTERED_SEARCH = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), f AS (SELECT v.* FROM v JOIN documents ON doc_id = vec_id WHERE lang = 'en' AND doc_id % 3 <> 0), s AS (SELECT q.vec_id AS query_id, f.vec_id, list_cosine_similarity(q.e, f.e) AS score FROM v q, f WHERE q.vec_id % 100 = 0 AND q.vec_id <> f.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, round(score, 5) AS score, rank FROM r WHERE rank <= 3"""


def budget_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.length("text").alias("size"))
    return ranking.within_budget(docs, ["source"], [F.col("doc_id")], F.col("size"), 40_000).select("source", "doc_id", "used")


BUDGET_PACK = "SELECT source, doc_id, used FROM (SELECT source, doc_id, (sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS used FROM documents) WHERE used <= 40000"


def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    cut = ranking.cut_to_budget(docs, ["source"], [F.col("doc_id")], "text", 20_000, "\n[cut]")
    return cut.select("source", "doc_id", "before", F.length("text").cast("long").alias("size"), F.endswith("text", F.lit("[cut]")).alias("is_cut"))


BUDGET_CUT = """WITH b AS (SELECT source, doc_id, length(text) AS n, (sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - length(text))::BIGINT AS before FROM documents)
SELECT source, doc_id, before, CASE WHEN n <= 20000 - before THEN n ELSE 20000 - before + 6 END::BIGINT AS size, n > 20000 - before AS is_cut FROM b WHERE before < 20000"""


def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("/"), F.col("n_nationkey") % 100).alias("term"))
    hits = queries.where("query_id % 2 = 0").select("query_id")
    names = table(spark, sf_dir, "pages").select(F.col("url").alias("name"), F.col("page_id").alias("pos"))
    return ranking.search_fallback(queries, hits, names, 3).select("query_id", "name", "rank")


KEYWORD_FALLBACK = "SELECT query_id, name, rank FROM (SELECT n_nationkey AS query_id, url AS name, row_number() OVER (PARTITION BY n_nationkey ORDER BY page_id) AS rank FROM nation JOIN pages ON contains(lower(url), '/' || (n_nationkey % 100)) WHERE n_nationkey % 2 = 1) WHERE rank <= 3"


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.concat(F.lit("Where does `poolSize` use "), F.coalesce("text", F.lit("")), F.lit(" getX? Cite the exact file."))
    b = table(spark, sf_dir, "benchmark").select("item_id", prompt.alias("p"))
    return b.select("item_id", F.array_join(search_terms(F.col("p"), ("where", "does", "cite")), ",").alias("terms"), F.length(fts_safe(F.col("p"))).cast("long").alias("safe_chars"))


#: Terms of whole texts are beyond SQL: tests hold them against a plain version.
QUERY_TERMS = None


def ticket_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    branch = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("fix/ABC-"), "c_custkey", F.lit("-x")))
    return c.select("c_custkey", ticket_id(branch, F.concat(F.lit("see "), F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper("c_mktsegment"), F.lit("-7"))).otherwise(F.lit("none")))).alias("ticket"))


TICKET_IDS = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'ABC-' || c_custkey WHEN c_custkey % 2 = 0 THEN nullif(regexp_extract(upper(c_mktsegment) || '-7', '[A-Z]+-[0-9]+'), '') END AS ticket FROM customer"


def text_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.when(F.col("doc_id") % 2 == 0, F.lit(2))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(line_range(F.col("text"), start, F.lit(3)).cast("binary")).alias("lines_md5"))


TEXT_RANGES = "SELECT doc_id, md5(array_to_string(CASE WHEN doc_id % 2 = 0 THEN string_split(text, chr(10))[2:3] ELSE string_split(text, chr(10))[1:80] END, chr(10))) AS lines_md5 FROM documents"


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> order -> line, and line -> next line of its order: of all orders and lines, as often as the tables have them."""
    name = lambda kind, *cs: F.concat(F.lit(kind), F.concat_ws(".", *(F.col(c).cast("string") for c in cs)))
    placed = table(spark, sf_dir, "orders").select(name("c", "o_custkey").alias("src"), name("o", "o_orderkey").alias("dst"), F.lit("placed").alias("kind"))
    lines = table(spark, sf_dir, "lineitem")
    line = name("l", "l_orderkey", "l_linenumber")
    holds = lines.select(name("o", "l_orderkey").alias("src"), line.alias("dst"), F.lit("holds").alias("kind"))
    follows = lines.where("l_linenumber > 1").select(F.concat(F.lit("l"), F.col("l_orderkey"), F.lit("."), F.col("l_linenumber") - 1).alias("src"), line.alias("dst"), F.lit("follows").alias("kind"))
    return placed.unionByName(holds).unionByName(follows)


_EDGES = """e AS (SELECT DISTINCT * FROM (SELECT 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'placed' AS kind FROM orders UNION ALL SELECT 'o' || l_orderkey, 'l' || l_orderkey || '.' || l_linenumber, 'holds' FROM lineitem
 UNION ALL SELECT 'l' || l_orderkey || '.' || (l_linenumber - 1), 'l' || l_orderkey || '.' || l_linenumber, 'follows' FROM lineitem WHERE l_linenumber > 1))"""


def walk_sql(hop: str, depth: int, seeds: str) -> str:
    return f"seeds AS ({seeds}), hop AS ({hop}), b(seed, node, depth) AS (SELECT node, node, 0 FROM seeds UNION SELECT b.seed, h.b, b.depth + 1 FROM b JOIN hop h ON h.a = b.node WHERE b.depth < {depth}), near AS (SELECT seed, node, min(depth) AS depth FROM b GROUP BY seed, node)"


def _seeds(spark: SparkSession, sf_dir: str, end: str, kind: str) -> DataFrame:
    """All nodes that edges of the kind have at this end."""
    return _edges(spark, sf_dir).where(F.col("kind") == kind).select(F.col(end).alias("node")).distinct()


def graph_callees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_seeds(spark, sf_dir, "src", "placed"), _edges(spark, sf_dir), 2, cap=50).select("seed", "node", "depth")


GRAPH_CALLEES = f"""WITH RECURSIVE {_EDGES}, {walk_sql('SELECT DISTINCT src AS a, dst AS b FROM e', 2, "SELECT DISTINCT src AS node FROM e WHERE kind = 'placed'")} SELECT seed, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS n FROM near WHERE depth > 0) WHERE n <= 50"""


def graph_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_seeds(spark, sf_dir, "dst", "holds"), _edges(spark, sf_dir), 2, direction="in").select("seed", "node", "depth")


_INTO_LINES = walk_sql("SELECT DISTINCT dst AS a, src AS b FROM e", 2, "SELECT DISTINCT dst AS node FROM e WHERE kind = 'holds'")
GRAPH_CALLERS = f"WITH RECURSIVE {_EDGES}, {_INTO_LINES} SELECT seed, node, depth FROM near WHERE depth > 0"


def graph_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.subgraph(_seeds(spark, sf_dir, "dst", "placed"), _edges(spark, sf_dir), 2)


_AROUND_ORDERS = "SELECT DISTINCT dst AS node FROM e WHERE kind = 'placed'"
GRAPH_SUBGRAPH = f"""WITH RECURSIVE {_EDGES}, {walk_sql('SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e', 2, _AROUND_ORDERS)} SELECT x.seed, src, dst, kind FROM e JOIN near x ON x.node = src JOIN near y ON y.node = dst AND y.seed = x.seed"""

#: Couplings of the kinds of edges here.
COUPLED = {"holds": "callers", "follows": "concurrent"}


def impact_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.impact(_seeds(spark, sf_dir, "dst", "holds"), _edges(spark, sf_dir), 2, COUPLED)


IMPACT = f"""WITH RECURSIVE {_EDGES}, {_INTO_LINES}, best AS (SELECT x.seed, x.node, min(CASE kind WHEN 'holds' THEN 'a callers' WHEN 'follows' THEN 'b concurrent' ELSE 'c other' END) AS c FROM near x JOIN e ON e.src = x.node JOIN near y ON y.node = e.dst AND y.seed = x.seed AND y.depth = x.depth - 1 WHERE x.depth > 0 GROUP BY ALL)
SELECT seed, c[3:] AS category, count(*) AS n FROM best GROUP BY ALL"""


def kind_limited_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(_seeds(spark, sf_dir, "dst", "placed"), _edges(spark, sf_dir), 2, kinds=("placed",), direction="both").select("seed", "node", "depth")


KIND_LIMITED = f"""WITH RECURSIVE {_EDGES}, {walk_sql("SELECT src AS a, dst AS b FROM e WHERE kind = 'placed' UNION SELECT dst, src FROM e WHERE kind = 'placed'", 2, _AROUND_ORDERS)} SELECT seed, node, depth FROM near WHERE depth > 0"""


def step_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as steps: each needs the one before it in its ten and the first of the ten before; the last two wait for each other."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"))
    most = s.agg(F.max("k").alias("most"))
    edges = s.join(F.broadcast(most), F.lit(True))
    step = lambda c: F.concat(F.lit("s"), c.cast("string"))
    k, last = F.col("k"), F.col("most")
    chain = edges.where(k % 10 != 0).select(step(k).alias("step"), step(k - 1).alias("needed"))
    tens = edges.where((k >= 10) & (k % 10 == 0)).select(step(k).alias("step"), step(k - 10).alias("needed"))
    ring = edges.where(k == last - 1).select(step(k).alias("step"), step(last).alias("needed"))
    return graph.step_order(s.select(step(k).alias("step")), chain.unionByName(tens).unionByName(ring))


STEP_ORDER = "SELECT 's' || k AS step, CASE WHEN k < m - 1 THEN k // 10 + k % 10 END::INT AS level FROM (SELECT s_suppkey AS k, max(s_suppkey) OVER () AS m FROM supplier)"


#: Parts of a path, the first that it contains decides.
RULES = (("/en/", "english"), ("/de/", "german"), ("/fr/", "romance"), ("/es/", "romance"), ("/a", "letters"), ("example", "sample"), ("/", "other"))
SENSITIVE = ("german",)


def module_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts as changes, whose files are their pages; a host's summary is its name and what its number of pages says."""
    p = table(spark, sf_dir, "pages").select(F.regexp_extract("url", "^[a-z]+://([^/]*)", 1).alias("id"), F.regexp_replace("url", "^[a-z]+://[^/]*", "").alias("path"))
    ruled = domains.classified(p, rows(spark, "pos int, part string, module string", *((i, *r) for i, r in enumerate(RULES))))
    n = p.groupBy("id").agg(F.count(F.lit(1)).alias("pages"))
    summary = F.concat_ws(" ", "id", F.when(F.col("pages") % 5 == 0, "HardFork"), F.when(F.col("pages") % 3 == 0, "a Mutex"))
    found = domains.domains_of(ruled).join(n, "id")
    return found.select("id", "primary_domain", F.array_join("domains", ",").alias("domains"), "confidence", domains.complexity(F.col("domains"), summary, SENSITIVE).alias("complexity"))


MODULE_CLASSIFY = f"""WITH p AS (SELECT regexp_extract(url, '^[a-z]+://([^/]*)', 1) AS id, regexp_replace(url, '^[a-z]+://[^/]*', '') AS path FROM pages),
r AS (SELECT DISTINCT id, path, CASE {" ".join(f"WHEN contains(path, '{part}') THEN '{m}'" for part, m in RULES)} END AS module FROM p), n AS (SELECT id, module, count(*) AS n FROM r WHERE module IS NOT NULL GROUP BY id, module),
d AS (SELECT id, list(module ORDER BY n DESC, module) AS m, max(n) AS top, sum(n) AS total FROM n GROUP BY id), s AS (SELECT id, lower(id) || CASE WHEN count(*) % 5 = 0 THEN ' hardfork' ELSE '' END || CASE WHEN count(*) % 3 = 0 THEN ' mutex' ELSE '' END AS s FROM p GROUP BY id),
l AS (SELECT s.id, coalesce(m, []) AS m, top, total, s, CASE WHEN coalesce(len(m), 0) >= 3 OR list_contains(coalesce(m, []), 'german') OR regexp_matches(s, 'genesis|hardfork|system contract') THEN 2 WHEN len(m) = 2 THEN 1 ELSE 0 END AS level FROM s LEFT JOIN d USING (id))
SELECT id, m[1] AS primary_domain, array_to_string(m, ',') AS domains, CASE WHEN len(m) = 1 THEN 'high' WHEN top * 2 >= total THEN 'medium' ELSE 'low' END AS confidence,
 ['simple', 'moderate', 'complex'][least(2, level + CASE WHEN regexp_matches(s, 'goroutine|race|mutex|concurrent') THEN 1 ELSE 0 END) + 1] AS complexity FROM l"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff for every document: its first half of lines goes from one file, a line is added to it, and all lines make up a new file."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "[\r@]", " "), "\n").alias("l"))
    half = F.floor((F.size("l") + 1) / 2).cast("int")
    each = lambda sign, lines: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(sign), x)), "\n")
    old = F.concat(F.lit("diff --git a/x b/x\nindex 1..2\n--- a/src/f"), "doc_id", F.lit(".go\n+++ b/src/f"), "doc_id", F.lit(".go\n@@ -3,"), half, F.lit(" +3 @@ func\n"), each("-", F.slice("l", F.lit(1), half)), F.lit("\n+added wording "), "doc_id")
    new = F.concat(F.lit("\n--- /dev/null\n+++ b/new/f"), "doc_id", F.lit(".go\n@@ -0,0 +1,"), F.size("l"), F.lit(" @@\n"), each("+", F.col("l")))
    return d.select("doc_id", F.concat(old, new).alias("diff"))


def diff_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = diffs.hunks(_diffs(spark, sf_dir), "doc_id", "diff")
    md5 = lambda c: F.md5(F.encode(c, "UTF-8")).alias(f"{c}_md5")
    return found.select(F.col("id").alias("doc_id"), "file", "pos", "old_start", "old_lines", "new_start", "new_lines", md5("added"), md5("removed"))


_HUNKS = """d AS (SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '[\r@]', ' ', 'g'), chr(10)) AS l FROM documents), d2 AS (SELECT *, (len(l) + 1) // 2 AS half FROM d),
hunk AS (SELECT doc_id, 'src/f' || doc_id || '.go' AS file, 0 AS pos, 3 AS old_start, half::INT AS old_lines, 3 AS new_start, 1 AS new_lines, 'added wording ' || doc_id AS added, array_to_string(l[1:half], chr(10)) AS removed FROM d2
 UNION ALL SELECT doc_id, 'new/f' || doc_id || '.go', 1, 0, 0, 1, len(l)::INT, array_to_string(l, chr(10)), '' FROM d2)"""
DIFF_HUNKS = f"WITH {_HUNKS} SELECT doc_id, file, pos, old_start, old_lines, new_start, new_lines, md5(added) AS added_md5, md5(removed) AS removed_md5 FROM hunk"


def change_hunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hunks that the items of the benchmark are about."""
    found = diffs.ranked_hunks(queries_of(spark, sf_dir), diffs.hunks(_diffs(spark, sf_dir), "doc_id", "diff"), K)
    return found.select("query_id", F.col("id").alias("doc_id"), "file", "pos", "score", "rank")


CHANGE_HUNKS = f"""WITH {_HUNKS}, hw AS (SELECT doc_id, pos, unnest(regexp_extract_all(lower(added || chr(10) || removed), '[a-z]{{4,}}')) AS term FROM hunk), ix AS MATERIALIZED (SELECT doc_id * 2 + pos AS id, term, count(*) AS tf, sum(count(*)) OVER (PARTITION BY doc_id, pos) AS dl FROM hw GROUP BY doc_id, pos, term),
q AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS}) AS term FROM benchmark), {BM25_CTE} SELECT query_id, id // 2 AS doc_id, CASE id % 2 WHEN 0 THEN 'src/f' ELSE 'new/f' END || (id // 2) || '.go' AS file, (id % 2)::INT AS pos, score, rank FROM bm"""


def transition_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wish for every order among a workflow's transitions."""
    wish = F.element_at(F.array(*map(F.lit, ("in review", "DONE", "indeterminate", "Start", "nowhere"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    options = rows(spark, "name string, to_status string, to_category string, pos int", ("Start", "In Progress", "indeterminate", 0), ("Send", "In Review", "indeterminate", 1), ("In review", "Waiting", "indeterminate", 2), ("Finish", "Done", "done", 3))
    return priority_lookup(table(spark, sf_dir, "orders").select("o_orderkey", wish.alias("target")), options, "target", ("name", "to_status", "to_category"), "pos")


TRANSITION_LOOKUP = """SELECT o_orderkey, t.* FROM orders JOIN (VALUES ('in review', 'In review', 'Waiting', 'indeterminate', 2), ('DONE', 'Finish', 'Done', 'done', 3), ('indeterminate', 'Start', 'In Progress', 'indeterminate', 0), ('Start', 'Start', 'In Progress', 'indeterminate', 0), ('nowhere', NULL, NULL, NULL, NULL)) t(target, name, to_status, to_category, pos)
 ON ['in review', 'DONE', 'indeterminate', 'Start', 'nowhere'][o_orderkey % 5 + 1] = target"""

_SQL = {
    index_statistics: INDEX_STATISTICS, keyword_topk: KEYWORD_TOPK, bm25_topk: BM25_TOPK, rrf_fusion: RRF, index_update: INDEX_UPDATE, updated_bm25_topk: UPDATED_BM25, vector_topk: VECTOR_TOPK, filtered_search: FILTERED_SEARCH, budget_pack: BUDGET_PACK, budget_cut: BUDGET_CUT, keyword_fallback: KEYWORD_FALLBACK, query_terms: QUERY_TERMS, ticket_ids: TICKET_IDS,
    text_ranges: TEXT_RANGES, graph_callees: GRAPH_CALLEES, graph_callers: GRAPH_CALLERS, graph_subgraph: GRAPH_SUBGRAPH, impact_by_category: IMPACT, kind_limited_impact: KIND_LIMITED, step_order: STEP_ORDER,
    module_classify: MODULE_CLASSIFY, diff_hunks: DIFF_HUNKS, change_hunks: CHANGE_HUNKS, transition_lookup: TRANSITION_LOOKUP,
}
QUERIES = {f.__name__: f for f in _SQL}
ORACLE = {f.__name__: s for f, s in _SQL.items() if s}
