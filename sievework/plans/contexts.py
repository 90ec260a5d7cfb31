"""Queries on what retrieval methods put into a context: documents as files, items of the benchmark as questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators import compositions, ranking
from sievework.operators.compositions import CUT_MARK, FULL_GRAPH, KEYWORD_CHARS, KEYWORD_FILES, METHODS
from sievework.plans.common import INJECTED_SQL, injected, table
from sievework.plans.filtering import POLICY, redacted_sql, scanned_sql
from sievework.plans.retrieval import BM25_CTE, INDEX_CTE, bm25_ranking, built, keyword_ranking, queries_of, walk_sql

CITATIONS, TOKENS = 8, 6_000


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of folders of four; where one's symbol stands, for six of seven on known lines."""
    k = F.col("doc_id")
    name = F.concat(F.lit("src/p"), F.floor(k / 4), F.lit("/d"), k, F.when(k % 5 == 0, ".md").otherwise(".go"))
    line = lambda n: F.when(k % 7 != 0, k % 3 + n).cast("int")
    return table(spark, sf_dir, "documents").select(k.alias("id"), name.alias("file"), line(1).alias("start_line"), line(5).alias("end_line"), F.concat(F.lit("s"), k).alias("node"), "text")


_FILES = """f AS (SELECT doc_id AS id, 'src/p' || (doc_id // 4) || '/d' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.md' ELSE '.go' END AS file, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 + 1 END AS s, CASE WHEN doc_id % 7 <> 0 THEN doc_id % 3 + 5 END AS e, 's' || doc_id AS node, text FROM documents)"""


def _edges(spark: SparkSession, sf_dir: str, prefix: str = "s") -> DataFrame:
    """Each document leads to those of a third and of a fifth of its number, so that nodes have several ways to each other."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    name = lambda c: F.concat(F.lit(prefix), c) if prefix else c.cast("long")
    to = lambda n, kind: d.where(F.col("doc_id") > 0).select(name(F.col("doc_id")).alias("src"), name(F.floor(F.col("doc_id") / n)).alias("dst"), F.lit(kind).alias("kind"))
    return to(3, "third").unionByName(to(5, "fifth"))


_EDGES = """e AS (SELECT 's' || doc_id AS src, 's' || (doc_id // 3) AS dst, 'third' AS kind FROM documents WHERE doc_id > 0 UNION ALL SELECT 's' || doc_id, 's' || (doc_id // 5), 'fifth' FROM documents WHERE doc_id > 0)"""
_BOTH_WAYS = "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e"


def _vector_ranking(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """A question's vector, and a document's, is the one of its number."""
    v = table(spark, sf_dir, "embeddings")
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("vec_id")).join(v, "vec_id").select("vec_id", "embedding")
    return ranking.vector_top_k(q, v, k).select("query_id", F.col("vec_id").alias("id"), "rank")


def _vector_cte(k: int) -> str:
    return f"""v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), vs AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(q.e, v.e) AS score FROM v q JOIN benchmark ON item_id = q.vec_id, v WHERE q.vec_id <> v.vec_id),
vh AS (SELECT query_id, id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM vs) WHERE rank <= {k})"""


def _hits(ranked: DataFrame, files: DataFrame) -> DataFrame:
    """Hits at their places; one in eleven has no symbol."""
    symbol = F.when(F.col("id") % 11 != 0, F.concat(F.lit("pkg."), "node", F.lit("()"))).otherwise("")
    return ranked.join(files.drop("text"), "id").select("query_id", "rank", symbol.alias("symbol"), "file", "start_line", "end_line")


def _definitions(files: DataFrame) -> DataFrame:
    """Every symbol at its place, those of even numbers on lines 5 and 6 too."""
    own = files.select(F.col("node").alias("symbol"), "file", "start_line", "end_line")
    return own.unionByName(files.where("id % 2 = 0").select(F.col("node").alias("symbol"), "file", F.lit(5).alias("start_line"), F.lit(6).alias("end_line")))


def _context(spark: SparkSession, sf_dir: str, ranked: DataFrame, method: str) -> DataFrame:
    files = _files(spark, sf_dir)
    places = compositions.ordered_places(_hits(ranked, files), _definitions(files), _edges(spark, sf_dir), files, method)
    found = compositions.packed_context(places, compositions.bodies(places, files), METHODS[method]["chars"])
    return found.select("query_id", "blocks", F.col("used").cast("long").alias("used"), F.md5(F.encode("context", "UTF-8")).alias("context_md5"))


def _context_sql(ctes: str, ranked: str, method: str) -> str:
    m = METHODS[method]
    per_seed = 2 if m["definitions"] else 1
    calls = f"WHERE call <= {m['calls']}" if m["calls"] else ""
    hits = "" if m["hits"] is None else f"WHERE rank <= {m['hits']}"
    definitions = "UNION ALL SELECT query_id, (seed - 1) * 2 + 2, 0, '', file, s, e FROM seed JOIN (SELECT node, file, s, e FROM f UNION ALL SELECT node, file, 5, 6 FROM f WHERE id % 2 = 0) USING (node)" if m["definitions"] else ""
    fits = "" if m["chars"] is None else f"WHERE used <= {m['chars']}"
    order = "call, depth, name, file, s NULLS FIRST, e NULLS FIRST"
    return f"""WITH RECURSIVE {ctes}, {_FILES}, {_EDGES},
h AS (SELECT query_id, rank, CASE WHEN id % 11 <> 0 THEN node ELSE '' END AS node, file, s, e FROM {ranked} JOIN f USING (id)),
seed AS (SELECT * FROM (SELECT query_id, node, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS seed FROM h WHERE rank <= {m['leading']} AND node <> '') WHERE seed <= {m['seeds']}),
{walk_sql(_BOTH_WAYS, m['depth'], 'SELECT DISTINCT node FROM seed')},
around AS (SELECT seed AS root, node, depth FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY depth, node) AS n FROM near WHERE depth > 0) WHERE n <= {m['nodes']} UNION ALL SELECT node, node, 0 FROM seeds),
every AS (SELECT query_id, 1 AS call, rank AS depth, '' AS name, file, s, e FROM h {hits} {definitions}
 UNION ALL SELECT query_id, (seed - 1) * {per_seed} + {1 + per_seed}, depth, f.node, file, s, e FROM seed JOIN around ON root = seed.node JOIN f ON f.node = around.node),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, file, s, e ORDER BY {order}) AS n FROM every {calls}) WHERE n = 1),
body AS (SELECT o.*, '// ===== ' || o.file || ':' || coalesce(o.s::VARCHAR, 'None') || '-' || coalesce(o.e::VARCHAR, 'None') || ' =====' || chr(10) AS head, string_split(text, chr(10)) AS l FROM once o JOIN f ON f.file = o.file),
block AS (SELECT *, head || b AS block FROM (SELECT *, array_to_string(CASE WHEN s IS NOT NULL AND s <= len(l) THEN l[s:e] ELSE l[1:80] END, chr(10)) AS b FROM body) WHERE b <> ''),
kept AS (SELECT *, sum(length(block)) OVER (PARTITION BY query_id ORDER BY {order} ROWS UNBOUNDED PRECEDING) AS used FROM block)
SELECT query_id, count(*) AS blocks, max(used)::BIGINT AS used, md5(string_agg(block, chr(10) || chr(10) ORDER BY {order})) AS context_md5 FROM kept {fits} GROUP BY query_id"""


def broad_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, _vector_ranking(spark, sf_dir, 5), "broad")


BROAD = _context_sql(_vector_cte(5), "vh", "broad")


def targeted_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, _vector_ranking(spark, sf_dir, 5), "targeted")


TARGETED = _context_sql(_vector_cte(5), "vh", "targeted")


def text_seeded_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As targeted_context, but by BM25 over the stored index."""
    return _context(spark, sf_dir, bm25_ranking(queries_of(spark, sf_dir), built(spark, sf_dir)), "targeted")


TEXT_SEEDED = _context_sql(f"{INDEX_CTE}, {BM25_CTE}", "bm", "targeted")


def stepwise_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _context(spark, sf_dir, _vector_ranking(spark, sf_dir, 5), "stepwise")


STEPWISE = _context_sql(_vector_cte(5), "vh", "stepwise")


def full_graph_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Around every document's symbol."""
    return compositions.full_graph(_files(spark, sf_dir).select("node"), _edges(spark, sf_dir))


FULL_GRAPH_DUMP = f"""WITH RECURSIVE {_FILES}, {_EDGES}, {walk_sql(_BOTH_WAYS, FULL_GRAPH['depth'], 'SELECT DISTINCT node FROM f')},
inner_e AS (SELECT x.seed, src, dst, kind FROM e JOIN near x ON x.node = src JOIN near y ON y.node = dst AND y.seed = x.seed),
n AS (SELECT seed AS root, count(*) AS nodes, sum(length(node) + 3) AS c FROM near GROUP BY 1), ed AS (SELECT seed AS root, count(*) AS edges, sum(length(src) + length(dst) + length(kind) + 12) AS c FROM inner_e GROUP BY 1)
SELECT root, nodes, coalesce(edges, 0) AS edges, (n.c + coalesce(ed.c, 0))::BIGINT AS chars, n.c + coalesce(ed.c, 0) > {FULL_GRAPH['chars']} AS failed FROM n LEFT JOIN ed USING (root)"""


def anchor_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's own files, each with a file beside it: two documents and one that isn't there."""
    files = _files(spark, sf_dir)
    names = files.select("id", "file")
    own = lambda k, pos: table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(pos).alias("pos"), (F.col("item_id") * 3 + k).alias("id")).join(names, "id").select("query_id", "pos", "file")
    gone = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(2).alias("pos"), F.concat(F.lit("gone/x"), "item_id", F.lit(".go")).alias("file"))
    chosen = compositions.anchor_files(own(0, 0).unionByName(own(1, 1)).unionByName(gone), files)
    found = compositions.file_context(chosen, files)
    return found.select("query_id", "files", F.md5(F.encode("context", "UTF-8")).alias("context_md5"))


ANCHORS = f"""WITH {_FILES}, own AS (SELECT item_id AS query_id, 0 AS pos, file FROM benchmark JOIN f ON id = item_id * 3 UNION ALL SELECT item_id, 1, file FROM benchmark JOIN f ON id = item_id * 3 + 1 UNION ALL SELECT item_id, 2, 'gone/x' || item_id || '.go' FROM benchmark),
a AS (SELECT query_id, file, min(pos) AS pos FROM own GROUP BY query_id, file),
beside AS (SELECT a.query_id, a.pos, (SELECT min(g.file) FROM f g WHERE g.file LIKE '%.go' AND g.file <> a.file AND regexp_extract(g.file, '^(.*/)?[^/]*$', 1) = regexp_extract(a.file, '^(.*/)?[^/]*$', 1)) AS file FROM a),
new AS (SELECT query_id, file, min(pos) AS pos FROM beside b WHERE file IS NOT NULL AND NOT EXISTS (SELECT 1 FROM a WHERE a.query_id = b.query_id AND a.file = b.file) GROUP BY query_id, file),
every AS (SELECT query_id, 0 AS k, pos, file FROM a UNION ALL SELECT query_id, 1, pos, file FROM new),
p AS (SELECT query_id, k, pos, CASE WHEN text IS NULL THEN '// --- FILE: ' || file || ' (NOT FOUND ON DISK) ---' || chr(10) ELSE '// --- FILE: ' || file || ' ---' || chr(10) || text || chr(10) END AS part FROM every LEFT JOIN f USING (file))
SELECT query_id, count(*) AS files, md5(string_agg(part, chr(10) ORDER BY k, pos)) AS context_md5 FROM p GROUP BY query_id"""


def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best files of a keyword search, within the budget."""
    files = _files(spark, sf_dir)
    top = keyword_ranking(spark, sf_dir, KEYWORD_FILES)
    chosen = top.select("query_id", F.col("rank").alias("pos"), "id").join(files.select("id", "file"), "id")
    found = compositions.file_context(chosen, files, KEYWORD_CHARS)
    return found.select("query_id", "files", F.length("context").cast("long").alias("n_chars"), F.md5(F.encode("context", "UTF-8")).alias("context_md5"))


_ROOM = f"{KEYWORD_CHARS} - before - length(head) - {len(CUT_MARK)} - 1"
KEYWORDS = f"""WITH {INDEX_CTE}, {_FILES}, s AS (SELECT query_id, id, 10 * count(*) + max(contains(lower(string_split(trim(d.text, ' '), ' ')[1]), term)::INT) AS score, any_value(length(d.text)) AS size FROM q JOIN ix USING (term) JOIN documents d ON d.doc_id = id GROUP BY query_id, id),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, size, id) AS pos FROM s) WHERE pos <= {KEYWORD_FILES}),
b AS (SELECT query_id, pos, text, '// --- FILE: ' || file || ' ---' || chr(10) AS head FROM t JOIN f USING (id)),
r AS (SELECT *, coalesce(sum(length(head) + length(text) + 1) OVER (PARTITION BY query_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM b),
p AS (SELECT query_id, pos, CASE WHEN length(head) + length(text) <= {KEYWORD_CHARS} - before THEN head || text || chr(10) WHEN {_ROOM} > 0 THEN head || substring(text, 1, {_ROOM}) || chr(10) || '// [truncated]' || chr(10) ELSE head || '// [truncated]' || chr(10) END AS part FROM r WHERE before < {KEYWORD_CHARS}),
c AS (SELECT query_id, count(*) AS files, string_agg(part, chr(10) ORDER BY pos) AS context FROM p GROUP BY query_id)
SELECT query_id, files, length(context) AS n_chars, md5(context) AS context_md5 FROM c"""


def task_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by vectors, BM25 and the graph, within a budget of tokens, filtered."""
    docs = injected(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "text")
    rankings = [_vector_ranking(spark, sf_dir, 5), bm25_ranking(queries_of(spark, sf_dir), built(spark, sf_dir)).select("query_id", "id", "rank")]
    pack = compositions.evidence_pack(rankings, _edges(spark, sf_dir, ""), docs, CITATIONS, TOKENS, POLICY)
    return pack.select("query_id", F.col("pos").cast("long").alias("pos"), "id", "sources", F.col("size").cast("long").alias("size"), "scan_result", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


TASK_PACK = f"""WITH {INDEX_CTE}, {BM25_CTE}, {_vector_cte(5)}, ge AS (SELECT doc_id AS a, doc_id // 3 AS b FROM documents WHERE doc_id > 0 UNION SELECT doc_id, doc_id // 5 FROM documents WHERE doc_id > 0),
hop AS (SELECT a, b FROM ge UNION SELECT b, a FROM ge), sd AS (SELECT query_id, id, min(rank) AS rank FROM (SELECT query_id, id, rank FROM vh UNION ALL SELECT query_id, id, rank FROM bm) WHERE rank <= 3 GROUP BY query_id, id),
gr AS (SELECT query_id, id, rank FROM (SELECT query_id, hop.b AS id, row_number() OVER (PARTITION BY query_id ORDER BY min(rank), hop.b) AS rank FROM sd JOIN hop ON hop.a = sd.id WHERE hop.b <> sd.id GROUP BY query_id, hop.b) WHERE rank <= 60),
al AS (SELECT query_id, id, rank FROM vh UNION ALL SELECT query_id, id, rank FROM bm UNION ALL SELECT query_id, id, rank FROM gr),
sc AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 9) AS score, count(*) AS sources FROM al GROUP BY query_id, id), tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM sc) WHERE pos <= {CITATIONS}),
{INJECTED_SQL}, sz AS (SELECT query_id, pos, id, sources, length(text) // 4 AS size, sum(length(text) // 4) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS used FROM tp JOIN doc_inj ON doc_id = id),
{scanned_sql('doc_inj', 'doc_id, source')}, done AS (SELECT doc_id, scan_result, CASE WHEN blocks > 0 THEN '' ELSE {redacted_sql('text')} END AS t FROM filtered)
SELECT query_id, pos, id, sources, size, scan_result, md5(t) AS text_md5 FROM sz JOIN done ON doc_id = id WHERE used <= {TOKENS}"""

_SQL = {
    broad_context: BROAD, targeted_context: TARGETED, text_seeded_context: TEXT_SEEDED, stepwise_context: STEPWISE, full_graph_dump: FULL_GRAPH_DUMP, anchor_context: ANCHORS, keyword_context: KEYWORDS, task_pack: TASK_PACK,
}
QUERIES = {f.__name__: f for f in _SQL}
ORACLE = {f.__name__: s for f, s in _SQL.items()}
