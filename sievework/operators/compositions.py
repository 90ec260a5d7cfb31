"""Retrieval methods as chains of ranking, lookup, graph and budget operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.detectors import Policy
from sievework.functions.text import bare_symbol, estimated_tokens, line_range
from sievework.operators.graph import reachable, subgraph
from sievework.operators.ranking import reciprocal_rank_fusion, together, top_k, within_budget
from sievework.operators.spans import scan_and_filter

#: What each method takes (fixed values): hits of a query, of which the first `leading` may give seeds, at most `seeds` of them; whether
#: seeds' definitions come before their graph; hops and nodes of a seed; calls in all; characters of the context.
METHODS = {
    "broad": {"hits": 3, "leading": 3, "seeds": 3, "definitions": False, "depth": 2, "nodes": 1500, "calls": None, "chars": 70_000},
    "targeted": {"hits": 5, "leading": 3, "seeds": 3, "definitions": True, "depth": 1, "nodes": 200, "calls": None, "chars": 40_000},
    "stepwise": {"hits": None, "leading": 3, "seeds": 2, "definitions": True, "depth": 1, "nodes": 200, "calls": 8, "chars": None},
}
#: The dump around roots (fixed values): one that is larger fails.
FULL_GRAPH = {"depth": 2, "nodes": 2000, "chars": 300_000}
#: Files of a keyword search and characters of their context, and what marks a cut (fixed values).
KEYWORD_FILES, KEYWORD_CHARS, CUT_MARK = 3, 60_000, "// [truncated]\n"


def find_symbol(symbols: DataFrame, names: DataFrame, language: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """Definition sites (of symbols: name, kind, language, file, start_line, end_line) of each wanted name."""
    s = symbols if language is None else symbols.where(F.col("language") == language)
    return (s.where(F.col("kind").isin(*kinds)) if kinds else s).join(names.select("name").distinct(), "name")


def change_history(wanted: DataFrame, changes: DataFrame, order: list[Column], most: int) -> DataFrame:
    """symbol, ref, rank: of each wanted symbol the first `most` changes (symbol, ref, ...) in order."""
    return top_k(changes.join(wanted.select("symbol").distinct(), "symbol"), ["symbol"], order, most)


def health(backends: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row, or one for each group of backends (name, up): down without an index, degraded without an embedder or with any backend that fails, else ok; what is missing."""
    up = lambda name: F.coalesce(F.bool_or((F.col("name") == name) & F.col("up")), F.lit(False))
    lost = F.array_sort(F.collect_set(F.when(~F.col("up"), F.col("name"))))  # names of backends: they are few
    return backends.groupBy(*by).agg(F.when(~up("index"), "down").when(~up("embedder") | ~F.bool_and("up"), "degraded").otherwise("ok").alias("status"), lost.alias("missing"))


def ordered_places(hits: DataFrame, definitions: DataFrame, edges: DataFrame, places: DataFrame, method: str, direction: str = "both") -> DataFrame:
    """query_id, pos, call, file, start_line, end_line: the places that a method's chain of searches gives, each the first time it comes.

    hits (query_id, rank, symbol, file, start_line, end_line), by whatever search, all come first. Then each seed in order of
    rank gives its definitions (symbol, file, start_line, end_line), where the method asks for them, and the nodes within reach,
    itself included, at their places (node, file, start_line, end_line). Seeds are the leading hits with a symbol, whose last
    identifier counts. call numbers the searches; those beyond the method's number of calls aren't made.
    """
    m = METHODS[method]
    here = hits if m["hits"] is None else hits.where(F.col("rank") <= m["hits"])
    named = hits.where((F.col("rank") <= m["leading"]) & (F.trim(F.coalesce("symbol", F.lit(""))) != "")).withColumn("symbol", bare_symbol(F.col("symbol")))
    seeds = top_k(named.select("query_id", "symbol", F.col("rank").alias("at")), ["query_id"], [F.col("at")], m["seeds"]).withColumnRenamed("rank", "seed")
    per_seed = 2 if m["definitions"] else 1
    call = lambda k: (F.col("seed") - 1) * per_seed + k
    place = ["file", "start_line", "end_line"]
    parts = [here.select("query_id", F.lit(1).cast("long").alias("call"), F.col("rank").cast("long").alias("depth"), F.lit("").alias("name"), *place)]
    if m["definitions"]:
        parts.append(seeds.join(definitions.select("symbol", *place), "symbol").select("query_id", call(2).alias("call"), F.lit(0).cast("long").alias("depth"), F.lit("").alias("name"), *place))
    names = seeds.select(F.col("symbol").alias("node")).distinct()
    near = reachable(names, edges, m["depth"], direction=direction, cap=m["nodes"]).select(F.col("seed").alias("symbol"), "node", "depth")
    around = near.unionByName(names.select(F.col("node").alias("symbol"), "node", F.lit(0).alias("depth")))
    parts.append(seeds.join(around, "symbol").join(places.select("node", *place), "node").select("query_id", call(1 + per_seed).alias("call"), F.col("depth").cast("long").alias("depth"), F.col("node").alias("name"), *place))
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    if m["calls"] is not None:
        every = every.where(F.col("call") <= m["calls"])
    order = [F.col("call"), F.col("depth"), F.col("name"), *(F.col(c) for c in place)]
    first = every.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", *place).orderBy(*order))).where("_n = 1")
    return first.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).alias("pos"), "call", *place)


def bodies(places: DataFrame, texts: DataFrame) -> DataFrame:
    """file, start_line, end_line, block: a heading and the lines of each different place; the first 80 where the start isn't a
    line of the text (file, text). A place in no text, or with an empty body, gives nothing."""
    place = ["file", "start_line", "end_line"]
    j = places.select(*place).distinct().join(texts.select("file", "text"), "file")
    inside = F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & F.col("start_line").between(1, F.size(F.split("text", "\n")))
    body = line_range(F.col("text"), F.when(inside, F.col("start_line")), F.col("end_line"))
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    heading = F.concat(F.lit("// ===== "), F.col("file"), F.lit(":"), shown("start_line"), F.lit("-"), shown("end_line"), F.lit(" =====\n"))
    return j.withColumn("_body", body).where("_body <> ''").select(*place, F.concat(heading, "_body").alias("block"))


def packed_context(places: DataFrame, blocks: DataFrame, chars: int | None) -> DataFrame:
    """query_id, blocks, used, context: blocks of places (query_id, pos, file, start_line, end_line) in order, up to the first that
    doesn't fit into the budget; used is the length of blocks alone. A query without a block that fits has no row."""
    same = [places[c].eqNullSafe(blocks[c]) for c in ("file", "start_line", "end_line")]
    rows = places.join(blocks, same).select("query_id", "pos", "block", F.length("block").alias("size"))
    kept = within_budget(rows, ["query_id"], [F.col("pos")], F.col("size"), chars) if chars is not None else rows.withColumn("used", F.col("size"))
    total = F.sum("size").alias("used")
    parts = F.array_sort(F.collect_list(F.struct("pos", "block")))  # what a budget lets into one context
    packed = kept.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), total, parts.alias("p"))
    return packed.select("query_id", "blocks", "used", F.array_join(F.transform("p", lambda x: x["block"]), "\n\n").alias("context"))


def full_graph(roots: DataFrame, edges: DataFrame, direction: str = "both") -> DataFrame:
    """root, nodes, edges, chars, failed: what a dump of the nodes and edges around each root (node) takes, as text; failed where it
    doesn't fit. Nothing is cut: a larger dump is an error."""
    g = FULL_GRAPH
    near = reachable(roots, edges, g["depth"], direction=direction, cap=g["nodes"]).select(F.col("seed").alias("root"), "node")
    every = near.unionByName(roots.select(F.col("node").alias("root"), "node").distinct())
    inner = subgraph(roots, edges, g["depth"], cap=g["nodes"]).withColumnRenamed("seed", "root")
    n = every.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.length("node") + 3).alias("_n"))  # quotes and a comma
    e = inner.groupBy("root").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.length("src") + F.length("dst") + F.length("kind") + 12).alias("_e"))
    chars = F.col("_n") + F.coalesce("_e", F.lit(0))
    return n.join(e, "root", "left").select("root", "nodes", F.coalesce("edges", F.lit(0)).alias("edges"), chars.alias("chars"), (chars > g["chars"]).alias("failed"))


def anchor_files(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """query_id, pos, file, found: the different files of a query's anchors (query_id, pos, file) in order, then for each the first
    other file of its folder by name (files: file, of any kind; siblings end in .go or .sol), unless it is there already."""
    own = anchors.where(F.coalesce("file", F.lit("")) != "").groupBy("query_id", "file").agg(F.min("pos").alias("pos"))
    folder = lambda c: F.regexp_extract(c, "^(.*/)?[^/]*$", 1)
    source = files.where(F.rlike("file", F.lit("[.](go|sol)$"))).select(folder(F.col("file")).alias("dir"), F.col("file").alias("other")).distinct()
    two = source.groupBy("dir").agg(F.min("other").alias("first")).join(source, "dir").where("other > first").groupBy("dir", "first").agg(F.min("other").alias("second"))
    firsts = source.groupBy("dir").agg(F.min("other").alias("first")).join(two, ["dir", "first"], "left")
    beside = own.withColumn("dir", folder(F.col("file"))).join(firsts, "dir").select("query_id", F.col("pos"), F.when(F.col("first") == F.col("file"), F.col("second")).otherwise(F.col("first")).alias("file"))
    new = beside.where("file is not null").join(own.select("query_id", "file"), ["query_id", "file"], "left_anti").groupBy("query_id", "file").agg(F.min("pos").alias("pos"))
    every = own.withColumn("_k", F.lit(0)).unionByName(new.withColumn("_k", F.lit(1)))
    numbered = every.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy("_k", "pos")))
    known = files.select("file").distinct().withColumn("found", F.lit(True))
    return numbered.join(known, "file", "left").select("query_id", "pos", "file", F.coalesce("found", F.lit(False)).alias("found"))


def file_context(chosen: DataFrame, texts: DataFrame, chars: int | None = None) -> DataFrame:
    """query_id, files, context: whole texts of the chosen files (query_id, pos, file) in order under a heading, a note for those that
    aren't there. With chars, the file that passes the budget is cut with a mark and ends the context."""
    j = chosen.join(texts.select("file", "text"), "file", "left")
    head = F.when(F.col("text").isNull(), F.concat(F.lit("// --- FILE: "), "file", F.lit(" (NOT FOUND ON DISK) ---\n"))).otherwise(F.concat(F.lit("// --- FILE: "), "file", F.lit(" ---\n")))
    if chars is None:
        part = F.concat(head, F.when(F.col("text").isNull(), "").otherwise(F.concat("text", F.lit("\n"))))
        rows = j.select("query_id", "pos", part.alias("part"))
    else:
        size = F.coalesce(F.length(head) + F.length("text") + 1, F.lit(0))  # a note costs nothing
        before = F.coalesce(F.sum(size).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        left = F.lit(chars) - F.col("before")
        fits = F.col("text").isNull() | (F.length(head) + F.length("text") <= left)
        room = (left - F.length(head) - len(CUT_MARK) - 1).cast("int")
        cut = F.when(room > 0, F.concat(head, F.substring("text", F.lit(1), room), F.lit("\n" + CUT_MARK))).otherwise(F.concat(head, F.lit(CUT_MARK)))
        whole = F.concat(head, F.when(F.col("text").isNull(), "").otherwise(F.concat("text", F.lit("\n"))))
        rows = j.withColumn("before", before).where(F.col("before") < chars).select("query_id", "pos", F.when(fits, whole).otherwise(cut).alias("part"))
    packed = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_list(F.struct("pos", "part"))).alias("p"))  # a query's few files
    return packed.select("query_id", "files", F.array_join(F.transform("p", lambda x: x["part"]), "\n").alias("context"))


def evidence_pack(rankings: list[DataFrame], edges: DataFrame, texts: DataFrame, citations: int, tokens: int, policy: Policy | None = None, fused: int = 60, graph_seeds: int = 3) -> DataFrame:
    """query_id, pos, id, sources, size, scan_result, text, redacted_count: the evidence for each query, filtered by the policy.

    rankings (query_id, id, rank), such as by vectors and by BM25, and the neighbours in the graph (src, dst, kind of ids) of the
    first of each, ranked by the best rank beside them and id, are fused by reciprocal ranks; at most `citations` ids are taken in that order while
    their texts (id, text) fit into `tokens`, at four characters each, up to the first that doesn't. sources says how many rankings have the id. Only what is packed is
    filtered: a blocked text is empty, another has its findings redacted.
    """
    seeds = together(rankings).where(F.col("rank") <= graph_seeds).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    names = seeds.select(F.col("id").alias("node")).distinct()
    near = reachable(names, edges, 1, direction="both").select(F.col("seed").alias("id"), F.col("node").alias("near"))
    around = seeds.join(near, "id").groupBy("query_id", "near").agg(F.min("rank").alias("by")).select("query_id", F.col("near").alias("id"), "by")
    graph = top_k(around, ["query_id"], [F.col("by"), F.col("id")], fused).select("query_id", "id", "rank")
    every = [*rankings, graph]
    scored = reciprocal_rank_fusion(every)
    counted = together(every).groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("sources"))
    best = top_k(scored.withColumn("score", F.round("score", 9)), ["query_id"], [F.col("score").desc(), F.col("id")], citations)
    sized = best.join(texts.select("id", F.coalesce("text", F.lit("")).alias("text")), "id").withColumn("size", estimated_tokens(F.col("text")))
    kept = within_budget(sized, ["query_id"], [F.col("rank")], F.col("size"), tokens)
    packed = kept.join(counted, ["query_id", "id"]).select("query_id", F.col("rank").alias("pos"), "id", "sources", "size", "text")
    return scan_and_filter(packed, "text", policy).select("query_id", "pos", "id", "sources", "size", "scan_result", F.col("filtered_text").alias("text"), "redacted_count")
