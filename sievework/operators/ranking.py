"""Keyword, BM25 and vector ranking, rank fusion and budgets."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Queries and vectors that a task compares at a time, and queries of these that it works on at once.
QUERY_BLOCK, VECTOR_PART, TILE = 4_096, 16_384, 128
#: Documents that a task ranks at a time.
DOC_PART = 8_192


def top_k(rows: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """rank 1 to k within each group; limited before the shuffle by the planner."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def terms_of(df: DataFrame, id_col: str, text_col: str, pattern: str = "[a-z]{4,}") -> DataFrame:
    """id, term, tf, dl: lower-case terms of each text, how often, and how many terms the text has."""
    words = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({pattern})"), F.lit(1)).alias("w"))
    return words.select("id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"), F.first("dl").alias("dl"))


def keyword_scores(queries: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """query_id, id, score, size: ten times the distinct terms that query (query_id, term) and document share, and one more
    if such a term is part of the document's name (sizes: id, size, and where there are names, name); sizes break ties."""
    shared = queries.select("query_id", "term").distinct().join(index.select("id", "term"), "term")
    if "name" not in sizes.columns:
        hits = shared.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("hits"))
        return hits.join(sizes, "id").select("query_id", "id", (F.col("hits") * 10).alias("score"), "size")
    named = shared.join(sizes, "id").withColumn("in_name", F.contains(F.lower("name"), F.lower("term")))
    scored = named.groupBy("query_id", "id").agg(F.count(F.lit(1)).alias("hits"), F.max("in_name").alias("bonus"), F.first("size").alias("size"))
    return scored.select("query_id", "id", (F.col("hits") * 10 + F.coalesce(F.col("bonus"), F.lit(False)).cast("int")).alias("score"), "size")


def keyword_parts(queries: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """id, size, term, part, flag: what each term of the queries adds to a document's score in keyword_scores, for best_documents."""
    shared = index.select("id", "term").join(F.broadcast(queries.select("term").distinct()), "term", "left_semi").join(sizes, "id")
    flag = F.coalesce(F.contains(F.lower("name"), F.lower("term")), F.lit(False)) if "name" in sizes.columns else F.lit(False)
    return shared.select("id", "size", "term", F.lit(10).alias("part"), flag.alias("flag"))


def bm25_parts(wanted: DataFrame, index: DataFrame, frequencies: DataFrame | None = None, totals: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """id, term, part, flag (none) of the wanted terms: what each adds to a document's score in bm25."""
    if totals is None:
        totals = index.agg(F.round(F.sum(F.col("tf") / F.col("dl"))).cast("long").alias("n_docs"), F.sum("tf").alias("n_terms"))
    some = index.join(wanted, "term", "left_semi")
    df = some.groupBy("term").agg(F.count(F.lit(1)).alias("df")) if frequencies is None else frequencies.join(wanted, "term", "left_semi")
    weighed = some.join(df, "term").join(F.broadcast(totals), F.lit(True))  # one row of statistics
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") * F.col("n_docs") / F.col("n_terms")))
    return weighed.select(*(c for c in index.columns if c not in ("term", "tf", "dl", "lead", "segment")), "term", part.alias("part"), F.lit(False).alias("flag"))


def bm25(queries: DataFrame, index: DataFrame, frequencies: DataFrame | None = None, totals: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, id, score by Okapi BM25 over an index of (id, term, tf, dl); idf is log(1 + (N - df + 0.5) / (df + 0.5)).

    Only terms that some query has are weighed; statistics are those of all documents with terms: frequencies (term, df)
    and totals (one row: n_docs, n_terms) of a stored index, else sums over the index, in which a document's frequencies
    add up to its length.
    """
    parts = bm25_parts(queries.select("term").distinct(), index, frequencies, totals, k1, b)
    return parts.select("id", "term", "part").join(queries.select("query_id", "term").distinct(), "term").groupBy("query_id", "id").agg(F.sum("part").alias("score"))


def _best_documents(queries: pa.Table, rows: pa.Table, keys: list[str], by: list[str], k: int, digits: int | None) -> pa.Table:
    """The k best documents of each query among those of rows: keys of a document, term, part, flag and by, what breaks ties."""
    terms, queried = pc.unique(queries["term"]), queries["query_id"].combine_chunks().dictionary_encode()
    queried = queried.combine_chunks() if isinstance(queried, pa.ChunkedArray) else queried
    names, q = queried.dictionary, queried.indices.to_numpy()
    at = pc.index_in(queries["term"], value_set=terms).to_numpy()
    asking, asked = q[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(terms))
    begin, n = np.cumsum(asked) - asked, len(names)
    rows = rows.filter(pc.is_in(rows["term"], value_set=terms))
    t = pc.index_in(rows["term"], value_set=terms).to_numpy()
    order = np.lexsort((t, *(rows[c].to_numpy() for c in keys[::-1])))
    t, cols = t[order], {c: rows[c].to_numpy()[order] for c in dict.fromkeys((*keys, *by, "part", "flag"))}
    fresh = np.r_[True, np.logical_or.reduce([cols[c][1:] != cols[c][:-1] for c in keys])] if len(t) else np.zeros(0, dtype=bool)
    starts = np.r_[np.flatnonzero(fresh), len(t)]
    best, score = [np.zeros(0, dtype=np.int64)] * 2, np.zeros(0)
    for i in range(0, len(starts) - 1, TILE):
        lo, hi = starts[i], starts[min(i + TILE, len(starts) - 1)]
        doc = np.cumsum(fresh[lo:hi]) - 1
        many = asked[t[lo:hi]]
        row = np.repeat(np.arange(hi - lo), many)
        cell = asking[np.repeat(begin[t[lo:hi]] - (np.cumsum(many) - many), many) + np.arange(len(row))].astype(np.int64) * TILE + doc[row]
        total = np.bincount(cell, cols["part"][lo:hi][row], n * TILE) + (np.bincount(cell, cols["flag"][lo:hi][row], n * TILE) > 0)
        if digits is not None:
            total = np.floor(total * 10**digits + 0.5) / 10**digits
        total = np.where(np.bincount(cell, minlength=n * TILE) > 0, total, -np.inf).reshape(n, TILE)
        least = np.partition(total, max(TILE - k, 0), axis=1)[:, max(TILE - k, 0)]
        r, c = np.nonzero((total >= least[:, None]) & (total > -np.inf))
        best = [np.concatenate(x) for x in zip(best, (r, starts[i + c]), strict=True)]
        score = np.concatenate((score, total[r, c]))
        keep = _best(best[0], [-score, *(cols[c][best[1]] for c in (*by, *keys))], k)
        best, score = [x[keep] for x in best], score[keep]
    return pa.table({"query_id": names.take(pa.array(best[0])), **{c: cols[c][best[1]] for c in dict.fromkeys((*keys, *by))}, "score": score})


def best_documents(queries: DataFrame, parts: DataFrame, keys: list[str], by: list[str], k: int, n_docs: int, digits: int | None = None) -> DataFrame:
    """query_id, keys, by, score, rank of the k best documents of each query (query_id, term): a document's score is the sum of the parts of
    the terms they share, and one more if any of these is flagged; rounded to digits, halves up. Ties go by the columns by, then by keys, all numbers.

    parts: keys, by, term, part, flag. Documents are dealt in groups of about DOC_PART, queries in blocks of about QUERY_BLOCK / 4 that
    meet all groups: pairs of a query and a document stay within a task, and k of each query leave it.
    """
    asked = queries.select("query_id", "term").distinct()
    blocks = -(-queries.select("query_id").distinct().count() // (QUERY_BLOCK // 4)) or 1
    groups = -(-n_docs // DOC_PART) or 1
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    dealt = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("long")
    q = asked.withColumn("block", dealt(blocks, "query_id")).withColumn("group", each(groups))
    d = parts.select(*dict.fromkeys((*keys, *by, "term")), F.col("part").cast("double").alias("part"), F.col("flag").cast("double").alias("flag"), dealt(groups, *keys).alias("group"), (each(blocks) if blocks > 1 else F.lit(0).cast("long")).alias("block"))
    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema, *parts.schema)}
    ddl = ", ".join(f"{c} {kinds[c]}" for c in dict.fromkeys(("query_id", *keys, *by))) + ", score double"
    found = q.groupBy("block", "group").cogroup(d.groupBy("block", "group")).applyInArrow(lambda a, b: _best_documents(a, b, keys, by, k, digits), ddl)
    return top_k(found, ["query_id"], [F.col("score").desc(), *map(F.col, (*by, *keys))], k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _best(group: np.ndarray, keys: list[np.ndarray], k: int) -> np.ndarray:
    """Places of the first k of each group by keys, the most important first."""
    order = np.lexsort((*keys[::-1], group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, dtype=np.int64)
    place = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[place < k]


def _matrix(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of doubles as rows, padded, and their lengths; -1 for a list that is null or holds nulls."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    row = np.repeat(np.arange(len(size)), size)
    out = np.zeros((len(size), size.max(initial=0)))
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = pc.fill_null(flat, 0.0).to_numpy(zero_copy_only=False)
    length = np.where(lists.is_null().to_numpy(zero_copy_only=False), -1, size)
    length[row[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    return out, length


def _nearest(q: pa.Table, v: pa.Table, k: int) -> pa.Table:
    """The k best pairs of each query among these vectors. Products are added in the order of components, as a fold does it, so
    equal vectors have equal scores wherever they stand. Without a score (nulls, other lengths) a pair comes last, NaN first."""
    (a, la), (b, lb) = _matrix(q["q"]), _matrix(v["v"])
    qid, vid = q["query_id"].to_numpy(), v["vec_id"].to_numpy()
    n = min(a.shape[1], b.shape[1])
    found = []
    for i in range(0, len(a), TILE):
        best = [np.zeros(0, dtype=np.int64)] * 2 + [np.zeros(0)] * 2
        qs = slice(i, i + TILE)
        for j in range(0, len(b), 4 * TILE):
            vs = slice(j, j + 4 * TILE)
            score = np.zeros((len(a[qs]), len(b[vs])))
            part = np.empty_like(score)
            left, right = np.ascontiguousarray(a[qs].T), np.ascontiguousarray(b[vs].T)
            for d in range(n):
                np.multiply(left[d][:, None], right[d][None, :], out=part)
                score += part
            key = np.where(np.isnan(score), -np.inf, -score)
            key[(la[qs][:, None] != lb[vs][None, :]) | (la[qs] < 0)[:, None]] = np.inf
            own = qid[qs][:, None] == vid[vs][None, :]
            ranked = np.where(own, np.inf, key)
            near = ~own & (ranked <= np.partition(ranked, min(k, ranked.shape[1]) - 1, axis=1)[:, min(k, ranked.shape[1]) - 1][:, None])
            r, c = np.nonzero(near)
            best = [np.concatenate(x) for x in zip(best, (r, vid[vs][c], key[r, c], score[r, c]), strict=True)]
            keep = _best(best[0], [best[2], best[1]], k)
            best = [x[keep] for x in best]
        found.append((qid[qs][best[0]], best[1], np.ma.masked_array(best[3], best[2] == np.inf)))
    if not found:
        return pa.table({"query_id": q["query_id"], "vec_id": q["query_id"], "score": pa.array([], pa.float64())})
    score = np.ma.concatenate([x[2] for x in found])
    return pa.table({"query_id": np.concatenate([x[0] for x in found]), "vec_id": np.concatenate([x[1] for x in found]), "score": pa.array(score.data, mask=np.ma.getmaskarray(score), from_pandas=False)})


def vector_top_k(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score, rank of the k vectors nearest to each query by cosine, ties by id; a vector isn't its own neighbour.

    queries is a stated set that is compared with all vectors, in blocks of about QUERY_BLOCK with parts of about VECTOR_PART: a
    task holds one of each at a time, and gives the k best of each query on. Both sides carry unit vectors, so a pair costs
    one dot product. Ids are integers.
    """
    unit = lambda c: F.transform(c, lambda v: v.cast("double") / F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))
    n_blocks, n_parts = -(-queries.count() // QUERY_BLOCK) or 1, -(-vectors.count() // VECTOR_PART) or 1
    dealt = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>"))
    q = queries.select(F.col("vec_id").cast("long").alias("query_id"), unit(F.col("embedding")).alias("q"), dealt(n_blocks).alias("block")).withColumn("part", each(n_parts))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), unit(F.col("embedding")).alias("v"), dealt(n_parts).alias("part")).withColumn("block", each(n_blocks))
    pairs = q.groupBy("block", "part").cogroup(v.groupBy("block", "part")).applyInArrow(lambda a, b: _nearest(a, b, k), "query_id long, vec_id long, score double")
    return top_k(pairs, ["query_id"], [F.col("score").desc(), F.col("vec_id")], k)


def glob_pattern(glob: str) -> str:
    """The regular expression of a path glob: ** is anything, * and ? stay within a segment."""
    parts = re.split(r"(\*\*/?|\*|\?)", glob)
    meaning = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(meaning.get(p) or re.escape(p) for p in parts) + "$"


def semantic_search(queries: DataFrame, vectors: DataFrame, k: int, language: str | None = None, path_glob: str | None = None, kinds: tuple[str, ...] = ()) -> DataFrame:
    """vector_top_k among the vectors (vec_id, embedding, language, path, kind) of a language, of paths that a glob fits, and of some kinds.

    The filters come before the vectors are compared, so each query has k answers where that many fit.
    """
    v = vectors if language is None else vectors.where(F.col("language") == language)
    v = v if path_glob is None else v.where(F.rlike("path", F.lit(glob_pattern(path_glob))))
    return vector_top_k(queries, v.where(F.col("kind").isin(*kinds)) if kinds else v, k)


def together(rankings: list[DataFrame]) -> DataFrame:
    """query_id, id, rank: rows of all rankings, dealt by query and id.

    Rankings are dealt alike (by query), and Spark 4.1 then takes their union for dealt that way too and groups it without a shuffle. It isn't always:
    with rankings by vectors and by BM25 pairs came out once for each (right with spark.sql.unionOutputPartitioning off).
    """
    every = rankings[0].select("query_id", "id", "rank")
    for r in rankings[1:]:
        every = every.unionByName(r.select("query_id", "id", "rank"))
    return every.repartition("query_id", "id")


def reciprocal_rank_fusion(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """query_id, id, score: the sum of 1 / (k + rank) over rankings (query_id, id, rank)."""
    return together(rankings).groupBy("query_id", "id").agg(F.sum(1.0 / (F.lit(k) + F.col("rank"))).alias("score"))


def within_budget(blocks: DataFrame, by: list[str], order: list[Column], size: Column, cap: int, distinct: tuple[str, ...] = ()) -> DataFrame:
    """Blocks of each group in order, up to the first whose running size passes the cap; used is the running size.

    Of blocks of a group that agree in the columns of `distinct` the first counts.
    """
    if distinct:
        blocks = blocks.withColumn("_again", F.row_number().over(Window.partitionBy(*by, *distinct).orderBy(*order))).where("_again = 1").drop("_again")
    running = F.sum(size).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("used", running).where(F.col("used") <= cap)


def cut_to_budget(blocks: DataFrame, by: list[str], order: list[Column], text: str, cap: int, marker: str) -> DataFrame:
    """As within_budget, but the block that passes the cap stays, cut short and marked."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    size = F.length(F.col(text))
    before = F.sum(size).over(w) - size
    left = F.lit(cap) - F.col("before")
    cut = F.when(size <= left, F.col(text)).otherwise(F.concat(F.substring(F.col(text), F.lit(1), left.cast("int")), F.lit(marker)))
    return blocks.withColumn("before", before).where(F.col("before") < cap).withColumn(text, cut)


def search_fallback(queries: DataFrame, hits: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """For queries (query_id, term) without hits: the first k names (name, pos) that contain one of their terms, in any case.

    The join is by the first three characters of a term, or all of a shorter one, among all such pieces of a name.
    """
    open_ = queries.join(hits.select("query_id").distinct(), "query_id", "left_anti").where("term <> ''").withColumn("piece", F.lower(F.substring("term", 1, 3)))
    at = F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1)))
    grams = [F.expr(f"transform(_at, i -> substring(lower(name), i, {n}))") for n in (1, 2, 3)]
    names = names.withColumn("_at", at)
    pieces = names.select("name", "pos", F.explode(F.array_distinct(F.concat(*grams))).alias("piece"))
    found = open_.join(pieces, "piece").where(F.contains(F.lower("name"), F.lower("term"))).select("query_id", "name", "pos").distinct()
    return top_k(found, ["query_id"], [F.col("pos")], k)
