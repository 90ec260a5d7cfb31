"""Unified diffs as hunks, and the hunks that a search is about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.operators.ranking import bm25, top_k
from sievework.sources.text_index import PATTERN, postings_of


def hunks(diffs: DataFrame, id_col: str, diff_col: str) -> DataFrame:
    """id, file, pos, old_start, old_lines, new_start, new_lines, added, removed: the hunks of each diff in order.

    file is the new path without b/, or the old one of a file that goes. A count that isn't told is 1. added and removed are the texts
    of these lines. What comes before the first file, or has no hunk, gives nothing.
    """
    files = F.split(F.concat(F.lit("\n"), F.coalesce(diff_col, F.lit(""))), r"\n--- (?=[^\n]*\n\+\+\+ )")
    name = lambda part, at: F.regexp_replace(F.regexp_extract(part, at, 1), "^[ab]/", "")
    path = lambda part: F.coalesce(F.nullif(name(part, r"^[^\n]*\n\+\+\+ ([^\t\n]*)"), F.lit("/dev/null")), name(part, r"^([^\t\n]*)"))
    pieces = lambda part: F.split(F.regexp_replace(part, r"\n(?:diff --git |index )[^\n]*(?=\n|$)", ""), r"\n@@ (?=-\d)")
    of_file = lambda part: F.transform(F.slice(pieces(part), 2, F.size(pieces(part))), lambda h: F.struct(path(part).alias("file"), h.alias("h")))
    rows = diffs.select(F.col(id_col).alias("id"), F.posexplode(F.flatten(F.transform(F.slice(files, 2, F.size(files)), of_file))).alias("pos", "x")).select("id", "pos", "x.file", "x.h")
    number = lambda g: F.regexp_extract("h", r"^-(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", g)
    count = lambda g: F.coalesce(F.nullif(number(g), F.lit("")).cast("int"), F.lit(1))
    lines = F.split("h", "\n")

    def of(sign: str) -> Column:
        own = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: F.startswith(x, F.lit(sign)))
        return F.array_join(F.transform(own, lambda x: F.substring(x, F.lit(2), F.length(x))), "\n")

    good = rows.where(number(1) != "")
    return good.select("id", "file", "pos", number(1).cast("int").alias("old_start"), count(2).alias("old_lines"), number(3).cast("int").alias("new_start"), count(4).alias("new_lines"), of("+").alias("added"), of("-").alias("removed"))


def ranked_hunks(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """query_id, id, file, pos, score, rank of the k hunks whose added and removed lines are most about each query (query_id, term), by BM25."""
    keyed = found.withColumn("key", F.struct("id", "pos"))
    texts = keyed.select(F.col("key").alias("id"), F.concat_ws("\n", "added", "removed").alias("text"))
    # statistics of all hunks need no postings of them; only terms that are asked for are grouped
    length = texts.select(F.size(F.regexp_extract_all(F.lower("text"), F.lit(f"({PATTERN})"), F.lit(1))).alias("dl"))
    totals = length.agg(F.count_if(F.col("dl") > 0).alias("n_docs"), F.sum("dl").alias("n_terms"))
    scored = bm25(queries, postings_of(texts), totals=totals).withColumn("score", F.round("score", 6))
    best = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("id")], k).withColumnRenamed("id", "key")
    return best.join(keyed.select("key", "file"), "key").select("query_id", "key.id", "file", "key.pos", "score", "rank")
