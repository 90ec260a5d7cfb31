"""Citations against expected ranges: precision, recall, correctness, unsupported references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import bare_symbol, checkable_symbol, normal_path, ranges_overlap


def location_scores(questions: DataFrame, predicted: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_pred, n_exp, precision, recall, f1 of each question.

    predicted and expected: keys, path, start_line, end_line. A prediction hits with an expected range of the same
    normal path that it overlaps; any null bound overlaps. Duplicates count each. Without expectations precision is
    1 with no prediction and 0 otherwise, recall 1, f1 the precision. The join is an equi-join on keys and path.
    """
    p = predicted.select(*keys, normal_path(F.col("path")).alias("path"), F.col("start_line").alias("ps"), F.col("end_line").alias("pe"), F.monotonically_increasing_id().alias("_p"))
    e = expected.select(*keys, normal_path(F.col("path")).alias("path"), F.col("start_line").alias("es"), F.col("end_line").alias("ee"), F.monotonically_increasing_id().alias("_e"))
    hit = [p[k] == e[k] for k in [*keys, "path"]] + [ranges_overlap(p["ps"], p["pe"], e["es"], e["ee"])]
    counted = lambda df, other, n, hits: df.join(other, hit, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias(hits)).join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)), keys, "right")
    both = questions.select(*keys).join(counted(p, e, "n_pred", "hit_pred"), keys, "left").join(counted(e, p, "n_exp", "hit_exp"), keys, "left").na.fill(0, ["n_pred", "hit_pred", "n_exp", "hit_exp"])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    none = F.col("n_exp") == 0
    precision = F.when(none, F.when(F.col("n_pred") == 0, 1.0).otherwise(0.0)).otherwise(share("hit_pred", "n_pred"))
    recall = F.when(none, 1.0).otherwise(share("hit_exp", "n_exp"))
    scored = both.withColumn("precision", precision).withColumn("recall", recall)
    total = F.col("precision") + F.col("recall")
    f1 = F.when(none, F.col("precision")).when(total > 0, 2 * F.col("precision") * F.col("recall") / total).otherwise(0.0)
    return scored.select(*keys, "n_pred", "n_exp", "precision", "recall", f1.alias("f1"))


def correct(answer: Column, recall: Column, keywords: Column, parsed: Column) -> Column:
    """A parsed, nonblank answer with recall of a half and any keyword in any case, if there are keywords."""
    said = F.exists(keywords, lambda k: F.contains(F.lower(answer), F.lower(k)))
    return F.coalesce(parsed & (F.trim(answer) != "") & (recall >= 0.5) & ((F.size(keywords) == 0) | said), F.lit(False))


def reference_verdicts(citations: DataFrame, files: DataFrame, symbols: DataFrame | None, words: DataFrame) -> DataFrame:
    """citations (id, path, symbol) with reason, is_unsupported and is_partial.

    files: path; symbols: name, from an index of definitions; words: name, whole words of the texts. A citation of an
    unknown file is unsupported, and so is one whose checkable symbol neither the index nor the text knows; line ranges
    don't matter, nor whether the symbol stands in the cited file. Where the index can't be asked (symbols is None, or citations
    have a column index_up that isn't true) the text alone decides, and the verdict is partial.
    """
    up = F.lit(False) if symbols is None else F.coalesce(F.col("index_up"), F.lit(False)) if "index_up" in citations.columns else F.lit(True)
    named = F.when(checkable_symbol(F.col("symbol")), bare_symbol(F.col("symbol")))
    c = citations.withColumn("path", normal_path(F.col("path"))).withColumn("_name", named).withColumn("_up", up)
    nameless = c.where(F.col("_name").isNull()).withColumn("_text", F.lit(None).cast("boolean")).withColumn("_index", F.lit(None).cast("boolean"))  # a join would send them all to one task
    c = c.where(F.col("_name").isNotNull())
    known = lambda df, name: df.select(F.col("name").alias("_name")).distinct().withColumn(name, F.lit(True))
    file = files.select(normal_path(F.col("path")).alias("path")).distinct().withColumn("_file", F.lit(True))
    j = c.join(known(words, "_text"), "_name", "left")
    j = j.withColumn("_index", F.lit(False)) if symbols is None else j.join(known(symbols, "_index"), "_name", "left")
    j = j.unionByName(nameless).join(file, "path", "left")
    reason = (
        F.when(F.col("_file").isNull(), "file_missing").when(F.coalesce("symbol", F.lit("")) == "", "file_only").when(F.col("_name").isNull(), "symbol_not_checkable")
        .when(F.col("_up") & F.col("_index"), "symbol_indexed").when(F.col("_text"), "symbol_in_text").otherwise("symbol_missing")
    )
    partial = F.col("_file").isNotNull() & F.col("_name").isNotNull() & ~F.col("_up")
    return j.select(*citations.columns, reason.alias("reason"), reason.isin("file_missing", "symbol_missing").alias("is_unsupported"), partial.alias("is_partial"))


def majority(yes: Column, no: Column) -> Column:
    """True on a tie; null without votes."""
    return F.when(yes + no > 0, yes >= no)
