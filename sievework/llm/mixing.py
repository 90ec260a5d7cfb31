"""Mixing sources to target weights by fitting subset sums.

A source's target is whole epochs plus a rest. The rest is fitted on the histogram of
its documents' lengths alone: a proportional number of documents of each length, then
longer ones until a bounded budget is left, to which bounded-knapsack dynamic
programming finds the nearest sum, below or above; where that misses, over more or all documents. Which documents of a length are
taken is decided by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievework.llm.common import arrow_schema, partitions, small_batches, stored, take_over, text_bytes, word_spans

#: The dynamic programme's largest gap, in words.
KNAPSACK = 1 << 16


def with_sizes(docs: DataFrame, id_col: str, source_col: str, text_col: str, tag_col: str | None) -> DataFrame:
    """id, source, tag and the number of words [^\\x20\\x09-\\x0D]+ of the whole text (null: 0)."""
    ddl = "id long, source string, size long, tag long"
    schema = arrow_schema(ddl)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(__name__)
        for big in batches:
            for batch in small_batches(big, "text"):
                yield pa.record_batch([batch.column("id"), batch.column("source"), pa.array(np.diff(word_spans(*text_bytes(batch.column("text")))[2]).astype(np.int64)), batch.column("tag")], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), (F.col(tag_col) if tag_col else F.lit(None)).cast("long").alias("tag")).mapInArrow(count, ddl)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """source, source_size, target of each source: share of all sizes by weight, none above most times its size.

    Sources stand in order of code points, null last, and weigh weights[0], weights[1], ..., repeating. Excess
    over a cap goes to the others by weight: with caps / weight ascending, the level is the first at which what
    is left, over the weights left, doesn't pass the next cap / weight.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = total.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (place + 1).cast("int"))).withColumn("cap", F.col("source_size") * float(most))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy(F.lit(0))
    below = F.coalesce(F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(rising.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(whole) * float(share) - below) / left
    fits = weighed.withColumn("level", level)
    best = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(whole)
    return fits.withColumn("best", best).select("source", "source_size", F.coalesce(F.least("cap", F.col("best") * F.col("weight")), F.col("cap")).alias("target"))


def fit(sizes: np.ndarray, counts: np.ndarray, rest: int) -> np.ndarray:
    """How many documents of each size to take so that their sizes sum to rest, or as near to it as can be found.

    A proportional number of each size is taken, and the nearest sum of the others added. Where that misses rest, more
    are kept for the sums: all documents where rest, or what is left out, is KNAPSACK words at most, so that the result is
    the nearest of all sums; else the proportional part ends half of KNAPSACK before rest. Of two sums as near, the smaller is taken.
    """
    total = int((sizes * counts).sum())
    if rest <= 0 or total <= 0:
        return np.zeros(len(sizes), np.int64)
    if rest >= total:
        return counts.copy()
    some = np.where(sizes > 0, counts, 0)
    sum_of = lambda taken: int((sizes * taken).sum())
    found = [proportional(sizes, some, rest, rest)]
    if sum_of(found[0]) != rest:
        if rest <= KNAPSACK:
            found.append(nearest_sum(sizes, some, rest))
        elif total - rest <= KNAPSACK:
            found.append(some - nearest_sum(sizes, some, total - rest, larger=True))
        else:
            found.append(proportional(sizes, some, rest, rest - KNAPSACK // 2))
    return min(found, key=lambda taken: (abs(sum_of(taken) - rest), sum_of(taken)))


def proportional(sizes: np.ndarray, counts: np.ndarray, rest: int, first: int) -> np.ndarray:
    """Shares of each size for the sum first, then longer ones until KNAPSACK is left at most, then the nearest sum of the others.

    If every document left is longer than a gap over KNAPSACK, the nearest is none or one of the shortest.
    """
    total = int((sizes * counts).sum())
    taken = counts * first // total if total < 2**31 else np.array([int(c) * first // total for c in counts.tolist()], np.int64)
    left = rest - int((sizes * taken).sum())
    spare = counts - taken
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        if left <= KNAPSACK or not s:
            break
        k = min(int(spare[i]), left // s, -(-(left - KNAPSACK) // s))
        taken[i] += k
        spare[i] -= k
        left -= k * s
    if left > KNAPSACK:
        shortest = int(np.flatnonzero(spare > 0)[np.argmin(sizes[spare > 0])])  # rest < total: some are left
        taken[shortest] += int(sizes[shortest]) - left < left
        return taken
    return taken + nearest_sum(sizes, spare, left)


def nearest_sum(sizes: np.ndarray, counts: np.ndarray, goal: int, larger: bool = False) -> np.ndarray:
    """Numbers of documents of each size, up to counts, whose sum is nearest to goal; of two as near the smaller, or the larger.

    Bounded-knapsack dynamic programming over all sums up to twice the goal: no sum beyond is nearer than none.
    """
    taken = np.zeros(len(sizes), np.int64)
    most = 2 * goal
    by = np.full(most + 1, -1, np.int32)  # the item that first reached a sum
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    items: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s, k = int(sizes[i]), int(counts[i])
        if not k or not s or s > most:
            continue
        if reach[goal]:
            break
        k, step = min(k, most // s), 1
        while k > 0:  # 1, 2, 4, ... copies: any number up to k is a sum of these
            n = min(step, k)
            k, step, w = k - n, 2 * step, n * s
            new = np.flatnonzero(reach[: most + 1 - w] & ~reach[w:]) + w
            by[new] = len(items)
            reach[new] = True
            items.append((i, n))
    sums = np.flatnonzero(reach)
    off = np.abs(sums - goal)
    at = int(sums[np.flatnonzero(off == off.min())[-1 if larger else 0]])
    while at:
        i, n = items[by[at]]
        taken[i] += n
        at -= n * int(sizes[i])
    return taken


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    tag_col: str | None = None,
) -> DataFrame:
    """One row per document: id, source, size, source_size, target, taken (words, repeats counted), copies, tag.

    A document's size is its number of words; null and empty texts have none and are never taken in the rest. A
    null source is a source of its own, last in order; a null id is an id like any other. Rows that agree in id,
    source and size are interchangeable. tag_col, a long, comes back as tag, so that rows can be told apart. The same rows and seed give the same mix. Other columns are ignored; an
    empty table gives an empty one. most must be a whole number: no document is taken more often.
    """
    spark = docs.sparkSession
    sized, _ = stored(with_sizes(docs, id_col, source_col, text_col, tag_col), "mix-sizes")
    histogram = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    goal = targets(sized, weights, share, most)
    same = lambda a, b, *cols: [a[c].eqNullSafe(b[c]) for c in cols]

    def fit_source(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("size")
        size, target = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
        epochs = min(int(most), int(target / size + 1e-12)) if size else 0
        rest = round(target - epochs * size) if epochs < most else 0
        rows["epochs"] = epochs
        rows["extra"] = fit(rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64), int(rest))
        return rows[["source", "size", "n", "source_size", "target", "epochs", "extra"]]

    counted = histogram.join(goal, same(histogram, goal, "source")).select(histogram["source"], "size", "n", "source_size", "target")
    fitted = counted.groupBy("source").applyInPandas(fit_source, "source string, size long, n long, source_size long, target double, epochs int, extra long")
    plan, _ = stored(fitted, "mix-plan")
    # documents of one source and size in about as many buckets of the hash as a bucket has documents
    chance = F.xxhash64(F.lit(seed), F.col("id"))
    # no broadcast: the plan has a row for each source and size, which grow with the documents
    joined = sized.join(plan.hint("merge"), same(sized, plan, "source", "size")).select(sized["id"], sized["source"], sized["size"], sized["tag"], "n", "source_size", "target", "epochs", "extra").withColumn("chance", chance)
    buckets = F.when(F.col("n") > 64, F.ceil(F.sqrt("n"))).otherwise(1).cast("long")
    spread = joined.withColumn("bucket", F.pmod(F.shiftrightunsigned("chance", 11), buckets)).repartition(partitions(spark), "source", "size", "bucket")
    in_bucket = Window.partitionBy("source", "size", "bucket").orderBy("chance", F.col("id").asc_nulls_last(), "tag")
    ranked = spread.withColumn("rank", F.row_number().over(in_bucket))
    before = Window.partitionBy("source", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = spread.groupBy("source", "size", "bucket").agg(F.count(F.lit(1)).alias("here"))
    counts = per_bucket.select("source", "size", "bucket", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("before"))
    copies = F.col("epochs") + F.when(F.col("rank") + F.col("before") <= F.col("extra"), 1).otherwise(0)
    return (
        ranked.join(counts.hint("merge"), same(ranked, counts, "source", "size", "bucket"))
        .select(ranked["id"].alias(id_col), ranked["source"].alias(source_col), ranked["size"], "source_size", "target", copies.cast("int").alias("copies"), "tag")
        .withColumn("taken", F.col("size") * F.col("copies"))
    )
