"""Set-difference checks, upserts and lookups with a fixed precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, custom: DataFrame, key: str, pos: str, values: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Rows of custom replace those of base by key, in place; new ones follow in their order. pos is numbered anew from 0, within
    each group of `by`; without groups the list is one, and short."""
    b, c = base.alias("b"), custom.alias("c")
    both = b.join(c, [*by, key], "full")
    order = Window.partitionBy(*by).orderBy(F.col(f"b.{pos}").asc_nulls_last(), F.col(f"c.{pos}"))
    pick = [F.when(F.col(f"c.{pos}").isNotNull(), F.col(f"c.{v}")).otherwise(F.col(f"b.{v}")).alias(v) for v in values]
    return both.select(*by, key, *pick, (F.row_number().over(order) - 1).cast("long").alias(pos))


def override(base: DataFrame, other: DataFrame, key: str, values: tuple[str, ...]) -> DataFrame:
    """Upsert without an order; keys that start with _ are comments."""
    o = other.where(~F.startswith(F.col(key), F.lit("_"))).withColumn("_new", F.lit(True))
    both = base.alias("b").join(o.alias("o"), key, "full")
    return both.select(key, *(F.when(F.col("_new"), F.col(f"o.{v}")).otherwise(F.col(f"b.{v}")).alias(v) for v in values))


def missing(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def drift(expected: DataFrame, found: DataFrame, key: str, value: str) -> DataFrame:
    """(key, problem): missing in found, not expected, or another value."""
    e, f = expected.select(key, F.col(value).alias("_e")), found.select(key, F.col(value).alias("_f"))
    both = e.withColumn("_x", F.lit(1)).join(f.withColumn("_y", F.lit(1)), key, "full")
    problem = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "unexpected").when(~F.col("_e").eqNullSafe(F.col("_f")), "differs")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def priority_lookup(requests: DataFrame, options: DataFrame, request: str, fields: tuple[str, ...], pos: str) -> DataFrame:
    """Each request's option: the first field, in order, that equals it in any case, then the first option by pos; null without one.

    options are few: the join by each field is an equi-join on the folded value.
    """
    folded = [options.select(F.lower(F.col(f)).alias("_k"), F.lit(i).alias("_p"), *options.columns) for i, f in enumerate(fields)]
    index = folded[0]
    for more in folded[1:]:
        index = index.unionByName(more)
    best = index.groupBy("_k").agg(F.min_by(F.struct(*options.columns), F.struct("_p", pos)).alias("_o"))
    return requests.join(best, F.lower(F.col(request)) == F.col("_k"), "left").select(*requests.columns, *(F.col(f"_o.{c}").alias(c) for c in options.columns))


def latest(rows: DataFrame, keys: list[str], order: list[Column], columns: list[str]) -> DataFrame:
    """The greatest row of each key: an aggregate that combines before the shuffle, no window."""
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_r"))
    return best.select(*keys, *(F.col(f"_r.{c}").alias(c) for c in columns))


def prefer(first: DataFrame, second: DataFrame, keys: list[str], label: str, names: tuple[str, str]) -> DataFrame:
    """All rows of first, and of second those whose keys first doesn't have; label tells which."""
    return first.withColumn(label, F.lit(names[0])).unionByName(second.join(first.select(*keys).distinct(), keys, "left_anti").withColumn(label, F.lit(names[1])))


def resolved_setting(*sources: tuple[str, Column]) -> tuple[Column, Column]:
    """The first value that isn't null or empty, and the name of its source ('none' without one)."""
    filled = [(n, F.nullif(c, F.lit(""))) for n, c in sources]
    label = F.coalesce(*(F.when(c.isNotNull(), n) for n, c in filled), F.lit("none"))
    return F.coalesce(*(c for _, c in filled)), label
