"""Token usage and what it costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import tokens_of_chars

BUCKETS = ("input", "output", "cache_write", "cache_read")


def usage_from_chars(log: DataFrame, keys: list[str], prompt: str, response: str, divisor: int = 4) -> DataFrame:
    """Tokens by keys: each record's characters over the divisor, rounded up before summing."""
    by = log.groupBy(*keys).agg(F.sum(tokens_of_chars(F.col(prompt), divisor)).alias("input"), F.sum(tokens_of_chars(F.col(response), divisor)).alias("output"))
    return by.withColumns({"cache_write": F.lit(0).cast("long"), "cache_read": F.lit(0).cast("long")})


def usage_from_sessions(log: DataFrame, keys: list[str]) -> DataFrame:
    """Tokens by keys of records with a usage struct; missing buckets are 0."""
    names = {"input": "input_tokens", "output": "output_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens"}
    return log.where("usage is not null").groupBy(*keys).agg(*(F.sum(F.coalesce(F.col(f"usage.{v}"), F.lit(0))).alias(k) for k, v in names.items()))


def models_of(log: DataFrame, agent: str, agents: DataFrame, tiers: DataFrame, fallback: str) -> DataFrame:
    """log with the model of each record's agent, by its tier; the fallback where either is unknown. Both tables are a few pins."""
    pins = agents.join(tiers, "tier").select(F.col("agent").alias("_a"), "model")
    return log.join(F.broadcast(pins), F.coalesce(F.col(agent), F.lit("unknown")) == F.col("_a"), "left").drop("_a").withColumn("model", F.coalesce("model", F.lit(fallback)))


def costs(usage: DataFrame, prices: DataFrame, source: str) -> DataFrame:
    """usage with amount (decimal, 6 places, halves up, of tokens times price a million) and status.

    A model without a price costs 0 and is 'unknown'; a source that starts with session is 'actual', others 'estimated'.
    """
    p = prices.select("model", *(F.col(b).cast("decimal(12,4)").alias(f"_{b}") for b in BUCKETS))
    total = sum((F.col(b).cast("decimal(18,0)") * F.col(f"_{b}") for b in BUCKETS[1:]), F.col(BUCKETS[0]).cast("decimal(18,0)") * F.col(f"_{BUCKETS[0]}"))
    known = F.col("_input").isNotNull()
    amount = F.when(known, F.round(total / F.lit(1_000_000).cast("decimal(8,0)"), 6)).otherwise(0).cast("decimal(18,6)")
    status = F.when(~known, "unknown").when(F.startswith(F.col(source), F.lit("session")), "actual").otherwise("estimated")
    return usage.join(p, "model", "left").select(*usage.columns, amount.alias("amount"), status.alias("status"))
