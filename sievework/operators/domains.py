"""Which parts of a code base a change touches, and how hard that makes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a summary that make a change complex, and those that raise it by a level (fixed values).
HARD_WORDS, CONCURRENT_WORDS = ("genesis", "hardfork", "system contract"), ("goroutine", "race", "mutex", "concurrent")
LEVELS = ("simple", "moderate", "complex")


def classified(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths (id, path, any more) with module: of the first rule (pos, part, module) whose part the path contains; null without one.

    Rules are a stated list and travel as one row.
    """
    one = rules.agg(F.sort_array(F.collect_list(F.struct("pos", "part", "module"))).alias("_rules"))
    first = F.get(F.filter("_rules", lambda r: F.contains("path", r["part"])), F.lit(0))["module"]
    return paths.join(F.broadcast(one), F.lit(True)).select(*paths.columns, first.alias("module"))


def domains_of(modules: DataFrame) -> DataFrame:
    """id, primary_domain, domains, confidence: different modules (id, path, module) of an id's different paths, the most frequent first,
    then by name. Confidence is high if all paths with a module agree, medium if half of them do, else low; low without any."""
    n = modules.where("module is not null").select("id", "path", "module").distinct().groupBy("id", "module").agg(F.count(F.lit(1)).alias("n"))
    by = n.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("_less"), "module"))).alias("m"), F.sum("n").alias("total"))  # modules are those of the rules
    found = modules.select("id").distinct().join(by, "id", "left")
    top = -F.get("m", F.lit(0))["_less"]
    confidence = F.when(F.size("m") == 1, "high").when(top * 2 >= F.col("total"), "medium").otherwise("low")
    names = F.coalesce(F.transform("m", lambda x: x["module"]), F.expr("cast(array() as array<string>)"))
    return found.select("id", F.get(names, F.lit(0)).alias("primary_domain"), names.alias("domains"), confidence.alias("confidence"))


def complexity(domains: Column, summary: Column, sensitive: tuple[str, ...]) -> Column:
    """complex for three domains, a sensitive one or a hard word; moderate for two; else simple. Words of concurrency raise it by a level."""
    text = F.lower(F.coalesce(summary, F.lit("")))
    says = lambda words: F.rlike(text, F.lit("|".join(words)))
    level = F.when((F.size(domains) >= 3) | F.arrays_overlap(domains, F.array(*map(F.lit, sensitive))) | says(HARD_WORDS), 2).when(F.size(domains) == 2, 1).otherwise(0)
    raised = F.least(F.lit(2), level + F.when(says(CONCURRENT_WORDS), 1).otherwise(0))
    return F.get(F.array(*map(F.lit, LEVELS)), raised)
