"""Grouped rollups, matrices, deltas and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def method_rollup(cells: DataFrame, methods: DataFrame) -> DataFrame:
    """Per method: n, means of precision, recall, f1 (null: 0), share of correct, sum of unsupported, mean tokens.

    methods (method, and anything else) drives: one without cells keeps its row, with nulls. Only true is correct.
    """
    mean = lambda c: F.round(F.avg(F.coalesce(c, F.lit(0.0))), 4)
    by = cells.groupBy("method").agg(
        F.count(F.lit(1)).alias("n"), mean(F.col("precision")).alias("loc_p"), mean(F.col("recall")).alias("loc_r"), mean(F.col("f1")).alias("loc_f1"),
        F.round(F.count_if(F.col("correct")) / F.count(F.lit(1)), 4).alias("correct_rate"), F.sum(F.coalesce("unsupported", F.lit(0))).alias("unsupported"),
        F.round(F.avg(F.coalesce("tokens", F.lit(0))), 1).alias("avg_tokens"),
    )
    return methods.select("method").join(by, "method", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def cost_status(status: Column) -> Column:
    """actual, estimated, unknown or mixed, of a group's statuses: estimates taint, nothing is unknown."""
    actual, estimated, other = F.max(status == "actual"), F.max(status == "estimated"), F.max(~status.isin("actual", "estimated", "unknown"))
    unknown = F.max(status == "unknown")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(actual) & ~yes(estimated) & ~yes(unknown) & ~yes(other), "actual").when(yes(estimated), "estimated").when(~yes(actual) & ~yes(other), "unknown").otherwise("mixed")


def mode_rollup(cells: DataFrame) -> DataFrame:
    """Per mode: cells, evaluated, correct and its rate (null if none was evaluated), tokens, cost, latency of cells that have one,
    safety flags, bug cycles and side effects. cells: mode, correct, tokens, cost, latency, cost_status, flags, bug_cycles, side_effects."""
    n = F.count(F.lit(1))
    evaluated, right = F.count("correct"), F.count_if(F.col("correct"))
    return cells.groupBy("mode").agg(
        n.alias("cells"), evaluated.alias("evaluated"), right.alias("correct"), F.when(evaluated > 0, F.round(right / evaluated, 4)).alias("correct_rate"),
        F.sum("tokens").alias("total_tokens"), F.round(F.sum("tokens") / n, 1).alias("avg_tokens"), F.round(F.sum("cost") / n, 6).cast("double").alias("avg_cost"),
        F.round(F.avg("latency"), 2).alias("avg_latency"), F.sum("flags").alias("safety_flags"), F.sum("bug_cycles").alias("bug_cycles"), F.round(F.sum("bug_cycles") / n, 2).alias("avg_bug_cycles"),
        F.sum("side_effects").alias("side_effects"), cost_status(F.col("cost_status")).alias("cost_status"),
    )


def matrix(cells: DataFrame, row: str, column: str, columns: list[str], value: Column) -> DataFrame:
    """A row for each key and a column for each of the given values; null where there is no cell."""
    return cells.groupBy(row).pivot(column, columns).agg(value)


def delta(rollup: DataFrame, base: str, target: str) -> DataFrame:
    """Change of the correct rate, and percent of tokens saved, of target over base; no row if either has no rate."""
    b = rollup.where(F.col("method") == base).select(F.col("correct_rate").alias("b_rate"), F.col("avg_tokens").alias("b_tokens"))
    t = rollup.where(F.col("method") == target).select(F.col("correct_rate").alias("t_rate"), F.col("avg_tokens").alias("t_tokens"))
    both = b.join(F.broadcast(t), F.lit(True)).where("b_rate is not null and t_rate is not null")  # one row each
    saved = F.when(F.col("b_tokens") > 0, F.round(100 * (1 - F.col("t_tokens") / F.col("b_tokens")), 1)).otherwise(0.0)
    return both.select(F.lit(base).alias("baseline"), F.lit(target).alias("target"), F.round(F.col("t_rate") - F.col("b_rate"), 4).alias("delta_correct_rate"), saved.alias("token_reduction_pct"))


def retrieval_rollup(rows: DataFrame) -> DataFrame:
    """Per method: percent present, mean focus and tokens, polluted of n, percent sufficient and relevance of judged rows, efficiency."""
    pct = lambda c: F.round(100 * F.avg(c.cast("double")), 1)
    by = rows.groupBy("method").agg(
        pct(F.col("present")).alias("present"), F.round(F.avg("focus"), 3).alias("focus"), F.round(F.avg("tokens"), 1).alias("tokens"),
        F.concat_ws("/", F.count_if(F.col("polluted")).cast("string"), F.count(F.lit(1)).cast("string")).alias("polluted"),
        pct(F.col("sufficient")).alias("sufficient"), F.round(F.avg("relevance"), 3).alias("relevance"),
    )
    return by.withColumn("efficiency", F.when(F.col("tokens") > 0, F.round(F.col("sufficient") / (F.col("tokens") / 1000), 2)).otherwise(0.0))


def recurring(failures: DataFrame, key: Column, id_col: str, least: int = 2) -> DataFrame:
    """Keys of at least `least` failures: how many, the first and the last id."""
    return failures.groupBy(key.alias("pattern")).agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id"), F.max(id_col).alias("last_id")).where(F.col("n") >= least)


def recurring_ids(failures: DataFrame, key: Column, id_col: str, least: int = 2) -> DataFrame:
    """pattern, n and a row for each id of the patterns of at least `least` failures: lists of any length stay rows."""
    keyed = failures.select(key.alias("pattern"), id_col)
    often = keyed.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return keyed.join(often, "pattern")


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as the report has them: flags 0 or 1, nulls empty, lists joined by semicolons."""
    kinds = dict(df.dtypes)
    def text(c: str) -> Column:
        x = F.col(c)
        if kinds[c] == "boolean":
            x = x.cast("int")
        elif kinds[c].startswith("array"):
            x = F.array_join(x, ";")
        return F.coalesce(x.cast("string"), F.lit("")).alias(c)
    return df.select(*map(text, columns))


def markdown_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """One table line per row: nulls as a dash, doubles with four decimals."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.coalesce(F.format_string("%.4f", F.col(c)) if kinds[c] == "double" else F.col(c).cast("string"), F.lit("—"))
    filled = [F.when(F.col(c).isNull(), "—").otherwise(cell(c)) for c in columns]
    return df.select(*df.columns, F.concat(F.lit("| "), F.concat_ws(" | ", *filled), F.lit(" |")).alias("line"))


def report_table(df: DataFrame, order: DataFrame, key: str, columns: list[str], headings: list[str] | None = None) -> DataFrame:
    """pos, line: a Markdown table: headings, a rule, and a line for each key in the caller's order (key, pos), with dashes where df has none."""
    head = headings or columns
    lines = markdown_rows(order.select(key, F.col("pos").cast("long").alias("pos")).join(df.drop("pos"), key, "left"), columns).select("pos", "line")
    top = df.sparkSession.createDataFrame([(-2, "| " + " | ".join(head) + " |"), (-1, "|" + "---|" * len(head))], "pos long, line string")
    return top.unionByName(lines)


def report_rows(df: DataFrame, order: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """pos and the columns as a CSV report has them, a row for each key in the caller's order (key, pos); blanks where df has none."""
    joined = order.select(key, F.col("pos").cast("long").alias("pos")).join(df.drop("pos"), key, "left")
    return csv_columns(joined, columns).select(*columns) if "pos" in columns else csv_columns(joined, ["pos", *columns]).withColumn("pos", F.col("pos").cast("long"))


def report_sections(*sections: tuple[str, DataFrame]) -> DataFrame:
    """section, pos, line: titled tables of lines (pos, line) one after the other; a section without lines says so."""
    every = None
    for n, (title, lines) in enumerate(sections):
        body = lines.select(F.lit(n).alias("section"), "pos", "line")
        empty = lines.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(n).alias("section"), F.lit(0).cast("long").alias("pos"), F.lit("_not available_").alias("line"))
        head = lines.sparkSession.createDataFrame([(n, -9, f"## {title}")], "section int, pos long, line string")
        part = head.unionByName(body).unionByName(empty)
        every = part if every is None else every.unionByName(part)
    return every


def delta_lines(found: DataFrame) -> DataFrame:
    """pos, line: a table of what `delta` gives, with signs; no line if it gives nothing."""
    signed = lambda c, form: F.format_string(form, F.col(c).cast("double"))
    cells = F.array(
        F.lit("| metric | value |"), F.lit("|---|---|"), F.concat(F.lit("| baseline | "), "baseline", F.lit(" |")), F.concat(F.lit("| target | "), "target", F.lit(" |")),
        F.concat(F.lit("| delta_correct_rate | "), signed("delta_correct_rate", "%+.4f"), F.lit(" |")), F.concat(F.lit("| token_reduction_pct | "), signed("token_reduction_pct", "%+.1f"), F.lit(" |")),
    )
    return found.select(F.posexplode(cells).alias("pos", "line")).select(F.col("pos").cast("long").alias("pos"), "line")
