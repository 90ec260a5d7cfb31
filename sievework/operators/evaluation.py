"""Cells of an experiment: collected, scored, scored anew, and what retrieval surfaced for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import drop_dot_slash, info_volume, is_test_file
from sievework.operators.parsing import parse_responses
from sievework.operators.scoring import correct, location_scores, reference_verdicts
from sievework.session import checkpointed

STORED_ANSWER = 500  # code points of an answer that are stored


def unsupported_counts(verdicts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, citations, unsupported, and whether any verdict is partial."""
    return verdicts.groupBy(*keys).agg(F.count(F.lit(1)).alias("citations"), F.count_if("is_unsupported").alias("unsupported"), F.bool_or("is_partial").alias("is_partial"))


def scored_cells(cells: DataFrame, questions: DataFrame, expected: DataFrame, files: DataFrame, symbols: DataFrame | None = None, words: DataFrame | None = None) -> DataFrame:
    """One row per cell (cell_id, question_id, response, injected_tokens): parse mode, stored answer, location scores,
    correctness, unsupported citations, whether any was checked in part, and information volume. questions: question_id, keywords;
    expected: question_id, path, start_line, end_line; files: path; symbols: name, from an index, None where there is none; words: name, from
    the texts. Cells may say by index_up that the index couldn't be asked for them. A cell whose question is unknown is scored
    against no expectations."""
    parsed = checkpointed(parse_responses(cells, "response").drop("response"))  # joined four times below, by what Python workers and patterns make of a text
    asked = ["index_up"] if "index_up" in cells.columns else []
    cited = parsed.select("cell_id", *asked, F.posexplode("citations").alias("pos", "c")).select("cell_id", "pos", *asked, F.col("c.file").alias("path"), "c.start_line", "c.end_line", "c.symbol")
    wanted = cells.select("cell_id", "question_id").join(expected, "question_id").select("cell_id", "path", "start_line", "end_line")
    scores = location_scores(cells, cited, wanted, ["cell_id"])
    said = words if words is not None else files.sparkSession.createDataFrame([], "name string")
    bad = unsupported_counts(reference_verdicts(cited, files, symbols, said), ["cell_id"]).drop("citations")
    j = parsed.join(questions.select("question_id", "keywords"), "question_id", "left").join(scores, "cell_id").join(bad, "cell_id", "left")
    right = correct(F.col("answer"), F.col("recall"), F.coalesce("keywords", F.expr("cast(array() as array<string>)")), F.col("parse_mode") != "failed")
    return j.select(
        "cell_id", "question_id", "parse_mode", F.substring("answer", 1, STORED_ANSWER).alias("answer"), "precision", "recall", "f1", right.alias("correctness"), F.size("citations").cast("long").alias("citations"),
        F.coalesce("unsupported", F.lit(0)).alias("unsupported"), F.coalesce("is_partial", F.lit(False)).alias("is_partial"), info_volume(F.col("injected_tokens")).alias("info_volume"),
    )


def rescored(cells: DataFrame, questions: DataFrame, counts: DataFrame | None = None, metrics: tuple[str, ...] = ("correctness",)) -> DataFrame:
    """Stored cells (answer, recall, parse_mode, correctness, unsupported) with the chosen metrics worked out anew, and whether any changed.

    correctness: an unknown question has no keywords. unsupported: counts (cell_id, unsupported) as checked now, 0 for a cell without
    citations; of two that can't be told apart none has changed.
    """
    out, changed = cells, F.lit(False)
    if "correctness" in metrics:
        none = F.expr("cast(array() as array<string>)")
        new = correct(F.coalesce("answer", F.lit("")), F.coalesce("recall", F.lit(0.0)), F.coalesce("keywords", none), F.col("parse_mode") != "failed")
        out = out.join(questions.select("question_id", "keywords"), "question_id", "left").withColumn("_correct", new).drop("keywords")
        changed = changed | ~F.col("_correct").eqNullSafe(F.col("correctness"))
    if "unsupported" in metrics:
        out = out.join(counts.select("cell_id", F.col("unsupported").alias("_bad")), "cell_id", "left").withColumn("_bad", F.coalesce("_bad", F.lit(0)))
        changed = changed | ~F.col("_bad").eqNullSafe(F.col("unsupported"))
    out = out.withColumn("changed", changed)
    for name, new in (("correctness", "_correct"), ("unsupported", "_bad")):
        out = out.withColumn(name, F.col(new)).drop(new) if new in out.columns else out
    return out


def collected(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Results by cell name: those listed, with task, mode and status of the list over what was found; all found where nothing is listed.

    listed: name, task, mode, status, null or empty where the list doesn't say; found: the same and more columns.
    """
    if listed.isEmpty():
        return found
    of = {c: F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in ("task", "mode", "status")}
    j = listed.select("name", *of.values()).join(found, "name", "left")
    return j.select("name", *(F.coalesce(f"_{c}", c).alias(c) for c in of), *(c for c in found.columns if c not in ("name", *of)))


def surfaced_scores(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows (id, surfaced, expected: arrays of paths) scored on different paths: hit, focus, recall, and how many there are,
    are unknown files, and are tests."""
    clean = lambda c: F.array_distinct(F.transform(c, drop_dot_slash))
    r = rows.select("id", clean("surfaced").alias("s"), clean("expected").alias("e"))
    on = F.size(F.array_intersect("s", "e"))
    known = files.select(F.col("path")).distinct()
    missing = r.select("id", F.explode("s").alias("path")).join(known, "path", "left_anti").groupBy("id").agg(F.count(F.lit(1)).alias("error_count"))
    tests = F.size(F.filter("s", is_test_file))
    return r.join(missing, "id", "left").select(
        "id", (on > 0).alias("location_hit"), F.round(F.when(F.size("s") > 0, on / F.size("s")).otherwise(0.0), 3).alias("answer_focus"), F.when(on > 0, 1.0).otherwise(0.0).alias("recall"),
        F.size("s").alias("n_surfaced"), F.coalesce("error_count", F.lit(0)).alias("error_count"), tests.alias("test_file_count"), (tests > 0).cast("int").alias("test_pollution"),
    )


def macro_scores(scores: DataFrame, by: list[str]) -> DataFrame:
    """Means of precision, recall and f1, and how many have any recall."""
    return scores.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.count_if(F.col("recall") > 0).alias("hits"))


def assembled(blocks: DataFrame, key: str, header: Column, body: Column, order: list[Column], missing: str = "(file not found)") -> DataFrame:
    """key, context: headers and bodies of a key's blocks in order, a marker for a body that is null."""
    part = F.concat(header, F.lit("\n"), F.coalesce(body, F.lit(missing)))
    rows = blocks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, part.alias("part")))).alias("p"))  # what a budget lets into one context
    return rows.select(key, F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("context"))
