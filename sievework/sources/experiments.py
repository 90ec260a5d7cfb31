"""The files of an experiment: its state, and a folder for each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.runs import STAGES, collected_runs, run_usage
from sievework.sources.files import names
from sievework.sources.readers import texts_of

CELLS = "array<struct<workspace: string, task: string, mode: string, status: string>>"


def listed_cells(spark: SparkSession, folder: str) -> DataFrame:
    """pos, cell, task, mode, status of the cells that the experiment's state.json lists; none without it. A cell is named by the
    last part of its workspace, or by task and mode."""
    state = texts_of(spark, folder, "state.json")
    cells = state.select(F.posexplode(F.from_json(F.get_json_object("value", "$.cells"), CELLS)).alias("pos", "c"))
    name = F.coalesce(F.nullif(F.element_at(F.split("c.workspace", "/"), -1), F.lit("")), F.concat_ws("__", F.coalesce("c.task", F.lit("None")), F.coalesce("c.mode", F.lit("None"))))
    return cells.select("pos", name.alias("cell"), "c.task", "c.mode", "c.status")


def collect_experiment(spark: SparkSession, folder: str, prices: DataFrame, agents: DataFrame, tiers: DataFrame, fallback: str, sessions: DataFrame | None = None, stage_names: tuple[str, ...] = STAGES) -> DataFrame:
    """A row for each cell of an experiment; see `collected_runs`. sessions: cell, path of a session's JSON lines.

    Files that can't be read count as absent, and a folder without any is a cell all the same. All texts are read by Spark, a
    row for each file or line.
    """
    root = f"{folder}/cells"
    cell = F.regexp_extract("path", "/cells/([^/]+)/", 1).alias("cell")
    whole = lambda name, column: texts_of(spark, root, name).select(cell, F.col("value").alias(column))
    every = spark.createDataFrame([(n,) for n in names(spark, root)], "cell string")
    files = every.join(whole("run-meta.json", "meta"), "cell", "left").join(whole("state.json", "state"), "cell", "left")
    lines = texts_of(spark, root, "agent-transcript.jsonl").select(cell, F.explode(F.split("value", "\n")).alias("line"))
    if sessions is None:
        said = spark.createDataFrame([], "cell string, line string")
    else:
        paths = [r["path"] for r in sessions.select("path").distinct().collect()]  # what the caller listed
        texts = spark.read.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")) if paths else spark.createDataFrame([], "file string, line string")
        said = texts.join(sessions, F.endswith(F.url_decode("file"), F.col("path"))).select("cell", "line")
    return collected_runs(listed_cells(spark, folder), files, run_usage(lines, said, agents, tiers, prices, fallback), stage_names)
