"""From raw documents to packed training sequences: five stages, each a table.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs. Stages but the
last return rows with the columns of docs. Rows are told apart by a number of their own,
so null and repeated ids make no difference. Numbers depend on how files are packed into
partitions, hence on the executors there are, so numbered rows are stored once a stage and
all its jobs read that table. Extra columns pass through; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import remove, stored, written
from sievework.llm.exact_dedup import exact_dedup
from sievework.llm.mixing import mix_sources
from sievework.llm.ngram_join import ngram_jaccard_join
from sievework.llm.packing import pack_power_of_two
from sievework.llm.quality import score_quality, train_quality


def _free(name: str, docs: DataFrame) -> str:
    """name, made longer until docs has no such column."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a number of each row, as a stored table; and the number's name."""
    name = _free("_row", docs)
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), "pipeline-rows")[0], name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject (score >= 0.3); it learns from `labels`."""
    trees = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # own names: those of docs may clash with the scores'
    plain = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    scored = score_quality(plain, trees, id_col=names["doc_id"], text_col=names["text"], keep=tuple(names.values()))
    return scored.where("predicted = 1").select(*(F.col(n).alias(c) for c, n in names.items()))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space."""
    rows, row = _numbered(docs)
    kept = exact_dedup(rows, tag_col=row).where("kept").select(F.col("tag").alias(row))
    return rows.join(kept, row, "left_semi").select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of texts that share 0.8 of their five-word shingles."""
    rows, row = _numbered(docs)
    found = ngram_jaccard_join(rows.select(row, "text"), size=5, num=80, den=100, id_col=row)
    return rows.join(found.where(F.col(row) == F.col("component_id")).select(row), row, "left_semi").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    rows, row = _numbered(docs)
    often = _free("_copies", rows)
    copies = mix_sources(rows, tag_col=row).where("copies > 0").select(F.col("tag").alias(row), F.sequence(F.lit(1), "copies").alias(often))
    return rows.join(copies, row).withColumn(often, F.explode(often)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences whose lengths are powers of two, one piece each; a document taken twice is packed twice."""
    pieces = pack_power_of_two(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mix", mix), ("pack", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next. Once a stage's table is there, those that it was
    made of go: the last stage's input is all that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    others = written()
    for name, stage in STAGES[:-1]:
        docs, path = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        for done in written() - others - {path}:
            remove(spark, done)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Trees, knapsacks and token ids are beyond SQL: tests hold run() against a plain version.
ORACLE_SQL = None
