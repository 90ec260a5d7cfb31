"""The pipeline: every stage's decisions against plain versions, on its own input."""

import random
import sys
import zlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
from sievework.llm import common
from sievework.llm.quality import score_quality, train_quality
from tests.llm.helpers import DDL, ROWS, components, documents, words
from tests.llm.test_classifiers import quality_rows
from tests.llm.test_tokens import library


def corpus():
    rows, labels = quality_rows(300)
    rng = random.Random(8)
    rows = [(i, t, "en", rng.choice("ab")) for i, t, _, _ in rows]
    rows += [(1000 + i, rows[4 * i + 1][1].replace(" ", "  "), "en", "a") for i in range(20)]  # exact copies
    rows += [(2000 + i, rows[4 * i + 2][1] + " more", "en", None) for i in range(20)]  # near copies
    return rows + ROWS, labels


def write(spark, path):
    rows, labels = corpus()
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows


def packed(t):
    return "".join((t or "").split(" ")).translate({9: None, 10: None, 11: None, 12: None, 13: None})


def pieces_of(doc, text):
    """Pieces of a document, as the library gives its ids: as many of 2048 as fit, then smaller powers of two."""
    ids, start = library("word_bpe_49k.json")(text, 1), 0
    n = len(ids)
    for size in [2048] * (n // 2048) + [1 << b for b in range(10, -1, -1) if n % 2048 >> b & 1]:
        yield doc, start, size, zlib.crc32(np.array(ids[start : start + size], "<u4").tobytes()), n
        start += size


def test_stages(spark, tmp_path):
    sf = str(tmp_path)
    rows = write(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    trees = train_quality(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    for n, (name, stage) in enumerate(cp.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, sf).write.parquet(f"{sf}/{n}")
        out = spark.read.parquet(f"{sf}/{n}")
        after = [tuple(r) for r in out.collect()]
        if name != "pack":
            assert out.columns == columns and set(after) <= set(before)
        if name == "quality":
            good = [r.predicted for r in score_quality(docs, trees).collect()]
            assert len(before) == len(rows) and len(after) == sum(good)
        elif name == "exact_dedup":
            assert len(after) == len({packed(t) for _, t, _, _ in before}) == len({packed(t) for _, t, _, _ in after})
            longest = {}
            for r in before:
                longest[packed(r[1])] = max(longest.get(packed(r[1]), 0), len(r[1] or ""))
            assert all(len(r[1] or "") == longest[packed(r[1])] for r in after)
        elif name == "near_dedup":
            groups = {c for _, _, c in components([(i, r[1]) for i, r in enumerate(before)], 5, 80, 100)}
            assert len(after) == len(groups)
        elif name == "mix":
            size = sum(len(words(r[1])) for r in before)
            assert abs(sum(len(words(r[1])) for r in after) - 1.5 * size) < 10
            assert max(after.count(r) for r in after) <= 2 * max(before.count(r) for r in before)
        else:
            assert len({r[columns_of(out, "sequence_id")] for r in after}) == len(after)
            assert Counter(r[:5] for r in map(tuple, out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect())) == Counter(p for r in before for p in pieces_of(r[0], r[1]))
        docs = out
    pieces = [c for c in docs.columns if c != "sequence_id"]  # which tells the files' places too
    others = common.written()
    again = cp.run(spark, sf)
    assert len(common.written() - others) == 1  # what the last stage reads
    assert sorted(map(str, docs.select(*pieces).collect())) == sorted(map(str, again.select(*pieces).collect()))
    assert again.select("sequence_id").distinct().count() == len(after)


def columns_of(df, name):
    return df.columns.index(name)


def test_extra_columns_and_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    write(spark, sf)
    extra = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("*", "1 as score", "'x' as predicted", "2 as _row", "3 as copies", "4 as _copies", "5 as tag")
    extra.write.parquet(f"{sf}/extra")
    extra = spark.read.parquet(f"{sf}/extra")
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, extra, sf)
        assert out.columns == extra.columns and out.count() > 0, name
    spark.createDataFrame([], DDL).write.parquet(f"{sf}/none")
    none = spark.read.parquet(f"{sf}/none")
    for name, stage in cp.STAGES:
        assert stage(spark, none, sf).count() == 0, name


class Crowd:
    """A session whose parallelism, and so the packing of files, grows from job to job, as if executors came."""

    def __init__(self, spark, monkeypatch):
        self.n = 1
        import sievework.llm.common as common

        def changing(df, name, codec="zstd"):
            out = plain(df, name, codec)
            self.n = 1 + 3 * self.n % 7
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", str(self.n))
            return out

        plain = common.stored
        for module in (cp, sys.modules["sievework.llm.exact_dedup"], sys.modules["sievework.llm.ngram_join"], sys.modules["sievework.llm.mixing"]):
            monkeypatch.setattr(module, "stored", changing)


def test_rows_stay_themselves_when_executors_change(spark, tmp_path, monkeypatch):
    rows = [(i // 2, f"text number {i // 2} of this corpus" + " a b c d e f g h" * (i // 2 % 5), "en", "ab"[i % 2]) for i in range(320)]
    docs = documents(spark, rows).repartition(16)
    docs.write.parquet(f"{tmp_path}/d")
    want = {name: sorted(map(tuple, stage(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path)).collect())) for name, stage in cp.STAGES[1:4]}
    assert len(want["exact_dedup"]) == 160
    before = spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        Crowd(spark, monkeypatch)
        for name, stage in cp.STAGES[1:4]:
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
            out = stage(spark, spark.read.parquet(f"{tmp_path}/d"), str(tmp_path))
            spark.conf.set("spark.sql.leafNodeDefaultParallelism", "8")
            got = sorted(map(tuple, out.collect()))
            if name == "mix":  # which of two equal rows is doubled is open
                assert sorted(r[1] for r in got) == sorted(r[1] for r in want[name])
            else:
                assert {r[1] for r in got} == {r[1] for r in want[name]} and len(got) == len(want[name])
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)


def test_clean_documents_stay(spark, tmp_path):
    sf = str(tmp_path)
    write(spark, sf)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in cp.quality(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).collect()}
    clean = [i for i, q in labels.items() if q == 1 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
