"""The stored index and tables that are published whole."""

import re
from collections import Counter

import pytest

from sievework.operators import ranking
from sievework.sources import text_index
from sievework.sources.files import names, publish, read_batches, replace_table, write_batch
from sievework.sources.text_index import build_index, compact_index, open_index, update_index

BEFORE = [(1, "alpha beta beta gamma"), (2, "beta delta"), (3, None), (4, "gamma gamma gamma"), (5, "omega alone here"), (6, "")]
AFTER = [(1, "alpha beta beta gamma"), (2, "delta delta moved"), (3, "gamma came"), (4, None), (7, "beta brandnew"), (6, "")]


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain(rows):
    """Postings, document frequencies, and numbers of documents with terms and of terms."""
    terms = {i: re.findall("[a-z]{4,}", (t or "").lower()) for i, t in rows}
    postings = {(i, w, n, len(ws)) for i, ws in terms.items() for w, n in Counter(ws).items()}
    return postings, Counter(w for ws in terms.values() for w in set(ws)), (sum(bool(w) for w in terms.values()), sum(map(len, terms.values())))


def state(index):
    postings = [(r.id, r.term, r.tf, r.dl) for r in index.postings.collect()]
    assert len(postings) == len(set(postings))
    return set(postings), Counter({r.term: r.df for r in index.frequencies.collect()}), tuple(index.totals.first())


def test_update_equals_rebuild(spark, tmp_path):
    path = str(tmp_path / "index")
    build_index(docs(spark, BEFORE), path)
    assert state(open_index(spark, path)) == plain(BEFORE)
    changes = {(r.id, r.change) for r in update_index(docs(spark, AFTER), path).collect()}
    assert changes == {(2, "changed"), (3, "changed"), (4, "changed"), (5, "removed"), (7, "added")}
    assert state(open_index(spark, path)) == plain(AFTER)
    # there and back again: entries of the base that were taken back stay so
    update_index(docs(spark, BEFORE), path)
    assert state(open_index(spark, path)) == plain(BEFORE)
    assert update_index(docs(spark, BEFORE), path).collect() == []
    assert len(names(spark, f"{path}/segments")) == 3
    compact_index(spark, path)
    assert state(open_index(spark, path)) == plain(BEFORE)
    update_index(docs(spark, AFTER), path)
    assert state(open_index(spark, path)) == plain(AFTER)
    update_index(docs(spark, []), path)
    assert state(open_index(spark, path))[:2] == (set(), Counter())


def test_terms_are_counted_within_their_text(spark):
    rows = [(i, " ".join("wxyz"[j * j % 4] * (4 + (i * j) % 5) for j in range(i))) for i in range(40)] + [(90, None), (91, ""), (92, "abc"), (93, "Zeta alpha ZETA zeta"), (94, "once")]
    found = text_index.postings_of(docs(spark, rows).withColumnRenamed("doc_id", "id"))
    got = found.collect()
    assert {(r.id, r.term, r.tf, r.dl) for r in got} == plain(rows)[0] and len(got) == len(plain(rows)[0])
    assert {(r.id, r.term) for r in got if r.lead} == {(i, ws[0]) for i, t in rows for ws in (re.findall("[a-z]{4,}", (t or "").lower()),) if ws}
    plan = found._jdf.queryExecution().toString()
    assert "Exchange" not in plan and "Aggregate" not in plan


def test_postings_lie_in_order(spark, tmp_path):
    rows = [(i, "alpha " + "beta " * (i % 3) + "gamma" * (i % 2)) for i in range(300)]
    build_index(docs(spark, rows), str(tmp_path / "index"))
    assert state(open_index(spark, str(tmp_path / "index"))) == plain(rows)
    for file in (tmp_path / "index" / "segments" / "00000000-base" / "postings").glob("*.parquet"):
        keys = [(r.term, r.id) for r in spark.read.parquet(str(file)).coalesce(1).collect()]
        assert keys == sorted(keys)


def test_only_changes_are_tokenised(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    build_index(docs(spark, BEFORE), path)
    seen = []
    tokens = text_index.postings_of
    monkeypatch.setattr(text_index, "postings_of", lambda d, *a: (seen.extend(r.id for r in d.collect()), tokens(d, *a))[1])
    update_index(docs(spark, AFTER), path)
    assert sorted(seen) == [2, 3, 4, 7]


def test_scores_of_an_updated_index(spark, tmp_path):
    queries = spark.createDataFrame([("q", "gamma"), ("q", "delta"), ("r", "beta"), ("r", "nowhere")], "query_id string, term string")
    found = []
    for k, old in enumerate((BEFORE, AFTER)):
        path = str(tmp_path / f"index{k}")
        build_index(docs(spark, old), path)
        update_index(docs(spark, AFTER), path)
        index = open_index(spark, path)
        for extra in ((), (index.frequencies, index.totals)):
            found.append({(r.query_id, r.id): round(r.score, 9) for r in ranking.bm25(queries, index.postings, *extra).collect()})
    assert found[0] and all(f == found[0] for f in found)


def test_no_index(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        open_index(spark, str(tmp_path / "none"))


def test_a_writer_that_dies_leaves_the_old_table(spark, tmp_path):
    folder = str(tmp_path / "table")
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "x int")
    read = lambda last: sorted(r.x for r in read_batches(spark, folder, "x int", last).collect())
    assert read(False) == []
    assert write_batch(rows(1, 2), folder, 0)

    def half(path):
        rows(7).write.parquet(path)
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        publish(spark, folder, "batch=000000000001", half)
    assert read(False) == [1, 2] and names(spark, folder) == ["batch=000000000000"]
    # what a writer leaves that can't clean up after itself isn't read either
    rows(8).write.parquet(f"{folder}/_staged-dead")
    assert read(False) == [1, 2]
    assert write_batch(rows(3), folder, 1)
    assert not write_batch(rows(4), folder, 1)  # the same batch again
    assert read(False) == [1, 2, 3] and read(True) == [3]
    replace_table(rows(5, 6), folder)
    assert read(True) == [5, 6]


def test_the_first_of_two_writers_wins(spark, tmp_path):
    folder = str(tmp_path / "race")
    rows = lambda x: spark.createDataFrame([(x,)], "x int")

    def slow(path):
        rows(1).write.parquet(path)
        assert write_batch(rows(2), folder, 0)

    assert not publish(spark, folder, "batch=000000000000", slow)
    assert [r.x for r in read_batches(spark, folder, "x int").collect()] == [2]
    assert names(spark, folder) == ["batch=000000000000"]
