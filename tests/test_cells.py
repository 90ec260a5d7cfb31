"""Citations with symbols, and cells that cite them."""

import json
import time

from pyspark.sql import functions as F

from sievework.operators.evaluation import scored_cells
from sievework.operators.parsing import parse_responses
from sievework.operators.scoring import reference_verdicts
from sievework.sources.text_index import words_of

FILES = ["core/set.go", "core/timer.go"]


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


def verdicts(spark, symbols, words=("QuorumSize", "newTimer"), indexed=("QuorumSize",), up=None):
    rows = [(i, path, s) for i, (path, s) in enumerate(symbols)]
    cited = frame(spark, "id int, path string, symbol string", rows)
    if up is not None:
        from pyspark.sql import functions as F

        cited = cited.withColumn("index_up", F.lit(up).cast("boolean"))
    index = None if indexed is None else frame(spark, "name string", [(n,) for n in indexed])
    found = reference_verdicts(cited, frame(spark, "path string", [(f,) for f in FILES]), index, frame(spark, "name string", [(w,) for w in words]))
    return [(r.reason, r.is_unsupported, r.is_partial) for r in found.orderBy("id").collect()]


def test_two_steps(spark):
    cited = [
        ("core/set.go", None), ("core/gone.go", "QuorumSize"), ("./core/set.go", "set.QuorumSize()"), ("core/set.go", "core.newTimer"), ("core/set.go", "totallyMadeUp"),
        ("core/set.go", "names of constants"), ("core/set.go", "11-fee"), ("core/set.go", ""), ("core/set.go", "quorumsize"),
    ]
    assert verdicts(spark, cited) == [
        ("file_only", False, False), ("file_missing", True, False), ("symbol_indexed", False, False), ("symbol_in_text", False, False), ("symbol_missing", True, False),
        ("symbol_not_checkable", False, False), ("symbol_not_checkable", False, False), ("file_only", False, False), ("symbol_missing", True, False),
    ]


def test_text_alone_is_partial(spark):
    cited = [("core/set.go", "QuorumSize"), ("core/set.go", "madeUp"), ("core/set.go", "no name"), ("core/gone.go", "QuorumSize"), ("core/set.go", "onlyIndexed")]
    wanted = [("symbol_in_text", False, True), ("symbol_missing", True, True), ("symbol_not_checkable", False, False), ("file_missing", True, False), ("symbol_missing", True, True)]
    assert verdicts(spark, cited, indexed=None) == wanted
    assert verdicts(spark, cited, indexed=("onlyIndexed",), up=False) == wanted
    assert verdicts(spark, cited, indexed=("onlyIndexed",), up=None)[-1] == ("symbol_indexed", False, False)


def test_citations_carry_symbols_and_numbers(spark):
    cited = [{"file": "a/b.go", "start_line": "12", "end_line": 20.7, "symbol": "X"}, {"file": "a/c.go", "start_line": "12.5", "symbol": ""}, {"file": ""}, "no object"]
    rows = [(1, json.dumps({"answer": "x", "citations": cited})), (2, "see a/b.go:3")]
    got = {r.id: [tuple(c) for c in r.citations] for r in parse_responses(frame(spark, "id int, text string", rows), "text").collect()}
    assert got == {1: [("a/b.go", 12, 20, "X"), ("a/c.go", None, None, None)], 2: [("a/b.go", 3, 3, None)]}


def test_cells_count_unknown_symbols(spark):
    cite = lambda *cs: json.dumps({"answer": "yes", "citations": [{"file": f, "start_line": 1, "end_line": 2, "symbol": s} for f, s in cs]})
    cells = [
        (1, "q", cite(("core/set.go", "NoSuchThing"), ("core/set.go", "QuorumSize")), 10, True),
        (2, "q", cite(("core/set.go", "newTimer")), 10, True),
        (3, "q", cite(("core/set.go", "newTimer"), ("core/gone.go", None)), 10, False),
        (4, "q", "nothing", 10, False),
    ]
    found = scored_cells(
        frame(spark, "cell_id int, question_id string, response string, injected_tokens long, index_up boolean", cells),
        frame(spark, "question_id string, keywords array<string>", [("q", [])]),
        frame(spark, "question_id string, path string, start_line int, end_line int", [("q", "core/set.go", 1, 9)]),
        frame(spark, "path string", [(f,) for f in FILES]), frame(spark, "name string", [("QuorumSize",)]), frame(spark, "name string", [("newTimer",)]),
    )
    assert {r.cell_id: (r.citations, r.unsupported, r.is_partial, r.correctness) for r in found.collect()} == {1: (2, 1, False, True), 2: (1, 0, False, True), 3: (2, 1, True, True), 4: (0, 0, False, False)}
    assert "EvalPython" not in found._jdf.queryExecution().toString()  # answers have been parsed, once for all that is joined


def test_words_are_all_words(spark):
    texts = frame(spark, "doc_id long, text string", [(1, "One two one, One_2"), (2, None), (3, ""), (4, "two--\u00e9t\u00e9 THREE"), (5, "--")])
    assert sorted(r.name for r in words_of(texts, "text", "[A-Za-z0-9_]+").collect()) == ["One", "One_2", "THREE", "one", "t", "two"]


def test_prose_is_read_only_where_it_counts(spark):
    long = "a" * 100_000  # the pattern of prose citations takes its square
    own = [{"file": "a/b.go", "start_line": 1, "end_line": 2, "symbol": None}]
    strict, block = json.dumps({"answer": long, "citations": []}), "Well: " + json.dumps({"answer": long, "citations": own})
    bare = 'See a/c.go:3. {"answer": "x", "citations": []}'
    start = time.monotonic()
    found = parse_responses(frame(spark, "id int, text string", [(1, strict), (2, block), (3, bare), (4, "a/d.py"), (5, "none"), (6, None)]), "text")
    got = {r.id: (r.parse_mode, len(r.answer), [tuple(c) for c in r.citations]) for r in found.collect()}
    assert got == {
        1: ("strict", len(long), []), 2: ("lenient", len(long), [("a/b.go", 1, 2, None)]), 3: ("lenient", 1, [("a/c.go", 3, 3, None)]),
        4: ("lenient", 6, [("a/d.py", None, None, None)]), 5: ("failed", 0, []), 6: ("failed", 0, []),
    }
    assert time.monotonic() - start < 20


def test_citations_without_a_name_are_dealt(spark):
    cited = spark.range(0, 4000, 1, 8).select("id", F.concat(F.lit("f"), F.col("id") % 97, F.lit(".go")).alias("path"), F.when(F.col("id") % 10 == 0, "newTimer").otherwise("no name").alias("symbol"))
    files = cited.select("path").distinct()
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = reference_verdicts(cited, files, frame(spark, "name string", [("x",)]), frame(spark, "name string", [("newTimer",)]))
        dealt = found.groupBy("reason", F.spark_partition_id().alias("task")).count().collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    rows = {reason: [r["count"] for r in dealt if r.reason == reason] for reason in ("symbol_in_text", "symbol_not_checkable")}
    assert {k: sum(v) for k, v in rows.items()} == {"symbol_in_text": 400, "symbol_not_checkable": 3600}
    assert max(rows["symbol_not_checkable"]) < 1800


def test_words_of_broken_texts_and_of_many_batches(spark):
    texts = spark.range(0, 3000, 1, 3).select(F.when(F.col("id") % 7 != 0, F.concat(F.lit("one w"), F.col("id") % 50, F.lit("-\U0001f600x_"), F.col("id") % 2)).alias("text"))
    broken = spark.sql("SELECT cast(X'6F6E65FF74776F' AS string) AS text")  # one, a byte that is no UTF-8, two
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
        found = [r.name for r in words_of(texts.union(broken), "text", "[A-Za-z0-9_]+").collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(found) == sorted({"one", "two", "x_0", "x_1", *(f"w{i}" for i in range(50))})
