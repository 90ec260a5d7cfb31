"""Edges of the scoring, parsing, ranking and lifecycle operators."""

from decimal import Decimal

from pyspark.sql import functions as F

from sievework.functions import text
from sievework.operators import graph, integrity, parsing, ranking, rollup, scoring, usage
from sievework.sources import readers


def one(spark, col, **values):
    ddl = ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], ddl).select(col).first()[0]


def test_paths(spark):
    assert one(spark, text.normal_path(F.col("p")), p="../.x\\y/") == "x/y"
    assert one(spark, text.drop_dot_slash(F.col("p")), p="././a") == "./a"
    assert one(spark, text.is_test_file(F.col("p")), p="a/testdata/x.go")
    assert not one(spark, text.is_test_file(F.col("p")), p="a/contest.go")


def test_symbols(spark):
    assert one(spark, text.bare_symbol(F.col("s")), s="(*Pool).add()") == "add"
    assert one(spark, text.checkable_symbol(F.col("s")), s=" a.B() ")
    assert not one(spark, text.checkable_symbol(F.col("s")), s="two words")


def test_tokens(spark):
    assert one(spark, text.tokens_of_chars(F.col("n")), n=401) == 101
    assert one(spark, text.tokens_of_chars(F.col("n"), 0), n=8) == 2
    assert one(spark, text.estimated_tokens(F.col("s")), s="abcdefg") == 1


def test_terms(spark):
    got = one(spark, text.search_terms(F.col("p"), ("what",)), p="What is `quorumSize` and QuorumSize in theFile go? Cite the exact file.")
    assert got == ["quorumSize", "theFile"]


def test_empty_expectations(spark):
    q = spark.createDataFrame([("none",), ("some",)], "q string")
    schema = "q string, path string, start_line long, end_line long"
    pred = spark.createDataFrame([("some", "./a.go", None, None), ("some", "./a.go", 1, 2)], schema)
    got = {r.q: (r.precision, r.recall, r.f1) for r in scoring.location_scores(q, pred, spark.createDataFrame([], schema), ["q"]).collect()}
    assert got == {"none": (1.0, 1.0, 1.0), "some": (0.0, 1.0, 0.0)}
    exp = spark.createDataFrame([("some", "a.go", 5, 9)], schema)
    got = {r.q: (r.n_pred, r.precision, r.recall) for r in scoring.location_scores(q, pred, exp, ["q"]).collect()}
    assert got["some"] == (2, 0.5, 1.0)  # a null bound overlaps


def test_costs(spark):
    prices = spark.createDataFrame([("m", "15", "75", "18.75", "1.5")], "model string, input string, output string, cache_write string, cache_read string")
    used = spark.createDataFrame([("m", "session_x", 1_000_000, 1_000_000, 0, 0), ("m", "chars", 1, 0, 0, 1), ("other", "session", 5, 5, 5, 5)], "model string, src string, input long, output long, cache_write long, cache_read long")
    got = {(r.model, r.src): (r.amount, r.status) for r in usage.costs(used, prices, "src").collect()}
    assert got[("m", "session_x")] == (Decimal("90.000000"), "actual")
    assert got[("m", "chars")] == (Decimal("0.000017"), "estimated")  # 16.5 millionths, halves up
    assert got[("other", "session")] == (Decimal("0"), "unknown")


def test_cost_status(spark):
    rows = spark.createDataFrame([("a", "actual"), ("b", "actual"), ("b", "estimated"), ("c", "unknown"), ("d", "actual"), ("d", "unknown"), ("e", None)], "k string, s string")
    got = dict(rows.groupBy("k").agg(rollup.cost_status(F.col("s"))).collect())
    assert got == {"a": "actual", "b": "estimated", "c": "unknown", "d": "mixed", "e": "unknown"}


def test_majority_tie(spark):
    assert one(spark, scoring.majority(F.col("y"), F.col("n")), y=2, n=2) is True
    assert one(spark, scoring.majority(F.col("y"), F.col("n")), y=0, n=0) is None


def test_blocks():
    assert parsing.first_block('a {"x": 1} {"answer": {"y": "}"}} z') == '{"answer": {"y": "}"}'  # the brace in the string counts
    assert parsing.first_block('} {"answer": 1}') is None


def test_trees(spark):
    assert one(spark, parsing.tree_to_markdown(F.col("t")), t="no tree") == ""
    assert one(spark, parsing.tree_to_markdown(parsing.paragraph_tree(F.col("t"))), t="a b") == "a b"


def test_graph_cap_and_cycle(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("b", "c", "y"), ("c", "d", "x")], "src string, dst string, kind string")
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r.node, r.depth) for r in graph.reachable(seeds, edges, 2).collect()} == {("b", 1), ("c", 2)}
    assert {r.node for r in graph.reachable(seeds, edges, 3, cap=1).collect()} == {"b"}
    assert {r.node for r in graph.reachable(seeds, edges, 3, kinds=("x",)).collect()} == {"b"}


def test_budget(spark):
    blocks = spark.createDataFrame([("q", 1, "aaaa"), ("q", 2, "bbbb"), ("q", 3, "c")], "q string, i int, t string")
    kept = ranking.within_budget(blocks, ["q"], [F.col("i")], F.length("t"), 7)
    assert [r.i for r in kept.collect()] == [1]  # stops at the first overflow
    cut = ranking.cut_to_budget(blocks, ["q"], [F.col("i")], "t", 6, "!")
    assert [(r.i, r.t) for r in cut.orderBy("i").collect()] == [(1, "aaaa"), (2, "bb!")]


def test_drift_and_fallback(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "k string, v string")
    b = spark.createDataFrame([("y", "3"), ("z", "4")], "k string, v string")
    assert dict(integrity.drift(a, b, "k", "v").collect()) == {"x": "missing", "y": "differs", "z": "unexpected"}
    both = {(r.k, r.src) for r in integrity.prefer(a, b, ["k"], "src", ("first", "second")).collect()}
    assert both == {("x", "first"), ("y", "first"), ("z", "second")}


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1}\n\nnot json\n{"a": 2}\n{"a":')
    assert sorted(r.a for r in readers.read_json_lines(spark, str(tmp_path), "a int").collect()) == [1, 2]


def test_flat_yaml():
    assert readers.parse_yaml("a: 1\nb:\n  - x\n  - 'y'  # note\nc: ~\nd: true\n") == {"a": 1, "b": ["x", "y"], "c": None, "d": True}


def test_replay_key(spark):
    import hashlib

    assert one(spark, readers.replay_key(F.col("s"), F.col("u")), s="a\"b", u="c") == hashlib.sha256(b'["a\\"b", "c"]').hexdigest()


def test_mode_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("m", True, None)], "m string, ok boolean, x double")
    readers.write_report_csv(rollup.csv_columns(df, ["m", "ok", "x"]), str(tmp_path / "r"))
    assert spark.read.option("header", True).csv(str(tmp_path / "r")).first()["ok"] == "1"


def test_findings_of_mutants_without_their_columns(spark):
    from sievework.operators import gates

    site = lambda n, a, t: (n, a, t)
    cases = [
        ("a", [site("x.add", "add", "TSum"), site("y.evict", "sub", "TPress"), site("z.read", "read", None)], "TSum", "TPress", ["## Step 1: a", "## Step 2: b"], 2, ["x.add", "y.evict"], ["TSum", "TPress"]),
        ("b", [site("x.add", "add", "TSum"), site("y", "rebuild", None)], "TSum", None, ["## Step 1: a", None, "text"], 1, None, ["TSum", ""]),
        ("c", None, "TSum", "TPress", ["## Step 1: a"], 2, ["x"], ["TSum", "TPress"]),
        ("d", [], "", "T", [], 0, [], None),
        ("e", [site("x", None, "T"), site(None, "add", "T"), site("x", "add", "T"), site("x", "sub", "")], "T", "T", None, 1, ["x"], ["T"]),
    ]
    rows = spark.createDataFrame(cases, gates.CASE)
    cols = ("case_id", "mutant", "category", "expect_before", "expect_after", "found_before", "found_after")
    got = sorted(gates.mutant_findings(rows).select(*cols).collect(), key=str)
    assert got == sorted(gates.findings(gates.mutants(rows)).select(*cols).collect(), key=str) and len(got) == 9 * len(cases)
    found = {(r.case_id, r.mutant): r.found_after for r in got}
    assert found["a", "clean"] == [] and found["a", "uncover_blank"] == ["covered"] and found["a", "drop_invariant_test"] == ["invariant", "covered"]
    assert found["a", "plan_malformed_heading"] == ["plan"] and found["a", "impl_drop_site"] == ["maintained"] and found["c", "clean"] == ["plan"]
    # headings are counted for the case and for the mutant that changes one, not for each mutant
    plan = gates.mutant_findings(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("Step") <= 3


def test_ranked_hunks_group_only_wanted_terms(spark):
    from sievework.operators import diffs

    ddl = "id long, file string, pos int, added string, removed string"
    found = spark.createDataFrame([(1, "a", 0, "alpha beta", "beta"), (1, "b", 1, "gamma", ""), (2, "c", 0, "", "x"), (3, "d", 0, "alpha", "delta delta")], ddl)
    queries = spark.createDataFrame([("q", "alpha"), ("q", "nowhere"), ("p", "delta")], "query_id string, term string")
    best = diffs.ranked_hunks(queries, found, 2)
    got = {(r.query_id, r.id, r.pos, r.file, r.rank) for r in best.collect()}
    assert got == {("q", 1, 0, "a", 1), ("q", 3, 0, "d", 2), ("p", 3, 0, "d", 1)}
    plan = best._jdf.queryExecution().optimizedPlan().toString()
    assert "sum((cast(tf" not in plan and "sum(tf" not in plan
