"""Reports, advice, packs and rescored cells by hand."""

from pyspark.sql import functions as F

from sievework.operators import checks, rollup
from sievework.operators.evaluation import rescored


def frame(spark, ddl, *rows):
    return spark.createDataFrame(list(rows), ddl)


def test_report_in_the_callers_order(spark):
    found = frame(spark, "method string, n long, f1 double, flags array<string>", ("b", 2, 0.5, ["x", "y"]), ("a", 1, None, []), ("unasked", 9, 1.0, []))
    order = frame(spark, "method string, pos int", ("z", 0), ("b", 1), ("a", 2))
    lines = [r.line for r in rollup.report_table(found, order, "method", ["method", "n", "f1"]).orderBy("pos").collect()]
    assert lines == ["| method | n | f1 |", "|---|---|---|", "| z | — | — |", "| b | 2 | 0.5000 |", "| a | 1 | — |"]
    rows = [tuple(r) for r in rollup.report_rows(found, order, "method", ["method", "n", "f1", "flags"]).orderBy("pos").collect()]
    assert rows == [(0, "z", "", "", ""), (1, "b", "2", "0.5", "x;y"), (2, "a", "1", "", "")]


def test_sections_of_a_report(spark):
    some = frame(spark, "pos long, line string", (0, "l0"), (1, "l1"))
    change = frame(spark, "baseline string, target string, delta_correct_rate double, token_reduction_pct double", ("a", "b", -0.25, 12.0))
    got = [(r.section, r.line) for r in rollup.report_sections(("One", some), ("Two", some.limit(0)), ("Three", rollup.delta_lines(change))).orderBy("section", "pos").collect()]
    assert got == [
        (0, "## One"), (0, "l0"), (0, "l1"), (1, "## Two"), (1, "_not available_"),
        (2, "## Three"), (2, "| metric | value |"), (2, "|---|---|"), (2, "| baseline | a |"), (2, "| target | b |"), (2, "| delta_correct_rate | -0.2500 |"), (2, "| token_reduction_pct | +12.0 |"),
    ]


def test_advice_comes_after_issues(spark):
    settings = frame(spark, "key string, status string, secret boolean", ("B", "unset", False), ("A", "unset", False), ("ROOT", "unset", False), ("TOKEN", "unset", True), ("C", "restart_needed", False), ("D", "ok", False))
    told = checks.advice(settings, F.lit(False), ("ROOT",))
    assert {(r.kind, r.pos, r.detail) for r in told.collect()} == {("restart_needed", 0, "C"), ("env_unset", 1, "A, B"), ("env_secret_unset", 2, "TOKEN"), ("permissions_unset", 3, "")}
    assert "permissions_unset" not in {r.kind for r in checks.advice(settings, F.col("key") == "D").collect()}
    issues = frame(spark, "kind string, pos int", ("lost", 4), ("env_unset", 7), ("lost", 2))
    got = checks.remedies(issues, frame(spark, "kind string, fix string", ("lost", "find it")), "by hand", told).orderBy("advice", "pos").collect()
    assert [(r.kind, r.n, r.fix) for r in got] == [("lost", 2, "find it"), ("env_unset", 2, "by hand"), ("restart_needed", 1, "by hand"), ("env_secret_unset", 1, "by hand"), ("permissions_unset", 1, "by hand")]


def test_problems_of_packs(spark):
    packs = frame(spark, "id string, doc string", ("ok", '{"project_id": "ok", "inv": "a.md"}'), ("bad", '{"inv": '), ("other", '{"project_id": "x", "inv": "b.md"}'), ("empty", "{}"), ("none", None))
    files = frame(spark, "id string, name string", ("ok", "a.md"), ("other", "a.md"))
    got = sorted((r.id, r.problem) for r in checks.pack_problems(packs, files, ("project_id",), ("inv",), "project_id").collect())
    assert got == [("bad", "invalid JSON"), ("empty", "missing key project_id"), ("none", "invalid JSON"), ("other", "inv -> b.md not found"), ("other", "project_id x is not the folder")]


def test_rescored_metrics(spark):
    ddl = "cell_id int, question_id string, answer string, recall double, parse_mode string, correctness boolean, unsupported long"
    cells = frame(spark, ddl, (1, "q", "the Pool", 0.5, "strict", False, 0), (2, "q", "the pool", 1.0, "strict", True, 2), (3, "q", "no", 1.0, "strict", False, 1), (4, "u", "x", 0.4, "strict", False, 0))
    questions = frame(spark, "question_id string, keywords array<string>", ("q", ["pool"]))
    counts = frame(spark, "cell_id int, unsupported long", (2, 2), (1, 3))
    get = lambda *metrics: {r.cell_id: (r.correctness, r.unsupported, r.changed) for r in rescored(cells, questions, counts, metrics).collect()}
    assert get("correctness") == {1: (True, 0, True), 2: (True, 2, False), 3: (False, 1, False), 4: (False, 0, False)}
    assert get("unsupported") == {1: (False, 3, True), 2: (True, 2, False), 3: (False, 0, True), 4: (False, 0, False)}
    assert get("correctness", "unsupported")[1] == (True, 3, True)
