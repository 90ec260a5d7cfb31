"""Tickets, domains, diffs and suffix matches by hand and by brute force."""

import random

from pyspark.sql import functions as F

from sievework.operators import checks, diffs, domains, tickets


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


def parse(spark, *rows):
    df = frame(spark, "id int, summary string, description string", [(i, *r) for i, r in enumerate(rows)])
    return tickets.parsed_tickets(df).orderBy("id").collect()


def test_sections_lists_and_pairs(spark):
    text = "lead\n## 영향  범위\n- 모듈: consensus, governance\n- 예상 변경 파일: a/b.go\n- plain\n- http://x.y\n### Acceptance Criteria\n* [ ] first\n- [X] second: done\n\n##no heading\n#### deeper\n## Own Name\nsome\ntext  \n"
    (r,) = parse(spark, ("s", text))
    scope, criteria, own = r.sections
    assert (scope.key, scope.bullets) == ("scope", ["모듈: consensus, governance", "예상 변경 파일: a/b.go", "plain", "http://x.y"])
    assert [(p.key, p["values"]) for p in scope.pairs] == [("modules", ["consensus", "governance"]), ("expected_files", ["a/b.go"])]
    assert (criteria.key, criteria.bullets, [(c.text, c.checked) for c in criteria.checklist]) == ("acceptance_criteria", [], [("first", False), ("second: done", True)])
    assert (own.key, own.body) == ("own name", "some\ntext")


def test_more_sections_than_any_cap(spark):
    (r,) = parse(spark, ("s", "".join(f"## h{i}\nbody {i}\n" for i in range(10_050))))
    assert len(r.sections) == 10_050 and r.sections[-1].body == "body 10049"


def test_kinds(spark):
    stated = ["## Work Type: New Feature", "## 타입: 버그 수정", "**작업 유형**: Code Review", "## type:RELEASE ", "## Type: odd\nplain text", "text\n## Type: bug"]
    guessed = ["a bug to fix", "one bug", "please review", "tag v1.2", "", None]
    got = [(r.work_type, r.stated, r.pipeline_variant) for r in parse(spark, *((None, t) for t in stated + guessed))]
    assert got[:6] == [("feature", True, "full"), ("bugfix", True, "full"), ("code_review", True, "review_only"), ("release", True, "release"), ("feature", False, "full"), ("bugfix", True, "full")]
    assert got[6:] == [("bugfix", False, "full"), ("feature", False, "full"), ("code_review", False, "review_only"), ("release", False, "release"), ("unknown", False, "full"), ("unknown", False, "full")]


def test_missing_fields_and_warnings(spark):
    full = "## Type: Bug\n## Repro\n- a\n## Expected\nx\n## Actual\ny\n## Scope\n- modules: core"
    rows = parse(spark, ("s", full), (None, "## Type: feature\n## Background\nwhy"), ("s", "## Type: review\n## Target\n- core/\n## AC\n- [ ] x"), ("s", "## Type: release\n## Version\n1\n## Changes\n\n## Checklist\n- [ ] Bench run"), ("", ""), ("s", "## Type: release"))
    assert [r.missing_fields for r in rows] == [[], ["summary", "scope.modules"], [], ["changes"], [], ["version", "changes"]]
    assert [len(r.warnings) for r in rows] == [0, 0, 1, 0, 1, 1]


def test_domains_and_complexity(spark):
    rules = frame(spark, "pos int, part string, module string", [(0, "core/txpool/", "txpool"), (1, "core/", "core"), (2, "p2p/", "p2p"), (3, "rpc/", "rpc")])
    paths = [("a", "core/txpool/x.go"), ("a", "core/y.go"), ("a", "core/z.go"), ("a", "core/z.go"), ("b", "p2p/x"), ("c", "docs/x"), ("d", "core/1"), ("d", "p2p/1"), ("d", "rpc/1"), ("d", None)]
    found = {r.id: (r.primary_domain, r.domains, r.confidence) for r in domains.domains_of(domains.classified(frame(spark, "id string, path string", paths), rules)).collect()}
    assert found == {"a": ("core", ["core", "txpool"], "medium"), "b": ("p2p", ["p2p"], "high"), "c": (None, [], "low"), "d": ("core", ["core", "p2p", "rpc"], "low")}
    cases = [(["core"], "x"), (["core"], "a Race here"), (["core", "p2p"], None), (["core", "p2p"], "mutex"), (["txpool"], ""), (["a", "b", "c"], ""), ([], "HardFork"), ([], None)]
    got = frame(spark, "i int, d array<string>, s string", [(i, *c) for i, c in enumerate(cases)]).orderBy("i").select(domains.complexity(F.col("d"), F.col("s"), ("txpool",)).alias("c")).collect()
    assert [r.c for r in got] == ["simple", "moderate", "moderate", "complex", "complex", "complex", "complex", "simple"]


DIFF = """diff --git a/core/a.go b/core/a.go
index 1..2 100644
--- a/core/a.go
+++ b/core/a.go
@@ -1,3 +1,4 @@ func a
 same
-gone
+token one
+--- not a file
 same
@@ -9 +11,0 @@
-last
diff --git a/old.go b/old.go
deleted file mode 100644
--- a/old.go
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-y
"""


def test_hunks(spark):
    rows = frame(spark, "id int, diff string", [(1, DIFF), (2, None), (3, "no diff"), (4, "--- a/x\n+++ b/x\nno hunk"), (5, "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+é token")])
    got = [tuple(r) for r in diffs.hunks(rows, "id", "diff").orderBy("id", "pos").collect()]
    assert got == [
        (1, "core/a.go", 0, 1, 3, 1, 4, "token one\n--- not a file", "gone"), (1, "core/a.go", 1, 9, 1, 11, 0, "", "last"), (1, "old.go", 2, 1, 2, 0, 0, "", "x\ny"),
        (5, "x", 0, 1, 1, 1, 1, "é token", ""),
    ]
    queries = frame(spark, "query_id string, term string", [("q", "token")])
    best = diffs.ranked_hunks(queries, diffs.hunks(rows, "id", "diff"), 5).orderBy("rank").collect()
    assert [(r.id, r.file, r.pos) for r in best] == [(5, "x", 0), (1, "core/a.go", 0)]


def test_suffixes_with_a_common_last_segment(spark):
    rng = random.Random(2)
    path = lambda: "/".join([*(rng.choice(["a", "b", "ab"]) for _ in range(rng.randrange(4))), rng.choice(["index.html", "x.html", "html"])])
    left, right = [path() for _ in range(60)] + ["", None], [path() for _ in range(60)] + [""]
    table = lambda ps: frame(spark, "path string", [(p,) for p in ps])
    got = {(r.a, r.b) for r in checks.suffix_matches(table(left), table(right)).collect()}
    assert got == {(a, b) for a in left for b in right if a and b and (a.endswith(b) or b.endswith(a))}
    cited = [(i, p, rng.randrange(9), 9) for i, p in enumerate(left)]
    known = [(p, s := rng.randrange(20), s + 1) for p in right]
    found = checks.suffix_locations(frame(spark, "id int, path string, start_line int, end_line int", cited), frame(spark, "path string, start_line int, end_line int", known))
    wanted = {i: any((p, b) in got and s <= t and u <= e for b, u, t in known) for i, p, s, e in cited}
    assert {r.id: r.found for r in found.collect()} == wanted
