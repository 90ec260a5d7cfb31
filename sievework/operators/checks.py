"""Completeness checks, settings, verdicts and incremental refresh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.text import ranges_overlap


def validate_ranges(expected: DataFrame, files: DataFrame) -> DataFrame:
    """expected (id, path, start_line, end_line) with problem: the file is missing, or a line lies outside its n_lines; null if fine."""
    j = expected.join(files.select("path", "n_lines"), "path", "left")
    problem = F.when(F.col("n_lines").isNull(), "file_missing").when(F.col("start_line").isNull(), None).when(~F.col("start_line").between(1, F.col("n_lines")), "start_out_of_range").when(~F.col("end_line").between(F.col("start_line"), F.col("n_lines")), "end_out_of_range")
    return j.select(*expected.columns, problem.alias("problem"))


def suffix_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Different pairs (a, b) of paths of left and right of which one ends with the other.

    A path meets those that are as long as one of its endings by that whole ending, so a last segment that many paths share
    is no common key. Endings are taken at the lengths that the other side has, of which there are no more than characters in its longest path.
    """

    def ends_with(long: DataFrame, short: DataFrame) -> DataFrame:
        sizes = short.agg(F.collect_set(F.length("path")).alias("_sizes"))  # one row
        cut = F.explode(F.transform(F.filter("_sizes", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.length("path") - n + 1, n)))
        endings = long.join(F.broadcast(sizes), F.lit(True)).select(F.col("path").alias("long"), cut.alias("short"))
        return endings.join(short.select(F.col("path").alias("short")), "short").select("long", "short")

    l, r = (x.select("path").where("path <> ''").distinct() for x in (left, right))
    return ends_with(l, r).select(F.col("long").alias("a"), F.col("short").alias("b")).union(ends_with(r, l).select(F.col("short").alias("a"), F.col("long").alias("b"))).distinct()


def suffix_locations(cited: DataFrame, known: DataFrame) -> DataFrame:
    """cited (id, path, start_line, end_line) with found: whether any place of known (path, start_line, end_line) overlaps it in a file
    whose path ends with the cited one, or the other way round."""
    pairs = suffix_matches(cited, known)
    k = known.select(F.col("path").alias("b"), F.col("start_line").alias("_s"), F.col("end_line").alias("_e"))
    near = cited.join(pairs, cited["path"] == pairs["a"]).join(k, "b").where(ranges_overlap(F.col("start_line"), F.col("end_line"), F.col("_s"), F.col("_e")))
    hit = near.select("id").distinct().withColumn("_hit", F.lit(True))
    return cited.join(hit, "id", "left").select(*(cited[c] for c in cited.columns), F.coalesce("_hit", F.lit(False)).alias("found"))


def next_sibling(files: DataFrame) -> DataFrame:
    """Each file (dir, name) with another one of its folder: the first by name, or the second for the first; null if alone."""
    first = files.groupBy("dir").agg(F.slice(F.sort_array(F.collect_set("name")), 1, 2).alias("_two"))  # a folder's names
    other = F.when(F.get("_two", F.lit(0)) != F.col("name"), F.get("_two", F.lit(0))).otherwise(F.get("_two", F.lit(1)))
    return files.join(first, "dir").select("dir", "name", other.alias("sibling"))


def setting_status(process: DataFrame, saved: DataFrame, wanted: DataFrame) -> DataFrame:
    """key, status of each wanted key: ok if the process has it, restart_needed if only the saved settings do, else unset."""
    has = lambda df, c: df.where("value <> ''").select("key").distinct().withColumn(c, F.lit(True))
    j = wanted.select("key").join(has(process, "_p"), "key", "left").join(has(saved, "_s"), "key", "left")
    return j.select("key", F.when(F.col("_p"), "ok").when(F.col("_s"), "restart_needed").otherwise("unset").alias("status"))


def merge_settings(old: DataFrame, new: DataFrame, force: bool) -> DataFrame:
    """key, value, written: filled values of new where old has none, or everywhere if forced."""
    o, n = old.select("key", F.col("value").alias("_o")), new.where("value <> ''").select("key", F.col("value").alias("_n"))
    take = F.col("_n").isNotNull() & (F.col("_o").isNull() | F.lit(force))
    return o.join(n, "key", "full").select("key", F.when(take, F.col("_n")).otherwise(F.col("_o")).alias("value"), take.alias("written"))


def remedies(issues: DataFrame, fixes: DataFrame, default: str, advisories: DataFrame | None = None) -> DataFrame:
    """kind, pos, n, fix: each kind of issue (kind, pos) once, at its first place, with its fix; then each kind of advice that is no
    issue (kind, pos), after all issues in its own order."""
    rows = issues.select("kind", F.lit(0).alias("_g"), F.col("pos").cast("long").alias("pos"))
    if advisories is not None:
        rows = rows.unionByName(advisories.select("kind", F.lit(1).alias("_g"), F.col("pos").cast("long").alias("pos")))
    first = rows.groupBy("kind").agg(F.min(F.struct("_g", "pos")).alias("at"), F.count(F.lit(1)).alias("n"))
    return first.join(fixes, "kind", "left").select("kind", F.col("at.pos").alias("pos"), (F.col("at._g") == 1).alias("advice"), "n", F.coalesce("fix", F.lit(default)).alias("fix"))


def advice(settings: DataFrame, allowed: Column | None = None, own: tuple[str, ...] = ()) -> DataFrame:
    """kind, pos, detail: what to do about settings (key, status, secret): those that need a restart, that are unset, secrets that are,
    and, where nothing is allowed, the permissions. Names are listed in order; keys of `own` have an issue already."""
    kind = (
        F.when(F.col("status") == "restart_needed", F.struct(F.lit("restart_needed").alias("kind"), F.lit(0).alias("pos")))
        .when((F.col("status") == "unset") & ~F.col("secret") & ~F.col("key").isin(*own), F.struct(F.lit("env_unset").alias("kind"), F.lit(1).alias("pos")))
        .when((F.col("status") == "unset") & F.col("secret"), F.struct(F.lit("env_secret_unset").alias("kind"), F.lit(2).alias("pos")))
    )
    by = settings.withColumn("_k", kind).where("_k is not null").groupBy("_k.kind", "_k.pos").agg(F.array_join(F.sort_array(F.collect_set("key")), ", ").alias("detail"))  # a set-up's keys
    if allowed is None:
        return by
    one = settings.agg(F.bool_or(allowed).alias("_any")).where("not coalesce(_any, false)")
    return by.unionByName(one.select(F.lit("permissions_unset").alias("kind"), F.lit(3).alias("pos"), F.lit("").alias("detail")))


#: Files and lines of a step from which on it should be split (fixed values).
STEP_FILES, STEP_LINES = 10, 500


def oversized(steps: DataFrame, files: int = STEP_FILES, lines: int = STEP_LINES) -> DataFrame:
    """Steps (files, lines, any more) that are over a limit."""
    return steps.where((F.col("files") > files) | (F.col("lines") > lines))


def pack_problems(packs: DataFrame, files: DataFrame, required: tuple[str, ...], references: tuple[str, ...], key: str) -> DataFrame:
    """id, problem: of packs (id, doc: JSON, in a folder named by the id) and their files (id, name): no JSON, a required key that
    isn't there, an own id (under key) that is another, and a file that a key refers to and that isn't there."""
    v = F.try_parse_json("doc")
    keys = F.coalesce(F.json_object_keys("doc"), F.expr("cast(array() as array<string>)"))
    own = F.get_json_object("doc", f"$.{key}")
    checks = [F.when(v.isNull(), F.lit("invalid JSON")), *(F.when(v.isNotNull() & ~F.array_contains(keys, k), F.lit(f"missing key {k}")) for k in required)]
    checks.append(F.when(own.isNotNull() & (own != F.col("id")), F.concat(F.lit(f"{key} "), own, F.lit(" is not the folder"))))
    found = packs.select("id", F.explode(F.array_compact(F.array(*checks))).alias("problem"))
    named = F.array(*(F.struct(F.lit(r).alias("ref"), F.get_json_object("doc", f"$.{r}").alias("name")) for r in references))
    lost = packs.select("id", F.explode(named).alias("r")).select("id", "r.ref", "r.name").where("name <> ''").join(files.select("id", "name").distinct(), ["id", "name"], "left_anti")
    return found.unionByName(lost.select("id", F.concat("ref", F.lit(" -> "), "name", F.lit(" not found")).alias("problem")))


def red_then_green(runs: DataFrame) -> DataFrame:
    """Per test (test, role, outcome, body): it failed at base, passes at head, and its body is unchanged."""
    at = lambda role, c: F.max(F.when(F.col("role") == role, F.col(c)))
    by = runs.groupBy("test").agg(at("base", "outcome").alias("_b"), at("head", "outcome").alias("_h"), at("base", "body").alias("_x"), at("head", "body").alias("_y"))
    return by.select("test", F.coalesce((F.col("_b") == "FAIL") & (F.col("_h") == "PASS") & (F.col("_x") == F.col("_y")), F.lit(False)).alias("consistent"))


def overall_verdict(stages: DataFrame, keys: list[str]) -> DataFrame:
    """accepted if all statuses are PASS, WARN or SKIPPED; careful if any is WARN or the run was degraded."""
    return stages.groupBy(*keys).agg(F.every(F.col("status").isin("PASS", "WARN", "SKIPPED")).alias("accepted"), F.some((F.col("status") == "WARN") | F.col("degraded")).alias("careful"))


def squash_lines(steps: Column, most: int = 10) -> Column:
    """All steps up to `most`, else the first three and how many more."""
    return F.when(F.size(steps) <= most, F.array_join(steps, "; ")).otherwise(F.concat(F.array_join(F.slice(steps, 1, 3), "; "), F.lit("; and "), F.size(steps) - 3, F.lit(" more")))


#: A git command at the start or after a separator, and the rules for one, the first that matches wins (fixed values):
#: verdict, whether it holds for pushes only, pattern.
GIT = r"(^|[;&|])\s*git(\s|$)"
PUSH = r"\bgit\b[^;&|]*\bpush\b"
COMMIT, ELSEWHERE = r"\bgit\b[^;&|]*\bcommit\b", r"\bgit\s+-C\b"
GIT_RULES = (
    ("deny", True, r"(--force(?!-with-lease)\b|(^|\s)-f(\s|$))"),
    ("deny", True, r"\bpush\b[^;&|]*(?:\s|:)(?:main|master)(?:\s|:|$)"),
    ("ask", False, r"\breset\b[^;&|]*--hard"),
    ("ask", False, r"\bclean\b\s+-[a-z]*f"),
    ("ask", False, r"\bbranch\b[^;&|]*\s-D\b"),
    ("ask", True, r"(--tags\b|\btag\b)"),
)


def command_rule(command: Column, branch: Column | None = None, auto_merge: Column | None = None) -> Column:
    """deny, ask or allow of a shell command: the first rule that matches.

    branch: the one checked out, null if unknown; commits on main or master are denied, unless -C names another folder.
    auto_merge: whether tags may be pushed unasked. Commands without git, and null, are allowed.
    """
    has = lambda p: F.rlike(command, F.lit(p))
    on_protected = F.coalesce(F.lit(None) if branch is None else branch, F.lit("")).isin("main", "master") & has(COMMIT) & ~has(ELSEWHERE)
    out = F.when(~has(GIT), "allow")
    for k, (answer, push_only, pattern) in enumerate(GIT_RULES):
        if k == 2:
            out = out.when(on_protected, "deny")
        hit = has(pattern) & has(PUSH) if push_only else has(pattern)
        out = out.when(hit & ~F.coalesce(auto_merge, F.lit(False)) if k == len(GIT_RULES) - 1 and auto_merge is not None else hit, answer)
    return out.otherwise("allow")


def refresh(indexed: DataFrame, current: DataFrame) -> DataFrame:
    """path, change (added, changed, removed) between two tables of path and hash."""
    i, c = indexed.select("path", F.col("hash").alias("_i")), current.select("path", F.col("hash").alias("_c"))
    change = F.when(F.col("_i").isNull(), "added").when(F.col("_c").isNull(), "removed").when(F.col("_i") != F.col("_c"), "changed")
    return i.join(c, "path", "full").select("path", change.alias("change")).where("change is not null")


def error_envelope(code: Column, message: Column) -> Column:
    """struct<error, message, recoverable>: only a failed login can't be recovered from."""
    return F.struct(code.alias("error"), message.alias("message"), (code != "AUTH_FAILED").alias("recoverable"))


def step_progress(events: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Per step: when it started first and was completed last, and its commits, each once and sorted; with an order, also its
    status and last checkpoint, which completion clears (events: kind, at, commit, checkpoint)."""
    more = []
    if order:
        at = F.struct(*order)
        told = F.col("checkpoint").isNotNull() | (F.col("kind") == "completed")
        more = [F.max_by("kind", at).alias("status"), F.max_by("checkpoint", F.when(told, at)).alias("checkpoint")]
    return events.groupBy(*keys).agg(
        F.min(F.when(F.col("kind") == "started", F.col("at"))).alias("started"), F.max(F.when(F.col("kind") == "completed", F.col("at"))).alias("completed"),
        F.array_join(F.sort_array(F.collect_set("commit")), ",").alias("commits"), *more,
    )


def missing_states(existing: DataFrame, matrix: DataFrame, keys: list[str]) -> DataFrame:
    """Existing states unchanged, and a pending one for every other cell of the matrix."""
    return existing.select(*keys, "status").unionByName(matrix.join(existing, keys, "left_anti").select(*keys, F.lit("pending").alias("status")))


def timeline(sources: list[tuple[str, DataFrame]], ts: str, limit: int | None = None) -> DataFrame:
    """Events of all nodes with their node and place in time."""
    every = None
    for node, df in sources:
        one = df.withColumn("node", F.lit(node))
        every = one if every is None else every.unionByName(one)
    return every.orderBy(ts) if limit is None else every.orderBy(ts).limit(limit)


def run_order(stages: DataFrame, by: list[str]) -> DataFrame:
    """Stages whose predicate holds, numbered anew in their order; the others are skipped, not failed."""
    w = Window.partitionBy(*by).orderBy("pos")
    return stages.withColumn("status", F.when(F.col("run_when"), "RUN").otherwise("SKIPPED")).withColumn("turn", F.when(F.col("run_when"), F.sum(F.col("run_when").cast("int")).over(w)))
