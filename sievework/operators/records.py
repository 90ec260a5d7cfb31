"""Issues, workspaces, runs and set-up as records: normalised, filtered, numbered and looked up."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievework.functions.yaml_text import yaml_to_json

#: States of a pipeline that count as passed, failed, and as ended (fixed values).
PASSED, FAILED, ENDED = ("EVALUATION_PASS", "COMPLETED", "COMPLETION"), ("EVALUATION_FAIL", "BLOCKED"), ("COMPLETED", "COMPLETION")


def normal_issue(raw: DataFrame) -> DataFrame:
    """Issues (key, fields) as flat columns: missing types and statuses are Unknown, categories unknown, assignees and labels empty.

    Only the fields named here are read, so a wider record is pruned at its scan. fields.description is a tree as JSON.
    """
    from sievework.operators.parsing import tree_to_markdown

    f = lambda path: F.col(f"fields.{path}")
    return raw.select(
        F.col("key").alias("ticket_id"), F.coalesce(f("issuetype.name"), F.lit("Unknown")).alias("type"), f("summary").alias("summary"), tree_to_markdown(f("description")).alias("description"),
        F.coalesce(f("assignee.displayName"), F.lit("")).alias("assignee"), F.coalesce(f("status.name"), F.lit("Unknown")).alias("status"), F.coalesce(f("status.statusCategory.key"), F.lit("unknown")).alias("status_category"),
        F.coalesce(f("labels"), F.expr("cast(array() as array<string>)")).alias("labels"), f("created").alias("created"), f("updated").alias("updated"),
    )


def author_name(author: Column) -> Column:
    """displayName of an author; Unknown without one."""
    return F.when(author.isNull(), "Unknown").otherwise(author["displayName"])


def since(comments: DataFrame, created: str, start: Column) -> DataFrame:
    """Comments whose time, as text, isn't before start, as text; all where start is empty."""
    return comments.where((start == "") | (F.col(created) >= start))


def search(issues: DataFrame, condition: Column, order: list[Column], limit: int = 50) -> DataFrame:
    """The first `limit` issues that a condition holds for."""
    return issues.where(condition).orderBy(*order).limit(limit)


def retried(attempts: DataFrame, key: str, order: list[Column], status: Column, most: int = 3) -> DataFrame:
    """key, outcome, attempts, waited_s of requests by their attempts in order: 429 and null (no reply) are tried again, up to
    `most` times, after 1, 2, 4, ... seconds; 401 and 404 end with their own errors, others under 400 well."""
    tried = attempts.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("n"), status.alias("status")).where(F.col("n") <= most)
    again = F.col("status").isNull() | (F.col("status") == 429)
    ends = tried.groupBy(key).agg(F.min(F.when(~again, F.struct("n", "status"))).alias("end"), F.max("n").alias("last"))
    outcome = (
        F.when(F.col("end").isNull(), F.when(F.col("last") >= most, "exhausted").otherwise("open")).when(F.col("end.status") == 401, "unauthorized").when(F.col("end.status") == 404, "not_found")
        .when(F.col("end.status") < 400, "ok").otherwise("failed")
    )
    n = F.coalesce("end.n", "last")
    return ends.select(key, outcome.alias("outcome"), n.alias("attempts"), (F.pow(F.lit(2.0), n - 1) - 1).alias("waited_s"))


def outcome_of(state: Column) -> Column:
    """Whether a run passed, by the state it is in; null before it was judged."""
    return F.when(state.isin(*PASSED), True).when(state.isin(*FAILED), False)


def active(workspaces: DataFrame, state: str, newest: list[Column], most: int = 5) -> DataFrame:
    """The newest `most` workspaces whose state isn't empty and hasn't ended."""
    return workspaces.where((F.col(state) != "") & ~F.col(state).isin(*ENDED)).orderBy(*newest).limit(most)


def to_continue(workspaces: DataFrame, now: Column, stale_s: int = 3600, again: Column | None = None) -> DataFrame:
    """The newest workspace (ticket, state, mode, cycle, max_cycles, touched) that should go on by itself: fresh, open, in mode
    auto and within its cycles; no cycle counts as the first, no bound as three. again: whether this stop was held up once
    already, after which it is let through."""
    fresh = F.timestamp_diff("SECOND", F.col("touched"), now) <= stale_s
    within = F.coalesce(F.nullif("cycle", F.lit(0)), F.lit(1)) <= F.coalesce(F.nullif("max_cycles", F.lit(0)), F.lit(3))
    open_ = (F.col("state") != "") & ~F.col("state").isin(*ENDED, "BLOCKED")
    first = F.lit(True) if again is None else ~F.coalesce(again, F.lit(False))
    return workspaces.where(first & fresh & open_ & (F.col("mode") == "auto") & within).orderBy(F.col("touched").desc(), "ticket").limit(1)


def next_number(keys: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """How many there are of each key, and one more."""
    n = existing.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return keys.select(key).join(n, key, "left").select(key, (F.coalesce("n", F.lit(0)) + 1).alias("number"))


def last_activity(spans: Column, fields: tuple[str, ...]) -> Column:
    """The latest of some fields of an array of structs, nulls aside."""
    return F.array_max(F.flatten(F.transform(spans, lambda s: F.array(*(s[f] for f in fields)))))


def first_count(*counts: Column) -> Column:
    """The first count that is neither null nor 0; else 0."""
    return F.coalesce(*(F.nullif(c, F.lit(0)) for c in counts), F.lit(0))


def iso_time(text: Column) -> Column:
    """ISO 8601 text, with Z or an offset, as a timestamp; null for anything else."""
    return F.when(F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)?)?$")), text.try_cast("timestamp"))


def identifiers(text: Column, stopwords: tuple[str, ...], most: int = 6) -> Column:
    """The first `most` different identifiers of three or more characters; stopwords in any case are left out."""
    found = F.regexp_extract_all(text, F.lit("([A-Za-z_][A-Za-z0-9_]{2,})"), F.lit(1))
    return F.slice(F.array_distinct(F.filter(found, lambda t: ~F.lower(t).isin(*stopwords))), 1, most)


#: A name that tells of a secret, assigned a literal of 16 or more characters.
SECRET_LITERAL = r"""(?i)\b([A-Za-z_]*(?:secret|password|token|key|credential)[A-Za-z_0-9]*)\s*(?::=|[:=])\s*["']([^"'\n]{16,})["']"""


def secret_literals(diff: Column) -> Column:
    """Names, in order, that added lines of a diff assign a long literal to and that tell of a secret; headings of files don't count."""
    added = F.filter(F.split(diff, "\n"), lambda x: F.startswith(x, F.lit("+")) & ~F.startswith(x, F.lit("+++ ")))
    return F.flatten(F.transform(added, lambda x: F.regexp_extract_all(x, F.lit(SECRET_LITERAL), F.lit(1))))


def failure_summary(failures: DataFrame, key: str, by: tuple[str, ...]) -> DataFrame:
    """key, total, and for each column of `by` a map of its values to their counts."""
    out = failures.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    for c in by:
        counts = failures.groupBy(key, c).agg(F.count(F.lit(1)).alias("n"))  # values are few
        out = out.join(counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}")), key)
    return out


def first_seen(rows: DataFrame, value: str, pos: str) -> DataFrame:
    """Different values in order of their first place, numbered from 1."""
    first = rows.groupBy(value).agg(F.min(pos).alias("first"))
    return first.withColumn("place", F.row_number().over(Window.orderBy("first")).cast("long"))  # one row a value: they are few


def detected(candidates: DataFrame, existing: DataFrame) -> DataFrame:
    """key, path: of each key's candidates (key, priority, path) the first that exists."""
    found = candidates.join(existing.select("path").distinct(), "path", "left_semi")
    return found.groupBy("key").agg(F.min_by("path", "priority").alias("path"))


def allow_merged(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """entry, added: all entries once; those only in wanted are added."""
    old = existing.select("entry").distinct()
    return old.withColumn("added", F.lit(False)).unionByName(wanted.select("entry").distinct().join(old, "entry", "left_anti").withColumn("added", F.lit(True)))


def project_of(override: Column, packs: Column, name: Column, remote: Column) -> Column:
    """The override, else the only pack, else the first pack whose name is part of the repository's name or remote; null without."""
    part = F.filter(F.array_sort(packs), lambda p: (p != "") & (F.contains(F.coalesce(name, F.lit("")), p) | F.contains(F.coalesce(remote, F.lit("")), p)))
    return F.coalesce(F.nullif(override, F.lit("")), F.when(F.size(packs) == 1, packs[0]), F.get(part, F.lit(0)))


def readiness(issues: Column, restarts: Column) -> Column:
    return F.when((issues == 0) & (restarts == 0), "READY").otherwise("NOT_READY")


def impact_seeds(symbols: Column, most: int = 3) -> Column:
    """The first `most` different symbols that aren't empty."""
    return F.slice(F.array_distinct(F.filter(symbols, lambda s: F.coalesce(s, F.lit("")) != "")), 1, most)


def carried_health(status: Column, missing: Column) -> Column:
    """struct<status, serviceable, degraded, missing, widen> that later stages get: degraded or incomplete retrieval widens their checks."""
    serviceable = status.isin("ok", "degraded")
    degraded = (status == "degraded") | (F.size(missing) > 0)
    return F.struct(status.alias("status"), serviceable.alias("serviceable"), degraded.alias("degraded"), F.array_sort(missing).alias("missing"), (~serviceable | degraded).alias("widen"))


def with_identity(results: DataFrame, snapshots: DataFrame, run: str, ts: str) -> DataFrame:
    """Results with the identity of the index they were made with: their run's last snapshot; null without one."""
    kept = [c for c in snapshots.columns if c not in (run, ts)]
    last = snapshots.groupBy(run).agg(F.max_by(F.struct(*kept), F.struct(ts, *kept)).alias("identity"))
    return results.join(last, run, "left")


def autonomy(source: Column) -> Column:
    """struct<mode, on_failure>: a local ticket runs by itself and escalates, any other is interactive and halts."""
    local = source == "local"
    return F.struct(F.when(local, "auto").otherwise("interactive").alias("mode"), F.when(local, "escalate").otherwise("halt").alias("on_failure"))


def processes_to_end(matching: DataFrame, before: DataFrame, own: DataFrame) -> DataFrame:
    """Processes that match, but for those that were there before and one's own."""
    return matching.select("pid").distinct().join(before.select("pid"), "pid", "left_anti").join(own.select("pid"), "pid", "left_anti")


def selected(items: DataFrame, ids: tuple = (), buckets: tuple = ()) -> DataFrame:
    """Items whose id and bucket are named; an empty list names all."""
    out = items.where(F.col("id").isin(*ids)) if ids else items
    return out.where(F.col("bucket").isin(*buckets)) if buckets else out


def with_question(cells: DataFrame, questions: DataFrame) -> DataFrame:
    """Cells with their question's columns; status failed and an error where it isn't in the index."""
    known = questions.withColumn("_known", F.lit(True))
    j = cells.join(known, "question_id", "left")
    lost = F.col("_known").isNull()
    return j.withColumn("status", F.when(lost, "failed").otherwise(F.col("status"))).withColumn("error", F.when(lost, F.concat(F.lit("question "), F.col("question_id").cast("string"), F.lit(" not in index")))).drop("_known")


def logged_to(commits: DataFrame, workspaces: DataFrame, touched: str) -> DataFrame:
    """commit_id, ticket, workspace: each commit (commit_id, ticket) goes to the newest workspace (ticket, workspace, state) of its
    ticket, one without any to every workspace that has a state, and to none if there is none.

    Those copies are what the log holds; a repository's workspaces are few. Commits and workspaces meet by ticket otherwise.
    """
    last = workspaces.groupBy("ticket").agg(F.max_by("workspace", F.struct(touched, "workspace")).alias("workspace"))
    own = commits.join(last, "ticket", "left").select("commit_id", "ticket", "workspace")
    live = workspaces.where(F.coalesce("state", F.lit("")) != "").agg(F.array_sort(F.collect_set("workspace")).alias("_all"))
    lost = own.where("workspace is null").drop("workspace").join(live, F.lit(True))
    return own.where("workspace is not null").unionByName(lost.select("commit_id", "ticket", F.explode("_all").alias("workspace")))


#: What a prompt without a recording gets where that is no error (fixed values).
PLACEHOLDER, PLACEHOLDER_TOKENS = '{"answer": "REPLAY_PLACEHOLDER", "citations": []}', (100, 20)


def replayed(prompts: DataFrame, fixtures: DataFrame, index: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """Prompts (id, system, user) with the recorded response, input_tokens and output_tokens, and an error.

    fixtures: name, response, input_tokens, output_tokens; index: key, name. By the key of both texts, the recording is the one that
    the index names, if it is there, else the one named by the key's first 16 digits, else by all of it. A miss is an error,
    or a placeholder where not strict.
    """
    from sievework.sources.readers import replay_key

    p = prompts.withColumn("_key", replay_key(F.col("system"), F.col("user")))
    named = p.withColumn("_name", F.lit(None).cast("string")) if index is None else p.join(index.groupBy(F.col("key").alias("_key")).agg(F.min("name").alias("_name")), "_key", "left")
    tries = F.array(F.col("_name"), F.substring("_key", 1, 16), F.col("_key"))
    answer = F.struct("response", "input_tokens", "output_tokens")
    by = fixtures.groupBy(F.col("name").alias("_tried")).agg(F.min(answer).alias("_answer"))
    hits = named.select("id", "_key", F.posexplode(tries).alias("_at", "_tried")).join(by, "_tried").groupBy("id", "_key").agg(F.min_by("_answer", "_at").alias("_answer"))
    j = named.join(hits, ["id", "_key"], "left")
    lost = F.col("_answer").isNull()
    fill = lambda c, v: F.when(lost, F.lit(None if strict else v)).otherwise(F.col("_answer")[c]).alias(c)
    miss = F.when(lost & F.lit(strict), F.concat(F.lit("no recorded answer for "), F.substring("_key", 1, 16))).alias("error")
    return j.select("id", fill("response", PLACEHOLDER), fill("input_tokens", PLACEHOLDER_TOKENS[0]), fill("output_tokens", PLACEHOLDER_TOKENS[1]), miss)


#: A fenced YAML block (fixed value).
FENCE = re.compile(r"```ya?ml\s*\n(.*?)\n```", re.DOTALL)


def yaml_blocks(text: Column) -> Column:
    """Fenced YAML blocks that are mappings, in order, as JSON; those that can't be read don't count.

    No SQL function reads YAML, so this runs in Arrow batches.
    """

    @F.pandas_udf("array<string>")
    def fenced(texts: pd.Series) -> pd.Series:
        return pd.Series([[j for m in FENCE.finditer(t or "") if (j := yaml_to_json(m[1])) and j[0] == "{"] for t in texts])

    return fenced(text)


def contract_block(blocks: Column, lists: tuple[str, ...], keys: tuple[str, ...] = ()) -> Column:
    """The first of an array of blocks with a list under one of `lists`, or with one of `keys`, at its top level; null without one."""

    def test(b: Column) -> Column:
        own = F.json_object_keys(b)
        a_list = [F.coalesce(F.startswith(F.get_json_object(b, f"$.{k}"), F.lit("[")) & F.try_variant_get(F.try_parse_json(b), f"$.{k}", "array<variant>").isNotNull(), F.lit(False)) for k in lists]
        there = [F.array_contains(own, k) for k in keys]
        return reduce(lambda x, y: x | y, [*a_list, *there])

    return F.get(F.filter(blocks, test), F.lit(0))


def plan_markdown(title: Column, steps: Column) -> Column:
    """A plan as markdown: a heading for each step, and the contract as a fenced YAML block."""
    heads = F.array_join(F.transform(steps, lambda s, i: F.concat(F.lit("## Step "), (i + 1).cast("string"), F.lit(": "), s)), "\n")
    items = F.array_join(F.transform(steps, lambda s: F.concat(F.lit("  - "), s)), "\n")
    return F.concat(F.lit("# "), title, F.lit("\n\n"), heads, F.lit("\n\n```yaml\nsteps:\n"), items, F.lit("\n```\n"))
