"""Scan, redact and merge: sensitive spans of texts, by a policy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievework.functions.detectors import TOKEN, Detector, Policy, jvm_regex
from sievework.functions.text import shannon_entropy

_OPEN, _SHUT = "\u0001", "\u0002"
#: What separates the tokens of the entropy detector.
_GAP = jvm_regex(TOKEN).replace("[^", "[", 1)
#: How many items arrays are worked on at a time; even, so that every second piece of a block is a match.
BLOCK = 256
SPAN = "struct<pattern_id: string, action: string, first: int, last: int>"


def worth_searching(text: Column, low: Column, d: Detector) -> Column:
    """Whether a text may have a match: one of the rule's hints, or a letter that folds to ASCII and that lower() leaves alone."""
    if not d.hints:
        return F.lit(True)
    out = F.contains(text, F.lit("\u017f")) | F.contains(text, F.lit("\u212a"))
    for h in d.hints:
        out = F.contains(low, F.lit(h)) | out
    return out


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(values: Column) -> Column:
    """The values in arrays of BLOCK, in order; one empty array if there are none."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(values) - 1, F.lit(0)) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK)))


def _running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of the integers, what add makes of those before it, from 0. An append copies an array, so it goes by blocks."""

    def fold(xs: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(xs, first, lambda acc, v: F.struct(add(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    of = lambda blocks: F.flatten(F.zip_with(blocks, fold(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), add)), F.lit(0)), fold))
    return _let(values, lambda v: _let(_blocks(v), of))


def _mark(text: Column) -> Column:
    """What sets matches off: a run of a control character, longer than any in the text."""
    longest = F.aggregate(F.regexp_extract_all(text, F.lit(f"({_OPEN}+)"), F.lit(1)), F.lit(0), lambda n, x: F.greatest(n, F.length(x)))
    return F.when(F.contains(text, F.lit(_OPEN)), F.concat(F.lit(_SHUT), F.repeat(F.lit(_OPEN), longest + 1), F.lit(_SHUT))).otherwise(F.lit(_OPEN))


def _secret(t: Column, d: Detector) -> Column:
    """Whether a token is a finding of the entropy detector."""
    fits = F.octet_length(t).between(d.min_length, d.max_length)
    for x in d.exclude_patterns:
        fits = fits & ~F.rlike(t, F.lit(jvm_regex(x)))
    return fits & (shannon_entropy(t) >= d.threshold)


def _long_tokens(text: Column, d: Detector) -> Column:
    return F.filter(F.split(text, _GAP), lambda t: F.octet_length(t) >= d.min_length)


def _pieces(text: Column, low: Column, mark: Column, d: Detector) -> Column:
    """The text cut around a rule's leftmost matches, so that every second piece is one; empty if there are none.

    Matches are set off by the mark in the whole text, which lookarounds see, and the text is split there.
    """
    if d.type == "entropy":
        # every byte length within bounds needs a quarter as many code points at least; only whole tokens match
        one = jvm_regex(TOKEN).removesuffix("+")
        pattern = f"(?<!{one}){one}{{{-(-d.min_length // 4)},{d.max_length}}}+(?!{one})"
        some = F.exists(_long_tokens(text, d), lambda t: _secret(t, d))  # places are worked out only where some token is a finding
    else:
        pattern = jvm_regex(d.regex)
        some = worth_searching(text, low, d) & F.rlike(text, F.lit(pattern))
    return F.when(some, F.split(F.regexp_replace(text, F.lit(pattern), F.concat(mark, F.lit("$0"), mark)), mark)).otherwise(F.expr("cast(array() as array<string>)"))


def scan(text: Column, policy: Policy, low: Column | None = None) -> Column:
    """array<SPAN>: of each rule in order, all its matches in order, in code points, ends exclusive.

    low: the text in lower case, where it is at hand.
    """
    low = F.lower(text) if low is None else low

    tokens = [d for d in policy.detectors if d.type == "entropy"]

    def found(r: Column, piece: Column) -> Column:
        out = F.lit(True)
        for d in tokens:
            out = F.when(r["pattern_id"] == d.id, _secret(piece, d)).otherwise(out)
        return out

    none = F.expr("cast(array() as array<struct<first: int, last: int>>)")
    size = lambda n, p: n + F.length(p)

    def placed(r: Column) -> Column:
        def step(acc: Column, p: Column) -> Column:
            end = acc["at"] + F.length(p)
            out = F.when(acc["inside"] & found(r, p), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("first"), end.alias("last"))))).otherwise(acc["out"])
            return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), out.alias("out"))

        def block(b: Column, at: Column) -> Column:
            return F.aggregate(b, F.struct(at.alias("at"), F.lit(False).alias("inside"), none.alias("out")), step, lambda acc: acc["out"])

        of = lambda blocks: F.flatten(F.zip_with(blocks, _running(F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), size)), lambda n, v: n + v), block))
        return F.transform(_let(_blocks(r["pieces"]), of), lambda m: F.struct(r["pattern_id"].alias("pattern_id"), r["action"].alias("action"), m["first"].alias("first"), m["last"].alias("last")))

    def rules(mark: Column) -> Column:
        return F.array(*(F.struct(F.lit(d.id).alias("pattern_id"), F.lit(d.action).alias("action"), _pieces(text, low, mark, d).alias("pieces")) for d in policy.detectors))

    hit = F.filter(_let(_mark(text), rules), lambda r: F.size(r["pieces"]) > 0)
    return F.flatten(F.transform(hit, placed))


def outer_wins(spans: Column) -> Column:
    """Longest first, then leftmost; those that overlap one already kept are left out. Ordered by start.

    Spans that don't overlap at all, the usual case, are just sorted. Others fall into clusters that no span leads out
    of, and only spans of a cluster are held against each other.
    """
    plain = lambda a: F.array_sort(F.transform(a, lambda k: F.struct(k["first"].alias("first"), k["last"].alias("last"), k["pattern_id"].alias("pattern_id"))))
    empty = F.expr("cast(array() as array<struct<cluster: int, neg: int, first: int, last: int, pattern_id: string>>)")

    def step(acc: Column, s: Column) -> Column:
        rivals = F.when(acc["cluster"] == s["cluster"], acc["kept"]).otherwise(empty)
        lost = F.exists(rivals, lambda k: (s["first"] < k["last"]) & (s["last"] > k["first"]))
        more = lambda a: F.when(lost, a).otherwise(F.concat(a, F.array(s)))
        return F.struct(s["cluster"].alias("cluster"), more(rivals).alias("kept"), more(acc["out"]).alias("out"))

    def kept(by_start: Column) -> Column:
        reach = _running(F.transform(by_start, lambda s: s["last"]), lambda n, v: F.greatest(n, v))
        fresh = F.zip_with(by_start, reach, lambda s, r: (s["first"] >= r).cast("int"))
        # a cluster's number: how many have begun, its own included
        number = _let(fresh, lambda f: F.zip_with(_running(f, lambda n, v: n + v), f, lambda n, v: n + v))
        ranked = F.array_sort(F.zip_with(by_start, number, lambda s, n: F.struct(n.alias("cluster"), (s["first"] - s["last"]).alias("neg"), s["first"].alias("first"), s["last"].alias("last"), s["pattern_id"].alias("pattern_id"))))
        return plain(F.aggregate(ranked, F.struct(F.lit(0).alias("cluster"), empty.alias("kept"), empty.alias("out")), step, lambda acc: acc["out"]))

    def chosen(by_start: Column) -> Column:
        more = F.greatest(F.size(by_start) - 1, F.lit(0))
        meet = F.exists(F.zip_with(F.slice(by_start, F.lit(1), more), F.slice(by_start, F.lit(2), more), lambda a, b: b["first"] < a["last"]), lambda x: x)
        return F.when(meet, kept(by_start)).otherwise(by_start)

    return _let(plain(spans), chosen)


def redact(text: Column, spans: Column, policy: Policy) -> Column:
    """The text with each kept span replaced by the policy's marker.

    A substring is found by walking from the start of its string, so each block of spans first cuts out its own part of the text.
    """
    before, after = policy.replacement.split("{pattern_id}")
    mark = lambda s: F.concat(F.lit(before), s["pattern_id"], F.lit(after))

    def cut(block: Column, begin: Column) -> Column:
        part = F.substring(text, begin + 1, F.element_at(block, -1)["last"] - begin)
        since = lambda i: F.when(i == 0, begin).otherwise(F.get(block, i - 1)["last"])
        return _let(part, lambda p: F.array_join(F.transform(block, lambda s, i: F.concat(F.substring(p, since(i) - begin + 1, s["first"] - since(i)), mark(s))), ""))

    def done(kept: Column) -> Column:
        begin = lambda b: F.when(b == 0, 0).otherwise(F.get(kept, b * BLOCK - 1)["last"])
        parts = F.transform(_blocks(kept), lambda block, b: cut(block, begin(b)))
        return F.concat(F.array_join(parts, ""), F.substring(text, F.element_at(kept, -1)["last"] + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(outer_wins(spans), done))


def scan_counts(df: DataFrame, text_col: str, policy: Policy | None = None) -> DataFrame:
    """df with scan_result and redacted_count as scan_and_filter has them, without looking for places or redacting."""
    policy = policy or Policy()
    text, low = F.coalesce(F.col(text_col), F.lit("")), F.col("_low")

    def n(d: Detector) -> Column:
        if d.type == "entropy":
            return F.size(F.filter(_long_tokens(text, d), lambda t: _secret(t, d)))
        return F.when(worth_searching(text, low, d), F.regexp_count(text, F.lit(jvm_regex(d.regex)))).otherwise(0)

    blocked, redacted = F.octet_length(text) > policy.max_scan_bytes, F.lit(0)
    for d in policy.detectors:
        if d.action == "block":
            blocked = blocked | (n(d) > 0)
        elif d.action == "redact":
            redacted = redacted + n(d)
    step = df.withColumn("_low", F.lower(text)).withColumn("_n", F.when(blocked, -1).otherwise(redacted))
    result = F.when(F.col("_n") < 0, "BLOCKED").when(F.col("_n") > 0, "REDACTED").otherwise("CLEAN")
    return step.select(*(F.col(f"`{c}`") for c in df.columns), result.alias("scan_result"), F.greatest("_n", F.lit(0)).cast("long").alias("redacted_count"))


def scan_and_filter(df: DataFrame, text_col: str, policy: Policy | None = None) -> DataFrame:
    """df with scan_result, filtered_text, redacted_count, redacted_patterns, blocked_patterns, warnings.

    A text over the policy's byte limit, or with a blocking span, is BLOCKED and its text is empty. redacted_count
    counts all redacting spans, overlapping ones too. Pattern lists are in order of first match. Null is empty.
    """
    policy = policy or Policy()
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text)
    none = F.expr("cast(array() as array<string>)")
    over = size > policy.max_scan_bytes
    spans = F.when(over, F.expr(f"cast(array() as array<{SPAN}>)")).otherwise(scan(text, policy, F.col("_low")))
    ids = lambda action: F.array_distinct(F.transform(F.filter("_spans", lambda s: s["action"] == action), lambda s: s["pattern_id"]))
    step = df.withColumn("_low", F.lower(text)).withColumn("_spans", spans).withColumn("_blocked", F.when(over, F.array(F.concat(F.lit("payload_too_large:"), size.cast("string")))).otherwise(ids("block")))
    step = step.withColumn("_redact", F.filter("_spans", lambda s: s["action"] == "redact"))
    blocked = F.size("_blocked") > 0
    return step.select(
        *(F.col(f"`{c}`") for c in df.columns),
        F.when(blocked, "BLOCKED").when(F.size("_redact") > 0, "REDACTED").otherwise("CLEAN").alias("scan_result"),
        F.when(blocked, "").otherwise(redact(text, F.col("_redact"), policy)).alias("filtered_text"),
        F.when(blocked, 0).otherwise(F.size("_redact")).cast("long").alias("redacted_count"),
        F.when(blocked, none).otherwise(ids("redact")).alias("redacted_patterns"),
        F.col("_blocked").alias("blocked_patterns"),
        F.when(blocked, none).otherwise(F.transform(ids("warn"), lambda i: F.concat(F.lit("warn:"), i))).alias("warnings"),
    )


def merge_metadata(filtered: DataFrame, *keys: str, order: Column | None = None, **sums: Column) -> DataFrame:
    """Worst result, sum of counts, and unions of the pattern lists in order of first appearance, by keys; sums are added up beside them.

    order: what rows of a key are ordered by; without it lists are sorted. All in one pass: texts are scanned once.
    """
    rank = F.when(F.col("scan_result") == "BLOCKED", 2).when(F.col("scan_result") == "REDACTED", 1).otherwise(0)
    lists = ("redacted_patterns", "blocked_patterns", "warnings")
    spot = "struct<list: string, name: string, pos: int>"
    placed = lambda c: F.transform(c, lambda x, i: F.struct(F.lit(c).alias("list"), x.alias("name"), i.alias("pos")))
    # a row itself, without a name, then the names of its lists
    each = F.explode(F.concat(F.array(F.lit(None).cast(spot)), F.flatten(F.array(*map(placed, lists))))).alias("_e")
    at = (F.lit(0) if order is None else order).alias("_at")
    rows = filtered.select(*keys, at, rank.alias("_rank"), "redacted_count", *(c.alias(n) for n, c in sums.items()), each).select("*", F.col("_e.list").alias("_list"), F.col("_e.name").alias("_name"), F.col("_e.pos").alias("_pos"))
    own = lambda c: F.sum(F.when(F.col("_e").isNull(), F.col(c))).alias(c)
    pos = F.col("_pos") if order is not None else F.lit(0).alias("_pos")
    # a name's first place is kept of each, so rows shrink to the rules, which are few, before they are shuffled
    first = rows.groupBy(*keys, "_list", "_name").agg(F.max("_rank").alias("_rank"), own("redacted_count"), *map(own, sums), F.min(F.when(F.col("_e").isNotNull(), F.struct("_at", pos))).alias("first"))
    of = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col("_list") == c, F.struct("first", "_name")))), lambda s: s["_name"]).alias(c)
    worst = F.element_at(F.array(*map(F.lit, ("CLEAN", "REDACTED", "BLOCKED"))), F.max("_rank") + 1).alias("scan_result")
    return first.groupBy(*keys).agg(worst, F.sum("redacted_count").alias("redacted_count"), *map(of, lists), *(F.sum(n).alias(n) for n in sums))


#: Whether a row may leave.
MAY_LEAVE = "scan_result <> 'BLOCKED'"


def drop_blocked(filtered: DataFrame) -> DataFrame:
    """Rows that may leave; their metadata is to be merged beforehand, from all rows."""
    return filtered.where(MAY_LEAVE)
