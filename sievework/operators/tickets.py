"""Tickets written after a template: their kind, sections, lists and what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of kinds and of sections, in any case and with any white space (fixed values).
KINDS = {
    "feature": ("feature", "기능", "기능 추가", "new feature", "enhancement"),
    "bugfix": ("bug fix", "bug", "버그", "버그 수정", "fix", "defect"),
    "code_review": ("code review", "review", "코드 리뷰", "리뷰"),
    "release": ("release", "릴리즈", "릴리스", "version", "버전"),
}
SECTIONS = {
    "summary": ("요약", "summary", "overview", "tl;dr"),
    "background": ("배경", "background", "context", "motivation"),
    "requirements": ("요구사항", "requirements", "요구 사항"),
    "scope": ("영향 범위", "scope", "impact", "범위"),
    "acceptance_criteria": ("수용 기준", "acceptance criteria", "ac", "인수 조건"),
    "references": ("참고 자료", "references", "참고", "links"),
    "steps_to_reproduce": ("재현 방법", "steps to reproduce", "재현 단계", "repro"),
    "expected": ("기대 동작", "expected behavior", "expected"),
    "actual": ("실제 동작", "actual behavior", "actual"),
    "review_target": ("리뷰 대상", "review target", "target"),
    "review_criteria": ("리뷰 기준", "review criteria", "criteria"),
    "version": ("버전", "version"),
    "changes": ("포함 변경사항", "changes", "included changes"),
    "checklist": ("릴리즈 체크리스트", "release checklist", "checklist"),
    "severity": ("심각도", "severity"),
}
#: Words that tell of a kind where none is stated; of the first, several must be there.
HINTS = (("bugfix", "fix|bug|에러|버그|수정", 2), ("code_review", "review|리뷰|검토", 1), ("release", r"v1\.|release|릴리즈|태그", 1))
VARIANTS = {"code_review": "review_only", "release": "release"}
#: What each kind needs; of alternatives one is enough (fixed values).
NEEDED = {
    "feature": ("summary", "requirements|background", "scope.modules"),
    "bugfix": ("summary", "steps_to_reproduce", "expected", "actual", "scope.modules"),
    "code_review": ("summary", "review_target.files_or_modules"),
    "release": ("version", "changes"),
}
#: Names of keys in "- key: a, b" lines.
PAIRS = {"modules": ("모듈", "module", "modules"), "expected_files": ("예상변경파일", "expectedfiles", "files"), "severity": ("심각도", "severity")}
STATED = r"(?im)^(?:##[ \t]+(?:작업 유형|work type|타입|type)[ \t]*:|\*\*(?:작업 유형|work type)\*\*[ \t]*:)[ \t]*([^\n]*?)[ \t]*$"


def _plain(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"\s+", ""))


def _lookup(names: dict[str, tuple[str, ...]]) -> Column:
    flat = {n.lower().replace(" ", ""): k for k, ns in names.items() for n in ns}
    return F.create_map(*(F.lit(x) for kv in flat.items() for x in kv))


def _section(part: Column) -> Column:
    """struct<key, body, checklist, bullets, pairs> of a heading and what follows it."""
    head = F.trim(F.regexp_extract(part, r"^([^\n]*)", 1))
    body = F.trim(F.regexp_replace(part, r"^[^\n]*\n?", ""), F.lit(" \t\r\n"))
    boxes = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*[-*][ \t]+\[([ xX])\]"), F.lit(1))
    texts = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*[-*][ \t]+\[[ xX]\][ \t]*([^\n]*?)[ \t\r]*$"), F.lit(1))
    bullets = F.regexp_extract_all(body, F.lit(r"(?m)^[ \t]*[-*][ \t]+(?!\[[ xX]\])([^\n]*?)[ \t\r]*$"), F.lit(1))
    told = F.filter(bullets, lambda b: F.rlike(b, F.lit(r"^[^:\s][^:]*:[ \t]")))
    key = lambda b: _plain(F.regexp_extract(b, "^([^:]*):", 1))
    values = lambda b: F.filter(F.transform(F.split(F.regexp_replace(b, "^[^:]*:", ""), ","), lambda v: F.trim(v)), lambda v: v != "")
    pairs = F.transform(told, lambda b: F.struct(F.coalesce(F.try_element_at(_lookup(PAIRS), key(b)), key(b)).alias("key"), values(b).alias("values")))
    return F.struct(
        F.coalesce(F.try_element_at(_lookup(SECTIONS), _plain(head)), F.lower(head)).alias("key"), body.alias("body"),
        F.zip_with(texts, boxes, lambda t, b: F.struct(t.alias("text"), (F.lower(b) == "x").alias("checked"))).alias("checklist"), bullets.alias("bullets"), pairs.alias("pairs"),
    )


def ticket_sections(text: Column) -> Column:
    """Sections under ## or ### headings, in order: array of struct<key, body, checklist<text, checked>, bullets, pairs<key, values>>.
    key is the section's usual name, else its heading in lower case. What stands before the first heading is none."""
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), "\\n#{2,3}[ \\t]+")
    return F.transform(F.slice(parts, 2, F.size(parts)), _section)


def parsed_tickets(tickets: DataFrame) -> DataFrame:
    """tickets (summary, description, any more) with work_type, stated, pipeline_variant, sections, missing_fields, warnings.

    A stated kind counts if it is known; else words of summary and description tell, several of the first kind, and a ticket
    with neither is a feature if it says anything, or unknown. Fields that are missing are named in order; they stop nothing.
    """
    said = F.regexp_extract(F.coalesce("description", F.lit("")), STATED, 1)
    text = F.lower(F.concat_ws("\n", "summary", "description"))
    guess = F.when(F.trim(text, F.lit(" \t\r\n")) == "", "unknown").otherwise("feature")
    for kind, words, least in reversed(HINTS):
        guess = F.when(F.regexp_count(text, F.lit(words)) >= least, kind).otherwise(guess)
    known = F.try_element_at(_lookup(KINDS), _plain(said))
    t = tickets.withColumn("work_type", F.coalesce(known, guess)).withColumn("stated", known.isNotNull()).withColumn("sections", ticket_sections(F.col("description")))
    variant = F.lit("full")
    for kind, v in VARIANTS.items():
        variant = F.when(F.col("work_type") == kind, v).otherwise(variant)

    def there(field: str) -> Column:
        if "|" in field:
            a, b = field.split("|")
            return there(a) | there(b)
        if "." in field:
            section, key = field.split(".")
            if key == "files_or_modules":  # whatever is listed
                return F.exists("sections", lambda s: (s["key"] == section) & (F.size(s["bullets"]) > 0))
            return F.exists("sections", lambda s: (s["key"] == section) & F.exists(s["pairs"], lambda p: (p["key"] == key) & (F.size(p["values"]) > 0)))
        filled = F.exists("sections", lambda s: (s["key"] == field) & (s["body"] != ""))
        return filled | (F.trim(F.coalesce("summary", F.lit(""))) != "") if field == "summary" else filled

    missing = F.expr("cast(array() as array<string>)")
    for kind, fields in NEEDED.items():
        missing = F.when(F.col("work_type") == kind, F.array_compact(F.array(*(F.when(~there(f), f.split("|")[0]) for f in fields)))).otherwise(missing)
    checked = F.exists("sections", lambda s: (s["key"] == "checklist") & F.contains(F.lower(s["body"]), F.lit("bench")))
    warnings = F.array_compact(F.array(
        F.when(F.col("work_type") == "unknown", "kind not stated"), F.when((F.col("work_type") == "code_review") & there("acceptance_criteria"), "a review with acceptance criteria"),
        F.when((F.col("work_type") == "release") & ~checked, "a release without its bench checklist"),
    ))
    return t.select(*tickets.columns, "work_type", "stated", variant.alias("pipeline_variant"), "sections", missing.alias("missing_fields"), warnings.alias("warnings"))
