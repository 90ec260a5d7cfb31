"""Column functions: text, numbers, paths and symbols. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def shannon_entropy(s: Column) -> Column:
    """Bits per code point; 0 for an empty string."""
    share = lambda c: (F.length(s) - F.length(F.replace(s, c, F.lit("")))) / F.length(s)
    chars = F.filter(F.array_distinct(F.split(s, "")), lambda c: c != "")
    return F.aggregate(F.transform(chars, share), F.lit(0.0), lambda a, p: a - p * F.log2(p))


def normal_path(p: Column) -> Column:
    """Backslashes as slashes; leading dots and slashes, and trailing slashes, dropped."""
    return F.regexp_replace(F.regexp_replace(F.replace(p, F.lit("\\"), F.lit("/")), "^[./]+", ""), "/+$", "")


def drop_dot_slash(p: Column) -> Column:
    return F.regexp_replace(p, "^\\./", "")


def bare_symbol(s: Column) -> Column:
    """The last identifier in s; s itself without one."""
    found = F.regexp_extract_all(s, F.lit(f"({IDENTIFIER})"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1)).otherwise(s)


def checkable_symbol(s: Column) -> Column:
    """Whether s, trimmed and without a trailing (), is a dotted identifier."""
    return F.coalesce(F.rlike(F.regexp_replace(F.trim(s), "\\(\\)$", ""), F.lit(f"^{IDENTIFIER}([.]{IDENTIFIER})*$")), F.lit(False))


def ranges_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Closed ranges; true if any bound is null."""
    return F.coalesce((s1 <= e2) & (s2 <= e1), F.lit(True))


def estimated_tokens(s: Column) -> Column:
    """A quarter of the code points, rounded down."""
    return F.floor(F.length(s) / 4).cast("long")


def tokens_of_chars(chars: Column, divisor: Column | int = 4) -> Column:
    """chars / divisor rounded up; a divisor that isn't positive counts as 4."""
    d = F.when(F.lit(divisor) > 0, F.lit(divisor)).otherwise(4) if isinstance(divisor, int) else F.when(divisor > 0, divisor).otherwise(4)
    return F.ceil(F.coalesce(chars, F.lit(0)) / d).cast("long")


def safe_double(x: Column, default: float = 0.0) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(default))


def safe_long(x: Column, default: int = 0) -> Column:
    return F.coalesce(x.try_cast("double").cast("long"), F.lit(default))


def info_volume(x: Column) -> Column:
    """Whole tokens, none below 0."""
    return F.greatest(F.lit(0), x.cast("long"))


def is_test_file(path: Column) -> Column:
    """By suffix, prefix of the last segment, or a test directory on the way."""
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    return (
        F.rlike(name, F.lit("(_test[.](go|py)|[.](test|spec)[.][jt]sx?|[.]t[.]sol)$"))
        | F.startswith(name, F.lit("test_"))
        | F.arrays_overlap(parts, F.array(*map(F.lit, ("test", "tests", "testdata", "__tests__"))))
    )


def fts_safe(q: Column) -> Column:
    """Everything but letters, digits, _ and white space as a blank."""
    return F.regexp_replace(q, "(?U)[^\\w\\s]", " ")


def ticket_id(branch: Column, body: Column) -> Column:
    """The first ABC-12 in the branch, else in the body; null without any."""
    first = lambda c: F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), "([A-Z]+-[0-9]+)", 1), F.lit(""))
    return F.coalesce(first(branch), first(body))


def masked(key: Column, value: Column, secret_keys: tuple[str, ...]) -> Column:
    return F.when(key.isin(*secret_keys) & (value != ""), F.lit("********")).otherwise(value)


def line_range(text: Column, start: Column, end: Column, default: int = 80) -> Column:
    """Lines start to end, counted from 1; the first `default` lines where start is null."""
    lines = F.split(text, "\n")
    return F.array_join(F.when(start.isNotNull(), F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start + 1, F.lit(0)))).otherwise(F.slice(lines, 1, default)), "\n")


def search_terms(prompt: Column, stopwords: tuple[str, ...]) -> Column:
    """Quoted identifiers, then identifiers with an inner hump or of 4 and more characters; the first of each, whatever its case."""
    clean = F.regexp_replace(prompt, "(?i)\\s+Cite\\s+the\\s+[^.]+\\.", "")
    quoted = F.regexp_extract_all(clean, F.lit("[`'\"]([A-Za-z0-9_.]+)[`'\"]"), F.lit(1))
    words = F.filter(F.regexp_extract_all(clean, F.lit(f"\\b({IDENTIFIER})\\b"), F.lit(1)), lambda w: (F.length(w) >= 4) | F.rlike(w, F.lit("[a-z][A-Z]")))
    stop = F.array(*map(F.lit, stopwords))
    fresh = F.filter(F.concat(quoted, words), lambda w: ~F.array_contains(stop, F.lower(w)))
    empty = F.expr("cast(array() as array<string>)")
    return F.aggregate(fresh, empty, lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w))))


def failure_key(summary: Column) -> Column:
    """Lower case, with hex addresses and hashes, then numbers, masked."""
    s = F.regexp_replace(F.lower(summary), "0x[0-9a-f]+|\\b[0-9a-f]{12,}\\b", "<hex>")
    return F.trim(F.regexp_replace(s, "[0-9]+", "<n>"))
