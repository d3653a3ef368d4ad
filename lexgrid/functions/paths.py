"""Citation paths: a root (a number with letters, or "Schedule" with a roman number) and bracketed parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of any kind.
SPACE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
ROOT = r"^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})"
#: Fixed value: brackets that may follow a root.
MAX_BRACKETS = 5
VALID = ROOT + r"(?:\([0-9A-Za-z]+\))*$"


def canonical(path: Column) -> Column:
    """A citation as written in paths: without a leading word for section and space before brackets; null if it is no path."""
    trimmed = F.regexp_replace(path, rf"^{SPACE}+|{SPACE}+$", "")
    bare = F.regexp_replace(F.regexp_replace(trimmed, rf"^(?i:sections?|sec\.?|s\.|u/s\.?){SPACE}*", ""), rf"{SPACE}+\(", "(")
    return F.when(bare.rlike(VALID), bare)


def parts(path: Column) -> Column:
    """Root and brackets as an array; null if it is no path."""
    return F.when(path.rlike(VALID), F.concat(F.array(F.regexp_extract(path, ROOT, 1)), F.regexp_extract_all(path, F.lit(r"(\([0-9A-Za-z]+\))"), F.lit(1))))


def depth(path: Column) -> Column:
    return F.size(parts(path))


def too_deep(path: Column) -> Column:
    return F.size(parts(path)) > MAX_BRACKETS + 1


def parent(path: Column) -> Column:
    """The path one level up; null for a root."""
    p = parts(path)
    return F.when(F.size(p) > 1, F.array_join(F.slice(p, 1, F.size(p) - 1), ""))


def prefixes(path: Column) -> Column:
    """The path and all its ancestors, the root first."""
    p = parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(p)), lambda n: F.array_join(F.slice(p, 1, n), ""))


def credits(got: Column, want: Column, lenient: bool = True) -> Column:
    """Whether a retrieved path earns credit for a required one: equal, or leniently a proper ancestor of it."""
    if not lenient:
        return got == want
    g, w = parts(got), parts(want)
    return F.slice(w, 1, F.size(g)) == g


def same_line(a: Column, b: Column) -> Column:
    """Whether one path is the other or above it."""
    p, q = parts(a), parts(b)
    n = F.least(F.size(p), F.size(q))
    return F.slice(p, 1, n) == F.slice(q, 1, n)


def number_range(low: Column, high: Column, widest: int = 50) -> Column:
    """All numbers from low to high; only both ends if they descend or lie too far apart."""
    lo, hi = low.try_cast("int"), high.try_cast("int")
    return F.when((lo <= hi) & (hi - lo <= widest), F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda x: x.cast("string"))).otherwise(F.array(low, high))


def label(path: Column, title: Column) -> Column:
    kind = F.when(path.startswith("Schedule"), path).otherwise(F.concat(F.lit("Section "), path))
    return F.concat_ws(" — ", kind, title)


def breadcrumb(numeral: Column, chapter: Column, path: Column, title: Column) -> Column:
    """Chapter and citation, for what a chunk is embedded and indexed with."""
    chapter_line = F.when(numeral != "", F.concat_ws(" — ", F.concat(F.lit("Chapter "), numeral), chapter))
    return F.concat_ws(" / ", chapter_line, label(path, title))
