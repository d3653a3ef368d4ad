"""Scalar text functions, all built-in columns. Null in gives null out unless said otherwise."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Masks and what they mask, in this order.
MASKS = [(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[PAN]"), (r"\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b", "[AADHAAR]"), (r"\b[0-9]{9,18}\b", "[ACCOUNT]")]
#: Fixed value: one token of the estimate.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"
NUMBER = r"[0-9][0-9,]*(?:\.[0-9]+)*(?: ?(?:lakh|crore))?"
MONEY = r"^\s*(-?)\s*(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(lakh|crore|cr|k)?(?:\s*rupees)?\s*$"
#: The words that carry no content.
STOPWORDS = "a an and any are as at be been but by can do does for from has have if in is it its may must no not of on or shall so such than that the this to was which will with".split()


def normalise(text: Column) -> Column:
    """Soft hyphens vanish, non-breaking spaces become spaces."""
    return F.translate(text, " ­", " ")


#: Signs whose full case folding has letters of tokens that lower case does not give, by the rule of Unicode: ß, ligatures, the long s and their like.
FOLDS = {"İ": "i̇"} | {c: c.casefold() for c in map(chr, range(0x80, 0x20000)) if c.casefold() != c.lower() and re.search("[a-z0-9]", c.casefold())}


def folded(text: Column) -> Column:
    """Case folding as far as tokens need it."""
    return F.lower(reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(FOLDS[c])), FOLDS, normalise(text)))


def folded_sql(text: str) -> str:
    """The same as SQL."""
    return "lower(" + "replace(" * len(FOLDS) + text + "".join(f", '{c}', '{f}')" for c, f in FOLDS.items()) + ")"


#: What stands at the head or foot of pages and is no text of the document: whole lines, and how lines begin.
FURNITURE = ["Income Tax Department", "Ministry of Finance, Government of India"]
FURNITURE_STARTS = ["Downloaded/Printed on"]


def is_furniture(line: Column, whole: list[str] | None = None, starts: list[str] | None = None) -> Column:
    """Whether a line belongs to the page and not to its text; null for null. Other documents bring their own lists."""
    own = F.trim(F.replace(normalise(line), F.lit("\t"), F.lit(" ")))
    begins = [own.startswith(s) for s in (FURNITURE_STARTS if starts is None else starts)]
    return reduce(lambda x, y: x | y, begins, own.isin(FURNITURE if whole is None else whole))


def tokens(text: Column) -> Column:
    """Runs of a-z and digits, in order; an empty array for a text without any."""
    return F.regexp_extract_all(folded(text), F.lit("([a-z0-9]+)"), F.lit(1))


def grouped_tokens(text: Column) -> Column:
    """The same with commas inside numbers removed first."""
    return tokens(F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{2,3}(?:[^0-9]|$))", ""))


def terms(text: Column) -> Column:
    """Tokens without a plural s."""
    return F.transform(tokens(text), lambda t: F.when((F.length(t) > 3) & t.endswith("s") & ~t.endswith("ss"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t))


def has_phrase(words: Column, phrase: Column) -> Column:
    """Whether the words of phrase occur in words, side by side."""
    pad = lambda a: F.concat(F.lit(" "), F.array_join(a, " "), F.lit(" "))
    return pad(words).contains(pad(phrase))


def find_phrase(words: Column, phrase: Column) -> Column:
    """The first index (from 0) at which phrase begins in words, or null."""
    n = F.size(phrase)
    return F.try_element_at(F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.slice(words, i + 1, n) == phrase), F.lit(1))


def token_estimate(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def squash(text: Column) -> Column:
    return F.regexp_replace(normalise(text), r"\s+", "")


def redact(text: Column) -> Column:
    for pattern, mask in MASKS:
        text = F.regexp_replace(text, pattern, mask)
    return text


def defined_term(text: Column) -> Column:
    """The quoted term (80 characters at most) at the start of the first line with text, after a bracketed number; null without one."""
    line = F.try_element_at(F.filter(F.split(normalise(text), "\n"), lambda x: F.trim(x) != ""), F.lit(1))
    found = F.regexp_extract(F.regexp_replace(F.trim(line), r"^\([0-9]{1,3}[A-Za-z]{0,3}\)\s*", ""), '^["“]([^"“”]{1,80})["”]', 1)
    return F.when(found != "", found)


def omitted_only(text: Column) -> Column:
    """Nothing but a marker and the sign of omission."""
    return F.trim(F.regexp_replace(text, r"\s+", " ")).rlike(r"^\S*\s*\[\*\*\*\]$")


def numbers_in(text: Column) -> Column:
    """The distinct numbers of a text as DECIMAL(38,6), in order of appearance; lakh and crore multiply; 12.04.2031 is no number."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({NUMBER})"), F.lit(1))
    times = lambda s: F.when(s.endswith("lakh"), F.lit(100000)).when(s.endswith("crore"), F.lit(10000000)).otherwise(F.lit(1))
    value = F.transform(found, lambda s: (F.regexp_replace(s, "[^0-9.]", "").try_cast("decimal(26,6)") * times(s)).try_cast("decimal(38,6)"))
    return F.array_distinct(F.filter(value, lambda v: v.isNotNull()))


def money(text: Column) -> Column:
    """An amount as DECIMAL(38,2); null if the text is none."""
    low = F.lower(text)
    part = lambda i: F.regexp_extract(low, MONEY, i)
    times = F.when(part(3) == "lakh", 100000).when(part(3).isin("crore", "cr"), 10000000).when(part(3) == "k", 1000).otherwise(1)
    amount = (F.regexp_replace(part(2), ",", "").try_cast("decimal(24,4)") * times).try_cast("decimal(38,2)")
    return F.when(part(2) != "", F.when(part(1) == "-", -amount).otherwise(amount))


def tax_year(text: Column) -> Column:
    """YYYY-YY with consecutive years, else null; a four-digit end is cut to two."""
    trimmed = F.trim(text)
    a, b = F.regexp_extract(trimmed, "^([0-9]{4})-(?:[0-9]{2})?([0-9]{2})$", 1), F.regexp_extract(trimmed, "^([0-9]{4})-(?:[0-9]{2})?([0-9]{2})$", 2)
    return F.when((a != "") & ((a.try_cast("int") + 1) % 100 == b.try_cast("int")), F.concat(a, F.lit("-"), b))


def content_words(text: Column) -> Column:
    """Distinct tokens without markers and stopwords."""
    return F.array_except(F.array_distinct(tokens(F.regexp_replace(text, r"\[[^\]\n]{1,12}\]", " "))), F.array(*[F.lit(w) for w in STOPWORDS]))


def line_type(line: Column) -> Column:
    """The kind of a line of an answer, first rule first."""
    body = F.trim(F.regexp_replace(F.regexp_replace(line, r"\[(?:[0-9]+|calc|fact|eg|guide)\]", ""), r"^\s*(?:[0-9]+[.)]|[-*•])\s*", ""))
    return (
        F.when(body == "", "malformed").when(line.rlike(r"^\s*#{1,6} "), "heading").when(line.contains("[guide]"), "guidance")
        .when(~line.rlike(r"\[[0-9]+\]") & F.lower(body).rlike(r"^(?:nothing in|no provision|the act does not)"), "no_basis")
        .when(F.lower(body).rlike(r"^(?:it is not known|cannot be determined|unknown)"), "unknown")
        .when(line.contains("[eg]"), "example").when(line.contains("[calc]"), "computation").when(line.contains("[fact]"), "application").otherwise("content")
    )


def chunk_id(version: Column, path: Column, text: Column) -> Column:
    """Sixteen hex digits derived from a chunk's content."""
    return F.substring(F.sha2(F.concat_ws("\x00", version, path, normalise(text)), 256), 1, 16)


def stub_embedding(kind: str, text: Column, dim: int = 32) -> Column:
    """A deterministic unit vector of a text: hashed numbers in [-1, 1), divided by their norm."""
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(F.sha2(F.concat_ws("\x00", F.lit(kind), text, i.cast("string")), 256), 1, 8), 16, 10).cast("double") / 2147483648.0 - 1.0)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)
