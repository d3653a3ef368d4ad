"""Personal information inside free text: e-mail addresses, phone numbers, identity numbers, street addresses, names of people.

Weak supervision. Labelers of three sorts (patterns, gazetteers, generic words around a span) propose spans and vote for or against every
proposed span; for names every run of capitalised words, or in texts of one case of words that are rare, is proposed too.
Two more labelers are learned: they vote for spans whose neighbouring words are, in all texts, mostly those of cases that lists and patterns know.
Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is. A logistic span classifier is then
trained on the resulting soft labels. It sees the votes and, besides, the words around the span, its shape, its endings and its case; training rows with votes come
again without them, so it learns from the places where known names stand to recognise names that no labeler knows.

Only vote patterns with their counts (at most 3^labelers, some hundred in practice), `sample` spans as hashed features and `vocabulary` frequent words
reach the driver, whatever the number of texts.

Of overlapping spans names give way to the other kinds; of spans of one kind within each other the longer stands unless it is less probable by 0.15; else the more probable one stands, then the longer,
then the earlier one.

Defined results: null, empty and blank texts have no spans; positions count code points; a repeated text is found in each
of its rows; a text in one case only is read without regard to case.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, spread

KINDS = ("email", "phone", "identity_number", "street_address", "person_name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "identity_number": "[IDENTITY_NUMBER]", "street_address": "[STREET_ADDRESS]", "person_name": "[PERSON_NAME]"}

# ---- patterns

_LABEL = r"[^\W_](?:[\w-]*[^\W_])?"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?|\sdot\s)"
_LOCAL = r"[^\W_][\w.+%-]*"
EMAIL = re.compile(rf"{_LOCAL}(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[^\W\d_]{{2,}}|\sat\s{_LABEL}(?:\s(?:dot)\s{_LABEL})*\sdot\s[^\W\d_]{{2,}})(?![\w@])", re.I)

PHONE = re.compile(
    r"(?<![\w.+/,-])(?:"
    r"(?:\+|00)\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,6}){1,3}"  # with a country prefix
    r"|\(\d{2,5}\)[ .-]?\d{3,4}[ .-]?\d{3,6}"  # with an area code in brackets
    r"|0\d{4}[ .-]?\d{3}[ .-]?\d{3}|0\d{3}[ .-]\d{3}[ .-]\d{3,4}|0\d{10}"  # with a trunk zero
    r"|\d{3}[.-]\d{3}[.-]\d{4}|\d{5}[ -]\d{5}|[5-9]\d{9}"
    r")(?![\w/]|[.,-]\d)"
)
TAX = re.compile(r"(?<![\w-])[A-Z]{5}[- ]?\d{4}[- ]?[A-Z](?![\w])", re.I)
NATIONAL = re.compile(r"(?<![\w.,/+-])\d{4}([ .-]?)\d{4}\1\d{4}(?![\w/]|[.,-]\d| \d)")
PASSPORT = re.compile(r"(?<![\w-])[A-Z]\d(?:\d{6}| \d{3} \d{3})(?!\w)", re.I)
ACCOUNT = re.compile(r"(?<![\w.,/+-])(?:\d{4} \d{4} \d{3,8}|\d{4}-\d{4}-\d{3,8}|\d{9,18})(?![\w/]|[.,-]\d| \d)")

_STREET_TYPE = r"(?:street|st|road|rd|lane|ln|close|avenue|ave|nagar|marg|drive|way|crescent|terrace|gardens|boulevard|square|row|cross|path|gali|salai|chowk)"
_WORD = r"[^\W\d_][\w'’]*"
_STREET = rf"(?:{_WORD}[ \t]+){{1,3}}?{_STREET_TYPE}\b\.?(?!\w)"
_NUMBER = r"\d+[a-z]?(?:[-/]\d+[a-z]?)?"
_HEAD = rf"(?:flat|plot|door|unit|house\s*no\.?|h\.?\s?no\.?|no\.|apt\.?|apartment|villa|room|shop)\s*#?{_NUMBER}"
_BOX = r"p\.?\s?o\.?\s?box\s*(?:no\.?\s*)?\d+"
_BUILDING = rf"(?:{_WORD}[ \t]+){{1,3}}?(?:court|apartments?|chambers|residency|house|towers?|heights|enclave|villas?|mansions?|building|complex|park)"
_PART = rf"(?:{_NUMBER}\s+{_STREET}|{_STREET}|{_BUILDING}|(?:sector|tower|block|wing|phase|apt\.?|apartment|flat|unit|floor)\s*[\w-]+|\d+(?:st|nd|rd|th)\s+floor)"
_TOWN = r"[^\W\d_]{3,}(?:-[^\W\d_]+)?"
_POST = r"(?:(?:\s*,\s*pin(?:\s*code)?\s*:?\s*|\s*-\s*|[ \t]+|\s*,\s*)\d{3}[ ]?\d{3}(?![\w]|-\d| \d)|\s*,\s*[a-z]{1,2}\d{1,2}[a-z]?\s?\d[a-z]{2}(?!\w))"
ADDRESS = re.compile(rf"(?<![\w/.-])(?:{_BOX}|{_HEAD}(?:\s*,\s*{_PART})+|{_NUMBER}\s+{_STREET}(?:\s*,\s*{_PART})*)\s*,\s*{_TOWN}{_POST}?", re.I)
ADDRESS_SHORT = re.compile(rf"(?<![\w/.-])(?:{_HEAD}(?:\s*,\s*{_PART})+|{_HEAD}\s*,\s*{_TOWN}{_POST})", re.I)

# ---- names

TITLE = r"(?:mr|mrs|ms|miss|mx|dr|prof|shri|sri|smt|kumari|sir)\b\.?"
_TITLE_WORD = re.compile(TITLE, re.I)
_TITLE_END = re.compile(rf"(?<!\w){TITLE}[ ]$", re.I)
_INITIAL = r"[^\W\d_]\."
_PIECES = re.compile(rf"{_INITIAL}|[^\W\d_]{{2,}}")
_ORGANISATION = re.compile(r"[ ](?:pvt|ltd|limited|inc|llp|llc|plc|gmbh|corp|company|trust|foundation|society|bank|university|& co|and sons|court|apartments|chambers|residency|street|st|road|rd|lane|close|avenue|nagar|marg|mills|industries)\b", re.I)
_NEIGHBOUR = re.compile(r"([^\W\d_]+\.?)[ ]$")
#: A word or a sign; a line break counts as a sign.
_TOKEN = re.compile(r"[^\W\d_]+|\d+|\n|[^\w\s]")


class Lexicon:
    """Name parts, and the stems and endings that family names of the list share."""

    def __init__(self, given: Iterable[str], family: Iterable[str], ordinary: Iterable[str] = ()):
        self.given = {g.lower() for g in given if g}
        self.family = {f.lower() for f in family if f}
        self.ordinary = {w.lower() for w in ordinary}  # frequent words of the corpus that are written small
        stems, endings = {}, {}
        for f in self.family:
            for i in range(2, len(f) - 2):
                stems.setdefault(f[:i], set()).add(f[i:])
                endings.setdefault(f[i:], set()).add(f[:i])
        self.stems = {s for s, e in stems.items() if len(e) >= 3}
        self.endings = {e for e, s in endings.items() if len(s) >= 3}

    @functools.lru_cache(100_000)  # noqa: B019 - one lexicon a worker
    def is_family(self, word: str) -> bool:
        w = word.lower()
        if w in self.family:
            return True
        return len(w) >= 5 and any(w[:i] in self.stems and w[i:] in self.endings for i in range(3, len(w) - 2))


def _case(text: str) -> str:
    """mixed, lower or upper."""
    return "lower" if text == text.lower() else "upper" if text == text.upper() else "mixed"


def _starts(text: str, at: int) -> bool:
    """Whether a sentence, a line or the text starts here."""
    before = text[:at].rstrip(" ")
    return not before or not (before[-1].isalnum() or before[-1] in ",;:'’\"()/&-@#")


def _runs(text: str, words: list[tuple[str, int, int]], lexicon: Lexicon, case: str) -> Iterator[tuple[int, int]]:
    """Places (first, last) in words of every run that may be a name by its looks alone; without its first word too, where that opens a sentence."""

    def looks(k: int) -> bool:
        word, a, b = words[k]
        if a and text[a - 1] in "@._+%-" and (a < 2 or not text[a - 2].isspace()) or text[b : b + 1] in ("@", "_"):
            return False
        if word.endswith("."):
            return case == "mixed" and text[a].isupper() or case != "mixed"
        if _TITLE_WORD.fullmatch(word):
            return False
        own = text[a:b]
        if case == "mixed":
            return own[0].isupper() and own[1:].islower()
        return word not in lexicon.ordinary or word in lexicon.given or len(word) > 3 and k + 1 < len(words) and text[b : words[k + 1][1]] == " " and lexicon.is_family(words[k + 1][0])

    def end_of(i: int) -> int:
        j = i
        while j + 1 < len(words) and j - i < 3 and looks(j + 1):
            gap = text[words[j][2] : words[j + 1][1]]
            if not (gap in (" ", "-") or gap == "" and words[j][0].endswith(".") or gap == ", " and j == i and not words[i][0].endswith(".")):
                break
            j += 1
        return j

    i = 0
    while i < len(words):
        if not looks(i):
            i += 1
            continue
        last = end_of(i)
        todo = [(i, last)]
        if _starts(text, words[i][1]) and last > i:
            todo.append((i + 1, end_of(i + 1)))
        for first, end in todo:
            if not all(words[k][0].endswith(".") for k in range(first, end + 1)):
                yield first, end
            if end > first and text[words[first][2] : words[first][2] + 2] == ", ":  # two names of a list, or one with the family first
                yield first, first
                yield first + 1, end
        i = max(end for _, end in todo) + 1


def _name_votes(text: str, lexicon: Lexicon) -> dict[tuple[int, int], set[str]]:
    """Spans that may be names with the labelers that speak for them."""
    found: dict[tuple[int, int], set[str]] = {}
    words = [(m.group().lower(), m.start(), m.end()) for m in _PIECES.finditer(text)]
    for i, j in _runs(text, words, lexicon, _case(text)):
        found.setdefault((words[i][1], words[j][2]), set())
    i = 0
    while i < len(words):
        span = _name_at(text, words, i, lexicon)
        if span is None:
            i += 1
            continue
        j, who = span
        found.setdefault((words[i][1], words[j][2]), set()).add(who)
        i = j + 1
    for (a, _), who in found.items():
        if _TITLE_END.search(text[max(0, a - 10) : a]):
            who.add("title")
    return found


def _name_at(text: str, words: list[tuple[str, int, int]], i: int, lexicon: Lexicon) -> tuple[int, str] | None:
    """Index of the last word of a name that begins at word i, and which gazetteer labeler says so."""

    def gap(k: int) -> str:
        return text[words[k][2] : words[k + 1][1]] if k + 1 < len(words) else "\0"

    def family(k: int) -> int | None:
        """The end of a family name, hyphenated or not, at k."""
        if k < len(words) and lexicon.is_family(words[k][0]):
            return k + 1 if gap(k) == "-" and lexicon.is_family(words[k + 1][0]) else k
        return None

    w = words[i][0]
    before = text[words[i][1] - 1] if words[i][1] else " "
    if before in "@._+%-" or before.isalnum():
        return None
    if w.endswith("."):  # initials, then a family name
        k = i
        while k + 1 < len(words) and words[k + 1][0].endswith(".") and gap(k) in ("", " "):
            k += 1
        if gap(k) in ("", " ") and (end := family(k + 1)) is not None and k - i < 3:
            return end, "full"
        return None
    if (end := family(i)) is not None and gap(end) == ", " and words[end + 1][0] in lexicon.given:
        k = end + 1
        if gap(k) == " " and words[k + 1][0].endswith("."):
            k += 1
        return k, "full"
    if (end := family(i)) is not None and gap(end) == " " and words[end + 1][0] in lexicon.given and words[end + 1][0] not in lexicon.ordinary:
        return end + 1, "full"
    k = i
    while gap(k) == " " and words[k + 1][0].endswith(".") and len(words[k + 1][0]) == 2 and k - i < 2:
        k += 1
    if gap(k) in ("", " ") and k + 1 < len(words) and (end := family(k + 1)) is not None and not lexicon.is_family(w):
        known = w in lexicon.given
        if known:
            return end, "full"
        inside = _case(text) == "mixed" and text[words[i][1]].isupper() and not _starts(text, words[i][1])
        if not re.fullmatch(TITLE, w) and (inside or w not in lexicon.ordinary and (text[words[i][1]].isupper() or _case(text) == "lower")):
            return end, "family"
        return None
    if w in lexicon.given and w not in lexicon.ordinary:
        return i, "given"
    return None


# ---- votes

#: The labelers of each kind, in the order of their votes.
LABELERS = {
    "email": ["pattern", "known_ending", "spelled"],
    "phone": ["pattern", "prefix", "word", "money_or_code", "account_word"],
    "identity_number": ["tax", "national", "passport", "account", "word", "no_word", "money_or_code"],
    "street_address": ["pattern", "short", "postcode", "ordinary_end"],
    "person_name": ["title", "full", "family", "given", "opening", "partial", "organisation", "covered"],
}
#: Two more labelers of every kind, learned from the corpus: the words before and after a span are those that known cases have.
LEARNED = ["before", "after"]
#: Votes that make a span no witness for what stands around cases.
DOUBTFUL = {k: [i for i, who in enumerate(v) if who in ("partial", "organisation", "covered", "money_or_code", "account_word", "ordinary_end")] for k, v in LABELERS.items()}
#: Votes of lists and patterns strong enough to make a span a known case.
SURE = {"email": "pattern", "phone": "prefix word", "identity_number": "tax national passport word", "street_address": "pattern postcode", "person_name": "title full family given"}
SURE = {k: [i for i, who in enumerate(LABELERS[k]) if who in v.split()] for k, v in SURE.items()}
#: Words that commonly announce a phone number, an identity number, an account, a sum or a code.
_PHONE_WORD = re.compile(r"\b(?:call|phone|ph|whatsapp|text|sms|mob|mobile|cell|tel|telephone|contact|reach|dial)\b[^\d\n]{0,25}$", re.I)
_ID_WORD = re.compile(r"\b(?:pan|id|identity|tax|national|passport|account|a/c|acct|iban|deposit|card|number)\b[^\d\n]{0,25}$", re.I)
_ACCOUNT_WORD = re.compile(r"\b(?:account|a/c|acct|iban|deposit)\b[^\d\n]{0,20}$", re.I)
_SUM_BEFORE = re.compile(r"(?:[₹$€£]|\brs\.?|\binr|\busd|\beur|\binvoice|\bno\.|\bdated|\bcode|\blot|\bpage|\btable|\bsection|\bpara)[ ]*$", re.I)
_SUM_AFTER = re.compile(r"^[ ]*(?:rupees|dollars|euros|lakh|crore|million|units|%|per cent)\b", re.I)
#: Hashed features of the classifier.
BITS = 18


def _hash(kind: str, feature: str) -> int:
    return zlib.crc32(f"{kind}|{feature}".encode()) & ((1 << BITS) - 1)


def vote_features(kind: str, votes: str) -> list[int]:
    return [_hash(kind, f"vote:{who}{v}") for who, v in zip([*LABELERS[kind], *LEARNED], votes) if v != "0"]


def learned(votes: str, found: list[int], known: set[int]) -> str:
    """The votes with those of LEARNED: known holds the hashed surroundings of cases."""
    before, after = found[1] in known or found[2] in known, found[3] in known or found[4] in known
    return votes + "0+"[before] + "0+"[after]


def features(kind: str, text: str, a: int, b: int, case: str) -> list[int]:
    """What the classifier sees of a span besides the votes: the words and signs around it, its shape, its ending, its case."""
    before = [re.sub(r"\d", "0", t) for t in _TOKEN.findall(text[max(0, a - 40) : a].lower())][-2:]
    after = [re.sub(r"\d", "0", t) for t in _TOKEN.findall(text[b : b + 40].lower())][:2]
    left, right = (["^", "^", *before][-2:], [*after, "$", "$"][:2])
    own = text[a:b]
    shape = re.sub(r"[^\W\d_]+", lambda m: "x" if m.group().islower() else "X" if len(m.group()) == 1 or m.group().isupper() else "Xx", own)
    shape = re.sub(r"\d+", lambda m: f"0{len(m.group())}", shape) if kind != "street_address" else "".join(sorted(set(re.sub(r"[\dxX]+", "", shape))))
    near = "tight" if a and not text[a - 1].isspace() else "open"
    last = (re.findall(r"[^\W\d_]+", own.lower()) or [""])[-1]
    plain = "" if case == "mixed" else case
    seen = [
        "bias", f"left={left[1]}", f"left2={left[0]} {left[1]}", f"right={right[0]}", f"right2={right[0]} {right[1]}", f"around={left[1]}_{right[0]}",
        f"shape={shape}", f"end={last[-3:]}", f"case={plain}", f"start={_starts(text, a)}", f"near={near}", f"size={min(9, len(own) // 4)}", f"place={plain}{left[1]}{shape}",
    ]
    return [_hash(kind, f) for f in seen]


def candidates(text: str | None, lexicon: Lexicon) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, votes) of every proposed span; a vote is + for, - against, 0 none, in the order of LABELERS."""
    if not text or text.isspace():
        return []
    out: dict[tuple[str, int, int], dict[str, str]] = {}

    def vote(kind: str, a: int, b: int, who: str, sign: str = "+") -> None:
        out.setdefault((kind, a, b), {})[who] = sign

    if "@" in text or re.search(r"\bat\b", text, re.I):
        for m in EMAIL.finditer(text):
            vote("email", *m.span(), "pattern")
    if re.search(r"\d", text):
        for m in PHONE.finditer(text):
            vote("phone", *m.span(), "pattern")
        for who, pattern in (("tax", TAX), ("national", NATIONAL), ("passport", PASSPORT), ("account", ACCOUNT)):
            for m in pattern.finditer(text):
                vote("identity_number", *m.span(), who)
        for who, pattern in (("pattern", ADDRESS), ("short", ADDRESS_SHORT)):
            for m in pattern.finditer(text):
                vote("street_address", *m.span(), who)
    covered, case = [(a, b) for k, a, b in out if k in ("email", "street_address")], _case(text)
    for (a, b), who in _name_votes(text, lexicon).items():
        out[("person_name", a, b)] = dict.fromkeys(who, "+")
        if any(a < d and c < b for c, d in covered):
            vote("person_name", a, b, "covered", "-")
        if (case != "mixed" or _starts(text, a)) and (m := _PIECES.match(text, a)) and m.group().lower() in lexicon.ordinary:
            vote("person_name", a, b, "opening", "-")
        if (m := _NEIGHBOUR.search(text[max(0, a - 30) : a])) and text[a].isupper() and m.group(1)[:1].isupper() and not (m.group(1).lower() in lexicon.ordinary and _starts(text, a - len(m.group()))) and not _TITLE_END.search(text[max(0, a - 10) : a]):
            vote("person_name", a, b, "partial", "-")
        if _ORGANISATION.match(text[b : b + 15]) or _ORGANISATION.search(text[a:b]):
            vote("person_name", a, b, "organisation", "-")
    for k, a, b in list(out):
        before, after = text[max(0, a - 40) : a], text[b : b + 12]
        if k == "email":
            vote(k, a, b, "known_ending", "+" if re.search(r"(?:example|test|invalid|com|org|net|in|edu|gov|info|uk)$", text[a:b], re.I) else "-")
            if re.search(r"\b(?:at|dot)\b", text[a:b], re.I):
                vote(k, a, b, "spelled")
        elif k in ("phone", "identity_number"):
            if _SUM_BEFORE.search(before) and not _ACCOUNT_WORD.search(before) or _SUM_AFTER.match(after):
                vote(k, a, b, "money_or_code", "-")
            if k == "phone":
                if text[a] in "+(" or text[a:b].startswith("0"):
                    vote(k, a, b, "prefix")
                if _PHONE_WORD.search(before):
                    vote(k, a, b, "word")
                if _ACCOUNT_WORD.search(before):
                    vote(k, a, b, "account_word", "-")
            elif _ID_WORD.search(before):
                vote(k, a, b, "word")
            elif not {"tax", "national", "passport"} & set(out[k, a, b]):
                vote(k, a, b, "no_word", "-")
        elif k == "street_address":
            if re.search(_POST + "$", text[a:b], re.I):
                vote(k, a, b, "postcode")
            elif text[a:b].lower().split()[-1].split(",")[-1] in lexicon.ordinary:
                vote(k, a, b, "ordinary_end", "-")
    return [(k, a, b, "".join(v.get(who, "0") for who in LABELERS[k])) for (k, a, b), v in sorted(out.items())]


# ---- reliabilities and the classifier


def reliabilities(counts: Counter, rounds: int = 100) -> dict[str, float]:
    """Dawid-Skene over vote patterns of one kind: the probability of a case for each pattern. It starts from labelers that are right four times out of five."""
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    votes = np.array([["0+-".index(v) for v in p] for p in patterns])
    n = votes.shape[1]
    prior, table = 0.2, np.stack([np.tile([0.5, 0.1, 0.4], (n, 1)), np.tile([0.5, 0.4, 0.1], (n, 1))])
    start = table.copy()
    for _ in range(rounds):
        log = np.log(table)[:, np.arange(n), votes].sum(2) + np.log([[1 - prior], [prior]])
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        prior = float(np.clip((weight @ post + 2) / (weight.sum() + 20), 0.02, 0.98))
        for c, p in ((0, 1 - post), (1, post)):
            for v in range(3):
                table[c, :, v] = ((votes == v) * (weight * p)[:, None]).sum(0) + 20 * start[c, :, v]
            table[c] /= table[c].sum(1, keepdims=True)
    return dict(zip(patterns, post.tolist()))


def soft_labels(counts: dict[tuple[str, str], int]) -> dict[tuple[str, str], float]:
    out = {}
    for kind in KINDS:
        mine = Counter({v: n for (k, v), n in counts.items() if k == kind})
        out |= {(kind, v): p for v, p in reliabilities(mine).items()} if mine else {}
    return out


def train(rows: list[tuple[list[int], list[int], float]], epochs: int = 20, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic classifier over hashed features; rows: (features, features of the votes, soft label). Each row is learned as it is, and rows with votes without them too."""
    weights, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
    if not rows:
        return weights
    both = [([*f, *v], y) for f, v, y in rows] + [(f, y) for f, v, y in rows if v]
    table = np.full((len(both), max(len(f) for f, _ in both)), -1)
    for i, (f, _) in enumerate(both):
        table[i, : len(f)] = f
    used, mask, label = np.maximum(table, 0), table >= 0, np.array([y for _, y in both])
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(table))
        for s in range(0, len(order), 256):
            some = order[s : s + 256]
            at, on = used[some], mask[some]
            z = (weights[at] * on).sum(1)
            error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some]
            places, where = np.unique(at[on], return_inverse=True)
            grad = np.bincount(where, np.repeat(error, on.sum(1))) / len(some) + decay * weights[places]
            seen[places] += grad * grad
            weights[places] -= rate * grad / np.sqrt(seen[places])
    return weights


def choose(spans: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int]]:
    """Of spans (kind, start, end, probability) those that stand, in order of their place."""
    good = [s for s in spans if s[3] >= 0.5]
    taken: list[tuple[str, int, int]] = []
    for names in (False, True):
        mine = [s for s in good if (s[0] == "person_name") == names and all(s[2] <= c or d <= s[1] for _, c, d in taken)]
        whole = [(k, a, b, p) for k, a, b, p in mine if not any(k == q and c <= a and b <= d and d - c > b - a and r >= p - 0.15 for q, c, d, r in mine)]
        for _, _, a, k, b in sorted((-round(p, 1), a - b, a, k, b) for k, a, b, p in whole):
            if all(b <= c or d <= a for _, c, d in taken):
                taken.append((k, a, b))
    return sorted(taken, key=lambda s: s[1])


def probability(weights: np.ndarray, kind: str, votes: str, found: list[int]) -> float:
    """That a span is a case; one that no labeler votes for, learned ones included, is none."""
    if "+" not in votes:
        return 0.0
    z = float(weights[found].sum() + weights[vote_features(kind, votes)].sum())
    return 1 / (1 + float(np.exp(-max(-30.0, min(30.0, z)))))


# ---- over tables


def ordinary_words(texts: DataFrame, size: int) -> DataFrame:
    """(word): the `size` most frequent words of texts in mixed case that have a capital inside a sentence in one of four places at most."""
    mixed = texts.filter(F.col("text").rlike(r"\p{Lu}") & F.col("text").rlike(r"\p{Ll}"))
    each = lambda pattern: F.expr(f"regexp_extract_all(text, '{pattern}', 1)")
    every = mixed.select(F.explode(each(r"(?<![\\p{L}@._+-])(\\p{L}\\p{Ll}+)(?![\\p{L}@_+-])")).alias("w"), F.lit(1).alias("n"), F.lit(0).alias("inside"))
    inside = mixed.select(F.explode(each(r"(?<=[\\p{Ll}\\p{N},] )(\\p{Lu}\\p{Ll}+)(?![\\p{L}@_+-])")).alias("w"), F.lit(0).alias("n"), F.lit(1).alias("inside"))
    counted = every.unionByName(inside).groupBy(F.lower("w").alias("word")).agg(F.sum("n").alias("n"), F.sum("inside").alias("inside"))
    return counted.filter("n > 2 and inside * 4 <= n").orderBy(F.desc("n"), "word").limit(size).select("word")


def find(texts: DataFrame, lexicon: DataFrame, key: list[str], vocabulary: int = 50_000, sample: int = 50_000) -> DataFrame:
    """texts(key..., text), lexicon(name_part, part_kind) -> (key..., text, spans ARRAY<STRUCT<kind, start_char, end_char>>).

    vocabulary: frequent words that the tasks know; sample: spans, about, that the classifier is trained on, chosen by a hash of their text; all spans are judged."""
    context = texts.sparkSession.sparkContext
    texts = spread(texts.select(*key, "text"))
    parts = lexicon.select("name_part", "part_kind").distinct().collect()  # a fixed list of about 160 names
    given, family = ([r["name_part"] for r in parts if r["part_kind"] == k and r["name_part"]] for k in ("given", "family"))
    known = context.broadcast((given, family, [r[0] for r in ordinary_words(texts, vocabulary).collect()]))
    kinds = {f.name: f.dataType.simpleString() for f in texts.schema.fields}
    head = ", ".join(f"`{c}` {kinds[c]}" for c in [*key, "text"])

    def propose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = Lexicon(*known.value)
        for pdf in batches:
            rows = []
            for t in pdf["text"]:
                t = t if isinstance(t, str) else None
                case = _case(t or "")
                rows.append([(k, a, b, v, features(k, t, a, b, case)) for k, a, b, v in candidates(t, names)])
            yield pdf.assign(spans=rows)

    proposed = materialize(texts.mapInPandas(propose, f"{head}, spans array<struct<kind string, start_char bigint, end_char bigint, votes string, features array<int>>>"))
    each = proposed.select(F.explode("spans").alias("s"))
    sure = lambda kind, rule: F.when(F.col("s.kind") == kind, rule)
    said = lambda kind, places, sign: reduce(lambda x, y: x | y, [F.substring("s.votes", i + 1, 1) == sign for i in places], F.lit(False))
    case = F.coalesce(*[sure(k, said(k, SURE[k], "+") & ~said(k, DOUBTFUL[k], "-")) for k in KINDS])
    doubt = F.coalesce(*[sure(k, said(k, DOUBTFUL[k], "-")) for k in KINDS])
    around = each.filter(~doubt).select(case.alias("case"), F.explode(F.slice("s.features", 2, 4)).alias("f")).groupBy("f").agg(F.count_if("case").alias("cases"), F.count("*").alias("n"))
    # no more rows than a hash has values
    surroundings = context.broadcast({r[0] for r in around.filter("cases >= 5 and 2 * cases >= n").select("f").collect()})

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        around = surroundings.value
        for pdf in batches:
            yield pd.DataFrame([(h, s["kind"], learned(s["votes"], s["features"], around), s["features"]) for h, spans in zip(pdf["h"], pdf["spans"]) for s in spans], columns=["h", "kind", "votes", "features"])

    voted = materialize(proposed.select(F.xxhash64("text").alias("h"), "spans").mapInPandas(vote, "h bigint, kind string, votes string, features array<int>"))
    counted = {(r["kind"], r["votes"]): r["count"] for r in voted.groupBy("kind", "votes").count().collect()}
    label = soft_labels(counted)
    share = max(1, sum(counted.values()) // sample)
    taken = voted.filter(F.pmod("h", F.lit(share)) == 0).drop("h").toArrow().to_pylist()  # about `sample` spans
    taken.sort(key=lambda r: (r["kind"], r["votes"], r["features"]))  # the order of arrival must not matter
    weights = context.broadcast(train([(r["features"], vote_features(r["kind"], r["votes"]), label[r["kind"], r["votes"]]) for r in taken]))

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, around = weights.value, surroundings.value
        for pdf in batches:
            chosen = []
            for spans in pdf["spans"]:
                rated = [(s["kind"], s["start_char"], s["end_char"], probability(w, s["kind"], learned(s["votes"], s["features"], around), s["features"])) for s in spans]
                chosen.append(choose(rated))
            yield pdf.drop(columns="spans").assign(spans=chosen)

    return proposed.mapInPandas(decide, f"{head}, spans array<struct<kind string, start_char bigint, end_char bigint>>")


def redact(found: DataFrame, key: list[str]) -> DataFrame:
    """(key..., redacted): the texts with typed placeholders; null stays null, all else is unchanged."""
    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = []
            for text, spans in zip(pdf["text"], pdf["spans"]):
                for s in reversed(list(spans)):
                    text = text[: s["start_char"]] + PLACEHOLDER[s["kind"]] + text[s["end_char"] :]
                done.append(text if isinstance(text, str) else None)
            yield pdf[key].assign(redacted=done)

    return found.mapInPandas(run, ", ".join(f"`{c}` {kinds[c]}" for c in key) + ", redacted string")
