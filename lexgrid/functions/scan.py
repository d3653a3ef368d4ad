"""Functions that need a scan with memory: pandas UDFs over Arrow batches. Null texts give empty results (null for single values)."""

from __future__ import annotations

import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F



def _per_text(kind: str, run: Callable[[pd.Series], pd.Series]) -> Callable[[Column | str], Column]:
    def udf(texts: pd.Series) -> pd.Series:
        return run(texts)

    return F.pandas_udf(udf, kind)


# ---- references to provisions

_LEX = re.compile(
    r"(?P<word>\b(?:sections?|schedules?|clauses?|sub-sections?|sub-clauses?|paragraphs?|this)\b)|(?P<sched>\b[IVXLC]+\b)|(?P<num>\b\d{1,3}[A-Z]{0,3}\b)"
    r"|(?P<mark>\(\s*[0-9A-Za-z]{1,4}\s*\))|(?P<join>,|\band\b|\bor\b)|(?P<to>\bto\b)|(?P<of>\bof\b)|(?P<space>\s+)|(?P<other>.)",
    re.I | re.S,
)
_OWN = re.compile(r"\s+(act|chapter|part|schedule|section|sub-section)\b", re.I)
_ACT = re.compile(r"\s*(?:of|to)\s+(?:the\s+)?((?:this|said|that)\s+Act|[A-Z][A-Za-z&,.'()\- ]{2,120}?\s(?:Act|Code))\b")
#: Fixed value: a wider range of sections is two sections.
WIDEST = 50


def _numbers(low: str, high: str) -> list[str]:
    if low.isdigit() and high.isdigit() and 0 <= int(high) - int(low) <= WIDEST:
        return [str(n) for n in range(int(low) + 1, int(high) + 1)]
    return [high]


def references(text: str | None) -> list[dict]:
    """References in a text in order: ref_type, surface, citations, act_name. A list inherits what its items leave out;
    "clause (a) of section 80(6)" is 80(6)(a); a reference that names another Act has its name."""
    if not text:
        return []
    toks = [(m.lastgroup, m.group(), m.start(), m.end()) for m in _LEX.finditer(text.replace("­", "").replace(" ", " ")) if m.lastgroup != "space"]
    text = text.replace("­", "").replace(" ", " ")
    out, i = [], 0

    def marks(k: int) -> tuple[str, int]:
        got = ""
        while k < len(toks) and toks[k][0] == "mark":
            got += re.sub(r"\s+", "", toks[k][1])
            k += 1
        return got, k

    while i < len(toks):
        kind, word, a, b = toks[i]
        low = word.lower()
        if kind != "word":
            i += 1
            continue
        if low == "this":
            if m := _OWN.match(text, b):
                out.append({"ref_type": "this_" + m.group(1).lower().replace("sub-section", "subsection"), "surface": text[a : m.end()], "citations": [], "act_name": None})
                while i < len(toks) and toks[i][2] < m.end():
                    i += 1
            else:
                i += 1
            continue
        chain, k = [], i
        # inner marks before the section: clause (a) of sub-clause (ii) of section 80
        while k + 2 < len(toks) and toks[k][0] == "word" and toks[k][1].lower().rstrip("s") in ("clause", "sub-section", "sub-clause") and toks[k + 1][0] == "mark":
            got, n = marks(k + 1)
            if n >= len(toks) or toks[n][0] != "of":
                break
            chain.append(got)
            k = n + 1
        if k >= len(toks) or toks[k][0] != "word" or toks[k][1].lower().rstrip("s") not in ("section", "schedule"):
            i += 1
            continue
        schedule = toks[k][1].lower().startswith("schedule")
        want, k = ("sched" if schedule else "num"), k + 1
        cites, base, plain, end, sep = [], None, None, None, None
        while k < len(toks):
            if toks[k][0] == want:
                number = toks[k][1]
                got, n = marks(k + 1)
                cite = ("Schedule " if schedule else "") + number + got
                if sep == "to" and plain and not got and not schedule:
                    cites += _numbers(plain, number)
                else:
                    cites.append(cite + "".join(reversed(chain)))
                    chain = []
                parts = re.findall(r"\([^)]*\)", got)
                base, plain = ("Schedule " if schedule else "") + number + "".join(parts[:-1]), None if got else number
                end, k = toks[n - 1][3], n
            elif toks[k][0] == "mark" and base is not None and sep:
                got, n = marks(k)
                cites.append(base + got)
                plain, end, k = None, toks[n - 1][3], n
            else:
                break
            sep = None
            while k < len(toks) and toks[k][0] in ("join", "to") and k + 1 < len(toks) and toks[k + 1][0] in (want, "mark", "join", "to"):
                sep = "to" if toks[k][0] == "to" else "join"
                k += 1
            if sep is None:
                break
        if cites:
            act = _ACT.match(text, end, end + 180)
            out.append({"ref_type": "schedule" if schedule else "section", "surface": text[a:end], "citations": cites, "act_name": act.group(1) if act else None})
        i = max(k, i + 1)
    return out


def scan_references(text: Column | str) -> Column:
    return _per_text("array<struct<ref_type:string,surface:string,citations:array<string>,act_name:string>>", lambda texts: texts.map(references))(text)


# ---- numbers in words

_UNITS = {w: i for i, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
_TENS = {w: 10 * i for i, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_SCALES = {"hundred": 100, "thousand": 1_000, "lakh": 100_000, "crore": 10_000_000}


def words_to_numbers(text: str | None) -> list[int]:
    """Numbers written in words, in order, each once. "one" and "zero" alone are no numbers; a scale needs a value before it."""
    found: list[int] = []
    total = part = 0
    run: list[str] = []

    def close() -> None:
        nonlocal total, part, run
        while run and run[-1] == "and":
            run.pop()
        if run and run not in (["one"], ["zero"]) and (n := total + part) not in found:
            found.append(n)
        total, part, run = 0, 0, []

    for word in re.findall(r"[a-z]+|[^a-z\s-]", (text or "").lower()):
        word = word.removesuffix("s") if word in ("lakhs", "crores", "hundreds", "thousands") else word
        if word in _UNITS or word in _TENS:
            value = _UNITS.get(word, _TENS.get(word, 0))
            if run and run[-1] != "and" and run[-1] not in _SCALES and not (run[-1] in _TENS and 0 < value < 10):
                close()
            part += value
            run.append(word)
        elif word in _SCALES and run and (part or total):
            if word == "hundred":
                part *= 100
            else:
                total, part = (total + part) * _SCALES[word] if total and total < _SCALES[word] else total + part * _SCALES[word], 0
            run.append(word)
        elif word == "and" and run and run[-1] in _SCALES:
            run.append(word)
        else:
            close()
    close()
    return found


def word_numbers(text: Column | str) -> Column:
    return _per_text("array<bigint>", lambda texts: texts.map(words_to_numbers))(text)


# ---- arithmetic

_PART = re.compile(r"\s*(?:(\d[\d,]*(?:\.\d+)?)\s*(%|lakh|crore)?|([()])|([+\-−–×x*/÷]))", re.I)


def evaluate(expression: str | None) -> Decimal | None:
    """The value of an expression of + - × ÷ and brackets, with %, lakh and crore; None if it is malformed or divides by zero."""
    toks: list = []
    at, source = 0, (expression or "").strip()
    while at < len(source):
        m = _PART.match(source, at)
        if not m:
            return None
        at = m.end()
        if m.group(1):
            scale = {"%": Decimal("0.01"), "lakh": Decimal(100_000), "crore": Decimal(10_000_000)}.get((m.group(2) or "").lower(), Decimal(1))
            toks.append(Decimal(m.group(1).replace(",", "")) * scale)
        else:
            toks.append(m.group(3) or {"−": "-", "–": "-", "×": "*", "x": "*", "X": "*", "÷": "/"}.get(m.group(4), m.group(4)))
    values: list[Decimal] = []
    ops: list[str] = []
    rank = {"+": 1, "-": 1, "*": 2, "/": 2}
    value_next = True

    def apply() -> None:
        op, y, x = ops.pop(), values.pop(), values.pop()
        values.append(x + y if op == "+" else x - y if op == "-" else x * y if op == "*" else x / y)

    try:
        for t in toks:
            if isinstance(t, Decimal):
                if not value_next:
                    return None
                values.append(t)
                value_next = False
            elif t == "(":
                if not value_next:
                    return None
                ops.append(t)
            elif t == ")":
                if value_next:
                    return None
                while ops[-1] != "(":
                    apply()
                ops.pop()
            else:
                if value_next:
                    return None
                while ops and ops[-1] != "(" and rank[ops[-1]] >= rank[t]:
                    apply()
                ops.append(t)
                value_next = True
        if value_next:
            return None
        while ops:
            apply()
        return values[0] if len(values) == 1 else None
    except (IndexError, KeyError, InvalidOperation, ZeroDivisionError):
        return None


def eval_expr(text: Column | str) -> Column:
    return _per_text("double", lambda texts: texts.map(lambda t: None if (v := evaluate(t)) is None else float(v)).astype("float64"))(text)


# ---- nested markers

def _kinds(mark: str) -> list[tuple[str, int]]:
    """The alphabets a marker may belong to and its place in each."""
    out = []
    if mark.isdigit():
        return [("numeric", int(mark))]
    case = "lower" if mark.islower() else "upper" if mark.isupper() else None
    if case is None:
        return []
    low, value = mark.lower(), 0
    if set(low) <= set("ivxlc"):
        for a, b in zip(low, low[1:] + "\0"):
            x, y = (dict(i=1, v=5, x=10, l=50, c=100).get(z, 0) for z in (a, b))
            value += -x if x < y else x
        out.append((f"roman_{case}", value))
    if len(set(low)) == 1 and len(low) <= 3:
        out.append((f"alpha_{case}", (len(low) - 1) * 26 + ord(low[0]) - 96))
    return out


def outline(text: str | None, widest_gap: int = 2) -> list[dict]:
    """Lines with markers like (1), (a), (i) as a tree: line_no, mark, path, depth, anomaly. A marker goes on with the deepest open level
    whose alphabet it follows, by widest_gap places at most, or opens a new alphabet with its first place; else it is no marker."""
    out: list[dict] = []
    stack: list[tuple[str, int, str]] = []
    seen: set[str] = set()
    for n, line in enumerate((text or "").split("\n")):
        m = re.match(r"\s*\(([0-9A-Za-z]{1,4})\)\s", line)
        if not m:
            continue
        mark, kinds = m.group(1), _kinds(m.group(1))
        place = None
        for depth in range(len(stack) - 1, -1, -1):
            if fits := [(k, v) for k, v in kinds if k == stack[depth][0] and 0 < v - stack[depth][1] <= widest_gap]:
                place = (depth, fits[0])
                break
        if place is None and (opens := [(k, v) for k, v in kinds if v == 1 and k not in {s[0] for s in stack}]):
            place = (len(stack), opens[0])
        if place is None:
            out.append({"line_no": n, "mark": mark, "path": None, "depth": None, "anomaly": "not_a_marker"})
            continue
        stack = [*stack[: place[0]], (*place[1], mark)]
        path = "".join(f"({s[2]})" for s in stack)
        out.append({"line_no": n, "mark": mark, "path": path, "depth": len(stack), "anomaly": "duplicate_path" if path in seen else "too_deep" if len(stack) > 5 else None})
        seen.add(path)
    return out


def outlines(text: Column | str) -> Column:
    return _per_text("array<struct<line_no:int,mark:string,path:string,depth:int,anomaly:string>>", lambda texts: texts.map(outline))(text)
