"""Splitting oversized texts at natural boundaries.

A text of more than `limit` tokens is cut into consecutive pieces of at most `limit` tokens; each piece after the first
begins with the last `overlap` tokens before its core. Agglomerative merging: the atoms are clauses (single tokens where
a clause alone is too long); adjacent pairs lie in a heap by the strength of the boundary between them and the weakest
boundary is merged first while the combined size plus the overlap fits, so the cuts that stay are the strongest.

Tokens are runs of Unicode letters, digits and underscores, and single other signs that are no white space. The cores of
a text's pieces, joined, are the text again, white space included.

Defined results: null, empty and blank texts give no piece; a text within the limit gives one piece; the smallest unit
is one token, so a run of letters longer than any limit is still one token; ties go to the smaller combined size, then to the left.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One token, for Java's regular expressions; TOKEN says the same for Python's.
JAVA_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x85\p{Z}]"
TOKEN = re.compile(r"\w+|[^\w\s]")
#: The strengths of boundaries, from none to a blank line.
NONE, WORD, CLAUSE, SENTENCE, LINE, PARAGRAPH = range(6)
NAMES = ["none", "word", "clause", "sentence", "line", "paragraph", "end"]
SENTENCE_END, CLAUSE_END = frozenset(".!?…।॥؟"), frozenset(",;:)]}—–”’»")
WIDE_SENTENCE_END, WIDE_CLAUSE_END = frozenset("。！？"), frozenset("、，；：」』")
PIECE = "piece int, start_char bigint, core_char bigint, end_char bigint, tokens int, boundary string, text string"


def token_count(text: Column) -> Column:
    """Tokens of a text; null for null."""
    return F.regexp_count(text, F.lit(JAVA_TOKEN))


def _strength(last: str, gap: str) -> int:
    if "\n" in gap:
        return PARAGRAPH if gap.count("\n") > 1 else LINE
    if last in WIDE_SENTENCE_END:
        return SENTENCE
    if last in WIDE_CLAUSE_END:
        return CLAUSE
    if not gap:
        return NONE
    return SENTENCE if last in SENTENCE_END else CLAUSE if last in CLAUSE_END else WORD


def cores(text: str, spans: list[tuple[int, int]], room: int) -> tuple[list[int], list[int]]:
    """First tokens of the cores, and the strength of the boundary before each; no core has more than room tokens."""
    n = len(spans)
    strong = [PARAGRAPH] + [_strength(text[spans[i - 1][1] - 1], text[spans[i - 1][1] : spans[i][0]]) for i in range(1, n)]
    first = [i for i in range(n) if i == 0 or strong[i] >= CLAUSE]
    atoms: list[int] = []
    for a, b in zip(first, [*first[1:], n]):
        atoms += range(a, b) if b - a > room else (a,)
    m = len(atoms)
    size = [b - a for a, b in zip(atoms, [*atoms[1:], n])]
    left, right, alive = list(range(-1, m - 1)), [*range(1, m), -1], [True] * m
    heap = [(strong[atoms[i]], size[i - 1] + size[i], i) for i in range(1, m)]  # i: the right atom of the pair
    heapq.heapify(heap)
    while heap:
        _, both, i = heapq.heappop(heap)
        if not alive[i] or (k := left[i]) < 0:
            continue
        now = size[k] + size[i]
        if now > room:
            continue  # sizes only grow: this boundary stays
        if now != both:
            heapq.heappush(heap, (strong[atoms[i]], now, i))
            continue
        size[k], alive[i], right[k] = now, False, right[i]
        if right[i] >= 0:
            left[right[i]] = k
    return [atoms[i] for i in range(m) if alive[i]], [strong[atoms[i]] for i in range(m) if alive[i]]


def split(text: str | None, limit: int, overlap: int) -> Iterator[tuple]:
    """Pieces of one text, as PIECE has them; boundary is the one at the piece's end."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be less than the limit")
    spans = [m.span() for m in TOKEN.finditer(text or "")]
    n = len(spans)
    if not n:
        return
    starts, strong = ([0], [PARAGRAPH]) if n <= limit else cores(text, spans, limit - overlap)
    for k, a in enumerate(starts):
        b = starts[k + 1] if k + 1 < len(starts) else n
        core = spans[a][0] if k else 0
        end = spans[b][0] if b < n else len(text)
        since = max(0, a - overlap) if k else 0
        begin = spans[since][0] if k else 0
        yield k, begin, core, end, b - since, NAMES[strong[k + 1]] if b < n else "end", text[begin:end]


def split_texts(df: DataFrame, key: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """key columns and PIECE columns, one row per piece. Only texts over the limit go through Python; the key must name unique rows."""
    counted = df.select(*key, F.col(text).alias("_text"), token_count(F.col(text)).alias("_n"))
    kind = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([f"`{c}` {kind[c]}" for c in key] + [PIECE])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*key, *[x.split()[0] for x in PIECE.split(", ")]]
        for pdf in batches:
            yield pd.DataFrame([(*r[:-1], *p) for r in pdf.itertuples(index=False, name=None) for p in split(r[-1], limit, overlap)], columns=columns)

    long = counted.filter(F.col("_n") > limit).select(*key, "_text").mapInPandas(run, schema)
    size = F.length("_text").cast("bigint")
    zero = F.lit(0).cast("bigint")
    short = counted.filter((F.col("_n") > 0) & (F.col("_n") <= limit)).select(
        *key, F.lit(0).alias("piece"), zero.alias("start_char"), zero.alias("core_char"), size.alias("end_char"),
        F.col("_n").cast("int").alias("tokens"), F.lit("end").alias("boundary"), F.col("_text").alias("text"),
    )
    return long.unionByName(short)
