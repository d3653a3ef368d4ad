"""Queries over selection, layout and tables inside texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..operators import joins as J
from ..operators import selection as X
from ..operators import sequences as S
from ..session import materialize
from ..sources.tables import once, table
from . import grounding, retrieval
from .corpus import CHUNKS, chunks

NEGATIVE, AFFIRMATIVE = r"(?i)\b(?:shall not|need not|may not|cannot|must not)\b", r"(?i)\b(?:shall|must|may|is entitled to|is required to)\b"

#: What is no text of its own in these documents: whole lines, and how lines begin.
FURNITURE, STARTS = ["TABLE"], ["Sl. No. |"]


def subtree_layout(spark: SparkSession, d: str) -> DataFrame:
    """Where each chunk's text begins and ends in the text of its root's subtree, joined by new lines in document order; empty texts are skipped."""
    c = chunks(spark, d, "corpus_version", "node_path", "ordinal", "text").filter(P.parts(F.col("node_path")).isNotNull() & (F.length("text") > 0))
    c = c.select("corpus_version", "chunk_id", P.parts(F.col("node_path"))[0].alias("root"), "ordinal", F.length("text").alias("n"))
    order = Window.partitionBy("corpus_version", "root").orderBy("ordinal", "chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("n") + 1).over(order), F.lit(0))
    return c.select("chunk_id", "root", start.alias("char_start"), (start + F.col("n")).alias("char_end"))


def heading_probe(spark: SparkSession, d: str) -> DataFrame:
    """Lines that look like headings by one cue or another, with the cues."""
    l = S.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    cues = {"number": F.col("line").rlike(r"^\([0-9]+\) "), "capitals": F.col("line").rlike(r"^[A-Z][A-Z .]{3,}$"), "question": F.col("line").startswith("Q:")}
    found = l.withColumn("cue", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in cues.items()]))))
    return found.groupBy("doc_id", "line_no").agg(F.array_join(F.array_sort(F.collect_set("cue")), ",").alias("cues"))


def table_cells(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the tables in documents, by line and column."""
    l = S.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").filter(F.col("line").contains(" | "))
    return l.select("doc_id", "line_no", F.posexplode(F.split("line", r" \| ")).alias("column", "cell"))


def modal_lines(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that forbid or excuse, and those that oblige or allow, per version."""
    t = F.col("text")
    c = chunks(spark, d, "corpus_version", "text").filter("text is not null")
    return c.groupBy("corpus_version").agg(F.count_if(t.rlike(NEGATIVE)).alias("negative"), F.count_if(t.rlike(AFFIRMATIVE) & ~t.rlike(NEGATIVE)).alias("affirmative"))


def miss_causes(spark: SparkSession, d: str) -> DataFrame:
    """Why wanted paths are not among the first ten: found, ranking (11 to 20), granularity (an ancestor was found), recall."""
    gold = materialize(retrieval._gold(spark, d))
    run = materialize(retrieval._bm25(spark, d, 20, of=gold).join(retrieval._paths(spark, d), "item_id").groupBy("query_id", "path").agg(F.min("rank").alias("rank")))
    exact = gold.join(run.withColumnRenamed("path", "required"), ["query_id", "required"], "left")
    above = gold.withColumn("path", F.explode(P.prefixes(F.col("required")))).filter("path <> required").join(run.filter("rank <= 10"), ["query_id", "path"]).select("query_id", "required", F.lit(True).alias("above")).distinct()
    cause = F.when(F.col("rank") <= 10, "found").when(F.col("above"), "granularity").when(F.col("rank") <= 20, "ranking").otherwise("recall")
    return exact.join(above, ["query_id", "required"], "left").groupBy(cause.alias("cause")).agg(F.count("*").alias("wanted"))


def furniture_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents that belong to a page's head or foot, by the lists of this corpus, which name the heads of its tables."""
    lines = S.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return lines.filter(T.is_furniture(F.col("line"), FURNITURE, STARTS)).select("doc_id", "line_no")


def root_shares(spark: SparkSession, d: str) -> DataFrame:
    """In what share of the root chunks each glossary term stands, with all its words in a row."""
    terms = materialize(grounding.glossary(spark, d).select("term", T.tokens(F.col("term")).alias("words")))
    roots = chunks(spark, d, "node_path", "text").filter(~F.col("node_path").contains("("))
    n = roots.agg(F.count("*").alias("roots"))
    hit = J.phrase_hits(roots.select(T.tokens(F.coalesce("text", F.lit(""))).alias("words")), terms).groupBy("term").agg(F.count("*").alias("hits"))
    each = terms.select("term").join(hit, "term", "left").join(F.broadcast(n))  # one row
    return each.select("term", F.round(F.coalesce("hits", F.lit(0)) / F.col("roots"), 6).alias("share"))


def fold_metrics(spark: SparkSession, d: str) -> DataFrame:
    """The retrieval metrics of the two folds of questions with gold, by the parity of their numbers."""
    scores = retrieval.retrieval_metrics(spark, d)
    fold = F.when(F.regexp_extract("query_id", "([0-9]+)$", 1).cast("bigint") % 2 == 0, "even").otherwise("odd")
    return scores.groupBy(fold.alias("fold")).agg(F.count("*").alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "mrr", "ndcg")])


def outliers(spark: SparkSession, d: str) -> DataFrame:
    """Live chunks of more than 500 tokens, and why they are that long: damaged trees first, then roots, then nodes between."""
    c = chunks(spark, d, "parent_id", "node_path", "text").withColumn("tokens", T.token_estimate(F.coalesce("text", F.lit(""))))
    reason = F.when(P.parts(F.col("node_path")).isNull(), "untrusted").when(F.coalesce(F.trim("parent_id"), F.lit("")) == "", "root").otherwise("between")
    return c.filter("tokens > 500").select("chunk_id", "tokens", reason.alias("reason"))


def fact_checks(spark: SparkSession, d: str) -> DataFrame:
    """The first check that each fact of the labelled turns fails, or none."""
    turns = once(table(spark, d, "labelled_turns", "turn_id", "turn", "facts"), ["turn_id"])
    f = turns.select("turn_id", "turn", F.posexplode("facts").alias("pos", "f")).select("turn_id", "turn", "pos", "f.*")
    again = F.row_number().over(Window.partitionBy("turn_id", "name").orderBy("pos"))
    value = F.regexp_replace("value", "^-", "")
    checks = {
        "malformed_entry": F.col("name").isNotNull() & F.col("value").isNotNull(), "duplicate_field": F.col("again") == 1, "bad_status": F.col("status").isin("stated", "inferred"),
        "span_not_in_turn": F.lower("turn").contains(F.lower(value)), "unparsable_value": T.money(F.col("value")).isNotNull() | T.tax_year(F.col("value")).isNotNull() | F.col("value").rlike("^[0-9]+$"),
    }
    return f.withColumn("again", again).select("turn_id", "pos", F.coalesce(X.first_failing(checks), F.lit("accepted")).alias("outcome"))


def merged_titles(spark: SparkSession, d: str) -> DataFrame:
    """A title for each section: the root's own, else the chapter's."""
    c = chunks(spark, d, "corpus_version", "section_number", "root_title", "chapter_title").filter("section_number is not null")
    own, chapter = (c.filter(F.col(t).isNotNull()).groupBy("corpus_version", "section_number").agg(F.min(t).alias("title")) for t in ("root_title", "chapter_title"))
    return X.first_source(["corpus_version", "section_number"], own, chapter)


def event_rates(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "value", "user_id")
    return X.rates(e, ["event_type"], {"large": (F.col("value") > 50, F.col("value").isNotNull()), "of_low_users": (F.col("user_id") < 100, F.lit(True))})


_LINES = "(SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"
_ROOT = "regexp_extract(node_path, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})', 1)"
_VALID = r"regexp_matches(node_path, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})(\([0-9A-Za-z]+\))*$')"
_R = retrieval
_MONEY = r"'^\s*(-?)\s*(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(lakh|crore|cr|k)?(?:\s*rupees)?\s*$'"
SQL = {
    "subtree_layout": f"SELECT chunk_id, root, s AS char_start, s + n AS char_end FROM (SELECT *, coalesce(sum(n + 1) OVER (PARTITION BY corpus_version, root ORDER BY ordinal, chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM (SELECT chunk_id, corpus_version, {_ROOT} AS root, ordinal, length(text) AS n FROM {CHUNKS} WHERE {_VALID} AND length(text) > 0))",
    "furniture_lines": f"SELECT doc_id, line_no FROM {_LINES}, (SELECT 1) WHERE trim(replace(translate(line, chr(160) || chr(173), ' '), chr(9), ' ')) IN ({', '.join(repr(x) for x in FURNITURE)}) OR {' OR '.join(f'starts_with(trim(replace(translate(line, chr(160) || chr(173), {chr(39)} {chr(39)}), chr(9), {chr(39)} {chr(39)})), {x!r})' for x in STARTS)}",
    "fold_metrics": _R._MET + " SELECT CASE WHEN CAST(regexp_extract(query_id, '([0-9]+)$', 1) AS BIGINT) % 2 = 0 THEN 'even' ELSE 'odd' END AS fold, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM met GROUP BY 1",
    "outliers": rf"SELECT chunk_id, CAST(t AS INT) AS tokens, CASE WHEN NOT coalesce({_VALID}, false) THEN 'untrusted' WHEN coalesce(trim(parent_id), '') = '' THEN 'root' ELSE 'between' END AS reason FROM (SELECT *, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]')) AS t FROM {CHUNKS}) WHERE t > 500",
    "heading_probe": rf"SELECT doc_id, line_no, concat_ws(',', CASE WHEN regexp_matches(line, '^[A-Z][A-Z .]{{3,}}$') THEN 'capitals' END, CASE WHEN regexp_matches(line, '^\([0-9]+\) ') THEN 'number' END, CASE WHEN line LIKE 'Q:%' THEN 'question' END) AS cues FROM {_LINES} WHERE cues <> ''",
    "table_cells": f"""SELECT doc_id, line_no, CAST(generate_subscripts(c, 1) - 1 AS INT) AS "column", unnest(c) AS cell FROM (SELECT doc_id, line_no, string_split(line, ' | ') AS c FROM {_LINES} WHERE contains(line, ' | '))""",
    "modal_lines": rf"SELECT corpus_version, count(*) FILTER (n) AS negative, count(*) FILTER (a AND NOT n) AS affirmative FROM (SELECT corpus_version, regexp_matches(text, '(?i)\b(?:shall not|need not|may not|cannot|must not)\b') AS n, regexp_matches(text, '(?i)\b(?:shall|must|may|is entitled to|is required to)\b') AS a FROM {CHUNKS} WHERE text IS NOT NULL) GROUP BY 1",
    "miss_causes": f"""WITH {_R._BM}, {_R._KN}, {_R._PATHS}, {_R._GOLD}, {_R._WAYS}, run AS (SELECT query_id, path, min(rank) AS rank FROM bm JOIN paths USING (item_id) WHERE rank <= 20 GROUP BY ALL),
        a AS (SELECT DISTINCT w.query_id, w.required FROM ways w JOIN run r ON r.query_id = w.query_id AND r.path = w.path WHERE w.path <> w.required AND r.rank <= 10)
        SELECT CASE WHEN r.rank <= 10 THEN 'found' WHEN a.required IS NOT NULL THEN 'granularity' WHEN r.rank <= 20 THEN 'ranking' ELSE 'recall' END AS cause, count(*) AS wanted
        FROM gold g LEFT JOIN run r ON r.query_id = g.query_id AND r.path = g.required LEFT JOIN a ON a.query_id = g.query_id AND a.required = g.required GROUP BY 1""",
    "fact_checks": f"""WITH f AS (SELECT turn_id, turn, CAST(generate_subscripts(facts, 1) - 1 AS INT) AS pos, unnest(facts) AS f FROM (SELECT turn_id, any_value(turn) AS turn, any_value(facts) AS facts FROM labelled_turns GROUP BY 1)),
        n AS (SELECT *, row_number() OVER (PARTITION BY turn_id, f.name ORDER BY pos) AS again FROM f)
        SELECT turn_id, pos, CASE WHEN f.name IS NULL OR f.value IS NULL THEN 'malformed_entry' WHEN again > 1 THEN 'duplicate_field' WHEN coalesce(f.status, '') NOT IN ('stated', 'inferred') THEN 'bad_status'
        WHEN NOT coalesce(contains(lower(turn), lower(regexp_replace(f.value, '^-', ''))), false) THEN 'span_not_in_turn' WHEN NOT (regexp_matches(lower(f.value), {_MONEY}) OR regexp_matches(f.value, '^[0-9]+$')
        OR (regexp_matches(trim(f.value), '^[0-9]{{4}}-([0-9]{{2}})?[0-9]{{2}}$') AND (TRY_CAST(left(trim(f.value), 4) AS INT) + 1) % 100 = TRY_CAST(right(trim(f.value), 2) AS INT))) THEN 'unparsable_value' ELSE 'accepted' END AS outcome FROM n""",
    "merged_titles": f"WITH c AS (SELECT corpus_version, section_number, min(root_title) AS r, min(chapter_title) AS t FROM {CHUNKS} WHERE section_number IS NOT NULL GROUP BY ALL) SELECT corpus_version, section_number, coalesce(r, t) AS title, CASE WHEN r IS NOT NULL THEN 0 ELSE 1 END AS source FROM c WHERE coalesce(r, t) IS NOT NULL",
    "event_rates": "SELECT event_type, count(*) AS rows, round(count(*) FILTER (value > 50) / nullif(count(value), 0), 6) AS large, round(count(*) FILTER (user_id < 100) / count(*), 6) AS of_low_users FROM events GROUP BY 1",
}
QUERIES = {q.__name__: q for q in (subtree_layout, furniture_lines, root_shares, fold_metrics, outliers, heading_probe, table_cells, modal_lines, miss_causes, fact_checks, merged_titles, event_rates)}
