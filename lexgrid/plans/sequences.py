"""Queries over ordered rows: lines of documents, messages of threads, events of users."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import sequences as S
from ..sources.tables import once, table
from .corpus import CHUNKS, chunks


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return S.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return once(table(spark, d, "turn_requests", "request_id", "thread_id", "user_id", "question", "created_at"), ["request_id"])


def line_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The numbered paragraph each line belongs to."""
    mark = F.regexp_extract("line", r"^\(([0-9]+)\) ", 1)
    l = _lines(spark, d).withColumn("mark", F.when(mark != "", mark))
    return l.select("doc_id", "line_no", S.carry_forward(F.col("mark"), "doc_id", "line_no").alias("paragraph")).filter("paragraph is not null")


def line_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The last line with text before each line and the first one after it, by length."""
    l = _lines(spark, d).withColumn("n", F.when(F.trim("line") != "", F.length("line")))
    return l.select("doc_id", "line_no", S.look_behind(F.col("n"), "doc_id", "line_no").alias("before"), S.look_ahead(F.col("n"), "doc_id", "line_no").alias("after"))


def line_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of lines of a table."""
    return S.islands(_lines(spark, d), "doc_id", "line_no", F.col("line").contains(" | "))


def section_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Ordinals that the live chunks of a corpus version lack: removed and damaged ones leave gaps."""
    c = chunks(spark, d, "corpus_version", "ordinal").select("corpus_version", F.col("ordinal").cast("bigint").alias("n")).filter("n is not null")
    return S.missing_numbers(c, "corpus_version", "n")


def window_fold(spark: SparkSession, d: str) -> DataFrame:
    """Lines in runs of 150 tokens or more."""
    l = table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    runs = S.windows(F.col("lines"), F.transform("lines", T.token_estimate), 150)
    return l.select("doc_id", F.explode(runs).alias("w")).select("doc_id", "w.*")


def rate_limit_batch(spark: SparkSession, d: str) -> DataFrame:
    """Turns beyond the first of a thread within 15 minutes or of a user within a day."""
    t = _turns(spark, d).filter("created_at is not null")
    t = t.withColumns({"in_thread": S.in_window(t, "thread_id", "created_at", 900), "of_user": S.in_window(t, "user_id", "created_at", 86400)})
    return t.filter("in_thread > 1 or (user_id is not null and of_user > 1)").select("request_id", "in_thread", "of_user")


def last_turns(spark: SparkSession, d: str) -> DataFrame:
    """The last three turns of each thread."""
    return S.last_rows(_turns(spark, d), "thread_id", [F.desc("created_at"), F.desc("request_id")], 3).select("thread_id", "request_id")


def first_seen_questions(spark: SparkSession, d: str) -> DataFrame:
    """When each question of a thread was first asked."""
    return S.first_seen(_turns(spark, d).filter("question is not null"), "thread_id", "question", "created_at")


def capped_lines(spark: SparkSession, d: str) -> DataFrame:
    """At most two example and five table lines of a document."""
    kind = F.when(F.col("line").contains(" | "), "table").when(F.col("line").contains("[eg]"), "example").otherwise("other")
    kept = S.cap_per_kind(_lines(spark, d).withColumn("kind", kind), "doc_id", "kind", "line_no", {"table": 5, "example": 2})
    return kept.groupBy("doc_id").agg(F.count("*").alias("lines"))


def empty_sections(spark: SparkSession, d: str) -> DataFrame:
    """Headings followed by a heading or by nothing."""
    head = F.col("line").rlike(r"^(TABLE|Q:|\([0-9]+\) )")
    l = _lines(spark, d).filter(F.trim("line") != "").withColumn("h", head)
    return l.withColumn("next", F.lead("h").over(Window.partitionBy("doc_id").orderBy("line_no"))).filter(F.col("h") & F.coalesce("next", F.lit(True))).select("doc_id", "line_no")


def fact_state(spark: SparkSession, d: str) -> DataFrame:
    """The fields of each user after all events: a purchase states a value, a click infers one."""
    e = table(spark, d, "events", "event_id", "ts", "user_id", "event_type", "value")
    e = e.withColumn("status", F.when(F.col("event_type") == "purchase", "stated").when(F.col("event_type") == "click", "inferred").otherwise("missing")).withColumn("field", F.pmod("event_id", F.lit(3)))
    return S.merge_facts(e, "user_id", "field", "status", ["ts", "event_id"]).select("user_id", "field", "status", "event_id")


def fact_overrides(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type")
    e = e.withColumn("status", F.when(F.col("event_type") == "purchase", "stated").when(F.col("event_type") == "click", "inferred").otherwise("missing")).withColumns({"field": F.pmod("event_id", F.lit(3)), "v": F.col("event_id")})
    return S.overrides(e, "user_id", "field", "status", "v", "event_id")


def chunk_stats(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of chunks per corpus version."""
    c = chunks(spark, d, "corpus_version", "text", "outgoing_refs").select("corpus_version", F.coalesce(T.token_estimate(F.col("text")), F.lit(0)).alias("n"), F.size("outgoing_refs").alias("r"))
    return c.groupBy("corpus_version").agg(F.count("*").alias("chunks"), F.sum("n").alias("total"), F.min("n").alias("minimum"), F.max("n").alias("maximum"), F.count_if(F.col("n") < 10).alias("small"), F.count_if(F.col("r") > 0).alias("with_refs"))


def percentile_rules(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "corpus_version", "text").select("corpus_version", T.token_estimate(F.col("text")).alias("n"))
    return E.percentiles(c, "n", ["corpus_version"])


def rater_kappa(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two length rules on documents, per source."""
    docs = table(spark, d, "documents", "source", "text", "n_chars").filter("text is not null")
    return docs.groupBy("source").agg(F.round(E.kappa(F.size(T.tokens(F.col("text"))) > 100, F.col("n_chars") > 600), 6).alias("kappa"))


def length_spearman(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "source", "text", "n_chars").select("source", F.size(T.tokens(F.col("text"))).alias("words"), "n_chars").filter("words >= 0")
    return E.spearman(docs, "words", "n_chars", ["source"]).withColumn("spearman", F.round("spearman", 6))


def prf_counts(spark: SparkSession, d: str) -> DataFrame:
    """Languages guessed by script against those given: right, wrong and missed, precision, recall and F1 of each and overall."""
    docs = table(spark, d, "documents", "doc_id", "lang", "text")
    given = docs.filter("lang is not null").select("doc_id", F.lower(F.substring("lang", 1, 2)).alias("lang"))
    guess = F.when(F.col("text").rlike(r"\p{IsHiragana}"), "ja").when(F.col("text").rlike(r"\p{IsDevanagari}"), "hi").when(F.col("text").rlike(r"\p{IsCyrillic}"), "ru").otherwise("en")
    found = docs.filter("text is not null").select("doc_id", guess.alias("lang"))
    return E.counts(given.withColumn("is", F.lit(True)), found.withColumn("is", F.lit(True)), ["doc_id", "lang"], "is")


_LINES = "(SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"
_TURNS = "(SELECT request_id, min(thread_id) AS thread_id, min(user_id) AS user_id, min(question) AS question, min(created_at) AS created_at FROM turn_requests GROUP BY 1)"
_EST = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]'))"
_TOKN = "len(regexp_extract_all(" + T.folded_sql("translate(text, chr(160) || chr(173), ' ')") + ", '[a-z0-9]+'))"
_FACTS = "(SELECT event_id, ts, user_id, event_id % 3 AS field, CASE event_type WHEN 'purchase' THEN 'stated' WHEN 'click' THEN 'inferred' ELSE 'missing' END AS status FROM events)"
_PCT = ", ".join(f"min(n) FILTER (upto > {p}) AS {k}_{round(q * 100)}" for q in (0.5, 0.9, 0.95, 0.99) for k, p in (("floor", f"least(floor({q} * c), c - 1)"), ("even", f"round_even({q} * (c - 1), 0)"), ("ceil", f"ceil({q} * c) - 1")))
SQL = {
    "line_carry_forward": rf"SELECT * FROM (SELECT doc_id, line_no, last_value(nullif(regexp_extract(line, '^\(([0-9]+)\) ', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no) AS paragraph FROM {_LINES}) WHERE paragraph IS NOT NULL",
    "line_neighbours": f"SELECT doc_id, line_no, last_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, first_value(n IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM (SELECT doc_id, line_no, CASE WHEN trim(line, ' ') <> '' THEN CAST(length(line) AS INT) END AS n FROM {_LINES})",
    "line_islands": f"SELECT doc_id, min(line_no) AS first, max(line_no) AS last, count(*) AS rows FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS g FROM {_LINES} WHERE contains(line, ' | ')) GROUP BY doc_id, g",
    "section_gaps": f"WITH c AS (SELECT DISTINCT corpus_version, CAST(ordinal AS BIGINT) AS n FROM {CHUNKS}), m AS (SELECT corpus_version, max(n) AS m FROM c GROUP BY 1) SELECT corpus_version, unnest(generate_series(1, m)) AS number FROM m EXCEPT SELECT corpus_version, n FROM c",
    "rate_limit_batch": f"""SELECT request_id, in_thread, of_user FROM (SELECT *, count(*) OVER (PARTITION BY thread_id ORDER BY epoch_us(created_at) RANGE BETWEEN 899999999 PRECEDING AND CURRENT ROW) AS in_thread, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(created_at) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS of_user FROM {_TURNS} WHERE created_at IS NOT NULL) WHERE in_thread > 1 OR (user_id IS NOT NULL AND of_user > 1)""",
    "last_turns": f"SELECT thread_id, request_id FROM {_TURNS} QUALIFY row_number() OVER (PARTITION BY thread_id ORDER BY created_at DESC, request_id DESC) <= 3",
    "first_seen_questions": f"SELECT thread_id, question, min(created_at) AT TIME ZONE 'UTC' AS created_at FROM {_TURNS} WHERE question IS NOT NULL GROUP BY ALL",
    "capped_lines": f"SELECT doc_id, count(*) AS lines FROM (SELECT doc_id, CASE WHEN contains(line, ' | ') THEN 'table' WHEN contains(line, '[eg]') THEN 'example' ELSE 'other' END AS kind, row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) AS r FROM {_LINES}) WHERE r <= CASE kind WHEN 'table' THEN 5 WHEN 'example' THEN 2 ELSE 1000000 END GROUP BY 1",
    "empty_sections": rf"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, h, lead(h) OVER (PARTITION BY doc_id ORDER BY line_no) AS n FROM (SELECT *, regexp_matches(line, '^(TABLE|Q:|\([0-9]+\) )') AS h FROM {_LINES} WHERE trim(line, ' ') <> '')) WHERE h AND coalesce(n, true)",
    "fact_state": f"SELECT user_id, field, status, event_id FROM {_FACTS} WHERE status <> 'missing' QUALIFY row_number() OVER (PARTITION BY user_id, field ORDER BY status = 'stated' DESC, ts DESC, event_id DESC) = 1",
    "fact_overrides": f"""WITH a AS (SELECT *, coalesce(max(CAST(status = 'stated' AS INT)) OVER (PARTITION BY user_id, field ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {_FACTS} WHERE status <> 'missing')
        SELECT * FROM (SELECT user_id, field, event_id, lag(event_id) OVER w AS was, event_id AS now FROM a WHERE status = 'stated' OR s = 0 WINDOW w AS (PARTITION BY user_id, field ORDER BY event_id)) WHERE was IS NOT NULL""",
    "chunk_stats": f"SELECT corpus_version, count(*) AS chunks, sum(n) AS total, CAST(min(n) AS INT) AS minimum, CAST(max(n) AS INT) AS maximum, count(*) FILTER (n < 10) AS small, count(*) FILTER (r > 0) AS with_refs FROM (SELECT corpus_version, coalesce({_EST}, 0) AS n, len(outgoing_refs) AS r FROM {CHUNKS}) GROUP BY 1",
    "percentile_rules": f"WITH x AS (SELECT corpus_version, CAST({_EST} AS INT) AS n FROM {CHUNKS} WHERE text IS NOT NULL), y AS (SELECT *, row_number() OVER (PARTITION BY corpus_version ORDER BY n) AS upto, count(*) OVER (PARTITION BY corpus_version) AS c FROM x) SELECT corpus_version, {_PCT} FROM y GROUP BY 1",
    "rater_kappa": f"WITH t AS (SELECT source, avg(CAST(a = b AS INT)) AS o, avg(CAST(a AS INT)) AS p, avg(CAST(b AS INT)) AS q FROM (SELECT source, {_TOKN} > 100 AS a, n_chars > 600 AS b FROM documents WHERE text IS NOT NULL) GROUP BY 1) SELECT source, round(CASE WHEN p * q + (1 - p) * (1 - q) = 1 THEN 1.0 ELSE (o - (p * q + (1 - p) * (1 - q))) / (1 - (p * q + (1 - p) * (1 - q))) END, 6) AS kappa FROM t",
    "prf_counts": r"""WITH g AS (SELECT doc_id, lower(left(lang, 2)) AS lang FROM documents WHERE lang IS NOT NULL),
        f AS (SELECT doc_id, CASE WHEN regexp_matches(text, '\p{Hiragana}') THEN 'ja' WHEN regexp_matches(text, '\p{Devanagari}') THEN 'hi' WHEN regexp_matches(text, '\p{Cyrillic}') THEN 'ru' ELSE 'en' END AS lang FROM documents WHERE text IS NOT NULL),
        j AS (SELECT coalesce(g.lang, f.lang) AS lang, g.doc_id IS NOT NULL AS a, f.doc_id IS NOT NULL AS b FROM g FULL JOIN f ON g.doc_id = f.doc_id AND g.lang = f.lang),
        c AS (SELECT coalesce(lang, 'all') AS lang, count(*) FILTER (a AND b) AS tp, count(*) FILTER (b AND NOT a) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM j GROUP BY ROLLUP (lang))
        SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""",
    "length_spearman": f"WITH x AS (SELECT source, {_TOKN} AS a, n_chars AS b FROM documents WHERE text IS NOT NULL), r AS (SELECT source, rank() OVER (PARTITION BY source ORDER BY a) + (count(*) OVER (PARTITION BY source, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY source ORDER BY b) + (count(*) OVER (PARTITION BY source, b) - 1) / 2.0 AS rb FROM x) SELECT source, round(corr(ra, rb), 6) AS spearman FROM r GROUP BY 1",
}
QUERIES = {q.__name__: q for q in (line_carry_forward, line_neighbours, line_islands, section_gaps, window_fold, rate_limit_batch, last_turns, first_seen_questions, capped_lines, empty_sections, fact_state, fact_overrides, chunk_stats, percentile_rules, rater_kappa, length_spearman, prf_counts)}
