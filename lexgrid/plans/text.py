"""Queries over the scalar text and path functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..sources.tables import once, table
from .corpus import CHUNKS, QUESTIONS, chunks, questions


def tokenize_stats(spark: SparkSession, d: str) -> DataFrame:
    t = T.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.size("t").alias("n"), F.size(F.array_distinct("t")).alias("kinds"), F.try_element_at("t", F.lit(1)).alias("first")).filter("n >= 0")


def plural_terms(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", F.array_join(T.terms(F.col("question")), " ").alias("terms"))


def token_estimates(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "text", "token_count").select("chunk_id", T.token_estimate(F.col("text")).alias("estimate"), "token_count")


def grouped_tokens(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", F.array_join(T.grouped_tokens(F.col("question")), " ").alias("grouped"))


def squashed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length(T.squash(F.col("text"))).alias("signs"))


def redact_counts(spark: SparkSession, d: str) -> DataFrame:
    turns = once(table(spark, d, "turn_requests", "request_id", "question"), ["request_id"])
    return turns.select("request_id", T.redact(F.col("question")).alias("masked")).filter(F.col("masked").rlike(r"\[(PAN|AADHAAR|ACCOUNT)\]"))


def defined_terms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", T.defined_term(F.col("text")).alias("term")).filter("term is not null")


def omitted_only(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "corpus_version", "text").groupBy("corpus_version").agg(F.count_if(T.omitted_only(F.col("text"))).alias("omitted"), F.count("*").alias("chunks"))


def numbers(spark: SparkSession, d: str) -> DataFrame:
    n = T.numbers_in(F.col("question"))
    return questions(spark, d).select("query_id", F.size(n).alias("n"), F.aggregate(n, F.lit(0).cast("decimal(38,6)"), lambda s, x: (s + x).cast("decimal(38,6)")).cast("double").alias("total"))


def fact_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Facts of the labelled turns, their amounts and tax years parsed."""
    turns = once(table(spark, d, "labelled_turns", "turn_id", "facts"), ["turn_id"])
    facts = turns.select("turn_id", F.posexplode("facts").alias("pos", "f"))
    return facts.select("turn_id", "pos", F.col("f.name").alias("name"), F.col("f.status").alias("status"), T.money(F.col("f.value")).cast("double").alias("amount"), T.tax_year(F.col("f.value")).alias("tax_year"))


def content_words(spark: SparkSession, d: str) -> DataFrame:
    return questions(spark, d).select("query_id", F.array_join(F.array_sort(T.content_words(F.col("question"))), " ").alias("words"))


def line_types(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return lines.groupBy("doc_id", T.line_type(F.col("line")).alias("line_type")).agg(F.count("*").alias("lines"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d, "corpus_version", "node_path", "text").select("chunk_id", T.chunk_id(F.col("corpus_version"), F.col("node_path"), F.coalesce("text", F.lit(""))).alias("derived"))


def breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    c = chunks(spark, d, "chapter_numeral", "chapter_title", "node_path", "root_title")
    return c.select("chunk_id", P.breadcrumb(F.col("chapter_numeral"), F.col("chapter_title"), F.col("node_path"), F.col("root_title")).alias("breadcrumb"))


def path_algebra(spark: SparkSession, d: str) -> DataFrame:
    p = F.col("node_path")
    return chunks(spark, d, "node_path").select("chunk_id", P.depth(p).alias("depth"), P.parent(p).alias("above"), P.parts(p)[0].alias("root"), P.too_deep(p).alias("too_deep"))


def canonical_paths(spark: SparkSession, d: str) -> DataFrame:
    refs = once(table(spark, d, "cross_references", "ref_id", "target_path"), ["ref_id"])
    return refs.select("ref_id", P.canonical(F.col("target_path")).alias("path")).filter("path is not null")


def stub_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = T.stub_embedding("query", F.col("question"))
    return questions(spark, d).select("query_id", F.round(v[0], 6).alias("v0"), F.round(v[31], 6).alias("v31"))


_N = "translate(text, chr(160) || chr(173), ' ')"
_T = "regexp_extract_all(" + T.folded_sql("{x}") + ", '[a-z0-9]+')"
_TOK = _T.format(x=_N)
_QTOK = _T.format(x="translate(question, chr(160) || chr(173), ' ')")
_EST = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]'))"
_ROOT = "regexp_extract(node_path, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})', 1)"
_VALID = r"regexp_matches(node_path, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})(\([0-9A-Za-z]+\))*$')"
_STOP = ", ".join(f"'{w}'" for w in T.STOPWORDS)

SQL = {
    "tokenize_stats": f"SELECT doc_id, CAST(len({_TOK}) AS INT) AS n, CAST(len(list_distinct({_TOK})) AS INT) AS kinds, {_TOK}[1] AS first FROM documents WHERE text IS NOT NULL",
    "plural_terms": f"SELECT query_id, coalesce(array_to_string([CASE WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN t[:-2] ELSE t END FOR t IN {_QTOK}], ' '), '') AS terms FROM {QUESTIONS}",
    "token_estimates": f"SELECT chunk_id, CAST({_EST} AS INT) AS estimate, token_count FROM {CHUNKS}",
    "squashed": rf"SELECT doc_id, CAST(length(regexp_replace({_N}, '[\s\x0b]+', '', 'g')) AS INT) AS signs FROM documents",
    "redact_counts": r"""SELECT request_id, m AS masked FROM (SELECT request_id, regexp_replace(regexp_replace(regexp_replace(q, '\b[A-Z]{5}[0-9]{4}[A-Z]\b', '[PAN]', 'g'),
        '\b[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}\b', '[AADHAAR]', 'g'), '\b[0-9]{9,18}\b', '[ACCOUNT]', 'g') AS m FROM (SELECT request_id, min(question) AS q FROM turn_requests GROUP BY 1)) WHERE regexp_matches(m, '\[(PAN|AADHAAR|ACCOUNT)\]')""",
    "defined_terms": rf"""SELECT doc_id, term FROM (SELECT doc_id, regexp_extract(regexp_replace(trim(list_filter(string_split({_N}, chr(10)), lambda x: trim(x) <> '')[1]), '^\([0-9]{{1,3}}[A-Za-z]{{0,3}}\)\s*', ''), '^["“]([^"“”]{{1,80}})["”]', 1) AS term FROM documents) WHERE term <> ''""",
    "omitted_only": rf"SELECT corpus_version, count(*) FILTER (regexp_matches(trim(regexp_replace(text, '[\s\x0b]+', ' ', 'g')), '^[^\s]*\s*\[\*\*\*\]$')) AS omitted, count(*) AS chunks FROM {CHUNKS} GROUP BY 1",
    "numbers": rf"""WITH n AS (SELECT query_id, list_distinct([CAST(regexp_replace(s, '[^0-9.]', '', 'g') AS DECIMAL(26,6)) * CASE WHEN s LIKE '%lakh' THEN 100000 WHEN s LIKE '%crore' THEN 10000000 ELSE 1 END
        FOR s IN regexp_extract_all(lower(question), '[0-9][0-9,]*(?:\.[0-9]+)*(?: ?(?:lakh|crore))?') IF TRY_CAST(regexp_replace(s, '[^0-9.]', '', 'g') AS DECIMAL(26,6)) IS NOT NULL]) AS v FROM {QUESTIONS})
        SELECT query_id, CAST(len(v) AS INT) AS n, CAST(coalesce(list_sum(v), 0) AS DOUBLE) AS total FROM n""",
    "fact_amounts": r"""WITH f AS (SELECT turn_id, CAST(generate_subscripts(facts, 1) - 1 AS INT) AS pos, unnest(facts) AS f FROM (SELECT turn_id, any_value(facts) AS facts FROM labelled_turns GROUP BY 1)),
        p AS (SELECT *, lower(f.value) AS v, '^\s*(-?)\s*(?:rs\.?|inr|₹)?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(lakh|crore|cr|k)?(?:\s*rupees)?\s*$' AS m, '^([0-9]{4})-(?:[0-9]{2})?([0-9]{2})$' AS y FROM f),
        q AS (SELECT *, regexp_extract(v, m, 2) AS d, regexp_extract(v, m, 3) AS u, regexp_extract(trim(f.value), y, 1) AS a, regexp_extract(trim(f.value), y, 2) AS b FROM p)
        SELECT turn_id, pos, f.name AS name, f.status AS status, CAST(CASE WHEN d <> '' THEN (CASE WHEN regexp_extract(v, m, 1) = '-' THEN -1 ELSE 1 END) * CAST(replace(d, ',', '') AS DECIMAL(24,4)) * (CASE u WHEN 'lakh' THEN 100000 WHEN 'crore' THEN 10000000 WHEN 'cr' THEN 10000000 WHEN 'k' THEN 1000 ELSE 1 END) END AS DOUBLE) AS amount,
        CASE WHEN a <> '' AND (CAST(a AS INT) + 1) % 100 = CAST(b AS INT) THEN a || '-' || b END AS tax_year FROM q""",
    "content_words": rf"SELECT query_id, coalesce(array_to_string(list_sort(list_filter(list_distinct({_T.format(x=chr(114) + 'egexp_replace(translate(question, chr(160) || chr(173), ' + chr(39) + ' ' + chr(39) + '), ' + chr(39) + chr(92) + '[[^' + chr(92) + ']' + chr(92) + 'n]{1,12}' + chr(92) + ']' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}), lambda x: x NOT IN ({_STOP}))), ' '), '') AS words FROM {QUESTIONS}",
    "chunk_ids": f"SELECT chunk_id, left(sha256(corpus_version || chr(0) || node_path || chr(0) || translate(coalesce(text, ''), chr(160) || chr(173), ' ')), 16) AS derived FROM {CHUNKS}",
    "breadcrumbs": f"SELECT chunk_id, concat_ws(' / ', CASE WHEN chapter_numeral <> '' THEN concat_ws(' — ', 'Chapter ' || chapter_numeral, chapter_title) END, concat_ws(' — ', CASE WHEN node_path LIKE 'Schedule%' THEN node_path ELSE 'Section ' || node_path END, root_title)) AS breadcrumb FROM {CHUNKS}",
    "path_algebra": rf"""SELECT chunk_id, CAST(CASE WHEN {_VALID} THEN 1 + len(b) ELSE NULL END AS INT) AS depth, CASE WHEN {_VALID} AND len(b) > 0 THEN {_ROOT} || array_to_string(b[:-2], '') END AS above, CASE WHEN {_VALID} THEN {_ROOT} END AS root, CASE WHEN {_VALID} THEN len(b) > 5 END AS too_deep
        FROM (SELECT chunk_id, node_path, regexp_extract_all(node_path, '\([0-9A-Za-z]+\)') AS b FROM {CHUNKS})""",
    "canonical_paths": r"""SELECT ref_id, p AS path FROM (SELECT ref_id, regexp_replace(regexp_replace(regexp_replace(min(target_path), '^[\s\x0b\x1c-\x1f\x{85}\p{Z}]+|[\s\x0b\x1c-\x1f\x{85}\p{Z}]+$', '', 'g'), '^(?i:sections?|sec\.?|s\.|u/s\.?)[\s\x0b\p{Z}]*', ''), '[\s\x0b\p{Z}]+\(', '(', 'g') AS p FROM cross_references GROUP BY 1) WHERE regexp_matches(p, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})(\([0-9A-Za-z]+\))*$')""",
    "line_types": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), b AS (SELECT *, trim(regexp_replace(regexp_replace(line, '\[(?:[0-9]+|calc|fact|eg|guide)\]', '', 'g'), '^\s*(?:[0-9]+[.)]|[-*•])\s*', '')) AS body FROM l)
        SELECT doc_id, CASE WHEN body = '' THEN 'malformed' WHEN regexp_matches(line, '^\s*#{1,6} ') THEN 'heading' WHEN contains(line, '[guide]') THEN 'guidance' WHEN NOT regexp_matches(line, '\[[0-9]+\]') AND regexp_matches(lower(body), '^(?:nothing in|no provision|the act does not)') THEN 'no_basis'
        WHEN regexp_matches(lower(body), '^(?:it is not known|cannot be determined|unknown)') THEN 'unknown' WHEN contains(line, '[eg]') THEN 'example' WHEN contains(line, '[calc]') THEN 'computation' WHEN contains(line, '[fact]') THEN 'application' ELSE 'content' END AS line_type, count(*) AS lines FROM b GROUP BY ALL""",
    "stub_vectors": f"""WITH r AS (SELECT query_id, list_transform(generate_series(0, 31), lambda i: CAST(CAST('0x' || left(sha256('query' || chr(0) || question || chr(0) || i), 8) AS BIGINT) AS DOUBLE) / 2147483648.0 - 1.0) AS r FROM {QUESTIONS} WHERE question IS NOT NULL)
        SELECT query_id, round(r[1] / sqrt(list_sum([x * x FOR x IN r])), 6) AS v0, round(r[32] / sqrt(list_sum([x * x FOR x IN r])), 6) AS v31 FROM r""",
}
QUERIES = {q.__name__: q for q in (tokenize_stats, plural_terms, token_estimates, grouped_tokens, squashed, redact_counts, defined_terms, omitted_only, numbers, fact_amounts, content_words, line_types, chunk_ids, breadcrumbs, path_algebra, canonical_paths, stub_vectors)}
