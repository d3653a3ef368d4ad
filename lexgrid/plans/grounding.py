"""Queries over parsing, evidence, claims and quality rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import scan as C
from ..functions import text as T
from ..operators import evidence as V
from ..operators import joins as J
from ..operators import quality as Q
from ..operators import references as R
from ..operators import sequences as S
from ..session import materialize
from ..sources.tables import once, table
from . import relations, retrieval
from .corpus import CHUNKS, chunks, questions


def reference_scan(spark: SparkSession, d: str) -> DataFrame:
    """References found anew in the chunks' texts, whether they name another Act, and whether their targets exist."""
    c = chunks(spark, d, "corpus_version", "node_path", "text").filter(F.col("text").isNotNull())
    found = c.select("corpus_version", "chunk_id", F.posexplode(C.scan_references("text")).alias("n", "r"))
    each = found.select("corpus_version", "chunk_id", "n", F.col("r.ref_type").alias("ref_type"), F.col("r.act_name").alias("act_name"), F.explode_outer("r.citations").alias("citation"))
    nodes = c.select("corpus_version", F.col("node_path").alias("citation")).distinct().withColumn("_hit", F.lit(True))
    return each.join(nodes, ["corpus_version", "citation"], "left").select("chunk_id", "n", "ref_type", "citation", "act_name", F.coalesce("_hit", F.lit(False)).alias("resolved"))


def question_citations(spark: SparkSession, d: str) -> DataFrame:
    q = F.regexp_replace("question", r"(?i)\b(?:u/s|sec\.?|s\.)\s*(?=[0-9])", "section ")
    return questions(spark, d).select("query_id", F.explode(C.scan_references(q)).alias("r")).filter("r.act_name is null").select("query_id", F.explode("r.citations").alias("citation")).distinct()


def word_number_scan(spark: SparkSession, d: str) -> DataFrame:
    turns = once(table(spark, d, "turn_requests", "request_id", "question"), ["request_id"])
    return turns.select("request_id", C.word_numbers("question").alias("numbers")).filter(F.size("numbers") > 0)


def equations(spark: SparkSession, d: str) -> DataFrame:
    """Equations in documents, and whether they hold within 1."""
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null")
    e = docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"([0-9(][0-9,.() ]*(?:[+×*/÷−-] ?[0-9(][0-9,.() ]*)+= ?[0-9][0-9,.]*)"), F.lit(1))).alias("n", "equation"))
    side = F.split("equation", "=")
    return e.select("doc_id", "n", "equation", C.eval_expr(side[0]).alias("value"), C.eval_expr(F.regexp_replace(side[1], r"[.,]+$", "")).alias("claimed")).withColumn("holds", F.abs(F.col("value") - F.col("claimed")) <= 1)


def outline_anomalies(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text").filter(F.col("text").rlike(r"(?m)^\s*\([0-9A-Za-z]{1,4}\)\s"))
    return docs.select("doc_id", F.explode(C.outlines("text")).alias("o")).select("doc_id", "o.*")


def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut at their numbered lines; every line stands in exactly one part, part 0 is the front matter."""
    l = S.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    opens = F.col("line").rlike(r"^\([0-9]+\) ").cast("int")
    l = l.withColumn("opens", opens).withColumn("part", S.carry_forward(F.when(F.col("opens") == 1, F.col("line_no")), "doc_id", "line_no"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]), "\n")
    return l.groupBy("doc_id", F.coalesce("part", F.lit(-1)).alias("from_line")).agg(F.count("*").alias("lines"), F.length(text).alias("signs"))


def _definitions(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, line_no, term): the lines of documents that define a term."""
    l = S.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text").filter(F.col("line").contains("” means"))
    return l.select("doc_id", "line_no", T.defined_term(F.col("line")).alias("term")).filter("term is not null")


def glossary(spark: SparkSession, d: str) -> DataFrame:
    """Terms that documents define, and in how many documents."""
    return _definitions(spark, d).groupBy("term").agg(F.countDistinct("doc_id").alias("documents"))


def terms_in(spark: SparkSession, d: str) -> DataFrame:
    """The glossary terms that stand in each chunk's text, within words too and in any case of letters, in the order in which they are first defined."""
    terms = _definitions(spark, d).groupBy(F.col("term").alias("phrase")).agg(F.min(F.struct("doc_id", "line_no")).alias("place"))
    texts = chunks(spark, d, "text").filter("text is not null").select("chunk_id", T.normalise(F.col("text")).alias("text"))
    return J.substrings_in(texts, terms).withColumnRenamed("phrases", "terms")


def _lead_ins(c: DataFrame, above: DataFrame) -> DataFrame:
    """(item_id, up, context): the ancestors of each chunk that has some, and the tokens of their own lines, which end where their first child begins."""
    end = c.select("corpus_version", F.col("parent_id").alias("chunk_id"), F.col("char_start").alias("_s")).join(c.select("corpus_version", "chunk_id", "char_start"), ["corpus_version", "chunk_id"])
    end = end.groupBy("chunk_id").agg(F.min(F.greatest(F.col("_s") - F.col("char_start"), F.lit(0))).alias("_end"))
    own = F.regexp_replace(F.when(F.col("_end").isNull(), F.col("text")).otherwise(F.substr("text", F.lit(1), F.col("_end"))), r"\n+$", "")
    tokens = c.join(end, "chunk_id", "left").select(F.col("chunk_id").alias("ancestor"), F.coalesce(T.token_estimate(own), F.lit(0)).alias("_t"))
    return above.join(tokens, "ancestor").groupBy("id").agg(F.collect_set("ancestor").alias("up"), F.sum("_t").cast("int").alias("context")).withColumnRenamed("id", "item_id")


def evidence_pack(spark: SparkSession, d: str) -> DataFrame:
    """The first 20 chunks of every question with their lead-ins, packed into 3,000 tokens; what room is left goes to the chunks they refer to."""
    ranked = materialize(retrieval._bm25(spark, d, 20))
    c = materialize(chunks(spark, d, "corpus_version", "parent_id", "node_path", "char_start", "text").filter(P.parts(F.col("node_path")).isNotNull()))
    nodes = c.select(F.col("corpus_version").alias("scope"), F.col("node_path").alias("path"), F.col("chunk_id").alias("id"))
    hops = materialize(relations._hops(spark, d, ranked.select(F.col("item_id").alias("id")).distinct()).select("id", "target", "position"))
    wanted = ranked.select("item_id").unionByName(hops.select(F.col("target").alias("item_id"))).distinct()
    above = J.lineage(nodes).join(wanted, F.col("id") == F.col("item_id"), "left_semi").select("id", "ancestor")
    own = F.array("item_id")
    items = c.withColumnRenamed("chunk_id", "item_id").join(wanted, "item_id", "left_semi").join(_lead_ins(c, above), "item_id", "left").select(
        "item_id", "text", F.coalesce("context", F.lit(0)).alias("context"), F.coalesce(F.concat(own, "up"), own).alias("lineage"),
        (F.coalesce(T.token_estimate(F.col("text")), F.lit(0)) + F.coalesce("context", F.lit(0))).alias("tokens"),
    )
    items = materialize(items)
    asked = questions(spark, d).select("query_id", F.col("question").alias("query"))
    targets = hops.join(items.select(F.col("item_id").alias("target"), "lineage", "tokens"), "target")
    units = V.evidence(ranked.join(items, "item_id").join(asked, "query_id"), 3000, targets, fill=True)
    return V.rows(units)


def repeated_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a document left after near repeats are dropped."""
    docs = table(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", F.split("text", "\n").alias("lines"))
    return docs.select("doc_id", F.size("lines").alias("lines"), F.size(V.drop_repeats(F.col("lines"))).alias("kept"))


def marker_check(spark: SparkSession, d: str) -> DataFrame:
    """Markers of documents and whether the document has a line of that number before the marked one."""
    l = S.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return V.markers(l).select("doc_id", "line_no", "marker", (F.col("marker") <= F.col("line_no")).alias("supported"))


def unsupported_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Numbers of a question that its nearest chunk by words does not have."""
    first = retrieval._bm25(spark, d, 1).select("query_id", F.col("item_id").alias("chunk_id"))
    joined = first.join(questions(spark, d), "query_id").join(chunks(spark, d, "text"), "chunk_id")
    return joined.select("query_id", F.size(V.unsupported_numbers(F.col("question"), F.coalesce("text", F.lit("")))).alias("unsupported"))


def dq_rules(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of chunks and vectors."""
    c = chunks(spark, d, "corpus_version", "parent_id", "section_number", "schedule_number", "node_path", "page_start", "page_end", "char_start", "char_end", "text", "token_count")
    rules = {
        "id_shape": F.col("chunk_id").rlike("^[0-9a-f]{16}$"), "one_root_kind": F.col("section_number").isNull() != F.col("schedule_number").isNull(),
        "page_order": F.coalesce(F.col("page_start") <= F.col("page_end"), F.lit(True)), "char_order": F.coalesce(F.col("char_start") <= F.col("char_end"), F.lit(True)),
        "path_valid": F.coalesce(P.parts(F.col("node_path")).isNotNull(), F.lit(False)), "not_too_deep": F.coalesce(~P.too_deep(F.col("node_path")), F.lit(True)),
        "text_present": F.col("text").isNotNull(), "tokens_right": F.col("token_count").eqNullSafe(T.token_estimate(F.col("text"))),
    }
    v = once(table(spark, d, "chunk_embeddings", "chunk_id", "corpus_version", "embedding"), ["chunk_id", "corpus_version"])
    return Q.together(
        Q.violations(c, "chunk_id", rules), Q.not_unique(c, ["corpus_version", "node_path"], "path_unique"),
        Q.without_parent(v, "chunk_id", ["corpus_version", "chunk_id"], c, "vector_has_chunk"), Q.violations(v, "chunk_id", {"vector_length": F.size("embedding") == 64}),
    )


def manifest_check(spark: SparkSession, d: str) -> DataFrame:
    """What corpus_versions claims of each version against its chunks (of any state)."""
    c = once(table(spark, d, "chunks", "chunk_id", "corpus_version", "node_path"), ["chunk_id", "corpus_version"])
    is_root = F.col("node_path").rlike(r"^[^(]*$")
    have = c.groupBy("corpus_version").agg(F.count("*").alias("chunks"), F.count_if(is_root).alias("roots"), F.substring(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("chunk_id"))), 256), 1, 16).alias("digest"))
    v = once(table(spark, d, "corpus_versions", "corpus_version", "chunk_count", "root_count"), ["corpus_version"])
    return v.join(have, "corpus_version", "left").select("corpus_version", "chunks", "roots", "digest", F.col("chunk_count").eqNullSafe(F.col("chunks").cast("int")).alias("count_holds"))


_LINES = "(SELECT doc_id, CAST(generate_subscripts(ls, 1) - 1 AS INT) AS line_no, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"
_EST = r"len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\x0b\x1c-\x1f\x{85}\p{Z}]'))"
_VALID = r"regexp_matches(node_path, '^(Schedule [IVXLC]+|[0-9]{1,3}[A-Z]{0,3})(\([0-9A-Za-z]+\))*$')"
SQL = {
    "paragraphs": rf"""SELECT doc_id, from_line, count(*) AS lines, CAST(sum(length(line)) + count(*) - 1 AS INT) AS signs FROM (SELECT *, CAST(coalesce(last_value(CASE WHEN regexp_matches(line, '^\([0-9]+\) ') THEN line_no END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), -1) AS INT) AS from_line FROM {_LINES}) GROUP BY ALL""",
    "marker_check": rf"SELECT doc_id, line_no, m AS marker, m <= line_no AS supported FROM (SELECT doc_id, line_no, CAST(unnest(list_distinct(regexp_extract_all(line, '\[([0-9]{{1,4}})\]', 1))) AS INT) AS m FROM {_LINES})",
    "glossary": rf"""SELECT term, count(DISTINCT doc_id) AS documents FROM (SELECT doc_id, regexp_extract(regexp_replace(trim(translate(line, chr(160) || chr(173), ' ')), '^\([0-9]{{1,3}}[A-Za-z]{{0,3}}\)\s*', ''), '^["“]([^"“”]{{1,80}})["”]', 1) AS term FROM {_LINES} WHERE contains(line, '” means')) WHERE term <> '' GROUP BY 1""",
    "dq_rules": rf"""WITH c AS (SELECT *, regexp_extract_all(node_path, '\([0-9A-Za-z]+\)') AS b FROM {CHUNKS}), v AS (SELECT chunk_id, corpus_version, min(embedding) AS e FROM chunk_embeddings GROUP BY ALL)
        SELECT 'id_shape' AS rule, chunk_id AS key FROM c WHERE NOT regexp_matches(chunk_id, '^[0-9a-f]{{16}}$') UNION ALL SELECT 'one_root_kind', chunk_id FROM c WHERE (section_number IS NULL) = (schedule_number IS NULL)
        UNION ALL SELECT 'page_order', chunk_id FROM c WHERE page_start > page_end UNION ALL SELECT 'char_order', chunk_id FROM c WHERE char_start > char_end UNION ALL SELECT 'path_valid', chunk_id FROM c WHERE NOT {_VALID}
        UNION ALL SELECT 'not_too_deep', chunk_id FROM c WHERE {_VALID} AND len(b) > 5 UNION ALL SELECT 'text_present', chunk_id FROM c WHERE text IS NULL UNION ALL SELECT 'tokens_right', chunk_id FROM c WHERE token_count IS DISTINCT FROM {_EST}
        UNION ALL SELECT 'path_unique', corpus_version || '|' || node_path FROM c GROUP BY corpus_version, node_path HAVING count(*) > 1 UNION ALL SELECT 'vector_has_chunk', v.chunk_id FROM v WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.chunk_id = v.chunk_id AND c.corpus_version = v.corpus_version)
        UNION ALL SELECT 'vector_length', chunk_id FROM v WHERE coalesce(len(e), -1) <> 64""",
    "manifest_check": r"""WITH c AS (SELECT DISTINCT chunk_id, corpus_version, node_path FROM chunks), h AS (SELECT corpus_version, count(*) AS chunks, count(*) FILTER (NOT contains(node_path, '(')) AS roots, left(sha256(string_agg(chunk_id, chr(10) ORDER BY chunk_id)), 16) AS digest FROM c GROUP BY 1)
        SELECT v.corpus_version, chunks, roots, digest, chunk_count IS NOT DISTINCT FROM chunks AS count_holds FROM (SELECT DISTINCT corpus_version, chunk_count FROM corpus_versions) v LEFT JOIN h USING (corpus_version)""",
}
QUERIES = {q.__name__: q for q in (reference_scan, question_citations, word_number_scan, equations, outline_anomalies, paragraphs, glossary, terms_in, evidence_pack, repeated_lines, marker_check, unsupported_numbers, dq_rules, manifest_check)}
