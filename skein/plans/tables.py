"""Queries of access rules, texts, questions, embedding runs and evaluation over the given tables, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import lexicon, questions, signals
from skein.functions import text as tx
from skein.operators import access, contexts, embedding
from skein.plans.batch import _FUSED, searched
from skein.plans.queries import _CONTROL, _FOLD, DIMENSION, chunk_table, query
from skein.sources import ingest

_OWNERS = "SELECT *, doc_id % 5 AS owner_id FROM documents"


def owners(t):
    return t("documents").withColumn("owner_id", F.col("doc_id") % 5)


@query("fil_owner_documents", f"SELECT doc_id, lang FROM ({_OWNERS}) WHERE owner_id = 3")
def _(t):
    return access.owned(owners(t), 3).select("doc_id", "lang")


@query("fil_documents_with_labels", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def _(t):
    return access.documents_with(t("documents").select("doc_id", "source"), t("labels"))


@query("fil_contains_documents", "SELECT doc_id, contains(lower(text), 'tion') AS has FROM documents")
def _(t):
    return t("documents").select("doc_id", access.contains_text(F.col("text"), "TION").alias("has"))


_EMBEDDED = (
    "SELECT vec_id AS chunk_id, 'p' || (label % 2) AS provider, 'm' || (vec_id % 3) AS model, len(embedding) AS dimension, "
    "CASE WHEN vec_id % 11 = 0 THEN 'failed' ELSE 'completed' END AS status, embedding FROM embeddings"
)


def embedded(t):
    """The vectors as embeddings of several providers and models, some of which failed."""
    v = F.col("vec_id")
    status = F.when(v % 11 == 0, "failed").otherwise("completed").alias("status")
    names = [F.concat(F.lit("p"), F.col("label") % 2).alias("provider"), F.concat(F.lit("m"), v % 3).alias("model"), F.size("embedding").alias("dimension")]
    return t("embeddings").select(v.alias("chunk_id"), *names, status, "embedding")


@query("fil_current_embeddings", f"SELECT chunk_id FROM ({_EMBEDDED}) WHERE status = 'completed' AND provider = 'p1' AND model = 'm2' AND dimension = {DIMENSION} AND embedding IS NOT NULL")
def _(t):
    return access.current(embedded(t), "p1", "m2", DIMENSION).select("chunk_id")


@query("fil_searchable_chunks", f"SELECT chunk_id, md5(text) AS text_md5 FROM (SELECT doc_id AS chunk_id, text FROM documents) JOIN ({_EMBEDDED}) USING (chunk_id) WHERE status = 'completed' AND provider = 'p0' AND model = 'm1'")
def _(t):
    return access.searchable(chunk_table(t).select("chunk_id", "text"), embedded(t), "p0", "m1", DIMENSION).select("chunk_id", F.md5("text").alias("text_md5"))


@query("fil_gates_documents", """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'extraction_not_found' WHEN l.quality = 0 THEN 'extraction_not_completed' WHEN length(d.text) < 500 THEN 'no_text'
  WHEN d.doc_id % 4 = 0 THEN 'chunks_not_found' WHEN e.vec_id IS NULL THEN 'embeddings_not_found' END AS reason
FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN embeddings e ON e.vec_id = d.doc_id""")
def _(t):
    rows = t("documents").join(t("labels").select("doc_id", "quality"), "doc_id", "left").join(t("embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(True).alias("has")), "doc_id", "left")
    status = F.when(F.col("quality") == 0, "running").when(F.col("quality").isNotNull(), "completed")
    return rows.select("doc_id", access.gate(status, F.length("text") >= 500, F.col("doc_id") % 4 != 0, F.col("has")).alias("reason"))


@query("fil_constraints_documents", """SELECT 'filled' AS "constraint", count(*) FILTER (length(text) < 20) AS violations FROM documents
UNION ALL SELECT 'short', count(*) FILTER (n_chars > 5000) FROM documents UNION ALL SELECT 'one_text', count(*) - count(DISTINCT text) FROM documents WHERE text IS NOT NULL
UNION ALL SELECT 'one_id', count(*) - count(DISTINCT doc_id) FROM documents""")
def _(t):
    checks = {"filled": F.length("text") >= 20, "short": F.col("n_chars") <= 5000}
    return access.violations(t("documents"), checks, {"one_text": ["text"], "one_id": ["doc_id"]})


_CLEAN_QUESTION = r"trim(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\s+', ' ', 'g'))"


@query("fil_questions_conversations", f"""SELECT conv_id, turn, md5(q) AS question, CASE WHEN q = '' THEN 'empty_query' WHEN length(q) > 1000 THEN 'query_too_long' END AS error
FROM (SELECT conv_id, turn, {_CLEAN_QUESTION} AS q FROM conversations)""")
def _(t):
    made = t("conversations").select("conv_id", "turn", questions.checked(F.col("text")).alias("c"))
    return made.select("conv_id", "turn", F.md5("c.text").alias("question"), "c.error")


@query("fil_top_k_parts", """SELECT p_partkey, CASE WHEN v = '' OR v IS NULL THEN 5 WHEN regexp_matches(v, '^\\s*[+-]?[0-9]{1,8}\\s*$') AND trim(v)::INT BETWEEN 1 AND 20 THEN trim(v)::INT END AS top_k,
  CASE WHEN v = '' OR v IS NULL OR (regexp_matches(v, '^\\s*[+-]?[0-9]{1,8}\\s*$') AND trim(v)::INT BETWEEN 1 AND 20) THEN NULL ELSE 'invalid_top_k' END AS error
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '' WHEN 1 THEN p_size::VARCHAR WHEN 2 THEN ' ' || p_size || ' ' WHEN 3 THEN '-' || p_size ELSE p_size || 'x' END AS v FROM part)""")
def _(t):
    k, size = F.col("p_partkey") % 5, F.col("p_size").cast("string")
    value = F.when(k == 0, "").when(k == 1, size).when(k == 2, F.concat(F.lit(" "), size, F.lit(" "))).when(k == 3, F.concat(F.lit("-"), size)).otherwise(F.concat(size, F.lit("x")))
    return t("part").select("p_partkey", questions.checked_top_k(value).alias("c")).select("p_partkey", "c.top_k", "c.error")


_FOLDED_TREE = f"list_filter(regexp_extract_all({_FOLD}, '[0-9a-z]+'), lambda x: length(x) >= 3 AND NOT list_contains({lexicon.TREE_STOP_WORDS}, x))"


@query("str_tree_tokens_documents", f"SELECT doc_id, len({_FOLDED_TREE})::INT AS n, md5(array_to_string({_FOLDED_TREE}, ' ')) AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.explode(F.array(tx.tree_tokens(F.col("text")))).alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join("x", " ")).alias("tokens"))


_CONTENT_WORDS = f"list_filter(list_distinct(regexp_extract_all({_FOLD}, '[a-z0-9]{{3,}}')), lambda x: NOT list_contains({lexicon.CONTENT_STOP_WORDS}, x))"


@query("str_content_tokens_documents", f"SELECT doc_id, len({_CONTENT_WORDS})::INT AS n, md5(array_to_string(list_sort({_CONTENT_WORDS}), ' ')) AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.explode(F.array(tx.content_tokens(F.col("text")))).alias("x")).select("doc_id", F.size("x").alias("n"), F.md5(F.array_join(F.array_sort("x"), " ")).alias("tokens"))


@query("str_concept_text_documents", f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace({_FOLD}, '[’‘`´]', '''', 'g'), '\\s+', ' ', 'g'))) AS plain FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(tx.concept_text(F.col("text"))).alias("plain"))


@query("str_excerpts_documents", "SELECT doc_id, CASE WHEN length(text) <= 520 THEN text ELSE rtrim(left(text, 520), ' ') || '...' END AS excerpt FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.excerpt(F.col("text")).alias("excerpt"))


def _kinds_sql(patterns: dict[str, str], text: str) -> str:
    each = ", ".join(f"CASE WHEN regexp_matches({text}, '(?i){p}') THEN '{k}' END" for k, p in patterns.items())
    return f"array_to_string(list_filter([{each}], lambda x: x IS NOT NULL), ',')"


@query("rgx_tree_values_documents", f"SELECT doc_id, {_kinds_sql(lexicon.TREE_VALUE_PATTERNS, _FOLD)} AS kinds FROM documents")
def _(t):
    return t("documents").select("doc_id", F.concat_ws(",", tx.matching(tx.fold(F.col("text")), lexicon.TREE_VALUE_PATTERNS)).alias("kinds"))


_PLAIN_TEXT = f"trim(regexp_replace(regexp_replace({_FOLD}, '[’‘`´]', '''', 'g'), '\\s+', ' ', 'g'))"


@query("rgx_concepts_conversations", f"SELECT conv_id, turn, {_kinds_sql({k: '(?:' + '|'.join(ps) + ')' for k, ps in lexicon.CONCEPTS.items()}, _PLAIN_TEXT)} AS concepts, "
    f"regexp_matches({_FOLD}, '{'|'.join(lexicon.DEADLINE_PHRASES)}') AS deadline FROM conversations")  # fmt: skip
def _(t):
    text = F.col("text")
    return t("conversations").select("conv_id", "turn", F.concat_ws(",", signals.concepts(text)).alias("concepts"), signals.names_deadline(tx.fold(text)).alias("deadline"))


_STATES = "SELECT d.doc_id AS chunk_id, d.source AS doc_id, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.vec_id % 7 <> 0 THEN 'current' ELSE 'stale' END AS state FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"


@query("emb_runs_documents", f"""SELECT doc_id, count(*)::INT AS chunks, count(*) FILTER (state = 'current')::INT AS reused, count(*) FILTER (state <> 'current')::INT AS generated,
  CASE WHEN count(*) > {embedding.MOST_CHUNKS} THEN 'too_many_chunks_for_embedding' END AS error FROM ({_STATES}) GROUP BY doc_id""")
def _(t):
    chunks = t("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id"), "text")
    sha = F.when(F.col("chunk_id") % 7 == 0, "old").otherwise(F.sha2("text", 256)).alias("chunk_sha256")
    known = t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(chunks, "chunk_id").select("chunk_id", "embedding", sha)
    return embedding.run_report(chunks, known, DIMENSION)


@query("emb_status_documents", f"SELECT source AS doc_id, count(*)::INT AS chunk_count, count(*) FILTER (status = 'completed')::INT AS embedding_count, count(*) FILTER (status = 'failed')::INT AS failed_count FROM documents d LEFT JOIN ({_EMBEDDED}) e ON e.chunk_id = d.doc_id GROUP BY source")
def _(t):
    return embedding.status_summary(t("documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_id")), embedded(t))


@query("pe_full_context_documents", rf"""SELECT doc_id, md5(CASE WHEN length(one) > 8900 THEN regexp_replace(left(one, 8900), '\s+\z', '') ELSE one END) AS context,
  CASE WHEN length(one) > 8900 THEN 'token_aware_document_start_truncation' WHEN length(t) > 20000 THEN 'configured_char_limit_document_start_truncation' END AS strategy,
  ceil((length(CASE WHEN length(one) > 8900 THEN regexp_replace(left(one, 8900), '\s+\z', '') ELSE one END) + 100) / 3.0)::BIGINT AS tokens
FROM (SELECT doc_id, t, CASE WHEN length(t) > 20000 THEN rtrim(left(t, 20000), ' ') ELSE t END AS one FROM
  (SELECT doc_id, regexp_replace(regexp_replace({_CONTROL}, '\n{{4,}}', repeat(chr(10), 3), 'g'), '^\s+|\s+\z', '', 'g') AS t FROM documents))""")
def _(t):
    made = t("documents").select("doc_id", F.explode(F.array(contexts.full_context(F.col("text"), 100, 20_000, 3000))).alias("c"))
    return made.select("doc_id", F.md5("c.text").alias("context"), "c.strategy", "c.tokens")


@query("src_safe_names", r"""SELECT page_id, CASE WHEN length(n) > 255 THEN regexp_replace(left(n, 251), '[ ._]+$', '') || '.pdf' ELSE n END AS name,
  'documents/user_' || (page_id % 7) || '/' || md5(url) || '.pdf' AS stored
FROM (SELECT page_id, url, regexp_replace(regexp_replace(replace(trim(regexp_extract(replace(url, '\', '/'), '[^/]*$')), ' ', '_'), '[^-\p{L}\p{N}\p{M}_.]', '', 'g'), '^[ ._]+|[ ._]+$', '', 'g') AS n FROM pages)""")
def _(t):
    return t("pages").select("page_id", ingest.safe_name(F.col("url")).alias("name"), ingest.stored_path(F.col("page_id") % 7, F.col("url")).alias("stored"))


@query("prj_source_payloads", f"WITH {_FUSED} SELECT question_id, 'source_' || position AS source, chunk_id, chunk_id AS chunk_index, final_score AS similarity FROM ranked")
def _(t):
    rows = searched(t).select("question_id", "position", "chunk_id", F.col("chunk_id").alias("chunk_index"), F.col("final_score").alias("similarity"))
    return access.source_payload(rows, "question_id")


