"""Queries over the test tables, each with the same in SQL. Documents stand in for chunks, vec_id for their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import claims, questions, signals
from skein.functions import text as tx
from skein.functions import vectors as vx
from skein.operators import answers, chunking, contexts, evaluation, fuzzy, hierarchy, retrieval
from skein.plans import search_plan
from skein.shipping import ship
from skein.sources import ingest, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
GROUPS = [["the", "de"], ["and", "la", "der", "und"]]
DIMENSION = 64
_FOLD = "lower(strip_accents(text))"
_TOKENS = f"regexp_extract_all({_FOLD}, '[0-9a-z]+')"
_GROUP_SQL = " AND ".join(f"list_has_any(tokens, {g})" for g in GROUPS)
_ALL_TERMS = [x for g in GROUPS for x in g]
_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_COSINE = f"round(list_cosine_similarity(embedding::DOUBLE[], {_VECTOR}::DOUBLE[]), 6)"
_VECTOR_TOP = (
    f"SELECT *, row_number() OVER (ORDER BY similarity DESC, chunk_id) AS vector_rank FROM (SELECT vec_id "
    f"AS chunk_id, {_COSINE} AS similarity FROM embeddings) ORDER BY similarity DESC, chunk_id LIMIT "
    f"20"
)
_LEXICAL_TOP = (
    f"SELECT chunk_id, hits, row_number() OVER (ORDER BY hits DESC, chunk_id) AS lexical_rank FROM (SELECT "
    f"chunk_id, len(list_filter(tokens, lambda x: list_contains({_ALL_TERMS}, x))) AS hits FROM (SELECT "
    f"doc_id AS chunk_id, {_TOKENS} AS tokens FROM documents) WHERE {_GROUP_SQL}) ORDER BY hits DESC, "
    f"chunk_id LIMIT 20"
)


def query(name: str, sql: str | None = None):
    def add(f):
        def run(spark, sf_dir: str) -> DataFrame:
            ship(spark)
            t = lambda name: table(spark, sf_dir, name)
            t.spark = spark
            return f(t)

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def chunk_table(t) -> DataFrame:
    return t("documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")


def vector_table(t) -> DataFrame:
    return t("embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def query_vector(t) -> list[float]:
    return t("embeddings").where("vec_id = 0").first()["embedding"]


@query("src_usability", (
    "SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g'))::INT AS solid, length(regexp_replace(text, "
    "'[^\\p{L}\\p{N}]', '', 'g'))::INT AS alnum, length(regexp_replace(text, '\\s', '', 'g')) >= 12 "
    "AND length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) >= 8 AS usable FROM documents"
))
def _(t):
    return t("documents").select("doc_id", tx.usability(F.col("text")).alias("u")).select("doc_id", "u.*")


@query("str_checksum", "SELECT doc_id, sha256(text) AS text_sha256, length(text)::INT AS text_length FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.length("text").alias("text_length"))


@query("str_clean_text", (
    r"SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, "
    r"'\r\n?', chr(10), 'g'), '[\x00-\x08\x0b-\x1f]', '', 'g'), '[^\S\n]+(\n|\z)', '\1', 'g'), '\n{3,}', "
    r"chr(10) || chr(10), 'g'), '^\s+|\s+\z', '', 'g')) AS clean_sha FROM documents"
))
def _(t):
    return t("documents").select("doc_id", F.sha2(tx.clean_text(F.col("text")), 256).alias("clean_sha"))


@query("str_clean_query", r"SELECT item_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS question FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", tx.clean_query(F.col("text")).alias("question"))


@query("str_fold", f"SELECT doc_id, md5({_FOLD}) AS folded FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(tx.fold(F.col("text"))).alias("folded"))


@query("str_tokens", f"SELECT doc_id, len({_TOKENS})::INT AS n_tokens, len(list_distinct({_TOKENS}))::INT AS n_distinct FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.tokens(F.col("text")).alias("x")).select("doc_id", F.size("x").alias("n_tokens"), F.size(F.array_distinct("x")).alias("n_distinct"))


@query("str_estimated_tokens", "SELECT doc_id, greatest(1, round_even(length(text) / 4, 0))::INT AS estimated FROM documents")
def _(t):
    return t("documents").select("doc_id", tx.estimated_tokens(F.col("text")).alias("estimated"))


_EDGE, _END = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"
_SQL_VALUES = {
    "amount": rf"(?i){_EDGE}(?:[0-9][0-9\s.,]*(?:mad|dh|dhs|dirhams?|eur|euros?)|(?:mad|dh|dhs|eur)\s*[0-9][0-9\s.,]*[0-9]?){_END}",
    "date": rf"(?i){_EDGE}(?:[0-9]{{1,2}}[/-][0-9]{{1,2}}[/-][0-9]{{2,4}}|[0-9]{{1,2}}\s+(?:janvier|f[eé]vrier|mars|avril|mai|juin|juillet|ao[uû]t"
    rf"|septembre|octobre|novembre|d[eé]cembre)\s+[0-9]{{4}}){_END}",
    "duration": rf"(?i){_EDGE}[0-9]+(?:[,.][0-9]+)?\s*(?:jours?|mois|ans?|ann[eé]es?|heures?){_END}",
    "market_reference": rf"(?i){_EDGE}[A-Z0-9]{{2,}}(?:[/-][A-Z0-9]{{2,}}){{2,}}{_END}",
    "percentage": rf"{_EDGE}[0-9]+(?:[,.][0-9]+)?\s*%(?:\s|$|[.,;:])",
    "quantity": rf"(?i){_EDGE}[0-9]+(?:[,.][0-9]+)?\s*(?:unit[eé]s?|pages?|lots?|exemplaires?|pi[eè]ces?){_END}",
    "time": rf"(?i){_EDGE}(?:[0-9]{{1,2}}\s*(?:h|heures?)(?:\s*[0-9]{{2}})?|[0-9]{{1,2}}:[0-9]{{2}}){_END}",
}
_TYPES_SQL = ", ".join(f"CASE WHEN regexp_matches(text, '{p}') THEN '{k}' END" for k, p in _SQL_VALUES.items())


@query("rgx_value_types", f"SELECT doc_id, array_to_string(list_filter([{_TYPES_SQL}], lambda x: x IS NOT NULL), ',') AS types FROM documents")
def _(t):
    return t("documents").select("doc_id", F.concat_ws(",", tx.value_types(F.col("text"))).alias("types"))


@query("chk_sentences", r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)))::INT AS n_sentences FROM documents")
def _(t):
    return t("documents").select("doc_id", F.size(tx.sentences(F.col("text"))).alias("n_sentences"))


_CLEAN = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g'), "
    r"'[\x00-\x08\x0b-\x1f]', '', 'g'), '[^\S\n]+(\n|\z)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+\z', '', 'g')"
)
_TRIM_SQL = r"regexp_replace({0}, '^\s+|\s+\z', '', 'g')"
_LEAD_SQL = r"length(regexp_extract({0}, '^\s*'))"
#: Spans as pieces of pieces with running offsets; blanks are cut by a recursion over the rest; packing is one over the spans.
_CHUNKS_SQL = rf"""WITH RECURSIVE c AS (SELECT doc_id, {_CLEAN} AS t FROM documents),
paragraphs AS (SELECT doc_id, i, p, sum(length(p) + 2) OVER (PARTITION BY doc_id ORDER BY i) - length(p) - 2 AS o FROM
  (SELECT doc_id, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(t, chr(10) || chr(10)) AS x FROM c))),
trimmed AS (SELECT doc_id, o + {_LEAD_SQL.format('p')} AS o, {_TRIM_SQL.format('p')} AS p FROM paragraphs),
sentences AS (SELECT doc_id, o + sum(length(s)) OVER (PARTITION BY doc_id, o ORDER BY i) - length(s) AS o, s FROM
  (SELECT doc_id, o, unnest(x) AS s, generate_subscripts(x, 1) AS i FROM
    (SELECT doc_id, o, CASE WHEN length(p) <= 1400 THEN [p] ELSE regexp_extract_all(p, '(?s).*?[.!?]\s+|.+') END AS x FROM trimmed WHERE p <> ''))),
cuts AS (SELECT doc_id, o + {_LEAD_SQL.format('s')} AS o, {_TRIM_SQL.format('s')} AS rest, NULL::VARCHAR AS piece, NULL::BIGINT AS place FROM sentences
  UNION ALL
  SELECT doc_id, o + k + {_LEAD_SQL.format('substr(rest, k + 1)')}, {_TRIM_SQL.format('substr(rest, k + 1)')}, {_TRIM_SQL.format('left(rest, k)')}, o FROM
    (SELECT *, CASE WHEN length(rest) <= 1400 THEN length(rest) WHEN regexp_matches(left(rest, 1400), '(?s)^.+[ \n\t]')
      THEN length(regexp_extract(left(rest, 1400), '(?s)^.+[ \n\t]')) - 1 ELSE 1400 END AS k FROM cuts WHERE rest <> '')),
spans AS (SELECT doc_id, place AS a, place + length(piece) AS b, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS i FROM cuts WHERE piece IS NOT NULL AND piece <> ''),
packed AS (SELECT doc_id, i, a, b, 0 AS n FROM spans WHERE i = 1
  UNION ALL
  SELECT s.doc_id, s.i, CASE WHEN joins THEN p.a ELSE s.a END, s.b, p.n + (NOT joins)::INT FROM packed p JOIN spans s ON s.doc_id = p.doc_id AND s.i = p.i + 1,
    LATERAL (SELECT s.b - p.a <= 1200 OR (p.b - p.a < 100 AND s.b - p.a <= 1400) AS joins)),
bases AS (SELECT doc_id, n, min(a) AS a, max(b) AS b FROM packed GROUP BY ALL),
before AS (SELECT *, lag(a) OVER w AS first, greatest(lag(b) OVER w - 200, lag(a) OVER w) AS start FROM bases WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
made AS (SELECT doc_id, n, b, CASE WHEN first IS NULL THEN a ELSE least(a, first + length(regexp_extract(substr(t, first + 1, start - first), '(?s)^.*\s'))) END AS a, t FROM before JOIN c USING (doc_id)),
texts AS (SELECT *, {_TRIM_SQL.format('substr(t, a + 1, b - a)')} AS chunk_text, max(n) OVER (PARTITION BY doc_id) AS last FROM made),
fine AS (SELECT *, max(length(chunk_text)) OVER (PARTITION BY doc_id) AS longest FROM texts)
SELECT doc_id, n::INT AS chunk_index, a::INT AS character_start, b::INT AS character_end, chunk_text, length(chunk_text)::INT AS text_length, sha256(chunk_text) AS text_sha256,
  1 AS chunking_version, CASE WHEN chunk_text = '' THEN 0 ELSE greatest(1, round_even(length(chunk_text) / 4, 0))::INT END AS estimated_tokens,
  CASE WHEN n = 0 THEN 0 ELSE 200 END AS overlap_chars, n = 0 AS is_first_chunk, n = last AS is_last_chunk
FROM fine WHERE length(t) <= 1000000 AND last < 1000 AND longest <= 1600"""


@query("chk_chunks", _CHUNKS_SQL)
def _(t):
    return chunking.chunks(t("documents").select("doc_id", "text")).select("*", "metadata.*").drop("metadata")


@query("pe_prefix_context", "SELECT doc_id, md5(rtrim(left(text, 60000))) AS context, length(text) > 60000 AS truncated FROM documents")
def _(t):
    return t("documents").select("doc_id", F.md5(tx.prefix_context(F.col("text"), 60_000)).alias("context"), (F.length("text") > 60_000).alias("truncated"))


@query("win_terms_in_window", (
    f"SELECT doc_id, coalesce(list_max(list_transform(range(1, len(tk) + 1), lambda i: len(list_intersect(list_distinct(tk[i:i "
    f"+ 11]), {_ALL_TERMS})))), 0)::INT AS most FROM (SELECT doc_id, {_TOKENS} AS tk FROM documents)"
))
def _(t):
    terms = F.array(*[F.lit(x) for x in _ALL_TERMS])
    return t("documents").select("doc_id", tx.terms_in_window(tx.tokens(F.col("text")), terms, 12).alias("most"))


@query("fil_valid_vectors", f"SELECT vec_id, len(embedding) = {DIMENSION} AS valid FROM embeddings")
def _(t):
    return t("embeddings").select("vec_id", vx.valid(F.col("embedding"), DIMENSION).alias("valid"))


@query("mth_cosine", f"SELECT vec_id, {_COSINE} AS similarity FROM embeddings")
def _(t):
    q = F.array(*[F.lit(float(x)) for x in query_vector(t)])
    return t("embeddings").select("vec_id", F.round(vx.cosine(F.col("embedding"), q), 6).alias("similarity"))


@query("sort_vector_top", f"SELECT chunk_id, similarity, vector_rank::INT AS vector_rank FROM ({_VECTOR_TOP})")
def _(t):
    return retrieval.vector_top(vector_table(t), query_vector(t), 20)


@query("ret_lexical_top", f"SELECT chunk_id, hits::INT AS hits, lexical_rank::INT AS lexical_rank FROM ({_LEXICAL_TOP})")
def _(t):
    return retrieval.lexical_top(chunk_table(t), GROUPS, 20)


@query("ret_hybrid", (
    f"WITH v AS ({_VECTOR_TOP}), l AS ({_LEXICAL_TOP}), f AS (SELECT chunk_id, similarity, vector_rank::INT "
    f"AS vector_rank, hits::INT AS hits, lexical_rank::INT AS lexical_rank, round(coalesce(1.0::DOUBLE "
    f"/ (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0), 9) AS hybrid_score FROM "
    f"v FULL JOIN l USING (chunk_id)) SELECT *, (row_number() OVER (ORDER BY hybrid_score DESC, coalesce(lexical_rank, "
    f"1000000), coalesce(vector_rank, 1000000), chunk_id))::INT AS final_rank FROM f ORDER BY final_rank "
    f"LIMIT 5"
))
def _(t):
    return retrieval.hybrid_top(chunk_table(t), vector_table(t), query_vector(t), GROUPS, 5)


@query("emb_states", (
    "SELECT d.doc_id AS chunk_id, CASE WHEN e.vec_id IS NULL THEN 'missing' WHEN e.vec_id % 7 <> 0 THEN "
    "'current' ELSE 'stale' END AS state FROM documents d LEFT JOIN embeddings e ON d.doc_id = e.vec_id"
))
def _(t):
    known = vector_table(t).join(chunk_table(t), "chunk_id").select("chunk_id", "embedding", F.when(F.col("chunk_id") % 7 == 0, "old").otherwise(F.sha2("text", 256)).alias("chunk_sha256"))
    return retrieval.stale_embeddings(chunk_table(t), known, DIMENSION)


@query("src_upsert", (
    "SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM documents) THEN toxic + 10 ELSE toxic END "
    "AS toxic FROM labels UNION ALL SELECT doc_id, 99 FROM documents WHERE doc_id NOT IN (SELECT doc_id "
    "FROM labels)"
))
def _(t):
    old = t("labels").select("doc_id", "toxic")
    new = t("documents").select("doc_id").join(old, "doc_id", "left").select("doc_id", F.coalesce(F.col("toxic") + 10, F.lit(99)).alias("toxic"))
    return retrieval.upsert(old, new, "doc_id", ["toxic"])


@query("join_inner", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id")


@query("join_left", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(t):
    return t("documents").select("doc_id").join(t("labels").select("doc_id", "quality"), "doc_id", "left")


@query("join_semi", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels").where("toxic = 1"), "doc_id", "left_semi")


@query("join_anti", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left_anti")


@query("join_closure", (
    "WITH RECURSIVE e AS (SELECT 'n' || n_nationkey AS child, 'r' || n_regionkey AS parent FROM nation "
    "UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer), w AS (SELECT parent AS root, "
    "child FROM e WHERE parent LIKE 'r%' UNION ALL SELECT w.root, e.child FROM w JOIN e ON e.parent "
    "= w.child) SELECT root, count(*) AS descendants FROM w GROUP BY root"
))
def _(t):
    edges = t("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("child"), F.concat(F.lit("r"), "n_regionkey").alias("parent"))
    edges = edges.union(t("customer").select(F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")))
    pairs = hierarchy.closure(edges).where("ancestor like 'r%'")
    return pairs.groupBy(F.col("ancestor").alias("root")).agg(F.count(F.lit(1)).alias("descendants"))


@query("agg_groups", (
    "SELECT lang, count(*) AS n, count(*) FILTER (n_chars > 1600) AS n_long, round(avg(n_chars), 4) "
    "AS mean_chars, bool_or(n_chars > 50000) AS any_huge, bool_and(n_chars > 0) AS all_filled FROM documents "
    "GROUP BY lang"
))
def _(t):
    n = F.col("n_chars")
    return t("documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(n > 1600).alias("n_long"), F.round(F.avg(n), 4).alias("mean_chars"), F.bool_or(n > 50000).alias("any_huge"), F.bool_and(n > 0).alias("all_filled"))


@query("agg_two_grains", "SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY ROLLUP (source, lang)")
def _(t):
    return t("documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("agg_best_per_key", (
    "SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY "
    "n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1"
))
def _(t):
    return retrieval.best_per_key(t("documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")]).drop("rank")


@query("agg_sets", "SELECT source, array_to_string(list_sort(list(DISTINCT lang)), ',') AS langs FROM documents GROUP BY source")
def _(t):
    return t("documents").groupBy("source").agg(F.concat_ws(",", F.sort_array(F.collect_set("lang"))).alias("langs"))


@query("agg_maps", (
    "SELECT source, array_to_string(list_sort(list(lang || '=' || n)), ',') AS counts FROM (SELECT source, "
    "lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source"
))
def _(t):
    per = t("documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source").agg(F.concat_ws(",", F.sort_array(F.collect_list(F.concat_ws("=", "lang", F.col("n").cast("string"))))).alias("counts"))


@query("agg_ordered_text", "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id")
def _(t):
    return t("conversations").groupBy("conv_id").agg(F.expr("listagg(text, '\n\n') within group (order by turn)").alias("transcript"))


@query("win_ranks", (
    "SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS rank, "
    "lag(n_chars) OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS previous, row_number() OVER "
    "(PARTITION BY lang ORDER BY n_chars DESC, doc_id) = 1 AS is_first, row_number() OVER (PARTITION "
    "BY lang ORDER BY n_chars, doc_id DESC) = 1 AS is_last FROM documents"
))
def _(t):
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    back = Window.partitionBy("lang").orderBy("n_chars", F.desc("doc_id"))
    return t("documents").select("doc_id", F.row_number().over(w).alias("rank"), F.lag("n_chars").over(w).alias("previous"), (F.row_number().over(w) == 1).alias("is_first"), (F.row_number().over(back) == 1).alias("is_last"))


@query("win_top_per_group", (
    "SELECT source, doc_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source "
    "ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 4"
))
def _(t):
    return retrieval.best_per_key(t("documents").select("source", "doc_id", "n_chars"), "source", [F.desc("n_chars"), F.col("doc_id")], 4).drop("n_chars")


@query("set_operations", (
    "SELECT 'both' AS kind, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT vec_id "
    "FROM embeddings) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT "
    "vec_id FROM embeddings) UNION ALL SELECT 'only', count(*) FROM (SELECT doc_id FROM documents EXCEPT "
    "SELECT vec_id FROM embeddings)"
))
def _(t):
    d, e = t("documents").select("doc_id"), t("embeddings").select(F.col("vec_id").alias("doc_id"))
    n = lambda kind, x: x.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return n("both", d.intersect(e)).union(n("either", d.union(e).distinct())).union(n("only", d.exceptAll(e).distinct()))


@query("evl_recall", (
    "WITH r AS (SELECT source AS question, doc_id AS item, row_number() OVER (PARTITION BY source ORDER "
    "BY n_chars DESC, doc_id) AS rank FROM documents), x AS (SELECT source AS question, doc_id AS item "
    "FROM documents JOIN labels USING (doc_id) WHERE quality = 1) SELECT x.question, round(count(*) "
    "FILTER (r.rank <= 5)::DOUBLE / count(*), 4) AS recall, round(coalesce(1.0::DOUBLE / min(r.rank), "
    "0), 4) AS reciprocal_rank FROM x LEFT JOIN (SELECT * FROM r WHERE rank <= 20) r USING (question, "
    "item) GROUP BY x.question"
))
def _(t):
    d = t("documents")
    ranking = retrieval.best_per_key(d.select(F.col("source").alias("question"), F.col("doc_id").alias("item"), "n_chars"), "question", [F.desc("n_chars"), F.col("item")], 20).drop("n_chars")
    expected = d.join(t("labels").where("quality = 1"), "doc_id").select(F.col("source").alias("question"), F.col("doc_id").alias("item"))
    return evaluation.recall_and_reciprocal_rank(ranking, expected, 5)


@query("fil_status", (
    "SELECT user_id, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN count(*) >= 10 THEN "
    "'ready' ELSE 'preparing' END AS status FROM events GROUP BY user_id"
))
def _(t):
    return t("events").groupBy("user_id").agg(F.when(F.bool_or(F.col("event_type") == "error"), "failed").when(F.count(F.lit(1)) >= 10, "ready").otherwise("preparing").alias("status"))


_CONTROL = r"regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g')"
_CLOSE = (
    "(CASE WHEN coalesce(list_max(list_transform(range(1, len(tk) + 1), lambda i: len(list_intersect(list_distinct(tk[i:i "
    "+ 9]), {terms})))), 0) >= 3 THEN 0.012 ELSE 0 END)"
)
_QUERY_RANKS = " UNION ALL ".join((
    f"(SELECT {q} AS query, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT "
    f"embedding FROM embeddings WHERE vec_id = {q})::DOUBLE[]), 6) AS score FROM embeddings ORDER BY "
    f"score DESC, chunk_id LIMIT 20)"
) for q in range(3))
_NODES = (
    "SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding FROM "
    "embeddings WHERE vec_id = 0)::DOUBLE[]), 6) AS similarity FROM embeddings"
)


@query("str_context", (
    rf"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace({_CONTROL}, '[ \t]+', ' ', 'g'), "
    rf"'\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+\z', '', 'g')) AS context FROM documents"
))
def _(t):
    return t("documents").select("doc_id", F.md5(tx.clean_context(F.col("text"))).alias("context"))


@query("str_document", (
    rf"SELECT doc_id, md5(regexp_replace(regexp_replace({_CONTROL}, '\n{{4,}}', repeat(chr(10), 3), 'g'), "
    rf"'^\s+|\s+\z', '', 'g')) AS document FROM documents"
))
def _(t):
    return t("documents").select("doc_id", F.md5(tx.clean_document(F.col("text"))).alias("document"))


_FRAGMENTS_SQL = r"string_split_regex(regexp_replace(text, '^[^:]*:', ''), '(?i)\s*(?:[,;]|\bet\b|\band\b)\s*')"
_CLEAN_FRAGMENT = r"lambda x: regexp_replace(trim(regexp_replace(x, '\s+', ' ', 'g')), '^[ .:;,\-?¿!¡]+|[ .:;,\-?¿!¡]+$', '', 'g')"


@query(
    "rag_fragments",
    f"SELECT item_id, array_to_string(list_filter(list_transform({_FRAGMENTS_SQL}, {_CLEAN_FRAGMENT}), lambda x: length(x) >= 3), '|') AS fragments "
    "FROM benchmark",
)
def _(t):
    return t("benchmark").select("item_id", F.concat_ws("|", questions.fragments(F.col("text"))).alias("fragments"))


@query("clm_claims_documents")
def _(t):
    return t("documents").select("doc_id", F.concat_ws(",", claims.claims(F.col("text"))).alias("claims"))


@query("pe_token_estimate", "SELECT doc_id, ceil((100 + length(text)) / 3.0)::BIGINT AS n_tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", F.ceil((F.length("text") + 100) / F.lit(3.0)).alias("n_tokens"))


@query("ctx_fold", r"""WITH RECURSIVE r AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS i FROM conversations),
f AS (SELECT conv_id, 0::BIGINT AS i, '' AS context FROM r WHERE i = 1
  UNION ALL
  SELECT f.conv_id, r.i, coalesce(context || gap || CASE WHEN length(text) <= room THEN text WHEN room > 20 THEN rtrim(left(text, room), ' ') END, context)
  FROM f JOIN r ON r.conv_id = f.conv_id AND r.i = f.i + 1, LATERAL (SELECT CASE WHEN context = '' THEN '' ELSE chr(10) || chr(10) END AS gap),
    LATERAL (SELECT 6000 - length(context) - length(gap) AS room))
SELECT conv_id, context FROM f QUALIFY i = max(i) OVER (PARTITION BY conv_id)""")
def _(t):
    return contexts.folded(t("conversations"), "conv_id", "turn", "text", 6000)


@query("ret_fuzzy")
def _(t):
    return fuzzy.fuzzy_scores(chunk_table(t), ["eshaing", "anderning", "thtionel"])


_WORDS = "oument ouelle retion aiment"
_WORDS_SQL = str(_WORDS.split())
_MARKER_SQL = (
    rf"(?i){_EDGE}(?:is|clause|article|section|numero|numéro|n[°o]|ref|réf|reference|référence)\s*[-.:/]?\s*[A-Z0-9]+(?:[./-][A-Z0-9]+)*{_END}"
)


@query(
    "rrk_scores",
    f"SELECT doc_id, round(len(list_intersect(list_distinct(tk), {_WORDS_SQL})) * 0.004 "
    f"+ least(1, len(list_filter([{_TYPES_SQL}], lambda x: x IS NOT NULL))) * 0.018 "
    f"+ {_CLOSE.replace('{terms}', _WORDS_SQL)} + CASE WHEN regexp_matches(text, '{_MARKER_SQL}') THEN 0.006 ELSE 0 END, 6)::DOUBLE AS score "
    f"FROM (SELECT doc_id, text, {_TOKENS} AS tk FROM documents)",
)
def _(t):
    plan = search_plan.plan(_WORDS)
    return t("documents").select("doc_id", signals.score(signals.signals(F.col("text"), plan, full=False)).alias("score"))


def query_results(t) -> DataFrame:
    vectors = {r["vec_id"]: r["embedding"] for r in t("embeddings").where("vec_id < 3").collect()}
    return retrieval.vector_top_of_each(vector_table(t), vectors, 20).withColumnRenamed("similarity", "score")


@query("rag_merge", (
    f"SELECT chunk_id, count(DISTINCT query)::INT AS n_matched, max(score) AS best_score, round(max(score) "
    f"+ 0.006 * (count(DISTINCT query) - 1), 6)::DOUBLE AS merged_score FROM ({_QUERY_RANKS}) GROUP BY "
    f"chunk_id"
))
def _(t):
    return answers.merge_queries(query_results(t))


_TURNS = [f"c{q} AS (SELECT chunk_id, {q} AS turn FROM r WHERE query = {q}" + "".join(f" AND chunk_id NOT IN (SELECT chunk_id FROM c{p})" for p in range(q)) + " ORDER BY rank, chunk_id LIMIT 1)" for q in range(3)]


@query("rag_select", (
    f"WITH r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, chunk_id) AS rank FROM ({_QUERY_RANKS})), {', '.join(_TURNS)}, "
    f"t AS (SELECT * FROM c0 UNION ALL SELECT * FROM c1 UNION ALL SELECT * FROM c2), m AS (SELECT chunk_id, count(DISTINCT query) AS n, "
    f"round(max(score) + 0.006 * (count(DISTINCT query) - 1), 6)::DOUBLE AS merged_score FROM r GROUP BY chunk_id) SELECT chunk_id, merged_score, "
    f"(row_number() OVER (ORDER BY coalesce(turn, 3), merged_score DESC, n DESC, chunk_id))::INT AS position FROM m LEFT JOIN t USING (chunk_id) QUALIFY position <= 8"
))
def _(t):
    return answers.select_merged(query_results(t), 8, 3)


@query("rap_level_top", (
    f"SELECT label AS level, vec_id AS node_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION "
    f"BY label ORDER BY similarity DESC, vec_id) AS rank FROM ({_NODES})) WHERE rank <= 4"
))
def _(t):
    return retrieval.best_per_key(node_table(t), "level", [F.desc("similarity"), F.col("node_id")], 4).select("level", "node_id", "rank")


def node_table(t) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query_vector(t)])
    return t("embeddings").select(F.col("label").alias("level"), F.col("vec_id").alias("node_id"), F.round(vx.cosine(F.col("embedding"), q), 6).alias("similarity"))


@query("rap_diverse", (
    f"WITH n AS ({_NODES}), h AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY similarity "
    f"DESC, vec_id) AS r, max(similarity) OVER () AS best FROM n) SELECT label AS level, vec_id AS node_id, "
    f"similarity FROM h WHERE r = 1 AND similarity >= greatest(0.05, best * 0.75, best - 0.25)"
))
def _(t):
    return hierarchy.diverse(node_table(t))


@query("rap_roots", "SELECT vec_id AS node_id FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label)")
def _(t):
    n = node_table(t)
    edges = n.groupBy("level").agg(F.min("node_id").alias("parent")).join(n.select("level", F.col("node_id").alias("child")), "level").where("parent <> child").select("parent", "child")
    return hierarchy.roots(n, edges).select("node_id")


@query(
    "src_sample_class",
    "SELECT source AS doc_id, count(*)::INT AS sampled_pages, count(*) FILTER (usable)::INT AS usable_pages, coalesce(sum(solid) FILTER (usable), 0)::BIGINT AS usable_chars, "
    "CASE WHEN coalesce(sum(solid) FILTER (usable), 0) >= 100 OR coalesce(sum(solid) FILTER (usable), 0) / count(*) >= 30 THEN 'probably_native' ELSE 'probably_scanned' END AS probable_source "
    "FROM (SELECT source, page, solid, solid >= 12 AND alnum >= 8 AS usable FROM (SELECT source, length(regexp_replace(text, '\\s', '', 'g')) AS solid, "
    "length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS alnum, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents)) WHERE page <= 5 GROUP BY source",
)
def _(t):
    pages = retrieval.best_per_key(t("documents").select("source", "doc_id", "text"), "source", [F.col("doc_id")], 6, "page")
    return ingest.sample_class(pages.select(F.col("source").alias("doc_id"), "page", F.col("text").alias("native_text")))


@query(
    "evl_inclusion",
    "WITH r AS (SELECT source AS question, doc_id AS item FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r <= 30), "
    "x AS (SELECT source AS question, doc_id AS item FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents JOIN labels USING (doc_id) WHERE quality = 1) WHERE r <= 1) "
    "SELECT q.question, coalesce(bool_and(r.item IS NOT NULL) FILTER (x.item IS NOT NULL), true) AS success FROM (SELECT DISTINCT source AS question FROM documents) q "
    "LEFT JOIN x USING (question) LEFT JOIN r ON r.question = x.question AND r.item = x.item GROUP BY q.question",
)
def _(t):
    d = t("documents").select(F.col("source").alias("question"), F.col("doc_id").alias("item"), "n_chars")
    shown = retrieval.best_per_key(d, "question", [F.desc("n_chars"), F.col("item")], 30)
    good = d.join(t("labels").where("quality = 1").select(F.col("doc_id").alias("item")), "item")
    return evaluation.inclusion(d.select("question").distinct(), retrieval.best_per_key(good, "question", [F.col("item")], 1), shown)
