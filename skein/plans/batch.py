"""Queries that answer every benchmark item at once over all documents, by way of an index, with the same in SQL by way of scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein import storage
from skein.functions import lexicon
from skein.functions import text as tx
from skein.functions import vectors as vx
from skein.operators import contexts, evaluation, evidence, fuzzy, hierarchy, layout, mixtures, postings, retrieval
from skein.operators.clustering import bic
from skein.plans import search_plan
from skein.plans.queries import _ALL_TERMS, _FOLD, _MARKER_SQL, _TOKENS, _TYPES_SQL, GROUPS, chunk_table, query, vector_table
from skein.sources import buckets

_WORDS = f"list_filter(regexp_extract_all({_FOLD}, '[0-9a-z]+'), lambda x: length(x) > 1 AND NOT list_contains({lexicon.SEARCH_STOP_WORDS}, x))"
_SYNONYMS = ", ".join(f"('{t}', '{s}')" for t, others in lexicon.SYNONYMS.items() for s in others)
#: Groups of a question are its first 16 different words with their synonyms; the caps on added words never bind here.
_QUESTIONS = f"""
words AS (SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i)[1:16] AS base FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
own AS (SELECT item_id, unnest(base) AS term, generate_subscripts(base, 1) AS g, len(base) AS n FROM words),
wanted AS (SELECT item_id, term, g, n, true AS base FROM own
  UNION ALL SELECT o.item_id, s.other, o.g, o.n, EXISTS (SELECT 1 FROM own b WHERE b.item_id = o.item_id AND b.term = s.other)
  FROM own o JOIN (VALUES {_SYNONYMS}) s(term, other) USING (term)),
tokens AS (SELECT doc_id, unnest(tk) AS term, generate_subscripts(tk, 1) - 1 AS p FROM (SELECT doc_id, {_TOKENS} AS tk FROM documents)),
hits AS (SELECT w.item_id, t.doc_id, t.p, w.g, w.n, w.base FROM tokens t JOIN wanted w USING (term)),
"""
_COVERS = """
matched AS (SELECT item_id, doc_id, any_value(n) AS n, count(DISTINCT p) FILTER (base) AS own FROM hits GROUP BY ALL HAVING count(DISTINCT g) = any_value(hits.n)),
places AS (SELECT item_id, doc_id, p, n, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY p) AS k FROM (SELECT DISTINCT item_id, doc_id, p FROM hits) JOIN matched USING (item_id, doc_id)),
lasts AS (SELECT x.item_id, x.doc_id, x.k, x.p, x.n, g.g, max(CASE WHEN h.g IS NOT NULL THEN x.k END) OVER (PARTITION BY x.item_id, x.doc_id, g.g ORDER BY x.k) AS last
  FROM places x JOIN (SELECT DISTINCT item_id, g FROM hits) g USING (item_id)
  LEFT JOIN (SELECT DISTINCT item_id, doc_id, p, g FROM hits) h ON h.item_id = x.item_id AND h.doc_id = x.doc_id AND h.p = x.p AND h.g = g.g),
firsts AS (SELECT item_id, doc_id, k, p, CASE WHEN count(last) = any_value(n) THEN min(last) END AS m FROM lasts GROUP BY ALL),
moves AS (SELECT *, coalesce(lag(m) OVER (PARTITION BY item_id, doc_id ORDER BY k), 0) AS before FROM firsts),
covers AS (SELECT c.item_id, c.doc_id, sum(0.1 / (1 + (c.p - f.p) - (c.k - f.k))) AS score FROM moves c JOIN places f ON f.item_id = c.item_id AND f.doc_id = c.doc_id AND f.k = c.m
  WHERE c.m > c.before GROUP BY ALL),
"""
_LEXICAL = f"""{_QUESTIONS}{_COVERS}
scored AS (SELECT item_id AS question_id, doc_id AS chunk_id, round(own * 0.1::DOUBLE, 6) AS base_score, round(coalesce(score, 0)::DOUBLE, 6) AS lexical_score
  FROM matched LEFT JOIN covers USING (item_id, doc_id)),
lexical AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY base_score DESC, lexical_score DESC, chunk_id)::INT AS rank FROM scored QUALIFY rank <= 20)
"""


def questions(t):
    """benchmark items; a vector of the same number stands for an item's."""
    vectors = t("embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    return t("benchmark").select(F.col("item_id").alias("question_id"), "text").join(vectors, "question_id", "left")


@query("ret_lexical_many", f"WITH {_LEXICAL} SELECT * FROM lexical")
def _(t):
    index = postings.build(chunk_table(t).select("chunk_id", "text"))
    return postings.lexical_many(index, postings.wanted_terms(questions(t)))


@query("ret_vector_many", (
    "SELECT * FROM (SELECT item_id AS question_id, e.vec_id AS chunk_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity, "
    "row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank "
    "FROM benchmark JOIN embeddings v ON v.vec_id = item_id, embeddings e) WHERE rank <= 20"
))
def _(t):
    return postings.vector_many(vector_table(t), questions(t))


@query("ret_hybrid_many", f"""WITH {_LEXICAL}, vector AS (SELECT * FROM (SELECT item_id AS question_id, e.vec_id AS chunk_id,
  round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity,
  row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank
  FROM benchmark JOIN embeddings v ON v.vec_id = item_id, embeddings e) WHERE rank <= 20),
fused AS (SELECT question_id, chunk_id, v.similarity, v.rank AS vector_rank, l.base_score, l.lexical_score, l.rank AS lexical_rank,
  round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 9) AS hybrid_score FROM vector v FULL JOIN lexical l USING (question_id, chunk_id))
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hybrid_score DESC, coalesce(lexical_rank, 1000000), coalesce(vector_rank, 1000000), chunk_id)::INT AS final_rank
FROM fused QUALIFY final_rank <= 5""")
def _(t):
    index = postings.build(chunk_table(t).select("chunk_id", "text"))
    return postings.hybrid_many(index, vector_table(t), questions(t))


_VECTOR = """vector AS (SELECT * FROM (SELECT item_id AS question_id, e.vec_id AS chunk_id,
  round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS similarity,
  row_number() OVER (PARTITION BY item_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, e.vec_id)::INT AS rank
  FROM benchmark JOIN embeddings v ON v.vec_id = item_id, embeddings e) WHERE rank <= 20)"""
#: Every candidate of each question. No item names a concept or a deadline, so these signals are left out.
_FUSED = f"""{_LEXICAL}, {_VECTOR},
fused AS (SELECT question_id, chunk_id, v.rank AS vector_rank, l.rank AS lexical_rank,
  round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + l.rank), 0), 9) AS hybrid_score FROM vector v FULL JOIN lexical l USING (question_id, chunk_id)),
near AS (SELECT f.*, w.base, d.text, (SELECT tk FROM (SELECT {_TOKENS} AS tk)) AS tk FROM fused f JOIN words w ON w.item_id = question_id JOIN documents d ON d.doc_id = chunk_id),
signed AS (SELECT *, round(len(list_intersect(list_distinct(tk), base)) * 0.004 + least(1, len(list_filter([{_TYPES_SQL}], lambda x: x IS NOT NULL))) * 0.018
  + CASE WHEN coalesce(list_max(list_transform(range(1, len(tk) + 1), lambda i: len(list_intersect(list_distinct(tk[i:i + 9]), base)))), 0) >= least(3, len(base)) THEN 0.012 ELSE 0 END
  + CASE WHEN regexp_matches(text, '{_MARKER_SQL}') THEN 0.006 ELSE 0 END, 6)::DOUBLE AS rerank_score FROM near),
final AS (SELECT question_id, chunk_id, vector_rank, lexical_rank, hybrid_score, rerank_score, round(hybrid_score + rerank_score, 9) AS final_score, text FROM signed),
ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY final_score DESC, hybrid_score DESC, coalesce(lexical_rank, 1000000), coalesce(vector_rank, 1000000), chunk_id)::INT AS position
  FROM final QUALIFY position <= 5)"""


def searched(t):
    """Every question's five best documents, reranked: question_id, chunk_id, ranks, scores, position."""
    asked, chunks = questions(t), chunk_table(t).select("chunk_id", "text")
    index = postings.build(chunks)
    lexical = postings.lexical_many(index, postings.wanted_terms(asked))
    vector = postings.vector_many(vector_table(t), asked)
    both = postings.fused_many(vector.withColumnRenamed("rank", "vector_rank"), lexical.withColumnRenamed("rank", "lexical_rank"), 1000)
    wanted = both.select("question_id", "chunk_id", "vector_rank", "lexical_rank", "hybrid_score")
    return storage.written(postings.reranked_many(wanted, asked.select("question_id", "text"), chunks), "searched")


@query("ret_reranked_many", f"WITH {_FUSED} SELECT * EXCLUDE (text) FROM ranked")
def _(t):
    return searched(t)


@query("ret_search_reports", f"""WITH {_FUSED} SELECT item_id AS question_id, count(vector_rank)::INT AS vector_candidates, count(lexical_rank)::INT AS lexical_candidates,
  (count(*) FILTER (vector_rank IS NOT NULL AND lexical_rank IS NOT NULL))::INT AS in_both, count(chunk_id)::INT AS candidates, (SELECT count(*) FROM ranked r WHERE r.question_id = item_id)::INT AS returned,
  (SELECT max(final_score) FROM ranked r WHERE r.question_id = item_id) AS best_score, 5 AS top_k, 20 AS candidate_limit FROM benchmark LEFT JOIN fused ON question_id = item_id GROUP BY item_id""")
def _(t):
    asked, chunks = questions(t), chunk_table(t).select("chunk_id", "text")
    index = postings.build(chunks)
    lexical = postings.lexical_many(index, postings.wanted_terms(asked)).withColumnRenamed("rank", "lexical_rank")
    fused = storage.written(postings.fused_many(postings.vector_many(vector_table(t), asked).withColumnRenamed("rank", "vector_rank"), lexical, 1 << 30), "fused")
    return postings.search_report(asked, fused, postings.reranked_many(fused, asked.select("question_id", "text"), chunks))


_EXPECTED = "SELECT item_id AS question, doc_id AS item FROM benchmark b JOIN documents d ON contains(d.text, b.text)"


@query("evl_stages_documents", f"""WITH {_FUSED}, x AS ({_EXPECTED}),
s AS (SELECT question_id AS question, chunk_id AS item, vector_rank AS rank, 'vector' AS stage FROM fused WHERE vector_rank IS NOT NULL
  UNION ALL SELECT question_id, chunk_id, lexical_rank, 'lexical' FROM fused WHERE lexical_rank IS NOT NULL
  UNION ALL SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY hybrid_score DESC, coalesce(lexical_rank, 1000000), coalesce(vector_rank, 1000000), chunk_id)::INT, 'rrf' FROM fused
  UNION ALL SELECT question_id, chunk_id, position, 'final' FROM ranked)
SELECT x.question, min(rank) FILTER (stage = 'vector') AS vector_rank, min(rank) FILTER (stage = 'lexical') AS lexical_rank, min(rank) FILTER (stage = 'rrf') AS rrf_rank,
  min(rank) FILTER (stage = 'rerank') AS rerank_rank, min(rank) FILTER (stage = 'final') AS final_rank FROM x LEFT JOIN s USING (question, item) GROUP BY x.question""")
def _(t):
    """At which rank each stage of the search has a document that holds the item's whole text. Such a document has all of its words,
    so the index finds them all, and only these are looked through."""
    asked, chunks = questions(t), chunk_table(t).select("chunk_id", "text")
    index = postings.build(chunks)
    every = storage.written(postings.lexical_many(index, postings.wanted_terms(asked, expand=False), 1 << 30), "matches")
    texts = asked.select("question_id", F.col("text").alias("asked"))
    held = every.join(chunks, "chunk_id").join(texts, "question_id").where(F.contains("text", "asked"))
    expected = held.select(F.col("question_id").alias("question"), F.col("chunk_id").alias("item"))
    lexical = postings.lexical_many(index, postings.wanted_terms(asked)).withColumnRenamed("rank", "lexical_rank")
    vector = postings.vector_many(vector_table(t), asked).withColumnRenamed("rank", "vector_rank")
    fused = storage.written(postings.fused_many(vector, lexical, 1 << 30), "fused")
    final = postings.reranked_many(fused, asked.select("question_id", "text"), chunks)
    stage = lambda rows, name, rank: rows.where(f"{rank} is not null").select(F.col("question_id").alias("question"), F.col("chunk_id").alias("item"), F.lit(name).alias("stage"), F.col(rank).alias("rank"))
    parts = [stage(fused, "vector", "vector_rank"), stage(fused, "lexical", "lexical_rank"), stage(fused, "rrf", "final_rank"), stage(final, "final", "position")]
    return evaluation.stage_ranks(reduce(DataFrame.unionByName, parts), expected)


#: The context of a question's results, block by block.
_CONTEXT_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0b-\x1f]', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+\z', '', 'g')"


@query("ctx_results", f"""WITH RECURSIVE {_FUSED}, blocks AS (SELECT question_id, position AS i, chunk_id, {_CONTEXT_CLEAN} AS t FROM ranked),
f AS (SELECT question_id, 0 AS i, '' AS context, 0 AS included, 0 AS omitted, false AS truncated FROM blocks WHERE i = 1
  UNION ALL
  SELECT question_id, i, CASE WHEN skip THEN context ELSE joined END, included + (NOT skip)::INT, omitted + skip::INT, truncated OR (narrow AND t <> '') OR (NOT skip AND (length(t) > two OR length(joined) >= 6000))
  FROM (SELECT *, CASE WHEN included > 0 THEN context || chr(10) || chr(10) || head || kept ELSE head || kept END AS joined, t = '' OR narrow AS skip FROM
    (SELECT *, one <= 20 OR (length(cut) > two AND two <= 20) AS narrow, CASE WHEN length(cut) > two THEN rtrim(left(cut, greatest(two, 0)), ' ') ELSE cut END AS kept FROM
      (SELECT *, CASE WHEN length(t) > one THEN rtrim(left(t, greatest(one, 0)), ' ') ELSE t END AS cut, one - CASE WHEN included > 0 THEN 2 ELSE 0 END AS two FROM
        (SELECT *, 6000 - length(context) - length(head) AS one FROM
          (SELECT f.question_id, b.i, b.t, f.context, f.included, f.omitted, f.truncated, '[source_' || (f.included + 1) || '; chunk_index=' || b.chunk_id || ']' || chr(10) AS head
           FROM f JOIN blocks b ON b.question_id = f.question_id AND b.i = f.i + 1))))))
SELECT question_id, md5(context) AS context, included, omitted, truncated FROM f QUALIFY i = max(i) OVER (PARTITION BY question_id)""")
def _(t):
    rows = searched(t).join(chunk_table(t).select("chunk_id", "text"), "chunk_id")
    listed = rows.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct("position", F.col("chunk_id").alias("chunk_index"), "text"))).alias("rows"))  # five each
    made = contexts.retrieval_context(F.transform("rows", lambda r: F.struct(r["chunk_index"], r["text"])))
    folded = listed.select("question_id", F.explode(F.array(made)).alias("c"))
    return folded.select("question_id", F.md5("c.text").alias("context"), "c.included", "c.omitted", "c.truncated")


_CONTENT = "list_filter(list_distinct(regexp_extract_all(lower(strip_accents({0})), '[a-z0-9]{{3,}}')), lambda x: NOT list_contains(" + str(lexicon.CONTENT_STOP_WORDS) + ", x))"


@query("evd_documents", f"""WITH {_FUSED}, c AS (SELECT r.question_id, position - 1 AS rank, final_score AS similarity, {_CONTENT.format('r.text')} AS tk, {_CONTENT.format('b.text')} AS own
  FROM ranked r JOIN benchmark b ON b.item_id = question_id),
s AS (SELECT question_id, rank, len(list_intersect(own, tk)) AS n, similarity FROM c),
v AS (SELECT question_id, rank, n::INT AS n_answer, round(2 * n + n + 0.01 * greatest(similarity, 0) - 0.001 * rank, 6)::DOUBLE AS support FROM s WHERE n >= 2)
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY support DESC, rank)::INT AS item FROM v QUALIFY item <= 4""")
def _(t):
    """Evidence among each item's results for the item as its own answer. No item has claims, so words decide."""
    asked = t("benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), F.col("text").alias("answer"))
    found = searched(t).select("question_id", "chunk_id", (F.col("position") - 1).alias("rank"), F.col("final_score").alias("similarity"))
    candidates = found.join(chunk_table(t).select("chunk_id", "text"), "chunk_id").join(asked, "question_id")
    return evidence.select_evidence(candidates).select("question_id", "rank", "n_answer", "support", "item")


@query("rap_mixtures")
def _(t):
    """The criterion of each number of components over all vectors."""
    vectors = mixtures.usable(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")))
    fits, n = mixtures.fit(storage.written(mixtures.reduced(vectors), "points"), 8)
    rows = [(k, float(m.log_likelihood), float(bic(m.log_likelihood, k, n, m.means.shape[1])), k == mixtures.best(fits, n)) for k, m in fits.items()]
    return t.spark.createDataFrame(rows, "components int, log_likelihood double, criterion double, best boolean")


@query("rap_layout")
def _(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return layout.laid_out(vectors, steps=10).select("id", *[F.get("point", F.lit(j)).alias(f"x{j}") for j in range(5)])


@query("rap_tree_vectors")
def _(t):
    nodes, edges = mixtures.tree(t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 8)
    below = edges.groupBy("level", F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("children"))
    return nodes.join(below, ["level", "node"], "left").select("level", "node", "children", F.round(F.sqrt(vx.dot(F.col("vector"), F.col("vector"))), 6).alias("norm"))


_FIXED = "VALUES " + ", ".join(f"(0, '{x}', {k}, {len(GROUPS)}, true)" for k, g in enumerate(GROUPS) for x in g)


@query("ret_covers", f"""WITH wanted AS (SELECT * FROM ({_FIXED}) v(item_id, term, g, n, base)),
tokens AS (SELECT doc_id, unnest(tk) AS term, generate_subscripts(tk, 1) - 1 AS p FROM (SELECT doc_id, {_TOKENS} AS tk FROM documents)),
hits AS (SELECT w.item_id, t.doc_id, t.p, w.g, w.n, w.base FROM tokens t JOIN wanted w USING (term)),{_COVERS.rstrip().rstrip(',')}
SELECT doc_id AS chunk_id, round(own * 0.1::DOUBLE, 6) AS base_score, round(coalesce(score, 0)::DOUBLE, 6) AS lexical_score FROM matched LEFT JOIN covers USING (item_id, doc_id)""")
def _(t):
    found = retrieval.matching(chunk_table(t).select("chunk_id", "text"), GROUPS)
    rank = retrieval.cover_density(retrieval.places_of(F.col("tokens"), GROUPS), F.lit(len(GROUPS)))
    return found.select("chunk_id", F.round(retrieval.hits(_ALL_TERMS) * retrieval.POSITION_WEIGHT, 6).alias("base_score"), F.round(rank, 6).alias("lexical_score"))


@query("ret_lexical_french")
def _(t):
    index = postings.build(chunk_table(t).select("chunk_id", "text"), config="french")
    return postings.lexical_many(index, postings.wanted_terms(questions(t), "french"))


def tree(t, *arity: int):
    """Edges of a tree over each label's vectors: number k in order of ids lies below number (k - 1) // arity; of a graph with shared
    children for several arities."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = t("embeddings").select("vec_id", "label", (F.row_number().over(order) - 1).alias("k"))
    parents = rows.select(F.col("vec_id").alias("parent"), "label", F.col("k").alias("at"))
    ups = F.array_distinct(F.array(*[F.floor((F.col("k") - 1) / n).cast("int") for n in arity]))
    below = rows.where("k > 0").select("label", F.col("vec_id").alias("child"), F.explode(ups).alias("at"))
    return below.join(parents, ["label", "at"]).select("parent", "child")


def _tree_sql(*arity: int) -> str:
    rows = "(SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings)"
    return " UNION ".join(f"SELECT p.vec_id AS parent, c.vec_id AS child FROM {rows} c JOIN {rows} p ON p.label = c.label AND c.k > 0 AND p.k = (c.k - 1) // {n}" for n in arity)


def _beam_sql(beam: int = 3, children: int = 4, depth: int = 4) -> str:
    near = "round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6)"
    best = "SELECT question_id, node_id FROM {0} QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY s DESC, node_id) <= " + str(beam)
    parts = [
        f"edges AS MATERIALIZED ({_tree_sql(4)})",
        "asked AS (SELECT item_id AS question_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id)",
        f"r0 AS (SELECT question_id, e.vec_id AS node_id, {near} AS s FROM asked v, embeddings e WHERE e.vec_id NOT IN (SELECT child FROM edges))",
        f"f0 AS MATERIALIZED ({best.format('r0')})",
    ]
    for d in range(1, depth):
        below = f"SELECT question_id, parent, child AS node_id, {near} AS s FROM f{d - 1} JOIN edges ON parent = node_id JOIN asked v USING (question_id) JOIN embeddings e ON e.vec_id = child"
        parts.append(f"r{d} AS MATERIALIZED (SELECT DISTINCT question_id, node_id, s FROM ({below}) QUALIFY row_number() OVER (PARTITION BY question_id, parent ORDER BY s DESC, node_id) <= {children})")
        parts.append(f"f{d} AS MATERIALIZED ({best.format(f'r{d}')})")
    seen = " UNION ALL ".join(f"SELECT question_id, node_id, {d} AS depth FROM {'r' if d else 'f'}{d}" for d in range(depth))
    return f"WITH {', '.join(parts)} SELECT question_id, node_id, min(depth) AS depth FROM ({seen}) GROUP BY ALL"


@query("rap_beam", _beam_sql())
def _(t):
    nodes = t("embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    asked = questions(t).where("embedding is not null").select("question_id", "embedding")
    return hierarchy.beam_search_many(nodes, tree(t, 4), asked)


@query("join_closure_graph", (
    f"WITH RECURSIVE edges AS ({_tree_sql(4, 3)}), w AS (SELECT parent AS ancestor, child AS node FROM edges UNION SELECT w.ancestor, e.child FROM w JOIN edges e ON e.parent = w.node) "
    "SELECT ancestor, count(*) AS descendants, min(node) AS first, max(node) AS last FROM w GROUP BY ancestor"
))
def _(t):
    pairs = hierarchy.closure(tree(t, 4, 3))
    return pairs.groupBy("ancestor").agg(F.count(F.lit(1)).alias("descendants"), F.min("node").alias("first"), F.max("node").alias("last"))


@query("src_replace_by_key", (
    "SELECT doc_id, lang, CASE WHEN doc_id % 5 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) "
    "UNION ALL SELECT -doc_id - 1, lang, n_chars FROM documents WHERE doc_id % 7 = 0"
))
def _(t):
    docs = t("documents").select("doc_id", "lang", "n_chars")
    kept = buckets.Table(t.spark, storage.new_path(t.spark, "keyed"))
    kept.create(docs, "doc_id")
    changed = docs.where("doc_id % 5 = 0").withColumn("n_chars", F.col("n_chars") + 1)
    kept.upsert(changed.union(docs.where("doc_id % 7 = 0").withColumn("doc_id", -F.col("doc_id") - 1)))
    kept.delete(t("labels").where("toxic = 1"))
    return kept.read()


@query("ret_fuzzy_vocabulary")
def _(t):
    words = lambda name: t(name).select(F.explode(tx.tokens(F.col("text"))).alias("w")).distinct()
    asked = words("benchmark").where(F.length("w") >= search_plan.FUZZY_LENGTH).select(F.col("w").alias("term"))
    return fuzzy.likely_pairs(asked, words("documents").select(F.col("w").alias("token")))
