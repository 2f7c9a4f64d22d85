"""Retrieval in a hierarchy of summaries: nodes (node_id, level, similarity) and edges (parent, child)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import storage
from skein.functions import lexicon
from skein.functions import text as tx
from skein.functions import vectors as vx
from skein.operators import postings, retrieval

# Thresholds and bonuses.
VALUE_BONUS, WORD_BONUS, MOST_WORD_BONUS, NEAR_BONUS, NEAR_WORDS = 0.09, 0.012, 0.072, 0.06, 6
COVERAGE, MATCH_BONUS = 0.35, 0.015


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without a parent."""
    return nodes.join(edges.select(F.col("child").alias("node_id")).distinct(), "node_id", "left_anti")


def entry_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots, or the nodes of the highest level if every node has a parent; `place` is their order."""
    free = roots(nodes, edges)
    top = nodes.join(F.broadcast(nodes.agg(F.max("level").alias("level"))), "level", "left_semi")
    some = free.limit(1).agg(F.count(F.lit(1)).alias("some"))
    chosen = free.unionByName(top.crossJoin(F.broadcast(some)).where("some = 0").select(free.columns))
    return chosen.withColumn("place", F.row_number().over(Window.orderBy(F.desc("level"), "node_index", "node_id")))


def beam_search(nodes: DataFrame, edges: DataFrame, beam: int = 3, children: int = 4, depth: int = 4) -> DataFrame:
    """node_id, depth of the nodes visited from the roots: at each depth the `beam` best, and the best children of each of these.

    A node reached twice keeps its smallest depth. nodes have the similarity to the one question."""
    scored = nodes.select("node_id", "similarity")
    first = roots(nodes, edges).select(F.lit(0).alias("question_id"), "node_id", "similarity")
    found = _descended(first, edges, lambda below: below.join(scored, "node_id"), beam, children, depth)
    return found.select("node_id", "depth")


def beam_search_many(nodes: DataFrame, edges: DataFrame, questions: DataFrame, beam: int = 3, children: int = 4, depth: int = 4) -> DataFrame:
    """question_id, node_id, depth for all questions (question_id, embedding) at once; nodes have node_id, embedding.

    Roots are ranked in blocks of questions; below, only children of nodes in a beam are compared."""
    candidates = roots(nodes, edges).select(F.col("node_id").alias("chunk_id"), "embedding")
    first = postings.vector_many(candidates, questions, beam).select("question_id", F.col("chunk_id").alias("node_id"), "similarity")
    vectors, asked = nodes.select("node_id", "embedding"), questions.select("question_id", F.col("embedding").alias("question"))
    near = F.round(vx.cosine(F.col("embedding"), F.col("question")), 6).alias("similarity")

    def score(below: DataFrame) -> DataFrame:
        return below.join(vectors, "node_id").join(asked, "question_id").select("question_id", "parent", "node_id", near)

    return _descended(first, edges, score, beam, children, depth)


def _descended(first: DataFrame, edges: DataFrame, score, beam: int, children: int, depth: int) -> DataFrame:
    """Each depth's frontier is a table of its own, so that the plan of a depth doesn't contain those before it."""
    order = [F.desc("similarity"), F.col("node_id")]
    best = lambda rows: storage.written(retrieval.best_per_key(rows, "question_id", order, beam).drop("rank"), "frontier")
    frontier = best(first)
    seen = [frontier.select("question_id", "node_id", F.lit(0).alias("depth"))]
    for d in range(1, depth):
        below = edges.select("parent", F.col("child").alias("node_id")).join(frontier.select("question_id", F.col("node_id").alias("parent")), "parent").distinct()
        ranked = score(below).withColumn("r", F.row_number().over(Window.partitionBy("question_id", "parent").orderBy(*order))).where(F.col("r") <= children)
        reached = storage.written(ranked.select("question_id", "node_id", "similarity").distinct(), "reached")
        seen.append(reached.select("question_id", "node_id", F.lit(d).alias("depth")))
        frontier = best(reached)
    return reduce(DataFrame.unionByName, seen).groupBy("question_id", "node_id").agg(F.min("depth").alias("depth"))


def diverse(candidates: DataFrame, floor: float = 0.05, share: float = 0.75, margin: float = 0.25) -> DataFrame:
    """The best candidate of each level that isn't far below the best of all: level, node_id, similarity."""
    best = candidates.agg(F.max("similarity").alias("best"))
    enough = F.greatest(F.lit(floor), F.col("best") * share, F.col("best") - margin)
    w = Window.partitionBy("level").orderBy(F.desc("similarity"), "node_id")
    heads = candidates.withColumn("r", F.row_number().over(w)).where(F.col("r") == 1)
    return heads.join(F.broadcast(best)).where(F.col("similarity") >= enough).select("level", "node_id", "similarity")


def level_limit(top_k: int, most: int = 20) -> int:
    """Candidates of each level."""
    return min(most, max(2 * top_k, top_k + 2))


def loosely_equal(a: Column, b: Column) -> Column:
    """The same word, or both of at least five letters that begin with the same five."""
    return (a == b) | ((F.length(a) >= 5) & (F.length(b) >= 5) & (F.substring(a, 1, 5) == F.substring(b, 1, 5)))


def value_intents(question_tokens: list[str]) -> list[str]:
    return [k for k, words in lexicon.TREE_VALUE_INTENTS.items() if set(words) & set(question_tokens)]


def factual_score(text: Column, question_tokens: list[str]) -> Column:
    """struct: score, matched_tokens, matching_types. What speaks for a leaf as the place of a value that is asked for."""
    intents = value_intents(question_tokens)
    wanted = sorted({*intents, *(["time"] if "date" in intents else [])})
    asked = F.array(*[F.lit(t) for t in sorted(set(question_tokens))]).cast("array<string>")

    def of(s: Column) -> Column:
        matched = F.filter(asked, lambda q: F.exists(s["tokens"], lambda t: loosely_equal(q, t)))
        kinds = F.array_sort(F.array_intersect(s["types"], F.array(*[F.lit(w) for w in wanted]).cast("array<string>")))
        places = F.transform(matched, lambda q: F.filter(F.transform(s["tokens"], lambda t, i: F.when(loosely_equal(q, t), i)), lambda i: i.isNotNull()))
        near = F.exists(places, lambda a: F.exists(a, lambda i: F.size(F.filter(places, lambda b: F.exists(b, lambda j: F.abs(i - j) <= NEAR_WORDS))) > 1))
        near = F.when((F.size(matched) >= 2) & (F.size(s["tokens"]) >= 2) & near, NEAR_BONUS).otherwise(0.0)
        score = F.least(F.size(matched) * F.lit(WORD_BONUS), F.lit(MOST_WORD_BONUS)) + near + F.least(F.size(kinds), F.lit(2)) * F.lit(VALUE_BONUS)
        return F.struct(F.when(F.size(kinds) > 0, F.round(score, 6)).otherwise(0.0).alias("score"), matched.alias("matched_tokens"), kinds.alias("matching_types"))

    folded = F.replace(tx.fold(text), F.lit("�"), F.lit(""))
    return tx.bound(F.struct(tx.tree_tokens(text).alias("tokens"), tx.matching(folded, lexicon.TREE_VALUE_PATTERNS).alias("types")), of)


def canonical(best_first: bool = True) -> list:
    """The order of candidates: selection score, similarity, distance, level, place in the level, id."""
    return [F.desc("selection_score"), F.desc("similarity"), F.asc("distance"), F.col("level"), F.col("node_index"), F.col("node_id")]


def factual_candidates(leaves: DataFrame, question_tokens: list[str], k: int = 8) -> DataFrame:
    """The k leaves (node_id, level, node_index, text, similarity, distance) with the best selection score among those whose values
    fit the question; their reason is factual_leaf."""
    scored = leaves.withColumn("f", factual_score(F.col("text"), question_tokens)).where("f.score > 0")
    scored = scored.withColumn("selection_score", F.round(F.col("similarity") + F.col("f.score"), 6)).withColumn("reason", F.lit("factual_leaf"))
    return scored.drop("f").orderBy(*canonical()).limit(k)


def better_of_two(kept: DataFrame, added: DataFrame) -> DataFrame:
    """Candidates of both; where both have a node, the better one, and of equals the one that was there."""
    both = kept.withColumn("turn", F.lit(0)).unionByName(added.withColumn("turn", F.lit(1)))
    w = Window.partitionBy("node_id").orderBy(*canonical(), "turn")
    return both.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "turn")


def final_selection(candidates: DataFrame, limit: int) -> DataFrame:
    """The chosen candidates, in order: heads of levels that are good enough (half of the places at most), then leaves with
    fitting values, then the rest. Candidates are as many as searches return."""
    ranked = candidates.withColumn("place", F.row_number().over(Window.orderBy(*canonical())))
    ranked = ranked.withColumn("of_level", F.row_number().over(Window.partitionBy("level").orderBy(*canonical())))
    facts = ranked.agg(F.max(F.when(F.col("place") == 1, F.col("similarity"))).alias("best"), F.count_distinct("level").alias("levels"))
    rows = ranked.crossJoin(F.broadcast(facts))
    enough = F.greatest(F.lit(0.05), F.col("best") * 0.75, F.col("best") - 0.25)
    head = (F.col("of_level") == 1) & (F.col("similarity") >= enough)
    rows = rows.withColumn("head", head).withColumn("turn", F.when(head, F.sum(head.cast("int")).over(Window.orderBy("place"))))
    first = F.coalesce(F.col("turn") <= F.least(F.col("levels"), F.lit(max(1, (limit + 1) // 2))), F.lit(False))
    tier = F.when(first, 0).when((F.col("level") == 0) & (F.col("reason") == "factual_leaf"), 1).otherwise(2)
    chosen = rows.withColumn("tier", tier).orderBy("tier", "place").limit(limit)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy("place"))).drop("head", "turn", "best", "levels", "of_level", "place")


def expand_children(selected: DataFrame, edges: DataFrame, nodes: DataFrame, per_parent: int = 2, margin: float = 0.25) -> DataFrame:
    """Children of the selected summaries that aren't far below their parent, the best two of each; a child counts once."""
    parents = selected.where("level > 0").select(F.col("node_id").alias("parent"), F.col("selection_score").alias("above"), "position")
    free = nodes.join(selected.select("node_id"), "node_id", "left_anti")
    found = edges.join(F.broadcast(parents), "parent").join(free, F.col("child") == F.col("node_id")).where(F.col("selection_score") >= F.col("above") - margin)
    once = found.withColumn("r", F.row_number().over(Window.partitionBy("node_id").orderBy("position"))).where("r = 1")
    best = once.withColumn("r", F.row_number().over(Window.partitionBy("parent").orderBy(*canonical()))).where(F.col("r") <= per_parent)
    return best.select("node_id", "parent", "selection_score")


def merge_intents(results: DataFrame) -> DataFrame:
    """A row for each node of results (intent, node_id, level, node_index, similarity, distance, selection_score): its best result,
    the intents that it covers, and a score with a bonus for each further one."""
    w = Window.partitionBy("node_id").orderBy(*canonical(), "intent")
    best = results.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "intent")
    matched = results.where(F.col("selection_score") >= COVERAGE).groupBy("node_id").agg(F.array_sort(F.collect_set("intent")).alias("intents"))
    rows = best.join(matched, "node_id", "left").withColumn("intents", F.coalesce("intents", F.array().cast("array<int>")))
    bonus = F.greatest(F.size("intents") - 1, F.lit(0)) * MATCH_BONUS
    return rows.withColumn("merged_score", F.round(F.col("selection_score") + bonus, 6))


def select_intents(results: DataFrame, n_intents: int, limit: int) -> DataFrame:
    """The nodes chosen for several intents: the best one of each intent, in turn, then by merged score; `position` tells the order."""
    merged = merge_intents(results)
    order = [F.desc("merged_score"), F.desc("similarity"), F.asc("distance"), F.col("level"), F.col("node_index"), F.col("node_id")]
    own = results.where(F.col("selection_score") >= COVERAGE).groupBy("intent", "node_id").agg(F.max("selection_score").alias("own_score"))
    rows = own.join(merged, "node_id")
    best = rows.withColumn("r", F.row_number().over(Window.partitionBy("intent").orderBy(F.desc("own_score"), *order))).where("r = 1")
    turns = best.groupBy("node_id").agg(F.min("intent").alias("turn"))
    chosen = merged.join(turns, "node_id", "left").orderBy(F.coalesce("turn", F.lit(n_intents + 1)), *order).limit(limit)
    return chosen.withColumn("position", F.row_number().over(Window.orderBy(F.coalesce("turn", F.lit(n_intents + 1)), *order)))


def intent_coverage(selected: DataFrame, n_intents: int) -> DataFrame:
    """intent, covered: whether a selected node covers it."""
    every = selected.sparkSession.range(1, n_intents + 1).select(F.col("id").cast("int").alias("intent"))
    found = selected.select(F.explode("intents").alias("intent")).distinct().withColumn("covered", F.lit(True))
    return every.join(found, "intent", "left").select("intent", F.coalesce("covered", F.lit(False)).alias("covered"))


def closure(edges: DataFrame) -> DataFrame:
    """ancestor, node of all pairs of edges (parent, child) that a path of any length joins. Each round follows only the pairs
    that the round before has found; pairs known already are left out, so shared children count once and cycles end."""
    steps = storage.written(edges.select("parent", "child").distinct(), "edges")
    new = steps.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"))
    known = [new]
    while True:
        further = new.join(steps, F.col("node") == F.col("parent")).select("ancestor", F.col("child").alias("node")).distinct()
        new = storage.written(further.join(reduce(DataFrame.unionByName, known), ["ancestor", "node"], "left_anti"), "pairs")
        if new.isEmpty():
            return reduce(DataFrame.unionByName, known)
        known.append(new)


def descendant_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """ancestor, leaf of every summary node, whatever the depth; a leaf reached by two ways is one."""
    leaves = nodes.where("level = 0").select(F.col("node_id").alias("node"))
    return closure(edges).join(leaves, "node").select("ancestor", F.col("node").alias("leaf"))
