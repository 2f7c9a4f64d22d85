"""Evidence for an answer: which retrieved texts support its claims, and what happens to claims that none supports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import claims as cl
from skein.functions import text as tx

MOST_ITEMS, MOST_RECOVERED = 4, 3
BLOCKED = "The answer could not be fully verified in the document evidence."


def evidence_score(claims: Column, answer_overlap: Column, question_overlap: Column, score: Column, rank: Column) -> Column:
    return F.round(12 * claims + 2 * answer_overlap + question_overlap + 0.01 * F.greatest(score, F.lit(0.0)) - 0.001 * rank, 6)


def admitted(candidates: DataFrame) -> DataFrame:
    """Candidates (question_id, question, answer, rank from 0, text, similarity) that can support the answer, with `matched`
    claims and `support`. With claims, a candidate needs one of them; without, two words of the answer or of the question."""
    answers = candidates.select("question_id", "question", "answer").distinct().select(
        "question_id", cl.claims(F.col("answer")).alias("answer_claims"), tx.content_tokens(F.col("answer")).alias("answer_tokens"),
        tx.content_tokens(F.col("question")).alias("question_tokens"), cl.gives_no_answer(F.col("answer")).alias("none"),
    )
    own = candidates.withColumns({"claims": cl.claims(F.col("text")), "tokens": tx.content_tokens(F.col("text"))})
    rows = own.join(answers, "question_id").withColumn("matched", F.array_intersect("answer_claims", "claims"))
    overlaps = [F.size(F.array_intersect(c, F.col("tokens"))) for c in ("answer_tokens", "question_tokens")]
    rows = rows.withColumns({"n_answer": overlaps[0], "n_question": overlaps[1]})
    has = F.size("answer_claims") > 0
    fits = (has & (F.size("matched") > 0)) | (~has & ~F.col("none") & ((F.col("n_answer") >= 2) | (F.col("n_question") >= 2)))
    support = evidence_score(F.size("matched"), F.col("n_answer"), F.col("n_question"), F.col("similarity"), F.col("rank"))
    return rows.where(fits).withColumn("support", support)


def select_evidence(candidates: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """The rows that are chosen as evidence, with `item` (1, 2, ...). A question has as many candidates as a search returns.

    With claims: again and again the candidate with most claims that none before it has, then with the best support; without:
    the best ones."""
    rows = admitted(candidates)
    one = F.struct("rank", "matched", "support")
    asked = rows.groupBy("question_id").agg(F.first("answer_claims").alias("wanted"), F.array_sort(F.collect_list(one)).alias("all"))

    def step(state: Column, _: Column) -> Column:
        free = F.filter("all", lambda c: ~F.array_contains(state["chosen"], c["rank"]))
        gain = lambda c: F.size(F.array_intersect(c["matched"], state["open"]))
        best = F.array_max(F.transform(free, lambda c: F.struct(gain(c).alias("gain"), c["support"].alias("support"), (-c["rank"]).alias("first"), c["matched"].alias("matched"))))
        go = best.isNotNull() & ((best["gain"] > 0) | (F.size("wanted") == 0))
        return F.when(go, F.struct(F.array_except(state["open"], best["matched"]).alias("open"), F.concat(state["chosen"], F.array(-best["first"])).alias("chosen"))).otherwise(state)

    start = F.struct(F.col("wanted").alias("open"), F.array().cast("array<int>").alias("chosen"))
    chosen = asked.select("question_id", F.posexplode(F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)["chosen"]).alias("item", "rank"))
    return rows.join(chosen.withColumn("item", F.col("item") + 1), ["question_id", "rank"])


def coverage(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """question_id, answer_claims, matched_claims, coverage (1 without claims), blocked, answer: what may be said."""
    asked = candidates.select("question_id", "answer").distinct().withColumn("claims", cl.claims(F.col("answer")))
    found = evidence.groupBy("question_id").agg(F.array_distinct(F.flatten(F.collect_list("matched"))).alias("matched"))
    rows = asked.join(found, "question_id", "left")
    n, m = F.size("claims"), F.coalesce(F.size("matched"), F.lit(0))
    m = F.greatest(m, F.lit(0))
    blocked = (n > 0) & (m < n)
    return rows.select(
        "question_id", n.alias("answer_claims"), m.alias("matched_claims"), F.when(n == 0, 1.0).otherwise(F.round(m / n, 6)).alias("coverage"),
        blocked.alias("blocked"), F.when(blocked, BLOCKED).otherwise(F.col("answer")).alias("answer"),
        F.array_sort(F.array_except("claims", F.coalesce("matched", F.array().cast("array<string>")))).alias("unsupported"),
    )


def recovery_queries(covered: DataFrame, questions: DataFrame, most: int = MOST_RECOVERED) -> DataFrame:
    """question_id, attempt, search_text: one search for each of the first unsupported claims, in alphabetical order."""
    rows = covered.join(questions, "question_id").select("question_id", "question", F.posexplode(F.slice("unsupported", 1, most)).alias("attempt", "claim"))
    return rows.select("question_id", (F.col("attempt") + 1).alias("attempt"), cl.query_text(F.col("question"), F.col("claim")).alias("search_text"))


def best_sentence(text: Column, claims: Column, answer_tokens: Column, question_tokens: Column, most: int = 520) -> Column:
    """A text of bounded length: all of it, or its sentence with most claims and words (the first of equals)."""
    whole = tx.clean_context(text)

    def best(t: Column) -> Column:
        parts = F.transform(F.split(t, r"(?<=[.!?;:])\s+"), lambda s: F.trim(s))
        worth = lambda s: 8 * F.size(F.array_intersect(claims, cl.claims(s))) + 2 * F.size(F.array_intersect(answer_tokens, tx.content_tokens(s))) + F.size(F.array_intersect(question_tokens, tx.content_tokens(s)))
        rated = F.transform(parts, lambda s, i: F.struct(worth(s).alias("w"), (-i).alias("i"), s.alias("s")))
        return F.when(F.length(t) <= most, t).otherwise(tx.excerpt(F.array_max(rated)["s"], most))

    return tx.bound(whole, best)


def items(evidence: DataFrame) -> DataFrame:
    """Evidence as it is shown: reason, claims as one says them, support rounded to 4 digits, excerpt."""
    w = Window.partitionBy("question_id").orderBy("item")
    return evidence.select(
        "question_id", F.row_number().over(w).alias("item"), "rank", F.round("support", 4).alias("support"),
        F.when(F.size("matched") > 0, "matched_answer_values").otherwise("matched_answer_terms").alias("reason"),
        F.array_sort(F.transform("matched", cl.label)).alias("supported_claims"),
        best_sentence(F.col("text"), F.col("answer_claims"), F.col("answer_tokens"), F.col("question_tokens")).alias("excerpt"),
    )
