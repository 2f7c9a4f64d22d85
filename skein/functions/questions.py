"""Taking questions apart, as Column expressions over a column of questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import lexicon
from skein.functions import text as tx

LEAST_FRAGMENT, MOST_PARTS = 3, 4
_EDGES = " .:;,\\-?¿!¡"


def _strip(c: Column, signs: str) -> Column:
    return F.regexp_replace(c, f"^[{signs}]+|[{signs}]+$", "")


def first_of_each(values: Column, key) -> Column:
    """The values whose key no earlier one has."""
    keys = F.transform(values, key)
    return tx.bound(F.struct(values.alias("v"), keys.alias("k")), lambda s: F.filter(s["v"], lambda v, i: F.array_position(s["k"], s["k"][i]) == i + 1))


def _capital(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, F.lit(2), F.length(c)))


def fragments(question: Column) -> Column:
    """Parts of a question, or of what follows its first colon, between commas, semicolons and conjunctions; short ones go."""
    listed = F.regexp_replace(question, "^[^:]*:", "")
    parts = F.transform(F.split(listed, lexicon.FRAGMENT_SEPARATOR.replace("(?iu)", "(?iuU)"), -1), lambda x: _strip(tx.clean_query(x), _EDGES))
    return F.filter(parts, lambda x: F.length(x) >= LEAST_FRAGMENT)


def restarts(question: Column) -> Column:
    """Questions that begin anew inside a question; empty if there aren't two."""
    parts = F.transform(F.split(question, lexicon.QUESTION_RESTART, -1), lambda x: _strip(tx.clean_query(x), _EDGES + "Â"))
    made = F.transform(F.filter(parts, lambda x: F.length(x) >= LEAST_FRAGMENT), lambda x: F.concat(_capital(x), F.lit(" ?")))
    return tx.bound(made, lambda m: F.when(F.size(m) < 2, F.array().cast("array<string>")).otherwise(F.slice(first_of_each(m, tx.fold), 1, MOST_PARTS)))


def intent_questions(question: Column) -> Column:
    """The questions that stand for the intents of the fragments, each once, in order."""
    def of(fragment: Column) -> Column:
        folded = tx.fold(fragment)
        return F.coalesce(*[F.when(folded.rlike(f"(?i){p}"), F.lit(q)) for p, q in lexicon.QUESTION_INTENTS.values()])

    return F.slice(F.array_distinct(F.array_compact(F.transform(fragments(question), of))), 1, MOST_PARTS)


def decompose(question: Column) -> Column:
    """struct: strategy (multi_query or single_query), subqueries (those of a multi query), search_text (what a single query
    searches for: the question of its one intent, else itself)."""
    def of(s: Column) -> Column:
        several = F.when(F.size(s["r"]) >= 2, s["r"]).when(F.size(s["i"]) >= 2, s["i"])
        return F.struct(
            F.when(several.isNotNull(), "multi_query").otherwise("single_query").alias("strategy"),
            F.coalesce(several, F.array().cast("array<string>")).alias("subqueries"),
            F.when(several.isNull(), F.when(F.size(s["i"]) == 1, s["i"][0]).otherwise(question)).alias("search_text"),
        )

    return tx.bound(F.struct(restarts(question).alias("r"), intent_questions(question).alias("i")), of)


def _ended(c: Column) -> Column:
    return F.regexp_replace(tx.clean_query(c), r"[\s.?!;:,]+$", "")


def asked(c: Column) -> Column:
    """A text as a question: no marks at its end, a capital first, a question mark."""
    return F.when(_ended(c) == "", "").otherwise(F.concat(_capital(_ended(c)), F.lit(" ?")))


def _listed(c: Column) -> Column:
    """A question for one item of a list."""
    words = tx.bare_words(_ended(c))
    begin = F.when(words.rlike("^(?:les|des) "), "Quelles sont ").when(words.rlike("^(?:le|un|montant|nom|delai) "), "Quel est ").otherwise("Quelle est ")
    return F.when(_ended(c) == "", "").otherwise(asked(F.concat(begin, _ended(c))))


def sub_intents(question: Column) -> Column:
    """struct: strategy (interrogative_restarts, imperative_list, single_intent or empty) and subintents, at most four."""
    q = tx.clean_query(question)
    filled = lambda parts: F.filter(parts, lambda x: x != "")
    once = lambda parts: F.slice(first_of_each(filled(parts), tx.bare_words), 1, MOST_PARTS)
    again = once(F.transform(F.split(q, lexicon.TREE_RESTART, -1), asked))
    body = F.regexp_replace(q, lexicon.IMPERATIVE, "")

    def items(part: Column) -> Column:
        kept = F.exists(F.array(*[F.lit(p) for p in lexicon.PROTECTED]), lambda p: F.contains(tx.bare_words(part), p))
        return F.when(kept, F.array(part)).otherwise(F.split(part, r"(?iu)\s+\bet\s+", -1))

    listed = once(F.transform(F.flatten(F.transform(F.split(body, r"\s*[,;]\s*", -1), items)), _listed))
    listed = F.when(q.rlike("[,;]") & q.rlike(lexicon.IMPERATIVE), listed)

    def of(s: Column) -> Column:
        case = F.when(s["q"] == "", F.struct(F.lit("empty").alias("strategy"), F.array().cast("array<string>").alias("subintents")))
        case = case.when(F.size(s["a"]) >= 2, F.struct(F.lit("interrogative_restarts").alias("strategy"), s["a"].alias("subintents")))
        case = case.when(F.size(s["l"]) >= 2, F.struct(F.lit("imperative_list").alias("strategy"), s["l"].alias("subintents")))
        return case.otherwise(F.struct(F.lit("single_intent").alias("strategy"), F.array(s["q"]).alias("subintents")))

    return tx.bound(F.struct(q.alias("q"), again.alias("a"), listed.alias("l")), of)


def checked(question: Column, most: int = 1000) -> Column:
    """struct: text (cleaned) and error (empty_query, query_too_long or null)."""
    return tx.bound(tx.clean_query(F.coalesce(question, F.lit(""))), lambda t: F.struct(
        t.alias("text"), F.when(t == "", "empty_query").when(F.length(t) > most, "query_too_long").alias("error")
    ))


def checked_top_k(value: Column, default: int = 5, most: int = 20) -> Column:
    """struct: top_k (the default for null or an empty text) and error (invalid_top_k or null)."""
    number = F.try_to_number(F.trim(value), F.lit("S99999999")).cast("int")
    given = F.when(value.isNull() | (value == ""), F.lit(default)).when(value.rlike(r"^\s*[+-]?\d{1,8}\s*$"), number)
    good = given.between(1, most)
    return F.struct(F.when(good, given).alias("top_k"), F.when(F.coalesce(good, F.lit(False)), F.lit(None).cast("string")).otherwise("invalid_top_k").alias("error"))
