"""Signals of a chunk's text for a question, and the rerank score they add up to."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import lexicon
from skein.functions import text as tx
from skein.plans.search_plan import SearchPlan

# Weights of the signals.
WEIGHTS = {"term": 0.004, "value": 0.018, "phrase": 0.012, "marker": 0.006, "concept": 0.024, "other_concept": -0.014}


def concepts(text: Column) -> Column:
    """Business concepts of a text, in the order of the lexicon."""
    def found(t: Column) -> Column:
        each = [F.when(F.greatest(*[t.rlike(p) for p in ps]) if len(ps) > 1 else t.rlike(ps[0]), F.lit(k)) for k, ps in lexicon.CONCEPTS.items()]
        return F.array_compact(F.array(*each))

    return tx.bound(tx.concept_text(text), found)


def has_marker(text: Column) -> Column:
    return text.rlike(f"(?iuU){lexicon.STRUCTURED_MARKER}")


def names_deadline(folded: Column) -> Column:
    return F.greatest(*[folded.rlike(p) for p in lexicon.DEADLINE_PHRASES])


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def signals(text: Column, plan: SearchPlan, full: bool = True) -> Column:
    """struct: matched terms, the most terms close together, value kinds that count, phrase, marker, concepts; if not `full`, only what
    the score needs: concepts where one is expected, and no `close_terms`."""
    asked = sorted({*plan.intents, *(["time"] if "date" in plan.intents else [])})
    return signals_for(text, _strings(plan.base), F.lit(plan.concept).cast("string"), _strings(asked), full)


def signals_for(text: Column, wanted: Column, expected: Column, asked: Column, full: bool = True) -> Column:
    """The same for a question whose own terms, expected concept and wanted kinds of values are columns."""
    least = F.least(F.lit(3), F.size(wanted))

    def of(s: Column) -> Column:
        match = F.coalesce(F.array_contains(s["concepts"], expected), F.lit(False))
        other = expected.isNotNull() & (F.size(s["concepts"]) > 0) & ~match
        fitting = F.array_intersect(s["values"], asked)
        fitting = F.when(other, F.array_remove(fitting, "percentage")).otherwise(fitting)
        counting = F.when((F.size(fitting) == 0) & ~other, F.slice(s["values"], 1, 1)).otherwise(fitting)
        near = (F.size(wanted) > 0) & (tx.terms_in_window(s["tokens"], wanted, 10) >= least)
        return F.struct(
            F.array_sort(F.array_intersect(F.array_distinct(s["tokens"]), wanted)).alias("matched_terms"),
            *([tx.terms_in_window(s["tokens"], wanted, 12).alias("close_terms")] if full else []),
            s["values"].alias("value_types"),
            counting.alias("counting_types"),
            (names_deadline(s["folded"]) | near).alias("phrase_match"),
            has_marker(text).alias("structured_marker"),
            expected.alias("expected_concept"),
            s["concepts"].alias("concepts"),
            match.alias("concept_match"),
            other.alias("concept_mismatch"),
        )

    named = concepts(text) if full else F.when(expected.isNotNull(), concepts(text)).otherwise(F.array().cast("array<string>"))
    parts = lambda folded: F.struct(folded.alias("folded"), F.regexp_extract_all(folded, F.lit(tx.TOKEN), 0).alias("tokens"), tx.value_types(text).alias("values"), named.alias("concepts"))
    return tx.bound(tx.fold(text), lambda folded: tx.bound(parts(folded), of))


def score(s: Column, enabled: bool = True) -> Column:
    """The rerank score of signals; 0 if reranking is off."""
    if not enabled:
        return F.lit(0.0)
    flag = lambda c, w: F.when(c, F.lit(w)).otherwise(0.0)
    rest = [("phrase_match", "phrase"), ("structured_marker", "marker"), ("concept_match", "concept"), ("concept_mismatch", "other_concept")]

    def of(x: Column) -> Column:
        terms = F.size(x["matched_terms"]) * F.lit(WEIGHTS["term"])
        values = F.least(F.size(x["counting_types"]), F.lit(2)) * F.lit(WEIGHTS["value"])
        return F.round(terms + values + sum((flag(x[c], WEIGHTS[w]) for c, w in rest), F.lit(0.0)), 6)

    return tx.bound(s, of)
