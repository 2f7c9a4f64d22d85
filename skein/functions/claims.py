"""Claims of a text: dates, times, percentages, durations, amounts and references in one form each, as kind=value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import lexicon
from skein.functions import text as tx

_NUMBER = r"\d+(?:[,.]\d+)?|[a-z]+(?:[-\s][a-z]+)?"
_NAMES = "|".join(sorted(lexicon.MONTHS, key=lambda m: (-len(m), m)))
# What a claim looks like in folded text.
PATTERNS = {
    "day_month_year": r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{2,4})\b",
    "day_name_year": rf"\b(\d{{1,2}})\s+({_NAMES})\.?\s+(\d{{2,4}})\b",
    "name_day_year": rf"\b({_NAMES})\.?\s+(\d{{1,2}}),?\s+(\d{{2,4}})\b",
    "time": r"\b([01]?\d|2[0-3])\s*(?::|h|heures?|hours?)\s*([0-5]\d)?\b",
    "percentage": rf"\b({_NUMBER})\s*(?:%|percent|per cent|pour\s*cent)(?=\W|$)",
    "duration": rf"\b({_NUMBER})\s*(jours?|days?|mois|months?|semaines?|weeks?)\b",
    "amount": r"\b\d+(?:[\s.]\d{3})*(?:[,.]\d+)?\s*(?:mad|dh|eur|euros?|usd|\$|€)\b",
    "reference": r"\b[a-z]{1,8}[-/]\d{1,6}(?:[-/][a-z0-9]{1,10})+\b",
}


def compact_digits(c: Column) -> Column:
    """Single digits with blanks between them, as scanned text has them, become one number; longer numbers stay apart."""
    return F.regexp_replace(c, r"(?<=(?<!\d)\d)\s+(?=\d(?!\d))", "")


def _map(values: dict[str, int]) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), F.lit(v))])


def number(c: Column) -> Column:
    """A folded number as text: decimal points, no leading zeros, or the sum of its number words; null if it has none."""
    def of(t: Column) -> Column:
        digits = F.regexp_replace(F.replace(t, F.lit(","), F.lit(".")), "^0+", "")
        words = F.transform(F.split(F.trim(t), r"\s+"), lambda w: F.try_element_at(_map(lexicon.NUMBER_WORDS), w))
        known = F.array_compact(words)
        total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0), lambda s, x: s + x).cast("string"))
        return F.when(t.rlike(r"^\d+(?:[,.]\d+)?$"), F.when(digits == "", "0").otherwise(digits)).otherwise(total)

    return tx.bound(compact_digits(F.replace(c, F.lit("-"), F.lit(" "))), of)


def _two(c: Column) -> Column:
    return F.lpad(c, 2, "0")


def _date(year: Column, month: Column, day: Column) -> Column:
    return F.concat_ws("-", F.lpad(F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year), 4, "0"), _two(month), _two(day))


def claims(c: Column) -> Column:
    """The distinct claims of a text, sorted."""
    def every(t: Column) -> Column:
        def each(kind: str, name: str, value) -> Column:
            p = PATTERNS[name]
            made = F.transform(F.regexp_extract_all(t, F.lit(p), F.lit(0)), lambda m: value(lambda i: F.regexp_extract(m, p, i)))
            return F.transform(F.array_compact(made), lambda v: F.concat(F.lit(f"{kind}="), v))

        month = lambda name: F.try_element_at(_map(lexicon.MONTHS), name).cast("string")
        unit = lambda u: F.when(u.rlike("^(?:jour|day)"), "day").when(u.rlike("^(?:semaine|week)"), "week").otherwise("month")
        return F.concat(
            each("date", "day_month_year", lambda g: _date(g(3), g(2), g(1))),
            each("date", "day_name_year", lambda g: _date(g(3), month(g(2)), g(1))),
            each("date", "name_day_year", lambda g: _date(g(3), month(g(1)), g(2))),
            each("time", "time", lambda g: F.concat(_two(g(1)), F.lit(":"), F.lpad(g(2), 2, "0"))),
            each("percentage", "percentage", lambda g: number(g(1))),
            each("duration", "duration", lambda g: F.concat(number(g(1)), F.lit(":"), unit(g(2)))),
            each("amount", "amount", lambda g: F.regexp_replace(g(0), r"\s+", "")),
            each("reference", "reference", lambda g: F.replace(g(0), F.lit(" "), F.lit(""))),
        )

    return F.array_sort(F.array_distinct(tx.bound(compact_digits(tx.fold(c)), every)))


def label(claim: Column) -> Column:
    """A claim's value as one says it."""
    value = F.regexp_extract(claim, "^[^=]*=(.*)$", 1)
    spoken = F.regexp_replace(value, r"^(.*):(day|week|month)$", "$1 $2s")
    return F.when(claim.startswith("duration="), spoken).when(claim.startswith("percentage="), F.concat(value, F.lit("%"))).otherwise(value)


def query_text(question: Column, claim: Column) -> Column:
    """What one searches for to support a claim."""
    return F.concat_ws(" ", question, F.regexp_extract(claim, "^([^=]*)=", 1), label(claim))


def gives_no_answer(answer: Column, exact: str = "Information not found in the provided document.") -> Column:
    found = F.exists(F.array(*[F.lit(m) for m in lexicon.NO_ANSWER]), lambda m: F.contains(tx.fold(answer), m))
    return (tx.fold(answer) == tx.fold(F.lit(exact))) | found
