"""What is searched for: terms, their variants and the expected values of one question, planned on the driver."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from skein.functions import lexicon

MOST_BASE, MOST_EXPANDED, MOST_SEARCHED = 16, 24, 32
FUZZY_LENGTH, MOST_FUZZY = 5, 8


def fold(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c)).lower()


def base_terms(question: str) -> list[str]:
    """Distinct words of at least two characters that aren't stop words, the first 16."""
    words = re.findall(r"[0-9a-z]+", fold(question))
    kept = dict.fromkeys(w for w in words if len(w) > 1 and w not in lexicon.SEARCH_STOP_WORDS)
    return list(kept)[:MOST_BASE]


def concepts(text: str) -> list[str]:
    plain = re.sub(r"\s+", " ", re.sub("[’‘`´]", "'", fold(text))).strip()
    return [k for k, patterns in lexicon.CONCEPTS.items() if any(re.search(p, plain) for p in patterns)]


def expected_concept(terms: list[str], question: str) -> str | None:
    """The one concept that the question names; none if it names several; else what its words point to."""
    named, has = concepts(question), set(terms)
    if named:
        return named[0] if len(named) == 1 else None
    if "offre" in has and has & {"garantie", "caution"}:
        return "bid_guarantee"
    if "garantie" in has and has & {"execution", "bonne"}:
        return "performance_guarantee"
    if "assurance" in has:
        return "insurance"
    if "garantie" in has and has & {"fournitures", "fourniture", "technique", "periode"}:
        return "technical_warranty"
    return None


def expanded(terms: list[str]) -> tuple[list[str], list[list[str]]]:
    """All terms with their synonyms, and a group of synonyms for each base term."""
    every, groups = list(terms), []
    for term in terms:
        group = [term]
        for other in lexicon.SYNONYMS.get(term, []):
            if other not in every:
                if len(every) >= MOST_EXPANDED:
                    continue
                every.append(other)
            if other not in group:
                group.append(other)
        groups.append(group)
    return every, groups


def searched(groups: list[list[str]]) -> list[list[str]]:
    """The groups with accented forms, of at most 32 different terms; a group always keeps one."""
    seen: set[str] = set()
    out = []
    for group in groups:
        terms: list[str] = []
        for form in (f for t in group for f in (t, lexicon.ACCENTED.get(t)) if f):
            if form not in terms and (form in seen or len(seen) < MOST_SEARCHED):
                terms.append(form)
                seen.add(form)
        out.append(terms or group[:1])
    return out


@dataclass(frozen=True)
class SearchPlan:
    question: str
    base: list[str]
    terms: list[str]
    groups: list[list[str]]
    fuzzy: list[str]
    intents: list[str]
    concept: str | None

    @property
    def added(self) -> list[str]:
        return self.terms[len(self.base) :]


def plan(question: str, expand: bool = True) -> SearchPlan:
    base = base_terms(question)
    terms, groups = expanded(base) if expand else (base, [[t] for t in base])
    return SearchPlan(
        question=question,
        base=base,
        terms=terms,
        groups=searched(groups),
        fuzzy=[t for t in base if len(t) >= FUZZY_LENGTH][:MOST_FUZZY],
        intents=sorted(k for k, words in lexicon.VALUE_INTENTS.items() if set(words) & set(base)),
        concept=expected_concept(base, question),
    )
