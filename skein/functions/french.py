"""Stems of French words by stripping suffixes, as full-text search in French does.

A word has three regions: RV, behind the first vowel that isn't its first letter (or behind the third letter of a word that begins with
two vowels); R1, behind the first consonant that follows a vowel; R2, the same within R1. A suffix goes only where it lies
in a region. Vowels that act as consonants are written in capitals meanwhile.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import lexicon

# Vowels, and the suffixes of the published stemming rules of French.
VOWELS = "aeiouyâàëéêèïîôûù"
_PLAIN = "ance iqUe isme able iste eux ances iqUes ismes ables istes".split()
_ATION = "atrice ateur ation atrices ateurs ations".split()
_I_VERBS = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait issant "
    "issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_E_VERBS = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_A_VERBS = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()
_OTHER = (
    "logie logies usion ution usions utions ence ences ement ements ité ités if ive ifs ives eaux aux euse euses issement issements "
    "amment emment ment ments"
).split()
_STOP = frozenset(lexicon.SEARCH_STOP_WORDS)
_DOUBLED = ("enn", "onn", "ett", "ell", "eill")

_V = f"[{VOWELS}]"
_REGION = re.compile(f".*?{_V}[^{VOWELS}]", re.S)


def _longest(word: str, suffixes, begin: int = 0) -> str | None:
    return max((s for s in suffixes if word.endswith(s) and len(word) - len(s) >= begin), key=len, default=None)


def _marked(word: str) -> str:
    """u and i between vowels, y beside one, and u behind q, in capitals."""
    out = list(word)
    for k, c in enumerate(out):
        before, after = k > 0 and out[k - 1] in VOWELS, k + 1 < len(out) and out[k + 1] in VOWELS
        if (c in "ui" and before and after) or (c == "y" and (before or after)) or (c == "u" and k and out[k - 1] == "q"):
            out[k] = c.upper()
    return "".join(out)


def _regions(word: str) -> tuple[int, int, int]:
    """Where RV, R1 and R2 begin."""
    n = len(word)
    if word[:3] in ("par", "col", "tap") or (n > 2 and word[0] in VOWELS and word[1] in VOWELS):
        rv = 3
    else:
        rv = next((k + 1 for k in range(1, n) if word[k] in VOWELS), n)
    one = m.end() if (m := _REGION.match(word)) else n
    two = m.end() if (m := _REGION.match(word, one)) else n
    return min(rv, n), one, two


class _Word:
    def __init__(self, text: str):
        self.text = _marked(text)
        self.rv, self.r1, self.r2 = _regions(self.text)

    def drop(self, suffix: str, region: int, other: str = "") -> bool:
        """Replaces the suffix if it lies in the region."""
        if not self.text.endswith(suffix) or len(self.text) - len(suffix) < region:
            return False
        self.text = self.text[: len(self.text) - len(suffix)] + other
        return True

    def drop_or(self, suffix: str, region: int, other: str) -> None:
        """Drops the suffix if it lies in the region; else replaces it."""
        if self.text.endswith(suffix) and not self.drop(suffix, region):
            self.drop(suffix, 0, other)

    def standard(self) -> tuple[bool, bool]:
        """Nominal endings: (whether the word has changed, whether verb endings come next)."""
        s = _longest(self.text, [*_PLAIN, *_ATION, *_OTHER])
        if s is None:
            return False, True
        before = self.text
        if s in _PLAIN:
            self.drop(s, self.r2)
        elif s in _ATION:
            if self.drop(s, self.r2):
                self.drop_or("ic", self.r2, "iqU")
        elif s.startswith("logie"):
            self.drop(s, self.r2, "log")
        elif s.startswith(("usion", "ution")):
            self.drop(s, self.r2, "u")
        elif s.startswith("ence"):
            self.drop(s, self.r2, "ent")
        elif s in ("ement", "ements"):
            if self.drop(s, self.rv):
                self._after_ement()
        elif s.startswith("ité"):
            if self.drop(s, self.r2):
                self._after_ity()
        elif s in ("if", "ive", "ifs", "ives"):
            if self.drop(s, self.r2) and self.drop("at", self.r2):
                self.drop_or("ic", self.r2, "iqU")
        elif s == "eaux":
            self.drop(s, 0, "eau")
        elif s == "aux":
            self.drop(s, self.r1, "al")
        elif s.startswith("euse"):
            self.drop(s, self.r2) or self.drop(s, self.r1, "eux")
        elif s.startswith("issement"):
            at = len(self.text) - len(s)
            if at and self.text[at - 1] not in VOWELS:
                self.drop(s, self.r1)
        elif s in ("amment", "emment"):
            self.drop(s, self.rv, "ant" if s[0] == "a" else "ent")
            return self.text != before, True
        else:  # ment, ments
            at = len(self.text) - len(s)
            if at > self.rv and self.text[at - 1] in VOWELS:
                self.drop(s, 0)
            return self.text != before, True
        return self.text != before, self.text == before

    def _after_ement(self) -> None:
        if self.text.endswith("iv"):
            if self.drop("iv", self.r2):
                self.drop("at", self.r2)
        elif self.text.endswith("eus"):
            self.drop("eus", self.r2) or self.drop("eus", self.r1, "eux")
        elif self.text.endswith(("abl", "iqU")):
            self.drop(self.text[-3:], self.r2)
        elif self.text.endswith(("ièr", "Ièr")):
            self.drop(self.text[-3:], self.rv, "i")

    def _after_ity(self) -> None:
        if self.text.endswith("abil"):
            self.drop_or("abil", self.r2, "abl")
        elif self.text.endswith("ic"):
            self.drop_or("ic", self.r2, "iqU")
        else:
            self.drop("iv", self.r2)

    def verb_i(self) -> bool:
        s = _longest(self.text, _I_VERBS, self.rv)
        at = len(self.text) - len(s or "")
        return s is not None and at > self.rv and self.text[at - 1] not in VOWELS and self.drop(s, self.rv)

    def verb(self) -> bool:
        s = _longest(self.text, ["ions", *_E_VERBS, *_A_VERBS], self.rv)
        if s is None or not self.drop(s, self.r2 if s == "ions" else self.rv):
            return False
        if s in _A_VERBS:
            self.drop("e", self.rv)
        return True

    def residual(self) -> None:
        t = self.text
        if t.endswith("s") and len(t) > 1 and t[-2] not in "aiouès":
            self.text = t[:-1]
        s = _longest(self.text, ["ion", "ier", "ière", "Ier", "Ière", "e"], self.rv)
        if s == "ion":
            at = len(self.text) - 3
            if at > self.rv and self.text[at - 1] in "st":
                self.drop(s, self.r2)
        elif s:
            self.drop(s, self.rv, "" if s == "e" else "i")


@lru_cache(maxsize=200_000)
def stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = _Word(word)
    changed, verbs = w.standard()
    if verbs:
        changed = w.verb_i() or w.verb() or changed
    if changed:
        w.text = re.sub("Y$", "i", re.sub("ç$", "c", w.text))
    else:
        w.residual()
    if w.text.endswith(_DOUBLED):
        w.text = w.text[:-1]
    return re.sub(f"[éè]([^{VOWELS}]+)$", r"e\1", w.text).lower()


def stems(tokens: Column) -> Column:
    """Stems of an array of words; stop words become null, so that the others keep their places."""
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [indexed(x) for x in t] for t in texts], dtype=object)

    return F.pandas_udf(of, "array<string>")(tokens)


def indexed(word: str) -> str | None:
    """The stem of a lower-case word; null for a stop word."""
    return None if word in _STOP else stem(word)


#: A word of a lower-case text.
WORD = r"[0-9a-zà-öø-ÿœ]+"


def words(c: Column) -> Column:
    """Lower-case words with their accents."""
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), 0)
