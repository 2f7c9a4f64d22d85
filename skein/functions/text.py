"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions import lexicon



def _folding() -> tuple[str, str]:
    """Characters whose compatibility decomposition, without combining marks, is one other character, and that character."""
    blocks = ((0xA0, 0x250), (0x1E00, 0x1F00), (0x2070, 0x20A0), (0x2100, 0x2150), (0xFF01, 0xFF5F))
    pairs = {}
    for first, last in blocks:
        for c in map(chr, range(first, last)):
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
            if plain != c and len(plain) == 1:
                pairs[c] = plain
    return "".join(pairs), "".join(pairs.values())


_MARKED, _PLAIN = _folding()
#: Ligatures, of more than one letter each.
_LIGATURES = {c: unicodedata.normalize("NFKD", c) for c in map(chr, (*range(0xFB00, 0xFB07), 0x132, 0x133, 0x2026))}


def clean_text(c: Column) -> Column:
    """Line ends as \\n, no control characters, no blanks at line ends, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", "")
    c = F.regexp_replace(c, r"(?U)[^\S\n]+(?=\n|\z)", "")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean_query(c: Column) -> Column:
    """One line with single spaces."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def fold(c: Column) -> Column:
    """Lower case without marks; compatibility forms (ligatures, full width, superscripts) as plain characters. Plain texts
    are only lowered."""
    other = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), _MARKED, _PLAIN)
    for sign, plain in _LIGATURES.items():
        other = F.replace(other, F.lit(sign), F.lit(plain))
    return F.lower(F.when(c.rlike(r"[^\x00-\x7F]"), other).otherwise(c))


def bound(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


#: A token of a folded text.
TOKEN = r"[0-9a-z]+"


def tokens(c: Column) -> Column:
    """Runs of digits and letters a to z of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), 0)


def estimated_tokens(c: Column) -> Column:
    """A quarter of the length, halves to even, at least 1; 0 for an empty text."""
    return F.when(F.length(c) == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(F.length(c) / 4).cast("int")))


def usability(c: Column) -> Column:
    """Whether a page has at least 12 characters that aren't space and 8 letters or digits; both counts."""
    solid = F.length(F.regexp_replace(c, r"(?U)\s", ""))
    alnum = F.length(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.struct(solid.alias("solid"), alnum.alias("alnum"), ((solid >= 12) & (alnum >= 8)).alias("usable"))


def matching(c: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns that a text matches, in their order."""
    return bound(c, lambda t: F.array_compact(F.array(*[F.when(t.rlike(f"(?iuU){p}"), F.lit(k)) for k, p in patterns.items()])))


def value_types(c: Column) -> Column:
    """Kinds of values in a text, in alphabetical order."""
    return matching(c, lexicon.VALUE_PATTERNS)


def terms_in_window(tokens_: Column, terms: Column, size: int) -> Column:
    """The most distinct terms within so many consecutive tokens; 0 for none. Only windows that begin at a term are looked at, and only
    at the terms in them."""
    def most(t: Column) -> Column:
        found = F.filter(F.transform(t, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda p: F.array_contains(terms, p["x"]))

        def windows(hits: Column) -> Column:
            reach = lambda k: F.filter(F.slice(hits, k + 1, size), lambda p: p["i"] < F.get(hits, k)["i"] + size)
            return F.array_max(F.transform(hits, lambda _, k: F.size(F.array_distinct(F.transform(reach(k), lambda p: p["x"])))))

        return F.coalesce(bound(found, windows), F.lit(0))

    return F.when(tokens_.isNotNull(), bound(tokens_, most))


def sentences(c: Column) -> Column:
    """Parts between an end mark with white space after it."""
    return F.split(c, r"(?<=[.!?])\s+")


def prefix_context(c: Column, most: int) -> Column:
    """The first characters without blanks at their end."""
    return F.rtrim(F.substring(c, 1, most))


def clean_context(c: Column) -> Column:
    """No control characters, single blanks, at most one empty line in a row, trimmed."""
    c = F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", "")
    c = F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def clean_document(c: Column) -> Column:
    """No control characters, at most two empty lines in a row, trimmed."""
    c = F.regexp_replace(F.regexp_replace(c, r"[\x00-\x08\x0b-\x1f]", ""), r"\n{4,}", "\n\n\n")
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def content_tokens(c: Column) -> Column:
    """Distinct tokens of at least three letters or digits that carry content."""
    found = F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9]{3,}"), 0))
    return F.array_except(found, F.array(*[F.lit(w) for w in lexicon.CONTENT_STOP_WORDS]))


def tree_tokens(c: Column) -> Column:
    """Tokens of at least three characters without stop words, in order, as the hierarchy's retrieval takes them."""
    stop = F.array(*[F.lit(w) for w in lexicon.TREE_STOP_WORDS])
    plain = F.replace(fold(c), F.lit("\ufffd"), F.lit(""))
    found = F.regexp_extract_all(plain, F.lit(r"[0-9a-z]+"), 0)
    return F.filter(found, lambda t: (F.length(t) >= 3) & ~F.array_contains(stop, t))


def bare_words(c: Column) -> Column:
    """Folded text in which everything but letters and digits is a single space."""
    return F.trim(F.regexp_replace(fold(c), "[^0-9a-z]+", " "))


def concept_text(c: Column) -> Column:
    """Folded text with straight apostrophes and single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(c), "[\u2019\u2018`\u00b4]", "'"), r"(?U)\s+", " "))


def excerpt(c: Column, most: int = 520) -> Column:
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most)), F.lit("...")))


def bounded_fold(blocks: Column, most: int, least: int = 20) -> Column:
    """Blocks joined by empty lines within a budget of characters: the first that doesn't fit is cut if more than `least`
    characters are left, else skipped; later shorter ones may still follow."""
    def add(done: Column, block: Column) -> Column:
        gap = F.when(F.length(done) > 0, F.lit("\n\n")).otherwise(F.lit(""))
        room = F.lit(most) - F.length(done) - F.length(gap)
        cut = F.when(F.length(block) <= room, block).when(room > least, F.rtrim(F.substring(block, F.lit(1), F.greatest(room, F.lit(1)))))
        return F.coalesce(F.concat(done, gap, cut), done)

    return F.aggregate(blocks, F.lit(""), add)
