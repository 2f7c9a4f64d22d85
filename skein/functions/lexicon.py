"""Word lists and patterns for French and English business documents.

Everything in this module is a fixed value: results depend on it letter by letter.
"""

# Words of a question that no search is made for.
SEARCH_STOP_WORDS = (
    "a au aux avec ce ces dans de des du elle en est et il la le les pour que quel quelle quelles quels qui quoi sont sur "
    "the what when where which"
).split()
# Words that the retrieval in the summary hierarchy leaves out.
TREE_STOP_WORDS = [w for w in SEARCH_STOP_WORDS if w != "which"]
# Words that don't count as content when an answer is compared with its evidence.
CONTENT_STOP_WORDS = (
    "the and for from with what which when where does document answer provided dans avec pour quel quelle quels quelles est "
    "sont des les une un aux sur par que qui quoi offres offre"
).split()

SYNONYMS = {
    "duree": ["periode", "delai"],
    "periode": ["duree", "delai"],
    "delai": ["duree", "periode"],
    "date": ["delai", "echeance", "remise", "depot"],
    "limite": ["delai", "echeance"],
    "echeance": ["date", "limite", "delai"],
    "remise": ["depot", "date", "limite"],
    "depot": ["remise", "date", "limite"],
    "garantie": ["caution", "offre"],
    "caution": ["garantie", "offre"],
    "numero": ["reference", "marche", "contrat"],
    "marche": ["reference", "numero", "contrat"],
    "reference": ["numero", "marche", "contrat"],
    "contrat": ["numero", "reference", "marche"],
    "montant": ["valeur", "prix", "cout"],
    "valeur": ["montant", "prix", "cout"],
    "prix": ["montant", "valeur", "cout"],
    "cout": ["montant", "valeur", "prix"],
    "pourcentage": ["taux", "pourcent"],
    "taux": ["pourcentage", "pourcent"],
    "exige": ["exigee", "requise", "requis", "obligatoire"],
    "exigee": ["exige", "requise", "requis", "obligatoire"],
    "requis": ["requise", "exige", "exigee", "obligatoire"],
    "requise": ["requis", "exige", "exigee", "obligatoire"],
    "obligatoire": ["exige", "exigee", "requis", "requise"],
    "offre": ["soumission"],
    "soumission": ["offre"],
}
ACCENTED = {
    "duree": "durée",
    "periode": "période",
    "delai": "délai",
    "validite": "validité",
    "echeance": "échéance",
    "depot": "dépôt",
    "numero": "numéro",
    "reference": "référence",
    "cout": "coût",
    "pieces": "pièces",
    "quantite": "quantité",
    "exige": "exigé",
    "exigee": "exigée",
}

# Kinds of values that words of a question ask for.
VALUE_INTENTS = {
    "amount": "montant budget prix caution garantie devise".split(),
    "date": "date delai deadline echeance limite depot ouverture".split(),
    "duration": "duree delai jours mois ans".split(),
    "market_reference": "marche reference numero avis appel offres".split(),
    "percentage": "pourcentage taux percent retenue".split(),
    "quantity": "quantite nombre lots exemplaires pieces".split(),
    "time": "heure horaire delai date limite ouverture".split(),
}
TREE_VALUE_INTENTS = {
    "amount": "montant prix cout valeur garantie".split(),
    "date": "date delai limite depot echeance ouverture quand".split(),
    "duration": "duree dure validite validit periode delai jours".split(),
    "percentage": "pourcentage taux pourcent montant garantie".split(),
    "time": "heure horaire date limite ouverture".split(),
}

# Values in the text of a chunk as it stands.
_MONTHS = "janvier|fevrier|février|mars|avril|mai|juin|juillet|aout|août|septembre|octobre|novembre|decembre|décembre"
VALUE_PATTERNS = {
    "amount": r"\b(?:\d[\d\s.,]*(?:mad|dh|dhs|dirhams?|eur|euros?|€|\$)|(?:mad|dh|dhs|eur|€|\$)\s*\d[\d\s.,]*)\b",
    "date": rf"\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{1,2}}\s+(?:{_MONTHS})\s+\d{{4}})\b",
    "duration": r"\b\d+(?:[,.]\d+)?\s*(?:jours?|mois|ans?|annees?|années?|heures?)\b",
    "market_reference": r"\b[A-Z0-9]{2,}(?:[/-][A-Z0-9]{2,}){2,}\b",
    "percentage": r"\b\d+(?:[,.]\d+)?\s*%(?=\s|$|[.,;:])",
    "quantity": r"\b\d+(?:[,.]\d+)?\s*(?:unites?|unités?|pages?|lots?|exemplaires?|pieces?|pièces?)\b",
    "time": r"\b(?:\d{1,2}\s*(?:h|heure|heures)(?:\s*\d{2})?|\d{1,2}:\d{2})\b",
}
# Values in the folded text of a leaf.
_PLAIN_MONTHS = "janvier|fevrier|mars|avril|mai|juin|juillet|aout|septembre|octobre|novembre|decembre"
TREE_VALUE_PATTERNS = {
    "amount": r"\b(?:\d[\d\s.,]*(?:mad|dh|dhs|dirhams?|eur|euros?|\$)|(?:mad|dh|dhs|eur|\$)\s*\d[\d\s.,]*)\b",
    "date": rf"\b(?:\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}|\d{{1,2}}\s+(?:{_PLAIN_MONTHS})\s+\d{{4}})\b",
    "duration": r"\b\d(?:[\d\s.,]*\d)?\s*(?:jours?|mois|ans?|annees?|heures?)\b",
    "percentage": r"\b\d+(?:[,.]\d+)?\s*%",
    "time": r"\b\d{1,2}\s*(?:h|heure|heures)(?:\s*\d{2})?\b",
}
STRUCTURED_MARKER = (
    r"\b(?:is|clause|article|section|numero|numéro|n[°o]|ref|réf|reference|référence)\s*[-.:/]?\s*[A-Z0-9]+(?:[./-][A-Z0-9]+)*\b"
)
# The deadline for offers, both ways round, in folded text.
DEADLINE_PHRASES = [
    r"\b(?:date|delai)\s+limite\b.{0,80}\bdepot\b.{0,80}\boffres?\b",
    r"\bdepot\b.{0,80}\boffres?\b.{0,80}\b(?:date|delai)\s+limite\b",
]
# Concepts, in this order, in folded text of single spaces.
CONCEPTS = {
    "bid_guarantee": [
        r"\b(?:garantie|caution)\b.{0,80}\b(?:offres?|soumission)\b",
        r"\b(?:offres?|soumission)\b.{0,80}\b(?:garantie|caution)\b",
    ],
    "performance_guarantee": [
        r"\bgarantie\b.{0,40}\b(?:bonne\s+execution|execution)\b",
        r"\b(?:bonne\s+execution|execution)\b.{0,40}\bgarantie\b",
    ],
    "technical_warranty": [
        r"\bgarantie\b.{0,60}\b(?:fournitures?|technique|contractuelle)\b",
        r"\b(?:fournitures?|technique|contractuelle)\b.{0,60}\bgarantie\b",
        r"\bperiode\s+de\s+garantie\b",
    ],
    "insurance": [r"\bassurance\b"],
}

# Intents of a part of a question, in this order: pattern in folded text and the question that stands for it.
QUESTION_INTENTS = {
    "date_deadline": (
        r"\b(?:date|deadline|echeance|limite)\b|\bsubmission\s+deadline\b|\bdelai\s+limite\b",
        "Quelle est la date limite de depot des offres ?",
    ),
    "deposit_address": (r"\b(?:adresse|lieu)\b", "Quelle est l'adresse de depot des offres ?"),
    "bid_guarantee": (
        r"\b(?:garantie|caution)\b|\b(?:bid|offer|offre)\s+(?:guarantee|security|bond)\b"
        r"|\b(?:guarantee|security|bond)\s+(?:bid|offer|offre)\b",
        "Quelle garantie d'offre est exigee ?",
    ),
    "validity_duration": (
        r"\bvalidite\b.*\b(?:duree|periode|delai)\b|\b(?:duree|periode|delai)\b.*\bvalidite\b"
        r"|\bvalidity\b.*\b(?:duration|period|days?)\b|\b(?:duration|period|days?)\b.*\bvalidity\b",
        "Quelle est la duree de validite des offres ?",
    ),
    "amount": (r"\b(?:montant|budget|prix|cout|valeur)\b", "Quel est le montant exige ?"),
    "percentage": (r"(?:%|\b(?:pourcentage|taux|pourcent)\b)", "Quel pourcentage ou taux est exige ?"),
}
# Where a second question begins inside a question.
QUESTION_RESTART = (
    r"(?iu)\s*(?:(?:,\s*)?et|;|,)\s+(?=(?:(?:quel|quelle|quels|quelles)\s+(?:est|sont)\b|combien\b|ou\b|où\b|quand\b))"
)
# A word ends where no letter, number or underscore follows, as in the reference; \b would take marks and joiners for parts of it.
FRAGMENT_SEPARATOR = r"(?iu)\s*(?:[,;]|(?<![\p{L}\p{N}_])(?:et|and)(?![\p{L}\p{N}_]))\s*"
TREE_RESTART = r"(?iu)\s*(?:[,;]\s*|\bet\s+)(?=(?:quel|quelle|quels|quelles|combien|quand|ou)\b)"
IMPERATIVE = (
    r"(?iu)^\s*(?:donnez|donne|indiquez|indique|precisez|precise|listez|liste|resumez|resume)(?:\s*:|\s+)"
)
# Coordinations that stay together, in folded text of letters, digits and single spaces.
PROTECTED = [
    "date et heure limite",
    "date et heure limites",
    "date et l heure limite",
    "date et l heure limites",
    "nom et adresse",
    "cout d exploitation et maintenance",
    "couts d exploitation et maintenance",
    "cout d exploitation et de maintenance",
    "couts d exploitation et de maintenance",
]

NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
    "un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9, "dix": 10,
    "onze": 11, "douze": 12, "treize": 13, "quatorze": 14, "quinze": 15, "seize": 16, "vingt": 20, "trente": 30,
    "quarante": 40, "cinquante": 50, "soixante": 60,
}
MONTHS = {
    "janvier": 1, "january": 1, "jan": 1, "fevrier": 2, "february": 2, "feb": 2, "mars": 3, "march": 3, "mar": 3,
    "avril": 4, "april": 4, "apr": 4, "mai": 5, "may": 5, "juin": 6, "june": 6, "jun": 6, "juillet": 7, "july": 7,
    "jul": 7, "aout": 8, "august": 8, "aug": 8, "septembre": 9, "september": 9, "sept": 9, "sep": 9, "octobre": 10,
    "october": 10, "oct": 10, "novembre": 11, "november": 11, "nov": 11, "decembre": 12, "december": 12, "dec": 12,
}
# Signs in a folded answer that it gives none.
NO_ANSWER = [
    "information not found",
    "not found in the provided document",
    "does not specify",
    "does not state",
    "not specified",
    "not provided",
    "not mentioned",
    "not available",
    "non indique",
    "non indiquee",
    "n indique pas",
    "ne precise pas",
    "pas precise",
    "pas mentionne",
    "pas trouve",
]
PAGE_KEYS = ["page", "page_number", "source_page", "start_page", "first_page", "page_start"]
SECTION_KEYS = ["section", "heading", "title", "clause", "source_section"]
