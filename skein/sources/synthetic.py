"""A corpus of planted facts for evaluations: chunks of filler text, some with a fact, and questions about the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The facts, (id, value, label, kind, place of their dimension).
FACTS = [
    ("atlas_date", "17 mars 2029", "Programme Atlas", "date", 0),
    ("boreal_duration", "45 jours", "Cycle Boreal", "duration", 1),
    ("cygnus_amount", "12 400 MAD", "Budget Cygnus", "amount", 2),
    ("delta_percentage", "7,5 %", "Retenue Delta", "percentage", 3),
    ("zephyr_reference", "REF-ZEPHYR-904", "Reference Zephyr", "reference", 4),
    ("fenix_obligation", "rapport hebdomadaire", "Obligation Fenix", "obligation", 5),
    ("ocr_noise", "15 aout 2031", "Mission Ivoire", "date", 6),
]
SIZES = {"small": 8, "medium": 50, "large": 180}


def positions(n: int) -> dict[str, int]:
    """The chunk of each fact among n chunks; one that is taken is passed over to the right."""
    wanted = {
        "atlas_date": 0, "zephyr_reference": min(2, n - 1), "delta_percentage": max(1, n // 3), "boreal_duration": n // 2,
        "ocr_noise": min(n - 2, max(3, n // 2 + 1)), "cygnus_amount": n - 2, "fenix_obligation": n - 1,
    }
    taken: dict[int, str] = {}
    for fact, place in wanted.items():
        while place in taken:
            place = (place + 1) % n
        taken[place] = fact
    return {f: p for p, f in taken.items()}


def corpus(spark: SparkSession, name: str, n: int) -> DataFrame:
    """dataset, chunk_id, chunk_index, fact_id, text of n chunks."""
    values = {f: (value, label) for f, value, label, *_ in FACTS}
    fact = text = None
    for f, place in positions(n).items():
        here = F.col("id") == place
        said = f"{values[f][1]} : {values[f][0]}."
        fact = F.when(here, f) if fact is None else fact.when(here, f)
        text = F.when(here, said) if text is None else text.when(here, said)
    filler = F.concat(F.lit("Paragraphe courant numero "), F.col("id").cast("string"), F.lit(" sans valeur attendue."))
    rows = spark.range(n).select(F.lit(name).alias("dataset"), F.col("id").alias("chunk_id"), F.col("id").cast("int").alias("chunk_index"), fact.alias("fact_id"), text.otherwise(filler).alias("text"))
    return rows


def vector(text: Column, dimension: int = 100) -> Column:
    """A vector by the facts that a text names: 1 in the dimension of each fact whose label or value it has."""
    folded = F.lower(text)
    said = [(place, F.contains(folded, F.lit(label.lower())) | F.contains(folded, F.lit(value.lower()))) for _, value, label, _, place in FACTS]
    none = ~F.greatest(*[c for _, c in said])
    other = F.lit(20) + F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 2), 16, 10).cast("int"), F.lit(dimension - 20))
    hit = F.array(*[F.when(c, F.lit(place)) for place, c in said], F.when(none, other))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.when(F.array_contains(F.array_compact(hit), i), F.when(none, 0.08).otherwise(1.0)).otherwise(0.001))


def questions(spark: SparkSession) -> DataFrame:
    """question_id, question, fact_id of a question for each fact."""
    return spark.createDataFrame([(f, f"{label} : quelle valeur ?", f) for f, _, label, *_ in FACTS], "question_id string, question string, fact_id string")
