"""Small reference tables as DataFrames: a starter myth table, narratives, patterns, invention dates.

The starter rows are examples of our own. A full myth base is read from files with ``read_myths``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from claimspark import lexicons as L
from claimspark import schema as S

_MYTHS = [
    ("bonaparte_height", 0, "Napoleon war klein", "Napoleon was short", "person_myth", "modern", "myth",
     "Mit rund 1,69 m lag er im Mittel seiner Zeit.", "At about 1.69 m he was of average height.",
     ("Britische Karikaturen", "um 1805", "Spott im Krieg"), ["napoleon", "klein", "short", "height"], ["A. Roberts"], ["bonaparte_complex"], 85),
    ("wall_from_moon", 1, "Die Chinesische Mauer ist vom Mond aus sichtbar", "The Great Wall of China is visible from the Moon",
     "event_myth", "medieval", "false", "Vom Mond aus ist kein Bauwerk zu sehen.", "No building can be seen from the Moon.",
     ("Reiseberichte", None, "Staunen"), ["mauer", "wall", "moon", "mond"], ["Y. Liwei"], [], 90),
    ("horned_helmets", 2, "Wikinger trugen Helme mit Hoernern", "Vikings wore horned helmets", "origin_myth", "medieval", "myth",
     "Kein Fund der Zeit zeigt Hoerner.", "No find of the period shows horns.",
     ("Opernkostueme", "1876", "Buehnenwirkung"), ["wikinger", "viking", "helmet", "horned"], ["R. Frank"], [], 80),
    ("flat_earth_sailor", 3, "Kolumbus wollte beweisen dass die Erde rund ist", "Columbus wanted to prove the earth is round",
     "event_myth", "early_modern", "false", "Die Kugelform war laengst bekannt.", "The round shape had long been known.",
     ("Romane", "1828", "Heldenbild"), ["kolumbus", "columbus", "flat", "round"], ["J. Russell", "S. Gould"], ["flat_earth_middle_ages"], 75),
    ("apple_on_head", 4, "Newton fiel ein Apfel auf den Kopf", "An apple fell on Newton's head", "person_myth", "early_modern", "disputed",
     "Er sah einen Apfel fallen.", "He watched an apple fall.", ("Biografie", "1752", "Anekdote"), ["newton", "apfel", "apple"], [], [], None),
    ("flat_earth_middle_ages", 5, "Im Mittelalter glaubte man an eine flache Erde", None, "event_myth", "medieval", "false",
     "Gelehrte kannten die Kugelgestalt.", None, ("Streitschriften", None, "Abwertung"), ["mittelalter", "flache", "scheibe"], ["J. Russell"],
     ["flat_earth_sailor"], 60),
]
_NARRATIVES = [
    ("lone_hero", "Der einsame Held", "The lone hero", "Ein einzelner loest alles.", ["Nur er konnte es"], ["held", "hero"],
     ["flat_earth_sailor", "apple_on_head"], "Verehrung"),
    ("dark_past", "Die finstere Zeit", "The dark past", "Frueher war man dumm.", ["Damals wusste niemand"], ["finster"],
     ["flat_earth_middle_ages", "unknown_myth"], "Abwertung"),
]
# Well-known errors with their correction and claim type.
MISCONCEPTIONS = [
    ("Napoleon war sehr klein", "Napoleon war mit 1,69m durchschnittlich gross fuer seine Zeit", "biographical"),
    ("Die Chinesische Mauer ist vom Mond aus sichtbar", "Die Chinesische Mauer ist vom Mond aus nicht sichtbar", "geographic"),
    ("Einstein war schlecht in Mathe", "Einstein war ein ausgezeichneter Mathematikstudent", "biographical"),
    ("Kolumbus wollte beweisen dass die Erde rund ist", "Im 15. Jahrhundert war bereits bekannt dass die Erde rund ist", "historical"),
    ("Marie Antoinette sagte Sollen sie Kuchen essen", "Es gibt keinen Beweis dass Marie Antoinette dies je sagte", "quote"),
    ("Wikinger trugen gehoernte Helme", "Es gibt keine historischen Belege fuer gehoernte Wikingerhelme", "historical"),
    ("Menschen im Mittelalter dachten die Erde sei flach", "Gebildete Menschen im Mittelalter wussten dass die Erde rund ist", "historical"),
    ("Der Hundertjaehrige Krieg dauerte 100 Jahre", "Der Hundertjaehrige Krieg dauerte 116 Jahre (1337-1453)", "historical"),
]


def myths(spark: SparkSession) -> DataFrame:
    rows = [(i, o, c, ce, cat, era, ["europe"], st, t, te, org, [("academic", f"Study of {i}", None, 2000, None)], kw, deb, rel, pop)
            for i, o, c, ce, cat, era, st, t, te, org, kw, deb, rel, pop in _MYTHS]
    return spark.createDataFrame(rows, S.MYTHS)


def narratives(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_NARRATIVES, S.NARRATIVES)


def misconceptions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MISCONCEPTIONS, "claim string, truth string, category string")


def read_myths(spark: SparkSession, path: str) -> DataFrame:
    """A myth base in JSON with the columns of ``schema.MYTHS``."""
    return spark.read.schema(S.MYTHS).json(path)


def seed_tables(spark: SparkSession) -> dict[str, DataFrame]:
    patterns = [(t, i, r, w, e) for t, w, e, regexes in L.TECHNIQUE_PATTERNS for i, r in enumerate(regexes)]
    return {
        "myths": myths(spark), "narratives": narratives(spark), "misconceptions": misconceptions(spark),
        "patterns": spark.createDataFrame(patterns, "technique string, ordinal int, regex string, weight double, explanation string"),
        "invention_dates": spark.createDataFrame(list(L.TECHNOLOGY_DATES.items()), "technology string, invented date"),
        "techniques": spark.createDataFrame(list(L.TECHNIQUES.items()), "technique string, description string"),
        "verdicts": spark.createDataFrame([(k, *v) for k, v in L.ANALYSIS_VERDICTS.items()], "verdict string, label_de string, label_en string"),
        "tiers": spark.createDataFrame([(t, L.TIER_RELIABILITY[t], L.TIER_BONUS[t]) for t in L.TIERS], "tier string, reliability double, bonus double"),
    }
