"""Column functions against hand-checked values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimspark.functions import dates as D
from claimspark.functions import names as N
from claimspark.functions import text as X
from claimspark.functions import tokens as T
from claimspark.operators.propaganda import with_propaganda


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, want", [("  Napoleon Bonaparte  ", "napoleon bonaparte"), ("LUDWIG XVI.", "ludwig xvi"),
                                       ("Jean-Luc   d'Arc", "jeanluc darc"), ("", ""), ("Émile\tZola!", "émile zola")])
def test_normalize_name(spark, raw, want):
    assert one(spark, N.normalize_name(F.col("a")), a=raw) == want


@pytest.mark.parametrize("a, b, want", [("test", "test", 1.0), ("napoleon", "napoléon", 0.875), ("", "x", 0.0), ("caesar", "napoleon", 1 - 7 / 8)])
def test_levenshtein_ratio(spark, a, b, want):
    assert one(spark, N.levenshtein_ratio(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


def plain_soundex(name):
    """The rule in plain words: digits by consonant class, everything else breaks a run."""
    if not name:
        return ""
    up = name.upper()
    code = dict(zip(N.SOUNDEX_LETTERS, N.SOUNDEX_DIGITS))
    digits = [code.get(ch, "0") for ch in up]
    kept = [d for before, d in zip(digits, digits[1:]) if d not in ("0", before)]
    return (up[0] + "".join(kept))[:4].ljust(4, "0")


@pytest.mark.parametrize("name", ["Robert", "Rupert", "Smith", "Smythe", "Ashcraft", "Großmann", "Müller", "", "a b c", "Tymczak", "Pfister", "BB", "Honeyman"])
def test_soundex4(spark, name):
    assert one(spark, N.soundex4(F.col("a")), a=name) == plain_soundex(name)


def test_soundex_pairs(spark):
    codes = {n: one(spark, N.soundex4(F.col("a")), a=n) for n in ("Robert", "Rupert", "Smith", "Smythe", "Ashcraft", "Großmann", "Müller")}
    assert codes["Robert"] == codes["Rupert"] and codes["Smith"] == codes["Smythe"]
    assert (codes["Ashcraft"], codes["Großmann"], codes["Müller"]) == ("A226", "G625", "M460")


def test_tokens(spark):
    assert one(spark, T.tokenize(F.col("a")), a="Die Zeitung, a b2 über_uns!") == ["die", "zeitung", "b2", "über_uns"]
    stems = one(spark, T.stemmed_tokens(F.col("a")), a="Zeitung asien reden ende er")
    assert stems == ["zeit", "asi", "red", "ende", "er"]
    assert one(spark, T.query_coverage(F.col("a"), F.col("b")), a="The cat the", b="a cat") == 0.5
    assert one(spark, T.jaccard_words(F.col("a"), F.col("b")), a="one two", b="Two three") == pytest.approx(1 / 3)


def test_synonyms_stay_unstemmed(spark):
    terms = one(spark, T.expand_synonyms(F.split(F.col("a"), " ")), a="europa x asi")
    assert set(terms) == {"europa", "x", "asi", "europe", "europaeisch"}


@pytest.mark.parametrize("raw, want", [("1815-06-18", dt.date(1815, 6, 18)), ("1815-06", dt.date(1815, 6, 1)), ("1815", dt.date(1815, 1, 1)),
                                       ("1815-02-30", None), ("-0044", None), ("about 1800", None)])
def test_partial_date(spark, raw, want):
    assert one(spark, D.partial_date(F.col("a")), a=raw) == want


def test_other_dates(spark):
    assert one(spark, D.year_date(F.col("a")), a=" 1769 ") == dt.date(1769, 1, 1)
    assert one(spark, D.year_date(F.col("a")), a="0") is None
    assert one(spark, D.statement_date(F.col("a")), a="+1769-00-00T00:00:00Z") == dt.date(1769, 1, 1)
    assert one(spark, D.statement_date(F.col("a")), a="-0044-03-15T00:00:00Z") is None
    assert one(spark, D.iso_date(F.col("a")), a="1769-08-15T00:00:00Z") == dt.date(1769, 8, 15)
    assert one(spark, D.leading_date(F.col("a")), a="1815-06-18+02:00") == dt.date(1815, 6, 18)
    assert tuple(one(spark, D.parse_point(F.col("a")), a="Point(2.35 48.85)")) == (48.85, 2.35)
    assert one(spark, D.parse_point(F.col("a")), a="nowhere") is None


def test_language_category_era(spark):
    assert one(spark, X.detect_language(F.col("a")), a="Das war der Kaiser") == "de"
    assert one(spark, X.detect_language(F.col("a")), a="hello") == "en"
    assert one(spark, X.guess_category(F.col("a")), a="He said hello") == "quote_myth"
    assert one(spark, X.guess_category(F.col("a")), a="Die Schlacht") == "war_myth"
    assert one(spark, X.guess_era(F.col("a")), a="Ein Ritter im Mittelalter") == "medieval"
    assert one(spark, X.guess_era(F.col("a")), a="x") == "modern"


def test_text_scores_with_sources(spark):
    df = spark.createDataFrame([("In 1815 Arthur Wellesley won the battle in Belgium.", 2, True, True, 0.9)],
                               "text string, source_count int, has_primary_source boolean, has_academic_source boolean, entity_score double")
    row = X.with_text_features(df).withColumn("rule", X.rule_score_text()).first()
    assert row["has_dates"] and row["has_names"] and row["mentions_event"]
    assert row["credibility_score"] == pytest.approx(0.3 + 0.25 + 0.2 + 0.18)
    assert row["specificity_score"] == pytest.approx(1.0)
    assert row["rule"] == pytest.approx(1.0)


@pytest.mark.parametrize("text, techniques", [
    ("studies show it", {"appeal_to_authority"}), ("studies show it, says the source", set()), ("studies show it\nthe source", {"appeal_to_authority"}),
    ("Das ist böse", {"loaded_language"}), ("bösewicht", set()), ("gefahrvoll", {"appeal_to_fear"}), ("ungefahr", set())])
def test_pattern_edges(spark, text, techniques):
    row = with_propaganda(spark.createDataFrame([(text,)], "text string")).first()
    assert {t["technique"] for t in row["techniques"]} == techniques


def test_propaganda_score_is_zero_or_flagged(spark, sf_dir):
    from checks.inputs import docs

    scores = with_propaganda(docs(spark, sf_dir)).select("propaganda_score", "is_propaganda").collect()
    assert all(r["propaganda_score"] == 0 or (r["propaganda_score"] >= 0.58 and r["is_propaganda"]) for r in scores)
    assert any(r["propaganda_score"] > 0 for r in scores)


def test_thresholds_ignore_the_last_bits_of_sums(spark):
    # 0.5 + 0.15 + 0.15 + 0.1 + 0.1 - 0.2 - 0.1 is 0.7000000000000001 in doubles
    df = spark.createDataFrame([("Arthur Wellesley, in 1815, in the battle of the city London: some say always.",)], "text string")
    row = X.with_text_features(df).withColumn("rule", X.rule_score_text()).first()
    assert row["uses_vague_language"] and row["uses_absolute_language"] and row["has_dates"] and row["mentions_location"]
    assert row["specificity_score"] == 0.7
    assert row["rule"] == pytest.approx(0.5 - 0.1 - 0.05 - 0.15)


def test_credibility_band_at_its_edge(spark):
    # 0.95 * 0.3 + 0.45 * 0.3 + 0.2 * 0.4 is 0.49999999999999994 in doubles
    score, band = X.credibility_overall(F.col("c"), F.col("p"), F.col("v"))
    row = spark.createDataFrame([(0.95, 0.55, 0.2)], "c double, p double, v double").select(score.alias("s"), band.alias("band")).first()
    assert row["s"] == 0.5 and row["band"] == "MODERATE CREDIBILITY"


def test_risk_level_at_its_edge(spark):
    # one technique of weight 1.0 found twice (0.7) and 0.1 for the technique: 0.7999999999999999 in doubles
    row = with_propaganda(spark.createDataFrame([("you hate what they hate",)], "text string"),
                          patterns=(("loaded_language", 1.0, "", (r"\bhate\b",)),)).first()
    assert row["propaganda_score"] == 0.8 and row["risk_level"] == "critical"
