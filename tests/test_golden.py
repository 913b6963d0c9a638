"""Worked examples with known results: chronology, validation, evidence, features, batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from claimspark import schema as S
from claimspark.operators import batch as B
from claimspark.operators import chronology as C
from claimspark.operators import consensus as Q
from claimspark.operators import evidence as E
from claimspark.operators import features as feat
from claimspark.operators import kb as K
from claimspark.operators import resolve as R
from claimspark.operators import search
from claimspark.plans import validate as V


def nodes(spark, *rows):
    names = [f.split(" ")[0] for f in "claim_id ordinal node_type name description birth_date death_date start_date end_date date_value".split(" ")]
    types = "claim_id string, ordinal int, node_type string, name string, description string, birth_date date, death_date date, start_date date, end_date date, date_value date"
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], types)


def rels(spark, *rows):
    return spark.createDataFrame(list(rows), "claim_id string, ordinal int, source_name string, relation_type string, target_name string")


def person(birth, death):
    return dict(claim_id="c", ordinal=0, node_type="Person", name="P", birth_date=birth, death_date=death)


@pytest.mark.parametrize("birth, death, event, issues", [
    (dt.date(1900, 1, 1), dt.date(1980, 12, 31), dt.date(1950, 6, 15), 0),
    (dt.date(1980, 1, 1), dt.date(1900, 12, 31), None, 1),
    (dt.date(1900, 1, 1), dt.date(1980, 12, 31), dt.date(1850, 6, 15), 1)])
def test_lifespans(spark, birth, death, event, issues):
    rows = [person(birth, death)]
    if event:
        rows.append(dict(claim_id="c", ordinal=1, node_type="Event", name="E", start_date=event))
    found = C.check_lifespans(nodes(spark, *rows), rels(spark, ("c", 0, "P", "PARTICIPATED_IN", "E"))).collect()
    assert len(found) == issues
    assert all(i["severity"] == "critical" for i in found)
    if event == dt.date(1850, 6, 15):
        assert "could not have participated" in found[0]["message"]


def test_anachronism_and_order(spark):
    n = nodes(spark, dict(claim_id="c", ordinal=0, node_type="Event", name="Siege", start_date=dt.date(1800, 1, 1), description="by Telephone"),
              dict(claim_id="c", ordinal=1, node_type="Person", name="X", birth_date=dt.date(1750, 1, 1)))
    issue = C.check_anachronisms(n).first()
    assert (issue["severity"], issue["claim_value"], issue["fact_value"]) == ("high", "1800-01-01", "1876-03-10")
    row = C.chronology(n, rels(spark)).first()
    assert (row["is_consistent"], row["earliest_date"], row["latest_date"]) == (False, dt.date(1750, 1, 1), dt.date(1800, 1, 1))
    assert [r["event"] for r in C.timeline(n).orderBy("date").collect()] == ["Birth", "Event Start"]


def test_first_event_date_is_the_listed_one(spark):
    n = nodes(spark, person(dt.date(1900, 1, 1), None), dict(claim_id="c", ordinal=1, node_type="Event", name="E", end_date=dt.date(1890, 1, 1)),
              dict(claim_id="c", ordinal=2, node_type="Event", name="E", start_date=dt.date(1950, 1, 1)))
    row = C.related_events(n, rels(spark, ("c", 0, "P", "PARTICIPATED_IN", "E"))).first()
    assert row["event_date"] == dt.date(1890, 1, 1)


def test_node_and_rel_validation(spark):
    n = nodes(spark, dict(claim_id="c", ordinal=0, node_type="Event", name="Waterloo", start_date=dt.date(1815, 6, 18), end_date=dt.date(1815, 6, 18)),
              dict(claim_id="c", ordinal=1, node_type="Event", name="Waterloo", start_date=dt.date(1815, 6, 18), end_date=dt.date(1815, 6, 17)),
              dict(claim_id="c", ordinal=2, node_type="Planet", name=""))
    good, bad = S.validate_nodes(n)
    assert [r["ordinal"] for r in good.collect()] == [0]
    assert {r["ordinal"]: r["reject_reasons"] for r in bad.collect()} == {1: ["date_range"], 2: ["name", "node_type"]}
    good, bad = S.validate_rels(rels(spark, ("c", 0, "  Napoleon  ", "PARTICIPATED_IN", "  Waterloo  "), ("c", 1, "a", "LIKES", "b")))
    assert [tuple(r)[2:5] for r in good.collect()] == [("Napoleon", "PARTICIPATED_IN", "Waterloo")]
    assert bad.first()["reject_reasons"] == ["relation_type"]


FACTS = "fact_id string, ordinal int, name string, node_type string, aliases array<string>"


def test_resolution_cascade(spark):
    facts = spark.createDataFrame([("f1", 0, "Napoleon Bonaparte", "Person", ["Napoleon"]), ("f2", 1, "Napoleon Bonapart", None, []),
                                   ("f3", 2, "Napoleon Bonaparte", "Location", []), ("f4", 3, "Rupert", "Person", []), ("f5", 4, "x", "Planet", [])], FACTS)
    claims = spark.createDataFrame([("c", 0, "napoleon bonaparte", "Person"), ("c", 1, "Napoleon", "Person"), ("c", 2, "Robert", "Person")],
                                   "claim_id string, ordinal int, name string, node_type string")
    got = {(r["claim_name"], r["fact_id"]): (round(r["match_score"], 4), r["match_method"]) for r in R.resolve_entities(claims, facts, 0.8, "all").collect()}
    assert got == {("napoleon bonaparte", "f1"): (1.0, "exact"), ("napoleon bonaparte", "f2"): (0.9444, "fuzzy"), ("Napoleon", "f1"): (0.95, "alias")}
    low = {(r["claim_name"], r["fact_id"]): r["match_method"] for r in R.resolve_entities(claims, facts, 0.7, "all").collect()}
    assert low[("Robert", "f4")] == "phonetic"
    near = R.resolve_entities(claims, facts, 0.8, "contained").collect()
    assert {(r["claim_name"], r["fact_id"]) for r in near} == {("Napoleon", "f1")}


def test_exact_name_wins_over_many_containing_ones(spark):
    facts = spark.createDataFrame([(f"f{i}", i, f"Napoleon monument number {i}", "Person", []) for i in range(14)] + [("last", 99, "Napoleon", "Person", [])], FACTS)
    claims = spark.createDataFrame([("c", 0, "Napoleon", "Person")], "claim_id string, ordinal int, name string, node_type string")
    assert [(r["fact_id"], r["match_score"]) for r in R.resolve_entities(claims, facts).collect()] == [("last", 1.0)]
    assert R.fact_candidates(claims, facts).count() == 15


def test_facts_with_one_short_id_are_told_apart(spark):
    schema = "id string, claim string, is_true boolean, explanation string, source string, claim_type string, entities array<string>, confidence double"
    row = lambda claim: ("geo_12345678", claim, True, "", "wikidata", "geographic", [], 1.0)
    fresh = K.new_facts(spark.createDataFrame([row("a liegt in b"), row("c liegt in d"), row("c liegt in d"), row("e liegt in f")], schema), spark.createDataFrame([row("e liegt in f")], schema))
    assert sorted(r["claim"] for r in fresh.collect()) == ["a liegt in b", "c liegt in d"]


def test_validation_status(spark):
    claims = spark.createDataFrame([("a",), ("b",), ("c",), ("d",), ("e",)], "claim_id string")
    issue = lambda c, sev: (c, "x", sev, "", None, None, None, 1.0)
    issues = spark.createDataFrame([issue("a", "critical"), issue("a", "high"), issue("b", "high"), issue("c", "medium")],
                                   "claim_id string, issue_type string, severity string, message string, claim_entity string, claim_value string, fact_value string, confidence double")
    matches = spark.createDataFrame([("d", 0.9), ("d", 1.0)], "claim_id string, match_score double")
    got = {r["claim_id"]: (r["overall_status"], r["overall_confidence"]) for r in V.validation_status(claims, issues, matches).collect()}
    assert got == {"a": ("contradicted", 0.1), "b": ("suspicious", 0.3), "c": ("partially_verified", 0.6), "d": ("verified", pytest.approx(0.95)), "e": ("unverifiable", 0.5)}


RESULTS = "claim_id string, ordinal int, source_type string, tier string, found boolean, relevance_score double, reliability_score double, rating string"


@pytest.mark.parametrize("hits, confidence, verified, tier", [
    ([("tier_3_academic", 0.26030697), ("tier_3_academic", 0.7)], 0.53, True, "tier_3_academic"),
    ([("tier_1_authority", 0.5)], 0.65, True, "tier_1_authority"),
    ([("tier_3_academic", 0.301)], 0.351, False, "tier_3_academic"),
    ([("tier_3_academic", 0.39575), ("tier_3_academic", 0.7)], 0.598, True, "tier_3_academic"),
    ([], 0.0, False, None)])
def test_tier_weighted_verification(spark, hits, confidence, verified, tier):
    weight = {"tier_1_authority": 0.95, "tier_3_academic": 0.8}
    rows = [("q", i, "academic", t, True, rel, weight[t], None) for i, (t, rel) in enumerate(hits)] + [("q", 9, "fact_check", "tier_2_factcheck", False, 0.0, 0.85, "")]
    row = E.aggregate_sources(spark.createDataFrame(rows, RESULTS)).first()
    assert (row["confidence"], row["verified"], row["highest_tier"], row["sources_checked"]) == (confidence, verified, tier, len(rows))


def test_votes(spark):
    claims = spark.createDataFrame([("none",), ("tie",), ("mis",), ("unv",), ("yes",)], "claim_id string")
    v = "claim_id string, ordinal int, verdict string, confidence double, explanation string, correction string, claim_type string"
    votes = spark.createDataFrame([
        ("tie", 0, "true", 0.6, "a", None, None), ("tie", 1, "false", 0.6, "b", "fix", "historical"), ("mis", 0, "misleading", 0.4, "c", "d", None),
        ("unv", 0, "unverifiable", 0.9, "", None, "weird"), ("yes", 0, "true", 0.95, "sure", None, "quote"), ("yes", 1, "false", 0.01, "no", None, None)], v)
    got = {r["claim_id"]: (r["verdict"], round(r["confidence"], 3), r["explanation"], r["correction"], r["claim_type"]) for r in E.merge_votes(claims, votes).collect()}
    assert got["none"] == ("unverifiable", 0.0, "Keine Quelle konnte die Behauptung pruefen.", None, "other")
    assert got["tie"] == ("false", 0.5, "b", "fix", "historical")
    assert got["mis"] == ("false", 0.95, "Basierend auf verfuegbaren Quellen.", None, "other")
    assert got["unv"][:2] == ("unverifiable", 0.3)
    assert got["yes"] == ("true", 0.95, "sure", None, "quote")


def test_rule_scores_and_features(spark):
    base = dict(num_critical_issues=0, num_high_issues=0, entity_match_rate=0.0, completeness_score=0.0, specificity_score=0.0,
                consistency_score=0.0, uses_vague_language=False, dates_in_future=False)
    def score(**kw):
        return spark.createDataFrame([{**base, **kw}]).select(feat.rule_score_graph().alias("s")).first()["s"]
    assert score(entity_match_rate=0.9, completeness_score=0.8, specificity_score=0.7, consistency_score=0.8) > 0.6
    assert score(entity_match_rate=0.5, num_critical_issues=3, dates_in_future=True) < 0.3
    shape = dict(num_nodes=10, nodes_with_dates=0.8, relationships_per_node=1.5, avg_description_length=150.0, has_specific_numbers=False, uses_vague_language=False, num_dates=0)
    high = feat.with_graph_scores(spark.createDataFrame([shape])).first()["completeness_score"]
    low = feat.with_graph_scores(spark.createDataFrame([{**shape, "num_nodes": 1, "nodes_with_dates": 0.0, "relationships_per_node": 0.0, "avg_description_length": 0.0}])).first()["completeness_score"]
    assert high > 0.7 and low < 0.3
    n = nodes(spark, dict(claim_id="c", ordinal=0, node_type="Person", name="Napoleon", birth_date=dt.date(1769, 8, 15)), dict(claim_id="c", ordinal=1, node_type="Person", name="Josephine"),
              dict(claim_id="c", ordinal=2, node_type="Event", name="Battle of Waterloo"))
    f = feat.graph_features(spark.createDataFrame([("c",)], "claim_id string"), n, rels(spark, ("c", 0, "Napoleon", "PARTICIPATED_IN", "Battle of Waterloo"))).first()
    assert (f["num_nodes"], f["num_persons"], f["num_events"], f["num_relationships"]) == (3, 2, 1, 1)
    assert f["nodes_with_dates"] == pytest.approx(1 / 3)


def test_batch_progress_and_duplicates(spark):
    items = spark.createDataFrame([("j", 1, "success"), ("j", 2, "success"), ("j", 3, "failed"), ("j", 4, "queued")], "job_id string, item_id int, status string")
    assert B.batch_progress(items).first()["progress_percent"] == 75.0
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "item_id int, text string")
    marked = {r["item_id"]: r["status"] for r in B.mark_duplicates(texts).collect()}
    assert marked == {1: "queued", 2: "queued", 3: "skipped"}
    hashes = {r["item_id"]: r["text_hash"] for r in B.mark_duplicates(texts).collect()}
    assert hashes[1] == hashes[3] != hashes[2] and len(hashes[1]) == 16


def test_consensus_defaults_and_strict(spark):
    n = spark.createDataFrame([("c", 0, 0, "Person", "Ann", 0.5), ("c", 1, 0, "Person", "ANN", 0.9), ("c", 2, 0, "Person", "Bob", 1.0)],
                              "claim_id string, run_id int, ordinal int, node_type string, name string, confidence double")
    r = spark.createDataFrame([], "claim_id string, run_id int, ordinal int, source_name string, relation_type string, target_name string, confidence double")
    loose, _ = Q.consensus(n, r, 3)
    got = {x["key"]: (x["name"], round(x["confidence"], 4)) for x in loose.collect()}
    assert got == {"Person:ann": ("ANN", round(0.9 * (0.5 + 0.5 * 2 / 3), 4)), "Person:bob": ("Bob", round(0.5 + 0.5 / 3, 4))}
    strict, _ = Q.consensus(n, r, 3, strict=True)
    assert {x["key"] for x in strict.collect()} == {"Person:ann"}


def test_metrics_swap_precision_and_recall(spark):
    cols = "claim_id string, ordinal int, node_type string, name string"
    a = spark.createDataFrame([("c", 0, "P", "x"), ("c", 1, "P", "y"), ("c", 2, "P", "z")], cols)
    b = spark.createDataFrame([("c", 0, "P", "X"), ("c", 1, "P", "w")], cols)
    r = spark.createDataFrame([], "claim_id string, source_name string, relation_type string, target_name string")
    ab, ba = Q.extraction_metrics(a, r, b, r).first(), Q.extraction_metrics(b, r, a, r).first()
    assert ab["node_precision"] == pytest.approx(1 / 3) == ba["node_recall"]
    assert ab["node_recall"] == 0.5 == ba["node_precision"]
    assert ab["node_f1"] == pytest.approx(ba["node_f1"])


def test_bm25_best_hit_is_one_and_matches_the_formula(spark):
    import math

    docs = {"1": "the capital of france", "2": "the river of france and spain", "3": "nothing", "4": ""}
    kb = spark.createDataFrame(list(docs.items()), "id string, claim string")
    q = spark.createDataFrame([("q", "france capital"), ("none", "zebra")], "query_id string, text string")
    rows = {r["doc_id"]: r for r in search.bm25_search(q, kb, 5, 0.0).collect()}
    assert set(rows) == {"1", "2"} and rows["1"]["score"] == 1.0
    # "capital" brings its synonyms; only the word itself occurs.
    avgdl, dl = (4 + 6 + 1 + 0) / 4, 4
    idf = lambda df: math.log((4 - df + 0.5) / (df + 0.5) + 1)
    want = sum(idf(df) * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avgdl)) for df in (1, 2))
    assert rows["1"]["raw_score"] == pytest.approx(want, abs=1e-6)
