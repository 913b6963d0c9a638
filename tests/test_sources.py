"""File sources, payload parsing, reports and the source registry."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from claimspark import session
from claimspark.sources import extractions as X
from claimspark.sources import files as S
from claimspark.sources import payloads as P
from claimspark.sources import reports as R
from claimspark.sources import seeds


def raw(spark, *payloads, **columns):
    rows = [(i, p if isinstance(p, str) else json.dumps(p)) for i, p in enumerate(payloads)]
    df = spark.createDataFrame(rows, "ordinal long, payload string")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def test_text_csv_jsonl(spark, tmp_path):
    (tmp_path / "a.txt").write_text("line one\nline two\n", encoding="utf-8")
    row = S.read_text_claims(spark, str(tmp_path / "a.txt")).first()
    assert row["text"] == "line one\nline two\n" and row["source_id"].endswith("a.txt")

    (tmp_path / "c.csv").write_text('id,text\n1,"a ""quoted"", claim"\n2,"  "\n3,"two\nlines"\n', encoding="utf-8")
    got = {r["source_id"]: r["text"] for r in S.read_csv_claims(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"1": 'a "quoted", claim', "3": "two\nlines"}
    assert S.read_csv_claims(spark, str(tmp_path / "c.csv"), text_col="nope").count() == 0

    (tmp_path / "d.jsonl").write_text('{"id": 7, "text": "x"}\n"bare"\n12\n{"id": 1}\n\n{broken\n', encoding="utf-8")
    good, bad = S.read_jsonl_claims(spark, str(tmp_path / "d.jsonl"))
    assert sorted((r["source_id"] or "", r["text"]) for r in good.collect()) == [("", "12"), ("", "bare"), ("7", "x")]
    assert [r["line"] for r in bad.collect()] == ["{broken"]


def test_facts_last_row_wins(spark, tmp_path):
    path = str(tmp_path / "kb")
    first = spark.createDataFrame([("a", "old", True, "geographic", "2020-01-01")], "id string, claim string, is_true boolean, claim_type string, t string")
    second = spark.createDataFrame([("a", "new", False, "geographic", "2021-01-01"), ("b", "b", True, "quote", "2021-01-01")], first.schema)
    for df in (first, second):
        S.append_facts(df.withColumn("created_at", F.to_timestamp("t")).drop("t"), path)
    assert {(r["id"], r["claim"]) for r in S.read_facts(spark, path).collect()} == {("a", "new"), ("b", "b")}


def test_verification_documents(spark, tmp_path):
    doc = {"query": "q", "verified": True, "confidence": 0.65, "results": [
        {"source_name": "A", "source_type": "authority_file", "tier": "tier_1_authority", "found": True, "relevance_score": 0.5, "reliability_score": 0.95, "raw_data": {"k": [1]}},
        {"source_name": "B", "source_type": "fact_check", "tier": "tier_2_factcheck", "found": False, "relevance_score": 0.0, "reliability_score": 0.85, "error": "down"}]}
    (tmp_path / "v.json").write_text(json.dumps(doc, indent=2), encoding="utf-8")
    rows = S.verification_results(S.read_verifications(spark, str(tmp_path))).orderBy("ordinal").collect()
    assert [(r["source_name"], r["found"], r["error"]) for r in rows] == [("A", True, None), ("B", False, "down")]


def test_gnd_shapes(spark):
    df = raw(spark, {"gndIdentifier": "1", "preferredName": "A", "variantName": ["x", {"y": 1}, "z"], "dateOfBirth": ["1769-08"], "type": ["Person"]},
             {"preferredName": "no id"}, {"gndIdentifier": "2", "preferredNameForThePerson": "B", "dateOfBirth": "1800-13-01"}, "{bad",
             {"gndIdentifier": "3", "preferredName": "C", "professionOrOccupation": [{"label": "p"}, "q"], "biographicalOrHistoricalInformation": "b" * 300, "type": ["CorporateBody"]})
    rows = {r["authority_id"]: r for r in P.ingest_gnd(df).collect()}
    assert set(rows) == {"1", "2", "3"}
    assert rows["1"]["name_variants"] == ["x", "z"] and str(rows["1"]["birth_date"]) == "1769-08-01" and rows["1"]["description"] is None
    assert rows["2"]["name"] == "B" and rows["2"]["birth_date"] is None and rows["2"]["birth_raw"] == "1800-13-01"
    assert rows["3"]["description"] == "p | " + "b" * 300 and rows["3"]["entity_type"] == "Organization"
    assert [r["ordinal"] for r in P.quarantine(df).collect()] == [3]


def test_other_authority_shapes(spark):
    viaf = P.ingest_viaf(raw(spark, {"viafID": 5, "mainHeadings": {"data": {"text": "N"}}, "birthDate": "1769"}, {"viafID": 6, "mainHeadings": {"data": []}})).collect()
    assert [(r["authority_id"], r["name"], str(r["birth_date"])) for r in viaf] == [("5", "N", "1769-01-01")]
    skos = "http://www.w3.org/2004/02/skos/core#"
    loc = P.ingest_loc(raw(spark, [{"@id": "x"}, {"@type": ["t"], skos + "prefLabel": [{"@value": "L"}], skos + "altLabel": [{"@value": "a"}, 3]}], {"@id": "untyped"}, lccn="n1")).collect()
    assert [(r["authority_id"], r["name"], r["name_variants"]) for r in loc] == [("n1", "L", ["a"])]
    getty = P.ingest_getty(raw(spark, {"subject": {"value": "http://v/ulan/99"}, "prefLabel": {"value": "G"}, "start": {"value": "x"}}, entity_type="Location")).first()
    assert (getty["source"], getty["authority_id"], getty["birth_date"]) == ("getty_tgn", "99", None)


def test_records_to_nodes_and_urls(spark):
    df = P.ingest_gnd(raw(spark, {"gndIdentifier": "1", "preferredName": "A", "variantName": list("abcdefg"), "dateOfBirth": "1800"}, entity_type="Event"))
    node = P.records_to_nodes(P.source_url(df)).first()
    assert node["aliases"] == list("abcdefg") and str(node["start_date"]) == "1800-01-01" and node["birth_date"] is None and node["confidence"] == 1.0
    assert P.source_url(df).first()["source_url"] == "https://d-nb.info/gnd/1"


def test_registry_is_open(spark):
    P.register_source("mine", lambda r: P.ingest_gnd(r).withColumn("source", F.lit("mine")))
    assert "mine" in P.registered_sources()
    assert P.ingest("mine", raw(spark, {"gndIdentifier": "1", "preferredName": "A"})).first()["source"] == "mine"


def test_source_results_edge_cases(spark):
    base = spark.createDataFrame([("c", 0, "cat dog", "{}"), ("c", 1, "cat dog", "not json")], "claim_id string, ordinal int, query string, payload string")
    for source in P.SOURCE_NAMES:
        rows = P.ingest_source_results(base, source).orderBy("ordinal").collect()
        assert [r["found"] for r in rows] == [False, False] and rows[1]["error"] == "malformed payload" and rows[0]["title"] is None
    with pytest.raises(ValueError):
        P.ingest_source_results(base, "other")


@pytest.mark.parametrize("response, nodes, rels", [
    ('```json\n{"nodes": [{"name": "A", "node_type": "person"}], "relationships": []}\n```', 1, 0),
    ('I think {"entities": [{"name": "A", "node_type": "Event"},], "relations": [{"source_name": "A", "source_type": "Event", "relation_type": "CAUSED", "target_name": "B", "target_type": "Event"},]}', 1, 1),
    ('{nodes: [{name: "A", node_type: "Date", date_value: "1815-06-18"}]}', 1, 0), ("sorry", 0, 0)])
def test_extractions(spark, response, nodes, rels):
    df = spark.createDataFrame([("c", response, "t")], "claim_id string, response string, source_text string")
    n, r, rejects = X.ingest_extractions(df)
    assert (n.count(), r.count()) == (nodes, rels)
    assert rejects.count() == (1 if response == "sorry" else 0)


@pytest.mark.parametrize("response, names", [
    ('{"nodes": [{"name": "x, y: z", "node_type": "Event"},],} see {note}', ["x, y: z"]),
    ('Use {curly} first: {"nodes": [{"name": "A } b", "node_type": "Event"}]} done } x', ["A } b"]),
    ('{nodes: [{name: "He said \\"a, b: c\\"", node_type: "Event",},],}', ['He said "a, b: c"']),
    ('{"a": {"nodes": 1}} {"entities": [{"name": "E", "node_type": "event"}]}', ["E"]),
    ('A 6" gun {"nodes": [{"name": "G", "node_type": "Event"}]} and "more { text', ["G"]),
    ('{"nodes": [{"name": "see https://x.y, note: z,] }", "node_type": "Event"}], }', ["see https://x.y, note: z,] }"]),
    ('{"nodes": [{"name": "' + "x" * 200_000 + '\\"", "node_type": "Event"}]} tail }', None)])
def test_repair_knows_strings_and_depth(spark, response, names):
    df = spark.createDataFrame([("c", response, "t")], "claim_id string, response string, source_text string")
    n, _, rejects = X.ingest_extractions(df)
    assert rejects.count() == 0 or names is None
    if names:
        assert [r["name"] for r in n.collect()] == names
    else:  # parsed whole; only the name's length is refused
        assert X.parse_responses(df).selectExpr("length(try_variant_get(v, '$.nodes[0].name', 'string')) AS n").first()["n"] == 200_001


def test_repair_is_linear_in_hostile_answers(spark):
    rows = [(str(i), r, "t") for i, r in enumerate(["{" * 20_000, '{"' * 20_000, '"' * 20_001, "{" + '\\"' * 20_001 + "}", '{"' + "a " * 20_000 + "\\}", "{" * 9_000 + "}" * 9_000, "", None])]
    df = spark.createDataFrame(rows, "claim_id string, response string, source_text string")
    assert X.parse_responses(df).filter("v IS NOT NULL").count() == 0


def test_reports(spark):
    a = spark.createDataFrame([(1, "word " * 40, "false", "because", "short", None)], "analysis_id long, input_text string, overall_verdict string, verdict_explanation string, summary_for_users string, recommendation string")
    c = spark.createDataFrame([(1, 0, "x" * 70, "myth", 0.95, ["t1", "t2", "t3", "t4"], [])],
                              "analysis_id long, ordinal int, original_claim string, fact_status string, confidence_score double, what_is_true array<string>, what_is_false array<string>")
    s = spark.createDataFrame([(1, 0, None, "T", 1999, None)], "analysis_id long, ordinal int, author string, title string, year int, url string")
    def text(fmt):
        return [r["line"] for r in R.render_reports(a, c, s, fmt).orderBy("analysis_id", "section", "pos", "sub").collect()]
    plain = text("text")
    assert max(map(len, plain)) <= 75 and "BEWERTUNG: ✗ FALSCH" in plain and "     - t3" in plain and "     - t4" not in plain
    assert "   Konfidenz: 95%" in plain and "  - T (1999)" in plain
    assert "- *T* (1999)" in text("markdown") and "### 1. " + "x" * 70 in text("markdown")
    assert text("html")[-1] == "</div>"
    with pytest.raises(ValueError):
        R.render_reports(a, c, s, "pdf")
    card = [r["line"] for r in R.render_myth_cards(seeds.myths(spark)).filter("analysis_id = 'wall_from_moon'").orderBy("sub").collect()]
    assert "URSPRUNG:" in card and not any(line.startswith("  Zeit:") for line in card)


def test_written_reports_keep_their_order(spark, tmp_path):
    rows = [(a, 0, p, 0, f"{a}/{p}") for a in range(5) for p in range(20)]
    lines = spark.createDataFrame(rows, "analysis_id long, section int, pos long, sub int, line string")
    R.write_reports(lines, str(tmp_path / "r"), 3)
    read = [r["value"] for r in spark.read.text(str(tmp_path / "r"), wholetext=True).collect()]
    merged = [line for part in read for line in part.splitlines()]
    for a in range(5):
        assert [x for x in merged if x.startswith(f"{a}/")] == [f"{a}/{p}" for p in range(20)]


def test_checkpoint_folder_comes_from_the_session(spark):
    folder = session.ensure_checkpoint_dir(spark)
    assert session.ensure_checkpoint_dir(spark) == folder
    assert session.shared_scratch(spark, "x").startswith(folder)
    df = session.checkpoint(spark.range(5))
    assert df.count() == 5 and "Range" not in df._jdf.queryExecution().toString()


def test_bounded_reads(spark):
    assert session.bounded_rows(spark.range(5), 4) is None and len(session.bounded_rows(spark.range(5), 5)) == 5
    big = session.bounded_broadcast(spark.range(100), 10)
    assert "ResolvedHint" not in big._jdf.queryExecution().analyzed().toString()


def test_facts_with_clashing_ids_are_both_kept(spark, tmp_path):
    path = str(tmp_path / "kb")
    row = "id string, claim string, is_true boolean, claim_type string, entities array<string>, created_at timestamp"
    day = lambda n: dt.datetime(2020, 1, n)
    S.append_facts(spark.createDataFrame([("a", "old", True, "geographic", ["x", "y"], day(1)), ("a", "other", True, "geographic", ["u", "v"], day(1))], row), path)
    S.append_facts(spark.createDataFrame([("a", "new", True, "geographic", ["x", "y"], day(2))], row), path)
    assert sorted(r["claim"] for r in S.read_facts(spark, path).collect()) == ["new", "other"]


def test_pages_lie_in_few_folders(spark):
    """One file per page, but not one folder each, and not all written by one task."""
    import os
    import re

    from checks.registry import QUERIES

    files = QUERIES["s1_read_text_claims"](spark, "/root/testdata/sf0.01").inputFiles()
    assert len(files) == 250 and len({os.path.dirname(f) for f in files}) <= 64
    assert len({re.search(r"part-(\d+)", f).group(1) for f in files}) > 1


def test_page_files_are_written_without_checksum_files(spark, tmp_path):
    """A file per text, whole and with a line end; Spark's writer would start processes for each file and its checksum."""
    import os

    from checks.registry import QUERIES

    texts = ["a", "", None, "zwei\nZeilen ü", *map(str, range(100))]
    for path in (str(tmp_path / "plain"), f"file://{tmp_path}/uri"):
        S.write_text_claims(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3), path)
        got = S.read_text_claims(spark, path).collect()
        assert sorted(r["text"] for r in got) == sorted(f"{t or ''}\n" for t in texts)
        assert len({r["source_id"] for r in got}) == len(texts)
    S.write_text_claims(spark.createDataFrame([], "text string").repartition(3), str(tmp_path / "none"))
    assert S.read_text_claims(spark, str(tmp_path / "none")).count() == 0
    files = QUERIES["s1_read_text_claims"](spark, "/root/testdata/sf0.001").inputFiles()
    assert files and not any(name.endswith(".crc") for name in os.listdir(os.path.dirname(files[0].removeprefix("file://"))))
