"""Queries over claim graphs, evidence, runs, batches and the knowledge base."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks import inputs as I
from checks.registry import query
from checks.text_queries import r6
from claimspark import schema as S
from claimspark.functions.text import interpretation_graph
from claimspark.operators import batch as B
from claimspark.operators import chronology as C
from claimspark.operators import consensus as Q
from claimspark.operators import evidence as E
from claimspark.operators import features as feat
from claimspark.operators import graph as G
from claimspark.operators import kb as K
from claimspark.operators import resolve as R
from claimspark.plans import grow as W
from claimspark.plans import validate as V
from claimspark.session import checkpoint

TECH = {k: dt.date.fromisoformat(v) for k, v in I.TECH.items()}
ISSUE = ["claim_id", "issue_type", "severity", "message", "claim_entity", "claim_value", "fact_value"]


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---- projections and validation ----------------------------------------------------------------
@query("p1_nodes_by_type", "SELECT claim_id, name, description FROM cn WHERE node_type = 'Event'", ("cn",))
def p1(spark, d):
    return G.nodes_by_type(I.chron_nodes(spark, d), "Event").select("claim_id", "name", "description")


@query("p2_triples", "SELECT source_name, relation_type, target_name FROM cr", ("cr",))
def p2(spark, d):
    return G.triples(I.chron_rels(spark, d))


@query("p3_validate_nodes", """SELECT claim_id, ordinal, CASE WHEN bad_type AND bad_range THEN 'node_type,date_range' WHEN bad_type THEN 'node_type' WHEN bad_range THEN 'date_range'
    WHEN bad_conf THEN 'confidence' END AS reasons FROM (SELECT claim_id, ordinal, FALSE AS bad_type, node_type = 'Event' AND end_date < start_date - (CASE WHEN ordinal % 2 = 0 THEN 0 ELSE -20 END) AS bad_range, ordinal = 100 AS bad_conf FROM cn)
    WHERE coalesce(bad_range, FALSE) OR bad_conf""", ("cn",))
def p3(spark, d):
    n = I.chron_nodes(spark, d)
    n = n.withColumns({"start_date": F.when(F.col("ordinal") % 2 == 0, F.col("start_date")).otherwise(F.date_add("start_date", 20)),
                       "confidence": F.when(F.col("ordinal") == 100, 1.5).otherwise(0.5)})
    return S.validate_nodes(n)[1].select("claim_id", "ordinal", F.array_join("reject_reasons", ",").alias("reasons"))


@query("p4_validate_rels", "SELECT claim_id, ordinal, source_name, target_name FROM claim_rels WHERE ordinal <> 4", ("claim_rels",))
def p4(spark, d):
    r = I.claim_rels(spark, d).withColumn("relation_type", F.when(F.col("ordinal") == 4, "LIKES").otherwise(F.col("relation_type")))
    return S.validate_rels(r)[0].select("claim_id", "ordinal", "source_name", "target_name")


@query("p14_p15_node_properties", """SELECT claim_id, ordinal, 'source_label=Claim' || CASE WHEN description IS NOT NULL THEN ';description=' || description ELSE '' END || CASE WHEN birth_date IS NOT NULL THEN ';birth_date=' || birth_date ELSE '' END
    || CASE WHEN death_date IS NOT NULL THEN ';death_date=' || death_date ELSE '' END || CASE WHEN start_date IS NOT NULL THEN ';start_date=' || start_date ELSE '' END
    || CASE WHEN end_date IS NOT NULL THEN ';end_date=' || end_date ELSE '' END || CASE WHEN date_value IS NOT NULL THEN ';date_value=' || date_value ELSE '' END AS properties,
    node_type || ',Claim' AS labels FROM cn""", ("cn",))
def p14(spark, d):
    n = G.node_labels(G.with_node_properties(I.chron_nodes(spark, d).withColumn("source_label", F.lit("Claim"))))
    flat = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return n.select("claim_id", "ordinal", flat.alias("properties"), F.array_join("labels", ",").alias("labels"))


@query("p13_clear_claims", "SELECT 'nodes' AS part, count(*) AS n FROM place_nodes WHERE source_label <> 'Claim' UNION ALL SELECT 'edges', count(*) FROM place_edges WHERE source_label <> 'Claim'", ("place_nodes", "place_edges"))
def p13(spark, d):
    nodes, edges = G.clear_claims(I.place_nodes(spark, d), I.place_edges(spark, d))
    count = lambda df, p: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n")
    return count(nodes, "nodes").unionByName(count(edges, "edges"))


# ---- resolution --------------------------------------------------------------------------------
_NORM = r"regexp_replace(regexp_replace(trim(lower({})), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '\s+', ' ', 'g')"
_POOL = "pool AS (SELECT fact_id, ordinal, name, aliases, t AS node_type FROM facts, (SELECT unnest(['Organization', 'Location']) AS t) WHERE node_type IS NULL OR node_type = t)"
_NAMES = "names AS (SELECT DISTINCT node_type, name AS claim_name FROM claim_nodes)"
_CAND = """cand AS (SELECT n.node_type, n.claim_name, f.fact_id, f.ordinal FROM names n JOIN pool f ON f.node_type = n.node_type
    AND (f.name = n.claim_name OR list_contains(f.aliases, n.claim_name) OR contains(f.name, n.claim_name) OR contains(n.claim_name, f.name))),
    few AS (SELECT * FROM cand)"""


def _cascade(pairs: str, threshold: float) -> str:
    a, b = _NORM.format("p.claim_name"), _NORM.format("f.name")
    return f"""scored AS (SELECT node_type, claim_name, fact_id, ordinal, fact_name, CASE WHEN phon THEN 0.7 ELSE base END AS score, CASE WHEN phon THEN 'phonetic' ELSE method END AS method FROM (
      SELECT *, base < {threshold} AND base < 0.7 AND sound AS phon FROM (
      SELECT p.node_type, p.claim_name, p.fact_id, p.ordinal, f.name AS fact_name, FALSE AS sound,
        CASE WHEN {a} = {b} THEN 1 WHEN len(list_filter(f.aliases, lambda x: {_NORM.format('x')} = {a})) > 0 THEN 0.95 ELSE 1 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) END AS base,
        CASE WHEN {a} = {b} THEN 'exact' WHEN len(list_filter(f.aliases, lambda x: {_NORM.format('x')} = {a})) > 0 THEN 'alias' ELSE 'fuzzy' END AS method
      FROM {pairs} p JOIN pool f ON f.fact_id = p.fact_id AND f.node_type = p.node_type)) WHERE CASE WHEN phon THEN 0.7 ELSE base END >= {threshold}),
    matches AS (SELECT c.claim_id, c.ordinal AS claim_ordinal, c.name AS claim_name, s.fact_id, s.fact_name, s.score AS match_score, s.method AS match_method,
      row_number() OVER (PARTITION BY c.claim_id, c.ordinal ORDER BY s.score DESC, s.ordinal, s.fact_id) AS rank
      FROM claim_nodes c JOIN scored s ON s.node_type = c.node_type AND s.claim_name = c.name)"""


_REF = f"{_POOL},\n{_NAMES},\n{_CAND},\n{_cascade('few', 0.8)}"
_ALL = f"{_POOL},\n{_NAMES},\nevery AS (SELECT n.node_type, n.claim_name, f.fact_id, f.ordinal FROM names n JOIN pool f ON f.node_type = n.node_type),\n{_cascade('every', 0.8)}"


def _with(prefix: tuple[str, ...], ctes: str, body: str) -> str:
    return I.with_ctes(prefix, "").rstrip() + ",\n" + ctes + "\n" + body


@query("j1_fact_candidates", _with(("claim_nodes", "facts"), f"{_POOL},\n{_NAMES},\n{_CAND}", "SELECT node_type, claim_name, fact_id FROM few"))
def j1(spark, d):
    return R.fact_candidates(I.claim_nodes(spark, d), R.typed_facts(I.fact_nodes(spark, d)))


_MATCH_OUT = "SELECT claim_id, claim_ordinal, claim_name, fact_id, fact_name, round(match_score, 6) AS match_score, match_method, rank FROM matches"


def _matches(m):
    return m.select("claim_id", "claim_ordinal", "claim_name", "fact_id", "fact_name", r6(F.col("match_score"), "match_score"), "match_method", *big("rank"))


@query("j2_t2_resolve_contained", _with(("claim_nodes", "facts"), _REF, _MATCH_OUT))
def j2(spark, d):
    return _matches(R.resolve_entities(I.claim_nodes(spark, d), I.fact_nodes(spark, d), 0.8, "contained"))


@query("j2_resolve_all", _with(("claim_nodes", "facts"), _ALL, _MATCH_OUT))
def j2_all(spark, d):
    return _matches(R.resolve_entities(I.claim_nodes(spark, d), I.fact_nodes(spark, d), 0.8, "all"))


@query("j26_missing_entities", _with(("claim_nodes", "facts"), _REF, """SELECT c.claim_id, 'No matching fact found for ''' || c.name || ''' (' || c.node_type || ')' AS message, 'medium' AS severity FROM claim_nodes c
    WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.claim_id = c.claim_id AND m.claim_ordinal = c.ordinal)"""))
def j26(spark, d):
    n = I.claim_nodes(spark, d)
    return R.missing_entities(n, R.resolve_entities(n, I.fact_nodes(spark, d))).select("claim_id", "message", "severity")


_FIRST = "firsts AS (SELECT claim_id, claim_name, arg_min(fact_name, claim_ordinal * 1000 + rank) AS fact_name, arg_min(match_score, claim_ordinal * 1000 + rank) AS match_score FROM matches GROUP BY 1, 2)"
_RELV = f"""{_FIRST},
    known AS (SELECT source_name, relation_type, lower(target_name) AS target, count(*) AS n FROM fact_edges WHERE source_label = 'Fact' GROUP BY 1, 2, 3),
    relv AS (SELECT r.claim_id, r.ordinal, r.source_name, r.target_name, s.fact_name IS NOT NULL AND t.fact_name IS NOT NULL AS resolved, coalesce(k.n, 0) AS matching_facts,
      CASE WHEN k.n IS NOT NULL THEN 'verified' ELSE 'unverifiable' END AS status, CASE WHEN k.n IS NOT NULL THEN s.match_score * t.match_score ELSE 0.5 END AS confidence
      FROM claim_rels r LEFT JOIN firsts s ON s.claim_id = r.claim_id AND s.claim_name = r.source_name LEFT JOIN firsts t ON t.claim_id = r.claim_id AND t.claim_name = r.target_name
      LEFT JOIN known k ON k.source_name = s.fact_name AND k.relation_type = r.relation_type AND k.target = lower(t.fact_name))"""


@query("w5_first_matches", _with(("claim_nodes", "facts"), f"{_REF},\n{_FIRST}", "SELECT claim_id, claim_name, fact_name, round(match_score, 6) AS match_score FROM firsts"))
def w5(spark, d):
    m = R.resolve_entities(I.claim_nodes(spark, d), I.fact_nodes(spark, d))
    return R.first_matches(m).select("claim_id", "claim_name", "fact_name", r6(F.col("match_score"), "match_score"))


@query("j5_verify_relationships", _with(("claim_nodes", "facts", "claim_rels", "fact_edges"), f"{_REF},\n{_RELV}",
                                        "SELECT claim_id, ordinal, resolved, matching_facts, status, round(confidence, 6) AS confidence FROM relv"))
def j5(spark, d):
    # nodes and matches are stored first, as they are read several times
    n = checkpoint(I.claim_nodes(spark, d), "nodes")
    m = checkpoint(R.resolve_entities(n, I.fact_nodes(spark, d)), "matches")
    v = R.verify_relationships(I.claim_rels(spark, d, n), m, I.fact_edges(spark, d))
    return v.select("claim_id", "ordinal", "resolved", "matching_facts", "status", r6(F.col("confidence"), "confidence"))


# ---- chronology --------------------------------------------------------------------------------
@query("j6_check_lifespans", "SELECT * FROM lifespan", ("lifespan",))
def j6(spark, d):
    return C.check_lifespans(I.chron_nodes(spark, d), I.chron_rels(spark, d)).select(*ISSUE)


@query("w4_related_events", "SELECT claim_id, source_name, name, birth_date, death_date, event_date FROM rel_events", ("rel_events",))
def w4(spark, d):
    return C.related_events(I.chron_nodes(spark, d), I.chron_rels(spark, d)).select(
        "claim_id", "source_name", "name", "birth_date", "death_date", "event_date")


@query("j8_check_anachronisms", "SELECT * FROM anachronism", ("anachronism",))
def j8(spark, d):
    return C.check_anachronisms(I.chron_nodes(spark, d), TECH).select(*ISSUE)


@query("j7_compare_dates", """SELECT c.claim_id, c.name AS claim_entity, CASE WHEN days > 3650 THEN 'high' ELSE 'medium' END AS severity, round(greatest(0.5, 1 - days / 3650.0::DOUBLE), 6) AS confidence
    FROM (SELECT c.*, abs(date_diff('day', f.birth, c.birth_date)) AS days FROM cn c JOIN (SELECT 'customer ' || o_custkey AS key, arg_max(CAST(o_orderdate AS DATE), o_orderkey) AS birth FROM orders GROUP BY 1) f
    ON f.key = lower(c.name) WHERE c.node_type = 'Person' AND c.birth_date IS NOT NULL) c WHERE days > 365""", ("cn",))
def j7(spark, d):
    facts = I.table(spark, d, "orders").select(
        F.lit("Person").alias("node_type"), F.col("o_orderkey").alias("ordinal"), I.sf("CUSTOMER ", I.s("o_custkey")).alias("name"),
        F.to_date("o_orderdate").alias("birth_date"), *[F.lit(None).cast("date").alias(c) for c in ("death_date", "start_date", "end_date")])
    return C.compare_dates(I.chron_nodes(spark, d), facts).select("claim_id", "claim_entity", "severity", r6(F.col("confidence"), "confidence"))


@query("t1_timeline", """SELECT claim_id, date, name AS entity, CASE kind WHEN 'start' THEN 'Event Start' WHEN 'birth' THEN 'Birth' ELSE 'Death' END AS event FROM node_dates WHERE kind IN ('start', 'birth', 'death')""", ("node_dates",))
def t1(spark, d):
    return C.timeline(I.chron_nodes(spark, d)).select("claim_id", "date", "entity", "event")


def _chron(spark, d):
    """Nodes and relationships of the orders, stored first as the operators read them several times."""
    return checkpoint(I.chron_nodes(spark, d), "nodes"), checkpoint(I.chron_rels(spark, d), "rels")


@query("a3_chronology", """SELECT c.claim_id, coalesce(b.n, 0) = 0 AS is_consistent, s.lo AS earliest_date, s.hi AS latest_date FROM (SELECT DISTINCT claim_id FROM cn) c
    LEFT JOIN (SELECT claim_id, count(*) AS n FROM (SELECT claim_id FROM lifespan UNION ALL SELECT claim_id FROM anachronism) GROUP BY 1) b ON b.claim_id = c.claim_id
    LEFT JOIN (SELECT claim_id, min(date) AS lo, max(date) AS hi FROM node_dates GROUP BY 1) s ON s.claim_id = c.claim_id""", ("lifespan", "anachronism", "node_dates"))
def a3(spark, d):
    return C.chronology(*_chron(spark, d), TECH)


# ---- full validation ---------------------------------------------------------------------------
def _all_nodes(spark, d):
    n = I.claim_nodes(spark, d)
    dated = I.chron_nodes(spark, d)
    return checkpoint(dated, "nodes").unionByName(checkpoint(n.withColumn("ordinal", F.col("ordinal") + 200), "nodes"), allowMissingColumns=True)


def _all_rels(spark, d):
    cols = ["claim_id", "ordinal", "source_name", "relation_type", "target_name"]
    return checkpoint(I.chron_rels(spark, d).select(cols), "rels").unionByName(
        checkpoint(I.claim_rels(spark, d).select(cols).withColumn("ordinal", F.col("ordinal") + 200), "rels"))


def _validation(spark, d):
    """The derived claim graph is stored first, part by part, as the operators read its tables several times."""
    return V.validate_claims(I.order_claims(spark, d), _all_nodes(spark, d), _all_rels(spark, d), I.fact_nodes(spark, d), I.fact_edges(spark, d), TECH)


_ALL_CTES = {
    "claim_nodes": "SELECT claim_id, ordinal + 200 AS ordinal, name, node_type FROM claim_nodes0 UNION ALL SELECT claim_id, ordinal, name, node_type FROM cn",
    "claim_rels": "SELECT claim_id, ordinal + 200 AS ordinal, source_name, relation_type, target_name FROM claim_rels0 UNION ALL SELECT claim_id, ordinal, source_name, relation_type, target_name FROM cr",
}
_A28_BASE = I.with_ctes(("claim_nodes", "claim_rels", "facts", "fact_edges", "lifespan", "anachronism"), "").rstrip().replace(
    "claim_rels AS (SELECT a.claim_id, a.ordinal, a.name AS source_name, 'LOCATED_AT' AS relation_type, b.name AS target_name\n        FROM claim_nodes a JOIN claim_nodes b",
    "claim_rels0 AS (SELECT a.claim_id, a.ordinal, a.name AS source_name, 'LOCATED_AT' AS relation_type, b.name AS target_name\n        FROM claim_nodes0 a JOIN claim_nodes0 b").replace(
    "\nclaim_nodes AS (", "\nclaim_nodes0 AS (")
_A28_POOL = "pool AS (SELECT fact_id, ordinal, name, aliases, t AS node_type FROM facts, (SELECT unnest(['Person', 'Event', 'Location', 'Date', 'Organization']) AS t) WHERE node_type IS NULL OR node_type = t)"
_A28 = (_A28_BASE + ",\n" + ",\n".join(f"{k} AS ({v})" for k, v in _ALL_CTES.items()) + ",\n" + _REF.replace(_POOL, _A28_POOL) + ",\n" + _RELV + """,
    issues AS (SELECT claim_id, issue_type, severity FROM lifespan UNION ALL SELECT claim_id, issue_type, severity FROM anachronism
      UNION ALL SELECT c.claim_id, 'entity_not_found', 'medium' FROM claim_nodes c WHERE NOT EXISTS (SELECT 1 FROM matches m WHERE m.claim_id = c.claim_id AND m.claim_ordinal = c.ordinal)
      UNION ALL SELECT claim_id, 'entity_not_found', 'medium' FROM relv WHERE NOT resolved),
    status AS (SELECT o.claim_id, coalesce(crit, 0) AS crit, coalesce(high, 0) AS high, coalesce(med, 0) AS med, coalesce(chr, 0) AS chr, coalesce(nm, 0) AS nm, coalesce(strong, 0) AS strong, mean FROM
      (SELECT CAST(o_orderkey AS VARCHAR) AS claim_id FROM orders) o LEFT JOIN (SELECT claim_id, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'high') AS high,
        count(*) FILTER (severity = 'medium') AS med, count(*) FILTER (issue_type = 'chronological_impossibility') AS chr FROM issues GROUP BY 1) i ON i.claim_id = o.claim_id
      LEFT JOIN (SELECT claim_id, count(*) AS nm, count(*) FILTER (match_score > 0.9) AS strong, avg(match_score) AS mean FROM matches GROUP BY 1) m ON m.claim_id = o.claim_id)""")


@query("a28_validate_claims", _A28 + """ SELECT claim_id, CASE WHEN crit > 0 THEN 'contradicted' WHEN high > 0 THEN 'suspicious' WHEN med > 0 THEN 'partially_verified' WHEN nm > 0 THEN 'verified' ELSE 'unverifiable' END AS overall_status,
    round(CASE WHEN crit > 0 THEN 0.1 WHEN high > 0 THEN 0.3 WHEN med > 0 THEN 0.6 WHEN nm > 0 THEN least(1, mean) ELSE 0.5 END, 6)::DOUBLE AS overall_confidence,
    crit AS n_critical, high AS n_high, med AS n_medium, nm AS n_matches,
    CASE WHEN nm = 0 AND crit = 0 AND chr = 0 THEN 'No significant issues found' ELSE concat_ws('. ', CASE WHEN nm > 0 THEN strong || '/' || nm || ' entities verified with high confidence' END,
      CASE WHEN crit > 0 THEN crit || ' critical issues found' END, CASE WHEN chr > 0 THEN chr || ' chronological impossibilities detected' END) END AS summary FROM status""")
def a28(spark, d):
    v = _validation(spark, d).claims
    return v.select("claim_id", "overall_status", r6(F.col("overall_confidence"), "overall_confidence"), "n_critical", "n_high", "n_medium", "n_matches", "summary")


@query("a1_a2_status_of_chronology", """SELECT c.claim_id, CASE WHEN crit > 0 THEN 'contradicted' WHEN high > 0 THEN 'suspicious' ELSE 'unverifiable' END AS overall_status,
    CASE WHEN crit > 0 THEN 'The claim contains factual errors and should not be trusted.' WHEN high > 0 THEN 'The claim contains potential inaccuracies. Manual verification recommended.'
    ELSE 'Insufficient data to verify this claim. Additional sources needed.' END AS recommendation FROM (SELECT CAST(o_orderkey AS VARCHAR) AS claim_id FROM orders) c
    LEFT JOIN (SELECT claim_id, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'high') AS high FROM (SELECT claim_id, severity FROM lifespan UNION ALL SELECT claim_id, severity FROM anachronism) GROUP BY 1) i
    ON i.claim_id = c.claim_id""", ("lifespan", "anachronism"))
def a1(spark, d):
    issues = C.chronology_issues(*_chron(spark, d), TECH)
    none = I.order_claims(spark, d).select("claim_id", F.lit(0.0).alias("match_score")).limit(0)
    return V.validation_status(I.order_claims(spark, d), issues, none).select("claim_id", "overall_status", "recommendation")


@query("e2_custom_rules", "SELECT claim_id, 'future' AS issue_type, count(*) AS n FROM cn WHERE start_date > DATE '2001-01-01' GROUP BY 1", ("cn",))
def e2(spark, d):
    def late_events(nodes, rels):
        return R.issue_rows(nodes.filter(F.col("start_date") > "2001-01-01"), "future", "low", "late", F.col("name"))

    return V.run_rules(I.chron_nodes(spark, d), I.chron_rels(spark, d), [late_events]).groupBy("claim_id", "issue_type").agg(F.count(F.lit(1)).alias("n"))


# ---- features ----------------------------------------------------------------------------------
_FEAT = """feat AS (SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, n.*, coalesce(r.nr, 0) AS num_relationships, coalesce(r.nr, 0) / n.num_nodes::DOUBLE AS rels_per_node,
    contains(lower(o_orderpriority), 'might') AS vague, regexp_matches(o_orderpriority, '[0-9]') AS numbers FROM orders JOIN (SELECT claim_id AS cid, count(*) AS num_nodes,
    count(*) FILTER (node_type = 'Person') AS num_persons, count(*) FILTER (node_type = 'Event') AS num_events, count(*) FILTER (node_type = 'Date') AS num_dates,
    count(*) FILTER (birth_date IS NOT NULL OR death_date IS NOT NULL OR start_date IS NOT NULL OR end_date IS NOT NULL) / count(*)::DOUBLE AS with_dates,
    avg(length(coalesce(description, ''))) AS avg_desc, avg(length(name)) AS avg_name, date_diff('day', min(least(birth_date, death_date, start_date, end_date)), max(greatest(birth_date, death_date, start_date, end_date))) AS span,
    coalesce(max(greatest(birth_date, death_date, start_date, end_date)) > DATE '2001-09-01', FALSE) AS future FROM cn GROUP BY 1) n ON n.cid = CAST(o_orderkey AS VARCHAR)
    LEFT JOIN (SELECT claim_id, count(*) AS nr FROM cr GROUP BY 1) r ON r.claim_id = n.cid),
    scored AS (SELECT *, (least(1, num_nodes / 5.0::DOUBLE) + with_dates + least(1, rels_per_node) + least(1, avg_desc / 100)) / 4 AS completeness,
      least(1, 0.5::DOUBLE + CASE WHEN numbers THEN 0.2 ELSE 0 END + CASE WHEN vague THEN 0 ELSE 0.2 END + CASE WHEN num_dates > 0 THEN 0.1 ELSE 0 END) AS specificity FROM feat)"""


def _features(spark, d):
    claims = I.table(spark, d, "orders").select(I.s("o_orderkey").alias("claim_id"), F.col("o_orderpriority").alias("source_text"))
    return feat.graph_features(claims, I.chron_nodes(spark, d), I.chron_rels(spark, d), today="2001-09-01")


@query("a4_f16_graph_features", _with(("cn", "cr"), _FEAT, """SELECT claim_id, num_nodes, num_persons, num_events, num_dates, num_relationships, round(with_dates, 6) AS nodes_with_dates, round(rels_per_node, 6) AS relationships_per_node,
    round(avg_desc, 6) AS avg_description_length, round(avg_name, 6) AS avg_entity_name_length, span AS date_span_days, future AS dates_in_future, round(completeness, 6) AS completeness_score, round(specificity, 6) AS specificity_score FROM scored"""))
def a4(spark, d):
    f = _features(spark, d)
    return f.select("claim_id", "num_nodes", "num_persons", "num_events", "num_dates", "num_relationships",
                    *[r6(F.col(c), c) for c in ("nodes_with_dates", "relationships_per_node", "avg_description_length", "avg_entity_name_length")],
                    F.col("date_span_days").cast("bigint").alias("date_span_days"), "dates_in_future", r6(F.col("completeness_score"), "completeness_score"), r6(F.col("specificity_score"), "specificity_score"))


_ENRICH = """,
    enriched AS (SELECT s.*, coalesce(i.crit, 0) AS crit, coalesce(i.high, 0) AS high FROM scored s LEFT JOIN (SELECT claim_id, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'high') AS high
      FROM (SELECT claim_id, severity FROM lifespan UNION ALL SELECT claim_id, severity FROM anachronism) GROUP BY 1) i ON i.claim_id = s.claim_id),
    matched AS (SELECT e.*, coalesce(m.n, 0) / greatest(1, num_nodes)::DOUBLE AS rate, coalesce(m.mean, 0) AS mean FROM enriched e LEFT JOIN (SELECT claim_id, count(*) AS n, avg(ordinal / 10.0::DOUBLE) AS mean FROM cr WHERE ordinal <= 3 GROUP BY 1) m ON m.claim_id = e.claim_id),
    cons AS (SELECT *, least(1, greatest(0, CASE WHEN rate > 0 THEN (1 - crit * 0.3::DOUBLE - high * 0.15::DOUBLE - crit * 0.1::DOUBLE) * 0.5 + mean * 0.5 ELSE 1 - crit * 0.3::DOUBLE - high * 0.15::DOUBLE - crit * 0.1::DOUBLE END)) AS consistency FROM matched),
    ruled AS (SELECT *, least(1, greatest(0, 0.5::DOUBLE - least(0.4, crit * 0.2::DOUBLE) - least(0.2, high * 0.1::DOUBLE) + rate * 0.3 + completeness * 0.15 + specificity * 0.1 + (consistency - 0.5) * 0.2
      - CASE WHEN vague THEN 0.1 ELSE 0 END - CASE WHEN future THEN 0.3 ELSE 0 END)) AS rule FROM cons)"""


def _enriched(spark, d):
    nodes, rels = I.chron_nodes(spark, d), I.chron_rels(spark, d)
    matches = rels.filter(F.col("ordinal") <= 3).select("claim_id", (F.col("ordinal") / 10).alias("match_score"))
    return feat.enrich_features(_features(spark, d), matches, C.chronology_issues(nodes, rels, TECH))


@query("a5_f17_rule_scores", _with(("cn", "cr", "lifespan", "anachronism"), _FEAT + _ENRICH, """SELECT claim_id, crit AS num_critical_issues, high AS num_high_issues, round(rate, 6) AS entity_match_rate, round(mean, 6) AS avg_entity_match_score,
    round(consistency, 6) AS consistency_score, round(rule, 6) AS rule_score FROM ruled"""))
def a5(spark, d):
    e = _enriched(spark, d).withColumn("rule", feat.rule_score_graph())
    return e.select("claim_id", "num_critical_issues", "num_high_issues", r6(F.col("entity_match_rate"), "entity_match_rate"), r6(F.col("avg_entity_match_score"), "avg_entity_match_score"),
                    r6(F.col("consistency_score"), "consistency_score"), r6(F.col("rule"), "rule_score"))


@query("f20_interpretation_graph", _with(("cn", "cr", "lifespan", "anachronism"), _FEAT + _ENRICH, """SELECT claim_id, base || CASE WHEN details = '' THEN '' ELSE ' (' || details || ')' END AS sentence FROM (
    SELECT claim_id, CASE WHEN r >= 0.8 THEN 'High confidence: The claim appears well-supported' WHEN r >= 0.6 THEN 'Moderate confidence: Some aspects could be verified' WHEN r >= 0.4 THEN 'Low confidence: Significant uncertainties exist'
    ELSE 'Very low confidence: Multiple issues detected' END AS base, concat_ws(', ', CASE WHEN crit > 0 THEN crit || ' critical issues found' END, CASE WHEN rate > 0.7 THEN CAST(round(rate * 100) AS BIGINT) || '% of entities verified' END) AS details
    FROM (SELECT *, round(rule, 6) AS r FROM ruled))"""))
def f20(spark, d):
    e = _enriched(spark, d).withColumn("r", F.round(feat.rule_score_graph(), 6))
    return e.select("claim_id", interpretation_graph(F.col("r")).alias("sentence"))


@query("w11_top_factors_graph", _with(("cn", "cr", "lifespan", "anachronism"), _FEAT + _ENRICH, """SELECT claim_id, count(*) FILTER (factor IS NOT NULL) AS n, coalesce(string_agg(factor, ',' ORDER BY w DESC, pos), '') AS factors FROM (
    SELECT claim_id, CASE WHEN crit > 0 THEN 'critical_issues' END AS factor, 0.9::DOUBLE AS w, 0 AS pos FROM ruled UNION ALL SELECT claim_id, CASE WHEN rate > 0.5 THEN 'entity_match_rate' END, rate, 1 FROM ruled
    UNION ALL SELECT claim_id, CASE WHEN future THEN 'dates_in_future' END, 0.8, 2 FROM ruled UNION ALL SELECT claim_id, CASE WHEN completeness > 0.7 THEN 'completeness_score' END, completeness * 0.5, 3 FROM ruled) GROUP BY 1"""))
def w11g(spark, d):
    e = _enriched(spark, d).withColumn("t", feat.top_factors_graph())
    return e.select("claim_id", F.size("t").cast("bigint").alias("n"), F.array_join(F.transform("t", lambda x: x["factor"]), ",").alias("factors"))


# ---- graph -------------------------------------------------------------------------------------
def _incoming(spark, d):
    """Orders as incoming customer nodes: later orders overwrite the price, some carry a note."""
    o = I.table(spark, d, "orders").join(I.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return o.select(F.lit("Person").alias("node_type"), F.when(F.col("o_orderkey") % 3 == 0, "Fact").otherwise("Claim").alias("source_label"), F.col("c_name").alias("name"),
                    F.col("o_orderkey").alias("ordinal"), F.create_map(F.lit("last_order"), I.s("o_orderkey"), F.lit("note"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")), F.lit("key"), F.lit(None).cast("string")).alias("properties"))


_INC = """inc AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'Fact' ELSE 'Claim' END AS source_label, c_name AS name, CAST(max(o_orderkey) AS VARCHAR) AS last_order, arg_max(o_orderpriority, o_orderkey) FILTER (o_orderkey % 5 = 0) AS note
    FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2)"""


@query("g1_merge_nodes", _with(("place_nodes",), _INC, """SELECT coalesce(p.node_type, 'Person') AS node_type, coalesce(p.source_label, i.source_label) AS source_label, coalesce(p.name, i.name) AS name, p.tbl, i.last_order, i.note
    FROM place_nodes p FULL JOIN inc i ON p.node_type = 'Person' AND p.source_label = i.source_label AND p.name = i.name"""))
def g1(spark, d):
    m = G.merge_nodes(I.place_nodes(spark, d), _incoming(spark, d))
    p = F.col("properties")
    return m.select("node_type", "source_label", "name", p["table"].alias("tbl"), p["last_order"].alias("last_order"), p["note"].alias("note"))


def _incoming_edges(spark, d):
    li = I.table(spark, d, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", F.col("l_linenumber")).join(
        I.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")
    return li.select(F.lit("Organization").alias("source_type"), F.col("s_name").alias("source_name"), F.lit("AFFILIATED_WITH").alias("relation_type"), F.lit("Organization").alias("target_type"),
                     I.sf("Part ", I.s("l_partkey")).alias("target_name"), F.lit("Fact").alias("source_label"), F.col("l_orderkey").alias("ordinal"),
                     F.create_map(F.lit("order"), I.s("l_orderkey")).alias("properties"))


@query("g2_merge_edges", """SELECT 'edges' AS part, count(*) AS n, sum(CAST(o AS BIGINT))::BIGINT AS checksum FROM (SELECT l_suppkey, l_partkey, max(l_orderkey) AS o FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2
    UNION ALL SELECT s_suppkey, -1, 0 FROM supplier JOIN nation ON n_nationkey = s_nationkey UNION ALL SELECT c_custkey, -2, 0 FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT n_nationkey, -3, 0 FROM nation)
    UNION ALL SELECT 'nodes', (SELECT count(*) FROM place_nodes) + (SELECT count(DISTINCT l_partkey) FROM lineitem), 0""", ("place_nodes",))
def g2(spark, d):
    nodes, edges = G.merge_edges(I.place_nodes(spark, d), I.place_edges(spark, d), _incoming_edges(spark, d))
    e = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("properties")["order"].cast("bigint"), F.lit(0))).alias("checksum")).select(F.lit("edges").alias("part"), "n", "checksum")
    return e.unionByName(nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("part"), "n", F.lit(0).cast("bigint").alias("checksum")))


@query("g3_add_graph", """SELECT 'nodes_added' AS what, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT 'relationships_added', count(*) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
    UNION ALL SELECT 'claim_nodes', (SELECT count(DISTINCT o_custkey) FROM orders JOIN customer ON c_custkey = o_custkey) + (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders))
      + (SELECT count(DISTINCT l_suppkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey) + (SELECT count(DISTINCT l_partkey) FROM lineitem JOIN supplier ON s_suppkey = l_suppkey)""")
def g3(spark, d):
    nodes, _, counts = G.add_graph(I.place_nodes(spark, d), I.place_edges(spark, d), _incoming(spark, d), _incoming_edges(spark, d), "Claim")
    return counts.unionByName(nodes.filter(F.col("source_label") == "Claim").agg(F.count(F.lit(1)).alias("n")).select(F.lit("claim_nodes").alias("what"), "n"))


@query("j21_neighbors", """SELECT name, relation_type, other_name, direction FROM (SELECT source_name AS name, relation_type, target_name AS other_name, 'out' AS direction FROM place_edges
    UNION ALL SELECT target_name, relation_type, source_name, 'in' FROM place_edges) WHERE name IN (SELECT n_name FROM nation)""", ("place_edges",))
def j21(spark, d):
    names = I.table(spark, d, "nation").select(F.col("n_name").alias("name"))
    return G.neighbors(I.place_edges(spark, d), names, "both").select("name", "relation_type", "other_name", "direction")


@query("a12_graph_label_stats", """SELECT 'label' AS kind, label, count(*) AS n FROM (SELECT node_type AS label FROM place_nodes UNION ALL SELECT source_label FROM place_nodes) GROUP BY 2
    UNION ALL SELECT 'relationship', relation_type, count(*) FROM place_edges GROUP BY 2""", ("place_nodes", "place_edges"))
def a12(spark, d):
    return G.graph_label_stats(I.place_nodes(spark, d), I.place_edges(spark, d))


_MG = """rel AS (SELECT DISTINCT id AS source_key, unnest(related_myths) AS target_key FROM myths), deb AS (SELECT DISTINCT unnest(debunked_by) AS source_key, id AS target_key FROM myths),
    cit AS (SELECT DISTINCT id AS source_key, unnest(titles) AS target_key FROM myths), bel AS (SELECT DISTINCT e AS source_key, id AS target_key FROM (SELECT id, unnest(examples) AS e FROM narratives) WHERE e IN (SELECT id FROM myths)),
    mg_edges AS (SELECT 'RELATED_TO' AS edge_type, * FROM rel UNION ALL SELECT 'DEBUNKED', * FROM deb UNION ALL SELECT 'CITED_IN', * FROM cit UNION ALL SELECT 'BELONGS_TO', * FROM bel),
    mg_nodes AS (SELECT 'Myth' AS kind, id AS key, popularity FROM myths UNION ALL SELECT DISTINCT 'Myth', target_key, NULL FROM rel WHERE target_key NOT IN (SELECT id FROM myths)
      UNION ALL SELECT DISTINCT 'Person', source_key, NULL FROM deb UNION ALL SELECT DISTINCT 'Source', target_key, NULL FROM cit UNION ALL SELECT 'Narrative', id, NULL FROM narratives)"""


def _myth_graph(spark, d):
    return G.myth_graph(I.myths(spark, d), I.narratives(spark, d))


@query("g4_myth_graph", _with(("myths", "narratives"), _MG, "SELECT edge_type AS what, source_key AS a, target_key AS b FROM mg_edges UNION ALL SELECT kind, key, CAST(popularity AS VARCHAR) FROM mg_nodes"))
def g4(spark, d):
    nodes, edges = _myth_graph(spark, d)
    return edges.select(F.col("edge_type").alias("what"), F.col("source_key").alias("a"), F.col("target_key").alias("b")).unionByName(
        nodes.select(F.col("kind").alias("what"), F.col("key").alias("a"), I.s("popularity").alias("b")))


@query("a13_graph_totals", _with(("myths", "narratives"), _MG, """SELECT measure, n FROM (SELECT 'total_' || lower(kind) || 's' AS measure, count(*) AS n FROM mg_nodes GROUP BY 1 UNION ALL SELECT 'total_relationships', count(*) FROM mg_edges)"""))
def a13(spark, d):
    return G.graph_totals(*_myth_graph(spark, d))


@query("a14_category_distribution", "SELECT category, count(*) AS n FROM myths GROUP BY 1", ("myths",))
def a14(spark, d):
    return G.category_distribution(I.myths(spark, d))


@query("a15_most_debunked", _with(("myths", "narratives"), _MG, "SELECT target_key AS myth_id, m.claim, count(*) AS connections FROM deb JOIN myths m ON m.id = target_key GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20"))
def a15(spark, d):
    nodes, edges = _myth_graph(spark, d)
    return G.most_debunked(edges, nodes)


@query("j9_myths_by_narrative", _with(("myths", "narratives"), _MG, "SELECT b.target_key AS narrative_id, b.source_key AS myth_id, m.claim, m.popularity FROM bel b JOIN myths m ON m.id = b.source_key"))
def j9(spark, d):
    nodes, edges = _myth_graph(spark, d)
    return G.myths_by_narrative(edges, nodes, I.narratives(spark, d).select("id"))


@query("j10_myths_by_debunker", _with(("myths", "narratives"), _MG, "SELECT source_key AS debunker, target_key AS myth_id, m.claim, m.popularity FROM deb JOIN myths m ON m.id = target_key"))
def j10(spark, d):
    nodes, edges = _myth_graph(spark, d)
    return G.myths_by_debunker(edges, nodes, nodes.filter(F.col("kind") == "Person").select(F.col("key").alias("name")))


@query("g5_related", _with(("myths", "narratives"), _MG, """, sym AS (SELECT DISTINCT * FROM (SELECT source_key AS a, target_key AS b FROM rel UNION ALL SELECT target_key, source_key FROM rel) WHERE a <> b),
    hop AS (SELECT a, b, min(dist) AS dist FROM (SELECT a, b, 1 AS dist FROM sym UNION ALL SELECT x.a, y.b, 2 FROM sym x JOIN sym y ON x.b = y.a UNION ALL SELECT x.a, z.b, 3 FROM sym x JOIN sym y ON x.b = y.a JOIN sym z ON y.b = z.a) WHERE a <> b GROUP BY 1, 2)
    SELECT a AS id, b AS related_id, popularity, 3 AS distance, dist AS min_distance FROM (SELECT hop.*, n.popularity, row_number() OVER (PARTITION BY a ORDER BY n.popularity DESC NULLS FIRST, b) AS rn FROM hop JOIN mg_nodes n ON n.kind = 'Myth' AND n.key = b) WHERE rn <= 10""").replace(")\n, sym AS", "),\nsym AS"))
def g5(spark, d):
    nodes, edges = _myth_graph(spark, d)
    e = edges.filter(F.col("edge_type") == "RELATED_TO").select(F.col("source_key").alias("src"), F.col("target_key").alias("dst"))
    n = nodes.filter(F.col("kind") == "Myth").select(F.col("key").alias("id"), "popularity")
    return G.related(e, n, 3, 10).select("id", "related_id", "popularity", "distance", "min_distance")


def _class_edges(spark, d):
    n, r = I.table(spark, d, "nation"), I.table(spark, d, "region")
    up = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    segments = I.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        I.sf(F.col("n_name"), "/", F.col("c_mktsegment")).alias("child"), F.col("n_name").alias("parent")).distinct()
    return up.unionByName(segments)


@query("g7_instances_of", """WITH RECURSIVE sub AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT DISTINCT n_name || '/' || c_mktsegment, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
    classes AS (SELECT r_name AS root, r_name AS class FROM region UNION SELECT c.root, s.child FROM classes c JOIN sub s ON s.parent = c.class)
    SELECT DISTINCT c.root, x.c_name AS instance FROM classes c JOIN (SELECT c_name, n_name || '/' || c_mktsegment AS class FROM customer JOIN nation ON c_nationkey = n_nationkey) x ON x.class = c.class""")
def g7(spark, d):
    n = I.table(spark, d, "nation")
    inst = I.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("instance"), I.sf(F.col("n_name"), "/", F.col("c_mktsegment")).alias("class"))
    return G.instances_of(inst, _class_edges(spark, d), I.table(spark, d, "region").select(F.col("r_name").alias("root")))


# ---- evidence ----------------------------------------------------------------------------------
@query("a6_aggregate_sources", """SELECT claim_id, round(c, 3) AS confidence, c > 0.5 AS verified, checked AS sources_checked, found AS sources_found, tier AS highest_tier, rating AS fact_check_rating FROM (
    SELECT claim_id, checked, found, tier, rating, round(CASE WHEN found > 0 THEN least(1, wr / w + CASE tier WHEN 'tier_1_authority' THEN 0.15 WHEN 'tier_2_factcheck' THEN 0.10 WHEN 'tier_3_academic' THEN 0.05 ELSE 0 END) ELSE 0 END, 9) AS c FROM (
    SELECT claim_id, count(*) AS checked, count(*) FILTER (found) AS found, min(tier) FILTER (found) AS tier, sum(reliability) FILTER (found) AS w, sum(reliability * relevance) FILTER (found) AS wr,
    arg_min(rating, ordinal) FILTER (found AND source_type = 'fact_check' AND rating <> '') AS rating FROM results GROUP BY 1))""", ("results",))
def a6(spark, d):
    return E.aggregate_sources(I.source_results(spark, d)).select("claim_id", "confidence", "verified", "sources_checked", "sources_found", "highest_tier", "fact_check_rating")


@query("a7_merge_votes", """SELECT o.claim_id, CASE WHEN v.n IS NULL OR t + f = 0 THEN 'unverifiable' WHEN t > f THEN 'true' ELSE 'false' END AS verdict,
    round(CASE WHEN v.n IS NULL THEN 0 WHEN t + f = 0 THEN 0.3 ELSE least(0.95, greatest(t, f) / (t + f)) END, 6)::DOUBLE AS confidence,
    CASE WHEN v.n IS NULL THEN 'Keine Quelle konnte die Behauptung pruefen.' ELSE coalesce(expl, 'Basierend auf verfuegbaren Quellen.') END AS explanation,
    CASE WHEN v.n IS NOT NULL AND t + f > 0 AND t <= f THEN corr END AS correction, coalesce(typ, 'other') AS claim_type FROM (SELECT CAST(o_orderkey AS VARCHAR) AS claim_id FROM orders) o LEFT JOIN (
    SELECT claim_id, count(*) AS n, sum(CASE WHEN verdict = 'true' THEN confidence ELSE 0 END) AS t, sum(CASE WHEN verdict IN ('false', 'misleading') THEN confidence ELSE 0 END) AS f,
    arg_max(explanation, ordinal) FILTER (told) AS expl, arg_max(correction, ordinal) FILTER (told) AS corr, arg_max(claim_type, ordinal) FILTER (told AND claim_type <> 'rumour') AS typ
    FROM (SELECT *, explanation IS NOT NULL AND confidence > 0.5 AS told FROM votes) GROUP BY 1) v ON v.claim_id = o.claim_id""", ("votes",))
def a7(spark, d):
    m = E.merge_votes(I.order_claims(spark, d), E.weighted_votes(I.votes(spark, d)))
    return m.select("claim_id", "verdict", r6(F.col("confidence"), "confidence"), "explanation", "correction", "claim_type")


@query("a22_article_verdict", """SELECT o.claim_id AS article_id, coalesce(n, 0) AS n_claims, CASE WHEN bad THEN 'false' WHEN good THEN 'historically_accurate' ELSE 'unverifiable' END AS verdict
    FROM (SELECT CAST(o_orderkey AS VARCHAR) AS claim_id FROM orders) o LEFT JOIN (SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, count(*) AS n, bool_or(l_returnflag = 'R' AND l_linestatus = 'F') AS bad, bool_and(l_returnflag = 'A') AS good FROM lineitem GROUP BY 1) l ON l.claim_id = o.claim_id""")
def a22(spark, d):
    st = I.table(spark, d, "lineitem").select(I.s("l_orderkey").alias("article_id"), F.when(F.col("l_returnflag") == "A", "confirmed").when(
        (F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "myth").otherwise("disputed").alias("fact_status"))
    return E.article_verdict(I.order_claims(spark, d).withColumnRenamed("claim_id", "article_id"), st)


@query("a25_t5_evidence_context", """WITH ents AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ordinal) AS rn FROM (SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, l_linenumber AS ordinal, 'S' || min(l_suppkey) AS entity FROM lineitem GROUP BY l_orderkey, l_linenumber)),
    f AS (SELECT 'S' || l_suppkey AS entity, l_partkey AS p, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS rn FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)),
    lines AS (SELECT e.claim_id, e.ordinal, 0 AS pos, '[GND] ' || s_name AS line FROM ents e JOIN supplier ON 'S' || s_suppkey = e.entity WHERE e.rn <= 3 UNION ALL SELECT e.claim_id, e.ordinal, 1, '  - nation ' || s_nationkey FROM ents e JOIN supplier ON 'S' || s_suppkey = e.entity WHERE e.rn <= 3 AND s_suppkey % 2 = 0
      UNION ALL SELECT e.claim_id, e.ordinal, 10 + f.p, '[Wikidata] sells: ' || f.p FROM ents e JOIN f ON f.entity = e.entity AND f.rn <= 5 WHERE e.rn <= 3)
    SELECT claim_id, md5(string_agg(line, chr(10) ORDER BY ordinal, pos)) AS digest FROM lines GROUP BY 1""")
def a25(spark, d):
    li = I.lines(spark, d)
    ents = li.select(I.s("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ordinal"), I.sf("S", I.s("suppkey")).alias("entity"))
    s = I.table(spark, d, "supplier")
    records = s.select(I.sf("S", I.s("s_suppkey")).alias("entity"), F.lit(0).alias("ordinal"), F.col("s_name").alias("label"),
                       F.when(F.col("s_suppkey") % 2 == 0, I.sf("nation ", I.s("s_nationkey"))).alias("description"), F.lit(None).cast("date").alias("birth_date"), F.lit(None).cast("date").alias("death_date"))
    facts = I.table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct().select(
        I.sf("S", I.s("l_suppkey")).alias("entity"), F.col("l_partkey").alias("ordinal"), F.lit("sells").alias("claim"), I.s("l_partkey").alias("value"))
    return E.evidence_context(ents, records, facts).select("claim_id", F.md5("context").alias("digest"))


@query("j14_verify_person_facts", """SELECT o_orderkey AS claim_id, CASE WHEN o_custkey % 3 <> 0 THEN '+' || strftime(b, '%Y-%m-%d') || 'T00' WHEN o_custkey % 2 = 0 THEN strftime(b, '%Y-%m-%d') END AS actual,
    o_custkey % 3 <> 0 AND strftime(b, '%Y-%m-%d') = strftime(o_orderdate, '%Y-%m-%d') AS verified, CASE WHEN o_custkey % 3 <> 0 THEN 0.8 WHEN o_custkey % 2 = 0 THEN 0.9 ELSE 0 END::DOUBLE AS confidence
    FROM (SELECT *, min(o_orderdate) OVER (PARTITION BY o_custkey) AS b FROM orders)""")
def j14(spark, d):
    o = I.table(spark, d, "orders")
    born = o.groupBy("o_custkey").agg(F.to_date(F.min("o_orderdate")).alias("b"))
    claims = o.select(F.col("o_orderkey").alias("claim_id"), I.s("o_custkey").alias("person"), F.lit("birth_date").alias("claim_type"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("claimed_value"))
    facts = born.filter(F.col("o_custkey") % 3 != 0).select(I.s("o_custkey").alias("entity"), F.lit(0).alias("ordinal"), F.lit("Geburtsdatum").alias("property"),
                                                           I.sf("+", I.s("b"), "T00").alias("value"), F.lit(0.8).alias("confidence"), F.lit("WIKIDATA").alias("source"))
    records = born.filter(F.col("o_custkey") % 2 == 0).select(I.s("o_custkey").alias("name"), F.lit(0).alias("ordinal"), F.col("b").alias("birth_date"))
    return E.verify_person_facts(claims, facts, records).select("claim_id", "actual", "verified", "confidence")


@query("j15_verify_pattern_claims", """SELECT c_custkey AS claim_id, CASE WHEN c_custkey % 2 = 0 THEN 'country_continent' ELSE 'capital' END AS pattern, c_custkey % 5 <> 0 OR c_nationkey = 0 AS confirms,
    CASE WHEN c_custkey % 2 = 0 THEN n_name || ' liegt in R' || n_regionkey || '.' ELSE 'Die Hauptstadt von ' || n_name || ' ist C' || n_nationkey || '.' END AS explanation FROM (
    SELECT *, FALSE AS z FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE TRUE""".replace("c_custkey % 5 <> 0 OR c_nationkey = 0 AS confirms", "c_custkey % 5 <> 0 AS confirms"))
def j15(spark, d):
    n = I.table(spark, d, "nation")
    c = I.table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    region = F.when(k % 5 == 0, "Nirgendwo").otherwise(I.sf("r", I.s("n_regionkey")))
    capital = F.when(k % 5 == 0, "Nirgendwo").otherwise(I.sf("c", I.s("n_nationkey")))
    text = F.when(k % 2 == 0, I.sf("Also ", F.col("n_name"), " liegt in ", region, " heute")).otherwise(I.sf("Die Hauptstadt von ", F.col("n_name"), " ist ", capital, "."))
    claims = c.select(k.alias("claim_id"), text.alias("text"))
    geo = n.select(F.lit("country_continent").alias("pattern"), F.col("n_name").alias("subject"), I.sf("R", I.s("n_regionkey")).alias("actual")).unionByName(
        n.select(F.lit("capital").alias("pattern"), F.col("n_name").alias("subject"), I.sf("C", I.s("n_nationkey")).alias("actual")))
    return E.verify_pattern_claims(claims, geo).select("claim_id", "pattern", "confirms", "explanation")


@query("j23_first_summary", r"""SELECT doc_id AS claim_id, arg_min(w, pos) AS title, 'about ' || arg_min(w, pos) AS summary FROM (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT doc_id, string_split_regex(text, '\s+') AS ws FROM docs))
    WHERE length(w) > 3 AND regexp_matches(w, '^\p{Lu}') AND length(w) % 2 = 0 GROUP BY 1""", ("docs",))
def j23(spark, d):
    claims = I.docs(spark, d).withColumnRenamed("doc_id", "claim_id")
    words = claims.select(F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("title")).filter(F.length("title") % 2 == 0).distinct()
    return E.first_summary(claims, words.withColumn("summary", I.sf("about ", F.col("title"))))


@query("j24_search_entities", """SELECT query_id, entity_id, rank FROM (SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY entity_id) AS rank FROM (
    SELECT DISTINCT b.p_brand || '/' || w AS query_id, 'm' || p.p_partkey AS entity_id FROM (SELECT DISTINCT p_brand, split_part(p_name, ' ', 2) AS w FROM part) b JOIN part p ON contains(lower(p.p_name || ' ' || p.p_brand), lower(w || ' ' || b.p_brand)) AND p.p_type IN ('PROMO', 'SMALL'))) WHERE rank <= 10""")
def j24(spark, d):
    p = I.table(spark, d, "part")
    word = F.element_at(F.split("p_name", " "), 2)
    queries = p.select(I.sf(F.col("p_brand"), "/", word).alias("query_id"), F.upper(I.sf(word, " ", F.col("p_brand"))).alias("name")).distinct()
    ents = p.select(I.sf("m", I.s("p_partkey")).alias("entity_id"), F.col("p_type").alias("entity_type"))
    labels = p.select(I.sf("m", I.s("p_partkey")).alias("entity_id"), I.sf(F.col("p_name"), " ", F.col("p_brand")).alias("label"), F.lit("en").alias("lang"))
    return E.search_entities(queries, ents, labels, ["PROMO", "SMALL"]).select("query_id", "entity_id", *big("rank"))


CLASSES = {"instance_of": "P31", "country": "Q6256", "human": "Q5", "continent": "P30", "capital": "P36", "sitelinks": "links", "birth": "P569", "death": "P570"}


def _statements(spark, d):
    """Nations as countries, their largest-key supplier as capital, customers as persons with order dates as life."""
    n, r = I.table(spark, d, "nation"), I.table(spark, d, "region")
    st = lambda df, s, p, v: df.select(s.alias("subject"), F.lit(p).alias("property"), v.alias("value"))
    N, C_ = I.sf("N", I.s("n_nationkey")), I.sf("C", I.s("c_custkey"))
    cap = I.table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_suppkey").alias("m"))
    life = I.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.to_date(F.min("o_orderdate")).alias("b"), F.to_date(F.max("o_orderdate")).alias("e"))
    cust = I.table(spark, d, "customer")
    statements = (
        st(n, N, "P31", F.lit("Q6256")).unionByName(st(n, N, "P30", I.sf("R", I.s("n_regionkey")))).unionByName(st(cap, N, "P36", I.sf("S", I.s("m"))))
        .unionByName(st(cust, C_, "P31", F.lit("Q5"))).unionByName(st(cust, C_, "links", (F.col("c_custkey") % 100).cast("string")))
        .unionByName(st(life, C_, "P569", I.s("b"))).unionByName(st(life.filter(F.col("c_custkey") % 4 != 0), C_, "P570", I.s("e"))))
    lab = lambda df, i, t: df.select(i.alias("entity_id"), t.alias("label"))
    labels = (lab(n, N, F.when(F.col("n_nationkey") == 3, "Q77").otherwise(F.col("n_name"))).unionByName(lab(r, I.sf("R", I.s("r_regionkey")), F.col("r_name")))
              .unionByName(lab(I.table(spark, d, "supplier"), I.sf("S", I.s("s_suppkey")), F.col("s_name"))).unionByName(lab(cust, C_, F.col("c_name"))))
    return statements, labels


_MINED = """nat AS (SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'Q77' ELSE n_name END AS n, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
    life AS (SELECT c_custkey, c_name, CAST(year(min(o_orderdate)) AS VARCHAR) AS b, CASE WHEN c_custkey % 4 <> 0 THEN CAST(year(max(o_orderdate)) AS VARCHAR) END AS e FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_custkey % 100 > 50 GROUP BY 1, 2),
    mined AS (SELECT 'geo_' || left(md5(n || '_' || r_name), 8) AS id, n || ' liegt in ' || r_name AS claim, 'geographic' AS claim_type FROM nat WHERE n <> 'Q77'
      UNION ALL SELECT 'cap_' || left(md5(n || '_' || s_name), 8), 'Die Hauptstadt von ' || n || ' ist ' || s_name, 'geographic' FROM nat JOIN (SELECT s_nationkey, arg_max(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey WHERE n <> 'Q77'
      UNION ALL SELECT 'bio_' || left(md5(c_name || '_' || b), 8), c_name || ' wurde ' || b || ' geboren', 'biographical' FROM life
      UNION ALL SELECT 'bio_' || left(md5(c_name || '_death_' || e), 8), c_name || ' starb ' || e, 'biographical' FROM life WHERE e <> b)"""


@query("j25_f29_p11_mine_facts", "WITH " + _MINED + " SELECT id, claim, claim_type FROM mined")
def j25(spark, d):
    return W.mine_facts(*_statements(spark, d), CLASSES).select("id", "claim", "claim_type")


@query("a19_growth_stats", "WITH " + _MINED + """ SELECT kind, count(*) AS n FROM (SELECT CASE WHEN claim_type = 'biographical' THEN 'biographical' WHEN contains(claim, 'Hauptstadt') THEN 'capitals' ELSE 'geographic' END AS kind FROM mined) GROUP BY 1""")
def a19(spark, d):
    return K.growth_stats(W.mine_facts(*_statements(spark, d), CLASSES))


@query("w1_merge_by_priority", """SELECT name, source, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(name)) ORDER BY CASE source WHEN 'gnd' THEN 1 WHEN 'loc' THEN 2 WHEN 'viaf' THEN 3 WHEN 'getty_tgn' THEN 4 ELSE 10 END, ordinal) AS rn FROM (
    SELECT CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name || ' ' END AS name, (['viaf', 'gnd', 'loc', 'getty_tgn', 'getty_aat'])[l_suppkey % 5 + 1] AS source, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS ordinal FROM lineitem JOIN part ON p_partkey = l_partkey)) WHERE rn = 1""")
def w1(spark, d):
    li = I.table(spark, d, "lineitem").join(I.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    rec = li.select(F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(I.sf(F.col("p_name"), " ")).alias("name"),
                    F.element_at(F.array(*map(F.lit, ["viaf", "gnd", "loc", "getty_tgn", "getty_aat"])), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("source"),
                    (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return R.merge_by_priority(rec)


@query("w2_merge_extractions", """SELECT node_type, name, description, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY node_type, lower(name) ORDER BY CASE WHEN coalesce(description, '') = '' THEN 1 ELSE 0 END, ordinal) AS rn FROM (
    SELECT 'Event' AS node_type, CASE WHEN l_linenumber % 2 = 0 THEN upper(p_name) ELSE p_name END AS name, CASE WHEN l_suppkey % 5 = 0 THEN 'by ' || l_suppkey END AS description, l_orderkey * 100000 + l_partkey * 10 + l_linenumber AS ordinal FROM lineitem JOIN part ON p_partkey = l_partkey)) WHERE rn = 1""")
def w2(spark, d):
    li = I.table(spark, d, "lineitem").join(I.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_name"), "l_partkey")
    n = li.select(F.lit("Event").alias("node_type"), F.when(F.col("l_linenumber") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name")).alias("name"),
                  F.when(F.col("l_suppkey") % 5 == 0, I.sf("by ", I.s("l_suppkey"))).alias("description"), (F.col("l_orderkey") * 100000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("ordinal"))
    return R.merge_extractions(n)


@query("u1_union_sources", """SELECT source, count(*) AS n FROM (SELECT 'gnd' AS source FROM customer WHERE c_custkey % 9 <> 0 UNION ALL SELECT 'viaf' FROM supplier) GROUP BY 1""")
def u1(spark, d):
    a = I.table(spark, d, "customer").select(F.lit("gnd").alias("source"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 9 == 0, "timeout").alias("error"))
    b = I.table(spark, d, "supplier").select(F.lit("viaf").alias("source"), F.col("s_name").alias("name"))
    c = I.table(spark, d, "part").select(F.lit("loc").alias("source"), F.col("p_name").alias("name"))
    return R.union_sources(a, b, c, sources=["gnd", "viaf"]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---- consensus ---------------------------------------------------------------------------------
@query("a8_consensus", """SELECT claim_id, key, n_seen, round(best * (0.5 + 0.5 * n_seen / 12.0), 6)::DOUBLE AS confidence, 'node' AS what FROM (SELECT claim_id, node_type || ':' || lower(name) AS key, count(*) AS n_seen, max(confidence) AS best FROM run_nodes GROUP BY 1, 2) WHERE n_seen >= 4
    UNION ALL SELECT claim_id, key, n_seen, round(best, 6), 'rel' FROM (SELECT claim_id, lower(source_name) || ':CAUSED:' || lower(target_name) AS key, count(*) AS n_seen, max(confidence) AS best FROM run_rels GROUP BY 1, 2) WHERE n_seen >= 4""", ("run_nodes", "run_rels"))
def a8(spark, d):
    n, r = Q.consensus(I.run_nodes(spark, d), I.run_rels(spark, d), 12, 0.4)
    out = lambda df, w: df.select("claim_id", "key", "n_seen", r6(F.col("confidence"), "confidence"), F.lit(w).alias("what"))
    return out(n, "node").unionByName(out(r, "rel"))


def _rates_sql(src: str, key: str, prefix: str) -> str:
    return f"""{prefix}k AS (SELECT claim_id, key, max(p) AS p, max(t) AS t FROM (SELECT claim_id || '/' || run_id AS claim_id, {key} AS key, 1 AS p, 0 AS t FROM {src}
      UNION ALL SELECT claim_id || '/' || ((run_id + 2) % 3), {key}, 0, 1 FROM {src}) GROUP BY 1, 2),
    {prefix}c AS (SELECT claim_id, sum(p * t) AS tp, sum(p * (1 - t)) AS fp, sum((1 - p) * t) AS fn FROM {prefix}k GROUP BY 1),
    {prefix} AS (SELECT claim_id, pr, re, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1, CASE WHEN tp + fp > 0 THEN fp / (tp + fp)::DOUBLE ELSE 0 END AS h FROM (
      SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS pr, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS re FROM {prefix}c))"""


def _run_pairs(df):
    """Both sides of every run against the next one, the last against the first: claim ids become ``claim/run``."""
    mark = lambda run: df.withColumn("claim_id", I.sf(F.col("claim_id"), "/", run.cast("string")))
    return mark(F.col("run_id")), mark((F.col("run_id") + 2) % 3)


_NK, _RK = "node_type || ':' || lower(name)", "lower(source_name) || ':' || relation_type || ':' || lower(target_name)"


@query("a9_extraction_metrics", _with(("run_nodes", "run_rels"), _rates_sql("run_nodes", _NK, "nn") + ",\n" + _rates_sql("run_rels", _RK, "rr"), """SELECT n.claim_id, round(n.pr, 6) AS node_precision, round(n.re, 6) AS node_recall, round(n.f1, 6) AS node_f1, round(n.h, 6) AS hallucination_rate,
    round(r.pr, 6) AS relationship_precision, round(r.re, 6) AS relationship_recall, round(r.f1, 6) AS relationship_f1, round((n.f1 + r.f1) / 2, 6) AS overall_f1 FROM nn n JOIN rr r ON r.claim_id = n.claim_id"""))
def a9(spark, d):
    (pn, tn), (pr, tr) = _run_pairs(I.run_nodes(spark, d)), _run_pairs(I.run_rels(spark, d))
    m = Q.extraction_metrics(pn, pr, tn, tr)
    return m.select("claim_id", *[r6(F.col(c), c) for c in m.columns if c != "claim_id"])


@query("u2_key_sets", _with(("run_nodes", "run_rels"), _rates_sql("run_nodes", _NK, "nn"), "SELECT claim_id, key, CASE WHEN p * t = 1 THEN 'tp' WHEN p = 1 THEN 'fp' ELSE 'fn' END AS side FROM nnk"))
def u2(spark, d):
    return Q.key_sets(*_run_pairs(I.run_nodes(spark, d)), Q.node_key())


@query("j20_diff_extractions", _with(("run_nodes",), "f AS (SELECT claim_id, run_id, " + _NK + " AS key, arg_min(grade, ordinal) AS grade, arg_min(name, ordinal) AS name FROM run_nodes GROUP BY 1, 2, 3)", """SELECT coalesce(a.claim_id, b.claim_id) AS claim_id, coalesce(a.key, b.key) AS key,
    CASE WHEN b.key IS NULL THEN 'only_left' WHEN a.key IS NULL THEN 'only_right' WHEN a.grade <> b.grade OR a.name <> b.name THEN 'conflict' ELSE 'agreement' END AS outcome,
    CASE WHEN a.key IS NOT NULL AND b.key IS NOT NULL THEN concat_ws(',', CASE WHEN a.grade <> b.grade THEN 'grade' END, CASE WHEN a.name <> b.name THEN 'name' END) ELSE '' END AS differing
    FROM (SELECT * REPLACE (claim_id || '/' || run_id AS claim_id) FROM f) a FULL JOIN (SELECT * REPLACE (claim_id || '/' || ((run_id + 2) % 3) AS claim_id) FROM f) b ON a.claim_id = b.claim_id AND a.key = b.key"""))
def j20(spark, d):
    x = Q.diff_extractions(*_run_pairs(I.run_nodes(spark, d)), ["grade", "name"])
    return x.select("claim_id", "key", "outcome", F.array_join("differing", ",").alias("differing"))


# ---- batches -----------------------------------------------------------------------------------
@query("w3_mark_duplicates", "SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY left(sha256(text), 16) ORDER BY doc_id) = 1 THEN 'queued' ELSE 'skipped' END AS status FROM documents")
def w3(spark, d):
    return B.mark_duplicates(I.table(spark, d, "documents"), "text", "doc_id").select("doc_id", "status")


@query("a16_batch_progress", """SELECT job_id, total_items, processed_items, failed_items, skipped_items, round(processed_items / total_items::DOUBLE * 100, 6) AS progress_percent, round(processed_items / (el / 60), 6) AS rate, round((total_items - processed_items) / (processed_items / el), 4) AS remaining FROM (
    SELECT job_id, count(*) AS total_items, count(*) FILTER (status IN ('success', 'failed', 'skipped')) AS processed_items, count(*) FILTER (status = 'failed') AS failed_items, count(*) FILTER (status = 'skipped') AS skipped_items,
    epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(min(ts)) AS el FROM items GROUP BY 1) WHERE processed_items > 0""", ("items",))
def a16(spark, d):
    items = I.batch_items(spark, d)
    jobs = items.groupBy("job_id").agg(F.min("ts").alias("started_at"))
    p = B.batch_progress(items, jobs, dt.datetime(2024, 2, 1))
    return p.filter("processed_items > 0").select("job_id", "total_items", "processed_items", "failed_items", "skipped_items", r6(F.col("progress_percent"), "progress_percent"),
                                                 r6(F.col("current_rate_per_minute"), "rate"), F.round("estimated_remaining_seconds", 4).alias("remaining"))


@query("a17_batch_result", """SELECT job_id, sum(n_nodes)::BIGINT AS total_nodes, sum(n_rels)::BIGINT AS total_relationships, round(sum(ms), 4) AS total_ms, count(*) FILTER (status = 'failed') AS failed_items, CAST(NULL AS BIGINT) AS item_id FROM items GROUP BY 1
    UNION ALL SELECT job_id, NULL, NULL, NULL, NULL, item_id FROM items WHERE status = 'failed'""", ("items",))
def a17(spark, d):
    totals, failed = B.batch_result(I.batch_items(spark, d))
    t = totals.select("job_id", "total_nodes", "total_relationships", F.round("total_ms", 4).alias("total_ms"), "failed_items")
    return t.unionByName(failed.select("job_id", "item_id"), allowMissingColumns=True)


@query("a23_import_stats", "SELECT sum(n_nodes) FILTER (status = 'success')::BIGINT AS total_nodes_imported, sum(n_rels) FILTER (status = 'success')::BIGINT AS total_relationships_imported, count(DISTINCT job_id) AS queries_processed FROM items", ("items",))
def a23(spark, d):
    i = I.batch_items(spark, d)
    return B.import_stats(i.select(F.col("job_id").alias("query"), (F.col("status") == "success").alias("success"), F.col("n_nodes").alias("nodes"), F.col("n_rels").alias("relationships")))


@query("w6_rolling_rate", """SELECT event_id, count(*) OVER w AS requests_in_window, count(*) OVER w > 3 AS over_limit FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 7199999999 PRECEDING AND CURRENT ROW)""")
def w6(spark, d):
    r = B.rolling_rate(I.table(spark, d, "events"), "user_id", "ts", seconds=7200, limit=3, bucket_seconds=86400)
    return r.select("event_id", "requests_in_window", "over_limit")


_REUSE = """WITH RECURSIVE req AS (SELECT md5(lower(trim('User ' || (user_id % 40)))) AS k, epoch_us(ts) AS us, event_id FROM events), times AS (SELECT k, us, min(event_id) AS first_id FROM req GROUP BY 1, 2),
    anchors AS (SELECT k, min(us) AS us FROM times GROUP BY 1 UNION ALL SELECT a.k, (SELECT min(t.us) FROM times t WHERE t.k = a.k AND t.us >= a.us + 86400000000) AS us FROM anchors a WHERE (SELECT min(t.us) FROM times t WHERE t.k = a.k AND t.us >= a.us + 86400000000) IS NOT NULL),
    miss AS (SELECT first_id FROM times JOIN anchors USING (k, us))"""


def _requests(spark, d):
    key = F.when(F.col("event_id") % 2 == 0, I.sf(" USER ", (F.col("user_id") % 40).cast("string"))).otherwise(I.sf("User ", (F.col("user_id") % 40).cast("string"), " "))
    return I.table(spark, d, "events").select(F.col("event_id").alias("request_id"), "ts", key.alias("key"))


@query("x5_reuse_flags", _REUSE + " SELECT event_id AS request_id, event_id NOT IN (SELECT first_id FROM miss) AS hit FROM events")
def x5(spark, d):
    return B.reuse_flags(_requests(spark, d)).select("request_id", "hit")


@query("x5_reuse_flags_hot_keys", _REUSE + " SELECT event_id AS request_id, event_id NOT IN (SELECT first_id FROM miss) AS hit FROM events")
def x5_hot(spark, d):
    return B.reuse_flags(_requests(spark, d), hot_rows=20).select("request_id", "hit")


@query("a24_reuse_stats", _REUSE + " SELECT (SELECT count(*) FROM events) - (SELECT count(*) FROM miss) AS hits, (SELECT count(*) FROM miss) AS misses, round(100 - 100.0::DOUBLE * (SELECT count(*) FROM miss) / (SELECT count(*) FROM events), 6) AS hit_rate")
def a24(spark, d):
    return B.reuse_stats(B.reuse_flags(_requests(spark, d))).select("hits", "misses", r6(F.col("hit_rate"), "hit_rate"))


# ---- knowledge base ----------------------------------------------------------------------------
@query("a10_fact_stats", """SELECT 'source' AS dimension, source AS value, count(*) AS n FROM kb GROUP BY 2 UNION ALL SELECT 'claim_type', claim_type, count(*) FROM kb GROUP BY 2
    UNION ALL SELECT 'verdict', CASE WHEN is_true THEN 'true' ELSE 'false' END, count(*) FROM kb GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM kb""", ("kb",))
def a10(spark, d):
    return K.fact_stats(I.kb_facts(spark, d))


_SEEDS = """used AS (SELECT DISTINCT unnest(entities) AS e FROM kb WHERE source = 'generated'), seeds AS (SELECT * FROM kb WHERE is_true AND claim_type = 'geographic' AND id NOT IN (SELECT id FROM (SELECT id, unnest(entities) AS e FROM kb) WHERE e IN (SELECT e FROM used)))"""


def _swap_sql() -> str:
    return "CASE b " + " ".join(f"WHEN '{k}' THEN {I.sql_list(v)}" for k, v in I.REGION_SWAPS.items()) + " END"


_NEG = f"""pick AS (SELECT id, a, b, alt, alt[(('0x' || left(md5(id), 8))::BIGINT % len(alt)) + 1] AS wrong FROM (SELECT id, entities[1] AS a, entities[2] AS b, {_swap_sql().replace('CASE b', 'CASE entities[2]')} AS alt FROM seeds) WHERE alt IS NOT NULL)"""


@query("j12_negative_seeds", _with(("kb",), _SEEDS, "SELECT id, claim FROM seeds"))
def j12(spark, d):
    return K.negative_seeds(I.kb_facts(spark, d)).select("id", "claim")


@query("f31_negatives", _with(("kb",), f"{_SEEDS},\n{_NEG}", "SELECT 'adv_' || left(md5(a || '_' || wrong), 8) AS id, a || ' liegt in ' || wrong AS claim, 'Falsch. ' || a || ' liegt in ' || b || ', nicht in ' || wrong || '.' AS explanation, FALSE AS is_true FROM pick"))
def f31(spark, d):
    return K.negatives(K.negative_seeds(I.kb_facts(spark, d), None), I.REGION_SWAPS).select("id", "claim", "explanation", "is_true")


@query("j11_new_facts", """SELECT id, claim FROM (SELECT 'geo_' || left(md5(a || '_' || b), 8) AS id, a || ' liegt in ' || b AS claim FROM (SELECT s_name AS a, r_name AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT a, b FROM kb_pairs)) c WHERE NOT EXISTS (SELECT 1 FROM kb WHERE kb.id = c.id AND kb.claim = c.claim) GROUP BY ALL""", ("kb",))
def j11(spark, d):
    n = I.table(spark, d, "nation").join(I.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("b"))
    s = I.table(spark, d, "supplier").join(n, "s_nationkey").select(F.col("s_name").alias("a"), "b")
    mined = K.country_facts(s.unionByName(I.kb_pairs(spark, d)))
    return K.new_facts(mined, I.kb_facts(spark, d)).select("id", "claim")


@query("u3_f30_grow_kb", """SELECT kind, count(*) AS n FROM (SELECT 'geographic' AS kind FROM supplier UNION ALL SELECT 'misconceptions' FROM (SELECT DISTINCT p_name FROM part)) GROUP BY 1""")
def u3(spark, d):
    n = I.table(spark, d, "nation").join(I.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("b"))
    mined = K.country_facts(I.table(spark, d, "supplier").join(n, "s_nationkey").select(F.col("s_name").alias("a"), "b"))
    wrong = K.misconception_facts(I.table(spark, d, "part").select(I.sf("all ", F.col("p_name"), " are round").alias("claim"), F.lit("no").alias("truth"), F.lit("other").alias("category")))
    return K.growth_stats(K.grow_kb(I.kb_facts(spark, d), mined, wrong))


@query("p10_sample_facts", "SELECT id, claim FROM kb WHERE source = 'wikidata' ORDER BY id LIMIT 20", ("kb",))
def p10(spark, d):
    return K.sample_facts(I.kb_facts(spark, d), "wikidata", 20).select("id", "claim")


@query("w9_balanced_sample", """SELECT id, is_true FROM (SELECT *, row_number() OVER (PARTITION BY is_true ORDER BY md5(id || '7'), id) AS rn FROM kb) WHERE rn <= least((SELECT count(*) FROM kb WHERE is_true), (SELECT count(*) FROM kb WHERE NOT is_true), 500)""", ("kb",))
def w9(spark, d):
    return K.balanced_sample(I.kb_facts(spark, d), 1000, "7").select("id", "is_true")


@query("p9_training_data", "SELECT id, is_true FROM kb WHERE claim_type = 'historical' AND NOT is_true ORDER BY id LIMIT 1000", ("kb",))
def p9(spark, d):
    return K.training_data(I.kb_facts(spark, d), claim_type="historical", only_false=True).select("id", "is_true")


@query("w7_page", "SELECT id, claim FROM kb ORDER BY id LIMIT 100 OFFSET 200", ("kb",))
def w7(spark, d):
    return K.page(I.kb_facts(spark, d), ["id"], 200, 100).select("id", "claim")


@query("w7_stored_pages", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 200 OFFSET 1000")
def w7_stored(spark, d):
    """A page by its offset and the next one by its cursor."""
    order = ["o_totalprice", "o_orderkey"]
    pages = K.store_pages(I.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), order)
    first = pages.read(1000, 100)
    last = first.orderBy(*[F.desc(c) for c in order]).first()
    return first.unionByName(K.page_after(pages.rows, order, [last[c] for c in order], 100)) if last else first


@query("s4_latest_facts", "SELECT 'u' || user_id AS id, arg_max(event_type, event_id) AS claim, max(event_id) % 2 = 0 AS is_true FROM events GROUP BY user_id")
def s4(spark, d):
    from claimspark.sources.files import latest_facts

    f = I.table(spark, d, "events").select(I.sf("u", I.s("user_id")).alias("id"), F.col("event_type").alias("claim"), (F.col("event_id") % 2 == 0).alias("is_true"), F.col("event_id").alias("ordinal"))
    return latest_facts(f)


def _candidates(spark, d):
    k = F.col("c_custkey")
    return I.table(spark, d, "customer").select(
        I.s("c_custkey").alias("id"), F.col("c_name").alias("claim"), F.lit("truth").alias("truth"), F.lit("war_myth").alias("category"), F.lit("modern").alias("era"), F.lit("myth").alias("status"),
        F.array(F.col("c_mktsegment")).alias("keywords"), F.when(k % 4 == 0, "approved").when(k % 4 == 1, "rejected").otherwise("pending").alias("review_status"))


def _review_events(spark, d):
    k = F.col("o_orderkey")
    return I.table(spark, d, "orders").select(
        I.s("o_custkey").alias("candidate_id"), F.when(k % 3 == 0, "reject").otherwise("approve").alias("action"), F.col("o_orderpriority").alias("notes"),
        F.when(k % 2 == 0, I.sf("edited ", I.s("o_orderkey"))).alias("modified_claim"), F.lit(None).cast("string").alias("modified_truth"), k.alias("ts"))


@query("p8_pending", "SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_custkey % 4 > 1")
def p8(spark, d):
    return K.pending(_candidates(spark, d)).select("id")


@query("a18_learning_stats", "SELECT count(*) AS total_candidates, count(*) FILTER (c_custkey % 4 > 1) AS pending_review, count(*) FILTER (c_custkey % 4 = 0) AS approved, count(*) FILTER (c_custkey % 4 = 1) AS rejected FROM customer")
def a18(spark, d):
    return K.learning_stats(_candidates(spark, d))


_REVIEWED = """reviewed AS (SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN k % 3 <> 0 AND k % 2 = 0 THEN 'edited ' || k ELSE c_name END AS claim, CASE WHEN k IS NULL THEN CASE c_custkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END
    WHEN k % 3 = 0 THEN 'rejected' ELSE 'approved' END AS review_status FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""


@query("x9_apply_reviews", f"WITH {_REVIEWED} SELECT id, claim, review_status FROM reviewed")
def x9(spark, d):
    return K.apply_reviews(_candidates(spark, d), _review_events(spark, d)).select("id", "claim", "review_status")


@query("j17_promote_candidates", f"WITH {_REVIEWED} SELECT 'learned_' || id AS id, claim, 50 AS popularity FROM reviewed WHERE review_status = 'approved' AND id NOT IN (SELECT CAST(s_suppkey AS VARCHAR) FROM supplier)")
def j17(spark, d):
    known = I.table(spark, d, "supplier").select(I.sf("learned_", I.s("s_suppkey")).alias("id"))
    return K.promote_candidates(K.apply_reviews(_candidates(spark, d), _review_events(spark, d)), known).select("id", "claim", "popularity")
