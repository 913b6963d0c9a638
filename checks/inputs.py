"""Operator inputs derived from the driver tables: once as DataFrames, once as SQL table expressions.

The prose of ``documents`` holds next to no lexicon words, so each text gets a phrase appended. All
other inputs re-read the business tables as claims, facts, votes, runs and requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimspark.session import spread

PHRASES = [
    "Napoleon war klein und die Gefahr ist immer da.",
    "Vikings wore horned helmets, experts say.",
    "Studies show that everyone must believe it.",
    "Studies show this, see the source in the archive.",
    "The real history was covered up and the truth is hidden, a secret.",
    "You are either with us or only against us!",
    "A great leader saved the nation; without him they would have lost.",
    "Probably the battle of 1815 was lost in the 19th century.",
    "What about the others? They also did the same, but they did the same twice.",
    "Die Chinesische Mauer ist vom Mond aus sichtbar, sagte Max Mustermann.",
    "Wenn wir nicht handeln, werden sie uns vernichten.",
    "The conspiracy is against us, they want to destroy everything.",
    "According to records [12] the king died on 12.03.1643 in Paris.",
    "Ancient Roman knights and medieval castles.",
    "No further remark.",
    "It is well known, obviously, that this never happened.",
    "The victims were persecuted and attacked unfairly; we are victims.",
    "In the old days it used to be better before it was destroyed.",
    "Columbus wanted to prove the earth is round in 1492.",
    "Everything is completely and totally wrong, unprecedented in history.",
]

# Invention dates for the words that part names hold.
TECH = {"ring": "1996-06-01", "bolt": "1997-03-15", "widget": "1998-01-01", "gizmo": "1999-09-09", "anvil": "1995-05-05"}
REGION_SWAPS = {
    "AFRICA": ["AMERICA", "ASIA", "EUROPE"], "AMERICA": ["ASIA", "EUROPE"], "ASIA": ["AFRICA", "MIDDLE EAST"],
    "EUROPE": ["AFRICA", "AMERICA", "ASIA", "MIDDLE EAST"],
}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(items) -> str:
    return "[" + ", ".join(quoted(i) for i in items) + "]"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def texts(spark: SparkSession, d: str) -> DataFrame:
    """Ids and texts of the documents; one small file is spread over the cores first."""
    return spread(table(spark, d, "documents").select("doc_id", "text"))


def sf(*cols):
    return F.concat(*[c if not isinstance(c, str) else F.lit(c) for c in cols])


def s(name: str):
    return F.col(name).cast("string")


# ---- texts -------------------------------------------------------------------------------------
def docs(spark, d) -> DataFrame:
    phrases = F.array(*map(F.lit, PHRASES))
    return texts(spark, d).select(
        "doc_id", sf(F.col("text"), " ", F.element_at(phrases, (F.col("doc_id") % len(PHRASES) + 1).cast("int"))).alias("text"))


def doc_claims(spark, d) -> DataFrame:
    return docs(spark, d).select(s("doc_id").alias("claim_id"), "text")


def phrase_claims(spark, d) -> DataFrame:
    """One short claim per part: its name set into a sentence."""
    n = F.col("p_name")
    form = F.col("p_partkey") % 5
    text = (F.when(form == 0, n).when(form == 1, sf("The ", n, " is old")).when(form == 2, F.upper(n))
            .when(form == 3, sf("a ", F.substring(n, 1, 5), " thing")).otherwise(sf("nothing about it, ", F.col("p_brand"))))
    return table(spark, d, "part").select(s("p_partkey").alias("claim_id"), text.alias("text"))


# ---- myth base ---------------------------------------------------------------------------------
def myths(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        sf("m", s("p_partkey")).alias("id"), k.alias("ordinal"), F.col("p_name").alias("claim"),
        F.when(k % 4 == 0, sf("the ", F.col("p_name"), " is a myth")).alias("claim_en"), F.col("p_type").alias("category"),
        F.col("p_brand").alias("era"), F.element_at(F.array(F.lit("myth"), F.lit("false"), F.lit("disputed")), (k % 3 + 1).cast("int")).alias("status"),
        sf(F.col("p_name"), " by ", F.col("p_brand")).alias("truth"), F.when(k % 5 == 0, sf("truth of ", F.col("p_name"))).alias("truth_en"),
        F.struct(F.col("p_brand").alias("source"), F.when(k % 2 == 0, F.lit("1900")).alias("date"), F.lit("trade").alias("reason")).alias("origin"),
        F.array(F.struct(sf("T", s("p_size")).alias("title")), F.struct(sf("B", F.col("p_brand")).alias("title"))).alias("sources"),
        F.split("p_name", " ").alias("keywords"),
        F.array(sf("person", (k % 37).cast("string")), sf("person", (k % 11).cast("string"))).alias("debunked_by"),
        F.array(sf("m", (k + 1).cast("string")), sf("m", (k * 7 % 5000).cast("string"))).alias("related_myths"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size")).alias("popularity"))


def narratives(spark, d) -> DataFrame:
    """One narrative per supplier; its example myths follow from its key."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(
        sf("n", s("s_suppkey")).alias("id"), F.col("s_name").alias("name"), F.lower("s_name").alias("name_en"),
        sf("story of ", F.col("s_name")).alias("description"), F.array(F.col("s_name")).alias("typical_claims"), sf("purpose ", s("s_nationkey")).alias("purpose"),
        F.array(sf("m", (k * 3).cast("string")), sf("m", (k * 3 + 1).cast("string")), sf("m", (k + 100000).cast("string"))).alias("examples"))


# ---- claim graphs ------------------------------------------------------------------------------
def lines(spark, d) -> DataFrame:
    """Order lines made unique by (order, line number)."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_shipdate").alias("shipdate"), F.min("l_partkey").alias("partkey"), F.min("l_suppkey").alias("suppkey"),
        F.min("l_returnflag").alias("rf"), F.min("l_linestatus").alias("ls"), F.max(F.abs("l_discount")).alias("disc"),
        F.max("l_quantity").alias("qty"))


def chron_nodes(spark, d) -> DataFrame:
    """Per order: one person, one event per line, one date node, one organization."""
    o = table(spark, d, "orders")
    od = F.to_date("o_orderdate")
    none = F.lit(None).cast("date")
    k = F.col("o_custkey")
    shape = ["claim_id", "ordinal", "node_type", "name", "description", "birth_date", "death_date", "start_date", "end_date", "date_value"]
    person = o.select(
        s("o_orderkey").alias("claim_id"), F.lit(0).alias("ordinal"), F.lit("Person").alias("node_type"),
        sf("Customer ", s("o_custkey")).alias("name"), F.col("o_orderpriority").alias("description"),
        F.when(k % 7 != 0, F.date_sub(od, (k % 60 - 20).cast("int"))).alias("birth_date"),
        F.when(k % 5 != 0, F.date_add(od, (k % 90 - 15).cast("int"))).alias("death_date"),
        none.alias("start_date"), none.alias("end_date"), none.alias("date_value"))
    event = lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name", "p_type"), "partkey").select(
        s("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ordinal"), F.lit("Event").alias("node_type"),
        F.col("p_name").alias("name"), F.when(F.col("l_linenumber") % 2 == 0, F.col("p_type")).alias("description"),
        none.alias("birth_date"), none.alias("death_date"),
        F.when(F.col("l_linenumber") != 3, F.to_date("shipdate")).alias("start_date"),
        F.when(F.col("rf") == "R", F.date_add(F.to_date("shipdate"), 10)).alias("end_date"), none.alias("date_value"))
    date = o.select(
        s("o_orderkey").alias("claim_id"), F.lit(100).alias("ordinal"), F.lit("Date").alias("node_type"),
        F.col("o_orderstatus").alias("name"), F.lit(None).cast("string").alias("description"), none.alias("birth_date"),
        none.alias("death_date"), none.alias("start_date"), none.alias("end_date"), od.alias("date_value"))
    return person.select(shape).unionByName(event.select(shape)).unionByName(date.select(shape))


def chron_rels(spark, d) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return lines(spark, d).join(o, "l_orderkey").join(
        table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name"), "partkey").select(
        s("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ordinal"), sf("Customer ", s("o_custkey")).alias("source_name"),
        F.lit("Person").alias("source_type"), F.when(F.col("rf") == "N", "LOCATED_AT").otherwise("PARTICIPATED_IN").alias("relation_type"),
        F.col("p_name").alias("target_name"), F.lit("Event").alias("target_type"))


def fact_nodes(spark, d) -> DataFrame:
    """One fact per part with a type, and null type for some."""
    k = F.col("p_partkey")
    code = F.left(F.md5(s("p_partkey")), F.lit(8))
    return table(spark, d, "part").select(
        sf("f", s("p_partkey")).alias("fact_id"), k.alias("ordinal"), sf(F.col("p_name"), " ", code).alias("name"),
        F.when(k % 10 == 9, F.lit(None).cast("string")).when(k % 2 == 0, "Organization").otherwise("Location").alias("node_type"),
        F.when(k % 3 == 0, F.array(sf("alias ", code), sf("Nick ", code))).otherwise(F.array().cast("array<string>")).alias("aliases"))


def claim_nodes(spark, d) -> DataFrame:
    """One node per order line: the part's fact name in one of seven spellings."""
    code = F.left(F.md5(s("partkey")), F.lit(8))
    full = sf(F.col("p_name"), " ", code)
    n = F.col("l_linenumber")
    name = (F.when(n == 1, full).when(n == 2, F.upper(full)).when(n == 3, F.expr("substring(full, 1, length(full) - 1)"))
            .when(n == 4, sf("the ", F.col("full"))).when(n == 5, sf("alias ", code)).when(n == 6, F.reverse("full")).otherwise(code))
    return lines(spark, d).join(table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), "p_name"), "partkey").withColumn(
        "full", full).select(s("l_orderkey").alias("claim_id"), n.alias("ordinal"), name.alias("name"),
                             F.when(F.col("partkey") % 2 == 0, "Organization").otherwise("Location").alias("node_type"))


def claim_rels(spark, d, nodes: DataFrame | None = None) -> DataFrame:
    """Each line's node is located at the next line's node of the same order; ``nodes`` may be passed on if stored."""
    a = claim_nodes(spark, d) if nodes is None else nodes
    b = a.select("claim_id", (F.col("ordinal") - 1).alias("ordinal"), F.col("name").alias("target_name"), F.col("node_type").alias("target_type"))
    return a.join(b, ["claim_id", "ordinal"]).select(
        "claim_id", "ordinal", sf(" ", F.col("name"), " ").alias("source_name"), F.col("node_type").alias("source_type"),
        F.lit("LOCATED_AT").alias("relation_type"), "target_name", "target_type")


def fact_edges(spark, d) -> DataFrame:
    """Facts located at each other wherever an order has both parts on neighbouring lines."""
    f = fact_nodes(spark, d).select("ordinal", F.col("name"))
    li = lines(spark, d)
    a = li.select("l_orderkey", "l_linenumber", F.col("partkey").alias("pa"))
    b = li.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("partkey").alias("pb"))
    pairs = a.join(b, ["l_orderkey", "l_linenumber"]).filter((F.col("pa") + F.col("pb")) % 3 != 0).select("pa", "pb").distinct()
    return pairs.join(f.select(F.col("ordinal").alias("pa"), F.col("name").alias("source_name")), "pa").join(
        f.select(F.col("ordinal").alias("pb"), F.col("name").alias("target_name")), "pb").select(
        "source_name", F.lit("LOCATED_AT").alias("relation_type"), "target_name",
        F.when((F.col("pa") * F.col("pb")) % 5 == 0, "Claim").otherwise("Fact").alias("source_label"))


def place_nodes(spark, d) -> DataFrame:
    """Graph nodes of the star schema: regions and nations as places, suppliers and customers as actors."""
    def rows(t, name, kind, label, key, extra):
        return table(spark, d, t).select(
            F.lit(kind).alias("node_type"), F.lit(label).alias("source_label"), F.col(name).alias("name"),
            F.col(key).cast("bigint").alias("ordinal"), F.create_map(F.lit("table"), F.lit(t), F.lit("key"), s(key), *extra).alias("properties"))
    return (rows("region", "r_name", "Location", "Fact", "r_regionkey", [])
            .unionByName(rows("nation", "n_name", "Location", "Fact", "n_nationkey", []))
            .unionByName(rows("supplier", "s_name", "Organization", "Fact", "s_suppkey", [F.lit("nation"), s("s_nationkey")]))
            .unionByName(rows("customer", "c_name", "Person", "Claim", "c_custkey", [F.lit("segment"), F.col("c_mktsegment")])))


def place_edges(spark, d) -> DataFrame:
    n = table(spark, d, "nation").withColumn("k", F.col("n_nationkey"))
    def rows(t, name, fk, kind, label):
        return table(spark, d, t).join(n.select(F.col("k").alias(fk), "n_name"), fk).select(
            F.lit(kind).alias("source_type"), F.col(name).alias("source_name"), F.lit("LOCATED_AT").alias("relation_type"),
            F.lit("Location").alias("target_type"), F.col("n_name").alias("target_name"), F.lit(label).alias("source_label"),
            F.create_map(F.lit("via"), F.lit(t)).alias("properties"))
    up = n.join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.lit("Location").alias("source_type"), F.col("n_name").alias("source_name"), F.lit("AFFILIATED_WITH").alias("relation_type"),
        F.lit("Location").alias("target_type"), F.col("r_name").alias("target_name"), F.lit("Fact").alias("source_label"),
        F.create_map(F.lit("via"), F.lit("nation")).alias("properties"))
    return rows("supplier", "s_name", "s_nationkey", "Organization", "Fact").unionByName(
        rows("customer", "c_name", "c_nationkey", "Person", "Claim")).unionByName(up)


# ---- evidence, runs, batches -------------------------------------------------------------------
TIER_LIST = ["tier_1_authority", "tier_2_factcheck", "tier_3_academic", "tier_4_encyclopedia"]


def source_results(spark, d) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, TIER_LIST)), F.col("l_linenumber") % 4 + 1)
    rel = F.element_at(F.array(*map(F.lit, [0.95, 0.85, 0.80, 0.75])), F.col("l_linenumber") % 4 + 1)
    kind = F.element_at(F.array(*map(F.lit, ["authority_file", "fact_check", "academic", "encyclopedia"])), F.col("l_linenumber") % 4 + 1)
    return lines(spark, d).select(
        s("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ordinal"), t.alias("tier"), kind.alias("source_type"),
        (F.col("rf") != "N").alias("found"), (F.col("disc") * 10).alias("relevance_score"), rel.alias("reliability_score"),
        F.when(F.col("ls") == "O", sf("rated ", F.col("rf"))).otherwise("").alias("rating"))


def votes(spark, d) -> DataFrame:
    pick = lambda *xs: F.element_at(F.array(*map(F.lit, xs)), F.col("l_linenumber") % len(xs) + 1)
    return lines(spark, d).select(
        s("l_orderkey").alias("claim_id"), F.col("l_linenumber").alias("ordinal"), pick("model", "structured", "local").alias("kind"),
        F.when(F.col("rf") == "A", "true").when(F.col("rf") == "R", F.when(F.col("ls") == "O", "false").otherwise("misleading")).otherwise("unverifiable").alias("verdict"),
        (F.col("disc") * 10).alias("raw_confidence"), F.when(F.col("partkey") % 4 != 0, sf("line ", s("l_linenumber"))).alias("explanation"),
        sf("fix ", s("partkey")).alias("correction"), pick("geographic", "historical", "rumour", "quote").alias("claim_type"))


def order_claims(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(s("o_orderkey").alias("claim_id"))


def run_nodes(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        s("user_id").alias("claim_id"), (F.col("event_id") % 3).alias("run_id"), F.col("event_id").alias("ordinal"),
        F.lit("Event").alias("node_type"), sf(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), " ",
                                             (F.col("event_id") % 17).cast("string")).alias("name"),
        (F.col("value") / 500).alias("confidence"), (F.col("event_id") % 5).alias("grade"))


def run_rels(spark, d) -> DataFrame:
    return table(spark, d, "events").select(
        s("user_id").alias("claim_id"), (F.col("event_id") % 3).alias("run_id"), F.col("event_id").alias("ordinal"),
        F.col("event_type").alias("source_name"), F.lit("CAUSED").alias("relation_type"),
        sf("Step ", (F.col("event_id") % 13).cast("string")).alias("target_name"), (F.col("value") / 500).alias("confidence"))


def batch_items(spark, d) -> DataFrame:
    e = F.col("event_type")
    return table(spark, d, "events").select(
        s("user_id").alias("job_id"), F.col("event_id").alias("item_id"),
        F.when(e == "error", "failed").when(e == "signup", "skipped").when(e == "click", "queued").otherwise("success").alias("status"),
        F.when(e == "error", F.col("props")).alias("error"), F.col("event_type").alias("source_id"),
        (F.col("event_id") % 9).alias("n_nodes"), (F.col("event_id") % 4).alias("n_rels"), F.col("value").alias("ms"), "ts")


# ---- knowledge base ----------------------------------------------------------------------------
def kb_pairs(spark, d) -> DataFrame:
    """Customer and its region, the "country and continent" of the knowledge-base queries."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("b"))
    return table(spark, d, "customer").join(n, "c_nationkey").select(F.col("c_name").alias("a"), "b")


def kb_facts(spark, d) -> DataFrame:
    """A knowledge base over customers: true and false located-in facts from two sources."""
    from claimspark.functions.names import stable_id

    k = table(spark, d, "customer").join(
        table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
            F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("b")), "c_nationkey")
    a, b, key = F.col("c_name"), F.col("b"), F.col("c_custkey")
    return k.select(
        stable_id("geo_", a, b).alias("id"), sf(a, " liegt in ", b).alias("claim"), (key % 4 != 0).alias("is_true"),
        sf("About ", a).alias("explanation"), F.when(key % 6 == 0, "generated").when(key % 5 == 0, "wikipedia").otherwise("wikidata").alias("source"),
        F.when(key % 3 == 0, "historical").otherwise("geographic").alias("claim_type"),
        F.when(key % 6 == 0, F.array(sf("Customer#", F.lpad((key + 1).cast("string"), 9, "0")))).otherwise(F.array(a, b)).alias("entities"),
        F.lit(1.0).alias("confidence"))


def analyses(spark, d) -> DataFrame:
    """One analysis per document; verdict and confidences follow from its id."""
    k = F.col("doc_id")
    verdict = F.element_at(F.array(*map(F.lit, ["false", "myth", "propaganda", "unverifiable", "historically_accurate"])), (k % 5 + 1).cast("int"))
    claim = lambda i: F.struct(sf("claim ", (k * 10 + i).cast("string")).alias("original_claim"),
                               (((k + i * 3) % 10) / 10).alias("confidence_score"))
    return docs(spark, d).select(
        s("doc_id").alias("id"), F.col("text").alias("source_text"), verdict.alias("overall_verdict"),
        sf("summary ", s("doc_id")).alias("summary_for_users"),
        F.when(k % 11 == 0, F.expr("cast(array() as array<struct<original_claim:string,confidence_score:double>>)")).otherwise(
            F.array(claim(0), claim(1))).alias("claims"))


# ---- the same inputs as SQL --------------------------------------------------------------------
_FULL = "p_name || ' ' || left(md5(CAST(partkey AS VARCHAR)), 8)"
CTE: dict[str, tuple[str, tuple[str, ...]]] = {
    "docs": (f"SELECT doc_id, text || ' ' || ({sql_list(PHRASES)})[doc_id % {len(PHRASES)} + 1] AS text FROM documents", ()),
    "phrase_claims": ("""SELECT CAST(p_partkey AS VARCHAR) AS claim_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN 'The ' || p_name || ' is old'
        WHEN 2 THEN upper(p_name) WHEN 3 THEN 'a ' || substring(p_name, 1, 5) || ' thing' ELSE 'nothing about it, ' || p_brand END AS text FROM part""", ()),
    "myths": ("""SELECT 'm' || p_partkey AS id, p_partkey AS ordinal, p_name AS claim,
        CASE WHEN p_partkey % 4 = 0 THEN 'the ' || p_name || ' is a myth' END AS claim_en, p_type AS category, p_brand AS era,
        (['myth','false','disputed'])[p_partkey % 3 + 1] AS status, p_name || ' by ' || p_brand AS truth,
        CASE WHEN p_partkey % 5 = 0 THEN 'truth of ' || p_name END AS truth_en, p_brand AS origin_source,
        CASE WHEN p_partkey % 2 = 0 THEN '1900' END AS origin_date, ['T' || p_size, 'B' || p_brand] AS titles,
        string_split(p_name, ' ') AS keywords, ['person' || (p_partkey % 37), 'person' || (p_partkey % 11)] AS debunked_by,
        ['m' || (p_partkey + 1), 'm' || (p_partkey * 7 % 5000)] AS related_myths,
        CASE WHEN p_size % 10 <> 0 THEN p_size END AS popularity FROM part""", ()),
    "narratives": ("""SELECT 'n' || s_suppkey AS id, s_name AS name, ['m' || (s_suppkey * 3), 'm' || (s_suppkey * 3 + 1), 'm' || (s_suppkey + 100000)] AS examples,
        s_nationkey FROM supplier""", ()),
    "li": ("""SELECT l_orderkey, l_linenumber, min(l_shipdate) AS shipdate, min(l_partkey) AS partkey, min(l_suppkey) AS suppkey, min(l_returnflag) AS rf,
        min(l_linestatus) AS ls, max(abs(l_discount)) AS disc, max(l_quantity) AS qty FROM lineitem GROUP BY l_orderkey, l_linenumber""", ()),
    "cn": ("""SELECT CAST(o_orderkey AS VARCHAR) AS claim_id, 0 AS ordinal, 'Person' AS node_type, 'Customer ' || o_custkey AS name, o_orderpriority AS description,
        CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) - CAST(o_custkey % 60 - 20 AS INTEGER) END AS birth_date,
        CASE WHEN o_custkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) + CAST(o_custkey % 90 - 15 AS INTEGER) END AS death_date,
        CAST(NULL AS DATE) AS start_date, CAST(NULL AS DATE) AS end_date, CAST(NULL AS DATE) AS date_value FROM orders
        UNION ALL SELECT CAST(l_orderkey AS VARCHAR), l_linenumber, 'Event', p_name, CASE WHEN l_linenumber % 2 = 0 THEN p_type END, NULL, NULL,
        CASE WHEN l_linenumber <> 3 THEN CAST(shipdate AS DATE) END, CASE WHEN rf = 'R' THEN CAST(shipdate AS DATE) + 10 END, NULL
        FROM li JOIN part ON p_partkey = partkey
        UNION ALL SELECT CAST(o_orderkey AS VARCHAR), 100, 'Date', o_orderstatus, NULL, NULL, NULL, NULL, NULL, CAST(o_orderdate AS DATE) FROM orders""", ("li",)),
    "cr": ("""SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, l_linenumber AS ordinal, 'Customer ' || o_custkey AS source_name,
        CASE WHEN rf = 'N' THEN 'LOCATED_AT' ELSE 'PARTICIPATED_IN' END AS relation_type, p_name AS target_name
        FROM li JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = partkey""", ("li",)),
    "node_dates": ("""SELECT * FROM (
        SELECT claim_id, ordinal, 0 AS slot, 'start' AS kind, name, start_date AS date FROM cn WHERE node_type = 'Event'
        UNION ALL SELECT claim_id, ordinal, 1, 'end', name, end_date FROM cn WHERE node_type = 'Event'
        UNION ALL SELECT claim_id, ordinal, 0, 'birth', name, birth_date FROM cn WHERE node_type = 'Person'
        UNION ALL SELECT claim_id, ordinal, 1, 'death', name, death_date FROM cn WHERE node_type = 'Person'
        UNION ALL SELECT claim_id, ordinal, 0, 'date', name, date_value FROM cn WHERE node_type = 'Date') WHERE date IS NOT NULL""", ("cn",)),
    "rel_events": ("""SELECT r.claim_id, r.source_name, r.target_name AS name, p.birth_date, p.death_date, e.event_date
        FROM cr r JOIN cn p ON p.claim_id = r.claim_id AND p.node_type = 'Person' AND p.name = r.source_name
        JOIN (SELECT claim_id, name, arg_min(date, ordinal * 10 + slot) AS event_date FROM node_dates GROUP BY 1, 2) e
        ON e.claim_id = r.claim_id AND e.name = r.target_name WHERE r.relation_type = 'PARTICIPATED_IN'""", ("cn", "cr", "node_dates")),
    "lifespan": ("""SELECT claim_id, 'chronological_impossibility' AS issue_type, 'critical' AS severity,
        'Birth date (' || birth_date || ') is after death date (' || death_date || ')' AS message, name AS claim_entity,
        CAST(birth_date AS VARCHAR) AS claim_value, CAST(death_date AS VARCHAR) AS fact_value FROM cn WHERE node_type = 'Person' AND birth_date > death_date
        UNION ALL SELECT claim_id, 'chronological_impossibility', 'critical',
        source_name || ' could not have participated in ''' || name || ''' (' || event_date || ') - born ' || birth_date, source_name, CAST(event_date AS VARCHAR),
        CAST(birth_date AS VARCHAR) FROM rel_events WHERE event_date < birth_date
        UNION ALL SELECT claim_id, 'chronological_impossibility', 'critical',
        source_name || ' could not have participated in ''' || name || ''' (' || event_date || ') - died ' || death_date, source_name, CAST(event_date AS VARCHAR),
        CAST(death_date AS VARCHAR) FROM rel_events WHERE event_date > death_date""", ("rel_events",)),
    "anachronism": (f"""SELECT c.claim_id, 'anachronism' AS issue_type, 'high' AS severity,
        '''' || term || ''' mentioned in context of ' || earliest || ', but invented ' || invented AS message, CAST(NULL AS VARCHAR) AS claim_entity,
        CAST(earliest AS VARCHAR) AS claim_value, CAST(invented AS VARCHAR) AS fact_value
        FROM (SELECT claim_id, min(CASE WHEN node_type = 'Event' THEN start_date WHEN node_type = 'Date' THEN date_value END) AS earliest,
              string_agg(lower(name), ' ') || ' ' || string_agg(lower(coalesce(description, '')), ' ') AS alltext FROM cn GROUP BY claim_id) c
        JOIN (VALUES {', '.join(f"('{k}', DATE '{v}')" for k, v in TECH.items())}) t(term, invented) ON contains(alltext, term) AND earliest < invented""", ("cn",)),
    "facts": ("""SELECT 'f' || p_partkey AS fact_id, p_partkey AS ordinal, p_name || ' ' || left(md5(CAST(p_partkey AS VARCHAR)), 8) AS name,
        CASE WHEN p_partkey % 10 = 9 THEN NULL WHEN p_partkey % 2 = 0 THEN 'Organization' ELSE 'Location' END AS node_type,
        CASE WHEN p_partkey % 3 = 0 THEN ['alias ' || left(md5(CAST(p_partkey AS VARCHAR)), 8), 'Nick ' || left(md5(CAST(p_partkey AS VARCHAR)), 8)] ELSE [] END AS aliases
        FROM part""", ()),
    "claim_nodes": (f"""SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, l_linenumber AS ordinal, CASE l_linenumber WHEN 1 THEN {_FULL} WHEN 2 THEN upper({_FULL})
        WHEN 3 THEN substring({_FULL}, 1, length({_FULL}) - 1) WHEN 4 THEN 'the ' || {_FULL} WHEN 5 THEN 'alias ' || left(md5(CAST(partkey AS VARCHAR)), 8)
        WHEN 6 THEN reverse({_FULL}) ELSE left(md5(CAST(partkey AS VARCHAR)), 8) END AS name,
        CASE WHEN partkey % 2 = 0 THEN 'Organization' ELSE 'Location' END AS node_type FROM li JOIN part ON p_partkey = partkey""", ("li",)),
    "claim_rels": ("""SELECT a.claim_id, a.ordinal, a.name AS source_name, 'LOCATED_AT' AS relation_type, b.name AS target_name
        FROM claim_nodes a JOIN claim_nodes b ON b.claim_id = a.claim_id AND b.ordinal = a.ordinal + 1""", ("claim_nodes",)),
    "fact_edges": ("""SELECT x.name AS source_name, 'LOCATED_AT' AS relation_type, y.name AS target_name, CASE WHEN (pa * pb) % 5 = 0 THEN 'Claim' ELSE 'Fact' END AS source_label
        FROM (SELECT DISTINCT a.partkey AS pa, b.partkey AS pb FROM li a JOIN li b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
              WHERE (a.partkey + b.partkey) % 3 <> 0) JOIN facts x ON x.ordinal = pa JOIN facts y ON y.ordinal = pb""", ("li", "facts")),
    "place_nodes": ("""SELECT 'Location' AS node_type, 'Fact' AS source_label, r_name AS name, 'region' AS tbl FROM region
        UNION ALL SELECT 'Location', 'Fact', n_name, 'nation' FROM nation UNION ALL SELECT 'Organization', 'Fact', s_name, 'supplier' FROM supplier
        UNION ALL SELECT 'Person', 'Claim', c_name, 'customer' FROM customer""", ()),
    "place_edges": ("""SELECT 'Organization' AS source_type, s_name AS source_name, 'LOCATED_AT' AS relation_type, 'Location' AS target_type, n_name AS target_name, 'Fact' AS source_label
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        UNION ALL SELECT 'Person', c_name, 'LOCATED_AT', 'Location', n_name, 'Claim' FROM customer JOIN nation ON c_nationkey = n_nationkey
        UNION ALL SELECT 'Location', n_name, 'AFFILIATED_WITH', 'Location', r_name, 'Fact' FROM nation JOIN region ON n_regionkey = r_regionkey""", ()),
    "results": ("""SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, l_linenumber AS ordinal,
        (['tier_1_authority','tier_2_factcheck','tier_3_academic','tier_4_encyclopedia'])[l_linenumber % 4 + 1] AS tier,
        (['authority_file','fact_check','academic','encyclopedia'])[l_linenumber % 4 + 1] AS source_type, rf <> 'N' AS found, disc * 10 AS relevance,
        ([0.95, 0.85, 0.80, 0.75])[l_linenumber % 4 + 1]::DOUBLE AS reliability, CASE WHEN ls = 'O' THEN 'rated ' || rf ELSE '' END AS rating FROM li""", ("li",)),
    "votes": ("""SELECT CAST(l_orderkey AS VARCHAR) AS claim_id, l_linenumber AS ordinal, (['model','structured','local'])[l_linenumber % 3 + 1] AS kind,
        CASE rf WHEN 'A' THEN 'true' WHEN 'R' THEN CASE WHEN ls = 'O' THEN 'false' ELSE 'misleading' END ELSE 'unverifiable' END AS verdict,
        CASE l_linenumber % 3 WHEN 0 THEN disc * 10 * 0.7::DOUBLE WHEN 1 THEN 0.95::DOUBLE ELSE disc * 10 * 0.6::DOUBLE END AS confidence,
        CASE WHEN partkey % 4 <> 0 THEN 'line ' || l_linenumber END AS explanation, 'fix ' || partkey AS correction,
        (['geographic','historical','rumour','quote'])[l_linenumber % 4 + 1] AS claim_type FROM li""", ("li",)),
    "run_nodes": ("""SELECT CAST(user_id AS VARCHAR) AS claim_id, event_id % 3 AS run_id, event_id AS ordinal, 'Event' AS node_type,
        CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || ' ' || (event_id % 17) AS name, value / 500 AS confidence, event_id % 5 AS grade FROM events""", ()),
    "run_rels": ("""SELECT CAST(user_id AS VARCHAR) AS claim_id, event_id % 3 AS run_id, event_id AS ordinal, event_type AS source_name, 'CAUSED' AS relation_type,
        'Step ' || (event_id % 13) AS target_name, value / 500 AS confidence FROM events""", ()),
    "items": ("""SELECT CAST(user_id AS VARCHAR) AS job_id, event_id AS item_id, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'skipped'
        WHEN 'click' THEN 'queued' ELSE 'success' END AS status, CASE WHEN event_type = 'error' THEN props END AS error, event_type AS source_id,
        event_id % 9 AS n_nodes, event_id % 4 AS n_rels, value AS ms, ts FROM events""", ()),
    "kb_pairs": ("""SELECT c_custkey, c_name AS a, r_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", ()),
    "kb": ("""SELECT 'geo_' || left(md5(a || '_' || b), 8) AS id, a || ' liegt in ' || b AS claim, c_custkey % 4 <> 0 AS is_true, 'About ' || a AS explanation,
        CASE WHEN c_custkey % 6 = 0 THEN 'generated' WHEN c_custkey % 5 = 0 THEN 'wikipedia' ELSE 'wikidata' END AS source,
        CASE WHEN c_custkey % 3 = 0 THEN 'historical' ELSE 'geographic' END AS claim_type,
        CASE WHEN c_custkey % 6 = 0 THEN ['Customer#' || lpad(CAST(c_custkey + 1 AS VARCHAR), 9, '0')] ELSE [a, b] END AS entities FROM kb_pairs""", ("kb_pairs",)),
    "analyses": ("""SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text AS source_text, (['false','myth','propaganda','unverifiable','historically_accurate'])[doc_id % 5 + 1] AS overall_verdict,
        CASE WHEN doc_id % 11 = 0 THEN NULL ELSE ((doc_id % 10) / 10.0::DOUBLE + ((doc_id + 3) % 10) / 10.0::DOUBLE) / 2 END AS mean_confidence FROM docs""", ("docs",)),
}


def with_ctes(names: tuple[str, ...] | list[str], body: str) -> str:
    """Prefix a query with the named table expressions and whatever they need, in order."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in done:
            return
        text, needs = CTE[name]
        for n in needs:
            add(n)
        done[name] = text

    for name in names:
        add(name)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in done.items()) + "\n" + body
