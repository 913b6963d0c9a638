"""Claim/fact graph as two tables: upsert, statistics, neighbourhoods, k-hop and closure.

graph nodes: ``node_type, source_label, name, properties map<string,string>``
graph edges: ``source_type, source_name, relation_type, target_type, target_name, source_label,
properties``; both ends of an edge carry its ``source_label``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from claimspark.functions.names import strip
from claimspark.operators.skew import hot_keys, skew_join
from claimspark.session import checkpoint

NODE_KEY = ["node_type", "source_label", "name"]
EDGE_KEY = ["source_type", "source_name", "relation_type", "target_type", "target_name", "source_label"]


def empty_map():
    return F.create_map().cast("map<string,string>")


# ---- projections -------------------------------------------------------------------------------
def nodes_by_type(nodes: DataFrame, node_type: str) -> DataFrame:
    return nodes.filter(F.col("node_type") == node_type)


def triples(rels: DataFrame) -> DataFrame:
    return rels.select("source_name", "relation_type", "target_name")


def node_labels(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("labels", F.array("node_type", "source_label"))


def with_node_properties(nodes: DataFrame) -> DataFrame:
    """Append ``properties``: every non-empty attribute as text, coordinates as two entries."""
    have = set(nodes.columns)
    pairs = []
    for name in ("source_label", "confidence", "description", "birth_date", "death_date", "nationality", "start_date",
                 "end_date", "event_type", "location_type", "parent_location", "date_value", "precision",
                 "calendar_system", "org_type", "founded_date", "dissolved_date", "headquarters"):
        if name in have:
            pairs += [F.lit(name), F.col(name).cast("string")]
    for name in ("aliases", "occupation"):
        if name in have:
            pairs += [F.lit(name), F.array_join(name, "; ")]
    if "coordinates" in have:
        pairs += [F.lit("latitude"), F.col("coordinates.lat").cast("string"),
                  F.lit("longitude"), F.col("coordinates.lon").cast("string")]
    bag = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))
    return nodes.withColumn("properties", bag)


# ---- upsert ------------------------------------------------------------------------------------
def _last_wins(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per key; each property takes the value with the highest ordinal.

    Keyed by (key, property) first, so copies of a hot key combine map-side; the final list holds
    at most one entry per property name.
    """
    entries = df.select(*key, "ordinal", F.explode_outer(F.coalesce("properties", empty_map())).alias("_p", "_v"))
    latest = entries.filter(F.col("_p").isNull() | F.col("_v").isNotNull()).groupBy(*key, "_p").agg(
        F.max_by("_v", "ordinal").alias("_v"))
    return latest.groupBy(*key).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_v")))).alias("properties"))


def _overlay(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    joined = old.select(*key, F.col("properties").alias("_old")).join(
        new.select(*key, F.col("properties").alias("_new")), key, "full_outer")
    return joined.select(*key, F.map_zip_with(
        F.coalesce("_old", empty_map()), F.coalesce("_new", empty_map()), lambda k, o, n: F.coalesce(n, o)
    ).alias("properties"))


def merge_nodes(graph_nodes: DataFrame, incoming: DataFrame) -> DataFrame:
    """Upsert by (type, label, name): incoming properties overwrite, others stay.

    ``incoming``: node key columns, ``ordinal``, ``properties``.
    """
    return _overlay(graph_nodes, _last_wins(incoming, NODE_KEY), NODE_KEY)


def edge_endpoints(edges: DataFrame) -> DataFrame:
    ends = F.array(F.struct(F.col("source_type").alias("t"), F.col("source_name").alias("n")),
                   F.struct(F.col("target_type").alias("t"), F.col("target_name").alias("n")))
    return edges.select("source_label", F.explode(ends).alias("e")).select(
        F.col("e.t").alias("node_type"), "source_label", F.col("e.n").alias("name")).distinct()


def merge_edges(graph_nodes: DataFrame, graph_edges: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert edges; end points that do not exist yet appear as bare nodes."""
    incoming = incoming.withColumns({"source_name": strip(F.col("source_name")), "target_name": strip(F.col("target_name"))})
    skeleton = edge_endpoints(incoming).join(graph_nodes.select(*NODE_KEY), NODE_KEY, "left_anti").withColumn(
        "properties", empty_map())
    nodes = graph_nodes.select(*NODE_KEY, "properties").unionByName(skeleton)
    return nodes, _overlay(graph_edges, _last_wins(incoming, EDGE_KEY), EDGE_KEY)


def add_graph(graph_nodes: DataFrame, graph_edges: DataFrame, nodes: DataFrame, rels: DataFrame, label: str
              ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Load an extraction as Claim or Fact graph; third result: counts of what was added."""
    nodes = nodes.withColumn("source_label", F.lit(label))
    rels = rels.withColumn("source_label", F.lit(label))
    merged = merge_nodes(graph_nodes, nodes)
    all_nodes, all_edges = merge_edges(merged, graph_edges, rels)
    counts = nodes.agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes_added").alias("what"), "n").unionByName(
        rels.agg(F.count(F.lit(1)).alias("n")).select(F.lit("relationships_added").alias("what"), "n"))
    return all_nodes, all_edges, counts


def clear_claims(graph_nodes: DataFrame, graph_edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Drop Claim nodes and every edge that touches one (both ends share the edge's label)."""
    return (graph_nodes.filter(F.col("source_label") != "Claim"),
            graph_edges.filter(F.col("source_label") != "Claim"))


# ---- reading -----------------------------------------------------------------------------------
def neighbors(edges: DataFrame, names: DataFrame, direction: str = "both") -> DataFrame:
    """Edges around each ``name`` of the ``names`` table: ``name, relation_type, other_name, other_type``."""
    out = edges.select(F.col("source_name").alias("name"), "relation_type", F.col("target_name").alias("other_name"),
                       F.col("target_type").alias("other_type"), "source_label", F.lit("out").alias("direction"))
    back = edges.select(F.col("target_name").alias("name"), "relation_type", F.col("source_name").alias("other_name"),
                        F.col("source_type").alias("other_type"), "source_label", F.lit("in").alias("direction"))
    table = {"out": out, "in": back, "both": out.unionByName(back)}[direction]
    return table.join(names.select("name").distinct(), "name", "left_semi")


def graph_label_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Count per label (a node counts once per label) and per relation type."""
    labels = node_labels(nodes).select(F.explode("labels").alias("label")).groupBy("label").agg(
        F.count(F.lit(1)).alias("n")).select(F.lit("label").alias("kind"), "label", "n")
    types = edges.groupBy(F.col("relation_type").alias("label")).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("relationship").alias("kind"), "label", "n")
    return labels.unionByName(types)


def graph_totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Totals of a myth graph: one row per entity kind and one for the edges."""
    kinds = {"total_myths": "Myth", "total_narratives": "Narrative", "total_persons": "Person", "total_sources": "Source"}
    counted = nodes.agg(*[F.count_if(F.col("kind") == v).alias(k) for k, v in kinds.items()])
    rows = counted.select(F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("measure", "n"))
    return rows.unionByName(edges.agg(F.count(F.lit(1)).alias("n")).select(F.lit("total_relationships").alias("measure"), "n"))


def category_distribution(myths: DataFrame) -> DataFrame:
    return myths.filter(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(
        F.desc("n"), "category")


# ---- myth graph --------------------------------------------------------------------------------
def myth_graph(myths: DataFrame, narratives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes ``kind, key, popularity, claim`` and edges ``edge_type, source_key, target_key``.

    Related ids that are no myth become stub nodes; narrative members must exist.
    """
    real = myths.select(F.lit("Myth").alias("kind"), F.col("id").alias("key"), "popularity", "claim")
    related = myths.select(F.col("id").alias("source_key"), F.explode("related_myths").alias("target_key")).distinct()
    blank = [F.lit(None).cast("int").alias("popularity"), F.lit(None).cast("string").alias("claim")]
    stubs = related.select(F.col("target_key").alias("key")).distinct().join(
        myths.select(F.col("id").alias("key")), "key", "left_anti").select(F.lit("Myth").alias("kind"), "key", *blank)
    debunked = myths.select(F.explode("debunked_by").alias("source_key"), F.col("id").alias("target_key")).distinct()
    cited = myths.select(F.col("id").alias("source_key"), F.explode("sources.title").alias("target_key")).distinct()
    belongs = narratives.select(F.explode("examples").alias("source_key"), F.col("id").alias("target_key")).distinct().join(
        myths.select(F.col("id").alias("source_key")), "source_key", "left_semi")
    other = lambda df, col, kind: df.select(F.lit(kind).alias("kind"), F.col(col).alias("key"), *blank).distinct()
    nodes = (real.unionByName(stubs).unionByName(other(debunked, "source_key", "Person"))
             .unionByName(other(cited, "target_key", "Source")).unionByName(other(narratives, "id", "Narrative")))
    edge = lambda df, t: df.select(F.lit(t).alias("edge_type"), "source_key", "target_key")
    edges = (edge(related, "RELATED_TO").unionByName(edge(debunked, "DEBUNKED"))
             .unionByName(edge(cited, "CITED_IN")).unionByName(edge(belongs, "BELONGS_TO")))
    return nodes, edges


def _by_popularity(*extra: str) -> list:
    return [F.col("popularity").desc_nulls_first(), *extra]


def myths_by_narrative(edges: DataFrame, nodes: DataFrame, narrative_ids: DataFrame) -> DataFrame:
    """Member myths of each narrative in ``narrative_ids(id)``, most popular first per narrative."""
    return (edges.filter(F.col("edge_type") == "BELONGS_TO")
            .join(narrative_ids.select(F.col("id").alias("target_key")), "target_key", "left_semi")
            .join(nodes.filter(F.col("kind") == "Myth").select(F.col("key").alias("source_key"), "popularity", "claim"), "source_key")
            .select(F.col("target_key").alias("narrative_id"), F.col("source_key").alias("myth_id"), "claim", "popularity")
            .orderBy("narrative_id", *_by_popularity("myth_id")))


def myths_by_debunker(edges: DataFrame, nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Myths each person in ``names(name)`` debunked, most popular first per person."""
    return (edges.filter(F.col("edge_type") == "DEBUNKED")
            .join(names.select(F.col("name").alias("source_key")), "source_key", "left_semi")
            .join(nodes.filter(F.col("kind") == "Myth").select(F.col("key").alias("target_key"), "popularity", "claim"), "target_key")
            .select(F.col("source_key").alias("debunker"), F.col("target_key").alias("myth_id"), "claim", "popularity")
            .orderBy("debunker", *_by_popularity("myth_id")))


def most_debunked(edges: DataFrame, nodes: DataFrame, n: int = 20) -> DataFrame:
    """Report of the n myths with most debunkers."""
    counts = edges.filter(F.col("edge_type") == "DEBUNKED").groupBy(F.col("target_key").alias("key")).agg(
        F.count(F.lit(1)).alias("connections")).orderBy(F.desc("connections"), "key").limit(n)
    return counts.join(nodes.filter(F.col("kind") == "Myth").select("key", "claim"), "key").select(
        F.col("key").alias("myth_id"), "claim", "connections").orderBy(F.desc("connections"), "myth_id")


def related(edges: DataFrame, nodes: DataFrame, depth: int = 2, k: int = 10, seeds: DataFrame | None = None) -> DataFrame:
    """The k most popular nodes within ``depth`` undirected hops of every node (or of ``seeds(id)``).

    ``edges``: ``src, dst``; ``nodes``: ``id, popularity``. Each hop hands every neighbour only the
    k + 1 most popular nodes it has seen. That is exact: of what a neighbour knows, at most one node
    is the receiver itself, so anything outside its first k + 1 is beaten by k others. The rows per
    hop are bounded by edges * (k + 1); a hub never emits its pairs of neighbours.
    """
    if depth not in (1, 2, 3):
        raise ValueError("depth must be 1, 2 or 3")
    sym = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    sym = sym.filter(F.col("src") != F.col("dst")).distinct()
    pop = nodes.select(F.col("id").alias("dst"), "popularity")
    base = sym.join(pop, "dst", "left").select("src", "dst", "popularity")
    order = Window.partitionBy("src").orderBy(*_by_popularity("dst"))

    def keep_best(pairs: DataFrame, n: int) -> DataFrame:
        nearest = pairs.groupBy("src", "dst", "popularity").agg(F.min("dist").alias("dist"))
        return nearest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)

    direct = base.withColumn("dist", F.lit(1))
    known = direct
    hubs = hot_keys(base.select(F.col("dst").alias("via")), ["via"]) if depth > 1 else []
    for _ in range(depth - 1):
        best = keep_best(known, k + 1)
        onward = skew_join(base.select("src", F.col("dst").alias("via")), best.select(
            F.col("src").alias("via"), "dst", "popularity", (F.col("dist") + 1).alias("dist")), ["via"], hot=hubs)
        known = direct.unionByName(onward.filter(F.col("src") != F.col("dst")).select("src", "dst", "popularity", "dist"))
    top = keep_best(known, k)
    if seeds is not None:
        top = top.join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    return top.select(F.col("src").alias("id"), F.col("dst").alias("related_id"), "popularity",
                      F.lit(depth).alias("distance"), F.col("dist").alias("min_distance"), "rank")


def subclass_closure(subclass_edges: DataFrame, roots: DataFrame, max_depth: int = 64) -> DataFrame:
    """All classes below each root, the root included: ``root, class``.

    Semi-naive loop: each round extends only the newest classes. Results are checkpointed, so a lost
    executor costs one round and the plan does not grow.
    """
    edges = subclass_edges.select("child", "parent").distinct()
    frontier = roots.select(F.col("root"), F.col("root").alias("class")).distinct()
    seen = checkpoint(frontier)
    frontier = seen
    for _ in range(max_depth):
        step = frontier.join(edges, frontier["class"] == edges["parent"]).select("root", F.col("child").alias("class"))
        frontier = checkpoint(step.distinct().join(seen, ["root", "class"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = checkpoint(seen.unionByName(frontier))
    raise RuntimeError(f"subclass hierarchy deeper than {max_depth}")


def instances_of(instance_edges: DataFrame, subclass_edges: DataFrame, roots: DataFrame) -> DataFrame:
    """Instances of each root class or of any class below it: ``root, instance``."""
    classes = subclass_closure(subclass_edges, roots)
    return instance_edges.join(classes, "class").select("root", "instance").distinct()
