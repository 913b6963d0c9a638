"""Growth runs of the knowledge base and imports of authority records into the fact graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimspark.operators import kb as K
from claimspark.operators.evidence import mine_relations
from claimspark.operators.graph import add_graph, with_node_properties
from claimspark.operators.resolve import merge_by_priority, union_sources
from claimspark.sources.payloads import records_to_nodes


def mine_facts(statements: DataFrame, labels: DataFrame, classes: dict[str, str], mode: str = "strict") -> DataFrame:
    """Fact rows for countries, capitals and notable persons of a statement dump."""
    countries = K.resolved_labels(mine_relations(statements, labels, "countries", classes), "a", "b", mode=mode)
    capitals = K.resolved_labels(mine_relations(statements, labels, "capitals", classes), "a", "b", mode=mode)
    persons = K.resolved_labels(mine_relations(statements, labels, "persons", classes), "person", mode=mode)
    return K.country_facts(countries).unionByName(K.capital_facts(capitals)).unionByName(K.person_facts(persons))


def import_authority(graph_nodes: DataFrame, graph_edges: DataFrame, *records: DataFrame, sources: list[str] | None = None
                     ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Union, priority merge and load as Facts; third result: one statistics row.

    ``success`` is false when nothing was found.
    """
    union = union_sources(*records, sources=sources)
    merged = with_node_properties(records_to_nodes(merge_by_priority(union))).select(
        "node_type", "source_label", "name", "ordinal", "properties")
    no_rels = graph_edges.withColumn("ordinal", F.lit(0)).limit(0)
    nodes, edges, _ = add_graph(graph_nodes, graph_edges, merged, no_rels, "Fact")
    stats = merged.agg(F.count(F.lit(1)).alias("nodes_imported")).select(
        (F.col("nodes_imported") > 0).alias("success"), "nodes_imported", F.lit(0).cast("bigint").alias("relationships_imported"))
    return nodes, edges, stats
