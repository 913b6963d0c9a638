"""Model responses to node and relationship tables, with everything unusable in a reject table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions.names import text_hash
from claimspark.schema import validate_nodes, validate_rels
from claimspark.session import checkpoint


# Up to the next brace outside a string, braces included. Possessive, so long texts need no stack and nothing is tried twice.
_TO_BRACE = r'(?s)(?:[^"{}\\]++|\\"?+|"(?:[^"\\]|\\.)*+"|")*+[{}]'
_STRINGS_APART = r'(?s)"(?:[^"\\]|\\.)*+"|[^"]+|"'
_FIELDS = ("nodes", "entities", "relationships", "relations")


def json_bodies(text: Column) -> Column:
    """Every outermost ``{...}`` of a text in order; braces within strings do not count. Linear in the text."""
    start = F.expr("named_struct('depth', 0, 'pos', 1, 'open', 1, 'spans', cast(array() as array<struct<start:int,len:int>>))")

    def step(state: Column, token: Column) -> Column:
        opens, depth = F.endswith(token, F.lit("{")), state["depth"]
        ends = state["pos"] + F.length(token)
        span = F.struct(state["open"].alias("start"), (ends - state["open"]).alias("len"))
        return F.struct(
            F.when(opens, depth + 1).otherwise(F.greatest(depth - 1, F.lit(0))).alias("depth"), ends.alias("pos"),
            F.when(opens & (depth == 0), ends - 1).otherwise(state["open"]).alias("open"),
            F.when(~opens & (depth == 1), F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(F.regexp_extract_all(text, F.lit(_TO_BRACE), F.lit(0)), start, step)["spans"]
    return F.transform(spans, lambda s: F.substring(text, s["start"], s["len"]))


def repair_json(body: Column) -> Column:
    """Drop trailing commas and quote bare keys; strings stay as they are."""
    def mend(piece: Column) -> Column:
        no_commas = F.regexp_replace(piece, r",(\s*[}\]])", "$1")
        return F.when(F.startswith(piece, F.lit('"')), piece).otherwise(F.regexp_replace(no_commas, r"([{,]\s*)(\w+)(\s*:)", '$1"$2"$3'))

    return F.array_join(F.transform(F.regexp_extract_all(body, F.lit(_STRINGS_APART), F.lit(0)), mend), "")


def parse_responses(raw: DataFrame) -> DataFrame:
    """``claim_id, response, source_text`` plus variant ``v`` (null if beyond repair) and ``text_hash``.

    The text from the first brace to the last is tried as it stands. If that has none of the expected lists, its outermost objects are tried
    as they stand and repaired, and the whole repaired (prose quotes can hide a brace): the first with one of the
    expected lists counts, else the first that parses. Fences, reasoning and remarks around the objects fall away.
    """
    has_list = lambda v: F.coalesce(*[F.try_variant_get(v, f"$.{f}", "array<variant>") for f in _FIELDS]).isNotNull()
    best = lambda a, v: F.when(has_list(a) | v.isNull(), a).when(has_list(v) | a.isNull(), v).otherwise(a)
    either = lambda body: F.coalesce(F.try_parse_json(body), F.try_parse_json(repair_json(body)))
    read = raw.withColumns({"_body": F.regexp_extract(F.regexp_extract("response", r"(?s)\{.*", 0), r"(?s)^.*\}", 0),
                            "text_hash": text_hash(F.col("source_text"))})
    read = read.withColumn("_strict", F.try_parse_json("_body"))
    bodies = F.array_append(json_bodies(F.col("_body")), F.col("_body"))
    mended = F.aggregate(F.transform(bodies, either), F.lit(None).cast("variant"), best)
    return read.withColumn("v", F.when(has_list(F.col("_strict")), F.col("_strict")).otherwise(mended)).drop("_body", "_strict")


def _items(parsed: DataFrame, *paths: str) -> DataFrame:
    found = F.coalesce(*[F.try_variant_get("v", f"$.{p}", "array<variant>") for p in paths])
    return parsed.select("claim_id", "text_hash", F.posexplode(found).alias("ordinal", "x"))


def _field(name: str, kind: str = "string") -> Column:
    return F.try_variant_get("x", f"$.{name}", kind).alias(name)


def _date(name: str) -> Column:
    return F.try_to_date(F.try_variant_get("x", f"$.{name}", "string"), "yyyy-MM-dd").alias(name)


def ingest_extractions(raw: DataFrame, label: str = "Claim", materialize: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, relationships and rejects (``claim_id, ordinal, what, reasons``).

    Five branches read the parsed answers, so these are written once to the shared checkpoint
    folder; ``materialize=False`` parses again in every branch.
    """
    parsed = parse_responses(raw).select("claim_id", "text_hash", "v")
    if materialize:
        parsed = checkpoint(parsed, "answers")
    none = F.array().cast("array<string>")
    kind = F.try_variant_get("x", "$.node_type", "string")
    nodes = _items(parsed, "nodes", "entities").select(
        "claim_id", "text_hash", "ordinal",
        F.concat(F.upper(F.left(kind, F.lit(1))), F.lower(F.substring(kind, 2, 500))).alias("node_type"), _field("name"),
        F.coalesce(F.try_variant_get("x", "$.aliases", "array<string>"), none).alias("aliases"), _field("description"),
        F.lit(label).alias("source_label"), F.coalesce(F.try_variant_get("x", "$.confidence", "double"), F.lit(1.0)).alias("confidence"),
        _date("birth_date"), _date("death_date"), _field("nationality"),
        F.coalesce(F.try_variant_get("x", "$.occupation", "array<string>"), none).alias("occupation"),
        _date("start_date"), _date("end_date"), _field("event_type"), _field("location_type"), _field("parent_location"),
        _date("date_value"), F.coalesce(F.try_variant_get("x", "$.precision", "string"), F.lit("day")).alias("precision"),
        _field("org_type"), _date("founded_date"), _date("dissolved_date"), _field("headquarters"))
    rels = _items(parsed, "relationships", "relations").select(
        "claim_id", "text_hash", "ordinal", _field("source_name"), _field("source_type"), _field("relation_type"),
        _field("target_name"), _field("target_type"), F.lit(label).alias("source_label"),
        F.coalesce(F.try_variant_get("x", "$.confidence", "double"), F.lit(1.0)).alias("confidence"),
        F.coalesce(F.try_variant_get("x", "$.properties", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("properties"))
    good_nodes, bad_nodes = validate_nodes(nodes)
    good_rels, bad_rels = validate_rels(rels)
    reject = lambda df, what: df.select("claim_id", "ordinal", F.lit(what).alias("what"), F.col("reject_reasons").alias("reasons"))
    unreadable = parsed.filter(F.col("v").isNull()).select(
        "claim_id", F.lit(None).cast("int").alias("ordinal"), F.lit("response").alias("what"), F.array(F.lit("json")).alias("reasons"))
    return good_nodes, good_rels, unreadable.unionByName(reject(bad_nodes, "node")).unionByName(reject(bad_rels, "relationship"))
