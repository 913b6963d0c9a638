"""Raw JSON payloads of authority files, entity dumps and search services to typed tables.

Every function takes a table with a JSON ``payload`` column and works through variant paths, so one
field may be a list in one row and a scalar in the next. Malformed rows give null and are dropped;
``quarantine`` returns them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark import lexicons as L
from claimspark.functions.dates import iso_date, leading_date, parse_point, partial_date, year_date
from claimspark.functions.tokens import query_coverage


def _parsed(raw: DataFrame) -> DataFrame:
    return raw.withColumn("v", F.try_parse_json("payload"))


def quarantine(raw: DataFrame) -> DataFrame:
    return _parsed(raw).filter(F.col("v").isNull()).drop("v").withColumn("reason", F.lit("malformed JSON"))


def _text(path: str, v: str = "v") -> Column:
    return F.try_variant_get(v, path, "string")


def _list(path: str, v: str = "v") -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _first_or_self(path: str) -> Column:
    """First element if the field is a list, the field itself otherwise."""
    is_list = F.try_variant_get("v", path, "array<variant>").isNotNull()
    return F.when(is_list, _text(f"{path}[0]")).otherwise(_text(path))


def _strings(items: Column) -> Column:
    """Only the elements that are strings."""
    only = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(only, lambda x: F.variant_get(x, "$", "string"))


def _ordinal(raw: DataFrame) -> Column:
    return F.col("ordinal") if "ordinal" in raw.columns else F.monotonically_increasing_id().alias("ordinal")


def _type(raw: DataFrame, derived: Column) -> Column:
    return F.coalesce("entity_type", derived) if "entity_type" in raw.columns else derived


def _record(df: DataFrame, raw: DataFrame, source, authority_id, name, variants, entity_type, birth_raw, death_raw, birth, death,
            description, quality: str) -> DataFrame:
    return df.select(
        (F.lit(source) if isinstance(source, str) else source).alias("source"), authority_id.alias("authority_id"),
        name.alias("name"), variants.alias("name_variants"), entity_type.alias("entity_type"), birth.alias("birth_date"),
        death.alias("death_date"), birth_raw.alias("birth_raw"), death_raw.alias("death_raw"),
        description.alias("description"), F.lit(quality).alias("quality"), _ordinal(raw).alias("ordinal"))


# ---- authority records -------------------------------------------------------------------------
def ingest_gnd(raw: DataFrame) -> DataFrame:
    """Id required, name with fallback, string variants, all occupations and the whole biography."""
    df = _parsed(raw).withColumns({"id": _text("$.gndIdentifier"), "types": _strings(_list("$.type"))}).filter(
        F.coalesce("id", F.lit("")) != "")
    derived = F.when(F.array_contains("types", "Person"), "Person").when(
        F.array_contains("types", "PlaceOrGeographicName"), "Location").when(
        F.array_contains("types", "CorporateBody"), "Organization").otherwise("Person")
    jobs = F.filter(_list("$.professionOrOccupation"), lambda o: F.schema_of_variant(o).startswith("OBJECT"))
    labels = F.transform(jobs, lambda o: F.coalesce(F.try_variant_get(o, "$.label", "string"), F.lit("")))
    occupations = F.when(F.size(labels) > 0, F.array_join(labels, ", "))
    bio = _first_or_self("$.biographicalOrHistoricalInformation")
    described = F.concat_ws(" | ", occupations, F.when(bio != "", bio))
    birth, death = _first_or_self("$.dateOfBirth"), _first_or_self("$.dateOfDeath")
    name = F.coalesce(F.nullif(_text("$.preferredName"), F.lit("")), _text("$.preferredNameForThePerson"), F.lit(""))
    return _record(df, raw, "gnd", F.col("id"), name, _strings(_list("$.variantName")), _type(raw, derived), birth, death,
                   partial_date(birth), partial_date(death), F.nullif(described, F.lit("")), "verified")


def ingest_viaf(raw: DataFrame) -> DataFrame:
    """Main heading as list or object, all variants, bare-year dates."""
    df = _parsed(raw)
    heading = F.coalesce(_text("$.mainHeadings.data[0].text"), _text("$.mainHeadings.data.text"))
    df = df.withColumns({"id": _text("$.viafID"), "heading": heading}).filter(
        (F.coalesce("id", F.lit("")) != "") & (F.coalesce("heading", F.lit("")) != ""))
    variants = F.transform(_list("$.x400s.x400"),
                           lambda x: F.try_variant_get(x, "$.datafield.subfield.content", "string"))
    birth, death = _text("$.birthDate"), _text("$.deathDate")
    return _record(df, raw, "viaf", F.col("id"), F.col("heading"), F.filter(variants, lambda x: F.coalesce(x, F.lit("")) != ""),
                   _type(raw, F.lit("Person")), birth, death, year_date(birth), year_date(death),
                   F.lit(None).cast("string"), "authoritative")


_SKOS = "http://www.w3.org/2004/02/skos/core#"


def ingest_loc(raw: DataFrame) -> DataFrame:
    """First typed JSON-LD element, its preferred and alternative labels; the id comes in column ``lccn``."""
    df = _parsed(raw)
    graph = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    typed = F.filter(graph, lambda x: F.try_variant_get(x, "$['@type']", "variant").isNotNull())
    df = df.withColumn("v", F.get(typed, F.lit(0)))
    pref, alt = f"$['{_SKOS}prefLabel']", f"$['{_SKOS}altLabel']"
    name = F.coalesce(_text(f"{pref}[0]['@value']"), _text(f"{pref}['@value']"))
    df = df.withColumn("name", name).filter(F.coalesce("name", F.lit("")) != "")
    objects = F.filter(_list(alt), lambda x: F.schema_of_variant(x).startswith("OBJECT"))
    variants = F.transform(objects, lambda x: F.coalesce(F.try_variant_get(x, "$['@value']", "string"), F.lit("")))
    nothing, no_date = F.lit(None).cast("string"), F.lit(None).cast("date")
    return _record(df, raw, "loc", F.col("lccn"), F.col("name"), variants, _type(raw, F.lit("Person")), nothing, nothing,
                   no_date, no_date, nothing, "authoritative")


def ingest_getty(raw: DataFrame, vocabulary: str = "ulan") -> DataFrame:
    """One query binding per row; places come from TGN and persons from ULAN whatever the default."""
    df = _parsed(raw).withColumns({"subject": _text("$.subject.value"), "name": _text("$.prefLabel.value")}).filter(
        (F.coalesce("subject", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    kind = _type(raw, F.lit("Person"))
    source = F.when(kind == "Location", "getty_tgn").when(kind == "Person", "getty_ulan").otherwise(f"getty_{vocabulary}")
    start, end = _text("$.start.value"), _text("$.end.value")
    note = F.nullif(_text("$.scopeNote.value"), F.lit(""))
    return _record(df, raw, source, F.element_at(F.split("subject", "/"), -1), F.col("name"), F.array().cast("array<string>"),
                   kind, start, end, year_date(start), year_date(end), note, "verified")


def source_url(df: DataFrame) -> DataFrame:
    prefix = F.create_map(*[x for k, u in L.SOURCE_URL_PREFIX.items() for x in (F.lit(k), F.lit(u))])
    return df.withColumn("source_url", F.coalesce(F.concat(prefix[F.col("source")], "authority_id"), F.lit("")))


def records_to_nodes(records: DataFrame) -> DataFrame:
    """Authority records as Fact nodes; events reuse birth and death as start and end. Other types are dropped."""
    t = F.col("entity_type")
    when = lambda kind, c: F.when(t == kind, F.col(c))
    return records.filter(t.isin("Person", "Event", "Location", "Organization")).select(
        "ordinal", t.alias("node_type"), "name", F.col("name_variants").alias("aliases"), "description",
        F.lit("Fact").alias("source_label"), F.lit(1.0).alias("confidence"),
        when("Person", "birth_date").alias("birth_date"), when("Person", "death_date").alias("death_date"),
        when("Event", "birth_date").alias("start_date"), when("Event", "death_date").alias("end_date"), "source", "authority_id")


# ---- entity dumps ------------------------------------------------------------------------------
def entity_facts(raw: DataFrame, properties: dict[str, str] | None = None) -> DataFrame:
    """First statement of each listed property: ``entity, property_id, property, value, confidence, refs``."""
    properties = properties or L.ENTITY_PROPERTIES
    df = _parsed(raw)

    def statement(pid: str, name: str) -> Column:
        base = f"$.claims.{pid}[0]"
        kind = _text(f"{base}.mainsnak.datavalue.type")
        path = f"{base}.mainsnak.datavalue.value"
        unit = F.element_at(F.split(F.coalesce(_text(f"{path}.unit"), F.lit("")), "/"), -1)
        value = (
            F.when(kind == "time", _text(f"{path}.time"))
            .when(kind == "quantity", F.concat(F.coalesce(_text(f"{path}.amount"), F.lit("")), F.lit(" ("), unit, F.lit(")")))
            .when(kind == "wikibase-entityid", _text(f"{path}.id")).otherwise(_text(path)))
        cited = F.flatten(F.transform(_list(f"{base}.references"), lambda r: F.coalesce(
            F.try_variant_get(r, "$.snaks.P248", "array<variant>"), F.array().cast("array<variant>"))))
        refs = F.filter(F.transform(cited, lambda s: F.try_variant_get(s, "$.datavalue.value.id", "string")),
                        lambda x: F.coalesce(x, F.lit("")) != "")
        return F.struct(F.lit(pid).alias("property_id"), F.lit(name).alias("property"), value.alias("value"),
                        F.transform(refs, lambda x: F.concat(F.lit("https://www.wikidata.org/wiki/"), x)).alias("refs"))

    rows = df.select("entity", F.posexplode(F.array(*[statement(p, n) for p, n in properties.items()])).alias("ordinal", "s"))
    return rows.filter(F.coalesce("s.value", F.lit("")) != "").select(
        "entity", "ordinal", "s.property_id", "s.property", "s.value",
        F.when(F.size("s.refs") > 0, 1.0).otherwise(0.8).alias("confidence"), F.col("s.refs").alias("refs"),
        F.lit("WIKIDATA").alias("source"))


def bindings_to_nodes(raw: DataFrame, entity_type: str, dialect: str = "statements") -> DataFrame:
    """Query bindings as Fact nodes; ``dialect`` is 'statements' or 'ontology'. Rows without a name are dropped."""
    df = _parsed(raw)
    value = lambda key: _text(f"$.{key}.value")
    no_text, no_date = F.lit(None).cast("string"), F.lit(None).cast("date")
    no_point = F.lit(None).cast("struct<lat:double,lon:double>")
    names = {"statements": {"Person": "personLabel", "Event": "eventLabel", "Location": "placeLabel"}}
    name = value(names["statements"][entity_type] if dialect == "statements" else "name")
    date = iso_date if dialect == "statements" else leading_date
    birth = death = start = end = no_date
    description, parent, point = no_text, no_text, no_point
    if entity_type == "Person":
        keys = ("birth", "death") if dialect == "statements" else ("birthDate", "deathDate")
        birth, death = (date(value(k)) for k in keys)
    elif entity_type == "Event":
        start = date(value("startDate" if dialect == "statements" else "date"))
        end = date(value("endDate")) if dialect == "statements" else no_date
    elif dialect == "statements":
        parent, point = value("countryLabel"), parse_point(value("coord"))
    else:
        lat, lon = value("lat").try_cast("double"), value("long").try_cast("double")
        point = F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
    if dialect == "ontology" and entity_type != "Location":
        description = F.nullif(value("abstract"), F.lit(""))
    return df.withColumn("_name", name).filter(F.coalesce("_name", F.lit("")) != "").select(
        _ordinal(raw).alias("ordinal"), F.lit(entity_type).alias("node_type"), F.col("_name").alias("name"),
        description.alias("description"), F.lit("Fact").alias("source_label"), F.lit(1.0).alias("confidence"),
        birth.alias("birth_date"), death.alias("death_date"), start.alias("start_date"), end.alias("end_date"),
        parent.alias("parent_location"), point.alias("coordinates"))


def property_bag(rows: DataFrame) -> DataFrame:
    """``entity, ordinal, property, value`` rows to one map per entity; the last value of a name wins.

    Names are the tail after the last ``/`` and ``#``. The list holds one entry per property name.
    """
    tail = F.element_at(F.split(F.element_at(F.split("property", "/"), -1), "#"), -1)
    last = rows.groupBy("entity", tail.alias("name")).agg(F.max_by("value", "ordinal").alias("value"))
    return last.groupBy("entity").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("properties"))


# ---- search services ---------------------------------------------------------------------------
def _result(df: DataFrame, name, kind: str, tier: str, found: Column, **fields: Column) -> DataFrame:
    blank = F.lit(None).cast("string")
    cols = {k: F.when(found, fields.get(k, blank)) for k in ("title", "url", "extract", "claim_review", "rating")}
    return df.select(
        "claim_id", "ordinal", (F.lit(name) if isinstance(name, str) else name).alias("source_name"),
        F.lit(kind).alias("source_type"), F.lit(tier).alias("tier"), F.coalesce(found, F.lit(False)).alias("found"),
        *[c.alias(k) for k, c in cols.items()],
        F.when(found, fields["relevance"]).otherwise(0.0).alias("relevance_score"),
        F.lit(L.TIER_RELIABILITY[tier]).alias("reliability_score"),
        F.when(F.col("v").isNull(), "malformed payload").alias("error"))


def _has(path: str) -> Column:
    return F.coalesce(F.size(F.try_variant_get("v", path, "array<variant>")) > 0, F.lit(False))


def ingest_source_results(raw: DataFrame, source: str) -> DataFrame:
    """Search payloads (``claim_id, ordinal, query, payload``) to tiered source results: the first hit of each."""
    df, q = _parsed(raw), F.col("query")
    authority, factcheck, academic = L.TIERS[0], L.TIERS[1], L.TIERS[2]
    if source == "gnd":
        title = F.coalesce(_text("$.member[0].preferredName"), F.lit(""))
        part = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
        jobs = F.transform(_list("$.member[0].professionOrOccupation"), lambda o: F.coalesce(
            F.try_variant_get(o, "$.label", "string"), F.try_variant_get(o, "$", "string")))
        info = F.concat_ws(" | ", part("Name", _text("$.member[0].preferredName")),
                           part("Info", _first_or_self("$.member[0].biographicalOrHistoricalInformation")),
                           part("Born", _first_or_self("$.member[0].dateOfBirth")),
                           part("Died", _first_or_self("$.member[0].dateOfDeath")),
                           part("Occupation", F.array_join(jobs, ", ")))
        return _result(df, "GND (Deutsche Nationalbibliothek)", "authority_file", authority, _has("$.member"), title=title,
                       url=_text("$.member[0].id"), relevance=query_coverage(q, title),
                       extract=F.when(info == "", "No additional information").otherwise(info))
    if source == "viaf":
        base = "$.searchRetrieveResponse.records"
        data = f"{base}[0].record.recordData"
        title = F.coalesce(_text(f"{data}.mainHeadings.data[0].text"), _text(f"{data}.mainHeadings.data.text"), F.lit(""))
        ident = F.coalesce(_text(f"{data}.viafID"), F.lit(""))
        return _result(df, "VIAF (Virtual International Authority File)", "authority_file", authority, _has(base), title=title,
                       url=F.when(ident != "", F.concat(F.lit("https://viaf.org/viaf/"), ident)),
                       extract=F.concat(F.lit("VIAF ID: "), ident), relevance=query_coverage(q, title))
    if source == "loc":
        hits = F.filter(_list("$"), lambda x: F.try_variant_get(x, "$['@id']", "string").isNotNull())
        df = df.withColumn("hit", F.get(hits, F.lit(0)))
        label, ident = _text("$.aLabel", "hit"), _text("$['@id']", "hit")
        return _result(df, "Library of Congress", "authority_file", authority, F.col("hit").isNotNull(),
                       title=F.coalesce(label, ident), url=ident, relevance=query_coverage(q, label))
    if source == "google":
        review = "$.claims[0].claimReview[0]"
        publisher = F.coalesce(_text(f"{review}.publisher.name"), F.lit("Unknown"))
        found = _has("$.claims")
        name = F.when(found, F.concat(F.lit("Fact Check ("), publisher, F.lit(")"))).otherwise("Google Fact Check")
        return _result(df, name, "fact_check", factcheck, found, title=F.coalesce(_text("$.claims[0].text"), F.lit("")),
                       url=_text(f"{review}.url"), extract=F.coalesce(_text(f"{review}.title"), F.lit("")),
                       claim_review=_text(f"{review}.title"), rating=F.coalesce(_text(f"{review}.textualRating"), F.lit("")),
                       relevance=F.lit(0.9))
    if source == "claimbuster":
        scored = F.transform(_list("$.results"), lambda r, i: F.struct(
            F.coalesce(F.try_variant_get(r, "$.score", "double"), F.lit(0.0)).alias("score"), (-i).alias("neg"),
            F.try_variant_get(r, "$.text", "string").alias("text")))
        df = df.withColumn("best", F.array_max(scored))
        score = F.col("best.score")
        band = F.when(score > 0.7, "Highly check-worthy claim").when(score > 0.5, "Moderately check-worthy claim").otherwise(
            "Low check-worthiness")
        return _result(df, "ClaimBuster", "fact_check", factcheck, _has("$.results"), title=F.coalesce("best.text", q),
                       extract=F.concat(F.lit("Check-worthiness score: "), F.format_number(score, 2), F.lit(" - "), band),
                       relevance=score)
    if source == "crossref":
        item = "$.message.items[0]"
        people = _list(f"{item}.author")
        names = F.transform(people, lambda a: F.concat_ws(" ", F.coalesce(F.try_variant_get(a, "$.given", "string"), F.lit("")),
                                                          F.coalesce(F.try_variant_get(a, "$.family", "string"), F.lit(""))))
        authors = F.when(F.size(people) > 0, F.array_join(names, ", ")).otherwise("Unknown")
        year = F.coalesce(_text(f"{item}['published-print']['date-parts'][0][0]"), F.lit("Unknown"))
        doi = F.nullif(_text(f"{item}.DOI"), F.lit(""))
        return _result(df, "CrossRef (Academic)", "academic", academic, _has("$.message.items"),
                       title=F.coalesce(_text(f"{item}.title[0]"), F.lit("No title")), url=F.concat(F.lit("https://doi.org/"), doi),
                       extract=F.concat(F.lit("Authors: "), authors, F.lit(" | Published: "), year),
                       relevance=F.coalesce(F.try_variant_get("v", f"{item}.score", "double"), F.lit(0.0)) / 100)
    if source == "openlibrary":
        listed = F.try_variant_get("v", "$.docs[0].author_name", "array<string>")
        authors = F.coalesce(F.array_join(listed, ", "), F.lit("Unknown"))
        key = F.nullif(_text("$.docs[0].key"), F.lit(""))
        return _result(df, "Open Library", "academic", academic, _has("$.docs"), title=F.coalesce(_text("$.docs[0].title"), F.lit("")),
                       url=F.concat(F.lit("https://openlibrary.org"), key), relevance=F.lit(0.7),
                       extract=F.concat(F.lit("Author: "), authors, F.lit(" | Year: "),
                                        F.coalesce(_text("$.docs[0].first_publish_year"), F.lit("Unknown"))))
    raise ValueError(f"unknown source {source!r}")


SOURCE_NAMES = ["gnd", "viaf", "loc", "google", "claimbuster", "crossref", "openlibrary"]

# ---- pluggable sources -------------------------------------------------------------------------
_REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "gnd": ingest_gnd, "viaf": ingest_viaf, "loc": ingest_loc, "getty_tgn": lambda raw: ingest_getty(raw, "tgn"),
    "getty_ulan": lambda raw: ingest_getty(raw, "ulan"),
}


def register_source(name: str, ingest: Callable[[DataFrame], DataFrame]) -> None:
    """Add or replace a source: a function from a raw payload table to authority records."""
    _REGISTRY[name] = ingest


def registered_sources() -> list[str]:
    return list(_REGISTRY)


def ingest(name: str, raw: DataFrame) -> DataFrame:
    return _REGISTRY[name](raw)


def search_records(records: DataFrame, query: str, entity_type: str | None = None, limit: int = 10) -> DataFrame:
    """Records whose name or a variant holds the query text, ignoring case."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("name"), q) | F.exists("name_variants", lambda n: F.contains(F.lower(n), q))
    df = records.filter(hit)
    return (df.filter(F.col("entity_type") == entity_type) if entity_type else df).orderBy("ordinal").limit(limit)


def get_records(records: DataFrame, *authority_ids: str) -> DataFrame:
    """The records with these ids, of all sources."""
    return records.filter(F.col("authority_id").isin(list(authority_ids)))
