"""Source records to domain tables: a mapper a source, written as column expressions, and one plan a table.

A record is (source_name, source_id, ts, quality, payload as JSON text). The payload is parsed once into a map of
texts; a table's rows are an array that only the record's own mapper fills, exploded. Adding a source means adding
expressions, so a table of any number of sources is still one scan.

Defined results: a payload that is null or no JSON object has no keys; a key that is missing takes the mapper's
default, a key that is null stays null; values that are no numbers are null, and series rows without a value go.
"""

from __future__ import annotations

from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewright.operators.records import uuid5

SERIES = "code string, name string, value double, unit string, commodity string, country string"
ENTITIES = "id string, entity_type string, name string, identifier string, country string, sector string, status string"
FLOWS = "flow_type string, amount double, currency string, commodity string, purpose string, source_entity_id string, dest_entity_id string"
EVENTS = "event_type string, name string, description string, severity string, economic_impact double"
ASSESSMENTS = "entity_id string, assessor string, metric_code string, score_numeric double, score_category string"
RELATIONSHIPS = "source_entity_id string, dest_entity_id string, relationship_type string, status string"
TABLES = {"time_series": SERIES, "entities": ENTITIES, "flows": FLOWS, "events": EVENTS, "assessments": ASSESSMENTS, "relationships": RELATIONSHIPS}


def p(key: str, default: str | None = None) -> Column:
    """The payload's value under the key as text."""
    value = F.try_element_at("p", F.lit(key))
    return value if default is None else F.when(F.map_contains_key("p", F.lit(key)), value).otherwise(default)


def number(key: str) -> Column:
    return p(key).try_cast("double")


def first_of(*texts: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def entity_id(source: str, key: Column) -> Column:
    return uuid5(F.concat(F.lit(f"entity:{source}:"), key))


def row(schema: str, where: Column | None = None, **values: Column | str | None) -> Column:
    """A row of a table as a struct, null if ``where`` does not hold."""
    fields = [x.strip().split(" ") for x in schema.split(",")]
    cell = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.struct(*[cell(values.get(name)).cast(kind).alias(name) for name, kind in fields])
    return out if where is None else F.when(where, out)


def series(value: str, code: Column, name: Column | None = None, where: Column | None = None, **more: Column | str | None) -> Column:
    v = number(value)
    return row(SERIES, v.isNotNull() if where is None else where & v.isNotNull(), code=code, name=name, value=v, **more)


def entity(source: str, kind: str, key: Column, name: Column, where: Column | None = None, **more: Column | str | None) -> Column:
    return row(ENTITIES, where, id=entity_id(source, key), entity_type=kind, name=name, **more)


def coded(prefix: str, *parts: Column | str) -> Column:
    return F.concat(F.lit(prefix), *[x if isinstance(x, Column) else F.lit(x) for x in parts])


@cache
def mappers(application: str) -> dict[str, dict[str, list[Column]]]:
    """Source to its tables' rows. Columns belong to a running application, so each has its own."""
    out: dict[str, dict[str, list[Column]]] = {}

    def mapper(*sources: str, **tables: list[Column]) -> None:
        for s in sources:
            out[s] = tables

    # One series row a record.
    mapper("World Bank WDI", time_series=[series("value", p("indicator_code"), p("indicator_name"), unit=p("unit"), country=p("country_code"))])
    mapper("FRED", time_series=[series("value", p("series_id"), p("series_name"))])
    mapper("Eurostat", time_series=[series("value", p("dataset"), p("dataset_name"), country=p("country_code"))])
    mapper("UNCTAD", "UNCTAD via UNdata", time_series=[series("value", p("indicator"), p("indicator_name"), unit=p("unit"), country=p("country"))])
    mapper("IMF PCPS", time_series=[series("value", p("commodity_code"), p("commodity_name"), unit=p("unit", "index"), commodity=p("commodity_name"))])
    mapper("ILO ILOSTAT", time_series=[series("value", p("indicator"), p("sector_name"), country=p("country"))])
    mapper("OECD", time_series=[series("value", p("dataset"), p("dataset_name"), country=p("country"))])
    mapper("SSB Norway", time_series=[series("value", p("table"), p("table_name"), commodity="salmon", country="NO")])
    mapper("EUMOFA", time_series=[series("price", p("category"), p("category_name"), unit=p("unit", "EUR/kg"), commodity=p("species"), country=p("country"))])
    mapper("Shanghai Shipping Exchange", time_series=[series("value", p("index_code"), p("index_name"), unit="index", country="CN")])
    mapper("Bunker Index", time_series=[series("price_usd_mt", p("fuel_type"), p("fuel_name"), unit="USD/mt", commodity=p("fuel_name"))])
    mapper("OilPriceAPI", time_series=[series("price_usd", p("product_code"), p("product_name"), unit=p("unit", "per barrel"), commodity=p("product_name"))])
    mapper("USDA AgTransport", time_series=[series("price_usd", coded("usda-bunker-", p("fuel_type")), p("fuel_type"), unit=p("unit", "USD/mt"), commodity=p("fuel_type"), country="US")])

    # Several series rows a record, or rows by the record's type.
    SECTOR = p("sector", "unknown")
    mapper("NOAA ENOW", time_series=[series(m, coded("enow-", SECTOR, f"-{m}"), F.concat(SECTOR, F.lit(f" {m}")), unit=u, country="US") for m, u in (("gdp", "USD"), ("employment", "jobs"), ("wages", "USD"), ("establishments", "count"))])
    mapper(
        "NOAA FOSS",
        time_series=[
            series("dollars", coded("foss-landings-", p("species")), p("species"), p("type") == "landings", unit="USD", commodity=p("species"), country="US"),
            series("dollars", coded("foss-trade-", p("product")), p("product"), p("type") == "foreign_trade", unit="USD", commodity=p("product"), country=p("country")),
        ],
    )
    mapper(
        "FEMA NFIP",
        time_series=[series("total_paid", F.lit("nfip-claims"), F.lit("NFIP Flood Claim Payout"), p("type") == "flood_claim", unit="USD", country="US")],
        events=[
            row(EVENTS, p("type") == "flood_claim", event_type="flood_claim", name=coded("NFIP flood claim ", p("state", "")), description=p("cause_of_damage"), economic_impact=number("total_paid")),
            row(EVENTS, p("type") == "flood_policy", event_type="flood_policy", name=coded("NFIP policy ", p("state", "")), economic_impact=number("total_coverage")),
        ],
    )

    # Stars: entities with the flows and series between them.
    PARTNER, USD = p("partner_name", "unknown"), number("value_usd").isNotNull()
    US_ID, PARTNER_ID = entity_id("USDA GATS", F.lit("country-US")), entity_id("USDA GATS", F.concat(F.lit("country-"), PARTNER))
    OUT = F.lower(p("flow", "export")).isin("export", "re-export")
    mapper(
        "USDA GATS",
        time_series=[series("value_usd", coded("gats-", p("hs_code")), p("commodity"), unit="USD", commodity=p("commodity"), country=p("partner_name"))],
        entities=[
            entity("USDA GATS", "country", F.lit("country-US"), F.lit("United States"), USD, identifier="US", country="US", sector="trade"),
            entity("USDA GATS", "country", F.concat(F.lit("country-"), PARTNER), PARTNER, USD, identifier=PARTNER, country=p("partner_code"), sector="trade"),
        ],
        flows=[row(FLOWS, USD, flow_type=p("flow"), amount=number("value_usd"), currency="USD", commodity=p("commodity"), source_entity_id=F.when(OUT, US_ID).otherwise(PARTNER_ID), dest_entity_id=F.when(OUT, PARTNER_ID).otherwise(US_ID))],
    )

    def first_in(key: str) -> Column:
        """The first element of a list, or the value itself."""
        whole = p(key)
        return F.when(whole.startswith("["), F.get_json_object(whole, "$[0]")).otherwise(whole)

    def of_list(key: str) -> Column:
        return F.when(p(key).startswith("["), F.get_json_object(p(key), "$[0]"))

    def funded(source: str, org: str, to: Column, to_sector: str, kind: str, amount: str, currency: Column, **about: Column) -> None:
        """An organisation that pays a country."""
        name, there = p(org, "unknown"), F.nullif(to, F.lit("")).isNotNull()
        own, other = F.concat(F.lit("org-"), name), F.concat(F.lit("country-"), to)
        mapper(
            source,
            entities=[entity(source, "organization", own, name, **about), entity(source, "country", other, to, there, identifier=to, country=to, sector=to_sector)],
            flows=[row(FLOWS, number(amount).isNotNull(), flow_type=kind, amount=number(amount), currency=currency, purpose=p("title"), source_entity_id=entity_id(source, own), dest_entity_id=F.when(there, entity_id(source, other)))],
        )

    funded("IATI", "reporting_org", first_in("recipient_country"), "development", "development_aid", "total_value", p("currency", "USD"), identifier=p("iati_identifier"), country=of_list("recipient_country"), sector=of_list("sector_codes"), status=p("status"))
    funded("Green Climate Fund", "entity", first_in("country"), "climate", "climate_finance", "gcf_amount_usd", F.lit("USD"), country=first_in("country"), sector=p("sector"), status=p("status"))

    FISHER, HAS_VALUE = p("dimension", "unknown") == "country", number("value").isNotNull()
    SAU_NAME = p("entity_name", "unknown")
    mapper(
        "Sea Around Us",
        time_series=[series("value", coded("sau-", p("region_type", "unknown"), "-", p("dimension", "unknown")), SAU_NAME, unit=p("unit"), commodity=F.when(p("dimension").isin("taxon", "commercialgroup"), p("entity_name")))],
        entities=[entity("Sea Around Us", "country", F.concat(F.lit("country-"), SAU_NAME), SAU_NAME, HAS_VALUE & FISHER, identifier=SAU_NAME, sector="fisheries")],
        flows=[row(FLOWS, HAS_VALUE & FISHER, flow_type="catch", amount=number("value"), purpose=F.concat(p("region_type", "unknown"), F.lit(" "), p("measure", "")), source_entity_id=entity_id("Sea Around Us", F.concat(F.lit("country-"), SAU_NAME)))],
    )
    FAO, LAND = "FAO FishStatJ", F.nullif(p("country"), F.lit(""))
    mapper(
        FAO,
        time_series=[series("value", coded("fishstat-", p("dataset", "unknown")), F.coalesce(first_of(p("species"), p("indicator_name")), p("dataset_name", "")), unit=p("unit"), commodity=p("species"), country=p("country"))],
        entities=[entity(FAO, "country", F.concat(F.lit("country-"), LAND), LAND, HAS_VALUE & LAND.isNotNull(), identifier=LAND, country=LAND, sector="fisheries")],
        flows=[row(FLOWS, HAS_VALUE & (p("dataset") == "commodities"), flow_type="fish_trade", amount=number("value"), commodity=p("species"), source_entity_id=entity_id(FAO, F.concat(F.lit("country-"), LAND)))],
    )

    # Entities with assessments.
    def rated(source: str, kind: str, key: Column, name: Column, assessor: str, scores: dict[str, str], rank: str | None = None, **about: Column | str) -> None:
        """``scores``: a payload key to its metric code; ``rank`` is the key whose row carries the rank."""
        own = entity_id(source, key)
        category = lambda k: p("rank") if k == rank else None
        mapper(
            source,
            entities=[entity(source, kind, key, name, **about)],
            assessments=[row(ASSESSMENTS, number(k).isNotNull(), entity_id=own, assessor=assessor, metric_code=code, score_numeric=number(k), score_category=category(k)) for k, code in scores.items()],
        )

    PROJECT = F.coalesce(F.when(F.map_contains_key("p", F.lit("project_id")), p("project_id")).otherwise(F.col("source_id")), F.lit("None"))
    rated("Verra VCS / CAD Trust", "project", F.concat(F.lit("project-"), PROJECT), F.when(F.map_contains_key("p", F.lit("name")), p("name")).otherwise(PROJECT), "Verra", {k: k for k in ("credits_issued", "credits_retired", "credits_available")}, identifier=PROJECT, country=p("country"), sector="carbon_credits", status=p("status"))
    rated("WBA Seafood Stewardship Index", "company", F.concat(F.lit("company-"), p("company_name", "unknown")), p("company_name", "unknown"), "WBA", {f"{k}_score": f"seafood_{k}" for k in ("total", "governance", "ecosystems", "traceability", "social")}, "total_score", country=p("country"), sector=p("sector"))
    NATION = p("country_code", "XX")
    rated("IUU Fishing Index", "country", F.concat(F.lit("country-"), NATION), F.when(F.map_contains_key("p", F.lit("country_name")), p("country_name")).otherwise(NATION), "IUU Fishing Index", {f"{k}_score": f"iuu_{k}" for k in ("overall", "coastal", "flag", "port", "market")}, "overall_score", identifier=NATION, country=NATION)
    STOCK, DETAIL = p("stock_code", "unknown"), F.map_contains_key("p", F.lit("fishing_mortality"))
    STOCK_ID = entity_id("ICES SAG", F.concat(F.lit("stock-"), STOCK))
    STOCK_UNITS = {"ssb": "tonnes", "fishing_mortality": "F", "recruitment": "thousands", "catches": "tonnes", "landings": "tonnes", "discards": "tonnes"}
    mapper(
        "ICES SAG",
        time_series=[series(m, coded("ices-", STOCK, f"-{m}"), F.concat(STOCK, F.lit(f" {m}")), DETAIL, unit=u, commodity=STOCK) for m, u in STOCK_UNITS.items()],
        entities=[entity("ICES SAG", "fish_stock", F.concat(F.lit("stock-"), STOCK), STOCK, identifier=STOCK, country=p("ecoregion"), sector="fisheries", status=p("stock_status"))],
        assessments=[row(ASSESSMENTS, entity_id=STOCK_ID, assessor="ICES", metric_code=F.when(DETAIL, "stock_status").otherwise("stock_advice"), score_category=F.when(DETAIL, p("stock_status")).otherwise(p("advice_status")))],
    )
    BIOME = p("biome", "unknown")
    mapper(
        "ESVD",
        entities=[entity("ESVD", "ecosystem", F.concat(F.lit("biome-"), BIOME), BIOME, identifier=BIOME, country=p("country"), sector="ecosystem_services")],
        assessments=[row(ASSESSMENTS, entity_id=entity_id("ESVD", F.concat(F.lit("biome-"), BIOME)), assessor="ESVD", metric_code=p("service_type", "unknown"), score_numeric=number("value_per_ha_year"), score_category=p("confidence"))],
    )

    # Entities with the company that runs them.
    def operated(source: str, kind: str, key: Column, name: Column, by: str, by_key: str, relation: str, home: Column | str, by_sector: Column | str, **about: Column | str) -> None:
        company = F.nullif(p(by), F.lit(""))
        other = F.concat(F.lit(f"{by_key}-"), company)
        mapper(
            source,
            entities=[entity(source, kind, key, name, country=home, status=p("status"), **about), entity(source, "company", other, company, company.isNotNull(), country=home, sector=by_sector)],
            relationships=[row(RELATIONSHIPS, company.isNotNull(), source_entity_id=entity_id(source, other), dest_entity_id=entity_id(source, key), relationship_type=relation, status=p("status"))],
        )

    def named(key: str) -> Column:
        return F.when(F.map_contains_key("p", F.lit(key)), p(key)).otherwise(F.col("source_id"))

    LAYER = p("layer", "unknown")
    operated("BOEM", "infrastructure", F.concat(LAYER, F.lit("-"), named("lease_number")), F.coalesce(F.nullif(p("lease_number"), F.lit("")), named("area_name")), "company", "operator", "operates", "US", LAYER, identifier=p("lease_number"), sector=LAYER)
    operated("Crown Estate UK", "infrastructure", F.concat(LAYER, F.lit("-"), named("name")), named("name"), "operator", "operator", "operates", "GB", LAYER, sector=LAYER)
    operated("OSPAR", "infrastructure", F.concat(F.lit("installation-"), named("name")), named("name"), "operator", "operator", "operates", p("country"), "offshore", sector=p("type", "offshore_installation"))
    operated("ISA DeepData", "contract", F.concat(F.lit("contract-"), named("area_name")), named("area_name"), "contractor", "contractor", "contractor", p("sponsoring_state"), "deep_sea_mining", identifier=F.col("source_id"), sector=p("mineral_type"))

    # Observations.
    def observed(source: str, kind: str, sector: str, names: tuple[str, ...], unknown: str, as_source: str | None = None, **more: Column | str) -> None:
        own = as_source or source
        mapper(source, entities=[entity(own, kind, F.col("source_id"), F.coalesce(first_of(*map(p, names)), F.lit(unknown)), sector=sector, **more)])

    def measured(source: str, keys: tuple[str, ...], code: Column, name: Column, unit: Column | str) -> None:
        """The first of the keys that is there and not zero, or the last one if it is there."""
        values = [number(k) for k in keys]
        value = F.coalesce(*[F.nullif(v, F.lit(0.0)) for v in values[:-1]], values[-1])
        mapper(source, time_series=[row(SERIES, value.isNotNull(), code=code, name=name, value=value, unit=unit)])

    STATION, WAVES = p("station_id", "unknown"), F.nullif(number("wave_height"), F.lit(0.0)).isNotNull()
    observed("OBIS", "species_observation", "biodiversity", ("scientific_name", "species"), "Unknown")
    observed("GBIF", "species_observation", "biodiversity", ("scientific_name", "species"), "Unknown", country=p("country"))
    observed("InterRidge", "hydrothermal_vent", "geology", ("name", "site_name"), "Unknown Vent")
    observed("NOAA Wrecks & Obstructions", "shipwreck", "maritime_heritage", ("vesselname", "name"), "Unknown Wreck", "NOAA Wrecks")
    observed("Marine Regions", "marine_region", "geography", ("name", "preferredGazetteerName"), "Unknown Region", identifier=F.coalesce(first_of(p("mrgid"), p("MRGID")), F.lit("")))
    observed("WoRMS", "taxon", "taxonomy", ("scientificname", "scientific_name"), "Unknown Taxon", identifier=p("AphiaID", ""))
    observed("OpenSanctions", "sanctioned_entity", "compliance", ("name", "caption"), "Unknown Entity", country=p("country"), status="sanctioned")
    measured("NOAA CO-OPS", ("value", "water_level"), coded("coops-", STATION, "-water_level"), p("station_name", "NOAA CO-OPS Station"), "meters")
    measured("PSMSL", ("rlr", "sea_level", "metric"), coded("psmsl-", STATION, "-sea_level"), p("station_name", "PSMSL Station"), "mm")
    WAVE_OR_WIND = F.when(WAVES, "wave_height").otherwise("wind_speed")
    measured("NDBC", ("wave_height", "wind_speed"), coded("ndbc-", STATION, "-", WAVE_OR_WIND), F.concat(F.lit("NDBC "), WAVE_OR_WIND), F.when(WAVES, "meters").otherwise("m/s"))
    mapper("Climate Indices", time_series=[series("value", p("index_name", "climate_index"), p("index_name", "Climate Index"), unit="index")])
    MAGNITUDE = number("magnitude")
    mapper(
        "USGS Earthquakes",
        events=[row(EVENTS, event_type="earthquake", name=F.when(F.map_contains_key("p", F.lit("title")), p("title")).otherwise(F.concat(F.lit("M"), F.coalesce(p("magnitude"), F.lit("None")), F.lit(" Earthquake"))), description=p("place", ""), severity=F.when(MAGNITUDE >= 5, "high").when(MAGNITUDE >= 3, "medium").when(MAGNITUDE.isNotNull(), "low"))],
    )
    mapper("NOAA Storm Events", events=[row(EVENTS, event_type=p("event_type", "storm"), name=p("event_type", "Storm Event"), description=p("event_narrative", ""), severity=p("magnitude_type", "medium"), economic_impact=number("damage_property"))])

    return out


def mappers_of(df: DataFrame) -> dict[str, dict[str, list[Column]]]:
    return mappers(df.sparkSession.sparkContext.applicationId)


def parsed(records: DataFrame) -> DataFrame:
    """The records with their payload as a map ``p``."""
    return records.withColumn("p", F.coalesce(F.from_json("payload", "map<string,string>"), F.create_map().cast("map<string,string>")))


def dispatch(records: DataFrame, table: str, sources: list[str] | None = None) -> DataFrame:
    """The rows that the records' mappers make for a table, with the record's source_name, source_id and ts."""
    schema = TABLES[table]
    rows = F.array().cast(f"array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in schema.split(','))}>>")
    makers = [(s, m[table]) for s, m in mappers_of(records).items() if table in m and (sources is None or s in sources)]
    made = reduce(lambda c, x: c.when(F.col("source_name") == x[0], F.array_compact(F.array(*x[1]))), makers, F.when(F.lit(False), rows)).otherwise(rows)
    # Sources without a mapper for the table are passed over before their payload is read.
    some = parsed(records.where(F.col("source_name").isin([s for s, _ in makers])))
    return some.select("source_name", "source_id", "ts", F.explode(made).alias("x")).select(F.col("source_name"), F.col("source_id").alias("record_id"), "ts", "x.*")


def unmapped(records: DataFrame) -> DataFrame:
    """Records whose source has no mapper."""
    return records.where(F.coalesce(~F.col("source_name").isin(list(mappers_of(records))), F.lit(True)))


GENERIC_NAMES = ("name", "title", "station_name", "scientific_name", "species", "vesselname")


def generic(records: DataFrame, kind: str = "observation") -> DataFrame:
    """An entity for each record, named by the first of six keys, else by its source and id."""
    source, key = F.coalesce("source_name", F.lit("unknown")), F.col("source_id")
    name = F.coalesce(first_of(*map(p, GENERIC_NAMES)), F.concat(source, F.lit(" #"), F.substring(key, 1, 20)))
    values = {"id": uuid5(F.concat(F.lit("entity:"), source, F.lit(":"), key)), "entity_type": kind, "name": F.substring(name, 1, 255), "identifier": F.substring(key, 1, 255), "country": p("country")}
    return parsed(records).select("source_name", F.col("source_id").alias("record_id"), "ts", row(ENTITIES, **values).alias("x")).select("source_name", "record_id", "ts", "x.*")


def all_entities(records: DataFrame) -> DataFrame:
    """Entities of mapped and unmapped sources, one of each id: that of the last record."""
    rows = dispatch(records, "entities").unionByName(generic(unmapped(records)))
    last = W.partitionBy("id").orderBy(F.desc("ts"), F.desc("record_id"), F.desc("name"))
    return rows.withColumn("rank", F.row_number().over(last)).where("rank = 1").drop("rank")


def promoted(records: DataFrame, known: DataFrame) -> DataFrame:
    """The entities that the records make and that ``known`` (id) has not."""
    return all_entities(records).join(known.select("id"), "id", "left_anti")
