"""Record mapping and dispatch queries with the SQL that checks them.

The records are made of the line items: every payload key has a text or a number that follows from the line's number,
and is missing now and then, so that defaults and gaps are met. The SQL says per source what the table must hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.common import table
from tidewright.operators import mapping as M

QUERIES, ORACLES = {}, {}

TEXTS = (
    "indicator_code indicator_name unit country_code series_id series_name dataset dataset_name indicator country commodity_code commodity_name sector_name table table_name category category_name species "
    "index_code index_name fuel_type fuel_name product_code product_name sector product state cause_of_damage partner_name partner_code hs_code commodity reporting_org iati_identifier status currency title entity "
    "region_type entity_name measure project_id name company_name rank country_name stock_code ecoregion stock_status advice_status biome service_type confidence layer lease_number area_name company operator "
    "contractor sponsoring_state mineral_type scientific_name site_name vesselname preferredGazetteerName mrgid MRGID scientificname AphiaID caption station_id station_name place event_narrative event_type magnitude_type"
).split()
NUMBERS = (
    "value price price_usd_mt price_usd gdp employment wages establishments dollars total_paid total_coverage value_usd total_value gcf_amount_usd credits_issued credits_retired credits_available total_score "
    "governance_score ecosystems_score traceability_score social_score overall_score coastal_score flag_score port_score market_score ssb fishing_mortality recruitment catches landings discards value_per_ha_year "
    "water_level rlr sea_level metric wave_height wind_speed magnitude damage_property"
).split()
CHOICES = {"type": ["landings", "foreign_trade", "flood_claim", "flood_policy"], "flow": ["Export", "import", "re-export"], "dimension": ["country", "taxon", "eez"]}
SOURCES = [
    "World Bank WDI", "FRED", "Eurostat", "UNCTAD", "IMF PCPS", "ILO ILOSTAT", "OECD", "SSB Norway", "EUMOFA", "Shanghai Shipping Exchange", "Bunker Index", "OilPriceAPI", "USDA AgTransport", "NOAA ENOW", "NOAA FOSS",
    "FEMA NFIP", "USDA GATS", "IATI", "Green Climate Fund", "Sea Around Us", "FAO FishStatJ", "Verra VCS / CAD Trust", "WBA Seafood Stewardship Index", "IUU Fishing Index", "ICES SAG", "ESVD", "BOEM", "Crown Estate UK",
    "OSPAR", "ISA DeepData", "OBIS", "GBIF", "InterRidge", "NOAA Wrecks & Obstructions", "Marine Regions", "WoRMS", "OpenSanctions", "NOAA CO-OPS", "PSMSL", "NDBC", "Climate Indices", "USGS Earthquakes",
    "NOAA Storm Events", "Some other source",
]


def records(s: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    li = table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.col("l_shipdate").alias("ts"), F.col("l_quantity").cast("double").alias("qty"))
    fields = [F.when((k + i) % 4 != 0, F.concat(F.lit(f"{key}-"), (k % 3).cast("string"))).alias(key) for i, key in enumerate(TEXTS)]
    fields += [F.when((k + i) % 5 != 0, F.when((k + i) % 7 == 0, 0.0).otherwise(F.col("qty") + i)).alias(key) for i, key in enumerate(NUMBERS)]
    fields += [F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int")).alias(key) for key, v in CHOICES.items()]
    fields += [F.when(k % 4 != 0, F.array(F.concat(F.lit("land-"), (k % 5).cast("string")), F.lit("x"))).alias("recipient_country"), F.when(k % 3 != 0, F.array(F.lit("311"))).alias("sector_codes")]
    source = F.element_at(F.array(*map(F.lit, SOURCES)), (F.floor(k / 3) % len(SOURCES) + 1).cast("int"))
    return li.select(source.alias("source_name"), F.concat(F.lit("r"), k.cast("string")).alias("source_id"), "ts", F.to_json(F.struct(*fields)).alias("payload"))


SOURCE_SQL = f"[{', '.join(chr(39) + x + chr(39) for x in SOURCES)}][k // 3 % {len(SOURCES)} + 1]"
VIEW = f"r AS (SELECT k, 'r' || k AS record_id, ts, qty, {SOURCE_SQL} AS source_name FROM (SELECT l_orderkey * 10 + l_linenumber AS k, l_shipdate AS ts, l_quantity::DOUBLE AS qty FROM lineitem))"


def t(key: str, default: str | None = None) -> str:
    if key in CHOICES:
        return f"[{', '.join(chr(39) + x + chr(39) for x in CHOICES[key])}][k % {len(CHOICES[key])} + 1]"
    value = f"CASE WHEN (k + {TEXTS.index(key)}) % 4 <> 0 THEN '{key}-' || (k % 3) END"
    return value if default is None else f"coalesce({value}, '{default}')"


def n(key: str) -> str:
    i = NUMBERS.index(key)
    return f"CASE WHEN (k + {i}) % 5 <> 0 THEN CASE WHEN (k + {i}) % 7 = 0 THEN 0.0 ELSE qty + {i} END END"


def uid(source: str, key: str) -> str:
    h = f"sha1(unhex('{'6ba7b8119dad11d180b400c04fd430c8'}') || encode('entity:{source}:' || {key}))"
    return (
        f"(SELECT substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab89ab89ab89ab', strpos('0123456789abcdef', "
        f"substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) FROM (SELECT {h} AS h))"
    )


LAND = "CASE WHEN k % 4 <> 0 THEN 'land-' || (k % 5) END"


def quoted(x: str | None) -> str:
    return "NULL" if x is None else f"'{x}'"


def rows(schema: str, parts: list[tuple[str, dict[str, str], str]]) -> str:
    """UNION ALL of (source, column to expression, condition)."""
    names = [x.strip().split(" ") for x in schema.split(",")]
    one = lambda source, of, where: (
        f"SELECT source_name, record_id, ts, {', '.join(f'CAST({of.get(c, chr(78) + chr(85) + chr(76) + chr(76))} AS {kind}) AS {c}' for c, kind in names)} FROM "
        f"r WHERE source_name = '{source}' AND {where}"
    )
    return f"WITH {VIEW} " + " UNION ALL ".join(one(s, {c: v.replace("string", "VARCHAR") for c, v in of.items()}, w) for s, of, w in parts).replace(" AS string)", " AS VARCHAR)")


def value_part(source, code, name, value="value", unit="NULL", commodity="NULL", country="NULL"):
    return source, {"code": code, "name": name, "value": n(value), "unit": unit, "commodity": commodity, "country": country}, f"({n(value)}) IS NOT NULL"


VALUES = [
    value_part("World Bank WDI", t("indicator_code"), t("indicator_name"), unit=t("unit"), country=t("country_code")),
    value_part("FRED", t("series_id"), t("series_name")),
    value_part("Eurostat", t("dataset"), t("dataset_name"), country=t("country_code")),
    value_part("UNCTAD", t("indicator"), t("indicator_name"), unit=t("unit"), country=t("country")),
    value_part("IMF PCPS", t("commodity_code"), t("commodity_name"), unit=t("unit", "index"), commodity=t("commodity_name")),
    value_part("ILO ILOSTAT", t("indicator"), t("sector_name"), country=t("country")),
    value_part("OECD", t("dataset"), t("dataset_name"), country=t("country")),
    value_part("SSB Norway", t("table"), t("table_name"), commodity="'salmon'", country="'NO'"),
    value_part("EUMOFA", t("category"), t("category_name"), "price", t("unit", "EUR/kg"), t("species"), t("country")),
    value_part("Shanghai Shipping Exchange", t("index_code"), t("index_name"), unit="'index'", country="'CN'"),
    value_part("Bunker Index", t("fuel_type"), t("fuel_name"), "price_usd_mt", "'USD/mt'", t("fuel_name")),
    value_part("OilPriceAPI", t("product_code"), t("product_name"), "price_usd", t("unit", "per barrel"), t("product_name")),
    value_part("USDA AgTransport", f"'usda-bunker-' || {t('fuel_type')}", t("fuel_type"), "price_usd", t("unit", "USD/mt"), t("fuel_type"), "'US'"),
]
ENOW = [value_part("NOAA ENOW", f"'enow-' || {t('sector', 'unknown')} || '-{m}'", f"{t('sector', 'unknown')} || ' {m}'", m, f"'{u}'", country="'US'") for m, u in (("gdp", "USD"), ("employment", "jobs"), ("wages", "USD"), ("establishments", "count"))]


def only(part, condition):
    return part[0], part[1], f"{part[2]} AND {condition}"


BY_TYPE = [
    only(value_part("NOAA FOSS", f"'foss-landings-' || {t('species')}", t("species"), "dollars", "'USD'", t("species"), "'US'"), f"{t('type')} = 'landings'"),
    only(value_part("NOAA FOSS", f"'foss-trade-' || {t('product')}", t("product"), "dollars", "'USD'", t("product"), t("country")), f"{t('type')} = 'foreign_trade'"),
    only(value_part("FEMA NFIP", "'nfip-claims'", "'NFIP Flood Claim Payout'", "total_paid", "'USD'", country="'US'"), f"{t('type')} = 'flood_claim'"),
]
SAU = value_part("Sea Around Us", f"'sau-' || {t('region_type', 'unknown')} || '-' || {t('dimension')}", t("entity_name", "unknown"), unit=t("unit"), commodity=f"CASE WHEN {t('dimension')} = 'taxon' THEN {t('entity_name')} END")
STARS = [
    value_part("USDA GATS", f"'gats-' || {t('hs_code')}", t("commodity"), "value_usd", "'USD'", t("commodity"), t("partner_name")),
    SAU,
    value_part("FAO FishStatJ", f"'fishstat-' || {t('dataset', 'unknown')}", f"coalesce({t('species')}, {t('indicator_name')}, {t('dataset_name')}, '')", unit=t("unit"), commodity=t("species"), country=t("country")),
]
UNITS = {"ssb": "tonnes", "fishing_mortality": "F", "recruitment": "thousands", "catches": "tonnes", "landings": "tonnes", "discards": "tonnes"}
ICES = [only(value_part("ICES SAG", f"'ices-' || {t('stock_code', 'unknown')} || '-{m}'", f"{t('stock_code', 'unknown')} || ' {m}'", m, f"'{u}'", t("stock_code", "unknown")), f"({n('fishing_mortality')}) IS NOT NULL") for m, u in UNITS.items()]


def measured_part(source, values, code, name, unit):
    value = f"coalesce({', '.join([f'nullif({n(v)}, 0)' for v in values[:-1]] + [n(values[-1])])})"
    return source, {"code": code, "name": name, "value": value, "unit": unit}, f"{value} IS NOT NULL"


WAVE = f"coalesce({n('wave_height')}, 0) <> 0"
STATION = t("station_id", "unknown")
OBSERVED = [
    measured_part("NOAA CO-OPS", ["value", "water_level"], f"'coops-' || {STATION} || '-water_level'", t("station_name", "NOAA CO-OPS Station"), "'meters'"),
    measured_part("PSMSL", ["rlr", "sea_level", "metric"], f"'psmsl-' || {STATION} || '-sea_level'", t("station_name", "PSMSL Station"), "'mm'"),
    measured_part("NDBC", ["wave_height", "wind_speed"], f"'ndbc-' || {STATION} || CASE WHEN {WAVE} THEN '-wave_height' ELSE '-wind_speed' END", f"CASE WHEN {WAVE} THEN 'NDBC wave_height' ELSE 'NDBC wind_speed' END", f"CASE WHEN {WAVE} THEN 'meters' ELSE 'm/s' END"),
    value_part("Climate Indices", t("index_name", "climate_index"), t("index_name", "Climate Index"), unit="'index'"),
]


def ent(source, kind, key, name, where="true", id_source=None, **more):
    of = {"id": uid(id_source or source, key), "entity_type": f"'{kind}'", "name": name, **more}
    return source, of, where


def seen(source, kind, sector, names, unknown, id_source=None, **more):
    return ent(source, kind, "record_id", f"coalesce({', '.join(map(t, names))}, '{unknown}')", id_source=id_source, sector=f"'{sector}'", **more)


PARTNER, USD = t("partner_name", "unknown"), f"({n('value_usd')}) IS NOT NULL"
COUNTRY = "'country-' || "
STAR_ENTITIES = [
    ent("USDA GATS", "country", "'country-US'", "'United States'", USD, identifier="'US'", country="'US'", sector="'trade'"),
    ent("USDA GATS", "country", COUNTRY + PARTNER, PARTNER, USD, identifier=PARTNER, country=t("partner_code"), sector="'trade'"),
    ent("IATI", "organization", f"'org-' || {t('reporting_org', 'unknown')}", t("reporting_org", "unknown"), identifier=t("iati_identifier"), country=LAND, sector="CASE WHEN k % 3 <> 0 THEN '311' END", status=t("status")),
    ent("IATI", "country", COUNTRY + LAND, LAND, f"({LAND}) IS NOT NULL", identifier=LAND, country=LAND, sector="'development'"),
    ent("Green Climate Fund", "organization", f"'org-' || {t('entity', 'unknown')}", t("entity", "unknown"), country=t("country"), sector=t("sector"), status=t("status")),
    ent("Green Climate Fund", "country", COUNTRY + t("country"), t("country"), f"({t('country')}) IS NOT NULL", identifier=t("country"), country=t("country"), sector="'climate'"),
    ent("Sea Around Us", "country", COUNTRY + t("entity_name", "unknown"), t("entity_name", "unknown"), f"({n('value')}) IS NOT NULL AND {t('dimension')} = 'country'", identifier=t("entity_name", "unknown"), sector="'fisheries'"),
    ent("FAO FishStatJ", "country", COUNTRY + t("country"), t("country"), f"({n('value')}) IS NOT NULL AND ({t('country')}) IS NOT NULL", identifier=t("country"), country=t("country"), sector="'fisheries'"),
]
OUT = f"lower({t('flow')}) IN ('export', 're-export')"
US_ID, PARTNER_ID = uid("USDA GATS", "'country-US'"), uid("USDA GATS", COUNTRY + PARTNER)
FLOW_ROWS = [
    ("USDA GATS", {"flow_type": t("flow"), "amount": n("value_usd"), "currency": "'USD'", "commodity": t("commodity"), "source_entity_id": f"CASE WHEN {OUT} THEN {US_ID} ELSE {PARTNER_ID} END", "dest_entity_id": f"CASE WHEN {OUT} THEN {PARTNER_ID} ELSE {US_ID} END"}, USD),
    ("IATI", {"flow_type": "'development_aid'", "amount": n("total_value"), "currency": t("currency", "USD"), "purpose": t("title"), "source_entity_id": uid("IATI", f"'org-' || {t('reporting_org', 'unknown')}"), "dest_entity_id": f"CASE WHEN ({LAND}) IS NOT NULL THEN {uid('IATI', COUNTRY + LAND)} END"}, f"({n('total_value')}) IS NOT NULL"),
    ("Green Climate Fund", {"flow_type": "'climate_finance'", "amount": n("gcf_amount_usd"), "currency": "'USD'", "purpose": t("title"), "source_entity_id": uid("Green Climate Fund", f"'org-' || {t('entity', 'unknown')}"), "dest_entity_id": f"CASE WHEN ({t('country')}) IS NOT NULL THEN {uid('Green Climate Fund', COUNTRY + t('country'))} END"}, f"({n('gcf_amount_usd')}) IS NOT NULL"),
    ("Sea Around Us", {"flow_type": "'catch'", "amount": n("value"), "purpose": f"{t('region_type', 'unknown')} || ' ' || {t('measure', '')}", "source_entity_id": uid("Sea Around Us", COUNTRY + t("entity_name", "unknown"))}, f"({n('value')}) IS NOT NULL AND {t('dimension')} = 'country'"),
]


def scores(source, key, assessor, of, rank=None):
    return [(source, {"entity_id": uid(source, key), "assessor": f"'{assessor}'", "metric_code": f"'{code}'", "score_numeric": n(k), "score_category": t("rank") if k == rank else "NULL"}, f"({n(k)}) IS NOT NULL") for k, code in of.items()]


DETAIL = f"({n('fishing_mortality')}) IS NOT NULL"
PROJECT = f"coalesce({t('project_id')}, record_id)"
RATED = [
    *scores("Verra VCS / CAD Trust", f"'project-' || {PROJECT}", "Verra", {k: k for k in ("credits_issued", "credits_retired", "credits_available")}),
    *scores("WBA Seafood Stewardship Index", f"'company-' || {t('company_name', 'unknown')}", "WBA", {f"{k}_score": f"seafood_{k}" for k in ("total", "governance", "ecosystems", "traceability", "social")}, "total_score"),
    *scores("IUU Fishing Index", COUNTRY + t("country_code", "XX"), "IUU Fishing Index", {f"{k}_score": f"iuu_{k}" for k in ("overall", "coastal", "flag", "port", "market")}, "overall_score"),
    ("ICES SAG", {"entity_id": uid("ICES SAG", f"'stock-' || {t('stock_code', 'unknown')}"), "assessor": "'ICES'", "metric_code": f"CASE WHEN {DETAIL} THEN 'stock_status' ELSE 'stock_advice' END", "score_category": f"CASE WHEN {DETAIL} THEN {t('stock_status')} ELSE {t('advice_status')} END"}, "true"),
    ("ESVD", {"entity_id": uid("ESVD", f"'biome-' || {t('biome', 'unknown')}"), "assessor": "'ESVD'", "metric_code": t("service_type", "unknown"), "score_numeric": n("value_per_ha_year"), "score_category": t("confidence")}, "true"),
]


def run_by(source, key, by, by_key, relation):
    company = t(by)
    return source, {"source_entity_id": uid(source, f"'{by_key}-' || {company}"), "dest_entity_id": uid(source, key), "relationship_type": f"'{relation}'", "status": t("status")}, f"({company}) IS NOT NULL"


OPERATED = [
    run_by("BOEM", f"{t('layer', 'unknown')} || '-' || coalesce({t('lease_number')}, record_id)", "company", "operator", "operates"),
    run_by("Crown Estate UK", f"{t('layer', 'unknown')} || '-' || coalesce({t('name')}, record_id)", "operator", "operator", "operates"),
    run_by("OSPAR", f"'installation-' || coalesce({t('name')}, record_id)", "operator", "operator", "operates"),
    run_by("ISA DeepData", f"'contract-' || coalesce({t('area_name')}, record_id)", "contractor", "contractor", "contractor"),
]
OBSERVED_ENTITIES = [
    seen("OBIS", "species_observation", "biodiversity", ["scientific_name", "species"], "Unknown"),
    seen("GBIF", "species_observation", "biodiversity", ["scientific_name", "species"], "Unknown", country=t("country")),
    seen("InterRidge", "hydrothermal_vent", "geology", ["name", "site_name"], "Unknown Vent"),
    seen("NOAA Wrecks & Obstructions", "shipwreck", "maritime_heritage", ["vesselname", "name"], "Unknown Wreck", "NOAA Wrecks"),
    seen("Marine Regions", "marine_region", "geography", ["name", "preferredGazetteerName"], "Unknown Region", identifier=f"coalesce({t('mrgid')}, {t('MRGID')}, '')"),
    seen("WoRMS", "taxon", "taxonomy", ["scientificname", "scientific_name"], "Unknown Taxon", identifier=t("AphiaID", "")),
    seen("OpenSanctions", "sanctioned_entity", "compliance", ["name", "caption"], "Unknown Entity", country=t("country"), status="'sanctioned'"),
]
MAG = n("magnitude")
EVENT_ROWS = [
    ("FEMA NFIP", {"event_type": "'flood_claim'", "name": f"'NFIP flood claim ' || {t('state', '')}", "description": t("cause_of_damage"), "economic_impact": n("total_paid")}, f"{t('type')} = 'flood_claim'"),
    ("FEMA NFIP", {"event_type": "'flood_policy'", "name": f"'NFIP policy ' || {t('state', '')}", "economic_impact": n("total_coverage")}, f"{t('type')} = 'flood_policy'"),
    ("USGS Earthquakes", {"event_type": "'earthquake'", "name": t("title", "?"), "description": t("place", ""), "severity": f"CASE WHEN {MAG} >= 5 THEN 'high' WHEN {MAG} >= 3 THEN 'medium' WHEN ({MAG}) IS NOT NULL THEN 'low' END"}, f"({t('title')}) IS NOT NULL"),
    ("NOAA Storm Events", {"event_type": t("event_type", "storm"), "name": t("event_type", "Storm Event"), "description": t("event_narrative", ""), "severity": t("magnitude_type", "medium"), "economic_impact": n("damage_property")}, "true"),
]
GENERIC_ID = uid("Some other source", "record_id")
GENERIC_NAME = f"coalesce({', '.join(map(t, M.GENERIC_NAMES))}, 'Some other source #' || record_id)"


def add(name, table_name, parts, schema):
    sources = sorted({x[0] for x in parts})
    QUERIES[name] = lambda s, d: M.dispatch(records(s, d), table_name, sources)
    ORACLES[name] = rows(schema, parts)


add("tr04_value_series", "time_series", VALUES, M.SERIES)
add("tr05_unpivoted_series", "time_series", ENOW, M.SERIES)
add("tr06_conditional_series", "time_series", BY_TYPE, M.SERIES)
add("tr07_star_series", "time_series", STARS, M.SERIES)
add("tr07_star_entities", "entities", STAR_ENTITIES, M.ENTITIES)
add("tr07_star_flows", "flows", FLOW_ROWS, M.FLOWS)
add("tr08_assessments", "assessments", RATED, M.ASSESSMENTS)
add("tr08_stock_series", "time_series", ICES, M.SERIES)
add("tr09_operator_relationships", "relationships", OPERATED, M.RELATIONSHIPS)
add("tr10_observed_series", "time_series", OBSERVED, M.SERIES)
add("tr10_observed_entities", "entities", OBSERVED_ENTITIES, M.ENTITIES)
QUERIES["tr10_events"] = lambda s, d: M.dispatch(records(s, d), "events").where("event_type <> 'earthquake' or name like 'title-%'")
ORACLES["tr10_events"] = rows(M.EVENTS, EVENT_ROWS)
QUERIES["tr11_generic_entities"] = lambda s, d: M.generic(M.unmapped(records(s, d)))
ORACLES["tr11_generic_entities"] = rows(M.ENTITIES, [("Some other source", {"id": GENERIC_ID, "entity_type": "'observation'", "name": GENERIC_NAME, "identifier": "record_id", "country": t("country")}, "true")])
QUERIES["tr01_dispatch_counts"] = lambda s, d: dispatch_counts(records(s, d))
ALL_SERIES = [*VALUES, *ENOW, *BY_TYPE, *STARS, *ICES, *OBSERVED]
ORACLES["tr01_dispatch_counts"] = (
    f"WITH s AS ({rows(M.SERIES, ALL_SERIES)}), f AS ({rows(M.FLOWS, FLOW_ROWS)}), a AS ({rows(M.ASSESSMENTS, RATED)}), o AS ({rows(M.RELATIONSHIPS, OPERATED)}) "
    "SELECT 'time_series' AS kind, source_name, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'flows', source_name, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'assessments', source_name, count(*) FROM a GROUP BY ALL "
    f"UNION ALL SELECT 'relationships', source_name, count(*) FROM o GROUP BY ALL UNION ALL SELECT 'unmapped', source_name, count(*) FROM (WITH {VIEW} SELECT * FROM r WHERE source_name = 'Some other source') GROUP BY ALL"
)
QUERIES["tr13_promoted"] = lambda s, d: M.promoted(records(s, d).where(F.col("source_name").isin("OBIS", "Some other source")), M.dispatch(records(s, d).where("ts < '1995-01-01'"), "entities", ["OBIS"]))
ORACLES["tr13_promoted"] = (
    rows(M.ENTITIES, [OBSERVED_ENTITIES[0], ("Some other source", {"id": GENERIC_ID, "entity_type": "'observation'", "name": GENERIC_NAME, "identifier": "record_id", "country": t("country")}, "true")]).replace(f"WITH {VIEW} ", f"WITH {VIEW}, x AS (", 1)
    + (
        ") SELECT * FROM x WHERE id NOT IN (SELECT id FROM x WHERE source_name = 'OBIS' AND ts < TIMESTAMP '1995-01-01') QUALIFY row_number() OVER (PARTITION "
        "BY id ORDER BY ts DESC, record_id DESC, name DESC) = 1"
    )
)


def dispatch_counts(r: DataFrame) -> DataFrame:
    """Rows by table and source, and the records that no mapper takes."""
    out = M.unmapped(r).select(F.lit("unmapped").alias("kind"), "source_name")
    for name in ("time_series", "flows", "assessments", "relationships"):
        out = out.unionByName(M.dispatch(r, name).select(F.lit(name).alias("kind"), "source_name"))
    return out.groupBy("kind", "source_name").agg(F.count(F.lit(1)).alias("n"))
