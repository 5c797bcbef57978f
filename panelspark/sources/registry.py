"""Region registry, coordinates, region groups, neighbours and fetch plans."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import small

SCHEMA = "code string, name string, region string, enabled boolean, priority int"
LOWEST_PRIORITY = 99
PAGE_ROWS = 5000

# Estimated rows per region and endpoint since 2019.
ENDPOINT_ROWS = {
    "region-data": 254760, "fuel-type-data": 456871, "interchange-data": 624813, "region-sub-ba-data": 381739,
}
# Members of the region groups.
REGION_MEMBERS = {
    "eastern": ["PJM", "MISO", "ISNE", "NYIS", "TVA", "SOCO", "DUK", "CPLE", "CPLW", "AEC", "FMPP", "FPC", "FPL",
                "GVL", "JEA", "SEC", "SC", "SCEG", "TAL", "TEC", "LGEE", "SWPP"],
    "western": ["CISO", "BPAT", "BANC", "CHPD", "DOPD", "GCPD", "NWMT", "AVA", "IPCO", "PACE", "PACW", "PGE", "PSEI",
                "SCL", "SNM", "WACM", "WAUW", "LDWP", "NEVP", "SRP", "TEPC", "WALC", "IID"],
    "texas": ["ERCO", "EPE"],
}
# Neighbours of a region.
NEIGHBOURS = {
    "PJM": ["MISO", "NYIS", "TVA", "ISNE"],
    "MISO": ["PJM", "SWPP", "SOCO", "TVA"],
    "ISNE": ["NYIS", "PJM"],
    "NYIS": ["ISNE", "PJM"],
    "TVA": ["PJM", "MISO", "SOCO"],
    "SOCO": ["TVA", "MISO", "FPL"],
    "ERCO": ["SWPP", "EPE"],
    "CISO": ["BPAT", "BANC", "LDWP"],
    "BPAT": ["CISO", "CHPD", "DOPD", "GCPD"],
}
# Latitude and longitude of a region.
COORDINATES = {
    "PJM": (40.2, -77.0), "MISO": (41.8, -93.6), "ISNE": (42.5, -72.0), "NYIS": (42.9, -76.0), "TVA": (35.8, -86.0),
    "SOCO": (33.0, -86.8), "DUK": (35.2, -80.8), "FPL": (26.7, -81.0), "LGEE": (38.2, -85.7), "CPLE": (35.8, -78.6),
    "CPLW": (35.2, -81.0), "FPC": (28.5, -81.4), "FMPP": (28.0, -82.0), "TEC": (28.0, -82.4), "GVL": (29.7, -82.3),
    "HST": (25.5, -80.4), "JEA": (30.3, -81.7), "NSB": (29.0, -80.9), "SEC": (28.0, -81.9), "TAL": (30.4, -84.3),
    "OVEC": (39.0, -82.4), "SC": (33.8, -80.0), "SCEG": (34.0, -81.0), "SEPA": (33.9, -84.5), "YAD": (35.6, -80.2),
    "ERCO": (31.0, -99.0), "CISO": (36.8, -120.0), "SWPP": (35.5, -97.5), "BPAT": (45.6, -122.0), "PACW": (43.6, -120.8),
    "PACE": (40.6, -111.8), "PSCO": (39.7, -104.9), "AZPS": (33.5, -112.0), "LDWP": (34.1, -118.2), "SRP": (33.4, -111.9),
    "WACM": (39.7, -105.0), "WALC": (33.5, -112.1), "AVA": (47.7, -117.4), "BANC": (38.6, -121.5), "EPE": (31.8, -106.5),
    "IPCO": (43.6, -116.2), "NEVP": (36.2, -115.1), "NWMT": (47.0, -109.0), "PSEI": (47.6, -122.3), "SCL": (47.6, -122.3),
    "TEPC": (32.2, -110.9), "WAUE": (44.9, -93.1), "WAUW": (44.9, -100.0), "SPA": (35.5, -96.8), "CHPD": (47.5, -120.5),
    "DOPD": (47.8, -120.0), "GCPD": (47.2, -119.3), "IID": (32.8, -115.6), "TIDC": (37.5, -120.8), "TPWR": (47.3, -122.4),
    "DEAA": (33.4, -112.9), "GRID": (37.8, -122.4), "GRIF": (35.2, -114.0), "GRMA": (33.3, -112.0), "GWA": (48.9, -111.9),
    "HGMA": (33.8, -113.2), "WWA": (48.9, -111.9), "AEC": (31.3, -86.3),
}


def load_registry(spark: SparkSession, path: str, section: str = "balancing_authorities") -> DataFrame:
    """Registry from a YAML (or JSON) settings file. The file is a small settings document."""
    text = spark.read.text(path, wholetext=True).first()[0]
    if path.endswith(".json"):
        entries = json.loads(text)[section]
    else:
        try:
            import yaml
        except ImportError as e:  # pragma: no cover
            raise ImportError("reading a YAML registry needs the yaml package; a JSON file works without it") from e
        entries = yaml.safe_load(text)[section]
    rows = [(e["code"], e.get("name", ""), e.get("region", ""), bool(e.get("enabled", True)),
             int(e.get("priority", LOWEST_PRIORITY))) for e in entries]
    return spark.createDataFrame(rows, SCHEMA)


def group_table(spark: SparkSession, groups: dict[str, list[str]] = REGION_MEMBERS) -> DataFrame:
    rows = [(code, name) for name, codes in groups.items() for code in codes]
    return spark.createDataFrame(rows, "respondent string, region string")


def neighbour_table(spark: SparkSession, neighbours: dict[str, list[str]] = NEIGHBOURS) -> DataFrame:
    rows = [(code, peer) for code, peers in neighbours.items() for peer in peers]
    return spark.createDataFrame(rows, "respondent string, peer string")


def coordinate_table(spark: SparkSession, coordinates: dict[str, tuple[float, float]] = COORDINATES) -> DataFrame:
    rows = [(code, lat, lon) for code, (lat, lon) in coordinates.items()]
    return spark.createDataFrame(rows, "code string, lat double, lon double")


def coordinates_of(codes: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Look up codes in upper case; unknown codes get no coordinates."""
    known = coordinates.withColumn("_u", F.upper("code")).drop("code")
    return codes.withColumn("_u", F.upper("code")).join(small(known), "_u", "left").drop("_u")


def select_regions(registry: DataFrame, enabled_only: bool = True, region: str | None = None,
                   max_priority: int | None = None) -> DataFrame:
    """Filter the registry; sorted by priority, then code."""
    out = registry.where("enabled") if enabled_only else registry
    if region:
        out = out.where(F.lower("region") == region.lower())
    if max_priority is not None:
        out = out.where(F.col("priority") <= max_priority)
    return out.orderBy("priority", "code")


def resolve(requested: DataFrame, registry: DataFrame) -> DataFrame:
    """Requested codes in upper case with a mark whether the registry knows them; none is dropped."""
    known = registry.select(F.upper("code").alias("code"), F.lit(1).alias("_k"))
    wanted = requested.select(F.upper("code").alias("code"))
    return wanted.join(known, "code", "left").select("code", F.coalesce("_k", F.lit(0)).alias("is_known"))


def without_coordinates(codes: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Codes (compared in upper case) that have no coordinates."""
    return codes.withColumn("_u", F.upper("code")).join(
        coordinates.select(F.upper("code").alias("_u")), "_u", "left_anti").drop("_u")


def fetch_plan(regions: DataFrame, endpoints: dict[str, int] = ENDPOINT_ROWS, delay: float = 0.5,
               page_rows: int = PAGE_ROWS) -> DataFrame:
    """Regions, estimated rows, pages and hours per endpoint, and a row ``total`` over all endpoints."""
    each = F.array(*[F.struct(F.lit(e).alias("endpoint"), F.lit(n).cast("long").alias("_rows")) for e, n in endpoints.items()])
    plan = regions.select(F.inline(each)).groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("n_regions"), F.sum("_rows").alias("est_rows"))
    total = plan.agg(F.max("n_regions").alias("n_regions"), F.sum("est_rows").alias("est_rows")).where("est_rows IS NOT NULL")
    plan = plan.unionByName(total.select(F.lit("total").alias("endpoint"), "n_regions", "est_rows"))
    pages = F.col("est_rows") / page_rows
    return plan.withColumns({"est_pages": pages, "est_hours": pages * delay / 3600})
