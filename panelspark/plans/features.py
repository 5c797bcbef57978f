"""The feature matrix of all regions in one job.

Order of work: (1) one conditional aggregate turns the long region table into a wide spine, which is put on a
strict hourly grid; (2) supply, flows, weather and other regions' values are joined on (respondent, period), the
result is written once; (3) every lag and rolling statistic is evaluated with a single exchange on
(respondent, time block); (4) everything else is a projection. Statistics of the whole history (caps,
quantiles, maxima) come from narrow tables and are joined as one row per region.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.functions import calendar, demand, fuel, holidays, weather
from panelspark.functions.nulls import flag, nan_to_null
from panelspark.operators import cleaning, flows, joins, spatial, splits
from panelspark.operators.blocks import lag, over_blocks
from panelspark.operators.quantiles import exact_quantiles
from panelspark.panel import Panel
from panelspark.session import materialize, small, stored

KEY, TS = "respondent", "period"

BYTE_COLUMNS = (
    "hour_of_day", "day_of_week", "month", "day_of_month", "week_of_year", "quarter", "is_weekend", "is_us_holiday",
    "is_business_day", "is_imputed", "is_anomaly", "fold", "is_in_holiday_period", "is_in_major_holiday_period",
    "days_into_holiday_period", "is_day_before_holiday", "is_day_after_holiday", "is_import_stress",
    "is_export_stress", "is_covid_period", "is_dst_transition", "days_from_month_start", "days_to_month_end",
)
SHORT_COLUMNS = ("days_to_nearest_holiday", "days_to_nearest_major_holiday")
#: Never used as a feature in training.
NOT_FEATURES = (KEY, TS, "demand_mw", "fold", "is_imputed", "is_anomaly", "eia_forecast_mw")


@dataclass(frozen=True)
class Tables:
    """Clean input tables. Only ``region`` is needed; the columns of absent tables are NULL (supply: 0).

    region: respondent, period, type, value_mwh, is_imputed, is_anomaly; fuel: respondent, period, fueltype,
    value_mwh; flows: period, fromba, toba, value_mwh; weather: respondent, period and six measures;
    members: respondent, region, enabled; neighbours: respondent, peer; coordinates: respondent, lat.
    """

    region: DataFrame
    fuel: DataFrame | None = None
    flows: DataFrame | None = None
    weather: DataFrame | None = None
    members: DataFrame | None = None
    neighbours: DataFrame | None = None
    coordinates: DataFrame | None = None


def _nulls(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.lit(None).cast("double") for n in names})


def spine(region: DataFrame, panel: Panel) -> DataFrame:
    """Wide rows of all series that have demand, on a gap-free grid, before cleaning."""
    v, kind = nan_to_null(F.col("value_mwh").cast("double")), F.col("type")

    def of(code: str, c):
        return F.max(F.when(kind == code, c))

    wide = region.groupBy(KEY, TS).agg(
        of("D", v).alias("demand_mw"), of("DF", v).alias("eia_forecast_mw"), of("NG", v).alias("net_generation"), of("TI", v).alias("total_interchange"),
        of("D", F.col("is_imputed")).alias("is_imputed"), of("D", F.col("is_anomaly")).alias("is_anomaly"),
        F.count(F.when(kind.isin("D", "DF"), 1)).alias("_rows"),
    ).where("_rows > 0").drop("_rows")
    wide = stored(wide)
    with_demand = wide.where("demand_mw IS NOT NULL").select(KEY).distinct()
    grid = cleaning.regular_grid(wide, panel).join(small(materialize(with_demand)), KEY, "left_semi")
    return grid.fillna(0, ["is_imputed", "is_anomaly"])


def _with_fuel(base: DataFrame, table: DataFrame | None, panel: Panel) -> DataFrame:
    if table is None:
        return _nulls(base, fuel.ALL_FUELS).withColumn("has_fuel", F.lit(False))
    wide = joins.fuel_wide(table, panel, fuel.ALL_FUELS, "value_mwh")
    seen = table.select(KEY).distinct().withColumn("has_fuel", F.lit(True))
    out = joins.align(base, panel, wide).join(small(materialize(seen)), KEY, "left")
    return out.withColumn("has_fuel", F.coalesce("has_fuel", F.lit(False)))


def _with_flows(base: DataFrame, table: DataFrame | None, panel: Panel) -> DataFrame:
    if table is None:
        return _nulls(base, ["net_interchange"])
    net = flows.net_interchange(table, value="value_mwh")
    return joins.align(base, panel, net.select(KEY, TS, "net_interchange"))


def one_row(table: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """One row per key: of repeated rows the greatest, compared column by column. A repeated row would add a step to the grid."""
    best = table.groupBy(*keys).agg(F.max(F.struct(*columns)).alias("_b"))
    return best.select(*keys, *[F.col(f"_b.{c}").alias(c) for c in columns])


def _with_weather(base: DataFrame, table: DataFrame | None, panel: Panel) -> DataFrame:
    if table is None:
        return _nulls(base, weather.CORE)
    return joins.align(base, panel, one_row(table, [KEY, TS], weather.CORE))


_REGIONAL = ("regional_demand_index", "regional_demand_per_ba")
_NEIGHBOUR = ("neighbor_demand_avg", "neighbor_demand_max", "neighbor_demand_min")


def _with_peers(base: DataFrame, raw: DataFrame, tables: Tables, panel: Panel) -> DataFrame:
    """Values of other regions one day earlier, from demand before cleaning."""
    out = base
    if tables.members is None:
        out = _nulls(out, _REGIONAL)
    else:
        regional = spatial.regional_demand(raw, tables.members, panel, "_raw").drop("_raw")
        out = joins.align(out, panel, regional)
    if tables.neighbours is None:
        return _nulls(out, (*_NEIGHBOUR, "neighbor_temp_2m"))
    edges = tables.neighbours
    if tables.members is not None:
        on = tables.members.where("enabled").select(F.col(KEY).alias("peer"))
        edges = edges.join(on, "peer", "left_semi")
    out = joins.align(out, panel, spatial.neighbour_demand(raw, edges, panel, "_raw"))
    if tables.weather is None:
        return _nulls(out, ["neighbor_temp_2m"])
    return joins.align(out, panel, spatial.neighbour_weather(one_row(tables.weather, [KEY, TS], ["temp_2m"]), edges, panel))


def _calendar(df: DataFrame) -> DataFrame:
    ts = F.col(TS)
    df = df.withColumns({
        **calendar.basic(ts), **calendar.fourier(ts), **calendar.annual(ts), **calendar.month_position(ts),
        "is_covid_period": calendar.in_period(ts), "is_dst_transition": calendar.clock_change(ts),
    })
    return df.withColumn("is_business_day", calendar.business_day(ts, F.col("is_us_holiday")))


def _weather_columns(df: DataFrame) -> DataFrame:
    t, dew, wind = F.col("temp_2m"), F.col("dewpoint_2m"), F.col("windspeed_10m")
    df = df.withColumns({"relative_humidity": weather.humidity(t, dew), **weather.thermal(t), **weather.temp_changes()})
    rh = F.col("relative_humidity")
    return df.withColumns({
        "apparent_temp": weather.apparent(t, rh),
        **weather.interactions(t, rh, F.col("hour_of_day"), F.col("month"), F.col("is_weekend"), F.col("hdd"), F.col("cdd")),
        **weather.supply_interactions(wind, F.col("solar_irradiance"), F.col("wind_pct"), F.col("solar_pct")),
        "dewpoint_depression": t - dew, "thi": weather.heat_humidity_index(t, rh), "wind_chill": weather.wind_chill(t, wind),
        **weather.sun_geometry(F.col("lat"), F.col(TS)),
        "temp_delta_vs_neighbors": t - F.col("neighbor_temp_2m"),
    })


def _whole_history(base: DataFrame, panel: Panel) -> DataFrame:
    """One row per region: flow quantiles, maxima of the regional components, first time and years."""
    net = over_blocks(base.select(KEY, TS, "net_interchange"), panel, {"_net": lag("net_interchange", 24)})
    q = exact_quantiles(net, [KEY], "_net", {"_p90": 0.9, "_p10": 0.1})
    tops = base.groupBy(KEY).agg(F.max("regional_demand_index").alias("_top_r"), F.max("neighbor_demand_avg").alias("_top_n"),
                                 F.min(TS).alias("_first"), *holidays.year_span(TS))
    return tops.join(q, KEY, "left")


def _stress(df: DataFrame) -> DataFrame:
    net = F.col("interchange_net_lag24")
    total, used = F.lit(0.0), F.lit(0)
    for value, top in (("regional_demand_index", "_top_r"), ("neighbor_demand_avg", "_top_n")):
        present = F.col(top).isNotNull()
        total = total + F.when(present, F.try_divide(value, top)).otherwise(F.lit(0.0))
        used = used + present.cast("int")
    return df.withColumns({
        "is_import_stress": flag(net > F.col("_p90")), "is_export_stress": flag(net < F.col("_p10")),
        "grid_stress_index": F.try_divide(total, used),
        "demand_delta_vs_neighbors": F.col("lag_24h") - F.col("neighbor_demand_avg"),
    })


def feature_matrix(tables: Tables, panel: Panel = Panel(), base_year: int = splits.BASE_YEAR) -> DataFrame:
    """All features of all regions as doubles; see ``cast_schema`` for storage types."""
    grid = stored(spine(tables.region, panel))
    raw = grid.select(KEY, TS, F.col("demand_mw").alias("_raw"))
    raw._is_stored = True  # a projection of a written table
    bounded = cleaning.absolute_bounds(grid, "demand_mw", "eia_forecast_mw")
    bounded._is_stored = True  # a projection of a written table
    base = cleaning.statistical_cap(bounded, panel, "demand_mw", "eia_forecast_mw")
    base = _with_fuel(base, tables.fuel, panel)
    base = _with_flows(base, tables.flows, panel)
    base = _with_weather(base, tables.weather, panel)
    base = stored(_with_peers(base, raw, tables, panel))

    stage = {
        **demand.lags(), **demand.long_lags(), **demand.anchored(), **demand.generation("net_generation", "total_interchange"), **demand.interchange(),
        **fuel.shifted(), **weather.temp_windows(), **weather.temp_weighted(),
    }
    df = over_blocks(base, panel, stage).withColumns({
        **demand.momentum(), **demand.generation_changes(), **fuel.mix(has_fuel=F.col("has_fuel"))})
    history = materialize(_whole_history(base, panel))
    df = df.join(small(history), KEY, "left")
    if tables.coordinates is None:
        df = _nulls(df, ["lat"])
    else:
        df = df.join(small(materialize(one_row(tables.coordinates, [KEY], ["lat"]))), KEY, "left")
    df = holidays.add_holidays(df, TS, (KEY,), span=history)
    df = _stress(_weather_columns(_calendar(df)))
    df = df.withColumn("fold", splits.fold_label(F.col(TS), base_year))
    # On a gap-free grid the position of a row follows from its time.
    df = df.where(
        (F.col(TS) >= panel.shift(splits.WARMUP_ROWS, F.col("_first"))) & F.col("demand_mw").isNotNull())
    hidden = [c for c in df.columns if c.startswith("_") or c.startswith("fuel_")]
    return df.drop(*hidden, *fuel.ALL_FUELS, "has_fuel", "net_generation", "total_interchange", "net_interchange", "neighbor_temp_2m", "lat")


def cast_schema(df: DataFrame) -> DataFrame:
    """Storage types: float features, byte flags and calendar, short day distances."""
    def target(name: str, kind: str):
        if name in BYTE_COLUMNS:
            return F.col(name).cast("byte")
        if name in SHORT_COLUMNS:
            return F.col(name).cast("short")
        return F.col(name).cast("float") if kind == "double" else F.col(name)

    return df.select(*[target(f.name, f.dataType.typeName()).alias(f.name) for f in df.schema.fields])


def feature_columns(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES) -> list[str]:
    """Columns used for training: everything but the excluded ones, in order."""
    return [c for c in df.columns if c not in exclude]


def column_report(df: DataFrame, exclude: tuple[str, ...] = NOT_FEATURES, sample: int = 10) -> dict:
    """Counts and names of used and excluded columns, from the schema alone."""
    used = feature_columns(df, exclude)
    return {"n_columns": len(df.columns), "n_features": len(used),
            "excluded": [c for c in df.columns if c in exclude], "sample": used[:sample]}
