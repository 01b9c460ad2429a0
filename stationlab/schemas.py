"""Fixed schemas, column names and missing-value markers for daily station data."""

from __future__ import annotations

from pyspark.sql import types as T

KEY = ["usaf", "wban"]
DATE = "timestamp"

# ---------------------------------------------------------------------------------------------
# Raw daily column names as delivered by the source export, and the readable
# names they are given on load (visibility is spelled correctly here).
DAILY_RENAMES = {
    "stn": "usaf",
    "wban": "wban",
    "temp": "temp_f_mean",
    "count_temp": "temp_count",
    "dewp": "dew_point_f_mean",
    "count_dewp": "dew_point_count",
    "slp": "sea_level_pressure_mbar_mean",
    "count_slp": "sea_level_pressure_count",
    "stp": "pressure_mbar_mean",
    "count_stp": "pressure_count",
    "visib": "visibility_miles_mean",
    "count_visib": "visibility_count",
    "wdsp": "wind_speed_knots_mean",
    "count_wdsp": "wind_speed_count",
    "max": "temp_f_max",
    "flag_max": "temp_max_measurement_type",
    "min": "temp_f_min",
    "flag_min": "temp_min_measurement_type",
    "prcp": "precipitation_total_inches",
    "flag_prcp": "precipitation_measurement_type",
    "sndp": "snow_depth_inches",
    "rain_drizzle": "had_rain",
    "snow_ice_pellets": "had_snow_ice",
    "hail": "had_hail",
}

# Documented missing-value markers per readable column.
MISSING_MARKERS = {
    "temp_f_mean": 9999.9,
    "temp_f_max": 9999.9,
    "temp_f_min": 9999.9,
    "dew_point_f_mean": 9999.9,
    "sea_level_pressure_mbar_mean": 9999.9,
    "pressure_mbar_mean": 9999.9,
    "visibility_miles_mean": 999.9,
    "wind_speed_knots_mean": 999.9,
    "snow_depth_inches": 999.9,
    "precipitation_total_inches": 99.99,
}

# Indicator columns where the value 10 is a known parse error meaning 0.
RECODE_TEN_TO_ZERO = ["had_hail", "had_snow_ice"]

# Station-list renames.
STATION_RENAMES = {
    "lat": "latitude",
    "lon": "longitude",
    "elev": "elevation",
    "begin": "nominal_begin_date",
    "end": "nominal_end_date",
}

# The columns kept in the cleaned daily panel.
PANEL_COLUMNS = [
    "temp_f_mean",
    "temp_count",
    "temp_f_max",
    "temp_f_min",
    "precipitation_total_inches",
    "temp_max_measurement_type",
    "temp_min_measurement_type",
    "precipitation_measurement_type",
]
# ---------------------------------------------------------------------------------------------

_MEASURES = ["temp", "dewp", "slp", "stp", "visib", "wdsp"]

DAILY_RAW = T.StructType(
    [T.StructField("stn", T.StringType()), T.StructField("wban", T.StringType()),
     T.StructField("year", T.IntegerType()), T.StructField("mo", T.IntegerType()),
     T.StructField("da", T.IntegerType())]
    + [f for m in _MEASURES for f in (T.StructField(m, T.DoubleType()), T.StructField(f"count_{m}", T.ShortType()))]
    + [T.StructField("max", T.DoubleType()), T.StructField("flag_max", T.StringType()),
       T.StructField("min", T.DoubleType()), T.StructField("flag_min", T.StringType()),
       T.StructField("prcp", T.DoubleType()), T.StructField("flag_prcp", T.StringType()),
       T.StructField("sndp", T.DoubleType()),
       T.StructField("rain_drizzle", T.ShortType()),
       T.StructField("snow_ice_pellets", T.ShortType()), T.StructField("hail", T.ShortType())]
)

STATIONS_RAW = T.StructType([
    T.StructField("usaf", T.StringType()), T.StructField("wban", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("call", T.StringType()),
    T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType()),
    T.StructField("elev", T.DoubleType()),
    T.StructField("begin", T.DateType()), T.StructField("end", T.DateType()),
])

CITIES = T.StructType([
    T.StructField("city", T.StringType()), T.StructField("state_province", T.StringType()),
    T.StructField("country", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
])

EXCLUSION_POINTS = T.StructType([
    T.StructField("usaf", T.StringType()), T.StructField("wban", T.StringType()),
    T.StructField("timestamp", T.DateType()),
])

EXCLUSION_YEARS = T.StructType([
    T.StructField("usaf", T.StringType()), T.StructField("wban", T.StringType()),
    T.StructField("year", T.IntegerType()),
])

SPLICE_GROUPS = T.StructType([
    T.StructField("pair_id", T.IntegerType()), T.StructField("usaf", T.StringType()),
    T.StructField("wban", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("ordinal", T.IntegerType()),
])

SELECTED_STATIONS = T.StructType([
    T.StructField("usaf", T.StringType()), T.StructField("wban", T.StringType()),
    T.StructField("min", T.DateType()), T.StructField("max", T.DateType()),
    T.StructField("count", T.LongType()), T.StructField("time_coverage", T.DoubleType()),
    T.StructField("name", T.StringType()), T.StructField("country", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("call", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("elevation", T.DoubleType()),
    T.StructField("nominal_begin_date", T.DateType()), T.StructField("nominal_end_date", T.DateType()),
    T.StructField("nearest_city", T.StringType()), T.StructField("distance_km", T.FloatType()),
    T.StructField("nominal_duration_years", T.DoubleType()),
])
