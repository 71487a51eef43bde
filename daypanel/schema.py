"""Column names and fixed values shared by every module."""

from __future__ import annotations

ENTITY = "catchment_id"
DATE = "date"
TARGET = "streamflow_mm_day"
BASIN = "basin"
OBS = "y_true"
PRED = "y_pred"
PRECIP = "precipitation_mm"
PET = "pet_mm"
TMAX = "temperature_max_c"
TMIN = "temperature_min_c"

# Columns that identify or locate a row and are never model features.
KEYS = (ENTITY, DATE, BASIN)
NOT_FEATURES = (TARGET, DATE, ENTITY, BASIN, "latitude", "longitude")

# Raw forcing header (lower case) -> canonical column.
FORCING_COLUMNS = {
    "prcp(mm/day)": "precipitation_mm",
    "tmax(c)": "temperature_max_c",
    "tmin(c)": "temperature_min_c",
    "tavg(c)": "temperature_avg_c",
    "srad_lw(w/m2)": "solar_radiation_lw_wm2",
    "srad_sw(w/m2)": "solar_radiation_wm2",
    "wind(m/s)": "wind_speed_ms",
    "rel_hum(%)": "relative_humidity_pct",
    "pet_gleam(mm/day)": "pet_mm",
    "aet_gleam(mm/day)": "aet_mm",
    "sm_lvl1(kg/m2)": "soil_moisture_l1",
    "sm_lvl2(kg/m2)": "soil_moisture_l2",
    "sm_lvl3(kg/m2)": "soil_moisture_l3",
    "sm_lvl4(kg/m2)": "soil_moisture_l4",
}

# Raw attribute header -> canonical column.
ATTRIBUTE_COLUMNS = {
    "cwc_area": "area_km2",
    "cwc_lat": "latitude",
    "cwc_lon": "longitude",
    "river_basin": "basin",
    "aridity_p_pet": "aridity_index",
    "p_monthly_variability": "p_seasonality",
    "pop_density_2020": "pop_density",
    "urban_frac_2005": "urban_frac",
}

# Flow regimes between the 0/10/25/50/75/90/100 % quantiles of the observations.
REGIME_QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)
REGIMES = ("very_low", "low", "below_median", "above_median", "high", "very_high")

# Risk labels and the score cuts between them.
RISK_LEVELS = ("Very Low", "Low", "Moderate", "High", "Very High")
RISK_CUTS = (0.2, 0.4, 0.6, 0.8)
