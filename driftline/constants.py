"""Fixed values of the survey method.

These must equal the values the analysed method uses for results to agree;
they are stated here once, in natural order, and every operator takes them
as overridable arguments.
"""

from __future__ import annotations

# --- fixed values: season bands (month ranges, inclusive) -------------------
SEASON_BANDS = (
    ("Spring", 3, 5),
    ("Summer", 6, 8),
    ("Fall", 9, 11),
)
SEASON_OTHERWISE = "Winter"  # every other month, and a missing month

# --- fixed values: region code -> region name --------------------------------
# maintained analysis: codes 1 and 2 merged as MAB
REGIONS_MERGED = {1: "MAB", 2: "MAB", 3: "GB", 4: "GOM"}
# workshop draft: code 2 kept as SNE
REGIONS_SPLIT = {1: "MAB", 2: "SNE", 3: "GB", 4: "GOM"}
REGION_OTHERWISE = "Outside"
REGION_DROPPED_CODE = 0

# --- fixed values: sampling --------------------------------------------------
PREFERRED_ZOO_GEAR = "6B3Z"
SAMPLE_KEY = ("cruise_name", "station", "region_name", "date")
DRAFT_SAMPLE_KEY = ("cruise_name", "station", "region", "date")
FORAGE_FISH = ("cluhar_10m2", "scosco_10m2", "pepspp_10m2", "ammspp_10m2")
VOLUME = "volume_1m2"

# --- fixed values: time series -----------------------------------------------
RUN_MEAN_K = 5
EARLY_PERIOD = (1978, 1987)
RECENT_START = 1998

# --- fixed values: tow metadata columns kept by both analyses, in order -------
TOW_METADATA = (
    "cruise_name", "station", "zoo_gear", "ich_gear", "lat", "lon", "region",
    "region_name", "strata_47", "strata_46", "strata_26", "date", "month",
    "day", "year", "doy", "time", "depth", "season", "sfc_temp", "sfc_salt",
    "btm_temp", "btm_salt",
)
