"""The data contract: input column names, codes and labels.

Everything in this file is a fixed value that has to equal what the input files carry, or what
readers of the output tables already rely on. No logic lives here.
"""

from __future__ import annotations

# --- fixed values: missing-value codes --------------------------------------------------------
MISSING_NUMBER = -1
MISSING_TEXT = "-1"
REDACTED_TEXT = "redacted"
UNKNOWN_TEXT = (MISSING_TEXT, REDACTED_TEXT)

# --- fixed values: identifier columns that must stay text -------------------------------------
IDENTIFIER_COLUMNS = (
    "zip_code",
    "system_ID_1",
    "system_ID_2",
    "TTS_link_ID",
    "extensions_multiphase_id",
)

# --- fixed values: the size ladder in kW, half-open [lower, upper) ----------------------------
SIZE_CUTS_KW = (5, 10, 20, 50, 100, 250, 500, 1000, 2000, 5000)
SIZE_LABELS = (
    "01. under 5 kW",
    "02. 5-10 kW",
    "03. 10-20 kW",
    "04. 20-50 kW",
    "05. 50-100 kW",
    "06. 100-250 kW",
    "07. 250-500 kW",
    "08. 500 kW-1 MW",
    "09. 1-2 MW",
    "10. 2-5 MW",
    "11. 5 MW and above",
)

# --- fixed values: bands shown side by side in the cross-tabs (output column -> label) --------
CROSS_TAB_BANDS = {
    "kw100_250": "06. 100-250 kW",
    "kw250_500": "07. 250-500 kW",
    "kw500_1mw": "08. 500 kW-1 MW",
    "mw1_2": "09. 1-2 MW",
}

# --- fixed values: shapes of a postal code ----------------------------------------------------
ZIP_MISSING = "0. missing"
ZIP_CLEAN = "1. clean 5-digit"
ZIP_FLOAT = "2. float artifact (.0)"
ZIP_SHORT = "3. 4-digit, zero lost"
ZIP_PLUS4 = "4. zip+4"
ZIP_OTHER = "5. other / malformed"
ZIP_PATTERNS = {
    "five": r"^[0-9]{5}\z",
    "four": r"^[0-9]{4}\z",
    "plus4": r"^[0-9]{5}-[0-9]{4}\z",
}

# --- fixed values: labels of decoded flags ----------------------------------------------------
MOUNT_LABELS = {1: "ground-mount", 0: "rooftop"}
MOUNT_UNKNOWN = "unknown"
OWNERSHIP_LABELS = {1: "third-party owned (lease/PPA)", 0: "host owned"}
OWNERSHIP_UNKNOWN = "not reported"

# --- fixed values: community-solar rule -------------------------------------------------------
RESIDENTIAL_SEGMENT = "RES"
COMMUNITY_MIN_KW = 500
COMMUNITY_LIKELY = "ALMOST CERTAINLY COMMUNITY SOLAR"
COMMUNITY_CHECK = "check -- may be multifamily/shared"

# --- fixed values: technology ----------------------------------------------------------------
STORAGE_ONLY = "storage-only"
PV_WITH_STORAGE = "pv+storage"

# --- fixed values: public and tax-exempt host segments (output column -> segment) -------------
PUBLIC_HOSTS = {
    "schools": "SCHOOL",
    "government": "GOV",
    "other_tax_exempt": "OTHER TAX-EXEMPT",
    "agricultural": "AGRICULTURAL",
    "multifamily": "RES_MF",
}

# --- fixed values: gap report ----------------------------------------------------------------
GAP_ABSENT = "NO DATA -- state absent from TTS"
GAP_THIN = "THIN -- too few records to analyze"
GAP_COVERED = "covered"
STATE_CODES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT "
    "NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC"
).split()

# --- fixed values: export ---------------------------------------------------------------------
RECORD_PREFIX = "tts_"
STATUS_INSTALLED = "installed"
METHOD_OWN_RATIO = "system loading ratio"
METHOD_MEDIAN_RATIO = "median loading ratio (year x segment)"

# --- fixed values: columns of the export, in order ---------------------------------------------
EXPORT_COLUMNS = (
    "source_record_id",
    "tts_row",
    "data_provider_1",
    "system_id_1",
    "data_provider_2",
    "system_id_2",
    "link_id",
    "multiphase_id",
    "source_vintage",
    "in_window",
    "is_first_at_address",
    "first_install_at_address",
    "exact_duplicate",
    "expansion_system",
    "multiple_phase_system",
    "build_date",
    "build_year",
    "status_group",
    "capacity_mw_dc",
    "inverter_loading_ratio_raw",
    "dc_ac_ratio_used",
    "capacity_mw_ac",
    "capacity_ac_method",
    "size_band_dc",
    "size_band_ac",
    "zip_code",
    "zip5",
    "city",
    "state",
    "utility_service_territory",
    "customer_segment",
    "likely_community_solar",
    "installed_price_usd",
    "price_per_w_dc",
    "rebate_or_grant_usd",
    "battery_price_usd",
    "third_party_owned",
    "third_party_owned_inferred",
    "third_party_owned_confidence",
    "loan_inferred",
    "loan_inferred_confidence",
    "cash_inferred",
    "cash_inferred_confidence",
    "installer_name",
    "self_installed",
    "ground_mounted",
    "tracking",
    "new_construction",
    "technology_type",
    "battery_kw",
    "battery_kwh",
    "tract_med_inc_k",
    "tract_med_inc_owner_occ_k",
)

# --- fixed values: input columns the reports and the export read -------------------------------
INPUT_COLUMNS = (
    "installation_date",
    "state",
    "city",
    "zip_code",
    "utility_service_territory",
    "customer_segment",
    "technology_type",
    "installer_name",
    "PV_system_size_DC",
    "total_installed_price",
    "rebate_or_grant",
    "battery_price",
    "battery_rated_capacity_kW",
    "battery_rated_capacity_kWh",
    "inverter_loading_ratio",
    "third_party_owned",
    "third_party_owned_inferred",
    "loan_inferred",
    "cash_inferred",
    "self_installed",
    "ground_mounted",
    "tracking",
    "new_construction",
    "third_party_owned_confidence",
    "loan_inferred_confidence",
    "cash_inferred_confidence",
    "med_inc_HH_tract",
    "med_inc_HH_state",
    "med_inc_owner_occ_HH_tract",
    "TTS_link_ID",
    "system_ID_1",
    "system_ID_2",
    "extensions_multiphase_id",
    "data_provider_1",
    "data_provider_2",
    "expansion_system",
    "multiple_phase_system",
)
