"""DuckDB statements that compute, independently, what each registered query returns."""

from __future__ import annotations

from coverlens.standin import STANDIN_SQL

# --- building blocks ---------------------------------------------------------------------------

_RECORDS = f"WITH recs AS ({STANDIN_SQL})"

_SINCE = """, sized AS (
  SELECT *, PV_system_size_DC AS kw, year(installation_date) AS yr,
         CASE WHEN total_installed_price > 0 THEN total_installed_price END AS usd,
         CASE WHEN total_installed_price > 0 THEN PV_system_size_DC END AS usd_kw,
         total_installed_price > 0 AS priced,
         CASE WHEN third_party_owned IN (0, 1) THEN third_party_owned END AS tpo
  FROM recs WHERE PV_system_size_DC > 0 AND installation_date >= TIMESTAMP '1996-01-01'
)"""

_MID = _RECORDS + _SINCE + """, mid AS (SELECT * FROM sized WHERE kw >= 100 AND kw < 2000)"""


def _ladder(column: str) -> str:
    edges = [
        (5, "01. under 5 kW"),
        (10, "02. 5-10 kW"),
        (20, "03. 10-20 kW"),
        (50, "04. 20-50 kW"),
        (100, "05. 50-100 kW"),
        (250, "06. 100-250 kW"),
        (500, "07. 250-500 kW"),
        (1000, "08. 500 kW-1 MW"),
        (2000, "09. 1-2 MW"),
        (5000, "10. 2-5 MW"),
    ]
    nested = "'11. 5 MW and above'"
    for edge, label in reversed(edges):
        nested = f"if({column} < {edge}, '{label}', {nested})"
    return f"if({column} IS NULL, NULL, {nested})"


_ZIP5 = """if(zip_code IN ('-1', 'redacted'), NULL,
  lpad(regexp_extract(zip_code, if(suffix(zip_code, '.0'), '^[^.]*', '^[^-]*')), 5, '0'))"""

_BANDS = """count(*) FILTER (kw >= 100 AND kw < 250) AS kw100_250,
  count(*) FILTER (kw >= 250 AND kw < 500) AS kw250_500,
  count(*) FILTER (kw >= 500 AND kw < 1000) AS kw500_1mw,
  count(*) FILTER (kw >= 1000 AND kw < 2000) AS mw1_2,
  count(*) AS total_systems"""

_MW = "round(sum(kw) / 1000.0, 1)"
_MUSD = "round(sum(usd) / 1e6, 1)"
_PER_WATT = "round(sum(usd) / (1000.0 * sum(usd_kw)), 2)"


def _projects(source: str, months: int = 12) -> str:
    """Rows of ``source`` with the first date at their link and the project flag."""
    return f"""
, at_link AS (SELECT TTS_link_ID AS lk, min(installation_date) AS first_at FROM {source} GROUP BY ALL)
, numbered AS (
  SELECT s.*, first_at, TTS_link_ID NOT IN ('-1', 'redacted') AS linked,
         date_diff('month', first_at, installation_date) // {months} AS win
  FROM {source} s JOIN at_link ON lk = TTS_link_ID
)
, flagged AS (
  SELECT *, NOT linked OR 1 = row_number() OVER (
      PARTITION BY lk2, win ORDER BY installation_date, PV_system_size_DC, data_provider_1, system_ID_1, tts_row0
    ) AS is_first
  FROM (SELECT *, TTS_link_ID AS lk2 FROM numbered)
)"""


def _distribution(rows: str) -> str:
    return f"""
, per_band AS (
  SELECT size_bin, count(*) AS n, sum(kw) AS k, median(kw) AS mid_kw, count(usd) AS n_priced,
         sum(usd) AS u, sum(usd_kw) AS uk
  FROM {rows} GROUP BY size_bin
)
, whole AS (SELECT sum(n) AS n_all, sum(k) AS k_all FROM per_band)
, cumulated AS (
  SELECT a.size_bin, sum(b.n) AS so_far FROM per_band a JOIN per_band b ON b.size_bin <= a.size_bin GROUP BY 1
)
SELECT size_bin, n AS n_systems, round(100.0 * n / n_all, 2) AS pct_systems,
       so_far::BIGINT AS cum_systems, round(100.0 * so_far / n_all, 1) AS cum_pct_systems,
       round(k / 1000.0, 1) AS mw_dc, round(100.0 * k / k_all, 2) AS pct_mw, round(mid_kw, 1) AS median_kw,
       n_priced, round(u / 1e6, 1) AS capital_musd, round(u / (1000.0 * uk), 2) AS usd_per_watt
FROM per_band JOIN cumulated USING (size_bin), whole"""


def _median_chain(source: str, ratio: str, segment: str, low: float, high: float, cell: int) -> str:
    """``filled``: rows of ``source`` (with ``yr``) plus the ratio they end up with."""
    return f"""
, usable AS (SELECT * FROM {source} WHERE {ratio} >= {low} AND {ratio} <= {high})
, fine AS (SELECT yr, {segment} AS seg, median({ratio}) AS m FROM usable GROUP BY ALL HAVING count(*) >= {cell})
, coarse AS (SELECT yr, median({ratio}) AS m FROM usable GROUP BY ALL HAVING count(*) >= {cell})
, overall AS (SELECT round(median({ratio}), 6) AS m FROM usable)
, filled AS (
  SELECT s.*, coalesce(fine.m, coarse.m, (SELECT m FROM overall)) AS ratio_median,
         coalesce({ratio} >= {low} AND {ratio} <= {high}, false) AS own
  FROM {source} s
  LEFT JOIN fine ON fine.yr = s.yr AND fine.seg = s.{segment}
  LEFT JOIN coarse ON coarse.yr = s.yr
)"""


_PV = _RECORDS + """, pv AS (
  SELECT *, year(installation_date) AS yr FROM recs
  WHERE PV_system_size_DC > 0 AND technology_type <> 'storage-only'
)"""
_RATIOS = _median_chain("pv", "inverter_loading_ratio", "customer_segment", 0.8, 2.0, 30)

_COPIES = """
, copies AS (
  SELECT TTS_link_ID AS c_link, PV_system_size_DC AS c_kw, total_installed_price AS c_usd
  FROM pv WHERE total_installed_price > 0 AND TTS_link_ID NOT IN ('-1', 'redacted')
  GROUP BY ALL HAVING count(*) >= 2
)"""
_IS_COPY = """EXISTS (SELECT 1 FROM copies WHERE c_link = TTS_link_ID AND c_kw = PV_system_size_DC
               AND c_usd = total_installed_price)"""

_USED = "if(own, inverter_loading_ratio, ratio_median)"


def _b(name: str) -> str:
    return f"CASE {name} WHEN 1 THEN true WHEN 0 THEN false END AS {name}"


_EXPORT = (
    _PV
    + _RATIOS
    + _COPIES
    + _projects("filled")
    + f"""
, export AS (
  SELECT concat('tts_', tts_row0) AS source_record_id, tts_row0 AS tts_row,
    nullif(data_provider_1, '-1') AS data_provider_1, nullif(system_ID_1, '-1') AS system_id_1,
    nullif(data_provider_2, '-1') AS data_provider_2, nullif(system_ID_2, '-1') AS system_id_2,
    if(linked, TTS_link_ID, NULL) AS link_id, nullif(extensions_multiphase_id, '-1') AS multiphase_id,
    'standin' AS source_vintage, yr >= 1996 AS in_window,
    is_first AS is_first_at_address, first_at::DATE AS first_install_at_address,
    {_IS_COPY} AS exact_duplicate,
    nullif(expansion_system, '-1') AS expansion_system, nullif(multiple_phase_system, -1) AS multiple_phase_system,
    installation_date::DATE AS build_date, yr AS build_year, 'installed' AS status_group,
    PV_system_size_DC / 1000 AS capacity_mw_dc, nullif(inverter_loading_ratio, -1) AS inverter_loading_ratio_raw,
    {_USED} AS dc_ac_ratio_used, PV_system_size_DC / 1000 / {_USED} AS capacity_mw_ac,
    if(own, 'system loading ratio', 'median loading ratio (year x segment)') AS capacity_ac_method,
    {_ladder("PV_system_size_DC")} AS size_band_dc, {_ladder(f"(PV_system_size_DC / {_USED})")} AS size_band_ac,
    nullif(zip_code, '-1') AS zip_code, {_ZIP5} AS zip5,
    if(city IN ('-1', 'redacted'), NULL, city) AS city, state,
    nullif(utility_service_territory, '-1') AS utility_service_territory,
    nullif(customer_segment, '-1') AS customer_segment,
    customer_segment = 'RES' AND PV_system_size_DC >= 500 AS likely_community_solar,
    nullif(total_installed_price, -1) AS installed_price_usd,
    if(total_installed_price > 0, total_installed_price / (PV_system_size_DC * 1000), NULL) AS price_per_w_dc,
    nullif(rebate_or_grant, -1) AS rebate_or_grant_usd, nullif(battery_price, -1) AS battery_price_usd,
    {_b("third_party_owned")}, {_b("third_party_owned_inferred")},
    nullif(third_party_owned_confidence, '-1') AS third_party_owned_confidence,
    {_b("loan_inferred")}, nullif(loan_inferred_confidence, '-1') AS loan_inferred_confidence,
    {_b("cash_inferred")}, nullif(cash_inferred_confidence, '-1') AS cash_inferred_confidence,
    nullif(installer_name, '-1') AS installer_name, {_b("self_installed")}, {_b("ground_mounted")},
    {_b("tracking")}, {_b("new_construction")}, nullif(technology_type, '-1') AS technology_type,
    nullif(battery_rated_capacity_kW, -1) AS battery_kw, nullif(battery_rated_capacity_kWh, -1) AS battery_kwh,
    nullif(med_inc_HH_tract, -1) AS tract_med_inc_k, nullif(med_inc_owner_occ_HH_tract, -1) AS tract_med_inc_owner_occ_k
  FROM flagged
)"""
)

# --- one statement per registered query -------------------------------------------------------

ORACLES: dict[str, str] = {}

ORACLES["overview"] = _RECORDS + """
SELECT count(*) AS total_records, count(DISTINCT state) AS states_covered,
  count(DISTINCT data_provider_1) AS data_providers,
  CAST(min(installation_date) AS VARCHAR) AS earliest_install,
  CAST(max(installation_date) AS VARCHAR) AS latest_install,
  count(*) FILTER (PV_system_size_DC <= 0) AS records_missing_size
FROM recs"""

_LINEITEM_SCHEMA = [
    ("l_orderkey", "bigint"),
    ("l_partkey", "bigint"),
    ("l_suppkey", "bigint"),
    ("l_linenumber", "int"),
    ("l_quantity", "double"),
    ("l_extendedprice", "double"),
    ("l_discount", "double"),
    ("l_tax", "double"),
    ("l_returnflag", "string"),
    ("l_linestatus", "string"),
    ("l_shipdate", "timestamp_ntz"),
]
ORACLES["schema_profile"] = " UNION ALL ".join(
    f"SELECT CAST({i} AS BIGINT) AS ordinal, '{name}' AS column_name, '{kind}' AS column_type, "
    f"count({name}) AS non_null_rows FROM lineitem"
    for i, (name, kind) in enumerate(_LINEITEM_SCHEMA, start=1)
)

ORACLES["row_position"] = """
SELECT row_number() OVER () AS tts_row, o_orderkey, o_custkey FROM orders"""

ORACLES["field_coverage"] = _MID + """
SELECT count(*) AS midscale_systems,
  round(100.0 * count(usd) / count(*), 1) AS pct_with_price,
  round(100.0 * sum(if(rebate_or_grant > 0, 1, 0)) / count(*), 1) AS pct_with_rebate,
  round(100.0 * count(tpo) / count(*), 1) AS pct_with_ownership,
  round(100.0 * sum(if(customer_segment IN ('-1', 'redacted'), 0, 1)) / count(*), 1) AS pct_with_segment,
  round(100.0 * sum(if(installer_name IN ('-1', 'redacted'), 0, 1)) / count(*), 1) AS pct_with_installer,
  round(100.0 * sum(if(ground_mounted >= 0, 1, 0)) / count(*), 1) AS pct_with_mount_type,
  round(100.0 * sum(if(med_inc_HH_tract > 0, 1, 0)) / count(*), 1) AS pct_with_tract_income
FROM mid"""

ORACLES["state_coverage"] = _MID + f"""
SELECT state, count(*) AS systems, {_MW} AS total_mw_dc, count(usd) AS n_with_price,
  round(100.0 * count(usd) / count(*), 1) AS pct_with_price,
  CAST(min(installation_date) AS VARCHAR) AS first_install, CAST(max(installation_date) AS VARCHAR) AS last_install
FROM mid GROUP BY state"""

ORACLES["annual_completeness"] = _MID + f"""
SELECT yr AS install_year, count(*) AS systems, count(DISTINCT state) AS states_reporting, {_MW} AS total_mw_dc
FROM mid GROUP BY yr"""

ORACLES["size_bands"] = (
    _RECORDS + _SINCE + f", binned AS (SELECT {_ladder('kw')} AS size_bin, * FROM sized)" + _distribution("binned")
)

ORACLES["size_bands_by_year"] = _MID + f"""
SELECT {_ladder('kw')} AS size_bin,
  {', '.join(f'count(*) FILTER (yr = {y}) AS y{y}' for y in range(1996, 2002))},
  count(*) AS total_systems, {_MW} AS total_mw_dc
FROM mid GROUP BY 1"""

ORACLES["size_bands_by_state"] = _MID + f"""
SELECT * FROM (SELECT state, {_BANDS}, round(median(kw), 1) AS median_kw, {_MW} AS total_mw_dc FROM mid GROUP BY state)
WHERE total_systems >= 300"""

ORACLES["size_bands_by_segment"] = _MID + f"""
SELECT customer_segment AS segment, {_BANDS}, round(median(kw), 1) AS median_kw, {_MUSD} AS capital_musd
FROM mid GROUP BY 1"""

ORACLES["res_label_check"] = _MID + f"""
SELECT state, count(*) AS res_labeled_systems, round(median(kw), 1) AS median_kw, {_MW} AS mw_dc,
  count(usd) AS n_with_price, count(tpo) AS n_with_ownership, count(DISTINCT utility_service_territory) AS n_utilities,
  if(median(kw) < 500, 'check -- may be multifamily/shared', 'ALMOST CERTAINLY COMMUNITY SOLAR') AS interpretation
FROM mid WHERE customer_segment = 'RES' GROUP BY state"""

ORACLES["zip_format_check"] = _RECORDS + """
, shaped AS (
  SELECT state, zip_code, if(zip_code IN ('-1', 'redacted'), '0. missing',
    if(regexp_full_match(zip_code, '[0-9]{5}'), '1. clean 5-digit',
    if(suffix(zip_code, '.0'), '2. float artifact (.0)',
    if(regexp_full_match(zip_code, '[0-9]{4}'), '3. 4-digit, zero lost',
    if(regexp_full_match(zip_code, '[0-9]{5}-[0-9]{4}'), '4. zip+4', '5. other / malformed'))))) AS zip_format
  FROM recs
)
SELECT zip_format, count(*) AS records, round(100.0 * count(*) / (SELECT count(*) FROM recs), 2) AS pct,
  count(DISTINCT state) AS states, min(zip_code) AS example
FROM shaped GROUP BY zip_format"""

ORACLES["zip5_recovery"] = _RECORDS + f"""
, fixed AS (SELECT regexp_full_match({_ZIP5}, '[0-9]{{5}}') AS ok FROM recs WHERE zip_code NOT IN ('-1', 'redacted'))
SELECT count(*) AS non_missing, count(*) FILTER (ok) AS valid_after, count(*) FILTER (NOT ok) AS still_broken,
  round(100.0 * count(*) FILTER (ok) / count(*), 2) AS pct_valid_after
FROM fixed"""

ORACLES["project_flags"] = _MID + _projects("mid") + """
SELECT tts_row0, TTS_link_ID AS link_id, installation_date, first_at AS first_at_address, is_first AS is_first_at_address
FROM flagged"""

ORACLES["rows_vs_projects"] = _MID + _projects("mid") + """
, per_segment AS (
  SELECT customer_segment AS segment, count(*) AS s, sum(is_first::INT) AS p,
    avg(tpo) AS tpo_s, avg(tpo) FILTER (is_first) AS tpo_p, sum(usd) AS u
  FROM flagged GROUP BY 1
)
SELECT segment, s AS systems, p::BIGINT AS projects, (s - p)::BIGINT AS collapsed,
  round(100.0 * s / (SELECT sum(s) FROM per_segment), 1) AS pct_systems,
  round(100.0 * p / (SELECT sum(p) FROM per_segment), 1) AS pct_projects,
  round(100.0 * tpo_s, 1) AS pct_tpo_systems, round(100.0 * tpo_p, 1) AS pct_tpo_projects,
  round(u / 1e6, 1) AS capital_musd
FROM per_segment"""

ORACLES["dedup_sensitivity"] = _MID + """
, at_link AS (SELECT TTS_link_ID AS lk, min(installation_date) AS first_at FROM mid GROUP BY ALL)
, gaps AS (
  SELECT tts_row0, lk, lk NOT IN ('-1', 'redacted') AS linked, date_diff('month', first_at, installation_date) AS gap
  FROM mid JOIN at_link ON lk = TTS_link_ID
)
, lengths(n, label) AS (VALUES (0, '0 (none)'), (1, '1'), (3, '3'), (12, '12'), (36, '36'), (999, '999 (any gap)'))
, counted AS (
  SELECT label, count(*) AS s,
    count(DISTINCT if(linked AND n > 0, concat(lk, '/', gap // greatest(n, 1)), concat('row ', tts_row0))) AS p
  FROM gaps, lengths GROUP BY label
)
SELECT label AS window_months, s AS systems, p AS projects, s - p AS collapsed,
  round(100.0 * (s - p) / s, 2) AS pct_collapsed
FROM counted"""

ORACLES["capital_headline"] = _MID + f"""
SELECT count(*) AS midscale_systems, count(usd) AS systems_with_price, {_MW} AS total_mw_dc,
  {_MUSD} AS reported_capital_musd, round(sum(usd_kw) / 1000.0, 1) AS priced_mw_dc,
  {_PER_WATT} AS implied_usd_per_watt,
  round(sum(kw) * 1000.0 * (sum(usd) / (sum(usd_kw) * 1000.0)) / 1e6, 1) AS scaled_estimate_musd
FROM mid"""

ORACLES["capital_by_year"] = _MID + f"""
SELECT yr AS install_year, count(*) AS systems, {_MW} AS mw_dc, count(usd) AS n_priced, {_MUSD} AS reported_capital_musd,
  round(median(total_installed_price) FILTER (total_installed_price <> -1), 0) AS median_project_usd,
  {_PER_WATT} AS usd_per_watt
FROM mid GROUP BY yr"""

ORACLES["by_segment"] = _MID + f"""
SELECT customer_segment, count(*) AS systems, {_MW} AS mw_dc, round(avg(kw), 0) AS avg_kw, count(usd) AS n_priced,
  {_MUSD} AS reported_capital_musd, {_PER_WATT} AS usd_per_watt
FROM mid GROUP BY customer_segment"""

ORACLES["by_technology"] = _MID + f"""
SELECT technology_type, if(ground_mounted = 1, 'ground-mount', if(ground_mounted = 0, 'rooftop', 'unknown')) AS mount_type,
  count(*) AS systems, {_MW} AS mw_dc, {_MUSD} AS reported_capital_musd,
  round(avg(battery_rated_capacity_kWh) FILTER (battery_rated_capacity_kWh <> -1), 1) AS avg_battery_kwh
FROM mid GROUP BY ALL"""

ORACLES["storage_trend"] = _MID + """
, marked AS (SELECT yr, if(technology_type = 'pv+storage', 1, 0) AS stored FROM mid)
SELECT yr AS install_year, count(*) AS systems, sum(stored)::BIGINT AS n_with_storage,
  round(100.0 * sum(stored) / count(*), 1) AS pct_with_storage
FROM marked GROUP BY yr"""

ORACLES["ownership_structure"] = _MID + f"""
SELECT if(tpo = 1, 'third-party owned (lease/PPA)', if(tpo = 0, 'host owned', 'not reported')) AS ownership,
  count(*) AS systems, round(100.0 * count(*) / (SELECT count(*) FROM mid), 1) AS pct_of_projects,
  {_MW} AS mw_dc, {_MUSD} AS reported_capital_musd, round(avg(kw), 0) AS avg_kw
FROM mid GROUP BY 1"""

ORACLES["ownership_by_year"] = _MID + """
SELECT yr AS install_year, count(tpo) AS n_with_data, round(100.0 * sum(tpo) / count(tpo), 1) AS pct_tpo,
  round(100.0 * sum(1 - tpo) / count(tpo), 1) AS pct_host_owned
FROM mid GROUP BY yr"""

ORACLES["inferred_finance"] = _MID + f"""
SELECT loan_inferred_confidence AS confidence, count(*) AS systems, count(*) FILTER (loan_inferred = 1) AS n_loan,
  count(*) FILTER (cash_inferred = 1) AS n_cash, count(*) FILTER (third_party_owned_inferred = 1) AS n_tpo_inferred,
  {_MUSD} AS reported_capital_musd
FROM mid GROUP BY 1"""

ORACLES["rebates"] = _MID + """
, supported AS (SELECT yr, usd, if(rebate_or_grant > 0, rebate_or_grant, NULL) AS reb FROM mid)
SELECT yr AS install_year, count(reb) AS n_with_rebate, round(100.0 * count(reb) / count(*), 1) AS pct_with_rebate,
  round(sum(reb) / 1e6, 2) AS rebate_dollars_musd,
  round(100.0 * sum(reb) FILTER (usd IS NOT NULL) / sum(usd) FILTER (reb IS NOT NULL), 1) AS rebate_pct_of_cost
FROM supported GROUP BY yr"""

ORACLES["top_installers"] = _MID + f"""
, ranked AS (
  SELECT installer_name, count(*) AS systems, count(DISTINCT state) AS states_active, {_MW} AS mw_dc,
    {_MUSD} AS reported_capital_musd, round(100.0 * sum(tpo) / count(tpo), 1) AS pct_tpo
  FROM mid WHERE installer_name NOT IN ('-1', 'redacted') GROUP BY installer_name
)
SELECT * FROM ranked WHERE systems >= 5 ORDER BY reported_capital_musd DESC NULLS LAST, installer_name LIMIT 30"""

ORACLES["installer_concentration"] = _MID + """
, per_state AS (
  SELECT state, count(*) AS systems, count(DISTINCT nullif(nullif(installer_name, 'redacted'), '-1')) AS k
  FROM mid GROUP BY state
)
SELECT state, systems, k AS distinct_installers, round(systems / nullif(k, 0), 1) AS systems_per_installer
FROM per_state WHERE systems >= 300"""

ORACLES["state_by_segment"] = _MID + f"""
SELECT * FROM (
  SELECT state, customer_segment, count(*) AS systems, {_MW} AS mw_dc, {_MUSD} AS reported_capital_musd
  FROM mid GROUP BY ALL
) WHERE systems >= 40 ORDER BY mw_dc DESC, state, customer_segment LIMIT 40"""

ORACLES["utility_territory"] = _MID + f"""
SELECT state, utility_service_territory, count(*) AS systems, {_MW} AS mw_dc, {_MUSD} AS reported_capital_musd
FROM mid WHERE utility_service_territory <> '-1' AND utility_service_territory <> 'redacted'
GROUP BY ALL ORDER BY mw_dc DESC, state, utility_service_territory LIMIT 30"""

ORACLES["state_growth"] = _MID + """
, spans AS (
  SELECT state, count(*) AS n, sum(kw) FILTER (yr IN (1996, 1997)) AS a, sum(kw) FILTER (yr IN (2000, 2001)) AS b
  FROM mid GROUP BY state
)
SELECT state, round(a / 1000.0, 1) AS mw_1996_1997, round(b / 1000.0, 1) AS mw_2000_2001,
  round(100.0 * (b - a) / nullif(a, 0), 1) AS pct_change_mw, n AS total_projects
FROM spans WHERE n >= 300"""

ORACLES["segment_growth"] = _MID + """
SELECT customer_segment, count(*) FILTER (yr IN (1996, 1997)) AS n_1996_1997,
  count(*) FILTER (yr IN (2000, 2001)) AS n_2000_2001,
  round(sum(kw) FILTER (yr IN (1996, 1997)) / 1000.0, 1) AS mw_1996_1997,
  round(sum(kw) FILTER (yr IN (2000, 2001)) / 1000.0, 1) AS mw_2000_2001
FROM mid GROUP BY customer_segment"""

ORACLES["tax_exempt_hosts"] = _MID + """
SELECT yr AS install_year, count(*) FILTER (customer_segment = 'SCHOOL') AS schools,
  count(*) FILTER (customer_segment = 'GOV') AS government,
  count(*) FILTER (customer_segment = 'OTHER TAX-EXEMPT') AS other_tax_exempt,
  count(*) FILTER (customer_segment = 'AGRICULTURAL') AS agricultural,
  count(*) FILTER (customer_segment = 'RES_MF') AS multifamily, count(*) AS all_midscale
FROM mid GROUP BY yr"""

ORACLES["missing_states"] = _MID + f"""
, listed AS (SELECT concat('NATION_', i) AS state FROM range(30) t(i))
, found AS (SELECT state, count(*) AS n, {_MW} AS mw FROM mid GROUP BY state)
SELECT state, ifnull(n, 0) AS midscale_systems, ifnull(mw, 0.0) AS mw_dc,
  if(n IS NULL, 'NO DATA -- state absent from TTS', if(n < 300, 'THIN -- too few records to analyze', 'covered'))
    AS coverage_status
FROM listed LEFT JOIN found USING (state)"""

ORACLES["penetration"] = _RECORDS + _SINCE + """
, split AS (SELECT state, kw, if(kw >= 100 AND kw < 2000, kw, NULL) AS inner_kw FROM sized)
SELECT state, count(*) AS all_projects, count(inner_kw) AS midscale_systems,
  round(100.0 * count(inner_kw) / count(*), 2) AS pct_midscale_by_count,
  round(100.0 * sum(inner_kw) / sum(kw), 1) AS pct_midscale_by_mw
FROM split GROUP BY state HAVING count(*) >= 500"""

ORACLES["income_quartiles"] = _MID + f"""
, scored AS (SELECT *, med_inc_HH_tract / med_inc_HH_state AS rel FROM mid WHERE med_inc_HH_tract > 0 AND med_inc_HH_state > 0)
, bucketed AS (SELECT *, ntile(4) OVER (ORDER BY rel, tts_row0) AS quarter FROM scored)
SELECT CAST(quarter AS BIGINT) AS income_quartile, count(*) AS systems,
  round(min(rel), 2) AS min_tract_to_state_ratio, round(max(rel), 2) AS max_tract_to_state_ratio,
  {_MW} AS mw_dc, {_MUSD} AS reported_capital_musd
FROM bucketed GROUP BY 1"""

ORACLES["midscale_extract"] = _MID + _projects("mid") + f"""
SELECT installation_date, state, city, zip_code, {_ZIP5} AS zip5, utility_service_territory, customer_segment,
  kw AS kw_dc, nullif(total_installed_price, -1) AS installed_price_usd, nullif(rebate_or_grant, -1) AS rebate_usd,
  third_party_owned, technology_type, nullif(battery_rated_capacity_kWh, -1) AS battery_kwh, installer_name,
  nullif(med_inc_HH_tract, -1) AS tract_med_inc_k, nullif(med_inc_owner_occ_HH_tract, -1) AS tract_med_inc_owner_occ_k,
  kw >= 500 AND customer_segment = 'RES' AS likely_community_solar, TTS_link_ID AS link_id,
  first_at::DATE AS first_install_at_address, is_first AS is_first_at_address
FROM flagged"""

ORACLES["ilr_medians"] = _PV + """
, usable AS (
  SELECT yr, customer_segment AS seg, inverter_loading_ratio AS r FROM pv WHERE inverter_loading_ratio BETWEEN 0.8 AND 2.0
)
SELECT CAST(2 AS BIGINT) AS depth, yr AS build_year, seg AS customer_segment, median(r) AS median_ilr, count(*) AS n
FROM usable GROUP BY yr, seg
UNION ALL SELECT 1, yr, NULL, median(r), count(*) FROM usable GROUP BY yr
UNION ALL SELECT 0, NULL, NULL, median(r), count(*) FROM usable"""

ORACLES["ilr_by_year"] = _PV + """
SELECT yr AS build_year, round(median(inverter_loading_ratio), 3) AS median_ilr, count(*) AS n
FROM pv WHERE inverter_loading_ratio BETWEEN 0.8 AND 2.0 GROUP BY yr HAVING n >= 30 AND yr >= 1996"""

ORACLES["ac_conversion"] = _PV + _RATIOS + f"""
SELECT tts_row0 AS tts_row, PV_system_size_DC / 1000 AS capacity_mw_dc, {_USED} AS dc_ac_ratio_used,
  PV_system_size_DC / 1000 / {_USED} AS capacity_mw_ac,
  if(own, 'system loading ratio', 'median loading ratio (year x segment)') AS capacity_ac_method,
  {_ladder(f"(PV_system_size_DC / {_USED})")} AS size_band_ac
FROM filled"""

ORACLES["exact_duplicates"] = _PV + _COPIES + f"""
SELECT tts_row0 AS tts_row, TTS_link_ID AS link_id, {_IS_COPY} AS exact_duplicate FROM pv"""

ORACLES["export_rows"] = _EXPORT + " SELECT * FROM export"

ORACLES["drop_accounting"] = _RECORDS + """
, tagged AS (
  SELECT if(technology_type = 'storage-only', 's', if(PV_system_size_DC > 0, 'k', 'n')) AS tag FROM recs
)
SELECT count(*) AS rows_in_release, count(*) FILTER (tag = 'k') AS pv_rows_kept,
  count(*) FILTER (tag = 's') AS storage_only_dropped, count(*) FILTER (tag = 'n') AS no_size_dropped
FROM tagged"""

ORACLES["export_checks"] = _EXPORT + """
SELECT count(*) AS n, count(DISTINCT source_record_id) AS n_id, round(sum(capacity_mw_dc), 6) AS mw_dc,
  count(*) FILTER (technology_type = 'storage-only') AS n_storage,
  count(*) - count(*) FILTER (capacity_mw_ac > 0) AS n_no_ac, count(*) FILTER (build_year >= 1996) AS n_window,
  count(*) FILTER (zip_code = 'redacted') AS zip_redacted,
  count(zip5) - count(*) FILTER (regexp_full_match(zip5, '[0-9]{5}')) AS zip_garbage, count(price_per_w_dc) AS n_priced
FROM export"""

ORACLES["export_band_summary"] = _EXPORT + """
SELECT size_band_dc, count(*) AS systems, round(sum(capacity_mw_dc), 0) AS mw_dc,
  round(100.0 * count(price_per_w_dc) / count(*), 1) AS pct_priced
FROM export WHERE build_year >= 1996 GROUP BY size_band_dc"""

ORACLES["export_flag_summary"] = _EXPORT + """
SELECT count(*) FILTER (likely_community_solar) AS likely_community_solar,
  count(*) FILTER (exact_duplicate) AS exact_duplicate,
  count(*) - count(*) FILTER (is_first_at_address) AS later_phase_at_address, count(DISTINCT state) AS states
FROM export WHERE build_year >= 1996"""

ORACLES["export_method_counts"] = _EXPORT + """
SELECT capacity_ac_method, count(*) AS systems FROM export GROUP BY 1"""

_CELL_SUMS = """count(*) AS n_rows, count(*) FILTER (PV_system_size_DC <= 0) AS n_unsized, count(kw) AS n_sized,
  count(kw) FILTER (total_installed_price > 0) AS n_priced, min(installation_date) AS first_date,
  max(installation_date) AS last_date, round(sum(kw), 1) AS kw_sum,
  round(sum(total_installed_price) FILTER (kw IS NOT NULL AND total_installed_price > 0), 1) AS usd,
  round(sum(kw) FILTER (total_installed_price > 0), 1) AS usd_kw"""

ORACLES["study_cells"] = _RECORDS + f""", marked AS (
  SELECT recs.*,
    CASE WHEN PV_system_size_DC > 0 AND installation_date >= TIMESTAMP '1996-01-01' THEN PV_system_size_DC END AS kw
  FROM recs
)
SELECT 'providers' AS cell_set, state, data_provider_1, NULL AS zip_code, NULL AS inside, NULL AS kw, {_CELL_SUMS}
FROM marked GROUP BY state, data_provider_1
UNION ALL BY NAME
SELECT 'postal' AS cell_set, state, zip_code, {_CELL_SUMS} FROM marked GROUP BY state, zip_code
UNION ALL BY NAME
SELECT 'markets' AS cell_set, state, inside, {_CELL_SUMS}
FROM (SELECT *, kw >= 100 AND kw < 2000 AS inside FROM marked) GROUP BY state, inside
UNION ALL BY NAME
SELECT 'sizes' AS cell_set, kw, {_CELL_SUMS} FROM marked GROUP BY kw"""

ORACLES["export_files"] = _RECORDS + """, numbered AS (
  SELECT tts_row0, (row_number() OVER (ORDER BY tts_row0) - 1) // 1000 AS file
  FROM recs WHERE PV_system_size_DC > 0 AND technology_type <> 'storage-only'
)
SELECT file, count(*) AS n_rows, min(tts_row0) AS first_row, max(tts_row0) AS last_row FROM numbered GROUP BY file"""

ORACLES["lineitem_bands"] = f"""
WITH items AS (
  SELECT l_extendedprice / 1000 AS kw, l_quantity AS usd, l_extendedprice / 1000 AS usd_kw
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_extendedprice > 0 AND l_quantity > 0
)
, binned AS (SELECT {_ladder('kw')} AS size_bin, * FROM items)""" + _distribution("binned")

ORACLES["lineitem_median_fallback"] = """
WITH items AS (
  SELECT l_orderkey, l_linenumber, year(l_shipdate) AS yr, l_returnflag, l_extendedprice / 1000 AS size FROM lineitem
)""" + _median_chain("items", "size", "l_returnflag", 8, 70, 300) + """
SELECT l_orderkey, l_linenumber, size, if(own, size, ratio_median) AS size_used FROM filled"""
