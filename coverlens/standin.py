"""A stand-in for the study's input, derived from orders, customer and nation.

The release the reports were written for is not redistributable. This query maps the TPC-H-like
tables onto its columns, codes and irregularities, row for row, so that every report can run on
data of any scale. ``FIXTURES.md`` describes it; the text is valid SQL in Spark and DuckDB alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coverlens.plans.params import ExportParams, StudyParams

ROW_ID = "tts_row0"
# keeps the row IDs of the copies clear of the originals, whatever the scale
COPY_OFFSET = 1_000_000_000_000

STUDY = StudyParams(
    start_date="1996-01-01",
    pivot_years=tuple(range(1996, 2002)),
    early_years=(1996, 1997),
    late_years=(2000, 2001),
    min_cell_rows=40,
    min_state_rows=300,
    min_market_rows=500,
    reference_states=tuple(f"NATION_{i}" for i in range(30)),
    thin_below=300,
    row_id=ROW_ID,
)
EXPORT = ExportParams(source_vintage="standin", start_date="1996-01-01", row_id=ROW_ID)

# --- fixed values: the mapping -----------------------------------------------------------------
STANDIN_SQL = """
WITH base AS (
SELECT
  o_orderkey AS tts_row0,
  o_orderdate AS installation_date,
  n_name AS state,
  CASE WHEN o_orderkey % 11 = 0 THEN '-1' WHEN o_orderkey % 11 = 1 THEN 'redacted' ELSE concat('City', CAST(o_custkey % 40 AS STRING)) END AS city,
  CASE WHEN o_orderkey % 17 = 0 THEN '-1' WHEN o_orderkey % 97 = 1 THEN 'redacted' WHEN o_orderkey % 101 = 2 THEN 'Clinton'
       WHEN o_orderkey % 4 = 0 THEN concat(CAST(60000 + o_custkey % 900 AS STRING), '.0')
       WHEN o_orderkey % 4 = 1 THEN CAST(1000 + o_custkey % 900 AS STRING)
       WHEN o_orderkey % 4 = 2 THEN concat('0', CAST(5000 + o_custkey % 900 AS STRING), '-', CAST(9000 + o_orderkey % 900 AS STRING))
       ELSE CAST(94000 + o_custkey % 900 AS STRING) END AS zip_code,
  CASE WHEN o_custkey % 13 = 0 THEN '-1' ELSE concat(n_name, '_U', CAST(o_custkey % 3 AS STRING)) END AS utility_service_territory,
  CASE WHEN o_orderkey % 37 = 0 THEN '-1' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'RES' WHEN c_mktsegment = 'BUILDING' THEN 'COM'
       WHEN c_mktsegment = 'MACHINERY' THEN 'SCHOOL' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'GOV' ELSE 'AGRICULTURAL' END AS customer_segment,
  CASE WHEN o_orderkey % 53 = 0 THEN CAST(-1 AS DOUBLE) WHEN o_orderkey % 5 = 0 THEN (1 + floor(o_totalprice / 2500)) / 8 WHEN o_orderkey % 5 = 1 THEN CAST(floor(o_totalprice / 64) AS DOUBLE) ELSE (1 + floor(o_totalprice / 40)) / 8 END AS PV_system_size_DC,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(-1 AS DOUBLE) WHEN o_orderkey % 211 = 1 THEN CAST(0 AS DOUBLE) ELSE CAST(floor(o_totalprice) * (1 + o_custkey % 4) AS DOUBLE) END AS total_installed_price,
  CASE WHEN o_orderkey % 6 < 4 THEN CAST(-1 AS DOUBLE) ELSE CAST(100 * (1 + o_custkey % 90) AS DOUBLE) END AS rebate_or_grant,
  CAST(o_orderkey % 5 % 3 AS INT) - 1 AS third_party_owned,
  CAST(o_orderkey % 3 AS INT) - 1 AS loan_inferred,
  CASE WHEN o_orderkey % 4 = 0 THEN 'H' WHEN o_orderkey % 4 = 1 THEN 'M' WHEN o_orderkey % 4 = 2 THEN 'L' ELSE '-1' END AS loan_inferred_confidence,
  CASE WHEN o_orderstatus = 'P' THEN 'pv+storage' WHEN o_orderkey % 71 = 3 THEN 'storage-only' ELSE 'pv-only' END AS technology_type,
  CAST(o_custkey % 3 AS INT) - 1 AS ground_mounted,
  CASE WHEN o_orderstatus = 'P' THEN CAST(5 * (1 + o_custkey % 20) AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS battery_rated_capacity_kWh,
  CASE WHEN o_custkey % 9 = 0 THEN '-1' WHEN o_custkey % 9 = 1 THEN 'redacted' ELSE concat('Installer', CAST(o_custkey % 120 AS STRING)) END AS installer_name,
  CASE WHEN o_custkey % 19 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(10 * (3 + o_custkey % 18) AS DOUBLE) END AS med_inc_HH_tract,
  CAST(10 * (6 + n_nationkey % 5) AS DOUBLE) AS med_inc_HH_state,
  CASE WHEN o_custkey % 10 < 8 THEN '-1' WHEN o_custkey % 10 = 8 AND o_orderkey % 50 = 0 THEN 'redacted' ELSE concat('L', CAST(o_custkey AS STRING)) END AS TTS_link_ID,
  CASE WHEN o_orderkey % 43 = 0 THEN '-1' ELSE concat('DP', CAST(c_nationkey % 4 AS STRING)) END AS data_provider_1,
  CAST(o_orderkey AS STRING) AS system_ID_1,
  CASE WHEN o_orderkey % 2 = 0 THEN CAST(-1 AS DOUBLE) ELSE (4 + o_orderkey % 29) / CAST(16 AS DOUBLE) END AS inverter_loading_ratio,
  CASE WHEN o_orderkey % 41 = 0 THEN -1 ELSE CAST(o_orderkey % 2 AS INT) END AS third_party_owned_inferred,
  CASE WHEN o_orderkey % 5 = 0 THEN '-1' WHEN o_orderkey % 5 = 1 THEN 'H' WHEN o_orderkey % 5 = 2 THEN 'M' ELSE 'L' END AS third_party_owned_confidence,
  CAST(o_custkey % 3 AS INT) - 1 AS cash_inferred,
  CASE WHEN o_custkey % 3 = 0 THEN '-1' WHEN o_custkey % 3 = 1 THEN 'H' ELSE 'L' END AS cash_inferred_confidence,
  CASE WHEN o_orderstatus = 'P' THEN CAST(2 * (1 + o_custkey % 20) AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS battery_rated_capacity_kW,
  CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN CAST(1000 * (1 + o_custkey % 20) AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS battery_price,
  CASE WHEN o_orderkey % 7 = 0 THEN 'DPX' ELSE '-1' END AS data_provider_2,
  CASE WHEN o_orderkey % 7 = 0 THEN concat('X', CAST(o_orderkey AS STRING)) ELSE '-1' END AS system_ID_2,
  CASE WHEN o_orderkey % 23 = 0 THEN concat('00', CAST(o_custkey AS STRING)) ELSE '-1' END AS extensions_multiphase_id,
  CASE WHEN o_orderkey % 29 = 0 THEN 'True' WHEN o_orderkey % 29 = 1 THEN '-1' ELSE 'False' END AS expansion_system,
  CAST(o_orderkey % 31 % 3 AS INT) - 1 AS multiple_phase_system,
  CAST(o_custkey % 4 % 3 AS INT) - 1 AS self_installed,
  CAST(o_orderkey % 8 % 3 AS INT) - 1 AS tracking,
  CAST(o_custkey % 5 % 3 AS INT) - 1 AS new_construction,
  CASE WHEN o_custkey % 19 = 0 THEN CAST(-1 AS DOUBLE) ELSE CAST(10 * (4 + o_custkey % 16) AS DOUBLE) END AS med_inc_owner_occ_HH_tract
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)
SELECT * FROM base
UNION ALL
SELECT tts_row0 + 1000000000000 AS tts_row0, installation_date, state, city, zip_code, utility_service_territory,
  customer_segment, PV_system_size_DC, total_installed_price, rebate_or_grant, third_party_owned,
  loan_inferred, loan_inferred_confidence, technology_type, ground_mounted, battery_rated_capacity_kWh,
  installer_name, med_inc_HH_tract, med_inc_HH_state, TTS_link_ID, data_provider_1, concat(system_ID_1,
  'b') AS system_ID_1, inverter_loading_ratio, third_party_owned_inferred, third_party_owned_confidence,
  cash_inferred, cash_inferred_confidence, battery_rated_capacity_kW, battery_price, data_provider_2,
  system_ID_2, extensions_multiphase_id, expansion_system, multiple_phase_system, self_installed, tracking,
  new_construction, med_inc_owner_occ_HH_tract
FROM base
WHERE tts_row0 % 8 = 1 AND TTS_link_ID <> '-1'
"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stand-in records for one scale of the test tables.

    Same rows as ``STANDIN_SQL``, but its second branch, the exact copies, is made by repeating
    rows of the first, so the tables are read and joined once.
    """
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation")}
    select = STANDIN_SQL[STANDIN_SQL.index("SELECT") : STANDIN_SQL.rindex("SELECT * FROM base")]
    select = select[: select.rindex(")")].replace(
        "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey",
        "FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey",
    )
    base = spark.sql(select, **tables)
    copied = (F.col(ROW_ID) % 8 == 1) & (F.col("TTS_link_ID") != "-1")
    copies = F.when(copied, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    repeated = base.withColumn("_copy", F.explode(copies))
    second = F.col("_copy") == 1
    return repeated.withColumns(
        {
            ROW_ID: F.col(ROW_ID) + F.col("_copy") * F.lit(COPY_OFFSET),
            "system_ID_1": F.when(second, F.concat("system_ID_1", F.lit("b"))).otherwise(F.col("system_ID_1")),
        }
    ).drop("_copy")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` under the names of the size and price reports (size in thousands)."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return items.select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_shipdate").alias("installation_date"),
        F.col("l_returnflag").alias("customer_segment"),
        (F.col("l_extendedprice") / 1000).alias("PV_system_size_DC"),
        F.col("l_quantity").alias("total_installed_price"),
    )
