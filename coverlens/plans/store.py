"""What the reports share, stored once: counts by the keys of whole-file reports, and the study's rows.

`cells` answers four families of reports with one aggregation over grouping sets. A cell carries how many
rows it stands for and their sums, so that reports add cells up, and medians weigh them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coverlens.functions import between_half_open, since
from coverlens.operators.tables import measures
from coverlens.plans.params import StudyParams
from coverlens.session import materialize

SIZE = "PV_system_size_DC"
DATE = "installation_date"

#: name -> keys; the keys of the other sets are NULL in a cell
SETS: dict[str, tuple[str, ...]] = {
    "providers": ("state", "data_provider_1"),
    "postal": ("state", "zip_code"),
    "markets": ("state", "inside"),
    "sizes": ("kw",),
}
_KEYS = ("state", "data_provider_1", "zip_code", "inside", "kw")

#: what the reports on rows of the study read, besides the columns of the project rule and the row id
ROW_COLUMNS = (
    DATE, "state", "city", "zip_code", "utility_service_territory", "customer_segment", SIZE,
    "total_installed_price", "rebate_or_grant", "third_party_owned", "technology_type",
    "battery_rated_capacity_kWh", "installer_name", "ground_mounted", "loan_inferred",
    "loan_inferred_confidence", "cash_inferred", "third_party_owned_inferred", "med_inc_HH_tract",
    "med_inc_HH_state", "med_inc_owner_occ_HH_tract",
)


def _sized(p: StudyParams) -> Column:
    return F.coalesce(since(F.col(DATE), p.start_date) & (F.col(SIZE) > 0), F.lit(False))


def cells(df: DataFrame, p: StudyParams, *sets: str) -> DataFrame:
    """(cell_set, the keys, counts and sums) for the named sets (default: all), from one scan.

    n_rows, n_unsized and the dates are over all rows of a cell; n_sized, n_priced, kw_sum, usd and
    usd_kw over those with a size since the study's start. Only those have ``inside``, whether the size
    is in the study's band, and ``kw``.
    """
    wanted = sets or tuple(SETS)
    sized = _sized(p)
    rows = measures(df).withColumn("_sized", sized)
    rows = rows.withColumns(
        {
            "kw": F.when(F.col("_sized"), F.col("kw")),
            "inside": F.when(F.col("_sized"), between_half_open(F.col(SIZE), p.min_kw, p.max_kw)),
        }
    )
    counted = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(SIZE) <= 0).alias("n_unsized"),
        F.min(DATE).alias("first_date"),
        F.max(DATE).alias("last_date"),
        F.count_if("_sized").alias("n_sized"),
        F.count_if(F.col("_sized") & F.col("usd").isNotNull()).alias("n_priced"),
        F.sum(F.when(F.col("_sized"), F.col(SIZE))).alias("kw_sum"),
        F.sum(F.when(F.col("_sized"), F.col("usd"))).alias("usd"),
        F.sum(F.when(F.col("_sized"), F.col("usd_kw"))).alias("usd_kw"),
    ]
    used = [k for k in _KEYS if any(k in SETS[s] for s in wanted)]
    # a bit per key, the first key the highest; 1 where the set leaves the key out
    number = {s: sum(1 << len(used) - 1 - i for i, k in enumerate(used) if k not in SETS[s]) for s in wanted}
    grouped = rows.groupingSets([[F.col(k) for k in SETS[s]] for s in wanted], *used)
    found = grouped.agg(F.grouping_id(*used).alias("_set"), *counted)
    name = F.lit(None).cast("string")
    for s, n in number.items():
        name = F.when(F.col("_set") == n, F.lit(s)).otherwise(name)
    kinds = {f.name: f.dataType for f in rows.schema}
    keys = [F.col(k) if k in used else F.lit(None).cast(kinds.get(k, "string")).alias(k) for k in _KEYS]
    return found.select(name.alias("cell_set"), *keys, *[c for c in found.columns if c not in (*used, "_set")])


def single_sizes(df: DataFrame, p: StudyParams) -> DataFrame:
    """The sizes as cells of one row each, which add up to the same as those of `cells`."""
    return measures(df).filter(_sized(p)).select(
        "kw",
        F.lit(1).cast("long").alias("n_sized"),
        F.col("usd").isNotNull().cast("long").alias("n_priced"),
        F.col("kw").alias("kw_sum"),
        "usd",
        "usd_kw",
    )


def cells_of(stored: DataFrame, name: str) -> DataFrame:
    return stored.filter(F.col("cell_set") == name)


@dataclass(frozen=True)
class StudyStore:
    """``records`` as they came, and the two stored tables that stand in for them.

    ``cells``: all sets. ``rows``: the columns that reports read, of the rows in the study's band.
    """

    records: DataFrame
    cells: DataFrame
    rows: DataFrame


def build_store(df: DataFrame, p: StudyParams) -> StudyStore:
    """Read the records twice: once for the cells, once for the rows of the study."""
    wanted = dict.fromkeys([*ROW_COLUMNS, p.project.link, p.project.date, *p.project.tie_break, p.row_id])
    inside = between_half_open(F.col(SIZE), p.min_kw, p.max_kw)
    rows = df.select(*wanted).filter(since(F.col(DATE), p.start_date) & (F.col(SIZE) > 0)).filter(inside)
    stored = materialize(cells(df, p).repartition("cell_set", *_KEYS).sortWithinPartitions("cell_set"))
    return StudyStore(df, stored, materialize(rows))
