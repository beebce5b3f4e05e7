"""The coverage study: one function per output table, ``(records, params) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coverlens import schema
from coverlens.functions import (
    between_half_open,
    blank,
    decode,
    likely_community_solar,
    named,
    round_to,
    safe_ratio,
    share,
    since,
    size_band,
    year_of,
    zip5,
    zip_format,
)
from coverlens.functions.postal import is_zip5
from coverlens.operators import tables
from coverlens.operators.projects import first_of_project, flag_projects, window_sensitivity
from coverlens.operators.selection import ntile_expression
from coverlens.operators.tables import totals, with_median
from coverlens.plans.params import StudyParams
from coverlens.plans.store import StudyStore, build_store, cells, cells_of, single_sizes
from coverlens.sources.parquet import describe
from coverlens.sources.sinks import write_csv_report

SIZE = "PV_system_size_DC"
DATE = "installation_date"
SEGMENT = "customer_segment"
OWNER = "third_party_owned"


def in_band(p: StudyParams) -> Column:
    return between_half_open(F.col(SIZE), p.min_kw, p.max_kw)


def sized_since_start(df: DataFrame, p: StudyParams) -> DataFrame:
    return df.filter(since(F.col(DATE), p.start_date) & (F.col(SIZE) > 0))


def study_rows(df: DataFrame, p: StudyParams) -> DataFrame:
    """The rows every mid-scale table starts from, with ``kw``, ``usd``, ``usd_kw``."""
    return tables.measures(sized_since_start(df, p).filter(in_band(p)))


def _by_year(rows: DataFrame) -> DataFrame:
    return rows.withColumn("install_year", year_of(F.col(DATE)))


def _knows_owner() -> Column:
    return F.col(OWNER) >= 0


def _third_party_share() -> Column:
    return share(F.count_if(F.col(OWNER) == 1), F.count_if(_knows_owner()))


# --- what is in the file ----------------------------------------------------------------------


def schema_listing(df: DataFrame, p: StudyParams) -> DataFrame:
    return describe(df)


def overview_of(found: DataFrame, p: StudyParams) -> DataFrame:
    # Cells per (state, provider) keep the two distinct counts off the raw rows.
    return found.agg(
        F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_records"),
        F.count_distinct("state").alias("states_covered"),
        F.count_distinct("data_provider_1").alias("data_providers"),
        F.min("first_date").cast("string").alias("earliest_install"),
        F.max("last_date").cast("string").alias("latest_install"),
        F.coalesce(F.sum("n_unsized"), F.lit(0)).alias("records_missing_size"),
    )


def field_coverage(df: DataFrame, p: StudyParams) -> DataFrame:
    return tables.coverage(
        study_rows(df, p),
        {
            "pct_with_price": F.col("usd").isNotNull(),
            "pct_with_rebate": F.col("rebate_or_grant") > 0,
            "pct_with_ownership": _knows_owner(),
            "pct_with_segment": named(F.col(SEGMENT)),
            "pct_with_installer": named(F.col("installer_name")),
            "pct_with_mount_type": F.col("ground_mounted") >= 0,
            "pct_with_tract_income": F.col("med_inc_HH_tract") > 0,
        },
        count_as="midscale_systems",
    )


def state_coverage(df: DataFrame, p: StudyParams) -> DataFrame:
    return (
        study_rows(df, p)
        .groupBy("state")
        .agg(
            totals.rows().alias("systems"),
            totals.mw().alias("total_mw_dc"),
            F.count("usd").alias("n_with_price"),
            share(F.count("usd"), totals.rows()).alias("pct_with_price"),
            F.min(DATE).cast("string").alias("first_install"),
            F.max(DATE).cast("string").alias("last_install"),
        )
        .orderBy(F.desc("systems"), "state")
    )


def annual_completeness(df: DataFrame, p: StudyParams) -> DataFrame:
    return (
        _by_year(study_rows(df, p))
        .groupBy("install_year")
        .agg(
            totals.rows().alias("systems"),
            F.count_distinct("state").alias("states_reporting"),
            totals.mw().alias("total_mw_dc"),
        )
        .orderBy("install_year")
    )


# --- how sizes are distributed ----------------------------------------------------------------


def size_bands_of(found: DataFrame, p: StudyParams) -> DataFrame:
    sizes = found.filter(F.col("n_sized") > 0).withColumn("size_bin", size_band(F.col("kw")))
    return tables.band_distribution(sizes, "size_bin").orderBy("size_bin")


def size_bands_by_year(df: DataFrame, p: StudyParams) -> DataFrame:
    rows = _by_year(study_rows(df, p)).withColumn("size_bin", size_band(F.col("kw")))
    years = {f"y{y}": y for y in p.pivot_years}
    return (
        rows.groupBy("size_bin")
        .agg(
            *tables.cross_tab(F.col("install_year"), years),
            totals.rows().alias("total_systems"),
            totals.mw().alias("total_mw_dc"),
        )
        .orderBy("size_bin")
    )


def _bands_across(df: DataFrame, p: StudyParams, key: str) -> tuple[DataFrame, list[Column]]:
    rows = study_rows(df, p).withColumn("size_bin", size_band(F.col("kw")))
    return rows, tables.cross_tab(F.col("size_bin"), schema.CROSS_TAB_BANDS)


def size_bands_by_state(df: DataFrame, p: StudyParams) -> DataFrame:
    rows, bands = _bands_across(df, p, "state")
    report = rows.groupBy("state").agg(
        *bands, totals.rows().alias("total_systems"), totals.mw().alias("total_mw_dc")
    )
    report = report.filter(F.col("total_systems") >= p.min_state_rows)
    return (
        with_median(report, rows, ["state"], "kw", "median_kw", 1)
        .select("state", *schema.CROSS_TAB_BANDS, "total_systems", "median_kw", "total_mw_dc")
        .orderBy(F.desc("total_systems"), "state")
    )


def size_bands_by_segment(df: DataFrame, p: StudyParams) -> DataFrame:
    rows, bands = _bands_across(df, p, SEGMENT)
    rows = rows.withColumnRenamed(SEGMENT, "segment")
    report = rows.groupBy("segment").agg(
        *bands, totals.rows().alias("total_systems"), totals.musd().alias("capital_musd")
    )
    return (
        with_median(report, rows, ["segment"], "kw", "median_kw", 1)
        .select("segment", *schema.CROSS_TAB_BANDS, "total_systems", "median_kw", "capital_musd")
        .orderBy(F.desc("total_systems"), "segment")
    )


# --- data-quality flags -----------------------------------------------------------------------


def residential_label_check(df: DataFrame, p: StudyParams) -> DataFrame:
    rows = study_rows(df, p).filter(F.col(SEGMENT) == schema.RESIDENTIAL_SEGMENT)
    report = rows.groupBy("state").agg(
        totals.rows().alias("res_labeled_systems"),
        totals.mw().alias("mw_dc"),
        F.count("usd").alias("n_with_price"),
        F.count_if(_knows_owner()).alias("n_with_ownership"),
        F.count_distinct("utility_service_territory").alias("n_utilities"),
    )
    report = with_median(report, rows, ["state"], "kw", "_median")
    verdict = F.when(
        F.col("_median") >= schema.COMMUNITY_MIN_KW, schema.COMMUNITY_LIKELY
    ).otherwise(schema.COMMUNITY_CHECK)
    return report.select(
        "state",
        "res_labeled_systems",
        round_to(F.col("_median"), 1).alias("median_kw"),
        "mw_dc",
        "n_with_price",
        "n_with_ownership",
        "n_utilities",
        verdict.alias("interpretation"),
    ).orderBy(F.desc("res_labeled_systems"), "state")


def zip_format_check_of(found: DataFrame, p: StudyParams) -> DataFrame:
    # Cells per code: a minimum of texts over raw rows would sort them all.
    report = found.groupBy(zip_format(F.col("zip_code")).alias("zip_format")).agg(
        F.sum("n_rows").alias("records"),
        F.count_distinct("state").alias("states"),
        F.min("zip_code").alias("example"),
    )
    # the window runs over one row per known shape
    everything = F.sum("records").over(Window.partitionBy())
    return report.select(
        "zip_format", "records", share(F.col("records"), everything, 2).alias("pct"), "states", "example"
    ).orderBy("zip_format")


def zip5_recovery_of(found: DataFrame, p: StudyParams) -> DataFrame:
    code = zip5(F.col("zip_code"))
    known = F.coalesce(F.sum("n_rows"), F.lit(0))
    usable = F.coalesce(F.sum(F.when(is_zip5(code), F.col("n_rows"))), F.lit(0))
    return found.filter(named(F.col("zip_code"))).agg(
        known.alias("non_missing"),
        usable.alias("valid_after"),
        (known - usable).alias("still_broken"),
        share(usable, known, 2).alias("pct_valid_after"),
    )


# --- systems and projects ---------------------------------------------------------------------


def rows_vs_projects(df: DataFrame, p: StudyParams) -> DataFrame:
    """Counts on both bases per segment; no row is joined back to its project.

    Rows that cannot share a project count as one each; the others are represented by the head
    of their project, taken from the combined (link, month) entries.
    """
    rows = study_rows(df, p).withColumnRenamed(SEGMENT, "segment")
    alone = ~p.project.collapsible()
    tpo, known = F.col(OWNER) == 1, _knows_owner()
    systems = rows.groupBy("segment").agg(
        totals.rows().alias("systems"),
        F.count_if(alone).alias("projects"),
        F.count_if(tpo).alias("tpo_rows"),
        F.count_if(known).alias("known_rows"),
        F.count_if(tpo & alone).alias("tpo_projects"),
        F.count_if(known & alone).alias("known_projects"),
        F.sum("usd").alias("usd"),
    )
    heads = first_of_project(rows, p.project, [p.row_id, "segment", OWNER])
    projects = heads.groupBy("segment").agg(
        totals.rows().alias("projects"),
        F.count_if(tpo).alias("tpo_projects"),
        F.count_if(known).alias("known_projects"),
    )
    both = systems.unionByName(projects, allowMissingColumns=True)
    both = both.groupBy("segment").agg(*[F.sum(c).alias(c) for c in both.columns if c != "segment"])
    everything = Window.partitionBy()  # one row per segment
    return both.select(
        "segment",
        "systems",
        "projects",
        (F.col("systems") - F.col("projects")).alias("collapsed"),
        share(F.col("systems"), F.sum("systems").over(everything)).alias("pct_systems"),
        share(F.col("projects"), F.sum("projects").over(everything)).alias("pct_projects"),
        share(F.col("tpo_rows"), F.col("known_rows")).alias("pct_tpo_systems"),
        share(F.col("tpo_projects"), F.col("known_projects")).alias("pct_tpo_projects"),
        round_to(F.col("usd") / 1e6, 1).alias("capital_musd"),
    ).orderBy(F.desc("systems"), "segment")


def dedup_sensitivity(df: DataFrame, p: StudyParams) -> DataFrame:
    counts = window_sensitivity(study_rows(df, p), p.project, p.sensitivity_windows)
    window = F.col("_window").cast("string")
    label = (
        F.when(F.col("_window") == 0, F.concat(window, F.lit(" (none)")))
        .when(F.col("_window") >= p.any_gap_window, F.concat(window, F.lit(" (any gap)")))
        .otherwise(window)
    )
    collapsed = F.col("systems") - F.col("projects")
    return counts.orderBy("_order").select(
        label.alias("window_months"),
        "systems",
        "projects",
        collapsed.alias("collapsed"),
        share(collapsed, F.col("systems"), 2).alias("pct_collapsed"),
    )


# --- capital ----------------------------------------------------------------------------------


def capital_headline(df: DataFrame, p: StudyParams) -> DataFrame:
    unit_price = safe_ratio(F.sum("usd"), F.sum("usd_kw") * 1000.0)
    return study_rows(df, p).agg(
        totals.rows().alias("midscale_systems"),
        F.count("usd").alias("systems_with_price"),
        totals.mw().alias("total_mw_dc"),
        totals.musd().alias("reported_capital_musd"),
        totals.mw("usd_kw").alias("priced_mw_dc"),
        round_to(unit_price, 2).alias("implied_usd_per_watt"),
        round_to(F.sum("kw") * 1000.0 * unit_price / 1e6, 1).alias("scaled_estimate_musd"),
    )


def capital_by_year(df: DataFrame, p: StudyParams) -> DataFrame:
    # The median keeps reported prices of 0, unlike every sum here.
    price = blank(F.col("total_installed_price"), schema.MISSING_NUMBER)
    rows = _by_year(study_rows(df, p)).withColumn("price", price)
    report = rows.groupBy("install_year").agg(
        totals.rows().alias("systems"),
        totals.mw().alias("mw_dc"),
        F.count("usd").alias("n_priced"),
        totals.musd().alias("reported_capital_musd"),
        totals.usd_per_watt().alias("usd_per_watt"),
    )
    return (
        with_median(report, rows, ["install_year"], "price", "median_project_usd", 0)
        .select(
            "install_year",
            "systems",
            "mw_dc",
            "n_priced",
            "reported_capital_musd",
            "median_project_usd",
            "usd_per_watt",
        )
        .orderBy("install_year")
    )


def by_customer_segment(df: DataFrame, p: StudyParams) -> DataFrame:
    return (
        study_rows(df, p)
        .groupBy(SEGMENT)
        .agg(
            totals.rows().alias("systems"),
            totals.mw().alias("mw_dc"),
            round_to(F.avg("kw"), 0).alias("avg_kw"),
            F.count("usd").alias("n_priced"),
            totals.musd().alias("reported_capital_musd"),
            totals.usd_per_watt().alias("usd_per_watt"),
        )
        .orderBy(F.desc_nulls_last("reported_capital_musd"), SEGMENT)
    )


def by_technology(df: DataFrame, p: StudyParams) -> DataFrame:
    mount = decode(F.col("ground_mounted"), schema.MOUNT_LABELS, schema.MOUNT_UNKNOWN)
    battery = blank(F.col("battery_rated_capacity_kWh"), schema.MISSING_NUMBER)
    return (
        study_rows(df, p)
        .groupBy("technology_type", mount.alias("mount_type"))
        .agg(
            totals.rows().alias("systems"),
            totals.mw().alias("mw_dc"),
            totals.musd().alias("reported_capital_musd"),
            round_to(F.avg(battery), 1).alias("avg_battery_kwh"),
        )
        .orderBy(F.desc("systems"), "technology_type", "mount_type")
    )


def storage_trend(df: DataFrame, p: StudyParams) -> DataFrame:
    stored = F.count_if(F.col("technology_type") == schema.PV_WITH_STORAGE)
    return (
        _by_year(study_rows(df, p))
        .groupBy("install_year")
        .agg(
            totals.rows().alias("systems"),
            stored.alias("n_with_storage"),
            share(stored, totals.rows()).alias("pct_with_storage"),
        )
        .orderBy("install_year")
    )


# --- ownership and finance --------------------------------------------------------------------


def ownership_structure(df: DataFrame, p: StudyParams) -> DataFrame:
    owner = decode(F.col(OWNER), schema.OWNERSHIP_LABELS, schema.OWNERSHIP_UNKNOWN)
    report = (
        study_rows(df, p)
        .groupBy(owner.alias("ownership"))
        .agg(
            totals.rows().alias("systems"),
            totals.mw().alias("mw_dc"),
            totals.musd().alias("reported_capital_musd"),
            round_to(F.avg("kw"), 0).alias("avg_kw"),
        )
    )
    everything = F.sum("systems").over(Window.partitionBy())  # three labels
    return report.select(
        "ownership",
        "systems",
        share(F.col("systems"), everything).alias("pct_of_projects"),
        "mw_dc",
        "reported_capital_musd",
        "avg_kw",
    ).orderBy(F.desc("systems"), "ownership")


def ownership_by_year(df: DataFrame, p: StudyParams) -> DataFrame:
    known = F.count_if(_knows_owner())
    return (
        _by_year(study_rows(df, p))
        .groupBy("install_year")
        .agg(
            known.alias("n_with_data"),
            _third_party_share().alias("pct_tpo"),
            share(F.count_if(F.col(OWNER) == 0), known).alias("pct_host_owned"),
        )
        .orderBy("install_year")
    )


def inferred_finance(df: DataFrame, p: StudyParams) -> DataFrame:
    return (
        study_rows(df, p)
        .groupBy(F.col("loan_inferred_confidence").alias("confidence"))
        .agg(
            totals.rows().alias("systems"),
            F.count_if(F.col("loan_inferred") == 1).alias("n_loan"),
            F.count_if(F.col("cash_inferred") == 1).alias("n_cash"),
            F.count_if(F.col("third_party_owned_inferred") == 1).alias("n_tpo_inferred"),
            totals.musd().alias("reported_capital_musd"),
        )
        .orderBy(F.desc("systems"), "confidence")
    )


def rebates(df: DataFrame, p: StudyParams) -> DataFrame:
    rebate = F.when(F.col("rebate_or_grant") > 0, F.col("rebate_or_grant"))
    rows = _by_year(study_rows(df, p)).withColumn("rebate", rebate)
    rebate_with_price = F.sum(F.when(F.col("usd").isNotNull(), F.col("rebate")))
    price_with_rebate = F.sum(F.when(F.col("rebate").isNotNull(), F.col("usd")))
    return (
        rows.groupBy("install_year")
        .agg(
            F.count("rebate").alias("n_with_rebate"),
            share(F.count("rebate"), totals.rows()).alias("pct_with_rebate"),
            totals.musd("rebate", 2).alias("rebate_dollars_musd"),
            share(rebate_with_price, price_with_rebate).alias("rebate_pct_of_cost"),
        )
        .orderBy("install_year")
    )


# --- who builds, and where --------------------------------------------------------------------


def top_installers(df: DataFrame, p: StudyParams) -> DataFrame:
    return (
        study_rows(df, p)
        .filter(named(F.col("installer_name")))
        .groupBy("installer_name")
        .agg(
            totals.rows().alias("systems"),
            F.count_distinct("state").alias("states_active"),
            totals.mw().alias("mw_dc"),
            totals.musd().alias("reported_capital_musd"),
            _third_party_share().alias("pct_tpo"),
        )
        .filter(F.col("systems") >= p.min_installer_rows)
        .orderBy(F.desc_nulls_last("reported_capital_musd"), "installer_name")
        .limit(p.top_installers)
    )


def installer_concentration(df: DataFrame, p: StudyParams) -> DataFrame:
    installers = F.count_distinct(F.when(named(F.col("installer_name")), F.col("installer_name")))
    return (
        study_rows(df, p)
        .groupBy("state")
        .agg(
            totals.rows().alias("systems"),
            installers.alias("distinct_installers"),
            round_to(safe_ratio(totals.rows(), installers), 1).alias("systems_per_installer"),
        )
        .filter(F.col("systems") >= p.min_state_rows)
        .orderBy(F.desc_nulls_last("systems_per_installer"), "state")
    )


def _spans(p: StudyParams) -> dict[str, tuple[int, int]]:
    return {f"{a}_{b}": (a, b) for a, b in (p.early_years, p.late_years)}


def state_growth(df: DataFrame, p: StudyParams) -> DataFrame:
    spans = _spans(p)
    early, late = (F.col(f"_sum_{s}") for s in spans)
    report = tables.growth(_by_year(study_rows(df, p)), "state", "kw", "install_year", spans)
    return (
        report.filter(F.col("_rows") >= p.min_state_rows)
        .select(
            "state",
            *[round_to(F.col(f"_sum_{s}") / 1000.0, 1).alias(f"mw_{s}") for s in spans],
            share(late - early, early).alias("pct_change_mw"),
            F.col("_rows").alias("total_projects"),
        )
        .orderBy(F.desc_nulls_last("pct_change_mw"), "state")
    )


def segment_growth(df: DataFrame, p: StudyParams) -> DataFrame:
    spans = _spans(p)
    report = tables.growth(_by_year(study_rows(df, p)), SEGMENT, "kw", "install_year", spans)
    last = list(spans)[-1]
    return report.select(
        SEGMENT,
        *[F.col(f"_n_{s}").alias(f"n_{s}") for s in spans],
        *[round_to(F.col(f"_sum_{s}") / 1000.0, 1).alias(f"mw_{s}") for s in spans],
    ).orderBy(F.desc_nulls_last(f"mw_{last}"), SEGMENT)


def _places(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(
        totals.rows().alias("systems"),
        totals.mw().alias("mw_dc"),
        totals.musd().alias("reported_capital_musd"),
    )


def state_by_segment(df: DataFrame, p: StudyParams) -> DataFrame:
    return (
        _places(study_rows(df, p), "state", SEGMENT)
        .filter(F.col("systems") >= p.min_cell_rows)
        .orderBy(F.desc("mw_dc"), "state", SEGMENT)
        .limit(p.top_cells)
    )


def utility_territory(df: DataFrame, p: StudyParams) -> DataFrame:
    utility = "utility_service_territory"
    return (
        _places(study_rows(df, p).filter(named(F.col(utility))), "state", utility)
        .orderBy(F.desc("mw_dc"), "state", utility)
        .limit(p.top_utilities)
    )


# --- gaps -------------------------------------------------------------------------------------


def missing_states(df: DataFrame, p: StudyParams) -> DataFrame:
    found = study_rows(df, p).groupBy("state").agg(
        totals.rows().alias("systems"), totals.mw().alias("mw")
    )
    labels = (schema.GAP_ABSENT, schema.GAP_THIN, schema.GAP_COVERED)
    report = tables.gap_report(found, "state", p.reference_states, "systems", labels, p.thin_below)
    return report.select(
        "state",
        F.coalesce("systems", F.lit(0)).alias("midscale_systems"),
        F.coalesce("mw", F.lit(0.0)).alias("mw_dc"),
        "coverage_status",
    ).orderBy("midscale_systems", "state")


def midscale_penetration_of(found: DataFrame, p: StudyParams) -> DataFrame:
    midscale = F.coalesce(F.sum(F.when(F.col("inside"), F.col("n_sized"))), F.lit(0))
    return (
        found.filter(F.col("n_sized") > 0)
        .groupBy("state")
        .agg(
            F.sum("n_sized").alias("all_projects"),
            midscale.alias("midscale_systems"),
            share(midscale, F.sum("n_sized"), 2).alias("pct_midscale_by_count"),
            share(F.sum(F.when(F.col("inside"), F.col("kw_sum"))), F.sum("kw_sum")).alias("pct_midscale_by_mw"),
        )
        .filter(F.col("all_projects") >= p.min_market_rows)
        .orderBy(F.asc_nulls_last("pct_midscale_by_mw"), "state")
    )


def income_distribution(df: DataFrame, p: StudyParams) -> DataFrame:
    tract, state = F.col("med_inc_HH_tract"), F.col("med_inc_HH_state")
    rows = (
        study_rows(df, p)
        .filter((tract > 0) & (state > 0))
        .withColumn("tract_vs_state", safe_ratio(tract, state))
    )
    bucket = ntile_expression(rows, "tract_vs_state", p.row_id, p.income_buckets)
    return (
        rows.groupBy(bucket.alias("income_quartile"))
        .agg(
            totals.rows().alias("systems"),
            round_to(F.min("tract_vs_state"), 2).alias("min_tract_to_state_ratio"),
            round_to(F.max("tract_vs_state"), 2).alias("max_tract_to_state_ratio"),
            totals.mw().alias("mw_dc"),
            totals.musd().alias("reported_capital_musd"),
        )
        .orderBy("income_quartile")
    )


def tax_exempt_hosts(df: DataFrame, p: StudyParams) -> DataFrame:
    return (
        _by_year(study_rows(df, p))
        .groupBy("install_year")
        .agg(
            *tables.cross_tab(F.col(SEGMENT), schema.PUBLIC_HOSTS),
            totals.rows().alias("all_midscale"),
        )
        .orderBy("install_year")
    )


# --- rows -------------------------------------------------------------------------------------


def midscale_extract(df: DataFrame, p: StudyParams) -> DataFrame:
    """One row per mid-scale system; written distributed, never collected."""
    kept = [
        p.row_id, DATE, "state", "city", "zip_code", "utility_service_territory", SEGMENT, SIZE,
        "total_installed_price", "rebate_or_grant", OWNER, "technology_type",
        "battery_rated_capacity_kWh", "installer_name", "med_inc_HH_tract",
        "med_inc_owner_occ_HH_tract", p.project.link, *p.project.tie_break,
    ]
    rows = sized_since_start(df, p).filter(in_band(p)).select(*dict.fromkeys(kept))
    rows = flag_projects(rows, p.project, p.row_id)

    def number(name: str) -> Column:
        return blank(F.col(name), schema.MISSING_NUMBER)

    return rows.select(
        DATE,
        "state",
        "city",
        "zip_code",
        zip5(F.col("zip_code")).alias("zip5"),
        "utility_service_territory",
        SEGMENT,
        F.col(SIZE).alias("kw_dc"),
        number("total_installed_price").alias("installed_price_usd"),
        number("rebate_or_grant").alias("rebate_usd"),
        OWNER,
        "technology_type",
        number("battery_rated_capacity_kWh").alias("battery_kwh"),
        "installer_name",
        number("med_inc_HH_tract").alias("tract_med_inc_k"),
        number("med_inc_owner_occ_HH_tract").alias("tract_med_inc_owner_occ_k"),
        likely_community_solar(F.col(SEGMENT), F.col(SIZE)).alias("likely_community_solar"),
        F.col(p.project.link).alias("link_id"),
        F.col("first_at_address").cast("date").alias("first_install_at_address"),
        "is_first_at_address",
    )


Report = Callable[[DataFrame, StudyParams], DataFrame]

#: table -> the cells it is made of, and how
OF_CELLS: dict[str, tuple[str, Report]] = {
    "02_overview": ("providers", overview_of),
    "06_size_bands": ("sizes", size_bands_of),
    "06h_zip_format_check": ("postal", zip_format_check_of),
    "06i_zip5_recovery": ("postal", zip5_recovery_of),
    "23_midscale_penetration": ("markets", midscale_penetration_of),
}


def _from_cells(name: str) -> Report:
    wanted, made = OF_CELLS[name]
    if wanted == "sizes":  # sizes hardly repeat: one report of them is quicker without combining them
        return lambda df, p: made(single_sizes(df, p), p)
    return lambda df, p: made(cells(df, p, wanted), p)

# --- fixed values: output table names, in publication order -----------------------------------
REPORTS: dict[str, Report] = {
    "01_schema": schema_listing,
    "02_overview": _from_cells("02_overview"),
    "03_field_coverage": field_coverage,
    "04_state_coverage": state_coverage,
    "05_annual_completeness": annual_completeness,
    "06_size_bands": _from_cells("06_size_bands"),
    "06b_size_bands_by_year": size_bands_by_year,
    "06c_size_bands_by_state": size_bands_by_state,
    "06d_size_bands_by_segment": size_bands_by_segment,
    "06e_res_label_check": residential_label_check,
    "06f_rows_vs_projects": rows_vs_projects,
    "06g_dedup_window_sensitivity": dedup_sensitivity,
    "06h_zip_format_check": _from_cells("06h_zip_format_check"),
    "06i_zip5_recovery": _from_cells("06i_zip5_recovery"),
    "07_capital_headline": capital_headline,
    "08_capital_by_year": capital_by_year,
    "09_by_customer_segment": by_customer_segment,
    "10_by_technology": by_technology,
    "11_storage_trend": storage_trend,
    "12_ownership_structure": ownership_structure,
    "13_ownership_by_year": ownership_by_year,
    "14_inferred_finance": inferred_finance,
    "15_rebates": rebates,
    "16_top_installers": top_installers,
    "17_installer_concentration": installer_concentration,
    "18_state_growth": state_growth,
    "19_segment_growth": segment_growth,
    "20_state_by_segment": state_by_segment,
    "21_utility_territory": utility_territory,
    "22_missing_states": missing_states,
    "23_midscale_penetration": _from_cells("23_midscale_penetration"),
    "24_income_distribution": income_distribution,
    "25_tax_exempt_hosts": tax_exempt_hosts,
    "midscale_systems_2018plus": midscale_extract,
}
ROW_LEVEL = {"midscale_systems_2018plus"}


def run_report(name: str, df: DataFrame, params: StudyParams | None = None) -> DataFrame:
    return REPORTS[name](df, params or StudyParams())


def report_from(store: StudyStore, name: str, params: StudyParams | None = None) -> DataFrame:
    """The same table as ``run_report``, from the stored cells or rows; only the schema asks the records."""
    p = params or StudyParams()
    if name in OF_CELLS:
        wanted, made = OF_CELLS[name]
        return made(cells_of(store.cells, wanted), p)
    return REPORTS[name](store.records if name == "01_schema" else store.rows, p)


def write_reports(
    df: DataFrame, folder: str, params: StudyParams | None = None, overwrite: bool = False
) -> list[str]:
    """Write every table below ``folder``, one CSV folder per table name.

    The records are read three times at most: for the schema, the cells and the rows of the study.
    """
    store = build_store(df, params or StudyParams())
    for name in REPORTS:
        write_csv_report(
            report_from(store, name, params),
            f"{folder}/{name}",
            single_file=name not in ROW_LEVEL,
            overwrite=overwrite,
        )
    return list(REPORTS)
