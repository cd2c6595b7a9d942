"""From raw cover records to the cohort of initial leaders followed through time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.functions.predicates import except_where, ifelse_in, not_in, strict
from sward.functions.scalar import TREATMENTS, fence_flag, npk_flag
from sward.operators import joins, rules
from sward.operators.panel import (
    baseline_cohort, complete_panel, drop_empty_periods, follow_up, unit_summary,
)
from sward.operators.ranking import (
    top_one, with_group_mean, with_plot_frequency, with_rank_percentile,
)
from sward.scale import join_on
from sward.session import measured_broadcasts, pin

KEYS = ["site_code", "plot", "Taxon"]
PLOT_YEAR = ["site_code", "year_trt", "plot"]

# Records and attribute codes the analysis distinguishes.
NON_VASCULAR = ["BRYOPHYTE", "LICHEN", "LIVERWORT"]
GRAMINOIDS = ["GRASS", "GRAMINOID"]
LONG_LIVED = ["PERENNIAL", "INDETERMINATE", "NULL"]
ELIGIBLE_TREATMENTS = ["NPK", "Fence"]
CLIMATE = ["site_richness", "MAP_VAR_v2", "MAP_v2", "MAT_v2", "TEMP_VAR_v2"]
SITE_COLUMNS = [
    "site_name", "continent", "country", "experiment_type", "latitude", "longitude", "MAP_v2",
    "MAP_VAR_v2",
]
META = dict.fromkeys(
    ["site_code", "plot", "trt", "year_trt", *CLIMATE, "vascular_live_mass", "litter_mass", *SITE_COLUMNS]
)


@dataclass
class CohortRules:
    """Data-specific cleaning, as rule tables."""

    year_repairs: Sequence[dict] = field(default_factory=list)
    dropped_sites: Sequence[str] = field(default_factory=list)
    row_exclusions: Sequence[dict] = field(default_factory=list)
    taxon_merges: Sequence[dict] = field(default_factory=list)
    copied_rows: Sequence[dict] = field(default_factory=list)
    cover_repairs: Sequence[dict] = field(default_factory=list)
    dropped_taxa: Sequence[str] = field(default_factory=list)
    overrides: Sequence[tuple] = field(default_factory=list)


@dataclass
class Cohort:
    """Tables of the finished cleaning."""

    records: DataFrame
    panel: DataFrame
    cohort: DataFrame
    sites: DataFrame


def _vascular() -> Column:
    """Live vascular plants with cover."""
    return (
        (F.col("live") == 1)
        & not_in(F.col("functional_group"), NON_VASCULAR)
        & (F.col("max_cover") != 0)
    )


def eligible_cover(cover: DataFrame, meta: DataFrame, rule: CohortRules) -> DataFrame:
    """Cover rows of treated, experimental sites that were also surveyed in year 0.

    Rows that ``clean_cover`` drops at once stay out, but for those of year 0, which tell of that survey.
    """
    condition = (
        F.col("trt").isin(ELIGIBLE_TREATMENTS)
        & not_in(F.col("experiment_type"), ["Observational"])
        & (F.col("year_trt") >= 1)
    )
    # the few sites are pinned, so that no join by site moves the rows
    sites = pin(joins.eligible_keys(meta, "site_code", condition))
    rows = rules.repair_values(joins.keep_keys(cover, sites, ["site_code"]), rule.year_repairs)
    # pinned: the sites of year 0, the last years and the rows themselves are read from it, the cover only once
    first = F.col("year_trt") == 0
    rows = pin(rows.filter(_vascular() | first))
    rows = joins.keep_keys(rows, pin(joins.eligible_keys(rows, "site_code", first)), ["site_code"])
    return rules.exclude_values(rows, [("site_code", site) for site in rule.dropped_sites])


def clean_cover(rows: DataFrame, rule: CohortRules) -> DataFrame:
    """Live vascular plants after exclusions, merges, imputed rows and repairs."""
    vascular = rows.filter(_vascular())
    # one pinned row per site on the right, so this join stays local to the rows
    last = pin(vascular.groupBy("site_code").agg(F.max("year_trt").alias("max_year")))
    kept = join_on(vascular, last, ["site_code"], "left").withColumn(
        "functional_group", rules.collapse(F.col("functional_group"), GRAMINOIDS, "GRAMINOID")
    )
    for item in rule.row_exclusions:
        if "months" in item:
            month = F.substring("date", 6, 2)
            kept = kept.filter(
                ~((F.col(item["column"]) == item["value"]) & F.coalesce(month.isin(item["months"]), F.lit(False)))
            )
        else:
            kept = kept.filter(
                except_where(
                    F.col(item["column"]), item["value"], F.col(item["other"]), item["kept"]
                )
            )
    kept = rules.merge_taxa(kept, rule.taxon_merges)
    kept = rules.append_copies(kept, rule.copied_rows)
    return rules.repair_values(kept, rule.cover_repairs)


def ranked_records(rows: DataFrame, name_fix: DataFrame, tie_order: Sequence[str]) -> DataFrame:
    """One record per plot, year and taxon with traits, ranks and plot frequency."""
    tops = pin(
        top_one(
            rows, [*PLOT_YEAR, "Taxon"], "max_cover", [F.col(name) for name in tie_order]
        )
    )
    keys = [
        "site_code", "block", "plot", "subplot", "trt", "year", "year_trt", "max_year", "Taxon",
        "live",
    ]
    cover = F.col("max_cover")
    merged = (
        joins.recode_names(tops, name_fix, ["site_code", "Taxon"], "Taxon", "NewTaxon")
        .groupBy(*keys)
        .agg(strict(F.sum(cover), cover).alias("max_cover"))
    )
    order = [F.col(name) for name in [*PLOT_YEAR, *tie_order]]
    traits = ["local_provenance", "functional_group", "local_lifespan"]
    described = joins.first_lookup(merged, tops, ["Taxon"], traits, order)
    # the ranks pin what they read
    ranked = with_rank_percentile(described, PLOT_YEAR, "max_cover").withColumn(
        "cover", F.col("rel_cover")
    )
    return with_plot_frequency(pin(ranked.filter(F.col("year_trt") >= 0)))


def followed_panel(records: DataFrame, cohort: DataFrame) -> DataFrame:
    """Every year of every leader, unsampled site-years removed, plot frequency attached."""
    # pinned: the panel reads it twice
    series = pin(
        joins.left_lookup(
            cohort.select(*KEYS),
            records.select(
                *KEYS, "cover", "max_cover", "rank", "perc_rank", "year_trt", "max_year"
            ),
            KEYS,
        )
    )
    filled = pin(
        complete_panel(
            series, ["site_code", "plot"], ["Taxon"], "year_trt", "max_year",
            {"cover": 0.0, "max_cover": 0.0, "perc_rank": 0.0},
        ).filter(F.col("site_code").isNotNull())
    )
    kept = drop_empty_periods(filled, ["site_code", "year_trt"], "cover")
    frequency = records.groupBy("site_code", "Taxon", "year_trt").agg(
        F.max("plotfreq_yr").alias("plotfreq_yr")
    )
    return joins.left_lookup_filled(
        kept, frequency, ["site_code", "Taxon", "year_trt"], {"plotfreq_yr": 0.0}
    )


def build_cohort(
    cover: DataFrame,
    meta: DataFrame,
    name_fix: DataFrame,
    rule: CohortRules | None = None,
    tie_order: Sequence[str] = ("year", "date", "max_cover"),
) -> Cohort:
    """Clean the cover table, pick each plot's leaders in year 0, and follow them.

    ``tie_order`` must order the rows of a plot, year and taxon totally.
    """
    with measured_broadcasts(cover.sparkSession):
        return _built(cover, meta, name_fix, rule or CohortRules(), tie_order)


def _built(
    cover: DataFrame, meta: DataFrame, name_fix: DataFrame, rule: CohortRules, tie_order: Sequence[str]
) -> Cohort:
    # pinned: sites, climate, year 0 and the summary read one; the other's size must be known
    meta = pin(meta.select(*META))
    name_fix = pin(name_fix.select("site_code", "Taxon", "NewTaxon"))
    rows = clean_cover(eligible_cover(cover, meta, rule), rule)
    records = pin(ranked_records(rows, name_fix, tie_order))
    leaders = pin(baseline_cohort(records))
    panel = pin(followed_panel(records, leaders))
    start = records.filter(F.col("year_trt") == 0)
    traits = with_group_mean(
        start.filter(F.col("live") == 1), ["site_code", "Taxon"], "cover", "avgCover"
    ).select(
        *KEYS, "trt", "local_provenance", "local_lifespan", "functional_group", "avgCover"
    )
    sites = joins.first_per_key(
        meta, ["site_code"], [F.col("plot"), F.col("year_trt")]
    ).select("site_code", *CLIMATE)
    plots = meta.filter(F.col("year_trt") == 0).select(
        "site_code", "plot", F.col("vascular_live_mass").alias("initial_live_mass"),
        F.col("litter_mass").alias("initial_litter_mass"),
    )
    followed = follow_up(
        leaders, panel.select(*KEYS, "max_cover", "cover", "perc_rank", "year_trt"), traits,
        sites, plots, list(TREATMENTS),
    )
    coded = followed.withColumns({"NPK": npk_flag(F.col("trt")), "Fence": fence_flag(F.col("trt"))})
    kept = rules.exclude_values(coded, [("Taxon", taxon) for taxon in rule.dropped_taxa])
    described = _attributes(kept, rule)
    richness = (
        start.filter((F.col("live") == 1) & not_in(F.col("Taxon"), ["LICHEN", "BRYOPHYTE"]))
        .select("site_code", "Taxon").distinct()
        .groupBy("site_code").agg(F.count(F.lit(1)).alias("site_rich_0"))
    )
    cohort = pin(joins.left_lookup(described, richness, ["site_code"]))
    summary = unit_summary(
        meta, cohort, cohort.select("site_code", "site_rich_0").distinct(), SITE_COLUMNS,
        [F.col("plot")],
    )
    return Cohort(records=records, panel=panel, cohort=cohort, sites=summary)


def _attributes(rows: DataFrame, rule: CohortRules) -> DataFrame:
    """Lifespan overrides precede its collapse to two classes; the others follow."""
    early = [item for item in rule.overrides if item[2] == "local_lifespan"]
    late = [item for item in rule.overrides if item[2] != "local_lifespan"]
    rows = rules.override_attributes(rows, early)
    rows = rows.withColumns(
        {
            "local_lifespan": ifelse_in(
                F.col("local_lifespan"), LONG_LIVED, "PERENNIAL", "ANNUAL"
            ),
            "functional_group": rules.collapse(F.col("functional_group"), GRAMINOIDS, "GRAMINOID"),
        }
    )
    return rules.override_attributes(rows, late)
