"""From the cohort to rank-decay models, their tables and persistence times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sward.functions.predicates import ifelse
from sward.functions.scalar import arcsine_root, clamp_unit, logit, relabel
from sward.operators.crossing import (
    crossing_times, flag_against_control, flag_against_level, pivot_treatments,
)
from sward.operators.describe import mean_where
from sward.operators.design import Design, factorial
from sward.operators.margins import (
    back_transform, covariate_levels, marginal_means, reference_grid, year_steps,
)
from sward.operators.mixed import MixedModel
from sward.operators.panel import eligible_series
from sward.operators.report import stack_tables

GROUPS = ["site_code", "plot", "Taxon"]
FACTORS = {
    "local_lifespan": ["Annual", "Perennial"],
    "local_provenance": ["Native", "Non-native"],
    "func_simple": ["Graminoid", "Non-graminoid"],
}
# Predictor of each family that may be dropped, under a report label.
FAMILIES = {
    "Initial Cover": "initial_rel_cover",
    "Lifespan": "local_lifespan",
    "Provenance": "local_provenance",
    "Functional Group": "func_simple",
    "Site Richness": "site_richness",
    "MAP": "MAP_v2",
    "Precipitation variability": "MAP_VAR_v2",
}
SIMPLE_DROPS = ["MAP_v2", "site_richness", "MAP_VAR_v2", "func_simple", "local_provenance"]


def full_design() -> Design:
    """Year, treatments and seven predictors with all interactions within a family."""
    crossings = [["year_trt", "initial_rel_cover", "NPK", "Fence"]]
    crossings += [
        [name, "year_trt", "NPK", "Fence"]
        for name in (*FACTORS, "MAP_v2", "MAP_VAR_v2", "site_richness")
    ]
    return factorial(crossings, FACTORS)


def arcsine_design() -> Design:
    """Initial cover and lifespan families only."""
    return factorial(
        [["year_trt", "initial_rel_cover", "NPK", "Fence"],
         ["local_lifespan", "year_trt", "NPK", "Fence"]],
        {"local_lifespan": FACTORS["local_lifespan"]},
    )


def with_labels(cohort: DataFrame) -> DataFrame:
    """Readable trait labels."""
    return cohort.withColumns(
        {
            "local_lifespan": relabel(
                F.col("local_lifespan"), {"ANNUAL": "Annual", "PERENNIAL": "Perennial"}
            ),
            "local_provenance": relabel(
                F.col("local_provenance"), {"NAT": "Native", "INT": "Non-native"}
            ),
        }
    )


def model_frame(cohort: DataFrame, min_length: int = 5) -> DataFrame:
    """Long enough series with transformed responses and two functional groups.

    Site richness is that of year 0.
    """
    rows = eligible_series(cohort, min_length)
    return rows.withColumns(
        {
            "site_richness": F.col("site_rich_0").cast("double"),
            "rank_adj": clamp_unit(F.col("perc_rank")),
            "rank_as": arcsine_root(F.col("perc_rank")),
            "func_simple": ifelse(
                F.col("functional_group") == "GRAMINOID", "Graminoid", "Non-graminoid"
            ),
        }
    ).withColumn("rank_logit", logit(F.col("rank_adj")))


def complete_rows(frame: DataFrame) -> DataFrame:
    """Rows of known provenance: the rows the models use."""
    return frame.filter(F.col("local_provenance") != "UNK")


def mean_rank_cutoff(rows: DataFrame) -> float:
    """Mean rank percentile after year 0."""
    return rows.agg(mean_where(F.col("year_trt") != 0, F.col("perc_rank"))).first()[0]


def cover_levels(frame: DataFrame) -> dict[str, float]:
    """Low and high initial cover, labelled for reports."""
    row = covariate_levels(frame, "initial_rel_cover").first()
    return {"Low Initial Cover": row["low"], "High Initial Cover": row["high"]}


def decay_curves(
    rows: DataFrame,
    model: MixedModel,
    cover: dict[str, float] | None = None,
    by_lifespan: bool = False,
    last_year: int = 15,
    per_year: int = 1,
) -> DataFrame:
    """Back-transformed marginal means per treatment and year.

    With ``cover`` the curves are drawn at the labelled initial covers; the label
    travels with the value, so no later comparison of doubles is needed.
    """
    at = {"year_trt": year_steps(last_year, per_year)}
    factors = ["local_lifespan"] if by_lifespan else []
    if not cover:
        return back_transform(marginal_means(reference_grid(rows, model, at, factors), model))
    grids = [
        reference_grid(rows, model, at | {"initial_rel_cover": [value]}, factors).withColumn(
            "initial_cover", F.lit(label)
        )
        for label, value in cover.items()
    ]
    return back_transform(marginal_means(stack_tables(grids), model))


def _report(curve: DataFrame, predictor: str, cutoff: float, base: Column | None) -> DataFrame:
    times = crossing_times(
        curve.withColumnRenamed(predictor, "Predictor"), ["Predictor", "trt"], "year_trt",
        F.lit(cutoff),
    )
    text = flag_against_control(times, ["Predictor"])
    if base is not None:
        text = flag_against_level(text, base)
    return pivot_treatments(text, ["Predictor"], "text")


def persistence_table(rows: DataFrame, frame: DataFrame, model: MixedModel) -> DataFrame:
    """Years until the mean curve falls below the mean rank, with interval flags.

    ``rows`` are the model rows; the initial cover levels come from ``frame``, which
    also holds the rows of unknown provenance. Rows: average, low and high initial
    cover, each lifespan.
    """
    cutoff = mean_rank_cutoff(rows)
    average = decay_curves(rows, model, per_year=10).withColumn("Average", F.lit("Average"))
    cover = decay_curves(rows, model, cover_levels(frame), last_year=30, per_year=10)
    lifespan = decay_curves(rows, model, by_lifespan=True, per_year=10)
    name = F.col("Predictor")
    return stack_tables(
        [
            _report(average, "Average", cutoff, None),
            _report(cover, "initial_cover", cutoff, name == "Low Initial Cover"),
            _report(lifespan, "local_lifespan", cutoff, name == "Annual"),
        ]
    )
