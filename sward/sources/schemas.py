"""Input schemas of a survey."""

from __future__ import annotations

# Long abundance table: one row per site, plot, date and taxon.
COVER = (
    "site_code string, block int, plot int, subplot string, trt string, year int, year_trt int, "
    "date string, Taxon string, live int, functional_group string, max_cover double, "
    "local_lifespan string, local_provenance string"
)

# Plot-year side table.
PLOT_META = (
    "site_code string, plot int, trt string, year_trt int, experiment_type string, "
    "site_richness double, MAP_VAR_v2 double, MAP_v2 double, MAT_v2 double, TEMP_VAR_v2 double, "
    "vascular_live_mass double, litter_mass double, site_name string, continent string, "
    "country string, latitude double, longitude double"
)

# Site-scoped name changes.
NAME_FIX = "site_code string, Taxon string, NewTaxon string"
