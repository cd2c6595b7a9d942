"""Rule tables for a multi-site grassland experiment.

Fixed values: site codes, taxon names and codes as they occur in the data.
"""

from sward.plans.cohort import CohortRules

GRASSLAND = CohortRules(
    # off-season pre-treatment survey
    year_repairs=[
        {"column": "year_trt", "op": "==", "match": -1, "new": 0, "scope": {"site_code": "lagoas.br"}},
    ],
    dropped_sites=["sval.no"],
    row_exclusions=[
        {"column": "site_code", "value": "doane.us", "other": "block", "kept": [1]},
        {"column": "site_code", "value": "jena.de", "months": ["05", "06"]},
    ],
    taxon_merges=[
        {"site": "bnch.us", "prefix": "CAREX", "new": "CAREX SP."},
        {"site": "sier.us", "names": ["BROMUS DIANDRUS", "BROMUS STERILIS"], "new": "BROMUS SP."},
        {
            "site": "doane.us",
            "names": ["SPOROBOLUS COMPOSITUS", "ANDROPOGON GERARDII"],
            "new": "ANDROPOGON GERARDII",
        },
    ],
    # a record overlooked in year 3
    copied_rows=[
        {
            "select": {"site_code": "cbgb.us", "Taxon": "SCHIZ*", "plot": 61, "year_trt": 2},
            "set": {"year_trt": 3, "max_cover": 60.0},
        },
    ],
    # in this order, on any row with the value
    cover_repairs=[
        {"column": "max_cover", "op": "==", "match": 235, "new": 30},
        {"column": "max_cover", "op": ">", "match": 150, "new": 100},
        {"column": "max_cover", "op": "==", "match": 130, "new": 80},
        {"column": "max_cover", "op": "==", "match": 120, "new": 12},
    ],
    dropped_taxa=["FORB SP.", "UNKNOWN "],
    overrides=[
        ("NARDUS STRICTA", None, "local_lifespan", "PERENNIAL"),
        ("LOLIUM MULTIFLORUM", None, "local_lifespan", "PERENNIAL"),
        ("ELYMUS SPICATUS", None, "local_lifespan", "PERENNIAL"),
        ("CIRSIUM ARVENSE", None, "local_lifespan", "PERENNIAL"),
        ("KOBRESIA CAPILLIFOLIA", None, "local_lifespan", "PERENNIAL"),
        ("DAUCUS CAROTA", None, "local_lifespan", "BIENNIAL"),
        ("CAREX SP.", "bnch.us", "local_provenance", "NAT"),
        ("CAREX SP.", "kibber.in", "local_provenance", "UNK"),
        ("DAUCUS CAROTA", "mcdan.us", "local_provenance", "INT"),
        ("ELYMUS SPICATUS", None, "local_provenance", "NAT"),
        ("HETEROTHECA VILLOSA", None, "local_provenance", "NAT"),
        ("MELICA NUTANS", None, "local_provenance", "NAT"),
        ("SETARIA SP.", None, "local_provenance", "NAT"),
        ("NARDUS STRICTA", None, "local_provenance", "NAT"),
        ("AGROSTIS SP.", None, "local_provenance", "NAT"),
        ("AMBROSIA ARTEMISIIFOLIA", None, "local_provenance", "NAT"),
        ("DANTHONIA SPICATA", None, "local_provenance", "NAT"),
        ("KOBRESIA CAPILLIFOLIA", None, "local_provenance", "NAT"),
        ("CIRSIUM ARVENSE", "badlau.de", "local_provenance", "NAT"),
        ("CIRSIUM ARVENSE", "lancaster.uk", "local_provenance", "NAT"),
        ("CIRSIUM ARVENSE", "smith.us", "local_provenance", "INT"),
        ("CAREX SP.", None, "functional_group", "GRAMINOID"),
    ],
)
