"""Physical plans, the cohort plan on a tiny survey, and queries against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import catalog.base as base
from sward.operators import ranking
from sward.plans import cohort as cohort_plan
from sward.plans.cohort import CohortRules, build_cohort
from sward.plans.decay import full_design
from sward.plans.grassland_rules import GRASSLAND
from sward.session import measured_broadcasts, pin
from sward.sources.schemas import COVER, NAME_FIX, PLOT_META

SF = os.environ.get("SWARD_TEST_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem".split()
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@needs_data
def test_scan_reads_only_needed_columns(spark):
    text = plan(base.cover_max(spark, SF).select("site_code", "max_cover"))
    assert "l_extendedprice" not in text and "s_acctbal" not in text
    assert "Cartesian" not in text


@needs_data
def test_top_row_is_limited_before_the_shuffle(spark):
    text = plan(base.cover_max(spark, SF))
    assert "WindowGroupLimit" in text and "Partial" in text


@needs_data
def test_rank_chain_shuffles_once_after_the_top_row(spark):
    rows = ranking.with_rank_percentile(
        base.cover_max(spark, SF), ["site_code", "year_trt", "plot"], "max_cover"
    )
    # the rows are shuffled once, by run; what else is shuffled by group are the runs' counts
    exchanges = [line for line in plan(rows).splitlines() if "Exchange hashpartitioning(site_code" in line]
    assert sum("__salt" in line for line in exchanges) == 1 and len(exchanges) == 3


QUICK = [
    "initial_dominants", "rank_percentile", "completed_panel", "left_join_chain",
    "cohort_from_raw_cover", "competition_rank_split_groups", "quantiles_split_groups",
    "sum_after_name_merge", "share_always_top", "interval_flags", "csv_round_trip",
]


@needs_data
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    cursor = connection.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    expected = sorted((tuple(map(str, row)) for row in cursor.fetchall()))
    df = entry_points.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    got = sorted(tuple(str(row[c]) for c in columns) for row in df.collect())
    assert [g for g, e in zip(got, expected) if g != e] == []
    assert len(got) == len(expected)


def test_every_statement_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    # the text operators are no items of the inventory
    assert all(base.OPERATORS[name] for name in base.QUERIES)


def test_full_design_has_64_columns():
    design = full_design()
    assert len(design.names) == 64
    assert len(design.without("MAP_v2").names) == 56


def tiny(spark):
    def cover(site, plot, year_trt, taxon, value, **other):
        row = {
            "site_code": site, "block": 1, "plot": plot, "subplot": "A", "trt": "NPK" if plot == 2 else "Control",
            "year": 2010 + year_trt, "year_trt": year_trt, "date": f"{2010 + year_trt}-07-01", "Taxon": taxon,
            "live": 1, "functional_group": "GRASS", "max_cover": value, "local_lifespan": "PERENNIAL",
            "local_provenance": "NAT",
        }
        return row | other

    rows = [
        cover("s", 1, 0, "A", 50.0), cover("s", 1, 0, "B", 50.0), cover("s", 1, 0, "C", 10.0),
        cover("s", 1, 0, "A", 20.0, date="2010-05-01"),
        cover("s", 1, 2, "B", 30.0), cover("s", 1, 2, "C", 60.0),
        cover("s", 2, 0, "D", 5.0, local_lifespan="BIENNIAL"), cover("s", 2, 2, "D", 9.0),
        cover("s", 2, 0, "MOSS", 90.0, functional_group="BRYOPHYTE"),
        cover("s", 1, 0, "E", 5.0, functional_group=None),
        cover("u", 1, 1, "A", 40.0),
    ]
    meta = [
        {"site_code": s, "plot": p, "trt": t, "experiment_type": "Experimental", "year_trt": y,
         "MAP_v2": 500.0, "vascular_live_mass": 10.0 + p}
        for s in ("s", "u") for p, t in ((1, "Control"), (2, "NPK")) for y in (0, 2)
    ]
    names = [{"site_code": "s", "Taxon": "C", "NewTaxon": "B"}]

    def frame(data, schema):
        fields = spark.createDataFrame([], schema).schema
        return spark.createDataFrame([tuple(r.get(f.name) for f in fields) for r in data], fields)

    return frame(rows, COVER), frame(meta, PLOT_META), frame(names, NAME_FIX)


def test_cohort_of_a_tiny_survey(spark):
    built = build_cohort(*tiny(spark), CohortRules())
    rows = built.cohort.orderBy("plot", "Taxon", "year_trt").collect()
    # C is renamed to B, so B leads plot 1 alone; year 1 was never sampled; u has no year 0
    assert [(r["plot"], r["Taxon"], r["year_trt"], r["perc_rank"]) for r in rows] == [
        (1, "B", 0, 1.0), (1, "B", 2, 1.0), (2, "D", 0, 1.0), (2, "D", 2, 1.0)]
    first = rows[0]
    # the row without a functional group is kept
    assert first["initial_abs_cover"] == 60.0
    assert first["initial_rel_cover"] == pytest.approx(60.0 / 115.0)
    assert first["site_rich_0"] == 4 and first["initial_live_mass"] == 11.0
    assert rows[2]["local_lifespan"] == "ANNUAL" and rows[2]["NPK"] == 1
    site = built.sites.collect()
    assert [(r["site_code"], r["max_year"], r["site_rich_0"]) for r in site] == [("s", 2, 4)]


def test_fixed_rules_run(spark):
    built = build_cohort(*tiny(spark), GRASSLAND)
    assert built.cohort.filter(F.col("Taxon") == "FORB SP.").count() == 0
    assert built.cohort.count() == 4


THRESHOLDS = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_rows_much_larger_than_their_files_are_not_broadcast(spark):
    # 200,000 rows of one name: files of some KB, rows of some MB
    rows = pin(spark.range(200_000).select((F.col("id") % 1000).alias("k"), F.lit("x" * 40).alias("name")))
    few = pin(spark.range(10).select(F.col("id").alias("k"), (F.col("id") + 1).alias("y")))
    spark.conf.set(THRESHOLDS[0], "1m")
    try:
        assert "BroadcastHashJoin" in plan(few.join(rows, "k", "left"))
        with measured_broadcasts(spark):
            assert [spark.conf.get(key) for key in THRESHOLDS] == ["32768", "1048576"]
            large, small = few.join(rows, "k", "left"), rows.join(few, "k", "left")
            assert "BroadcastHashJoin" not in plan(large) and "BroadcastHashJoin" in plan(small)
            # and measured rows stay below the threshold
            assert large.count() == 2000 and "BroadcastHashJoin" not in plan(large).split("Initial Plan")[0]
        assert [spark.conf.get(key, None) for key in THRESHOLDS] == ["1m", None]
        spark.conf.set(THRESHOLDS[1], "5m")
        with pytest.raises(ZeroDivisionError), measured_broadcasts(spark):
            assert [spark.conf.get(key) for key in THRESHOLDS] == ["32768", "5m"]
            1 / 0
        assert [spark.conf.get(key) for key in THRESHOLDS] == ["1m", "5m"]
        spark.conf.set(THRESHOLDS[0], "-1")
        with measured_broadcasts(spark):
            assert [spark.conf.get(key) for key in THRESHOLDS] == ["-1", "5m"]
    finally:
        for key in THRESHOLDS:
            spark.conf.unset(key)


def test_cohort_reads_its_cover_once_and_broadcasts_no_table_by_the_size_of_its_files(spark, monkeypatch):
    cover, meta, names = tiny(spark)
    stored, plans = pin(cover), []
    place = os.path.basename(os.path.dirname(stored.inputFiles()[0]))

    def recorded(df):
        plans.append(plan(df))
        return pin(df)

    monkeypatch.setattr(cohort_plan, "pin", recorded)
    # the room of a few of these tables' files; a thirtieth of it is less than any of them has
    spark.conf.set(THRESHOLDS[0], "6k")
    try:
        built = build_cohort(stored, meta, names, CohortRules())
    finally:
        spark.conf.unset(THRESHOLDS[0])
    assert built.cohort.count() == 4
    assert sum(text.count(place) for text in plans) == 1
    assert not any("BroadcastHashJoin" in text for text in plans)
