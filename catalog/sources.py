"""Readers and writers; the files are written from the driver's tables."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from catalog.base import name_fix, plot_meta, query, survey
from sward.operators.describe import row_col_count
from sward.session import shared_dir
from sward.sources.files import latest_file, read_survey, write_table
from sward.sources.schemas import NAME_FIX

_COVER = "site_code string, plot long, year_trt long, Taxon string, max_cover double, ok long"


def _folder(spark):
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


@query("csv_round_trip", "SC1", "SC4", sql="""
select site_code, plot, year_trt, case when live = 1 then Taxon end as Taxon, max_cover, ok
from survey""")
def csv_round_trip(spark, sf_dir):
    rows = survey(spark, sf_dir).select(
        "site_code", "plot", "year_trt", F.when(F.col("live") == 1, F.col("Taxon")).alias("Taxon"),
        "max_cover", "ok",
    )
    return read_survey(spark, write_table(rows, _folder(spark), "cover"), _COVER)


@query("parquet_round_trip", "SC1", "SC4", sql="""
select site_code, plot, year_trt, Taxon, max_cover, ok from survey""")
def parquet_round_trip(spark, sf_dir):
    rows = survey(spark, sf_dir).select("site_code", "plot", "year_trt", "Taxon", "max_cover", "ok")
    return read_survey(spark, write_table(rows, _folder(spark), "cover", "parquet"), _COVER,
                       "parquet")


@query("name_recode_file", "SC2", sql="select site_code, Taxon, NewTaxon from name_fix")
def name_recode_file(spark, sf_dir):
    path = write_table(name_fix(spark, sf_dir), _folder(spark), "names")
    return read_survey(spark, path, NAME_FIX)


@query("latest_extract", "SC3", sql="""
select site_code, plot, year_trt, round(vascular_live_mass, 6) as vascular_live_mass,
  '2023-06-28' as extracted from plot_meta""")
def latest_extract(spark, sf_dir):
    folder = _folder(spark)
    meta = plot_meta(spark, sf_dir).select("site_code", "plot", "year_trt", "vascular_live_mass")
    for day in (datetime.date(2023, 6, 28), datetime.date(2022, 10, 10)):
        extract = meta.withColumn("extracted", F.lit(day.isoformat()))
        write_table(extract, folder, "plots", date=day)
    path = latest_file(spark, folder, "plots_*")
    schema = "site_code string, plot long, year_trt long, vascular_live_mass double, extracted string"
    return read_survey(spark, path, schema)


@query("table_profile", "SC5", sql="""
select count(*) as n_rows, 11::bigint as n_cols from plot_meta""")
def table_profile(spark, sf_dir):
    return row_col_count(plot_meta(spark, sf_dir))
