"""Threshold crossings, pivots and flags on the observed decay curve."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import followed, query
from sward.operators.crossing import (
    crossing_times, flag_against_control, flag_against_level, pivot_treatments,
)
from sward.operators.describe import mean_where
from sward.operators.report import stack_tables
from sward.scale import join_on
from sward.session import pin


def observed_curve(rows, by):
    """Mean rank percentile per year with a two standard error band."""
    mean = F.avg("perc_rank")
    error = F.stddev_samp("perc_rank") / F.sqrt(F.count(F.lit(1)))
    return rows.groupBy(*by, "year_trt").agg(
        mean.alias("mean_btrans"), (mean + 2 * error).alias("upper_btrans"),
        (mean - 2 * error).alias("lower_btrans"),
    )


def times(spark, sf_dir, by):
    return times_of(pin(followed(spark, sf_dir)), by)


def times_of(rows, by):
    """Crossing times of the curves of ``rows``, a stored table."""
    cutoff = rows.agg(mean_where(F.col("year_trt") != 0, F.col("perc_rank")).alias("cutoff"))
    curve = join_on(observed_curve(rows, by), cutoff, [], "left")
    return crossing_times(curve, by, "year_trt", F.col("cutoff"))


def _times_sql(source, by):
    return f"""select {by}, coalesce(min(case when mean_btrans < cut then year_trt end),
    max(year_trt)) as mean_time,
  coalesce(min(case when upper_btrans < cut then year_trt end), max(year_trt)) as upper_time,
  coalesce(min(case when lower_btrans < cut then year_trt end), max(year_trt)) as lower_time
from {source}, cutoff group by {by}"""


_BY_TRT = _times_sql("curve", "trt")
_BY_LIFE = _times_sql("life_curve", "local_lifespan, trt")


@query("crossing_times", "WN13", "EM4", sql=_BY_TRT)
def crossing_times_by_treatment(spark, sf_dir):
    return times(spark, sf_dir, ["trt"])


@query("pivot_treatments", "PV1", sql=f"""
select local_lifespan, max(case when trt = 'Control' then mean_time end) as Control,
  max(case when trt = 'Fence' then mean_time end) as Fence,
  max(case when trt = 'NPK' then mean_time end) as NPK,
  max(case when trt = 'NPK+Fence' then mean_time end) as "NPK+Fence"
from ({_BY_LIFE}) t group by local_lifespan""")
def pivot_treatments_by_lifespan(spark, sf_dir):
    rows = times(spark, sf_dir, ["local_lifespan", "trt"])
    return pivot_treatments(rows, ["local_lifespan"], "mean_time")


_FLAG = """cast(t.mean_time as varchar) || case when t.trt <> 'Control'
    and (c.mean_time > t.upper_time or c.mean_time < t.lower_time) then '*' else '' end"""


@query("interval_flags", "PV2", sql=f"""
with t as ({_BY_TRT}), c as (select * from t where trt = 'Control')
select t.trt, t.mean_time, {_FLAG} as text from t left join c on true""")
def interval_flags(spark, sf_dir):
    rows = pin(times(spark, sf_dir, ["trt"]))
    return flag_against_control(rows, []).select("trt", "mean_time", "text")


@query("level_flags", "PV3", sql=f"""
with t as ({_BY_LIFE}), c as (select * from t where trt = 'Control'),
b as (select * from t where local_lifespan = 'Annual')
select t.local_lifespan, t.trt, {_FLAG} || case when t.local_lifespan <> 'Annual'
  and (t.mean_time > b.upper_time or t.mean_time < b.lower_time) then '†' else '' end as text
from t left join c on t.local_lifespan = c.local_lifespan left join b on t.trt = b.trt""")
def level_flags(spark, sf_dir):
    rows = pin(times(spark, sf_dir, ["local_lifespan", "trt"]))
    starred = flag_against_control(rows, ["local_lifespan"])
    flagged = flag_against_level(starred, F.col("local_lifespan") == "Annual")
    return flagged.select("local_lifespan", "trt", "text")


@query("stacked_persistence_table", "PV4", "ST2", sql=f"""
with t as (select 'Average' as Predictor, * from ({_BY_TRT}) a
  union all select * from ({_BY_LIFE}) b)
select Predictor, max(case when trt = 'Control' then cast(mean_time as varchar) end) as Control,
  max(case when trt = 'Fence' then cast(mean_time as varchar) end) as Fence,
  max(case when trt = 'NPK' then cast(mean_time as varchar) end) as NPK,
  max(case when trt = 'NPK+Fence' then cast(mean_time as varchar) end) as "NPK+Fence"
from t group by Predictor""")
def stacked_persistence_table(spark, sf_dir):
    followed_rows = pin(followed(spark, sf_dir))
    average = times_of(followed_rows, ["trt"]).withColumn("Predictor", F.lit("Average"))
    lifespan = times_of(followed_rows, ["local_lifespan", "trt"]).withColumnRenamed(
        "local_lifespan", "Predictor"
    )
    tables = [
        pivot_treatments(rows.withColumn("text", F.col("mean_time").cast("string")),
                         ["Predictor"], "text")
        for rows in (average, lifespan)
    ]
    return stack_tables(tables)
