"""Shares, quantiles, correlations, distributions, sorting."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, clean, cover_max, followed, plot_meta, query, ranked, survey, table
from sward.operators import describe
from sward.operators.joins import first_per_key
from sward.operators.panel import eligible_series
from sward.operators.ranking import with_group_max
from sward.scale import join_on
from sward.session import pin


def series_traits(spark, sf_dir):
    """Mean rank percentile of each followed taxon with its traits."""
    base = pin(followed(spark, sf_dir))
    keys = ["site_code", "plot", "Taxon"]
    means = eligible_series(base, 0).groupBy(*keys, "max_year").agg(
        F.avg("perc_rank").alias("avg_rank")
    )
    traits = base.select(
        *keys, "initial_rel_cover", "local_lifespan", "site_rich_0", "trt"
    ).distinct()
    return join_on(means, traits, keys, "left")


@query("share_always_top", "AG8", sql="""
select trt, local_lifespan, count(*) as n,
  round(count_if(avg_rank = 1)::double / count(*), 6) as always_top,
  round(case when count_if(max_year >= 5) = 0 then null
    else count_if(avg_rank = 1 and max_year >= 5)::double / count_if(max_year >= 5) end, 6)
    as always_top_long
from series_traits group by 1, 2""")
def share_always_top(spark, sf_dir):
    top, all_rows, long = F.col("avg_rank") == 1, F.lit(True), F.col("max_year") >= 5
    return series_traits(spark, sf_dir).groupBy("trt", "local_lifespan").agg(
        F.count(F.lit(1)).alias("n"),
        describe.share_where(top, all_rows).alias("always_top"),
        describe.share_where(top, long).alias("always_top_long"),
    )


@query("share_of_leading_records", "AG8", sql="""
select trt, round(count_if(rank = 1)::double / count(*), 6) as top_share,
  round(count_if(rank = 1 and local_lifespan = 'ANNUAL')::double
    / count_if(local_lifespan = 'ANNUAL'), 6) as top_share_annual
from ranked group by 1""")
def share_of_leading_records(spark, sf_dir):
    top, annual = F.col("rank") == 1, F.col("local_lifespan") == "ANNUAL"
    return ranked(spark, sf_dir).groupBy("trt").agg(
        describe.share_where(top, F.lit(True)).alias("top_share"),
        describe.share_where(top, annual).alias("top_share_annual"),
    )


@query("conditional_means", "AG9", sql="""
select round(avg(case when rank = 1 then cover end), 6) as top_cover,
  round(avg(case when rank <> 1 then cover end), 6) as other_cover,
  round(avg(case when year_trt <> 0 then perc_rank end), 6) as later_rank from ranked""")
def conditional_means(spark, sf_dir):
    top = F.col("rank") == 1
    return ranked(spark, sf_dir).agg(
        describe.mean_where(top, F.col("cover")).alias("top_cover"),
        describe.mean_where(~top, F.col("cover")).alias("other_cover"),
        describe.mean_where(F.col("year_trt") != 0, F.col("perc_rank")).alias("later_rank"),
    )


@query("last_year_rows", "AG10", sql="""
select site_code, plot, year_trt, round(vascular_live_mass, 6) as vascular_live_mass from (
  select *, max(year_trt) over (partition by site_code) as max_year from plot_meta) t
where year_trt = max_year""")
def last_year_rows(spark, sf_dir):
    meta = pin(plot_meta(spark, sf_dir))
    last = with_group_max(meta, ["site_code"], "year_trt", "max_year")
    return last.filter("year_trt = max_year").select(
        "site_code", "plot", "year_trt", "vascular_live_mass"
    )


@query("pearson_correlation", "AG11", sql="""
select round(corr(cover, rich), 6) as r, cast(null as double) as r_constant from ranked""")
def pearson_correlation(spark, sf_dir):
    return ranked(spark, sf_dir).agg(
        describe.correlation(F.col("cover"), F.col("rich")).alias("r"),
        describe.correlation(F.col("cover"), F.col("live")).alias("r_constant"),
    ).withColumn("r_constant", F.col("r_constant").cast("double"))


@query("correlation_matrix", "AG12", sql="""
select x, y, round(r, 6) as r from (
  select a.name as x, b.name as y, corr(a.v, b.v) as r
  from (select site_code, unnest(['MAP_v2','MAP_VAR_v2','MAT_v2','mass']) as name,
      unnest([MAP_v2, MAP_VAR_v2, MAT_v2, vascular_live_mass]) as v from first_meta) a
  join (select site_code, unnest(['MAP_v2','MAP_VAR_v2','MAT_v2','mass']) as name,
      unnest([MAP_v2, MAP_VAR_v2, MAT_v2, vascular_live_mass]) as v from first_meta) b
  on a.site_code = b.site_code group by 1, 2) t""".replace("first_meta", """(
    select * from (select *, row_number() over (partition by site_code order by plot, year_trt)
      as rn from plot_meta) m where rn = 1)"""))
def correlation_matrix(spark, sf_dir):
    order = [F.col("plot"), F.col("year_trt")]
    sites = first_per_key(plot_meta(spark, sf_dir), ["site_code"], order)
    sites = sites.withColumnRenamed("vascular_live_mass", "mass")
    return describe.correlation_matrix(sites, ["MAP_v2", "MAP_VAR_v2", "MAT_v2", "mass"])


@query("covariate_quantiles", "AG13", "EM5", sql="""
select round(quantile_cont(cover, 0.05), 6) as low, round(quantile_cont(cover, 0.95), 6) as high
from ranked""")
def covariate_quantiles(spark, sf_dir):
    return describe.quantiles(ranked(spark, sf_dir), [], "cover", [0.05, 0.95], ["low", "high"])


@query("quantiles_split_groups", "AG13", "AG14", sql="""
select l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) as low,
  round(median(l_extendedprice), 6) as middle,
  round(quantile_cont(l_extendedprice, 0.95), 6) as high
from lineitem group by 1""")
def quantiles_split_groups(spark, sf_dir):
    # each flag holds a third of all rows
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    return describe.quantiles(
        rows, ["l_returnflag"], "l_extendedprice", [0.05, 0.5, 0.95], ["low", "middle", "high"]
    )


@query("value_range", "AG15", sql="""
select min(avg_cover) as minimum, max(avg_cover) as maximum from (
  select round(avg(cover), 6) as avg_cover from ranked where year_trt = 0
  group by site_code, Taxon) t""")
def value_range(spark, sf_dir):
    means = ranked(spark, sf_dir).filter("year_trt = 0").groupBy("site_code", "Taxon").agg(
        F.round(F.avg("cover"), 6).alias("avg_cover")
    )
    return describe.value_range(means, "avg_cover")


@query("histogram", "AG15", sql="""
select bin, round(lo + bin * width, 6) as bin_from, round(lo + (bin + 1) * width, 6) as bin_to,
  count(*) as n
from (select cast(least(floor((max_cover - lo) * 20 / (hi - lo)), 19) as bigint) as bin, lo,
    (hi - lo) / 20 as width
  from cover_max, (select min(max_cover) as lo, max(max_cover) as hi from cover_max) b) t
group by bin, lo, width""")
def histogram(spark, sf_dir):
    return describe.histogram(pin(cover_max(spark, sf_dir).select("max_cover")), "max_cover", 20)


@query("five_number_summary", "AG16", sql="""
select trt, local_lifespan, round(min(perc_rank), 6) as minimum,
  round(quantile_cont(perc_rank, 0.25), 6) as lower_quartile, round(median(perc_rank), 6) as median,
  round(quantile_cont(perc_rank, 0.75), 6) as upper_quartile, round(max(perc_rank), 6) as maximum
from ranked group by 1, 2""")
def five_number_summary(spark, sf_dir):
    return describe.five_numbers(ranked(spark, sf_dir), ["trt", "local_lifespan"], "perc_rank")


@query("normal_quantile_pairs", "AG17", sql="""
select p as prob, round(vs[lo + 1] + (h - lo) * (vs[least(lo + 2, len(vs))] - vs[lo + 1]), 6)
  as sample
from (select *, (len(vs) - 1) * p as h, cast(floor((len(vs) - 1) * p) as bigint) as lo
  from (select list_sort(list(rel_cover)) as vs from ranked) a,
    (select unnest(range(1, 20)) / 20.0::double as p) b) t""")
def normal_quantile_pairs(spark, sf_dir):
    pairs = describe.normal_qq(ranked(spark, sf_dir), "rel_cover", 19)
    return pairs.select("prob", "sample")


@query("least_squares_line", "LM13", sql="""
select round(regr_slope(cover, rich), 6) as slope, round(regr_intercept(cover, rich), 6)
  as intercept, round(regr_r2(cover, rich), 6) as r2
from (select distinct site_code, plot, round(cover, 9) as cover, rich from ranked
  where year_trt = 0) t""")
def least_squares_line(spark, sf_dir):
    rows = ranked(spark, sf_dir).filter("year_trt = 0").select(
        "site_code", "plot", F.round("cover", 9).alias("cover"), "rich"
    ).distinct()
    line = describe.least_squares_line(F.col("rich"), F.col("cover"))
    return rows.agg(*[column.alias(name) for name, column in line.items()])


@query("row_and_column_count", "SC5", sql="""
select count(*) as n_rows, 16::bigint as n_cols from survey""")
def row_and_column_count(spark, sf_dir):
    return describe.row_col_count(survey(spark, sf_dir))


@query("sorted_distinct_keys", "SR1", sql="""
select distinct site_code from clean where year_trt = 0 order by site_code""")
def sorted_distinct_keys(spark, sf_dir):
    return clean(spark, sf_dir).filter("year_trt = 0").select("site_code").distinct().orderBy(
        "site_code"
    )


@query("stable_order_by_key", "SR2", sql="""
select site_code, year_trt, plot, Taxon, rank from ranked
order by year_trt, site_code, plot, Taxon""")
def stable_order_by_key(spark, sf_dir):
    return ranked(spark, sf_dir).select(*KEY, "rank").orderBy("year_trt", "site_code", "plot", "Taxon")


@query("first_rows", "SR3", sql="""
select site_code, year_trt, plot, Taxon, max_cover from cover_max
order by site_code, plot, year_trt, Taxon limit 60""")
def first_rows(spark, sf_dir):
    rows = cover_max(spark, sf_dir).select(*KEY, "max_cover")
    return rows.orderBy("site_code", "plot", "year_trt", "Taxon").limit(60)
