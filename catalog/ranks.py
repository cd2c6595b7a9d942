"""Totals, ranks, richness and leading taxa."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import KEY, TIE_ORDER, clean, cover_max, plot_meta, query, ranked, table
from sward.operators.joins import first_per_key, repeats_per_key
from sward.operators.ranking import (
    in_tied_groups, rebreak_ties, top_one, top_ties, value_at_max, with_change_from_first,
    with_distinct_count, with_group_max, with_group_mean, with_group_size, with_plot_frequency,
    with_rank, with_rank_percentile, with_share,
)
from sward.scale import join_on
from sward.session import pin

PLOT_YEAR = ["site_code", "year_trt", "plot"]


@query("largest_cover_per_key", "WN9", sql="""
select site_code, year_trt, plot, Taxon, max_cover, ok, cast(ln as bigint) as ln, pk
from cover_max""")
def largest_cover_per_key(spark, sf_dir):
    rows = top_one(clean(spark, sf_dir), KEY, "max_cover", [F.col(c) for c in TIE_ORDER])
    return rows.select(*KEY, "max_cover", "ok", "ln", "pk")


@query("group_max_year", "WN1", sql="""
select site_code, plot, Taxon, year_trt, ok, pk, max(year_trt) over (partition by site_code)
  as max_year from clean""")
def group_max_year(spark, sf_dir):
    rows = with_group_max(clean(spark, sf_dir), ["site_code"], "year_trt", "max_year")
    return rows.select("site_code", "plot", "Taxon", "year_trt", "ok", "pk", "max_year")


@query("relative_cover", "WN2", sql="""
select site_code, year_trt, plot, Taxon,
  round(max_cover / sum(max_cover) over (partition by site_code, year_trt, plot), 6) as rel_cover
from cover_max""")
def relative_cover(spark, sf_dir):
    rows = with_share(cover_max(spark, sf_dir), PLOT_YEAR, "max_cover", "rel_cover")
    return rows.select(*KEY, "rel_cover")


@query("competition_rank", "WN3", sql="""
select site_code, year_trt, plot, Taxon,
  rank() over (partition by site_code, year_trt, plot order by max_cover desc) as rank
from cover_max""")
def competition_rank(spark, sf_dir):
    return with_rank(cover_max(spark, sf_dir), PLOT_YEAR, "max_cover").select(*KEY, "rank")


@query("competition_rank_split_groups", "WN3", sql="""
select l_returnflag, l_orderkey, l_partkey, l_suppkey, l_extendedprice,
  rank() over (partition by l_returnflag order by l_extendedprice desc) as rank
from lineitem""")
def competition_rank_split_groups(spark, sf_dir):
    # each flag holds a third of all rows, and is split into runs
    rows = table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    return with_rank(rows, ["l_returnflag"], "l_extendedprice", run_rows=5_000)


@query("plot_richness", "WN4", sql="""
select site_code, year_trt, plot, Taxon,
  count(*) over (partition by site_code, year_trt, plot) as rich from cover_max""")
def plot_richness(spark, sf_dir):
    return with_group_size(cover_max(spark, sf_dir), PLOT_YEAR, "rich").select(*KEY, "rich")


@query("rank_percentile", "WN5", "PJ6", "FN10", sql="""
select site_code, year_trt, plot, Taxon, round(rel_cover, 6) as rel_cover, rank, rich,
  round(perc_rank, 6) as perc_rank from ranked""")
def rank_percentile(spark, sf_dir):
    rows = with_rank_percentile(cover_max(spark, sf_dir).filter("year_trt >= 0"), PLOT_YEAR, "max_cover", dealt=False)
    return rows.select(*KEY, "rel_cover", "rank", "rich", "perc_rank")


@query("distinct_plots", "WN6", sql="""
select r.site_code, r.year_trt, r.plot, r.Taxon, a.nplots, b.nplot from ranked r
join (select site_code, count(distinct plot) as nplots from ranked group by 1) a
  on r.site_code = a.site_code
join (select site_code, Taxon, year_trt, count(distinct plot) as nplot from ranked group by 1, 2, 3)
  b on r.site_code = b.site_code and r.Taxon = b.Taxon and r.year_trt = b.year_trt""")
def distinct_plots(spark, sf_dir):
    base = pin(ranked(spark, sf_dir).select(*KEY))
    rows = with_distinct_count(base, ["site_code"], "plot", "nplots")
    return with_distinct_count(rows, ["site_code", "Taxon", "year_trt"], "plot", "nplot")


@query("plot_frequency", "WN7", sql="""
select r.site_code, r.year_trt, r.plot, r.Taxon, round(b.nplot / a.nplots, 6) as plotfreq_yr
from ranked r
join (select site_code, count(distinct plot) as nplots from ranked group by 1) a
  on r.site_code = a.site_code
join (select site_code, Taxon, year_trt, count(distinct plot) as nplot from ranked group by 1, 2, 3)
  b on r.site_code = b.site_code and r.Taxon = b.Taxon and r.year_trt = b.year_trt""")
def plot_frequency(spark, sf_dir):
    return with_plot_frequency(pin(ranked(spark, sf_dir).select(*KEY))).select(*KEY, "plotfreq_yr")


@query("baseline_means", "WN8", sql="""
select site_code, plot, Taxon,
  round(avg(cover) over (partition by site_code, Taxon), 6) as avgCover,
  round(avg(perc_rank) over (partition by site_code, Taxon), 6) as avgRankPerc
from ranked where year_trt = 0""")
def baseline_means(spark, sf_dir):
    start = ranked(spark, sf_dir).filter("year_trt = 0")
    rows = with_group_mean(start, ["site_code", "Taxon"], "cover", "avgCover")
    rows = with_group_mean(rows, ["site_code", "Taxon"], "perc_rank", "avgRankPerc")
    return rows.select("site_code", "plot", "Taxon", "avgCover", "avgRankPerc")


@query("initial_dominants", "WN10", "PN3", sql="""
select site_code, plot, Taxon, round(initial_rel_cover, 6) as initial_rel_cover,
  initial_abs_cover from cohort""")
def initial_dominants(spark, sf_dir):
    start = ranked(spark, sf_dir).filter("year_trt = 0")
    return top_ties(start, ["site_code", "plot"], "max_cover").select(
        "site_code", "plot", "Taxon", F.col("cover").alias("initial_rel_cover"),
        F.col("max_cover").alias("initial_abs_cover"),
    )


@query("first_dominant_by_argmax", "WN11", sql="""
select site_code, plot, max(max_cover) as max_cover,
  round(arg_max(cover, ok * 1000000 + pk), 6) as last_order_cover
from ranked where year_trt = 0 group by 1, 2""")
def first_dominant_by_argmax(spark, sf_dir):
    start = ranked(spark, sf_dir).filter("year_trt = 0")
    stamped = start.withColumn("stamp", F.col("ok") * 1000000 + F.col("pk"))
    last = value_at_max(stamped, ["site_code", "plot"], "stamp", ["cover"])
    best = stamped.groupBy("site_code", "plot").agg(F.max("max_cover").alias("max_cover"))
    return join_on(best, last, ["site_code", "plot"], "left").withColumnRenamed(
        "cover", "last_order_cover"
    )


@query("tied_dominants", "WN12", sql="""
select site_code, plot, Taxon, round(initial_rel_cover, 6) as initial_rel_cover
from cohort qualify count(*) over (partition by site_code, plot) > 1""")
def tied_dominants(spark, sf_dir):
    start = ranked(spark, sf_dir).filter("year_trt = 0")
    tops = pin(
        top_ties(start, ["site_code", "plot"], "max_cover").select(
            "site_code", "plot", "Taxon", F.col("cover").alias("initial_rel_cover")
        )
    )
    return in_tied_groups(tops, ["site_code", "plot"])


@query("ties_rebroken_next_year", "WN12", sql="""
select site_code, plot, Taxon, max_cover from (
  select t.site_code, t.plot, t.Taxon, r.max_cover,
    rank() over (partition by t.site_code, t.plot order by r.max_cover desc nulls last) as top
  from (select * from cohort qualify count(*) over (partition by site_code, plot) > 1) t
  left join (select * from ranked where year_trt = 1) r
    on t.site_code = r.site_code and t.plot = r.plot and t.Taxon = r.Taxon) x
where top = 1""")
def ties_rebroken_next_year(spark, sf_dir):
    base = pin(ranked(spark, sf_dir).select(*KEY, "max_cover"))
    plot = ["site_code", "plot"]
    tops = top_ties(base.filter("year_trt = 0"), plot, "max_cover").select(*plot, "Taxon")
    later = base.filter("year_trt = 1")
    return rebreak_ties(in_tied_groups(pin(tops), plot), later, plot, [*plot, "Taxon"], "max_cover")


@query("change_from_first_year", "WN14", sql="""
select year_trt, round(m, 6) as mean_cover, round(m - first_value(m) over (order by year_trt), 6)
  as change
from (select year_trt, avg(cover) as m from ranked group by 1) t""")
def change_from_first_year(spark, sf_dir):
    means = ranked(spark, sf_dir).groupBy("year_trt").agg(F.avg("cover").alias("mean_cover"))
    return with_change_from_first(means, "mean_cover", "year_trt", "change")


@query("first_row_per_taxon", "AG7", sql="""
select Taxon, site_code, plot, local_lifespan, ok, pk from (
  select *, row_number() over (partition by Taxon
    order by site_code, year_trt, plot, ok, ln, pk, date) as rn from cover_max) t where rn = 1""")
def first_row_per_taxon(spark, sf_dir):
    order = [F.col(c) for c in ["site_code", "year_trt", "plot", *TIE_ORDER]]
    rows = first_per_key(cover_max(spark, sf_dir), ["Taxon"], order)
    return rows.select("Taxon", "site_code", "plot", "local_lifespan", "ok", "pk")


@query("repeat_rows_per_site", "AG7", "AG12", sql="""
select site_code, plot, year_trt, round(vascular_live_mass, 6) as vascular_live_mass from (
  select *, row_number() over (partition by site_code order by plot, year_trt) as rn
  from plot_meta) t where rn > 1""")
def repeat_rows_per_site(spark, sf_dir):
    meta = pin(plot_meta(spark, sf_dir).select("site_code", "plot", "year_trt",
                                               "vascular_live_mass"))
    return repeats_per_key(meta, ["site_code"], ["plot", "year_trt"])
