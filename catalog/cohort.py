"""Panels, cohort tables and site summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    clean, followed, name_fix, panel, plot_meta, query, survey,
)
from sward.operators.panel import complete_panel, drop_empty_periods, unit_summary
from sward.operators.report import stack_tables
from sward.plans.cohort import CohortRules, build_cohort
from sward.session import pin


@query("completed_panel", "PN1", "JN14", sql="""
select site_code, plot, Taxon, max_year, year_trt, round(cover, 6) as cover, max_cover,
  round(perc_rank, 6) as perc_rank, rank from panel""")
def completed_panel(spark, sf_dir):
    return panel(spark, sf_dir)[2]


@query("completed_panel_out_of_range", "PN1", sql="""
select coalesce(e.site_code, r.site_code) as site_code, coalesce(e.plot, r.plot) as plot,
  coalesce(e.year_trt, r.year_trt) as year_trt, coalesce(r.n, 0) as n
from (select site_code, plot, unnest(range(0, 4)) as year_trt
    from (select distinct site_code, plot from clean) d) e
full join (select site_code, plot, year_trt, count(*) as n from clean group by 1, 2, 3) r
  on e.site_code = r.site_code and e.plot = r.plot and e.year_trt = r.year_trt""")
def completed_panel_out_of_range(spark, sf_dir):
    # the range ends at year 3 although the data go on
    counts = clean(spark, sf_dir).groupBy("site_code", "plot", "year_trt").agg(
        F.count(F.lit(1)).alias("n")
    ).withColumn("last", F.lit(3))
    filled = complete_panel(counts, ["site_code"], ["plot"], "year_trt", "last", {"n": 0})
    return filled.select("site_code", "plot", "year_trt", "n")


@query("panel_without_unsampled_years", "PN2", "JN4", sql="""
select site_code, plot, Taxon, year_trt, round(cover, 6) as cover from kept_panel""")
def panel_without_unsampled_years(spark, sf_dir):
    filled = panel(spark, sf_dir)[2]
    kept = drop_empty_periods(filled, ["site_code", "year_trt"], "cover")
    return kept.select("site_code", "plot", "Taxon", "year_trt", "cover")


@query("site_summary", "PN6", "AG10", sql="""
select m.site_code, m.max_year, m.continent, m.experiment_type, m.MAP_v2, m.MAP_VAR_v2,
  r.site_rich_0
from (select * from (select *, row_number() over (partition by site_code order by plot) as rn
    from (select *, max(year_trt) over (partition by site_code) as max_year from plot_meta) a
    where year_trt = max_year) b where rn = 1) m
left join site_richness_0 r on m.site_code = r.site_code
where m.site_code in (select site_code from followed)""")
def site_summary(spark, sf_dir):
    table = pin(followed(spark, sf_dir))
    richness = table.select("site_code", "site_rich_0").distinct()
    return unit_summary(
        pin(plot_meta(spark, sf_dir)), table, richness,
        ["continent", "experiment_type", "MAP_v2", "MAP_VAR_v2"], [F.col("plot")],
    )


def _cover_table(spark, sf_dir):
    return survey(spark, sf_dir).withColumns(
        {"subplot": F.lit("A"), "date": F.date_format("date", "yyyy-MM-dd")}
    )


def _meta_table(spark, sf_dir):
    missing = ["site_richness", "TEMP_VAR_v2", "latitude", "longitude"]
    return plot_meta(spark, sf_dir).withColumns(
        {name: F.lit(None).cast("double") for name in missing}
        | {"site_name": F.col("site_code"), "country": F.col("continent")}
    )


_FULL = """
with eligible as (select distinct site_code from plot_meta where trt in ('NPK','Fence')
    and experiment_type <> 'Observational' and year_trt >= 1),
rows1 as (select s.* replace (
      case when site_code = 'NATION_8' and year_trt = 1 then 0 else year_trt end as year_trt)
    from survey s where site_code in (select site_code from eligible)),
rows2 as (select *, max(year_trt) over (partition by site_code) as max_year from rows1
    where site_code in (select site_code from rows1 where year_trt = 0)
      and site_code <> 'NATION_4' and live = 1
      and functional_group not in ('BRYOPHYTE','LICHEN','LIVERWORT') and max_cover <> 0),
rows3 as (select * replace (
      case when functional_group in ('GRASS','GRAMINOID') then 'GRAMINOID'
        else functional_group end as functional_group,
      case when site_code = 'NATION_1' and Taxon like 'Brand#1%' then 'Brand SP.'
        else Taxon end as Taxon,
      case when max_cover > 45 then 30 else max_cover end as max_cover)
    from rows2 where not (site_code = 'NATION_3' and block <> 1)),
tops as (select * exclude (rn) from (select *, row_number() over (
      partition by site_code, year_trt, plot, Taxon order by max_cover desc, ok, ln, pk, date)
      as rn from rows3) t where rn = 1),
merged as (select t.site_code, t.block, t.plot, t.trt, t.year, t.year_trt, t.max_year,
      coalesce(f.NewTaxon, t.Taxon) as Taxon, sum(t.max_cover) as max_cover
    from tops t left join name_fix f on t.site_code = f.site_code and t.Taxon = f.Taxon
    group by all),
traits as (select Taxon, local_provenance, functional_group, local_lifespan from (
      select *, row_number() over (partition by Taxon
        order by site_code, year_trt, plot, ok, ln, pk, date) as rn from tops) t where rn = 1),
rk as (select m.*, t.local_provenance, t.functional_group, t.local_lifespan,
      (rich + 1 - rank) / rich as perc_rank
    from (select *, rank() over (partition by site_code, year_trt, plot order by cover desc) as rank
      from (select *, max_cover / sum(max_cover) over w as cover, count(*) over w as rich
        from merged window w as (partition by site_code, year_trt, plot)) a) m
    left join traits t on m.Taxon = t.Taxon where year_trt >= 0),
start as (select *, avg(cover) over (partition by site_code, Taxon) as avgCover from rk
    where year_trt = 0),
doms as (select site_code, plot, Taxon, cover as initial_rel_cover,
      max_cover as initial_abs_cover from (
      select *, rank() over (partition by site_code, plot order by max_cover desc) as top
      from start) t where top = 1),
grid as (select distinct d.site_code, d.plot, d.Taxon, r.max_year,
      unnest(range(0, r.max_year + 1)) as year_trt
    from doms d join rk r on d.site_code = r.site_code and d.plot = r.plot and d.Taxon = r.Taxon),
filled as (select g.*, coalesce(r.cover, 0) as cover, coalesce(r.max_cover, 0) as max_cover,
      coalesce(r.perc_rank, 0) as perc_rank
    from grid g left join rk r on g.site_code = r.site_code and g.plot = r.plot
      and g.Taxon = r.Taxon and g.year_trt = r.year_trt),
kept as (select * from filled where (site_code, year_trt) not in (
      select (site_code, year_trt) from filled group by site_code, year_trt having sum(cover) = 0)),
site_rich as (select site_code, count(distinct Taxon) as site_rich_0 from rk where year_trt = 0
    group by 1)
select d.site_code, d.plot, d.Taxon, round(d.initial_rel_cover, 6) as initial_rel_cover,
  d.initial_abs_cover, k.year_trt, round(k.cover, 6) as cover, k.max_cover,
  round(k.perc_rank, 6) as perc_rank, s.trt,
  case when s.Taxon = 'Brand#1/SMALL' and s.site_code = 'NATION_9' then 'NAT'
    when s.Taxon = 'Brand#1/SMALL' then 'INT' else s.local_provenance end as local_provenance,
  case when s.local_lifespan in ('PERENNIAL','INDETERMINATE','NULL') then 'PERENNIAL'
    else 'ANNUAL' end as local_lifespan,
  s.functional_group, round(s.avgCover, 6) as avgCover, c.MAP_v2,
  b.vascular_live_mass as initial_live_mass, round(b.litter_mass, 6) as initial_litter_mass,
  case when s.trt in ('NPK','NPK+Fence') then 1::bigint else 0 end as NPK,
  case when s.trt in ('Fence','NPK+Fence') then 1::bigint else 0 end as Fence, q.site_rich_0
from doms d left join kept k on d.site_code = k.site_code and d.plot = k.plot and d.Taxon = k.Taxon
left join start s on d.site_code = s.site_code and d.plot = s.plot and d.Taxon = s.Taxon
left join climate c on d.site_code = c.site_code
left join (select * from plot_meta where year_trt = 0) b
  on d.site_code = b.site_code and d.plot = b.plot
left join site_rich q on d.site_code = q.site_code
where s.trt in ('Control','NPK','Fence','NPK+Fence') and d.Taxon <> 'Brand#7/SMALL'"""

DEMO_RULES = CohortRules(
    year_repairs=[{"column": "year_trt", "op": "==", "match": 1, "new": 0,
                   "scope": {"site_code": "NATION_8"}}],
    dropped_sites=["NATION_4"],
    row_exclusions=[{"column": "site_code", "value": "NATION_3", "other": "block", "kept": [1]}],
    taxon_merges=[{"site": "NATION_1", "prefix": "Brand#1", "new": "Brand SP."}],
    cover_repairs=[{"column": "max_cover", "op": ">", "match": 45, "new": 30}],
    dropped_taxa=["Brand#7/SMALL"],
    overrides=[("Brand#1/SMALL", None, "local_provenance", "INT"),
               ("Brand#1/SMALL", "NATION_9", "local_provenance", "NAT")],
)


@query("cohort_from_raw_cover", "PN3", "PN4", "JN9", "JN11", "RC5", sql=_FULL)
def cohort_from_raw_cover(spark, sf_dir):
    built = build_cohort(
        _cover_table(spark, sf_dir), _meta_table(spark, sf_dir), name_fix(spark, sf_dir),
        DEMO_RULES, tie_order=["ok", "ln", "pk", "date"],
    )
    return built.cohort.select(
        "site_code", "plot", "Taxon", "initial_rel_cover", "initial_abs_cover", "year_trt",
        "cover", "max_cover", "perc_rank", "trt", "local_provenance", "local_lifespan",
        "functional_group", "avgCover", "MAP_v2", "initial_live_mass", "initial_litter_mass",
        "NPK", "Fence", "site_rich_0",
    )


@query("stacked_tables", "ST2", sql="""
select 'site' as kind, site_code, cast(null as bigint) as plot, count(*) as n from survey
  group by site_code
union all select 'plot', site_code, plot, count(*) from survey group by site_code, plot""")
def stacked_tables(spark, sf_dir):
    rows = survey(spark, sf_dir)
    counts = [
        rows.groupBy("site_code").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit("site")),
        rows.groupBy("site_code", "plot").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("kind", F.lit("plot")),
    ]
    return stack_tables(counts).select("kind", "site_code", "plot", "n")
