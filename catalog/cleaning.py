"""Filters, joins, and rule-table cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import (
    KEY, clean, cover_max, followed, name_fix, panel, plot_meta, query, ranked, survey,
)
from sward.functions.predicates import (
    except_where, has_prefix, ifelse, ifelse_in, not_in, strict,
)
from sward.operators import joins, rules
from sward.operators.panel import baseline_cohort, eligible_series, empty_periods
from sward.operators.ranking import with_group_mean, with_group_size
from sward.session import pin

LINE = ["site_code", "plot", "year_trt", "Taxon", "ok", "pk"]


@query("filter_conjunction", "FL1", sql="""
select site_code, plot, year_trt, Taxon, ok, pk from survey
where live = 1 and functional_group not in ('BRYOPHYTE','LICHEN','LIVERWORT') and max_cover <> 0
  and year_trt >= 0""")
def filter_conjunction(spark, sf_dir):
    return clean(spark, sf_dir).filter(F.col("year_trt") >= 0).select(*LINE)


@query("filter_membership", "FL2", sql="""
select site_code, plot, year_trt, Taxon, ok, pk from survey
where trt in ('NPK','Fence') and not (local_lifespan in ('NULL','ANNUAL'))""")
def filter_membership(spark, sf_dir):
    rows = survey(spark, sf_dir).filter(F.col("trt").isin("NPK", "Fence"))
    return rows.filter(not_in(F.col("local_lifespan"), ["NULL", "ANNUAL"])).select(*LINE)


@query("filter_compound_exclusion", "FL3", sql="""
select site_code, plot, year_trt, Taxon, ok, pk from survey
where not (site_code = 'NATION_3' and block <> 1)
  and not (site_code = 'NATION_5' and strftime(date, '%m') in ('05','06'))""")
def filter_compound_exclusion(spark, sf_dir):
    month = F.date_format("date", "MM")
    rows = survey(spark, sf_dir).filter(
        except_where(F.col("site_code"), "NATION_3", F.col("block"), [1])
    )
    return rows.filter(~((F.col("site_code") == "NATION_5") & month.isin("05", "06"))).select(*LINE)


@query("filter_prefix", "FL4", sql="""
select site_code, plot, year_trt, Taxon, ok, pk from survey
where site_code = 'NATION_7' and substr(Taxon, 1, 8) = 'Brand#23'""")
def filter_prefix(spark, sf_dir):
    rows = survey(spark, sf_dir).filter(F.col("site_code") == "NATION_7")
    return rows.filter(has_prefix(F.col("Taxon"), "Brand#23")).select(*LINE)


@query("filter_null_test", "FL5", sql="""
select site_code, plot, Taxon, year_trt, rank is null as absent from panel
where site_code is not null""")
def filter_null_test(spark, sf_dir):
    rows = panel(spark, sf_dir)[2].filter(F.col("site_code").isNotNull())
    return rows.select("site_code", "plot", "Taxon", "year_trt", F.col("rank").isNull().alias("absent"))


@query("filter_exclusion_rules", "FL6", sql="""
select site_code, plot, year_trt, Taxon, ok, pk from survey
where site_code <> 'NATION_4' and Taxon not in ('Brand#9/SMALL','Brand#7/PROMO')""")
def filter_exclusion_rules(spark, sf_dir):
    exclude = [("site_code", "NATION_4"), ("Taxon", "Brand#9/SMALL"), ("Taxon", "Brand#7/PROMO")]
    return rules.exclude_values(survey(spark, sf_dir), exclude).select(*LINE)


@query("filter_long_series", "FL7", "PN5", sql="""
select site_code, plot, year_trt, Taxon, max_year, round(perc_rank, 6) as perc_rank from (
  select *, max(year_trt) over (partition by site_code) as max_year from followed) t
where max_year >= 5""")
def filter_long_series(spark, sf_dir):
    rows = eligible_series(pin(followed(spark, sf_dir)), 5)
    return rows.select("site_code", "plot", "year_trt", "Taxon", "max_year", "perc_rank")


@query("filter_outliers", "FL9", sql="""
select year, strftime(date, '%Y-%m-%d') as date, site_code, plot, Taxon, max_cover from survey
where max_cover > 48""")
def filter_outliers(spark, sf_dir):
    return survey(spark, sf_dir).filter(F.col("max_cover") > 48).select(
        "year", F.date_format("date", "yyyy-MM-dd").alias("date"), "site_code", "plot", "Taxon",
        "max_cover",
    )


def _eligible(meta):
    condition = (
        F.col("trt").isin("NPK", "Fence")
        & not_in(F.col("experiment_type"), ["Observational"])
        & (F.col("year_trt") >= 1)
    )
    return joins.eligible_keys(meta, "site_code", condition)


@query("semi_join_eligible_sites", "JN1", sql="""
select site_code, plot, year_trt, Taxon, ok, pk from survey where site_code in (
  select site_code from plot_meta where trt in ('NPK','Fence')
    and experiment_type <> 'Observational' and year_trt >= 1)""")
def semi_join_eligible_sites(spark, sf_dir):
    sites = _eligible(plot_meta(spark, sf_dir))
    return joins.keep_keys(survey(spark, sf_dir), sites, ["site_code"]).select(*LINE)


@query("semi_join_baseline_sites", "JN2", sql="""
select site_code, plot, year_trt, Taxon, ok, pk from survey where site_code in (
  select site_code from clean where year_trt = 0 and trt = 'Control')""")
def semi_join_baseline_sites(spark, sf_dir):
    start = clean(spark, sf_dir).filter((F.col("year_trt") == 0) & (F.col("trt") == "Control"))
    return joins.keep_keys(survey(spark, sf_dir), start, ["site_code"]).select(*LINE)


@query("anti_join_sites_without_baseline", "JN3", sql="""
select distinct site_code from plot_meta where site_code not in (
  select site_code from survey where year_trt = 0 and trt = 'Control')""")
def anti_join_sites_without_baseline(spark, sf_dir):
    start = survey(spark, sf_dir).filter((F.col("year_trt") == 0) & (F.col("trt") == "Control"))
    sites = plot_meta(spark, sf_dir).select("site_code").distinct()
    return joins.drop_keys(sites, start, ["site_code"])


@query("anti_join_composite_key", "JN4", sql="""
select s.site_code, s.plot, s.year_trt, s.Taxon, s.ok, s.pk from survey s where not exists (
  select 1 from (select site_code, year_trt from survey group by 1, 2
    having sum(max_cover) < 8000) z
  where z.site_code = s.site_code and z.year_trt = s.year_trt)""")
def anti_join_composite_key(spark, sf_dir):
    rows = survey(spark, sf_dir)
    thin = rows.groupBy("site_code", "year_trt").agg(F.sum("max_cover").alias("t")).filter("t < 8000")
    return joins.drop_keys(rows, thin, ["site_code", "year_trt"]).select(*LINE)


@query("left_join_name_recode", "JN5", sql="""
select c.site_code, c.plot, c.year_trt, coalesce(f.NewTaxon, c.Taxon) as Taxon, c.ok, c.pk
from cover_max c left join name_fix f on c.site_code = f.site_code and c.Taxon = f.Taxon""")
def left_join_name_recode(spark, sf_dir):
    fixes = name_fix(spark, sf_dir)
    rows = joins.recode_names(
        cover_max(spark, sf_dir), fixes, ["site_code", "Taxon"], "Taxon", "NewTaxon"
    )
    return rows.select(*LINE)


@query("left_join_taxon_attributes", "JN6", sql="""
select c.site_code, c.plot, c.year_trt, c.Taxon, c.ok, c.pk, l.local_lifespan, l.functional_group
from cover_max c left join (
  select Taxon, local_lifespan, functional_group from (
    select *, row_number() over (partition by Taxon
      order by site_code, year_trt, plot, ok, ln, pk, date) as rn from cover_max) t
  where rn = 1) l on c.Taxon = l.Taxon""")
def left_join_taxon_attributes(spark, sf_dir):
    base = pin(cover_max(spark, sf_dir))
    order = [F.col(c) for c in ["site_code", "year_trt", "plot", "ok", "ln", "pk", "date"]]
    return joins.first_lookup(
        base.select(*LINE), base, ["Taxon"], ["local_lifespan", "functional_group"], order
    )


@query("left_join_dominant_series", "JN7", sql="""
select c.site_code, c.plot, c.Taxon, r.year_trt, round(r.cover, 6) as cover, r.rank
from cohort c left join ranked r
  on c.site_code = r.site_code and c.plot = r.plot and c.Taxon = r.Taxon""")
def left_join_dominant_series(spark, sf_dir):
    base = pin(ranked(spark, sf_dir).select(*KEY, "cover", "max_cover", "rank"))
    keys = ["site_code", "plot", "Taxon"]
    series = base.select(*keys, "year_trt", "cover", "rank")
    return joins.left_lookup(baseline_cohort(base).select(*keys), series, keys)


@query("left_join_zero_fill", "JN8", sql="""
select p.site_code, p.plot, p.Taxon, p.year_trt, round(coalesce(f.plotfreq, 0), 6) as plotfreq
from panel p left join (
  select site_code, Taxon, year_trt, count(distinct plot) / 10.0::double as plotfreq from ranked
  group by 1, 2, 3) f
on p.site_code = f.site_code and p.Taxon = f.Taxon and p.year_trt = f.year_trt""")
def left_join_zero_fill(spark, sf_dir):
    base, _, filled = panel(spark, sf_dir)
    keys = ["site_code", "Taxon", "year_trt"]
    freq = base.groupBy(*keys).agg((F.countDistinct("plot") / F.lit(10.0)).alias("plotfreq"))
    rows = joins.left_lookup_filled(filled, freq, keys, {"plotfreq": 0.0})
    return rows.select("site_code", "plot", "Taxon", "year_trt", "plotfreq")


@query("left_join_chain", "JN9", "PN4", sql="""
select site_code, plot, Taxon, year_trt, trt, round(cover, 6) as cover,
  round(perc_rank, 6) as perc_rank, local_lifespan, local_provenance, func_simple,
  round(avgCover, 6) as avgCover, MAP_v2, initial_live_mass,
  round(initial_litter_mass, 6) as initial_litter_mass, site_rich_0,
  cast(NPK as bigint) as NPK, cast(Fence as bigint) as Fence from followed""")
def left_join_chain(spark, sf_dir):
    return followed(spark, sf_dir).select(
        "site_code", "plot", "Taxon", "year_trt", "trt", "cover", "perc_rank", "local_lifespan",
        "local_provenance", "func_simple", "avgCover", "MAP_v2", "initial_live_mass",
        "initial_litter_mass", "site_rich_0", "NPK", "Fence",
    )


@query("left_join_first_climate", "JN10", sql="""
select s.site_code, s.plot, s.year_trt, s.Taxon, s.ok, s.pk, m.MAP_v2, m.MAT_v2 from survey s
left join (select site_code, MAP_v2, MAT_v2 from (
  select *, row_number() over (partition by site_code order by plot, year_trt) as rn
  from plot_meta) t where rn = 1) m on s.site_code = m.site_code""")
def left_join_first_climate(spark, sf_dir):
    order = [F.col("plot"), F.col("year_trt")]
    return joins.first_lookup(
        survey(spark, sf_dir).select(*LINE), plot_meta(spark, sf_dir), ["site_code"],
        ["MAP_v2", "MAT_v2"], order,
    )


@query("left_join_baseline_biomass", "JN11", sql="""
select s.ok, s.pk, s.plot, s.max_cover, m.vascular_live_mass as initial_live_mass,
  round(m.litter_mass, 6) as initial_litter_mass
from survey s left join plot_meta m on s.site_code = m.site_code and s.plot = m.plot
  and m.year_trt = 0""")
def left_join_baseline_biomass(spark, sf_dir):
    mass = plot_meta(spark, sf_dir).filter("year_trt = 0").select(
        "site_code", "plot", F.col("vascular_live_mass").alias("initial_live_mass"),
        F.col("litter_mass").alias("initial_litter_mass"),
    )
    rows = survey(spark, sf_dir).select("site_code", "ok", "pk", "plot", "max_cover")
    return joins.left_lookup(rows, mass, ["site_code", "plot"]).drop("site_code")


@query("left_join_site_richness", "JN12", sql="""
select r.site_code, r.plot, r.year_trt, r.Taxon, s.site_rich_0 from ranked r
left join site_richness_0 s on r.site_code = s.site_code""")
def left_join_site_richness(spark, sf_dir):
    base = pin(ranked(spark, sf_dir).select("site_code", "plot", "year_trt", "Taxon"))
    richness = base.filter("year_trt = 0").groupBy("site_code").agg(
        F.countDistinct("Taxon").alias("site_rich_0")
    )
    return joins.left_lookup(base, richness, ["site_code"])


@query("left_join_natural", "JN13", sql="""
select a.site_code, a.plot, a.Taxon, round(a.avg_rank, 6) as avg_rank, t.trt, t.local_lifespan
from (select site_code, plot, Taxon, avg(perc_rank) as avg_rank from ranked group by 1, 2, 3) a
left join (select distinct site_code, plot, Taxon, trt, local_lifespan from ranked) t
using (site_code, plot, Taxon)""")
def left_join_natural(spark, sf_dir):
    base = pin(ranked(spark, sf_dir).select("site_code", "plot", "Taxon", "perc_rank", "trt",
                                            "local_lifespan"))
    means = base.groupBy("site_code", "plot", "Taxon").agg(F.avg("perc_rank").alias("avg_rank"))
    traits = base.select("site_code", "plot", "Taxon", "trt", "local_lifespan").distinct()
    return joins.natural_left_join(means, traits)


@query("value_recode_scoped", "RC1", sql="""
select site_code, plot, Taxon, ok, pk,
  case when site_code = 'NATION_8' and year_trt = 1 then 0 else year_trt end as year_trt
from survey""")
def value_recode_scoped(spark, sf_dir):
    fix = {"column": "year_trt", "op": "==", "match": 1, "new": 0, "scope": {"site_code": "NATION_8"}}
    return rules.repair_values(survey(spark, sf_dir), [fix]).select(*LINE)


@query("category_collapse", "RC2", sql="""
select ok, pk, case when functional_group in ('GRASS','GRAMINOID') then 'GRAMINOID'
  else functional_group end as functional_group,
  case when functional_group = 'GRAMINOID' then 'Graminoid' else 'Non-graminoid' end as func_simple,
  case when local_lifespan in ('PERENNIAL','INDETERMINATE','NULL') then 'PERENNIAL'
  else 'ANNUAL' end as local_lifespan from survey""")
def category_collapse(spark, sf_dir):
    group, life = F.col("functional_group"), F.col("local_lifespan")
    return survey(spark, sf_dir).select(
        "ok", "pk", rules.collapse(group, ["GRASS", "GRAMINOID"], "GRAMINOID")
        .alias("functional_group"),
        ifelse(group == "GRAMINOID", "Graminoid", "Non-graminoid").alias("func_simple"),
        ifelse_in(life, ["PERENNIAL", "INDETERMINATE", "NULL"], "PERENNIAL", "ANNUAL")
        .alias("local_lifespan"),
    )


@query("taxon_merge_rules", "RC3", sql="""
select ok, pk, case when site_code = 'NATION_1' and substr(Taxon, 1, 7) = 'Brand#1' then 'Brand SP.'
  when site_code = 'NATION_2' and Taxon in ('Brand#3/LARGE','Brand#4/LARGE') then 'Brand#4/LARGE'
  else Taxon end as Taxon, count(*) over (partition by site_code, year) as n from survey""")
def taxon_merge_rules(spark, sf_dir):
    merge = [
        {"site": "NATION_1", "prefix": "Brand#1", "new": "Brand SP."},
        {"site": "NATION_2", "names": ["Brand#3/LARGE", "Brand#4/LARGE"], "new": "Brand#4/LARGE"},
    ]
    merged = rules.merge_taxa(survey(spark, sf_dir), merge)
    return with_group_size(merged, ["site_code", "year"], "n").select("ok", "pk", "Taxon", "n")


@query("outlier_repair_in_order", "RC4", sql="""
select ok, pk, plot, case when c = 12 then 6 else c end as max_cover from (
  select *, case when b = 30 then 12::double else b end as c from (
    select *, case when a > 45 then 30::double else a end as b from (
      select *, case when max_cover = 49 then 10::double else max_cover end as a from survey) x
    ) y) z""")
def outlier_repair_in_order(spark, sf_dir):
    steps = [
        {"column": "max_cover", "op": "==", "match": 49, "new": 10},
        {"column": "max_cover", "op": ">", "match": 45, "new": 30},
        {"column": "max_cover", "op": "==", "match": 30, "new": 12},
        {"column": "max_cover", "op": "==", "match": 12, "new": 6},
    ]
    return rules.repair_values(survey(spark, sf_dir), steps).select("ok", "pk", "plot", "max_cover")


@query("attribute_overrides", "RC5", sql="""
select ok, pk, plot, case when Taxon = 'Brand#1/PROMO' and site_code = 'NATION_2' then 'NAT'
  when Taxon in ('Brand#1/PROMO','Brand#1/LARGE') then 'INT' else local_provenance end
  as local_provenance,
  case when Taxon in ('Brand#1/PROMO','Brand#2/PROMO') then 'PERENNIAL' else local_lifespan end
  as local_lifespan from survey""")
def attribute_overrides(spark, sf_dir):
    overrides = [
        ("Brand#1/PROMO", None, "local_provenance", "INT"),
        ("Brand#1/LARGE", None, "local_provenance", "INT"),
        ("Brand#1/PROMO", "NATION_2", "local_provenance", "NAT"),
        ("Brand#1/PROMO", None, "local_lifespan", "PERENNIAL"),
        ("Brand#2/PROMO", None, "local_lifespan", "PERENNIAL"),
    ]
    return rules.override_attributes(survey(spark, sf_dir), overrides).select(
        "ok", "pk", "plot", "local_provenance", "local_lifespan"
    )


@query("sentinel_audit", "RC6", sql="""
select 'local_lifespan' as "column", local_lifespan as sentinel, count(*) as n_rows,
  count(distinct Taxon) as n_taxa from survey where local_lifespan in ('NULL','UNK') group by 1, 2
union all
select 'local_provenance', local_provenance, count(*), count(distinct Taxon) from survey
where local_provenance in ('NULL','UNK') group by 1, 2""")
def sentinel_audit(spark, sf_dir):
    return rules.sentinel_audit(
        survey(spark, sf_dir), ["local_lifespan", "local_provenance"], ["NULL", "UNK"]
    )


@query("low_high_labels_by_site", "RC11", "AG14", sql="""
select site_code, plot, Taxon, year_trt,
  case when cover < median(cover) over (partition by site_code) then 'Low Initial Cover'
    else 'High Initial Cover' end as initial_cover,
  case when rich < median(rich) over (partition by site_code) then 'Low site richness'
    else 'High site richness' end as richness from ranked""")
def low_high_labels_by_site(spark, sf_dir):
    base = pin(ranked(spark, sf_dir).select(*KEY, "cover", "rich"))
    labelled = rules.low_high_label(
        base,
        {
            "cover": ("initial_cover", "Low Initial Cover", "High Initial Cover"),
            "rich": ("richness", "Low site richness", "High site richness"),
        },
    )
    return labelled.select("site_code", "plot", "Taxon", "year_trt", "initial_cover", "richness")


@query("low_high_labels_overall", "RC11", sql="""
select site_code, plot, Taxon, year_trt, case when cover < (select median(cover) from ranked)
  then 'Low' else 'High' end as cover_level from ranked""")
def low_high_labels_overall(spark, sf_dir):
    base = pin(ranked(spark, sf_dir).select(*KEY, "cover"))
    rows = rules.low_high_label(base, {"cover": ("cover_level", "Low", "High")}, by=[])
    return rows.select("site_code", "plot", "Taxon", "year_trt", "cover_level")


@query("append_modified_copies", "ST1", sql="""
select site_code, plot, year, year_trt, Taxon, max_cover from survey
union all
select site_code, plot, year, 3, Taxon, 60.0::double from survey
where site_code = 'NATION_6' and substr(Taxon, 1, 8) = 'Brand#12' and year_trt = 2""")
def append_modified_copies(spark, sf_dir):
    rule = {
        "select": {"site_code": "NATION_6", "Taxon": "Brand#12*", "year_trt": 2},
        "set": {"year_trt": 3, "max_cover": 60.0},
    }
    rows = survey(spark, sf_dir).select("site_code", "plot", "year", "year_trt", "Taxon", "max_cover")
    return rules.append_copies(rows, [rule])


@query("sum_after_name_merge", "AG1", sql="""
select site_code, block, plot, trt, year, year_trt, Taxon, live, sum(max_cover) as max_cover from (
  select c.site_code, cast(c.block as bigint) as block, c.plot, c.trt, c.year, c.year_trt,
    coalesce(f.NewTaxon, c.Taxon) as Taxon, cast(c.live as bigint) as live, c.max_cover
  from cover_max c left join name_fix f on c.site_code = f.site_code and c.Taxon = f.Taxon) t
group by all""")
def sum_after_name_merge(spark, sf_dir):
    rows = joins.recode_names(
        cover_max(spark, sf_dir), name_fix(spark, sf_dir), ["site_code", "Taxon"], "Taxon",
        "NewTaxon",
    )
    keys = ["site_code", "block", "plot", "trt", "year", "year_trt", "Taxon", "live"]
    cover = F.col("max_cover")
    return rows.groupBy(*keys).agg(strict(F.sum(cover), cover).alias("max_cover"))


@query("mean_by_group", "AG2", sql="""
select site_code, plot, Taxon, max_year, round(avg_rank, 6) as avg_rank from series""")
def mean_by_group(spark, sf_dir):
    rows = eligible_series(pin(followed(spark, sf_dir)), 0)
    return rows.groupBy("site_code", "plot", "Taxon", "max_year").agg(
        F.avg("perc_rank").alias("avg_rank")
    )


@query("sum_with_having", "AG3", "PN2", sql="""
select site_code, year_trt, sum(cover) as total from panel group by 1, 2 having sum(cover) = 0""")
def sum_with_having(spark, sf_dir):
    return empty_periods(panel(spark, sf_dir)[2], ["site_code", "year_trt"], "cover")


@query("count_by_group", "AG4", sql="""
select site_code, year, Taxon, count(*) as n from survey where substr(Taxon, 1, 7) = 'Brand#2'
group by 1, 2, 3""")
def count_by_group(spark, sf_dir):
    rows = survey(spark, sf_dir).filter(has_prefix(F.col("Taxon"), "Brand#2"))
    return rows.groupBy("site_code", "year", "Taxon").agg(F.count(F.lit(1)).alias("n"))


@query("distinct_taxa_per_site", "AG5", sql="""
select site_code, site_rich_0 from site_richness_0""")
def distinct_taxa_per_site(spark, sf_dir):
    start = ranked(spark, sf_dir).filter("year_trt = 0")
    return start.groupBy("site_code").agg(F.countDistinct("Taxon").alias("site_rich_0"))


@query("distinct_rows", "AG6", sql="""
select distinct site_code, plot, trt, Taxon, local_lifespan from survey""")
def distinct_rows(spark, sf_dir):
    return survey(spark, sf_dir).select("site_code", "plot", "trt", "Taxon", "local_lifespan").distinct()


@query("mean_join_back", "WN8", sql="""
select ok, pk, plot, round(avg(max_cover) over (partition by site_code, Taxon), 6) as mean_cover
from clean""")
def mean_join_back(spark, sf_dir):
    rows = with_group_mean(clean(spark, sf_dir), ["site_code", "Taxon"], "max_cover", "mean_cover")
    return rows.select("ok", "pk", "plot", "mean_cover")
