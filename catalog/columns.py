"""Projection, reshaping of columns, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import cover_max, followed, panel, plot_meta, query, ranked, survey
from sward.functions import scalar
from sward.functions.predicates import ifelse, ifelse_in
from sward.operators.report import (
    all_to_text, effect_block, relocate_before, rename_matching, unite, with_level_order,
)

@query("select_columns", "PJ1", sql="select site_code, plot, Taxon, max_cover from survey")
def select_columns(spark, sf_dir):
    return survey(spark, sf_dir).select("site_code", "plot", "Taxon", "max_cover")


@query("drop_column", "PJ2", sql="""
select * exclude (litter_mass) replace (round(vascular_live_mass, 6) as vascular_live_mass)
from plot_meta""")
def drop_column(spark, sf_dir):
    return plot_meta(spark, sf_dir).drop("litter_mass")


@query("rename_columns", "PJ3", sql="""
select site_code as site, plot, Taxon as species, max_cover as abundance from survey""")
def rename_columns(spark, sf_dir):
    rows = survey(spark, sf_dir).select("site_code", "plot", "Taxon", "max_cover")
    return rows.withColumnsRenamed(
        {"site_code": "site", "Taxon": "species", "max_cover": "abundance"}
    )


@query("rename_by_pattern", "PJ4", sql="""
select site_code, plot, MAP_v2 as MAPv2, MAP_VAR_v2 as MAPVAR_v2 from plot_meta""")
def rename_by_pattern(spark, sf_dir):
    rows = plot_meta(spark, sf_dir).select("site_code", "plot", "MAP_v2", "MAP_VAR_v2")
    return rename_matching(rows, "map", "_", "")


@query("relocate_column", "PJ5", sql="select max_cover, site_code, plot, Taxon from survey")
def relocate_column(spark, sf_dir):
    rows = survey(spark, sf_dir).select("site_code", "plot", "Taxon", "max_cover")
    return relocate_before(rows, "max_cover", "site_code")


@query("derived_columns", "PJ6", "FN10", sql="""
select site_code, plot, year_trt, round(litter_mass / vascular_live_mass, 6) as litter_share,
  round(vascular_live_mass + litter_mass, 6) as total_mass,
  round(MAP_v2 * MAP_VAR_v2 - MAT_v2, 6) as index_value, MAP_v2 > 900 as wet
from plot_meta""")
def derived_columns(spark, sf_dir):
    live, litter = F.col("vascular_live_mass"), F.col("litter_mass")
    return plot_meta(spark, sf_dir).select(
        "site_code", "plot", "year_trt",
        F.try_divide(litter, live).alias("litter_share"),
        (live + litter).alias("total_mass"),
        (F.col("MAP_v2") * F.col("MAP_VAR_v2") - F.col("MAT_v2")).alias("index_value"),
        (F.col("MAP_v2") > 900).alias("wet"),
    )


@query("unite_columns", "PJ7", sql="""
select Taxon, concat_ws(',', site_code, cast(plot as varchar)) as DF, max_cover from survey""")
def unite_columns(spark, sf_dir):
    rows = survey(spark, sf_dir).select("site_code", "plot", "Taxon", "max_cover")
    return unite(rows, "DF", ["site_code", "plot"], ",")


@query("all_columns_to_text", "PJ9", "FN11", sql="""
select site_code, cast(plot as varchar) as plot, cast(year_trt as varchar) as year_trt,
  cast(cast(n as bigint) as varchar) as n
from (select site_code, plot, year_trt, count(*) as n from survey group by 1, 2, 3) t""")
def all_columns_to_text(spark, sf_dir):
    counts = survey(spark, sf_dir).groupBy("site_code", "plot", "year_trt").agg(
        F.count(F.lit(1)).alias("n")
    )
    return all_to_text(counts)


@query("text_to_number", "FN11", sql="""
select site_code, Taxon, cast(regexp_extract(Taxon, '([0-9]+)', 1) as bigint) as brand_no,
  cast(cast(max_cover as bigint) as varchar) as cover_text from cover_max""")
def text_to_number(spark, sf_dir):
    return cover_max(spark, sf_dir).select(
        "site_code", "Taxon", F.regexp_extract("Taxon", "([0-9]+)", 1).cast("long").alias("brand_no"),
        F.col("max_cover").cast("long").cast("string").alias("cover_text"),
    )


@query("ordered_category", "PJ10", sql="""
select site_code, plot, trt, cast(case trt when 'Control' then 1 when 'Fence' then 2
  when 'NPK' then 3 when 'NPK+Fence' then 4 end as bigint) as trt_order
from (select distinct site_code, plot, trt from survey) t""")
def ordered_category(spark, sf_dir):
    plots = survey(spark, sf_dir).select("site_code", "plot", "trt").distinct()
    return with_level_order(plots, "trt", list(scalar.TREATMENTS), "trt_order")


@query("substring_of_date", "FN1", sql="""
select ok, pk, substr(strftime(date, '%Y-%m-%d'), 6, 2) as month, substr(Taxon, 1, 5) as head
from survey""")
def substring_of_date(spark, sf_dir):
    day = F.date_format("date", "yyyy-MM-dd")
    return survey(spark, sf_dir).select(
        "ok", "pk", scalar.substr_between(day, 6, 7).alias("month"),
        scalar.substr_between(F.col("Taxon"), 1, 5).alias("head"),
    )


@query("pasted_keys", "FN2", sql="""
select site_code || '_' || cast(year_trt as varchar) as id, site_code || '.' || cast(plot as varchar)
  as plot_id, coalesce(cast(rank as varchar), 'NA') as rank_text from panel""")
def pasted_keys(spark, sf_dir):
    return panel(spark, sf_dir)[2].select(
        scalar.paste(F.col("site_code"), F.col("year_trt"), sep="_").alias("id"),
        scalar.paste(F.col("site_code"), F.col("plot"), sep=".").alias("plot_id"),
        scalar.paste(F.col("rank")).alias("rank_text"),
    )


@query("regex_functions", "FN3", "FL8", sql="""
select ok, pk, replace(Taxon, 'Brand#', 'B') as short_name,
  regexp_replace(local_lifespan, 'ENN', 'enn') as life, regexp_matches(Taxon, 'Brand#1[0-9]/S')
  as in_teens
from survey where regexp_matches(Taxon, '(SMALL|LARGE)$')""")
def regex_functions(spark, sf_dir):
    rows = survey(spark, sf_dir).filter(F.col("Taxon").rlike("(SMALL|LARGE)$"))
    return rows.select(
        "ok", "pk", F.regexp_replace("Taxon", "Brand#", "B").alias("short_name"),
        F.regexp_replace("local_lifespan", "ENN", "enn").alias("life"),
        F.col("Taxon").rlike("Brand#1[0-9]/S").alias("in_teens"),
    )


@query("conditional_values", "FN4", sql="""
select site_code, plot, Taxon, year_trt,
  case when rank is null then null when rank = 1 then 'top' else 'lower' end as place,
  case when rank in (1, 2) then 'lead' else 'rest' end as lead
from panel""")
def conditional_values(spark, sf_dir):
    return panel(spark, sf_dir)[2].select(
        "site_code", "plot", "Taxon", "year_trt",
        ifelse(F.col("rank") == 1, "top", "lower").alias("place"),
        ifelse_in(F.col("rank"), [1, 2], "lead", "rest").alias("lead"),
    )


@query("rounding", "FN5", sql="""
select site_code, plot, year_trt, round_even(vascular_live_mass / 8, 1) as half_even,
  round(round_even(vascular_live_mass * pow(10.0, 1 - floor(log10(vascular_live_mass))), 0)
    / pow(10.0, 1 - floor(log10(vascular_live_mass))), 6) as two_digits
from plot_meta where vascular_live_mass > 0""")
def rounding(spark, sf_dir):
    live = F.col("vascular_live_mass")
    return plot_meta(spark, sf_dir).filter(live > 0).select(
        "site_code", "plot", "year_trt",
        scalar.round_even(live / 8, 1).alias("half_even"),
        scalar.signif(live, 2).alias("two_digits"),
    )


@query("p_value_text", "FN6", sql="""
select site_code, year_trt, plot, Taxon,
  case when round_even(p, 3) = 0 then '< 0.001' else 'shown' end as rounded_text,
  case when p_signif <= 0.001 then '< 0.001' else 'shown' end as signif_text
from (select *, round_even(p * pow(10.0, 1 - floor(log10(p))), 0)
    / pow(10.0, 1 - floor(log10(p))) as p_signif
  from (select *, pow(rel_cover, 4) as p from ranked) a) b""")
def p_value_text(spark, sf_dir):
    rows = ranked(spark, sf_dir).withColumn("p", F.pow("rel_cover", F.lit(4.0)))

    def shown(text):
        return F.when(text == "< 0.001", text).otherwise("shown")

    return rows.select(
        "site_code", "year_trt", "plot", "Taxon",
        shown(scalar.p_text_rounded(F.col("p"))).alias("rounded_text"),
        shown(scalar.p_text_signif(F.col("p"))).alias("signif_text"),
    )


@query("logit_of_clamped_rank", "FN7", sql="""
select site_code, plot, Taxon, year_trt, round(adj, 6) as rank_adj,
  round(ln(adj / (1 - adj)), 6) as rank_logit
from (select *, case when perc_rank = 1 then 0.99::double when perc_rank = 0 then 0.01::double
  else perc_rank end as adj from panel) t""")
def logit_of_clamped_rank(spark, sf_dir):
    adjusted = scalar.clamp_unit(F.col("perc_rank"))
    return panel(spark, sf_dir)[2].select(
        "site_code", "plot", "Taxon", "year_trt", adjusted.alias("rank_adj"),
        scalar.logit(adjusted).alias("rank_logit"),
    )


@query("inverse_logit", "FN8", sql="""
select site_code, year_trt, plot, Taxon, round(1 / (1 + exp(-(rel_cover * 10 - 1))), 6) as p
from ranked""")
def inverse_logit(spark, sf_dir):
    return ranked(spark, sf_dir).select(
        "site_code", "year_trt", "plot", "Taxon",
        scalar.invlogit(F.col("rel_cover") * 10 - 1).alias("p"),
    )


@query("arcsine_transform", "FN9", sql="""
select site_code, year_trt, plot, Taxon, round(asin(sqrt(perc_rank)), 6) as rank_as,
  round(pow(sin(asin(sqrt(perc_rank))), 2), 6) as back from ranked""")
def arcsine_transform(spark, sf_dir):
    angle = scalar.arcsine_root(F.col("perc_rank"))
    return ranked(spark, sf_dir).select(
        "site_code", "year_trt", "plot", "Taxon", angle.alias("rank_as"),
        scalar.arcsine_root_inverse(angle).alias("back"),
    )


@query("percent_change_to_control", "FN12", sql="""
select site_code, year_trt, round(-100 * (1 - fence / control), 6) as fence_change,
  case when fence is null or control is null then null
    else cast(cast(fence as bigint) as varchar) || ' (' ||
    cast(cast(-100 * (1 - fence / control) as bigint) as varchar) || '%)' end as fence_text
from (select site_code, year_trt, sum(max_cover) filter (trt = 'Fence') as fence,
    sum(max_cover) filter (trt = 'Control') as control from survey group by 1, 2) t""")
def percent_change_to_control(spark, sf_dir):
    sums = survey(spark, sf_dir).groupBy("site_code", "year_trt").agg(
        F.sum(F.when(F.col("trt") == "Fence", F.col("max_cover"))).alias("fence"),
        F.sum(F.when(F.col("trt") == "Control", F.col("max_cover"))).alias("control"),
    )
    change = scalar.percent_change(F.col("fence"), F.col("control"))
    whole = F.concat(
        F.col("fence").cast("long").cast("string"), F.lit(" ("),
        F.bround(change, 0).cast("long").cast("string"), F.lit("%)"),
    )
    return sums.select("site_code", "year_trt", change.alias("fence_change"),
                       whole.alias("fence_text"))


@query("year_grid_in_tenths", "FN13", "JN14", sql="""
select site_code, trt, t / 10.0::double as year_trt from (
  select site_code, trt, unnest(range(0, 10 * last + 1)) as t from (
    select site_code, trt, max(year_trt) as last from survey group by 1, 2) a) b""")
def year_grid_in_tenths(spark, sf_dir):
    last = survey(spark, sf_dir).groupBy("site_code", "trt").agg(F.max("year_trt").alias("last"))
    steps = last.select("site_code", "trt", F.explode(F.sequence(F.lit(0), F.col("last") * 10))
                        .alias("t"))
    return steps.select("site_code", "trt", (F.col("t") / F.lit(10.0)).alias("year_trt"))


@query("dummy_codes", "RC7", sql="""
select site_code, plot, trt, case when trt in ('NPK','NPK+Fence') then 1::bigint else 0 end as NPK,
  case when trt in ('Fence','NPK+Fence') then 1::bigint else 0 end as Fence
from (select distinct site_code, plot, trt from survey) t""")
def dummy_codes(spark, sf_dir):
    plots = survey(spark, sf_dir).select("site_code", "plot", "trt").distinct()
    return plots.withColumns(
        {"NPK": scalar.npk_flag(F.col("trt")), "Fence": scalar.fence_flag(F.col("trt"))}
    )


@query("treatment_labels", "RC8", sql="""
select site_code, plot, Taxon, year_trt, case when NPK = 0 and Fence = 0 then 'Control'
  when NPK = 0 and Fence = 1 then 'Fence' when NPK = 1 and Fence = 0 then 'NPK'
  when NPK = 1 and Fence = 1 then 'NPK+Fence' end as label,
  case when NPK = 1 and Fence = 1 then 'No' else 'Yes' end as sig from followed""")
def treatment_labels(spark, sf_dir):
    label = scalar.treatment_label(F.col("NPK"), F.col("Fence"))
    return followed(spark, sf_dir).select(
        "site_code", "plot", "Taxon", "year_trt", label.alias("label"),
        ifelse(label == "NPK+Fence", "No", "Yes").alias("sig"),
    )


@query("relabel_by_regex", "RC9", sql="""
select ok, pk, replace(replace(local_lifespan, 'ANNUAL', 'Annual'), 'PERENNIAL', 'Perennial')
  as lifespan, replace(replace(local_provenance, 'NAT', 'Native'), 'INT', 'Non-native') as provenance
from survey""")
def relabel_by_regex(spark, sf_dir):
    return survey(spark, sf_dir).select(
        "ok", "pk",
        scalar.relabel(F.col("local_lifespan"), {"ANNUAL": "Annual", "PERENNIAL": "Perennial"})
        .alias("lifespan"),
        scalar.relabel(F.col("local_provenance"), {"NAT": "Native", "INT": "Non-native"})
        .alias("provenance"),
    )


@query("ordered_patterns", "RC10", sql="""
select Taxon, cast(case when Taxon like '%Brand#1%' then 2 when Taxon like '%SMALL%' then 3
  when Taxon like '%LARGE%' then 4 else 1 end as bigint) as block
from (select distinct Taxon from survey) t""")
def ordered_patterns(spark, sf_dir):
    taxa = survey(spark, sf_dir).select("Taxon").distinct()
    blocks = [("Brand#1", 2), ("SMALL", 3), ("LARGE", 4)]
    return taxa.withColumn("block", effect_block(F.col("Taxon"), blocks))
