"""Binding of the driver's tables to a community survey, and the query registry.

site = nation, plot = supplier, taxon = brand/type, year = ship year - 1995, cover =
quantity. Every table below has a DataFrame form and a SQL form of the same name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sward.functions.predicates import not_in
from sward.operators.joins import left_lookup
from sward.operators.panel import baseline_cohort, complete_panel, drop_empty_periods
from sward.operators.ranking import top_one, with_group_mean, with_rank_percentile
from sward.scale import join_on
from sward.session import pin, tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
OPERATORS: dict[str, tuple[str, ...]] = {}

KEY = ["site_code", "year_trt", "plot", "Taxon"]
# The plot first: numbers are sorted faster than names with one beginning.
PLOT_YEAR = ["plot", "year_trt", "site_code"]
# Unique per survey row at every scale.
TIE_ORDER = ["ok", "ln", "pk", "date"]


def query(name: str, *operators: str, sql: str | None = None):
    """Register a query; ``sql`` may use the tables of ``TABLES`` by name."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(tune(spark), sf_dir))

        QUERIES[name] = run
        OPERATORS[name] = operators
        if sql is not None:
            SQL[name] = with_tables(sql)
        return build

    return register


def plain(df: DataFrame) -> DataFrame:
    """Round doubles to 6 places and widen integers, for comparison across engines."""
    columns = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DoubleType):
            column = F.round(column, 6)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("long")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def treatment(plot):
    kind = plot % 4
    return (
        F.when(kind == 0, "Control").when(kind == 1, "NPK").when(kind == 2, "Fence")
        .otherwise("NPK+Fence")
    )


def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long cover table, one row per shipment line."""
    line = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    site = table(spark, sf_dir, "supplier").join(
        table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")
    )
    joined = line.join(part, line.l_partkey == part.p_partkey).join(
        site, line.l_suppkey == site.s_suppkey
    )
    kind, brand = F.col("p_type"), F.col("p_brand")
    return joined.select(
        F.col("n_name").alias("site_code"),
        (F.col("l_suppkey") % 3).cast("int").alias("block"),
        F.col("l_suppkey").alias("plot"),
        treatment(F.col("l_suppkey")).alias("trt"),
        F.year("l_shipdate").cast("long").alias("year"),
        (F.year("l_shipdate") - 1995).cast("long").alias("year_trt"),
        F.col("l_shipdate").alias("date"),
        F.concat(brand, F.lit("/"), kind).alias("Taxon"),
        F.col("l_quantity").alias("max_cover"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("live"),
        F.when(kind == "PROMO", "NULL").when(kind == "ECONOMY", "ANNUAL")
        .when(kind == "SMALL", "INDETERMINATE").otherwise("PERENNIAL").alias("local_lifespan"),
        F.when(brand == "Brand#1", "UNK")
        .when(brand.isin("Brand#2", "Brand#3", "Brand#4", "Brand#5"), "INT")
        .otherwise("NAT").alias("local_provenance"),
        F.when(kind == "LARGE", "GRASS").when(kind == "MEDIUM", "GRAMINOID")
        .when(kind == "SMALL", "FORB").when(kind == "PROMO", "LEGUME")
        .when(kind == "ECONOMY", "WOODY").otherwise("BRYOPHYTE").alias("functional_group"),
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
    )


def plot_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot-year side table: treatment, climate, biomass."""
    line = table(spark, sf_dir, "lineitem")
    sums = line.groupBy("l_suppkey", (F.year("l_shipdate") - 1995).alias("year_trt")).agg(
        F.sum("l_quantity").alias("vascular_live_mass"),
        F.sum(F.col("l_quantity") * F.col("l_tax")).alias("litter_mass"),
    )
    place = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    key = F.col("n_nationkey")
    return sums.join(place, sums.l_suppkey == place.s_suppkey).select(
        F.col("n_name").alias("site_code"),
        F.col("l_suppkey").alias("plot"),
        F.col("year_trt").cast("long").alias("year_trt"),
        treatment(F.col("l_suppkey")).alias("trt"),
        F.when(F.col("n_regionkey") == 4, "Observational").otherwise("Experimental")
        .alias("experiment_type"),
        F.col("r_name").alias("continent"),
        (400 + 37 * key).cast("double").alias("MAP_v2"),
        (10 + (key * 7) % 13).cast("double").alias("MAP_VAR_v2"),
        (5 + (key * 3) % 20).cast("double").alias("MAT_v2"),
        "vascular_live_mass",
        "litter_mass",
    )


def name_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two brands of each site and type are merged into a third."""
    full = survey(spark, sf_dir)
    merged = full.filter(F.split("Taxon", "/")[0].isin("Brand#24", "Brand#25"))
    return merged.select(
        "site_code", "Taxon", F.concat(F.lit("Brand#23/"), F.split("Taxon", "/")[1]).alias("NewTaxon")
    ).distinct()


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live vascular plants with cover."""
    return survey(spark, sf_dir).filter(
        (F.col("live") == 1)
        & not_in(F.col("functional_group"), ["BRYOPHYTE", "LICHEN", "LIVERWORT"])
        & (F.col("max_cover") != 0)
    )


def cover_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per plot, year and taxon: the one with the largest cover."""
    return top_one(clean(spark, sf_dir), KEY, "max_cover", [F.col(c) for c in TIE_ORDER])


def ranked(spark: SparkSession, sf_dir: str, covers_only: bool = False) -> DataFrame:
    """Relative cover, rank, richness and rank percentile per plot-year.

    With ``covers_only`` the rows have no other columns of the survey: the largest cover is an aggregate.
    """
    # a plot-year is ranked by itself: years that are not asked for are left out before
    if covers_only:
        rows = clean(spark, sf_dir).filter(F.col("year_trt") >= 0)
        rows = rows.groupBy(*PLOT_YEAR, "Taxon").agg(F.max("max_cover").alias("max_cover"))
    else:
        rows = cover_max(spark, sf_dir).filter(F.col("year_trt") >= 0)
    # every cover is known, so no rows need be dealt
    rows = with_rank_percentile(rows, PLOT_YEAR, "max_cover", dealt=False)
    return rows.withColumn("cover", F.col("rel_cover"))


def panel(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pinned ranks of covers, pinned cohort, completed panel)."""
    base = pin(ranked(spark, sf_dir, True).select(*KEY, "cover", "max_cover", "rank", "perc_rank"))
    cohort = pin(baseline_cohort(base))
    last = base.groupBy("site_code").agg(F.max("year_trt").alias("max_year"))
    keys = ["site_code", "plot", "Taxon"]
    series = left_lookup(
        cohort.select(*keys),
        base.select(*keys, "cover", "max_cover", "rank", "perc_rank", "year_trt"),
        keys,
    )
    # read twice below; a few rows a plot, while the ranked table has them all
    series = pin(join_on(series, last, ["site_code"], "left"))
    filled = complete_panel(
        series,
        ["site_code", "plot"], ["Taxon"], "year_trt", "max_year",
        {"cover": 0.0, "max_cover": 0.0, "perc_rank": 0.0},
    )
    return base, cohort, filled


def followed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis table: the panel with traits, site and plot covariates and codes."""
    base, cohort, filled = panel(spark, sf_dir)
    kept = drop_empty_periods(filled, ["site_code", "year_trt"], "cover")
    start = base.filter(F.col("year_trt") == 0)
    richness = (
        start.select("site_code", "Taxon").distinct().groupBy("site_code")
        .agg(F.count(F.lit(1)).alias("site_rich_0"))
    )
    means = with_group_mean(start, ["site_code", "Taxon"], "cover", "avgCover").select(
        "site_code", "plot", "Taxon", "avgCover"
    )
    order = [F.col(c) for c in TIE_ORDER]
    first = clean(spark, sf_dir).filter(F.col("year_trt") == 0)
    traits = top_one(first, KEY, "max_cover", order).select(
        "site_code", "plot", "trt", "Taxon", "local_provenance", "local_lifespan", "functional_group"
    )
    meta = pin(plot_meta(spark, sf_dir))
    climate = meta.select("site_code", "MAP_v2", "MAP_VAR_v2", "MAT_v2").distinct()
    mass = meta.filter(F.col("year_trt") == 0).select(
        "site_code", "plot", F.col("vascular_live_mass").alias("initial_live_mass"),
        F.col("litter_mass").alias("initial_litter_mass"),
    )
    keys = ["site_code", "plot", "Taxon"]
    joined = join_on(cohort, kept.drop("rank", "max_year"), keys, "left")
    joined = join_on(join_on(joined, traits, keys, "left"), means, keys, "left")
    for side, on in ((climate, ["site_code"]), (mass, ["site_code", "plot"]),
                     (richness, ["site_code"])):
        joined = join_on(joined, side, on, "left")
    life, group, trt = F.col("local_lifespan"), F.col("functional_group"), F.col("trt")
    return joined.withColumns(
        {
            "local_lifespan": F.when(
                life.isin("PERENNIAL", "INDETERMINATE", "NULL"), "Perennial"
            ).otherwise("Annual"),
            "local_provenance": F.when(F.col("local_provenance") == "NAT", "Native")
            .when(F.col("local_provenance") == "INT", "Non-native").otherwise("UNK"),
            "func_simple": F.when(group.isin("GRASS", "GRAMINOID"), "Graminoid")
            .otherwise("Non-graminoid"),
            "NPK": trt.isin("NPK", "NPK+Fence").cast("int"),
            "Fence": trt.isin("Fence", "NPK+Fence").cast("int"),
        }
    )


_TRT = """case cast(l.l_suppkey % 4 as int) when 0 then 'Control' when 1 then 'NPK'
    when 2 then 'Fence' else 'NPK+Fence' end"""

# SQL forms, in order of dependence.
TABLES = {
    "survey": f"""
  select n.n_name as site_code, cast(l.l_suppkey % 3 as int) as block, l.l_suppkey as plot,
    {_TRT} as trt,
    cast(year(l.l_shipdate) as bigint) as year,
    cast(year(l.l_shipdate) - 1995 as bigint) as year_trt, l.l_shipdate as date,
    concat(p.p_brand, '/', p.p_type) as Taxon, l.l_quantity as max_cover,
    case when l.l_returnflag = 'R' then 0 else 1 end as live,
    case p.p_type when 'PROMO' then 'NULL' when 'ECONOMY' then 'ANNUAL'
      when 'SMALL' then 'INDETERMINATE' else 'PERENNIAL' end as local_lifespan,
    case when p.p_brand = 'Brand#1' then 'UNK'
      when p.p_brand in ('Brand#2','Brand#3','Brand#4','Brand#5') then 'INT'
      else 'NAT' end as local_provenance,
    case p.p_type when 'LARGE' then 'GRASS' when 'MEDIUM' then 'GRAMINOID'
      when 'SMALL' then 'FORB' when 'PROMO' then 'LEGUME' when 'ECONOMY' then 'WOODY'
      else 'BRYOPHYTE' end as functional_group,
    l.l_orderkey as ok, l.l_linenumber as ln, l.l_partkey as pk
  from lineitem l join part p on l.l_partkey = p.p_partkey
  join supplier s on l.l_suppkey = s.s_suppkey join nation n on s.s_nationkey = n.n_nationkey""",
    "plot_meta": f"""
  select n.n_name as site_code, l.l_suppkey as plot,
    cast(year(l.l_shipdate) - 1995 as bigint) as year_trt, {_TRT} as trt,
    case when n.n_regionkey = 4 then 'Observational' else 'Experimental' end as experiment_type,
    r.r_name as continent, cast(400 + 37 * n.n_nationkey as double) as MAP_v2,
    cast(10 + (n.n_nationkey * 7) % 13 as double) as MAP_VAR_v2,
    cast(5 + (n.n_nationkey * 3) % 20 as double) as MAT_v2,
    sum(l.l_quantity) as vascular_live_mass, sum(l.l_quantity * l.l_tax) as litter_mass
  from lineitem l join supplier s on l.l_suppkey = s.s_suppkey
  join nation n on s.s_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey
  group by 1,2,3,4,5,6,7,8,9""",
    "name_fix": """
  select distinct site_code, Taxon, concat('Brand#23/', split_part(Taxon, '/', 2)) as NewTaxon
  from survey where split_part(Taxon, '/', 1) in ('Brand#24','Brand#25')""",
    "clean": """
  select * from survey
  where live = 1 and functional_group not in ('BRYOPHYTE','LICHEN','LIVERWORT')
    and max_cover <> 0""",
    "cover_max": """
  select * exclude (rn) from (
    select *, row_number() over (partition by site_code, year_trt, plot, Taxon
      order by max_cover desc, ok, ln, pk, date) as rn from clean) t where rn = 1""",
    "ranked": """
  select *, rel_cover as cover, (rich + 1 - rank) / rich as perc_rank from (
    select *, rank() over (partition by site_code, year_trt, plot order by rel_cover desc) as rank
    from (select *, max_cover / sum(max_cover) over w as rel_cover, count(*) over w as rich
      from cover_max window w as (partition by site_code, year_trt, plot)) a) b
  where year_trt >= 0""",
    "site_last": """
  select site_code, max(year_trt) as max_year from ranked group by site_code""",
    "cohort": """
  select site_code, plot, Taxon, cover as initial_rel_cover, max_cover as initial_abs_cover
  from (select *, rank() over (partition by site_code, plot order by max_cover desc) as top
    from ranked where year_trt = 0) t where top = 1""",
    "panel": """
  select e.site_code, e.plot, e.Taxon, e.max_year, e.year_trt, coalesce(r.cover, 0.0) as cover,
    coalesce(r.max_cover, 0.0) as max_cover, coalesce(r.perc_rank, 0.0) as perc_rank, r.rank
  from (select c.site_code, c.plot, c.Taxon, s.max_year,
      unnest(range(0, s.max_year + 1)) as year_trt
    from cohort c join site_last s on c.site_code = s.site_code) e
  left join ranked r on e.site_code = r.site_code and e.plot = r.plot and e.Taxon = r.Taxon
    and e.year_trt = r.year_trt""",
    "kept_panel": """
  select p.* from panel p where not exists (
    select 1 from (select site_code, year_trt from panel group by 1, 2 having sum(cover) = 0) z
    where z.site_code = p.site_code and z.year_trt = p.year_trt)""",
    "site_richness_0": """
  select site_code, count(distinct Taxon) as site_rich_0 from ranked where year_trt = 0
  group by site_code""",
    "traits_0": """
  select site_code, plot, trt, Taxon, local_provenance, local_lifespan, functional_group,
    avg(cover) over (partition by site_code, Taxon) as avgCover from ranked where year_trt = 0""",
    "climate": """
  select distinct site_code, MAP_v2, MAP_VAR_v2, MAT_v2 from plot_meta""",
    "followed": """
  select c.*, p.year_trt, p.cover, p.max_cover, p.perc_rank, t.trt,
    case when t.local_lifespan in ('PERENNIAL','INDETERMINATE','NULL') then 'Perennial'
      else 'Annual' end as local_lifespan,
    case t.local_provenance when 'NAT' then 'Native' when 'INT' then 'Non-native'
      else 'UNK' end as local_provenance, t.functional_group, t.avgCover,
    m.MAP_v2, m.MAP_VAR_v2, m.MAT_v2, b.vascular_live_mass as initial_live_mass,
    b.litter_mass as initial_litter_mass, r.site_rich_0,
    case when t.functional_group in ('GRASS','GRAMINOID') then 'Graminoid'
      else 'Non-graminoid' end as func_simple,
    case when t.trt in ('NPK','NPK+Fence') then 1 else 0 end as NPK,
    case when t.trt in ('Fence','NPK+Fence') then 1 else 0 end as Fence
  from cohort c
  left join kept_panel p on c.site_code = p.site_code and c.plot = p.plot and c.Taxon = p.Taxon
  left join traits_0 t on c.site_code = t.site_code and c.plot = t.plot and c.Taxon = t.Taxon
  left join climate m on c.site_code = m.site_code
  left join (select * from plot_meta where year_trt = 0) b
    on c.site_code = b.site_code and c.plot = b.plot
  left join site_richness_0 r on c.site_code = r.site_code""",
    "series": """
  select site_code, plot, Taxon, max_year, avg(perc_rank) as avg_rank from (
    select *, max(year_trt) over (partition by site_code) as max_year from followed) t
  group by 1, 2, 3, 4""",
    "series_traits": """
  select s.*, d.initial_rel_cover, d.local_lifespan, d.site_rich_0, d.trt from series s
  left join (select distinct site_code, plot, Taxon, initial_rel_cover, local_lifespan,
    site_rich_0, trt from followed) d
  on s.site_code = d.site_code and s.plot = d.plot and s.Taxon = d.Taxon""",
    "curve": """
  select trt, year_trt, avg(perc_rank) as mean_btrans,
    avg(perc_rank) + 2 * stddev_samp(perc_rank) / sqrt(count(*)) as upper_btrans,
    avg(perc_rank) - 2 * stddev_samp(perc_rank) / sqrt(count(*)) as lower_btrans
  from followed group by trt, year_trt""",
    "life_curve": """
  select local_lifespan, trt, year_trt, avg(perc_rank) as mean_btrans,
    avg(perc_rank) + 2 * stddev_samp(perc_rank) / sqrt(count(*)) as upper_btrans,
    avg(perc_rank) - 2 * stddev_samp(perc_rank) / sqrt(count(*)) as lower_btrans
  from followed group by local_lifespan, trt, year_trt""",
    "cutoff": """
  select avg(perc_rank) as cut from followed where year_trt <> 0""",
}


def with_tables(sql: str) -> str:
    """Prefix the tables a statement needs, directly or through another table."""
    needed: set[str] = set()
    todo = [sql]
    while todo:
        words = set("".join(c if c.isalnum() or c == "_" else " " for c in todo.pop()).split())
        for name in words & set(TABLES) - needed:
            needed.add(name)
            todo.append(TABLES[name])
    if not needed:
        return sql
    parts = [f"{name} as ({body})" for name, body in TABLES.items() if name in needed]
    joiner = ",\n" if sql.lstrip().lower().startswith("with ") else "\n"
    body = sql.lstrip()[5:] if joiner == ",\n" else sql
    return "with " + ",\n".join(parts) + joiner + body
