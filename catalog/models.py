"""Mixed models of rank decay, their tables, marginal means and persistence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from catalog.base import followed, query
from sward.functions.scalar import arcsine_root, clamp_unit, logit
from sward.operators import mixed_outputs
from sward.operators.describe import five_numbers, histogram, normal_qq
from sward.operators.design import design_matrix, factorial
from sward.operators.margins import back_transform, contrasts, reference_grid, year_steps
from sward.operators.mixed import (
    Evaluator, estimable, fit_designs, group_sums, model_at, solve, submodels_at,
)
from sward.operators.panel import eligible_series
from sward.operators.report import tidy_anova, tidy_coefficients
from sward.plans import decay
from sward.scale import join_on
from sward.session import pin

KEYS = ["site_code", "plot", "Taxon"]

_ADJ = """(select *, case when perc_rank = 1 then 0.99::double when perc_rank = 0 then 0.01::double
  else perc_rank end as adj from followed)"""
_ROWS = f"""(select site_code, plot, Taxon, cast(year_trt as double) as x,
  ln(adj / (1 - adj)) as y from {_ADJ} a)"""


def frames(spark, sf_dir):
    """(rows of all followed leaders, rows of known provenance) with responses."""
    rows = eligible_series(pin(followed(spark, sf_dir)), 5).withColumns(
        {
            "site_richness": F.col("site_rich_0").cast("double"),
            "rank_logit": logit(clamp_unit(F.col("perc_rank"))),
            "rank_as": arcsine_root(F.col("perc_rank")),
        }
    )
    rows = pin(rows)
    return rows, decay.complete_rows(rows)


def reduced_design():
    return decay.full_design().without(*decay.SIMPLE_DROPS)


def reduced_model(spark, sf_dir):
    rows, known = frames(spark, sf_dir)
    sums = group_sums(known, "rank_logit", reduced_design(), KEYS)
    return rows, known, fit_designs(sums, [reduced_design()])[0]


@query("design_matrix", "LM1", sql="""
select site_code, plot, Taxon, year_trt, unnest(range(1, 9)) as position, unnest([1.0::double, y, n,
  f, y * n, y * f, n * f, y * n * f]) as x
from (select *, cast(year_trt as double) as y, cast(NPK as double) as n, cast(Fence as double) as f
  from followed) t""")
def design_columns(spark, sf_dir):
    design = factorial([["year_trt", "NPK", "Fence"]])
    wide = design_matrix(followed(spark, sf_dir), design, [*KEYS, "year_trt"])
    return wide.select(*KEYS, "year_trt", F.posexplode("x").alias("position", "x")).withColumn(
        "position", F.col("position") + 1
    )


@query("cross_products", "LM2", sql=f"""
select cast(i as bigint) as i, cast(j as bigint) as j, round(sum(z[i] * z[j]), 6) as total
from (select [1.0, x, y] as z from {_ROWS} r) a, (values (1), (2), (3)) b(i), (values (1), (2), (3)) c(j)
group by 1, 2""")
def cross_products(spark, sf_dir):
    _, sums = year_sums(spark, sf_dir)
    cells = [
        (i + 1, j + 1, float(v)) for (i, j), v in np.ndenumerate(sums.gram)
    ]
    return spark.createDataFrame(cells, "i int, j int, total double")


_TRIALS = [(0.5, 0.25, 0.125), (0.05, 0.5, 1.0), (2.0, 0.1, 0.0)]


_LEVEL = """select * replace (
    m11 + r * w * w / (1 + r * w) as m11, mx1 + r * w * sx / (1 + r * w) as mx1,
    my1 + r * w * sy / (1 + r * w) as my1, mxx + r * sx * sx / (1 + r * w) as mxx,
    mxy + r * sx * sy / (1 + r * w) as mxy, myy + r * sy * sy / (1 + r * w) as myy,
    ld + ln(1 + r * w) as ld, w / (1 + r * w) as w, sx / (1 + r * w) as sx,
    sy / (1 + r * w) as sy) from (select *, {ratio} as r from {source}) q"""
_SUMS = """sum(m11) as m11, sum(mx1) as mx1, sum(my1) as my1, sum(mxx) as mxx, sum(mxy) as mxy,
    sum(myy) as myy, sum(ld) as ld, sum(w) as w, sum(sx) as sx, sum(sy) as sy"""


_CRITERION = f"""
trials(trial, st, pt, tt) as (values
  {", ".join(f"({i + 1}, {a}::double, {b}::double, {c}::double)" for i, (a, b, c) in enumerate(_TRIALS))}),
obs as (select * from {_ROWS} r),
taxa0 as (select trial, st, pt, tt, site_code, plot, Taxon, 0.0::double as m11, 0.0::double as mx1,
    0.0::double as my1, 0.0::double as mxx, 0.0::double as mxy, 0.0::double as myy,
    0.0::double as ld, cast(count(*) as double) as w, sum(x) as sx, sum(y) as sy
  from obs, trials group by trial, st, pt, tt, site_code, plot, Taxon),
taxa1 as ({_LEVEL.format(ratio="tt", source="taxa0")}),
plots0 as (select trial, st, pt, tt, site_code, plot, {_SUMS} from taxa1 group by all),
plots1 as ({_LEVEL.format(ratio="pt", source="plots0")}),
sites0 as (select trial, st, pt, tt, site_code, {_SUMS} from plots1 group by all),
sites1 as ({_LEVEL.format(ratio="st", source="sites0")}),
gone as (select trial, {_SUMS} from sites1 group by trial),
g as (select count(*) as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(x * y) as xy,
    sum(y * y) as yy from obs),
m as (select trial, n, ld, g.n - m11 as a, g.x - mx1 as b, g.xx - mxx as d, g.y - my1 as e,
    g.xy - mxy as f, g.yy - myy as h from gone, g),
s as (select *, (d * e - b * f) / (a * d - b * b) as b0, (a * f - b * e) / (a * d - b * b) as b1,
    (h - (d * e * e - 2 * b * e * f + a * f * f) / (a * d - b * b)) / (n - 2) as s2 from m)"""

# Random effects of the first trial, from the outermost level down.
_EFFECTS = f"""{_CRITERION},
one as (select t.*, s.b0, s.b1, s.s2 from trials t join s using (trial) where trial = 1),
et as (select o.site_code, o.plot, o.Taxon, st, pt, tt, count(*) as n, sum(y - b0 - b1 * x) as t
  from obs o, one group by all),
ep as (select site_code, plot, st, pt, sum(n / (1 + n * tt)) as w, sum(t / (1 + n * tt)) as t
  from et group by all),
es as (select site_code, st, sum(w / (1 + pt * w)) as w, sum(t / (1 + pt * w)) as t
  from ep group by all),
bs as (select site_code, st * t / (1 + st * w) as site_effect from es),
bp as (select ep.site_code, ep.plot, bs.site_effect,
    pt * (t - w * bs.site_effect) / (1 + pt * w) as plot_effect
  from ep join bs on ep.site_code = bs.site_code),
bt as (select et.site_code, et.plot, et.Taxon, site_effect, plot_effect,
    tt * (t - n * (site_effect + plot_effect)) / (1 + n * tt) as taxon_effect
  from et join bp on et.site_code = bp.site_code and et.plot = bp.plot)"""


def year_sums(spark, sf_dir):
    """Model rows and their sums for a design of intercept and year."""
    rows = pin(
        followed(spark, sf_dir).select(
            *KEYS, "year_trt", logit(clamp_unit(F.col("perc_rank"))).alias("rank_logit")
        )
    )
    return rows, group_sums(rows, "rank_logit", factorial([["year_trt"]]), KEYS)


@query("reml_criterion", "LM2", "LM4", sql=f"""
with {_CRITERION}
select cast(trial as bigint) as trial, round(b0, 6) as intercept, round(b1, 6) as slope,
  round(s2, 6) as sigma2,
  round(-((n - 2) * (ln(2 * pi() * s2) + 1) + ld + ln(a * d - b * b)) / 2, 6) as loglik from s""")
def reml_criterion(spark, sf_dir):
    _, sums = year_sums(spark, sf_dir)
    evaluator = Evaluator(sums)
    found = []
    for i, (matrix, logdet) in enumerate(evaluator.evaluate(np.array(_TRIALS)), 1):
        fit = solve(matrix, logdet, [0, 1], sums.rows, "REML")
        found.append((i, float(fit.beta[0]), float(fit.beta[1]), fit.sigma2, fit.loglik))
    evaluator.close()
    return spark.createDataFrame(
        found, "trial int, intercept double, slope double, sigma2 double, loglik double"
    )


@query("coefficients_at_given_variances", "LM3", "LM4", "PJ8", sql=f"""
with {_CRITERION}, k as (select count(*) as taxa from (select distinct site_code, plot, Taxon from obs) q)
select unnest(['(Intercept)', 'year_trt']) as Effect, round(unnest([b0, b1]), 6) as Value,
  round(unnest([sqrt(s2 * d / (a * d - b * b)), sqrt(s2 * a / (a * d - b * b))]), 6) as "Std.Error",
  cast(n - k.taxa - 1 as double) as DF,
  round((n - 2) * (ln(2 * pi() * s2) + 1) + ld + ln(a * d - b * b) + 2 * (2 + 3 + 1), 6) as AIC
from s, k where trial = 1""")
def coefficients_at_given_variances(spark, sf_dir):
    model = model_at(year_sums(spark, sf_dir)[1], _TRIALS[0])
    table = mixed_outputs.coefficient_table(spark, model)
    return table.select("Effect", "Value", "`Std.Error`", "DF", F.lit(model.aic()).alias("AIC"))


@query("random_effects_at_given_variances", "LM8", sql=f"""
with {_EFFECTS}
select site_code, plot, Taxon, round(site_effect, 6) as site_effect,
  round(plot_effect, 6) as plot_effect, round(taxon_effect, 6) as taxon_effect from bt""")
def random_effects_at_given_variances(spark, sf_dir):
    model = model_at(year_sums(spark, sf_dir)[1], _TRIALS[0])
    rows = None
    for depth, (group, name) in enumerate(
        zip(KEYS, ["site_effect", "plot_effect", "taxon_effect"]), 1
    ):
        effects = mixed_outputs.random_effects(model)[group].withColumnRenamed("effect", name)
        rows = effects if rows is None else join_on(effects, rows, KEYS[: depth - 1], "left")
    return rows


@query("fitted_at_given_variances", "LM10", sql=f"""
with {_EFFECTS}
select o.site_code, o.plot, o.Taxon, cast(o.x as bigint) as year_trt, round(b0 + b1 * o.x, 6) as fixed,
  round(b0 + b1 * o.x + site_effect + plot_effect + taxon_effect, 6) as fitted,
  round((o.y - (b0 + b1 * o.x + site_effect + plot_effect + taxon_effect)) / sqrt(s2), 6) as pearson
from obs o join bt on o.site_code = bt.site_code and o.plot = bt.plot and o.Taxon = bt.Taxon, one""")
def fitted_at_given_variances(spark, sf_dir):
    rows, sums = year_sums(spark, sf_dir)
    scored = mixed_outputs.with_fitted(rows, model_at(sums, _TRIALS[0]))
    return scored.select(*KEYS, "year_trt", "fixed", "fitted", "pearson")


@query("r_squared_at_given_variances", "LM7", sql=f"""
with {_CRITERION}, v as (select var_samp(b0 + b1 * x) as fixed, any_value(s2) as e,
    any_value(s2) * ({" + ".join(map(str, _TRIALS[0]))}) as random from obs, s where trial = 1)
select round(fixed / (fixed + random + e), 6) as R2m,
  round((fixed + random) / (fixed + random + e), 6) as R2c from v""")
def r_squared_at_given_variances(spark, sf_dir):
    rows, sums = year_sums(spark, sf_dir)
    return mixed_outputs.r_squared(rows, model_at(sums, _TRIALS[0]))


@query("back_transformed_band", "EM3", "RC8", sql=f"""
select trt, year_trt, round(1 / (1 + exp(-m)), 6) as mean_btrans,
  round(1 / (1 + exp(-(m + 2 * se))), 6) as upper_btrans,
  round(1 / (1 + exp(-(m - 2 * se))), 6) as lower_btrans
from (select trt, year_trt, avg(ln(adj / (1 - adj))) as m,
    stddev_samp(ln(adj / (1 - adj))) / sqrt(count(*)) as se from {_ADJ} a group by 1, 2) t""")
def back_transformed_band(spark, sf_dir):
    value = logit(clamp_unit(F.col("perc_rank")))
    error = F.stddev_samp("y") / F.sqrt(F.count(F.lit(1)))
    means = followed(spark, sf_dir).withColumn("y", value).groupBy("NPK", "Fence", "year_trt").agg(
        F.avg("y").alias("emmean"), (F.avg("y") - 2 * error).alias("lower_CL"),
        (F.avg("y") + 2 * error).alias("upper_CL"),
    )
    return back_transform(means).select(
        "trt", "year_trt", "mean_btrans", "upper_btrans", "lower_btrans"
    )


@query("full_model_coefficients", "LM2", "LM3", "PV6", "PJ8", "RC10")
def full_model_coefficients(spark, sf_dir):
    _, known = frames(spark, sf_dir)
    sums = group_sums(known, "rank_logit", decay.full_design(), KEYS)
    model = fit_designs(sums, [estimable(sums)])[0]
    return tidy_coefficients(mixed_outputs.coefficient_table(spark, model, sums.design))


@query("predictor_family_aic", "LM4", "LM5", "SC6", "WN14")
def predictor_family_aic(spark, sf_dir):
    _, known = frames(spark, sf_dir)
    sums = group_sums(known, "rank_logit", decay.full_design(), KEYS)
    return mixed_outputs.drop_family_table(spark, sums, decay.FAMILIES)


@query("reduced_model_coefficients", "LM6", "LM3", "PV6")
def reduced_model_coefficients(spark, sf_dir):
    model = reduced_model(spark, sf_dir)[2]
    return tidy_coefficients(mixed_outputs.coefficient_table(spark, model))


@query("reduced_model_r_squared", "LM7")
def reduced_model_r_squared(spark, sf_dir):
    _, known, model = reduced_model(spark, sf_dir)
    return mixed_outputs.r_squared(known, model)


@query("reduced_model_anova", "LM9", "PV5")
def reduced_model_anova(spark, sf_dir):
    model = reduced_model(spark, sf_dir)[2]
    return tidy_anova(mixed_outputs.anova_table(spark, model))


@query("plot_random_effects", "LM8")
def plot_random_effects(spark, sf_dir):
    model = reduced_model(spark, sf_dir)[2]
    return mixed_outputs.random_effects(model)["plot"]


@query("taxon_random_effect_histogram", "LM8", "AG15")
def taxon_random_effect_histogram(spark, sf_dir):
    model = reduced_model(spark, sf_dir)[2]
    return histogram(pin(mixed_outputs.random_effects(model)["Taxon"]), "effect", 12)


@query("fitted_and_residuals", "LM10")
def fitted_and_residuals(spark, sf_dir):
    _, known, model = reduced_model(spark, sf_dir)
    rows = mixed_outputs.with_fitted(known, model)
    return rows.select(*KEYS, "year_trt", "fixed", "fitted", "residual", "pearson")


@query("residuals_by_treatment", "LM10", "AG16")
def residuals_by_treatment(spark, sf_dir):
    _, known, model = reduced_model(spark, sf_dir)
    return five_numbers(pin(mixed_outputs.with_fitted(known, model)), ["trt"], "residual")


@query("residual_normal_quantiles", "LM10", "AG17")
def residual_normal_quantiles(spark, sf_dir):
    _, known, model = reduced_model(spark, sf_dir)
    return normal_qq(pin(mixed_outputs.with_fitted(known, model)), "residual", 39)


@query("leverage", "LM11", sql=f"""
select site_code, plot, Taxon, cast(x as bigint) as year_trt, round(1.0::double / count(*) over ()
  + pow(x - avg(x) over (), 2) / (count(*) over () * var_pop(x) over ()), 6) as leverage
from {_ROWS} r""")
def leverage(spark, sf_dir):
    rows, sums = year_sums(spark, sf_dir)
    scored = mixed_outputs.with_leverage(rows.select(*KEYS, "year_trt"), sums)
    return scored.select(*KEYS, "year_trt", "leverage")


@query("arcsine_model_coefficients", "LM12", "FN9", "PV6")
def arcsine_model_coefficients(spark, sf_dir):
    _, known = frames(spark, sf_dir)
    sums = group_sums(known, "rank_as", decay.arcsine_design(), ["site_code", "plot"])
    model = fit_designs(sums, [sums.design])[0]
    return tidy_coefficients(mixed_outputs.coefficient_table(spark, model))


@query("decay_curves_by_initial_cover", "EM1", "EM3", "EM5", "JN14")
def decay_curves_by_initial_cover(spark, sf_dir):
    rows, known, model = reduced_model(spark, sf_dir)
    curves = decay.decay_curves(known, model, decay.cover_levels(rows))
    return curves.select(
        "initial_cover", "trt", "year_trt", "emmean", "SE", "df", "lower_CL", "upper_CL",
        "mean_btrans", "lower_btrans", "upper_btrans",
    )


@query("decay_curves_by_lifespan", "EM1", "EM3")
def decay_curves_by_lifespan(spark, sf_dir):
    _, known, model = reduced_model(spark, sf_dir)
    curves = decay.decay_curves(known, model, by_lifespan=True)
    return curves.select("local_lifespan", "trt", "year_trt", "emmean", "SE", "df", "mean_btrans")


@query("treatment_contrasts", "EM2")
def treatment_contrasts(spark, sf_dir):
    _, known, model = reduced_model(spark, sf_dir)
    at = {"year_trt": year_steps(15)}
    return contrasts(reference_grid(known, model, at, treatments=False), model)


@query("aic_at_given_variances", "LM5", "LM6", "LM4", "SC6", "WN14", sql=f"""
with {_CRITERION}, v as (select *, (h - e * e / a) / (n - 1) as s0 from s where trial = 1),
w as (select (n - 2) * (ln(2 * pi() * s2) + 1) + ld + ln(a * d - b * b) + 2 * (2 + 3 + 1) as whole,
    (n - 1) * (ln(2 * pi() * s0) + 1) + ld + ln(a) + 2 * (1 + 3 + 1) as less from v)
select cast(1 as bigint) as position, 'Full Model' as Predictor, round_even(whole, 1) as AIC,
  0.0::double as deltaAIC from w
union all
select 2, 'Year', round_even(less, 1), round_even(less - whole, 1) from w""")
def aic_at_given_variances(spark, sf_dir):
    whole = factorial([["year_trt"]])
    models = submodels_at(year_sums(spark, sf_dir)[1], [whole, whole.without("year_trt")], _TRIALS[0])
    return mixed_outputs.aic_table(spark, dict(zip(["Full Model", "Year"], models)))


@query("anova_at_given_variances", "LM9", sql=f"""
with {_CRITERION}
select cast(unnest([1, 2]) as bigint) as position, unnest(['(Intercept)', 'year_trt']) as Effect,
  1::bigint as numDF,
  round(unnest([e * e / (a * s2), b1 * b1 * (a * d - b * b) / (a * s2)]), 6) as "F.value"
from s where trial = 1""")
def anova_at_given_variances(spark, sf_dir):
    model = model_at(year_sums(spark, sf_dir)[1], _TRIALS[0])
    return mixed_outputs.anova_table(spark, model).select("position", "Effect", "numDF", "`F.value`")


_AS_ROWS = _ROWS.replace("ln(adj / (1 - adj)) as y", "asin(sqrt(perc_rank)) as y")


@query("arcsine_coefficients_at_given_variances", "LM12", "FN9", sql=f"""
with {_CRITERION.replace(_ROWS, _AS_ROWS)}
select unnest(['(Intercept)', 'year_trt']) as Effect, round(unnest([b0, b1]), 6) as Value,
  round(unnest([sqrt(s2 * d / (a * d - b * b)), sqrt(s2 * a / (a * d - b * b))]), 6) as "Std.Error",
  round(unnest([b0 / sqrt(s2 * d / (a * d - b * b)), b1 / sqrt(s2 * a / (a * d - b * b))]), 6) as "t.value"
from s where trial = 3""")
def arcsine_coefficients_at_given_variances(spark, sf_dir):
    # the third trial gives the taxa no variance: two levels
    rows = pin(
        followed(spark, sf_dir).select(*KEYS, "year_trt", arcsine_root(F.col("perc_rank")).alias("rank_as"))
    )
    sums = group_sums(rows, "rank_as", factorial([["year_trt"]]), ["site_code", "plot"])
    table = mixed_outputs.coefficient_table(spark, model_at(sums, _TRIALS[2][:2]))
    return table.select("Effect", "Value", "`Std.Error`", "`t.value`")


def _signif(x: str, digits: int) -> str:
    scale = f"pow(10.0, {digits - 1} - floor(log10(abs({x}))))"
    return f"case when {x} = 0 then 0.0 else round_even({x} * {scale}, 0) / {scale} end"


@query("tidy_coefficient_report", "PV6", sql=f"""
with t as (select case length(site_code) % 3 when 0 then 'initial:' || site_code when 1 then 'MAP_VAR_v2:' || site_code
    else site_code end as Effect, avg(perc_rank) as v, max(perc_rank) - min(perc_rank) + 0.0625 as se,
    cast(count(*) as double) as df, avg(perc_rank) / 10 as p from followed group by site_code)
select Effect, {_signif("v", 3)} as Estimate, {_signif("se", 2)} as "Std.Error", df as DF,
  {_signif("(v / se)", 2)} as "t.value",
  case when {_signif("p", 2)} <= 0.001 then '< 0.001' else cast({_signif("p", 2)} as varchar) end as "p.value",
  cast(case when Effect like 'initial%' then 2 when Effect like 'MAP_VAR_v2%' then 8 else 1 end as bigint) as "order" from t""")
def tidy_coefficient_report(spark, sf_dir):
    kind = F.length("site_code") % 3
    name = F.when(kind == 0, F.concat(F.lit("initial:"), "site_code")).when(kind == 1, F.concat(F.lit("MAP_VAR_v2:"), "site_code"))
    table = followed(spark, sf_dir).groupBy("site_code").agg(
        F.avg("perc_rank").alias("Value"), (F.max("perc_rank") - F.min("perc_rank") + 0.0625).alias("Std.Error"),
        F.count(F.lit(1)).cast("double").alias("DF"),
    ).withColumn("Effect", F.coalesce(name, F.col("site_code")))
    return tidy_coefficients(table.withColumns({
        "position": F.col("DF"), "t.value": F.col("Value") / F.col("`Std.Error`"), "p.value": F.col("Value") / 10,
    }))


@query("tidy_anova_report", "PV5", sql="""
select site_code as Effect, count(distinct plot) || ',' || count(*) as DF,
  round_even(avg(year_trt) + 0.0625, 2) as "F value",
  case when round_even(avg(perc_rank) / 400, 3) = 0 then '< 0.001'
    else cast(round_even(avg(perc_rank) / 400, 3) as varchar) end as "P value"
from followed group by site_code""")
def tidy_anova_report(spark, sf_dir):
    table = followed(spark, sf_dir).groupBy("site_code").agg(
        F.countDistinct("plot").alias("numDF"), F.count(F.lit(1)).alias("denDF"),
        (F.avg("year_trt") + 0.0625).alias("F.value"), (F.avg("perc_rank") / 400).alias("p.value"),
    )
    return tidy_anova(table.withColumns({"Effect": F.col("site_code"), "position": F.col("denDF")}))


_NPK_ROWS = _ROWS.replace("cast(year_trt as double) as x", "cast(NPK as double) as x")


@query("contrasts_at_given_variances", "EM2", sql=f"""
with {_CRITERION.replace(_ROWS, _NPK_ROWS)},
one as (select *, s2 * a / (a * d - b * b) as v from s where trial = 1)
select contrast, round(side * b1, 6) as estimate, round(sqrt(v), 6) as SE, round(side * b1 / sqrt(v), 6) as t_ratio
from one, (values ('Control - NPK', -1), ('Control - NPK+Fence', -1), ('Fence - NPK', -1),
  ('Fence - NPK+Fence', -1)) c(contrast, side)""")
def contrasts_at_given_variances(spark, sf_dir):
    rows = pin(
        followed(spark, sf_dir).select(
            *KEYS, F.col("NPK").cast("double").alias("NPK"),
            logit(clamp_unit(F.col("perc_rank"))).alias("rank_logit"),
        )
    )
    model = model_at(group_sums(rows, "rank_logit", factorial([["NPK"]]), KEYS), _TRIALS[0])
    found = contrasts(reference_grid(rows, model, {"year_trt": [0.0]}, treatments=False), model)
    # the model has no fence term: pairs that differ in the fence alone have no error
    return found.filter("SE > 0").select("contrast", "estimate", "SE", "t_ratio")


@query("reference_grid_means", "EM1", "JN14", sql="""
select round(a.cover, 6) as initial_rel_cover, n.npk as NPK, n.fence as Fence, y.year_trt
from (select avg(initial_rel_cover) as cover from (
    select *, max(year_trt) over (partition by site_code) as max_year from followed) f
    where max_year >= 5 and local_provenance <> 'UNK') a,
  (values (0.0::double, 0.0::double), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)) n(npk, fence),
  (select cast(unnest(range(0, 16)) as double) as year_trt) y""")
def reference_grid_means(spark, sf_dir):
    _, known = frames(spark, sf_dir)
    return reference_grid(known, reduced_design(), {"year_trt": year_steps(15)}).select(
        "initial_rel_cover", "NPK", "Fence", "year_trt"
    )


@query("persistence_report", "EM4", "PV1", "PV2", "PV3", "PV4", "WN13")
def persistence_report(spark, sf_dir):
    rows, known, model = reduced_model(spark, sf_dir)
    return decay.persistence_table(known, rows, model)
