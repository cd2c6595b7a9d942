"""The mixed model against dense linear algebra on small unbalanced data."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sward.functions.distributions import studentised_range_upper, t_quantile, t_two_sided
from sward.operators import margins, mixed, mixed_outputs
from sward.operators.design import factorial

GROUPS = ["site", "plot", "taxon"]


def make_rows(seed, sites=5):
    rng = np.random.default_rng(seed)
    rows = []
    for s in range(sites):
        rain, bs = rng.normal(8, 2), rng.normal(0, 1.0)
        for p in range(rng.integers(3, 6)):
            npk, fence, bp = float(p % 2), float((p // 2) % 2), rng.normal(0, 0.7)
            for t in range(rng.integers(1, 4)):
                life, bt = str(rng.choice(["Annual", "Perennial"])), rng.normal(0, 0.5)
                for year in range(rng.integers(2, 6)):
                    mean = 1 - 0.4 * year + 0.3 * npk * year + 0.1 * rain + (life == "Annual")
                    rows.append((f"s{s}", p, f"t{t}", float(year), npk, fence, life, rain,
                                 mean + bs + bp + bt + rng.normal(0, 0.8)))
    columns = ["site", "plot", "taxon", "year", "NPK", "Fence", "life", "rain", "y"]
    return pd.DataFrame(rows, columns=columns)


def design():
    return factorial(
        [["year", "NPK", "Fence"], ["life", "year"], ["rain"]], {"life": ["Annual", "Perennial"]}
    )


class Dense:
    """The model with its covariance matrix written out."""

    def __init__(self, frame, design, groups=GROUPS):
        self.x = design.matrix(frame)
        self.y = frame["y"].to_numpy()
        self.codes = [
            frame.groupby(groups[: k + 1]).ngroup().to_numpy() for k in range(len(groups))
        ]
        self.z = [np.eye(c.max() + 1)[c] for c in self.codes]

    def solve(self, ratios, method="REML"):
        n, p = self.x.shape
        v = np.eye(n) + sum(r * z @ z.T for r, z in zip(ratios, self.z))
        inverse = np.linalg.inv(v)
        a = self.x.T @ inverse @ self.x
        beta = np.linalg.solve(a, self.x.T @ inverse @ self.y)
        res = self.y - self.x @ beta
        quad = res @ inverse @ res
        logdet_v, logdet_a = np.linalg.slogdet(v)[1], np.linalg.slogdet(a)[1]
        if method == "REML":
            s2 = quad / (n - p)
            twice = (n - p) * (math.log(2 * math.pi * s2) + 1) + logdet_v + logdet_a
        else:
            s2 = quad / n
            twice = n * (math.log(2 * math.pi * s2) + 1) + logdet_v
        return beta, s2 * np.linalg.inv(a), s2, -twice / 2, inverse, res

    def best(self, start, method="REML"):
        """Coordinate search from a starting point, to check a maximum."""
        point, step = np.log(np.maximum(start, 1e-12)), 0.05
        value = self.solve(np.exp(point), method)[3]
        while step > 1e-4:
            moved = False
            for i in range(len(point)):
                for sign in (-1, 1):
                    trial = point.copy()
                    trial[i] += sign * step
                    found = self.solve(np.exp(trial), method)[3]
                    if found > value + 1e-12:
                        point, value, moved = trial, found, True
            if not moved:
                step /= 2
        return np.exp(point), value


@pytest.fixture(scope="module")
def fitted(spark):
    frame = make_rows(1)
    df = spark.createDataFrame(frame).repartition(5)
    sums = mixed.group_sums(df, "y", design(), GROUPS)
    return frame, df, sums, mixed.fit_designs(sums, [design()])[0]


@pytest.mark.parametrize("seed", [2, 3])
def test_trial_matrices_equal_dense(spark, seed):
    frame = make_rows(seed)
    sums = mixed.group_sums(spark.createDataFrame(frame), "y", design(), GROUPS)
    ratios = np.array([[0.5, 0.3, 0.2], [2.0, 1e-9, 0.7], [1e-9, 0.4, 1e-9]])
    evaluator = mixed.Evaluator(sums)
    dense = Dense(frame, design())
    full = np.column_stack([dense.x, dense.y])
    for trial, (matrix, logdet) in zip(ratios, evaluator.evaluate(ratios)):
        v = np.eye(len(frame)) + sum(r * z @ z.T for r, z in zip(trial, dense.z))
        np.testing.assert_allclose(matrix, full.T @ np.linalg.solve(v, full), rtol=1e-9, atol=1e-8)
        assert logdet == pytest.approx(np.linalg.slogdet(v)[1], abs=1e-9)
    evaluator.close()


def test_fit_equals_dense_maximum(fitted):
    frame, _, _, model = fitted
    dense = Dense(frame, design())
    beta, cov, s2, loglik, *_ = dense.solve(model.ratios)
    np.testing.assert_allclose(model.beta, beta, rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(model.cov, cov, rtol=1e-7, atol=1e-10)
    assert model.sigma2 == pytest.approx(s2, rel=1e-9)
    assert model.loglik == pytest.approx(loglik, abs=1e-8)
    ratios, value = dense.best(model.ratios)
    assert value <= model.loglik + 1e-6
    np.testing.assert_allclose(model.ratios, ratios, rtol=2e-3, atol=1e-6)
    assert model.aic() == pytest.approx(-2 * loglik + 2 * (len(beta) + 4))


def test_maximum_likelihood_and_two_levels(spark):
    frame = make_rows(4)
    groups = ["site", "plot"]
    model = mixed.fit_nested_lmm(spark.createDataFrame(frame), "y", design(), groups, "ML")
    dense = Dense(frame, design(), groups)
    beta, _, s2, loglik, *_ = dense.solve(model.ratios, "ML")
    np.testing.assert_allclose(model.beta, beta, rtol=1e-7, atol=1e-9)
    assert model.loglik == pytest.approx(loglik, abs=1e-8)
    assert dense.best(model.ratios, "ML")[1] <= loglik + 1e-6


def test_one_level(spark):
    frame = make_rows(5)
    model = mixed.fit_nested_lmm(spark.createDataFrame(frame), "y", design(), ["site"])
    dense = Dense(frame, design(), ["site"])
    assert model.loglik == pytest.approx(dense.solve(model.ratios)[3], abs=1e-8)
    assert dense.best(model.ratios)[1] <= model.loglik + 1e-6


def test_no_group_effect_is_least_squares(spark):
    rng = np.random.default_rng(9)
    frame = make_rows(6, sites=4)
    # alternate residuals within each group so that group means carry no signal
    frame["y"] = 1.0 - 0.5 * frame["year"] + np.where(np.arange(len(frame)) % 2, 1.0, -1.0)
    frame["y"] += rng.normal(0, 1e-3, len(frame))
    simple = factorial([["year"]])
    model = mixed.fit_nested_lmm(spark.createDataFrame(frame), "y", simple, GROUPS)
    least, *_ = np.linalg.lstsq(simple.matrix(frame), frame["y"].to_numpy(), rcond=None)
    np.testing.assert_allclose(model.beta, least, rtol=1e-3)
    assert model.ratios.max() < 1e-2


def test_submodels_share_the_sums(spark, fitted):
    frame, df, sums, _ = fitted
    smaller = design().without("rain")
    together = mixed.fit_designs(sums, [design(), smaller])[1]
    alone = mixed.fit_nested_lmm(df, "y", smaller, GROUPS)
    assert together.loglik == pytest.approx(alone.loglik, abs=1e-6)
    table = mixed_outputs.drop_family_table(spark, sums, {"Rain": "rain", "Life": "life"})
    rows = table.orderBy("position").collect()
    assert [r["Predictor"] for r in rows] == ["Full Model", "Rain", "Life"]
    assert rows[0]["deltaAIC"] == 0.0
    assert rows[1]["AIC"] == pytest.approx(alone.aic(), abs=0.06)


def test_random_effects_fitted_and_residuals(fitted):
    frame, df, _, model = fitted
    dense = Dense(frame, design())
    *_, inverse, res = dense.solve(model.ratios)
    effects = mixed_outputs.random_effects(model)
    keys = [[*GROUPS[: k + 1]] for k in range(3)]
    for ratio, z, group, key in zip(model.ratios, dense.z, GROUPS, keys):
        expected = ratio * z.T @ inverse @ res
        order = frame[key].drop_duplicates().sort_values(key).reset_index(drop=True)
        got = effects[group].toPandas().sort_values(key).reset_index(drop=True)
        assert got[key].equals(order)
        np.testing.assert_allclose(got["effect"], expected, rtol=1e-6, atol=1e-9)
    fitted_rows = mixed_outputs.with_fitted(df, model).toPandas()
    total = dense.x @ model.beta + sum(
        r * z @ z.T @ inverse @ res for r, z in zip(model.ratios, dense.z)
    )
    keyed = frame.assign(expected=total)
    merged = fitted_rows.merge(keyed[[*GROUPS, "year", "expected"]], on=[*GROUPS, "year"])
    np.testing.assert_allclose(merged["fitted"], merged["expected"], rtol=1e-7, atol=1e-9)
    np.testing.assert_allclose(
        merged["pearson"], (merged["y"] - merged["expected"]) / math.sqrt(model.sigma2), atol=1e-8
    )


def test_r_squared_and_leverage(fitted):
    frame, df, sums, model = fitted
    x = design().matrix(frame)
    fixed = np.var(x @ model.beta, ddof=1)
    random = model.ratios.sum() * model.sigma2
    row = mixed_outputs.r_squared(df, model).first()
    assert row["R2m"] == pytest.approx(fixed / (fixed + random + model.sigma2), rel=1e-8)
    assert row["R2c"] == pytest.approx((fixed + random) / (fixed + random + model.sigma2), rel=1e-8)
    hat = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
    got = mixed_outputs.with_leverage(df, sums).toPandas()
    merged = got.merge(frame.assign(hat=hat), on=[*GROUPS, "year"])
    np.testing.assert_allclose(merged["leverage"], merged["hat"], rtol=1e-8)
    assert got["leverage"].sum() == pytest.approx(x.shape[1])


def test_containment_degrees_of_freedom(fitted):
    frame, _, sums, model = fitted
    sites = frame["site"].nunique()
    plots = len(frame[["site", "plot"]].drop_duplicates())
    taxa = len(frame[GROUPS].drop_duplicates())
    df = dict(zip(model.design.names, model.df))
    # rain varies between sites, treatments between plots, lifespan between taxa
    assert df["rain"] == sites - 1 - 1
    assert df["NPK"] == plots - sites - 3
    assert df["lifePerennial"] == taxa - plots - 1
    inside = len(frame) - taxa - 5
    assert df["year"] == df["year:NPK"] == df["(Intercept)"] == inside


def test_coefficient_and_anova_tables(spark, fitted):
    _, _, _, model = fitted
    rows = mixed_outputs.coefficient_table(spark, model).orderBy("position").collect()
    assert [r["Effect"] for r in rows] == model.design.names
    last = rows[-1]
    assert last["t.value"] == pytest.approx(last["Value"] / last["Std.Error"])
    assert last["p.value"] == pytest.approx(t_two_sided(last["t.value"], last["DF"]))
    tests = mixed_outputs.anova_table(spark, model).orderBy("position").collect()
    # the last term is adjusted for all others, so its F is the squared t
    assert tests[-1]["F.value"] == pytest.approx(last["t.value"] ** 2, rel=1e-8)
    assert tests[-1]["p.value"] == pytest.approx(last["p.value"], rel=1e-6)


def test_marginal_means_and_contrasts(fitted):
    frame, df, _, model = fitted
    grid = margins.reference_grid(df, model, {"year": [0.0, 3.0]})
    got = margins.marginal_means(grid, model).toPandas()
    assert len(got) == 8
    rain = frame["rain"].mean()
    names = model.design.names
    for _, row in got.iterrows():
        total = np.zeros(len(names))
        for life in ("Annual", "Perennial"):
            point = pd.DataFrame([{"year": row["year"], "NPK": row["NPK"], "Fence": row["Fence"],
                                   "life": life, "rain": rain}])
            total += model.design.matrix(point)[0] / 2
        assert row["emmean"] == pytest.approx(total @ model.beta)
        assert row["SE"] == pytest.approx(math.sqrt(total @ model.cov @ total))
        assert row["df"] == min(d for d, w in zip(model.df, total) if w != 0)
        width = t_quantile(0.975, row["df"]) * row["SE"]
        assert row["upper_CL"] - row["emmean"] == pytest.approx(width)
    base = margins.reference_grid(df, model, {"year": [3.0]}, treatments=False)
    pairs = margins.contrasts(base, model).toPandas()
    assert len(pairs) == 6
    means = got[got["year"] == 3.0].set_index(["NPK", "Fence"])["emmean"]
    first = pairs[pairs["contrast"] == "Control - NPK+Fence"].iloc[0]
    assert first["estimate"] == pytest.approx(means[(0.0, 0.0)] - means[(1.0, 1.0)])


def test_missing_values_are_refused(spark):
    frame = make_rows(7).astype({"y": float})
    frame.loc[3, "y"] = np.nan
    df = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    with pytest.raises(ValueError, match="missing values"):
        mixed.group_sums(df, "y", design(), GROUPS)


def test_dependent_columns_are_refused(spark):
    frame = make_rows(8)
    frame["copy"] = 2.0 * frame["rain"]
    df = spark.createDataFrame(frame)
    with pytest.raises(ValueError, match="dependent"):
        mixed.fit_nested_lmm(df, "y", factorial([["year"], ["rain"], ["copy"]]), GROUPS)


def test_t_distribution_values():
    # published two-sided 5 % points
    assert t_quantile(0.975, 10) == pytest.approx(2.228138852, abs=1e-8)
    assert t_quantile(0.975, 1) == pytest.approx(12.70620474, abs=1e-6)
    assert t_two_sided(1.959963985, 1e7) == pytest.approx(0.05, abs=1e-6)


def test_design_order_and_names():
    names = factorial([["a", "b", "c"], ["f", "a"]], {"f": ["x", "y", "z"]}).names
    assert names == ["(Intercept)", "a", "b", "c", "fy", "fz", "a:b", "a:c", "b:c", "a:fy", "a:fz",
                     "a:b:c"]


def test_offsets_far_above_the_spread_cost_no_digits(spark):
    # four groups of 1e5 rows, response and covariate about 1e6; the dense answer in extended precision
    n = 400_000
    ids = F.col("id")
    df = spark.range(n).select(
        (ids % 2).alias("site"), (ids % 4).alias("plot"),
        (ids * 7919 % 1000 / 1000.0 + 1e6).alias("x"),
        (2.0 * (ids * 7919 % 1000 / 1000.0) + ids % 4 * 0.3 + (ids * 104729 % 10007 / 10007.0) + 1e6).alias("y"),
    )
    i = np.arange(n)
    x = i * 7919 % 1000 / 1000.0 + 1e6
    y = 2.0 * (i * 7919 % 1000 / 1000.0) + i % 4 * 0.3 + (i * 104729 % 10007 / 10007.0) + 1e6
    x, y = x.astype(np.longdouble) - 1_000_000, y.astype(np.longdouble) - 1_000_000
    z = np.column_stack([np.ones(n, np.longdouble), x, y])
    ratios = (0.5, 0.25)
    total, logdet = z.T @ z, np.longdouble(0)
    tops = {0: [np.zeros(3, np.longdouble), 0], 1: [np.zeros(3, np.longdouble), 0]}
    for plot in range(4):
        s, m = z[i % 4 == plot].sum(0), np.longdouble(n // 4)
        scale = 1 / (1 + ratios[1] * m)
        total, logdet = total - ratios[1] * scale * np.outer(s, s), logdet - np.log(scale)
        tops[plot % 2][0] = tops[plot % 2][0] + s * scale
        tops[plot % 2][1] += m * scale
    for t, w in tops.values():
        scale = 1 / (1 + ratios[0] * w)
        total, logdet = total - ratios[0] * scale * np.outer(t, t), logdet - np.log(scale)
    a, b, c = total[:2, :2], total[:2, 2], total[2, 2]
    det = a[0, 0] * a[1, 1] - a[0, 1] ** 2
    slope = (a[0, 0] * b[1] - a[0, 1] * b[0]) / det
    start = (a[1, 1] * b[0] - a[0, 1] * b[1]) / det
    sigma2 = (c - start * b[0] - slope * b[1]) / (n - 2)
    sums = mixed.group_sums(df, "y", factorial([["x"]]), ["site", "plot"])
    model = mixed.model_at(sums, ratios)
    assert model.beta[1] == pytest.approx(float(slope), rel=1e-9)
    assert model.beta[0] == pytest.approx(float(start - slope * 1_000_000 + 1_000_000), rel=1e-9)
    assert model.sigma2 == pytest.approx(float(sigma2), rel=1e-9)
    assert model.cov[1, 1] == pytest.approx(float(sigma2 * a[0, 0] / det), rel=1e-9)
    twice = (n - 2) * (np.log(2 * np.longdouble(math.pi) * sigma2) + 1) + logdet + np.log(det)
    assert model.loglik == pytest.approx(float(-twice / 2), rel=1e-11)
    effects = mixed_outputs.random_effects(model)["plot"].collect()
    assert max(abs(r["effect"]) for r in effects) < 1.0


def test_leverage_of_a_doubled_column_is_that_of_the_plain_design(spark):
    frame = make_rows(8)
    frame["twice"] = 2.0 * frame["rain"] + 5.0
    df = spark.createDataFrame(frame)
    plain, doubled = factorial([["year"], ["rain"]]), factorial([["twice"], ["year"], ["rain"]])
    want = mixed_outputs.with_leverage(df, mixed.group_sums(df, "y", plain, GROUPS)).toPandas()["leverage"]
    got = mixed_outputs.with_leverage(df, mixed.group_sums(df, "y", doubled, GROUPS)).toPandas()["leverage"]
    np.testing.assert_allclose(got, want, rtol=1e-8)
    assert got.sum() == pytest.approx(3.0)


def test_studentised_range_against_tables():
    # published upper 5 % and 1 % points
    for p, means, df, q in ((0.05, 3, 10, 3.877), (0.05, 4, 20, 3.958), (0.05, 10, 5, 6.995), (0.01, 4, 20, 5.018),
                            (0.05, 3, 2, 8.331), (0.05, 4, math.inf, 3.633), (0.01, 5, 60, 4.818)):
        assert studentised_range_upper(q, means, df) == pytest.approx(p, rel=2e-3)
    # the range of two means is a t value
    for t, df in ((0.5, 3), (2.0, 7), (3.1, 40), (5.0, 1)):
        assert studentised_range_upper(t * math.sqrt(2), 2, df) == pytest.approx(t_two_sided(t, df), rel=1e-6)
    assert studentised_range_upper(0.0, 4, 9) == 1.0 and math.isnan(studentised_range_upper(math.nan, 4, 9))


def test_contrasts_carry_adjusted_p_values(fitted):
    _, df, _, model = fitted
    base = margins.reference_grid(df, model, {"year": [0.0, 3.0]}, treatments=False)
    for _, row in margins.contrasts(base, model).toPandas().iterrows():
        t = abs(row["t_ratio"])
        assert row["p_single"] == pytest.approx(t_two_sided(t, row["df"]))
        assert row["p_value"] == pytest.approx(studentised_range_upper(t * math.sqrt(2), 4, row["df"]))
        assert row["p_single"] <= row["p_value"] <= min(1.0, 6.0 * row["p_single"]) + 1e-9


def test_columns_without_spread_have_no_coefficient(spark):
    frame = make_rows(8)
    frame["same"] = 0.1
    df = spark.createDataFrame(frame)
    plain, wide = factorial([["year"], ["rain"]]), factorial([["same", "year"], ["rain"]])
    sums = mixed.group_sums(df, "y", wide, GROUPS)
    kept = mixed.estimable(sums)
    assert kept.names == ["(Intercept)", "year", "rain"]
    model = mixed.fit_designs(sums, [kept])[0]
    want = mixed.fit_nested_lmm(df, "y", plain, GROUPS)
    np.testing.assert_allclose(model.beta, want.beta, rtol=1e-5)
    assert model.aic() == pytest.approx(want.aic(), abs=1e-4)
    table = mixed_outputs.coefficient_table(spark, model, wide).toPandas().set_index("Effect")
    assert list(table.index) == wide.names and list(table.index[table["Value"].isna()]) == ["same", "same:year"]
    aic = mixed_outputs.drop_family_table(spark, sums, {"Same": "same", "Rain": "rain"}).toPandas()
    assert aic["deltaAIC"][1] == 0.0 and aic["deltaAIC"][2] != 0.0
