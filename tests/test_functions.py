"""Null rules and scalar functions on hand-made frames."""

import pytest
from pyspark.sql import functions as F

from sward.functions import predicates as P
from sward.functions import scalar as S
from sward.functions.distributions import f_upper, t_two_sided


def values(df, column="out"):
    return [row[column] for row in df.select(column).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("out")).first()["out"]


def test_negated_membership_keeps_nulls(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "x string")
    kept = df.filter(P.not_in(F.col("x"), ["A"]))
    assert {r["x"] for r in kept.collect()} == {"B", None}


def test_conditionals(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int").coalesce(1)
    assert values(df.withColumn("out", P.ifelse(F.col("x") == 1, "a", "b"))) == ["a", "b", None]
    assert values(df.withColumn("out", P.ifelse_in(F.col("x"), [1], "a", "b"))) == ["a", "b", "b"]


def test_strict_aggregate(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0), ("b", 3.0)], "g string, x double")
    x = F.col("x")
    rows = df.groupBy("g").agg(P.strict(F.sum(x), x).alias("out")).collect()
    assert {r["g"]: r["out"] for r in rows} == {"a": None, "b": 5.0}


def test_compound_exclusion(spark):
    df = spark.createDataFrame([("s", 1), ("s", 2), ("t", 2), ("s", None)], "site string, block int")
    kept = df.filter(P.except_where(F.col("site"), "s", F.col("block"), [1]))
    assert sorted((r["site"], r["block"]) for r in kept.collect()) == [("s", 1), ("t", 2)]


@pytest.mark.parametrize(
    "value,digits,expected",
    [(0.0012345, 3, 0.00123), (123456.0, 2, 120000.0), (-0.05678, 2, -0.057), (0.0, 3, 0.0)],
)
def test_significant_digits(spark, value, digits, expected):
    assert one(spark, S.signif(F.lit(value), digits)) == pytest.approx(expected)


def test_half_even(spark):
    assert one(spark, S.round_even(F.lit(0.125), 2)) == 0.12


def test_p_value_text(spark):
    texts = [one(spark, S.p_text_signif(F.lit(p))) for p in (0.001, 0.0004, 0.05)]
    assert texts == ["< 0.001", "< 0.001", "0.05"]
    assert one(spark, S.p_text_rounded(F.lit(0.0004))) == "< 0.001"
    assert one(spark, S.p_text_rounded(F.lit(0.05))) == "0.05"


def test_links(spark):
    assert one(spark, S.invlogit(S.logit(F.lit(0.3)))) == pytest.approx(0.3)
    assert one(spark, S.arcsine_root_inverse(S.arcsine_root(F.lit(0.3)))) == pytest.approx(0.3)
    assert [one(spark, S.clamp_unit(F.lit(p))) for p in (0.0, 0.5, 1.0)] == [0.01, 0.5, 0.99]


def test_treatment_codes_round_trip(spark):
    df = spark.createDataFrame([(t,) for t in [*S.TREATMENTS, None]], "trt string").coalesce(1)
    coded = df.select("trt", S.npk_flag(F.col("trt")).alias("n"), S.fence_flag(F.col("trt")).alias("f"))
    back = coded.withColumn("out", S.treatment_label(F.col("n"), F.col("f")))
    # a missing treatment is no member of any treated set
    assert values(back) == ["Control", "Fence", "NPK", "NPK+Fence", "Control"]


def test_text_functions(spark):
    assert one(spark, S.substr_between(F.lit("2019-09-18"), 6, 7)) == "09"
    assert one(spark, S.paste(F.lit("a"), F.lit(None).cast("string"), sep="_")) == "a_NA"
    assert one(spark, S.number_text(F.lit(3.0))) == "3"
    assert one(spark, S.number_text(F.lit(3.1))) == "3.1"
    assert one(spark, S.percent_change_text(F.lit(1.5), F.lit(2.0))) == "1.5 (-25.0%)"
    assert one(spark, S.relabel(F.lit("BIANNUAL"), {"ANNUAL": "Annual"})) == "BIAnnual"
    assert one(spark, S.first_match(F.lit("initial x MAP_v2"), [("initial", 2), ("MAP_v2", 7)], 1)) == 2


def test_f_tail_equals_squared_t():
    assert f_upper(2.5**2, 1, 17) == pytest.approx(t_two_sided(2.5, 17), rel=1e-12)
