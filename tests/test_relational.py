"""Joins, ranks, rules, panels and reports on hand-made frames."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from sward.operators import crossing, describe, joins, panel, ranking, report, rules
from sward.scale import join_on, order_statistics, with_runs
from sward.session import pin


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- joins ----


def test_null_key_matches_null_key(spark):
    left = spark.createDataFrame([("a", 1), (None, 2)], "k string, x int")
    right = spark.createDataFrame([("a", 10), (None, 20)], "k string, y int")
    assert rows(joins.left_lookup(left, right, ["k"]), "x", "y") == [(1, 10), (2, 20)]


def test_duplicate_lookup_keys_fan_out_or_raise(spark):
    left = spark.createDataFrame([("a", 1)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("a", 20)], "k string, y int")
    assert joins.left_lookup(left, right, ["k"]).count() == 2
    with pytest.raises(ValueError, match="duplicate"):
        joins.left_lookup(left, right, ["k"], unique=True)


def test_first_row_lookup_spreads_one_sites_traits(spark):
    source = spark.createDataFrame([("s1", "T", "NAT"), ("s2", "T", "INT")],
                                   "site string, Taxon string, prov string")
    looked = joins.first_lookup(source.select("site", "Taxon"), source, ["Taxon"], ["prov"],
                                [F.col("site")])
    assert rows(looked, "site", "prov") == [("s1", "NAT"), ("s2", "NAT")]


def test_first_and_repeat_rows_partition_the_table(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "k string, o int")
    first = joins.first_per_key(df, ["k"], [F.col("o")])
    repeats = joins.repeats_per_key(df, ["k"], ["o"])
    assert rows(first, "o") == [(1,), (3,), (4,)]
    assert rows(repeats, "o") == [(2,), (5,)]


def test_recode_and_natural_join(spark):
    df = spark.createDataFrame([("s", "A", 1), ("t", "A", 2)], "site string, Taxon string, x int")
    fix = spark.createDataFrame([("s", "A", "B")], "site string, Taxon string, New string")
    assert rows(joins.recode_names(df, fix, ["site", "Taxon"], "Taxon", "New"), "x", "Taxon") == [
        (1, "B"), (2, "A")]
    right = spark.createDataFrame([("s", "A", 9)], "site string, Taxon string, y int")
    assert rows(joins.natural_left_join(df, right), "x", "y") == [(1, 9), (2, None)]


# ---- ranks ----


def test_rank_ties_gaps_and_null(spark):
    df = spark.createDataFrame(
        [("p", 5.0), ("p", 5.0), ("p", 3.0), ("p", 3.0), ("p", 1.0), ("p", None)], "plot string, x double")
    expected = [(1.0, 5), (3.0, 3), (3.0, 3), (5.0, 1), (5.0, 1), (None, None)]
    assert rows(ranking.with_rank(df, ["plot"], "x"), "x", "rank") == expected
    split = ranking.with_rank(df, ["plot"], "x", run_rows=1)
    assert rows(split, "x", "rank") == expected


def test_tops_with_and_without_ties(spark):
    df = spark.createDataFrame([("p", "a", 2.0), ("p", "b", 2.0), ("p", "c", 1.0), ("q", "d", None)],
                               "plot string, taxon string, x double")
    assert rows(ranking.top_ties(df, ["plot"], "x"), "taxon") == [("a",), ("b",)]
    top = ranking.top_one(df, ["plot"], "x", [F.col("taxon")])
    assert rows(top, "taxon") == [("a",), ("d",)]
    assert rows(ranking.in_tied_groups(df, ["plot"]), "taxon") == [("a",), ("b",), ("c",)]


def skewed(spark, seed=1):
    """One group holds most rows and one value repeats very often."""
    rng = random.Random(seed)
    data = [("hot", 7.0)] * 300
    data += [("hot", float(rng.randint(0, 400)) / 4) for _ in range(900)]
    data += [(f"g{rng.randint(0, 20)}", float(rng.randint(0, 30))) for _ in range(500)]
    data += [("hot", None), ("g1", None)]
    return data, spark.createDataFrame(data, "g string, x double").repartition(6)


@pytest.mark.parametrize("limit", [1, 100, 10_000])
def test_split_rank_equals_brute_force(spark, limit):
    data, df = skewed(spark)
    expected = []
    groups = {}
    for g, x in data:
        if x is not None:
            groups.setdefault(g, []).append(x)
    for g, x in data:
        expected.append((g, x, None if x is None else 1 + sum(y > x for y in groups[g])))
    got = ranking.with_rank(df, ["g"], "x", run_rows=limit)
    assert rows(got, "g", "x", "rank") == sorted(expected, key=str)


def test_rank_percentile_properties_on_both_paths(spark):
    data, df = skewed(spark, 2)
    df = df.filter("x > 0")
    plain = ranking.with_rank_percentile(df, ["g"], "x").cache()
    split = ranking.with_rank_percentile(df, ["g"], "x", run_rows=50)
    columns = ["g", "x", "rank", "rich", "perc_rank"]
    assert rows(plain, *columns) == rows(split, *columns)
    sums = plain.groupBy("g").agg(F.sum("rel_cover").alias("s"), F.max("perc_rank").alias("m"))
    for row in sums.collect():
        assert row["s"] == pytest.approx(1.0) and row["m"] == 1.0


def test_distinct_count_counts_null_once(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), ("a", None), ("b", None)], "g string, x int")
    got = ranking.with_distinct_count(df, ["g"], "x", "n").select("g", "n").distinct()
    assert rows(got, "g", "n") == [("a", 2), ("b", 1)]


def test_zero_total_gives_null_share(spark):
    df = spark.createDataFrame([("a", 0.0)], "g string, x double")
    assert ranking.with_share(df, ["g"], "x", "s").first()["s"] is None


def test_runs_keep_the_order_of_values_and_bound_a_task(spark):
    df = spark.range(60_000).select(
        F.lit("hot").alias("g"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(F.col("id") * 7919 % 60_000).cast("double").alias("x"))
    runs = with_runs(pin(df.union(df.limit(100).withColumn("x", F.lit(None)))), ["g"], "x", run_rows=1_000).cache()
    spans = runs.filter("x is not null").groupBy("__run").agg(
        F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).orderBy("__run").collect()
    assert all(a["low"] > b["high"] for a, b in zip(spans, spans[1:])) and len(spans) > 20
    # the third of the rows with one value is a run of its own, dealt over tasks: only other runs are sorted
    assert max(r["n"] for r in spans if r["low"] < r["high"]) < 15_000
    tied = next(r for r in spans if r["low"] <= 5.0 <= r["high"])
    assert tied["low"] == tied["high"] and tied["n"] >= 20_000
    assert runs.filter("x is null and __run is not null").isEmpty()


def test_rank_has_one_plan_for_all_sizes(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    plans = [ranking.with_rank(df.limit(n), ["g"], "x")._jdf.queryExecution().analyzed().toString() for n in (10, 1000)]
    windows = [[line for line in plan.split("\n") if "rank(" in line] for plan in plans]
    assert all("__run" in line and "__salt" in line for lines in windows for line in lines if "Window" in line)
    assert len(windows[0]) == len(windows[1])


# ---- description ----


def plain_quantile(values, p):
    values = sorted(values)
    at = (len(values) - 1) * p
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low if low == high else low + (at - math.floor(at)) * (high - low)


@pytest.mark.parametrize("accuracy", [20, 100, 10_000])
@pytest.mark.parametrize("by", [["g"], []])
def test_quantiles_equal_brute_force(spark, by, accuracy):
    # a coarse summary brackets all groups but the shortest, a fine one takes groups whole
    data, df = skewed(spark, 4)
    probs = [0.95, 0.0, 0.05, 0.5, 0.5, 1.0, 0.33]
    df = df.withColumn("y", -F.col("x") * F.col("x")).withColumn("none", F.lit(None).cast("int"))
    got = order_statistics(df.unionByName(df.limit(1).selectExpr("'z' as g", "cast(null as double) as x", "cast(null as double) as y", "none")),
                           by, ["x", "y", "none"], probs, accuracy)
    groups = {}
    for g, x in data:
        if x is not None:
            groups.setdefault(g if by else None, []).append(x)
    found = {r["g"] if by else None: r for r in got.collect()}
    assert set(found) == set(groups) | ({"z"} if by else set())
    for g, values in groups.items():
        assert found[g]["x"] == pytest.approx([plain_quantile(values, p) for p in probs])
        assert found[g]["y"] == pytest.approx([plain_quantile([-v * v for v in values], p) for p in probs])
        assert found[g]["none"] == [None] * len(probs)
    if by:
        assert found["z"]["x"] == [None] * len(probs)


def test_quantiles_of_an_empty_table_and_of_special_values(spark):
    empty = spark.createDataFrame([], "g string, x double")
    assert describe.quantiles(empty, [], "x", [0.5], ["m"]).collect() == [(None,)]
    assert describe.quantiles(empty, ["g"], "x", [0.5], ["m"]).collect() == []
    inf = float("inf")
    df = spark.createDataFrame([("a", inf), ("a", inf), ("a", 1.0), (None, -inf), (None, 2.0)], "g string, x double")
    got = {r["g"]: tuple(r)[1:] for r in describe.quantiles(df, ["g"], "x", [0.0, 0.5, 1.0], ["a", "b", "c"]).collect()}
    assert got == {"a": (1.0, inf, inf), None: (-inf, -inf, 2.0)}


def test_quantiles_of_ten_million_rows_in_one_group(spark):
    # few bytes at the leaves of the plan, one group, all values different
    n = 10_000_000
    df = spark.range(n).select((F.col("id") * 7919 % n).cast("double").alias("x"))
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]
    got = describe.quantiles(df, [], "x", probs, [f"q{i}" for i in range(len(probs))]).first()
    assert list(got) == pytest.approx([(n - 1) * p for p in probs])


def test_medians_of_several_columns_share_one_join(spark):
    data, df = skewed(spark, 5)
    got = describe.with_quantiles(df.withColumn("y", 2 * F.col("x")), ["g"], 0.5, {"x": "mx", "y": "my"})
    assert got.count() == len(data)
    for g, values in (("hot", [x for g, x in data if g == "hot" and x is not None]),):
        row = got.filter(F.col("g") == g).first()
        assert row["mx"] == pytest.approx(median(values)) and row["my"] == pytest.approx(2 * median(values))


def test_correlation_guards_constant_columns(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, 7.0, 5.0)], "a double, b double, c double")
    matrix = {(r["x"], r["y"]): r["r"] for r in describe.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert matrix["a", "a"] == pytest.approx(1.0) and matrix["a", "b"] == matrix["b", "a"]
    assert matrix["a", "c"] is None


def test_histogram_edges_and_constant_column(spark):
    df = spark.createDataFrame([(float(x), 3.0) for x in range(11)] + [(None, 3.0)], "x double, c double")
    assert rows(describe.histogram(df, "x", 5), "bin", "n") == [(0, 2), (1, 2), (2, 2), (3, 2), (4, 3)]
    assert rows(describe.histogram(df, "c", 5), "bin", "n") == [(0, 12)]


def test_share_of_an_empty_set_is_null(spark):
    df = spark.createDataFrame([(1,)], "x int")
    share = describe.share_where(F.col("x") == 1, F.col("x") > 5)
    assert df.agg(share.alias("s")).first()["s"] is None


# ---- rules ----


def test_site_medians_label_constant_columns_high(spark):
    df = spark.createDataFrame([("s", 3.0, 1.0), ("s", 3.0, 2.0), ("t", 9.0, 5.0)],
                               "site_code string, rich double, cover double")
    labels = {"rich": ("r", "Low", "High"), "cover": ("c", "Low", "High")}
    by_site = rules.low_high_label(df, labels)
    assert {r["r"] for r in by_site.collect()} == {"High"}
    overall = rules.low_high_label(df, labels, by=[])
    assert rows(overall, "cover", "c") == [(1.0, "Low"), (2.0, "High"), (5.0, "High")]


def test_repairs_are_ordered_and_unscoped(spark):
    df = spark.createDataFrame([("a", 235.0), ("b", 235.0), ("a", 160.0), ("c", 130.0), ("d", 120.0), ("e", None)],
                               "site string, max_cover double")
    steps = [("==", 235, 30), (">", 150, 100), ("==", 130, 80), ("==", 120, 12)]
    fixed = rules.repair_values(
        df, [{"column": "max_cover", "op": o, "match": m, "new": n} for o, m, n in steps])
    assert rows(fixed, "site", "max_cover") == [
        ("a", 100.0), ("a", 30.0), ("b", 30.0), ("c", 80.0), ("d", 12.0), ("e", None)]


def test_copied_row_keeps_its_calendar_year(spark):
    df = spark.createDataFrame([("s", "SCHIZ A", 2, 2010, 5.0), ("s", "OTHER", 2, 2010, 1.0)],
                               "site string, Taxon string, year_trt int, year int, max_cover double")
    rule = {"select": {"Taxon": "SCHIZ*", "year_trt": 2}, "set": {"year_trt": 3, "max_cover": 60}}
    got = rules.append_copies(df, [rule])
    assert rows(got.filter("year_trt = 3"), "Taxon", "year", "max_cover") == [("SCHIZ A", 2010, 60.0)]
    assert got.count() == 3


def test_specific_override_wins(spark):
    df = spark.createDataFrame([("T", "s", "NULL"), ("T", "t", "NULL"), ("U", "s", "NAT")],
                               "Taxon string, site_code string, prov string")
    got = rules.override_attributes(df, [("T", "t", "prov", "INT"), ("T", None, "prov", "NAT")])
    assert rows(got, "Taxon", "site_code", "prov") == [("T", "s", "NAT"), ("T", "t", "INT"), ("U", "s", "NAT")]


def test_exclusions_and_merges(spark):
    df = spark.createDataFrame([("s", "CAREX A"), ("t", "CAREX A"), ("s", "UNKNOWN "), ("s", None)],
                               "site_code string, Taxon string")
    merged = rules.merge_taxa(df, [{"site": "s", "prefix": "CAREX", "new": "CAREX SP."}])
    got = rules.exclude_values(merged, [("Taxon", "UNKNOWN ")])
    assert rows(got, "site_code", "Taxon") == [("s", "CAREX SP."), ("s", None), ("t", "CAREX A")]


def plain_merge(site, name, given):
    for rule in given:
        if name is not None and rule.get("site") in (None, site):
            if name.startswith(rule["prefix"]) if "prefix" in rule else name in rule["names"]:
                name = rule["new"]
    return name


def test_merges_equal_one_rule_after_the_other(spark):
    draw = random.Random(3)
    for trial in range(4):
        letters = "abé"
        word = lambda most: "".join(draw.choice(letters) for _ in range(draw.randint(0, most)))
        given = []
        for _ in range(12):
            match = {"prefix": word(2)} if draw.random() < 0.5 else {"names": [word(3) for _ in range(3)]}
            given.append({"site": draw.choice(["s", "t", None]), "new": word(3), **match})
        data = [(i, draw.choice(["s", "t", None]), draw.choice([None, *[word(4) for _ in range(9)]])) for i in range(200)]
        df = spark.createDataFrame(data, "id long, site_code string, Taxon string")
        want = [(i, s, plain_merge(s, n, given)) for i, s, n in data]
        got = rules.merge_taxa(df, given)
        assert got.columns == df.columns
        assert {r["id"]: r["Taxon"] for r in got.collect()} == {i: n for i, _, n in want}
    assert rules.merge_taxa(df, []).collect() == df.collect()


def test_ten_thousand_merges_have_the_plan_of_ten(spark):
    def made(n):
        return [{"site": f"s{i % 7}", "prefix": f"P{i:05d}", "new": f"G{i:05d}"} for i in range(n)]

    df = spark.createDataFrame([(f"s{i % 7}", f"P{i:05d} x") for i in range(0, 10_050, 50)], "site_code string, Taxon string")
    few, many = (rules.merge_taxa(df, made(n)) for n in (10, 10_000))
    size = [len(f._jdf.queryExecution().optimizedPlan().toString().splitlines()) for f in (few, many)]
    assert size[0] == size[1]
    assert sorted(r["Taxon"] for r in many.collect()) == sorted(
        f"G{i:05d}" if i < 10_000 else f"P{i:05d} x" for i in range(0, 10_050, 50))


def test_sentinel_audit(spark):
    df = spark.createDataFrame([("A", "NULL"), ("A", "NULL"), ("B", "NULL"), ("C", "x")], "Taxon string, life string")
    got = rules.sentinel_audit(df, ["life"], ["NULL", "UNK"])
    assert rows(got, "column", "sentinel", "n_rows", "n_taxa") == [("life", "NULL", 3, 2)]


# ---- panel ----


def test_panel_fills_gaps_and_keeps_out_of_range_rows(spark):
    df = spark.createDataFrame(
        [("s", 1, "A", 0, 5.0, 1, 2), ("s", 1, "A", 2, None, 2, 2), ("s", 1, "A", 4, 1.0, 3, 2), ("t", 1, "B", 0, 7.0, 1, 0)],
        "site string, plot int, Taxon string, year_trt int, cover double, rank int, max_year int")
    got = panel.complete_panel(df, ["site", "plot"], ["Taxon"], "year_trt", "max_year", {"cover": 0.0})
    assert rows(got, "site", "year_trt", "cover", "rank") == [
        ("s", 0, 5.0, 1), ("s", 1, 0.0, None), ("s", 2, 0.0, 2), ("s", 4, 1.0, 3), ("t", 0, 7.0, 1)]
    kept = panel.drop_empty_periods(got, ["site", "year_trt"], "cover")
    assert rows(kept, "site", "year_trt") == [("s", 0), ("s", 4), ("t", 0)]


def test_panel_size_is_entities_times_years(spark):
    df = spark.createDataFrame([("s", p, t, 0, 1.0, 6) for p in range(5) for t in "ab"],
                               "site string, plot int, Taxon string, year_trt int, cover double, max_year int")
    got = panel.complete_panel(df, ["site", "plot"], ["Taxon"], "year_trt", "max_year", {"cover": 0.0})
    assert got.count() == 5 * 2 * 7


# ---- crossings and reports ----


def test_crossing_rules(spark):
    data = [("never", t, 0.9) for t in range(4)] + [("once", 0, 0.1), ("once", 1, 0.0)]
    data += [("touch", 0, 0.9), ("touch", 1, 0.5), ("touch", 2, 0.4), ("dip", 0, 0.9), ("dip", 1, 0.2), ("dip", 2, 0.9)]
    df = spark.createDataFrame(data, "k string, t int, v double")
    got = df.groupBy("k").agg(crossing.first_below(F.col("v"), F.col("t"), F.lit(0.5)).alias("time"))
    assert rows(got, "k", "time") == [("dip", 1), ("never", 3), ("once", 0), ("touch", 2)]


def test_report_flags(spark):
    data = [("Low", "Control", 5.0, 6.0, 4.0), ("Low", "NPK", 3.0, 4.5, 2.0), ("Low", "Fence", 4.0, 5.5, 3.0),
            ("High", "Control", 8.0, 9.0, 7.0), ("High", "NPK", 3.5, 9.0, 2.0), ("High", "Fence", 9.0, 10.0, 8.5)]
    times = spark.createDataFrame(data, "level string, trt string, mean_time double, upper_time double, lower_time double")
    starred = crossing.flag_against_control(times, ["level"])
    final = crossing.flag_against_level(starred, F.col("level") == "Low")
    table = crossing.pivot_treatments(final, ["level"], "text")
    assert table.columns == ["level", "Control", "Fence", "NPK", "NPK+Fence"]
    assert rows(table, *table.columns) == [("High", "8†", "9*†", "3.5", None), ("Low", "5", "4", "3*", None)]


def test_report_shapes(spark):
    df = spark.createDataFrame([(1, 5, "x")], "numDF int, denDF int, Effect string")
    assert report.unite(df, "DF", ["numDF", "denDF"], ",").first()["DF"] == "1,5"
    assert report.relocate_before(df, "Effect", "numDF").columns == ["Effect", "numDF", "denDF"]
    wide = df.toDF("Sepal-Length", "a-b", "c")
    assert report.rename_matching(wide, "Length", "-", ".").columns == ["Sepal.Length", "a-b", "c"]
    stacked = report.stack_tables([df.select("numDF"), df.select("Effect")])
    assert rows(stacked, "numDF", "Effect") == [(1, None), (None, "x")]


def test_join_without_keys_fails_on_two_rows(spark):
    left = spark.range(3)
    one = spark.createDataFrame([(7,)], "v long")
    assert [r["v"] for r in join_on(left, one, [], "left").collect()] == [7, 7, 7]
    with pytest.raises(Exception, match="needs one row at most"):
        join_on(left, spark.createDataFrame([(1,), (2,)], "v long"), [], "left").collect()


def test_rank_percentile_computes_its_input_once_and_ranks_without_splitters(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("x"))
    got = ranking.with_rank_percentile(df.mapInPandas(count, df.schema), ["g"], "x")
    assert got.count() == 100 and got.filter("rank = 1").count() == 3
    assert seen.value == 100
    # a row that carried its group's splitters grew with the group
    plan = ranking.with_rank(df, ["g"], "x", run_rows=10)._jdf.queryExecution().analyzed().toString()
    assert "splitters" not in plan


def test_panel_and_persistence_table_compute_shared_rows_once(spark, monkeypatch):
    from catalog import base, persistence

    names = "site_code string, plot long, Taxon string, year_trt long, cover double, max_cover double, rank long, perc_rank double"
    small = [("s", 1, t, y, 0.5, c, 1, 1.0 - y / 10) for t, c in (("a", 9.0), ("b", 4.0)) for y in (0, 2)]
    monkeypatch.setattr(base, "ranked", lambda *_: spark.createDataFrame(small, names))
    ranked, cohort, filled = base.panel(spark, "")
    assert rows(filled, "Taxon", "year_trt", "cover") == [("a", 0, 0.5), ("a", 1, 0.0), ("a", 2, 0.5)]
    assert filled._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    calls = []

    def followed(*_):
        calls.append(1)
        data = [("s", trt, "Annual", y, 1.0 - y / 10) for trt in ("Control", "NPK", "Fence", "NPK+Fence") for y in range(3)]
        return spark.createDataFrame(data, "site_code string, trt string, local_lifespan string, year_trt long, perc_rank double")

    monkeypatch.setattr(persistence, "followed", followed)
    assert persistence.stacked_persistence_table(spark, "").count() == 2 and len(calls) == 1


def test_rank_percentile_without_dealing_equals_the_dealt_one(spark):
    data = [(g, t, None if i % 11 == 0 else float(i % 5)) for t in range(3) for g in ("a", "b", None) for i in range(40)]
    data += [("zero", 0, 0.0), ("zero", 0, None), ("large", 0, 1.0)] + [("large", 0, float(i % 7)) for i in range(400)]
    df = spark.createDataFrame(data, "g string, t int, x double")
    columns = ["g", "t", "x", "rich", "rel_cover", "rank", "perc_rank"]
    for run_rows in (1_000_000, 50):
        dealt, whole = (ranking.with_rank_percentile(df, ["t", "g"], "x", run_rows, way) for way in (True, False))
        assert dealt.columns == whole.columns and sorted(columns) == sorted(whole.columns)
        assert rows(whole, *columns) == rows(dealt, *columns)


def test_panel_stores_covers_of_its_years_alone(spark, tmp_path, monkeypatch):
    from datetime import datetime

    from catalog import base

    tables = {
        "region": ([(0, "R")], "r_regionkey int, r_name string"),
        "nation": ([(0, "N", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(1, 0), (2, 0)], "s_suppkey long, s_nationkey int"),
        "part": ([(1, "Brand#1", "LARGE"), (2, "Brand#2", "PROMO"), (3, None, "SMALL"), (4, None, "LARGE")],
                 "p_partkey long, p_brand string, p_type string"),
        "lineitem": (
            [(o, p, s, 1, q, 0.1, "N", datetime(y, 5, 1)) for o, p, s, q, y in (
                (1, 1, 1, 9.0, 1994), (2, 1, 1, 4.0, 1995), (3, 1, 1, 8.0, 1995), (4, 2, 1, 2.0, 1995), (5, 1, 1, 3.0, 1996),
                (6, 4, 2, 5.0, 1995), (7, 3, 2, 5.0, 1995), (8, 2, 2, 1.0, 1996), (9, None, 1, 7.0, 1995))],
            "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_tax double, l_returnflag string, l_shipdate timestamp",
        ),
    }
    for name, (data, schema) in tables.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    stored, pin = [], ranking.pin
    monkeypatch.setattr(ranking, "pin", lambda df: stored.append(pin(df)) or stored[-1])
    got = base.followed(spark, str(tmp_path))
    # two rows without a name share a plot: the first one in order gives the traits
    assert rows(got, "plot", "Taxon", "year_trt", "max_cover", "func_simple", "local_lifespan", "avgCover") == sorted([
        (1, "Brand#1/LARGE", 0, 8.0, "Graminoid", "Perennial", 0.8), (1, "Brand#1/LARGE", 1, 3.0, "Graminoid", "Perennial", 0.8),
        (2, None, 0, 5.0, "Graminoid", "Perennial", 1.0), (2, None, 1, 0.0, "Graminoid", "Perennial", 1.0),
    ], key=str)
    assert set(stored[0].columns) == {*base.KEY, "max_cover"}
    assert stored[0].filter("year_trt < 0").count() == 0
