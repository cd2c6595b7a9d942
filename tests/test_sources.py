"""Files in and out, and the folder for intermediate tables."""

import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sward.session import pin, shared_dir, tune
from sward.sources.remote import lines_from
from sward.sources.files import latest_file, read_remote_csv, read_survey, write_table


def test_missing_token_and_literal_null_text(spark, tmp_path):
    path = tmp_path / "cover.csv"
    path.write_text("extra,Taxon,max_cover\n1,NULL,NA\n2,A B ,3.5\n")
    got = read_survey(spark, str(path), "Taxon string, max_cover double").collect()
    assert [(r["Taxon"], r["max_cover"]) for r in got] == [("NULL", None), ("A B ", 3.5)]
    with pytest.raises(ValueError, match="missing"):
        read_survey(spark, str(path), "site_code string")


def test_columns_are_matched_file_by_file(spark, tmp_path):
    (tmp_path / "1.csv").write_text("site,Taxon\ns1,A\n")
    (tmp_path / "2.csv").write_text("site,Taxon\ns2,B\n")
    schema = "Taxon string, site string"
    assert sorted(tuple(r) for r in read_survey(spark, str(tmp_path), schema).collect()) == [("A", "s1"), ("B", "s2")]
    assert sorted(r[0] for r in read_survey(spark, str(tmp_path), "Taxon string").collect()) == ["A", "B"]
    (tmp_path / "3.csv").write_text("Taxon,extra,site\nC,x,s3\nNA,y,s4\n")
    (tmp_path / "4.csv").write_text("")
    expected = [("A", "s1"), ("B", "s2"), ("C", "s3"), (None, "s4")]
    assert sorted((tuple(r) for r in read_survey(spark, str(tmp_path), schema).collect()), key=str) == expected
    (tmp_path / "5.csv").write_text("Taxon\nD\n")
    with pytest.raises(ValueError, match="missing"):
        read_survey(spark, str(tmp_path), schema)


def test_a_failed_write_leaves_the_earlier_table(spark, tmp_path):
    day = datetime.date(2023, 6, 29)
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, x double").repartition(2)
    path = write_table(df, str(tmp_path), "t", date=day)
    broken = df.withColumn("x", F.when(F.col("k") == "b", F.raise_error(F.lit("mid-write")).cast("double")).otherwise(9.0))
    with pytest.raises(Exception, match="mid-write"):
        write_table(broken, str(tmp_path), "t", date=day)
    back = read_survey(spark, path, "k string, x double")
    assert sorted(tuple(r) for r in back.collect()) == [("a", 1.0), ("b", 2.0)]
    again = write_table(df.filter("k = 'a'"), str(tmp_path), "t", date=day)
    assert [tuple(r) for r in read_survey(spark, again, "k string, x double").collect()] == [("a", 1.0)]
    assert [p.name for p in tmp_path.iterdir()] == ["t_2023-06-29"]


def test_latest_file_by_name(spark, tmp_path):
    for name in ("plots-2022-10-10.csv", "plots-2023-06-28.csv", "other-2024-01-01.csv"):
        (tmp_path / name).write_text("a\n1\n")
    assert latest_file(spark, str(tmp_path), "plots-*").endswith("plots-2023-06-28.csv")


def test_write_and_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", None), ("b", 2.0)], "k string, x double")
    path = write_table(df, str(tmp_path), "t", date=datetime.date(2023, 6, 29))
    assert path.endswith("t_2023-06-29")
    back = read_survey(spark, path, "k string, x double")
    assert sorted(tuple(r) for r in back.collect()) == [("a", None), ("b", 2.0)]


def test_remote_lookup(spark, tmp_path):
    path = tmp_path / "names.csv"
    path.write_text("site_code,Taxon,NewTaxon\ns,A,B\n")
    schema = "site_code string, Taxon string, NewTaxon string"
    assert read_remote_csv(spark, f"file://{path}", schema).first()["NewTaxon"] == "B"
    with pytest.raises(Exception, match="missing"):
        read_remote_csv(spark, f"file://{path}", "nothing string").collect()


@pytest.mark.parametrize("step", [1, 7, 16, 1000])
def test_remote_ranges_hold_every_line_once(spark, tmp_path, step):
    path = tmp_path / "ranges.csv"
    path.write_bytes("id,text\r\n1,é\n\n2,\"a,b\"\n3,NA\n4,".encode() + b"x" * 50 + b"\n5,last")
    url = f"file://{path}"
    got = read_remote_csv(spark, url, "text string, id long", range_bytes=step).collect() if step > 1 else None
    if got is not None:
        assert sorted((r["id"], r["text"]) for r in got) == [(1, "é"), (2, "a,b"), (3, None), (4, "x" * 50), (5, "last")]
    size = path.stat().st_size
    lines = [line for a in range(0, size, step) for line in lines_from(url, a, min(size, a + step))]
    assert lines == path.read_bytes().decode().replace("\r", "").split("\n")


def test_a_remote_table_above_64_mb_is_read_by_tasks(spark, tmp_path):
    path = tmp_path / "large.csv"
    n = 1_200_000
    with open(path, "w") as out:
        out.write("id,name\n")
        for low in range(0, n, 100_000):
            out.write("".join(f"{i},{'n' * 50}{i}\n" for i in range(low, low + 100_000)))
    assert path.stat().st_size > 64 * 1024**2
    got = read_remote_csv(spark, f"file://{path}", "id long, name string", range_bytes=8 * 1024**2)
    assert got.rdd.getNumPartitions() > 8
    row = got.agg(F.count("id").alias("n"), F.sum("id").alias("s"), F.countDistinct("name").alias("d")).first()
    assert tuple(row) == (n, n * (n - 1) // 2, n)


def test_pin_uses_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_dir(spark) == folder
    pinned = pin(spark.range(5).withColumn("x", F.col("id") * 2))
    assert pinned.count() == 5
    assert all(folder in name for name in pinned.inputFiles())


def test_a_cluster_must_name_its_folder():
    cluster = SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: default),
        sparkContext=SimpleNamespace(master="yarn"),
    )
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_tune_switches_adaptive_execution_on(spark):
    assert tune(spark).conf.get("spark.sql.adaptive.skewJoin.enabled") == "true"
