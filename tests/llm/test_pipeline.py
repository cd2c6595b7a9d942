"""Stages of the corpus pipeline on small tables: nulls, empty, long, tied and repeated rows, clashing names, no rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from sward.llm.decontaminate import find_leaks

rng = random.Random(3)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, __copies long, size string, kept int, copies int, component_id long"


def prose(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


BASE, LEAK = prose(120), prose(14)


@pytest.fixture(scope="module")
def rows():
    texts = [(1, BASE), (1, BASE), (1, BASE), (2, BASE + " tail"), (3, prose(90)), (3, prose(90)), (None, prose(80)), (None, None), (4, ""),
             (5, "  \n"), (6, prose(50) + " " + LEAK + " " + prose(50)), (7, prose(20_000)), *[(10 + i, prose(60)) for i in range(30)]]
    return [(i, t, "en", ["a", "b", None][k % 3], None if t is None else len(t), "x", 9, "s", 1, 7, 3) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, LEAK), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(4).cache()


def counted(df):
    return Counter(tuple(r) for r in df.select(*[f"`{c}`" for c in SCHEMA.replace(",", "").split()[::2]]).collect())


def test_quality_keeps_whole_rows(spark, docs, rows, folder):
    got = pipeline.keep_good(spark, docs, folder)
    assert got.columns == docs.columns
    assert not counted(got) - Counter(rows)


def test_one_row_of_each_group_stays(spark, docs, rows, folder):
    got = counted(pipeline.keep_one_of_each(spark, docs, folder))
    groups = [r for r in rows if (r[1] or "").startswith(BASE)]
    assert sum(got[r] for r in set(groups)) == 1
    others = Counter(r for r in rows if r not in groups)
    assert Counter({r: n for r, n in got.items() if r not in groups}) == others  # texts under one id too


def test_leaks_go(spark, docs, rows, folder):
    got = counted(pipeline.drop_leaks(spark, docs, folder))
    assert got == Counter(r for r in rows if LEAK not in (r[1] or ""))


def test_mix_gives_every_row_its_own_copies(spark, docs, rows, folder):
    got = counted(pipeline.mix(spark, docs, folder))
    many = Counter(rows)
    assert all(n <= 3 * many[r] for r, n in got.items())
    sizes = Counter()
    for r, n in got.items():
        sizes[r[3]] += n * len((r[1] or "").split())
    total = Counter()
    for r in rows:
        total[r[3]] += len((r[1] or "").split())
    # the sources by name weigh 5, 2, 1 (null last), up to 3 times their size
    everything = sum(total.values())
    want = {"a": min(3 * total["a"], everything * 5 / 8)}
    rest = everything - want["a"]
    want["b"] = min(3 * total["b"], rest * 2 / 3)
    want[None] = min(3 * total[None], rest - want["b"])
    longest = max(len((r[1] or "").split()) for r in rows)
    assert all(abs(sizes[s] - want[s]) <= longest for s in want)


def test_shard_replaces_a_column_of_its_name(spark, docs, rows, folder):
    got = pipeline.shard(spark, docs, folder)
    assert sorted(got.columns) == sorted(docs.columns)
    placed = got.select("text", "shard").collect()
    assert len(placed) == len(rows) and {r["shard"] for r in placed} <= set(range(8))
    assert len({r["shard"] for r in placed if r["text"] == BASE}) == 1


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_empty_tables_pass_through(spark, docs, folder, name, stage):
    got = stage(spark, docs.limit(0), folder)
    assert got.count() == 0 and set(got.columns) == set(docs.columns)


def test_stages_run_one_after_the_other(spark, docs, rows, folder, tmp_path):
    docs.write.parquet(f"{folder}/documents.parquet", mode="overwrite")
    got = pipeline.run(spark, folder)
    left = [r for r in got.select("doc_id", "text", "shard").collect()]
    assert not any(LEAK in (r["text"] or "") for r in left)
    assert all(r["text"] in {x[1] for x in rows} for r in left)


def test_leaks_of_items_with_text_ids(spark, docs):
    items = spark.createDataFrame([("b10", LEAK), ("b9", LEAK), ("c", None)], "item_id string, text string")
    row = find_leaks(docs, items).filter(F.col("doc_id") == 6).first()
    assert row["items"] == ["b10", "b9"] and row["n_items"] == 2 and row["contaminated"]


def test_quality_classifier_holds_little_beside_its_texts():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from sward.llm import classifier
    from sward.llm.common import text_slices

    words = "word %d, other %d. More words here; " * 8
    batch = pa.RecordBatch.from_arrays([pa.array([words % tuple(range(i, i + 16)) for i in range(6000)])], names=["text"])

    def scores(**slices):
        out = []
        for _, _, text in text_slices(batch, **slices):
            index, row, value = classifier.features(text)
            out.append(np.bincount(row, weights=value * np.sin(index), minlength=text.rows))
        return np.concatenate(out)

    whole = scores()
    tracemalloc.start()
    cut = scores(size=classifier.SLICE_BYTES)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(whole, cut)  # a score depends on its text alone, to the last bit
    assert peak < 64e6  # slices of 2 MB take 122 MB
