"""CSV and Parquet in and out."""

from __future__ import annotations

import datetime
import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sward.sources.remote import NAME, RANGE_BYTES, RemoteCsv

# Headers read at a time.
_HEADER_JOBS = 8


def read_survey(spark: SparkSession, path: str, schema: str, fmt: str = "csv") -> DataFrame:
    """Read a table with a fixed schema; NA is missing, the text NULL stays text.

    CSV columns are matched by header name, file by file: the files of a folder may carry more
    columns than the schema, each in an order of its own. A file without one of the
    schema's columns is an error; an empty file has no rows.
    """
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    files = [r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect()]
    reader = spark.read.option("header", True).option("nullValue", "NA")
    with ThreadPoolExecutor(_HEADER_JOBS) as pool:
        headers = pool.map(lambda file: tuple(reader.csv(file).columns), files)
    alike: dict[tuple[str, ...], list[str]] = {}
    for header, file in zip(headers, files):
        if header:
            alike.setdefault(header, []).append(file)
    if not alike:
        return spark.createDataFrame([], schema)
    parts = [
        _named_columns(spark, reader.option("enforceSchema", False).csv(same), schema, ", ".join(same[:3]))
        for same in alike.values()
    ]
    return reduce(DataFrame.unionAll, parts)


def _named_columns(spark: SparkSession, header: DataFrame, schema: str, path: str) -> DataFrame:
    fields = spark.createDataFrame([], schema).schema.fields
    missing = [f.name for f in fields if f.name not in header.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return header.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in fields])


def read_remote_csv(
    spark: SparkSession, url: str, schema: str, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Read a CSV file of any size by URL; each task fetches one range of its bytes.

    Columns are matched by header name. A line is a record: quoted line ends are not supported.
    Every executor must reach the address.
    """
    spark.dataSource.register(RemoteCsv)
    columns = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    options = {"url": url, "columns": json.dumps(columns), "rangeBytes": str(range_bytes)}
    return _named_columns(spark, spark.read.format(NAME).options(**options).load(), schema, url)


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the last entry by name among those in a folder that match a glob.

    An entry is a single file or a folder of part files; only names are read.
    """
    listing = spark.read.format("binaryFile").load(f"{folder}/{pattern}").select("path")
    inside = F.substring_index(F.col("path"), folder.rstrip("/") + "/", -1)
    last = listing.agg(F.max(F.substring_index(inside, "/", 1))).first()[0]
    if last is None:
        raise FileNotFoundError(f"nothing in {folder} matches {pattern}")
    return f"{folder.rstrip('/')}/{last}"


def write_table(
    df: DataFrame, folder: str, name: str, fmt: str = "csv", date: datetime.date | None = None
) -> str:
    """Write under ``folder/name_DATE`` and return that path.

    The table is written to a staging folder beside it and put in place by a rename when complete, so a
    run that fails leaves an earlier table of that date as it was.
    """
    day = (date or datetime.date.today()).isoformat()
    path = f"{folder}/{name}_{day}"
    staging = f"{folder}/_staging-{uuid.uuid4().hex}"
    spark = df.sparkSession
    to_path = spark._jvm.org.apache.hadoop.fs.Path
    files = to_path(staging).getFileSystem(spark._jsc.hadoopConfiguration())
    writer = df.write
    try:
        if fmt == "csv":
            writer.option("header", True).option("nullValue", "NA").csv(staging)
        else:
            writer.format(fmt).save(staging)
        _publish(files, to_path(staging), to_path(path), to_path(f"{folder}/_replaced-{uuid.uuid4().hex}"))
    finally:
        files.delete(to_path(staging), True)
    return path


def _publish(files, staging, path, aside) -> None:
    """Rename ``staging`` to ``path``; what stood there is deleted after, or put back on failure."""
    replaced = files.exists(path)
    if replaced and not files.rename(path, aside):
        raise OSError(f"cannot move {path.toString()} aside")
    if not files.rename(staging, path):
        if replaced:
            files.rename(aside, path)
        raise OSError(f"cannot put a table in place at {path.toString()}")
    if replaced:
        files.delete(aside, True)
