"""Parquet tables by name, and report sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """One table of a dataset folder."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def write_tracking(df: DataFrame, path: str, key: str = "match_id") -> None:
    """Tracking rows partitioned by match, sorted by frame inside the files so that track look-ups skip row groups."""
    order = [c for c in ("job_id", "frame_index", "track_id") if c in df.columns]
    df.repartition(key).sortWithinPartitions(key, *order).write.partitionBy(key).parquet(path)


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    """Each row as one JSON document."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias(name))


def sample_frames(frames: DataFrame, *, stride: int = 1, start: int = 0, limit: int | None = None, frame: str = "frame_index") -> DataFrame:
    """Every stride-th frame from start on; with limit, the first so many of them per dataset."""
    if stride < 1:
        raise ValueError("stride must be at least 1")
    kept = frames.where((F.col(frame) >= start) & (F.pmod(F.col(frame) - start, F.lit(stride)) == 0))
    return kept if limit is None else kept.orderBy(frame).limit(limit)


def image_files(spark: SparkSession, folder: str, *, stride: int = 1) -> DataFrame:
    """Images of a folder in order of path, every stride-th, with their bytes and their stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").option("recursiveFileLookup", True).load(folder)
    stem = F.regexp_extract("path", r"([^/]+)\.[^.]+$", 1)
    # a rank over all names, spread over tasks: no DataFrame operator gives one
    names = spark.createDataFrame(files.select("path").rdd.map(lambda r: r[0]).sortBy(str).zipWithIndex(), "path string, i bigint")
    return files.join(names.where(F.col("i") % stride == 0), "path").select("i", "path", stem.alias("stem"), "content")


def annotated_images(spark: SparkSession, folder: str, schema: str, *, stride: int = 1) -> DataFrame:
    """Images with the parsed JSON of the same stem; null where there is none or it cannot be parsed, never dropped."""
    notes = spark.read.option("wholetext", True).option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).text(folder)
    notes = notes.select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^.]+$", 1).alias("stem"), F.from_json("value", schema).alias("annotation"))
    return image_files(spark, folder, stride=stride).join(notes, "stem", "left")


def camel_case(df: DataFrame) -> DataFrame:
    """Columns renamed from snake_case to camelCase, for a sink that wants it."""
    name = lambda c: c.split("_")[0] + "".join(p[:1].upper() + p[1:] for p in c.split("_")[1:])
    return df.toDF(*[name(c) for c in df.columns])


def shown(column: str, digits: int = 0) -> Column:
    """A number as text with so many digits, 'n/a' for null."""
    return F.when(F.col(column).isNotNull(), F.format_string(f"%.{digits}f", F.col(column).cast("double"))).otherwise("n/a")
